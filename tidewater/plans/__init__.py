"""Plan shapes shared by the operators: chunked windows, scans, quantiles, interval and as-of joins."""
