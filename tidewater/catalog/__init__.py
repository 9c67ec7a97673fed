"""The registered queries, grouped by topic."""

import importlib

_TOPICS = ("indicators", "ingest", "features", "metrics", "trading", "analytics", "streams", "plugins")
for _t in _TOPICS:
    importlib.import_module(f"tidewater.catalog.{_t}")

from tidewater.catalog.registry import ORACLES, QUERIES  # noqa: E402,F401
