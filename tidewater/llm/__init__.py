"""Operators for training-data pipelines: sharding, chat formatting, near duplicates, decontamination,
tokenising, language-model scoring, line dedup, toxicity, nearest neighbours and URL filters.

Nothing outside this folder imports it; ``catalog`` holds the registered queries and their SQL.
"""
