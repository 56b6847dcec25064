"""Operators of a training-data pipeline: quality, sharding, WARC, de-duplication, decontamination,
chat formatting, toxicity and subword tokens.  Nothing else in the library imports this package."""
