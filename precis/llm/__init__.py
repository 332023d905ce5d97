"""Operators of a training-data pipeline: quality rules, substring and document
dedup, language-model scores, language identification, toxicity, WARC
archives, nearest neighbours, source mixing and sequence packing.

Nothing outside this package imports it."""
