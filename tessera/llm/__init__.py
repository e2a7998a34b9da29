"""Operators of a training-data pipeline: language, quality, packing, deduplication, tokens, media, search, chat."""
