"""Operators for training-data pipelines: tokens, quality, privacy, language models, packing, pages, duplicates, search."""
