"""Operators for training-data corpora: packing, rules, tokens, duplicates, filters, scores."""
