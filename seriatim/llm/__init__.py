"""Preparation of training data: spans, nearest matches, vectors, survivors, tokens, packing, residue."""
