"""Preparation of training corpora: screening, deduplication, packing and token files."""
