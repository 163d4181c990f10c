"""Operators for large training corpora: dedup, mixing, packing, scoring, token counts, search."""
