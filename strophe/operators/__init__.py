"""Operators over segments, arrays, vectors, scores, sequences, features and pedigrees."""
