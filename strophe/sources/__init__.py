"""Listing, naming, ingestion and storage of the input tables."""
