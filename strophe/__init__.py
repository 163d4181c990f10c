"""Labelled-sequence analytics as DataFrame operators."""
