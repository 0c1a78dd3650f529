"""Operators on text for training data."""
