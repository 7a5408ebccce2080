"""Operators for preparing training data, each over whole tables and whole texts.

Nothing else in the library imports this package."""
