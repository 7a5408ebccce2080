"""Narration planning and media-timeline analytics as PySpark DataFrame operators."""
