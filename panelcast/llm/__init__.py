"""Operators of a training-data pipeline over text tables (documents, pages, conversations)."""
