"""Readers and writers of the text formats of the field, and of tables."""
