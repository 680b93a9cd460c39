"""Readers and writers: extraction documents, instance text, source files."""
