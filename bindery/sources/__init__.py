"""Readers and writers of catalogues and text corpora."""
