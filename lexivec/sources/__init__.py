"""Readers and writers: text corpora, vector files and binary model files."""
