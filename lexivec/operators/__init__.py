"""Vocabulary, features, scoring, metrics, training, quantization and search as DataFrame operators."""
