"""lexivec: text classification, text embeddings and corpus preparation on PySpark."""
