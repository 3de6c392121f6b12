"""Audits of large corpora of identity and compliance documents, as Spark DataFrame transformations."""
