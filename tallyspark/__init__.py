"""A Spark engine that audits retrieval pipelines."""
