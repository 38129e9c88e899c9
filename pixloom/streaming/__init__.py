"""The same pipelines on streams."""
