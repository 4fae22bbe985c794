"""Incremental closure over streams."""
