"""foliant: document-archive intelligence as plain Spark DataFrame functions."""
