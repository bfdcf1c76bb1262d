"""Government contract-spending analytics as plain Spark DataFrame functions."""
