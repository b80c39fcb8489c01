"""Spark jobs over captured subtitle-site data, and operators for building training corpora."""
