"""Versioned keyed tables on Spark: an append-only log of typed row versions and DataFrame views over it."""
