"""Dense, banded, packed and triangular linear algebra as Spark DataFrame work."""
