"""Scalar functions: column expressions first, Arrow-batched Python where Spark has no built-in."""
