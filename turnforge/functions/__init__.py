"""Column-level helpers: every function takes and returns ``Column`` objects
built only from ``pyspark.sql.functions`` so that they stay inside
whole-stage code generation."""
