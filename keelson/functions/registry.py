"""SQL functions of the engine, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name -> signature and body; they are inlined by the optimizer.
FUNCTIONS = {
    "vec_dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_norm": "(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "ball_bound": "(q ARRAY<DOUBLE>, c ARRAY<DOUBLE>, r DOUBLE) RETURNS DOUBLE RETURN aggregate(zip_with(q, c, (x, y) -> x * y), 0D, (s, x) -> s + x) + r * sqrt(aggregate(q, 0D, (s, x) -> s + x * x))",
    "box_bound": "(q ARRAY<DOUBLE>, lo ARRAY<DOUBLE>, hi ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(q, zip_with(lo, hi, (a, b) -> named_struct('a', a, 'b', b)), (x, c) -> greatest(x * c.a, x * c.b)), 0D, (s, x) -> s + x)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
