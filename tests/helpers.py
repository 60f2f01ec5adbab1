"""Helpers for the tests."""


def one(spark, expr, value, schema="v string"):
    """Evaluate a Column expression on one row holding ``value``."""
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).collect()[0]["r"]
