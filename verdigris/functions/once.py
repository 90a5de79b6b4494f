"""Computing a column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """df with new columns that are computed once per row and then referred to.

    Neighbouring projections are merged by the optimiser, which repeats an expression wherever it is referred to; with
    expressions that use a parsed question or a slot array dozens of times, plans grow exponentially. A generator of one
    row is a boundary it doesn't merge across; it costs no exchange and stays within whole-stage code generation.
    """
    names = [c for c in df.columns if c not in cols]
    x = F.explode(F.array(F.struct(*(c.alias(k) for k, c in cols.items()))))
    return df.select(*names, x.alias("_once")).select(*names, *(F.col(f"_once.{k}").alias(k) for k in cols))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: inside a lambda an outer expression is evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
