"""As-of lookup: of each row, the last earlier row of its key that qualifies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(df: DataFrame, *, by: str, order: Sequence[str], source: Column, value: Column, span: Column, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the last row before it, in ``order``, of the same ``by`` for which ``source`` holds.

    Keys are split by ``span`` (of which ``order`` must be no finer or equal: a day, an hour), so a key with a third of all
    rows is spread over its spans; each span takes over the last value of the spans before, one row per key and span.
    ``order`` must tell all rows of a key apart, else any of the equal ones may come first. Rows without a key are left
    out; a row with nothing before it has null; an empty table gives an empty result.
    """
    rows = df.where(F.col(by).isNotNull()).withColumn("_span", span)
    last = F.max(F.when(source, F.struct(*order, value.alias("_value"))))
    before = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(by, "_span").agg(last.alias("_last")).select(F.col(by).alias("_by"), F.col("_span").alias("_at"), F.last("_last._value", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.last(F.when(source, value), ignorenulls=True).over(inside), F.col("_carried"))
    joined = rows.join(spans, (F.col(by) == F.col("_by")) & F.col("_span").eqNullSafe(F.col("_at")))
    return joined.withColumn("_found", found).select(*df.columns, F.col("_found").alias(name))
