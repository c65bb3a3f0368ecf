"""Percentiles of very large columns by cumulative frequencies.

A table of (groups, value, count) is the mergeable summary: tables of separate days, files or runs are put together
by adding counts (:func:`merge_counts`) before :func:`percentiles` reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.plans.lineage import cut


def quantised(value: Column, bits: int | None) -> Column:
    """``value`` cut towards zero to ``bits`` binary digits after the leading one; ``None`` keeps it exact.

    The relative error is below ``2**-bits``. Only comparisons and powers of two are involved, so the result is the
    same on every machine. Zero stays zero.
    """
    if bits is None:
        return value
    size = F.abs(value)
    near = F.floor(F.log2(size))  # may be one off next to a power of two
    exponent = near + F.when(F.pow(F.lit(2.0), near + 1) <= size, 1).when(F.pow(F.lit(2.0), near) > size, -1).otherwise(0)
    step = F.pow(F.lit(2.0), exponent - bits)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.signum(value) * F.floor(size / step) * step)


def compact_id(name: Column) -> Column:
    """A UUID in lower case as its 16 bytes, any other text as its own bytes; null stays null. Equal only if equal."""
    uuid = F.rlike(name, F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))
    return F.when(uuid, F.unhex(F.translate(name, "-", ""))).otherwise(F.concat(F.lit("id ").cast("binary"), name.cast("binary"), F.lit(" of no fixed size").cast("binary")))


def text_of_id(compact: Column) -> Column:
    """The text that :func:`compact_id` was given."""
    uuid = F.regexp_replace(F.lower(F.hex(compact)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.octet_length(compact) == 16, uuid).otherwise(F.substr(compact, F.lit(4), F.octet_length(compact) - 20).cast("string"))


def is_value(number: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))


def value_counts(df: DataFrame, groups: Sequence[str], value: str, *, bits: int | None = None) -> DataFrame:
    """The mergeable summary ``(*groups, value, n)`` of a numeric column.

    Nulls, NaN and infinities are no values and leave no row; negative values count as they are. Null group keys form a group.
    With ``bits`` a group has at most ``2**bits`` values per power of two, however many rows it has, and rows are added
    up before the shuffle. An empty table gives an empty summary.
    """
    number = F.col(value).cast("double")
    return df.where(is_value(number)).select(*groups, quantised(number, bits).alias("value")).groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add up summaries (a union of them, or one with finer groups) for ``groups``."""
    return counts.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: Sequence[str], per_myriad: Sequence[int], *, piece_bits: int = 5, most_broadcast: int = 250_000) -> DataFrame:
    """``(*groups, per_myriad, total, value)``: the smallest value whose cumulative count reaches ``ceil(q * total)``
    (at least 1), for each ``q = per_myriad / 10000`` and group.

    The summary is sorted by range over (groups, value), so a group as large as a third of all rows lies in many
    partitions. Totals of partitions give offsets to the pieces of ``2**piece_bits`` rows inside them, and these to the
    rows; only rows of pieces that hold a target rank are summed one by one, and found by a broadcast of the pieces'
    numbers where these are at most ``most_broadcast``, else by a shuffle.
    Which piece holds which row is fixed by a copy in the shared checkpoint folder. Null keys match each other.
    """
    order = [F.col(g) for g in groups] + [F.col("value")]
    # A number of 64 bits that rises in the sorted order of each partition; its upper bits are the partition's.
    sorted_parts = cut(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_piece", F.shiftright(F.monotonically_increasing_id(), piece_bits)))
    part = F.shiftright("_piece", 33 - piece_bits)
    pieces = cut(sorted_parts.groupBy(*groups, "_piece").agg(F.sum("n").alias("_n")))
    by_group, by_part = Window.partitionBy(*groups), Window.partitionBy(*groups, "_part")
    so_far = (Window.unboundedPreceding, -1)

    def same(names: Sequence[str]) -> Column:
        on = F.lit(True)
        for g in groups:
            on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        for name in names:
            on = on & (F.col(name) == F.col(f"_g_{name}"))
        return on

    def keys(names: Sequence[str]) -> list[Column]:
        return [F.col(c).alias(f"_g_{c}") for c in (*groups, *names)]

    rank = F.greatest(F.expr("(total * per_myriad + 9999) div 10000"), F.lit(1))
    parts = (
        pieces.groupBy(*groups, part.alias("_part")).agg(F.sum("_n").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_group.orderBy("_part").rowsBetween(*so_far)), F.lit(0)))
        .withColumn("total", F.sum("_n").over(by_group))
        .withColumn("per_myriad", F.explode(F.array(*(F.lit(int(q)) for q in per_myriad))))
        .withColumn("_rank", rank - F.col("_before")).where(F.col("_rank").between(1, F.col("_n")))
        .select(*keys(["_part"]), "per_myriad", "total", "_rank")
    )
    offsets = pieces.withColumn("_part", part).withColumn("_before", F.coalesce(F.sum("_n").over(by_part.orderBy("_piece").rowsBetween(*so_far)), F.lit(0)))
    targets = cut(
        offsets.join(parts, same(["_part"])).withColumn("_rank", F.col("_rank") - F.col("_before")).where(F.col("_rank").between(1, F.col("_n")))
        .select(*keys(["_piece"]), "per_myriad", "total", "_rank")
    )
    wanted = targets.select(F.col("_g__piece").alias("_piece")).distinct()
    if wanted.count() <= most_broadcast:  # 8 bytes each
        wanted = F.broadcast(wanted)
    running = Window.partitionBy(*groups, "_piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = sorted_parts.join(wanted, "_piece", "left_semi").withColumn("_upto", F.sum("n").over(running))
    reached = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("n") < F.col("_rank"))
    return rows.join(targets, same(["_piece"]) & reached).select(*groups, "per_myriad", "total", "value")
