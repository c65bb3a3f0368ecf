"""Implausible measurements per source: jumps, stuck values and impossible readings.

The work is split by source *and* by blocks of consecutive readings, so a source that holds a third of all
rows is spread over many tasks. A block carries the readings next to it (the halo), which is all that the local
tests need. All rows are shuffled twice: once to merge the copies of a reading, once into blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.plans.lineage import cut

#: Blanks around a name: white space, separators, control and invisible format characters.
BLANK = r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$"


def source_key(name: Column) -> Column:
    """All spellings of a source (letter case, outer blanks) as one key."""
    return F.lower(F.regexp_replace(name, BLANK, ""))


def _readings(rows: DataFrame, hours: int) -> DataFrame:
    """Each reading once, with its span of ``hours``.

    ``_a`` and ``_z`` are the least and the greatest id of its rows and ``_rows`` their number, so rows need no second
    look unless a reading may have more than two ids. All of it merges before the shuffle: an hour delivered a million
    times costs no more than others.
    """
    span = F.expr(f"timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', _ts) div {hours}")
    return rows.groupBy("_source", span.alias("_span"), "_ts", "_value").agg(F.min("_id").alias("_a"), F.max("_id").alias("_z"), F.count(F.lit(1)).alias("_rows"))


def _blocks(readings: DataFrame, size: int, halo: int) -> DataFrame:
    """``readings`` by ``_block``: ``size`` consecutive readings of a source, with at least ``halo`` more on either side.

    Whole spans go to all blocks that they may touch; the readings before each span (``_before``) come from counts.
    """
    before = Window.partitionBy("_source").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut(
        readings.groupBy("_source", "_span").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_source", "_span", "_before", F.sequence(F.greatest(F.floor((F.col("_before") - halo) / size), F.lit(0)), F.floor((F.col("_before") + F.col("_n") - 1 + halo) / size)).alias("_block"))
    )
    return readings.join(spans, ["_source", "_span"]).withColumn("_block", F.explode("_block"))


def _least(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def _departure(x: dict[int, Column], longest: int) -> Column:
    """How far the reading's segment (of at most ``longest`` readings) stands off the straight line between the
    readings just before and after, less the distance of these two from each other. Negative or null: not at all."""
    found = []
    for length in range(1, longest + 1):
        for first in range(1 - length, 1):  # the segment's first reading, counted from this one
            before, after = x[first - 1], x[first + length]
            off = [x[first + k] - (before + (after - before) * F.lit((k + 1) / (length + 1))) for k in range(length)]
            up, down = _least(off), _least([-o for o in off])
            found.append(F.greatest(up, down) - F.abs(after - before))
    return F.greatest(*found)  # ignores nulls: at a source's ends some segments have no reading before or after


def flag_implausible(
    df: DataFrame,
    *,
    id_col: str,
    source_col: str,
    time_col: str,
    value_col: str,
    low: float = -95.0,
    high: float = 62.0,
    half_window: int = 3,
    longest_jump: int = 3,
    stuck_run: int = 12,
    gate: float = 2.0,
    factor: float = 3.3,
    block: int = 8192,
    span_hours: int = 256,
) -> DataFrame:
    """Rows whose value is impossible, belongs to a short jump or to a stuck run: ``(id, reason)``.

    * ``bounds``: outside ``low..high`` or infinite; such values take no part in what follows.
    * ``jump``: a Hampel test against the rolling median of ``2 * half_window + 1`` readings passes ``gate``
      scales, and a segment of at most ``longest_jump`` readings stands off the line between its neighbours by
      more than ``factor`` scales plus the neighbours' own difference (so a level that stays is none). The scale
      is per source: the larger of 1.4826 times the median absolute deviation from the rolling median and the
      deviations' 95th percentile, which carries sources so rounded that most deviations are 0. It comes from a
      histogram of deviations in steps of 0.01, so it needs no sort of a source.
    * ``stuck``: ``stuck_run`` or more stored readings in a row that are exactly equal.

    Nulls and NaN are no readings and never flagged; rows without source or time are tested for bounds only.
    Copies of a row and redelivered readings of one hour count once, yet every row of a flagged reading comes
    out (once per id and reason); a row without an id takes part and can't come out. An empty table gives an empty
    result. Other columns are never read.

    ``span_hours`` should hold no more readings than ``block``: whole spans are copied at the edges of blocks.
    """
    raw = df.select(F.col(id_col).alias("_id"), source_key(F.col(source_col)).alias("_source"), F.col(time_col).alias("_ts"), F.col(value_col).cast("double").alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    inside = F.col("_value").between(low, high)
    bounds = raw.where(~inside & F.col("_id").isNotNull()).select("_id", F.lit("bounds").alias("reason"))

    plausible = raw.where(inside & F.col("_source").isNotNull() & F.col("_ts").isNotNull())
    blocks = _blocks(cut(_readings(plausible, span_hours)), block, max(stuck_run, 2 * half_window, longest_jump) + 1)
    order = Window.partitionBy("_source", "_block").orderBy("_ts", "_value")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    reach = max(half_window, longest_jump)
    around = [k for k in range(-reach, reach + 1) if k]
    x = {0: F.col("_value")} | {k: F.col(f"_at{k + reach}") for k in around}
    window = [x[k] for k in range(-half_window, half_window + 1)]
    absent = sum((v.isNull().cast("int") for v in window), F.lit(0))  # sorted first
    count = F.lit(len(window)) - absent
    middle = (F.get("_near", absent + F.floor((count - 1) / 2).cast("int")) + F.get("_near", absent + F.floor(count / 2).cast("int"))) / 2
    least = 0.05
    tested = (
        blocks.select(
            "*",
            *((F.lag if k < 0 else F.lead)("_value", abs(k)).over(order).alias(f"_at{k + reach}") for k in around),
            (F.min("_before").over(so_far) + F.row_number().over(order) - 1).alias("_rank"),
        )
        # The rank at which the run of equal values begins, and whether the run goes on to its stuck_run-th reading.
        .withColumn("_begins", F.max(F.when(~F.col("_value").eqNullSafe(x[-1]), F.col("_rank"))).over(so_far))
        .withColumn("_full", F.min(F.when(F.col("_rank") - F.col("_begins") >= stuck_run - 1, F.col("_begins"))).over(order.rowsBetween(0, stuck_run - 1)))
        .where(F.floor(F.col("_rank") / block) == F.col("_block"))
        .withColumn("_near", F.sort_array(F.array(*window)))
        .select(*("_source _ts _value _a _z _rows".split()), F.abs(F.col("_value") - middle).alias("_deviation"), _departure(x, longest_jump).alias("_off"), F.coalesce(F.col("_full") == F.col("_begins"), F.lit(False)).alias("_stuck"))
        # No scale is below ``least``, so most readings can be told from jumps already: of these only the deviation is kept.
        .withColumn("_maybe", F.col("_stuck") | F.coalesce((F.col("_off") > least * factor) & (F.col("_deviation") > least * gate), F.lit(False)))
    )
    seen = cut(tested.select("_source", "_maybe", "_deviation", *(F.when(F.col("_maybe"), F.col(c)).alias(c) for c in "_ts _value _a _z _rows _off _stuck".split())))
    upto = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        seen.groupBy("_source", F.floor(F.col("_deviation") * 100 + 0.5).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy("_source")))
    )
    scales = histogram.groupBy("_source").agg(
        F.greatest(
            F.min(F.when(F.col("_upto") * 2 >= F.col("_all"), F.col("_bin"))) * 0.01 * 1.4826,
            F.min(F.when(F.col("_upto") * 20 >= F.col("_all") * 19, F.col("_bin"))) * 0.01,
            F.lit(least),
        ).alias("_scale")
    )
    jump = (F.col("_deviation") > F.col("_scale") * gate) & (F.col("_off") > F.col("_scale") * factor)
    reasons = F.array_compact(F.array(F.when(jump, F.lit("jump")), F.when(F.col("_stuck"), F.lit("stuck"))))
    flagged = seen.where("_maybe").join(cut(scales), "_source").select("_source", "_ts", "_value", "_a", "_z", "_rows", F.explode(reasons).alias("reason"))

    many = (F.col("_rows") > 2) & (F.col("_a") != F.col("_z"))  # copies, or more ids than the two that are known
    rows = flagged.select(F.explode(F.array_compact(F.array("_a", "_z"))).alias("_id"), "reason")
    if not seen.where(F.col("_maybe") & many).isEmpty():
        again = cut(flagged.where(many).select("_source", "_ts", "_value", "reason"))  # a table's size is known: if small, it is broadcast
        rows = rows.unionByName(plausible.where(F.col("_id").isNotNull()).join(again, ["_source", "_ts", "_value"]).select("_id", "reason"))
    return bounds.unionByName(rows).distinct().select(F.col("_id").alias(id_col), "reason")
