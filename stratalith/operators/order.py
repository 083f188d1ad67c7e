"""Order over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def running_id(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """df with ``out``: 1, 2, 3 ... in the order of the keys, which should tell all rows apart.

    Rows are sorted by range and written, so that parts stay what they are; a row's id is its place
    in its part and the sizes of the parts before, one number a part.
    """
    scratch = Scratch(df.sparkSession, "order")
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = scratch.keep(dealt.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    # The upper bits number the part, the lower ones the row.
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_part", F.coalesce(total, F.lit(0)).alias("_before"))
    numbered = ordered.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(out, F.col("_before") + place + 1).drop("_row", "_part", "_before")


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, n, before, total``: for each distinct value of a group its rows, those of smaller values, and all of the group's.

    Null values take no part. Equal values are counted before anything is sorted, so a hot value is one
    row a task; the counts are sorted by range over keys and value, so a hot group is spread over many
    tasks. A group's rows in the parts before are one number a group and part.
    """
    scratch = Scratch(df.sparkSession, "ranked")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    dealt = counts.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    ordered = scratch.keep(dealt.withColumn("_row", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_row", 33))
    running = F.sum("n").over(Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    group = Window.partitionBy(*keys)
    sizes = ordered.groupBy("_part", *keys).agg(F.sum("n").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_n").over(group))
    out = ordered.withColumn("_running", running).join(sizes.drop("_n"), ["_part", *keys])
    return out.select(*keys, value, "n", (F.col("_before") + F.col("_running") - F.col("n")).alias("before"), "total")


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate over rows of ``ranked``: the value at a place, counted from 0, in its group's order."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(value)))


def linear(value: str, share: Column | float) -> Column:
    """Aggregate over rows of ``ranked``: the percentile between the two places around share * (total - 1)."""
    share = share if isinstance(share, Column) else F.lit(share)
    place = share * (F.col("total") - 1)
    low, high = at_rank(value, F.floor(place)), at_rank(value, F.ceil(place))
    far = F.max(place) - F.max(F.floor(place))
    return F.when((far == 0) | (low == high), low).otherwise((1 - far) * low + far * high)


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """One row of exact linear percentiles, by name: of a column, null values left out, at a share from 0 to 1.

    No task holds a column's values; see ``ranked``. A column without values has null percentiles.
    """
    columns = {name: F.col(c) if isinstance(c, str) else c for name, (c, _) in wanted.items()}
    slots = {str(c): i for i, c in enumerate({str(c): c for c in columns.values()})}
    first = {slots[str(c)]: c for c in columns.values()}
    long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("_of"), c.cast("double").alias("_v")) for i, c in first.items()))).alias("x")).select("x.*")
    found = ranked(long, ["_of"], "_v")
    by = {}
    for name, (_, share) in wanted.items():
        by.setdefault((slots[str(columns[name])], share), []).append(name)
    each = found.groupBy("_of").agg(*(linear("_v", share).alias(f"_p{i}") for i, share in enumerate(dict.fromkeys(s for _, s in by))))
    place = {share: i for i, share in enumerate(dict.fromkeys(s for _, s in by))}
    return each.agg(*(F.max(F.when(F.col("_of") == of, F.col(f"_p{place[share]}"))).alias(name) for (of, share), names in by.items() for name in names))
