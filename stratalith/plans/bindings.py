"""What the queries run on: grids, stacks and samples made from the tables of the test data.

Each is a DataFrame and, for DuckDB, a common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_COLS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, r, c, lab, seg, v``: a dense grid of 50 columns, ragged labels, 5 x 5 segments and a value."""
    key = F.col("o_orderkey")
    r, c = F.floor(key / N_COLS).cast("int"), (key % N_COLS).cast("int")
    seg = (F.floor(F.floor(key / N_COLS) / 5) * 10 + F.floor((key % N_COLS) / 5) + 1).cast("int")
    return table(spark, sf_dir, "orders").select(key.alias("pid"), r.alias("r"), c.alias("c"), (F.col("o_custkey") % 7).cast("int").alias("lab"), seg.alias("seg"), F.col("o_totalprice").alias("v"))


GRID = """g AS (
  SELECT o_orderkey AS pid, CAST(floor(o_orderkey / 50) AS INT) AS r, CAST(o_orderkey % 50 AS INT) AS c,
         CAST(o_custkey % 7 AS INT) AS lab,
         CAST(floor(floor(o_orderkey / 50) / 5) * 10 + floor((o_orderkey % 50) / 5) + 1 AS INT) AS seg, o_totalprice AS v
  FROM orders
)"""


def in_aoi() -> Column:
    """Whether a cell lies in the area of interest: a circle in each band of 50 rows."""
    return (F.col("c") - 25) * (F.col("c") - 25) + (F.col("r") % 50 - 25) * (F.col("r") % 50 - 25) <= 576


AOI = "((c - 25) * (c - 25) + (r % 50 - 25) * (r % 50 - 25) <= 576)"


def gapped(cells: DataFrame) -> DataFrame:
    """The grid with every eleventh value missing."""
    return cells.withColumn("v", F.when(F.col("pid") % 11 != 0, F.col("v")))


GAPPED = "gm AS (SELECT * REPLACE (CASE WHEN pid % 11 <> 0 THEN v END AS v) FROM g)"


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, e, cls, b1..b8``: eight epochs of eight bands from the 64 numbers of each vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("cls"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("e"), "embedding")
    bands = [(0.05 + F.abs(F.element_at("embedding", 8 * F.col("e") + b).cast("double"))).alias(f"b{b}") for b in range(1, 9)]
    return rows.select("pid", "e", "cls", *bands)


STACK = (
    "s AS (SELECT vec_id AS pid, e, label AS cls, "
    + ", ".join(f"0.05 + abs(CAST(embedding[8 * e + {b}] AS DOUBLE)) AS b{b}" for b in range(1, 9))
    + " FROM embeddings CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS e))"
)


def wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """``pid, cls`` and the 64 numbers of each vector as features, eight epochs of eight bands; and the features' names."""
    made = {f"e{e}_b{b}": 0.05 + F.abs(F.element_at("embedding", F.lit(8 * e + b)).cast("double")) for e in range(8) for b in range(1, 9)}
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").cast("int").alias("cls"), *(x.alias(k) for k, x in made.items()))
    return rows, list(made)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, final_id, edges``: a triangle for each customer, in units of cells."""
    x, y = (F.col("c_custkey") % 40).cast("double"), (F.col("c_custkey") * 7 % 280).cast("double")
    corners = [(x + a, y + b) for a, b in TRIANGLE]
    edges = [F.struct(p[0].alias("x0"), p[1].alias("y0"), q[0].alias("x1"), q[1].alias("y1")) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True)]
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 5 + 1).cast("int").alias("final_id"), F.array(*edges).alias("edges"))


TRIANGLE = [(0.0, 0.0), (8.5, 2.25), (3.25, 9.75)]


def _inside_triangle() -> str:
    terms = []
    for (a0, b0), (a1, b1) in zip(TRIANGLE, [*TRIANGLE[1:], TRIANGLE[0]], strict=True):
        terms.append(f"CASE WHEN (y + {b0}e0 > r + 0.5e0) <> (y + {b1}e0 > r + 0.5e0) AND c + 0.5e0 < x + {a0}e0 + (r + 0.5e0 - (y + {b0}e0)) * ((x + {a1}e0 - (x + {a0}e0)) / (y + {b1}e0 - (y + {b0}e0))) THEN 1 ELSE 0 END")
    return f"({' + '.join(terms)}) % 2 = 1"


HITS = f"""cu AS (SELECT c_custkey AS ord, CAST(c_custkey % 5 + 1 AS INT) AS final_id, c_custkey % 40 AS x, c_custkey * 7 % 280 AS y FROM customer),
hits AS (SELECT pid, seg, ord, final_id FROM g JOIN cu ON r BETWEEN y - 1 AND y + 10 AND c BETWEEN x - 1 AND x + 9 WHERE {_inside_triangle()})"""


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, e, v``: means of each user in ten buckets of three days, every seventh missing."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pid"), F.floor((F.day("ts") - 1) / 3).cast("int").alias("e")).agg(F.avg("value").alias("v"))
    return rows.withColumn("v", F.when((F.col("pid") * 3 + F.col("e")) % 7 != 0, F.col("v")))


RAGGED = """t0 AS (
  SELECT user_id AS pid, CAST(floor((day(ts) - 1) / 3) AS INT) AS e, avg(value) AS v FROM events GROUP BY 1, 2
), t AS (SELECT pid, e, CASE WHEN (pid * 3 + e) % 7 <> 0 THEN v END AS v FROM t0)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segment, label, subtype``: points of classes in segments."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("segment"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("status"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pixel, ts, vv, vh``: a collection of scenes, linear values."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pixel"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("vv"), F.col("l_quantity").alias("vh"))


SCENES = "m AS (SELECT l_suppkey AS pixel, l_shipdate AS ts, l_extendedprice AS vv, l_quantity AS vh FROM lineitem)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y_true, y_pred`` of an evaluation."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("y_true"), (F.col("vec_id") % 10).cast("int").alias("y_pred"))


PAIRS = "p AS (SELECT CAST(label AS INT) AS y_true, CAST(vec_id % 10 AS INT) AS y_pred FROM embeddings)"
