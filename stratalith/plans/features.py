"""Queries over cells, bands and epochs: scans, resampling, indices, scaling, zonal and temporal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indices, names, scaling
from ..operators import grid as cells_of
from ..operators import segment, temporal, texture, zonal
from ..sources import io
from ..sources.scratch import Scratch
from . import bindings as B


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded, and without the sign of a zero."""
    return F.round(x, places) + F.lit(0.0)


def round_all(df: DataFrame, keys: list[str], places: int = 6) -> DataFrame:
    return df.select(*keys, *(rounded(F.col(c), places).alias(c) for c in df.columns if c not in keys))


def _r(sql: str, name: str, places: int = 6) -> str:
    return f"round({sql}, {places}) + 0.0 AS {name}"


def q01(spark, d):
    return round_all(B.stack(spark, d).select("pid", "e", "b2", "b8"), ["pid", "e"])


Q01 = f"WITH {B.STACK} SELECT pid, e, {_r('b2', 'b2')}, {_r('b8', 'b8')} FROM s"


def q02(spark, d):
    box = cells_of.clip(B.grid(spark, d), (10, 200), (5, 44))
    return box.groupBy("r").agg(F.count("*").alias("n_box"), F.count_if(B.in_aoi()).alias("n_aoi"))


Q02 = f"WITH {B.GRID} SELECT r, count(*) AS n_box, count(*) FILTER (WHERE {B.AOI}) AS n_aoi FROM g WHERE r BETWEEN 10 AND 200 AND c BETWEEN 5 AND 44 GROUP BY r"


def q03(spark, d):
    v = F.col("v")
    return B.grid(spark, d).select("pid", rounded(scaling.mask_and_scale(v, 65535.0, 0.01)).alias("height"), rounded(scaling.clip_to_byte(v / 500.0), 4).alias("byte"))


Q03 = f"WITH {B.GRID} SELECT pid, round(CASE WHEN v < 65535 THEN v * 0.01e0 END, 6) + 0.0 AS height, round(greatest(least(v / 500.0e0, 255.0e0), 0.0e0), 4) + 0.0 AS byte FROM g"


def q04(spark, d):
    g = B.grid(spark, d)
    targets = g.where((F.col("r") % 2 == 0) & (F.col("c") % 2 == 0)).select((F.col("r") / 2).cast("int").alias("tr"), (F.col("c") / 2).cast("int").alias("tc"))
    n_rows = g.agg((F.max("r") + 1).alias("n"))
    out = cells_of.resample_bilinear(g, targets.crossJoin(F.broadcast(n_rows)), F.col("tr") * 2 + 0.5, F.col("tc") * 2 + 0.5, "v", F.col("n"), B.N_COLS)
    return out.select("tr", "tc", rounded(F.col("v")).alias("v"))


Q04 = f"""WITH {B.GRID}, x AS (SELECT max(r) AS mr FROM g), t AS (
  SELECT CAST(r / 2 AS INT) AS tr, CAST(c / 2 AS INT) AS tc FROM g WHERE r % 2 = 0 AND c % 2 = 0
), k AS (
  SELECT tr, tc, least(2 * tr + i, mr) AS r, least(2 * tc + j, 49) AS c
  FROM t CROSS JOIN x CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)
) SELECT tr, tc, {_r('sum(v * 0.25e0)', 'v')} FROM k JOIN g USING (r, c) GROUP BY tr, tc"""


def q05(spark, d):
    fine = cells_of.resample_nearest(B.grid(spark, d), 2)
    return fine.select("tr", "tc", "lab")


Q05 = f"WITH {B.GRID} SELECT r * 2 + i AS tr, c * 2 + j AS tc, lab FROM g CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INT) AS i) CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INT) AS j)"


def q05b(spark, d):
    """Nearest cells of a grid that lies a quarter of a cell off and has cells half as wide again."""
    g = B.grid(spark, d)
    n = g.agg(F.max("r")).first()[0] + 1
    source, reference = cells_of.Grid(0.0, float(n), 1.0, 1.0, n, B.N_COLS), cells_of.Grid(0.25, n - 0.25, 1.5, 1.5, int((n - 1) / 1.5), 32)
    return cells_of.to_reference(g, source, reference, "lab", nearest=True)


Q05b = f"""WITH {B.GRID}, x AS (SELECT max(r) AS mr FROM g), t AS (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT unnest(range(CAST(floor(mr / 1.5e0) AS BIGINT))) AS r FROM x) CROSS JOIN (SELECT unnest(range(32)) AS c))
SELECT t.r, t.c, lab FROM t JOIN g ON g.r = CAST(floor(0.25e0 + (t.r + 0.5e0) * 1.5e0) AS INT) AND g.c = CAST(floor(0.25e0 + (t.c + 0.5e0) * 1.5e0) AS INT)"""


def q06(spark, d):
    return round_all(cells_of.resample_average(B.gapped(B.grid(spark, d)), "v", 3), ["tr", "tc"])


Q06 = f"WITH {B.GRID}, {B.GAPPED} SELECT CAST(floor(r / 3) AS INT) AS tr, CAST(floor(c / 3) AS INT) AS tc, {_r('CASE WHEN count(v) = count(*) THEN avg(v) END', 'v')} FROM gm GROUP BY 1, 2"


def q07(spark, d):
    """Points on the grid of cell centres, by the nearest line."""
    points = B.table(spark, d, "lineitem").select((F.col("l_partkey") % 6000 / 100.0).alias("x"), (F.col("l_orderkey") / 50.0).alias("y"))
    snapped = points.select(cells_of.snap_round(F.col("y"), 0.5, 1.0, 100).alias("r"), cells_of.snap_round(F.col("x"), 0.5, 1.0, B.N_COLS).alias("c"))
    return snapped.groupBy("r", "c").agg(F.count("*").alias("n"))


Q07 = "SELECT CAST(least(greatest(round_even(l_orderkey / 50e0 - 0.5e0, 0), 0), 99) AS INT) AS r, CAST(least(greatest(round_even(l_partkey % 6000 / 100e0 - 0.5e0, 0), 0), 49) AS INT) AS c, count(*) AS n FROM lineitem GROUP BY 1, 2"


def q08(spark, d):
    """A cache of features, written and read."""
    made = B.grid(spark, d).select("r", "c", (F.col("v") / 3.0).alias("third"), "v")
    folder = io.write_features(made, Scratch(spark, "cache").path("features"), {"divisor": 3})
    return round_all(io.read_features(spark, folder, ["third"]), ["r", "c"])


Q08 = f"WITH {B.GRID} SELECT r, c, {_r('v / 3e0', 'third')} FROM g"


def q08b(spark, d):
    """A class map by tiles, written and read."""
    path = Scratch(spark, "map").path("classes")
    io.write_raster(B.grid(spark, d).withColumn("lab", F.when(F.col("lab") > 1, F.col("lab"))), path, "lab")
    return spark.read.parquet(path).select("r", "c", F.col("lab").cast("int").alias("lab"))


Q08b = f"WITH {B.GRID} SELECT r, c, CASE WHEN lab > 1 THEN lab ELSE 0 END AS lab FROM g"


def q09(spark, d):
    """A sampled matrix as CSV, written and read."""
    path = Scratch(spark, "matrix").path("rows.csv")
    io.write_report(B.stack(spark, d).select(F.round("b1", 6).alias("b1"), F.when(F.col("pid") % 5 != 0, F.round("b8", 6)).otherwise(F.lit(float("nan"))).alias("b8"), F.col("cls").cast("int").alias("class")), path)
    return io.read_matrix(spark, path, ["b1", "b8"]).groupBy("class").agg(F.count("*").alias("n"), F.count("b8").alias("n_b8"), rounded(F.sum("b1"), 3).alias("b1"))


Q09 = f"WITH {B.STACK} SELECT CAST(cls AS INT) AS class, count(*) AS n, count(CASE WHEN pid % 5 <> 0 THEN b8 END) AS n_b8, {_r('sum(round(b1, 6))', 'b1', 3)} FROM s GROUP BY 1"


def _band(n: int) -> Column:
    return F.col(f"b{n}")


def q10(spark, d):
    s = B.stack(spark, d)
    return s.select("pid", "e", *(rounded(x, 5).alias(k) for k, x in indices.legacy_indices(_band).items()))


Q10 = f"""WITH {B.STACK} SELECT pid, e, {_r('(b8 - b4) / (b8 + b4 + 1e-10)', 'NDVI', 5)}, {_r('(b2 - b4) / (b2 + b4 + 1e-10)', 'NDWI', 5)},
  {_r('(b6 - b3) / (b6 + b3 + 1e-10)', 'NDBI', 5)}, {_r('2.5e0 * (b8 - b4) / nullif(b8 + 6e0 * b4 - 7.5e0 * b2 + 1e0, 0)', 'EVI', 5)} FROM s"""


def q11(spark, d):
    s = B.stack(spark, d)
    return s.select("pid", "e", *(rounded(x, 5).alias(k) for k, x in indices.extended_indices(_band).items()))


Q11 = f"""WITH {B.STACK} SELECT pid, e, {_r('(b8 - b7) / (b8 + b7 + 1e-10)', 'NDRE', 5)}, {_r('b8 / (b7 + 1e-10) - 1e0', 'CIre', 5)},
  {_r('(b7 - b6) / (b7 + b6 + 1e-10)', 'RENDVI', 5)}, {_r('(b8 - b6) * 1.5e0 / (b8 + b6 + 0.5e0 + 1e-10)', 'SAVI', 5)},
  {_r('(b8 - b6) / (b8 + b6 + 0.16e0 + 1e-10)', 'OSAVI', 5)},
  {_r('0.5e0 * (2e0 * b8 + 1e0 - sqrt(greatest((2e0 * b8 + 1e0) * (2e0 * b8 + 1e0) - 8e0 * (b8 - b6), 0e0)))', 'MSAVI2', 5)},
  {_r('(b8 - b4) / (b8 + b4 + 1e-10)', 'GNDVI', 5)}, {_r('(b8 - (2e0 * b6 - b2)) / (b8 + (2e0 * b6 - b2) + 1e-10)', 'ARVI', 5)},
  {_r('(b4 - b6) / (b4 + b6 - b2 + 1e-10)', 'VARI', 5)}, {_r('((b5 + b6) - (b8 + b2)) / ((b5 + b6) + (b8 + b2) + 1e-10)', 'BSI', 5)} FROM s"""


def q16(spark, d):
    """Temporal median of three epochs, stretched to bytes, in eight bins: the eight textures of 3 x 3 windows."""
    epochs = F.array(*(F.col("v") * (1.0 + 0.1 * ((F.col("pid") + k) % 3)) for k in (0, 1, 4)))
    median = B.grid(spark, d).select("r", "c", temporal.percentile(epochs, 0.5).alias("m"))
    levels = scaling.byte_stretch(median, "m", "byte").withColumn("level", texture.binned(F.col("byte")))
    made = round_all(texture.window_textures(levels, "level"), ["r", "c"])
    return made.select("r", "c", *(F.col(t).alias(f"har_NIR_{t}") for t in texture.TEXTURES))


Q16 = f"""WITH {B.GRID}, x AS (SELECT r, c, list_sort([v * (1e0 + 0.1e0 * (pid % 3)), v * (1e0 + 0.1e0 * ((pid + 1) % 3)), v * (1e0 + 0.1e0 * ((pid + 4) % 3))])[2] AS m FROM g),
b AS (SELECT quantile_cont(m, 0.01) AS lo, quantile_cont(m, 0.99) AS hi FROM x),
q AS (SELECT r, c, CAST(least(floor(floor(greatest(least((m - lo) / greatest(hi - lo, 1e-6) * 255e0, 255e0), 0e0)) * 8 / 255e0), 7) AS INT) AS l FROM x CROSS JOIN b),
k AS (SELECT a.r, a.c, a.l AS i, b.l AS j FROM q a JOIN q b ON b.r = a.r + 1 AND b.c = a.c + 1),
w AS (SELECT r + y AS r, c + z AS c, i, j FROM k CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INT) AS y) CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INT) AS z)),
p AS (SELECT r, c, i, j FROM w UNION ALL SELECT r, c, j, i FROM w),
n AS (SELECT r, c, i, j, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY r, c, i, j),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY r, c) AS f, sum(n * i) OVER (PARTITION BY r, c) / sum(n) OVER (PARTITION BY r, c) AS m FROM n),
h AS (SELECT r, c, sum(x * x) / 8 - 1e0 / 64 AS s FROM (SELECT r, c, i, sum(f) AS x FROM f GROUP BY r, c, i) GROUP BY r, c)
SELECT r, c, {_r('sum(f * f)', 'har_NIR_energy')}, {_r('-sum(f * ln(f))', 'har_NIR_entropy')},
  {_r('CASE WHEN sum(f * (i - m) * (i - m)) > 1e-12 THEN sum(f * (i - m) * (j - m)) / sum(f * (i - m) * (i - m)) END', 'har_NIR_correlation')},
  {_r('sum(f / (1 + (i - j) * (i - j)))', 'har_NIR_idm')}, {_r('sum(f * (i - j) * (i - j))', 'har_NIR_inertia')}, {_r('sum(f * pow(i + j - 2 * m, 3))', 'har_NIR_clushade')},
  {_r('sum(f * pow(i + j - 2 * m, 4))', 'har_NIR_cluprom')}, {_r('CASE WHEN any_value(s) > 1e-12 THEN (sum(f * i * j) - 1e0 / 64) / any_value(s) END', 'har_NIR_hcorr')} FROM f JOIN h USING (r, c) GROUP BY r, c"""


def q20(spark, d):
    out = scaling.min_max(B.grid(spark, d), "v", "x", F.col("lab") > 0)
    return out.select("pid", rounded(F.col("x")).alias("x"))


Q20 = f"WITH {B.GRID}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM g WHERE lab > 0) SELECT pid, round(CASE WHEN lab > 0 THEN (v - lo) / CASE WHEN hi - lo <= 1e-12 THEN 1e0 ELSE hi - lo END END, 6) + 0.0 AS x FROM g CROSS JOIN b"


def q21(spark, d):
    out = scaling.percentile_stretch(B.gapped(B.grid(spark, d)), "v", "x", B.in_aoi())
    return out.select("pid", rounded(F.col("x"), 5).alias("x"))


Q21 = f"""WITH {B.GRID}, {B.GAPPED}, b AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM gm WHERE {B.AOI})
SELECT pid, round(CASE WHEN {B.AOI} AND v IS NOT NULL THEN greatest(least((v - lo) / greatest(hi - lo, 1e-6) * 255e0, 255e0), 0e0) ELSE 0e0 END, 5) + 0.0 AS x FROM gm CROSS JOIN b"""


def q22(spark, d):
    return scaling.byte_stretch(B.gapped(B.grid(spark, d)), "v", "x").select("pid", "x")


Q22 = f"""WITH {B.GRID}, {B.GAPPED}, b AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM gm)
SELECT pid, CASE WHEN v IS NULL THEN 0 ELSE CAST(floor(greatest(least((v - lo) / greatest(hi - lo, 1e-6) * 255e0, 255e0), 0e0)) AS INT) END AS x FROM gm CROSS JOIN b"""


def q23(spark, d):
    return scaling.quantise(B.gapped(B.grid(spark, d)), "v", "level").select("pid", "level")


_QUANTISED = f"""{B.GRID}, {B.GAPPED}, b AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM gm),
q AS (SELECT pid, seg, CASE WHEN v IS NULL THEN 255 ELSE CAST(round_even(greatest(least((v - lo) / (hi - lo), 1e0), 0e0) * 31e0, 0) AS INT) END AS level FROM gm CROSS JOIN b)"""
Q23 = f"WITH {_QUANTISED} SELECT pid, level FROM q"


def q24(spark, d):
    sparse = B.grid(spark, d).withColumn("lab", F.when(F.col("lab") % 3 != 0, F.col("lab") * 10 + F.floor(F.col("r") / 60)).otherwise(0).cast("int"))
    out = zonal.compact(sparse, "lab")
    mean = segment.require_mean_size(out, "segment_id")  # raises if segments are small
    return zonal.sizes(out, "segment_id").select("segment_id", "size", rounded(F.lit(mean)).alias("mean_size"), F.lit(True).alias("sound"))


Q24 = f"""WITH {B.GRID}, x AS (SELECT CASE WHEN lab % 3 <> 0 THEN CAST(lab * 10 + floor(r / 60) AS INT) ELSE 0 END AS lab FROM g),
k AS (SELECT lab, row_number() OVER (ORDER BY lab) AS segment_id FROM (SELECT DISTINCT lab FROM x WHERE lab <> 0)),
z AS (SELECT segment_id, count(*) AS size FROM x JOIN k USING (lab) GROUP BY segment_id)
SELECT segment_id, size, round((SELECT avg(size) FROM z), 6) + 0.0 AS mean_size, (SELECT avg(size) FROM z) >= 20 AS sound FROM z"""


def q25(spark, d):
    """The minimum slice: zonal mean and deviation of a value with gaps, and sizes."""
    out = zonal.zonal_mean_std(B.gapped(B.grid(spark, d)), ["v"])
    return out.select("seg", "size", rounded(F.col("v__mean"), 4).alias("v__mean"), rounded(F.col("v__std"), 4).alias("v__std"))


Q25 = f"WITH {B.GRID}, {B.GAPPED} SELECT seg, count(*) AS size, {_r('avg(v)', 'v__mean', 4)}, {_r('stddev_pop(v)', 'v__std', 4)} FROM gm WHERE seg > 0 GROUP BY seg"


def _wide(spark, d) -> tuple[DataFrame, list[str]]:
    """Fifty derived features of each cell: more than one batch of aggregates."""
    made = {f"f{k}": F.col("v") * F.sqrt(F.lit(float(k))) + F.col("c") * float(k) for k in range(1, 51)}
    return B.grid(spark, d).withColumns(made), list(made)


def q26(spark, d):
    cells, features = _wide(spark, d)
    return round_all(zonal.zonal_mean_std(cells, features), ["seg", "size"], 2)


Q26 = f"WITH {B.GRID} SELECT seg, count(*) AS size, " + ", ".join(f"{_r(f'avg(v * sqrt({k}e0) + c * {k}e0)', f'f{k}__mean', 2)}, {_r(f'stddev_pop(v * sqrt({k}e0) + c * {k}e0)', f'f{k}__std', 2)}" for k in range(1, 51)) + " FROM g GROUP BY seg"


#: An ablation: two epochs, no temporal statistics.
_ABLATED = names.feature_names(names.EPOCHS[:2], temporal=False)


def q26b(spark, d):
    cells = B.grid(spark, d).withColumns({x: F.col("v") * float(k) + F.col("c") for k, x in enumerate(_ABLATED, 1)})
    return round_all(zonal.zonal_mean_std(cells, _ABLATED, std=False), ["seg", "size"], 2)


Q26b = f"WITH {B.GRID} SELECT seg, count(*) AS size, " + ", ".join(_r(f"avg(v * {k}e0 + c)", f'"{x}__mean"', 2) for k, x in enumerate(_ABLATED, 1)) + " FROM g GROUP BY seg"


def q27(spark, d):
    optional = B.grid(spark, d).where("pid % 3 = 0").select("r", "c", (F.col("v") / 777.0).alias("S1_VV_mean"))
    joined = B.grid(spark, d).select("r", "c", "seg").join(optional, ["r", "c"], "left")
    return round_all(zonal.zonal_mean_std(joined, ["S1_VV_mean"]).drop("size"), ["seg"], 5)


Q27 = f"WITH {B.GRID} SELECT seg, {_r('avg(CASE WHEN pid % 3 = 0 THEN v / 777e0 END)', 'S1_VV_mean__mean', 5)}, {_r('stddev_pop(CASE WHEN pid % 3 = 0 THEN v / 777e0 END)', 'S1_VV_mean__std', 5)} FROM g GROUP BY seg"


def q28(spark, d):
    levels = scaling.quantise(B.gapped(B.grid(spark, d)), "v", "level")
    return round_all(zonal.entropy(levels, "level"), ["seg"])


Q28 = f"WITH {_QUANTISED}, n AS (SELECT seg, level, count(*) AS n FROM q WHERE level <> 255 AND seg > 0 GROUP BY seg, level), f AS (SELECT seg, n * 1e0 / sum(n) OVER (PARTITION BY seg) AS f FROM n) SELECT seg, {_r('-sum(f * ln(f))', 'entropy')} FROM f GROUP BY seg"


def q29(spark, d):
    return round_all(zonal.index_range(B.gapped(B.grid(spark, d)), "v"), ["seg"], 4)


Q29 = f"WITH {B.GRID}, {B.GAPPED}, a AS (SELECT seg, list_sort(list(v)) AS a FROM gm WHERE v IS NOT NULL GROUP BY seg) SELECT seg, {_r('a[CAST(ceil(0.9e0 * (len(a) - 1)) AS INT) + 1] - a[CAST(floor(0.1e0 * (len(a) - 1)) AS INT) + 1]', 'range', 4)} FROM a"


def q30(spark, d):
    return round_all(zonal.variation_and_deviation(B.gapped(B.grid(spark, d)), "v"), ["seg"], 5)


Q30 = f"WITH {B.GRID}, {B.GAPPED}, m AS (SELECT seg, v, avg(v) OVER (PARTITION BY seg) AS m FROM gm WHERE v IS NOT NULL) SELECT seg, {_r('CASE WHEN abs(avg(v)) > 1e-6 THEN stddev_pop(v) / avg(v) END', 'cv', 5)}, {_r('avg(abs(v - m))', 'mad', 5)} FROM m GROUP BY seg"


def _series(spark, d) -> DataFrame:
    return temporal.series(B.ragged(spark, d), "pid", "e", "v", 10, "x")


def q31(spark, d):
    x = F.col("x")
    out = {**temporal.statistics(x), **{f"p{int(q * 100)}": temporal.percentile(x, q) for q in (0.1, 0.5, 0.9)}}
    return _series(spark, d).select("pid", *(rounded(v).alias(k) for k, v in out.items()))


Q31 = f"""WITH {B.RAGGED} SELECT pid, {_r('max(v)', 'max')}, {_r('min(v)', 'min')}, {_r('stddev_pop(v)', 'std')}, {_r('max(v) - min(v)', 'amp')},
  {_r('quantile_cont(v, 0.1)', 'p10')}, {_r('quantile_cont(v, 0.5)', 'p50')}, {_r('quantile_cont(v, 0.9)', 'p90')} FROM t WHERE e < 10 GROUP BY pid"""


def q32(spark, d):
    out = temporal.harmonic(F.col("x"), names.DAYS)
    return _series(spark, d).select("pid", *(rounded(v, 5).alias(k) for k, v in out.items()))


def _harmonic_sql() -> str:
    """The same thirty constants, shipped as a table of the plan."""
    rows = temporal.harmonic_matrix(names.DAYS)
    values = ", ".join(f"({e}, {a!r}, {b!r}, {c!r})" for e, (a, b, c) in enumerate(zip(*rows, strict=True)))
    return f"""WITH {B.RAGGED}, w(e, a, b, c) AS (VALUES {values}), p AS (SELECT DISTINCT pid FROM t),
    x AS (SELECT p.pid, w.a, w.b, w.c, coalesce(t.v, avg(t.v) OVER (PARTITION BY p.pid)) AS v FROM p CROSS JOIN w LEFT JOIN t ON t.pid = p.pid AND t.e = w.e),
    y AS (SELECT pid, sum(CAST(a AS DOUBLE) * v) AS o, sum(CAST(b AS DOUBLE) * v) AS k, sum(CAST(c AS DOUBLE) * v) AS s FROM x GROUP BY pid)
    SELECT pid, {_r('o', '"offset"', 5)}, {_r('sqrt(k * k + s * s)', 'amp', 5)}, {_r('atan2(s, k)', 'phase', 5)} FROM y"""


Q32 = _harmonic_sql()


def q33(spark, d):
    return _series(spark, d).select("pid", rounded(temporal.change(F.col("x"), 0, 9)).alias("yoy"))


Q33 = f"WITH {B.RAGGED} SELECT pid, {_r('max(CASE WHEN e = 9 THEN v END) - max(CASE WHEN e = 0 THEN v END)', 'yoy')} FROM t GROUP BY pid"


QUERIES = {name: value for name, value in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
SQL = {f"q{name[1:]}": value for name, value in list(globals().items()) if name[:1] == "Q" and name[1:3].isdigit()}
