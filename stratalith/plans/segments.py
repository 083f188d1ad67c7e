"""Queries over points, votes, polygons, neighbourhoods, radar scenes and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indices, names
from ..operators import curate, evaluate, focal, graph, model, overlay, paint, radar, segment, shape, vote, zonal
from ..operators import grid as cells_of
from ..operators.order import running_id
from ..sources import io
from ..sources.scratch import Scratch
from ..streaming.epochs import epoch_aggregates
from . import bindings as B
from .features import _r, round_all, rounded

BOXES = [(1, 5, 3, 40, 2, 30), (2, 6, 20, 90, 10, 45), (3, 7, 60, 95, 0, 20)]
_BOXES = "b(ord, final_id, r0, r1, c0, c1) AS (VALUES " + ", ".join(map(str, BOXES)) + ")"


def _boxes(spark) -> DataFrame:
    return spark.createDataFrame(BOXES, "ord int, final_id int, r0 int, r1 int, c0 int, c1 int")


def _n_rows(cells: DataFrame) -> int:
    return cells.agg(F.max("r")).first()[0] + 1


def q40(spark, d):
    g = B.grid(spark, d)
    points = B.table(spark, d, "lineitem").select((F.col("l_partkey") % 6000 / 100.0).alias("x"), (F.col("l_orderkey") / 50.0 + 0.3).alias("y"))
    snapped = points.select(cells_of.snap_floor(F.col("y"), 0.0, 1.0, _n_rows(g)).alias("r"), cells_of.snap_floor(F.col("x"), 0.0, 1.0, B.N_COLS).alias("c"))
    # Points of one cell are counted before they meet the grid.
    counted = snapped.groupBy("r", "c").agg(F.count("*").alias("n"))
    return cells_of.sample_at_points(counted, g).groupBy("seg").agg(F.sum("n").alias("n_points"), F.sum(F.col("n") * F.col("lab")).alias("labels"))


Q40 = f"""WITH {B.GRID}, x AS (SELECT max(r) + 1 AS n FROM g), p AS (
  SELECT CAST(least(greatest(floor(l_orderkey / 50.0e0 + 0.3e0), 0), n - 1) AS INT) AS r, CAST(least(greatest(floor(l_partkey % 6000 / 100.0e0), 0), 49) AS INT) AS c FROM lineitem CROSS JOIN x)
SELECT seg, count(*) AS n_points, CAST(sum(lab) AS BIGINT) AS labels FROM p JOIN g USING (r, c) GROUP BY seg"""


def q41(spark, d):
    return vote.plurality(B.votes(spark, d), "segment", "label")


Q41 = """WITH n AS (SELECT l_partkey AS segment, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER w AS i, lead(n) OVER w AS n2 FROM n WINDOW w AS (PARTITION BY segment ORDER BY n DESC, label))
SELECT segment, label, n FROM k WHERE i = 1 AND n > coalesce(n2, 0)"""


def q41b(spark, d):
    return vote.plurality_within(B.votes(spark, d), "segment", F.col("label") == "R", F.col("status"), {"F": 5, "O": 6}, "final_id")


Q41b = """WITH n AS (SELECT l_partkey AS segment, CASE trim(l_linestatus) WHEN 'F' THEN 5 WHEN 'O' THEN 6 END AS final_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('F', 'O') GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER w AS i, lead(n) OVER w AS n2 FROM n WINDOW w AS (PARTITION BY segment ORDER BY n DESC, final_id))
SELECT segment, final_id, n FROM k WHERE i = 1 AND n > coalesce(n2, 0)"""


def _thin(spark, d) -> DataFrame:
    """Means of segments of a few cells each, the cells of one label in a block; many are slivers and some have no value."""
    ragged = B.gapped(B.grid(spark, d)).withColumn("seg", F.col("seg") * 10 + F.col("lab") + 1)
    return zonal.zonal_mean_std(ragged, ["v"], std=False)


_THIN = f"{B.GRID}, {B.GAPPED}, z AS (SELECT seg * 10 + lab + 1 AS seg, count(*) AS size, avg(v) AS m FROM gm GROUP BY 1), y AS (SELECT seg, size, CASE WHEN size >= 4 THEN m END AS m FROM z)"


def q42(spark, d):
    return round_all(zonal.drop_slivers(_thin(spark, d), ["v__mean"]), ["seg", "size"])


Q42 = f"WITH {_THIN} SELECT seg, size, {_r('m', 'v__mean')} FROM y"


def q43(spark, d):
    holed = zonal.drop_slivers(_thin(spark, d), ["v__mean"]).withColumn("v__mean", F.when(F.col("seg") % 5 != 0, F.col("v__mean")))
    return round_all(zonal.impute_median(holed, ["v__mean"], F.col("size") >= 4), ["seg", "size"])


Q43 = f"WITH {_THIN}, h AS (SELECT seg, size, CASE WHEN seg % 5 <> 0 THEN m END AS m FROM y), k AS (SELECT median(m) AS k FROM h WHERE size >= 4) SELECT seg, size, round(CASE WHEN size >= 4 THEN coalesce(m, k) ELSE m END, 6) + 0.0 AS v__mean FROM h CROSS JOIN k"


def q44(spark, d):
    return vote.class_counts(q41(spark, d), "label")


Q44 = f"SELECT label, count(*) AS n FROM ({Q41}) GROUP BY label"


def q45(spark, d):
    g = B.grid(spark, d)
    burnt = overlay.burn_boxes(g.select("r", "c", "seg"), _boxes(spark), "final_id")
    return vote.majority_with_default(burnt, g.select("seg").distinct(), "seg", "final_id", 7)


_BURNT = f"{B.GRID}, {_BOXES}, u AS (SELECT pid, r, c, seg, coalesce(max_by(final_id, ord), 0) AS final_id FROM g LEFT JOIN b ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY ALL)"
Q45 = f"""WITH {_BURNT.replace('GROUP BY ALL', 'GROUP BY pid, r, c, seg')}, n AS (SELECT seg, final_id, count(*) AS n FROM u WHERE final_id > 0 GROUP BY seg, final_id),
k AS (SELECT seg, final_id, row_number() OVER (PARTITION BY seg ORDER BY n DESC, final_id) AS i FROM n)
SELECT s.seg, coalesce(final_id, 7) AS final_id FROM (SELECT DISTINCT seg FROM g) s LEFT JOIN k ON k.seg = s.seg AND i = 1"""


def q45b(spark, d):
    """A triangle and a later quadrangle, burnt by their cells' centres."""
    rings = [(5, [(2.0, 3.0), (40.0, 10.0), (12.0, 60.0)]), (6, [(20.0, 20.0), (45.0, 25.0), (44.0, 80.0), (18.0, 70.0)])]
    burnt = overlay.burn_rings(B.grid(spark, d), rings, "final_id")
    return burnt.groupBy("seg", "final_id").agg(F.count("*").alias("n"))


def _ring_sql(ring) -> str:
    terms = []
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y0 != y1:
            terms.append(f"CASE WHEN ({y0}e0 > r + 0.5e0) <> ({y1}e0 > r + 0.5e0) AND c + 0.5e0 < {x0}e0 + (r + 0.5e0 - {y0}e0) * {(x1 - x0) / (y1 - y0)!r} THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


Q45b = f"""WITH {B.GRID} SELECT seg, CASE WHEN {_ring_sql([(20.0, 20.0), (45.0, 25.0), (44.0, 80.0), (18.0, 70.0)])} THEN 6 WHEN {_ring_sql([(2.0, 3.0), (40.0, 10.0), (12.0, 60.0)])} THEN 5 ELSE 0 END AS final_id, count(*) AS n FROM g GROUP BY 1, 2"""


def q45c(spark, d):
    """A polygon for each customer, burnt in their order."""
    burnt = overlay.burn_polygons(B.grid(spark, d), B.triangles(spark, d), "final_id")
    return burnt.groupBy("seg", "final_id").agg(F.count("*").alias("n"))


Q45c = f"WITH {B.GRID}, {B.HITS}, b AS (SELECT pid, max_by(final_id, ord) AS final_id FROM hits GROUP BY pid) SELECT seg, coalesce(final_id, 0) AS final_id, count(*) AS n FROM g LEFT JOIN b USING (pid) GROUP BY 1, 2"


def q45d(spark, d):
    """Cells joined with the polygons that hold them, overlaps and all."""
    pairs = overlay.cells_in_polygons(B.grid(spark, d), B.triangles(spark, d))
    return pairs.groupBy("ord").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


Q45d = f"WITH {B.GRID}, {B.HITS} SELECT ord, count(*) AS n, CAST(sum(pid) AS BIGINT) AS pids FROM hits GROUP BY ord"


def q46(spark, d):
    dense = B.grid(spark, d).where("lab >= 4")
    return graph.cell_components(dense).select("pid", "component")


_DENSE = f"""RECURSIVE {B.GRID}, dense AS (SELECT pid, r, c, lab FROM g WHERE lab >= 4),
link AS (SELECT a.pid AS a, b.pid AS b FROM dense a JOIN dense b ON (b.r = a.r AND abs(b.c - a.c) = 1) OR (b.c = a.c AND abs(b.r - a.r) = 1)),
reach(pid, other) AS (SELECT pid, pid FROM dense UNION SELECT reach.pid, link.b FROM reach JOIN link ON link.a = reach.other),
comp AS (SELECT pid, min(other) AS component FROM reach GROUP BY pid)"""
Q46 = f"WITH {_DENSE} SELECT pid, component FROM comp"


def _pieces(spark, d) -> tuple[DataFrame, DataFrame]:
    """Dense components, and their pieces inside boxes and outside, with areas in cells."""
    dense = graph.cell_components(B.grid(spark, d).where("lab >= 4")).select("r", "c", "component")
    boxes = overlay.burn_boxes(B.grid(spark, d).select("r", "c"), _boxes(spark), "final_id").where("final_id > 0")
    inside = overlay.intersect_cells(dense, boxes).groupBy("component", "final_id").agg(F.count("*").alias("area")).withColumn("source", F.lit("piece"))
    rest = overlay.subtract_cells(dense, boxes).groupBy("component").agg(F.count("*").alias("area")).select("component", F.lit(0).alias("final_id"), "area", F.lit("residual").alias("source"))
    return dense, inside.unionByName(rest).where("area >= 2")


_PIECES = f"""{_DENSE}, {_BOXES}, u AS (SELECT pid, max_by(final_id, ord) AS final_id FROM g JOIN b ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY pid),
pieces AS (SELECT component, coalesce(final_id, 0) AS final_id, count(*) AS area, CASE WHEN u.pid IS NULL THEN 'residual' ELSE 'piece' END AS source
  FROM comp LEFT JOIN u USING (pid) GROUP BY 1, 2, 4 HAVING count(*) >= 2)"""


def q47(spark, d):
    _, pieces = _pieces(spark, d)
    return running_id(pieces, ["source", "component", "final_id"], "id").select(F.col("id").cast("int").alias("id"), "source", "component", "final_id", "area")


Q47 = f"WITH {_PIECES} SELECT CAST(row_number() OVER (ORDER BY source, component, final_id) AS INT) AS id, source, component, final_id, area FROM pieces"


def q47b(spark, d):
    dense, pieces = _pieces(spark, d)
    whole = dense.groupBy("component").agg(F.count("*").alias("area"))
    share = overlay.coverage(pieces, whole, "area")
    return overlay.size_histogram(pieces, "area", [1, 2, 5, 10, 20]).crossJoin(share).select("limit", "n", rounded(F.col("coverage_pct")).alias("coverage_pct"), rounded(F.col("median_area")).alias("median_area"))


Q47b = f"""WITH {_PIECES}, k AS (SELECT 100e0 * sum(area) / (SELECT count(*) FROM comp) AS coverage_pct, median(area) AS median_area FROM pieces)
SELECT l AS "limit", (SELECT count(*) FROM pieces WHERE area >= l) AS n, round(coverage_pct, 6) + 0.0 AS coverage_pct, round(median_area, 6) + 0.0 AS median_area FROM (SELECT unnest([1e0, 2e0, 5e0, 10e0, 20e0]) AS l) CROSS JOIN k"""


def _in_pairs(spark, d) -> DataFrame:
    """The grid in segments of two cells side by side."""
    return B.grid(spark, d).withColumn("segment", (F.col("r") * 25 + F.floor(F.col("c") / 2) + 1).cast("int"))


def _points(spark, d, reviewed: bool) -> DataFrame:
    """A point in each cell, classed by its label, or, as reviewed points are, by its value."""
    label = F.when(F.col("v") > 200000, 1).otherwise(0) if reviewed else F.col("lab") % 2
    return _in_pairs(spark, d).select("pid", "r", "c", "segment", label.cast("int").alias("class"))


def _curated(spark, d) -> DataFrame:
    clean = curate.split(_points(spark, d, False), "segment", "class").where("n_classes = 1")
    centres = curate.centroids(_in_pairs(spark, d), "segment")
    dr, dc = F.col("r") - F.col("cr"), F.col("c") - F.col("cc")
    return curate.nearest_to_centroid(clean, centres, "segment", "pid", ["class", "n_points"], F.round(dr * dr + dc * dc, 9))


_CURATED = f"""{B.GRID}, gp AS (SELECT pid, r, c, lab, v, CAST(r * 25 + c // 2 + 1 AS INT) AS segment FROM g),
pt AS (SELECT pid, r, c, segment, CAST(lab % 2 AS INT) AS class, 0 AS rest FROM gp UNION ALL SELECT pid, r, c, segment, CASE WHEN v > 200000 THEN 1 ELSE 0 END AS class, 5 AS rest FROM gp),
k AS (SELECT segment, rest, count(*) AS n_points, count(DISTINCT class) AS n_classes FROM pt GROUP BY 1, 2),
ce AS (SELECT segment, avg(r) AS cr, avg(c) AS cc FROM gp GROUP BY segment),
cu AS (SELECT * FROM (SELECT segment, pid, class, n_points, row_number() OVER (PARTITION BY segment ORDER BY round((r - cr) * (r - cr) + (c - cc) * (c - cc), 9), pid) AS i
  FROM pt JOIN k USING (segment, rest) JOIN ce USING (segment) WHERE rest = 0 AND n_classes = 1) WHERE i = 1)"""


def q48(spark, d):
    return _curated(spark, d)


Q48 = f"WITH {_CURATED} SELECT segment, pid, class, n_points FROM cu"


def q48b(spark, d):
    return curate.split(_points(spark, d, False), "segment", "class").where("n_classes > 1").select("pid", "segment", "class", "n_points", "n_classes")


Q48b = f"WITH {_CURATED} SELECT pid, segment, class, n_points, n_classes FROM pt JOIN k USING (segment, rest) WHERE rest = 0 AND n_classes > 1"


def q49(spark, d):
    before = _points(spark, d, False)
    merged = curate.merge_reviewed(_curated(spark, d).select("segment", "pid", "class"), _points(spark, d, True).select("segment", "pid", "class"), "segment", "class", "pid")
    return curate.report(before, merged, "class")


Q49 = f"""WITH {_CURATED}, rv AS (SELECT segment, class, pid FROM (SELECT segment, class, pid, row_number() OVER (PARTITION BY segment ORDER BY pid) AS i FROM pt JOIN k USING (segment, rest)
  WHERE rest = 5 AND n_classes = 1 AND segment NOT IN (SELECT segment FROM cu)) WHERE i = 1),
al AS (SELECT class FROM cu UNION ALL SELECT class FROM rv), x AS (SELECT class, count(*) AS n FROM pt WHERE rest = 0 GROUP BY class), y AS (SELECT class, count(*) AS n FROM al GROUP BY class)
SELECT class, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after_curation FROM x FULL JOIN y USING (class)"""


def _db(spark, d) -> DataFrame:
    return B.scenes(spark, d).select("pixel", "ts", *(indices.linear_to_db(F.col(b)).alias(b) for b in ("vv", "vh")))


_DB = f"{B.SCENES}, db AS (SELECT pixel, ts, 10e0 * log10(greatest(vv, 1e-10)) AS vv, 10e0 * log10(greatest(vh, 1e-10)) AS vh FROM m)"


def q50(spark, d):
    return round_all(radar.temporal_statistics(radar.between_dates(_db(spark, d), "1995-01-01", "1998-01-01"), ["vv", "vh"]), ["pixel"])


Q50 = f"WITH {_DB} SELECT pixel, " + ", ".join(f"{_r(f'avg({b})', f'{b}_mean')}, {_r(f'stddev_pop({b})', f'{b}_stdDev')}, {_r(f'min({b})', f'{b}_min')}, {_r(f'max({b})', f'{b}_max')}, {_r(f'abs(stddev_pop({b}) / avg({b}))', f'{b}_CV')}" for b in ("vv", "vh")) + " FROM db WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY pixel"


def q51(spark, d):
    db = _db(spark, d)
    means = db.groupBy("pixel").agg(F.avg("vv").alias("_vv"), F.avg("vh").alias("_vh"))
    made = indices.radar_indices(F.col("_vv"), F.col("_vh"))
    out = radar.seasonal_means(db, ["vv", "vh"]).join(means.select("pixel", *(x.alias(k) for k, x in made.items())), "pixel")
    return round_all(out, ["pixel"])


Q51 = f"WITH {_DB} SELECT pixel, " + ", ".join(f"{_r(f'avg({b}) FILTER (WHERE month(ts) IN (11, 12, 1, 2, 3))', f'{b}_wet')}, {_r(f'avg({b}) FILTER (WHERE month(ts) BETWEEN 4 AND 10)', f'{b}_dry')}, {_r(f'avg({b}) FILTER (WHERE month(ts) IN (11, 12, 1, 2, 3)) - avg({b}) FILTER (WHERE month(ts) BETWEEN 4 AND 10)', f'{b}_seasonal_diff')}" for b in ("vv", "vh")) + f", {_r('avg(vv) - avg(vh)', 'ratio')}, {_r('4e0 * avg(vh) / (avg(vv) + avg(vh))', 'RVI')}, {_r('(avg(vh) + avg(vv)) / 2e0', 'DPSVI')} FROM db GROUP BY pixel"


def q52(spark, d):
    scenes = B.scenes(spark, d)
    year = radar.newest_year(scenes, range(1990, 2011))
    last = radar.mosaic(radar.between_dates(scenes, f"{year}-01-01", f"{year + 1}-01-01"), ["vv", "vh"], [])
    db = last.select("pixel", *(indices.digital_number_to_db(F.col(b)).alias(b) for b in ("vv", "vh")))
    made = indices.radar_indices(F.col("vv"), F.col("vh"))
    return round_all(db.select("pixel", "vv", "vh", *(x.alias(k) for k, x in made.items())), ["pixel"])


Q52 = f"""WITH {B.SCENES}, y AS (SELECT max(year(ts)) AS y FROM m WHERE year(ts) BETWEEN 1990 AND 2010),
k AS (SELECT pixel, vv, vh, row_number() OVER (PARTITION BY pixel ORDER BY ts DESC, vv DESC, vh DESC) AS i FROM m CROSS JOIN y WHERE year(ts) = y),
x AS (SELECT pixel, CASE WHEN vv > 0 THEN 20e0 * log10(vv) - 83e0 END AS vv, CASE WHEN vh > 0 THEN 20e0 * log10(vh) - 83e0 END AS vh FROM k WHERE i = 1)
SELECT pixel, {_r('vv', 'vv')}, {_r('vh', 'vh')}, {_r('vv - vh', 'ratio')}, {_r('4e0 * vh / nullif(vv + vh, 0)', 'RVI')}, {_r('(vh + vv) / 2e0', 'DPSVI')} FROM x"""


def q60(spark, d):
    return round_all(focal.focal_mean_std(B.grid(spark, d), "v", 2), ["r", "c"], 4)


_REFLECT = "CASE WHEN {i} < 0 THEN -{i} - 1 WHEN {i} > {m} THEN 2 * {m} + 1 - {i} ELSE {i} END"
Q60 = f"""WITH {B.GRID}, x AS (SELECT max(r) AS mr, max(c) AS mc FROM g), o AS (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM (SELECT unnest(range(-2, 3)) AS a) CROSS JOIN (SELECT unnest(range(-2, 3)) AS b) WHERE a * a + b * b <= 4),
n AS (SELECT g.r, g.c, {_REFLECT.format(i='(g.r + a)', m='mr')} AS nr, {_REFLECT.format(i='(g.c + b)', m='mc')} AS nc FROM g CROSS JOIN o CROSS JOIN x)
SELECT n.r, n.c, {_r('avg(v)', 'mean', 4)}, {_r('sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0e0))', 'std', 4)} FROM n JOIN g ON g.r = nr AND g.c = nc GROUP BY n.r, n.c"""


def q61(spark, d):
    return round_all(shape.shape_features(B.grid(spark, d), "lab", 3.0), ["lab"])


Q61 = f"""WITH {B.GRID}, p AS (SELECT a.lab AS a, b.lab AS b FROM g a JOIN g b ON (b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1) WHERE a.lab <> b.lab),
e AS (SELECT lab, count(*) AS e FROM (SELECT a AS lab FROM p UNION ALL SELECT b FROM p) WHERE lab > 0 GROUP BY lab),
x AS (SELECT lab, count(*) AS n, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM g WHERE lab > 0 GROUP BY lab)
SELECT lab, {_r('n * 9e0', 'area_m2')}, {_r('coalesce(e, 0) * 3e0', 'perimeter_m')}, {_r('CASE WHEN e > 0 THEN 4 * pi() * (n * 9e0) / ((e * 3e0) * (e * 3e0)) END', 'compactness')},
  {_r('greatest(h, w) * 1e0 / least(h, w)', 'elongation')}, {_r('n * 1e0 / (h * w)', 'fill_ratio')} FROM x LEFT JOIN e USING (lab)"""


def q62(spark, d):
    out = focal.terrain(B.grid(spark, d), "v", 3.0)
    made = indices.slope_aspect(F.col("gx"), F.col("gy"))
    return round_all(out.select("r", "c", "tpi", "tri", *(x.alias(k) for k, x in made.items())), ["r", "c"])


Q62 = f"""WITH {B.GRID}, x AS (SELECT max(r) AS mr, max(c) AS mc FROM g), o AS (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM (SELECT unnest([-1, 0, 1]) AS a) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS b)),
n AS (SELECT g.r, g.c, g.v AS z, a, b, mr, mc, least(greatest(g.r + a, 0), mr) AS nr, least(greatest(g.c + b, 0), mc) AS nc FROM g CROSS JOIN o CROSS JOIN x),
k AS (SELECT n.r, n.c, any_value(z) AS z, any_value(mr) AS mr, any_value(mc) AS mc, avg(v) AS m, sum(abs(z - v)) / 8 AS tri,
  max(CASE WHEN a = 0 AND b = -1 THEN v END) AS w, max(CASE WHEN a = 0 AND b = 1 THEN v END) AS e, max(CASE WHEN a = -1 AND b = 0 THEN v END) AS u, max(CASE WHEN a = 1 AND b = 0 THEN v END) AS l
  FROM n JOIN g ON g.r = nr AND g.c = nc GROUP BY n.r, n.c),
y AS (SELECT *, (e - w) / (CASE WHEN c = 0 OR c = mc THEN 1e0 ELSE 2e0 END * 3e0) AS gx, (l - u) / (CASE WHEN r = 0 OR r = mr THEN 1e0 ELSE 2e0 END * 3e0) AS gy FROM k)
SELECT r, c, {_r('z - m', 'tpi')}, {_r('tri', 'tri')}, {_r('degrees(atan(sqrt(gx * gx + gy * gy)))', 'slope')}, {_r('sin(atan2(-gx, gy))', 'aspect_sin')}, {_r('cos(atan2(-gx, gy))', 'aspect_cos')} FROM y"""



def q62b(spark, d):
    """Tree height over circles of three cells; gaps are ground."""
    return round_all(focal.tree_height(B.gapped(B.grid(spark, d)), "v", 10.0), ["r", "c"], 4)


Q62b = Q60.replace(B.GRID, f"{B.GRID}, {B.GAPPED}").replace("JOIN g ON g.r", "JOIN gm ON gm.r").replace("AND g.c = nc", "AND gm.c = nc").replace("range(-2, 3)", "range(-3, 4)").replace("a * a + b * b <= 4", "a * a + b * b <= 9").replace("avg(v", "avg(coalesce(v, 0e0)").replace("(coalesce(v, 0e0) * v)", "(coalesce(v, 0e0) * coalesce(v, 0e0))")

_LABELS = list(range(10))


def q63(spark, d):
    return evaluate.confusion(B.pairs(spark, d), _LABELS)


_MATRIX = f"{B.PAIRS}, l AS (SELECT CAST(unnest(range(10)) AS INT) AS k), cm AS (SELECT a.k AS y_true, b.k AS y_pred, (SELECT count(*) FROM p WHERE y_true = a.k AND y_pred = b.k) AS n FROM l a CROSS JOIN l b)"
_MARGINS = f"{_MATRIX}, mg AS (SELECT k AS label, (SELECT sum(n) FROM cm WHERE y_true = k AND y_pred = k) AS tp, (SELECT sum(n) FROM cm WHERE y_true = k) AS actual, (SELECT sum(n) FROM cm WHERE y_pred = k) AS predicted FROM l)"
Q63 = f"WITH {_MATRIX} SELECT y_true, y_pred, n FROM cm"


def q63b(spark, d):
    return round_all(evaluate.accuracy_kappa(q63(spark, d)), [])


Q63b = f"WITH {_MARGINS}, t AS (SELECT sum(tp) * 1e0 / sum(actual) AS po, sum(actual * 1e0 * predicted) / (sum(actual) * 1e0 * sum(actual)) AS pe FROM mg) SELECT {_r('po', 'accuracy')}, {_r('(po - pe) / (1e0 - pe)', 'kappa')} FROM t"


def q63c(spark, d):
    return round_all(evaluate.per_class(q63(spark, d)), ["label", "support"])


Q63c = f"""WITH {_MARGINS}, x AS (SELECT label, CAST(actual AS BIGINT) AS support, coalesce(tp * 1e0 / nullif(predicted, 0), 0e0) AS p, coalesce(tp * 1e0 / nullif(actual, 0), 0e0) AS r FROM mg)
SELECT label, support, {_r('p', '"precision"')}, {_r('r', 'recall')}, {_r('coalesce(2e0 * p * r / nullif(p + r, 0), 0e0)', 'f1')} FROM x"""

def _features(spark, d) -> tuple[DataFrame, list[str]]:
    """All features of all rows, from a cache as a classifier has it."""
    rows, features = B.wide(spark, d)
    return Scratch(spark, "features").keep(rows, "rows"), features


def q64(spark, d):
    """Five folds of forests with all parameters at their defaults, on all features of all rows, and their summary."""
    rows, features = _features(spark, d)
    folds = model.cross_validate(rows, "pid", features, "cls", _LABELS)
    return folds.crossJoin(F.broadcast(evaluate.fold_summary(folds)))


def q64b(spark, d):
    """The twenty most important features of a fitted forest, and their epochs."""
    rows, features = B.wide(spark, d)
    ranked = model.importances(model.fit(rows, features, "cls"), features)
    return evaluate.top_features(ranked, 20).withColumn("epoch", F.substring_index("feature", "_", 1))


def q64c(spark, d):
    """A hold-out of a forest on the twenty most important features alone."""
    rows, features = _features(spark, d)
    train, held_out = model.split(rows, "pid")
    model.require_rows(train)
    every = model.fit(train, features, "cls", written=True)
    fitted, best = model.top_n_retrain(train, model.importances(every, features), 20, "cls", written=True, like=every)
    _, scores, _ = model.evaluate(fitted, held_out, best, "cls", _LABELS)
    return scores.crossJoin(held_out.agg(F.count("*").alias("n_held_out"))).withColumn("n_features", F.lit(len(best)))


def q65(spark, d):
    g = B.grid(spark, d)
    table = g.where("lab > 0").groupBy("seg").agg((F.min("seg") % 11).cast("int").alias("final")).where("seg % 13 <> 0")
    return paint.distribution(paint.paint(g, table, "seg", "final"), "final", B.in_aoi()).withColumn("pct_aoi", rounded(F.col("pct_aoi")))


_NAMES = ", ".join(f"({k}, '{v}')" for k, v in model.FINAL_CLASSES.items())
Q65 = f"""WITH {B.GRID}, t AS (SELECT seg, CAST(seg % 11 AS INT) AS final FROM g WHERE lab > 0 AND seg % 13 <> 0 GROUP BY seg), f(k, name) AS (VALUES {_NAMES}),
x AS (SELECT coalesce(final, 0) AS final_id, count(*) AS n_pixels FROM g LEFT JOIN t USING (seg) WHERE {B.AOI} GROUP BY 1)
SELECT final_id, coalesce(name, 'id_' || final_id) AS name, n_pixels, round(100e0 * n_pixels / sum(n_pixels) OVER (), 6) + 0.0 AS pct_aoi FROM x LEFT JOIN f ON k = final_id"""


def q65b(spark, d):
    """A forest on all features of all rows predicts them; rows with a gap in a feature are class 0."""
    rows, features = _features(spark, d)
    fitted = model.fit(rows, features, "cls", written=True)
    pixels = rows.withColumn("e3_b3", F.when(F.col("pid") % 17 != 0, F.col("e3_b3")))
    found = model.predict(fitted, pixels, features).select("pid", "predicted")
    return pixels.select("pid").join(found, "pid", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))


def _importance(spark) -> DataFrame:
    made = names.dictionary(spark, names.feature_names() + ["har_NIR_energy", "S1_VV_mean__std", "PALSAR_HH_db__mean", "meta_canopy_p95__mean", "slope__mean", "compactness__seg", "entropyNDVI__seg", "other"])
    return made.select(F.col("name").alias("feature"), ((F.length("name") * 37 + F.ascii(F.substring("name", 3, 1)) * 11) % 101 / 100.0).alias("importance"))


def _importance_sql() -> str:
    every = names.feature_names() + ["har_NIR_energy", "S1_VV_mean__std", "PALSAR_HH_db__mean", "meta_canopy_p95__mean", "slope__mean", "compactness__seg", "entropyNDVI__seg", "other"]
    return "d(feature) AS (VALUES " + ", ".join(f"('{x}')" for x in every) + "), i AS (SELECT feature, (length(feature) * 37 + ascii(substring(feature, 3, 1)) * 11) % 101 / 100.0e0 AS importance, regexp_replace(feature, '__(mean|std|seg)$', '') AS base FROM d)"


def q66(spark, d):
    return evaluate.top_features(_importance(spark), 20).withColumn("importance", rounded(F.col("importance")))


Q66 = f"WITH {_importance_sql()} SELECT feature, round(importance, 6) + 0.0 AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank FROM i ORDER BY importance DESC, feature LIMIT 20"


def q66b(spark, d):
    return focal.focal_mode(B.grid(spark, d), "lab")


Q66b = f"""WITH {B.GRID}, o(a, b) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)), n AS (SELECT x.r, x.c, y.lab, count(*) AS n FROM g x CROSS JOIN o JOIN g y ON y.r = x.r + a AND y.c = x.c + b WHERE y.lab > 0 GROUP BY x.r, x.c, y.lab),
k AS (SELECT r, c, lab, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, lab) AS i FROM n)
SELECT g.r, g.c, coalesce(k.lab, g.lab) AS mode FROM g LEFT JOIN k ON k.r = g.r AND k.c = g.c AND i = 1"""


def q67(spark, d):
    segments = B.grid(spark, d).groupBy("seg").agg(((F.avg("v") - 200000.0) / 10000.0).alias("canopy")).select("seg", "canopy", (F.col("seg") % 8).alias("l1"), (F.col("seg") % 10 / 10.0).alias("green"))
    level2 = segments.where("seg % 3 <> 2").select("seg", F.when(F.col("seg") % 3 == 0, 6).otherwise(7).alias("final_id"))
    return model.hierarchy(segments, "l1", level2, "seg", model.Regrowth(apply=True)).select("seg", "final_class")


_MAP = " ".join(f"WHEN {a} THEN {b}" for a, b in model.REMAP.items())
Q67 = f"""WITH {B.GRID}, s AS (SELECT seg, (avg(v) - 200000e0) / 10000e0 AS canopy, seg % 8 AS l1, seg % 10 / 10.0e0 AS green FROM g GROUP BY seg),
h AS (SELECT *, CASE WHEN l1 = 5 THEN CASE seg % 3 WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 5 END ELSE coalesce(CASE l1 {_MAP} END, 0) END AS f FROM s)
SELECT seg, CAST(CASE WHEN f IN (7, 8) AND canopy BETWEEN 3 AND 10 AND green > 0.6e0 THEN 10 ELSE f END AS INT) AS final_class FROM h"""


def q68(spark, d):
    return round_all(names.group_importance(_importance(spark), names.family(F.col("feature")), "family"), ["family", "feature_count"])


_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(base, '{p}') THEN '{f}'" for f, p in names.FAMILIES) + " ELSE 'Other' END"
Q68 = f"WITH {_importance_sql()} SELECT {_FAMILY} AS family, {_r('sum(importance)', 'total_importance')}, count(*) AS feature_count, {_r('avg(importance)', 'avg_importance')} FROM i GROUP BY 1"


def q68b(spark, d):
    return round_all(names.group_importance(_importance(spark), names.epoch(F.col("feature")), "epoch"), ["epoch", "feature_count"])


_EPOCH = "CASE " + " ".join(f"WHEN starts_with(base, '{e}_') THEN '{e}'" for e in sorted(names.EPOCHS, key=lambda x: (-len(x), x))) + " END"
Q68b = f"WITH {_importance_sql()} SELECT {_EPOCH} AS epoch, {_r('sum(importance)', 'total_importance')}, count(*) AS feature_count, {_r('avg(importance)', 'avg_importance')} FROM i WHERE {_EPOCH} IS NOT NULL GROUP BY 1"


def q69(spark, d):
    g = B.grid(spark, d)
    return paint.summary(g, g.select("seg").distinct(), q65(spark, d), {"spatialr": 3.0, "ranger": 12.0, "minsize": 50.0})


def q69b(spark, d):
    """The summary as a JSON file, read back."""
    path = Scratch(spark, "summary").path("summary.json")
    io.write_json(q69(spark, d), path)
    kind = "struct<n_segments: bigint, n_pixels: bigint, classes: array<struct<final_id: int, n_pixels: bigint>>, parameters: struct<minsize: double>>"
    x = spark.read.text(path).select(F.from_json("value", kind).alias("x"))
    return x.select("x.n_segments", "x.n_pixels", F.size("x.classes").cast("long").alias("n_classes"), F.aggregate("x.classes", F.lit(0).cast("long"), lambda a, k: a + k["n_pixels"]).alias("painted"), "x.parameters.minsize")


Q69b = f"WITH {B.GRID}, u AS ({Q65}) SELECT count(*) AS n_pixels, count(DISTINCT seg) AS n_segments, (SELECT count(*) FROM u) AS n_classes, CAST((SELECT sum(n_pixels) FROM u) AS BIGINT) AS painted, 50e0 AS minsize FROM g"

_SIGNED = ["b1", "b4", "b8"]


def q70(spark, d):
    return round_all(evaluate.class_signature(B.stack(spark, d), "cls", _SIGNED), ["cls", "feature"])


_MELTED = f"{B.STACK}, k AS (" + " UNION ALL ".join(f"SELECT cls, '{b}' AS feature, {b} AS x FROM s" for b in _SIGNED) + ")"
Q70 = f"WITH {_MELTED} SELECT cls, feature, {_r('avg(x)', 'mean')}, {_r('stddev_samp(x)', 'std')} FROM k GROUP BY cls, feature"


def q71(spark, d):
    return round_all(evaluate.separability(B.stack(spark, d), "cls", _SIGNED), ["a", "b"])


_DISTANCES = f"{_MELTED}, t AS (SELECT cls, feature, avg(x) AS m, stddev_pop(x) + 1e-6 AS sd FROM k GROUP BY cls, feature), dist AS (SELECT p.cls AS a, q.cls AS b, CASE WHEN p.cls = q.cls THEN 0e0 ELSE sqrt(sum((p.m - q.m) * (p.m - q.m) / (p.sd * p.sd + q.sd * q.sd))) END AS distance FROM t p JOIN t q USING (feature) GROUP BY p.cls, q.cls)"
Q71 = f"WITH {_DISTANCES} SELECT a, b, {_r('distance', 'distance')} FROM dist"


def q72(spark, d):
    return evaluate.isolation(evaluate.separability(B.stack(spark, d), "cls", _SIGNED)).withColumn("isolation", rounded(F.col("isolation")))


Q72 = f"WITH {_DISTANCES}, i AS (SELECT a, sum(distance) / (count(*) - 1) AS isolation FROM dist GROUP BY a) SELECT a, round(isolation, 6) + 0.0 AS isolation, CAST(row_number() OVER (ORDER BY isolation DESC, a) AS INT) AS rank FROM i"


def q72b(spark, d):
    return evaluate.extreme_pairs(evaluate.separability(B.stack(spark, d), "cls", _SIGNED)).withColumn("distance", rounded(F.col("distance")))


Q72b = f"""WITH {_DISTANCES}, u AS (SELECT * FROM dist WHERE a < b), near AS (SELECT *, 'closest' AS kind FROM u ORDER BY distance, a, b LIMIT 6), far AS (SELECT *, 'farthest' AS kind FROM u ORDER BY distance DESC, a, b LIMIT 3)
SELECT a, b, {_r('distance', 'distance')}, kind FROM (SELECT * FROM near UNION ALL SELECT * FROM far)"""


def _smooth(spark, d) -> DataFrame:
    cells = B.grid(spark, d).withColumn("b", F.col("v") / 5000.0)
    return segment.like_components(segment.mean_shift(cells, ["b"], range_radius=25.0, rounds=20), ["b"], 12.0)


def q80(spark, d):
    return _smooth(spark, d).select("pid", "r", "c", rounded(F.col("b")).alias("b"), "component")


def q81(spark, d):
    return segment.merge_small(_smooth(spark, d), "component", ["b"], 10)


def q90(spark, d):
    out = epoch_aggregates(B.table(spark, d, "events"), "user_id", "value")
    return out.select("user_id", "start", "n", rounded(F.col("mean")).alias("mean"))


Q90 = f"SELECT user_id, time_bucket(INTERVAL 3 DAYS, ts, TIMESTAMP '1970-01-01') AS start, count(value) AS n, {_r('avg(value)', 'mean')} FROM events GROUP BY 1, 2"

QUERIES = {name: value for name, value in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
SQL = {f"q{name[1:]}": value for name, value in list(globals().items()) if name[:1] == "Q" and name[1:3].isdigit()}
