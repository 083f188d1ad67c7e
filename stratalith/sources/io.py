"""Readers and writers: tables of cells, points and polygons, caches of features, reports.

Parquet is the form at rest: columns are pruned and predicates on rows, columns and tiles reach the
scan. GeoTIFF files come in through Spark's binary-file source, so any Hadoop file system holds them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scaling import finite
from ..operators.grid import Grid

TILE = 1024


def read_features(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Keys and the named features of a cache; a name that it lacks is an error before anything runs."""
    table = spark.read.parquet(path)
    if missing := sorted(set(names) - set(table.columns)):
        raise FileNotFoundError(f"the cache lacks {', '.join(missing)}")
    return table.select("r", "c", *names)


def write_features(cells: DataFrame, path: str, parameters: dict) -> str:
    """A cache of features. Its folder, which is returned, is named by its parameters, so another run's cache is never taken for it."""
    folder = f"{path}/{zlib.crc32(repr(sorted(parameters.items())).encode()):08x}"
    cells.write.mode("ignore").parquet(folder)
    return folder


def write_raster(cells: DataFrame, path: str, value: str) -> None:
    """A class map: whole numbers, 0 for nodata, one folder a tile."""
    tile = lambda x: F.floor(F.col(x) / TILE).cast("int")
    cells.select("r", "c", F.coalesce(value, F.lit(0)).cast("smallint").alias(value), tile("r").alias("tile_r"), tile("c").alias("tile_c")).write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def read_points(spark: SparkSession, path: str, label: str, subtype: str | None = None) -> DataFrame:
    """Points ``pid, x, y, label`` (and a subtype) from Parquet, or CSV with a header. A missing label column is an error."""
    if path.rstrip("/").endswith(".csv"):
        table = spark.read.csv(path, header=True, schema=f"pid long, x double, y double, {label} int" + (f", {subtype} string" if subtype else ""), enforceSchema=False)
    else:
        table = spark.read.parquet(path)
    if label not in table.columns:
        raise KeyError(f"{label} is not among {table.columns}")
    return table


def read_matrix(spark: SparkSession, path: str, features: list[str], label: str = "class") -> DataFrame:
    """A sampled training matrix in CSV: features as doubles, NaN and infinities as nulls."""
    schema = ", ".join([*(f"`{f}` double" for f in features), f"`{label}` int"])
    table = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return table.withColumns({f: finite(F.col(f)) for f in features})


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, column: str = "summary") -> None:
    """A one-row JSON column as text."""
    df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def with_edges(polygons: DataFrame, wkb: str, grid: Grid | None = None) -> DataFrame:
    """polygons with ``edges``, an array of (x0, y0, x1, y1) of all rings of a WKB polygon or multipolygon.

    Coordinates are taken as they are, or come in units of a grid's cells. A null geometry has no edges.
    """
    kind = "array<struct<x0: double, y0: double, x1: double, y1: double>>"

    def run(batches) -> Iterator:
        import pyarrow as pa

        edge = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])
        for batch in batches:
            found = []
            for data in batch.column(wkb).to_pylist():
                rings = [] if data is None else _rings(bytes(data))
                if grid is not None:
                    rings = [[((x - grid.x0) / grid.dx, (grid.y0 - y) / grid.dy) for x, y in ring] for ring in rings]
                found.append([dict(zip(("x0", "y0", "x1", "y1"), (*p, *q), strict=True)) for ring in rings for p, q in zip(ring, [*ring[1:], ring[0]], strict=True) if p != q])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(edge))], [*batch.schema.names, "edges"])

    return polygons.mapInArrow(run, polygons.select("*", F.array().cast(kind).alias("edges")).schema)


def boxes_of(polygons: DataFrame, wkb: str) -> DataFrame:
    """polygons with ``x0, y0, x1, y1``, the bounds of all rings; null without a geometry."""
    low = lambda k: F.array_min(F.transform("edges", lambda e: F.least(e[f"{k}0"], e[f"{k}1"])))
    high = lambda k: F.array_max(F.transform("edges", lambda e: F.greatest(e[f"{k}0"], e[f"{k}1"])))
    out = with_edges(polygons, wkb).withColumns({"x0": low("x"), "y0": low("y"), "x1": high("x"), "y1": high("y")})
    return out.drop("edges")


def _rings(data: bytes) -> list[list[tuple[float, float]]]:
    """The rings of a WKB polygon or multipolygon, in either byte order, of two dimensions or more."""
    out: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        order = "<" if data[at] == 1 else ">"
        kind, n = struct.unpack_from(f"{order}II", data, at + 1)
        at += 9
        # Dimensions beyond two stand as high bits or as thousands.
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[kind % 10000 // 1000 if kind < 10000 else 0]
        if kind & 0x20000000:
            at, n = at + 4, struct.unpack_from(f"{order}I", data, at)[0]
        base = (kind & 0xFFFF) % 1000
        if base == 6:
            for _ in range(n):
                at = read(at)
        elif base == 3:
            for _ in range(n):
                points = struct.unpack_from(f"{order}I", data, at)[0]
                flat = struct.unpack_from(f"{order}{dims * points}d", data, at + 4)
                out.append(list(zip(flat[::dims], flat[1::dims], strict=True)))
                at += 4 + 8 * dims * points
        else:
            raise ValueError("only WKB polygons and multipolygons are read")
        return at

    read(0)
    return [ring for ring in out if ring]


def write_polygons(polygons: DataFrame, path: str) -> None:
    """A vector layer: attributes and WKB as Parquet, ordered by nothing, one folder."""
    polygons.write.mode("overwrite").parquet(path)


class Tiff:
    """A baseline TIFF image: strips or tiles, plain or deflate, any number of bands, read by ranges of bytes."""

    _TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}

    def __init__(self, read):
        """read: (offset, size) -> bytes."""
        self.read = read
        head = read(0, 8)
        self.order = {b"II": "<", b"MM": ">"}.get(bytes(head[:2]))
        if self.order is None or struct.unpack_from(f"{self.order}H", head, 2)[0] != 42:
            raise ValueError("no TIFF file")
        at = struct.unpack_from(f"{self.order}I", head, 4)[0]
        entries = struct.unpack(f"{self.order}H", read(at, 2))[0]
        table, self.tags = read(at + 2, 12 * entries), {}
        for i in range(entries):
            tag, kind, count = struct.unpack_from(f"{self.order}HHI", table, 12 * i)
            if code := self._TYPES.get(kind):
                size = struct.calcsize(f"{self.order}{code}") * count
                raw = table[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else read(struct.unpack_from(f"{self.order}I", table, 12 * i + 8)[0], size)
                self.tags[tag] = struct.unpack(f"{self.order}{count}{code}", raw)
        self.width, self.height = self._one(256), self._one(257)
        self.bands, self.planar = self._one(277, 1), self._one(284, 1) == 2
        kind = {1: "u", 2: "i", 3: "f"}[self._one(339, 1)]
        self.dtype = f"{self.order}{kind}{self._one(258) // 8}"
        if self._one(259, 1) not in (1, 8, 32946) or self._one(317, 1) != 1:
            raise ValueError("this compression or predictor is not read")
        self.tiled = 322 in self.tags
        self.block_width = self._one(322) if self.tiled else self.width
        self.block_height = self._one(323) if self.tiled else min(self._one(278, self.height), self.height)
        self.offsets, self.sizes = (self.tags[324], self.tags[325]) if self.tiled else (self.tags[273], self.tags[279])

    def _one(self, tag: int, default=None):
        value = self.tags.get(tag)
        return default if value is None else value[0]

    @property
    def nodata(self) -> float | None:
        """The value that stands for missing ones, as the usual text tag names it."""
        text = self._one(42113)
        return None if text is None else float(text.split(b"\0")[0].strip() or b"nan")

    @property
    def grid(self) -> tuple[float, float, float, float]:
        """``x0, y0, dx, dy`` of the upper left corner and a cell, by the tie point and the scale; cells themselves without."""
        dx, dy = (self.tags.get(33550) or (1.0, 1.0))[:2]
        tie = self.tags.get(33922) or (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        return tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy

    @property
    def crs(self) -> int | None:
        """The EPSG code of the projected or geographic system among the geo keys."""
        keys = self.tags.get(34735) or ()
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return codes.get(3072) or codes.get(2048)

    def block(self, k: int) -> tuple[int, int, int, object]:
        """``row, column, band, array`` of a block: rows x columns (x bands, if these are interleaved; band is then -1)."""
        import numpy as np

        w, h = self.block_width, self.block_height
        across, down = -(-self.width // w), -(-self.height // h)
        raw = self.read(self.offsets[k], self.sizes[k])
        raw = zlib.decompress(raw) if self._one(259, 1) != 1 else raw
        band, place = divmod(k, across * down) if self.planar else (-1, k)
        row, col = place // across * h, place % across * w
        depth = 1 if self.planar else self.bands
        rows = h if self.tiled else min(h, self.height - row)
        array = np.frombuffer(raw, dtype=self.dtype, count=rows * w * depth).reshape(rows, w, depth)
        return row, col, band, array[: self.height - row, : self.width - col]


CELLS = "path string, r int, c int, band int, value double"


def _cells(name: str, image: Tiff, blocks, bands: int, first: int = 0) -> Iterator:
    """Arrow batches of the cells of some blocks; ``first`` is added to the number of a band."""
    import numpy as np
    import pyarrow as pa

    for number in blocks:
        row, col, band, array = image.block(number)
        for k in range(array.shape[2]):
            n = (k if band < 0 else band) + 1 + first
            if n > bands:
                continue
            values = array[:, :, k].astype(np.float64).reshape(-1)
            gone = ~np.isfinite(values)
            if image.nodata is not None:
                gone |= values == image.nodata
            r, c = (x.reshape(-1).astype(np.int32) for x in np.indices(array.shape[:2]))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(r + row), pa.array(c + col), pa.array(np.full(len(values), n, dtype=np.int32)), pa.array(values, mask=gone)], ["path", "r", "c", "band", "value"])


def _of(data: bytes):
    return lambda offset, size: data[offset : offset + size]


def _enough(name: str, image: Tiff, bands: int) -> Tiff:
    if image.bands < bands:
        raise ValueError(f"{name} has {image.bands} bands; {bands} are needed")
    return image


def read_geotiff(spark: SparkSession, path: str, bands: int) -> DataFrame:
    """``path, r, c, band, value`` of GeoTIFF files; files with fewer bands are an error, NaN and the nodata value become null.

    Files come through Spark's binary-file source, whole, so any Hadoop file system holds them and none
    is over 2 GB; ``read_geotiff_windows`` has no such bound. Long rows keep a task's memory at one file
    and one block. ``as_bands`` makes them wide.
    """

    def run(batches) -> Iterator:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                image = _enough(name, Tiff(_of(data)), bands)
                yield from _cells(name, image, range(len(image.offsets)), bands)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS)


def _ranges(path: str):
    """Reads of ranges of a file on any file system that Arrow knows."""
    from pyarrow import fs

    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    system, name = fs.FileSystem.from_uri(uri)
    file = system.open_input_file(name)
    return lambda offset, size: file.read_at(size, offset)


HEADERS = "path string, n_rows int, n_cols int, n_bands int, x0 double, y0 double, dx double, dy double, crs int, nodata double, block_height int, block_width int, n_blocks int"


def geotiff_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its size, transform, EPSG code, nodata value and blocks. Only headers are read."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in HEADERS.split(", ")]
        kinds = [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 4, pa.int32(), pa.float64(), *[pa.int32()] * 3]
        for batch in batches:
            found = [(name, Tiff(_ranges(name))) for name in batch.column("path").to_pylist()]
            rows = [(name, x.height, x.width, x.bands, *x.grid, x.crs, x.nodata, x.block_height, x.block_width, len(x.offsets)) for name, x in found]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, HEADERS)


def read_geotiff_windows(spark: SparkSession, path: str, bands: int, blocks: int = 64, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The rows of ``read_geotiff`` by tasks of so many blocks each, which read these blocks' bytes alone.

    Files of any size are read by as many tasks as they have windows. window: rows r0 to r1 and columns
    c0 to c1, inclusive; blocks without a cell of it are not read.
    """
    parts = geotiff_headers(spark, path).withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1, F.lit(blocks)))).select("path", "first")
    dealt = parts.repartition(max(1, parts.count()))

    def wanted(image: Tiff, k: int) -> bool:
        if window is None:
            return True
        across = -(-image.width // image.block_width)
        place = k % (across * -(-image.height // image.block_height))
        row, col = place // across * image.block_height, place % across * image.block_width
        r0, r1, c0, c1 = window
        return row <= r1 and row + image.block_height > r0 and col <= c1 and col + image.block_width > c0

    def run(batches) -> Iterator:
        for batch in batches:
            for name, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                image = _enough(name, Tiff(_ranges(name)), bands)
                yield from _cells(name, image, [k for k in range(first, min(first + blocks, len(image.offsets))) if wanted(image, k)], bands)

    out = dealt.mapInArrow(run, CELLS)
    if window is None:
        return out
    return out.where(F.col("r").between(*window[:2]) & F.col("c").between(*window[2:]))


def read_download(spark: SparkSession, path: str, bands: int) -> DataFrame:
    """The rows of ``read_geotiff`` of downloads that are one TIFF or a ZIP with a TIFF for each band, told by their first bytes.

    A ZIP's TIFF files are its bands in the order of their names. Anything else is an error.
    """

    def run(batches) -> Iterator:
        import io
        import zipfile

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if data[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        members = sorted(x for x in z.namelist() if x.lower().endswith((".tif", ".tiff")))
                        if len(members) < bands:
                            raise ValueError(f"{name} has {len(members)} bands; {bands} are needed")
                        for first, member in enumerate(members[:bands]):
                            image = Tiff(_of(z.read(member)))
                            yield from _cells(name, image, range(len(image.offsets)), first + 1, first)
                elif data[:4] in (b"II*\0", b"MM\0*"):
                    image = _enough(name, Tiff(_of(data)), bands)
                    yield from _cells(name, image, range(len(image.offsets)), bands)
                else:
                    raise ValueError(f"{name} is neither a TIFF nor a ZIP file")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS)


def as_bands(long_rows: DataFrame, bands: int) -> DataFrame:
    """``path, r, c, b1..bn`` of long rows: one aggregate, no pivot that would first collect the bands."""
    return long_rows.groupBy("path", "r", "c").agg(*(F.max(F.when(F.col("band") == k, F.col("value"))).alias(f"b{k}") for k in range(1, bands + 1)))
