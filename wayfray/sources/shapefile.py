"""A Spark data source for shapefiles: ``spark.read.format("shapefile").load("x.shp")``.

Rows have the columns of the .dbf and ``parts``, an array of arrays of points (lines' parts
or polygons' rings). The .shx index gives record offsets, so files are read in parallel,
``records`` (option, 20,000) to a partition; ``bbox`` (option, "x0,y0,x1,y1") skips records
whose box lies outside, and ``columns`` (option, comma list) skips other attributes. The
files must be where all executors can open them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..schemas import RINGS

_KINDS = {"C": StringType(), "D": StringType(), "L": BooleanType(), "F": DoubleType(), "N": DoubleType()}


def dbf_fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, bytes of header and record, and (name, type, length, decimals) of each field."""
    with open(path, "rb") as f:
        head = f.read(32)
        n, header, record = struct.unpack("<IHH", head[4:12])
        raw = f.read(header - 32)
    fields = []
    for i in range(0, len(raw) - 31, 32):
        if raw[i] == 0x0D:
            break
        fields.append((raw[i : i + 11].split(b"\0")[0].decode("ascii"), chr(raw[i + 11]), raw[i + 16], raw[i + 17]))
    return n, header, record, fields


def _value(kind: str, decimals: int, raw: bytes):
    text = raw.decode("utf-8", "replace").strip("\0 ")
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if kind in "NF":
        try:
            return int(text) if kind == "N" and not decimals else float(text)
        except ValueError:
            return None
    return text or None


def shape(content: bytes, box: tuple[float, ...] | None) -> tuple[bool, list | None]:
    """Whether a record passes the box, and its parts."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return box is None, None
    if kind in (1, 11, 21):
        x, y = struct.unpack_from("<2d", content, 4)
        return box is None or box[0] <= x <= box[2] and box[1] <= y <= box[3], [[(x, y)]]
    x0, y0, x1, y1 = struct.unpack_from("<4d", content, 4)
    if box is not None and (x0 > box[2] or x1 < box[0] or y0 > box[3] or y1 < box[1]):
        return False, None
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    xy = struct.unpack_from(f"<{2 * n_points}d", content, 44 + 4 * n_parts)
    points = list(zip(xy[::2], xy[1::2], strict=True))
    return True, [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str] | None):
        self.base = options["path"].removesuffix(".shp")
        self.records = int(options.get("records", 20_000))
        self.box = tuple(map(float, options["bbox"].split(","))) if options.get("bbox") else None
        self.columns = columns

    def partitions(self) -> list[InputPartition]:
        n = dbf_fields(f"{self.base}.dbf")[0]
        return [_Range(i, min(n, i + self.records)) for i in range(0, n, self.records)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        _, header, record, fields = dbf_fields(f"{self.base}.dbf")
        with open(f"{self.base}.shp", "rb") as shp, open(f"{self.base}.shx", "rb") as shx, open(f"{self.base}.dbf", "rb") as dbf:
            shx.seek(100 + 8 * partition.first)
            index = shx.read(8 * (partition.last - partition.first))
            for k in range(partition.first, partition.last):
                at, size = struct.unpack_from(">2i", index, 8 * (k - partition.first))
                shp.seek(2 * at + 8)
                ok, parts = shape(shp.read(2 * size), self.box)
                if not ok:
                    continue
                dbf.seek(header + k * record)
                raw, o, row = dbf.read(record), 1, []
                for name, kind, length, decimals in fields:
                    if self.columns is None or name in self.columns:
                        row.append(_value(kind, decimals, raw[o : o + length]))
                    o += length
                yield (*row, parts)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _columns(self) -> list[str] | None:
        return self.options["columns"].split(",") if self.options.get("columns") else None

    def schema(self) -> StructType:
        fields, keep = dbf_fields(self.options["path"].removesuffix(".shp") + ".dbf")[3], self._columns()
        kinds = [StructField(n, LongType() if k == "N" and not d else _KINDS.get(k, StringType())) for n, k, _, d in fields if keep is None or n in keep]
        return StructType([*kinds, StructField("parts", RINGS)])

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(dict(self.options), self._columns())


def register(spark) -> None:
    spark.dataSource.register(ShapefileSource)
