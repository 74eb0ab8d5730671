"""A reader of the DICOM attributes and pixels that series need: explicit and implicit, little and big endian, deflated.

Sequences are passed whatever their nesting and whether their length is given or open, by a stack of what is open; only
elements of the outermost level count. Compressed pixels are passed as well: such a file has its attributes, and a series of
them is refused when its volume is asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators.rules import first_match

#: Attributes by (group, element).
TAGS = {
    (0x0008, 0x0018): "instance", (0x0008, 0x0060): "modality", (0x0018, 0x0015): "body_part", (0x0020, 0x000D): "study", (0x0020, 0x000E): "series", (0x0010, 0x0020): "patient",
    (0x0028, 0x0002): "samples", (0x0018, 0x0050): "thickness", (0x0020, 0x0032): "position", (0x0020, 0x0037): "orientation", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns",
    (0x0028, 0x0030): "pixel_spacing", (0x0028, 0x0100): "bits", (0x0028, 0x0103): "signed", (0x0028, 0x1052): "intercept", (0x0028, 0x1053): "slope", (0x7FE0, 0x0010): "pixels", (0x7FE0, 0x0008): "float_pixels",
}
_NUMBERS = ("rows", "columns", "bits", "signed", "samples")
_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UR", b"UT", b"UN", b"SV", b"UV", b"OV"}
BINARY = ("pixels", "float_pixels")
TEXT = [*(n for n in TAGS.values() if n not in BINARY), "syntax"]
SCHEMA = "path string, readable boolean, broken boolean, " + ", ".join(f"{n} string" for n in TEXT) + ", pixels binary, float_pixels binary"
#: Transfer syntaxes that are not compressed.
IMPLICIT, EXPLICIT, DEFLATED, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
#: An open length; the elements that begin an item and end an item and a sequence.
_OPEN, _ITEM, _ITEM_END, _SEQUENCE_END = 0xFFFFFFFF, (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)


def attributes(raw: bytes, pixels: bool = True) -> dict[str, str | bytes] | None:
    """The known attributes of a file as text and its pixels as bytes; None for what is no DICOM file.

    Compressed pixels are empty bytes, and so are all without ``pixels``. A file that ends within an element is a ValueError.
    """
    if len(raw) < 132 or raw[128:132] != b"DICM":
        return None
    out: dict[str, str | bytes] = {"syntax": EXPLICIT}
    raw, at = _header(raw, out)
    order = ">" if out["syntax"] == BIG else "<"
    for tag, value in _outermost(raw, at, order, explicit=out["syntax"] != IMPLICIT):
        name = TAGS.get(tag)
        if name in BINARY:
            out[name] = bytes(value) if pixels else b""
        elif name in _NUMBERS:
            out[name] = str(struct.unpack_from(order + "H", value)[0]) if len(value) >= 2 else ""
        elif name:
            out[name] = bytes(value).rstrip(b"\0 ").decode("utf-8", "replace").strip()
    return out


def _header(raw: bytes, out: dict) -> tuple[memoryview, int]:
    """The bytes of the data set and where it begins; the header before it, group 2, names its transfer syntax."""
    at = 132
    while at + 8 <= len(raw) and struct.unpack_from("<H", raw, at)[0] == 2:
        tag, _, size, at = _element(raw, at, "<", True)
        value, at = _value(raw, at, size)
        if tag == (0x0002, 0x0010):
            out["syntax"] = bytes(value).rstrip(b"\0 ").decode("ascii", "replace")
    if out["syntax"] == DEFLATED:
        return memoryview(zlib.decompressobj(-zlib.MAX_WBITS).decompress(raw[at:])), 0
    return memoryview(raw), at


#: By byte order: an element's first eight bytes, and a long length.
_HEADS = {order: (struct.Struct(order + "2H2sH"), struct.Struct(order + "I")) for order in "<>"}


def _element(raw, at: int, order: str, explicit: bool) -> tuple[tuple[int, int], bytes, int, int]:
    """(tag, kind, length, where the value begins) of the element at a place; items and their ends have no kind."""
    head, whole = _HEADS[order]
    group, element, kind, short = head.unpack_from(raw, at)
    if explicit and group != 0xFFFE:
        if kind in _LONG:
            return (group, element), kind, whole.unpack_from(raw, at + 8)[0], at + 12
        return (group, element), kind, short, at + 8
    return (group, element), b"", whole.unpack_from(raw, at + 4)[0], at + 8


def _value(raw, at: int, size: int) -> tuple[memoryview, int]:
    if at + size > len(raw):
        raise ValueError("the file ends within an element")
    return raw[at: at + size], at + size


def _outermost(raw: memoryview, at: int, order: str, explicit: bool) -> Iterator[tuple[tuple[int, int], memoryview]]:
    """(tag, value) of the elements outside of all sequences; one of open length has an empty value."""
    open_: list[bool] = []  # for each open sequence or item, whether its elements name their kinds
    while at + 8 <= len(raw):
        named = open_[-1] if open_ else explicit
        tag, kind, size, at = _element(raw, at, order, named)
        if tag in (_ITEM_END, _SEQUENCE_END):
            if open_:
                open_.pop()
        elif size == _OPEN:
            if not open_:
                yield tag, memoryview(b"")
            # What is open and of unknown kind is written without kinds inside.
            open_.append(named if tag == _ITEM or kind != b"UN" else False)
        else:
            value, at = _value(raw, at, size)
            if not open_:
                yield tag, value
    if open_ or at < len(raw) and any(raw[at:]):
        raise ValueError("the file ends within an element")


_SHORT, _LENGTH = struct.Struct("<H"), struct.Struct("<HI")


def _written() -> list[tuple[str, bytes, bool, bool]]:
    """(name, tag and kind, whether its length is long, whether it is a number) of the attributes in the order of their tags."""
    out = []
    for (group, element), name in sorted(TAGS.items()):
        kind = b"OW" if name == "pixels" else b"OF" if name == "float_pixels" else b"US" if name in _NUMBERS else b"LO"
        out.append((name, struct.pack("<2H", group, element) + kind, kind in _LONG, name in _NUMBERS))
    return out


_WRITTEN = _written()


def encode(values: dict[str, str | bytes | None]) -> bytes:
    """A file of the given attributes, explicit little endian; attributes that are None are left out."""
    out = [b"\0" * 128 + b"DICM"]
    for name, head, long, number in _WRITTEN:
        value = values.get(name)
        if value is None:
            continue
        raw = value if isinstance(value, bytes) else _SHORT.pack(int(value)) if number else value.encode()
        raw += b"\0" * (len(raw) % 2)
        out += (head, _LENGTH.pack(0, len(raw)) if long else _SHORT.pack(len(raw)), raw)
    return b"".join(out)


def parsed(files: DataFrame, pixels: bool = True) -> DataFrame:
    """One row of attributes for every file (path, content); without ``pixels`` they are left out."""

    def attributes_of(raw: bytes) -> tuple[dict, bool, bool]:
        try:
            found = attributes(raw, pixels)
        except (ValueError, struct.error, zlib.error):
            return {}, True, True
        return found or {}, found is not None, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [attributes_of(raw.as_py() or b"") for raw in part.column(1)]
                columns = {n: pa.array([r.get(n) for r, _, _ in found], pa.binary() if n in BINARY else pa.string()) for n in (*TEXT, *BINARY)}
                states = {"readable": pa.array([r[1] for r in found]), "broken": pa.array([r[2] for r in found])}
                yield pa.RecordBatch.from_pydict({"path": part.column(0)} | states | columns)

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row of every file below ``path``."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


#: Body parts that are heads; no body part may be one.
HEADS = ("HEAD", "BRAIN", "SKULL", "HEADNECK", "")


def rejections(files: DataFrame, heads: tuple[str, ...] = HEADS) -> DataFrame:
    """Adds ``rejection``, the first rule that a file breaks; a repeated instance counts among files not rejected."""
    blank = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    first = first_match([
        ("notDicom", ~F.col("readable")), ("unreadable", F.col("broken")), ("noSeries", blank("series")), ("noPixels", F.coalesce("pixels", "float_pixels").isNull()),
        ("notMr", ~F.coalesce(F.trim("modality"), F.lit("")).isin("", "MR")), ("notHead", ~F.upper(F.coalesce(F.trim("body_part"), F.lit(""))).isin(*heads)),
    ])
    marked = files.withColumn("rejection", first)
    again = F.row_number().over(Window.partitionBy("instance", F.col("rejection").isNull()).orderBy("path")) > 1
    return marked.withColumn("rejection", F.coalesce("rejection", F.when(again & ~blank("instance"), "duplicateInstance")))


#: Fixed value: the most voxels of a volume.
MAX_VOXELS = 512 * 512 * 1024


def _numbers(text: Column, n: int) -> Column:
    """The first n numbers of a list with backslashes; what is missing or no number is 0."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\\")
    return F.array(*[F.coalesce(F.try_element_at(parts, F.lit(k + 1)).try_cast("double"), F.lit(0.0)) for k in range(n)])


def placed(files: DataFrame) -> DataFrame:
    """(series, path, place, slices, refusal): of each slice its place from 0 along the normal of the series' first file, by path, and of each
    series the first reason against a volume of it, null if there is none.

    Of a file that can't be decoded: ``compressed``, ``bits``, ``samples``; of the series: ``noDimensions``,
    ``tooManyVoxels``; of a file that differs from the first: ``otherDimensions``, ``otherFormat``; ``shortPixels``.
    """
    number = lambda n, default: F.coalesce(F.col(n).try_cast("long"), F.lit(default))
    heads = files.where("series <> ''").select(
        "series", "path", number("rows", 0).alias("rows"), number("columns", 0).alias("columns"), number("samples", 1).alias("samples"), (F.col("signed") == "1").alias("signed"), "syntax",
        F.when(F.col("pixels").isNull() & F.col("float_pixels").isNotNull(), 32).otherwise(number("bits", 0)).alias("bits"), F.col("pixels").isNull().alias("floats"),
        F.coalesce(F.length("pixels"), F.length("float_pixels"), F.lit(0)).alias("bytes"), _numbers(F.col("orientation"), 6).alias("o"), _numbers(F.col("position"), 3).alias("p"),
    )
    w = Window.partitionBy("series")
    first = F.min_by(F.struct("rows", "columns", "bits", "signed", "o"), "path")
    of = heads.groupBy("series").agg(first.alias("first"), F.count(F.lit(1)).alias("slices"))
    h = heads.join(of, "series")
    o = [F.col("first.o")[k] for k in range(6)]
    normal = (o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3])
    along = sum((F.col("p")[k] * normal[k] for k in range(3)), F.lit(0.0))
    plain = F.col("syntax").isin(IMPLICIT, EXPLICIT, DEFLATED, BIG)
    same = lambda *names: F.forall(F.array(*[F.col(f"first.{n}").eqNullSafe(F.col(n)) for n in names]), lambda x: x)
    rules = [
        (0, "compressed", ~plain), (0, "bits", ~F.col("floats") & ~F.col("bits").isin(8, 16)), (0, "samples", F.col("samples") != 1),
        (1, "noDimensions", (F.col("first.rows") == 0) | (F.col("first.columns") == 0)), (2, "tooManyVoxels", F.col("first.rows") * F.col("first.columns") * F.col("slices") > MAX_VOXELS),
        (3, "otherDimensions", ~same("rows", "columns")), (3, "otherFormat", ~same("bits", "signed")), (3, "shortPixels", F.col("bytes") < F.col("rows") * F.col("columns") * (F.col("bits") / 8)),
    ]
    broken = F.filter(F.array(*[F.when(broken, F.struct(F.lit(step).alias("step"), F.col("path").alias("path"), F.lit(k).alias("k"), F.lit(code).alias("code"))) for k, (step, code, broken) in enumerate(rules)]), lambda x: x.isNotNull())
    # Files are decoded before they are compared, and of the files compared the first one that differs counts.
    found = h.withColumn("broken", F.array_min(broken)).withColumn("along", along)
    place = F.row_number().over(w.orderBy("along", "path")) - 1
    return found.select("series", "path", place.alias("place"), "slices", F.min("broken").over(w)["code"].alias("refusal"))


def slices(files: DataFrame) -> DataFrame:
    """(series, place, slices, columns, rows, voxels): the rescaled voxels of every slice of the series without a refusal; no task
    holds more than a batch of slices, however large the volume."""
    kept = placed(files).where("refusal IS NULL").select(F.col("path").alias("at"), "place", "slices")
    rows = files.join(kept, F.col("path") == F.col("at")).select("series", "place", "slices", "columns", "rows", "bits", "signed", "slope", "intercept", "syntax", "pixels", "float_pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [decoded(r) for r in part.select(list(part.schema.names)).to_pylist()]
                counts = {n: part.column(n).cast(pa.int32()) for n in ("place", "slices", "columns", "rows")}
                yield pa.RecordBatch.from_pydict({"series": part.column("series")} | counts | {"voxels": pa.array(found, pa.list_(pa.float64()))})

    return rows.mapInArrow(run, "series string, place int, slices int, columns int, rows int, voxels array<double>")


def decoded(r: dict) -> np.ndarray:
    """The rescaled values of one slice."""
    order = ">" if r["syntax"] == BIG else "<"
    kind = f"{order}f4" if r["pixels"] is None else order + ("i" if r["signed"] == "1" else "u") + str(int(r["bits"]) // 8)
    number = lambda text, default: float(text) if text else default
    raw = np.frombuffer(r["float_pixels"] if r["pixels"] is None else r["pixels"], kind, int(r["rows"]) * int(r["columns"]))
    return raw.astype(float) * number(r["slope"], 1.0) + number(r["intercept"], 0.0)


def volumes(files: DataFrame) -> DataFrame:
    """(series, columns, rows, slices, voxels) of the series without a refusal, as one array each; ``slices`` gives large
    volumes slice by slice."""
    stacked = F.flatten(F.array_sort(F.collect_list(F.struct("place", "voxels")))["voxels"])
    return slices(files).groupBy("series", "columns", "rows", "slices").agg(stacked.alias("voxels"))
