"""NIfTI-1 volumes: headers of 348 bytes of either byte order, and dense voxels, plain or gzip."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Numpy types of the format's datatype codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = "path string, error string, rank int, columns int, rows int, slices int, datatype int, spacing array<double>, slope double, intercept double, origin string, affine array<double>"
VOXELS = "path string, error string, columns int, rows int, slices int, voxels array<float>"


def header(raw: bytes) -> dict:
    """The fields of a header; raises ValueError for what is none. Directions are turned from RAS to LPS."""
    if len(raw) < 348:
        raise ValueError("truncated header")
    order = next((o for o in "<>" if struct.unpack(o + "i", raw[:4])[0] == 348), None)
    if order is None:
        raise ValueError("not a NIfTI header")
    dim = struct.unpack(order + "8h", raw[40:56])
    if not 1 <= dim[0] <= 7 or any(n <= 0 for n in dim[1: min(dim[0], 3) + 1]):
        raise ValueError("bad dimensions")
    pixdim = struct.unpack(order + "8f", raw[76:108])
    datatype = struct.unpack(order + "h", raw[70:72])[0]
    offset, slope, intercept = struct.unpack(order + "3f", raw[108:120])
    qform, sform = struct.unpack(order + "2h", raw[252:256])
    if sform > 0:
        origin, rows = "sform", np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack(order + "6f", raw[256:280])
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        scale = np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
        origin, rows = "qform", np.column_stack([turn * scale, [x, y, z]])
    else:
        origin, rows = "default", np.column_stack([np.diag(pixdim[1:4]), [0, 0, 0]])
    shape = [dim[k] if k <= dim[0] else 1 for k in (1, 2, 3)]
    return {
        "rank": dim[0], "shape": shape, "datatype": datatype, "order": order, "offset": int(offset), "spacing": [float(p) for p in pixdim[1:4]],
        "slope": float(slope) or 1.0, "intercept": float(intercept) if slope else 0.0, "origin": origin, "affine": (rows * np.array([[-1], [-1], [1]])).ravel().tolist(),
    }


def encode(voxels: np.ndarray, spacing=(1.0, 1.0, 1.0), slope: float = 1.0, intercept: float = 0.0) -> bytes:
    """A float volume [slice, row, column] as a file of the format."""
    raw = bytearray(352)
    struct.pack_into("<i", raw, 0, 348)
    struct.pack_into("<8h", raw, 40, 3, *voxels.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", raw, 70, 16, 32)
    struct.pack_into("<8f", raw, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", raw, 108, 352, slope, intercept)
    raw[344:348] = b"n+1\0"
    return bytes(raw) + voxels.astype("<f4").tobytes()


def volume(raw: bytes) -> tuple[dict, np.ndarray]:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    h = header(raw)
    if h["datatype"] not in TYPES:
        raise ValueError("unsupported datatype")
    kind = np.dtype(h["order"] + TYPES[h["datatype"]])
    n = int(np.prod(h["shape"]))
    if len(raw) < h["offset"] + n * kind.itemsize:
        raise ValueError("truncated data")
    v = np.frombuffer(raw, kind, n, h["offset"]).astype(np.float64) * h["slope"] + h["intercept"]
    return h, v.astype(np.float32)


def decode(df: DataFrame, path: str = "path", content: str = "content", voxels: bool = True) -> DataFrame:
    """Headers, or voxels in the order column, row, slice, of binary rows; what can't be read has an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    h, v = volume(raw.as_py()) if voxels else (header(raw.as_py()), None)
                    base = {"path": [name], "error": pa.array([None], pa.string()), "columns": pa.array([h["shape"][0]], pa.int32()), "rows": pa.array([h["shape"][1]], pa.int32()), "slices": pa.array([h["shape"][2]], pa.int32())}
                    if voxels:
                        yield pa.RecordBatch.from_pydict(base | {"voxels": pa.array([v], pa.list_(pa.float32()))})
                    else:
                        more = {k: pa.array([h[k]], t) for k, t in (("rank", pa.int32()), ("datatype", pa.int32()), ("spacing", pa.list_(pa.float64())), ("slope", pa.float64()), ("intercept", pa.float64()), ("origin", pa.string()), ("affine", pa.list_(pa.float64())))}
                        yield pa.RecordBatch.from_pydict({k: (base | more)[k] for k in ("path", "error", "rank", "columns", "rows", "slices", "datatype", "spacing", "slope", "intercept", "origin", "affine")})
                except (ValueError, OSError, EOFError, TypeError) as e:
                    schema = pa.schema([(f, t) for f, t in (_VOXEL_FIELDS if voxels else _HEADER_FIELDS)])
                    yield pa.RecordBatch.from_pydict({f.name: pa.array([name if f.name == "path" else str(e) if f.name == "error" else None], f.type) for f in schema}, schema=schema)

    return df.select(path, content).mapInArrow(run, VOXELS if voxels else HEADER)


_VOXEL_FIELDS = [("path", pa.string()), ("error", pa.string()), ("columns", pa.int32()), ("rows", pa.int32()), ("slices", pa.int32()), ("voxels", pa.list_(pa.float32()))]
_HEADER_FIELDS = [("path", pa.string()), ("error", pa.string()), ("rank", pa.int32()), ("columns", pa.int32()), ("rows", pa.int32()), ("slices", pa.int32()), ("datatype", pa.int32()), ("spacing", pa.list_(pa.float64())), ("slope", pa.float64()), ("intercept", pa.float64()), ("origin", pa.string()), ("affine", pa.list_(pa.float64()))]


def read(spark: SparkSession, path: str, voxels: bool = True) -> DataFrame:
    return decode(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), voxels=voxels)
