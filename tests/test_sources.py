"""File formats against files made here."""

import gzip
import io
import json
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import archives, dicom, documents, files, nifti, sinks


def element(group, number, kind, value):
    value += b"\0" * (len(value) % 2)
    head = struct.pack("<2H", group, number) + kind
    return head + (struct.pack("<HI", 0, len(value)) if kind == b"OW" else struct.pack("<H", len(value))) + value


def slice_file(z, modality=b"MR", instance=b"1.1", pixels=True):
    body = element(8, 0x18, b"UI", instance) + element(8, 0x60, b"CS", modality) + element(0x20, 0xE, b"UI", b"9.9") + element(0x20, 0x32, b"DS", f"0\\0\\{z}".encode()) + element(0x20, 0x37, b"DS", b"1\\0\\0\\0\\1\\0")
    body += element(0x28, 0x10, b"US", struct.pack("<H", 2)) + element(0x28, 0x11, b"US", struct.pack("<H", 3)) + element(0x28, 0x100, b"US", struct.pack("<H", 16)) + element(0x28, 0x103, b"US", struct.pack("<H", 0)) + element(0x28, 0x1052, b"DS", b"-1") + element(0x28, 0x1053, b"DS", b"2")
    return b"\0" * 128 + b"DICM" + body + (element(0x7FE0, 0x10, b"OW", np.arange(6, dtype="<u2").tobytes() if pixels is True else pixels) if pixels else b"")


def test_dicom(spark, tmp_path):
    for name, raw in {"b": slice_file(2, instance=b"1.2"), "a": slice_file(5), "c": slice_file(2, instance=b"1.2"), "d": b"text", "e": slice_file(1, modality=b"CT", instance=b"1.5"), "f": slice_file(1, instance=b"1.6", pixels=False)}.items():
        (tmp_path / name).write_bytes(raw)
    files = dicom.rejections(dicom.read(spark, str(tmp_path))).cache()
    got = {r.path[-1]: r.rejection for r in files.collect()}
    assert got == {"a": None, "b": None, "c": "duplicateInstance", "d": "notDicom", "e": "notMr", "f": "noPixels"}
    (v,) = dicom.volumes(files.where("rejection IS NULL")).collect()
    assert (v.columns, v.rows, v.slices) == (3, 2, 2) and v.voxels[:6] == [-1, 1, 3, 5, 7, 9]


def test_nifti(spark, tmp_path):
    v = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    (tmp_path / "a.nii").write_bytes(nifti.encode(v, (0.9, 1.1, 1.5), 2, 1))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti.encode(v)))
    (tmp_path / "c.nii").write_bytes(nifti.encode(v)[:-4])
    got = {r.path[-5:]: r for r in nifti.read(spark, str(tmp_path)).collect()}
    assert got["a.nii"].voxels == [2 * x + 1 for x in range(24)] and (got["a.nii"].columns, got["a.nii"].rows, got["a.nii"].slices) == (4, 3, 2)
    assert got["ii.gz"].voxels == list(range(24)) and got["c.nii"].error == "truncated data"
    with pytest.raises(ValueError):
        nifti.header(b"x" * 400)


def test_big_endian_header():
    raw = bytearray(352)
    struct.pack_into(">i", raw, 0, 348)
    struct.pack_into(">8h", raw, 40, 3, 4, 5, 6, 1, 1, 1, 1)
    struct.pack_into(">2h", raw, 252, 0, 1)
    struct.pack_into(">12f", raw, 280, *range(12))
    h = nifti.header(bytes(raw))
    assert h["shape"] == [4, 5, 6] and h["origin"] == "sform" and h["affine"][:4] == [0, -1, -2, -3] and h["slope"] == 1


def test_archive(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name in ("IXI012-HH-1211-T1.nii.gz", "notes.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    (r,) = archives.members(spark, str(tmp_path), ".nii.gz").withColumn("site", archives.name_parts(F.col("name"))).collect()
    assert (r.site, bytes(r.content)) == ("HH", b"abc")


def test_manifest_version(spark, tmp_path):
    row = {"series_id": "s", "study_id": "t", "subject_id": "u", "tier": "Extended", "weighting": "T1", "contrast_enhanced": False, "slice_count": 3, "voxel_spacing_mm": [1.0, 1.0, 1.0]}
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1.0.0", "series": [row]}, indent=1))
    assert documents.manifest(spark, str(tmp_path / "m.json")).first().slice_count == 3
    (tmp_path / "n.json").write_text(json.dumps({"schema_version": "2.0.0", "series": [row]}))
    with pytest.raises(Exception, match="schema_version"):
        documents.manifest(spark, str(tmp_path / "n.json")).collect()


def test_semicolons(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿"code";"note"\nS-0001;"a; ""b"""\n', encoding="utf-8")
    (r,) = documents.semicolons(spark, str(tmp_path / "r.csv")).collect()
    assert (r.code, r.note) == ("S-0001", 'a; "b"')


def test_journal_lines(spark):
    good = json.dumps({"event": "e", "previousHash": "p", "hash": "h"})
    lines = spark.createDataFrame([(0, good + "\r"), (1, ""), (2, "{bad"), (3, good), (4, good[:10])], "n long, value string")
    assert [r.state for r in documents.journal(lines).orderBy("n").collect()] == ["record", "unreadable", "record", "incompleteTail"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k1", "a"), ("k2", "b")], "k string, c string")
    sinks.write_immutable(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_immutable(df, str(tmp_path / "out"))
    assert [r.k for r in sinks.write_idempotent(df, df.where("k = 'k1'"), "k", "c").collect()] == ["k2"]
    with pytest.raises(Exception, match="another content"):
        sinks.write_idempotent(df, spark.createDataFrame([("k1", "z")], "k string, c string"), "k", "c").collect()


def walked(paths, max_depth, max_files, max_bytes):
    """The walk by an explicit queue of folders."""
    sizes, out, queue, seen = dict(paths), [], [((), 0)], 0
    while queue:
        folder, depth = queue.pop(0)
        if depth > max_depth:
            out.append(("/".join(folder), "tooDeep"))
            continue
        below = [p.split("/") for p in sizes if tuple(p.split("/")[: len(folder)]) == folder]
        queue += [((*folder, name), depth + 1) for name in sorted({p[len(folder)] for p in below if len(p) > len(folder) + 1})]
        for p in sorted("/".join(p) for p in below if len(p) == len(folder) + 1):
            seen += 1
            if seen > max_files:
                return [*out, (p, "tooMany")]
            out.append((p, "tooLarge" if sizes[p] > max_bytes else "read"))
    return out


def test_walk_reaches_each_limit(spark, tmp_path):
    paths = [("a", 5), ("b/a", 5), ("b/c/a", 50), ("b/c/d/e", 5), ("b/c/d/f", 5), ("b/c/g/h/i", 5), ("b/c/z", 5), ("B/é", 500), ("b-/x", 5), ("b/c.x/d/e", 1), ("z", 700)]
    df = spark.createDataFrame(paths, "path string, size long").repartition(4)
    kinds = set()
    for depth in (0, 1, 2, 3, 9):
        for most in (0, 1, 2, 5, 7, 11, 100):
            want = walked(paths, depth, most, 400)
            got = [tuple(r) for r in files.walk(df, depth, most, 400).collect()]
            assert sorted(got) == sorted(want), (depth, most)
            assert sum(o == "tooMany" for _, o in got) <= 1
            kinds |= {o for _, o in got}
    assert kinds == {"read", "tooDeep", "tooMany", "tooLarge"}
    assert files.walk(df.limit(0)).count() == 0
    for path, size in paths:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * size)
    got = files.walk(files.listing(spark, str(tmp_path)), 2, 100, 400).collect()
    assert sorted((r.path.replace("%C3%A9", "é"), r.outcome) for r in got) == sorted(walked(paths, 2, 100, 400))


def elements(order="<", kinds=True, **values):
    """Elements by attribute name, in the order of their tags, with their kinds or without."""
    out = b""
    for tag, name in sorted(dicom.TAGS.items()):
        if name not in values:
            continue
        v = values[name]
        v = struct.pack(order + "H", v) if isinstance(v, int) else v if isinstance(v, bytes) else v.encode()
        v += b"\0" * (len(v) % 2)
        long = name in dicom.BINARY
        head = (b"OW" if long else b"LO") + (struct.pack(order + "HI", 0, len(v)) if long else struct.pack(order + "H", len(v))) if kinds else struct.pack(order + "I", len(v))
        out += struct.pack(order + "2H", *tag) + head + v
    return out


def nested(order="<", kinds=True, kind=b"SQ"):
    """A sequence of open length: an item of open length that holds one of known length, and decoys of known tags."""
    tag = lambda g, e, size: struct.pack(order + "2HI", g, e, size)
    within = kinds and kind != b"UN"
    begin = lambda g, e, size, k: struct.pack(order + "2H", g, e) + (k + struct.pack(order + "HI", 0, size) if within else struct.pack(order + "I", size))
    decoy = elements(order, within, series="wrong", modality="CT")
    inner = tag(0xFFFE, 0xE000, len(decoy)) + decoy
    body = tag(0xFFFE, 0xE000, 0xFFFFFFFF) + decoy + begin(0x0008, 0x1199, len(inner), b"SQ") + inner + begin(0x0008, 0x1115, 0xFFFFFFFF, b"SQ") + tag(0xFFFE, 0xE0DD, 0) + tag(0xFFFE, 0xE00D, 0) + inner
    head = struct.pack(order + "2H", 0x0008, 0x1140) + (kind + struct.pack(order + "HI", 0, 0xFFFFFFFF) if kinds else struct.pack(order + "I", 0xFFFFFFFF))
    return head + body + tag(0xFFFE, 0xE0DD, 0)


def file_of(body, syntax=dicom.EXPLICIT):
    uid = syntax.encode() + b"\0" * (len(syntax) % 2)
    return b"\0" * 128 + b"DICM" + struct.pack("<2H", 2, 0x10) + b"UI" + struct.pack("<H", len(uid)) + uid + body


SLICE = dict(instance="1", modality="MR", series="9.9", rows=2, columns=3, bits=16, signed=1, slope="2", intercept="-1")


@pytest.mark.parametrize("syntax", [dicom.EXPLICIT, dicom.IMPLICIT, dicom.BIG, dicom.DEFLATED])
@pytest.mark.parametrize("kind", [b"SQ", b"UN"])
def test_sequences_of_open_length_are_passed(syntax, kind):
    order, kinds = (">" if syntax == dicom.BIG else "<"), syntax != dicom.IMPLICIT
    pixels = np.arange(-3, 3).astype(order + "i2").tobytes()
    known = elements(order, kinds, **SLICE, pixels=pixels)
    cut = len(elements(order, kinds, instance="1", modality="MR"))
    body = known[:cut] + nested(order, kinds, kind) + known[cut:]
    if syntax == dicom.DEFLATED:
        packer = zlib.compressobj(wbits=-15)
        body = packer.compress(body) + packer.flush()
    found = dicom.attributes(file_of(body, syntax))
    assert (found["modality"], found["series"], found["rows"], found["pixels"]) == ("MR", "9.9", "2", pixels)
    assert dicom.decoded({"float_pixels": None} | found).tolist() == [-7, -5, -3, -1, 1, 3]
    assert dicom.attributes(file_of(body, syntax), pixels=False)["pixels"] == b""


def test_cut_and_compressed_files(spark):
    whole = file_of(elements(**SLICE, pixels=b"\0" * 12))
    fragments = struct.pack("<2H", 0x7FE0, 0x10) + b"OB" + struct.pack("<HI", 0, 0xFFFFFFFF) + struct.pack("<2HI", 0xFFFE, 0xE000, 0) + struct.pack("<2HI", 0xFFFE, 0xE000, 4) + b"abcd" + struct.pack("<2HI", 0xFFFE, 0xE0DD, 0)
    made = {"a": whole, "b": whole[:-3], "c": file_of(elements(**(SLICE | {"instance": "2"})) + fragments, "1.2.840.10008.1.2.4.50"), "d": b"", "e": file_of(nested()[:-4]), "f": file_of(elements(series="7", rows=1)), "g": file_of(elements(series="7", instance="5", body_part="neck", pixels=b"")), "h": file_of(elements(series="7", instance="6"))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")
    found = dicom.rejections(dicom.parsed(df))
    got = {r.path: r.rejection for r in found.collect()}
    assert got == {"a": None, "b": "unreadable", "c": None, "d": "notDicom", "e": "unreadable", "f": "noPixels", "g": "notHead", "h": "noPixels"}
    assert {r.path: r.refusal for r in dicom.placed(found.where("path = 'c'")).collect()} == {"c": "compressed"}
    assert dicom.parsed(df.limit(0)).count() == 0 and dicom.volumes(found.limit(0)).count() == 0


def test_series_that_are_no_volume(spark):
    good = dict(rows=2, columns=3, bits=16, signed=0, orientation="1\\0\\0\\0\\1\\0", pixels=b"\1\0" * 6)
    bad = {
        "fine": [{}, {}], "compressed": [{}, {"syntax": "1.2.840.10008.1.2.4.70"}], "bits": [{}, {"bits": 32}], "samples": [{"samples": 3}, {}], "noDimensions": [{"rows": 0}, {}], "tooManyVoxels": [{"rows": 60000, "columns": 60000}, {}],
        "otherDimensions": [{}, {"rows": 1}, {"signed": 1}], "otherFormat": [{}, {"signed": 1}, {"rows": 1}], "shortPixels": [{}, {"pixels": b"\1\0" * 5}, {"rows": 3}],
    }
    rows = []
    for code, parts in bad.items():
        for k, part in enumerate(parts):
            v = good | {"series": code, "instance": f"{code}{k}", "position": f"0\\0\\{-k}"} | part
            rows.append((f"{code}/{k}", bytearray(file_of(elements(**{n: x for n, x in v.items() if n != "syntax"}), v.get("syntax", dicom.EXPLICIT)))))
    files_ = dicom.parsed(spark.createDataFrame(rows, "path string, content binary").repartition(5))
    got = dicom.placed(files_).collect()
    assert {r.series: r.refusal for r in got} == {code: None if code == "fine" else code for code in bad}
    assert [(r.path, r.place) for r in sorted(got) if r.series == "fine"] == [("fine/0", 1), ("fine/1", 0)]  # along the normal, not by name
    (v,) = dicom.volumes(files_).collect()
    assert (v.series, v.slices, v.voxels) == ("fine", 2, [1.0] * 12) and dicom.slices(files_).count() == 2


def test_the_layout_of_files_is_made_once(monkeypatch):
    """it was made of the list of tags for each file."""
    from cairn.sources import dicom

    rows = [{"instance": f"{i}.1", "rows": str(i), "modality": "MR", "pixels": b"\0\0"} for i in range(300)]
    with monkeypatch.context() as m:
        m.setattr(dicom, "TAGS", None)
        files = [dicom.encode(r) for r in rows]
    assert [dicom.attributes(f) for f in files] == [r | {"syntax": dicom.EXPLICIT} for r in rows]
