"""SimHash near-duplicates through pivot distance tables.

Fingerprints of 64 bits come from the XXH64 (seed 42) of space-joined word shingles. Two fingerprints link when
they differ in at most ``max_bits`` bits. Linking works on distinct fingerprints:

1. A fingerprint is filed under four keys, one for each quarter of its bits. Two fingerprints with three or fewer
   differing bits agree in one quarter at least, so every link meets under a key.
2. Each distinct fingerprint has a stored row of Hamming distances to 16 reference fingerprints (the pivot table). By
   the triangle inequality the largest coordinate difference is a lower bound of the distance. Under a key, rows are
   searched by range on the first coordinate, pairs above ``max_bits`` in any other are discarded, survivors verified.
3. A key with more than ``key_rows`` fingerprints is filed again under quarters of its free bits, until it fits; no
   row is dropped, and as fingerprints are distinct, few free bits bound the rows.
4. A task returns one star for each group it has linked, not all pairs; stars are joined to components in Spark.

``keep_one`` can also link all rows whose shingle sets have a Jaccard coefficient of ``jaccard`` or more: see
``_likeness``.

Nulls: a null or blank text has the fingerprint zero and is linked like any other. Repeated rows share a fingerprint
and a component. Rows with a null id keep their fingerprint and take the component of the equal fingerprint with the
smallest id (null if no row has an id). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.graph import connected_components

from ._likeness import SKETCH, similar_components, sketches
from ._store import durable, fresh, partitions, scratch
from ._text import IS_SPACE, LOWER, U64, chunks, components, mix, utf8, words

SEED = 42
#: Reference fingerprints of the pivot table: the mixed numbers 1 to 16.
PIVOTS = mix(np.arange(1, 17, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: A key with so few free bits is not filed again: its distinct fingerprints are 2^12 at most.
_FEW_BITS = 12
#: Byte value -> its eight bits, the highest first, in eight byte lanes.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(U64)[:, 0]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of every row of a buffer, and the number of shingles of each row."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, rows = words(low, offsets, IS_SPACE)
    counts = np.bincount(rows, minlength=n)
    size = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    inside = np.repeat(at[:-1] - starts, size) + np.flatnonzero(~IS_SPACE[low])
    joined[inside] = low[~IS_SPACE[low]]
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first_word = np.cumsum(counts) - counts
    row = np.repeat(np.arange(n), shingles)
    first = first_word[row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = first + np.minimum(width, counts[row]) - 1
    begin, end = at[first], at[last] + size[last]
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist())), U64, len(begin)), shingles


def fingerprints_of(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """One 64-bit word for each row: the bits that over half its hashes have."""
    out = np.zeros(len(shingles), U64)
    full = np.flatnonzero(shingles)
    if not len(full):
        return out
    # Eight counters of a byte fit in a word, so hashes are added up in runs of at most 255.
    n = shingles[full]
    runs = -(-n // 255)
    run_of = np.repeat(np.arange(len(full)), runs)
    begin = np.repeat(np.cumsum(n) - n, runs) + 255 * (np.arange(len(run_of)) - np.repeat(np.cumsum(runs) - runs, runs))
    parts = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(full), 64), np.int64)
    row_begin = np.cumsum(runs) - runs
    for k in range(8):
        lanes = np.add.reduceat(_LANES[parts[:, k]], begin).view(np.uint8).reshape(-1, 8)
        counts[:, 8 * k: 8 * k + 8] = np.add.reduceat(lanes.astype(np.int64), row_begin, axis=0)
    bits = np.packbits(2 * counts > n[:, None], axis=1)
    out[full] = bits.view(">u8")[:, 0].astype(U64)
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long: the fingerprint's bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for at, to, d, o in chunks(data, offsets):
                fp = fingerprints_of(*shingle_hashes(d, o, width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def _quarters(mask: int) -> list[int]:
    """The free bits of ``mask`` in four parts."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(free, 4)]


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table: the Hamming distances of each fingerprint to the reference fingerprints."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _tabled(classes: DataFrame) -> DataFrame:
    """(fp, rep, mask, pivots): each distinct fingerprint with its row of the pivot table, computed once; no bit fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([r.tobytes() for r in distances(np.asarray(batch.column(0)).view(U64))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(batch.num_rows, np.int64)), rows], ["fp", "rep", "mask", "pivots"])

    return classes.select("fp", "rep").mapInArrow(run, "fp long, rep long, mask long, pivots binary")


def _filed(rows: DataFrame) -> DataFrame:
    """Each row (fp, rep, mask, pivots) once for each quarter of its free bits: (key, fp, rep, mask, pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep, mask = (np.asarray(batch.column(i)) for i in range(3))
            for held in np.unique(mask):
                own, fixed = np.flatnonzero(mask == held), int(held) % (1 << 64)
                table = batch.column(3).take(pa.array(own))
                for part in _quarters(fixed):
                    wide = U64(fixed | part)
                    key = mix(mix(fp[own].view(U64) & wide) ^ wide)
                    columns = [pa.array(x) for x in (key.view(np.int64), fp[own], rep[own], np.full(len(own), wide, U64).view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, table], ["key", "fp", "rep", "mask", "pivots"])

    return rows.select("fp", "rep", "mask", "pivots").mapInArrow(run, "key long, fp long, rep long, mask long, pivots binary")


def link_sorted(key: np.ndarray, fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs among rows that share a key. The pivot table is searched by range on its first
    coordinate; of the pairs found, those with a coordinate difference above ``max_bits`` are discarded, as no two
    fingerprints are nearer than their rows; what is left is verified."""
    order = np.lexsort((table[:, 0], key))
    key, fp, table = key[order], fp[order], table[order]
    active, found_a, found_b, shift = np.arange(len(fp)), [], [], 1
    while len(active):
        active = active[active + shift < len(fp)]
        other = active + shift
        near = (key[active] == key[other]) & (table[other, 0] - table[active, 0] <= max_bits)
        active, other = active[near], other[near]  # sorted: once beyond, always beyond
        close = np.abs(table[active] - table[other]).max(axis=1, initial=0) <= max_bits
        a, b = active[close], other[close]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        found_a.append(a[true])
        found_b.append(b[true])
        shift += 1
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(found_a)], order[np.concatenate(found_b)]


def _links(filed: DataFrame, max_bits: int, n: int) -> DataFrame:
    """Stars (a, b) of the groups that link under each key. A key's rows are one task's; its size is bounded."""

    def stars(key, fp, rep, table):
        a, b = link_sorted(key, fp.view(U64), table, max_bits)
        used = np.unique(np.concatenate([a, b]))
        label = components(len(used), np.searchsorted(used, a), np.searchsorted(used, b))
        moved = np.flatnonzero(label != np.arange(len(used)))
        return pa.RecordBatch.from_arrays([pa.array(rep[used[label[moved]]]), pa.array(rep[used[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*[np.zeros(0, np.int64)] * 3, np.zeros((0, len(PIVOTS)), np.int8)]
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(-1, len(PIVOTS))
            held = [np.concatenate(x) for x in zip(held, [*(np.asarray(batch.column(i)) for i in range(3)), table])]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
            if whole:
                yield stars(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        yield stars(*held)

    return filed.select("key", "fp", "rep", "pivots").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_links(classes: DataFrame, max_bits: int = 3, key_rows: int = 4096) -> DataFrame:
    """Links (a, b) between the representatives of distinct fingerprints ``classes``: (fp, rep). Their components
    are those of all pairs with at most ``max_bits`` (3 or fewer) differing bits."""
    if max_bits > 3:
        raise ValueError("four quarters guarantee a common key for 3 differing bits at most")
    n = partitions(classes)
    filed = _filed(durable(_tabled(classes)))
    found = None
    while True:
        counts = filed.groupBy("key", "mask").agg(F.count(F.lit(1)).alias("n"))
        hot = durable(counts.where((F.col("n") > key_rows) & (64 - F.bit_count("mask") > _FEW_BITS)).select("key"))
        done = hot.isEmpty()
        part = _links(filed if done else filed.join(hot, "key", "left_anti"), max_bits, n)
        found = part if found is None else found.unionByName(part)
        if done:
            return found
        filed = durable(_filed(filed.join(hot, "key", "left_semi")))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, key_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``; see the module's notes."""
    with scratch(docs.sparkSession):
        fps = durable(fingerprints(docs, width, id_col, text_col), keep=True)
        classes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
        joined = connected_components(near_links(classes.where("rep IS NOT NULL"), max_bits, key_rows))
        labels = durable(classes.join(joined, classes.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), keep=True)
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 3, key_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None, gram: int = 5) -> DataFrame:
    """``docs`` with one row of every component (with ``jaccard``, rows whose sets of shingles of ``gram`` words are as
    near as that are linked too): the one with the smallest id (null last), then the smallest hash of
    its text. Of rows with equal id and text one stays, whichever their other columns are. Rows are told apart by 128
    bits of id and text."""
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    keyed = docs.withColumns({k1: F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), k2: F.xxhash64(F.lit(SEED), F.col(text_col), F.col(id_col).cast("long"))})
    rows = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        fps = durable(_fingerprinted(rows, width, gram if jaccard is not None else None))
        least = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "k1", "k2")
        classes = durable(fps.groupBy("fp").agg(F.min(least).alias("first")))
        links = near_links(classes.select("fp", F.col("fp").alias("rep")), max_bits, key_rows)
        if jaccard is None:
            joined = connected_components(links)
        else:
            joined = similar_components(fps, durable(links), rows.select("k1", "k2", "text"), gram, jaccard)
        group = classes.join(joined, classes.fp == joined.node, "left").select(F.coalesce("component", "fp").alias("group"), "first")
        stay = durable(group.groupBy("group").agg(F.min("first").alias("row")).select("row.k1", "row.k2"))
        # The rows to go are the fewer. Texts are shuffled to them once, by the same plan at every size.
        gone = durable(fps.select("k1", "k2").distinct().join(stay, ["k1", "k2"], "left_anti").toDF(k1, k2), keep=True)
        twice = durable(fps.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2").toDF(k1, k2), keep=True)
    kept = keyed.join(gone.hint("merge"), [k1, k2], "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, [k1, k2], "left_anti").unionByName(kept.join(twice, [k1, k2], "left_semi").dropDuplicates([k1, k2]))
    return kept.select(*docs.columns)


def _fingerprinted(rows: DataFrame, width: int, gram: int | None) -> DataFrame:
    """(doc_id, k1, k2, fp) of every row (doc_id, k1, k2, text); with ``gram`` the columns of ``SKETCH`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for at, to, d, o in chunks(data, offsets):
                fp = pa.array(fingerprints_of(*shingle_hashes(d, o, width)).view(np.int64))
                more = sketches(d, o, gram) if gram else []
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(3)), fp, *more], names)

    schema = "doc_id long, k1 long, k2 long, fp long" + (", " + SKETCH if gram else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, schema)
