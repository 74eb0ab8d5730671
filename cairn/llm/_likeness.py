"""Components of texts whose sets of word shingles have a Jaccard coefficient of a given size or more.

Long fingerprints (the least of a text's shingle hashes under each of 120 factors) meet under 24 bands of five. Work
under a band is bound by components, not by pairs:

1. Two rounds of stars: in every band whose rows are of several components, one row is the reference of the others.
   These pairs, one for each row and band at most, are tested, and components that a pair joins are one from then on.
   A large group of near copies is one component after this.
2. Rows under one band that are still of different components get sketches of 512 bytes from their whole texts and are
   compared in the task by size and sketch, each pair under its first common band; what may be near enough is tested.
   A band with more than ``BAND_ROWS`` such rows is dealt into cells, one for each pair of its blocks, so that no task
   takes more than two blocks and every pair meets once.

Tests are exact: the sets themselves are read from the whole texts. Two sets at 0.8 share no band with a probability
of 6e-5 (by calculation), sketches leave out a pair at the threshold with one of 3e-5. Unlike rows that share most of
their shingles cost a comparison for each pair: a passage that makes up less than 0.8 of very many texts, but much of
them, is where time grows faster than the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.graph import connected_components

from ._store import durable, partitions
from ._text import IS_SPACE, LOWER, U64, Polynomial, chunks, mix, utf8, words

BANDS, BAND_WIDTH = 24, 5
#: Rows of one block of a band.
BAND_ROWS = 2048
STAR_ROUNDS = 2
_FACTORS = mix(np.arange(1, BANDS * BAND_WIDTH + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_STEPS = mix(np.arange(1, 65, dtype=U64) * U64(0x9E6C63D0876A9A35))
#: Bytes of the sketches that rows get which stars did not settle.
LONG = 512
_LONG_FACTORS = mix(np.arange(1, LONG + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def _least_share(jaccard: float, size: int) -> float:
    """The share of equal bytes from which pairs are tested: four standard deviations below the threshold."""
    return jaccard - 4 * (jaccard * (1 - jaccard) / size) ** 0.5


def gram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every row of a buffer in order, and their number in each row. A row with fewer
    words than ``width`` has one shingle of all of them."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, rows = words(low, offsets, IS_SPACE)
    counts = np.bincount(rows, minlength=n)
    word = Polynomial(low).of(starts, ends)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(n), shingles)
    first = (np.cumsum(counts) - counts)[row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    size = np.minimum(width, counts)[row]
    found = size.astype(U64)
    for j in range(width):
        inside = size > j
        found[inside] = mix(found[inside] * _STEPS[63] + mix(word[first[inside] + j] ^ _STEPS[j % 63]))
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.bincount(row[new], minlength=n)


#: What ``sketches`` gives for each row.
SKETCH = "set long, set_too long, n long, bands array<long>, sketch binary"


def sketches(data: np.ndarray, offsets: np.ndarray, width: int) -> list[pa.Array]:
    """Columns of ``SKETCH`` of a buffer's rows: two hashes of the set of shingles, its size, the bands' keys and a
    byte of each least hash. A row without words has size 0."""
    grams, n = gram_sets(data, offsets, width)
    full = np.flatnonzero(n)
    whole, least = np.zeros((2, len(n)), U64), np.zeros((len(n), BANDS * BAND_WIDTH), U64)
    if len(full):
        begin = (np.cumsum(n) - n)[full]
        for k in (0, 1):
            whole[k, full] = mix(np.add.reduceat(mix(grams * _STEPS[k]), begin) + n[full].astype(U64))
        for k, factor in enumerate(_FACTORS):
            least[full, k] = np.minimum.reduceat(grams * factor, begin)
    bands = np.zeros((len(n), BANDS), U64)
    for b in range(BANDS):
        bands[:, b] = _STEPS[b]
        for k in range(b * BAND_WIDTH, (b + 1) * BAND_WIDTH):
            bands[:, b] = mix(bands[:, b] * _STEPS[63] ^ least[:, k])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
    sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(least.shape[1]), len(n), [None, pa.py_buffer((mix(least) & U64(255)).astype(np.uint8).tobytes())])
    return [*(pa.array(x.view(np.int64)) for x in whole), pa.array(n.astype(np.int64)), lists, sketch.cast(pa.binary())]


def _grams(texts: DataFrame, gram: int) -> DataFrame:
    """(sid, grams): the shingle set of every row (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for at, to, d, o in chunks(data, offsets):
                grams, n = gram_sets(d, o, gram)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], ["sid", "grams"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, grams array<long>")


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _close(pairs: DataFrame, jaccard: float) -> DataFrame:
    """Of pairs (a, b, ca, cb, sa, sb) those whose sketches sa and sb may be as near as ``jaccard``: (a, b, ca, cb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_bytes(batch.column(4)) == _bytes(batch.column(5))).mean(axis=1) >= _least_share(jaccard, BANDS * BAND_WIDTH)
                yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(near))

    return pairs.select("a", "b", "ca", "cb", "sa", "sb").mapInArrow(run, "a long, b long, ca long, cb long")


def _tested(pairs: DataFrame, texts: DataFrame, gram: int, jaccard: float) -> DataFrame:
    """Links (a, b) of the components of those pairs (a, b, ca, cb: rows and their components) that are as near as
    ``jaccard``, by the sets of the whole texts."""
    needed = durable(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    found = durable(_grams(texts.join(needed, "sid", "left_semi"), gram))
    left, right = (found.select(F.col("sid").alias(k), F.col("grams").alias(f"g{k}")) for k in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    near = pairs.join(left, "a").join(right, "b").where(both >= jaccard * (F.size("ga") + F.size("gb") - both) - 1e-9)
    return durable(near.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())


def _sizes_fit(n, m, jaccard: float):
    return F.least(n, m) >= jaccard * F.greatest(n, m) - 1e-9


def _stars(touched: DataFrame, sets: DataFrame, texts: DataFrame, gram: int, jaccard: float) -> DataFrame:
    """Links of components between each row of ``touched`` (band, sid, comp, n, turn, first) and its band's reference,
    the row whose turn is the first."""
    centre = touched.where("turn = first").groupBy("band").agg(F.min("sid").alias("csid"))
    centre = durable(centre.join(touched.where("turn = first").select("band", F.col("sid").alias("csid"), F.col("comp").alias("ccomp"), F.col("n").alias("cn")), ["band", "csid"]))
    met = touched.join(centre, "band").where((F.col("comp") != F.col("ccomp")) & _sizes_fit(F.col("n"), F.col("cn"), jaccard))
    swap = F.col("sid") > F.col("csid")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = met.select(either("sid", "csid").alias("a"), either("csid", "sid").alias("b"), either("comp", "ccomp").alias("ca"), either("ccomp", "comp").alias("cb")).distinct()
    sa, sb = (sets.select(F.col("sid").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab")
    return _tested(durable(_close(durable(pairs).join(sa, "a").join(sb, "b"), jaccard)), texts, gram, jaccard)


def _long_sketches(texts: DataFrame, gram: int) -> DataFrame:
    """(sid, long): a byte of each of ``LONG`` least hashes of every row (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for at, to, d, o in chunks(data, offsets):
                grams, n = gram_sets(d, o, gram)
                out, full = np.zeros((len(n), LONG), np.uint8), np.flatnonzero(n)
                if len(full):
                    begin = (np.cumsum(n) - n)[full]
                    for k, factor in enumerate(_LONG_FACTORS):
                        out[full, k] = mix(np.minimum.reduceat(grams * factor, begin)) & U64(255)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([r.tobytes() for r in out], pa.binary())], ["sid", "long"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, long binary")


def _in_cells(touched: DataFrame, sets: DataFrame, texts: DataFrame, gram: int, jaccard: float) -> DataFrame:
    """Pairs (a, b, ca, cb) of rows of different components under one band that may be as near as ``jaccard``."""
    longer = durable(_long_sketches(texts.join(durable(touched.select("sid").distinct()), "sid", "left_semi"), gram))
    blocks = touched.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BAND_ROWS).cast("int").alias("blocks"))
    rows = touched.join(durable(blocks), "band").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(F.col("block"), j) * F.col("blocks") + F.greatest(F.col("block"), j))
    rows = rows.select("band", F.explode(others).alias("cell"), "blocks", "block", "sid", "comp", "n").join(longer, "sid").join(sets.select("sid", "bands"), "sid")
    least = _least_share(jaccard, LONG)

    def pairs(band, cell, blocks, block, sid, comp, n, same, bands):
        within = cell // blocks == cell % blocks  # a cell of one block; others pair rows of two
        active, shift = np.arange(len(band)), 1
        while len(active):
            active = active[active + shift < len(band)]
            active = active[(band[active] == band[active + shift]) & (cell[active] == cell[active + shift])]
            for part in np.array_split(active, max(1, len(active) // 20_000)):
                a, b = part, part + shift
                fit = (comp[a] != comp[b]) & (within[a] | (block[a] != block[b])) & (np.minimum(n[a], n[b]) >= jaccard * np.maximum(n[a], n[b]) - 1e-9)
                a, b = a[fit], b[fit]
                fit = (same[a] == same[b]).mean(axis=1) >= least
                a, b = a[fit], b[fit]
                common = bands[a] == bands[b]
                first = bands[a, common.argmax(axis=1)] == band[a]
                a, b = a[first], b[first]
                if len(a):
                    low, high = np.where(sid[a] < sid[b], a, b), np.where(sid[a] < sid[b], b, a)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sid[low], sid[high], comp[low], comp[high])], ["a", "b", "ca", "cb"])
            shift += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [np.asarray(batch.column(i)) for i in range(7)] + [_bytes(batch.column(7)), batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])  # the last cell may go on
            whole = int(np.argmax(last))
            if whole:
                yield from pairs(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None:
            yield from pairs(*held)

    dealt = rows.select("band", "cell", "blocks", "block", "sid", "comp", "n", "long", "bands").repartition(partitions(sets), "band", "cell").sortWithinPartitions("band", "cell")
    return dealt.mapInArrow(run, "a long, b long, ca long, cb long")


def similar_components(rows: DataFrame, known: DataFrame, texts: DataFrame, gram: int, jaccard: float) -> DataFrame:
    """(node, component) over fingerprints: what the links ``known`` (a, b) and all pairs of ``rows`` at ``jaccard`` or
    more join. ``rows``: stored (fp, k1, k2) and ``SKETCH``; ``texts``: (k1, k2, text). Equal sets are one row.
    Call it in a scratch scope."""
    full = rows.where("n > 0")
    held = durable(full.select("set", "set_too", "fp").distinct())
    several = durable(held.groupBy("set", "set_too").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").select("set", "set_too", "a"))
    joined = connected_components(known.unionByName(held.join(several, ["set", "set_too"]).select("a", F.col("fp").alias("b"))))
    links = joined.select(F.col("component").alias("a"), F.col("node").alias("b"))
    sets = full.dropDuplicates(["set", "set_too"]).select("fp", "k1", "k2", "n", "bands", "sketch")
    sets = durable(sets.withColumn("sid", F.monotonically_increasing_id()))
    touched = sets.join(joined, sets.fp == joined.node, "left").select("sid", "n", F.coalesce("component", "fp").alias("comp"), F.explode("bands").alias("band"))
    for turn in range(STAR_ROUNDS + 1):
        touched = touched.withColumn("turn", F.xxhash64("sid", F.lit(turn)))
        met = touched.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("turn").alias("first")).where("lo <> hi")
        touched = durable(touched.join(durable(met.select("band", "first")), "band"))
        if not turn:  # all that is compared from here on: these texts are fetched once, by one plan at every size
            keys = durable(sets.join(touched.select("sid").distinct(), "sid", "left_semi").select("sid", "k1", "k2"))
            texts = durable(texts.dropDuplicates(["k1", "k2"]).join(keys.hint("merge"), ["k1", "k2"]).select("sid", "text"))
        if turn < STAR_ROUNDS:
            new = _stars(touched, sets, texts, gram, jaccard)
            moved = connected_components(new)
            touched = touched.drop("turn", "first").join(moved, touched.comp == moved.node, "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component")
        else:
            new = _tested(durable(_in_cells(touched, sets, texts, gram, jaccard)), texts, gram, jaccard)
        links = links.unionByName(new)
    return connected_components(links)
