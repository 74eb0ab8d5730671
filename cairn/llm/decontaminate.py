"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters and digits (any character beyond ASCII counts as a letter). A seed is a fixed
mask such as 1101001011: at each word position of a text, the words under the ones are hashed and the others ignored,
so a substituted word spoils only the seeds that look at it. Hashes of the test items join those of the texts; every
hit fixes an item, a text and a shift between them. Around the hits the item is laid on the text word by word, and
shifts within ``drift`` words of each other count together, so inserted or lost words are bridged as well. A pair is
reported when at least ``similarity`` of the item's words are found, or ``run_words`` of them in a row: a part of an
item that long is a leak too.

Work on the corpus is one pass without a shuffle: each task keeps only positions whose hash is in a bit table of the
items' hashes (fixed size, whatever the benchmark's), and returns the word hashes around them. Only these segments
are shuffled; a join and the verification decide, so the table's false hits cost time, not precision.

Nulls: null or empty texts and items without words never match; null ids, of items and of texts, are carried and count
as one id each in the report. Repeated ids or rows give one result row for each pair of ids; an item id with several
texts is found by any of them. Extra columns are ignored or, in ``decontaminate``, kept. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import durable, fresh, scratch, text_key
from ._text import NOT_WORD, U64, Polynomial, chunks, mix, utf8, words

#: Seeds of weight five. An item of 7 words or more with up to a fifth of them substituted keeps one seed at least,
#: wherever the substitutions are (tests enumerate them).
MASKS = ("1101011", "1100100101", "101100011", "11111", "110111")
#: Items of fewer words have masks of their own.
SHORT = 7


def masks_of(n: int, masks: tuple[str, ...], similarity: float) -> tuple[str, ...]:
    """The masks of an item of ``n`` words: short ones have every mask of their length that ignores as many words as
    ``similarity`` lets be substituted."""
    if n >= SHORT:
        return tuple(m for m in masks if len(m) <= n)
    zeros = combinations(range(n), int(n * (1 - similarity) + 1e-9))
    return tuple("".join("0" if i in z else "1" for i in range(n)) for z in zeros) if n else ()


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = words(data, offsets, NOT_WORD)
    return Polynomial(data).of(starts, ends), rows


def _seeds(tokens: np.ndarray, rows: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a mask over all rows' words."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = rows[:n] == rows[len(mask) - 1:]
    total = np.full(n, len(mask), U64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = mix(total + tokens[k: k + n])
    at = np.flatnonzero(inside)
    return total[at], at


def _bits(hashes: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> U64(64 - log2_bits), hashes & U64((1 << log2_bits) - 1)


def _item_words(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, words) of every row of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1), lower=True)
            tokens, rows = _word_hashes(data, offsets)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], ["item_id", "words"])

    return benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "item_id long, words array<long>")


def _item_seeds(items: DataFrame, masks: tuple[str, ...], similarity: float) -> DataFrame:
    """(h, iid, at): every seed of every item (iid, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, listed in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.asarray(listed.values).view(U64)
                for mask in masks_of(len(tokens), masks, similarity):
                    h, at = _seeds(tokens, np.zeros(len(tokens), np.int64), mask)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([item] * len(h), pa.int64()), pa.array(at.astype(np.int32))], ["h", "iid", "at"])

    return items.select("iid", "words").mapInArrow(run, "h long, iid long, at int")


def _segments(docs: DataFrame, masks: tuple[str, ...], table: np.ndarray, log2_bits: int, reach: int) -> DataFrame:
    """Word hashes around the positions whose seed may be an item's: (doc_id, k1, k2, start, words, hs, at) of texts
    (doc_id, k1, k2, text)."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        known = lambda x: bits[x >> U64(6)] >> (x & U64(63)) & U64(1) == 1
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(3)]
            data, offsets = utf8(batch.column(3), lower=True)
            for first, _, d, o in chunks(data, offsets):
                tokens, rows = _word_hashes(d, o)
                hs, ats = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
                for mask in masks:
                    h, at = _seeds(tokens, rows, mask)
                    a, b = _bits(h, log2_bits)
                    hit = np.flatnonzero(known(a))
                    hit = hit[known(b[hit])]
                    hs.append(h[hit])
                    ats.append(at[hit])
                at = np.concatenate(ats)
                order = np.argsort(at, kind="stable")
                at, h = at[order], np.concatenate(hs)[order]
                if not len(at):
                    continue
                new = np.flatnonzero(np.diff(at, prepend=-2 * reach) > reach) if reach else np.arange(len(at))
                new = np.union1d(new, np.flatnonzero(np.diff(rows[at], prepend=-1)))
                row_first = np.searchsorted(rows, np.arange(len(o)))
                out = {k: [] for k in ("doc_id", "k1", "k2", "start", "words", "hs", "at")}
                for a, b in zip(new, [*new[1:], len(at)]):
                    row = rows[at[a]]
                    lo, hi = max(row_first[row], at[a] - reach), min(row_first[row + 1], at[b - 1] + reach)
                    for k, column in zip(("doc_id", "k1", "k2"), ids):
                        out[k].append(column[first + row])
                    out["start"].append(lo - row_first[row])
                    out["words"].append(tokens[lo:hi].view(np.int64))
                    out["hs"].append(h[a:b].view(np.int64))
                    out["at"].append((at[a:b] - lo).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(out[k], pa.int64()) for k in ("doc_id", "k1", "k2", "start")), pa.array(out["words"], pa.list_(pa.int64())),
                     pa.array(out["hs"], pa.list_(pa.int64())), pa.array(out["at"], pa.list_(pa.int32()))], list(out),
                )

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, start long, words array<long>, hs array<long>, at array<int>")


def overlap(item: np.ndarray, text: np.ndarray, shifts: np.ndarray, drift: int) -> tuple[int, int, int]:
    """The most words of ``item`` that a group of near shifts finds in ``text``, where the first of them is, and how
    many of them are in a row in both."""
    best, longest = (0, 0), 0
    shifts = np.sort(shifts)
    for group in np.split(shifts, np.flatnonzero(np.diff(shifts) > drift) + 1):
        found, first = np.zeros(len(item), bool), len(text)
        for d in group:
            lo, hi = max(0, -d), min(len(item), len(text) - d)
            same = np.zeros(len(item), bool)
            same[lo:hi] = item[lo:hi] == text[lo + d: hi + d]
            ends = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            longest = max(longest, int((ends[1::2] - ends[::2]).max(initial=0)))
            if len(group) > 1:  # chance agreements of single words don't count for several shifts
                run = np.concatenate([[False], same, [False]])
                same &= run[:-2] | run[2:]
            if same.any():
                first = min(first, int(np.argmax(same)) + int(d))
            found |= same
        best = max(best, (int(found.sum()), -first))
    return best[0], -best[1], longest


_FOUND = "doc_id long, k1 long, k2 long, item_id long, n_words long, n_found long, similarity double, first_word long, longest_run long"


def _overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, similarity: float = 0.8, run_words: int = 13, drift: int = 8, log2_bits: int = 25,
              id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``_FOUND``: a place of a text that holds a test item. Items are told apart by a generated id, texts by
    the hashes k1 and k2 of their content; item_id and doc_id are carried, null or repeated ones too."""
    items = durable(_item_words(benchmark, item_col, item_text_col).distinct().withColumn("iid", F.monotonically_increasing_id()))
    seeds = durable(_item_seeds(items, masks, similarity))
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    lengths = sorted(r[0] for r in items.where(F.size("words").between(1, SHORT - 1)).select(F.size("words")).distinct().collect())
    all_masks = tuple(dict.fromkeys([*masks, *(m for n in lengths for m in masks_of(n, masks, similarity))]))
    # The bit table: at most 2^log2_bits / 64 words reach the driver, combined by OR in Spark.
    index = F.explode(F.array(F.shiftrightunsigned("h", 64 - log2_bits), F.col("h").bitwiseAND(F.lit((1 << log2_bits) - 1))))
    ored = seeds.select(index.alias("i")).groupBy(F.shiftrightunsigned("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).toPandas()
    table = np.zeros(1 << log2_bits - 6, U64)
    table[ored["w"].to_numpy(np.int64)] = ored["b"].to_numpy(np.int64).view(U64)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    segments = durable(_segments(texts, all_masks, table, log2_bits, int(longest) + drift).withColumn("sid", F.monotonically_increasing_id()))
    hits = segments.select("sid", F.explode(F.arrays_zip("hs", "at")).alias("x")).select("sid", F.col("x.hs").alias("h"), F.col("x.at").alias("pos")).join(seeds, "h")
    shifts = hits.select("sid", "iid", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    pairs = shifts.groupBy("sid", "iid").agg(F.collect_list("shift").alias("shifts"))
    laid = pairs.join(items.withColumnRenamed("words", "item_words"), "iid").join(segments.select("sid", "doc_id", "k1", "k2", "start", "words"), "sid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FOUND.split(", ")]
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            out = [overlap(np.asarray(c["item_words"][i].values), np.asarray(c["words"][i].values), np.asarray(c["shifts"][i].values), drift) for i in range(batch.num_rows)]
            n = [len(x) for x in c["item_words"]]
            found, first = [x[0] for x in out], [s + x[1] for s, x in zip(c["start"].to_pylist(), out)]
            share = pa.array([f / k for f, k in zip(found, n)], pa.float64())
            whole = [pa.array(x, pa.int64()) for x in (n, found)]
            yield pa.RecordBatch.from_arrays([*(c[k] for k in names[:4]), *whole, share, pa.array(first, pa.int64()), pa.array([x[2] for x in out], pa.int64())], names)

    return laid.mapInArrow(verify, _FOUND).where((F.col("similarity") >= similarity) | (F.col("longest_run") >= run_words))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_words, n_found, similarity, first_word, longest_run): texts that hold a test item, best place
    of each pair of ids; for the options see ``_overlaps``."""
    best = F.max_by(F.struct("n_words", "n_found", "similarity", "first_word", "longest_run"), F.struct("similarity", "longest_run", -F.col("first_word"), "n_words")).alias("b")
    with scratch(docs.sparkSession):
        return durable(_overlaps(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*"), keep=True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; columns and clean rows stay as they are, rows that share
    a null or repeated id with such a row too."""
    k1, k2 = fresh(docs, "bad_k1"), fresh(docs, "bad_k2")
    with scratch(docs.sparkSession):
        # Stored, so that its size is known: while it is small, Catalyst broadcasts it and the texts stay where they are.
        bad = durable(_overlaps(docs, benchmark, **options).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), keep=True)
    own = text_key(F.col(options.get("text_col", "text")))
    return docs.join(bad, (own[0] == F.col(k1)) & (own[1] == F.col(k2)), "left_anti")
