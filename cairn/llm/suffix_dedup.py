"""Exact removal of long repeated strings by merging shard Burrows-Wheeler transforms.

A string of ``length`` bytes that starts at two places of the corpus (the same document included) is repeated, and
every byte under it is removed. The work is dealt out so that equal strings always meet, and nowhere else:

1. Anchors. Every string of ``length`` bytes has an anchor, its leftmost ``length // 2``-gram of least hash. Equal
   strings have equal anchors. Consecutive starts with one anchor form a window, about 50 starts long. Anchors that
   occur once in the corpus are out: most text ends here.
2. Windows with repeated anchors are fetched from the texts and counted, so copies weigh as one row from here on.
3. Windows are dealt into buckets by anchor. A bucket's windows form shards; each shard has its suffixes sorted and so
   its Burrows-Wheeler order; the shards are merged by refining an interleave (which shard does the next suffix come
   from?) without sorting suffixes of different shards: a stable pass over the symbols in front of the suffixes, as in
   Holt and McMillan's merge, takes an interleave right for d bytes to one right for d + e bytes. Symbols are the
   blocks of equal e-byte prefixes, so 8, 16, 32, 64, 128 and ``length`` bytes take six passes. The block borders are
   where common prefixes end; a block of suffixes that are equal over ``length`` bytes is a repeated interval.
4. An anchor whose windows exceed ``cap_bytes`` is dealt again by narrower windows, all of whose strings share more
   bytes (the bucket is a hash of those), at last by the whole strings, of which each occurs once and its count
   tells. No row is dropped and no bucket grows with the corpus.
5. Repeated starts go back to their windows' places, and each document's removed bytes are the union of its spans.

Nulls: a null text is empty. Texts shorter than ``length`` bytes stay whole. Equal rows are copies of each other and
lose what they share, repeated or null ids included. Extra columns are kept or ignored. An empty table gives an empty
result. Texts are told apart by 128 bits of their content: equal texts are one text with a number of copies, combined
before any shuffle, so K equal rows cost K rows, not K^2, wherever they are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import durable, fresh, partitions, scratch, text_key
from ._text import U64, Polynomial, chunks, mix, utf8

#: Starts of one window at each level of splitting.
WIDTHS = (0, 25, 5, 1)
SHARD_BYTES = 64 << 10
_PIECE = 8 << 20


KEY = ("k1", "k2")


# ---- 1. anchors


def _windows_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first start in the row, starts, anchor's distance from the first start, anchor hash) of every window."""
    k = length // 2
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),)
    if len(data) < length:
        return none
    h = Polynomial(data).grams(k)
    n = len(data) - length + 1  # starts, those across rows included
    # Least hash, then place: 40 bits of one and 24 of the other, so that windows slide by minimum alone.
    low = (h >> U64(24) << U64(24)) | np.arange(len(h), dtype=U64)
    width, span = length - k + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n], low[width - span: width - span + n])
    place = (low & U64((1 << 24) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[1:][row]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & inside)
    bounds = np.flatnonzero(new | ~inside)
    following = np.append(bounds, n)[np.searchsorted(bounds, first, "right")]
    return row[first], first - offsets[row[first]], following - first, place[first] - first, h[place[first]]


def _all_windows(text: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The windows of all rows; a text beyond the piece size is worked on in pieces that share no start."""
    for first, to, data, o in chunks(text, offsets):
        if len(data) <= _PIECE:
            row, at, n, anchor, h = _windows_of(data, o, length)
            yield row + first, at, n, anchor, h
        else:
            for begin in range(0, len(data) - length + 1, _PIECE):
                piece = data[begin: begin + _PIECE + length - 1]
                row, at, n, anchor, h = _windows_of(piece, np.array([0, len(piece)]), length)
                yield row + first, at + begin, n, anchor, h


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """(m, k1, k2, at): the anchor hash, the text and the packed place of every window of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            for row, at, n, anchor, h in _all_windows(*utf8(batch.column(2)), length):
                packed = at << 24 | n << 12 | anchor
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), k1[row], k2[row], packed)], ["m", *KEY, "at"])

    return texts.select(*text_key(F.col("text")), "text").mapInArrow(run, "m long, k1 long, k2 long, at long")


# ---- 2. windows


def _places(batch: pa.RecordBatch, column: int, data_offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place, begin, end, the list's other fields) of every listed window of a batch."""
    listed = batch.column(column)
    cuts = np.asarray(listed.offsets).astype(np.int64)
    part = slice(cuts[0], cuts[-1])
    fields = {f.name: np.asarray(listed.values.field(f.name))[part] for f in listed.type.value_type}
    row = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
    begin = data_offsets[row] + (fields["at"] >> 24)
    end = np.minimum(begin + (fields["at"] >> 12 & 4095) + length - 1, data_offsets[row + 1])
    return row, begin, end, fields


def _hashed(shared: DataFrame, length: int) -> DataFrame:
    """(k1, k2, copies, at, g, h): every listed window of texts (k1, k2, copies, text, places array<struct<m, at>>), h a
    hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ends = utf8(batch.column(3))
            for first, to, data, offsets in chunks(text, ends):
                part = batch.slice(first, to - first)
                row, begin, end, fields = _places(part, 4, offsets, length)
                h = Polynomial(data).of(begin, end)
                own = [np.asarray(part.column(i))[row] for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, fields["at"], fields["m"], h.view(np.int64))], [*KEY, "copies", "at", "g", "h"])

    return shared.select(*KEY, "copies", "text", "places").mapInArrow(run, "k1 long, k2 long, copies long, at long, g long, h long")


def _fetched(rows: DataFrame, length: int) -> DataFrame:
    """(g, h, c, anchor, w): the bytes of the windows of texts (text, wanted array<struct<g, h, c, at>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            whole = data.tobytes()
            _, begin, end, fields = _places(batch, 1, offsets, length)
            for a in range(0, len(begin), 20_000):
                cut = slice(a, a + 20_000)
                w = pa.array([whole[x:y] for x, y in zip(begin[cut].tolist(), end[cut].tolist())], pa.binary())
                columns = [pa.array(fields[k][cut]) for k in ("g", "h", "c")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((fields["at"][cut] & 4095).astype(np.int32)), w], ["g", "h", "c", "anchor", "w"])

    return rows.select("text", "wanted").mapInArrow(run, "g long, h long, c long, anchor int, w binary")


# ---- 3. one bucket


def _blocks(sorted_keys: np.ndarray) -> np.ndarray:
    """The block number of each place of a sorted sequence."""
    new = np.empty(len(sorted_keys), bool)
    new[:1] = False
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.cumsum(new)


def _stable(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers below 2^32, by passes over 16 bits."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    if len(keys) and keys.max() >> 16:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _grams8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a circular text, as numbers in the order of bytes."""
    round_ = np.concatenate([text, np.resize(text, 7)])
    out = np.zeros(len(text), U64)
    for k in range(8):
        out = out << U64(8) | round_[k: k + len(text)].astype(U64)
    return out


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of one circular shard in the order of their first ``depth`` bytes or more."""
    n, d = len(text), 8
    order = np.argsort(_grams8(text), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _blocks(_grams8(text)[order])
    while d < depth and rank.max() < n - 1:
        pair = rank << 32 | np.roll(rank, -(d % n))
        order = np.argsort(pair, kind="stable")
        rank[order] = _blocks(pair[order])
        d *= 2
    return order


def merge_shards(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the suffixes of all (circular) shards by their first ``length`` bytes, as places, and how far
    each one's common prefix with the one before it reached (one of the depths of the passes; ``length`` at most).

    ``source`` is the interleave: the shard of each suffix of the merged order. Suffixes are taken from the shards'
    own orders as it says; only its refinement moves them.
    """
    sizes = np.array([len(s) for s in shards])
    base = np.cumsum(sizes) - sizes
    orders, grams = [shard_order(s, length) for s in shards], [_grams8(s) for s in shards]
    own = np.concatenate([o + b for o, b in zip(orders, base)])
    source = np.repeat(np.arange(len(shards)), sizes)
    start, size = np.repeat(base, sizes), np.repeat(sizes, sizes)
    n = int(sizes.sum())
    # The alphabet of the first pass: each shard's own order has its 8-byte symbols sorted, so only distinct ones are merged.
    alphabet = np.unique(np.concatenate([_distinct(g[o]) for g, o in zip(grams, orders)]))
    block = np.concatenate([np.searchsorted(alphabet, g) for g in grams])  # of 8 bytes, by place
    common = np.zeros(n, np.int64)
    depth, order, held = 0, own, np.zeros(n, np.int64)  # held: the block at ``depth`` of each merged suffix
    while depth < length:
        step = 8 if depth == 0 else min(depth, length - depth)
        front = start[order] + (order - start[order] - step) % size[order]  # the suffix ``step`` bytes before
        symbol = block[front]
        turn = _stable(symbol)
        source = source[turn]
        # Equal first blocks, and what follows in equal blocks: equal over depth + step.
        moved, symbol = held[turn], symbol[turn]
        new = np.empty(n, bool)
        new[:1] = True
        new[1:] = (symbol[1:] != symbol[:-1]) | (moved[1:] != moved[:-1])
        held = np.cumsum(new) - 1
        slot = np.argsort(source.astype(np.uint16) if len(shards) < 1 << 16 else source, kind="stable")
        order = np.empty(n, np.int64)
        order[slot] = own  # the next suffix of the shard that the interleave names
        block = np.empty(n, np.int64)
        block[order] = held
        depth += step
        common[~new] = depth  # refining moves suffixes within blocks only, so borders stay where they are
    return order, common


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def repeated_starts(windows: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct window the starts whose ``length`` bytes occur more than once, as [from, to, from, to, ...]."""
    shards, held, fill = [], [], 0
    for w in windows:
        held.append(w)
        fill += len(w)
        if fill >= SHARD_BYTES:
            shards.append(np.frombuffer(b"".join(held), np.uint8))
            held, fill = [], 0
    if held:
        shards.append(np.frombuffer(b"".join(held), np.uint8))
    order, common = merge_shards(shards, length)
    block = np.empty(len(order), np.int64)
    block[order] = np.cumsum(common < length)  # a repeated interval has common prefixes of ``length``
    size = np.array([len(w) for w in windows])
    starts = size - length + 1
    valid = np.repeat(np.cumsum(size) - size, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    weight = np.bincount(block[valid], np.repeat(np.minimum(counts, 2), starts), minlength=len(block) + 1)
    again = weight[block[valid]] >= 2
    return [_runs(x) for x in np.split(again, np.cumsum(starts)[:-1])]


def _runs(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).astype(np.int32)


# ---- 4. dealing


def _split(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Windows (sid, w, anchor, c) as narrower ones of ``width`` starts at fixed distances from the anchor:
    (sid, off, g, w, anchor, c), g a hash of the bytes that all strings of such a window share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("sid", "off", "w", "anchor", "c", "shared")}
            for sid, w, anchor, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                begin = 0
                while begin + length <= len(w):
                    part = (anchor - begin) // width  # the starts whose distance to the anchor falls in it
                    end = min(anchor - part * width + 1, len(w) - length + 1)
                    # Every string of this distance range holds these bytes, whatever of the range is here.
                    lo, hi = anchor - part * width, anchor - part * width - width + 1 + length
                    out["sid"].append(sid)
                    out["off"].append(begin)
                    out["w"].append(w[begin: end + length - 1])
                    out["anchor"].append(anchor - begin)
                    out["c"].append(c)
                    out["shared"].append(b"%d:" % part + w[lo:hi])
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["sid"], pa.int64()), pa.array(out["off"], pa.int32()), pa.array(out["w"], pa.binary()),
                 pa.array(out["anchor"], pa.int32()), pa.array(out["c"], pa.int64()), pa.array(out["shared"], pa.binary())], list(out),
            )

    cut = rows.select("sid", "w", "anchor", "c").mapInArrow(run, "sid long, off int, w binary, anchor int, c long, shared binary")
    return cut.select("sid", "off", F.xxhash64("shared").alias("g"), "w", "anchor", "c")


def _merged(rows: DataFrame, length: int, bucket_bytes: int) -> DataFrame:
    """(sid, spans) of the windows (sid, g, w, c) that have repeated starts."""

    def run(table: pa.Table) -> pa.Table:
        spans = repeated_starts(table.column("w").to_pylist(), np.asarray(table.column("c")), length)
        keep = [i for i, x in enumerate(spans) if len(x)]
        return pa.table({"sid": table.column("sid").take(pa.array(keep, pa.int64())), "spans": pa.array([spans[i] for i in keep], pa.list_(pa.int32()))})

    total = rows.agg(F.sum(F.length("w"))).first()[0] or 0
    buckets = int(total // bucket_bytes) + 1
    dealt = rows.select("sid", "w", "c", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
    # A task takes about four buckets, whatever the corpus; beyond 64 tasks a partition it takes more of them.
    tasks = min(buckets // 4 + 1, 64 * partitions(rows))
    return dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, "sid long, spans array<int>")


def _resolve(distinct: DataFrame, length: int, level: int, bucket_bytes: int, cap_bytes: int) -> DataFrame:
    """``distinct``: a stored table of distinct windows (sid, g, w, c, anchor). Returns (sid, spans)."""
    groups = distinct.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("w")).alias("bytes"))
    hot = durable(groups.where((F.col("n") > 1) & (F.col("bytes") > cap_bytes)).select("g")) if level + 1 < len(WIDTHS) else None
    if hot is None or hot.isEmpty():
        return durable(_merged(distinct, length, bucket_bytes))
    found = _merged(distinct.join(hot, "g", "left_anti"), length, bucket_bytes)
    narrow = durable(_split(distinct.join(hot, "g", "left_semi"), WIDTHS[level + 1], length).withColumn("h", F.xxhash64("w")))
    fewer = narrow.groupBy("g", "h", "w").agg(F.sum("c").alias("c"), F.max("anchor").alias("anchor"))
    fewer = durable(fewer.withColumn("sid", F.monotonically_increasing_id()))
    below = _resolve(fewer, length, level + 1, bucket_bytes, cap_bytes).join(fewer.select("sid", "g", "h"), "sid").select("g", "h", "spans")
    moved = narrow.select("sid", "off", "g", "h").join(below, ["g", "h"]).select("sid", F.transform("spans", lambda x: x + F.col("off")).alias("spans"))
    return durable(found.unionByName(moved))


def repeated_spans(docs: DataFrame, length: int = 200, bucket_bytes: int = 256 << 10, cap_bytes: int = 512 << 10, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts that share an anchor, (k1, k2, text), and their repeated starts, (k1, k2, spans array<struct<b, e>>):
    byte ranges to remove, unordered and overlapping. ``k1, k2`` are hashes of the text."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)
    with scratch(docs.sparkSession):
        return _repeated_spans(texts, length, bucket_bytes, cap_bytes)


def _repeated_spans(texts: DataFrame, length: int, bucket_bytes: int, cap_bytes: int) -> tuple[DataFrame, DataFrame]:
    anchors = _anchors(texts, length)
    # Stored, so that the join below reads both its sides from shuffles, which adaptive execution can split by rows.
    again = durable(anchors.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m"))
    listed = anchors.join(again, "m").groupBy(*KEY).agg(F.collect_set(F.struct("m", "at")).alias("places"))
    # Copies are combined in the tasks that read them: of a text a third of all rows have, each task sends one.
    contents = texts.select(*text_key(F.col("text")), "text").groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    shared = durable(contents.join(listed, [*KEY]), keep=True)
    # Windows are told apart by 128 bits, anchor and content; their bytes are read where an anchor has several.
    counted = durable(_hashed(shared, length).groupBy("g", "h").agg(F.sum("copies").alias("c"), F.min(F.struct(*KEY, "at")).alias("first")))
    several = durable(counted.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"))
    wanted = counted.join(several, "g").groupBy("first.k1", "first.k2").agg(F.collect_list(F.struct("g", "h", "c", F.col("first.at").alias("at"))).alias("wanted"))
    distinct = durable(_fetched(shared.select(*KEY, "text").join(wanted, [*KEY]), length).withColumn("sid", F.monotonically_increasing_id()))
    found = _resolve(distinct, length, 0, bucket_bytes, cap_bytes)
    found = found.join(distinct.select("sid", "g", "h"), "sid").select("g", "h", "spans")
    # An anchor with one window only: it occurs more than once as a whole.
    alone = counted.join(several, "g", "left_anti").where("c > 1")
    whole = alone.select("g", "h", F.array(F.lit(0), F.shiftright("first.at", 12).bitwiseAND(F.lit(4095)).cast("int")).alias("spans"))
    at = _hashed(shared, length).join(durable(found.unionByName(whole)), ["g", "h"])
    start = F.shiftright("at", 24)
    pairs = F.expr("transform(sequence(0, size(spans) - 1, 2), i -> struct(spans[i] as b, spans[i + 1] as e))")
    ranges = at.select(*KEY, start.alias("s"), pairs.alias("p"))
    span = F.transform("p", lambda x: F.struct((F.col("s") + x["b"]).alias("b"), (F.col("s") + x["e"] + (length - 1)).alias("e")))
    return shared.select(*KEY, "text"), durable(ranges.groupBy(*KEY).agg(F.flatten(F.collect_list(span)).alias("spans")), keep=True)


def _union(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i in np.argsort(begin, kind="stable"):
        if out and begin[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(end[i]))
        else:
            out.append([int(begin[i]), int(end[i])])
    return [(a, b) for a, b in out]


def _cut(shared: DataFrame, spans: DataFrame, result) -> DataFrame:
    """(k1, k2, kept, n_removed, n_spans) of the texts with repeated starts; kept is result(kept bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed, rows = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                raw = texts[i].as_py().encode()
                flat = listed[i].values
                runs = _union(np.asarray(flat.field("b")), np.asarray(flat.field("e")))
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(b for b, _ in runs), len(raw)]))
                rows.append((result(kept), sum(b - a for a, b in runs), len(runs)))
            kept, removed, n = zip(*rows) if rows else ((), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "kept", "n_removed", "n_spans"])

    return shared.join(spans, [*KEY]).select(*KEY, "text", "spans").mapInArrow(run, "k1 long, k2 long, kept string, n_removed long, n_spans long")


def digests(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row. Only texts that share an anchor are moved."""
    cut = _cut(*repeated_spans(docs, length, text_col=text_col, **options), lambda kept: hashlib.sha256(kept).hexdigest())
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(F.col(text_col)), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return rows.join(cut, [*KEY], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")
    )


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text_col``; a character that was cut apart goes as a whole."""
    cut = _cut(*repeated_spans(docs, length, text_col=text_col, **options), lambda kept: kept.decode("utf-8", "ignore"))
    names = {n: fresh(docs, n) for n in (*KEY, "kept")}
    cut = cut.select(*[F.col(n).alias(to) for n, to in names.items()])
    own = text_key(F.col(text_col))
    joined = docs.join(cut, (own[0] == F.col(names["k1"])) & (own[1] == F.col(names["k2"])), "left")
    return joined.withColumn(text_col, F.coalesce(names["kept"], text_col)).select(*docs.columns)
