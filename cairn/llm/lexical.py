"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners, by the share of the documents that hold them, rarest first; an owner holds the postings of
its terms. Items travel in bundles: a bundle visits the owners one after another and carries what its items have gained
so far, a sparse accumulator of (item, document) -> score; at each owner the two are brought together by a cogroup, and
the owner adds the contributions of its terms, integers whose sum does not depend on the order. After the last owner
the best of each accumulator leave it, and the best of all are selected.

Documents are cut into blocks of ``BLOCK`` where they are read, and postings and accumulators are kept for each block,
so a term that every document holds is as many short lists as there are blocks, and an accumulator has at most
``BUNDLE`` x ``BLOCK`` entries whatever the corpus. The texts are read once and are not shuffled: a task keeps
the postings whose term may be an item's (a bit table of fixed size tells), by 64-bit hashes of the terms; the
join with the items' terms decides. Two terms count as one only if 64 bits of hash agree.

Scores: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its contribution w ((10^9 tf) div (1000 tf + 20 m))
with m = 50 + (50 n N) div L, where N counts documents with a term, L their terms and n one document's terms.

Nulls: null or empty texts have no terms; they match nothing and don't count in N. Rows of equal item id, null too, are
one item with the terms of all. Documents with a null or repeated id are ranked each, null after all others among equal scores.
Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import durable, scratch
from ._text import LOWER, NOT_WORD, U64, Polynomial, chunks, utf8, words

#: Documents of a block; items of a bundle.
BLOCK, BUNDLE = 2048, 64
#: Owners hold the terms that at most one in so many documents has; the last one holds the rest.
OWNERS = (64, 8)
_LOG2_BITS = 25


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of the terms, their rows) of runs of rows."""
    data, offsets = utf8(column)
    for first, to, d, o in chunks(data, offsets):
        d = LOWER[d]
        starts, ends, rows = words(d, o, NOT_WORD)
        yield first, to, Polynomial(d).of(starts, ends), rows


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) of every distinct term of an item, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, hashes, rows in _terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + rows)), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term long").distinct()


def _bit_table(terms: DataFrame) -> np.ndarray:
    """2^25 bits of which each term sets one; they are combined in Spark, by words of 64."""
    at = F.shiftrightunsigned("term", 64 - _LOG2_BITS)
    ored = terms.select(at.alias("i")).groupBy(F.shiftrightunsigned("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).toPandas()
    table = np.zeros(1 << _LOG2_BITS - 6, U64)
    table[ored["w"].to_numpy(np.int64)] = ored["b"].to_numpy(np.int64).view(U64)
    return table


_POSTINGS = "block long, term long, n int, docs binary, tfs binary, sizes binary"


def postings(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of each block: places of documents in the block (two bytes each), occurrences and the documents'
    terms (four bytes each). The row without a term lists all documents of the block: ids (eight bytes) and terms.

    Places ascend with the ids, null last.
    """
    held = docs.sparkSession.sparkContext.broadcast(table)

    def block(number: int, ids: list, sizes: list[np.ndarray], hashes: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        n = np.concatenate(sizes).astype(np.int32)
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        h, d = np.concatenate(hashes), place[np.concatenate(owners)]
        by = np.lexsort((d, h))
        h, d = h[by], d[by]
        new = np.flatnonzero(np.diff(h, prepend=~h[:1]).astype(bool) | (np.diff(d, prepend=-1) != 0)) if len(h) else np.zeros(0, np.int64)
        tf = np.diff(np.append(new, len(h))).astype(np.int32)
        h, d = h[new], d[new]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, np.int64)
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(h)]))
        size, at = n[order], d.astype(np.uint16)
        listed = np.array([ids[k] if ids[k] is not None else 0 for k in order], np.int64)
        absent = np.array([ids[k] is None for k in order], np.uint8)
        columns = [
            [number] * (1 + len(cuts)), [None, *h[first].view(np.int64).tolist()], [len(ids), *(b - a for a, b in cuts)],
            [listed.tobytes(), *(at[a:b].tobytes() for a, b in cuts)], [absent.tobytes(), *(tf[a:b].tobytes() for a, b in cuts)], [size.tobytes(), *(size[d[a:b]].tobytes() for a, b in cuts)],
        ]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _POSTINGS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        ids, sizes, hashes, owners = [], [], [], []
        for batch in batches:
            all_ids = batch.column(0).to_pylist()
            for first, to, found, rows in _terms(batch.column(1)):
                counts = np.bincount(rows, minlength=to - first)
                at = found >> U64(64 - _LOG2_BITS)
                asked = np.flatnonzero(bits[at >> U64(6)] >> (at & U64(63)) & U64(1) == 1)
                cut = 0
                while cut < to - first:
                    end = min(to - first, cut + BLOCK - len(ids))
                    here = asked[np.searchsorted(rows[asked], cut): np.searchsorted(rows[asked], end)]
                    hashes.append(found[here])
                    owners.append(rows[here] - cut + len(ids))
                    sizes.append(counts[cut:end])
                    ids += all_ids[first + cut: first + end]
                    cut = end
                    if len(ids) == BLOCK:
                        yield block(next(numbers), ids, sizes, hashes, owners)
                        ids, sizes, hashes, owners = [], [], [], []
        if ids:
            yield block(next(numbers), ids, sizes, hashes, owners)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _POSTINGS)


def _numbers(data: Column | None, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind)


_BUNDLES = "block long, bundle long, cells binary, scores binary"


def _visit(carried: DataFrame | None, owned: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The accumulators (block, bundle, cells, scores) after an owner: what is carried to it and what its postings add.

    A cell is slot of the item in its bundle x BLOCK + place of the document in its block.
    """

    def add(have: pa.Table | None, rows: pa.Table) -> pa.Table:
        total = np.zeros(BUNDLE * BLOCK, np.int64)
        for cells, scores in zip(have["cells"].to_pylist(), have["scores"].to_pylist()) if have is not None else ():
            total[_numbers(cells, "<i4")] = _numbers(scores, "<i8")
        for weight, slots, docs, tfs, sizes in zip(*(rows[k].to_pylist() for k in ("weight", "slots", "docs", "tfs", "sizes"))):
            tf, n = _numbers(tfs, "<i4").astype(np.int64), _numbers(sizes, "<i4").astype(np.int64)
            gain = weight * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * n * n_docs // n_terms)))
            at = _numbers(docs, "<u2").astype(np.int64)
            for slot in slots:
                total[slot * BLOCK + at] += gain
        cells = np.flatnonzero(total)
        key = have if have is not None and have.num_rows else rows
        out = [key["block"][:1].combine_chunks(), key["bundle"][:1].combine_chunks(), pa.array([cells.astype("<i4").tobytes()]), pa.array([total[cells].astype("<i8").tobytes()])]
        return pa.table(out, names=[x.split()[0] for x in _BUNDLES.split(", ")])

    if carried is None:
        return owned.groupBy("block", "bundle").applyInArrow(lambda rows: add(None, rows), _BUNDLES)
    return carried.groupBy("block", "bundle").cogroup(owned.groupBy("block", "bundle")).applyInArrow(add, _BUNDLES)


def _best(accumulators: DataFrame, top: int) -> DataFrame:
    """(block, bundle, slot, place, score): the best of each item in each accumulator, ties by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells, scores = _numbers(batch["cells"][k].as_py(), "<i4").astype(np.int64), _numbers(batch["scores"][k].as_py(), "<i8")
                slots = cells // BLOCK
                order = np.lexsort((cells, -scores, slots))
                begins = np.searchsorted(slots[order], slots[order])
                keep = order[np.arange(len(order)) - begins < top]
                head = [pa.array([batch[name][k].as_py()] * len(keep), pa.int64()) for name in ("block", "bundle")]
                yield pa.RecordBatch.from_arrays([*head, pa.array(slots[keep]), pa.array(cells[keep] % BLOCK), pa.array(scores[keep])], ["block", "bundle", "slot", "place", "score"])

    return accumulators.mapInArrow(run, "block long, bundle long, slot long, place long, score long")


def _documents(blocks: DataFrame) -> DataFrame:
    """(block, place, doc_id) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = _numbers(batch["docs"][k].as_py(), "<i8")
                absent = _numbers(batch["tfs"][k].as_py(), np.uint8).astype(bool)
                block = pa.array(np.full(len(ids), batch["block"][k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([block, pa.array(np.arange(len(ids))), pa.array(ids, mask=absent)], ["block", "place", "doc_id"])

    return blocks.select("block", "docs", "tfs").mapInArrow(run, "block long, place long, doc_id long")


def _sizes(blocks: DataFrame) -> DataFrame:
    """(docs, terms): of each block, how many documents have a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_numbers(x.as_py(), "<i4") for x in batch["sizes"]]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in sizes], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in sizes], pa.int64())], ["docs", "terms"])

    return blocks.select("sizes").mapInArrow(run, "docs long, terms long")


def ranking(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal scores by id."""
    with scratch(docs.sparkSession):
        asked = durable(item_terms(items, item_col, item_text_col))
        index = durable(postings(docs, _bit_table(asked), id_col, text_col))
        blocks, lists = index.where("term IS NULL"), index.where("term IS NOT NULL")
        n_docs, n_terms = (x or 0 for x in _sizes(blocks).agg(F.sum("docs"), F.sum("terms")).first())
        # Items are dealt to bundles by a number; equal ids, null too, have one.
        numbered = durable(asked.select("item_id").distinct().withColumn("spread", F.xxhash64("item_id")))
        numbered = _numbered(numbered)
        held = asked.join(numbered, asked["item_id"].eqNullSafe(numbered["item_id"])).select("term", "bundle", "slot")
        df = lists.groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
        owner = sum((F.col("df") * share > n_docs).cast("int") for share in OWNERS)
        terms = df.join(held, "term").groupBy("term", "bundle").agg(F.first("df").alias("df"), F.array_sort(F.collect_list("slot")).alias("slots"))
        terms = durable(terms.select("term", "bundle", "slots", weight.alias("weight"), owner.alias("owner")))
        owned = durable(lists.join(terms, "term").select("owner", "block", "bundle", "weight", "slots", "docs", "tfs", "sizes"))
        carried = None
        for k in range(len(OWNERS) + 1):
            carried = _visit(carried, owned.where(F.col("owner") == k).drop("owner"), n_docs, max(1, n_terms))
        best = _best(carried, top).join(_documents(blocks), ["block", "place"])
        order = Window.partitionBy("bundle", "slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = ranked.join(numbered, ["bundle", "slot"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        return durable(out, keep=True)


def _numbered(items: DataFrame) -> DataFrame:
    """(item_id, bundle, slot): ids are dealt by range of a hash and numbered within their ranges; no bundle has more
    than ``BUNDLE`` items."""
    part = durable(items.repartitionByRange("spread", "item_id").withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("part").orderBy("spread", "item_id")) - 1
    numbered = part.withColumn("place", place)
    bundle = F.col("part").cast("long") * (1 << 32) + F.floor(F.col("place") / BUNDLE)
    return durable(numbered.select("item_id", bundle.alias("bundle"), (F.col("place") % BUNDLE).cast("long").alias("slot")))


def ranking_sql(top: int = 50) -> str:
    split = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
t AS (SELECT k, {split} AS term FROM d),
p AS (SELECT k, term, count(*) AS tf FROM t GROUP BY k, term),
s AS (SELECT k, count(*) AS n FROM t GROUP BY k),
g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM s),
m AS (SELECT k, 50 + (50 * n * n_docs) // n_terms AS m FROM s, g),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {split} AS term FROM benchmark)),
x AS (SELECT item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY item_id, k),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM x JOIN d USING (k) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {top}
"""
