"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target (``source_targets``) and so a copy rate; a document is copied floor(rate) times and once
more with the fractional part p of the rate as probability. The extra copies are drawn dependently: a document is
paired with a partner (all smaller documents of its bucket), and word mass p * size moves at random from one to the
other until one of the two is integral, which keeps the sum of p * size and every expectation. Buckets have about
``bucket_rows`` rows, dealt by a hash of the id; what stays fractional, one document a bucket, meets again bucket by bucket in a reduction
tree, until one residual a source is left, which a coin decides. A source's taken words thus miss its target by less
than one document's size. Random numbers are hashes of the id, the seed and the level: reruns agree.

Nulls: a null text has size 0, which takes 0 words; a null source is a source of its own, last in order. Rows of equal
id (null too), size and source are one class: the whole part of their extra copies is given out, the rest is rounded
like a document's, so of such rows some may be taken once more than others. Extra columns are ignored (``mix``) or
kept (``with_copies``). An empty table gives an empty result; where all sizes are 0, all targets are 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.histograms import positions

from ._store import durable, fresh, scratch

WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9
_COLUMNS = ["doc_id", "size", "slot", "bucket", "n", "each", "once", "p"]
_ROW = "doc_id long, size long, slot long, bucket long, n long, each long, once long, p double"


def word_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """(source, slot, source_size, n_docs, target) of each source of (source, size).

    Sources in code-point order (null last) weigh ``cycle`` in turn and share the sum of all sizes by weight; a target
    stops at ``max_copies`` times its source's size and the excess is shared again by weight until none is above.
    Each round is one aggregate over the table of sources, of which only three numbers reach the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = positions(durable(sums).withColumn("last", F.col("source").isNull()), ["last", "source"], "slot").withColumn("slot", F.col("slot") - 1).drop("last")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = durable(ranked.withColumn("weight", F.element_at(weights, (F.col("slot") % len(cycle) + 1).cast("int"))))
    cap = F.col("source_size") * max_copies
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return ranked.withColumn("target", F.lit(0.0))
    level, capped = total / weight, -1
    while True:
        above = cap <= F.col("weight") * level
        n, fixed, open_weight = ranked.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - fixed) / open_weight
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def _snap(p: float) -> float:
    return p if _EPS < p < 1 - _EPS else float(round(p))


def _settle_equal(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds a bucket of documents of one p, the largest first, down to one fractional row at most.

    A document is paired with all smaller ones of its bucket as one partner, whose common p absorbs the mass. Large
    documents thus settle while there is much to pair them with, and what stays fractional is small.
    """
    rows = rows.sort_values(["size", "turn", "doc_id"], ascending=[False, True, True], kind="stable")
    size, p, draw = rows["size"].tolist(), rows["p"].tolist(), rows["draw"].tolist()
    common, rest = p[0], sum(size)
    for i, w in enumerate(size):
        rest -= w
        own, p[i] = common, common
        if not rest or common in (0.0, 1.0):
            continue
        up, down = min((1 - own) * w, common * rest), min(own * w, (1 - common) * rest)
        moved = up if draw[i] * (up + down) < down else -down
        p[i], common = _snap(own + moved / w), _snap(common - moved / rest)
    return rows.assign(p=p)[_COLUMNS]


def _settle_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds residuals, each with a p of its own, pair by pair down to one fractional row at most."""
    rows = rows.sort_values(["size", "turn", "doc_id"], ascending=[False, True, True], kind="stable")
    size, p, draw = rows["size"].tolist(), rows["p"].tolist(), rows["draw"].tolist()
    i = 0
    for j in range(1, len(p)):
        up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        moved = up if draw[j] * (up + down) < down else -down
        p[i], p[j] = _snap(p[i] + moved / size[i]), _snap(p[j] - moved / size[j])
        i = i if 0 < p[i] < 1 else j
    return rows.assign(p=p)[_COLUMNS]


def _round(rows: DataFrame, seed: int, level: int, settle) -> DataFrame:
    number = lambda k: (F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit(seed + k), F.lit(level)), 11)) * F.lit(2.0**-53)
    drawn = rows.withColumn("turn", number(1)).withColumn("draw", number(2))
    return drawn.groupBy("slot", "bucket").applyInPandas(settle, _ROW)


def _rounded(rows: DataFrame, seed: int, bucket_rows: int) -> DataFrame:
    """``rows`` (of ``_ROW``) with p 0 or 1."""
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    settled, level = rows.where(~fractional), 0
    rest = rows.where(fractional)
    while True:
        if level:
            done = durable(_round(rest, seed, level, _settle_pairs))
        else:  # documents that stand alone share their source's p; repeated ones have one of their own
            alone = F.col("n") == 1
            done = durable(_round(rest.where(alone), seed, 0, _settle_equal).unionByName(_round(rest.where(~alone), seed, 0, _settle_pairs)))
        settled = settled.unionByName(done.where(~fractional))
        rest, level = done.where(fractional), level + 1
        if rest.groupBy("slot").count().where("count > 1").isEmpty():
            coin = F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit(seed), F.lit(-1)), 11) * F.lit(2.0**-53)
            return settled.unionByName(rest.withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0)))
        rest = rest.withColumn("bucket", F.floor(F.col("bucket") / bucket_rows))


def _classes(sized: DataFrame, cycle: tuple[float, ...], max_copies: int, seed: int, bucket_rows: int) -> DataFrame:
    """(doc_id, size, source, source_size, target, n, each, once): of the n rows of equal id, size and source (of
    ``sized``), every one is taken ``each`` times and ``once`` of them once more. Rows are counted before they are
    shuffled, so however many rows have one id, they are one."""
    targets = durable(source_targets(sized, cycle, max_copies))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate)
    side = targets.select(F.col("source").alias("of"), "slot", rate.alias("rate"), F.ceil(F.col("n_docs") / bucket_rows).alias("buckets"))
    classes = sized.groupBy("doc_id", "size", "source").agg(F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0) * F.col("n")  # expected extra copies of a class
    whole = F.floor(part + _EPS)
    rows = classes.join(side, classes.source.eqNullSafe(side.of)).select(
        "doc_id", "size", "slot", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("buckets")).alias("bucket"),
        "n", F.floor("rate").alias("each"), whole.alias("once"), F.when(part - whole > _EPS, part - whole).otherwise(0.0).alias("p"),
    )
    done = _rounded(durable(rows), seed, bucket_rows)
    return done.join(targets.drop("n_docs", "weight"), "slot").select("doc_id", "size", "source", "source_size", "target", "n", "each", (F.col("once") + F.col("p")).cast("long").alias("once"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_size(F.col(text_col)).alias("size")]


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 42, bucket_rows: int = 4096,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken): a row for every row of ``docs``."""
    with scratch(docs.sparkSession):
        sized = durable(docs.select(*_sized(docs, id_col, text_col, source_col)))
        found = durable(_classes(sized, cycle, max_copies, seed, bucket_rows), keep=True)
    # The rows of a class again, in blocks, so that a class of very many rows is many tasks' work.
    named = ("doc_id", "size", "source", "source_size", "target")
    single = found.where("n = 1").select(*named, (F.col("each") + F.col("once")).alias("copies"))
    blocks = found.where("n > 1").withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {bucket_rows}L)"))).repartition("doc_id", "size", "source", "first")
    listed = blocks.withColumn("k", F.explode(F.sequence("first", F.least(F.col("first") + bucket_rows, F.col("n")) - 1)))
    rows = single.unionByName(listed.select(*named, (F.col("each") + (F.col("k") < F.col("once")).cast("long")).alias("copies")))
    return rows.withColumn("taken", F.col("size") * F.col("copies"))


def with_copies(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 42, bucket_rows: int = 4096,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns and size, source_size, target, copies and taken, under names that
    ``docs`` does not have. Which of several rows of equal id, size and source are taken once more is settled by their
    order in a stored copy of the table."""
    names = {n: fresh(docs, n) for n in ("row_of_mix", "id_of_mix", "source_of_mix", "size", "source_size", "target", "copies", "taken")}
    keys = dict(zip(("doc_id", "source", "size"), (names["id_of_mix"], names["source_of_mix"], names["size"])))
    columns = dict(zip(("doc_id", "source", "size"), _sized(docs, id_col, text_col, source_col)))
    with scratch(docs.sparkSession):
        rows = durable(docs.withColumns({keys[k]: column for k, column in columns.items()}).withColumn(names["row_of_mix"], F.monotonically_increasing_id()), keep=True)
        sized = rows.select(*[F.col(name).alias(k) for k, name in keys.items()], F.col(names["row_of_mix"]).alias("row"))
        found = durable(_classes(sized, cycle, max_copies, seed, bucket_rows))
        same = lambda a, b: a.doc_id.eqNullSafe(b.id2) & a.source.eqNullSafe(b.source2) & (a["size"] == b.size2)
        side = found.withColumnsRenamed({"doc_id": "id2", "source": "source2", "size": "size2"})
        place = durable(sized.join(side, same(sized, side)).drop("id2", "source2", "size2"))
        several = positions(place.where("n > 1"), ["doc_id", "source", "size", "row"], "at")
        first = durable(several.groupBy("doc_id", "source", "size").agg(F.min("at").alias("first")).withColumnsRenamed({"doc_id": "id2", "source": "source2", "size": "size2"}))
        several = several.join(first, same(several, first)).withColumn("extra", (F.col("at") - F.col("first") < F.col("once")).cast("long"))
        numbers = place.where("n = 1").select("row", "source_size", "target", (F.col("each") + F.col("once")).alias("copies")).unionByName(
            several.select("row", "source_size", "target", (F.col("each") + F.col("extra")).alias("copies"))
        )
        numbers = durable(numbers.withColumnsRenamed({"row": names["row_of_mix"], **{n: names[n] for n in ("source_size", "target", "copies")}}), keep=True)
    # Both sides have every row: a merge at every size.
    out = rows.join(numbers.hint("merge"), names["row_of_mix"]).withColumn(names["taken"], F.col(names["size"]) * F.col(names["copies"]))
    return out.select(*docs.columns, *[names[n] for n in ("size", "source_size", "target", "copies", "taken")])
