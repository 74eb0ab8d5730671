import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import suffix_dedup as S

from .brute import without_repeats

rng = random.Random(1)


def rnd(n):
    return "".join(rng.choice("ab é") for _ in range(n))


PASSAGES = [rnd(60), rnd(45), "ab" * 40, "a" * 90]
ROWS = [(i, rnd(rng.randrange(80)) + rng.choice(PASSAGES) + rnd(rng.randrange(50)) + rng.choice(PASSAGES)) for i in range(60)]
ROWS += [(100, None), (101, ""), (None, PASSAGES[0]), (102, "x"), (102, "x"), (103, "x" * 500), (None, None)]


@pytest.mark.parametrize("cap", [1 << 19, 300])
def test_equals_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(S, "WIDTHS", (0, 7, 3, 1))
    monkeypatch.setattr(S, "SHARD_BYTES", 200)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"k1": F.lit(1), "places": F.lit("x")})
    got = [tuple(r) for r in S.digests(docs, length=20, bucket_bytes=600, cap_bytes=cap).collect()]
    assert sorted(got, key=str) == sorted(without_repeats(ROWS, 20), key=str)


def test_merge_finds_equal_prefixes():
    gen = np.random.default_rng(0)
    shards = [gen.integers(97, 99, n).astype(np.uint8) for n in (40, 7, 90, 64)]
    for length in (8, 12, 20, 33):
        order, common = S.merge_shards(shards, length)
        strings = [bytes(np.resize(np.roll(s, -i), length)) for s in shards for i in range(len(s))]
        merged = [strings[i] for i in order]
        assert sorted(order) == list(range(len(strings))) and merged == sorted(strings)
        for x, y, c in zip(merged, merged[1:], common[1:]):  # common prefixes are those of the passes' depths
            assert x[:c] == y[:c] and (c == length or x[: max(8, 2 * c)] != y[: max(8, 2 * c)])
        assert common[0] == 0


def test_copies_cost_no_more_rows_than_there_are(spark, monkeypatch):
    base, stored = rnd(400), []
    durable = S.durable

    def counted(df, keep=False):
        out = durable(df, keep)
        stored.append(out.count())
        return out

    monkeypatch.setattr(S, "durable", counted)
    totals = []
    for k in (25, 50, 100):
        stored.clear()
        rows = [(None, base)] * k + [(5, base + rnd(100)), (6, rnd(300))]
        got = S.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=50).collect()
        assert [r.n_removed for r in got if r.doc_id is None] == [len(base.encode())] * k
        totals.append(sum(stored))
    assert totals[0] == totals[1] == totals[2]


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 500)
    monkeypatch.setattr("cairn.llm._text.CHUNK_BYTES", 400)
    rows = [(1, rnd(3000)), (2, rnd(100))]
    rows.append((3, rows[0][1][900:1800]))
    got = [tuple(r) for r in S.digests(spark.createDataFrame(rows, "doc_id long, text string"), length=50).collect()]
    assert sorted(got) == sorted(without_repeats(rows, 50))


def test_texts_come_back_cleaned(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("__kept", F.lit("other"))
    got = S.remove_repeats(docs, length=20)
    assert got.columns == docs.columns and got.count() == len(ROWS)
    assert {r.text for r in got.where("doc_id = 102").collect()} == {"x"} and got.where("doc_id = 100").first().text is None


def test_empty_table(spark):
    assert S.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
