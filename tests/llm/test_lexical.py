"""Ranked lexical search against a plain ranking."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cairn.llm import lexical as L
from cairn.llm.queries import ORACLES, QUERIES

from ..compare import duck, same


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, top):
    counted = [(doc_id, Counter(terms(t))) for doc_id, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, wanted in asked.items():
        scores = []
        for doc_id, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return out


def check(spark, docs, items, top=50, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns({"term": F.lit("x"), "block": F.lit(1), "item_id": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"bundle": F.lit(1), "doc_id": F.lit(2), "spread": F.lit("x")})
    got = [tuple(r) for r in L.ranking(d, i, top=top).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(docs, items, top)))
    return got


def corpus(rng, n, words):
    return [(k * 3 % (2 * n), " ".join(rng.choices(words, [1 / (w + 1) for w in range(len(words))], k=rng.randrange(60)))) for k in range(n)]


WORDS = [f"w{k}" for k in range(60)] + ["Über", "ÉCOLE", "x.y", "日本", "A-b", "7"]


def test_ranks(spark):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))) for k in range(30)]
    assert len(check(spark, corpus(rng, 400, WORDS), items)) > 1000


def test_many_blocks_and_bundles(spark, monkeypatch):
    """Blocks of 8 documents and bundles of 4 items."""
    rng = random.Random(2)
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "BUNDLE", 4)
    docs, items = corpus(rng, 150, WORDS), [(k, " ".join(rng.choices(WORDS, k=5))) for k in range(11)]
    check(spark, docs, items, top=7)
    bits = L._bit_table(L.item_terms(spark.createDataFrame(items, "item_id long, text string")))
    index = L.postings(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), bits)
    assert index.where("term IS NULL").count() >= 150 / 8 and index.agg(F.max("n")).first()[0] <= 8


def test_ties_nulls_and_repeated_rows(spark):
    docs = [(9, "a b"), (3, "a b"), (None, "a b"), (3, "a b"), (4, "B, a!"), (5, None), (6, ""), (7, " .,"), (8, "c"), (10, "c c c a"), (11, "z")]
    items = [(1, "A"), (2, "a c"), (None, "z"), (3, None), (4, ""), (2, "b"), (5, "nowhere"), (6, "a a a")]
    check(spark, docs, items)
    check(spark, docs, items, top=2)


def test_small_tables(spark):
    assert check(spark, [], [(1, "a")]) == [] and check(spark, [(1, "a")], []) == [] and check(spark, [], []) == []
    assert check(spark, [(1, None)], [(1, "a")]) == []
    check(spark, [(1, "a")], [(1, "a")])


def test_a_very_long_text(spark):
    rng = random.Random(3)
    docs = [*corpus(rng, 20, WORDS), (999, " ".join(rng.choices(WORDS, k=600_000))), (1000, "y" * 3_000_000 + " w1")]
    check(spark, docs, [(1, "w1 w2 über"), (2, "y" * 3_000_000)])


def test_equals_sql(spark, sf_dir):
    con = duck(sf_dir)
    for name in ("op11_nested_manifest", "op13_term_pipeline"):
        assert same(QUERIES[name](spark, sf_dir), con, ORACLES[name])
