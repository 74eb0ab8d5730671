import numpy as np
from pyspark.sql import functions as F

from cairn.llm import langid, quality, queries
from cairn.llm._sample import crc_mod


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op6_attention_mil(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and (got.predicted == got.quality).mean() > 0.95


def test_quality_gradient():
    gen = np.random.default_rng(0)
    x, bag, y = gen.standard_normal((7, quality.FEATURES)), np.array([0, 0, 1, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    model = quality.GatedAttention().fit(x, bag, y, rounds=200)
    assert ((model.score(x, bag, 4) > 0.5) == (y == 1)).all()
    f = model._forward((x - model.mean) / model.std, bag, 4)
    assert np.allclose(np.bincount(bag, f["weight"]), 1)  # attention is a distribution over each bag's passages


def test_quality_reads_every_passage():
    from cairn.llm._text import utf8
    import pyarrow as pa

    x, owner = quality.passages(*utf8(pa.array(["a b c d e", None, "", "x " * 7])), 2)
    assert owner.tolist() == [0, 0, 0, 1, 2, 3, 3, 3, 3] and (x[3] == 0).all()


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text here"), (1, "good text here"), (None, None), (3, "")], "doc_id long, text string").withColumns({"score": F.lit("x"), "__text": F.lit("y")}).drop("__text")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model == 1.0
    assert [r.score for r in quality.scores(docs, quality.fit(docs, labels.where("doc_id = 9"))).collect()] == [0.5] * 4
    assert quality.scores(docs.where("doc_id = 9"), model).count() == 0
    assert quality.keep_good(docs.drop("score"), model).count() == 4


def test_language_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op3_hierarchical_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert set(held.doc_id) == {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").where(crc_mod("doc_id", 5) == 0).select("doc_id").collect()}


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "der die das und", "de"), (2, "the and of it", "en"), (3, None, "en"), (4, "123 !!", None), (None, "ЖЖ", "xx"), (6, "", "de"), (7, "le la les", "fr")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[3] == got[4] == got[6] == ("und", 0.0) and got[None][0] != "und" and (got[1][0], got[2][0], got[7][0]) == ("de", "en", "fr")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.where("lang = 'zz'"))).collect()} == {"und"}
    assert langid.predict(docs.where("doc_id = 99"), model).count() == 0
    assert langid.family_of("de") == "germanic" and langid.family_of("tlh") == "tlh"


def test_quality_features_equal_plain_counts():
    """Sizes, hashed words and new words of passages, counted word by word."""
    import pyarrow as pa

    from cairn.llm._text import utf8

    text = "one two two three one four five one"
    x, owner = quality.passages(*utf8(pa.array([text, "one two"])), 3)
    parts = [p.split() for p in ("one two two", "three one four", "five one", "one two")]
    assert owner.tolist() == [0, 0, 0, 1] and np.allclose(np.expm1(x[:, -2]), [3, 3, 2, 2])
    alone = {}
    at = 64 + quality._LENGTHS
    for w in {w for p in parts for w in p}:
        one, _ = quality.passages(*utf8(pa.array([w])), 3)
        alone[w] = int(np.flatnonzero(one[0, at: at + quality._WORDS])[0])
    for row, words in zip(x, parts):
        want = np.zeros(quality._WORDS)
        for w in words:
            want[alone[w]] += 1 / len(words)
        assert np.allclose(row[at: at + quality._WORDS] ** 2, want, atol=1e-6)
        assert np.isclose((row[at + quality._WORDS: at + quality._WORDS + quality._PAIRS] ** 2).sum(), (len(words) - 1) / len(words), atol=1e-6)
        assert np.isclose(row[-4], len(set(words)) / len(words))
    seen = [{"one", "two"}, {"three", "four"}, {"five"}, {"one", "two"}]
    assert np.allclose(x[:, -3], [len(s) / len(p) for s, p in zip(seen, parts)])


def test_quality_scores_equal_a_plain_forward_pass():
    gen = np.random.default_rng(1)
    model = quality.GatedAttention()
    x, bag = gen.standard_normal((6, quality.FEATURES)), np.array([0, 0, 0, 1, 2, 2])
    p, want = model.p, []
    for b in range(3):
        h = [np.tanh(r @ p["W"] + p["b"]) for r in x[bag == b]]
        e = np.array([(np.tanh(k @ p["V"]) / (1 + np.exp(-(k @ p["U"])))) @ p["q"] for k in h])
        w = np.exp(e) / np.exp(e).sum()
        want.append(1 / (1 + np.exp(-(sum(a * k for a, k in zip(w, h)) @ p["c"] + p["c0"][0]))))
    assert np.allclose(model.score(x, bag, 3), want)


def test_language_votes_equal_a_plain_count():
    """Family by the greatest margin, then every pair of its languages votes; the sum of certainties settles ties."""
    from itertools import combinations

    gen = np.random.default_rng(2)
    languages = ["de", "en", "nl", "fr", "es", "xx"]
    x = np.abs(gen.standard_normal((120, 40)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.Hierarchy(x, [languages[i % 6] for i in range(120)])
    got, score = model.predict(x)
    for row, name, s in zip(x, got, score):
        margin = [row @ w[:-1] + w[-1] for w in model.top]
        members = model.families[model.names[int(np.argmax(margin))]]
        votes = {m: 0.0 for m in members}
        for a, b in combinations(members, 2):
            p = 1 / (1 + np.exp(-3 * (row @ model.pairs[a, b][:-1] + model.pairs[a, b][-1])))
            votes[a if p >= 0.5 else b] += 1
            votes[a] += 1e-3 * p
            votes[b] += 1e-3 * (1 - p)
        assert name == max(members, key=votes.get) and 0 <= s <= 1


def test_language_features_equal_plain_counts():
    import pyarrow as pa

    from cairn.llm._text import utf8

    x = langid.features(*utf8(pa.array(["Ab ab", "", "12 ab", "ab", "ba"])))
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 0, 1, 1, 1])
    assert np.count_nonzero(x[3]) == 1 and np.count_nonzero(x[0]) >= 3 and not (x[3] * x[4]).any()


def test_very_long_text(spark):
    """One text of some megabytes goes through every kernel whole."""
    import hashlib

    from cairn.llm import decontaminate, simhash

    words = [f"w{int(hashlib.md5(str(i).encode()).hexdigest()[:6], 16) % 50_000}" for i in range(700_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b c")], "doc_id long, text string")
    item = " ".join(words[600_000:600_020])
    found = decontaminate.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word) for r in found] == [(1, 5, 600_000)]
    assert simhash.near_duplicates(docs).count() == 2 and simhash.keep_one(docs, jaccard=0.8).count() == 2
    assert quality.scores(docs, quality.GatedAttention()).count() == 2
    assert langid.predict(docs, langid.fit(docs.selectExpr("doc_id", "text", "'en' AS lang"))).count() == 2
