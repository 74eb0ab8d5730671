import itertools
import random

from pyspark.sql import functions as F

from cairn.llm import decontaminate as D

rng = random.Random(4)
WORDS = [f"w{i}" for i in range(400)] + ["été", "Straße"]


def some(n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_planted_passages(spark):
    items = [(i, some(rng.randrange(16, 60))) for i in range(20)]
    docs, want = [], set()
    for k in range(120):
        item_id, item = items[k % 20]
        body = some(rng.randrange(0, 200))
        at = rng.randrange(len(body) + 1)
        planted = item[:]
        kind = k // 20
        if kind == 1:  # substitutions, under a fifth
            for i in rng.sample(range(len(item)), len(item) // 6):
                planted[i] = "other"
        elif kind == 2:
            planted.insert(len(item) // 2, "extra")
        elif kind == 3:
            planted = [w.upper() + "," for w in planted]
        elif kind == 4:  # a part of it only, too short or long enough for a run
            planted = planted[: 10 if k % 2 else 13]
        elif kind == 5:
            planted = []
        docs.append((k, " ".join(body[:at] + planted + body[at:])))
        if kind < 4 or kind == 4 and not k % 2:
            want.add((k, item_id))
    docs += [(500, None), (501, ""), (None, " ".join(items[0][1])), (502, docs[0][1]), (502, docs[0][1])]
    bench = [(i, " ".join(t)) for i, t in items] + [(90, None), (91, "  "), (92, "Two words")]
    docs.append((503, "before TWO words after"))
    want |= {(None, 0), (502, 0), (503, 92)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"h": F.lit(1), "sid": F.lit("x"), "item_id": F.lit(3)})
    benchmark = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = D.contaminated(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = D.decontaminate(df, benchmark)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, bench).count() == 0
    some_docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert D.contaminated(some_docs, bench).count() == 0 and D.decontaminate(some_docs, bench).count() == 1


def test_null_and_repeated_ids(spark):
    leaked, other = some(20), some(20)
    bench = spark.createDataFrame([(None, " ".join(leaked)), (None, None), (7, " ".join(some(18))), (7, " ".join(other))], "item_id long, text string")
    rows = [(1, " ".join(some(30) + leaked)), (2, " ".join(some(40))), (None, " ".join(other + some(5))), (None, " ".join(some(25))), (1, " ".join(some(25)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_found) for r in D.contaminated(docs, bench).collect()} == {(1, None, 20), (None, 7, 20)}
    assert sorted(r.text for r in D.decontaminate(docs, bench).collect()) == sorted(t for _, t in rows[1::2] + rows[4:])


def test_masks_find_every_pattern():
    """A seed is left of every item of 5 to 21 words, wherever a fifth of its words are substituted."""
    for n in range(1, 22):
        seeds = [{i + j for j, bit in enumerate(m) if bit == "1"} for m in D.masks_of(n, D.MASKS, 0.8) for i in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), n // 5):
            assert any(s.isdisjoint(changed) for s in seeds), (n, changed)


def test_equals_brute_force(spark):
    """Ungapped overlays of every item on every place of every text."""
    own = random.Random(8)
    items = [(i, [own.choice(WORDS) for _ in range(own.choice((5, 6, 7, 9, 10, 16, 30)))]) for i in range(40)]
    docs = []
    for k in range(160):
        item = items[k % 40][1][:]
        for i in own.sample(range(len(item)), own.randrange(0, len(item) // 3 + 1)):
            item[i] = "other"
        docs.append((k, [own.choice(WORDS) for _ in range(own.randrange(60))] + item + [own.choice(WORDS) for _ in range(own.randrange(60))]))
    want = set()
    for d, text in docs:
        for i, item in items:
            for at in range(1 - len(item), len(text)):
                same = [0 <= at + j < len(text) and text[at + j] == w for j, w in enumerate(item)]
                if sum(same) >= 0.8 * len(item) or "1" * 13 in "".join("01"[x] for x in same):
                    want.add((d, i))
    join = lambda rows: [(k, " ".join(w)) for k, w in rows]
    got = D.contaminated(spark.createDataFrame(join(docs), "doc_id long, text string"), spark.createDataFrame(join(items), "item_id long, text string"), drift=0)
    assert len(want) > 60 and {(r.doc_id, r.item_id) for r in got.collect()} == want
