import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import _likeness as L
from cairn.llm import simhash

from .brute import groups, simhash as fingerprint, words

rng = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(300)] + ["été", "Größe", "A", "ZZ"]


def texts():
    out = []
    for _ in range(40):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 400))]
        out.append(" ".join(base))
        for _ in range(3):
            edited = base[:]
            edited[rng.randrange(len(edited))] = rng.choice(VOCABULARY)
            out.append("\n".join(edited) + "\t")
    return out + ["", "  \n", None, "one", "one two", out[0], out[0].upper()]


@pytest.mark.parametrize("key_rows", [4096, 3])
def test_equals_brute_force(spark, key_rows):
    rows = list(enumerate(texts()))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), key_rows=key_rows).collect()
    fp = {i: fingerprint(t, 3) for i, t in rows}
    want = groups(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_fingerprint_is_sparks_hash(spark):
    (h,) = spark.sql("SELECT xxhash64('a b c')").first()
    assert fingerprint("a b c", 3) == h % 2**64


def test_one_row_of_a_group_stays(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "zz"), (None, "zz"), (5, None), (6, ""), (7, "q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "key": F.lit("x"), "rep": F.lit(None).cast("string")})
    got = sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_one(docs).collect())
    assert got == [(0, "zz"), (1, "a b c d"), (5, ""), (7, "q r s t u")]
    assert simhash.keep_one(docs).columns == docs.columns


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([], "fp long, rep long"), 4)


@pytest.mark.parametrize("rounds, rows_a_block", [(2, 2048), (0, 3)])
def test_near_copies_at_the_stated_likeness_go(spark, monkeypatch, rounds, rows_a_block):
    monkeypatch.setattr(L, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(L, "BAND_ROWS", rows_a_block)
    own = random.Random(11)

    def grams(text):
        w = words(text)
        return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))}

    rows = []
    for _ in range(120):
        base = [own.choice(VOCABULARY) for _ in range(own.randrange(40, 300))]
        rows.append(" ".join(base))
        edited = base[:]
        for at in own.sample(range(len(base)), max(1, len(base) // own.randrange(30, 80))):  # a few words changed
            edited[at] = own.choice(VOCABULARY)
        rows.append("  ".join(edited).title())
        rows.append(" ".join(base + [own.choice(VOCABULARY) for _ in range(len(base) // own.randrange(4, 9))]))  # or a paragraph added
    sets, fp = [grams(t) for t in rows], [fingerprint(t, 3) for t in rows]
    near = {(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert len(near) > 150 and sum((fp[a] ^ fp[b]).bit_count() <= 3 for a, b in near) < len(near) / 2
    want = groups(range(len(rows)), lambda a, b: (a, b) in near or (fp[a] ^ fp[b]).bit_count() <= 3)
    docs = spark.createDataFrame(list(enumerate(rows)) + [(0, rows[0]), (0, rows[0]), (None, rows[1]), (900, None), (901, "")], "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in simhash.keep_one(docs, jaccard=0.8).collect())
    assert got == sorted({*want.values(), 900})
    assert simhash.keep_one(docs.limit(0), jaccard=0.8).count() == 0
