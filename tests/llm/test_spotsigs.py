import hashlib
import re

from pyspark.sql import functions as F

from cairn.llm import spotsigs as S


def brute(text, chain=2):
    common = {S.LINE, *S.ANTECEDENTS.split()}
    w = [x for line in re.split(r"[\n\r]+", (text or "").lower()) for x in [S.LINE, *re.findall(r"[^\W_]+", line)]]
    out = []
    for i, a in enumerate(w):
        if a in common:
            taken, last, n = [a], 0, 0
            for x in w[i + 1:]:
                taken.append(x)
                if x not in common:
                    n, last = n + 1, len(taken)
                if n == chain:
                    break
            if n:
                out.append(" ".join(taken[:last]))
    return set(out)


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


TEXT = "The cat sat on the mat, and the dog of Übergröße was not in the house. It is a fine day for a walk with friends"
ROWS = [(1, TEXT), (2, TEXT.upper()), (3, None), (4, ""), (5, "alpha beta gamma delta"), (9, TEXT.replace("dog", "cow")), (7, "x"), (8, TEXT + " 😀 und der Hund läuft schnell"), (None, "the end of it all"), (12, TEXT), (13, "one\ntwo three\r\n\nthe four\n"), (14, "the of and"), (15, "\n")]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"range": F.lit(1), "sigs": F.lit("x"), "halo": F.lit(7)})
    got = {r.doc_id: r for r in S.with_edited(df).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(brute(text), brute(edited))) < 1e-12 and abs(r.near_next - likeness(brute(text), brute(following))) < 1e-12
    assert got[1].fingerprint == got[12].fingerprint != got[9].fingerprint


def test_many_ranges_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.edited_sha256 for r in S.with_edited(docs).collect()}
    rows = docs.orderBy(F.desc("doc_id")).collect()
    for k, r in enumerate(rows):
        half = len(r.text) // 2
        assert got[r.doc_id] == hashlib.sha256((r.text[: len(r.text) - half] + rows[(k + 1) % len(rows)].text[:half]).encode()).hexdigest()


def test_hot_ids_are_cut_by_hash(spark):
    """A third of the rows has no id, a third one id: many ranges, the same order as one sorted list."""
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, f"text number {i} of the many {'é' * (i % 7)}") for i in range(600)] + [(2**63 - 1, "last"), (-5, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    listed = docs.withColumns({"sigs": F.array(F.lit(1)), "h": F.xxhash64("text")})
    number, n = S._ranges(listed, 16)
    held = [r["count"] for r in listed.groupBy(number.alias("k")).count().collect()]
    assert len(held) > 14 and max(held) < 120
    order = sorted(listed.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = {r.text: order[(k + 1) % len(order)].text for k, r in enumerate(order)}
    assert {r.text: r.next_text for r in S.with_next(listed.drop("h")).collect()} == want


def test_pairs_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    members, pairs = S.similar_pairs(docs)
    rows = docs.collect()
    sigs = {r.doc_id: frozenset(brute(r.text)) for r in rows}
    first = {}
    for i in sorted(sigs):
        first.setdefault(sigs[i], i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[s] for i, s in sigs.items()}
    classes = sorted(first.values())
    want = {frozenset((a, b)) for n, a in enumerate(classes) for b in classes[:n] if min(len(sigs[a]), len(sigs[b])) >= 0.8 * max(len(sigs[a]), len(sigs[b])) - 1e-9 and likeness(sigs[a], sigs[b]) >= 0.8 - 1e-9}
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want


def test_empty_table(spark):
    assert S.with_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
