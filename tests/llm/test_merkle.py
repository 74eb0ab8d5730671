"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return sha(*(field(row[k]) for k in ("doc_id", "source", "lang", "n_chars")), field(text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k: k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    for level in tree[:-1]:
        first = at - at % 3
        yield level[first:at], level[at + 1: first + 3]
        at //= 3


def brute(rows):
    groups = {}
    for row in rows:
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
        bare = row["text"].replace("\n", "") if hit and row["text"] is not None else row["text"]
        groups.setdefault(row["source"], []).append((row["doc_id"], leaf(row, row["text"]), leaf(row, bare)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for k, (doc_id, own, now) in enumerate(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))):
            steps = [*path(trees[s], k), *path(top, i)]
            h = now
            for left, right in steps:
                h = sha(*left, h, *right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha(*(x for left, right in steps for x in left + right)), h, h == top[-1][0]))
    return out


def check(spark, rows):
    df = spark.createDataFrame([tuple(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).repartition(3)
    df = df.withColumns({"grp": F.lit(1), "rank": F.lit("x"), "digest": F.lit(2), "lo": F.lit(3)})
    got = [tuple(r) for r in M.verified(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    return got


def row(rng, doc_id, source):
    text = rng.choice([None, "", "a", "line\nline", "é\n\nü", "\n", "x" * rng.randrange(50)])
    return {"doc_id": doc_id, "text": text, "lang": rng.choice([None, "de", "", "-"]), "source": source, "n_chars": rng.choice([None, 0, 12])}


def test_sizes_around_powers_of_three(spark):
    rng = random.Random(1)
    rows, doc_id = [], 0
    for s, n in enumerate([1, 2, 3, 4, 9, 10, 28, 81, 1, 5, 27]):
        for _ in range(n):
            doc_id += rng.randrange(1, 4)
            rows.append(row(rng, doc_id, None if s == 4 else f"s{s}"))
    got = check(spark, rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_several_bands(spark, monkeypatch):
    """Buckets of one and two levels make a tree of many bands."""
    rng = random.Random(2)
    rows = [row(rng, k, "big" if k % 3 else "é" * (k % 5)) for k in range(200)]
    monkeypatch.setattr(M, "BAND", 2)
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = [row(rng, None, "a") for _ in range(7)] + [row(rng, 5, "a") for _ in range(6)]
    rows += [dict(rows[0]) for _ in range(5)] + [row(rng, 1, None), row(rng, None, None), row(rng, 1, "")]
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    check(spark, [row(random.Random(4), 9, "one")] * n)


def test_very_long_text(spark):
    rows = [row(random.Random(5), k, "s") for k in range(3)] + [{"doc_id": 8, "text": "line\n" * 800_000, "lang": "en", "source": "s", "n_chars": 4_000_000}]
    check(spark, rows)


def test_nodes_are_nested_intervals(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([tuple(row(rng, k, "s").values()) for k in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    nodes, proofs = M.manifest(df, M.document_leaf(F.col("text")))
    found = {(r.level, r.lo): r for r in nodes.where("tree = 'groups'").collect()}
    assert sum(level == 1 for level, _ in found) == 17 and found[(4, 0)].hi == 50
    for r in found.values():
        kids = [(k.lo, k.hi) for k in r.kids]
        assert kids[0][0] == r.lo and kids[-1][1] == r.hi and all(a[1] == b[0] for a, b in zip(kids, kids[1:]))
        assert r.digest == sha(*(k.digest for k in r.kids))
    assert {r.n_inner for r in proofs.collect()} == {4}
