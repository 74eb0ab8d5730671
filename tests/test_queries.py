"""Every registered query against its SQL; those without SQL run and give rows."""

import pytest

from cairn.plans import registry

from .compare import duck, same

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitioning_does_not_matter(spark, sf_dir):
    """The same rows in another order and number of partitions give the same result."""
    from cairn.operators import latest as L

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    one = L.latest(orders.repartition(7, "o_orderkey"), ["o_custkey"], "o_orderdate", "o_orderkey")
    two = L.latest(orders.orderBy("o_totalprice").coalesce(2), ["o_custkey"], "o_orderdate", "o_orderkey")
    assert sorted(map(str, one.select(*orders.columns).collect())) == sorted(map(str, two.select(*orders.columns).collect()))


def test_every_segment_is_drawn(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity").collect()
    want = set()
    for r in rows:
        x0, y0, x1, y1 = r.l_partkey % 40, r.l_suppkey % 40, int(r.l_quantity), r.l_linenumber * 5
        steps = 2 * max(abs(x1 - x0), abs(y1 - y0))
        for k in range(steps + 1):
            px, py = (min(max(round(a + (b - a) * k / max(steps, 1)), 0), 31) for a, b in ((x0, x1), (y0, y1)))
            want.add((r.l_orderkey, r.l_linenumber, r.l_extendedprice, px, py))
    got = [tuple(r) for r in QUERIES["vox_draw_line_all"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[0] for r in got} == {r.l_orderkey for r in rows}


def test_secrets_of_any_number_are_matched(spark):
    from pyspark.sql import functions as F

    from cairn.functions import text as T
    from cairn.plans.filters import leaking

    values = ["Ana", "é", "", "12", "1.5.", ".7", "12345678", "Größe", "abcdefgh", "a b", " x", None, "zz.z", "ABCDE"]
    secrets = [(i, v, n) for i, v in enumerate(values) for n in (False, True)] + [(10_000 + i, f"nobody{i}", False) for i in range(10_500)]
    texts = [(i, v) for i, v in enumerate(["ana", " ANA ", "banana 12 and 1.5", "x12y .7. 112", "123456789", "GRÖSSE größe", "xabcdefghi", "a  b", "a b", None, "", "É", "nobody77 x", "a\nabcde", "ana"])] + [(0, "ana")]
    t = spark.createDataFrame(texts, "conv_id long, text string")
    s = spark.createDataFrame(secrets, "item_id long, secret string, neutral boolean")
    pick = lambda df: sorted(map(str, df.select("conv_id", "item_id", "neutral").collect()))
    want = pick(t.join(F.broadcast(s), T.leaks(F.col("text"), F.col("secret"), F.col("neutral"))))
    assert len(want) > 30 and pick(leaking(t, s)) == want


def test_stacks_are_split_without_a_row_for_each_count(spark, sf_dir):
    """one exchange of combined rows, none that is expanded."""
    plan = QUERIES["flt_stack_split"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1


def test_pixels_of_keys_with_several_segments(spark):
    """repeated items, several segments of a key, null keys and values, coordinates off the frame; no pixel goes through a
    shuffle where a key has one segment."""
    from cairn.plans.voxels import drawn

    items = [(1, 1, 2.0, 3, 7, 10.0), (1, 1, 2.0, 3, 7, 10.0), (1, 1, 2.0, 30, 7, 10.5), (1, 1, None, 39, 0, 50.0), (1, 1, None, 5, 39, -7.0), (2, 9, 1.0, -39, -1, -80.0), (None, 2, 1.0, 4, 4, 4.0), (3, None, 1.0, 4, 4, 4.0), (4, 1, 1.0, None, 4, 4.0), (5, 1, 0.5, 5, 5, 5.0)]
    df = spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_extendedprice double, l_partkey long, l_suppkey long, l_quantity double")
    want = set()
    for order, line, price, part, supp, quantity in items:
        if None in (line, part):
            continue
        rem = lambda v: v % 40 if v >= 0 else -(-v % 40)
        x0, y0, x1, y1 = rem(part), rem(supp), int(quantity), line * 5
        steps = 2 * max(abs(x1 - x0), abs(y1 - y0))
        for k in range(steps + 1):
            want.add((order, line, price, *(min(max(round(a + (b - a) * k / max(steps, 1)), 0), 31) for a, b in ((x0, x1), (y0, y1)))))
    got = [tuple(r) for r in drawn(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_keys_of_texts_take_bounded_memory():
    """4 MB of texts in one batch, and one text longer than what is tested at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from cairn.operators import bloom
    from cairn.plans import filters

    texts = ["", "abc", "x" * 3_000_000 + "secre", *["some text of a few words " * 20] * 2000, "secre", "c"]
    key = lambda v: int.from_bytes(v, "big") + (len(v) << 56)
    words, wanted = np.zeros(bloom.WORDS, np.uint64), np.array([key(b"secre"), key(b"c")])
    for at, bit in bloom._places(wanted):
        np.bitwise_or.at(words, at, bit)
    tracemalloc.start()
    row, h = filters.met_keys(pa.array(texts), pa.array([[]] * len(texts), pa.list_(pa.int64())), [1, 2, 3, 4, 5], words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {(r, k) for r, k in zip(row.tolist(), h.tolist()) if k in set(wanted.tolist())}
    assert got == {(2, key(b"secre")), (2, key(b"c")), (len(texts) - 2, key(b"secre")), (1, key(b"c")), (len(texts) - 1, key(b"c")), (len(texts) - 2, key(b"c"))}
    assert peak < 100e6
