"""The Bloom filter of a scan."""

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import bloom
from cairn.plans.filters import leaking


def test_keys_pass_and_few_others(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    known = bloom.table(keys, "h")
    own, others = (np.array([r.h for r in df.collect()], np.int64) for df in (keys, spark.range(10_000, 60_000).select(F.xxhash64("id").alias("h"))))
    assert bloom.may_hold(known, own).all() and bloom.may_hold(known, others).sum() < 50
    assert bloom.may_hold(bloom.table(spark.range(5000).select(F.col("id").alias("h")), "h"), np.arange(5000)).all()
    assert not bloom.may_hold(bloom.table(keys.limit(0), "h"), others).any()


def test_hardly_a_row_is_made_for_no_secret(spark, monkeypatch):
    from cairn.plans import filters

    texts = spark.range(300).select(F.col("id").alias("conv_id"), F.concat(F.lit("plain words with many positions "), F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") % 100 == 0, " the Password1 is here").otherwise("")).alias("text"))
    secrets = spark.createDataFrame([(1, "password1", False), (2, "nowhere to be found", False), (3, "12345", False)], "item_id long, secret string, neutral boolean")
    made, plain = [], filters.durable
    monkeypatch.setattr(filters, "durable", lambda df: made.append(plain(df)) or made[-1])
    got = sorted((r.conv_id, r.item_id) for r in leaking(texts, secrets).collect())
    assert got == [(0, 1), (100, 1), (200, 1)]
    assert made[-1].count() <= 6  # meetings; the texts have some 30,000 positions
