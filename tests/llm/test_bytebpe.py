"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import bytebpe as B

RANKS = B.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
VOCABULARY = B.Vocabulary.of(RANKS, P.PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return B.Codec.of(VOCABULARY)


def same(codec, texts):
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == PLAIN.encode_ordinary(text), text
        assert codec.bytes_of(ids).tobytes() == text.encode()


def test_every_character(codec):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(codec, ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)} \n" for c in points[k: k + 64]) for k in range(0, len(points), 64)])


def test_pieces_that_two_merges_claim(codec):
    """Byte strings x y z with tokens xy = yz: which pair is merged first matters."""
    claimed = []
    for t in RANKS:
        for p in range(1, len(t)):
            q = len(t) - p
            if p != q and t[p:] == t[:q] and all(x in RANKS for x in (t[:p], t[p:], t[:q], t[q:])):
                claimed.append((t + t[q:]).decode("utf-8", "ignore"))
    rng = random.Random(1)
    assert len(claimed) > 100
    same(codec, claimed + ["".join(rng.choices(claimed, k=rng.randrange(1, 6))) for _ in range(5000)])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sta.,!? 0123éÄ한👍🏽")), max_size=200))
def test_any_text(text):
    codec = B.Codec.of(VOCABULARY)
    same(codec, [text])
    ids = next(codec.encode([text]))
    starts, ends = codec.offsets(ids)
    spans = PLAIN.decode_with_offsets(ids.tolist())[1]
    assert starts.tolist() == spans
    assert all(a < b for a, b in zip(starts, ends)) and (not len(ends) or ends[-1] == len(text))
    parts = B.token_texts(codec, ids)
    assert "".join(parts) == text and len(parts) == len(ids)


def test_windows_and_forgotten_pieces(codec, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdeé.,'\n ", k=rng.randrange(1, 9))) for _ in range(400)) for _ in range(5)] + ["x" * 3000 + " " * 700 + "y. z", " \n", ""]
    monkeypatch.setattr(B, "WINDOW", 64)
    monkeypatch.setattr(B, "KNOWN", 50)
    assert all("".join(B.windows(t)) == t for t in texts)
    same(codec, texts)


def test_a_character_of_several_tokens(codec):
    ids = next(codec.encode(["a𓀀b"]))
    assert len(ids) > 3
    starts, ends = codec.offsets(ids)
    assert set(zip(starts.tolist(), ends.tolist())) == {(0, 1), (1, 2), (2, 3)}
    parts = B.token_texts(codec, ids)
    assert [p for p in parts if p] == ["a", "𓀀", "b"]
    assert B.token_texts(codec, ids[:3])[-1] == "�"


def test_tables(spark):
    texts = [None, "", "Hello, world! ", "naïve café\r\n\n  x", "日本語 テキスト", "same", "same", "word, " * 800_000]
    df = spark.createDataFrame([(k if k != 4 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({"ids": F.lit("x"), "encoded_text": F.lit(1), "bytes": F.lit(2)})
    rows = B.encode(df, VOCABULARY)
    assert rows.columns == [*df.columns, "ids_", "starts", "ends"]
    for r in rows.where("coalesce(length(text), 0) < 1000").collect():
        assert r.ids_ == PLAIN.encode_ordinary(r.text or "") and len(r.starts) == len(r.ends) == len(r.ids_)
    back = B.decode(rows.withColumn("ids_", F.when(F.col("text").isNotNull(), F.col("ids_"))), VOCABULARY, ids_col="ids_")
    for r in back.drop("added").where("coalesce(length(text), 0) < 1000").collect():
        assert r.decoded == r.text and (r.text is None) == (r.bytes_ is None)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(df, VOCABULARY).collect()}
    want = set()
    for k, t in enumerate(texts):
        ids = np.array(PLAIN.encode_ordinary(t or ""), "<u4")
        want.add((k if k != 4 else None, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    none = df.limit(0)
    assert B.digests(none, VOCABULARY).count() == B.decode(B.encode(none, VOCABULARY), VOCABULARY, "ids_").count() == 0


def test_unknown_ids_are_refused(codec):
    with pytest.raises(ValueError):
        codec.bytes_of(np.array([60_000]))
