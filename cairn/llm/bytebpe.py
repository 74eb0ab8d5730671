"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A rank file gives the bytes of every token and its rank. Bytes become characters by a fixed one-to-one table
(printable ones stay, the others move behind 255), so tokens and merges can be told to the library as strings. A token
of several bytes may be put together from every pair of tokens that gives its bytes; all of these pairs are merges of
its rank, which makes the library merge as a search for the least rank does. Text is split by a pattern first, and no
token crosses a split. Decoding looks the bytes of the ids up in the reversed table and joins them.

Offsets are counted in characters of the text, from the bytes of each token: a token that holds a part of a character
covers that character, so neighbours that share one overlap there.

A text goes to the library in pieces, and a piece that comes again is looked up. It is cut only where every
pattern of this family splits anyway (``_BREAK``), so the ids are those of the whole text; a text without such a place
is one piece. Nothing is shuffled and no text is dropped.

Nulls: a null text is empty and has no tokens; null ids of rows are carried; null ``ids`` decode to null. Bytes that are
no UTF-8 (ids that end within a character) decode to U+FFFD in texts, and stay as they are in ``bytes``. An id that the
vocabulary lacks is an error. Repeated rows are encoded alike. Extra columns are kept by ``encode`` and ``decode`` and
ignored by ``digests``; new columns get fresh names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from ._store import fresh

#: Characters of a text that are worked on at once, and how many encoded pieces a task keeps.
WINDOW, KNOWN = 1 << 16, 1 << 19
#: Between a word character or stop and a space or line break.
_BREAK = re.compile(r"(?<=[\w.,;:!?])(?=[ \n])")


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printed, else the next one behind 255."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer as text and the bytes of its tokens, end to end; small whatever the corpus."""

    model: str
    blob: bytes
    ends: bytes

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        shown = byte_characters()
        name = lambda token: "".join(shown[b] for b in token)
        ordered = sorted(ranks, key=ranks.get)
        merges = [(name(t[:k]), name(t[k:])) for t in ordered for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        tokenizer = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges))
        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        by_id = {r: t for t, r in ranks.items()}
        listed = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
        return cls(tokenizer.to_str(), b"".join(listed), np.cumsum([0, *map(len, listed)]).astype(np.int64).tobytes())


class Codec:
    """A vocabulary at work in one task."""

    _kept: dict[int, Codec] = {}

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_str(vocabulary.model)
        self.blob = np.frombuffer(vocabulary.blob, np.uint8)
        self.ends = np.frombuffer(vocabulary.ends, np.int64)
        self.sizes = np.diff(self.ends)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Codec:
        """One for each vocabulary and worker."""
        key = hash(vocabulary)
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(vocabulary)
        return cls._kept[key]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text. Pieces that come again are encoded once, while they are kept."""
        for text in texts:
            out = [b""]
            for window in windows(text or ""):
                parts = _BREAK.split(window)
                new = [part for part in dict.fromkeys(parts) if part not in self.known]
                if len(self.known) + len(new) > KNOWN:
                    self.known.clear()
                    new = list(dict.fromkeys(parts))
                for part, encoding in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else ()):
                    self.known[part] = array("I", encoding.ids).tobytes()
                out += map(self.known.__getitem__, parts)
            yield np.frombuffer(b"".join(out), np.uint32)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, joined."""
        if len(ids) and (int(ids.max()) >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.ends[ids] - (ends - sizes), sizes)
        return self.blob[at]

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each token and the one after its last."""
        data = self.bytes_of(ids)
        character = np.cumsum((data & 0xC0) != 0x80)  # 1-based number of each byte's character
        ends = np.cumsum(self.sizes[ids])
        first = character[ends - self.sizes[ids]] - 1
        return first.astype(np.int32), character[ends - 1].astype(np.int32)


def windows(text: str) -> Iterator[str]:
    """The text in windows of little more than ``WINDOW`` characters, cut where no token can cross."""
    at = 0
    while len(text) - at > WINDOW and (cut := _BREAK.search(text, at + WINDOW)):
        yield text[at: cut.start()]
        at = cut.start()
    yield text[at:]


def token_texts(codec: Codec, ids: np.ndarray) -> list[str]:
    """What each token adds to the text: a character that several tokens share comes with the last of them; bytes that
    are none come as U+FFFD, unfinished ones with the last token."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    data, ends = codec.bytes_of(ids).tobytes(), np.cumsum(codec.sizes[ids]).tolist()
    return [decoder.decode(data[a:b], b == len(data)) for a, b in zip([0, *ends], ends)]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *values]), kind))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, characters: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of rows whose texts or id lists are about so long together, with their values."""
    for batch in batches:
        values, at, size = [], 0, 0
        for k in range(batch.num_rows):
            values.append(batch.column(column)[k].as_py())
            size += len(values[-1] or ())
            if size >= characters or k == batch.num_rows - 1:
                yield batch.slice(at, k + 1 - at), values
                values, at, size = [], k + 1, 0


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and the character offsets ``starts`` and ``ends`` (arrays of int) of the text's tokens."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    added = [fresh(docs, name) for name in ("ids", "starts", "ends")]
    schema = StructType([*docs.schema, *(StructField(name, ArrayType(IntegerType())) for name in added)])
    at, kept = len(docs.columns), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(held.value)
        for batch, texts in _blocks(batches, at):
            ids = list(codec.encode(texts))
            spans = [codec.offsets(x) for x in ids]
            lists = (_lists([x.astype(np.int32) for x in ids], pa.int32()), *(_lists([s[k] for s in spans], pa.int32()) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *lists], [*kept, *added])

    text = F.col(text_col).cast("string").alias(fresh(docs, "encoded_text"))
    return docs.select("*", text).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with the joined ``bytes``, the ``decoded`` text and the array ``added`` of what each token adds to it."""
    held = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    added = [fresh(tokens, name) for name in ("bytes", "decoded", "added")]
    kinds = (BinaryType(), StringType(), ArrayType(StringType()))
    schema = StructType([*tokens.schema, *(StructField(name, kind) for name, kind in zip(added, kinds))])
    at, kept = len(tokens.columns), tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(held.value)
        for batch, values in _blocks(batches, at):
            ids = [None if v is None else np.asarray(v, np.int64) for v in values]
            data = [None if x is None else codec.bytes_of(x).tobytes() for x in ids]
            texts = [None if d is None else d.decode("utf-8", "replace") for d in data]
            parts = [None if x is None else token_texts(codec, x) for x in ids]
            columns = (pa.array(data, pa.binary()), pa.array(texts, pa.string()), pa.array(parts, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], [*kept, *added])

    ids = F.col(ids_col).cast("array<int>").alias(fresh(tokens, "decoded_ids"))
    return tokens.select("*", ids).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids as little-endian unsigned 32-bit
    integers and of the bytes that they decode to."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(held.value)
        for batch, texts in _blocks(batches, 1):
            ids = list(codec.encode(texts))
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.astype("<u4")) for x in ids], pa.string()), pa.array([sha(codec.bytes_of(x)) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
