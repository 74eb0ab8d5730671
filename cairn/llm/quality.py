"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``passage_words`` words; only the bag has a label. Every passage of the whole text
is encoded from its words and pairs of words (hashed), the classes of its characters (pairs of neighbouring classes),
the lengths of its words, the share of its words that are new in the passage and in the document, and its size, by one
tanh layer. A gated attention
(tanh branch times sigmoid branch) weighs the passages of a bag, and a logistic layer scores the weighted sum. All
weights are learned together from document labels, by full-batch Adam on the driver, from at most ``fit_rows``
labelled documents, each with all its passages, which the driver holds once, in four bytes a feature; scoring reads
every passage of every document and runs in the scan's tasks without a shuffle.

Nulls: a null or blank text is one passage of no words and gets a score like any other; a null id is carried and not
held out. Repeated rows are scored each, alike. Extra columns are ignored or, in ``keep_good``, kept. An empty table
gives an empty result. Without labels of both values every document gets their mean as score (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import stratified_ids
from ._store import fresh
from ._text import IS_SPACE, U64, Polynomial, chunks, mix, utf8, words

#: Classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line break, 5 full stop or comma, 6 other signs, 7 beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
for _name, _members in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, (9, 32)), (4, range(10, 14)), (5, (44, 46)), (7, range(128, 256))):
    _CLASS[list(_members)] = _name
_LENGTHS = 12
#: Slots of hashed words and of hashed pairs of words.
_WORDS, _PAIRS = 128, 64
FEATURES = 64 + _LENGTHS + _WORDS + _PAIRS + 4


def passages(data: np.ndarray, offsets: np.ndarray, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a buffer's rows, and the row of each; a row without words has one passage of zeros."""
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets, IS_SPACE)
    counts = np.bincount(rows, minlength=n)
    bags = np.maximum(1, -(-counts // passage_words))
    first = np.cumsum(bags) - bags
    total = int(bags.sum())
    owner = np.repeat(np.arange(n), bags)
    place = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
    passage = first[rows] + place // passage_words
    out = np.zeros((total, FEATURES), np.float32)
    size = np.bincount(passage, minlength=total).astype(np.float32)
    some = np.maximum(size, 1)
    if len(starts):
        # Each byte from a word's first to the one before the next word's is the word's passage's.
        reach = np.append(starts[1:], len(data))
        reach = np.minimum(reach, offsets[rows + 1]) - starts
        of = np.repeat(passage, reach)
        at = np.repeat(starts - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        kind = _CLASS[data]
        pair = kind * 8
        pair[:-1] += kind[1:]
        grams = np.bincount(of * 64 + pair[at], minlength=total * 64).reshape(total, 64)
        out[:, :64] = np.sqrt(grams / np.maximum(1, grams.sum(axis=1, keepdims=True)))
        length = np.minimum(ends - starts, _LENGTHS) - 1
        out[:, 64: 64 + _LENGTHS] = np.bincount(passage * _LENGTHS + length, minlength=total * _LENGTHS).reshape(total, -1) / some[:, None]
        hashes = Polynomial(data).of(starts, ends)
        slots = 64 + _LENGTHS
        words_in = np.bincount(passage * _WORDS + (hashes >> U64(57)).astype(np.int64), minlength=total * _WORDS)
        out[:, slots: slots + _WORDS] = np.sqrt(words_in.reshape(total, _WORDS) / some[:, None])
        both = passage[1:] == passage[:-1]
        pair_of = (mix(hashes[:-1] + U64(1)) ^ hashes[1:]) * U64(0x9E3779B97F4A7C15) >> U64(58)
        pairs_in = np.bincount(passage[1:][both] * _PAIRS + pair_of[both].astype(np.int64), minlength=total * _PAIRS)
        out[:, slots + _WORDS: slots + _WORDS + _PAIRS] = np.sqrt(pairs_in.reshape(total, _PAIRS) / some[:, None])
        for column, group in ((-4, passage), (-3, rows)):
            order = np.lexsort((np.arange(len(hashes)), hashes, group))
            new = np.ones(len(order), bool)
            new[1:] = (group[order][1:] != group[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
            out[:, column] = np.bincount(passage[order][new], minlength=total) / some
        out[:, -2] = np.log1p(size)
        out[:, -1] = np.log1p(counts[owner]) / 4
    return out, owner


def _slices(n: int, step: int = 4096) -> list[slice]:
    return [slice(k, k + step) for k in range(0, n, step)]


class GatedAttention:
    """Encoder, gated attention and logistic layer over bags; plain numbers, so a fitted one is small and picklable."""

    def __init__(self, width: int = 32, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.p = {"W": draw(FEATURES, width), "b": np.zeros(width), "V": draw(width, gate), "U": draw(width, gate), "q": draw(gate), "c": draw(width), "c0": np.zeros(1)}
        self.mean, self.std = np.zeros(FEATURES), np.ones(FEATURES)

    def _forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        p = self.p
        # Features are standardised through the weights, so that there is no second matrix of them.
        weights, bias = p["W"] / self.std[:, None], p["b"] - (self.mean / self.std) @ p["W"]
        h = np.empty((len(x), len(bias)))
        for rows in _slices(len(x)):
            h[rows] = np.tanh(x[rows] @ weights + bias)
        tanh, gate = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (tanh * gate) @ p["q"]  # bounded by the norm of q: no overflow
        weight = np.exp(e)
        weight /= np.bincount(bag, weight, minlength=n)[bag]
        first = np.searchsorted(bag, np.arange(n))
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return {"h": h, "tanh": tanh, "gate": gate, "weight": weight, "z": z, "logit": z @ p["c"] + p["c0"][0], "first": first}

    def score(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-self._forward(x, bag, n)["logit"]))

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.02, decay: float = 1e-4) -> GatedAttention:
        """``bag`` ascends from 0; ``y`` is a 0/1 label for each bag. Labels weigh alike in sum."""
        self.mean = x.mean(axis=0, dtype=np.float64)
        self.std = np.sqrt(sum(((x[rows] - self.mean) ** 2).sum(axis=0) for rows in _slices(len(x))) / len(x)) + 1e-3
        n, p = len(y), self.p
        importance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / n
        first_moment, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for t in range(1, rounds + 1):
            f = self._forward(x, bag, n)
            h, weight = f["h"], f["weight"]
            d_logit = (1 / (1 + np.exp(-f["logit"])) - y) * importance
            d_z = d_logit[:, None] * p["c"]
            d_weight = (d_z[bag] * h).sum(axis=1)
            d_e = weight * (d_weight - np.add.reduceat(weight * d_weight, f["first"])[bag])
            both = f["tanh"] * f["gate"]
            d_tanh = d_e[:, None] * p["q"] * f["gate"] * (1 - f["tanh"] ** 2)
            d_gate = d_e[:, None] * p["q"] * both * (1 - f["gate"])
            d_h = (weight[:, None] * d_z[bag] + d_tanh @ p["V"].T + d_gate @ p["U"].T) * (1 - h**2)
            d_w = sum(x[rows].astype(np.float64).T @ d_h[rows] for rows in _slices(len(x)))
            d_w = (d_w - self.mean[:, None] * d_h.sum(axis=0)) / self.std[:, None]
            grad = {"W": d_w, "b": d_h.sum(axis=0), "V": h.T @ d_tanh, "U": h.T @ d_gate, "q": both.T @ d_e, "c": f["z"].T @ d_logit, "c0": np.array([d_logit.sum()])}
            for k in p:
                g = grad[k] + decay * p[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= rate * (first_moment[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, fit_rows: int = 3000, passage_words: int = 64,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> GatedAttention | float:
    """A model of ``labels`` (rows where ``use``, over the id, holds), or their mean where they have one value only."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if use is None else use))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
    sample = stratified_ids(known, "__id", "__y", fit_rows // 2, fit_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, to, d, o in chunks(*utf8(batch.column(2))):
                x, owner = passages(d, o, passage_words)
                rows = []
                for i in range(to - first):
                    rows.append(x[np.searchsorted(owner, i): np.searchsorted(owner, i, "right")].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, to - first), batch.column(1).slice(first, to - first), pa.array(rows, pa.binary())], ["id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    bags = texts.join(F.broadcast(sample), "__id").select("__id", "__y", "__text").mapInArrow(encode, "id long, y int, x binary")
    bags = bags.orderBy(F.xxhash64("id"), F.xxhash64("x")).limit(2 * fit_rows).collect()
    y = np.array([r.y for r in bags], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    sizes = [len(r.x) // (4 * FEATURES) for r in bags]
    x = np.empty((sum(sizes), FEATURES), np.float32)
    at = len(x)
    while bags:  # from the end, so that each row's copy goes when it has been read
        own = np.frombuffer(bags.pop().x, np.float32).reshape(-1, FEATURES)
        x[at - len(own): at] = own
        at -= len(own)
    return GatedAttention().fit(x, np.repeat(np.arange(len(sizes)), sizes), y)


def scores(docs: DataFrame, model: GatedAttention | float, passage_words: int = 64, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and the double ``name`` of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            found = [np.zeros(0)]
            for first, to, d, o in chunks(*utf8(batch.column(len(keep)))):
                found.append(np.full(to - first, model) if isinstance(model, float) else model.score(*passages(d, o, passage_words), to - first))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(found))], [*keep, name])

    return docs.select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "scored"))).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: GatedAttention | float, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``."""
    name = fresh(docs, "score")
    return scores(docs, model, text_col=text_col, keep=tuple(docs.columns), name=name).where(F.col(name) >= threshold).drop(name)
