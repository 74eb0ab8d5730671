"""Language identification by hierarchical discrimination.

A text's hashed letter pairs and triples (bytes of lower-cased text; all but letters counts as one gap) give a vector
of square-rooted counts of unit length. Linear support vector machines first tell the language family (one against the
rest); within the family, one machine for each pair of languages votes. Languages are put in families by
``FAMILIES``; a language that is not listed is a family of its own.

Fitting takes at most ``fit_rows`` labelled texts, about ``per_language`` of each language, picked by a hash of the
id; prediction reads every whole text in the scan's tasks, without a shuffle.

Nulls: a null text, or one without letters, is ``und`` with score 0; a null language is never learned; a null id is
carried and not held out. Repeated rows are predicted each, alike. Extra columns are ignored. Without any labelled
text all predictions are ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import stratified_ids
from ._text import chunks, utf8

#: Language families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn mr gu pa ur ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
    "sinitic": "zh yue",
}
DIMENSIONS = 2048
_GAP = 0x20
_LETTER = np.full(256, _GAP, np.uint8)
for _a, _z in ((97, 123), (128, 256)):
    _LETTER[_a:_z] = np.arange(_a, _z)
_LETTER[65:91] = np.arange(97, 123)
UNDETERMINED = "und"


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language.lower().split("-")[0] in members.split()), language)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unit vector of each row (zeros where it has no letters)."""
    n = len(offsets) - 1
    low = _LETTER[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * DIMENSIONS)
    for width in (2, 3):
        if len(low) < width:
            continue
        m = len(low) - width + 1
        code, gaps = np.zeros(m, np.uint32), np.zeros(m, np.uint8)
        for k in range(width):
            part = low[k: k + m]
            code = code * np.uint32(257) + part
            gaps += part == _GAP
        use = (row[:m] == row[width - 1:]) & (gaps < width - 1 if width > 2 else gaps < width)
        slot = (code * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64)  # 11 bits
        out += np.bincount(row[:m][use] * DIMENSIONS + slot[use], minlength=n * DIMENSIONS)
    out = np.sqrt(out.reshape(n, DIMENSIONS)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _parts(batch_column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of bounded bytes and number, for dense vectors."""
    for first, _, d, o in chunks(*utf8(batch_column)):
        for a in range(0, len(o) - 1, 512):
            cut = o[a: a + 513]
            yield first + a, first + a + len(cut) - 1, d[cut[0]: cut[-1]], cut - cut[0]


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; y is -1 or 1 and its sides weigh alike."""
    w, velocity = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    side = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    for _ in range(rounds):  # Nesterov steps; unit vectors and the bias bound the curvature by 4
        ahead = w + 0.9 * velocity
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        push = -2 * side * slack * y
        grad = np.append(x.T @ push, push.sum()) + 2 * ridge * np.append(ahead[:-1], 0)
        velocity = 0.9 * velocity - 0.25 * grad
        w = w + velocity
    return w


class Hierarchy:
    def __init__(self, x: np.ndarray, languages: list[str]):
        self.families: dict[str, list[str]] = {}
        for language in sorted(set(languages)):
            self.families.setdefault(family_of(language), []).append(language)
        self.names = sorted(self.families)
        label, family = np.array(languages), np.array([family_of(v) for v in languages])
        x = x.astype(np.float64)
        self.top = np.array([_svm(x, np.where(family == f, 1.0, -1.0)) for f in self.names]) if len(self.names) > 1 else None
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                own = (label == a) | (label == b)
                self.pairs[a, b] = _svm(x[own], np.where(label[own] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        sure = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -50, 50)))
        if self.top is None:
            chosen, certain = np.zeros(n, int), np.ones(n)
        else:
            margin = x @ self.top[:, :-1].T + self.top[:, -1]
            chosen = margin.argmax(axis=1)
            certain = sure(margin.max(axis=1))
        out, score = np.empty(n, object), np.zeros(n)
        for k, name in enumerate(self.names):
            own, members = np.flatnonzero(chosen == k), self.families[name]
            votes = np.zeros((len(own), len(members)))
            for a, b in combinations(range(len(members)), 2):
                w = self.pairs[members[a], members[b]]
                p = sure(x[own] @ w[:-1] + w[-1])
                votes[:, a] += (p >= 0.5) + 1e-3 * p  # the sum of certainties settles even votes
                votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
            best = votes.argmax(axis=1) if len(members) > 1 else np.zeros(len(own), int)
            out[own] = [members[i] for i in best]
            share = (votes[np.arange(len(own)), best] % 1) * 1e3 / (len(members) - 1) if len(members) > 1 else np.ones(len(own))
            score[own] = certain[own] * np.clip(share, 0, 1)
        return out.tolist(), np.clip(score, 0, 1)


def fit(docs: DataFrame, use: Column | None = None, per_language: int = 1200, fit_rows: int = 5000,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """A model of the rows of ``docs`` with a language where ``use``, over the id, holds; None without any."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.lit(True) if use is None else use))
    known = known.select(F.col(id_col).cast("long").alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text"))
    sample = stratified_ids(known, "__id", "__lang", per_language, fit_rows).distinct()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, to, d, o in _parts(batch.column(2)):
                x = features(d, o)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, to - first), batch.column(1).slice(first, to - first), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "lang", "x"])

    rows = known.join(F.broadcast(sample), ["__id", "__lang"]).select("__id", "__lang", "__text").mapInArrow(encode, "id long, lang string, x binary")
    rows = rows.orderBy(F.xxhash64("id"), "lang", F.xxhash64("x")).limit(2 * fit_rows).collect()
    if not rows:
        return None
    return Hierarchy(np.array([np.frombuffer(r.x, np.float32) for r in rows]), [r.lang for r in rows])


def predict(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            column = batch.column(len(keep))
            names, score = [], []
            for first, to, d, o in _parts(column):
                found, certain = model.predict(features(d, o)) if model else ([UNDETERMINED] * (to - first), np.zeros(to - first))
                ascii_letter = (_LETTER[d] != _GAP) & (d < 128)
                for i in np.flatnonzero(np.diff(np.append(0, np.cumsum(ascii_letter))[o]) == 0):
                    text = column[first + int(i)].as_py() or ""
                    if not any(c.isalpha() for c in text):
                        found[i], certain[i] = UNDETERMINED, 0.0
                names += found
                score.append(certain)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
