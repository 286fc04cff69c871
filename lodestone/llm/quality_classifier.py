"""Quality classifier: labelled latent-semantic vectors of words, word shapes and repetition are broadcast, and every text's nearest neighbours among them vote."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from lodestone.llm import labelled
from lodestone.llm.common import double, map_texts, ship

#: Labelled rows of each class at most; their vectors are all that is broadcast: 2 * PER_CLASS * DIMENSIONS floats.
PER_CLASS = 1500
#: Hashed terms of shapes and ratios, and as many of words, latent dimensions, voting neighbours, and the power to which similarity weighs a vote.
TERMS = 2048
DIMENSIONS = 48
NEIGHBOURS = 15
POWER = 8
#: Further directions that the orthogonal iteration carries, and its steps.
EXTRA = 16
ITERATIONS = 20
#: Texts scored at once.
BLOCK = 512
#: Different words whose shape a task remembers.
WORDS_KEPT = 100_000
#: Steps of the measured ratios, each of which is a term, and the weight of such a term.
STEPS = 10
RATIO_WEIGHT = 4.0
#: Weight of a word against that of its shape.
WORD_WEIGHT = 0.25

_CLASSES = ((re.compile(r"[^\W\d_]+"), lambda m: "U" if m[0].isupper() else "u" if m[0][0].isupper() and m[0][1:].islower() else "l" if m[0].islower() else "m"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"([^\w])\1+"), lambda m: m[1] * 2))


def shape(word: str) -> str:
    """A word with each run of letters, digits or one symbol put as its kind."""
    for find, kind in _CLASSES:
        word = find.sub(kind, word)
    return word


class Shapes(dict):
    """Term numbers of words, by shape."""

    def __init__(self):
        self.of_shape: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
            self.of_shape.clear()
        if word.isalpha() and word.islower():
            kind = "l"
        elif word[:-1].isalpha() and word[:-1].islower() and not word[-1].isalnum():
            kind = "l" + word[-1]
        else:
            kind = shape(word)
        n = self.of_shape.get(kind)
        if n is None:
            n = self.of_shape[kind] = zlib.crc32(kind.encode()) % TERMS
        self[word] = n
        return n


class Words(dict):
    """Term numbers of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        n = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % TERMS
        return n


def ratio_terms(words: list[str], lines: list[str], chars: int) -> list[int]:
    """Terms for the share of different words, of repeated windows and of repeated lines, the mean length of words and lines, and the size."""
    n = len(words)
    h = np.fromiter(map(hash, words), np.int64, n)
    window = h[:-2] * 3 + h[1:-1] * 5 + h[2:] * 7 if n > 2 else h
    again = 1 - len(np.unique(window)) / max(len(window), 1)
    full = [x for x in lines if x and not x.isspace()]
    shares = (len(set(words)) / n, again, 1 - len(set(full)) / max(len(full), 1), min(chars / n / 20, 1), min(n / max(len(full), 1) / 100, 1), min(np.log1p(n) / 10, 1))
    return [zlib.crc32(b"%d:%d" % (k, min(int(x * STEPS), STEPS - 1))) % TERMS for k, x in enumerate(shares)]


class Terms:
    """Weighted term vectors of texts: shapes, pairs of shapes and ratios, then words."""

    def __init__(self):
        self.number, self.word = Shapes().__getitem__, Words().__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(2 * TERMS, np.float32)
        at = np.fromiter(map(self.number, words), np.int64, len(words))
        pairs = (at[:-1] * 31 + at[1:] * 17 + 7) % TERMS
        # shares, so that a long text does not differ from a short one of its kind
        counts = (np.bincount(at, minlength=TERMS) + 0.5 * np.bincount(pairs, minlength=TERMS)) / len(words)
        own = np.bincount(np.fromiter(map(self.word, words), np.int64, len(words)), minlength=TERMS) / len(words)
        out = np.sqrt(np.concatenate([counts, own])).astype(np.float32)
        out[TERMS:] *= np.float32(WORD_WEIGHT)
        np.add.at(out, ratio_terms(words, text.split("\n"), sum(map(len, words))), np.float32(RATIO_WEIGHT / 10))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def principal(x: np.ndarray) -> np.ndarray:
    """The DIMENSIONS leading right singular vectors of x, as columns, by orthogonal iteration: it holds no second matrix of x's size."""
    size = min(DIMENSIONS + EXTRA, *x.shape)
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((x.shape[1], size)))
    for _ in range(ITERATIONS):
        q, _ = np.linalg.qr((x.T @ (x @ q.astype(np.float32))).astype(np.float64))
    _, _, turn = np.linalg.svd(x @ q.astype(np.float32), full_matrices=False)
    return (q @ turn.T)[:, :DIMENSIONS]


@dataclass
class Model:
    """weights and basis take term vectors to latent ones; vectors and y are the labelled rows; prior is the share of label 1."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    prior: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        return unit(unit(terms * self.weights) @ self.basis)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors; without any like it, the prior."""
        if not len(self.y):
            return np.full(len(terms), self.prior)
        out = np.empty(len(terms))
        k = min(NEIGHBOURS, len(self.y))
        for begin in range(0, len(terms), BLOCK):
            near = self.latent(terms[begin : begin + BLOCK]) @ self.vectors.T
            top = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(1)
            out[begin : begin + BLOCK] = np.where(total > 0, (weight * self.y[top]).sum(1) / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits on at most per_class labelled rows of each class; usable says which label rows may be learned from.

    Without labelled rows every score is 0.5; with one class alone, its label.
    """
    chosen = labelled.sample(labels, label_col, usable, per_class, id_col)

    def make():
        terms = Terms()
        return lambda texts: [[terms(t).astype(np.float16).tobytes() for t in texts]]

    field = T.StructField("terms", T.BinaryType())
    rows = map_texts(labelled.texts(docs, chosen, id_col, text_col), "text", [field], make, ["y"]).toArrow()  # at most 2 * per_class rows
    y = rows.column("y").to_numpy().astype(np.float64)
    x = np.zeros((len(y), 2 * TERMS), np.float16)
    for k, v in enumerate(rows.column("terms")):
        x[k] = np.frombuffer(v.as_buffer(), np.float16)
    del rows
    order = np.lexsort((x.astype(np.float32) @ np.sin(np.arange(2 * TERMS, dtype=np.float32)), y))  # whatever order the rows came in
    x, y = x[order].astype(np.float32), y[order]
    weights = np.log1p((1 + len(y)) / (1 + (x > 0).sum(0))).astype(np.float32)
    if not len(y):
        return Model(weights, np.zeros((2 * TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    model = Model(weights, principal(unit(x * weights)).astype(np.float32), np.zeros((0, 1)), y, float(y.mean()))
    model.vectors = model.latent(x).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None, least: float | None = None) -> DataFrame:
    """Adds score_col, the vote for label 1 between 0 and 1; with least, returns only rows of that score or more, without it.

    Null and empty texts get the prior. A row's score depends on its text alone, so ties and repeated rows repeat it; an
    input column named score_col is replaced. Whole texts count; an empty table gives an empty result.
    """
    shared = ship(docs.sparkSession, model)

    def make():
        terms, known = Terms(), shared()

        def run(texts):
            out = [known.score(np.stack([terms(t) for t in texts[k : k + BLOCK]])) for k in range(0, len(texts), BLOCK)]
            found = np.concatenate(out) if out else np.zeros(0)
            return [found] if least is None else [found >= least]

        return run

    field = double(score_col) if least is None else T.StructField(score_col, T.BooleanType())
    return map_texts(docs, text_col, [field], make, keep, where=None if least is None else 0)
