"""Toxicity: obfuscated words are restored by Viterbi decoding of character lattices, and restored text is scored by a learned lexicon."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import labelled
from lodestone.llm.common import chunks, double, map_texts, materialise, remove, ship

#: One in so many clean rows is read first, to leave out features that these alone show to be none of the lexicon.
FIRST = 16
#: Beginnings of words that are features besides the whole word.
PREFIXES = (4, 5, 6)
#: A feature is in the lexicon from this log-likelihood ratio against the share of toxic rows, and this share of toxic rows among its own.
LEAST_EVIDENCE = 16.0
LEAST_SHARE = 0.75
#: Features in the lexicon at most, by evidence, and words and contexts in the language model, by counts over all rows: they bound what is broadcast.
LEXICON = 20_000
CONTEXTS = 60_000
#: Different words that a task remembers.
WORDS_KEPT = 300_000
#: Log-costs of the channel: a letter that stands for itself is free; a separator between letters may end a word.
SWAP_COST = 1.0
KEEP_RUN_COST = 0.5
BREAK_COST = 3.0

# Letters that digits and symbols stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_SYMBOLS = re.compile(r"(\W)\1\1+")
_ODD = re.compile(r"[0-9@$!|+(€£¡]")
_RUN = re.compile(r"([^\W\d_])\1")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_NUMBER = re.compile(r"^\d+(?:\W+\d+)*$")
_DOTTED = re.compile(r"^\w(?:[.\-_*~·]+[\w@$!]){2,}$")
_SPACED = re.compile(r"(?<![^\s\"'“‘«(\[])[^\W_]?[\w@$!|](?:[ \t.\-_*]+[\w@$!|]){3,}(?=[.,;:?!\"'”’»)\]]*(?:\s|$))")
_SEPARATOR = re.compile(r"[\s.\-_*~·]+")
_BREAK = " "
_LETTER = re.compile(r"[^\W\d_]")


def plain(token: str) -> str:
    """A token in lower case without symbols around it."""
    return _EDGE.sub("", _SYMBOLS.sub("", token.lower()))


@dataclass
class CharModel:
    """Interpolated character trigrams of words, as log-probabilities by context."""

    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)
    letters: int = 64

    @classmethod
    def train(cls, words: Counter) -> CharModel:
        """words: how often each occurs; its logarithm counts."""
        counts: dict[str, Counter] = {}
        for word, n in words.items():
            weight = 1 + int(log(n))
            text = "^^" + word + "$"
            for k in range(2, len(text)):
                for size in (0, 1, 2):
                    counts.setdefault(text[k - size : k], Counter())[text[k]] += weight
        kept = sorted(counts, key=lambda c: (len(c), -sum(counts[c].values()), c))[:CONTEXTS]
        return cls({c: dict(counts[c]) for c in kept}, {c: sum(counts[c].values()) for c in kept})

    def logp(self, before: str, char: str) -> float:
        p = 1 / self.letters
        for size in (0, 1, 2):
            context = before[len(before) - size :]
            if total := self.totals.get(context):
                p = (self.counts[context].get(char, 0) + 4 * p) / (total + 4)
        return log(p)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, what it may stand for, with the cost.

    A separator between letters stands for nothing or for the end of a word; one that is longer than the token's usual
    separator, as between words of spaced letters, ends a word unless that costs more than going on.
    """
    gaps = _SEPARATOR.findall(token)
    usual = min(map(len, gaps)) if gaps else 0
    steps, at = [], 0
    while at < len(token):
        if m := _SEPARATOR.match(token, at):
            steps.append([("", BREAK_COST), (_BREAK, 0.0)] if len(m[0]) > usual else [("", 0.0), (_BREAK, BREAK_COST)])
            at = m.end()
            continue
        char, size = _run(token, at)
        at += size
        options = []
        if _LETTER.match(char):
            options.append((char, 0.0))
        for letter in LEET.get(char, ""):
            options.append((letter, SWAP_COST))
        if not options:
            options = [(char, 0.0)] if char.isalnum() else [("", 0.0)]
        if size > 1:
            options += [(c * 2, cost + KEEP_RUN_COST * (size > 2)) for c, cost in options if c]
        steps.append(options)
    return steps


def _run(token: str, at: int) -> tuple[str, int]:
    """The character at a place and how often it stands there in a row."""
    end = at + 1
    while end < len(token) and token[end] == token[at]:
        end += 1
    return token[at], end - at


def viterbi(token: str, model: CharModel) -> str:
    """The most probable words behind a token: the best path through its lattice under the language model and the channel.

    A state is the last two letters. A step has at most four options, of two letters, so there are few states and all of
    them are kept: the path is the best one.
    """
    best = {"^^": (0.0, "")}
    for options in lattice(token):
        new: dict[str, tuple[float, str]] = {}
        for state, (total, out) in best.items():
            for letters, cost in options:
                at, sum_ = state, total - cost
                for c in letters:
                    if c == _BREAK:
                        sum_ += model.logp(at, "$")
                        at = "^^"
                    else:
                        sum_ += model.logp(at, c)
                        at = at[-1] + c
                if at not in new or sum_ > new[at][0]:
                    new[at] = (sum_, out + letters)
        best = new
    return max(best.items(), key=lambda x: x[1][0] + model.logp(x[0], "$"))[1][1]


def features(word: str) -> list[str]:
    return [f"={word}"] + [f"^{word[:k]}" for k in PREFIXES if len(word) >= k]


class Plain(dict):
    """plain() of tokens, remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[token] = plain(token)
        return found

    def words(self, text: str) -> list[str]:
        return [self[t] for t in text.split()]


def context(words: list[str], at: int) -> int:
    """The 64-bit hash of the words around a place."""
    return xxhash.xxh3_64_intdigest(f"{words[at - 1] if at else ''} {words[at + 1] if at + 1 < len(words) else ''}") - 2**63


def places(words: list[str]) -> dict[str, int]:
    """Each word's first place."""
    found = dict(zip(reversed(words), range(len(words) - 1, -1, -1), strict=True))
    found.pop("", None)
    return found


def met(words: list[str], at: dict[str, int], wanted: Callable[[str], Iterable[str]] = features) -> list[tuple[str, int]]:
    """The features wanted of a text's words, each with the context of its first place."""
    first: dict[str, int] = {}
    for w, k in at.items():
        for f in wanted(w):
            if k < first.get(f, len(words)):
                first[f] = k
    return [(f, context(words, k)) for f, k in first.items()]


class Wanted(dict):
    """For each word those of its features that are among the candidates."""

    def __init__(self, candidates: frozenset[str]):
        self.candidates = candidates

    def __missing__(self, word: str) -> tuple:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = tuple(f for f in features(word) if f in self.candidates)
        return found


def _contexts(texts: DataFrame) -> DataFrame:
    """f, y and context of every feature of every text."""

    def run(batches):
        plain_of = Plain()
        for batch in batches:
            for part in chunks(batch, 1):
                rows = []
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = plain_of.words(text)
                    rows += [(f, y, c) for f, c in met(words, places(words))]
                f, y, c = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32()), pa.array(c, pa.int64())], names=["f", "y", "context"])

    return texts.select("y", "text").mapInArrow(run, "f string, y int, context long")


def _counted(texts: DataFrame, candidates: frozenset[str]) -> DataFrame:
    """Two kinds of rows over all texts: f, n and good, summed in each task, say how many rows, and clean rows, have a word of letters; f and context say where candidates stand in clean rows."""
    shared = ship(texts.sparkSession, candidates)

    def run(batches):
        wanted, plain_of, sums = Wanted(shared()), Plain(), (Counter(), Counter())

        def flush():
            every = [w for w in sums[0].keys() | sums[1].keys() if w.isalpha()]
            good = [sums[0][w] for w in every]
            n = [g + sums[1][w] for g, w in zip(good, every, strict=True)]
            for s in sums:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array(n, pa.int64()), pa.array(good, pa.int64()), pa.nulls(len(every), pa.int64())], names=["f", "n", "good", "context"])

        for batch in batches:
            for part in chunks(batch, 1):
                rows = []
                for y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = plain_of.words(text)
                    at = places(words)
                    sums[y].update(at.keys())
                    if not y:
                        rows += met(words, at, wanted.__getitem__)
                f, c = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.nulls(len(f), pa.int64()), pa.nulls(len(f), pa.int64()), pa.array(c, pa.int64())], names=["f", "n", "good", "context"])
                if len(sums[0]) + len(sums[1]) >= WORDS_KEPT:
                    yield flush()
        yield flush()

    return texts.select("y", "text").mapInArrow(run, "f string, n long, good long, context long")


@dataclass
class Model:
    """lexicon: features with the smoothed share of toxic rows; chars restores words; prior scores texts without any; known: frequent words of clean rows, whose doubled letters obscure nothing."""

    lexicon: dict[str, float]
    chars: CharModel
    prior: float
    known: frozenset[str] = frozenset()


class Words(dict):
    """For each token the lexicon features of it and of its restored form, as a tuple, mostly empty."""

    def __init__(self, model: Model):
        self.model = model
        self.begins = {f[1 : 1 + PREFIXES[0]] for f in model.lexicon}

    def restored(self, token: str) -> list[str]:
        """The plain word, and its decoded form if digits, symbols or repetitions may obscure it.

        Plain numbers and known words with doubled letters stand for themselves.
        """
        word = plain(token)
        forms = [word]
        odd = _ODD.search(word) and not _NUMBER.match(word)
        if odd or _LONG_RUN.search(word) or _DOTTED.match(word) or _RUN.search(word) and word not in self.model.known:
            forms.append(viterbi(word, self.model.chars))
        raw = _SYMBOLS.sub("", token.lower())
        if raw != word and _ODD.search(raw) and (_LETTER.search(raw) or odd):  # a symbol at an edge may stand for a letter
            forms.append(viterbi(raw.strip(".,;:?%&#*\"'"), self.model.chars))
        return forms

    def __missing__(self, token: str) -> tuple:
        if len(self) >= WORDS_KEPT:
            self.clear()
        word = token if token.isalpha() else token[:-1] if token[-1:] in ".,;:?" else ""
        lower = word.lower()
        clear = not _RUN.search(lower) or lower in self.model.known and not _LONG_RUN.search(lower)
        if word.isalpha() and clear and lower[: PREFIXES[0]] not in self.begins:
            self[token] = ()  # nothing to restore, and no feature begins like it
            return ()
        found = self[token] = self.features(" ".join(self.restored(token)))
        return found

    def features(self, words: str) -> tuple:
        return tuple(dict.fromkeys(f for w in words.split() for f in features(w) if f in self.model.lexicon))

    def spaced(self, letters: str) -> str:
        """The words behind letters set apart, decoded in one lattice."""
        return viterbi(letters.strip().lower(), self.model.chars)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, Words(model)

    def evidence(self, text: str | None) -> set[str]:
        """Lexicon features of a text's words, as they stand, restored, and decoded from spaced letters."""
        if not text:
            return set()
        found = {f for hit in map(self.words.__getitem__, text.split()) if hit for f in hit}
        for m in _SPACED.finditer(text):
            found.update(self.words.features(self.words.spaced(m[0])))
        return found

    def __call__(self, text: str | None) -> float:
        clean = 1 - self.model.prior
        for f in self.evidence(text):
            clean *= 1 - self.model.lexicon[f]
        return min(max(1 - clean, 0.0), 1.0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns the lexicon and the character model from all labelled rows; of near copies one stands for all.

    A feature counts once for each context it has in toxic rows, and in clean ones: a passage that rows share shows its
    words in one context. Toxic rows and some clean ones are counted first. More clean rows only lower a feature's share
    of toxic ones, so what falls short already is left out; the others are counted over all clean rows, so that the
    lexicon is that of all rows. Without toxic rows it is empty and every score is the same, under 0.5.
    """
    chosen = materialise(labelled.every(labels, label_col, usable, id_col), "labels")
    rows = materialise(labelled.once(docs, chosen, id_col, text_col), "labelled")
    n = dict(rows.groupBy("y").count().collect())
    share = n.get(1, 0) / max(sum(n.values()), 1)
    if not 0 < share < 1:
        return Model({}, CharModel(), 0.02)
    first = materialise(rows.where((F.col("y") == 1) | (F.pmod("text_key", F.lit(FIRST)) == 0)), "first")
    each = _contexts(labelled.all_texts(docs, first, id_col, text_col)).distinct()
    counts = each.groupBy("f").agg(F.count(F.when(F.col("y") == 1, 1)).alias("bad"), F.count(F.when(F.col("y") == 0, 1)).alias("good"))
    p = (F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1)
    evidence = F.col("bad") * F.log(p / share) + F.col("good") * F.log((1 - p) / (1 - share))
    # with that share, good is at most bad * (1 - LEAST_SHARE) / LEAST_SHARE, which bounds the evidence
    most = F.col("bad") * (-log(share) - log(1 - share) * (1 - LEAST_SHARE) / LEAST_SHARE)
    candidates = materialise(counts.where((p >= LEAST_SHARE) & (most >= LEAST_EVIDENCE)).select("f", "bad"), "candidates")
    counted = materialise(_counted(labelled.all_texts(docs, rows, id_col, text_col), frozenset(r.f for r in candidates.collect())), "counted")
    good = counted.where("n is null").select("f", "context").distinct().groupBy("f").agg(F.count("*").alias("good"))
    exact = candidates.join(good, "f", "left").na.fill(0, ["good"]).withColumn("p", p)
    top = exact.where((p >= LEAST_SHARE) & (evidence >= LEAST_EVIDENCE)).orderBy(evidence.desc(), "f").limit(LEXICON).select("f", "p").collect()
    common = counted.where("n is not null").groupBy("f").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy(F.desc("n"), "f").limit(CONTEXTS).collect()
    words = Counter({r.f: r.n for r in common})
    for r in top:  # words that mark toxic rows are what the channel hides
        if r.f[0] == "=":
            words[r.f[1:]] *= 20
    lexicon = {r.f: r.p for r in top}
    for made in (chosen, rows, first, candidates, counted):
        remove(made)
    return Model(lexicon, CharModel.train(words), 0.02, frozenset(r.f for r in common if r.good and f"={r.f}" not in lexicon))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds score_col: the chance, between 0 and 1, that some lexicon feature of the restored text marks it as toxic.

    Null and empty texts get the model's prior. A row's score depends on its text alone, so ties and repeated rows repeat
    it; an input column named score_col is replaced. Whole texts are read; an empty table gives an empty result.
    """
    shared = ship(docs.sparkSession, model)

    def make():
        scorer = Scorer(shared())
        return lambda texts: [[scorer(t) for t in texts]]

    return map_texts(docs, text_col, [double(score_col)], make, keep)


def restore(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "restored") -> DataFrame:
    """Adds out_col, the text with each obscured word, and words of spaced letters, replaced by their decoded form.

    A null text stays null and an empty one empty. A row's result depends on its text alone, so ties and repeated rows
    repeat it; an input column named out_col is replaced. Whole texts are read; an empty table gives an empty result.
    """
    shared = ship(docs.sparkSession, model)

    def make():
        words = Words(shared())

        def one(m) -> str:
            forms = words.restored(m[0])
            return forms[-1] if len(forms) > 1 else m[0]

        def whole(text: str | None) -> str | None:
            return text if text is None else re.sub(r"\S+", one, _SPACED.sub(lambda m: words.spaced(m[0]), text))

        return lambda texts: [[whole(t) for t in texts]]

    return map_texts(docs, text_col, [T.StructField(out_col, T.StringType())], make)
