"""BPE encoding and decoding: batched numpy merge rounds over the symbols of many words in one flat array."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import long, map_texts, string

# Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies, as the public format defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a task remembers; beyond that it forgets all and begins anew.
WORDS_KEPT = 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers JSON file, without its Python library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) > 0] if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks, self.made = keys[order][first], order[first].astype(np.int64), made[order][first]
        self.special = added
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        value = {c: b for b, c in enumerate(letters)}
        spelled = [b""] * self.size
        for word, at in vocab.items():
            spelled[at] = bytes(value[c] for c in word)
        for word, at in added.items():
            spelled[at] = word.encode()
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has. Each round merges the lowest-rank pair of every word."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_of, none = [], [], len(self.keys)
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), max(none - 1, 0))
            fits = (self.keys[at] == key) & (of[:-1] == of[1:]) if none else np.zeros(len(key), bool)
            rank = np.append(np.where(fits, self.ranks[at], none), none)
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            counts = np.diff(np.r_[heads, len(of)])
            least = np.repeat(np.minimum.reduceat(rank, heads), counts)
            ended = least == none
            done_symbols.append(symbols[ended])
            done_of.append(of[ended])
            hit = (rank == least) & ~ended
            # in a run of one repeated symbol, every second pair overlaps the one before it
            begins = hit & ~np.r_[False, hit[:-1]]
            where = np.arange(len(hit))
            hit &= (where - np.maximum.accumulate(np.where(begins, where, 0))) % 2 == 0
            spots = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[spots] = self.made[at[spots]]
            stays = ~ended
            stays[spots + 1] = False
            symbols, of = symbols[stays], of[stays]
        of, symbols = np.concatenate(done_of), np.concatenate(done_symbols)
        return symbols[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.spelled[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


class BatchCoder:
    """Encodes lists of texts; words met before are looked up."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.find = bpe, regex.compile(PATTERN).findall
        self.forget()

    def forget(self):
        self.seen: defaultdict = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.flat = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def words(self, text: str) -> list:
        """Pre-tokens of a text; a special token stands as its id."""
        if self.bpe.split is None:
            return self.find(text)
        special, found = self.bpe.special, []
        for part in self.bpe.split(text):
            found += [special[part]] if part in special else self.find(part)
        return found

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > WORDS_KEPT:
            self.forget()
        known, place = len(self.seen), self.seen.__getitem__
        rows = [np.fromiter(map(place, self.words(t)), np.int64) for t in texts]
        new = list(islice(self.seen, known, None))
        flat, counts = self.bpe.merge([b"\x00" if isinstance(w, int) else w.encode() for w in new])
        heads = np.cumsum(counts) - counts
        for k, w in enumerate(new):
            if isinstance(w, int):
                flat[heads[k]] = w
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        heads = np.cumsum(self.counts) - self.counts
        every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sizes = self.counts[every]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(heads[every] - (ends - sizes), sizes) + np.arange(total)]
        cuts = np.cumsum([len(r) for r in rows])
        bounds = np.r_[0, np.where(cuts > 0, np.r_[0, ends][cuts], 0)] if rows else [0]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False, decoded: bool = False) -> DataFrame:
    """Adds n_tokens and, as asked, `ids` (array of int), `decoded` (text) and the digests ids_sha256 and decoded_sha256.

    A null or empty text has no tokens, empty ids and the digests of nothing. Whole texts of any length are encoded; a
    row's result depends on its text alone, so ties and repeated rows repeat it. Input columns with a result's name are
    replaced. An empty table gives an empty result. path: the vocabulary file, readable on every executor.
    """
    fields = [long("n_tokens")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if ids else []
    fields += [string("ids_sha256"), string("decoded_sha256")] if digests else []
    fields += [string("decoded")] if decoded else []

    def make():
        bpe = ByteBPE(path)
        coder = BatchCoder(bpe)

        def run(texts):
            rows = coder([t or "" for t in texts])
            out: list = [[len(r) for r in rows]]
            if ids:
                out.append([r.astype(np.int32) for r in rows])
            back = [bpe.decode(r).decode("utf-8", "replace") for r in rows] if digests or decoded else []
            if digests:
                out.append([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows])
                out.append([hashlib.sha256(x.encode()).hexdigest() for x in back])
            if decoded:
                out.append(back)
            return out

        return run

    return map_texts(docs, text_col, fields, make, keep)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that an array of ids stands for; null ids give a null text, no ids an empty one, as do ids outside the vocabulary."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def back(ids):
        bpe = back.bpe = getattr(back, "bpe", None) or ByteBPE(path)
        rows = [None if x is None else np.asarray(x, np.int64) for x in ids]
        return ids.__class__([None if x is None else bpe.decode(x[(x >= 0) & (x < bpe.size)]).decode("utf-8", "replace") for x in rows])

    return encoded.withColumn(out_col, back(F.col(ids_col)))
