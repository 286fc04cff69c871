"""LM scoring: a gated recurrent word model with a class-factored softmax, trained in numpy on every training text, beside corpus-wide unigram counts.

Texts become numbers once: chunks of texts carry their own dictionaries, whose words are counted over the corpus by hash
and come back to their chunk with count and number. The network then trains in rounds. Training texts are dealt by hash to
rounds and shards whose number follows from the tokens alone; in a round every shard trains a copy, on its texts in the
order of their hashes, and the copies' mean is the next model. So each text is learned from once, a shard's work is
bounded, and neither partitions nor machines matter to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import chunks, materialise, remove, ship

#: Words with an output of their own: one for so many training tokens, between these bounds; embedding and state size, and classes of rare words.
TOKENS_A_WORD = 1_500
LEAST_FREQUENT = 600
FREQUENT = 8_000
EMBED = 8
STATE = 8
RARE = 24
#: Steps between gradient updates, texts or stretches of text side by side in training and in scoring.
STEPS = 16
LANES = 512
SCORED = 4096
#: States whose outputs are found at once in scoring.
OUTPUTS = 16_384
#: Rounds of training, and the training tokens of a shard in a round, on average.
ROUNDS = 4
SHARD_TOKENS = 1_000_000
RATE = 0.1
#: Models that the driver averages at the end of a round.
LAST_MEANS = 16
#: Partitions of a round at most; a partition trains its shards one after another.
TRAINERS = 20_000
#: Bytes of text in a chunk, whose words make one dictionary, and tokens scored at once.
CHUNK = 8_000_000
AT_ONCE = 2_000_000
#: A word that stands twice in so many chunks is counted apart, at most so many words: no task sorts its rows.
HOT_CHUNKS = 32
HOT_WORDS = 50_000



def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts, one after another, and how many each has: words, lower-cased A-Z, split at ASCII white space, and one end (empty)."""
    whole = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # the space before the end keeps a place for it
    parts = pc.ascii_split_whitespace(pc.binary_join_element_wise(whole, "", " "))
    words, lengths = pc.list_flatten(parts), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(whole, "").to_numpy(zero_copy_only=False)
    if blank.any():  # of an empty text the join gives two empty parts
        keep = np.ones(len(words), bool)
        keep[(np.cumsum(lengths) - lengths)[blank & (lengths > 1)]] = False
        words, lengths = words.filter(pa.array(keep)), np.where(blank, 1, lengths)
    return words, lengths


def rare_classes(words: pa.Array) -> np.ndarray:
    """Classes of words by their last two bytes."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    size = np.diff(ends)
    byte = lambda k: np.where(size >= k, data[np.maximum(ends[1:] - k, 0)] if len(data) else 0, 0).astype(np.int64)
    return ((byte(2) * 31 + byte(1)) * 0x9E3779B1 >> 16) % RARE


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


@dataclass
class Vocabulary:
    """words: hashes of the frequent ones, most frequent first, and their counts; rare_n, rare_v: tokens and words of each rare class; n, v: of all."""

    words: list[int]
    counts: np.ndarray
    rare_n: np.ndarray
    rare_v: np.ndarray
    n: int
    v: int

    def __post_init__(self):
        k = len(self.words)
        # classes of like probability mass, by the square root of counts
        mass = np.cumsum(np.sqrt(np.maximum(self.counts, 1)))
        of = np.minimum((mass / mass[-1] * np.ceil(np.sqrt(k))).astype(int), int(np.ceil(np.sqrt(k))) - 1) if k else np.zeros(0, int)
        _, self.of = np.unique(of, return_inverse=True)
        self.starts = np.r_[np.flatnonzero(np.r_[True, np.diff(self.of) > 0]), k] if k else np.zeros(1, int)
        self.classes = len(self.starts) - 1
        end = word_hash(b"")
        self.end = self.words.index(end) if end in self.words else k + int(rare_classes(pa.array([b""]))[0])


class Gru:
    """The network. Parameters are float32 arrays by name; caches are the sums of squared gradients that damp each one's steps."""

    NAMES = ("E", "W", "U", "b", "Wc", "bc", "Wo", "bo")

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        k, out = len(v.words), v.classes + RARE
        g = np.random.default_rng(7)
        normal = lambda *shape: (g.standard_normal(shape) * 0.1).astype(np.float32)
        mass = np.r_[np.bincount(v.of, v.counts + 1, v.classes) if k else np.zeros(0), v.rare_n + v.rare_v + 1]
        # at first the output is the smoothed unigram distribution of the whole corpus
        self.p = {"E": normal(k + RARE, EMBED), "W": normal(EMBED, 3 * STATE), "U": normal(STATE, 3 * STATE), "b": np.zeros(3 * STATE, np.float32), "Wc": np.zeros((STATE, out), np.float32), "bc": np.log(mass / mass.sum()).astype(np.float32), "Wo": np.zeros((k, STATE), np.float32), "bo": np.log(v.counts + 1.0).astype(np.float32)}
        self.cache = {x: np.full_like(y, 1e-5) for x, y in self.p.items()}

    def pack(self) -> np.ndarray:
        return np.concatenate([part[x].ravel() for part in (self.p, self.cache) for x in self.NAMES]).astype(np.float32)

    def unpack(self, packed: np.ndarray):
        at = 0
        for part in (self.p, self.cache):
            for x in self.NAMES:
                size = part[x].size
                part[x] = packed[at : at + size].reshape(part[x].shape).astype(np.float32)
                at += size

    def forward(self, table: np.ndarray, inputs: np.ndarray, first: np.ndarray, active: list[int], h: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States after each step of a window, of its active rows, one after another; h is carried on in place.

        inputs and first are by (step, row); where first holds, a text begins and the state is put to zero.
        """
        s, U, states = STATE, self.p["U"], []
        half, one = np.float32(0.5), np.float32(1)
        for t, n in enumerate(active):
            if not n:
                break
            g, before = table.take(inputs[t, :n], axis=0), h[:n].copy()
            if first[t, :n].any():
                before[first[t, :n]] = 0
            u = before @ U
            zr = g[:, : 2 * s] + u[:, : 2 * s]
            zr *= half
            np.tanh(zr, zr)
            zr += one
            zr *= half
            z, r, un = zr[:, :s], zr[:, s:], u[:, 2 * s :]
            new = r * un
            new += g[:, 2 * s :]
            np.tanh(new, new)
            after = before - new
            after *= z
            after += new
            h[:n] = after
            states.append(after)
            if kept is not None:
                kept.append((before, z, r, un, new))
        return np.concatenate(states) if states else np.zeros((0, s), np.float32)

    def output(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each target's class, and of a frequent word within it; with grads also the gradient by state."""
        p, v, k = self.p, self.v, len(self.v.words)
        known = targets < k
        wanted = np.where(known, v.of[np.minimum(targets, max(k - 1, 0))] if k else 0, v.classes + targets - k)
        logits = states @ p["Wc"]
        logits += p["bc"]
        logits -= logits.max()
        rows, ones = np.arange(len(targets)), np.ones(max(logits.shape[1], np.diff(v.starts).max(initial=0)), logits.dtype)
        every = np.ones(len(targets), logits.dtype)
        logp = logits[rows, wanted]
        e = np.exp(logits, logits)
        total = e @ ones[: e.shape[1]]
        logp -= np.log(total)
        back = None
        if grads is not None:
            e *= (1 / total)[:, None]
            e[rows, wanted] -= 1
            grads["Wc"] += states.T @ e
            grads["bc"] += every @ e
            back = e @ p["Wc"].T
        order = np.flatnonzero(known)
        order = order[np.argsort(wanted[order].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(wanted[order], np.arange(v.classes + 1))
        near, one, spread = states.take(order, axis=0), targets[order], np.zeros((len(order), STATE), states.dtype) if grads is not None else None
        inside = np.zeros(len(order), logp.dtype)
        for c in range(v.classes):
            i, j, a, b = cuts[c], cuts[c + 1], v.starts[c], v.starts[c + 1]
            if i == j or b - a == 1:
                continue
            x = near[i:j]
            e = x @ p["Wo"][a:b].T
            e += p["bo"][a:b]
            e -= e.max()
            at, own = rows[: j - i], one[i:j] - a
            got = e[at, own]
            np.exp(e, e)
            total = e @ ones[: b - a]
            inside[i:j] = got - np.log(total)
            if grads is not None:
                e *= (1 / total)[:, None]
                e[at, own] -= 1
                grads["Wo"][a:b] += e.T @ x
                grads["bo"][a:b] += every[: j - i] @ e
                spread[i:j] = e @ p["Wo"][a:b]
        logp[order] += inside
        if grads is None:
            return logp
        back[order] += spread
        return logp, back

    def learn(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, active: list[int], h: np.ndarray):
        """One truncated window: forward, backward through its steps, and an update. Arrays are by (step, row)."""
        s, p = STATE, self.p
        grads = {x: np.zeros_like(y) for x, y in p.items()}
        kept: list = []
        table = p["E"] @ p["W"] + p["b"]
        states = self.forward(table, inputs, first, active, h, kept)
        _, back = self.output(states, np.concatenate([targets[t, :n] for t, n in enumerate(active) if n]), grads)
        carried = np.zeros_like(h)
        ends, back_u = np.cumsum([len(x[0]) for x in kept]), np.ascontiguousarray(p["U"].T)
        dg, du = np.empty((len(states), 3 * s), states.dtype), np.empty((len(states), 3 * s), states.dtype)
        for t in range(len(kept) - 1, -1, -1):
            before, z, r, un, new = kept[t]
            n = len(before)
            at = slice(ends[t] - n, ends[t])
            dh = carried[:n] + back[at]
            g, u = dg[at], du[at]
            zd = dh * z
            da = (dh - zd) * (1 - new * new)
            g[:, :s] = (before - new) * (zd - zd * z)
            dr = da * r
            g[:, s : 2 * s] = un * (dr - dr * r)
            g[:, 2 * s :] = da
            u[:, : 2 * s] = g[:, : 2 * s]
            u[:, 2 * s :] = dr
            zd += u @ back_u
            carried[:n] = zd
            if first[t, :n].any():
                carried[:n][first[t, :n]] = 0  # nothing is carried over a text's begin
        grads["U"] = np.concatenate([x[0] for x in kept]).T @ du
        flat = np.concatenate([inputs[t, :n] for t, n in enumerate(active) if n])
        d_in = np.ascontiguousarray((dg @ p["W"].T).T)
        for k in range(EMBED):
            grads["E"][:, k] = np.bincount(flat, d_in[k], len(p["E"]))
        grads["W"] = p["E"].take(flat, axis=0).T @ dg
        grads["b"] = np.ones(len(dg), dg.dtype) @ dg
        scale = 1 / len(states)
        norm = scale * np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale *= min(1.0, 1.0 / max(norm, 1e-6))
        for x, g in grads.items():
            g *= np.float32(scale)
            self.cache[x] += g * g
            p[x] -= np.float32(RATE) * g / np.sqrt(self.cache[x])

    def train(self, rows: list[np.ndarray]) -> int:
        """Learns from texts in their order: they make one stream, cut into lanes of like length that go side by side."""
        flat = np.concatenate(rows).astype(np.int64)
        begins = np.zeros(len(flat), bool)
        lengths = np.array([len(r) for r in rows])
        begins[np.cumsum(lengths) - lengths] = True
        before = np.r_[self.v.end, flat[:-1]]
        before[begins] = self.v.end
        lanes = int(np.clip(len(flat) // 256, 1, LANES))
        size, more = divmod(len(flat), lanes)
        start = np.arange(lanes) * size + np.minimum(np.arange(lanes), more)
        begins[start] = True  # a lane may begin within a text, whose state it lacks
        h = np.zeros((lanes, STATE), np.float32)
        for t in range(0, size + (more > 0), STEPS):
            active = [lanes if u < size else more for u in range(t, min(t + STEPS, size + (more > 0)))]
            spots = np.minimum(start + np.arange(t, t + len(active))[:, None], len(flat) - 1)
            self.learn(before[spots], flat[spots], begins[spots], active, h)
        return len(flat)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each text's classes and frequent words; the state is carried through the whole text."""
        out = np.zeros(len(rows))
        table = self.p["E"] @ self.p["W"] + self.p["b"]
        every = np.array([len(r) for r in rows])
        order = np.argsort(-every, kind="stable")
        for begin in range(0, len(rows), SCORED):
            at = order[begin : begin + SCORED]
            lengths = every[at]
            # one place before each text for the end that stands before its first word
            flat = np.concatenate([x for k in at for x in ([self.v.end], rows[k])]).astype(np.int64)
            start = np.cumsum(lengths + 1) - lengths - 1
            h, held, size = np.zeros((len(at), STATE), np.float32), [], 0
            for t in range(0, int(lengths[0]), STEPS):
                active = [n for u in range(t, t + STEPS) if (n := int(np.searchsorted(-lengths, -u)))]
                near = flat[np.minimum(start[: active[0]] + np.arange(t, t + len(active) + 1)[:, None], len(flat) - 1)]
                states = self.forward(table, near[:-1], np.zeros((len(active), active[0]), bool), active, h[: active[0]])
                held.append((states, np.concatenate([near[u + 1, :n] for u, n in enumerate(active)]), np.concatenate([at[:n] for n in active])))
                size += len(states)
                if size >= OUTPUTS or t + STEPS >= lengths[0]:  # few long texts make small windows, whose outputs wait for more
                    states, targets, whose = (np.concatenate(x) for x in zip(*held, strict=True))
                    out += np.bincount(whose, self.output(states, targets), len(rows))
                    held, size = [], 0
        return out


_PARTS = "chunk long, place int, word long, n long, rare int, doc_id {id}, held_out boolean, places binary"


def _parts(docs: DataFrame, id_type: str) -> DataFrame:
    """Chunks of texts: for each, its words (place, hash, n in training texts, rare class) and its texts as places of words.

    docs: doc_id, held_out and text.
    """

    def run(batches):
        from pyspark import TaskContext

        base, held, size = TaskContext.get().partitionId() << 32, [], 0
        codec = pa.Codec("zstd", compression_level=1)
        names = ["chunk", "place", "word", "n", "rare", "doc_id", "held_out", "places"]

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks()
            words, lengths = split(whole.column(2).combine_chunks())
            coded = words.dictionary_encode()
            at, own = coded.indices.to_numpy(), whole.column(1).to_numpy()
            known = coded.dictionary.cast(pa.binary())
            k, m = len(known), whole.num_rows
            n = np.bincount(at[~np.repeat(own, lengths)], minlength=k)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known.to_pylist()), np.uint64, k) ^ np.uint64(1 << 63)
            none = lambda kind, size: pa.nulls(size, kind)
            kind = whole.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, base)), pa.array(np.arange(k, dtype=np.int32)), pa.array(hashes.view(np.int64)), pa.array(n), pa.array(rare_classes(known).astype(np.int32)), none(kind, k), none(pa.bool_(), k), none(pa.binary(), k)], names=names)
            places = [codec.compress(x.tobytes(), asbytes=True) for x in np.split(at.astype(np.int32), np.cumsum(lengths)[:-1])]
            packed = [int(n).to_bytes(8, "little") + x for n, x in zip(lengths, places, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, base)), none(pa.int32(), m), none(pa.int64(), m), none(pa.int64(), m), none(pa.int32(), m), whole.column(0).combine_chunks(), whole.column(1).combine_chunks(), pa.array(packed, pa.binary())], names=names)

        for batch in batches:
            for part in chunks(batch, 2):
                held.append(part)
                size += part.column(2).nbytes
                if size >= CHUNK:
                    yield from flush()
                    base, held, size = base + 1, [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, _PARTS.format(id=id_type))


def _counted(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, place, word, rare, c) of every chunk's words, c counted over the corpus, and (word, rare, c) of every word once.

    Words that stand in many chunks are counted by an aggregate combined in each task and told to all, at most HOT_WORDS
    of 20 bytes; so the window over the others never holds more rows of one word than a few.
    """
    hot = words.where("n >= 2").groupBy("word").agg(F.count("*").alias("chunks")).where(F.col("chunks") >= HOT_CHUNKS).orderBy(F.desc("chunks"), "word").limit(HOT_WORDS).select("word")
    hot = words.join(F.broadcast(hot), "word").groupBy("word", "rare").agg(F.sum("n").alias("c"))
    hot = materialise(hot, "hot")
    rest = words.join(F.broadcast(hot.select("word")), "word", "left_anti")
    of_word = Window.partitionBy("word")
    rest = rest.select("chunk", "place", "word", "rare", F.sum("n").over(of_word).alias("c"), (F.min("chunk").over(of_word) == F.col("chunk")).alias("first"))
    told = words.join(F.broadcast(hot.select("word", "c")), "word").select("chunk", "place", "word", "rare", "c", F.lit(False).alias("first"))
    counted = materialise(rest.unionByName(told), "counted")
    return counted.drop("first"), counted.where("first").select("word", "rare", "c").unionByName(hot.select("word", "rare", "c"))


def vocabulary(words: DataFrame) -> Vocabulary:
    """words: word (hash), rare and c, a row for each word. Counts are those of the whole training corpus."""
    seen = words.where("c > 0")
    sums = {r.rare: (r.n, r.v) for r in seen.groupBy("rare").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # RARE rows
    n, v = np.zeros(RARE), np.zeros(RARE)
    for k, (a, b) in sums.items():
        n[k], v[k] = a, b
    every = int(n.sum()), int(v.sum())
    size = min(max(every[0] // TOKENS_A_WORD, LEAST_FREQUENT), FREQUENT)
    top = seen.orderBy(F.desc("c"), "word").limit(size).select("word", "c", "rare").collect()
    for r in top:  # frequent words are in no rare class
        n[r.rare] -= r.c
        v[r.rare] -= 1
    return Vocabulary([r.word for r in top], np.array([r.c for r in top], np.float64), n, v, *every)


def _numbered(parts: DataFrame, counted: DataFrame, v: Vocabulary, id_type: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base, inside and ids of every text.

    ids: the network's numbers of its tokens, 16 bits each; inside: what rare words add to the score within their classes.
    """
    shared = ship(parts.sparkSession, v)  # FREQUENT words

    def run(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        v, codec = shared(), pa.Codec("zstd")
        order = np.argsort(dictionary.column("place").to_numpy())
        c, rare, word = (dictionary.column(x).to_numpy()[order] for x in ("c", "rare", "word"))
        k = len(v.words)
        by_hash = np.argsort(np.array(v.words, np.int64))
        sorted_ = np.array(v.words, np.int64)[by_hash]
        spot = np.minimum(np.searchsorted(sorted_, word), max(k - 1, 0))
        frequent = sorted_[spot] == word if k else np.zeros(len(word), bool)
        number = np.where(frequent, by_hash[spot] if k else 0, k + rare).astype(np.int16)
        unigram = np.log10((c + 1) / (v.n + v.v + 1))
        within = np.where(frequent, 0.0, np.log10((c + 1) / (v.rare_n[rare] + v.rare_v[rare] + 1)))
        places = [np.frombuffer(codec.decompress(x[8:], int.from_bytes(x[:8], "little") * 4), np.int32) for x in texts.column("places").to_pylist()]
        flat, lengths = np.concatenate(places), np.array([len(p) for p in places])
        begins = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x[flat], begins) for x in ((c > 0).astype(np.int64), unigram, within)]
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(lengths), *map(pa.array, sums), pa.array([number[p].tobytes() for p in places], pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids"])

    texts = parts.where("places is not null").select("chunk", "doc_id", "held_out", "places")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, inside double, ids binary"
    return texts.groupBy("chunk").cogroup(counted.select("chunk", "place", "word", "rare", "c").groupBy("chunk")).applyInArrow(run, schema)


def _mean(batches):
    """Of (at, n, packed) rows one: the mean of the models, weighted by tokens."""
    total, n = None, 0
    for b in batches:
        for w, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.frombuffer(x, np.float32).astype(np.float64) * w
            total, n = (x if total is None else total + x), n + w
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["at", "n", "packed"])


def _trained(texts: DataFrame, model: Gru, shards: int) -> Gru:
    """One round: each shard trains a copy of the model on its texts; the copies' mean, weighted by tokens, is the new model. texts: shard, order and ids."""
    shared = ship(texts.sparkSession, (model.v, model.pack()))  # bounded by FREQUENT and the state's size
    firsts = int(np.ceil(np.sqrt(shards)))
    names = ["at", "n", "packed"]

    def run(batches):
        v, packed = shared()
        now, own, rows, size, learned = None, None, [], 0, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now % firsts]), pa.array([learned]), pa.array([own.pack().tobytes()], pa.binary())], names=names)

        for b in batches:
            for shard, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard != now or size >= 4 * SHARD_TOKENS:  # what few texts make too long goes on with the same copy
                    if rows:
                        learned += own.train(rows)
                        rows, size = [], 0
                    if shard != now:
                        if own is not None:
                            yield done()
                        now, own, learned = shard, Gru(v), 0
                        own.unpack(packed)
                rows.append(np.frombuffer(ids, np.int16))
                size += len(rows[-1])
        if rows:
            learned += own.train(rows)
        if own is not None:
            yield done()

    kind = "at long, n long, packed binary"
    dealt = texts.repartition(min(shards, TRAINERS), "shard").sortWithinPartitions("shard", "order", "ids")
    found = dealt.mapInArrow(run, kind).repartition(firsts, "at").mapInArrow(_mean, kind)
    if firsts > LAST_MEANS:
        found = found.repartition(LAST_MEANS).mapInArrow(_mean, kind)
    models = found.collect()  # at most LAST_MEANS models
    if models:
        total = sum(r.n for r in models)
        model.unpack(sum(np.frombuffer(r.packed, np.float32).astype(np.float64) * (r.n / total) for r in sorted(models, key=lambda r: (r.n, r.packed))))
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row.

    held_out: a condition over docs; rows where it holds are scored only, and all others are learned from, once each. Null
    texts are empty, one end token. Words are known by 64-bit hashes. Scores depend on the rows of the table, not on their
    partitions, but for the last digits of sums; ties and repeated rows get equal scores, and rows that repeat an id and
    its text are learned from in one shard. Without training rows every token is unknown. Columns besides the two named
    and those of the condition are not read. An empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    parts = materialise(_parts(named, kind), "chunks")
    counted, words = _counted(parts.where("word is not null").select("chunk", "place", "word", "n", "rare"))
    v = vocabulary(words)
    texts = materialise(_numbered(parts, counted, v, kind), "texts")
    remove(counted)
    remove(parts)
    shards = max(1, round(v.n / (ROUNDS * SHARD_TOKENS)))
    spot = F.xxhash64("doc_id", "ids")
    learned = texts.where(~F.col("held_out")).select(F.pmod(F.xxhash64(spot), F.lit(shards)).alias("shard"), spot.alias("order"), "ids")
    model = Gru(v)
    for turn in range(ROUNDS):
        model = _trained(learned.where(F.pmod("order", F.lit(ROUNDS)) == turn), model, shards)
    shared = ship(docs.sparkSession, (v, model.pack()))

    def run(batches):
        v, packed = shared()
        gru = Gru(v)
        gru.unpack(packed)

        def scored(held):
            whole = pa.Table.from_batches(held)
            total = gru.score([np.frombuffer(x, np.int16) for x in whole.column(6).to_pylist()]) / np.log(10)
            return pa.RecordBatch.from_arrays([*(whole.column(k).combine_chunks() for k in range(4)), pa.array(np.full(whole.num_rows, v.n)), whole.column(4).combine_chunks(), pa.array(total + whole.column(5).to_numpy())], names=names)

        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, 6):
                held.append(part)
                size += pc.sum(part.column(2)).as_py()
                if size >= AT_ONCE:
                    yield scored(held)
                    held, size = [], 0
        if held:
            yield scored(held)

    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids"]
    return texts.select(*columns).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
