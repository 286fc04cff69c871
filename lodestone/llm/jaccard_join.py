"""N-gram Jaccard join: an exact set similarity self-join that skips index blocks by size and position and derives a set's answers from a similar set's.

Equal sets are one class. Each class puts its prefix, its rarest shingles, into an index. An index list is cut into blocks
of like size, each in the order of positions, so that a block ends for a set at the first position that leaves no room for
a link. The entry that stands first in each block is compared first; sets that are linked with one compared set are in one
component, and only entries of a list that are still in different components are looked at again: first with the nearest
others, which joins most, then with all that remain. Parity signatures of the sets bound how far two of them differ, so
few whole sets are ever compared.

All links of a component are then found from one of its sets, the pivot. Of every set its difference from the pivot is
taken once; two sets differ in what their differences do not share, so the overlap of any two follows from the short
differences alone, without reading whole sets again. Large components are cut into blocks of bounded size, and each two
blocks are a group of their own. All of it is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, materialise, mix, remove, ship, text_key, word_hashes
from lodestone.llm.components import connected_components

#: Words in a shingle, and the similarity of a link as a percentage.
WORDS = 4
PERCENT = 85
#: The most frequent shingles come last in the common order; so many are told to all tasks (16 bytes each).
FREQUENT = 200_000
#: A shingle is a candidate for that list if so many prefixes hold it.
FREQUENT_LEAST = 16
#: Bits of the filter over texts whose sets are needed again; false hits cost time alone. More texts than the second number are found by a join.
FILTER_BITS = 26
FILTERED = 1 << 23
#: Words of 64 bits in a set's signature, a bitmap of the parity of its hashes.
SIGNATURE = 8
#: A set outside a list's largest component is first compared with so many nearest others, by signature, then with all.
NEAREST = 2
#: Lists up to this length are compared pair by pair at once.
SHORT = 4
#: Entries in a block of an index list that is looked at again: each two blocks of a longer one are a group of their own.
LIST = 1024
#: Classes in a block of a component, and the pairs that meet one copy of a whole set.
BLOCK = 512
DEALT = 256
#: A difference that so many sets of a group share is counted by a matrix product.
COMMON = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    out = np.full(max(len(h) - words + 1, 0), words, np.uint64)
    for k in range(words):
        out = out * _ODD + h[k : k + len(out)]
    out, sets = mix(out).view(np.int64), []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= words:
            x = np.sort(out[end - n : end - words + 1])
            sets.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif n:
            one = np.full(1, n, np.uint64)
            for w in h[end - n : end]:
                one = one * _ODD + w
            sets.append(mix(one).view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets


def required(n, percent: int):
    """The least overlap that a set of n shingles has with any that it links with."""
    return (percent * n + 99) // 100


def prefix_size(n: int, percent: int) -> int:
    return int(n - required(n, percent) + 1)


def overlap(n, m, percent: int):
    """The least overlap of linked sets of n and m shingles."""
    return -((-percent * (n + m)) // (100 + percent))


def ordered_prefix(h: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, size: int) -> np.ndarray:
    """The first `size` of sorted shingles in the common order: by hash, then the frequent ones, rarest first."""
    if not len(frequent):
        return h[:size]
    place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    known = frequent[place] == h
    rare = h[~known][:size]
    if len(rare) == size:
        return rare
    late = h[known][np.argsort(ranks[place[known]], kind="stable")]
    return np.concatenate([rare, late[: size - len(rare)]])


def signature(h: np.ndarray) -> np.ndarray:
    """For each of 64 * SIGNATURE places the parity of the hashes that fall there: two sets differ in as many hashes at least as their signatures in bits."""
    place = (h.view(np.uint64) >> np.uint64(20)) & np.uint64(64 * SIGNATURE - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=64 * SIGNATURE) & 1).astype(np.uint8)).view(np.int64)


def differences(n, m, percent: int):
    """The most hashes in which linked sets of n and m differ."""
    return n + m - 2 * overlap(n, m, percent)


def _base(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Each row's id, text_key, n, fp (the hash of its set; null if empty) and, for the first row of a class in a task, its prefix by hash and its signature."""

    def run(batches):
        met: set = set()
        for batch in batches:
            for part in chunks(batch, 2):
                sizes, prints, prefixes, signatures = [], [], [], []
                for h in shingle_sets(part.column(2), words):
                    fp = _print(h)
                    first = fp is not None and fp not in met
                    met.add(fp)
                    sizes.append(len(h))
                    prints.append(fp)
                    prefixes.append(h[: prefix_size(len(h), percent)] if first else None)
                    signatures.append(signature(h) if first else None)
                long, longs = pa.int64(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, long), pa.array(prints, long), pa.array(prefixes, longs), pa.array(signatures, longs)], names=["doc_id", "text_key", "n", "fp", "prefix", "bits"])

    named = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {kind}, text_key long, n long, fp long, prefix array<long>, bits array<long>")


def _print(h: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)) if len(h) else None


def _postings(docs: DataFrame, text_col: str, words: int, percent: int, frequent, ranks) -> DataFrame:
    """(token, fp, n, pos) of every class's prefix in the common order; a task gives a class once."""
    shared = ship(docs.sparkSession, (frequent, ranks))  # at most 16 * FREQUENT bytes

    def run(batches):
        met: set = set()
        common, late = shared()
        for batch in batches:
            for part in chunks(batch, 0):
                rows = []
                for h in shingle_sets(part.column(0), words):
                    fp = _print(h)
                    if fp is not None and fp not in met:
                        met.add(fp)
                        rows.append((fp, len(h), ordered_prefix(h, common, late, prefix_size(len(h), percent))))
                if rows:
                    sizes = [len(p) for _, _, p in rows]
                    spread = lambda x: np.repeat(np.array(x, np.int64), sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p for _, _, p in rows])), pa.array(spread([r[0] for r in rows])), pa.array(spread([r[1] for r in rows])), pa.array(np.concatenate([np.arange(k) for k in sizes]))], names=["token", "fp", "n", "pos"])

    return docs.select(F.col(text_col)).mapInArrow(run, "token long, fp long, n long, pos long")


def _admits(n, i, m, j, percent: int):
    """Whether sizes n, m and the places i, j of a common shingle, the first one, leave room for a link."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= overlap(n, m, percent))


_PAIR = "a long, na long, b long, nb long, token long, pos long"


def _rows(a, na, b, nb, token=None, pos=None):
    """Candidate pairs, or with token and pos the entries of a list that is to be looked at again (b is null)."""
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(na), none if b is None else pa.array(b), none if nb is None else pa.array(nb), none if token is None else pa.array(token), none if pos is None else pa.array(pos)], names=["a", "na", "b", "nb", "token", "pos"])


def _lists(batches, columns: int):
    """Whole index lists, many at a time, as arrays: a batch's last list waits for the rest of it."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        cut = int(np.searchsorted(got[0], got[0][-1]))  # sorted by token
        if cut or held and held[0][0][0] != got[0][0]:
            ready = [*held, [x[:cut] for x in got]]
            yield [np.concatenate(x) for x in zip(*ready, strict=True)]
            held = []
        held.append([x[cut:] for x in got])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _first_pairs(percent: int):
    """From lists sorted by token, n and fp: all pairs of short lists, and of others the pairs with the first entry of their own block of like size and of the block below, and the entries themselves."""

    def run(batches):
        for token, fp, n, pos in _lists(batches, 4):
            again = np.r_[False, (token[1:] == token[:-1]) & (fp[1:] == fp[:-1])]  # a class from two tasks
            token, fp, n, pos = (x[~again] for x in (token, fp, n, pos))
            heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            counts = np.diff(np.r_[heads, len(token)])
            size = np.repeat(counts, counts)
            some = size > 1
            token, fp, n, pos, size = (x[some] for x in (token, fp, n, pos, size))
            if not len(token):
                continue
            for d in range(1, SHORT):
                k = np.flatnonzero((token[:-d] == token[d:]) & (size[d:] <= SHORT))
                k = k[_admits(n[k], pos[k], n[k + d], pos[k + d], percent)]
                if len(k):
                    yield _rows(fp[k], n[k], fp[k + d], n[k + d])
            long = np.flatnonzero(size > SHORT)
            if not len(long):
                continue
            token, fp, n, pos = (x[long] for x in (token, fp, n, pos))
            heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            # blocks: sizes whose ratio admits a link; a block's first entry is that of the least class, the same in most lists of a group
            block = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
            order = np.lexsort((fp, block, token))
            token, fp, n, pos, block = (x[order] for x in (token, fp, n, pos, block))
            heads = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])])
            own = np.repeat(heads, np.diff(np.r_[heads, len(token)]))
            before = np.r_[-1, heads[:-1]]
            adjoins = (before >= 0) & (token[heads] == token[before]) & (block[heads] == block[before] + 1)
            lower = np.repeat(np.where(adjoins, before, -1), np.diff(np.r_[heads, len(token)]))
            for pivot in (own, lower):
                k = np.flatnonzero((pivot >= 0) & (pivot != np.arange(len(token))))
                k = k[_admits(n[pivot[k]], pos[pivot[k]], n[k], pos[k], percent)]
                if len(k):
                    yield _rows(fp[pivot[k]], n[pivot[k]], fp[k], n[k])
            yield _rows(fp, n, None, None, token, pos)

    return run


def _cross_pairs(percent: int, nearest: int | None):
    """From lists sorted by key and n, with the component, block and signature of each entry: the pairs of different components that size, position and signature admit, or of each entry the nearest ones.

    In a list of two blocks only pairs across them count.
    """

    def run(batches):
        for token, fp, n, pos, root, own, across, bits in _lists(batches, 8):
            for begin, end in zip(heads := np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), np.r_[heads[1:], len(token)], strict=True):
                f, s, p, r, o, apart_only = (x[begin:end] for x in (fp, n, pos, root, own, across))
                if (r == r[0]).all():
                    continue
                b = np.stack(bits[begin:end])
                # the largest component of the list meets the others alone, so only entries outside it look for partners
                values, counts = np.unique(r, return_counts=True)
                top = values[np.argmax(counts)]
                # blocks of like size, each by position, so that a block's end is skipped at once
                like = np.floor(np.log(s) / np.log(100 / percent)).astype(np.int64)
                order = np.lexsort((p, like))
                starts = np.flatnonzero(np.r_[True, np.diff(like[order]) != 0])
                blocks = [(order[x:y], p[order[x:y]], s[order[x:y]].min(), s[order[x:y]].max()) for x, y in zip(starts, np.r_[starts[1:], len(order)], strict=True)]
                for k in np.flatnonzero(r != top):
                    low, high = required(s[k], percent), s[k] * 100 // percent
                    near = []
                    for at, places, least, most in blocks:
                        if most >= low and least <= high:
                            m = min(most, high)  # the later a position in a set of m, the fewer shingles are left to share
                            near.append(at[: np.searchsorted(places, m - overlap(s[k], m, percent), "right")])
                    w = np.sort(np.concatenate(near)) if near else np.zeros(0, np.int64)
                    w = w[(r[w] != r[k]) & (~apart_only[k] | (o[w] != o[k])) & ((r[w] == top) | (w > k) | (nearest is not None))]
                    w = w[_admits(s[k], p[k], s[w], p[w], percent)]
                    apart = np.bitwise_count((b[w] ^ b[k]).view(np.uint64)).sum(1)  # unsigned: of a negative number it counts another
                    near = apart <= differences(s[k], s[w], percent)
                    w, apart = w[near], apart[near]
                    if nearest is not None:
                        w = w[np.lexsort((f[w], apart))[:nearest]]
                    if len(w):
                        yield _rows(np.full(len(w), f[k]), np.full(len(w), s[k]), f[w], s[w])

    return run


def _signatures(base: DataFrame) -> DataFrame:
    """fp, n and bits of every class."""
    return base.where("bits is not null").groupBy("fp").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))


def _filter(texts: DataFrame):
    """A function that gives a bitmap of text_keys by their last FILTER_BITS bits."""
    spot = F.col("text_key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))
    bits = texts.select(F.shiftright(spot, 6).alias("at"), F.expr("shiftleft(1L, cast(text_key & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    told = bits.toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    filled[told.column("at").to_numpy()] = told.column("bits").to_numpy()
    return ship(texts.sparkSession, filled)  # 2 ** (FILTER_BITS - 3) bytes


def _sets(docs: DataFrame, text_col: str, words: int, base: DataFrame, needed: DataFrame) -> DataFrame:
    """fp and held (the sorted hashes, as bytes) of each needed class."""
    texts = materialise(base.where("fp is not null").groupBy("fp").agg(F.min("text_key").alias("text_key")).join(needed, "fp").select("text_key"), "keys")

    keyed = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    if texts.count() > FILTERED:
        keyed, shared = keyed.join(texts.distinct(), "text_key", "left_semi"), None
    else:
        shared = _filter(texts)

    def sets(batches):
        met: set = set()
        filled = shared() if shared else None
        for batch in batches:
            for part in chunks(batch, 1):
                if filled is not None:  # few others than the needed ones pass
                    key = part.column(0).to_numpy()
                    part = part.filter(pa.array(((filled[(key & ((1 << FILTER_BITS) - 1)) >> 6] >> (key & 63)) & 1).astype(bool)))
                prints, held = [], []
                for h in shingle_sets(part.column(1), words):
                    fp = _print(h)
                    if fp is not None and fp not in met:
                        met.add(fp)
                        prints.append(fp)
                        held.append(h.tobytes())
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(held, pa.binary())], names=["fp", "held"])

    found = keyed.mapInArrow(sets, "fp long, held binary")
    return materialise(found.join(needed, "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def _linked(left: int, right: int, same: int, percent: int) -> bool:
    return 100 * same >= percent * (left + right - same)


def _links(pairs: DataFrame, base: DataFrame, docs: DataFrame, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The candidate pairs that are links, each compared once over whole sets, and the sets of all candidates.

    The set of more pairs is the left one; it is sent once for each DEALT of its pairs, to as many tasks.
    """
    known = _signatures(base)
    side = lambda x: known.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    size = F.col("na") + F.col("nb")
    most = size - 2 * F.ceil(percent * size / (100 + percent) - F.lit(1e-6))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialise(pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b"), "pairs")
    degrees = materialise(pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("k")), "needed")
    found = _sets(docs, text_col, words, base, degrees.select("fp"))
    of = lambda x: degrees.select(F.col("fp").alias(x), F.col("k").alias(f"k{x}"))
    turned = pairs.join(of("a"), "a").join(of("b"), "b")
    hub = F.col("ka") >= F.col("kb")
    turned = turned.select(F.when(hub, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(hub, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("ka", "kb").alias("k"))
    turned = turned.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / DEALT)))
    right = turned.select("a", "salt", "b").join(found.select(F.col("fp").alias("b"), "held"), "b").select("a", "salt", "b", "held")
    left = turned.select("a", "salt").distinct().join(found.select(F.col("fp").alias("a"), "held"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "held")

    def compare(batches):
        whole = None
        for batch in batches:
            one, two = [], []
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                h = np.frombuffer(x.as_buffer(), np.int64)
                if b is None:
                    whole = h.copy()
                    continue
                spot = np.minimum(np.searchsorted(whole, h), len(whole) - 1)
                if _linked(len(whole), len(h), int((whole[spot] == h).sum()), percent):
                    one.append(a)
                    two.append(b)
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])

    dealt = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialise(dealt.mapInArrow(compare, "a long, b long"), "linked"), found


def shared_differences(differ: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common, as a matrix."""
    m = len(differ)
    out = np.zeros((m, m), np.int64)
    rows = np.repeat(np.arange(m), [len(d) for d in differ])
    flat = np.concatenate(differ)
    order = np.lexsort((rows, flat))
    flat, rows = flat[order], rows[order]
    heads = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, len(flat)])
    for k in range(2, COMMON + 1):  # elements of few sets: their pairs of sets
        at = heads[counts == k]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(out, (rows[at + i], rows[at + j]), 1)
    often = np.flatnonzero(counts > COMMON)
    for begin in range(0, len(often), 4096):  # elements of many sets: columns of a matrix
        part = often[begin : begin + 4096]
        x = np.zeros((m, len(part)), np.float32)
        x[rows[np.concatenate([np.arange(heads[c], heads[c] + counts[c]) for c in part])], np.repeat(np.arange(len(part)), counts[part])] = 1
        out += np.triu(np.rint(x @ x.T).astype(np.int64), 1)
    return out + out.T


def links_within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets, one component or part of one, are linked: answers of all follow from each one's difference from the first."""
    differ = [np.setxor1d(sets[0], h, assume_unique=True) for h in sets]
    d, n = np.array([len(x) for x in differ]), np.array([len(h) for h in sets])
    apart = d[:, None] + d[None, :] - 2 * shared_differences(differ)
    total = n[:, None] + n[None, :]
    out = (100 + percent) * (total - apart) >= 2 * percent * total
    np.fill_diagonal(out, False)
    return out


def _link_counts(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """fp and linked, the rows that have another set than fp's and are linked with it. classes: fp, root, weight (rows of the class).

    A component is cut into blocks by hash; each two blocks meet in a group of their own, of 2 * BLOCK sets on average.
    """
    sizes = classes.groupBy("root").agg(F.count("*").alias("m")).where("m > 1")
    rows = classes.join(sizes, "root").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp", "weight")
    dealt = rows.join(sets, "fp").select("root", "x", "y", "own", "fp", "weight", "held").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "fp")

    def run(batches):
        def counted(group):
            x, y = group[0][1], group[0][2]
            own, weight = np.array([g[3] for g in group]), np.array([g[5] for g in group])
            linked = links_within([np.frombuffer(g[6], np.int64) for g in group], percent)
            if x != y:
                linked &= own[:, None] != own[None, :]
            return zip((g[4] for g in group), (linked @ weight).tolist(), strict=True)

        group, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    out += counted(group)
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["fp", "linked"])
                out = []
        if group:
            out = list(counted(group))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["fp", "linked"])

    return dealt.mapInArrow(run, "fp long, linked long").groupBy("fp").agg(F.sum("linked").alias("linked"))


@dataclass
class Joined:
    """members: doc_id, text_key, n_shingles, fp (its class; null for an empty set), root (the class that names its component), component_id and n_links. links: verified pairs (a, b) of classes that span every component."""

    members: DataFrame
    links: DataFrame


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, counts: bool = True) -> Joined:
    """Links texts whose sets of shingles have 100 * intersection >= percent * union; returns each row's component and number of links.

    n_links counts the other rows that a row is linked with, rows of an equal set included; without counts it is left out.
    Null, empty and blank texts have an empty set, link with nothing and are their own component; a text of fewer words
    than a shingle is one shingle. Equal sets are one class and linked; classes are known by 64-bit hashes. Repeated rows
    and ids are rows of their own; component_id is the least id reached, nulls aside. Columns besides the two named are
    not read. Whole texts count; an empty table gives an empty result.
    """
    base = materialise(_base(docs, id_col, text_col, words, percent), "classes")
    seen = base.where("prefix is not null").select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT_LEAST)
    top = seen.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    token, c = (top.column(k).to_numpy() for k in ("token", "c"))
    by_hash = np.argsort(token)
    ranks = np.empty(len(token), np.int64)
    ranks[np.lexsort((token, c))] = np.arange(len(token))
    index = _postings(docs, text_col, words, percent, token[by_hash], ranks[by_hash]).repartition("token").sortWithinPartitions("token", "n", "fp")
    first = materialise(index.mapInArrow(_first_pairs(percent), _PAIR), "first")
    links, sets = _links(first.where("b is not null"), base, docs, text_col, words, percent)
    roots = connected_components(links, "a", "b")
    entries = first.where("token is not null").select("token", F.col("a").alias("fp"), F.col("na").alias("n"), "pos")
    entries = entries.join(_signatures(base).select("fp", "bits"), "fp")
    for nearest in (NEAREST, None):
        rooted = materialise(entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", "n", "pos", F.coalesce("root", "fp").alias("root"), "bits"), "lists")
        mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high").select("token", F.ceil(F.col("size") / LIST).alias("blocks"))
        cross = rooted.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cross = cross.withColumn("key", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))).withColumn("across", F.col("own") != F.col("other"))
        # an entry's own block meets itself once and each other block once; the group of two blocks holds both blocks' entries
        cross = cross.repartition("key").sortWithinPartitions("key", "n", "fp").select("key", "fp", "n", "pos", "root", "own", "across", "bits")
        more, others = _links(cross.mapInArrow(_cross_pairs(percent, nearest), _PAIR), base, docs, text_col, words, percent)
        if more.limit(1).count():
            links, sets = links.unionByName(more), sets.unionByName(others)
            roots = connected_components(links, "a", "b")
        remove(rooted)
    remove(first)
    held = base.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"))
    classes = held.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "weight", F.coalesce("root", "fp").alias("root"))
    classes = materialise(classes, "rooted")
    reached = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    columns = ["doc_id", "text_key", "n_shingles", "fp", "root", "component_id"]
    if counts:
        columns.append("n_links")
        reached = reached.join(_link_counts(sets.dropDuplicates(["fp"]), classes.select("fp", "root", "weight"), percent), "fp", "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("linked", F.lit(0).cast("long")))
    members = base.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "fp").join(reached.drop("least", "weight", "linked"), "fp", "left")
    alone = F.col("fp").isNull()
    members = members.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    if counts:
        members = members.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return Joined(members.select(*columns), links)
