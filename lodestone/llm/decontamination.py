"""Benchmark decontamination: a positional inverted index over training tokens, searched from the rarest terms of each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, text_key
from lodestone.llm.quality_rules import let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a window; an item of fewer is one window.
WINDOW = 13
#: A document is contaminated where so many times its hit words reach its words.
SHARE = 20
#: Test tables are broadcast while the test set's words, with what is told about each, take so many bytes; beyond that joins shuffle.
BROADCAST_BYTES = 64_000_000
#: Bytes told about a word: its place, count, item and the windows it stands in.
WORD_BYTES = 120
#: Tasks over which the postings of one term are dealt where they are shuffled.
SALTS = 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), 0)


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, n_words and words of each row: the forward side of the index, stored once and read by every step."""
    return materialise(docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), words(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words").cast("long")), "tokens")


def test_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id (text) and words of each item that has words. Null ids are an item of their own."""
    return benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0).distinct().withColumn("item", F.xxhash64("item_id", F.array_join("words", " ")))


def fits(items: DataFrame) -> bool:
    """Whether the test set is small enough to be broadcast."""
    size = items.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + WORD_BYTES))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def told(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def term_counts(stored: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """How often each test term stands in the training texts. Counts are combined before the shuffle."""
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    each = stored.select(F.explode("words").alias("term"))
    if small:
        each = each.join(F.broadcast(vocabulary), "term")
    seen = each.groupBy("term").agg(F.count("*").alias("n"))
    return vocabulary.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Each item with its windows: start, size, and the places `a` and `b` of its rarest and second rarest word."""
    placed = items.select("item", F.posexplode("words").alias("p", "term")).join(counts, "term").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("ns"))
    size = F.least(F.lit(window), F.size("words"))

    def one(s: Column) -> Column:
        ranked = F.sort_array(F.transform(F.slice(F.col("ns"), s + 1, size), lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p"))))
        return let(ranked, lambda r: F.struct(s.alias("start"), r[0]["p"].alias("a"), F.coalesce(F.get(r, F.lit(1))["p"], r[0]["p"]).alias("b")))

    return items.join(placed, "item").select("item_id", "item", "words", size.alias("size"), F.transform(F.sequence(F.lit(0), F.size("words") - size), one).alias("windows"))


def postings(stored: DataFrame, terms: DataFrame, small: bool, reach: int) -> DataFrame:
    """The index: term, doc_id, text_key and pos. Where terms are broadcast also, as payload, the words up to `reach` places to either side and the place of the first.

    A shuffle carries places alone, each term's in SALTS parts.
    """
    if not small:
        each = stored.select("doc_id", "text_key", F.posexplode("words").alias("pos", "term")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "pos"), F.lit(SALTS)).cast("int"))
        parts = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return each.join(parts, ["term", "salt"]).drop("salt")
    each = stored.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "term"))
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    return each.join(F.broadcast(terms), "term").select("term", "doc_id", "text_key", "pos", start.alias("near_from"), F.slice("words", start + 1, F.col("pos") - start + reach + 1).alias("near"))


def phrase_matches(stored: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Exact occurrences of test windows: doc_id, text_key, item_id and runs, an array of each window's (first, last) word.

    stored: tokens() of the documents. Terms are counted over all documents; postings of each window's two rarest words
    are stored, brought to the item's offset and intersected. Where both stand, the words between are compared: those of
    the payload, or, where the test set is too large to be broadcast, those of the document itself. Repeated rows give
    their runs once.
    """
    items = materialise(test_items(benchmark, id_col, text_col), "items")
    small = fits(items)
    placed = materialise(windows(items, term_counts(stored, items, small), window), "windows")
    anchors = placed.select("item", "words", F.explode("windows").alias("w")).select("item", "words", F.explode(F.array("w.a", "w.b")).alias("q")).select(F.get("words", F.col("q")).alias("term"), "item", "q").distinct()
    index = materialise(postings(stored, anchors.select("term").distinct(), small, window - 1), "postings")
    at = F.struct("q", "pos", "near_from", "near") if small else F.struct("q", "pos")
    aligned = index.join(told(anchors, small), "term").groupBy("doc_id", "text_key", "item", (F.col("pos") - F.col("q")).alias("shift")).agg(F.collect_set(at).alias("at"))
    has = lambda q: F.exists("at", lambda x: x["q"] == q)
    # windows whose two rarest words both stand at this shift
    starts = F.filter("windows", lambda w: has(w["a"]) & has(w["b"]))
    whole = aligned.join(told(placed, small), "item").withColumn("starts", starts).where(F.size("starts") > 0)
    if not small:
        whole = whole.drop("windows")
        keys = whole.select(F.col("doc_id").alias("key_id"), "text_key").distinct()
        texts = stored.join(keys, stored.doc_id.eqNullSafe(keys.key_id) & (stored.text_key == keys.text_key), "left_semi").groupBy(F.col("doc_id").alias("key_id"), F.col("text_key").alias("key")).agg(F.first("words").alias("near"))
        whole = whole.join(texts, whole.doc_id.eqNullSafe(texts.key_id) & (whole.text_key == texts.key)).withColumn("near_from", F.lit(0))

    def run(w: Column) -> Column:
        """(first, last) of a window that stands whole in the document, else null."""
        x = F.filter("at", lambda x: x["q"] == w["a"])[0] if small else F.struct("near", "near_from")
        from_ = F.col("shift") + w["start"] - x["near_from"]
        here, there = F.slice(x["near"], F.greatest(from_, F.lit(0)) + 1, F.col("size")), F.slice("words", w["start"] + 1, F.col("size"))
        return F.when((from_ >= 0) & (here == there), F.struct((F.col("shift") + w["start"]).cast("long").alias("first"), (F.col("shift") + w["start"] + F.col("size") - 1).cast("long").alias("last")))

    runs = F.filter(F.transform("starts", run), lambda r: r.isNotNull())
    return whole.select("doc_id", "text_key", "item_id", runs.alias("runs")).where(F.size("runs") > 0)


def proximity_matches(stored: DataFrame, benchmark: DataFrame, terms: int = 3, slop: int = 30, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Places where the rarest `terms` different words of an item stand, in any order, within `slop` words.

    Returns doc_id, text_key, item_id, first and last word, each place once: repeated rows give theirs once. Rarest is by
    corpus count, then by the word; an item of fewer different words uses all it has. Null and empty texts and items, and
    empty tables, give no rows.
    """
    from pyspark.sql import Window

    items = materialise(test_items(benchmark, id_col, text_col), "items")
    small = fits(items)
    counts = term_counts(stored, items, small)
    rarest = items.select("item", "item_id", F.explode(F.array_distinct("words")).alias("term")).join(counts, "term").groupBy("item", "item_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, terms).alias("rare"))
    wanted = materialise(rarest.select("item", "item_id", F.size("rare").alias("needed"), F.explode("rare.term").alias("term")), "rarest")
    hits = stored.select("doc_id", "text_key", F.posexplode("words").alias("pos", "term")).join(told(wanted, small), "term").distinct()
    ahead = Window.partitionBy("doc_id", "text_key", "item").orderBy("pos").rangeBetween(0, slop - 1)
    near = hits.withColumn("terms", F.collect_set(F.struct("term")).over(ahead)).withColumn("ends", F.collect_list(F.struct("term", "pos")).over(ahead))
    # the span ends where the last of the needed words comes for the first time
    last = F.array_max(F.transform("terms", lambda t: F.array_min(F.transform(F.filter("ends", lambda e: e["term"] == t["term"]), lambda e: e["pos"]))))
    return near.where(F.size("terms") == F.col("needed")).select("doc_id", "text_key", "item_id", F.col("pos").cast("long").alias("first"), last.cast("long").alias("last")).distinct()


def covered(runs: Column) -> Column:
    """Words that (first, last) runs, sorted, cover together."""
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), r["last"] - F.greatest(a["to"], r["first"] - 1))).alias("n"), F.greatest(a["to"], r["last"]).alias("to"))
    return F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to")), step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted item ids) and contaminated, one row for each row of docs.

    A null text has no words and is clean; so is all of a table without items. Rows with equal id and text get equal
    results; a null id is an id. Columns besides the two named are not read.
    """
    stored = tokens(docs, id_col, text_col)
    found = phrase_matches(stored, benchmark, window)
    hits = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.sort_array(F.collect_set("item_id")).alias("items")).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), covered(F.col("runs")).alias("n_hit"), "items")
    rows = stored.select("doc_id", "text_key", "n_words")
    out = rows.join(hits, rows.doc_id.eqNullSafe(hits.hit_id) & (rows.text_key == hits.hit_key), "left")
    out = out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
