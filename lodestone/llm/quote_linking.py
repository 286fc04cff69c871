"""Chat formatting by quotation linking: quoted passages are traced to the messages they come from, and conversations are put in reply order without quotes."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import free, map_texts, materialise, shared_dir
from lodestone.llm.components import connected_components
from lodestone.operators.ordered import with_index

#: A passage of fewer words is looked for in its own conversation alone.
LEAST_WORDS = 2
#: A passage that so many messages quote is dealt over so many tasks.
HOT = 10_000
SALTS = 64
#: A thread of so many messages has its first place told to all tasks.
LONG = 100_000

_QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_SAID = re.compile(r"^[ \t]*(?:on\b.*\bwrote|.+\b(?:wrote|writes|schrieb|escribió|a écrit)|-+ ?original message ?-+)[ \t]*:?[ \t]*$", re.I)
_NOT_WORD = re.compile(r"[^\w]+")


def normal(text: str) -> str:
    """Words in lower case, one space apart."""
    return _NOT_WORD.sub(" ", text.lower()).strip()


def passage_hash(text: str) -> int | None:
    """The hash of a passage's words; it is odd for one of fewer words than LEAST_WORDS, and none for one without words."""
    words = normal(text)
    if not words:
        return None
    return (xxhash.xxh3_64_intdigest(words) - 2**63) & ~1 | (words.count(" ") + 1 < LEAST_WORDS)


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text without quotes and lines that announce them, and its quoted passages as (level, text).

    A passage is a run of lines of one level; its text has one line for each of the original's lines. A line of the
    message itself announces a quote if the next line that isn't blank is one.
    """
    own, passages, last = [], [], 0
    lines = (text or "").split("\n")
    quoted = [_QUOTE.match(line) for line in lines]
    before_quote, follows = [False] * len(lines), False
    for k in range(len(lines) - 1, -1, -1):
        before_quote[k] = follows
        if quoted[k] or lines[k].strip():
            follows = bool(quoted[k])
    for line, m, announces in zip(lines, quoted, before_quote, strict=True):
        level = m[1].count(">") if m else 0
        body = line[m.end() :] if m else line
        if (level or announces) and _SAID.match(body):
            continue
        if not level:
            own.append(line)
        elif level == last and passages:
            passages[-1] = (level, passages[-1][1] + "\n" + body)
        else:
            passages.append((level, body))
        last = level
    return "\n".join(own).strip() if passages else (text or ""), passages


def hashes(text: str) -> list[int]:
    """The hash of a passage, and of each of its lines, so that a quote of part of a message is found too."""
    parts = [text, *text.split("\n")] if "\n" in text.strip() else [text]
    return list(dict.fromkeys(h for p in parts if (h := passage_hash(p)) is not None))


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds own_text, own_hashes and quotes, an array of (level, text, hashes)."""
    longs = T.ArrayType(T.LongType(), False)
    quote = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("hashes", longs)])
    fields = [T.StructField("own_text", T.StringType()), T.StructField("own_hashes", longs), T.StructField("quotes", T.ArrayType(quote, False))]

    def make():
        def run(texts):
            found = [parse(t) for t in texts]
            return [[f[0] for f in found], [hashes(f[0]) for f in found], [[{"level": k, "text": t, "hashes": hashes(t)} for k, t in f[1]] for f in found]]

        return run

    return map_texts(messages, text_col, fields, make)


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, quoted (the deepest level), the parent of each message and its links.

    links: (level, conv_id, turn, n) of every message that passages of a level come from, n hashes of them; a passage
    counts at its least level. A message's parent is the earlier message that most of its passages of the least linked
    level come from: one of its own conversation if there is any, else the first anywhere; ties go to the latest turn,
    then the conversation whose hash is least. A quote that nothing earlier says links with nothing, and one of fewer than
    LEAST_WORDS words with nothing but its own conversation. Null and empty texts quote nothing; rows with a null
    conversation or turn have no parent and are none. Repeated rows are rows of their own with one parent. Whole texts
    count; input columns besides the four are not read, so none can clash; an empty table gives an empty result.

    For each passage the first message with it counts, found by an aggregate that tasks combine before the shuffle, so no
    list of a passage's messages is ever built. Only passages that HOT messages quote are copied, to meet their quotes in
    SALTS tasks.
    """
    named = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = materialise(parsed(named), "messages")
    said = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("own_hashes").alias("hash"))
    asked = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", F.explode("q.hashes").alias("hash")).groupBy("conv_id", "turn", "hash").agg(F.min("level").alias("level"))
    near = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn"))
    asked = materialise(asked, "asked")
    hot = asked.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("hash", F.lit(SALTS).alias("salts"))  # a row for HOT quotes at least
    first = said.where("hash % 2 = 0").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    first = first.join(hot, "hash", "left").select("hash", "first", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    salted = asked.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("conv_id", "turn"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    found = salted.join(near, ["hash", "conv_id"], "left").join(first, ["hash", "salt"], "left")
    same = F.col("near_turn") < F.col("turn")
    earlier = F.col("first") < F.struct("conv_id", "turn")
    found = found.select("conv_id", "turn", "level", F.when(same, F.struct(F.col("conv_id"), F.col("near_turn").alias("turn"))).when(earlier, F.col("first")).alias("source")).where("source is not null")
    votes = found.groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("n"))
    rank = F.struct((-F.col("level")).alias("near"), (F.col("source.conv_id") == F.col("conv_id")).alias("same"), "n", F.col("source.turn").alias("turn"), (-F.xxhash64("source.conv_id")).alias("order"), "source")
    parents = votes.groupBy("conv_id", "turn").agg(F.max(rank)["source"].alias("parent"), F.sum("n").alias("n_linked"), F.sort_array(F.collect_list(F.struct("level", "source.conv_id", "source.turn", "n"))).alias("links"))
    out = rows.join(parents, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.col("own_text").alias("text"), F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("quoted"), F.col("parent.conv_id").alias("parent_conv_id"), F.col("parent.turn").alias("parent_turn"), F.coalesce("links", F.array()).alias("links"))


def reply_order(linked: DataFrame) -> DataFrame:
    """Adds thread_id, the conversation in which the chain of parents begins, and position, from 0, in that thread's reply order.

    A reply comes after what it answers: threads follow (conversation, turn), which parents precede. Conversations that
    quote one another are one thread; equal turns follow their texts, and equal texts come in any order. Null
    conversations are a thread of their own, and null turns come first. Messages are sorted by ranges of all keys, so
    many tasks number a thread of any length and any number of conversations. Columns pass through; ones named thread_id
    and position are replaced. An empty table gives an empty result.
    """
    across = linked.where("parent_conv_id is not null and parent_conv_id <> conv_id").select("conv_id", "parent_conv_id")
    roots = connected_components(across, "conv_id", "parent_conv_id").select(F.col("node").alias("conv_id"), F.col("root").alias("thread_id"))
    rows = linked.drop("thread_id", "position").join(roots, "conv_id", "left").withColumn("thread_id", F.coalesce("thread_id", "conv_id"))
    shared_dir(linked.sparkSession)
    placed = with_index(rows, "thread_id", "conv_id", "turn", "text", out=(place := free("place", rows.columns)))
    begins = materialise(placed.groupBy("thread_id").agg(F.min(place).alias("begin"), F.count("*").alias("n")), "threads")
    long = begins.where(F.col("n") >= LONG).select(F.col("thread_id").alias("long_id"), F.col("begin").alias("long_begin"))  # a row for LONG messages at least
    placed = placed.join(F.broadcast(long), placed.thread_id.eqNullSafe(long.long_id), "left")
    short = begins.where(F.col("n") < LONG).select(F.col("thread_id").alias("short_id"), "begin")
    rest = placed.where("long_begin is null")
    rest = rest.join(short, rest.thread_id.eqNullSafe(short.short_id)).withColumn("position", F.col(place) - F.col("begin"))
    whole = placed.where("long_begin is not null").withColumn("position", F.col(place) - F.col("long_begin"))
    columns = [*rows.columns, "position"]
    return rest.select(*columns).unionByName(whole.select(*columns))


def chat_format(messages: DataFrame, **cols) -> DataFrame:
    """Messages without quotes, linked and in reply order: link() and then reply_order(), with their results for nulls, ties, repeats and empty tables."""
    return reply_order(link(messages, **cols))
