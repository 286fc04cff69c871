"""Secret scans: pattern spans in every text, and corpus-wide ownership counts that tell shared examples from live credentials."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality_rules import let


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the secret value, and the least code points that this group needs."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


# The base kinds, in the order that breaks ties. Runs of 24 or 16 in place of one or more leave the same
# matches once short ones are dropped, as a shorter run can't hold a longer one.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
    # from header to end line, no further than the next five hyphens; of a key that is cut off, what is base64, up to 200
    # lines, which is more than the longest keys in use have; the value is what follows the header
    Kind("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([^-]*+(?:-[^-]++){0,16}+-----END [A-Z ]*PRIVATE KEY-----|(?:[\s\\nr]{0,8}[A-Za-z0-9+/=]{32,}){0,200})", 1, base=False),
    Kind("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Kind("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    Kind("url", r"://[^\s/:@]++:[^\s/:@]++@", base=False),
)
#: A value that so many owners, or several owners in so many repositories, hold is a copied example.
SHARED_OWNERS = 3
SHARED_REPOS = 25
#: A live-looking value has so many different characters at least.
LIVE_CHARS = 6
#: Tasks over which the copies of one value are dealt where verdicts meet their spans.
SALTS = 16
REDACTED = "[SECRET]"
#: Elements of an array that are folded together.
BLOCK = 128


def running(values: Column, combine, block: int = BLOCK) -> Column:
    """For each of an array's integers the fold of those before it, from 0.

    An aggregate that builds an array copies it at each step, so blocks are folded first and put together by their totals:
    a long array costs a block's copies for each element, not its own.
    """
    empty = F.array().cast("array<int>")
    step = lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def blocks(v: Column) -> Column:
        each = F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / block).cast("int"))
        return F.transform(each, lambda b: F.aggregate(F.slice(v, b * block + 1, F.lit(block)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def joined(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        step = lambda a, b: F.struct(combine(a["at"], b["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(b["out"], lambda x: combine(a["at"], x)))).alias("out"))
        return F.flatten(F.aggregate(parts, start, step, lambda a: a["out"]))

    return let(values, lambda v: let(blocks(v), joined))


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """Leftmost non-overlapping matches: (start, kind_order, end, kind, value_hash, live_looking), in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)

    def row(match: Column, start: Column) -> Column:
        value = F.regexp_extract(match, kind.pattern, kind.group) if kind.group else match
        return F.struct(start.cast("long").alias("start"), F.lit(order).alias("kind_order"), (start + F.length(match)).cast("long").alias("end"), F.lit(kind.name).alias("kind"), F.sha2(value, 256).alias("value_hash"), (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS).alias("live_looking"), (F.length(value) >= kind.least).alias("long_enough"))

    def placed(matches: Column) -> Column:
        """The text between two matches is what split leaves, so lengths of both add up to the next start."""
        gaps = F.transform(F.split(text, kind.pattern), F.length)
        sizes = F.transform(matches, F.length)
        # a match begins behind its gap and all gaps and matches before
        starts = F.zip_with(gaps, running(F.zip_with(gaps, sizes, lambda g, m: g + F.coalesce(m, F.lit(0))), lambda a, b: a + b), lambda g, before: g + before)
        return F.filter(F.zip_with(matches, let(starts, lambda s: F.slice(s, 1, F.size(matches))), row), lambda x: x["long_enough"])

    kind_type = "array<struct<start:bigint,kind_order:int,end:bigint,kind:string,value_hash:string,live_looking:boolean,long_enough:boolean>>"
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(kind_type)).otherwise(placed(m)))


def scan(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds `found`: all spans of a text by start, then kind.

    A null or empty text has none. Each kind's matches are leftmost and don't overlap; those of several kinds may. A row's
    spans depend on its text alone. Columns pass through; one named `found` is replaced. No shuffle, no Python workers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("found", F.sort_array(F.concat(*[spans_of(text, k, n) for n, k in enumerate(kinds)])))


def ownership(scanned: DataFrame, repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """For each candidate value's hash: n_repos and n_owners, counted exactly over the whole corpus, and `shared`.

    Nulls are a repository or owner of their own; repeated rows count once; an empty table gives no rows. Distinct pairs are combined before they are dealt out, so a value that
    a third of the corpus holds reaches no task whole.
    """
    held = scanned.select(F.explode("found.value_hash").alias("value_hash"), F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"))
    counted = held.groupBy("value_hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    return counted.withColumn("shared", (F.col("n_owners") >= SHARED_OWNERS) | (F.col("n_owners") > 1) & (F.col("n_repos") >= SHARED_REPOS))


def judge(scanned: DataFrame, key: list[str], repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row for each key that has spans: key, n_live, n_shared and `live`, its live spans as (start, end).

    A span is live if its value looks so and few owners hold it. Rows with the same key count once; null keys are kept. An
    empty table, or one without spans, gives no rows.
    scanned: a materialised scan, read twice. Verdicts are copied SALTS times and each copy meets a share of the spans.
    """
    spans = scanned.dropDuplicates(key).select(*key, F.explode("found").alias("s")).select(*key, "s.start", "s.end", "s.value_hash", "s.live_looking").withColumn("salt", F.pmod(F.xxhash64(*key, "start"), F.lit(SALTS)).cast("int"))
    verdicts = ownership(scanned, repo_col, owner_col).select("value_hash", "shared", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    live = ~F.col("shared") & F.col("live_looking")
    return spans.join(verdicts, ["value_hash", "salt"]).groupBy(*key).agg(F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(F.col("shared"), 1)).alias("n_shared"), F.sort_array(F.collect_set(F.when(live, F.struct("start", "end")))).alias("live"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each (start, end) span, sorted by start, replaced by a mark; overlapping spans share one.

    Pieces are cut from the array of the text's characters, so a long text with many spans is read once.
    """
    chars = F.split(text, "")

    def cut(c: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"].cast("int"))
        pieces = F.zip_with(spans, running(ends, F.greatest), lambda s, to: F.when(s["start"] >= to, F.concat(F.array_join(F.slice(c, to + 1, F.greatest(s["start"].cast("int") - to, F.lit(0))), ""), F.lit(REDACTED))).otherwise(F.lit("")))
        last = F.coalesce(F.array_max(ends), F.lit(0))
        return F.concat(F.array_join(pieces, ""), F.array_join(F.slice(c, last + 1, F.size(c)), ""))

    return let(chars, cut)


def joined(found: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
