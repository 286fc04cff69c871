"""Quality rules: every rule is evaluated once into a ledger of failure bits and measurements; policies are masks over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free

WORD = r"[^\x20\x09-\x0D]+"
SOME_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words stand in a window of words that occurs twice or more, every occurrence included."""
    last = F.size(words) - window

    def positions(at: Column) -> Column:
        """at: (hash, position) of all windows, sorted, so that equal windows are neighbours; the positions of those, sorted."""
        same = lambda i: F.get(at, i)["h"] == F.get(at, i + 1)["h"]
        return F.sort_array(F.filter(F.transform(at, lambda x, i: F.when(((i > 0) & same(i - 1)) | F.coalesce(same(i), F.lit(False)), x["p"])), lambda p: p.isNotNull()))

    def covered(spots: Column) -> Column:
        """Words that windows at these positions cover."""
        return F.aggregate(F.transform(spots, lambda p, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), p - F.get(spots, i - 1)))), F.lit(0), lambda n, x: n + x)

    def hashed(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(paired, lambda at: let(positions(at), covered)))

    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    return F.when(last < 1, F.lit(0)).otherwise(let(windows, hashed)).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper (long).

    A null text measures as an empty one: all zero.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SOME_WORD))
    of_words, of_lines = free("words", docs.columns), free("lines", docs.columns)
    made = {
        of_words: let(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("again"))),
        of_lines: let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
    }
    put = {"n_words": f"{of_words}.n", "word_chars": f"{of_words}.chars", "n_repeat_words": f"{of_words}.again", "n_lines": f"{of_lines}.n", "n_dup_lines": f"{of_lines}.dup"}
    count = lambda of: F.regexp_count(text, F.lit(of)).cast("long")
    return docs.withColumns(made).withColumns({k: F.col(v) for k, v in put.items()} | {"n_symbols": count(SYMBOL), "n_upper": count("[A-Z]")}).drop(*made)


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds; its place in the rule list is its bit."""

    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


#: Bit k is rule k. New rules go at the end, so that bits of stored ledgers keep their meaning.
RULES = (
    Rule("few_words", lambda: _c("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule("symbols", lambda: 100 * _c("n_symbols") > 10 * _c("n_words")),
    Rule("duplicate_lines", lambda: 100 * _c("n_dup_lines") > 50 * _c("n_lines")),
    Rule("short_words", lambda: _c("word_chars") < 2 * _c("n_words")),
    Rule("long_words", lambda: _c("word_chars") > 20 * _c("n_words")),
    Rule("upper_case", lambda: 100 * _c("n_upper") > 50 * _c("word_chars")),
)
#: Policies by version: the names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case"),
}


def mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    at = {r.name: 1 << k for k, r in enumerate(rules)}
    return sum(at[n] for n in set(names))


def ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measurements and fail_bits (long): bit k is set where rule k fails. Each rule is evaluated once.

    A null text counts as empty and fails few_words. Results depend on the row's text alone, so ties and repeated rows
    repeat them; other columns pass through, and one that has a result's name is replaced. No shuffle, no Python workers.
    """
    bits = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def apply_policy(kept: DataFrame, policy: str | tuple[str, ...], out_col: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the verdict of a policy over a ledger: true where none of its rules fails."""
    return kept.withColumn(out_col, F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablations(kept: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows it fails, rows that it alone rejects, and rows kept without it.

    The ledger is summed by bit pattern first, at most 2 ** rules rows, so texts and measurements are not read again.
    An empty ledger gives zeros.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(policy, rules)
    patterns = kept.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    spark = kept.sparkSession
    asked = spark.createDataFrame([(n, mask((n,), rules)) for n in names], "rule string, bit long")
    total = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    # at most 2 ** rules patterns, by the few rules of the policy
    return F.broadcast(asked).join(patterns, F.lit(True), "left").groupBy("rule").agg(total(fails)("n_failed"), total(F.col("bits") == F.col("bit"))("n_only"), total(F.col("bits").bitwiseAND(F.lit(whole) - F.col("bit")) == 0)("n_kept_without"))
