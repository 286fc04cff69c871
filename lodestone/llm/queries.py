"""The queries of this subpackage: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontamination, gru_lm, html_extract, jaccard_join, quality_classifier, quality_rules, quote_linking, secret_scan, toxicity
from lodestone.llm.common import materialise, read, remainder, text_key


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents")).members.select("doc_id", "n_shingles", "component_id", "n_links")


def _scored(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return _scored(quality_classifier.score(docs, model, keep=["doc_id"]), held_out)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return _scored(toxicity.score(docs, model, keep=["doc_id"]), held_out)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask("base")).cast("long")) != 0
    return quality_rules.apply_policy(kept, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.chat_format(read(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's index searched for places where the rarest words of an item stand near one another."""
    stored = decontamination.tokens(read(spark, sf_dir, "documents"))
    return decontamination.proximity_matches(stored, read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "first", "last")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's ledger summed by bit pattern: what each rule fails, what it alone fails, and what would be kept without it."""
    kept = quality_rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.ablations(kept, "v1")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("text_key", text_key(F.col("text")))
    scanned = materialise(secret_scan.scan(docs).drop("text"), "spans")
    judged = secret_scan.judge(scanned.where(F.size("found") > 0), ["doc_id", "text_key"]).select(F.col("doc_id").alias("judged_id"), F.col("text_key").alias("judged_key"), "n_live", "n_shared")
    base = {k.name for k in secret_scan.KINDS if k.base}
    of_base = F.filter("found", lambda x: x["kind"].isin(*sorted(base)))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    out = scanned.join(judged, scanned.doc_id.eqNullSafe(judged.judged_id) & (scanned.text_key == judged.judged_key), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(secret_scan.joined(of_base), 256).alias("base_sha256"), secret_scan.joined(F.col("found")).alias("spans"), zero("n_live"), zero("n_shared"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(read(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"], ids=False, digests=True)


def queries() -> dict:
    return {f.__name__: f for f in (op1_jaccard_join, op2_quality_classifier, op3_quality_rules, op4_chat_format, op5_decontamination, op6_secret_scan, op7_toxicity, op8_html_extract, op9_gru_lm, op10_bpe, proximity_matches, rule_ablations)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD, _ALNUM = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP1 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_WORD}) as ws from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end) as g from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from shared join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
r as (select x, y from l union select y, x from l),
c(x, y) as (select doc_id, doc_id from documents union select c.x, r.y from c join r on c.y = r.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, coalesce(k.n_links, 0) as n_links from documents d left join n on n.doc_id = d.doc_id
left join (select x, count(*) as n_links from r group by x) k on k.x = d.doc_id
join (select x, min(y) as component_id from c group by x) m on m.x = d.doc_id"""

_OP3 = f"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) as ls from documents),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from w where len(ws) > 2),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as k from g) where k > 1),
covered as (select doc_id, count(distinct i + o) as n from again, (values (0), (1), (2)) o(o) group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) as n_upper
  from w left join covered on covered.doc_id = w.doc_id),
b as (select *, (n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (100 * n_symbols > 10 * n_words)::int + 8 * (100 * n_dup_lines > 50 * n_lines)::int
  + 16 * (word_chars < 2 * n_words)::int + 32 * (word_chars > 20 * n_words)::int + 64 * (100 * n_upper > 50 * word_chars)::int as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 as base_failed, bits = 0 as kept, cast(bits as bigint) as fail_bits from b"""

_OP5 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from documents),
i as (select cast(item_id as varchar) as item_id, ws, least(13, len(ws)) as size from (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from benchmark) where len(ws) > 0),
iw as (select distinct item_id, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda k: array_to_string(ws[k : k + size - 1], ' '))) as g from i),
dw as (select doc_id, size, unnest(range(1, len(ws) - size + 2)) as p, unnest(list_transform(range(1, len(ws) - size + 2), lambda k: array_to_string(ws[k : k + size - 1], ' '))) as g
  from d, (select distinct size from i) where len(ws) >= size),
hit as (select doc_id, item_id, p, iw.size as size from dw join iw on dw.g = iw.g and dw.size = iw.size),
n as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(p, p + size)) as k from hit) group by doc_id),
f as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from d left join n on n.doc_id = d.doc_id left join f on f.doc_id = d.doc_id"""


_SPANS = (
    ("assign", """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", "[0-9a-f]{24,}", 0, 0),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([^-]*(?:-[^-]+){0,16}-----END [A-Z ]*PRIVATE KEY-----|(?:[\s\\nr]{0,8}[A-Za-z0-9+/=]{32,})*)", 1, 0),
    ("hosted", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("url", r"://[^\s/:@]+:[^\s/:@]+@", 0, 0),
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FOUND = " union all ".join(
    f"select doc_id, source, {k} as k, '{kind}' as kind, i, ms, gaps, regexp_extract(ms[i], {_quoted(pattern)}, {group}) as value, {least} as least from (select *, unnest(range(1, len(ms) + 1)) as i from (select doc_id, source, regexp_extract_all(t, {_quoted(pattern)}) as ms, string_split_regex(t, {_quoted(pattern)}) as gaps from d) where len(ms) > 0)"
    for k, (kind, pattern, group, least) in enumerate(_SPANS)
)
_OP6 = f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
f as (select * from ({_FOUND}) where length(value) >= least),
p as (select *, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as a, length(ms[i]) as size from f),
o as (select value, count(distinct doc_id) as repos, count(distinct coalesce(source, chr(0))) as owners from p group by value),
j as (select p.*, owners >= {secret_scan.SHARED_OWNERS} or owners > 1 and repos >= {secret_scan.SHARED_REPOS} as shared, len(list_distinct(string_split(p.value, ''))) >= {secret_scan.LIVE_CHARS} as looks from p join o on o.value = p.value),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || a || ':' || (a + size), ',' order by a, k) as spans, string_agg(kind || ':' || a || ':' || (a + size), ',' order by a, k) filter (k < 3) as base,
  count(*) filter (not shared and looks) as n_live, count(*) filter (shared) as n_shared from j group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_shared, 0) as n_shared from d left join g on g.doc_id = d.doc_id"""

_PROXIMITY = f"""
with d as (select doc_id, unnest(range(1, len(ws) + 1)) - 1 as pos, unnest(ws) as term from (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from documents)),
i as (select distinct cast(item_id as varchar) as item_id, ws from (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from benchmark) where len(ws) > 0),
n as (select term, count(*) as n from d group by term),
r as (select item_id, ws, term, row_number() over (partition by item_id, ws order by n, term) as k
  from (select item_id, ws, t.term, coalesce(n.n, 0) as n from (select item_id, ws, unnest(list_distinct(ws)) as term from i) t left join n on n.term = t.term)),
w as (select *, count(*) over (partition by item_id, ws) as needed from r where k <= 3),
h as (select distinct doc_id, item_id, ws, needed, pos, w.term from d join w on d.term = w.term),
e as (select a.doc_id, a.item_id, a.ws, a.pos, a.needed, b.term, min(b.pos) as pos_b from h a join h b on a.doc_id = b.doc_id and a.item_id = b.item_id and a.ws = b.ws and b.pos between a.pos and a.pos + 29 group by all)
select distinct doc_id, item_id, pos as first, max(pos_b) as last from e group by doc_id, item_id, ws, pos, needed having count(*) = needed"""

_NAMES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "upper_case")
_ABLATIONS = f"with l as ({_OP3}) " + " union all ".join(
    f"select '{name}' as rule, count(*) filter (fail_bits & {1 << k} <> 0) as n_failed, count(*) filter (fail_bits = {1 << k}) as n_only, count(*) filter (fail_bits & {127 - (1 << k)} = 0) as n_kept_without from l"
    for k, name in enumerate(_NAMES)
)


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL, or need positions of matches; tests hold them against brute force."""
    return {"op1_jaccard_join": _OP1, "op3_quality_rules": _OP3, "op5_decontamination": _OP5, "op6_secret_scan": _OP6, "proximity_matches": _PROXIMITY, "rule_ablations": _ABLATIONS}
