"""A corpus pipeline of five stages over documents; each stage is written as Parquet and read again by the next.

Every stage keeps the columns of documents, the last one excepted, and knows a document by its id and text: other texts
under an id, null ids and repeated rows are judged on their own. Rows with a null or empty text go through the stages as
their operators define it: the quality classifier gives them the prior, they link with nothing, and they hold neither
benchmark passages nor secrets. Texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontamination, jaccard_join, quality_classifier, secret_scan
from lodestone.llm.common import materialise, read, remainder, remove, text_key
from lodestone.llm.queries import tokenizer_path

#: Documents of a lower score go.
LEAST_QUALITY = 0.5
#: Words in a shingle, and the similarity of near duplicates as a percentage.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from label rows that are not held out."""
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return quality_classifier.score(docs, model, least=LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id (nulls last), then the least hash of its text; documents without words all stay.

    A document is known by id and text, so other texts under its id are judged on their own. Of rows with equal id and
    text, the one with the least other columns stays; each task first takes its own least one.
    """
    members = materialise(jaccard_join.jaccard_join(docs, words=NEAR_WORDS, percent=NEAR_PERCENT, counts=False).members, "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    kept = members.where("root is not null").groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key"))
    again = members.where("root is not null").groupBy("doc_id", "text_key").count().where("count > 1")
    kept = materialise(kept.join(again.select(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key"), F.lit(True).alias("again")), F.col("kept_id").eqNullSafe(F.col("again_id")) & (F.col("kept_key") == F.col("again_key")), "left"), "kept")
    keyed = docs.withColumn("text_key", text_key(F.col("text")))
    empty = members.where("root is null").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), F.lit(False).alias("again")).distinct()
    found = kept.select("kept_id", "kept_key", F.coalesce("again", F.lit(False)).alias("again")).unionByName(empty)
    out = keyed.join(found, keyed.doc_id.eqNullSafe(found.kept_id) & (keyed.text_key == found.kept_key))
    once = out.where("not again").select(*docs.columns)
    if not kept.where("again").limit(1).count():
        return once
    of = out.where("again").groupBy("doc_id", "text_key").agg(F.min(F.struct(*docs.columns)).alias("least"))
    return once.unionByName(of.select(*[F.col(f"least.`{c}`") for c in docs.columns]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates."""
    found = materialise(decontamination.contamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated"), "contaminated")
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.bad_id) & (text_key(docs.text) == bad.bad_key), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live-looking secrets replaced by a mark, and n_chars to match; shared examples stay."""
    keyed = docs.withColumn("text_key", text_key(F.col("text")))
    spans = materialise(secret_scan.scan(keyed.select("doc_id", "source", "text", "text_key")).drop("text").where(F.size("found") > 0), "spans")
    judged = secret_scan.judge(spans, ["doc_id", "text_key"]).where("n_live > 0")
    live = materialise(judged.select(F.col("doc_id").alias("live_id"), F.col("text_key").alias("live_key"), "live"), "live")
    out = keyed.join(live, keyed.doc_id.eqNullSafe(live.live_id) & (keyed.text_key == live.live_key), "left")
    out = out.withColumn("redacted", F.when(F.col("live").isNotNull(), secret_scan.redact(F.col("text"), F.col("live"))))
    changed = {"text": F.coalesce("redacted", "text"), "n_chars": F.when(F.col("redacted").isNotNull(), F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
    return out.select(*[changed[c].alias(c) if c in changed else out[c] for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids, with digests of the ids and of the decoded text."""
    return bpe.encode(docs, tokenizer_path(), keep=["doc_id", "lang", "source"], digests=True)


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("bpe", encoded),
]
#: The classifier, the join's components and the encoding are beyond SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
            if k:
                remove(last)  # nothing reads the stage before any more
    return docs
