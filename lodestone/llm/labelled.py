"""Labelled rows, all or a bounded sample, for fitting classifiers."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import long, map_texts

#: Least hashes of a text's shingles; texts that share one are near copies.
MINIMA = 4
#: Rows of ids at most that are told to all tasks; more are joined by a shuffle.
TOLD = 2_000_000


def every(labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id") -> DataFrame:
    """doc_id and y (0 or 1) of every labelled row.

    usable: a condition on the label table. Null ids and labels are left out; an id with two labels counts once, as 1.
    """
    return labels.where(usable).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(labels: DataFrame, label_col: str, usable: Column, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """Of every() at most per_class rows of each class, those with the least hash of their id."""
    rows = every(labels, label_col, usable, id_col)
    one = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return one(0).unionByName(one(1))


def minima(text: str | None) -> list[int | None]:
    """The least hash of a text's three-word shingles under each of MINIMA orders; of a text without words, none."""
    words = (text or "").split()
    if not words:
        return [None] * MINIMA
    h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    n = max(len(h) - 2, 1)
    h = sum((h[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) for k in range(min(3, len(h))))
    return [int(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 4 * k) >> np.uint64(1)).min()) for k in range(MINIMA)]


def texts(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and y of the sampled rows; of a group of copies or near copies, one for each y counts, so that none outvotes the rest.

    Of an id's texts the least counts, and of copies the one of the least id, then the least text, so that every layout
    of the table gives the same rows. Null texts are empty.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most 2 * per_class ids
    names = [f"least{k}" for k in range(MINIMA)]
    found = map_texts(found, "text", [long(x) for x in names], lambda: lambda texts: list(zip(*map(minima, texts), strict=True)) or [[]] * MINIMA)
    for x in names:
        rest = ["doc_id", "text", *[n for n in names if n != x]]
        found = found.groupBy(x, "y").agg(F.min(F.struct(*rest)).alias("first")).select(x, "y", "first.*")
    return found.select("text", "y")


def _told(rows: DataFrame) -> DataFrame:
    """Materialised rows, broadcast while they are few."""
    return F.broadcast(rows) if rows.count() <= TOLD else rows


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def once(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and y of every text of the chosen rows; of near copies of one y the least id and key stands for all.

    chosen: materialised doc_id and y. Near copies agree in all but one of MINIMA least hashes, which texts that share
    less than half of their shingles hardly do. Texts stay where they are; keys and hashes are shuffled.
    """
    names = [f"least{k}" for k in range(MINIMA)]
    found = _keyed(docs, id_col, text_col).join(_told(chosen), "doc_id")
    found = map_texts(found, "text", [long(x) for x in names], lambda: lambda texts: list(zip(*map(minima, texts), strict=True)) or [[]] * MINIMA, ["doc_id", "text_key", "y"])
    for x in names:
        same = [n for n in names if n != x]
        found = found.groupBy(*same, "y").agg(F.min(F.struct("doc_id", "text_key", x)).alias("first")).select(*same, "y", "first.*")
    return found.select("doc_id", "text_key", "y")


def all_texts(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """y, text_key and text of the rows of once(), materialised; a row that stands several times in docs does so here."""
    return _keyed(docs, id_col, text_col).join(_told(rows), ["doc_id", "text_key"]).select("y", "text_key", "text")
