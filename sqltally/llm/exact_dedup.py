"""Exact duplicates: 128-bit content hash, one row kept per group, bytes compared inside groups.

Native: DataFrame operations only. Texts cross the network once, and only for the proof. Hashes are written
once, so the proof, the groups and the answer do not hash again.

Defined cases: a null text equals an empty one; a null id is smaller than any other and a group of null ids
keeps a null id; rows that repeat id and text are one document, all with the same answer, of which
``drop_copies`` returns one; an empty table gives an empty answer; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.llm.words import body
from sqltally.session import kept

#: Tasks over which the texts of one group are compared.
SPREAD = 16


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _split_groups(texts: DataFrame, groups: DataFrame, mark_of: Callable[[Column], Column]) -> DataFrame:
    """Marks under which at least two different texts meet.

    The least and the greatest text of a group are equal only if all are. Each group is compared in
    ``SPREAD`` parts first: no task reads the whole of a large group. The parts are more than their file's size lets
    the planner expect, so they are never broadcast.
    """
    parts = groups.select("mark", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    rows = texts.select(
        mark_of(F.col("text")).alias("mark"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int").alias("part"),
        "text",
    )
    return (
        rows.join(parts.hint("merge"), ["mark", "part"])
        .groupBy("mark", "part")
        .agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .groupBy("mark")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low <> high")
        .select("mark")
    )


def content_groups(docs: DataFrame, mark_of: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """Per row ``doc_id, keep_id, group_size, kept, text_sha256``; the largest id of equal texts is kept."""
    texts = docs.select("doc_id", body(F.col("text")).alias("text"))
    marks = kept(
        texts.select("doc_id", mark_of(F.col("text")).alias("mark"), F.sha2("text", 256).alias("text_sha256")),
        "exact-marks",
    )
    groups = kept(
        marks.groupBy("mark")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"),
        "exact-groups",
    )
    clashes = kept(_split_groups(texts, groups, mark_of), "exact-clashes")
    answer = ["doc_id", "keep_id", "group_size", "text_sha256"]
    single = F.col("group_size").isNull()
    if clashes.isEmpty():
        found = marks.join(groups, "mark", "left")
    else:
        # Different texts under one mark: those rows are grouped by the texts themselves.
        odd = texts.withColumn("mark", mark_of(F.col("text"))).join(clashes, "mark", "left_semi")
        by_text = kept(
            odd.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
            "exact-texts",
        )
        exact = odd.join(by_text, "text").select(
            "doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")
        )
        plain = marks.join(clashes, "mark", "left_anti").join(groups, "mark", "left")
        found = plain.select(answer).unionByName(exact)
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, all their columns."""
    stay = kept(content_groups(docs).where("kept").select("doc_id", "text_sha256").distinct(), "exact-stay")
    marked = docs.select(F.struct("*").alias("row"), "doc_id", F.sha2(body(F.col("text")), 256).alias("text_sha256"))
    same = marked["doc_id"].eqNullSafe(stay["doc_id"]) & (marked["text_sha256"] == stay["text_sha256"])
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text_sha256"]).select("row.*")
