"""Line dedup by overlapping windows of three lines.

Lines with a word are numbered within their document; every three consecutive ones form a window, known by 128 bits of hash.
The first place of each window in the corpus, by document id and line number, stays; every later place marks
its three lines, and the marks of a document are merged into covered positions, which are removed. DataFrame
operations only: windows are aggregated before they are shuffled, and only repeated windows are looked up again.

Defined cases: a null text has no lines and stays null; lines without a word are in no window and stay; documents of fewer than
three lines with words stay as they are; a null id comes before all others; rows that repeat an id share their
places: where equal texts repeat an id, each row is as the first; an empty table gives an empty answer; other
columns are kept by ``deduplicated`` and ignored by ``repeated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.llm.words import body
from sqltally.session import kept

WINDOW = 3


def _lines(text: Column) -> Column:
    """Structs of line number and line, for the lines with a word."""
    numbered = F.transform(F.split(body(text), "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(r"[^ \t-\r]"))


def windows(docs: DataFrame) -> DataFrame:
    """``doc_id, n`` (place among lines with words), ``high, low`` (128 bits of hash) per window."""
    hashed = docs.select(
        "doc_id",
        F.transform(
            _lines(F.col("text")),
            lambda x: F.struct(F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b")),
        ).alias("_h"),
    )
    of = lambda i, part: [F.get("_h", i + k)[part] for k in range(WINDOW)]
    made = F.transform(
        F.sequence(F.lit(0), F.size("_h") - WINDOW),
        lambda i: F.struct(i.alias("n"), F.xxhash64(*of(i, "a")).alias("high"), F.xxhash64(*of(i, "b")).alias("low")),
    )
    return hashed.where(F.size("_h") >= WINDOW).select("doc_id", F.explode(made).alias("_w")).select("doc_id", "_w.*")


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, covered``: for documents with later places of windows, the places covered, ascending."""
    found = kept(windows(docs), "line-windows")
    place = F.struct("doc_id", "n")
    firsts = kept(
        found.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("NOT first <=> last").select("high", "low", "first"),
        "line-firsts",
    )
    later = found.join(firsts, ["high", "low"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "n")
    covered = F.explode(F.array(*[F.col("n") + k for k in range(WINDOW)]))
    return later.select("doc_id", covered.alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_set("n")).alias("covered"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with later places removed from ``text``; the columns ``n_lines`` and ``n_removed`` follow."""
    marks = kept(repeated(docs), "line-covered")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    joined = rows.join(marks.hint("merge"), rows["doc_id"].eqNullSafe(marks["doc_id"]), "left").select("row", "text", "covered")
    # Places among lines with words become numbers among all lines, then those lines go.
    found = joined.withColumn("places", F.transform(_lines(F.col("text")), lambda x: x["at"]))
    gone = F.transform(F.filter("covered", lambda n: n < F.size("places")), lambda n: F.get("places", n))
    cut = found.withColumn("gone", F.when(F.col("covered").isNotNull(), gone)).withColumn(
        "lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n"))
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return cut.select(
        *[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns],
        F.size("places").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
