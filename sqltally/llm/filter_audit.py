"""What each of several filters removes, in every order, and its fair share of the whole: an audit of their interaction.

Each document's failures become one bit mask, and each part of the corpus one histogram over the masks. A coalition of filters
removes the documents that fail any of them: the removal game. Everything else follows from the game's value for every coalition:

* a step of an order removes the difference between the coalitions after and before it;
* the potential of a coalition is (its value + the potentials of the coalitions with one filter less) / its size, from the empty one up; a
  filter's Shapley value is the potential of all filters minus the potential of all but that one. With potentials counted in
  ``n!``-ths every division is exact, and the share is the sum over all ``n!`` orders of what the filter removes.

Texts meet by their SHA-256, never themselves; a group of copies is one partial minimum per task. Documents are counted, not
moved, and only rows with labels are shuffled to meet them. What is left are at most ``2^n`` rows a part.

Defined cases: a null text is empty, a null part is the empty string; rows that repeat an id count each, and none of them is a copy of
the other; a null id is smaller than no id, so such a row copies nothing and is copied by nothing, and it has no label; an id with
several label rows has a label if any row gives it; null labels are none; an empty table gives an empty answer; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.llm.words import body, words
from sqltally.session import kept

#: One letter per filter, that for copies last.
NAMES = "ABCDE"


def text_failures(text: Column, found: Column) -> dict[str, Column]:
    """The filters on a text and its array of words by letter: true where a document fails."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(found) < 100,
        "B": 100 * F.size(F.array_distinct(found)) < 80 * F.size(found),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """Per row ``doc_id, part, mask``: bit ``k`` is set if the row fails the ``k``-th filter, the last bit if it is a copy."""
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), body(F.col("text")).alias("text")
    ).withColumn("found", words(F.col("text")))
    tests = list(text_failures(F.col("text"), F.col("found")).values())
    mask = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    facts = kept(
        rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("mark")), "audit-facts"
    )
    groups = facts.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = kept(groups.select("mark", "first"), "audit-copies")
    later = F.when(F.col("doc_id") > F.col("first"), 1 << len(tests)).otherwise(0)
    return facts.join(copies, "mark", "left").select("doc_id", "part", (F.col("mask") + later).alias("mask"))


def histogram(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents with that mask, and those of them with quality 1 and toxic 1."""
    told = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("bigint")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("bigint")).alias("toxic"),
    )
    counted = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    labelled = masked.join(told, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    zero = F.lit(0).cast("bigint")
    both = counted.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(
        labelled.select("part", "mask", zero.alias("n"), "good", "toxic")
    )
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def games(counts: DataFrame, n_filters: int) -> DataFrame:
    """Per part arrays over all coalitions, by their bit mask: what they remove of all, good and toxic documents.

    Beside them ``total``, the part's documents, and ``only``, per mask the documents with just that mask.
    """
    size = 1 << n_filters
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    spread = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    values = spread.groupBy("part", "coalition").agg(
        *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")],
        F.sum(F.when(F.col("mask") == F.col("coalition"), F.col("n")).otherwise(0)).alias("only"),
        F.sum("n").alias("total"),
    )
    columns = ["n", "good", "toxic", "only"]
    rows = values.groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("coalition", *columns))).alias("game"), F.max("total").alias("total")
    )
    return rows.select("part", "total", *[F.col(f"game.{c}").alias(c) for c in columns])


def potentials(game: DataFrame, n_filters: int, value: str = "n") -> DataFrame:
    """Add ``potential``: that of each coalition in ``n_filters!``-ths, those of one size from those of the size below."""
    size, whole = 1 << n_filters, factorial(n_filters)
    made = game.withColumn("potential", F.array_repeat(F.lit(0).cast("bigint"), size))
    for members in range(1, n_filters + 1):
        cells = []
        for s in range(size):
            below = [f"potential[{s ^ 1 << k}]" for k in range(n_filters) if s >> k & 1]
            total = " + ".join([f"{whole} * {value}[{s}]", *below])
            cells.append(f"({total}) div {members}" if s.bit_count() == members else f"potential[{s}]")
        made = made.withColumn("potential", F.expr(f"array({', '.join(cells)})"))
    return made


def audit(masked: DataFrame, labels: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step; ``names`` has one letter per bit of ``mask``.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed before), ``unique_fails`` (fail no other
    filter), ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``, what the filter removes summed over all orders.
    """
    n = len(names)
    every = (1 << n) - 1
    told = potentials(games(histogram(masked, labels), n), n)
    orders = F.split(F.lit(" ".join("".join(o) for o in permutations(names))), " ")
    steps = told.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def coalition(letters: Column) -> Column:
        return sum((F.when(letters.contains(name), 1 << k).otherwise(0) for k, name in enumerate(names)), F.lit(0))

    steps = steps.withColumns({
        "_own": coalition(F.substring("filter_order", F.col("step"), F.lit(1))),
        "_now": coalition(F.substring("filter_order", F.lit(1), F.col("step"))),
    }).withColumn("_before", F.col("_now") - F.col("_own"))
    lost = lambda c: F.col(c)[F.col("_now")] - F.col(c)[F.col("_before")]
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("n")[F.col("_now")]).alias("kept"),
        lost("n").alias("removed"),
        (F.col("n")[F.col("_own")] - lost("n")).alias("redundant"),
        F.col("only")[F.col("_own")].alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        (F.col("potential")[every] - F.col("potential")[F.lit(every) - F.col("_own")]).alias("shapley"),
    )
