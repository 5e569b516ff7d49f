"""Quality rules: text statistics, base limits and a learned decision list. DataFrame operations only.

Statistics are taken once per document and written; learning and judging read the written table. Learning is
sequential covering on the labelled rows: rules grow by the threshold condition with the highest information
gain on two thirds of the rows and are pruned to the prefix that does best on the last third; those precise enough
are kept; rows that they cover leave, and the next rule follows until none is precise. Every step is one aggregation
into a table of counts per feature and bin (some thousand rows), so learning reads all labelled rows, whatever their
number. The list becomes ordered conditional expressions.

Defined cases: null and blank texts have no words, fail the base limits and are dropped; a null id has no label;
of several labels of an id the lowest counts, null labels and labels of unknown ids are ignored; repeated rows each
get their answer; without two kinds of labels the list is empty and only the base limits act; an empty table gives
an empty answer; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltally.llm.words import body, words
from sqltally.session import kept

WINDOW = 5
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_calls", "n_distinct"]


def _covered(table: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``_words``: words inside windows that the text holds at least twice.

    Windows are compared by 64-bit hashes of word hashes. Texts without a repeated window, most of them, need no sort.
    For the others the windows are sorted with their places; those equal to a neighbour are marked, and each mark covers
    words up to the next mark, at most a window.
    """
    span = F.size("_words") - WINDOW
    table = table.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i: [F.get("_hashes", i + k) for k in range(WINDOW)]
    windows = F.transform(F.sequence(F.lit(0), span), lambda i: F.xxhash64(*at(i)))
    table = table.withColumn("_windows", F.when(span > 0, windows))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    table = table.withColumn("_placed", F.when(repeats, placed))
    twice = F.filter(
        "_placed",
        lambda x, j: F.coalesce(x["h"] == F.get("_placed", j - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("_placed", j + 1)["h"], F.lit(False)),
    )
    table = table.withColumn("_marks", F.array_sort(F.transform(twice, lambda x: x["i"])))
    reach = F.transform("_marks", lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_marks", j + 1) - v, F.lit(WINDOW))))
    total = F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return table.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint")))


def _number(pattern: str) -> Column:
    """Characters of the text outside the pattern's matches."""
    return F.length(F.regexp_replace("_text", pattern, "")).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every row."""
    table = docs.select("doc_id", body(F.col("text")).alias("_text")).withColumn("_words", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    table = _covered(table).withColumn("_lines", lines)
    return table.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        _number(r"[ \t-\r]+").alias("word_chars"),
        _number(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("bigint").alias("n_lines"),
        _number(r"\P{Lu}+").alias("n_capitals"),
        _number(r"[^!?]+").alias("n_calls"),
        F.size(F.array_distinct("_hashes")).cast("bigint").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Interpretable numbers that conditions may test; 0 where nothing is there to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "words_per_line": share("n_words", "n_lines"),
        "capitals": share("n_capitals", "word_chars"),
        "calls_per_word": share("n_calls", "n_words"),
        "distinct_words": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, column: Column) -> Column:
        return column >= self.threshold if self.at_least else column < self.threshold


def _all(conditions: list[Condition], columns: dict[str, Column]) -> Column:
    result = F.lit(True)
    for c in conditions:
        result = result & c.holds(columns[c.feature])
    return result


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on the covered bad rows when p of p0 bad and n of n0 good rows stay."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(
    labelled: DataFrame, bins: int = 24, max_conditions: int = 4, precision: float = 0.9, least: int = 4
) -> list[list[Condition]]:
    """Rules for bad rows from ``bad`` (boolean), ``part`` (0 to 2; 2 prunes) and the features, as doubles.

    A rule must cover ``least`` bad rows or a thousandth of them, two where it is pruned, and reach ``precision`` where it is pruned
    and where it is grown. If the rule grown from the best first condition does not, rules grow from those of every other feature
    and direction, side by side in the same few aggregations, so a kind of junk that no precise rule describes hides no other one;
    those precise enough are taken. The list ends when none is. Each rule takes ``least`` bad rows away, so it does end.
    """
    names = list(features())
    # The ends too: where the good rows begin and end, a kind of junk may begin.
    probes = [i / bins for i in range(bins + 1)]
    cuts = labelled.groupBy("bad").agg(*[F.percentile_approx(n, probes, 2000).alias(n) for n in names]).collect()
    if len(cuts) < 2:
        return []
    thresholds = {n: sorted({t for row in cuts for t in row[n]}) for n in names}
    binned = kept(
        labelled.select(
            "bad",
            "part",
            *[sum((F.when(F.col(n) >= t, 1).otherwise(0) for t in ts), F.lit(0)).cast("smallint").alias(n) for n, ts in thresholds.items()],
        ),
        "quality-bins",
    )
    place = {n: {t: i + 1 for i, t in enumerate(ts)} for n, ts in thresholds.items()}

    def inside(conditions: list[Condition]) -> Column:
        return _all([Condition(c.feature, c.at_least, place[c.feature][c.threshold]) for c in conditions],
                    {n: F.col(n) for n in names})

    def counted(rest: DataFrame, tried: list[list[Condition]]) -> list[list]:
        """Per rule the bad and good growing rows that it covers, by feature and bin."""
        mine = F.filter(F.array(*[F.when(inside(rule), i) for i, rule in enumerate(tried)]), lambda i: i.isNotNull())
        rows = rest.where(F.col("part") < 2).select("bad", *names, F.explode(mine).alias("rule"))
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names]))
        found = (
            rows.select("bad", "rule", cells.alias("cell")).groupBy("rule", "cell.name", "cell.bin")
            .agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n"))
            .collect()
        )
        return [[r for r in found if r["rule"] == i] for i in range(len(tried))]

    def grown(rest: DataFrame, tried: list[list[Condition]]) -> list[list[Condition]]:
        """The rules, each grown by its best conditions, side by side; and their prefixes, longer ones later."""
        growing = [rule for rule in tried if len(rule) < max_conditions]
        while growing:
            more = []
            for rule, counts in zip(growing, counted(rest, growing)):
                found, good = _gains(counts, thresholds, names, least)
                if found and good:
                    rule.append(max(found.values(), key=lambda x: x[0])[1])
                    more.append(rule)
            growing = [rule for rule in more if len(rule) < max_conditions]
        return [rule[: k + 1] for rule in tried for k in range(len(rule))]

    def precise(rest: DataFrame, tried: list[list[Condition]]) -> list[list[Condition]]:
        """The rules that are precise enough, the best prefix of each first condition; those that cover most bad rows first."""
        cover = F.filter(F.array(*[F.when(inside(rule), j) for j, rule in enumerate(tried)]), lambda j: j.isNotNull())
        prune = F.col("part") == 2
        sums = {
            r["j"]: (r["p"], r["n"], r["grown_p"], r["grown_n"])
            for r in rest.select("bad", "part", F.explode(cover).alias("j")).groupBy("j").agg(
                F.count_if(F.col("bad") & prune).alias("p"), F.count_if(~F.col("bad") & prune).alias("n"),
                F.count_if(F.col("bad") & ~prune).alias("grown_p"), F.count_if(~F.col("bad") & ~prune).alias("grown_n"),
            ).collect()
        }
        best = {}
        for j, rule in enumerate(tried):
            p, n, grown_p, grown_n = sums.get(j, (0, 0, 0, 0))
            worth = ((p - n) / max(1, p + n), p, -len(rule))
            if rule[0] not in best or worth > best[rule[0]][0]:
                enough = p >= 2 and p + grown_p >= needed and min(p / (p + n), grown_p / max(1, grown_p + grown_n)) >= precision
                best[rule[0]] = (worth, p + grown_p, rule, enough)
        return [rule for _, _, rule, enough in sorted(best.values(), key=lambda x: -x[1]) if enough]

    rules: list[list[Condition]] = []
    rest = binned
    needed = max(least, binned.where("bad").count() / 1000)
    while True:
        found, good = _gains(counted(rest, [[]])[0], thresholds, names, least)
        if not found or not good:
            return rules
        firsts = sorted(found.values(), key=lambda x: -x[0])
        good_rules = precise(rest, grown(rest, [[firsts[0][1]]]))
        if not good_rules and len(firsts) > 1:
            good_rules = precise(rest, grown(rest, [[c] for _, c in firsts[1:]]))
        if not good_rules:
            return rules
        while good_rules:
            rules.append(good_rules[0])
            rest = rest.where(~inside(good_rules[0]))
            # The others may cover the same rows: they are judged anew on what is left.
            good_rules = precise(rest, good_rules[1:]) if len(good_rules) > 1 else []


def _gains(counts: list, thresholds: dict, names: list[str], least: int) -> tuple[dict[tuple[str, bool], tuple[float, Condition]], int]:
    """Per feature and direction the condition with the highest gain, from counts per feature and bin; and the good rows before it."""
    found, p0, n0 = {}, 0, 0
    for name in names:
        ts = thresholds[name]
        p, n = [0] * (len(ts) + 1), [0] * (len(ts) + 1)
        for row in counts:
            if row["name"] == name:
                p[row["bin"]], n[row["bin"]] = row["p"], row["n"]
        p0, n0, below_p, below_n = sum(p), sum(n), 0, 0
        if not p0:
            return {}, n0
        for i, t in enumerate(ts):
            below_p, below_n = below_p + p[i], below_n + n[i]
            for at_least, a, b in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                if a >= least and (gain := _gain(a, b, p0, n0)) > found.get((name, at_least), (1e-9, None))[0]:
                    found[name, at_least] = (gain, Condition(name, at_least, t))
    return found, n0


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that rejects a row, from 1; 0 if none does."""
    columns, result = features(), None
    for i, rule in enumerate(rules):
        test = _all(rule, columns)
        result = F.when(test, i + 1) if result is None else result.when(test, i + 1)
    return F.lit(0) if result is None else result.otherwise(0)


def describe(rules: list[list[Condition]]) -> list[str]:
    sign = {True: ">=", False: "<"}
    return [" and ".join(f"{c.feature} {sign[c.at_least]} {c.threshold:g}" for c in rule) for rule in rules]


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row ``doc_id``, the counts, ``base_failed``, ``kept`` and ``rule``, the list's rule that rejects it (0: none)."""
    stats = kept(statistics(docs), "quality-stats")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("part")
    # Rows that the base limits drop already teach nothing that the list is asked for.
    labelled = kept(
        stats.where(~base_failed()).join(known, "doc_id").select(
            (F.col("quality") == 0).alias("bad"), part, *[c.alias(n) for n, c in features().items()]
        ),
        "quality-labelled",
    )
    rules = learn(labelled, **how)
    return stats.select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), verdict(rules).cast("int").alias("rule")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
