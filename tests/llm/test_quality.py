import re
from collections import Counter

from sqltally.llm import quality_rules as rules
from sqltally.llm.queries import QUERIES


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check(rows, found):
    expected = Counter((i, *by_hand(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_whole_table_and_its_labels(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op2_quality_rules"](spark, sf).collect()
    check(docs, found)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r for r in found if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_odd_rows(spark, odd_docs, odd_rows):
    labels = spark.createDataFrame(
        [(1, 0), (1, 1), (2, None), (None, 0), (99, 0), (7, 1), (8, 1)], "doc_id bigint, quality int"
    )
    check([r[:2] for r in odd_rows], rules.judge(odd_docs, labels).collect())
    check([r[:2] for r in odd_rows], rules.judge(odd_docs, labels.limit(0)).collect())
    assert rules.judge(odd_docs.limit(0), labels).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d e f g a b c d e f g h a b c d e", "a b c d e", "x " * 30_000 + "y"]
    found = rules.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in found} == {i: by_hand(t)[4] for i, t in enumerate(texts)}


def test_rules_find_a_planted_conjunction(spark):
    """Bad rows have many symbols and few distinct words; either alone is good."""
    import random

    draw, rows, names = random.Random(3), [], list(rules.features())
    for _ in range(3000):
        values = {n: draw.random() for n in names}
        bad = values["symbols_per_word"] > 0.7 and values["distinct_words"] < 0.4
        rows.append((bad, draw.randrange(3), *values.values()))
    schema = "bad boolean, part int, " + ", ".join(f"{n} double" for n in rules.features())
    found = rules.learn(spark.createDataFrame(rows, schema))
    tested = {(c.feature, c.at_least) for rule in found for c in rule}
    assert {("symbols_per_word", True), ("distinct_words", False)} <= tested
    data = spark.createDataFrame(rows, schema)
    columns = {n: data[n] for n in rules.features()}
    hit = [rules._all(rule, columns) for rule in found]
    caught = hit[0]
    for h in hit[1:]:
        caught = caught | h
    right = data.where(caught == data["bad"]).count()
    assert right >= 0.96 * len(rows)


def learned(spark, rows):
    """Rules of rows (bad, part, values), and what each row is told."""
    names = list(rules.features())
    schema = "bad boolean, part int, " + ", ".join(f"{n} double" for n in names)
    data = spark.createDataFrame([(bad, part, *[values[n] for n in names]) for bad, part, values in rows], schema)
    found = rules.learn(data)
    holds = lambda c, v: v[c.feature] >= c.threshold if c.at_least else v[c.feature] < c.threshold
    return found, [any(all(holds(c, v) for c in rule) for rule in found) for _, _, v in rows]


def test_more_than_eight_kinds_of_junk(spark):
    """Each feature's lowest and highest twentieth is junk: 18 kinds, one rule each at least."""
    import random

    draw, rows = random.Random(11), []
    names = list(rules.features())
    for i in range(9000):
        values = {n: draw.uniform(0.05, 0.95) for n in names}
        kind = i % 36
        if kind < 18:
            values[names[kind // 2]] = draw.uniform(0, 0.04) if kind % 2 else draw.uniform(0.96, 1)
        rows.append((kind < 18, draw.randrange(3), values))
    found, said = learned(spark, rows)
    assert len(found) >= 18
    assert sum(s for s, r in zip(said, rows) if r[0]) >= 0.95 * 4500
    assert sum(s for s, r in zip(said, rows) if not r[0]) <= 0.01 * 4500


def test_an_imprecise_kind_hides_no_precise_one(spark):
    """Many rows with symbols are bad in six of ten cases; a rarer kind, with capitals, always is."""
    import random

    draw, rows, names = random.Random(12), [], list(rules.features())
    for i in range(6000):
        values = {n: draw.random() * 0.9 for n in names}
        bad = False
        if i % 5 == 0:
            values["symbols_per_word"], bad = draw.uniform(0.95, 1), draw.random() < 0.6
        elif i % 50 == 1:
            values["capitals"], bad = draw.uniform(0.95, 1), True
        rows.append((bad, draw.randrange(3), values))
    _, said = learned(spark, rows)
    exact = [s for s, r in zip(said, rows) if r[2]["capitals"] > 0.94]
    assert sum(exact) >= 0.95 * len(exact)


def test_without_a_kind_no_rule(spark):
    """Labels by chance teach next to nothing."""
    import random

    draw, names = random.Random(13), list(rules.features())
    rows = [(draw.random() < 0.1, draw.randrange(3), {n: draw.random() for n in names}) for _ in range(4000)]
    _, said = learned(spark, rows)
    assert sum(s for s, r in zip(said, rows) if not r[0]) <= 0.005 * len(rows)
