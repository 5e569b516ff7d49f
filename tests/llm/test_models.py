"""Language identification and toxicity: exact parts by hand, learned parts on held-out rows."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sqltally.llm import language, toxicity
from sqltally.llm.queries import QUERIES


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_ngrams_do_not_depend_on_segments(monkeypatch):
    texts = ["", "1 2", "Été in the Haus", "aB", "x" * 50 + " y" * 50, "ǅ ß İ 漢字 𐐀"]
    whole = language.counts(texts)
    monkeypatch.setattr(language, "SEGMENT", 7)
    assert (language.counts(texts) == whole).all()
    assert whole[0].sum() == whole[1].sum() == 0
    assert whole[2].sum() == 2 * sum(c.isalpha() for c in texts[2])


def test_language_of_the_whole_table(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op3_language_id"](spark, sf).collect()
    assert Counter(r.doc_id for r in found) == Counter(list(docs))
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in found)
    unseen = [r for r in found if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in unseen) >= 0.95 * len(unseen)


def test_language_of_odd_rows(odd_docs, odd_rows):
    found = language.languages(odd_docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd_rows)
    unknown = Counter(r[0] for r in odd_rows if not any(c.isalpha() for c in r[1] or ""))
    assert Counter(r.doc_id for r in found if r.lang_pred == "und") == unknown
    assert all(r.lang_pred in ("und", "en", "de") for r in found)
    assert language.languages(odd_docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.languages(odd_docs.where("lang IS NULL")).collect()} == {"und"}


def test_machine_learns_a_pair():
    """Two terms that mean something only together."""
    draw = np.random.default_rng(1)
    sets = [np.flatnonzero(draw.random(6) < 0.5) for _ in range(4000)]
    labels = np.array([float(0 in s and 1 in s) for s in sets])
    bias, linear, pairs = toxicity.fit(sets, labels, 6)
    machine = toxicity.Machine(bias, np.arange(6), linear, pairs)
    score = lambda *terms: machine.scores(np.array(terms, np.int64), np.array([len(terms)]))[0]
    assert score(0, 1) > 0.8 and score(0, 1, 3) > 0.8
    assert score(0) < 0.3 and score(1) < 0.3 and score(0, 2, 4) < 0.3 and score(1, 5) < 0.3


def test_scores_by_definition():
    draw = np.random.default_rng(2)
    machine = toxicity.Machine(-0.3, np.array([0, 1, -1, 2]), draw.normal(size=3), draw.normal(size=(3, 4)))
    texts = [[0, 1, 2, 3], [], [2], [1, 3]]
    out = machine.scores(np.concatenate([np.array(t, np.int64) for t in texts]), np.array([len(t) for t in texts]))
    for found, text in zip(out, texts):
        at = [machine.place[t] for t in text if machine.place[t] >= 0]
        raw = -0.3 + sum(machine.linear[i] for i in at)
        raw += sum(machine.pairs[i] @ machine.pairs[j] for k, i in enumerate(at) for j in at[:k])
        assert abs(found - 1 / (1 + np.exp(-raw))) < 1e-9


def test_toxicity_of_the_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op5_toxicity"](spark, sf).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in found)
    clean = [r.predicted for r in found if labels.get(r.doc_id) == 0 and r.held_out]
    assert sum(clean) <= 0.03 * len(clean)
    toxic = [r.predicted for r in found if labels.get(r.doc_id) == 1]
    assert sum(toxic) >= 0.6 * len(toxic)


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows):
    schema = "doc_id bigint, toxic int"
    labels = spark.createDataFrame([(10, 1), (10, 0), (1, 0), (2, 0), (6, 0), (7, 0), (None, 1), (99, 1), (3, None), (4, 0)], schema)
    for given in (labels, labels.limit(0), labels.where("toxic = 0")):
        found = toxicity.toxicity(odd_docs, given).collect()
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd_rows)
        assert all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity(odd_docs.limit(0), labels).count() == 0
    left = toxicity.without_toxic(odd_docs, labels.where("toxic = 0"))
    assert left.columns == odd_docs.columns and left.count() == len(odd_rows)


def filled(draw, *terms):
    """A text of the terms and common words, none of which tells anything."""
    words = [*terms, *(f"filler{draw.integers(60)}" for _ in range(12))]
    return " ".join(draw.permutation(words))


def told(spark, docs, probes, **how):
    """Scores of the probes by a machine from ``docs`` (text, toxic)."""
    ids = [i for i in range(4 * len(docs)) if not held(i)][: len(docs)]
    rows = [(i, text, label) for i, (text, label) in zip(ids, docs)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"), **how)
    asked = spark.createDataFrame(list(enumerate(probes)), "doc_id bigint, text string")
    return [r.score for r in toxicity.scored(asked, machine).orderBy("doc_id").collect()]


def test_learns_terms_that_tell_only_together(spark):
    """Either term alone is as frequent in toxic texts as in clean ones."""
    draw = np.random.default_rng(3)
    kinds = [(("grupo", "zott"), 1), ((), 1), (("grupo",), 0), (("zott",), 0)]
    docs = [(filled(draw, *terms), label) for terms, label in kinds for _ in range(1500)]
    scores = told(spark, docs, [filled(draw, *terms) for terms, _ in kinds for _ in range(10)])
    assert min(scores[:20]) > 0.5 > max(scores[20:])


def test_counts_cover_rows_outside_the_sample(spark):
    """A term with 100 toxic rows among 10,000, of which a sample of 100 is to hold one or two."""
    draw = np.random.default_rng(4)
    docs = [(filled(draw, "zottelig"), 1) for _ in range(1900)] + [(filled(draw, "wummerig"), 1) for _ in range(100)]
    docs += [(filled(draw), 0) for _ in range(8000)]
    scores = told(spark, docs, [filled(draw, "wummerig") for _ in range(20)] + [filled(draw) for _ in range(20)], fit_rows=100)
    assert np.median(scores[:20]) >= toxicity.THRESHOLD > max(scores[20:])


def test_few_toxic_rows_among_many(spark):
    """12 toxic rows among 12,012: a sample of 1,000 at one rate is to hold one of them."""
    draw = np.random.default_rng(5)
    docs = [(filled(draw, "zottelig"), 1) for _ in range(12)] + [(filled(draw), 0) for _ in range(12_000)]
    scores = told(spark, docs, [filled(draw, "zottelig") for _ in range(20)] + [filled(draw) for _ in range(200)], fit_rows=1000)
    assert min(scores[:20]) >= toxicity.THRESHOLD > max(scores[20:])


def test_copies_do_not_thin_a_language(spark):
    """300,000 copies of one text beside 300 others, which are all to be learned from but for the bound."""
    draw = np.random.default_rng(6)
    word = lambda letters: "".join(draw.choice(list(letters), 5))
    texts = {name: [" ".join(word(letters) for _ in range(12)) for _ in range(300)] for name, letters in (("xx", "abcdef"), ("yy", "uvwxyz"))}
    ids = iter(i for i in range(10**6) if not held(i))
    rows = spark.createDataFrame([(next(ids), t, name) for name in texts for t in texts[name]], "doc_id bigint, text string, lang string")
    copies = spark.range(10**6, 14 * 10**5).select(F.col("id").alias("doc_id"), F.lit("uvw uvw").alias("text"), F.lit("yy").alias("lang"))
    _, model = language.learn(rows.unionByName(copies))
    centres = np.stack([m["centre"] for m in model if m["lang"] == "yy"])
    assert len(centres) > 1
    weight = np.ones(language.SIZE, np.float32)
    assert (language.vectors(language.counts(texts["yy"][:50]), weight) @ centres.T).max(1).min() > 0.2
    found = language.languages(rows.unionByName(copies)).join(rows.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in found)


def test_a_language_with_a_small_second_script(spark):
    """Seven texts of a hundred are in another script, which a second language shares with other letters."""
    import random

    draw = random.Random(5)
    alphabets = {"latin": "abcdefghijklm", "second": "абвгдежз", "near": "вгдежзиклмн"}
    text = lambda kind: " ".join("".join(draw.choice(alphabets[kind]) for _ in range(6)) for _ in range(40))
    rows = [(i, "second" if i % 100 < 7 else "latin") for i in range(1200)]
    rows = [(i, "aa", kind, text(kind)) for i, kind in rows] + [(i, "bb", "near", text("near")) for i in range(2000, 2600)]
    docs = spark.createDataFrame([(i, lang, body) for i, lang, _, body in rows], "doc_id bigint, lang string, text string")
    kinds = {i: (lang, kind) for i, lang, kind, _ in rows}
    right, seen = Counter(), Counter()
    for r in language.languages(docs).collect():
        if r.held_out:
            lang, kind = kinds[r.doc_id]
            seen[kind] += 1
            right[kind] += r.lang_pred == lang
    assert seen["second"] >= 15
    assert all(right[kind] >= 0.95 * n for kind, n in seen.items())


def test_far_starts_find_a_small_group_and_pass_over_single_points():
    points = np.zeros((200, 12), np.float32)
    points[:, 0] = 1
    points[:, 1:4] = np.random.default_rng(1).random((200, 3)) / 4
    points[:8] = 0
    points[:8, 5] = 1
    points[8] = 0
    points[8, 9] = 1
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres, sizes = language.cluster(points, 4)
    assert sizes.sum() == 200 and sizes.min() >= 4
    assert (centres @ points[0]).max() > 0.9
