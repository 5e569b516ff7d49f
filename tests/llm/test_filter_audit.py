"""The audit against removal by hand in every order, and its potentials against their definition."""

import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest

from sqltally.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int, part string"


def fails(docs):
    """Per row the letters of the filters that it fails."""
    least = {}
    for i, text in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A"} if len(words) < 100 else set()
        bad |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        bad |= {"D"} if re.search("[#$%&*|]", text) else set()
        bad |= {"E"} if i is not None and i > least.get(text, i) else set()
        out.append(bad)
    return out


def by_hand(rows, names="ABCDE"):
    """``rows``: part, failed letters, good, toxic. Every order is applied to the rows themselves."""
    out, shares = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations(names):
            left = own
            for step, name in enumerate(order, 1):
                removed = [r for r in left if name in r[1]]
                failing = [r for r in own if name in r[1]]
                left = [r for r in left if name not in r[1]]
                shares[part, name] += len(removed)
                out[part, "".join(order), step] = (
                    len(left), len(removed), len(failing) - len(removed), sum(len(r[1]) == 1 for r in failing),
                    sum(r[2] for r in removed), sum(r[3] for r in removed),
                )
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(audited):
    found = [tuple(r) for r in audited.collect()]
    assert len({r[:3] for r in found}) == len(found)
    return {r[:3]: r[3:] for r in found}


def test_odd_rows(spark, odd_rows, odd_docs):
    labels = [(1, 1, 0, "x"), (1, 0, 1, "x"), (2, 1, None, None), (None, 1, 1, None), (10, None, 1, "y"), (99, 1, 1, "y")]
    masked = filter_audit.failures(odd_docs)
    found = as_dict(filter_audit.audit(masked, spark.createDataFrame(labels, LABELS), filter_audit.NAMES))
    good, toxic = {1, 2}, {1, 10}
    bad = fails([r[:2] for r in odd_rows])
    rows = [(r[2] or "", b, r[0] in good, r[0] in toxic) for r, b in zip(odd_rows, bad)]
    assert {r[0] for r in rows} == {"", "de", "en"} and any("E" in r[1] for r in rows)
    assert found == by_hand(rows)


def test_each_filter_at_its_bound(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [
        " ".join(words[:100]), " ".join(words[:99]), "", None, " ".join(words[:80] + words[:20]), " ".join(words[:79] + words[:21]),
        "A" + "a" * 9, "AA" + "a" * 8, "É" * 10, "#", "~^", " ".join(words[:100]),
    ]
    docs = list(enumerate(texts))
    found = filter_audit.failures(spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id bigint, text string, lang string"))
    made = {r.doc_id: {n for k, n in enumerate("ABCDE") if r["mask"] >> k & 1} for r in found.collect()}
    assert made == dict(zip([i for i, _ in docs], fails(docs)))
    assert made[0] == set() and made[4] == set() and made[5] == {"B"} and made[11] == {"E"} and made[3] == {"A", "E"}


@pytest.mark.parametrize("n", [1, 3, 4])
def test_any_number_of_filters(spark, n):
    masks = [(("p", "q")[i % 2], i * 7 % (1 << n), i) for i in range(50)]
    masked = spark.createDataFrame([(d, p, m) for p, m, d in masks], "doc_id bigint, part string, mask int")
    names = "WXYZ"[:n]
    found = as_dict(filter_audit.audit(masked, spark.createDataFrame([], LABELS), names))
    rows = [(p, {c for k, c in enumerate(names) if m >> k & 1}, False, False) for p, m, _ in masks]
    assert found == by_hand(rows, names)


def test_potentials_share_the_whole(spark):
    masked = spark.createDataFrame([(i, "p", i * i % 32) for i in range(400)], "doc_id bigint, part string, mask int")
    counts = filter_audit.histogram(masked, spark.createDataFrame([], LABELS))
    row = filter_audit.potentials(filter_audit.games(counts, 5), 5).first()
    p, whole = row.potential, factorial(5)
    for s in range(1, 32):
        shares = [p[s] - p[s ^ 1 << k] for k in range(5) if s >> k & 1]
        assert sum(shares) == whole * row.n[s]
        for a in range(5):
            for b in range(5):
                if a != b and s >> a & 1 and s >> b & 1:
                    assert (p[s] - p[s ^ 1 << a]) - (p[s ^ 1 << b] - p[s ^ 1 << a ^ 1 << b]) == (p[s] - p[s ^ 1 << b]) - (
                        p[s ^ 1 << a] - p[s ^ 1 << a ^ 1 << b])


def test_empty_table(spark, odd_docs):
    masked = filter_audit.failures(odd_docs.limit(0))
    assert filter_audit.audit(masked, spark.createDataFrame([], LABELS), "ABCDE").count() == 0
