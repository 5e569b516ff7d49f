from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from sqltally.llm import mixing


def reshared(sizes, weights):
    """Targets by resharing the excess round by round."""
    budget, weight = 1.5 * sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    target, full = [0.0] * len(sizes), set()
    while True:
        rest = budget - sum(2 * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weight) if i not in full)
        target = [2.0 * s if i in full else rest * weight[i] / share for i, s in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if i not in full and target[i] >= 2 * sizes[i]}
        if not above:
            return target
        full |= above
        if len(full) == len(sizes):
            return [2.0 * s for s in sizes]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=9))
def test_targets_are_the_end_of_resharing(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame([(n or "-", n, s) for n, s in zip(names, sizes)], "_key string, source string, source_size bigint")
    found = {r["_key"]: r["target"] for r in mixing.targets(rows, (3, 1, 2), (3, 2), 2).collect()}
    for name, value in zip(names, reshared(sizes, (3, 1, 2))):
        assert abs(found[name or "-"] - value) <= 1e-6 * max(1, value)


def test_odd_rows(odd_docs, odd_rows):
    found = mixing.shares(odd_docs).collect()
    size = lambda text: len((text or "").split())
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((r[0], size(r[1])) for r in odd_rows)
    assert all(r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 2 * r["size"] for r in found)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.shares(odd_docs).collect()), key=str)
    assert mixing.shares(odd_docs.limit(0)).count() == 0
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(r.taken for r in found)


def test_sources_come_near_their_targets(spark, sf):
    from sqltally.llm.queries import QUERIES

    sums, targets, sizes = defaultdict(int), {}, defaultdict(int)
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op10_source_mixing"](spark, sf).collect():
        source = docs[r.doc_id]
        sums[source] += r.taken
        targets[source] = r.target
        sizes[source] = max(sizes[source], r["size"])
    assert all(abs(sums[s] - targets[s]) <= sizes[s] for s in sums)
    assert abs(sum(sums.values()) - sum(targets.values())) < 0.1 * sum(targets.values())
