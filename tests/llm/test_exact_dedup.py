import hashlib
from collections import Counter

from pyspark.sql import functions as F

from sqltally.llm import exact_dedup


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return Counter(out)


def test_odd_rows(odd_docs, odd_rows):
    assert Counter(tuple(r) for r in exact_dedup.content_groups(odd_docs).collect()) == expected(odd_rows)
    assert exact_dedup.content_groups(odd_docs.limit(0)).count() == 0


def test_colliding_hashes_are_told_apart_by_the_texts(odd_docs, odd_rows):
    few = lambda text: F.substring(F.unhex(F.md5(text)), 1, 0)
    assert Counter(tuple(r) for r in exact_dedup.content_groups(odd_docs, mark_of=few).collect()) == expected(odd_rows)


def test_one_document_of_a_group_stays(odd_docs, odd_rows):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert sorted(r[1] or "" for r in rows) == sorted({r[1] or "" for r in odd_rows})
    assert all(r in odd_rows for r in rows)
    assert {r[0] for r in rows} == {2, 4, 5, 6, 7, 8, 9, 10}
