"""The trie against one built by hand, whatever the sketch proves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sqltally.llm import prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string, owner bigint"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """Per conversation its turns in order."""
    digest = lambda r, t: hashlib.sha256(f"{len(r or '')}:{r or ''}{t or ''}".encode()).digest()
    out = {}
    for conv, turn, role, text in sorted(
        (r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r[2], r[3]))
    ):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def by_hand(said):
    members = {}
    for conv, turns in said.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ids = ",".join(str(c) for c in sorted(c for c in convs if len(said[c]) == len(p)))
        out.append((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children[p]),
            sum(not children[q] for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
            hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[0], r[1]))


def listed(made):
    assert sorted(made.columns) == sorted(FIELDS)
    return sorted((tuple(r[c] for c in FIELDS) for r in made.collect()), key=lambda r: (r[0], r[1]))


def drawn(seed, n=120):
    """Conversations over few turns, many alike, some long and most with tails of their own."""
    draw, rows = random.Random(seed), []
    for conv in draw.sample(range(-50, 5_000), n):
        turns = [(draw.choice(["user", "assistant"]), draw.choice(["", "hi", "héé"])) for _ in range(draw.randint(1, 4))]
        if draw.random() < 0.5:
            turns += [("user", f"{conv} {k}") for k in range(draw.randint(1, 5))]
        rows += [(conv, k * 3 - 4, *t) for k, t in enumerate(turns)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "widest"), [(1, 27), (2, 3), (3, 6)])
def test_any_sketch_gives_the_same_trie(spark, seed, widest):
    rows = drawn(seed)
    given = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], TURNS).repartition(5)
    assert listed(prefix_trie.conversation_trie(given, widest)) == by_hand(sequences(rows))


def test_the_sketch_never_proves_a_shared_prefix(spark):
    rows = drawn(4)
    given = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], TURNS)
    prefixes = prefix_trie.prefixes(prefix_trie.whole(prefix_trie.turn_rows(given))[0])
    for widest in (4, 8, 27):
        found = prefix_trie.screened(prefixes, widest).collect()
        members = {}
        for r in found:
            members.setdefault((r.k1, r.k2), set()).add(r.conv_id)
        assert all(len(members[r.k1, r.k2]) == 1 for r in found if r.single)
        assert all(len(members[r.u1, r.u2]) == 1 for r in found if r.parent_single)
    assert sum(r.single for r in found) >= 0.8 * sum(len(m) == 1 for m in members.values())


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = [(c, 0, "user", "same") for c in range(-9, 40)] + [(c, 0, "user", "own") for c in (100, 300)] + [(50, 0, "user", "lone")]
    given = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], TURNS)
    assert listed(prefix_trie.conversation_trie(given)) == by_hand(sequences(rows))


def test_odd_rows(spark):
    long = "x" * 300_000
    rows = [
        (None, 1, "user", "lost"), (1, None, "user", None), (1, 2, None, "a"), (1, 2, None, "a"), (2, None, "user", ""), (2, 2, "", "a"),
        (3, 5, "u", "ser"), (4, 5, "us", "er"), (5, 1, "user", long), (6, 1, "user", long), (6, 2, "user", "b"), (7, 1, "a", "1"), (7, 1, "b", "2"),
        (8, 9, "b", "2"), (8, 9, "a", "1"),
    ]
    given = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], TURNS)
    assert listed(prefix_trie.conversation_trie(given)) == by_hand(sequences(rows))
    assert prefix_trie.conversation_trie(given.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(given.where("conv_id IS NULL")).count() == 0


@pytest.mark.parametrize("head", [0, 2, 9])
def test_splicing(spark, head):
    rows = drawn(7, 60) + [(3_000, k, "user", f"h{k}") for k in range(4)] + [(4_000, 0, "user", "short")]
    given = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], TURNS)
    conv_id = F.col("conv_id")
    source = conv_id - conv_id % 1000
    made = prefix_trie.trie(*prefix_trie.spliced(prefix_trie.turn_rows(given), source, F.lit(head)))
    said = sequences(rows)
    rebuilt = {c: said.get(c - (abs(c) % 1000) * (1 if c > 0 else -1), [])[:head] + t[head:] for c, t in said.items()}
    assert any(not t for t in rebuilt.values()) or head == 0
    assert listed(made) == by_hand(rebuilt)
