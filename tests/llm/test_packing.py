import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sqltally.llm import bin_plans, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins_of(counts, capacity, bins):
    """Checks that every item has one place, and counts the bins."""
    places = defaultdict(list)
    for b in bins:
        assert b.n > 0
        assert b.room == capacity - sum(length * per for length, per, _ in b.slots) >= 0
        for length, per, first in b.slots:
            places[length].append((first, first + per * b.n))
    for length, n in counts.items():
        at = 0
        for first, end in sorted(places.pop(length)):
            assert first == at
            at = end
        assert at == n
    assert not places
    return sum(b.n for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=40), st.integers(1, 12))
def test_plan_places_every_item_once(counts, groups):
    made = bins_of(counts, 64, bin_plans.plan(counts, 64, groups))
    assert made >= -(-sum(k * n for k, n in counts.items()) // 64)


@pytest.mark.parametrize(
    ("counts", "fewest"), [({}, 0), ({64: 7}, 7), ({33: 5}, 5), ({32: 6}, 3), ({40: 10, 24: 10}, 10), ({22: 9, 20: 9}, 6), ({1: 65}, 2)]
)
def test_plan_is_best_where_the_best_is_known(counts, fewest):
    assert bins_of(counts, 64, bin_plans.plan(counts, 64)) == fewest


def test_plan_comes_near_the_volume():
    draw = np.random.default_rng(5)
    counts = dict(Counter(int(x) for x in np.minimum(2047, draw.lognormal(6.2, 1.1, 30_000) + 1)))
    made = bins_of(counts, 2048, bin_plans.plan(counts, 2048))
    assert made <= 1.005 * sum(k * n for k, n in counts.items()) / 2048


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("aZ é'stK½1Σ. \n\t\x0b\x1f́|<>", max_size=60))
def test_tokens(text):
    plain = Tokenizer.from_file(PATH)
    expected = plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.word_tokenizer(PATH).encode(text), "<u4").tolist() == expected


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    own, plain = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for text in ["One two, three four five", "two six <|endoftext|>", "one 12 two's", ""]:
        expected = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text("aZ é'1. \n\t<|>", max_size=30) | st.just("x <|endoftext|> y"), max_size=8))
def test_tokens_of_many_texts(texts):
    plain = Tokenizer.from_file(PATH)
    ids, bounds = packing.word_tokenizer(PATH).encode_all(pa.array(texts, pa.string()), np.array([0], "<u4").tobytes())
    found = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert found == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_long_texts(spark, monkeypatch):
    """One word of a megabyte, one text of a million words, and texts that are not encoded together."""
    monkeypatch.setattr(packing, "TOGETHER", 1 << 10)
    rows = [(1, "ab" * 500_000), (2, " ".join(f"w{i % 5000}" for i in range(1_000_000))), (3, "one two"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    check_packed(rows, packing.pack(docs, PATH).collect(), 2048)


def check_packed(docs, rows, capacity):
    """Every document's ids come back from its pieces, and sequences are filled without gaps or overlaps."""
    plain = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc_id, text in docs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[(doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_odd_rows(spark):
    rows = [(1, "a b c " * 30, "x"), (1, "a b c " * 30, "x"), (None, "one", None), (2, None, "y"), (3, "", "y"), (4, "<|endoftext|> it's", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string")
    found = packing.pack(docs, PATH, capacity=16, with_ids=True)
    check_packed([r[:2] for r in rows], found.collect(), 16)
    made = packing.sequences(found).collect()
    assert sum(len(r.ids) for r in made) == sum(r.length for r in found.collect())
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_whole_table(spark, sf):
    from sqltally.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    made = check_packed(docs, rows, 2048)
    assert made <= 1 + 1.03 * sum(r.length for r in rows) / 2048
