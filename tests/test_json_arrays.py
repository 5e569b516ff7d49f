"""Objects of JSON arrays against the standard parser, however the files are cut into splits."""

import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqltally.sources import json_arrays, splits

NASTY = ["", "}", "{", '"', "\\", '\\"', "]},{[", '"}', "é😀\n", "predictions", '"predictions": [', "a\\\\", "[{"]


def value(draw, depth=3):
    kind = draw.randrange(6 if depth else 4)
    if kind == 4:
        return {draw.choice(NASTY) + str(k): value(draw, depth - 1) for k in range(draw.randrange(3))}
    if kind == 5:
        return [value(draw, depth - 1) for _ in range(draw.randrange(3))]
    return [draw.choice(NASTY), draw.randrange(99), None, True][kind]


def item(draw):
    return {draw.choice(NASTY) + str(k): value(draw) for k in range(draw.randrange(4))}


@pytest.fixture
def cut(spark):
    """Sets the size of splits, far below that of an object."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield to
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize(("size", "seed"), [(31, 1), (300, 3), (1 << 20, 4)])
def test_any_split(spark, cut, tmp_path, size, seed):
    cut(size)
    draw, wanted = random.Random(seed), []
    for n in range(4):
        rows = [item(draw) for _ in range(draw.randrange(8))]
        mixed = list(rows)
        for _ in range(n):
            mixed.insert(draw.randrange(len(mixed) + 1), draw.choice([None, 3, "x{", ["y", {"z": 1}], "]"]))
        text = json.dumps(mixed, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5)
        (tmp_path / f"part{n}.json").write_text(draw.choice(["", "\n ", "﻿"]) + text + draw.choice(["", "\n"]))
        wanted += rows
    found = json_arrays.read_objects(spark, [str(tmp_path)]).orderBy("idx").collect()
    assert [r.idx for r in found] == list(range(len(wanted)))
    assert [json.loads(r.text) for r in found] == wanted


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_arrays_inside_objects(spark, cut, tmp_path, size):
    cut(size)
    draw, wanted = random.Random(size), []
    for n in range(4):
        rows = [item(draw) for _ in range(5)]
        whole = {"model": 'a}b"', "by": {"easy": {"n": 1, "list": [{"no": 1}]}, "hard": {}}, "other": [{"no": 2}, {"predictions": [{"no": 3}]}]}
        late = {"later": [{"no": 4}, {"no": 5}], "last": {"predictions": [{"no": 6}]}}
        made = rows if n == 2 else {**whole, "predictions": rows, **late} if n else {"predictions": rows}
        (tmp_path / f"p{n}.json").write_text(json.dumps(made, indent=n % 2 or None))
        wanted += rows
    found = json_arrays.read_objects(spark, [str(tmp_path)], "predictions").orderBy("idx").collect()
    assert [json.loads(r.text) for r in found] == wanted
    assert [r.idx for r in found] == list(range(len(wanted)))
    # Without a key, only files that are arrays have objects.
    assert json_arrays.read_objects(spark, [str(tmp_path)]).count() == 5


@settings(max_examples=1500, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30))
def test_splits_agree_on_their_state(seed, step):
    """Without Spark: the parts of a text, cut at any braces, hand out its objects."""
    draw = random.Random(seed)
    rows = [item(draw) for _ in range(draw.randrange(5))]
    mixed = list(rows)
    for _ in range(draw.randrange(4)):
        mixed.insert(draw.randrange(len(mixed) + 1), draw.choice([None, 3, "x{", "}", ["y", {"z": {}}, [{}]], "]"]))
    pieces = json.dumps(mixed, indent=draw.choice([None, 2])).split("}")
    groups = [pieces[i : i + step] for i in range(0, len(pieces), step)]
    quotes, depth, texts, held = 0, 0, [], ""
    for group in groups:
        state = json_arrays.Splitter(bool(quotes % 2), depth)
        for fragment in group:
            state.feed(fragment)
        left = state.rest()
        if left[-2][2] and left[0][0] != "head":
            held = ""
        for kind, _, _, text in left:
            if kind in ("tail", "middle"):
                held += text
            elif kind in ("head", "whole"):
                texts.append(held + text)
                held = ""
        more, outer, inner, _ = json_arrays.change(group)
        depth += (outer, inner)[quotes % 2]
        quotes += more
        assert state.inside == bool(quotes % 2) and state.depth == depth
    assert [json.loads(t) for t in texts] == rows


def test_fragments_are_looked_at_together():
    """Without Spark: fragments of a split come joined, not one by one, and give what they give one by one."""
    rows = [{"n": n, NASTY[n % len(NASTY)]: [NASTY[n % 5], {"x": n}]} for n in range(3_000)]
    for made, key in ((rows, None), ({"by": {"a}": [{}]}, "predictions": rows, "late": [{"no": 1}]}, "predictions")):
        pieces = json.dumps(made).split("}")
        table = {"file": ["a"] * len(pieces) + ["b"], "start": [0] * len(pieces) + [0], "value": [*pieces, "[]"]}
        told = [(split, list(texts)) for split, texts in json_arrays._by_split(pa.table(table).to_batches(), [])]
        assert told == [(("a", 0), ["}".join(pieces)]), (("b", 0), ["[]"])]
        assert json_arrays.change(told[0][1]) == json_arrays.change(pieces)
        one, many = (json_arrays.Splitter(False, 0, key, key is None) for _ in range(2))
        one.feed(told[0][1][0])
        for piece in pieces:
            many.feed(piece)
        assert (left := one.rest()) == many.rest()
        assert [json.loads(text) for kind, *_, text in left if kind == "whole"] == rows


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1}, {"b": 2', '[{"a": "x}]', '{"predictions": [{"a": 1}', "["])
def test_torn_files_are_told(spark, tmp_path, text):
    (tmp_path / "torn.json").write_text(text)
    with pytest.raises(ValueError, match="torn.json"):
        json_arrays.read_objects(spark, [str(tmp_path / "torn.json")], "predictions")


@pytest.mark.parametrize("text", ["", " \n", "[]", "[ ]\n", "[1, 2]", "{}", '{"predictions": []}', '{"predictions": null}'])
def test_no_objects(spark, tmp_path, text):
    (tmp_path / "none.json").write_text(text)
    assert json_arrays.read_objects(spark, [str(tmp_path / "none.json")], "predictions").count() == 0


def test_one_file_is_many_tasks(spark, cut, tmp_path):
    """A file of some megabytes, in splits of a tenth of it; rows as the standard parser has them."""
    rows = [{"db_id": f"d{n % 7}", "question": f"q{n} " + NASTY[n % len(NASTY)] * 3, "query": f"SELECT {n}", "sql": {"where": [[n, "}"]]}} for n in range(5_000)]
    (tmp_path / "dev.json").write_text(json.dumps(rows))
    cut((tmp_path / "dev.json").stat().st_size // 10)
    assert json_arrays.fragments(spark, [str(tmp_path / "dev.json")]).rdd.getNumPartitions() >= 10
    found = splits.read_split(spark, "dev", str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.db_id, r.question, r.gold_sql) for r in found] == [(n, r["db_id"], r["question"], r["query"]) for n, r in enumerate(rows)]
    assert [json.loads(r.sql) for r in found[:50]] == [r["sql"] for r in rows[:50]]
