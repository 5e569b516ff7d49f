"""Objects of JSON arrays of any size, read in splits: no file is one string and none is one task.

The text source cuts a file at every closing brace, wherever its splits lie. Two passes follow, each over one split at a
time with some megabytes, or one object, in memory; they look at the marks of all these fragments at once:

1. how a split changes the nesting, for a start outside a string and for one inside;
2. with the state at its start known from the splits before it, each split hands out its whole objects, and its ends as pieces.

Objects that cross splits are put together from their pieces, then all are numbered by counts per split. Only such figures of
splits are brought into order, never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import totals_before
from ..session import kept, ship_package

QUOTE, OPEN, CLOSE, ARRAY = b'"{}['
STEP = np.zeros(256, np.int8)
STEP[list(b"{[")], STEP[list(b"}]")] = 1, -1
MARK = STEP != 0
MARK[QUOTE] = True
BLANKS = " \t\r\n\ufeff"
#: Characters looked at, and of objects handed over, together; a longer fragment is looked at as a whole.
TOGETHER = 1 << 22

SPLIT = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType())])
CHANGE = T.StructType([
    *SPLIT.fields, T.StructField("quotes", T.LongType()), T.StructField("outer", T.LongType()), T.StructField("inner", T.LongType()),
    T.StructField("opening", T.StringType()),
])
PIECE = T.StructType([
    *SPLIT.fields, T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("sure", T.BooleanType()),
    T.StructField("text", T.StringType()),
])


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes and brackets, these marks, and how many quotes there are up to each; in a JSON text a backslash is always inside a string."""
    if b"\\" in data:
        data = data.replace(b"\\\\", b"__").replace(b'\\"', b"__")
    read = np.frombuffer(data, np.uint8)
    places = np.flatnonzero(MARK[read])
    marks = read[places]
    return places, marks, np.cumsum(marks == QUOTE)


def change(texts: Iterable[str]) -> tuple[int, int, int, str | None]:
    """Number of quotes, change of depth for a start outside and inside a string, and the first character that is not blank.

    A text is one fragment, or some that follow each other with the braces between them.
    """
    quotes, depth, opening = 0, [0, 0], None
    for text in texts:
        if opening is None:
            opening = text.lstrip(BLANKS + "}")[:1] or None
        _, marks, count = _marks(text.encode() + b"}")
        steps, odd = STEP[marks], (count + quotes) % 2 == 1
        inner = int(steps[odd].sum())
        depth = [depth[0] + int(steps.sum()) - inner, depth[1] + inner]
        quotes += int(count[-1])
    return quotes, depth[0], depth[1], opening


@dataclass
class Splitter:
    """Whole objects of one split, from its state at the start.

    ``depth`` at which the wanted objects lie is ``base``: 1 in a file that is an array, 2 in one that holds it under ``key``. There
    ``active`` is None as long as nothing tells whether the split began inside the wanted array.
    """

    inside: bool
    depth: int
    key: str | None = None
    active: bool | None = True
    held: list[str] | None = None
    began_before: bool = False
    through: bool = False
    unsure: int = 0
    sure: int = 0
    found: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.base = 1 if self.key is None else 2
        if self.depth > self.base and self.active is not False:
            self.held, self.began_before = [], True
        self.through = self.began_before

    def feed(self, text: str) -> None:
        """Go on with a fragment, or some that follow each other with the braces between them; a brace ends the last one, too."""
        data = text.encode() + b"}"
        places, marks, count = _marks(data)
        outside = np.flatnonzero((marks != QUOTE) & ((count + self.inside) % 2 == 0))
        own = marks[outside]
        step = STEP[own]
        after = self.depth + np.cumsum(step, dtype=np.int64)
        active = self._active(data, places, marks, count, outside, own, after)
        # An object ends where a brace comes back to its depth; what the split began in may also be an array in the wanted one.
        ends = np.flatnonzero((own == CLOSE) & (after == self.base))
        begins = np.flatnonzero((own == OPEN) & (after == self.base + 1) & (active != 0))
        if self.held is not None:
            back = np.flatnonzero(after == self.base)[:1] if self.began_before else ends[:1]
            if not len(back):
                self.held.append(data.decode())
                begins = begins[:0]
            else:
                if own[back[0]] == CLOSE:
                    end = int(places[outside[back[0]]]) + 1
                    kind = "head" if self.began_before else "whole"
                    self._found(kind, ["".join([*self.held, data[:end].decode()])], active[back])
                self.held, self.began_before, self.through = None, False, False
                begins = begins[begins > back[0]]
        if len(begins):
            closing = np.searchsorted(ends, begins)
            _, first = np.unique(closing, return_index=True)
            begins, closing = begins[first], closing[first]
            whole = int(np.searchsorted(closing, len(ends)))
            starts = places[outside[begins]]
            stops = places[outside[ends[closing[:whole]]]] + 1
            self._found("whole", [data[a:b].decode() for a, b in zip(starts[:whole].tolist(), stops.tolist())], active[begins[:whole]])
            if whole < len(begins):
                self.held = [data[starts[whole] :].decode()]
        self.inside = bool((self.inside + int(count[-1])) % 2)
        if len(outside):
            self.depth = int(after[-1])
            self.active = None if active[-1] < 0 else bool(active[-1])

    def _active(self, data, places, marks, count, outside, own, after) -> np.ndarray:
        """``active`` from each bracket outside strings on: 1, 0, and -1 where nothing tells."""
        now = -1 if self.active is None else int(self.active)
        if self.key is None:
            return np.full(len(own), now)
        told = np.where((STEP[own] < 0) & (after <= 1), 0, -1)
        name, quotes = self.key.encode(), places[marks == QUOTE]
        for i in np.flatnonzero((own == ARRAY) & (after == 2)):
            at, seen = outside[i], int(count[outside[i]])
            # The name of an array is the string right before it.
            if seen > 1 and marks[at - 1] == QUOTE and data[quotes[seen - 2] + 1 : quotes[seen - 1]] == name:
                told[i] = 1
        last = np.maximum.accumulate(np.where(told >= 0, np.arange(len(told)), -1))
        return np.where(last >= 0, told[last], now)

    def _found(self, kind: str, texts: list[str], active: np.ndarray) -> None:
        seq = self.sure + self.unsure
        known = (active >= 0).tolist()
        self.found += [(kind, seq + n, k, text) for n, (k, text) in enumerate(zip(known, texts))]
        self.sure, self.unsure = self.sure + sum(known), self.unsure + len(known) - sum(known)

    def rest(self) -> list[tuple]:
        """What is left at the end of the split, and its figures."""
        out = self.found
        if self.held is not None:
            out.append(("middle" if self.began_before else "tail", 0, self.active is not None, "".join(self.held)))
        told = None if self.active is None else str(self.active).lower()
        # A split that lies in one object or array as a whole is passed through by the pieces before it.
        return [*out, ("split", self.sure, not self.through, told), ("unsure", self.unsure, True, None)]


def _texts(batches: Iterable[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[tuple, str]]:
    """Fragments of one split that follow each other, joined by the braces between them, some megabytes together."""
    for batch in batches:
        rows, value = batch.num_rows, batch.column("value")
        if not rows:
            continue
        keys = [batch.column(c) for c in ("file", "start", *extra)]
        size = np.cumsum(pc.binary_length(value).to_numpy(), dtype=np.int64) // TOGETHER
        cut = size[1:] != size[:-1]
        for key in keys[:2]:
            cut |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), rows]
        for a, b in zip(edges, edges[1:]):
            listed = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), value.slice(a, b - a))
            yield tuple(key[a].as_py() for key in keys), pc.binary_join(listed, pa.scalar("}", value.type))[0].as_py()


def _by_split(batches: Iterable[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The texts of each split in their order; a task reads its splits one after the other."""
    for split, texts in groupby(_texts(batches, extra), itemgetter(0)):
        yield split, (text for _, text in texts)


def fragments(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, start`` (of the split) and ``value``, the text up to each closing brace."""
    read = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(list(paths))
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _changes(read: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(*split, *change(values)) for split, values in _by_split(batches, [])]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*found)) or [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.name for f in CHANGE.fields])

    return read.mapInArrow(run, CHANGE)


def _starts(changes: DataFrame) -> DataFrame:
    """``file, start, inside, depth, wrapped`` at the start of each split; raises on files whose nesting does not end."""
    order = Window.partitionBy("file").orderBy("start")
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    placed = changes.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    own = F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner"))
    placed = placed.withColumns({
        "depth": F.coalesce(F.sum(own).over(before), F.lit(0)), "last": F.sum(own).over(all_of),
        "opening": F.first("opening", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    # The last fragment ends with the file, not with a brace; a file that is one object may end with its own.
    fine = (F.col("last") == -1) | ((F.col("last") == 0) & (F.col("opening") == "{"))
    told = kept(placed.select("file", "start", "inside", "depth", (F.col("opening") == "{").alias("wrapped"), fine.alias("fine")), "json-starts")
    torn = told.where("NOT fine").select("file").first()
    if torn is not None:
        raise ValueError(f"not a whole JSON document: {torn['file']}")
    return told.drop("fine")


def _pieces(read: DataFrame, key: str | None) -> DataFrame:
    names = [f.name for f in PIECE.fields]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, weight = [], 0
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        for (file, start, inside, depth, wrapped), values in _by_split(batches, ["inside", "depth", "wrapped"]):
            active = True if not wrapped else False if key is None or depth < 2 else None
            state = Splitter(bool(inside), depth, key if wrapped else None, active)
            for value in values:
                state.feed(value)
                weight += len(value)
                if weight > TOGETHER:
                    out += [(file, start, *f) for f in state.found]
                    state.found = []
                    if out:
                        yield table()
                    out, weight = [], 0
            out += [(file, start, *f) for f in state.rest()]
        if out:
            yield table()

    return read.mapInArrow(run, PIECE)


def read_objects(spark: SparkSession, paths: Sequence[str], key: str | None = None) -> DataFrame:
    """``idx, part, text``: the objects of JSON arrays with a dense number in the order of ``paths``, file names and places.

    A path is a file or a folder of files; ``part`` is its place in ``paths``. A file is an array, or an object with the array under
    ``key`` at its top level (without a ``key``, such a file has no objects). Items of the array that are no objects are passed over.
    Raises ``ValueError`` if a file ends inside its array or one of its items.
    """
    ship_package(spark)
    read = None
    for part, path in enumerate(paths):
        found = fragments(spark, [path])
        starts = _starts(kept(_changes(found), "json-changes"))
        # One row per split of the input, so far smaller than what is read; a merge would lose the order of the fragments.
        known = found.join(F.broadcast(starts), ["file", "start"])
        pieces = kept(_pieces(known.select("file", "start", "inside", "depth", "wrapped", "value"), key), "json-pieces")
        whole = pieces.withColumn("part", F.lit(part))
        read = whole if read is None else read.unionByName(whole)
    at = ["part", "file", "start"]
    splits = read.where("kind IN ('split', 'unsure')").groupBy(*at).agg(
        F.max(F.when(F.col("kind") == "split", F.col("text"))).alias("told"),
        F.sum(F.when(F.col("kind") == "split", F.col("seq"))).alias("sure"),
        F.bool_or(F.when(F.col("kind") == "split", F.col("sure"))).alias("stops"),
        F.sum(F.when(F.col("kind") == "unsure", F.col("seq"))).alias("unsure"),
    )
    order = Window.partitionBy("part", "file").orderBy("start")
    active = F.coalesce(F.last("told", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit("false")) == "true"
    closes = F.when(F.col("stops"), F.col("start"))
    splits = splits.withColumns({
        "active": active,
        "next": F.min(closes).over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    counted = splits.withColumns({
        "n": F.col("sure") + F.when(F.col("active"), F.col("unsure")).otherwise(0),
        "skip": F.when(F.col("active"), 0).otherwise(F.col("unsure")),
    })
    placed = totals_before(counted, at, "n", "offset")
    cut = read.where("kind IN ('head', 'middle', 'tail')").join(placed.select(*at, "next"), at)
    last = F.when(F.col("kind") == "head", F.col("start")).otherwise(F.col("next"))
    joined = cut.withColumn("last", last).where("last IS NOT NULL").groupBy("part", "file", F.col("last").alias("start")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("start").alias("from"), "text"))), lambda p: p["text"]), "").alias("text"),
        F.bool_or(F.when(F.col("kind") == "head", F.col("sure"))).alias("certain"),
        F.max(F.when(F.col("kind") == "head", F.col("seq"))).alias("seq"),
    ).where("seq IS NOT NULL")
    objects = read.where("kind = 'whole'").select(*at, "seq", F.col("sure").alias("certain"), "text").unionByName(
        joined.select(*at, "seq", "certain", "text")
    )
    numbered = objects.join(placed.select(*at, "active", "skip", "offset"), at).where("certain OR active")
    return numbered.select((F.col("offset") + F.col("seq") - F.col("skip")).alias("idx"), "part", "text")
