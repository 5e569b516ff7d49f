"""Language identification by nearest centroids of TF-IDF letter n-grams.

A text becomes a vector of hashed letter pairs and triples (blanks stand for all that is not a letter), weighted by root frequency and
inverse document frequency and scaled to length one. Each language has several centroids, found by spherical
k-means in one task per language on a bounded sample (``per_lang`` distinct texts expected, a documented bound); document frequencies
cover all learning rows. A text gets the language of the centroid with the highest cosine. Texts farther from
it than nearly all learned texts of that language are marked as rejected.

Defined cases: a null text or one without letters is ``und`` with score 0 and rejected; a text with letters always gets a learned
language; without learned languages all are ``und``; a null id is not held out and never learns; repeated rows each get their
answer; an empty table gives an empty answer; other columns are ignored, whatever their names. Long texts are
counted in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.llm.words import body, held_out, learns
from sqltally.session import kept, ship_package

TRIPLES, PAIRS = 4096, 512
SIZE = TRIPLES + PAIRS
#: Texts counted at once; letters counted at once.
ROWS, SEGMENT = 256, 1 << 19
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter; a blank for all that is not a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


def _count(out: np.ndarray, texts: list[str], rows: list[int]) -> None:
    """Adds the n-grams of segments to their rows. A segment's first and last characters are context only."""
    points = _letters()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    sizes = np.array([len(t) for t in texts])
    inner = np.ones(len(points), bool)
    ends = sizes.cumsum()
    inner[ends - 1] = inner[ends - sizes] = False
    at = np.flatnonzero(inner & (points != 32))
    row = np.repeat(np.array(rows), sizes)[at]
    a, b, c = points[at - 1], points[at], points[at + 1]
    pair = (b * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77))
    triple = (pair ^ (a * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    pair = pair * np.uint32(0x165667B1)
    for bucket in ((triple >> np.uint32(32 - 12)).astype(np.int64), TRIPLES + (pair >> np.uint32(32 - 9)).astype(np.int64)):
        out += np.bincount(row * SIZE + bucket, minlength=out.size).reshape(out.shape)


def counts(texts: list[str]) -> np.ndarray:
    """N-gram counts, one row per text."""
    out = np.zeros((len(texts), SIZE), np.int64)
    held, rows, size = [], [], 0
    for i, text in enumerate(texts):
        padded = f" {text} "
        for start in range(0, len(text), SEGMENT):
            held.append(padded[start : start + SEGMENT + 2])
            rows.append(i)
            size += len(held[-1])
            if size >= SEGMENT:
                _count(out, held, rows)
                held, rows, size = [], [], 0
    if held:
        _count(out, held, rows)
    return out


def vectors(grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
    found = np.sqrt(grams, dtype=np.float32) * weight
    length = np.sqrt((found * found).sum(1, keepdims=True))
    return found / np.where(length > 0, length, 1)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    column = batch.column("text")
    for start in range(0, len(column), ROWS):
        yield start, column.slice(start, ROWS).to_pylist()


def document_weights(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows of ``text``: one small table of sums per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for _, part in _groups(batch):
                found += (counts(part) > 0).sum(0)
                rows += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SIZE)), pa.array(np.concatenate([[rows], found]))], ["gram", "n"])

    sums = texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(SIZE + 1)
    for r in sums:
        found[r["gram"] + 1] = r["n"]
    return np.log((1 + found[0]) / (1 + found[1:])).astype(np.float32) + np.float32(1)


def cluster(points: np.ndarray, k: int, rounds: int = 12, least: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by spherical k-means, and how many points each has.

    It starts at ``k`` points spread over the cosines with the mean and ``k`` far ones: of the tenth of the points farthest from all
    starts so far, the one nearest to the others of that tenth, so that a small group of its own kind gets a centroid and a
    single odd text does not. Points of centroids with fewer than ``least`` of all points, or one, go to the others.
    """
    if not len(points):
        return np.zeros((0, points.shape[1]), np.float32), np.zeros(0, int)
    order = np.argsort(points @ points.mean(0), kind="stable")
    starts = [int(i) for i in order[np.unique(np.linspace(0, len(points) - 1, min(k, len(points)) + 2)[1:-1].astype(int))]]
    near = (points @ points[starts].T).max(1)
    for _ in range(min(k, len(points) - len(starts))):
        far = np.argsort(near, kind="stable")[: max(1, len(points) // 10)]
        starts.append(int(far[(points[far] @ points[far].sum(0)).argmax()]))
        near = np.maximum(near, points @ points[starts[-1]])

    def settle(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            own = (points @ centres.T).argmax(1)
            for j in range(len(centres)):
                if (own == j).any():
                    centres[j] = points[own == j].mean(0)
            centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        return centres, np.bincount((points @ centres.T).argmax(1), minlength=len(centres))

    centres, sizes = settle(points[starts])
    enough = sizes >= min(sizes.max(), max(2, least * len(points)))
    return (centres, sizes) if enough.all() else settle(centres[enough])


def learn(docs: DataFrame, k: int = 4, per_lang: int = 250, reject: float = 0.005) -> tuple[np.ndarray, list[dict]]:
    """Weights, and per centroid its language, direction and the cosine below which texts are rejected."""
    rows = docs.where(learns(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", body(F.col("text")).alias("text"))
    # Texts are drawn once each, so the chance follows the distinct ones. Hashes go, no text is shuffled.
    marks = rows.select("lang", F.xxhash64("text").alias("mark")).distinct()
    sizes = {r["lang"]: r["n"] for r in marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return np.ones(SIZE, np.float32), []
    weight = document_weights(rows)
    steps = 1 << 30
    chance = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, per_lang / n) * steps)))])
    # One text stands once: copies would pull a centroid to themselves.
    drawn = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(steps)) < chance[F.col("lang")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for start, part in _groups(batch):
                packed = [row.tobytes() for row in vectors(counts(part), weight)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(start, len(part)), pa.array(packed, pa.binary())], ["lang", "vector"]
                )

    def centre(frame: pd.DataFrame) -> pd.DataFrame:
        points = np.stack([np.frombuffer(v, np.float32) for v in sorted(frame["vector"])])
        points = points[np.linalg.norm(points, axis=1) > 0]
        centres, sizes = cluster(points, k)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "n": sizes})

    # Read for the centroids and again to judge them; a task per language holds the sample's vectors, 18 kB each.
    sample = kept(
        rows.where(drawn).dropDuplicates(["lang", "text"]).select("lang", "text").mapInArrow(run, "lang string, vector binary"),
        "language-sample",
    )
    found = sample.groupBy("lang").applyInPandas(centre, "lang string, centre binary, n long").collect()
    model = [{"lang": r["lang"], "centre": np.frombuffer(r["centre"], np.float32), "n": r["n"]} for r in found]
    model.sort(key=lambda m: (m["lang"], m["centre"].tobytes()))
    return weight, _useful(sample, model, reject)


def _useful(sample: DataFrame, model: list[dict], reject: float, small: float = 0.1) -> list[dict]:
    """The centroids that help, and per language the cosine below which texts are rejected.

    A centroid with less than ``small`` of its language's sample may be a second script or topic, or odd texts such as mixtures
    of two languages. It goes if, over the samples of all languages, it turns more right answers into wrong ones than wrong into right.
    """
    if not model:
        return []
    names = sorted({m["lang"] for m in model})
    totals = {n: sum(m["n"] for m in model if m["lang"] == n) for n in names}
    own = np.array([names.index(m["lang"]) for m in model])
    most = {n: max(m["n"] for m in model if m["lang"] == n) for n in names}
    minor = np.array([m["n"] < min(small * totals[m["lang"]], most[m["lang"]]) for m in model])
    centres = np.stack([m["centre"] for m in model]).T

    def trade(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros(len(own), np.int64)
        for batch in frames:
            if not len(batch):
                continue
            near = np.stack([np.frombuffer(v, np.float32) for v in batch.column("vector").to_pylist()]) @ centres
            lang = np.array([names.index(x) if x in names else -1 for x in batch.column("lang").to_pylist()])
            first = near.argmax(1)
            major = np.where(minor, -2, near).argmax(1)
            np.add.at(gain, first, (own[first] == lang).astype(int) - (own[major] == lang).astype(int))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(gain)], ["place", "gain"])

    gains = sample.mapInArrow(trade, "place long, gain long").groupBy("place").agg(F.sum("gain").alias("gain")).collect()
    bad = {r["place"] for r in gains if r["gain"] < 0 and minor[r["place"]]}
    model = [m for i, m in enumerate(model) if i not in bad]
    centres = np.stack([m["centre"] for m in model]).T
    own = np.array([names.index(m["lang"]) for m in model])

    def limit(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["lang"].iloc[0]
        points = np.stack([np.frombuffer(v, np.float32) for v in frame["vector"]])
        points = points[np.linalg.norm(points, axis=1) > 0]
        mine = centres[:, own == names.index(name)] if name in names else centres[:, :0]
        value = float(np.quantile((points @ mine).max(1), reject)) if len(points) and mine.shape[1] else 1.0
        return pd.DataFrame({"lang": [name], "limit": [value]})

    limits = {r["lang"]: r["limit"] for r in sample.groupBy("lang").applyInPandas(limit, "lang string, limit double").collect()}
    return [{"lang": m["lang"], "centre": m["centre"], "limit": limits[m["lang"]]} for m in model]


def languages(docs: DataFrame, **how) -> DataFrame:
    """Per row ``doc_id, held_out, lang_pred, score, rejected``."""
    ship_package(docs.sparkSession)
    weight, model = learn(docs, **how)
    names = sorted({m["lang"] for m in model})
    centres = np.stack([m["centre"] for m in model]).T if model else np.zeros((SIZE, 0), np.float32)
    own = np.array([names.index(m["lang"]) for m in model], int)
    limits = np.array([next(m["limit"] for m in model if m["lang"] == n) for n in names])
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), body(F.col("text")).alias("text"))
    fields = [*slim.drop("text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("rejected", T.BooleanType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in _groups(batch):
                grams = counts(part)
                letters = grams.any(1)
                if names:
                    near = vectors(grams, weight) @ centres
                    by_name = np.stack([near[:, own == i].max(1) for i in range(len(names))], 1)
                    best = by_name.argmax(1)
                    score = np.where(letters, by_name.max(1), 0).clip(0, 1).astype(float)
                    said = [names[i] if ok else UNKNOWN for i, ok in zip(best, letters)]
                    out = (~letters) | (score < limits[best])
                else:
                    score, said, out = np.zeros(len(part)), [UNKNOWN] * len(part), np.ones(len(part), bool)
                ids = [batch.column(n).slice(start, len(part)) for n in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(said, pa.string()), pa.array(score), pa.array(out)], schema.names)

    return slim.mapInArrow(run, schema)
