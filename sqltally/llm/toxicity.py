"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and, for longer words, their first letters; they are hashed on the JVM side.
Counts of every term cover all labelled learning rows: ids meet hashed terms, no text is shuffled. The machine knows every term
of ``SEEN`` rows; toxic ones start at a lower bound of their odds. It is fitted by stochastic gradients on a bounded sample, drawn for each label on its own, so that few toxic rows among
very many are all learned from; the bias is put back to the labels' shares. Equal texts count once in learning, so copies of one document do not make its chance words look toxic.
Scores are the logistic of the machine's output.

Defined cases: a null text is empty; a text without known terms scores the model's bias; a null id is not held out and
never learns; of several labels of an id the highest counts, null labels and labels of unknown ids are ignored; without
labels of both kinds, or terms of ``SEEN`` rows, nothing is learned and every score is 0; repeated rows each get their answer; an empty table gives an empty answer; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.llm.words import body, held_out, learns
from sqltally.session import kept, ship_package

#: Hashed terms; letters of a word's beginning.
BUCKETS, HEAD = 1 << 18, 4
#: Learning rows that hold a term the machine uses; deviations from which on a term alone tells the labels apart;
#: rows from which on any other term is learned at full pace.
SEEN, SURE, OFTEN = 3, 2.5, 1000
FACTORS, EPOCHS, BATCH = 8, 12, 128
THRESHOLD = 0.3


def terms(text: Column) -> Column:
    """Distinct hashed terms of a text."""
    found = F.array_distinct(F.split(F.lower(body(text)), r"[^\p{L}\p{N}]+"))
    bucket = lambda kind, w: F.pmod(F.xxhash64(F.lit(kind), w), F.lit(BUCKETS)).cast("int")
    whole = F.transform(F.filter(found, lambda w: w != ""), lambda w: bucket(0, w))
    longer = F.filter(found, lambda w: F.length(w) > HEAD + 1)
    heads = F.transform(F.array_distinct(F.transform(longer, lambda w: F.substring(w, 1, HEAD))), lambda w: bucket(1, w))
    return F.array_distinct(F.concat(whole, heads))


@dataclass
class Machine:
    """``place`` maps a bucket to its row in ``linear`` and ``pairs``, -1 for buckets without one."""

    bias: float
    place: np.ndarray
    linear: np.ndarray
    pairs: np.ndarray

    def scores(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of texts whose terms stand one text after the other."""
        at = self.place[buckets]
        row = np.repeat(np.arange(len(counts)), counts)[at >= 0]
        at, n = at[at >= 0], len(counts)
        out = self.bias + np.bincount(row, self.linear[at], n)
        for factor in self.pairs.T:
            own = factor[at]
            out += 0.5 * (np.bincount(row, own, n) ** 2 - np.bincount(row, own * own, n))
        return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -30, 30))))


def fit(
    rows: list[np.ndarray], labels: np.ndarray, size: int, seed: int = 7, start: np.ndarray | None = None, pace: np.ndarray | None = None
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, linear weights (from ``start``) and interaction factors for rows of term places, by AdaGrad on the logistic loss.

    ``pace`` scales a term's steps.
    """
    pace = np.ones(size) if pace is None else pace
    draw = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias, linear, pairs = float(np.log(share / (1 - share))), np.zeros(size) if start is None else start.copy(), draw.normal(0, 0.02, (size, FACTORS)) * pace[:, None]
    seen_bias, seen_linear, seen_pairs = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for epoch in range(EPOCHS):
        order = draw.permutation(len(rows))
        rate = 0.15 / (1 + 0.2 * epoch)
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            used, inside = np.unique(np.concatenate([rows[i] for i in batch]), return_inverse=True)
            x = np.zeros((len(batch), len(used)))
            x[np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch]), inside] = 1
            w, v = linear[used], pairs[used]
            sums = x @ v
            out = bias + x @ w + 0.5 * ((sums**2).sum(1) - (x @ (v * v)).sum(1))
            off = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[batch]) / len(batch)
            back = x.T @ off
            to_linear = back + 1e-4 * w
            to_pairs = x.T @ (off[:, None] * sums) - back[:, None] * v + 1e-4 * v
            seen_bias += off.sum() ** 2
            seen_linear[used] += to_linear**2
            seen_pairs[used] += to_pairs**2
            bias -= rate * off.sum() / np.sqrt(seen_bias)
            linear[used] -= pace[used] * rate * to_linear / np.sqrt(seen_linear[used])
            pairs[used] -= 0.3 * pace[used][:, None] * rate * to_pairs / np.sqrt(seen_pairs[used])
    return bias, linear, pairs


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 30_000) -> Machine:
    """The machine from the rows of ``labels`` that may be learned from; ``fit_rows`` / 2 rows expected of each label at most."""
    ship_package(docs.sparkSession)
    empty = Machine(-np.inf, np.full(BUCKETS, -1, np.int32), np.zeros(1), np.zeros((1, FACTORS)))
    usable = labels.where(F.col("toxic").isNotNull() & learns(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("label"))
    texts = docs.where(learns(F.col("doc_id"))).select("doc_id", body(F.col("text")).alias("text"))
    hashed = texts.select("doc_id", F.md5("text").alias("mark"), terms(F.col("text")).alias("terms"))
    # Merged at every size: the labels grow with the table.
    rows = kept(
        hashed.join(known.hint("merge"), "doc_id").groupBy("mark").agg(F.max("label").alias("label"), F.first("terms").alias("terms")),
        "toxicity-rows",
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    toxic, clean = total["p"], total["n"] - total["p"]
    if not toxic or not clean:
        return empty
    steps = 1 << 30
    rates = {1: min(1.0, fit_rows / 2 / toxic), 0: min(1.0, fit_rows / 2 / clean)}
    chance = F.when(F.col("label") == 1, F.lit(int(rates[1] * steps))).otherwise(F.lit(int(rates[0] * steps)))
    drawn = (F.pmod(F.xxhash64("mark"), F.lit(steps)) < chance).cast("int")
    counts = (
        rows.select("label", F.explode("terms").alias("term")).groupBy("term")
        .agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
        .where(F.col("p") + F.col("n") >= SEEN).orderBy("term").toPandas()
    )
    p, n = counts["p"].to_numpy(float), counts["n"].to_numpy(float)
    odds = np.log((p + 0.5) / (toxic - p + 0.5)) - np.log((n + 0.5) / (clean - n + 0.5))
    sure = odds / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    if not len(counts):
        return empty
    place = np.full(BUCKETS, -1, np.int32)
    place[counts["term"].to_numpy(int)] = np.arange(len(counts))
    # Toxic terms start at the lower bound of their odds over all rows, halved as a word and its beginning are two terms: the
    # sample holds some too rarely to learn them.
    start = np.where(sure >= SURE, 0.5 * odds * (1 - SURE / np.maximum(sure, SURE)), 0.0)
    # Terms that tell nothing alone are learned too, rare ones slowly: their chance rows would drown the others.
    pace = np.where(np.abs(sure) >= SURE, 1.0, np.clip((p + n) / OFTEN, 0.05, 1))

    @F.pandas_udf("array<int>")
    def known_terms(found: pd.Series) -> pd.Series:
        return found.map(lambda t: [x for x in place[np.asarray(t, np.int64)].tolist() if x >= 0])

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("mark")
        inside = [np.asarray(t, np.int64) for t in frame["terms"]]
        bias, linear, pairs = fit(inside, frame["label"].to_numpy(float), len(start), start=start, pace=pace)
        yield pd.DataFrame({"bias": [bias], "linear": [linear.astype(np.float32).tobytes()], "pairs": [pairs.astype(np.float32).tobytes()]})

    sample = rows.where(drawn == 1).select("mark", "label", known_terms("terms").alias("terms")).repartition(1)
    model = sample.mapInPandas(train, "bias double, linear binary, pairs binary").first()
    if model is None:
        return empty
    # Labels drawn at different rates shift the odds of all rows alike.
    bias = model["bias"] + float(np.log(rates[0] / rates[1]))
    return Machine(bias, place, np.frombuffer(model["linear"], np.float32), np.frombuffer(model["pairs"], np.float32).reshape(-1, FACTORS))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` per row."""
    slim = docs.select("doc_id", terms(F.col("text")).alias("terms"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.scores(flat, counts))], ["doc_id", "score"])

    return slim.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 30_000) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``."""
    found = scored(docs, learn(docs, labels, fit_rows))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = 30_000) -> DataFrame:
    """The documents below the threshold, all their columns."""
    machine = learn(docs, labels, fit_rows)

    @F.pandas_udf("double")
    def score(found: pd.Series) -> pd.Series:
        counts = found.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *found.to_list()]).astype(np.int64)
        return pd.Series(machine.scores(flat, counts))

    return docs.where(score(terms(F.col("text"))) < THRESHOLD)
