"""Packing whole documents into token sequences of a fixed length, by linear grouping.

Documents are tokenised in Python tasks, the distinct words of many texts at once; words seen before come from a bounded table,
which lives as long as the task. Only documents longer than a sequence are cut. The lengths' histogram (one count per length, so at most
the capacity's number of rows) is planned on the driver, see ``bin_plans``; every piece then finds its sequence and offset from its
rank among the pieces of its length. Ranks come from blocks of a hash, so a length that a third of all pieces share
is ranked by many tasks.

Defined cases: a null text is empty: one piece that holds the end id alone; repeated rows are packed each for itself;
a null id is packed like any other; an empty table gives an empty answer; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.llm import bin_plans
from sqltally.llm.words import body
from sqltally.operators.running import rank_rows
from sqltally.session import kept, ship_package

#: Pieces of text that a worker remembers, and those in one call of the tokenizer; bytes of texts that are encoded together.
REMEMBERED, AT_ONCE, TOGETHER = 250_000, 1 << 12, 4 << 20
#: Chunks of printable ASCII and Latin-1 letters fall apart into pieces that are encoded each for itself. An
#: apostrophe is left out: it may start a contraction.
SIMPLE = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")


class WordTokenizer:
    """Ids of a tokenizer that lower-cases, splits at white space and marks the ends of words, as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for word, i in vocabulary.items():
            self.ends[i] = word.endswith("</w>")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self.remembered = REMEMBERED

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, pieces: list[str]) -> list[bytes]:
        """One call for all; a piece's ids end where a word ends."""
        joined = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids
        ids = np.array(joined, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(pieces):
            return [self._one(p) for p in pieces]
        raw, stops = ids.tobytes(), stops.tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of some different chunks."""
        simple, made = [], {}
        for c in chunks:
            if SIMPLE.fullmatch(c):
                simple.append(c)
            elif c:
                made[c] = self._one(c)
        found = PIECE.findall("\n".join(simple).lower())
        wanted = set(found) - {"\n"}
        unknown = list(wanted.difference(self.pieces))
        if len(self.pieces) + len(unknown) > self.remembered:
            self.pieces, unknown = {}, list(wanted)
        for start in range(0, len(unknown), AT_ONCE):
            part = unknown[start : start + AT_ONCE]
            self.pieces.update(zip(part, self._many(part)))
        at = 0
        for c in simple:
            stop = found.index("\n", at) if c is not simple[-1] else len(found)
            made[c] = self.pieces[found[at]] if stop == at + 1 else b"".join([self.pieces[p] for p in found[at:stop]])
            at = stop + 1
        made[""] = b""
        return [made[c] for c in chunks]

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by ``end``, and where each text's begin and the last one's end.

        A text's chunks are looked up once for all texts together; a text that spells a control token is encoded whole.
        """
        odd = {i for t in self.added for i in np.flatnonzero(pc.match_substring(texts, t).to_numpy(zero_copy_only=False)).tolist()}
        if odd:
            mask = np.zeros(len(texts), bool)
            mask[list(odd)] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        else:
            plain = texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        # Behind the chunks' ids lie the end and the texts that were encoded whole.
        whole = sorted(odd)
        parts = [*self._ids(coded.dictionary.to_pylist()), end, *[self._one(texts[i].as_py()) for i in whole]]
        ids = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.cumsum(sizes) - sizes
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        picked = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        last = len(parts) - len(whole) - 1
        picked = np.insert(picked, np.concatenate([stops[whole], stops]), [*range(last + 1, len(parts)), *[last] * len(texts)])
        lengths = sizes[picked]
        ahead = np.cumsum(lengths)
        places = np.arange(ahead[-1] if len(ahead) else 0) + np.repeat(first[picked] - ahead + lengths, lengths)
        # A text's items are its chunks, itself if it is encoded whole, and the end.
        items = stops + np.cumsum(np.isin(np.arange(len(texts)), whole)) + np.arange(1, len(texts) + 1)
        return ids[places], np.concatenate([[0], ahead[items - 1]]).astype(np.int64)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, remembered: int = REMEMBERED, together: int = TOGETHER
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``: the tokens of each document and the end id.

    ``remembered`` pieces of text and ``together`` bytes of texts bound a worker's memory; larger bounds take less time.
    """
    ship_package(docs.sparkSession)
    slim = docs.select("doc_id", body(F.col("text")).alias("text"))
    fields = [slim.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        tokenizer.remembered = remembered
        for batch in batches:
            origin, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = batch.column("text")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            groups = np.searchsorted(sizes // together, np.unique(sizes // together), "left").tolist()
            for a, b in zip(groups, [*groups[1:], len(texts)]):
                ids_of, bounds = tokenizer.encode_all(texts.slice(a, b - a), end)
                raw = memoryview(ids_of.tobytes())
                bounds = (4 * bounds).tolist()
                for i, (begin, stop) in enumerate(zip(bounds, bounds[1:]), a):
                    for k, at in enumerate(range(begin, stop, width)):
                        part = raw[at : min(at + width, stop)]
                        origin.append(i)
                        piece.append(k)
                        start.append((at - begin) // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(origin, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        # The worker lives on, perhaps idle: what the task learned would take memory from others.
        tokenizer.pieces = {}
        pa.default_memory_pool().release_unused()

    return slim.mapInArrow(run, T.StructType(fields))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, groups: int = 96, **bounds: int) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; ``bounds`` as for ``token_pieces``."""
    # Numbered once, in a written table: a task that runs again later reads the same numbers.
    pieces = kept(
        token_pieces(docs, path, capacity, end_id, with_ids, **bounds).withColumn("_row", F.monotonically_increasing_id()),
        "pack-pieces",
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = bin_plans.slot_table(bin_plans.plan(counts, capacity, groups))
    mixed = F.shiftrightunsigned(F.xxhash64("_row"), 1)
    ranked = rank_rows(
        pieces.withColumn("_mixed", mixed), ["length"], [F.col("_mixed"), F.col("_row")],
        F.shiftright("_mixed", 52).cast("int"), "_rank",
    ).drop("_mixed", "_row")
    schema = T.StructType([*ranked.drop("_rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    starts = (slots["length"] << 44) + slots["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) - 1
            at = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            local = rank - slots["first"][at]
            sequence = slots["sequence"][at] + local // slots["per"][at]
            offset = slots["offset"][at] + local % slots["per"][at] * length
            own = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token sequences of pieces packed ``with_ids``; a sequence is at most its capacity."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
