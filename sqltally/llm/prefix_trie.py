"""The trie of conversation prefixes: each distinct sequence of first turns is a node, with what its subtree shares.

A turn is taken up as a digest of role and text and its length; texts themselves are never shuffled. The digest of a
prefix is the sum of its turns' hashes with their places, 128 bits, so it comes from block-wise running totals, a prefix knows its
parent's digest, and a conversation of any length is spread over tasks.

Screening: a count-min sketch counts all prefixes in ``ROWS`` rows of cells. An estimate of one, a cell that only one
prefix fell into, proves that no other conversation has that prefix: its node is complete as it stands and emitted where it is.
The sketch is a set of bits, a bit per cell counted once; it is sent to all tasks, at most ``2^WIDEST`` bits a row. With many
more prefixes than cells it proves less, and more prefixes take the exact way; the result is the same.

Exact way, for prefixes that may be shared: partial aggregates by digest give a node's members and its smallest one, its owner. A
conversation owns its prefixes from some depth on, so what a subtree holds is the sum over its members of what each of them
owns at that depth and below: running totals from the last turn up, then one more aggregate by digest.

Defined cases: turns are ordered by number, null first, then by digest, so repeated rows are turns of their own; a null role or
text is empty; rows without a conversation id belong to no conversation; an empty table gives an empty answer; other columns are
ignored, whatever their names. Many rows of one conversation with one turn number are ordered by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.llm.words import body
from sqltally.operators.running import rank_rows, running
from sqltally.session import kept

#: Rows of the sketch; its least and greatest width as powers of two, and cells per prefix between them.
ROWS, NARROWEST, WIDEST, CELLS = 2, 10, 27, 4
#: Turn numbers per task of one conversation; ids of conversations that end at one node, per piece.
TURNS, IDS = 1 << 16, 1 << 12
_LOW = (1 << 32) - 1
KEY, PARENT = ["k1", "k2"], ["u1", "u2"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Per turn ``conv_id, pos`` (from 1), ``mark`` (digest of role and text) and ``chars`` (code points of the text)."""
    role, text = body(F.col("role")), body(F.col("text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.sha2(said, 256)).alias("mark"), F.length(text).cast("bigint").alias("chars")
    )
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS).cast("bigint"), F.lit(-(1 << 62)))
    return rank_rows(kept(rows, "trie-turns"), ["conv_id"], [F.asc_nulls_first("turn"), F.col("mark")], bucket, "pos").drop("turn")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their conversation's length ``n``, and ``conv_id, n`` of all conversations."""
    turns = kept(turns, "trie-ranked")
    sizes = kept(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    return turns.join(sizes, "conv_id"), sizes


def spliced(turns: DataFrame, source: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first ``head`` turns of conversation ``source``, then the own turns after the first ``head``.

    ``source`` and ``head`` are columns over ``conv_id``. A shorter source gives what it has, an absent one nothing.
    """
    turns = kept(turns, "trie-ranked")
    sizes = kept(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("given")), "trie-given")
    plans = sizes.select("conv_id", "given", source.alias("source"), head.cast("bigint").alias("head"))
    there = sizes.select(F.col("conv_id").alias("source"), F.col("given").alias("there"))
    plans = plans.join(there, "source", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    plans = kept(plans.withColumn("n", F.col("taken") + F.greatest(F.col("given") - F.col("head"), F.lit(0))), "trie-plans")
    own = turns.join(plans, "conv_id").where("pos > head").withColumn("pos", F.col("pos") - F.col("head") + F.col("taken"))
    firsts = turns.withColumnRenamed("conv_id", "source").join(plans, "source").where("pos <= head")
    columns = ["conv_id", "pos", "mark", "chars", "n"]
    return own.select(columns).unionByName(firsts.select(columns)), plans.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn the prefix that ends with it: ``conv_id, depth``, its key, its parent's key, ``chars`` and ``ends``."""
    hashes = [F.xxhash64(F.lit(seed), "pos", "mark") for seed in (1, 2)]
    parts = [p for h in hashes for p in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))]
    rows = turns.select(
        "conv_id", F.col("pos").alias("depth"), "chars", (F.col("pos") == F.col("n")).alias("ends"),
        *[p.alias(f"p{k}") for k, p in enumerate(parts)],
    )
    summed = running(kept(rows, "trie-parts"), ["conv_id"], "depth", {f"s{k}": f"p{k}" for k in range(4)})
    low = lambda c: c.bitwiseAND(F.lit(_LOW))
    key = lambda a, b: low(a).bitwiseOR(F.shiftleft(low(b), 32))
    now = [F.col(f"s{k}") for k in range(4)]
    before = [F.col(f"s{k}") - F.col(f"p{k}") for k in range(4)]
    return summed.select(
        "conv_id", "depth", "chars", "ends", key(*now[:2]).alias("k1"), key(*now[2:]).alias("k2"),
        key(*before[:2]).alias("u1"), key(*before[2:]).alias("u2"),
    )


def _cells(key: list[str], width: int) -> list[Column]:
    """A key's cell in each row of the sketch, from 1, rows laid end to end."""
    return [F.pmod(F.xxhash64(F.lit(r), *key), F.lit(width)) + (r * width + 1) for r in range(ROWS)]


def screened(rows: DataFrame, widest: int = WIDEST) -> DataFrame:
    """Add ``single`` and ``parent_single``: the sketch proves that no other conversation has the prefix, or its parent's.

    The bits come in pieces of 4 kB, at most ``ROWS * 2^widest`` bits in all, so they may be sent to every task.
    """
    width = 1 << min(widest, max(NARROWEST, (CELLS * rows.count()).bit_length()))
    counted = rows.select(F.explode(F.array(*_cells(KEY, width))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    once = counted.where("n = 1").groupBy(F.bitmap_bucket_number("cell").alias("piece"))
    sketch = kept(once.agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")), "trie-sketch")
    found = rows
    for name, key in (("single", KEY), ("parent_single", PARENT)):
        proved = F.lit(False)
        for r, cell in enumerate(_cells(key, width)):
            place, bits = f"_{name}_{r}", f"_{name}_bits_{r}"
            piece = F.broadcast(sketch.select(F.col("piece").alias(place), F.col("bits").alias(bits)))
            found = found.withColumn(place, F.bitmap_bucket_number(cell)).join(piece, place, "left")
            at = F.bitmap_bit_position(cell)
            byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
            proved = proved | (F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")), F.lit(0)) == 1)
        found = found.withColumn(name, proved)
    return found.select(*rows.columns, "single", "parent_single")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``depth`` and key of each node where conversations end, with the SHA-256 of their ids, ascending and joined by commas.

    Ids are joined piece by piece by ranges of ids; only a node with several pieces has these hashed one after the other, by a
    task that holds one piece at a time.
    """
    node = ["depth", *KEY]
    piece = F.floor(F.col("conv_id") / IDS).alias("piece")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = kept(ends.groupBy(*node, piece).agg(joined.alias("ids")), "trie-ends")
    sizes = pieces.groupBy(*node).agg(F.count(F.lit(1)).alias("pieces"), F.min("ids").alias("ids"))
    sizes = kept(sizes, "trie-end-nodes")
    short = sizes.where("pieces = 1").select(*node, F.sha2("ids", 256).alias("ends_sha256"))
    many = pieces.join(sizes.where("pieces > 1").select(*node), node, "left_semi")
    schema = short.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in node])
            for key, ids in zip(keys, batch.column("ids")):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.as_py().encode())
                else:
                    state.update(b"," + ids.as_py().encode())
        if now is not None:
            done.append((*now, state.hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*done)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.name for f in schema.fields])

    whole_nodes = many.repartition(*node).sortWithinPartitions(*node, "piece")
    return short.unionByName(whole_nodes.mapInArrow(run, schema))


def trie(turns: DataFrame, sizes: DataFrame, widest: int = WIDEST) -> DataFrame:
    """All nodes of conversations given as ``turns`` (conv_id, pos, mark, chars, n) and ``sizes`` (conv_id, n; n may be 0).

    ``conv_id`` smallest member, ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` and ``ends_sha256``.
    """
    found = kept(screened(kept(prefixes(turns), "trie-prefixes"), widest), "trie-screened")
    alone, shared = found.where("single"), found.where("NOT single")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    nodes = kept(
        shared.groupBy(*KEY).agg(
            F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"), F.min("chars").alias("chars"),
            F.count_if("ends").alias("n_ends"), *[F.min(c).alias(c) for c in PARENT],
        ),
        "trie-nodes",
    )
    # What a member owns here: the saving of the node, and whether its own end is a leaf.
    met = shared.select("conv_id", "depth", *KEY, "ends").join(nodes.select(*KEY, "owner", "n_convs", "n_ends", "chars"), KEY)
    own = F.col("conv_id") == F.col("owner")
    held = kept(
        met.select(
            "conv_id", (-F.col("depth")).alias("up"), *KEY,
            F.when(own, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved"),
            F.col("ends").cast("bigint").alias("ended"),
            (F.col("ends") & own & (F.col("n_ends") == F.col("n_convs"))).cast("bigint").alias("leaf"),
        ),
        "trie-held",
    )
    below = running(held, ["conv_id"], "up", {"saved": "saved", "ended": "ended", "leaf": "leaf"})
    # A member whose end is not here ends at a node of its own: a leaf.
    sums = below.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum(F.col("leaf") + 1 - F.col("ended")).alias("n_leaves"))

    tips = alone.where("depth > 1 AND NOT parent_single")
    children = nodes.where("depth > 1").select(*PARENT).unionByName(tips.select(*PARENT)).groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.toDF(*KEY, "n_children")
    owners = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("owner").alias("above"))
    ends = shared.where("ends").select("depth", *KEY, "conv_id")
    none = [F.lit(0).cast("bigint").alias(c) for c in ("depth", *KEY)]
    digests = kept(ends_hashes(ends.unionByName(sizes.where("n = 0").select(*none, "conv_id"))), "trie-digests")

    top = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    leaf = F.col("n_ends") == F.col("n_convs")
    totals = (
        nodes.select((F.col("depth") == 1).alias("first"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
        .unionByName(alone.select((F.col("depth") == 1).alias("first"), F.col("ends").alias("leaf"), zero.alias("saved")))
        .agg(F.count_if("first").alias("n_children"), F.greatest(F.count_if("leaf"), one).alias("n_leaves"),
             F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    )
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    above = F.lit(top.conv_id).cast("bigint")
    root = totals.select(
        above.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(top.n_convs).alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens",
    ).where(F.lit(top.n_convs > 0)).join(digests.where("depth = 0").select("depth", "ends_sha256"), "depth", "left")
    inner = (
        nodes.join(sums, KEY).join(children, KEY, "left").join(owners, PARENT, "left").join(digests, ["depth", *KEY], "left").select(
            F.col("owner").alias("conv_id"), "depth",
            F.when(F.col("depth") == 1, above).otherwise(F.coalesce("above", "owner")).alias("parent_conv_id"),
            "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256",
        )
    )
    digest = F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing)
    tail = lambda rows, parent: rows.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), (~F.col("ends")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), digest.alias("ends_sha256"),
    )
    local = tail(alone.where("depth = 1 OR parent_single"), F.when(F.col("depth") == 1, above).otherwise(F.col("conv_id")))
    first = tail(tips.join(owners, PARENT), F.col("above"))
    columns = local.columns
    made = root.select(columns).unionByName(inner.select(columns)).unionByName(local).unionByName(first)
    return made.withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def conversation_trie(conversations: DataFrame, widest: int = WIDEST) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(*whole(turn_rows(conversations)), widest)
