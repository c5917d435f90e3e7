"""Operator 13: the prefix trie of rebuilt conversations, by digests of blocks of turns.

Conversations are cut into blocks of ``BLOCK`` turns. A block's digest is keyed by the places of its turns and covers all
that stands before it, so one grouping by (digest before, digest at the end) finds the different blocks that follow
each prefix, with their members, however deep they lie. Where one block alone follows a prefix, all its turns have the
same members, and its nodes are read off. Only where siblings diverge are the turns of the few different blocks
listed and grouped, turn by turn.

Turns are numbered in a range-partitioned, sorted stream, and running digests are made in segments of ``SEGMENT`` turns, so
one endless conversation is no task of its own. Texts are replaced by digests and lengths before anything is shuffled.

Each conversation but the first of a node shares with a smaller one what stands before the place where it leaves
every smaller one (``leaves_at``, in code points). A subtree's saved code points are so a sum over members, like the
leaves: each leaf is counted at its smallest member.

Cases: rows with a null conv_id belong to no conversation; turns are ordered by turn (null first), then by role
and by the SHA-256 of their text, so repeated turn numbers have a defined order and equal rows stay as many turns; a null
role or text is empty, and an empty turn is a turn; a conversation without turns is a member of the root; other
columns are left out; an empty table has no conversation and so no node, not even the root. Equality of turns is that
of 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small_batches

SPAN, HEAD_TURNS = 100, 6  # a conversation's first turns come from that of the same hundred; fewer than HEAD_TURNS of them
BLOCK = 4
SEGMENT = 256 * BLOCK
ID_CHUNK = 4096
KEY = ["block", "before_a", "before_b", "end_a", "end_b", "n", "last"]
PREFIX = ["block", "before_a", "before_b"]
NODE = ["depth", "a", "b"]
MANY = 4096


def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD_TURNS


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among those of its conversation in this partition; rows come sorted."""
    last, count = None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        begins = np.flatnonzero(new)
        place = np.arange(len(conv)) - begins[np.cumsum(new) - 1]
        if last is not None and conv[0] == last:
            place[: begins[1] if len(begins) > 1 else len(conv)] += count
        last, count = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), *batch.columns[1:]], ["conv_id", "place", "g1", "g2", "chars"])


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, g1, g2, chars) for each turn, and (conv_id, own) with the number of turns."""
    small_batches(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    turns = materialize(turns, "turns")  # the range bounds come from a first look at these
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = ranged.select("conv_id", F.xxhash64("role", "digest").alias("g1"), F.xxhash64(F.lit("second"), "role", "digest").alias("g2"), "chars")
    pieces = materialize(hashed.mapInArrow(_numbered, "conv_id long, place long, g1 long, g2 long, chars long").withColumn("part", F.spark_partition_id()), "numbered")
    runs = pieces.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a range partition can have begun in another one: as many rows as there are partitions at most
    moved = runs.select("conv_id", "part", F.sum("n").over(earlier).alias("earlier")).where("earlier > 0")
    placed = pieces.join(F.broadcast(moved), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("place"), "g1", "g2", "chars")
    return placed, runs.groupBy("conv_id").agg(F.sum("n").alias("own"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length, place, g1, g2, chars) for each turn of each rebuilt conversation, and (conv_id, length)."""
    placed, own = numbered_turns(conversations)
    own = materialize(own, "lengths")
    is_head = F.col("conv_id") % SPAN == 0
    head_lengths = own.where(is_head).select(F.col("conv_id").alias("head"), F.col("own").alias("head_own"))
    plan = own.select("conv_id", "own", head_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % SPAN).alias("head")).join(head_lengths, "head", "left")
    plan = plan.withColumn("base", F.least("h", F.coalesce("head_own", F.lit(0)))).withColumn("length", F.col("base") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = materialize(plan.select("conv_id", "head", "h", "base", "length"), "plan")
    values = ["g1", "g2", "chars"]
    kept = placed.join(plan, "conv_id").where("place >= h").select("conv_id", "length", (F.col("place") - F.col("h") + F.col("base")).alias("place"), *values)
    heads = placed.where(is_head & (F.col("place") < HEAD_TURNS - 1)).withColumnRenamed("conv_id", "head")
    lent = heads.join(plan, "head").where("place < h").select("conv_id", "length", "place", *values)
    return kept.unionByName(lent), plan.select("conv_id", "length")


def _slots(names: str, n: int = BLOCK) -> list[str]:
    return [f"{c}{j}" for c in names for j in range(n)]


def blocks_of(turns: DataFrame) -> DataFrame:
    """A row for each block: its place, the digests before it and after each of its turns, code points before it and of each turn."""
    slot = F.col("place") % BLOCK
    keyed = turns.select("conv_id", "length", F.expr(f"place div {SEGMENT}").alias("segment"), F.expr(f"place div {BLOCK}").alias("block"), slot.alias("slot"), F.xxhash64("place", "g1").alias("a"), F.xxhash64("place", "g2").alias("b"), "chars")
    by_slot = [F.max(F.when(F.col("slot") == j, F.col(src))).alias(f"{dst}{j}") for dst, src in (("x", "a"), ("y", "b"), ("c", "chars")) for j in range(BLOCK)]
    sums = [F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("chars").alias("chars")]
    # one shuffle: grouping and running values both stay inside a segment of a conversation
    grouped = keyed.repartition("conv_id", "segment").groupBy("conv_id", "length", "segment", "block").agg(F.count("*").alias("n"), *by_slot, *sums)
    running = Window.partitionBy("conv_id", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(grouped.withColumns({"ra": F.bit_xor("xa").over(running), "rb": F.bit_xor("xb").over(running), "rc": F.sum("chars").over(running)}), "blocks")
    long = parts.where(F.col("length") > SEGMENT).groupBy("conv_id", "segment").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("chars").alias("chars"))
    up_to = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = long.select("conv_id", "segment", F.bit_xor("xa").over(up_to).alias("sa"), F.bit_xor("xb").over(up_to).alias("sb"), F.sum("chars").over(up_to).alias("sc")).where("segment > 0")
    zero = F.lit(0).cast("long")
    joined = parts.join(segments, ["conv_id", "segment"], "left")

    def before(kind: str) -> Column:
        return F.coalesce(f"r{kind}", zero).bitwiseXOR(F.coalesce(f"s{kind}", zero))

    def after(kind: str, letter: str, j: int) -> Column:
        return reduce(lambda x, i: x.bitwiseXOR(F.coalesce(f"{letter}{i}", zero)), range(j + 1), before(kind))

    return joined.select(
        "conv_id",
        "block",
        "n",
        ((F.col("block") * BLOCK + F.col("n")) == F.col("length")).alias("last"),
        before("a").alias("before_a"),
        before("b").alias("before_b"),
        after("a", "x", BLOCK - 1).alias("end_a"),
        after("b", "y", BLOCK - 1).alias("end_b"),
        (F.coalesce("rc", zero) + F.coalesce("sc", zero)).alias("before_chars"),
        *[after("a", "x", j).alias(f"a{j}") for j in range(BLOCK)],
        *[after("b", "y", j).alias(f"b{j}") for j in range(BLOCK)],
        *[F.coalesce(f"c{j}", zero).alias(f"c{j}") for j in range(BLOCK)],
    )


def _chars_before(j: int) -> Column:
    return reduce(lambda x, i: x + F.col(f"c{i}"), range(j), F.col("before_chars"))


def _turns_of(siblings: DataFrame, values, *also: str) -> DataFrame:
    """A row for each turn of each different block: its node, and ``values(j)`` of its place in the block."""

    def turn(j: int) -> Column:
        own = [(F.col("block") * BLOCK + (j + 1)).alias("depth"), F.col(f"a{j}").alias("a"), F.col(f"b{j}").alias("b")]
        return F.struct(*own, *[c.alias(name) for name, c in values(j).items()])

    return siblings.select(*also, F.inline(F.slice(F.array(*[turn(j) for j in range(BLOCK)]), F.lit(1), F.col("n").cast("int"))))


def _flagged(siblings: DataFrame, kinds: DataFrame) -> DataFrame:
    """``siblings`` with ``alone``: whether no other block follows their prefix.

    Prefixes that more than one ``MANY``th of all different blocks follow are fewer than ``MANY`` and are broadcast, so that
    their blocks are not brought together to be told that they have siblings.
    """
    many = kinds.where(F.col("kinds") * MANY > max(siblings.count(), MANY)).select(*PREFIX, F.lit(True).alias("many"))
    marked = siblings.join(F.broadcast(many), PREFIX, "left")
    rest = marked.where("many IS NULL").join(kinds, PREFIX).withColumn("alone", F.col("kinds") == 1).drop("kinds", "many")
    return rest.unionByName(marked.where("many").withColumn("alone", F.lit(False)).drop("many"))


def _refined(siblings: DataFrame, values, merges: list[Column]) -> DataFrame:
    """Nodes: read off where one block follows a prefix (``alone``), grouped turn by turn where several do."""
    plain, split = (_turns_of(siblings.where(w), values) for w in ("alone", "NOT alone"))
    merged = split.groupBy(*NODE).agg(*merges)
    return plain.unionByName(merged)


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """The contract's columns, a row for each node."""
    turns, lengths = rebuilt_turns(conversations)
    blocks = materialize(blocks_of(turns), "chained")
    fixed = [*_slots("abc"), "before_chars"]  # equal for all members of a key
    siblings = materialize(blocks.groupBy(*KEY).agg(F.count("*").alias("members"), F.min("conv_id").alias("first"), *[F.min(c).alias(c) for c in fixed]), "siblings")
    kinds = materialize(siblings.groupBy(*PREFIX).agg(F.count("*").alias("kinds")), "kinds")
    flagged = _flagged(siblings, kinds)

    def counted(j: int) -> dict[str, Column]:
        ended = F.col("last") & (F.col("n") == j + 1)
        return {
            "n_convs": F.col("members"),
            "first": F.col("first"),
            "ended": F.when(ended, F.col("members")).otherwise(0),
            "chars_before": _chars_before(j),
            "up_a": F.col(f"a{j - 1}" if j else "before_a"),
            "up_b": F.col(f"b{j - 1}" if j else "before_b"),
        }

    merges = [F.sum("n_convs").alias("n_convs"), F.min("first").alias("first"), F.sum("ended").alias("ended"), *[F.min(c).alias(c) for c in ("chars_before", "up_a", "up_b")]]
    nodes = materialize(_refined(flagged, counted, merges), "nodes")

    # where a conversation leaves every smaller one: before the first node whose smallest member it is; at its end if there is none
    owners = nodes.groupBy(F.col("first").alias("conv_id")).agg(F.min("chars_before").alias("leaves_at"), F.max((F.col("ended") == F.col("n_convs")).cast("long")).alias("leaf"))
    totals = blocks.where("last").select("conv_id", _chars_before(BLOCK).alias("total"))
    shared = materialize(totals.join(owners, "conv_id", "left").select("conv_id", F.coalesce("leaves_at", "total").alias("leaves_at"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")), "shared")
    saved = [F.sum(F.greatest(F.col("leaves_at") - _chars_before(j), F.lit(0))).alias(f"saved{j}") for j in range(BLOCK)]
    weighed = materialize(blocks.join(shared, "conv_id").groupBy(*KEY).agg(F.sum("leaf").alias("leaves"), *saved, *[F.min(c).alias(c) for c in _slots("ab")]), "weighed")

    def weights(j: int) -> dict[str, Column]:
        return {"n_leaves": F.col("leaves"), "saved_tokens": F.col(f"saved{j}")}

    sums = _refined(_flagged(weighed, kinds), weights, [F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")])

    zero = F.lit(0).cast("long")
    deep = shared.agg(F.coalesce(F.sum("leaf"), zero).alias("n_leaves"), F.coalesce(F.sum("leaves_at"), zero).alias("saved_tokens"))
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("first")).where("n_convs > 0")
    root = root.crossJoin(F.broadcast(deep)).select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "n_convs", "first", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")  # one row and one row
    names = [*NODE, "n_convs", "first", "n_leaves", "saved_tokens", "up_a", "up_b"]
    whole = nodes.join(sums, NODE).select(names).unionByName(root.withColumns({"up_a": F.lit(None).cast("long"), "up_b": F.lit(None).cast("long")}).select(names))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    ends = blocks.where("last").select((F.col("block") * BLOCK + F.col("n")).alias("depth"), F.col("end_a").alias("a"), F.col("end_b").alias("b"), "conv_id")
    ends = ends.unionByName(lengths.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("first").alias("parent")).unionByName(root.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("first").alias("parent")))
    full = whole.join(children, NODE, "left").join(id_digests(ends), NODE, "left").join(parents, ["depth", "up_a", "up_b"], "left")
    return full.select(
        F.col("first").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the rows of each node, which come in order and may be any number."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for key, ids in zip(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), batch.column("ids").to_pylist(), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield _digest_rows(done)
    if node is not None:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined conv_ids of each node, ascending. A hash has one order, so one task reads a node's ids, but
    as joined stretches of ``ID_CHUNK`` ids' range, a row each, and keeps none of them."""
    chunk = F.floor(F.col("conv_id") / ID_CHUNK).alias("chunk")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    stretches = ends.groupBy(*NODE, chunk).agg(joined)
    return stretches.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(_streamed_digests, "depth long, a long, b long, ends_sha256 string")
