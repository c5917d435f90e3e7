"""Operator 3: near duplicates by b-bit MinHash, confirmed on full shingle sets.

Each document's distinct word shingles give 128 minima. Five minima make a band; 25 bands make pairs of 85 %
similarity meet with probability 1 - 4e-7, of 80 % with 1 - 5e-5. Of every minimum only the low four bits are kept beside the bands,
packed in eight 64-bit numbers: the bit count of what differs, corrected for chance collisions, estimates the
similarity of candidates and discards hopeless ones (``SLACK`` below the threshold: six standard deviations at 85 %, 5.4 at 80 %).
What remains is confirmed on the full sets, computed from the whole texts.

Documents with equal sets are one class, found by a digest and represented by their smallest id; they are
linked by it and never expanded into pairs. In each bucket members are first compared with the bucket's
smallest id only; where a bucket still spans several components after that, the pairs between its different
components are compared too, so that no link between different sets is lost, while a group whose members are
linked already costs one comparison a member. Of those pairs only the possible ones are made: a link across
components rests on shingles that several components hold, so a pair whose sets have too few of these for
their sizes is none; and a shingle whose bit the other set's bit map lacks is not in that set, which bounds the
intersection from above. A large bucket is compared in blocks of both sides. Neither test loses a link; both leave out the copies whose own changes set them apart.

Cases: a text with fewer words than a shingle is one shingle; null, empty and blank texts have no set, no
links, and are their own component; rows with equal ids are one document; a row with a null id has the component of its
set (null if no such row has an id) and a null ``kept``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, NOT_SPACE, blocks, gram_hashes, mixed, word_hashes, word_spans
from .components import connected_components
from .shared import materialize, texts

SHINGLE = 5
PERCENT = 85
HASHES = 128
BAND = 5
BITS = 4
MAP_LONGS = 32  # 2,048 bits in a set's bit map
BUCKET_ROWS = 2000  # of an open bucket that a task compares with as many others
SLACK = 0.2  # six standard deviations of the estimate at the threshold

_rng = np.random.Generator(np.random.PCG64(2024))
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a text of fewer than k words is one shingle."""
    for first, _, body, offsets in blocks(column):
        body = LOWER[body]
        starts, ends, row_words = word_spans(body, offsets, NOT_SPACE)
        words = word_hashes(body, starts, ends)
        grams = gram_hashes(words, k)
        for row, (a, b) in enumerate(zip(row_words[:-1].tolist(), row_words[1:].tolist(), strict=True)):
            if b - a >= k:
                yield first + row, np.unique(grams[a : b - k + 1])
            else:
                yield first + row, gram_hashes(words[a:b], b - a) if b > a else grams[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 2048):
        np.minimum(out, (high[at : at + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    n = HASHES // BAND
    rows = least[: n * BAND].reshape(n, BAND).astype(np.uint64)
    key = np.arange(1, n + 1, dtype=np.uint64)
    for j in range(BAND):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def low_bits(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the (mixed) minima, sixteen to a 64-bit number."""
    low = mixed(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return (low.reshape(-1, 64 // BITS) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands, bits): size and digest of the set, band keys and packed low bits; null without a set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, bands, bits = [], [], [], []
            for _, shingles in shingle_sets(batch.column(1), k):
                size.append(len(shingles))
                if not len(shingles):
                    digest.append((None, None))
                    bands.append(None)
                    bits.append(None)
                    continue
                digest.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64).tolist())
                least = minima(shingles)
                bands.append(band_keys(least))
                bits.append(low_bits(least))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), pa.array(bands, longs), pa.array(bits, longs)], ["doc_id", "n_shingles", "s1", "s2", "bands", "bits"])

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, bits array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the share of equal low bits, less what chance makes equal."""
    unequal = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def confirmed(pairs: DataFrame, whole: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for (_, x), (_, y) in zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = whole.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = whole.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long")


def common_shingles(placed: DataFrame, whole: DataFrame, k: int) -> DataFrame:
    """(rep, size, common) of the documents in ``placed`` (rep, c): shingles, and those that another component holds too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, homes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = list(shingle_sets(batch.column(2), k))
            size = np.array([len(x) for _, x in own], np.int64)
            grams = np.concatenate([x for _, x in own]) if own else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.repeat(ids, size)), pa.array(np.repeat(homes, size)), pa.array(np.repeat(size, size))], ["gram", "rep", "c", "size"])

    read = whole.withColumnRenamed("doc_id", "rep").join(placed.select("rep", "c").distinct(), "rep").select("rep", "c", "text")
    grams = materialize(read.mapInArrow(rows, "gram long, rep long, c long, size long"), "open-shingles")
    spread = grams.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("gram")
    return grams.join(spread, "gram", "left_semi").groupBy("rep", "size").agg(F.count("*").alias("common"))


def bit_maps(whole: DataFrame, k: int) -> DataFrame:
    """(rep, bitmap): of each document's shingles, a bit by their hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = np.zeros((batch.num_rows, 64 * MAP_LONGS), np.uint8)
            for row, shingles in shingle_sets(batch.column(1), k):
                maps[row, (shingles % np.uint64(64 * MAP_LONGS)).astype(np.int64)] = 1
            packed = np.packbits(maps, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(packed), pa.list_(pa.int64()))], ["rep", "bitmap"])

    return whole.select("doc_id", "text").mapInArrow(rows, "rep long, bitmap array<long>")


def absent(a: Column, b: Column) -> Column:
    """At least so many shingles of the set with bit map ``a`` are not in that with ``b``."""
    out = F.lit(0)
    for i in range(MAP_LONGS):
        out = out + F.bit_count(F.get(a, i).bitwiseAND(F.bitwise_not(F.get(b, i))))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    base = texts(docs, id_col, text_col)
    signed = materialize(signatures(base, k), "signatures")
    classes = materialize(signed.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    least = percent / 100 - SLACK

    banded = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    leaders = materialize(banded.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a"), "leaders")
    members = materialize(banded.join(leaders, "key"), "buckets")  # (key, rep, a): buckets of several classes only
    bits = materialize(reps.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "bits"), "bits")
    # a merge join at every size: what is shuffled then follows the input
    whole = materialize(base.join(bits.select("doc_id").hint("merge"), "doc_id", "left_semi"), "paired-texts")

    def likely(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a")), "a")
        with_b = with_a.join(bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b")), "b")
        return with_b.where(estimate(F.col("bits_a"), F.col("bits_b")) >= least).select("a", "b")

    stars = members.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    linked = materialize(confirmed(likely(stars), whole, k, percent), "links")
    labels = connected_components(linked)

    # pairs across the components that still share a bucket
    placed = members.select("key", "rep").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    placed = materialize(placed, "placed")
    torn = materialize(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "torn")
    open_rows = materialize(placed.join(torn, "key"), "open")
    able = materialize(common_shingles(open_rows, whole, k).where(f"100 * common >= {percent} * size"), "able")
    keys = open_rows.groupBy("rep").agg(F.collect_list("key").alias("keys"))  # a band's key each, so 25 at most
    maps = bit_maps(whole.join(able.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), k)
    open_rows = materialize(open_rows.join(able, "rep").join(keys, "rep").join(bits.select(F.col("doc_id").alias("rep"), "bits"), "rep").join(maps, "rep"), "able-rows")
    # a large bucket is compared in blocks, so that its pairs are dealt out over many tasks
    blocks = materialize(open_rows.groupBy("key").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("n_blocks")).where("n_blocks > 1"), "large-buckets")
    x, y, same_cell = open_rows.alias("x"), open_rows.alias("y"), F.col("x.key") == F.col("y.key")
    if not blocks.isEmpty():
        dealt = open_rows.join(blocks, "key", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int")).withColumn("each", F.sequence(F.lit(0), F.col("n_blocks") - 1))
        x = dealt.withColumn("i", F.col("block")).withColumn("j", F.explode("each")).drop("block", "each", "n_blocks").alias("x")
        y = dealt.withColumn("j", F.col("block")).withColumn("i", F.explode("each")).drop("block", "each", "n_blocks").alias("y")
        same_cell &= (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    needed = percent * (F.col("x.size") + F.col("y.size"))  # of (100 + percent) * intersection
    enough = (100 + percent) * F.least("x.common", "y.common") >= needed
    most = F.least(F.col("x.size") - absent(F.col("x.bitmap"), F.col("y.bitmap")), F.col("y.size") - absent(F.col("y.bitmap"), F.col("x.bitmap")))
    possible = (100 + percent) * most >= needed
    likely_pair = estimate(F.col("x.bits"), F.col("y.bits")) >= least
    first_meeting = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")  # a pair comes from one bucket only
    across = x.join(y, same_cell & (F.col("x.c") < F.col("y.c")) & enough & likely_pair & possible & first_meeting)
    more = across.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    late = materialize(confirmed(more, whole, k, percent), "late-links")
    if not late.isEmpty():
        labels = connected_components(linked.union(late))

    by_set = materialize(classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id")), "set-components")
    ids = signed.select("doc_id", "n_shingles", "s1", "s2").join(by_set, ["s1", "s2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return ids.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its component; all columns.

    Rows with a null id stay, whatever their text: nothing names them as a copy's keeper or as a copy.
    """
    kept = near_duplicates(docs, id_col, text_col, percent=percent).where("kept").select(F.col("doc_id").alias(id_col))
    return docs.join(kept, id_col, "left_semi").select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
