"""Operator 10: find benchmark windows in documents, as a prefix-filtered set join.

A window (ten consecutive item words, or a whole shorter item) is a set of word shingles that a document
must contain entirely. Under full containment the necessary prefix is a window's rarest shingle, so:
corpus counts of the benchmark's shingles order each window's shingles by rarity; the rarest one of each
window is joined to the documents' shingles; a candidate must have room for the window around the shingle
(position and length bounds); the window's words are then compared exactly.

Documents are screened in the tasks by a bit table of fixed size, whatever the benchmark's size; the join
on the shingle hash then drops what only shares a bit. No document text is shuffled, only the words around
candidates.

Windows with equal words are one window throughout; the items that hold it are attached after the exact test.

Cases: a null or empty text has no words and no hits; a null or empty item has no window; items with equal
windows are all reported; each row is counted alone, also where rows share a doc_id or have none; an empty
benchmark leaves every document clean; other columns, however named, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWER, blocks, gram_hashes, word_hashes, word_spans
from .shared import materialize, texts

WINDOW = 10
SHINGLE = 3
FILTER_BITS = 24  # 2 MB a task


def _grams(words: np.ndarray, row_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles inside rows, and the word each starts at."""
    hashes = gram_hashes(words, k)
    at = np.arange(len(hashes))
    row = np.searchsorted(row_words, at, "right") - 1
    inside = at + k <= row_words[1:][row] if len(at) else np.zeros(0, bool)
    return hashes[inside], at[inside]


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, window, n, words, k, grams): every window with its words (space-joined) and its shingles in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            ids = batch.column(0).to_pylist()
            for row, _, body, offsets in blocks(batch.column(1)):
                body = LOWER[body]
                starts, ends, row_words = word_spans(body, offsets, ALNUM)
                hashes = word_hashes(body, starts, ends)
                for r in range(len(offsets) - 1):
                    a, b = int(row_words[r]), int(row_words[r + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    k = min(shingle, n)
                    grams = gram_hashes(hashes[a:b], k).view(np.int64)
                    for w in range(b - a - n + 1):
                        said = b" ".join(body[starts[i] : ends[i]].tobytes() for i in range(a + w, a + w + n))
                        for column, value in zip(out, (ids[row + r], w, n, said.decode("utf-8", "replace"), k, grams[w : w + n - k + 1]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.list_(pa.int64()))], ["item", "window", "n", "words", "k", "grams"])

    return bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(rows, "item string, window int, n int, words string, k int, grams array<long>")


def _bit_table(grams: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which of 2**FILTER_BITS slots the shingles (k, gram) fall in, and the shingle sizes: of fixed size, from one row a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = np.zeros(1 << FILTER_BITS, bool), set()
        for batch in batches:
            if batch.num_rows:
                sizes |= set(batch.column(0).to_pylist())
                table[batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(sizes)], pa.list_(pa.int32())), pa.array([np.packbits(table).tobytes()], pa.binary())], ["sizes", "bits"])

    table, sizes = np.zeros(1 << FILTER_BITS >> 3, np.uint8), set()
    for row in grams.select("k", "gram").coalesce(4).mapInArrow(rows, "sizes array<int>, bits binary").toLocalIterator():
        table |= np.frombuffer(row.bits, np.uint8)
        sizes |= set(row.sizes)
    return table, sorted(sizes)


def _screen(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - FILTER_BITS)
    return (table[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def shingle_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(k, gram, n): how often each shingle of ``grams`` occurs in all documents; one that never does is left out."""
    table, sizes = _bit_table(grams)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[np.ndarray]] = {k: [] for k in sizes}
            for _, _, body, offsets in blocks(batch.column(0)):
                body = LOWER[body]
                starts, ends, row_words = word_spans(body, offsets, ALNUM)
                hashes = word_hashes(body, starts, ends)
                for k in sizes:
                    own, _ = _grams(hashes, row_words, k)
                    found[k].append(own[_screen(shared.value, own)])
            for k, parts in found.items():
                gram, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "gram", "n"])

    counted = docs.select("text").mapInArrow(rows, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    return counted.join(grams.select("k", "gram").distinct(), ["k", "gram"])


def rarest_shingles(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(n, words, k, gram, offset), one row for all windows of equal words: the prefix, its rarest shingle and that
    one's offset. A window with an absent shingle can't occur and goes."""
    said = windows.groupBy("n", "words", "k").agg(F.min("grams").alias("grams"))
    each = said.select("n", "words", "k", F.posexplode("grams").alias("offset", "gram"))
    known = each.join(counts.withColumnRenamed("n", "seen"), ["k", "gram"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return known.groupBy("n", "words", "k").agg(F.min(F.struct("seen", "gram", "offset")).alias("least")).where("least.seen > 0").select("n", "words", "k", "least.gram", "least.offset")


def _candidates(docs: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, n_words, found): one row a document, found = places of prefix shingles and the words around them."""
    table, sizes = _bit_table(prefixes)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, end, body, offsets in blocks(batch.column(2)):
                body = LOWER[body]
                starts, ends, row_words = word_spans(body, offsets, ALNUM)
                n_words[first:end] = np.diff(row_words)
                hashes = word_hashes(body, starts, ends)
                for k in sizes:
                    own, at = _grams(hashes, row_words, k)
                    hit = np.flatnonzero(_screen(shared.value, own))
                    for gram, place, row in zip(own[hit].view(np.int64).tolist(), at[hit].tolist(), (np.searchsorted(row_words, at[hit], "right") - 1).tolist(), strict=True):
                        base, top = int(row_words[row]), int(row_words[row + 1])
                        left, right = max(base, place + k - window), min(top, place + window)
                        around = b" ".join(body[starts[i] : ends[i]].tobytes() for i in range(left, right))
                        found[first + row].append({"k": k, "gram": gram, "place": place - base, "left": left - base, "around": around.decode("utf-8", "replace")})
            kind = pa.list_(pa.struct([("k", pa.int32()), ("gram", pa.int64()), ("place", pa.int32()), ("left", pa.int32()), ("around", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.array(found, kind)], ["row", "doc_id", "n_words", "found"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(rows, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, found array<struct<k int, gram long, place int, left int, around string>>")


def find_windows(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: row, doc_id, n_words), (occurrences: row, start, n, words), starts counted in words, and (items: words, item).

    ``row`` numbers the rows of ``docs``.
    """
    base = texts(docs, id_col, text_col)
    windows = materialize(benchmark_windows(bench, item_col, item_text, window, shingle), "windows")
    grams = windows.select("k", F.explode("grams").alias("gram"))
    prefixes = materialize(rarest_shingles(windows, shingle_counts(base, grams)), "prefixes")
    seen = materialize(_candidates(base, prefixes, window), "candidates")
    near = seen.where(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    pairs = near.join(prefixes, ["k", "gram"]).withColumn("start", F.col("place") - F.col("offset"))
    roomy = pairs.where((F.col("start") >= F.col("left")) & (F.col("start") + F.col("n") <= F.col("n_words")))
    exact = roomy.where(F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("left") + 1, F.col("n")), " ") == F.col("words"))
    return seen.select("row", "doc_id", "n_words"), exact.select("row", "start", "n", "words"), windows.select("words", "item").distinct()


def contamination(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    sizes, hits, items = find_windows(docs, bench, **options)
    spans = hits.groupBy("row", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = spans.withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0))).withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", "covered")))
    covered = fresh.groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("row", "words").distinct().join(items, "words").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = sizes.join(covered.join(named, "row"), "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, all columns.

    A text's digest tells the rows, so that it doesn't matter whether ids are null or shared.
    """
    digest = "digest" + "_" * max(len(c) for c in docs.columns)  # longer than any name there
    found = contamination(docs.select(F.md5(F.col(text_col).cast("binary")).alias("doc_id"), F.col(text_col).alias("text")), bench, **options)
    bad = found.where("contaminated").select(F.col("doc_id").alias(digest)).distinct()
    return docs.join(bad, F.md5(docs[text_col].cast("binary")) == bad[digest], "left_anti")
