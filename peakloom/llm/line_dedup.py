"""Operator 8: drop lines that many documents repeat.

Line hashes are range-partitioned with their document, sorted by hash, document (largest first) and
position, and streamed: the first document of a run keeps its lines. A hash that many documents hold
runs over several range partitions; only the first and the last run of a partition can, so those rows are
settled afterwards from one small total a hash. What comes back is a compressed keep bitmap a document.

Cases: a null or empty text is one empty line, which is never dropped; a document that holds a key several
times counts once and loses, or keeps, all its lines of that key; rows with a null id keep every line and
count nowhere; rows that share an id count as one document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, texts

MIN_CHARS = 40
MIN_DOCS = 5
STRIPPED = b" \t\n\x0b\x0c\r"
_PIECE = "settled boolean, h1 long, h2 long, doc_id long, line int, opens int"


def line_key(line: bytes) -> bytes:
    """ASCII white space off both ends, A-Z lower-cased."""
    return line.strip(STRIPPED).lower()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, line): the 128-bit hash of every key of at least ``min_chars`` code points, with its place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                for place, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars:
                        key = line_key(line)
                        if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                            digests.append(xxhash.xxh3_128_digest(key))
                            ids.append(doc)
                            places.append(place)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(places, pa.int32())], ["h1", "h2", "doc_id", "line"])

    return docs.mapInArrow(rows, "h1 long, h2 long, doc_id long, line int")


def _streamed(min_docs: int):
    """Over one sorted range partition: dropped lines of the inner runs, and every line of the first and last run."""

    def out(settled: np.ndarray, cols: list[np.ndarray], opens: np.ndarray, take: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(settled[take])] + [pa.array(c[take]) for c in cols] + [pa.array(opens[take].astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["settled", "h1", "h2", "doc_id", "line", "opens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            begins = np.flatnonzero(new)
            held = [c[begins[-1] :] for c in cols]  # this run may go on in the next batch
            if len(begins) == 1:
                continue
            done = [c[: begins[-1]] for c in cols]
            begins, new = begins[:-1], new[: begins[-1]]
            opens = new.copy()
            opens[1:] |= done[2][1:] != done[2][:-1]
            run_of = np.cumsum(new) - 1
            n_docs = np.add.reduceat(opens.astype(np.int64), begins)
            drop = (n_docs[run_of] >= min_docs) & (done[2] != done[2][begins][run_of])
            settled = np.ones(len(new), bool)
            if first:
                settled[run_of == 0] = False
                first = False
            yield out(settled, done, opens, drop | ~settled)
        if held is not None:
            opens = np.ones(len(held[0]), bool)
            opens[1:] = held[2][1:] != held[2][:-1]
            yield out(np.zeros(len(opens), bool), held, opens, np.ones(len(opens), bool))

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, line) of every line to drop. ``docs`` has doc_id and text."""
    hashes = materialize(line_hashes(docs, min_chars), "lines")  # the range bounds come from a first look at these
    ranged = hashes.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "line")
    pieces = materialize(ranged.mapInArrow(_streamed(min_docs), _PIECE), "line-runs")
    open_runs = pieces.where(~F.col("settled"))
    # Two hashes a range partition at most, of some 40 bytes each: 8 MB for 100,000 partitions. Broadcast, so that the rows
    # of one very common line, which may fill many partitions, are not brought together to be joined.
    totals = open_runs.groupBy("h1", "h2").agg(F.sum("opens").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    late = open_runs.join(F.broadcast(totals), ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    return pieces.where("settled").select("doc_id", "line").unionByName(late.select("doc_id", "line"))


def pack_keep(n_lines: int, dropped: list[int] | None) -> bytes:
    """Compressed bitmap of a document's kept lines."""
    keep = np.ones(n_lines, np.uint8)
    if dropped:
        keep[[x for x in dropped if x < n_lines]] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_keep(n_lines: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep): a zlib-compressed, bit-packed keep bitmap a document that loses lines.

    Documents that lose none are left out: all their lines stay.
    """
    base = texts(docs, id_col, text_col)
    gone = dropped_lines(base, min_chars, min_docs).groupBy("doc_id").agg(F.collect_list("line").alias("gone"))
    n_lines = base.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("n_lines")).groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, gone = (c.to_pylist() for c in batch.columns)
            lost = [{x for x in g if x < n} for n, g in zip(counts, gone, strict=True)]
            maps = [pack_keep(n, sorted(g)) for n, g in zip(counts, lost, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array([len(g) for g in lost], pa.int32()), pa.array(maps, pa.binary())], ["doc_id", "n_lines", "n_dropped", "keep"])

    return n_lines.join(gone, "doc_id").select("doc_id", "n_lines", "gone").mapInArrow(rows, "doc_id long, n_lines int, n_dropped int, keep binary")


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines, dropped lines, kept text) of one document."""
    if not text:
        return 1, 0, b""
    if keep is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    stay = np.ones(len(lines), bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].astype(bool)
    stay[: len(bits)] = bits
    return len(lines), int((~stay).sum()), b"\n".join(line for line, s in zip(lines, stay, strict=True) if s)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``docs`` with its dropped lines cut from the text; every other column stays."""
    own_id, own_keep = (name + "_" * max(len(c) for c in docs.columns) for name in ("id", "keep"))  # longer than any name there
    # written first, so that a task runs one Python worker at a time
    maps = materialize(keep_bitmaps(docs, id_col, text_col, **limits), "bitmaps").select(F.col("doc_id").alias(own_id), F.col("keep").alias(own_keep))
    joined = docs.join(maps.hint("merge"), docs[id_col] == F.col(own_id), "left").drop(own_id)
    at = joined.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, keep = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            text = [t if k is None else kept_lines(t, k)[2] for t, k in zip(whole, keep, strict=True)]
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(text, pa.binary()).cast(batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(rows, docs.schema)


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every document."""
    base = texts(docs)
    joined = base.join(materialize(keep_bitmaps(base), "bitmaps").select("doc_id", "keep").hint("merge"), "doc_id", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_lines(t, k) for t, k in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
