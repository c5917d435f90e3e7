"""Operator 7: remove repeated 100-byte strings, by merging shards' Burrows-Wheeler order level by level.

A 100-byte window can only repeat where an anchor inside it repeats: the window's least rolling hash of 24
bytes (leftmost if equal) depends on the window alone, so equal windows name equal anchors at equal places.
The windows that share one anchor occurrence are neighbours; with the bytes they cover they are its context.

1. Each task finds its documents' contexts. Of equal contexts in a block only the earliest goes on; in all
   others every window is a repeat (pre-aggregation, so a passage of many documents is shuffled once a block).
2. Contexts are range-partitioned and sorted by anchor, content, document and place, so an anchor that many
   documents hold runs over several tasks, and streamed, a batch at a time: of equal contexts, again, all but
   the earliest are repeats. An anchor with one context is settled; most anchors occur once and end here. What
   a partition's ends leave open, its first and last content, is settled from these two rows a partition.
3. Anchors with several contexts are the shards to merge. Their suffixes from the anchor on are sorted once,
   with common prefix lengths. Then the order is refined a byte at a time: suffixes that start one byte
   further left follow from the present order by a stable distribution over the preceding byte (the
   Burrows-Wheeler symbol), which interleaves the shards without sorting any suffix again. At each level a run
   of equal left bytes whose common prefixes reach the window's end is a repeated interval: all its windows
   but the earliest are repeats.
   No task gathers an anchor with more than HOT different contexts: those are the edges of very common passages,
   where the neighbours differ. Their windows are parted by how many bytes lie before the anchor (their level):
   all windows of a range of levels cover the same bytes around it, which become the longer anchor of a narrower
   context. Narrower contexts go through steps 2 and 3 again, in ranges of 20 levels, of 5 and at last of one,
   where the anchor is the window and step 2 settles all.
4. Each document's windows are joined to its text, and the bytes they cover are removed.

Cases: null, empty and shorter texts have no window; overlapping repeats (also of a document with itself)
count, judged on the input; rows with a null id take no part and lose nothing; ids are taken as unique: rows
that share one are cut by their united spans, within their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import blocks, flat, mixed, powers
from .shared import materialize, texts

LENGTH = 100
ANCHOR = 24
GRAMS = LENGTH - ANCHOR + 1  # anchors to choose from in a window
AFTER = LENGTH - ANCHOR  # bytes of a window outside its anchor
CHUNK = 40_000  # contexts merged at once
BLOCK = 2 << 20  # bytes of text in which a task looks for equal contexts
HOT = 2000  # different contexts of one anchor that a task merges; of more the anchor grows
LEVELS = (20, 5, 1)  # levels of a narrower context, each a multiple of the next

_rng = np.random.Generator(np.random.PCG64(77))
_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0xD1342543DE82EF95)
_R_INVERSE = np.uint64(pow(int(_R), -1, 2**64))
_PLACE = np.uint64(0xFFFFFFFF)


def rolling(body: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on, by doubling."""
    h, width = _MIX[body], 1
    by_width = {1: h}
    while width * 2 <= ANCHOR:
        h = h[:-width] * _C[width.bit_length() % 8] + h[width:]
        width *= 2
        by_width[width] = h
    n = len(body) - ANCHOR + 1
    out, done = by_width[width][:n].copy(), width
    for w in sorted(by_width, reverse=True):
        while done + w <= ANCHOR:
            out = out * _C[(w.bit_length() + 3) % 8] + by_width[w][done : done + n]
            done += w
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, span = x, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - span : width - span + len(x) - width + 1])


def contexts(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, context hash, first window, number of windows, anchor minus first window), places in ``body``."""
    n = len(body) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hashes = rolling(body)
    least = sliding_min(hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), GRAMS)
    anchor = (least & _PLACE).astype(np.int64)
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    ends = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])  # after a document's last window
    begin = np.unique(np.concatenate([[0], cuts, offsets[:-1], ends]))
    begin = begin[begin < n]
    until = np.append(begin[1:], n)
    row = np.searchsorted(offsets, begin, "right") - 1
    inside = begin + LENGTH <= offsets[row + 1]
    row, begin, until = row[inside], begin[inside], until[inside]
    at = anchor[begin]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX2[body] * powers(len(body), _R))])
    content = (sums[until + LENGTH - 1] - sums[begin]) * powers(len(body), _R_INVERSE)[begin]
    content = mixed(content + (until - begin).astype(np.uint64) * _C[0] + (at - begin).astype(np.uint64) * _C[1])
    return row, hashes[at], content, begin, until - begin, at - begin


_CONTEXT = "anchor long, content long, doc_id long, first int, windows int, lead int, repeat boolean"


def document_contexts(docs: DataFrame) -> DataFrame:
    """Every document's contexts; ``repeat`` marks those that an earlier equal one in the same block settles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for start, end, body, offsets in blocks(batch.column(1), BLOCK):
                row, anchor, content, first, windows, lead = contexts(body, offsets)
                doc, first = ids[start:end][row], first - offsets[row]
                order = np.lexsort((first, doc, anchor, content))
                row, anchor, content, first, windows, lead, doc = (x[order] for x in (row, anchor, content, first, windows, lead, doc))
                repeat = np.zeros(len(row), bool)
                repeat[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(repeat)], ["anchor", "content", "doc_id", "first", "windows", "lead", "repeat"])

    return docs.mapInArrow(rows, _CONTEXT)


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 0) -> Iterator[list[np.ndarray | pa.Array]]:
    """The sorted batches' columns again, cut where the first column changes, and of at least ``rows`` rows."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size <= rows or not batch.num_rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
        size = table.num_rows - cut
    if size:
        yield pa.concat_tables(held).combine_chunks()


_PLACED = ["anchor", "content", "doc_id", "first", "windows", "lead"]
_PIECE = "anchor long, content long, doc_id long, first int, windows int, lead int, bytes binary, repeat boolean, several boolean, edge boolean"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's contexts, sorted by anchor, content, document and place: repeats, and the earliest of each
    content where its anchor has ``several``. The partition's first and last content come as ``edge`` in any case,
    as the partitions beside it may go on with them. Repeats need their bytes no more.
    """

    def out(rows: pa.RecordBatch, repeat: bool, several: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        marks = [pa.array(np.full(rows.num_rows, repeat)), pa.array(several), pa.array(edge)]
        return pa.RecordBatch.from_arrays([*rows.columns, *marks], [*rows.schema.names, "repeat", "several", "edge"])

    def repeats(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = np.zeros(rows.num_rows, bool)
        return out(rows.set_column(len(_PLACED), "bytes", pa.nulls(rows.num_rows, pa.binary())), True, none, none)

    held, held_several, first = None, False, True  # the last content's earliest row
    for batch in batches:
        again = batch.column(batch.schema.get_field_index("repeat"))
        batch = batch.select([*_PLACED, "bytes"])
        yield repeats(batch.filter(again))
        rows = batch.filter(pc.invert(again))
        if not rows.num_rows:
            continue
        anchor, content = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        if held is not None:
            new[0] = anchor[0] != held.column(0)[0].as_py() or content[0] != held.column(1)[0].as_py()
        yield repeats(rows.filter(pa.array(~new)))
        rows = rows.filter(pa.array(new))
        if held is not None:
            rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
        if not rows.num_rows:
            continue
        same = np.diff(rows.column(0).to_numpy()) == 0
        several = np.concatenate((same, [False])) | np.concatenate(([held_several], same))
        edge = np.zeros(len(several), bool)
        edge[0] = first
        keep = (several | edge)[:-1]
        done = rows.slice(0, len(several) - 1)
        yield out(done.filter(pa.array(keep)), False, several[:-1][keep], edge[:-1][keep])
        first &= len(several) == 1
        held, held_several = rows.slice(len(several) - 1), bool(several[-1])
    if held is not None:
        yield out(held, False, np.array([held_several]), np.array([True]))


def settled_contexts(found: DataFrame) -> DataFrame:
    """(anchor, doc_id, first, windows, lead, bytes, repeat): all repeats, and the earliest of each content of anchors with several.

    ``bytes`` are those of ``found``, if it has them.
    """
    found = materialize(found, "found-contexts")  # the range bounds come from a first look at these
    if "bytes" not in found.columns:
        found = found.withColumn("bytes", F.lit(None).cast("binary"))
    # what a task has settled itself is dealt out by its place, so that a common passage doesn't meet in one partition
    deal = F.when(F.col("repeat"), F.xxhash64("doc_id", "first")).otherwise(F.col("anchor"))
    order = ["anchor", "content", "doc_id", "first"]
    ranged = found.withColumn("anchor", deal).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = materialize(ranged.mapInArrow(_settled, _PIECE), "contexts")
    # two rows a partition at most
    place, by_anchor, by_content = F.struct("doc_id", "first"), Window.partitionBy("anchor"), Window.partitionBy("anchor", "content")
    several = F.max("several").over(by_anchor) | (F.min("content").over(by_anchor) < F.max("content").over(by_anchor))
    edges = pieces.where("edge").select("anchor", "doc_id", "first", "windows", "lead", "bytes", (place > F.min(place).over(by_content)).alias("repeat"), several.alias("several"))
    settled = pieces.where("not edge").select("anchor", "doc_id", "first", "windows", "lead", "bytes", "repeat", "several").unionByName(edges)
    return settled.where("repeat or several").drop("several")


def merge_contexts(group: np.ndarray, data: np.ndarray, starts: np.ndarray, windows: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which windows of the contexts (rows) repeat an earlier one of their group: rows x GRAMS, column = window.

    Rows come by group and, inside, by document and place. ``data`` has the contexts' bytes, from ``starts`` on.
    """
    n = len(group)
    found = np.zeros((n, GRAMS), bool)
    right = np.zeros((n, (AFTER + 7) // 8 * 8), np.uint8)
    size = windows - 1 + LENGTH - lead - ANCHOR  # bytes after the anchor
    for j in range(AFTER):
        has = np.flatnonzero(size > j)
        right[has, j] = data[starts[has] + lead[has] + ANCHOR + j]
    order = np.lexsort((*right.view(">u8").T[::-1], group))
    same = np.concatenate([right[order[1:], :AFTER] == right[order[:-1], :AFTER], np.zeros((max(n - 1, 0), 1), bool)], axis=1)
    common = np.where(group[order[1:]] == group[order[:-1]], same.argmin(axis=1), -1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    left = group[order].astype(np.int64)  # class of equal left bytes, along ``order``
    for level in range(GRAMS):
        block = np.concatenate(([0], np.cumsum(common < AFTER - level)))
        live = lead[order] - windows[order] < level
        own, side, reach = order[live], left[live], block[place[order[live]]]
        if len(own):
            begins = np.flatnonzero(np.concatenate(([True], (side[1:] != side[:-1]) | (reach[1:] != reach[:-1]))))
            earliest = np.repeat(np.minimum.reduceat(own, begins), np.diff(np.append(begins, len(own))))
            late = own[own > earliest]
            found[late, lead[late] - level] = True
        stay = lead[order] > level
        order, left = order[stay], left[stay]
        if not len(order):
            break
        symbol = data[starts[order] + lead[order] - level - 1]
        key = left * 256 + symbol
        step = np.argsort(key, kind="stable")
        order, key = order[step], key[step]
        left = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    return found


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, first, windows): the runs of repeated windows in contexts sorted by anchor, document and place."""
    for table in _runs(batches, CHUNK):
        anchor, doc, first, windows, lead = (table.column(c).to_numpy() for c in ("anchor", "doc_id", "first", "windows", "lead"))
        data, offsets = flat(table.column("bytes"))
        group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
        found = merge_contexts(group, data, offsets[:-1], windows.astype(np.int64), lead.astype(np.int64))
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((first[row] + begin).astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["doc_id", "first", "windows"])


def narrowed(shards: DataFrame, levels: int) -> DataFrame:
    """The shards' contexts parted into contexts of ``levels`` levels, under longer anchors, with their bytes.

    A window at level l has l bytes before the anchor and AFTER - l behind it. Those of a range of levels all have
    as many bytes before as its first level and as many behind as its last: with the anchor, these are the new one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, first, windows, lead, piece in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "windows", "lead", "bytes")), strict=True):
                for low in range((lead - windows + 1) // levels * levels, lead + 1, levels):
                    high = min(low + levels, GRAMS) - 1
                    begin, end = max(lead - high, 0), min(lead - low, windows - 1)
                    anchor = xxhash.xxh3_64_intdigest(piece[lead - low : lead + LENGTH - high], seed=low)
                    own = piece[begin : end + LENGTH]
                    content = xxhash.xxh3_64_intdigest(own, seed=GRAMS + lead - begin)
                    row = (anchor - 2**63, content - 2**63, doc, first + begin, end - begin + 1, lead - begin, own if levels > 1 else None, False)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [*_PLACED, "bytes", "repeat"])

    return shards.mapInArrow(rows, "anchor long, content long, doc_id long, first int, windows int, lead int, bytes binary, repeat boolean")


def with_bytes(earliest: DataFrame, base: DataFrame) -> DataFrame:
    """The contexts with the bytes that their windows cover, from their documents."""
    own = earliest.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "windows", "lead")).alias("own"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc_id", "first", "windows", "lead", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for c in own:
                    piece = text[c["first"] : c["first"] + c["windows"] + LENGTH - 1] if text else b""
                    if len(piece) == c["windows"] + LENGTH - 1:
                        for column, value in zip(out, (c["anchor"], doc, c["first"], c["windows"], c["lead"], piece), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return base.join(own, "doc_id").select("doc_id", "text", "own").mapInArrow(cut, "anchor long, doc_id long, first int, windows int, lead int, bytes binary")


def merged(shards: DataFrame) -> DataFrame:
    """(doc_id, first, windows) of the repeated windows of anchors that a task each may hold."""
    return shards.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "first").mapInArrow(_merged, "doc_id long, first int, windows int")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, first, windows): runs of windows that an earlier place holds too, as first byte and number; they may overlap."""
    base = texts(docs, id_col, text_col).where("doc_id is not null")
    pieces = settled_contexts(document_contexts(base))
    runs = pieces.where("repeat").select("doc_id", "first", "windows")
    shards = earliest = pieces.where("not repeat")
    for levels in (0, *LEVELS):
        if levels:  # the contexts of hot anchors, narrower
            pieces = settled_contexts(narrowed(shards, levels))
            runs = runs.unionByName(pieces.where("repeat").select("doc_id", "first", "windows"))
            shards = earliest = pieces.where("not repeat")
        if levels == 1:  # a window is its own anchor, so none has several contents
            break
        large = materialize(earliest.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "hot-anchors")
        if not levels:
            shards = with_bytes(earliest, base)
        if large.isEmpty():
            return runs.unionByName(merged(shards))
        shards = materialize(shards, "shards")  # read twice
        runs = runs.unionByName(merged(shards.join(large, "anchor", "left_anti")))
        shards = shards.join(large, "anchor", "left_semi")
    return runs


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(what is left, number of maximal removed runs) without the union of ``spans`` (start, end)."""
    kept, runs, until = [], 0, -1
    at = 0
    for start, end in sorted(spans):
        start, end = min(start, len(text)), min(end, len(text))
        if start >= end:
            continue
        if start > until:
            kept.append(text[at:start])
            runs += 1
        until = max(until, end)
        at = until
    kept.append(text[at:])
    return b"".join(kept), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept = the remaining bytes."""
    base = texts(docs, id_col, text_col)
    spans = repeated_windows(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("windows").alias("windows"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for text, first, windows in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), batch.column(3), strict=True):
                text = text or b""
                left, n = text, 0
                if first.is_valid:
                    start = first.values.to_numpy()
                    left, n = cut_spans(text, list(zip(start.tolist(), (start + windows.values.to_numpy() + LENGTH - 1).tolist(), strict=True)))
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                runs.append(n)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return base.join(spans, "doc_id", "left").select("doc_id", "text", "first", "windows").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
