"""Sparse scores of stated queries against all references, reduced in the task that holds a part of the references.

References are cut in parts, every query goes to each part, packed in blocks. A task keeps its part's postings by bin, makes the scores of a block's
queries from the lists of their bins, and what ``reduce`` makes of them leaves it. The pairs themselves, whose number grows with the square
of the table, are no row of any shuffle. All pairs that share a bin are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSTINGS = 2_000_000  # postings of a part, about
QUERIES = 4_096  # queries of a block, about
TRIPLES = 4_000_000  # products that are made at once


def packed(bins: DataFrame, spectrum: str = "spectrum_id") -> DataFrame:
    """(id, bins, values): a spectrum's bins over its norm in one row; one of norm 0 has none."""
    lists = bins.groupBy(F.col(spectrum).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("p"))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p["v"] * p["v"]))
    return lists.withColumn("norm", norm).where("norm > 0").select("id", F.col("p.bin").cast("array<int>").alias("bins"), F.transform("p.v", lambda v: v / F.col("norm")).alias("vals"))


Reduce = Callable[["Part", np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def reduced(queries: DataFrame, references: DataFrame, reduce: Reduce, schema: str, parts: int, own: bool = False) -> DataFrame:
    """``reduce(part, ids, groups, query, reference, score)`` of every part and some queries: query and reference are places of a pair.

    ``queries``: (grp, id, bins, vals); those of one grp come together. ``references``: (id, label, part, bins, vals), part below ``parts``.
    Pairs of equal ids are left out unless ``own``.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // QUERIES))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    block = F.pmod(F.xxhash64("grp"), F.lit(blocks)).cast("int")
    held = queries.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("grp", "id", "bins", "vals"))).alias("q"))
    asked = held.select(F.lit(1).alias("side"), F.col("q.grp").alias("grps"), F.col("q.id").alias("ids"), F.transform("q", lambda x: F.size(x["bins"])).alias("sizes"), F.flatten("q.bins").alias("bins"), F.flatten("q.vals").alias("vals"))
    asked = asked.select("*", every)
    there = references.select(F.lit(0).alias("side"), "id", F.col("label").cast("long").alias("label"), "bins", "vals", F.col("part").cast("int").alias("part"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    dealt = there.unionByName(asked, allowMissingColumns=True).repartition(n, "part").sortWithinPartitions("part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, part = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "side")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if key != keys[0, low]:
                    key, rows, part = keys[0, low], [], None
                if keys[1, low] == 0:
                    rows.append(batch.slice(low, high - low).select(["id", "label", "bins", "vals"]))
                    continue
                if part is None:
                    if not rows:
                        continue  # a part without a reference
                    part, rows = Part(rows), []
                for i in range(low, high):
                    ids, grps, sizes, bins, vals = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "grps", "sizes", "bins", "vals"))
                    for at, query, reference, score in part.pairs(ids, grps, sizes, bins, vals, own):
                        if len(query):
                            yield reduce(part, ids[at], grps[at], query, reference, score)

    return dealt.mapInArrow(run, schema)


class Part:
    """Postings of a part by bin; ``code`` is the place of a reference's label among ``labels``."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        self.ids = table["id"].to_numpy()
        self.labels, self.code = np.unique(table["label"].to_numpy(), return_inverse=True)
        bins, vals = (pa.concat_arrays([c.flatten() for c in table[x].chunks]).to_numpy(zero_copy_only=False) for x in ("bins", "vals"))
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table["bins"].chunks])
        order = np.argsort(bins, kind="stable")
        self.bins, self.vals = bins[order], vals[order]
        self.reference = np.repeat(np.arange(len(self.ids), dtype=np.int32), sizes)[order]

    def pairs(self, ids, grps, sizes, bins, vals, own: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, query, reference, score) of some queries at a time, whole groups, ordered by query and reference."""
        low, high = np.searchsorted(self.bins, bins, "left"), np.searchsorted(self.bins, bins, "right")
        ends = np.cumsum(sizes)
        made = np.concatenate(([0], np.cumsum(high - low)))[ends]  # products up to the end of each query
        last = np.flatnonzero(np.append(grps[1:] != grps[:-1], True))  # the last query of each group
        start = done = 0
        while start < len(ids):
            ready = last[(made[last] - done <= TRIPLES) & (last >= start)]
            stop = (int(ready[-1]) if len(ready) else int(last[last >= start][0])) + 1
            at = slice(start, stop)
            rows = slice(ends[start - 1] if start else 0, ends[stop - 1])
            yield at, *self._summed(ids[at], sizes[at], vals[rows], low[rows], high[rows] - low[rows], own)
            start, done = stop, made[stop - 1]

    def _summed(self, ids, sizes, vals, low, n, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = int(n.sum())
        flat = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
        key = np.repeat(np.repeat(np.arange(len(ids)), sizes) * len(self.ids), n) + self.reference[flat]
        product = np.repeat(vals, n) * self.vals[flat]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if total else np.zeros(0, np.int64)
        score = np.add.reduceat(product[order], first) if total else np.zeros(0)
        query, reference = np.divmod(key[first], len(self.ids))
        if not own:
            kept = ids[query] != self.ids[reference]
            query, reference, score = query[kept], reference[kept], score[kept]
        return query, reference, score


def _lists(owner: np.ndarray, size: int, columns: dict[str, pa.Array]) -> pa.ListArray:
    """Lists of structs for owners 0, ..., size - 1; ``owner`` is not falling."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=size)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


LABELLED = "query long, entries array<struct<structure:long,score:double>>"


def best_by_label(part: Part, ids, grps, query, reference, score) -> pa.RecordBatch:
    """A row a query: its largest score of each label of the part, of those with a positive one."""
    labels = len(part.labels)
    best = np.zeros(len(ids) * labels)
    np.maximum.at(best, query * labels + part.code[reference], score)
    at = np.flatnonzero(best > 0)
    entries = _lists(at // labels, len(ids), {"structure": pa.array(part.labels[at % labels]), "score": pa.array(best[at])})
    return pa.RecordBatch.from_arrays([pa.array(ids), entries], ["query", "entries"])


GROUPED = "grp long, entries array<struct<structure:long,mean:double,max:double,single:double>>"


def grouped_by_label(part: Part, ids, grps, query, reference, score) -> pa.RecordBatch:
    """A row a group: of each label the largest, over its references, of the mean, of the largest and of the first query's score. Queries are ordered by group and id."""
    groups, own = np.unique(grps, return_inverse=True)
    first = np.concatenate(([True], grps[1:] != grps[:-1]))
    key = own[query] * len(part.ids) + reference
    order = np.argsort(key, kind="stable")
    key, score, single = key[order], score[order], np.where(first[query], score, -np.inf)[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(starts, len(key)))
    each = {"mean": np.add.reduceat(score, starts) / count, "max": np.maximum.reduceat(score, starts), "single": np.maximum.reduceat(single, starts)}
    g, r = np.divmod(key[starts], len(part.ids))
    labels = len(part.labels)
    best = {c: np.full(len(groups) * labels, -np.inf) for c in each}
    for c, x in each.items():
        np.maximum.at(best[c], g * labels + part.code[r], x)
    at = np.flatnonzero(best["max"] > -np.inf)
    columns = {"structure": pa.array(part.labels[at % labels])} | {c: pa.array(x[at], mask=x[at] == -np.inf) for c, x in best.items()}
    return pa.RecordBatch.from_arrays([pa.array(groups), _lists(at // labels, len(groups), columns)], ["grp", "entries"])


NEAREST = "query long, entries array<struct<reference:long,score:double>>"


def nearest(k: int, digits: int = 9) -> Reduce:
    """A row a query: its k references of largest score, of equal ones (to ``digits``) the smaller."""

    def reduce(part: Part, ids, grps, query, reference, score) -> pa.RecordBatch:
        seen = np.round(score, digits)
        starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        least = np.zeros(len(ids))
        for low, high in zip(starts, np.append(starts[1:], len(query)), strict=True):
            if high - low > k:
                least[query[low]] = np.partition(seen[low:high], high - low - k)[high - low - k]
        kept = np.flatnonzero(seen >= least[query])
        kept = kept[np.lexsort((part.ids[reference[kept]], -seen[kept], query[kept]))]
        q = query[kept]
        kept = kept[np.arange(len(q)) - np.searchsorted(q, q) < k]
        entries = _lists(query[kept], len(ids), {"reference": pa.array(part.ids[reference[kept]]), "score": pa.array(score[kept])})
        return pa.RecordBatch.from_arrays([pa.array(ids), entries], ["query", "entries"])

    return reduce


def merged(found: DataFrame, key: str, scores: list[str], whole: bool) -> DataFrame:
    """(key, entries) of all parts, a structure once; ``whole``: a structure's references lie in one part, so there is nothing to merge."""
    if not whole:
        each = found.select(key, F.inline("entries")).groupBy(key, "structure").agg(*[F.max(c).alias(c) for c in scores])
        return each.groupBy(key).agg(F.collect_list(F.struct("structure", *scores)).alias("entries"))
    return found.groupBy(key).agg(F.flatten(F.collect_list("entries")).alias("entries"))
