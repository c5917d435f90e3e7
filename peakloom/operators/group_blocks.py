"""Scores of every spectrum against every candidate of its group, by matrix products of blocks, reduced inside the task.

A row of the join is a pair of blocks of one group. What leaves a task is a row a candidate and block of spectra (or a
row a spectrum and block of candidates), so the pairs themselves are never shuffled. The work stays that of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECTRA, CANDIDATES, SALTS = 8192, 512, 8
NEAR = 1e-9  # products closer than this are added up anew in the order of the vector


def packed(rows: DataFrame, group: str, id_col: str, vector: str, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(grp, dim, ids, extra..., matrix): blocks of vectors of one group and length; float vectors stay float. Vectors with a
    null or a value that isn't finite have no finite score and are left out."""
    kind, dtype = ("float", np.float32) if dict(rows.dtypes)[vector] == "array<float>" else ("double", np.float64)
    x = F.col(vector).cast(f"array<{kind}>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ready = rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(group).cast("long").alias("grp"), F.size(x).alias("dim"), F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in extra], x.alias("x"))

    def block(table: pa.Table) -> pa.RecordBatch:
        flat = pa.concat_arrays([c.flatten() for c in table.column("x").chunks]).to_numpy(zero_copy_only=False).astype(dtype, copy=False)
        one = {"grp": [table["grp"][0].as_py()], "dim": [table["dim"][0].as_py()], "ids": [table["id"].to_pylist()]} | {c: [table[c].to_pylist()] for c in extra}
        return pa.RecordBatch.from_pydict(one | {"matrix": [flat.tobytes()]}, schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("grp", "dim")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if n and key != tuple(keys[:, low]):
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
                key = tuple(keys[:, low])
                while low < high:
                    take = min(high - low, size - n)
                    held.append(batch.slice(low, take))
                    low, n = low + take, n + take
                    if n == size:
                        yield block(pa.Table.from_batches(held))
                        held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    schema = pa.schema([("grp", pa.int64()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.float64())) for c in extra], ("matrix", pa.binary())])
    text = "grp long, dim int, ids array<long>, " + "".join(f"{c} array<double>, " for c in extra) + "matrix binary"
    made = ready.sortWithinPartitions("grp", "dim").mapInArrow(pack, text)
    return made.withColumn("wide", F.lit(kind == "double"))


Reduce = Callable[..., dict[str, np.ndarray]]


def pairs(spectra: DataFrame, candidates: DataFrame, reduce: Reduce, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``reduce(Q, R, spectrum ids, candidate ids, extra...)`` makes of each pair of blocks of a group, with ``grp``."""
    q = spectra.select("grp", "dim", F.col("ids").alias("q_ids"), *extra, F.col("matrix").alias("q_matrix"), F.col("wide").alias("q_wide"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    r = candidates.select("grp", "dim", F.col("ids").alias("r_ids"), F.col("matrix").alias("r_matrix"), F.col("wide").alias("r_wide"), F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int").alias("salt"))
    names = ["grp", *[x.split(" ")[0] for x in schema.split(", ")]]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                matrices = [np.frombuffer(row[f"{s}_matrix"].as_buffer(), np.float64 if row[f"{s}_wide"].as_py() else np.float32).astype(np.float64).reshape(-1, row["dim"].as_py()) for s in "qr"]
                ids = [row[f"{s}_ids"].values.to_numpy() for s in "qr"]
                out = reduce(*matrices, *ids, *[row[c].values.to_numpy(zero_copy_only=False).astype(float) for c in extra])
                n = len(out[names[1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["grp"].as_py(), np.int64)), *[pa.array(out[c]) for c in names[1:]]], names)

    return q.join(r, ["grp", "dim", "salt"]).drop("salt").mapInArrow(products, "grp long, " + schema)


def in_order(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Products of equal rows of two matrices, added up from the first value to the last as ``vectors.dot`` does."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * r[:, j]
    return total


def statistics(spectra: DataFrame, candidates: DataFrame, wanted: str = "all", temperature: float = 0.1) -> DataFrame:
    """(grp, structure, n, mean, std, low, top, top2, logsumexp) over the scores of a group's spectra, from packed blocks.

    ``wanted``: all, or the one of mean, max, top2_mean and logsumexp that is needed; other columns are null then.
    """

    def reduce(q, r, q_ids, r_ids):
        n, none = len(q), np.full(len(r), np.nan)
        out = {"structure": r_ids, "n": np.full(len(r), n, np.int64), "mean": q.sum(0) @ r.T / n, "m2": none, "low": none, "top": none, "second": none, "lse": none}
        if wanted == "mean":
            return out
        s = q @ r.T
        out["top"] = s.max(0)
        if wanted in ("all", "top2_mean") and n > 1:
            out["second"] = np.partition(s, n - 2, axis=0)[n - 2]
        if wanted == "logsumexp":
            out["lse"] = np.exp((s - out["top"]) / temperature).sum(0)
        if wanted == "all":
            out["low"] = s.min(0)
            out["m2"] = ((s - out["mean"]) ** 2).sum(0)
        return out

    parts = pairs(spectra, candidates, reduce, "structure long, n long, mean double, m2 double, low double, top double, second double, lse double")
    held = parts.groupBy("grp", "structure").agg(F.collect_list(F.struct("n", "mean", "m2", "low", "top", "second", "lse")).alias("p"))  # one a block of spectra

    def total(value: Callable[[Column], Column]) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda acc, x: acc + value(x))

    held = held.withColumn("n", total(lambda x: x["n"]).cast("long")).withColumn("mean", total(lambda x: x["n"] * x["mean"]) / F.col("n")).withColumn("top", F.array_max("p.top"))
    best = F.slice(F.sort_array(F.filter(F.concat("p.top", "p.second"), lambda v: ~F.isnan(v)), asc=False), 1, 2)
    return held.select(
        "grp", "structure", "n", "mean", "top", F.array_min("p.low").alias("low"),
        F.sqrt(total(lambda x: x["m2"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean"))) / F.col("n")).alias("std"),
        (F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v) / F.size(best)).alias("top2"),
        (F.col("top") + temperature * F.log(total(lambda x: x["lse"] * F.exp((x["top"] - F.col("top")) / temperature)))).alias("logsumexp"),
    )


def best_true(spectra: DataFrame, candidates: DataFrame, is_true: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query, best, best_id) of each spectrum's best true candidate, of equal scores that of the smaller id; spectra without one are absent."""

    def reduce(q, r, q_ids, r_ids):
        s = np.where(is_true(q_ids[:, None], r_ids[None, :]), q @ r.T, -np.inf)
        top = s.max(1)
        a, b = np.nonzero((s >= top[:, None] - NEAR) & (top > -np.inf)[:, None])
        return {"query": q_ids[a], "score": in_order(q[a], r[b]), "id": r_ids[b]}

    found = pairs(spectra, candidates, reduce, "query long, score double, id long")
    best = found.groupBy("query").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("x"))
    return best.select("query", F.col("x.score").alias("best"), (-F.col("x.minus")).alias("best_id"))


def any_candidate(q_ids: np.ndarray, r_ids: np.ndarray) -> np.ndarray:
    """For ``best_true``: each candidate counts."""
    return np.ones(np.broadcast_shapes(q_ids.shape, r_ids.shape), bool)


def best_by_residue(spectra: DataFrame, candidates: DataFrame, modulus: int) -> DataFrame:
    """(query, structure, score): each spectrum's largest score of the candidates of each residue of their ids, which has the sign of the id."""

    def reduce(q, r, q_ids, r_ids):
        s = q @ r.T
        residue = np.fmod(r_ids, modulus)
        seen = np.unique(residue)
        return {"query": np.repeat(q_ids, len(seen)), "structure": np.tile(seen, len(q_ids)), "score": np.stack([s[:, residue == x].max(1) for x in seen], axis=1).ravel()}

    return pairs(spectra, candidates, reduce, "query long, structure long, score double").groupBy("query", "structure").agg(F.max("score").alias("score"))


def sound(rows: DataFrame, group: str, vector: str) -> bool:
    """Whether all vectors are finite and those of a group of one length, so that blocks have all scores."""
    x = F.col(vector)
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    each = rows.groupBy(group).agg(F.min(fine).alias("fine"), F.min(F.size(x)).alias("low"), F.max(F.size(x)).alias("high"))
    return each.where("not fine or low <> high").isEmpty()


def places(spectra: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, rank): the place of (best, best_id) among all of the group's candidates by score, then id; null without a best.

    ``spectra`` are packed with best and best_id.
    """

    def reduce(q, r, q_ids, r_ids, best, best_id):
        d = q @ r.T - best[:, None]
        a, b = np.nonzero(np.abs(d) <= NEAR)
        exact = in_order(q[a], r[b])
        ahead = (d > NEAR).sum(1)
        ahead += np.bincount(a[(exact > best[a]) | ((exact == best[a]) & (r_ids[b] < best_id[a]))], minlength=len(q))
        return {"query": q_ids, "ahead": ahead.astype(np.int64), "known": np.isfinite(best)}

    counted = pairs(spectra, candidates, reduce, "query long, ahead long, known boolean", extra=("best", "best_id"))
    return counted.groupBy("query").agg(F.sum("ahead").alias("ahead"), F.max("known").alias("known")).select("query", F.when(F.col("known"), F.col("ahead") + 1).alias("rank"))
