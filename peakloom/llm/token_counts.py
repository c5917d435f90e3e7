"""Operator 1: token counts of a document's fields or sections, from one encoding of the whole document.

Each text is encoded once by a byte-level BPE; token byte lengths, mapped to characters, give every token's span
of code points (of the first and last character that it has a byte of). Fields are spans too: given ones, such as
those of ``joined_fields``, or the sections between line feeds, each with its line feed. The interval join of
both, a binary search a document, gives each token the fields it lies in. A token that crosses a field's end
goes to one field by the rule: ``first`` (that of its first character in a field), ``last`` (of its last one) or
``most`` (that with most of its characters, the earlier one if equal). Sections cover a text, so their counts
add up to the document's; between given fields tokens may lie in none.

Cases: a null or empty text is one empty section without tokens; an empty section (a bare line feed) has
what its own character gets; ids may be null or repeated, each row is counted alone; given spans are taken in
order of start, cut to the text and to what an earlier span has left, and may be empty or null; other columns,
however named, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

RULES = ("first", "last", "most")


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken vocabulary: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def load_encoding(vocabulary: str, pattern: str):
    """(encoding, byte length of each token), read once in a worker's life."""
    import tiktoken

    ranks = load_ranks(vocabulary)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def characters(body: np.ndarray) -> np.ndarray:
    """The number of the code point that each byte belongs to."""
    return np.cumsum((body & 0xC0) != 0x80) - 1


def token_spans(lengths: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of tokens of so many bytes."""
    ends = np.cumsum(lengths)
    of_byte = characters(body)
    return of_byte[ends - lengths], of_byte[ends - 1] + 1


def section_spans(body: np.ndarray, separator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of the sections: cut after every separator but one at the text's end."""
    if not len(body):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    of_byte = characters(body)
    cuts = np.flatnonzero(body[:-1] == separator[0]) + 1
    starts = np.concatenate(([0], of_byte[cuts]))
    return starts, np.append(starts[1:], of_byte[-1] + 1)


def given_spans(spans: list[dict] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of given spans: in order, inside a text of ``size`` characters, and apart."""
    found = sorted((s["start"] or 0, s["end"] or 0) for s in spans or [] if s)
    starts, ends = np.array(found, np.int64).reshape(-1, 2).clip(0, size).T
    starts = np.maximum(starts, np.maximum.accumulate(np.concatenate(([0], ends)))[:-1])
    return starts, np.maximum(starts, ends)


def attribute(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """The span (in order, apart) of each token, -1 outside all, and whether the token lies in more than one."""
    full = np.flatnonzero(ends > starts)
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not len(full):
        return np.full(len(token_starts), -1), np.zeros(len(token_starts), bool)
    starts, ends = starts[full], ends[full]
    first = np.searchsorted(ends, token_starts, "right")
    last = np.searchsorted(starts, token_ends, "left") - 1
    crosses = last > first
    chosen = last.copy() if rule == "last" else first.copy()
    for i in np.flatnonzero(crosses) if rule == "most" else []:
        span = np.arange(first[i], last[i] + 1)
        chosen[i] = span[np.argmax(np.minimum(ends[span], token_ends[i]) - np.maximum(starts[span], token_starts[i]))]
    return np.where(last >= first, full[np.clip(chosen, 0, len(full) - 1)], -1), crosses


def joined_fields(df: DataFrame, fields: list[str], id_col: str = "doc_id", separator: str = "\n") -> DataFrame:
    """(doc_id, text, spans): text columns as one document, and where each stands in it; a null field is empty."""
    values = [F.coalesce(F.col(c), F.lit("")) for c in fields]
    spans, at = [], F.lit(0)
    for value in values:
        spans.append(F.struct(at.alias("start"), (at + F.char_length(value)).alias("end")))
        at = at + F.char_length(value) + len(separator)
    return df.select(F.col(id_col).alias("doc_id"), F.concat_ws(separator, *values).alias("text"), F.array(*spans).alias("spans"))


def section_tokens(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_crossing, sections): sections = array of (start, end, n_tokens), in code points of the text.

    ``spans_col`` names a column of given spans, array<struct<start, end>>; without it the lines are the sections.
    ``vocabulary`` is the path of a .tiktoken file that every executor has; ``pattern`` its split pattern.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = load_encoding(vocabulary, pattern)
        for batch in batches:
            n_tokens, n_crossing, sizes, spans = [], [], [0], ([], [], [])
            given = batch.column(2).to_pylist() if spans_col else [None] * batch.num_rows
            for text, own in zip(batch.column(1).to_pylist(), given, strict=True):
                text = text or ""
                body = np.frombuffer(text.encode("utf-8"), np.uint8)
                ids = encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
                starts, ends = given_spans(own, len(text)) if spans_col else section_spans(body)
                chosen, crosses = attribute(*token_spans(lengths[ids], body), starts, ends, rule)
                n_tokens.append(len(ids))
                n_crossing.append(int(crosses.sum()))
                sizes.append(len(starts))
                for column, values in zip(spans, (starts, ends, np.bincount(chosen[chosen >= 0], minlength=len(starts))), strict=True):
                    column.append(values.astype(np.int64))
            flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in spans]
            sections = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(flat, ["start", "end", "n_tokens"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_crossing, pa.int64()), sections], ["doc_id", "n_tokens", "n_crossing", "sections"])

    base = texts(docs, id_col, text_col)
    if spans_col:
        base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(spans_col).alias("spans"))
    return base.mapInArrow(rows, "doc_id long, n_tokens long, n_crossing long, sections array<struct<start: long, end: long, n_tokens: long>>")


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "first") -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_tokens): the sections' counts in order, comma-joined."""
    counted = section_tokens(docs, vocabulary, pattern, rule)
    return counted.select("doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), "n_crossing", F.array_join(F.col("sections.n_tokens").cast("array<string>"), ",").alias("section_tokens"))
