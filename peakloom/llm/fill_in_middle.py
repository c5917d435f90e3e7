"""Operator 12: fill-in-the-middle texts by displacement, and their restoration.

Two cuts, from a hash of the document's id, fall on token ends and give a prefix, a middle and a suffix. Moving the
pieces is a displacement: at the start of each piece a difference array holds by how much its place in the output
differs from that of the piece before, its running sum is every byte's shift, and one scatter a batch writes all
outputs. Restoration finds the three marks of an output and gathers the bytes back by the inverse shifts. A
batch is worked on in runs of about a megabyte of text and shifts are made a slice at a time, so that the work
arrays stay small; for one long text memory is some eight times the text.

A token is white space and the word after it, or white space at the end. Cuts and forms follow the hash alone, so any
executor gives the same output. A text that holds a mark stays plain, as its output could not be told apart.

Cases: a null text is an empty one, and plain; a text without words has one token, its white space; a null id hashes
as an empty one; rows that share an id have equal hashes and are cut alone; other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import NOT_SPACE, SPACES, blocks, word_spans
from .shared import texts

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
SLICE = 1 << 20
_MARKS = {name: np.frombuffer(name.encode(), np.uint8) for name in (PREFIX, SUFFIX, MIDDLE)}


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def token_cuts(body: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each row, and the places of its two cuts in ``body``."""
    _, ends, at = word_spans(body, offsets, NOT_SPACE)
    words, full = np.diff(at), np.diff(offsets) > 0
    tail = np.zeros(len(words), bool)
    tail[full] = SPACES[body[offsets[1:][full] - 1]]
    n = words + tail
    padded = np.append(ends, 0)

    def place(k: np.ndarray) -> np.ndarray:
        inner = padded[np.where((k > 0) & (k <= words), at[:-1] + k - 1, len(ends))]
        return np.where(k == 0, offsets[:-1], np.where(k > words, offsets[1:], inner))

    x, y = h1 % (n + 1), h2 % (n + 1)
    return n, place(np.minimum(x, y)), place(np.maximum(x, y))


def shifts(starts: np.ndarray, moves: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, shift of each place) for slices of ``size`` places; piece i begins at ``starts[i]``, in order, and moves
    by ``moves[i]``. Empty pieces begin where the next does; their differences add up."""
    steps = np.diff(moves, prepend=0)
    carried = 0
    for begin in range(0, size, SLICE):
        end = min(begin + SLICE, size)
        lo, hi = np.searchsorted(starts, (begin, end))
        difference = np.zeros(end - begin, np.int64)
        np.add.at(difference, starts[lo:hi] - begin, steps[lo:hi])
        shift = np.cumsum(difference) + carried
        carried = int(shift[-1])
        yield begin, end, shift


def _pieces(form: np.ndarray, out: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where prefix, middle and suffix begin in the output, a row each, and where the marks of its row stand."""
    marked = 3 * (form != PLAIN)
    spm = form == SPM
    first = np.where(spm, suffix, prefix)  # bytes between the first mark and the second
    second = np.where(spm, prefix, suffix)
    at2, at3 = out + marked + first, out + 2 * marked + first + second
    begin = np.stack([np.where(spm, at2, out) + marked, at3 + marked, np.where(spm, out, at2) + marked], 1)
    plain = form == PLAIN
    begin[plain] = (out[:, None] + np.stack([np.zeros_like(prefix), prefix, prefix + middle], 1))[plain]
    return begin, {PREFIX: np.where(spm, at2, out), SUFFIX: np.where(spm, out, at2), MIDDLE: at3}


def displaced(body: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs."""
    start, stop = offsets[:-1], offsets[1:]
    out_offsets = np.concatenate(([0], np.cumsum(stop - start + 9 * (form != PLAIN))))
    begin, marks = _pieces(form, out_offsets[:-1], a - start, b - a, stop - b)
    out = np.empty(out_offsets[-1], np.uint8)
    pieces = np.stack([start, a, b], 1)
    for lo, hi, shift in shifts(pieces.ravel(), (begin - pieces).ravel(), len(body)):
        out[np.arange(lo, hi) + shift] = body[lo:hi]
    moved = form != PLAIN
    for name, at in marks.items():
        for i, byte in enumerate(_MARKS[name]):
            out[at[moved] + i] = byte
    return out, out_offsets


def gathered(out: np.ndarray, out_offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that the outputs were made from."""
    start, stop = out_offsets[:-1], out_offsets[1:]
    offsets = np.concatenate(([0], np.cumsum(stop - start - 9 * (form != PLAIN))))
    open_at = np.flatnonzero(out[:-2] == ord("<")) if len(out) > 2 else np.zeros(0, np.int64)
    open_at = open_at[out[open_at + 2] == ord(">")]
    kind = out[open_at + 1]
    row = np.searchsorted(stop, open_at, "right")
    real = (form[row] != PLAIN) & (open_at + 3 <= stop[row])
    places = {}
    for name in (PREFIX, SUFFIX, MIDDLE):
        own = real & (kind == ord(name[1]))
        places[name] = np.zeros(len(form), np.int64)
        places[name][row[own]] = open_at[own]  # a row that isn't plain has each mark once
    spm = form == SPM
    prefix = np.where(spm, places[MIDDLE], places[SUFFIX]) - places[PREFIX] - 3
    middle = stop - places[MIDDLE] - 3
    plain = form == PLAIN
    prefix[plain], middle[plain] = (stop - start)[plain], 0
    suffix = np.diff(offsets) - prefix - middle
    begin, _ = _pieces(form, start, prefix, middle, suffix)
    pieces = np.stack([offsets[:-1], offsets[:-1] + prefix, offsets[:-1] + prefix + middle], 1)
    body = np.empty(offsets[-1], np.uint8)
    for lo, hi, shift in shifts(pieces.ravel(), (begin - pieces).ravel(), len(body)):
        body[lo:hi] = out[np.arange(lo, hi) + shift]
    return body, offsets


def _strings(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))


def _chars(body: np.ndarray, begin: int, end: int) -> int:
    return int(np.count_nonzero((body[begin:end] & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row a document."""
    h1, h2, h3, h4 = hashes(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    held = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when(held | (h3 % 100 >= fim_percent), PLAIN).when(h4 % 100 < spm_percent, SPM).otherwise(PSM)
    ready = texts(docs).select("doc_id", text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, form = (batch.column(c).to_numpy() for c in ("h1", "h2", "form"))
            for first, end, body, offsets in blocks(batch.column("text")):
                n, a, b = token_cuts(body, offsets, h1[first:end], h2[first:end])
                f = form[first:end]
                out, out_offsets = displaced(body, offsets, np.where(f == PLAIN, offsets[1:], a), np.where(f == PLAIN, offsets[1:], b), f)
                prefix = [None if k == PLAIN else _chars(body, s, x) for k, s, x in zip(f, offsets[:-1], a, strict=True)]
                middle = [None if k == PLAIN else _chars(body, x, y) for k, x, y in zip(f, a, b, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:end], pa.array(n.astype(np.int64)), pa.array([FORMS[k] for k in f], pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(out, out_offsets)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return ready.mapInArrow(rows, f"doc_id {dict(ready.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """``made`` with the column ``restored``, from its columns form and output alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = np.array([FORMS.index(x) for x in batch.column("form").to_pylist()], np.int64)
            for first, end, out, out_offsets in blocks(batch.column("output")):
                body, offsets = gathered(out, out_offsets, form[first:end])
                yield pa.RecordBatch.from_arrays([*(c[first:end] for c in batch.columns), _strings(body, offsets)], [*batch.schema.names, "restored"])

    return made.mapInArrow(rows, ", ".join(f"`{c}` {t}" for c, t in made.dtypes) + ", restored string")


def middle_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: digests of each output and of the text that is restored from it."""
    back = restore(fill_in_middle(docs))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
