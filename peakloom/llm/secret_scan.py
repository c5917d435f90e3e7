"""Operator 2: secret scans by patterns and by sliding-window Shannon entropy, in DataFrame functions only.

Three patterns give the base spans. Besides, each maximal run of a character class (hexadecimal, or the
base-64 alphabet) is a candidate: a window slides over it, and of the window's counts (packed, twelve to a
64-bit number) only the two change of the character that enters and of the one that leaves, and with them the
sum of c * log2(c) that the entropy needs. Windows of high entropy are merged to spans. An allow list
suppresses well-known harmless strings: its pieces are blanked before runs are cut, so that a secret beside
one is still found. The whole scan is a projection of each row: nothing is shuffled, and no key gathers rows.

Every step is linear in the text but for a small constant: arrays are built in blocks, never by appending to
one that grows with the text.

Cases: a null or empty text has no spans; equal rows each give a row; a candidate as long as the text costs
one step a character; other columns, however named, are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import texts

#: Name, pattern, group that the length is taken of, least length, in the order of listing.
BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Character classes of candidates: name, class, alphabet, window, least bits, what a candidate must hold.
CLASSES = [
    ("hexent", "[0-9A-Fa-f]", "0123456789abcdefABCDEF", 20, 3.2, ["[0-9]", "[A-Fa-f]"]),
    ("b64ent", "[A-Za-z0-9+/_=-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.8, ["[0-9]", "[A-Z]", "[a-z]"]),
]
#: Allow list, pieces: harmless wherever they stand in a run. Each matches texts of one length only, given beside it.
ALLOWED_PIECES = [
    ("(?i)example", 7),
    ("(?i)placeholder", 11),
    ("(?i)changeme", 8),
    ("(?i)your[_-]", 5),
    ("(?i)lorem", 5),
    ("(?i)x{6}", 6),
    ("0{8}", 8),
    ("0123456789", 10),
    ("(?i)abcdefghij", 10),
]
#: Allow list, whole runs: identifiers, and one character over and over.
ALLOWED_RUNS = [
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(.)\1+$",
]
BLOCK = 64  # entries of an array that are appended one by one
STARTS = 256  # windows of a candidate that are slid over at once
PACKED, BITS = 12, 5  # counts in a 64-bit number; a count is at most the window, below 2**BITS


def let(value: Column, body) -> Column:
    """``body`` of a lambda variable with ``value``, which is so computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def cut(values: Column, size: int, more: int = 0) -> Column:
    """array<(from, part)>: runs of ``size`` entries, each with up to ``more`` of the next; one empty run of an empty array."""
    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1 - more) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * size).alias("from"), F.slice(values, k * size + 1, size + more).alias("part")))


def running_sums(values: Column, levels: int = 3) -> Column:
    """The sums of the entries up to each one; ``values`` is a lambda variable or a column."""

    def plain(part: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])

    def total(part: Column) -> Column:
        return F.coalesce(F.get(part, F.size(part) - 1), F.lit(0))

    if levels == 1:
        return plain(values)
    inner = F.transform(cut(values, BLOCK), lambda b: plain(b["part"]))
    return let(inner, lambda parts: let(F.transform(parts, total), lambda totals: let(running_sums(totals, levels - 1), lambda sums: F.flatten(F.zip_with(parts, sums, lambda part, s: F.transform(part, lambda x: x + s - total(part)))))))


def placed(found: Column, gaps: Column) -> Column:
    """array<(start, end, found)> from the matches and the lengths of what stands between them, in code points."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, f: gap + F.char_length(f))
    return F.zip_with(let(lengths, lambda x: running_sums(x)), found, lambda end, f: F.struct((end - F.char_length(f)).alias("start"), end.alias("end"), f.alias("found")))


def _weight(c: Column) -> Column:
    """c * log2(c), 0 for 0."""
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def _dense_windows(codes: Column, alphabet: str, window: int, bits: float) -> Column:
    """array<(start, end)> inside the short array ``codes``: merged windows of at least ``bits`` of Shannon entropy."""
    pairs = F.zip_with(codes, F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), 1, F.size(codes)), lambda i, o: F.struct(i.alias("into"), o.alias("out")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    zeros = F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // PACKED))
    first = F.struct(zeros.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), none.alias("spans"))
    enough = math.log2(window) - bits - 1e-9  # entropy = log2(window) - sum / window

    def word(code: Column) -> Column:
        return F.floor(code / PACKED).cast("int")

    def shift(code: Column) -> Column:
        return (code % PACKED * BITS).cast("int")

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, word(code)), shift(code)).bitwiseAND(F.lit(2**BITS - 1))

    def one(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))

    def step(acc: Column, x: Column) -> Column:
        more, fewer = count(acc["counts"], x["into"]), F.when(x["out"] >= 0, count(acc["counts"], x["out"]))
        same = x["into"] == x["out"]
        change = F.when(same, F.lit(0.0)).otherwise(_weight(more + 1) - _weight(more) + F.coalesce(_weight(fewer - 1) - _weight(fewer), F.lit(0.0)))
        total, n = acc["sum"] + change, acc["n"] + 1
        counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, j: c + F.when(j == word(x["into"]), one(x["into"])).otherwise(0) - F.when((x["out"] >= 0) & (j == word(x["out"])), one(x["out"])).otherwise(0)))
        size = F.size(acc["spans"])
        last = F.get(acc["spans"], size - 1)
        longer = F.concat(F.slice(acc["spans"], 1, F.greatest(size - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), n.alias("end"))))
        another = F.concat(acc["spans"], F.array(F.struct((n - window).alias("start"), n.alias("end"))))
        grown = F.when((size > 0) & (last["end"] >= n - window), longer).otherwise(another)
        return F.struct(counts.alias("counts"), total.alias("sum"), n.alias("n"), F.when((n >= window) & (total <= enough * window), grown).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pairs, first, step, lambda acc: acc["spans"])


def merged(spans: Column) -> Column:
    """Spans in order of start and of end, those that touch as one; ``spans`` is a lambda variable or a column."""
    starts = F.filter(spans, lambda x, i: (i == 0) | (x["start"] > F.get(spans, i - 1)["end"]))
    ends = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > x["end"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def entropy_spans(candidate: Column, alphabet: str, window: int, bits: float) -> Column:
    """array<(start, end)> inside ``candidate``: merged windows of at least ``bits`` of Shannon entropy.

    The window slides over STARTS places at a time; what it finds is joined to one list in the end.
    """
    codes = F.transform(F.slice(F.split(candidate, ""), 1, F.char_length(candidate)), lambda c: F.position(c, F.lit(alphabet)) - 1)

    def each(own: Column) -> Column:
        return F.flatten(F.transform(cut(own, STARTS, window - 1), lambda b: F.transform(_dense_windows(b["part"], alphabet, window, bits), lambda s: F.struct((s["start"] + b["from"]).alias("start"), (s["end"] + b["from"]).alias("end")))))

    return let(codes, lambda own: let(each(own), merged))


def blanked(text: Column, pieces: list[tuple[str, int]] | None = None) -> Column:
    """``text`` with every piece of the allow list as spaces, so that places stay."""
    for pattern, length in ALLOWED_PIECES if pieces is None else pieces:
        text = F.regexp_replace(text, pattern, " " * length)
    return text


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed_pieces: list[tuple[str, int]] | None = None, allowed_runs: list[str] | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, rank, kind, end), sorted; ``spans`` holds the base ones and the method's."""
    base = texts(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a text without a run as long as a window has none after blanking either
    long_run = F.col("text").rlike("|".join(f"{chars}{{{window},}}" for _, chars, _, window, _, _ in CLASSES))
    base = base.select("doc_id", "text", F.when(long_run, blanked(F.col("text"), allowed_pieces)).otherwise("").alias("open"))
    patterns = [(name, "text", pattern) for name, pattern, _, _ in BASE] + [(name, "open", f"{chars}{{{window},}}") for name, chars, _, window, _, _ in CLASSES]
    each = base.select("doc_id", "text", "open", *(F.regexp_extract_all(source, F.lit(p), F.lit(0)).alias(name) for name, source, p in patterns))

    def with_places(name: str, source: str, pattern: str) -> Column:
        gaps = F.transform(F.split(source, pattern, -1), F.char_length)
        return F.when(F.size(name) > 0, placed(F.col(name), gaps)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>")).alias(name)

    each = each.select("doc_id", *(with_places(*p) for p in patterns))

    def kind(rank: int, name: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"), x["end"].alias("end")))

    def plain(name: str, pattern: str, group: int, least: int) -> Column:
        return F.filter(name, lambda x: F.char_length(F.regexp_extract(x["found"], pattern, group)) >= least)

    def dense(name: str, alphabet: str, window: int, bits: float, holds: list[str]) -> Column:
        def candidate(x: Column) -> Column:
            keep = F.lit(True)
            for pattern in holds:  # one at a time: each is found, or not, in one pass
                keep &= x["found"].rlike(pattern)
            for pattern in ALLOWED_RUNS if allowed_runs is None else allowed_runs:
                keep &= ~x["found"].rlike(pattern)
            return keep

        def windows(x: Column) -> Column:
            return F.transform(entropy_spans(x["found"], alphabet, window, bits), lambda s: F.struct((s["start"] + x["start"]).alias("start"), (s["end"] + x["start"]).alias("end")))

        return F.flatten(F.transform(F.filter(name, candidate), windows))

    by_pattern = [kind(i, name, plain(name, pattern, group, least)) for i, (name, pattern, group, least) in enumerate(BASE)]
    by_entropy = [kind(i, name, dense(name, alphabet, window, bits, holds)) for i, (name, _, alphabet, window, bits, holds) in enumerate(CLASSES, len(BASE))]
    parted = each.select("doc_id", F.concat(*by_pattern).alias("base"), F.concat(*by_entropy).alias("more"))
    return parted.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "more")).alias("spans"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    found = secret_spans(docs)

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(name: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [number(name) for name, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
