"""Operator 6: BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words (runs without white space, after the vocabulary's normalisation) are counted over all documents; the
most frequent ones, encoded once, are compiled into a minimal acyclic automaton: equal suffixes share their
states, and the numbers on a word's edges add up to its place in the id lists. The automaton is one array,
broadcast, and memory-mapped by each worker from a file that leaves nothing behind. A batch's distinct
words walk it together; a word outside the lexicon is split and merged exactly. The lexicon decides speed
only, never ids.

Cases: a null or empty text has no tokens and decodes to an empty text; special tokens written in a text get
their ids, as the library gives them; ids and repeated rows are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import sys
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, texts

LEXICON_WORDS = 60_000
KNOWN_WORDS = 300_000  # encoded words that a worker remembers
LONG = 64  # bytes of a piece, up to which pieces are merged together
ABSENT = 1 << 40  # rank of a pair that never merges
#: White space of the vocabulary's own patterns: Unicode's, without the four separators that Python adds.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

NOT_SPACE = "\x1c\x1d\x1e\x1f"


# Where the tokenizers library's Unicode tables differ from Python's. Its classes and cases are newer, its marks older.
LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
LOWERED = {"1C89": 0x1C8A, "A7CB": 0x264, "A7CC": 0xA7CD, "A7CE": 0xA7CF, "A7D2": 0xA7D3, "A7D4": 0xA7D5, "A7DA": 0xA7DB, "A7DC": 0x19B, "10D50-10D65": 0x10D70, "16EA0-16EB8": 0x16EBB}
#: Marks without a combining class there, and the parts of a character that isn't composed there: nothing moves or joins across them.
STILL = "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11935 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"


def code_points(ranges: str) -> list[int]:
    bounds = [(x.split("-")[0], x.split("-")[-1]) for x in ranges.split(" ")]
    return [c for a, z in bounds for c in range(int(a, 16), int(z, 16) + 1)]


def _set_of(ranges: str, end: int = sys.maxunicode) -> str:
    return "".join(f"\\U{c:08x}" for c in code_points(ranges) if c <= end)


_CASES = {c: to + i for ranges, to in LOWERED.items() for i, c in enumerate(code_points(ranges))}
_CASED = re.compile(f"[{''.join(map(chr, _CASES))}]").search
_STILL = re.compile(f"([{_set_of(STILL)}])").split


def composed(text: str) -> str:
    """NFC by the library's tables. What Python takes for composed is so there too."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text
    return "".join(unicodedata.normalize("NFC", part) if i % 2 == 0 else part for i, part in enumerate(_STILL(text)))


def lowered(text: str) -> str:
    """Each code point lower-cased alone, by the library's tables."""
    text = text.replace("Σ", "σ").lower()
    return text if text.isascii() or not _CASED(text) else text.translate(_CASES)


def _class_of(kind: str, end: int = sys.maxunicode) -> str:
    """The code points of a general category up to ``end``, as ranges of a character class."""
    out, start, last = [], None, None
    for code in range(end + 2):
        inside = code <= end and unicodedata.category(chr(code))[0] == kind
        if inside and start is None:
            start = code
        if not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        last = code
    return "".join(out)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


class PairTable:
    """Rank of a pair of ids by open addressing; the ranks are the pairs' places in the list."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(4, int(8 * len(pairs) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, ABSENT, np.int64)
        self.probes = 1
        for rank, key in enumerate((pairs[:, 0] << 32 | pairs[:, 1]).tolist()):
            slot, step = int(self.slots(np.array([key]))[0]), 1
            while self.keys[slot] >= 0:
                slot, step = (slot + 1) % len(self.keys), step + 1
            self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, step)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32 | b).ravel()
        slot, out = self.slots(keys), np.full(len(keys), ABSENT)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            open_, slot = open_[more], (slot[more] + 1) & (len(self.keys) - 1)
        return out.reshape(a.shape)


class WordBPE:
    """A lower-casing BPE with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.ids: dict[str, int] = file["model"]["vocab"]
        self.end = file["model"]["end_of_word_suffix"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(file["model"]["merges"])}
        self.joined = [a + b for a, b in self.ranks]
        self.merged_id = np.array([self.ids[j] for j in self.joined], np.int64)
        self.pairs = PairTable(np.array([[self.ids[a], self.ids[b]] for a, b in self.ranks], np.int64).reshape(-1, 2))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = byte_letters()
        self.inner, self.last = (np.array([self.ids.get(x + end, 0) for x in self.letters], np.int64) for end in ("", self.end))
        # three forms of one pattern: classes without characters beyond 16 bits are looked up at once, the whole ones range by range
        self.ascii_pieces, self.short_pieces, self.all_pieces = (
            re.compile(f"[{letter}]+|[{number}]|'(?:s|t|re|ve|m|ll|d)|[^ {letter}{number}]+").findall
            for letter, number in [("A-Za-z", "0-9"), *((_class_of("L", end) + _set_of(LETTERS, end), _class_of("N", end) + _set_of(NUMBERS, end)) for end in (0xFFFF, sys.maxunicode))]
        )
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda text: [text]
        self.space = re.compile(f"[{SPACE}]+").sub

    def pieces(self, word: str) -> list[str]:
        """What the vocabulary's pattern cuts a word into."""
        if word.isascii():
            return self.ascii_pieces(word)
        if _CASED(word):
            word = word.translate(_CASES)
        return self.all_pieces(word) if max(word) > "\uffff" else self.short_pieces(word)

    def normal(self, text: str) -> str:
        """NFC, white space as single spaces, each code point lower-cased alone."""
        return lowered(self.space(" ", composed(text)))

    def words(self, text: str) -> list[str]:
        """What stands between white space, special tokens being words of their own (marked by a leading NUL)."""
        if not any(t in text for t in self.special) and not any(c in text for c in NOT_SPACE):
            return composed(text).replace("Σ", "σ").lower().split()  # cases that Python doesn't know wait for ``pieces``
        out: list[str] = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append("\0" + part)
            elif part:
                out += [w for w in self.normal(part).split(" ") if w]
        return out

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: of the adjacent pairs the one of lowest rank, leftmost if equal, is merged until none is left.

        A heap of pairs and links between the parts, so that a piece of any length takes n log n steps.
        """
        parts: list[str | None] = [self.letters[b] for b in piece.encode("utf-8")]
        parts[-1] += self.end
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in self.ranks]  # noqa: B905  one shorter
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            to = after[at] if parts[at] is not None else n
            if to >= n or self.ranks.get((parts[at], parts[to])) != rank:
                continue
            parts[at], parts[to] = self.joined[rank], None
            after[at] = after[to]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (new := self.ranks.get((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (new, left))
        return [self.ids[p] for p in parts if p is not None]

    def merge_many(self, pieces: list[str]) -> list[list[int]]:
        """merge() of many pieces at once, for those of up to LONG bytes.

        Pieces of one length are the rows of a matrix; each step merges one pair in every row, so rows that go on
        join those of the next shorter length. Only the merged part's own pairs are looked up again.
        """
        coded = [p.encode("utf-8") for p in pieces]
        out: list[list[int]] = [self.merge(p) if len(c) > LONG else [] for p, c in zip(pieces, coded, strict=True)]
        length = np.array([len(c) for c in coded])
        flat = np.frombuffer(b"".join(coded), np.uint8)
        start = np.cumsum(length) - length
        rows, parts, ranks = np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64)
        for n in range(min(LONG, int(length.max(initial=0))), 0, -1):
            own = np.flatnonzero(length == n)
            fresh = self.inner[flat[start[own][:, None] + np.arange(n)]]
            if len(own):
                fresh[:, -1] = self.last[flat[start[own] + n - 1]]
            rows = np.concatenate([rows, own])
            parts = np.concatenate([parts.reshape(len(parts), n), fresh])
            ranks = np.concatenate([ranks.reshape(len(ranks), n - 1), self.pairs.lookup(fresh[:, :-1], fresh[:, 1:])])
            at = ranks.argmin(axis=1) if n > 1 else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if n > 1 else np.full(len(rows), ABSENT)
            ended = best == ABSENT
            for row, ids in zip(rows[ended].tolist(), parts[ended].tolist(), strict=True):
                out[row] = ids
            if n == 1:
                break
            rows, parts, ranks, at, best = rows[~ended], parts[~ended], ranks[~ended], at[~ended], best[~ended]
            each = np.arange(len(rows))
            parts[each, at] = self.merged_id[best]
            stay = np.ones(parts.shape, bool)
            stay[each, at + 1] = False
            parts = parts[stay].reshape(len(rows), n - 1)
            stay = np.ones(ranks.shape, bool)
            stay[each, at] = False
            ranks = ranks[stay].reshape(len(rows), n - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            ranks[left, at[left] - 1] = self.pairs.lookup(parts[left, at[left] - 1], parts[left, at[left]])
            ranks[right, at[right]] = self.pairs.lookup(parts[right, at[right]], parts[right, at[right] + 1])
        return out

    def split(self, word: str) -> list[str]:
        """Pieces of a word; a special token is one piece, marked by its NUL."""
        return [word] if word[0] == "\0" and word[1:] in self.special else self.pieces(word)

    def pieces_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of many pieces, special tokens among them."""
        plain = [p for p in pieces if not (p[0] == "\0" and p[1:] in self.special)]
        merged = iter(self.merge_many(plain)) if plain else iter(())
        return [[self.special[p[1:]]] if p[0] == "\0" and p[1:] in self.special else next(merged) for p in pieces]

    def word_ids(self, word: str) -> list[int]:
        return [i for ids in self.pieces_ids(self.split(word)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by single spaces; this vocabulary names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """The vocabulary, read once in a worker's life."""
    return WordBPE(path)


class Transducer:
    """A minimal acyclic automaton over UTF-8 bytes with additive outputs, as one flat array of 64-bit numbers.

    After three counts come the edges' keys (state * 256 + byte, sorted), their targets and numbers, the
    states (1 accepting, 2 the root), and the id lists' offsets and ids.
    """

    def __init__(self, array: np.ndarray):
        self.array = array
        edges, states, words = (int(x) for x in array[:3])
        parts = np.split(array[3:], np.cumsum([edges, edges, edges, states, words + 1]))
        self.keys, self.targets, self.numbers, self.final, self.offsets, self.ids = parts

    @staticmethod
    def compile(lexicon: dict[str, list[int]]) -> Transducer:
        """Add words in byte order; once a branch can't grow any more, its states are shared with equal ones."""
        shared: dict[tuple, int] = {}
        done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in shared:
                shared[key] = len(done)
                done.append(key)
            return shared[key]

        path: list[list] = [[False, []]]  # open states of the last word: accepting, edges so far
        last = b""
        ordered = sorted((w.encode("utf-8"), ids) for w, ids in lexicon.items())
        for word, _ in [*ordered, (b"", [])]:
            common = os.path.commonprefix([word, last]) if word else b""
            for depth in range(len(last), len(common), -1):
                closed = settle(path.pop())
                path[depth - 1][1].append((last[depth - 1], closed))
            path += [[False, []] for _ in word[len(common) :]]
            path[-1][0] |= bool(word)
            last = word
        root = settle(path[0])
        accepts = np.zeros(len(done), np.int64)
        for state, (final, edges) in enumerate(done):  # targets come before the states that lead there
            accepts[state] = final + sum(accepts[t] for _, t in edges)
        rows = []
        for state, (final, edges) in enumerate(done):
            before = int(final)
            for byte, target in edges:
                rows.append((state * 256 + byte, target, before))
                before += int(accepts[target])
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        final = np.array([f for f, _ in done], np.int64)
        final[root] |= 2
        offsets = np.concatenate(([0], np.cumsum([len(ids) for _, ids in ordered])))
        flat = np.array([i for _, ids in ordered for i in ids], np.int64)
        return Transducer(np.concatenate([[len(table), len(done), len(ordered)], *table.T, final, offsets, flat]).astype(np.int64))

    @staticmethod
    def mapped(data: bytes) -> Transducer:
        """Memory-map the array from a file in the executor's own folder; the file's name goes at once, the map stays."""
        with tempfile.NamedTemporaryFile() as f:
            f.write(data)
            f.flush()
            return Transducer(np.memmap(f.name, np.int64, "r"))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the id lists, or -1; all words walk together, a byte a step."""
        place = np.zeros(len(words), np.int64)
        state = np.full(len(words), int(np.flatnonzero(self.final >= 2)[0]) if len(self.final) else -1)
        if not len(words) or not len(self.keys):
            return np.full(len(words), -1, np.int64)
        length = np.array([len(w) for w in words])
        start = np.concatenate(([0], np.cumsum(length)))[:-1]
        body = np.frombuffer(b"".join(words), np.uint8)
        going = np.flatnonzero(length > 0)
        step = 0
        while len(going):
            key = state[going] * 256 + body[start[going] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            state[going[~there]] = -1
            going, edge = going[there], edge[there]
            state[going] = self.targets[edge]
            place[going] += self.numbers[edge]
            step += 1
            going = going[length[going] > step]
        accepted = (state >= 0) & (self.final[np.maximum(state, 0)] % 2 == 1)
        return np.where(accepted, place, -1)

    def output(self, place: int) -> list[int]:
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist()


def frequent_words(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents, ``most`` at most; only these come to the driver.

    A histogram of the counts (eight steps to a doubling, so of a few hundred rows) gives the least count that
    keeps within ``most``; words at least that frequent are taken.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = load(vocabulary), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(bpe.words(text))
            if len(counts) > KNOWN_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    short = materialize(counted.where((F.col("n") > 1) & (F.length("word") <= 64) & ~F.col("word").startswith("\0")).withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "words")
    least, total = None, 0
    steps = short.groupBy("step").count().orderBy(F.desc("step")).collect()
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r.step
    if least is None:  # no words, or more than ``most`` in the top step: its first ones by name
        return [r.word for r in short.where(F.col("step") == steps[0].step).orderBy("word").limit(most).collect()] if steps else []
    return [r.word for r in short.where(F.col("step") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> Transducer:
    bpe = load(vocabulary)
    split = {w: bpe.split(w) for w in frequent_words(docs, vocabulary, most)}
    pieces = list({p for own in split.values() for p in own})
    ids = dict(zip(pieces, bpe.pieces_ids(pieces), strict=True))
    return Transducer.compile({w: [i for p in own for i in ids[p]] for w, own in split.items()})


class Encoder:
    """Whole texts to ids in a worker: remembered words, then the transducer, then exact merging.

    What is remembered is text (ids, and tokens, joined by spaces), which costs the garbage collector nothing.
    """

    def __init__(self, bpe: WordBPE, lexicon: Transducer):
        self.bpe, self.lexicon = bpe, lexicon
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.shown = [str(i) for i in range(max(bpe.tokens) + 1)]
        self.token = [bpe.tokens.get(i, "") for i in range(max(bpe.tokens) + 1)]

    def _joined(self, ids: list[int]) -> tuple[str, str]:
        return " ".join([self.shown[i] for i in ids]), " ".join([self.token[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Remember words and, as words too, their pieces."""
        if len(self.ids) > KNOWN_WORDS:
            self.ids.clear()
            self.tokens.clear()
        new = [w for w in words if w not in self.ids]
        places = self.lexicon.lookup([w.encode("utf-8") for w in new])
        for i in np.flatnonzero(places >= 0).tolist():
            self.ids[new[i]], self.tokens[new[i]] = self._joined(self.lexicon.output(int(places[i])))
        rest = [new[i] for i in np.flatnonzero(places < 0).tolist()]
        mixed = [(w, self.bpe.split(w)) for w in rest if not w.isalpha()]
        pieces = list({p for _, own in mixed for p in own if p not in self.ids}.union([w for w in rest if w.isalpha()]))
        for piece, ids in zip(pieces, self.bpe.pieces_ids(pieces), strict=True):
            self.ids[piece], self.tokens[piece] = self._joined(ids)
        for word, own in mixed:
            self.ids[word] = " ".join([self.ids[p] for p in own])
            self.tokens[word] = " ".join([self.tokens[p] for p in own])

    def batch(self, column: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by spaces, decoded text) of each text."""
        split = [self.bpe.words(t) if t else [] for t in column]
        self.learn(set().union(*split))
        for words in split:
            ids = " ".join(map(self.ids.__getitem__, words))
            yield (ids.count(" ") + 1 if words else 0), ids, " ".join(map(self.tokens.__getitem__, words))


def encode_documents(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids an array, decoded the library's decoding of them."""

    def row(n: int, ids: str, decoded: str) -> tuple:
        return n, [int(i) for i in ids.split()], decoded

    return _encoded(texts(docs, id_col, text_col), vocabulary, most, row, [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())], "doc_id long, n_tokens long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every document."""

    def row(n: int, ids: str, decoded: str) -> tuple:
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    return _encoded(texts(docs), vocabulary, most, row, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(base: DataFrame, vocabulary: str, most: int, row, columns: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(build_lexicon(base, vocabulary, most).array.tobytes())  # bounded by ``most`` words of 64 characters

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(vocabulary), Transducer.mapped(shared.value))
        for batch in batches:
            done = [row(*r) for r in encoder.batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[i] for d in done], kind) for i, (_, kind) in enumerate(columns))], ["doc_id", *(name for name, _ in columns)])

    return base.mapInArrow(rows, schema)
