"""Operator 6 against the library on every code point, and on marks that its tables don't know."""

import itertools
import random
import sys

import pytest

from peakloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = P.path("word_bpe_49k.json")
    own = bpe.WordBPE(path)
    return own, tokenizers.Tokenizer.from_file(path)


def own_ids(own, text):
    return [i for w in own.words(text) for i in ([own.special[w[1:]]] if w.startswith("\0") else itertools.chain.from_iterable(own.merge(p) for p in own.pieces(w)))]


def test_every_code_point(both):
    own, library = both
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 65536):
        part = points[at : at + 65536]
        texts = [f"ab{chr(c)}cd1{chr(c)}" for c in part]
        for c, text, want in zip(part, texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            if own.normal(text) != library.normalizer.normalize_str(text):
                raise AssertionError(f"normal form of {c:X}")
            # merging is slow here and the same for all: one code point in 64, and all that the tables name
            if c % 64 == 0 or c in NAMED:
                assert own_ids(own, text) == want.ids, f"{c:X}"
            else:
                pieces = [p for w in own.words(text) for p in own.pieces(w)]
                assert "".join(pieces) == "".join(own.words(text))
                assert len(pieces) == sum(t.endswith("</w>") for t in want.tokens), f"{c:X}"


NAMED = {c for r in (bpe.LETTERS, bpe.NUMBERS, bpe.STILL, *bpe.LOWERED) for c in bpe.code_points(r)}


def test_marks_in_any_order(both):
    own, library = both
    rng = random.Random(6)
    marks = [chr(c) for c in bpe.code_points(bpe.STILL)] + ["́", "̴", "ͅ", "̣", "̧"]
    for _ in range(2000):
        text = "".join(rng.choice(["a", "é", "Σ", " ", "ᄀ", "ᅡ", "ᆨ", *rng.sample(marks, 3)]) for _ in range(rng.randrange(12)))
        assert own_ids(own, text) == library.encode(text, add_special_tokens=False).ids, ascii(text)
