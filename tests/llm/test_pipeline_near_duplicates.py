"""The near-duplicate stage of the pipeline: its threshold and its rows."""

import corpus_pipeline
from peakloom.llm import minhash
from tests.llm.test_duplicates_and_quality import docs


def text(name, n=200, changed=()):
    return " ".join(f"{name}{i}" if i not in changed else f"{name}changed{i}" for i in range(n))


def similarity(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_takes_a_threshold_of_its_own(spark):
    pair = [text("a"), text("a", changed=(30, 80, 130, 180))]
    chain = [" ".join(f"b{i}" for i in range(s, s + 200)) for s in (0, 20, 40)]
    exact = [text("c", 94), text("c", 94, changed=(30, 60))]  # 80 of 100 shingles
    below = [text("e"), text("e", changed=(30, 70, 110, 150, 190))]
    assert all(0.80 < similarity(*p) < 0.85 for p in (pair, chain[:2], chain[1:])) and similarity(*exact) == 0.8
    assert similarity(chain[0], chain[2]) < 0.8 and 0.75 < similarity(*below) < 0.8
    d = docs(spark, pair + chain + exact + below)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, d, None).collect()) == [0, 2, 5, 7, 8]
    assert minhash.keep_one_of_each(d).count() == 9  # op3's threshold is as it was


def test_rows_with_a_null_id_stay(spark):
    d = docs(spark, [text("a"), text("a"), text("b"), text("b"), None, text("c"), text("c")], ids=[1, 2, None, None, None, 5, None])
    got = corpus_pipeline.near_duplicate_stage(spark, d, None)
    assert got.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, text("b")), (0, text("b")), (0, text("c")), (1, text("a")), (5, text("c"))]
