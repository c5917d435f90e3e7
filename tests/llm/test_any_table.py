"""What every operator must bear: other columns of any name, empty tables, null and shared ids, repeated rows."""

import pytest
from pyspark.sql import functions as F

from peakloom.llm import bpe, decontam, license_scan, line_dedup, media, minhash, quality, secret_scan, suffix_dedup, token_counts

P = pytest.importorskip("public_tokenizers")
LINE = "a line of more than forty characters that several documents share"
TEXTS = [None, "", "one two three four five six seven", LINE, LINE, LINE + "\n" + LINE, LINE, LINE, "token=abcdef1 under the MIT license", "é漢 😀\n\nx", ("word " * 9 + "end. ") * 40]
CLASH = ["row", "key", "rep", "a", "b", "c", "bits", "bands", "gram", "words", "hash", "place", "open", "base", "spans", "media", "tiles", "label", "score", "predicted", "found", "anchor", "content", "first", "windows", "lead", "own", "hot", "h1", "line", "gone", "keep", "n_lines", "word", "n", "ids", "n_tokens", "component", "kept", "n_shingles", "id", "size", "item", "start"]


def rows(df):
    return sorted(df.collect(), key=repr)


def tables(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int")
    return docs, bench, labels


def operators(bench, labels):
    path = P.path("byte_bpe_50k.tiktoken")
    return {
        "token_counts": lambda d: token_counts.token_counts(d, path, P.PATTERN),
        "secret_scan": secret_scan.secret_digests,
        "minhash": minhash.near_duplicates,
        "media": media.media_digests,
        "quality": lambda d: quality.quality_scores(d, labels),
        "bpe": lambda d: bpe.token_digests(d, P.path("word_bpe_49k.json")),
        "suffix_dedup": suffix_dedup.repeat_digests,
        "line_dedup": line_dedup.line_digests,
        "license_scan": license_scan.license_digests,
        "decontam": lambda d: decontam.contamination(d, bench),
    }


NAMES = ["token_counts", "secret_scan", "minhash", "media", "quality", "bpe", "suffix_dedup", "line_dedup", "license_scan", "decontam"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_and_empty_tables(spark, name):
    docs, bench, labels = tables(spark)
    run = operators(bench, labels)[name]
    clash = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    got = run(clash)
    assert rows(got) == rows(run(docs))
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_null_and_shared_ids(spark, name):
    """Every row stays a row; what depends on the text alone is the same as under ids of its own."""
    docs, bench, labels = tables(spark)
    run = operators(bench, labels)[name]
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.floor(F.col("doc_id") / 4)))
    got = run(odd)
    assert got.count() == len(TEXTS)
    if name in ("token_counts", "secret_scan", "media", "bpe", "license_scan", "decontam"):
        columns = [c for c in got.columns if c != "doc_id"]
        assert rows(got.select(columns)) == rows(run(docs).select(columns))


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_duplicates", "decontamination"])
def test_stages_keep_other_columns_whatever_their_names(spark, name):
    docs, bench, labels = tables(spark)
    run = {
        "quality": lambda d: quality.keep_good(d, labels),
        "line_dedup": line_dedup.dedup_lines,
        "near_duplicates": lambda d: minhash.keep_one_of_each(d, percent=80),
        "decontamination": lambda d: decontam.keep_clean(d, bench),
    }[name]
    clash = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    got, want = run(clash), run(docs)
    assert got.columns == clash.columns and want.columns == docs.columns
    assert rows(got.select("doc_id", "text")) == rows(want)
    assert all(r[c] == f"{c} of {r.doc_id}" for r in got.collect() for c in CLASH)
    assert run(clash.limit(0)).count() == 0
