"""Operators 3, 5 and 7 and the pipeline against brute force, on small tables with awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import components, minhash, quality, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string"
VOCAB = ["w%02d" % i for i in range(90)]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0, "clash") for i, t in enumerate(texts)], SCHEMA)


def say(rng, n):
    return " ".join(rng.choice(VOCAB, n))


def changed(rng, text, n):
    w = text.split()
    for i in rng.choice(len(w), n, replace=False):
        w[i] = "changed%d" % rng.integers(1000)
    return " ".join(w)


AWKWARD = [None, "", " \n\t", "one", "One", "two words", "one two three four", "one two three four five", "é漢 😀 x y z", "a " * 3000]


def components_of(texts, percent=85):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    home = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if (both := len(a & sets[j])) and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    home[i] = home[j] = min(home[i], home[j])
    return [(len(s), h) for s, h in zip(sets, home, strict=True)]


@pytest.mark.parametrize("rows", [2000, 3])
def test_near_duplicates(spark, monkeypatch, rows):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(1)
    texts = list(AWKWARD)
    for _ in range(6):
        base = say(rng, int(rng.integers(40, 200)))
        texts += [base, base.upper(), base] + [changed(rng, base, int(rng.integers(1, 7))) for _ in range(8)]
    chain = say(rng, 300).split()
    texts += [" ".join(chain[i * 6 : i * 6 + 200]) for i in range(8)]  # linked in a row only
    texts += [say(rng, 80) for _ in range(20)]
    order = np.random.default_rng(2).permutation(len(texts))
    texts = [texts[i] for i in order]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    want = components_of(texts)
    assert len(got) == len(texts)
    for i, (n, home) in enumerate(want):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, home, home == i), i
    kept = minhash.keep_one_of_each(docs(spark, texts))
    assert kept.columns == docs(spark, ["x"]).columns and kept.count() == sum(h == i for i, (_, h) in enumerate(want))
    assert minhash.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def test_large_group(spark):
    """A large group of copies and near copies costs about a comparison a member and comes out as one component."""
    rng = np.random.default_rng(3)
    base = say(rng, 150)
    texts = [base] * 300 + [changed(rng, base, 2) for _ in range(300)]
    got = minhash.near_duplicates(docs(spark, texts))
    assert got.agg(F.count_distinct("component_id"), F.count_if("kept")).first() == (1, 1)


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(4)
    rows = []
    for share in (0.0, 0.3, 0.6, 0.85, 1.0):
        both = rng.integers(0, 2**63, 400).astype(np.uint64)
        n = int(400 * share)
        a, b = np.concatenate([both[:n], rng.integers(0, 2**63, (400 - n) // 2).astype(np.uint64)]), np.concatenate([both[:n], rng.integers(0, 2**63, (400 - n) // 2).astype(np.uint64)])
        true = n / (len(a) + len(b) - n)
        rows.append((true, [int(x) for x in minhash.low_bits(minhash.minima(a))], [int(x) for x in minhash.low_bits(minhash.minima(b))]))
    df = spark.createDataFrame(rows, "j double, a array<long>, b array<long>")
    for r in df.select("j", minhash.estimate(F.col("a"), F.col("b")).alias("e")).collect():
        assert abs(r.j - r.e) < minhash.SLACK


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 205)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[205] == 200 and got[339] == 300
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7
def repeats_of(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup(spark, seed):
    rng = np.random.default_rng(seed)
    passages = [say(rng, n) for n in (24, 25, 26, 30, 60, 200)]
    texts = [t for t in AWKWARD if t is None or len(t) < 5000] + ["x" * 99, "x" * 100, "x" * 101, "x" * 350, "ab" * 300, "é" * 120, "a " * 700]
    for _ in range(40):
        parts = [say(rng, int(rng.integers(1, 40))) for _ in range(int(rng.integers(1, 4)))]
        for p in rng.choice(passages, int(rng.integers(0, 4))):
            parts.insert(int(rng.integers(0, len(parts) + 1)), p if rng.random() < 0.6 else changed(rng, p, 1))
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-1], changed(rng, passages[5], 2), changed(rng, passages[5], 3)]
    df = docs(spark, texts).repartition(5, F.rand(seed))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(df).collect()}
    want = repeats_of(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] > 0 for w in want) > 10


@pytest.mark.parametrize("hot", [1, 3])
def test_suffix_dedup_of_hot_anchors(spark, hot):
    """Anchors with too many contexts for one task to merge grow, round after round, and give the same."""
    rng = np.random.default_rng(12)
    line = say(rng, 30)
    texts = [say(rng, 8) + " " + line + " " + say(rng, int(rng.integers(1, 30))) for _ in range(30)] + ["x" * 300, line, line]
    texts += [say(rng, 9) + line[a : a + int(rng.integers(60, 110))] + say(rng, 9) for a in rng.integers(0, 20, 30).tolist()]
    spans = suffix_dedup.repeated_windows(docs(spark, texts), hot=hot)
    gone = [bytearray(len(t)) for t in texts]
    for r in spans.collect():
        gone[r.doc_id][r.first : r.first + r.windows + 99] = b"\1" * (r.windows + 99)
    assert [sum(g) for g in gone] == [w[1] for w in repeats_of(texts)]


def test_narrower_contexts_share_the_anchor_of_equal_windows(spark):
    """Each window comes once in each round; equal windows at equal levels have equal anchors, and no others share one."""
    rng = np.random.default_rng(4)
    middle = bytes(rng.integers(97, 123, 24, dtype=np.uint8))
    rows = []
    for doc in range(40):
        left, right = (bytes(rng.integers(97, 99, 76, dtype=np.uint8) if rng.random() < 0.5 else np.full(76, 97 + n, np.uint8)) for n in (0, 1))
        lead, last = int(rng.integers(0, 77)), int(rng.integers(0, 77))
        windows = lead + 1 if last >= 76 else int(rng.integers(1, lead + 2))
        body = (left[76 - lead :] + middle + right)[: windows + 99]
        rows.append((5, doc, 10, windows, lead, body))
    shards = spark.createDataFrame(rows, "anchor long, doc_id long, first int, windows int, lead int, bytes binary")
    whole = {(doc, 10 + w): (lead - w, body[w : w + 100]) for _, doc, _, windows, lead, body in rows for w in range(windows)}
    for levels in suffix_dedup.LEVELS:
        anchors, owner = {}, {}
        for r in suffix_dedup.narrowed(shards, levels).collect():
            for w in range(r.windows):
                level, window = whole[r.doc_id, r["first"] + w]
                assert level == r.lead - w and (levels == 1 or r.bytes[w : w + 100] == window)
                assert (r.doc_id, r["first"] + w) not in owner
                owner[r.doc_id, r["first"] + w] = r.anchor
                low = level // levels * levels
                high = min(low + levels, 77) - 1
                core = (low, window[level - low : level + 100 - high])
                assert anchors.setdefault(r.anchor, core) == core
        assert owner.keys() == whole.keys() and len(set(anchors.values())) == len(anchors)


def test_many_contexts_of_one_anchor_are_merged(spark):
    """Of 30,000 contexts of one anchor no group over ``hot`` reaches a task, and all of their repeats are found."""
    rng = np.random.default_rng(8)
    middle = bytes(rng.integers(97, 123, 60, dtype=np.uint8))
    edges = rng.integers(97, 123, (30_000, 2, 60), dtype=np.uint8)
    same = rng.integers(0, 45, (30_000, 2))
    bodies = []
    for pair, (a, b) in zip(edges, same.tolist(), strict=True):
        pair[0, 60 - a :], pair[1, :b] = 65, 66
        bodies.append(bytes(pair[0]) + middle + bytes(pair[1]))
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(bodies)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert [got[i] for i in range(len(bodies))] == [w[1] for w in repeats_of([t.decode() for t in bodies])]


def test_contexts_of_one_anchor_over_many_partitions(spark):
    """Whatever the range partitions cut apart, each content keeps one earliest place, and lone anchors go."""
    rng = np.random.default_rng(21)
    rows = [(int(rng.choice([5, 5, 5, 6, 7, 900])), int(rng.integers(0, 6)), i, int(rng.integers(0, 3)), 1, 0, False) for i in range(400)]
    rows += [(1000 + i, 1, i, 0, 1, 0, False) for i in range(50)] + [(2000, 3, i, 0, 1, 0, False) for i in range(60)]
    found = spark.createDataFrame(rows, suffix_dedup._CONTEXT)
    contents, least = {}, {}
    for a, c, d, f, *_ in rows:
        contents.setdefault(a, set()).add(c)
        least[a, c] = min(least.get((a, c), (d, f)), (d, f))
    want = {(a, d, f, (d, f) != least[a, c]) for a, c, d, f, *_ in rows if (d, f) != least[a, c] or len(contents[a]) > 1}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for n in (1, 7, 60):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = suffix_dedup.settled_contexts(found).collect()
        assert len(got) == len(want) and {(r.anchor, r.doc_id, r["first"], r.repeat) for r in got} == want, n
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_many_contexts_of_one_anchor_in_bounded_memory():
    """A partition with one anchor of a million different contexts is streamed: what is held is one row."""
    import tracemalloc

    names = ["anchor", "content", "doc_id", "first", "windows", "lead", "repeat", "bytes"]

    def batches():
        for at in range(0, 1_000_000, 2000):
            n = np.arange(at, at + 2000)
            small = np.zeros(2000, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(2000, np.int64), n, n, small, small + 1, small, np.zeros(2000, bool), [b"x" * 120] * 2000)], names)

    tracemalloc.start()
    rows, edges, before = 0, 0, pa.total_allocated_bytes()
    for batch in suffix_dedup._settled(batches()):
        rows += batch.num_rows
        edges += sum(batch.column(9).to_pylist()) if batch.num_rows < 2 or rows < 5000 else 0
        assert pa.total_allocated_bytes() - before < 4 << 20
    assert rows == 1_000_000 and edges == 2 and tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_suffix_dedup_cases(spark):
    assert suffix_dedup.repeat_digests(docs(spark, ["x"]).limit(0)).count() == 0
    same = spark.createDataFrame([(None, "y" * 150), (7, "z" * 120), (7, "z" * 20)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.repeat_digests(same).collect()) == [(20, 19), (120, 119), (150, 0)]
    assert suffix_dedup.cut_spans(b"abcdef", [(1, 3), (2, 4), (5, 9)]) == (b"ae", 2)


def test_equal_windows_choose_equal_anchors():
    rng = np.random.default_rng(9)
    w = rng.integers(97, 100, 300, dtype=np.uint8)
    body = np.concatenate([rng.integers(97, 100, 57, dtype=np.uint8), w, rng.integers(97, 100, 31, dtype=np.uint8), w])
    out = suffix_dedup.contexts(body, np.array([0, len(body)]))
    owner = {}
    for _, anchor, _, first, n, lead in zip(*out, strict=True):
        for i in range(n):
            owner[first + i] = (anchor, lead - i)
    assert len(owner) == len(body) - 99
    assert [owner[57 + i] for i in range(201)] == [owner[57 + 300 + 31 + i] for i in range(201)]


# 5
def labelled(spark, n=700, seed=5):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        text = ". ".join(say(rng, 12).capitalize() for _ in range(8)) if good else " ".join(x.upper() + "!!" for x in rng.choice(VOCAB, 80))
        rows.append((i, text))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_holds_out_a_fold(spark):
    d, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.quality_scores(d, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(held) and len(held) > 80
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    used = {r.doc_id for r in quality.training_rows(d, labels, sample=50).collect()}
    assert 25 <= len(used) <= 50 and not used & set(held)


def test_quality_cases(spark):
    d, labels = labelled(spark, 60)
    model = quality.fit(d, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (4, "same text"), (5, "same text"), (None, "é")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score_texts(odd, model).collect()}
    assert len(got) == 6 and got[1].score == got[2].score and got[4].score == got[5].score
    assert {r.score for r in quality.quality_scores(d, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality.quality_scores(d, labels.where("quality = 1")).collect()} == {1}
    assert quality.keep_good(d, labels).columns == d.columns


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    model = quality.ByteCNN()
    texts = [bytes(rng.integers(97, 101, rng.integers(0, 300), dtype=np.uint8)) for _ in range(30)] + [b"abcdefg" * 9] * 2
    offsets = np.cumsum([0] + [len(t) for t in texts])
    together = model.scores(model.pooled(*quality.halves(np.frombuffer(b"".join(texts), np.uint8), offsets)))
    alone = [model.scores(model.pooled(*quality.halves(np.frombuffer(t, np.uint8), np.array([0, len(t)]))))[0] for t in texts]
    assert np.allclose(together, alone, atol=2e-6)


def slow_score(model, text):
    """The network by its definition: byte by byte, chunk by chunk, filter by filter."""
    size = max(1, -(-len(text) // 8)) + quality.GAP
    codes = list(text) + [0] * (size * 8 - len(text))
    again = [c != 0 and any(i - 5 - lag >= 0 and codes[i - 5 : i + 1] == codes[i - 5 - lag : i + 1 - lag] for lag in quality.LAGS) for i, c in enumerate(codes)]
    codes = [c + 256 * f for c, f in zip(codes, again, strict=True)]
    total = float(model.offset[0])
    for f in range(quality.FILTERS):
        best = -np.inf
        for chunk in range(size - 1):
            best = max(best, sum(float(model.embedding[c, e]) * float(model.filters[j * quality.EMBEDDING + e, f]) for j, c in enumerate(codes[chunk * 8 : chunk * 8 + 16]) for e in range(quality.EMBEDDING)))
        total += max(0.0, best + float(model.bias[f])) * float(model.weights[f])
    return 1 / (1 + np.exp(-total))


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(6)
    model = quality.ByteCNN(seed=3)
    model.bias, model.weights = rng.normal(0, 0.3, quality.FILTERS).astype(np.float32), rng.normal(0, 0.5, quality.FILTERS).astype(np.float32)
    texts = [None, "", "x", "abcdefgh", "abcdefghi", "spam spam spam spam " * 3, "é漢😀 word", say(rng, 30), "\0\0\0\0\0\0a\0\0\0\0\0\0a", "abcabcabcabcabc" + say(rng, 5)]
    got = {r.doc_id: r for r in quality.score_texts(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i].score - slow_score(model, (t or "").encode())) < 3e-6 and got[i].predicted == (got[i].score >= 0.3), t


def test_training_rows_of_shared_ids_are_bounded(spark):
    d = spark.createDataFrame([(3, "b %d" % i) for i in range(50)] + [(4, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in quality.training_rows(d, labels, folds=1000).collect()) == [(3, "b 0", 1), (4, "c", 0)]


# pipeline
def passes(spark, sf, texts):
    """ids of ``texts`` without a benchmark window."""
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        q = words_of(r.text)
        n = min(10, len(q))
        windows |= {tuple(q[i : i + n]) for i in range(len(q) - n + 1) if n}
    sizes = {len(w) for w in windows}
    return {d for d, t in texts.items() for w in [words_of(t)] if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))}


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from tests.llm.test_text_operators import lines_of

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    current, after = documents, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, sf).write.parquet(str(tmp_path / str(i)))
        current = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert current.columns == documents.columns
            after.append({r.doc_id: r.text for r in current.select("doc_id", "text").collect()})
    before = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert set(after[0]) == {r.doc_id for r in quality.quality_scores(documents, labels).where("predicted = 1").collect()}
    assert all(after[0][i] == before[i] for i in after[0]) and len(after[0]) < len(before)
    ids = sorted(after[0])
    lines = lines_of([after[0][i] for i in ids])
    assert [hashlib.sha256((after[1][i] or "").encode()).hexdigest() for i in ids] == [x[2] for x in lines] and sorted(after[1]) == ids
    home = components_of([after[1][i] for i in ids], 80)
    assert set(after[2]) == {ids[i] for i, (_, h) in enumerate(home) if h == i}
    assert set(after[3]) == passes(spark, sf, after[2]) and 0 < len(after[3]) < len(after[2])
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in current.collect()}
    assert set(rows) == set(after[3])
    for i, text in after[3].items():
        got = library.encode(text, add_special_tokens=False).ids
        assert rows[i].n_tokens == len(got) and rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest()
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()} == {tuple(r) for r in rows.values()}


def test_pipeline_empty_table(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_shingles_of_a_short_text():
    got = dict(minhash.shingle_sets(pa.array([None, "", "a", "A", "a b c d e f"])))
    assert [len(got[i]) for i in range(5)] == [0, 0, 1, 1, 2] and got[2] == got[3]
