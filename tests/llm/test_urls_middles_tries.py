"""Operators 11 to 13 against definitions in plain Python, on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom.llm import conversation_trie, fill_in_middle, queries, url_filter

# --- urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_verdict(host, path, entries):
    best = None
    for h, p, v in entries:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (h.count("."), len(p), v == "block", h + p, v))
    return (best[3], best[4]) if best else (None, "allow" if host else "block")


URLS = [
    None, "", "no scheme", "http://", "http:///en/x", "HTTP://WWW.Example.COM/en/1?x=/en/#y", "http://example.com", "http://example.com/en", "http://example.com/en/", "http://a.b.example.com/en/q",
    "http://www.example.com/en/", "http://x.www.example.com/en/1", "http://notexample.com/en/", "http://net/es/1", "http://a.net/es", "http://a.net/fr/#", "http://a.net#/fr/", "http://com./en/", "http://.com/en/",
    "x://y://example.com/en/", "http://É.com/é/", "http://com:80/en/", "http://user@example.com/en/", "http://example.com?/en/", "http://example.com/english/a", "http://a.org/" + "long/" * 5000, "http://" + "a." * 3000 + "net/fr/1",
]
MORE = [("", "/", "block"), ("com", "", "block"), ("example.com", "/en", "allow"), ("example.com", "/eng", "block"), ("b.example.com", "/en/q/r", "allow"), ("com", "/", "block"), ("org", "/long/long/lo", "block"), ("É.com", "/é/", "block"), ("net", "/es/1/2/3", "allow")]


@pytest.mark.parametrize("entries", [queries.URL_ENTRIES, queries.URL_ENTRIES + MORE, [], MORE + MORE])
@pytest.mark.parametrize("trie_bytes", [url_filter.TRIE_BYTES, 0])
def test_urls_against_every_entry(spark, entries, trie_bytes):
    table = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://a.com/"), (3, "http://a.com/")], "page_id long, url string")
    got = url_filter.judge_urls(table, entries, trie_bytes=-1 if not entries and not trie_bytes else trie_bytes).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None and r.host + r.path != "a.com/":
            assert (r.host, r.path) == plain_parts(URLS[r.page_id])
        assert (r.rule, r.verdict) == plain_verdict(r.host, r.path, entries), (r.host[:50], r.path[:50])


def test_entries_as_a_table_and_other_columns(spark):
    entries = spark.createDataFrame(queries.URL_ENTRIES, url_filter.ENTRY)
    table = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string, rule int")
    want = sorted(url_filter.judge_urls(table.select("page_id", "url"), queries.URL_ENTRIES).collect())
    for most in (url_filter.TRIE_BYTES, 0):
        assert sorted(url_filter.judge_urls(table, entries, trie_bytes=most).collect(), key=lambda r: r.page_id) == sorted(want, key=lambda r: r.page_id)
    assert url_filter.judge_urls(table.limit(0), entries).count() == 0


@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=3).map(".".join), st.text("/ab", max_size=5), st.sampled_from(["allow", "block"])), max_size=12), st.lists(st.sampled_from(["a", "b", "c"]), max_size=4).map(".".join), st.text("/ab", max_size=8))
@settings(max_examples=300, deadline=None)
def test_trie(entries, host, path):
    trie = url_filter.Trie(entries)
    got = trie.judge(trie.hosts(host), path)
    want = plain_verdict(host, path, entries)
    assert got == (want if want[0] is not None else (None, None))


# --- fill in the middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [None, "", " ", "\n\t ", "a", " a", "a ", "é 漢 😀\u00a0x\u2003y", "<P> a b", "a <S", "S> <M <P", "<<S <M <", "< P> <S\x1c>", "\x0b\x0c\r x", "a\x00b c", "tie tie tie", "tie tie tie"]


def test_middles_against_definition(spark):
    rng = random.Random(3)
    texts = ODD * 12 + ["".join(rng.choice("ab é\n<SPM>漢 ") for _ in range(rng.randrange(60))) for _ in range(300)] + ["word and é " * 250_000 + "end", "x" * 2_500_000, " " * 1_500_000]
    rows = list(enumerate(texts)) + [(None, "a b c d"), (7, "shared id"), (7, "shared id")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fill_in_middle.fill_in_middle(table)
    got = fill_in_middle.restore(made).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append((*plain_middle(i, t), t or ""))
    assert len(got) == len(rows)
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored))
    assert {k: sorted(v, key=repr) for k, v in have.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middle_query_and_other_columns(spark):
    table = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n long, output string").withColumnsRenamed({})
    got = {r.doc_id: r for r in fill_in_middle.middle_digests(table.withColumn("form", table.n).withColumn("h1", table.n)).collect()}
    for i, t in enumerate(ODD):
        n, form, prefix, middle, out = plain_middle(i, t)
        assert tuple(got[i]) == (i, n, form, prefix, middle, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert fill_in_middle.middle_digests(table.limit(0)).count() == 0


@given(st.lists(st.tuples(st.text("a é\n<", max_size=20), st.integers(0, 9), st.integers(0, 9), st.sampled_from([0, 1, 2])), max_size=8), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_scatter_and_gather(rows, size):
    """Slices of any size; pieces and rows may be empty."""
    data = [t.encode() for t, *_ in rows]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    body = np.frombuffer(b"".join(data), np.uint8)
    form = np.array([f for *_, f in rows], np.int64)
    _, a, b = fill_in_middle.token_cuts(body, offsets, np.array([x for _, x, _, _ in rows], np.int64), np.array([y for _, _, y, _ in rows], np.int64))
    a, b = np.where(form == 0, offsets[1:], a), np.where(form == 0, offsets[1:], b)
    old, fill_in_middle.SLICE = fill_in_middle.SLICE, size
    try:
        out, at = fill_in_middle.displaced(body, offsets, a, b, form)
        back, back_at = fill_in_middle.gathered(out, at, form)
    finally:
        fill_in_middle.SLICE = old
    for i, d in enumerate(data):
        p, m, s = d[: a[i] - offsets[i]], d[a[i] - offsets[i] : b[i] - offsets[i]], d[b[i] - offsets[i] :]
        assert out[at[i] : at[i + 1]].tobytes() == [d, b"<P>" + p + b"<S>" + s + b"<M>" + m, b"<S>" + s + b"<P>" + p + b"<M>" + m][form[i]]
    assert back.tobytes() == body.tobytes() and list(back_at) == list(offsets)


# --- conversations


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(head, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = defaultdict(list)
    for x in members:
        if x:
            children[x[:-1]].append(x)
    leaves, saved = {}, {}
    for x in sorted(members, key=len, reverse=True):
        leaves[x] = sum(leaves[y] for y in children[x]) or 1
        saved[x] = sum(saved[y] for y in children[x]) + ((len(members[x]) - 1) * len(x[-1][1]) if x else 0)
    out = []
    for x, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(x)))
        out.append((min(cs), len(x), min(members[x[:-1]]) if x else None, len(cs), len(children[x]), leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def trie_rows(spark, rows):
    return sorted((tuple(r) for r in conversation_trie.trie_nodes(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=repr)


def some_conversations(seed, n):
    """Few different turns, so that prefixes are shared and part ways at every depth; some lengths are multiples of a block."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 900), n):
        for turn in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 12, 13])):
            rows.append((c, rng.choice([turn, turn, None]) if rng.random() < 0.1 else turn, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", rng.choice(["hello", "hello", "hello", "é", "", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_definition(spark, seed):
    rows = some_conversations(seed, 250)
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_awkward_conversations(spark):
    rows = [
        (None, 0, "user", "nobody's"), (101, 0, "user", "gone"), (200, 1, "user", "b"), (200, 1, "user", "a"), (200, 1, "user", "a"), (200, None, None, None), (201, 0, "user", "x"), (205, 5, "", ""), (205, 5, "", ""),
        (300, 0, "user", "x" * 200_000), (301, 0, "user", "y"), *[(302, i, "user", "same") for i in range(12)], *[(303, i, "user", "same") for i in range(12)], *[(304, i, "user", "same") for i in range(8)],
    ]
    want = plain_trie(rows)
    assert trie_rows(spark, rows) == want
    alone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1][:1]
    turnless = [(alone[0], 0, "user", "lost, as its head is absent")]
    assert trie_rows(spark, turnless) == plain_trie(turnless) == [(alone[0], 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone[0]).encode()).hexdigest())]
    other = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "turn AS place", "role AS a", "1 AS depth", "2 AS block", "3 AS part", "4 AS own", "text AS digest")
    assert sorted((tuple(r) for r in conversation_trie.trie_nodes(other).collect()), key=repr) == want
    assert trie_rows(spark, []) == []


def test_one_conversation_over_many_partitions(spark):
    """A conversation of many segments lies in several range partitions; another one leaves it deep down."""
    rows = [(400, i, "user", f"turn {i % 50}") for i in range(2500)] + [(499, i, "user", f"turn {i % 50}" if i != 1700 else "other") for i in range(2500)] + [(c, 0, "user", "turn 0") for c in range(401, 440)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_many_copies(spark):
    """One list of ids over several stretches, and copies that own no node."""
    rows = [(c, i, "user", "copy") for c in range(9000, 18_000, 3) for i in range(6)]
    assert trie_rows(spark, rows) == plain_trie(rows)
