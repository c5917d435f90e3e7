"""The license scan: one row an input row, whatever the ids; labels and score against brute force."""

import re

import numpy as np

from peakloom.llm import license_scan


def test_rows_with_shared_or_null_ids(spark):
    rows = [(1, "x under the mit"), (1, "y under the mit"), (None, "the mit license"), (None, "under the mit license"), (2, None), (2, None), (3, "cc by nc"), (3, "cc by nc")]
    got = license_scan.license_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    said = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.base_labels, r.labels) for r in got.collect())
    assert said == [(0, 3, 0, None, "", ""), (0, 4, 1, 0, "mit", "mit,mit-notice"), (1, 4, 0, None, "", ""), (1, 4, 0, None, "", ""), (2, 0, 0, None, "", ""), (2, 0, 0, None, "", ""), (3, 3, 1, 0, "cc-by-nc", "cc-by-nc"), (3, 3, 1, 0, "cc-by-nc", "cc-by-nc")]


def brute(text):
    """(labels, score) from every diagonal and those up to NEAR above it, place by place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    labels, score = set(), 0.0
    for table, near, share in ((license_scan.PHRASES, 0, 1.0), (license_scan.TEMPLATES, license_scan.NEAR, license_scan.SHARE)):
        for template, label in table.items():
            q = template.split()
            held = {}
            for place in range(len(w) - 2):
                for at in range(len(q) - 2):
                    if w[place : place + 3] == q[at : at + 3]:
                        held.setdefault(place - at, set()).add(at)
            for d in held:
                own = len(set().union(*(held.get(d + i, ()) for i in range(near + 1)))) / (len(q) - 2)
                if own >= share:
                    labels.add(label)
                if near or own == 1:
                    score = max(score, own)
    return ",".join(sorted(labels)), round(score, 6)


def test_labels_and_score_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "released under the released under the released under the", "released under the " * 4000, "under the mit license " * 3]
    for template in [*license_scan.TEMPLATES, *license_scan.PHRASES]:
        q = template.split()
        for _ in range(6):
            t = [x for x in q if rng.random() > 0.1]
            for _ in range(int(rng.integers(0, 3))):
                t.insert(int(rng.integers(0, len(t) + 1)), "word%d" % rng.integers(9))
            texts.append(" ".join(["x"] * int(rng.integers(0, 5)) + t + q[: int(rng.integers(0, len(q)))]))
    got = {r.doc_id: r for r in license_scan.license_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert (got[i].labels, got[i].score) == brute(text), text
    assert (got[2].labels, got[2].score) == ("", 0.333333) and (got[3].labels, got[3].n_words) == ("", 12000)


def test_clashing_columns(spark):
    clash = spark.createDataFrame([(1, "cc by nc", 5, "g", [1])], "doc_id long, text string, row long, gram string, places array<int>")
    assert license_scan.license_digests(clash).first().base_labels == "cc-by-nc"


def test_one_span_a_copy(spark):
    template = next(iter(license_scan.TEMPLATES))
    text = " ".join(["a", *template.split()[:9], "b", *template.split()[9:], "c"])
    votes = license_scan.materialize(license_scan.license_votes(spark.createDataFrame([(1, text)], "doc_id long, text string")), "votes")
    spans = license_scan.license_spans(votes).where("score > 0.6").collect()
    assert [(s.label, s.start) for s in spans] == [("mit-text", 1)]
