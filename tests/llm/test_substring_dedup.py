from __future__ import annotations

import hashlib
import random
import re

from meridia.llm import substring_dedup as op

SCHEMA = "doc_id long, text string, rk string, known string"


def brute(rows, n):
    first, words = {}, {}
    for k, (doc, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words[k] = w
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), []).append((doc, i, k))
    out = []
    for k, (doc, _) in enumerate(rows):
        w, gone = words[k], set()
        for i in range(len(w) - n + 1):
            if any((d < doc) or (k == kk and p < i) for d, p, kk in first[tuple(w[i : i + n])]):
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def fixture():
    rnd = random.Random(5)
    vocab = [f"w{i}é" for i in range(300)] + ["a", "the", "\x00z"]
    base = [rnd.choice(vocab) for _ in range(400)]
    rows = []
    for d in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            at, ln = rnd.randint(0, 350), rnd.randint(5, 50)
            cut = rnd.randint(0, len(w))
            w = w[:cut] + base[at : at + ln] + w[cut:]
        rows.append((d, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(200, None), (201, ""), (202, "x " * 500), (203, rows[7][1]), (204, rows[7][1]), (205, "x " * 300), (205, "x " * 300), (206, "y y " * 3000)]
    return rows


def test_matches_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(a, b, "k", "v") for a, b in rows], SCHEMA).repartition(5)
    for n, inner in ((20, 8), (7, 3)):
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op.removals(docs, n, inner).collect())
        assert got == brute(rows, n)


def test_spans_cover_what_goes(spark):
    docs = spark.createDataFrame([(a, b, "", "") for a, b in fixture()], SCHEMA)
    for r in op.removals(docs).collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert all(x[1] < y[0] for x, y in zip(r.spans, r.spans[1:], strict=False))


def test_null_ids_and_empty_table(spark):
    text = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text, "", ""), (3, text, "", ""), (None, text, "", "")], SCHEMA)
    assert {(r.doc_id, r.n_removed) for r in op.removals(docs).collect()} == {(None, 30), (3, 0)}
    assert op.removals(docs.limit(0)).count() == 0
