from __future__ import annotations

import random
import re

import numpy as np

from meridia.llm import minhash_dedup as op

SCHEMA = "doc_id long, text string, class_id string, rk string"


def labelled(text, k=5):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    g = [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    seen, out = {}, []
    for x in g:
        seen[x] = seen.get(x, -1) + 1
        out.append((x, seen[x]))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(rows):
    n = len(rows)
    seq = [labelled(t or "") for _, t in rows]
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = seq[i], seq[j]
            same = a and a == b or (not a and rows[i][1] is not None and rows[i] == rows[j])
            if not same and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                m = lcs(a, b)
                same = m / (len(a) + len(b) - m) >= 0.8
            if same:
                up[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], min(groups[find(i)]), len(groups[find(i)])) for i in range(n))


def fixture():
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(14):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 30, 90, 200]))]
        for c in range(rnd.randint(1, 7)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 9])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(w).title() if c == 1 else ", ".join(w)))
    rows += [(900, "only three words"), (901, "Only THREE words!"), (902, "only three other"), (903, "..."), (904, ""), (906, "a " * 4000), (907, "a " * 4000 + "b")]
    return rows


def test_matches_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in op.near_duplicates(docs).collect())
    small = [r for r in rows if len(r[1]) < 5000]
    want = brute(small) + [(906, 906, 2), (907, 906, 2)]
    assert got == sorted(want)
    kept = op.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})


def test_hub_of_a_large_bucket(spark):
    """Copies linked only through their base, more than are compared at once."""
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(900)]
    base = [rnd.choice(vocab) for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for d in range(60):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(150)] = f"x{rnd.random()}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in op.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(40)] + [(b"z1", b"z2"), (b"z3", b"z2")]
    rnd.shuffle(edges)
    got = {bytes(r.node): bytes(r.component) for r in op.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {f"{i:03}".encode(): b"000" for i in range(1, 41)} | {b"z2": b"z1", b"z3": b"z1"}


def test_alignment_is_the_common_subsequence():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        a = rnd.permutation(60).astype(np.uint64)
        b = a.copy()
        for _ in range(rnd.integers(0, 6)):
            i, j = rnd.integers(0, 60, 2)
            b[i], b[j] = b[j], b[i]
        m = lcs(a.tolist(), b.tolist())
        if m / (120 - m) >= op.SIMILARITY:
            assert abs(op.aligned(a, b) - m / (120 - m)) < 1e-9
        else:
            assert op.aligned(a, b) < op.SIMILARITY


def test_edge_cases(spark):
    rows = [(None, "same text of a few words here"), (None, "same text of a few words here"), (3, None), (4, None), (5, "same text of a few words here"), (5, "same text of a few words here")]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in op.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 5, 4), (None, 5, 4), (5, 5, 4), (5, 5, 4), (3, 3, 1), (4, 4, 1)], key=str)
    assert sorted(r.doc_id for r in op.deduplicate(docs).collect()) == [3, 4, 5]
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_recall_by_edits(spark):
    """Copies at known numbers of changed words: all pairs of similarity 0.8 or more are found."""
    rnd = random.Random(21)
    vocab = [f"w{i}" for i in range(5000)]
    rows, pairs = [], []
    for g in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([60, 150, 400]))]
        edited = list(base)
        for at in rnd.sample(range(len(base)), max(1, len(base) * (g % 5) // 200)):
            edited[at] = f"x{rnd.random()}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(edited))]
        a, b = labelled(rows[-2][1]), labelled(rows[-1][1])
        m = lcs(a, b)
        pairs.append((2 * g, m / (len(a) + len(b) - m)))
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in op.near_duplicates(docs).collect()}
    near = [d for d, s in pairs if s >= 0.8]
    assert len(near) > 25 and any(s < 0.8 for _, s in pairs)
    assert all(got[d] == got[d + 1] for d in near)
    assert all(got[d] != got[d + 1] for d, s in pairs if s < 0.8)


def test_parity_bounds_the_difference():
    rnd = np.random.default_rng(4)
    for n in (3, 40, 300):
        a = rnd.integers(0, 2**62, n).astype(np.uint64)
        b = np.r_[a[: n // 2], rnd.integers(0, 2**62, n - n // 2).astype(np.uint64)]
        bits = op.parity(np.r_[a, b], np.repeat([0, 1], n), 2)
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in (bits[0] ^ bits[1]).tolist())
        only = len(set(a.tolist()) ^ set(b.tolist()))
        assert differ <= only and (n > 40 or differ >= 0.8 * only)


def test_of_equal_rows_one_stays(spark):
    rows = [(1, "the same text here", "b", 1), (1, "the same text here", "a", 2), (1, None, "a", 3), (1, "", "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, n int").repartition(3)
    first = op.deduplicate(docs).collect()
    again = op.deduplicate(docs.orderBy("n", ascending=False)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 3
    assert {(r.text, r.n) for r in first if not r.text} == {(None, 3), ("", 4)}
