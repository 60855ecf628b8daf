from __future__ import annotations

import hashlib
import random
import re

from meridia.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    windows = {}
    for k, t in items:
        w = norm(t)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for d, t in docs:
        w, hit, who = norm(t), set(), set()
        for length in {len(x) for x in windows}:
            for i in range(len(w) - length + 1):
                k = windows.get(tuple(w[i : i + length]))
                if k is not None:
                    hit |= set(range(i, i + length))
                    who |= k
        ids = sorted(str(x) for x in who if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture(seed=3):
    rnd = random.Random(seed)
    vocab = [f"W{i}" for i in range(40)] + ["É", "le", "The"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 4, 9, 10, 11, 25, 40]) if k > 2 else 30))) for k in range(25)]
    items = [(k, t) for k, t in items if len(t.split()) > 1] + [(90, None), (91, "..."), (92, items[1][1]), (None, items[2][1]), (93, "le le le")]
    docs = []
    for d in range(80):
        w = [rnd.choice([*vocab, "other", "zz"]) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            t = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, 10)
            w += t[a : a + rnd.randint(3, 30)]
        docs.append((d, rnd.choice([" ", ", ", "-"]).join(w)))
    return [*docs, (80, None), (81, ""), (82, "le " * 500), (82, "le " * 500), (None, docs[3][1])], items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, spans string").repartition(4),
        spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, items string"),
    )


def digest(df):
    out = []
    for r in df.collect():
        out.append((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    for seed in (3, 4):
        docs, items = fixture(seed)
        d, i = frames(spark, docs, items)
        assert digest(op.contamination(d.drop("spans"), i)) == brute(docs, items)


def test_item_blocks_give_the_same(spark):
    docs, items = fixture(7)
    docs = list(dict.fromkeys(docs))
    d, i = frames(spark, docs, items)
    assert digest(op.contamination(d.drop("spans"), i, max_item_words=60)) == brute(docs, items)


def test_item_blocks_keep_repeated_rows(spark):
    docs, items = fixture(7)
    d, i = frames(spark, docs, items)
    assert len(docs) > len(set(docs))
    assert digest(op.contamination(d.drop("spans"), i, max_item_words=60)) == brute(docs, items)
    one, several = op.contamination(d.drop("spans"), i), op.contamination(d.drop("spans"), i, max_item_words=60)
    assert sorted(one.collect(), key=str) == sorted(several.collect(), key=str)
    for least in (1, 12):
        cut = [op.contamination(d.drop("spans"), i, max_item_words=n, cut=(least, 0.9)).collect() for n in (60, 1_000_000)]
        assert sorted(cut[0], key=str) == sorted(cut[1], key=str)


def test_clean_removes_spans_and_keeps_the_rest(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = [(1, "Alpha beta. " + item.upper() + " gamma " + "delta " * 30), (2, item), (3, "nothing here"), (4, None)]
    d, i = frames(spark, docs, [(5, item)])
    out = op.clean(d, i)
    assert out.columns == d.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "Alpha beta.  gamma " + "delta " * 30, 3: "nothing here", 4: None}


def test_empty_tables(spark):
    docs, items = fixture()
    d, i = frames(spark, docs, items)
    assert op.contamination(d.limit(0).drop("spans"), i).count() == 0
    assert all(r.n_hit == 0 for r in op.contamination(d.drop("spans"), i.limit(0)).collect())
