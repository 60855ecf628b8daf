from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import language_id as op

TEST = "/root/testdata/sf0.001"


def test_probabilities_sum_to_one():
    texts = ["the cat sat on the mat", "that then there the"]
    grams = np.concatenate([op.ngrams(op.symbols(t), 3) for t in texts])
    g, n = np.unique(grams, return_counts=True)
    model = op.Model.fit({"x": (g, n)}, 3)
    alphabet = sorted({int(c) for t in texts for c in op.symbols(t).tolist()})
    for context in ((32, ord("t")), (ord("t"), ord("h")), (ord("q"), ord("q")), (ord("a"), ord("t"))):
        packed = np.array([(context[0] << 32) | (context[1] << 16) | c for c in [*alphabet, 0x3FF]], np.uint64)
        total = np.exp(model.log_probs(packed, 3)).sum()
        assert abs(total - 1) < 1e-3, (context, total)


def test_symbols():
    assert "".join(map(chr, op.symbols("Hi, 42 Yoü!").tolist())) == " hi yoü "
    assert len(op.symbols("123 !")) == 0 and len(op.symbols(None)) == 0 and len(op.symbols("𝒳")) == 3
    assert len(op.symbols("😀 👍🏽")) == 0 and len(op.symbols("a😀𝒳")) == 5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TEST}/documents.parquet")
    out = op.op1_language_id(spark, TEST)
    got = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.95
    assert out.count() == docs.count()


def test_edge_cases(spark):
    rows = [(i, ["aaa bbb", "ccc ddd"][i % 2] * 5, ["a", "c"][i % 2], "k") for i in range(40)]
    rows += [(None, "aaa", "a", "k"), (50, None, "a", "k"), (51, "", None, "k"), (52, "12 34", "a", "k"), (53, "aab " * 20000, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = op.fit(docs.drop("score"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in op.predict(docs, model).collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0) and got[53][0] == "a" and got[0][0] == "a" and got[1][0] == "c"
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = op.fit(docs.limit(0))
    assert {r.lang_pred for r in op.predict(docs, empty).collect()} == {"und"}
    assert op.predict(docs.limit(0), model).count() == 0


def test_all_ngrams_are_kept(spark):
    rng = np.random.default_rng(1)
    # More distinct n-grams than 400,000, almost all of them once.
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 50_000))) for _ in range(9)]
    want, n = np.unique(np.concatenate([op.ngrams(op.symbols(t), op.ORDER) for t in texts]), return_counts=True)
    docs = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    grams, counts = op.ngram_counts(docs)["x"]
    sort = np.argsort(grams)
    assert len(want) > 400_000 and (grams[sort] == want).all() and (counts[sort] == n).all()


def test_only_the_calibration_rows_are_left_out(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abc def", "x") for i in range(400)], "doc_id long, text string, lang string")
    seen, real = [], op.ngram_counts
    monkeypatch.setattr(op, "ngram_counts", lambda rows, *more: seen.append(rows.count()) or real(rows, *more))
    op.fit(docs, calibration_texts=3)
    assert seen == [397]


def brute(texts, order, alphabet):
    """Interpolated Kneser-Ney by dictionaries: a function from a text to its nats per character."""

    def grams(text, k):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [tuple(("\0" * order + s)[order + i - k + 1 : order + i + 1]) for i in range(1, len(s))]

    tables = {order: Counter(g for t in texts for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    facts = {}
    for k, table in tables.items():
        once, twice = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in table.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        facts[k] = once / (once + 2 * twice) if once and twice else 0.5, total, kinds

    def p(g):
        if not g:
            return 1 / (alphabet + 1)
        d, total, kinds = facts[len(g)]
        context = g[:-1]
        if not total[context]:
            return p(g[1:])
        return max(tables[len(g)][g] - d, 0) / total[context] + d * kinds[context] / total[context] * p(g[1:])

    return lambda text: -sum(math.log(p(g)) for g in grams(text, order)) / len(grams(text, order))


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    words = {"x": "the that then there a an and anna nan".split(), "y": "der die das den dann da an und undine".split()}
    texts = {lang: [" ".join(rnd.choice(w) for _ in range(rnd.randint(1, 30))) for _ in range(40)] for lang, w in words.items()}
    docs = spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own], "lang string, text string")
    model = op.Model.fit(op.ngram_counts(docs))
    alphabet = len({c for own in texts.values() for t in own for c in t} | {" "})
    want = {lang: brute(own, op.ORDER, alphabet) for lang, own in texts.items()}
    for t in ["the den", "undine", "q zebra, an!", "nan nan", *texts["x"][:5], *texts["y"][:5]]:
        got = model.entropy(t)
        assert got.tolist() == pytest.approx([want[lang](t) for lang in model.langs], rel=1e-5)
        assert model.predict(t)[0] == min(model.langs, key=lambda lang: want[lang](t))
