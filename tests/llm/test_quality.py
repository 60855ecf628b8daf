from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meridia.llm import _tokens as tk
from meridia.llm import quality as op

TEST = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{TEST}/labels.parquet")
    out = op.op5_quality(spark, TEST)
    got = out.join(labels, "doc_id").where("held_out").groupBy("quality").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    rate = {r.quality: r.p for r in got}
    assert rate[1] > 0.97 and rate[0] < 0.2, got
    assert out.count() == 1000


def test_tokens_and_shapes():
    _, _, data, offs = next(tk.blocks(pa.array(["The the THE!! cat, cat, 12", "", None, "cat,"])))
    word, shape, first = op.tokens(data, offs)
    assert first.tolist() == [0, 6, 6, 6, 7]
    assert word[0] == word[1] == word[2] and word[3] == word[4] == word[6]
    assert shape[3] != shape[4] and shape[3] == shape[6] and len({*shape[:3].tolist()}) == 3


def test_features_do_not_depend_on_blocks():
    texts = ["One two.", "", "THREE!! four", "x y z " * 50]
    model = op.train(texts * 5, np.array([1, 0, 0, 1] * 5))
    whole = np.concatenate([model.scores(d, o) for _, _, d, o in tk.blocks(pa.array(texts))])
    single = np.concatenate([model.scores(d, o) for t in texts for _, _, d, o in tk.blocks(pa.array([t]))])
    assert np.allclose(whole, single)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, "", "s"), (None, "q " * 30000, "s"), (1, "a b c", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for used in (labels, labels.limit(0), labels.where("quality = 1")):
        got = op.score(docs, op.fit(docs, used), "doc_id").collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert op.score(docs.limit(0), op.fit(docs, labels), "doc_id").count() == 0
    assert op.accepted(docs, labels).columns == docs.columns


def test_the_byte_bound_takes_rows_of_any_length(spark, monkeypatch):
    rows = [(i, ("long " if i % 2 else "short ") * (400 if i % 2 else 4), i // 2 % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(op, "train", lambda texts, labels: seen.append(texts))
    op.fit(docs, labels, sample_bytes=60_000)
    assert 45_000 < sum(map(len, seen[0])) <= 60_000
    assert 0.3 < sum(len(t) > 100 for t in seen[0]) / len(seen[0]) < 0.7
    op.fit(docs.where("doc_id = 1"), labels, sample_bytes=10)
    assert len(seen[1]) == 1


def test_vectors_and_features_equal_plain_loops():
    texts = ["The cat sat, the CAT sat!", "", "one", "a b a b c 12 x9 -- é ü", "cat"]
    (_, _, data, offs), = tk.blocks(pa.array(texts))
    word, shape, first = op.tokens(data, offs)
    # A text alone has the tokens that it has among others.
    for i, t in enumerate(texts):
        alone = [x for *_, d, o in tk.blocks(pa.array([t])) for x in op.tokens(d, o)[:2]]
        assert not t or (alone[0].tolist() == word[first[i] : first[i + 1]].tolist() and alone[1].tolist() == shape[first[i] : first[i + 1]].tolist())
        assert first[i + 1] - first[i] == len(t.split())
    index, shapes = op.index_vectors(op.BUCKETS), op.index_vectors(op.SHAPES, seed=2)
    total = {}
    for i in range(len(texts)):
        own = list(range(first[i], first[i + 1]))
        for k in own:
            v = index[word[k]] + shapes[shape[k]]
            for j in (k - 1, k + 1):
                if j in own:
                    v = v + index[word[j]]
            total[word[k]] = total.get(word[k], 0) + v
    got = op.word_vectors(texts)
    for w, v in total.items():
        want = v if np.any(v) else index[w]
        assert np.allclose(got[w], want / np.linalg.norm(want), atol=1e-5)
    model = op.Quality(got, shapes, np.zeros(1), np.ones(1), [], 1.0, 0.5)
    x = model.features(data, offs)
    for i in range(len(texts)):
        own = range(first[i], first[i + 1])
        mean = np.mean([np.r_[got[word[k]], shapes[shape[k]]] for k in own], axis=0) if len(own) else np.zeros(x.shape[1] - 1)
        assert np.allclose(x[i, :-1], mean, atol=1e-5) and np.isclose(x[i, -1], np.log1p(len(own)))
