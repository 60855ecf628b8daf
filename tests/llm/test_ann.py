from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from meridia.llm import ann as op

SCHEMA = "vec_id long, embedding array<float>, score double, v int"


def brute(rows, ids, top=5):
    known = {i: np.array(v, np.float64) for i, v in rows}
    x = np.array(list(known.values()))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in ids:
        unit = known[q] / np.linalg.norm(known[q])
        s = [(-a, i) for a, i in zip((x @ unit).tolist(), known, strict=True) if i != q]
        out[q] = [(i, -x) for x, i in sorted((round(a, 12), i) for a, i in s)[:top]]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    got = {}
    for r in op.op7_ann(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    assert set(got) == set(want)
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    total = sum(map(len, want.values()))
    print(sf, "recall", hit / total)
    assert hit >= 0.9 * total
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        for _, v, s in found:
            exact = dict(want[q]).get(v)
            assert exact is None or abs(exact - s) < 1e-9


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)]
    rows += [(100 + i, [1.0, 2.0] + [0.0] * 6) for i in range(300)]
    bad = [(50, None), (150_000, [0.0] * 8), (200_000, [1.0, None] + [0.0] * 6), (250_000, [float("nan")] * 8), (300_000, [float("inf")] * 8), (350_000, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 0.5, 1) for r in [*rows, *bad, rows[3], rows[3]] if r[0] != 50 or r[1] is None], SCHEMA)
    rows = [r for r in rows if r[0] != 50]
    vectors = op.usable(df)
    got = {}
    for r in op.nearest(vectors, vectors.where("vec_id % 50 = 0"), least=20).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[150] == [(i, 1.0) for i in range(100, 105)] or [v for v, _ in got[150]] == [100, 101, 102, 103, 104]
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    assert set(got) == {100, 150, 200, 250, 300, 350}
    few = op.usable(df.where("vec_id in (100, 3)"))
    assert [(r.vec_id, r.rank) for r in op.nearest(few, few.where("vec_id = 100")).collect()] == [(3, 1)]
    none = vectors.limit(0)
    assert op.nearest(none, none).count() == 0


def test_copies_take_one_place_of_the_shortlist(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).round(3)
    rows = list(enumerate(x.tolist()))
    ids = list(range(0, 400, 50))

    def near(q, r):
        step = rng.normal(size=16)
        return (x[q] + r * step / np.linalg.norm(step)).round(4).tolist()

    for q in ids:
        # Two groups of copies, each larger than the shortlist, and six rows a little nearer than they are.
        for group in range(2):
            far = near(q, 1.05)
            rows += [(1000 + 200 * q + 100 * group + i, far) for i in range(60)]
        rows += [(100_000 + q + i, near(q, 1.0)) for i in range(1, 7)]
    vectors = op.usable(spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], "vec_id long, embedding array<double>, score double, v int"))
    got = {}
    for r in op.nearest(vectors, vectors.where(f"vec_id in ({', '.join(map(str, ids))})"), least=40, slack=0.0, books=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(rows, ids)
    hit = sum(len({v for _, v in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit == 40, hit


def test_shortlist_is_measured(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 8)).tolist())]
    vectors = op.usable(spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], "vec_id long, embedding array<double>, score double, v int"))
    queries = vectors.where("vec_id % 50 = 0")
    got = {}
    # One codebook of few words says little, so nearly all rows have to be reranked.
    for r in op.nearest(vectors, queries, least=1, books=1, recall=1.0, slack=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(rows, [0, 50, 100, 150, 200, 250])
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == {q: [v for v, _ in w] for q, w in want.items()}


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_recall_where_the_shortlist_is_small(spark, monkeypatch, kind):
    """50,000 vectors: recall of 0.9 at least with under a fiftieth of them reranked."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50_000, 32)).astype(np.float32)
    if kind == "clustered":
        x = 0.3 * x + rng.normal(size=(200, 32)).astype(np.float32)[rng.integers(0, 200, len(x))]
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.float32()))
    vectors = op.usable(spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": lists})))
    used, real = [], op.measured_shortlist
    monkeypatch.setattr(op, "measured_shortlist", lambda *a: used.append(real(*a)) or used[0])
    got = {}
    for r in op.nearest(vectors, vectors.where("vec_id % 250 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(list(enumerate(x.tolist())), range(0, len(x), 250))
    hit = sum(len(got[q] & {v for v, _ in want[q]}) for q in want)
    print(kind, "shortlist", used, "recall", hit / (5 * len(want)))
    assert hit >= 0.9 * 5 * len(want) and used[0] < len(x) // 50


def test_repeated_ids_and_dimensions(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (100, [1.0, 2.0, 3.0]), (3, [3.0, 2.0, 1.0])]
    vectors = op.usable(spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA))
    got = {}
    for r in op.nearest(vectors, vectors.where("vec_id % 50 = 0"), top=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got[50]) == [(1, 2), (1, 50), (1, 50), (2, 1), (2, 1), (2, 1), (3, 1), (3, 1), (3, 1)]
    assert got[100] == [(1, 3)]
