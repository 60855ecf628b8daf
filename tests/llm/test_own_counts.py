from __future__ import annotations

import numpy as np
import pyarrow as pa

from meridia.llm import minhash_dedup as mh


def test_own_shingles_without_a_join_of_shingles_by_node(spark):
    texts = spark.createDataFrame([(b"a", "one two three four five six"), (b"b", "one two three four five seven"), (b"d", "one two three four five six")], "node binary, text string")
    nodes = spark.createDataFrame([(b"a", b"a"), (b"b", b"b"), (b"d", b"a")], "node binary, c binary")
    out = mh._own_counts(nodes, texts, 5)
    assert {bytes(r.node): r.own for r in out.collect()} == {b"a": 1, b"b": 1, b"d": 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan[: plan.index("MapInArrow")]


def _own(rows):
    """Own counts of rows (h, c, nodes) of all tasks, by plain loops."""
    components, nodes = {}, {}
    for h, c, of in rows:
        components.setdefault(h, set()).update([c] if c is not None else [1, 2])
        nodes.setdefault(h, []).extend(of or [])
    out = {}
    for h, cs in components.items():
        for n in nodes[h] if len(cs) == 1 else []:
            out[n] = out.get(n, 0) + 1
    return out


def test_near_copies_make_a_row_for_each_distinct_shingle_of_a_task():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts, comps = [], []
    for i in range(40):
        words = list(base)
        words[int(rng.integers(60))] = f"x{i // 2}"
        texts.append(" ".join(words))
        comps.append(b"c%d" % (i // 4))
    nodes = [b"n%d" % i for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.binary()), "c": pa.array(comps, pa.binary()), "text": texts})
    sets = [set(mh.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0].tolist()) for t in texts]
    want = {}
    for i in range(40):
        others = set().union(*(sets[j] for j in range(40) if comps[j] != comps[i]))
        if n := len(sets[i] - others):
            want[nodes[i]] = n
    for size in (1, 500, 1 << 19):
        rows = [r for b in mh.shingle_rows(5, size)(batch.slice(i, 8) for i in range(0, 40, 8)) for r in zip(*(b.column(x).to_pylist() for x in ("h", "c", "nodes")))]
        assert _own(rows) == want
    # All in one task, once each: 2240 labelled shingles before.
    assert len(rows) == len(set().union(*sets)) < sum(map(len, sets)) / 3
