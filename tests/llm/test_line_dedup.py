from __future__ import annotations

import random

from meridia.llm import line_dedup as op

SCHEMA = "doc_id long, text string, source string, gone string, rk string"


def brute(rows, t):
    sites, first = {}, {}
    for d, text, s in rows:
        for x in (text or "").split("\n"):
            x = x.strip(" ")
            if x:
                if s is not None:
                    sites.setdefault(x, set()).add(s)
                k = d if d is not None else 2**63
                first[x] = min(first.get(x, k), k)
    out = []
    for d, text, _ in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        kept, seen, n, gone = [], set(), 0, 0
        for raw in text.split("\n"):
            x = raw.strip(" ")
            bad = bool(x) and len(sites.get(x, ())) >= t and not (first[x] == (d if d is not None else 2**63) and x not in seen)
            seen.add(x)
            n += bool(x)
            gone += bad
            if not bad:
                kept.append(raw)
        out.append((d, "\n".join(kept), n, gone))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(2)
    pool = [f"line {i}" for i in range(30)]
    rows = [(d, "\n".join(rnd.choice([rnd.choice(pool), f"own {d} {i}", "", "  "]) + rnd.choice(["", " "]) for i in range(rnd.randint(0, 9))), rnd.choice([*"abcdefgh", None])) for d in range(150)]
    rows += [(200, None, "a"), (201, "", "b"), (202, "line 1\nline 1\nline 1", "c"), (202, "line 1\nline 1\nline 1", "c"), (None, "line 2", "d"), (203, "line 3\n" * 3000, "e")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    for t in (2, 5, 8):
        got = sorted(((r.doc_id, r.text, r._n_lines, r._n_removed) for r in op.line_dedup(docs, t).collect()), key=str)
        assert got == brute(rows, t)
    assert op.line_dedup(docs.limit(0)).count() == 0
    assert op.line_dedup(docs).columns == [*docs.columns, "_n_lines", "_n_removed"]
