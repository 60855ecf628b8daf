from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

TEST = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{TEST}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, TEST)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert 0 < len(rows) <= before.count()
        assert all(r.n_chars == len(r.text) for r in rows)
        before = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.run(spark, TEST)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in before.collect())


def test_planted_cases(spark, tmp_path):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]

    def prose(n):
        w = [rnd.choice(vocab) for _ in range(n)]
        return "\n".join(" ".join(w[i : i + 25]) + "." for i in range(0, n, 25))

    item = " ".join(rnd.choice(vocab) for _ in range(30))
    clean = [(i, prose(rnd.randint(60, 200)), f"s{i % 15}") for i in range(120)]
    near = clean[3][1].replace(clean[3][1].split()[40], "changed", 1)
    footer = "A line that every site shares."
    rows = [(i, t + f"\n{footer}", s) for i, t, s in clean]
    rows += [(200, rows[5][1], "s1"), (201, near, "s2"), (202, clean[7][1] + " " + item + " " + prose(80), "s3"), (203, item, "s4")]
    junk = [(300 + i, "BUY!! NOW!! " * 60, "s5") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows + junk], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _, _ in rows] + [(i, 0, 0) for i, _, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows_after = stage(spark, before, str(tmp_path)).collect()
        kept.append({r.doc_id: r.text for r in rows_after})
        before = spark.createDataFrame(rows_after, docs.schema)
    ids = {i for i, _, _ in rows}
    assert set(kept[0]) == ids
    assert sum(footer in t for t in kept[1].values()) == 1
    assert set(kept[2]) == ids - {200, 201}
    assert set(kept[3]) == ids - {200, 201, 203}
    assert item not in kept[3][202] and clean[7][1] in kept[3][202]
    assert all(kept[3][i].removesuffix(f"\n{footer}") == t for i, t, _ in clean)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n_lines int, row string, rk string, Score double"


def _tables(spark, path, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_edge_cases_through_all_stages(spark, tmp_path):
    long = " ".join(f"word{i % 977} other{i}" for i in range(60_000))
    texts = ["a plain text of a few words", "another text that says something else", None, "", "same rows twice in here", "same rows twice in here", long]
    rows = [(i if i != 5 else 4, t, "en", None if i == 3 else f"s{i}", len(t or ""), 7, "r", "k", 0.5) for i, t in enumerate(texts)]
    rows.append((None, "text without an id at all", None, None, None, None, None, None, None))
    before = _tables(spark, tmp_path, rows)
    columns = before.columns
    # Stages after the classifier, whose two labels say little, over all rows.
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == columns, name
        kept = after.collect()
        before = spark.createDataFrame(kept, before.schema)
    got = {r.doc_id: r for r in kept}
    assert len(kept) == 7 and set(got) == {0, 1, 2, 3, 4, 6, None}
    assert got[2].text is None and got[3].text == "" and got[6].text == long and got[6].n_chars == len(long)
    assert got[0]._n_lines == 7 and got[0].row == "r" and got[0].Score == 0.5
    scored = corpus_pipeline.STAGES[0][1](spark, before, str(tmp_path))
    assert scored.columns == columns and scored.count() <= 7
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.tokenize(spark, before, str(tmp_path)).collect()}[2] == 0


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
