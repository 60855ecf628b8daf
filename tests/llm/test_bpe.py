from __future__ import annotations

import random

import numpy as np
import pytest

from meridia.llm import bpe as op

tokenizers = pytest.importorskip("tokenizers")

SAMPLES = [
    "", " ", "Hello  World's he'd I'M x'RE", "İstanbul ΟΔΥΣΣΕΥΣ Σ straße", "été ẛ̣", "12345 ³½ Ⅷ a_b-c__d", "a\x1cb \x85c d\xa0e​f",
    "<|startoftext|>hi<|endoftext|> <|nothing|>", "日本語テスト 한국어 👍🏽👨‍👩‍👧", "\x00\x01 �", "it's''s 'S", "́abc x́", "tab\tnew\nline\r\n",
]


@pytest.fixture(scope="module")
def lib():
    return tokenizers.Tokenizer.from_file(op.default_path())


def check(lib, bpe, text):
    want = lib.encode(text, add_special_tokens=False).ids
    ids, decoded = bpe.text(text)
    assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
    assert decoded == lib.decode(want, skip_special_tokens=False) == bpe.decode(ids)


def test_equals_library(lib):
    bpe, rnd = op.Bpe(cache=50), random.Random(1)
    for s in SAMPLES:
        check(lib, bpe, s)
    chars = "abcdeéßÀΣσ 's't1²,.!?-_\n\t́<|>日İ"
    for _ in range(1500):
        check(lib, bpe, "".join(rnd.choice(chars) for _ in range(rnd.randint(1, 30))))


def test_tree_concatenation_equals_whole_encoding(lib):
    bpe, rnd = op.Bpe(), random.Random(2)
    for alphabet in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "theinanre", "éa日"):
        for n in (2, 50, 700, 3000):
            s = "".join(rnd.choice(alphabet) for _ in range(n))
            want = lib.encode(s, add_special_tokens=False).ids
            for leaf in (1, 3, 64, 257):
                assert bpe.tree([bpe.merge(x) for x in bpe.leaves(s.encode(), leaf)]) == want


def test_operator_with_long_pieces(spark, lib):
    rnd = random.Random(4)
    long = "".join(rnd.choice("etaoins") for _ in range(900))
    texts = [*SAMPLES, None, long, f"x {long}<|endoftext|>{long[::-1]}! {long}", "!" * 500, "!" * 500]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in op.encode(docs, leaf=64, long_chunk=300).collect():
        want = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
    got = op.decode(op.encode(docs)).collect()
    assert len(got) == len(texts)
    assert op.encode(docs.limit(0)).count() == 0
