"""Anchors with very many different spans: ranges of places halved until the groups are small."""

import random

import brute
import pytest

from lexicarta.llm import suffix_dedup


def around(passage: str, n: int, seed: int) -> list[tuple]:
    """``n`` texts with the passage between contexts from few and from many, and some whole copies."""
    draw = random.Random(seed)
    word = lambda k: "".join(draw.choice("abcd") for _ in range(k))
    left, right = [word(40) for _ in range(60)], [word(40) for _ in range(60)]
    out = []
    for i in range(n):
        a = draw.choice(left)[draw.randrange(20) :] if draw.random() < 0.5 else word(draw.randrange(40))
        b = draw.choice(right)[: draw.randrange(1, 40)] if draw.random() < 0.5 else word(draw.randrange(40))
        out.append((i, a + passage + b))
    return out + [(n + i, out[i][1]) for i in range(0, n, 50)] + [(2 * n, None), (2 * n + 1, "")]


@pytest.mark.parametrize("n,group", [(5000, 1024), (600, 16), (300, 1)])
def test_many_spans_of_one_anchor(spark, n, group):
    docs = around("the very same line stands here", n, n)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(df, 60, 20, 1 << 14, group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {tuple(r) for r in got} == brute.suffix_dedup(docs, 60)


def test_many_spans_are_halved(spark, monkeypatch):
    """Groups stay as small as asked, the rounds end, and blocks of the transform see all of it."""
    sizes, plain = [], suffix_dedup._by_blocks

    def seen(pieces, length, block_bytes):
        sizes.extend(r[0] for r in pieces.groupBy("anchor").count().select("count").collect())
        return plain(pieces, length, block_bytes)

    monkeypatch.setattr(suffix_dedup, "_by_blocks", seen)
    docs = around("the very same line stands here", 1500, 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(df, 60, 20, 1 << 14, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {tuple(r) for r in got} == brute.suffix_dedup(docs, 60)
    assert 1 < max(sizes) <= 100
