"""Keyed hashes: equal runs and words agree, prepared collisions of linear hashes do not."""

import random

import brute
import numpy as np
import pytest

from lexicarta.llm import jaccard_join, spans, substring_dedup, suffix_dedup


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def words_of(texts, key, lower=False):
    raw = [t.encode() for t in texts]
    return spans.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lower, key)


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_thue_morse_words_collide_in_polynomials_only(n):
    key = spans.Key.draw()
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    hashes = words_of([x, y, x], key).hash
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    if n >= 1024:
        assert len(set(words_of([x, y], None).hash.tolist())) == 1


@pytest.mark.parametrize("lower", [False, True])
def test_equal_words_alone_agree(lower):
    rng = random.Random(1)
    key = spans.Key.draw()
    words = ["".join(rng.choice("abAB\0é日") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40]))) for _ in range(3000)]
    text = " ".join(words)
    fold = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w) if lower else w
    got, seen = words_of([text], key, lower).hash.tolist(), {}
    assert len(got) == len(words)
    for w, h in zip(words, got, strict=True):
        assert seen.setdefault(fold(w), h) == h
    assert len(set(seen.values())) == len(seen)
    assert words_of([text], spans.Key.draw(), lower).hash.tolist() != got  # another key, other hashes


def test_windows_agree_where_their_items_do():
    rng = np.random.default_rng(2)
    key = spans.Key.draw()
    data = rng.integers(97, 99, 700).astype(np.uint8)
    for rolling in (spans.Windows(data.astype(np.uint64), key), spans.Windows.of_bytes(data, key, 8), spans.Windows.of_bytes(data, key, 3)):
        for width in (8, 9, 13, 16, 40):
            hashes, seen = rolling.all(width), {}
            assert len(hashes) == len(data) - width + 1
            for i, h in enumerate(hashes.tolist()):
                assert seen.setdefault(data[i : i + width].tobytes(), h) == h
            assert len(set(seen.values())) == len(seen)
            start = np.arange(0, 600, 7)
            assert (rolling.some(start, start + width) == hashes[start]).all()
        size = rng.integers(8, 60, 90)
        start = rng.integers(0, 600, 90)
        assert rolling.some(start, start + size).tolist() == [int(rolling.all(n)[a]) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    assert len(spans.Windows(np.zeros(3, np.uint64), key).all(5)) == 0


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_thue_morse_texts_apart(spark, n):
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    around = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join([*around[:30], x, *around[30:]])), (2, " ".join([*around[:30], y, *around[30:]])), (3, x), (4, y), (5, " ".join(thue_morse(n))), (6, " ".join(thue_morse(n, "b", "a")))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in substring_dedup.substring_dedup(df, 50).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == brute.substring_dedup(docs, 50)
    assert {r[0]: r[2] for r in got}[2] == 0
    linked = {tuple(r) for r in jaccard_join.jaccard_join(df, 4, 85, 100).collect()}
    assert linked == brute.jaccard_join(docs)
    assert {r[0]: r[2] for r in linked}[4] == 4
    got = {tuple(r) for r in suffix_dedup.suffix_dedup(df, 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == brute.suffix_dedup(docs, 400)
