"""Trigram postings stored in blocks: the same rows as a scan, written once, never dealt out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_index_runs import SMALL, moved, stored

from lexicarta import fixtures
from lexicarta.functions import text
from lexicarta.operators import batch, positions, postings
from lexicarta.plans import inspect

TEXTS = "id long, platform string, version int, target_norm string"


def test_threes_sort_alike_on_both_ways():
    rng = np.random.default_rng(1)
    few = rng.integers(97, 101, 3000)
    many = np.concatenate([few, rng.permutation(0x10FFFF)[:300_000]])  # letters beyond what one integer takes beside a number
    for line, most in ((few, 5000), (many, 1 << 40)):
        number = np.sort(rng.integers(0, most, len(line) - 2))
        key, first, got = positions.sorted_threes(line.astype(np.int64), np.arange(len(line) - 2), number)
        plain = positions._key(*(line[k : len(line) - 2 + k].astype(np.int64) for k in range(3)))
        order = np.lexsort((number, plain))
        assert (got == number[order]).all()
        assert (np.repeat(key, np.diff(np.append(first, len(got)))) == plain[order]).all() and (np.diff(key) > 0).all()


@pytest.mark.parametrize("segment_chars", [60, 1 << 20])
def test_stored_postings_equal_the_scan(spark, tmp_path, segment_chars):
    rng = random.Random(6)
    made = ["".join(rng.choice("abé😀 \0") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(k * 7 - 300, "ios", 26 if k % 3 else 18, t) for k, t in enumerate(made)] + [(None, "ios", 26, "abab"), (1 << 60, "ios", 26, "ab ab"), (5000, "ios", 26, None), (5001, "ios", 26, "bbbbbbbb"), (5001, "ios", 26, "bbbbbbbb")]
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    index = postings.store(df, f"{tmp_path}/i", segment_chars)
    terms = ["ab", "a", "abé", "é😀", "aba ", "bbbb", "a😀b", "😀\0", "zzz", "abz"] + ["".join(rng.choice("abé ") for _ in range(4)) for _ in range(6)]
    for term in ("ab", "abé", "a😀b", "bbbb", "zzz"):
        want = sorted(i for i, _, _, t in rows if t and i is not None and term in t)
        assert sorted(r["id"] for r in postings.lookup(index, df.where("id is not null"), term).collect()) == want, term
    asked = [(100 * v + k, "ios", v, t) for v in (26, 18, 1) for k, t in enumerate(terms)]
    got = {(r["request_id"], r["id"]) for r in postings.batch_lookup(index, df, spark.createDataFrame(asked, "request_id long, platform string, version int, q string")).where("id is not null").collect()}
    assert got == {(r, i) for r, _, v, q in asked for i, _, w, t in rows if v == w and t and i is not None and text.normalise(q) in t}


def test_blocks_count_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "ios", 26, "aaaa bbb"), (2, "ios", 26, "aaa"), (3, "ios", 26, "xy")], TEXTS)
    got = {(r.gram, r.n) for r in postings.store(df.coalesce(1), f"{tmp_path}/i").collect()}
    assert got == {("aaa", 2), ("aa ", 1), ("a b", 1), (" bb", 1), ("bbb", 1)}
    assert postings.store(df.where("id = 3"), f"{tmp_path}/none").count() == 0


def test_the_queries_shuffle_no_postings(spark, tmp_path):
    g = fixtures.glossary_docs(spark, SMALL).repartition(3).localCheckpoint()
    index, shuffled, written = moved(spark, lambda: postings.store(g, f"{tmp_path}/i"))
    assert shuffled == 0 and 0 < written < 1.1 * stored(f"{tmp_path}/i")
    _, rows, _ = moved(spark, lambda: postings.write(postings.build(g), f"{tmp_path}/rows"))
    assert rows > 0  # what the queries did before
    asked = batch.resolve_versions(batch.clean(fixtures.requests(spark, SMALL), "q", "bundle"), fixtures.releases(spark))
    found = postings.batch_lookup(index, g, asked)
    assert "gram#" not in "".join(x for x in inspect.physical(found).split("\n") if "hashpartitioning" in x)
    assert found.count() == g.join(asked.select("request_id", "platform", "version", "q"), ["platform", "version"]).where((F.length("q") > 0) & F.contains("target_norm", "q")).count()
    assert "gram" in str(inspect.scan_filters(postings.lookup(index, g, "haus"))["PushedFilters"])
