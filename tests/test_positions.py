"""Positional postings against a scan, their coding, and whole words over a table of requests."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta import fixtures
from lexicarta.functions.text import normalise
from lexicarta.operators import batch, matcher, positions, search
from lexicarta.plans import inspect
from lexicarta.schema import RELEASE

SMALL = "/root/testdata/sf0.001"
TEXTS = "id long, platform string, version int, target_norm string"


def places(text, term):
    return sum(text.startswith(term, i) for i in range(len(text)))


def test_coding_round_trip():
    rng = random.Random(1)
    for bits in (0, 7, 8, 14, 21, 28, 40, 62):
        values = np.array([0, 1, 127, 128, (1 << bits) - 1, 1 << bits, *(rng.randrange(1 << max(1, bits)) for _ in range(50))], np.int64)
        data, ends = positions.pack(values)
        assert positions.unpack(data.tobytes()).tolist() == values.tolist()
        assert positions.unpack(data[ends[3] :].tobytes()).tolist() == values[4:].tolist()
    assert positions.unpack(b"").tolist() == [] and positions.pack(np.zeros(0, np.int64))[0].tolist() == []
    ids = np.array([5, -7, 1 << 40, 0, -(1 << 62)])
    assert positions._unzigzag(positions.unpack(positions.pack(positions._zigzag(ids))[0].tobytes())).tolist() == ids.tolist()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé 日😀") for _ in range(rng.randint(0, n)))
    out = [(k, *rng.choice([("ios", 26), ("ios", 18), ("mac os", 26)]), rng.choice([None, "", "a", "ab", word(40), "ab" * 30])) for k in range(150)]
    return out + [(None, "ios", 26, "abab"), (7, "ios", 26, "abab again"), (7, "ios", 26, "abab again"), (-5, "ios", 26, "xyz"), (1 << 50, "ios", 26, "z")]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, TEXTS).withColumns({"term": F.lit("clash"), "segment": F.lit("clash")}).repartition(3)
    # small batches make many segments
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    yield positions.write(df, str(tmp_path_factory.mktemp("index") / "i"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


TERMS = ["a", "日", "ab", "b ", "aba", "abab", "ababa", "ababababab", "é日", "😀", "a😀b", "xyz", "z", "again", "abab again", "nothing", "b😀 日é"]


def test_batch_lookup_equals_the_scan(spark, rows, index):
    asked = [(k, p, v, t) for k, (t, (p, v)) in enumerate((t, r) for t in [*TERMS, "", None, "ABAB", "ab"] for r in [("ios", 26), ("mac os", 26), ("nowhere", 1)])]
    found = positions.batch_lookup(index, spark.createDataFrame(asked, "request_id long, platform string, version int, q string"))
    assert found.columns == ["request_id", "platform", "version", "id", "hits"]
    want = [(k, p, v, i, places(t, normalise(q))) for k, p, v, q in asked if q for i, a, b, t in rows if i is not None and (a, b) == (p, v) and t and normalise(q) in t]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_single_lookup_equals_the_scan(spark, rows, index):
    for term in ("ab", "Abab", "日", "ababababab", "nothing"):
        want = sorted((p, v, i, places(t, normalise(term))) for i, p, v, t in rows if i is not None and t and normalise(term) in t)
        assert sorted(tuple(r) for r in positions.lookup_ids(index, term).collect()) == want
    with pytest.raises(ValueError):
        positions.lookup_ids(index, "")


def test_a_lookup_reads_ranges_of_the_index_alone(spark, index):
    for term, pushed in (("again", "In(gram"), ("ab", "GreaterThanOrEqual(gram")):
        filters = inspect.scan_filters(positions.lookup_ids(index.where("platform = 'ios' and version = 26"), term))
        assert len(filters["ReadSchema"]) == 1 and "target" not in filters["ReadSchema"][0]  # one scan
        assert pushed in filters["PushedFilters"][0] and "platform" in filters["PartitionFilters"][0]


def test_an_empty_glossary_has_an_empty_index(spark, tmp_path):
    empty = positions.write(spark.createDataFrame([(1, "ios", 26, None)], TEXTS), f"{tmp_path}/i")
    assert empty.count() == 0 and positions.lookup_ids(empty, "abc").count() == 0


def test_rows_of_the_glossary(spark, tmp_path):
    g = fixtures.glossary_docs(spark, SMALL)
    found = positions.lookup(positions.write(g, f"{tmp_path}/i"), g, "hein")
    assert sorted(map(str, found.collect())) == sorted(map(str, g.where(search.contains_term("hein")).collect()))


def test_searches_through_the_index_equal_those_over_the_texts(spark, tmp_path):
    """Groups, bundles, languages and releases alike; matching reads no text."""
    g = fixtures.glossary_docs(spark, SMALL)
    m = fixtures.language_map(g)
    index = positions.write(g, f"{tmp_path}/i")
    known = fixtures.releases(spark)
    for request in ({"term": "Hein"}, {"term": "e", "bundle": "bundle1"}, {"term": "nothing at all"}, {"bundle": "bundle2"}):
        one = search.search(g, m, "ios", 26, releases=known, index=index, **request)
        want = search.search(g, m, "ios", 26, releases=known, **request)
        assert sorted(map(str, one.rows.select("id", "language").collect())) == sorted(map(str, want.rows.select("id", "language").collect())), request
    asked = batch.resolve_versions(batch.clean(fixtures.requests(spark, SMALL), "q", "bundle"), g)
    found = batch.search_all(g, m, asked, index).select("request_id", "id")
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.search_all(g, m, asked).select("request_id", "id").collect()))
    assert "target_norm" not in "".join(s for s in inspect.scan_filters(found)["ReadSchema"])


WORDS = ["world", "hello world", "wor", "-class", "world-class", "a_b", "b", "x.y", "é", "日", "c++", "", None]


def test_batch_words_equal_single_search(spark):
    texts = ["hello world", "world-class", "worldwide", "a_b", "a b", "x.y", "x.yz", "é", "éa", "日本", "日 本", "c++", "c++11", "hello world2 hello world", "_world_", "world", None, ""]
    g = spark.createDataFrame([(k, k // 3, f"k{k}", t, "en", "f", "b", "ios", 26, t) for k, t in enumerate(texts)], "id long, group_id long, source string, target string, language string, file_name string, bundle_name string, platform string, version int, target_norm string").cache()
    m = spark.createDataFrame([("ios", 26, "English", "en")], "platform string, version int, language_name string, code string")
    asked = spark.createDataFrame([(k, "ios", 26, q, None, None) for k, q in enumerate(WORDS)], "request_id long, platform string, version int, q string, bundle string, languages array<string>")
    got: dict = {}
    for r in batch.search_all(g, m, asked, mode="word").collect():
        got.setdefault(r.request_id, []).append(r.id)
    for k, q in enumerate(WORDS):
        want = sorted(r.id for r in search.search(g, m, "ios", 26, term=q, mode="word").rows.collect()) if q else []
        assert sorted(got.get(k, [])) == want, q
    with pytest.raises(ValueError):
        matcher.find_terms(g, [], ["id"], mode="regex")
