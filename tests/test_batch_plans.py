"""Tables of requests: all terms in one pass, prefixes by equi-joins, one rule for page numbers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexicarta import fixtures
from lexicarta.operators import batch, matcher, search
from lexicarta.plans import inspect
from lexicarta.schema import MOST_PAGE

SMALL = "/root/testdata/sf0.001"
TEXTS = "id long, platform string, version int, target_norm string"
TERMS = "platform string, version int, q string"


def join_keys(df):
    """Left keys of every join, without their numbers."""
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Left keys \[\d+\]: \[(.*)\]", inspect.physical(df))]


@pytest.mark.parametrize("limit", [1 << 20, 9, 1])
def test_terms_found_equal_the_plain_version(spark, limit):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé 日😀") for _ in range(rng.randint(0, n)))
    releases = [("ios", 26), ("ios", 18), ("macos", 26)]
    texts = [(k, *rng.choice(releases), rng.choice([None, "", word(40)])) for k in range(120)] + [(None, "ios", 26, "abab"), (7, "ios", 26, "abab"), (7, "ios", 26, "abab"), (8, "watch", 1, "abab")]
    terms = [(*rng.choice(releases), word(3)) for _ in range(60)] + [("ios", 26, "abab"), ("ios", 26, "ab"), ("ios", 26, "ab"), ("ios", 26, None), ("ios", 26, "nothing here")]
    got = matcher.find_terms(spark.createDataFrame(texts, TEXTS), matcher.collect(spark.createDataFrame(terms, TERMS), limit=limit), ["id"])
    want = sorted(str((p, v, i, q)) for i, p, v, t in texts for q in {q for a, b, q in terms if (a, b) == (p, v) and q} if t and q in t)
    assert got.columns == ["platform", "version", "id", "q"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_no_terms_and_no_texts(spark):
    texts, none = spark.createDataFrame([(1, "ios", 26, "a")], TEXTS), spark.createDataFrame([], TERMS)
    assert matcher.find_terms(texts, matcher.collect(none), ["id"]).count() == 0
    assert matcher.find_terms(texts.limit(0), matcher.collect(spark.createDataFrame([("ios", 26, "a")], TERMS)), ["id"]).count() == 0
    assert matcher.collect(spark.createDataFrame([("ios", 26, "abc")], TERMS), most=10) is None


def asked(spark, n):
    """``n`` requests, nearly all of them for terms that no text holds."""
    i = F.col("id")
    q = F.when(i < 20, F.element_at(F.array(*map(F.lit, ("hein", "haus", "and", "the", "que"))), (i % 5 + 1).cast("int"))).otherwise(F.concat(F.lit("zq"), F.hex(i)))
    return spark.range(n).select(i.alias("request_id"), F.lit("ios").alias("platform"), F.lit(26).alias("version"), q.alias("q"), F.lit("").alias("bundle"), F.array().cast("array<string>").alias("languages"))


def test_one_pass_however_many_requests(spark):
    g = fixtures.glossary_docs(spark, SMALL)
    m = fixtures.language_map(g)
    found = {}
    for n in (200, 20_000):
        rows = batch.search_all(g, m, asked(spark, n))
        passes = [x for x in inspect.python_nodes(rows) if "MapInArrow" in x]
        assert len(passes) == 1
        assert all(set(keys) - {"platform", "version"} for keys in join_keys(rows))  # no join on the release alone
        found[n] = sorted((r.request_id, r.id) for r in rows.select("request_id", "id").collect())
    assert found[200] == found[20_000] and found[200]


def test_terms_beyond_the_bound_take_the_index(spark, monkeypatch):
    g = fixtures.glossary_docs(spark, SMALL)
    m = fixtures.language_map(g)
    requests = asked(spark, 40)
    want = sorted(map(str, batch.search_all(g, m, requests).collect()))
    monkeypatch.setattr(matcher, "collect", lambda terms: None)
    rows = batch.search_all(g, m, requests)
    assert not inspect.python_nodes(rows.select("id")) or "MapInArrow" not in str(inspect.python_nodes(rows))
    assert sorted(map(str, rows.select(*batch.search_all(g, m, requests).columns).collect())) == want


def test_prefixes_join_by_equality(spark):
    g = fixtures.glossary_docs(spark, SMALL)
    rows = batch.search_columns(g, fixtures.language_map(g), fixtures.prefix_requests(spark, SMALL))
    keys = join_keys(rows)
    assert any("prefix" in k for k in keys)
    text = inspect.physical(rows)
    assert "StartsWith" not in text and not re.search(r"Join condition: .*prefix", text)


CASES = [("3", 3), ("0", 1), ("-4", 1), ("", None), (None, None), ("abc", None), (" 7 ", 7), ("\t8\n", 8), ("+5", 5), ("1_0", 1), ("2.9", 2), ("12abc", 12), ("3000000000", 3_000_000_000), ("9" * 40, MOST_PAGE), ("-" + "9" * 40, 1), ("- 3", None), ("٣", None)]


def test_both_forms_read_numbers_alike(spark):
    raw = spark.createDataFrame([(k, v, v) for k, (v, _) in enumerate(CASES)], "request_id long, page string, size string")
    got = {r.request_id: (r.page_number, r.page_size, r.row_offset) for r in batch.paging(raw).collect()}
    for k, (value, want) in enumerate(CASES):
        page, size = want or 1, min(200, want or 200)
        assert search.clamp(value, 1) == page and search.clamp(value, 200, 200) == size, value
        assert got[k] == (page, size, (page - 1) * size), value


def test_selections_are_shared_and_exact(spark):
    m = spark.createDataFrame([("ios", 26, "English", "en"), ("ios", 26, "French", "fr"), ("ios", 26, "English", "en_GB")], "platform string, version int, language_name string, code string")
    g = spark.createDataFrame([(1, 1, "k", "hello", c, "f", "b", "ios", 26, "hello") for c in ("en", "fr", "en_GB", "xx")], "id long, group_id long, source string, target string, language string, file_name string, bundle_name string, platform string, version int, target_norm string")
    lists = [None, [], ["English"], ["French", "English"], ["English", "French", "English"], ["Klingon"], [None], ["Klingon", "French"]]
    requests = spark.createDataFrame([(k, "ios", 26, "hello", None, x) for k, x in enumerate(lists)], "request_id long, platform string, version int, q string, bundle string, languages array<string>")
    got = {}
    for r in batch.search_all(g, m, requests).collect():
        got.setdefault(r.request_id, set()).add(r.language)
    every = {"en", "fr", "en_GB"}
    assert got == {0: every, 1: every, 2: {"en", "en_GB"}, 3: every, 4: every, 7: {"fr"}}
