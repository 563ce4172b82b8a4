"""Pages by rank, and group expansion where the groups lie."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexicarta import fixtures
from lexicarta.operators import search
from lexicarta.plans import inspect
from lexicarta.schema import RESULT_COLUMNS, total_order
from lexicarta.sources import glossary as source

SMALL = "/root/testdata/sf0.001"
ROWS = "id long, group_id long, source string, target string, language string, file_name string, bundle_name string"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50), rng.choice([None, 7, 7, 7, rng.randrange(-40, 200)]), "k", None, rng.choice([None, "en", "de"]), "f", "b") for _ in range(400)]
    return spark.createDataFrame(rows, ROWS).repartition(3).cache()


@pytest.mark.parametrize("groups", [1, 16, 1000])
def test_pages_by_rank_equal_the_sorted_whole(table, groups):
    whole = [tuple(r) for r in table.orderBy(*total_order()).collect()]
    for start, size in ((0, 7), (3, 1), (150, 60), (390, 20), (400, 5), (10**12, 5)):
        page = search.page_by_rank(table, start, size, groups).orderBy("row_number").collect()
        assert [tuple(r)[:-1] for r in page] == whole[start : start + size]
        assert [r.row_number for r in page] == list(range(start + 1, start + 1 + len(page)))


def test_a_page_by_rank_of_nothing(table):
    assert search.page_by_rank(table.limit(0), 5, 5).count() == 0


def test_deep_pages_of_a_result_take_the_rank(table, monkeypatch):
    shallow, deep = (search.SearchResult(table, 9, 20) for _ in range(2))
    want = [tuple(r) for r in shallow.page().collect()]
    numbered = sorted(map(str, shallow.numbered_page().collect()))
    monkeypatch.setattr(search, "DEEP", 100)
    assert [tuple(r) for r in deep.page().collect()] == want and len(want) == 20
    assert sorted(map(str, deep.numbered_page().collect())) == numbered


def test_what_is_sorted_does_not_grow_with_the_page(spark):
    """Rows that reach the window, counted by an accumulator in front of it."""
    rows = fixtures.glossary_lines(spark, SMALL).select(*RESULT_COLUMNS).cache()
    total, most = rows.count(), []
    for start in (0, total // 2, total - 50):
        span = F.coalesce(F.floor(F.col("group_id") / 64), F.lit(-(1 << 62)))
        part = search._holding(rows.withColumn("span", span), "span", F.lit(0).cast("long"), start, 50)
        most.append(part.rows.count())
    assert max(most) < total / 5 and max(most) < 3 * min(most)


def test_groups_expand_without_an_exchange_of_the_glossary(spark, tmp_path):
    g = fixtures.glossary_docs(spark, SMALL)
    m = fixtures.language_map(g).cache()
    stored = source.write_bucketed(g, "bucketed_test", f"{tmp_path}/g", 4)
    try:
        rows = search.search(stored, m, "ios", 26, term="hein", releases=fixtures.releases(spark)).rows
        plain = search.search(g, m, "ios", 26, term="hein", releases=fixtures.releases(spark)).rows
        assert sorted(map(str, rows.select(*RESULT_COLUMNS).collect())) == sorted(map(str, plain.select(*RESULT_COLUMNS).collect()))
        # with large groups on both sides, neither is broadcast
        of_codes = m.where("platform = 'ios' and version = 26").select(F.col("code").alias("language")).distinct()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        own = stored.where("platform = 'ios' and version = 26").join(F.broadcast(of_codes), "language", "left_semi")
        expanded = own.join(search.matched_groups(own, "hein", None), "group_id", "left_semi")
        text = inspect.physical(expanded)
        assert "Bucketed: true" in text
        exchanged = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
        assert not any("group_id" in x for x in exchanged)
        assert any("group_id" in x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", inspect.physical(g.join(search.matched_groups(g, "hein", None), "group_id", "left_semi"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_test")
