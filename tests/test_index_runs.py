"""Stored indexes: each task writes its own sorted runs, and look-ups never deal an index out."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from lexicarta import fixtures
from lexicarta.operators import batch, positions
from lexicarta.plans import inspect

SMALL = "/root/testdata/sf0.001"
TEXTS = "id long, platform string, version int, target_norm string"
ASKED = "request_id long, platform string, version int, q string"


def moved(spark, action):
    """Result of an action, and the bytes that its stages shuffled and wrote."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def stages():
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        found = jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, jvm.java.util.ArrayList()))
        return {s.stageId(): (s.shuffleWriteBytes(), s.outputBytes()) for s in found}

    before = stages()
    out = action()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    new = [v for k, v in stages().items() if k not in before]
    return out, sum(s for s, _ in new), sum(w for _, w in new)


def stored(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_positions_are_written_once_and_shuffled_never(spark, tmp_path):
    g = fixtures.glossary_docs(spark, SMALL).repartition(3).localCheckpoint()
    index, shuffled, written = moved(spark, lambda: positions.write(g, f"{tmp_path}/i"))
    assert shuffled == 0 and 0 < written < 1.1 * stored(f"{tmp_path}/i")
    assert index.count() > 1000


def test_runs_are_sorted(spark, tmp_path):
    import pyarrow.parquet as pq

    positions.write(fixtures.glossary_docs(spark, SMALL), f"{tmp_path}/i", partitions=2, segment_chars=2000)
    files = list(Path(f"{tmp_path}/i").rglob("*.parquet"))
    assert len({f.parent for f in files}) == 10
    for f in files:
        grams = pq.ParquetFile(f).read(["gram", "segment"]).to_pylist()
        assert grams == sorted(grams, key=lambda r: (r["gram"], r["segment"]))
        assert len({r["segment"] for r in grams}) > 1


def test_batch_lookup_deals_out_what_was_found_only(spark, tmp_path):
    """The requests go to the index: what is shuffled is the blocks asked for, by segment."""
    asked = batch.resolve_versions(batch.clean(fixtures.requests(spark, SMALL), "q", "bundle"), fixtures.releases(spark))
    index = positions.write(fixtures.glossary_docs(spark, SMALL), f"{tmp_path}/i")
    found = positions.batch_lookup(index, asked)
    text = inspect.physical(found)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert len([r for r in inspect.scan_filters(found)["ReadSchema"] if "places" in r]) == 2  # blocks once, directory once
    assert found.count() > 0


def test_many_releases_and_segments_equal_the_scan(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé 日😀") for _ in range(rng.randint(0, 30)))
    rows = [(k, "ios", rng.randrange(40), word()) for k in range(600)]
    terms = ["a", "日", "ab", "b ", "aba", "é日a", "😀a b", "", None]
    asked = [(10 * v + k, "ios", v, t) for v in (0, 7, 39, 99) for k, t in enumerate(terms)]
    index = positions.write(spark.createDataFrame(rows, TEXTS), f"{tmp_path}/i", partitions=2, segment_chars=50)
    assert index.select("segment").distinct().count() > 80
    got = positions.batch_lookup(index, spark.createDataFrame(asked, ASKED)).drop("hits")
    want = sorted((r, p, v, i) for r, p, v, q in asked if q for i, a, b, t in rows if (a, b) == (p, v) and q in t)
    assert sorted(tuple(r) for r in got.collect()) == want and want
    one = positions.lookup_ids(index.where(F.col("version") == 7), "ab").select("id").collect()
    assert sorted(r.id for r in one) == sorted(i for i, _, v, t in rows if v == 7 and "ab" in t)
