"""Reading, unifying and writing glossaries, and the result documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised
from ..schema import RELEASE, RESULT_COLUMNS, of_release
from .stage import bounded


def scan_release(glossary: DataFrame, platform: str, version: int) -> DataFrame:
    """One release: partitions are pruned on a partitioned dataset."""
    return glossary.where(of_release(platform, version))


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, partitions: int = 8, quote: str = '"', **options: str) -> DataFrame:
    """A release table of a relational database, read in parallel by ranges of ``id``.

    Filters on the result reach the database. ``quote`` is its mark around identifiers.
    """
    settings = {"url": url, **({"driver": driver} if driver else {}), **options}
    read = lambda **more: spark.read.format("jdbc").options(**settings, **more).load()
    low, high = read(query=f"SELECT min({quote}id{quote}) AS low, max({quote}id{quote}) AS high FROM {table}").first()
    if low is None:
        return read(dbtable=table)
    return read(dbtable=table, partitionColumn="id", lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions))


def read_jdbc_releases(spark: SparkSession, url: str, tables: dict[tuple[str, int], str], driver: str | None = None, **options) -> DataFrame:
    """All release tables of a database as one glossary, one parallel read per release."""
    return unify({release: read_jdbc(spark, url, table, driver, **options) for release, table in tables.items()})


def unify(releases: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """One dataset of all release tables, with ``platform`` and ``version`` columns."""
    tagged = [df.select(*RESULT_COLUMNS).withColumn("platform", F.lit(p)).withColumn("version", F.lit(v).cast("int")) for (p, v), df in sorted(releases.items())]
    return reduce(DataFrame.unionByName, tagged)


def with_normalised_target(glossary: DataFrame) -> DataFrame:
    """Add ``target_norm``; texts go to Python in batches of bounded bytes."""
    return bounded(glossary).withColumn("target_norm", normalised("target"))


#: What files are dealt and sorted by, so that group look-ups prune row groups.
FILE_ORDER = ("platform", "version", "group_id", "language")


def by_ranges(glossary: DataFrame, partitions: int | None = None) -> DataFrame:
    """Dealt into ranges of release and group, drawn from the data, so that a large release gets more of them."""
    return glossary.repartitionByRange(*([partitions] if partitions else []), *FILE_ORDER[:3])


def write_glossary(glossary: DataFrame, path: str, partitions: int | None = None) -> None:
    """Partitioned by release, in result order. Releases written before are replaced if they come again, and stay otherwise.

    A reader meanwhile may find a replaced release in part; ``store.GlossaryStore`` swaps at once.
    """
    writer = by_ranges(glossary, partitions).sortWithinPartitions(*FILE_ORDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("platform", "version").parquet(path)


def write_bucketed(glossary: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A table under ``path``, partitioned by release and bucketed and sorted by group, one file for each bucket and release.

    The groups of a search lie in the bucket of the rows they expand to, so both steps of
    the expansion, distinct groups and the join back, run bucket by bucket without an
    exchange of the glossary.  A bucket should hold some hundred megabytes of the largest
    release; the same number serves all releases.
    """
    columns = [*RESULT_COLUMNS, "target_norm", *RELEASE]
    dealt = glossary.select(*columns).repartition(buckets, "group_id")
    dealt.write.mode("overwrite").partitionBy(*RELEASE).bucketBy(buckets, "group_id").sortBy("group_id").option("path", path).saveAsTable(table)
    return glossary.sparkSession.table(table)


def read_language_map(spark: SparkSession, path: str) -> DataFrame:
    """Language maps from files, one JSON object of language names to lists of codes for each release.

    Files lie under ``platform=…/version=…``; returns one row per code.
    """
    raw = spark.read.option("wholetext", True).text(path)
    languages = F.from_json("value", "map<string,array<string>>").alias("languages")
    return explode_language_map(raw.select(F.col("platform").cast("string").alias("platform"), F.col("version").cast("int").alias("version"), languages))


def write_language_map(codes: DataFrame, path: str) -> None:
    """The rows ``platform, version, language_name, code`` as such files."""
    nested = nest_language_map(codes)
    nested.select("platform", "version", F.to_json("languages").alias("value")).repartition("platform", "version").write.mode("overwrite").partitionBy("platform", "version").text(path)


def nest_language_map(codes: DataFrame) -> DataFrame:
    """One row per release with ``languages map<string,array<string>>``: as many entries as a release has codes."""
    lists = codes.groupBy("platform", "version", "language_name").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return lists.groupBy("platform", "version").agg(F.map_from_entries(F.collect_list(F.struct("language_name", "codes"))).alias("languages"))


def explode_language_map(raw: DataFrame) -> DataFrame:
    """``platform, version, languages map<string,array<string>>`` to one row per code."""
    named = raw.select("platform", "version", F.explode("languages").alias("language_name", "codes"))
    return named.select("platform", "version", "language_name", F.explode("codes").alias("code"))


def response_documents(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """``request_id, data, last_page, total``: one document per request, its rows (a page: 200 at most) in order.

    ``pages`` has ``request_id, row_number`` and the result columns; ``totals`` has
    ``request_id, total, last_page``.  Write with ``.write.json``.
    """
    item = F.struct(*RESULT_COLUMNS)
    data = pages.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("row_number", item.alias("item")))).alias("rows"))
    data = data.select("request_id", F.transform("rows", lambda r: r["item"]).alias("data"))
    none = F.array().cast(f"array<{pages.select(item.alias('s')).schema['s'].dataType.simpleString()}>")
    return totals.join(data, "request_id", "left").select("request_id", F.coalesce("data", none).alias("data"), "last_page", "total")
