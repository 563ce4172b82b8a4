"""Registered queries of the glossary engine, each with its oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import locales
from .functions.text import normalised
from .operators import batch, catalog, matcher, positions, postings, search
from .schema import COLUMNS, GLOSSARY_SCHEMA, RELEASE, RESULT_COLUMNS, of_release
from .sources import glossary as source
from .sources.stage import staged
from .sources.store import GlossaryStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEVEN = ", ".join(RESULT_COLUMNS)
IOS = "platform = 'ios' AND version = 26"
ORDER = "group_id, language, id, source, target, file_name, bundle_name"
#: The release and term that have matches at every scale.
TERM = "hein"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = X.glossary_docs(spark, sf_dir)
    return g, X.language_map(g)


def _expanded(condition: str, names: str = "", select: str = SEVEN) -> str:
    """SQL of a group-expanding search on the fixture's newest release."""
    chosen = f" AND language_name IN ({names})" if names else ""
    return f"""WITH {X.SQL_MAP},
rows AS (SELECT * FROM g WHERE {IOS} AND language IN (SELECT code FROM lm WHERE {IOS}{chosen})),
res AS (SELECT * FROM rows WHERE group_id IN (SELECT group_id FROM rows WHERE {condition}))
SELECT {select} FROM res"""


def _searched(**request) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(*_views(spark, sf_dir), "ios", 26, releases=X.releases(spark), **request).rows.select(*RESULT_COLUMNS)

    return run


HAS_TERM = f"contains(target_norm, '{TERM}')"
query("search_by_term", _expanded(HAS_TERM))(_searched(term=TERM))
query("search_by_bundle", _expanded("bundle_name = 'bundle1'"))(_searched(bundle="bundle1"))
query("search_term_and_bundle", _expanded(f"{HAS_TERM} AND bundle_name = 'bundle1'"))(_searched(term=TERM, bundle="bundle1"))
query("search_languages", _expanded("contains(target_norm, 'and')", "'English'"))(_searched(term="and", languages=["English"]))
query("search_all_languages", _expanded("contains(target_norm, 'e')"))(_searched(term="e"))
query("search_unknown_language", _expanded(HAS_TERM, "'Klingon'"))(_searched(term=TERM, languages=["Klingon"]))
query("search_no_match", _expanded("contains(target_norm, 'zzzz')"))(_searched(term="zzzz"))
query("search_word", _expanded(r"regexp_matches(target_norm, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')"))(_searched(term="The", mode="word"))


@query("scan_release", f"WITH {X.SQL_DOCS} SELECT {SEVEN} FROM g WHERE {IOS}")
def scan_release(spark, sf_dir):
    return source.scan_release(X.glossary_docs(spark, sf_dir), "ios", 26).select(*RESULT_COLUMNS)


@query("jdbc_ingest", f"WITH {X.SQL_DOCS} SELECT {SEVEN} FROM g WHERE {IOS}")
def jdbc_ingest(spark, sf_dir):
    """Writes one release to a database and reads it back in parallel."""
    url, driver, prefix = _database(spark)
    _to_database(X.glossary_docs(spark, sf_dir), url, driver, f"{prefix}ios26", "ios", 26)
    return source.read_jdbc(spark, url, f"{prefix}ios26", driver, partitions=4)


@query("jdbc_ingest_releases", f"WITH {X.SQL_DOCS} SELECT {SEVEN}, platform, version FROM g")
def jdbc_ingest_releases(spark, sf_dir):
    """Every release as a table of a database, then all of them as one glossary."""
    url, driver, prefix = _database(spark)
    tables = {(p, v): f"{prefix}{p}{v}" for p, versions in X.VERSIONS.items() for v in versions}
    for (p, v), table in tables.items():
        _to_database(X.glossary_docs(spark, sf_dir), url, driver, table, p, v)
    return source.read_jdbc_releases(spark, url, tables, driver, partitions=2)


def _database(spark: SparkSession) -> tuple[str, str, str]:
    """URL, driver and a prefix for new tables: of the server that ``lexicarta.jdbc.url`` names, else in a new database of the driver's."""
    prefix = f"t{uuid.uuid4().hex[:12]}_"
    if url := spark.conf.get("lexicarta.jdbc.url", None):
        return url, spark.conf.get("lexicarta.jdbc.driver"), prefix
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a database that all executors reach in lexicarta.jdbc.url and its driver in lexicarta.jdbc.driver")
    return f"jdbc:derby:memory:glossary{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver", prefix


def _to_database(glossary: DataFrame, url: str, driver: str, table: str, platform: str, version: int) -> None:
    rows = source.scan_release(glossary, platform, version).select(*RESULT_COLUMNS)
    rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", table).option("numPartitions", 4).save()


@query("unify_releases", f"WITH {X.SQL_DOCS} SELECT {SEVEN}, platform, version FROM g")
def unify_releases(spark, sf_dir):
    g = X.glossary_docs(spark, sf_dir)
    return source.unify({(p, v): g.where(of_release(p, v)).drop(*RELEASE) for p, versions in X.VERSIONS.items() for v in versions})


@query("partitioned_search", _expanded(HAS_TERM))
def partitioned_search(spark, sf_dir):
    """Releases unified, normalised, written partitioned and sorted, then one of them searched: only its files are read."""
    g, m = _views(spark, sf_dir)
    path = staged(spark, "glossary")
    source.write_glossary(source.with_normalised_target(unify_releases(spark, sf_dir)), path)
    stored = spark.read.schema(GLOSSARY_SCHEMA).parquet(path)
    return search.search(stored, m, "ios", 26, term=TERM, releases=X.releases(spark)).rows.select(*RESULT_COLUMNS)


@query("language_map_rows", f"WITH {X.SQL_MAP} SELECT * FROM lm")
def language_map_rows(spark, sf_dir):
    """From the nested form, one map per release, back to rows."""
    _, codes = _views(spark, sf_dir)
    return source.explode_language_map(source.nest_language_map(codes))


@query("language_map_files", f"WITH {X.SQL_MAP} SELECT * FROM lm")
def language_map_files(spark, sf_dir):
    """Written as one JSON file per release and read back."""
    path = staged(spark, "language-maps")
    source.write_language_map(_views(spark, sf_dir)[1], path)
    return source.read_language_map(spark, path)


@query("normalize_target", f"WITH {X.SQL_DOCS} SELECT id, target_norm FROM g")
def normalize_target(spark, sf_dir):
    return source.with_normalised_target(X.glossary_docs(spark, sf_dir).drop("target_norm")).select("id", "target_norm")


@query("bundle_list", f"WITH {X.SQL_DOCS} SELECT DISTINCT platform, version, bundle_name FROM g")
def bundle_list(spark, sf_dir):
    return catalog.bundle_list(X.glossary_docs(spark, sf_dir))


@query("release_counts", f"WITH {X.SQL_DOCS} SELECT platform, version, count(*) AS row_count FROM g GROUP BY ALL")
def release_counts(spark, sf_dir):
    return catalog.release_counts(X.glossary_docs(spark, sf_dir))


@query("latest_release", f"WITH {X.SQL_DOCS} SELECT {SEVEN}, platform, version FROM g JOIN (SELECT platform, max(version) AS version FROM g GROUP BY platform) USING (platform, version)")
def latest_release(spark, sf_dir):
    g = X.glossary_docs(spark, sf_dir)
    return catalog.latest_rows(g).select(*RESULT_COLUMNS, *RELEASE)


@query("project_result", f"WITH {X.SQL_DOCS} SELECT {SEVEN} FROM g")
def project_result(spark, sf_dir):
    return X.glossary_docs(spark, sf_dir).select(*RESULT_COLUMNS)


STRIPPED = "regexp_replace(language, '(-iphoneos|-macos|-tvos|~appletv|~applewatch|~ipad|~iphone)$', '')"


@query(
    "display_language",
    f"""WITH {X.SQL_DOCS},
names(code, display_name) AS (VALUES ('en', 'English (United States)'), ('en_GB', 'English (United Kingdom)'), ('fr', 'French (France)'), ('de', 'German (Germany)'), ('es', 'Spanish (Spain)'))
SELECT id, language, coalesce(display_name, language) AS display_language FROM g LEFT JOIN names ON code = {STRIPPED}""",
)
def display_language(spark, sf_dir):
    rows = X.glossary_docs(spark, sf_dir).select("id", "language")
    return locales.with_display_name(rows, locales.locale_names(spark)).select("id", "language", "display_language")


@query("group_headers", f"WITH {X.SQL_DOCS} SELECT platform, version, group_id, arg_min(source, (language, id)) AS header, count(*) AS items FROM g GROUP BY ALL")
def group_headers(spark, sf_dir):
    return catalog.group_headers(X.glossary_docs(spark, sf_dir))


@query("filter_language", f"WITH {X.SQL_DOCS} SELECT {SEVEN} FROM g WHERE language IN ('en', 'en_XX', 'de-macos')")
def filter_language(spark, sf_dir):
    return search.of_languages(X.glossary_docs(spark, sf_dir), ["en", "en_XX", "de-macos"]).select(*RESULT_COLUMNS)


@query("filter_bundle", f"WITH {X.SQL_DOCS} SELECT {SEVEN} FROM g WHERE bundle_name = 'bundle1'")
def filter_bundle(spark, sf_dir):
    return search.of_bundle(X.glossary_docs(spark, sf_dir), "bundle1").select(*RESULT_COLUMNS)


@query("search_contains", f"WITH {X.SQL_DOCS} SELECT {SEVEN} FROM g WHERE {HAS_TERM}")
def search_contains(spark, sf_dir):
    return X.glossary_docs(spark, sf_dir).where(search.contains_term(TERM)).select(*RESULT_COLUMNS)


@query("search_total", _expanded(HAS_TERM, select="count(id) AS total, CAST(ceil(count(id) / 200.0) AS BIGINT) AS last_page"))
def search_total(spark, sf_dir):
    return search.search(*_views(spark, sf_dir), "ios", 26, releases=X.releases(spark), term=TERM).total()


@query("matched_groups", f"WITH {X.SQL_MAP} SELECT DISTINCT group_id FROM g WHERE {IOS} AND language IN (SELECT code FROM lm WHERE {IOS}) AND {HAS_TERM}")
def matched_groups(spark, sf_dir):
    g, m = _views(spark, sf_dir)
    return search.matched_groups(search.in_languages(g, m, "ios", 26), TERM, None)


def _paged(size: int, page: int) -> str:
    return _expanded(HAS_TERM) + f" ORDER BY {ORDER} LIMIT {size} OFFSET {size * (page - 1)}"


@query("search_page_2", _paged(7, 2))
def search_page_2(spark, sf_dir):
    return search.search(*_views(spark, sf_dir), "ios", 26, releases=X.releases(spark), term=TERM, page="2", size="7").page()


@query("page_past_end", _paged(200, 10000))
def page_past_end(spark, sf_dir):
    return search.search(*_views(spark, sf_dir), "ios", 26, releases=X.releases(spark), term=TERM, page=10000).page()


@query("result_row_number", f"WITH r AS ({_paged(7, 2)}) SELECT *, row_number() OVER (ORDER BY {ORDER}) + 7 AS row_number FROM r")
def result_row_number(spark, sf_dir):
    return search.search(*_views(spark, sf_dir), "ios", 26, releases=X.releases(spark), term=TERM, page=2, size=7).numbered_page().withColumn("row_number", F.col("row_number").cast("long"))


#: For each column a value that occurs at every scale, and a prefix of it with pattern characters where there are any.
VALUES = {"key": ("a_b.3", "a["), "localization": ("Avec.", "En"), "language": ("en_XX", "en"), "file": ("file3.strings", "file1"), "bundle": ("bundle1", "bundle")}


def _column_queries() -> None:
    shown = {"equal": "equal", "notEqual": "not_equal", "startsWith": "starts_with"}
    for alias, column in COLUMNS.items():
        value, prefix = VALUES[alias]
        tests = {"equal": (value, f"{column} = '{value}'"), "notEqual": (value, f"{column} <> '{value}'"), "startsWith": (prefix, f"starts_with({column}, '{prefix}')")}
        for operator, (word, test) in tests.items():

            def run(spark, sf_dir, alias=alias, operator=operator, word=word):
                return search.search_column(*_views(spark, sf_dir), "ios", 26, alias, operator, word, releases=X.releases(spark)).rows.select(*RESULT_COLUMNS)

            query(f"adv_{shown[operator]}_{alias}", f"WITH {X.SQL_MAP} SELECT {SEVEN} FROM g WHERE {IOS} AND language IN (SELECT code FROM lm WHERE {IOS}) AND {test}")(run)


_column_queries()


@query(
    "adv_equal_localization_present",
    f"WITH {X.SQL_MAP}, rows AS (SELECT * FROM g WHERE {IOS} AND language IN (SELECT code FROM lm WHERE {IOS})) SELECT {SEVEN} FROM rows WHERE target = (SELECT min(target) FROM rows WHERE target <> '')",
)
def adv_equal_localization_present(spark, sf_dir):
    """Equality on the first text of the release, so that there is a row to find."""
    g, m = _views(spark, sf_dir)
    first = search.in_languages(g, m, "ios", 26).where("target <> ''").agg(F.min("target")).first()[0]
    return search.search_column(g, m, "ios", 26, "localization", "equal", first, releases=X.releases(spark)).rows.select(*RESULT_COLUMNS)


PREFIXED = f"FROM g WHERE {IOS} AND language IN (SELECT code FROM lm WHERE {IOS}) AND starts_with(source, 'a')"


@query("adv_total", f"WITH {X.SQL_MAP} SELECT count(id) AS total, CAST(ceil(count(id) / 9.0) AS BIGINT) AS last_page {PREFIXED}")
def adv_total(spark, sf_dir):
    return search.search_column(*_views(spark, sf_dir), "ios", 26, "key", "startsWith", "a", releases=X.releases(spark), size=9).total()


@query("adv_page_2", f"WITH {X.SQL_MAP} SELECT {SEVEN} {PREFIXED} ORDER BY {ORDER} LIMIT 5 OFFSET 5")
def adv_page_2(spark, sf_dir):
    return search.search_column(*_views(spark, sf_dir), "ios", 26, "key", "startsWith", "a", releases=X.releases(spark), page=2, size=5).page()


@query("strip_locale_suffix", f"WITH {X.SQL_DOCS} SELECT id, {STRIPPED} AS code FROM g")
def strip_locale_suffix(spark, sf_dir):
    return X.glossary_docs(spark, sf_dir).select("id", locales.strip_suffix(F.col("language")).alias("code"))


@query("infer_language", f"WITH {X.SQL_DOCS} SELECT id, CASE left(language, 2) WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS language_name FROM g")
def infer_language(spark, sf_dir):
    return locales.infer_language(X.glossary_docs(spark, sf_dir).select("id", "language")).select("id", "language_name")


@query("clean_requests", f"WITH {X.SQL_REQUESTS} SELECT request_id, trim(q) AS q, trim(bundle) AS bundle FROM raw")
def clean_requests(spark, sf_dir):
    return batch.clean(X.requests(spark, sf_dir), "q", "bundle").select("request_id", "q", "bundle")


@query(
    "validate_requests",
    f"""WITH {X.SQL_REQUESTS} SELECT request_id,
  CASE WHEN coalesce(trim(q), '') = '' AND coalesce(trim(bundle), '') = '' THEN 'missing_term' ELSE 'ok' END AS search_status,
  CASE WHEN column_alias NOT IN ('key', 'localization', 'language', 'file', 'bundle') THEN 'bad_column' WHEN operator NOT IN ('equal', 'notEqual', 'startsWith') THEN 'bad_operator' WHEN coalesce(trim(q), '') = '' THEN 'empty_query' ELSE 'ok' END AS column_status
FROM raw""",
)
def validate_requests(spark, sf_dir):
    asked = batch.clean(X.requests(spark, sf_dir), "q", "bundle")
    return asked.select("request_id", batch.search_status().alias("search_status"), batch.column_status().alias("column_status"))


@query(
    "release_status",
    f"""WITH {X.SQL_REQUESTS}, wild AS (SELECT item_id AS request_id, CASE item_id % 10 WHEN 9 THEN 'watch' ELSE CASE item_id % 2 WHEN 0 THEN 'ios' ELSE 'macos' END END AS platform,
  CASE item_id % 7 WHEN 5 THEN '99' WHEN 6 THEN 'x' ELSE ['latest', '26', '15', ''][item_id % 4 + 1] END AS version FROM benchmark),
asked_for AS (SELECT request_id, wild.platform, newest, CASE WHEN wild.version IN ('', 'latest') THEN newest ELSE TRY_CAST(wild.version AS INTEGER) END AS version FROM wild LEFT JOIN newest USING (platform))
SELECT request_id, platform, version, CASE WHEN newest IS NULL THEN 'unknown_platform' WHEN EXISTS (FROM g WHERE g.platform = a.platform AND g.version = a.version) THEN 'ok' ELSE 'unknown_version' END AS release_status FROM asked_for a""",
)
def release_status(spark, sf_dir):
    """Requests for releases that exist and that do not: all stay, marked."""
    i = F.col("request_id")
    wild = X.requests(spark, sf_dir).withColumn("platform", F.when(i % 10 == 9, "watch").otherwise(F.col("platform"))).withColumn("version", F.when(i % 7 == 5, "99").when(i % 7 == 6, "x").otherwise(F.col("version")))
    return batch.with_release_status(wild, X.glossary_docs(spark, sf_dir)).select("request_id", *RELEASE, "release_status")


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g, m = _views(spark, sf_dir)
    known = spark.createDataFrame(g.select(*RELEASE).distinct().collect(), "platform string, version int")  # a row a release
    asked = batch.resolve_versions(batch.clean(X.requests(spark, sf_dir), "q", "bundle"), known)
    return g, m, asked


@query("batch_search", f"WITH {X.SQL_REQUESTS} SELECT request_id, platform, version, {SEVEN} FROM res")
def batch_search(spark, sf_dir):
    return batch.search_all(*_batch(spark, sf_dir)).select("request_id", *RELEASE, *RESULT_COLUMNS)


@query("batch_search_indexed", f"WITH {X.SQL_REQUESTS} SELECT request_id, platform, version, {SEVEN} FROM res")
def batch_search_indexed(spark, sf_dir):
    """The same through stored trigram postings."""
    g, m, asked = _batch(spark, sf_dir)
    index = postings.store(g, staged(spark, "postings"))
    return batch.search_all(g, m, asked, index).select("request_id", *RELEASE, *RESULT_COLUMNS)


@query("batch_page", f"WITH {X.SQL_REQUESTS} SELECT request_id, id, row_number, page_number FROM num JOIN req USING (request_id) WHERE row_number > CAST(page_number - 1 AS BIGINT) * page_size AND row_number <= CAST(page_number AS BIGINT) * page_size")
def batch_page(spark, sf_dir):
    """The page that each request asks for."""
    g, m, asked = _batch(spark, sf_dir)
    paged = batch.paging(asked)
    rows = batch.requested_pages(batch.search_all(g, m, asked), paged)
    return rows.join(paged.select("request_id", "page_number"), "request_id").select("request_id", "id", F.col("row_number").cast("long").alias("row_number"), F.col("page_number").cast("int").alias("page_number"))


@query("all_pages", f"WITH {X.SQL_REQUESTS} SELECT request_id, id, row_number, (row_number - 1) // 50 + 1 AS page FROM num")
def all_pages(spark, sf_dir):
    rows = batch.number_pages(batch.search_all(*_batch(spark, sf_dir)), 50)
    return rows.select("request_id", "id", F.col("row_number").cast("long").alias("row_number"), F.col("page").cast("long").alias("page"))


@query("batch_first_page", f"WITH {X.SQL_REQUESTS} SELECT request_id, {SEVEN}, row_number FROM num WHERE row_number <= 20")
def batch_first_page(spark, sf_dir):
    rows = batch.first_pages(batch.search_all(*_batch(spark, sf_dir)), 20)
    return rows.select("request_id", *RESULT_COLUMNS, F.col("row_number").cast("long").alias("row_number"))


@query(
    "paging_math",
    f"""WITH {X.SQL_REQUESTS}, t AS (SELECT request_id, count(id) AS total FROM res GROUP BY request_id)
SELECT request_id, page_number, page_size, CAST(page_number - 1 AS BIGINT) * page_size AS row_offset, coalesce(total, 0) AS total,
  CAST(ceil(coalesce(total, 0) / CAST(page_size AS DOUBLE)) AS BIGINT) AS last_page, least(CAST(page_number AS BIGINT) * page_size, coalesce(total, 0)) AS loaded
FROM req LEFT JOIN t USING (request_id) WHERE EXISTS (FROM g WHERE g.platform = req.platform AND g.version = req.version)""",
)
def paging_math(spark, sf_dir):
    g, m, asked = _batch(spark, sf_dir)
    total = batch.totals(batch.search_all(g, m, asked))
    paged = batch.paging(asked).join(total, "request_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    small = [F.col(c).cast("int").alias(c) for c in ("page_number", "page_size")]
    return batch.with_pages(paged).select("request_id", *small, "row_offset", "total", "last_page", "loaded")


@query("response_documents")
def response_documents(spark, sf_dir):
    g, m, asked = _batch(spark, sf_dir)
    found = batch.search_all(g, m, asked)
    paged = batch.paging(asked)
    pages = batch.requested_pages(found, paged)
    total = paged.select("request_id", "page_number", "page_size").join(batch.totals(found), "request_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return source.response_documents(pages, batch.with_pages(total))


@query(
    "response_documents_json",
    f"""WITH {X.SQL_REQUESTS}, known AS (SELECT * FROM req WHERE EXISTS (FROM g WHERE g.platform = req.platform AND g.version = req.version)),
t AS (SELECT request_id, count(id) AS total FROM res GROUP BY request_id),
page AS (SELECT request_id, to_json(list({{'id': id, 'group_id': group_id, 'source': source, 'language': coalesce(language, ''), 'file_name': file_name, 'bundle_name': bundle_name, 'text_hash': coalesce(md5(target), '')}} ORDER BY row_number)) AS data
  FROM num JOIN known USING (request_id) WHERE row_number > CAST(page_number - 1 AS BIGINT) * page_size AND row_number <= CAST(page_number AS BIGINT) * page_size GROUP BY request_id)
SELECT request_id, coalesce(CAST(data AS VARCHAR), '[]') AS data, coalesce(total, 0) AS total, CAST(ceil(coalesce(total, 0) / CAST(page_size AS DOUBLE)) AS BIGINT) AS last_page
FROM known LEFT JOIN t USING (request_id) LEFT JOIN page USING (request_id)""",
)
def response_documents_json(spark, sf_dir):
    """The same documents as text: of each row its columns, the localized text as a digest."""
    row = lambda r: F.struct(*(F.coalesce(r[c], F.lit("")).alias(c) if c == "language" else r[c].alias(c) for c in RESULT_COLUMNS if c != "target"), F.coalesce(F.md5(r["target"]), F.lit("")).alias("text_hash"))
    return response_documents(spark, sf_dir).select("request_id", F.to_json(F.transform("data", row)).alias("data"), "total", "last_page")


SQL_COLUMN_REQUESTS = (
    X.SQL_MAP
    + r""",
req AS (
  SELECT item_id AS request_id, CASE item_id % 2 WHEN 0 THEN 'ios' ELSE 'macos' END AS platform, 26 AS version, ['key', 'file', 'bundle'][item_id % 3 + 1] AS column_alias,
    ['equal', 'startsWith', 'notEqual'][(item_id // 3) % 3 + 1] AS operator,
    CASE item_id % 3 WHEN 0 THEN concat('a_b.', item_id % 7) WHEN 1 THEN concat('file', item_id % 11, '.strings') ELSE concat('bundle', item_id % 7) END AS q,
    CASE WHEN item_id % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['English'] END AS languages
  FROM benchmark),
cell AS (SELECT req.request_id, g.*, operator, q, CASE column_alias WHEN 'key' THEN source WHEN 'file' THEN file_name ELSE bundle_name END AS value FROM g JOIN req USING (platform, version)
  WHERE language IN (SELECT code FROM lm WHERE lm.platform = g.platform AND lm.version = g.version AND (len(languages) = 0 OR list_contains(languages, language_name))))"""
)


@query("batch_advanced", f"WITH {SQL_COLUMN_REQUESTS} SELECT request_id, platform, version, {SEVEN} FROM cell WHERE CASE operator WHEN 'equal' THEN value = q WHEN 'notEqual' THEN value <> q ELSE starts_with(value, q) END")
def batch_advanced(spark, sf_dir):
    g, m = _views(spark, sf_dir)
    return batch.search_columns(g, m, X.column_requests(spark, sf_dir)).select("request_id", *RELEASE, *RESULT_COLUMNS)


@query(
    "random_bundle_browse",
    f"""WITH {X.SQL_DOCS}, drawn AS (SELECT platform, version, arg_min(bundle_name, md5(concat(bundle_name, ':7'))) AS bundle_name FROM (SELECT DISTINCT platform, version, bundle_name FROM g) GROUP BY ALL),
hit AS (SELECT DISTINCT platform, version, group_id FROM g SEMI JOIN drawn USING (platform, version, bundle_name))
SELECT platform, version, {SEVEN} FROM g SEMI JOIN hit USING (platform, version, group_id)""",
)
def random_bundle_browse(spark, sf_dir):
    return catalog.browse_random_bundle(X.glossary_docs(spark, sf_dir), seed=7).select(*RELEASE, *RESULT_COLUMNS)


@query("postings_lookup", f"WITH {X.SQL_DOCS} SELECT {SEVEN} FROM g WHERE contains(target_norm, 'haus')")
def postings_lookup(spark, sf_dir):
    g = X.glossary_docs(spark, sf_dir)
    return postings.lookup(postings.store(g, staged(spark, "postings")), g, "Haus").select(*RESULT_COLUMNS)


@query(
    "postings_batch",
    f"""WITH {X.SQL_REQUESTS} SELECT DISTINCT request_id, platform, version, id FROM g JOIN req USING (platform, version) WHERE length(q) >= 3 AND contains(target_norm, q)""",
)
def postings_batch(spark, sf_dir):
    g, _, asked = _batch(spark, sf_dir)
    return postings.batch_matches(postings.store(g, staged(spark, "postings")), g, asked)


@query("postings_batch_all", f"WITH {X.SQL_REQUESTS} SELECT DISTINCT request_id, platform, version, id FROM g JOIN req USING (platform, version) WHERE length(q) > 0 AND contains(target_norm, q)")
def postings_batch_all(spark, sf_dir):
    g, _, asked = _batch(spark, sf_dir)
    return postings.batch_lookup(postings.store(g, staged(spark, "postings")), g, asked)


LINES = "SELECT l_linenumber AS id, l_orderkey AS group_id, p_type AS source, p_name AS target, l_returnflag AS language, l_linestatus AS file_name, p_brand AS bundle_name FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(
    "lines_search",
    f"""WITH g AS ({LINES}), rows AS (SELECT * FROM g WHERE language IN ('A', 'R'))
SELECT CAST(id AS BIGINT) AS id, {SEVEN[4:]} FROM rows WHERE group_id IN (SELECT group_id FROM rows WHERE contains(lower(target), 'ring') AND bundle_name = 'Brand#2')""",
)
def lines_search(spark, sf_dir):
    """Group expansion on the largest table, whose rows have ties and no unique id."""
    g = X.glossary_lines(spark, sf_dir)
    codes = spark.createDataFrame([("ios", 26, "A", "A"), ("ios", 26, "R", "R")], "platform string, version int, language_name string, code string")
    return search.search(g, codes, "ios", 26, term="ring", bundle="Brand#2").rows.select(*RESULT_COLUMNS)


@query("talk_headers", "WITH g AS (SELECT conv_id AS group_id, concat('conv.', turn) AS source, role AS language, conv_id * 1000 + turn AS id FROM conversations) SELECT 'ios' AS platform, 26 AS version, group_id, arg_min(source, (language, id)) AS header, count(*) AS items FROM g GROUP BY group_id")
def talk_headers(spark, sf_dir):
    return catalog.group_headers(X.glossary_talk(spark, sf_dir))


#: What is left after the releases are published and one of them, changed and smaller by its untitled rows, once more.
SQL_PUBLISHED = (
    X.SQL_DOCS
    + """,
p AS (
  SELECT * FROM g WHERE NOT (platform = 'ios' AND version = 18)
  UNION ALL SELECT * REPLACE (concat(source, '!') AS source, concat('new ', bundle_name) AS bundle_name) FROM g WHERE platform = 'ios' AND version = 18 AND language <> 'en')"""
)


def _published(spark: SparkSession, sf_dir: str) -> GlossaryStore:
    """A store with the newest releases published first, the others beside them, and then ios 18 in a new form."""
    g, store = X.glossary_docs(spark, sf_dir), GlossaryStore(spark, staged(spark, "store"))
    store.publish(g.where("version = 26"))
    store.publish(g.where("version <> 26"))
    changed = g.where(of_release("ios", 18) & (F.col("language") != "en"))
    store.publish(changed.withColumns({"source": F.concat("source", F.lit("!")), "bundle_name": F.concat(F.lit("new "), "bundle_name")}))
    store.vacuum()
    return store


@query("published_glossary", f"WITH {SQL_PUBLISHED} SELECT {SEVEN}, platform, version FROM p")
def published_glossary(spark, sf_dir):
    """Releases published one after the other, one of them replaced: the others stay as they were."""
    return _published(spark, sf_dir).glossary().select(*RESULT_COLUMNS, *RELEASE)


@query("published_search", f"WITH {SQL_PUBLISHED}, rows AS (SELECT * FROM p WHERE platform = 'ios' AND version = 18 AND language IN (SELECT language FROM g WHERE platform = 'ios' AND version = 18)) SELECT {SEVEN} FROM rows WHERE group_id IN (SELECT group_id FROM rows WHERE {HAS_TERM})")
def published_search(spark, sf_dir):
    """A search of the replaced release, whose name is looked up in the manifest."""
    store = _published(spark, sf_dir)
    return search.search(store.glossary(), _views(spark, sf_dir)[1], "ios", 18, term=TERM, releases=store.releases()).rows.select(*RESULT_COLUMNS)


@query("catalogue_releases", f"WITH {SQL_PUBLISHED}, n AS (SELECT platform, version, count(*) AS row_count FROM p GROUP BY ALL) SELECT platform, version, row_count, version = max(version) OVER (PARTITION BY platform) AS latest FROM n")
def catalogue_releases(spark, sf_dir):
    """Counts of the releases and the newest of each platform, from the manifest alone."""
    releases = _published(spark, sf_dir).releases().select(*RELEASE, "row_count")
    newest = catalog.latest_releases(releases).withColumn("latest", F.lit(True))
    return releases.join(newest, [*RELEASE], "left").withColumn("latest", F.coalesce("latest", F.lit(False)))


@query("catalogue_bundles", f"WITH {SQL_PUBLISHED} SELECT platform, version, bundle_name, count(*) AS row_count FROM p GROUP BY ALL")
def catalogue_bundles(spark, sf_dir):
    """Bundles of the releases with their rows, from the catalogue alone."""
    return _published(spark, sf_dir).bundles()


@query(
    "catalogue_browse",
    f"""WITH {SQL_PUBLISHED}, drawn AS (SELECT platform, version, arg_min(bundle_name, md5(concat(bundle_name, ':7'))) AS bundle_name FROM (SELECT DISTINCT platform, version, bundle_name FROM p) GROUP BY ALL),
hit AS (SELECT DISTINCT platform, version, group_id FROM p SEMI JOIN drawn USING (platform, version, bundle_name))
SELECT platform, version, {SEVEN} FROM p SEMI JOIN hit USING (platform, version, group_id)""",
)
def catalogue_browse(spark, sf_dir):
    """A bundle of each release drawn from the catalogue, and the groups that touch it."""
    store = _published(spark, sf_dir)
    return catalog.browse_random_bundle(store.glossary(), 7, store.bundles()).select(*RELEASE, *RESULT_COLUMNS)


@query("batch_terms", f"WITH {X.SQL_REQUESTS} SELECT DISTINCT platform, version, id, q FROM g JOIN asked USING (platform, version) WHERE length(q) > 0 AND contains(target_norm, q)")
def batch_terms(spark, sf_dir):
    """Which of its release's terms each text contains: all terms in one pass."""
    g, _, asked = _batch(spark, sf_dir)
    terms = asked.where(batch.search_status() == "ok").select(*RELEASE, normalised("q").alias("q"))
    return matcher.find_terms(g, matcher.collect(terms, None), ["id"])


SQL_PREFIX_REQUESTS = (
    X.SQL_MAP
    + """,
req AS (SELECT item_id AS request_id, CASE item_id % 2 WHEN 0 THEN 'ios' ELSE 'macos' END AS platform, 26 AS version,
  ['key', 'localization', 'language', 'file', 'bundle'][item_id % 5 + 1] AS column_alias,
  CASE item_id % 5 WHEN 0 THEN left(concat('a_b.', item_id % 7), 1 + CAST(item_id % 4 AS INTEGER)) WHEN 1 THEN left(text, 1 + CAST(item_id % 6 AS INTEGER)) WHEN 2 THEN left('en_XX', 1 + CAST(item_id % 5 AS INTEGER)) WHEN 3 THEN concat('file', item_id % 11) ELSE 'bundle' END AS q FROM benchmark)"""
)


@query(
    "batch_prefixes",
    f"""WITH {SQL_PREFIX_REQUESTS} SELECT request_id, g.platform, g.version, {SEVEN} FROM g JOIN req USING (platform, version)
WHERE starts_with(CASE column_alias WHEN 'key' THEN source WHEN 'localization' THEN target WHEN 'language' THEN language WHEN 'file' THEN file_name ELSE bundle_name END, q)
  AND EXISTS (FROM lm WHERE lm.platform = g.platform AND lm.version = g.version AND lm.code = g.language)""",
)
def batch_prefixes(spark, sf_dir):
    """Prefixes of many lengths on all five columns."""
    return batch.search_columns(*_views(spark, sf_dir), X.prefix_requests(spark, sf_dir)).select("request_id", *RELEASE, *RESULT_COLUMNS)


WORD_HIT = r"regexp_matches(target_norm, concat('(^|[^\p{L}\p{N}_])', regexp_replace(q, '([^\p{L}\p{N}_])', '\\\1', 'g'), '($|[^\p{L}\p{N}_])'))"


@query("batch_search_word", f"WITH {X.SQL_REQUESTS.replace('contains(target_norm, q)', WORD_HIT)} SELECT request_id, platform, version, {SEVEN} FROM res")
def batch_search_word(spark, sf_dir):
    """Whole words and phrases of a table of requests, all in one pass."""
    return batch.search_all(*_batch(spark, sf_dir), mode="word").select("request_id", *RELEASE, *RESULT_COLUMNS)


@query("positions_lookup", f"WITH {X.SQL_DOCS} SELECT platform, version, id, CAST((length(target_norm) - length(replace(target_norm, 'haus', ''))) // 4 AS INTEGER) AS hits FROM g WHERE contains(target_norm, 'haus')")
def positions_lookup(spark, sf_dir):
    """Rows and places of one term from a stored positional index, which is all that is read."""
    index = positions.write(X.glossary_docs(spark, sf_dir), staged(spark, "positions"))
    return positions.lookup_ids(index, "Haus")


@query("positions_batch", f"WITH {X.SQL_REQUESTS} SELECT DISTINCT request_id, platform, version, id FROM g JOIN req USING (platform, version) WHERE length(q) > 0 AND contains(target_norm, q)")
def positions_batch(spark, sf_dir):
    """All terms of the requests, of any length, from a stored positional index."""
    g, _, asked = _batch(spark, sf_dir)
    index = positions.write(g, staged(spark, "positions"))
    return positions.batch_lookup(index, asked).drop("hits")


@query("bucketed_search", _expanded(HAS_TERM))
def bucketed_search(spark, sf_dir):
    """The search over a stored glossary whose groups lie in buckets: it expands them where they lie."""
    g, m = _views(spark, sf_dir)
    name = f"glossary_{uuid.uuid4().hex}"
    stored = source.write_bucketed(g, name, staged(spark, name), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return search.search(stored, m, "ios", 26, term=TERM, releases=X.releases(spark)).rows.select(*RESULT_COLUMNS)


@query(
    "deep_page",
    f"""WITH g AS ({LINES}), rows AS (SELECT * FROM g WHERE contains(lower(target), 'e')), n AS (SELECT count(*) // 2 AS half FROM rows),
num AS (SELECT CAST(id AS BIGINT) AS id, {SEVEN[4:]}, row_number() OVER (ORDER BY {ORDER}) AS row_number FROM rows)
SELECT num.* FROM num, n WHERE row_number > half AND row_number <= half + 200""",
)
def deep_page(spark, sf_dir):
    """The two hundred rows in the middle of a large result, found by rank."""
    rows = X.glossary_lines(spark, sf_dir).where(search.contains_term("e")).select(*RESULT_COLUMNS)
    return search.page_by_rank(rows, rows.count() // 2, 200)


@query("search_positions", _expanded(f"{HAS_TERM} AND bundle_name = 'bundle1'", "'German'"))
def search_positions(spark, sf_dir):
    """Term, bundle and language of a single search, the term from stored positional postings."""
    g, m = _views(spark, sf_dir)
    index = positions.write(g, staged(spark, "positions"))
    return search.search(g, m, "ios", 26, term=TERM, bundle="bundle1", languages=["German"], releases=X.releases(spark), index=index).rows.select(*RESULT_COLUMNS)


@query("batch_search_positions", f"WITH {X.SQL_REQUESTS} SELECT request_id, platform, version, {SEVEN} FROM res")
def batch_search_positions(spark, sf_dir):
    """The requests' terms from stored positional postings: no text is read to match them."""
    g, m, asked = _batch(spark, sf_dir)
    return batch.search_all(g, m, asked, positions.write(g, staged(spark, "positions"))).select("request_id", *RELEASE, *RESULT_COLUMNS)
