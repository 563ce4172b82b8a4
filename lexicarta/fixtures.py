"""Glossary views over general tables, for queries that must run on any data at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import RELEASE

VERSIONS = {"ios": (26, 18, 17, 16, 15), "macos": (26, 15, 14, 13, 12)}
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def glossary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a glossary: groups of four rows over ten releases and seven bundles."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    group = F.floor(n / 4)
    ios = group % 2 == 0
    return d.select(
        n.alias("id"), group.cast("long").alias("group_id"),
        F.concat(_pick(n % 5, ("a_b", "a%b", "axb", "a[b", "a\\b")), F.lit("."), (n % 7).cast("string")).alias("source"),
        F.col("text").alias("target"),
        F.concat("lang", _pick(n % 6, ("", "_XX", "-iphoneos", "~ipad", "-macos", "_GB~iphone"))).alias("language"),
        F.concat(F.lit("file"), (n % 11).cast("string"), F.lit(".strings")).alias("file_name"),
        F.concat(F.lit("bundle"), ((n % 4 + F.floor(n / 40)) % 7).cast("string")).alias("bundle_name"),
        F.when(ios, "ios").otherwise("macos").alias("platform"),
        F.when(ios, _pick(F.floor(n / 8) % 5, VERSIONS["ios"])).otherwise(_pick(F.floor(n / 8) % 5, VERSIONS["macos"])).alias("version"),
        F.lower("text").alias("target_norm"),
    )


def language_map(glossary: DataFrame) -> DataFrame:
    """Codes present in each release by first two letters; tablet codes of versions 15 are not mapped."""
    name = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[F.substring("language", 1, 2)]
    codes = glossary.where(~((F.col("version") == 15) & F.endswith("language", F.lit("~ipad")))).select(*RELEASE, "language").distinct()
    return codes.select(*RELEASE, name.alias("language_name"), F.col("language").alias("code"))


def releases(spark: SparkSession) -> DataFrame:
    """The releases that these views deal rows to."""
    return spark.createDataFrame([(p, v) for p, versions in VERSIONS.items() for v in versions], "platform string, version int")


def glossary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with ``part``: large, with ties and without a unique id."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_linenumber").cast("long").alias("id"), F.col("l_orderkey").alias("group_id"), F.col("p_type").alias("source"), F.col("p_name").alias("target"),
        F.col("l_returnflag").alias("language"), F.col("l_linestatus").alias("file_name"), F.col("p_brand").alias("bundle_name"),
        F.lit("ios").alias("platform"), F.lit(26).alias("version"), F.lower("p_name").alias("target_norm"),
    )


def glossary_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a glossary: natural groups with ties of group and language."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("group_id"), F.concat(F.lit("conv."), F.col("turn").cast("string")).alias("source"),
        F.col("text").alias("target"), F.col("role").alias("language"), F.lit("talk.strings").alias("file_name"),
        F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string")).alias("bundle_name"), F.lit("ios").alias("platform"), F.lit(26).alias("version"), F.lower("text").alias("target_norm"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search and one column request per benchmark item, good and bad ones; fields are raw text."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    word = F.lower(F.regexp_extract("text", "^[^ \\n]+", 0))
    return b.select(
        i.alias("request_id"),
        _pick(i % 2, ("ios", "macos")).alias("platform"),
        _pick(i % 4, ("latest", "26", "15", "")).alias("version"),
        F.when(i % 5 == 4, F.lit("")).when(i % 7 == 6, F.lit(None)).otherwise(F.concat(F.lit(" "), word)).alias("q"),
        F.when(i % 3 == 0, F.concat(F.lit("bundle"), (i % 7).cast("string"), F.lit(" "))).when(i % 3 == 1, F.lit("")).alias("bundle"),
        F.when(i % 4 == 1, F.array(F.lit("English"))).when(i % 4 == 2, F.array(F.lit("Klingon"))).when(i % 4 == 3, F.array(F.lit("German"), F.lit("French"))).otherwise(F.array().cast("array<string>")).alias("languages"),
        _pick(i % 6, ("key", "localization", "language", "file", "bundle", "nope")).alias("column_alias"),
        _pick(i % 5, ("equal", "notEqual", "startsWith", "like", "equal")).alias("operator"),
        _pick(i % 6, ("0", "", "abc", "2", "-3", "1")).alias("page"),
        _pick(i % 5, ("9999", "0", "", "50", "seven")).alias("size"),
    )


def column_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid column requests: each item asks for one column of its release with a value that fits."""
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        i.alias("request_id"), _pick(i % 2, ("ios", "macos")).alias("platform"), F.lit(26).alias("version"),
        _pick(i % 3, ("key", "file", "bundle")).alias("column_alias"), _pick(F.floor(i / 3) % 3, ("equal", "startsWith", "notEqual")).alias("operator"),
        F.when(i % 3 == 0, F.concat(F.lit("a_b."), (i % 7).cast("string"))).when(i % 3 == 1, F.concat(F.lit("file"), (i % 11).cast("string"), F.lit(".strings"))).otherwise(F.concat(F.lit("bundle"), (i % 7).cast("string"))).alias("q"),
        F.when(i % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("English"))).alias("languages"),
    )


def prefix_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix requests of several lengths: each item asks for one of the five columns."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    first = lambda c, n: F.substring(c, F.lit(1), (n + 1).cast("int"))
    return b.select(
        i.alias("request_id"), _pick(i % 2, ("ios", "macos")).alias("platform"), F.lit(26).alias("version"),
        _pick(i % 5, ("key", "localization", "language", "file", "bundle")).alias("column_alias"), F.lit("startsWith").alias("operator"),
        F.when(i % 5 == 0, first(F.concat(F.lit("a_b."), (i % 7).cast("string")), i % 4)).when(i % 5 == 1, first(F.col("text"), i % 6)).when(i % 5 == 2, first(F.lit("en_XX"), i % 5))
        .when(i % 5 == 3, F.concat(F.lit("file"), (i % 11).cast("string"))).otherwise(F.lit("bundle")).alias("q"),
        F.array().cast("array<string>").alias("languages"),
    )


#: The same views in the oracle's dialect.
SQL_DOCS = r"""
g AS (
  SELECT doc_id AS id, doc_id // 4 AS group_id,
    concat(CASE doc_id % 5 WHEN 0 THEN 'a_b' WHEN 1 THEN 'a%b' WHEN 2 THEN 'axb' WHEN 3 THEN 'a[b' ELSE 'a\b' END, '.', doc_id % 7) AS source,
    text AS target,
    concat(lang, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '_XX' WHEN 2 THEN '-iphoneos' WHEN 3 THEN '~ipad' WHEN 4 THEN '-macos' ELSE '_GB~iphone' END) AS language,
    concat('file', doc_id % 11, '.strings') AS file_name,
    concat('bundle', (doc_id % 4 + doc_id // 40) % 7) AS bundle_name,
    CASE WHEN (doc_id // 4) % 2 = 0 THEN 'ios' ELSE 'macos' END AS platform,
    CAST(CASE WHEN (doc_id // 4) % 2 = 0 THEN [26, 18, 17, 16, 15][(doc_id // 8) % 5 + 1] ELSE [26, 15, 14, 13, 12][(doc_id // 8) % 5 + 1] END AS INTEGER) AS version,
    lower(text) AS target_norm
  FROM documents)"""
SQL_MAP = SQL_DOCS + r""",
lm AS (
  SELECT DISTINCT platform, version, CASE left(language, 2) WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS language_name, language AS code
  FROM g WHERE NOT (version = 15 AND ends_with(language, '~ipad')))"""
SQL_REQUESTS = SQL_MAP + r""",
raw AS (
  SELECT item_id AS request_id, CASE item_id % 2 WHEN 0 THEN 'ios' ELSE 'macos' END AS platform, ['latest', '26', '15', ''][item_id % 4 + 1] AS version,
    CASE WHEN item_id % 5 = 4 THEN '' WHEN item_id % 7 = 6 THEN NULL ELSE concat(' ', lower(regexp_extract(text, '^[^ \n]+'))) END AS q,
    CASE item_id % 3 WHEN 0 THEN concat('bundle', item_id % 7, ' ') WHEN 1 THEN '' END AS bundle,
    CASE item_id % 4 WHEN 1 THEN ['English'] WHEN 2 THEN ['Klingon'] WHEN 3 THEN ['German', 'French'] ELSE CAST([] AS VARCHAR[]) END AS languages,
    ['key', 'localization', 'language', 'file', 'bundle', 'nope'][item_id % 6 + 1] AS column_alias,
    ['equal', 'notEqual', 'startsWith', 'like', 'equal'][item_id % 5 + 1] AS operator,
    ['0', '', 'abc', '2', '-3', '1'][item_id % 6 + 1] AS page, ['9999', '0', '', '50', 'seven'][item_id % 5 + 1] AS size
  FROM benchmark),
newest AS (SELECT platform, max(version) AS newest FROM g GROUP BY platform),
req AS (
  SELECT request_id, raw.platform, CASE WHEN raw.version IN ('', 'latest') THEN newest ELSE TRY_CAST(raw.version AS INTEGER) END AS version, trim(q) AS q, trim(bundle) AS bundle, languages,
    greatest(1, coalesce(TRY_CAST(trim(page) AS INTEGER), 1)) AS page_number, least(200, greatest(1, coalesce(TRY_CAST(trim(size) AS INTEGER), 200))) AS page_size
  FROM raw JOIN newest USING (platform)),
asked AS (SELECT * FROM req WHERE (coalesce(q, '') <> '' OR coalesce(bundle, '') <> '') AND EXISTS (FROM g WHERE g.platform = req.platform AND g.version = req.version)),
codes AS (
  SELECT DISTINCT request_id, code FROM req JOIN lm USING (platform, version)
  WHERE len(languages) = 0 OR list_contains(languages, language_name)),
hit AS (
  SELECT DISTINCT a.request_id, g.platform, g.version, g.group_id FROM g JOIN asked a USING (platform, version) JOIN codes c ON c.request_id = a.request_id AND c.code = g.language
  WHERE (coalesce(q, '') = '' OR contains(target_norm, q)) AND (coalesce(bundle, '') = '' OR bundle_name = bundle)),
res AS (
  SELECT h.request_id, g.* FROM g JOIN hit h USING (platform, version, group_id) JOIN codes c ON c.request_id = h.request_id AND c.code = g.language),
num AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY group_id, language, id, source, target, file_name, bundle_name) AS row_number FROM res)"""
