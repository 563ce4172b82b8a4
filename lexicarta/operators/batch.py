"""Whole tables of requests: cleaning, validation, search, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised, trimmed
from ..schema import COLUMNS, DEFAULT_SIZE, MOST_PAGE, MOST_SIZE, OPERATORS, RELEASE, total_order
from . import matcher, positions, postings

#: Groups whose rows are numbered together: what one task numbers does not follow the request.
RANGE = 4096


def clean(requests: DataFrame, *columns: str) -> DataFrame:
    """Trim the text fields: blanks of every kind, tabs and line ends."""
    return requests.withColumns({c: trimmed(c) for c in columns})


def _number(column: str, default: int, most: int) -> Column:
    """The rule of ``search.clamp`` for a column of text."""
    digits = F.regexp_extract(F.col(column), r"^[\s\p{Z}]*([+-]?[0-9]+)", 1)
    small = F.length(digits) <= 18
    value = F.when(small, digits.try_cast("bigint")).when(F.startswith(digits, F.lit("-")), F.lit(1)).otherwise(F.lit(most))
    return F.coalesce(F.when(digits != "", F.greatest(F.lit(1), F.least(F.lit(most), value))), F.lit(default)).cast("bigint")


def paging(requests: DataFrame) -> DataFrame:
    """From the strings ``page`` and ``size``: ``page_number`` (1 or more), ``page_size`` (1 to 200), ``row_offset``; all longs."""
    paged = requests.withColumns({"page_number": _number("page", 1, MOST_PAGE), "page_size": _number("size", DEFAULT_SIZE, MOST_SIZE)})
    return paged.withColumn("row_offset", (F.col("page_number") - 1) * F.col("page_size"))


def with_pages(paged: DataFrame) -> DataFrame:
    """Add ``last_page`` and ``loaded`` to rows that have a ``total``."""
    return paged.withColumn("last_page", F.ceil(F.col("total") / F.col("page_size")).cast("long")).withColumn("loaded", F.least(F.col("page_number") * F.col("page_size"), F.col("total")))


def search_status(term: str = "q", bundle: str = "bundle") -> Column:
    """``ok`` or ``missing_term``."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return F.when(blank(term) & blank(bundle), "missing_term").otherwise("ok")


def column_status(alias: str = "column_alias", operator: str = "operator", term: str = "q") -> Column:
    """``bad_column``, ``bad_operator``, ``empty_query`` or ``ok``, in that order."""
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    return F.when(~known(alias, COLUMNS), "bad_column").when(~known(operator, OPERATORS), "bad_operator").when(F.coalesce(F.col(term), F.lit("")) == "", "empty_query").otherwise("ok")


def with_release_status(requests: DataFrame, releases: DataFrame) -> DataFrame:
    """Replace the text ``version`` (``latest``, empty or a number) by the release's number and add ``release_status``.

    The status is ``ok``, ``unknown_platform`` or ``unknown_version``; every request
    stays, and ``version`` is null where it is no number.
    """
    newest = releases.groupBy("platform").agg(F.max("version").alias("newest"))
    asked = requests.join(newest, "platform", "left").withColumn("version", F.when(F.coalesce(F.col("version"), F.lit("")).isin("", "latest"), F.col("newest")).otherwise(F.expr("try_cast(version as int)")))
    known = releases.select(*RELEASE, F.lit(True).alias("known")).distinct()
    status = F.when(F.col("newest").isNull(), "unknown_platform").when(F.col("known"), "ok").otherwise("unknown_version")
    return asked.join(known, [*RELEASE], "left").withColumn("release_status", status).drop("newest", "known")


def resolve_versions(requests: DataFrame, releases: DataFrame) -> DataFrame:
    """The requests for a known release, with its number as ``version``; ``with_release_status`` keeps the others."""
    return with_release_status(requests, releases).where("release_status = 'ok'").drop("release_status")


def _with_selection(requests: DataFrame) -> DataFrame:
    """Add ``chosen``: the languages a request names as a text, the same for equal lists; ``[]`` for none."""
    names = F.sort_array(F.array_distinct(F.coalesce("languages", F.array().cast("array<string>"))))
    return requests.withColumn("chosen", F.to_json(names))


def _selected(requests: DataFrame, language_map: DataFrame) -> DataFrame:
    """``platform, version, chosen, language``: codes of each list of languages that occurs, and for no list all mapped codes.

    Requests with equal lists share one selection; names join the map by name.
    """
    lists = requests.where("chosen <> '[]'").select(*RELEASE, "chosen", "languages").dropDuplicates([*RELEASE, "chosen"])
    named = lists.select(*RELEASE, "chosen", F.explode("languages").alias("language_name")).join(language_map, [*RELEASE, "language_name"])
    every = language_map.select(*RELEASE, F.lit("[]").alias("chosen"), F.col("code").alias("language"))
    return named.select(*RELEASE, "chosen", F.col("code").alias("language")).unionByName(every).distinct()


def search_all(glossary: DataFrame, language_map: DataFrame, requests: DataFrame, index: DataFrame | None = None, mode: str = "contains") -> DataFrame:
    """Group-expanding search of every request ``(request_id, platform, version, q, bundle, languages)``.

    All terms together go over each text once (``matcher.find_terms``), so the work for a
    row does not grow with the requests; what was found joins them by release and term.
    With a stored ``index`` they are looked up instead and find rows that have an id: in
    positional postings (``positions.write``) without reading a text, in trigram postings
    (``postings.build``) by their rarest trigram and then in the texts.  Terms too many for
    one pass and without an index take the latter.  With ``mode="word"``
    terms are whole words or phrases, as in ``search``, and always go over the texts, in more
    passes if they are very many.  Requests for a bundle alone join by release and bundle.  Returns ``request_id`` and the glossary's
    columns.
    """
    key = [*RELEASE, "chosen", "language"]
    asked = _with_selection(requests.where(search_status() == "ok").select("request_id", *RELEASE, normalised("q").alias("q"), "bundle", "languages"))
    codes = _selected(asked, language_map)
    asked = asked.drop("languages")
    no_term = F.coalesce("q", F.lit("")) == ""
    terms = asked.where(~no_term)
    shards = matcher.collect(terms, None) if mode == "word" else matcher.collect(terms) if index is None else None
    if shards is not None:
        near = matcher.find_terms(glossary, shards, ["group_id", "language", "bundle_name"], mode)
        found = near.join(terms, [*RELEASE, "q"])
    else:
        places = glossary.select(*RELEASE, "id", "group_id", "language", "bundle_name").distinct()
        if index is not None and "places" in index.columns:
            ids = positions.batch_lookup(index, terms).drop("hits")
        else:
            ids = postings.batch_lookup(postings.build(glossary) if index is None else index, glossary, terms)
        found = places.join(ids, [*RELEASE, "id"]).join(terms.drop(*RELEASE), "request_id")
    found = found.where((F.coalesce("bundle", F.lit("")) == "") | (F.col("bundle_name") == F.col("bundle")))
    bundles = asked.where(no_term).drop("q").withColumnRenamed("bundle", "bundle_name")
    columns = ["request_id", *RELEASE, "chosen", "group_id", "language"]
    near = found.select(*columns).unionByName(glossary.join(bundles, [*RELEASE, "bundle_name"]).select(*columns))
    groups = near.join(codes, key, "left_semi").drop("language").distinct()
    return glossary.join(groups, [*RELEASE, "group_id"]).join(codes, key, "left_semi").drop("chosen")


def search_columns(glossary: DataFrame, language_map: DataFrame, requests: DataFrame) -> DataFrame:
    """Column search of every valid request ``(request_id, platform, version, column_alias, operator, q, languages)``.

    Equal comparisons join by release and the column itself.  For prefixes each value is
    joined by its own prefixes, of just those lengths that occur among the requests for the
    column, so nothing is compared beyond the matches.  Requests for unequal values return
    nearly their whole release, which is what they meet.
    """
    asked = _with_selection(requests.where(column_status() == "ok").select("request_id", *RELEASE, "column_alias", "operator", "q", "languages"))
    codes = _selected(asked, language_map)
    asked = asked.drop("languages")
    value = F.coalesce(*(F.when(F.col("column_alias") == a, F.col(c)) for a, c in COLUMNS.items()))
    found = glossary.join(asked.where("operator = 'notEqual'"), [*RELEASE]).where(value != F.col("q")).drop("column_alias", "operator", "q")
    lengths: dict[str, list[int]] = {}
    for alias, n in asked.where("operator = 'startsWith'").select("column_alias", F.length("q")).distinct().collect():
        lengths.setdefault(alias, []).append(n)
    for a, c in COLUMNS.items():
        own = lambda operator, name, a=a: asked.where((F.col("operator") == operator) & (F.col("column_alias") == a)).select("request_id", *RELEASE, "chosen", F.col("q").alias(name))
        found = found.unionByName(glossary.join(own("equal", c), [*RELEASE, c]))
        if a in lengths:
            sizes = F.explode(F.array(*map(F.lit, sorted(lengths[a]))))
            prefixes = glossary.withColumn("prefix_length", sizes).where(F.col("prefix_length") <= F.length(c))
            prefixes = prefixes.withColumn("prefix", F.substring(F.col(c), F.lit(1), F.col("prefix_length")))
            found = found.unionByName(prefixes.join(own("startsWith", "prefix"), [*RELEASE, "prefix"]).drop("prefix", "prefix_length"))
    return found.join(codes, [*RELEASE, "chosen", "language"], "left_semi").drop("chosen")


def numbered(rows: DataFrame) -> DataFrame:
    """Every row of every request with ``row_number`` in its whole result.

    Rows are numbered within ranges of groups, and each range starts where the counts
    of those before it end, so a request for much of a release is no single task's work.
    """
    key = ["request_id", "range"]
    placed = rows.withColumn("range", F.coalesce(F.floor(F.col("group_id") / RANGE), F.lit(-(1 << 62))))
    before = Window.partitionBy("request_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = placed.withColumn("row_number", F.row_number().over(Window.partitionBy(*key).orderBy(*total_order())))
    return inside.join(starts, key).withColumn("row_number", F.col("row_number") + F.col("start")).drop("range", "start")


def number_pages(rows: DataFrame, size: int = DEFAULT_SIZE) -> DataFrame:
    """Every row of every request with ``row_number`` and ``page``."""
    return numbered(rows).withColumn("page", F.floor((F.col("row_number") - 1) / size) + 1)


def first_pages(rows: DataFrame, size: int = DEFAULT_SIZE) -> DataFrame:
    """The first page of every request: a grouped top-N, pruned before the shuffle."""
    order = Window.partitionBy("request_id").orderBy(*total_order())
    return rows.withColumn("row_number", F.row_number().over(order)).where(F.col("row_number") <= size)


def requested_pages(rows: DataFrame, paged: DataFrame) -> DataFrame:
    """The page each request ``(request_id, page_size, row_offset)`` asks for, with ``row_number``."""
    pages = numbered(rows).join(paged.select("request_id", "page_size", "row_offset"), "request_id")
    return pages.where((F.col("row_number") > F.col("row_offset")) & (F.col("row_number") <= F.col("row_offset") + F.col("page_size"))).drop("page_size", "row_offset")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("request_id").agg(F.count("id").alias("total"))
