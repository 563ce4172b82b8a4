"""Group-expanding full-text search and column search over one release."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_term, contains_word
from ..schema import COLUMNS, DEFAULT_SIZE, MOST_PAGE, MOST_SIZE, OPERATORS, RELEASE, RESULT_COLUMNS, of_release, total_order
from . import positions


_NUMBER = re.compile(r"\s*([+-]?[0-9]+)")


def clamp(value: object, default: int, most: int = MOST_PAGE) -> int:
    """A number from 1 to ``most`` from a request field: the decimal digits it begins with, after blanks and a sign.

    What follows the digits is ignored; a field without them means the default.  ``batch.paging``
    reads columns by the same rule.
    """
    found = _NUMBER.match(str(value))
    return max(1, min(most, int(found[1]))) if found else default


#: Rows before a page from which it is found by rank; and groups whose rows are counted together for that.
DEEP, RANK_GROUPS = 10_000, 1024


def page_by_rank(rows: DataFrame, start: int, size: int, groups: int = RANK_GROUPS) -> DataFrame:
    """Rows ``start + 1`` to ``start + size`` in the total order, with ``row_number``, however far down they are.

    Rows are counted by ranges of ``groups`` groups, then, within the ranges that hold the
    page, by group; only the groups that hold it are sorted.  What is sorted follows the
    largest group, not the page's number.  The counts are one row for each range.
    """
    span = F.coalesce(F.floor(F.col("group_id") / groups), F.lit(-(1 << 62)))
    inside = _holding(rows.withColumn("span", span), "span", F.lit(0).cast("long"), start, size)
    near = inside.rows.withColumn("place", F.coalesce("group_id", F.lit(-(1 << 62))))
    own = _holding(near, "place", inside.before, start, size)
    number = F.row_number().over(Window.orderBy(*total_order())).cast("long") + own.before
    return own.rows.drop("span", "place").withColumn("row_number", number).where(F.col("row_number").between(start + 1, start + size))


@dataclass(frozen=True)
class _Part:
    """Rows that hold a page, and how many rows of the result stand before them."""

    rows: DataFrame
    before: Column


def _holding(rows: DataFrame, key: str, before: Column, start: int, size: int) -> _Part:
    ahead = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", before + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    held = counts.where((F.col("first") < start + size) & (F.col("first") + F.col("n") > start))
    low, high, first = (held.agg(f.alias("v")).scalar() for f in (F.min(key), F.max(key), F.min("first")))
    return _Part(rows.where(F.col(key).between(low, high)), first)


@dataclass(frozen=True)
class SearchResult:
    """Lazy rows of a whole result, with its total and one page as DataFrames."""

    rows: DataFrame
    page_number: int
    size: int

    def total(self) -> DataFrame:
        """``total, last_page``; counts rows with an id, not groups."""
        count = self.rows.agg(F.count("id").alias("total"))
        return count.withColumn("last_page", F.ceil(F.col("total") / self.size).cast("long"))

    def page(self) -> DataFrame:
        """One top-N over the total order: no full sort, no overlap between pages. Deep pages are found by rank."""
        start = (self.page_number - 1) * self.size
        if start > DEEP:
            return page_by_rank(self.rows.select(*RESULT_COLUMNS), start, self.size).drop("row_number").orderBy(*total_order())
        return self.rows.select(*RESULT_COLUMNS).orderBy(*total_order()).offset(start).limit(self.size)

    def numbered_page(self) -> DataFrame:
        """The page with ``row_number`` in the whole result; the window sees one page only."""
        start = (self.page_number - 1) * self.size
        if start > DEEP:
            return page_by_rank(self.rows.select(*RESULT_COLUMNS), start, self.size)
        return self.page().withColumn("row_number", F.row_number().over(Window.orderBy(*total_order())) + start)

    def pages(self, total: int) -> int:
        return math.ceil(total / self.size)


def of_languages(rows: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Rows in a short list of codes, which reaches the scan; a whole map joins by ``in_languages``."""
    return rows.where(F.col("language").isin(list(codes)))


def of_bundle(rows: DataFrame, bundle: str | None) -> DataFrame:
    """Rows of the bundle; an empty or missing name is no filter."""
    return rows.where(F.col("bundle_name") == bundle) if bundle else rows


def require_release(rows: DataFrame, releases: DataFrame, platform: str, version: int) -> DataFrame:
    """``rows``, whose plan also looks the release up among ``releases`` and fails with the known ones if it is not there.

    The look-up is a branch of its own that adds no row, for a filter would go with rows
    that turn out to be empty.  It reads ``releases`` (a manifest's, say) and nothing else.
    """
    names = F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", *RELEASE))), ", ")
    known = F.coalesce(F.max(of_release(platform, version)), F.lit(False))
    failure = F.raise_error(F.concat(F.lit(f"no release {platform} {version}; known: "), names))
    checked = releases.select(*RELEASE).agg(F.when(known, F.lit(True)).otherwise(failure).alias("known")).where("not known")
    return rows.unionByName(checked.select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in rows.schema)))


def language_codes(language_map: DataFrame, platform: str, version: int, names: Sequence[str] | None) -> DataFrame:
    """Codes mapped for the release: of the names given, or of all languages when none is.

    An unknown name adds nothing; a selection of unknown names only selects nothing.
    """
    codes = language_map.where(of_release(platform, version))
    if names:
        codes = codes.where(F.col("language_name").isin(list(names)))
    return codes.select(F.col("code").alias("language")).distinct()


def in_languages(glossary: DataFrame, language_map: DataFrame, platform: str, version: int, names: Sequence[str] | None = None) -> DataFrame:
    rows = glossary.where(of_release(platform, version))
    return rows.join(language_codes(language_map, platform, version, names), "language", "left_semi")


def matched_groups(rows: DataFrame, term: str | None, bundle: str | None, mode: str = "contains") -> DataFrame:
    """Distinct groups with at least one row that meets term and bundle."""
    if not term and not bundle:
        raise ValueError("a search needs a term or a bundle")
    rows = of_bundle(rows, bundle)
    if term:
        rows = rows.where({"contains": contains_term, "word": contains_word}[mode](term))
    return rows.select("group_id").distinct()


def search(glossary: DataFrame, language_map: DataFrame, platform: str, version: int, term: str | None = None, bundle: str | None = None, languages: Sequence[str] | None = None, page: object = 1, size: object = DEFAULT_SIZE, mode: str = "contains", releases: DataFrame | None = None, index: DataFrame | None = None) -> SearchResult:
    """All rows, in the languages selected, of every group with a matching row.

    The term and the bundle choose groups; the rows returned need not match either.  The
    result raises for a release that is not among ``releases``, by default those with a
    language map.  With positional postings as ``index`` (``positions.write``) matching rows are
    found there, those that have an id, and only the rows of their groups read their texts.
    """
    rows = in_languages(glossary, language_map, platform, version, languages)
    if index is not None and term and mode == "contains":
        ids = positions.lookup_ids(index.where(of_release(platform, version)), term).select("id")
        matched = of_bundle(rows, bundle).join(ids, "id", "left_semi").select("group_id").distinct()
    else:
        matched = matched_groups(rows, term, bundle, mode)
    found = require_release(rows.join(matched, "group_id", "left_semi"), language_map if releases is None else releases, platform, version)
    return SearchResult(found, clamp(page, 1), clamp(size, DEFAULT_SIZE, MOST_SIZE))


def predicate(alias: str, operator: str, value: str) -> Column:
    """Exact comparisons of one column; a null in the column meets none of them."""
    if alias not in COLUMNS:
        raise ValueError(f"unknown column: {alias}")
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator: {operator}")
    if not value:
        raise ValueError("empty search word")
    column = F.col(COLUMNS[alias])
    if operator == "equal":
        return column == F.lit(value)
    if operator == "notEqual":
        return column != F.lit(value)
    return F.startswith(column, F.lit(value))


def search_column(glossary: DataFrame, language_map: DataFrame, platform: str, version: int, alias: str, operator: str, value: str, languages: Sequence[str] | None = None, page: object = 1, size: object = DEFAULT_SIZE, releases: DataFrame | None = None) -> SearchResult:
    """Rows whose column meets the predicate; groups are not expanded. Unknown releases raise as in ``search``."""
    wanted = predicate(alias, operator, value)
    rows = in_languages(glossary, language_map, platform, version, languages).where(wanted)
    found = require_release(rows, language_map if releases is None else releases, platform, version)
    return SearchResult(found, clamp(page, 1), clamp(size, DEFAULT_SIZE, MOST_SIZE))
