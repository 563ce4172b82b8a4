"""Catalogues of releases, bundles and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RELEASE


def release_counts(glossary: DataFrame) -> DataFrame:
    return glossary.groupBy(*RELEASE).agg(F.count("*").alias("row_count"))


def latest_releases(glossary: DataFrame) -> DataFrame:
    """The newest version of each platform."""
    return glossary.groupBy("platform").agg(F.max("version").alias("version"))


def latest_rows(glossary: DataFrame) -> DataFrame:
    """All rows of the newest release of each platform."""
    return glossary.join(latest_releases(glossary), [*RELEASE], "left_semi")


def resolve_release(releases: DataFrame, platform: str, version: int | str | None) -> tuple[str, int]:
    """The release asked for; ``latest`` or nothing means the newest. A catalogue has one row per release."""
    known = sorted((r["platform"], r["version"]) for r in releases.select(*RELEASE).distinct().collect())
    own = [v for p, v in known if p == platform]
    if version in (None, "", "latest") and own:
        return platform, max(own)
    if str(version) in map(str, own):
        return platform, int(version)
    raise ValueError(f"no release {platform} {version}; known: {known}")


def bundle_list(glossary: DataFrame) -> DataFrame:
    """Distinct bundles of each release, in order."""
    return glossary.where("bundle_name is not null").select(*RELEASE, "bundle_name").distinct().orderBy(*RELEASE, "bundle_name")


def group_headers(glossary: DataFrame) -> DataFrame:
    """Key of each group's first row (by language, then id) and the group's size."""
    first = F.min_by("source", F.struct("language", "id"))
    return glossary.groupBy(*RELEASE, "group_id").agg(first.alias("header"), F.count("*").alias("items"))


def random_bundle(bundles: DataFrame, seed: int) -> DataFrame:
    """One bundle per release, drawn by a seeded hash so that it can be repeated; from a glossary or its catalogue of bundles."""
    names = bundles.where("bundle_name is not null").select(*RELEASE, "bundle_name").distinct()
    return names.groupBy(*RELEASE).agg(F.min_by("bundle_name", F.struct(F.md5(F.concat("bundle_name", F.lit(f":{seed}"))), "bundle_name")).alias("bundle_name"))


def browse_random_bundle(glossary: DataFrame, seed: int, bundles: DataFrame | None = None) -> DataFrame:
    """All rows of the groups that touch the drawn bundle, which comes from the catalogue ``bundles`` if there is one."""
    key = [*RELEASE, "group_id"]
    drawn = random_bundle(glossary if bundles is None else bundles, seed)
    matched = glossary.join(drawn, [*RELEASE, "bundle_name"], "left_semi").select(*key).distinct()
    return glossary.join(matched, key, "left_semi")
