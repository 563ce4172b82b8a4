"""A glossary whose releases are published one by one, with a catalogue kept beside it.

Every publication writes its rows to a folder of its own and never touches another.
What counts is the manifest: a small numbered file with one line for each release, its
folder, files and rows.  It is written last, under the next number, so until then
readers see the releases as they were, and an interrupted publication leaves nothing
but a folder that no manifest names.  A release that is published again replaces its
line; its old rows stay for readers of earlier manifests until ``vacuum``.

With its rows a publication writes the counts of each release's bundles.  Counts of
releases and lists of bundles are read from these, not from the glossary.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GLOSSARY_SCHEMA, RELEASE, RESULT_COLUMNS
from .glossary import FILE_ORDER, by_ranges, with_normalised_target

STORED = GLOSSARY_SCHEMA.replace(", platform string, version int", "") + ", platform string, version int"
BUNDLES = "bundle_name string, row_count long, platform string, version int"


@dataclass(frozen=True)
class Release:
    """A manifest's line: ``run`` names the publication that holds the release."""

    platform: str
    version: int
    run: str
    files: int
    row_count: int


class Conflict(RuntimeError):
    """Another publication took the number first, time and again."""


class GlossaryStore:
    """Releases under ``root``, a folder of any file system that Spark reaches and that renames files at once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- the manifest: a few lines, read and written by the driver -----------------------------

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of all manifests, ascending."""
        path, fs = self._path("manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, at: int | None = None) -> list[Release]:
        """Releases of manifest ``at``, by default the newest; none before the first publication."""
        if at is None:
            at = max(self.numbers(), default=0)
            if not at:
                return []
        path, fs = self._path("manifest", f"{at:09d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Release(**json.loads(line)) for line in text.splitlines()]

    def _swap(self, change, tries: int = 20) -> int:
        """Write the next manifest, ``change`` of the newest one; its number."""
        for _ in range(tries):
            at = max(self.numbers(), default=0)
            lines = sorted(change(self.manifest(at) if at else []), key=lambda r: (r.platform, r.version))
            draft, fs = self._path("manifest", f"_{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            try:
                out.write(bytearray("".join(json.dumps(asdict(r)) + "\n" for r in lines).encode()))
            finally:
                out.close()
            final, _ = self._path("manifest", f"{at + 1:09d}.json")
            if not fs.exists(final) and fs.rename(draft, final):
                return at + 1
            fs.delete(draft, False)
        raise Conflict(f"no manifest could be written in {tries} tries")

    # --- writing ---------------------------------------------------------------------------------

    def publish(self, glossary: DataFrame, partitions: int | None = None) -> int:
        """Add the releases of ``glossary``, or replace those that are there; the number of the new manifest.

        ``glossary`` has the result columns, ``platform`` and ``version`` (others are left out);
        the normalised text is made here, once the rows are where they are written.  All its
        releases appear at once.  Rows without a platform or version are refused; a glossary
        without rows changes nothing.
        """
        run = uuid.uuid4().hex
        key = F.col("platform").isNull() | F.col("version").isNull()
        rows = glossary.select(*RESULT_COLUMNS, *RELEASE).withColumn("platform", F.when(key, F.raise_error(F.lit("a row has no release"))).otherwise(F.col("platform")))
        dealt = with_normalised_target(by_ranges(rows, partitions))
        dealt.sortWithinPartitions(*FILE_ORDER).write.partitionBy(*RELEASE).parquet(f"{self.root}/data/run={run}")
        written = self._read("data", [run], STORED)
        counts = written.groupBy("bundle_name", *RELEASE).agg(F.count("*").alias("row_count"))
        counts.select("bundle_name", "row_count", *RELEASE).coalesce(1).write.partitionBy(*RELEASE).parquet(f"{self.root}/bundles/run={run}")
        totals = self._read("bundles", [run], BUNDLES).groupBy(*RELEASE).agg(F.sum("row_count").alias("n")).collect()  # a row a release
        fresh = {(r["platform"], r["version"]): Release(r["platform"], r["version"], run, self._files(run, r["platform"], r["version"]), r["n"]) for r in totals}
        return self._swap(lambda old: [*(r for r in old if (r.platform, r.version) not in fresh), *fresh.values()])

    def retract(self, platform: str, version: int) -> int:
        """Take a release out; its rows stay until ``vacuum``."""
        return self._swap(lambda old: [r for r in old if (r.platform, r.version) != (platform, version)])

    def vacuum(self, keep: int = 1) -> None:
        """Delete all manifests but the newest ``keep``, and every publication that those do not name.

        Not to be run beside a publication, whose folder no manifest names yet.
        """
        if keep < 1:
            raise ValueError("at least one manifest stays")
        numbers = self.numbers()
        named = {r.run for n in numbers[-keep:] for r in self.manifest(n)}
        for n in numbers[:-keep]:
            path, fs = self._path("manifest", f"{n:09d}.json")
            fs.delete(path, False)
        for kind in ("data", "bundles"):
            top, fs = self._path(kind)
            for status in fs.listStatus(top) if fs.exists(top) else []:
                if status.getPath().getName().removeprefix("run=") not in named:
                    fs.delete(status.getPath(), True)

    # --- reading ---------------------------------------------------------------------------------

    def _files(self, run: str, platform: str, version: int) -> int:
        path, fs = self._path("data", f"run={run}", *self._folder(platform, version))
        return sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(path))

    def _folder(self, platform: str, version: int) -> list[str]:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return [f"platform={escape(platform)}", f"version={version}"]

    def _read(self, kind: str, runs: list[str], schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/run={run}" for run in runs]
        return self.spark.read.schema(schema + ", run string").option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def _current(self, kind: str, schema: str, at: int | None) -> DataFrame:
        lines = self.manifest(at)
        names = [c.split()[0] for c in schema.split(", ")]
        if not lines:
            return self.spark.createDataFrame([], schema)
        paths = ["/".join([self.root, kind, f"run={r.run}", *self._folder(r.platform, r.version)]) for r in lines]
        return self.spark.read.schema(schema + ", run string").option("basePath", f"{self.root}/{kind}").parquet(*paths).select(*names)

    def glossary(self, at: int | None = None) -> DataFrame:
        """All rows of the newest manifest (or of ``at``): a filter on the release prunes folders, one on the group row groups."""
        return self._current("data", STORED, at)

    def bundles(self, at: int | None = None) -> DataFrame:
        """``platform, version, bundle_name, row_count`` from the catalogue; a null name for rows without a bundle."""
        return self._current("bundles", BUNDLES, at).select(*RELEASE, "bundle_name", "row_count")

    def releases(self, at: int | None = None) -> DataFrame:
        """``platform, version, row_count, files`` from the manifest."""
        lines = [(r.platform, r.version, r.row_count, r.files) for r in self.manifest(at)]
        return self.spark.createDataFrame(lines, "platform string, version int, row_count long, files int")
