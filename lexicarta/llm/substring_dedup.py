"""Operator 1: repeated word passages, by a log-structured fingerprint index.

The index is a log of immutable runs in the shared folder.  A run holds, bucketed and
sorted by anchor, the distinct window fingerprints of one batch of documents with the
smallest document of each.  A new batch is merge-joined with each run where it lies:
history is read in place, and only what shares an anchor with the batch leaves it.
Fingerprints seen in a smaller document decide at once, and those whose anchor is
known from other surroundings are verified window by window over the texts concerned.
Runs are compacted by size: a run is merged with the one before while that is not
much larger, so there are few runs and a fingerprint is rewritten a few times only.

One fingerprint stands for a whole *span* of windows (see ``spans``), about one
row for sixteen windows, and the decisions stay exact: an equal span means equal
windows throughout; windows can be equal across different spans only when the
anchors are equal, and exactly those are verified.  Equality is that of two 64-bit
hashes throughout, of the anchor's words and of the span's or window's, under a key that
each index draws anew (``spans.Key``).
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .scratch import Scratch, bounded

FINGERPRINTS = "doc_id long, anchor long, span long, n long"


class FingerprintIndex:
    """Incremental index of ``width``-word windows. Parameters are fixed for its life; ``close`` frees its tables.

    Two neighbouring runs are merged unless the older has more than ``ratio`` times the
    rows of the newer; with ``most_runs``, all are merged once there are more than that instead.
    """

    def __init__(self, spark: SparkSession, width: int = 50, gram: int = 20, most_runs: int | None = None, ratio: float = 4.0):
        if not 1 <= gram <= width:
            raise ValueError("gram must lie between 1 and width")
        self.spark, self.width, self.gram, self.most_runs, self.ratio = spark, width, gram, most_runs, ratio
        self.key = S.Key.draw()
        self.scratch = Scratch(spark, "fingerprints")
        self.runs: list[tuple[str, int]] = []
        self.highest: int | None = None
        self._count = 0
        self._name = f"fingerprints_{uuid.uuid4().hex}"

    def fingerprints(self, docs: DataFrame) -> DataFrame:
        """Distinct ``(doc_id, anchor, span)`` of each document. Null ids or texts give none."""
        width, gram, key = self.width, self.gram, self.key

        def extract(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for low, _, data, offsets in S.chunks(batch.column(1)):
                    w = S.words(data, offsets, key=key)
                    s = S.spans(S.Windows(w.hash, key), w.bounds, width, gram)
                    yield _distinct(ids[low + s.row], s.anchor, s.hash)

        return bounded(docs).select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(extract, FINGERPRINTS)

    def _store(self, run: DataFrame) -> tuple[str, int]:
        """Write ``anchor, span, first`` as a run: buckets of anchors, each sorted, one file a bucket."""
        self._count += 1
        name = f"{self._name}_{self._count}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = run.select("anchor", "span", "first").repartition(buckets, "anchor")
        dealt.write.bucketBy(buckets, "anchor").sortBy("anchor", "span").option("path", f"{self.scratch.root}/{name}").option("compression", "zstd").saveAsTable(name)
        return name, self.spark.table(name).count()

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def append(self, rows: DataFrame, more: bool = True) -> tuple[DataFrame, DataFrame]:
        """Add a batch of fingerprints as a run; all its ids must exceed those of earlier batches.

        Returns ``seen (doc_id, span)``, spans of the batch that stand in a smaller
        document, and ``open (doc_id, span)``, the spans of any batch so far whose
        windows must be verified because of this batch.  Raises where the ids do not ascend.
        After the last batch (``more`` false) nothing is compacted.
        """
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and self.highest is not None and low <= self.highest:
            raise ValueError(f"document {low} comes after {self.highest}: batches must have ascending ids")
        self.highest = self.highest if high is None else high
        run = self._store(rows.groupBy("anchor", "span").agg(F.min("doc_id").alias("first")))
        fresh = self.spark.table(run[0])
        merged = fresh.withColumn("fresh", F.lit(True))
        if self.runs:
            anchors = fresh.select("anchor").distinct()
            for old, _ in self.runs:  # what history knows of the batch's anchors
                merged = merged.unionByName(self.spark.table(old).join(anchors, "anchor", "left_semi").withColumn("fresh", F.lit(False)))
            merged = merged.groupBy("anchor", "span").agg(F.min("first").alias("first"), F.max("fresh").alias("fresh"))
            merged = self.scratch.write(merged, f"met-{self._count}")
        seen = rows.join(merged.where("fresh"), ["anchor", "span"]).where("doc_id > first").select("doc_id", "span")
        mixed = merged.groupBy("anchor").agg(F.count("*").alias("k"), F.min("first").alias("low"), F.max("first").alias("high"))
        mixed = mixed.where("k > 1 and low < high").select("anchor")
        unsure = merged.join(mixed, "anchor", "left_semi").select(F.col("first").alias("doc_id"), "span")
        seen, unsure = self.scratch.write(seen, f"seen-{self._count}"), self.scratch.write(unsure, f"open-{self._count}")
        self.scratch.drop(f"met-{self._count}")
        self.runs.append(run)
        if more:
            self._compact()
        return seen, unsure

    def _compact(self) -> None:
        """Merge the newest runs while the older of two is not much larger; buckets meet where they lie."""
        if self.most_runs is not None:
            if len(self.runs) > self.most_runs:
                self._merge(len(self.runs))
            return
        while len(self.runs) > 1 and self.runs[-2][1] <= self.ratio * self.runs[-1][1]:
            self._merge(2)

    def _merge(self, n: int) -> None:
        old = [name for name, _ in self.runs[-n:]]
        both = reduce(DataFrame.unionByName, map(self.spark.table, old)).groupBy("anchor", "span").agg(F.min("first").alias("first"))
        self.runs[-n:] = [self._store(both)]
        for name in old:
            self._drop(name)

    def close(self) -> None:
        for name, _ in self.runs:
            self._drop(name)
        self.runs = []

    def verify(self, corpus: DataFrame, unsure: DataFrame) -> DataFrame:
        """``(doc_id, window)``: windows inside open spans that also start in a smaller document."""
        width, gram, key = self.width, self.gram, self.key

        def emit(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                marks = batch.column(2)
                for low, high, data, offsets in S.chunks(batch.column(1)):
                    w = S.words(data, offsets, key=key)
                    s = S.spans(S.Windows(w.hash, key), w.bounds, width, gram)
                    hashes = S.Windows(w.hash, key).all(width)
                    edges = np.searchsorted(s.row, np.arange(high - low + 1))
                    for k in range(high - low):
                        part = slice(edges[k], edges[k + 1])
                        hit = np.isin(s.hash[part], _longs(marks, low + k))
                        if hit.any():
                            at = covered(s.first[part][hit], s.last[part][hit])
                            anchor = np.repeat(s.anchor[part][hit], s.last[part][hit] - s.first[part][hit] + 1)
                            got, one = np.unique(hashes[at], return_index=True)
                            yield pa.record_batch([pa.array(np.full(len(got), ids[low + k])), pa.array(anchor[one].view(np.int64)), pa.array(got.view(np.int64))], ["doc_id", "anchor", "window"])

        wanted = unsure.groupBy("doc_id").agg(F.collect_set("span").alias("marks"))
        windows = corpus.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "marks").mapInArrow(emit, "doc_id long, anchor long, window long")
        windows = self.scratch.write(windows.distinct(), "windows")
        first = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("end")).where("first < end").select("anchor", "window", "first")
        return windows.join(first, ["anchor", "window"]).where("doc_id > first").select("doc_id", "window")

    def apply(self, docs: DataFrame, seen: DataFrame, windows: DataFrame) -> DataFrame:
        """Remove the covered words: ``doc_id, n_words, n_removed, kept_text, kept_sha256``."""
        width, gram, key = self.width, self.gram, self.key

        def strip(batches):
            for batch in batches:
                spans_of, windows_of = batch.column(2), batch.column(3)
                for low, high, data, offsets in S.chunks(batch.column(1)):
                    raw, out = data.tobytes(), []
                    busy = [k for k in range(high - low) if spans_of[low + k].is_valid or windows_of[low + k].is_valid]
                    gone: dict[int, np.ndarray] = {}
                    if busy:
                        w = S.words(data, offsets, key=key)
                        s = S.spans(S.Windows(w.hash, key), w.bounds, width, gram)
                        hashes = S.Windows(w.hash, key).all(width)
                        edges = np.searchsorted(s.row, np.arange(high - low + 1))
                        for k in busy:
                            part, a, b = slice(edges[k], edges[k + 1]), w.bounds[k], w.bounds[k + 1]
                            hit = np.isin(s.hash[part], _longs(spans_of, low + k))
                            starts = covered(s.first[part][hit], s.last[part][hit]) - a
                            if windows_of[low + k].is_valid:
                                more = np.flatnonzero(np.isin(hashes[a : max(a, b - width + 1)], _longs(windows_of, low + k)))
                                starts = np.concatenate([starts, more])
                            gone[k] = cover(starts, width, b - a)
                    for k in range(high - low):
                        own = raw[offsets[k] : offsets[k + 1]].split()
                        kept = own if k not in gone else list(itertools.compress(own, ~gone[k]))
                        joined = b" ".join(kept)
                        out.append((len(own), len(own) - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest()))
                    n_words, n_removed, text, digest = zip(*out, strict=True)
                    ids = batch.column(0).slice(low, high - low)
                    yield pa.record_batch([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(text, pa.string()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

        marks = seen.withColumn("window", F.lit(None).cast("long")).unionByName(windows.withColumn("span", F.lit(None).cast("long")))
        marks = marks.groupBy("doc_id").agg(F.collect_set("span").alias("spans"), F.collect_set("window").alias("windows"))
        some = lambda c: F.when(F.size(c) > 0, F.col(c))
        rows = docs.select("doc_id", "text").join(marks, "doc_id", "left").select("doc_id", "text", some("spans").alias("spans"), some("windows").alias("windows"))
        return rows.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def substring_dedup(docs: DataFrame, width: int = 50, gram: int = 20, batches: int = 2) -> DataFrame:
    """Remove from every document the words covered by a window of an earlier document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever
    their names.  Documents enter the index in ``batches`` ranges of ascending id.
    Returns one row per input row: ``doc_id, n_words, n_removed, kept_text,
    kept_sha256``.  A null text is an empty one (zero words); texts shorter than a
    window keep every word; rows that share a ``doc_id`` count as one document; a row
    with a null ``doc_id`` is returned whole and never removes anything; an empty
    table gives an empty result.  Memory in a task follows the longest single text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = FingerprintIndex(docs.sparkSession, width, gram)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [1.0], 1000).alias("q")).first().q or []
    part = sum((F.col("doc_id") > F.lit(c)).cast("int") for c in sorted(set(cuts))) if batches > 1 and cuts else F.lit(0)
    rows = index.scratch.write(index.fingerprints(docs).withColumn("batch", part), "rows", by="batch")
    seen = unsure = None
    n = len(set(cuts)) + 1 if batches > 1 else 1
    for k in range(n):
        a, b = index.append(rows.where(F.col("batch") == k).drop("batch"), more=k + 1 < n)
        seen, unsure = (a, b) if seen is None else (seen.unionByName(a), unsure.unionByName(b))
    index.close()  # this call's documents are all there is; a caller with more to come keeps its index open
    index.scratch.drop("rows")
    return index.apply(docs, seen, index.verify(docs, unsure))


def covered(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the inclusive ranges, one after the other."""
    n = last - first + 1
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the items that a window from any of the starts covers."""
    step = np.zeros(n + width + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step)[:n] > 0


def _longs(lists: pa.Array, k: int) -> np.ndarray:
    item = lists[k]
    return item.values.to_numpy(zero_copy_only=False).view(np.uint64) if item.is_valid else np.zeros(0, np.uint64)


def _distinct(ids: np.ndarray, anchor: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    """One row per (document, anchor, span) with its number of times."""
    order = np.lexsort((span, anchor, ids))
    ids, anchor, span = ids[order], anchor[order], span[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(ids)))
    return pa.record_batch([pa.array(ids[at].astype(np.int64)), pa.array(anchor[at].view(np.int64)), pa.array(span[at].view(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "anchor", "span", "n"])
