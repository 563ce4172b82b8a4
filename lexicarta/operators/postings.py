"""Trigram postings: an equi-join form of the contains search.

They come as rows, one for each trigram of a text (``build``), or stored in blocks
(``store``): for each trigram of about a million characters of a release, the ids of its
texts.  The look-ups take both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_term, normalise, normalised
from ..schema import RELEASE
from ..sources.stage import bounded, sent
from . import positions

BLOCKS = "platform string, version int, gram string, n int, ids binary"
#: Rows of one batch of ids read from blocks.
MOST_ROWS = 1 << 16


def trigrams(text: Column) -> Column:
    """Distinct trigrams: what a look-ahead of three characters sees from every place, in one pass over the text.

    From inside a character beyond the basic plane it sees a spurious gram, in a text
    and in every term found in it alike, so look-ups are not affected.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def build(glossary: DataFrame) -> DataFrame:
    """``platform, version, gram, id`` of each row's normalised text: no shuffle."""
    return glossary.select(*RELEASE, F.explode(trigrams(F.col("target_norm"))).alias("gram"), "id")


def write(postings: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Store an index once for many look-ups, and read it back.

    Releases are partitions and files hold sorted ranges of grams, so a look-up reads a
    few row groups.  Ranges are drawn from the data: a common gram gets files of its own.
    """
    key = (*RELEASE, "gram", "id")
    dealt = postings.repartitionByRange(*([partitions] if partitions else []), *key).sortWithinPartitions(*key)
    dealt.write.mode("overwrite").partitionBy(*RELEASE).parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


def store(glossary: DataFrame, path: str, segment_chars: int = positions.SEGMENT_CHARS) -> DataFrame:
    """Index a glossary's normalised texts under ``path`` in blocks, once for many look-ups, and read the index back.

    Rows without an id or a text are not in it.  Every task writes one run for each release
    it has rows of, sorted by trigram, without a shuffle; a look-up reads a few pages of each.
    """
    rows = glossary.where("id is not null and target_norm is not null").select("platform", "version", "id", "target_norm")
    blocks = bounded(rows).mapInArrow(_indexer(segment_chars), BLOCKS).sortWithinPartitions(*RELEASE, "gram")
    writer = blocks.write.mode("overwrite").partitionBy(*RELEASE).option("compression", "zstd")
    writer.option("parquet.block.size", positions.ROW_GROUP_BYTES).option("parquet.page.size", positions.PAGE_BYTES).parquet(path)
    return glossary.sparkSession.read.schema(BLOCKS).parquet(path)


def _indexer(segment_chars: int):
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (platform, version), ids, texts in positions.segments(batches, segment_chars):
            grams, n, ends, data = _blocks(ids, texts)
            if k := len(grams):
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), k, [None, offsets, pa.py_buffer(data.tobytes())])
                yield pa.record_batch([pa.array([platform] * k, pa.string()), pa.array([version] * k, pa.int32()), pa.array(grams, pa.string()), pa.array(n.astype(np.int32)), packed], names)

    return index


def _blocks(ids: list[int], texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """A segment's trigrams, in how many of its texts each is, the ends of the ids' bytes, and those bytes."""
    parts, sizes, marks = [], [], np.full(2, positions.END, np.uint32)
    for text in texts:
        own = positions._code_points(text)
        parts += [own, marks]
        sizes.append(len(own) + 2)
    line = np.concatenate(parts).astype(np.int64)
    inside = line != positions.END
    at = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:])
    key, first, row = positions.sorted_threes(line, at, np.repeat(np.arange(len(texts)), sizes)[at])
    if not len(key):
        return [], first, first, np.zeros(0, np.uint8)
    new = np.diff(row, prepend=-1) != 0  # a text counts once for each trigram
    new[first] = True
    first = (np.cumsum(new) - 1)[first]
    own = np.array(ids, np.int64)[row[new]]
    step = np.diff(own, prepend=0)
    step[first] = own[first]
    data, ends = positions.pack(positions._zigzag(step))
    after = np.append(first[1:], len(own))
    mask = (1 << positions.BITS) - 1
    letters = np.stack([key >> (2 * positions.BITS), (key >> positions.BITS) & mask, key & mask], 1)
    line = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [line[i : i + 3] for i in range(0, len(line), 3)], after - first, ends[after - 1], data


def _by_id(postings: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``id``: one row for each id of a block; postings in rows stay as they are."""
    if "ids" not in postings.columns:
        return postings.select(*keep, "id")
    found = postings.select(*keep, "ids")
    return bounded(found).mapInArrow(_ids, found.drop("ids").withColumn("id", F.lit(0).cast("long")).schema)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width, rows, found, size = batch.num_columns - 1, [], [], 0

        def flush():
            at = pa.array(np.concatenate(rows))
            return pa.record_batch([*(batch.column(i).take(at) for i in range(width)), pa.array(np.concatenate(found))], [*batch.schema.names[:width], "id"])  # noqa: B023

        for k, data in enumerate(batch.column(width)):
            ids = np.cumsum(positions._unzigzag(positions.unpack(data.as_py())))
            rows.append(np.full(len(ids), k))
            found.append(ids)
            size += len(ids)
            if size >= MOST_ROWS:
                yield flush()
                rows, found, size = [], [], 0
        if size:
            yield flush()


def lookup(postings: DataFrame, glossary: DataFrame, term: str) -> DataFrame:
    """Rows whose text contains the term, found by its trigrams and checked again; short terms scan."""
    term = normalise(term)
    grams = sorted({term[i : i + 3] for i in range(len(term) - 2)})
    if not grams:
        return glossary.where(contains_term(term))
    found = _by_id(postings.where(F.col("gram").isin(grams)), *RELEASE, "gram").groupBy(*RELEASE, "id").agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(grams))
    return glossary.join(found, [*RELEASE, "id"], "left_semi").where(contains_term(term))


def batch_matches(postings: DataFrame, glossary: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, platform, version, id`` for requests ``(request_id, platform, version, q)`` of three characters or more.

    Each request looks its rarest trigram up (by document frequency in its release),
    then the text is checked: an equi-join, however many requests there are.
    ``batch_lookup`` answers shorter requests too.
    """
    return batch_lookup(postings, glossary, requests.where("length(q) >= 3"))


def _by_release(glossary: DataFrame, asked: DataFrame) -> DataFrame:
    """Terms without a trigram, by the release as the key, as in ``batch.search_all``."""
    near = asked.join(glossary.select(*RELEASE, "id", "target_norm"), [*RELEASE])
    return near.where(F.contains("target_norm", "q")).select("request_id", *RELEASE, "id").distinct()


def batch_lookup(postings: DataFrame, glossary: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for requests of any length but empty ones; terms without a trigram meet the rows of their release."""
    asked = sent(requests.where("length(q) > 0").select("request_id", *RELEASE, normalised("q").alias("q")), "asked")
    return _by_rarest(postings, glossary, asked.where("length(q) >= 3")).unionByName(_by_release(glossary, asked.where("length(q) < 3")))


def _of_term(term: str) -> Column:
    """Distinct trigrams of a term by code points, which both forms of postings hold."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - 2, F.lit(1))), lambda i: F.substring(F.col(term), i, F.lit(3))))


def _by_rarest(postings: DataFrame, glossary: DataFrame, asked: DataFrame) -> DataFrame:
    grams = sent(asked.select("request_id", *RELEASE, "q", F.explode(_of_term("q")).alias("gram")), "grams")
    size = F.sum("n") if "ids" in postings.columns else F.count("*")
    frequency = postings.join(grams.select(*RELEASE, "gram").distinct(), [*RELEASE, "gram"], "left_semi").groupBy(*RELEASE, "gram").agg(size.alias("df"))
    complete = grams.join(frequency, [*RELEASE, "gram"], "left")
    rarest = complete.groupBy("request_id", *RELEASE, "q").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best"))
    rarest = sent(rarest.select("request_id", *RELEASE, "q", F.col("best.gram").alias("gram")), "rarest")
    near = _by_id(rarest.join(postings, [*RELEASE, "gram"]), "request_id", *RELEASE, "q")
    return near.join(glossary.select(*RELEASE, "id", "target_norm"), [*RELEASE, "id"]).where(F.contains("target_norm", "q")).select("request_id", *RELEASE, "id").distinct()
