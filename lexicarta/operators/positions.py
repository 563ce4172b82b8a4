"""Positional postings: terms found, and proven, from an index alone.

The index cuts a release's rows into *segments* of about a million characters, laid end
to end with two end marks after each text.  For every three characters that stand at
some place of a segment it holds one block: the places, ascending, as differences of
variable length.  A term's places are those where its threes stand at their offsets, so
a match needs no text: the blocks of a few threes are intersected, segment by segment.
A segment's directory, where each row begins and its id, turns places into rows.

Each task stores its blocks where it cut them, as one run a release sorted by the three
characters: nothing is shuffled or staged.  A look-up reads a few pages of every run;
terms of one or two characters read the range of threes that begin so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise, normalised
from ..schema import RELEASE
from ..sources.stage import bounded, sent

#: Characters of a segment; one longer text is a segment of its own.
SEGMENT_CHARS = 1 << 20
#: Bits of a code point, the mark after a text, and the directory's name among the threes.
BITS, END, DIRECTORY = 21, 0x110000, -1
SCHEMA = "platform string, version int, gram long, segment long, n int, places binary, ids binary"
#: Small row groups and pages, so that a look-up skips most of a file.
ROW_GROUP_BYTES, PAGE_BYTES = 4 << 20, 64 << 10
#: Texts that a task may hold open over all releases, in segments.
MOST_OPEN = 16


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values, seven bits each, lowest first, the last without the high bit; and where each value ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - size
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        low = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[some] + k] = low.astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> 1) ^ -(x & 1)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _key(a, b, c):
    return (a << (2 * BITS)) | (b << BITS) | c


def sorted_threes(line: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different threes at the places ``at``, where each begins among the numbers, and the numbers of all places, sorted by both.

    Characters are numbered in their order, so that a three and its number mostly fit one
    integer, which sorts several times faster; a text of very many different ones takes
    the plain way.
    """
    seen = np.zeros(END + 1, bool)
    seen[line] = True
    letters = np.flatnonzero(seen)
    b, low = len(letters).bit_length(), int(number.max(initial=0)).bit_length()
    if 3 * b + low > 62:
        key = _key(line[at], line[at + 1], line[at + 2])
        order = np.lexsort((number, key))
        key, number = key[order], number[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first], first, number
    code = np.zeros(END + 1, np.int64)
    code[letters] = np.arange(len(letters))
    own = code[line]
    both = (((own[at] << (2 * b)) | (own[at + 1] << b) | own[at + 2]) << low) | number
    both.sort()
    key = both >> low
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, mask = key[first], (1 << b) - 1
    return _key(letters[key >> (2 * b)], letters[(key >> b) & mask], letters[key & mask]), first, both & ((1 << low) - 1)


def _blocks(ids: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, bytes]:
    """A segment's threes, their counts, ends of their bytes, those bytes; and the directory's two columns."""
    parts, sizes, marks = [], [], np.full(2, END, np.uint32)
    for text in texts:
        own = _code_points(text)
        parts += [own, marks]
        sizes.append(len(own) + 2)
    line = np.concatenate(parts).astype(np.int64)
    keep = np.flatnonzero(line[:-2] != END)
    key, first, place = sorted_threes(line, keep, keep)
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    data, ends = pack(step)
    n = np.diff(np.append(first, len(place)))
    block_ends = ends[np.append(first[1:], len(place)) - 1] if len(place) else np.zeros(0, np.int64)
    lengths, _ = pack(np.array(sizes, np.int64))
    names, _ = pack(_zigzag(np.diff(np.array(ids, np.int64), prepend=0)))
    return key, n, block_ends, data, lengths, names


def _indexer(segment_chars: int):
    """Function from batches ``platform, version, id, target_norm`` to blocks; nothing is grouped across tasks."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def emit(release, ids, texts, segment):
        key, n, ends, data, lengths, directory = _blocks(ids, texts)
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
        places = pa.Array.from_buffers(pa.binary(), len(key), [None, offsets, pa.py_buffer(data.tobytes())])
        constant = lambda k: [pa.array([release[0]] * k, pa.string()), pa.array([release[1]] * k, pa.int32())]
        one = [pa.array([DIRECTORY], pa.int64()), pa.array([segment], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([lengths.tobytes()], pa.binary()), pa.array([directory.tobytes()], pa.binary())]
        yield pa.record_batch([*constant(1), *one], names)
        if len(key):
            yield pa.record_batch([*constant(len(key)), pa.array(key, pa.int64()), pa.array(np.full(len(key), segment), pa.int64()), pa.array(n.astype(np.int32)), places, pa.nulls(len(key), pa.binary())], names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 24
        for release, ids, texts in segments(batches, segment_chars):
            yield from emit(release, ids, texts, count)
            count += 1

    return index


def segments(batches: Iterator[pa.RecordBatch], segment_chars: int) -> Iterator[tuple[tuple, list[int], list[str]]]:
    """``(platform, version), ids, texts`` of about ``segment_chars`` characters from batches ``platform, version, id, target_norm``."""
    open_: dict[tuple, tuple[list, list, list]] = {}
    held = 0
    for batch in batches:
        for platform, version, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            release = (platform, version)
            ids, texts, size = open_.setdefault(release, ([], [], [0]))
            ids.append(id_)
            texts.append(text)
            size[0] += len(text)
            held += len(text)
            if held >= MOST_OPEN * segment_chars:  # many releases lie side by side
                release = max(open_, key=lambda r: open_[r][2][0])
            elif size[0] < segment_chars:
                continue
            ids, texts, size = open_.pop(release)
            held -= size[0]
            yield release, ids, texts
    for release, (ids, texts, _) in open_.items():
        yield release, ids, texts


def write(glossary: DataFrame, path: str, partitions: int | None = None, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Index the normalised texts of a glossary under ``path``, once for many look-ups, and read the index back.

    Rows without an id or a text are not in it.  Every task writes one sorted run for each
    release it has rows of; ``partitions`` deals the texts into that many tasks first.
    """
    rows = glossary.where("id is not null and target_norm is not null").select("platform", "version", "id", "target_norm")
    if partitions:
        rows = rows.repartition(partitions)
    blocks = bounded(rows).mapInArrow(_indexer(segment_chars), SCHEMA).sortWithinPartitions(*RELEASE, "gram", "segment")
    writer = blocks.write.mode("overwrite").partitionBy(*RELEASE).option("compression", "zstd")
    writer.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).parquet(path)
    return read(glossary.sparkSession, path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _offsets(length: int) -> list[int]:
    """Offsets of the threes that together cover a term."""
    return sorted({*range(0, length - 2, 3), max(0, length - 3)})


def _wanted(term: str) -> list[tuple[int, int, int]]:
    """``(offset, lowest, highest)`` three of each part of a normalised term."""
    c = [int(x) for x in _code_points(term)]
    if len(c) >= 3:
        return [(o, k := _key(*c[o : o + 3]), k) for o in _offsets(len(c))]
    low = _key(*[*c, 0, 0][:3])
    return [(0, low, low + (1 << (BITS * (3 - len(c)))) - 1)]


def lookup_ids(index: DataFrame, term: str) -> DataFrame:
    """``platform, version, id, hits``: rows that contain the term and how often, from the index alone.

    To search one release, filter the index by it: the other releases' files are not read.
    Overlapping places count.  The term is normalised here; an empty one raises.  A row
    that repeats an id is returned for each of its texts that contain the term.
    """
    term = normalise(term)
    if not term:
        raise ValueError("an empty term stands everywhere")
    wanted = _wanted(term)
    low, high = wanted[0][1:]
    gram = F.col("gram")
    # constants, in one filter: they reach the scan, which is read once for the blocks and the directory
    if low == high:
        offsets = {k: [o for o, x, _ in wanted if x == k] for _, k, _ in wanted}
        blocks = index.where(gram.isin(DIRECTORY, *offsets))
        of_gram = F.coalesce(*(F.when(gram == k, F.array(*map(F.lit, o))) for k, o in offsets.items()), F.array(F.lit(-1)))
        blocks = blocks.withColumn("offset", F.explode(of_gram))
    else:
        blocks = index.where((gram == DIRECTORY) | gram.between(low, high)).withColumn("offset", F.lit(0))
    blocks = blocks.withColumns({"term": F.when(gram != DIRECTORY, F.lit(0).cast("long")), "parts": F.lit(len(wanted))})
    return _segments(blocks).drop("term")


def lookup(index: DataFrame, glossary: DataFrame, term: str) -> DataFrame:
    """The glossary's rows found by ``lookup_ids``."""
    return glossary.join(lookup_ids(index, term), [*RELEASE, "id"], "left_semi").select(*glossary.columns)


def batch_lookup(index: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, platform, version, id, hits`` for requests ``(request_id, platform, version, q)``; empty terms find nothing.

    Each different term of a release looks its threes up by an equi-join, shorter terms
    theirs by what a three begins with.
    """
    asked = sent(requests.select("request_id", *RELEASE, normalised("q").alias("q")).where("length(q) > 0"), "asked")
    terms = sent(asked.select(*RELEASE, "q").distinct().withColumn("term", F.xxhash64("q")), "terms")
    n = F.length("q")
    code = lambda o: F.ascii(F.substring("q", o + F.lit(1), F.lit(1))).cast("long")
    all_ = F.when(n >= 3, F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)), F.lit(3)), F.array(n - 3)))).otherwise(F.array(F.lit(0)))
    o = F.col("offset")
    begins = F.when(n == 1, code(o)).when(n == 2, F.shiftleft(code(o), BITS).bitwiseOR(code(o + 1))).otherwise(_shifted(code(o), code(o + 1), code(o + 2)))
    wanted = terms.withColumn("all", all_).withColumn("parts", F.size("all")).withColumn("offset", F.explode("all"))
    wanted = sent(wanted.select(*RELEASE, "term", "parts", "offset", F.least(n, F.lit(3)).alias("size"), begins.alias("begins")), "threes")
    # one pass over the blocks, each by its whole three and by what it begins with if terms so short occur
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())
    blocks = index.where(F.col("gram") != DIRECTORY)
    ways = F.array(*(F.struct(F.lit(k).alias("size"), F.shiftright("gram", BITS * (3 - k)).alias("begins")) for k in sizes or [3]))
    found = blocks.withColumn("way", F.explode(ways)).select(*blocks.columns, "way.*").join(wanted, [*RELEASE, "size", "begins"])
    hits = _rows(found, index).join(terms, [*RELEASE, "term"])
    return asked.join(hits, [*RELEASE, "q"]).select("request_id", *RELEASE, "id", "hits")


def _shifted(a: Column, b: Column, c: Column) -> Column:
    return F.shiftleft(a, 2 * BITS).bitwiseOR(F.shiftleft(b, BITS)).bitwiseOR(c)


def _rows(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``platform, version, term, id, hits`` from blocks with their ``term, parts, offset``."""
    directory = index.where(F.col("gram") == DIRECTORY).withColumns({"term": F.lit(None).cast("long"), "parts": F.lit(0), "offset": F.lit(-1)})
    columns = [*RELEASE, "segment", "term", "parts", "offset", "places", "ids"]
    return _segments(directory.select(*columns).unionByName(asked.select(*columns)))


def _segments(blocks: DataFrame) -> DataFrame:
    """Intersect each term's blocks of each segment; one shuffle, by segment.

    Within a segment the directory (no term) comes first, then the blocks term by term, and
    they are read as a stream; one term's blocks of one segment are held at a time.
    """
    key = [*RELEASE, "segment"]
    both = blocks.select(*key, "term", "parts", "offset", "places", "ids").repartition(*key)
    both = both.sortWithinPartitions(*key, F.col("term").asc_nulls_first(), "offset")
    return bounded(both).mapInArrow(_intersect, "platform string, version int, term long, id long, hits int")


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment = term = None
    starts = ids = np.zeros(0, np.int64)
    parts, held = 0, {}

    def close() -> Iterator[pa.RecordBatch]:
        if term is None or len(held) < parts:  # a part of the term stands nowhere here
            return
        lists = sorted(((o, np.sort(np.concatenate(p)) if len(p) > 1 else p[0]) for o, p in held.items()), key=lambda x: len(x[1]))
        at = lists[0][1] - lists[0][0]
        for offset, places in lists[1:]:
            k = np.searchsorted(places, at + offset)
            k[k == len(places)] = 0
            at = at[places[k] == at + offset]
        if len(at):
            row, hits = np.unique(np.searchsorted(starts, at, "right") - 1, return_counts=True)
            n = len(row)
            yield pa.record_batch([pa.array([segment[0]] * n, pa.string()), pa.array([segment[1]] * n, pa.int32()), pa.array([term] * n, pa.int64()), pa.array(ids[row]), pa.array(hits.astype(np.int32))], ["platform", "version", "term", "id", "hits"])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for platform, version, number, name, size, offset, places, names in zip(*columns, strict=True):
            if (platform, version, number) != segment or name != term:
                yield from close()
                segment, term, parts, held = (platform, version, number), name, size, {}
            if name is None:
                starts = np.cumsum(np.concatenate([[0], unpack(places)]))[:-1]
                ids = np.cumsum(_unzigzag(unpack(names)))
            else:
                held.setdefault(offset, []).append(np.cumsum(unpack(places)))
    yield from close()
