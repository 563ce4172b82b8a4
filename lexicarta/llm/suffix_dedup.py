"""Operator 6: repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

Byte spans (see ``spans``) reduce the corpus to the places where a decision is
open: a span seen twice is repeated throughout, and an anchor known from one
span only repeats nothing.  For the rest, the spans of an anchor meet in one
block of bounded size.  There a suffix array gives the transform, and
breadth-first backward extension of intervals fixes the common prefixes of
neighbouring suffixes by increasing value; it stops at the threshold, and the
neighbours still open share at least that many bytes.

The spans of an anchor with more of them than a block may hold are split by content.
The place of the anchor inside a window follows from the window alone, and all
windows whose anchor lies in one range of places share the bytes around it, the
more of them the narrower the range.  So ranges are halved: a span falls into its
windows of either half, which meet only spans with the same bytes around the anchor,
and the rules above decide again, halving on where a group is still too large.
At a single place the shared bytes are the whole window, so that no group is left.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .scratch import Scratch, bounded
from .substring_dedup import _distinct, _longs, cover, covered

#: Symbols packed into the first sort key (each below 2**9, zero ends a string).
PACK = 7


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the packed keys of ``symbols`` (0 ends each string, and sorts by place).

    Prefix doubling that sorts again only the suffixes still tied.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(PACK, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    ended = np.zeros(n, bool)
    for k in range(PACK):
        part = padded[k : k + n]
        key = (key << np.uint64(9)) | np.where(ended, np.uint64(0), part)
        ended |= part == 0
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n + 1, bool)
    new[1:n] = (ordered[1:] != ordered[:-1]) | ended[sa[1:]]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new[:n], place, 0))
    depth = PACK
    while True:
        tied = np.flatnonzero(~(new[:n] & new[1:]))
        if not len(tied):
            break
        own = sa[tied]
        pair = (rank[own] << 32) | rank[own + depth]
        order = np.argsort(pair, kind="stable")
        own, pair = own[order], pair[order]
        sa[tied] = own
        new[tied[1:]] = pair[1:] != pair[:-1]
        starts = np.ones(len(tied), bool)
        starts[1:] = pair[1:] != pair[:-1]
        rank[own] = tied[np.maximum.accumulate(np.where(starts, np.arange(len(tied)), 0))]
        depth *= 2
    return sa, rank, key


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Mask of the positions whose next ``length`` symbols also start elsewhere and hold no end mark.

    Values below ``PACK`` are read off the packed keys; from there each round
    extends the open intervals backward by every symbol.  A neighbour's value is
    set by the first interval that ends before it, and only such intervals go on.
    """
    n = len(symbols)
    sa, rank, key = suffix_array(symbols)
    bwt = symbols[sa - 1]
    previous = rank[sa - 1]  # the suffix one symbol longer
    # neighbours, in suffix order, among suffixes preceded by the same symbol
    by_symbol = np.argsort(bwt, kind="stable")
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    ordered = key[sa]
    differ = ordered[1:] ^ ordered[:-1]
    known = np.full(n + 1, -1, np.int32)  # common prefix of suffixes i-1 and i; -1: still open
    known[0] = known[n] = 0
    value = np.full(n - 1, PACK, np.int32)
    for k in range(PACK):
        value[(differ >> np.uint64(9 * (PACK - 1 - k))) != 0] = np.minimum(value[(differ >> np.uint64(9 * (PACK - 1 - k))) != 0], k)
    small = min(PACK, length)
    low = np.flatnonzero(value < small) + 1
    known[low] = value[low - 1]
    whole = (ordered & np.uint64(511)) != 0
    if length > PACK:
        starts = np.concatenate([[0], np.flatnonzero(differ != 0) + 1])
        ends = np.append(starts[1:], n) - 1
        open_ = whole[starts] & (np.append(value, -1)[ends] == PACK - 1)
        left, right = starts[open_], ends[open_]
        for depth in range(PACK, length):
            if not len(left):
                break
            at = covered(left, right)
            size = right - left + 1
            is_first = (before[at] < np.repeat(left, size)) & (bwt[at] != 0)
            is_last = (after[at] > np.repeat(right, size)) & (bwt[at] != 0)
            left, right = np.sort(previous[at[is_first]]), np.sort(previous[at[is_last]])
            fresh = known[right + 1] < 0
            left, right = left[fresh], right[fresh]
            known[right + 1] = depth
    # an open neighbour counts only where both suffixes are long enough
    ends_at = np.flatnonzero(symbols == 0)
    room = ends_at[np.searchsorted(ends_at, np.arange(n))] - np.arange(n) >= length
    long_enough = room[sa]
    joined = np.zeros(n + 1, bool)
    joined[1:n] = (known[1:n] < 0) & long_enough[1:] & long_enough[:-1]
    out = np.zeros(n, bool)
    out[sa] = joined[:-1] | joined[1:]
    return out


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = 200, block_bytes: int = 1 << 20, group_spans: int = 1024) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Texts are
    UTF-8 bytes, judged on the input; strings never cross documents; places in the
    same document count, overlapping or not.  Returns one row per input row:
    ``doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256``.  A null text
    is an empty one; shorter texts are kept whole; rows with a null ``doc_id`` are
    returned whole and repeat nothing; repeated rows repeat each other.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must lie between 1 and length")
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch, key = Scratch(docs.sparkSession, "suffixes"), S.Key.draw()

    def find(batch_texts):
        for low, high, data, offsets in S.chunks(batch_texts):
            yield low, high, data, offsets, S.spans(S.Windows.of_bytes(data, key, gram), offsets, length, gram)

    def extract(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, _, _, _, s in find(batch.column(1)):
                yield _distinct(ids[low + s.row], s.anchor, s.hash)

    rows = docs.where("doc_id is not null and text is not null").mapInArrow(extract, "doc_id long, anchor long, span long, n long")
    rows = scratch.write(rows, "rows")
    index = scratch.write(rows.groupBy("anchor", "span").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")), "index")
    whole = rows.join(index.where("n > 1").select("anchor", "span"), ["anchor", "span"], "left_semi").select("doc_id", "span")
    mixed = index.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1")
    unsure = index.join(mixed.select("anchor", (F.col("k") > group_spans).alias("wide")), "anchor")
    wanted = unsure.groupBy("doc_id").agg(F.collect_list(F.struct("span", "wide", (F.col("n") == 1).alias("single"))).alias("marks"))

    def emit(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for low, high, data, offsets, s in find(batch.column(1)):
                edges = np.searchsorted(s.row, np.arange(high - low + 1))
                got = [[], [], [], [], [], []]
                for k in range(high - low):
                    part = slice(edges[k], edges[k + 1])
                    item = marks[low + k].values
                    names, wide, single = (item.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    names = names.view(np.uint64)
                    order = np.argsort(names)
                    names = names[order]
                    mine, one = np.unique(s.hash[part], return_index=True)
                    where = np.searchsorted(names, mine)
                    where[where == len(names)] = 0
                    for i, j in zip(one[names[where] == mine], order[where[names[where] == mine]], strict=True):
                        i += edges[k]
                        values = (ids[low + k], s.anchor[i].view(np.int64), s.hash[i].view(np.int64), bool(wide[j]), bool(single[j]), data[s.first[i] : s.last[i] + length].tobytes())
                        for column, value in zip(got, values, strict=True):
                            column.append(value)
                if got[0]:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], ["doc_id", "anchor", "span", "wide", "single", "bytes"])

    pieces = docs.join(wanted, "doc_id").select("doc_id", "text", "marks").mapInArrow(emit, "doc_id long, anchor long, span long, wide boolean, single boolean, bytes binary")
    # one text for each span: repeated rows of one id emit it again
    pieces = scratch.write(pieces.dropDuplicates(["doc_id", "anchor", "span"]), "pieces")
    few = _by_blocks(pieces.where("not wide").withColumn("base", F.lit(0)), length, block_bytes)
    many = _by_halves(pieces.where("wide"), length, gram, block_bytes, group_spans, key, scratch)
    found = scratch.write(reduce(DataFrame.unionByName, many, few), "found")

    def strip(batches):
        for batch in batches:
            whole_of, part_of = batch.column(2), batch.column(3)
            for low, high, data, offsets in S.chunks(batch.column(1)):
                raw, out = data.tobytes(), []
                busy = [k for k in range(high - low) if whole_of[low + k].is_valid or part_of[low + k].is_valid]
                gone = {}
                if busy:
                    s = S.spans(S.Windows.of_bytes(data, key, gram), offsets, length, gram)
                    edges = np.searchsorted(s.row, np.arange(high - low + 1))
                    for k in busy:
                        part, a, b = slice(edges[k], edges[k + 1]), offsets[k], offsets[k + 1]
                        hit = np.isin(s.hash[part], _longs(whole_of, low + k))
                        starts = [covered(s.first[part][hit], s.last[part][hit]) - a]
                        if part_of[low + k].is_valid:
                            at = {int(h): i for h, i in zip(s.hash[part].view(np.int64), range(edges[k], edges[k + 1]), strict=True)}
                            for item in part_of[low + k].as_py():
                                if item["span"] in at:
                                    starts.append(s.first[at[item["span"]]] - a + np.array(item["at"], np.int64))
                        gone[k] = cover(np.concatenate(starts), length, b - a)
                for k in range(high - low):
                    own = raw[offsets[k] : offsets[k + 1]]
                    mask = gone.get(k)
                    runs = 0
                    if mask is not None:
                        runs = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and mask[0]))
                    kept = own if not runs else np.frombuffer(own, np.uint8)[~mask].tobytes()
                    out.append((len(own), len(own) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.record_batch([batch.column(0).slice(low, high - low), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    none = F.lit(None)
    marks = whole.withColumn("part", none.cast("struct<span:long,at:array<int>>")).unionByName(
        found.select("doc_id", F.struct("span", "at").alias("part")).withColumn("span", none.cast("long")))
    marks = marks.groupBy("doc_id").agg(F.collect_set("span").alias("whole"), F.collect_list("part").alias("part"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    joined = docs.join(marks, "doc_id", "left").select("doc_id", "text", some("whole").alias("whole"), some("part").alias("part"))
    return joined.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def _by_blocks(pieces: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """``(doc_id, span, at)``: repeated window starts inside single spans, all spans of an anchor in one block."""

    def solve(group):
        symbols = np.concatenate([np.append(np.frombuffer(p[3], np.uint8).astype(np.int16) + 1, 0) for p in group]).astype(np.int16)
        mask, at, out = repeated_starts(symbols, length), 0, []
        for doc, span, single, text, base in group:
            hits = np.flatnonzero(mask[at : at + len(text)])
            if single and len(hits):
                out.append((doc, span, (hits + base).astype(np.int32)))
            at += len(text) + 1
        return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["doc_id", "span", "at"])

    def blocks(batches):
        block, size, last = [], 0, None
        for batch in batches:
            for anchor, *piece in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if anchor != last and size >= block_bytes:
                    yield solve(block)
                    block, size = [], 0
                block.append(piece)
                size += len(piece[3]) + 1
                last = anchor
        if block:
            yield solve(block)

    dealt = pieces.select("anchor", "doc_id", "span", "single", "bytes", "base").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(blocks, "doc_id long, span long, at array<int>")


#: A span's windows whose anchor lies ``low`` to ``high`` bytes after their start, from window ``base`` on.
HALVES = "part long, sub long, doc_id long, anchor long, span long, single boolean, low int, high int, base int, windows int, bytes binary"


def _halved(pieces: DataFrame, length: int, gram: int, key: S.Key) -> DataFrame:
    """Each piece's windows of either half of its range, with the hashes of the bytes they share (``part``) and of all (``sub``)."""

    def halve(rows):
        texts = [np.frombuffer(r[-1], np.uint8) for r in rows]
        data, size = np.concatenate(texts), np.array([len(t) for t in texts])
        start = np.cumsum(size) - size
        anchor, low, high, base = (np.array([r[k] for r in rows]) for k in (1, 4, 5, 6))
        hashes = S.Windows.of_bytes(data, key, gram)
        grams = hashes.all(gram)
        at = np.flatnonzero(grams == np.repeat(anchor.astype(np.int64).view(np.uint64), size)[: len(grams)])
        place = at[np.searchsorted(at, start)]  # of the anchor: its first in the piece lies in every window of it
        middle = (low + high) // 2
        for a, b in ((low, middle), (middle + 1, high)):
            first, last = np.maximum(start, place - b), np.minimum(start + size - length, place - a)
            some = np.flatnonzero(first <= last)
            if not len(some):
                continue
            a, b, first, last, own = a[some], b[some], first[some], last[some], place[some]
            ends = last + length
            part = S.mix(hashes.some(own - a, own + length - b) ^ S.mix((a * length + b).astype(np.uint64)))
            columns = [part.view(np.int64), hashes.some(first, ends).view(np.int64)]
            columns += [[rows[i][k] for i in some] for k in range(4)]
            columns += [a, b, base[some] + first - start[some], last - first + 1, [data[i:j].tobytes() for i, j in zip(first, ends, strict=True)]]
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int32()] * 4 + [pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in HALVES.split(", ")])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                rows.append(row)
                size += len(row[-1])
                if size >= S.CHUNK_BYTES:
                    yield from halve(rows)
                    rows, size = [], 0
            if rows:
                yield from halve(rows)

    return pieces.select("doc_id", "anchor", "span", "single", "low", "high", "base", "bytes").mapInArrow(run, HALVES)


def _by_halves(pieces: DataFrame, length: int, gram: int, block_bytes: int, group_spans: int, key: S.Key, scratch: Scratch) -> list[DataFrame]:
    """The same for anchors of more than ``group_spans`` spans, in at most ``log2(length - gram)`` rounds, rounded up."""
    left = pieces.withColumns({"low": F.lit(0), "high": F.lit(length - gram), "base": F.lit(0)})
    found, turn, own = [], 0, ["part", "sub"]
    while not left.isEmpty():
        halves = scratch.write(_halved(left, length, gram, key), f"halves-{turn}")
        index = scratch.write(halves.groupBy(own).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "span")).alias("one")), f"halves-index-{turn}")
        # windows of pieces equal throughout are repeated; the others meet those of their group
        twice = halves.where("single").select(*own, "doc_id", "span", "base", "windows").join(index.where("n > 1").select(own), own, "left_semi")
        found.append(twice.select("doc_id", "span", F.sequence("base", F.col("base") + F.col("windows") - 1).alias("at")))
        groups = index.groupBy("part").agg(F.count("*").alias("k")).where("k > 1")
        met = index.join(groups, "part").select(*own, "one", (F.col("n") == 1).alias("alone"), (F.col("k") > group_spans).alias("wide"))
        met = halves.join(met, own).where(F.struct("doc_id", "span") == F.col("one"))
        met = met.select("doc_id", "anchor", "part", "span", (F.col("single") & F.col("alone")).alias("single"), "low", "high", "base", "bytes", "wide")
        met = scratch.write(met, f"halves-met-{turn}")
        found.append(_by_blocks(met.where("not wide").withColumn("anchor", F.col("part")), length, block_bytes))
        left, turn = met.where("wide"), turn + 1
    return found
