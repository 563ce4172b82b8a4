"""Operator 13: runs of periodic words, by longest common extensions on suffix trees.

A run is a stretch of words with a smallest period q that no neighbouring word
extends.  Two suffix trees (Ukkonen), of a document and of its reversal, answer in
constant time how far two places agree to the right and to the left: the string
depth of two leaves' lowest common ancestor, which is a range minimum over the Euler
tour.  Every run with two periods or more holds, under one of the two opposite orders
of the words, a longest Lyndon word of length q that starts at some place; so for each
place the Lyndon words of both orders are the only candidates, and each is extended
both ways.

A run of ``least`` words or more repeats each ``ceil(least/2)``-gram of its first period
at the distance q, and those grams cover it.  So stretches whose grams do not occur
twice in the document hold no run: each becomes one separator in the trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .scratch import bounded


def suffix_tree(s: list[int]) -> tuple[list, list, list, list]:
    """Ukkonen's tree of ``s``, whose last symbol is unique: edge starts and ends, children, suffix of each leaf."""
    n = len(s)
    start, stop, link, kids, suffix = [0], [0], [0], [{}], [-1]
    node = edge = length = rest = 0
    for i, c in enumerate(s):
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            own, first = kids[node], s[edge]
            child = own.get(first)
            if child is None:
                own[first] = len(start)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[child]
                span = stop[child] - at
                if length >= span:  # walk down
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[at + length] == c:
                    if last and node:
                        link[last] = node
                    length += 1
                    break
                middle = len(start)
                start.append(at)
                stop.append(at + length)
                link.append(0)
                suffix.append(-1)
                start[child] = at + length
                kids.append({s[at + length]: child, c: middle + 1})
                own[first] = middle
                if last:
                    link[last] = middle
                last = middle
            start.append(i)
            stop.append(n)
            link.append(0)
            kids.append(None)
            suffix.append(i - rest + 1)
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return start, stop, kids, suffix


def euler_tour(s: list[int], ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """String depths along the Euler tour of the tree of ``s``, and where each suffix's leaf stands in it.

    With ``ordered``, leaves come in the order of their suffixes.
    """
    start, stop, kids, suffix = suffix_tree(s)
    n = len(s)
    depth, tour, place, stack = [0] * len(start), [], [0] * n, [0]
    while stack:
        v = stack.pop()
        if v < 0:
            tour.append(depth[~v])
            continue
        own = kids[v]
        if own is None:
            place[suffix[v]] = len(tour)
            tour.append(n - suffix[v])
            continue
        d = depth[v]
        tour.append(d)
        for c in [own[x] for x in sorted(own, reverse=True)] if ordered else own.values():
            stack.append(~v)
            stack.append(c)
            depth[c] = d + stop[c] - start[c]
    return np.array(tour, np.int32), np.array(place, np.int64)


class RangeMin:
    """Minimum of any range in constant time: a sparse table over blocks, prefixes and suffixes within them."""

    BLOCK = 32

    def __init__(self, x: np.ndarray):
        self.x = x
        blocks = -(-len(x) // self.BLOCK)
        padded = np.full(blocks * self.BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(x)] = x
        table = padded.reshape(blocks, self.BLOCK)
        self.prefix = np.minimum.accumulate(table, 1).ravel()
        self.suffix = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [table.min(1)]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= blocks:
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum over ``a..b`` inclusive, for ``a <= b``."""
        low, high = a // self.BLOCK, b // self.BLOCK
        out = np.minimum(self.suffix[a], self.prefix[b])
        gap = high - low - 1
        for k, level in enumerate(self.levels):
            at = np.flatnonzero((gap >= 1 << k) & (gap < 2 << k))
            if len(at):
                out[at] = np.minimum(out[at], np.minimum(level[low[at] + 1], level[high[at] - (1 << k)]))
        at = np.flatnonzero(gap < 0)  # both in one block
        if len(at):
            first, last = a[at], b[at]
            best = self.x[first]
            for k in range(1, int((last - first).max()) + 1):
                best = np.minimum(best, self.x[np.minimum(first + k, last)])
            out[at] = best
        return out


def extensions(s: list[int], ordered: bool = False):
    """``lce(a, b)``: how many symbols agree from places a and b on, and the ranks of the suffixes."""
    tour, place = euler_tour(s, ordered)
    least = RangeMin(tour)

    def lce(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = place[a], place[b]
        return least.query(np.minimum(p, q), np.maximum(p, q))

    rank = np.empty(len(s), np.int64)
    rank[np.argsort(place)] = np.arange(len(s))
    return lce, rank


def next_smaller(x: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value (the length if none)."""
    n = len(x)
    out, stack = [n] * n, []
    for i, v in enumerate(x):
        while stack and x[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(s: list[int]) -> np.ndarray:
    """``start, length, period`` of every run of ``s`` (two periods or more); its last symbol is unique."""
    n = len(s)
    right, rank = extensions(s, ordered=True)
    left, _ = extensions([*s[-2::-1], s[-1]])
    place = np.arange(n)
    # the suffixes' order is that of the symbols, and under the opposite order exactly its reverse
    found = [np.stack([place, next_smaller(order.tolist()) - place], 1) for order in (rank, n - 1 - rank)]
    i, q = np.concatenate(found).T
    inside = i + q < n
    i, q = i[inside], q[inside]
    after = right(i, i + q)
    before = np.zeros(len(i), np.int64)
    inner = i > 0
    before[inner] = left(n - 1 - i[inner], n - 1 - i[inner] - q[inner])
    runs = np.stack([i - before, before + q + after, q], 1)
    runs = runs[runs[:, 1] >= 2 * runs[:, 2]]
    return np.unique(runs, axis=0) if len(runs) else runs


def document_runs(words: list[bytes], suspect: np.ndarray, least: int) -> np.ndarray:
    """Runs of at least ``least`` words; ``suspect`` marks the words that one may hold."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], suspect.view(np.int8), [0]])))
    names: dict[bytes, int] = {}
    s, source, ends = [], [], -1
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= least:
            s += [names.setdefault(w, len(names)) for w in words[a:b]]
            s.append(ends)  # unique
            source.append(np.arange(a, b + 1))
            ends -= 1
    if not s:
        return np.zeros((0, 3), np.int64)
    runs = runs_of(s)
    runs = runs[runs[:, 1] >= least]
    runs[:, 0] = np.concatenate(source)[runs[:, 0]]
    return runs


def suspects(w: S.Words, gram: int) -> np.ndarray:
    """Mask of the words covered by a gram that occurs twice in their document; hashes may add words, never lose any."""
    n = len(w.hash)
    out = np.zeros(n, bool)
    count = np.maximum(np.diff(w.bounds) - gram + 1, 0)
    if not count.sum():
        return out
    row = np.repeat(np.arange(len(count)), count)
    at = np.repeat(w.bounds[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    key = S.mix(S.Rolling(w.hash).all(gram)[at] + S.mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(n + gram + 1, np.int32)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + gram, -1)
    return np.cumsum(step)[:n] > 0


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """All runs of ``least`` words and two periods or more of every whole text, and the text with each run cut to one period.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Words are
    ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  Returns one row per input row: ``doc_id,
    n_words, runs, kept_text``, the runs as ``start, length, period`` in this order, and the
    words that no run contains after its first period, joined by one blank.  A null text is
    an empty one and has no run; null ids and repeated rows are returned as they are; an
    empty table gives an empty result.  Memory in a task follows the longest single text:
    of its stretches that may hold a run some 500 bytes a word while a tree is built.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    gram = -(-least // 2)
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches):
        for batch in batches:
            for low, high, data, offsets in S.chunks(batch.column(1)):
                w = S.words(data, offsets)
                marked = suspects(w, gram)
                raw, size, found, kept = data.tobytes(), [], [], []
                for k in range(high - low):
                    own = raw[offsets[k] : offsets[k + 1]].split()
                    part = marked[w.bounds[k] : w.bounds[k + 1]]
                    runs = document_runs(own, part, least) if part.any() else None
                    if runs is not None and len(runs):
                        gone = S.cover_ranges(runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1], len(own))
                        kept.append(b" ".join([x for x, g in zip(own, gone.tolist(), strict=True) if not g]))
                        found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                    else:
                        kept.append(b" ".join(own))
                        found.append([])
                    size.append(len(own))
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(size, pa.int64()), pa.array(found, pa.list_(item)), pa.array([x.decode() for x in kept], pa.string())], ["doc_id", "n_words", "runs", "kept_text"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")


def longest(runs: Column) -> Column:
    """The run of greatest length; of ties the first to start, then the shortest period. Null without runs."""
    order = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(order.isNotNull(), F.struct(order["start"].alias("start"), (-order["shortness"]).alias("length"), order["period"].alias("period")))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where crc32 of the decimal id is a multiple of ten, the words from a place on repeat the first ones of that place.

    With g the crc32 by ten and n words, word i >= a becomes word ``a + (i - a) % p``, where
    ``a = g % n`` and ``p = 1 + (n - a) / (3 + g % 8)`` in whole numbers.  Texts without words and
    rows with a null id stay as they are.
    """
    words = F.array_remove(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    split = split.withColumn("n", F.size("w").cast("long"))
    a = F.col("g") % F.greatest("n", F.lit(1))
    rest = F.col("n") - a
    p = F.lit(1) + F.floor(rest / (F.lit(3) + F.col("g") % 8))
    again = F.flatten(F.array_repeat(F.slice("w", (a + 1).cast("int"), p.cast("int")), F.ceil(rest / p).cast("int")))
    tail = F.slice(again, F.lit(1), rest.cast("int"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), a.cast("int")), tail), " ")
    return split.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))
