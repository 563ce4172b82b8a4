"""Operator 8: benchmark decontamination by template windows.

Numbers, units after a number, and names (words inside a sentence with a capital
and then a small letter) become typed placeholders, so a question keeps its
template when its parameters change.  Windows that hold a name also count with the
name as a word, for copies whose case or sentence bounds differ.  Hashes of
five-word template windows join documents with benchmark items; slot values must
then agree: within one copy of an item, one value of the item stands for one value
of the document.  A document may hold several copies with different values, so
where values disagree the windows are judged copy by copy: by how far document and
item place lie apart, in half-overlapping ranges of every width from one word up to
the whole document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .scratch import Scratch, bounded

UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hours minutes seconds days weeks months years mph kmh km/h percent usd eur dollars euros cents meters metres miles kilometers kilometres grams kilograms liters litres".split()
NUMBER, NAME, UNIT = (np.uint64(0xA5A5A5A500000000 + k) for k in (1, 2, 3))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = _DIGIT.copy()
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3A, 0x3F, 0x0A]] = True


def _fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes (ASCII and Latin-1 letters) and where an upper-case letter begins."""
    upper = (data >= 65) & (data <= 90)
    low = np.where(upper, data + 32, data).astype(np.uint8)
    if len(data) > 1:
        accented = np.zeros(len(data), bool)
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[accented] += 0x20
        upper[:-1] |= accented[1:]
    return low, upper


_UNIT_HASH = None


def _unit_hashes() -> np.ndarray:
    global _UNIT_HASH
    if _UNIT_HASH is None:
        raw = [u.encode() for u in UNITS]
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        _UNIT_HASH = np.unique(S._ranges(data, at[:-1], at[1:]))
    return _UNIT_HASH


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[S.Words, np.ndarray]:
    """Words of a chunk and their kinds (0 literal, 1 number, 2 name, 3 unit)."""
    low, upper = _fold(data)
    n = len(data)
    digit, solid = _DIGIT[data], _WORD[data].copy()
    if n > 2:  # a point or comma between digits belongs to the number
        solid[1:-1] |= ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
    first = solid.copy()
    if n > 1:
        first[1:] &= ~solid[:-1] | (digit[:-1] & ~digit[1:] & _WORD[data[1:]])  # 5kg is 5 kg
    inner = offsets[:-1][offsets[:-1] < n]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = S.Words(start, end, S._ranges(low, start, end), np.searchsorted(start, offsets))
    kind = np.zeros(len(start), np.int8)
    if len(start):
        other = np.concatenate([[0], np.cumsum(~digit & solid & (data != 0x2E) & (data != 0x2C))])
        number = digit[start] & (other[end] == other[start])
        kind[number] = 1
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        heads = np.zeros(len(start), bool)
        heads[words.bounds[:-1][words.bounds[:-1] < len(start)]] = True
        inside = np.zeros(len(start), bool)
        inside[1:] = (stops[start[1:]] == stops[end[:-1]]) & ~heads[1:]
        second = start + np.where(data[start] < 0x80, 1, 2)
        small = (second < end) & ~upper[np.minimum(second, n - 1)]
        kind[inside & upper[start] & small] = 2
        after = np.zeros(len(start), bool)
        after[1:] = number[:-1] & ~heads[1:]
        kind[after & np.isin(words.hash, _unit_hashes())] = 3
    return words, kind


#: Bits of the filter for each window of the benchmark, as long as it may grow; Spark's bitmaps hold 2**15 bits each.
FILTER_BITS, BITMAP_BYTES = 64, 1 << 12


class Filter:
    """Bits set where hashes of a set begin: all of the set pass, and of others the share of bits that are set."""

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.log = bits, log

    @staticmethod
    def of(rows: DataFrame, most: int) -> Filter:
        """Of ``rows (window)``: executors aggregate the bits, the driver gets at most ``FILTER_BITS * most`` of them."""
        log = max(6, (FILTER_BITS * max(1, min(rows.count(), most)) - 1).bit_length())
        at = F.shiftrightunsigned("window", 64 - log) + 1  # bitmaps count from 1
        maps = rows.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        bits = np.zeros((max(1, (1 << log) // (8 * BITMAP_BYTES)), BITMAP_BYTES), np.uint8)
        for k, block in maps.collect():
            bits[k - 1] = np.frombuffer(block, np.uint8)
        return Filter(bits.ravel(), log)

    def near(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.log)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _windows(texts: pa.Array, width: int, known: Filter | None):
    """(row, position, hash, slots) of the template windows of each text; a shorter text is one window.

    With ``known`` only windows that pass it.  Windows with fewer
    than two literal words (one, if they have one word) say nothing and are left out.
    """
    for low, _, data, offsets in S.chunks(texts):
        words, kind = template(data, offsets)
        n = len(kind)
        if not n:
            continue
        count = np.diff(words.bounds)
        row_of = np.repeat(np.arange(len(count)), count)
        place = np.arange(n) - words.bounds[row_of]
        size = np.minimum(count, width)[row_of]
        starts = np.flatnonzero(place <= count[row_of] - size)
        ends = starts + size[starts]
        named = np.concatenate([[0], np.cumsum(kind == 2)])
        for names_open in (False, True):
            held = kind if names_open else np.where(kind == 2, 0, kind)
            at, to = starts, ends
            if names_open:
                some = named[to] > named[at]
                at, to = at[some], to[some]
            literal = np.concatenate([[0], np.cumsum(held == 0)])
            told = literal[to] - literal[at] >= np.minimum(2, to - at)
            at, to = at[told], to[told]
            hashes = S.Rolling(np.select([held == 1, held == 2, held == 3], [NUMBER, NAME, UNIT], words.hash)).some(at, to)
            if known is not None:
                near = known.near(hashes)
                at, to, hashes = at[near], to[near], hashes[near]
            for i, j, h in zip(at.tolist(), to.tolist(), hashes.view(np.int64).tolist(), strict=True):
                slots = [data[words.start[k] : words.end[k]].tobytes().decode("utf-8", "replace").lower() for k in range(i, j) if held[k]]
                yield low + int(row_of[i]), int(place[i]), h, slots


def _window_rows(df: DataFrame, key: str, width: int, known: Filter | None) -> DataFrame:
    """``key, place, window, slots`` for each text."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []

            def flush(out):
                rows = pa.array([x[0] for x in out], pa.int64())
                return pa.record_batch([ids.take(rows), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.string()))], [key, "place", "window", "slots"])

            for item in _windows(batch.column(1), width, known):
                out.append(item)
                if len(out) == 20000:
                    yield flush(out)
                    out = []
            if out:
                yield flush(out)

    return bounded(df).select(F.col(key).cast("long").alias(key), "text").where(f"{key} is not null and text is not null").mapInArrow(run, f"{key} long, place long, window long, slots array<string>")


def _by_copy(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``copy``: one for all windows whose values agree anyway, else every range of ``apart`` a window lies in.

    Windows of one copy lie equally far apart from the item, or nearly where names differ
    in length.  Windows within d words are together in some range of at most 4d words, and
    the widest range is the whole document.
    """
    key = ["doc_id", "item_id"]
    values = pairs.select(*key, F.explode("slots").alias("s")).groupBy(*key, F.col("s.a").alias("a")).agg(F.min("s.b").alias("low"), F.max("s.b").alias("high"))
    mixed = values.where("low <> high").select(*key).distinct()
    spread = pairs.join(mixed, key, "left_semi").groupBy(*key).agg(F.min("apart").alias("least"), (F.max("apart") - F.min("apart")).alias("spread"))
    placed = pairs.join(spread, key, "left")
    far = F.col("apart") - F.col("least")
    whole = F.ceil(F.log2(F.col("spread") + F.lit(1))).cast("int")  # 2**whole is more than the spread

    def ranges(k):
        width = F.pow(F.lit(2.0), k)
        one = lambda half: F.struct(k.alias("scale"), F.lit(half).alias("half"), F.floor((far + half * width / 2) / width).alias("number"))
        return F.when(k == 0, F.array(one(0))).otherwise(F.array(one(0), one(1)))

    only = F.array(F.struct(F.lit(0).alias("scale"), F.lit(0).alias("half"), F.lit(0).cast("long").alias("number")))
    copies = F.when(F.col("spread").isNull(), only).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), whole), ranges)))
    return placed.select(*key, "place", "slots", F.explode(copies).alias("copy"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, most_known: int = 2_000_000) -> DataFrame:
    """Documents that hold a benchmark item, whole or re-parameterised.

    ``docs (doc_id, text)``, ``benchmark (item_id, text)``; other columns are ignored.
    Returns one row per pair with at least ``share`` of the item's windows found and
    consistent in one place: ``doc_id, item_id, n_windows, n_found, coverage,
    reparameterised`` of its best copy (an exact one if equal).
    Null ids or texts, empty texts and items without a word match nothing; a text
    shorter than a window is one window, so an item of fewer words is found only as a
    whole text (inside others such a phrase proves nothing); repeated rows count once.  A filter of
    64 bits for each benchmark window, sized for at most ``most_known`` of them (16 MB), keeps
    most other windows from the join; for a larger benchmark it lets more of them through.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = scratch.write(_window_rows(benchmark, "item_id", width, None).dropDuplicates(["item_id", "place", "window"]), "items")
    size = items.groupBy("item_id").agg(F.count_distinct("place").alias("n_windows"))
    found = _window_rows(docs, "doc_id", width, Filter.of(items.select("window"), most_known))
    pairs = found.select("doc_id", "window", F.col("place").alias("at"), F.col("slots").alias("doc_slots")).join(items, "window")
    pairs = pairs.select("doc_id", "item_id", "place", (F.col("at") - F.col("place")).alias("apart"), F.arrays_zip(F.col("slots").alias("a"), F.col("doc_slots").alias("b")).alias("slots"))
    pairs = _by_copy(scratch.write(pairs, "pairs"))
    # without slots a window is consistent as it is; else each of its values must map as most do
    key = ["doc_id", "item_id", "copy"]
    votes = pairs.where(F.size("slots") > 0).select(*key, F.explode("slots").alias("s")).groupBy(*key, F.col("s.a").alias("a"), F.col("s.b").alias("b")).agg(F.count("*").alias("n"))
    rule = votes.groupBy(*key, "a").agg(F.max_by("b", F.struct("n", F.col("a") == F.col("b"), "b")).alias("b"))
    rule = rule.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("rule"))
    judged = pairs.join(rule, key, "left")
    fits = judged.where(F.coalesce(F.forall("slots", lambda s: F.element_at("rule", s["a"]) == s["b"]), F.size("slots") == 0))
    moved = F.max(F.exists("slots", lambda s: s["a"] != s["b"]))
    copies = fits.groupBy(*key).agg(F.count_distinct("place").alias("n_found"), moved.alias("moved"))
    total = copies.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_found", (~F.col("moved")).alias("exact"))).alias("best"))
    total = total.select("doc_id", "item_id", "best.n_found", (~F.col("best.exact")).alias("reparameterised"))
    total = total.join(size, "item_id").withColumn("coverage", F.col("n_found") / F.col("n_windows"))
    return total.where(F.col("coverage") >= share).select("doc_id", "item_id", "n_windows", "n_found", "coverage", "reparameterised")
