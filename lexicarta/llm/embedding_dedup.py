"""Operator 2: near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random directions, and each projection is kept
sorted at its far end only: the vectors beyond the quantile ``share``.  There two
unrelated vectors meet with chance ``share`` squared, but near ones with ``share``
times the chance that the second is far out, too, and lies in the window around
the first.  That chance follows from the cosine alone, so the number of directions
is calibrated exactly: pairs right at the threshold collide ``least`` times or more
with the recall asked for, closer ones more surely.

A vector is far out on a handful of directions and goes to those only, with the
list of all its places; so the collisions of a pair are counted where it meets
first, and pairs that pass are verified by their exact cosine on the spot.  The
share falls as labels grow, so a vector meets about as many others in a label of a
million as in one of a thousand.  Full ends are cut into blocks of bounded size and
each pair of blocks is one unit of work, which returns a number of links and the
smallest linked id for each of its vectors, never the pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, bounded

#: Vectors that an end holds in the largest label, and the smallest share of an end (2**-10).
END, MOST_LEVEL = 32, 10
#: Values of one block of projections in memory.
SHADOW = 1 << 20
#: Vectors of a unit up to which many units are solved at once.
SMALL = 256


@dataclass(frozen=True)
class Plan:
    """Ends beyond ``bound`` of ``ends`` directions (two each way), window half-width, collisions asked for, recall at the threshold."""

    bound: float
    ends: int
    half: float
    least: int
    recall: float


def _beyond(x: float) -> float:
    """Chance of a standard normal number above x."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def collision_chance(cosine: float, bound: float, half: float) -> float:
    """Chance that of two unit vectors at this cosine both lie beyond ``bound`` of a direction, within ``half``."""
    sigma = math.sqrt(max(1e-12, 1 - cosine * cosine))
    x = np.linspace(bound, bound + 12, 20001)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    low, high = np.maximum(x - half, bound), x + half
    inner = np.array([_beyond(a) - _beyond(b) for a, b in zip((low - cosine * x) / sigma, (high - cosine * x) / sigma, strict=True)])
    return float(np.trapezoid(density * inner, x))


def calibrate(cosine: float, recall: float, level: int, least: int = 2, z: float = 2.5) -> Plan:
    """``least`` is two or more.  The fewest ends of share ``2**-level`` with which pairs at the threshold collide ``least`` times at the recall."""
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _beyond(middle) > 2.0**-level else (low, middle)
    half = z * math.sqrt(max(0.0, 2 - 2 * cosine))
    one = collision_chance(cosine, low, half)

    def kept(ends: int) -> float:
        return 1 - sum(math.comb(ends, k) * one**k * (1 - one) ** (ends - k) for k in range(least))

    ends = 2 * least
    while kept(ends) < recall:
        ends += max(2, ends // 64 * 2)
    return Plan(low, ends, half, least, kept(ends))


def directions(dim: int, n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def far_out(unit: np.ndarray, plan: Plan, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, end, value) of every place of the rows, by row; end 2k is above, 2k + 1 below on direction k."""
    rows, ends, values = [], [], []
    step = max(1, SHADOW // axes.shape[1])
    for at in range(0, len(unit), step):
        shadow = unit[at : at + step] @ axes
        row, k = np.nonzero(np.abs(shadow) >= plan.bound)
        value = shadow[row, k]
        rows.append(row + at)
        ends.append(2 * k + (value < 0))
        values.append(np.abs(value))
    return np.concatenate(rows), np.concatenate(ends).astype(np.int32), np.concatenate(values).astype(np.float32)


def embedding_dedup(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.99, block: int = 2000) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``cosine``, in double precision.

    ``vectors`` needs ``vec_id``, ``embedding`` (array of numbers) and ``label``; other
    columns are ignored.  Returns one row per input row: ``vec_id, n_links,
    component_id, kept``.  Null labels, and vectors that are null, empty, zero or hold
    a null or a non-finite number, link with nothing, as do vectors of different
    lengths; a null ``vec_id`` is returned with a null component.  Equal vectors of a
    label are one class, compared once and counted each.  No link below ``cosine`` is
    ever returned; a pair right at it is found with chance ``recall``, a closer one more surely.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"), F.col("label").cast("string").alias("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    valid = rows.where(F.coalesce(fine, F.lit(False)))
    classes = valid.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.write(classes.withColumn("dim", F.size("e")), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    plan = calibrate(cosine, recall, min(MOST_LEVEL, max(1, int(math.log2(max(1, largest) / END)))) if largest > END else 1)

    def place(batches):
        axes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in axes:
                    axes[dim] = directions(dim, plan.ends // 2)
                own = pa.array(np.flatnonzero(dims == dim))
                x = matrix(batch.column(1).take(own))
                row, end, value = far_out(x / np.linalg.norm(x, axis=1, keepdims=True), plan, axes[dim])
                bounds = np.searchsorted(row, np.arange(len(own) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(c)) for c in (end, value)]
                for low in range(0, len(row), 4096):
                    part = row[low : low + 4096]
                    whole = own.take(pa.array(part))
                    columns = [batch.column(k).take(whole) for k in (0, 4, 2, 3, 1)]
                    yield pa.record_batch([*columns, pa.array(end[low : low + 4096]), *(c.take(pa.array(part)) for c in lists)], ["label", "dim", "rep", "copies", "e", "end", "ends", "places"])

    placed = classes.select("label", "e", "rep", "copies", "dim").mapInArrow(place, f"label string, dim int, rep long, copies long, e {kind}, end int, ends array<int>, places array<float>")
    placed = scratch.write(placed, "placed")
    key = ["label", "dim", "end"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = placed.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a unit is a pair of blocks (s <= t) of one end; side tells on which of two different blocks a row stands
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("*", other).withColumn("s", F.least("block", "other")).withColumn("t", F.greatest("block", "other"))
    dealt = dealt.select(F.xxhash64(*key, "s", "t").alias("unit"), F.when(F.col("s") == F.col("t"), 0).when(F.col("block") == F.col("s"), 1).otherwise(2).alias("side"), "end", "rep", "copies", "ends", "places", "e")

    def count(batches):
        held = None
        for batch in batches:
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cuts = _cuts(table.column(0).to_numpy())
            yield from _solved(table, cuts[:-1], plan, cosine)
            held = table.slice(cuts[-2]) if len(cuts) > 1 else None
        if held is not None:
            yield from _solved(held, [0, held.num_rows], plan, cosine)

    dealt = dealt.repartition("unit").sortWithinPartitions("unit")
    found = scratch.write(dealt.mapInArrow(count, "rep long, links long, low long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("low < rep").select(F.col("rep").alias("a"), F.col("low").alias("b")), scratch)
    known = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = valid.join(known, ["label", "e"]).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _cuts(marks: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)] if len(marks) else [0]


def _solved(table: pa.RecordBatch, cuts: list[int], plan: Plan, cosine: float):
    """Links of all units of a batch, one row for each vector with any: small units all at once, large ones one by one."""
    if len(cuts) < 2:
        return
    out = []
    side, end, rep, copies = (table.column(k).to_numpy() for k in (1, 2, 3, 4))
    size, cuts = np.diff(cuts), np.array(cuts)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    if len(small):
        rows = _ranges(cuts[small], size[small])
        unit = np.repeat(np.arange(len(small)), size[small])
        member, ends, places = _places(table.take(pa.array(rows)))
        i, j = first_met(unit, end[rows], side[rows], member, ends, places, plan)
        out.append(_links(rep[rows], copies[rows], table.column(7).take(pa.array(rows)), i, j, cosine))
    for a, b in zip(cuts[:-1][size > SMALL].tolist(), cuts[1:][size > SMALL].tolist(), strict=True):
        member, ends, places = _places(table.slice(a, b - a))
        i, j = collided(member, ends, places, int(end[a]), side[a:b], plan)
        out.append(_links(rep[a:b], copies[a:b], table.column(7).slice(a, b - a), i, j, cosine))
    out = [x for x in out if x is not None]
    if out:
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        yield pa.record_batch([pa.array(c) for c in columns], ["rep", "links", "low"])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    return np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _places(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, end, value) of every place of the rows."""
    ends, places = rows.column(5), rows.column(6)
    return np.repeat(np.arange(rows.num_rows), ends.value_lengths().to_numpy()), ends.flatten().to_numpy(), places.flatten().to_numpy()


def first_met(unit: np.ndarray, end: np.ndarray, side: np.ndarray, member: np.ndarray, ends: np.ndarray, places: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """As ``collided`` for many units at once; ``unit, end, side`` are of the rows, the others of their places.

    All rows of a unit lie at its end, so only collisions at other ends need counting:
    a pair must have enough, none at an earlier end, and lie within the window here.
    """
    n, here = len(unit), np.zeros(len(unit), np.float32)
    own = ends == end[member]
    here[member[own]] = places[own]
    member, ends, places = member[~own], ends[~own].astype(np.int64), places[~own]
    key = unit[member] * (plan.ends + 1) + ends
    order = np.lexsort((places, key))
    member, ends, places, key = member[order], ends[order], places[order], key[order]
    cells, firsts = [], []
    for gap in range(1, len(key)):
        same = np.flatnonzero(key[gap:] == key[:-gap])
        if not len(same):
            break
        same = same[places[same + gap] - places[same] <= plan.half]
        i, j = member[same], member[same + gap]
        cells.append(np.minimum(i, j) * n + np.maximum(i, j))
        firsts.append(ends[same])
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell, first = np.concatenate(cells), np.concatenate(firsts)
    if not len(cell):
        return cell, cell
    order = np.argsort(cell, kind="stable")
    cell, first = cell[order], first[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    met, first = np.diff(np.append(starts, len(cell))) + 1, np.minimum.reduceat(first, starts)
    i, j = np.divmod(cell[starts], n)
    fine = (met >= plan.least) & (first > end[i]) & (np.abs(here[i] - here[j]) <= plan.half) & ((side[i] == 0) | (side[i] != side[j]))
    return i[fine], j[fine]


def collided(member: np.ndarray, ends: np.ndarray, places: np.ndarray, end: int, side: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members with ``plan.least`` (two or more) collisions, of which this end's is the first.

    All places of all members are sorted by end and value; each pair of places of one
    end within the window is one collision.
    """
    n = int(member[-1]) + 1
    order = np.lexsort((places, ends))
    member, ends, places = member[order], ends[order], places[order]
    met, first = np.zeros((n, n), np.int16), np.full((n, n), np.iinfo(np.int32).max, np.int32)
    for gap in range(1, len(ends)):
        same = ends[gap:] == ends[:-gap]
        if not same.any():
            break
        near = np.flatnonzero(same & (places[gap:] - places[:-gap] <= plan.half))
        if not len(near):
            continue
        i, j, at = member[near], member[near + gap], ends[near]
        i, j = np.minimum(i, j), np.maximum(i, j)
        cell = i * n + j
        np.add.at(met.reshape(-1), cell, 1)
        np.minimum.at(first.reshape(-1), cell, at)
    i, j = np.nonzero((met >= plan.least) & (first == end))
    if side.any():
        across = side[i] != side[j]
        i, j = i[across], j[across]
    return i, j


def _links(rep: np.ndarray, copies: np.ndarray, vectors: pa.Array, i: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, ...] | None:
    """(id, links, smallest id reached) of the members whose exact cosine with another passes."""
    if not len(i):
        return None
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    rep, copies, i, j = rep[used], copies[used], at[: len(i)], at[len(i) :]
    vectors = vectors.take(pa.array(used))
    if len(set(vectors.value_lengths().to_pylist())) > 1:  # units of different lengths: each on its own
        length = vectors.value_lengths().to_numpy()
        parts = [_links(rep, copies, vectors, i[length[i] == n], j[length[i] == n], cosine) for n in np.unique(length)]
        parts = [p for p in parts if p is not None]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None
    x = matrix(vectors)
    norm = np.sqrt((x**2).sum(1))
    exact = np.empty(len(i))
    step = max(1, SHADOW // x.shape[1])
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        exact[at : at + step] = (x[a] * x[b]).sum(1) / (norm[a] * norm[b])
    i, j = i[exact >= cosine], j[exact >= cosine]
    if not len(i):
        return None
    links, low = np.zeros(len(rep), np.int64), rep.copy()
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    while True:
        least = low.copy()
        np.minimum.at(least, i, low[j])
        np.minimum.at(least, j, low[i])
        if (least == low).all():
            break
        low = least
    some = links > 0
    return rep[some], links[some], low[some]
