"""Operator 7: Jaccard similarity join of word shingles by token-combination prefixes.

All documents order their shingles by one hash.  Two sets with Jaccard at least t
share at least l of the first ``n - ceil(t*n) + l`` shingles of each, for any l up
to their overlap; with l grown to a twentieth of the set, three exact steps follow:

* a document with fewer than l prefix shingles known from elsewhere links with none;
* shingles few documents share are indexed alone, so pairs with one of them meet;
* other pairs share l frequent ones: dealt into l - 1 groups by hash, two of those
  fall into one group, so two-shingle combinations within groups are indexed.

Candidate pairs are verified on whole sets, unless both are in one component already.  Large buckets are not expanded:
members are first compared with the bucket's smallest id; only buckets that still
span several components go on, and there only pairs across components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans as S
from .components import components
from .scratch import Scratch, bounded

#: Slots of the frequency sketch: a fixed size, however many shingles there are.
SLOT_BITS = 16
#: So many ids may go to every task; more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Rows of one side in a block of a large family.
BLOCK = 1000


class Threshold:
    """Jaccard at least ``num/den``, in integers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold lies in (0, 1]")
        self.num, self.den = num, den

    def least(self, n):
        """Fewest shingles of a set of n that a similar set shares, and its fewest shingles."""
        return -(-n * self.num // self.den)

    def most(self, n):
        """Most shingles of a set similar to one of n."""
        return n * self.den // self.num

    def shared(self, n):
        """l: prefix shingles shared by two similar sets of n or more."""
        return n // 20 + 2

    def prefix(self, n):
        return min(n, n - self.least(n) + self.shared(n))

    def alone(self, n) -> bool:
        """Only equal sets can be similar to one of n."""
        return self.least(n) == n and self.most(n) == n

    def classes(self, n) -> range:
        """Size classes in which a set of n can meet a partner: powers of 1.25 of the smaller size."""
        return range(size_class(self.least(n)), size_class(n) + 1)

    def groups(self, c: int) -> int:
        """Groups of class c: one fewer than the shingles shared by the smallest sets of the class."""
        return max(1, self.shared(math.ceil(1.25**c - 1e-9)) - 1)


def size_class(n: int) -> int:
    c = int(math.log(n) / math.log(1.25) + 1e-9)
    while 1.25**c > n + 1e-9:
        c -= 1
    while 1.25 ** (c + 1) <= n + 1e-9:
        c += 1
    return c


def shingle_sets(texts: pa.Array, k: int, key: S.Key):
    """(row, sorted distinct shingle hashes) of each text with a word; A-Z in lower case.

    A text of fewer than ``k`` words is one shingle, the whole sequence.
    """
    for low, high, data, offsets in S.chunks(texts):
        w = S.words(data, offsets, lower=True, key=key)
        rolling = S.Windows(w.hash, key)
        grams, size = rolling.all(k), np.diff(w.bounds)
        short = np.flatnonzero((size > 0) & (size < k))
        whole = dict(zip(short.tolist(), rolling.some(w.bounds[short], w.bounds[short + 1]), strict=True))
        for r in range(high - low):
            a, b = int(w.bounds[r]), int(w.bounds[r + 1])
            if b - a >= k:
                yield low + r, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield low + r, np.array([whole[r]])


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, rare: int = 8) -> DataFrame:
    """Links between documents whose sets of ``k``-word shingles have Jaccard at least ``num/den``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Returns one row
    per input row: ``doc_id, n_shingles, component_id``, the smallest id reachable by
    links.  A null or wordless text has no shingle and links with nothing; a row with a
    null id is returned with a null component; rows that share an id and a text are
    returned each; an id with different texts keeps a row and a count for each, is
    compared by the greatest of its sets, and belongs to the smallest of its classes.
    Equal sets form one class and are compared once.  An empty table gives an empty result.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch, key = Scratch(docs.sparkSession, "jaccard"), S.Key.draw()
    t = Threshold(num, den)

    def measure(batches):
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        shift = np.uint64(64 - SLOT_BITS)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            first, second = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            for row, own in shingle_sets(batch.column(1), k, key):
                n[row] = len(own)
                first[row] = S.mix(own).sum(dtype=np.uint64)
                second[row] = S.mix(own ^ np.uint64(S.ITEM_BASE)).sum(dtype=np.uint64)
                np.add.at(seen, (own >> shift).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), none], ["doc_id", "n", "h1", "h2", "slot"])
        at = np.flatnonzero(seen)
        zero = pa.array(np.zeros(len(at), np.int64))
        yield pa.record_batch([pa.nulls(len(at), pa.int64()), pa.array(seen[at]), zero, zero, pa.array(at.astype(np.int32))], ["doc_id", "n", "h1", "h2", "slot"])

    measured = scratch.write(docs.mapInArrow(measure, "doc_id long, n long, h1 long, h2 long, slot int"), "measured")
    meta = measured.where("slot is null").select("doc_id", "n", "h1", "h2")
    # slots with far more shingles than most hold very frequent ones (at most 2**SLOT_BITS rows)
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for slot, total in measured.where("slot is not null").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = total
    usual = float(np.median(counts))
    hot = counts > usual + 8 * math.sqrt(usual + 1) + 64

    def prefixes(batches):
        shift, done = np.uint64(64 - SLOT_BITS), set()
        for batch in batches:
            ids, out = batch.column(0), []
            for row, own in shingle_sets(batch.column(1), k, key):
                n = len(own)
                if t.alone(n):
                    continue
                digest = (n, int(S.mix(own).sum(dtype=np.uint64)))
                if digest in done:  # a copy within this task
                    continue
                done.add(digest)
                busy = hot[(own >> shift).astype(np.int64)]
                order = np.concatenate([own[~busy], own[busy]])[: t.prefix(n)]
                cold = min(len(order), n - int(busy.sum()))
                out.append((row, n, order, cold))
            if out:
                size = [len(x[2]) for x in out]
                rows = np.repeat([x[0] for x in out], size)
                held = np.concatenate([np.arange(len(x[2])) >= x[3] for x in out])
                yield pa.record_batch([pa.array(np.concatenate([x[2] for x in out]).view(np.int64)), ids.take(pa.array(rows)), pa.array(np.repeat([x[1] for x in out], size).astype(np.int32)), pa.array(held)], ["token", "doc_id", "n", "hot"])

    tokens = docs.where("doc_id is not null and text is not null").mapInArrow(prefixes, "token long, doc_id long, n int, hot boolean")
    # very frequent shingles are salted and need no count; the sketch bounds the rows of all others
    tokens = tokens.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(256)).cast("int")).otherwise(0))
    counted = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token", "salt")))
    known = scratch.write(counted.where("hot or df > 1").select("token", "doc_id", "n", "hot"), "known")
    bound = lambda n: F.floor(F.ceil(n * num / den) / 20) + 2  # noqa: E731  l of the smallest partner
    alive = known.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= bound(F.col("n"))).select("doc_id")
    # the smallest id stands for each set
    sets = meta.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = meta.join(sets.where("copies > 1"), ["n", "h1", "h2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"))
    copies = scratch.write(copies, "copies")
    live = known.join(alive, "doc_id", "left_semi").join(copies, "doc_id", "left")
    live = live.select("token", F.coalesce("rep", "doc_id").alias("doc_id"), "n", "hot").distinct()
    live = scratch.write(live, "live")
    scratch.drop("known")
    frequency = live.groupBy("token").agg(F.count("*").alias("df"), F.max("hot").alias("hot")).where("df > 1")
    live = scratch.write(live.drop("hot").join(frequency, "token"), "classed")
    scratch.drop("live")
    single = live.where(F.col("df") <= rare).select("token", "doc_id", "n")
    pairs = single.alias("x").join(single.alias("y"), "token").where("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    fit = lambda a, b: (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)
    pairs = pairs.where(fit("na", "nb")).select("a", "b").distinct()

    def combine(batches):
        for batch in batches:
            sig, doc, size = [], [], []
            for d, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.sort(own.values.to_numpy().view(np.uint64))
                for c in t.classes(n):
                    got = combinations(own, c, t.groups(c))
                    sig.append(got)
                    doc.append(np.full(len(got), d))
                    size.append(np.full(len(got), n, np.int32))
            if sig:
                yield pa.record_batch([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(size))], ["sig", "doc_id", "n"])

    frequent = live.where(F.col("df") > rare).groupBy("doc_id").agg(F.max("n").alias("n"), F.collect_set("token").alias("tokens"))
    combos = scratch.write(frequent.select("doc_id", "n", "tokens").mapInArrow(combine, "sig long, doc_id long, n int"), "combos")
    hubs = combos.groupBy("sig").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = scratch.write(hubs, "hubs")
    met = combos.join(hubs, "sig")
    stars = met.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
    stars = stars.where("a <> b").where(fit("na", "nb")).select("a", "b").distinct()
    tried = scratch.write(pairs.unionByName(stars).distinct(), "tried")

    held = scratch.write(live.select("doc_id").distinct(), "held")
    scratch.drop("classed")
    if held.count() <= MOST_IDS:  # 8 MB of ids: the texts need no shuffle
        held = F.broadcast(held)

    def gather(batches):
        for batch in batches:
            out = [(row, own) for row, own in shingle_sets(batch.column(1), k, key)]
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.record_batch([batch.column(0).take(rows), pa.array([x[1].view(np.int64) for x in out], pa.list_(pa.int64()))], ["doc_id", "own"])

    whole = docs.join(held, "doc_id", "left_semi").mapInArrow(gather, "doc_id long, own array<long>")
    whole = scratch.write(whole.groupBy("doc_id").agg(F.max("own").alias("own")), "sets")

    def verified(candidates: DataFrame) -> DataFrame:
        both = candidates.join(whole.select(F.col("doc_id").alias("a"), F.col("own").alias("x")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("own").alias("y")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
        return both.where(F.col("i") * den >= (F.col("s") - F.col("i")) * num).select("a", "b")

    # one candidate of each document first; of the others only those that could still join two components
    first = tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    sure = scratch.write(verified(first), "sure")
    joined = scratch.write(components(sure, scratch, "cc0"), "joined")
    of = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    open_ = tried.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    open_ = open_.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    links = scratch.write(sure.unionByName(verified(open_)), "links")
    parts = scratch.write(components(links, scratch, "cc1"), "parts")
    # buckets that still span components: pairs across components not tried yet, by the buckets' smallest id
    wide = met.where("members > 2").select("sig", "doc_id", "n", F.col("hub.doc_id").alias("hub")).join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    wide = wide.withColumn("component", F.coalesce("component", "doc_id"))
    split = wide.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    wide = wide.join(split, "sig", "left_semi").where("doc_id <> hub").select("hub", "doc_id", "n", "component").distinct()
    wide = scratch.write(wide, "wide")
    scratch.drop("combos")
    scratch.drop("hubs")
    # shingles that no other such document has bound what a pair can share
    lone = whole.join(wide.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode("own").alias("token"))
    lone = lone.groupBy("token").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id")).where("df = 1").groupBy("doc_id").agg(F.count("*").alias("u"))
    wide = wide.join(lone, "doc_id", "left").withColumn("can", F.col("n") - F.coalesce("u", F.lit(0)))
    size = wide.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wide = scratch.write(wide.join(size, "hub"), "families")
    x = wide.select("hub", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), *(F.col(c).alias(f"{c}_x") for c in ("doc_id", "n", "component", "can")))
    y = wide.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"{c}_y") for c in ("doc_id", "n", "component", "can")))
    can = F.least("can_x", "can_y")
    near = (F.col("doc_id_x") < F.col("doc_id_y")) & (F.col("component_x") != F.col("component_y")) & (can * (den + num) >= (F.col("n_x") + F.col("n_y")) * num)
    cross = x.join(y, (x["hub"] == y["hub"]) & (x["block"] == y["block"]) & near).select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b")).distinct()
    cross = cross.join(tried, ["a", "b"], "left_anti")
    more = scratch.write(verified(cross), "more")
    final = components(links.unionByName(more), scratch, "cc2")
    for name in ("tried", "held", "sets", "sure", "joined", "links", "parts", "wide", "families", "more"):
        scratch.drop(name)
    whole_map = meta.join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return whole_map.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def combinations(own: np.ndarray, c: int, groups: int) -> np.ndarray:
    """Hashes of all two-shingle combinations within each group of size class ``c``."""
    group = (S.mix(own) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    own, group = own[order], group[order]
    out = []
    for gap in range(1, len(own)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        out.append(S.mix(own[:-gap][same] * np.uint64(S.ITEM_BASE) + S.mix(own[gap:][same] + np.uint64(c))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
