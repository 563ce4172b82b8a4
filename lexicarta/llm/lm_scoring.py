"""Operator 10: document scores by masked pseudo-likelihood.

A small network looks at the words on both sides of a masked position and gives
every token a probability, by class and then within the class.  The corpus is
turned into tokens once and dealt into shards by content, about ``SHARD`` tokens
each.  Training runs in numpy inside the tasks: each shard masks a share of all its
positions, trains from the common parameters in an order of its own, and the results
are averaged with the positions as weights, for a few rounds, each with another
share until every position had a turn.  Shards, their order and the sums depend on
the texts alone, so the scores do not depend on how rows lie in partitions.  A
document's score sums the log-probability of every one of its tokens given both sides.

Tokens are lower-cased words: the most frequent of the whole corpus by themselves,
all others in hashed buckets.  With the counts of all words, a word in a bucket gets
the bucket's probability times its own share of it, and the vocabulary grows with
the fourth root of the corpus, up to ``MOST_SIDE ** 2`` tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .scratch import Scratch, bounded

#: Rows of averaged parameters: values in one row, and ways to split the sum of a row.
ROW, WAYS = 2048, 64
#: Words of a corpus up to which the smallest shape stands, and the side of the largest.
FEW_WORDS, MOST_SIDE = 1 << 22, 96
#: Tokens of a shard, and of a piece of it that is held at once.
SHARD, PIECE = 1 << 21, 1 << 16
#: Copies of one text that one task puts out.
MOST_COPIES = 1024


@dataclass(frozen=True)
class Shape:
    """``side * side`` tokens (below 2**15), the first ``words`` of them frequent words; ``radius`` words each side."""

    side: int = 32
    words: int = 768
    width: int = 16
    radius: int = 2

    @property
    def tokens(self) -> int:
        return self.side * self.side

    def sizes(self) -> list[tuple[int, ...]]:
        n, d = self.side, self.width
        return [(self.tokens + 1, d), (2 * self.radius, d), (d,), (d, n), (n,), (n, d, n), (n, n)]

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for size in self.sizes():
            n = int(np.prod(size))
            out.append(flat[at : at + n].reshape(size))
            at += n
        return out

    def start(self, seed: int = 3) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = [rng.standard_normal(s) * 0.1 for s in self.sizes()]
        parts[1] += 1.0 / (2 * self.radius)
        for k in (2, 4, 6):
            parts[k][:] = 0
        return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def token_ids(hashes: np.ndarray, vocabulary: np.ndarray, shape: Shape) -> np.ndarray:
    """Token of each word hash; ``vocabulary`` is sorted."""
    bucket = shape.words + (hashes % np.uint64(shape.tokens - shape.words)).astype(np.int64)
    if not len(vocabulary):
        return bucket
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, bucket)


class Around:
    """Tokens around positions; beyond a document stands the token after the last."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, shape: Shape):
        # documents lie apart by as many such tokens as a window reaches
        self.steps = [*range(-shape.radius, 0), *range(1, shape.radius + 1)]
        self.place = np.arange(len(ids)) + shape.radius * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
        self.padded = np.full(len(ids) + shape.radius * len(bounds), shape.tokens, np.int32)
        self.padded[self.place] = ids

    def of(self, at: np.ndarray) -> np.ndarray:
        place = self.place[at]
        return np.stack([self.padded[place + step] for step in self.steps], 1)


def contexts(ids: np.ndarray, bounds: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """Tokens around each position."""
    return Around(ids, bounds, shape).of(at)


def _hidden(embed: np.ndarray, place: np.ndarray, shift: np.ndarray, around: np.ndarray) -> np.ndarray:
    """What the network makes of both sides: embeddings weighed by place."""
    total = (embed * place[0])[around[:, 0]]
    for k in range(1, len(place)):
        total += (embed * place[k])[around[:, k]]
    total += shift
    return np.tanh(total, out=total)


def _exponents(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Exponentials of logits up to a factor for each row; as they are where the weights bound them (hidden values lie within 1)."""
    if (np.abs(weights).sum(0) + np.abs(bias)).max() > 60:
        x -= x.max(1, keepdims=True)
    return np.exp(x, out=x)


def log_probabilities(flat: np.ndarray, around: np.ndarray, target: np.ndarray, shape: Shape) -> np.ndarray:
    """Conditional log-probability of each target."""
    embed, place, shift, top, top_bias, inner, inner_bias = shape.split(flat)
    hidden = _hidden(embed, place, shift, around)
    group, member = np.divmod(target, shape.side)
    e = _exponents(hidden @ top + top_bias, top, top_bias)
    chance = e[np.arange(len(target)), group] / e.sum(1)
    order = np.argsort(group.astype(np.int16), kind="stable")
    hidden, member = hidden[order], member[order]
    cuts = np.searchsorted(group[order], np.arange(shape.side + 1)).tolist()
    within = np.empty(len(target), chance.dtype)
    for g in range(shape.side):
        a, b = cuts[g], cuts[g + 1]
        if b > a:
            e = _exponents(hidden[a:b] @ inner[g] + inner_bias[g], inner[g], inner_bias[g])
            within[a:b] = e[np.arange(b - a), member[a:b]] / e.sum(1)
    small = np.finfo(np.float32).tiny
    out = np.log(np.maximum(chance, small).astype(np.float64))
    out[order] += np.log(np.maximum(within, small).astype(np.float64))
    return out


def train_step(flat: np.ndarray, memory: np.ndarray, around: np.ndarray, target: np.ndarray, shape: Shape, rate: float) -> None:
    """One mini-batch of gradient descent with per-parameter rates, in place."""
    embed, place, shift, top, top_bias, inner, inner_bias = shape.split(flat)
    slope = np.zeros_like(flat)
    g_embed, g_place, g_shift, g_top, g_top_bias, g_inner, g_inner_bias = shape.split(slope)
    group, member = np.divmod(target, shape.side)
    order = np.argsort(group.astype(np.int16), kind="stable")  # a group's positions lie together
    around, group, member = around[order], group[order], member[order]
    hidden = _hidden(embed, place, shift, around)
    error = _exponents(hidden @ top + top_bias, top, top_bias)
    error /= error.sum(1, keepdims=True)
    error[np.arange(len(target)), group] -= 1
    g_top += hidden.T @ error
    g_top_bias += error.sum(0)
    back = error @ top.T
    cuts = np.searchsorted(group, np.arange(shape.side + 1)).tolist()
    for g in range(shape.side):
        a, b = cuts[g], cuts[g + 1]
        if b > a:
            error = _exponents(hidden[a:b] @ inner[g] + inner_bias[g], inner[g], inner_bias[g])
            error /= error.sum(1, keepdims=True)
            error[np.arange(b - a), member[a:b]] -= 1
            g_inner[g] += hidden[a:b].T @ error
            g_inner_bias[g] += error.sum(0)
            back[a:b] += error @ inner[g].T
    back *= 1 - hidden**2
    g_shift += back.sum(0)
    cell = np.arange(shape.width, dtype=np.int64)
    for k in range(2 * shape.radius):  # sums for each token, counted by single cells: much faster than adding rows
        sums = np.bincount((around[:, k, None] * shape.width + cell).ravel(), back.ravel(), g_embed.size).reshape(g_embed.shape)
        g_embed += sums * place[k]
        g_place[k] += (sums * embed).sum(0)
    slope /= len(target)
    memory += slope**2
    flat -= rate * slope / np.sqrt(memory + 1e-8)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` for the hash of every word of all documents."""

    def count(batches):
        for batch in batches:
            held = []
            for _, _, data, offsets in S.chunks(batch.column(0), 4 * S.CHUNK_BYTES):
                held.append(np.unique(S.words(data, offsets, lower=True).hash, return_counts=True))
            if held:
                h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x[1] for x in held]), len(h)).astype(np.int64)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    return bounded(docs).select("text").where("text is not null").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counted: DataFrame, words: int) -> np.ndarray:
    best = counted.orderBy(F.desc("n"), "word").limit(words).collect()
    return np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))


def vocabulary(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the ``words`` most frequent words over all documents."""
    return _most_frequent(word_counts(docs), words)


def shape_for(n_words: int) -> Shape:
    """The shape for a corpus of so many words, three quarters of its tokens frequent words."""
    side = min(MOST_SIDE, int(Shape.side * max(1.0, n_words / FEW_WORDS) ** 0.125))
    return Shape(side=side, words=side * side * 3 // 4)


@dataclass(frozen=True)
class Shares:
    """What tells the words of a bucket apart: ``counted (word, n)`` of the corpus, and by bucket the logarithm of its words, occurrences and one."""

    counted: DataFrame
    rest: np.ndarray


def word_shares(counted: DataFrame, words: np.ndarray, shape: Shape = Shape()) -> Shares:
    """P(word | bucket) is (n + 1) / (occurrences + words + 1); one part is left for all unseen words together."""
    buckets = shape.tokens - shape.words
    frequent = counted.sparkSession.createDataFrame([(x,) for x in words.view(np.int64).tolist()], "word long")
    signed = F.pmod("word", F.lit(buckets)) + F.when(F.col("word") < 0, 2**64 % buckets).otherwise(0)
    held = counted.join(F.broadcast(frequent), "word", "left_anti").groupBy(F.pmod(signed, F.lit(buckets)).cast("int").alias("bucket"))
    rest = np.ones(buckets)
    for r in held.agg((F.sum("n") + F.count("*")).alias("n")).collect():
        rest[r["bucket"]] += r["n"]
    return Shares(counted, np.log(rest))


def _average(rows: DataFrame, length: int) -> np.ndarray | None:
    """Weighted mean of parameter rows ``part, row, weight, values``, summed in a stream, in two levels."""

    def add(batches):
        key, total, weight = None, None, 0.0

        def done():
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([weight]), pa.array([total], pa.list_(pa.float64()))], ["row", "way", "weight", "values"])

        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if now != key:
                    if key is not None:
                        yield done()
                    key, total, weight = now, 0.0, 0.0
                weight += batch.column(2)[k].as_py()
                total = total + batch.column(3)[k].values.to_numpy()
        if key is not None:
            yield done()

    schema = "row int, way int, weight double, values array<double>"
    first = rows.select("row", F.pmod("part", F.lit(WAYS)).cast("int").alias("way"), "part", "weight", "values")
    first = first.repartition("row", "way").sortWithinPartitions("row", "way", "part").select("row", "way", "weight", "values").mapInArrow(add, schema)
    second = first.repartition("row").sortWithinPartitions("row", "way").select("row", F.lit(0).alias("way"), "weight", "values").mapInArrow(add, schema)
    got = sorted(second.collect())  # as many rows as parameters / ROW
    if not got:
        return None
    return np.concatenate([np.array(r[3]) / r[2] for r in got])[:length].astype(np.float32)


def masked(words: S.Words, every: int, turn: int) -> np.ndarray:
    """Positions whose turn it is, by what ``words.hash`` holds and the place in the document alone."""
    place = np.arange(len(words.hash)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
    return np.flatnonzero(S.mix(words.hash + place.astype(np.uint64) * np.uint64(S.ITEM_BASE)) % np.uint64(every) == np.uint64(turn % every))


def tokens(docs: DataFrame, words: np.ndarray, shape: Shape) -> DataFrame:
    """``key, ids`` of every text with a word: a hash of its words, and its tokens."""

    def read(batches):
        for b in batches:
            for _, _, data, offsets in S.chunks(b.column(0)):
                w = S.words(data, offsets, lower=True)
                some = np.flatnonzero(np.diff(w.bounds))
                if len(some):
                    keys = S.Rolling(w.hash).some(w.bounds[some], w.bounds[some + 1])
                    ids = pa.ListArray.from_arrays(pa.array(np.append(w.bounds[some], len(w.hash)), pa.int32()), pa.array(token_ids(w.hash, words, shape).astype(np.int16)))
                    yield pa.record_batch([pa.array(keys.view(np.int64)), ids], ["key", "ids"])

    return docs.select("text").where("text is not null").mapInArrow(read, "key long, ids array<short>")


def _copies(coded: DataFrame) -> DataFrame:
    """``key, copy, ids``: each text as often as it occurs; many copies come out of many tasks."""
    few = coded.where(F.col("copies") <= MOST_COPIES).select("key", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    many = coded.where(F.col("copies") > MOST_COPIES).select("key", "ids", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / MOST_COPIES))).alias("block"))
    first = F.col("block") * MOST_COPIES
    many = many.repartition("key", "block").select("key", "ids", F.explode(F.sequence(first, F.least(first + MOST_COPIES, F.col("copies")) - 1)).alias("copy"))
    return few.unionByName(many).select("key", "copy", "ids")


def _pieces(batches, size: int):
    """(shard, marks, ids, bounds) of runs of whole documents of one shard, cut by their tokens and not by batches.

    Marks are hashes of the documents' keys and copies, for each token.
    """
    shard, held, n = None, [], 0

    def done():
        length = [len(x[1]) for x in held]
        marks = S.mix(np.array([x[0] for x in held], np.int64).view(np.uint64) + np.array([x[2] for x in held], np.uint64) * np.uint64(S.BYTE_BASE))
        return shard, np.repeat(marks, length), np.concatenate([x[1] for x in held]), np.concatenate([[0], np.cumsum(length)])

    for b in batches:
        shards, keys, copies, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
        flat, ends = lists.flatten().to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for k in range(b.num_rows):
            if held and (shards[k] != shard or n >= size):
                yield done()
                held, n = [], 0
            shard = int(shards[k])
            held.append((keys[k], flat[ends[k] : ends[k + 1]], copies[k]))
            n += len(held[-1][1])
    if held:
        yield done()


def train(docs: DataFrame, shape: Shape = Shape(), every: int = 2, rounds: int = 2, batch: int = 4096, rate: float = 0.1, counted: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary, parameters), fitted on one masked position in ``every`` of every document a round.

    The shares of ``every`` rounds in a row are disjoint and together all positions.
    ``counted`` are the word counts of ``docs``, where at hand.  Null and wordless texts
    teach nothing, equal texts teach as often as they occur, spread over all shards, and
    no text at all leaves the first parameters.  What training gathers is one set of parameters for each shard
    and round, summed by executors in two levels; the driver gets the mean.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    docs = bounded(docs).select("text").where("text is not null")
    words, flat = _most_frequent(word_counts(docs) if counted is None else counted, shape.words), shape.start()
    coded = tokens(docs, words, shape).groupBy("key", "ids").agg(F.count("*").alias("copies"))
    coded = scratch.write(coded, "tokens")
    shards = max(1, -(-(coded.agg(F.sum(F.size("ids") * F.col("copies"))).first()[0] or 0) // SHARD))
    dealt = _copies(coded).select(F.pmod(F.xxhash64("key", "copy"), F.lit(shards)).cast("int").alias("shard"), "key", "copy", "ids").repartition("shard").sortWithinPartitions("shard", "key", "copy")
    for turn in range(rounds):

        def fit(batches, common=flat, turn=turn):
            now, own, memory, done = None, None, None, 0

            def told():
                rows = -(-len(own) // ROW)
                values = np.zeros(rows * ROW, np.float64)
                values[: len(own)] = own.astype(np.float64) * done
                return pa.record_batch([pa.array([now] * rows, pa.int32()), pa.array(range(rows), pa.int32()), pa.array([float(done)] * rows), pa.array(list(values.reshape(rows, ROW)), pa.list_(pa.float64()))], ["part", "row", "weight", "values"])

            for shard, marks, ids, bounds in _pieces(batches, PIECE):
                if shard != now:
                    if done:
                        yield told()
                    now, own, memory, done = shard, common.copy(), np.full_like(common, 1e-3), 0
                at = masked(S.Words(bounds[:-1], bounds[1:], marks, bounds), every, turn)
                at = at[np.argsort(S.mix(at.astype(np.uint64)))]
                around = Around(ids, bounds, shape)
                for k in range(0, len(at), batch):
                    part = at[k : k + batch]
                    train_step(own, memory, around.of(part), ids[part], shape, rate)
                done += len(at)
            if done:
                yield told()

        got = scratch.write(dealt.mapInArrow(fit, "part int, row int, weight double, values array<double>"), f"round-{turn}")
        mean = _average(got, len(flat))
        scratch.drop(f"round-{turn}")
        if mean is None:
            break
        flat = mean
    scratch.drop("tokens")
    return words, flat


def score(docs: DataFrame, words: np.ndarray, flat: np.ndarray, shape: Shape = Shape(), batch: int = 1 << 15, shares: Shares | None = None) -> DataFrame:
    """``doc_id, n_tokens, pll, mean_pll`` for every row of ``docs (doc_id, text)``.

    ``pll`` sums the log-probability of every token of the whole text from both
    sides; with ``shares`` that of every word.  A null or wordless text has 0 tokens,
    ``pll`` 0 and a null mean; null ids and repeated rows stay; other columns are ignored.
    """
    rest = None if shares is None else shares.rest

    def run(batches):
        for b in batches:
            n, total, rare, ends = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), [], np.zeros(b.num_rows + 1, np.int64)
            for low, high, data, offsets in S.chunks(b.column(1)):
                w = S.words(data, offsets, lower=True)
                ids = token_ids(w.hash, words, shape)
                logs, around = np.zeros(len(ids) + 1), Around(ids, w.bounds, shape)
                for k in range(0, len(ids), batch):
                    at = slice(k, min(k + batch, len(ids)))
                    logs[at] = log_probabilities(flat, around.of(at), ids[at], shape)
                if rest is not None:
                    shared = np.flatnonzero(ids >= shape.words)
                    logs[shared] -= rest[ids[shared] - shape.words]
                    rare.append(w.hash[shared])
                    ends[low + 1 : high + 1] = ends[low] + np.searchsorted(shared, w.bounds[1:])
                n[low:high] = np.diff(w.bounds)
                some = np.flatnonzero(n[low:high])
                if len(some):
                    total[low + some] = np.add.reduceat(logs, w.bounds[some])
            found = [b.column(0), pa.array(n), pa.array(total)]
            if rest is not None:
                found.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rare, np.zeros(0, np.uint64)]).view(np.int64))))
            yield pa.record_batch(found, ["doc_id", "n_tokens", "pll", "rare"][: len(found)])

    schema = "doc_id long, n_tokens long, pll double" + ("" if shares is None else ", rare array<long>")
    out = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    if shares is not None:
        out = Scratch(docs.sparkSession, "lm-scores").write(out.withColumn("row", F.monotonically_increasing_id()), "rows")
        share = out.select("row", F.explode("rare").alias("word")).join(shares.counted, "word").groupBy("row").agg(F.sum(F.log1p("n")).alias("share"))
        out = out.drop("rare").join(share, "row", "left").select("doc_id", "n_tokens", (F.col("pll") + F.coalesce("share", F.lit(0.0))).alias("pll"))
    return out.withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))


def train_and_score(docs: DataFrame) -> DataFrame:
    """Scores of all documents under a model of them, of the shape for their size.

    Returns ``doc_id, n_tokens, pll, mean_pll`` for every row as ``score`` does: a null or
    wordless text has 0 tokens, ``pll`` 0 and a null mean, null ids and repeated rows stay,
    rows with one text have one score but for rounding, other columns are ignored.  Words counted alike enter
    the vocabulary in the order of their hashes.  An empty table gives an empty result.
    """
    counted = Scratch(docs.sparkSession, "lm-words").write(word_counts(docs), "counted")
    shape = shape_for(counted.agg(F.sum("n")).first()[0] or 0)
    words, flat = train(docs, shape, counted=counted)
    return score(docs, words, flat, shape, shares=word_shares(counted, words, shape))
