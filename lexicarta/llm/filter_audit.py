"""Operator 12: how filters interact, by wide packed counters.

For every order of the filters and every step of it a document has an outcome:
kept, removed here, removed earlier.  Its *mask* (the filters it fails, and its two
labels) decides all of them at once, so a mask maps to one big integer with a field
for each outcome of each step.  Such integers are summed, and the sum's fields are
the counts.  A field is as wide as the part's row count is long: no count exceeds
that, so no carry reaches the next field.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bounded

OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Orders grow with the factorial: at 6 filters there are 4,320 steps, at 7 already 35,280.
MOST_FILTERS = 6


class Steps:
    """All orders of the letters, and for each mask the outcomes of every step.

    In a mask, bit i stands for filter i; the next two bits for the labels good and toxic.
    """

    def __init__(self, letters: str):
        if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) != len(letters):
            raise ValueError(f"one to {MOST_FILTERS} different letters are needed")
        k = len(letters)
        self.orders = ["".join(o) for o in itertools.permutations(letters)]
        own = np.array([[1 << letters.index(x) for x in o] for o in self.orders])
        before = np.cumsum(own, 1) - own
        mask = np.arange(1 << (k + 2))[:, None, None]
        fails, earlier = (mask & own) != 0, (mask & before) != 0
        removed = fails & ~earlier
        only = (mask & ((1 << k) - 1)) == own
        good, toxic = (mask >> k) & 1 == 1, (mask >> (k + 1)) & 1 == 1
        held = np.stack([~fails & ~earlier, removed, fails & earlier, only, removed & good, removed & toxic], -1)
        self.held = held.reshape(len(mask), -1)
        self.filter = np.array([[letters.index(x) for x in o] for o in self.orders]).ravel()
        self.k = k

    def integer(self, mask: int, width: int) -> int:
        """The mask's outcomes as fields of ``width`` bits: one or zero each."""
        bits = np.zeros((self.held.shape[1], width), np.uint8)
        bits[:, 0] = self.held[mask]
        return int.from_bytes(np.packbits(bits.ravel(), bitorder="little").tobytes(), "little")

    def unpack(self, total: int, width: int) -> np.ndarray:
        """Steps by outcomes."""
        fields = self.held.shape[1]
        raw = np.frombuffer(total.to_bytes(-(-fields * width // 8), "little"), np.uint8)
        bits = np.unpackbits(raw, count=fields * width, bitorder="little").reshape(fields, width)
        return (bits.astype(np.int64) << np.arange(width)).sum(1).reshape(-1, len(OUTCOMES))


def filter_audit(docs: DataFrame, filters: dict[str, Column], twin: str | None = None, labels: DataFrame | None = None, part: str = "lang") -> DataFrame:
    """Counts of every step of every order of ``filters`` for each value of ``part``.

    ``docs`` needs ``doc_id``, ``text`` and ``part``; ``filters`` names each failure condition,
    over ``docs``, by a letter.  ``twin`` is the letter of one more filter: the text is that of
    any smaller ``doc_id`` in the whole table, removed or not.  ``labels (doc_id, quality,
    toxic)`` marks good (quality 1) and toxic (toxic 1) documents; an id labelled twice is
    marked if one label says so.

    Returns ``part, filter_order, step`` and long counts within the part: ``kept``,
    ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``,
    the filter's removed summed over all orders.  A null part is the empty string, a null
    text the empty text, a null condition no failure.  Rows with a null id have no smaller
    id and are nobody's; rows that repeat an id are counted each and are not each other's
    twins.  Other columns are ignored; an empty table gives an empty result.

    Texts meet by SHA-256.  Rows are aggregated by id, then by text, before they meet, so
    copies, however many, are a few rows; a part comes to one task as one row a mask.
    """
    letters = "".join(sorted([*filters, *([twin] if twin else [])]))
    steps = Steps(letters)
    bit = {x: 1 << i for i, x in enumerate(letters)}
    fails = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
    text = F.coalesce(docs["text"], F.lit(""))
    mask = sum((fails(c, bit[x]) for x, c in sorted(filters.items())), F.lit(0)).alias("mask")
    digest = F.unhex(F.sha2(text.cast("binary"), 256)) if twin else F.lit(None).cast("binary")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), digest.alias("digest"), mask)
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    if labels is None:
        marked = rows.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
        flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
        marked = rows.join(flags, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    marked = marked.withColumn("mask", F.col("mask") + F.col("good") * (1 << steps.k) + F.col("toxic") * (2 << steps.k))
    if twin:
        lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
        named = F.col("doc_id").isNotNull().alias("named")
        texts = marked.groupBy("digest", "part", "mask", named).agg(F.sum("n").alias("n"), lowest.alias("low"))
        least = F.min("low.doc_id").over(Window.partitionBy("digest"))  # a text has one row for each part and label
        first = F.when(~F.col("named"), F.col("n")).when(F.col("low.doc_id") == least, F.col("low.n")).otherwise(F.lit(0))
        split = texts.select("part", "mask", "n", first.alias("first"))
        marked = split.select("part", F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + bit[twin]).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("e")).select("part", "e.*")
    counts = marked.groupBy("part", "mask").agg(F.sum("n").alias("n")).where("n > 0")

    def audit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        width = max(1, int(rows["n"].sum()).bit_length())
        total = sum(n * steps.integer(mask, width) for mask, n in zip(rows["mask"].tolist(), rows["n"].tolist(), strict=True))
        table = steps.unpack(total, width)
        k = steps.k
        shapley = np.array([table[steps.filter == f, 1].sum() for f in range(k)])
        out = {"part": key[0], "filter_order": np.repeat(steps.orders, k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(steps.orders))}
        return pd.DataFrame(out | dict(zip(OUTCOMES, table.T, strict=True)) | {"shapley": shapley[steps.filter]})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*OUTCOMES, "shapley"))
    return bounded(counts).groupBy("part").applyInPandas(audit, schema)


def quality_filters(docs: DataFrame) -> dict[str, Column]:
    """Failure conditions of four text filters over ``docs.text`` (null: empty).

    A: under 100 words.  B: fewer than 80 % of the words distinct.  C: more than 10 % of the
    code points in A-Z.  D: holds any of ``#$%&*|``.  Words are ``[^\\x20\\x09-\\x0D]+``.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * F.size(words),
        "C": F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
