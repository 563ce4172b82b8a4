"""Operator 9: secret scans with DataFrame functions only.

Fixed patterns give the base spans.  Two character Markov models, of random
strings and of ordinary identifiers, add spans: a long token is a secret when the
first explains its characters better than the second by a clear log-likelihood
ratio.  Both are counted from labelled samples of the corpus itself: values the
base patterns caught, and words of documents they left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
#: A maximal run of token characters; long ones are weighed by the models.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Any of the above, found once: most documents need no further work.
BASE_HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|(?<![0-9a-f])[0-9a-f]{24}"
HINT = BASE_HINT + r"|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CLASSES = len(ALPHABET) + 1
#: Code points that a token can hold lie in this range; it indexes the table of ratios.
FIRST_CODE, CODES = ord("+"), ord("z") - ord("+") + 1
#: Block of the two-level prefix folds, and characters of a piece of a text.
BLOCK, PIECE = 64, 4096
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


@dataclass
class MarkovModel:
    """Log-likelihood ratio of each transition, ``CLASSES`` squared numbers whatever the corpus."""

    ratio: list[float]

    def literal(self) -> Column:
        """The ratios by code points: that of (a, b) at ``(a - FIRST_CODE) * CODES + b - FIRST_CODE + 1``."""
        kinds = [_class(chr(FIRST_CODE + k)) for k in range(CODES)]
        return F.split(F.lit(",".join(f"{self.ratio[a * CLASSES + b]:.4f}" for a in kinds for b in kinds)), ",").cast("array<double>")


def _class(c: str) -> int:
    return ALPHABET.find(c) + 1


def _transitions(tokens: DataFrame) -> dict[str, int]:
    """Counts of printable character pairs in the column ``token``: at most 94 squared rows."""
    pairs = tokens.where(F.length("token") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    return dict(pairs.where(F.col("pair").rlike("^[!-~]{2}$")).groupBy("pair").count().collect())


def train(docs: DataFrame, sample: int = 2000) -> MarkovModel:
    """Fit both chains on at most ``sample`` documents each, with one added to every count.

    The documents of either class are the first by a hash of their id.  One pass marks
    all documents, one gathers the texts of the two samples, and both chains are
    counted on what was gathered.  Null ids and texts are left out; an empty class
    leaves its chain uniform.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    hint = F.col("text").rlike(BASE_HINT)
    marked = scratch.write(docs.select("doc_id", hint.alias("caught")), "marked")
    first = lambda caught: marked.where(F.col("caught") == caught).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = first(True).unionByName(first(False))
    # at most twice ``sample`` ids; a row counts in the class that its own text belongs to
    chosen = scratch.write(docs.join(F.broadcast(ids), "doc_id").where(hint == F.col("caught")), "sample")
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    secret = chosen.where("caught").select(F.explode(values).alias("token")).where((F.length("token") >= 16) & F.col("token").rlike("[0-9]"))
    plain = chosen.where("not caught").select(F.explode(F.split("text", r"[^A-Za-z0-9_]+")).alias("token"))
    chains = []
    for counts in (_transitions(secret), _transitions(plain)):
        table = [[1.0] * CLASSES for _ in range(CLASSES)]
        for pair, n in counts.items():
            table[_class(pair[0])][_class(pair[1])] += n
        chains.append([[math.log(x / sum(row)) for x in row] for row in table])
    scratch.drop("marked")
    scratch.drop("sample")
    return MarkovModel([a - b for x, y in zip(*chains, strict=True) for a, b in zip(x, y, strict=True)])


def _hits(flag: Column, pattern: str, group: int = 0) -> Column:
    return F.when(flag, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row.

    An expression that a lambda names is otherwise put in its place and computed again
    for each element; generated columns are not.
    """
    packed = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return df.select("*", packed.alias("held")).select(*df.columns, *(F.col(f"held.{name}").alias(name) for name in columns))


def _running(df: DataFrame, columns: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """Add, for each new name, the running fold (from 0) of an integer array.

    In two levels, folds of blocks and then within a block, so that many values in one
    row cost little more than few.
    """
    own = df.columns
    some = lambda c, x: F.when(F.size(c) > 0, x).otherwise(F.array().cast("array<int>"))

    def befores(c, fold):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(c, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), fold))
        return some(c, F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(fold(F.element_at(a, -1), x)))))

    def value(c, before, fold):
        def one(_, i):
            b = F.floor(i / BLOCK).cast("int")
            return F.aggregate(F.slice(c, b * BLOCK + 1, i - b * BLOCK + 1), F.element_at(before, b + 1), fold)

        return some(c, F.transform(c, one))

    df = _held(df, **{f"{name}_raw": c for name, (c, _) in columns.items()})
    df = _held(df, **{f"{name}_before": befores(F.col(f"{name}_raw"), fold) for name, (_, fold) in columns.items()})
    return df.select(*own, *(value(F.col(f"{name}_raw"), F.col(f"{name}_before"), fold).alias(name) for name, (_, fold) in columns.items()))


def _add(a: Column, x: Column) -> Column:
    return a + x


def _most(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def scan(docs: DataFrame, model: MarkovModel | None = None, per_char: float = 0.5, least: float = 12.0, carry: bool = False) -> DataFrame:
    """All secret spans of every whole text, as ``doc_id, text, base, added``.

    ``base`` and ``added`` are arrays of ``(start, rank, kind, end)`` in code points,
    end exclusive; base kinds are ``assign``, ``access``, ``hex``, added ones
    ``markov``.  A token counts as added when the ratio is at least ``per_char`` on
    average and ``least`` in total, it has a digit, and it meets no base span.  A null
    text has no spans; null ids and repeated rows stay; other columns are ignored,
    or with ``carry`` returned whole in the struct ``row``; an empty table gives an
    empty result.
    """
    own = ["doc_id", "text", *["row"] * carry]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.struct("*").alias("row")] * carry)
    rows = rows.withColumn("flag", F.col("text").rlike(HINT if model else BASE_HINT))
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | ({"markov": TOKEN} if model else {})
    rows = rows.select(*own, *(_hits(F.col("flag"), p).alias(f"{k}_hits") for k, p in kinds.items()), _hits(F.col("flag"), ASSIGN, 2).alias("values"))
    some = lambda k, c: F.when(F.size(f"{k}_hits") > 0, c).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", *(some(k, F.transform(F.split("text", p, -1), F.length)).alias(f"{k}_gaps") for k, p in kinds.items()))
    # a hit ends where all gaps and hits up to it end
    lens = lambda k: some(k, F.zip_with(F.slice(f"{k}_gaps", F.lit(1), F.size(f"{k}_hits")), f"{k}_hits", lambda g, h: g + F.length(h)))
    rows = _running(rows, {f"{k}_ends": (lens(k), _add) for k in kinds})

    def spans(rank: int, kind: str, wide_enough) -> Column:
        one = lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"))
        return F.filter(F.zip_with(f"{kind}_hits", f"{kind}_ends", one), wide_enough)

    base = F.concat(
        spans(0, "assign", lambda s, i: F.length(F.element_at("values", i + 1)) >= 6),
        spans(1, "access", lambda s: s["end"] - s["start"] >= 20),
        spans(2, "hex", lambda s: s["end"] - s["start"] >= 24),
    )
    rows = rows.select(*own, F.sort_array(base).alias("base"), *["markov_hits", "markov_ends"] * bool(model))
    if model is None:
        return rows.select(*own, "base", F.array().cast(f"array<{SPAN}>").alias("added"))
    token = lambda h, e: F.struct((e - F.length(h)).alias("start"), F.lit(3).alias("rank"), F.lit("markov").alias("kind"), e.alias("end"), h.alias("token"))
    rows = rows.select(*own, "base", F.filter(F.zip_with("markov_hits", "markov_ends", token), lambda s: s["token"].rlike("[0-9]")).alias("tokens"))
    # base spans that begin before a token's end are the first ones; it is free if none of those reaches beyond its start
    point = lambda at, is_base: F.struct(at.alias("at"), F.lit(is_base).alias("is_base"))
    both = F.sort_array(F.concat(F.transform("base", lambda s: point(s["start"], 1)), F.transform("tokens", lambda s: point(s["end"], 0))))
    any_ = lambda x: F.when(F.size("tokens") > 0, x).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", any_(both.getField("is_base")).alias("marks"))
    rows = _running(rows, {"before": (F.col("marks"), _add), "reach": (any_(F.col("base.end")), _most)})
    ahead = F.transform(F.filter(F.arrays_zip("marks", "before"), lambda x: x["marks"] == 0), lambda x: x["before"])
    rows = _held(rows.select(*own, "base", "tokens", "reach", ahead.alias("ahead")), reach_=F.col("reach"), ahead_=F.col("ahead"))
    free = lambda s, n: (n == 0) | (F.element_at("reach_", F.greatest(n, F.lit(1))) <= s["start"])
    rows = rows.select(*own, "base", F.filter("tokens", lambda s, i: F.coalesce(free(s, F.element_at("ahead_", i + 1)), F.lit(True))).alias("tokens"))
    table = model.literal()
    codes = lambda t: F.transform(F.split(t, ""), lambda c: F.ascii(c) - FIRST_CODE)
    step = lambda a, b: F.when(b.isNotNull(), F.element_at(table, a * CODES + b + 1)).otherwise(0.0)
    pairs = lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), step)
    coded = F.transform("tokens", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), codes(s["token"]).alias("codes")))
    rows = rows.select(*own, "base", coded.alias("coded"))
    weighed = F.transform("coded", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.aggregate(pairs(s["codes"]), F.lit(0.0), _add).alias("ratio")))
    kept = F.filter(weighed, lambda s: (s["ratio"] >= least) & (s["ratio"] >= per_char * (s["end"] - s["start"] - 1)))
    added = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select(*own, "base", added.alias("added"))


def named(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``text`` with every span (overlaps merged) replaced by ``mark``; takes and otherwise keeps what ``scan`` returns.

    Work follows the length of a text and its number of spans: a span begins a new cut
    if no earlier one reaches it, and gaps are taken from pieces of the text.
    """
    kept = scanned.columns
    none = F.array().cast("array<int>")
    rows = _held(scanned, ordered=F.sort_array(F.concat("base", "added")))
    rows = _running(rows, {"furthest": (F.col("ordered.end"), _most)})
    rows = _held(rows, reach=F.col("furthest"))
    first = F.filter(F.sequence(F.lit(1), F.size("ordered")), lambda i: (i == 1) | (F.element_at("ordered", i)["start"] > F.element_at("reach", F.greatest(i - 1, F.lit(1)))))
    rows = rows.select("*", F.when(F.size("ordered") > 0, first).otherwise(none).alias("heads"))
    # the gap before cut k runs from the end of the one before; the last gap is the tail
    to = F.concat(F.transform("heads", lambda i: F.element_at("ordered", i)["start"]), F.array(F.length("text")))
    since = F.concat(F.array(F.lit(0)), F.transform(F.slice("heads", F.lit(2), F.size("heads")), lambda i: F.element_at("reach", i - 1)), F.array(F.element_at("reach", -1)))
    some = lambda x, other: F.when(F.size("ordered") > 0, x).otherwise(other)
    rows = _held(rows, to=some(to, none), since=some(since, none), pieces=some(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), F.array().cast("array<string>")))

    def gap(a: Column, b: Column) -> Column:
        low, high = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        part = lambda j: F.substring(F.element_at("pieces", j + 1), F.greatest(a - j * PIECE, F.lit(0)) + 1, F.least(b, (j + 1) * PIECE) - F.greatest(a, j * PIECE))
        return F.when(b > a, F.array_join(F.transform(F.sequence(low, high), part), "")).otherwise("")

    return rows.withColumn("text", some(F.array_join(F.zip_with("since", "to", gap), mark), F.col("text"))).select(*kept)
