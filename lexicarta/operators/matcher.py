"""Many terms in one pass over the texts: an automaton with failure links.

The distinct terms of a table of requests become one automaton, which every task
builds for itself and runs over each normalised text once: a character costs one
step however many terms there are, and only the terms that occur in a text, and that
its own release was asked for, leave the task.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RELEASE
from ..sources.stage import bounded

#: Characters of the terms of one automaton (some 50 bytes each in a task); more terms take another pass.
SHARD_CHARS = 1 << 20
#: Characters of all terms that may go through the driver to the tasks.
MOST_CHARS = 1 << 25


def collect(terms: DataFrame, most: int | None = MOST_CHARS, limit: int = SHARD_CHARS) -> list[dict[str, list[tuple]]] | None:
    """Terms ``(platform, version, q)`` with the releases that ask for them, in shards of about ``limit`` characters.

    None if they have more than ``most`` characters in all; reading stops there.
    """
    asked = terms.where("length(q) > 0").groupBy("q").agg(F.collect_set(F.struct(*RELEASE)).alias("releases"))
    out, size, total = [{}], 0, 0
    for row in asked.toLocalIterator():
        n = len(row["q"])
        total += n + 16
        if most is not None and total > most:
            return None
        if size and size + n > limit:
            out.append({})
            size = 0
        out[-1][row["q"]] = [tuple(r) for r in row["releases"]]
        size += n
    return [s for s in out if s]


def find_terms(texts: DataFrame, shards: list[dict[str, list[tuple]]], keep: list[str], mode: str = "contains") -> DataFrame:
    """``platform, version, *keep, q`` for each row of ``texts`` and each of its release's terms that its text contains.

    With ``mode="word"`` a term counts where no letter, digit or underscore touches it on
    either side (``text.word_pattern``).
    ``texts`` has ``platform, version, target_norm`` and the columns ``keep``; ``shards`` are the
    normalised terms as ``collect`` returns them, one pass each.  A row comes once for each
    different term.  Empty and null terms and null texts meet nothing.
    """
    if mode not in ("contains", "word"):
        raise ValueError(f"no such mode: {mode}")
    rows = bounded(texts.where("target_norm is not null")).select(*RELEASE, *keep, "target_norm")
    kept = rows.drop("target_norm")
    schema = kept.withColumn("found", F.array().cast("array<string>")).schema
    found = None
    for shard in shards:
        one = rows.mapInArrow(_scanner(shard, len(keep) + len(RELEASE), mode == "word"), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return kept.withColumn("q", F.lit(None).cast("string")).where(F.lit(False))
    return found.select(*RELEASE, *keep, F.explode("found").alias("q"))


def _touches(text: str, at: int) -> bool:
    """Whether a letter, digit or underscore stands at the place."""
    return 0 <= at < len(text) and (text[at] == "_" or unicodedata.category(text[at])[0] in "LN")


def _whole_words(automaton, names: list[str], text: str) -> set[int]:
    met = set()
    for end, i in automaton.iter(text):
        if i not in met and not _touches(text, end + 1) and not _touches(text, end - len(names[i])):
            met.add(i)
    return met


def _scanner(shard: dict[str, list[tuple]], width: int, whole: bool):
    """Function over batches: columns before ``width`` are kept (the first two the release), the next one is the text."""

    def scan(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        names, of_release = list(shard), {}
        for k, name in enumerate(names):
            automaton.add_word(name, k)
            for release in shard[name]:
                of_release.setdefault(release, set()).add(k)
        automaton.make_automaton()
        everywhere = {r: len(own) == len(names) for r, own in of_release.items()}
        for batch in batches:
            rows, found = [], []
            releases = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            texts = batch.column(width)
            for k, release in enumerate(releases):
                own = of_release.get(release)
                if own is None:
                    continue
                text = texts[k].as_py()
                met = _whole_words(automaton, names, text) if whole else {i for _, i in automaton.iter(text)}
                if not everywhere[release]:
                    met &= own
                if met:
                    rows.append(k)
                    found.append([names[i] for i in met])
            if rows:
                at = pa.array(rows, pa.int64())
                columns = [batch.column(i).take(at) for i in range(width)]
                yield pa.record_batch([*columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names[:width], "found"])

    return scan
