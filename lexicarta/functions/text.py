"""The one normalisation that ingest, search and batch search share."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalise(text: str) -> str:
    """NFKC, then lower case: for the literal of a query."""
    return unicodedata.normalize("NFKC", text).lower()


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """The texts that NFKC changes; null for all others, which stay in the JVM."""

    def changed(text: str | None) -> str | None:
        return None if text is None or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)

    return pa.array((changed(t.as_py()) for t in texts), pa.string())


def normalised(column: str) -> Column:
    """The same for a column, at ingest. Python sees only texts beyond ASCII and returns those it changes; the others pass as null."""
    wide = F.when(F.col(column).rlike("[^\\x00-\\x7F]"), F.col(column))
    return F.lower(F.coalesce(_nfkc(wide), F.col(column)))


def trimmed(column: str) -> Column:
    """Without white space of any kind (blanks, tabs, line ends, byte-order marks) at both ends."""
    return F.regexp_replace(column, r"^[\s\p{Z}\uFEFF]+|[\s\p{Z}\uFEFF]+$", "")


def contains_term(term: str, column: str = "target_norm") -> Column:
    return F.contains(F.col(column), F.lit(normalise(term)))


def word_pattern(term: str) -> str:
    """Whole-token phrase: no letter, digit or underscore touches it on either side."""
    quoted = re.sub(r"([\\.\[\]{}()*+?^$|\-&~#])", r"\\\1", normalise(term))
    return rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])"


def contains_word(term: str, column: str = "target_norm") -> Column:
    return F.col(column).rlike(word_pattern(term))
