"""The whole of LM scoring, from counting to shares, on awkward tables."""

import math

from pyspark.sql import functions as F

from lexicarta.llm import lm_scoring

SCHEMA = "doc_id long, text string, lang string"


def test_every_row_has_its_defined_score(spark):
    plain = "the cat sat on the mat and the dog lay by the door of the house " * 4
    rows = [(1, plain), (2, plain), (2, plain), (3, None), (4, ""), (5, " \t\n"), (None, plain), (6, "zwx qqv"), (7, plain + "rare " + plain), (8, "word " * 5000)]
    docs = spark.createDataFrame([(a, b, "en") for a, b in rows], SCHEMA).withColumns({c: F.lit("clash") for c in ("n", "word", "row", "share", "rare", "pll")})
    out = lm_scoring.train_and_score(docs).collect()
    assert out[0].asDict().keys() == {"doc_id", "n_tokens", "pll", "mean_pll"}
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == sorted((a or 0, len((b or "").split())) for a, b in rows)
    for r in out:
        if r.n_tokens:
            assert math.isfinite(r.pll) and r.pll < 0 and math.isclose(r.mean_pll, r.pll / r.n_tokens)
        else:
            assert r.pll == 0 and r.mean_pll is None
    same = [r.pll for r in out if r.doc_id in (1, 2, None)]
    assert len(same) == 4 and max(same) - min(same) < 1e-4  # one text, one score but for rounding


def test_an_empty_table_has_no_scores(spark):
    assert lm_scoring.train_and_score(spark.createDataFrame([], SCHEMA)).count() == 0
