"""The pipeline's stages against their rules, on the smallest tables."""

import re

import brute
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(900001, "12 + 34 !!", "en", "x", 10), (900002, None, None, None, None), (None, "no id but a text in plain words", "en", "x", 3)], docs.schema)
    docs = docs.unionByName(extra)
    before = docs.collect()
    kept = P.language_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    lettered = {r["doc_id"] for r in before if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    assert {r["doc_id"] for r in kept.collect()} == lettered
    once = P.near_duplicate_stage(spark, kept, SMALL)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None]
    first = {d for d, _, c in brute.jaccard_join(rows, 5, 80, 100) if d == c}
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == first | {None}
    clean = P.benchmark_stage(spark, once, SMALL)
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    held = set()
    for r in once.collect():
        w = re.findall(r"[^\W_]+", r["text"].lower())
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if any(len(own & g) >= 0.8 * len(g) for g in grams):
            held.add(r["doc_id"])
    assert held and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in once.collect()} - held
    hidden = P.secret_stage(spark, clean, SMALL)
    assert hidden.columns == docs.columns and hidden.count() == clean.count()
    assert all(x[1:4] == (0, 0, 0) for x in brute.secret_scan([(r["doc_id"], r["text"]) for r in hidden.collect()]))
    found = {r["doc_id"] for r in hidden.collect() if "<SECRET>" in r["text"]}
    assert {x[0] for x in brute.secret_scan([(r["doc_id"], r["text"]) for r in clean.collect()]) if sum(x[1:4])} <= found
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = {r["doc_id"]: r["ids"] for r in P.encoding_stage(spark, hidden, SMALL).collect()}
    assert coded == {r["doc_id"]: lib.encode(r["text"], add_bos=True, add_eos=True) for r in hidden.collect()}


def test_run(spark):
    out = P.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered", "ids"] and 100 < out.count() < 200


def awkward(spark):
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words, "en", "t", 2), (3, None, "en", "s", 3), (4, "", None, None, None), (None, words, "en", "s", 4), (None, None, None, None, None), (5, "token=abcdefgh12345 " + "other words here " * 9, "en", "s", 5), (6, "12 34", "en", "s", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("clash")).withColumn("component_id", F.lit("clash")).withColumn("gone", F.lit(None).cast("string"))


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_on_awkward_tables(spark, name, stage):
    docs = awkward(spark)
    out, none = stage(spark, docs, SMALL), stage(spark, docs.limit(0), SMALL)
    assert none.count() == 0
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    if name == "encoding":
        assert ids == sorted((r["doc_id"] for r in docs.collect()), key=str)
        return
    assert out.columns == docs.columns == none.columns and out.dtypes == docs.dtypes
    assert ids == {"language": [1, 1, 2, 5, None, None], "near_duplicates": [1, 1, 3, 4, 5, 6, None, None], "benchmark": [1, 1, 2, 3, 4, 5, 6, None, None], "secrets": [1, 1, 2, 3, 4, 5, 6, None, None]}[name]
    if name == "secrets":
        got = {r["doc_id"]: r for r in out.collect()}
        assert got[3]["text"] is None and got[5]["text"].startswith("<SECRET> other") and got[5]["n_chars"] == len(got[5]["text"]) and got[2]["n_chars"] == 2 and got[2]["row"] == "clash"
