"""Operators against plain versions on a small table with every awkward case."""

import hashlib
import inspect
import math
import random
import re

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicarta.llm import components as CC
from lexicarta.llm import decontaminate, embedding_dedup, jaccard_join, language_id, lm_scoring, pieces, secret_scan, spans, substring_dedup, suffix_dedup, token_counts
from lexicarta.llm.queries import ORACLES, QUERIES
from lexicarta.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def make_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(70))
    base = [word() for _ in range(200)]
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (6, "One two"), (7, "a " * 400), (8, "a " * 90 + passage),
        (9, passage + " end"), (10, "start " + passage), (11, "\n".join([passage] * 3)), (12, "日本語 😀 ñandú " * 30), (13, "x" * 1500), (14, "xy" * 900),
        (15, " ".join(word() for _ in range(60000))), (16, "12 345 67 " * 20), (17, "a b c d"), (18, " ".join(base)), (19, " ".join(base)),
    ]
    for k in range(20, 60):  # near copies of many degrees
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = word() + "q"
        rows.append((k, " ".join(own)))
    for k in range(60, 80):
        rows.append((k, " ".join(word() for _ in range(rng.randint(1, 120))) + rng.choice(["", passage[:200], " " + passage])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(a, b, "en", None, None) for a, b in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("anchor", "span", "n", "token", "rep", "component_id", "flag", "window", "e", "row", "marks")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_window_spans_cover_every_window_once():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 3, 500).astype(np.uint64)
    bounds = np.array([0, 3, 3, 200, 500])
    s = spans.spans(spans.mix(items), bounds, 12, 4)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(s.first, s.last, strict=True)])
    assert sorted(starts.tolist()) == [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(a, b - 11)]
    assert (s.last - s.first).max() < 12 - 4 + 1


def test_word_hashes_do_not_depend_on_their_place():
    texts = pa.array(["ab cd", None, "", "cd  ab\tab", " x" * 5])
    got = [(spans.words(d, o).hash.tolist(), spans.words(d, o).bounds.tolist()) for _, _, d, o in spans.chunks(texts)]
    (h, b), = got
    assert b == [0, 2, 2, 2, 5, 10] and h[0] == h[3] == h[4] and h[1] == h[2] and h[0] != h[1]


@pytest.mark.parametrize("width,gram,batches", [(50, 20, 2), (7, 3, 3), (50, 20, 1), (1, 1, 2)])
def test_substring_dedup(docs, rows, width, gram, batches):
    got = collected(substring_dedup.substring_dedup(docs, width, gram, batches), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(rows, width)


def test_substring_index_is_incremental(spark, docs, rows):
    index = substring_dedup.FingerprintIndex(spark, 10, 4, most_runs=2)
    seen = unsure = None
    for low, high in ((0, 12), (12, 40), (40, 90)):
        a, b = index.append(index.fingerprints(docs.where(F.col("doc_id").between(low + 1, high))))
        seen, unsure = (a, b) if seen is None else (seen.union(a), unsure.union(b))
    assert len(index.runs) == 1  # three runs were one too many
    got = collected(index.apply(docs, seen, index.verify(docs, unsure)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(rows, 10)


def test_substring_index_keeps_runs_by_size(spark, docs, rows):
    index = substring_dedup.FingerprintIndex(spark, 10, 4, ratio=2)
    seen = unsure = None
    counts = []
    for low, high in ((0, 15), (15, 40), (40, 60), (60, 70), (70, 75), (75, 76)):
        a, b = index.append(index.fingerprints(docs.where(F.col("doc_id").between(low + 1, high))))
        seen, unsure = (a, b) if seen is None else (seen.union(a), unsure.union(b))
        counts.append(len(index.runs))
        sizes = [n for _, n in index.runs]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert max(counts) > 1
    part = [r for r in rows if r[0] <= 76]
    got = collected(index.apply(docs.where("doc_id <= 76"), seen, index.verify(docs.where("doc_id <= 76"), unsure)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(part, 10)
    with pytest.raises(ValueError, match="ascending"):
        index.append(index.fingerprints(docs.where("doc_id = 60")))
    plan = spark.table(index.runs[0][0]).join(spark.table(index.runs[-1][0]).select("anchor").distinct(), "anchor", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    index.close()
    assert index.runs == []


@pytest.mark.parametrize("length,gram,group", [(400, 200, 1024), (30, 12, 2), (5, 2, 1024)])
def test_suffix_dedup(docs, rows, length, gram, group):
    short = [r for r in rows if len(r[1] or "") < 20000 or length > 100]
    df = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 20000) if length <= 100 else docs
    got = collected(suffix_dedup.suffix_dedup(df, length, gram, 1 << 14, group), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(short, length)


def test_interval_expansion_against_counting():
    rng = np.random.default_rng(2)
    for _ in range(60):
        length = int(rng.integers(1, 25))
        base = rng.integers(1, 4, size=60)
        parts = [np.append(np.concatenate([rng.integers(1, 5, int(rng.integers(0, 40))), base[int(rng.integers(0, 30)) :][: int(rng.integers(0, 40))]]), 0) for _ in range(int(rng.integers(1, 7)))]
        s = np.concatenate(parts).astype(np.int16)
        ends = np.flatnonzero(s == 0)
        keys = {i: s[i : i + length].tobytes() for i in range(len(s)) if ends[np.searchsorted(ends, i)] - i >= length}
        seen = list(keys.values())
        want = [i in keys and seen.count(keys[i]) > 1 for i in range(len(s))]
        assert suffix_dedup.repeated_starts(s, length).tolist() == want


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows}
    for ranks in (None, path("byte_bpe_50k.tiktoken")):
        got = token_counts.token_counts(docs, path("byte_bpe_50k.json"), 10, ranks, public_tokenizers.PATTERN)
        assert collected(got, "doc_id", "n_bytes", "n_tokens") == want
        assert all(r[1] == (r[0] > 10) for r in got.select("n_tokens", "over_limit").collect())


def test_token_counts_of_long_blanks(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_counts.token_counts(df, path("byte_bpe_50k.json"), 10, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert collected(got, "doc_id", "n_tokens") == {(k, len(tok.encode(t, add_special_tokens=False).ids)) for k, t in enumerate(texts)}


def test_token_pieces_are_safe(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    text = ("It's we'll  two   blanks\n\n and 3.14 words<|endoftext|>here é ß ﷺ 日本  x  y " * 40) + "tail "
    cut = token_counts.pieces(text, 50)
    assert len(cut) > 10 and "".join(cut) == text and sum(map(count, cut)) == count(text)
    rng = random.Random(3)
    odd = ["".join(rng.choice("aZ '\n\t0.é ßΩ日 ​𝒳<|endoftext|>") for _ in range(200)) for _ in range(30)] + ["<|endoftext|>" * 3, "a<|endoftext|> b"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = dict(token_counts.token_counts(df, path("byte_bpe_50k.json"), 10, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens").collect())
    assert got == {k: count(t) for k, t in enumerate(odd)}


def test_pieces_match_the_library(docs, rows):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r["doc_id"]: r for r in pieces.encode_pieces(docs, model).collect()}
    digests = {r["doc_id"]: r for r in pieces.encode_pieces(docs, model, output="digests").collect()}
    for doc, text in rows:
        text = text or ""
        ids = lib.encode(text, add_bos=True, add_eos=True)
        r, d, raw = got[doc], digests[doc], text.encode()
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids)
        assert d["n_tokens"] == len(ids) and d["decoded_sha256"] == brute.sha(lib.decode(ids)) and d["n_covered"] == len(raw)
        assert d["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert b"".join(raw[a:b] for a, b in zip(r["starts"], r["ends"], strict=True)) == raw


def test_character_map_normaliser():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    for rule in ("nmt_nfkc", "nmt_nfkc_cf", "nfkc"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = sentencepiece_model_pb2.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
        c = pieces.Codec.__new__(pieces.Codec)
        c.map, c.dummy, c.squeeze, c.escape = pieces.CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        for text in ("ＷＯＲＬＤ①ｶﾞ ﬁ", "ﷺ a​b", "é  \t x", "  lead and trail  ", "", "plain", "Ａ　Ｂ", "ÄÖ ẞ", " \t "):
            normal, source = c.normalise(text.encode())
            assert normal.decode() == lib.normalize(text), (rule, text)
            assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text.encode())


def test_language_id(spark, docs):
    all_docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(all_docs.where(~held), per_language=60, rounds=150)
    assert model.languages == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    out = language_id.predict(all_docs.where(held), model).join(all_docs.select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right > 0.95 and n > 20
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert {got[k]["lang_pred"] for k in (1, 2, 3, 16)} == {"und"} and got[1]["score"] == 0 and got[1]["ambiguous"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 20])
def test_codewords_tell_languages_apart(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    far = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert n == 1 or min(far) >= (1 if n < 3 else 2)


def test_jaccard_join(docs, rows):
    for k, num, den, rare in ((4, 85, 100, 8), (5, 80, 100, 2), (1, 60, 100, 3), (2, 1, 1, 8)):
        small = [r for r in rows if r[0] != 15]
        got = collected(jaccard_join.jaccard_join(docs.where("doc_id <> 15"), k, num, den, rare), "doc_id", "n_shingles", "component_id")
        assert got == brute.jaccard_join(small, k, num, den), (k, num)


def test_jaccard_prefix_bounds():
    t = jaccard_join.Threshold(85, 100)
    for n in range(1, 400):
        assert t.shared(t.least(n)) <= max(2, t.least(n)) and t.prefix(n) <= n
        for m in range(t.least(n), n + 1):  # a similar smaller set meets in a class, with enough shared shingles
            assert size_ok(t, m, n)


def size_ok(t, m, n):
    if t.alone(n) or t.alone(m):
        return True
    c = jaccard_join.size_class(m)
    return c in t.classes(m) and c in t.classes(n) and t.groups(c) + 1 <= t.shared(m)


def test_decontaminate(spark):
    items = [
        (1, "If a train leaves Boston at 60 mph and a car leaves Dallas at 45 mph when do they meet on the road"),
        (2, "Short one here"), (3, None), (4, ""), (5, "12 34"),
    ]
    docs = [
        (1, "Preface words. " + items[0][1] + ". More text follows"),
        (2, "Intro: If a train leaves Denver at 75 mph and a car leaves Austin at 30 mph when do they meet on the road, said who"),
        (3, items[0][1].upper()), (4, None), (5, ""), (6, "nothing of the kind is written here at all, not a word of it"),
        (7, "If a train leaves Boston at 60 mph and then the driver of the car sleeps all day"), (8, "SHORT one, here"), (10, "say short one here"),
        (9, "if a train leaves boston at 60 mph and a car leaves dallas at 45 mph when do they meet on the road"),
    ]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    d = spark.createDataFrame(docs + docs[:1], "doc_id long, text string").withColumn("window", F.lit("clash"))
    want = {(1, 1, False), (2, 1, True), (3, 1, False), (8, 2, False), (9, 1, False)}
    for most in (2_000_000, 1):  # with the filter in the tasks, and by the join alone
        got = decontaminate.decontaminate(d, b, most_known=most)
        assert collected(got, "doc_id", "item_id", "reparameterised") == want
    assert decontaminate.decontaminate(d, b.limit(0)).count() == 0 and decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_decontaminate_needs_consistent_slots(spark):
    item = "Add 12 apples to 12 pears and take 7 plums from the box then count what is left in it"
    same = item.replace("12", "90").replace("7", "8")
    mixed = item.replace("12 pears", "44 pears")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string"), b, share=0.95)
    assert collected(got, "doc_id", "reparameterised") == {(1, True)}


def test_decontaminate_judges_copies_apart(spark):
    item = "If a train leaves Boston at 60 mph and a car leaves Dallas at 45 mph when do they meet on the road"
    copy = lambda a, m, b, n: item.replace("Boston", a).replace("60", m).replace("Dallas", b).replace("45", n)
    two = [copy("Denver", "75", "Austin", "90"), copy("Miami", "50", "Boise", "30")]
    long_name = copy("New York City", "75", "Salt Lake City", "90")
    torn = "If a train leaves Boston at 60 mph then a Car leaves Austin at 30 mph. The train leaves Dallas at 45 mph, who knows when do they meet"
    docs = [
        (1, ". ".join(two)), (2, f"{item}. {two[0]}. {two[1]}"), (3, f"{two[0]}. {two[1]}. {item}"), (4, f"{two[0]} {'and so on ' * 300}. {two[1]}"),
        (5, f"{long_name}. {two[1]}"), (6, ". ".join(copy(f"P{'abcdefgh'[k]}x", str(k), f"Q{'abcdefgh'[k]}y", str(k + 20)) for k in range(8))), (7, torn), (8, f"{torn}. {torn}"),
    ]
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (2_000_000, 1):
        got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), b, most_known=most)
        assert collected(got, "doc_id", "reparameterised") == {(1, True), (2, False), (3, False), (4, True), (5, True), (6, True)}


def awkward_questions():
    rng = random.Random(21)
    names, units = ["Ann", "Bob", "Éva", "Paris", "New", "Xu"], ["kg", "mph", "days", "Km", "apples"]
    common = "if the a train leaves box from with how many does it take and then when what is left of".split()
    item = lambda: " ".join(rng.choice([rng.choice(common), rng.choice(common), rng.choice(names), f"{rng.choice(['3', '12', '4.5', '1,000'])}{rng.choice([' ', ''])}{rng.choice(units)}", str(rng.randint(1, 9))]) for _ in range(rng.randint(3, 26)))
    items = [(k, item()) for k in range(25)] + [(90, None), (91, ""), (92, "12 34"), (93, "word"), (None, "no id at all here to be found")]
    docs = [(1000, None), (1001, ""), (1002, "12 34"), (1003, "Word")]
    swap = lambda t: t.replace("12", rng.choice(["12", "77"])).replace("Ann", rng.choice(["Ann", "Zoe", "Bob"])).replace("Paris", rng.choice(["Rome", "Paris"])).replace("3", rng.choice(["3", "8"]))
    for k in range(160):
        parts = [item() if rng.random() < 0.4 else swap(rng.choice(items[:25])[1]) for _ in range(rng.randint(1, 5))]
        text = rng.choice([" ", ". ", "\n", ", "]).join(parts)
        docs.append((k, rng.choice([text, text, text.upper(), text.lower(), text.replace(" the", "")])))
    return docs, items


def test_decontamination_equals_the_plain_version(spark):
    docs, items = awkward_questions()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([*docs, docs[7], (None, items[0][1])], "doc_id long, text string").repartition(3)
    for share in (0.8, 0.5):
        want = brute.decontaminate(docs, items, decontaminate.UNITS, share)
        got = collected(decontaminate.decontaminate(d, b, share=share), "doc_id", "item_id", "n_found", "reparameterised")
        assert got == want and len(want) > 80 and len({x[3] for x in want}) == 2


def test_language_features_and_decoding_equal_the_plain_version():
    rng = np.random.default_rng(4)
    texts = ["", "a", "Ab", "Der Fluß, 12!", "日本 é", "x" * 700, None, "aé" * 900]
    got = language_id.features(pa.array(texts), 256)
    for text, row in zip(texts, got, strict=True):
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode()]
        want = np.zeros(256)
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                g = {1: b[i] + (1 << 24), 2: (b[i] << 8) + b[min(i + 1, len(b) - 1)] + (1 << 25), 3: (b[i] << 16) + (b[min(i + 1, len(b) - 1)] << 8) + b[min(i + 2, len(b) - 1)]}[n]
                want[(g * spans.BYTE_BASE % (1 << 64)) >> 56] += 1
        assert row == pytest.approx(np.sqrt(want / max(want.sum(), 1)), abs=1e-6)
    code = language_id.codewords(4)
    model = language_id.LanguageModel(list("abcd"), code, rng.standard_normal((256, 7)), rng.standard_normal(7), rng.uniform(0.5, 1.5, 7), 256)
    best, score, lead = model.decode(got)
    for k, row in enumerate(got):
        margin = [sum(float(x) * float(w) for x, w in zip(row, model.weights[:, j], strict=True)) + model.bias[j] for j in range(7)]
        cost = [sum(model.trust[j] * math.log(1 + math.exp(-code[c, j] * margin[j])) for j in range(7)) for c in range(4)]
        share = [math.exp(min(cost) - c) for c in cost]
        share = sorted((x / sum(share) for x in share), reverse=True)
        assert best[k] == cost.index(min(cost)) and score[k] == pytest.approx(share[0]) and lead[k] == pytest.approx(share[0] - share[1])


SECRETS = [
    (1, None), (2, ""), (3, "password=hunter22 and token: 'abc' secret=abcdef"), (4, "é😀 API_KEY = \"" + "Ab1" * 9 + "\" x"),
    (5, "AKIA" + "Q" * 16 + " AKIAQQ AKIAAKIA" + "Z9" * 10), (6, "deadbeef" * 3 + " " + "f" * 23 + " g" + "0a" * 15 + "G"),
    (7, "token=token=abcdef token:token:abcdefgh PASSWD:zzzzzz"), (8, "passwordpassword=secretsecret password=a.b-c/d"),
    (9, "token=" + "a1b2c3d4" * 4), (10, "ﬁ token=ſecret12 secret=ſecret\nsecret=\nabcdefgh apikey:=abcdefgh"),
]


def test_secret_base_spans(spark):
    many = [(11, "x token=abcdef1 y " * 700)]
    df = spark.createDataFrame(SECRETS + many, "doc_id long, text string").withColumn("flag", F.lit("clash"))
    out = secret_scan.scan(df)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).alias(k)
    got = collected(out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.named(F.col("base")).cast("binary"), 256).alias("h")), "doc_id", "assign", "access", "hex", "h")
    assert got == brute.secret_scan(SECRETS + many)


def test_secret_models_add_spans(spark):
    rng = random.Random(4)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    train = [(k, f"the user_name of theServer2 is written here token={token(32)} and then more words follow") for k in range(200)]
    train += [(k, "theServerConnection2 handler of parseRequest and formatResponse value") for k in range(200, 500)]
    model = secret_scan.train(spark.createDataFrame(train, "doc_id long, text string"))
    assert len(model.ratio) == secret_scan.CLASSES**2
    one, word = token(28) + "7", "theServerConnectionRequestHandler2"
    df = spark.createDataFrame([(1, f"go {one} on"), (2, f"go {word} on"), (3, f"token={one}"), (4, None)], "doc_id long, text string")
    out = secret_scan.scan(df, model)
    got = {r["doc_id"]: (secret_spans(r["base"]), secret_spans(r["added"])) for r in out.collect()}
    assert got == {1: ([], [("markov", 3, 32)]), 2: ([], []), 3: ([("assign", 0, 35)], []), 4: ([], [])}
    clean = dict(secret_scan.redact(out).select("doc_id", "text").collect())
    assert clean[1] == "go <SECRET> on" and clean[2] == f"go {word} on" and clean[3] == "<SECRET>" and clean[4] == ""
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def awkward_secrets():
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    token = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = ["theServer2Connection_handler", "parse_request_and_format1", "plain", "é😀", "token:", "secret=abcdef9", "deadbeef" * 4, "AKIA" + "Q7" * 9, "api_key"]
    docs = [(k, " ".join(rng.choice([token(rng.randint(4, 60)), rng.choice(words), rng.choice(words)]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    docs += [(k, " ".join(rng.choice(["parseRequest2", "format_value", "theServer", "of", "word9"]) for _ in range(40))) for k in range(120, 200)]
    return [*docs, (200, None), (201, ""), (202, f"{token(30)}9token={token(30)}"), (203, f"token={token(30)}9 {token(25)}7"), (204, " ".join(token(30) for _ in range(3000)))]


def test_secret_models_and_added_spans_equal_the_plain_version(spark):
    rows = awkward_secrets()
    df = spark.createDataFrame([*rows, (None, "token=abcdefgh1234567890 x")], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    model, ratio = secret_scan.train(df), brute.secret_chains(rows)
    assert model.ratio == pytest.approx([x for row in ratio for x in row], abs=1e-9)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in secret_scan.scan(df.where("doc_id is not null"), model).collect()}
    want = {k: brute.secret_added(text or "", ratio) for k, text in rows}
    assert got == want and sum(map(len, want.values())) > 400
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).alias(k)
    out = secret_scan.scan(df.where("doc_id is not null"), model).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.named(F.col("base")).cast("binary"), 256).alias("h"))
    assert collected(out, "doc_id", "assign", "access", "hex", "h") == brute.secret_scan(rows)
    cut = dict(secret_scan.redact(secret_scan.scan(df.where("doc_id is not null"), model)).select("doc_id", "text").collect())
    for k, text in rows:
        text = text or ""
        spans = sorted(want[k] + [m.span() for m in brute.ASSIGN.finditer(text) if len(m[2]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]{24,}", text)])
        parts, end = [], 0
        for n, (a, b) in enumerate(spans):
            if n == 0 or a > end:
                parts += [text[end:a], "<SECRET>"]
            end = max(end, b)
        assert cut[k] == "".join([*parts, text[end:]]), k


def test_secrets_in_a_text_with_very_many(spark):
    text = "é x token=abcdef1 y " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secret_scan.redact(secret_scan.scan(df, secret_scan.MarkovModel([0.0] * secret_scan.CLASSES**2))).first()
    assert len(got["base"]) == 100_000 and got["base"][99_999]["start"] == 20 * 99_999 + 4
    assert got["text"] == "é x <SECRET> y " * 100_000


def secret_spans(found):
    return [(s["kind"], s["start"], s["end"]) for s in found]


def test_redaction_merges_overlaps(spark):
    df = spark.createDataFrame([(1, "é token=" + "a1" * 15 + " mid secret=abcdefg")], "doc_id long, text string")
    got = secret_scan.redact(secret_scan.scan(df, carry=True)).first()
    assert got["text"] == "é <SECRET> mid <SECRET>" and got["row"]["doc_id"] == 1


def test_lm_scores(spark, docs, rows):
    shape = lm_scoring.Shape(side=8, words=40, width=6, radius=2)
    words, flat = lm_scoring.train(docs, shape, every=2, rounds=2)
    assert len(words) == 40 and len(flat) == sum(math.prod(s) for s in shape.sizes())
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, words, flat, shape, batch=37).collect()}
    assert got[1]["n_tokens"] == got[3]["n_tokens"] == 0 and got[1]["pll"] == 0 and got[1]["mean_pll"] is None
    embed, place, shift, top, top_bias, inner, inner_bias = shape.split(flat.astype(np.float64))
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    for doc in (4, 9, 25, 17):
        text = dict(rows)[doc]
        (_, _, data, offsets), = spans.chunks(pa.array([text]))
        ids = lm_scoring.token_ids(spans.words(data, offsets, lower=True).hash, words, shape)
        total = 0.0
        for i, t in enumerate(ids):
            around = [ids[j] if 0 <= j < len(ids) else shape.tokens for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(sum(embed[a] * p for a, p in zip(around, place, strict=True)) + shift)
            total += soft(h @ top + top_bias)[t // 8] + soft(h @ inner[t // 8] + inner_bias[t // 8])[t % 8]
        assert got[doc]["n_tokens"] == len(ids) and got[doc]["pll"] == pytest.approx(total, rel=1e-4)


def test_lm_words_of_a_bucket_have_their_own_shares(spark):
    shape = lm_scoring.Shape(side=4, words=6, width=4, radius=1)
    texts = ["a b c d e f " * 9 + "often often often seen", "often", "seen", "never", "often  Never seen", None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "often"), (1, "often")], "doc_id long, text string").repartition(2)
    counted = lm_scoring.word_counts(docs.where("doc_id = 0"))
    words, flat = lm_scoring.train(docs.where("doc_id = 0"), shape, counted=counted)
    shares = lm_scoring.word_shares(counted, words, shape)
    plain, got = (sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["pll"]) for r in lm_scoring.score(docs, words, flat, shape, shares=s).collect()) for s in (None, shares))
    assert [x[:2] for x in plain] == [x[:2] for x in got]
    seen = {"often": 3, "seen": 1}
    hashes = {}
    for t in (*seen, "never"):
        (_, _, data, offsets), = spans.chunks(pa.array([t]))
        hashes[t] = spans.words(data, offsets, lower=True).hash
    bucket = {t: int(lm_scoring.token_ids(h, words, shape)[0]) for t, h in hashes.items()}
    share = lambda t: math.log((seen.get(t, 0) + 1) / (sum(n + 1 for w, n in seen.items() if bucket[w] == bucket[t]) + 1))
    add = {0: 3 * share("often") + share("seen"), 1: share("often"), 2: share("seen"), 3: share("never"), 4: share("often") + share("never") + share("seen"), 5: 0, 6: 0, -1: share("often")}
    for (k, _, before), (_, _, after) in zip(plain, got, strict=True):
        assert after - before == pytest.approx(add[k], abs=1e-4), k


def test_lm_training_masks_every_position_once():
    texts = pa.array(["a b c a b c " * 50, None, "", "one", "d e f " * 70])
    (_, _, data, offsets), = spans.chunks(texts)
    w = spans.words(data, offsets, lower=True)
    for every in (1, 2, 5):
        turns = [lm_scoring.masked(w, every, turn) for turn in range(every)]
        assert sorted(np.concatenate(turns).tolist()) == list(range(len(w.hash)))
    given = inspect.signature(lm_scoring.train).parameters
    assert given["rounds"].default >= given["every"].default


def test_lm_scores_do_not_depend_on_the_layout(spark, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 3000)  # many shards, pieces that end inside batches, many copies
    monkeypatch.setattr(lm_scoring, "MOST_COPIES", 16)
    shape = lm_scoring.Shape(side=8, words=40, width=6, radius=2)
    made = [(k, t if t is None else t[:40000]) for k, t in rows] + [(1000 + k, "the same text again and again") for k in range(90)]
    one = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    two = spark.createDataFrame(random.Random(1).sample(made, len(made)), "doc_id long, text string").repartition(7)
    (a, x), (b, y) = (lm_scoring.train(df, shape, batch=512) for df in (one, two))
    assert (a == b).all() and (x == y).all() and not (x == shape.start()).all()


def test_lm_rounds_average_the_shards_by_their_positions(spark):
    """One shard trained by hand, and the mean of two by their weights."""
    shape = lm_scoring.Shape(side=4, words=10, width=4, radius=1)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 13}" for j in range(60))) for k in range(8)], "doc_id long, text string")
    words, flat = lm_scoring.train(docs, shape, every=2, rounds=1, batch=64)
    coded = sorted((r["key"], r["ids"]) for r in lm_scoring.tokens(docs.select("text"), words, shape).collect())
    dealt = {}
    for key, ids in coded:  # a copy is told by its number
        dealt[key, sum(k == key for k, _ in dealt)] = ids
    dealt = sorted(dealt.items())
    ids, bounds = np.concatenate([i for _, i in dealt]), np.concatenate([[0], np.cumsum([len(i) for _, i in dealt])])
    marks = [spans.mix(np.array([k], np.int64).view(np.uint64) + np.uint64(n) * np.uint64(spans.BYTE_BASE))[0] for (k, n), _ in dealt]
    marks = np.repeat(np.array(marks, np.uint64), np.diff(bounds))
    at = lm_scoring.masked(spans.Words(bounds[:-1], bounds[1:], marks, bounds), 2, 0)
    at = at[np.argsort(spans.mix(at.astype(np.uint64)))]
    own, memory = shape.start(), np.full_like(shape.start(), 1e-3)
    for k in range(0, len(at), 64):
        part = at[k : k + 64]
        lm_scoring.train_step(own, memory, lm_scoring.contexts(ids, bounds, part, shape), ids[part], shape, 0.1)
    assert flat == pytest.approx(own, rel=1e-5, abs=1e-6)
    values = [[float(k + j) for j in range(lm_scoring.ROW)] for k in range(5)]
    parts = spark.createDataFrame([(k, 0, float(k + 1), [x * (k + 1) for x in v]) for k, v in enumerate(values)], "part int, row int, weight double, values array<double>")
    want = np.average(np.array(values), axis=0, weights=np.arange(1, 6))
    assert lm_scoring._average(parts.repartition(3), lm_scoring.ROW) == pytest.approx(want, rel=1e-6)


def test_lm_vocabulary_grows_with_the_corpus():
    sides = [lm_scoring.shape_for(n).side for n in (0, 1 << 22, 1 << 30, 1 << 34, 1 << 60)]
    assert sides[:2] == [32, 32] and sides[1] < sides[2] < sides[3] < sides[4] == lm_scoring.MOST_SIDE
    assert lm_scoring.shape_for(0) == lm_scoring.Shape()


def test_lm_training_learns(spark):
    base = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(k, " ".join(base * 40)) for k in range(20)], "doc_id long, text string")
    shape = lm_scoring.Shape(side=8, words=40, width=8, radius=2)
    score = lambda m: lm_scoring.score(docs, *m, shape).agg(F.sum("pll") / F.sum("n_tokens")).first()[0]
    start = score((lm_scoring.vocabulary(docs, 40), shape.start()))
    assert score(lm_scoring.train(docs, shape, every=2, rounds=3, batch=256)) > start + 1.5


def test_lm_gradient():
    shape = lm_scoring.Shape(side=3, words=5, width=4, radius=1)
    flat = shape.start(1).astype(np.float64) * 3
    rng = np.random.default_rng(0)
    around, target = rng.integers(0, 10, (6, 2)), rng.integers(0, 9, 6)
    moved, memory = flat.copy(), np.ones_like(flat) * 1e12
    lm_scoring.train_step(moved, memory, around, target, shape, 1e6)  # steps of 1: the change is the gradient
    loss = lambda x: -lm_scoring.log_probabilities(x, around, target, shape).mean()
    for k in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(flat[k] - moved[k], abs=1e-5)


def make_vectors():
    rng = np.random.default_rng(8)
    out = []
    for label in (1, 2, None):
        centres = rng.standard_normal((30, 16))
        for k in range(260):
            v = centres[k % 30] + rng.standard_normal(16) * rng.choice([0.05, 0.1, 0.2, 0.3, 1.0])
            out.append(([float(np.float32(x)) for x in v], label))
    out += [(None, 1), ([], 1), ([0.0] * 16, 1), ([1.0, None] + [0.5] * 14, 1), ([float("nan")] + [1.0] * 15, 1), ([float("inf")] + [1.0] * 15, 1), ([1.0, 0.0], 2), ([2.0, 0.0], 2)]
    out += [out[0]] * 40
    return [(k, e, label) for k, (e, label) in enumerate(out)]


def test_embedding_dedup(spark):
    vectors = make_vectors()
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    edges = []
    unit = {k: np.array(e) / np.linalg.norm(e) for k, e, label in vectors if e and label and None not in e and np.isfinite(e).all() and any(e)}
    label = {k: l for k, _, l in vectors}
    keys = sorted(unit)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if label[a] == label[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.93:
                edges.append((b, a))
    degree = {k: 0 for k, _, _ in vectors}
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, 0.93, block=50).collect()}
    found = sum(r["n_links"] for r in got.values()) / 2
    assert len(got) == len(vectors) and found >= 0.95 * len(edges)
    assert all(got[k]["n_links"] <= degree[k] for k in degree)  # no link below the threshold
    comp = brute.union_find(degree, edges)
    same = sum(got[k]["component_id"] == comp[k] for k in comp)
    assert same >= 0.95 * len(comp) and all(got[k]["kept"] == (got[k]["component_id"] == k) for k in comp)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_chances_follow_from_the_cosine():
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((2, 400_000))
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    for level in (1, 3, 6):
        plan = embedding_dedup.calibrate(0.93, 0.99, level)
        met = np.mean((x >= plan.bound) & (y >= plan.bound) & (np.abs(x - y) <= plan.half))
        assert embedding_dedup.collision_chance(0.93, plan.bound, plan.half) == pytest.approx(met, rel=0.05)
        assert plan.recall >= 0.99 and np.mean(x >= plan.bound) == pytest.approx(2.0**-level, rel=0.05)


def test_embedding_recall_and_work_at_the_threshold():
    """Pairs right at the threshold are found; a vector meets little more than as many others in a label of 16 times the size."""
    rng = np.random.default_rng(3)
    met = []
    for n in (1000, 16000):
        x = rng.standard_normal((n, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.standard_normal((n // 2, 48))
        side -= (side * x[: n // 2]).sum(1, keepdims=True) * x[: n // 2]
        x[n // 2 :] = 0.931 * x[: n // 2] + math.sqrt(1 - 0.931**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        plan = embedding_dedup.calibrate(0.93, 0.99, int(math.log2(n / embedding_dedup.END)))
        row, end, value = embedding_dedup.far_out(x, plan, embedding_dedup.directions(48, plan.ends // 2))
        found = set()
        for e in np.unique(end):
            members = row[end == e]
            if len(members) > 1:
                mine = np.isin(row, members)
                i, j = embedding_dedup.collided(np.searchsorted(members, row[mine]), end[mine], value[mine], int(e), np.zeros(len(members), np.int8), plan)
                found |= {(members[a], members[b]) for a, b in zip(i, j, strict=True)}
        assert np.mean([(k, k + n // 2) in found for k in range(n // 2)]) >= 0.97
        met.append(np.mean(np.bincount(end)[end]) * len(row) / n)
        # the same pairs by many units at once
        order = np.argsort(end, kind="stable")
        held, unit = row[order], np.unique(end[order], return_inverse=True)[1]
        lists = np.searchsorted(row, np.arange(n + 1))
        size = np.diff(lists)[held]
        flat = np.repeat(lists[held], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        i, j = embedding_dedup.first_met(unit, end[order], np.zeros(len(held), np.int8), np.repeat(np.arange(len(held)), size), end[flat], value[flat], plan)
        assert {(held[a], held[b]) for a, b in zip(i, j, strict=True)} == found
    assert met[1] < 2.5 * met[0]  # more ends are needed as they narrow, and they differ in size; all pairs would be 16 times as many


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = brute.union_find({x for e in edges for x in e}, edges)
    got = dict(map(tuple, CC.components(df, Scratch(spark, "test")).collect()))
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_empty_tables(empty):
    path = public_tokenizers.path
    model = language_id.train(empty)
    outs = [
        substring_dedup.substring_dedup(empty), suffix_dedup.suffix_dedup(empty), token_counts.token_counts(empty, path("byte_bpe_50k.json")),
        language_id.predict(empty, model), pieces.encode_pieces(empty, path("piece_bpe_32k.model")), jaccard_join.jaccard_join(empty),
        secret_scan.scan(empty, secret_scan.train(empty)), lm_scoring.score(empty, *lm_scoring.train(empty)),
    ]
    assert [df.count() for df in outs] == [0] * len(outs)
    assert model.languages == []


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(120))
    df = spark.createDataFrame([(None, text), (None, None), (3, text), (3, text), (4, text)], "doc_id long, text string")
    got = sorted(map(tuple, substring_dedup.substring_dedup(df).select("doc_id", "n_removed").collect()), key=str)
    assert got == sorted([(None, 0), (None, 0), (3, 0), (3, 0), (4, 120)], key=str)
    n = len(text.encode())
    got = sorted(map(tuple, suffix_dedup.suffix_dedup(df).select("doc_id", "n_removed").collect()), key=str)
    assert got == sorted([(None, 0), (None, 0), (3, n), (3, n), (4, n)], key=str)
    got = sorted(map(tuple, jaccard_join.jaccard_join(df).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, None), (None, None), (3, 3), (3, 3), (4, 3)], key=str)
    twice = spark.createDataFrame([(3, text), (3, "a b c d e f g h"), (4, text), (5, "a b c d e f g h"), (6, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_join(twice).collect()))
    assert [r[:2] for r in got] == [(3, 5), (3, 117), (4, 117), (5, 5), (6, 0)] and got[4][2] == 6 and {r[2] for r in got[:4]} == {3}


def test_a_model_without_languages_says_und(docs, empty):
    out = language_id.predict(docs, language_id.train(empty))
    assert {r[0] for r in out.select("lang_pred").distinct().collect()} == {"und"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = duck.execute(ORACLES[name])
    names = [x[0] for x in rows.description]
    want = [[r[names.index(c)] for c in columns] for r in rows.fetchall()]
    assert sorted(names) == columns and brute.canonical(df.select(*columns).collect()) == brute.canonical(want)
