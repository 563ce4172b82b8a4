"""Operators 11 to 13 against the library, the oracle and plain versions, with every awkward case."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexicarta.llm import byte_bpe, filter_audit, periodic_runs, spans
from lexicarta.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def awkward(spark, rows):
    """Rows ``(doc_id, text, lang)`` with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(a, b, c, None, None) for a, b, c in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("part", "mask", "digest", "n", "low", "good", "runs", "w", "g", "ids", "n_tokens", "named", "e")})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe.read(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


# --- 11 ---------------------------------------------------------------------------------------


def test_bpe_tree_equals_the_library_on_hard_strings(bpe, library):
    rng = random.Random(3)
    for alphabet in ("ab", "a", "etaoinsh", "aé日😀", " \n\ta", "1234567890", "<|endoftext|>"):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))
            assert bpe.encode(text).tolist() == library.encode_ordinary(text)
            assert bpe.decode(bpe.encode(text)) == text.encode()


def test_bpe_long_pieces_and_every_leaf_size(bpe, library, monkeypatch):
    texts = ["a" * 5001, "ab" * 3000, " " * 4000, "é" * 2500, "xyz" * 2000 + "a" * 999]
    for leaf in (1, 2, 8, 64):
        monkeypatch.setattr(byte_bpe, "LEAF", leaf)
        bpe._pieces.clear()
        for text in texts:
            assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def test_bpe_join_of_any_cut(bpe):
    """The join is that of the whole wherever the two halves meet."""
    data = "Unbelievably internationalisation-aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab".encode()
    whole = bpe._merge_short(data)
    assert whole == bpe._merge_long(data)
    for cut in range(len(data) + 1):
        assert bpe.join(bpe.tokens(data[:cut]), bpe.tokens(data[cut:])) == whole


def test_bpe_bounded_memory_changes_nothing(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "MOST_WINDOWS", 2)
    text = "some words that come again, some words that come again and more " * 5
    assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def test_bpe_table_and_round_trip(spark, library):
    texts = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "日本語 😀 ñandú\r\n\t  x"), (5, "word " * 40000), (6, "<|endoftext|> isn't it's")]
    docs = awkward(spark, [(a, b, "en") for a, b in texts])
    out = byte_bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = []
    for a, text in texts:
        ids = library.encode_ordinary(text or "")
        want.append((a if a is not None else -1, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text or "")))
    assert got == sorted(want)
    decoded = byte_bpe.bpe_decode(out, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.data).decode() for r in decoded) == sorted(t or "" for _, t in texts)
    assert byte_bpe.bpe_encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN, output="pieces")


def test_op11_whole_table(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_bpe"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(docs[r.doc_id]))


# --- 12 ---------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    tests = {
        "A": lambda d, t, w: len(w) < 100, "B": lambda d, t, w: 100 * len(set(w)) < 80 * len(w), "C": lambda d, t, w: 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
        "D": lambda d, t, w: any(c in "#$%&*|" for c in t), "E": lambda d, t, w: d is not None and d > first[t],
    }
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    out, names = {}, ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    parts = {lang or "" for _, _, lang in rows}
    for part in parts:
        for order in map("".join, itertools.permutations("ABCDE")):
            for k in range(5):
                out[part, order, k + 1] = dict.fromkeys(names, 0)
    for doc, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {x for x, f in tests.items() if f(doc, t, w)}
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for k, x in enumerate(order):
                o = out[lang or "", order, k + 1]
                now = x in fails and not gone
                o["redundant"] += x in fails and gone
                gone |= now
                o["removed"] += now
                o["kept"] += not gone
                o["unique_fails"] += fails == {x}
                o["good_lost"] += now and doc in good
                o["toxic_lost"] += now and doc in toxic
    for part in parts:
        for x in "ABCDE":
            total = sum(o["removed"] for (p, order, k), o in out.items() if p == part and order[k - 1] == x)
            for (p, order, k), o in out.items():
                if p == part and order[k - 1] == x:
                    o["shapley"] = total
    return out


def test_audit_equals_the_plain_version(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "d#", "e", "ñ"]
    rows = [(1, None, "en"), (2, "", "en"), (3, "", None), (None, "", "de"), (None, "same text", "en"), (4, "same text", "en"), (5, "same text", "de"), (5, "same text", "de"), (4, "same text", "en")]
    rows += [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 99, 100, 150]))), rng.choice(["en", "de", None, ""])) for k in range(10, 40)]
    rows += [(k, " ".join(f"w{i}" for i in range(120)), "en") for k in (50, 51, 52)] + [(60, " ".join(f"w{i}" for i in range(30000)), "fr")]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, 1), (51, 1, 1), (52, None, 1), (None, 1, 1), (11, 0, 1), (99, 1, 1)]
    docs = awkward(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality long, toxic long").withColumn("n", F.lit(9))
    found = filter_audit.filter_audit(docs, filter_audit.quality_filters(docs), twin="E", labels=marks)
    got = {(r.part, r.filter_order, r.step): {c: r[c] for c in (*filter_audit.OUTCOMES, "shapley")} for r in found.collect()}
    assert got == plain_audit(rows, labels)


def test_audit_without_twins_labels_or_rows(spark):
    docs = awkward(spark, [(1, "a", "x"), (2, "b c", "x"), (3, None, None)])
    found = filter_audit.filter_audit(docs, {"S": F.length("text") < 2, "T": F.col("text").contains("c")})
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in found.collect()}
    assert got["x", "ST", 1] == (1, 1, 0, 2) and got["x", "ST", 2] == (0, 1, 0, 2)
    assert got["", "TS", 2] == (1, 0, 0, 0)  # a null condition is no failure
    assert filter_audit.filter_audit(docs.limit(0), filter_audit.quality_filters(docs.limit(0)), twin="E").count() == 0
    with pytest.raises(ValueError):
        filter_audit.filter_audit(docs, {"S": F.lit(True)}, twin="S" * 2)


def test_packed_fields_do_not_overflow():
    """Counts up to the part's own, at widths that fit it exactly and far beyond 64 bits of fields in all."""
    steps = filter_audit.Steps("ABCDE")
    for n in (1, 2, 3, 255, 256, (1 << 40) - 1, 1 << 40):
        width = n.bit_length()
        for mask in (0, 31, 127):
            table = steps.unpack(n * steps.integer(mask, width), width)
            assert (table == n * steps.held[mask].reshape(table.shape)).all()
    assert len(steps.orders) == 120 and steps.held.shape == (128, 600 * 6)


def test_audit_plan_brings_texts_nowhere(spark):
    """What is shuffled are digests and masks, aggregated before each exchange."""
    from lexicarta.plans import inspect

    text = inspect.physical(QUERIES["op12_filter_audit"](spark, SMALL))
    for line in re.findall(r"Exchange\n(?:.*\n)*?Input \[\d+\]: (\[.*\])", text):
        assert "text" not in line


def test_op12_oracle(spark, duck):
    rel = duck.sql(ORACLES["op12_filter_audit"])
    own = QUERIES["op12_filter_audit"](spark, SMALL)
    assert sorted(rel.columns) == sorted(own.columns)
    want = {tuple(dict(zip(rel.columns, r, strict=True))[c] for c in own.columns) for r in rel.fetchall()}
    assert {tuple(r) for r in own.collect()} == want and len(want) == own.count()


# --- 13 ---------------------------------------------------------------------------------------


def plain_runs(w, least):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return out


def own_runs(w, least):
    text = b" ".join(w)
    marked = periodic_runs.suspects(spans.words(np.frombuffer(text, np.uint8), np.array([0, len(text)])), -(-least // 2))
    return set(map(tuple, periodic_runs.document_runs(w, marked, least).tolist()))


def test_runs_equal_the_plain_version():
    rng = random.Random(6)
    for _ in range(600):
        alphabet, least = rng.choice([b"ab", b"abc", b"abcdefgh"]), rng.choice([2, 3, 5, 12])
        w = [bytes([rng.choice(alphabet)]) for _ in range(rng.randint(0, 70))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randint(1, 9)
            w = w[:a] + [w[a + i % min(p, len(w) - a)] for i in range(len(w) - a)]
        assert own_runs(w, least) == plain_runs(w, least)


def test_runs_of_words_that_read_periodic_binary():
    """Fibonacci words have the most runs; Thue-Morse words none of three periods."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    assert own_runs(b, 2) == plain_runs(b, 2)
    t = [b"x" if bin(i).count("1") % 2 else b"y" for i in range(256)]
    assert own_runs(t, 2) == plain_runs(t, 2)


def test_suffix_tree_extensions():
    rng = random.Random(8)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 90))] + [-1]
        lce, rank = periodic_runs.extensions(s, ordered=True)
        assert [int(i) for i in np.argsort(rank)] == sorted(range(len(s)), key=lambda i: s[i:])
        a, b = (np.array([rng.randrange(len(s)) for _ in range(50)]) for _ in range(2))
        keep = a != b
        a, b = a[keep], b[keep]
        want = [next((k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert lce(a, b).tolist() == want


def plain_op13(doc, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = sorted(plain_runs(w, 12), key=lambda r: (r[0], r[2]))
    gone = set()
    for s, size, q in runs:
        gone.update(range(s + q, s + size))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_op13_on_a_small_fixture(spark, tmp_path):
    rng = random.Random(9)
    periodic = [k for k in range(100, 3000) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (None, None), (4, "a b " * 40), (4, "a b " * 40), (5, "one two three four five six " * 2), (6, "x " * 11), (7, "x " * 12)]
    rows += [(k, rng.choice(["", None, "w", " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 80))), " ".join(f"w{i}" for i in range(rng.randint(1, 200)))])) for k in periodic[:120]]
    rows += [(k, " ".join("ab") + " " + " ".join(rng.choice("ab") for _ in range(60))) for k in range(40, 80)]
    rows += [(periodic[200], " ".join(f"w{i}" for i in range(3000)))]
    awkward(spark, [(a, b, "en") for a, b in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted((plain_op13(a, b) for a, b in rows), key=order)


def test_op13_whole_small_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    short = {k: t for k, t in docs.items() if len(WORD.findall(t or "")) < 1500}
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SMALL).select(*COLUMNS).collect()}
    assert set(got) == set(docs) and len(short) > 150
    for doc, text in short.items():
        assert got[doc] == plain_op13(doc, text)


def test_periodic_runs_of_an_empty_table(spark):
    docs = awkward(spark, [(1, "a", "x")]).limit(0)
    assert periodic_runs.periodic_runs(docs).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, least=1)
