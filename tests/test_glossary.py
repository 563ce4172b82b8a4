"""Rules of the glossary engine on a hand-written table, properties on random ones, and plans."""

import random

import pytest
from pyspark.sql import functions as F

from lexicarta import fixtures
from lexicarta.functions import locales, text
from lexicarta.operators import batch, catalog, postings, search
from lexicarta.plans import inspect
from lexicarta.schema import COLUMNS, GLOSSARY_SCHEMA, OPERATORS, RESULT_COLUMNS, total_order
from lexicarta.sources import glossary as source

SMALL = "/root/testdata/sf0.001"


def row(id_, group, source_, target, language, bundle="b1", platform="ios", version=26, file_name="f.strings"):
    norm = text.normalise(target) if target is not None else None
    return (id_, group, source_, target, language, file_name, bundle, platform, version, norm)


ROWS = [
    row(1, 1, "k.hello", "Hello world", "en"), row(2, 1, "k.hello", "Bonjour monde", "fr", "b2"), row(3, 1, "k.hello", "Hallo Welt", "de"),
    row(4, 2, "a_b", "ＷＯＲＬＤ①", "en"), row(5, 2, "a_b", "monde", "fr"), row(6, 2, "a_b", "worldwide", "en"),
    row(7, 3, "a%b", None, "en", None), row(8, 3, None, "ｶﾞ world", "ja"), row(9, 3, "a\\b", "x", "en~ipad"),
    row(10, 4, "a[b", "world-class", "en", "b3"), row(11, 4, "axb", "nothing", "en", "b3"), row(12, 4, "a[b", "nothing", "xx"),
    row(13, 1, "k.hello", "Hello world", "en", "b1", "ios", 18), row(14, 1, "mac", "mac world", "en", "b1", "macos", 26), row(15, 5, "k", "same", "en"),
    row(16, 5, "k", "same", "en"), row(16, 5, "k", "same", "en"), row(None, 5, "k", "world", "en", "b9"),
]
CODES = {"English": ["en", "en~ipad"], "French": ["fr"], "German": ["de"], "Japanese": ["ja"]}


@pytest.fixture(scope="module")
def glossary(spark):
    return spark.createDataFrame(ROWS, GLOSSARY_SCHEMA).cache()


@pytest.fixture(scope="module")
def language_map(spark):
    raw = spark.createDataFrame([("ios", 26, CODES), ("ios", 18, {"English": ["en"]}), ("macos", 26, {"English": ["en"]})], "platform string, version int, languages map<string,array<string>>")
    return source.explode_language_map(raw).cache()


@pytest.fixture
def ids(glossary, language_map):
    def run(**request):
        return sorted((r["id"] for r in search.search(glossary, language_map, "ios", 26, **request).rows.collect()), key=lambda x: (x is None, x or 0))

    return run


def test_whole_groups_return_whether_or_not_each_row_matches(ids):
    assert ids(term="hello") == [1, 2, 3]


def test_the_bundle_chooses_groups_only(ids):
    assert ids(bundle="b2") == [1, 2, 3]
    assert ids(term="hello", bundle="b2") == []  # no single row meets both
    assert ids(term="world", bundle="b3") == [10, 11]


def test_languages_hold_in_both_steps(ids):
    assert ids(term="hello", languages=["French"]) == []
    assert ids(term="monde", languages=["French"]) == [2, 5]
    assert ids(term="monde", languages=["French", "English"]) == [1, 2, 4, 5, 6]


def test_no_selection_means_every_mapped_code(ids):
    assert 12 not in ids(bundle="b3") and 9 in ids(term="ガ")


def test_unknown_names_select_nothing(ids):
    assert ids(term="hello", languages=["Klingon"]) == []
    assert ids(term="monde", languages=["Klingon", "French"]) == [2, 5]


def test_empty_result_has_zero_pages(glossary, language_map):
    r = search.search(glossary, language_map, "ios", 26, term="zzz")
    assert tuple(r.total().first()) == (0, 0) and r.page().count() == 0


@pytest.mark.parametrize("term,bundle", [(None, None), ("", ""), (None, "")])
def test_a_search_needs_something(ids, term, bundle):
    with pytest.raises(ValueError):
        ids(term=term, bundle=bundle)


def test_empty_fields_are_no_predicate(ids):
    assert ids(term="", bundle="b2") == ids(bundle="b2") and ids(term="hello", bundle="") == ids(term="hello")


def test_normalisation_is_shared(ids):
    assert ids(term="WORLD1") == [4, 5, 6] and ids(term="world1") == [4, 5, 6] and ids(term="ＷＯＲＬＤ1") == [4, 5, 6]
    assert ids(term="ガ") == [7, 8, 9] and ids(term="か") == []


def test_word_mode_matches_whole_tokens(ids):
    assert ids(term="world", mode="word", languages=["English"]) == [1, 10, 11, 15, 16, 16, None]
    assert ids(term="world-class", mode="word") == [10, 11] and ids(term="hello world", mode="word") == [1, 2, 3]
    assert ids(term="w.rld", mode="word") == []


def test_releases_are_apart(glossary, language_map):
    assert [r["id"] for r in search.search(glossary, language_map, "ios", 18, term="hello").rows.collect()] == [13]
    assert [r["id"] for r in search.search(glossary, language_map, "macos", 26, bundle="b1").rows.collect()] == [14]


def test_release_resolution(glossary):
    assert catalog.resolve_release(glossary, "ios", "latest") == ("ios", 26) == catalog.resolve_release(glossary, "ios", None)
    assert catalog.resolve_release(glossary, "ios", "18") == ("ios", 18)
    for platform, version in (("watch", "latest"), ("ios", "99"), ("ios", "x")):
        with pytest.raises(ValueError, match="known"):
            catalog.resolve_release(glossary, platform, version)
    assert {tuple(r) for r in catalog.latest_releases(glossary).collect()} == {("ios", 26), ("macos", 26)}


@pytest.mark.parametrize("value,want", [("3", 3), (3, 3), ("0", 1), (-4, 1), ("", 200), (None, 200), ("abc", 200), ("999", 200), (" 7 ", 7)])
def test_size_is_clamped(value, want):
    assert search.clamp(value, 200, 200) == want


def test_totals_count_rows_with_an_id(glossary, language_map):
    r = search.search(glossary, language_map, "ios", 26, term="same", size=2)
    assert tuple(r.total().first()) == (3, 2) and r.rows.count() == 4 and r.pages(3) == 2


def test_pages_join_to_the_whole(glossary, language_map):
    whole = search.search(glossary, language_map, "ios", 26, term="o")
    n = whole.rows.count()
    parts = [r for k in range(1, n // 3 + 2) for r in search.search(glossary, language_map, "ios", 26, term="o", page=k, size=3).page().collect()]
    assert sorted(map(str, parts)) == sorted(map(str, whole.rows.select(*RESULT_COLUMNS).collect()))
    order = [(r["group_id"], r["language"]) for r in parts]
    assert order == sorted(order)
    second = search.search(glossary, language_map, "ios", 26, term="o", page=2, size=3).numbered_page().collect()
    assert [r["row_number"] for r in second] == [4, 5, 6]


def column(glossary, language_map, alias, operator, value):
    return sorted(r["id"] or 0 for r in search.search_column(glossary, language_map, "ios", 26, alias, operator, value).rows.collect())


def test_column_search_does_not_expand(glossary, language_map):
    assert column(glossary, language_map, "localization", "equal", "Hello world") == [1]
    assert column(glossary, language_map, "bundle", "equal", "b2") == [2]
    assert column(glossary, language_map, "language", "equal", "ja") == [8]


def test_not_equal_drops_nulls(glossary, language_map):
    assert 7 not in column(glossary, language_map, "localization", "notEqual", "x") and 8 not in column(glossary, language_map, "key", "notEqual", "k")


@pytest.mark.parametrize("prefix,want", [("a_b", [4, 5, 6]), ("a%", [7]), ("a\\", [9]), ("a[", [10]), ("a", [4, 5, 6, 7, 9, 10, 11])])
def test_prefixes_are_literal(glossary, language_map, prefix, want):
    assert column(glossary, language_map, "key", "startsWith", prefix) == want


@pytest.mark.parametrize("alias,operator,value,message", [("nope", "like", "", "column"), ("key", "like", "", "operator"), ("key", "equal", "", "empty")])
def test_column_requests_fail_in_order(alias, operator, value, message):
    with pytest.raises(ValueError, match=message):
        search.predicate(alias, operator, value)


def test_five_columns_and_three_operators():
    assert list(COLUMNS) == ["key", "localization", "language", "file", "bundle"] and OPERATORS == ("equal", "notEqual", "startsWith")


@pytest.mark.parametrize("code,want", [
    ("en", "en"), ("en_GB-iphoneos", "en_GB"), ("en~ipad", "en"), ("zh-Hans-tvos", "zh-Hans"), ("a-macosb-macos", "ab-macos"), ("x-macos~ipad", "x"),
    ("~iphone", ""), ("en_GB~iphone-tvos", "en_GB"), ("b~appletv~applewatch", "b"),
])
def test_suffixes_go_once_each(spark, code, want):
    assert spark.createDataFrame([(code,)], "c string").select(locales.strip_suffix(F.col("c"))).first()[0] == want
    plain = code
    for s in locales.SUFFIXES:
        plain = plain.replace(s, "", 1)
    assert plain == want


def test_display_names(spark):
    names = locales.display_names()
    assert names["en"] == "English (United States)" and names["Base"] == "English" and names["zh-Hant"] == "Chinese" and names["he"] == "Hebrew"
    assert names["de-AT"] == "German (Austria)" and names["hi_Latn"] == "Hindi (India)" and names["es_419"] == "Spanish (Latin America)" and names["Dutch"] == "Dutch (Netherlands)"
    assert not {"bn_Latn", "de_AT", "en-GB", "fil", "mn", "nl_BE"} & set(names) and len(names) == 110
    codes = [("en_GB-iphoneos", "English (United Kingdom)"), ("mn~ipad", "mn~ipad"), ("zh_HK", "Chinese (Hong Kong)"), ("de_AT", "de_AT")]
    got = locales.with_display_name(spark.createDataFrame([(c,) for c, _ in codes], "language string"), locales.locale_names(spark))
    assert {tuple(r) for r in got.collect()} == set(codes)


def test_every_display_name_is_shown(spark):
    names = locales.DISPLAY_NAMES
    codes = [(c, c + s) for c in names for s in ("", "-macos", "~ipad")]
    got = locales.with_display_name(spark.createDataFrame(codes, "plain string, language string"), locales.locale_names(spark)).collect()
    assert len(got) == 330 and all(r["display_language"] == names[r["plain"]] for r in got)


def test_languages_by_rule(spark):
    want = {"Base": "English", "fil": "Filipino", "zh-Hans": "Simplified Chinese", "zh_CN~ipad": "Simplified Chinese", "zh_HK": "Traditional Chinese", "zh-Hant": "Traditional Chinese", "en_GB-iphoneos": "English", "en~ipad": "English", "mn": "Mongolian", "km": "Central Khmer", "qq": None, "Dutch": "Dutch", "nb": "Norwegian Bokmål"}
    got = locales.infer_language(spark.createDataFrame([(c,) for c in want], "language string")).collect()
    assert {r["language"]: r["language_name"] for r in got} == want


def test_catalogues(glossary):
    assert {tuple(r) for r in catalog.release_counts(glossary).collect()} == {("ios", 26, 16), ("ios", 18, 1), ("macos", 26, 1)}
    assert [r["bundle_name"] for r in catalog.bundle_list(glossary).where("platform = 'ios' and version = 26").collect()] == ["b1", "b2", "b3", "b9"]
    heads = {r["group_id"]: (r["header"], r["items"]) for r in catalog.group_headers(glossary).where("platform = 'ios' and version = 26").collect()}
    assert heads[1] == ("k.hello", 3) and heads[4][1] == 3


def test_random_browse_is_repeatable_and_whole(glossary):
    one, two = (sorted(map(str, catalog.browse_random_bundle(glossary, 5).collect())) for _ in range(2))
    assert one == two
    picked = {(r["platform"], r["version"]): r["bundle_name"] for r in catalog.random_bundle(glossary, 5).collect()}
    assert set(picked) == {("ios", 26), ("ios", 18), ("macos", 26)}
    groups = {(r["platform"], r["version"], r["group_id"]) for r in glossary.collect() if r["bundle_name"] == picked[r["platform"], r["version"]]}
    assert len(one) == sum((r["platform"], r["version"], r["group_id"]) in groups for r in glossary.collect())
    assert len({catalog.random_bundle(glossary, s).where("platform = 'ios' and version = 26").first()["bundle_name"] for s in range(12)}) > 1


REQUESTS = [
    (1, "ios", "latest", "hello", None, None), (2, "ios", "26", "", "b2", []), (3, "ios", "26", "monde", "", ["French", "English"]),
    (4, "ios", "18", "HELLO", None, ["English"]), (5, "ios", "26", "hello", "", ["Klingon"]), (6, "ios", "26", "", "", []), (7, "ios", "99", "hello", "", []), (8, "macos", "", "world", None, []),
    (9, "ios", "26", "ＷＯＲＬＤ1", None, []), (10, "ios", "26", "ｶﾞ", "", ["Japanese"]), (11, "ios", "latest", "ＨＥＬＬＯ", "b1", []), (12, "ios", "26", "w", None, ["English"]), (13, "watch", "1", "hello", None, []),
]


def test_batch_equals_single(spark, glossary, language_map):
    asked = spark.createDataFrame(REQUESTS, "request_id long, platform string, version string, q string, bundle string, languages array<string>")
    found = batch.search_all(glossary, language_map, batch.resolve_versions(asked, glossary))
    got = {}
    for r in found.collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    for k, platform, version, q, bundle, languages in REQUESTS:
        if version == "99" or platform == "watch" or not (q or bundle):
            assert k not in got
            continue
        p, v = catalog.resolve_release(glossary, platform, version)
        want = [r["id"] for r in search.search(glossary, language_map, p, v, q, bundle, languages).rows.collect()]
        assert sorted(map(str, got.get(k, []))) == sorted(map(str, want)), k
    pages = batch.number_pages(found, 2).collect()
    assert {(r["row_number"] - 1) // 2 + 1 == r["page"] for r in pages} == {True}
    totals = {r["request_id"]: r["total"] for r in batch.totals(found).collect()}
    assert totals == {k: sum(x is not None for x in v) for k, v in got.items()}


ASKED = "request_id long, platform string, version string, q string, bundle string, languages array<string>"


def test_batch_by_index_equals_batch_by_release(spark, glossary, language_map, tmp_path):
    asked = batch.resolve_versions(spark.createDataFrame(REQUESTS, ASKED), glossary)
    named = glossary.where("id is not null")
    index = postings.write(postings.build(named), str(tmp_path / "index"), 3)
    one, two = (sorted(map(str, batch.search_all(named, language_map, asked, i).select("request_id", *GLOSSARY_SCHEMA_NAMES).collect())) for i in (None, index))
    assert one == two and len(one) > 20
    assert any("gram,world" in f.replace(" ", "") or "EqualTo(gram" in f or "In(gram" in f for f in inspect.scan_filters(postings.lookup(index, named, "world"))["PushedFilters"])


def test_requests_for_unknown_releases_stay_marked(spark, glossary):
    asked = batch.with_release_status(spark.createDataFrame([*REQUESTS, (14, "ios", "x", "q", None, []), (15, None, None, "q", None, [])], ASKED), glossary)
    got = {r["request_id"]: (r["version"], r["release_status"]) for r in asked.collect()}
    assert len(got) == len(REQUESTS) + 2 and got[1] == (26, "ok") and got[7] == (99, "unknown_version") and got[13] == (1, "unknown_platform")
    assert got[14] == (None, "unknown_version") and got[15] == (None, "unknown_platform")
    assert {r[0] for r in batch.resolve_versions(spark.createDataFrame(REQUESTS, ASKED), glossary).select("request_id").collect()} == {k for k, (_, s) in got.items() if s == "ok"}


def test_row_numbers_follow_the_total_order_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(batch, "RANGE", 3)
    rng = random.Random(2)
    made = [(rng.choice([1, 2, 3]), *row(rng.randint(0, 40), rng.choice([*range(30), None]), "s", f"t{rng.randint(0, 3)}", rng.choice(["en", "fr", None]))) for _ in range(600)]
    df = spark.createDataFrame(made, "request_id long, " + GLOSSARY_SCHEMA)
    got = {}
    for r in batch.numbered(df).collect():
        got.setdefault(r["request_id"], []).append((r["row_number"], *(r[c] for c in total_order())))
    for k, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, sum(m[0] == k for m in made) + 1))
        keys = [tuple((x is not None, x if x is not None else 0) for x in r[1:]) for r in rows]
        assert keys == sorted(keys)


def test_every_kind_of_white_space_is_trimmed(spark):
    blanks = " \t\n\x0b\x0c\r\u00a0\u2003\u2028\ufeff\u3000"
    df = spark.createDataFrame([(blanks + "a b" + blanks, blanks), ("x", None)], "q string, bundle string")
    assert [tuple(r) for r in batch.clean(df, "q", "bundle").collect()] == [("a b", ""), ("x", None)]


def test_language_maps_from_files(spark, language_map, tmp_path):
    source.write_language_map(language_map, str(tmp_path / "maps"))
    files = list((tmp_path / "maps").glob("platform=*/version=*/*.txt"))
    assert len(files) == 3 and all(f.read_text().startswith("{") for f in files)
    same = lambda df: sorted(map(str, df.select("platform", "version", "language_name", "code").collect()))
    assert same(source.read_language_map(spark, str(tmp_path / "maps"))) == same(language_map)


def test_batch_columns_equal_single(spark, glossary, language_map):
    asked = [(k, "ios", 26, a, o, q, lang) for k, (a, o, q, lang) in enumerate((a, o, q, lang) for a in COLUMNS for o in OPERATORS for q in ("a", "b1", "en", "Hello world") for lang in ([], ["English"]))]
    df = spark.createDataFrame([*asked, (900, "ios", 26, "nope", "equal", "x", []), (901, "ios", 26, "key", "equal", "", [])], "request_id long, platform string, version int, column_alias string, operator string, q string, languages array<string>")
    got = {}
    for r in batch.search_columns(glossary, language_map, df).collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    rows = [r for r in glossary.collect() if (r["platform"], r["version"]) == ("ios", 26)]
    test = {"equal": lambda x, q: x == q, "notEqual": lambda x, q: x != q, "startsWith": lambda x, q: x.startswith(q)}
    for k, _, _, a, o, q, lang in asked:
        codes = CODES["English"] if lang else [c for v in CODES.values() for c in v]
        want = [r["id"] for r in rows if r["language"] in codes and r[COLUMNS[a]] is not None and test[o](r[COLUMNS[a]], q)]
        assert sorted(map(str, got.get(k, []))) == sorted(map(str, want)), (a, o, q)
    assert not {900, 901} & set(got)


def test_request_fields(spark):
    df = spark.createDataFrame([("0", "9999"), ("", ""), ("abc", "x"), (" 3 ", "50"), ("-3", "0"), (None, None)], "page string, size string")
    assert [(r["page_number"], r["page_size"], r["row_offset"]) for r in batch.paging(df).collect()] == [(1, 200, 0), (1, 200, 0), (1, 200, 0), (3, 50, 100), (1, 1, 0), (1, 200, 0)]
    df = spark.createDataFrame([("nope", "like", ""), ("key", "like", ""), ("key", "equal", None), (None, "equal", "x"), ("file", "notEqual", "x")], "column_alias string, operator string, q string")
    assert [r[0] for r in df.select(batch.column_status()).collect()] == ["bad_column", "bad_operator", "empty_query", "bad_column", "ok"]


def test_response_documents(spark, glossary, language_map, tmp_path):
    asked = batch.resolve_versions(spark.createDataFrame(REQUESTS, "request_id long, platform string, version string, q string, bundle string, languages array<string>"), glossary)
    found = batch.search_all(glossary, language_map, asked)
    total = asked.select("request_id", F.lit("1").alias("page"), F.lit("200").alias("size")).join(batch.totals(found), "request_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    out = source.response_documents(batch.first_pages(found), batch.with_pages(batch.paging(total)))
    out.write.json(str(tmp_path / "out"))
    got = {r["request_id"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert [d["id"] for d in got[1]["data"]] == [3, 1, 2] and got[1]["total"] == 3 and got[1]["last_page"] == 1
    assert got[5]["data"] == [] and got[5]["total"] == 0 and got[5]["last_page"] == 0


def test_response_documents_hold_the_requested_page(spark):
    from lexicarta.queries import QUERIES

    rows = spark.createDataFrame([(r, *row(k, k, "s", f"t{k}", "en")) for r in (1, 2, 3, 4) for k in range(130)], "request_id long, " + GLOSSARY_SCHEMA)
    asked = spark.createDataFrame([(1, "2", "50"), (2, "3", "50"), (3, "4", "50"), (4, None, None)], "request_id long, page string, size string")
    got = {}
    for r in batch.requested_pages(rows, batch.paging(asked)).collect():
        got.setdefault(r["request_id"], set()).add(r["id"])
    assert got == {1: set(range(50, 100)), 2: set(range(100, 130)), 4: set(range(130))}
    for r in QUERIES["response_documents"](spark, SMALL).join(batch.paging(fixtures.requests(spark, SMALL)), "request_id").collect():
        assert len(r["data"]) == max(0, min(r["page_size"], r["total"] - r["row_offset"]))


def test_postings_equal_the_scan(spark, glossary):
    rng = random.Random(6)
    made = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame([row(k, k, "s", t, "en") for k, t in enumerate(made)] + [row(999, 1, "s", None, "en")], GLOSSARY_SCHEMA)
    index = postings.build(df)
    terms = ["ab", "a", "abé", "é😀", "aba ", "bbbb", "a😀b", "zzz"] + ["".join(rng.choice("abé ") for _ in range(4)) for _ in range(6)]
    for term in terms:
        want = sorted(k for k, t in enumerate(made) if text.normalise(term) in text.normalise(t))
        assert sorted(r["id"] for r in postings.lookup(index, df, term).collect()) == want, term
    asked = spark.createDataFrame([(k, "ios", 26, t) for k, t in enumerate(terms)], "request_id long, platform string, version int, q string")
    got = {(r["request_id"], r["id"]) for r in postings.batch_matches(index, df, asked).collect()}
    assert got == {(k, i) for k, term in enumerate(terms) if len(term) >= 3 for i, t in enumerate(made) if text.normalise(term) in text.normalise(t)}


def test_batch_lookup_answers_short_and_wide_terms(spark):
    made = ["abc def", "ﬁne day", "xa", "", None, "ＡＢＣ"]
    df = source.with_normalised_target(spark.createDataFrame([row(k, k, "s", t, "en") for k, t in enumerate(made)], GLOSSARY_SCHEMA))
    terms = ["a", "ab", "ＡＢＣ", "ﬁ", "ﬁne", "", "day"]
    asked = spark.createDataFrame([(k, "ios", 26, t) for k, t in enumerate(terms)], "request_id long, platform string, version int, q string")
    got = {(r["request_id"], r["id"]) for r in postings.batch_lookup(postings.build(df), df, asked).collect()}
    assert got == {(k, i) for k, term in enumerate(terms) if term for i, t in enumerate(made) if t and text.normalise(term) in text.normalise(t)}


def test_partitioned_dataset_and_plans(spark, glossary, language_map, tmp_path):
    path = str(tmp_path / "glossary")
    parts = {(p, v): glossary.where((F.col("platform") == p) & (F.col("version") == v)).drop("platform", "version") for p, v in (("ios", 26), ("ios", 18), ("macos", 26))}
    source.write_glossary(source.with_normalised_target(source.unify(parts)), path)
    stored = spark.read.schema(GLOSSARY_SCHEMA).parquet(path)
    assert sorted(map(str, stored.select(*GLOSSARY_SCHEMA_NAMES).collect())) == sorted(map(str, glossary.select(*GLOSSARY_SCHEMA_NAMES).collect()))
    r = search.search(stored, language_map, "ios", 26, term="hello")
    seen = inspect.scan_filters(r.rows)
    assert all("platform" in f and "version" in f for f in seen["PartitionFilters"]) and len(seen["PartitionFilters"]) >= 2
    assert any("StringContains(target_norm,hello)" in f for f in seen["PushedFilters"])
    assert "LeftSemi" in inspect.physical(r.rows) and inspect.python_nodes(r.rows) == []
    assert "TakeOrderedAndProject" in inspect.physical(r.page())
    c = search.search_column(stored, language_map, "ios", 26, "key", "startsWith", "a_b")
    assert any("StringStartsWith(source,a_b)" in f for f in inspect.scan_filters(c.rows)["PushedFilters"])
    total = inspect.scan_filters(c.total())["ReadSchema"][0]
    assert "target" not in total and "file_name" not in total
    assert "WindowGroupLimit" in inspect.physical(batch.first_pages(stored.withColumn("request_id", F.col("id") % 3), 5))


GLOSSARY_SCHEMA_NAMES = [c.split()[0] for c in GLOSSARY_SCHEMA.split(", ")]


def test_fixture_map_leaves_codes_out(spark):
    g = fixtures.glossary_docs(spark, SMALL)
    unmapped = g.join(fixtures.language_map(g).withColumnRenamed("code", "language"), ["platform", "version", "language"], "left_anti")
    assert unmapped.count() > 0 and {r[0] for r in unmapped.select("version").distinct().collect()} == {15}
