"""Normalizers, numbers and similarities on hand-made cases."""

from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions import fuzzy, numbers, similarity, text
from ravelin.operators import normalize

NAMES = [
    ("Acme & Sons Pvt. Ltd.", "H.No 14/2, M.G. Rd, Near SBI 560001"),
    ("Café №5", "12-B Main St 94105-1234"),
    ("7 Eleven", "AF-0684 Park Ave"),
    ("X", "AF-0684 Park Ave"),
    ("Shop", "Plot 0042"),
    ("ACME ＬＴＤ", ""),
    ("हिन्दी", None),
    (None, None),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(f"S1-{k}", n, a, "U.S.A.") for k, (n, a) in enumerate(NAMES)]
    frame = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    return {int(r.entity_id[3:]): r for r in normalize.spec(frame).collect()}


def test_normalized_names(records):
    assert [records[k].name_norm for k in range(8)] == ["acme and sons pvt ltd", "café no5", "7 eleven", "x", "shop", "acme ltd", "ह न द", ""]
    assert records[0].address_norm == "house house 14 2 m g road near sbi 560001"
    assert records[0].name_core == "acme and sons" and records[0].name_compact == "acmeandsonspvtltd"
    assert records[1].name_translit == "cafe no5" and records[6].name_translit == "h n d"
    assert {r.country_norm for r in records.values()} == {"united states"}
    assert [records[k].address_missing for k in (0, 5, 6, 7)] == [0, 1, 1, 1]


def test_numbers(records):
    assert [records[k].house_number for k in (0, 2, 4, 5)] == ["142", "7", "42", ""]
    assert records[0].numeric_tokens == ["14", "2", "560001"] and records[0].numeric_signature == "14|2|560001"
    assert [records[k].postal_candidate for k in (0, 1, 2, 5)] == ["560001", "94105", "", ""]
    assert records[3].house_number == "684" and records[2].numeric_signature == "0684|7"


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("name", "core"), [("pvt ltd co inc", "pvt"), ("a pvt ltd co inc", "a pvt"), ("ltd", ""), ("cold", "cold"), ("", ""), ("a ltd b", "a ltd b")])
def test_core(spark, name, core):
    assert column(spark, name, text.name_core) == core


@pytest.mark.parametrize("value", ["ﬁ Ⅷ ²", "é", "ＡＢＣ  ", "plain", "", "ẛ̣", "한"])
def test_unicode_forms(spark, value):
    assert column(spark, value, text.unicode_norm) == unicodedata.normalize("NFKC", value)


def test_translit(spark):
    assert column(spark, "क्षेत्र Straße Œuvre ŁÓDŹ", text.transliterate) == "kshetr straße œuvre łodz"
    assert column(spark, "१२ ग्राम।", text.transliterate_wide) == "12 graam"
    assert column(spark, "़", text.transliterate_wide) == "़"
    assert column(spark, "Ünïcode ŉ", text.ascii_fold) == "Unicode ʼn"


def test_grams(spark):
    assert column(spark, "abab", text.char_grams) == ["#ab", "aba", "bab", "ab#"]
    assert column(spark, "", text.char_grams) == [] and column(spark, None, text.char_grams) == []


def test_views(spark):
    row = spark.createDataFrame([("n", "")], "a string, b string").select(text.view(name=F.col("a"), address=F.col("b")).alias("v"), text.semantic_text(F.col("a"), F.col("b"), F.col("a")).alias("s")).first()
    assert row.v == "name: n" and row.s == "n [SEP] n"


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), ([], ["x"], 0.0), (["x", "x"], ["x"], 1.0), (["x", "y"], ["y", "z"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(similarity.jaccard(F.col("a"), F.col("b")).alias("r"), similarity.jaccard(F.col("a"), F.col("b"), 0.0).alias("z")).first()
    assert row.r == pytest.approx(want) and row.z == (0.0 if not a and not b else pytest.approx(want))


def test_hashed_counts(spark):
    import hashlib

    tokens = ["a", "b", "a", "zebra"]
    got = spark.createDataFrame([(tokens,)], "t array<string>").select(similarity.hashed_counts(F.col("t")).alias("r")).first().r
    want = [0.0] * 256
    for t in tokens:
        want[int(hashlib.md5(t.encode()).hexdigest(), 16) % 256] += 1
    assert got == want


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=20), st.text("abcé ", max_size=20))
def test_fuzzy(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b)
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)
    assert fuzzy.token_sort_ratio(a, b) == pytest.approx(fuzzy.ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    for f in (fuzzy.ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.partial_ratio, fuzzy.weighted_ratio):
        assert 0 <= f(a, b) <= 100
    if a and b:
        short, long = sorted((a, b), key=len)
        pieces = [long[max(0, e - len(short)) : e] for e in range(1, len(long) + len(short))]
        if len(a) != len(b):
            assert fuzzy.partial_ratio(a, b) == pytest.approx(max(fuzzy.ratio(short, p) for p in pieces))


def test_known_ratios():
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert fuzzy.partial_ratio("this is a test", "this is a test!") == 100
    assert fuzzy.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)


def test_house_numbers(spark):
    assert column(spark, "12/3 Main 4b, x5 6-7a 12345678", numbers.house_numbers) == ["12/3", "4b", "6-7a"]
    assert column(spark, "000", numbers.canon_house) == "0" and column(spark, " 00-12 / B", numbers.canon_house) == "12b"
