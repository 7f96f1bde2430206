"""Native operators on random texts of awkward parts, against brute force."""

from __future__ import annotations

import hashlib
import random

from ravelin.llm import quality, secrets
from ravelin.llm.common import numbered
from tests.llm.test_operators import brute_quality, brute_secrets

SECRET_PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "abcdef1", "é", "\U0001f600", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "\n", "--", "ſecret", "toKen", "K"]
QUALITY_PARTS = ["a", "b", "bb", "\x1c", "\x85", " ", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "#", "<|>", "é", "\U0001f600", "\n\n", "a b a", "x y z x y z", "line\n", "line\n"]


def made(parts: list[str], n: int, most: int) -> list[tuple[int, str]]:
    random.seed(12)
    return [(k, "".join(random.choices(parts, k=random.randint(0, most)))) for k in range(n)]


def test_secrets(spark):
    rows = made(SECRET_PARTS, 3000, 30)
    got = secrets.scan(numbered(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string"))).collect()
    texts = dict(rows)
    for r in got:
        counts, listed = brute_secrets(texts[r.doc_id])
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == (counts, hashlib.sha256(listed.encode()).hexdigest()), texts[r.doc_id]


def test_many_matches_in_one_text(spark):
    text = "é token=abcdef1 " * 3000
    row = secrets.scan(numbered(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string"))).first()
    counts, listed = brute_secrets(text)
    assert row.n_assign == 3000 == counts[0] and row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_quality(spark):
    rows = made(QUALITY_PARTS, 3000, 60)
    texts = dict(rows)
    for r in quality.judge(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), repr(texts[r.doc_id])
