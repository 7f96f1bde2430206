"""Each operator against a brute-force version, on real documents, odd ones and an empty table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ravelin.llm import langid, lm, media, packing, pieces, pii, quality, secrets, simhash, substring
from ravelin.llm.common import RID, numbered
from ravelin.llm.components import components
from ravelin.llm.queries import tokenizer_file

BPE = tokenizer_file("byte_bpe_50k.json")
SP = tokenizer_file("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def bag(rows, key):
    return sorted((tuple(map(repr, key(r))) for r in rows))


@pytest.fixture(params=["docs", "odd_docs", "no_docs"])
def table(request):
    return request.getfixturevalue(request.param)


# op1 -----------------------------------------------------------------------------------------------------------------


def test_media(table):
    got = media.media_digest(table).collect()

    def expected(doc_id, text):
        raw = (text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        return doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])

    assert bag(got, lambda r: (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) == bag(rows_of(table), lambda r: expected(*r))
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


# op2 -----------------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = WORD.findall(ascii_lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        root = find(i)
        if x is not None:
            least[root] = min(x, least.get(root, x))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(table):
    got = simhash.near_duplicate_groups(numbered(table)).collect()
    rows = rows_of(table)
    prints = [brute_print(t) for _, t in rows]
    groups = brute_components(prints, [d for d, _ in rows])
    assert bag(got, lambda r: (r.doc_id, r.fp % 2**64, r.component_id)) == sorted(tuple(map(repr, x)) for x in zip([d for d, _ in rows], prints, groups, strict=True))


def test_keep_one_with_repeated_ids(spark):
    """Texts that nothing links stay apart, though their groups have the same least id."""
    texts = [" ".join(f"{p}{k}" for k in range(40)) for p in "ab"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(rows_of(kept)) == sorted(rows[:2])


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = rows_of(odd_docs)
    groups = set(zip(brute_components([brute_print(t) for _, t in rows], [d for d, _ in rows]), strict=True))
    assert kept.count() == len(groups)
    assert simhash.keep_one(no_docs).count() == 0


def test_links_of_all_patterns():
    """Every pair of bits, in every segment, gives a common key."""
    import numpy as np

    decoder = simhash.GolayDecoder()
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for word in base:
        flips = [1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 64, (60, 2))]
        near = np.array([word, *(int(word) ^ f for f in flips)], np.uint64)
        keys, at = simhash.golay_keys(near, decoder)
        own = set(keys[at == 0])
        assert all(own & set(keys[at == k]) for k in range(1, len(near)))


def test_every_word_is_near_a_codeword():
    import numpy as np

    decoder = simhash.GolayDecoder()
    words = np.arange(1 << 23, step=37, dtype=np.uint32)
    assert (np.bitwise_count(decoder.error) <= 3).all()
    codes = words ^ decoder.error[decoder.low[words & 0xFFF] ^ decoder.high[words >> 12]]
    assert (decoder.low[codes & 0xFFF] ^ decoder.high[codes >> 12] == 0).all()


def test_dense_groups(spark):
    """Chains and balls of fingerprints with buckets beyond the list bound."""
    import random

    random.seed(4)
    prints = {0, 1 << 63}
    while len(prints) < 900:
        x = random.choice(list(prints))
        prints.add(x ^ 1 << random.randrange(12) ^ 1 << random.randrange(64))
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 2 for r in found)
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[find(r.u)] = find(r.v)
    ids = list(range(len(signed)))
    truth = brute_components([x % 2**64 for x in signed], ids)
    mine = defaultdict(set)
    for k, x in enumerate(signed):
        mine[find(x)].add(truth[k])
    assert len(mine) == len(set(truth)) and all(len(x) == 1 for x in mine.values())


# op3 -----------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    names = ("assign", "access", "hex")
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return tuple(sum(k == x for _, k, _ in spans) for x in range(3)), listed


def test_secrets(table):
    got = secrets.scan(numbered(table)).collect()

    def expected(doc_id, text):
        counts, listed = brute_secrets(text)
        return doc_id, *counts, hashlib.sha256(listed.encode()).hexdigest()

    assert bag(got, lambda r: (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) == bag(rows_of(table), lambda r: expected(*r))
    texts = defaultdict(set)
    for d, t in rows_of(table):
        texts[d].add(brute_secrets(t)[1])
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("blob"))
        assert base in texts[r.doc_id]


def test_secret_owners(spark):
    live = "Zx9Kq2Lm7Rt4Wv8Yb3Nc6"
    rows = [(k, f"token={'CommonExample123' if k < 4 else 'OnlyHere98765xyz'} {live if k == 9 else ''}", "en", f"src{k}") for k in range(4)] + [(9, f"token=OnlyHere98765xyz {live}", "en", "src9")]
    got = {r.doc_id: r for r in secrets.scan(numbered(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert all(got[k].n_copied == 1 and got[k].n_live == 0 for k in range(4))
    assert got[9].n_live == 2 and got[9].spans.endswith("blob:23:44") and got[9].n_copied == 0


def test_secret_repositories(spark):
    """One owner's value counts as copied in many repositories, or very often in one; owners alone don't decide."""
    value = lambda n: f"Kq7Zm{n}Xw2Rt9LpVb4Yc8Nd"
    rows = [(k, f"x {value(1)} y", f"repo{k}", "one") for k in range(secrets.COPIED_REPOS)]  # many repositories
    rows += [(100 + k, f"x {value(2)} y", "repo0", "one") for k in range(500)]  # many times
    rows += [(700 + k, f"x {value(3)} y", f"repo{k}", "one") for k in range(secrets.COPIED_REPOS - 1)]  # a few of either
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secrets.scan(numbered(frame)).collect()}
    assert all((got[k].n_live, got[k].spans) == ((0, "") if k < 700 else (1, "blob:2:24")) for k, *_ in rows)
    texts = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert texts[0] == rows[0][1] and texts[700] == "x [SECRET] y"
    marked = spark.createDataFrame([(k, "token=abcdefg1 secret=OnlyHere9", "en", f"src{k}") for k in range(3)] + [(3, "token=abcdefg1 secret=OnlyHere7", "en", "src3")], "doc_id long, text string, lang string, source string")
    assert [r.text for r in secrets.redact(marked).orderBy("doc_id").collect()] == ["[EXAMPLE] [EXAMPLE]"] * 3 + ["[EXAMPLE] [SECRET]"]


def test_redaction(odd_docs):
    got = {r.doc_id: r.text for r in secrets.redact(odd_docs).select("doc_id", "text").collect()}
    assert got[8] == "[SECRET]\" and token: abc and [SECRET] [SECRET]"
    assert got[3] is None and got[11] == "12345 !!! ???"


# op4 -----------------------------------------------------------------------------------------------------------------


def test_packing(table):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(BPE)
    whole = [(d, slow.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows_of(table)]
    got = packing.pack(table, BPE, with_ids=True).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.05 * (total + padding)
    assert total == sum(len(ids) for _, ids in whole)
    ids_of = defaultdict(list)
    for d, ids in whole:
        ids_of[d, len(ids)].append(ids)
    for key, parts in documents.items():
        copies = ids_of.pop(key)
        counted = Counter((s, tuple(i)) for s, i in parts)
        for start, ids in {(s, tuple(i)) for s, i in parts}:
            assert any(tuple(c[start : start + len(ids)]) == ids for c in copies)
        assert sum(len(i) for _, i in parts) == sum(map(len, copies)) and counted
    assert not ids_of


def test_unusual_texts_have_the_same_ids():
    import random

    bpe = packing.ByteBpe(BPE)
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choices([chr(c) for c in range(0x300)] + ["<|endoftext|>", "日本", "\U0001f600", "  ", "\n\n", "'ll"], k=25))
        assert bpe.ids(text).tolist() == bpe.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [1, 2, 31, 63, 64, 65, 1023, 1024, 1025, 1500, 2047, 2048, 2049, 5000])
def test_cuts(length):
    parts = packing.cut(length)
    assert sum(parts) == length and all(0 < p <= 2048 for p in parts)


# op5 -----------------------------------------------------------------------------------------------------------------


def brute_personal(text):
    text = text or ""
    spans = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0:
            spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return spans


def test_personal_data(table):
    got = pii.personal_rows(table.select("doc_id", "text")).collect()

    def expected(doc_id, text):
        spans = brute_personal(text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        return doc_id, *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()

    assert bag(got, lambda r: (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) == bag(rows_of(table), lambda r: expected(*r))


def test_personal_patterns():
    import random

    random.seed(3)
    for _ in range(4000):
        text = "".join(random.choices(["a", "Z", "1", "23", "255", ".", "@", "-", " ", "+", "(", "é", "00", "4111111111111111", "a@b.c"], k=14))
        assert [s for s in pii.base_spans(text)] == brute_personal(text)


def test_booster_learns():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    model = pii.Booster.train(x, y)
    fresh = rng.normal(size=(1000, 5))
    truth = (fresh[:, 0] > 0.3) & (fresh[:, 2] < 0.5)
    assert ((model.probability(fresh) > 0.5) == truth).mean() > 0.95
    assert pii.Booster.train(x, np.zeros(3000)) is None


def test_personal_redaction(odd_docs):
    got = {r.doc_id: r.text for r in pii.redact(odd_docs, None).select("doc_id", "text").collect()}
    assert got[10] == "mail [EMAIL], [IP], 300.1.1.1, [CARD], [PHONE] \U0001f600 x@[EMAIL]"
    assert got[3] is None


def test_added_spans_look_like_confirmed_ones(docs):
    rows = docs.select("doc_id", "text")
    booster = pii.learn(rows)
    for r in pii.scan(rows, booster).filter("n_added > 0").collect():
        base = [s for s in r.spans.split(",") if s.split(":")[0] in pii.KINDS]
        assert len(r.spans.split(",")) == len(base) + r.n_added


def test_personal_data_beyond_base_patterns(spark):
    """Formats that no base pattern has are found in texts that training hasn't seen; dates, prices and codes are not."""
    import random

    rng = random.Random(9)
    n = lambda k: "".join(rng.choices("123456789", k=k))
    name = lambda: "".join(rng.choices("abcdefghij", k=6))
    real = [lambda: f"{name()} (at) {name()} dot org", lambda: f"{name()} [at] {name()} [dot] com", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}"]
    other = [lambda: f"20{rng.randint(10, 24)}-0{n(1)}-1{n(1)}", lambda: f"order{n(6)}", lambda: f"{n(9)}", lambda: f"{name()}@{name()}.com", lambda: f"+1 {n(3)} {n(3)} {n(4)}"]
    texts = [(k, f"we saw {rng.choice(real + other)()} there and {rng.choice(real + other)()} too") for k in range(2000)]
    booster = pii.learn(spark.createDataFrame(texts, "doc_id long, text string"))
    found = [[f"so {s} it was"[a:b] for _, a, b in pii.find(f"so {s} it was", booster)[1]] == [s] for s in (make() for make in real for _ in range(20))]
    wrong = [bool(pii.find(f"so {make()} it was", booster)[1]) for make in other for _ in range(20)]
    assert sum(found) >= 0.95 * len(found) and not any(wrong)


# op6 -----------------------------------------------------------------------------------------------------------------


def test_language_model(table):
    got = lm.score(table).collect()
    rows = rows_of(table)
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[*WORD.findall(ascii_lower(t or "")), "\n"] for _, t in rows]
    counts = Counter(w for h, ws in zip(held, tokens, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = [(d, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for (d, _), h, ws in zip(rows, held, tokens, strict=True)]
    key = lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))
    assert bag(got, key) == sorted(tuple(map(repr, x)) for x in expected)
    assert all(r.score < 0 for r in got)


def test_model_is_normalised_and_better(docs):
    import numpy as np

    model = lm.LogBilinear.start(np.arange(lm.CLASSES)[::-1] * 10)
    rng = np.random.default_rng(1)
    keys = (rng.integers(0, 3, 50_000) * (lm.CLASSES + 1) + rng.integers(0, 4, 50_000)) * lm.CLASSES
    keys = keys + keys // lm.CLASSES % (lm.CLASSES + 1)  # a class follows itself
    uniq, n = np.unique(keys, return_counts=True)
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    for turn in range(150):
        model.fit(uniq, n.astype(float), noise, seed=turn)
    near, far, z = model.tables()
    p = np.exp(near[2] + far[1] - z[1, 2])
    assert abs(p.sum() - 1) < 1e-9 and p.argmax() == 2
    held = [r for r in lm.score(docs).collect() if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# op7 -----------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(table):
    got = quality.judge(table).collect()
    key = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert bag(got, key) == bag(rows_of(table), lambda r: (r[0], *brute_quality(r[1])))
    assert all(not r.kept or not r.base_failed for r in got)


def test_quality_sql(spark):
    import duckdb

    from ravelin.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.execute(sql).df()
        got = queries.queries()[name](spark, "/root/testdata/sf0.01").toPandas()[list(want.columns)]
        assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, want.values.tolist()))


def test_bad_hosts(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(k, "short", "bad.example") for k in range(60)] + [(100, good, "bad.example")] + [(200 + h * 20 + k, good, f"good{h}.example") for h in range(5) for k in range(20)] + [(500, "short", "good0.example")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[100].host_failed and not got[100].kept and not got[100].base_failed
    assert got[200].kept and not got[500].kept and not got[500].host_failed


def test_host_limit_follows_the_corpus(spark):
    """A host with half of its documents short fails where hosts are good, and doesn't where all are like that."""
    good = " ".join(f"w{k}" for k in range(80))
    text = lambda h, k, all_bad: "short" if (all_bad or h == 0) and k % 2 else good
    for all_bad in (False, True):
        rows = [(h * 20 + k, text(h, k, all_bad), f"host{h}") for h in range(40) for k in range(20)]
        got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert {r.host for r in got if r.host_failed} == (set() if all_bad else {"host0"})


# op8 -----------------------------------------------------------------------------------------------------------------


def test_languages(docs, odd_docs, no_docs):
    got = langid.language_rows(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    odd = {r.doc_id: r for r in langid.language_rows(odd_docs).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[11].lang_pred == "und" and odd[11].score == 0
    assert langid.language_rows(no_docs).count() == 0


def test_rank_distance():
    """The vectorised distance against one made of dictionaries."""
    texts = {"a": "the cat and the dog and the hat", "b": "le chat et le chien et le chapeau"}

    def grams(text):
        text = re.sub("[^a-z]+", "_", f" {text} ")
        return Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1) if text[i : i + n] != "_")

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | (langid.BOUNDARY if c == "_" else ord(c))
        return out

    order = {k: [code(g) for g, _ in sorted(grams(t).items(), key=lambda x: (-x[1], code(x[0])))] for k, t in texts.items()}
    profiles = langid.Profiles.of(order, 400)
    mine = [code(g) for g, _ in sorted(grams("the chat and the chien").items(), key=lambda x: (-x[1], code(x[0])))]
    far = {k: sum(min(400, abs(v.index(g) - i)) if g in v else 400 for i, g in enumerate(mine)) for k, v in order.items()}
    best = min(far, key=far.get)
    assert profiles.predict("the chat and the chien") == (best, pytest.approx(1 - far[best] / (400 * len(mine))))


# op9 -----------------------------------------------------------------------------------------------------------------


def check_passages(frame):
    rows = [(r[RID], WORD.findall(ascii_lower(r.text or ""))) for r in numbered(frame).select(RID, "text").collect()]
    words = dict(rows)
    found = substring.passages(numbered(frame)).collect()
    covered = defaultdict(set)
    for r in found:
        assert r.other < r.rid and r.similarity >= 0.8
        a, b = words[r.rid][r.start_word : r.end_word], words[r.other][r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50
        if r.similarity == 1:
            assert a == b
        covered[r.rid].update(range(r.start_word, r.end_word))
    first = {}
    for rid, ws in sorted(rows):
        for i in range(len(ws) - 49):
            key = tuple(ws[i : i + 50])
            if first.setdefault(key, rid) != rid:
                assert covered[rid] >= set(range(i, i + 50)), (rid, i)
    return found


def test_passages(table):
    check_passages(table)


def test_star_around_a_stranger(spark):
    """The first row shares only a line with two others that share a passage around that line."""
    line = " ".join(f"common{k}" for k in range(30))
    passage = f"{' '.join(f'left{k}' for k in range(20))} {line} {' '.join(f'right{k}' for k in range(20))}"
    pad = lambda p: " ".join(f"{p}{k}" for k in range(60))
    texts = [f"{pad('a')} {line} {pad('b')}", f"{pad('c')} {passage} {pad('d')}", f"{pad('e')} {passage} {pad('f')}"]
    found = check_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    assert [(r.start_word, r.end_word) for r in found] == [(60, 130)]


@pytest.mark.parametrize("lines", [1, 2])
def test_near_star_around_strangers(spark, lines):
    """Earlier rows have only the lines that a near passage of two later rows is made of."""
    pad = lambda p, n=60: " ".join(f"{p}{k}" for k in range(n))
    parts = [pad(f"line{k}x", 70 // lines - 8) for k in range(lines)]
    if lines == 1:
        parts = [pad("left", 24), pad("line", 20), pad("right", 25)]
        early = [parts[1]]
    else:
        early = parts
    near = [" ".join(parts), f" {'x ' * (lines == 2)}".join(parts)] if lines == 2 else [" ".join(parts), " ".join(parts).replace("line10 ", "other ")]
    texts = [f"{pad(f'a{k}')} {line} {pad(f'b{k}')}" for k, line in enumerate(early)]
    texts += [f"{pad(f'c{k}')} {passage} {pad(f'd{k}')}" for k, passage in enumerate(near)]
    found = check_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    size = len(near[1].split())
    assert [(r.start_word, r.end_word) for r in found] == [(60, 60 + size)] and found[0].similarity < 1


def test_near_passage(spark):
    words = [f"w{k}" for k in range(120)]
    changed = words[:60] + ["other"] + words[61:]
    texts = [" ".join(["x"] * 10 + words), " ".join(["y"] * 7 + changed + ["z"] * 9)]
    found = substring.passages(numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))).collect()
    assert len(found) == 1 and found[0].start_word == 7 and found[0].end_word == 127 and 0.8 <= found[0].similarity < 1


def brute_similarity(a, b):
    x, y = (Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def near_pairs(tries, least=50, most=200, seed=3):
    """(similarity, words, changed words): a passage and one with edits at random places, from 0.8 on."""
    import random

    rng = random.Random(seed)
    for n in range(tries):
        words = [f"n{n}.{k}" for k in range(rng.randint(least, most))]
        changed = list(words)
        for k in range(rng.randint(1, max(1, len(words) // 25))):
            at, kind = rng.randrange(len(changed)), rng.randrange(3)
            changed[at : at + (kind != 1)] = [] if kind == 0 else [f"new{n}.{k}"]
        alike = brute_similarity(words, changed)
        if alike >= 0.8 and len(changed) >= 50:
            yield alike, words, changed


def test_recall_of_signatures():
    """Near passages inside longer texts have a signature in common, at the limit of similarity and of length too."""
    shared = lambda a, b, n: bool(substring.anchors_of(" ".join([f"a{n}.{k}" for k in range(60)] + a)) & substring.anchors_of(" ".join(b + [f"b{n}.{k}" for k in range(60)])))
    any_place = [shared(a, b, n) for n, (_, a, b) in enumerate(near_pairs(400))]
    assert len(any_place) > 200 and np.mean(any_place) >= 0.99
    words = [f"k{n}" for n in range(51)]
    limit = []
    for k in range(5, 46):
        for new in ("new", "newer", "newest", "other", "another"):
            changed = [*words[:k], new, *words[k + 1 :]]
            if brute_similarity(words, changed) >= 0.8:
                limit.append(shared(words, changed, k))
    assert len(limit) > 100 and np.mean(limit) >= 0.9
    # exact stretches of 50 words always have all of them in common
    for n in range(20):
        exact = [f"e{n}.{k}" for k in range(50)]
        assert shared(exact, exact, n)


def test_signatures_are_joined_windows():
    """A band's signatures are those of the stretches that a compact window of each of its functions holds."""
    rng = np.random.default_rng(9)
    hashes = rng.integers(0, 2**63, 300).astype(np.uint64)
    for band in range(substring.BANDS):
        want = [None] * (300 - substring.WINDOW + 1)
        for k in range(substring.FUNCTIONS):
            values = substring._mixed(hashes, 1000 + band * substring.FUNCTIONS + k)
            for left, c, right in substring.compact_windows(values, substring.WINDOW):
                for start in range(max(left, c - substring.WINDOW + 1), min(c, right - substring.WINDOW + 1) + 1):
                    want[start] = (want[start] or ()) + (int(values[c]),)
        got = substring.signatures(hashes, band).tolist()
        assert all(len(w) == substring.FUNCTIONS for w in want)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_near_passages_behind_strangers(spark):
    """Two later rows share a near passage; an earlier one has a part of it only. Nine pairs of ten and more are found."""
    rows, number = [], 0
    for n, (_, a, b) in enumerate(near_pairs(40, 60, 160, seed=8)):
        at = len(a) // 3
        pad = lambda p: " ".join(f"{p}{n}.{k}" for k in range(55))  # noqa: B023, E731
        for text in (f"{pad('p')} {' '.join(a[at : at + 20])} {pad('q')}", f"{pad('r')} {' '.join(a)} {pad('s')}", f"{pad('t')} {' '.join(b)} {pad('u')}"):
            rows.append((len(rows), text))
        number += 1
    found = {r.rid for r in substring.passages(numbered(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect()}
    assert number >= 20 and found <= set(range(2, 3 * number, 3)) and len(found) >= 0.9 * number


def test_near_passages_behind_many_strangers(spark):
    """Earlier rows have a part of a near passage each, so that most signatures of it are theirs: other centres are tried, until
    no new pair comes up."""
    rows = []
    for n in range(60):
        words = [f"n{n}.{k}" for k in range(54)]
        other = [*words[: 3 + n % 48], f"new{n}", *words[4 + n % 48 :]]
        if not substring.verify(*(substring.word_hashes(" ".join(x)) for x in (words, other))):
            continue
        pad = lambda p: " ".join(f"{p}{n}.{k}" for k in range(55))  # noqa: B023, E731
        for k, part in enumerate((words[:42], words[12:], words[6:48], words, other)):
            rows.append((len(rows), f"{pad(f'p{k}x')} {' '.join(part)} {pad(f'q{k}x')}"))
    found = {r.rid for r in substring.passages(numbered(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect()}
    later = set(range(4, len(rows), 5))
    print("found", len(found & later), "of", len(later), sorted((r - 4) // 5 for r in later - found))
    assert found <= later and len(later) >= 30 and len(found) >= 0.97 * len(later)


def test_passage_twice_in_a_row(spark):
    """Both copies in the later row are found and cut; the first row keeps its own."""
    words = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    passage = words("shared", 60)
    frame = spark.createDataFrame([(0, f"{words('a', 30)} {passage}"), (1, f"{passage} {words('b', 30)} {passage} {words('c', 10)}")], "doc_id long, text string").coalesce(1)
    assert sorted((r.start_word, r.end_word) for r in check_passages(frame)) == [(0, 60), (90, 150)]
    assert [r.text for r in substring.remove_repeats(frame).orderBy("doc_id").collect()] == [f"{words('a', 30)} {passage}", f" {words('b', 30)} {words('c', 10)}"]


def test_clashing_names(odd_docs):
    """Columns that bear internal names come back with their values."""
    import corpus_pipeline

    odd = odd_docs.selectExpr("*", "doc_id AS __spans", "doc_id AS __lang", "doc_id AS __score", "doc_id AS __ravelin_rid", "doc_id AS kept0")
    for work in (substring.remove_repeats, secrets.redact, simhash.keep_one, lambda d: corpus_pipeline.language_id(None, d, "")):
        out = work(odd)
        assert out.columns == odd.columns
        assert out.filter("not (__spans <=> doc_id and __lang <=> doc_id and __score <=> doc_id and __ravelin_rid <=> doc_id and kept0 <=> doc_id)").count() == 0


def found_in(a, b):
    return substring.verify(substring.word_hashes(" ".join(a)), substring.word_hashes(" ".join(b)))


def test_edits_and_moves():
    """Passages are found whole wherever brute-force similarity allows, over close, long and moved edits."""
    import random

    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    two = [w if k not in (48, 51) else "new" for k, w in enumerate(words[:100])]
    long = words[:90] + [f"n{k}" for k in range(16)] + words[106:]
    moved = words[:40] + words[55:110] + words[40:55] + words[110:]
    cases = [(words[:100], two), (words, long), (words, moved), (words[:120], words[20:120] + words[:20])]
    for _ in range(150):
        a = words[: rng.randint(60, 200)]
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            at, n = rng.randrange(6, len(b) - 12), rng.randint(0, 6)
            b[at : at + n] = [f"r{rng.random()}" for _ in range(rng.randint(0, 6))]
        cases.append((a, b))
    tried = 0
    for a, b in cases:
        if len(b) >= 50 and brute_similarity(a, b) >= 0.8:
            tried += 1
            for x, y in ((a, b), (b, a)):
                got = found_in([*"pqrst", *x, "end"], [*"uvw", *y, "stop"])
                assert [p[:4] for p in got] == [(5, 5 + len(x), 3, 3 + len(y))], got
                assert got[0][4] == pytest.approx(brute_similarity(x, y))
    assert tried > 50


def test_passage_with_a_later_repeat():
    """A refrain stands early in a text, and again where the common passage is."""
    for k in range(6):
        refrain = " ".join(f"r{k}.{n}" for n in range(40))
        passage = f"{refrain} {' '.join(f't{k}.{n}' for n in range(10))}"
        rest = lambda p: " ".join(f"{p}{k}.{n}" for n in range(60))
        a, b = f"{rest('a')} {passage}".split(), f"{refrain} {rest('b')} {passage} {refrain}".split()
        assert substring.anchors_of(" ".join(a)) & substring.anchors_of(" ".join(b))
        assert [p[:4] for p in found_in(a, b)] == [(60, 110, 100, 150)] and [p[:4] for p in found_in(b, a)] == [(100, 150, 60, 110)]


def test_windows_by_definition():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (5, 40, 90):
        values = rng.integers(0, 50, n).astype(np.uint64)  # with ties
        got = set(substring.compact_windows(values, 5))
        want = set()
        for c in range(n):
            a = c
            while a and values[a - 1] > values[c]:
                a -= 1
            b = c
            while b + 1 < n and values[b + 1] >= values[c]:
                b += 1
            if b - a + 1 >= 5:
                want.add((a, c, b))
        assert got == want


def test_removal(odd_docs, no_docs):
    got = {r.doc_id: r for r in substring.remove_repeats(odd_docs).collect()}
    texts = sorted(got[d].text for d in (6, 7))
    assert sum("shared0" in t for t in texts) == 1 and got[3].text is None
    assert any(t in ("something else\nwith another close", "before it all and then an end") for t in texts)
    assert substring.remove_repeats(no_docs).count() == 0
    assert substring.without("a b  c\nd e ", [(1, 3)]) == "a\nd e "


# op10 ----------------------------------------------------------------------------------------------------------------


def brute_viterbi(model, text):
    if not text:
        return []
    text = pieces.MARK + text.replace(" ", pieces.MARK)
    worth, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        best = None
        for start in range(max(0, end - model.longest), end):
            piece = text[start:end]
            if piece in model.pieces:
                found, ids = model.worth[model.pieces[piece][1]], (model.pieces[piece][0],)
            elif end - start == 1:
                found, ids = model.missing, model.spelled(piece)
            else:
                continue
            if best is None or worth[start] + found > best[0]:
                best = worth[start] + found, start, ids
        worth.append(best[0])
        back.append(best[1:])
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out = list(ids) + out
    return out


def test_pieces(table):
    model = pieces.model_at(SP)
    got = pieces.digest(table, SP).collect()
    short = [(d, (t or "")[:3000]) for d, t in rows_of(table)][:60]
    assert all(model.encode(t) == brute_viterbi(model, t) for _, t in short)
    assert all(r.round_trip for r in got) and len(got) == table.count()
    assert bag(got, lambda r: (r.doc_id, r.n_chars)) == bag(rows_of(table), lambda r: (r[0], len(r[1] or "")))


def test_search_streams(docs, monkeypatch):
    """All ids that are in no table come from the streaming search, with a window that is bounded."""
    model = pieces.Pieces(SP)
    seen = []
    real = pieces.Pieces._stream
    monkeypatch.setattr(pieces.Pieces, "_stream", lambda self, part: seen.append(part) or real(self, part))
    texts = [r.text or "" for r in docs.select("text").limit(60).collect()]
    first = [model.encode(t) for t in texts]
    parts = len(seen)
    assert parts > 1000 and max(map(len, seen)) <= max(map(len, " ".join(texts).split())) + 1
    assert [model.encode(t) for t in texts] == first and all(len(p) > 4 * model.longest for p in seen[parts:])
    long = "abcdefghij" * 3000
    model.most_open = 0
    assert model.encode(long) == brute_viterbi(model, long) and model.most_open <= 8 * model.longest


def test_agreement_with_the_library(docs):
    """Fewest pieces, then ranks, against merging in rank order: most words have the same ids, and lists are no longer."""
    from sentencepiece import SentencePieceProcessor

    library, model = SentencePieceProcessor(model_file=SP), pieces.model_at(SP)
    words = sorted({w for r in docs.select("text").collect() for w in (r.text or "").split()})[:20_000]
    theirs = library.encode(words)
    ours = [model.encode(w) for w in words]
    same = np.mean([a == b for a, b in zip(ours, theirs, strict=True)])
    print("same ids for", same, "of", len(words), "words; pieces", sum(map(len, ours)), sum(map(len, theirs)))
    assert same >= 0.6 and sum(map(len, ours)) <= sum(map(len, theirs))
    for text in ("hello world", "data", "The quick brown fox"):
        assert model.encode(text) == library.encode(text)


def test_streaming_is_whole_viterbi():
    """A vocabulary whose pieces cross spaces and whose paths meet late."""
    import random

    random.seed(6)
    made = {"a": (1, -2.0), "b": (2, -2.0), "ab": (3, -3.5), "ba": (4, -3.4), "aba": (5, -5.2), "b" + pieces.MARK + "a": (6, -4.0), pieces.MARK: (7, -2.5), "bbbb": (8, -7.0)}
    model = pieces.Pieces.of(made, [10 + b for b in range(256)], 0)
    assert not model.apart
    for _ in range(200):
        text = "".join(random.choices("ab c", weights=[5, 5, 2, 1], k=random.randint(1, 200)))
        parts = list(model._stream(pieces.MARK + text.replace(" ", pieces.MARK)))
        assert [i for p in parts for i in p] == brute_viterbi(model, text)
    assert len(list(model._stream("ab" * 500))) > 1


def test_groups_broadcast_nothing(spark):
    """A broadcast side goes through the driver: joins of a table that grows exchange both sides, however small it is now."""
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[: 40 + k % 7] + words[k : k + 2 + k % 3])) for k in range(120)]
    numbered_rows = numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    for out in (simhash.near_duplicate_groups(numbered_rows), simhash.keep_one(numbered_rows.drop("__ravelin_rid")), components(spark.range(50).selectExpr("id u", "id + 1 v"))):
        out.collect()
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
