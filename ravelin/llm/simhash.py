"""SimHash near-duplicate groups by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
[23, 12]. Every 23-bit word lies within 3 bits of exactly one codeword. A segment's keys are the codeword indices of the
word and of all words one bit away: one key where the word is within 2 bits of a codeword, six keys elsewhere. Two words
that differ in at most two bits have a word within one bit of both, so they share a key.

By the pigeonhole principle two wrong bits leave at least one of three segments whole. The wrong bits lie
  * both in one segment: key = that segment's codeword index with the two other segments as they are; or
  * in two segments, one each: key = an index of both with the third segment as it is. One wrong bit turns a segment's
    parity, so a segment of odd parity gives only its own index and one of even parity gives those of its neighbourhood.
Each key table is joined by its key; candidates are verified by their Hamming distance.

Only distinct fingerprints take part, so exact copies of any number count once. A bucket of two is verified from its
aggregated ends. A bucket of up to BUCKET members is verified inside one bounded array, and gives a spanning forest
instead of all pairs. Members of larger buckets are linked by an exact way that is linear in their number: words within
two bits share a word that is within one bit of both, and at most 65 words are within one bit of a word.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import RID, arrow_rows, exchanged, numbered, settle, sheltered, texts_of
from ravelin.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Up to so many members a bucket is verified in one array.
BUCKET = 256
#: Distinct fingerprints whose keys one task makes; a fingerprint has some 40 keys.
PRINTS_OF_TASK = 20_000
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


class GolayDecoder:
    """Vectorised nearest-codeword decoding; a codeword's index is its upper 12 bits, which are systematic."""

    def __init__(self) -> None:
        unit = [_remainder(1 << b) for b in range(23)]
        self.low = np.zeros(1 << 12, np.uint16)
        self.high = np.zeros(1 << 11, np.uint16)
        for table, first in ((self.low, 0), (self.high, 12)):
            for b in range(len(table).bit_length() - 1):
                table[1 << b : 2 << b] = table[: 1 << b] ^ unit[first + b]
        self.error = np.zeros(1 << 11, np.uint32)
        for a in range(23):
            self.error[unit[a]] = 1 << a
            for b in range(a):
                self.error[unit[a] ^ unit[b]] = 1 << a | 1 << b
                for c in range(b):
                    self.error[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c

    def index(self, words: np.ndarray) -> np.ndarray:
        words = words.astype(np.uint32)
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def near(self, words: np.ndarray, bits: int = 23) -> np.ndarray:
        """Row i: the distinct indices of word i and of its neighbours by one of the lower bits, filled up with -1."""
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
        got = np.sort(self.index(words[:, None].astype(np.uint32) ^ flips).astype(np.int32), axis=1)
        again = np.zeros_like(got, bool)
        again[:, 1:] = got[:, 1:] == got[:, :-1]
        got[again] = 1 << 20
        got = np.sort(got, axis=1)[:, :6]
        got[got == 1 << 20] = -1
        return got


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text; zero where it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def golay_keys(prints: np.ndarray, decoder: GolayDecoder) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of the fingerprint of each key). A key has its table's number in the top bits."""
    prints = prints.astype(np.uint64)
    parts = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)) for s, n in SEGMENTS]
    near = [decoder.near(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    odd = [(np.bitwise_count(p) & 1).astype(bool) for p in parts]
    own = [decoder.index(p) for p in parts]
    rows = np.arange(len(prints))
    keys, owners = [], []

    def put(table: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, valid: np.ndarray) -> None:
        # up to 12 + 21 + 22 bits with 3 for the table
        made = (np.uint64(table) << np.uint64(60)) | (a.astype(np.uint64) << np.uint64(44)) | (b.astype(np.uint64) << np.uint64(22)) | c.astype(np.uint64)
        keys.append(made[valid])
        owners.append(np.broadcast_to(rows[:, None], made.shape)[valid])

    for i in range(3):
        j, k = [x for x in range(3) if x != i]
        ones = np.ones((1, near[i].shape[1]), np.uint64)
        put(i, near[i] & 0xFFF, parts[j][:, None] * ones, parts[k][:, None] * ones, near[i] >= 0)
    for i in range(3):  # segment i is whole
        j, k = [x for x in range(3) if x != i]
        sides = []
        for s in (j, k):
            some = near[s].copy()
            some[odd[s]] = -1
            some[odd[s], 0] = own[s][odd[s]]
            sides.append(some)
        a = np.repeat(sides[0], 6, axis=1)
        b = np.tile(sides[1], (1, 6))
        put(3 + i, a & 0xFFF, b & 0xFFF, parts[i][:, None] * np.ones((1, 36), np.uint64), (a >= 0) & (b >= 0))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RID, doc_id, fp) with the fingerprint as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(fp)], names=[RID, "doc_id", "fp"])

        return work

    rows = docs.select(RID, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_rows(rows, make, f"{RID} long, doc_id long, fp long")


def _keys(prints: DataFrame) -> DataFrame:
    def make():
        decoder = GolayDecoder()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            keys, at = golay_keys(fp.view(np.uint64), decoder)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], names=["key", "fp"])

        return work

    tasks = max(1, -(-prints.count() // PRINTS_OF_TASK))
    return arrow_rows(prints.select("fp").repartition(tasks, "fp"), make, "key long, fp long")


def spanning_links(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of a forest that joins what pairs within the distance join."""
    n = len(prints)
    bits = prints.view(np.uint64)
    close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
    left, links = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            for other in np.flatnonzero(close[at] & left):
                left[other] = False
                links.append((int(prints[at]), int(prints[other])))
                todo.append(other)
    return links


def _verify_lists(lists: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            links = [x for members in batch.column(0).to_pylist() for x in spanning_links(np.array(members, np.int64))]
            u, v = ([x[i] for x in links] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        return work

    return arrow_rows(lists, make, "u long, v long", rows=256)


def links(prints: DataFrame) -> DataFrame:
    """(u, v): verified links between distinct fingerprints, enough to join all that are linked."""
    keys = _keys(prints)
    buckets = settle(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"))
    near = F.expr(f"bit_count(u ^ v) <= {DISTANCE}")
    found = buckets.filter("n = 2").filter(near).select("u", "v")
    more = buckets.filter("n > 2")
    if more.isEmpty():
        return found
    members = keys.join(exchanged(more.select("key", "n")), "key")
    small = members.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("members")).select("members")
    found = found.unionByName(_verify_lists(small))
    if more.filter(F.col("n") > BUCKET).isEmpty():
        return found
    large = members.filter(F.col("n") > BUCKET).select("fp").distinct()
    middle = F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))"))
    balls = large.select("fp", middle.alias("m")).groupBy("m").agg(F.collect_list("fp").alias("members")).filter("size(members) > 1")
    star = balls.select(F.array_min("members").alias("u"), F.explode("members").alias("v")).filter("u <> v")
    return found.unionByName(star.distinct())


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RID, doc_id, fp, component_id) for each row of docs, which must have RID.

    Words are runs without white space, in lower case for A-Z; shingles have three words, joined by a space. Texts that
    are null or have no word have fingerprint zero and are linked like others. component_id is the least id that can be
    reached over links of at most two differing bits; it is null only where all ids of a group are null. Repeated rows
    stay; empty tables give empty tables; other columns of docs play no part.
    """
    return _groups(docs, id_col, text_col).drop("root")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_duplicate_groups with the fingerprint `root` of each row's component, which tells components apart where ids
    are null or repeated."""
    rows = settle(fingerprints(docs, id_col, text_col))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(prints)).withColumnRenamed("node", "fp")
    named = prints.join(exchanged(joined), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.select("fp", "root").join(exchanged(least), "root").select("fp", "root", "component_id")
    return rows.join(exchanged(named), "fp").select(RID, "doc_id", "fp", "component_id", "root")


@sheltered
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, that of the least id (of several rows with it, the first by row number)."""
    rows = numbered(docs)
    groups = _groups(rows, id_col, text_col)
    # a null id comes last
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", RID)
    first = groups.groupBy("root").agg(F.min(order).alias("o")).select(F.col(f"o.{RID}").alias(RID))
    return rows.join(exchanged(first), RID, "left_semi").select(*docs.columns)
