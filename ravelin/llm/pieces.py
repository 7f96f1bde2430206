"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search reads a text once, from left to right. It keeps scores and back pointers of the last positions only, as many
as the longest piece has characters; whenever the back-pointer paths of all of them run through one common boundary, the
ids up to it are final and are handed on. Memory is bounded by that window and by what is not final yet, never by the
text.

Where two neighbouring characters stand together in no piece, all paths converge between them at once. Where no piece of
a vocabulary has its space mark after another character, that holds before each word, so a word's ids depend on the word
alone. Ids of words (and of their parts between such points) that the search has finished before are taken from a bounded
table; all others come from the search itself, whatever their length.

Spaces become the mark U+2581 and one mark is put before a text; a mark in a text reads as a space. A path's worth is the
sum of its pieces' scores; among equal ones that with the longer last piece wins at each position. A character without a
piece of its own may be spelled in its bytes, ten below the lowest score. A file of merges has whole numbers, the order of
the merges, in place of probabilities. Sums of these would favour many early pieces, so there a piece costs PIECE and its
rank: the fewest pieces win, and among as many those that merge first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import arrow_columns

MARK = "▁"
#: Words whose ids a worker keeps; it forgets all at once when it is full.
KEPT_WORDS = 400_000
#: What a piece costs besides its rank, where scores are ranks of merges.
PIECE = 1e6


class Pieces:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.text_of: list[bytes] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.text_of.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text_of.append(b"")
            else:
                self.pieces[piece] = (i, model.get_score(i))
                self.text_of.append(piece.replace(MARK, " ").encode())
        self.setup(model.unk_id())

    @classmethod
    def of(cls, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int) -> Pieces:
        """A vocabulary given by its parts."""
        self = cls.__new__(cls)
        self.pieces, self.bytes = dict(pieces), list(byte_ids)
        self.text_of = [b""] * (1 + max([i for i, _ in pieces.values()] + [b for b in byte_ids] + [unknown]))
        for piece, (i, _) in pieces.items():
            self.text_of[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            if i >= 0:
                self.text_of[i] = bytes([b])
        self.setup(unknown)
        return self

    def setup(self, unknown: int) -> None:
        self.unknown = unknown
        self.longest = max(map(len, self.pieces), default=1)
        scores = sorted({s for _, s in self.pieces.values()}, reverse=True)
        ranks = len(scores) > 1 and all(s == int(s) for s in scores)
        #: What each score is worth.
        self.worth = {s: -PIECE - k for k, s in enumerate(scores)} if ranks else {s: s for s in scores}
        self.missing = min(self.worth.values(), default=0.0) - 10
        self.most_open = 0
        self.tree: dict = {}
        for piece, (i, score) in self.pieces.items():
            found = (i, self.worth[score])
            node = self.tree
            for character in piece:
                node = node.setdefault(character, {})
            node[0] = found
        self.pairs = {p[n : n + 2] for p in self.pieces for n in range(len(p) - 1)}
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.known: dict[str, tuple[int, ...]] = {}

    def spelled(self, character: str) -> tuple[int, ...]:
        ids = tuple(self.bytes[b] for b in character.encode("utf-8", "replace"))
        return ids if min(ids) >= 0 else (self.unknown,)

    def _stream(self, text: str) -> Iterator[list[int]]:
        """Lists of final ids, in order. Positions count from the last final boundary."""
        tree, pieces, longest, n = self.tree, self.pieces, self.longest, len(text)
        worth, back = [0.0] + [_NEVER] * longest, [None] * (longest + 1)
        final, at, check = 0, 0, min(n, longest)
        while at < n:
            here = at - final
            score = worth[here]
            if score != _NEVER:
                node, end = tree, here
                for character in text[at : at + longest]:
                    node = node.get(character)
                    if node is None:
                        break
                    end += 1
                    found = node.get(0)
                    if found is not None:
                        total = score + found[1]
                        if total > worth[end]:
                            worth[end], back[end] = total, (here, found[0])
                if text[at] not in pieces and score + self.missing > worth[here + 1]:
                    worth[here + 1], back[here + 1] = score + self.missing, (here, None)
            at += 1
            worth.append(_NEVER)
            back.append(None)
            if at == check:
                check = min(n, at + longest)
                here = at - final
                # open paths end at the positions that a piece has reached; those before `at` are done with
                boundary = self._meeting(back, [k for k in range(here, len(worth)) if worth[k] != _NEVER])
                self.most_open = max(self.most_open, here - boundary)
                if boundary:
                    yield self._path(back, boundary, text[final : final + boundary])
                    final += boundary
                    worth = worth[boundary:]
                    back = [b and (b[0] - boundary, b[1]) for b in back[boundary:]]

    def _word(self, word: str) -> tuple[int, ...]:
        """A word's ids by its parts between neighbours that stand together in no piece."""
        known, pairs = self.known, self.pairs
        out: list[int] = []
        start, n = 0, len(word)
        for at in range(1, n + 1):
            if at == n or word[at - 1 : at + 1] not in pairs:
                part = word[start:at]
                ids = known.get(part)
                if ids is None:
                    ids = tuple(i for some in self._stream(part) for i in some)
                    if at - start <= 4 * self.longest:
                        known[part] = ids
                out.extend(ids)
                start = at
        return tuple(out)

    @staticmethod
    def _meeting(back: list, ends: list[int]) -> int:
        """The last boundary through which the paths of all ends run. Each step moves the hindmost path back."""
        open_ends = set(ends)
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.discard(last)
            open_ends.add(back[last][0])
        return open_ends.pop()

    def _path(self, back: list, boundary: int, text: str) -> list[int]:
        out: list[int] = []
        while boundary:
            before, found = back[boundary]
            out.extend(reversed(self.spelled(text[before:boundary])) if found is None else (found,))
            boundary = before
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty one."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        if not self.apart:
            return [i for ids in self._stream(text) for i in ids]
        out: list[int] = []
        known = self.known
        for word in _WORD.findall(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                ids = self._word(word)
                if len(word) <= 4 * self.longest:
                    known[word] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        """The text of ids: the first space goes, bytes that are no UTF-8 become U+FFFD."""
        texts = self.text_of
        raw = b"".join([texts[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_NEVER = float("-inf")
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_models: dict[str, Pieces] = {}


def model_at(path: str) -> Pieces:
    """The model of a file, read once in each worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _lists(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The lists of a column as views of its values; None for null."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for k, valid in enumerate(column.is_valid().to_pylist()):
        yield values[offsets[k] : offsets[k + 1]] if valid else None


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col, array<int>. Null and empty texts have no ids. A column of that name is replaced."""

    def make():
        model = model_at(model_path)

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            lists = [np.array(model.encode(t), np.int32) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            return {ids_col: pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *lists]))}

        return work

    return arrow_columns(docs, make, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], rows=512)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded", sum_col: str | None = None) -> DataFrame:
    """rows with text_col, the text of ids_col, in its place; null ids give null. A column of that name is replaced.

    sum_col, where it is given, is the CRC-32 of the ids as little-endian unsigned 32-bit numbers.
    """
    fields = [T.StructField(text_col, T.StringType())] + ([T.StructField(sum_col, T.LongType())] if sum_col else [])

    def make():
        model = model_at(model_path)

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            lists = list(_lists(batch.column(batch.schema.get_field_index(ids_col))))
            out = {text_col: pa.array([None if x is None else model.decode(x.tolist()) for x in lists], pa.string())}
            if sum_col:
                out[sum_col] = pa.array([None if x is None else zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in lists], pa.int64())
            return out

        return work

    return arrow_columns(rows.withColumn("n_ids", F.size(ids_col).cast("long")) if sum_col else rows, make, fields, drop=(ids_col,) if sum_col else (), rows=512)


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and round_trip: whether the
    decoded text is the given one, with marks read as spaces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = decode(encode(rows, model_path), model_path, sum_col="ids_crc32")
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "n_ids",
        "ids_crc32",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"),
    )
