"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k takes pieces of at most capacity // k tokens and fills each of its
bins with exactly k of them, so a bin's content never depends on another worker. To leave little room, a document's rest
beyond whole sequences is cut where the classes end: its first piece takes capacity // k tokens for the smallest k of
the ladder that fits below it, which fills its share of a bin, and what remains is cut again until it is small.

A worker's bins that stay incomplete at its end are joined into one last stream, cut at the capacity; the stream's end is
cut at powers of two, so that no padding is left there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import through_arrow

CAPACITY = 2048
END = 1
#: Documents in a bin of each class. Up to CUT, pieces are cut to the class's length; the others take small rests.
LADDER = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 2048)
CUT = 32
#: Code points up to here are split alike by both libraries' patterns; longer ones and special tokens take the slow way.
PLAIN_END = 0x24F


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The class of a piece: the most pieces of that length that the ladder puts in one bin."""
    return max(k for k in LADDER if k * length <= capacity)


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = next((k for k in LADDER if capacity // k <= rest), None)
        if k is None or k > CUT or rest - capacity // k == 0:
            out.append(rest)
            break
        out.append(capacity // k)
        rest -= capacity // k
    return out


class Packer:
    """Fills bins in the order in which documents come. An open bin holds its pieces' own ids and no whole document."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}
        self.sequences = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for document, start, ids in pieces:
            yield document, start, ids, self.sequences, offset
            offset += len(ids)
        self.sequences += 1

    def add(self, document, ids: np.ndarray) -> Iterator[tuple]:
        """(document, start, ids, sequence, offset) for pieces whose bin is full now."""
        start = 0
        for n in cut(len(ids), self.capacity):
            k = class_of(n, self.capacity)
            pieces = self.open.setdefault(k, [])
            pieces.append((document, start, ids[start : start + n].copy()))
            start += n
            if len(pieces) == k:
                yield from self._emit(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """The pieces of incomplete bins, cut anew where sequences end."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        room = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if total % self.capacity >> b & 1]
        at, used = 0, 0  # in left, and in its piece
        for size in room:
            pieces, free = [], size
            while free:
                document, start, ids = left[at]
                some = ids[used : used + free]
                pieces.append((document, start + used, some))
                free -= len(some)
                used += len(some)
                if used == len(ids):
                    at, used = at + 1, 0
            yield from self._emit(pieces)


class ByteBpe:
    """Ids of the byte-level BPE file by `tokenizers`.

    Texts of Latin characters without the special token's string are encoded by the same vocabulary as ranks in
    `tiktoken`, which gives the same ids several times faster; all others by `tokenizers` itself.
    """

    def __init__(self, path: str) -> None:
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        known = json.loads(Path(path).read_text(encoding="utf-8"))
        special = [x["content"] for x in known.get("added_tokens", [])]
        # the printable stand-ins of bytes in such files: printable Latin-1 for itself, others from 256 upwards
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in known["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=self._pattern(), mergeable_ranks=ranks, special_tokens={})
        self.unusual = re.compile("|".join([f"[^\x00-{chr(PLAIN_END)}]", *map(re.escape, special)])).search

    @staticmethod
    def _pattern() -> str:
        # fixed value: the published pattern of byte-level BPE
        return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def ids(self, text: str) -> np.ndarray:
        if self.unusual(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text counts as empty, and each document ends with the id 1, so none lacks a piece. Repeated rows are packed
    each for itself. sequence_id is the partition's number times 2**40 plus the worker's own count. Memory is bounded by
    the open bins, at most LADDER's bins of capacity ids. Order within a partition is the table's, so a repeated task
    packs the same sequences.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, packer = ByteBpe(tokenizer_path), Packer(capacity)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def row(piece: tuple) -> tuple:
            (doc_id, total), start, mine, sequence, offset = piece
            out = (doc_id, start, len(mine), zlib.crc32(mine.astype("<u4", copy=False)), total, base + sequence, offset)
            return (*out, mine.astype(np.int32)) if with_ids else out

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

        for given in batches:
            for doc_id, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.ids(text or ""), np.uint32(END)).astype(np.uint32)
                rows.extend(map(row, packer.add((doc_id, len(ids)), ids)))
                if len(rows) >= 20_000:
                    yield batch()
                    rows = []
        rows.extend(map(row, packer.finish()))
        if rows:
            yield batch()

    return through_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
