"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text becomes its letters in lower case; each run of other characters becomes one boundary. Its n-grams of one to three
characters are exact: three code points of 21 bits fit one 64-bit number. A language's profile is its most frequent
n-grams over all training texts, ranked. A text's distance to it is the sum, over the text's own most frequent n-grams,
of how far the two ranks lie apart, or of the profile's size where the profile lacks the n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import arrow_columns, arrow_rows, texts_of

UNDETERMINED = "und"
#: n-grams of a language's profile, and of a text's.
PROFILE = 400
TEXT_PROFILE = 300
BOUNDARY = 1
#: Texts whose n-grams are sorted at once; a text of 3,000 characters has 70 kB of them.
LEARN_ROWS = 512

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """By code point: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def points_of(text: str) -> np.ndarray:
    """The code points of a text's letters in lower case, with one boundary before, between and after runs of them."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letter_table()[raw]
    points = np.concatenate([[BOUNDARY], np.where(letter, raw, BOUNDARY), [BOUNDARY]]).astype(np.int64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != BOUNDARY) | (points[:-1] != BOUNDARY)
    return points[keep]


def grams_of(points: np.ndarray) -> np.ndarray:
    """All n-grams of one to three characters but for lone boundaries."""
    two = points[:-1] << 21 | points[1:]
    three = two[:-1] << 21 | points[2:]
    return np.concatenate([points[points != BOUNDARY], two, three])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order and their counts."""
    grams = np.sort(grams)
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[edge], np.diff(np.append(edge, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, by count downwards, then by n-gram."""
    if len(grams) > 2 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:most]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of all profiles' n-grams: ranks[i, k] for n-gram i and language k, `size` where it isn't in the profile."""

    langs: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, by_lang: dict[str, list[int]], size: int = PROFILE) -> Profiles:
        langs = tuple(sorted(by_lang))
        grams = np.unique(np.array([g for x in by_lang.values() for g in x], np.int64))
        ranks = np.full((len(grams) + 1, len(langs)), -1, np.int32)
        for k, name in enumerate(langs):
            mine = np.array(by_lang[name], np.int64)
            ranks[np.searchsorted(grams, mine), k] = np.arange(len(mine))
        return cls(langs, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score). Ties go to the language that comes first by name."""
        points = points_of(text or "")
        if not self.langs or len(points) <= 1:
            return UNDETERMINED, 0.0
        top = ranked(*counted(grams_of(points)), TEXT_PROFILE)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(top))[:, None]), self.size)).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.size * len(top)))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all texts of docs with a language. Only `size` n-grams a language come to the driver."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, langs = texts_of(batch), batch.column(1).to_pylist()
            names, grams, counts = [], [], []
            for name in sorted(set(langs)):
                mine = [grams_of(p) for t, x in zip(texts, langs, strict=True) if x == name and len(p := points_of(t)) > 1]
                if mine:
                    g, n = counted(np.concatenate(mine))
                    names += [name] * len(g)
                    grams.append(g)
                    counts.append(n)
            if not names:
                return None
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts).astype(np.int64))], names=["lang", "gram", "n"])

        return work

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = arrow_rows(rows, make, "lang string, gram long, n long", rows=LEARN_ROWS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    by_lang: dict[str, list[int]] = {}
    for row in counts.withColumn("place", place).filter(F.col("place") <= size).orderBy("lang", "place").select("lang", "gram").collect():
        by_lang.setdefault(row.lang, []).append(row.gram)
    return Profiles.of(by_lang, size)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with a predicted language and a score from 0 to 1; only the text plays a part.

    Null texts and texts without a letter get `und` and 0, as do all where no language was learned. Columns with the
    new names are replaced; rows stay as they are.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            got = [profiles.predict(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            return {lang_col: pa.array([x for x, _ in got], pa.string()), score_col: pa.array([x for _, x in got], pa.float64())}

        return work

    return arrow_columns(docs, make, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])


def held_out(id_col: str = "doc_id"):
    """True for the rows that training leaves out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def language_rows(docs: DataFrame) -> DataFrame:
    """The query's rows. A null doc_id counts as empty text where rows are held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").withColumn("held_out", held_out())
    profiles = learn(own.filter(~F.col("held_out")))
    return predict(own.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")
