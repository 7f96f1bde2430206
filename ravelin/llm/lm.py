"""Language-model scores: a log-bilinear neural model over word classes, trained by noise-contrastive estimation.

Words are counted over all training texts. The FREQUENT words with the highest counts stand in a bounded table; the most
frequent of them are classes of their own, the others share classes of about equal mass, and all remaining words are one
last class. A word's probability is its class's, given the classes of the two words before it, times its share in its
class. The class model is log-bilinear: a context word's vector times its position's matrix, summed over positions, gives
a predicted vector; its product with a class's vector plus a bias is the class's score.

Training reads all training texts: their class triples are counted over the corpus, and each round fits the model on all
counted triples, partition by partition from the same start, and averages the results by weight. The gradients are those
of noise-contrastive estimation with noise that a batch shares. Scores are normalised exactly: a table of all contexts'
normalisers is made by batched matrix products.

Rare words (beyond the bounded table) are looked up by a join on the word; frequent ones, which make the hot keys, never
take part in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import RID, arrow_rows, numbered, settle, texts_of, through_arrow

#: Words with a table entry on each worker: some 10 MB.
FREQUENT = 131_072
#: Classes in all; the last is that of all words without an entry.
CLASSES = 256
#: Words that are a class of their own.
OWN_CLASS = 128
DIMENSIONS = 24
NOISE = 64
BATCH = 4096
ROUNDS = 2
RATE = 0.1
#: Counted triples of one training task.
TASK_TRIPLES = 400_000
#: The end of a text. It holds a gap, so no word is equal to it.
END = b"\n"
#: A worker hands its word counts on when it holds so many.
FLUSH = 400_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the column text; words are lower-case bytes, and each text has one END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return through_arrow(docs.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The bounded table of frequent words, their classes, and the corpus totals."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    class_counts: np.ndarray
    tokens: int
    distinct: int
    least: int

    def index(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}

    @property
    def rare_tokens(self) -> int:
        return self.tokens - int(self.counts.sum())

    @property
    def rare_distinct(self) -> int:
        return self.distinct - len(self.words)


def vocabulary(counts: DataFrame, most: int = FREQUENT) -> Vocabulary:
    """The words above the lowest count at which no more than `most` words come to the driver."""
    step = F.floor(F.log2("c") * 16).cast("int")
    spread = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    taken, least = 0, 1 << 62
    for row in spread:
        if taken + row.n > most:
            break
        taken, least = taken + row.n, row.least
    rows = sorted(((r.c, bytes(r.word)) for r in counts.filter(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    number = np.array([c for c, _ in rows], np.int64)
    classes = np.arange(len(rows))
    if len(rows) > OWN_CLASS:
        rest = number[OWN_CLASS:]
        shared = CLASSES - 1 - OWN_CLASS
        classes[OWN_CLASS:] = OWN_CLASS + np.minimum((np.cumsum(rest) - rest) * shared // max(1, int(rest.sum())), shared - 1)
    class_counts = np.bincount(classes, weights=number, minlength=CLASSES).astype(np.int64)
    tokens, distinct = sum(r.c for r in spread), sum(r.n for r in spread)
    class_counts[CLASSES - 1] = tokens - int(number.sum())
    return Vocabulary([w for _, w in rows], number, classes.astype(np.int64), class_counts, int(tokens), int(distinct), int(least))


def class_sequence(indices: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Classes of word numbers; -1 stands for words without an entry."""
    if not len(vocab.words):
        return np.full(len(indices), CLASSES - 1, np.int64)
    return np.where(indices < 0, CLASSES - 1, vocab.classes[indices])


def _indices(words: list[bytes], table: dict[bytes, int]) -> np.ndarray:
    get = table.get
    return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def _contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the word before and of that before it; CLASSES stands before the text."""
    one = np.concatenate([[CLASSES], classes[:-1]])
    two = np.concatenate([[CLASSES], one[:-1]])
    return one, two


def count_triples(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(k, n): how often each class follows two classes, over the column text. There are at most CLASSES**3-some rows."""

    def make():
        table = vocab.index()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = []
            for text in texts_of(batch):
                c = class_sequence(_indices([*words_of(text), END], table), vocab)
                one, two = _contexts(c)
                keys.append((two * (CLASSES + 1) + one) * CLASSES + c)
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["k", "n"])

        return work

    return arrow_rows(docs.select("text"), make, "k long, n long", rows=8192).groupBy("k").agg(F.sum("n").alias("n"))


class LogBilinear:
    """Vectors of context classes, a matrix for each of two positions, vectors and biases of predicted classes."""

    shapes = (("context", (CLASSES + 1, DIMENSIONS)), ("near", (DIMENSIONS, DIMENSIONS)), ("far", (DIMENSIONS, DIMENSIONS)), ("target", (CLASSES, DIMENSIONS)), ("bias", (CLASSES,)))

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.asarray(values, np.float64)
        at = 0
        for name, shape in self.shapes:
            n = int(np.prod(shape))
            setattr(self, name, self.values[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, class_counts: np.ndarray, seed: int = 7) -> LogBilinear:
        rng = np.random.default_rng(seed)
        model = cls(rng.normal(0, 0.1, sum(int(np.prod(s)) for _, s in cls.shapes)))
        model.near[:] = np.eye(DIMENSIONS) * 0.7
        model.far[:] = np.eye(DIMENSIONS) * 0.3
        model.bias[:] = np.log((class_counts + 1) / (class_counts.sum() + CLASSES))
        return model

    def fit(self, keys: np.ndarray, weights: np.ndarray, noise: np.ndarray, seed: int = 7) -> None:
        """One pass of noise-contrastive estimation over weighted triples, with AdaGrad steps."""
        rng = np.random.default_rng(seed)
        word = keys % CLASSES
        one = keys // CLASSES % (CLASSES + 1)
        two = keys // CLASSES // (CLASSES + 1)
        log_noise = np.log(NOISE * noise)
        past = {name: np.full(shape, 1e-6) for name, shape in self.shapes}
        order = rng.permutation(len(keys))
        for at in range(0, len(keys), BATCH):
            pick = order[at : at + BATCH]
            w, a, b = word[pick], one[pick], two[pick]
            weight = weights[pick] / weights[pick].sum()
            guess = self.context[a] @ self.near + self.context[b] @ self.far
            true = (guess * self.target[w]).sum(1) + self.bias[w] - log_noise[w]
            drawn = rng.choice(CLASSES, NOISE, p=noise)
            false = guess @ self.target[drawn].T + self.bias[drawn] - log_noise[drawn]
            up = weight / (1 + np.exp(np.clip(true, -30, 30)))
            down = -weight[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
            to_guess = up[:, None] * self.target[w] + down @ self.target[drawn]
            steps = {name: np.zeros(shape) for name, shape in self.shapes}
            np.add.at(steps["target"], w, up[:, None] * guess)
            np.add.at(steps["target"], drawn, down.T @ guess)
            np.add.at(steps["bias"], w, up)
            np.add.at(steps["bias"], drawn, down.sum(0))
            steps["near"] = self.context[a].T @ to_guess
            steps["far"] = self.context[b].T @ to_guess
            np.add.at(steps["context"], a, to_guess @ self.near.T)
            np.add.at(steps["context"], b, to_guess @ self.far.T)
            for name, step in steps.items():
                past[name] += step**2
                getattr(self, name)[...] += RATE * step / np.sqrt(past[name])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near scores with bias, far scores, log normalisers[far, near]); a score is near + far - normaliser."""
        near = self.context @ self.near @ self.target.T + self.bias
        far = self.context @ self.far @ self.target.T
        top, away = near.max(1), far.max(1)
        total = np.exp(far - away[:, None]) @ np.exp(near - top[:, None]).T
        return near, far, np.log(total) + away[:, None] + top[None, :]


def train(triples: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS) -> LogBilinear:
    """A model fitted on all counted triples. Each round's parts come together as one weighted mean."""
    model = LogBilinear.start(class_counts)
    noise = (class_counts + 1) / (class_counts.sum() + CLASSES)
    tasks = max(1, -(-triples.count() // TASK_TRIPLES))
    parts = triples.repartition(tasks, "k")
    for turn in range(rounds):
        values = model.values

        def run(batches: Iterator[pa.RecordBatch], values=values, turn=turn) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if not got:
                return
            keys, n = (np.concatenate([g[i] for g in got]) for i in (0, 1))
            order = np.argsort(keys)
            mine = LogBilinear(values.copy())
            mine.fit(keys[order], n[order].astype(np.float64), noise, seed=turn)
            weight = np.full(len(values), float(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(mine.values * weight), pa.array(weight)], names=["i", "v", "w"])

        mean = through_arrow(parts, run, "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))
        values = model.values.copy()
        for row in mean.collect():
            values[row.i] = row.v
        model = LogBilinear(values)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    A null text counts as empty: its only token is the end. A null id counts as empty text where rows are held out.
    Repeated rows stay, and each counts in training. Without training rows all counts are zero. score is the model's
    log10 probability of the whole text.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).withColumn("held_out", held_out())
    training = rows.filter(~F.col("held_out"))
    counts = settle(count_words(training))
    vocab = vocabulary(counts)
    model = train(settle(count_triples(training, vocab)), vocab.class_counts)
    near, far, normaliser = model.tables()

    def make():
        table = vocab.index()
        share = np.log(vocab.counts / vocab.class_counts[vocab.classes]) if len(vocab.words) else np.zeros(0)
        plus = np.log10(vocab.counts + 1.0)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("rid", "doc_id", "held", "n", "known", "base", "model", "word", "tf")}

            def put(*values) -> None:
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)

            for rid, doc_id, text, held in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = [*words_of(text), END]
                index = _indices(words, table)
                c = class_sequence(index, vocab)
                one, two = _contexts(c)
                there = index[index >= 0]
                log_p = float((near[one, c] + far[two, c] - normaliser[two, one]).sum() + share[there].sum())
                put(rid, doc_id, held, len(words), len(there), float(plus[there].sum()), log_p / np.log(10), b" %d" % rid, 0)
                for word, tf in Counter(words[k] for k in np.flatnonzero(index < 0)).items():
                    put(rid, None, None, None, None, None, None, word, tf)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

        return work

    parts = arrow_rows(rows.select(RID, "doc_id", "text", "held_out"), make, "rid long, doc_id long, held boolean, n long, known long, base double, model double, word binary, tf int", rows=1024)
    rare = counts.filter(F.col("c") < vocab.least)
    joined = parts.join(rare, "word", "left").select(
        "rid", "doc_id", "held", "n", "base", "model", "tf",
        F.coalesce("known", F.when(F.col("c").isNotNull(), F.col("tf")), F.lit(0)).cast("long").alias("known"),
        (F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare"),
    )
    summed = joined.groupBy("rid").agg(*(F.max(x).alias(x) for x in ("doc_id", "held", "n", "base", "model")), F.sum("known").alias("known"), F.sum("rare").alias("rare"), F.sum("tf").alias("tf"))
    each, rare_each = np.log10(vocab.tokens + vocab.distinct + 1), np.log10(vocab.rare_tokens + vocab.rare_distinct + 1)
    return summed.select(
        "doc_id",
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare") - F.col("n") * F.lit(float(each))).alias("base_score"),
        (F.col("model") + F.col("rare") - F.col("tf") * F.lit(float(rare_each))).alias("score"),
    )
