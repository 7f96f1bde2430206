"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap: the base patterns (mail addresses, IPv4 addresses, card
numbers, phone numbers with a plus) and looser ones (number groups of any layout, tokens with four digits and more,
spelled-out mail addresses). Boosted
trees judge each candidate by features of its format and of its context. They are trained on candidates of a bounded
sample of texts. A candidate counts as true where a base pattern confirms it or where it has a known format that no base
pattern has (spelled-out mail addresses, national phone numbers, account numbers with right check digits); as false where
neither its format nor the words before it speak for it; the others are unlabelled and left out. Thresholds, one for each kind, are
calibrated on looser candidates that training hasn't seen and that touch no base span, so that the share of true ones above
reaches PRECISION. Base spans are always reported; other candidates are reported where they pass the threshold and touch no base
span.

All patterns run in time linear in the text: each has one anchor (an at sign, a plus, the first digit of a run) and no
nested repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import arrow_columns, arrow_rows, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
MORE = ("number", "contact", "identifier")
#: Expected number of texts in the training sample, and the most candidates that come to the driver.
SAMPLE_TEXTS = 20_000
SAMPLE_CANDIDATES = 30_000
PRECISION = 0.95
#: A kind has a threshold of its own from so many calibration rows on.
CALIBRATION_ROWS = 30
TREES = 40
DEPTH = 3
BINS = 32
RATE = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,3}[0-9])+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,63}){1,8}")
_TOKEN = re.compile(r"[A-Za-z0-9+][A-Za-z0-9._/:@+-]{3,63}")
_SPELLED_HINT = re.compile(r"[(\[{]at[)\]}]| at .{1,70} dot ")
_DIGITS = re.compile(r"[^0-9]+")
_HAS_DIGIT = re.compile("[0-9]").search
_CONTEXT = (re.compile(r"mail|contact|write|@", re.I), re.compile(r"tel|phone|call|fax|mobile|whatsapp", re.I), re.compile(r"card|visa|master|credit|payment|iban|account", re.I), re.compile(r"\bip\b|host|server|address|addr", re.I))


#: Known formats beyond the base patterns. National numbers: area code in parentheses, three groups, or a leading zero.
_BRACKETED = re.compile(r"[(\[{]at[)\]}]")
_LAST_LABEL = re.compile(r"(?:\.|\(dot\)|\[dot\]|\bdot\b) ?([A-Za-z]{2,24})$")
_NATIONAL = re.compile(r"\([0-9]{2,5}\) ?[0-9]{3,4}[ .-]?[0-9]{3,5}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]{1,5}(?:[ /-][0-9]{2,8}){1,4}")
_LOCAL_NUMBER = re.compile(r"[0-9](?:[ ()/-]{0,2}[0-9]){6,14}")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the longest run of name characters before it that no earlier match holds, and a domain."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points, ends exclusive."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if _HAS_DIGIT(text):
        out += [(1, *s) for s in ips(text)]
        out += [(2, *s) for s in cards(text)]
        if "+" in text:
            out += [(3, *s) for s in phones(text)]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(4, 5 or 6, start, end): candidates of the looser generators. They may overlap each other and base spans."""
    out = []
    if _HAS_DIGIT(text):
        for m in _TOKEN.finditer(text):
            if _HAS_DIGIT(m.group()) and len(_DIGITS.sub("", m.group())) >= 4:
                out.append((6, *m.span()))
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() >= 7 and 7 <= sum(c.isdigit() for c in m.group()) <= 24:
                out.append((4, *m.span()))
    if "at" in text and _SPELLED_HINT.search(text):
        out += [(5, *m.span()) for m in _SPELLED.finditer(text)]
    return out


FEATURES = 22


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    digits = [c for c in span if "0" <= c <= "9"]
    groups = [len(g) for g in re.split("[^0-9]+", span) if g]
    letters = sum(c.isalpha() for c in span)
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    parts = span.split(".")
    return [
        end - start, len(digits), len(groups), max(groups, default=0), min(groups, default=0), float(np.std(groups)) if groups else 0.0,
        letters, span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count(")"), span.count("/"),
        float("@" in span or "[at]" in span or "(at)" in span or "{at}" in span or " at " in span), float(span[:1] == "+"),
        float(len(digits) > 1 and luhn("".join(digits))), float(len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)),
        float(before[-1:].isalnum()), float(after[:1].isalnum()),
        *(float(bool(p.search(before))) for p in _CONTEXT),
    ]


def overlaps(span: tuple[int, int, int], others: list[tuple[int, int, int]]) -> bool:
    return any(o[1] < span[2] and span[1] < o[2] for o in others)


class Booster:
    """Gradient-boosted trees of fixed depth on binned features, with logistic loss."""

    def __init__(self, edges: list[np.ndarray], trees: list[tuple], start: float, scale: tuple[float, float], threshold: float) -> None:
        """threshold is that of kinds without one of their own in thresholds; above 1 none passes."""
        self.edges, self.trees, self.start, self.scale, self.threshold = edges, trees, start, scale, threshold
        self.thresholds: dict[int, float] = {}

    def passes(self, kind: int, p: float) -> bool:
        return p >= self.thresholds.get(kind, self.threshold)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _leaf(tree: tuple, bins: np.ndarray) -> np.ndarray:
        split, at, _ = tree
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            right = bins[np.arange(len(bins)), split[node]] > at[node]
            node = 2 * node + 1 + right
        return node - (2**DEPTH - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += RATE * tree[2][self._leaf(tree, bins)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: a logistic curve over the trees' sums."""
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, seed: int = 11, loose: np.ndarray | None = None, kinds: np.ndarray | None = None) -> Booster | None:
        """None where the rows hold only one class. Each third row is kept for calibration, of which only those that are
        `loose` set the thresholds: one for each of `kinds` with CALIBRATION_ROWS of them, and one for all others."""
        if len(y) < 30 or y.min() == y.max():
            return None
        order = np.random.default_rng(seed).permutation(len(y))
        held, used = order[::3], np.setdiff1d(order, order[::3])
        if y[used].min() == y[used].max():
            return None
        edges = [np.unique(np.quantile(x[used, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        mean = y[used].mean()
        self = cls(edges, [], float(np.log(mean / (1 - mean))), (1.0, 0.0), 2.0)
        bins = self._bins(x[used])
        total = np.full(len(used), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            tree = cls._tree(bins, y[used] - p, p * (1 - p) + 1e-9)
            self.trees.append(tree)
            total += RATE * tree[2][cls._leaf(tree, bins)]
        self._calibrate(x[held], y[held], np.ones(len(held), bool) if loose is None else loose[held], None if kinds is None else kinds[held])
        return self

    @staticmethod
    def _tree(bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple:
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        split, at = np.zeros(inner, np.int64), np.full(inner, BINS + 1, np.int64)
        node = np.zeros(len(bins), np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == k)
                best = 1e-6
                for f in range(bins.shape[1] if len(mine) else 0):
                    g = np.bincount(bins[mine, f], gradient[mine], BINS + 1).cumsum()
                    h = np.bincount(bins[mine, f], weight[mine], BINS + 1).cumsum()
                    gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                    if gain.max() > best:
                        best, split[k], at[k] = gain.max(), f, int(gain.argmax())
                right = bins[mine, split[k]] > at[k]
                node[mine] = 2 * k + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        return split, at, np.clip(g / (h + 1), -4, 4)

    def _calibrate(self, x: np.ndarray, y: np.ndarray, loose: np.ndarray, kinds: np.ndarray | None) -> None:
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a weak pull towards (1, 0)
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w = p * (1 - p)
            grad = np.array([((y - p) * m).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
            hess = np.array([[(w * m * m).sum() + 0.1, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
            da, db = np.linalg.solve(hess, grad)
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-6:
                break
        self.scale = (float(a), float(b))
        p, y = self.probability(x)[loose], y[loose]
        self.threshold = self._threshold(p, y)
        if kinds is not None:
            of = kinds[loose]
            self.thresholds = {int(k): self._threshold(p[of == k], y[of == k]) for k in np.unique(of) if (of == k).sum() >= CALIBRATION_ROWS}

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        """The lowest from which the share of true ones reaches PRECISION."""
        order = np.argsort(-p, kind="stable")
        share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(share >= PRECISION)
        return max(0.5, float(p[order[good[-1]]])) if len(good) else 2.0


def evidence(text: str, kind: int, start: int, end: int) -> int | None:
    """Whether a looser candidate is personal data, by what no base pattern looks at; None where nothing tells."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    cues = [bool(p.search(before)) for p in _CONTEXT]
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() or _DATE.match(span):
        return 0
    if kind == 5:
        return 1 if _LAST_LABEL.search(span) and (_BRACKETED.search(span) or re.search(r"\bdot\b", span)) else None
    if kind != 5:
        digits = len(_DIGITS.sub("", span))
        if 8 <= digits <= 15 and _NATIONAL.fullmatch(span) or cues[1] and 7 <= digits <= 15 and _LOCAL_NUMBER.fullmatch(span.strip("+")):
            return 1
    if kind == 6 and _IBAN.fullmatch(span):
        return int(int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1)
    return None if any(cues) else 0


def training_rows(texts: list[str]) -> tuple[list[list[float]], list[int], list[int]]:
    """Features of all labelled candidates, 0 (not personal), 1 (personal, by a known format) or 2 (touches a base span), and
    their kinds."""
    x, y, kinds = [], [], []
    for text in texts:
        base = base_spans(text)
        spans = base + loose_spans(text)
        labels = [2 if s[0] < 4 or overlaps(s, base) else evidence(text, *s) for s in spans]
        real = [s for s, label in zip(spans, labels, strict=True) if label == 1]
        for (kind, start, end), label in zip(spans, labels, strict=True):
            # a part of a real one isn't false
            if label is not None and (label or not overlaps((kind, start, end), real)):
                x.append(features(text, start, end))
                y.append(label)
                kinds.append(kind)
    return x, y, kinds


def learn(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Booster | None:
    """A booster from the candidates of about SAMPLE_TEXTS texts, chosen by a hash of their ids."""
    n = docs.count()
    share = min(1.0, SAMPLE_TEXTS / max(1, n))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y, kinds = training_rows(texts_of(batch))
            key = [int.from_bytes(hashlib.blake2b(repr(r).encode() + bytes([k % 251]), digest_size=7).digest(), "big") for k, r in enumerate(x)]
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(kinds, pa.int32())], names=["key", "x", "y", "kind"])

        return work

    got = arrow_rows(rows.select("text"), make, "key long, x array<double>, y int, kind int").orderBy("key", "y", "kind").limit(SAMPLE_CANDIDATES).collect()
    if not got:
        return None
    y = np.array([r.y for r in got])
    return Booster.train(np.array([r.x for r in got]), (y > 0).astype(np.float64), loose=y < 2, kinds=np.array([r.kind for r in got]))


def find(text: str | None, booster: Booster | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of one text."""
    text = text or ""
    base = base_spans(text)
    if booster is None or min([booster.threshold, *booster.thresholds.values()]) > 1:
        return base, []
    loose = [s for s in loose_spans(text) if not overlaps(s, base)]
    if not loose:
        return base, []
    p = booster.probability(np.array([features(text, s[1], s[2]) for s in loose]))
    added: list[tuple[int, int, int]] = []
    for k in np.argsort(-p, kind="stable"):  # of overlapping ones the likeliest stays
        if booster.passes(loose[k][0], p[k]) and not overlaps(loose[k], added):
            added.append(loose[k])
    return base, sorted(added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(KINDS + MORE)[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, booster: Booster | None, text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added; columns with these names are replaced.

    Null and empty texts have no spans. Repeated rows stay. spans lists kind:start:end by kind, then start.
    """
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]

    def make():
        def one(text: str | None) -> list:
            base, added = find(text, booster)
            counts = [0] * len(KINDS)
            for k, _, _ in base:
                counts[k] += 1
            return [*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added)]

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = [one(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            return {f.name: pa.array([r[k] for r in rows], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for k, f in enumerate(fields)}

        return work

    return arrow_columns(docs, make, fields)


def redact(docs: DataFrame, booster: Booster | None, text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in brackets; overlapping spans become one, of the first kind."""

    def make():
        def one(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for start, end, kind in sorted((a, b, k) for x in find(text, booster) for k, a, b in x):
                if start >= at:
                    out += [text[at:start], f"[{(KINDS + MORE)[kind].upper()}]"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {text_col: pa.array([one(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()], pa.string())}

        return work

    return arrow_columns(docs, make, [T.StructField(text_col, T.StringType())]).select(*docs.columns)


def personal_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scan(rows, learn(rows)).drop("text")
