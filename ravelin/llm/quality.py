"""Quality rules with host verdicts, in DataFrame functions only.

Each text is measured once. Rule failures are summed by host (partial sums first, so one host with a third of all rows
is a few rows per task). Each rule's rates over hosts give a beta prior by their moments: the mean is that of all documents,
the variance what the hosts' rates, weighted by their documents, vary beyond chance. A host's rate is shrunk towards the
prior, and a host fails where a shrunk rate lies in the prior's upper tail. The hosts' verdicts are joined back to the
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import settle, text_or_empty
from ravelin.llm.native import let, words

SYMBOLS = r"[#*$%&|<>]"
#: Fewer words than this fail.
LEAST_WORDS = 50
#: A host fails where a rule's shrunk failure rate is so many of the prior's standard deviations above its mean, but never
#: below the first of HOST_LIMITS and always above the second.
HOST_TAIL = 3.0
HOST_LIMITS = (0.25, 0.8)
#: The prior's weight in documents lies between these; it is the second where hosts vary by chance alone.
PRIOR_WEIGHTS = (2.0, 1000.0)
#: Up to so many hosts their verdicts are broadcast: some 64 bytes each.
BROADCAST_HOSTS = 50_000

#: Rules whose failures are summed by host, over the measures of a document.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_words > 0 and 10 * n_symbols > n_words",
    "lines": "n_lines > 0 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}


def repeat_words(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more, from the windows' hashes in order.

    Hashes are 64-bit and are only compared within one text.
    """
    n = F.size(hashes)
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        none = F.array().cast("array<struct<h:bigint,i:int>>")
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), none)
        after = F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
        back = F.zip_with(s, before, lambda x, p: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == p["h"], F.lit(False)).alias("again")))
        places = F.zip_with(back, after, lambda x, q: F.when(x["again"] | F.coalesce(x["h"] == q["h"], F.lit(False)), x["i"]))
        return F.aggregate(
            F.sort_array(F.filter(places, lambda i: i.isNotNull())),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("sum")),
            lambda a, i: F.struct((i + 3).alias("end"), (a["sum"] + i + 3 - F.greatest(i, a["end"])).alias("sum")),
            lambda a: a["sum"],
        )

    return F.when(n == F.size(F.array_distinct(hashes)), F.lit(0).cast("bigint")).otherwise(let(placed, covered))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words; a null text has no words."""
    text = text_or_empty(text_col)
    gap = F.lit(" \t\n\x0b\x0c\r")
    out = docs.withColumn("__words", words(text))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, gap) != "")
    windows = let(F.col("__words"), lambda w: F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))))
    out = out.withColumns({"__lines": lines, "__windows": windows})
    return out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__windows")).cast("long"),
        }
    ).drop("__words", "__lines", "__windows")


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, host_docs, host_rate, host_failed) from measured rows with a column host.

    host_rate is the largest shrunk failure rate of a rule. Without hosts the table is empty.
    """
    failures = {k: F.sum(F.expr(rule).cast("int")).alias(k) for k, rule in RULES.items()}
    hosts = settle(rows.groupBy("host").agg(F.count("*").alias("host_docs"), *failures.values()))
    moments = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("host_docs").alias("docs"),
        *(F.sum(k).alias(f"{k}_sum") for k in RULES),
        *(F.sum(F.col(k) * F.col(k) / F.col("host_docs")).alias(f"{k}_square") for k in RULES),
    ).first()
    rates, failed = [], F.lit(False)
    for k in RULES:
        mean, weight, limit = prior(moments["hosts"], moments["docs"] or 0, moments[f"{k}_sum"] or 0, moments[f"{k}_square"] or 0.0)
        rates.append((F.col(k) + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight)))
        failed = failed | (rates[-1] > limit)
    return hosts.select("host", "host_docs", F.greatest(*rates).alias("host_rate"), failed.alias("host_failed"))


def prior(hosts: int, docs: int, failures: int, squares: float) -> tuple[float, float, float]:
    """(mean, weight, limit) of a rule's beta prior; squares is the sum of failures**2 / documents over hosts."""
    if not docs:
        return 0.0, PRIOR_WEIGHTS[1], HOST_LIMITS[1]
    mean = failures / docs
    chance = mean * (1 - mean)
    between = (squares - docs * mean * mean - (hosts - 1) * chance) / docs
    weight = min(max(chance / between - 1, PRIOR_WEIGHTS[0]), PRIOR_WEIGHTS[1]) if between > 0 else PRIOR_WEIGHTS[1]
    return mean, weight, min(max(mean + HOST_TAIL * (chance / (weight + 1)) ** 0.5, HOST_LIMITS[0]), HOST_LIMITS[1])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of docs with its measures, base_failed, its host's verdict and kept.

    A null host is the host of the empty name. Repeated rows stay and count for their host; an empty table gives an empty
    one. Other columns of docs play no part.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    rows = settle(measured(docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), F.col(text_col).cast("string").alias("text"))).drop("text"))
    hosts = settle(host_verdicts(rows))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = rows.join(hosts, "host").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host", F.round("host_rate", 6).alias("host_rate"), "host_failed")
