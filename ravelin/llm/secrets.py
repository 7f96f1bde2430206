"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in each text; a candidate's hash is then counted over the whole corpus by distinct repositories and
owners. A value that several owners have, or that one owner has in many repositories or very many times, is an example that
was copied around; one that a single owner has in few repositories, a few times, and that looks random is taken for a live
credential. Base spans (assignments, access keys, long hex runs) are always reported. Blobs of 20 and more letters and
digits are reported only where ownership says that they are live. Redaction marks copied examples apart from secrets.

Counting goes in three steps (hash, owner, repository), (hash, owner), (hash), each with partial sums before its
exchange, so a value in a third of all rows is a few rows per task. Only candidates are exchanged, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import RID, numbered, settle, sheltered, text_or_empty
from ravelin.llm.native import let, matches

#: Kinds in the order of equal starts.
KINDS = ("assign", "access", "hex", "blob")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
#: A run below the least length can hold no longer match that starts later in it, so the length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BLOB = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
ASSIGN_LEAST = 6
#: From so many owners, or repositories, or places in a repository on average, upwards a value counts as copied.
COPIED_OWNERS = 3
COPIED_REPOS = 4
COPIED_TIMES = 20
#: A live value has so many different characters at least.
LIVE_CHARACTERS = 8

SPAN = "array<struct<start:bigint,kind:int,end:bigint,hash:string,random:boolean>>"


def _random(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _kind(text: Column, hint: Column, pattern: str, kind: int, group: int = 0, keep=None) -> Column:
    found = matches(text, pattern, group)
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["value"]))
    shaped = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash"), _random(x["value"]).alias("random")))
    return F.when(hint, shaped).otherwise(F.array()).cast(SPAN)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start, then kind. Blobs that touch a base span are left out."""
    base = F.concat(
        _kind(text, text.rlike(ASSIGN_HINT), ASSIGN, 0, 2, lambda v: F.length(v) >= ASSIGN_LEAST),
        _kind(text, F.contains(text, F.lit("AKIA")), ACCESS, 1),
        _kind(text, text.rlike("[0-9a-f]{24}"), HEX, 2),
    )
    blobs = _kind(text, text.rlike(BLOB), BLOB, 3, 0, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    free = lambda b, x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
    both = F.struct(base.alias("base"), blobs.alias("blobs"))
    return let(both, lambda s: F.sort_array(F.concat(s["base"], F.filter(s["blobs"], lambda x: free(s["base"], x)))))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos, times) from rows (hash, repo, owner)."""
    each = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("times"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("times").alias("times"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("times").alias("times"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """(RID, doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live, copied) for each row of docs.

    docs must have RID. The owner is the column source unless another is given; a repository is an owner's part, by
    default the pair of source and lang. Null owners and repositories count as empty ones; a null text counts as empty
    and has no spans. Spans are kind:start:end in code points. `copied` lists the spans of copied examples: values that
    COPIED_OWNERS owners, COPIED_REPOS repositories or more have, or that stand COPIED_TIMES times or more in each of their
    repositories on average. `live` lists the spans of values that one owner alone has, that aren't copied and that look
    random; n_live and n_copied count them. Repeated rows stay, and each counts.
    """
    owner = F.coalesce((F.col("source") if owner is None else owner).cast("string"), F.lit(""))
    repo = F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit(""))) if repo is None else F.coalesce(repo.cast("string"), F.lit(""))
    rows = settle(docs.select(RID, F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), repo.alias("repo"), candidates(text_or_empty(text_col)).alias("found")))
    each = rows.filter(F.size("found") > 0).select(RID, "owner", "repo", F.explode("found").alias("x")).select(RID, "owner", "repo", "x.*")
    counts = ownership(each.select("hash", "owner", "repo"))
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS) | (F.col("times") >= COPIED_TIMES * F.col("repos"))
    live = (F.col("owners") == 1) & ~copied & F.col("random")
    judged = each.join(counts, "hash").select(RID, F.struct("start", "kind", "end", live.alias("live"), copied.alias("copied")).alias("x"))
    per_row = judged.groupBy(RID).agg(F.sort_array(F.collect_list("x")).alias("judged"))
    base = F.filter("found", lambda x: x["kind"] < 3)
    told = F.coalesce(F.filter("judged", lambda x: (x["kind"] < 3) | x["live"]), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,copied:boolean>>"))
    return (
        rows.join(per_row, RID, "left")
        .withColumns({"base": base, "told": told})
        .select(
            RID,
            "doc_id",
            _count(F.col("found"), 0).alias("n_assign"),
            _count(F.col("found"), 1).alias("n_access"),
            _count(F.col("found"), 2).alias("n_hex"),
            F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
            _listed(F.col("told")).alias("spans"),
            F.size(F.filter("told", lambda x: x["live"])).cast("long").alias("n_live"),
            F.size(F.filter("told", lambda x: x["copied"])).cast("long").alias("n_copied"),
            _listed(F.filter("told", lambda x: x["live"])).alias("live"),
            _listed(F.filter("told", lambda x: x["copied"])).alias("copied"),
        )
    )


@sheltered
def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", copied_mark: str = "[EXAMPLE]") -> DataFrame:
    """docs with each reported span of text_col replaced: secrets by mark, copied examples by copied_mark. Overlapping spans become
    one mark, that of secrets where one of them is no copied example.

    Rows without a span, null texts too, stay as they are. n_chars, where docs has it, follows the new text.
    """
    rows = numbered(docs)
    found = scan(rows, id_col, text_col).filter("spans <> ''").select(RID, F.split("spans", ",").alias("__spans"), F.split("copied", ",").alias("__copied"))
    part = lambda s, k: F.split(s, ":")[k].cast("int")
    ends = F.sort_array(F.transform("__spans", lambda s: F.struct(part(s, 1).alias("a"), part(s, 2).alias("b"), F.array_contains("__copied", s).alias("copied"))))
    # stretches to replace: one for all spans that overlap
    kind = "array<struct<a:int,b:int,copied:boolean>>"
    merged = F.aggregate(
        ends,
        F.array().cast(kind),
        lambda out, x: F.when(
            (F.size(out) > 0) & (x["a"] < F.coalesce(F.try_element_at(out, F.lit(-1))["b"], F.lit(0))),
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(out, F.lit(-1))["b"], x["b"]).alias("b"), (F.try_element_at(out, F.lit(-1))["copied"] & x["copied"]).alias("copied")))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    cut = found.select(RID, merged.alias("__cut"))
    before = F.transform("__cut", lambda x, i: F.concat(_between(F.col(text_col), F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__cut"), i - 1)["b"]), x["a"]), F.when(x["copied"], copied_mark).otherwise(mark)))
    new = F.concat(F.array_join(before, ""), _between(F.col(text_col), F.element_at("__cut", -1)["b"], F.length(text_col)))
    out = rows.join(cut, RID, "left").withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _between(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, a + 1, b - a)


def secret_rows(docs: DataFrame) -> DataFrame:
    return scan(numbered(docs)).drop(RID)
