"""Weighted retrieval: IDF-sum token search, rare tokens, numbers, character n-grams, and their unions.

Every channel is an equi-join of exploded keys with partial sums, then a per-record row_number that Spark turns into a
group limit before the exchange. Ties go to the lower target id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.config import Lists, Retrieval
from ravelin.functions import numbers, text
from ravelin.functions.similarity import jaccard
from ravelin.operators.blocking import bit_of, idf, names_of, spread


def token_rows(records: DataFrame, tokens: Column) -> DataFrame:
    """(id, country, token), distinct tokens of each record."""
    return records.select(F.col("entity_id").alias("id"), F.col("country_norm").alias("country"), F.explode(F.array_distinct(tokens)).alias("token"))


def weights(targets: DataFrame, rows: DataFrame, df_cap: int) -> DataFrame:
    """(country, token, df, idf) of indexed tokens: those in at most df_cap of a country's records."""
    sizes = targets.groupBy(F.col("country_norm").alias("country")).agg(F.count("*").alias("n"))
    df = rows.groupBy("country", "token").agg(F.count("*").alias("df")).filter(F.col("df") <= df_cap)
    return df.join(F.broadcast(sizes), "country").select("country", "token", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def _total(weight: str) -> Column:
    """A sum of weights to nine places: the order of addition must not decide between equal scores."""
    return F.round(F.sum(weight), 9).alias("score")


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best targets of each s1_id."""
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(score), "target_id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def idf_search(queries: DataFrame, targets: DataFrame, query_tokens: Column, target_tokens: Column, k: int, settings: Retrieval = Retrieval(), most: int | None = None) -> DataFrame:
    """(s1_id, target_id, score, rank): sum of idf over shared indexed tokens of a query's rarest ones, within a country."""
    held = token_rows(targets, target_tokens)
    indexed = weights(targets, held, settings.df_cap)
    asked = token_rows(queries, query_tokens).join(indexed, ["country", "token"])
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    asked = asked.withColumn("place", place).filter(F.col("place") <= (most or settings.query_tokens))
    postings = held.join(indexed.select("country", "token"), ["country", "token"], "left_semi")
    hits = spread(asked.select(F.col("id").alias("s1_id"), "country", "token", "idf"), "s1_id").join(postings.withColumnRenamed("id", "target_id"), ["country", "token"])
    return top(hits.groupBy("s1_id", "target_id").agg(_total("idf")), k)


def name_and_address(prefix: str = "") -> Column:
    return F.concat(F.col(f"{prefix}name_tokens"), F.col(f"{prefix}address_tokens"))


def multi_pass(queries: DataFrame, targets: DataFrame, settings: Retrieval = Retrieval()) -> DataFrame:
    """(s1_id, target_id, score): the full text (2K), name only (K) and address only (K), best score of each pair, then
    score and name overlap weighted, K kept."""
    k = settings.top_k
    passes = [
        idf_search(queries, targets, name_and_address(), name_and_address(), 2 * k, settings),
        idf_search(queries, targets, F.col("name_tokens"), F.col("name_tokens"), k, settings),
        idf_search(queries, targets, F.col("address_tokens"), F.col("address_tokens"), k, settings),
    ]
    best = passes[0].unionByName(passes[1]).unionByName(passes[2]).groupBy("s1_id", "target_id").agg(F.max("score").alias("score"))
    most = F.max("score").over(Window.partitionBy("s1_id"))
    named = best.withColumn("most", most).join(queries.select(F.col("entity_id").alias("s1_id"), F.col("name_tokens").alias("n1")), "s1_id").join(targets.select(F.col("entity_id").alias("target_id"), F.col("name_tokens").alias("n2")), "target_id")
    share = F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0)
    mixed = settings.score_weight * share + settings.name_weight * jaccard(F.col("n1"), F.col("n2"))
    return top(named.select("s1_id", "target_id", F.round(mixed, 9).alias("score")), k)


def _first(keys: DataFrame, limit: int) -> DataFrame:
    """The first `limit` records of each key by id, so that a key of very many records multiplies a query by no more."""
    place = F.row_number().over(Window.partitionBy("country", "kind", "key").orderBy("id"))
    return keys.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def boosters(queries: DataFrame, targets: DataFrame, found: DataFrame, settings: Retrieval = Retrieval()) -> DataFrame:
    """(s1_id, target_id, kind): up to `boosters` targets beyond `found` with the same name, core name or 5/6-digit number
    in the same country, in that order of preference, then by id. found has at most top_k targets of a query, so the first
    boosters + top_k of a key hold all that can be chosen."""

    def keys(rows: DataFrame) -> DataFrame:
        c = F.col
        kinds = F.concat(
            F.array(F.struct(F.lit(0).alias("kind"), c("name_norm").alias("key")), F.struct(F.lit(1).alias("kind"), c("name_core").alias("key"))),
            F.transform(numbers.pin_boosters(c("address_raw")), lambda p: F.struct(F.lit(2).alias("kind"), p.alias("key"))),
        )
        return rows.select(c("entity_id").alias("id"), c("country_norm").alias("country"), F.explode(kinds).alias("k")).select("id", "country", "k.kind", "k.key").filter("key <> ''")

    held = _first(keys(targets), settings.boosters + settings.top_k)
    hits = spread(keys(queries).withColumnRenamed("id", "s1_id"), "s1_id").join(held.withColumnRenamed("id", "target_id"), ["country", "kind", "key"])
    new = hits.groupBy("s1_id", "target_id").agg(F.min("kind").alias("kind")).join(found.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy("kind", "target_id"))
    return new.withColumn("place", place).filter(F.col("place") <= settings.boosters).drop("place")


def exact_lists(queries: DataFrame, targets: DataFrame, settings: Lists = Lists()) -> DataFrame:
    """(s1_id, target_id, place, exact_name, exact_address): same name and address, then same name, then same address,
    up to exact_limit, by id. The flags are the pair's own. A key's first exact_limit targets hold all that can be chosen."""

    def keys(rows: DataFrame) -> DataFrame:
        c = F.col
        both = F.when((c("name_norm") != "") & (c("address_norm") != ""), F.concat_ws("\u0001", "name_norm", "address_norm")).otherwise("")
        kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in enumerate((both, c("name_norm"), c("address_norm")))))
        return rows.select(c("entity_id").alias("id"), c("country_norm").alias("country"), F.explode(kinds).alias("k")).select("id", "country", "k.kind", "k.key").filter("key <> ''")

    held = _first(keys(targets), settings.exact_limit)
    hits = spread(keys(queries).withColumnRenamed("id", "s1_id"), "s1_id").join(held.withColumnRenamed("id", "target_id"), ["country", "kind", "key"])
    pairs = hits.groupBy("s1_id", "target_id").agg(F.min("kind").alias("kind")).withColumns({"exact_name": (F.col("kind") < 2).cast("int"), "exact_address": (F.col("kind") != 1).cast("int")})
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy("kind", "target_id"))
    return pairs.withColumn("place", place).filter(F.col("place") <= settings.exact_limit).drop("kind")


def rare_lists(queries: DataFrame, targets: DataFrame, column: str, k: int, settings: Lists = Lists(), query_column: str | None = None) -> DataFrame:
    """(s1_id, target_id, score, rank) by rare tokens of at least least_length characters of one field."""
    long = lambda c: F.filter(F.col(c), lambda t: F.length(t) >= settings.least_length)
    return idf_search(queries, targets, long(query_column or column), long(column), k, Retrieval(df_cap=settings.rare_df))


def translit_lists(queries: DataFrame, targets: DataFrame, settings: Lists = Lists()) -> DataFrame:
    """The rare-name search again with the queries' Latin view; scores count less."""
    latin = queries.withColumn("__latin", text.tokens(F.col("name_translit")))
    found = rare_lists(latin, targets, "name_tokens", settings.name_top, settings, "__latin")
    return found.withColumn("score", F.col("score") * settings.translit_factor)


def numeric_lists(queries: DataFrame, targets: DataFrame, settings: Lists = Lists()) -> DataFrame:
    """(s1_id, target_id, score, rank): weights for a shared postal number, house number and numeric signature."""

    def keys(rows: DataFrame) -> DataFrame:
        c = F.col
        kinds = F.array(
            F.struct(F.lit("p").alias("kind"), c("postal_candidate").alias("key"), F.lit(settings.postal_weight).alias("w")),
            F.struct(F.lit("h").alias("kind"), c("house_number").alias("key"), F.lit(settings.house_weight).alias("w")),
            F.struct(F.lit("s").alias("kind"), c("numeric_signature").alias("key"), F.lit(settings.signature_weight).alias("w")),
        )
        return rows.select(c("entity_id").alias("id"), c("country_norm").alias("country"), F.explode(kinds).alias("k")).select("id", "country", "k.kind", "k.key", "k.w").filter("key <> ''")

    place = F.row_number().over(Window.partitionBy("country", "kind", "key").orderBy("id"))
    held = keys(targets).drop("w").withColumn("place", place).filter(F.col("place") <= settings.numeric_cap).drop("place")
    hits = spread(keys(queries).withColumnRenamed("id", "s1_id"), "s1_id").join(held.withColumnRenamed("id", "target_id"), ["country", "kind", "key"])
    return top(hits.groupBy("s1_id", "target_id").agg(F.sum("w").alias("score")), settings.numeric_top)


def char_lists(queries: DataFrame, targets: DataFrame, column: str = "name_norm", settings: Lists = Lists()) -> DataFrame:
    """(s1_id, target_id, score, rank) by shared character trigrams, weighted by idf; too common ones don't count."""
    held = token_rows(targets, text.char_grams(F.col(column)))
    sizes = targets.groupBy(F.col("country_norm").alias("country")).agg(F.count("*").alias("n"))
    df = held.groupBy("country", "token").agg(F.count("*").alias("df")).join(F.broadcast(sizes), "country")
    rare = df.filter(F.col("df") <= F.greatest(F.lit(settings.char_df_least), F.floor(F.col("n") * settings.char_df_share)))
    indexed = rare.select("country", "token", idf(F.col("df"), F.col("n")).alias("idf"))
    asked = token_rows(queries, text.char_grams(F.col(column))).join(indexed, ["country", "token"])
    postings = held.join(indexed.select("country", "token"), ["country", "token"], "left_semi")
    hits = spread(asked.withColumnRenamed("id", "s1_id"), "s1_id").join(postings.withColumnRenamed("id", "target_id"), ["country", "token"])
    return top(hits.groupBy("s1_id", "target_id").agg(_total("idf")), settings.char_top)


def union_lists(lists: dict[str, DataFrame], settings: Lists = Lists()) -> DataFrame:
    """(s1_id, target_id, n, best_score, best_rank, blocks, order): channels together, most channels first."""
    rows = None
    for name, found in lists.items():
        part = found.select("s1_id", "target_id", F.lit(name).alias("block"), F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    names = tuple(lists)
    bits = rows.withColumn("bit", bit_of(F.col("block"), names)).groupBy("s1_id", "target_id").agg(F.bit_or("bit").alias("bits"), F.max("score").alias("best_score"), F.min("rank").alias("best_rank"))
    merged = bits.select("s1_id", "target_id", F.bit_count("bits").cast("long").alias("n"), "best_score", "best_rank", names_of(F.col("bits"), names).alias("blocks"))
    order = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("n"), F.desc("best_score"), "best_rank", "target_id"))
    return merged.withColumn("order", order)
