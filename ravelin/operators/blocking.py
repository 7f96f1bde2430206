"""Deterministic blocking: all channels as one long key table for each side and one equi-join.

A record gives rows (id, country, channel, key); a channel's composite keys are joined by U+0001. Caps are applied on the
target side before the join: keys of the exact and numeric channels with more postings than the cap are dropped, those of
the rare-token channels are cut to the cap's first postings by id. Rarity comes first, so hot tokens never reach the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.config import Blocking

EXACT = ("b1", "b2", "b3", "b4", "b12")
NUMERIC = ("b5", "b6", "b7", "b10", "b11")
RARE = ("b8", "b9")
CHANNELS = EXACT + NUMERIC + RARE
_SEP = "\u0001"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df over twice a session's partitions by a key. A small side that a join multiplies must not end in one task, where
    adaptive execution would put it by its size; with another number than the session's, Spark can't take the step for one
    that an exchange before it has done already."""
    spark = df.sparkSession
    return df.repartition(2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)


def bit_of(name: Column, names: tuple[str, ...]) -> Column:
    """Each name's bit: sets of names are kept as numbers, which aggregate without objects."""
    return F.coalesce(*(F.when(name == n, F.lit(1 << k)) for k, n in enumerate(names)))


def names_of(bits: Column, names: tuple[str, ...]) -> Column:
    """The names of a set, in ascending order."""
    each = F.array(*(F.when(bits.bitwiseAND(F.lit(1 << names.index(n))) != 0, F.lit(n)) for n in sorted(names)))
    return F.filter(each, lambda x: x.isNotNull())


def _pair(*parts: Column) -> Column:
    return F.concat_ws(_SEP, *parts)


def _single(channel: str, key: Column, *needed: Column) -> Column:
    given = F.lit(True)
    for c in needed:
        given = given & (c != "")
    return F.when(given, F.array(F.struct(F.lit(channel).alias("channel"), key.alias("key")))).otherwise(F.array().cast("array<struct<channel:string,key:string>>"))


def _by_token(channel: str, tokens: Column, other: Column, needed: bool = True) -> Column:
    rows = F.transform(F.array_distinct(tokens), lambda t: F.struct(F.lit(channel).alias("channel"), _pair(t, other).alias("key")))
    return F.when(other != "", rows).otherwise(F.array().cast("array<struct<channel:string,key:string>>")) if needed else rows


def block_keys(normalized: DataFrame, channels: tuple[str, ...] = EXACT + NUMERIC, settings: Blocking = Blocking(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, country, channel, key, *keep) of the exact and numeric channels."""
    c = F.col
    first = F.slice(c("name_tokens"), 1, settings.name_tokens)
    made = {
        "b1": _single("b1", c("name_norm"), c("name_norm")),
        "b2": _single("b2", c("name_translit"), c("name_translit")),
        "b3": _single("b3", c("name_core"), c("name_core")),
        "b4": _single("b4", c("name_compact"), c("name_compact")),
        "b12": _single("b12", _pair(c("name_norm"), c("address_norm")), c("name_norm"), c("address_norm")),
        "b5": _single("b5", _pair(c("name_core"), c("house_number")), c("name_core"), c("house_number")),
        "b6": _by_token("b6", first, c("postal_candidate")),
        "b7": _by_token("b7", first, c("house_number")),
        "b10": _single("b10", c("numeric_signature"), c("numeric_signature")),
        "b11": _single("b11", _pair(c("postal_candidate"), c("house_number")), c("postal_candidate"), c("house_number")),
    }
    keys = F.concat(*(made[k] for k in channels))
    return normalized.select(c("entity_id").alias("id"), c("country_norm").alias("country"), *keep, F.explode(keys).alias("k")).select("id", "country", "k.channel", "k.key", *keep)


def _records(copies: str | None) -> Column:
    return F.sum(copies) if copies else F.count("*")


def capped(keys: DataFrame, cap: int, truncate: bool = False, copies: str | None = None) -> DataFrame:
    """Keys with at most cap postings; larger ones go, or keep their first postings by id. copies: see key_rows."""
    by_key = ("country", "channel", "key")
    if truncate:
        place = F.row_number().over(Window.partitionBy(*by_key).orderBy("id"))
        return keys.withColumn("place", place).filter(F.col("place") <= cap).drop("place")
    small = keys.groupBy(*by_key).agg(_records(copies).alias("n")).filter(F.col("n") <= cap).drop("n")
    return keys.join(small, [*by_key], "left_semi")


def document_frequency(normalized: DataFrame, tokens: str, by_country: bool = False, copies: str | None = None) -> DataFrame:
    """(country?, token, df): in how many records each token stands. copies: see key_rows."""
    group = ["country", "token"] if by_country else ["token"]
    rows = normalized.select(F.col("country_norm").alias("country"), *([copies] if copies else []), F.explode(F.array_distinct(tokens)).alias("token"))
    return rows.groupBy(*group).agg(_records(copies).alias("df"))


def idf(df: Column, n: Column) -> Column:
    """ln(n / (1 + df)); below zero for tokens of nearly all records."""
    return F.log(n / (F.lit(1) + df))


def rarest(normalized: DataFrame, df: DataFrame, tokens: str, most: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, country, token, df, *extra): each record's `most` rarest tokens, ties by token."""
    rows = normalized.select(F.col("entity_id").alias("id"), F.col("country_norm").alias("country"), *extra, F.explode(F.array_distinct(tokens)).alias("token")).join(df, "token", "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "token"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def rare_keys(targets: DataFrame, queries: DataFrame, settings: Blocking = Blocking(), copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(target keys, query keys with weight) of the rare-token channels.

    Frequencies and the number of records are the targets', over all countries. A query keeps its rarest tokens first and
    then those within the cap. b9 takes an empty house number for a key like any other. copies: see key_rows.
    """
    if copies and settings.rare_df_cap > settings.posting_cap:
        raise ValueError("a posting list that can be cut needs a row for each record")
    n = F.lit((targets.agg(F.sum(copies)).first()[0] or 0) if copies else targets.count())
    sides: list[list[DataFrame]] = [[], []]
    for channel, tokens in (("b8", "name_tokens"), ("b9", "address_tokens")):
        df = document_frequency(targets, tokens, copies=copies)
        rare = df.filter(F.col("df") <= settings.rare_df_cap)
        key = F.col("token") if channel == "b8" else _pair(F.col("token"), F.col("house_number"))
        rows = targets.select(F.col("entity_id").alias("id"), F.col("country_norm").alias("country"), "house_number", F.explode(F.array_distinct(tokens)).alias("token"))
        sides[0].append(rows.join(rare, "token", "left_semi").select("id", "country", F.lit(channel).alias("channel"), key.alias("key")))
        asked = rarest(queries, df, tokens, settings.query_tokens, ("house_number",)).filter(F.col("df") <= settings.rare_df_cap)
        weight = idf(F.col("df"), n) if channel == "b8" else F.lit(0.0)
        sides[1].append(asked.select("id", "country", F.lit(channel).alias("channel"), key.alias("key"), weight.alias("weight")))
    held = sides[0][0].unionByName(sides[0][1])
    # with copies no list can be longer than the frequency allows
    return held if copies else capped(held, settings.posting_cap, truncate=True), sides[1][0].unionByName(sides[1][1])


def key_rows(queries: DataFrame, targets: DataFrame, channels: tuple[str, ...] = CHANNELS, settings: Blocking = Blocking(), copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(query keys with weight, target keys) of all channels, after caps.

    copies names a column of targets that tells for how many equal records a row stands: frequencies and caps count records.
    """
    plain = tuple(k for k in channels if k not in RARE)
    left: list[DataFrame] = []
    right: list[DataFrame] = []
    if plain:
        left.append(block_keys(queries, plain, settings).withColumn("weight", F.lit(0.0)))
        keys = block_keys(targets, plain, settings, (copies,) if copies else ())
        right.append(capped(keys, settings.posting_cap, copies=copies).select("id", "country", "channel", "key"))
    if any(k in RARE for k in channels):
        rare_targets, rare_queries = rare_keys(targets, queries, settings, copies)
        left.append(rare_queries.filter(F.col("channel").isin(*channels)))
        right.append(rare_targets.filter(F.col("channel").isin(*channels)))
    asked, held = left[0], right[0]
    for more in left[1:]:
        asked = asked.unionByName(more)
    for more in right[1:]:
        held = held.unionByName(more)
    return asked, held


def _on(settings: Blocking) -> list[str]:
    return (["country"] if settings.same_country else []) + ["channel", "key"]


def hits(queries: DataFrame, targets: DataFrame, channels: tuple[str, ...] = CHANNELS, settings: Blocking = Blocking(), copies: str | None = None) -> DataFrame:
    """(s1_id, target_id, bit, weight): each pair once for each key that found it, with the channel's bit. copies: see key_rows."""
    asked, held = key_rows(queries, targets, channels, settings, copies)
    asked = spread(asked.withColumn("bit", bit_of(F.col("channel"), CHANNELS)), "id")
    return asked.withColumnRenamed("id", "s1_id").join(held.withColumnRenamed("id", "target_id"), _on(settings)).select("s1_id", "target_id", "bit", "weight")


def merged(found: DataFrame) -> DataFrame:
    """(s1_id, target_id, bits, block_count, rare_w): the pairs of hits once."""
    each = found.groupBy("s1_id", "target_id").agg(F.bit_or("bit").alias("bits"), F.sum("weight").alias("rare_w"))
    return each.select("s1_id", "target_id", "bits", F.bit_count("bits").cast("long").alias("block_count"), "rare_w")


def _number(channel: Column, key: Column) -> Column:
    """A key as a number: its hash, with the channel's place in the last four bits."""
    place = F.coalesce(*(F.when(channel == n, F.lit(k)) for k, n in enumerate(CHANNELS))).cast("long")
    return F.xxhash64(key).bitwiseAND(F.lit(-16)).bitwiseOR(place)


def pairs(queries: DataFrame, targets: DataFrame, sides: tuple[DataFrame, DataFrame], made: dict[str, Column], settings: Blocking = Blocking(), copies: str | None = None) -> DataFrame:
    """(s1_id, target_id, bits, rare_w, *made) of all channels: each pair once, whole where a key joins it.

    Every key of a record goes with the numbers of all of them, so the pair's first common key gives the pair with all its
    channels, and the others give nothing: what comes out needs no merge, and can be limited before it is exchanged.
    sides has records' columns by s1_id and target_id; made has columns that are made of both records' ones. copies: see key_rows.
    """
    asked, held = key_rows(queries, targets, CHANNELS, settings, copies)
    number = _number(F.col("channel"), F.col("key"))

    def whole(keys: DataFrame, side: DataFrame, name: str, *more: Column) -> DataFrame:
        """The keys with their record's columns and all its keys' numbers."""
        of = keys.withColumn("number", number).groupBy(F.col("id").alias(name)).agg(F.collect_list(F.struct("country", "channel", "key", "number")).alias("keys"), *more)
        return of.withColumn("numbers", F.col("keys.number")).join(side.hint("merge"), name).withColumn("k", F.explode("keys")).select("*", "k.*").drop("keys", "k")

    weighed = F.collect_list(F.when(F.col("weight") != 0, F.struct("number", "weight"))).alias("weights")
    left = whole(spread(asked, "id"), sides[0], "s1_id", weighed).withColumnRenamed("numbers", "numbers_1")
    right = whole(held, sides[1], "target_id").drop("number").withColumnRenamed("numbers", "numbers_2")
    common = F.array_intersect("numbers_1", "numbers_2")
    found = left.join(right if settings.same_country else right.drop("country"), _on(settings)).filter(F.col("number") == F.array_min(common))
    bits = F.aggregate("common", F.lit(0), lambda held, x: held.bitwiseOR(F.call_function("shiftleft", F.lit(1), x.bitwiseAND(F.lit(15)).cast("int"))))
    rare = F.aggregate(F.filter("weights", lambda x: F.array_contains("common", x["number"])), F.lit(0.0), lambda total, x: total + x["weight"])
    return found.withColumn("common", common).select("s1_id", "target_id", bits.alias("bits"), rare.alias("rare_w"), *(c.alias(k) for k, c in made.items()))


def candidates(queries: DataFrame, targets: DataFrame, channels: tuple[str, ...] = CHANNELS, settings: Blocking = Blocking(), copies: str | None = None) -> DataFrame:
    """(s1_id, target_id, blocks, block_count, rare_w): each pair once, with the channels that found it. copies: see key_rows."""
    each = merged(hits(queries, targets, channels, settings, copies))
    return each.select("s1_id", "target_id", names_of(F.col("bits"), CHANNELS).alias("blocks"), "block_count", "rare_w")


def family_counts(normalized: DataFrame) -> DataFrame:
    """(id, family): how many records share country, core name (or Latin view) and compact address."""
    name = F.when(F.col("name_core") != "", F.col("name_core")).otherwise(F.col("name_translit"))
    keyed = normalized.select(F.col("entity_id").alias("id"), "country_norm", name.alias("n"), "address_compact")
    sizes = keyed.groupBy("country_norm", "n", "address_compact").agg(F.count("*").alias("family"))
    return keyed.join(sizes, ["country_norm", "n", "address_compact"]).select("id", "family")
