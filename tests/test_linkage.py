"""Blocking, decisions, metrics, tables, models and streams on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ravelin.config import Blocking, Ranking, Settings
from ravelin.functions.similarity import jaccard, numbers_of, set_jaccard
from ravelin.operators import blocking, candidates, decisions, features, metrics, normalize, sampling, training, validation, vectors
from ravelin.plans import spec
from ravelin.sources import roles, tables
from ravelin.streaming import chunks

RECORD = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def dev(spark):
    """Reference rows with an identical target each, targets without a partner, singletons that look like matches."""
    rows = [(f"S1-{i:03d}", f"Acme Manufacturing {i}", f"{100 + i} Main Street", ("United States", "India")[i % 2]) for i in range(200)]
    rows += [(f"S2-{i:03d}", f"Acme Manufacturing {i}", f"{100 + i} Main Street", ("United States", "India")[i % 2]) for i in range(200)]
    rows += [(f"S3-{i:03d}", f"Unrelated Business {i}", f"{900 + i} Other Road", "United States") for i in range(60)]
    records = normalize.spec(spark.createDataFrame(rows, RECORD)).persist()
    truth = spark.createDataFrame([(f"S1-{i:03d}", f"S2-{i:03d}") for i in range(200) if i % 10], "s1_id string, target_id string")
    return (*roles.split(records), truth)


def test_channels(spark):
    rows = [
        ("S1-1", "Rose Bakery", "12 High St", "US"), ("S2-1", "rose  bakery", "99 Low Rd", "usa"), ("S2-2", "Rose Bakery", "", "France"), ("S3-1", "Other", "12 Any Way", "US"),
        ("S3-2", "Rose Garden", "No address", "US"), ("S1-2", "Rose", "None here", "US"),
    ]
    s1, targets = roles.split(normalize.spec(spark.createDataFrame(rows, RECORD)))
    found = {(r.s1_id, r.target_id): r for r in blocking.candidates(s1, targets).collect()}
    assert set(found[("S1-1", "S2-1")].blocks) >= {"b1", "b2", "b3", "b4"} and ("S1-1", "S2-2") not in found
    assert "b10" in found[("S1-1", "S3-1")].blocks and "b11" not in found[("S1-1", "S3-1")].blocks
    assert "b9" not in found.get(("S1-2", "S3-1"), type("R", (), {"blocks": []})).blocks
    assert found[("S1-2", "S3-2")].blocks == ["b8"]
    loose = blocking.candidates(s1, targets, settings=Blocking(same_country=False))
    assert loose.filter("s1_id = 'S1-1' AND target_id = 'S2-2'").count() == 1


def test_empty_house_is_a_key(spark):
    rows = [("S1-1", "a", "rare lane", "x"), ("S2-1", "b", "rare road", "x"), ("S2-2", "c", "rare 5", "x")]
    s1, targets = roles.split(normalize.spec(spark.createDataFrame(rows, RECORD)))
    assert [r.target_id for r in blocking.candidates(s1, targets, ("b9",)).collect()] == ["S2-1"]
    assert blocking.candidates(s1, targets, ("b11",)).count() == 0


@pytest.mark.parametrize(("truncate", "left"), [(False, 0), (True, 3)])
def test_caps(spark, truncate, left):
    keys = spark.createDataFrame([(f"S2-{k}", "x", "b1", "k") for k in range(4)], "id string, country string, channel string, key string")
    assert blocking.capped(keys, 3, truncate).count() == left and blocking.capped(keys, 4, truncate).count() == 4


def test_union_with_neighbours(spark):
    blocks = spark.createDataFrame([("S1-1", "S2-1", ["b3", "b5"], 2, 1.5)], "s1_id string, target_id string, blocks array<string>, block_count long, rare_w double")
    near = spark.createDataFrame([("S1-1", "S2-1", 0.4, 3), ("S1-1", "S2-1", 0.6, 5), ("S1-1", "S3-9", 0.2, 0)], "s1_id string, target_id string, score double, ann_rank int")
    got = {r.target_id: r for r in candidates.with_neighbours(blocks, near).collect()}
    assert (got["S2-1"].blocks, got["S2-1"].block_count, got["S2-1"].ann_score, got["S2-1"].ann_rank) == (["b3", "b5"], 2, 0.6, 3)
    assert (got["S3-9"].blocks, got["S3-9"].block_count, got["S3-9"].hit_ann, got["S3-9"].ann_rank) == ([], 0, True, 0)


def test_equal_scores_take_the_higher_id(spark):
    pairs = spark.createDataFrame([("S1-1", f"S2-{k}") for k in range(4)], "s1_id string, target_id string")
    assert [r.target_id for r in candidates.ranked(pairs, 2, F.lit(1.0)).orderBy("block_rank").collect()] == ["S2-3", "S2-2"]


@pytest.mark.parametrize(("truth", "found", "want"), [([], [], (1, 1, 1)), ([], ["a"], (0, 0, 0)), (["a"], [], (0, 0, 0)), (["a", "c"], ["a", "b", "c"], (0.7142857, 2 / 3, 1)), (["a"], ["b"], (0, 0, 0))])
def test_scores(spark, truth, found, want):
    frame = lambda x: spark.createDataFrame([("S1-1", x)], "s1_id string, matched array<string>")
    row = metrics.entity_scores(frame(truth), frame(found)).first()
    assert (row.f05, row.precision, row.recall) == pytest.approx(want)


def test_scores_over_both_tables(spark):
    one = spark.createDataFrame([("S1-1", ["a"])], "s1_id string, matched array<string>")
    two = spark.createDataFrame([("S1-2", ["a"])], "s1_id string, matched array<string>")
    assert metrics.macro(metrics.entity_scores(one, two)).first().n_entities == 2


def scored(spark, *rows):
    return spark.createDataFrame(rows, "s1_id string, target_id string, p double, house_conflict int, postal_conflict int, name_exact int")


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([(0.8, 1, 0, 0), (0.75, 0, 0, 0)], 0), ([(0.9, 1, 0, 0), (0.75, 0, 0, 0)], 1), ([(0.8, 1, 0, 1), (0.75, 0, 0, 0)], 1), ([(0.8, 0, 0, 0), (0.75, 0, 0, 0)], 1),
        ([(0.7, 0, 0, 1)], 0), ([(0.8, 1, 0, 0), (0.79, 1, 0, 0)], 2), ([(0.8, 1, 0, 0)], 1),
    ],
)
def test_gate(spark, rows, kept):
    frame = scored(spark, *[("S1-1", f"S2-{k}", *r) for k, r in enumerate(rows)])
    assert decisions.gate(frame, 0.78, 0.6).count() == kept


def test_sweep_takes_the_first_best(spark):
    frame = spark.createDataFrame([("S1-1", "S2-1", 0.9, 1)], "s1_id string, target_id string, p double, label int")
    truth = spark.createDataFrame([("S1-1", ["S2-1"])], "s1_id string, matched array<string>")
    swept = metrics.sweep(frame, truth, [(0.95,), (0.3,), (0.5,)], ("threshold",), lambda s: F.col("p") >= s[0])
    assert metrics.best(swept) == (0.3, 1.0)


def test_outputs(spark):
    s1 = spark.createDataFrame([("S1-2",), ("S1-1",)], "s1_id string")
    lists = spark.createDataFrame([("S1-1", ["S3-1", "S2-9", "S2-9", "S1-1"])], "s1_id string, matched array<string>")
    got = {r[0]: r[1] for r in tables.matching_output(s1, lists).collect()}
    assert got == {"S1-1": "S2-9,S3-1", "S1-2": ""}
    clean = tables.matching_output(s1, lists)
    wide = clean.withColumnRenamed("matched_entity_ids", "candidate_entity_ids")
    assert validation.validate(clean, wide, s1).count() == 0


def test_files(spark, tmp_path):
    path = tmp_path / "records.tsv"
    path.write_text('﻿entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted, name\t\tUS\n \tblank id\tx\ty\n', encoding="utf-8")
    rows = tables.read_records(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'A "quoted, name', "", "US")]
    (tmp_path / "bad.csv").write_text("entity_id,business_name,business_address,country\n")
    with pytest.raises(tables.SchemaError, match="commas"):
        tables.read_records(spark, str(tmp_path / "bad.csv"))
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,S2-1\nS1-2\t\nS1-3\tNaN\n")
    got = {r.s1_id: r.matched for r in tables.read_truth(spark, str(truth), wide_blanks=True).collect()}
    assert got == {"S1-1": ["S2-1", "S3-2"], "S1-2": [], "S1-3": []}
    manifest = tables.write_manifest(str(tmp_path / "m.json"), [str(path)], rows=1)
    assert manifest["rows"] == 1 and tables.verify_manifest(str(tmp_path / "m.json")) == []
    path.write_text("changed")
    assert tables.verify_manifest(str(tmp_path / "m.json")) == [str(path)]


def test_cache_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.ensure_cache(spark, str(tmp_path / "cache"), make).count() == 3
    assert made == [1]


def test_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 16))
    frame = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(data)], "id long, vector array<double>, g int").repartition(4)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = {}
    for r in vectors.exact_neighbours(frame.filter("id < 20"), frame, 5).collect():
        got.setdefault(r.query_id, []).append((r.ann_rank, r.target_id))
    assert all([t for _, t in sorted(v)] == np.argsort(-sims[k])[:5].tolist() for k, v in got.items()) and len(got) == 20
    same = vectors.exact_neighbours(frame.filter("id < 20"), frame, 5, same="g")
    assert same.filter("query_id % 2 <> target_id % 2").count() == 0
    recall = vectors.recall_at(vectors.indexed_neighbours(frame.filter("id < 20"), frame, 5, lists=8), vectors.exact_neighbours(frame.filter("id < 20"), frame, 5)).first().recall
    assert recall >= 0.9


def test_split_is_a_partition(spark, dev):
    s1, _, truth = dev
    lists = s1.select(F.col("entity_id").alias("s1_id"), F.col("country_norm").alias("country")).join(truth.groupBy("s1_id").agg(F.collect_set("target_id").alias("m")), "s1_id", "left").select("s1_id", "country", F.coalesce("m", F.array().cast("array<string>")).alias("matched"))
    parts = sampling.split(lists, 120, 40).collect()
    assert len({r.s1_id for r in parts}) == len(parts) and parts == sampling.split(lists, 120, 40).collect()
    assert abs(sum(r.part == "train" for r in parts) - 120) <= 4


def test_dev_run(spark, dev, tmp_path):
    s1, targets, truth = dev
    settings = Settings(ranking=Ranking(top_k=10))
    linker = spec.train(s1, targets, truth, 120, 60, settings)
    pairs = spec.featured(s1, targets, spec.candidate_table(s1, targets, settings, with_ann=False), 10, settings=settings)
    matches = decisions.as_matches(linker.decide(pairs))
    lists = s1.select(F.col("entity_id").alias("s1_id")).join(truth.groupBy("s1_id").agg(F.collect_set("target_id").alias("matched")), "s1_id", "left").select("s1_id", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))
    assert metrics.macro(metrics.entity_scores(lists, matches)).first().macro_f05 >= 0.85
    found = pairs.groupBy("s1_id").agg(F.collect_set("target_id").alias("candidates"))
    assert metrics.candidate_recall(lists, found).first().micro_recall == 1.0
    training.save(linker.model, str(tmp_path / "artifact"), t2=linker.t2)
    model, thresholds = training.load(spark, str(tmp_path / "artifact"))
    assert thresholds == {"t2": linker.t2} and training.score(model, pairs).count() == pairs.count()


def test_python_comes_after_the_limit(spark, dev):
    """Fuzzy features are evaluated above the per-entity limit."""
    s1, targets, _ = dev
    plan = spec.featured(s1, targets, spec.candidate_table(s1, targets, with_ann=False), 5, fuzzy=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("WindowGroupLimit")
    assert features.SPEC_ORDER == tuple(features.spec_features()) and len(features.SPEC_ORDER) == 36
    assert len(features.light_features()) == 26


def test_stream_goes_on_after_a_break(spark, dev, tmp_path):
    _, targets, _ = dev
    rows = [(f"S1-{i:03d}", f"Acme Manufacturing {i}", f"{100 + i} Main Street", ("United States", "India")[i % 2]) for i in range(30)]
    frame = spark.createDataFrame(rows, RECORD)
    link = lambda b: blocking.candidates(normalize.spec(b), targets, ("b12",)).select("s1_id", "target_id")
    places = [str(tmp_path / x) for x in ("in", "out", "state")]
    for part in (frame.filter("entity_id < 'S1-010'"), frame.filter("entity_id >= 'S1-010'")):
        part.coalesce(1).write.mode("append").parquet(places[0])
        chunks.link_stream(spark, *places, link, file_format="parquet").awaitTermination()
    assert spark.read.parquet(places[1]).count() == 30
    assert chunks.next_mode(50, {"FULL": 100, "FAST": 20}) == "FAST"


def test_common_key_does_not_multiply(spark):
    """One name in thousands of records on each side: a query gets its first targets by id, and the join makes no more."""
    from ravelin.config import Lists, Retrieval
    from ravelin.operators import retrieval

    def side(prefix, n):
        return spark.range(n).selectExpr(
            f"concat('{prefix}', lpad(id, 6, '0')) AS entity_id", "'us' AS country_norm", "'same name' AS name_norm", "'same' AS name_core", f"concat('{prefix} street ', id) AS address_norm", "'road 12345' AS address_raw"
        )

    s1, targets = side("S1-", 3000), side("S2-", 10_000)
    exact = retrieval.exact_lists(s1, targets)
    assert exact.count() == 3000 * Lists().exact_limit and exact.agg({"target_id": "max"}).first()[0] == "S2-000049"
    found = spark.createDataFrame([("S1-000000", "S2-000000")], "s1_id string, target_id string")
    more = retrieval.boosters(s1, targets, found)
    assert more.count() == 3000 * Retrieval().boosters
    assert sorted(r.target_id for r in more.filter("s1_id = 'S1-000000'").collect()) == [f"S2-{k:06d}" for k in range(1, 11)]


def _copied(spark, copies):
    """(S1, targets) with equal records, as they were read."""
    kinds = [(f"Rose {w} {'Ltd' if k % 2 else ''}", f"{10 + k % 3} {('High', 'Low')[k % 2]} St 1000{k % 4}", ("US", "France")[k % 5 == 0]) for k, w in enumerate(["Bakery", "Garden", "Bakery", "Mill", "Hall", "Garden", "Inn", "Bakery"])]
    kinds.append((None, None, None))
    rows = [(f"S{(7 * c + k) % 3 + 1}-{c * 31 % 97:03d}{k:03d}", *kind) for c in range(copies) for k, kind in enumerate(kinds)]
    return roles.split(spark.createDataFrame(rows, RECORD))


@pytest.mark.parametrize("settings", [Settings(), Settings(blocking=Blocking(rare_df_cap=9, posting_cap=14)), Settings(blocking=Blocking(rare_df_cap=30, posting_cap=5))])
def test_equal_records(spark, settings):
    """Lists, scores and counts are those of the records themselves, whatever the caps."""
    raw = _copied(spark, 6)
    s1, targets = (normalize.spec(x) for x in raw)
    pairs = candidates.sides(spec.candidate_table(s1, targets, settings, with_ann=False), s1, targets)
    some = ["s1_id", "target_id", "block_rank", "prescore", "blocks", "block_count", "name_norm_1", "address_tokens_2"]
    pairs = pairs.persist()
    for k in (4, 22) if settings == Settings() else (4,):
        want = sorted(map(repr, candidates.ranked(pairs, k, candidates.prescore()).select(some).collect()))
        assert want and sorted(map(repr, spec.best_pairs(*raw, k, settings).select(some).collect())) == want
    want = sorted(map(tuple, pairs.select("s1_id", "target_id", F.round(candidates.prescore(), 9)).collect()))
    assert sorted(map(tuple, spec.scored_pairs(*raw, settings).collect())) == want
    if settings.blocking.posting_cap != 14:
        return
    truth = raw[0].select(F.col("entity_id").alias("s1_id")).join(pairs.filter("hash(s1_id, target_id) % 3 = 0").groupBy("s1_id").agg(F.collect_list("target_id").alias("m")), "s1_id", "left")
    truth = truth.select("s1_id", F.coalesce("m", F.array().cast("array<string>")).alias("matched"))
    for row in spec.ablation(*raw, truth, settings).collect():
        channels = {"A": blocking.EXACT, "B": blocking.EXACT + blocking.NUMERIC, "C": blocking.CHANNELS}[row.variant]
        lists = blocking.candidates(s1, targets, channels, settings.blocking).groupBy("s1_id").agg(F.collect_set("target_id").alias("candidates"))
        recall, stats = metrics.candidate_recall(truth, lists).first(), metrics.count_stats(truth.select("s1_id"), lists).first()
        assert (row.micro_recall, row.macro_recall, row.avg_n, row.p95) == (*recall, stats.avg_n, stats.p95)


def test_equal_records_do_not_multiply_pairs(spark):
    few, many = (spec.profile_pairs(*map(spec.profiles, _copied(spark, n))).count() for n in (3, 12))
    assert few == many > 0


def test_rules_are_made_once_for_equal_entities(spark):
    """A step over the pairs of an entity sees equal entities once, and its result is that over each one's own pairs."""
    raw, seen = _copied(spark, 6), []
    rule = lambda rows: decisions.gate(rows.withColumns({"p": F.col("prescore") / 16, "house_conflict": F.lit(0), "postal_conflict": F.lit(0), "name_exact": F.lit(1)}), 0.2, 0.3).select("s1_id", "target_id", "p")
    got = spec.best_pairs(*raw, 4, then=lambda rows: (seen.append(rows.select("s1_id").distinct().count()), rule(rows))[1])
    want = rule(spec.best_pairs(*raw, 4))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    # the record without any text has no pairs
    assert seen == [raw[0].filter("business_name is not null").drop("entity_id").distinct().count()] and seen[0] < raw[0].count()


def test_columns_kept_part_profiles(spark):
    """Records that differ in a kept column only are not one; the lists stay."""
    s1, targets = (x.withColumn("business", F.substring("entity_id", -1, 1).cast("int") % 2) for x in _copied(spark, 6))
    got = spec.best_pairs(s1, targets, 4, keep=("business",))
    known = targets.select(F.col("entity_id").alias("target_id"), "business")
    assert got.join(known, "target_id").filter("NOT business <=> business_2").count() == 0
    plain = spec.best_pairs(s1.drop("business"), targets.drop("business"), 4)
    some = ("s1_id", "target_id", "block_rank", "prescore")
    assert sorted(map(tuple, got.select(*some).collect())) == sorted(map(tuple, plain.select(*some).collect()))


def test_truth_is_counted_not_listed(spark, tmp_path):
    """Scores of entities come from counts: the same as from lists, and no pair of the truth is made."""
    import re

    from ravelin.queries import base
    from ravelin.queries import decisions as queries

    place = "/root/testdata/sf0.001/part.parquet"
    part = spark.read.parquet(place)
    rows = part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1000)).withColumn("p_name", F.when(F.col("p_partkey") % 11 > 0, F.col("p_name")))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    found = queries.scored(spark, str(tmp_path)).filter("p >= 0.45")
    want = metrics.entity_scores(base.truth_lists(spark, str(tmp_path)), decisions.as_matches(found))
    got = queries.entity_scores(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("hit > 0").count() > 0
    for frame in (got, queries.gate(spark, str(tmp_path)), spec.ablation(*roles.split(roles.records(spark, str(tmp_path), business=True)), None)):
        assert not re.search(r"collect_set|label", frame._jdf.queryExecution().optimizedPlan().toString())


def test_pairs_are_exchanged_without_columns(spark):
    """No record's columns go with the pairs: hits have their scores' parts where they cross an exchange."""
    import re

    plan = spec.profile_pairs(*map(spec.profiles, _copied(spark, 3)))._jdf.queryExecution().optimizedPlan().toString()
    head = plan[: re.search(r"RepartitionByExpression \[s1_id", plan).start()]
    assert "Join" not in head and "tokens" not in head


def test_pairs_are_limited_before_they_are_exchanged(spark):
    """A task hands on its k best pairs of a profile at most, each once and without the records' columns."""
    raw = _copied(spark, 3)
    plan = spec.best_pairs(*raw, 4)._jdf.queryExecution().optimizedPlan().toString()
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "prescore" in line]
    assert limits and "Repartition" not in "".join(plan.splitlines()[plan.splitlines().index(limits[-1]) + 1 :][:3])
    first, other = map(spec.profiles, raw)
    pairs = spec._whole_pairs(first, other, Settings())
    assert pairs.count() == pairs.select("s1_id", "target_id").distinct().count() < blocking.hits(first.rows, other.rows, copies="copies").count()
    assert not [c for c in pairs.columns if c.endswith(("_1", "_2"))]


def test_pairs_hold_what_their_hits_held(spark):
    """A pair that its first common key gives has the channels and the weight of all its hits, whatever the caps."""
    for settings in (Blocking(), Blocking(rare_df_cap=9, posting_cap=14), Blocking(rare_df_cap=30, posting_cap=5), Blocking(same_country=False)):
        first, other = (spec.profiles(x, Settings(blocking=settings)) for x in _copied(spark, 6))
        sides = [p.rows.select(F.col("entity_id").alias(n)) for p, n in ((first, "s1_id"), (other, "target_id"))]
        got = blocking.pairs(first.rows, other.rows, sides, {}, settings, other.weight)
        want = blocking.merged(blocking.hits(first.rows, other.rows, settings=settings, copies=other.weight))
        some = ("s1_id", "target_id", F.col("bits").cast("int"), F.round("rare_w", 9))
        assert sorted(map(tuple, got.select(*some).collect())) == sorted(map(tuple, want.select(*some).collect())) != []


def test_kinds_are_made_once(spark):
    """Records are normalized once for all that is made of them: what is left to run has the pairs alone."""
    plan = spec.best_pairs(*_copied(spark, 3), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "ArrowEvalPython" not in plan


def test_sets_of_numbers_compare_like_tokens(spark):
    rows = [(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], []), (["x", "y"], ["y", "x", "x"]), ([], ["q"])]
    for empty in (1.0, 0.0):
        made = spark.createDataFrame(rows, "a array<string>, b array<string>").select(jaccard("a", "b", empty), set_jaccard(numbers_of("a"), numbers_of("b"), empty))
        assert all(want == got for want, got in made.collect())
