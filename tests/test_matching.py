import pytest
from pyspark.sql import functions as F

from homeward.config import KnnConfig, MatchConfig
from homeward.operators import matching as M
from homeward.plans import casework as cw

# Results of the rules on the first four dimensions, computed beforehand in plain SQL.
GOLDEN_LEVELS = {
    "VERY_HIGH": (5, 4.6033),
    "HIGH": (180, 143.0707),
    "MEDIUM": (859, 569.3004),
    "LOW": (1201, 646.622),
    "VERY_LOW": (233, 60.9579),
}
GOLDEN_REJECTS = {1: 1065, 2: 92, 3: 301, 4: 66, None: 10928}
CONFIG = MatchConfig(as_of_year=2024, dim=4)
OPEN = MatchConfig(as_of_year=2024, dim=4, limit=10_000)


@pytest.fixture(scope="module")
def golden_sides(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("point_id"),
        F.slice("embedding", 1, 4).alias("embedding"),
    )
    return [
        cw.table(spark, sf_dir, side).drop("embedding").join(vectors, "point_id")
        for side in ("missing", "found")
    ]


def test_golden_match(golden_sides):
    matches = M.match_missing_to_found(*golden_sides, CONFIG, explain=False)
    got = {
        r[0]: (r[1], r[2])
        for r in matches.groupBy("confidence_level")
        .agg(F.count("*"), F.round(F.sum("confidence_score"), 4))
        .collect()
    }
    assert got == GOLDEN_LEVELS


def test_golden_rejections(golden_sides):
    judged = M.judge(M.score(M.candidates(*golden_sides, "missing", CONFIG), CONFIG), CONFIG)
    got = {r[0]: r[1] for r in judged.groupBy("reject_rule").count().collect()}
    assert got == GOLDEN_REJECTS
    passed = judged.filter("reject_rule is null and accepted").count()
    assert passed == 5244
    assert judged.agg(F.round(F.sum("metadata_similarity"), 3)).first()[0] == 3261.837
    assert judged.agg(F.round(F.sum("combined_score"), 3)).first()[0] == 7075.895


def test_scores_are_bounded_and_rejects_are_absent(golden_sides):
    judged = M.judge(M.score(M.candidates(*golden_sides, "missing", CONFIG), CONFIG), CONFIG)
    names = ["metadata_similarity", "combined_score", "gender_match", "age_consistency",
             "marks_similarity", "location_plausibility"]
    for name in names:
        low, high = judged.agg(F.min(name), F.max(name)).first()
        assert 0 <= low and high <= 1
    matches = M.match_missing_to_found(*golden_sides, CONFIG, explain=False)
    rejected = judged.filter("reject_rule is not null")
    assert matches.join(rejected, ["query_id", "candidate_id"], "left_semi").count() == 0


def test_directions_are_transposed_without_rules_and_limits(golden_sides):
    missing, found = golden_sides
    there = M.score(M.candidates(missing, found, "missing", OPEN), OPEN)
    back = M.score(M.candidates(found, missing, "found", OPEN), OPEN)
    columns = ["face_similarity", "metadata_similarity", "combined_score"]
    a = there.select("query_id", "candidate_id", *columns)
    b = back.select(F.col("candidate_id"), F.col("query_id"), *columns).toDF(
        "query_id", "candidate_id", *columns
    )
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_strategies_give_the_same_matches(golden_sides):
    def rows(knn):
        config = MatchConfig(as_of_year=2024, dim=4, knn=knn)
        matches = M.match_missing_to_found(*golden_sides, config, explain=False)
        return sorted(map(tuple, matches.select("query_id", "candidate_id", "match_rank").collect()))

    whole = rows(KnnConfig())
    assert rows(KnnConfig(strategy="blocked", rows_per_pivot=30, block_rows=40)) == whole
    assert rows(KnnConfig(strategy="broadcast_queries")) == whole


def test_rules_apply_to_the_other_direction_only_on_request(golden_sides):
    missing, found = golden_sides

    def rejected(validate_both):
        config = MatchConfig(as_of_year=2024, dim=4, validate_both=validate_both)
        pairs = M.candidates(found, missing, "found", config)
        return M.judge(M.score(pairs, config), config).filter("reject_rule is not null").count()

    assert rejected(False) == 0 < rejected(True)


def test_lookup(golden_sides):
    missing, found = golden_sides
    config = MatchConfig(as_of_year=2024, dim=4, limit=1)
    got = M.search_by_id(missing, found, "missing", ["MISS_2", "NONEXISTENT_ID_12345"], config)
    rows = got.collect()
    assert {r.business_id for r in rows} == {"MISS_2", "NONEXISTENT_ID_12345"} and len(rows) == 2
    known, unknown = sorted(rows, key=lambda r: r.business_id)
    assert known.record.case_id == "MISS_2" and known.status in ("matched", "no match")
    assert (unknown.status, unknown.record, unknown.query_id) == ("unknown id", None, None)
    gone = M.search_by_id(missing, found, "missing", ["NONEXISTENT"], config).collect()
    assert [r.status for r in gone] == ["unknown id"]


def test_lookup_takes_the_lowest_point_of_a_repeated_id(spark):
    df = spark.createDataFrame([("b", "X"), ("a", "X"), ("c", "Y")], "point_id string, case_id string")
    got = M.records_by_business_id(df, "missing", ["X"]).collect()
    assert [r.point_id for r in got] == ["a"]
    ids = spark.createDataFrame([("X",), ("X",), ("Z",)], "id string")
    assert [r.point_id for r in M.records_by_business_id(df, "missing", ids).collect()] == ["a"]


def test_a_child_is_found_grown_up(spark):
    missing = spark.createDataFrame(
        [("m1", [1.0, 0.1, 0.0], "DEMO_MISSING_001", "John Doe", 2, 2020, "male",
          "New York, USA", "family@example.com", None)],
        "point_id string, embedding array<float>, case_id string, name string, "
        "age_at_disappearance int, year_disappeared int, gender string, "
        "location_last_seen string, contact string, birthmarks array<string>",
    )
    found = spark.createDataFrame(
        [("f1", [1.0, 0.2, 0.1], "DEMO_FOUND_001", 22, "male", "Los Angeles, USA",
          "finder@example.com", None, "http://img/1"),
         ("f2", [-1.0, 0.2, 0.1], "DEMO_FOUND_002", 22, "male", "Los Angeles, USA",
          "finder@example.com", None, None)],
        "point_id string, embedding array<float>, found_id string, current_age_estimate int, "
        "gender string, current_location string, finder_contact string, "
        "visible_marks array<string>, image_url string",
    )
    config = MatchConfig(as_of_year=2040, dim=3)
    missing = missing.withColumn("image_url", F.lit(None).cast("string"))
    match = M.match_missing_to_found(missing, found, config).first()
    assert match.candidate_id == "f1" and match.contact == "finder@example.com"
    assert match.age_consistency == 1.0 and match.confidence_level == "HIGH"
    assert match.metadata.found_id == "DEMO_FOUND_001" and match.image_url == "http://img/1"
    assert match.match_details.match_current_age == 22
    back = M.match_found_to_missing(missing, found, config).collect()
    assert [(r.query_id, r.candidate_id) for r in back] == [("f1", "m1")]
    assert back[0].contact == "family@example.com"
    both = M.match_bilateral(missing, found, config, explain=False)
    assert {r.search_type for r in both.collect()} == {"found", "missing"}


def test_derived_filters(spark):
    missing = spark.createDataFrame(
        [("male", 20, 2020), ("unknown", 1, 2023), ("", None, 2020), (None, 5, 2000)],
        "gender string, age_at_disappearance int, year_disappeared int",
    )
    got = M.derive_filters(missing, "missing", CONFIG)
    assert [tuple(r)[3:] for r in got.collect()] == [
        ("male", 19, 29), (None, 0, 7), (None, None, None), (None, 24, 34),
    ]
    found = spark.createDataFrame([("male", 30), ("other", 118)], "gender string, current_age_estimate int")
    got = M.derive_filters(found, "found", CONFIG)
    assert [tuple(r)[2:] for r in got.collect()] == [("male", 0, 35), (None, 68, 120)]


def test_a_grid_of_weightings_equals_single_searches(spark, sf_dir, monkeypatch):
    from dataclasses import replace

    missing, found = cw.table(spark, sf_dir, "missing"), cw.table(spark, sf_dir, "found")
    plain = MatchConfig(as_of_year=2024, dim=4)
    grid = {
        "plain": plain, "weights": replace(plain, metadata_weight=0.4, gender_weight=0.4, age_weight=0.2),
        "strict": replace(plain, face_threshold=0.9, accept_combined=0.7), "few": replace(plain, limit=5, pool_factor=10),
    }
    searches = []
    original = M.knn_join
    monkeypatch.setattr(M, "knn_join", lambda *a, **k: (searches.append(1), original(*a, **k))[1])
    rows = M.match_grid(missing, found, grid).collect()
    assert len(searches) == 1
    columns = ["query_id", "candidate_id", "match_rank", "confidence_level"]
    for name, config in grid.items():
        want = M.match_missing_to_found(missing, found, config, explain=False)
        got = sorted(tuple(r[c] for c in columns) for r in rows if r.configuration == name)
        assert got == sorted(map(tuple, want.select(*columns).collect())) != []
    with pytest.raises(ValueError):
        M.match_grid(missing, found, {"a": plain, "b": replace(plain, age_tolerance=9)})
