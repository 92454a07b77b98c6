"""Matching missing against found records, a whole table at a time.

Vector candidates first (``knn_join``), metadata only on the survivors, then the
implausibility rules, the acceptance test, the final limit, and the confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeward.config import ConfidenceConfig, MatchConfig
from homeward.functions import confidence as C
from homeward.functions import similarity as S
from homeward.functions.contacts import contact_of
from homeward.functions.explanation import explanation
from homeward.operators.knn import Prefilter, knn_both, knn_join
from homeward.operators.knn_index import Index, knn_indexed
from homeward.schemas import AGE_COLUMN, BUSINESS_ID
from homeward.session import checkpointed

MISSING, FOUND = "missing", "found"

# Columns that travel with a candidate; free text stays behind unless asked for.
CARRIED = [
    "case_id", "found_id", "name", "age_at_disappearance", "year_disappeared",
    "current_age_estimate", "gender", "location_last_seen", "current_location",
    "contact", "finder_contact", "height_cm", "birthmarks", "visible_marks", "image_url",
]

_FEATURES = ["_gender", "_age", "_marks", "_place", "_place_words"]


def other_side(side: str) -> str:
    return FOUND if side == MISSING else MISSING


def _present(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def with_features(df: DataFrame, side: str, as_of_year: int) -> DataFrame:
    """Add the comparable form of every field the similarity uses."""
    places = _present(df, "location_last_seen", "current_location")
    if side == MISSING:
        age = S.age_now(F.col("age_at_disappearance"), F.col("year_disappeared"), as_of_year)
    else:
        age = S.known_age(F.col("current_age_estimate"))
    return df.withColumns({
        "_gender": S.gender_key(F.col("gender")),
        "_age": age,
        "_marks": S.mark_set(*_present(df, "birthmarks", "visible_marks")),
        "_place": S.location_key(*places),
    }).withColumn("_place_words", S.location_words(F.col("_place")))


def derive_filters(df: DataFrame, side: str, config: MatchConfig) -> DataFrame:
    """Search filters a record of ``side`` implies for the other side; NULL means no filter.

    A found person may have been missing for up to fifty years, a missing person is expected
    within the tolerance of the age they should have now.
    """
    gender = F.when(~F.col("gender").isin("unknown", "other", ""), F.col("gender"))
    if side == FOUND:
        age = F.col("current_age_estimate")
        low = F.greatest(F.lit(0), age - 50)
        high = F.least(F.lit(120), age + 5)
        usable = age.isNotNull() & (low <= high)
    else:
        age = F.col("age_at_disappearance") + (F.lit(config.as_of_year) - F.col("year_disappeared"))
        low = F.greatest(F.lit(0), age - config.age_tolerance)
        high = age + config.age_tolerance
        usable = age.isNotNull()
    return df.withColumns({
        "want_gender": gender,
        "want_age_low": F.when(usable, low),
        "want_age_high": F.when(usable, high),
    })


def candidates(
    queries: DataFrame,
    base: DataFrame,
    side: str,
    config: MatchConfig,
    carry: list[str] | None = None,
) -> DataFrame:
    """Vector candidates of ``queries`` (records of ``side``) among ``base`` (the other side)."""
    wanted = CARRIED if carry is None else carry
    left = with_features(queries, side, config.as_of_year)
    right = with_features(base, other_side(side), config.as_of_year)
    prefilter = None
    if config.prefilter:
        left = derive_filters(left, side, config)
        prefilter = Prefilter(
            F.col("want_gender"), F.col("want_age_low"), F.col("want_age_high"),
            F.col("gender"), F.col(AGE_COLUMN[other_side(side)]),
        )
    return knn_join(
        left,
        right,
        k=config.pool_size,
        threshold=config.candidate_threshold,
        dim=config.dim,
        query_columns=[c for c in wanted if c in left.columns] + _FEATURES,
        base_columns=[c for c in wanted if c in right.columns] + _FEATURES,
        prefilter=prefilter,
        config=config.knn,
    ).withColumn("search_type", F.lit(other_side(side)))


def candidates_in_index(
    queries: DataFrame, index: Index, side: str, config: MatchConfig, carry: list[str] | None = None
) -> DataFrame:
    """Vector candidates of ``queries`` (records of ``side``) in an index of the other side's table."""
    if config.prefilter:
        raise ValueError("an index is searched without derived filters")
    wanted = CARRIED if carry is None else carry
    left = with_features(queries, side, config.as_of_year)
    return knn_indexed(
        left,
        index,
        k=config.pool_size,
        threshold=config.candidate_threshold,
        query_columns=[c for c in wanted if c in left.columns] + _FEATURES,
        base_columns=[c for c in wanted if c in index.rows.columns] + _FEATURES,
        prepare=lambda rows: with_features(rows, other_side(side), config.as_of_year),
        config=config.knn,
    ).withColumn("search_type", F.lit(other_side(side)))


def candidates_of_both(
    missing: DataFrame, found: DataFrame, config: MatchConfig, carry: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Vector candidates of the missing and of the found records, every pair scored once.

    Ids and scores are written once for both directions; the records are joined to them.
    """
    wanted = CARRIED if carry is None else carry
    sides = {MISSING: missing, FOUND: found}
    pairs = checkpointed(
        knn_both(missing, found, config.pool_size, config.candidate_threshold, config.dim, config.knn)
    )

    def rows(side: str, key: str, name: str) -> DataFrame:
        df = with_features(sides[side], side, config.as_of_year)
        columns = ["point_id", *[c for c in wanted if c in df.columns], *_FEATURES]
        return df.select(
            F.col("point_id").cast("string").alias(key), F.struct(*dict.fromkeys(columns)).alias(name)
        )

    def direction(side: str, reverse: bool) -> DataFrame:
        mine = pairs.filter(F.col("reverse") == reverse).drop("reverse")
        return (
            mine.join(rows(side, "query_id", "query"), "query_id")
            .join(rows(other_side(side), "candidate_id", "candidate"), "candidate_id")
            .withColumn("search_type", F.lit(other_side(side)))
        )

    return direction(MISSING, False), direction(FOUND, True)


def score(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """Add the agreement components, the metadata similarity and the combined score."""
    return blend(agreement(pairs, config), config)


def agreement(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """Add the agreement components, which no weight enters."""
    q, c = F.col("query"), F.col("candidate")
    age_missing = F.when(F.col("search_type") == FOUND, q["_age"]).otherwise(c["_age"])
    age_found = F.when(F.col("search_type") == FOUND, c["_age"]).otherwise(q["_age"])
    return pairs.withColumns({
        "gender_match": S.gender_match(q["_gender"], c["_gender"]),
        "age_consistency": S.age_consistency(age_found, age_missing, config.age_tolerance),
        "marks_similarity": S.marks_similarity(q["_marks"], c["_marks"]),
        "location_plausibility": S.location_plausibility(
            q["_place"], q["_place_words"], c["_place"], c["_place_words"]
        ),
    })


def blend(components: DataFrame, config) -> DataFrame:
    """Add the metadata similarity and the combined score; weights are numbers or columns."""
    blended = components.withColumn(
        "metadata_similarity",
        S.metadata_similarity(
            F.col("gender_match"),
            F.col("age_consistency"),
            F.col("marks_similarity"),
            F.col("location_plausibility"),
            config,
        ),
    )
    return blended.withColumn(
        "combined_score",
        S.combined_score(F.col("face_similarity"), F.col("metadata_similarity"), config),
    )


def judge(scored: DataFrame, config: MatchConfig) -> DataFrame:
    """Add ``reject_rule`` (NULL when plausible) and ``accepted``."""
    rule = S.reject_rule(
        F.col("face_similarity"),
        F.col("metadata_similarity"),
        F.col("gender_match"),
        F.col("age_consistency"),
    )
    if not config.validate_both:
        rule = F.when(F.col("search_type") == FOUND, rule)
    return scored.withColumns({
        "reject_rule": rule,
        "accepted": S.accepted(
            F.col("face_similarity"),
            F.col("metadata_similarity"),
            F.col("combined_score"),
            config,
        ),
    })


def rank(pairs: DataFrame, first: Column | None = None) -> DataFrame:
    """Add ``match_rank``: position within the query by combined score, face similarity, id."""
    order = [F.desc("combined_score"), F.desc("face_similarity"), F.asc("candidate_id")]
    if first is not None:
        order.insert(0, first.desc())
    best_first = Window.partitionBy("query_id").orderBy(*order)
    return pairs.withColumn("match_rank", F.row_number().over(best_first))


def keep_best(judged: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best accepted, plausible pairs of every query, with ``match_rank``.

    The verdict is the first sort key and is filtered after ranking: a filter in front would be
    pushed below the scoring and evaluate all of it a second time.
    """
    passed = F.col("reject_rule").isNull() & F.col("accepted")
    ranked = rank(judged.withColumn("_kept", passed), F.col("_kept"))
    return ranked.filter((F.col("match_rank") <= limit) & F.col("_kept")).drop("_kept")


def with_confidence(
    scored: DataFrame, config: ConfidenceConfig = ConfidenceConfig(), explain: bool = False
) -> DataFrame:
    """Add confidence score and level, and on request the explanation struct."""
    parts = C.factors()
    result = scored.withColumn(
        "confidence_score", C.confidence_score(parts, F.col("gender_match"), config)
    ).withColumn("confidence_level", C.confidence_level(F.col("confidence_score"), config))
    if explain:
        result = result.withColumn(
            "explanation",
            explanation(
                parts,
                F.col("gender_match"),
                F.col("confidence_score"),
                F.col("confidence_level"),
                config,
            ),
        )
    return result


def _details(side: str) -> Column:
    q, c = F.col("query"), F.col("candidate")
    if side == MISSING:
        ages = [
            q["age_at_disappearance"].alias("query_age_at_disappearance"),
            q["year_disappeared"].alias("query_year_disappeared"),
            c["current_age_estimate"].alias("match_current_age"),
        ]
    else:
        ages = [
            q["current_age_estimate"].alias("query_current_age"),
            c["age_at_disappearance"].alias("match_age_at_disappearance"),
            c["year_disappeared"].alias("match_year_disappeared"),
        ]
    shared = ["search_type", "gender_match", "age_consistency", "marks_similarity",
              "location_plausibility"]
    return F.struct(*[F.col(n) for n in shared], *ages)


def match(
    queries: DataFrame,
    base: DataFrame,
    side: str,
    config: MatchConfig,
    confidence: ConfidenceConfig = ConfidenceConfig(),
    carry: list[str] | None = None,
    explain: bool = True,
) -> DataFrame:
    """Ranked, accepted matches of ``queries`` (records of ``side``) among the other side."""
    return match_candidates(
        candidates(queries, base, side, config, carry), side, config, confidence, explain
    )


def match_candidates(
    pairs: DataFrame,
    side: str,
    config: MatchConfig,
    confidence: ConfidenceConfig = ConfidenceConfig(),
    explain: bool = True,
) -> DataFrame:
    """Ranked, accepted matches of the vector candidates of records of ``side``."""
    limited = keep_best(judge(score(pairs, config), config), config.limit)
    c = F.col("candidate")
    contact = contact_of(c["contact"], F.lit(None)) if side == FOUND else contact_of(
        F.lit(None), c["finder_contact"]
    )
    details = ["gender_match", "age_consistency", "marks_similarity", "location_plausibility"]
    columns = [
        "search_type", "query_id", "candidate_id", "match_rank", "face_similarity",
        "metadata_similarity", "combined_score", "confidence_score", "confidence_level",
        *details,
    ]
    result = with_confidence(limited, confidence, explain)
    return result.select(
        *columns,
        _details(side).alias("match_details"),
        contact.alias("contact"),
        c["image_url"].alias("image_url"),
        *(["explanation"] if explain else []),
        c.dropFields(*_FEATURES).alias("metadata"),
    )


def match_missing_to_found(missing, found, config, **options) -> DataFrame:
    return match(missing, found, MISSING, config, **options)


def match_found_to_missing(missing, found, config, **options) -> DataFrame:
    return match(found, missing, FOUND, config, **options)


# Columns both directions share.
COMMON = [
    "search_type", "query_id", "candidate_id", "match_rank", "face_similarity",
    "metadata_similarity", "combined_score", "confidence_score", "confidence_level",
    "gender_match", "age_consistency", "marks_similarity", "location_plausibility",
    "contact", "image_url",
]


def match_bilateral(
    missing: DataFrame,
    found: DataFrame,
    config: MatchConfig,
    confidence: ConfidenceConfig = ConfidenceConfig(),
    carry: list[str] | None = None,
    explain: bool = True,
) -> DataFrame:
    """Both directions in one table, told apart by ``search_type``.

    Every pair of records is scored once for both. Filters that differ by direction need a search
    for each.
    """
    if config.prefilter:
        pools = candidates(missing, found, MISSING, config, carry), candidates(found, missing, FOUND, config, carry)
    else:
        pools = candidates_of_both(missing, found, config, carry)
    to_found, to_missing = (
        match_candidates(pool, side, config, confidence, explain)
        for pool, side in zip(pools, (MISSING, FOUND))
    )
    shared = [c for c in [*COMMON, "explanation"] if c in to_found.columns]
    return to_found.select(*shared).unionByName(to_missing.select(*shared))


# What configurations of a grid may differ in.
VARIED = [
    "gender_weight", "age_weight", "marks_weight", "location_weight", "gender_conflict_factor",
    "metadata_weight", "face_weight", "face_threshold", "accept_combined", "accept_face",
    "accept_metadata", "limit",
]


class _Varied:
    """A configuration whose weights are columns of the row."""

    def __init__(self, column: str, validate_both: bool):
        self._column, self.validate_both = column, validate_both

    def __getattr__(self, name: str) -> Column:
        return F.col(self._column)[name]


def match_grid(
    missing: DataFrame,
    found: DataFrame,
    grid: dict[str, MatchConfig],
    confidence: ConfidenceConfig = ConfidenceConfig(),
) -> DataFrame:
    """Matches of the missing records under many configurations, told apart by ``configuration``.

    Neighbours are searched and compared once; the rows are then repeated for each configuration,
    with its weights beside them. Configurations may differ in ``VARIED``; the pool of candidates is
    that of the first, and must be the same for all.
    """
    first = next(iter(grid.values()))
    fixed = ("as_of_year", "dim", "candidate_threshold", "pool_size", "age_tolerance", "validate_both", "prefilter")
    for name, config in grid.items():
        for field in fixed:
            if getattr(config, field) != getattr(first, field):
                raise ValueError(f"{name} differs in {field}, which a grid has in common")
    weights = [
        F.struct(F.lit(name).alias("configuration"), *[F.lit(getattr(config, f)).alias(f) for f in VARIED])
        for name, config in grid.items()
    ]
    compared = agreement(candidates(missing, found, MISSING, first), first)
    varied = compared.withColumn("_w", F.explode(F.array(*weights)))
    config = _Varied("_w", first.validate_both)
    judged = judge(blend(varied, config), config)
    passed = F.col("reject_rule").isNull() & F.col("accepted")
    best_first = Window.partitionBy("_w.configuration", "query_id").orderBy(
        F.desc("_kept"), F.desc("combined_score"), F.desc("face_similarity"), F.asc("candidate_id")
    )
    kept = (
        judged.withColumn("_kept", passed)
        .withColumn("match_rank", F.row_number().over(best_first))
        .filter((F.col("match_rank") <= F.col("_w.limit")) & F.col("_kept"))
    )
    return with_confidence(kept, confidence).select(
        F.col("_w.configuration").alias("configuration"), "search_type", "query_id", "candidate_id",
        "match_rank", "face_similarity", "metadata_similarity", "combined_score", "confidence_score",
        "confidence_level",
    )


def records_by_business_id(df: DataFrame, side: str, ids: list[str] | DataFrame) -> DataFrame:
    """Records with the given business ids; of several with one id the lowest point id."""
    key = BUSINESS_ID[side]
    if isinstance(ids, DataFrame):
        chosen = df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    else:
        chosen = df.filter(F.col(key).isin(list(ids)))
    return (
        chosen.groupBy(key)
        .agg(F.min_by(F.struct(*[c for c in df.columns]), "point_id").alias("_r"))
        .select("_r.*")
    )


# Outcomes of a lookup.
UNKNOWN_ID, NO_MATCH, MATCHED = "unknown id", "no match", "matched"


def search_by_id(
    missing: DataFrame,
    found: DataFrame,
    side: str,
    ids: list[str] | DataFrame,
    config: MatchConfig,
    **options,
) -> DataFrame:
    """Look records up by business id and match each against the other side.

    Every id that was asked for has at least one row: ``business_id``, ``status``, the ``record``
    itself (NULL for an unknown id) and the columns of its matches (NULL without any).
    """
    own, base = (missing, found) if side == MISSING else (found, missing)
    if isinstance(ids, DataFrame):
        asked = ids.select(F.col(ids.columns[0]).cast("string").alias("business_id")).distinct()
    else:
        rows = [(i,) for i in dict.fromkeys(ids)]
        asked = own.sparkSession.createDataFrame(rows, "business_id string")
    # Written once: the join counts, measures and scores its queries.
    queries = checkpointed(records_by_business_id(own, side, ids))
    matches = match(queries, base, side, config, **options)
    records = queries.select(
        F.col(BUSINESS_ID[side]).alias("business_id"),
        F.col("point_id").alias("_point"),
        F.struct(*[c for c in queries.columns if c != "embedding"]).alias("record"),
    )
    status = (
        F.when(F.col("_point").isNull(), UNKNOWN_ID)
        .when(F.col("query_id").isNull(), NO_MATCH)
        .otherwise(MATCHED)
    )
    return (
        asked.join(records, "business_id", "left")
        .join(matches, F.col("_point") == F.col("query_id"), "left")
        .select("business_id", status.alias("status"), "record", *matches.columns)
    )
