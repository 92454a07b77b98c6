"""The registered queries: every operator applied to whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homeward.config import KnnConfig, MatchConfig
from homeward.functions import confidence as C
from homeward.functions import contacts, identifiers, text, vectors
from homeward.operators import (
    agepairs,
    embedding,
    imageaudit,
    matching,
    notifications,
    records,
    search,
    stats,
    uploads,
    validation,
    vision,
)
from homeward.operators.knn import knn_join
from homeward.operators.knn_index import build_index, extend_index, knn_indexed, open_index
from homeward.plans import casework as cw
from homeward.session import checkpointed, run_dir
from homeward.sources import layout, tables
from homeward.sources.files import list_images, read_pairs, write_pairs
from homeward.streaming.arrivals import match_arrivals, notify_arrivals

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = MatchConfig(as_of_year=cw.AS_OF_YEAR, dim=cw.FOLDED_DIM)
SCORES = [
    "face_similarity", "metadata_similarity", "combined_score", "confidence_score",
    "age_consistency", "marks_similarity", "location_plausibility",
]


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Round to six places, the precision at which results are compared."""
    return df.withColumns({n: F.round(n, 6) for n in names if n in df.columns})


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return cw.table(spark, sf, "missing"), cw.table(spark, sf, "found")


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The larger tables without vectors, for everything that needs none."""
    return cw.table(spark, sf, "missing_forms"), cw.table(spark, sf, "found_forms")


# Matching


def _flat(matches: DataFrame, *more: str) -> DataFrame:
    ages = [
        f"match_details.{f.name}"
        for f in matches.schema["match_details"].dataType.fields
        if f.name not in matches.columns
    ]
    return _six(matches.selectExpr(*more, *matching.COMMON, *ages), *SCORES)


def match_missing_to_found(spark, sf):
    missing, found = _sides(spark, sf)
    return _flat(matching.match_missing_to_found(missing, found, CONFIG, explain=False))


def match_found_to_missing(spark, sf):
    missing, found = _sides(spark, sf)
    return _flat(matching.match_found_to_missing(missing, found, CONFIG, explain=False))


def match_bilateral(spark, sf):
    missing, found = _sides(spark, sf)
    return _six(matching.match_bilateral(missing, found, CONFIG, explain=False), *SCORES)


def _lookup(side: str) -> Query:
    """Look up every business id of a side, and as many unknown ones; at most one match each."""

    def query(spark, sf):
        missing, found = _sides(spark, sf)
        own = missing if side == "missing" else found
        known = own.select(F.col("case_id" if side == "missing" else "found_id").alias("id"))
        ids = known.unionByName(known.select(F.concat("id", F.lit("_gone")).alias("id")))
        one = MatchConfig(as_of_year=cw.AS_OF_YEAR, dim=cw.FOLDED_DIM, limit=1)
        looked_up = matching.search_by_id(missing, found, side, ids, one, explain=False)
        return _flat(looked_up, "business_id", "status", "record.image_url AS own_image_url")

    return query


def _knn(strategy: str, **options) -> Query:
    """Ten nearest neighbours over whole 64-d vectors, between the two sides."""

    def query(spark, sf):
        whole = cw.table(spark, sf, "vectors")
        missing, found = [
            df.select("point_id").join(
                whole, F.col("point_id") == F.col("image_id"), "inner"
            ).drop("image_id")
            for df in _sides(spark, sf)
        ]
        pairs = knn_join(
            missing, found, k=10, threshold=0.1, dim=cw.VECTOR_DIM,
            config=KnnConfig(strategy=strategy, **options),
        )
        return _six(pairs.select("query_id", "candidate_id", "face_similarity"), *SCORES)

    return query


def knn_index_query(spark, sf):
    """The found side indexed in two batches, then searched for the missing side's neighbours."""
    whole = cw.table(spark, sf, "vectors")
    missing, found = [
        df.select("point_id").join(whole, F.col("point_id") == F.col("image_id")).drop("image_id")
        for df in _sides(spark, sf)
    ]
    path = run_dir(spark, "index")
    late = F.pmod(F.xxhash64("point_id"), F.lit(4)) == 0
    build_index(found.filter(~late), path, cw.VECTOR_DIM, rows_per_cell=20)
    extend_index(found.filter(late), path, "late")
    extend_index(found.filter(late), path, "late")  # a repeated batch
    pairs = knn_indexed(missing, open_index(spark, path), k=10, threshold=0.1)
    return _six(pairs.select("query_id", "candidate_id", "face_similarity"), *SCORES)


def knn_filtered(spark, sf):
    """Nearest neighbours among the base records that meet metadata filters."""
    missing, found = _sides(spark, sf)
    women = search.filter_records(found, "found", {"gender": "female", "age_range": [18, 60]})
    pairs = knn_join(missing, women, k=10, threshold=0.45, dim=cw.FOLDED_DIM)
    return _six(pairs.select("query_id", "candidate_id", "face_similarity"), *SCORES)


OTHER_WEIGHTS = MatchConfig(
    as_of_year=cw.AS_OF_YEAR, dim=cw.FOLDED_DIM, metadata_weight=0.4,
    gender_weight=0.4, age_weight=0.2, marks_weight=0.1, location_weight=0.3,
)


def match_other_weights(spark, sf):
    missing, found = _sides(spark, sf)
    return _flat(matching.match_missing_to_found(missing, found, OTHER_WEIGHTS, explain=False))


def match_grid(spark, sf):
    """Histogram of the matches under three weightings, from one search."""
    grid = {
        "plain": CONFIG,
        "other": OTHER_WEIGHTS,
        "strict": replace(CONFIG, face_threshold=0.9, accept_combined=0.7, accept_metadata=0.8),
    }
    missing, found = _sides(spark, sf)
    matches = matching.match_grid(missing, found, grid)
    return _six(
        stats.confidence_histogram(matches, "configuration"), "avg_confidence", "avg_face_similarity"
    )


def _judged(spark, sf) -> DataFrame:
    missing, found = _sides(spark, sf)
    pairs = matching.candidates(missing, found, "missing", CONFIG)
    return matching.judge(matching.score(pairs, CONFIG), CONFIG)


def _of_candidates(*columns: str) -> Query:
    """Columns of the scored candidates of every missing record."""

    def query(spark, sf):
        return _six(_judged(spark, sf).select("query_id", "candidate_id", *columns), *columns)

    return query


def rerank(spark, sf):
    ranked = matching.rank(_judged(spark, sf))
    return _six(
        ranked.select(
            "query_id", "candidate_id", "match_rank", "face_similarity",
            "metadata_similarity", "combined_score",
        ),
        *SCORES,
    )


def accept(spark, sf):
    return _judged(spark, sf).select("query_id", "candidate_id", "accepted")


def reject_rules(spark, sf):
    return _judged(spark, sf).select("query_id", "candidate_id", "reject_rule")


def derive_filters(spark, sf):
    missing, found = _sides(spark, sf)
    columns = ["point_id", "want_gender", "want_age_low", "want_age_high"]
    parts = [
        matching.derive_filters(df, side, CONFIG).select(F.lit(side).alias("side"), *columns)
        for df, side in ((missing, "missing"), (found, "found"))
    ]
    return parts[0].unionByName(parts[1])


def prefiltered_match(spark, sf):
    missing, found = _sides(spark, sf)
    config = MatchConfig(as_of_year=cw.AS_OF_YEAR, dim=cw.FOLDED_DIM, prefilter=True)
    return _flat(matching.match_missing_to_found(missing, found, config, explain=False))


def conf_factors(spark, sf):
    parts = C.factors()
    df = _judged(spark, sf).select(
        "query_id",
        "candidate_id",
        parts["age_plausibility"].alias("age_plausibility"),
        parts["location_proximity"].alias("location_proximity"),
        parts["distinctive_features"].alias("distinctive_features"),
        C.temporal_factor().alias("temporal_consistency"),
    )
    return _six(df, "age_plausibility", "location_proximity", "distinctive_features")


def confidence(spark, sf):
    df = matching.with_confidence(_judged(spark, sf))
    return _six(
        df.select("query_id", "candidate_id", "confidence_score", "confidence_level"), *SCORES
    )


def explain(spark, sf):
    missing, found = _sides(spark, sf)
    matches = matching.match_missing_to_found(missing, found, CONFIG, explain=True)
    e = F.col("explanation")
    factors = [
        column
        for name in C.factors()
        for column in (
            e["factors"][name]["description"].alias(f"{name}_text"),
            F.round(e["factors"][name]["contribution"], 6).alias(f"{name}_part"),
        )
    ]
    cutoffs = [
        e["threshold_info"][n].alias(n) for n in ("very_high", "high", "medium", "low")
    ]
    return matches.select(
        "query_id",
        "candidate_id",
        e["confidence_level"].alias("confidence_level"),
        e["confidence_score"].alias("confidence_score"),
        *factors,
        F.array_join(e["reasons"], " | ").alias("reasons"),
        e["summary"].alias("summary"),
        F.array_join(e["recommendations"], " | ").alias("recommendations"),
        *cutoffs,
    )


def confidence_hist(spark, sf):
    missing, found = _sides(spark, sf)
    matches = matching.match_bilateral(missing, found, CONFIG, explain=False)
    return _six(
        stats.confidence_histogram(matches), "avg_confidence", "avg_face_similarity"
    )


def _stream(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """The rows of a table, one file or a folder of files, as a stream.

    A stream of a plain path must be given a folder; a pattern, which matches the table alone, may
    stand for either.
    """
    path = f"{sf}/{source}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(
        f"{sf}/[{source[0]}]{source[1:]}.parquet"
    )


def _raw_forms(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """A stream of the side's records as their senders would give them: no ids, any case."""
    forms = cw.derive(_stream(spark, sf, "embeddings"), side).withColumn("gender", F.upper("gender"))
    return forms.withColumnRenamed("point_id", "form_key").drop(
        "case_id", "found_id", "estimated_current_age"
    )


def match_stream(spark, sf):
    """Raw forms of both sides arrive on streams; found ones meet the stored missing ones."""
    root = run_dir(spark, "arrivals")
    tables.initialize_tables(spark, root)
    for side in ("missing", "found"):
        _arrive(_raw_forms(spark, sf, side), side, root, "all")
    return _six(tables.read_arrivals(spark, root, "found", "matches"), *SCORES)


def _arrive(forms: DataFrame, side: str, root: str, checkpoint: str, **options) -> None:
    match_arrivals(
        forms, side, root, f"{root}/{side}_{checkpoint}", CONFIG, F.col("form_key"),
        F.lit(cw.UPLOADED_AT), availableNow=True, **options,
    ).awaitTermination()


def match_arrivals_indexed(spark, sf):
    """Found forms on a stream, matched from an index of the missing table."""
    root = run_dir(spark, "indexed")
    tables.initialize_tables(spark, root)
    _arrive(_raw_forms(spark, sf, "missing"), "missing", root, "all")
    indexes = {"missing": f"{root}/missing_index"}
    build_index(
        tables.read_table(spark, root, "missing"), indexes["missing"], cw.FOLDED_DIM, rows_per_cell=20
    )
    _arrive(_raw_forms(spark, sf, "found"), "found", root, "all", indexes=indexes)
    return _six(tables.read_arrivals(spark, root, "found", "matches"), *SCORES)


def match_streams(spark, sf):
    """Found forms on two streams of different forms, one of which loses its checkpoint and starts anew."""
    root = run_dir(spark, "streams")
    tables.initialize_tables(spark, root)
    _arrive(_raw_forms(spark, sf, "missing"), "missing", root, "all")
    even = F.pmod(F.crc32(F.col("form_key").cast("binary")), F.lit(2)) == 0
    found = _raw_forms(spark, sf, "found")
    for forms, checkpoint in ((found.filter(even), "a"), (found.filter(~even), "b"), (found.filter(even), "c")):
        _arrive(forms, "found", root, checkpoint)
    return _six(tables.read_arrivals(spark, root, "found", "matches"), *SCORES)


# Tables


def _ingest(side: str) -> Query:
    def query(spark, sf):
        form = cw.table(spark, sf, f"{side}_uploads")
        prepared = form.withColumn("gender", F.lower("gender"))
        stored = records.ingest(
            prepared, side, cw.VECTOR_DIM, cw.UPLOADED_AT, cw.AS_OF_YEAR, F.col("upload_key")
        )
        return stored.withColumn("vector_size", F.size("embedding")).drop("embedding", "upload_key")

    return query


def stored_missing(spark, sf):
    """Intake appended to the stored table, which is then read back."""
    root = run_dir(spark, "tables")
    tables.initialize_tables(spark, root)
    form = cw.table(spark, sf, "missing_uploads").withColumn("gender", F.lower("gender"))
    stored = records.ingest(
        form, "missing", cw.VECTOR_DIM, cw.UPLOADED_AT, cw.AS_OF_YEAR, F.col("upload_key")
    )
    tables.append_rows(stored, root, "missing")
    back = tables.read_table(spark, root, "missing")
    return back.withColumn("vector_size", F.size("embedding")).select(
        "point_id", "case_id", "name", "age_at_disappearance", "year_disappeared", "gender",
        "collection_type", "upload_timestamp", "estimated_current_age", "vector_size",
    )


def reset_roundtrip(spark, sf):
    """Rows of both tables after the intake and after the tables were emptied."""
    root = run_dir(spark, "reset")
    tables.initialize_tables(spark, root)
    sides = ("missing", "found")
    for side in sides:
        form = cw.table(spark, sf, f"{side}_uploads").withColumn("gender", F.lower("gender"))
        stored = records.ingest(
            form, side, cw.VECTOR_DIM, cw.UPLOADED_AT, cw.AS_OF_YEAR, F.col("upload_key")
        )
        tables.append_rows(stored, root, side)

    def counted(moment: str) -> DataFrame:
        parts = [
            tables.read_table(spark, root, side).agg(
                F.lit(moment).alias("moment"), F.lit(side).alias("side"),
                F.countDistinct("point_id").alias("records"),
            )
            for side in sides
        ]
        return checkpointed(parts[0].unionByName(parts[1]))

    before = counted("stored")
    tables.reset_tables(spark, root)
    return before.unionByName(counted("reset"))


def ingest_rejects(spark, sf):
    parts = [
        records.ingest_rejects(cw.table(spark, sf, f"{side}_uploads"), side, cw.VECTOR_DIM)
        .select(F.lit(side).alias("side"), F.col(key).alias("business_id"), "error")
        for side, key in (("missing", "case_id"), ("found", "found_id"))
    ]
    return parts[0].unionByName(parts[1])


def _upload(side: str) -> Query:
    """Outcome of uploading every record of a side: stored, or rejected with its errors."""

    def query(spark, sf):
        forms = cw.table(spark, sf, side)
        done = uploads.upload(forms, side, CONFIG, cw.UPLOADED_AT, F.col("point_id"))
        key = "case_id" if side == "missing" else "found_id"
        stored = done.stored.select(
            key, F.col("point_id"), F.lit(None).cast("string").alias("errors")
        )
        rejected = done.rejected.select(
            key, F.lit(None).cast("string").alias("point_id"), F.array_join("errors", " | ")
        )
        return stored.union(rejected)

    return query


def prepare_forms(spark, sf):
    moment = F.lit(cw.UPLOADED_AT).cast("timestamp_ntz")
    form = cw.table(spark, sf, "missing_forms").withColumn(
        "case_id", F.when(F.col("height_cm").isNotNull(), F.col("case_id"))
    )
    done = records.prepare_form(form, "missing", moment, F.col("point_id"))
    return done.select(
        "point_id", "case_id", "gender", F.array_join("birthmarks", "|").alias("marks")
    )


def list_page(spark, sf):
    """The second page of the found table: it starts at the token the first page gives."""
    _, found = _stored(spark, sf)
    return search.list_page(found, limit=100, offset="f2").select(
        "point_id", "found_id", "current_age_estimate", "gender", "next_offset"
    )


def delete_points(spark, sf):
    missing, _ = _stored(spark, sf)
    left = records.delete_points(missing, cw.table(spark, sf, "withdrawn"))
    return left.select("point_id", "case_id", "name")


def update_metadata(spark, sf):
    missing, _ = _stored(spark, sf)
    changed = records.update_metadata(missing, cw.table(spark, sf, "metadata_patches"))
    return changed.select("point_id", "case_id", "contact", "height_cm", "estimated_current_age")


def get_points(spark, sf):
    missing, _ = _stored(spark, sf)
    found = records.get_points(missing, cw.table(spark, sf, "withdrawn"))
    return found.select("point_id", "case_id", "name", "contact")


def _bucketed(spark, sf) -> DataFrame:
    root = run_dir(spark, "buckets")
    layout.write_bucketed(_stored(spark, sf)[0], root, "missing", buckets=8)
    return layout.open_bucketed(spark, root, "missing")


def update_bucketed(spark, sf):
    """Patches joined to a table in buckets, which stays where it is."""
    changed = records.update_metadata(_bucketed(spark, sf), cw.table(spark, sf, "metadata_patches"))
    return changed.select("point_id", "case_id", "contact", "height_cm", "estimated_current_age")


def delete_bucketed(spark, sf):
    left = records.delete_points(_bucketed(spark, sf), cw.table(spark, sf, "withdrawn"))
    return left.select("point_id", "case_id", "name")


def points_zoned(spark, sf):
    root = run_dir(spark, "zones")
    layout.write_zoned(_stored(spark, sf)[0], root, "missing", rows_per_file=100)
    found = layout.points_zoned(spark, root, "missing", cw.table(spark, sf, "withdrawn"))
    return found.select("point_id", "case_id", "name", "contact")


def page_zoned(spark, sf):
    root = run_dir(spark, "zones")
    layout.write_zoned(_stored(spark, sf)[1], root, "found", rows_per_file=500)
    return layout.page_zoned(spark, root, "found", limit=100, offset="f2").select(
        "point_id", "found_id", "current_age_estimate", "gender", "next_offset"
    )


def search_zoned(spark, sf):
    """A search by gender and age over files sorted by them."""
    root, by = run_dir(spark, "zones"), ("gender", "current_age_estimate")
    layout.write_zoned(_stored(spark, sf)[1], root, "found", by, rows_per_file=500)
    hits = layout.search_zoned(spark, root, "found", {"gender": "female", "age_range": [18, 40]}, by)
    return hits.select("point_id", "gender", "current_age_estimate")


def person_record(spark, sf):
    missing, found = _stored(spark, sf)
    parts = [
        records.person_record(df).select("id", "contact", "image_url", "metadata.gender")
        for df in (missing, found)
    ]
    return parts[0].unionByName(parts[1])


def _filtered(side: str, filters: dict) -> Query:
    def query(spark, sf):
        table = cw.table(spark, sf, f"{side}_forms")
        return search.filter_records(table, side, filters).select("point_id", "gender", "name")

    return query


def search_metadata(spark, sf):
    missing, _ = _stored(spark, sf)
    hits = search.search_metadata(missing, "missing", {"gender": "male"})
    return hits.select("point_id", "case_id", "gender", "score")


def _with_case_name(cases: DataFrame) -> DataFrame:
    """The name as the metadata has it, in place of the JSON text."""
    named = F.get_json_object("metadata", "$.name").alias("metadata_name")
    return cases.select("*", named).drop("metadata")


def list_cases(spark, sf):
    return _with_case_name(search.list_cases(*_stored(spark, sf), limit=100))


def _cases_of(side: str) -> Query:
    def query(spark, sf):
        return _with_case_name(search.list_cases(*_stored(spark, sf), limit=20, case_type=side))

    return query


def case_stats(spark, sf):
    return stats.case_statistics(*_stored(spark, sf))


def collection_stats(spark, sf):
    missing, found = _sides(spark, sf)
    return stats.collection_stats(missing, "missing_persons").unionByName(
        stats.collection_stats(found, "found_persons")
    )


def search_stats(spark, sf):
    return stats.search_statistics(*_sides(spark, sf), CONFIG)


def data_health(spark, sf):
    uploads = [cw.table(spark, sf, f"{side}_uploads") for side in ("missing", "found")]
    return stats.data_health(*uploads, dim=cw.VECTOR_DIM)


# Validation and text


def _with_marks(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, text.form_list(F.col(f"{name}_text")))


def _errors(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "is_valid", F.array_join("errors", " | ").alias("errors"))


def _validate(side: str, strict: bool) -> Query:
    def query(spark, sf):
        marks = "birthmarks" if side == "missing" else "visible_marks"
        forms = _with_marks(cw.table(spark, sf, f"{side}_forms"), marks)
        check = validation.validate_missing if side == "missing" else validation.validate_found
        return _errors(check(forms, cw.AS_OF_YEAR, strict=strict), "point_id")

    return query


def validate_searches(spark, sf):
    checked = validation.validate_searches(cw.table(spark, sf, "saved_searches"), strict=True)
    return _errors(checked, "search_id", "threshold_ok", "age_range_ok")


def file_gate(spark, sf):
    return validation.file_gate(cw.table(spark, sf, "uploads")).drop("content")


def parse_marks(spark, sf):
    df = cw.table(spark, sf, "found_forms")
    marks = text.form_list(F.col("visible_marks_text"))
    return df.select(
        "point_id", F.size(marks).alias("n_marks"), F.array_join(marks, "|").alias("marks")
    )


def sanitize_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", text.sanitize(F.col("text")).alias("clean"))


def extract_email(spark, sf):
    def emails(df: DataFrame, kind: str, key: str, contact: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(key).cast("string").alias("key"),
            contacts.email_in(F.col(contact)).alias("email"),
        )

    missing, found = _stored(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return (
        emails(missing, "missing", "point_id", "contact")
        .unionByName(emails(found, "found", "point_id", "finder_contact"))
        .unionByName(emails(docs, "document", "doc_id", "text"))
    )


def notify_outbox(spark, sf):
    missing, found = _stored(spark, sf)
    missing = _with_marks(missing, "birthmarks")
    found = _with_marks(found, "visible_marks")
    line = lambda f: F.concat(f["label"], F.lit(": "), f["value"])
    parts = [
        notifications.outbox(df, side).select(
            "recipient",
            "subject",
            F.array_join(F.transform("fields", line), "\n").alias("body"),
            "image_url",
        )
        for df, side in ((missing, "missing"), (found, "found"))
    ]
    return parts[0].unionByName(parts[1])


def notify_stream(spark, sf):
    """The outbox of a stream on which every record arrives twice."""
    root, line = run_dir(spark, "outbox"), lambda f: F.concat(f["label"], F.lit(": "), f["value"])
    parts = []
    for side, marks in (("missing", "birthmarks"), ("found", "visible_marks")):
        stream = _stream(spark, sf, cw.TABLES[f"{side}_forms"][0])
        forms = _with_marks(cw.derive(stream, f"{side}_forms"), marks)
        twice = forms.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
        notify_arrivals(
            twice, side, f"{root}/{side}", f"{root}/{side}_checkpoint", F.col("upload_timestamp"),
            availableNow=True,
        ).awaitTermination()
        parts.append(spark.read.parquet(f"{root}/{side}").select(
            "recipient", "subject", F.array_join(F.transform("fields", line), "\n").alias("body"), "image_url",
        ))
    return parts[0].unionByName(parts[1])


def make_ids(spark, sf):
    log = cw.table(spark, sf, "arrivals_log")
    return log.select(
        "event_id",
        identifiers.dated_id("MISS", F.col("event_id"), F.col("ts")).alias("dated_id"),
        identifiers.millis_id("FOUND", F.col("ts"), F.col("event_id")).alias("millis_id"),
    )


# Vectors


def vec_normalize(spark, sf):
    df = cw.table(spark, sf, "vectors")
    unit = df.select("image_id", F.posexplode(vectors.normalize(F.col("embedding"))))
    return _six(
        unit.select("image_id", F.col("pos").alias("position"), F.col("col").alias("value")),
        "value",
    )


def _paired_vectors(spark, sf) -> DataFrame:
    """Every listed pair of lineitem keys, with the vectors there are."""
    pairs, whole = cw.table(spark, sf, "vector_pairs"), cw.table(spark, sf, "vectors")
    return vision.with_vectors(pairs, whole, "pair_id")


def _of_compared(value: Column) -> Column:
    return F.when(F.col("status") == vision.COMPARED, value)


def _of_pairs(name: str, value: Callable[[Column, Column], Column]) -> Query:
    def query(spark, sf):
        pairs = _paired_vectors(spark, sf)
        result = _of_compared(value(F.col("left"), F.col("right")))
        return _six(pairs.select("pair_id", "status", result.alias(name)), name)

    return query


def sim_dist(spark, sf):
    pairs = _paired_vectors(spark, sf)
    cosine = _of_compared(vectors.cosine(F.col("left"), F.col("right")))
    df = pairs.select("pair_id", "status", cosine.alias("similarity")).withColumn(
        "distance", vectors.to_distance(F.col("similarity"))
    )
    return _six(
        df.withColumn("back", vectors.to_similarity(F.col("distance"))),
        "similarity", "distance", "back",
    )


def verify_pairs(spark, sf):
    pairs, whole = cw.table(spark, sf, "vector_pairs"), cw.table(spark, sf, "vectors")
    verified = vision.verify_pairs(pairs, whole, "pair_id")
    return _six(verified, "cosine_similarity", "euclidean_distance")


def doubled_model():
    """Stand-in for a user's network: an affine map of the input."""

    def predict(batch: np.ndarray) -> np.ndarray:
        return batch * 2.0 + 0.5

    return predict


def embed_batch(spark, sf):
    items = cw.table(spark, sf, "missing_uploads").select("case_id", "embedding")
    out = embedding.embed(items, "embedding", [cw.VECTOR_DIM], doubled_model, output="unit")
    flat = out.select("case_id", F.posexplode("unit"))
    return flat.groupBy("case_id").agg(
        F.count("*").alias("dim"),
        F.round(F.sum(F.col("col").cast("double") * (F.col("pos") + 1)), 3).alias("weighted_sum"),
    )


def embed_status(spark, sf):
    """Every item, whether it could be embedded or not."""
    items = cw.table(spark, sf, "missing_uploads").select("upload_key", "embedding")
    out = embedding.embed(items, "embedding", [cw.VECTOR_DIM], doubled_model, output="unit")
    return out.select("upload_key", "embedding_status", F.coalesce(F.size("unit"), F.lit(0)).alias("dim"))


# Images and age-labelled files


def detections(spark, sf):
    faces = vision.detections(cw.table(spark, sf, "detections"))
    box = F.col("bbox")
    return faces.select(
        "image_id", "face_id", *[box[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.round("confidence", 6).alias("confidence"), "area",
    )


def _best_face(by: str) -> Query:
    def query(spark, sf):
        faces = vision.detections(cw.table(spark, sf, "detections"))
        best = vision.best_face(faces, by)
        return best.select(
            "image_id", "face_id", F.round("confidence", 6).alias("confidence"), "area"
        )

    return query


def quality_gate(spark, sf):
    gated = vision.quality_gate(cw.table(spark, sf, "face_metrics"))
    return gated.select(
        "image_id", "is_sharp", "is_bright_enough", "is_contrasted", "is_good_quality"
    )


def image_valid(spark, sf):
    images = vision.image_valid(cw.table(spark, sf, "face_metrics"))
    return images.select("image_id", "width", "height", "channels", "is_valid")


def _gray(vector: str) -> Column:
    """Vector components as gray levels."""
    return F.transform(vector, lambda v: F.round((v.cast("double") + 1.0) * 127.5).cast("int"))


def _face_hashes(spark, sf) -> DataFrame:
    """Whole vectors as 8x8 gray thumbnails, hashed."""
    return cw.table(spark, sf, "face_thumbs").select(
        "image_id", vision.average_hash(_gray("embedding")).alias("hash")
    )


def _document_hashes(spark, sf) -> DataFrame:
    """A 64-pixel thumbnail from the digest of each whole text: exact copies share it."""
    digits = F.split("digits", "")
    pixels = F.transform(digits, lambda d: (F.conv(d, 16, 10).cast("int") * 17))
    return cw.table(spark, sf, "document_prints").select(
        "image_id", vision.average_hash(pixels).alias("hash")
    )


def image_audit(spark, sf):
    """Whole vectors as decoded 8x8 images, gray or in colour, some cut short."""
    digits = F.transform(_gray("embedding"), lambda p: F.lpad(F.hex(p), 2, "0"))
    number = F.col("image_id").cast("long")
    colour, whole = number % 3 == 1, F.array_join(digits, "")
    data = F.when(number % 5 == 0, F.substring(whole, 1, 100)).otherwise(
        F.when(colour, F.repeat(whole, F.lit(3))).otherwise(whole)
    )
    image = F.struct(
        F.col("image_id").alias("origin"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.when(colour, 3).otherwise(1).alias("nChannels"),
        F.when(colour, 16).otherwise(0).alias("mode"),
        F.unhex(data).alias("data"),
    )
    images = cw.table(spark, sf, "face_thumbs").select(image.alias("image"))
    audit = imageaudit.image_audit(images)
    hashed = audit.withColumn("hash", vision.average_hash(F.col("thumbnail")))
    return _six(hashed.drop("thumbnail"), "brightness", "contrast", "sharpness")


def dup_hash(spark, sf):
    return vision.duplicate_groups(_document_hashes(spark, sf))


def dup_near(spark, sf):
    """Face thumbnails whose hashes differ in at most seven bits."""
    return vision.near_duplicates(_face_hashes(spark, sf), 7)


def dup_members(spark, sf):
    return vision.duplicate_members(checkpointed(_document_hashes(spark, sf)))


def _files(spark, sf) -> DataFrame:
    return cw.table(spark, sf, "age_files")


def _ages_text(df: DataFrame) -> DataFrame:
    return df.withColumn("ages", F.array_join(F.col("ages").cast("array<string>"), ","))


def _of_files(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(_files(spark, sf))


def fg_pair_file(spark, sf):
    """Pairs written as a CSV data set with header and read back."""
    path = run_dir(spark, "pairs")
    write_pairs(agepairs.all_pairs(_files(spark, sf)), path)
    return read_pairs(spark, path)


def listed_images(spark, sf):
    """Rows of the files that a folder's image listing finds; the ``txt`` files are not listed."""
    folder = run_dir(spark, "images")
    rows = _files(spark, sf).repartition("path")
    for extension in ("JPG", "jpg", "txt"):
        rows.write.mode("append").option("extension", extension).csv(folder)
    listed = list_images(spark, folder).withColumn("file", F.regexp_extract("path", "[^/]+$", 0))
    lines = spark.read.text(folder).select(F.col("_metadata.file_name").alias("file"))
    return (
        lines.join(listed, "file")
        .groupBy(F.substring_index("file", ".", -1).alias("extension"))
        .agg(F.count("*").alias("rows"))
    )


def fg_overall_stats(spark, sf):
    return _six(agepairs.overall_stats(_files(spark, sf)), "avg_images", "avg_span")


QUERIES: dict[str, Query] = {
    # Matching
    "match_missing_to_found": match_missing_to_found,
    "match_found_to_missing": match_found_to_missing,
    "match_bilateral": match_bilateral,
    "match_arrivals": match_stream,
    "match_streams": match_streams,
    "match_arrivals_indexed": match_arrivals_indexed,
    "match_prefiltered": prefiltered_match,
    "search_by_case": _lookup("missing"),
    "search_by_found": _lookup("found"),
    "knn_topk": _knn("auto"),
    "knn_broadcast_queries": _knn("broadcast_queries"),
    "knn_blocked": _knn("blocked", rows_per_pivot=100, block_rows=64),
    "knn_merged": _knn("broadcast_queries", merge_fan_in=2),
    "knn_filtered": knn_filtered,
    "knn_indexed": knn_index_query,
    "match_other_weights": match_other_weights,
    "match_grid": match_grid,
    "rerank": rerank,
    "accept": accept,
    "reject_rules": reject_rules,
    "derive_filters": derive_filters,
    "gender_similarity": _of_candidates("gender_match"),
    "age_similarity": _of_candidates("age_consistency"),
    "marks_similarity": _of_candidates("marks_similarity"),
    "location_similarity": _of_candidates("location_plausibility"),
    "metadata_similarity": _of_candidates("metadata_similarity", "combined_score"),
    "conf_factors": conf_factors,
    "confidence": confidence,
    "confidence_hist": confidence_hist,
    "explain": explain,
    # Tables
    "ingest_missing": _ingest("missing"),
    "ingest_found": _ingest("found"),
    "stored_missing": stored_missing,
    "reset_roundtrip": reset_roundtrip,
    "ingest_rejects": ingest_rejects,
    "upload_missing": _upload("missing"),
    "upload_found": _upload("found"),
    "prepare_forms": prepare_forms,
    "list_page": list_page,
    "delete_points": delete_points,
    "update_metadata": update_metadata,
    "get_points": get_points,
    "update_bucketed": update_bucketed,
    "delete_bucketed": delete_bucketed,
    "points_zoned": points_zoned,
    "page_zoned": page_zoned,
    "search_zoned": search_zoned,
    "person_record": person_record,
    "filter_eq": _filtered("missing", {"gender": "male"}),
    "filter_in": _filtered("missing", {"gender": ["male", "Female", "unknown"]}),
    "filter_age_range": _filtered("missing", {"age_range": [20, 60]}),
    "filter_age_range_found": _filtered("found", {"age_range": [20, 60]}),
    "filter_conj": _filtered(
        "found", {"age_range": [18, 45], "gender": ["male", "female"], "additional_info": None}
    ),
    "search_metadata": search_metadata,
    "list_cases": list_cases,
    "list_cases_missing": _cases_of("missing"),
    "list_cases_found": _cases_of("found"),
    "case_stats": case_stats,
    "collection_stats": collection_stats,
    "search_stats": search_stats,
    "data_health": data_health,
    # Validation and text
    "validate_missing": _validate("missing", strict=False),
    "validate_found": _validate("found", strict=False),
    "validate_missing_strict": _validate("missing", strict=True),
    "validate_found_strict": _validate("found", strict=True),
    "validate_searches": validate_searches,
    "file_gate": file_gate,
    "parse_marks": parse_marks,
    "sanitize_text": sanitize_text,
    "extract_email": extract_email,
    "notify_outbox": notify_outbox,
    "notify_stream": notify_stream,
    "make_ids": make_ids,
    # Vectors
    "vec_normalize": vec_normalize,
    "vec_cosine": _of_pairs("cosine", vectors.cosine),
    "vec_euclid": _of_pairs("distance", vectors.euclidean),
    "sim_dist": sim_dist,
    "verify_pairs": verify_pairs,
    "embed_batch": embed_batch,
    "embed_status": embed_status,
    # Images and age-labelled files
    "detections": detections,
    "best_face": _best_face("confidence"),
    "best_face_by_area": _best_face("area"),
    "quality_gate": quality_gate,
    "image_valid": image_valid,
    "avg_hash": _face_hashes,
    "image_audit": image_audit,
    "dup_hash": dup_hash,
    "dup_members": dup_members,
    "dup_near": dup_near,
    "list_images": listed_images,
    "fg_parse": _of_files(agepairs.parse_files),
    "fg_by_person": _of_files(agepairs.files_by_person),
    "fg_dedup": _of_files(lambda f: agepairs.by_person(f).drop("n_files")),
    "fg_manifest": _of_files(agepairs.manifest),
    "fg_person_stats": _of_files(lambda f: _ages_text(agepairs.person_stats(f))),
    "fg_overall_stats": fg_overall_stats,
    "fg_sample": _of_files(lambda f: _ages_text(agepairs.sample_persons(f))),
    "fg_same_pairs": _of_files(agepairs.same_pairs),
    "fg_diff_pairs": _of_files(agepairs.different_pairs),
    "fg_all_pairs": _of_files(lambda f: agepairs.shuffled(agepairs.all_pairs(f))),
    "fg_pair_file": fg_pair_file,
    "fg_pair_counts": _of_files(lambda f: agepairs.pair_counts(agepairs.all_pairs(f))),
}
