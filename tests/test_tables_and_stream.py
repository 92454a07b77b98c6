import pytest
from pyspark.sql import functions as F

from homeward.config import MatchConfig
from homeward.operators import matching, records, stats
from homeward.operators.knn_index import build_index, open_index, pick_pivots
from homeward.operators.uploads import upload
from homeward.plans import casework as cw
from homeward.schemas import FOUND_TABLE, MISSING_TABLE
from homeward.sources import tables
from homeward.streaming.arrivals import match_arrivals, notify_arrivals

CONFIG = MatchConfig(as_of_year=2024, dim=4)


def test_table_life_cycle(spark, tmp_path):
    root = str(tmp_path / "db")
    tables.initialize_tables(spark, root)
    assert tables.read_table(spark, root, "missing").schema == MISSING_TABLE
    assert tables.read_table(spark, root, "found").schema == FOUND_TABLE
    form = spark.createDataFrame(
        [([1.0, 0.0], "MISS_1", "Ann", 20, 2014, "female")],
        "embedding array<float>, case_id string, name string, age_at_disappearance int, "
        "year_disappeared int, gender string",
    )
    stored = records.ingest(form, "missing", 2, "2024-06-01", 2024, F.col("case_id"))
    tables.append_rows(stored, root, "missing")
    tables.initialize_tables(spark, root)  # keeps what is there
    table = tables.read_table(spark, root, "missing")
    assert [r.estimated_current_age for r in table.collect()] == [30]
    health = stats.data_health(table, tables.read_table(spark, root, "found"), 2).collect()
    assert {r.collection_name: r.status for r in health} == {
        "missing_persons": "healthy", "found_persons": "unhealthy",
    }
    rest = records.delete_points(table, table.select("point_id"))
    tables.write_table(rest, str(tmp_path / "next"), "missing")
    assert tables.read_table(spark, str(tmp_path / "next"), "missing").count() == 0
    tables.reset_tables(spark, root)
    assert tables.read_table(spark, root, "missing").count() == 0


def raw(df):
    forms = df.withColumn("gender", F.upper("gender")).withColumnRenamed("point_id", "form_key")
    return forms.drop("case_id", "found_id", "estimated_current_age")


def start(spark, side, folder, root, checkpoint, schema, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return match_arrivals(
        stream, side, root, checkpoint, CONFIG, F.col("form_key"), F.lit("2024-06-01T00:00:00"), availableNow=True,
        **options,
    )


COLUMNS = ["query_id", "candidate_id", "match_rank", "combined_score"]


@pytest.fixture
def arrivals(spark, sf_dir, tmp_path):
    """Forms of both sides in several files each, and helpers to run streams over them."""

    class Arrivals:
        root = str(tmp_path / "db")
        forms = {side: raw(cw.table(spark, sf_dir, side)) for side in ("missing", "found")}

        def write(self, side, name, condition="true", files=5):
            folder = str(tmp_path / f"incoming_{side}_{name}")
            self.forms[side].filter(condition).repartition(files).write.parquet(folder)

        def run(self, side, name, checkpoint=None, **options):
            folder = str(tmp_path / f"incoming_{side}_{name}")
            where = str(tmp_path / f"checkpoint_{side}_{checkpoint or name}")
            start(spark, side, folder, self.root, where, self.forms[side].schema, **options).awaitTermination()

        def stored(self, side):
            return tables.read_table(spark, self.root, side)

        def matches(self, side="found"):
            found = tables.read_arrivals(spark, self.root, side, "matches")
            return sorted(map(tuple, found.select(*COLUMNS).collect()))

        def expected(self):
            found, missing = self.stored("found"), self.stored("missing")
            batch = matching.match_found_to_missing(missing, found, CONFIG, explain=False)
            return sorted(map(tuple, batch.select(*COLUMNS).collect()))

        def check(self):
            """Everything is stored or rejected once, and matched as a batch would."""
            found = self.stored("found")
            assert found.count() == found.select("point_id").distinct().count()
            rejects = tables.read_arrivals(spark, self.root, "found", "rejects")
            assert found.count() + rejects.count() == self.forms["found"].count()
            assert self.matches() == self.expected() != []

    tables.initialize_tables(spark, Arrivals.root)
    made = Arrivals()
    made.write("missing", "all")
    made.run("missing", "all")
    return made


def test_a_stream_of_raw_forms_equals_a_batch(spark, arrivals):
    arrivals.write("found", "all")
    arrivals.run("found", "all")
    arrivals.check()
    assert len(tables.entries(spark, arrivals.root, "found", "stored")) > 1  # several batches
    found = arrivals.stored("found")
    assert found.filter("collection_type = 'found' and upload_timestamp is not null").count() == found.count()
    # The same forms again on a new stream, as after a lost checkpoint, change nothing.
    before = sorted(map(str, found.collect())), arrivals.matches()
    arrivals.run("found", "all", checkpoint="again")
    assert (sorted(map(str, arrivals.stored("found").collect())), arrivals.matches()) == before
    arrivals.check()
    tables.reset_tables(spark, arrivals.root)
    assert arrivals.stored("found").count() == arrivals.stored("missing").count() == 0


def test_two_streams_of_one_side_store_the_sum(arrivals):
    for name, condition in (("odd", "form_key % 4 = 1"), ("other", "form_key % 4 <> 1")):
        arrivals.write("found", name, condition)
        arrivals.run("found", name)
    arrivals.check()


@pytest.mark.parametrize("dies", ["before the entry", "before the matches"])
def test_a_batch_that_dies_half_way_is_made_up_for(spark, arrivals, monkeypatch, dies):
    arrivals.write("found", "all")
    calls = []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return original(*args, **kwargs)

    if dies == "before the matches":
        original = matching.match
        monkeypatch.setattr("homeward.streaming.arrivals.match", failing)
    else:
        written = tables.commit_part

        def commit(rows, root, side, kind, *names):
            if kind == "stored" and len(calls) < 2:
                calls.append(1)
                if len(calls) == 2:
                    rows.write.parquet(f"{root}/{side}_parts/{kind}/half")
                    raise RuntimeError("executor lost")
            return written(rows, root, side, kind, *names)

        monkeypatch.setattr("homeward.streaming.arrivals.commit_part", commit)
    with pytest.raises(Exception, match="executor lost"):
        arrivals.run("found", "all")
    monkeypatch.undo()
    # A new stream without the old one's checkpoint makes up for what was left undone.
    arrivals.run("found", "all", checkpoint="new")
    arrivals.check()
    stored, matched = (tables.entries(spark, arrivals.root, "found", k) for k in ("stored", "matches"))
    assert stored.keys() == matched.keys()


def test_streams_extend_and_search_indexes(spark, arrivals, tmp_path):
    indexes = {side: str(tmp_path / f"{side}_index") for side in ("missing", "found")}
    for side in indexes:
        make = build_index if side == "missing" else pick_pivots  # no found record yet
        make(arrivals.stored("missing"), indexes[side], CONFIG.dim, rows_per_cell=20)
        assert (open_index(spark, indexes[side]) is None) == (side == "found")
    arrivals.write("found", "all")
    arrivals.run("found", "all", indexes=indexes)
    arrivals.check()
    index = open_index(spark, indexes["found"])
    assert index.rows.count() == arrivals.stored("found").count()
    # And the other way round: what has been stored is found through its index.
    late = arrivals.forms["missing"].limit(20).withColumn("form_key", F.concat(F.lit("late"), "form_key"))
    late.coalesce(1).write.parquet(str(tmp_path / "incoming_missing_late"))
    arrivals.run("missing", "late", indexes=indexes)
    stored = arrivals.stored("missing").filter(F.col("point_id").isin(
        [r.point_id for r in tables.read_arrivals(spark, arrivals.root, "missing", "matches").selectExpr("query_id as point_id").distinct().collect()]
    ))
    want = matching.match_missing_to_found(stored, arrivals.stored("found"), CONFIG, explain=False)
    assert arrivals.matches("missing") == sorted(map(tuple, want.select(*COLUMNS).collect())) != []


def test_names_of_streams_live_in_their_checkpoints(spark, tmp_path):
    a, b = (tables.stream_name(spark, str(tmp_path / n)) for n in "ab")
    assert a != b and tables.stream_name(spark, str(tmp_path / "a")) == a


def test_notifications_go_out_once(spark, tmp_path):
    schema = "found_id string, finder_contact string, moment string"
    rows = [
        ("F1", "a@example.com", "2024-01-01 00:00:00"), ("F1", "a@example.com", "2024-01-01 01:00:00"),
        ("F2", "a@example.com", "2024-01-01 02:00:00"), ("F3", "no mail", "2024-01-01 03:00:00"),
    ]
    folder = str(tmp_path / "in")
    for _ in range(2):  # every record in two files, read one after the other
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    notify_arrivals(
        stream, "found", out, str(tmp_path / "checkpoint"), F.col("moment"), availableNow=True
    ).awaitTermination()
    sent = spark.read.parquet(out).collect()
    assert sorted((r.recipient, r.found_id) for r in sent) == [("a@example.com", "F1"), ("a@example.com", "F2")]


def test_upload_splits_whole_tables(spark, sf_dir):
    missing = cw.table(spark, sf_dir, "missing")
    done = upload(missing, "missing", CONFIG, "2024-06-01", F.col("point_id"))
    assert done.stored.count() + done.rejected.count() == missing.count()
    assert done.stored.filter("collection_type = 'missing'").count() == done.stored.count() > 0
    errors = {e for r in done.rejected.collect() for e in r.errors}
    assert "Contact must be a valid email or phone number" in errors
    # A stage after one that found errors is not reached.
    assert "gender: one of male, female, other, unknown" in errors
    assert not errors & {"Missing required field: gender", "Missing required metadata field: gender"}


def test_confidence_histogram(spark):
    df = spark.createDataFrame(
        [("found", "LOW", 0.4, 0.5), ("found", "LOW", 0.6, 0.7), ("missing", "HIGH", 0.8, 0.9)],
        "search_type string, confidence_level string, confidence_score double, face_similarity double",
    )
    rows = {(r[0], r[1]): tuple(r)[2:] for r in stats.confidence_histogram(df).collect()}
    assert rows["found", "LOW"] == (2, 0.5, pytest.approx(0.6))


def test_search_statistics(spark):
    side = spark.range(3).select(F.lit(1).alias("x"))
    row = stats.search_statistics(side, side.limit(1), CONFIG).first()
    assert (row.missing_persons_count, row.found_persons_count, row.total_records) == (3, 1, 4)
    assert (row.face_threshold, row.metadata_weight, row.age_tolerance) == (0.8, 0.3, 5)


def test_a_table_streams_from_a_file_and_from_a_folder_of_files(spark, tmp_path):
    """All queries on a stream of vectors share the step."""
    from homeward.plans.queries import QUERIES

    rows = [(i, [float((i * j * 7 + i) % 11 - 5) for j in range(1, 65)], i % 3) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    table.repartition(3).write.parquet(str(tmp_path / "folder" / "embeddings.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file" / "embeddings.parquet")
    folder, file = (
        sorted(map(str, QUERIES["match_arrivals"](spark, str(tmp_path / kind)).collect())) for kind in ("folder", "file")
    )
    assert folder == file != []
