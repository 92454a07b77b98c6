import pytest
from pyspark.sql import functions as F

from homeward.functions import contacts, identifiers, text
from homeward.operators import records, search
from homeward.operators.notifications import outbox

FORM = (
    "embedding array<float>, case_id string, name string, age_at_disappearance int, "
    "year_disappeared int, gender string"
)


@pytest.fixture
def forms(spark):
    good = ([0.6, 0.8], "MISS_1", "Ann", 20, 2014, "female")
    rows = [
        good,
        (None, *good[1:]),
        ([], *good[1:]),
        ([1.0], *good[1:]),
        (good[0], None, *good[2:]),
        (*good[:3], None, None, good[5]),
    ]
    return spark.createDataFrame(rows, FORM)


def test_ingest_and_rejects(forms):
    key = F.monotonically_increasing_id()
    stored = records.ingest(forms, "missing", 2, "2024-06-01T00:00:00", 2024, key).collect()
    assert [r.estimated_current_age for r in stored] == [30]
    assert stored[0].collection_type == "missing" and len(stored[0].point_id) == 36
    errors = [r.error for r in records.ingest_rejects(forms, "missing", 2).collect()]
    assert errors == [
        "Embedding cannot be None or empty",
        "Embedding cannot be None or empty",
        "Embedding must be 2-dimensional, got 1",
        "Missing required metadata field: case_id",
        "Missing required metadata field: age_at_disappearance",
    ]


def test_prepare_form(spark):
    form = spark.createDataFrame(
        [(None, "MALE", " a, ,b "), ("MISS_9", "Female", " , ")],
        "case_id string, gender string, birthmarks_text string",
    )
    moment = F.lit("2024-12-20 22:40:00.123").cast("timestamp_ntz")
    first, second = records.prepare_form(form, "missing", moment, F.lit("k")).collect()
    assert first.case_id == "MISS_1734734400123_8254C329A928"
    assert (first.gender, first.birthmarks) == ("male", ["a", "b"])
    assert (second.case_id, second.birthmarks) == ("MISS_9", None)


def test_rows_of_a_batch_get_ids_of_their_own(spark):
    form = spark.range(1000).selectExpr(
        "cast(null as string) as case_id", "'MALE' as gender", "cast(id as string) as key",
        "array(1f, 2f) as embedding", "'Ann' as name", "20 as age_at_disappearance",
        "2014 as year_disappeared",
    )
    moment = F.lit("2024-12-20 22:40:00")
    prepared = records.prepare_form(form, "missing", moment, F.col("key"))
    same_case = prepared.withColumn("case_id", F.lit("MISS_1"))
    for forms in (prepared, same_case):
        stored = records.ingest(forms, "missing", 2, moment, 2024, F.col("key"))
        assert stored.select("point_id").distinct().count() == 1000
    assert prepared.select("case_id").distinct().count() == 1000


def test_identifiers(one):
    moment = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    dated = one(identifiers.dated_id("MISS", F.lit("k"), moment))
    assert dated.startswith("MISS_20240102030405_") and len(dated.rsplit("_", 1)[1]) == 6
    assert dated == one(identifiers.dated_id("MISS", F.lit("k"), moment))


TABLE = "point_id string, contact string, height_cm int, estimated_current_age int, gender string"


@pytest.fixture
def table(spark):
    rows = [(f"p{i}", f"c{i}", 100 + i, 20 + i, "male" if i % 2 else "female") for i in range(6)]
    return spark.createDataFrame(rows, TABLE)


def test_update_merges_patches(spark, table):
    patches = spark.createDataFrame(
        [("p1", 1, "a", None), ("p1", 3, None, 7), ("p1", 2, "b", 5), ("nobody", 1, "z", 1)],
        "point_id string, seq int, contact string, height_cm int",
    )
    got = {r.point_id: r for r in records.update_metadata(table, patches).collect()}
    assert (got["p1"].contact, got["p1"].height_cm, got["p1"].estimated_current_age) == ("b", 7, 21)
    assert got["p2"].contact == "c2" and len(got) == 6


def test_delete_and_get(spark, table):
    ids = spark.createDataFrame([("p1",), ("p1",), ("nobody",)], "point_id string")
    assert records.delete_points(table, ids).count() == 5
    assert [r.point_id for r in records.get_points(table, ids).collect()] == ["p1"]
    assert records.get_points(table, ["nobody"]).count() == 0


def test_pages_cover_the_table(table):
    seen, offset = [], None
    while True:
        page = search.list_page(table, limit=4, offset=offset).orderBy("point_id").collect()
        seen += [r.point_id for r in page]
        offset = page[0].next_offset if page else None
        if offset is None:
            break
    assert seen == [f"p{i}" for i in range(6)]


def test_filters(table):
    def ids(filters):
        return [r.point_id for r in search.filter_records(table, "missing", filters).collect()]

    assert ids({"gender": "male", "age_range": [21, 23]}) == ["p1", "p3"]
    assert ids({"contact": ["c0", "c5", "x"]}) == ["p0", "p5"]
    assert len(ids({})) == len(ids({"gender": None})) == 6
    assert search.search_metadata(table, "missing", {}, limit=2).count() == 2


def test_list_cases(spark):
    missing = spark.createDataFrame(
        [("m1", "M1", "A", "male", "")],
        "point_id string, case_id string, name string, gender string, contact string",
    )
    found = spark.createDataFrame(
        [(f"f{i}", f"F{i}", None, None, "f@x.org") for i in range(3)],
        "point_id string, found_id string, name string, gender string, finder_contact string",
    )
    rows = search.list_cases(missing, found, limit=2).collect()
    assert [r.id for r in rows] == ["m1", "f0", "f1"]
    assert rows[0].contact == contacts.NO_CONTACT and rows[1].contact == "f@x.org"
    assert search.list_cases(missing, found, case_type="found").count() == 3
    with pytest.raises(ValueError):
        search.list_cases(missing, found, limit=501)
    with pytest.raises(ValueError):
        search.list_cases(missing, found, case_type="lost")


@pytest.mark.parametrize(
    "contact, want",
    [
        ("a@b.org", "a@b.org"),
        ("  a.b+c@d-e.co \n", "a.b+c@d-e.co"),
        ("mail me: x_y@z.net now", "x_y@z.net"),
        ("+1 555 000 1111", None),
        ("", None),
        (None, None),
    ],
)
def test_email(one, contact, want):
    assert one(contacts.email_in(F.lit(contact).cast("string"))) == want


@pytest.mark.parametrize(
    "dirty, clean",
    [
        ("a\x00b\nc", "abc"),
        ("  a    b  ", "a b"),
        ("x" * 1200, "x" * 1000),
        (None, ""),
        ("a\x85b\x9f", "ab"),
    ],
)
def test_sanitize(one, dirty, clean):
    assert one(text.sanitize(F.lit(dirty).cast("string"))) == clean


def test_outbox(spark):
    rows = [
        ("M1", "Ann", 20, None, "female", "Rome", "ann@x.org", 0, ["scar", "mole"], ""),
        ("M2", "Bob", 30, 2000, None, "Oslo", "555 555 5555", 170, None, "tall"),
    ]
    df = spark.createDataFrame(
        rows,
        "case_id string, name string, age_at_disappearance int, year_disappeared int, "
        "gender string, location_last_seen string, contact string, height_cm int, "
        "birthmarks array<string>, additional_info string",
    )
    (mail,) = outbox(df, "missing").collect()
    assert mail.recipient == "ann@x.org"
    assert mail.subject == "Hồ Sơ Người Mất Tích Đã Được Tạo - M1"
    assert [f.value for f in mail.fields] == [
        "M1", "Ann", "20 tuổi", "N/A", "FEMALE", "Rome", "ann@x.org", "scar, mole",
    ]
