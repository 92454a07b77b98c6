import pytest

from homeward.operators import records, search
from homeward.plans import casework as cw
from homeward.sources import layout


@pytest.fixture(scope="module")
def forms(spark, sf_dir):
    return cw.table(spark, sf_dir, "missing_forms")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_patches_and_deletions_leave_a_bucketed_table_where_it_is(spark, sf_dir, forms, tmp_path):
    root = str(tmp_path / "db")
    layout.write_bucketed(forms, root, "missing", buckets=8)
    table = layout.open_bucketed(spark, root, "missing")
    patches, gone = (cw.table(spark, sf_dir, n) for n in ("metadata_patches", "withdrawn"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for changed, want in (
            (records.update_metadata(table, patches), records.update_metadata(forms, patches)),
            (records.delete_points(table, gone), records.delete_points(forms, gone)),
            (records.get_points(table, gone), records.get_points(forms, gone)),
        ):
            assert rows(changed, "point_id", "contact") == rows(want, "point_id", "contact")
            plan = changed._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            scan = next(i for i, line in enumerate(lines) if "homeward_" in line and "FileScan" in line)
            join = max(i for i, line in enumerate(lines[:scan]) if "Join" in line)
            assert not any("Exchange" in line for line in lines[join:scan]), plan
        # The result is written in buckets again without an exchange of its own.
        layout.rewrite_bucketed(records.delete_points(table, gone), str(tmp_path / "next"), "missing", 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    left = layout.open_bucketed(spark, str(tmp_path / "next"), "missing")
    assert rows(left, "point_id") == rows(records.delete_points(forms, gone), "point_id")


def test_another_session_learns_of_the_buckets(spark, forms, tmp_path):
    root = str(tmp_path / "db")
    layout.write_bucketed(forms, root, "missing", buckets=3)
    spark.sql(f"drop table {layout._name(layout._path(root, 'missing', 'buckets'))}")
    table = layout.open_bucketed(spark, root, "missing")
    assert rows(table, "point_id") == rows(forms, "point_id")
    counted = table.groupBy("point_id").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.count() == forms.count()


def test_lookups_and_pages_read_few_files_of_a_hundred(spark, forms, tmp_path):
    root, n = str(tmp_path / "db"), forms.count()
    layout.write_zoned(forms, root, "missing", rows_per_file=max(1, n // 100))
    files = layout.zones(spark, root, "missing").count()
    assert files >= 90
    every = sorted(r.point_id for r in forms.select("point_id").collect())
    ids = [every[3], every[n // 2], "gone"]
    found = layout.points_zoned(spark, root, "missing", ids)
    assert rows(found, "point_id") == [(i,) for i in sorted(ids[:2])]
    assert len(found.inputFiles()) <= 3
    for offset in (None, every[0], every[n // 3], every[-1], "zzz", every[5] + "x"):
        page = layout.page_zoned(spark, root, "missing", 7, offset)
        want = search.list_page(forms, 7, offset)
        assert rows(page, "point_id", "next_offset") == rows(want, "point_id", "next_offset")
        assert len(page.inputFiles()) <= 10


def test_searches_skip_files_by_gender_and_age(spark, sf_dir, tmp_path):
    forms = cw.table(spark, sf_dir, "found_forms")
    root, by = str(tmp_path / "db"), ("gender", "current_age_estimate")
    layout.write_zoned(forms, root, "found", by, rows_per_file=max(1, forms.count() // 60))
    files = layout.zones(spark, root, "found", by).count()
    for filters in (
        {"gender": "female", "age_range": [20, 30]}, {"gender": ["male", "nobody"]}, {"gender": "nobody"},
        {"age_range": (50, 51)}, {"gender": None}, {}, {"found_id": "FOUND_1"},
    ):
        found = layout.search_zoned(spark, root, "found", filters, by)
        assert rows(found, "point_id") == rows(search.filter_records(forms, "found", filters), "point_id")
        if filters.get("age_range") == [20, 30]:
            assert 0 < len(found.inputFiles()) <= files // 4
    with pytest.raises(ValueError):
        layout.search_zoned(spark, root, "found", {"gender": {"a": 1}}, by)


def test_small_files_have_small_filters_and_few_tasks(spark, tmp_path):
    """Also where one id fills several files."""
    rows = [(f"m{i:05}", f"MISS_{i}", i % 90) for i in range(3000)] + [("m01000", "MISS_1000", 7)] * 250
    table = spark.createDataFrame(rows, "point_id string, case_id string, age_at_disappearance int")
    root = str(tmp_path / "db")
    layout.write_zoned(table, root, "missing", rows_per_file=50)
    sizes = [f.stat().st_size for f in (tmp_path / "db").rglob("rows/*.parquet")]
    assert len(sizes) >= 65 and max(sizes) < 50_000
    tasks = {f.name.split("-")[1] for f in (tmp_path / "db").rglob("rows/*.parquet")}
    assert len(tasks) <= spark.sparkContext.defaultParallelism
    found = layout.points_zoned(spark, root, "missing", ["m00007", "m01000", "none"])
    assert rows_of_page(found) == ["m00007"] + ["m01000"] * 251
    for offset in (None, "m00990", "m01000", "m01001", "m02999"):
        page = layout.page_zoned(spark, root, "missing", 270, offset)
        assert rows_of_page(page) == rows_of_page(search.list_page(table, 270, offset))
        assert len(page.inputFiles()) <= 20


def rows_of_page(df):
    return sorted(r.point_id for r in df.select("point_id").collect())
