import pytest

from homeward.operators import agepairs as A
from homeward.sources.files import list_images, read_pairs, write_pairs

NAMES = ["001A02.JPG", "001A22.JPG", "001A22a.JPG", "001B14.jpg", "002A05.JPG", "002A40.JPG",
         "003A10.JPG", "IMG_1.JPG", "01A02.JPG", "001C05.JPG"]


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(f"/d/{n}",) for n in NAMES], "path string")


def test_parse(files):
    rows = {r.original_name: (r.person_id, r.version, r.age) for r in A.parse_files(files).collect()}
    assert len(rows) == 7
    assert rows["001A22a.JPG"] == ("001", "A", 22) and rows["001B14.jpg"] == ("001", "B", 14)


def test_one_image_per_age(files):
    kept = {(r.person_id, r.age): (r.n_files, r.path) for r in A.by_person(files).collect()}
    assert kept["001", 22] == (2, "/d/001A22a.JPG") and len(kept) == 6
    targets = {r.target for r in A.manifest(files).collect()}
    assert "person_001/age_02.jpg" in targets


def test_every_file_has_a_position(files):
    rows = A.files_by_person(files).collect()
    assert len(rows) == A.parse_files(files).count()
    for person in {r.person_id for r in rows}:
        own = sorted((r for r in rows if r.person_id == person), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        assert [r.age for r in own] == sorted(r.age for r in own)


def test_statistics(files):
    stats = {r.person_id: (r.n_images, r.ages, r.age_span) for r in A.person_stats(files).collect()}
    assert stats["001"] == (3, [2, 14, 22], 20)
    total = A.overall_stats(files).first()
    assert (total.persons, total.images, total.min_span, total.max_span) == (3, 6, 0, 35)
    assert [r.person_id for r in A.sample_persons(files, 2).collect()] == ["001", "002"]


@pytest.mark.parametrize("gap, n", [(0, 4), (8, 4), (10, 3), (13, 2), (20, 2), (36, 0)])
def test_same_pairs(files, gap, n):
    pairs = A.same_pairs(files, gap).collect()
    assert len(pairs) == n
    assert all(p.age_gap >= gap and p.img1 < p.img2 and p.label == 1 for p in pairs)


def test_different_pairs(files):
    pairs = A.different_pairs(files, 10).collect()
    assert len(pairs) == A.same_pairs(files, 10).count()
    assert all(p.img1[:10] != p.img2[:10] and (p.label, p.age_gap) == (0, 0) for p in pairs)
    assert pairs == A.different_pairs(files.repartition(3), 10).collect() or sorted(pairs) == sorted(
        A.different_pairs(files.repartition(3), 10).collect()
    )
    assert pairs != A.different_pairs(files, 10, seed=7).collect()


def test_one_person_has_no_different_pairs(spark):
    files = spark.createDataFrame([("001A02.JPG",), ("001A30.JPG",)], "path string")
    assert A.different_pairs(files).count() == 0 and A.same_pairs(files).count() == 1


def test_pair_file(spark, files, tmp_path):
    pairs = A.all_pairs(files)
    write_pairs(A.shuffled(pairs), str(tmp_path / "pairs"))
    header = {p.read_text().splitlines()[0] for p in (tmp_path / "pairs").glob("*.csv")}
    assert header == {"img1,img2,label,age_gap"}
    back = read_pairs(spark, str(tmp_path / "pairs"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pairs.collect()))
    assert {r.label: r.pairs for r in A.pair_counts(back).collect()} == {0: 3, 1: 3}


def test_listing(spark, tmp_path):
    for name in ("001A02.JPG", "002B03.jpg", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    listed = list_images(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in listed.collect()} == {"001A02.JPG", "002B03.jpg"}
