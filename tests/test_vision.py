import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from homeward.functions import vectors
from homeward.operators import imageaudit, vision
from homeward.operators.embedding import embed
from homeward.sources.files import read_images, read_uploads


def test_vectors(one):
    a = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(vectors.normalize(a)) == [0.6, 0.8] and one(vectors.normalize(zero)) == [0.0, 0.0]
    assert one(vectors.cosine(a, a)) == pytest.approx(1.0) and one(vectors.cosine(a, zero)) == 0.0
    assert one(vectors.euclidean(a, zero)) == 5.0
    assert one(vectors.to_similarity(vectors.to_distance(F.lit(0.25)))) == 0.25


def test_detections_and_best_face(spark):
    rows = [("i", "a", 1, 2, 10, 10, 0.9), ("i", "b", 0, 0, 50, 50, 0.8), ("i", "c", 0, 0, 9, 9, 0.6)]
    faces = spark.createDataFrame(
        rows, "image_id string, face_id string, x int, y int, w int, h int, confidence double"
    )
    found = vision.detections(faces)
    assert {r.face_id: (r.bbox, r.area) for r in found.collect()} == {
        "a": ([1, 2, 11, 12], 100), "b": ([0, 0, 50, 50], 2500),
    }
    assert vision.best_face(found).first().face_id == "a"
    assert vision.best_face(found, by="area").first().face_id == "b"
    assert vision.detections(faces, 0.9).count() == 1


def test_quality_gate(spark):
    rows = [(100.0, 40.0, 30.0, True), (99.9, 40.0, 30.0, False), (100.0, 220.0, 30.0, True),
            (100.0, 220.1, 30.0, False), (100.0, 40.0, 29.0, False)]
    df = spark.createDataFrame(rows, "sharpness double, brightness double, contrast double, want boolean")
    assert all(r.is_good_quality == r.want for r in vision.quality_gate(df).collect())


def test_average_hash(one):
    def gray(values):
        return F.array(*[F.lit(int(v)) for v in values])

    assert one(vision.average_hash(gray([7] * 64))) == "0"
    assert one(vision.average_hash(gray([0] * 60 + [9] * 4))) == "f"
    assert one(vision.average_hash(gray([9] + [0] * 63))) == "8000000000000000"


def test_duplicates(spark):
    rows = [(str(i), "hot" if i % 3 == 0 else f"h{i // 4}") for i in range(3000)]
    images = spark.createDataFrame(rows, "image_id string, hash string")
    groups = {r.hash: r.n_copies for r in vision.duplicate_groups(images).collect()}
    assert groups["hot"] == 1000
    members = vision.duplicate_members(images, hot_rows=50).collect()
    assert len(members) == sum(groups.values())
    assert len({r.image_id for r in members}) == len(members)


def test_verify_pairs_with_a_hot_image(spark):
    rng = np.random.default_rng(3)
    data = {str(i): rng.normal(size=5).astype(np.float32) for i in range(40)}
    whole = spark.createDataFrame(
        [(k, v.tolist()) for k, v in data.items()], "image_id string, embedding array<float>"
    )
    rows = [(str(i), "0" if i % 2 else str(i % 40), str(i % 41)) for i in range(4000)]
    pairs = spark.createDataFrame(rows, "pair_id string, img1 string, img2 string")
    got = vision.verify_pairs(pairs, whole, "pair_id", hot_rows=100).collect()
    assert len(got) == len(rows)
    assert all((r.status == "compared") == (r.img2 in data) for r in got)
    assert {(r.status, r.is_match) for r in got if r.img2 not in data} == {("no vector for img2", None)}
    for r in [r for r in got if r.status == "compared"][:200]:
        a, b = data[r.img1].astype(float), data[r.img2].astype(float)
        cosine = a @ b / ((np.linalg.norm(a) + 1e-8) * (np.linalg.norm(b) + 1e-8))
        assert r.cosine_similarity == pytest.approx(cosine) and r.is_match == (cosine >= 0.6)
        assert r.euclidean_distance == pytest.approx(np.linalg.norm(a - b))


def test_vectors_of_other_length_or_none(spark):
    whole = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.0, 2.0]), ("d", []), ("e", None),
         ("f", [0.0, 0.0, 3.0])],
        "image_id string, embedding array<float>",
    )
    listed = [("a", "b"), ("a", "c"), ("a", "d"), ("x", "a"), ("e", "y"), ("b", "f"), (None, "a")]
    pairs = spark.createDataFrame(
        [(str(n), *p) for n, p in enumerate(listed)], "pair_id string, img1 string, img2 string"
    )
    got = {r.pair_id: r for r in vision.verify_pairs(pairs, whole, "pair_id").collect()}
    assert [got[str(n)].status for n in range(7)] == [
        "vectors differ in length", "compared", "no vector for img2", "no vector for img1",
        "no vectors", "compared", "no vector for img1",
    ]
    assert got["1"].cosine_similarity == pytest.approx(0) and not got["5"].is_match
    assert got["0"].cosine_similarity is None and got["0"].is_match is None


def stored_vectors(spark, rows):
    return spark.createDataFrame(rows, "image_id string, embedding array<float>")


def test_pairs_move_once_to_their_vectors(spark):
    whole = stored_vectors(spark, [(str(i), [float(i), 1.0]) for i in range(20)])
    rows = [(str(i), str(i % 30), str(i % 7)) for i in range(2000)]
    pairs = spark.createDataFrame(rows, "pair_id string, img1 string, img2 string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        verified = vision.verify_pairs(pairs, whole, "pair_id")
        plan = verified._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan
        assert verified.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_listed_pairs_of_hot_absent_and_repeated_images(spark):
    """One pair very often, images that are not named, and an image with two vectors."""
    stored = [(str(i), [float(i), 1.0]) for i in range(12)] + [("3", [9.0, 9.0]), (None, [5.0, 5.0])]
    whole = stored_vectors(spark, stored)
    listed = [("1", "2")] * 3000 + [(None, "3")] * 3000 + [("3", "3"), (None, None), ("x", "4")]
    listed += [(str(i % 13), str(i % 11)) for i in range(500)]
    rows = [(str(n), *p, n) for n, p in enumerate(listed)]
    pairs = spark.createDataFrame(rows, "pair_id string, img1 string, img2 string, n int")
    of = {}
    for image, vector in stored:
        of.setdefault(image, []).append(vector)
    of[None] = []
    want = sorted(
        (pair, str(left), str(right))
        for pair, img1, img2, _ in rows
        for left in of.get(img1) or [None]
        for right in of.get(img2) or [None]
    )
    both = vision.with_vectors(pairs, whole, "pair_id", part_pairs=100)
    got = both.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.pair_id, str(r.left), str(r.right)) for r in got) == want
    assert all(r.n == int(r.pair_id) for r in got)
    tasks = {}
    for r in got:
        tasks.setdefault(r.task, set()).add(r.pair_id)
    assert max(map(len, tasks.values())) < 400


def test_few_pairs_of_many_vectors(spark):
    whole = stored_vectors(spark, [(str(i), [float(i), 1.0]) for i in range(2000)])
    pairs = spark.createDataFrame(
        [(str(i), str(i), str(i + 1995)) for i in range(10)],
        "pair_id string, img1 string, img2 string",
    )
    got = vision.with_vectors(pairs, whole, "pair_id").collect()
    assert len(got) == 10
    assert all(r.left == [float(r.img1), 1.0] for r in got)
    assert sum(r.status == vision.COMPARED for r in got) == 5
    none = vision.with_vectors(pairs.limit(0), whole, "pair_id")
    assert none.count() == 0


def bitmap(pixels: np.ndarray) -> bytes:
    """24-bit BMP of a (height, width, 3) BGR array."""
    height, width, _ = pixels.shape
    pad = (-width * 3) % 4
    body = b"".join(row.tobytes() + b"\0" * pad for row in pixels[::-1])
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0)
    return head + info + body


def test_image_audit(spark, tmp_path):
    rng = np.random.default_rng(5)
    noisy = rng.integers(0, 256, (60, 55, 3), dtype=np.uint8)
    flat = np.full((50, 50, 3), 100, np.uint8)
    for name, pixels in (("noisy", noisy), ("flat", flat), ("copy", noisy)):
        (tmp_path / f"{name}.bmp").write_bytes(bitmap(pixels))
    (tmp_path / "broken.bmp").write_bytes(b"BMnot an image")
    audit = imageaudit.image_audit(read_images(spark, str(tmp_path)))
    audit = audit.withColumn("hash", vision.average_hash(F.col("thumbnail")))
    rows = {r.origin.rsplit("/", 1)[1].split(".")[0]: r for r in audit.collect()}
    broken = rows.pop("broken")
    assert broken.error == imageaudit.UNREADABLE and broken.brightness is None
    assert set(rows) == {"noisy", "flat", "copy"} and all(r.error is None for r in rows.values())
    assert (rows["noisy"].width, rows["noisy"].height, rows["noisy"].channels) == (55, 60, 3)
    assert rows["noisy"].size_bytes == 55 * 60 * 3
    gray = np.rint(noisy @ np.array([0.114, 0.587, 0.299]))
    assert rows["noisy"].brightness == pytest.approx(gray.mean(), abs=0.2)
    assert rows["noisy"].contrast == pytest.approx(gray.std(), abs=0.2)
    assert not rows["noisy"].is_blurry and rows["flat"].is_blurry
    assert (rows["flat"].brightness, rows["flat"].contrast, rows["flat"].hash) == (100.0, 0.0, "0")
    assert rows["noisy"].hash == rows["copy"].hash
    sizes = audit.select(F.col("origin"), "width", "height", "channels")
    assert vision.image_valid(sizes).filter("is_valid").count() == 3
    assert read_uploads(spark, str(tmp_path)).count() == 4


def test_thumbnail_of_an_8x8_image_is_the_image():
    gray = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert (imageaudit.thumbnail(gray) == gray).all()


def test_embedding_hook(spark):
    def make_model():
        return lambda batch: batch[:, ::-1] * 3.0

    rows = [(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [6.0, 8.0])]
    df = spark.createDataFrame(rows, "id int, t array<float>")
    got = {r.id: r for r in embed(df, "t", [2], make_model, batch_size=2).collect()}
    assert {i: r.embedding_status for i, r in got.items()} == {
        1: "embedded", 2: "unreadable", 3: "unreadable", 4: "zero vector", 5: "unreadable", 6: "embedded",
    }
    assert got[1].embedding == got[6].embedding == pytest.approx([0.8, 0.6])
    assert all(r.embedding is None for r in got.values() if r.embedding_status != "embedded")
    assert got[3].t == [1.0]
    with pytest.raises(ValueError):
        embed(df, "t", [2], make_model, output="T")


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_near_hashes_equal_brute_force(spark, radius):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    rows = [("no", None)]
    for i in range(300):
        bits = int(centres[i % 12])
        for at in rng.integers(0, 64, rng.integers(0, 6)):
            bits ^= 1 << int(at)
        # A third of all rows share the lowest twenty bits.
        rows.append((f"i{i:03d}", f"{bits >> 20 << 20 if i % 3 == 0 else bits:x}"))
    images = spark.createDataFrame(rows, "image_id string, hash string")
    for block in (vision.BAND_BLOCK, 5):
        got = {r.image_id: r for r in vision.near_duplicates(images, radius, block, hot_rows=5).collect()}
        assert len(got) == len(rows)
        for i, h in rows:
            near = [j for j, g in rows if j != i and h and g and bin(int(h, 16) ^ int(g, 16)).count("1") <= radius]
            assert (got[i].n_near, got[i].first_near) == (len(near), min([*near, i]))


def test_blocks_cut_a_hot_band(spark):
    rows = [(str(i), f"{i << 32:x}") for i in range(400)]  # the lower bands are the same for all
    images = spark.createDataFrame(rows, "image_id string, hash string")
    got = {r.image_id: r.n_near for r in vision.near_duplicates(images, 2, block=16).collect()}
    assert got == {i: sum(0 < bin(int(h, 16) ^ int(g, 16)).count("1") <= 2 for _, g in rows) for i, h in rows}
