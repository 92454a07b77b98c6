import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from homeward.llm import common, shards


def dealt(docs, n=5, **options):
    return shards.shuffled(docs, n, out="dealt", **options).select("doc_id", "text", "dealt.*").collect()


def assert_gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_query(run, texts):
    got = run("op8_external_shuffle")
    assert set(got) == set(texts)
    assert_gapless(got.values())
    for i, r in got.items():
        data = texts[i].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert {i: r.slot for i, r in got.items()} == {i: r.slot for i, r in run("op8_external_shuffle").items()}


def hash64(*parts):
    """Spark's xxhash64: the hash of one value is the seed of the next; a null leaves it as it is."""
    seed = 42
    for part in parts:
        if part is not None:
            kind = "q" if part.bit_length() > 31 or isinstance(part, Long) else "i"
            seed = xxhash.xxh64(struct.pack("<" + kind, part), seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


class Long(int):
    """A value of a long column."""


def shard_of(doc_id, n, seed=5):
    bids = [(hash64(seed, None if doc_id is None else Long(doc_id), s), s) for s in range(n)]
    return max(bids)[1]


def test_shards_and_buckets_equal_brute_force(documents, run, texts):
    got = run("op8_external_shuffle")
    for i, r in got.items():
        assert (r.shard, r.grown_shard) == (shard_of(i, 24), shard_of(i, 25))
    # With several buckets a shard: every bucket fills a stretch of slots behind the earlier ones.
    rows, limit = dealt(documents, 3, bucket_bytes=20_000), 20_000
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += len(r.text.encode()) + 8
    by_bucket = defaultdict(list)
    for r in rows:
        assert r.shard == shard_of(r.doc_id, 3)
        many = -(-size[r.shard] // limit)
        by_bucket[r.shard, hash64(6, Long(r.doc_id), Long(zlib.crc32(r.text.encode())), Long(0)) % many].append(r)
    before = defaultdict(int)
    for (shard, _), members in sorted(by_bucket.items()):
        assert sorted(r.slot for r in members) == list(range(before[shard], before[shard] + len(members)))
        before[shard] += len(members)
    largest = max(by_bucket.values(), key=len)
    order = [r.doc_id for r in sorted(largest, key=lambda r: r.slot)]
    seeded = [r.doc_id for r in sorted(largest, key=lambda r: hash64(7, Long(r.doc_id), Long(zlib.crc32(r.text.encode())), Long(0)))]
    assert order != seeded and sorted(order) == sorted(seeded)  # shuffled once more


def test_slots_do_not_depend_on_settings(spark, documents):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for partitions in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append({r.doc_id: (r.shard, r.slot) for r in dealt(documents.repartition(5), bucket_bytes=20_000)})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_copies_are_spread_over_the_buckets(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text").unionByName(
        spark.range(100).selectExpr("id as doc_id", "concat('t', id) as text")
    )
    for most in (common.SHIPPED_KEYS, 0):  # the list of repeated keys is sent, or joined
        monkeypatch.setattr(common, "SHIPPED_KEYS", most)
        monkeypatch.setattr(shards, "SHIPPED_BUCKETS", most)
        placed = shards.shuffled(rows, 3, bucket_bytes=8_000)
        found = placed.select("doc_id", "place.*").collect()
        assert len(found) == 20_100
        assert_gapless(found)
        merged = common.repeats_merged(rows, "n").collect()
        assert Counter(r.n for r in merged) == Counter({1: 100, 20_000: 1})


def test_a_column_with_the_name_of_the_result(edge, tmp_path):
    clashing = edge.withColumnsRenamed({"place": "Place", "node": "copy", "hash": "ROWS"})
    placed = shards.shuffled(clashing, 4)
    assert placed.columns == [*clashing.columns, "_place"]
    assert {(r.Place, r.ROWS) for r in placed.collect()} == {("x", "x")}
    shards.write_shards(placed, str(tmp_path / "out"))
    assert edge.sparkSession.read.parquet(str(tmp_path / "out")).count() == edge.count()


def test_several_buckets_in_a_shard(documents):
    one = dealt(documents, 3)
    many = dealt(documents, 3, bucket_bytes=20_000)
    assert_gapless(many)
    assert {r.doc_id: r.shard for r in one} == {r.doc_id: r.shard for r in many}
    assert [r.doc_id for r in sorted(many, key=lambda r: (r.shard, r.slot))] != sorted(r.doc_id for r in many)


def test_growth_only_fills_the_new_shard(documents):
    small = {r.doc_id: r for r in dealt(documents, 7)}
    large = {r.doc_id: r.shard for r in dealt(documents, 8)}
    assert all(small[i].grown_shard == s for i, s in large.items())
    assert all(s in (small[i].shard, 7) for i, s in large.items())


def test_edge_rows_and_columns(edge, empty, tmp_path):
    placed = shards.shuffled(edge, 4, out="dealt")
    assert placed.columns == [*edge.columns, "dealt"]
    rows = placed.select("doc_id", "dealt.*").collect()
    assert len(rows) == edge.count()
    assert_gapless(rows)
    nulls = {r.shard for r in rows if r.doc_id is None}
    assert len(nulls) == 1
    assert shards.shuffled(empty, 4).count() == 0
    path = str(tmp_path / "shards")
    shards.write_shards(placed, path, "dealt")
    written = edge.sparkSession.read.parquet(path)
    assert written.count() == edge.count()
    assert written.agg(F.countDistinct("shard", "slot")).first()[0] == edge.count()
