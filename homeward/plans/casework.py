"""Person records, forms, files and detections derived from the test tables.

Each derived table is one projection of one whole test table, written in the SQL
both engines share (``LIST(`` stands for the engine's list constructor), so the
Spark side and the checking SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_YEAR = 2024
FOLDED_DIM = 4
VECTOR_DIM = 64
UPLOADED_AT = "2024-06-01T00:00:00"

_MISSING_MARKS = (
    "case vec_id % 8 when 0 then LIST() when 2 then LIST('Scar on left arm ') "
    "when 4 then LIST('scar on left arm', 'mole on cheek') "
    "when 6 then LIST('tattoo on back', 'mole on cheek', 'burn on hand') end"
)
_FOUND_MARKS = (
    "case vec_id % 8 when 1 then LIST() when 3 then LIST('scar on left arm') "
    "when 5 then LIST('mole on cheek', 'scar on left arm') when 7 then LIST('burn on hand') end"
)

# name -> (source table, condition or None, {column: expression})
TABLES: dict[str, tuple[str, str | None, dict[str, str]]] = {
    # The two sides of the embeddings table: every row is on one of them.
    "missing": (
        "embeddings",
        "vec_id % 2 = 0",
        {
            "point_id": "cast(vec_id as string)",
            "embedding": "FOLDED",
            "case_id": "'MISS_' || cast(vec_id as string)",
            "name": "'Person ' || cast(vec_id as string)",
            "age_at_disappearance": "cast((vec_id * 7) % 60 as int)",
            "year_disappeared": "cast(1990 + (vec_id * 3) % 35 as int)",
            "gender": "case when vec_id % 22 = 0 then null when vec_id % 26 = 0 then 'unknown' "
            "when label % 2 = 0 then 'male' else 'female' end",
            "location_last_seen": "case when vec_id % 34 = 0 then null else "
            "'City' || cast(label as string) || ', State' || cast(vec_id % 3 as string) end",
            "contact": "case when vec_id % 10 = 0 then '' else "
            "'family' || cast(vec_id as string) || '@example.com' end",
            "birthmarks": _MISSING_MARKS,
            "image_url": "case when vec_id % 4 = 0 then "
            "'https://images.example.com/' || cast(vec_id as string) end",
            "estimated_current_age": "cast((vec_id * 7) % 60 + "
            f"({AS_OF_YEAR} - (1990 + (vec_id * 3) % 35)) as int)",
        },
    ),
    "found": (
        "embeddings",
        "vec_id % 2 = 1",
        {
            "point_id": "cast(vec_id as string)",
            "embedding": "FOLDED",
            "found_id": "'FOUND_' || cast(vec_id as string)",
            "name": "case when vec_id % 3 = 0 then 'Person ' || cast(vec_id as string) end",
            "current_age_estimate": "cast((vec_id * 5) % 90 as int)",
            "gender": "case when vec_id % 33 = 0 then null "
            "when label % 2 = 0 then 'male' else 'female' end",
            "current_location": "case when vec_id % 35 = 0 then null when vec_id % 5 = 0 then "
            "'CITY' || cast(label as string) || ', State' || cast(vec_id % 3 as string) else "
            "'City' || cast(label as string) || ' State' || cast(vec_id % 3 as string) end",
            "finder_contact": "'finder' || cast(vec_id as string) || '@example.com'",
            "visible_marks": _FOUND_MARKS,
            "image_url": "case when vec_id % 3 = 0 then "
            "'https://images.example.com/' || cast(vec_id as string) end",
        },
    ),
    # Uploads with whole vectors, some of them unusable.
    "missing_uploads": (
        "embeddings",
        None,
        {
            "upload_key": "cast(vec_id as string)",
            "embedding": "case when vec_id % 19 = 0 then null "
            "when vec_id % 23 = 0 then LIST(cast(1 as float)) else embedding end",
            "case_id": "case when vec_id % 29 = 0 then null "
            "else 'MISS_' || cast(vec_id as string) end",
            "name": "case when vec_id % 31 = 0 then null "
            "else 'Person ' || cast(vec_id as string) end",
            "age_at_disappearance": "case when vec_id % 37 = 0 then null "
            "else cast((vec_id * 7) % 60 as int) end",
            "year_disappeared": "cast(1990 + (vec_id * 3) % 35 as int)",
            "gender": "case when vec_id % 41 = 0 then null when label % 2 = 0 then 'MALE' "
            "else 'Female' end",
        },
    ),
    "found_uploads": (
        "embeddings",
        None,
        {
            "upload_key": "cast(vec_id as string)",
            "embedding": "case when vec_id % 17 = 0 then null "
            "when vec_id % 13 = 0 then LIST(cast(1 as float)) else embedding end",
            "found_id": "case when vec_id % 29 = 0 then null "
            "else 'FOUND_' || cast(vec_id as string) end",
            "current_age_estimate": "cast((vec_id * 5) % 90 as int)",
            "gender": "case when label % 2 = 0 then 'MALE' else 'Female' end",
            "finder_contact": "case when vec_id % 11 = 0 then null "
            "else 'finder' || cast(vec_id as string) || '@example.com' end",
        },
    ),
    # Upload forms, valid and invalid.
    "missing_forms": (
        "customer",
        None,
        {
            "point_id": "'m' || cast(c_custkey as string)",
            "case_id": "'MISS_' || cast(c_custkey as string)",
            "name": "case when c_custkey % 41 = 0 then ' X ' when c_custkey % 43 = 0 then null "
            "else c_name end",
            "age_at_disappearance": "cast((c_custkey * 7) % 130 as int)",
            "year_disappeared": "cast(1890 + (c_custkey * 3) % 140 as int)",
            "gender": "case c_mktsegment when 'MACHINERY' then 'male' when 'FURNITURE' then "
            "'Female' when 'BUILDING' then 'other' when 'AUTOMOBILE' then 'unknown' else "
            "case when c_custkey % 5 = 0 then 'n/a' end end",
            "location_last_seen": "case when c_custkey % 37 = 0 then null "
            "when c_custkey % 31 = 0 then ' a ' else 'City' || cast(c_nationkey as string) || "
            "', State' || cast(c_custkey % 3 as string) end",
            "contact": "case when c_custkey % 15 = 5 then 'write to user' || "
            "cast(c_custkey as string) || '@example.com please' when c_custkey % 3 = 0 then "
            "'user' || cast(c_custkey as string) || '@example.com ' when c_custkey % 3 = 1 then "
            "'+1 (555) ' || lpad(cast(c_custkey as string), 7, '0') when c_custkey % 15 = 2 "
            "then '' else 'call me ' || cast(c_custkey as string) end",
            "height_cm": "case when c_custkey % 4 = 0 then null "
            "else cast((c_custkey * 13) % 300 as int) end",
            "birthmarks_text": "case c_custkey % 6 when 1 then 'scar on left arm , mole on cheek' "
            "when 2 then '' when 3 then ' , ' when 4 then 'a,b,c,d,e,f,g,h,i,j,k' "
            "when 5 then 'tattoo on back' end",
            "additional_info": "case when c_custkey % 9 = 0 then repeat(c_name, 60) "
            "when c_custkey % 9 = 1 then '' else 'Last seen by ' || c_name end",
            "estimated_current_age": "cast((c_custkey * 7) % 130 + "
            f"({AS_OF_YEAR} - (1890 + (c_custkey * 3) % 140)) as int)",
            "upload_timestamp": f"'{UPLOADED_AT}'",
            "image_url": "case when c_custkey % 7 = 0 then "
            "'https://images.example.com/' || cast(c_custkey as string) end",
        },
    ),
    "found_forms": (
        "orders",
        None,
        {
            "point_id": "'f' || cast(o_orderkey as string)",
            "found_id": "'FOUND_' || cast(o_orderkey as string)",
            "name": "case when o_orderkey % 5 = 0 then 'Q' when o_orderkey % 3 = 0 then "
            "'Found person ' || cast(o_orderkey as string) end",
            "current_age_estimate": "cast((o_orderkey * 11) % 130 as int)",
            "gender": "case o_orderpriority when '1-URGENT' then 'male' when '2-HIGH' then "
            "'female' when '3-MEDIUM' then 'UNKNOWN' when '4-NOT SPECIFIED' then "
            "'not specified' end",
            "current_location": "case when o_orderkey % 29 = 0 then 'xy' else "
            "'City' || cast(o_custkey % 25 as string) || ' State' || "
            "cast(o_custkey % 3 as string) end",
            "finder_contact": "case when o_orderkey % 3 = 0 then 'finder' || "
            "cast(o_orderkey as string) || '@example.com' when o_orderkey % 3 = 1 then "
            "'555-' || lpad(cast(o_orderkey as string), 7, '0') else 'ask at the desk' end",
            "visible_marks_text": "case o_orderkey % 5 when 0 then 'scar on left arm' "
            "when 1 then 'mole on cheek,,burn on hand' when 2 then "
            "'a,b,c,d,e,f,g,h,i,j,k,l' end",
            "current_condition": "case when o_orderkey % 7 = 0 then null else "
            "repeat(o_orderpriority || ' ', cast(o_orderkey % 60 as int)) end",
            "additional_info": "cast(null as string)",
            "upload_timestamp": f"'{UPLOADED_AT}'",
            "image_url": "cast(null as string)",
        },
    ),
    "metadata_patches": (
        "orders",
        None,
        {
            "point_id": "'m' || cast(o_custkey as string)",
            "seq": "o_orderkey",
            "contact": "case when o_orderkey % 2 = 0 then 'order' || cast(o_orderkey as string) "
            "|| '@example.com' end",
            "height_cm": "case when o_orderkey % 3 = 0 then cast(100 + o_orderkey % 100 as int) "
            "end",
        },
    ),
    "withdrawn": ("events", None, {"point_id": "'m' || cast(user_id as string)"}),
    "saved_searches": (
        "part",
        None,
        {
            "search_id": "p_partkey",
            "max_results": "case when p_partkey % 10 = 9 then null "
            "else cast(p_size * 3 - 5 as int) end",
            "threshold": "case when p_partkey % 10 = 8 then null "
            "else (p_retailprice - 890) / 100 end",
            "gender": "case p_type when 'MEDIUM' then 'male' when 'LARGE' then 'female' "
            "when 'PROMO' then 'Male' when 'SMALL' then 'unknown' end",
            "age_range": "case p_partkey % 5 when 0 then LIST(20, 40) when 1 then LIST(50, 30) "
            "when 2 then LIST(10) when 3 then LIST(cast(p_partkey % 60 as int), "
            "cast(p_partkey % 200 as int)) end",
        },
    ),
    # Vision side tables.
    "detections": (
        "lineitem",
        None,
        {
            "image_id": "cast(l_orderkey as string)",
            "face_id": "cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || "
            "cast(l_linenumber as string)",
            "x": "cast(l_partkey as int)",
            "y": "cast(l_suppkey as int)",
            "w": "cast(floor(l_quantity) as int)",
            "h": "cast(l_linenumber * 20 as int)",
            "confidence": "l_discount * 10",
        },
    ),
    "face_metrics": (
        "lineitem",
        None,
        {
            "image_id": "cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || "
            "cast(l_suppkey as string) || '-' || cast(l_linenumber as string)",
            "sharpness": "l_extendedprice / 100",
            "brightness": "l_quantity * 5",
            "contrast": "l_tax * 1000",
            "width": "cast(floor(l_quantity * 4) as int)",
            "height": "cast(floor(l_extendedprice / 500) as int)",
            "channels": "case when l_returnflag = 'R' then 1 else 3 end",
        },
    ),
    "face_thumbs": (
        "embeddings",
        None,
        {"image_id": "cast(vec_id as string)", "embedding": "embedding"},
    ),
    "document_prints": (
        "documents",
        None,
        {"image_id": "cast(doc_id as string)", "digits": "md5(text) || md5(lower(text))"},
    ),
    "uploads": (
        "documents",
        None,
        {
            "filename": "'Scan' || cast(doc_id as string) || case doc_id % 6 when 0 then '.JPG' "
            "when 1 then '.png' when 2 then '.txt' when 3 then '.jpeg' when 4 then '' "
            "else '.webp' end",
            # The whole text, behind the signature of an image format or alone.
            "content": "case when doc_id % 7 = 0 then null else BYTES(case doc_id % 4 "
            "when 0 then 'GIF89a' when 1 then 'RIFF1234WEBP' else '' end || text) end",
            "length": "n_chars * 40",
        },
    ),
    # Age-labelled files; person 001 owns a third of them.
    "age_files": (
        "customer",
        None,
        {
            "path": "'/faces/' || case when c_custkey % 17 = 0 then 'IMG_' || "
            "cast(c_custkey as string) else case when c_custkey % 3 = 0 then '001' else "
            "lpad(cast((c_custkey * 7) % 1000 as string), 3, '0') end || "
            "case when c_custkey % 2 = 0 then 'A' else 'B' end || "
            "lpad(cast((c_custkey * 11 + c_nationkey) % 70 as string), 2, '0') || "
            "case when c_custkey % 23 = 0 then 'a' else '' end end || "
            "case when c_custkey % 5 = 0 then '.jpg' else '.JPG' end"
        },
    ),
    "vector_pairs": (
        "lineitem",
        None,
        {
            "pair_id": "cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || "
            "cast(l_suppkey as string) || '-' || cast(l_linenumber as string)",
            "img1": "cast(l_partkey as string)",
            "img2": "cast(l_suppkey as string)",
        },
    ),
    "vectors": (
        "embeddings",
        None,
        {"image_id": "cast(vec_id as string)", "embedding": "embedding"},
    ),
    "arrivals_log": (
        "events",
        None,
        {"event_id": "event_id", "ts": "ts", "event_type": "event_type"},
    ),
}
def folded_vector() -> F.Column:
    """The whole 64-d vector added up in four runs of sixteen.

    Random unit vectors of 64 dimensions are almost orthogonal; folded to four dimensions their
    cosines spread over the whole range, so that every matching rule has work to do.
    """
    run = VECTOR_DIM // FOLDED_DIM

    def total(i):
        part = F.slice("embedding", i * run + 1, run).cast("array<double>")
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), F.lit(FOLDED_DIM - 1)), total)


_FOLDED_SQL = (
    f"list_transform(range({FOLDED_DIM}), lambda i: list_sum(cast(embedding"
    f"[i * {VECTOR_DIM // FOLDED_DIM} + 1 : (i + 1) * {VECTOR_DIM // FOLDED_DIM}] as double[])))"
)


def derive(rows: DataFrame, name: str) -> DataFrame:
    """Apply the projection of a derived table to rows of its source table."""
    _, condition, columns = TABLES[name]
    if condition:
        rows = rows.filter(condition)
    return rows.select(*[
        (folded_vector() if text == "FOLDED" else F.expr(_spark(text))).alias(column)
        for column, text in columns.items()
    ])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(spark.read.parquet(f"{sf_dir}/{TABLES[name][0]}.parquet"), name)


def _spark(text: str) -> str:
    return text.replace("LIST(", "array(").replace("BYTES(", "binary(")


def cte(*names: str) -> str:
    """``WITH`` clause that defines the named derived tables for the checking SQL."""
    parts = []
    for name in names:
        source, condition, columns = TABLES[name]
        select = ", ".join(f"{_duck(text)} as {column}" for column, text in columns.items())
        where = f" where {condition}" if condition else ""
        parts.append(f"{name} as (select {select} from {source}{where})")
    return "with " + ",\n".join(parts)


def _duck(text: str) -> str:
    if text == "FOLDED":
        return _FOLDED_SQL
    return text.replace("LIST(", "list_value(").replace("BYTES(", "encode(")
