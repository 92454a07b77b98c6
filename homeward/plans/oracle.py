"""Checking SQL for the registered queries, to be run by DuckDB on the same tables."""

from __future__ import annotations

from homeward.functions.contacts import EMAIL, EMAIL_INSIDE, PHONE
from homeward.operators.agepairs import SEED
from homeward.operators.notifications import LABELS, SUBJECTS
from homeward.plans import match_sql as M
from homeward.plans.casework import (
    AS_OF_YEAR,
    FOLDED_DIM,
    TABLES,
    UPLOADED_AT,
    VECTOR_DIM,
    cte,
)

_BY_SIDE = {
    "missing": ("case_id", "contact"),
    "found": ("found_id", "finder_contact"),
}


def _candidates(columns: str) -> str:
    return f"{M.scored('missing')} select qid as query_id, cid as candidate_id, {columns} from judged"


def _match_bilateral() -> str:
    parts = []
    for side in ("missing", "found"):
        parts.append(f"select * exclude (ages) from (select *, 0 as ages from ({_common(side)}))")
    return " union all ".join(parts)


def _common(side: str) -> str:
    other = "found" if side == "missing" else "missing"
    return (
        f"{M.ranked(side)},{M.confidence('final')} "
        f"select '{other}' as search_type, {M.MATCH_COLUMNS} from confident"
    )


def _arrivals() -> str:
    """Valid forms of both sides are stored, vectors as floats; the found ones are matched."""
    given = cte("missing", "found")
    text = _common("found")
    assert given in text
    raw = given.replace("missing as (", "raw_missing as (").replace("found as (", "raw_found as (")
    stored = ", ".join(
        f"{side} as (select * replace ({_uuid(side, 'point_id')} as point_id, "
        f"embedding::float[]::double[] as embedding) from raw_{side} "
        f"where ({_upload_errors(side)}) is null)"
        for side in ("missing", "found")
    )
    return text.replace(given, f"{raw}, {stored}")


def _lookup(side: str) -> str:
    """Every id asked for, with what was found."""
    key = _BY_SIDE[side][0]
    return f"""{cte("missing", "found")}, m as ({M.match(side, limit=1)}),
asked as (select {key} as business_id from {side} union select {key} || '_gone' from {side}),
known as (select {key}, min(point_id) as point_id, arg_min(image_url, point_id) as image_url
  from {side} group by {key})
select business_id, case when k.point_id is null then 'unknown id' when m.query_id is null
    then 'no match' else 'matched' end as status,
  (select r.image_url from {side} r where r.point_id = k.point_id) as own_image_url, m.*
from asked left join known k on business_id = k.{key} left join m on m.query_id = k.point_id"""


def _other_weights() -> str:
    text = M.match("missing")
    changes = {
        "g_m * 0.3::double + a_c * 0.3::double + m_s * 0.25::double + l_p * 0.15::double":
        "g_m * 0.4::double + a_c * 0.2::double + m_s * 0.1::double + l_p * 0.3::double",
        "0.7::double * face + 0.3::double * meta": "0.6::double * face + 0.4::double * meta",
    }
    for old, new in changes.items():
        assert old in text
        text = text.replace(old, new)
    return text


def _grid() -> str:
    """Histograms of three weightings, each of a search of its own."""
    weights = {
        "g_m * 0.3::double + a_c * 0.3::double + m_s * 0.25::double + l_p * 0.15::double":
        "g_m * 0.4::double + a_c * 0.2::double + m_s * 0.1::double + l_p * 0.3::double",
        "0.7::double * face + 0.3::double * meta": "0.6::double * face + 0.4::double * meta",
    }
    strict = {
        "face >= 0.80 or comb >= 0.55 or (face >= 0.50 and meta >= 0.60)":
        "face >= 0.9 or comb >= 0.7 or (face >= 0.50 and meta >= 0.8)",
    }
    parts = []
    for name, changes in (("plain", {}), ("other", weights), ("strict", strict)):
        text = f"{M.ranked('missing')},{M.confidence('final')}"
        for old, new in changes.items():
            assert old in text
            text = text.replace(old, new)
        parts.append(
            f"select * from ({text} select '{name}' as configuration, 'found' as search_type, "
            "level as confidence_level, count(*) as matches, round(avg(conf), 6) as avg_confidence, "
            "round(avg(face), 6) as avg_face_similarity from confident group by level)"
        )
    return " union all ".join(parts)


def _reset() -> str:
    counts = [
        f"select 'stored' as moment, '{side}' as side, count(distinct upload_key) as records "
        f"from {side}_uploads where ({_intake_error(side)}) is null "
        f"union all select 'reset', '{side}', 0"
        for side in ("missing", "found")
    ]
    return f"{cte('missing_uploads', 'found_uploads')} " + " union all ".join(counts)


_COLOUR = (
    "list_transform(range(64), lambda j: (1868 * p[((3 * j) % 64) + 1] + "
    "9617 * p[((3 * j + 1) % 64) + 1] + 4899 * p[((3 * j + 2) % 64) + 1] + 8192) >> 14)"
)


def _prefiltered() -> str:
    """The match with the derived gender and age filters applied before the top k."""
    wanted = (
        "q.gender in ('unknown', 'other', '') or q.gender is null or c.gender = q.gender"
    )
    estimate = f"(q.age_at_disappearance + ({AS_OF_YEAR} - q.year_disappeared))"
    ages = f"c.current_age_estimate between greatest(0, {estimate} - 5) and {estimate} + 5"
    plain = "from missing q, found c)"
    filtered = f"from missing q, found c where ({wanted}) and {ages})"
    text = M.match("missing")
    assert plain in text
    return text.replace(plain, filtered)


def _knn() -> str:
    return f"""{cte("missing", "found", "vectors")},
m as (select point_id, v.embedding::double[] as e from missing join vectors v on image_id = point_id),
f as (select point_id, v.embedding::double[] as e from found join vectors v on image_id = point_id),
pairs as (
  select m.point_id as query_id, f.point_id as candidate_id,
    round(list_cosine_similarity(m.e, f.e), 9) as s from m, f)
select query_id, candidate_id, round(s, 6) as face_similarity from pairs where s >= 0.1
qualify row_number() over (partition by query_id order by s desc, candidate_id) <= 10"""


def _uuid(side: str, key: str) -> str:
    digest = f"md5('{side}|' || {key} || '|{UPLOADED_AT}')"
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in parts)


def _intake_error(side: str, dim: int = VECTOR_DIM) -> str:
    required = {
        "missing": ["case_id", "name", "age_at_disappearance", "year_disappeared", "gender"],
        "found": ["found_id", "current_age_estimate", "gender", "finder_contact"],
    }[side]
    cases = " ".join(
        f"when {c} is null then 'Missing required metadata field: {c}'" for c in required
    )
    return (
        "case when embedding is null or len(embedding) = 0 then "
        "'Embedding cannot be None or empty' "
        f"when len(embedding) <> {dim} then 'Embedding must be {dim}-dimensional, "
        f"got ' || len(embedding) {cases} end"
    )


def _ingest(side: str) -> str:
    fields = {
        "missing": "case_id, name, age_at_disappearance, year_disappeared, lower(gender) as gender, "
        f"age_at_disappearance + ({AS_OF_YEAR} - year_disappeared) as estimated_current_age",
        "found": "found_id, current_age_estimate, lower(gender) as gender, finder_contact",
    }[side]
    return f"""{cte(f"{side}_uploads")}
select {fields}, '{side}' as collection_type, '{UPLOADED_AT}' as upload_timestamp,
  {_uuid(side, 'upload_key')} as point_id, cast(len(embedding) as int) as vector_size
from {side}_uploads where ({_intake_error(side)}) is null"""


def _ingest_rejects() -> str:
    parts = [
        f"select '{side}' as side, {_BY_SIDE[side][0]} as business_id, "
        f"{_intake_error(side)} as error from {side}_uploads where ({_intake_error(side)}) is not null"
        for side in ("missing", "found")
    ]
    return f"{cte('missing_uploads', 'found_uploads')} " + " union all ".join(parts)


def _list(text: str) -> str:
    """Form field to list, NULL when nothing is left."""
    items = (
        f"list_filter(list_transform(string_split({text}, ','), lambda p: trim(p)), "
        "lambda p: p <> '')"
    )
    return f"case when len({items}) > 0 then {items} end"


_GENDER_ERROR = "Gender must be one of: male, female, other, unknown"


def _field(name: str, *rules: tuple[str, str]) -> str:
    cases = " ".join(f"when {broken} then '{message}'" for broken, message in rules)
    return f"case when {name} is null then 'Missing required field: {name}' {cases} end"


def _bad_contact(name: str) -> str:
    return (
        f"not (regexp_matches(trim({name}), '{EMAIL}') or regexp_matches(trim({name}), '{PHONE}'))"
    )


def _form_rules(side: str) -> list[tuple[str, str]]:
    """(column, error or NULL) of the form rules in order."""
    genders = "('male', 'female', 'other', 'unknown')"
    gender = ("gender", _field("gender", (f"lower(gender) not in {genders}", _GENDER_ERROR)))

    def field(name: str, broken: str, message: str) -> tuple[str, str]:
        return name, _field(name, (broken, message))

    if side == "missing":
        return [
            field("name", "length(trim(name)) < 2", "Name must be at least 2 characters"),
            field(
                "age_at_disappearance",
                "age_at_disappearance not between 0 and 120",
                "Age at disappearance must be between 0 and 120",
            ),
            field(
                "year_disappeared",
                f"year_disappeared not between 1900 and {AS_OF_YEAR}",
                f"Year disappeared must be between 1900 and {AS_OF_YEAR}",
            ),
            gender,
            field(
                "location_last_seen",
                "length(trim(location_last_seen)) < 3",
                "Location must be at least 3 characters",
            ),
            field(
                "contact",
                _bad_contact("contact"),
                "Contact must be a valid email or phone number",
            ),
            (
                "height_cm",
                "case when height_cm not between 50 and 250 "
                "then 'Height must be between 50 and 250 cm' end",
            ),
            (
                "birthmarks",
                "case when len(birthmarks) > 10 then 'Maximum 10 birthmarks allowed' end",
            ),
        ]
    return [
        field(
            "current_age_estimate",
            "current_age_estimate not between 0 and 120",
            "Current age estimate must be between 0 and 120",
        ),
        gender,
        field(
            "current_location",
            "length(trim(current_location)) < 3",
            "Current location must be at least 3 characters",
        ),
        field(
            "finder_contact",
            _bad_contact("finder_contact"),
            "Finder contact must be a valid email or phone number",
        ),
        (
            "visible_marks",
            "case when len(visible_marks) > 10 then 'Maximum 10 visible marks allowed' end",
        ),
        (
            "current_condition",
            "case when length(current_condition) > 500 "
            "then 'Current condition must be less than 500 characters' end",
        ),
    ]


def _declared_rules(side: str) -> list[tuple[str, str]]:
    """(column, error or NULL) of the declared constraints in order."""
    genders = "('male', 'female', 'other', 'unknown')"
    texts = {"name": (2, 100), "additional_info": (0, 1000)}
    if side == "missing":
        needed, marks = ["name", "location_last_seen", "contact"], "birthmarks"
        texts["location_last_seen"] = (3, 200)
        numbers = {
            "age_at_disappearance": (0, 120),
            "year_disappeared": (1900, AS_OF_YEAR),
            "height_cm": (50, 250),
        }
    else:
        needed, marks = ["current_location", "finder_contact"], "visible_marks"
        texts |= {"current_location": (3, 200), "current_condition": (0, 500)}
        numbers = {"current_age_estimate": (0, 120)}
    rules = [(n, f"case when {n} is null then '{n}: required' end") for n in needed]
    for n, (a, b) in texts.items():
        error = f"'{n}: length must be {a} to {b}'"
        rules.append((n, f"case when length({n}) not between {a} and {b} then {error} end"))
    for n, (a, b) in numbers.items():
        rules.append(
            (n, f"case when {n} not between {a} and {b} then '{n}: must be {a} to {b}' end")
        )
    rules.append((marks, f"case when len({marks}) > 10 then '{marks}: at most 10 items' end"))
    rules.append((
        "gender",
        f"case when gender is null or gender not in {genders} "
        "then 'gender: one of male, female, other, unknown' end",
    ))
    return rules


def _joined(rules: list[tuple[str, str]], columns=None) -> str:
    picked = [error for name, error in rules if columns is None or name in columns]
    return f"concat_ws(' | ', {', '.join(picked)})"


def _validation(side: str, strict: bool) -> str:
    marks = "birthmarks" if side == "missing" else "visible_marks"
    rules = _form_rules(side) + (_declared_rules(side) if strict else [])
    return f"""{cte(f"{side}_forms")},
listed as (select *, {_list(marks + "_text")} as {marks} from {side}_forms),
checked as (select point_id, {_joined(rules)} as errors from listed)
select point_id, errors = '' as is_valid, errors from checked"""


def _upload_errors(side: str) -> str:
    columns = TABLES[side][2]
    stages = [
        f"nullif({_joined([(n, e) for n, e in rules if n in columns])}, '')"
        for rules in (_declared_rules(side), _form_rules(side))
    ]
    return f"coalesce({', '.join(stages)}, {_intake_error(side, FOLDED_DIM)})"


def _upload(side: str) -> str:
    key = _BY_SIDE[side][0]
    return f"""{cte(side)},
checked as (select *, {_upload_errors(side)} as all_errors from {side})
select {key}, case when all_errors is null then {_uuid(side, 'point_id')} end as point_id,
  all_errors as errors from checked"""


def _validate_searches() -> str:
    rules = [
        "case when max_results not between 1 and 100 "
        "then 'Limit must be an integer between 1 and 100' end",
        "case when threshold not between 0 and 1 "
        "then 'Threshold must be a number between 0.0 and 1.0' end",
        "case when gender not in ('male', 'female', 'other', 'unknown') "
        "then 'Filter gender must be one of: male, female, other, unknown' end",
        "case when len(age_range) <> 2 then 'Age range filter must be a list of two integers' "
        "when age_range[1] > age_range[2] then 'Age range minimum must be less than maximum' end",
        "case when len(list_filter(age_range, lambda a: a not between 0 and 120)) > 0 "
        "then 'Ages must be between 0 and 120' end",
    ]
    return f"""{cte("saved_searches")},
checked as (select *, concat_ws(' | ', {', '.join(rules)}) as errors from saved_searches)
select search_id, coalesce(threshold between 0 and 1, false) as threshold_ok,
  coalesce(len(age_range) = 2 and age_range[1] >= 0 and age_range[1] <= age_range[2]
    and age_range[2] <= 120, false) as age_range_ok,
  errors = '' as is_valid, errors from checked"""


def _file_gate() -> str:
    extension = "list_last(string_split(lower(filename), '.'))"
    return f"""{cte("uploads")},
typed as (
  select filename, length, case
    when starts_with(hex(content), 'FFD8FF') then 'image/jpeg'
    when starts_with(hex(content), '89504E470D0A1A0A') then 'image/png'
    when starts_with(hex(content), '474946383761') or starts_with(hex(content), '474946383961')
      then 'image/gif'
    when starts_with(hex(content), '52494646') and substr(hex(content), 17, 8) = '57454250'
      then 'image/webp'
    when content is null and contains(filename, '.')
      and {extension} in ('jpg', 'jpeg', 'png', 'gif', 'webp') then 'image/' || {extension}
    else 'unknown' end as mime_type
  from uploads),
judged as (
  select *, case when length < 1024 then 'File too small (minimum 1024 bytes)'
    when length > 10485760 then 'File too large (maximum 10MB)'
    when mime_type not in ('image/jpeg', 'image/jpg', 'image/png', 'image/gif', 'image/webp')
      then 'Unsupported file type: ' || mime_type end as error
  from typed)
select *, error is null as is_valid from judged"""


def _email_in(contact: str) -> str:
    return (
        f"case when regexp_matches(trim({contact}), '{EMAIL}') then trim({contact}) "
        f"else nullif(regexp_extract({contact}, '{EMAIL_INSIDE}', 0), '') end"
    )


def _extract_email() -> str:
    return f"""{cte("missing_forms", "found_forms")}
select 'missing' as kind, point_id as key, {_email_in("contact")} as email from missing_forms
union all
select 'found', point_id, {_email_in("finder_contact")} from found_forms
union all
select 'document', cast(doc_id as varchar), {_email_in("text")} from documents"""


def _outbox() -> str:
    optional = {
        "missing": ["height_cm", "birthmarks", "additional_info"],
        "found": ["name", "visible_marks", "current_condition", "additional_info"],
    }

    def shown(side: str, name: str) -> str:
        if name in ("birthmarks", "visible_marks"):
            text = f"case when len({name}) > 0 then array_to_string({name}, ', ') end"
        elif name == "height_cm":
            text = "case when height_cm <> 0 then cast(height_cm as varchar) || ' cm' end"
        elif name == "gender":
            text = "upper(gender)"
        else:
            text = f"cast({name} as varchar)"
        if name in optional[side]:
            return f"nullif({text}, '')"
        suffix = " || ' tuổi'" if "age" in name else ""
        return f"coalesce({text}, 'N/A'){suffix}"

    parts = []
    for side, (key, contact) in _BY_SIDE.items():
        marks = "birthmarks" if side == "missing" else "visible_marks"
        fields = ", ".join(
            f"'{label}: ' || ({shown(side, name)})" for name, label in LABELS[side].items()
        )
        subject = SUBJECTS[side].replace("%s", "")
        parts.append(
            f"select {_email_in(contact)} as recipient, '{subject}' || {key} as subject, "
            f"concat_ws(chr(10), {fields}) as body, image_url "
            f"from (select *, {_list(marks + '_text')} as {marks} from {side}_forms) "
            f"where ({_email_in(contact)}) is not null"
        )
    return f"{cte('missing_forms', 'found_forms')} " + " union all ".join(parts)


_SPACES = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_PAIRS = (
    "vp as (select p.*, a.embedding::double[] as l, b.embedding::double[] as r "
    "from vector_pairs p left join vectors a on a.image_id = img1 "
    "left join vectors b on b.image_id = img2)"
)
_COSINE = (
    "list_dot_product(l, r) / ((sqrt(list_dot_product(l, l)) + 1e-8) "
    "* (sqrt(list_dot_product(r, r)) + 1e-8))"
)


_STATUS = (
    "case when l is null and r is null then 'no vectors' when l is null then "
    "'no vector for img1' when r is null then 'no vector for img2' else 'compared' end as status"
)


def _pairs(select: str) -> str:
    return f"{cte('vector_pairs', 'vectors')}, {_PAIRS} select {select}, {_STATUS} from vp"


_HASH = (
    "lower(to_hex(list_sum(list_transform(range(64), lambda i: case when "
    "pixels[i + 1] * 64 > list_sum(pixels) then (1::hugeint << (63 - i)) else 0::hugeint end))"
    "::uhugeint))"
)

_GRAY = (
    "list_transform(embedding, lambda v: cast(round((cast(v as double) + 1.0) * 127.5) as bigint))"
)


def _around(down: int, right: int) -> str:
    """Neighbour of pixel i of an 8x8 image, mirrored at the borders."""

    def mirrored(position: str, step: int) -> str:
        return f"(7 - abs(7 - abs({position} + {step})))"

    return f"pixels[{mirrored('(i // 8)', down)} * 8 + {mirrored('(i % 8)', right)} + 1]"


_DOC_HASH = f"""{cte("document_prints")},
thumbs as (select image_id, list_transform(range(64),
  lambda i: (strpos('0123456789abcdef', substr(digits, i + 1, 1)) - 1) * 17) as pixels
  from document_prints),
hashed as (select image_id, {_HASH} as hash from thumbs),
groups as (select hash, count(*) as n_copies, min(image_id) as first_image from hashed
  group by hash having count(*) > 1)"""

_FACES = (
    "faces as (select image_id, face_id, x as x1, y as y1, x + w as x2, y + h as y2, "
    "confidence, w * h as area from detections where confidence >= 0.70)"
)


def _best_face(order: str) -> str:
    return f"""{cte("detections")}, {_FACES}
select image_id, face_id, round(confidence, 6) as confidence, area from faces
qualify row_number() over (partition by image_id order by {order}, face_id desc) = 1"""


_NAME = "regexp_extract(path, '[^/]+$', 0)"
_STEM = f"replace(replace({_NAME}, '.JPG', ''), '.jpg', '')"
_PATTERN = r"^(\d{3})([AB])(\d{2})"
_TARGET = "'person_' || {0} || '/age_' || lpad(cast({1} as varchar), 2, '0') || '.jpg'"

_FILES = f"""{cte("age_files")},
parsed as (
  select regexp_extract({_STEM}, '{_PATTERN}', 1) as person_id,
    regexp_extract({_STEM}, '{_PATTERN}', 2) as version,
    cast(regexp_extract({_STEM}, '{_PATTERN}', 3) as int) as age,
    {_NAME} as original_name, path
  from age_files where regexp_matches({_STEM}, '{_PATTERN}')),
kept as (select person_id, age, count(*) as n_files, max(path) as path from parsed
  group by person_id, age),
persons as (
  select person_id, count(*) as n_images,
    string_agg(cast(age as varchar), ',' order by age) as ages, min(age) as min_age,
    max(age) as max_age, max(age) - min(age) as age_span
  from kept group by person_id),
same as (
  select {_TARGET.format('a.person_id', 'a.age')} as img1,
    {_TARGET.format('b.person_id', 'b.age')} as img2, 1 as label, b.age - a.age as age_gap
  from kept a join kept b on a.person_id = b.person_id and b.age > a.age and b.age - a.age >= 10),
numbered as (select person_id, row_number() over (order by person_id) - 1 as place from persons),
images as (select person_id, age, row_number() over (partition by person_id order by age) - 1 as place
  from kept),
drawn as (
  select *, (select count(*) from persons) as n,
    {{draws}}
  from same),
seats as (
  select *, d1 % n as p1, (d1 % n + 1 + d2 % (n - 1)) % n as p2 from drawn where n > 1),
diff as (
  select {_TARGET.format('x.person_id', 'x.age')} as img1,
    {_TARGET.format('y.person_id', 'y.age')} as img2, 0 as label, 0 as age_gap
  from seats s join numbered u on u.place = s.p1 join numbered v on v.place = s.p2
    join persons pu on pu.person_id = u.person_id join persons pv on pv.person_id = v.person_id
    join images x on x.person_id = u.person_id and x.place = s.d3 % pu.n_images
    join images y on y.person_id = v.person_id and y.place = s.d4 % pv.n_images)
""".replace(
    "{draws}",
    ", ".join(
        f"cast('0x' || substr(md5('{SEED}|{role}|' || img1 || '|' || img2), 1, 8) as bigint) as d{i}"
        for i, role in enumerate(("p1", "p2", "i1", "i2"), 1)
    ),
)

_CASE_COLUMNS = (
    "1.0 as face_similarity, 1.0 as metadata_similarity, 1.0 as combined_score, "
    "'VERY_HIGH' as confidence_level, 1.0 as confidence_score, name as metadata_name"
)
_MISSING_CASES = (
    "(select 'missing' as collection_type, point_id as id, case_id, name, gender, "
    f"coalesce(nullif(contact, ''), 'No contact available') as contact, {_CASE_COLUMNS} "
    "from missing_forms order by point_id limit {0})"
)
_FOUND_CASES = (
    "(select 'found' as collection_type, point_id as id, found_id as case_id, name, gender, "
    f"coalesce(finder_contact, 'No contact available') as contact, {_CASE_COLUMNS} "
    "from found_forms order by point_id limit {0})"
)


def _counts(missing: str, found: str, names: tuple[str, str, str], extra: str = "") -> str:
    m, f = f"(select count(*) from {missing})", f"(select count(*) from {found})"
    return (
        f"{cte(missing, found)} select {m} as {names[0]}, {f} as {names[1]}, "
        f"{m} + {f} as {names[2]}{extra}"
    )


def _health(side: str) -> str:
    return (
        f"select '{side}_persons' as collection_name, count(*) as points_count, "
        "count(*) filter (where embedding is null) as without_vector, "
        f"count(*) filter (where len(embedding) <> {VECTOR_DIM}) as wrong_dimension, "
        "case when points_count > 0 and without_vector = 0 and wrong_dimension = 0 "
        f"then 'healthy' else 'unhealthy' end as status from {side}_uploads"
    )


def _filter(side: str, condition: str) -> str:
    return f"{cte(f'{side}_forms')} select point_id, gender, name from {side}_forms where {condition}"


def _derived() -> str:
    gender = "case when gender not in ('unknown', 'other', '') then gender end as want_gender"
    estimate = f"(age_at_disappearance + ({AS_OF_YEAR} - year_disappeared))"
    return f"""{cte("missing", "found")}
select 'missing' as side, point_id, {gender}, greatest(0, {estimate} - 5) as want_age_low,
  {estimate} + 5 as want_age_high from missing
union all
select 'found', point_id, {gender}, greatest(0, current_age_estimate - 50),
  least(120, current_age_estimate + 5) from found"""


def build() -> dict[str, str]:
    judged = _candidates
    epoch = "(epoch_us(ts) // 1000)"
    return {
        "match_missing_to_found": M.match("missing"),
        "match_found_to_missing": M.match("found"),
        "match_bilateral": _match_bilateral(),
        "match_arrivals": _arrivals(),
        "match_streams": _arrivals(),
        "match_arrivals_indexed": _arrivals(),
        "match_prefiltered": _prefiltered(),
        "search_by_case": _lookup("missing"),
        "search_by_found": _lookup("found"),
        "match_other_weights": _other_weights(),
        "match_grid": _grid(),
        "knn_merged": _knn(),
        "knn_filtered": f"""{cte("missing", "found")},
pairs as (
  select m.point_id as query_id, f.point_id as candidate_id,
    round(list_cosine_similarity(m.embedding, f.embedding), 9) as s from missing m, found f
  where f.gender = 'female' and f.current_age_estimate between 18 and 60)
select query_id, candidate_id, round(s, 6) as face_similarity from pairs where s >= 0.45
qualify row_number() over (partition by query_id order by s desc, candidate_id) <= 10""",
        "reset_roundtrip": _reset(),
        "knn_topk": _knn(),
        "knn_broadcast_queries": _knn(),
        "knn_blocked": _knn(),
        "knn_indexed": _knn(),
        "rerank": judged(
            "row_number() over (partition by qid order by comb desc, face desc, cid) as match_rank, "
            "round(face, 6) as face_similarity, round(meta, 6) as metadata_similarity, "
            "round(comb, 6) as combined_score"
        ),
        "accept": judged("ok as accepted"),
        "reject_rules": judged("rule as reject_rule"),
        "derive_filters": _derived(),
        "gender_similarity": judged("g_m as gender_match"),
        "age_similarity": judged("round(a_c, 6) as age_consistency"),
        "marks_similarity": judged("round(m_s, 6) as marks_similarity"),
        "location_similarity": judged("round(l_p, 6) as location_plausibility"),
        "metadata_similarity": judged(
            "round(meta, 6) as metadata_similarity, round(comb, 6) as combined_score"
        ),
        "conf_factors": f"""{M.scored("missing")},{M.confidence("judged")}
select qid as query_id, cid as candidate_id, round(f_age, 6) as age_plausibility,
  round(f_loc, 6) as location_proximity, round(f_feat, 6) as distinctive_features,
  0.5::double as temporal_consistency from factors""",
        "confidence": f"""{M.scored("missing")},{M.confidence("judged")}
select qid as query_id, cid as candidate_id, round(conf, 6) as confidence_score,
  level as confidence_level from confident""",
        "confidence_hist": " union all ".join(
            f"select * from ({M.ranked(side)},{M.confidence('final')} "
            f"select '{other}' as search_type, level as confidence_level, count(*) as matches, "
            "round(avg(conf), 6) as avg_confidence, round(avg(face), 6) as avg_face_similarity "
            "from confident group by level)"
            for side, other in (("missing", "found"), ("found", "missing"))
        ),
        "explain": M.explain(),
        "ingest_missing": _ingest("missing"),
        "ingest_found": _ingest("found"),
        "stored_missing": _ingest("missing"),
        "ingest_rejects": _ingest_rejects(),
        "upload_missing": _upload("missing"),
        "upload_found": _upload("found"),
        "prepare_forms": f"""{cte("missing_forms")}
select point_id, case when height_cm is not null then case_id
    else 'MISS_' || epoch_ms(timestamp '{UPLOADED_AT}') || '_' ||
      upper(substr(sha256(point_id), 1, 12)) end as case_id,
  lower(gender) as gender, array_to_string({_list("birthmarks_text")}, '|') as marks
from missing_forms""",
        "list_page": f"""{cte("found_forms")},
fetched as (select * from found_forms where point_id >= 'f2' order by point_id limit 101),
page as (select *, row_number() over (order by point_id) as rn from fetched)
select point_id, found_id, current_age_estimate, gender,
  (select point_id from page where rn = 101) as next_offset from page where rn <= 100""",
        "delete_points": f"""{cte("missing_forms", "withdrawn")}
select point_id, case_id, name from missing_forms
where point_id not in (select point_id from withdrawn)""",
        "update_metadata": f"""{cte("missing_forms", "metadata_patches")},
last as (select point_id, arg_max(contact, seq) filter (where contact is not null) as contact,
  arg_max(height_cm, seq) filter (where height_cm is not null) as height_cm
  from metadata_patches group by point_id)
select b.point_id, case_id, coalesce(l.contact, b.contact) as contact,
  coalesce(l.height_cm, b.height_cm) as height_cm, estimated_current_age
from missing_forms b left join last l using (point_id)""",
        "get_points": f"""{cte("missing_forms", "withdrawn")}
select point_id, case_id, name, contact from missing_forms
where point_id in (select point_id from withdrawn)""",
        "search_zoned": f"""{cte("found_forms")}
select point_id, gender, current_age_estimate from found_forms
where gender = 'female' and current_age_estimate between 18 and 40""",
        "person_record": f"""{cte("missing_forms", "found_forms")}
select point_id as id, coalesce(nullif(contact, ''), 'No contact available') as contact,
  image_url, gender from missing_forms
union all
select point_id, coalesce(finder_contact, 'No contact available'), image_url, gender
from found_forms""",
        "filter_eq": _filter("missing", "gender = 'male'"),
        "filter_in": _filter("missing", "gender in ('male', 'Female', 'unknown')"),
        "filter_age_range": _filter("missing", "estimated_current_age between 20 and 60"),
        "filter_age_range_found": _filter("found", "current_age_estimate between 20 and 60"),
        "filter_conj": _filter(
            "found", "current_age_estimate between 18 and 45 and gender in ('male', 'female')"
        ),
        "search_metadata": f"""{cte("missing_forms")}
select point_id, case_id, gender, 1.0 as score from missing_forms where gender = 'male'
order by point_id limit 10""",
        "list_cases": f"{cte('missing_forms', 'found_forms')} {_MISSING_CASES.format(100)} "
        f"union all {_FOUND_CASES.format(100)}",
        "list_cases_missing": f"{cte('missing_forms')} {_MISSING_CASES.format(20)}",
        "list_cases_found": f"{cte('found_forms')} {_FOUND_CASES.format(20)}",
        "case_stats": _counts(
            "missing_forms", "found_forms", ("total_missing", "total_found", "total_cases")
        ),
        "collection_stats": f"{cte('missing', 'found')} "
        + " union all ".join(
            f"select '{s}_persons' as collection_name, count(*) as points_count, "
            f"cast(max(len(embedding)) as int) as vector_size, 'Cosine' as distance_metric from {s}"
            for s in ("missing", "found")
        ),
        "search_stats": _counts(
            "missing",
            "found",
            ("missing_persons_count", "found_persons_count", "total_records"),
            ", 0.8::double as face_threshold, 0.3::double as metadata_weight, 5 as age_tolerance",
        ),
        "data_health": f"{cte('missing_uploads', 'found_uploads')} "
        f"{_health('missing')} union all {_health('found')}",
        "validate_missing": _validation("missing", strict=False),
        "validate_found": _validation("found", strict=False),
        "validate_missing_strict": _validation("missing", strict=True),
        "validate_found_strict": _validation("found", strict=True),
        "validate_searches": _validate_searches(),
        "file_gate": _file_gate(),
        "parse_marks": f"""{cte("found_forms")},
listed as (select point_id, {_list("visible_marks_text")} as marks from found_forms)
select point_id, cast(len(marks) as int) as n_marks, array_to_string(marks, '|') as marks
from listed""",
        "sanitize_text": "select doc_id, substr(trim(regexp_replace(regexp_replace(text, "
        rf"'[\x{{00}}-\x{{1f}}\x{{7f}}-\x{{9f}}]', '', 'g'), '{_SPACES}', ' ', 'g')), 1, 1000) "
        "as clean from documents",
        "extract_email": _extract_email(),
        "notify_outbox": _outbox(),
        "notify_stream": f"select distinct * from ({_outbox()})",
        "make_ids": f"""{cte("arrivals_log")}
select event_id, 'MISS_' || strftime(ts, '%Y%m%d%H%M%S') || '_' ||
  upper(substr(sha256(cast(event_id as varchar)), 1, 6)) as dated_id,
  'FOUND_' || {epoch} || '_' ||
  upper(substr(sha256(cast(event_id as varchar)), 1, 12)) as millis_id from arrivals_log""",
        "vec_normalize": f"""{cte("vectors")},
d as (select image_id, embedding::double[] as e from vectors),
n as (select image_id, e, sqrt(list_dot_product(e, e)) as norm from d),
u as (select image_id, unnest(range(len(e))) as position, unnest(e) as v, norm from n)
select image_id, cast(position as int) as position,
  round(case when norm = 0 then v else v / norm end, 6) as value from u""",
        "vec_cosine": _pairs(f"pair_id, round({_COSINE}, 6) as cosine"),
        "vec_euclid": _pairs("pair_id, round(list_distance(l, r), 6) as distance"),
        "sim_dist": _pairs(
            f"pair_id, round({_COSINE}, 6) as similarity, round(1.0 - ({_COSINE}), 6) as distance, "
            f"round(1.0 - (1.0 - ({_COSINE})), 6) as back"
        ),
        "verify_pairs": _pairs(
            f"pair_id, img1, img2, round({_COSINE}, 6) as cosine_similarity, "
            "round(list_distance(l, r), 6) as euclidean_distance, 0.6::double as threshold, "
            f"({_COSINE}) >= 0.6 as is_match"
        ),
        "embed_batch": f"""{cte("missing_uploads")},
raw as (select case_id, list_transform(embedding, lambda v: cast(v * 2.0::float + 0.5::float as double)) as e
  from missing_uploads where len(embedding) = {VECTOR_DIM}),
u as (select case_id, unnest(range(len(e))) as pos,
  unnest(list_transform(e, lambda v: cast(v / sqrt(list_dot_product(e, e)) as float))) as v from raw)
select case_id, count(*) as dim, round(sum(cast(v as double) * (pos + 1)), 3) as weighted_sum
from u group by case_id""",
        "embed_status": f"""{cte("missing_uploads")}
select upload_key, case when len(embedding) = {VECTOR_DIM} then 'embedded' else 'unreadable' end as embedding_status,
  case when len(embedding) = {VECTOR_DIM} then {VECTOR_DIM} else 0 end as dim from missing_uploads""",
        "detections": f"""{cte("detections")}, {_FACES}
select image_id, face_id, x1, y1, x2, y2, round(confidence, 6) as confidence, area from faces""",
        "best_face": _best_face("confidence desc, area desc"),
        "best_face_by_area": _best_face("area desc, confidence desc"),
        "quality_gate": f"""{cte("face_metrics")},
g as (select image_id, sharpness >= 100 as is_sharp, brightness between 40 and 220 as is_bright_enough,
  contrast >= 30 as is_contrasted from face_metrics)
select *, is_sharp and is_bright_enough and is_contrasted as is_good_quality from g""",
        "image_valid": f"""{cte("face_metrics")}
select image_id, width, height, channels, channels = 3 and width >= 50 and height >= 50 as is_valid
from face_metrics""",
        "avg_hash": f"""{cte("face_thumbs")},
thumbs as (select image_id, {_GRAY} as pixels from face_thumbs)
select image_id, {_HASH} as hash from thumbs""",
        "image_audit": f"""{cte("face_thumbs")},
given as (select image_id, {_GRAY} as p, cast(image_id as bigint) % 3 = 1 as colour
  from face_thumbs where cast(image_id as bigint) % 5 <> 0),
thumbs as (select image_id, colour, case when colour then {_COLOUR} else p end as pixels from given),
measured as (select image_id, colour, pixels, list_transform(range(64), lambda i:
  {_around(-1, 0)} + {_around(1, 0)} + {_around(0, -1)} + {_around(0, 1)} - 4 * pixels[i + 1]) as edges
  from thumbs)
select image_id as origin, 8 as width, 8 as height, case when colour then 3 else 1 end as channels,
  case when colour then 192 else 64 end as size_bytes,
  round(list_avg(pixels), 6) as brightness, round(list_stddev_pop(pixels), 6) as contrast,
  round(list_var_pop(edges), 6) as sharpness, list_var_pop(edges) < 100 as is_blurry,
  {_HASH} as hash, null as error from measured
union all
select image_id, null, null, null, null, null, null, null, null, null,
  'image could not be decoded' from face_thumbs where cast(image_id as bigint) % 5 = 0""",
        "dup_hash": f"{_DOC_HASH} select * from groups",
        "dup_members": f"{_DOC_HASH} select image_id, hash, n_copies, first_image "
        "from hashed join groups using (hash)",
        "dup_near": f"""{cte("face_thumbs")},
thumbs as (select image_id, {_GRAY} as pixels from face_thumbs),
hashed as (select image_id, {_HASH} as hash from thumbs),
digits as (select image_id, hash, list_transform(range(1, 17),
  lambda i: strpos('0123456789abcdef', lpad(hash, 16, '0')[i]) - 1) as d from hashed),
near as (
  select a.image_id, count(*) as n, min(b.image_id) as least from digits a join digits b
    on a.image_id <> b.image_id
  where list_sum(list_transform(range(1, 17), lambda i: bit_count(xor(a.d[i], b.d[i])))) <= 7
  group by a.image_id)
select image_id, hash, coalesce(n, 0) as n_near, least(image_id, coalesce(least, image_id)) as first_near
from hashed left join near using (image_id)""",
        "list_images": f"{cte('age_files')} select extension, count(*) as rows from age_files, "
        "(values ('JPG'), ('jpg')) as kinds(extension) group by extension",
        "fg_parse": f"{_FILES} select * from parsed",
        "fg_by_person": f"{_FILES} select person_id, age, path, row_number() over (partition by "
        "person_id order by age, substr(md5(path), 1, 2), path) as position from parsed",
        "fg_dedup": f"{_FILES} select person_id, age, path from kept",
        "fg_manifest": f"{_FILES} select path, {_TARGET.format('person_id', 'age')} as target, "
        "person_id, age from kept",
        "fg_person_stats": f"{_FILES} select * from persons",
        "fg_overall_stats": f"{_FILES} select count(*) as persons, cast(sum(n_images) as bigint) "
        "as images, round(avg(n_images), 6) as avg_images, min(age_span) as min_span, "
        "max(age_span) as max_span, round(avg(age_span), 6) as avg_span from persons",
        "fg_sample": f"{_FILES} select * from persons order by person_id limit 5",
        "fg_same_pairs": f"{_FILES} select * from same",
        "fg_diff_pairs": f"{_FILES} select * from diff",
        "fg_all_pairs": f"{_FILES} select * from same union all select * from diff",
        "fg_pair_file": f"{_FILES} select * from same union all select * from diff",
        "fg_pair_counts": f"{_FILES} select label, count(*) as pairs from "
        "(select label from same union all select label from diff) group by label",
    }


ORACLE = build()
# Other layouts of a table give the same rows.
ORACLE |= {
    "update_bucketed": ORACLE["update_metadata"],
    "delete_bucketed": ORACLE["delete_points"],
    "points_zoned": ORACLE["get_points"],
    "page_zoned": ORACLE["list_page"],
}
