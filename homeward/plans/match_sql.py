"""Checking SQL of the matching queries, written independently of the Spark code."""

from __future__ import annotations

from homeward.config import ConfidenceConfig
from homeward.functions import wording as W
from homeward.plans.casework import AS_OF_YEAR, cte

_WORDS = r"list_distinct(list_filter(string_split_regex(replace(place, ',', ' '), '\s+'), lambda w: w <> ''))"


def _features(side: str) -> str:
    if side == "missing":
        age = f"nullif(age_at_disappearance, 0) + ({AS_OF_YEAR} - nullif(year_disappeared, 0))"
        marks, place = "birthmarks", "location_last_seen"
    else:
        age, marks, place = "nullif(current_age_estimate, 0)", "visible_marks", "current_location"
    return f"""
{side}_plain as (
  select *, nullif(lower(gender), '') as g, {age} as a,
    list_distinct(list_transform(coalesce({marks}, []), lambda m: trim(lower(m)))) as marks,
    trim(lower(nullif({place}, ''))) as place
  from {side}),
{side}_features as (select *, {_WORDS} as words from {side}_plain)"""


_JACCARD = "len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"


def scored(side: str, limit: int = 10) -> str:
    """``WITH`` clause ending in ``judged``: every candidate with its scores and verdicts."""
    other = "found" if side == "missing" else "missing"
    current, expected = ("c.a", "q.a") if side == "missing" else ("q.a", "c.a")
    marks = _JACCARD.format("q.marks", "c.marks")
    words = _JACCARD.format("q.words", "c.words")
    rule = """case when g_m = 0 and face > 0.85 then 1 when face > 0.92 and meta < 0.35 then 2
      when face > 0.90 and a_c < 0.1 then 3
      when face > 0.88 and a_c < 0.05 and meta < 0.4 then 4 end"""
    return f"""{cte("missing", "found")},{_features("missing")},{_features("found")},
pairs as (
  select q.point_id as qid, c.point_id as cid,
    round(list_cosine_similarity(q.embedding, c.embedding), 9) as face
  from {side} q, {other} c),
pool as (
  select * from pairs where face >= 0.45
  qualify row_number() over (partition by qid order by face desc, cid) <= {5 * limit}),
components as (
  select p.*, {'q.age_at_disappearance' if side == 'missing' else 'q.current_age_estimate'} as q_age,
    {'q.year_disappeared' if side == 'missing' else 'cast(null as int)'} as q_year,
    {'c.current_age_estimate' if side == 'missing' else 'c.age_at_disappearance'} as c_age,
    {'cast(null as int)' if side == 'missing' else 'c.year_disappeared'} as c_year,
    {'c.finder_contact' if side == 'missing' else "coalesce(nullif(c.contact, ''), 'No contact available')"} as contact,
    c.image_url,
    case when q.g is null or c.g is null then 0.5 when q.g = c.g then 1.0 else 0.0 end::double as g_m,
    (case when {current} is null or {expected} is null then 0.5
      when abs({current} - {expected}) <= 5 then 1.0::double - (abs({current} - {expected})::double / 5.0::double) * 0.3::double
      else greatest(0.0, 0.7::double * exp(-(abs({current} - {expected})::double - 5.0::double) / 5.0::double)) end)::double as a_c,
    (case when len(q.marks) = 0 and len(c.marks) = 0 then 0.5
      when len(q.marks) = 0 or len(c.marks) = 0 then 0.3 else {marks} end)::double as m_s,
    (case when q.place is null or c.place is null then 0.5 when q.place = c.place then 1.0
      when len(q.words) = 0 and len(c.words) = 0 then 0.0 else {words} end)::double as l_p
  from pool p join {side}_features q on q.point_id = qid join {other}_features c on c.point_id = cid),
blended as (
  select *, g_m * 0.3::double + a_c * 0.3::double + m_s * 0.25::double + l_p * 0.15::double as m from components),
weighted as (
  select *, least(1.0::double, greatest(0.0::double, case when g_m = 0 then m * 0.4::double else m end)) as meta from blended),
combined as (select *, 0.7::double * face + 0.3::double * meta as comb from weighted),
judged as (
  select *, {rule if side == "missing" else "cast(null as int)"} as rule,
    face >= 0.80 or comb >= 0.55 or (face >= 0.50 and meta >= 0.60) as ok
  from combined)"""


def ranked(side: str, limit: int = 10) -> str:
    """... ending in ``final``: accepted matches in order."""
    return f"""{scored(side, limit)},
final as (
  select *, row_number() over (partition by qid order by comb desc, face desc, cid) as rk
  from judged where rule is null and ok qualify rk <= {limit})"""


def confidence(of: str) -> str:
    """CTEs ``factors`` and ``confident`` on top of a table with component columns."""
    w = ConfidenceConfig().weights
    return f"""
factors as (
  select *,
    case when a_c >= 0.9 then 1.0 when a_c >= 0.7 then 0.8::double + (a_c - 0.7::double)
      when a_c >= 0.5 then 0.5::double + (a_c - 0.5::double) * 1.5::double else a_c end::double as f_age,
    case when l_p >= 0.8 then 1.0 when l_p >= 0.5 then 0.7::double + (l_p - 0.5::double)
      when l_p >= 0.2 then 0.4::double + (l_p - 0.2::double) else l_p * 2.0::double end::double as f_loc,
    case when m_s >= 0.8 then 1.0 when m_s >= 0.5 then 0.8::double + (m_s - 0.5::double) * 0.67::double
      when m_s >= 0.3 then 0.5::double + (m_s - 0.3::double) * 1.5::double else m_s * 1.67::double end::double as f_feat
  from {of}),
raw_confidence as (
  select *, {w['face_similarity']!r}::double * face + {w['metadata_consistency']!r}::double * meta
    + {w['age_plausibility']!r}::double * f_age + {w['location_proximity']!r}::double * f_loc
    + {w['distinctive_features']!r}::double * f_feat as raw from factors),
confident as (
  select *, least(1.0::double, greatest(0.0::double, case when g_m = 0 then raw * 0.5::double else raw end)) as conf,
    case when conf >= 0.90 then 'VERY_HIGH' when conf >= 0.75 then 'HIGH' when conf >= 0.60 then 'MEDIUM'
      when conf >= 0.40 then 'LOW' else 'VERY_LOW' end as level
  from raw_confidence)"""


MATCH_COLUMNS = """qid as query_id, cid as candidate_id, rk as match_rank,
  round(face, 6) as face_similarity, round(meta, 6) as metadata_similarity,
  round(comb, 6) as combined_score, round(conf, 6) as confidence_score, level as confidence_level,
  g_m as gender_match, round(a_c, 6) as age_consistency, round(m_s, 6) as marks_similarity,
  round(l_p, 6) as location_plausibility, contact, image_url"""


def match(side: str, limit: int = 10) -> str:
    ages = (
        "q_age as query_age_at_disappearance, q_year as query_year_disappeared, "
        "c_age as match_current_age"
        if side == "missing"
        else "q_age as query_current_age, c_age as match_age_at_disappearance, "
        "c_year as match_year_disappeared"
    )
    other = "found" if side == "missing" else "missing"
    return f"""{ranked(side, limit)},{confidence("final")}
select '{other}' as search_type, {MATCH_COLUMNS}, {ages} from confident"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bands(column: str, name: str) -> str:
    texts = W.DESCRIPTIONS[name]
    cases = " ".join(f"when {column} >= {b} then {_q(t)}" for b, t in zip(W.BANDS, texts))
    return f"case {cases} else {_q(texts[-1])} end"


def explain() -> str:
    """The explanation of every match, flattened to text columns."""
    w = ConfidenceConfig().weights
    columns = dict(zip(w, ["face", "meta", "f_age", "f_loc", "f_feat"]))
    flat = ",\n  ".join(
        f"{_bands(c, n)} as {n}_text, round({c} * {w[n]!r}::double, 6) as {n}_part"
        for n, c in columns.items()
    )
    R, S, A = W.REASONS, W.SUMMARY_SUPPORT, W.SUMMARY_ALERT
    face_reason = " ".join(
        f"when face >= {low} then printf({_q(W.FACE_REASONS[n])}, face)"
        for n, low in (("strong", 0.8), ("moderate", 0.6), ("weak", -2))
    )

    def high_low(column, high, low, name):
        return (
            f"case when {column} >= {high} then {_q(R[name + '_high'])} "
            f"when {column} < {low} then {_q(R[name + '_low'])} end"
        )

    def alert(texts, default):
        return (
            f"case when face > 0.95 and meta < 0.3 then {_q(texts['warning'])} "
            f"when face > 0.90 and meta < 0.4 then {_q(texts['caution'])} else {default} end"
        )

    levels = " ".join(f"when {_q(k)} then {_q(v)}" for k, v in W.SUMMARIES.items())
    advice = " ".join(
        f"when {_q(k)} then {_q(' | '.join(v))}" for k, v in W.RECOMMENDATIONS.items()
    )
    E = W.EXTRA_RECOMMENDATIONS
    return f"""{ranked("missing")},{confidence("final")}
select qid as query_id, cid as candidate_id, level as confidence_level,
  round(conf, 3) as confidence_score, {flat},
  concat_ws(' | ', case {face_reason} end, {high_low('f_age', 0.8, 0.5, 'age')},
    {high_low('f_loc', 0.7, 0.3, 'location')}, {high_low('f_feat', 0.7, 0.3, 'features')},
    case when g_m = 1 then {_q(R['gender_same'])} when g_m = 0 then {_q(R['gender_conflict'])} end,
    {alert(R, 'null')}) as reasons,
  (case level {levels} end) || (case when face >= 0.8 and f_age >= 0.8 then {_q(S['both'])}
    when face >= 0.8 then {_q(S['face'])} when f_age >= 0.8 then {_q(S['age'])} else '' end)
    || ({alert(A, "''")}) as summary,
  concat_ws(' | ', case level {advice} end, case when face < 0.6 then {_q(E['face'])} end,
    case when f_age < 0.5 then {_q(E['age'])} end,
    case when f_loc < 0.3 then {_q(E['location'])} end) as recommendations,
  0.9::double as very_high, 0.75::double as high, 0.6::double as medium, 0.4::double as low
from confident"""
