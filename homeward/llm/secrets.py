"""Secret scans: base patterns, and character Markov models of random and ordinary strings.

Base kinds are patterns whose matches are found leftmost and without overlap per kind. The
models add spans of kind ``markov``: runs of at least ``MIN_RUN`` key characters with a digit and a
letter that overlap no base span and whose characters follow each other as in random strings
rather than as in ordinary ones. Both models are first-order chains over ASCII. The labelled
samples come from the corpus: values of base matches are random strings, runs of key characters
elsewhere are ordinary; both are counted over all documents. Without any of either kind there are
no added spans.

Only DataFrame functions. Places are code points, ends exclusive. Null texts count as empty and
have no spans. Every text is searched whole. Repeated rows are rows like others. The struct that is
added is the last column, under the next free name with underscores in front if a column has its name
in any case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward.llm.common import drawn, fresh
from homeward.llm.quality_rules import literal

# Fixed patterns. Runs shorter than the least length cannot be part of a longer one for access and
# hex, so the length stands in the pattern; a short assignment uses up its characters and is
# dropped afterwards.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]
MIN_VALUE = 8
MIN_RUN = 20
KEY = "A-Za-z0-9+/_=-"
RUN = rf"(?<![{KEY}])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[{KEY}]{{{MIN_RUN},}}"
ORDINARY = rf"[{KEY}]{{8,}}"
# Mean log-likelihood ratio per step, random over ordinary.
THRESHOLD = 0.5
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _found(text: Column, pattern: str, rank: int, group: int | None = None) -> Column:
    """Spans of all matches: pieces between matches and matches lie one behind the other."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    joined = F.arrays_zip(
        F.transform(pieces, lambda p: F.length(p)).alias("gap"),
        F.transform(hits, lambda h: F.length(h)).alias("size"),
        F.transform(values, lambda v: F.length(v)).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def extend(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["size"]).alias("end"))
        longer = F.when(x["value"] >= MIN_VALUE, F.array_append(acc["spans"], span))
        return F.struct(
            (begin + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.coalesce(longer, acc["spans"]).alias("spans"),
        )

    spans = F.aggregate(joined, start, extend, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    return F.concat(_found(text, ASSIGN, 0, 2), _found(text, ACCESS, 1), _found(text, HEX, 2))


def markov_ratios(docs: DataFrame, bound: int | None = None) -> list[float] | None:
    """Log ratio, random over ordinary, of each step between two ASCII characters.

    All documents are counted unless the caller asks for a sample of about ``bound``.
    """
    if bound is not None:
        docs = docs.filter(F.col("doc_id").isNotNull() & drawn(bound / max(1, docs.count()), 7, "doc_id"))
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.regexp_replace(text, "|".join([ASSIGN, ACCESS, HEX]), " ")
    labelled = docs.select(
        F.explode(F.concat(
            *[F.transform(F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda v: F.length(v) >= n),
                          lambda v: F.struct(F.lit(True).alias("random"), v.alias("run")))
              for p, g, n in ((ASSIGN, 2, MIN_VALUE), (ACCESS, 0, 16), (HEX, 0, 32))],
            F.transform(F.regexp_extract_all(blank, F.lit(ORDINARY), F.lit(0)),
                        lambda v: F.struct(F.lit(False).alias("random"), v.alias("run"))),
        )).alias("labelled")
    ).select("labelled.*")
    # Equal runs are counted first: a corpus repeats its words far more often than it has new ones.
    runs = labelled.groupBy("random", "run").agg(F.count("*").alias("n"))
    steps = (
        runs.select("random", "n", F.explode(_steps(F.col("run"))).alias("step"))
        .groupBy("random", "step")
        .agg(F.sum("n").alias("count"))
        .filter("step is not null")
        .collect()  # at most two rows for each pair of ASCII characters
    )
    counts = {True: [0.0] * (128 * 128), False: [0.0] * (128 * 128)}
    for r in steps:
        counts[r.random][r.step] += r["count"]
    if not any(counts[True]) or not any(counts[False]):
        return None
    used = sorted({s // 128 for r in steps for s in (r.step, r.step % 128 * 128)})
    ratios = [0.0] * (128 * 128)
    for a in used:
        totals = {k: sum(counts[k][a * 128 : a * 128 + 128]) + len(used) for k in counts}
        for b in used:
            p = {k: (counts[k][a * 128 + b] + 1) / totals[k] for k in counts}
            ratios[a * 128 + b] = math.log(p[True] / p[False])
    return ratios


def _steps(run: Column) -> Column:
    """Numbers of the pairs of neighbouring characters; a null outside ASCII."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    return F.transform(
        F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda c, i: F.when((c < 128) & (F.get(codes, i) < 128), F.get(codes, i) * 128 + c),
    )


def scan(
    docs: DataFrame, out: str = "secrets", threshold: float = THRESHOLD, train_docs: int | None = None
) -> DataFrame:
    """Add struct ``out`` (base, spans): sorted spans (start, rank of the kind, end)."""
    out, source, base, runs = fresh(docs, out, "source_text", "base", "runs")
    ratios = markov_ratios(docs, train_docs)
    found = docs.withColumn(source, F.coalesce(F.col("text"), F.lit(""))).withColumn(
        base, F.array_sort(base_spans(F.col(source)))
    )
    if ratios is None:
        added = F.array().cast(_SPAN)
    else:
        weights = literal(ratios)

        def random(span: Column) -> Column:
            n = span["end"] - span["start"]
            steps = _steps(F.substring(F.col(source), span["start"] + 1, n))
            total = F.aggregate(
                steps, F.lit(0.0), lambda a, s: a + F.coalesce(F.get(weights, s), F.lit(0.0))
            )
            return total >= threshold * (n - 1)

        added = F.filter(
            F.col(runs),
            lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            & random(s),
        )
        found = found.withColumn(runs, _found(F.col(source), RUN, 3))
    return found.withColumn(
        out,
        F.struct(
            F.col(base).alias("base"), F.array_sort(F.concat(F.col(base), added)).alias("spans")
        ),
    ).drop(source, base, runs)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        fresh_span = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh_span, F.concat(acc["text"], gap, F.lit(mark))).otherwise(acc["text"]).alias("text"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    rest = lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with their secrets replaced; ``n_chars`` follows where there is one."""
    scanned = scan(docs, **options)
    out = scanned.columns[-1]
    cleaned = scanned.withColumn("text", redacted(F.col("text"), F.col(f"{out}.spans"), mark))
    if "n_chars" in docs.columns:
        changed = F.size(f"{out}.spans") > 0
        cleaned = cleaned.withColumn(
            "n_chars",
            F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")),
        )
    return cleaned.select(*docs.columns)
