"""Quality rules: fixed base rules, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over the buckets
are counted, one of the whole raw corpus and one of all trusted target documents; a document's score
is the mean log ratio of its n-grams, target over raw. Documents that look like the target score
near zero or above, text that only the raw corpus has scores far below. Every document whose
score is under ``threshold`` is rejected, whatever the others score.

The number of buckets grows with the n-grams of the target, so that a bucket has ``PER_BUCKET`` of
them on average, from 2^``LEAST_BITS`` to 2^``MOST_BITS``; log ratios are kept in steps of
1 / ``STEPS``. What every task gets is therefore a list of 262,144 small numbers at most.

Only DataFrame functions. A null or blank text has no words, fails the base rules and scores
zero. Texts are judged whole, however long, repeated rows each for itself with equal results; ids may be
null. Windows of three words are compared by 64-bit hashes. Without any trusted document, or over
an empty table, all ratios are zero and only the base rules decide. Trusted ids that are null or
not in the table have no effect, ids listed repeatedly count once. Columns of ``docs`` may have any
name; the struct that is added is the last column, under the next free name with underscores in
front if a column has its name in any case.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward.llm.common import WORD, filtered_after, fresh, stored, words

LEAST_BITS, MOST_BITS = 14, 18
PER_BUCKET = 64
STEPS = 1024
# N-grams a bucket that the raw distribution is worth as the target's prior.
PRIOR = 4.0
# Trusted ids are sent to all tasks up to this many; more are joined by a shuffle.
SHIPPED_IDS = 4_000_000
# Mean log ratio that a document needs.
THRESHOLD = -0.1
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null")
    return good.select("doc_id").distinct()


class Ratios(NamedTuple):
    """Log ratios of all buckets in whole steps of 1 / ``STEPS``, joined by commas; none: all zero."""

    bits: int
    steps: str | None

    def total(self, hashes: Column) -> Column:
        """Sum over the words and pairs of neighbours, in steps."""
        if self.steps is None:
            return F.lit(0)
        table = F.split(F.lit(self.steps), ",").cast("array<int>")  # folded into one constant
        ratio = lambda h: F.get(table, h.bitwiseAND((1 << self.bits) - 1).cast("int"))
        return F.aggregate(
            hashes,
            # The word before, and the sum; the first word makes no pair.
            F.struct(F.lit(None).cast("long").alias("before"), F.lit(0).cast("long").alias("sum")),
            lambda a, h: F.struct(
                h.alias("before"),
                (a["sum"] + ratio(h) + F.when(a["before"].isNull(), 0).otherwise(ratio(F.xxhash64(a["before"], h))))
                .alias("sum"),
            ),
            lambda a: a["sum"],
        )


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of the trusted ones, finest buckets."""
    marked = trusted.select("doc_id", F.lit(1).alias("trusted")).distinct()
    if marked.limit(SHIPPED_IDS + 1).count() <= SHIPPED_IDS:
        marked = F.broadcast(marked)
    hashes = F.col("hs")
    pairs = F.transform(
        F.slice(hashes, 2, F.greatest(F.size("hs") - 1, F.lit(0))),
        lambda h, i: F.xxhash64(F.get(hashes, i), h),
    )
    return (
        docs.select("doc_id", words(F.col("text")).alias("ws"))
        .select("doc_id", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
        .join(marked, "doc_id", "left")
        .select("trusted", F.explode(F.concat(hashes, pairs)).alias("h"))
        .groupBy(F.col("h").bitwiseAND((1 << MOST_BITS) - 1).alias("bucket"))
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, prior: float = PRIOR) -> Ratios:
    """Log ratio of target to raw probability for each bucket; all documents are counted.

    The target starts from the raw distribution with a weight of ``prior`` n-grams a bucket, so a
    small target says little against a text.
    """
    fine = stored(bucket_counts(docs, trusted), "quality-buckets")
    sums = fine.agg(F.sum("raw"), F.sum("target")).first()
    raw_total, target_total = sums[0] or 0, sums[1] or 0
    if not target_total:
        return Ratios(LEAST_BITS, None)
    bits = min(MOST_BITS, max(LEAST_BITS, (target_total // PER_BUCKET).bit_length() - 1))
    weight = prior * (1 << bits)
    share = F.col("raw") / F.lit(float(raw_total))
    target = (F.col("target") + F.lit(weight) * share) / F.lit(target_total + weight)
    step = F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.round(F.log(target / share) * STEPS)))
    found = (
        fine.groupBy(F.col("bucket").bitwiseAND((1 << bits) - 1).alias("bucket"))
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .select("bucket", step.cast("int").alias("step"))
    )
    every = docs.sparkSession.range(1 << bits).withColumnRenamed("id", "bucket")
    rows = every.join(found, "bucket", "left").select("bucket", F.coalesce("step", F.lit(0)).alias("step"))
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "step")))  # 2^MOST_BITS at most
    return Ratios(bits, rows.agg(F.array_join(ordered["step"].cast("array<string>"), ",")).first()[0])


def literal(values: list[float]) -> Column:
    """An array that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def judged(
    docs: DataFrame, ratios: Ratios, threshold: float = THRESHOLD, out: str = "quality"
) -> DataFrame:
    """Add struct ``out``: n_words, the base counts, score, base_failed, kept."""
    out, ws, hs, ts, ps, ls, rs, ss = fresh(docs, out, "ws", "hs", "ts", "ps", "ls", "rs", "ss")
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes, n = F.col(hs), F.size(hs).cast("long")
    third = F.transform(
        F.slice(hashes, 3, F.greatest(F.size(hs) - 2, F.lit(0))),
        lambda h, i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), h),
    )
    windows = F.col(ts)
    # Only texts with an equal pair of windows need the places of theirs: equal windows are
    # neighbours once sorted by hash, and their places come back in text order.
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)

    def twice(sorted_windows: Column) -> Column:
        same = F.zip_with(
            F.slice(sorted_windows, 1, F.size(sorted_windows) - 1),
            F.slice(sorted_windows, 2, F.size(sorted_windows) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    places = F.col(ps)
    covered = F.aggregate(
        F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    lined, repeated_words, total = F.col(ls), F.col(rs), F.col(ss)
    failed = (n < MIN_WORDS) | (100 * repeated_words > MAX_REPEAT_PERCENT * n)
    # What is used more than once is a column of its own, so that it is computed once.
    return (
        docs.withColumn(ws, words(text))
        .withColumn(hs, F.transform(ws, lambda w: F.xxhash64(w)))
        .withColumn(ts, third)
        .withColumn(ps, F.when(repeated, placed))
        .withColumn(ps, F.when(F.col(ps).isNotNull(), twice(F.col(ps))))
        .withColumns({
            ls: F.when(text.contains("\n"), F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))),
            rs: F.when(places.isNull(), F.lit(0)).otherwise(covered).cast("long"),
            ss: F.when(n > 0, ratios.total(hashes) / (STEPS * (2 * n - 1))).otherwise(F.lit(0.0)),
        })
        .withColumn(
            out,
            F.struct(
                n.alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                F.when(lined.isNull(), F.lit(0))
                .otherwise(F.size(lined) - F.size(F.array_distinct(lined))).cast("long").alias("n_dup_lines"),
                repeated_words.alias("n_repeat_words"),
                total.alias("score"),
                failed.alias("base_failed"),
                (~failed & (total >= threshold)).alias("kept"),
            ),
        )
        .drop(ws, hs, ts, ps, ls, rs, ss)
    )


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, out: str = "quality") -> DataFrame:
    """Count both multinomials and judge every document."""
    return judged(docs, log_ratios(docs, trusted_ids(labels)), threshold, out)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    judged = judge(docs, labels, threshold)
    return filtered_after(judged, f"{judged.columns[-1]}.kept").select(*docs.columns)
