"""Mixing sources to target weights by fitting a budget of words from document lengths.

Per source, documents are counted by their exact length. The target is met by whole rounds over
the source, then by the same share of every length, rounded so that less than one document is over,
then by dynamic programming over all of the rest and the lengths that are left (bounded knapsack, as
many items of a length as documents remain). A source too
small for that to fit may have documents taken more or less often than the others. Which documents
of a length are taken is decided by a seeded hash.

Sources by code point, the null source last, get the weights 1, 2, 3 in turn. Targets share the
whole size of the corpus by weight, stop at ``max_rounds`` times the source, and the excess goes
to the others by weight. A document is taken ``max_rounds`` times at most, empty documents as
often as the whole rounds have it. An empty table gives an empty result. Repeated rows count as
rows of their own; rows that agree in hash and id are taken in any order, which cannot be told
apart. Null ids take part like any other. A size is the number of words, zero for a null text; a text
of any length is counted whole. The struct that is added is the last column, under the next free name
with underscores in front if a column has its name in any case.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homeward.llm.common import fresh, n_words, repeats_merged, stored

WEIGHTS = (1, 2, 3)
MAX_ROUNDS = 3
# Words that are left to dynamic programming, beside what sharing cannot give.
DP_WORDS = 1 << 16


def _shared(lengths: np.ndarray, counts: np.ndarray, budget: int, start: float) -> np.ndarray:
    """The same share of every length, words in all at most ``budget`` and less by under one document.

    Fractions of documents are carried on to the next longer length in words, from a drawn start on,
    so every stretch of lengths gives its share.
    """
    total = int((lengths * counts).sum())
    take, carried = np.zeros(len(counts), np.int64), start
    for i, (length, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        carried += length * n * budget / total
        take[i] = min(n, int(carried // length))
        carried -= int(take[i]) * length
    while int((lengths * take).sum()) > budget:  # the drawn start may have been a document too many
        take[np.flatnonzero(take)[0]] -= 1
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """Documents to take of each length (ascending, positive) so that their words come to ``budget``.

    The same share of every length is taken, and all of the rest fitted by programming. Where that
    does not come out even, ``DP_WORDS`` more are left to the programme; a budget of no more words
    is fitted by it as a whole. The closest sum below the budget wins.
    """
    total = int((lengths * counts).sum())
    budget = max(0, min(budget, total))
    best, best_sum = np.zeros(len(counts), np.int64), 0
    rng = np.random.default_rng(seed)
    for left in (0, DP_WORDS):
        if best_sum == budget:
            break
        share = max(0, budget - left)
        first = np.zeros(len(counts), np.int64)
        if share:
            first = _shared(lengths, counts, share, rng.random() * float(lengths[0]))
        take = _fit_rest(lengths, counts, first, budget - int((lengths * first).sum()), rng)
        if int((lengths * take).sum()) > best_sum:
            best, best_sum = take, int((lengths * take).sum())
    return best


def _fit_rest(
    lengths: np.ndarray, counts: np.ndarray, first: np.ndarray, goal: int, rng: np.random.Generator
) -> np.ndarray:
    """``first`` and what else comes closest to ``goal`` words, by bounded-knapsack programming.

    Lengths are tried in drawn order, so that neither short nor long documents fill up the rest.
    """
    take, left = first.copy(), counts - first
    # Sums that can be reached, with the item that reached each first; items are powers of two
    # of a length's documents, so that any number of them can be put together.
    reached = np.zeros(goal + 1, bool)
    reached[0] = True
    by = np.zeros(goal + 1, np.int64)
    items: list[tuple[int, int]] = []
    for i in rng.permutation(np.flatnonzero((left > 0) & (lengths <= goal))).tolist():
        remaining = min(int(left[i]), goal // int(lengths[i]))
        chunk = 1
        while remaining and not reached[goal]:
            n = min(chunk, remaining)
            step = n * int(lengths[i])
            new = np.flatnonzero(reached[: goal + 1 - step] & ~reached[step:]) + step
            reached[new] = True
            by[new] = len(items)
            items.append((i, n))
            remaining -= n
            chunk *= 2
        if reached[goal]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def targets(totals: DataFrame, weights: tuple[int, ...], max_rounds: int) -> DataFrame:
    """Add ``target`` to (no_source, source_name, source_size), one row per source.

    Sorted by ranges and numbered from the rows of each range, so sources may be many. The level
    at which the uncapped sources share the rest follows from sums over all of them.
    """
    ordered = stored(
        totals.orderBy("no_source", "source_name").withColumn(
            "place", F.monotonically_increasing_id()
        ),
        "mix-sources",
    )
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    before, so_far = [], 0
    for p in sorted(sizes):  # as many entries as the sort has partitions
        before.append((p, so_far))
        so_far += sizes[p]
    earlier = totals.sparkSession.createDataFrame(before, "part long, earlier long")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.col("earlier") + row, F.lit(len(weights))) + 1).cast("int"),
    )
    numbered = ordered.join(F.broadcast(earlier), part == F.col("part"))
    weighed = stored(numbered.withColumn("weight", weight).drop("place", "part", "earlier"), "mix-weights")
    level, capped = 0.0, None
    while True:
        over = F.col("source_size") * max_rounds < F.col("weight") * F.lit(level)
        sums = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, F.col("source_size") * max_rounds)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
            F.count_if(over).alias("capped"),
        ).first()
        if sums.capped == capped or not sums.weight:
            break
        capped = sums.capped
        level = ((sums.total or 0) - (sums.fixed or 0)) / sums.weight
    return weighed.withColumn(
        "target",
        F.least(F.col("source_size") * F.lit(float(max_rounds)), F.col("weight") * F.lit(level)),
    ).drop("weight")


def mix(
    docs: DataFrame,
    out: str = "mix",
    weights: tuple[int, ...] = WEIGHTS,
    max_rounds: int = MAX_ROUNDS,
    seed: int = 11,
) -> DataFrame:
    """Add struct ``out`` (size, source_size, target, copies, taken) to every document.

    Documents of a length are ranked within slices of a seeded hash, the square root of the
    table's rows in number, so that a length which a third of all documents share is no hot group.
    Equal rows that are very many are ranked as one.
    """
    out, no, name, size, cut, draw, rank, n = fresh(
        docs, out, "no_source", "source_name", "size", "cut", "draw", "rank", "n"
    )
    keys = [no, name, size, cut]
    measures = {
        no: F.col("source").isNull(),
        name: F.coalesce(F.col("source").cast("string"), F.lit("")),
        size: n_words(F.col("text")),
        draw: F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
    }
    sized = docs.withColumns(measures)
    lengths = stored(
        sized.groupBy(F.col(no).alias("no_source"), F.col(name).alias("source_name"),
                      F.col(size).alias("size"), F.shiftrightunsigned(draw, 44).alias("part"))
        .agg(F.count("*").alias("n")),
        "mix-lengths",
    )
    rows = lengths.agg(F.sum("n")).first()[0] or 0
    # Slices are ranges of the hash's upper 20 bits.
    slices = 1 << min(20, max(0, math.ceil(math.log2(max(rows, 1)) / 2)))
    to_slice = (1 << 20) // slices
    source = ["no_source", "source_name"]
    by_slice = lengths.groupBy(*source, "size", F.floor(F.col("part") / to_slice).alias("cut")).agg(
        F.sum("n").alias("n")
    )
    by_length = lengths.groupBy(*source, "size").agg(F.sum("n").alias("n"))
    aims = stored(
        targets(
            by_length.groupBy(*source).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
            weights,
            max_rounds,
        ),
        "mix-targets",
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        rounds = min(int(target // total), max_rounds) if total else 0
        full = (group["size"] > 0).to_numpy()
        lengths, counts = (group.loc[full, c].to_numpy(np.int64) for c in ("size", "n"))
        # Whole rounds and at most one copy more; where that does not fit, a freer choice.
        choices = [(rounds, more) for more in range(min(1, max_rounds - rounds), max_rounds - rounds + 1)]
        choices += [(less, max_rounds - less) for less in range(rounds - 1, -1, -1)]
        best, best_gap = (rounds, np.zeros(len(lengths), np.int64)), None
        for base, more in choices if total else ():
            budget = round(target) - base * total
            take = fit_budget(lengths, counts * more, budget, seed)
            gap = budget - int((take * lengths).sum())
            if best_gap is None or gap < best_gap:
                best, best_gap = (base, take), gap
            if not gap:
                break
        group["rounds"], group["extra"] = best[0], 0
        group.loc[full, "rounds"] += best[1] // np.maximum(counts, 1)
        group.loc[full, "extra"] = best[1] % np.maximum(counts, 1)
        return group[[*source, "size", "source_size", "target", "rounds", "extra"]]

    # A source has no more distinct lengths than the root of twice its words, so a group is small.
    quotas = by_length.join(aims, source).groupBy(*source).applyInPandas(
        fit, "no_source boolean, source_name string, size long, source_size long, target double, "
             "rounds long, extra long")  # fmt: skip
    earlier = Window.partitionBy(*source, "size").orderBy("cut").rowsBetween(
        Window.unboundedPreceding, -1)
    allowed = (
        by_slice.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(quotas, [*source, "size"])
        .select(
            F.col("no_source").alias(no), F.col("source_name").alias(name),
            F.col("size").alias(size), F.col("cut").alias(cut),
            F.struct("source_size", "target", "rounds", "earlier", "extra").alias(out),
        )
    )
    # Rows that stand for many equal ones are ranked once, by the rows before them.
    before = F.sum(n).over(
        Window.partitionBy(*keys).orderBy(draw, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        repeats_merged(docs, n)
        .withColumns(measures)
        .withColumn(cut, F.floor(F.shiftrightunsigned(draw, 44) / to_slice))
        .join(allowed, keys)
        .withColumn(rank, F.coalesce(before, F.lit(0)))
        .withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    )
    copies = F.col(f"{out}.rounds") + (
        F.col(rank) + F.col(n) + F.col(f"{out}.earlier") <= F.col(f"{out}.extra")
    ).cast("long")
    return placed.withColumn(
        out,
        F.struct(
            F.col(size).alias("size"),
            F.col(f"{out}.source_size").alias("source_size"),
            F.col(f"{out}.target").alias("target"),
            copies.alias("copies"),
            (copies * F.col(size)).alias("taken"),
        ),
    ).select(*docs.columns, out)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    mixed = mix(docs, **options)
    (one,) = fresh(mixed, "copy")
    return (
        mixed.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(f"{mixed.columns[-1]}.copies").cast("int"))))
        .select(*docs.columns)
    )
