"""Matching forms as they arrive, and the notifications about them.

Each micro-batch of raw forms goes through what an upload does: the form rules, the checks, the
system columns. What can be stored is committed as a part of the side's table, and then matched
against the current table of the other side, which may be fed by streams of its own. As records
are committed before they look for matches, of two that arrive on both sides at the same time at
least one finds the other.

Every output of a batch is committed under the names of stream and batch (``sources.tables``), and
identifiers derive from the form's key and arrival time. A repeated batch therefore changes nothing,
forms that an earlier stream has stored are not stored again, and records whose matches were not
committed, because their stream died in between, are matched when a stream of the side starts.
Streams of one side that run at the same time must read different forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from homeward.config import ConfidenceConfig, MatchConfig
from homeward.functions.identifiers import point_id
from homeward.operators.knn_index import extend_index, open_index
from homeward.operators.matching import (
    COMMON, candidates_in_index, match, match_candidates, other_side,
)
from homeward.operators.notifications import outbox
from homeward.operators.records import prepare_form
from homeward.operators.uploads import upload
from homeward.schemas import BUSINESS_ID, TABLES
from homeward.sources.tables import (
    commit_part, conform, entries, not_stored, read_table, stream_name,
)


def match_arrivals(
    forms: DataFrame,
    side: str,
    root: str,
    checkpoint: str,
    config: MatchConfig,
    row_key: Column,
    arrived_at: Column,
    confidence: ConfidenceConfig = ConfidenceConfig(),
    indexes: dict[str, str] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start storing and matching a stream of raw forms of ``side``.

    ``root`` holds the two person tables, and receives the rejected forms with ``form_id`` and
    ``errors`` and the matches, which ``tables.read_arrivals`` reads. ``row_key`` is unique per form
    and ``arrived_at`` is its arrival time. ``indexes`` are folders of neighbour indexes (``knn_index``)
    by side: what is stored extends the own side's, and matches are looked for in the other side's,
    of which a batch reads the cells in reach. Without one the whole other table is searched.
    ``trigger`` is passed on, e.g. ``availableNow=True``.
    """
    spark = forms.sparkSession
    stream = stream_name(spark, checkpoint)
    folders = indexes or {}

    def commit_matches(stored: DataFrame, of_stream: str, batch_id: int) -> None:
        if side in folders:
            extend_index(stored, folders[side], f"{of_stream}-{batch_id}")
        other = folders.get(other_side(side))
        index = open_index(spark, other) if other else None
        if index is not None:
            pairs = candidates_in_index(stored, index, side, config)
            matches = match_candidates(pairs, side, config, confidence, explain=False)
        else:
            base = read_table(spark, root, other_side(side))
            matches = match(stored, base, side, config, confidence, explain=False)
        commit_part(matches.select(*COMMON), root, side, "matches", of_stream, batch_id)

    def process(batch: DataFrame, batch_id: int) -> None:
        prepared = prepare_form(batch, side, arrived_at, row_key).persist()
        done = upload(prepared, side, config, arrived_at, row_key)
        rejected = done.rejected.withColumn("form_id", point_id(side, row_key, arrived_at))
        commit_part(rejected, root, side, "rejects", stream, batch_id)
        new = conform(not_stored(done.stored, root, side), side)
        # Match what was stored: the batch is not computed again.
        stored = commit_part(new, root, side, "stored", stream, batch_id)
        prepared.unpersist()
        commit_matches(stored, stream, batch_id)

    stored, matched = (entries(spark, root, side, kind) for kind in ("stored", "matches"))
    for name, number in stored.keys() - matched.keys():
        part = stored[name, number]["path"]
        commit_matches(spark.read.schema(TABLES[side]).parquet(part), name, number)
    writer = forms.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def notify_arrivals(
    records: DataFrame,
    side: str,
    output: str,
    checkpoint: str,
    arrived_at: Column,
    within: str = "1 day",
    **trigger,
) -> StreamingQuery:
    """Start writing the outbox of a stream of records to ``output``, each notification once.

    A record that arrives again, at most ``within`` after its first arrival by ``arrived_at``, is not
    notified again: what has been sent is kept in the stream's state for that long. The recipient and
    the record's business id make a notification.
    """
    key = BUSINESS_ID[side]
    timed = records.withColumn("arrived_at", arrived_at.cast("timestamp"))
    sent = (
        outbox(timed, side, "arrived_at", key)
        .withWatermark("arrived_at", within)
        .dropDuplicatesWithinWatermark(["recipient", key])
    )
    writer = sent.writeStream.format("parquet").option("path", output)
    writer = writer.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
