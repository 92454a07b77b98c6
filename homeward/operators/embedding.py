"""Embedding hook: a user's model applied in batches, one model per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import types as T

EMBEDDED, UNREADABLE, ZERO = "embedded", "unreadable", "zero vector"


def embed(
    items: DataFrame,
    tensor: str,
    shape: list[int],
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    output: str = "embedding",
    batch_size: int = 64,
    status: str = "embedding_status",
    resources: ResourceProfile | None = None,
) -> DataFrame:
    """Add unit-length embeddings of the arrays in column ``tensor``, and a status, to every item.

    ``make_model`` runs once per task and returns a function from an (n, *shape) array to an
    (n, dim) array. An item whose tensor is NULL, holds a NULL or is not of the right size is
    ``unreadable``, one for which the model gives zeros or no numbers has ``zero vector``; neither
    has an embedding. ``resources`` are what the stage of the model asks of its executors and tasks,
    such as a GPU, on clusters that allocate by profile.
    """
    size = int(np.prod(shape))
    clash = {output.lower(), status.lower()} & {c.lower() for c in items.columns}
    if clash:
        raise ValueError(f"the items already have a column {sorted(clash)[0]}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                tensors = batch.column(tensor)
                right = pc.fill_null(pc.equal(pc.list_value_length(tensors), size), False)
                values = tensors.filter(right).flatten()
                rows = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                readable = np.flatnonzero(right.to_numpy(zero_copy_only=False))
                whole_rows = ~np.isnan(rows).any(axis=1)  # a NULL number has become NaN
                readable, rows = readable[whole_rows], rows[whole_rows]
                vectors: list = [None] * batch.num_rows
                states = np.full(batch.num_rows, UNREADABLE, object)
                if len(rows):
                    raw = np.asarray(model(rows.reshape(-1, *shape).astype(np.float32)), np.float64)
                    length = np.sqrt((raw * raw).sum(axis=1))
                    usable = np.isfinite(length) & (length > 0)
                    states[readable] = np.where(usable, EMBEDDED, ZERO)
                    for i in np.flatnonzero(usable):
                        vectors[readable[i]] = (raw[i] / length[i]).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(states, pa.string())],
                    names=[*batch.schema.names, output, status],
                )

    schema = T.StructType([
        *items.schema.fields,
        T.StructField(output, T.ArrayType(T.FloatType())),
        T.StructField(status, T.StringType()),
    ])
    return items.mapInArrow(run, schema, profile=resources)
