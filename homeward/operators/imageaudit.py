"""Pixel statistics of image files decoded by Spark's image source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from homeward.operators.vision import MIN_SHARPNESS

SCHEMA = (
    "origin string, width int, height int, channels int, size_bytes long, brightness double, "
    "contrast double, sharpness double, is_blurry boolean, thumbnail array<int>, error string"
)

_ARROW = pa.schema([
    ("origin", pa.string()),
    ("width", pa.int32()),
    ("height", pa.int32()),
    ("channels", pa.int32()),
    ("size_bytes", pa.int64()),
    ("brightness", pa.float64()),
    ("contrast", pa.float64()),
    ("sharpness", pa.float64()),
    ("is_blurry", pa.bool_()),
    ("thumbnail", pa.list_(pa.int32())),
    ("error", pa.string()),
])

UNREADABLE = "image could not be decoded"

# Gray weights of blue, green and red in 1/16384, and the bicubic coefficient.
GRAY_WEIGHTS = (1868, 9617, 4899)
CUBIC = -0.75


def gray_image(data, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    weighted = pixels[:, :, :3].astype(np.int64) @ np.array(GRAY_WEIGHTS)
    return ((weighted + 8192) >> 14).astype(np.uint8)


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, borders mirrored."""
    p = np.pad(gray.astype(np.float64), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    centre = p[1:-1, 1:-1]
    around = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]
    return float((around - 4 * centre).var())


def _cubic_weights(size: int, target: int) -> np.ndarray:
    """(target, size) interpolation matrix of bicubic resizing, borders repeated."""
    a = CUBIC
    weights = np.zeros((target, size))
    for i in range(target):
        centre = (i + 0.5) * size / target - 0.5
        first = int(np.floor(centre)) - 1
        for tap in range(first, first + 4):
            d = abs(centre - tap)
            near = (a + 2) * d**3 - (a + 3) * d**2 + 1
            far = a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
            weights[i, min(max(tap, 0), size - 1)] += near if d <= 1 else far if d < 2 else 0.0
    return weights


def thumbnail(gray: np.ndarray, size: int = 8) -> np.ndarray:
    rows = _cubic_weights(gray.shape[0], size)
    columns = _cubic_weights(gray.shape[1], size)
    return np.clip(np.rint(rows @ gray.astype(np.float64) @ columns.T), 0, 255).astype(np.int32)


def _measure(origin: str, data, height: int, width: int, channels: int) -> dict:
    sound = height is not None and height > 0 and data is not None
    if not sound or len(data) != height * width * channels:
        return {"origin": origin, "error": UNREADABLE}
    gray = gray_image(data, height, width, channels)
    sharpness = laplacian_variance(gray)
    return {
        "origin": origin,
        "width": width,
        "height": height,
        "channels": channels,
        "size_bytes": len(data),
        "brightness": float(gray.mean()),
        "contrast": float(gray.std()),
        "sharpness": sharpness,
        "is_blurry": sharpness < MIN_SHARPNESS,
        "thumbnail": thumbnail(gray).ravel().tolist(),
    }


def image_audit(images: DataFrame) -> DataFrame:
    """Size, brightness, contrast, sharpness and 8x8 thumbnail of every image.

    ``images`` has the ``image`` column of ``spark.read.format('image')``. An image that could not
    be decoded, or whose bytes do not fit its size, keeps its row with ``error`` and NULL figures.
    The hash for duplicate search is ``vision.average_hash`` of the thumbnail.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image = batch.column("image")
            small = [image.field(n).to_pylist() for n in ("origin", "height", "width", "nChannels")]
            rows = []
            for data, origin, height, width, channels in zip(image.field("data"), *small):
                view = memoryview(data.as_buffer()) if data.is_valid else None  # not copied
                rows.append(_measure(origin, view, height, width, channels))
            yield from pa.Table.from_pylist(rows, schema=_ARROW).to_batches()

    return images.select("image").mapInArrow(measure, SCHEMA)
