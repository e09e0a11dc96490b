"""Map tiles, cache keys and confidence of predictions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.functions.numbers import round_half_up

TILE_DEGREES = 0.75


def tile_of(lat: Column, lng: Column, size: float = TILE_DEGREES) -> tuple[Column, Column]:
    """Row and column of the tile that holds a point."""
    return F.floor(lat / size).cast("long"), F.floor(lng / size).cast("long")


def tile_box(row: Column, col: Column, size: float = TILE_DEGREES) -> dict[str, Column]:
    """Bounds of a tile, rounded to 1e-8 degrees."""
    return {
        "min_lat": round_half_up(row * size, 8),
        "max_lat": round_half_up((row + 1) * size, 8),
        "min_lng": round_half_up(col * size, 8),
        "max_lng": round_half_up((col + 1) * size, 8),
    }


def tile_of_box(box: dict[str, Column], size: float = TILE_DEGREES) -> tuple[Column, Column]:
    """The tile of a box's centre; what lies beyond that tile is left out."""
    return tile_of((box["min_lat"] + box["max_lat"]) / 2, (box["min_lng"] + box["max_lng"]) / 2, size)


def tile_key(row: Column, col: Column, timeout: int = 90) -> Column:
    """First 16 hex digits of the SHA-256 of row, column and timeout."""
    return F.substring(F.sha2(F.concat_ws("|", row.cast("string"), col.cast("string"), F.lit(str(timeout))), 256), 1, 16)


def box_key(box: dict[str, Column]) -> Column:
    """First 16 hex digits of the SHA-256 of the four bounds to four decimals."""
    parts = [F.format_string("%.4f", box[k]) for k in ("min_lat", "min_lng", "max_lat", "max_lng")]
    return F.substring(F.sha2(F.concat_ws(",", *parts), 256), 1, 16)


def prediction_confidence(n: Column) -> Column:
    """0.6 without predictions, 0.03 more for each, 0.9 from ten on."""
    return F.when(n.isNull() | (n <= 0), F.lit(0.6)).when(n >= 10, F.lit(0.9)).otherwise(0.6 + 0.03 * n)


def sub_boxes(box: dict[str, Column], most: float) -> Column:
    """Array of boxes, row by row, that cut a box into steps of at most ``most`` degrees."""
    count = lambda a, b: F.greatest(F.lit(1), F.ceil((box[b] - box[a] - 1e-9) / most)).cast("int")
    rows, cols = count("min_lat", "max_lat"), count("min_lng", "max_lng")
    dy, dx = (box["max_lat"] - box["min_lat"]) / rows, (box["max_lng"] - box["min_lng"]) / cols
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), rows - 1),
            lambda r: F.transform(
                F.sequence(F.lit(0), cols - 1),
                lambda c: F.struct(
                    (box["min_lat"] + r * dy).alias("min_lat"),
                    (box["min_lat"] + (r + 1) * dy).alias("max_lat"),
                    (box["min_lng"] + c * dx).alias("min_lng"),
                    (box["min_lng"] + (c + 1) * dx).alias("max_lng"),
                ),
            ),
        )
    )
