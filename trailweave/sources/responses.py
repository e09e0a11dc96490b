"""Saved map responses by tile: a cache that is read before anything is fetched."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

from trailweave.functions.tiles import TILE_DEGREES
from trailweave.sources import files
from trailweave.sources.overpass import query_text

ENDPOINT = "https://overpass-api.de/api/interpreter"
#: Fetches a query's response from an endpoint: ``fetch(query, endpoint) -> dict``.
Fetch = Callable[[str, str], dict]


def tile_of_box(box: dict[str, float]) -> tuple[int, int]:
    """Row and column of the tile of a box's centre."""
    return math.floor((box["min_lat"] + box["max_lat"]) / 2 / TILE_DEGREES), math.floor((box["min_lng"] + box["max_lng"]) / 2 / TILE_DEGREES)


def bounds_of_tile(row: int, col: int) -> dict[str, float]:
    edge = lambda k: math.floor(k * TILE_DEGREES * 1e8 + 0.5) / 1e8
    return {"min_lat": edge(row), "max_lat": edge(row + 1), "min_lng": edge(col), "max_lng": edge(col + 1)}


class ResponseCache:
    """``<root>/<key>.json`` for each tile and timeout."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, tile: tuple[int, int], timeout: int = 90) -> str:
        key = hashlib.sha256(f"{tile[0]}|{tile[1]}|{timeout}".encode()).hexdigest()[:16]
        return f"{self.root}/{key}.json"

    def read(self, tile: tuple[int, int], timeout: int = 90) -> dict | None:
        """The saved response; None if there is none, or an empty or broken one."""
        try:
            return json.loads(files.read_bytes(self.path(tile, timeout)))
        except (OSError, ValueError):
            return None

    def write(self, tile: tuple[int, int], response: dict, timeout: int = 90) -> str:
        files.write_bytes(path := self.path(tile, timeout), json.dumps(response).encode())
        return path

    def fetched(
        self, box: dict[str, float], fetch: Fetch, timeout: int = 90, force: bool = False, no_cache: bool = False, endpoint: str = ENDPOINT
    ) -> tuple[dict, dict[str, float]]:
        """The response for the tile of a box's centre, and the tile's bounds.

        ``force`` fetches though there is a saved one, ``no_cache`` neither reads nor saves.
        """
        tile = tile_of_box(box)
        bounds = bounds_of_tile(*tile)
        if not (force or no_cache) and (found := self.read(tile, timeout)) is not None:
            return found, bounds
        response = fetch(query_text(bounds["min_lat"], bounds["min_lng"], bounds["max_lat"], bounds["max_lng"], timeout), endpoint)
        if not no_cache:
            self.write(tile, response, timeout)
        return response, bounds
