"""Street networks and loop routes on Spark; the names below are loaded when first used."""

from importlib import import_module

_WHERE = {
    "Graph": "operators.street_graph",
    "build_graph": "operators.street_graph",
    "build_stats": "operators.street_graph",
    "coverage": "operators.street_graph",
    "Network": "operators.corridors",
    "build_network": "operators.corridors",
    "network_stats": "operators.corridors",
    "build_chains": "operators.chains",
    "build_for_location": "operators.location",
    "within_box": "operators.location",
    "report_text": "operators.reports",
    "loop_routes": "operators.search",
    "route_stats": "operators.search",
    "segments": "operators.search",
    "street_features": "operators.export",
    "network_features": "operators.export",
    "route_features": "operators.export",
    "score_corridors": "functions.scoring",
    "defaults": "functions.scoring",
    "ChainOptions": "functions.compat",
    "ingest": "sources.ingest",
    "from_pbf": "sources.ingest",
    "from_overpass": "sources.ingest",
    "enriched": "sources.providers",
    "Provider": "sources.providers",
    "NetworkCache": "sources.cache",
    "ResponseCache": "sources.responses",
    "Regions": "service",
    "local_session": "session",
    "ship": "session",
}
__all__ = list(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    found = import_module(f"{__name__}.{_WHERE[name]}")
    return getattr(found, name)
