"""Regional extracts of map data: keys, names and addresses."""

from __future__ import annotations

# Regions that have an extract of their own.
NAMES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "District of Columbia", "Florida", "Georgia",
    "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan",
    "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York",
    "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee",
    "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
)
ADDRESS = "https://download.geofabrik.de/north-america/us/{key}-latest.osm.pbf"
REGIONS = {n.lower().replace(" ", "-"): n for n in NAMES}


def resolve(key: str) -> tuple[str, str]:
    """Name and address of a region; an unknown key raises an error that lists the known ones."""
    if key not in REGIONS:
        raise KeyError(f"{key}: not one of {', '.join(sorted(REGIONS))}")
    return REGIONS[key], ADDRESS.format(key=key)
