"""Scoring parameters as files: a base for each activity, and profiles that differ from it."""

from __future__ import annotations

import json
import re
from pathlib import Path

from trailweave.functions import scoring


def merged(base: dict, change: dict) -> dict:
    """``base`` with ``change`` put in: objects merge, everything else replaces, None is ignored."""
    out = dict(base)
    for k, v in change.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def difference(base: dict, current: dict) -> dict:
    """The leaves of ``current`` that differ from ``base``."""
    out = {}
    for k, v in current.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            if inner := difference(base[k], v):
                out[k] = inner
        elif v != base.get(k):
            out[k] = v
    return out


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def config_root(start: str, name: str = "configs", parents: int = 10) -> Path:
    """The folder ``name`` in ``start`` or the nearest of its parents that has one."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][: parents + 1]:
        if (folder / name).is_dir():
            return folder / name
    raise FileNotFoundError(f"no folder {name} in {start} or {parents} of its parents")


def base(folder: str, activity: str) -> dict:
    """The file ``base/<activity>.json`` over the built-in parameters, or those alone."""
    path = Path(folder, "base", f"{activity}.json")
    built_in = scoring.defaults(activity)
    return merged(built_in, json.loads(path.read_text())) if path.exists() else built_in


def profiles(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder, "profiles").glob("*.json"))


def resolved(folder: str, activity: str, profile: str | None = None, explicit: dict | None = None) -> dict:
    """Explicit values before the profile's before the base's."""
    out = base(folder, activity)
    if profile:
        out = merged(out, json.loads(Path(folder, "profiles", f"{slug(profile)}.json").read_text()).get("params", {}))
    return merged(out, explicit or {})


def save_base(folder: str, activity: str, params: dict) -> Path:
    path = Path(folder, "base", f"{activity}.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(params, indent=2))
    return path


def save_profile(folder: str, activity: str, name: str, params: dict) -> Path:
    """Only what differs from the base is kept."""
    path = Path(folder, "profiles", f"{slug(name)}.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"name": name, "activity": activity, "params": difference(base(folder, activity), params)}, indent=2))
    return path
