"""Configuration documents with parents, typed keys and project folders."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import PurePosixPath

PARENT = "ParentConfig"
DEPTH = 20


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_config(path: str, read: Callable[[str], dict] = _read) -> dict:
    """A JSON document over its parents: a member that the child has replaces the parent's, objects as a whole.

    A parent is named by ParentConfig, relative to the child's file. A cycle, a chain of over 20 parents
    and a document that is not an object are errors.
    """
    chain, seen = [], set()
    at: str | None = str(path)
    while at:
        name = str(PurePosixPath(at))
        if name in seen:
            raise ValueError(f"configuration cycle at {name}")
        if len(chain) > DEPTH:
            raise ValueError("configuration chain is too deep")
        seen.add(name)
        doc = read(at)
        if not isinstance(doc, dict):
            raise ValueError(f"{name} is not an object")
        chain.append(doc)
        parent = doc.get(PARENT)
        at = _resolve(PurePosixPath(at).parent, parent) if parent else None
    out: dict = {}
    for doc in reversed(chain):
        out |= {k: v for k, v in doc.items() if k != PARENT}
    return out


def _resolve(folder: PurePosixPath, name: str) -> str:
    parts: list[str] = []
    for part in (folder / name).parts:
        if part == ".." and parts and parts[-1] not in ("..", "/"):
            parts.pop()
        elif part != ".":
            parts.append(part)
    return str(PurePosixPath(*parts))


def get(doc: dict, key: str, kind: type, default=None):
    """A typed value; an empty string disables the key, a number of the wrong kind is an error."""
    value = doc.get(key, default)
    if value is None or value == "":
        return default if value is None else None
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise TypeError(f"{key} is not of type {kind.__name__}")
    return value


def get_list(doc: dict, key: str) -> list[str]:
    """A string or an array of strings, as a list without empty ones."""
    value = doc.get(key)
    values = [value] if isinstance(value, str) else value or []
    return [v for v in values if v]


def project_folders(base: str, project: str) -> dict[str, str]:
    root = str(PurePosixPath(base) / project)
    return {"project": root} | {k: f"{root}/{k}" for k in ("snapshots", "frames", "cache", "images")}


def first_of(columns: list[str], candidates: list[str]) -> str:
    """The first candidate name that exists."""
    for c in candidates:
        if c in columns:
            return c
    raise KeyError(f"none of {candidates}")
