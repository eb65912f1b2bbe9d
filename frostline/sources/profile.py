"""Profiles: a source, a query over it, the columns to store and the columns to index."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml

#: Names of derived columns; a stored column can't have one.
RESERVED = frozenset("_doc_id _pk _part _at _geom _lat _lon _ex _ey _ez _cell _xmin _ymin _xmax _ymax __distance _latitude _longitude _by_key _rank".split())
PREFIXES = ("_key_", "_tok_", "_num_", "_bin_")
TYPES = ("text", "bitmap", "geo", "range", "date", "datetime")


@dataclass(frozen=True)
class Index:
    column: str
    type: str
    stopwords: tuple[str, ...] = ()
    resolution: int = 8
    bins: int = 20


@dataclass(frozen=True)
class Profile:
    collection: str
    path: str
    query: str
    primary_key: str
    columns: tuple[str, ...]
    indexes: tuple[Index, ...] = ()
    version: str = "1.0"
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.primary_key not in self.columns:
            raise ValueError(f"the primary key {self.primary_key!r} must be among the stored columns")
        for i in self.indexes:
            if i.type not in TYPES:
                raise ValueError(f"index type {i.type!r} of {i.column!r} is none of {', '.join(TYPES)}")
            if i.bins < 1 or not 0 <= i.resolution <= 15:
                raise ValueError(f"index of {i.column!r}: bins from 1, resolution from 0 to 15")
        if len(self.of("geo")) > 1:
            raise ValueError("a profile has one geo index at most")
        if taken := [c for c in self.columns if c in RESERVED or c.startswith(PREFIXES)]:
            raise ValueError(f"these names are reserved: {', '.join(taken)}")

    def of(self, *types: str) -> list[Index]:
        return [i for i in self.indexes if i.type in types]

    def index(self, column: str, *types: str) -> Index | None:
        return next((i for i in self.of(*types) if i.column == column), None)


def from_dict(data: dict) -> Profile:
    indexes = []
    for i in data.get("indexes") or []:
        kind = str(i["type"]).lower()
        indexes.append(Index(i["column"], "datetime" if kind == "date_time" else kind, tuple(i.get("stopwords") or ()), int(i["resolution"]) if i.get("resolution") is not None else 8, int(i["bins"]) if i.get("bins") is not None else 20))
    return Profile(str(data["collection"]), str(data["source"]["path"]), str(data["source"]["query"]), str(data["storage"]["primary_key"]), tuple(data["storage"]["columns"]), tuple(indexes), str(data.get("version", "1.0")))


def from_yaml(text: str) -> Profile:
    return from_dict(yaml.safe_load(text))


def load(path: str) -> Profile:
    with open(path, encoding="utf-8") as f:
        return from_yaml(f.read())
