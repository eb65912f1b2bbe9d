from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from frostline.operators.filters import Bounds, Values, bound, parse
from frostline.operators.text import words
from frostline.sources.profile import Index, Profile, from_yaml


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("shape:round && weight:[1.5..9] && colour:!=[red,dark blue]", [Values("shape", ("round",)), Bounds("weight", "1.5", "9"), Values("colour", ("red", "dark blue"), True)]),
        ("a:![x, y]", [Values("a", ("x", "y"), True)]),
        ("a:!=x", [Values("a", ("x",), True)]),
        ("a:!=[x", [Values("a", ("[x",), True)]),
        ("a:[x", [Values("a", ("[x",))]),
        ("a:[..5]", [Bounds("a", None, "5")]),
        ("a:[5..]", [Bounds("a", "5", None)]),
        ("a:[..]", [Bounds("a")]),
        ("a:>=1 && b:<=2 && c:>3 && d:<4", [Bounds("a", "1"), Bounds("b", None, "2"), Bounds("c", "3"), Bounds("d", None, "4")]),
        ("nothing && && :v", [Values("", ("v",))]),
        (" a : b:c ", [Values("a", ("b:c",))]),
        ("", []),
        (None, []),
    ],
)
def test_parse(text: str | None, want: list) -> None:
    assert parse(text) == want


@given(st.text(max_size=60))
def test_any_text_parses(text: str) -> None:
    assert len(parse(text)) <= text.count("&&") + 1


@pytest.mark.parametrize(("text", "kind", "want"), [("20", "range", 20.0), ("x", "range", None), ("1_0", "range", None), ("2024-01-02", "date", 19724.0), ("02/01/2024", "date", None), ("1970-01-01T00:01:00Z", "datetime", 60.0), ("1970-01-01 00:01:00", "datetime", 60.0), ("1970-01-01T01:00:00+01:00", "datetime", 0.0), ("1970-01-01", "datetime", None), (None, "range", None)])
def test_bound(text: str | None, kind: str, want: float | None) -> None:
    assert bound(text, kind) == want


def test_stopwords_by_field() -> None:
    p = Profile("c", "", "", "id", ("id",), (Index("a", "text", ("le", "La")), Index("b", "text", ("le",))))
    assert words("Le la ÉCOLE !!!", p) == [("la", ["b"]), ("ecole", ["a", "b"]), ("", ["a", "b"])]


def test_profile() -> None:
    p = from_yaml("""
collection: ships
source: {path: ships.csv, query: "SELECT * FROM read_csv('{path}')"}
storage: {primary_key: imo, columns: [imo, flag]}
indexes:
  - {column: title, type: text, stopwords: [mv, ss]}
  - {column: flag, type: bitmap}
  - {column: berth, type: geo, resolution: 11}
  - {column: tonnage, type: range, bins: 7}
  - {column: seen, type: date_time}
""")
    assert (p.collection, p.primary_key, len(p.indexes), p.indexes[2].resolution, p.indexes[4].type, p.indexes[1].bins) == ("ships", "imo", 5, 11, "datetime", 20)
    assert p.index("title", "text").stopwords == ("mv", "ss") and p.version == "1.0"
    with pytest.raises(ValueError, match="primary key"):
        Profile("c", "", "", "id", ("name",))
    with pytest.raises(ValueError, match="one geo"):
        Profile("c", "", "", "id", ("id",), (Index("a", "geo"), Index("b", "geo")))
    with pytest.raises(ValueError, match="none of"):
        Profile("c", "", "", "id", ("id",), (Index("a", "hash"),))


@pytest.mark.parametrize("name", ["_lat", "_geom", "__distance", "_num_x", "_doc_id", "_cell"])
def test_derived_names_are_reserved(name: str) -> None:
    with pytest.raises(ValueError, match="reserved"):
        Profile("c", "", "", "id", ("id", name))
    assert Profile("c", "", "", "id", ("id", "_own", "lat"))
