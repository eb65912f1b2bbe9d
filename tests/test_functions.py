from __future__ import annotations

import json
import struct
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.functions import geo, textnorm, values

TEXTS = ["Привет, МИР! ёж Щука ъ", "Ελλάδα ΆΈ ς", "北京大学 学报", "हिन्दी भाषा", "ａＢ１ ١٢٣", "Ѐ Ӝ ª º ﬁ ᴀ ʰ", "שלום ﺍﻟﺴﻼﻡ", "e\u0301 \u0301", "Château de Versailles", "Straße ÆŒØŁĐÞ", "a\nb\tc", "", "Éric's café-bar 42", "ÀÉÎÕÜ ñç Ÿ", "日本 abc", "İstanbul ſ K"]


def test_slug_agrees_with_python(spark) -> None:  # noqa: ANN001
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", textnorm.slug("t").alias("s")).collect()
    assert {r.t: r.s for r in rows} == {t: textnorm.slugify(t) for t in TEXTS}
    assert textnorm.slugify("Château") == "chateau" and textnorm.slugify("a\nb") == "ab" and textnorm.slugify("Straße") == "strasse"


def test_no_word_with_letters_is_empty() -> None:
    for word, slug in (("Привет", "privet"), ("Ελλάδα", "ellada"), ("北京", "北京"), ("हिन्दी", "हिन्दी"), ("שלום", "שלום"), ("Ж", "zh"), ("日", "日")):
        assert textnorm.slugify(word) == slug and textnorm.is_token(slug)
    assert textnorm.slugify("!!!") == "" and not textnorm.is_token("a")


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_keys_and_numbers_are_in_utc_whatever_the_session(spark, zone: str) -> None:  # noqa: ANN001
    query = """SELECT timestamp_seconds(0) AS t, timestamp_ntz'2024-07-01 02:30:00' AS summer, timestamp_ntz'2024-03-10 02:30:15.5' AS gap, timestamp'1969-12-31T23:59:59.5Z' AS before,
      '2024-03-10 02:30:00' AS plain, '2024-03-10T02:30:00+01:00' AS zoned, date'1970-01-02' AS d, timestamp_seconds(1710037800) AS late"""
    want_keys = ("1970-01-01T00:00:00+00:00", "2024-07-01T02:30:00+00:00", "2024-03-10T02:30:15+00:00", "1970-01-01T00:00:00+00:00", "2024-03-10 02:30:00", "2024-03-10T02:30:00+01:00", "1970-01-02", "2024-03-10T02:30:00+00:00")
    want_times, want_days = (0.0, 1719801000.0, 1710037815.0, 0.0, 1710037800.0, 1710034200.0, 86400.0, 1710037800.0), (0.0, 19905.0, 19792.0, -1.0, None, None, 1.0, 19792.0)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql(query)
        kinds = {f.name: f.dataType for f in df.schema}
        assert tuple(df.select(*(values.key(F.col(c), kinds[c]) for c in df.columns)).first()) == want_keys
        assert tuple(df.select(*(values.number(F.col(c), kinds[c], "datetime") for c in df.columns)).first()) == want_times
        assert tuple(df.select(*(values.number(F.col(c), kinds[c], "date") for c in df.columns)).first()) == want_days
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tokens(spark) -> None:  # noqa: ANN001
    row = spark.createDataFrame([("La rue de la Paix 7 a x9",)], "t string").select(textnorm.tokens("t", ["La", "dé"]).alias("k")).first()
    assert sorted(row.k) == ["7", "paix", "rue", "x9"]


def test_keys(spark) -> None:  # noqa: ANN001
    schema = "b boolean, i int, l bigint, f double, s string, d date, t timestamp_ntz, n decimal(10,2)"
    df = spark.createDataFrame([(True, 1, -5, 2.0, "01000", date(2024, 2, 3), datetime(2024, 2, 3, 4, 5, 6, 999), None), (None, None, None, 2.5, None, None, None, None), (False, 0, 0, 1e20, "", None, None, None), (False, 0, 0, 1.5e-7, "", None, None, None)], schema)
    got = df.select(*(values.key(F.col(f.name), f.dataType).alias(f.name) for f in df.schema)).collect()
    assert tuple(got[0]) == ("true", "1", "-5", "2", "01000", "2024-02-03", "2024-02-03T04:05:06+00:00", None)
    assert got[1].f == "2.5" and got[1].s is None and got[2].f == "100000000000000000000" and got[3].f == "0.00000015"


@pytest.mark.parametrize(("text", "index", "want"), [("true", None, "true"), ("01000", None, '"01000"'), ("0", None, "0"), (" 12", None, "12"), ("1.50", None, "1.5"), ("x\"y", None, '"x\\"y"'), ("007", "range", "7"), ("2024-01-02", "date", '"2024-01-02"'), ("a]", None, '"a]"'), ("1e3", None, "1000.0")])
def test_rendered(spark, text: str, index: str | None, want: str) -> None:  # noqa: ANN001
    assert spark.createDataFrame([(text,)], "t string").select(values.rendered(F.col("t"), index).alias("r")).first().r == want


def test_numbers(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(" 3.5", "2024-01-02", "1970-01-01T00:01:00Z"), ("x", "2024-13-02", "never"), (None, None, None)], "r string, d string, t string")
    got = df.select(values.number(F.col("r"), T.StringType(), "range").alias("r"), values.number(F.col("d"), T.StringType(), "date").alias("d"), values.number(F.col("t"), T.StringType(), "datetime").alias("t")).collect()
    assert tuple(got[0]) == (3.5, 19724.0, 60.0) and tuple(got[1]) == (None, None, None) and tuple(got[2]) == (None, None, None)


def test_wkt_wkb_and_polygons(spark) -> None:  # noqa: ANN001
    geo.register(spark)
    square = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    two = "MULTIPOLYGON(((2 2,3 2,3 3,2 3,2 2)),((10 10, 11 10, 11 11, 10 11, 10 10)))"
    df = spark.sql(f"SELECT st_geomfromtext('{square}') AS a, st_geomfromtext('{two}') AS b, st_point(2.5, 48.5) AS p, st_geomfromtext(' point ( 1.5 -2 ) ') AS q")
    row = df.select(
        geo.contains(F.col("a"), 3.0, 3.0).alias("inside"), geo.contains(F.col("a"), 1.5, 1.5).alias("hole"), geo.contains(F.col("b"), 10.5, 10.5).alias("second"),
        geo.polygon_distance(F.col("a"), 1.5, 1.9).alias("edge"), F.col("p.kind").alias("kind"), geo.geojson(F.col("p")).alias("json"), geo.geojson(F.col("b")).alias("multi"), F.array(*geo.envelope(F.col("b"))).alias("box"), F.expr("st_x(q)").alias("x"), F.expr("st_ymax(b)").alias("top"),
    ).first()
    assert row.inside and not row.hole and row.second and row.kind == "POINT" and row.box == [2.0, 2.0, 11.0, 11.0] and (row.x, row.top) == (1.5, 11.0)
    assert row.edge == pytest.approx(0.1 * 111195, rel=1e-3)
    assert row.json == '{"type":"Point","coordinates":[2.5,48.5]}' and row.multi.startswith('{"type":"MultiPolygon","coordinates":[[[[2.0,2.0]')
    point = struct.pack("<BIdd", 1, 1, 2.0, 3.0)
    assert geo.from_wkb(point) == {"kind": "POINT", "parts": [[[{"x": 2.0, "y": 3.0}]]], "members": None}
    ring = struct.pack(">BIII", 0, 3, 1, 4) + b"".join(struct.pack(">dd", *v) for v in [(0, 0), (1, 0), (1, 1), (0, 0)])
    assert geo.from_wkb(ring)["kind"] == "POLYGON" and geo.from_wkb(struct.pack("<BII", 1, 6, 1) + ring)["parts"] == geo.from_wkb(ring)["parts"]
    assert geo.from_wkb(struct.pack("<BIddd", 1, 1001, 2.0, 3.0, 9.0))["parts"][0][0][0] == {"x": 2.0, "y": 3.0}


def test_collections_within_collections(spark) -> None:  # noqa: ANN001
    geo.register(spark)
    point, ring = struct.pack("<BIdd", 1, 1, 2.0, 3.0), struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)

    def collection(*members: bytes) -> bytes:
        return struct.pack("<BII", 1, 7, len(members)) + b"".join(members)

    flat, deep = collection(point, ring, point), collection(collection(collection(point), collection()), collection(ring), point)
    assert geo.from_wkb(deep) == geo.from_wkb(flat) and [m["kind"] for m in geo.from_wkb(deep)["members"]] == ["POINT", "POLYGON", "POINT"]
    assert geo.to_wkb(geo.from_wkb(deep)) == flat and geo.from_wkb(collection(collection())) == {"kind": "GEOMETRYCOLLECTION", "parts": [], "members": []}
    shown = spark.createDataFrame([(deep,)], "w binary").selectExpr("st_geomfromwkb(w) AS g").select(geo.geojson(F.col("g")).alias("g")).first().g
    assert [m["type"] for m in json.loads(shown)["geometries"]] == ["Point", "Polygon", "Point"]


def test_shapes_that_are_none(spark) -> None:  # noqa: ANN001
    geo.register(spark)
    for text in ("POINT(1)", "POLYGON(1 2)", "CIRCLE(1 2)", "POINT(1 2", ""):
        with pytest.raises(Exception, match="no well-known text"):
            spark.sql(f"SELECT st_geomfromtext('{text}') AS g").collect()
    empty = spark.sql("SELECT st_geomfromtext('MULTIPOLYGON EMPTY') AS g, st_geomfromtext(NULL) AS n").select(*geo.envelope(F.col("g")), geo.contains(F.col("g"), 0.0, 0.0), F.col("n")).first()
    assert tuple(empty) == (None, None, None, None, False, None)
    ring = ", ".join(f"{k} {k % 7}" for k in range(30_000)) + ", 0 0"
    long = spark.createDataFrame([(f"POLYGON(({ring}))",)], "w string").selectExpr("st_geomfromtext(w) AS g")
    assert long.select(F.size(F.col("g.parts")[0][0])).first()[0] == 30_001


def test_around_wraps_and_covers_poles() -> None:
    assert geo.around(0.0, 179.99, 5000)[2][1][0] == -180.0
    assert geo.around(89.99, 0.0, 50_000)[2] == [(-180.0, 180.0)]
