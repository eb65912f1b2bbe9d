from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from frostline import server
from frostline.operators import indexes
from frostline.plans import stage
from frostline.plans.catalog import Catalog, Collection, cleaned, pointers, publish
from frostline.plans.search import matches, search
from frostline.sources import readers
from frostline.sources.profile import Index, Profile
from frostline.streaming.reload import Watcher, follow

CSV = """id,name,category,lon,lat,price
1,Château de Versailles,A,2.3522,48.8566,10.5
2,Vieux Lyon,B,4.8357,45.7640,7
3,Pizza de la Gare,A,2.3530,48.8570,12
4,,C,,,
"""
QUERY = "SELECT id, name, category, price, CASE WHEN lat IS NOT NULL THEN st_point(lon, lat) END AS geom FROM read_csv('{path}')"


def places(path: str, **more: object) -> Profile:
    return Profile("places", path, QUERY, "id", ("id", "name", "category", "price", "geom"), (Index("name", "text", ("le", "la", "les")), Index("category", "bitmap"), Index("geom", "geo"), Index("price", "range", bins=4)), **more)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory: pytest.TempPathFactory) -> str:  # noqa: ANN001
    home = tmp_path_factory.mktemp("places")
    (home / "in.csv").write_text(CSV)
    stage.build(spark, places(str(home / "in.csv")), str(home / "out" / "places"), with_postings=True)
    return str(home / "out")


def test_search_of_a_written_collection(spark, built: str) -> None:  # noqa: ANN001
    one = Catalog(spark, [built]).collections["places"]
    assert one.staged.size == 4 and one.staged.geometry == "point"
    assert [r.id for r in one.search(q="PIZZ gare").collect()] == [3]
    assert [r.id for r in one.search(q="la").collect()] == []
    assert [r.id for r in one.search(lat="48.8566", lon="2.3522", radius="1000").collect()] == [1, 3]
    assert [r.id for r in one.search(lat=48.8566, lon=2.3522, top_n="2").collect()] == [1, 3]
    assert [r.id for r in one.search(min_lat=45, max_lat=46, min_lon=4, max_lon=5).collect()] == [2]
    assert sorted(r.id for r in one.search(filter_by="category:!=A").collect()) == [2, 4]
    assert [r.id for r in one.search(filter_by="price:[..]").orderBy("id").collect()] == [1, 2, 3]
    assert sorted(r.id for r in one.search(group_by="category", top_n=1).collect()) == [1, 2, 4]
    assert one.search(group_by="name").collect() == [] and one.search(top_n=0).collect() == [] and one.search(q="").collect() == []
    assert len(one.search(top_n="-1").collect()) == 4 and len(one.search(lat="x", lon=2, radius=5).collect()) == 4
    assert one.info() == {"text": ["name"], "bitmap": ["category"], "geo": ["geom"], "range": ["price"]}


def test_get_and_render(spark, built: str) -> None:  # noqa: ANN001
    one = Catalog(spark, [built]).collections["places"]
    assert json.loads(one.get_json("1"))["name"] == "Château de Versailles"
    assert json.loads(one.get_json("4")) == {"id": 4, "category": "C"}
    assert one.get_json("nothing") is None and one.get_json("99999999999999999999") is None
    features = json.loads(one.render(lat=48.8566, lon=2.3522, radius=500))
    assert features["type"] == "FeatureCollection" and features["features"][0]["geometry"] == {"type": "Point", "coordinates": [2.3522, 48.8566]} and features["features"][0]["properties"]["__distance"] == pytest.approx(0, abs=1)
    listed = json.loads(one.render("json", q="vieux"))
    assert listed[0]["name"] == "Vieux Lyon" and listed[0]["price"] == 7 and listed[0]["lat"] == pytest.approx(45.764, abs=1e-5)


def test_polygons(spark) -> None:  # noqa: ANN001
    rows = [(1, "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"), (2, "MULTIPOLYGON(((2 2, 3 2, 3 3, 2 3, 2 2)))"), (3, None)]
    spark.createDataFrame(rows, "id bigint, wkt string").createOrReplaceTempView("areas")
    p = Profile("areas", "", "SELECT id, st_geomfromtext(wkt) AS geom FROM areas", "id", ("id",), (Index("geom", "geo"),))
    s = stage.stage(readers.source(spark, p.query), p)
    assert s.geometry == "polygon"
    for lat, lon, want in [(0.5, 0.5, [1]), (2.5, 2.5, [2]), (1.5, 1.5, [])]:
        assert [r.id for r in search(s, lat=lat, lon=lon, radius=1000).collect()] == want
    assert [r.id for r in search(s, lat=0.5, lon=0.5).collect()] == [1]
    assert sorted(r.id for r in search(s, min_lat=0.9, min_lon=0.9, max_lat=2.1, max_lon=2.1).collect()) == [1, 2]
    with pytest.raises(ValueError, match="not both"):
        stage.geometry_kind(spark.sql("SELECT st_point(1, 2) AS _geom UNION ALL SELECT st_geomfromtext('POLYGON((0 0,1 0,1 1,0 0))')"))


def test_bitmap_and_bins(spark) -> None:  # noqa: ANN001
    spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, "C")], "id bigint, category string").createOrReplaceTempView("letters")
    p = Profile("letters", "", "SELECT * FROM letters", "id", ("id", "category"), (Index("category", "bitmap"), Index("id", "range")))
    s = stage.stage(readers.source(spark, p.query), p)
    assert {r["value"]: r["ids"] for r in indexes.values(s.rows, "category").collect()} == {"A": [1, 3], "B": [2], "C": [4]}
    assert indexes.boundaries(s.rows, "id", 2) == [2.5] and indexes.boundaries(s.rows.where("id < 0"), "id", 4) == []
    assert indexes.boundaries(s.rows, "id", 20)[4] == 1.75 and indexes.boundaries(s.rows.where("id = 3"), "id", 4) == [3.0] * 3
    assert [r[0] for r in s.rows.orderBy("id").select(indexes.bin_of(F.col("_num_id"), [2.0, 3.5])).collect()] == [0, 0, 1, 2]


def test_equal_keys_last_wins(spark) -> None:  # noqa: ANN001
    spark.createDataFrame([(7, "x"), (7, "y"), (8, "z"), (None, "n")], "id bigint, v string").createOrReplaceTempView("twice")
    p = Profile("twice", "", "SELECT * FROM twice", "id", ("id", "v"), (Index("v", "text"),))
    s = stage.stage(readers.source(spark, p.query), p)
    by_hash = s.rows.where("id = 7").orderBy(F.xxhash64(F.to_json(F.struct("id", "v")))).collect()  # equal keys go by a hash of the stored values
    assert Collection("twice", s).get(7).first().v == by_hash[-1].v and Collection("twice", s).get(1).first().v == "n"
    long = "x" * 100
    spark.createDataFrame([(7, f"{long}{k}", k) for k in range(20)], "id bigint, v string, n int").createOrReplaceTempView("long")
    p = Profile("long", "", "SELECT * FROM long", "id", ("id", "v", "n"))
    assert Collection("long", stage.stage(readers.source(spark, p.query), p)).get(7).first().n == 19  # numbers come first
    p = Profile("long", "", "SELECT * FROM long", "id", ("id", "v"))
    want = {stage.stage(readers.source(spark, f"SELECT * FROM long ORDER BY n {way}"), p).rows.orderBy(F.desc("_doc_id")).first().v for way in ("", "DESC")}
    assert len(want) == 1
    assert {r.v for r in matches(s)[0].collect()} == {"x", "y", "z", "n"}


def test_empty_source(spark) -> None:  # noqa: ANN001
    spark.createDataFrame([], "id bigint, name string").createOrReplaceTempView("none")
    p = Profile("none", "", "SELECT * FROM none", "id", ("id", "name"), (Index("name", "text"), Index("id", "range")))
    s = stage.stage(readers.source(spark, p.query), p)
    assert s.size == 0 and search(s, q="a", filter_by="id:>1").collect() == []


def test_formats(spark, tmp_path: Path) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    df.write.json(str(tmp_path / "j"))
    df.write.orc(str(tmp_path / "o"))
    df.write.parquet(str(tmp_path / "p"))
    df.write.option("header", True).option("compression", "gzip").option("sep", ";").csv(str(tmp_path / "c"))
    for call in (f"read_json_auto('{tmp_path}/j')", f"read_orc('{tmp_path}/o')", f"parquet_scan('{tmp_path}/p')", f"READ_CSV('{tmp_path}/c', delim=';', header=True)"):
        assert readers.source(spark, f"SELECT sum(id) AS n FROM {call}").first().n == 3
    assert readers.source(spark, "SELECT count(*) AS n FROM read_parquet('{path}') a JOIN read_parquet('{path}') b ON a.id = b.id", str(tmp_path / "p")).first().n == 2


def test_server_and_reload(spark, built: str, tmp_path: Path) -> None:  # noqa: ANN001
    catalog = Catalog(spark, [built])
    http = server.serve(catalog, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"

    def get(path: str) -> object:
        with urllib.request.urlopen(base + path) as r:
            return json.loads(r.read())

    assert get("/health")[0]["size"] == 4
    assert get("/places/get/2")["name"] == "Vieux Lyon"
    assert [d["id"] for d in get("/places/search?q=chateau&output=json")] == [1]
    assert get("/places/search?filter=category:A&top_n=1")["features"][0]["properties"]["category"] == "A"
    for path in ("/places/get/77", "/none/search", "/places/other"):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == 404
    http.shutdown()

    watcher, before = Watcher(catalog), catalog.collections["places"]
    assert not watcher.look()
    (tmp_path / "new.csv").write_text(CSV + "5,Neuf,A,2.4,48.9,1\n")
    stage.build(spark, places(str(tmp_path / "new.csv")), f"{built}/places")
    assert watcher.look() and catalog.health()[0]["size"] == 5
    assert before.staged.size == 4 and len(before.search().collect()) == 4


def test_broken_collections_are_left_out(spark, tmp_path: Path) -> None:  # noqa: ANN001
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "CURRENT-0000000001-missing").write_text("")
    assert Catalog(spark, [str(tmp_path), str(tmp_path / "nowhere")]).health() == []


def test_readers_always_find_a_version(spark, tmp_path: Path) -> None:  # noqa: ANN001
    """Pointers change while others read: at no time is there none, and the number never goes back."""
    home, seen, done = str(tmp_path / "c"), [], threading.Event()
    publish(spark, home, "0" * 32)

    def look() -> None:
        while not done.is_set():
            seen.append(pointers(spark, home)[-1][0])

    reader = threading.Thread(target=look)
    reader.start()
    for k in range(1, 30):
        publish(spark, home, f"{k:032x}")
        cleaned(spark, home, 2)
    done.set()
    reader.join()
    assert len(seen) > 5 and seen == sorted(seen) and [n for n, _ in pointers(spark, home)] == [29, 30]


def test_old_and_failed_versions_go(spark, tmp_path: Path) -> None:  # noqa: ANN001
    (tmp_path / "in.csv").write_text(CSV)
    home = tmp_path / "places"
    for _ in range(3):
        stage.build(spark, places(str(tmp_path / "in.csv")), str(home), keep=2)
    versions = {p.name for p in home.iterdir() if p.is_dir()}
    assert versions == {v for _, v in pointers(spark, str(home))} and len(versions) == 2
    with pytest.raises(Exception, match="nothing"):
        stage.build(spark, Profile("places", "", "SELECT id, raise_error('nothing') AS name FROM range(3)", "id", ("id", "name")), str(home))
    assert {p.name for p in home.iterdir() if p.is_dir()} == versions
    (home / ("f" * 32)).mkdir()
    assert cleaned(spark, str(home), 2) == [] and cleaned(spark, str(home), 2, age=-10) == ["f" * 32] and (home / "notes").mkdir() is None and cleaned(spark, str(home), 1, age=-10) != ["notes"]


def test_command_line(spark, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:  # noqa: ANN001
    """Build and serve as the commands do, in this session."""
    from frostline import __main__ as cli

    (tmp_path / "in.csv").write_text(CSV)
    (tmp_path / "p.yaml").write_text(f"""
collection: places
source: {{path: none.csv, query: "{QUERY}"}}
storage: {{primary_key: id, columns: [id, name, price]}}
indexes: [{{column: name, type: text}}, {{column: geom, type: geo}}, {{column: price, type: range, bins: 4}}]
""")
    cli.main(["build", "--profile", str(tmp_path / "p.yaml"), "--output", str(tmp_path / "out" / "places"), "--input", str(tmp_path / "in.csv"), "--postings", "--bins", "--keep", "1"])
    one = Catalog(spark, [str(tmp_path / "out")]).collections["places"]
    assert one.staged.size == 4 and one.staged.bounds["price"] and {r.bin: r.n for r in one.bins("price").collect() if r.bin is not None} and sum(r.n for r in one.bins("price").collect()) == 3
    assert [r.id for r in one.search(q="pizza").collect()] == [3]

    served = []

    def answer(catalog: Catalog, host: str, port: int) -> object:
        served.append((server.respond(catalog, "/places/search?lat=48.8566&lon=2.3522&top_n=1&output=json"), host, port))
        return type("Once", (), {"serve_forever": lambda self: None})()

    monkeypatch.setattr(cli.server, "serve", answer)
    cli.main(["--debug", "serve", str(tmp_path / "out"), "--http-addr", "0.0.0.0:4000"])
    (status, _, body), host, port = served[0]
    assert (status, host, port) == (200, "0.0.0.0", 4000) and [d["id"] for d in json.loads("".join(body))] == [1]


def test_nearest_is_served(spark, built: str) -> None:  # noqa: ANN001
    one = Catalog(spark, [built]).collections["places"]
    for n in (1, 2, 3, 7):
        near = one.search(lat=48.8, lon=2.3, top_n=n)
        assert [(r.id, r.__getitem__("__distance")) for r in near.collect()] == [(r.id, r.__getitem__("__distance")) for r in search(one.staged, lat=48.8, lon=2.3, top_n=n).collect()]
    assert "LessThanOrEqual(_lat" in one.search(lat=48.8566, lon=2.3522, top_n=1)._jdf.queryExecution().executedPlan().toString()


def test_postings_are_joined_once(spark, tmp_path: Path) -> None:  # noqa: ANN001
    (tmp_path / "in.csv").write_text(CSV)
    stage.build(spark, places(str(tmp_path / "in.csv")), str(tmp_path / "places"), with_postings=True)
    one = Catalog(spark, [str(tmp_path)]).collections["places"]
    plan = matches(one.staged, q="pizza gare")[0].select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "_at" in plan.split("LeftSemi")[1].split("\n")[0]
    assert [r.id for r in matches(one.staged, q="pizza gare")[0].collect()] == [3]


def test_tokens_are_derived_behind_the_exchange(spark, tmp_path: Path) -> None:  # noqa: ANN001
    rows = spark.range(50).selectExpr("id", "concat('word ', id) AS t")
    p = Profile("c", "", "", "id", ("id", "t"), (Index("t", "text"),))
    seen = []
    original = stage.storage.written
    try:
        stage.storage.written = lambda df, *a: seen.append(df._jdf.queryExecution().executedPlan().toString()) or original(df, *a)
        stage.stage(rows, p)
    finally:
        stage.storage.written = original
    exchange = seen[0].index("Exchange rangepartitioning")
    assert "_tok_t" in seen[0][:exchange] and "regexp_replace" not in seen[0][exchange:]


def test_following_a_folder(spark, tmp_path: Path) -> None:  # noqa: ANN001
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string").write.parquet(str(source))
    p = Profile("live", str(source), "SELECT * FROM read_parquet('{path}')", "id", ("id", "v"), (Index("v", "bitmap"),))
    schema = spark.read.parquet(str(source)).schema
    for expected in (2, 3):
        follow(spark, p, str(tmp_path / "live"), str(tmp_path / "mark"), schema, once=True).awaitTermination()
        assert Catalog(spark, [str(tmp_path / "live")]).health()[0]["size"] == expected
        spark.createDataFrame([(3, "c")], "id bigint, v string").write.mode("append").parquet(str(source))


def test_plans_push_down(spark, built: str) -> None:  # noqa: ANN001
    """Boxes and ranges reach the scan, only the needed columns are read, and nearest-N keeps few rows per task."""
    one = Catalog(spark, [built]).collections["places"]
    box, _ = matches(one.staged, min_lat=45, max_lat=46, min_lon=4, max_lon=5, filter_by="price:>=5")
    plan = box.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_lat" in plan and "GreaterThanOrEqual(_num_price" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "_tok_name" not in schema and "_geom" not in schema
    assert "TakeOrderedAndProject" in one.search(lat=45, lon=4, top_n=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in one.search(lat=45, lon=4, group_by="category", top_n=3)._jdf.queryExecution().executedPlan().toString()
