"""The engine's own queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline import server, storage
from frostline.functions import geo, textnorm, values
from frostline.operators import indexes, sets
from frostline.plans import render
from frostline.plans.catalog import Catalog, Collection, open_collection
from frostline.plans.search import matches, nearest, search
from frostline.plans.stage import POINT, POLYGON, Staged, build, derived, stage
from frostline.sources import readers
from frostline.sources.profile import Index, Profile

STOPWORDS = ("the", "la", "de", "der")
LAT, LON = "48.8e0 + (c_custkey * 7919 % 1000) / 1e4", "2.25e0 + (c_custkey * 104729 % 1500) / 1e4"
WEST, SOUTH = "(2.25e0 + (n_nationkey % 5) * 3e-2)", "(48.8e0 + floor(n_nationkey / 5e0) * 2e-2)"
CENTRE = (48.85, 2.325)


def profile(name: str, key: str, columns: list[str], indexes_: list[Index], query: str | None = None) -> Profile:
    return Profile(name, "{path}", query or f"SELECT * FROM read_parquet('{{path}}/{name}.parquet')", key, tuple(columns), tuple(indexes_))


PROFILES = {
    "part": profile("part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], [Index("p_name", "text"), Index("p_type", "text"), Index("p_brand", "bitmap"), Index("p_size", "range"), Index("p_retailprice", "range")]),
    "orders": profile("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], [Index("o_orderpriority", "bitmap"), Index("o_orderstatus", "bitmap"), Index("o_totalprice", "range"), Index("o_orderdate", "date")]),
    "events": profile("events", "event_id", ["event_id", "ts", "user_id", "event_type", "value"], [Index("event_type", "bitmap"), Index("ts", "datetime"), Index("value", "range", bins=10)]),
    "documents": profile("documents", "doc_id", ["doc_id", "text", "lang", "source", "n_chars"], [Index("text", "text", STOPWORDS), Index("source", "text"), Index("lang", "bitmap"), Index("n_chars", "range")]),
    "labelled": profile("labelled", "doc_id", ["doc_id", "lang", "quality", "toxic"], [Index("quality", "bitmap"), Index("toxic", "range"), Index("lang", "bitmap")], "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM read_parquet('{path}/documents.parquet') d LEFT JOIN read_parquet('{path}/labels.parquet') l ON d.doc_id = l.doc_id"),
    "customer": profile("customer", "c_custkey", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"], [Index("c_name", "text"), Index("c_mktsegment", "bitmap"), Index("c_acctbal", "range"), Index("geom", "geo")], f"SELECT *, st_point({LON}, {LAT}) AS geom FROM read_parquet('{{path}}/customer.parquet')"),
    "tiles": profile("tiles", "n_nationkey", ["n_nationkey", "n_name"], [Index("n_name", "text"), Index("geom", "geo")], f"""
        SELECT n_nationkey, n_name, st_geomfromtext(concat('POLYGON((', x, ' ', y, ', ', x + 2e-2, ' ', y, ', ', x + 2e-2, ' ', y + 1e-2, ', ', x, ' ', y + 1e-2, ', ', x, ' ', y, '))')) AS geom
        FROM (SELECT *, {WEST} AS x, {SOUTH} AS y FROM read_parquet('{{path}}/nation.parquet'))"""),
    "by_customer": profile("orders", "o_custkey", ["o_custkey", "o_orderkey", "o_totalprice"], [Index("o_totalprice", "range")]),
}
KINDS = {"customer": POINT, "tiles": POLYGON}

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def rows(spark: SparkSession, sf_dir: str, name: str) -> Staged:
    """Staged without ids, which conditions don't need."""
    p = PROFILES[name]
    return Staged(derived(readers.source(spark, p.query, sf_dir), p), p, KINDS.get(name))


def staged(spark: SparkSession, sf_dir: str, name: str) -> Staged:
    p = PROFILES[name]
    return stage(readers.source(spark, p.query, sf_dir), p, KINDS.get(name))


_built: dict[tuple[str, str, str], Collection] = {}


def built(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    """The collection, built with postings and bins once per session, as readers open it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        home = f"{storage.new_path(spark, 'built')}/{name}"
        build(spark, replace(PROFILES[name], path=sf_dir, query=PROFILES[name].query.replace("{path}", sf_dir)), home, with_postings=True, with_bins=True)
        _built[key] = open_collection(spark, home)
    return _built[key]


def add(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        _queries[name] = query
        if sql is not None:
            _sql[name] = sql
        return query

    return put


def condition(name: str, table: str, columns: str, sql_where: str, sql_from: str | None = None, of_built: bool = False, **conditions: object) -> None:
    """A query for all rows that meet the conditions, over a built collection or over rows as they come."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        over = built(spark, sf, table).staged if of_built else rows(spark, sf, table)
        return matches(over, **conditions)[0].select(*(c.strip() for c in columns.split(",")))

    add(name, f"SELECT {columns} FROM {sql_from or table} WHERE {sql_where}")(query)


ORDER = "o_orderkey, o_orderstatus, o_orderpriority, o_totalprice"
LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
condition("flt_equal", "orders", ORDER, "o_orderpriority = '1-URGENT'", filter_by="o_orderpriority:1-URGENT")
condition("flt_not_equal", "orders", ORDER, "o_orderstatus <> 'F'", filter_by="o_orderstatus:!=F")
condition("flt_in", "orders", ORDER, "o_orderpriority IN ('1-URGENT', '5-LOW')", filter_by="o_orderpriority:[1-URGENT, 5-LOW]")
condition("flt_not_in", "orders", ORDER, "o_orderpriority NOT IN ('1-URGENT', '5-LOW')", filter_by="o_orderpriority:!=[1-URGENT,5-LOW]")
condition("flt_not_in_short", "orders", ORDER, "o_orderstatus NOT IN ('F', 'O')", filter_by="o_orderstatus:![F,O]")
condition("flt_null_keep", "labelled", "doc_id, lang", "quality IS DISTINCT FROM 1", LABELLED, filter_by="quality:!=1")
condition("flt_null_keep_not_in", "labelled", "doc_id, lang", "quality IS NULL OR quality NOT IN (0, 1)", LABELLED, filter_by="quality:!=[0,1]")
condition("flt_value_present", "labelled", "doc_id, lang, toxic", "toxic IS NOT NULL", LABELLED, filter_by="toxic:[..]")
condition("flt_range_closed", "part", "p_partkey, p_size, p_retailprice", "p_retailprice BETWEEN 920 AND 940.5", filter_by="p_retailprice:[920..940.5]")
condition("flt_range_open", "part", "p_partkey, p_size", "p_size <= 7", filter_by="p_size:[..7]")
condition("flt_range_open_above", "part", "p_partkey, p_size", "p_size >= 45", filter_by="p_size:[45..]")
condition("flt_ge", "orders", ORDER, "o_totalprice >= 250000", filter_by="o_totalprice:>=250000")
condition("flt_le", "orders", ORDER, "o_totalprice <= 250000", filter_by="o_totalprice:<=250000")
condition("flt_gt_inclusive", "part", "p_partkey, p_size", "p_size >= 25", filter_by="p_size:>25")
condition("flt_lt_inclusive", "part", "p_partkey, p_size", "p_size <= 25", filter_by="p_size:<25")
condition("flt_bad_bound", "part", "p_partkey, p_size", "p_size IS NOT NULL", filter_by="p_size:>=many")
condition("flt_no_range_index", "orders", "o_orderkey", "false", filter_by="o_custkey:>=5")
condition("flt_no_bitmap_index", "orders", "o_orderkey", "false", filter_by="o_custkey:5")
condition("flt_not_without_index", "orders", "o_orderkey", "true", filter_by="o_custkey:!=5")
condition("flt_date_range", "orders", "o_orderkey, o_orderdate", "o_orderdate::DATE BETWEEN DATE '1996-01-15' AND DATE '1996-06-30'", filter_by="o_orderdate:[1996-01-15..1996-06-30]")
condition("flt_datetime_range", "events", "event_id, ts, event_type", "date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'", filter_by="ts:[2024-01-03 06:00:00..2024-01-09T18:30:00Z]")
condition("flt_conjunction", "orders", ORDER, "o_orderstatus = 'O' AND o_orderpriority <> '3-MEDIUM' AND o_totalprice BETWEEN 100000 AND 200000", filter_by="o_orderstatus:O && o_orderpriority:!=3-MEDIUM && && nonsense && o_totalprice:[100000..200000]")
condition("flt_empty_and", "orders", ORDER, "false", filter_by="o_orderstatus:none such && o_orderpriority:1-URGENT")
condition("flt_unclosed_bracket", "orders", ORDER, "o_orderstatus = '[F'", filter_by="o_orderstatus:[F")

#: Slugs and tokens by DuckDB, for texts in Latin letters.
SLUG = "regexp_replace(lower(strip_accents(replace({0}, 'ß', 'ss'))), '[^a-z0-9 ]', '', 'g')"
TOKENS = f"list_filter(list_distinct(string_split({SLUG}, ' ')), lambda t: len(t) >= 2 OR regexp_matches(t, '^[0-9]'))"
STOPS = "('the', 'la', 'de', 'der')"
TOKENISED = f"(SELECT *, list_filter({TOKENS.format('text')}, lambda t: t NOT IN {STOPS}) AS tokens, {TOKENS.format('source')} AS sources FROM documents)"
PARTS = f"(SELECT *, {TOKENS.format('p_name')} AS names, {TOKENS.format('p_type')} AS types FROM part)"


def _starts(field: str, prefix: str) -> str:
    return f"len(list_filter({field}, lambda t: starts_with(t, '{prefix}'))) > 0"


def _either(prefix: str) -> str:
    return f"({_starts('tokens', prefix)} OR {_starts('sources', prefix)})"


condition("txt_prefix", "documents", "doc_id, lang", _either("erth"), TOKENISED, True, q="erth")
condition("txt_multiword", "documents", "doc_id, lang", f"{_either('be')} AND {_either('thin')}", TOKENISED, True, q="Be  thin!")
condition("txt_stopwords", "documents", "doc_id, lang", f"{_starts('sources', 'the')} AND {_either('and')}", TOKENISED, True, q="the and")
condition("txt_multifield", "documents", "doc_id, source", f"{_either('src1')} AND {_either('und')}", TOKENISED, True, q="src1 und")
condition("txt_accent", "documents", "doc_id, lang", _either("eau"), TOKENISED, True, q="ÉAU")
condition("txt_no_match", "documents", "doc_id", "false", TOKENISED, True, q="zzzzzz")
condition("txt_empty_query", "documents", "doc_id", "false", TOKENISED, True, q=" ")
condition("txt_empty_word", "documents", "doc_id", "len(tokens) > 0 OR len(sources) > 0", TOKENISED, True, q="!!!")
condition("txt_filter_combo", "documents", "doc_id, lang, n_chars", f"{_either('en')} AND lang IN ('fr', 'es') AND n_chars >= 1000", TOKENISED, True, q="en", filter_by="lang:[fr,es] && n_chars:>=1000")
condition("txt_unbuilt", "documents", "doc_id, lang", _either("thin"), TOKENISED, q="thin")
condition("txt_two_fields", "part", "p_partkey", f"({_starts('names', 'red')} OR {_starts('types', 'red')})", PARTS, q="red")


@add("txt_filter_range", f"SELECT p_partkey, p_name, p_brand, p_retailprice FROM {PARTS} WHERE ({_starts('names', 'red')} OR {_starts('types', 'red')}) AND p_retailprice >= 905 ORDER BY p_partkey LIMIT 100")
def _text_and_range(spark: SparkSession, sf: str) -> DataFrame:
    return search(staged(spark, sf, "part"), q="red", filter_by="p_retailprice:>=905").select("p_partkey", "p_name", "p_brand", "p_retailprice")


@add("txt_token_scan", f"SELECT doc_id, lang FROM {TOKENISED} WHERE {_either('erth')} AND {_either('and')}")
def _text_by_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return matches(replace(built(spark, sf, "documents").staged, postings=None), q="erth and")[0].select("doc_id", "lang")


@add("txt_postings", f"SELECT doc_id, lang FROM {TOKENISED} WHERE {_either('erth')} AND {_either('and')}")
def _text_by_postings(spark: SparkSession, sf: str) -> DataFrame:
    return matches(built(spark, sf, "documents").staged, q="erth and")[0].select("doc_id", "lang")


WORLD = ("Привет, мир", "Ελληνική Δημοκρατία", "北京大学 学报", "Щука и ёж", "हिन्दी भाषा", "Ｆｕｌｌ ١٢٣")
WORLD_QUERY = "SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORLD)) + " ELSE p_name END AS words FROM read_parquet('{path}/part.parquet')"
PROFILES["world"] = profile("world", "p_partkey", ["p_partkey", "words"], [Index("words", "text")], WORLD_QUERY)
for _name, _q, _rest in (("cyrillic", "ПРИВЕТ мир", 0), ("spelt", "shchuka", 3), ("greek", "Δημοκ", 1), ("cjk", "北京 学报", 2), ("indic", "भाषा", 4), ("digits", "full 12", 5)):
    condition(f"txt_{_name}", "world", "p_partkey", f"p_partkey % 7 = {_rest}", "part", q=_q)


@add("fn_slugify", f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def _slugs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", textnorm.slug("text").alias("slug"))


@add("idx_tokens", f"SELECT doc_id, len(tokens)::INTEGER AS n_tokens, array_to_string(list_sort(tokens), ' ') AS tokens FROM {TOKENISED}")
def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf, "documents").rows.select("doc_id", F.size("_tok_text").alias("n_tokens"), F.array_join(F.array_sort("_tok_text"), " ").alias("tokens"))


@add("idx_postings", f"SELECT term, count(*) AS n, min(id) AS first_id, max(id) AS last_id, sum(id)::BIGINT AS sum_ids FROM (SELECT unnest(tokens) AS term, id FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS id FROM {TOKENISED})) GROUP BY term")
def _postings(spark: SparkSession, sf: str) -> DataFrame:
    found = indexes.postings(staged(spark, sf, "documents").rows, ["text"])
    total = F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, b: a + b))
    return found.groupBy("term").agg(F.sum(F.size("ids")).alias("n"), F.min(F.array_min("ids")).alias("first_id"), F.max(F.array_max("ids")).alias("last_id"), total.alias("sum_ids"))


@add("idx_bitmap", "SELECT o_orderpriority AS value, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders) GROUP BY o_orderpriority")
def _bitmap(spark: SparkSession, sf: str) -> DataFrame:
    found = indexes.values(staged(spark, sf, "orders").rows, "o_orderpriority")
    return found.groupBy("value").agg(F.sum(F.size("ids")).alias("n"), F.min(F.array_min("ids")).alias("first_id"), F.max(F.array_max("ids")).alias("last_id"))


@add("idx_primary", "SELECT o_custkey::VARCHAR AS key, max(id) AS id FROM (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders) GROUP BY o_custkey")
def _primary(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.primary(staged(spark, sf, "by_customer").rows)


NUMBERED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders)"


@add("set_operations", f"SELECT 'union' AS operation, count(*) AS n, sum(id)::BIGINT AS ids FROM {NUMBERED} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT 'intersection', count(*), sum(id)::BIGINT FROM {NUMBERED} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' UNION ALL SELECT 'difference', count(*), sum(id)::BIGINT FROM {NUMBERED} WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT 'universe', count(*), sum(id)::BIGINT FROM {NUMBERED}")
def _sets(spark: SparkSession, sf: str) -> DataFrame:
    s = staged(spark, sf, "orders").rows
    by_priority, by_status = indexes.values(s, "o_orderpriority"), indexes.values(s, "o_orderstatus")
    urgent = sets.holding(by_priority, "1-URGENT")
    found = {"union": sets.union(urgent, sets.holding(by_priority, "2-HIGH")), "intersection": sets.intersection(urgent, sets.holding(by_status, "F")), "difference": sets.difference(sets.universe(s), urgent), "universe": sets.universe(s)}
    parts = [d.agg(F.count("*").alias("n"), F.sum("_doc_id").alias("ids")).select(F.lit(name).alias("operation"), "n", "ids") for name, d in found.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


QUANTILES = "(SELECT list_transform(quantile_cont(o_totalprice, [" + ", ".join(f"{p}" for p in indexes.probabilities(20)) + "]), lambda x: x) AS b FROM orders)"


@add("idx_quantiles", f"SELECT unnest(generate_series(1, 19))::INTEGER AS number, round(unnest(b), 4) AS boundary FROM {QUANTILES}")
def _quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = indexes.boundaries(rows(spark, sf, "orders").rows, "o_totalprice", 20)
    return spark.createDataFrame([(k, round(b, 4)) for k, b in enumerate(found, 1)], "number int, boundary double")


@add("idx_bins", "SELECT bin, count(*) AS n FROM (SELECT len(list_filter(b, lambda x: x < value))::INTEGER AS bin FROM events, (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM events)) GROUP BY bin")
def _bins(spark: SparkSession, sf: str) -> DataFrame:
    r = rows(spark, sf, "events").rows
    return r.select(indexes.bin_of(F.col("_num_value"), indexes.boundaries(r, "value", 10)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@add("idx_numbers", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS days FROM orders")
def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf, "orders").rows.select("o_orderkey", F.col("_num_o_orderdate").alias("days"))


#: Customers with coordinates, earth-centred floats and ids, by DuckDB.
PLACED = f"""(SELECT *, row_number() OVER (ORDER BY lat, lon, c_custkey) AS id,
  (6371000e0 * cos(radians(lat)) * cos(radians(lon)))::FLOAT AS ex, (6371000e0 * cos(radians(lat)) * sin(radians(lon)))::FLOAT AS ey, (6371000e0 * sin(radians(lat)))::FLOAT AS ez
  FROM (SELECT *, {LAT} AS lat, {LON} AS lon FROM customer))"""
CX, CY, CZ = (f"({c!r}::DOUBLE)::FLOAT" for c in geo.ecef_of(*CENTRE))
CHORD = f"(({CX} - ex) * ({CX} - ex) + ({CY} - ey) * ({CY} - ey) + ({CZ} - ez) * ({CZ} - ez))"
NEAR = f"sqrt({CHORD})::FLOAT::DOUBLE"


@add("geo_ecef", f"SELECT c_custkey, ex, ey, ez FROM {PLACED}")
def _ecef(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf, "customer").rows.select("c_custkey", F.col("_ex").alias("ex"), F.col("_ey").alias("ey"), F.col("_ez").alias("ez"))


@add("geo_latlon", f"SELECT c_custkey, round(degrees(asin(ez::DOUBLE / 6371000e0)), 6) AS lat, round(degrees(atan2(ey::DOUBLE, ex::DOUBLE)), 6) AS lon FROM {PLACED}")
def _latlon(spark: SparkSession, sf: str) -> DataFrame:
    r = rows(spark, sf, "customer").rows
    return r.select("c_custkey", F.round(geo.latitude(F.col("_ez")), 6).alias("lat"), F.round(geo.longitude(F.col("_ex"), F.col("_ey")), 6).alias("lon"))


def _with_distance(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(*columns, F.round("__distance", 3).alias("distance"))


@add("geo_radius", f"SELECT c_custkey, round({NEAR}, 3) AS distance FROM {PLACED} WHERE {CHORD} <= 2000::FLOAT * 2000::FLOAT")
def _radius(spark: SparkSession, sf: str) -> DataFrame:
    return _with_distance(matches(rows(spark, sf, "customer"), lat=CENTRE[0], lon=CENTRE[1], radius=2000)[0], "c_custkey")


@add("geo_knn", f"SELECT id, c_custkey, round({NEAR}, 3) AS distance FROM {PLACED} ORDER BY {NEAR}, id LIMIT 10")
def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _with_distance(search(staged(spark, sf, "customer"), lat=CENTRE[0], lon=CENTRE[1], top_n=10).withColumnRenamed("_doc_id", "id"), "id", "c_custkey")


@add("geo_knn_pruned", f"SELECT id, c_custkey, round({NEAR}, 3) AS distance FROM {PLACED} WHERE c_mktsegment <> 'BUILDING' ORDER BY {NEAR}, id LIMIT 20")
def _nearest_pruned(spark: SparkSession, sf: str) -> DataFrame:
    found = nearest(staged(spark, sf, "customer"), *CENTRE, 20, filter_by="c_mktsegment:!=BUILDING")
    return _with_distance(found.withColumnRenamed("_doc_id", "id"), "id", "c_custkey")


@add("geo_bbox", f"SELECT c_custkey, c_name FROM {PLACED} WHERE lat BETWEEN 48.82 AND 48.85 AND lon BETWEEN 2.3 AND 2.35")
def _box(spark: SparkSession, sf: str) -> DataFrame:
    return matches(rows(spark, sf, "customer"), min_lat=48.82, max_lat=48.85, min_lon=2.3, max_lon=2.35)[0].select("c_custkey", "c_name")


@add("geo_text_filter", f"SELECT c_custkey, c_mktsegment, round({NEAR}, 3) AS distance FROM {PLACED} WHERE starts_with(lower(c_name), 'customer') AND c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND {CHORD} <= 4000::FLOAT * 4000::FLOAT")
def _all_conditions(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = matches(rows(spark, sf, "customer"), q="customer", filter_by="c_mktsegment:BUILDING && c_acctbal:>=0", lat=str(CENTRE[0]), lon=str(CENTRE[1]), radius="4000")
    return _with_distance(found, "c_custkey", "c_mktsegment")


TILES = f"(SELECT *, {WEST} AS x, {SOUTH} AS y, {WEST} + 2e-2 AS x2, {SOUTH} + 1e-2 AS y2 FROM nation)"
CLOSEST = "greatest(x, least(x2, 2.3)) AS px, greatest(y, least(y2, 48.83)) AS py"
HAVERSINE = "2e0 * 6371008.8e0 * asin(sqrt(pow(sin((radians(py) - radians(48.83::DOUBLE)) / 2), 2) + cos(radians(py)) * cos(radians(48.83::DOUBLE)) * pow(sin(radians(px - 2.3) / 2), 2)))"


@add("poly_contains", f"SELECT n_nationkey, n_name, 0e0 AS distance FROM {TILES} WHERE 2.29 BETWEEN x AND x2 AND 48.825 BETWEEN y AND y2")
def _inside(spark: SparkSession, sf: str) -> DataFrame:
    return _with_distance(matches(rows(spark, sf, "tiles"), lat=48.825, lon=2.29)[0], "n_nationkey", "n_name")


@add("poly_radius", f"SELECT n_nationkey, round({HAVERSINE}, 3) AS distance FROM (SELECT *, {CLOSEST} FROM {TILES}) WHERE {HAVERSINE} <= 3000 AND x <= 2.3 + 3000 / (111320e0 * cos(radians(48.83::DOUBLE))) AND x2 >= 2.3 - 3000 / (111320e0 * cos(radians(48.83::DOUBLE))) AND y <= 48.83 + 3000 / 111320e0 AND y2 >= 48.83 - 3000 / 111320e0")
def _polygons_near(spark: SparkSession, sf: str) -> DataFrame:
    return _with_distance(matches(rows(spark, sf, "tiles"), lat=48.83, lon=2.3, radius=3000)[0], "n_nationkey")


@add("poly_bbox", f"SELECT n_nationkey, n_name FROM {TILES} WHERE x <= 2.33 AND x2 >= 2.275 AND y <= 48.845 AND y2 >= 48.805")
def _polygons_in_box(spark: SparkSession, sf: str) -> DataFrame:
    return matches(rows(spark, sf, "tiles"), min_lon=2.275, max_lon=2.33, min_lat=48.805, max_lat=48.845)[0].select("n_nationkey", "n_name")


CONCAVE = f"""
    SELECT n_nationkey, st_geomfromtext(concat('MULTIPOLYGON(((', x, ' ', y, ', ', x + 2e-2, ' ', y, ', ', x + 2e-2, ' ', y + 1e-2, ', ', x + 1e-2, ' ', y + 1e-2, ', ', x + 1e-2, ' ', y + 5e-3, ', ', x, ' ', y + 5e-3, ', ', x, ' ', y,
      '),(', x + 15e-3, ' ', y + 2e-3, ', ', x + 18e-3, ' ', y + 2e-3, ', ', x + 18e-3, ' ', y + 8e-3, ', ', x + 15e-3, ' ', y + 8e-3, ', ', x + 15e-3, ' ', y + 2e-3,
      ')), ((', x + 2e-3, ' ', y + 7e-3, ', ', x + 4e-3, ' ', y + 7e-3, ', ', x + 4e-3, ' ', y + 9e-3, ', ', x + 2e-3, ' ', y + 7e-3, ')))')) AS geom
    FROM (SELECT *, {WEST} AS x, {SOUTH} AS y FROM read_parquet('{{path}}/nation.parquet'))"""
#: Places in a tile: in the foot of an L, in its notch, in its hole, in its arm, in the triangle beside it, left of that.
PLACES = {"foot": (2.313, 48.822), "notch": (2.316, 48.8275), "hole": (2.326, 48.825), "arm": (2.322, 48.8275), "triangle": (2.3137, 48.828), "beside": (2.3122, 48.8288)}
_u, _v = "({0} - x)", "({1} - y)"
WITHIN = f"""({_u} BETWEEN 0 AND 2e-2 AND {_v} BETWEEN 0 AND 5e-3 OR {_u} BETWEEN 1e-2 AND 2e-2 AND {_v} BETWEEN 5e-3 AND 1e-2) AND NOT ({_u} BETWEEN 15e-3 AND 18e-3 AND {_v} BETWEEN 2e-3 AND 8e-3)
  OR {_v} BETWEEN 7e-3 AND 9e-3 AND {_u} <= 4e-3 AND {_u} - 2e-3 >= {_v} - 7e-3"""


@add("poly_concave", "SELECT n_nationkey, " + ", ".join(f"{WITHIN.format(f'{lon}::DOUBLE', f'{lat}::DOUBLE')} AS {name}" for name, (lon, lat) in PLACES.items()) + f" FROM {TILES}")
def _concave(spark: SparkSession, sf: str) -> DataFrame:
    shapes = readers.source(spark, CONCAVE, sf)
    return shapes.select("n_nationkey", *(geo.contains(F.col("geom"), lon, lat).alias(name) for name, (lon, lat) in PLACES.items()))


#: Well-known text and GeoJSON of each kind of shape, # standing for a number.
SHAPES = [
    ("POINT(# 1)", '{"type":"Point","coordinates":[#,1.0]}'),
    ("SRID=4326; LINESTRING (# 0, 1 1)", '{"type":"LineString","coordinates":[[#,0.0],[1.0,1.0]]}'),
    ("POLYGON((# 0, 4 0, 4 4, # 0),(1 1, 2 1, 2 2, 1 1))", '{"type":"Polygon","coordinates":[[[#,0.0],[4.0,0.0],[4.0,4.0],[#,0.0]],[[1.0,1.0],[2.0,1.0],[2.0,2.0],[1.0,1.0]]]}'),
    ("MULTIPOINT(# 2, 3 4)", '{"type":"MultiPoint","coordinates":[[#,2.0],[3.0,4.0]]}'),
    ("MULTIPOINT Z ((# 2 9), (3 4 9))", '{"type":"MultiPoint","coordinates":[[#,2.0],[3.0,4.0]]}'),
    ("MULTILINESTRING((# 0,1 1),(2 2,3 3,4 4))", '{"type":"MultiLineString","coordinates":[[[#,0.0],[1.0,1.0]],[[2.0,2.0],[3.0,3.0],[4.0,4.0]]]}'),
    ("MULTIPOLYGON(((# 2,3 2,3 3,# 2)),((10 10,11 10,11 11,10 10)))", '{"type":"MultiPolygon","coordinates":[[[[#,2.0],[3.0,2.0],[3.0,3.0],[#,2.0]]],[[[10.0,10.0],[11.0,10.0],[11.0,11.0],[10.0,10.0]]]]}'),
    ("GEOMETRYCOLLECTION(POINT(# 2), LINESTRING(1 1, 2 2))", '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[#,2.0]},{"type":"LineString","coordinates":[[1.0,1.0],[2.0,2.0]]}]}'),
    ("POLYGON EMPTY", '{"type":"Polygon","coordinates":[]}'),
]


def _shape(k: int, number: str) -> str:
    return " ".join(f"WHEN {i} THEN replace('{s[k]}', '#', {number})" for i, s in enumerate(SHAPES))


@add("geo_shapes", f"SELECT n_nationkey, CASE n_nationkey % {len(SHAPES)} {_shape(1, 'n_nationkey::DOUBLE::VARCHAR')} END AS shape, CASE n_nationkey % {len(SHAPES)} {_shape(1, 'n_nationkey::DOUBLE::VARCHAR')} END AS by_wkb FROM nation")
def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    found = readers.source(spark, f"SELECT n_nationkey, g, st_geomfromwkb(st_aswkb(g)) AS h FROM (SELECT n_nationkey, st_geomfromtext(CASE n_nationkey % {len(SHAPES)} {_shape(0, 'CAST(n_nationkey AS STRING)')} END) AS g FROM read_parquet('{{path}}/nation.parquet'))", sf)
    return found.select("n_nationkey", geo.geojson(F.col("g")).alias("shape"), geo.geojson(F.col("h")).alias("by_wkb"))


def _groups(order: str, where: str, n: int, source: str = PLACED) -> str:
    return f"SELECT c_mktsegment, c_custkey, distance FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {order}, id) AS k FROM (SELECT *, round({{0}}, 3) AS distance FROM {source}) WHERE {where}) WHERE k <= {n}"


@add("grp_topn", _groups("id", "true", 5).format("0e0"))
def _first_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _with_distance(search(staged(spark, sf, "customer"), group_by="c_mktsegment", top_n=5), "c_mktsegment", "c_custkey")


@add("grp_default", _groups("id", "c_acctbal >= 0", 10).format("0e0"))
def _default_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _with_distance(search(staged(spark, sf, "customer"), group_by="c_mktsegment", filter_by="c_acctbal:>=0"), "c_mktsegment", "c_custkey")


@add("grp_topn_geo", _groups(f"sqrt({CHORD}::DOUBLE)", "true", 3).format(f"sqrt({CHORD}::DOUBLE)"))
def _nearest_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _with_distance(search(staged(spark, sf, "customer"), group_by="c_mktsegment", top_n=3, lat=CENTRE[0], lon=CENTRE[1]), "c_mktsegment", "c_custkey")


@add("grp_after_filter", _groups(f"sqrt({CHORD}::DOUBLE)", f"c_acctbal >= 1000 AND {CHORD} <= 5000::FLOAT * 5000::FLOAT", 2).format(f"sqrt({CHORD}::DOUBLE)"))
def _groups_after_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _with_distance(search(staged(spark, sf, "customer"), group_by="c_mktsegment", top_n=2, filter_by="c_acctbal:>=1000", lat=CENTRE[0], lon=CENTRE[1], radius=5000), "c_mktsegment", "c_custkey")


@add("doc_order_limit", "SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def _first_documents(spark: SparkSession, sf: str) -> DataFrame:
    return search(staged(spark, sf, "orders")).select(F.col("_doc_id").alias("id"), "o_orderkey", "o_orderstatus")


@add("doc_ids", "SELECT row_number() OVER (ORDER BY lat, lon, c_custkey) AS id, c_custkey FROM " + PLACED)
def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "customer").rows.select(F.col("_doc_id").alias("id"), "c_custkey")


@add("get_by_key", "SELECT row_number, p_partkey, p_name FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS row_number, * FROM part) WHERE p_partkey = 42")
def _by_key(spark: SparkSession, sf: str) -> DataFrame:
    return Collection("part", staged(spark, sf, "part")).get("42").select(F.col("_doc_id").alias("row_number"), "p_partkey", "p_name")


@add("get_by_doc_id", "SELECT id, c_custkey FROM (SELECT *, row_number() OVER (ORDER BY 'k' || c_custkey) AS id FROM customer) WHERE id = 17")
def _by_id(spark: SparkSession, sf: str) -> DataFrame:
    p = profile("customer", "k", ["k", "c_custkey"], [], "SELECT concat('k', c_custkey) AS k, c_custkey FROM read_parquet('{path}/customer.parquet')")
    found = Collection("customer", stage(readers.source(spark, p.query, sf), p)).get(17)
    return found.select(F.col("_doc_id").alias("id"), "c_custkey")


@add("dup_key_last", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderkey DESC LIMIT 1")
def _last_of_key(spark: SparkSession, sf: str) -> DataFrame:
    least = spark.read.parquet(f"{sf}/orders.parquet").agg(F.min("o_custkey")).first()[0]
    return Collection("orders", staged(spark, sf, "by_customer")).get(least).select("o_custkey", "o_orderkey")


def passed(name: str, query: str) -> None:
    """A source query, whose SQL both engines run."""
    add(name, re.sub(r"read_parquet\('\{path\}/(\w+)\.parquet'\)", r"\1", query))(lambda spark, sf: readers.source(spark, query, sf))


def _t(name: str) -> str:
    return f"read_parquet('{{path}}/{name}.parquet')"


passed("src_join", f"SELECT c.c_custkey, n.n_name, r.r_name FROM {_t('customer')} c JOIN {_t('nation')} n ON c.c_nationkey = n.n_nationkey JOIN {_t('region')} r ON n.n_regionkey = r.r_regionkey")
passed("src_left_join", f"SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM {_t('documents')} d LEFT JOIN {_t('labels')} l ON d.doc_id = l.doc_id")
passed("src_semi_anti", f"SELECT c_custkey, 'with' AS orders FROM {_t('customer')} WHERE c_custkey IN (SELECT o_custkey FROM {_t('orders')}) UNION ALL SELECT c_custkey, 'without' AS orders FROM {_t('customer')} c WHERE NOT EXISTS (SELECT 1 FROM {_t('orders')} o WHERE o.o_custkey = c.c_custkey)")
passed("src_range_join", f"SELECT p.p_partkey, count(*) AS n FROM {_t('part')} p JOIN {_t('nation')} n ON n.n_nationkey BETWEEN p.p_size - 3 AND p.p_size GROUP BY p.p_partkey")
passed("src_window", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS r, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS before FROM {_t('orders')}")
passed("src_union", f"SELECT o_custkey AS k FROM {_t('orders')} UNION SELECT c_custkey FROM {_t('customer')}")
passed("src_intersect_except", f"(SELECT c_custkey AS k, 'both' AS part FROM {_t('customer')} INTERSECT SELECT o_custkey, 'both' FROM {_t('orders')}) UNION ALL (SELECT c_custkey AS k, 'rest' AS part FROM {_t('customer')} EXCEPT SELECT o_custkey, 'rest' FROM {_t('orders')})")
passed("src_agg", f"SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM {_t('orders')} GROUP BY o_orderpriority")
passed("src_rollup", f"SELECT coalesce(n.n_regionkey, -1) AS n_regionkey, coalesce(c.c_mktsegment, 'all') AS c_mktsegment, count(*) AS n FROM {_t('customer')} c JOIN {_t('nation')} n ON c.c_nationkey = n.n_nationkey GROUP BY ROLLUP (n.n_regionkey, c.c_mktsegment)")
passed("src_cube", f"SELECT coalesce(o_orderstatus, 'all') AS o_orderstatus, coalesce(o_orderpriority, 'all') AS o_orderpriority, count(*) AS n FROM {_t('orders')} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
passed("src_cte_case", f"WITH big AS (SELECT *, CASE WHEN o_totalprice >= 250000 THEN 'big' ELSE 'small' END AS size FROM {_t('orders')}) SELECT size, o_orderstatus, count(*) AS n FROM big GROUP BY size, o_orderstatus")
passed("src_distinct", f"SELECT DISTINCT p_brand, p_type FROM {_t('part')}")
passed("src_functions", f"SELECT p_partkey, p_name || ' ' || p_brand AS label, CAST(floor(p_retailprice) AS BIGINT) AS price, CAST(p_size AS DOUBLE) AS size, upper(p_name) AS loud, length(p_name) AS letters FROM {_t('part')}")


def _number(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE {c}::VARCHAR END"


@add("render_json", f"""SELECT id, '{{"id":' || id || ',"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '","p_type":"' || p_type || '","p_size":' || p_size || ',"p_retailprice":' || {_number('p_retailprice')} || ',"__distance":0.0}}' AS document
  FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS id FROM part) WHERE p_size = 7 ORDER BY id LIMIT 100""")
def _json(spark: SparkSession, sf: str) -> DataFrame:
    s = staged(spark, sf, "part")
    return render.json_documents(search(s, filter_by="p_size:[7..7]"), s).withColumnRenamed("_doc_id", "id")


@add("render_geojson", f"SELECT id, 'Feature' AS kind, 'Point' AS shape, round(degrees(atan2(ey::DOUBLE, ex::DOUBLE)), 6) AS lon, round(degrees(asin(ez::DOUBLE / 6371000e0)), 6) AS lat, c_custkey::VARCHAR AS key, c_name AS name, round({NEAR}, 3) AS distance FROM {PLACED} ORDER BY {NEAR}, id LIMIT 25")
def _geojson(spark: SparkSession, sf: str) -> DataFrame:
    s = staged(spark, sf, "customer")
    found = render.features(search(s, lat=CENTRE[0], lon=CENTRE[1], top_n=25), s)

    def at(path: str) -> F.Column:
        return F.get_json_object("feature", path)

    numbers = {"lon": ("$.geometry.coordinates[0]", 6), "lat": ("$.geometry.coordinates[1]", 6), "distance": ("$.properties.__distance", 3)}
    return found.select(
        F.col("_doc_id").alias("id"), at("$.type").alias("kind"), at("$.geometry.type").alias("shape"), at("$.properties.c_custkey").alias("key"), at("$.properties.c_name").alias("name"),
        *(F.round(at(p).cast("double"), n).alias(c) for c, (p, n) in numbers.items()),
    )


INFERRED = "(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN lpad(p_partkey::VARCHAR, 8, '0') WHEN 2 THEN p_partkey::VARCHAR WHEN 3 THEN p_partkey::VARCHAR || '.5' WHEN 4 THEN p_name ELSE ' ' || p_partkey::VARCHAR END AS v FROM part)"


@add("store_infer", f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN v WHEN 1 THEN '\"' || v || '\"' WHEN 2 THEN v WHEN 3 THEN v WHEN 4 THEN '\"' || v || '\"' ELSE trim(v) END AS piece FROM {INFERRED}")
def _inferred(spark: SparkSession, sf: str) -> DataFrame:
    return readers.source(spark, f"SELECT * FROM {INFERRED.replace('::VARCHAR', '::STRING').replace('FROM part', 'FROM ' + _t('part'))}", sf).select("p_partkey", values.rendered(F.col("v"), None).alias("piece"))


@add("val_keys", f"SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS time_key, {_number('floor(value)')} AS floor_key, event_id::VARCHAR AS id_key FROM events")
def _keys(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/events.parquet").withColumn("whole", F.floor("value").cast("double"))
    kinds = {f.name: f.dataType for f in d.schema}
    return d.select("event_id", *(values.key(F.col(c), kinds[c]).alias(n) for c, n in (("ts", "time_key"), ("whole", "floor_key"), ("event_id", "id_key"))))


def _asked(spark: SparkSession, sf: str, name: str, target: str) -> str:
    """The body that the server gives for a path, with a catalog of one built collection."""
    catalog = Catalog(spark, [])
    catalog.collections = {name: built(spark, sf, name)}
    status, _, body = server.respond(catalog, target)
    if status != 200:
        raise ValueError(f"{target}: {status}")
    return "".join(body)


@add("http_search", f"SELECT p_partkey, p_name, p_size FROM {PARTS} WHERE ({_starts('names', 'red')} OR {_starts('types', 'red')}) AND p_size BETWEEN 10 AND 20 ORDER BY p_partkey LIMIT 15")
def _search_over_http(spark: SparkSession, sf: str) -> DataFrame:
    found = json.loads(_asked(spark, sf, "part", "/part/search?q=Red&filter=p_size:%5B10..20%5D&top_n=15&output=json"))
    return spark.createDataFrame([(d["p_partkey"], d["p_name"], d["p_size"]) for d in found], "p_partkey long, p_name string, p_size int")


@add("http_nearest", f"SELECT c_custkey, round({NEAR}, 3) AS distance FROM {PLACED} WHERE c_mktsegment <> 'BUILDING' ORDER BY {NEAR}, id LIMIT 12")
def _nearest_over_http(spark: SparkSession, sf: str) -> DataFrame:
    found = json.loads(_asked(spark, sf, "customer", f"/customer/search?lat={CENTRE[0]}&lon={CENTRE[1]}&top_n=12&filter_by=c_mktsegment:!=BUILDING"))
    return spark.createDataFrame([(f["properties"]["c_custkey"], round(f["properties"]["__distance"], 3)) for f in found["features"]], "c_custkey long, distance double")


@add("http_get", "SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 1")
def _get_over_http(spark: SparkSession, sf: str) -> DataFrame:
    key = spark.read.parquet(f"{sf}/part.parquet").agg(F.min("p_partkey")).first()[0]
    d = json.loads(_asked(spark, sf, "part", f"/part/get/{key}"))
    return spark.createDataFrame([(d["id"], d["p_partkey"], d["p_name"])], "id long, p_partkey long, p_name string")


@add("http_health", "SELECT 'part' AS name, count(*) AS size, 5 AS n_indexes FROM part")
def _health_over_http(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(d["name"], d["size"], len(d["indexes"])) for d in json.loads(_asked(spark, sf, "part", "/health"))], "name string, size long, n_indexes int")


@add("built_box", f"SELECT c_custkey, c_name FROM {PLACED} WHERE lat BETWEEN 48.82 AND 48.85 AND lon BETWEEN 2.3 AND 2.35")
def _box_of_built(spark: SparkSession, sf: str) -> DataFrame:
    return matches(built(spark, sf, "customer").staged, min_lat=48.82, max_lat=48.85, min_lon=2.3, max_lon=2.35)[0].select("c_custkey", "c_name")


@add("built_ids", "SELECT row_number() OVER (ORDER BY lat, lon, c_custkey) AS id, c_custkey FROM " + PLACED)
def _ids_of_built(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf, "customer").staged.rows.select(F.col("_doc_id").alias("id"), "c_custkey")


@add("built_bins", "SELECT bin, count(*) AS n, round(max(value), 3) AS high FROM (SELECT value, len(list_filter(b, lambda x: x < value))::INTEGER AS bin FROM events, (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM events)) GROUP BY bin")
def _bins_of_built(spark: SparkSession, sf: str) -> DataFrame:
    events = built(spark, sf, "events")
    highest = events.staged.rows.groupBy(F.col("_bin_value").alias("bin")).agg(F.round(F.max("_num_value"), 3).alias("high"))
    return events.bins("value").select("bin", "n").join(highest, "bin")


def _copied(file_format: str, columns: str, call: str) -> Query:
    """A source query over a copy of the parts in another format, in two folders that one call lists."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        home = storage.new_path(spark, file_format)
        parts = spark.read.parquet(f"{sf}/part.parquet").selectExpr(*columns.split(", "))
        for k in range(2):
            writer = parts.where(F.col("p_partkey") % 2 == k).write
            (writer.option("header", True).option("compression", "gzip") if file_format == "csv" else writer).format(file_format).save(f"{home}/{k}")
        return readers.source(spark, f"SELECT {columns} FROM {call}(['{{path}}/0', '{{path}}/1'])", home)

    return query


for _format, _call in (("csv", "read_csv_auto"), ("json", "read_json"), ("orc", "read_orc")):
    _columns = "p_partkey, p_name, p_size, p_retailprice"
    add(f"src_{_format}", f"SELECT {_columns} FROM part")(_copied(_format, _columns, _call))


HEALTH = ("part", "orders", "events", "documents", "customer")


@add("meta_health", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS size, '{i.column}' AS field, '{i.type}' AS type FROM {t}" for t in HEALTH for i in PROFILES[t].indexes))
def _health(spark: SparkSession, sf: str) -> DataFrame:
    out = []
    for t in HEALTH:
        p = PROFILES[t]
        health = Collection(t, Staged(r := rows(spark, sf, t).rows, p, size=r.count())).health()
        out += [(health["name"], health["size"], i["field"], i["type"]) for i in health["indexes"]]
    return spark.createDataFrame(out, "name string, size long, field string, type string")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
