"""Index tables: dense ids, postings, exact values, quantile boundaries and bins."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline import storage


#: Ranges that ids are looked up in by a literal; bits of ids in a block of an index table.
LISTED_RANGES, BLOCK_BITS = 2000, 20


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows dealt out by ranges of the order and sorted, with the number of the range (_part) and the place
    in it (_at). Ranges come from a random sample, so write the result before reading it twice."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return out.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})


def bases(table: DataFrame) -> list[int]:
    """How many rows stand before each range of a written placed() table; the driver sees a count per range."""
    counts = {r["_part"]: r["n"] for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    return list(accumulate((counts.get(part, 0) for part in range(max(counts, default=-1) + 1)), initial=0))


def dense_ids(table: DataFrame, before: list[int], name: str = "_doc_id") -> DataFrame:
    """Ids 1, 2, ... in the order of a written placed() table. `before` has a number per range: few are written
    into the plan, many are joined as a broadcast of a row per range."""
    place = F.col("_at") + 1
    if len(before) <= LISTED_RANGES:
        return table.withColumn(name, F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), F.col("_part") + 1) + place)
    listed = table.sparkSession.createDataFrame(list(enumerate(before)), "_part int, _before long")
    return table.join(F.broadcast(listed), "_part").withColumn(name, F.col("_before") + place).drop("_before")


def range_of(number: Column, before: list[int]) -> list[Column]:
    """The range and the place in it of ids, as the table has them: what dense_ids() undoes."""
    if len(before) <= LISTED_RANGES:
        bounds = F.array(*(F.lit(b).cast("long") for b in before))
        part = F.size(F.filter(bounds, lambda b: b < number)) - 1
        return [part.cast("int"), number - F.element_at(bounds, part + 1) - 1]
    raise ValueError("too many ranges to look ids up by literals")


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """Sorted ids by keys, in blocks of so many consecutive ids, so that a common key is never one array or one task."""
    block = F.shiftright("_doc_id", BLOCK_BITS).alias("block")
    return rows.groupBy(*keys, block).agg(F.sort_array(F.collect_list("_doc_id")).alias("ids"))


def postings(staged: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, block, ids: the documents of each token."""
    parts = [staged.select(F.lit(f).alias("field"), F.explode(f"`_tok_{f}`").alias("term"), "_doc_id") for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return _gathered(out, "field", "term")


def primary(staged: DataFrame) -> DataFrame:
    """key, id: of documents with one primary key the last; null keys have no entry."""
    return staged.where(F.col("_pk").isNotNull()).groupBy(F.col("_pk").alias("key")).agg(F.max("_doc_id").alias("id"))


def values(staged: DataFrame, field: str) -> DataFrame:
    """value, block, ids of an exact-match index; nulls have none."""
    key = F.col(f"`_key_{field}`")
    return _gathered(staged.where(key.isNotNull()).select(key.alias("value"), "_doc_id"), "value")


def probabilities(bins: int) -> list[float]:
    """Inner quantiles of so many bins, rounded to hundredths."""
    return [round(k / bins, 2) for k in range(1, bins)]


def boundaries(staged: DataFrame, field: str, bins: int) -> list[float]:
    """Exact quantiles by linear interpolation. The values are sorted by ranges and written; a quantile is one or
    two of them, found by range and place, so no task and no aggregate holds them all."""
    wanted = probabilities(bins)
    value = staged.select(F.col(f"`_num_{field}`").alias("value")).where("value IS NOT NULL")
    path = storage.new_path(staged.sparkSession, "quantiles")
    table = storage.written(placed(value, [F.col("value")]), "quantiles", path)
    before = bases(table)
    n = before[-1]
    if not n or not wanted:
        storage.removed(staged.sparkSession, path)
        return []
    at = {p: p * (n - 1) for p in wanted}
    places = {}
    for rank in {int(x) for x in at.values()} | {min(int(x) + 1, n - 1) for x in at.values()}:
        part = bisect_right(before, rank) - 1
        places[part, rank - before[part]] = rank
    some = table.where(F.col("_part").isin(sorted({p for p, _ in places})) & F.col("_at").isin(sorted({k for _, k in places})))
    got = {places[r["_part"], r["_at"]]: r["value"] for r in some.collect() if (r["_part"], r["_at"]) in places}
    storage.removed(staged.sparkSession, path)
    return [got[int(x)] + (x - int(x)) * (got[min(int(x) + 1, n - 1)] - got[int(x)]) for x in at.values()]


def bin_of(value: Column, bounds: list[float]) -> Column:
    """0 for values up to the first boundary, then one more for each boundary that the value is beyond."""
    if not bounds:
        return F.when(value.isNotNull(), 0)
    return F.when(value.isNotNull(), F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < value)))
