from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from frostline.llm import knn, pii
from frostline.llm.queries import op7_voronoi_top_k
from tests.llm.conftest import SCHEMA, messy_rows, prose


def vectors() -> list[tuple]:
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    out = [(k, (centres[k % 5] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist(), 0) for k in range(400)]
    out += [(k, out[50][1], 1) for k in range(400, 480)]  # copies: ties
    out += [(500, None, 1), (501, [1.0, None], 1), (502, [math.nan] * 8, 1), (503, [math.inf] * 8, 1), (504, [], 1), (505, [0.0] * 8, 1), (506, [0.5] * 3, 1), (550, [3e12] * 8, 1), (None, [1.0] * 8, 1), (600, [-1.0] * 8, 1), (650, [1e7, 1.0], 1), (651, [2e7, 5.0], 1), (652, [-3e38] * 8, 1), (653, [-1e9] * 8, 1)]
    return out + out[100:101] * 3 + out[50:51] + out[651:652]


def brute(rows: list[tuple], k: int) -> dict[int, list[tuple[int, int]]]:
    """Every row a candidate, in Python's integers; rows with the query's id left out."""
    good = [(i, [math.floor(256 * x) for x in np.float32(v).tolist()]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    return {q: [(-s, i) for s, i in sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in good if i != q)[:k]] for q, x in good if q % 50 == 0}


@pytest.mark.parametrize(("block", "share"), [(7, 4), (4096, 1)])
def test_op7(spark, tmp_path, block: int, share: int, monkeypatch: pytest.MonkeyPatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "BUNDLE", 4)
    monkeypatch.setattr(knn, "ROOT_SHARE", share)
    rows = vectors()
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got: dict[int, list] = {}
    for r in sorted(op7_voronoi_top_k(spark, str(tmp_path)).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        assert r.score == (int(r.score_exact) if -(2**63) <= int(r.score_exact) < 2**63 else None)
        got[r.query_id].append((int(r.score_exact), r.vec_id))
    assert got == brute(rows, 5)


def test_only_needed_cells_are_replicated(spark) -> None:  # noqa: ANN001
    """On clustered vectors most pairs of a cell and a group of queries never meet, and the result is whole."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(k, (centres[k % 40] + 0.02 * rng.normal(size=16)).tolist(), 0) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    part = knn.taking_part(df, "vec_id", "embedding").cache()
    pivots = knn.pivots_of(part, 40_000, 16)
    summary = knn.summed_up(knn.dealt(part, pivots, 16).cache(), "vec_id % 3 = 0", pivots, 5)
    small, knn.BUNDLE = knn.BUNDLE, 50
    try:
        pairs, groups = knn.visits(summary)
    finally:
        knn.BUNDLE = small
    n_groups = len({g for _, g in groups})
    assert n_groups >= 20 and len(pairs) < 0.25 * n_groups * len(summary.held)
    got: dict[int, list] = {}
    for r in knn.top_k(df, 5, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == brute(rows, 5)


def test_top_k_of_few_and_none(spark) -> None:  # noqa: ANN001
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [0.5, 0.25]), (100, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in knn.top_k(few, 5, "vec_id % 50 = 0").collect()) == [(0, 1, 3), (0, 2, 100), (100, 1, 3), (100, 2, 0)]
    assert knn.top_k(few.limit(0), 5, "vec_id % 50 = 0").collect() == [] and knn.top_k(few.where("vec_id = 0"), 5, "true").collect() == []


def test_scores_beyond_doubles_are_exact() -> None:
    for x, y in ((2.0**22 + 1 / 256, 3.0), (1e7, 5.0), (1e30, -1e30), (1e307, 1.0)):
        a = np.array([[x, y]])
        want = sum((int(v) * 256 if abs(v) > 1e15 else math.floor(256 * v)) ** 2 for v in (x, y))
        assert int(knn.scores(a, a)[0, 0]) == want


def test_columns_of_vectors_may_be_called_anything(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(k, [float(k), 1.0], k, k, "x", 0.5, 1) for k in range(0, 150, 10)], "vec_id long, embedding array<float>, pivot int, cell int, block string, distance double, `rank` int")
    assert [(r.query_id, r.vec_id) for r in knn.top_k(df, 1, "vec_id % 50 = 0").orderBy("query_id").collect()] == [(0, 10), (50, 140), (100, 140)]


def test_pipeline(spark, empty) -> None:  # noqa: ANN001
    rows = [(r[0], r[1] + "\n" + prose("en", 200, 3000 + r[0]), *r[2:]) if r[0] is not None and 85 <= r[0] < 95 else r for r in messy_rows()]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "").cache()
        assert after.columns == docs.columns and after.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert stage(spark, empty, "").collect() == []
        if name == "language ID":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in after.collect()} <= {100, 101, 102, 105, 107, None}
            assert after.where("lang IS NULL").isEmpty()
        if name == "SimHash near-dedup":
            assert after.where("doc_id BETWEEN 60 AND 74").count() <= 3 and after.where("doc_id < 60").count() == 60
        if name == "PII surrogates":
            assert not any(x in (r.text or "") for r in after.collect() for x in ("979) 555", "jo.smith", "10.1.2.3", "Smith"))
        if name != "language ID":
            assert after.where("n_chars <> length(text)").isEmpty() or name == "SimHash near-dedup"
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").collect() == []


def test_run_equals_its_stages(spark, clean_dir: str) -> None:  # noqa: ANN001
    docs = spark.read.parquet(f"{clean_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, clean_dir).collect()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, clean_dir)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, docs.collect()))


def test_entry_survives_without_the_subpackage(tmp_path) -> None:  # noqa: ANN001
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(corpus_pipeline.__file__).parent
    for name in ("__spark_entry__.py", "frostline"):
        (shutil.copytree if (home / name).is_dir() else shutil.copy)(home / name, tmp_path / name)
    shutil.rmtree(tmp_path / "frostline/llm")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_knn_sql_agrees(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [(k, [float(k % 7) - 3, k / 10, 0.5], 0) for k in range(120)] + [(4, [1.0, 9.0, 0.5], 0)] * 2 + [(50, [-3.0, 5.0, 0.5], 1), (7, [1e7, 2.0], 0), (150, [2e7, 5.0], 0), (150, [2e7, 5.0], 0), (151, None, 0), (152, [math.nan], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert sorted(map(str, con.execute(knn.SQL).fetchall())) == sorted(str((r.query_id, r.rank, r.vec_id, r.score, r.score_exact)) for r in knn.top_k(df, 5, "vec_id % 50 = 0").collect())


def test_mark_is_no_letter() -> None:
    assert not pii.MARK.isalnum() and len(pii.MARK) == 1
