"""Every query with SQL against DuckDB on the smallest tables; learners, storage and the stream."""

import duckdb
import numpy as np
import pytest

from tidemark.operators import learners
from tidemark.plans import catalog
from tidemark.sources import storage
from tidemark.streaming import scores

SF = "/root/testdata/sf0.001"
#: Queries without a row on ten series: no order statistic, too few series for an edge or a range, and none of a length near that of series 0.
EMPTY = {"series_neighbours", "null_threshold", "graph_edges", "common_range", "ts_auc_by_fold", "law_interval"}
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert len(got) or name in EMPTY
    columns = sorted(got.columns)
    got, want = (f[columns].sort_values(columns, na_position="first").reset_index(drop=True) for f in (got, want))
    for c in columns:
        if got[c].dtype.kind in "fiu":
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-4, equal_nan=True), c
        else:
            assert (got[c].fillna("") == want[c].fillna("")).all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) and got.notna().all().all()


def test_stream_answers_disorder_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 4, 3.0), ("b", 1, float("nan"))], "id string, t long, value double")
    references = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0)], "id string, mean_h double, sd_h double")
    got = scores.drained(spark, scores.scored(scores.replayed(spark, rows, 1), references)).toPandas().set_index(["id", "t"])
    assert got.loc["a", 4].late and not got.loc["a", 2].late and got.loc["b", 1].z == 0


def test_forests(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float((i * 3) % 5), int(i % 7 > 3)) for i in range(200)], "id long, a double, b double, y long")
    model = learners.boosted(rows, ["a", "b"], trees=4)
    trees, bias = learners.exported(model, ["a", "b"])
    got = learners.forest_score(catalog.Relation.of(rows), trees, bias).frame(spark).orderBy("id").toPandas()
    from pyspark.ml.functions import vector_to_array

    want = model.transform(learners._assembled(rows, ["a", "b"])).select("id", vector_to_array("rawPrediction")[1].alias("m")).orderBy("id").toPandas()
    assert np.allclose(got.margin, want.m * 2, atol=1e-9) or np.allclose(got.margin, want.m, atol=1e-9)
    assert got.p.max() <= learners.forest_bound(trees, bias)


def test_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = x @ [1.0, -2.0] + 0.5
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    model = learners.ridge_fit(rows, ["a", "b"], "y", alpha=1e-6)
    assert np.allclose(model["coefficients"], [1, -2], atol=1e-4) and model["intercept"] == pytest.approx(0.5, abs=1e-4)
    assert learners.varying(rows.selectExpr("*", "1e0 AS c"), ["a", "c"]) == ["a"]


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2)], "id long, fold int, x double")
    storage.write_cache(rows, str(tmp_path / "cache"), "h1")
    assert [r.id for r in storage.read_fold(spark, str(tmp_path / "cache"), [1], "h1").collect()] == [2]
    with pytest.raises(ValueError):
        storage.read_fold(spark, str(tmp_path / "cache"), [0], "h2")
    assert storage.one_to_one(rows, rows.select("id", "fold"), ["id", "fold"]).count() == 2
    with pytest.raises(ValueError):
        storage.one_to_one(rows, rows.filter("id = 1").select("id"), ["id"])
    with pytest.raises(ValueError):
        storage.admitted(rows, rows.filter("id = 1"))
    learners.save(spark, str(tmp_path / "model"), {"k": 1}, ["x"], {"s": 2})
    assert learners.load(spark, str(tmp_path / "model"), ["x"], {"s": 2}) == {"k": 1}
    with pytest.raises(ValueError):
        learners.load(spark, str(tmp_path / "model"), ["y"], {"s": 2})
    assert storage.manifest(spark, str(tmp_path / "cache" / "fold=0")).count() >= 1
    storage.append_ledger(rows, str(tmp_path / "ledger"))
    storage.append_ledger(rows, str(tmp_path / "ledger"))
    assert spark.read.csv(str(tmp_path / "ledger"), header=True).count() == 4


def test_cross_fit_leaves_a_fold_out(spark):
    rng = np.random.default_rng(1)
    data = [(int(k % 3), float(a), float(b), float(a - b + 0.1 * e)) for k, (a, b, e) in enumerate(rng.normal(size=(90, 3)))]
    rows = spark.createDataFrame(data, "fold long, a double, b double, y double")
    got = learners.ridge_cross_fit(rows, ["a", "b"], "y", alpha=1.0).toPandas()
    for k in range(3):
        want = learners.linear_score(rows.filter(f"fold = {k}"), learners.ridge_fit(rows.filter(f"fold <> {k}"), ["a", "b"], "y", alpha=1.0)).toPandas()
        assert np.allclose(got[got.fold == k].sort_values("y").p, want.sort_values("y").p)


def test_interaction_gains_where_there_is_one(spark):
    from tidemark.operators.factorized import interaction_gain

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, (2, 4000))
    for goal, least in (((a + b) % 3, 0.5), (a, -0.05)):
        rows = spark.createDataFrame([(int(k % 40), int(x), int(y), int(z)) for k, (x, y, z) in enumerate(zip(a, b, goal, strict=True))], "id long, a int, b int, goal int")
        got = interaction_gain(rows.filter("id < 30"), rows.filter("id >= 30"), "a", "b", "goal").toPandas()
        assert len(got) == 10 and (got.gain.mean() > least) and (least > 0 or got.gain.mean() < 0.05)
