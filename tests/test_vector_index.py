import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import vector_index, vectors
from folioforge.plans import retrieval
from folioforge.tables import table


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = centres[rng.integers(0, 12, 600)] + rng.normal(scale=0.3, size=(600, 8))
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(rows)]
    data += [(600, data[5][1]), (601, None), (602, [0.0] * 8), (603, [2 * x for x in data[7][1]])]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(4).cache()


@pytest.fixture(scope="module")
def index(points, tmp_path_factory):
    return vector_index.build(points, str(tmp_path_factory.mktemp("index")), cells=20)


def rows(df):
    return sorted((r["query_id"], r["rk"], r["vec_id"], round(r["sim"], 9)) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"least": 0.6}, {"earlier": True, "least": 0.2}])
def test_exact_search_equals_all_pairs(index, points, how):
    queries = points.where("vec_id % 5 = 0 or vec_id > 598")
    want = rows(vectors.nearest(points, queries, 4, **how))
    assert rows(vector_index.search(index, queries, 4, probes=1, **how)) == want
    assert rows(vector_index.search(index, queries, 4, probes=3, **how)) == want


def test_blocks_of_cells_and_queries(index, points, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 7)
    queries = points.where("vec_id % 3 = 0")
    assert rows(vector_index.search(index, queries, 2, probes=2)) == rows(vectors.nearest(points, queries, 2))


def test_every_vector_is_stored_and_read_back(spark, index, points):
    stored = index.points(spark)
    assert stored.count() == 602 and stored.select("id").distinct().count() == 602
    again = vector_index.load(spark, index.path)
    assert np.allclose(again.centres, index.centres) and (again.size == index.size).all() and again.size.sum() == 602
    found = stored.groupBy("cell").agg(F.max("angle").alias("r")).collect()
    assert all(abs(index.radius[r["cell"]] - r["r"]) < 1e-12 for r in found)
    queries = points.limit(3)
    assert rows(vector_index.search(again, queries, 2)) == rows(vector_index.search(index, queries, 2))


def test_recall_grows_with_probes(index, points):
    queries = points.where("vec_id % 20 = 0")
    got = {r["probes"]: (r["recall"], r["share"]) for r in vector_index.recall(index, queries, 5, [1, 4, 20]).collect()}
    assert got[1][0] <= got[4][0] <= got[20][0] == 1 and got[4][0] >= 0.9 and got[4][1] < 0.6
    assert vector_index.probes_for(index, queries, 5, 0.9) <= 4


def test_curve_is_what_searches_find(index, points, monkeypatch):
    """Each number of probes finds in fact what the curve says, and the curve searches nothing."""
    queries = points.where("vec_id % 7 = 0")
    truth = vectors.nearest(points, queries, 5).select("query_id", "vec_id")
    total = truth.count()
    want = {p: vector_index.search(index, queries, 5, p, exact=False).join(truth, ["query_id", "vec_id"]).count() / total for p in (1, 2, 5, 20)}
    monkeypatch.setattr(vector_index, "search", None)
    got = vector_index.curve(index, queries, 5)
    assert {p: got[p] for p in want} == pytest.approx(want) and got[0] == 0


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    made = vector_index.build(none, str(tmp_path / "none"))
    some = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert vector_index.search(made, some, 3).count() == 0
    one = vector_index.build(some, str(tmp_path / "one"))
    assert vector_index.search(one, some, 3).count() == 0
    assert vector_index.search(one, none, 3).count() == 0


def test_query_reaches_its_recall(spark, sf):
    best = {r["probes"]: r["recall"] for r in retrieval.v2_index_recall(spark, sf).collect()}
    assert max(best.values()) >= 0.9
    ids = table(spark, sf, "embeddings").where("vec_id % 20 = 0").count()
    assert retrieval.v1_index_search(spark, sf).select("query_id").distinct().count() == ids
