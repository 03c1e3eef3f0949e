"""The vector index: recall against the share of vectors read, exactness at full probes, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import vectors as V
from lodestar.operators.search import SCOPE, semantic_branch

SCHEMA = "id long, embedding array<float>"


def scoped(df):
    return df.withColumn("resource_owner", F.lit("o")).withColumn("resource_namespace", F.lit("n"))


def clustered(spark, n=3000, dim=24):
    random = np.random.default_rng(8)
    centres = random.normal(size=(40, dim)) * 3
    points = (centres[random.integers(40, size=n)] + random.normal(size=(n, dim))).astype(np.float32)
    return scoped(spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], SCHEMA))


def recall(spark, table, probes, rerank, k=10):
    """(share of the true nearest that is found, share of the vectors that is read)."""
    table = table.select("id", *SCOPE, "embedding")
    questions = table.where("id % 50 = 7").withColumnRenamed("id", "query_id")
    model = V.fit(table)
    index = V.coded(table, model, [*SCOPE, "id"])
    rows = {r.id: np.array(r.embedding, float) for r in table.collect()}
    ids = np.array(sorted(rows))
    unit = V._unit(np.stack([rows[i] for i in ids]))
    got = {}
    for r in V.approximate_nearest(table, index, questions, model, SCOPE, k, probes, rerank).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = 0
    for q, found in got.items():
        d = 1 - unit @ unit[np.searchsorted(ids, q)]
        hits += len(found & set(ids[np.lexsort((ids, d))[:k]].tolist()))
    n = questions.count()
    read = V.candidates(index, questions, model, SCOPE, probes, rerank).count() / (n * len(ids))
    return hits / (k * n), read


def test_recall_on_vectors_with_and_without_clusters(spark):
    plain = scoped(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding"))
    found, read = recall(spark, plain, probes=45, rerank=200)
    assert found >= 0.9 and read <= 0.3
    found, read = recall(spark, clustered(spark), probes=6, rerank=100)
    assert found >= 0.9 and read <= 0.1


def test_full_probes_are_exact(spark):
    table = clustered(spark, 400, 6).withColumn("resource_namespace", F.when(F.col("id") % 3 == 0, "m").otherwise("n"))
    table = table.unionByName(table.where("id < 5").withColumn("id", F.col("id") + 1000))  # repeated vectors: ties
    questions = table.where("id % 40 = 2").select(F.col("id").alias("query_id"), *SCOPE, "embedding")
    model = V.fit(table)
    index = V.coded(table, model, [*SCOPE, "id"])
    got = V.approximate_nearest(table, index, questions, model, SCOPE, 50, probes=V.CELLS, rerank=10_000)
    wanted = semantic_branch(table, questions, 10).select("query_id", "id", "semantic_distance", "sem_pos")
    assert sorted(map(tuple, got.select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def test_cells_are_split_and_odd_vectors_are_left_out(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(V, "PART_ROWS", 20)
    odd = scoped(spark.createDataFrame([(9000, None), (9001, []), (9002, [1.0]), (9003, [None] * 6), (9004, [0.0] * 6), (9005, [float("nan")] * 6)], SCHEMA))
    table = clustered(spark, 300, 6).unionByName(odd)
    model = V.fit(table, cells=4)
    V.write_model(model, spark, str(tmp_path / "model"))
    again = V.read_model(spark, str(tmp_path / "model"))
    assert (again.centres == model.centres).all() and (again.books == model.books).all()
    index = V.coded(table, again, [*SCOPE, "id"])
    assert index.count() == 301 and index.agg(F.max("part")).first()[0] > 0
    got = V.approximate_nearest(table, index, table.where("id IN (3, 9000)").withColumnRenamed("id", "query_id"), again, SCOPE, 5, probes=4).collect()
    assert len(got) == 5 and {r.query_id for r in got} == {3} and got[0].id == 3
    assert V.fit(odd.where("id = 9000")) is None


@pytest.mark.parametrize("n", [1, 2, 7])
def test_few_vectors(spark, n):
    table = clustered(spark, n, 6)
    model = V.fit(table)
    index = V.coded(table, model, [*SCOPE, "id"])
    assert V.approximate_nearest(table, index, table.withColumnRenamed("id", "query_id"), model, SCOPE, 3).count() == n * min(n, 3)
