from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallybrook.operators import model, nodetable, treesplits
from tallybrook.plans import registry
from tallybrook.sources import payments as source

#: Walks every row down every tree, a level a step.
WALK = """
WITH RECURSIVE walk AS (
  SELECT transaction_id, features, tree, node FROM rows, (SELECT DISTINCT tree, 0 AS node FROM nodes)
  UNION ALL
  SELECT transaction_id, features, tree,
         CASE WHEN features[feature + 1] <= threshold THEN left_child ELSE right_child END
  FROM walk JOIN nodes USING (tree, node) WHERE left_child >= 0
)
SELECT transaction_id, AVG(share) AS score
FROM walk JOIN nodes USING (tree, node) WHERE left_child < 0 GROUP BY transaction_id
"""


@pytest.fixture(scope="module", autouse=True)
def small_forest():
    patch = pytest.MonkeyPatch()
    patch.setattr(model, "TREES", 7)
    patch.setattr(model, "DEPTH", 6)
    yield
    patch.undo()


def test_forest_and_its_nodes_and_sql_over_them_agree(spark, sf_dir, folder):
    rows = source.payments(spark, sf_dir)
    fitted = model.fit_model(rows)
    fitted.save(f"{folder}/model")
    loaded = model.load_model(spark, f"{folder}/model")
    nodes = spark.read.parquet(f"{folder}/model/nodes")
    assert nodes.columns == nodetable.NODE_COLUMNS
    walked = {r.transaction_id: r.ml_score for r in model.score_from_nodes(rows, loaded, nodes).collect()}
    served = {r.transaction_id: r.ml_score for r in model.score_with_model(rows, loaded).collect()}
    features = F.array(*[F.col(c).cast("double") for c in model.FEATURES]).alias("features")
    loaded.inputs(rows).select("transaction_id", features).write.parquet(f"{folder}/rows")
    with duckdb.connect() as connection:
        for name, place in (("rows", "rows"), ("nodes", "model/nodes")):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{place}/*.parquet'")
        by_sql = dict(connection.execute(WALK).fetchall())
    assert len(walked) == rows.count() and len(set(walked.values())) > 20
    assert set(walked) == set(served) == set(by_sql)
    for key, score in walked.items():
        assert score == pytest.approx(served[key], abs=1.01e-4)
        assert score == pytest.approx(by_sql[key], abs=0.51e-4)


def test_walking_shuffles_no_row_and_starts_no_python(spark, sf_dir, folder):
    rows = source.payments(spark, sf_dir)
    nodes = spark.createDataFrame([(0, 0, 0, 5.0, -1, -1, 0.5)], NODES)
    features = F.array(F.col("amount_egp").cast("double"))
    frame = nodetable.with_trees(rows, nodes).select(nodetable.mean_share(F.col("_trees"), features, 3))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    assert {r[0] for r in frame.distinct().collect()} == {0.5}


NODES = "tree int, node int, feature int, threshold double, left_child int, right_child int, share double"


def test_ties_go_left_and_missing_values_right(spark):
    nodes = [
        (0, 0, 1, 2.0, 1, 2, 0.5), (0, 1, -1, None, -1, -1, 0.25), (0, 2, -1, None, -1, -1, 1.0),
        (3, 0, -1, None, -1, -1, None),
    ]
    nodes = spark.createDataFrame(nodes, NODES).repartition(3)
    rows = [(9.0, 2.0), (9.0, 2.5), (9.0, None), (None, 1.0), (0.0, float("nan"))]
    table = spark.createDataFrame(rows, "a double, b double")
    score = nodetable.mean_share(F.col("_trees"), F.array("a", "b"), 1)
    got = [r[0] for r in nodetable.with_trees(table, nodes).select(score).collect()]
    assert got == [0.125, 0.5, 0.5, 0.125, 0.5]


def test_forest_in_batches_finds_the_same_and_rows_carry_no_table(spark):
    rng = random.Random(3)
    nodes = [
        (0, 0, 1, 2.0, 1, 2, 0.5), (0, 1, -1, None, -1, -1, 0.25), (0, 2, 0, 0.0, 3, 4, 1.0),
        (0, 3, -1, None, -1, -1, 0.125), (0, 4, -1, None, -1, -1, None), (3, 0, -1, None, -1, -1, None),
        (5, 0, 0, 1.0, 1, 2, 0.5), (5, 1, -1, None, -1, -1, 1.0), (5, 2, -1, None, -1, -1, 0.0),
    ]
    nodes = spark.createDataFrame(nodes, NODES).repartition(3)
    values = [None, float("nan"), -1.0, 0.0, 1.0, 2.0, 2.5]
    rows = [(rng.choice(values), rng.choice(values)) for _ in range(200)]
    table = spark.createDataFrame(rows, "a double, b double").repartition(5)
    walked = table.select("a", "b", nodetable.mean_share_of_forest(nodes, F.array("a", "b"), 2).alias("s"))
    plan = walked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "subquery" not in plan
    score = nodetable.mean_share(F.col("_trees"), F.array("a", "b"), 2)
    want = nodetable.with_trees(table, nodes).select("a", "b", score.alias("s"))
    assert sorted(map(str, walked.collect())) == sorted(map(str, want.collect()))
    none = nodetable.mean_share_of_forest(spark.createDataFrame([], NODES), F.array("a", "b"), 2)
    assert {r[0] for r in table.select(none).collect()} == {None}
    assert table.where("a < -9").select(nodetable.mean_share_of_forest(nodes, F.array("a", "b"), 2)).collect() == []


def test_scoring_from_nodes_copies_the_table_with_no_row(spark, sf_dir, folder):
    rows = source.payments(spark, sf_dir).limit(300)
    model.fit_model(rows).save(f"{folder}/model")
    nodes = spark.read.parquet(f"{folder}/model/nodes")
    scored = model.score_from_nodes(rows, model.load_model(spark, f"{folder}/model"), nodes)
    assert "_trees" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_no_tree_gives_no_score(spark):
    rows = nodetable.with_trees(spark.range(1), spark.createDataFrame([], NODES))
    score = nodetable.mean_share(F.col("_trees"), F.array(F.lit(1.0)), 2)
    assert rows.select(score).first()[0] is None


def test_grown_tree_holds_the_share_of_every_node(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.randrange(4)) for _ in range(800)]
    rows = [(x, y, int(rng.random() < (0.7 if x > 5 else 0.2 if y == 1 else 0.05))) for x, y in rows]
    table = spark.createDataFrame(rows, "x int, y int, label int").repartition(4)
    splits = treesplits.first_levels(table, ["x", "y"], 3).persist()
    nodes = {r.path: r for r in treesplits.grown_tree(table, ["x", "y"], splits, 3).collect()}
    found = {r.node: r for r in splits.collect()}
    assert sorted(r.node for r in nodes.values()) == list(range(len(nodes)))
    p, q = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
    inside = {1: rows}
    for path in sorted(nodes):
        own = inside[path]
        f, o = sum(r[2] for r in own) / p, sum(1 - r[2] for r in own) / q
        assert nodes[path].share == pytest.approx(f / (f + o))
        assert (path in found) == (nodes[path].left_child >= 0)
        if path in found:
            i = ["x", "y"].index(found[path].feature)
            assert nodes[path].feature == i and nodes[path].threshold == found[path].threshold
            inside[2 * path] = [r for r in own if r[i] <= found[path].threshold]
            inside[2 * path + 1] = [r for r in own if r[i] > found[path].threshold]
            assert nodes[path].left_child == nodes[2 * path].node
            assert nodes[path].right_child == nodes[2 * path + 1].node
    assert set(inside) == set(nodes)


def test_tree_scores_separate_the_labels(spark, sf_dir):
    scored = registry.QUERIES["fraud_tree_scores"](spark, sf_dir)
    means = {r.source_flag: r.m for r in scored.groupBy("source_flag").agg(F.avg("fraud_score").alias("m")).collect()}
    assert means[True] > means[False]
