import random

from frameloom.llm import components as graph


def plain(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def edge_lists():
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(-20, 20)]
    star = [(100, 100 + i) for i in range(1, 30)]
    some = [(rng.randrange(1000, 1120), rng.randrange(1000, 1120)) for _ in range(60)]
    rng.shuffle(path)
    return [*path, *star, *some, *some[:9], (2**62, -(2**62)), (7, 7)]


def found(spark, edges, group):
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return {r.node: r.root for r in rows}, len(rows), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_few_edges_take_few_jobs(spark):
    got, n, jobs = found(spark, edge_lists(), "few edges")
    assert got == plain([e for e in edge_lists() if e[0] != e[1]]) and n == len(got)
    assert jobs <= 8


def test_more_edges_are_joined(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_ROWS", 10, raising=False)
    got, n, _ = found(spark, edge_lists(), "more edges")
    assert got == plain([e for e in edge_lists() if e[0] != e[1]]) and n == len(got)


def test_no_edges(spark):
    assert found(spark, [(1, 1), (None, 2)], "no edges")[0] == {}
