"""Queries that take every label, user and part."""

from chronovec.plans import catalog


def test_all_keys_are_there(spark, sf_dir, duck):
    rows = lambda name: catalog.QUERIES[name](spark, sf_dir)
    some = lambda sql: duck.execute(sql).fetchone()[0]
    users = some("SELECT count(DISTINCT user_id) FROM events")
    assert rows("d3_within_pairs").select("label").distinct().count() > 3
    for name in ("d6_zip_timelines", "d7_lag_correlation"):
        assert rows(name).select("user_id").distinct().count() == users - 1
    assert rows("g6_best_fit_block").count() == some("SELECT count(*) FROM part WHERE p_partkey % 3 <> 0")
    graphs = rows("b7_filter_graph").collect()
    assert sum(r.graph.count("trim=start") for r in graphs) == some("SELECT count(*) FROM events")


def test_filter_graph_of_one_segment_and_of_two(spark):
    from chronovec.sources.reports import filter_graph

    df = spark.createDataFrame([(1, 0, 0.0, 1.5), (2, 0, 0.0, 1.0), (2, 1, 3.0, 4.25)], "u long, i long, a double, b double")
    got = {r.u: r.graph for r in filter_graph(df, ["u"], "i", "a", "b").collect()}
    assert got[1] == "[0:v]trim=start=0.000:end=1.500,setpts=PTS-STARTPTS[v]"
    assert got[2] == "[0:v]trim=start=0.000:end=1.000,setpts=PTS-STARTPTS[v0];[0:v]trim=start=3.000:end=4.250,setpts=PTS-STARTPTS[v1];[v0][v1]concat=n=2:v=1[v]"
