"""Search configuration, stopping, batches, sinks and analysis edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelar.functions.keys import key_sql, keys, place_sql
from parcelar.operators import analysis, decoders, features, partition
from parcelar.plans import batch, search
from parcelar.sources import fixtures, tables
from conftest import SMALL


def test_config_bounds():
    assert search.SearchConfig(elite_fraction=0.29).elite == 28  # int() truncates 28.999...
    for bad in ({"elite_fraction": 0.5}, {"mutant_fraction": 0}, {"elite_fraction": 0.4, "mutant_fraction": 0.6}, {"crossover_rate": 0.5}, {"population_size": 3}):
        with pytest.raises(ValueError):
            search.SearchConfig(**bad)


def test_keys_agree_and_spread(spark):
    got = [r[0] for r in spark.range(5000).selectExpr(f"{key_sql('3', place_sql('2', '9', 'id'))} AS u").collect()]
    assert got == keys(3, 2, 9, np.arange(5000)).tolist()
    assert abs(np.mean(got) - 0.5) < 0.02 and abs(np.var(got) - 1 / 12) < 0.01
    far = keys(3, 2, 9, np.arange(10**6))
    assert 0 <= far.min() and far.max() < 1


def minima(spark, values):
    return spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run_id string, generation int, min double")


def test_stopping(spark):
    stop = lambda values, t: search.tolerance_stop(minima(spark, values), t).first()["stopped_at"]
    assert stop([5, 4, 4, 4, 3], 2) == 3
    assert stop([5, 4, 4, 3], 2) is None
    assert stop([5, 4], 0) == 1
    drift = [5 - 0.00009 * i for i in range(5)]  # small gains add up against the best that counted
    assert search.tolerance_stop(minima(spark, drift), 10).first()["best"] == pytest.approx(drift[4])


def test_last_improvement(spark):
    row = search.last_improvement(minima(spark, [5, 5, 4, 4])).first()
    assert (row["improved_at"], row["last_gen"]) == (2, 3)
    assert search.last_improvement(minima(spark, [5, 5])).first()["improved_at"] == 0


def test_native_and_kernel_decoders_agree(spark):
    from parcelar.queries import population

    for make in (fixtures.nation_lattice, fixtures.nation_rows):
        nodes, edges = make(spark, SMALL)
        pop = population(spark, "mst")
        if make is fixtures.nation_rows:
            from pyspark.sql import functions as F

            pop = pop.withColumn("instance", F.lit("nation_rows"))
        a = {r["chrom"]: r["labels"] for r in decoders.decode_mst_native(pop, nodes, edges).collect()}
        b = {r["chrom"]: r["labels"] for r in decoders.decode(pop, nodes, edges, "mst").collect()}
        assert a == b and len(a) == 20


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        batch.check_heuristics(["no_such_method"])
    assert batch.check_heuristics([]) == batch.HEURISTICS
    graph = decoders.as_graph(2, [0.0, 1.0], [0], [1])
    with pytest.raises(ValueError):
        batch.run_one(graph, 3, "skater", 0, search.SearchConfig())


def test_labels_out_of_range(spark):
    labels = spark.createDataFrame([("r", 3, [1, 0, 4, 1, 3])], "run_id string, k int, labels array<int>")
    found = {r["region"]: r["nodes"] for r in partition.labels_to_regions(labels).collect()}
    assert found == {1: [0, 3], 2: [], 3: [4]}


def test_tiles_of_pairs(spark):
    nodes, _ = fixtures.embedding_ring(spark, SMALL)
    nodes = nodes.where("node_id < 40")
    a = {(r["i"], r["j"]): r["d"] for r in features.pairwise_dissimilarity(nodes, 7).collect()}
    b = {(r["i"], r["j"]): r["d"] for r in features.pairwise_dissimilarity(nodes).collect()}
    assert a == b and len(a) == 780


def test_sinks(spark, tmp_path):
    rows = [("a__3__0", 25, 3, "skater", 1.5, 0.1, None), ("a__3__0", 25, 3, "brkga_mst", 1.0, 0.2, 9)]
    results = spark.createDataFrame(rows, tables.RESULTS)
    where = str(tmp_path / "results")
    assert tables.read_results(spark, where).isEmpty()
    tables.append_results(results, where)
    assert tables.read_results(spark, where).count() == 2
    ids = spark.createDataFrame([("a__3__0",), ("b__3__0",)], "id string")
    tables.write_ids(ids, str(tmp_path / "ids"))
    assert [r[0] for r in batch.pending(tables.read_ids(spark, str(tmp_path / "ids")), tables.read_results(spark, where)).collect()] == ["b__3__0"]
    tables.write_results_csv(batch.results_wide(results, ["brkga_mst", "skater"]), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[:5] == ["ID", "N", "K", "brkga_mst__f", "skater__f"]
    tables.write_config(spark, {"b": 1, "a": [2]}, str(tmp_path / "config"))
    assert spark.read.text(str(tmp_path / "config")).first()[0] == '{"a": [2], "b": 1}'
    nodes, edges = fixtures.nation_lattice(spark, SMALL)
    tables.write_instances(nodes, edges, str(tmp_path / "instances"))
    back, lines = tables.read_instances(spark, str(tmp_path / "instances"))
    assert (back.count(), lines.count()) == (25, 40)
    named = partition.region_names(nodes.selectExpr("'r' AS run_id", "instance", "1 AS region", "node_id"), nodes).selectExpr("'skater' AS heuristic", "*")
    tables.write_partitions(named, str(tmp_path / "partitions"))
    assert spark.read.text(str(tmp_path / "partitions")).count() == 1
    assert tables.folders(None, "data/")["Plots"] == "data/Results/Plots"


def results(spark, rows):
    return spark.createDataFrame([(str(i), h, f, 1.0) for i, h, f in rows], "id string, heuristic string, f double, time_s double")


def test_ranks_with_ties_and_gaps(spark):
    rows = [(1, "a", 1.0), (1, "b", 1.0 + 1e-10), (1, "c", 2.0), (2, "a", None), (2, "b", float("nan")), (2, "c", 1.0)]
    found = {(r["id"], r["heuristic"]): r["rank"] for r in analysis.ranks(results(spark, rows)).collect()}
    assert found == {("1", "a"): 1.5, ("1", "b"): 1.5, ("1", "c"): 3.0, ("2", "c"): 1.0}
    assert {r["heuristic"]: r["wins"] for r in analysis.wins(results(spark, rows)).collect()} == {"a": 1, "b": 1, "c": 1}


def test_friedman_edges(spark):
    tied = results(spark, [(i, h, 1.0) for i in range(4) for h in "abc"])
    assert analysis.friedman(tied).first()["statistic"] is None
    two = results(spark, [(i, h, float(ord(h))) for i in range(4) for h in "ab"])
    assert analysis.friedman(two).first()["statistic"] is None
    assert analysis.analyse(results(spark, [])) == {}
    assert set(analysis.analyse(two)) == {"summary", "boxplot_f", "boxplot_time"}
    full = results(spark, [(i, h, float(ord(h))) for i in range(6) for h in "abc"])
    assert analysis.friedman(full).first()["statistic"] == pytest.approx(12.0)
    assert analysis.friedman(full).first()["p"] == pytest.approx(np.exp(-6), rel=1e-9)
    assert len(analysis.analyse(full)) == 9


def test_tails():
    assert analysis._chi_square_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert analysis._chi_square_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-5)
    assert analysis._chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert analysis.studentized_range_tail(3.314, 3) == pytest.approx(0.05, abs=2e-4)
    assert analysis.studentized_range_tail(4.474, 10) == pytest.approx(0.05, abs=2e-4)


def test_palette_is_total():
    assert len(set(partition.palette(12).values())) == 12 and partition.palette(0) == {}


def test_plan_stops_like_the_kernel(spark):
    from parcelar.operators.kernels import chromosome_length

    nodes, edges = fixtures.nation_lattice(spark, SMALL)
    config = search.SearchConfig(population_size=10, max_generations=6, tolerance_generations=1, max_time=None, seed=3)
    runs = spark.createDataFrame([("r", "nation_lattice", 3, 3, chromosome_length("mst", 25, 40))], "run_id string, instance string, k int, seed int, length int")
    _, statistics = search.run_plan(runs, nodes, edges, config, "mst")
    tasks = spark.createDataFrame([("r", "nation_lattice", 3, 3, "brkga_mst")], "run_id string, instance string, k int, seed int, heuristic string")
    kernel = search.statistics_of(search.search_runs(tasks, nodes, edges, config))
    a, b = ({r["generation"]: r["min"] for r in s.collect()} for s in (statistics, kernel))
    assert a.keys() == b.keys() and all(a[g] == pytest.approx(b[g]) for g in a)


def test_components_of_long_paths(spark):
    """A path of randomly numbered nodes is one component however long it is; two instances don't mix."""
    order = np.random.default_rng(5).permutation(1000).tolist()
    edges = [("long", a, b) for a, b in zip(order, order[1:])] + [("cut", a, b) for i, (a, b) in enumerate(zip(order, order[1:])) if i != 499]
    edges += [("cut", 7, 7), ("cut", 3, 5000)]  # a loop, and a node that isn't there
    nodes = [(i, n) for i in ("long", "cut") for n in order] + [("cut", 2000)]
    half = {n: min(part) for part in (order[:500], order[500:], [2000]) for n in part}
    found = decoders.connected_components(
        spark.createDataFrame(edges, "instance string, u int, v int"), spark.createDataFrame(nodes, "instance string, node_id int")
    ).collect()
    assert {(r["instance"], r["node_id"]): r["component"] for r in found} == {(i, n): 0 if i == "long" else half[n] for i, n in nodes}
    assert len(found) == len(nodes)


def test_shuffled_graphs_give_the_same(spark, monkeypatch):
    from parcelar.operators import decoders
    from parcelar.queries import lattice
    from parcelar.queries import population as some_population

    nodes, edges = lattice(spark, SMALL)
    population = some_population(spark, "shortest")
    want = sorted(map(str, decoders.decode(population, nodes, edges, "shortest").collect()))
    monkeypatch.setattr(decoders, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decoders.decode(population, nodes, edges, "shortest").collect())) == want


def test_saved_waves_go_on_where_they_stopped(spark, tmp_path):
    from parcelar.queries import lattice

    nodes, edges = lattice(spark, SMALL)
    ids, path = batch.execution_ids(nodes, 2), str(tmp_path / "results")
    config = search.SearchConfig(population_size=10, max_generations=2, max_time=None)
    options = {"redcap": {"method": "fullorder-completelinkage"}, "azp_tabu": {"tabu_length": 3}}
    first = batch.run_and_save(ids.where("repetition = 0"), nodes, edges, config, path, ["redcap", "azp_tabu"], options, waves=2)
    assert first.count() == 6
    times = {r["id"]: r["time_s"] for r in first.where("heuristic = 'redcap'").collect()}
    whole = batch.run_and_save(ids, nodes, edges, config, path, ["redcap", "azp_tabu"], options, waves=3)
    assert whole.count() == 12
    assert all(times.get(r["id"], r["time_s"]) == r["time_s"] for r in whole.where("heuristic = 'redcap'").collect())  # nothing ran twice


def test_tiles_are_never_broadcast(spark):
    """Spark would judge the blocks before they are repeated for their tiles, and collect these in the driver."""
    nodes = spark.range(200).select(F.lit("a").alias("instance"), F.col("id").cast("int").alias("node_id"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("x"))
    pairs = features.pairwise_dissimilarity(nodes, 7)
    assert len(pairs.collect()) == 200 * 199 // 2
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_objective_of_nodes_forms_pairs_inside_regions_only(spark, monkeypatch):
    nodes = spark.range(90).select(F.lit("a").alias("instance"), F.col("id").cast("int").alias("node_id"), F.array(F.col("id") * 1.5, F.col("id") % 7 * 1.0).alias("x"))
    found = nodes.crossJoin(spark.createDataFrame([("r", 3), ("s", 1)], "run_id string, k int"))
    found = found.where("node_id <> 89").selectExpr("run_id", "instance", "CASE WHEN node_id = 5 THEN 9 ELSE cast(node_id % k AS int) END AS region", "node_id")
    want = {r["run_id"]: r["f"] for r in partition.objective_pairwise(found, features.pairwise_dissimilarity(nodes)).collect()}
    for block in (4, 128):
        got = {r["run_id"]: r["f"] for r in partition.objective_of_nodes(found, nodes, block).collect()}
        assert got == pytest.approx(want)
    from parcelar import queries

    monkeypatch.setattr(features, "pairwise_dissimilarity", None)  # all pairs of the table aren't needed
    queries.objective_pairwise(spark, "/root/testdata/sf0.001").collect()


def shuffled_bytes(spark):
    gateway = spark.sparkContext._gateway
    lists = [gateway.jvm.java.util.ArrayList() for _ in range(2)]
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(lists[0], False, False, gateway.new_array(gateway.jvm.double, 0), lists[1])
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))


def test_nodes_of_all_pairs_are_shuffled_a_few_times_only(spark):
    """An equi-join of tiles would write each of the 64 blocks 65 times."""
    x = np.random.default_rng(3).normal(size=(1024, 32))
    nodes = spark.createDataFrame([("a", i, row) for i, row in enumerate(x.tolist())], "instance string, node_id int, x array<double>")
    before = shuffled_bytes(spark)
    assert features.pairwise_dissimilarity(nodes, 16).count() == 1024 * 1023 // 2
    assert 0 < shuffled_bytes(spark) - before < 8 * x.nbytes


@pytest.mark.parametrize("named", [True, False])
def test_pairs_of_instances_of_one_block_and_of_many(spark, named):
    ids = {"many": [n * 37 - 100 for n in range(40)], "more": list(range(30)), "one": [1, 2, 4], "single": [9]}
    x = {(i, n): [n * 0.25, float(n % 7)] for i in ids for n in ids[i]}
    nodes = spark.createDataFrame([(i, n, v) for (i, n), v in x.items()] + [(None, 3, [0.0, 0.0]), (None, 4, [1.0, 0.0])], "instance string, node_id int, x array<double>")
    want = [(i, a, b, (x[i, a][0] - x[i, b][0]) ** 2 + (x[i, a][1] - x[i, b][1]) ** 2) for i in ids for a in ids[i] for b in ids[i] if a < b]
    got = features.pairwise_dissimilarity(nodes, 7, named=named)
    assert sorted(map(tuple, got.collect())) == sorted(want if named else [row[1:] for row in want])
    small = features.pairwise_dissimilarity(nodes.where("instance IN ('one', 'single')"), 7, named=named)
    assert len(small.collect()) == 3 and features.pairwise_dissimilarity(nodes.where("false"), 7).isEmpty()


def test_distances_are_rounded_as_in_sql(spark):
    import duckdb

    d = np.arange(12_345_678, 12_346_678) * 1e-6 + 0.5e-6
    d = np.concatenate([d, np.nextafter(d, 0), np.nextafter(d, 99), [0.0, 0.5e-6, 1e300, np.inf]])
    want = duckdb.sql(f"SELECT round(unnest({d[:-1].tolist()}::DOUBLE[]), 6) AS r").df()["r"].to_numpy()
    assert (features._rounded(d, 6)[:-1] == want).all() and features._rounded(d, 6)[-1] == np.inf
    nodes = spark.createDataFrame([("a", 0, [0.0]), ("a", 1, [0.9])], "instance string, node_id int, x array<double>")
    assert features.pairwise_dissimilarity(nodes, digits=1).first()["d"] == 0.8
