"""Keys that hold all rows: numbers inside keys, list parts and labels are spread over tasks."""

from pyspark.sql import functions as F

from seqbin.operators.graph import connected_components, neighbors
from seqbin.operators.groups import group_members
from seqbin.operators.indexing import with_group_position
from seqbin.operators.kmers import kmer_index
from seqbin.operators.skew import PIECES, join_one
from seqbin.staging import stage

N = 20_000


def rows_per_partition(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_positions_inside_keys(spark):
    rows = [(None if i % 7 == 0 else f"k{i % 3}", i * 37 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, o int, id long").repartition(5)
    got = with_group_position(df, ["key"], ["o", "id"], ranges=("o",)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    want = {}
    for at, row in enumerate(order):
        own = [r for r in order if r[0] == row[0]]
        want[row[2]] = (order.index(own[0]), own.index(row), len(own), min(r[1] for r in own), max(r[1] for r in own))
    assert {r.id: (r.start, r.position, r.total, r.o_min, r.o_max) for r in got} == want


def test_one_key_is_spread_over_partitions(spark):
    df = spark.range(N).select(F.lit(1).alias("key"), "id").repartition(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = with_group_position(df, ["key"], ["id"])
        sizes = rows_per_partition(placed)
        table = spark.createDataFrame([(1, "x")], "key int, name string")
        joined = rows_per_partition(join_one(df, table, ["key"], ["id"]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == N and max(sizes) <= N * 3 // 4 and len(sizes) > 1
    assert sum(joined) == N and max(joined) < N // 2 and PIECES > 8


def test_join_one_keeps_rows_without_a_partner(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "key int, id int")
    table = spark.createDataFrame([(1, "x")], "key int, name string")
    assert sorted(map(str, (tuple(r) for r in join_one(rows, table, ["key"], ["id"], "left").collect()))) == [
        "(1, 1, 'x')", "(1, 2, 'x')", "(2, 3, None)"
    ]
    assert join_one(rows, table, ["key"], ["id"]).count() == 2


def test_lists_of_hot_keys_are_cut_in_order(spark):
    tokens = spark.range(1000).select(F.lit("A").alias("kmer"), F.col("id").alias("read_id"))
    parts = kmer_index(tokens, max_list=64).orderBy("part").collect()
    assert [r.part for r in parts] == list(range(16)) and {r.parts for r in parts} == {16}
    assert [x for r in parts for x in r.adjacency] == list(range(1000))
    edges = spark.range(1, 1001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    twice = edges.unionByName(edges)
    hub = neighbors(twice, max_list=100).filter("read_id = 0").orderBy("part").collect()
    assert [x for r in hub for x in r.nbrs] == list(range(1, 1001)) and len(hub) == 10
    groups = spark.range(1000).select(
        F.lit("0.0").alias("group_id"), F.lit(0).alias("component"), F.lit(0).alias("group_idx"), F.col("id").alias("read_id"), (F.col("id") == 0).alias("is_seed")
    )
    members = group_members(groups, max_list=250).filter("not is_seed").orderBy("part").collect()
    assert [x for r in members for x in r.members] == list(range(1, 1000)) and len(members) == 4


def test_one_component_of_all_reads(spark):
    edges = spark.range(1, N).select(F.floor(F.col("id") / 50).alias("src"), F.col("id").alias("dst"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        components = connected_components(edges)
        sizes = rows_per_partition(components)
        assert components.select("component").distinct().collect()[0][0] == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == N and max(sizes) < N // 2
