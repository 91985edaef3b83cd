"""Time the headline operators; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from seqbin import BinningParams, fixtures  # noqa: E402
from seqbin.operators import graph, groups, kmers, overlap, vectors  # noqa: E402
from seqbin.plans.binning import bin_reads, index_records  # noqa: E402
from seqbin.plans.registry import K, M  # noqa: E402
from seqbin.staging import drop_stages, stage  # noqa: E402


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    params = BinningParams()
    times: dict[str, float] = {}

    def timed(name: str, work):
        start = time.time()
        value = work()
        times[name] = round(time.time() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
        return value

    records = fixtures.document_records(spark, sf_dir)
    run(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # start the session
    reads = timed("read_index", lambda: index_records(records))
    timed("read_kmers", lambda: run(kmers.read_kmers(reads, K)))
    timed("kmer_tokens", lambda: run(kmers.kmer_tokens(reads, K)))
    edges = timed("overlap_edges", lambda: stage(overlap.overlap_of_reads(reads, K, M), "edges"))
    components = timed(
        "connected_components",
        lambda: stage(graph.attach_components(reads.select("read_id"), graph.connected_components(edges)), "components"),
    )
    grouped = timed(
        "seed_groups", lambda: stage(groups.group_reads(edges, components), "groups")
    )
    timed("frequency_vectors", lambda: run(vectors.frequency_vectors(grouped, reads)))
    timed("bin_reads", lambda: run(bin_reads(spark, records, params).metrics()))
    drop_stages(spark)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline operators",
                "value": round(sum(times.values()), 2),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
