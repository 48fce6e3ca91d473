"""The benchmarks: merge, groupby, shuffle, scan, array and stencil, on generated tables whose results are known.

python -m loomgrid.plans.benchmarks merge --runs 3 --rows 1000000 --chunks 10
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from ..functions.sizes import byte_size
from ..operators import aggregate, arrays, blocks, join, repartition
from ..session import materialised, session
from ..sources import generate, parquet
from . import harness, workers


def kept(spark: SparkSession, args: argparse.Namespace, name: str, make) -> DataFrame:
    """An input made once, persisted and computed before any time is taken."""
    held = args.__dict__.setdefault("_held", {})
    if name not in held:
        held[name] = materialised(make())
    return held[name]


def merge(spark, args) -> tuple[int, DataFrame]:
    """Bytes of both inputs (two columns of 8 bytes each); an inner join by broadcast, by shuffle or as Spark likes.

    The build side is dealt by a column that has nothing to do with the key, so keys that match don't lie together,
    unless no_shuffle leaves them in their natural order. set_index: the result is sorted by the key over all partitions."""
    base, other = args.base_chunks or args.chunks, args.other_chunks or args.chunks

    def build():
        rows = generate.merge_build(spark, base, args.rows)
        return (rows if args.no_shuffle else repartition.dealt_by_id(rows, "shuffle", base)).drop("shuffle")

    left = kept(spark, args, "other", lambda: generate.merge_other(spark, other, args.rows, args.frac_match).withColumnRenamed("payload", "other_payload"))
    right = kept(spark, args, "build", build)
    out = join.join_indexed(left, right, "key", max(base, other), args.join_type) if args.set_index else join.inner_join(left, right, "key", args.join_type)
    return repartition.item_bytes((base + other) * args.rows, 2), out


def groupby(spark, args) -> tuple[int, DataFrame]:
    rows = kept(spark, args, "rows", lambda: generate.groupby_rows(spark, args.chunks, args.rows, args.unique_ratio))
    return repartition.item_bytes(args.chunks * args.rows, 3), aggregate.max_count_mean(rows, "key", "int64", "float64", sort=args.sort, split_out=args.split_out, split_every=args.split_every)


def shuffle(spark, args) -> tuple[int, DataFrame]:
    size = byte_size(args.partition_size)
    rows = kept(spark, args, "rows", lambda: generate.shuffle_rows(spark, args.in_parts, size, args.workers))
    return args.in_parts * (size // 8) * 8, repartition.hash_shuffled(rows.drop("worker"), "data", args.out_parts or args.in_parts)


def scan(spark, args) -> tuple[int, DataFrame]:
    """Bytes on disk of the files; every column asked for is read in full."""
    rows = parquet.scanned(spark, parquet.discovered(spark, args.path, args.files), args.columns)
    return parquet.on_disk(rows.select("*", "_metadata")).first()["bytes"], parquet.opaque_count(rows)


def array(spark, args) -> tuple[int, DataFrame]:
    """Bytes of the inputs and the result of one operation: of a square array in long form or in blocks, of a tall one of rows of vectors (svd), of one of columns (fft), or of two columns."""
    n, m, size = args.size, args.second_size, args.chunk_size
    square = lambda name, seed: kept(spark, args, name, lambda: generate.uniform_array(spark, n, n, seed))
    in_blocks = lambda name, seed: kept(spark, args, f"{name} in blocks", lambda: blocks.blocked(generate.uniform_array(spark, n, n, seed), n, n, size))
    vectors = lambda rows, length: kept(spark, args, "vectors", lambda: arrays.to_vectors(generate.uniform_array(spark, rows, length, args.seed)))
    normal = lambda name, seed: kept(spark, args, name, lambda: generate.normal_array(spark, n, seed=seed))
    parts = -(-n // size)
    todo = {
        "sum": lambda: (n * n, arrays.total(square("x", args.seed))),
        "mean": lambda: (n * n, arrays.mean(square("x", args.seed))),
        "transpose_sum": lambda: (n * n, blocks.transpose_sum(in_blocks("x", args.seed))),
        "slice": lambda: (n * n, arrays.every(square("x", args.seed), 3)),
        "dot": lambda: (2 * n * n, blocks.dot(in_blocks("x", args.seed), in_blocks("y", args.seed + 1), axes=(parts, parts, parts))),
        "svd": lambda: (n * m, blocks.svd(vectors(n, m), "i", "v", m).u),
        "fft": lambda: (n * n, blocks.fft(vectors(n, n), "i", "v")),
        "col_sum": lambda: (2 * n, arrays.added(normal("x", args.seed), normal("y", args.seed + 1))),
        "col_mask": lambda: (2 * n, arrays.masked(normal("x", args.seed), normal("y", args.seed + 1), 10.0)),
        "col_gather": lambda: (n + m, arrays.gathered(normal("x", args.seed), kept(spark, args, "index", lambda: generate.int_array(spark, m, n, args.seed)))),
    }
    cells, out = todo[args.operation]()
    return cells * 8, out


def stencil(spark, args) -> tuple[int, DataFrame]:
    """Bytes of a square array; its mean over (2k + 1) x (2k + 1) neighbours, in blocks."""
    x = kept(spark, args, "x", lambda: blocks.blocked(generate.uniform_array(spark, args.size, args.size, args.seed), args.size, args.size, args.chunk_size))
    return args.size * args.size * 8, blocks.stencil(x, blocks.mean_kernel(args.kernel_size), args.size, args.size, args.chunk_size)


ALL = {f.__name__: f for f in (merge, groupby, shuffle, scan, array, stencil)}
OPERATIONS = ["sum", "mean", "transpose_sum", "slice", "dot", "svd", "fft", "col_sum", "col_mask", "col_gather"]


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = harness.parser("Benchmarks")
    p.add_argument("benchmark", choices=sorted(ALL))
    p.add_argument("--rows", type=int, default=1_000_000, help="rows of a chunk")
    p.add_argument("--chunks", type=int, default=8)
    p.add_argument("--base-chunks", type=int, help="chunks of the build side, if not --chunks")
    p.add_argument("--other-chunks", type=int, help="chunks of the other side, if not --chunks")
    p.add_argument("--no-shuffle", action="store_true", help="leave the build side's keys in their natural order")
    p.add_argument("--set-index", action="store_true", help="sort the joined rows by their key")
    p.add_argument("--frac-match", type=float, default=0.3)
    p.add_argument("--join-type", choices=["auto", "broadcast", "shuffle", "merge"], default="auto")
    p.add_argument("--unique-ratio", type=float, default=0.01)
    p.add_argument("--sort", action="store_true")
    p.add_argument("--split-out", type=int)
    p.add_argument("--split-every", type=int)
    p.add_argument("--in-parts", type=int, default=16)
    p.add_argument("--out-parts", type=int)
    p.add_argument("--partition-size", default="8 MiB")
    p.add_argument("--path", default="/root/testdata/sf0.1")
    p.add_argument("--files", type=int)
    p.add_argument("--columns", nargs="*")
    p.add_argument("--operation", choices=OPERATIONS, default="transpose_sum")
    p.add_argument("--size", type=int, default=1000)
    p.add_argument("--second-size", type=int, default=64, help="columns of the tall array, or length of the index")
    p.add_argument("--chunk-size", type=int, default=256, help="side of a block")
    p.add_argument("--kernel-size", type=int, default=1, help="k of a stencil over (2k + 1) x (2k + 1) cells")
    p.add_argument("--text", action="store_true", help="a report to read instead of one line of JSON")
    p.add_argument("--seed", type=int, default=0)
    return p.parse_args(given)


def measured(spark: SparkSession, args: argparse.Namespace) -> dict:
    """What one benchmark reports: sizes, times, throughput (harmonic mean and spread) in MiB/s, and what Spark shuffled and spilled meanwhile, over all its stages and in the exchange that moved most."""
    done: dict = {}

    def go():
        runs, summary = harness.run(spark, harness.Benchmark(args.benchmark, ALL[args.benchmark]), args)
        done["runs"], done["summary"] = runs.collect(), summary.first()

    stages = workers.exchanges(spark, go).collect()
    for df in args.__dict__.pop("_held", {}).values():
        df.unpersist()
    rows, s = done["runs"], done["summary"]
    total = lambda name: sum(r[name] for r in stages)
    widest = max(stages, key=lambda r: r["read_bytes"], default=None)
    return {
        "benchmark": args.benchmark, "bytes": rows[0]["data_processed"], "seconds": [round(r["duration"], 3) for r in rows],
        "mib_per_s": round(s["throughput_hmean"] / 2**20, 4), "mib_per_s_std": round(s["throughput_hstd"] / 2**20, 4), "wall_mean": round(s["wall_mean"], 3), "wall_std": round(s["wall_std"], 3),
        "shuffle_write_bytes": total("written_bytes"), "shuffle_write_rows": total("written_rows"), "shuffle_read_bytes": total("read_bytes"),
        "memory_spilled_bytes": total("memory_spilled_bytes"), "disk_spilled_bytes": total("disk_spilled_bytes"),
        "widest_exchange": {k: widest[k] for k in ("tasks", "read_rows", "read_bytes", "largest_read_rows", "median_read_rows")} if widest and widest["read_bytes"] else None,
    }


def report(found: dict, args: argparse.Namespace) -> str:
    """The figures as lines to read: configuration, runs, throughput, time, and what moved."""
    size = lambda n: next((f"{n / 2**k:.2f} {u}" for k, u in ((40, "TiB"), (30, "GiB"), (20, "MiB"), (10, "KiB")) if n >= 2**k), f"{n} B")
    head = [(k.replace("_", "-"), v) for k, v in sorted(vars(args).items()) if not k.startswith("_") and v not in (None, False) and k != "benchmark"]
    lines = [found["benchmark"], *[f"{k:<20}| {v}" for k, v in head], f"{'bytes a run':<20}| {size(found['bytes'])}"]
    lines += [f"{'run ' + str(k + 1):<20}| {t:.3f} s | {size(found['bytes'] / t)}/s" for k, t in enumerate(found["seconds"])]
    lines += [f"{'throughput':<20}| {found['mib_per_s']:.2f} MiB/s +/- {found['mib_per_s_std']:.2f} MiB/s", f"{'wall clock':<20}| {found['wall_mean']:.3f} s +/- {found['wall_std']:.3f} s"]
    lines += [f"{'shuffled':<20}| {size(found['shuffle_write_bytes'])} in {found['shuffle_write_rows']} rows", f"{'spilled':<20}| {size(found['memory_spilled_bytes'])} of memory, {size(found['disk_spilled_bytes'])} to disk"]
    if x := found["widest_exchange"]:
        lines.append(f"{'widest exchange':<20}| {size(x['read_bytes'])} to {x['tasks']} tasks; rows of the median task {x['median_read_rows']:.0f}, of the largest {x['largest_read_rows']}")
    return "\n".join(lines)


def main() -> None:
    args = arguments()
    spark = session(workers=args.workers, threads=args.threads_per_worker, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    found = measured(spark, args)
    print(report(found, args) if args.text else json.dumps(found), flush=True)


if __name__ == "__main__":
    main()
