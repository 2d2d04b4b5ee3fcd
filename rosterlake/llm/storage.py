"""Scratch tables and committed files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); a local one only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='rosterlake-')}")
    return where.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for joins that must not broadcast it, nor what is made of it by explodes and aggregates.

    Spark takes a table for as large as its files and an explode for as large
    as what goes in; ids that compress well, or 48 rows out of one, would pass
    its threshold and not fit the driver.
    """
    out = df.hint("merge")
    if path := df.__dict__.get("scratch_path"):
        out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by `written` that no later result reads."""
    for df in tables:
        remove_dir(df.sparkSession, df.scratch_path)


def remove_dir(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that `column` holds about `max_bytes` in each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column(column).nbytes
        step = max(1, int(n * max_bytes / max(size, 1))) if size > max_bytes else n
        at = 0
        while at < n:
            part = batch.slice(at, step)
            while part.num_rows > 1 and part.column(column).nbytes > 2 * max_bytes:
                part = batch.slice(at, max(1, part.num_rows // 2))
            yield part
            at += part.num_rows


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI (file, hdfs, s3, gs) or of a plain path."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def put_temporary(folder: str, name: str, parts: list[bytes]) -> str:
    """Write a file under a temporary name of this task attempt; `commit` gives it its final one."""
    fs, root = open_fs(folder)
    fs.create_dir(f"{root}/_tmp", recursive=True)
    temp = f"_tmp/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{root}/{temp}", compression=None) as out:
        for x in parts:
            out.write(x)
    return temp


def read_file(folder: str, name: str) -> bytes:
    fs, root = open_fs(folder)
    with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
        return f.read()


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Give the files of a manifest (temp_name, file_name) their final names.

    Only the attempt whose row reached the manifest is renamed, so files of
    failed or speculative attempts never become visible.  A rename that ran
    before an executor was lost is recognised when it is tried again.
    """

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for temp, name in zip(batch.column("temp_name").to_pylist(), batch.column("file_name").to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{temp}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{name}")
            yield batch

    spark = manifest.sparkSession
    path = f"{folder}/manifest"
    manifest.mapInArrow(rename, manifest.schema).write.parquet(path)
    remove_dir(spark, f"{folder}/_tmp")
    return spark.read.schema(manifest.schema).parquet(path)


HISTOGRAM_CELLS = 1 << 15
MAX_SHARDS = 1 << 13


def _reached(cuts: list[int], x: str, kind: str) -> str:
    """SQL: how many of the ascending cuts are <= x, by binary search over a literal array."""
    if not cuts:
        return "0"
    table = f"array({', '.join(f'cast({c} as {kind})' for c in cuts)})"
    middle = "cast((s.lo + s.hi) div 2 as int)"
    return (
        f"aggregate(sequence(1, {len(cuts).bit_length()}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> if(s.lo >= s.hi, s,"
        f" if({table}[{middle}] <= {x}, named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle}))), s -> s.lo)"
    )


def range_shards(df: DataFrame, key: str, weight, per_shard: int, source: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Add `shard`: consecutive ranges of the integer `key`, of about `per_shard` total weight each (MAX_SHARDS ranges or so at most).

    Deterministic, unlike sampled range bounds: an equal-width histogram of the
    key is taken, cells that weigh too much are taken apart by histograms of
    their own until they hold one key, and the cells are cut where the running
    weight passes a multiple of `per_shard`.  At most HISTOGRAM_CELLS + MAX_SHARDS
    rows of a histogram reach the driver, at any input size.  Rows with a null
    key form shard 0 together with the smallest keys; rows of one key stay
    together.  Returns the frame and the number of shards.  source: a cheaper
    frame with the same keys and weights, to take the histograms from.
    """
    base = df if source is None else source
    lo, hi, total = base.agg(F.min(key), F.max(key), F.sum(F.when(F.col(key).isNotNull(), weight)).cast("double")).first()
    if lo is None:
        return df.withColumn("shard", F.lit(0)), 1
    per = max(per_shard, (total or 0.0) / MAX_SHARDS)
    # places count from the smallest key; as decimals where long would overflow
    kind = "bigint" if hi - lo < 1 << 62 else "decimal(20,0)"
    place = f"(cast(`{key}` as {kind}) - cast({lo} as {kind}))"
    weighed = base.where(F.col(key).isNotNull()).select(F.expr(place).alias("place"), weight.cast("double").alias("w"))
    cells, open_cells = [], [(0, hi - lo + 1, float("inf"))]
    while open_cells:
        starts = [c[0] for c in open_cells]
        widths = [max(1, -(-c[1] // max(2, HISTOGRAM_CELLS // len(open_cells)))) for c in open_cells]
        at = lambda values: f"array({', '.join(f'cast({v} as {kind})' for v in values)})[no]"
        numbered = weighed.withColumn("no", F.expr(f"{_reached(starts, 'place', kind)} - 1")).withColumn("past", F.expr(f"place - {at(starts)}"))
        inside = numbered.where(F.expr(f"past < {at([c[1] for c in open_cells])}"))
        rows = inside.groupBy("no", F.expr(f"cast(past div {at(widths)} as bigint)").alias("cell")).agg(F.sum("w").alias("w")).collect()
        found = [(starts[r["no"]] + r["cell"] * widths[r["no"]], widths[r["no"]], r["w"] or 0.0) for r in rows]
        open_cells = sorted(c for c in found if c[2] > 2 * per and c[1] > 1)
        cells += [c for c in found if not (c[2] > 2 * per and c[1] > 1)]
    cuts, held = [], 0.0
    for start, _, w in sorted(cells):
        if held >= per:
            cuts.append(start)
            held = 0.0
        held += w
    shard = F.expr(f"coalesce({_reached(cuts, '_place', kind)}, 0)").cast("int")
    return df.withColumn("_place", F.coalesce(F.expr(place), F.lit(0))).withColumn("shard", shard).drop("_place"), len(cuts) + 1
