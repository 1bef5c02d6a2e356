"""Shared pieces: materialising, distributed ranks, vectorised word and shingle hashes, components."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that share one bucket of a distributed rank, about.
ROWS_PER_BUCKET = 4096
#: Bytes of a table that may be broadcast after its size has been measured.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch on its way to a worker, about, unless the session sets its own; Spark's default is 64 MB or 10,000 rows.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="terralume-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a table once into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def bounded(df: DataFrame) -> DataFrame:
    """The table, its session's Arrow batches bounded by BATCH_BYTES: executors hold them outside the heap, and long texts make them large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def release(*tables: DataFrame) -> None:
    """Delete what materialize has written, once all that is read from it has been written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast hint if the materialised table's measured size is within BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def bucket_count(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_BUCKET))


def distributed_rank(df: DataFrame, group: list[str], order: list, rows: int, size: str | None = None, salt: list | None = None) -> DataFrame:
    """Add rank (0-based, gapless in its group) and, with size, before (sum of the sizes ahead).

    A group is ordered by (bucket, order); a bucket is a hash of salt (default: order), so that no task
    has to hold a group: rows are ranked inside (group, bucket), and buckets are offset by sums that are
    aggregated before any shuffle. df is read twice and should be materialised. Groups may be null.
    """
    total = F.sum(size) if size else F.lit(0).cast("long")
    x = df.withColumn("_b", F.pmod(F.xxhash64(*(salt or order)), F.lit(bucket_count(rows)))).withColumns({f"_g{i}": F.coalesce(F.xxhash64(g), F.lit(0)) for i, g in enumerate(group)} | {f"_n{i}": F.col(g).isNull() for i, g in enumerate(group)})
    keys = [c for i in range(len(group)) for c in (f"_g{i}", f"_n{i}")]
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = x.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), total.alias("_s"))
    offsets = offsets.select(*keys, "_b", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_oc"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_os"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    x = x.join(offsets, [*keys, "_b"])
    x = x.withColumn("rank", F.col("_oc") + F.row_number().over(inside) - 1)
    if size:
        x = x.withColumn("before", F.col("_os") + F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.drop("_b", "_oc", "_os", *keys)


# ---- vectorised hashes -------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection) on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 17)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z in lower case, and the bounds of each text's words."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inner = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    firsts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return words, np.searchsorted(starts, firsts)


def give_back() -> None:
    """Hand freed memory back to the system: workers are used again, and what they keep would add up from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def sliced(batches, column: int, size: int = 1 << 21):
    """The batches in parts whose texts (or binaries) in the column have about so many bytes, a row at least; after each, freed memory is given back."""
    for b in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(held):
            end = max(begin + 1, int(np.searchsorted(held, (held[begin - 1] if begin else 0) + size, "right")))
            yield b.slice(begin, end - begin)
            begin = end
            give_back()
        if not len(held):
            yield b
    _powers.clear()
    give_back()


def chunks(texts: list[str | None], chars: int = 1 << 19):
    """Slices of the list with about so many characters each, one text at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: list[str | None], width: int):
    """For each text, the sorted distinct hashes of its shingles of width words; fewer words: the whole sequence as one."""
    for begin, end in chunks(texts):
        words, bounds = word_hashes(texts[begin:end])
        acc = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            acc = mix(acc * np.uint64(3) + words[j : len(words) - width + 1 + j] + np.uint64(j + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                yield np.unique(acc[a : b - width + 1])
            elif b > a:
                one = np.uint64(0)
                with np.errstate(over="ignore"):
                    for j, w in enumerate(words[a:b]):
                        one = mix(np.array([one * np.uint64(3) + w + np.uint64(j + 1)], np.uint64))[0]
                yield np.array([one], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


# ---- connected components ----------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b), root being the smallest node reachable.

    Alternates large-star and small-star steps, each an aggregation and a join, on tables written to the
    shared folder, until the edges stay as they are. Nulls aren't nodes; loops and repeats do no harm.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(least, "a")
        if large:
            return out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    edges = materialize(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    while seen[0]:
        last, edges = edges, materialize(star(star(edges, True), False))
        release(last)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
