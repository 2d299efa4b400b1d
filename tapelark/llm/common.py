"""Words, scratch tables, first occurrences and connected components shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch, and about the bytes of what a worker turns into Python objects at a time.
BATCH_ROWS, PIECE_BYTES = 1000, 8 << 20

#: Seconds between two times that the driver gives memory back, and such times without a job before that ends.
EVERY_S, IDLE_TIMES = 10, 30

_serial = itertools.count()
_own: list[str] = []


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once per row.

    A plain projection may be merged into what reads it, and into a lambda's every call; what a
    generator makes is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, one of our own: only on a local master, as executors of a cluster would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tapelark-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a narrow intermediate table to the shared folder and read it back.

    The files survive lost executors and cut the lineage. They belong to the job: remove them with
    ``drop`` when nothing reads them any more, or with the folder itself.
    """
    path = f"{scratch(df.sparkSession)}/tapelark/{label}-{next(_serial)}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tapelark_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table."""
    path = getattr(df, "_tapelark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of ``rows`` rows at most for what runs meanwhile; executor and worker both hold whole ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name, None)
    if own is None or not 0 < int(own) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task, or goes on to another operator, without it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def driver_gives_back(spark: SparkSession) -> bool:
    """Return to the system what the driver has freed outside the JVM's heap; whether its JVM can do that (HotSpot on glibc).

    Compilers and native libraries take memory from many threads, and what they have freed stays with the process otherwise.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    give_back()
    try:
        # By reflection, as the server's own class is not open to others.
        named, one, kind = jvm.java.lang.Class.forName, jvm.Object, jvm.java.lang.Class
        ways = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(kind, *ways))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(one, name, "systemTrimNativeHeap", array(one), array(jvm.String)))
    except Py4JJavaError:
        return False
    return True


_giver: threading.Thread | None = None


def keep_giving_back(spark: SparkSession, every: float | None = None) -> None:
    """``driver_gives_back`` now, and again and again while jobs run: those of a lazy result run after its function has returned."""
    global _giver
    context, every = spark.sparkContext, EVERY_S if every is None else every

    def run() -> None:
        idle = 0
        while idle < IDLE_TIMES and not pause.wait(every):
            try:
                idle = 0 if context.statusTracker().getActiveJobsIds() else idle + 1
                driver_gives_back(spark)
            except (Py4JError, AttributeError, OSError):  # the session has ended
                return

    if driver_gives_back(spark) and not (_giver and _giver.is_alive()):
        pause = threading.Event()
        _giver = threading.Thread(target=run, name="tapelark-gives-back", daemon=True)
        _giver.start()


def by_pieces(run: Callable, total: int = PIECE_BYTES) -> Callable:
    """``run`` for mapInArrow over batches cut to about ``total`` bytes; what it has freed goes back when it ends."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * total // max(total, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cut(batches))
        give_back()

    return whole


def plan_bytes(df: DataFrame) -> int:
    """Bytes of a materialized table's files, which is what a size check before a broadcast looks at."""
    path = df._tapelark_path
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


#: A side is broadcast only if its written files are no larger than this.
BROADCAST_BYTES = 4 << 20


def sized(df: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if the files of ``written`` prove it small; else as it is.

    ``written`` is a materialized table that ``df`` is a projection of, by default ``df`` itself.
    """
    return F.broadcast(df) if plan_bytes(df if written is None else written) <= BROADCAST_BYTES else df


def apart(df: DataFrame, label: str) -> DataFrame:
    """An aggregation's result, written before it is joined on its own key.

    Without that, the join takes the aggregation's partitions as they are and Spark cannot split a
    skewed one; this way both sides come by an exchange of the join's, or the small one by a broadcast.
    """
    return sized(materialize(df, label))


def later_occurrences(rows: DataFrame, key: str | list[str], place: list[str]) -> DataFrame:
    """Of rows with equal ``key``, those that are not at the first place (in the order of ``place``), with that as ``first``.

    The first places come from a partial aggregation, so a key of any frequency costs a row per task. They
    are written, so that both sides of the join come by an exchange of its own and a skewed one can be
    split; there is no other plan for small inputs.
    """
    at = F.struct(*place)
    key = [key] if isinstance(key, str) else key
    firsts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("first")).filter("_n > 1").drop("_n")
    return rows.join(materialize(firsts, "firsts"), key).filter(at > F.col("first"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Alternates large-star and small-star steps. Each round is written to the shared folder, so that
    lineage stays short and a lost executor costs one round at most; what a round has read is deleted. The
    loop ends when a round changes nothing, compared by count and an order-free hash; only those two
    numbers reach the driver.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges, before = materialize(pairs, "edges"), None
    while True:
        after = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            break
        before = after
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.filter("v > u").join(sized(lowest), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        centre = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "centre")
        small = (
            large.join(sized(centre), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(centre.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = materialize(small, "edges")
        for read in (edges, lowest, large, centre):
            drop(read)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
