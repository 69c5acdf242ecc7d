"""Session helpers: settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators assume.  Time zone only matters for LTZ timestamps;
# the library keeps commit times as TIMESTAMP_NTZ in UTC wall time.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "logweave",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or get) a session with the settings the operators expect.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to the
    data (roughly input bytes / 128 MB); locally it defaults to the core count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    # operators checkpoint reused intermediates; let the cleaner remove them
    # once they are no longer referenced
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Runtime settings safe to change on an existing session."""
    for k, v in SESSION_DEFAULTS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or connect-only settings
            pass


def checkpoint_dir(spark: SparkSession, local_fallback: bool = False) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Iterative operators cut lineage with ``DataFrame.checkpoint()``, which
    needs a folder every executor can reach.  On a cluster that folder comes
    from the session.  Only when it is unset *and* ``local_fallback`` is
    requested (tests, local bench) a fresh folder under the system temp dir
    is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not local_fallback:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared "
            "folder for checkpoint(). Set it on the session.")
    master = sc.master or ""
    if not master.startswith("local"):
        raise RuntimeError("refusing a machine-local checkpoint folder on a cluster; "
                           "set spark.checkpoint.dir")
    d = tempfile.mkdtemp(prefix="logweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logweave`` importable in Python workers (pandas UDF operators
    reference its functions): zip the package once per driver process and
    add it with ``addPyFile``, which Spark distributes to every executor.
    Equivalent to ``--py-files`` at submit time."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="logweave-pkg-"), "logweave.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def materialize(df):
    """``df.checkpoint()`` that evaluates ``df``'s last stage only once.

    An eager reliable checkpoint runs one job on the plan and a second one
    that writes the files; the second re-runs the last stage (earlier stages
    are reused from shuffle files).  That is cheap for plain DataFrame work,
    but wrong when the last stage calls user code with side effects (a
    labelling service): persist first, checkpoint, then drop the cached copy.
    """
    from pyspark import StorageLevel

    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared checkpoint folder, as a full URI, that goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, tag))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    return system.makeQualified(path).toString()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared checkpoint folder, removed when the application ends."""
    import uuid

    path = f"{checkpoint_dir(spark, local_fallback=True).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def stored(df, tag: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but runs the plan once.  ``drop_stored``
    removes the folder early; whatever is left goes when the application ends.
    The shuffle files of the write go when it ends, not with a later collection of garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df) -> None:
    """Remove a ``stored`` table that nothing reads any more."""
    drop_folder(df.sparkSession, df._stored_at)


def drop_folder(spark: SparkSession, folder: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
