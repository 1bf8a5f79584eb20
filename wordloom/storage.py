"""Shared scratch storage: lineage is cut only with tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of this process that ``clear_scratch`` removes.
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary folder and a cluster an error, as its executors share no
    folder of the driver's machine.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-"))
        current = sc._jsc.sc().getCheckpointDir()
    return str(current.get()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by ``clear_scratch`` or when the process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clear_at_exit)
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables made so far; call it when no result that reads them is needed any more."""
    while _scratch:
        remove(spark, _scratch.pop())


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            clear_scratch(spark)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_manifest(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Version ``version`` of the manifest of the table set below ``path``: written aside, then renamed; the one before the last goes."""
    fs, target = _fs(spark, f"{path}/manifest-{version:06d}.json")
    _, aside = _fs(spark, f"{path}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.rename(aside, target):
        raise RuntimeError(f"{path} was changed by another writer")
    remove(spark, f"{path}/manifest-{version - 2:06d}.json")


def read_manifest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """The last version and its content, or None where there is no manifest."""
    fs, p = _fs(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    names = [n for n in names if n.startswith("manifest-")]
    if not names:
        return None
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/{names[-1]}").collect())  # one line
    return int(names[-1][9:-5]), json.loads(text)


def bounded(df: DataFrame, max_rows: int) -> tuple[list, bool]:
    """Rows of a lookup table if it has at most ``max_rows``, and whether it has; never more than that is fetched."""
    rows = df.limit(max_rows + 1).collect()
    return (rows, True) if len(rows) <= max_rows else ([], False)


def broadcast_checked(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Hint a broadcast only after counting: beyond ``max_rows`` the join falls back to Catalyst's own choice."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as literals, so that no join is needed; an empty table gives nulls."""
    row = one.head()
    return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in one.schema.fields})


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that is read in fewer tasks than there are cores (one small file); a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
