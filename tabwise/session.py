"""Session helpers: a local session for tests and the checkpoint folder rule.

The library never creates a session behind the caller's back; every public
function takes a DataFrame (and reads ``df.sparkSession`` when it needs one).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "tabwise") -> SparkSession:
    """A ``local[cores]`` session configured the way the tests and bench run."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``SparkContext`` at the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only a local-mode
    session (a single machine, as in tests) may fall back to a fresh temporary
    folder; on a cluster an unset value is an error, because a machine-local
    folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running tabwise on a cluster")
    path = tempfile.mkdtemp(prefix="tabwise-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: tasks that use its functions import it there.

    The archive is the driver's own file; Spark serves it to the executors as any ``--py-files`` entry.
    """
    import tabwise

    sc = spark.sparkContext
    if getattr(sc, "_tabwise_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(tabwise.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tabwise-code-"), "tabwise_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tabwise", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tabwise_shipped = True
