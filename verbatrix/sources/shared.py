"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from verbatrix.errors import EngineError

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests on one machine, a
    temporary folder of our own. On a cluster a folder of one machine won't do."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise EngineError("INVALID_ARGS", "spark.checkpoint.dir is not set", "name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="verbatrix-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table that is read instead of recomputed and that
    outlives lost executors."""
    path = f"{folder(df.sparkSession)}/verbatrix-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(df: DataFrame) -> bool:
    """Whether the files that ``df`` reads still exist."""
    spark = df.sparkSession
    files = df.inputFiles()
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0]) if files else None
    return path is not None and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
