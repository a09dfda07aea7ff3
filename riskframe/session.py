"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed state of streams is kept outside of the heap and saved as changes
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # batches for Python are cut by their size too: 10,000 long texts would not fit
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


# HotSpot does not compile methods above 8000 bytes, so a very wide projection fused into one
# method would run interpreted; past this limit Spark splits it into small methods instead.
# Aggregations are better left fused, hence two profiles.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
FUSED, SPLIT = "65535", "8000"


def prepare(spark: SparkSession, wide: bool = False) -> SparkSession:
    """Apply the settings in ``REQUIRED`` to a running session.

    ``wide`` is for jobs dominated by projections of dozens of derived columns, such as the
    payment features.
    """
    settings = REQUIRED | {METHOD_LIMIT: SPLIT if wide else FUSED}
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint()`` in the folder named by ``spark.checkpoint.dir``.

    A private temporary folder is used only when the session names none and runs in
    local mode; on a cluster a machine-local folder would not survive executor loss.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="riskframe-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
