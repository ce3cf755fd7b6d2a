"""A Spark session with the settings the plans assume."""

from pyspark.sql import SparkSession


def get_session(name: str = "vigilake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; everything else is the cluster's business or ``conf``'s."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A folder that every executor sees: below spark.checkpoint.dir, or in local mode a temporary one."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/vigilake-checkpoints"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
