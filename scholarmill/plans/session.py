"""Session factory."""

from pyspark.sql import SparkSession


def session(app: str = "scholarmill", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings are kept where none is given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
