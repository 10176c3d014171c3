"""Sessions for a single machine. On a cluster the driver's session is used as it is."""

from pyspark.sql import SparkSession


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8, **more: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1",
    } | more
    spark = SparkSession.builder.master(f"local[{cores}]").appName("tallyforge").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
