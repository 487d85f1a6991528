"""Options for Spark's own JDBC source (PostgreSQL, Trino)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# JDBC driver classes by database.
DRIVERS = {"postgresql": "org.postgresql.Driver", "trino": "io.trino.jdbc.TrinoDriver"}


def jdbc_options(
    database: str,
    url: str,
    table: str,
    user: str,
    password: str | None = None,
    *,
    ssl: bool = False,
    schema: str | None = None,
    partition: tuple[str, int, int, int] | None = None,
    one_task: bool = False,
) -> dict[str, str]:
    """``partition`` is (column, lower, upper, tasks).

    Without it Spark reads the table in one task, so that has to be asked for: ``one_task``.
    """
    if (partition is None) != one_task:
        raise ValueError("give a partition, or one_task=True for a table that one task can read")
    if database not in DRIVERS:
        raise ValueError(f"database must be one of {sorted(DRIVERS)}, not {database!r}")
    if not url.startswith("jdbc:"):
        url = f"jdbc:{database}://{url}"
    options = {"url": url, "driver": DRIVERS[database], "user": user}
    options["dbtable"] = f"{schema}.{table}" if schema else table
    if password is not None:
        options["password"] = password
    if ssl:
        options["ssl" if database == "postgresql" else "SSL"] = "true"
    if partition is not None:
        column, lower, upper, tasks = partition
        options.update(
            partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(tasks)
        )
    return options


def read_jdbc(spark: SparkSession, *args, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(*args, **kwargs)).load()
