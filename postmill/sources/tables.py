"""Tables of the store, in any format that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str | None, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """S16. A table at a path (parquet, json, csv, orc), or of a database (kind jdbc, no path, options url and dbtable).

    Give the schema of json and csv, else Spark reads the data once more to find it."""
    reader = spark.read.format(kind).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.load(path) if path else reader.load()


def read_split(spark: SparkSession, url: str, table: str, column: str, parts: int, quote: str = '"', **options: str) -> DataFrame:
    """S16 from a database in `parts` queries over ranges of a numeric column, whose ends are asked for first. Filters on the result and
    the choice of columns go to the database; a null in the column is in the first part. `quote` is the database's mark of names."""
    source = {"url": url, **options}
    named = f"{quote}{column}{quote}"
    ends = spark.read.format("jdbc").options(**source, query=f"select min({named}) as low, max({named}) as high from {table}").load().first()
    if ends[0] is None:
        return spark.read.format("jdbc").options(**source, dbtable=table).load()
    bounds = {"partitionColumn": column, "lowerBound": str(ends[0]), "upperBound": str(int(ends[1]) + 1), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**source, dbtable=table, **bounds).load()


def write_table(df: DataFrame, path: str | None, kind: str = "parquet", by: tuple[str, ...] = (), mode: str = "error", **options: str) -> None:
    """S16. Write df; `by` lays rows out in folders by these columns, so that filters on them skip files."""
    writer = df.write.format(kind).mode(mode).options(**options)
    writer = writer.partitionBy(*by) if by else writer
    writer.save(path) if path else writer.save()
