"""Segments and metadata in tables of a database or of a Spark catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.sources.storage import Store


class TableStore(Store):
    """A store whose rows stand in tables, each with the batch that brought it. Which batches count is in the same log as for
    files, under ``path``, so that a batch becomes visible as a whole however many tasks write it.

    Times are milliseconds, lists are JSON, as databases differ in both. Predicates on gid and time go to the source: bounds on
    times become bounds on the stored numbers.
    """

    def insert(self, df: DataFrame, table: str) -> None:
        raise NotImplementedError

    def rows(self, table: str) -> DataFrame:
        raise NotImplementedError

    def folder(self, df: DataFrame, table: str, batch: str | None = None, rows_a_file: int | None = None) -> str:
        name = self.batch_name(batch)
        out = []
        for f in df.schema.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, T.ArrayType):
                c = F.to_json(c)
            elif isinstance(f.dataType, T.TimestampType):
                c = F.unix_millis(c)
            out.append(c.alias(f.name))
        self.insert(df.select(*out, F.lit(name).alias("batch")), table)
        return name

    def read(self, table: str, schema: str, state: dict | None = None) -> DataFrame:
        state = state or self.state()[1]
        known = T.StructType.fromJson(state["schemas"][table]) if table in state["schemas"] else T._parse_datatype_string(schema)
        names = state["tables"].get(table, [])
        if not names:
            return self.spark.createDataFrame([], known)
        df = self.rows(table)
        df = df.toDF(*[c.lower() for c in df.columns]).where(F.col("batch").isin(*names))
        out = []
        for f in known.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, T.ArrayType):
                c = F.from_json(c, f.dataType)
            elif isinstance(f.dataType, T.TimestampType):
                c = F.timestamp_millis(c)
            out.append(c.cast(f.dataType).alias(f.name))
        return df.select(*out)


class CatalogStore(TableStore):
    """Tables of a Spark catalog, in ``namespace``: of Hive, Iceberg, Cassandra or whatever the session has a catalog for.
    ``provider`` is the format of tables that are made. A batch that comes again after a failure gets a name of its own, and
    what an attempt before left counts for nothing."""

    def __init__(self, spark: SparkSession, path: str, namespace: str, provider: str | None = None):
        super().__init__(spark, path)
        self.namespace, self.provider = namespace, provider
        self.format = provider or self.format

    def insert(self, df: DataFrame, table: str) -> None:
        w = df.write.format(self.provider) if self.provider else df.write
        w.mode("append").saveAsTable(f"{self.namespace}.{table}")

    def rows(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.namespace}.{table}")

    def folder(self, df: DataFrame, table: str, batch: str | None = None, rows_a_file: int | None = None) -> str:
        return super().folder(df, table, None, rows_a_file)

    def append_segments(self, segments: DataFrame, batch: str | None = None, temporary: DataFrame | None = None, rows_a_file: int | None = None) -> None:
        """As for files, but a batch that the log has taken isn't taken again."""
        if batch is not None and batch in self.state()[1].get("taken", []):
            return
        super().append_segments(segments, batch, temporary, rows_a_file)

    def vacuum(self, older_than_ms: int = 0) -> list[str]:
        """Left to the catalog: not every one can delete rows."""
        return []


class JdbcStore(TableStore):
    """Tables of a database, over JDBC. ``options`` are those of Spark's JDBC source (user, driver, fetchsize, ...)."""

    def __init__(self, spark: SparkSession, path: str, url: str, **options: str):
        super().__init__(spark, path)
        self.url, self.options = url, options
        self.quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
        self.batch = self.quoted("batch")

    def insert(self, df: DataFrame, table: str) -> None:
        w = df.write.format("jdbc").options(url=self.url, dbtable=self.quoted(table), **self.options)
        w.option("createTableColumnTypes", "batch VARCHAR(200)").mode("append").save()  # to be compared, where text is a large object

    def rows(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=self.quoted(table), **self.options).load()

    def execute(self, statement: str) -> None:
        """On a connection of Spark's own driver registry; a table that isn't there is passed over."""
        jvm = self.spark._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            s = connection.createStatement()
            s.executeUpdate(statement)
        except Exception as e:  # noqa: BLE001 - a Java exception
            if not any(x in str(e) for x in ("does not exist", "not found", "doesn't exist", "no such table")):
                raise
        finally:
            connection.close()

    def folder(self, df: DataFrame, table: str, batch: str | None = None, rows_a_file: int | None = None) -> str:
        if batch is not None:
            self.execute(f"DELETE FROM {self.quoted(table)} WHERE {self.batch} = '{self.batch_name(batch)}'")  # of an attempt before
        return super().folder(df, table, batch, rows_a_file)

    def vacuum(self, older_than_ms: int = 0) -> list[str]:
        """Deletes rows of batches that the state doesn't name. Run it while nobody writes: a batch's age isn't known."""
        tables = self.state()[1]["tables"]
        for table in ("segment", "temporary", "time_series", "model_type"):
            named = ", ".join(f"'{n}'" for n in tables.get(table, []))
            self.execute(f"DELETE FROM {self.quoted(table)}" + (f" WHERE {self.batch} NOT IN ({named})" if named else ""))
        return []
