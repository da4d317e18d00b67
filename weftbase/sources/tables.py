"""Reading and writing the knowledge base's tables, logs and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbase import schemas


def read_jdbc(spark: SparkSession, url: str, table: str, key: str = "id", rows: int = 100_000, **options: str) -> DataFrame:
    """A relational table, read in parallel in ranges of its key of about ``rows`` rows each. Their borders are the
    key's own values at equal ranks, which the database finds in one query, so that gaps and clusters of keys make
    no large range; rows without a key come with the first. Repeated keys stay in one range."""
    load = lambda **what: spark.read.format("jdbc").options(url=url, **options, **what).load()
    total = int(load(query=f"SELECT COUNT(*) AS N FROM {table}").head()[0])
    ranks = range(rows, total, rows)
    if not ranks:
        return load(dbtable=table)
    ranked = [f"SELECT * FROM (SELECT {key} AS K FROM {table} WHERE {key} IS NOT NULL ORDER BY {key} OFFSET {n} ROWS FETCH NEXT 1 ROWS ONLY) R{i}" for i, n in enumerate(ranks)]
    borders: list = []
    for at in range(0, len(ranked), 100):
        borders += [r[0] for r in load(query=" UNION ALL ".join(ranked[at : at + 100])).collect()]
    marks = [_literal(b) for b in sorted(set(borders))]
    if not marks:
        return load(dbtable=table)
    ranges = [f"{key} < {marks[0]} OR {key} IS NULL", *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(marks, marks[1:], strict=False)], f"{key} >= {marks[-1]}"]
    return spark.read.jdbc(url, table, predicates=ranges, properties=dict(options))


def _literal(value: object) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def upsert_jdbc(df: DataFrame, url: str, table: str, key: str = "id", connections: int = 16, **options: str) -> None:
    """Rows of ``df`` into a relational table: those whose key it holds replace their columns, the others are added.
    Tasks fill a staging table; one MERGE statement then takes all of it or, where it fails, nothing. A key must not
    stand twice in ``df``. The table must have the columns of ``df`` and can have more."""
    spark, staging = df.sparkSession, f"{table}_STAGING"
    names = [c.upper() for c in df.columns]
    rows = df.toDF(*names).coalesce(connections)
    rows.write.format("jdbc").options(url=url, dbtable=staging, **options).mode("overwrite").save()
    own = key.upper()
    changed = ", ".join(f"T.{c} = S.{c}" for c in names if c != own)
    merge = f"MERGE INTO {table} T USING {staging} S ON T.{own} = S.{own}" + (f" WHEN MATCHED THEN UPDATE SET {changed}" if changed else "")
    merge += f" WHEN NOT MATCHED THEN INSERT ({', '.join(names)}) VALUES ({', '.join('S.' + c for c in names)})"
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for k, v in options.items():
        settings.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        statement = connection.createStatement()
        statement.executeUpdate(merge)
        statement.executeUpdate(f"DROP TABLE {staging}")
    finally:
        connection.close()


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    (df.write.mode(mode).partitionBy(by) if by else df.write.mode(mode)).parquet(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The chunk store: text, metadata and vector of an entry in one row."""
    return spark.read.parquet(path)


def write_entries(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Entries with a source_type column, in one folder per source type."""
    write_table(entries, path, mode, "source_type")


def write_keyed(df: DataFrame, name: str, key: str = "chunk_id", buckets: int = 64) -> DataFrame:
    """A table in ``buckets`` by the hash of its key, each sorted by it. Tables that have the same buckets join and
    aggregate by the key where they lie: only what is not so stored moves. Take so many buckets that one is a
    task's work; a table's buckets are never changed in place. Returns the table."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def clear_table(spark: SparkSession, path: str, schema: str) -> None:
    """Leave a table of this schema without rows."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str = schemas.PROGRESS) -> DataFrame:
    """JSON lines of a progress, error or resource log; broken lines give null columns."""
    return spark.read.schema(schema).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_chunk_ids(chunks: DataFrame, path: str) -> None:
    """The ids of chunks as JSON lines, in order."""
    chunks.select(F.col("id").alias("chunk_id")).sortWithinPartitions("chunk_id").write.mode("overwrite").json(path)


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Work records from a JSON dump; title and container title may be strings or lists."""
    from pyspark.sql.types import StringType, StructField, StructType

    raw = spark.read.schema(StructType([StructField("value", StringType())])).text(path)
    work = F.try_parse_json(F.col("value"))
    get = lambda p, t: F.try_variant_get(work, p, t)
    listed = lambda p: F.coalesce(get(p, "array<string>"), F.when(get(p, "string").isNotNull(), F.array(get(p, "string"))))
    author = "array<struct<family:string,given:string>>"
    return raw.select(
        get("$.DOI", "string").alias("DOI"), listed("$.title").alias("title"), listed("$['container-title']").alias("container_title"),
        F.coalesce(get("$.author", author), get("$.authors", author)).alias("author"),
        get("$['published-print']['date-parts'][0][0]", "int").alias("year_print"), get("$['published-online']['date-parts'][0][0]", "int").alias("year_online"), get("$.created['date-parts'][0][0]", "int").alias("year_created"),
        get("$.volume", "string").alias("volume"), get("$.issue", "string").alias("issue"), get("$.page", "string").alias("page"),
    ).filter("DOI is not null")


DATACITE = "DOI string, titles array<struct<title:string>>, container struct<title:string>, creators array<struct<name:string>>, publicationYear int, dates array<struct<date:string,dateType:string>>"


def read_datacite(spark: SparkSession, path: str) -> DataFrame:
    """DataCite's records (the ``attributes`` of one work a line) from a JSON dump; lines that are no JSON, or have no DOI, go."""
    schema = DATACITE.replace("DOI ", "doi ")
    return spark.read.schema(schema).json(path).withColumnRenamed("doi", "DOI").filter("DOI is not null")


def pdf_inventory(spark: SparkSession, folder: str, most: int = 50 * 1024 * 1024) -> DataFrame:
    """path, modificationTime, length of the PDF files of a folder up to a size; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime", "length").filter(F.col("length") <= most)
