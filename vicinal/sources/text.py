"""Vectors in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.errors import FileFormatError
from vicinal.sources.knnbin import write_knnbin


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file, or of all files of a folder in the order of their names; lines sort in order."""
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(line.alias("line"), "value")


def _consecutive(df: DataFrame) -> DataFrame:
    """(id, vec) with ids 0, 1, ... in the order of `line`, by counts of the files' blocks rather than a global sort."""
    blocks = df.groupBy("line.file", "line.block").agg(F.count("*").alias("n"))
    before = blocks.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))  # one row for each block
    inside = F.row_number().over(Window.partitionBy("line.file", "line.block").orderBy("line.at")) - 1
    rows = df.withColumn("inside", inside).select("inside", "vec", F.col("line.file").alias("file"), F.col("line.block").alias("block"))
    return rows.join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("inside")).cast("bigint").alias("id"), "vec")


def _row(line):
    return F.struct(F.lit(line["file"]).alias("file"), F.lit(line["block"]).cast("bigint").alias("block"), F.lit(line["at"]).cast("bigint").alias("at"))


def _write_text(head: list[str], rows: DataFrame, path: str) -> None:
    """Writes (id, value) rows as a folder of text parts in the order of ids, after the head's lines."""
    first = rows.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "id bigint, value string") if head else None
    rows = rows if first is None else first.union(rows)
    rows.repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


def read_vector_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file of two lines with the numbers of rows and columns, then comma-separated rows: (id, vec)."""
    lines = _numbered(spark, path)
    head = [r["value"] for r in lines.orderBy("line").limit(2).collect()]
    first = lines.orderBy("line").limit(2).agg(F.max("line").alias("m")).first()["m"]
    if len(head) < 2 or not all(h.strip().isdigit() for h in head):
        raise FileFormatError(f"{path}: the first two lines must be the numbers of rows and columns")
    body = lines.where((F.col("line") > _row(first)) & (F.trim("value") != ""))
    return _consecutive(body.select("line", F.split("value", ",").cast("array<float>").alias("vec")))


def write_vector_csv(df: DataFrame, path: str) -> None:
    """Writes (id, vec) as a folder of text parts in the order of ids, the two count lines first."""
    n, d = df.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    _write_text([str(n), str(d)], df.select("id", _joined(",").alias("value")), path)


def _joined(by: str):
    return F.array_join(F.col("vec").cast("array<string>"), by)


def write_arff(df: DataFrame, path: str, relation: str = "vectors") -> None:
    """Writes (id, vec) as a folder of parts in the order of ids, the first with the numeric attributes before `@data`."""
    d = df.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    head = [f"@relation {relation}", *(f"@attribute x{i} numeric" for i in range(d)), "@data"]
    _write_text(head, df.select("id", _joined(",").alias("value")), path)


def write_libsvm(df: DataFrame, path: str, label: str = "0") -> None:
    """Writes (id, vec) as `label index:value ...` lines in a folder of parts in the order of ids; indices start at 1 and zeros are left out."""
    entries = F.filter(F.transform("vec", lambda x, i: F.when(x != 0, F.concat_ws(":", (i + 1).cast("string"), x.cast("string")))), lambda t: t.isNotNull())
    _write_text([], df.select("id", F.concat_ws(" ", F.lit(label), F.array_join(entries, " ")).alias("value")), path)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The numeric rows after `@data`, all columns as features: (id, vec).  Comments and blank lines are skipped."""
    lines = _numbered(spark, path)
    mark = lines.where(F.lower(F.trim("value")) == "@data").agg(F.min("line").alias("m")).first()["m"]
    if mark is None:
        raise FileFormatError(f"{path}: no @data line")
    body = lines.where((F.col("line") > _row(mark)) & ~F.trim("value").rlike("^(%.*)?$"))
    return _consecutive(body.select("line", F.split(F.trim("value"), r"\s*,\s*").cast("array<float>").alias("vec")))


def read_libsvm(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """`label index:value ...` lines as dense vectors without their labels: (id, vec); indices start at 1."""
    pairs = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t.contains(":")), lambda t: F.struct(F.split(t, ":")[0].cast("int").alias("i"), F.split(t, ":")[1].cast("float").alias("x")))
    rows = _numbered(spark, path).where(F.trim("value") != "").select("line", pairs.alias("pairs"))
    if dims is None:
        dims = rows.agg(F.max(F.array_max(F.col("pairs.i")))).first()[0] or 0
    entries = F.map_from_entries("pairs")
    dense = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.coalesce(F.element_at(entries, i), F.lit(0.0).cast("float")))
    return _consecutive(rows.select("line", dense.alias("vec")))


def convert_to_knnbin(spark: SparkSession, source: str, target: str) -> None:
    """Converts an .arff, .libsvm or .csv file to the binary format, by its extension."""
    kind = source.rsplit(".", 1)[-1].lower()
    readers = {"arff": read_arff, "libsvm": read_libsvm, "csv": read_vector_csv}
    if kind not in readers:
        raise FileFormatError(f"{source}: no reader for .{kind}")
    write_knnbin(readers[kind](spark, source), target)
