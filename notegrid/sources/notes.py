"""Reading notes and evaluation cases, publishing an index, writing reports."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import norm_path, stripped
from ..operators.index import validate_index

# Folders that do not count.
EXCLUDED = (".obsidian", "_plantillas", "_templates")
#: Bytes of files that a task hands on at once.
READ_BYTES = 16 << 20
QUERY_TYPES = ("factual", "relational", "hybrid", "out_of_domain")


class NoteListing(DataSource):
    """Format `note_listing`: path (relative), size and mtime of all .md files below the path, whatever their names begin with.

    Spark's own lister leaves out names that start with _. Folders that do not count are not entered. The folders of the
    first levels are the partitions, so large trees are listed by many tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "note_listing"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"], int(self.options.get("folders", "64")))


class _ListingReader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root, folders

    def partitions(self) -> list[InputPartition]:
        """Folders to list with all below them, and folders of which only the files are left."""
        fs, root = file_system(self.root)
        shallow, deep = [], [""]
        for _ in range(4):
            if not deep or len(deep) >= self.folders:
                break
            shallow, deep = shallow + deep, [f"{d}/{n}".lstrip("/") for d in deep for n in _subfolders(fs, f"{root}/{d}")]
        return [InputPartition((d, False)) for d in shallow] + [InputPartition((d, True)) for d in deep]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, root = file_system(self.root)
        waiting = [partition.value[0]]
        while waiting:
            folder = waiting.pop()
            for info in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}".rstrip("/"))):
                path = f"{folder}/{info.base_name}".lstrip("/")
                if info.type == pafs.FileType.Directory:
                    if partition.value[1] and _counts(info.base_name):
                        waiting.append(path)
                elif info.base_name.lower().endswith(".md") and not info.base_name.startswith("."):
                    yield path, info.size, info.mtime


def _counts(folder: str) -> bool:
    return not folder.startswith(".") and folder.casefold() not in EXCLUDED


def _subfolders(fs: pafs.FileSystem, folder: str) -> list[str]:
    infos = fs.get_file_info(pafs.FileSelector(folder.rstrip("/")))
    return sorted(i.base_name for i in infos if i.type == pafs.FileType.Directory and _counts(i.base_name))


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local or shared folders, hdfs, s3), and the path in it."""
    local = re.sub(r"^file:/+", "/", root.rstrip("/"))
    return (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(local)


def list_notes(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(NoteListing)
    return spark.read.format("note_listing").load(root)


def read_notes(spark: SparkSession, root: str, paths: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """path (relative), raw, sha256, mtime of the .md files below root, or of those (relative) paths alone.

    With known (path, mtime), only files that are new or have another mtime are opened. Files are listed
    first, then dealt evenly and read in the tasks.
    """
    files = list_notes(spark, root)
    if paths is not None:
        files = files.join(F.broadcast(spark.createDataFrame([(p,) for p in paths], "path string")), "path", "left_semi")
    if known is not None:
        old = known.select(F.col("path").alias("__p"), F.col("mtime").alias("__m"))
        files = files.join(old, (F.col("path") == F.col("__p")) & (F.col("mtime") == F.col("__m")), "left_anti")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            held, size, first = [], 0, 0
            for at, path in enumerate(batch.column(0).to_pylist()):
                with fs.open_input_stream(f"{base}/{path}") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size > READ_BYTES or at + 1 == batch.num_rows:
                    part = batch.slice(first, at + 1 - first)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.binary()), part.column(1)], names=["path", "content", "mtime"])
                    held, size, first = [], 0, at + 1

    dealt = files.select("path", "mtime").repartition(max(2, spark.sparkContext.defaultParallelism), "path")
    return note_rows(dealt.mapInArrow(read, "path string, content binary, mtime timestamp"))


def write_notes(files: DataFrame, root: str) -> None:
    """One file below root for each row of files (path, content)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs.create_dir(f"{base}/{path}".rpartition("/")[0])
                with fs.open_output_stream(f"{base}/{path}") as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    files.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def note_rows(files: DataFrame) -> DataFrame:
    """The same from path, content (binary) and mtime: folders that do not count go, text is repaired and its newlines made one kind."""
    parts = F.split(F.translate("path", "\\", "/"), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(parts, lambda x: F.startswith(x, F.lit("."))) | F.exists(folders, lambda x: F.lower(x).isin(*EXCLUDED))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    raw = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return files.filter(~hidden & F.lower("path").endswith(".md")).select(
        F.array_join(parts, "/").alias("path"), raw.alias("raw"), F.sha2("content", 256).alias("sha256"), "mtime"
    )


CASE = (
    "id string, question string, expected_paths array<string>, expect_abstention boolean, expected_terms string, query_type string, "
    "forbidden_paths array<string>, tags array<string>, status string, vigencia string, expand_links boolean, requires_semantic boolean"
)


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) of the `cases` of JSON files."""
    files = spark.read.schema(f"cases array<struct<{', '.join(x.replace(' ', ':', 1) for x in CASE.split(', '))}>>").option("multiLine", "true").json(path)
    return split_cases(files.select(F.inline("cases")))


def split_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trims and completes cases, and parts those that break a rule from the others; one aggregation finds repeated ids."""
    empty = F.array().cast("array<string>")
    groups = F.coalesce(F.from_json("expected_terms", "array<string>"), empty)  # inner arrays stay as text here
    as_group = lambda t: F.when(F.startswith(stripped(t), F.lit("[")), F.from_json(t, "array<string>")).otherwise(F.array(t))
    clean = cases.select(
        stripped("id").alias("id"),
        stripped("question").alias("question"),
        F.transform(F.coalesce("expected_paths", empty), norm_path).alias("expected_paths"),
        F.transform(F.coalesce("forbidden_paths", empty), norm_path).alias("forbidden_paths"),
        F.coalesce("expect_abstention", F.lit(False)).alias("expect_abstention"),
        F.transform(groups, as_group).alias("expected_terms"),
        F.lower(stripped("query_type")).alias("query_type"),
        *[c for c in ("tags", "status", "vigencia", "expand_links", "requires_semantic") if c in cases.columns],
    ).withColumn("query_type", F.coalesce(F.nullif("query_type", F.lit("")), F.when(F.col("expect_abstention"), "out_of_domain").otherwise("factual")))
    repeated = clean.groupBy("id").agg(F.count("*").alias("__n"))
    reason = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id")
        .when(F.coalesce(F.col("question"), F.lit("")) == "", "missing question")
        .when(F.col("__n") > 1, "repeated id")
        .when(F.col("expect_abstention") & (F.size("expected_paths") > 0), "abstention with expected paths")
        .when(~F.col("expect_abstention") & (F.size("expected_paths") == 0), "answerable without expected paths")
        .when(~F.col("query_type").isin(*QUERY_TYPES), "unknown query type")
    )
    judged = clean.join(repeated, clean["id"].eqNullSafe(repeated["id"]), "left").drop(repeated["id"]).withColumn("reason", reason).drop("__n")
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def publish_index(spark: SparkSession, tables: Mapping[str, DataFrame], dest: str, run_id: str, expected: Mapping[str, int] | None = None) -> DataFrame:
    """Writes a version of the tables, checks it as it lies there, and only then makes it the current one.

    Returns the checks, taken once more of what is current then. If one fails, ValueError, and the version
    before stays or becomes current again: a manifest row is what makes a version current.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{dest}/{run_id}/{name}")
    staged = {name: spark.read.parquet(f"{dest}/{run_id}/{name}") for name in tables}
    checks = validate_index(staged, expected if expected is not None else {name: df.count() for name, df in tables.items()})
    if not checks.filter(~F.col("ok")).isEmpty():
        raise ValueError(f"run {run_id} is not valid")
    before = _published(spark, dest)
    _announce(spark, dest, run_id)
    active = validate_index(load_index(spark, dest, list(tables)), {r.check.removeprefix("count "): r.expected for r in checks.collect() if r.check.startswith("count ")})
    if not active.filter(~F.col("ok")).isEmpty():
        if before:
            _announce(spark, dest, before)
        raise ValueError(f"run {run_id} was not valid after it had become current")
    return active


def _announce(spark: SparkSession, dest: str, run_id: str) -> None:
    spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("published_at")).write.mode("append").json(f"{dest}/manifest")


def _published(spark: SparkSession, dest: str) -> str | None:
    """The current run, null before the first."""
    try:
        manifest = spark.read.schema("run_id string, published_at timestamp").json(f"{dest}/manifest")
        return manifest.agg(F.max_by("run_id", F.struct("published_at", "run_id"))).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_index(spark: SparkSession, dest: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the version that was published last."""
    run = _published(spark, dest)
    return {n: spark.read.parquet(f"{dest}/{run}/{n}") for n in names}


def percent(c: str) -> F.Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.1f %%", F.col(c) * 100)).otherwise("N/A")


def report_rows(metrics: DataFrame, name: str, values: list[str]) -> DataFrame:
    """line: the rows of a Markdown table, percentages to one place, N/A for null."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name).cast("string"), *[percent(v) for v in values]), F.lit(" |"))
    return metrics.select(cells.alias("line"))


def write_report(cases: DataFrame, metrics: DataFrame, dest: str, name: str, values: list[str]) -> None:
    """Case rows and metric rows as JSON, and the metrics as a Markdown table (few rows: one file)."""
    cases.write.mode("overwrite").json(f"{dest}/cases")
    metrics.write.mode("overwrite").json(f"{dest}/metrics")
    spark = metrics.sparkSession
    head = [f"| {name} | {' | '.join(values)} |", f"|{'---|' * (len(values) + 1)}"]
    lines = spark.range(1).select(F.posexplode(F.array(*map(F.lit, head)))).select(F.col("pos").alias("o"), F.col("col").alias("line"))
    body = report_rows(metrics, name, values).withColumn("o", F.lit(len(head)))
    lines.select("o", "line").unionByName(body.select("o", "line")).coalesce(1).sortWithinPartitions("o", "line").select("line").write.mode("overwrite").text(f"{dest}/table")
