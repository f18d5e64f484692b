"""Readers and writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSES = (
    "source_id string, url string, status_code int, headers map<string,string>, content binary, encoding string, fetched_at timestamp"
)
RULES = "source_id string, capability string, field string, rule string, _corrupt_record string"
CHAPTERS = (
    "id string, book_id string, source_chapter_id string, title string, url string, index int, content string, "
    "content_hash string, word_count int, created_at timestamp, updated_at timestamp"
)


def read_responses(spark: SparkSession, path: str, stream: bool = False, max_files_per_trigger: int = 1000) -> DataFrame:
    """Bodies landed by any fetcher; only successful ones are used. The condition reaches the Parquet scan."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger) if stream else spark.read
    return reader.schema(RESPONSES).parquet(path).filter(F.col("status_code") == 200)


def read_rules(spark: SparkSession, path: str, schema: str = RULES) -> tuple[DataFrame, DataFrame]:
    """Rule rows from JSON lines; rows that do not parse or lack a key come out as rejects instead of failing the read."""
    raw = (
        spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )
    broken = F.col("_corrupt_record").isNotNull() | F.col("source_id").isNull() | F.col("rule").isNull()
    return raw.filter(~broken).drop("_corrupt_record"), raw.filter(broken)


def read_assets(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,gif,webp}") -> DataFrame:
    """Image files as rows: path, modificationTime, length, content. Size filters are pushed into the listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None, cluster_by: list[str] | None = None) -> None:
    """The next snapshot of a table, into a new folder. Rows are range-sorted by the clustering columns, so that key
    filters skip row groups, and a hot key spans several files."""
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_pieces(pieces: DataFrame, path: str, tasks: int | None = None) -> None:
    """Export pieces as text: one folder per book and part, files in order. A large book is cut across tasks by range,
    and the file names of a folder sort in the order of the text."""
    keys = ["book_id", "part", "ord"]
    named = pieces.withColumn("part", F.regexp_replace("part", "/", "__"))
    placed = named.repartitionByRange(tasks, *keys) if tasks else named.repartitionByRange(*keys)
    # the writer ends every row with a newline, so the piece gives its own last newline away
    text = F.regexp_replace("content", r"\n\z", "")
    ordered = placed.sortWithinPartitions(*keys).select("book_id", "part", text.alias("value"))
    ordered.write.mode("errorifexists").partitionBy("book_id", "part").text(path)


FILE_BYTES = 128 * 1024 * 1024


def write_packed(pieces: DataFrame, path: str, tasks: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Export pieces (``book_id, part, ord, content``) as UTF-8 text in files of about ``file_bytes``, many books to a file, and an
    index: ``book_id, part, ord, file, offset, length`` in bytes.

    Pieces are cut by ranges of (book, part, ord), so the files follow that order, a book of any length spans tasks, and the
    number of files follows the bytes, not the books. A file is written under another name first, so a second attempt of a task
    replaces it whole. The index is written beside the files (``index``) and read back. Null contents count as empty.
    """
    keys = ["book_id", "part", "ord"]
    rows = pieces.select(*keys, F.coalesce("content", F.lit("")).alias("content"))
    placed = rows.repartitionByRange(tasks, *keys) if tasks else rows.repartitionByRange(*keys)
    schema = T.StructType([*rows.select(*keys).schema.fields, *T._parse_datatype_string("file string, offset long, length long").fields])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = pafs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        number, seq, out, at = TaskContext.get().partitionId(), 0, None, 0
        name = aside = ""
        for batch in batches:
            files, offsets, lengths = [], [], []
            for content in batch.column(3).to_pylist():
                if out is None:
                    name, aside, at = f"part-{number:06d}-{seq:04d}.txt", f"_part-{number:06d}-{seq:04d}.{uuid.uuid4().hex}", 0
                    out = system.open_output_stream(f"{root}/{aside}")
                body = content.encode("utf-8", "surrogatepass")
                out.write(body)
                files.append(name)
                offsets.append(at)
                lengths.append(len(body))
                at += len(body)
                if at >= file_bytes:
                    out.close()
                    system.move(f"{root}/{aside}", f"{root}/{name}")
                    out, seq = None, seq + 1
            columns = [*batch.columns[:3], pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if out is not None:
            out.close()
            system.move(f"{root}/{aside}", f"{root}/{name}")

    placed.sortWithinPartitions(*keys).mapInArrow(write, schema).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/index")
    return pieces.sparkSession.read.parquet(f"{path.rstrip('/')}/index")


def read_packed(index: DataFrame, path: str) -> DataFrame:
    """The pieces that rows of an index of ``write_packed`` stand for: its key columns and ``content``. Filter the index first to
    read a few books; a task reads the pieces of a file in the order of their places."""
    keys = ["book_id", "part", "ord"]
    schema = T.StructType([*index.select(*keys).schema.fields, T.StructField("content", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(path)
        name, source = None, None
        for batch in batches:
            contents = []
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns[3:]], strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{root}/{file}")
                contents.append(source.read_at(length, offset).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(contents, pa.string())], names=schema.names)
        if source is not None:
            source.close()

    return index.select(*keys, "file", "offset", "length").sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Every listing as one JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
