"""Trigram signatures: which files of a stored table can hold a keyword at all.

A signature is a bitmap of 32,768 bits per file: the byte trigrams of its case-folded bodies, hashed. A keyword can only be in
files whose bitmap has all its trigrams, so a search opens those files and checks their bodies as the plain scan does. Signatures are
a narrow table beside the chapters (four kilobytes a file) and are made when a file is written, or later from the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import contains_keyword

#: Fixed by the bitmap functions of Spark.
BITS = 32_768
BYTES = BITS // 8
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _places(folded: bytes) -> np.ndarray:
    """Bits of the trigrams of a text of bytes."""
    b = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return mixed >> np.uint32(17)


def file_signatures(spark: SparkSession, path: str, content: str = "content") -> DataFrame:
    """``file, signature`` for every file below ``path`` that holds rows. A task hands on one bitmap per file it has read, and
    bitmaps of a file are united by the built-in aggregate; null bodies have no trigrams."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col(content).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[str, np.ndarray] = {}
        for batch in batches:
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here = flags.setdefault(file, np.zeros(BITS, np.uint8))
                if body:
                    here[_places(body.encode("utf-8", "surrogatepass").translate(_FOLD))] = 1
        packed = [np.packbits(f, bitorder="little").tobytes() for f in flags.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(flags), pa.string()), pa.array(packed, pa.binary())], names=["file", "part"])

    return rows.mapInArrow(run, "file string, part binary").groupBy("file").agg(F.bitmap_or_agg("part").alias("signature"))


def may_hold(signature: Column, keyword: str) -> Column:
    """Whether all trigrams of a keyword are in a signature; keywords of fewer than three bytes may be anywhere."""
    def bit(place: int) -> Column:
        byte = F.conv(F.hex(F.substring(signature, place // 8 + 1, 1)), 16, 10).cast("int")
        return byte.bitwiseAND(F.lit(1 << place % 8)) != 0

    places = np.unique(_places(keyword.encode("utf-8", "surrogatepass").translate(_FOLD))).tolist()
    return reduce(lambda a, b: a & b, map(bit, places), F.lit(True))


def candidate_files(signatures: DataFrame, keyword: str) -> list[str]:
    """Files that may hold the keyword; names of files, as any listing of a table, are the driver's."""
    return sorted(r[0] for r in signatures.filter(may_hold(F.col("signature"), keyword)).select("file").collect())


def scan_indexed(spark: SparkSession, path: str, signatures: DataFrame, keyword: str, content: str = "content") -> DataFrame:
    """The rows of a stored table whose body holds the keyword (literal, ASCII case ignored), reading only files that may hold it.

    ``signatures`` must cover the files below ``path`` as they are now: files without a signature are not looked at. An empty keyword
    matches nothing. Partition columns of the path are kept.
    """
    whole = spark.read.parquet(path)
    files = candidate_files(signatures, keyword) if keyword else []
    if not files:
        return whole.limit(0)
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*files).filter(contains_keyword(content, keyword))
