"""Search for many keywords at once: one automaton over a table of keywords, one pass over the bodies."""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.core import strip
from pagemill.functions.text import fold_ascii_case
from pagemill.session import scratch_folder

#: Bytes of keywords that one automaton is built from; larger tables are searched in several passes.
AUTOMATON_BYTES = 8 * 1024 * 1024
CONTEXT = 30
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(folder: str) -> ahocorasick.Automaton:
    """The automaton of one block of keywords, once per worker; a worker keeps the last one only."""
    if folder not in _built:
        _built.clear()
        system, path = pafs.FileSystem.from_uri(folder)
        built = ahocorasick.Automaton()
        for batch in pads.dataset(path, filesystem=system, format="parquet").to_batches(columns=["folded", "keywords"]):
            for folded, keywords in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                built.add_word(folded, (len(folded), keywords))
        built.make_automaton()
        _built[folder] = built
    return _built[folder]


def _hits(built: ahocorasick.Automaton, body: str) -> dict[str, tuple[int, int]]:
    """Keywords that occur in a body, with the place and length of the first hit."""
    first: dict[str, tuple[int, int]] = {}
    for end, (length, keywords) in built.iter(body.translate(_FOLD)):
        for keyword in keywords:
            if keyword not in first:
                first[keyword] = (end - length + 1, length)
    return first


def search_keywords(chapters: DataFrame, keywords: DataFrame, content: str = "content", block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``book_id, id, index, keyword, snippet`` for every keyword (column ``keyword`` of a table) that a body holds.

    As ``search_many``: literal, ASCII case ignored, one row per chapter and keyword, the snippet shows the first hit. The keywords
    are written to the shared folder in blocks of at most about ``block_bytes``; every worker builds the automaton of a block once
    and runs each body through it once, whatever the number of keywords. Null and empty keywords and null bodies match nothing;
    keywords that differ in case only are reported each.
    """
    spark = chapters.sparkSession
    words = keywords.select(F.col("keyword").cast("string").alias("keyword")).filter(F.col("keyword") != "").distinct()
    total = words.agg(F.coalesce(F.sum(F.octet_length("keyword") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    folder = f"{scratch_folder(spark).rstrip('/')}/keywords-{spark._jvm.java.util.UUID.randomUUID()}"
    folded = words.groupBy(fold_ascii_case("keyword").alias("folded")).agg(F.sort_array(F.collect_list("keyword")).alias("keywords"))
    placed = folded.withColumn("block", F.pmod(F.xxhash64("folded"), F.lit(blocks)).cast("int"))
    placed.repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    kept = [c for c in ("book_id", "id", "index") if c in chapters.columns]
    rows = chapters.filter(F.col(content).isNotNull()).select(*kept, F.col(content).cast("string").alias("_body"))
    out = T.StructType([*rows.select(*kept).schema.fields, *T._parse_datatype_string("keyword string, _cut string, _head boolean, _tail boolean").fields])
    used = [r[0] for r in placed.select("block").distinct().collect()]  # one small number per block

    def scan(block: int):  # noqa: ANN202
        path = f"{folder}/block={block}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = _automaton(path)
            for batch in batches:
                at, found, cuts, heads, tails = [], [], [], [], []
                for row, body in enumerate(batch.column(len(kept)).to_pylist()):
                    for keyword, (begin, length) in _hits(built, body).items():
                        lo, hi = max(0, begin - CONTEXT), min(len(body), begin + length + CONTEXT)
                        for column, value in zip((at, found, cuts, heads, tails), (row, keyword, body[lo:hi], lo > 0, hi < len(body)), strict=True):
                            column.append(value)
                index = pa.array(at, pa.int64())
                columns = [batch.column(k).take(index) for k in range(len(kept))]
                columns += [pa.array(found, pa.string()), pa.array(cuts, pa.string()), pa.array(heads, pa.bool_()), pa.array(tails, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

        return rows.mapInArrow(run, out)

    if not used:
        return rows.select(*kept, F.lit("").alias("keyword"), F.lit("").alias("snippet")).limit(0)
    snippet = F.concat(F.when(F.col("_head"), "…").otherwise(""), strip("_cut"), F.when(F.col("_tail"), "…").otherwise(""))
    return reduce(DataFrame.unionByName, map(scan, sorted(used))).select(*kept, "keyword", snippet.alias("snippet"))
