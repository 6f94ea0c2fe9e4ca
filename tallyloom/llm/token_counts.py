"""Token counts of flat, unindexed token files by a separator scan.

A token file is identifiers one after the other (two or four bytes each, little-endian) with an end-of-document
identifier behind each document, and nothing that tells where documents are. Files are cut into blocks of a fixed number
of identifiers, each block is searched for the separator in one vectorised comparison, and boundaries are stitched across
blocks by a prefix scan over block summaries: how many documents ended before a block, and where the last one ended.

`write_files` makes such files from a table, one for each task and attempt; a task that is run again writes a new file
and only the files that the finished tasks name are read, so lost executors leave no half-written input behind.

Documents of no tokens are counted as such. An unended tail of a file is one more document if it has identifiers.
Nulls and empty texts have no tokens; repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import Store

#: Identifiers in a block: 4 MiB of two-byte identifiers.
BLOCK = 1 << 21
#: The scan of a file starts anew after so many blocks, whose totals are then scanned; bounds what one task sorts.
RUN = 4096


@lru_cache(maxsize=4)
def _encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoder(ranks_path: str, pattern: str) -> Callable[[str], list[int]]:
    return _encoding(ranks_path, pattern).encode_ordinary


def _opened(url: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(url)


def write_files(docs: DataFrame, folder: str, ranks_path: str, pattern: str, separator: int, width: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a token file for each task; rows (file, n_ids, nth, key) say which document was put where in its file."""
    kind = np.dtype("<u2" if width == 2 else "<u4")
    schema = pa.schema([("file", pa.string()), ("nth", pa.int64()), (key, pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, out, nth, size = encoder(ranks_path, pattern), f"{folder}/{uuid.uuid4().hex}.bin", None, 0, 0
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                if out is None:
                    fs, path = _opened(file)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                flat: list[int] = []
                for t in part.column(text).to_pylist():
                    flat += encode(t or "")
                    flat.append(separator)
                out.write(np.array(flat, kind).tobytes())
                size += len(flat)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(nth, nth + n), pa.int64()), part.column(key).cast(pa.int64()), pa.array([size] * n, pa.int64())], schema=schema)
                nth += n
        if out is not None:
            out.close()

    return docs.select(key, text).mapInArrow(run, f"file string, nth long, `{key}` long, n_ids long")


def summaries(spans: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """Of each (file, block, first, n): the block's separators as places in the file, ascending."""
    kind = np.dtype("<u2" if width == 2 else "<u4")
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, first, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                fs, path = _opened(file)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(n * width, first * width), kind)
                ends = np.flatnonzero(ids == separator) + first
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([first]), pa.array([n]), pa.array([ends], pa.list_(pa.int64()))], schema=schema)

    return spans.select("file", "block", "first", "n").mapInArrow(run, "file string, block long, first long, n long, ends array<long>")


def blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, block, first, n) for files (file, n_ids)."""
    at = files.where("n_ids > 0").select("file", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {block}"))).alias("block"))
    first = F.col("block") * block
    return at.select("file", "block", first.alias("first"), F.least(F.lit(block).cast("long"), F.col("n_ids") - first).alias("n")).repartition("file", "block")


def stitched(found: DataFrame) -> DataFrame:
    """(file, nth, start, n_tokens) for every document, from block summaries.

    The scan is in two levels, runs of RUN blocks and then the runs' totals, so that no task sorts a whole huge file.
    """
    s = found.select("file", "block", F.expr(f"block div {RUN}").alias("run"), (F.col("first") + F.col("n")).alias("stop"), F.size("ends").cast("long").alias("ended"), F.try_element_at("ends", F.lit(-1)).alias("last"), "ends")
    totals = s.groupBy("file", "run").agg(F.sum("ended").alias("ended"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("file", "run", F.coalesce(F.sum("ended").over(over), F.lit(0)).alias("ended0"), F.max("last").over(over).alias("last0"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"before": F.coalesce(F.sum("ended").over(inside), F.lit(0)), "open": F.max("last").over(inside)}).join(carried, ["file", "run"])
    # the place behind the last separator before this block: where the document that reaches into it began
    s = s.select("file", "ends", (F.col("ended0") + F.col("before")).alias("nth0"), (F.coalesce("open", "last0", F.lit(-1).cast("long")) + 1).alias("began"))
    starts = F.concat(F.array("began"), F.transform("ends", lambda e: e + 1))
    each = s.where(F.size("ends") > 0).select("file", "nth0", F.posexplode(F.zip_with("ends", F.slice(starts, F.lit(1), F.size("ends")), lambda e, b: F.struct(b.alias("start"), (e - b).alias("n_tokens")))).alias("i", "d"))
    docs = each.select("file", (F.col("nth0") + F.col("i")).alias("nth"), "d.start", "d.n_tokens")
    ends = totals.groupBy("file").agg(F.sum("ended").alias("nth"), (F.coalesce(F.max("last"), F.lit(-1).cast("long")) + 1).alias("start"), F.max("stop").alias("stop"))
    tail = ends.where("stop > start").select("file", "nth", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))
    return docs.unionByName(tail)


def scan_files(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Counts of every document of token files given as (file, n_ids)."""
    return stitched(summaries(blocks(files, block), separator, width))


def count_documents(docs: DataFrame, ranks_path: str, pattern: str, separator: int, key: str = "doc_id", text: str = "text", store: Store | None = None) -> DataFrame:
    """Per document: key, n_tokens. The texts are written as token files, which are then scanned."""
    spark: SparkSession = docs.sparkSession
    store = store or Store(spark, "tokens")
    placed = store.put(write_files(docs, f"{store.root}/files", ranks_path, pattern, separator, key=key, text=text), "placed")
    files = placed.groupBy("file").agg(F.max("n_ids").alias("n_ids"))
    counted = scan_files(files, separator)
    # the written table looks small as its file names compress well; without the hint it would be broadcast whole
    return placed.select("file", "nth", key).hint("merge").join(counted, ["file", "nth"]).select(key, "n_tokens")
