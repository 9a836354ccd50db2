"""Token counts of documents in flat token files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from acctrisk.llm import bpe
from acctrisk.llm.common import shared_folder, stored

#: The id that ends a document in a flat file. Ids are unsigned 16-bit, little-endian.
END_OF_DOCUMENT = 50256
#: Documents of a file at most, and tokens of a block of it.
FILE_DOCUMENTS, BLOCK = 4000, 1 << 18


def write_flat(docs: DataFrame, folder: str, by: list[str], order: str, text: str = "text",
               tokenizer: str | None = None, eod: int = END_OF_DOCUMENT) -> None:
    """Write the ids of all texts, each followed by ``eod``, to flat files below ``folder``.

    Rows with the same values of ``by`` stand in order of ``order`` in files numbered in sequence; a
    task must hold all rows of such a group, as it does for the parts of an input file. Nothing is
    shuffled. The end-of-document id is the line separator of Spark's text writer, so that the files
    may lie wherever Spark can write, and hold nothing but ids.
    """
    path = tokenizer or bpe.default_path()

    def ids(batches):
        encode = bpe.encoder(path)
        for batch in batches:
            rows = [_narrow(np.frombuffer(encode(t.as_py()), np.uint32), eod) for t in batch.column(text)]
            keys = [batch.column(c) for c in (*by, order)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(rows, pa.binary())], names=[*by, order, "value"])

    kinds = dict(docs.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in (*by, order))
    separator = eod.to_bytes(2, "little").decode("latin-1")
    (docs.select(*by, order, text).mapInArrow(ids, f"{fields}, value binary")
     .sortWithinPartitions(*by, order).select(*by, F.col("value").cast("string").alias("value"))
     .write.partitionBy(*by).option("encoding", "ISO-8859-1").option("lineSep", separator)
     .option("maxRecordsPerFile", FILE_DOCUMENTS).text(folder))


def _narrow(ids: np.ndarray, eod: int) -> bytes:
    """Ids as they stand in a flat file; such that can't stand there raise."""
    if len(ids) and (ids.max() >= 1 << 16 or (ids == eod).any()):
        raise ValueError(f"ids of a flat file are below {1 << 16}, and {eod} only ends a document")
    return ids.astype("<u2").tobytes()


def scan_blocks(spark: SparkSession, folder: str, eod: int = END_OF_DOCUMENT, block: int = BLOCK) -> DataFrame:
    """One row per block of a file: ``file``, ``block``, ``tokens`` and ``ends``, the places of ``eod`` in the file."""
    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                tokens = np.frombuffer(content.as_buffer(), "<u2")
                starts = range(0, max(1, len(tokens)), block)
                ends = [np.flatnonzero(tokens[s:s + block] == eod) + s for s in starts]
                lengths = [min(block, len(tokens) - s) for s in starts]
                offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
                yield pa.RecordBatch.from_arrays([
                    pa.array([path.as_py()] * len(ends)), pa.array(range(len(ends)), pa.int32()), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ends), pa.int64()))],
                    names=["file", "block", "tokens", "ends"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(scan, "file string, block int, tokens long, ends array<long>")


def document_spans(blocks: DataFrame) -> DataFrame:
    """One row per document: ``file``, ``ordinal`` in it, ``start``, ``n_tokens`` and ``ended``.

    A block knows the ends in it. What lies before its first end began behind the last end of an
    earlier block; an exclusive prefix scan over the blocks of a file carries that place, and the
    number of ends so far, into the block. Ids behind the last end of a file are a document that is
    not ``ended``; a file that ends with an end has none such.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    last = F.try_element_at("ends", F.lit(-1))
    upto = F.coalesce(F.sum("tokens").over(earlier), F.lit(0)) + F.col("tokens")
    carried = blocks.select(
        "file", "ends", F.coalesce(F.max(last).over(earlier) + 1, F.lit(0)).alias("open"),
        F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).alias("before"),
        F.when(F.count(F.lit(1)).over(later) == 0, upto).alias("stop"))
    # The arrays are made once per block, outside the function of an element. The last start has no end in its block.
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    both = F.zip_with(starts, "ends", lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    spans = F.transform(both, lambda z, i: F.struct(
        (F.col("before") + i).alias("ordinal"), z["start"].alias("start"),
        (F.coalesce(z["end"], F.col("stop")) - z["start"]).alias("n_tokens"), z["end"].isNotNull().alias("ended")))
    return carried.select("file", F.inline(F.filter(spans, lambda x: x["ended"] | (x["n_tokens"] > 0))))


def token_counts(spark: SparkSession, path: str, id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Tokens per document of the Parquet table at ``path``, counted in flat files written from it.

    Columns: the id, ``n_tokens`` (without the end), and the document's place: ``flat_file``,
    ``ordinal`` and ``start``. The files have no index: the n-th document of an input file is the
    n-th end in the flat files written from it, in their order, and a prefix scan over those files
    numbers the ends. A missing or empty text has no tokens; missing and repeated ids have a row per
    input row; an empty table gives an empty result; other columns are ignored. Long texts are counted
    whole; a flat file holds 4000 documents, and Spark reads it if it has less than 2 GB.
    """
    docs = spark.read.parquet(path)
    source = F.xxhash64(F.col("_metadata.file_path"))
    placed = docs.select(F.col(text).cast("string").alias("text"), source.alias("source"), F.col("_metadata.file_block_start").alias("part"),
                         F.col("_metadata.row_index").alias("row"))
    folder = shared_folder(spark, "flat")
    write_flat(placed, folder, ["source", "part"], "row", "text", tokenizer)
    found = document_spans(scan_blocks(spark, folder))
    name = F.col("file")
    found = stored(found.select(
        "*", F.regexp_extract(name, r"source=(-?\d+)", 1).cast("long").alias("source"),
        F.regexp_extract(name, r"part=(\d+)", 1).cast("long").alias("part"), F.regexp_extract(name, r"[.-]c(\d+)", 1).cast("int").alias("number")), "spans")
    sizes = found.groupBy("source", "part", "number").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("source", "part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = found.join(bases, ["source", "part", "number"]).withColumn("row", F.col("base") + F.col("ordinal"))
    index = docs.select(F.col(id).alias("__id"), source.alias("source"), F.col("_metadata.row_index").alias("row"))
    return index.join(counts, ["source", "row"]).select(
        F.col("__id").alias(id), "n_tokens", F.regexp_extract("file", r"([^/]+)$", 1).alias("flat_file"), "ordinal", "start")
