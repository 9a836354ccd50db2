"""A content-addressed archive of web records in WARC files."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from acctrisk.llm.common import stored

#: Bytes of a file, about, and of a record without its payload. Files are read whole, so this bounds a task's memory.
SEGMENT_BYTES, HEAD_BYTES = 16 << 20, 600
#: Equal payloads of at least so many bytes are stored once.
REVISIT_FROM = 100
#: A payload of more than this part of all records is heavy. So there are fewer heavy ones than its inverse.
HEAVY = 1 / 1000
END = "\r\n\r\n"
#: Fixed value of the format's standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def as_records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id``, ``url``, ``payload``, ``digest`` (32 bytes) and ``bytes`` of every page; a missing page is empty."""
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    return (pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"))
            .withColumns({"digest": F.unhex(F.sha2("payload", 256)), "bytes": F.octet_length("payload").cast("long")}))


def with_types(records: DataFrame, revisit_from: int = REVISIT_FROM, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Add ``refers_to``, the id of the response that a revisit repeats; missing for responses.

    Digests that occur once, and payloads below ``revisit_from``, need no decision. Heavy digests, at
    most ``1 / HEAVY``, are broadcast; the others that occur more often meet their records by digest. The
    records shuffle once, into as many parts as there will be files: those of short and heavy payloads
    by a hash of id and address, which spreads them evenly.
    """
    n, total = records.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    files = max(1, -(-((total or 0) + n * HEAD_BYTES) // segment_bytes))
    repeated = stored(
        records.where(F.col("bytes") >= revisit_from).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "repeated")
    heavy = F.col("n") > n * HEAVY
    many = repeated.where(heavy).select("digest", F.col("first").alias("many_first"), F.lit(True).alias("many"))
    by_digest = F.xxhash64("digest")
    few = repeated.where(~heavy).select("digest", "first", by_digest.alias("deal")).repartition(files, "deal")
    spread = (F.col("bytes") < revisit_from) | F.col("many").isNotNull()
    dealt = (records.join(F.broadcast(many), "digest", "left")
             .withColumn("deal", F.when(spread, F.xxhash64("id", "url")).otherwise(by_digest)).repartition(files, "deal"))
    first = F.coalesce("many_first", "first")
    refers = F.when(~F.col("id").eqNullSafe(first), first)
    return dealt.join(few, ["deal", "digest"], "left").withColumn("refers_to", refers).drop("first", "many_first", "many", "deal")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record per row of :func:`with_types` to gzip files in ``folder``.

    Every record ends with two line ends, which is the line separator that Spark's text writer
    puts after each row, so the files come from Spark alone and may lie wherever it can write.
    """
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    body = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]+", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("id"))), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", uri),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(""),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", body.cast("string")), F.lit("\r\n"), http)
    payload = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.encode(head, "UTF-8"), payload).cast("string")
    records.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(folder)


SCHEMA = ("id long, type string, refers_to long, digest binary, head binary, payload binary, "
          "file string, place int, own binary, crc long")
ARROW = pa.schema([("id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.binary()),
                   ("head", pa.binary()), ("payload", pa.binary()), ("file", pa.string()), ("place", pa.int32()),
                   ("own", pa.binary()), ("crc", pa.int64())])


def _number(urn: bytes | None) -> int | None:
    tail = (urn or b"").rpartition(b":")[2].rstrip(b">")
    return int(tail) if tail.lstrip(b"-").isdigit() else None


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an unpacked file; a broken one raises."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(b": ", 1) for line in data[at:end - 4].split(b"\r\n")[1:])
        stop = end + int(fields[b"Content-Length"])
        start = data.index(b"\r\n\r\n", end) + 4  # of the payload, behind the HTTP header
        if start > stop or data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"broken record at byte {at}")
        revisit = fields[b"WARC-Type"] == b"revisit"
        yield (_number(fields[b"WARC-Record-ID"]), "revisit" if revisit else "response", _number(fields.get(b"WARC-Refers-To")),
               bytes.fromhex(fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()), data[at:start], None if revisit else data[start:stop])
        at = stop + 4


def read_archive(spark: SparkSession, folder: str, payloads: bool = True, chosen: DataFrame | None = None) -> DataFrame:
    """The records in ``folder``: id, type, refers_to, digest, exact ``head`` and, if asked for, payload.

    ``file`` and ``place`` say where a record lies. ``own`` is the SHA-256 digest of a response's
    payload and ``crc`` the CRC-32 of the record, both computed from the bytes read. ``chosen``
    (``file``, ``places``) names the records to return; all without it. Spark lists and opens the
    files; each is unpacked and parsed in one piece, and the rows leave in batches of a few MB.
    """

    def rows(batches):
        for batch in batches:
            held = batch.column("places").to_pylist() if "places" in batch.schema.names else [None] * batch.num_rows
            for path, content, some in zip(batch.column("path").to_pylist(), batch.column("content"), held):
                out, size = [], 0
                unpack = zlib.decompressobj(31)
                data = unpack.decompress(content.as_py()) + unpack.flush()
                wanted = None if some is None else set(some)
                for n, r in enumerate(parse(data)):
                    if wanted is not None and n not in wanted:
                        continue
                    own = None if r[5] is None else hashlib.sha256(r[5]).digest()
                    crc = zlib.crc32(r[5] or b"", zlib.crc32(r[4]))
                    out.append((*r[:5], r[5] if payloads else None, path, n, own, crc))
                    size += len(r[4]) + len(out[-1][5] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    if chosen is not None:
        files = files.join(chosen.select(F.col("file").alias("path"), "places"), "path")
    return files.mapInArrow(rows, SCHEMA)


def store(spark: SparkSession, folder: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Split an archive into the tables ``payloads`` and ``heads`` below ``target``.

    ``heads`` has every record's exact header bytes with the digest that the record declares.
    ``payloads`` has each payload once under the SHA-256 digest of its bytes, computed anew, whoever
    wrote the archive: of the responses with one digest, the first by file and place is read again
    and stored. The choice takes digests and places alone, so that no payload is shuffled for it.
    """
    read_archive(spark, folder, payloads=False).drop("payload").write.option("compression", "zstd").parquet(f"{target}/heads")
    heads = spark.read.parquet(f"{target}/heads")
    one = heads.where(F.col("type") == "response").groupBy("own").agg(F.min(F.struct("file", "place")).alias("at"))
    chosen = stored(one.groupBy("at.file").agg(F.collect_list("at.place").alias("places")), "chosen")
    kept = read_archive(spark, folder, chosen=chosen).select(F.col("own").alias("digest"), "payload", F.octet_length("payload").cast("long").alias("bytes"))
    kept.write.option("compression", "zstd").parquet(f"{target}/payloads")
    return spark.read.parquet(f"{target}/payloads"), heads


def resolve(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record with the columns of the payload it declares. A record without payload raises.

    The rows of a payload that very many records repeat are split by adaptive execution's skew join.
    """
    found = heads.join(payloads.withColumn("found", F.lit(True)), "digest", "left")
    lost = F.raise_error(F.concat(F.lit("no payload with the digest of record "), F.coalesce(F.col("id").cast("string"), F.lit("none"))))
    return found.withColumn("bytes", F.when(F.col("found"), F.col("bytes")).otherwise(lost.cast("long"))).drop("found")


def reconstruct(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """``heads`` with ``record``, the bytes of every record as they were archived, without the closing line ends.

    ``payload`` and ``bytes`` are those of the full payload, also for revisits. A record that differs
    from the archived one raises.
    """
    body = F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    rebuilt = resolve(heads, payloads).where(F.col("bytes").isNotNull()).withColumn("record", F.concat("head", body))
    other = F.raise_error(F.concat(F.lit("other bytes than archived in record "), F.coalesce(F.col("id").cast("string"), F.lit("none"))))
    return rebuilt.withColumn("record", F.when(F.crc32("record") == F.col("crc"), F.col("record")).otherwise(other.cast("binary")))


def archive_pages(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html",
                  revisit_from: int = REVISIT_FROM, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Archive ``pages`` below ``folder`` and read them back: one row per page.

    Columns: ``page_id``, ``payload_bytes``, ``payload_digest`` (of the full payload), ``record_type``
    and ``refers_to``. Of equal payloads of at least ``revisit_from`` bytes the smallest id is the
    response and the others revisit it; rows that repeat that id are responses too. A missing html is
    an empty payload, a missing id or url is archived as such, an empty table gives an empty result,
    and other columns are ignored.
    """
    spark = pages.sparkSession
    write_archive(with_types(as_records(pages, id, url, html), revisit_from, segment_bytes), f"{folder}/warc")
    payloads, heads = store(spark, f"{folder}/warc", folder)
    # Every record is rebuilt and compared, and the digest computed from its payload once more: what is reported has been read back.
    return reconstruct(heads, payloads).where(F.col("record").isNotNull()).select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")
