"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Spark's text writer commits the archives: with CR LF CR LF as its line separator, each row is a record. Reading cuts every
file into ranges. A task looks in its range for everything that could begin a record and gives its offset and that of its
successor (header and block lengths added); a payload may well hold such text. Only what the chain of successors from the
start of the file reaches is a record. The chain is followed within a range by the task, and from range to range by pointer
jumping over all files at once, which doubles the ranges covered with every step.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed, prepare, shared_path, written

END = b"\r\n\r\n"
#: The versions of the format, the alphabet of base32.
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(content: Column) -> Column:
    """SHA-1 as 32 upper-case characters: 20 bits at a time, 4 characters each."""
    digits = F.sha1(content)
    parts = []
    for i in range(8):
        number = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(number, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def records(pages: DataFrame, *, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """``(record)``: the text of one WARC record per page.

    Of the pages with equal payloads of ``least_bytes`` or more, that with the largest id is a response and the others
    revisit it. Rows that repeat that id are responses too; a null id is the largest only among nulls.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), text.alias("html")).withColumns(
        {"page": F.col("id").cast("string"), "size": F.octet_length("html").cast("bigint"), "digest": base32_sha1(F.col("html").cast("binary"))}
    )
    groups = (
        rows.filter(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("_digest"), F.col("to"), F.col("to").cast("string").alias("to_page"))
    )
    # Written first, so that its size is known when the join is planned: pages move only if there are many groups.
    groups = written(groups, "warc-groups")
    rows = rows.join(groups, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("_digest").isNotNull() & ~F.col("id").eqNullSafe(F.col("to"))
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("html")))
    uuid = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(F.md5(c.cast("string").cast("binary")), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    header = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", uuid(F.concat_ws(":", "digest", "page"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", one_line(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Page-ID", F.col("page")),
        ("WARC-Refers-To", F.when(revisit, uuid(F.concat_ws(":", "digest", "to_page")))),
        ("WARC-Refers-To-Page-ID", F.when(revisit, F.col("to_page"))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))) for k, v in header]
    return rows.select(F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("", *lines), F.lit("\r\n"), block).alias("record"))


def write(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    records_per_file: int = 100_000,
) -> None:
    """Write ``pages`` as WARC files below ``path``, a record per row, committed by Spark's writer.

    A null html is an empty payload, a null url an empty one; line breaks in a url become blanks; a null page id leaves
    out its header line. An empty table gives files without records, or none.
    """
    prepare(pages.sparkSession)
    rows = records(pages, page_id=page_id, url=url, html=html, least_bytes=least_bytes)
    rows.write.option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).text(path)


def parse_header(head: bytes) -> dict[str, str] | None:
    """The named fields, names in lower case, or None if this isn't the header of a record."""
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode(errors="replace")] = value.strip().decode(errors="replace")
    return fields if fields.get("content-length", "").isdecimal() else None


def open_file(path: str):
    system, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else f"file://{path}")
    return system.open_input_file(inner)


def candidates_in(file, size: int, begin: int, end: int) -> list[tuple[int, int, int, dict[str, str]]]:
    """``(offset, block, successor, fields)`` of all that could be a record beginning in [begin, end)."""
    start = max(0, begin - len(END))
    file.seek(start)
    data = file.read(min(size, end + (64 << 10)) - start)
    found = []
    for m in MAGIC.finditer(data):
        at = start + m.start()
        if at >= end:
            break
        if at < begin or at and data[m.start() - len(END) : m.start()] != END:
            continue
        stop = data.find(END, m.start())
        step = 64 << 10
        # A header may be of any length. The next candidate follows its end, so no stretch is looked at twice.
        while stop < 0 and start + len(data) < size:
            more = max(m.start(), len(data) - len(END))
            file.seek(start + len(data))
            data += file.read(step)
            step *= 2
            stop = data.find(END, more)
        fields = parse_header(data[m.start() : stop]) if stop >= 0 else None
        if fields is None:
            continue
        block = start + stop + len(END)
        successor = block + int(fields["content-length"]) + len(END)
        if successor <= size:
            found.append((at, block, successor, fields))
    return found


CANDIDATE = "file string, range bigint, offset bigint, block bigint, successor bigint, leaves bigint, fields map<string,string>"


#: Partitions at most, however many ranges there are.
MOST_TASKS = 50_000
#: Bytes of an archive whose payloads are read together.
STRETCH = 4 << 20


def candidates(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """All candidates of all files below ``path``. ``leaves`` is the first offset outside its range on a candidate's chain."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    ranges = files.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("begin")
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(path_) as file:
                    found = candidates_in(file, size, begin, begin + range_bytes)
                leaves: dict[int, int] = {}
                for at, _, successor, _ in reversed(found):
                    leaves[at] = leaves.get(successor, successor)
                rows = [
                    {"file": path_, "range": begin // range_bytes, "offset": at, "block": block, "successor": successor, "leaves": leaves[at], "fields": list(fields.items())}
                    for at, block, successor, fields in found
                ]
                yield pa.RecordBatch.from_pylist(
                    rows,
                    pa.schema([("file", pa.string()), ("range", pa.int64()), ("offset", pa.int64()), ("block", pa.int64()), ("successor", pa.int64()), ("leaves", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))]),
                )

    # As many partitions as ranges: their rows are short, so by their bytes many ranges would fall to one task.
    return ranges.repartition(min(max(ranges.count(), 1), MOST_TASKS), "path", "begin").mapInArrow(searched, CANDIDATE)


def entries(found: DataFrame, steps: int) -> DataFrame:
    """``(file, offset)``: where the chain of each file, from its start, first comes into each range it visits.

    Pointer jumping: with the offsets reached after at most 2^k - 1 ranges and a table of jumps over 2^k ranges, one join
    reaches 2^(k+1) - 1, and another doubles the jumps.
    """
    jumps = checkpointed(found.select("file", "offset", F.col("leaves").alias("to")))
    reached = checkpointed(jumps.filter("offset = 0").select("file", "offset"))
    for _ in range(steps):
        further = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = checkpointed(reached.union(further).distinct())
        again = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("next"))
        jumps = checkpointed(jumps.join(again, ["file", "to"]).select("file", "offset", F.col("next").alias("to")))
    return reached


def read(spark: SparkSession, path: str, *, range_bytes: int = 8 << 20) -> DataFrame:
    """``(file, offset, block, length, fields)``: the records of all WARC files below ``path``, and where their blocks are.

    Text inside a payload that looks like a record is none, as no chain from a file's start reaches it. If a chain ends
    before its file does (a damaged length), what comes after isn't reached, and is left out. Empty files have no records.
    """
    prepare(spark)
    found = written(candidates(spark, path, range_bytes), "warc")
    most = found.agg(F.max("range")).first()[0]
    if most is None:
        return found.select("file", "offset", "block", (F.col("successor") - F.col("block") - len(END)).alias("length"), "fields")
    entered = entries(found, math.ceil(math.log2(most + 2)))
    starts = found.join(entered, ["file", "offset"]).select("file", "range", F.col("offset").alias("entry"))
    # A range is entered once, at the first of its records; the others are what the chain from there reaches inside it.
    inside = found.join(starts, ["file", "range"]).select("file", "range", "offset", "successor", "entry")

    def follow(table: pa.Table) -> pa.Table:
        step = dict(zip(table.column("offset").to_pylist(), table.column("successor").to_pylist()))
        at, kept = table.column("entry")[0].as_py(), []
        while at in step:
            kept.append(at)
            at = step[at]
        return pa.table({"file": pa.array([table.column("file")[0].as_py()] * len(kept), pa.string()), "offset": pa.array(kept, pa.int64())})

    kept = inside.groupBy("file", "range").applyInArrow(follow, "file string, offset bigint")
    return found.join(kept, ["file", "offset"]).select(
        "file", "offset", "block", (F.col("successor") - F.col("block") - len(END)).alias("length"), "fields"
    )


def payloads(recs: DataFrame, parts: int) -> DataFrame:
    """``recs`` plus ``payload_bytes`` and ``payload_digest`` of what the archive holds of each payload, read back whole.

    The payload is the block after its HTTP header. Each task reads the blocks of a file in the order of their offsets;
    ``parts`` is over how many partitions the stretches of ``STRETCH`` bytes are dealt.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib

        name, file = None, None
        for batch in batches:
            sizes, digests = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "block", "length")]
            for path, block, length in zip(*columns):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, open_file(path)
                file.seek(block)
                data = file.read(length)
                head = data.find(END)
                body = data[head + len(END) :] if data.startswith(b"HTTP/") and head >= 0 else data
                sizes.append(len(body))
                digests.append(base64.b32encode(hashlib.sha1(body).digest()).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names, "payload_bytes", "payload_digest"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in recs.schema.fields)
    dealt = recs.repartition(parts, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(digested, f"{schema}, payload_bytes bigint, payload_digest string")


def round_trip(pages: DataFrame, *, page_id: str = "page_id", path: str | None = None, range_bytes: int = 8 << 20, **options) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each page, from archives written and read.

    A revisit has no payload of its own: its size and digest are those of the response that it refers to. Rows that repeat
    a page are records of their own. Raises ValueError if the records of a file end before the file does.
    """
    spark = prepare(pages.sparkSession)
    path = path or shared_path(spark, "archives")
    write(pages, path, page_id=page_id, **options)
    kind = pages.schema[page_id].dataType
    stretches = spark.read.format("binaryFile").load(path).agg(F.sum(F.ceil(F.col("length") / STRETCH))).first()[0]
    recs = payloads(read(spark, path, range_bytes=range_bytes), min(max(stretches or 0, 1), MOST_TASKS)).select(
        F.col("fields")["warc-record-id"].alias("record"),
        F.col("fields")["warc-refers-to"].alias("to"),
        F.col("fields")["warc-type"].alias("record_type"),
        F.col("fields")["warc-page-id"].cast(kind).alias("page_id"),
        F.col("fields")["warc-refers-to-page-id"].cast(kind).alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        "file",
        (F.col("block") + F.col("length") + len(END)).alias("end"),
    )
    recs = written(recs, "warc-records")
    ends = recs.groupBy("file").agg(F.max("end").alias("end"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    broken = files.join(ends, "file", "left").filter(F.coalesce("end", F.lit(0)) != F.col("size")).first()
    if broken:
        raise ValueError(f"the records of {broken['file']} end at {broken['end'] or 0} of {broken['size']} bytes")
    recs = recs.drop("file", "end")
    own = recs.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    full = recs.filter("record_type = 'response'").select(F.col("record").alias("to"), "payload_bytes", "payload_digest").distinct()
    again = recs.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(full, "to")
    return own.union(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE = """
WITH full_payloads AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS digits FROM pages),
digests AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(digits, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest
    FROM full_payloads),
groups AS (SELECT payload_digest, max(page_id) AS first FROM digests GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM digests JOIN groups USING (payload_digest)
"""
