"""WARC archives: written by Spark's text writer, read by boundary-chain verification.

Writing. Every page becomes one record. Of pages with equal payloads of at least ``least``
bytes, the one with the largest id is a response with the full payload and the others are
revisits of it. The largest id per payload digest is one aggregation, combined before the
shuffle; pages themselves are not shuffled unless the list of repeated digests, once counted,
is too long to broadcast. A text row of header and block, ended by the record separator, is a
record, so any file system Spark can write to will do.

Reading. Files are split at the record magic by Spark's text reader, so a task starts anywhere
in a file and a payload may hold the magic itself. A split's segments carry their lengths; the
lengths of the splits before it make them byte offsets. Each segment whose header parses is a
candidate, which names its successor: its own offset plus header, block and separator. Pointer
jumping from offset 0 of every file, doubling the jump each round, keeps what is reachable:
magic inside a payload starts no record, however well-formed what follows. Rounds grow with the
logarithm of the records in a file; reachable offsets stay distributed. A record that lies in one
segment is digested where it was read; only segments of payloads that hold the magic are
shuffled, to be joined again.

Defined results: a null html is an empty payload; a null url leaves its header out; line breaks
in a url are percent-encoded; a null page_id sorts below all others, is written as ``null`` and
read back as null; rows that repeat the largest id are all responses; an empty table gives an
empty archive and an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.sources.shared import checked_keys, fresh_path

# The parts of the format.
MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
RECORDS_PER_FILE = 4096
HEX_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named. Under a condition
    Spark shares no subexpression, but a lambda's argument is a value."""
    return F.transform(F.array(value), use)[0]


def base32_sha1(text: Column) -> Column:
    """The SHA-1 of the text's UTF-8 bytes: five hexadecimal digits are four of base 32."""
    def spelt(digest: Column) -> Column:
        parts = [
            F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)
        ]
        return F.translate(F.concat(*parts), HEX_DIGITS, BASE32_DIGITS)

    return bound(F.sha1(text.cast("binary")), spelt)


def measured(block: Column) -> Column:
    """Digest and octets of a block's payload."""
    return bound(
        payload(block),
        lambda own: F.struct(base32_sha1(own).alias("digest"), F.octet_length(own).cast("bigint").alias("octets")),
    )


def write_archive(pages: DataFrame, path: str, least: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages (page_id, url, html)`` as WARC files below ``path``."""
    given = pages.select(
        F.col("page_id").cast("bigint").alias("id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.col("html")))
    repeated = (
        given.where(F.octet_length("html") >= least)
        .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        .where(F.col("n") > 1).select(F.col("digest").alias("of"), "top")
    )
    first = given.join(
        checked_keys(repeated),
        (F.col("digest") == F.col("of")) & (F.octet_length("html") >= least), "left",
    )
    name = lambda column: F.coalesce(F.col(column).cast("string"), F.lit("null"))
    revisit = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    length = F.octet_length("html")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    # concat_ws leaves out what is null.
    header = F.concat_ws(
        BREAK,
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name("id"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {DATE}"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), length.cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), name("top"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    (
        first.select(F.concat(F.lit(MAGIC), header, F.lit(END), block).alias("value"))
        .write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)
    )


def field(name: str) -> Column:
    """A header field of the segment, null where it has none."""
    found = F.regexp_extract(F.col("header"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def raw_segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, by file, split and place."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), F.col("value"),
    )


def segments(spark: SparkSession, path: str) -> DataFrame:
    """All segments with byte offsets and parsed headers.
    ``digest`` and ``octets`` are those of the payload where the segment is the whole record, else ``text`` is the
    segment itself."""
    at = F.instr("value", END)
    cut = raw_segments(spark, path).withColumn("header", F.when(at > 0, F.expr("left(value, instr(value, '\\r\\n\\r\\n') - 1)")))
    size = F.octet_length("value").cast("bigint")
    head, content = F.octet_length("header") + len(END), field("Content-Length").try_cast("bigint")
    whole = F.coalesce(size == head + F.col("content") + len(END), F.lit(False))
    # A whole segment ends with the separator; its payload starts after the block's own header.
    body = F.expr("substring(value, length(header) + 5, length(value) - length(header) - 8)")
    parsed = (
        cut.withColumn("content", content)
        .withColumns({"size": size, "head": head.cast("bigint"), "whole": whole})
        .withColumns(
            {
                "id": F.regexp_extract(field("WARC-Record-ID"), "<urn:page:(.*)>", 1),
                "type": field("WARC-Type"),
                "refers": F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(.*)>", 1),
                "told": F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")),
                "length": field("WARC-Payload-Length").try_cast("bigint"),
                "own": F.when(F.col("whole"), measured(body)),
                "text": F.when(~F.col("whole"), F.col("value")),
            }
        )
        .drop("value", "header").select("*", "own.*").drop("own")
    )
    kept = stored(parsed, "segments")
    step = F.col("size") + len(MAGIC)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("file", "block").agg(F.sum(step).alias("bytes")).select(
        "file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # A file begins with an empty segment before its first magic, so the magic of a segment
    # stands just before it.
    offset = F.col("start") + F.coalesce(F.sum(step).over(inside), F.lit(0)) - len(MAGIC)
    placed = kept.join(starts, ["file", "block"]).withColumn("at", offset).drop("start")
    follows = F.col("at") + len(MAGIC) + F.col("head") + F.col("content") + len(END)
    return stored(placed.withColumn("to", follows), "offsets")


def payload(block: Column) -> Column:
    """A block without its HTTP header."""
    return bound(block, lambda b: F.substring(b, F.instr(b, END) + F.lit(len(END)), F.length(b)))


def reachable(candidates: DataFrame) -> DataFrame:
    """``(file, at)`` of the candidates ``(file, at, to)`` that a chain from offset 0 reaches."""
    jumps = stored(candidates.select("file", "at", "to"), "jumps")
    reached = jumps.where(F.col("at") == 0).select("file", "at").distinct()
    count = -1
    while True:
        reached = stored(
            reached.union(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(),
            "reached",
        )
        now = reached.count()
        if now == count:
            return reached
        count = now
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("onto"))
        jumps = stored(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("onto").alias("to")), "jumps")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``,
    and ``intact``: whether a response's payload has the digest and length its header tells. Bytes
    and digest of a response are measured on what was read; a revisit's are its header's."""
    found = segments(spark, path)
    candidates = found.where(F.col("content").isNotNull() & F.col("type").isNotNull())
    reached = reachable(candidates)
    records = candidates.join(reached, ["file", "at"], "left_semi")
    whole = records.where("whole").withColumn("real", F.col("digest"))
    # Records whose payload holds the magic: their segments are those up to the next record.
    broken = records.where(~F.col("whole")).drop("text", "digest", "octets")
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = reached.withColumn("start", F.col("at"))
    owned = (
        found.select("file", "at", "block", "nth", "whole", "text")
        .join(starts, ["file", "at"], "left")
        .withColumn("start", F.max("start").over(upto))
        .join(broken.select("file", F.col("at").alias("start")), ["file", "start"], "left_semi")
    )
    owned = stored(owned, "owned")
    # A segment inside a payload may look like a whole record; its text was not stored then.
    lost = owned.where("whole").select("file", "block", "nth")
    if not lost.isEmpty():
        again = raw_segments(spark, path).join(checked_keys(lost), ["file", "block", "nth"])
        owned = owned.join(again, ["file", "block", "nth"], "left").withColumn("text", F.coalesce("text", "value")).drop("value")
    rebuilt = (
        owned.groupBy("file", "start")
        .agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
        .withColumn("value", F.array_join(F.col("parts.text"), MAGIC))
        .withColumn("block", F.expr("substring(value, instr(value, '\\r\\n\\r\\n') + 4)"))
        .withColumn("block", F.expr("left(block, length(block) - 4)"))
        .select("file", F.col("start").alias("at"), measured(F.col("block")).alias("own"))
        .select("file", "at", F.col("own.digest").alias("real"), "own.octets")
    )
    mended = broken.join(rebuilt, ["file", "at"])
    columns = ["id", "length", "told", "type", "refers", "real", "octets"]
    everything = whole.select(*columns).union(mended.select(*columns))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).try_cast("bigint")
    response = F.col("type") == "response"
    as_told = (F.col("real") == F.col("told")) & (F.col("octets") == F.col("length"))
    return everything.select(
        number("id").alias("page_id"),
        F.when(response, F.col("octets")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(response, F.col("real")).otherwise(F.col("told")).alias("payload_digest"),
        F.col("type").alias("record_type"), number("refers").alias("refers_to"),
        (~response | F.coalesce(as_told, F.lit(False))).alias("intact"),
    )


def archive(pages: DataFrame, least: int = 0, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path, least, records_per_file)
    return read_archive(pages.sparkSession, path)
