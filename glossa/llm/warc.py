"""WARC archives: writing, and reading back by boundary-chain verification.

Writing makes one record a page, in uncompressed files of at most RECORDS_PER_FILE records that Spark's writer makes, which
Spark can split. Of pages with equal payloads the one with the largest page_id (of equal ones, the greatest url) is a
response; the others are revisit records, which carry no payload and name the page they refer to.

Reading takes no word in a payload for a record. Spark cuts the files at every occurrence of the magic; lengths before an
occurrence in its file give its offset. Each occurrence that reads as a header is a candidate, which proposes the offset
of its successor from its Content-Length. Pointer jumping from each file's start, which doubles the length of the jumps
in each round, keeps the candidates that the chain of records reaches; what lies between two of them is payload, magic
inside included. Nothing is read whole by one task: a file is cut by Spark's splits, and a record is put together from
its own pieces. Pieces are numbered once, in a saved table, so that later reads can't number them otherwise.

Defined cases: a null html is an empty payload, equal to other empty ones; a null url is written as empty and read back as
null; a null page_id is written as none, ranks below all others and is read back as null; rows that repeat a page are records
of their own, all but one a revisit; an empty table gives no rows; payloads are whole, whatever their length; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, bit_map, hits, let

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
RECORDS_PER_FILE = 20_000
DATE = "2024-01-01T00:00:00Z"


def base32(hexadecimal: Column) -> Column:
    """Base32 of bytes given as hexadecimal digits, a multiple of five bytes: each five digits are four characters."""
    fives = F.regexp_extract_all(hexadecimal, F.lit("[0-9A-Fa-f]{5}"), 0)
    return F.array_join(F.transform(fives, lambda x: F.translate(F.lpad(F.conv(x, 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")), "")


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to.

    Only payloads that may have an equal, by a bit map of the keys of those that have, are shuffled.
    """
    html = F.coalesce("html", F.lit(""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), base32(F.sha1(F.encode(html, "UTF-8"))).alias("digest"), F.sha2(html, 256).alias("key"))
    top = known.groupBy("key").agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("at"))).alias("top"), F.count("*").alias("times")).where("times > 1")
    top = top.select("key", F.col("top.page_id").alias("original"), F.col("top.at").alias("top_url"), "times")
    twins = bit_map(top, F.col("key"))
    alone = hits(known, twins, F.col("key"), wanted=False).select("page_id", "url", "html", "digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    joined = hits(known, twins, F.col("key")).join(top, "key", "left")
    first = F.col("times").isNull() | (F.col("page_id").eqNullSafe(F.col("original")) & (F.coalesce("url", F.lit("")) == F.col("top_url")))
    joined = joined.withColumn("first", first)
    # of equal rows one is the response; only they need a number
    nth = joined.where("first").withColumn("response", F.row_number().over(Window.partitionBy("key").orderBy("page_id")) == 1)
    both = joined.where("NOT first").withColumn("response", F.lit(False)).unionByName(nth)
    both = both.select("page_id", "url", "html", "digest", F.when(F.col("response"), "response").otherwise("revisit").alias("record_type"), F.when(~F.col("response"), F.col("original")).alias("refers_to"))
    return alone.unionByName(both)


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages under path."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    body = F.concat(http, F.when(F.col("record_type") == "response", F.col("html")).otherwise(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    r = records(pages).withColumn("body", body)
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        F.when(F.col("refers_to").isNull(), "").otherwise(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        F.when(F.col("refers_to").isNull(), "").otherwise(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"), F.col("body"), F.lit("\r\n\r"),
    )
    # the writer's line feed is the last byte of a record
    r.select(record.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path, lineSep="\n", compression="none")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, row: the bytes before, between and after occurrences of the magic, and their order in a file.

    Numbers hold for one scan alone.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def chain(scratch: Scratch, candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates (file, offset, successor) that the chain from offset 0 of each file reaches.

    After round k, reached are those within 2^k steps, and a jump leads 2^k steps on.
    """
    jumps = scratch.save(candidates.select("file", "offset", "successor"), "jump-0")
    reached = scratch.save(candidates.where("offset = 0").select("file", "offset"), "reached-0")
    step, had = 0, reached.count()
    while True:
        on = reached.join(jumps.hint("merge"), ["file", "offset"]).select("file", F.col("successor").alias("offset"))
        valid = on.join(candidates.select("file", "offset").hint("merge"), ["file", "offset"], "left_semi")
        step += 1
        reached = scratch.save(reached.union(valid).distinct(), f"reached-{step}")
        now = reached.count()
        scratch.drop(f"reached-{step - 1}")
        if now == had:
            scratch.drop(f"jump-{step - 1}")
            return reached
        had = now
        further = jumps.select("file", F.col("offset").alias("successor"), F.col("successor").alias("further"))
        jumps = scratch.save(jumps.join(further.hint("merge"), ["file", "successor"]).select("file", "offset", F.col("further").alias("successor")), f"jump-{step}")
        scratch.drop(f"jump-{step - 1}")


LENGTH_FIELD = r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]+)"


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _length(head: Column) -> Column:
    return F.regexp_extract(head, LENGTH_FIELD, 1).try_cast("bigint")


def _latin(value: Column) -> Column:
    return F.decode(value, "ISO-8859-1")


def _content(value: Column, head: Column) -> Column:
    """A record's content, from the bytes after its magic."""
    return F.substring(value, F.length(head) + len(END) + 1, _length(head).cast("int"))


def _payload(content: Column) -> Column:
    return let(F.substring_index(_latin(content), END, 1), lambda http: F.substring(content, F.length(http) + len(END) + 1, F.length(content)))


def walk(spark: SparkSession, path: str, done=None):
    """The saved pieces, and what is known of those of reached records, with where the record starts.

    A piece that holds its record whole has the length and digest of its payload; of others these are null. ``done`` is
    called when the pieces are saved, as the archives aren't read after that.
    """
    scratch = Scratch(spark)
    order = Window.partitionBy("file").orderBy("block", "row")
    facts = F.struct(F.octet_length("value").cast("long").alias("size"), F.substring_index(_latin(F.col("value")), END, 1).alias("head"), F.col("value").alias("value"))

    def known(x):
        whole = x["size"] == F.length(x["head"]) + len(END) + _length(x["head"]) + len(END)
        payload = let(_content(x["value"], x["head"]), lambda c: let(_payload(c), lambda p: F.struct(F.octet_length(p).cast("long").alias("bytes"), base32(F.sha1(p)).alias("digest"))))
        return F.struct(x["size"].alias("size"), x["head"].alias("head"), F.when(whole, payload).alias("own"), F.coalesce(whole, F.lit(False)).alias("whole"))

    raw = scratch.save(pieces(spark, path).select("file", "block", "row", let(facts, known).alias("x"), "value").select("file", "block", "row", "x.*", "value"), "raw")
    if done:
        done()
    light = raw.drop("value").withColumn("offset", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - len(MAGIC))
    light = scratch.save(light, "pieces")
    found = light.where("offset >= 0").select("file", "offset", (F.col("offset") + len(MAGIC) + F.length("head") + len(END) + _length(F.col("head")) + len(END)).alias("successor"))
    reached = chain(scratch, found.where("successor IS NOT NULL"))
    # a piece belongs to the last reached record at or before it
    owned = light.where("offset >= 0").join(reached.withColumn("start", F.col("offset")).hint("merge"), ["file", "offset"], "left")
    owned = owned.withColumn("start", F.last("start", True).over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))).where("start IS NOT NULL")
    return scratch, raw, scratch.save(owned, "owned")


def joined(raw: DataFrame, owned: DataFrame) -> DataFrame:
    """head, content of each record, put together from its pieces."""
    parts = raw.select("file", "block", "row", "value").join(owned.select("file", "block", "row", "start", "offset"), ["file", "block", "row"]).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    data = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["value"], lambda acc, x: F.concat(acc, F.encode(F.lit(MAGIC), "UTF-8"), x["value"]))
    value = parts.select(data.alias("value"))
    return value.select(F.substring_index(_latin(F.col("value")), END, 1).alias("head"), "value").select("head", _content(F.col("value"), F.col("head")).alias("content"))


def _named(head: Column) -> list[Column]:
    number = lambda name: F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    return [
        number("WARC-Record-ID").alias("page_id"), F.decode(F.encode(_field(head, "WARC-Target-URI"), "ISO-8859-1"), "UTF-8").alias("url"), _field(head, "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
    ]


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest (as written), payload (null for revisits).

    The result is computed from tables in the shared folder, which stay there.
    """
    _, raw, owned = walk(spark, path)
    found = joined(raw, owned).select(*_named(F.col("head")), _payload(F.col("content")).alias("payload"))
    return found.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, of the archives read back.

    Lengths and digests of responses are those of the payload that was read; revisits take them from the record they
    refer to, which is found by page and digest. Payloads are digested where they are read; only records that the magic
    cuts into several pieces are put together first.
    """
    spark = pages.sparkSession
    home = Scratch(spark)
    path = f"{home.root}/archives"
    write(pages, path)
    scratch, raw, owned = walk(spark, path, lambda: home.drop("archives"))
    pieces_of = owned.groupBy("file", "start").agg(F.count("*").alias("n"))
    several = owned.join(pieces_of.where("n > 1").select("file", "start"), ["file", "start"], "left_semi")
    single = owned.join(pieces_of.where("n = 1").select("file", "start"), ["file", "start"], "left_semi")
    key = F.concat_ws("|", "file", "block", "row")
    cut = hits(raw, bit_map(several, key), key)
    whole = single.select(*_named(F.col("head")), F.col("own.bytes").alias("own_bytes"), F.col("own.digest").alias("own_digest"))
    rest = joined(cut, several).select(*_named(F.col("head")), _payload(F.col("content")).alias("p")).select("page_id", "url", "record_type", "refers_to", "payload_digest", F.octet_length("p").cast("long").alias("own_bytes"), base32(F.sha1("p")).alias("own_digest"))
    back = scratch.save(whole.unionByName(rest).drop("url"), "back")
    for name in ("raw", "pieces", "owned"):
        scratch.drop(name)
    own = F.col("record_type") == "response"
    full = back.where(own).select(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("payload_digest"), F.col("own_bytes").alias("full_bytes"))
    same = back.join(full, back["refers_to"].eqNullSafe(full["refers_to"]) & (back["payload_digest"] == full["payload_digest"]) & (back["record_type"] == "revisit"), "left").drop(full["refers_to"]).drop(full["payload_digest"])
    return same.select("page_id", F.when(own, F.col("own_bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"), F.when(own, F.col("own_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
