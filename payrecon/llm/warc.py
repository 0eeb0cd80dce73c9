"""Operator 6, WARC archives: written as records, read back by boundary chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table

#: What every record of any version 1 begins with, and what the records that are written here go on with.
MAGIC, VERSION = "WARC/1.", "1\r\n"
BREAK = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def digest_of(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hex digits are four of base 32."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`_record`: the text of one WARC record a page, less the closing blank lines.

    Of pages with equal payloads of at least `least_bytes` bytes that with the smallest id is a response and
    the others revisit it, without its payload; smaller ones are all responses.

    Defined cases: a null payload is an empty one, a null URL an empty one; rows that repeat the id of a response,
    and its payload, are responses too; a null id is no smallest one, its record refers to the smallest known one,
    and where all ids are null all are responses; other columns are not read.
    """
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20]", "%20")
    base = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    base = base.withColumn("_bytes", F.octet_length("_html")).withColumn("_digest", digest_of(F.col("_html").cast("binary")))
    same = base.filter(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = stored(same.filter("_n > 1").select(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"), "_first"), "warc-same")
    known = base.join(same, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    http = F.concat(F.lit(HTTP), F.col("_bytes").cast("string"), F.lit(BREAK))
    block = F.when(again, http).otherwise(F.concat(http, F.col("_html")))
    head = F.concat(
        F.lit(MAGIC + VERSION), F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("_id")), F.lit("\r\nWARC-Target-URI: "), F.col("_url"),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("_first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK),
    )
    return known.select(F.concat(head, block).alias("_record"))


def write_warc(pages: DataFrame, path: str, **names) -> None:
    """Archives below `path`. The text writer ends each record with the two blank lines that WARC asks for."""
    records(pages, **names).write.option("lineSep", BREAK).text(path)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r]*)", 1), F.lit(""))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every occurrence of the magic, in whatever splits the scan has.

    `_path, _file` (its hash), `_block` and `_seq` (their order within the file), `_bytes`: what follows a magic
    up to the next one or the end. Spark's text reader with the magic as line separator does the cutting; it
    hands on bytes as they are. Every scan gives the same `_path, _file, _bytes`; `_block` and `_seq` follow from
    the splits, which Spark sizes by the cores of the moment, and are good within one scan only.
    """
    path_of = F.col("_metadata.file_path")
    return spark.read.option("lineSep", MAGIC).text(path).select(
        path_of.alias("_path"), F.xxhash64(path_of).alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), F.col("value").cast("binary").alias("_bytes"),
    )


def _with_header(rows: DataFrame) -> DataFrame:
    """rows with `_head` (from the rest of the version on), `_size` (Content-Length) and `_from`, the first byte of the
    block; null where there is no header."""
    text = F.col("_bytes").cast("string")
    head = F.when(text.rlike("^[0-9]+\r\n") & (F.instr(text, BREAK) > 0), F.substring_index(text, BREAK, 1))
    rows = rows.withColumn("_head", head).withColumn("_size", _field(F.col("_head"), "Content-Length"))
    size = F.expr("try_cast(_size AS bigint)")
    return rows.withColumn("_size", F.when(size >= 0, size)).withColumn("_from", F.octet_length("_head").cast("long") + len(BREAK) + 1)


def _block_of(rows: DataFrame) -> Column:
    return F.expr("substring(_bytes, cast(_from AS int), cast(_size AS int))")


def payload_facts(head: Column, block: Column) -> Column:
    """`bytes, digest` of the payload, and `declared`, the length that an HTTP head gives for it."""
    http = F.concat(F.lit("\r\n"), F.substring_index(block.cast("string"), BREAK, 1))
    body = F.substring(block, F.octet_length(http) - 2 + len(BREAK) + 1, F.octet_length(block))
    is_http = F.coalesce(_field(head, "Content-Type").startswith("application/http"), F.lit(False))
    payload = F.when(is_http, body).otherwise(block)
    return F.struct(F.octet_length(payload).cast("long").alias("bytes"), digest_of(payload).alias("digest"), F.when(is_http, _field(http, "Content-Length").cast("long")).alias("declared"))


def _key_of(content: Column) -> Column:
    """What a segment is found by in another scan, however that is split: the SHA-256 of its bytes."""
    return F.unhex(F.sha2(content, 256))


def candidates(cut: DataFrame) -> DataFrame:
    """What each segment says of itself, stored: length, key, header, length of its block, and if the whole block
    is in the segment the facts of its payload. Payloads stay where they are."""
    rows = _with_header(cut).withColumn("_len", F.octet_length("_bytes").cast("long"))
    rows = rows.withColumn("_whole", F.coalesce(F.col("_len") >= F.col("_from") - 1 + F.col("_size"), F.lit(False)))
    facts = F.when(F.col("_whole"), payload_facts(F.col("_head"), _block_of(rows)))
    return stored(rows.select("_path", "_file", "_block", "_seq", "_len", _key_of(F.col("_bytes")).alias("_key"), F.when(F.col("_size").isNotNull(), F.col("_head")).alias("_head"), "_size", "_from", "_whole", facts.alias("_facts")), "warc-candidates")


def offsets(seen: DataFrame) -> DataFrame:
    """`_file, _block, _seq, _at` and what chains need: the offset of the magic before each segment, from sums of
    lengths over the segments of a file; what is before the first magic gets a negative one."""
    order = Window.partitionBy("_file").orderBy("_block", "_seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("_len") + len(MAGIC)).over(order), F.lit(0)) - len(MAGIC)
    return stored(seen.select("_file", "_block", "_seq", "_len", "_size", "_from", "_whole").withColumn("_at", at), "warc-offsets")


def reachable(jumps: DataFrame) -> DataFrame:
    """`_file, _at` of the records on the chain that begins at offset 0.

    jumps: `_file, _at, _to`. Candidates that follow each other in a file and point at each other are one run; a run
    begins anew where a pointer from elsewhere comes in. Pointer jumping then goes over runs, of which a file without
    the magic in its payloads has one.
    """
    order, here = Window.partitionBy("_file").orderBy("_at"), ["_file", "_at"]
    near = jumps.withColumn("_joins", F.coalesce(F.lag("_to").over(order) == F.col("_at"), F.lit(False)))
    near = stored(near.withColumn("_leaps", ~F.coalesce(F.lead("_at").over(order) == F.col("_to"), F.lit(False))), "warc-jumps")
    entered = near.filter("_leaps").select("_file", F.col("_to").alias("_at")).distinct().withColumn("_entered", F.lit(True))
    heads = near.join(entered, here, "left").withColumn("_head", ~F.col("_joins") | F.col("_entered").isNotNull())
    runs = stored(heads.select(*here, "_to", F.sum(F.col("_head").cast("long")).over(order).alias("_run")), "warc-runs")
    links = stored(runs.groupBy("_file", "_run").agg(F.min("_at").alias("_at"), F.max_by("_to", "_at").alias("_to")), "warc-links")
    found = _jumped(links.drop("_run"))
    return runs.join(links.join(found, here).select("_file", "_run"), ["_file", "_run"], "left_semi").select(*here)


def _jumped(jumps: DataFrame) -> DataFrame:
    """`_file, _at` of the nodes on the chains from offset 0, by pointer jumping over `_file, _at, _to`.

    Each round doubles how far every pointer goes and how many nodes are reached; pointers that lead beyond the
    last node drop out. Rounds grow with the logarithm of the nodes of a file, and each is a stored table, joined
    by sort and merge.
    """
    here = ["_file", "_at"]
    nodes, found = jumps.select(*here), stored(jumps.filter("_at = 0").select(*here), "warc-found")
    n = found.count()
    while True:
        step = found.join(jumps.hint("merge"), here).select("_file", F.col("_to").alias("_at"))
        found = stored(found.union(step.join(nodes.hint("merge"), here, "left_semi")).distinct(), "warc-found")
        now = found.count()
        if now == n:
            return found
        n = now
        then = jumps.select("_file", F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        jumps = stored(jumps.hint("merge").join(then, ["_file", "_to"]).select(*here, F.col("_next").alias("_to")), "warc-jumps")


def records_of(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, pieces): `_file, _at, _block, _seq, _whole` of the candidates on the chains from the files' first
    bytes, and `_file, _block, _seq, _at, _start` of all segments of the records that take several."""
    at = offsets(seen)
    after = F.col("_at") + len(MAGIC) + F.col("_from") - 1 + F.col("_size") + len(BREAK)
    chain = reachable(at.filter("_size IS NOT NULL").select("_file", "_at", after.alias("_to")))
    records = stored(at.join(chain, ["_file", "_at"]).select("_file", "_at", "_block", "_seq", "_whole"), "warc-records")
    starts = records.select("_file", "_at", F.when(~F.col("_whole"), F.col("_at")).otherwise(F.lit(-1)).alias("_start"))
    last = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = at.join(starts, ["_file", "_at"], "left").withColumn("_start", F.last("_start", ignorenulls=True).over(last))
    return records, stored(placed.filter("_start >= 0").select("_file", "_block", "_seq", "_at", "_start"), "warc-pieces")


def _with_bytes(cut: DataFrame, places: DataFrame) -> DataFrame:
    """places (with `_key`) with `_bytes`, from another scan than the one that found them: by content, so that its
    splits are free to differ. Equal segments are the same bytes, and one of them serves all places."""
    found = cut.select(_key_of(F.col("_bytes")).alias("_key"), "_bytes").join(places.select("_key").distinct(), "_key", "left_semi")
    found = found.groupBy("_key").agg(F.first("_bytes").alias("_bytes"))
    lost = F.raise_error(F.lit("archives changed between two scans")).cast("binary")
    return places.join(found, "_key", "left").withColumn("_bytes", F.coalesce("_bytes", lost))


def _together(cut: DataFrame, pieces: DataFrame) -> DataFrame:
    """`_file, _at, _bytes` of the records in several segments: the magic goes back between them."""
    parts = _with_bytes(cut, pieces)
    rows = parts.groupBy("_file", "_start").agg(F.sort_array(F.collect_list(F.struct("_at", "_bytes"))).alias("_p"))
    first, rest = F.get("_p", F.lit(0))["_bytes"], F.slice("_p", 2, F.size("_p"))
    whole = F.aggregate(rest, first, lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["_bytes"]))
    return rows.select("_file", F.col("_start").alias("_at"), whole.alias("_bytes"))


def chain_ends(spark: SparkSession, path: str) -> DataFrame:
    """`file, bytes, read_to, records` for every archive below `path` that has a byte: where its chain of records ended.

    read_to is `bytes` where all of the file is records; it is less where a record is cut off, names a wrong length or
    another follows without a header, and 0 where the file does not begin with one: what lies behind is not read. The last
    record may lack its closing blank lines. Of compressed files all numbers are those of the bytes within.
    """
    seen = candidates(segments(spark, path))
    records, _ = records_of(seen)
    at = offsets(seen)
    names = seen.groupBy("_file").agg(F.first("_path").alias("file"))
    whole = at.groupBy("_file").agg(F.max(F.col("_at") + len(MAGIC) + F.col("_len")).alias("bytes"))
    ends = at.join(records.select("_file", "_at"), ["_file", "_at"]).groupBy("_file").agg(F.max(F.col("_at") + len(MAGIC) + F.col("_from") - 1 + F.col("_size")).alias("_end"), F.count(F.lit(1)).alias("records"))
    closed = F.when(F.col("bytes").between(F.col("_end"), F.col("_end") + len(BREAK)), F.col("bytes")).otherwise(F.col("_end") + len(BREAK))
    cut = F.when(F.col("_end") > F.col("bytes"), F.col("_last")).otherwise(closed)
    last = records.groupBy("_file").agg(F.max("_at").alias("_last"))
    known = whole.join(names, "_file").join(ends, "_file", "left").join(last, "_file", "left").filter("bytes > 0")
    return known.select("file", "bytes", F.coalesce(cut, F.lit(0).cast("long")).alias("read_to"), F.coalesce("records", F.lit(0).cast("long")).alias("records"))


def index_warc(spark: SparkSession, path: str) -> DataFrame:
    """`file, at, head, block_bytes, payload` (bytes, digest, declared) of every record of the archives below `path`,
    of any version 1, and compressed or not (a compressed file is read by one task).

    Every magic is a candidate, and with its Content-Length it names its successor. Only candidates on the
    chain from a file's first byte are records; the magic inside a payload is not one, and what such a payload
    says about lengths moves nothing.

    Defined cases: a file that does not begin with a record has none; a chain ends where no candidate follows, and
    chain_ends() tells where that was; empty files, and archives of an empty table, give no rows. The chains of one file
    are put in order by one task, from some 100 bytes a candidate: archives are files of a few GB.

    At scale: archives are read in splits, and what is read of payloads (length and digest) is computed where
    they are read; offsets, pointers and chains are tables of numbers. Only records that hold the magic are put
    together, in a second scan that is skipped if there are none of them; it finds segments by their bytes' hash,
    so that cores which come or go between the scans, and with them Spark's splits, change nothing.
    """
    cut = segments(spark, path)
    seen = candidates(cut)
    records, pieces = records_of(seen)
    key = ["_file", "_block", "_seq"]
    known = records.filter("_whole").select(*key, "_at").join(seen, key).select(F.col("_path").alias("file"), F.col("_at").alias("at"), F.col("_head").alias("head"), F.col("_size").alias("block_bytes"), F.col("_facts").alias("payload"))
    if pieces.isEmpty():
        return known
    more = _with_header(_together(cut, pieces.join(seen.select(*key, "_key"), key)))
    more = more.join(records.filter("NOT _whole").select("_file", "_at", "_block", "_seq"), ["_file", "_at"]).join(seen.select(*key, "_path"), key)
    more = more.select(F.col("_path").alias("file"), F.col("_at").alias("at"), F.col("_head").alias("head"), F.col("_size").alias("block_bytes"), payload_facts(F.col("_head"), _block_of(more)).alias("payload"))
    return known.union(more)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """`at, head, block` of every record, found as in index_warc(), with the block's bytes."""
    cut = segments(spark, path)
    seen = candidates(cut)
    records, pieces = records_of(seen)
    key = ["_file", "_block", "_seq"]
    keys = seen.select(*key, "_key")
    one = _with_bytes(cut, records.filter("_whole").join(keys, key).select("_file", "_at", "_key")).select("_file", "_at", "_bytes")
    rows = _with_header(one.union(_together(cut, pieces.join(keys, key))))
    return rows.select(F.col("_at").alias("at"), F.col("_head").alias("head"), _block_of(rows).alias("block"))


def page_index(found: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record of index_warc(): its page, the full payload's size and digest, and what it revisits.

    A revisit has no payload of its own: its HTTP head and its digest field speak of the payload it refers to.
    """
    rows = found.withColumn("_kind", _field(F.col("head"), "WARC-Type"))
    revisit = F.col("_kind") == "revisit"
    rows = rows.withColumn("_rid", _field(F.col("head"), "WARC-Record-ID")).withColumn("_ref", _field(F.col("head"), "WARC-Refers-To"))
    page = lambda name: F.expr(f"try_cast(regexp_extract({name}, '<urn:page:(.*)>', 1) AS {id_type})")
    stated = F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "")
    return rows.select(
        page("_rid").alias("page_id"),
        F.when(revisit, F.col("payload.declared")).otherwise(F.col("payload.bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("payload.digest")).alias("payload_digest"),
        F.col("_kind").alias("record_type"),
        page("_ref").alias("refers_to"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_index(index_warc(spark, path))


SQL = {
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS x FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS g FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY g, n) AS first FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f""",
}
