"""WARC archives: written by Spark's text writer, read back by verifying the chain of record boundaries.

The reader cuts archives at every "WARC/1.0", wherever it stands, so splits of a
file are read independently. Every cut is a candidate record that claims a
successor: its offset plus header, content length and separators. Within a split
the claims are followed at once; from split to split by pointer jumping. Only
candidates that the chain reaches from the file's start are records; the rest is
payload that happens to hold the magic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.session import Written

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
LEAST_BYTES = 100  # smaller payloads are never revisits


def write_archives(pages: DataFrame, folder: str, written: Written, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to WARC files in ``folder``.

    Equal payloads of at least ``least_bytes``: a row with a larger page_id than
    the smallest one becomes a revisit without payload; rows that share the
    smallest id and rows without id are responses. A null html is an empty
    payload, a null url has no header; control characters of a url are dropped.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    # Written first, so that its measured size decides whether the join below moves any html.
    groups = written.keep(groups.where(F.col("first") < F.col("last")).select("digest", "first"))
    rows = rows.join(groups, "digest", "left")
    again = F.col("page_id") > F.col("first")
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">\r\n"))
    record = F.concat(
        F.lit(MAGIC), F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.lit("WARC-Record-ID: "), name, F.lit("WARC-Date: 2026-01-01T00:00:00Z\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x1F\\x7F]", ""), F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.when(again, F.lit("0")).otherwise(F.col("size").cast("string")), F.lit(END),
        F.when(again, F.lit("")).otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(folder)


def read_archives(spark: SparkSession, folder: str, written: Written) -> DataFrame:
    """(file, offset, type, record_id, uri, refers_to, digest, payload_bytes, payload_digest) of the verified records.

    ``payload_*`` describe the bytes really stored. A record cut off by the end
    of its file, and everything behind a broken boundary, is not returned.
    """
    pieces = _pieces(spark, folder)
    nodes = written.keep(pieces.drop("value").mapInPandas(_number, _NODE))
    # Where each split's pieces begin in the file.
    sums = nodes.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    order = Window.partitionBy("file").orderBy("block")
    sums = sums.select("file", "block", F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
                       (F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).alias("file_size"))
    placed = nodes.join(sums, ["file", "block"])
    at = F.col("base") + F.col("place") - len(MAGIC)
    nodes = placed.withColumns({"offset": at, "next": at + F.col("span")}).drop("base", "place", "span")
    nodes = written.keep(nodes.where("offset >= 0"))  # what stands before a file's first magic is no candidate

    claims = nodes.select("file", "block", "offset", F.when(F.col("next").between(F.col("offset") + 1, F.col("file_size")), F.col("next")).otherwise(-1).alias("next"), "file_size")
    claims = written.keep(claims.groupBy("file", "block").applyInPandas(_follow, "file string, block long, offset long, next long, file_size long, leaves long"))
    entries = _jump(claims, written)
    reached = claims.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInPandas(_mark, "file string, offset long, leaves long")
    # A chain leaves a split at most once; where it goes must be a candidate, which the jumps have then entered.
    reached = written.keep(reached)
    sound = reached.where("leaves >= 0").join(entries.select("file", F.col("offset").alias("leaves")), ["file", "leaves"], "left_semi")
    reached = reached.where("leaves < 0").select("file", "offset").unionByName(sound.select("file", "offset"))
    records = written.keep(nodes.join(reached, ["file", "offset"]))
    whole = records.where("whole").select("file", "offset", *_FIELDS, "payload_bytes", "payload_digest")
    parted = records.where("NOT whole").select("file", "offset", "next")
    if parted.isEmpty():
        return whole
    return whole.unionByName(_assembled(pieces, nodes, records, parted))


def page_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archive ``pages``, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    One row per page. The figures are those of the full payload, which a revisit
    takes from the record it refers to. No pages give an empty result.
    """
    written = Written(pages.sparkSession, "warc")
    folder = f"{written.root}/archives"
    write_archives(pages, folder, written, least_bytes)
    records = written.keep(read_archives(pages.sparkSession, folder, written))
    number = r"^<urn:page:(-?\d+)>$"
    records = records.withColumn("page_id", F.expr(f"try_cast(nullif(regexp_extract(record_id, r'{number}', 1), '') AS bigint)"))
    records = records.withColumn("first", F.expr(f"try_cast(nullif(regexp_extract(refers_to, r'{number}', 1), '') AS bigint)"))
    stored = records.where("type = 'response'")
    originals = stored.where("page_id IS NOT NULL").select(F.col("page_id").alias("first"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("full_bytes")).distinct()
    revisits = records.where("type = 'revisit'").join(originals, ["first", "digest"], "left")
    return stored.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("first").alias("refers_to")))


_FIELDS = ("type", "record_id", "uri", "refers_to", "digest")
_NODE = ("file string, block long, seq long, place long, size long, span long, whole boolean, type string, record_id string, uri string, "
         "refers_to string, digest string, payload_bytes long, payload_digest string")


def _header(head, name: str):
    return F.nullif(F.regexp_extract(head, f"(?i)(?:^|\\r\\n){name}:[ \\t]*([^\\r\\n]*)", 1), F.lit(""))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The texts between magics, with what their headers say if they are records."""
    raw = spark.read.option("lineSep", MAGIC).text(folder)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    head = F.substring_index("value", END, 1)
    rows = raw.withColumns({"head": head, "size": F.octet_length("value").cast("long")})
    length = F.expr("try_cast(nullif(regexp_extract(head, r'(?i)(?:^|\\r\\n)Content-Length:[ \\t]*(\\d+)(?:\\r\\n|$)', 1), '') AS bigint)")
    rows = rows.withColumns({"length": length, "rest": F.expr("substring(value, length(head) + 5)")})
    ends = F.col("rest").endswith(END)
    whole = ends & (F.octet_length("rest") == F.col("length") + len(END))
    payload = F.expr("substring(rest, 1, length(rest) - 4)")
    return rows.select(
        "file", "block", "value", "size", F.coalesce(len(MAGIC) + F.octet_length("head") + 2 * len(END) + F.col("length"), F.lit(-1)).alias("span"), F.coalesce(whole, F.lit(False)).alias("whole"),
        F.lower(_header(F.col("head"), "WARC-Type")).alias("type"), _header(F.col("head"), "WARC-Record-ID").alias("record_id"), _header(F.col("head"), "WARC-Target-URI").alias("uri"),
        _header(F.col("head"), "WARC-Refers-To").alias("refers_to"), F.regexp_replace(_header(F.col("head"), "WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        F.coalesce("length", F.lit(-1)).alias("payload_bytes"), F.when(whole, F.sha2(payload.cast("binary"), 256)).alias("payload_digest"))


def _number(batches):
    """Number the pieces of each split and sum the bytes before them; a split's rows come in file order."""
    state: dict[tuple, tuple[int, int]] = {}
    for pdf in batches:
        for key, rows in pdf.groupby(["file", "block"], sort=False):
            seq, place = state.get(key, (0, 0))
            steps = rows["size"].to_numpy() + len(MAGIC)
            ends = place + np.cumsum(steps)
            rows = rows.assign(seq=seq + np.arange(len(rows)), place=ends - steps)
            state = {key: (seq + len(rows), int(ends[-1]))}
            yield rows


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, where the chain that starts there leaves the split (-1: nowhere, or the file ends)."""
    pdf = pdf.sort_values("offset")
    leaves: dict[int, int] = {}
    last, size = int(pdf["offset"].iloc[-1]), int(pdf["file_size"].iloc[0])
    for offset, after in zip(pdf["offset"].to_numpy()[::-1], pdf["next"].to_numpy()[::-1]):
        leaves[offset] = leaves.get(after, -1) if after <= last else -1 if after == size else after
    return pdf.assign(leaves=[leaves[o] for o in pdf["offset"].to_numpy()])


def _jump(claims: DataFrame, written: Written) -> DataFrame:
    """(file, block, offset) of the candidates at which the chain from the file's start enters a split.

    Pointer doubling: after round n all entries within 2**n splits are known.
    """
    known = claims.select("file", "block", "offset")
    reached = written.keep(known.where("offset = 0").select("file", "offset"))
    jumps = claims.where("leaves >= 0").select("file", "offset", F.col("leaves").alias("to"))
    jumps = written.keep(jumps.join(known.select("file", F.col("offset").alias("to")), ["file", "to"]).select("file", "offset", "to"))
    while not jumps.isEmpty():
        further = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = written.keep(reached.union(further).distinct())
        twice = jumps.select(F.col("file"), F.col("offset").alias("to"), F.col("to").alias("far"))
        jumps = written.keep(jumps.join(twice, ["file", "to"]).select("file", "offset", F.col("far").alias("to")))
    return written.keep(known.join(reached, ["file", "offset"]).select("file", "block", "offset"))


def _mark(claims: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one split that the chain passes, from where it enters, as far as both ends of each are boundaries.

    ``leaves`` is where the last of them says the next record begins if that is in another split, else -1.
    """
    after = dict(zip(claims["offset"].to_numpy(), claims["next"].to_numpy()))
    last, size = (max(after), claims["file_size"].iloc[0]) if after else (-1, -1)
    out: dict[int, int] = {}
    for offset in entries["offset"].to_numpy():
        while offset in after and offset not in out:
            following = after[offset]
            if following not in after and following != size and following <= last:
                break
            out[offset] = following if last < following < size else -1
            offset = following
    return pd.DataFrame({"file": pd.Series([claims["file"].iloc[0]] * len(out) if out else [], dtype=object),
                         "offset": np.array(list(out), np.int64), "leaves": np.array(list(out.values()), np.int64)})


def _assembled(pieces: DataFrame, nodes: DataFrame, records: DataFrame, parted: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces are put together again."""
    files = parted.select("file").distinct()
    starts = records.select("file", "offset", F.col("offset").alias("start"), F.col("whole").alias("of_whole"))
    rows = nodes.select("file", "block", "seq", "offset").join(files, "file", "left_semi").join(starts, ["file", "offset"], "left")
    owner = F.last("start", True).over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("start", owner).select("file", "block", "seq", "offset", "start")
    rows = rows.join(parted.select("file", F.col("offset").alias("start"), "next"), ["file", "start"]).where("offset < next")
    texts = pieces.select("file", "block", "size", "value").mapInPandas(_number, "file string, block long, size long, value string, seq long, place long").drop("size", "place")
    texts = texts.join(rows, ["file", "block", "seq"])
    whole = texts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
    whole = whole.select("file", F.col("start").alias("offset"), text.alias("value"))
    whole = whole.withColumn("rest", F.expr(r"substring(value, length(substring_index(value, '\r\n\r\n', 1)) + 5)"))
    whole = whole.join(records.select("file", "offset", *_FIELDS, "payload_bytes"), ["file", "offset"])
    payload = F.substring(F.col("rest").cast("binary"), F.lit(1), F.col("payload_bytes").cast("int"))
    return whole.select("file", "offset", *_FIELDS, "payload_bytes", F.sha2(payload, 256).alias("payload_digest"))
