"""WARC archives: a deduplicating writer and a reader that salvages what damage leaves.

Each record is built in DataFrame operations and written by Spark's text writer, whose line
separator is the two line ends that close a record; so archives go wherever Spark can write.

The reader checks each record (version line, header, length, closing line ends, digests).  After a
failed check it searches for the next version line, or gzip member, at which a valid record starts,
goes on there, and reports the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import checkpoint, join_counted, shared_dir
from barloom.llm.exact_dedup import mark, probe, repeated_filter

END = "\r\n\r\n"
TYPES = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())
#: Before and after the id in a record's name.
NAME = ("<urn:page:", ">")
#: The name of a record without an id.
NO_ID = "<urn:page>"
#: Digits of base 32 as numbers are written, and as RFC 4648 has them.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary column; its 160 bits are four groups of eight digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*digits)), DIGITS, BASE32)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, max_words: int = 4_000_000) -> DataFrame:
    """(_id, _url, _payload, _bytes, _digest, _refers): which page each record refers to, null for responses.

    Of payloads of at least ``min_bytes`` that are equal, the page with the smallest id is the
    response and all others revisit it; smaller ones are all responses.  A null payload is empty.
    Repeated rows of the smallest id are all responses; a null id comes after all others.
    A Bloom filter finds the digests that may repeat; only their pages are shuffled.  A filter of more than
    ``max_words`` words is not sent to the pages; then each page is shuffled once.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumns({"_bytes": F.octet_length("_payload").cast("long"), "_digest": sha1_base32(F.col("_payload"))})
    slim = checkpoint(rows.select("_id", "_bytes", "_digest").where(F.col("_bytes") >= min_bytes))
    n = slim.count()
    bits = max(1 << 10, 1 << (8 * n).bit_length())
    words = checkpoint(repeated_filter(slim, "_digest", bits))
    small = words.count() <= max_words
    groups = checkpoint(
        probe(slim, words, "_digest", bits, small).where("_maybe").groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    )
    marked = mark(rows, words, "_digest", bits, small, groups.where("_n > 1").select("_digest")).withColumn("_maybe", F.col("_maybe") & (F.col("_bytes") >= min_bytes))
    alone = marked.where("not _maybe").withColumn("_refers", F.lit(None).cast(rows.schema["_id"].dataType))
    many = join_counted(marked.where("_maybe"), groups, "_digest", "_n", n)
    many = many.withColumn("_refers", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")))
    columns = ["_id", "_url", "_payload", "_bytes", "_digest", "_refers"]
    return alone.select(columns).unionByName(many.select(columns))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", records_per_file: int = 4000, max_words: int = 4_000_000) -> None:
    """Archives of ``pages``, one record per row, in the new folder ``path``.

    Line ends in an address are written as %0D and %0A; a null address is empty.  An id of any type is
    written as text, percent-encoded; a null id has a name of its own.  A revisit holds the response's HTTP header and no payload.
    """
    name = lambda c: F.coalesce(F.concat(F.lit(NAME[0]), F.url_encode(c.cast("string")), F.lit(NAME[1])), F.lit(NO_ID))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    url = F.replace(F.replace(F.coalesce(F.col("_url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("_refers").isNotNull()
    http = text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: ", F.col("_bytes").cast("string"), END)
    block = F.concat(http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("_payload")))
    header = text(
        "WARC/1.0\r\nWARC-Type: ", F.when(revisit, "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: ", name(F.col("_id")), f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: ", url,
        F.when(revisit, text(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: ", name(F.col("_refers")))).otherwise(""),
        "\r\nWARC-Payload-Digest: sha1:", F.col("_digest"), "\r\nWARC-Block-Digest: sha1:", sha1_base32(F.col("_block")),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length("_block").cast("string"), END,
    )
    records = plan_records(pages, id_col, url_col, payload_col, min_bytes, max_words).withColumn("_block", block)
    records.select(F.concat(header.cast("binary"), F.col("_block")).cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; a line that starts with a blank goes on the line before."""
    found: dict[str, str] = {}
    name = ""
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            found[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, value = line.split(b":", 1)
            name = key.strip().lower().decode("utf-8", "replace")
            found[name] = value.strip().decode("utf-8", "replace")
    return found


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


VERSION, LINE = re.compile(rb"WARC/\d{1,4}\.\d{1,4}\r\n"), re.compile(rb"\r\nWARC/\d{1,4}\.\d{1,4}\r\n")


def parse_record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record that starts at ``at`` and where it ends, or what is wrong with it."""
    if not VERSION.match(data, at):
        return "no version line"
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        return "no end of header"
    if LINE.search(data, at, head_end + 2):
        return "another version line in the header"
    fields = _fields(data[at:head_end])
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    start, end = head_end + 4, head_end + 4 + int(length)
    if end + 4 > len(data):
        return "content is cut off"
    if data[end : end + 4] != b"\r\n\r\n":
        return "no line ends after content"
    block = data[start:end]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:].upper() != _sha1(block):
        return "block digest differs"
    http, cut, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    declared = fields.get("warc-payload-digest", "")
    revisit = fields.get("warc-type") == "revisit"
    if revisit:
        size = _fields(http).get("content-length", "")
        size = int(size) if size.isascii() and size.isdigit() else None
        payload_digest = declared[5:] if declared.startswith("sha1:") else None
    else:
        size, payload_digest = len(payload), _sha1(payload)
        if declared.startswith("sha1:") and declared[5:].upper() != payload_digest:
            return "payload digest differs"
    record = {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": payload_digest, "payload": None if revisit else payload,
        "checked": (digest.startswith("sha1:") or not revisit and declared.startswith("sha1:")) and fields.get("warc-type") in TYPES
        and bool(re.fullmatch(r"<[!-;=?-~]+>", fields.get("warc-record-id", ""))),
    }
    return record, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member that starts at ``at`` holds, as far as it can be read, and where it ends (None if it is damaged or cut off)."""
    view, step = memoryview(data), 1 << 16
    engine, out, k = zlib.decompressobj(31), [], at
    before, start = engine, at
    while k < len(data) and not engine.eof:
        if step > 1:
            before, start = engine.copy(), k
        try:
            out.append(engine.decompress(view[k : k + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), None
            # of a piece with an error nothing is returned: again, byte by byte
            engine, k, step = before, start, 1
            continue
        k += step
    return b"".join(out), min(k, len(data)) - len(engine.unused_data) if engine.eof else None


def _candidates(data: bytes, at: int) -> Iterator[int]:
    """Places after ``at`` where a record may start again: version lines, in order.

    Of the version lines before one end of a header the first, the last at the start of a line and the last of all count:
    what stands between them has the same end and less of a header.  So each byte is looked at a few times only.
    """
    while found := VERSION.search(data, at):
        first = found.start()
        head_end = data.find(b"\r\n\r\n", first)
        if head_end < 0:
            return
        wanted = {first}
        for mark in (b"\r\nWARC/", b"WARC/"):
            last = head_end + 2
            while (last := data.rfind(mark, first + 1, last)) >= 0 and not VERSION.match(data, last + len(mark) - 5):
                last += len(mark) - 1
            if last >= 0:
                wanted.add(last + len(mark) - 5)
        yield from sorted(wanted)
        at = head_end + 2


def _plain(data: bytes, digests: bool = False) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record or reason of a gap) over uncompressed bytes; with ``digests`` a record counts only if it has one and a sound header."""
    at, gap, reason, places = 0, None, "", iter(())
    while at < len(data):
        got = parse_record(data, at)
        if digests and not isinstance(got, str) and not got[0]["checked"]:
            got = "no digest or no sound header in a damaged gzip member"
        if isinstance(got, str):
            if gap is None:
                gap, reason, places = at, got, _candidates(data, at + 1)
            at = next(places, -1)
            if at < 0:
                break
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield at, got[1], got[0]
        at = got[1]
    if gap is not None:
        yield gap, len(data), reason


def _row(offset: int, length: int, found: dict | str, inner: tuple[int, int] | None = None) -> dict:
    place = {"offset": offset, "length": length, **({"inner_offset": inner[0], "inner_length": inner[1]} if inner else {})}
    if isinstance(found, str):
        return {"kind": "gap", **place, "reason": found}
    return {"kind": "record", **place, **{k: v for k, v in found.items() if k != "checked"}}


def salvage(data: bytes) -> Iterator[dict]:
    """The records of an archive (``kind`` record) and the gaps between them (``kind`` gap, with a reason), in order.

    In a gzip archive the records of a member are searched in what can be inflated of it.  Its gaps
    have ``inner_offset`` and ``inner_length``, as its records do; a damaged member without a valid
    record is part of a gap between members.  In a damaged member only records with a digest and a sound
    header are valid, and they give the damage as their reason, since no digest covers a header.
    """
    zipped = data[:2] == b"\x1f\x8b" or (not data.startswith(b"WARC/") and b"\x1f\x8b\x08" in data and b"WARC/1." not in data)
    if not zipped:
        for start, end, found in _plain(data):
            yield _row(start, end - start, found)
        return
    mark = b"\x1f\x8b\x08"
    at, gap, reason = 0, None, ""
    while at < len(data):
        wrong, inner, end = "no gzip member", [], None
        if data.startswith(mark, at):
            raw, end = _inflate(data, at)
            inner = list(_plain(raw, end is None))
            wrong = "damaged gzip member" if end is None else next((f for _, _, f in inner if isinstance(f, str)), "")
        following = data.find(mark, at + 1) if end is None else end
        following = len(data) if following < 0 else following
        if any(not isinstance(f, str) for _, _, f in inner) or not wrong:
            if gap is not None:
                yield _row(gap, at - gap, reason)
                gap = None
            if end is None and not isinstance(inner[-1][2], str):
                inner.append((len(raw), len(raw), wrong))
            for a, b, found in inner:
                yield _row(at, following - at, found, (a, b - a)) | ({"reason": wrong} if end is None and not isinstance(found, str) else {})
        elif gap is None:
            gap, reason = at, wrong
        at = following
    if gap is not None:
        yield _row(gap, len(data) - gap, reason)


SALVAGED = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner_offset", pa.int64()), ("inner_length", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
     ("url", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives under ``path``; empty files give no rows.

    Columns: ``path``, ``kind`` (record or gap), ``offset`` and ``length`` in the file (for gzip: of
    the member), ``inner_offset`` and ``inner_length`` in the member's inflated bytes, ``reason`` (gaps, and records of damaged members), ``record_type``, ``record_id``, ``url``, ``refers_to_id``,
    ``payload_bytes`` and ``payload_digest`` (of the full payload, also for revisits) and ``payload``
    (null for revisits and gaps, and for all without ``payloads``).  A task holds one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows: list[dict] = []
                size = 0
                for row in salvage(content.as_py()):
                    size += row["length"]
                    rows.append({"path": file.as_py()} | row | ({} if payloads else {"payload": None}))
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, SALVAGED)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SALVAGED)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, kind string, offset long, length long, inner_offset long, inner_length long, reason string, record_type string, record_id string, url string, refers_to_id string, payload_bytes long, payload_digest string, payload binary")


def page_of(name: Column, kind: str = "long") -> Column:
    """The id in a record's name; null without one."""
    inner = F.substring(name, len(NAME[0]) + 1, F.length(name) - F.lit(len("".join(NAME))))
    return F.when(name.startswith(NAME[0]), F.url_decode(inner)).try_cast(kind)


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back: one row per page.

    Columns: the id in its own type, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    Repeated rows give a row each; a null id stays null; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col=id_col, **options)
    records, kind = read_warc(spark, path, payloads=False).where("kind = 'record'"), pages.schema[id_col].dataType.simpleString()
    return records.select(page_of(F.col("record_id"), kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to_id"), kind).alias("refers_to"))
