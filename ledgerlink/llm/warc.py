"""WARC archives: written as one gzip member a record, read in splits.

A reader task takes a byte range, scans it for the gzip magic, takes a place for
a member only if the bytes from there inflate to a WARC header, and owns the
records that start inside its range, however far they go on.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm.common import bounded_batches, cut, small, workspace

MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are stored each time.
LEAST_BYTES = 100
SPLIT_BYTES = 16 << 20
DIGEST = "sha256:"


def _files(path: str):
    """(file system, path in it) of a URI, for folders that all executors share."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A response record, or a revisit (HTTP header only) of refers_to, as a gzip member."""
    import gzip

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: {DIGEST}{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def _written(folder: str):
    def run(batches):
        import pyarrow as pa

        fs, home = _files(folder)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                out = out or fs.open_output_stream(posixpath.join(home, name), compression=None)
                data = record(r["page_id"], r["url"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"])
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["name", "bytes", "records"])

    return run


def digested(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages with payload (null for revisits), payload_bytes, payload_digest, refers_to and revisit.

    Of equal payloads of at least the given size the row with the smallest
    page_id is the response (nulls last; of rows that repeat it, one with the
    smallest url); null html is an empty payload. No row is told apart by its
    place in the table.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    each = rows.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest"), "page_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("n"))).alias("first")
    several = cut(each.groupBy("digest").agg(first, F.sum("n").alias("copies")).filter("copies > 1").drop("copies"), "warc-copies")
    # Payloads move only where the table of repeated ones is too large to go to them.
    joined = rows.join(small(several, 128), (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least), "left")
    joined = joined.withColumn("mine", F.col("first").isNotNull() & F.col("page_id").eqNullSafe(F.col("first.id")))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "revisit"]
    settled = joined.filter(~F.col("mine") | (F.col("first.n") == 1)).withColumn("revisit", F.col("first").isNotNull() & ~F.col("mine"))
    settled = settled.withColumn("refers_to", F.when(F.col("revisit"), F.col("first.id"))).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    if several.filter("first.n > 1").isEmpty():
        return settled.select(columns)
    # Rows that repeat the page that is the response: counted by url, one of them keeps the payload.
    twins = joined.filter(F.col("mine") & (F.col("first.n") > 1))
    counted = twins.groupBy("digest", "page_id", "payload_bytes", "payload_digest", "url").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
    lead = counted.groupBy(F.col("digest").alias("of")).agg(F.min(F.struct(F.col("url").isNull().alias("none"), F.col("url").alias("url"))).alias("lead"))
    counted = counted.join(lead, F.col("digest") == F.col("of")).withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    counted = counted.withColumn("revisit", (F.col("no") > 1) | ~F.col("url").eqNullSafe(F.col("lead.url")))
    counted = counted.withColumn("refers_to", F.when(F.col("revisit"), F.col("page_id"))).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    return settled.select(columns).unionByName(counted.select(columns))


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Archives under folder, one a partition: the committed manifest (name, bytes, records).

    An attempt that is lost leaves at most a file that no manifest names.
    """
    spark = pages.sparkSession
    bounded_batches(spark, "4m")
    fs, home = _files(folder)
    fs.create_dir(posixpath.join(home, "archives"), recursive=True)
    # A revisit of a page without an id is told by an empty, not an absent, reference.
    rows = digested(pages, least).withColumn("refers_to", F.when(F.col("revisit"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")))).drop("revisit")
    manifest = rows.mapInArrow(_written(f"{folder}/archives"), "name string, bytes long, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema("name string, bytes long, records long").parquet(f"{folder}/manifest")


def member(read, at: int, step: int = 1 << 16):
    """(record bytes, end) of the gzip WARC member at a place, or None if there is none.

    The first 5 inflated bytes decide; read(offset, n) gives bytes, fewer at the
    end of the file.
    """
    import zlib

    inflate, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not inflate.eof:
            chunk = read(pos, step)
            if not chunk:
                return None
            pos += len(chunk)
            out += inflate.decompress(chunk)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    if not out.startswith(b"WARC/") or b"\r\n\r\n" not in out:
        return None
    return bytes(out), pos - len(inflate.unused_data)


def split_records(read, lo: int, hi: int, block: int = 1 << 20):
    """(start, record) of each member that starts in [lo, hi)."""
    at = lo
    while at < hi:
        chunk = read(at, min(block, hi - at) + len(MAGIC) - 1)
        i = chunk.find(MAGIC)
        if i < 0:
            if len(chunk) < len(MAGIC):
                return
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += i
        # Members follow each other, so after a true one the next is at its end.
        true = False
        while at < hi and (found := member(read, at)):
            true = True
            yield at, found[0]
            at = found[1]
        at += not true


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")

    def fields(lines):
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    warc = fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    body = rest[: int(warc.get("content-length", len(rest)))]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http.decode("utf-8", "replace").split("\r\n")[1:]), payload


SCHEMA = "archive string, start long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _read(folder: str):
    def run(batches):
        import hashlib

        import pyarrow as pa

        fs, home = _files(folder)

        def page(urn: str | None):
            number = (urn or "").strip("<>").removeprefix("urn:page:")
            return int(number) if number else None

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])
        for batch in batches:
            for s in batch.to_pylist():
                with fs.open_input_file(posixpath.join(home, s["name"])) as f:
                    rows, held = [], 0
                    for start, data in split_records(lambda o, n: f.read_at(n, o) if o < s["bytes"] else b"", s["lo"], s["hi"]):
                        warc, http, payload = parse(data)
                        kind, stated = warc.get("warc-type"), warc.get("warc-payload-digest", "").removeprefix(DIGEST)
                        full = kind == "response"
                        digest = hashlib.sha256(payload).hexdigest() if full else stated
                        if digest != stated:
                            raise ValueError(f"{s['name']} at {start}: the payload is not what its digest says")
                        rows.append((s["name"], start, kind, page(warc.get("warc-record-id")), warc.get("warc-target-uri"), page(warc.get("warc-refers-to")), len(payload) if full else int(http.get("content-length", 0)), digest, payload if full else None))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    return run


def read(spark: SparkSession, manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives (name, bytes) under folder, one row each; see SCHEMA.

    Ranges of split_bytes are dealt to tasks, about one to each; a record is read
    by the one whose range has its first byte. Revisits have no payload, but its size and digest.
    """
    last = F.greatest(F.ceil(F.col("bytes") / split_bytes) - 1, F.lit(0))
    splits = manifest.filter("bytes > 0").select("name", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("no"))
    splits = splits.select("name", "bytes", (F.col("no") * split_bytes).alias("lo"), F.least((F.col("no") + 1) * split_bytes, F.col("bytes")).alias("hi"))
    # Ranges, as many as splits: a number that is given is not coalesced, so each split has its task.
    return splits.repartitionByRange(max(1, splits.count()), "name", "lo").mapInArrow(_read(folder), SCHEMA)


def round_trip(pages: DataFrame, least: int = LEAST_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages (page_id, url, html), written and read back.

    Null html is an empty payload; null page_ids come back null; repeated rows
    have a record each. No pages give no records.
    """
    spark = pages.sparkSession
    folder = workspace(spark, "warc")
    manifest = write(pages, folder, least)
    found = read(spark, manifest, f"{folder}/archives", split_bytes)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
