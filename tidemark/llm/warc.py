"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, one a record, into the shared folder
under a temporary name and renames it; what a task returns (one capture per record: URL key,
archive, offset, length) becomes a table, and only archives named there count. A payload of at
least ``min_revisit`` bytes that several pages share is stored once, as the response of the
largest page_id, and revisited by the others.

Index: captures sorted by reversed-host URL key over all tasks become compressed blocks of
bounded size; a sparse directory holds the first key of every block (or of every few blocks,
so that it never exceeds its bound). A lookup binary-searches the directory for each key,
opens the block, and range-reads the records it names, neighbours of one archive together.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, new_path

MIN_REVISIT = 1000
BLOCK_CAPTURES = 3000
DIRECTORY_ROWS = 1_000_000
READ_GAP = 1 << 16
READ_SPAN = 8 << 20
#: Archive bytes that one reading task takes, where there are more than the session's partitions of them.
TASK_BYTES = 64 << 20
ARCHIVE_BYTES = 256 << 20
CAPTURE = "key string, archive string, at long, length long"


def url_key(url: str | None) -> str:
    """The reversed-host key: ``https://www.a.example.com:8/p?q`` gives ``com,example,a,www:8)/p?q``."""
    rest = (url or "").partition("://")[2] or (url or "")
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, colon, port = rest[:cut].lower().partition(":")
    path = rest[cut:].partition("#")[0]
    return ",".join(reversed(host.split("."))) + colon + port + ")" + (path if path.startswith("/") else f"/{path}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit (payload None) without."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    header = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url or "")),
        ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if payload is None:
        header += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    header.append(("Content-Length", str(len(block))))
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in header) + "\r\n"
    return lines.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, payload and the figures of one record; raises where the record contradicts itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    header = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(header["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")) if k.lower() == "content-length")
    sha1 = base64.b32decode(header["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda v: None if v is None or "null" in v else int(v.removeprefix("<urn:page:").removesuffix(">"))
    kind = header["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError(f"{header['WARC-Record-ID']}: the payload does not match its digest")
    return {
        "page_id": number(header["WARC-Record-ID"]), "url": header["WARC-Target-URI"], "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": sha1, "record_type": kind, "refers_to": number(header.get("WARC-Refers-To")),
    }


def mark_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, size, sha1, refers_to): the response's id where a record revisits it.

    One row per shared digest is joined back, so a digest that a third of the pages share is
    pre-aggregated first and split by adaptive execution in the join. Payloads too small to be
    revisited share no key, whatever they hold.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("sha1"))
    shared = (
        sized.where(F.col("size") >= min_revisit).groupBy("sha1", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where("n > 1 and response is not null")
        .select("sha1", "size", "response")
    )
    key = F.when(F.col("size") >= min_revisit, F.concat_ws(":", "sha1", "size")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    keyed = sized.withColumn("key", key)
    return keyed.join(shared.select(F.concat_ws(":", "sha1", "size").alias("key"), "response"), "key", "left").select(
        "page_id", "url", "html", "size", "sha1",
        F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the archives under ``folder`` and returns their captures.

    A task starts a new archive every ``ARCHIVE_BYTES``. The archives of a failed or repeated
    task attempt are named by no capture.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at, rows = None, "", 0, []

        def close():
            out.close()
            store.move(f"{root}/{name}.part", f"{root}/{name}")

        def captures():
            keys, names, offsets, lengths = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "archive", "at", "length"])

        for batch in batches:
            for page_id, url, html, size, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}.part", compression=None)
                payload = html.encode("utf-8", "surrogatepass") if refers_to is None else None
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, payload, size, sha1, refers_to)) + packer.flush()
                out.write(member)
                rows.append((url_key(url), name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    close()
                    out = None
            if out is None and rows:
                yield captures()
                rows = []
        if out is not None:
            close()
        if rows:
            yield captures()

    return mark_revisits(pages, min_revisit).mapInArrow(run, CAPTURE)


def build_index(captures: DataFrame, block_captures: int = BLOCK_CAPTURES) -> DataFrame:
    """(first_key, last_key, n, bytes, block): captures in key order as compressed blocks, and the bytes their records take."""

    def run(batches):
        held: list[tuple] = []

        def pack(rows):
            lines = "\n".join("\x1f".join((k.encode("unicode_escape").decode(), a, str(o), str(n))) for k, a, o, n in rows)
            return rows[0][0], rows[-1][0], len(rows), sum(r[3] for r in rows), zlib.compress(lines.encode(), 6)

        def emit(blocks):
            columns = list(zip(*blocks, strict=True))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["first_key", "last_key", "n", "bytes", "block"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= block_captures:
                yield emit([pack(held[:block_captures])])
                held = held[block_captures:]
        if held:
            yield emit([pack(held)])

    # The order of equal keys is that of their records, so one hot URL may span many blocks and tasks.
    return captures.repartitionByRange("key", "archive", "at").sortWithinPartitions("key", "archive", "at").mapInArrow(run, "first_key string, last_key string, n int, bytes long, block binary")


def unpack_block(block: bytes) -> list[tuple[str, str, int, int]]:
    rows = (line.split("\x1f") for line in zlib.decompress(block).decode().split("\n"))
    return [(k.encode().decode("unicode_escape"), a, int(o), int(n)) for k, a, o, n in rows]


def open_blocks(blocks: DataFrame) -> DataFrame:
    """The captures of index blocks."""

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                columns = list(zip(*unpack_block(block), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["key", "archive", "at", "length"])

    return blocks.select("block").mapInArrow(run, CAPTURE)


def read_records(captures: DataFrame, folder: str, size: int, with_payload: bool = False) -> DataFrame:
    """Range-reads the captures' records, neighbours of one archive together.

    Captures are dealt by archive and stretch of archive, so a large archive is no larger a
    task. The tasks' number follows ``size``, the bytes of all archives: a capture is a small
    row and much work.
    """
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + (["payload"] if with_payload else [])
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        source, opened = None, None

        def read(name, wanted):
            nonlocal source, opened
            if name != opened:
                if source is not None:
                    source.close()
                source, opened = store.open_input_file(f"{root}/{name}"), name
            start, end = wanted[0][0], max(o + n for o, n in wanted)
            raw = source.read_at(end - start, start)
            records = [parse_record(zlib.decompress(raw[o - start : o - start + n], 31)) for o, n in wanted]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in records], kinds[c]) for c in columns], columns)

        for batch in batches:
            wanted, name = [], None
            for archive, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if wanted and (archive != name or at > wanted[-1][0] + wanted[-1][1] + READ_GAP or at + length - wanted[0][0] > READ_SPAN):
                    yield read(name, wanted)
                    wanted = []
                name = archive
                wanted.append((at, length))
            if wanted:
                yield read(name, wanted)

    stretch = F.floor(F.col("at") / READ_SPAN)
    tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    dealt = captures.select("archive", "at", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "at")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    return dealt.mapInArrow(run, schema)


class CaptureIndex:
    """Archives, index blocks and directory of one collection in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.blocks = spark.read.parquet(f"{folder}/index")
        self.size = self.blocks.agg(F.sum("bytes")).first()[0] or 0

    @classmethod
    def write(cls, pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT, block_captures: int = BLOCK_CAPTURES) -> CaptureIndex:
        spark = pages.sparkSession
        folder = folder or new_path(spark, "warc")
        captures, _ = materialize(write_archives(pages, f"{folder}/archives", min_revisit), "captures")
        build_index(captures, block_captures).write.parquet(f"{folder}/index")
        return cls(spark, folder)

    def read_all(self, with_payload: bool = False) -> DataFrame:
        return read_records(open_blocks(self.blocks), f"{self.folder}/archives", self.size, with_payload)

    def directory(self, max_rows: int = DIRECTORY_ROWS) -> list[str]:
        """The sparse directory: sorted first keys, of every block or of as many as the bound allows."""
        keys = self.blocks.select("first_key")
        share = -(-keys.count() // max_rows)
        if share > 1:
            keys = keys.where(F.pmod(F.xxhash64("first_key"), F.lit(share)) == 0).limit(max_rows)
        return sorted({r["first_key"] for r in keys.collect()})

    def lookup(self, urls: DataFrame, with_payload: bool = True) -> DataFrame:
        """The records captured of each distinct URL in ``urls`` (column ``url``)."""
        directory = self.directory()

        def keys(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["wanted"])

        def slot(keys: pa.Array) -> pa.Array:
            # Blocks from the last first key before a key on may hold it.
            return pa.array([bisect.bisect_left(directory, k) for k in keys.to_pylist()], pa.int32())

        def slots(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), slot(batch.column(0))], ["wanted", "slot"])

        def block_slots(batches):
            for batch in batches:
                for first, last, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    span = range(bisect.bisect_left(directory, first), bisect.bisect_left(directory, last) + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(list(span), pa.int32()), pa.array([block] * len(span), pa.binary())], ["slot", "block"])

        wanted = urls.where("url is not null").select("url").mapInArrow(keys, "wanted string").distinct().mapInArrow(slots, "wanted string, slot int")
        blocks = self.blocks.select("first_key", "last_key", "block").mapInArrow(block_slots, "slot int, block binary")
        # A block spans few slots: one, but for the keys that the bound left out of the directory.
        opened = blocks.join(wanted.select("slot").distinct(), "slot", "left_semi").select("block").distinct()
        captures = open_blocks(opened).join(wanted, F.col("key") == F.col("wanted"), "left_semi")
        return read_records(captures, f"{self.folder}/archives", self.size, with_payload)


def archive_pages(pages: DataFrame) -> DataFrame:
    """The op7 digest per page row, from the records that the index finds for the pages' URLs.

    A null html is an empty payload, a null URL an empty target. Rows that repeat the largest
    page_id of a payload are all its responses; a null page_id revisits like others but is no
    response that others refer to. Extra columns are not read, and an empty table gives an
    empty result.
    """
    index = CaptureIndex.write(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    found = index.lookup(pages.select(F.coalesce("url", F.lit("")).alias("url")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM r
"""
