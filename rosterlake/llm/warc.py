"""Deterministic sharded WARC writer and reader.

Records are sorted by page_id over shards that are fixed ranges of it, files
are rolled by compressed size, headers and digests are regenerated, and files
appear by rename from temporary names once a manifest row vouches for them.
The same table gives the same bytes, however often tasks are tried.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .membership import with_maybe
from .storage import commit, drop, new_dir, put_temporary, range_shards, read_file, slices, written

#: Compressed bytes at which a file is closed, and payload bytes of a shard, which one task writes as several files.
FILE_BYTES = 8 << 20
SHARD_BYTES = 64 << 20
PIECE = 1 << 14
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are never stored as revisits.
MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = {c: f"%{c:02X}" for c in [*range(0x21), 0x7F]}


def record_id(*parts: object) -> str:
    h = hashlib.sha1("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record as one gzip member without a time stamp."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, first_url: str | None, revisit: bool, date: str) -> bytes:
    sha = digest(payload).removeprefix("sha1:")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = lambda u: None if u is None else u.translate(_UNSAFE)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url, sha)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri(url)),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", digest(block)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_id, first_url, sha)), ("WARC-Refers-To-Target-URI", uri(first_url)), ("X-Refers-To-Page-Id", first_id), ("X-Payload-Length", len(payload))]
    return member([*fields, ("X-Page-Id", page_id), ("Content-Type", "application/http; msgtype=response")], block)


def _write(folder: str, file_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, held, size, n = None, 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{shard:08d}-{part:06d}.warc.gz"
            info = f"software: rosterlake\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
            first = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)
            digest = hashlib.sha1(first)
            for x in held:
                digest.update(x)
            temp = put_temporary(folder, name, [first, *held])
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "records": pa.array([n]), "bytes": pa.array([size + len(first)]), "sha1": [digest.hexdigest()], "temp_name": [temp], "file_name": [name]})

        for b in slices(batches, "html", 16 << 20):
            for s, page_id, url, html, first_id, first_url, revisit in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "first_id", "first_url", "revisit")), strict=True):
                if held and (s != shard or size >= file_bytes):
                    yield flush()
                    part, held, size, n = part + 1, [], 0, 0
                if s != shard:
                    shard, part = s, 0
                record = page_record(page_id, url, (html or "").encode(), first_id, first_url, revisit, date)
                held.append(record)
                size, n = size + len(record), n + 1
        if held:
            yield flush()

    return write


_MANIFEST = "shard int, part int, records long, bytes long, sha1 string, temp_name string, file_name string"


def write_pages(pages: DataFrame, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> tuple[str, DataFrame]:
    """Write pages (page_id, url, html, ...) as WARC files; returns their folder and manifest.

    Of records with equal payloads, that with the largest page_id is the
    response (a null id is smallest), and the others revisit it; rows that
    repeat the response's page_id are responses too.
    """
    spark = pages.sparkSession
    folder = new_dir(spark, "warc")
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(F.encode(payload, "UTF-8"))).withColumn("length", F.octet_length(payload))
    # one row a payload that occurs twice, combined on the map side
    groups = keyed.groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("first_id"), F.max_by("url", F.struct("page_id", "url")).alias("first_url"), F.max("length").alias("n")).where((F.col("copies") > 1) & (F.col("n") >= min_revisit_bytes))
    groups = written(groups.drop("copies", "n"), "payloads")
    # payloads that have copies meet their groups as ids; html is shuffled by page, never by a payload that many share
    split = with_maybe(keyed, "digest", groups.select("digest"))
    ids = split.where("maybe").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"))
    told = ids.join(groups, F.col("_digest") == F.col("digest")).select("_id", "_digest", "first_id", "first_url").distinct()
    several = split.where("maybe").join(told, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left").drop("_id", "_digest")
    single = split.where("not maybe").withColumn("first_id", F.lit(None).cast("long")).withColumn("first_url", F.lit(None).cast("string"))
    marked = several.unionByName(single).withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    placed, shards = range_shards(marked, "page_id", F.col("length"), shard_bytes, pages.select("page_id", F.octet_length(payload).alias("length")))
    ordered = placed.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "url", "digest")
    files = written(ordered.select("shard", "page_id", "url", "html", "first_id", "first_url", "revisit").mapInArrow(_write(folder, file_bytes, date), _MANIFEST), "files")
    manifest = commit(files, folder)
    drop(files, groups)
    return folder, manifest


def members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one by one, fed in pieces (what is left over is copied for each member)."""
    view, at = memoryview(raw), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            out.append(z.decompress(view[at : at + PIECE]))
            at = min(at + PIECE, len(view)) - len(z.unused_data)
        yield b"".join(out)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_pages(folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, html of every page record in the archives.

    Payload length and digest of a response are taken anew from its block; a
    revisit holds no payload, so it has a null html and its header's values.
    A file that differs from the manifest's digest, or a block or payload that
    differs from its header's, raises ValueError.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for name, sha1 in zip(b.column("file_name").to_pylist(), b.column("sha1").to_pylist(), strict=True):
                rows, size = [], 0
                raw = read_file(folder, name)
                if hashlib.sha1(raw).hexdigest() != sha1:
                    raise ValueError(f"{name} is not what the manifest vouches for")
                for record in members(raw):
                    fields, block = parsed(record)
                    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != digest(block):
                        raise ValueError(f"block digest of {fields['WARC-Record-ID']} in {name}")
                    kind, number = fields["WARC-Type"], lambda k, fields=fields: int(fields[k]) if k in fields else None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        found = digest(payload)
                        if fields["WARC-Payload-Digest"] != found:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} in {name}")
                        rows.append((number("X-Page-Id"), fields.get("WARC-Target-URI"), len(payload), found.removeprefix("sha1:"), kind, None, payload.decode()))
                        size += len(payload)
                    elif kind == "revisit":
                        rows.append((number("X-Page-Id"), fields.get("WARC-Target-URI"), number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number("X-Refers-To-Page-Id"), None))
                    if len(rows) >= 10_000 or size > 16 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    wide = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file_name", "sha1").repartition(wide, "file_name").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def archived_pages(pages: DataFrame, **options: int) -> DataFrame:
    """Write pages to WARC files and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row; a null html is an empty payload, a null url or page_id
    leaves its header out.  An empty table gives no files and no rows.
    """
    return read_pages(*write_pages(pages, **options)).drop("url", "html")
