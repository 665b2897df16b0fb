"""WARC archives in Zstandard: written one frame per record behind a leading skippable frame that
holds the dictionary, and read back frame by frame with headers and lengths validated.

Archives go to the shared folder through its own file system, under names no other attempt uses, and
a manifest row is kept only for archives of tasks that ended well; a lost executor leaves orphans,
never half an archive in the manifest.

Defined results: a null payload is empty; null urls become an empty target; the page with the
smallest id among equal payloads is the response, other ids revisit it, repeated rows of the smallest
id are responses too; pages with a null id are responses unless a page with an id has their payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import fresh_path, written

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
VERSION = b"WARC/1.1"
ROLL_BYTES = 32 << 20
DICTIONARY_BYTES, SAMPLES = 16 << 10, 256
READ_BYTES = 1 << 20


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises WarcError where they are malformed or lengths disagree."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError("no record header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b": ")
        if not colon or name.decode() in headers:
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.decode()] = value.decode()
    for name in ("WARC-Type", "WARC-Record-ID", "Content-Length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the block has {len(rest) - 4}")
    return headers, rest[:n]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or none where the samples are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, steps=1).as_bytes() if len(samples) >= 32 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """One archive: the dictionary's frame, then one frame for each record."""

    def __init__(self, out, dict_bytes: bytes):
        self.out, self.size, self.records = out, 0, 0
        given = zstandard.ZstdCompressionDict(dict_bytes) if dict_bytes else None
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=True, write_checksum=True)
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(dict_bytes)) + dict_bytes)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.zstd.compress(data))
        self.records += 1


def frames(source) -> Iterator[bytes]:
    """Decoded frames of an archive, read in blocks; only one record is held at a time."""
    head = source.read(8)
    if len(head) < 8:
        raise WarcError("the archive has no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE_MAGIC:
        raise WarcError("the archive doesn't begin with a skippable frame")
    raw = source.read(size)
    if len(raw) != size:
        raise WarcError("the dictionary is cut short")
    if size and struct.unpack("<I", raw[:4])[0] != DICTIONARY_MAGIC:
        raise WarcError("the skippable frame holds no dictionary")
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if size else None)
    waiting = source.read(READ_BYTES)
    while waiting:
        one, parts = zstd.decompressobj(), []
        while True:
            parts.append(one.decompress(waiting))
            waiting = one.unused_data if one.eof else b""
            if one.eof:
                break
            waiting = source.read(READ_BYTES)
            if not waiting:
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)
        waiting = waiting or source.read(READ_BYTES)


def write_archives(pages: DataFrame, where: str, key: str = "page_id", url: str = "url", payload: str = "html", refers: str = "refers_to") -> DataFrame:
    """Write each row as a record to archives under `where`; rows with `refers` set become revisits
    without a payload. Returns (path, records), already run and stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        rows = ((k, u, (p or "").encode(), r) for b in batches for k, u, p, r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        first, held = [], 0
        for row in rows:
            first.append(row)
            held += len(row[2])
            if len(first) >= SAMPLES or held > ROLL_BYTES:
                break
        if not first:
            return
        known = dictionary([record("response", {}, r[2])[: 64 << 10] for r in first])
        stream, writer, path, done = None, None, "", []

        def close() -> None:
            if stream is not None:
                stream.close()
                done.append((path, writer.records))

        for k, u, body, r in (row for part in (first, rows) for row in part):
            if writer is None or writer.size > ROLL_BYTES:
                close()
                path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                stream = fs.open_output_stream(path)
                writer = ArchiveWriter(stream, known)
            headers = {
                "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": quote(u or "", safe=":/?&=#%+,;@~!$*'()[]"),
                "WARC-Payload-Digest": f"sha1:{digest(body)}", "X-Payload-Length": str(len(body)), "X-Page-Id": "" if k is None else str(k),
            }
            if r is None:
                writer.add(record("response", headers | {"Content-Type": "text/html; charset=utf-8"}, body))
            else:
                writer.add(record("revisit", headers | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(r)}, b""))
        close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done]), "records": pa.array([n for _, n in done], pa.int64())})

    rows = pages.select(key, F.col(url).cast("string"), payload, refers)
    return written(rows.mapInArrow(run, "path string, records bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, where: str, key_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """Every record of the archives in the manifest, checked: (page_id, url, payload_bytes,
    payload_digest, record_type, refers_to), and html if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(where)
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[list] = [[] for _ in range(7)]
                seen = 0
                with fs.open_input_stream(path) as source:
                    for data in frames(source):
                        h, block = parse(data)
                        seen += 1
                        kind, said = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (digest(block) != said or len(block) != int(h["X-Payload-Length"])):
                            raise WarcError(f"payload of {h['WARC-Record-ID']} disagrees with its header")
                        if kind == "revisit" and (block or not h.get("X-Refers-To-Page")):
                            raise WarcError(f"revisit {h['WARC-Record-ID']} is malformed")
                        row = (int(h["X-Page-Id"]) if h["X-Page-Id"] else None, unquote(h["WARC-Target-URI"]), int(h["X-Payload-Length"]), said, kind, int(h["X-Refers-To-Page"]) if kind == "revisit" else None, block.decode() if with_payload else None)
                        for o, v in zip(out, row, strict=True):
                            o.append(v)
                        if len(out[0]) >= 2000:
                            yield batch(out)
                            out = [[] for _ in range(7)]
                if seen != records:
                    raise WarcError(f"{path} has {seen} records of {records}")
                if out[0]:
                    yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html")
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names)

    spread = manifest.repartition(max(1, manifest.count()), "path")
    got = spread.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string")
    return got if with_payload else got.drop("html")


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """pages with refers_to: the smallest id of an equal payload of at least min_bytes, null on that row itself.

    Only ids and hashes are grouped; payloads are shuffled only if any of them repeats.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    small = pages.select(F.col(key).alias("k"), F.sha1(text.cast("binary")).alias("h")).where(F.octet_length(text) >= min_bytes)
    twice = small.groupBy("h").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("h", "first")
    revisits = written(small.join(twice, "h").where("NOT k <=> first").select("k", "h", "first").distinct(), "revisits")
    if revisits.isEmpty():
        return pages.withColumn("refers_to", F.lit(None).cast("bigint"))
    on = F.col(f"p.{key}").eqNullSafe(F.col("r.k")) & (F.sha1(F.coalesce(F.col(f"p.{payload}"), F.lit("")).cast("binary")) == F.col("r.h"))
    return pages.alias("p").join(revisits.alias("r").hint("shuffle_hash"), on, "left").select("p.*", F.col("r.first").cast("bigint").alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    where = fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(with_revisits(pages.select("page_id", "url", "html"), min_bytes=min_bytes), where)
    return read_archives(manifest, where)
