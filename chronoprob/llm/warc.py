"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames, frames into bundle files. A bundle ends in a seek table (a
skippable frame in the public seekable format), so that any frame can be read alone; the index maps a
record's identifier to bundle, frame and place within the frame.

Of records with equal payloads of a certain size, the one with the largest page id is a response and the
others are revisits that refer to it; smaller payloads are all responses. A revisit carries the digest
and length of its payload, but not the payload.

Tasks write bundles into a shared folder under names of their own attempt, and Spark commits the index
with the names of the bundles that count; files of lost or repeated attempts are in no index and are not
read. Reading back opens the bundles that the index names, in tasks, by ranges of bytes.

Defined cases: a null html is an empty payload; a null url is left out; line breaks in a url are escaped;
a null page id takes no part in choosing the response but its record is written and, if its payload has a
response, refers to it; rows that repeat a response's page id and payload are responses too; an empty
table gives no bundles and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

#: Fixed numbers of the seekable format: the skippable frame's and the seek table's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "bundle string, frame int, frame_offset long, record_offset int, record_bytes int, record_id string"


@dataclass(frozen=True)
class Layout:
    frame_bytes: int = 256 << 10
    bundle_bytes: int = 32 << 20
    level: int = 3
    #: Payloads of fewer bytes are never revisits.
    dedupe_from: int = 1000


def record_types(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(page_id, digest, refers_to, is_revisit): one row for each page id and payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).distinct()
    owners = facts.where(F.col("size") >= layout.dedupe_from).groupBy("digest").agg(F.max("page_id").alias("owner"))
    both = facts.join(owners, "digest", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return both.select("page_id", "digest", F.when(revisit, F.col("owner")).alias("refers_to"), revisit.alias("is_revisit"))


def _urn(page_id) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    content = HTTP_HEAD if is_revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []),
        *([f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if is_revisit else []),
        f"WARC-Payload-Digest: {digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + content + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}: {lines[0][:40]}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    content = data[start : start + size]
    return head, content[content.index(b"\r\n\r\n") + 4 :], start + size + 4


class Bundle:
    """A bundle in the making."""

    def __init__(self, layout: Layout):
        import zstandard

        self.layout, self.packer = layout, zstandard.ZstdCompressor(level=layout.level, write_content_size=True)
        self.out, self.frames, self.index = io.BytesIO(), [], []
        self.frame, self.size, self.members = [], 0, []

    def add(self, record_id: str, record: bytes) -> None:
        self.members.append((self.size, len(record), record_id))
        self.frame.append(record)
        self.size += len(record)
        if self.size >= self.layout.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.index += [(len(self.frames), self.out.tell(), *m) for m in self.members]
            self.frames.append((len(packed), self.size))
            self.out.write(packed)
            self.frame, self.size, self.members = [], 0, []

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return self.out.getvalue() + struct.pack("<II", SKIPPABLE, len(table)) + table


def frame_places(table: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of each frame, from the entries of the seek table."""
    at, out = 0, []
    for packed, size in struct.iter_unpack("<II", table):
        out.append((at, packed, size))
        at += packed
    return out


def _system(folder: str):
    """Arrow's file system for a folder of any kind of store, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def _store(folder: str, name: str, data: bytes) -> str:
    """Write a file under a name that only this attempt has, whole or not at all."""
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}.part", compression=None) as f:
        f.write(data)
    system.move(f"{path}/{name}.part", f"{path}/{name}")
    return name


class Opened:
    """A bundle in the store, read piece by piece: the seek table first, then single frames."""

    def __init__(self, folder: str, name: str):
        system, path = _system(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {name}")
        self.frames = frame_places(self.file.read_at(8 * count, size - 9 - 8 * count))

    def frame(self, number: int) -> bytes:
        import zstandard

        offset, packed, size = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, offset), max_output_size=size)

    def close(self) -> None:
        self.file.close()


def write_archives(pages: DataFrame, folder: str | None = None, layout: Layout = Layout()) -> tuple[str, DataFrame]:
    """Write a record for each row; returns the folder and the committed index (see ``INDEX``)."""
    folder = folder or scratch(pages.sparkSession, "warc")
    kinds = record_types(pages, layout).withColumnRenamed("page_id", "_page_id")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("_digest"))
    # neither side has a size bound: one plan for every size, with pages dealt by id
    joined = rows.hint("merge").join(kinds, F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("_digest") == F.col("digest")))

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, written = Bundle(layout), 0

        def close() -> pd.DataFrame:
            name = _store(folder, f"bundle-{uuid.uuid4().hex}.warc.zst", bundle.finish())
            return pd.DataFrame([(name, *x) for x in bundle.index], columns=["bundle", "frame", "frame_offset", "record_offset", "record_bytes", "record_id"])

        for pdf in batches:
            for page_id, url, html, refers, revisit in pdf.itertuples(index=False):
                page, of = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                record = write_record(page, url, (html or "").encode("utf-8", "surrogatepass"), of, bool(revisit))
                bundle.add(_urn(page), record)
                written += len(record)
                if written >= layout.bundle_bytes:
                    yield close()
                    bundle, written = Bundle(layout), 0
        if bundle.frame or bundle.frames:
            yield close()

    # as strings, ids pass through pandas exactly
    texts = joined.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), "is_revisit")
    return folder, cut(texts.mapInPandas(bundles, INDEX), "warc-index")


def dealt_bundles(index: DataFrame) -> DataFrame:
    """(bundle): the bundles of ``index`` in as many partitions as there are bundles: a number given, which
    adaptive execution does not put together."""
    names = index.select("bundle").distinct()
    return names.repartition(max(1, names.count()), "bundle")


def read_archives(folder: str, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact: read from the bundles
    that ``index`` names, a frame at a time; a response is intact if its payload has the digest and length
    of its head. Only names of bundles are shuffled; a task opens the few bundles that it is dealt."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda urn: None if urn is None or urn == _urn(None) else urn[len("<urn:page:") : -1]
        for pdf in batches:
            for name in pdf["bundle"]:
                bundle = Opened(folder, name)
                for i in range(len(bundle.frames)):
                    data, at, found = bundle.frame(i), 0, []
                    while at < len(data):
                        head, payload, at = read_record(data, at)
                        digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                        kind, size = head["WARC-Type"], int(head["X-Payload-Length"])
                        intact = kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
                        url = head.get("WARC-Target-URI")
                        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        found.append((number(head["WARC-Record-ID"]), size, digest, kind, number(head.get("WARC-Refers-To")), url, intact))
                    yield pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"])
                bundle.close()

    read = dealt_bundles(index).mapInPandas(records, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, intact boolean")
    return read.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def fetch(folder: str, index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """(record_id, record): single records by id, each from its own frame."""
    wanted = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    places = wanted.groupBy("bundle", "frame").agg(F.collect_list(F.struct("record_offset", "record_bytes", "record_id")).alias("places"))  # a frame's records

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, frame, members in zip(pdf["bundle"], pdf["frame"], pdf["places"], strict=True):
                bundle = Opened(folder, name)
                data = bundle.frame(int(frame))
                bundle.close()
                yield pd.DataFrame([(m["record_id"], data[m["record_offset"] : m["record_offset"] + m["record_bytes"]]) for m in members], columns=["record_id", "record"])

    return places.mapInPandas(pick, "record_id string, record binary")


def round_trip(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    folder, index = write_archives(pages, layout=layout)
    return read_archives(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
