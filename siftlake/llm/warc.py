"""WARC archives: a distributed writer with revisit records, and a splittable reader.

The writer makes one gzip member per record, so that an archive can be read from any member on. The
reader deals out byte ranges of the files: a task looks for gzip magic in its range, takes a
candidate for a member only if it decodes to the header of a record, and owns the records that start
inside the range, reading on past its end to finish the last one. Texts in UTF-8 cannot hold gzip
magic, so no payload written here can look like a member, even where deflate stores it as it is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_schema, scratch_dir, stored

MAGIC = b"\x1f\x8b\x08"
#: Ranges that a task reads at most.
RANGES = 16
VERSION = b"WARC/1.1\r\n"
READ = 1 << 20
#: A member's header is decoded in parts of at most this size, up to its end.
HEADER_PART = 1 << 16
#: Fixed by the format: profile of revisit records whose payload is that of an earlier record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a folder given as URI or local path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit names the record it refers to and holds no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    data = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def planned(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """Which record each page becomes: ``page_id``, ``url``, ``payload``, ``digest``, ``kind`` and ``refers_to``.

    Digests are grouped with a combining aggregate and joined back; a digest that a large share of the
    pages has is split by the skew join.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    heads = (
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
        .where(large)
        .groupBy(F.sha1("payload").alias("digest"))
        .agg(F.max("page_id").alias("head"))
    )
    is_revisit = large & (F.col("page_id") < F.col("head"))
    return rows.join(heads.hint("merge"), "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(is_revisit, "revisit").otherwise("response").alias("kind"),
        F.when(is_revisit, F.col("head")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 1000,
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write a record per row into ``*.warc.gz`` files under ``folder``; returns their ``path`` and ``length``.

    Of rows with equal payloads of at least ``least_bytes``, the one with the largest id is a response and
    the others are revisits of it; smaller payloads are all responses. Rows that repeat the largest id are
    responses each; a row with a null id is a response. A null html is an empty payload, a null url leaves
    out the target. Each attempt of a task writes files of its own and only those of the attempt that
    succeeded are in the returned table, which is stored: a lost executor or a second attempt leaves no
    record twice. Files are closed at about ``file_bytes``.
    """
    arrow = arrow_schema("path string, length long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        where.create_dir(root, recursive=True)
        out, path, size = None, None, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(batch.column(k) for k in range(6)), strict=True):
                if out is None:
                    path, size = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(path, compression=None)
                data = record(kind.as_py(), page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t.type) for k, t in enumerate(arrow)], schema=arrow)

    plan = planned(pages, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes)
    return stored(plan.mapInArrow(run, "path string, length long"), "warc-files")


def header_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a record's header and where its block begins; none if ``data`` begins otherwise."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4


class _Window:
    """A file read forwards, of which only the part from a place on is held."""

    def __init__(self, file: pa.NativeFile, at: int, size: int) -> None:
        self.file, self.at, self.size, self.data = file, at, size, b""
        file.seek(at)

    def grow(self) -> bool:
        more = self.file.read(READ)
        self.data += more
        return bool(more)

    def drop(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def _is_member(window: _Window, k: int) -> bool:
    """Whether the candidate ``k`` bytes into the window decodes to a record's header."""
    unpack, got, fed = zlib.decompressobj(31), b"", k
    while True:
        piece = unpack.unconsumed_tail
        if not piece:
            piece = window.data[fed : fed + 4096]
            fed += len(piece)
        seen = max(0, len(got) - 3)
        try:
            got += unpack.decompress(piece, HEADER_PART)
        except zlib.error:
            return False
        if got.find(b"\r\n\r\n", seen) >= 0:
            return header_of(got) is not None
        if not VERSION[:7].startswith(got[:7]) and not got.startswith(b"WARC/1.") or unpack.eof:
            return False
        if not unpack.unconsumed_tail and fed >= len(window.data) and not window.grow():
            return False


def records_in(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields and block of each record whose member starts in ``[start, end)``."""
    window = _Window(file, start, size)
    found = start == 0  # a file begins with a member
    while window.at < end:
        if not found:  # look for magic and validate the candidate
            k = window.data.find(MAGIC)
            if k < 0:
                keep = min(len(window.data), len(MAGIC) - 1)
                window.drop(len(window.data) - keep)
                if window.at >= end or not window.grow():
                    return
                continue
            if window.at + k >= end:
                return
            if not _is_member(window, k):
                window.drop(k + 1)
                continue
            window.drop(k)
            found = True
        unpack, parts, fed = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                if fed >= len(window.data):
                    window.drop(fed)
                    fed = 0
                    if not window.grow():
                        return  # a member cut off by the end of the file
                piece = window.data[fed : fed + 65536]
                if not fed and not parts:
                    begin = window.at
                parts.append(unpack.decompress(piece))
                fed += len(piece) - len(unpack.unused_data)
        except zlib.error:  # damaged: go on at the next member
            window.drop(1)
            found = False
            continue
        window.drop(fed)
        data = b"".join(parts)
        head = header_of(data)
        if head is None:
            found = False
            continue
        fields, at = head
        yield begin, fields, data[at : at + int(fields["content-length"])]
        if len(window.data) < len(MAGIC):
            window.grow()
        found = window.data.startswith(MAGIC)


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, files: DataFrame, folder: str, *, split_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives in ``files`` (``path``, ``length``), read in ranges of ``split_bytes``.

    Columns: ``path``, ``start``, ``kind``, ``page_id``, ``url``, ``declared_digest`` (lower-case hex),
    ``refers_to``, ``payload`` (null for revisits) and ``payload_bytes`` (of the full payload, which a revisit
    declares in its HTTP header). Damaged members are skipped to the next valid one.
    """
    schema = (
        "path string, start long, kind string, page_id long, url string, declared_digest string, refers_to long, payload binary, payload_bytes long"
    )
    arrow = arrow_schema(schema)
    ranges = files.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("begin")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = filesystem(folder)
        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for path, length, begin in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with where.open_input_file(path) as file:
                    for start, fields, block in records_in(file, length, begin, min(begin + split_bytes, length)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        kind = fields["warc-type"]
                        rows.append(
                            (path, start, kind, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), base64.b32decode(digest).hex() if digest else None,
                             _page(fields.get("warc-refers-to")), None if kind == "revisit" else payload, size if kind == "revisit" else len(payload))
                        )
                        held += len(block)
                        if held > 4_000_000:
                            yield batch_of()
                            rows, held = [], 0
        if rows:
            yield batch_of()

    # A range is a few bytes to Spark and megabytes to its reader: the number of tasks is stated, so that ranges are not merged.
    number = int(files.agg(F.sum(F.greatest(F.ceil(F.col("length") / split_bytes), F.lit(1)))).first()[0] or 0)
    tasks = max(1, min(number, 4 * spark.sparkContext.defaultParallelism), -(-number // RANGES))
    return ranges.repartition(tasks).mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, *, split_bytes: int = 8 << 20, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back, a row per record.

    ``payload_digest`` is computed from the payload as read; for revisits it is the digest they declare.
    """
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(pages, folder, least_bytes=least_bytes)
    got = read_archives(spark, files, folder, split_bytes=split_bytes)
    return got.select(
        "page_id",
        "payload_bytes",
        F.coalesce(F.sha1("payload"), "declared_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )


def sha1_of(payload: bytes) -> str:
    return hashlib.sha1(payload, usedforsecurity=False).hexdigest()
