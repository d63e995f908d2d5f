"""WARC archives with a Zstandard dictionary of their own.

Each task writes one archive: it trains a dictionary on its first records, puts it in
a leading skippable frame, and compresses every record as a frame of its own, so that
any record can be read by itself. Repeated payloads are revisit records without a body.
Archives are read back record by record in bounded memory.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wirepulse.llm import bloom
from wirepulse.llm.files import attempt_path, create, open_file, output_folder
from wirepulse.session import checkpointed

# Fixed value: the skippable frame that holds the dictionary of a compressed archive.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of records a dictionary is trained on, and of the dictionary.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
#: Payloads from this size on are archived once.
REVISIT_BYTES = 1000
#: Date of the records; an archive is a function of its input.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to)),
        ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """Headers, payload and HTTP headers of a record."""
    top, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = top.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of another length than it says")
    head, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload, dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records; of raw content where there are too few to train on."""
    if not records:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8)
    except zstandard.ZstdError:
        raw = b"".join(records)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Buffers at most ``SAMPLE_BYTES`` (and one record), then trains and streams."""

    def __init__(self, stream):
        self.stream, self.sample, self.size, self.compressor = stream, [], 0, None

    def write(self, record: bytes) -> None:
        if self.compressor:
            self.stream.write(self.compressor.compress(record))
            return
        self.sample.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        # Long records count by their beginnings: a dictionary is for what records have in common.
        dictionary = train([r[: SAMPLE_BYTES // 16] for r in self.sample])
        if dictionary:
            content = dictionary.as_bytes()
            self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
        for record in self.sample:
            self.stream.write(self.compressor.compress(record))
        self.sample = []

    def close(self) -> None:
        if not self.compressor:
            self._start()
        self.stream.close()


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    dictionary, data = None, stream.read(8)
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        content = stream.read(struct.unpack("<I", data[4:])[0])
        kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        dictionary, data = zstandard.ZstdCompressionDict(content, dict_type=kind), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    raise ValueError("archive ends inside a record")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(page, url, html, digest, winner)``: ``winner`` is the id that a revisit refers to, else null.

    Only payloads that occur twice need to meet: a Bloom filter of their digests, of fixed
    size, sends the rest past the join.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("html"))
    # The digest is computed where it is needed: a row that carries it is half as wide again.
    digest = F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1("html"))
    groups = rows.select("page", digest.alias("digest")).where("digest is not null").groupBy("digest")
    repeated = checkpointed(groups.agg(F.max("page").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null").select("digest", "winner"))
    probed = bloom.probe(rows.withColumn("digest", digest), F.col("digest"), bloom.build(repeated, F.col("digest")), "possible")
    alone = probed.where(~F.col("possible")).select("page", "url", "html", F.lit(None).cast("long").alias("winner"))
    met = probed.where("possible").join(repeated, "digest", "left").select("page", "url", "html", F.col("winner").cast("long"))
    return alone.unionAll(met)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one archive per task; returns their ``(path, records)``, checkpointed.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the row with the largest id is the
    response (several rows with that id and payload all are), the others revisit it.
    A null html is an empty payload, a null url ``about:blank``; rows with a null id are
    written without one and revisit like others, but are never referred to. Repeated
    rows are written each. No rows, no archives. Other columns are not read.
    """
    plan = planned(pages, id_col, url_col, html_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, count = None, attempt_path(folder, ".warc.zst"), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for page, url, html, winner in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    writer = writer or ArchiveWriter(create(path))
                    payload = html.encode("utf-8", "surrogatepass")
                    revisit = winner is not None and winner != page
                    writer.write(make_record(page, url, payload, hashlib.sha1(payload).hexdigest(), winner, revisit))
                    count += 1
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return checkpointed(plan.mapInArrow(run, "path string, records long"))


RECORD_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """One row per record of the archives in ``archives (path, ...)``.

    A response's size and digest are taken from its payload and must agree with its
    headers; a revisit's are those its headers state for the full payload.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=list(names))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_file(path) as stream:
                    for record in read_archive(stream):
                        headers, payload, http = parse_record(record)
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http["Content-Length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"damaged record in {path}")
                        page, refers = (headers.get(n) for n in ("X-Page-ID", "X-Refers-To-Page"))
                        rows.append((page and int(page), size, digest, kind, refers and int(refers), headers["WARC-Target-URI"]))
                        if len(rows) == 4096:
                            yield emit(rows)
                            rows = []
                if rows:
                    yield emit(rows)

    count = max(1, archives.count())
    return archives.select("path").repartition(count).mapInArrow(run, RECORD_FIELDS)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write archives of all pages to the shared folder and read them back."""
    spark = pages.sparkSession
    written = write_archives(pages, output_folder(spark, "warc"))
    return read_archives(spark, written).drop("url")


#: The same in SQL, without archives.
ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS winner FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN winner IS NULL OR winner IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN winner IS DISTINCT FROM page_id THEN winner END AS refers_to
FROM w
"""
