"""WARC archives in Zstandard: one frame a record, dictionary in the leading skippable frame.

Writing: archives are files of Spark's text writer, so any store that Spark writes to will do and task
attempts commit as usual. The first row of a file is the skippable frame that holds the dictionary, each later
row the frame of one record; the line separator is itself an empty skippable frame (its eight bytes are
ASCII), so a file is a plain sequence of frames.

Reading: each archive is taken as a whole (writing bounds its size), the dictionary is loaded from the
leading skippable frame, frames are found by walking their block headers, each is decoded to one record, and
the record's version line, header fields and lengths are checked, and its payload against its digest.

Of records with equal payloads of at least REVISIT_BYTES bytes, the one with the largest page_id is the
response and the others are revisits of it, without payload.

Defined cases: a null payload is empty; a page without a page_id is a response; rows that repeat a page_id and payload share one response, of which
one row is the response; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fresh_path, only, parts, prepare, staged

REVISIT_BYTES = 1000
#: Payload bytes an archive is meant to hold, pages the dictionary is trained on at most, its size, the level.
ARCHIVE_BYTES, SAMPLE_PAGES, DICT_BYTES, LEVEL = 32 << 20, 400, 64 << 10, 3
#: Magic of the skippable frame that holds a dictionary, of other skippable frames, of frames.
DICT_MAGIC, SKIP_LOW, SKIP_HIGH, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0x184D2A5F, 0xFD2FB528
#: Fixed value: an empty skippable frame, as text.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP headers of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The checked fields of one record; raises ValueError where it isn't well formed."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon:
            raise ValueError(f"not a header field: {x[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ValueError(f"a record has no {name}")
    n = int(fields["content-length"])
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    if hashlib.sha1(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError("the block differs from its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    size, digest = int(sizes[0]), fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE):
        raise ValueError("not a well-formed revisit")
    number = lambda x: int(n) if (n := x.rsplit(":", 1)[1].rstrip(">")) else None
    refers = fields.get("warc-refers-to")
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(refers) if refers else None, "payload": payload if kind == "response" else None}


def frames(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, first byte, end) of each frame of an archive, by the frames' own headers."""
    import zstandard

    at = 0
    while at < len(raw):
        magic = int.from_bytes(raw[at : at + 4], "little")
        if SKIP_LOW <= magic <= SKIP_HIGH:
            end = at + 8 + int.from_bytes(raw[at + 4 : at + 8], "little")
        elif magic == FRAME_MAGIC:
            end = at + zstandard.frame_header_size(raw[at : at + 18])
            last = False
            while not last:
                head = int.from_bytes(raw[end : end + 3], "little")
                last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ValueError("a reserved block type")
                end += 3 + (1 if kind == 1 else size)
            end += 4 * (raw[at + 4] >> 2 & 1)  # checksum
        else:
            raise ValueError(f"no frame at byte {at}")
        if end > len(raw):
            raise ValueError("a frame is cut off")
        yield magic, at, end
        at = end


def read_archive(raw: bytes) -> Iterator[dict]:
    """Records of one archive."""
    import zstandard

    reader = zstandard.ZstdDecompressor()
    for k, (magic, at, end) in enumerate(frames(raw)):
        if magic == FRAME_MAGIC:
            yield parse_record(reader.decompress(raw[at:end], max_output_size=1 << 31) if zstandard.frame_content_size(raw[at : at + 18]) < 0 else reader.decompress(raw[at:end]))
        elif k == 0 and magic == DICT_MAGIC:
            data = raw[at + 8 : end]
            if data[:4] == FRAME_MAGIC.to_bytes(4, "little"):  # the dictionary may be compressed itself
                data = zstandard.ZstdDecompressor().decompress(data)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_PAGES pages, those whose ids have the smallest hashes."""
    import zstandard

    rows = only(pages, page_id="long", html="string").where("page_id is not null and length(html) between 1 and 100000")
    # ids alone are ordered; the pages of the chosen ones are fetched then
    ids = [r[0] for r in rows.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()]
    sample = rows.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect() if ids else []
    blobs = [r["html"].encode() for r in sample]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blobs).as_bytes() if len(blobs) >= 8 else b"".join(blobs)[-DICT_BYTES:]
    except zstandard.ZstdError:  # too little to learn from: raw content is a dictionary too
        return b"".join(blobs)[-DICT_BYTES:]


_PACKED = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("copies", T.IntegerType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("packed", T.BinaryType()),
])


def classified(pages: DataFrame, partitions: int, dictionary: bytes) -> DataFrame:
    """Rows of _PACKED, dealt and sorted by (page_id, payload_digest).

    Marks come first (copies 0, refers_to the response's page_id), then the pages of that id and digest, each with
    its payload's frame. Payloads are compressed where they are read and shuffled once: marks and pages are one table, so
    no join moves them again. Pages alike in id, url and payload reach the shuffle once a batch, with their number.
    """
    rows = only(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("url", F.coalesce("url", F.lit("")))
    narrow = rows.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(F.col("html").cast("binary")).alias("payload_digest")).where(F.col("payload_bytes") >= REVISIT_BYTES)
    narrow = narrow.groupBy("page_id", "payload_digest").agg(F.count("*").alias("rows"))
    groups = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("keep"), F.sum("rows").alias("n")).where("n > 1 and keep is not null")
    groups = staged(groups.select("payload_digest", "keep"), "groups")  # apart from the join, so that Spark may split a group with very many pages there
    empty = {"copies": F.lit(0), "refers_to": F.col("keep"), "url": F.lit(None).cast("string"), "payload_bytes": F.lit(None).cast("long"), "packed": F.lit(None).cast("binary")}
    marks = narrow.where("page_id is not null").join(groups, "payload_digest").select("page_id", "payload_digest", *[c.alias(k) for k, c in empty.items()])

    def pack(b: pa.RecordBatch):
        packer = _packer(dictionary)
        seen: dict[tuple, list] = {}
        for page_id, url, html in zip(*b.columns):
            raw = html.as_py().encode()
            page_id, url, digest = page_id.as_py(), url.as_py(), hashlib.sha1(raw).hexdigest()
            if (row := seen.get((page_id, url, digest))) is not None:
                row[2] += 1
            else:
                seen[page_id, url, digest] = [page_id, digest, 1, None, url, len(raw), packer.compress(raw)]
        yield [list(c) for c in zip(*seen.values())] if seen else [[] for _ in _PACKED.fields]

    full = arrow_map(rows.select("page_id", "url", "html"), pack, _PACKED)
    # pages without an id are not marked, so they may stand anywhere
    dealt = full.unionByName(marks).repartition(partitions, F.coalesce("page_id", F.xxhash64("payload_digest", "url")))
    return dealt.sortWithinPartitions("page_id", "payload_digest", "copies")


def _packer(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


def _frames(out: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])


def write_archives(pages: DataFrame) -> str:
    """Write a record for each row of pages; gives the archives' folder."""
    import zstandard

    spark = pages.sparkSession
    prepare(spark)
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    dictionary = train_dictionary(pages)
    path = fresh_path(spark, "warc")

    def run(batches):
        packer = _packer(dictionary)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        first = DICT_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
        begun, mark, answered = False, None, True
        for b in batches:
            out = [] if begun else [first]
            begun = True
            for page_id, digest, copies, refers, url, n, packed in zip(*(c.to_pylist() for c in b.columns)):
                if not copies:
                    mark, answered = (page_id, digest, refers), refers != page_id
                    continue
                target = mark[2] if mark and page_id is not None and mark[:2] == (page_id, digest) else None
                payload = None
                for _ in range(copies):
                    revisit = target is not None and answered
                    answered = True
                    if payload is None and not revisit:
                        payload = reader.decompress(packed)
                    out.append(packer.compress(record(page_id, url, b"" if revisit else payload, n, digest, target if revisit else None)))
                    if len(out) == 1000:
                        yield _frames(out)
                        out = []
            yield _frames(out)

    n = int(max(1, -(-size // ARCHIVE_BYTES), min(parts(spark), -(-size // (1 << 20)))))
    frame = classified(pages, n, dictionary).mapInArrow(run, T.StructType([T.StructField("frame", T.BinaryType())]))
    frame.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)
    return path


_READ = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]."""
    schema = _READ if with_payload else T.StructType(_READ.fields[:-1])
    names = schema.names
    kinds = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows: list[dict] = []
                for r in read_archive(raw):
                    rows.append({k: r[k] for k in names})
                    if len(rows) == 500:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], kinds[type(f.dataType)]) for f in schema.fields], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
