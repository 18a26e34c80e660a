"""WARC archives compressed with an embedded Zstandard dictionary, written and read back (operator 7).

A task writes one archive per `FILE_BYTES` of payload: it buffers the records, trains a dictionary on a sample of them,
puts the dictionary (itself compressed) in a skippable frame at the head of the file and compresses each record as a
frame of its own, so any record can be read from its offset alone. Archives are written under a name of the attempt and
then moved, so a task that is run again leaves one whole file. Any store that pyarrow's filesystems know can hold them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.llm.common import new_path, read, saved

#: The skippable frame that holds the dictionary, and the frame of plain Zstandard data.
DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
FILE_BYTES, DICT_BYTES, SAMPLE_BYTES = 32 << 20, 64 << 10, 4 << 20
#: Pieces of records that a dictionary is trained on at least, if the records have as many.
SAMPLES = 256
DATE = "2020-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP header and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; a response's digest and length are computed from its payload again."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != said or digest32(payload) != digest):
        raise ValueError("payload and header disagree")
    page = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x and x != _urn(None) else None
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": said,
        "payload_digest": digest, "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of what records have in common; None for a single record and where there is too little to learn from.

    Samples are pieces of bounded length from every record, more of each where records are few, so that an archive of a few
    large records has as many samples as one of many small ones.
    """
    if len(records) < 2:
        return None
    total = sum(map(len, records))
    size = min(128 << 10, max(64, min(total, SAMPLE_BYTES) // SAMPLES))
    each = max(1, SAMPLES // len(records), min(total, SAMPLE_BYTES) // size // len(records))
    step = max(1, len(records) * each * size // SAMPLE_BYTES)
    sample = []
    for i, r in enumerate(records):
        places = range(0, len(r), max(size, -(-len(r) // each)))
        sample += [r[at : at + size] for k, at in enumerate(places) if (i + k) % step == 0]
    known = sum(map(len, sample))
    try:
        return zstandard.train_dictionary(max(256, min(DICT_BYTES, known // 8)), sample)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of an archive and each record's (offset, length)."""
    head, trained = b"", _dictionary(records)
    if trained is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        head = struct.pack("<II", DICT_MAGIC, len(packed)) + packed
    pack = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    out, places, at = [head], [], len(head)
    for r in records:
        frame = pack.compress(r)
        places.append((at, len(frame)))
        out.append(frame)
        at += len(frame)
    return b"".join(out), places


def frames(handle) -> Iterator[bytes]:
    """The records of an open archive, one after the other; one record is in memory at a time."""
    trained, start = None, handle.read(8)
    if len(start) == 8 and struct.unpack("<II", start)[0] == DICT_MAGIC:
        packed = handle.read(struct.unpack("<II", start)[1])
        raw = zstandard.ZstdDecompressor().decompress(packed) if struct.unpack("<I", packed[:4])[0] == ZSTD_MAGIC else packed
        trained, start = zstandard.ZstdCompressionDict(raw), b""
    unpack, rest = zstandard.ZstdDecompressor(dict_data=trained), start
    while True:
        rest = rest or handle.read(1 << 16)
        if not rest:
            return
        one, out = unpack.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := handle.read(1 << 16)):
                raise ValueError("the archive ends inside a record")
            out.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(out)


def _store(uri: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def classed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, kind, refers_to): of equal payloads the largest page_id is the response.

    Rows without an id revisit a row with one; if no row of a payload has an id, all are responses.
    """
    own = pages.withColumn("digest", F.sha1("payload"))
    # written before it is joined: a join of plain exchanges can split the partition of a payload that many pages share
    last, _ = saved(own.groupBy("digest").agg(F.max("page_id").alias("last")), "responses")
    first = F.col("page_id").eqNullSafe(F.col("last"))
    return own.join(last, "digest").select("page_id", "url", "payload", F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as archives below folder; returns (uri, n_records) of every archive, once it is read.

    A null html is an empty payload, equal to every other empty one. A null url leaves the header out. A row without a
    page_id is a record without a number, never named by another. Repeated rows: all are responses if they are the largest
    id. Other columns are not read, so clashing names don't matter.
    """
    given = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))

    def write_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        held, size = [], 0

        def flush() -> pd.DataFrame:
            data, _ = archive(held)
            name = uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(data).hexdigest()).hex
            draft, final = f"{base}/.{name}-{uuid.uuid4().hex}", f"{base}/{name}.warc.zst"
            with store.open_output_stream(draft, compression=None) as f:
                f.write(data)
            store.move(draft, final)
            return pd.DataFrame({"uri": [f"{folder}/{name}.warc.zst"], "n_records": [len(held)]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                payload = bytes(row.payload)
                number = lambda x: None if x is None else int(x)
                held.append(record(row.kind, number(row.page_id), row.url, payload, digest32(payload), number(row.refers_to)))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    # ids travel as text: beside nulls pandas would turn them to floating point
    named = classed(given).select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "kind", F.col("refers_to").cast("string").alias("refers_to"))
    return named.mapInPandas(write_all, "uri string, n_records long")


def load(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of archives (uri)."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads
    kinds = dict(zip(["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"], ["long", "string", "string", "long", "string", "long", "binary"], strict=True))

    def read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["uri"]:
                store, path = _store(uri)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as handle:
                    for raw in frames(handle):
                        rows.append(parse(raw))
                        size += len(raw)
                        if size >= 4 << 20:
                            yield _table(rows)
                            rows, size = [], 0
                if rows:
                    yield _table(rows)

    def _table(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in names})
        return out.astype({"refers_to": "Int64", "page_id": "Int64", "payload_bytes": "int64"})

    return archives.select("uri").repartition("uri").mapInPandas(read_all, ", ".join(f"{n} {kinds[n]}" for n in names))


def archived(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back. An empty table gives an empty result."""
    spark = pages.sparkSession
    listed, _ = saved(write(pages, new_path(spark, "warc")), "archives")  # a row an archive
    return load(listed, payloads=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, max(page_id) AS last FROM p GROUP BY x),
d AS (
  SELECT x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 5 * (q // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (q % 4))) & 31 AS BIGINT) + 1, 1), '' ORDER BY q) AS b
  FROM (SELECT DISTINCT x FROM p), range(0, 32) r(q) GROUP BY x
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, b AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, url
FROM p JOIN m USING (x) JOIN d USING (x)
"""
