"""WARC archives: writing, a normaliser of whole-file gzip, an offset index, reading.

A crawl often arrives as one gzip stream for a whole file, which nothing can
seek in. The normaliser inflates such a stream once, record by record, writes
every record as a gzip member of its own and notes where it stands; with that
index any record can be read alone, and reading is spread over tasks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import materialize, new_path, shuffle_partitions

#: Record bytes, before compression, from which a task begins another archive.
ARCHIVE_BYTES = 64_000_000
#: A fixed date, as pages carry none.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 3
_READ = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str, mode: str):
    """A stream of a file in any store that pyarrow can reach."""
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(name, compression=None)
    return store.open_input_file(name) if mode == "seek" else store.open_input_stream(name, compression=None)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers, which hold the length, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(inflated: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the bytes of an archive; only one record is held at a time."""
    held = bytearray()
    for part in inflated:
        held += part
        while (at := held.find(b"\r\n\r\n")) >= 0:
            end = at + 4 + int(_fields(bytes(held[:at]))["content-length"]) + 4
            if len(held) < end:
                break
            yield bytes(held[:end])
            del held[:end]
    if held:
        raise ValueError("the archive ends inside a record")


def _inflate(path: str) -> Iterator[bytes]:
    stream = _open(path, "r")
    inflater = zlib.decompressobj(wbits=31)
    with stream:
        while data := stream.read(_READ):
            while data:
                yield inflater.decompress(data)
                data = inflater.unused_data
                if inflater.eof:
                    inflater = zlib.decompressobj(wbits=31)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to, the page with an equal payload that stands for it.

    Of equal payloads of at least `min_bytes` bytes, the largest page_id is the
    response and has no refers_to. A null page_id counts as smaller than any.
    Only payloads that come again are joined, and they are written first, so
    that the join can split the pages of one that very many pages have.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_digest", F.unhex(F.sha1("html")))
    several = rows.groupBy("_digest").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
    first = materialize(several.where("_n > 1").drop("_n"), "payloads")
    refers = F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_response")), F.col("_response"))
    return rows.join(first, "_digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the frame of `mark_revisits` as archives, each one gzip stream; gives their paths.

    Every task writes its own files under new names, so what a failed attempt
    leaves behind is in no list. The result is lazy: write it out once.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = packer = None
        size, paths = 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c].astype("object").where(batch[c].notna(), None) for c in ("page_id", "url", "html", "refers_to"))):
                if stream is None:
                    paths.append(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    stream, packer, size = _open(paths[-1], "w"), zlib.compressobj(1, wbits=31), 0
                data = record(page_id, url, html.encode(), refers_to)
                stream.write(packer.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    stream.write(packer.flush())
                    stream.close()
                    stream = None
        if stream is not None:
            stream.write(packer.flush())
            stream.close()
        yield pd.DataFrame({"path": paths}, dtype="object")

    # ids as text: beside nulls, pandas would make them floating point
    as_text = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return as_text.mapInPandas(write, "path string")


def normalize(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite whole-file gzip archives with a member for each record, beside a sidecar index.

    `archives` has `path`. Gives the index: archive, offset, length, one row a
    record; the same is in `<archive>.index`, a line of JSON for each. Streams
    that already have several members are taken too. The result is lazy.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                archive = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                offsets, lengths, at = [], [], 0
                with _open(archive, "w") as out:
                    for data in split_records(_inflate(path)):
                        packer = zlib.compressobj(level, wbits=31)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                with _open(f"{archive}.index", "w") as out:
                    out.write("".join(json.dumps({"offset": o, "length": n}) + "\n" for o, n in zip(offsets, lengths)).encode())
                yield pd.DataFrame({"archive": archive, "offset": pd.Series(offsets, dtype="int64"), "length": pd.Series(lengths, dtype="int64")})

    return archives.mapInPandas(rewrite, "archive string, offset bigint, length bigint")


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that index rows point to.

    Gives page_id, url, record_type, refers_to, payload (null for revisits),
    payload_bytes and payload_digest. A response whose payload does not fit its
    digest raises an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, rows in batch.groupby("archive", sort=False):
                out = []
                with _open(archive, "seek") as file:
                    for offset, length in zip(rows["offset"].tolist(), rows["length"].tolist()):
                        file.seek(offset)
                        head, _, block = zlib.decompress(file.read(length), wbits=31).partition(b"\r\n\r\n")
                        field = _fields(head)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        payload = payload[: int(field["content-length"]) - len(http) - 4]
                        digest = field["warc-payload-digest"].removeprefix("sha1:")
                        number = lambda name: int(x) if (x := field.get(name, "<urn:page:>")[10:-1]) else None  # noqa: B023, E731
                        revisit = field["warc-type"] == "revisit"
                        if not revisit and base32_sha1(payload) != digest:
                            raise ValueError(f"damaged payload at {offset} of {archive}")
                        out.append((number("warc-record-id"), field.get("warc-target-uri"), field["warc-type"], number("warc-refers-to"), None if revisit else payload, int(_fields(http)["content-length"]), digest))
                frame = pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.mapInPandas(read, "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record, normalise the archives and give their index.

    `pages` needs page_id, url and html; null html is an empty payload, a null
    url leaves its header out, repeated rows are records each, and other
    columns are left out. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder, n = new_path(spark, "warc"), shuffle_partitions(spark)
    paths = materialize(write_monolithic(mark_revisits(pages, min_bytes), f"{folder}/whole"), "archives")
    return materialize(normalize(paths.repartition(n, "path"), f"{folder}/members"), "index")
