"""Operator 3, a deterministic sharded WARC writer and its reader.

Records are put in order of their id by an exact range sort (the splitters of
the sharding operator, by payload bytes), so shards do not depend on how the
input happened to be partitioned; rows of one id are cut by payload and url.
Each shard is one task, which writes its records one by one into files that roll
at a compressed size. Above ``most_shards`` shards become larger, not the list of
splitters: a task streams its shard, whatever the size. Headers are made anew
from the record: record ids and digests derive from the content, the date is a
parameter, so a second attempt writes the same bytes. A file appears under a
temporary name of its attempt and is renamed when complete, after a file that an
earlier attempt left under this name is removed; the manifest, committed by
Spark, names the files that count, with sizes and checksums.

Of records with equal payloads of ``revisit_bytes`` or more, that with the
largest id is the response and the others are revisits of it.

Payloads are exchanged once; what a revisit refers to is sent beside them by the
same order. The writer holds one Arrow batch, which Spark bounds in bytes and
rows, and turns one record at a time into Python; the reader holds one record
and up to 8 MB of those before it.

Defined cases: a null payload is empty; a null url has no target line; null ids
sort first and never count as the largest unless all are null; rows of one id
and one payload are all responses if they hold the largest id, with equal record
ids if their urls are equal too; a very long payload is one record, whole; an
empty table gives a manifest without files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_folder
from .sharding import bins, plan_shards, salted

_LOW = -(2**63)
_SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the published namespace of URLs
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
MANIFEST = "shard int, seq int, file string, records long, bytes long, sha256 string"
RECORD = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_OF_IDS, f'{page} {url} {digest}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._")


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, target: str | None = None) -> bytes:
    """One record as a gzip member."""
    block = _HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, url, _sha1(payload))), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    head += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    if page is not None:
        head.append(("X-Page-ID", str(page)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
        if refers_to is not None:
            head += [("WARC-Refers-To", record_id(refers_to, target, _sha1(payload))), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(refers_to))]
            if target is not None:
                head.append(("WARC-Refers-To-Target-URI", _uri(target)))
    head.append(("Content-Length", str(len(block))))
    data = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip without time or name
    return pack.compress(data) + pack.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of an unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


class _Roll:
    """The open file of a shard."""

    def __init__(self, store, base: str, shard: int, seq: int):
        self.store, self.shard, self.seq = store, shard, seq
        self.name = f"shard-{shard:05d}-{seq:05d}.warc.gz"
        self.final = f"{base}/{self.name}"
        self.temporary = f"{base}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.out = store.open_output_stream(self.temporary)
        self.records = self.bytes = 0
        self.sum = hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.records += 1
        self.bytes += len(data)

    def close(self) -> tuple:
        self.out.close()
        from pyarrow import fs

        if self.store.get_file_info(self.final).type != fs.FileType.NotFound:  # of an attempt that was lost; the bytes are the same
            self.store.delete_file(self.final)
        self.store.move(self.temporary, self.final)
        return (self.shard, self.seq, self.name, self.records, self.bytes, self.sum.hexdigest())


def write_warc(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, most_shards: int = 8192, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives and their manifest below ``folder``; returns the manifest.

    ``shard_bytes``: payload of a shard, so of a task. ``roll_bytes``: compressed
    size at which a file is closed.
    """
    spark = pages.sparkSession
    base = qualified(spark, folder)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_LOW))
    link = F.col(f"`{url}`").cast("string")
    # rows of one id follow each other by payload; the url's hash, in the last bits, lets them be cut
    second = salted(F.xxhash64(body), F.xxhash64(link))
    size = (F.octet_length(body) + 512).cast("long")
    meta = materialize(pages.select(F.col(f"`{id}`").cast("long").alias("id"), link.alias("url"), F.sha1(body).alias("digest"), size.alias("size"), key.alias("k1"), second.alias("k2")), "warc-meta")
    total = meta.agg(F.sum("size")).first()[0] or 0
    shards = max(1, min(-(-total // shard_bytes), most_shards))
    plan = plan_shards(meta, shards, 0.01)
    edges, ends, shard_of = plan.first, plan.second, plan.shard

    @F.pandas_udf("int")
    def shard(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(shard_of[bins(edges, ends, k1.to_numpy(), k2.to_numpy())].astype("int32"))

    large = meta.where(F.col("size") >= revisit_bytes + 512)
    # the largest id of each payload that occurs more than once; partial aggregation takes up hot payloads
    heads = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.max_by(F.struct("url"), F.struct("id", "url")).alias("target"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    heads = materialize(heads, "warc-heads")  # right above their exchange, so that Spark can split a hot payload
    again = large.join(heads, "digest").where("id IS NULL OR id <> refers_to").select("k1", "k2", "digest", "refers_to", F.col("target.url").alias("target")).distinct()
    nothing = lambda kind: F.lit(None).cast(kind)
    notes = again.select("k1", "k2", "digest", F.lit(0).alias("kind"), nothing("long").alias("id"), F.col("target").alias("url"), nothing("binary").alias("payload"), "refers_to")
    rows = pages.select(key.alias("k1"), second.alias("k2"), F.sha1(body).alias("digest"), F.lit(1).alias("kind"), F.col(f"`{id}`").cast("long").alias("id"), link.alias("url"), body.alias("payload"), nothing("long").alias("refers_to"))
    both = notes.unionByName(rows).withColumn("shard", shard("k1", "k2"))
    ordered = both.repartitionById(int(shards), F.col("shard")).sortWithinPartitions("shard", "k1", "k2", "digest", "kind", "url")

    def write(batches: Iterator) -> Iterator[pd.DataFrame]:
        store, root = _store(base)
        store.create_dir(root, recursive=True)
        file: _Roll | None = None
        done: list[tuple] = []
        note: tuple = (None, None, None, None)
        for batch in batches:
            for at in range(batch.num_rows):
                (r,) = batch.slice(at, 1).to_pylist()
                if r["kind"] == 0:
                    note = (r["k1"], r["digest"], r["refers_to"], r["url"])
                    continue
                revisit = note[:2] == (r["k1"], r["digest"])
                if file is not None and (file.shard != r["shard"] or file.bytes >= roll_bytes):
                    done.append(file.close())
                    file = _Roll(store, root, r["shard"], file.seq + 1 if file.shard == r["shard"] else 0)
                if file is None:
                    file = _Roll(store, root, r["shard"], 0)
                file.add(make_record(r["id"], r["url"], r["payload"], note[2] if revisit else None, revisit, date, note[3]))
        if file is not None:
            done.append(file.close())
        names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
        table = pd.DataFrame(done, columns=names)
        import pyarrow as pa

        kinds = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        yield pa.RecordBatch.from_pandas(table, kinds, preserve_index=False)

    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{base}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def read_members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    data = stream.read(piece)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(piece)
    if any(parts):
        raise ValueError("the archive ends within a record")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the files in the manifest, digests checked; revisits have no payload."""
    base = qualified(spark, folder)
    files = spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    n = max(1, files.count())

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        store, root = _store(base)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in read_members(stream):
                        rows.append(_row(data))
                        held += len(data)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("file").repartition(n).mapInArrow(read, RECORD)


def _row(data: bytes) -> dict:
    head, block = parse_record(data)
    if _sha1(block) != head["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {head['WARC-Record-ID']} does not match")
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    if payload is not None and _sha1(payload) != head["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {head['WARC-Record-ID']} does not match")
    number = lambda k: int(head[k]) if k in head else None
    return {
        "id": number("X-Page-ID"),
        "url": unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None,
        "record_type": head["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload_bytes": number("X-Payload-Length") if revisit else len(payload),
        "payload_digest": base64.b32decode(head["WARC-Payload-Digest"][5:]).hex(),
        "payload": payload,
    }


def archive_and_read(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives (to the shared folder unless told otherwise) and read them back."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    return read_warc(pages.sparkSession, folder)
