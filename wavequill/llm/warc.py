"""A deterministic sharded WARC writer, and the reader that checks what it wrote."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, column, delete, pa_schema

#: Compressed bytes at which a file is closed and the next one begins.
FILE_BYTES = 1 << 30
#: Bytes of a shard's records before compression: so many at least, and as many as make up no more shards than this, or one cell more.
SHARD_BYTES, MOST_SHARDS = 4 << 20, 16_384
#: Digits of a record's key: 16 of the page_id and 64 of the payload's digest.
KEY_DIGITS = 80
#: Files that the commit renames at a time.
RENAMES = 16
#: Payloads shorter than this are always written in full.
REVISIT_BYTES = 100
#: All records carry this date, so that equal input gives equal files.
DATE = "2020-01-01T00:00:00Z"
_BLOCK = 1 << 20


def _open(path: str):
    """File system and path within it, for any scheme that Arrow knows; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") and not path.startswith("file:") else path.replace("file:/", "file:///", 1))


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def _record(page_id: int | None, url: str | None, payload: bytes, hexed: str, first: int | None, same: bool) -> bytes:
    """One record as its own gzip member; every header is computed anew from the payload."""
    uri = (url or "").replace("\r", "").replace("\n", "") or f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if same else http + payload
    name = uuid.UUID(hashlib.sha256(f"{page_id}|{uri}|{hexed}".encode()).hexdigest()[:32])
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if same else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{hexed}", f"WARC-Block-Digest: {_digest(block)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if same:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {'' if first is None else first}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _info() -> bytes:
    body = b"software: wavequill\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(hashlib.sha256(body).hexdigest()[:32])}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nWARC-Block-Digest: {_digest(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def _key() -> Column:
    """page_id in sortable hexadecimal digits, null last, then the payload's digest: records are in the order of this text."""
    # Without a sign bit the digits of negative ids come after those of others; flipping it puts them first.
    page = F.lpad(F.lower(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    return F.concat(F.coalesce(page, F.lit("g" * 16)), F.sha2(F.col("html").cast("binary"), 256))


def _shards(light: DataFrame, least: int) -> tuple[list[tuple[str, int]], int]:
    """(beginning of a key, shard) for all keys, and the number of shards, from exact sums of bytes by beginnings.

    Cells are keys that begin alike. Cells above the size of a shard are cut by one digit more, again and again, so that an id
    with very many rows is cut by digests; neighbouring cells then make up shards. Nothing is sampled: equal
    rows give equal shards. There are at most ``MOST_SHARDS`` shards or so, and 16 times as many cells.
    """
    all_ = light.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("n").alias("n")).first()
    if all_["a"] is None:
        return [], 0
    size = max(least, -(-all_["n"] // MOST_SHARDS))
    length = 1 + len(os.path.commonprefix([all_["a"], all_["b"]]))
    wanted = size
    while wanted < all_["n"] and length < KEY_DIGITS:
        length, wanted = length + 1, wanted * 16
    cells: list[tuple[str, int]] = []
    rest = light
    while True:
        begin = F.substring("key", 1, length)
        found = rest.groupBy(begin.alias("cell")).agg(F.sum("n").alias("n")).collect()
        whole = length >= KEY_DIGITS
        cells += [(r["cell"], r["n"]) for r in found if r["n"] <= size or whole]
        large = [(r["cell"],) for r in found if r["n"] > size and not whole]
        if not large:
            break
        rest = light.join(F.broadcast(light.sparkSession.createDataFrame(large, "large string")), begin == F.col("large"), "left_semi")
        length += 1
    out, shard, filled = [], 0, 0
    for cell, n in sorted(cells):
        if filled and filled + n > size:
            shard, filled = shard + 1, 0
        out.append((cell, shard))
        filled += n
    return out, shard + 1


def _with_shard(df: DataFrame, cells: list[tuple[str, int]]) -> DataFrame:
    """The rows with the shard of their key: one small join for each length of cells."""
    spark, shard = df.sparkSession, F.lit(None).cast("int")
    for k, length in enumerate(sorted({len(c) for c, _ in cells})):
        sent = F.broadcast(spark.createDataFrame([(c, n) for c, n in cells if len(c) == length], f"cell{k} string, shard{k} int"))
        df = df.join(sent, F.substring("key", 1, length) == F.col(f"cell{k}"), "left").drop(f"cell{k}")
        shard = F.coalesce(shard, F.col(f"shard{k}"))
    return df.withColumn("shard", shard).drop(*(c for c in df.columns if re.fullmatch(r"shard\d+", c)))


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a record for every row of page_id, url, html; returns the manifest, a row for each file.

    Of rows with equal payloads of ``REVISIT_BYTES`` or more, the one with the smallest page_id is a
    response, the others revisit it; null page_ids count as larger than any other. Rows with the same page_id and payload
    are one response and revisits of it. Null html is an empty payload.

    Records are in the order of page_id, payload digest and url, cut into shards by exact counts (``_shards``); a shard's files
    roll over by compressed size and are named by shard and number. So equal rows give equal files, however they
    are partitioned. Every attempt of a task writes under names of its own in
    ``_temporary``; only what finished tasks report is renamed, then the manifest is written the
    same way. So files without a manifest are never read, and a lost executor leaves nothing behind
    but temporary files, which the commit deletes.
    """
    spark = pages.sparkSession
    folder = folder.rstrip("/")
    scratch = Scratch(spark, "warc-rows")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    light = scratch.keep(rows.select("page_id", _key().alias("key"), (F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)) + 500).cast("long").alias("n"), (F.octet_length("html") >= REVISIT_BYTES).alias("long")), "light")
    cells, shards = _shards(light, shard_bytes)
    if not cells:
        return _commit(spark, folder, [])
    long = light.where("long").select("page_id", "key", F.substring("key", 17, 64).alias("digest"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    firsts = long.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first"))
    # Which rows revisit, without their payloads; the sort below brings the two together in one shuffle.
    marks = long.join(firsts, "digest").select("key", "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first", F.lit(0).alias("kind")).distinct()
    full = rows.select(_key().alias("key"), "page_id", "url", "html", F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind"))
    # Which tasks write which shards is up to samples; what is in a shard is not.
    every = _with_shard(marks.unionByName(full), cells).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "key", "kind", "url")
    schema = "shard int, number int, temporary string, records long, bytes long, sha256 string"
    out = pa_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        done: list[tuple] = []
        stream = name = check = None
        shard, number, size, records = -1, 0, 0, 0
        key, first, marked, written = "", None, False, False

        def close() -> None:
            nonlocal stream, number
            if stream is not None:
                stream.close()
                done.append((shard, number, name, records, size, check.hexdigest()))
                stream, number = None, number + 1

        for batch in batches:
            for its, k, page, url, html, to, kind in zip(*(column(batch, c).to_pylist() for c in ("shard", "key", "page_id", "url", "html", "first", "kind")), strict=True):
                if its != shard:
                    close()
                    shard, number = its, 0
                if k != key:
                    key, first, marked, written = k, None, False, False
                if kind == 0:
                    first, marked = to, True
                    continue
                payload, hexed = html.encode("utf-8"), k[16:]
                parts = []
                if stream is None:
                    name = f"{folder}/_temporary/{attempt}/{shard:06d}-{number:06d}.warc.gz"
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(path, compression=None)
                    size = records = 0
                    check = hashlib.sha256()
                    parts = [_info()]
                parts.append(_record(page, url, payload, hexed, first, marked and (first != page or written)))
                written = True
                for p in parts:
                    stream.write(p)
                    check.update(p)
                    size += len(p)
                records += 1
                if size >= file_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)

    # A row for each file: no more than MOST_SHARDS and the total over FILE_BYTES.
    reported = sorted(tuple(r) for r in every.mapInArrow(run, schema).collect())
    scratch.drop("light")
    return _commit(spark, folder, reported)


def _commit(spark: SparkSession, folder: str, reported: list[tuple]) -> DataFrame:
    """Rename what the tasks report, a few files at a time, then write the manifest."""
    from concurrent.futures import ThreadPoolExecutor

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = path(folder).getFileSystem(conf)
    system.mkdirs(path(folder))

    def publish(row: tuple) -> tuple:
        shard, number, temporary, records, size, check = row
        final = f"{folder}/part-{shard:06d}-{number:06d}.warc.gz"
        if not system.rename(path(temporary), path(final)):
            system.delete(path(final), False)  # left by an earlier commit that did not end
            if not system.rename(path(temporary), path(final)):
                raise OSError(f"can't rename {temporary}")
        return final, records, size, check

    with ThreadPoolExecutor(RENAMES) as pool:
        made = list(pool.map(publish, reported))
    lines = "".join(json.dumps({"file": f.rpartition("/")[2], "records": r, "bytes": b, "sha256": c}) + "\n" for f, r, b, c in made)
    stream = system.create(path(f"{folder}/_manifest.tmp"), True)
    stream.write(lines.encode())
    stream.close()
    system.delete(path(f"{folder}/manifest.jsonl"), False)
    system.rename(path(f"{folder}/_manifest.tmp"), path(f"{folder}/manifest.jsonl"))
    delete(spark, f"{folder}/_temporary")
    return spark.createDataFrame(made, "file string, records long, bytes long, sha256 string")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each whole, with no more than one held."""
    rest = b""
    while True:
        part = rest or stream.read(_BLOCK)
        if not part:
            return
        unpack, out = zlib.decompressobj(31), io.BytesIO()
        while True:
            out.write(unpack.decompress(part))
            if unpack.eof:
                break
            part = stream.read(_BLOCK)
            if not part:
                raise OSError("a gzip member is cut off")
        rest = unpack.unused_data
        yield out.getvalue()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != _digest(block):
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
    return headers, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest lists: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Block digests are checked; payload digests of responses are computed from their payloads.
    A revisit gives the length and digest of the full payload that its headers tell.
    """
    folder = folder.rstrip("/")
    listed = spark.read.schema("file string, records long, bytes long, sha256 string").json(f"{folder}/manifest.jsonl")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    out = pa_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in column(batch, "file").to_pylist():
                system, path = _open(f"{folder}/{file}")
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for record in members(stream):
                        headers, block = parse(record)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        told = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        n = int(headers["WARC-Payload-Length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != told or len(payload) != n:
                                raise ValueError(f"payload of {headers['WARC-Record-ID']} differs")
                        page, to = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
                        rows.append((int(page) if page else None, n, told, kind, int(to) if to else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    n = max(1, min(listed.count(), 10_000))
    return listed.select("file").repartition(n).mapInArrow(run, schema)
