"""Media columns: content-defined chunks, a deduplicated chunk store, and verified reconstruction."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, column, documents, pa_schema, strings

#: Payloads are padded with blanks to a positive multiple of this.
FRAME = 192
#: Chunks: least and greatest bytes, and bits of the gear hash that are zero at a cut (1 in 2^11 bytes).
LEAST, MOST, CUT_BITS = 512, 8192, 11
#: Bits of the filter that tells which digests occur more than once; its size is fixed whatever the input.
FILTER_BITS = 1 << 24
SAMPLE_RATE = 8000


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + gear[byte] (mod 2^32) after every byte, for all bytes at once.

    The hash is a sum over the last 32 bytes, doubled five times from a sum over one.
    """
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) <= k:
            break
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))  # the right side is a copy made before
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a payload: after bytes where the top bits of the hash are zero."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    hashes = gear_hashes(np.frombuffer(data, np.uint8))
    marked = (np.flatnonzero(hashes >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, start, k = [], 0, 0
    while n - start > LEAST:
        while k < len(marked) and marked[k] < start + LEAST:
            k += 1
        end = min(marked[k] if k < len(marked) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8")
    return raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME)), len(raw)


def wave(payload: bytes) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples that are the payload's bytes."""
    pad = len(payload) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def samples(media: bytes) -> bytes:
    """The samples of such a file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def feature(payload: bytes, chunks: int) -> str:
    """Mean, deviation and zero-crossing rate of the samples about the middle, and the number of chunks."""
    x = np.frombuffer(payload, np.uint8)
    mean, spread = float(x.mean()), float(x.std())
    above = x >= 128
    crossing = int((above[1:] != above[:-1]).sum())
    return f"mean={mean:.4f};std={spread:.4f};zc={crossing};chunks={chunks}"


def _chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    out, start = [], 0
    for end in cuts(media):
        part = media[start:end]
        out.append((hashlib.sha256(part).digest(), part))
        start = end
    return out


def _positions(digest: bytes) -> tuple[int, int]:
    a, b = struct.unpack(">QQ", digest[:16])
    return a % FILTER_BITS, b % FILTER_BITS


def store(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Write the media of all texts as a chunk store; returns its two tables.

    lists: row, doc_id, n_bytes, media_bytes, media_sha256, n_chunks, for each chunk its digest,
    and the bytes of those chunks that no other media holds. shared: digest and bytes of the
    chunks that occur more than once, each once.

    A first pass gives digests alone, which a join groups; those met more than once set bits in
    a filter of fixed size (false hits only move a chunk to the shared table). A second pass
    writes the lists, a third the shared chunks: only these are shuffled.
    """
    spark = docs.sparkSession
    docs = documents(docs)

    def make_digests():
        def one(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = {"digest": []}
            for t in strings(batch):
                cols["digest"] += [d for d, _ in _chunks(wave(payload_of(t)[0]))]
            return cols

        return one

    digests = arrow_map(docs.select("text"), make_digests, "digest binary")
    twice = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    number = lambda at: F.pmod(F.conv(F.hex(F.substring("digest", at, 8)), 16, 10).cast("decimal(20,0)"), F.lit(FILTER_BITS).cast("decimal(20,0)")).cast("long")
    bits = twice.select(F.explode(F.array(number(1), number(9))).alias("bit"))
    # At most FILTER_BITS / 64 rows, whatever the number of digests.
    words = bits.groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toPandas()
    mask = np.zeros(FILTER_BITS // 64, np.uint64)
    mask[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(mask)

    def known(mask: np.ndarray, digest: bytes) -> bool:
        return all(int(mask[p >> 6]) >> (p & 63) & 1 for p in _positions(digest))

    def make_lists():
        mask = sent.value

        def one(batch: pa.RecordBatch) -> dict:
            cols: dict[str, list] = defaultdict(list)
            for doc, t in zip(column(batch, "doc_id").to_pylist(), strings(batch), strict=True):
                payload, n = payload_of(t)
                media = wave(payload)
                parts = _chunks(media)
                common = [known(mask, d) for d, _ in parts]
                cols["doc_id"].append(doc)
                cols["n_bytes"].append(n)
                cols["media_bytes"].append(len(media))
                cols["media_sha256"].append(hashlib.sha256(media).digest())
                cols["digests"].append([d for d, _ in parts])
                cols["own"].append([None if c else p for c, (_, p) in zip(common, parts, strict=True)])
                cols["complete"].append(not any(common))
            return cols

        return one

    def make_shared():
        mask = sent.value

        def one(batch: pa.RecordBatch) -> dict:
            found = {d: p for t in strings(batch) for d, p in _chunks(wave(payload_of(t)[0])) if known(mask, d)}
            return {"digest": list(found), "bytes": list(found.values())}

        return one

    lists = arrow_map(docs, make_lists, "doc_id long, n_bytes long, media_bytes long, media_sha256 binary, digests array<binary>, own array<binary>, complete boolean")
    lists = scratch.keep(lists.withColumn("row", F.monotonically_increasing_id()), "lists")
    shared = arrow_map(docs.select("text"), make_shared, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    return lists, scratch.keep(shared, "shared")


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(doc: int | None, n: int, media: bytes, told: bytes, chunks: int) -> tuple:
    check = hashlib.sha256(media).digest()
    if check != told:
        raise ValueError(f"the media of document {doc} differ from what was stored")
    payload = samples(media)
    return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), check.hex(), feature(payload, chunks)


def describe(lists: DataFrame, shared: DataFrame) -> DataFrame:
    """Read all media back from the chunk store, verify them and compute what describes them.

    Media that share no chunk are put together where their list lies. Of the others each missing
    chunk is joined by digest, and rows are sorted by media and place within partitions, so that a task holds one
    media at a time.
    """
    spark = lists.sparkSession
    out = pa_schema(spark, _OUT)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def make_whole():
        names = [f.name for f in out]

        def one(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc, n, told, own in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "n_bytes", "media_sha256", "own")), strict=True):
                rows.append(_describe(doc, n, b"".join(own), told, len(own)))
            return dict(zip(names, zip(*rows, strict=True), strict=True))

        return one

    whole = arrow_map(lists.where("complete").select("doc_id", "n_bytes", "media_sha256", "own"), make_whole, _OUT)

    part = lists.where("not complete")
    each = part.select("row", F.posexplode(F.arrays_zip("digests", "own")).alias("place", "chunk")).select("row", "place", F.col("chunk.digests").alias("digest"), F.col("chunk.own").alias("own"))
    have = each.where("own is not null").select("row", "place", F.col("own").alias("bytes"))
    lack = each.where("own is null").select("row", "place", "digest").join(shared, "digest").select("row", "place", "bytes")
    heads = part.select("row", F.lit(-1).alias("place"), "doc_id", "n_bytes", "media_sha256", F.size("digests").alias("n"), F.lit(None).cast("binary").alias("bytes"))
    none = lambda t: F.lit(None).cast(t)
    parts = have.unionByName(lack).select("row", "place", none("long").alias("doc_id"), none("long").alias("n_bytes"), none("binary").alias("media_sha256"), none("int").alias("n"), "bytes")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = heads.unionByName(parts).repartition(n, "row").sortWithinPartitions("row", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, done = None, [], []

        def close() -> None:
            if head is not None:
                if len(held) != head[3]:
                    raise ValueError(f"document {head[0]} has {len(held)} of {head[3]} chunks")
                done.append(_describe(head[0], head[1], b"".join(held), head[2], len(held)))

        for batch in batches:
            for place, doc, size, told, count, data in zip(*(column(batch, c).to_pylist() for c in ("place", "doc_id", "n_bytes", "media_sha256", "n", "bytes")), strict=True):
                if place < 0:
                    close()
                    head, held = (doc, size, told, count), []
                else:
                    held.append(data)
            if done:
                yield batch_of(done)
                done = []
        close()
        if done:
            yield batch_of(done)

    return whole.unionByName(sorted_.mapInArrow(run, _OUT))


def media_digests(docs: DataFrame) -> tuple[DataFrame, Scratch]:
    """Store every whole text as 8-bit samples in the chunk store and describe what is read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature,
    a row for each row of ``docs``, and the scratch folder that holds the store. Null texts are empty: their payload is
    192 blanks. Null doc_ids and repeated rows are stored like others and share their chunks.
    """
    scratch = Scratch(docs.sparkSession, "media")
    lists, shared = store(docs, scratch)
    return describe(lists, shared), scratch
