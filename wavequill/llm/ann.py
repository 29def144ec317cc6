"""Approximate nearest neighbours by additive quantisation with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, column, pa_schema

#: Vectors that the codebooks are fitted to at most, by a hash of their ids.
FIT_ROWS = 16_384
#: Candidates of a block; a block is searched by one task at a time.
BLOCK_ROWS = 4_096
#: Candidates of each block that are reranked.
SHORTLIST = 128


@dataclass(frozen=True)
class AdditiveCodebooks:
    """``books[m, k]`` are full-dimensional; a vector is about the sum of one entry of each book."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes of vectors by beam search: after each book the ``beam`` best partial sums go on.

        |x - s - c|^2 = |x - s|^2 - 2 (x - s).c + |c|^2; x.c and all c.c' come from products
        made once, so that a step adds table entries and never forms residuals.
        """
        m, k, _ = self.books.shape
        flat = self.books.reshape(m * k, -1)
        gram = flat @ flat.T
        out = np.empty((len(x), m), np.uint8)
        for a in range(0, len(x), 512):
            part = x[a : a + 512]
            xc = (part @ flat.T).reshape(len(part), m, k)
            n = len(part)
            codes = np.zeros((n, 1, 0), np.int64)
            cost = np.zeros((n, 1), np.float32)
            for j in range(m):
                step = np.diag(gram)[j * k : (j + 1) * k][None, None, :] - 2 * xc[:, j][:, None, :]
                for i in range(j):
                    step = step + 2 * gram[i * k + codes[:, :, i], j * k : (j + 1) * k]
                total = (cost[:, :, None] + step).reshape(n, -1)
                b = min(beam, total.shape[1])
                best = np.argpartition(total, b - 1, axis=1)[:, :b] if b < total.shape[1] else np.tile(np.arange(b), (n, 1))
                cost = np.take_along_axis(total, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
            out[a : a + n] = codes[np.arange(n), cost.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with every entry: (books, queries, entries)."""
        return np.einsum("qd,mkd->mqk", queries, self.books, optimize=True).astype(np.float32)


def fit(x: np.ndarray, n_books: int = 16, entries: int = 256, rounds: int = 8, seed: int = 1) -> AdditiveCodebooks:
    """Residual k-means book by book, then books refitted together by least squares to beam-search codes."""
    rng = np.random.default_rng(seed)
    entries = min(entries, max(1, len(x)))
    rest = x.astype(np.float32).copy()
    books = np.zeros((n_books, entries, x.shape[1]), np.float32)
    for m in range(n_books):
        centre = rest[rng.choice(len(rest), entries, replace=False)].copy()
        for _ in range(rounds):
            near = (rest @ centre.T * -2 + (centre**2).sum(axis=1)).argmin(axis=1)
            total = np.stack([np.bincount(near, rest[:, d], entries) for d in range(x.shape[1])], axis=1)
            n = np.bincount(near, minlength=entries)
            centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre).astype(np.float32)
        books[m] = centre
        rest -= centre[near]
    out = AdditiveCodebooks(books)
    codes = out.encode(x.astype(np.float32))
    # One pass of block coordinate descent: each book's entries become the means of what the others leave.
    rest = x.astype(np.float32) - out.decode(codes)
    for m in range(n_books):
        rest += books[m][codes[:, m]]
        n = np.bincount(codes[:, m], minlength=entries)
        total = np.stack([np.bincount(codes[:, m], rest[:, d], entries) for d in range(x.shape[1])], axis=1)
        books[m] = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], books[m])
        rest -= books[m][codes[:, m]]
    return AdditiveCodebooks(books)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec of rows that take part: an id, and finite components that are not all zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def index(rows: DataFrame, books: AdditiveCodebooks, scratch: Scratch, name: str = "index") -> DataFrame:
    """rows of vec_id, vec, d with codes and scale, written once: scale is the vector's norm over that of its code.

    Rows whose number of components is not that of the codebooks have null codes.
    """
    sent = rows.sparkSession.sparkContext.broadcast(books)
    schema = "vec_id long, vec array<double>, d int, codes binary, scale float"
    out = pa_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            d = column(batch, "d").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(d == books.books.shape[2])
            codes: list = [None] * len(d)
            scale = np.ones(len(d), np.float32)
            if len(at):
                x = column(batch, "vec").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                found = books.encode(x.astype(np.float32))
                about = np.sqrt((books.decode(found).astype(np.float64) ** 2).sum(axis=1))
                scale[at] = np.sqrt((x**2).sum(axis=1)) / np.maximum(about, 1e-12)
                for i, c in zip(at.tolist(), found, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "vec"), column(batch, "d"), pa.array(codes, pa.binary()), pa.array(scale)], schema=out)

    return scratch.keep(rows.mapInArrow(run, schema), name)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", n_books: int = 16, shortlist: int = SHORTLIST) -> DataFrame:
    """The k nearest rows by inner product of each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score. All rows are encoded once, and codes and norms are stored (``index``).
    A query scores every code of a block of candidates from lookup tables, scaled by true over quantised norm, and the
    block's ``shortlist`` best are reranked by exact inner products in double precision, ties to the smaller id. The
    query set meets all rows in blocks, which are of equal size and dealt to tasks in order; blocks give k rows a query at most.

    Rows whose vector is null, empty, zero or holds null or non-finite components take no part. Rows meet those with as many
    components; the codebooks are for the commonest number of them, and the few rows of other numbers are scored exactly.
    Rows with the same id and vector count once; with the same id and other vectors they are queries and candidates of
    their own, but never candidates of their id's query. Of equal vectors in a block only the k + 1 smallest ids are scored:
    no other can be among a query's nearest. Fewer candidates than k give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.keep(usable(vectors, id_col, vector_col).distinct().withColumn("d", F.size("vec")), "rows")
    sizes = sorted((r["d"], r["n"]) for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect())
    schema = "query_id long, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = max(sizes, key=lambda x: (x[1], -x[0]))[0]
    sample = np.array([r["vec"] for r in rows.where(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()], np.float32)
    books = fit(sample, n_books)
    stored = index(rows, books, scratch)
    scratch.drop("rows")
    sent = spark.sparkContext.broadcast(books)

    # Numbers of blocks by number of components, and the first block of each.
    counts = [-(-n // BLOCK_ROWS) for _, n in sizes]
    dealt = F.broadcast(spark.createDataFrame([(x, sum(counts[:i]), c) for i, ((x, _), c) in enumerate(zip(sizes, counts, strict=True))], "d int, base long, blocks long"))
    met = stored.join(dealt, "d")
    candidates = met.select((F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).alias("block"), F.lit(0).alias("kind"), "vec_id", "vec", "codes", "scale")
    each = F.explode(F.sequence(F.col("base"), F.col("base") + F.col("blocks") - 1)).alias("block")
    queries = met.where(F.col("vec_id") % every == 0).select(each, F.lit(1).alias("kind"), "vec_id", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("scale"))
    units = candidates.unionByName(queries).repartitionByRange(sum(counts), "block").sortWithinPartitions("block", "kind", "vec_id")
    out = pa_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:
            at = column(batch, "block").to_numpy(zero_copy_only=False)
            kind = column(batch, "kind").to_numpy(zero_copy_only=False)
            ids = column(batch, "vec_id").to_numpy(zero_copy_only=False)
            vec, codes, scale = (column(batch, c) for c in ("vec", "codes", "scale"))
            edge = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edge], [*edge, len(at)], strict=True):
                if at[a] != block:
                    block, held, index = at[a], [], None
                x = vec.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if kind[a] == 0:
                    held.append((ids[a:b], x, codes.slice(a, b - a).to_pylist(), scale.slice(a, b - a).to_numpy(zero_copy_only=False)))
                    continue
                if index is None:
                    if not held:
                        continue
                    index = _Block(sent.value, *(np.concatenate([h[i] for h in held]) for i in (0, 1)), [c for h in held for c in h[2]], np.concatenate([h[3] for h in held]), k)
                for i in range(0, b - a, 256):
                    q, v, s = index.nearest(ids[a + i : min(b, a + i + 256)], x[i : i + 256], k, shortlist)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], schema=out)

    found = units.mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class _Block:
    """Stored codes and scales and the vectors of one block of candidates."""

    def __init__(self, books: AdditiveCodebooks, ids: np.ndarray, vec: np.ndarray, codes: list[bytes | None], scale: np.ndarray, k: int):
        _, same = np.unique(vec, axis=0, return_inverse=True)
        order = np.lexsort((ids, same.ravel()))
        group = same.ravel()[order]
        place = np.arange(len(order)) - np.searchsorted(group, group)
        keep = np.sort(order[place <= k])
        keep = keep[np.argsort(ids[keep], kind="stable")]
        self.ids, self.vec, self.books, self.scale = ids[keep], vec[keep], books, scale[keep]
        own = [codes[i] for i in keep.tolist()]
        self.codes = None if None in own else np.ascontiguousarray(np.frombuffer(b"".join(own), np.uint8).reshape(len(own), -1).T)

    def about(self, queries: np.ndarray) -> np.ndarray:
        """Scores from lookup tables, or exact ones where there are no codes."""
        if self.codes is None:
            return queries @ self.vec.T
        tables = self.books.tables(queries.astype(np.float32))
        out = np.zeros((len(queries), len(self.ids)), np.float32)
        for m in range(len(tables)):
            out += np.take(tables[m], self.codes[m], axis=1)
        out *= self.scale
        return out

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        about = self.about(queries)
        about[ids[:, None] == self.ids[None, :]] = -np.inf
        n = min(shortlist, len(self.ids))
        # Equal scores at the shortlist's end go to smaller ids: columns are in order of id.
        cut = -np.partition(-about, n - 1, axis=1)[:, n - 1]
        out = []
        for i, query in enumerate(queries):
            row = about[i]
            near = np.flatnonzero(row > cut[i])
            if len(near) < n and cut[i] > -np.inf:
                near = np.concatenate([near, np.flatnonzero(row == cut[i])[: n - len(near)]])
            exact = (self.vec[near] * query).sum(axis=1)
            best = np.lexsort((self.ids[near], -exact))[:k]
            out.append((np.full(len(best), ids[i]), self.ids[near][best], exact[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
