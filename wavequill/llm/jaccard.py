"""N-gram Jaccard join with Bayesian pruning of candidate pairs."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, column, documents, pa_schema, strings

WORDS, THRESHOLD = 5, 0.8
#: MinHash values of a text; bands of ROWS values each find the candidates.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: A pair is dropped when the probability that it reaches the threshold is below this.
TOLERANCE = 1e-6
#: Texts and shingles in a block of a band's candidates; two blocks are compared at once, so many pairs at a time.
BLOCK_TEXTS, BLOCK_SHINGLES, TILE = 2_048, 1 << 20, 512
#: Up to so many candidate texts their (id, digest) pairs are sent to all tasks (some 20 MB); more are joined by a shuffle.
SENT_ROWS = 200_000

_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _scramble(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
        return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, HASHES + 1, dtype=np.uint64)
    return _scramble(i * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), _scramble(i + np.uint64(1 << 40))


class Shingler:
    """Sorted distinct 64-bit hashes of the word five-grams of whole texts.

    Words are runs of letters, digits and underscores, in lower case. A text of one to four words
    has them all as its one shingle, a text without words has none.
    """

    LIMIT = 200_000

    def __init__(self, n: int = WORDS):
        import xxhash

        self.n, self.hash, self.known = n, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.LIMIT:
                known.clear()
                new = set(words)
            h = self.hash
            known.update((w, h(w)) for w in new)
        w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(w))
        with np.errstate(over="ignore"):
            out = np.full(len(w) - n + 1, np.uint64(len(w) if n < self.n else 0))
            for k in range(n):
                out = out * np.uint64(0x9FB21C651E98DF25) + w[k : len(w) - n + 1 + k]
        return np.unique(_scramble(out))


def minhash(shingles: np.ndarray) -> np.ndarray:
    a, b = _permutations()
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 1024):
            part = (shingles[k : k + 1024, None] * a + b) >> np.uint64(32)
            out = np.minimum(out, part.min(axis=0).astype(np.uint32))
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band, different bands with different keys."""
    with np.errstate(over="ignore"):
        out = np.broadcast_to(_scramble(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signatures), BANDS)).copy()
        cut = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
        for k in range(ROWS):
            out = _scramble(out * np.uint64(0x9FB21C651E98DF25) + cut[:, :, k])
    return out


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(n, m) after each band: a pair with fewer than m equal values of its first n is dropped.

    With a uniform prior the similarity given m of n equal values is Beta(m + 1, n - m + 1), whose
    upper tail at the threshold is a binomial sum.
    """
    out = []
    for n in range(ROWS, HASHES + 1, ROWS):
        tail = lambda m, n=n: sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        out.append((n, next(m for m in range(n + 1) if tail(m) >= tolerance)))
    return tuple(out)


def prune(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Indices of the pairs (i, j) that survive the incremental comparison of their MinHash values."""
    alive = np.arange(len(i))
    equal = np.zeros(len(i), np.int32)
    done = 0
    for n, least in least_matches(threshold, tolerance):
        equal[alive] += (left[i[alive], done:n] == right[j[alive], done:n]).sum(axis=1)
        alive = alive[equal[alive] >= least]
        done = n
        if not len(alive):
            break
    return alive


def overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact numbers of common shingles of the pairs: merges for few pairs, incidence products for many."""
    if len(i) <= 4 * (len(left) + len(right)):
        out = np.empty(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = left[a], right[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[k] = int((y[at] == x).sum())
        return out
    use_l, use_r = np.unique(i), np.unique(j)
    flat = np.concatenate([*(left[a] for a in use_l), *(right[b] for b in use_r)])
    row_of = np.repeat(np.arange(len(use_l) + len(use_r)), [len(left[a]) for a in use_l] + [len(right[b]) for b in use_r])
    shared, number, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[number] > 1
    number, row_of = (np.cumsum(n > 1) - 1)[number[keep]], row_of[keep]
    order = np.argsort(number, kind="stable")
    number, row_of = number[order], row_of[order]
    total = np.zeros((len(use_l), len(use_r)), np.float64)
    width = 2048
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, (a, a + width))
        dense = np.zeros((len(use_l) + len(use_r), width), np.float32)
        dense[row_of[lo:hi], number[lo:hi] - a] = 1
        total += dense[: len(use_l)] @ dense[len(use_l) :].T
    return total[np.searchsorted(use_l, i), np.searchsorted(use_r, j)].round().astype(np.int64)


def candidates(left: np.ndarray, right: np.ndarray | None, band: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks of signatures (or within one) that equal each other in ``band`` and no band before it, and survive pruning."""
    other = left if right is None else right
    a, b = band_keys(left), band_keys(other)
    found = []
    for x in range(0, len(a), TILE):
        for y in range(x if right is None else 0, len(b), TILE):
            p, q = a[x : x + TILE], b[y : y + TILE]
            mask = p[:, band][:, None] == q[:, band][None, :]
            if right is None and x == y:
                mask = np.triu(mask, 1)
            for k in range(band):  # such a pair is another band's
                mask &= p[:, k][:, None] != q[:, k][None, :]
            i, j = np.nonzero(mask)
            alive = prune(left, other, i + x, j + y, threshold, tolerance)
            found.append((i[alive] + x, j[alive] + y))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links_of(left: dict, right: dict | None, band: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two blocks (or within one): surviving candidates, then exact."""
    other = left if right is None else right
    i, j = candidates(left["sig"], None if right is None else right["sig"], band, threshold, tolerance)
    if not len(i):
        return i, j
    both = overlaps(left["shingles"], other["shingles"], i, j)
    union = np.array([len(x) for x in left["shingles"]])[i] + np.array([len(x) for x in other["shingles"]])[j] - both
    linked = both >= threshold * union - 1e-9
    return i[linked], j[linked]


def _forest(nodes: list[int], i: np.ndarray, j: np.ndarray, right: list[int]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links, as node pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(nodes[a]), root(right[b])
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield nodes[a], right[b]


def _each_unit(batches: Iterator[pa.RecordBatch], out: pa.Schema, columns: tuple[str, ...], emit: Callable[[tuple, list[list[tuple]]], dict | None]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit and side, given to ``emit`` a unit at a time, so that no more is held: the unit, and the rows of each side.

    A block may be empty: a unit of two blocks of which one is has no pairs, and the other's own are found within it.
    """

    def batch_of(held: list[tuple]) -> pa.RecordBatch | None:
        _, _, low, high = unit = held[0][0]
        sides = [[r[2:] for r in held if r[1] == side] for side in (0, 1)]
        cols = emit(unit, sides) if len(held) > 1 and sides[0] and (low == high or sides[1]) else None
        return cols and pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    unit, held = None, []
    for batch in batches:
        units = zip(*(column(batch, c).to_pylist() for c in _UNIT), strict=True)
        for at, side, *row in zip(units, *(column(batch, c).to_pylist() for c in ("side", *columns)), strict=True):
            if at != unit and held:
                if found := batch_of(held):
                    yield found
                held = []
            unit = at
            held.append((at, side, *row))
    if held and (found := batch_of(held)):
        yield found


_UNIT = ("band", "key", "low", "high")


def _signature_array(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), HASHES)


def _survivors(units: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """The units' nodes that have a surviving partner in the unit: the others need no texts."""
    schema = "band int, key long, low long, high long, side int, node long"
    out = pa_schema(units.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _each_unit(batches, out, ("node", "sig"), emit)

    def emit(unit: tuple, sides: list[list[tuple]]) -> dict | None:
        left, right = sides
        i, j = candidates(_signature_array([r[1] for r in left]), _signature_array([r[1] for r in right]) if right else None, unit[0], threshold, tolerance)
        if not len(i):
            return None
        ends = [np.unique(i), np.unique(j)] if right else [np.unique(np.concatenate([i, j])), []]
        rows = [(side, sides[side][k][0], *unit) for side in (0, 1) for k in ends[side]]
        return dict(zip(("side", "node", *_UNIT), zip(*rows, strict=True), strict=True))

    return units.mapInArrow(run, schema)


def _links(units: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """node, links: a node's linked rows in a unit; node, partner: a spanning forest of a unit's links."""
    schema = "node long, partner long, links long"
    out = pa_schema(units.sparkSession, schema)

    def emit(unit: tuple, sides: list[list[tuple]]) -> dict | None:
        left, right = ({"node": [r[0] for r in own], "copies": np.array([r[1] for r in own], np.int64), "sig": _signature_array([r[2] for r in own]), "shingles": [np.frombuffer(r[3], np.uint64) for r in own]} if own else None for own in sides)
        i, j = links_of(left, right, unit[0], threshold, tolerance)
        if not len(i):
            return None
        other = left if right is None else right
        links: dict[int, int] = {}
        for nodes, at, weights in ((left["node"], i, other["copies"][j]), (other["node"], j, left["copies"][i])):
            for k, n in enumerate(np.bincount(at, weights, len(nodes)).astype(np.int64).tolist()):
                if n:
                    links[nodes[k]] = links.get(nodes[k], 0) + n
        edges = list(_forest(left["node"], i, j, other["node"]))
        # Link counts are rows without a partner, edges are rows without a count.
        return {"node": [*links, *(a for a, _ in edges)], "partner": [*[None] * len(links), *(b for _, b in edges)], "links": [*links.values(), *[0] * len(edges)]}

    return units.mapInArrow(lambda batches: _each_unit(batches, out, ("node", "copies", "sig", "shingles"), emit), schema)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component: the smallest node that a chain of edges (a, b) reaches.

    All nodes of a label move to the smallest label that any of them meets among its neighbours, then jump to that
    label's own label, until none changes. Moving whole regions at once keeps the number of rounds near the logarithm of the
    longest chain; there is no cap on it: labels only fall, so that rounds end, and where none falls all neighbours agree.
    Each round is written. Nodes with very many edges are joined on the side that adaptive execution splits, and their
    labels are combined before the shuffle.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), f"{name}-0")
    for k in itertools.count(1):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = scratch.keep(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("met")), f"{name}-met-{k}")
        hooks = met.groupBy("old").agg(F.min("met").alias("met"))
        jump = labels.select(F.col("node").alias("met"), F.col("component").alias("far"))
        moved = hooks.join(jump, "met").select("old", F.least("met", "far").alias("component"))
        new = scratch.keep(met.select("node", "old").join(moved, "old"), f"{name}-{k}")
        changed = not new.where("old <> component").isEmpty()
        labels = new.select("node", "component")
        scratch.drop(f"{name}-met-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        if not changed:
            break
    return labels


def _signatures(docs: DataFrame) -> DataFrame:
    import xxhash

    def make():
        shingle = Shingler()

        def one(batch: pa.RecordBatch) -> dict:
            known: dict[str, tuple] = {}
            got = []
            for t in strings(batch):
                if t not in known:
                    s = shingle(t)
                    known[t] = (xxhash.xxh3_128_digest(s.tobytes()), len(s), minhash(s)) if len(s) else (None, 0, None)
                got.append(known[t])
            keys = iter(band_keys(np.array([g[2] for g in got if g[1]])).view(np.int64).tolist()) if any(g[1] for g in got) else iter(())
            return {
                "doc_id": column(batch, "doc_id"), "mark": column(batch, "mark"), "print": [g[0] for g in got], "n": [g[1] for g in got],
                "sig": [g[2].tobytes() if g[1] else None for g in got], "keys": [next(keys) if g[1] else None for g in got],
            }

        return one

    return arrow_map(docs, make, "doc_id long, mark binary, print binary, n long, sig binary, keys array<long>")


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, Scratch]:
    """Join all documents whose word five-gram sets have a Jaccard similarity of ``threshold`` or more.

    Returns doc_id, class_id and n_links, a row for every input row, and the scratch folder. class_id is the smallest doc_id
    that a chain of links reaches; n_links counts the other rows that the row is similar to itself.

    1. Rows with the same shingle set are one node with a number of copies: exact copies never meet as pairs.
    2. The nodes of a MinHash band's value are a group of candidates; of groups with the same nodes the first band's stays. Groups
       are cut into blocks bounded in texts and shingles; a unit of work is two blocks of a group. A pair belongs to the first
       band that it shares, so that no pair is compared in two groups, and chains of groups are never followed.
    3. In a unit, pairs are compared by MinHash values a band at a time and dropped as soon as the posterior probability
       of reaching the threshold is below ``tolerance``. Shingles join only nodes of which a pair is left, and those pairs
       are compared exactly. Units give counts by node and a spanning forest, never pairs.
    4. Classes are the components of the forests.

    Null and empty texts and texts without words have no shingles, are similar to none and are a class of their
    own each; so are rows with null doc_id, with class_id null, unless they have similar rows. Repeated rows count as copies.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = _marked(docs)
    rows = scratch.keep(_signatures(docs), "rows")
    # All rows of one print have the same values, whichever is taken.
    some = rows.where("print is not null").groupBy("print").agg(F.count("*").alias("copies"), F.min(_first()).alias("first"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("keys").alias("keys"))
    nodes = scratch.keep(some.withColumn("node", F.monotonically_increasing_id()), "nodes")

    members = _members(nodes, scratch)
    left = scratch.keep(_survivors(_by_unit(members.join(nodes.select("node", "sig"), "node")), threshold, tolerance), "survivors")
    found = scratch.keep(_links(_by_unit(_with_shingles(docs, nodes, left)), threshold, tolerance), "found")
    classes = components(found.where("partner is not null").select(F.col("node").alias("a"), F.col("partner").alias("b")), scratch, "classes")
    links = found.where("partner is null").groupBy("node").agg(F.sum("links").alias("links"))

    own = nodes.select("print", "node", "copies", "first").join(classes, "node", "left").join(links, "node", "left")
    own = own.withColumn("component", F.coalesce("component", "node"))
    smallest = own.groupBy("component").agg(F.min("first").alias("head"))
    by_print = own.join(smallest, "component").select("print", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    result = rows.select("doc_id", "mark", "print").join(by_print, "print", "left")
    alone = F.col("print").isNull()
    return result.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "mark", F.when(alone, F.col("mark")).otherwise(F.col("head.mark")).alias("class_mark"),
    ), scratch


def _first() -> Column:
    """Orders rows by doc_id, nulls last, and then by their texts' digest."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))


def _marked(docs: DataFrame) -> DataFrame:
    return documents(docs, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("mark"))


def _members(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """band, key, low, high, side, node: which nodes are in which units."""
    each = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    # Two sums of hashes tell whether groups have the same nodes.
    groups = each.groupBy("band", "key").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2))).where("c > 1")
    first = groups.groupBy("c", "x1", "x2").agg(F.min(F.struct("band", "key", "n")).alias("g"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_TEXTS), F.ceil(F.col("g.n") / BLOCK_SHINGLES)).cast("long")
    cut = first.select("g.band", "g.key", blocks.alias("blocks"))
    held = each.join(cut, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(0)), F.col("blocks")))
    met = held.withColumn("with_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "with_"), F.greatest("block", "with_")
    return scratch.keep(met.select("band", "key", low.alias("low"), high.alias("high"), F.when(F.col("block") == low, 0).otherwise(1).alias("side"), "node"), "members")


def _by_unit(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *_UNIT).sortWithinPartitions(*_UNIT, "side", "node")


def _with_shingles(docs: DataFrame, nodes: DataFrame, left: DataFrame) -> DataFrame:
    """The units' rows with copies, signatures and shingles, from the texts that stand for these nodes."""

    def make():
        shingle = Shingler()
        return lambda batch: {"mark": column(batch, "mark"), "shingles": [shingle(t).tobytes() for t in strings(batch)]}

    needed = nodes.join(left.select("node").distinct(), "node", "left_semi").select("node", "copies", "sig", F.col("first.doc_id").alias("w_doc"), F.col("first.mark").alias("w_mark"))
    wanted = needed.select("w_doc", "w_mark")
    if wanted.count() <= SENT_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("mark") == F.col("w_mark")), "left_semi")
    shingled = arrow_map(texts, make, "mark binary, shingles binary").dropDuplicates(["mark"])
    return left.join(needed.select("node", "copies", "sig", F.col("w_mark").alias("mark")).join(shingled, "mark").drop("mark"), "node")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of similar rows: that with the smallest doc_id, with its columns as they were.

    Rows without words stay. Among rows that share the smallest doc_id the text with the smallest digest
    stays, and of wholly repeated rows any one.
    """
    classes, _ = similar_classes(docs, threshold)
    linked = classes.where("n_links > 0")
    head = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    key = F.struct("doc_id", "mark")
    gone = linked.where(~head).select(key.alias("gone")).distinct()
    repeated = linked.where(head).groupBy(key.alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    # Everything of the input is in one column, so that no name can clash.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("mark")).alias("key"))
    kept = rows.join(gone, F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    once = kept.join(repeated, F.col("key").eqNullSafe(F.col("again")), "left_semi").dropDuplicates(["key"])
    return kept.join(repeated, F.col("key").eqNullSafe(F.col("again")), "left_anti").unionByName(once).select("row.*")
