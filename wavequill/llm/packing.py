"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import functools
import heapq
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch, arrow_map, column, documents, pa_schema, strings

#: Words of each of the two generations that a Python worker remembers (some 70 MB each).
CACHE_WORDS = 400_000

_FOUR = struct.Struct("<I").pack
_TWO_SPACES = re.compile(r"\s\s")
#: A blank-led word of Latin letters, then ASCII marks (no apostrophe): two pre-tokens, each remembered alone.
_STEM = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)", re.ASCII)
#: Letters alone are one pre-token, which the model can be given itself.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+", re.ASCII)


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class _Words(dict):
    """Ids by word; an unknown word is learnt when it is asked for. The generation before the present one is still known."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn, self.old = learn, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            parts = None if word[-1:].isalpha() else _STEM.fullmatch(word)
            if parts:
                known = parts[1] in self
                ids = self[parts[1]] + self[parts[2]]
                if not known:  # a stem's first sight; most such words come once only
                    return ids
            else:
                ids = self.learn(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Token ids of texts by a byte-level BPE file of ``tokenizers``, remembered by word.

    The file's pre-tokenizer cuts a text before every blank and around every line end that has no
    other white space beside it, and merges never cross such a cut. So the ids of a text without
    two neighbouring white-space characters are the ids of its blank-led words and line ends, each
    of which the library encodes once. All other texts, and those with a special string, go
    to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.can_split = self._raw("a\nb c") == self._raw("a") + self._raw("\n") + self._raw("b") + self._raw(" c")
        self.direct = all(self._letters(w) == self._raw(w) for w in (" the", "Über", " événement", "a", " Xqz"))
        self.words = _Words(self._learn)
        self.words[""] = b""

    def _raw(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, word: str) -> bytes:
        mapped = word.replace(" ", self.alphabet[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([_FOUR(t.id) for t in self.model.tokenize(mapped)])

    def _learn(self, word: str) -> bytes:
        if self.direct and ((word.isascii() and (word.isalpha() or word[1:].isalpha() and word[0] == " ")) or _LETTERS.fullmatch(word)):
            return self._letters(word)
        return self._raw(word)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not self.can_split or _TWO_SPACES.search(text) or any(s in text for s in self.special):
            return self._raw(text)
        # A line end stands for itself; every other unit has none.
        units = self._units(text) if "\0" in text else text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return b"".join(map(self.words.__getitem__, units))

    @staticmethod
    def _units(text: str) -> list[str]:
        return [u for u in re.split(r"(\n)|(?= )", text) if u]


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise whole documents and cut them: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``, so that even an empty one has one token. Documents
    of at most ``max_len`` ids are one piece; longer ones have a first piece of what is left
    over by full pieces (if anything is), then pieces of exactly ``max_len``.
    """

    def make():
        encoder = _encoder(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")

        def one(batch: pa.RecordBatch) -> dict:
            texts, ids = strings(batch), column(batch, "doc_id").to_pylist()
            cols: dict[str, list] = defaultdict(list)
            for doc, coded in zip(ids, map(encoder.encode, texts), strict=True):
                coded += end
                n = len(coded) // 4
                first = n % max_len or max_len
                at = k = 0
                while at < n:
                    size = first if k == 0 else max_len
                    for name, v in (("doc_id", doc), ("piece", k), ("start", at), ("length", size), ("ids_crc32", zlib.crc32(coded[4 * at : 4 * (at + size)]))):
                        cols[name].append(v)
                    at, k = at + size, k + 1
            return cols

        return one

    return arrow_map(documents(docs), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: Rows of a range that one task sweeps, about; what a sweep leaves over is bounded by it.
RANGE_ROWS = 50_000
#: Lengths of a superstep lie within this factor of each other.
STEP = 4

_PIECE = ("row", "doc_id", "piece", "start", "length", "ids_crc32")
_SWEPT = "state string, row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, size long, part int, place long, slots long"


class _Ranges:
    """One task's sweep over its range, from large sizes to small ones: a gap waits until a document takes it.

    Gaps that were met and are not used up lie on a stack, the smallest on top; all of them hold the document at hand, so the
    top is its best fit. What is left of a gap goes back to the top while it holds the document at hand, else it waits until the
    sweep comes to its size. A document that meets an empty stack is left over, or opens a sequence.
    """

    def __init__(self, max_len: int, opens: bool):
        self.max_len, self.opens = max_len, opens
        self.stack: list[tuple[int, int]] = []
        self.waiting: list[tuple[int, int]] = []
        self.last = 0

    def take(self, kinds: list[int], sizes: list[int], rows: list[int]) -> tuple[list[int | None], list[int | None]]:
        """Sequence and offset of each document among these rows, None where it is left over."""
        stack, waiting, found, offsets = self.stack, self.waiting, [], []
        for kind, size, row in zip(kinds, sizes, rows, strict=True):
            while waiting and -waiting[0][0] >= size:
                s, q = heapq.heappop(waiting)
                stack.append((-s, q))
            if not kind:
                stack.append((size, row))
                continue
            if not stack:
                if not self.opens:
                    found.append(None)
                    offsets.append(None)
                    continue
                stack.append((self.max_len, row))
            room, sequence = stack.pop()
            found.append(sequence)
            offsets.append(self.max_len - room)
            if room - size >= size:
                stack.append((room - size, sequence))
            elif room > size:
                heapq.heappush(waiting, (size - room, sequence))
        if sizes:
            self.last = sizes[-1]
        return found, offsets


def _sweep(items: DataFrame, max_len: int, longest: int, opens: bool) -> DataFrame:
    """Range-sort documents and gaps by size and sweep every range: a row for each, with ``state`` saying what became of it.

    placed: a document with its sequence_id and offset; left: a document without, numbered by ``place`` within its range;
    open: a gap that all later ranges' documents fit into, ``slots`` of them whichever they are, with the slots before it in
    ``place``; gap: any other gap.
    """
    out = pa_schema(items.sparkSession, _SWEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranges = _Ranges(max_len, opens)
        left = 0

        def batch_of(n: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if isinstance(cols.get(f.name), pa.Array) else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in out], schema=out)

        for batch in batches:
            kinds = column(batch, "kind").to_pylist()
            found, offsets = ranges.take(kinds, column(batch, "size").to_pylist(), column(batch, "row").to_pylist())
            docs = batch.filter(pa.array([bool(k) for k in kinds]))
            if not docs.num_rows:
                continue
            place = []
            for s in found:
                place.append(left if s is None else None)
                left += s is None
            state = ["left" if s is None else "placed" for s in found]
            yield batch_of(docs.num_rows, state=state, **{c: column(docs, c) for c in _PIECE}, sequence_id=found, offset=offsets, size=column(docs, "size"), part=[part] * docs.num_rows, place=place)
        before = 0
        rows: list[tuple] = []
        for size, sequence in ranges.stack:
            fit = max(1, size // longest)
            whole = size >= ranges.last
            rows.append(("open" if whole else "gap", sequence, size, before, fit))
            before += fit if whole else 0
        rows += [("gap", q, -s, None, None) for s, q in ranges.waiting]
        if rows:
            state, sequence, size, place, slots = zip(*rows, strict=True)
            yield batch_of(len(rows), state=list(state), sequence_id=list(sequence), size=list(size), part=[part] * len(rows), place=list(place), slots=list(slots))

    return items.mapInArrow(run, _SWEPT)


def match_ranges(held: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(id, part of gaps, lowest slot, part of documents, first document, number) of what ranges leave over for each other.

    held: part, documents left and slots left of each range, in order of size. A range's documents take the slots of the
    nearest ranges before it from the top; every entry ends a run of slots or of documents, so there are fewer than two a range.
    """
    stack: list[list[int]] = []
    out = []
    for part, docs, slots in sorted(held):
        first = 0
        while first < docs and stack:
            n = min(docs - first, stack[-1][1])
            stack[-1][1] -= n
            out.append((len(out), stack[-1][0], stack[-1][1], part, first, n))
            first += n
            if not stack[-1][1]:
                stack.pop()
        if slots:
            stack.append([part, slots])
    return out


def _across(swept: DataFrame, runs: list[tuple]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents, documents still left and gaps, after the ranges' remainders met by rank.

    The n-th left document of a run takes its n-th slot from the top. A gap with several slots gets as many documents, one after the other.
    """
    spark = swept.sparkSession
    sent = F.broadcast(spark.createDataFrame(runs, "run long, gap_part int, low long, doc_part int, first long, n long"))
    docs = swept.where("state = 'left'").join(sent, (F.col("part") == F.col("doc_part")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n")), "left")
    gaps = swept.where("state = 'open'").select("sequence_id", "size", "part", F.col("place").alias("at"), "slots")
    gaps = gaps.join(sent, (F.col("part") == F.col("gap_part")) & (F.col("at") < F.col("low") + F.col("n")) & (F.col("at") + F.col("slots") > F.col("low")), "left")
    each = gaps.where("run is not null").withColumn("slot", F.explode(F.sequence(F.greatest("at", "low"), F.least(F.col("at") + F.col("slots"), F.col("low") + F.col("n")) - 1)))
    slots = each.select("run", (F.col("low") + F.col("n") - 1 - F.col("slot")).alias("rank"), "sequence_id", "size")
    met = docs.where("run is not null").select(*_PIECE, "run", (F.col("place") - F.col("first")).alias("rank")).join(slots, ["run", "rank"])
    upto = Window.partitionBy("sequence_id").orderBy("run", "rank")
    filled = met.withColumn("upto", F.sum("length").over(upto)).withColumn("final", F.lead("run").over(upto).isNull())
    return filled, docs.where("run is null").select(*_PIECE), gaps.where("run is null").select("sequence_id", "size")


def best_fit(pieces: DataFrame, max_len: int, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Give each piece (row, doc_id, piece, start, length, ids_crc32; row unique) a sequence_id and an offset.

    Pieces of more than half of ``max_len`` open a sequence each. Then supersteps go down the lengths, each with those within
    a factor of ``STEP``. In a superstep, documents and gaps are range-sorted together and swept (``_sweep``); what ranges
    leave over for each other is matched by rank (``match_ranges``, ``_across``); gaps are updated; and this repeats until no
    document is left, or none was placed, or no gap holds any. Documents left then open sequences, which is one more
    sweep. A sweep over one range is best-fit decreasing; a border between ranges costs a few documents their best fit.

    sequence_id is the row that opened the sequence. The driver gets three numbers for each range, not rows.
    """
    item = lambda kind, df, row, size, gap: df.select(F.lit(kind).alias("kind"), F.col(size).cast("long").alias("size"), F.col(row).alias("row"), *((F.lit(None).cast("long").alias(c) if gap else F.col(c)) for c in _PIECE[1:]))
    half = max_len // 2
    alone = pieces.where(F.col("length") > half)
    placed = [alone.select(*_PIECE[1:], F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps: list[DataFrame] = [alone.where(F.col("length") < max_len).select(F.col("row").alias("sequence_id"), (F.lit(max_len) - F.col("length")).alias("size"))]
    bounds = []
    hi = half
    while hi >= 1:
        lo = hi // STEP if hi > STEP * STEP else 0
        bounds.append((lo, hi))
        hi = lo
    counts = {r["lo"]: r["n"] for r in pieces.where(F.col("length") <= half).groupBy(sum((F.when((F.col("length") > lo) & (F.col("length") <= hi), lo).otherwise(0) for lo, hi in bounds), F.lit(0)).alias("lo")).agg(F.count("*").alias("n")).collect()}
    rounds = 0

    def union(parts: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, parts)

    def sweep(docs: DataFrame, live: DataFrame | None, n: int, longest: int) -> DataFrame:
        nonlocal rounds
        rounds += 1
        items = item(1, docs, "row", "length", False)
        if live is not None:
            items = items.unionByName(item(0, live, "sequence_id", "size", True))
        order = (F.desc("size"), F.asc("kind"), F.asc("row"))
        ranged = items.repartitionByRange(max(1, -(-n // range_rows)), *order).sortWithinPartitions(*order)
        return scratch.keep(_sweep(ranged, max_len, longest, live is None), f"sweep-{rounds}")

    for lo, hi in bounds:
        n = counts.get(lo, 0)
        if not n:
            continue
        docs = pieces.where((F.col("length") > lo) & (F.col("length") <= hi))
        # Gaps that hold nothing of this superstep wait for the next one.
        live, small = union(gaps).where(F.col("size") > lo), union(gaps).where(F.col("size") <= lo)
        gaps = [small]
        while n and (width := live.count()):
            swept = sweep(docs, live, n + width, hi)
            left = F.col("state") == "left"
            held = swept.groupBy("part").agg(
                F.count(F.when(left, 1)).alias("docs"), F.coalesce(F.sum(F.when(F.col("state") == "open", F.col("slots"))), F.lit(0)).alias("slots"),
                F.min(F.when(left, F.col("length"))).alias("least"), F.max(F.when(F.col("state").isin("open", "gap"), F.col("size"))).alias("most"),
            ).collect()
            placed.append(_columns(swept.where("state = 'placed'")))
            was, n = n, sum(r["docs"] for r in held)
            docs, live = swept.where(left).select(*_PIECE), swept.where("state in ('open', 'gap')").select("sequence_id", "size")
            if not n:
                break
            if runs := match_ranges([(r["part"], r["docs"], r["slots"]) for r in held]):
                filled, docs, unused = _across(swept, runs)
                filled = scratch.keep(filled, f"across-{rounds}")
                placed.append(_columns(filled.withColumn("offset", F.lit(max_len) - F.col("size") + F.col("upto") - F.col("length"))))
                live = union([swept.where("state = 'gap'").select("sequence_id", "size"), unused, filled.where("final").select("sequence_id", (F.col("size") - F.col("upto")).alias("size")).where("size > 0")])
                n -= sum(r[-1] for r in runs)
            elif n == was or max((r["most"] or 0 for r in held), default=0) < min(r["least"] for r in held if r["docs"]):
                break
        gaps.append(live)
        if n:
            swept = sweep(docs, None, n, hi)
            placed.append(_columns(swept.where("state = 'placed'")))
            gaps.append(swept.where("state in ('open', 'gap')").select("sequence_id", "size"))
    return union(placed)


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*_PIECE[1:], "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 1024, end_id: int = 2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Pack all documents into sequences of at most ``max_len`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row for each
    piece; null and empty texts are the end token alone, null doc_ids and repeated rows are
    packed like any other, an empty table gives an empty result. Texts are tokenised once and never moved; what is sorted
    and swept are rows of seven numbers (``best_fit``).
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, tokenizer_path, max_len, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return best_fit(cut, max_len, scratch, range_rows)
