"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import arrow_map, column, documents, strings

#: Characters of one piece of a split text; also what one call of the library gets at least.
PIECE_CHARS = 1 << 16

_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Split at single blanks between two visible characters, so that piece counts add up.

    Each piece but the first has lost its leading blank, which the model itself puts before any
    text. This holds for models that add a dummy prefix, leave blanks as they are and have no
    vocabulary piece with a blank after another character; ``splittable`` tests that.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def splittable(processor) -> bool:
    """Whether counts of ``safe_pieces`` add up for this model: shown by its pieces and two probes."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        return False
    joined = lambda a, b: processor.encode(f"{a} {b}") == processor.encode(a) + processor.encode(b)
    blanks = processor.encode("a  b") != processor.encode("a b")
    return blanks and joined("a", "b") and joined("über den", "x1,")


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Tokens of every whole text by a sentencepiece model file.

    Returns doc_id, n_bytes (UTF-8), n_tokens and over_limit, a row for every input row, in any
    order; only lengths leave the Python workers. Null and empty texts have 0 bytes and 0 tokens.
    Texts longer than ``PIECE_CHARS`` are split at safe boundaries, batches are cut by bytes, and
    within a batch equal texts are encoded once. Null doc_ids and repeated rows are kept as they are.
    The library's defaults hold for special strings in a text: they are ordinary text.
    """

    def make():
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        split = splittable(processor)

        def one(batch: pa.RecordBatch) -> dict:
            texts = strings(batch)
            distinct = list(dict.fromkeys(texts))
            pieces: list[str] = []
            owner: list[int] = []
            for i, t in enumerate(distinct):
                own = list(safe_pieces(t)) if split else [t]
                pieces += own
                owner += [i] * len(own)
            counts = [0] * len(distinct)
            for i, ids in zip(owner, processor.encode(pieces, num_threads=1), strict=True):
                counts[i] += len(ids)
            by_text = dict(zip(distinct, counts, strict=True))
            n = [by_text[t] for t in texts]
            return {
                "doc_id": column(batch, "doc_id"),
                "n_bytes": pc.fill_null(pc.binary_length(column(batch, "text").cast(pa.binary())), 0),
                "n_tokens": n,
                "over_limit": [x > limit for x in n],
            }

        return one

    return arrow_map(documents(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
