"""Token counts of whole texts by a SentencePiece BPE model, with a whole-token shortcut.

The model turns each space into U+2581 and puts one in front. No vocabulary
string holds U+2581 behind another character, so no merge crosses the place
before a run of spaces: a text's tokens are those of its units (a run of
U+2581 and the other characters up to the next), one after the other. A text
is cut into units; a unit that encodes alone as one token counts as one.
``prove_whole`` finds those units offline, by encoding each vocabulary string
once with the library; it also refuses a model for which the argument does not
hold. Only other units are merged, each different one once for a bounded
cache.

Null and empty text have no token. Strings of control tokens inside a text are
ordinary characters, as the library has them by default. Repeated rows count
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpuslode.llm.common import bounded_batches

SPACE = "▁"
#: Units whose counts a Python worker keeps beside the proven ones; then it starts anew.
CACHE_UNITS = 400_000

_UNIT = re.compile(" +[^ ]*")


def prove_whole(model) -> dict[str, int]:
    """Units (without their first U+2581, which the model adds) that are one token alone, as {unit: 1}."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece of this model crosses a space; its texts cannot be cut into units")
    if model.encode("a  b", out_type=str) == model.encode("a b", out_type=str):
        raise ValueError("this model drops spaces; its texts cannot be cut into units")
    units = [p[1:].replace(SPACE, " ") for p in pieces if p.startswith(SPACE) and p != SPACE]
    found = {u: 1 for u, ids in zip(units, model.encode(units, num_threads=1), strict=True) if len(ids) == 1}
    # a space at the end of a text stands alone
    if model.piece_to_id(SPACE) != model.unk_id():
        found[""] = 1
    return found


class Counter:
    """Counts tokens of texts in one Python worker."""

    def __init__(self, model, whole: dict[str, int], cache_units: int = CACHE_UNITS):
        self.model, self.whole, self.most = model, whole, cache_units
        self.cache = dict(whole)

    def units(self, text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [u[1:] for u in _UNIT.findall(" " + text)]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        units, cache = self.units(text), self.cache
        if new := set(units).difference(cache):
            new = list(new)
            if len(cache) + len(new) > self.most:
                self.cache = cache = dict(self.whole)
                new = list(set(units).difference(cache))
            cache.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        return sum(map(cache.__getitem__, units))


_workers: dict[str, Counter] = {}


def counter(model_path: str, whole: dict[str, int]) -> Counter:
    """The worker's counter for a model, kept from task to task."""
    if model_path not in _workers:
        import sentencepiece

        _workers[model_path] = Counter(sentencepiece.SentencePieceProcessor(model_file=model_path), whole)
    return _workers[model_path]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each document. ``model_path`` must be readable on each executor."""
    bounded_batches(docs.sparkSession)
    import sentencepiece

    # bounded by the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(prove_whole(sentencepiece.SentencePieceProcessor(model_file=model_path)))
    d = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path, shared.value)
        for b in batches:
            text = b.column("text")
            n = pa.array([count(t) for t in text.to_pylist()], pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
