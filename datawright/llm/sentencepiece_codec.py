"""SentencePiece encoding and decoding of text columns by the streaming Viterbi pass of ``lattice``.

Ids equal those of the public library for models with the identity normaliser, unigram or BPE, with byte fallback.
Nulls and empty texts give no ids. Decoding gives the text back exactly, unless it holds U+2581, which
stands for a blank, or, without byte fallback, characters that the model lacks.
Texts of any length are handled: beside a text and its ids one chunk of it is held. Repeated rows are encoded each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship
from .lattice import Encoder, loaded

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text after which a batch of results goes back to Spark.
PART_CHARS = 2_000_000


def model_bytes(path: str = MODEL) -> bytes:
    """The model's bytes, read on the driver and shipped with the task: under a megabyte for the public ones."""
    with open(path, "rb") as f:
        return f.read()


def parts(batch: pa.RecordBatch, text_at: int, most: int = PART_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with their texts, each about ``most`` characters or one text."""
    begin = held = 0
    texts: list[str | None] = []
    column = batch.column(text_at)
    for i in range(batch.num_rows):
        texts.append(column[i].as_py())
        held += len(texts[-1] or "")
        if held >= most:
            yield batch.slice(begin, i + 1 - begin), texts
            begin, held, texts = i + 1, 0, []
    if texts:
        yield batch.slice(begin), texts


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL, verify: bool = False) -> DataFrame:
    """``keep`` columns with ``n_tokens`` (long) and ``ids`` (array of int); with ``verify`` also ``decoded``: whether decoding gives the text back (a null counts as empty)."""
    data = model_bytes(model)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(Encoder, data)
        for batch in batches:
            for part, texts in parts(batch, len(keep)):
                flat: list[np.ndarray] = []
                ok, counts = [], []
                for text in texts:
                    ids = coder.encode(text or "")
                    flat.append(np.array(ids, np.int32))
                    counts.append(len(ids))
                    if verify:
                        ok.append(coder.decode(ids) == (text or ""))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                arrays = [*part.columns[: len(keep)], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ok, pa.bool_())] if verify else [])], names)

    names = [*keep, "n_tokens", "ids", *(["decoded"] if verify else [])]
    picked = docs.select(*keep, text_col)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in picked.dtypes[: len(keep)]), "n_tokens long", "ids array<int>", *(["decoded boolean"] if verify else [])])
    return picked.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """``keep`` columns with ``text``; null ids give an empty text."""
    data = model_bytes(model)
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(Encoder, data)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    picked = encoded.select(*keep, ids_col)
    return picked.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in picked.dtypes[: len(keep)]), "text string"]))
