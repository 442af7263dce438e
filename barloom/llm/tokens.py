"""A corpus to token ids, or to their numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.bpe import TOKENIZERS, Encoder
from barloom.session import ship


def _encode(path: str, count_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                packed = [encoder.packed(t) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
                if count_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes)], ["id", "n_tokens"])
                    continue
                offsets = np.zeros(len(packed) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["id", "ids"])

    return run


def encode_corpus(documents: DataFrame, id_column: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_column and ``ids``, the tokens of each whole text without special tokens; an empty list for null and empty texts.

    Strings of special tokens in a text are ordinary text. Rows stay where they are: no shuffle. Repeated rows and null
    ids are kept as they come. The vocabulary is read from ``folder``/``tokenizer``.tiktoken on each executor.
    """
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)[id_column]
    out = documents.select(id_column, text).mapInArrow(_encode(f"{folder}/{tokenizer}.tiktoken", False), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_column)


def decoded(corpus: DataFrame, id_column: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_column and ``text``, the text whose tokens are in ``ids``; a null list gives a null text. Bytes that are no UTF-8 are
    replaced."""
    ship(corpus.sparkSession)
    kind, path = dict(corpus.dtypes)[id_column], f"{folder}/{tokenizer}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = Encoder.of(path).v.bytes_of
        for batch in batches:
            texts = [None if own is None else b"".join([bytes_of[i] for i in own]).decode("utf-8", "replace") for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return corpus.select(id_column, ids).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def count_tokens(documents: DataFrame, id_column: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_column and ``n_tokens``, the length of what encode_corpus() gives."""
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)[id_column]
    out = documents.select(id_column, text).mapInArrow(_encode(f"{folder}/{tokenizer}.tiktoken", True), f"id {kind}, n_tokens long")
    return out.withColumnRenamed("id", id_column)
