"""Problem 8: the whole corpus as token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.bpe import default_vocabulary, transducer
from linkloom.runtime import table

#: Texts that Python takes up at a time; Spark bounds the bytes of what it sends.
TEXTS_A_SLICE = 512


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_A_SLICE):
            yield batch.slice(at, TEXTS_A_SLICE)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in _slices(batches):
            packed = [machine.packed(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
            ids = np.frombuffer(b"".join(packed), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return run


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in _slices(batches):
            counts = [machine.counts(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))], names=["doc_id", "n_tokens", "n_masked"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in _slices(batches):
            texts = ["".join(machine.decode(i)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode_corpus(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: one row per document, whole texts, no shuffle.

    Null, empty texts give an empty list; strings of special tokens are ordinary text; repeated rows come out as often
    as they stand; other columns are not read. ``vocabulary`` is the path of a rank file on every executor.
    """
    return documents.select("doc_id", "text").mapInArrow(_encoder(vocabulary or default_vocabulary()), "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_masked`` by the same machine, 0 of null and empty texts; masked are the tokens of a preamble."""
    return documents.select("doc_id", "text").mapInArrow(_counter(vocabulary or default_vocabulary()), "doc_id bigint, n_tokens bigint, n_masked bigint")


def decode_corpus(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``: tokens are streamed through an incremental UTF-8 machine; an empty list gives an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(vocabulary or default_vocabulary()), "doc_id bigint, text string")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: ``doc_id`` and the text's MD5 digest; null texts come back empty."""
    return decode_corpus(p8_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
