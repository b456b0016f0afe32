"""Byte-pair encoding and decoding by the contiguous rank array."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from meterlake.llm.bpe import RankArrayBpe, loaded
from meterlake.llm.common import id_and_text, slices


def encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row: the ids that the tokenizers library gives without added special tokens.

    Null and empty texts give an empty array; null ids stay null; repeated rows give one row each; other columns are
    ignored. Narrow: no shuffle.
    """

    def run(batches):
        codec = loaded(RankArrayBpe, vocabulary)
        for batch in slices(batches):
            ids = pa.array([codec.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the library's decode without skipping special tokens. Null ids: empty text."""

    def run(batches):
        codec = loaded(RankArrayBpe, vocabulary)
        for batch in slices(batches):
            texts = [codec.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, keeping digests only.

    ``ids_sha256`` is over the decimal ids with one space between them, ``decoded_sha256`` over the decoded text.
    Null and empty texts: no ids, both digests of the empty string.
    """

    def run(batches):
        codec = loaded(RankArrayBpe, vocabulary)
        decimal = [str(i) for i in range(len(codec.vocabulary.pieces))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches):
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                n.append(len(ids))
                a.append(sha(" ".join(map(decimal.__getitem__, ids))))
                b.append(sha(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
