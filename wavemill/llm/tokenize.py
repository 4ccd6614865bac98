"""Problem 7: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import FILE, TOKENIZER_DIR, encoder
from .common import spread

#: Texts that are encoded together: the words of one slice are proposed and verified in one go.
SLICE = 512


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, file: str = FILE) -> DataFrame:
    """(id, ids ARRAY<INT>): each row's text by a byte-level BPE vocabulary, without special tokens.

    A null and an empty text give an empty list, never null. Strings of special tokens are ordinary text. Rows are
    neither merged nor dropped: repeated rows come out repeatedly; other columns of df are ignored. One narrow pass:
    no shuffle, nothing collected.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_dir, file)
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                batch = big.slice(at, SLICE)
                ids = bpe.encode_batch(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return spread(df.select(id_col, text_col), id_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
