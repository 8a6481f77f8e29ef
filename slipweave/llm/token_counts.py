"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Rows are taken in batches balanced by bytes; every text is split at safe boundaries, so a long text is only many more pieces. The
unknown pieces of a batch go to the library together and a bounded cache keeps their lengths. Special strings inside texts count as the
library does by default. The vocabulary's path is a parameter and is read by each Python worker. Null counts as empty: no tokens.
"""
from __future__ import annotations

import gc
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from slipweave.llm.common import buffer_of, chunks, column, documents
from slipweave.llm.pieces import Encoded, cut
from slipweave.llm.registry import query

LIMIT = 512
#: Pieces that the library encodes in one call.
CALL = 1 << 14


def lengths(path: str):
    """A function from strings to their token counts, by the library for the file: tokenizers for .json, sentencepiece for .model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for lo in range(0, len(texts), CALL) for ids in model.encode(texts[lo:lo + CALL], num_threads=1)]
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for lo in range(0, len(texts), CALL) for e in model.encode_batch_fast(texts[lo:lo + CALL], add_special_tokens=False)]


def counter(path: str):
    """A function from a list of texts to their token counts. Cuts at spaces are safe for byte-level files; other files take whole texts."""
    encode = lengths(path)
    if path.endswith(".model") or '"ByteLevel"' not in open(path, encoding="utf-8").read(4096):
        return encode
    known = Encoded(encode)

    def run(texts: list[str]) -> list[int]:
        pieces = [cut(t) for t in texts]
        known.fill(pieces)
        return [sum(map(known.__getitem__, p)) for p in pieces]
    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of docs."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        gc.disable()  # nothing here forms cycles, and the cache holds many small objects
        count = counter(path)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            data = data.tobytes()
            for lo, hi in chunks(offsets):
                n = count([data[offsets[i]:offsets[i + 1]].decode() for i in range(lo, hi)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(offsets[lo + 1:hi + 1] - offsets[lo:hi]), pa.array(n, pa.int64())],
                                                 names=["doc_id", "n_bytes", "n_tokens"])
    given = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    counted = given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    import public_tokenizers
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
