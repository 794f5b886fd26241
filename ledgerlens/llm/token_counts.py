"""Token counts (operator 6): batches of texts are encoded in an Arrow function
that returns lengths only.

Batches are re-cut to about the same number of bytes, and long texts are split
at safe boundaries (``pieces``), so that memory follows the batch and not the
longest text. There is no shuffle.

Edge cases: a null text counts as empty, an empty text has no tokens. Rows are
judged one by one, so repeated rows and ids give repeated results. An empty
table gives an empty result. Other columns are ignored. A special token's
string inside a text counts as the library does by default."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, one_array, regrouped, table
from .pieces import encoder

BATCH_BYTES = 8 << 20


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and over_limit.

    ``tokenizer_path`` names a .json file for ``tokenizers`` or a .model file
    for ``sentencepiece``; the driver reads it and sends it to the workers."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    is_json = tokenizer_path.endswith(".json")

    def counted(batches):
        if is_json:
            enc = encoder(shared.value.decode())
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for part in regrouped(batches, "text", batch_bytes):
            text = one_array(part["text"])
            n_bytes = np.diff(byte_view(text)[1])
            if is_json:
                n = enc.documents(text, with_ids=False)[0]
            else:
                n = np.array([len(x) for x in model.encode(text.to_pylist(), num_threads=1)], np.int64)
            yield pa.RecordBatch.from_arrays([one_array(part["doc_id"]), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
