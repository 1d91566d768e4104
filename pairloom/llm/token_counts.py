"""Token counts of whole texts.

Ordinary documents are encoded piece by piece; documents longer than a chunk go
through overlap resynchronisation (see `tokens.Chunked`), which bounds the
memory of one encode call however long the document is.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); a text
without any blank is encoded whole once its overlaps have widened to it;
repeated rows and null ids pass through; an empty table gives an empty result;
extra columns do not take part. Counts are those of the tokenizers library.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CHUNK, OVERLAP, Chunked, encoder


def count_tokens(docs: DataFrame, path: str, blanks_drop: bool, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chunked."""

    def run(batches):
        pieces = encoder(path, blanks_drop)
        chunks = Chunked(pieces.tokenizer, chunk, overlap)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [pieces.count(t) if len(t) <= chunk else len(chunks.ids(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array([len(t) > chunk for t in texts])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "chunked"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, chunked boolean")
