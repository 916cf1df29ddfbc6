"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (base64 token and rank per line) of a byte-level BPE.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how that vocabulary's texts are split before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Encoders by vocabulary, kept as long as a Python worker lives.
LOADED: dict = {}


def with_tokens(df: DataFrame, text: str, out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with its number of tokens in ``out``; null and the empty text have none.

    Texts are tokenized whole. A column called ``out`` is replaced. The vocabulary, under 1 MB, is read by
    the driver and broadcast.
    """
    with open(vocabulary, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    kept = [f for f in df.schema.fields if f.name not in (text, out)]
    rows = df.select(*(F.col(f"`{f.name}`") for f in kept), F.coalesce(F.col(text), F.lit("")).alias("\x00text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        from fluxgrid.llm import tokens

        if vocabulary not in tokens.LOADED:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.value.splitlines())}
            tokens.LOADED[vocabulary] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        encode = tokens.LOADED[vocabulary].encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*batch.schema.names[:-1], out])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` long"])
    return rows.mapInArrow(count, fields)
