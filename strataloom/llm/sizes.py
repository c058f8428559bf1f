"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.runtime import spread

#: Setting that names the tokenizer file on every node, and its value where unset: ranks of byte pairs (.tiktoken), or a tokenizer as JSON (.json).
SETTING, DEFAULT = "strataloom.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how a text is parted before byte pairs are joined.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts given to the tokenizer at once.
TEXTS = 64


def counter(path: str):
    """A function from a list of texts to their numbers of tokens; strings of special tokens are ordinary text."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        model = tiktoken.Encoding("own", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(model.encode_ordinary(t)) for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    encode = getattr(model, "encode_batch_fast", model.encode_batch)  # without offsets, where the library has it
    return lambda texts: [len(e) for i in range(0, len(texts), TEXTS) for e in encode(texts[i : i + TEXTS], add_special_tokens=False)]


def tokenizer_path(spark) -> str:
    return spark.conf.get(SETTING, DEFAULT)


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, digest, tokens) of every document with a text; strings of special tokens are ordinary text.

    A narrow pass: each text is tokenized whole where it lies. NULL texts and NULL ids give no row, an empty text has 0 tokens.
    """
    path = path or tokenizer_path(documents.sparkSession)

    schema = T._parse_datatype_string("doc_id long, source string, digest string, tokens long")

    def run(batches):
        count = counter(path)
        for batch in batches:
            sizes = count(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes, pa.int64())], names=["doc_id", "source", "digest", "tokens"])

    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.sha2("text", 256).alias("digest"), "text")
    return spread(texts).mapInArrow(run, schema)
