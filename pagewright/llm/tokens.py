"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE, one "base64 rank" a line; any such file can be given.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to these ranks and splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(path: str = RANKS):
    """One encoding a process and file."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


#: Texts of at most this many characters are encoded in one call; longer ones in parts cut before a space or line end.
_CALL_CHARS = 50_000


def count(text: str, path: str = RANKS) -> int:
    enc = encoding(path)
    if len(text) <= _CALL_CHARS:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        to = len(text)
        if to - at > _CALL_CHARS:
            cut = text.rfind(" ", at + 1, at + _CALL_CHARS)
            while cut > at and text[cut - 1].isspace():  # a space that follows other white space would be split otherwise
                cut = text.rfind(" ", at + 1, cut)
            to = cut if cut > at else at + _CALL_CHARS
        total += len(enc.encode_ordinary(text[at:to]))
        at = to
    return total


def with_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str = RANKS) -> DataFrame:
    """The columns keep and tokens (bigint) of each row; a null or empty text has 0 tokens. Only keep and the text are read."""
    own = docs.select(*keep, F.col(text).cast("string").alias("_text"))

    def measure(batches):
        for b in batches:
            sizes = [0 if t is None else count(t, path) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sizes, pa.int64())], [*keep, "tokens"])

    schema = own.select(*keep).withColumn("tokens", F.lit(0).cast("long")).schema
    return own.mapInArrow(measure, schema)
