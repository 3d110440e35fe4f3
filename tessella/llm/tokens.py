"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary used where none is named; it stays where the tokenizers lie.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the rank files' vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def counter(path: str):  # noqa: ANN201
    """A function from a text to its number of tokens, for a .tiktoken, .json or .model vocabulary; loaded once per process."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda x: len(enc.encode_ordinary(x))
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _loaded[path] = lambda x: len(tok.encode(x, add_special_tokens=False).ids)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda x: len(sp.encode(x))
    return _loaded[path]


def sizes(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns of keep, tokens (BIGINT) and digest (of the text) of every row; a null text has no tokens and no digest."""

    @F.pandas_udf("struct<tokens:long,digest:binary>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        n = counter(path)
        for s in batches:
            yield pd.DataFrame({"tokens": [0 if x is None else n(x) for x in s], "digest": [None if x is None else hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for x in s]})

    return df.select(*[df[c] for c in keep], count(df[text]).alias("_t")).select(*keep, "_t.tokens", "_t.digest")
