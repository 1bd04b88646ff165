"""Column-level text functions: JVM built-ins, but for truncation by a given tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexical tokenisation rule shared with the SQL oracle.
# Lower-case, split on runs of characters that are neither letters nor digits,
# drop empty pieces.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
WHITESPACE = r"\s+"


def tokens(text: Column | str) -> Column:
    """``array<string>`` of lexical tokens of ``text``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(c), TOKEN_SPLIT), "")


def words(text: Column | str) -> Column:
    """Whitespace-delimited pieces (no case folding)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(c, WHITESPACE)


def py_strip(text: Column | str) -> Column:
    """Strip leading/trailing white space the way Python ``str.strip`` does.

    Spark ``trim`` removes spaces only; Python also removes tabs, newlines and
    the other Unicode white-space characters.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def truncate_tokens(text: Column | str, max_tokens: int) -> Column:
    """X3 with the default regex tokenizer.

    A text with at most ``max_tokens`` tokens is returned unchanged; otherwise
    the original text up to the end of token ``max_tokens`` is kept (the decode
    of the first ``max_tokens`` token ids, spelling and separators preserved).
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    c = F.col(text) if isinstance(text, str) else text
    head = (r"^[^\p{L}\p{N}]*+(?:[\p{L}\p{N}]++[^\p{L}\p{N}]++){%d}[\p{L}\p{N}]++"
            % (max_tokens - 1))
    return F.when(F.size(tokens(c)) <= max_tokens, c).otherwise(
        F.regexp_extract(c, head, 0))


Encode = Callable[[str], list[int]]
Decode = Callable[[list[int]], str]


def tokenizer_file(path: str) -> Callable[[], tuple[Encode, Decode]]:
    """Loader of a tokenizer file (JSON) for ``truncate_by_tokenizer``; the path must be there on executors."""
    def load() -> tuple[Encode, Decode]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return (lambda text: tok.encode(text, add_special_tokens=False).ids,
                lambda ids: tok.decode(ids, skip_special_tokens=False))
    return load


def truncate_by_tokenizer(text: Column | str, max_tokens: int, load: Callable[[], tuple[Encode, Decode]]) -> Column:
    """X3 with any tokenizer: a text of more than ``max_tokens`` ids becomes what its first ids decode to.

    ``load`` gives ``(encode, decode)`` and runs once per task; a shorter text is unchanged, null stays null.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = load()

        def one(t):
            ids = encode(t) if isinstance(t, str) else []
            return t if len(ids) <= max_tokens else decode(ids[:max_tokens])

        for batch in batches:
            yield pd.Series([one(t) for t in batch], dtype=object)

    return cut(F.col(text) if isinstance(text, str) else text)


def with_prefix(text: Column | str, prefix: str | None) -> Column:
    """Prefix prepended for embedding only."""
    c = F.col(text) if isinstance(text, str) else text
    return c if not prefix else F.concat(F.lit(prefix), c)
