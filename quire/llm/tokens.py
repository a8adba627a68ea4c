"""Text sizes in tokens of a public byte-level tokenizer, counted exactly.

A byte-level BPE never merges across the pieces its splitting pattern makes, so the
count of a text is the sum over its pieces. Words repeat, so a worker keeps the counts
of the pieces it has met (at most CACHE_LIMIT of them) and encodes each only once.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_LIMIT = 500_000

# Fixed value: the splitting pattern of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# End of fixed value.

_GAP = r" \t\n\r\f\v"
#: The same pattern for texts that are ASCII, in a form the faster standard matcher takes.
ASCII_PATTERN = PATTERN.replace(r"^\s\p{L}\p{N}", rf"^{_GAP}A-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\S", rf"[^{_GAP}]").replace(r"\s", f"[{_GAP}]")

PIECES = T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))
_ARROW_PIECES = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("tokens", pa.int32())]))


class TokenCounter(dict):
    """piece -> number of tokens, filled as pieces are met; one per worker process."""

    def __init__(self, vocabulary: str) -> None:
        import regex
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ascii, self._any = re.compile(ASCII_PATTERN), regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        n = len(self._encoding.encode_ordinary(piece))
        if len(piece) < 100:
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        return (self._ascii if text.isascii() else self._any).findall(text)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces(text)))

    def cut(self, text: str, capacity: int) -> list[tuple[int, int, int]]:
        """Consecutive (start, end, tokens) spans of at most `capacity` tokens that cover
        the text: one where it fits, else full ones cut between pieces. A piece that is
        itself too large is cut between characters."""
        total = self.count(text)
        if total <= capacity:
            return [(0, len(text), total)] if total else []
        spans, start, at, size = [], 0, 0, 0
        for piece in self.pieces(text):
            n = self[piece]
            if n > capacity:
                step = max(1, capacity // 4)  # no character takes more than 4 tokens
                parts = [piece[i : i + step] for i in range(0, len(piece), step)]
            else:
                parts = [piece]
            for part in parts:
                m = n if len(parts) == 1 else self[part]
                if size and size + m > capacity:
                    spans.append((start, at, size))
                    start, size = at, 0
                at, size = at + len(part), size + m
        spans.append((start, at, size))
        return spans


_counters: dict[str, TokenCounter] = {}


def counter(vocabulary: str) -> TokenCounter:
    if vocabulary not in _counters:
        _counters[vocabulary] = TokenCounter(vocabulary)
    return _counters[vocabulary]


def token_count(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of a text; null and empty texts have 0."""

    @F.arrow_udf(T.IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        c = counter(vocabulary)
        return pa.array([c.count(t) if t else 0 for t in texts.to_pylist()], pa.int32())

    return count(text)


def token_spans(text: Column, capacity: int, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Spans of at most `capacity` tokens that cover a text (TokenCounter.cut); none for
    null and empty texts."""

    @F.arrow_udf(PIECES)
    def spans(texts: pa.Array) -> pa.Array:
        c = counter(vocabulary)
        out = [[dict(zip(("char_start", "char_end", "tokens"), s)) for s in c.cut(t, capacity)] if t else [] for t in texts.to_pylist()]
        return pa.array(out, _ARROW_PIECES)

    return spans(text)
