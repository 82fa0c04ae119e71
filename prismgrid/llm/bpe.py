"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode`` adds an ``array<int>`` of token ids, ``decode`` turns ids back into raw bytes.
Both run on Arrow batches; the rank file is read once per worker process.

Long texts are cut before they reach the library, at places where no match of the pattern
can cross: before a white-space character that follows a non-space character. Every
alternative that starts with a non-space ends there, and white-space runs stay whole, so
the ids equal those of the uncut text. White space is Unicode's, as in the pattern.

The library backtracks over white-space runs and gives up on very long ones. A run of
``LONG_RUN`` characters or more is therefore taken out: followed by a non-space, all but its
last character is one match of the pattern (``\\s+(?!\\S)``), at the end of the text all of it
is; that match is merged as one piece, and the last character stays with what follows.

Null text counts as empty (no ids, empty bytes). An existing column of the result's name is
replaced; other columns and repeated rows pass through unchanged.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismgrid.llm.common import small_batches

#: Characters above which a text is cut before encoding.
LONG_TEXT = 16_384
#: Length of a white-space run that is merged without the pattern.
LONG_RUN = 4_096
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_RUN = re.compile(rf"[{_SPACE}]{{{LONG_RUN},}}")
_loaded: dict[tuple[str, str], object] = {}


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, kept per process."""
    if (rank_file, pattern) not in _loaded:
        import tiktoken

        with open(rank_file, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _loaded[rank_file, pattern] = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _loaded[rank_file, pattern]


def pieces(text: str, long_text: int = LONG_TEXT) -> list[str]:
    """The text, cut at safe boundaries into parts of about ``long_text`` characters."""
    out, start = [], 0
    while len(text) - start > long_text:
        cut = _SAFE.search(text, start + long_text)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode_text(enc, text: str, long_text: int = LONG_TEXT) -> np.ndarray:
    """Ids of one text as int32."""
    parts, start = [], 0
    for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
        parts += [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text[start : run.start()], long_text)]
        start = run.end() - (run.end() < len(text))
        parts.append(np.array(enc._encode_single_piece(text[run.start() : start]), np.uint32))
    parts += [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text[start:], long_text)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype(np.int32)


def encode(
    docs: DataFrame, rank_file: str, pattern: str, text: str = "text", to: str = "ids", long_text: int = LONG_TEXT
) -> DataFrame:
    """``docs`` with the ids of ``text`` in column ``to`` (``array<int>``)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(rank_file, pattern)
        each = [encode_text(enc, x or "", long_text) for x in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *each])))

    return docs.withColumn(to, ids(F.col(text)))


def decode_lists(enc, values: pa.Array) -> pa.Array:
    """Raw bytes of each list of ids. Null lists: empty. Ids leave Arrow as one block; a scalar object for each of
    them costs as much as encoding."""
    flat, ends = values.values.to_numpy(zero_copy_only=False), values.offsets.to_pylist()
    known = values.is_valid().to_pylist()
    each = [enc.decode_bytes(flat[a:b].tolist()) if ok else b"" for a, b, ok in zip(ends, ends[1:], known, strict=False)]
    return pa.array(each, pa.binary())


def decode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the raw bytes of the ids in column ``to`` (``binary``). Null ids: empty."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.BinaryType())
    def raw(values: pa.Array) -> pa.Array:
        return decode_lists(encoding(rank_file, pattern), values)

    return docs.withColumn(to, raw(F.col(ids)))
