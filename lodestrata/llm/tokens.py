"""Encoding texts with a public byte-level BPE, and back."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestrata.session import spread

#: Where the public vocabularies lie, unless the session names another folder.
FOLDER, FOLDER_SETTING = "/opt/tokenizers", "lodestrata.tokenizers"
# Fixed value: the pre-splitting pattern that belongs to the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is cut before it is encoded.
LONG_TEXT = 20_000
#: No token of the pattern reaches from a letter, digit or mark into a blank after it, nor from a Han or Kana
#: letter into the full stop or comma after it.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \t\r\n])|(?<=[一-龥ぁ-ゖァ-ヺ])(?=[。、，！？])")


def rank_file(spark: SparkSession, name: str = "byte_bpe_50k") -> bytes:
    """The rank file of a vocabulary, read on the driver; under 1 MB, so it can travel with the tasks."""
    return (Path(spark.conf.get(FOLDER_SETTING, FOLDER)) / f"{name}.tiktoken").read_bytes()


_ENCODINGS: dict = {}


def encoding(ranks: bytes):
    """The encoding of a rank file; built once per Python worker."""
    import tiktoken

    name = hashlib.sha256(ranks).hexdigest()
    if name not in _ENCODINGS:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        _ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[name]


def safe_pieces(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """Cut `text` into pieces of about `limit` characters or more whose encodings put together are that of the whole.

    Where no safe place follows, as in one endless word, the piece runs on to the next or to the end.
    """
    start = 0
    while len(text) - start > limit:
        found = SAFE.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(bpe, text: str | None, limit: int = LONG_TEXT) -> np.ndarray:
    """Ids of a text; none for an empty or null one. Text that looks like a special token is ordinary text."""
    if not text:
        return np.array([], dtype="uint32")
    if len(text) <= limit:
        return np.asarray(bpe.encode_ordinary(text), dtype="uint32")
    return np.concatenate([np.asarray(bpe.encode_ordinary(p), dtype="uint32") for p in safe_pieces(text, limit)])


def _keep(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[df[c] for c in columns])


def encode(documents: DataFrame, ranks: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row: its text's ids without special tokens.

    Null and empty texts give the empty list; blank ones are encoded as they are. Repeated keys give a row each.
    Whole texts are encoded, long ones piece by piece, in the tasks that read them: there is no shuffle
    (only a table in fewer files than there are cores is spread out first).
    """
    source = _keep(documents, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks)
        for batch in batches:
            ids = [encode_text(bpe, t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, ids)])
            values = pa.array(np.concatenate(ids).astype("int32") if ids else np.array([], "int32"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype("int32")), values)], names=[key, "ids"])

    return spread(source).mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, ranks: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens bigint): the length of what `encode` gives, without carrying the ids."""
    source = _keep(documents, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks)
        for batch in batches:
            sizes = np.array([len(encode_text(bpe, t.as_py())) for t in batch.column(1)], dtype="int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=[key, "n_tokens"])

    return spread(source).mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, n_tokens bigint")


@lru_cache(maxsize=4)
def _bytes_of(ranks: bytes) -> tuple[bytes, ...]:
    table = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tuple(table.get(i, b"") for i in range(max(table, default=-1) + 1))


def decode(encoded: DataFrame, ranks: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the raw bytes of all ids of a row put together, then read as UTF-8.

    Bytes come first because a character may be spread over several ids. Null and empty lists give the empty
    text; bytes that are no UTF-8, as in a list that was cut, give U+FFFD; ids not in the vocabulary give nothing.
    """
    source = _keep(encoded, key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _bytes_of(ranks)
        for batch in batches:
            texts = [
                b"".join([words[i] for i in row.as_py() if 0 <= i < len(words)]).decode("utf-8", "replace") if row.is_valid else ""
                for row in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, text string")
