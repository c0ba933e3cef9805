"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``SPLIT_CHARS`` are cut at safe boundaries first: between a non-space and a following white-space
character no match of the split pattern can cross, so the parts' ids joined are the ids of the whole text. Runs without
such a boundary are left whole. Ids decode as raw bytes, so any text comes back exactly.

Defined cases: a null text is the empty text (no ids; the digests are those of empty strings). Repeated rows and ids stay
as they are, null ids too. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from quillmesh.llm.common import map_rows

RANKS_FILE = "byte_bpe_50k.tiktoken"
SPLIT_CHARS = 20_000
#: White space of the split pattern, by its Unicode property.
SPACE = "\t-\r \x85\xa0  -     　"
SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """Cuts text into parts of about size characters, only where no match of the pattern can cross."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


class Codec:
    """Encodes whole texts to ids and ids back to bytes."""

    def __init__(self, path: str, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.inner = encoding(path, pattern)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= SPLIT_CHARS:
            return self.inner.encode_ordinary(text)
        ids: list[int] = []
        for part in safe_parts(text):
            ids += self.inner.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.inner.decode_bytes(ids)


def encode_documents(docs: DataFrame, ranks_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    path = ranks_path or vocabulary_path(RANKS_FILE)

    def rows(source):
        codec = Codec(path)
        for key, text in source:
            yield key, codec.encode(text)

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs.select(id_column, text_column), rows, f"{id_column} {kind}, ids array<int>", flush=200)


def round_trip(docs: DataFrame, ranks_path: str | None = None, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids): encodes each text and decodes its ids, in one pass."""
    path = ranks_path or vocabulary_path(RANKS_FILE)

    def rows(source):
        codec = Codec(path)
        for key, text in source:
            ids = codec.encode(text)
            row = key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()
            yield (*row, ids) if with_ids else row

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(id_column, text_column), rows, f"{schema}, ids array<int>" if with_ids else schema, flush=200 if with_ids else 2000)
