"""Texts in tokens of a public byte-level tokenizer, with the bytes each token covers."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: The vocabulary used unless a path is given, and where vocabularies lie; ``ALLELAKE_TOKENIZERS`` names another folder.
VOCABULARY = "byte_bpe_50k.tiktoken"
FOLDER = os.environ.get("ALLELAKE_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the public split pattern that belongs to these vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def tokenizer(path: str | None = None) -> tuple[object, np.ndarray]:
    """The encoding at ``path`` (a file of base64 tokens and ranks) and the bytes of each token."""
    import tiktoken

    with open(path or os.path.join(FOLDER, VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def clean(text: str) -> str:
    """``text`` with lone surrogates, which no encoding has, replaced."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def count(text: str, path: str | None = None) -> int:
    """Tokens of a text."""
    return len(tokenizer(path)[0].encode_ordinary(text))


def encode(text: str, path: str | None = None) -> np.ndarray:
    """Where each token ends, in bytes of the UTF-8 text."""
    encoding, sizes = tokenizer(path)
    return np.cumsum(sizes[np.array(encoding.encode_ordinary(text), dtype=np.int64)])
