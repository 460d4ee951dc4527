"""The tokenizer of public rank files, loaded once in each Python process."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = DEFAULT_PATH) -> tiktoken.Encoding:
    """Byte-level BPE without special tokens: the strings of such tokens are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str = DEFAULT_PATH) -> np.ndarray:
    """How many bytes each token stands for, by its id."""
    enc = encoding(path)
    sizes = np.zeros(enc.n_vocab, np.int64)
    for rank in range(enc.n_vocab):
        try:
            sizes[rank] = len(enc.decode_single_token_bytes(rank))
        except KeyError:
            pass
    return sizes
