"""Byte-level BPE ids of texts, as the ``tokenizers`` library gives them."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Code points of plain Latin texts, on whose classes both engines agree (see tests/llm/test_packing.py).
PLAIN = re.compile("[\x20-\x7e\n\r\t\xa1-\xac\xae-ɏ‐-„]*")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, without special tokens.

    With ``ranks_path``, the same vocabulary as merge ranks, plain Latin texts go through ``tiktoken``, several times
    as fast; every other text goes through ``tokenizers``.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.encode_special_tokens = True
    by_ranks = None
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_ranks = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if by_ranks is not None and PLAIN.fullmatch(text):
            return np.asarray(by_ranks.encode_ordinary(text), np.uint32)
        return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode
