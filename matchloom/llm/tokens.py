"""Token ids of whole texts under a public byte-level BPE vocabulary.

The ids are those of ``tokenizers`` with ``add_special_tokens=False``. Ordinary text is encoded by ``tiktoken``
with the same vocabulary as ranks, which gives the same ids in a fifth of the time; a text that holds the string
of a special token, which ``tokenizers`` turns into its id, goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np


def vocabulary(name: str) -> str:
    """The place of a vocabulary file, looked up where it is used: each machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as arrays of unsigned 32-bit numbers, by the vocabulary ``<name>.json`` and its ranks ``<name>.tiktoken``."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.name = name
        self.special = "<|endoftext|>"
        #: UTF-8 bytes of each token; a special token has those of its string.
        self.width = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.width[-1] = len(self.special)

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(vocabulary(f"{self.name}.json"))

    def ids(self, text: str) -> np.ndarray:
        if self.special in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """One encoder per worker process."""
    return Encoder(name)
