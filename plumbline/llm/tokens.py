"""Byte-level BPE ids of texts, the same as the tokenizer file gives, at the speed of ranks."""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Beyond these characters the two libraries might know different versions of Unicode.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")


class Encoder:
    """``encode(text)`` gives uint32 ids without special tokens.

    Ranks give the ids of ordinary texts. A text that spells an added token, has
    characters on which two versions of Unicode may differ, or has a run of white space that is too long for
    the ranks' pattern goes to the tokenizer itself. ``plain`` makes added tokens in a text plain text.
    """

    def __init__(self, tokenizer: str, ranks: str, plain: bool = False):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.file, self.plain = tokenizer, plain
        with open(tokenizer, encoding="utf-8") as text:
            self.added = [] if plain else [t["content"] for t in json.load(text).get("added_tokens", [])]

    @cached_property
    def exact(self) -> Tokenizer:
        """The tokenizer itself, read when a text needs it: it takes more memory than the ranks."""
        tokenizer = Tokenizer.from_file(self.file)
        tokenizer.encode_special_tokens = self.plain
        return tokenizer

    def encode(self, text: str) -> np.ndarray:
        if (text.isascii() or not _OTHER.search(text)) and not any(t in text for t in self.added):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # its pattern's stack does not hold a run of about a million white spaces
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> Encoder:
    return Encoder(tokenizer, ranks)
