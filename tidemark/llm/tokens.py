"""Token ids of a byte-level BPE vocabulary, for use inside tasks."""

from __future__ import annotations

import base64
import json
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"
END_ID = 1


class Encoder:
    """Ids as the tokenizer file gives them without special tokens added.

    The ranks file holds the same vocabulary and encodes several times faster; a text that spells out a special token
    goes through the tokenizer file itself, which has an id for it."""

    def __init__(self, name: str = VOCABULARY):
        self.path = public_tokenizers.path(f"{name}.json")
        with open(self.path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self) -> Tokenizer:
        """Read when the first text needs it."""
        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids and END_ID, as uint32. A null text is an empty one."""
        text = text or ""
        if any(s in text for s in self.special):
            found = self.exact.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.array([*found, END_ID], np.uint32)


@cache
def encoder(name: str = VOCABULARY) -> Encoder:
    """One for each Python worker."""
    return Encoder(name)
