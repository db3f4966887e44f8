"""Byte-level BPE ids of whole texts. No words are remembered: where many are rare, cutting a
text and looking its words up costs more than encoding it as it is."""

from __future__ import annotations

import base64
import json
from array import array
from functools import cached_property

import numpy as np
import tiktoken
import tokenizers


class ByteBpe:
    """Encodes as tokenizers does with the .json file; `ranks` holds the same vocabulary."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.json_path = json_path
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    @cached_property
    def slow(self) -> tokenizers.Tokenizer:
        """The library itself, for texts that hold its special strings."""
        return tokenizers.Tokenizer.from_file(self.json_path)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers, without added special tokens."""
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_LOADED: dict[tuple, ByteBpe] = {}


def forget() -> None:
    """Drop what byte_bpe has loaded: workers outlive the stages that they serve."""
    _LOADED.clear()


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> ByteBpe:
    """One for each worker and vocabulary."""
    key = (json_path, ranks_path, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(*key)
    return _LOADED[key]
