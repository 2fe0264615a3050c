"""Token ids of a byte-level BPE file of the ``tokenizers`` library.

The ids are those that ``tokenizers`` gives for the file.  Most texts are encoded by ``tiktoken``
with the vocabulary read from the same file, which takes a third of the time and was found equal
on every code point (``tests/llm/test_alignment.py`` repeats that).  Texts with a special token's
string, where it counts as one, and texts with very long white space, which the other library's
pattern cannot run through, are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np

from .common import fresh_start, worker_cache

# How a byte-level file parts a text, and the bytes that stand for themselves in it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

LONG_WHITE = re.compile(r"\s{256}")
MAYBE_LONG = re.compile(r"\s{4}")  # among every 64th letter


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level piece stands for; unprinted bytes follow from 256 on."""
    others = [b for b in range(256) if b not in PRINTED]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteEncoder:
    """Encodes texts with a byte-level file; ``plain`` takes the strings of special tokens as text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path, self.plain = path, plain
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"] for t in spec["added_tokens"]}
        self.special = [] if plain else sorted(added)
        letters = byte_letters()
        vocabulary = {p: i for p, i in spec["model"]["vocab"].items() if p not in added}
        self.bytes_of = {i: bytes(letters[c] for c in p) for p, i in vocabulary.items()}
        ranks = {data: i for i, data in self.bytes_of.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.size = max(self.bytes_of) + 1
        self.quick = None
        shape = spec["pre_tokenizer"] or {}
        plain_shape = shape.get("type") == "ByteLevel" and shape.get("use_regex") and not shape.get("add_prefix_space")
        if plain_shape and not spec["normalizer"] and not spec["model"].get("ignore_merges"):
            self.quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """The library's own, which few texts need."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = self.plain
        return made

    def encode(self, text: str) -> list[int]:
        long_white = MAYBE_LONG.search(text[::64]) and LONG_WHITE.search(text)
        if self.quick is None or long_white or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)

    def byte_lengths(self) -> np.ndarray:
        lengths = np.zeros(self.size, np.int64)
        for i, data in self.bytes_of.items():
            lengths[i] = len(data)
        return lengths


_encoders: dict[tuple[str, bool], ByteEncoder] = worker_cache()


def byte_encoder(path: str, plain: bool = False) -> ByteEncoder:
    """The worker's encoder of that file, kept from one task to the next."""
    if (path, plain) not in _encoders:
        fresh_start()
        _encoders[path, plain] = ByteEncoder(path, plain)
    return _encoders[path, plain]
