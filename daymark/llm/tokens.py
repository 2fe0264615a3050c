"""Token ids of many texts by the ``tokenizers`` library, each distinct word encoded once.

The word-level vocabulary drops white space and never merges across it, so the ids of a text
are those of its words, one after the other.  A task keeps the ids of words it has met, under
two independent 64-bit hashes of each, in sorted arrays, behind plain tables of slots that most
words are found by.  There are two generations of them: when the newer one is full it becomes
the older, and words that are met again move on.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import fresh_start, ragged, split_points, texts_of, worker_cache
from .shingles import OTHER_BASE, mixed, word_spans
from .shingles import span_hashes as long_hashes

WORDS = 1_000_000  # of both generations; about 70 bytes each
SLOTS = 20  # bits of the slots of a table
SIGNS = b",.;:!?%$&*#|"  # never one token with the letters before them
MOST_SIGNS = 8  # behind letters; words with more are encoded as they are
JOINED = 50  # words of letters given to the library at once
LONG = 64  # bytes
STEP = 1 << 14  # least room of what words are kept in

_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS)] = True
_LETTER = np.zeros(256, np.uint8)  # 2: a letter; 1: byte of a sign outside ASCII
_LETTER[128:] = 1
_LETTER[[*range(65, 91), *range(97, 123)]] = 2
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FIRST_BASE = 0x9E3779B97F4A7C15


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _FIRST_BASE) -> np.ndarray:
    """The hash of each span of bytes, A-Z taken as lower case; eight bytes of all spans at once."""
    lower = np.zeros(len(raw) + 8, np.uint8)
    np.add(raw, ((raw - np.uint8(65)) < 26).view(np.uint8) << 5, out=lower[: len(raw)])
    words = np.ndarray(len(raw) + 1, "<u8", lower, strides=(1,))
    lengths = ends - starts
    factor = np.uint64(base)
    hashes = (lengths + 1).astype(np.uint64) * factor
    hashes ^= words[starts] & _MASKS[np.minimum(lengths, 8)]
    hashes = mixed(hashes * factor)
    rest, done = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 8
    while len(rest):
        left = lengths[rest] - done
        part = words[starts[rest] + done] & _MASKS[np.minimum(left, 8)]
        hashes[rest] = mixed((hashes[rest] ^ part) * factor)
        rest, done = rest[left > 8], done + 8
    rest = np.flatnonzero(lengths > LONG)
    if len(rest):
        at = split_points(lengths[rest])
        hashes[rest] ^= long_hashes(raw[ragged(starts[rest], lengths[rest])], at[:-1], at[1:], base)
    return hashes


def _grown(held: np.ndarray, size: int) -> np.ndarray:
    """With room for so many at least; an eighth more, as memory is short."""
    more = max(size + size // 8, STEP) - held.shape[-1] if size > held.shape[-1] else 0
    return np.concatenate([held, np.zeros((*held.shape[:-1], more), held.dtype)], -1) if more else held


class _Generation:
    """Words by their hashes, and the ids of each."""

    def __init__(self) -> None:
        self.first = np.zeros(0, np.uint64)  # ascending
        self.place = np.zeros(0, np.int32)  # of a word in the order of coming
        self.ids, self.used = np.zeros(STEP, np.uint32), 0
        self.starts, self.lengths = np.zeros(STEP, np.int32), np.zeros(STEP, np.int32)
        self.hashes = np.zeros((2, STEP), np.uint64)  # by place
        self.slots = np.zeros(1 << SLOTS, np.int32)  # place + 1 of the first word that came to it

    def quick(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where each word is, if it came first to its slot, else -1."""
        at = self.slots.take(first >> np.uint64(64 - SLOTS)).astype(np.int64) - 1
        same = (self.hashes[0].take(at) == first) & (self.hashes[1].take(at) == second) & (at >= 0)
        return np.where(same, at, -1)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where each word is, -1 for none.  Two words with one first hash are both taken for unknown."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        places = self.place[at]
        return np.where((self.first[at] == first) & (self.hashes[1][places] == second), places, -1)

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[places]
        return self.ids[ragged(self.starts[places], lengths)] if len(places) else np.zeros(0, np.uint32), lengths

    def add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        have, known, many = self.used, len(self.first), len(first)
        self.ids = _grown(self.ids, have + len(ids))
        self.starts, self.lengths = _grown(self.starts, known + many), _grown(self.lengths, known + many)
        self.hashes = _grown(self.hashes, known + many)
        self.ids[have : have + len(ids)] = ids
        self.starts[known : known + many] = have + split_points(lengths)[:-1]
        self.lengths[known : known + many] = lengths
        self.used = have + len(ids)
        self.hashes[:, known : known + many] = first, second
        slots = (first >> np.uint64(64 - SLOTS)).astype(np.int64)
        free = np.flatnonzero(self.slots[slots] == 0)[::-1]  # of several, the first is written last
        self.slots[slots[free]] = known + free + 1
        order = np.argsort(first, kind="stable")
        at = np.searchsorted(self.first, first[order])
        self.first = np.insert(self.first, at, first[order])
        self.place = np.insert(self.place, at, (known + order).astype(np.int32))


def _words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """Words at spans of the data, A-Z in lower case; none of them holds a space."""
    if not len(starts):
        return []
    # Lower case is the vocabulary's own first step; here it makes fewer distinct words.
    return b" ".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]).lower().decode().split(" ")


def _stay_letters(words: list[str]) -> list[bool]:
    """Whether the vocabulary's first steps leave letters only; of some a mark comes off, that joins signs."""
    after = unicodedata.normalize("NFC", " ".join(words)).lower().split(" ") if words else []
    return [a.isalpha() and b.isalpha() for a, b in zip(words, after, strict=True)]


class WordEncoder:
    """Encodes texts with a tokenizer file whose pieces stay within words parted by white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.now, self.before = _Generation(), _Generation()
        # Where a word's last id can be told by itself, words of letters are encoded in rows.
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        self.joins = bool(suffix) and all(sign + suffix in vocabulary for sign in ByteLevel.alphabet())

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters, several to a call; where one has several ends, each by itself."""
        if not self.joins:
            return self._plain(words)
        rows = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        found = self.tokenizer.encode_batch_fast([" ".join(row) for row in rows], add_special_tokens=False)
        found = [np.array(e.ids, np.uint32) for e in found]
        flat = np.concatenate([np.zeros(0, np.uint32), *found])
        at = split_points(np.array([len(ids) for ids in found], np.int64))
        ends = np.flatnonzero(self.last[flat]) + 1
        count = np.diff(np.searchsorted(ends, at, "right"))
        if (count == [len(row) for row in rows]).all():
            return flat, np.diff(ends, prepend=0)
        made = [
            (ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)) if n == len(row) else self._plain(row)
            for row, ids, n in zip(rows, found, count.tolist())
        ]
        flat, lengths = zip(*made)
        return np.concatenate(flat), np.concatenate(lengths)

    def _encoded(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words; letters with signs behind them are put together from the two."""
        cuts = ends.copy()
        left = np.arange(len(ends))
        for _ in range(MOST_SIGNS + 1):
            left = left[_SIGN[raw[cuts[left] - 1]]]
            cuts[left] -= 1
            left = left[cuts[left] > starts[left]]
        cuts[(ends - cuts > MOST_SIGNS) | (cuts == starts)] = 0
        cuts = np.where(cuts, cuts, ends)
        data = raw.tobytes()
        lengths = cuts - starts
        kinds = np.minimum.reduceat(_LETTER[raw[ragged(starts, lengths)]], split_points(lengths)[:-1])
        letters = kinds == 2
        other = np.flatnonzero(kinds == 1)
        letters[other] = _stay_letters(_words(data, starts[other], cuts[other]))
        cuts = np.where(letters, cuts, ends)
        tailed = np.flatnonzero(cuts < ends)
        # Parts: stems or whole words, then the signs behind stems.
        lows, highs = np.concatenate([starts, cuts[tailed]]), np.concatenate([cuts, ends[tailed]])
        letters = np.concatenate([letters, np.zeros(len(tailed), bool)])
        first, second = span_hashes(raw, lows, highs), span_hashes(raw, lows, highs, OTHER_BASE)
        kinds, example, which = np.unique(first, return_index=True, return_inverse=True)
        seconds = second[example]
        new = example[self.now.find(kinds, seconds) < 0]
        for some, encode in ((new[letters[new]], self._rows), (new[~letters[new]], self._plain)):
            self._keep(first[some], second[some], *encode(_words(data, lows[some], highs[some])))
        places = self.now.find(kinds, seconds)
        if (places < 0).any() or (seconds[which] != second).any():  # two of them share a hash
            return self._plain(_words(data, starts, ends))
        places = places[which]
        parts = np.full((len(starts), 2), -1)
        parts[:, 0] = places[: len(starts)]
        parts[tailed, 1] = places[len(starts) :]
        flat, _ = self.now.ids_of(parts[parts >= 0])
        return flat, np.where(parts >= 0, self.now.lengths[parts], 0).sum(1)

    def _keep(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add what is not there yet; a word and a part of another may be the same."""
        fresh = np.flatnonzero(self.now.find(first, second) < 0)
        at = split_points(lengths)
        self.now.add(first[fresh], second[fresh], ids[ragged(at[fresh], lengths[fresh])], lengths[fresh])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start (one more entry than texts); null is empty."""
        if len(self.now.first) > WORDS // 2 or self.now.used > 8 * WORDS:
            self.now, self.before = _Generation(), self.now
            self.before.slots = np.zeros(0, np.int32)  # not asked again
        raw, starts, ends, at = word_spans(column)
        first, second = span_hashes(raw, starts, ends), span_hashes(raw, starts, ends, OTHER_BASE)
        codes = self.now.quick(first, second)
        rest = np.flatnonzero(codes < 0)
        kinds, example, which = np.unique(first[rest], return_index=True, return_inverse=True)
        example = rest[example]
        seconds = second[example]
        new = np.flatnonzero(self.now.find(kinds, seconds) < 0)
        old = self.before.find(kinds[new], seconds[new])
        moved, learnt = new[old >= 0], new[old < 0]
        if len(moved):
            self._keep(kinds[moved], seconds[moved], *self.before.ids_of(old[old >= 0]))
        if len(learnt):
            words = example[learnt]
            self._keep(kinds[learnt], seconds[learnt], *self._encoded(raw, starts[words], ends[words]))
        places = self.now.find(kinds, seconds)
        if (places < 0).any() or (seconds[which] != second[rest]).any():
            # Two words share a hash: the texts are encoded as they are.
            flat, lengths = self._plain(texts_of(column))
            return flat, split_points(lengths)
        codes[rest] = places[which]
        lengths = self.now.lengths[codes]
        ids = self.now.ids[ragged(self.now.starts[codes], lengths)] if len(codes) else np.zeros(0, np.uint32)
        return ids, split_points(lengths)[at]


_encoders: dict[str, WordEncoder] = worker_cache("words")


def encoder(path: str) -> WordEncoder:
    """The task's encoder of that file, kept from one task to the next."""
    if path not in _encoders:
        fresh_start()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each with one more id behind."""
    return np.insert(ids, at[1:], end), at + np.arange(len(at))
