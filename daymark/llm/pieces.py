"""SentencePiece encoding by Viterbi over many words at once, and decoding.

A piece file gives pieces and their scores.  The encoding of a text is the sequence of pieces
with the greatest sum of scores; of equal sums the one whose last piece is longer wins, at the
end of every prefix.  A letter that no piece
of one letter covers becomes the pieces of its UTF-8 bytes.

No piece goes on behind a space once it has another letter, and none has a line break, so a
text falls into words that are encoded apart.  Distinct words of one length advance together:
hashes of all their substrings are looked up among the sorted hashes of the pieces, and the
greatest sums and the piece lengths that lead there are arrays over the words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, crc_of, fresh_start, ragged, split_points, texts_of, worker_cache
from .tokens import default_path

SPACE = "▁"
WORD = re.compile(r"\n| *[^ \n]+| +")
_BASE = 0x9E3779B97F4A7C15
WORDS = 400_000


class Pieces:
    """The pieces of a model file, sorted by hash, and their bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = np.arange(model.get_piece_size())
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in ids.tolist()]
        texts = [model.id_to_piece(i) for i in ids.tolist()]
        used = ids[plain]
        scores = np.array([model.get_score(i) for i in used.tolist()])
        keys = np.array([self._key(texts[i].replace(SPACE, " ")) for i in used.tolist()], np.uint64)
        order = np.argsort(keys)
        self.keys, self.scores, self.ids = keys[order], scores[order], used[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.longest = max(len(texts[i]) for i in used.tolist())
        self.unknown = float(scores.min()) - 10
        self.of_byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        spelt = [t.replace(SPACE, " ").encode() if p else b"" for t, p in zip(texts, plain)]
        for b, i in enumerate(self.of_byte.tolist()):
            spelt[i] = bytes([b])
        self.lengths = np.array([len(s) for s in spelt])
        self.starts = split_points(self.lengths)[:-1]
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)

    @staticmethod
    def _key(text: str) -> int:
        key = 0
        for letter in text:
            key = (key * _BASE + ord(letter) + 1) % (1 << 64)
        return key

    def best(self, words: list[str]) -> list[list[int]]:
        """The ids of words of one length: the greatest sum of scores."""
        n, count = len(words[0]), len(words)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(count, n).astype(np.uint64) + np.uint64(1)
        reach = min(self.longest, n)
        # scores[l - 1][:, i]: of the substring of length l that starts at i.
        hashes = np.zeros((count, n), np.uint64)
        scores, found = [], []
        for size in range(1, reach + 1):
            width = n - size + 1
            hashes = hashes[:, :width] * np.uint64(_BASE) + letters[:, size - 1 :]
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            scores.append(np.where(known, self.scores[at], self.unknown if size == 1 else -np.inf))
            found.append(np.where(known, self.ids[at], -1).astype(np.int32))
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, count), np.int32)
        for end in range(1, n + 1):
            sizes = range(min(reach, end), 0, -1)  # the longest first, for ties
            sums = np.stack([best[end - s] + scores[s - 1][:, end - s] for s in sizes])
            choice = sums.argmax(0)
            best[end] = sums[choice, np.arange(count)]
            back[end] = len(sizes) - choice
        result = []
        for i, word in enumerate(words):
            ids, end = [], n
            while end:
                size = int(back[end, i])
                piece = int(found[size - 1][i, end - size])
                ids.append([piece] if piece >= 0 else self.of_byte[list(word[end - 1].encode())].tolist())
                end -= size
            result.append([x for part in reversed(ids) for x in part])
        return result

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts of ids; the space put before each text goes."""
        data = self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()
        ends = split_points(self.lengths[ids])[at]
        return [data[low:high].removeprefix(b" ") for low, high in zip(ends[:-1].tolist(), ends[1:].tolist())]


class PieceEncoder:
    """Encodes texts by a piece file, each distinct word once; up to ``WORDS`` of them are kept."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)

    def _store(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        have, known = self.used, len(self.place)
        while len(self.ids) < have + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < known + len(words):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[have : have + len(flat)] = flat
        self.starts[known : known + len(words)] = have + split_points(lengths)[:-1]
        self.lengths[known : known + len(words)] = lengths
        self.place.update(zip(words, range(known, known + len(words))))
        self.used = have + len(flat)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start (one more entry than texts); null is empty."""
        if len(self.place) > WORDS:
            self._forget()
        split = self.words_of(pc.fill_null(column, ""))
        words = [w for s in split for w in s]
        new = set(words).difference(self.place)
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[codes]
        ids = self.ids[ragged(self.starts[codes], lengths)] if len(codes) else np.zeros(0, np.uint32)
        at = split_points(lengths)[split_points(np.array([len(s) for s in split], np.int64))]
        return ids, at

    def words_of(self, column: pa.Array) -> list[list]:
        return [WORD.findall(" " + t.replace(SPACE, " ")) if t else [] for t in column.to_pylist()]

    def _learn(self, new: set[str]) -> None:
        lengths: dict[int, list[str]] = {}
        for word in new:
            lengths.setdefault(len(word), []).append(word)
        for size, words in lengths.items():
            step = max(1, (1 << 20) // (size * min(size, self.pieces.longest)))
            for low in range(0, len(words), step):
                found = self.pieces.best(words[low : low + step])
                counts = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.array([i for x in found for i in x], np.uint32)
                self._store(words[low : low + step], flat, counts)


_encoders: dict[str, PieceEncoder] = worker_cache()


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        fresh_start()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


RESULT = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in chunks(batches, "text"):
            texts = texts_of(batch.column("text"))
            ids, at = words.encode(batch.column("text"))
            back = words.pieces.decode(ids, at)
            same = [b == t.encode() for b, t in zip(back, texts)]
            crc = [crc_of(ids[low:high]) for low, high in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(at), pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return run


def _with_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in chunks(batches, "text"):
            ids, at = words.encode(batch.column("text"))
            cells = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), cells], ["doc_id", "ids"])

    return run


def _to_text(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            at = split_points(np.array([len(x) for x in lists], np.int64))
            texts = pieces.decode(np.array([i for x in lists for i in x], np.int64), at)
            decoded = pa.array([t.decode(errors="replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decoded], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of each row; null text counts as empty and has no ids."""
    job = _with_ids(path or default_path("piece_bpe_32k.model"))
    return docs.select("doc_id", "text").mapInArrow(job, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids are none, broken UTF-8 is replaced."""
    job = _to_text(path or default_path("piece_bpe_32k.model"))
    return ids.select("doc_id", "ids").mapInArrow(job, "doc_id long, text string")


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each row's text encoded and decoded: numbers of ids, their crc32, and whether it came back.

    A text with the sign ``▁`` of the piece file does not, as that sign means a space there.
    """
    return docs.select("doc_id", "text").mapInArrow(_coded(path or default_path("piece_bpe_32k.model")), RESULT)
