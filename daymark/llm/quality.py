"""Quality scores by compression: how much better good text's dictionary serves than bad text's.

Two zstandard dictionaries are built from labelled texts.  A text is compressed, part by part,
with either dictionary and with none; the differences of the sizes, over the part's length, are
averaged, and a logistic model trained on other labelled texts turns them into a score.  Beside
the text itself its outline is measured so, where letters, capitals and digits stand for their
kind: it shows tables, capitals and stray signs in any language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, first_texts, texts_of
from .logistic import Logistic

SAMPLE = 4_000  # labelled rows of either class that are learnt from, at most
PART = 2048  # bytes compressed at once
DICTIONARY = 64 << 10
LEVEL = 3
FEATURES = 14

_OUTLINE = bytearray(range(256))
for _kind, _members in ((b"a", range(97, 123)), (b"A", range(65, 91)), (b"0", range(48, 58)), (b"b", range(128, 256))):
    for _byte in _members:
        _OUTLINE[_byte] = _kind[0]
_OUTLINE = bytes(_OUTLINE)


def parts_of(text: bytes) -> list[bytes]:
    """The whole text in like parts of about ``PART`` bytes."""
    count = max(1, round(len(text) / PART))
    cuts = [len(text) * k // count for k in range(count + 1)]
    return [text[low:high] for low, high in zip(cuts[:-1], cuts[1:])]


def trained(texts: list[bytes]) -> bytes:
    """A dictionary from parts of texts; from too few, their plain end."""
    parts = [p for t in texts for p in parts_of(t) if len(p) >= 8]
    try:
        return zstd.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


@dataclass
class QualityModel:
    dictionaries: tuple[bytes, ...]  # good and bad text, good and bad outlines
    logistic: Logistic

    @cached_property
    def _compressors(self):
        made = []
        for data in self.dictionaries:
            # Shorter data is no dictionary, and would not change a size.
            shared = zstd.ZstdCompressionDict(data) if len(data) >= 8 else None
            if shared:
                shared.precompute_compress(level=LEVEL)
            made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False))
        return made, zstd.ZstdCompressor(level=LEVEL, write_content_size=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "logistic": self.logistic}

    def features(self, text: str) -> list[float]:
        whole = text.encode()
        if not whole:
            return [0.0] * FEATURES
        own, plain = self._compressors
        row, weights = [], None
        for kind, data in enumerate((whole, whole.translate(_OUTLINE))):
            parts = parts_of(data)
            length = np.array([len(p) for p in parts], float)
            good, bad, none = (
                np.array([len(c.compress(p)) for p in parts]) / length for c in (own[2 * kind], own[2 * kind + 1], plain)
            )
            weights = length / length.sum()
            gap = bad - good
            row += [gap @ weights, gap.min(), gap.max(), good @ weights, bad @ weights, none @ weights]
        return [*row, float(np.log(len(whole))), 1.0 / len(whole)]

    def scores(self, texts: list[str]) -> np.ndarray:
        rows = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES)
        return self.logistic.chance(_crossed(rows))


def _crossed(rows: np.ndarray) -> np.ndarray:
    """The features, their squares, and their products with the length's."""
    rows = np.clip(rows, -8, 12)
    return np.concatenate([rows, rows**2, rows[:, :12] * rows[:, 12:13]], 1)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """A model from rows ``text, label``; of each class at most ``sample`` distinct texts.

    Half of them, by a hash of the text, make the dictionaries, the others the logistic model,
    which so sees texts that its dictionaries do not know.  Null labels are left out, null text
    is empty.  Without rows of both classes every score is the one label's, or 0.
    """
    rows = labelled.filter("label IN (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), "label")
    texts = [
        [r.text for r in first_texts(rows.filter(F.col("label") == k), sample).orderBy("order").toLocalIterator()]
        for k in (1, 0)
    ]
    blank = Logistic.constant(3 * FEATURES - 2, float(bool(texts[0])))
    if not texts[0] or not texts[1]:
        return QualityModel((b"",) * 4, blank)
    learnt = [[t.encode() for t in own[::2]] for own in texts]
    outlines = [[t.translate(_OUTLINE) for t in own] for own in learnt]
    model = QualityModel(tuple(trained(x) for x in (*learnt, *outlines)), blank)
    rest = [own[1::2] or own for own in texts]
    x = np.array([model.features(t) for own in rest for t in own])
    y = np.repeat([1.0, 0.0], [len(own) for own in rest])
    return QualityModel(model.dictionaries, Logistic.fit(_crossed(x), y))


def _scored(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            scores = model.scores(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of each row; null text counts as empty, other columns are not looked at."""
    return docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, score double")
