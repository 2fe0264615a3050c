"""Two tokenizers aligned over a corpus: which ids of one cover the bytes of which ids of the other.

1. Rows are shuffled by their full text, and each distinct text is kept once with its copies.
2. A task tokenises a block of distinct texts with both tokenizers.  Where tokens of both end at
   one byte, the text is cut into groups; wherever a token of either ends, a link between the two
   tokens that hold the byte before does.  So the links of a text are as many as its cuts.
3. A block counts each pair of ids it holds once, weighted by copies; the counts are summed over
   the corpus.  Each block then asks for the pairs it holds and for no others: no table of all
   pairs is ever in one place, and a pair has no more rows than there are blocks.
4. The measures of a distinct text are joined to all rows that have it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .bytelevel import byte_encoder
from .common import chunks, fresh_start, split_points, texts_of, worker_cache
from .tokens import default_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 2 << 20  # of distinct texts that are aligned together
SPACE = "▁"  # stands for a space in pieces
HOT_SHARE = 1000  # a text is hot if one row in so many has it; there are no more hot ones than that
HOT_ROWS = 1000  # and if so many rows have it, which then share one row of measures


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = byte_encoder(a_path, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_length = self.a.byte_lengths()
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # Ids as text with each sign that may follow: another of the group, the other side, the next group.
        most = max(len(self.a_length), len(self.b_length))
        self.written = [b"%d%c" % (i, sign) for i in range(most) for sign in b",|;"]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text by both; none for texts that either does not give back byte by byte."""
        none = np.zeros(0, np.int64)
        left, right = [], []
        for text, b_ids in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = f" {text}".encode()
            a_ids = np.array(self.a.encode(" " + text) if text else [], np.int64)
            # Byte-level pieces part the bytes and change none.
            same = int(self.a_length[a_ids].sum()) == len(whole)
            same = same and b"".join(map(self.b_bytes.__getitem__, b_ids)) == whole
            left.append(a_ids if same else none)
            right.append(np.array(b_ids, np.int64) if same else none)
        return left, right


_kept: dict[tuple[str, str], Tokenizers] = worker_cache()


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """The worker's tokenizers, kept from one task to the next."""
    if (a_path, b_path) not in _kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        fresh_start()
        _kept[a_path, b_path] = Tokenizers(a_path, b_path)
    return _kept[a_path, b_path]


class Block:
    """The alignment of some texts, one behind the other."""

    def __init__(self, both: Tokenizers, left: list[np.ndarray], right: list[np.ndarray]):
        self.a_at, self.b_at = (split_points(np.array([len(x) for x in side], np.int64)) for side in (left, right))
        empty = [np.zeros(0, np.int64)]
        a, b = np.concatenate(left or empty), np.concatenate(right or empty)
        # Marks at every byte behind a token; both tokenizers' texts have the same bytes.
        ends = [np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b])]
        marks = np.zeros(1 + (int(ends[0][-1]) if len(a) else 0), np.uint8)
        marks[ends[0]] = 1
        marks[ends[1]] |= 2
        cuts = np.flatnonzero(marks)
        is_a, is_b = marks[cuts] & 1 > 0, marks[cuts] & 2 > 0
        shared = is_a & is_b
        # How many tokens of each, and groups, end at a cut or before it.
        a_done, b_done, groups_done = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(shared)
        self.pairs = a[a_done - is_a] << 32 | b[b_done - is_b]
        text_end = np.concatenate([[0], ends[0]])[self.a_at[1:]]
        self.link_at = np.concatenate([[0], np.searchsorted(cuts, text_end, "right")])
        self.groups = np.diff(np.concatenate([[0], groups_done])[self.link_at])
        # All tokens in the order of the groups, the first tokenizer's before the second's.
        before = np.concatenate([[0], b_done[shared]])
        within = a_done[shared]
        self.order = np.empty(len(a) + len(b), np.int64)
        self.order[np.arange(len(a)) + before[(groups_done - shared)[is_a]]] = a * 3 + shared[is_a]
        self.order[np.arange(len(b)) + within[(groups_done - shared)[is_b]]] = b * 3 + 2 * shared[is_b]
        self.written = both.written

    def texts(self) -> Iterator[bytes]:
        """The groups of each text as written: ``a1,a2|b1;a3|b2``; empty without tokens."""
        at = (self.a_at + self.b_at).tolist()
        for low, high in zip(at[:-1], at[1:]):
            yield b"".join(map(self.written.__getitem__, self.order[low:high].tolist()))[:-1]


def _packed(codes: np.ndarray, many: int) -> bytes:
    return codes.astype("<u2" if many <= 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, many: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if many <= 1 << 16 else "<u4")


# One row a block; binary columns hold little-endian numbers, one after the other.
BLOCKS = (
    "digests array<binary>, hashes array<string>, copies array<long>, n_a array<long>, n_b array<long>,"
    " n_groups array<long>, n_links array<long>, codes binary, pairs array<long>, weights array<long>"
)


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for batch in chunks(batches, "text", BLOCK_BYTES):
            left, right = [], []
            for part in chunks([batch], "text", 1 << 19):
                for side, ids in zip((left, right), both.encode(texts_of(part.column("text")))):
                    side += ids
            block = Block(both, left, right)
            hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in block.texts()]
            copies = batch.column("copies").to_numpy(False)
            links = np.diff(block.link_at)
            pairs = np.unique(block.pairs)
            codes = np.searchsorted(pairs, block.pairs)
            weights = np.zeros(len(pairs), np.int64)
            np.add.at(weights, codes, np.repeat(copies, links))
            numbers = [copies, np.diff(block.a_at), np.diff(block.b_at), block.groups, links]
            row = [batch.column("digest").to_pylist(), hashes, *[x.tolist() for x in numbers]]
            row += [_packed(codes, len(pairs)), pairs, weights]
            schema = pa.schema(
                [("digests", pa.list_(pa.binary())), ("hashes", pa.list_(pa.string()))]
                + [(c, pa.list_(pa.int64())) for c in ("copies", "n_a", "n_b", "n_groups", "n_links")]
                + [("codes", pa.binary()), ("pairs", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))]
            )
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    return run


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _measured(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The texts of a block, from its row and the answers to its pairs."""
    row = block.to_pylist()[0]
    many = answers.num_rows
    place = answers.column("place").to_numpy()
    count, best = np.zeros(many, np.int64), np.zeros(many, np.int64)
    count[place], best[place] = answers.column("links").to_numpy(), answers.column("best").to_numpy()
    codes = _unpacked(row["codes"], many)
    at = split_points(np.array(row["n_links"], np.int64))
    of_links = [np.diff(split_points(values[codes])[at]) for values in (best, count)]
    columns = [row["digests"], row["copies"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *of_links, row["hashes"]]
    kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "copies", *MEASURES, "groups_sha256"])


@dataclass(frozen=True)
class Alignment:
    """``pairs``: ``a_id, b_id, links, best``, each pair of ids that a link holds, how many links of
    all rows do, and whether no other pair of the same ``b_id`` has more.

    ``documents``: a row for every row, with its counts of tokens, groups and links, of links
    whose pair is best, the sum of its links' counts, and the sha256 of its groups as text.
    """

    pairs: DataFrame
    documents: DataFrame


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a_path: str | None = None,
    b_path: str | None = None,
) -> Alignment:
    """Aligns a byte-level file of ``tokenizers`` (A) with a ``sentencepiece`` model (B) over all texts.

    A encodes a space and the text, B the text, before which it puts the space itself; strings of
    special tokens are plain text.  A text that is null or empty, or whose bytes either does not
    give back, has no tokens: its counts are 0 and its hash is empty.  Rows that repeat an id or a
    text count each, other columns are not looked at, and an empty table gives empty results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = rows.filter("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.unhex(F.sha2("text", 256))
    distinct = distinct.select(digest.alias("digest"), "text", "copies")
    blocks = distinct.mapInArrow(_aligned(a_path or default_path(A_FILE), b_path or default_path(B_FILE)), BLOCKS)
    blocks = materialised(blocks.withColumn("block", F.monotonically_increasing_id()), "alignment-blocks")

    held = blocks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p")).select("p.pairs", "p.weights")
    pairs = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("weights").alias("links"))
    pairs = materialised(pairs, "alignment-pairs").withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    # One row an id of the second tokenizer.
    top = materialised(pairs.groupBy("b_id").agg(F.max("links").alias("top")), "alignment-top")
    pairs = pairs.join(top, "b_id").withColumn("best", F.col("links") == F.col("top"))

    asked = blocks.select(F.col("block").alias("by"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pairs.select("pair", "links", "best"), "pair")
    answers = answers.select("by", "place", "links", F.col("best").cast("int").alias("best"))
    schema = ", ".join(["digest binary, copies long", *[f"{m} long" for m in MEASURES], "groups_sha256 string"])
    kept = blocks.select("block", "digests", "hashes", "copies", "n_a", "n_b", "n_groups", "n_links", "codes")
    texts = kept.groupBy("block").cogroup(answers.groupBy("by")).applyInArrow(_measured, schema)
    texts = materialised(texts, "alignment-texts")

    # A text that very many rows have gets a row of measures for every thousand of them.
    total = texts.agg(F.sum("copies")).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_SHARE + 1)
    hot = [(r.digest, -(-r.copies // HOT_ROWS)) for r in texts.filter(F.col("copies") >= least).select("digest", "copies").collect()]
    hot = F.broadcast(spark.createDataFrame(hot, "digest binary, parts long"))  # of at most HOT_SHARE rows
    parts = F.coalesce("parts", F.lit(1))
    spread = texts.drop("copies").join(hot, "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(1), parts)))
    slim = rows.select("doc_id", digest.alias("digest")).join(hot, "digest", "left")
    slim = slim.select("doc_id", "digest", (F.pmod(F.xxhash64("doc_id"), parts) + 1).alias("part"))
    found = slim.join(spread.drop("parts"), ["digest", "part"], "left")
    documents = found.select(
        "doc_id",
        *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
    a_id = F.shiftright("pair", 32).cast("int").alias("a_id")
    return Alignment(pairs.select(a_id, "b_id", "links", "best"), documents)
