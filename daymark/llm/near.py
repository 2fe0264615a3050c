"""Near duplicates: an exact Jaccard self-join on word shingles.

Two texts link when ``100 * intersection >= 80 * union`` of their distinct 5-word shingles.

1. Equal shingle sets are one node, named by the smallest id among them.
2. Texts that link share one of the first ``floor(n / 5) + 1`` shingles of either, in any order
   that holds for all texts.  The order here puts shingles that many texts hold last, so a
   passage which thousands of texts quote brings none of them together.
3. Texts that meet under a shingle form a list.  All of a list are first held against the one
   whose shingles are the most common in the corpus, mostly the origin of the copies.  So a
   large group becomes one component without all its pairs.
4. What is left in a list unconnected is joined by an R-tree over count vectors: a text's
   shingles are hashed into groups, the counts per group are its point, and the minima of two
   points (or of a point and a box's upper corner) sum to an upper bound of the overlap.
5. Pairs that the bound lets pass are verified on their whole shingle sets.

Nothing is capped: a list of any size is joined, in blocks of ``BLOCK`` members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import NULL_ID, Job, chunks, ragged, trimmed
from .shingles import shingle_sets

COMMON = 16_000_000  # at most so many shingles count as common; their list, 12 bytes each, goes to every task
OFTEN = 8  # a shingle in fewer texts is not common
GROUPS = 256  # coordinates of a count vector
LEAF = 16  # points in a leaf of the R-tree, and boxes in a node
BLOCK = 2048  # members of a list that meet in one task
SLICE = 1 << 19  # bytes of text, or of sets, a task works on at once
TALLY = 4 << 20  # shingles tallied at once
PAIRS = 4096  # pairs of points held against each other at once


def lean(job: Job) -> Job:
    """A job of this module, begun without what other operators kept in its worker."""
    return trimmed(job, "shingles")


def needed(a, b):
    """The least overlap of linked sets of these sizes: 100 i >= 80 (a + b - i)."""
    return (80 * (a + b) + 179) // 180


# ---- how common each shingle is


def _tallies(ranges: int):
    """Per task and range of the hash space: the high halves of the shingle hashes and their counts."""

    def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
        items = np.concatenate(parts)
        parts.clear()
        items.sort()
        first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])).astype(np.uint32)
        items, n = items[first], np.diff(first, append=np.uint32(len(items)))
        at = np.searchsorted(items, (np.arange(1, ranges) << 32) // ranges)
        columns = zip(range(ranges), np.split(items, at), np.split(n, at))
        some = [(r, i.astype("<u4").tobytes(), c.astype("<u4").tobytes()) for r, i, c in columns if len(i)]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*some), (pa.int32(), pa.binary(), pa.binary()))],
            ["part", "items", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in chunks(batches, "text", SLICE):
            hashes, _ = shingle_sets(batch.column("text"))
            if len(hashes):
                parts.append((hashes >> np.uint64(32)).astype(np.uint32))
                size += len(hashes)
            if size > TALLY:
                yield rows(parts)
                size = 0
        if parts:
            yield rows(parts)

    return lean(run)


def _summed(least: int):
    """Adds up the tallies of each range; the row of item -1 holds the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, items, counts in zip(*(c.to_pylist() for c in batch.columns)):
                mine = held.setdefault(part, ([], []))
                mine[0].append(np.frombuffer(items, "<u4"))
                mine[1].append(np.frombuffer(counts, "<u4"))
        total = 0
        for parts, counts in held.values():
            items, n = _added(np.concatenate(parts), np.concatenate(counts))
            total += int(n.sum())
            often = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(items[often].astype(np.int64)), pa.array(n[often])], ["item", "count"]
            )
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.int64())], ["item", "count"])

    return lean(run)


def _added(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(items, kind="stable")
    items, counts = items[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
    return items[first], np.add.reduceat(counts, first)


def common_shingles(texts: DataFrame, most: int = COMMON, least: int = OFTEN) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that the most texts hold, by the high half of their hash, and how many do.

    Counts cover all texts.  With ``total`` shingles, at most ``most`` can be in
    ``total / most`` texts or more, which bounds what reaches the driver.
    """
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tallies = texts.select("text").mapInArrow(_tallies(4 * width), "part int, items binary, counts binary")
    counts = tallies.repartition(width, "part").mapInArrow(_summed(least), "item long, count long")
    counts = materialised(counts, "near-counts")
    total = counts.filter("item = -1").agg(F.sum("count")).first()[0] or 0
    bar = max(least, -(-total // most))
    rows = counts.filter((F.col("item") >= 0) & (F.col("count") >= bar)).orderBy("item").toPandas()
    return rows["item"].to_numpy(np.uint32), rows["count"].to_numpy(np.int64)


# ---- one row per text


SIGNATURE = "doc_id long, n long, digest binary, weight double, prefix binary, point binary"


def _signatures(items: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE):
            hashes, at = shingle_sets(batch.column("text"))
            high = (hashes >> np.uint64(32)).astype(np.uint32)
            rank = np.zeros(len(hashes), np.int64)
            if len(items):
                place = np.minimum(np.searchsorted(items, high), len(items) - 1)
                rank = np.where(items[place] == high, counts[place], 0)
            sizes = np.diff(at)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            group = (hashes % np.uint64(GROUPS)).astype(np.int64)
            points = np.bincount(owner * GROUPS + group, minlength=len(sizes) * GROUPS).astype("<u4")
            points = points.reshape(len(sizes), GROUPS)
            out = [[], [], [], []]
            for i, (low, high_) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own, common = hashes[low:high_], rank[low:high_]
                first = own[: len(own) // 5 + 1]
                if common.any():
                    first = own[np.lexsort((own, common))[: len(own) // 5 + 1]]
                out[0].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                out[1].append(float(common.mean()) if len(own) else 0.0)
                out[2].append(first.astype("<u8").tobytes())
                out[3].append(points[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(out[0], pa.binary())]
                + [pa.array(out[1], pa.float64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                ["doc_id", "n", "digest", "weight", "prefix", "point"],
            )

    return lean(run)


@lean
def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.frombuffer(x, "<i8") for x in batch.column("prefix").to_pylist()]
        times = np.array([len(k) for k in keys])
        rows = pa.array(np.repeat(np.arange(len(keys)), times))
        if len(rows):
            taken = [batch.column(k).take(rows) for k in ("weight", "node")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *taken], ["key", "weight", "node"])


@lean
def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, the heaviest of each first: give each other row its key's first."""
    key, pivot = None, None
    for batch in batches:
        keys, nodes = batch.column("key").to_numpy(False), batch.column("node").to_numpy(False)
        if not len(keys):
            continue
        new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        first = np.where(begin >= 0, nodes[begin], 0 if pivot is None else pivot)
        key, pivot = keys[-1], first[-1]
        rest = ~new & (first != nodes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[rest]), pa.array(first[rest]), pa.array(nodes[rest])], ["key", "a", "b"]
        )


# ---- the R-tree


def overlap_bound(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bound for each pair of a row ``i`` of ``a`` and a row ``j`` of ``b``, ``PAIRS`` at a time."""
    bound = np.zeros(len(i), np.int64)
    for low in range(0, len(i), PAIRS):
        part = slice(low, low + PAIRS)
        bound[part] = np.minimum(a[i[part]], b[j[part]]).sum(-1, dtype=np.int64)
    return bound


def tree_pairs(points: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Pairs ``(i, j), i < j``, of unlike ``others`` whose points allow a link.

    Points are packed into an R-tree by size and then by their fullest coordinates.  Of a box
    only the upper corner and the least size matter: they bound the overlap from above and
    the overlap needed from below.
    """
    order = np.lexsort((points.argmax(1), sizes))
    levels = [(points[order], sizes[order], sizes[order])]
    while len(levels[-1][0]) > LEAF:
        top, least, most = levels[-1]
        cuts = np.arange(0, len(top), LEAF)
        levels.append(
            (np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts))
        )
    found = []
    for low in range(0, len(order), 512):
        asked = order[low : low + 512]
        query = np.repeat(np.arange(len(asked)), len(levels[-1][0]))
        box = np.tile(np.arange(len(levels[-1][0])), len(asked))
        for depth in range(len(levels) - 1, -1, -1):
            top, least, most = levels[depth]
            passed = []
            for part in np.array_split(np.arange(len(query)), len(query) // 65536 + 1):
                n = sizes[asked[query[part]]]
                # Sizes first: the smaller of linked sets has at least 4/5 of the larger.
                ok = (4 * least[box[part]] <= 5 * n) & (5 * most[box[part]] >= 4 * n)
                part, n = part[ok], n[ok]
                bound = overlap_bound(points, asked[query[part]], top, box[part])
                passed.append(part[bound >= needed(n, np.maximum(least[box[part]], -(-4 * n // 5)))])
            keep = np.concatenate(passed)
            query, box = query[keep], box[keep]
            if depth:
                times = np.minimum(LEAF, len(levels[depth - 1][0]) - box * LEAF)
                query, box = np.repeat(query, times), ragged(box * LEAF, times)
        i, j = asked[query], order[box]
        unlike = (others[i] != others[j]) & (i != j)
        i, j = np.minimum(i, j)[unlike], np.maximum(i, j)[unlike]
        ok = overlap_bound(points, i, points, j) >= needed(sizes[i], sizes[j])
        found.append(np.stack([i[ok], j[ok]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _points(column: pa.Array) -> np.ndarray:
    """The count vectors of a column without nulls, as they lie in its buffer."""
    if not len(column):
        return np.zeros((0, GROUPS), np.uint32)
    column = column.cast(pa.large_binary())
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], "<u4", len(column) * GROUPS, int(begin)).reshape(-1, GROUPS)


def _joined(rows: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
    """The pairs within each run of rows between two cuts; runs of one leaf are done together."""
    points = _points(rows.column("point"))
    node, component, n = (rows.column(k).to_numpy(False) for k in ("node", "component", "n"))
    lengths = np.diff(cuts)
    small = np.repeat(lengths <= LEAF, lengths)
    begin = np.repeat(cuts[:-1], lengths)
    before = np.where(small, np.arange(len(n)) - begin, 0)
    i, j = ragged(begin, before), np.repeat(np.arange(len(n)), before)
    fits = (component[i] != component[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
    i, j = i[fits], j[fits]
    ok = overlap_bound(points, i, points, j) >= needed(n[i], n[j])
    found = [np.stack([i[ok], j[ok]], 1)]
    for low, high in zip(cuts[:-1][lengths > LEAF], cuts[1:][lengths > LEAF]):
        found.append(low + tree_pairs(points[low:high], n[low:high], component[low:high]))
    pairs = np.concatenate(found)
    a, b = node[pairs[:, 0]], node[pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


@lean
def _tree_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by list and pair of blocks; a list's block pair is joined as a whole."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(k).to_numpy(False) for k in ("key", "i", "j"))
        new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1])
        if cuts[-1]:
            yield _joined(batch.slice(0, cuts[-1]), cuts)
        held = batch.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield _joined(held, np.array([0, held.num_rows]))


# ---- verification and components


@lean
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "set_a", SLICE):
        sets = [[np.frombuffer(x, "<u8") for x in batch.column(k).to_pylist()] for k in ("set_a", "set_b")]
        linked = []
        for x, y in zip(*sets):
            both = np.concatenate([x, y])
            both.sort()
            linked.append(int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y)))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in ("a", "b")], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole shingle sets link; sets are made for texts in a pair only."""
    pairs = materialised(pairs, "near-pairs")
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    paired = materialised(paired, "near-paired")
    whole = texts.withColumnRenamed("doc_id", "node").join(paired, "node")
    sets = materialised(whole.mapInArrow(_shingle_rows, "node long, shingles binary"), "near-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    links = pairs.join(left, "a").join(right, "b").mapInArrow(_verified, "a long, b long").distinct()
    return materialised(links, "near-links")


@lean
def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", SLICE):
        hashes, at = shingle_sets(batch.column("text"))
        sets = [hashes[low:high].astype("<u8").tobytes() for low, high in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    Each round takes the smallest label among a node's own, its neighbours', and its label's.
    """
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialised(edges, "near-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = labels.select("node", F.least("node", "low").alias("component"))
    labels = materialised(labels, "near-labels")
    while True:
        near = labels.select(F.col("node").alias("b"), "component")
        heard = edges.join(near, "b").groupBy("a").agg(F.min("component").alias("heard"))
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = (
            labels.join(heard, F.col("node") == F.col("a"))
            .join(above, "component", "left")
            .select(
                "node",
                F.least("component", "heard", F.coalesce("above", "component")).alias("component"),
                F.col("component").alias("before"),
            )
        )
        new = materialised(new, "near-labels")
        labels = new.select("node", "component")
        if new.filter("component < before").isEmpty():
            return labels


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    The component is the smallest id that links reach, the row itself included.  A text without
    words, or null, links with nothing, not even with another such text.  Rows of one id stand
    or fall together: what links to one of their texts links to the id.  A null id counts as
    smaller than any other.  Other columns are not looked at.
    """
    ids = F.coalesce(F.col(id_col), F.lit(NULL_ID))
    texts = docs.select(ids.alias("doc_id"), F.col(text_col).alias("text"))
    items, counts = common_shingles(texts)
    rows = materialised(texts.mapInArrow(_signatures(items, counts), SIGNATURE), "near-signatures")

    named = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"))
    named = materialised(named, "near-nodes")
    # Rows that repeat an id and a text come twice here; a text is never paired with itself.
    nodes = rows.select("doc_id", "digest", F.col("weight").cast("float").alias("weight"), "prefix")
    nodes = nodes.join(named, "digest").filter("doc_id = node").select("prefix", "weight", "node")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = nodes.mapInArrow(_prefix_rows, "key long, weight float, node long")
    by_key = keys.repartition(width, "key").sortWithinPartitions("key", F.desc("weight"), "node")
    lists = materialised(by_key.mapInArrow(_lists, "key long, a long, b long"), "near-lists")

    met = lists.select(F.col("a").alias("node")).union(lists.select(F.col("b").alias("node"))).distinct()
    sizes = rows.select(F.col("doc_id").alias("node"), "n", "point").join(met, "node")
    sizes = materialised(sizes.dropDuplicates(["node", "point"]), "near-points")

    star = lists.select("a", "b").distinct()
    star = star.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "point"), "a")
    star = star.withColumnRenamed("point", "point_a").join(sizes.toDF("b", "n_b", "point_b"), "b")
    star = star.filter("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    links = verified(star.mapInArrow(_within_bound, "a long, b long").distinct(), texts)
    found = components(links)

    # What a list still holds unconnected.  Its first has been held against all the others.
    members = lists.select("key", F.col("b").alias("node")).distinct().join(found, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    members = materialised(members, "near-members")
    open_lists = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("sign"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("sign_2"),
    )
    # Lists of the same members, as the shingles of one passage have them, are joined once.
    open_lists = open_lists.filter("low < high").groupBy("size", "sign", "sign_2").agg(F.min("key").alias("key"))
    open_lists = open_lists.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    spread = members.join(open_lists, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component"
    ).join(sizes, "node")
    spread = spread.select("key", "i", "j", "node", "component", "n", "point")
    spread = spread.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = verified(spread.mapInArrow(_tree_join, "a long, b long").distinct(), texts)
    if not more.isEmpty():
        found = components(links.unionByName(more))

    # Copies and rows of one id take their node's component; ids that belong to several nodes join those.
    label = named.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    labelled = rows.select("doc_id", "n", "digest").join(label, "digest", "left")
    labelled = materialised(labelled.withColumn("component", F.coalesce("component", "doc_id")), "near-labelled")
    several = labelled.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    if not several.filter("a < b").isEmpty():
        ties = labelled.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).distinct()
        labelled = labelled.drop("component").join(
            components(ties).select(F.col("node").alias("doc_id"), "component"), "doc_id"
        )
    real = F.when(F.col("component") != NULL_ID, F.col("component"))
    return labelled.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real.alias("component_id"),
    )


@lean
def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.arange(batch.num_rows)
        need = needed(*(batch.column(k).to_numpy(False) for k in ("n_a", "n_b")))
        bound = overlap_bound(_points(batch.column("point_a")), rows, _points(batch.column("point_b")), rows)
        keep = pa.array(bound >= need)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in ("a", "b")], ["a", "b"])


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its component.

    Rows of one id stay together.
    """
    stay = near_components(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay"]), "left_semi")
