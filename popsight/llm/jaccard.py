"""N-gram Jaccard self-join with signature trees, exact at any threshold.

1. An Arrow pass turns every text into its set of word shingles (64-bit
   hashes) and writes the set's size, its 128-bit hash, a token bitmap and its
   prefix: the n - ceil(t n) + 1 first shingles in a global order. Sets at a
   similarity of t or more share a shingle of their prefixes. The order puts
   frequent shingles last: a first pass counts prefix shingles in plain hash order,
   those above a bound (at most MAX_FREQUENT of them) are moved back in the second.
2. Documents with equal sets are one class; its smallest doc_id stands for it.
3. The classes that share a prefix shingle and have sizes that can link go to
   the block of the smallest of them. Shingles of one group of copies lead to the same block, so a class is
   sent to few blocks, and every similar pair meets in one.
4. Blocks get bitmaps and sizes only, sorted by size into a signature tree:
   leaves of LEAF sets, inner nodes of FANOUT children, each with its size range, the
   OR-combined token bitmap of its sets and their common bits. A dual
   traversal drops pairs of nodes whose maximum possible overlap can't reach
   the threshold, and pairs whose members are connected already. Classes that may
   link form groups; only these get their whole sets, are traversed again
   with wider bitmaps and compared exactly, on integers. Blocks and groups
   beyond a size are cut into chunks and all pairs of chunks.
5. Links, at most one less than the sets of a tile, become components.

Losing an executor costs the tasks it ran: every step reads Parquet in the
shared folder or a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lean, q, ship, stored, table, whole_row
from .components import connected_components

MAX_FREQUENT = 100_000       # shingles moved to the end of the order; bounds what tasks get sent
LEAST_FREQUENT = 16          # shingles in no more prefixes than this stay where they are
TILE_SETS = 4_096            # bitmaps of a chunk
TILE_TOKENS = 2_000_000      # shingles of a chunk (8 bytes each)
BROADCAST_REPS = 100_000     # classes in blocks up to which their ids are broadcast
LEAF, FANOUT = 16, 4


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles, A-Z lower-cased; with
    fewer words the whole sequence is one shingle, without words there is none."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        if not words:
            return np.empty(0, np.uint64)
        return np.array([xxh3_64_intdigest(b"\x00" + b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    x = np.zeros(n, np.uint64)
    for k in range(width):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that what a task holds besides the texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit h mod ``bits`` for every hash (bits: a power of two)."""
    row = np.zeros(bits, bool)
    row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(row).view(np.uint64)


def narrowed(row: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    while 64 * len(row) > bits:
        half = len(row) // 2
        row = row[:half] | row[half:]
    return row


def bits_for(n: int, factor: int) -> int:
    return max(256, 1 << (factor * n - 1).bit_length())


def _prefixes(width: int, percent: int):
    """Texts -> prefix shingles in hash order, to count them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [np.empty(0, np.uint64)]
            for text in batch.column(0):
                s = shingles(text.as_py() or "", width)
                got.append(s[:prefix_size(len(s), percent)].copy())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["x"])
    return lean(run)


def _sets(width: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in sliced(batches):
            ids, texts = batch.columns
            size, key, maps, flat, ends = [], [], [], [], [0]
            for text in texts:
                s = shingles(text.as_py() or "", width)
                size.append(len(s))
                key.append(xxh3_128_digest(s.tobytes()))
                maps.append(bitmap(s, bits_for(len(s), 1)).tobytes() if len(s) else b"")
                if len(frequent) and len(s):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                flat.append(s[:prefix_size(len(s), percent)].copy())
                ends.append(ends[-1] + len(flat[-1]))
            values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(maps, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                ["doc_id", "n", "key", "map", "prefix"])
    return lean(run)


def _bytes_of_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(x.as_py() or "", width) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["rep", "block", "chunks", "n", "bytes"])
    return lean(run)


class Tree:
    """Signature tree over sets in order of size: their sizes and bitmaps (of one width)."""

    def __init__(self, size: np.ndarray, maps: np.ndarray):
        self.size, self.maps = size, maps
        level = [self._node(range(a, min(a + LEAF, len(size))), ()) for a in range(0, len(size), LEAF)]
        while len(level) > 1:
            level = [self._join(level[a:a + FANOUT]) for a in range(0, len(level), FANOUT)]
        self.root = level[0]

    def _node(self, span: range, children: tuple) -> tuple:
        part = self.maps[span.start:span.stop]
        return (span, children, int(self.size[span.start]), int(self.size[span.stop - 1]),
                np.bitwise_or.reduce(part), np.bitwise_and.reduce(part))

    def _join(self, nodes: list[tuple]) -> tuple:
        if len(nodes) == 1:
            return nodes[0]
        return (range(nodes[0][0].start, nodes[-1][0].stop), tuple(nodes), nodes[0][2], nodes[-1][3],
                np.bitwise_or.reduce([x[4] for x in nodes]), np.bitwise_and.reduce([x[5] for x in nodes]))


def can_link(x: tuple, y: tuple, percent: int) -> bool:
    """Whether any set below x can overlap enough with any below y. Bits that all sets of
    one node have and none of the other's are shingles outside every overlap."""
    if x[3] * 100 < y[2] * percent or y[3] * 100 < x[2] * percent:
        return False
    apart = int(np.bitwise_count(x[5] & ~y[4]).sum()) + int(np.bitwise_count(y[5] & ~x[4]).sum())
    # overlap = (|a| + |b| - apart) / 2 must be at least percent / (100 + percent) * (|a| + |b|)
    return apart * (100 + percent) <= (100 - percent) * (x[3] + y[3])


def traverse(tree: Tree, other: Tree | None, percent: int,
             check: Callable[[int, int], bool]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, group of each set): dual traversal of one tree with itself, or of two with
    each other (the second's sets are numbered on). Pairs that the bitmaps leave are
    checked; those whose members earlier links connect already are not."""
    same_tree = other is None
    other, shift = (tree, 0) if same_tree else (other, len(tree.size))
    group = np.arange(len(tree.size) if same_tree else shift + len(other.size))
    links: list[tuple[int, int]] = []
    todo = [(tree.root, other.root)]
    while todo:
        x, y = todo.pop()
        xs, ys = x[0], y[0]
        gx, gy = group[xs.start:xs.stop], group[shift + ys.start:shift + ys.stop]
        if (gx == gx[0]).all() and (gy == gx[0]).all():
            continue
        same = same_tree and xs == ys
        if not same and not can_link(x, y, percent):
            continue
        if x[1] or y[1]:
            if same:
                kids = x[1]
                todo += [(kids[a], kids[b]) for a in range(len(kids)) for b in range(a, len(kids))]
            elif x[1] and (not y[1] or len(xs) >= len(ys)):
                todo += [(k, y) for k in x[1]]
            else:
                todo += [(x, k) for k in y[1]]
            continue
        apart = np.bitwise_count(tree.maps[xs.start:xs.stop, None] ^ other.maps[None, ys.start:ys.stop]).sum(2, dtype=np.int64)
        sa, sb = tree.size[xs.start:xs.stop, None], other.size[None, ys.start:ys.stop]
        may = (apart * (100 + percent) <= (100 - percent) * (sa + sb)) & (gx[:, None] != gy[None])
        may &= (sa * 100 >= sb * percent) & (sb * 100 >= sa * percent)
        if same:
            may = np.triu(may, 1)
        for a, b in np.argwhere(may).tolist():
            i, j = xs.start + a, shift + ys.start + b
            if group[i] != group[j] and check(i, j):
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links, group


def set_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links (i, j), indices into ``left`` then ``right``, that connect all similar pairs of
    ``left``, or all between ``left`` and ``right``."""
    if not left or right is not None and not right:
        return []
    bits = min(bits_for(max(len(s) for s in left + (right or [])), 8), 1 << 16)

    def planted(sets: list[np.ndarray]) -> tuple[list[int], Tree]:
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        return order, Tree(np.array([len(sets[i]) for i in order], np.int64), np.array([bitmap(sets[i], bits) for i in order]))

    names, tree = planted(left)
    sets, other = [left[i] for i in names], None
    if right is not None:
        more, other = planted(right)
        sets += [right[i] for i in more]
        names = names + [len(left) + i for i in more]

    def check(i: int, j: int) -> bool:
        s, t = sets[i], sets[j]
        both = len(np.intersect1d(s, t, assume_unique=True))
        return 100 * both >= percent * (len(s) + len(t) - both)

    return [(names[i], names[j]) for i, j in traverse(tree, other, percent, check)[0]]


def map_groups(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None,
               percent: int) -> list[int]:
    """Group number of each (size, bitmap) of ``left`` then ``right``: what may link is in one group.

    Bitmaps are as wide as their sets are large. Sets that can link differ little in size, so
    each width meets itself and the few widths above it, narrowed to it: a small set in a
    block doesn't blur the large ones."""
    sets = left + (right or [])
    group = list(range(len(sets)))

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def by_width(numbers: range) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i in sorted(numbers, key=lambda i: sets[i][0]):
            out.setdefault(64 * len(sets[i][1]), []).append(i)
        return out

    def meet(a: list[int], b: list[int] | None, bits: int) -> None:
        if not a or b is not None and not b:
            return
        trees = [Tree(np.array([sets[i][0] for i in x], np.int64), np.array([narrowed(sets[i][1], bits) for i in x]))
                 for x in ((a,) if b is None else (a, b))]
        names = a + (b or [])
        for i, j in traverse(trees[0], trees[1] if b is not None else None, percent, lambda i, j: True)[0]:
            group[find(names[i])] = find(names[j])

    most = 2
    while most * percent < 100:
        most *= 2
    mine = by_width(range(len(left)))
    theirs = mine if right is None else by_width(range(len(left), len(sets)))
    for w, a in mine.items():
        for v, b in theirs.items():
            if right is None and v < w or v > w * most or w > v * most:
                continue
            meet(a, None if right is None and v == w else b, min(v, w))
    return [find(i) for i in range(len(sets))]


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple[list, list], tuple[list, list]]]:
    """Rows (block, i, j, side, rep, size or null, bytes) sorted by (block, i, j): one tile at a time as
    (whether it is of one chunk, reps of both sides, their sizes and values)."""
    here, reps, values = None, ([], []), ([], [])
    for batch in batches:
        tiles = zip(*(c.to_pylist() for c in batch.columns[:6]))
        for (block, i, j, side, rep, n), raw in zip(tiles, batch.column(6)):
            if (block, i, j) != here:
                if here is not None:
                    yield here[1] == here[2], reps, values
                here, reps, values = (block, i, j), ([], []), ([], [])
            reps[side].append(rep)
            values[side].append((n, np.frombuffer(raw.as_py(), np.uint64)))
    if here is not None:
        yield here[1] == here[2], reps, values


def _pairs(found: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)


def _group(percent: int) -> Callable:
    """Tiles of bitmaps -> (group, rep) of classes that may link; a group is named by its smallest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for one, reps, maps in by_tile(batches):
            names = reps[0] + reps[1]
            members: dict[int, list[int]] = {}
            for name, g in zip(names, map_groups(maps[0], None if one else maps[1], percent)):
                members.setdefault(g, []).append(name)
            for group in members.values():
                if len(group) > 1:
                    first = min(group)
                    found += [(first, rep) for rep in group]
            if len(found) > 10_000:
                yield _pairs(found, ["block", "rep"])
                found = []
        if found:
            yield _pairs(found, ["block", "rep"])
    return lean(run)


def _link(percent: int) -> Callable:
    """Tiles of whole sets -> links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for one, reps, sets in by_tile(batches):
            names = reps[0] + reps[1]
            left, right = [x[1] for x in sets[0]], None if one else [x[1] for x in sets[1]]
            found += [(names[i], names[j]) for i, j in set_links(left, right, percent)]
            if len(found) > 10_000:
                yield _pairs(found, ["a", "b"])
                found = []
        if found:
            yield _pairs(found, ["a", "b"])
    return lean(run)


def _tiles(members: DataFrame) -> DataFrame:
    """Members (block, chunks, rep, n, bytes) dealt to tiles: one per pair of chunks of a block."""
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    return (members.withColumn("c", chunk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("block", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"),
                    (F.col("c") > F.col("o")).cast("int").alias("side"), "rep", "n", "bytes")
            .repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side", "rep"))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                       percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their shingle
    sets; component_id is the smallest doc_id reachable. Texts without words
    (null, empty, blank) link with nothing. Rows that share a doc_id are one
    document. A row without doc_id links with nothing and has a null
    component_id. An empty table gives an empty result."""
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be in 1..100, width at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(q(doc_id)).cast("long").alias("doc_id"), F.col(q(text)).cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(_prefixes(width, percent), "x bigint").groupBy("x").agg(
        F.count(F.lit(1)).alias("c")).filter(F.col("c") > LEAST_FREQUENT)
    counts = stored(counts, "frequent")
    bound = max(LEAST_FREQUENT, -(-(counts.agg(F.sum("c")).first()[0] or 0) // MAX_FREQUENT))
    frequent = [r[0] for r in counts.filter(F.col("c") > bound).select("x").collect()]    # at most MAX_FREQUENT
    late = np.sort(np.array(frequent, np.int64).view(np.uint64))
    sets = stored(rows.mapInArrow(_sets(width, percent, late),
                                  "doc_id bigint, n bigint, key binary, map binary, prefix array<bigint>"), "shingle-sets")
    known = sets.filter("n > 0 and doc_id is not null")
    smallest = known.groupBy("key").agg(F.min("doc_id").alias("rep"))
    # the prefix and bitmap of the smallest doc_id's row; equal keys have equal ones
    reps = known.join(smallest.withColumnRenamed("rep", "doc_id"), ["key", "doc_id"], "left_semi").select(
        F.col("doc_id").alias("rep"), "n", "map", "prefix")

    tokens = reps.select("rep", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("x"))
    late = F.broadcast(spark.createDataFrame([(x,) for x in frequent], "x bigint"))       # at most MAX_FREQUENT
    # the classes of a shingle in order of size fall into islands; no two islands hold sizes that can link
    by_size = Window.partitionBy("x").orderBy("n")
    gap = F.coalesce((F.lag("n").over(by_size) * 100 < F.col("n") * percent).cast("int"), F.lit(0))
    island = Window.partitionBy("x", "island")
    rare = (tokens.join(late, "x", "left_anti").withColumn("gap", gap).withColumn("island", F.sum("gap").over(by_size))
            .select("rep", F.min("rep").over(island).alias("block"), F.max("rep").over(island).alias("z"))
            .filter("block < z").drop("z"))
    # frequent shingles: levels of size instead, each class in its own and the next; sizes that can link share one
    step = -math.log(percent / 100) + 1e-9
    level = F.floor(F.log(F.col("n").cast("double")) / step).cast("bigint")
    common = tokens.join(late, "x").select("rep", "x", F.explode(F.array(level, level + 1)).alias("level"))
    tops = common.groupBy("x", "level").agg(F.min("rep").alias("block"))
    common = common.join(tops, ["x", "level"]).select("rep", "block")
    members = stored(rare.unionByName(common).distinct(), "members")
    # a block holds more than its first class; large ones are cut into chunks
    blocks = (members.groupBy("block").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
              .select("block", F.ceil(F.col("m") / TILE_SETS).cast("int").alias("chunks")))
    maps = (members.join(blocks, "block").join(reps.select("rep", "n", F.col("map").alias("bytes")).distinct(), "rep"))
    near = stored(_tiles(maps).mapInArrow(_group(percent), "block bigint, rep bigint").distinct(), "groups")
    # groups that share a class are one, so that every set is sent once
    up = connected_components(near.select(F.col("block").alias("a"), F.col("rep").alias("b")))
    groups = (near.select("rep").distinct().join(up, F.col("rep") == F.col("node"), "left")
              .select("rep", F.coalesce("root", "rep").alias("block")))
    sized = groups.join(reps.select("rep", "n").distinct(), "rep")
    chunks = sized.groupBy("block").agg(F.ceil(F.sum("n") / TILE_TOKENS).cast("int").alias("chunks"))
    ids = stored(groups.join(chunks, "block").withColumnRenamed("rep", "doc_id"), "group-members")
    if ids.count() <= BROADCAST_REPS:
        ids = F.broadcast(ids)
    full = (rows.join(ids, "doc_id").select(F.col("doc_id").alias("rep"), "block", "chunks", "text")
            .mapInArrow(_bytes_of_sets(width), "rep bigint, block bigint, chunks int, n bigint, bytes binary").filter("n > 0"))
    links = _tiles(full).mapInArrow(_link(percent), "a bigint, b bigint")
    roots = connected_components(links)

    classed = sets.select("doc_id", "n", "key").join(smallest, "key", "left")
    return (classed.join(roots, F.col("rep") == F.col("node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id"))
                    .otherwise(F.coalesce("root", "rep")).alias("component_id")))


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                  percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (all columns) whose document is the smallest of its
    component, one row each. Rows without doc_id all stay."""
    found = similar_components(docs, doc_id, text, width, percent)
    keep = (found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
            .select(F.col("doc_id").alias("_id")))
    packed = docs.select(whole_row(docs).alias("_row"), F.col(q(doc_id)).cast("long").alias("_id"))
    stay = packed.filter("_id is not null").join(keep, "_id", "left_semi").dropDuplicates(["_id"])
    return stay.select("_row.*").unionByName(packed.filter("_id is null").select("_row.*"))


def op7_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 3-word shingles and its
    component at a Jaccard of 0.9 or more."""
    return similar_components(table(spark, sf_dir, "documents"), width=3, percent=90)


ship(__name__)
