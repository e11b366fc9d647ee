"""SimHash near-duplicates by multi-index hashing.

A fingerprint is split into segments. By the pigeonhole rule two fingerprints
within `distance` bits of each other lie within a small Hamming ball of each
other in at least one segment, so every fingerprint is filed once per segment
and looked up under the keys of that ball. Complete distances are verified
before a link counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, cut, one_of_each, partitions, released, small_batches

SEED = 42
HOT = 4096


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of one whole text; 0 for a text without words or null."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype="<u8")
    else:
        joined = b" ".join(found)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(found) - words + 1].tolist()
        stops = (ends - 1)[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            [digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8", count=len(starts)
        )
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        made = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for every document; fp holds the unsigned 64 bits in a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        released(lambda it: _fingerprint_batches(it, words)), f"doc_id {kind}, fp long"
    )


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment.

    With radii summing to distance - count + 1, a pair outside every ball differs
    in at least the sum of (radius + 1), which is distance + 1 bits: none is missed.
    """
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    spare = max(0, distance - count + 1)
    out, shift = [], 0
    for i, width in enumerate(widths):
        out.append((shift, width, spare // count + (i < spare % count)))
        shift += width
    return out


def _balls(values: np.ndarray, width: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) within `radius` bits of each value, itself left out.

    Of two values one flip apart only the one with the bit set looks the other
    up; wider balls are looked up from both sides.
    """
    if radius == 0:
        return
    flips = [np.uint64(1) << np.uint64(b) for b in range(width)]
    if radius == 1:
        for flip in flips:
            rows = np.flatnonzero(values & flip)
            yield rows, values[rows] ^ flip
        return
    masks, level = set(map(int, flips)), set(map(int, flips))
    for _ in range(radius - 1):
        level = {m | int(f) for m in level for f in flips}
        masks |= level
    for mask in sorted(masks):
        yield np.arange(len(values)), values ^ np.uint64(mask)


def _filed(batches: Iterator[pa.RecordBatch], plan: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """(segment, key, fp, home): each fingerprint under its own keys and under those of its balls."""
    for batch in batches:
        everything = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(everything), 4096):
            fps = everything[lo : lo + 4096]
            for number, (shift, width, radius) in enumerate(plan):
                value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                rows, keys, home = [np.arange(len(fps))], [value], [np.ones(len(fps), bool)]
                for r, k in _balls(value, width, radius):
                    rows.append(r)
                    keys.append(k)
                    home.append(np.zeros(len(r), bool))
                taken = fps[np.concatenate(rows)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(taken), number, np.int32)),
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(taken),
                        pa.array(np.concatenate(home)),
                    ],
                    names=["segment", "key", "fp", "home"],
                )


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints within `distance` bits of each other.

    Breadth first, each step against those not reached yet, so a dense cloud of
    near copies costs little more than one pass.
    """
    edges: list[tuple[int, int]] = []
    rest = np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                hit = rest[near]
                edges += [(int(at), int(x)) for x in hit]
                queue += list(hit)
                rest = rest[~near]
    return edges


def _verified(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (segment, key, cell); yields forest edges of each group that has a home row."""
    kept: list[np.ndarray] | None = None

    def links(group: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fps, home, first = group[2].view(np.uint64), group[3], group[4]
        bounds = np.append(np.flatnonzero(first), len(fps))
        sizes = np.diff(bounds)
        homes = np.add.reduceat(home.astype(np.int64), bounds[:-1]) if len(sizes) else sizes
        pairs = bounds[:-1][(sizes == 2) & (homes > 0)]
        near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= distance
        a, b = [fps[pairs[near]]], [fps[pairs[near] + 1]]
        for i in np.flatnonzero((sizes > 2) & (homes > 0)):
            if edges := _forest(fps[bounds[i] : bounds[i + 1]], distance):
                made = np.array(edges, dtype=np.uint64)
                a.append(made[:, 0])
                b.append(made[:, 1])
        left, right = np.concatenate(a), np.concatenate(b)
        if len(left):
            yield pa.RecordBatch.from_arrays(
                [pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["a", "b"]
            )

    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # segment, key, cell, fp, home
        rows = [rows[0], rows[1], rows[3], rows[4], rows[2]]  # the cell last
        if kept is not None:
            rows = [np.concatenate(p) for p in zip(kept, rows)]
        if not len(rows[0]):
            continue
        first = np.ones(len(rows[0]), bool)
        first[1:] = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[4]) != 0)
        last = int(np.flatnonzero(first)[-1])
        kept = [r[last:] for r in rows]  # the last group may go on in the next batch
        if last:
            yield from links([r[:last] for r in rows[:4]] + [first[:last]])
    if kept is not None and len(kept[0]):
        first = np.zeros(len(kept[0]), bool)
        first[0] = True
        yield from links(kept[:4] + [first])


def _masks(width: int, radius: int) -> list[int]:
    """Differences of all other values within `radius` bits."""
    found, level = set(), {0}
    for _ in range(radius):
        level = {m ^ (1 << b) for m in level for b in range(width)}
        found |= level
    return sorted(found - {0})


def dealt(fps: DataFrame, distance: int, count: int, cell: int) -> DataFrame:
    """(segment, key, cell, fp, home): the rows that meet in one group, of about 2 * `cell` at most.

    A key under which more than `cell` rows can be filed deals them by hash into chunks; every
    pair of chunks is a cell, so any two rows of the key meet in one and none holds them all.
    The rows of a key are its own and those of the keys in its ball, so only keys with a
    neighbour of cell / (ball + 1) rows or more have to be looked at.
    """
    plan = segments(distance, count)
    filed = fps.mapInArrow(released(lambda it: _filed(it, plan)), "segment int, key long, fp long, home boolean")
    own = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w, _ in plan]
    home = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), k.alias("key")) for i, k in enumerate(own)])).alias("s"))
    balls = [[0, *_masks(w, r)] for _, w, r in plan]
    ball = F.get(F.array(*[F.array(*[F.lit(m).cast("long") for m in b]) for b in balls]), F.col("segment"))
    large = home.groupBy("s.segment", "s.key").count().where(F.col("count") * max(map(len, balls)) > cell)
    hot = (
        large.select("segment", F.col("key").alias("near"), "count", F.explode(ball).alias("mask"))
        .groupBy("segment", F.col("near").bitwiseXOR(F.col("mask")).alias("key")).agg(F.sum("count").alias("count"))
        .where(F.col("count") > cell).select("segment", "key", F.ceil(F.col("count") / cell).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(F.col("chunk"), j) * F.col("chunks") + F.greatest(F.col("chunk"), j))
    return (
        filed.join(hot, ["segment", "key"], "left").withColumn("chunk", chunk)
        .withColumn("cell", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pairs)))
        .select("segment", "key", "cell", "fp", "home")
    )


def links(fps: DataFrame, distance: int = 4, count: int = 3, cell: int = 1 << 16) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within `distance` bits.

    fps: rows (fp), distinct. Each group under one key yields a spanning forest
    of its links, never all pairs; see dealt for keys with many rows. No pair is lost.
    """
    return (
        dealt(fps, distance, count, cell).repartition(partitions(fps.sparkSession), "segment", "key", "cell").sortWithinPartitions("segment", "key", "cell")
        .mapInArrow(released(lambda it: _verified(it, distance)), "a long, b long")
    )


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, count: int = 3) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest doc_id reachable over links.

    docs: doc_id and text; other columns are ignored. Equal fingerprints are one
    node, so a hot group of copies costs one row in the search. Null and empty
    texts have fingerprint zero and link like any other; rows with a null doc_id
    keep a null id and take their group's component; repeated rows are returned
    as often as they occur; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        prints = cut(fingerprints(docs, words))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    roots = components(links(nodes.select("fp"), distance, count))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = grouped.join(least, "root").select("fp", "component_id")
    named = cut(nodes.join(moved, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id")))
    # fingerprints of a HOT-th of all documents or more: fewer than HOT of them, so they may be broadcast
    hot = F.broadcast(named.where(F.col("copies") * HOT > prints.count()).select("fp", "component_id"))
    rest = prints.join(hot, "fp", "left_anti").join(named.drop("copies"), "fp")
    return prints.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Exactly one row, with all its columns, of each group of near_duplicates; see one_of_each.

    It is the one of the smallest doc_id, a null id last: a document with a null id and
    without a near copy stays, and of repeated rows of one doc_id one stays.
    """

    def groups(rows: DataFrame) -> DataFrame:
        return near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))

    return one_of_each(docs, groups)
