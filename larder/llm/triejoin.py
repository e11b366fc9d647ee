"""N-gram Jaccard join by prefix trees: all links of a similarity of 4/5 or more, exactly.

A text is the set of its distinct word shingles, in one order common to all texts: by hash, but those
of many texts last, as counted over all texts. The order decides the work and never the result.

1. Two similar sets share a shingle among the first n - ceil(4n/5) + 1 of each, and a pair of neighbours in the order
   among the first floor(2n/5) + 2: a set lacks at most (5n - 4m)/9 of the other's m, each shingle that one lacks parts two
   pairs, each that the other adds parts one, (2n - m)/3 in all. Only these meet by key, as (set, size, place): single shingles of
   sets below LONG and those a quarter larger, pairs of sets from LONG on, whose bitmaps would have to be too
   long to tell two that share one shingle. A key of one set alone is dropped at once. Within a key, sizes, places and narrow parity
   bitmaps (they never differ in more bits than the sets in shingles) rule pairs out, and a spanning forest of what is
   left goes on: at most one row for each row that comes in, never all pairs. What it connects is gone
   through once more with wide bitmaps.
2. Connected candidates form blocks; any two similar sets are in one block. Complete sets go to their block
   once, are stored in a trie there and joined by traversal: all sets below a node share the overlap found
   on the way to it, and a subtree is left as soon as its sizes and what remains cannot reach the overlap needed.
3. Links leave a block as a spanning forest; components are those of the forests.

Keys and blocks with too many rows for a task are dealt into chunks, and every pair of chunks is a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, cut, one_of_each, only, partitions, released, small_batches, stored

SEED = 42
COUNTERS = 1 << 24  # slots in which shingles are counted for the order, at most: a broadcast of 16 MB
SLICE = 1 << 16  # counters that travel together
MANY = 96  # texts from which on a shingle is frequent, besides what others in its slot make likely
LONG = 2048  # shingles, 2 at least, from which on sets meet by pairs of neighbours
NARROW = 2048  # most bits of a bitmap that travels with each key
CELL = 2048  # rows of one key in a cell, times two
TOKENS = 2 << 20  # shingles of one block in a cell, times two
SEGMENT = 32
SLOTS = 1 << 24  # bits of the filter of texts, whatever their number: a broadcast of 2 MB
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _Hashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word, SEED)
        return made


_HASHES = _Hashes()


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of `words` words as sorted 61-bit hashes; a shorter text is one shingle, one without words has none."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED) >> 3], np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    mixed = np.zeros(len(found) - words + 1, np.uint64)
    for i in range(words):  # Horner's scheme with a full mix at each word
        mixed = (mixed ^ each[i : len(found) - words + 1 + i]) * _PRIMES[i % len(_PRIMES)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed >> np.uint64(3))


def ordered(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles with the level of their slot in the top three bits, sorted: the order common to all sets."""
    level = levels[own & np.uint64(len(levels) - 1)]
    return np.sort(own | (level.astype(np.uint64) << np.uint64(61))) if level.any() else own


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def singles(n: int) -> int:
    """Single shingles under which a set of n is filed."""
    return prefix_length(n) if 4 * n <= 5 * (LONG - 1) else 0


def wanted_length(n: int) -> int:
    """Shingles of the order's beginning that the keys of a set of n are made of."""
    return max(singles(n), 2 * n // 5 + 2 if n >= LONG else 0)


def keys(first: np.ndarray, n: int) -> np.ndarray:
    """The keys of a set of n: its first single shingles, then its pairs of neighbours by the place of the first of them."""
    pairs = first[: 2 * n // 5 + 2 if n >= LONG else 0]
    pairs = (pairs[:-1] * _PRIMES[0] ^ pairs[1:]) * _PRIMES[1]
    return np.concatenate([first[: singles(n)], pairs ^ (pairs >> np.uint64(32))]).view(np.int64)


def reach(n: int) -> int:
    """Shingles kept of a set, by hash: those its keys need and some more, in place of frequent ones among them."""
    return min(n, wanted_length(n) * 5 // 4 + 8)


def parity(own: np.ndarray, least: int, most: int | None = None) -> bytes:
    """A bitmap of a power of two of bits, 64 and `least` at least, `most` at most: a bit is the parity of the shingles that fall on it."""
    width = max(64, 1 << (least - 1).bit_length())
    width = min(width, most or width)
    at = (own & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def _counted(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """(slice, width, payload) of lists of shingles: how many fall on each slot, in the narrowest integers, compressed."""
    total = np.zeros(slots, np.int32)
    for batch in batches:
        np.add.at(total, batch.column(0).flatten().to_numpy() & (slots - 1), 1)
    for lo in range(0, slots, SLICE):
        own = total[lo : lo + SLICE]
        if own.any():
            own = own.astype(np.min_scalar_type(own.max()))
            payload = pa.Codec("zstd", 1).compress(own.tobytes(), asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([own.itemsize], pa.int32()), pa.array([payload], pa.binary())], names=["slice", "width", "payload"])


def _leveled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, level) of the frequent slots, from whole slices."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for lo, width, payload in zip(*(c.to_pylist() for c in batch.columns)):
            raw = pa.Codec("zstd").decompress(payload, SLICE * width, asbytes=True)
            held.setdefault(lo, np.zeros(SLICE, np.int64))
            held[lo] += np.frombuffer(raw, f"u{width}").astype(np.int64)
    for lo, own in held.items():
        likely = own.mean()
        least = MANY + likely + 8 * likely**0.5
        at = np.flatnonzero(own >= least)
        if len(at):
            level = np.minimum(np.log2(own[at] / least).astype(np.int32) + 1, 7)
            yield pa.RecordBatch.from_arrays([pa.array((lo + at).astype(np.int32)), pa.array(level)], names=["slot", "level"])


def frequent(kept: DataFrame) -> np.ndarray:
    """The level, 0 or for frequent ones 1 to 7, of each slot of shingles, counted over all rows of kept (a list of shingles).

    Some 16 slots a text, COUNTERS at most, so a shingle may be taken for frequent for others in its slot; that is
    the same for all sets. Counters are added up slice by slice, and only frequent slots reach the driver.
    """
    slots = min(COUNTERS, max(SLICE, 1 << (16 * kept.count()).bit_length()))
    counts = kept.mapInArrow(released(lambda it: _counted(it, slots)), "slice int, width int, payload binary")
    rows = counts.repartition(partitions(kept.sparkSession), "slice").mapInArrow(released(_leveled), "slot int, level int").toArrow()
    levels = np.zeros(slots, np.uint8)
    levels[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return levels


def _sketched(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            digests, sizes, firsts, narrow, wide = [], [], [], [], []
            for text in part.column(2):
                own = shingles(text.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(own.tobytes(), SEED))
                sizes.append(len(own))
                firsts.append(own[: reach(len(own))].view(np.int64) if len(own) else np.zeros(0, np.int64))
                narrow.append(parity(own, 2 * len(own) // 3 if singles(len(own)) else 64, NARROW) if len(own) else b"")
                wide.append(parity(own, 2 * len(own)) if len(own) else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                    pa.array(narrow, pa.binary()), pa.array(wide, pa.binary()),
                ],
                names=["doc_id", "print", "digest", "n", "kept", "narrow", "wide"],
            )


def _prefix(kept: np.ndarray, n: int, levels: np.ndarray) -> np.ndarray | None:
    """What the keys of a set of n shingles are made of, from those kept of it; None if too many of these are frequent to know it."""
    if len(kept) == n:
        return ordered(kept, levels)[: wanted_length(n)]
    rare = kept[levels[kept & np.uint64(len(levels) - 1)] == 0][: wanted_length(n)]
    return rare if len(rare) == wanted_length(n) else None


def _known_keys(batches: Iterator[pa.RecordBatch], levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Reads (digest, node, n, print, kept); keys take the place of kept, null where they need the text."""
    for batch in batches:
        ends, flat = np.cumsum(batch.column(4).value_lengths().to_numpy()), batch.column(4).flatten().to_numpy().view(np.uint64)
        made = [_prefix(flat[a:b], n, levels) for a, b, n in zip([0, *ends.tolist()], ends.tolist(), batch.column(2).to_pylist())]
        found = pa.array([x if x is None else keys(x, n) for x, n in zip(made, batch.column(2).to_pylist())], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], found], names=["digest", "node", "n", "print", "keys"])


def _late_keys(batches: Iterator[pa.RecordBatch], words: int, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(digest, keys) of whole texts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            sets = [shingles(text.as_py(), words) for text in batch.column(0).slice(lo, 256)]
            sets = [own for own in sets if len(own)]
            found = pa.array([keys(ordered(own, levels)[: wanted_length(len(own))], len(own)) for own in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(own.tobytes(), SEED) for own in sets], pa.binary()), found], names=["digest", "keys"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups by the first `keys` columns, of rows that come sorted by them."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.flatnonzero(change) + 1
        fresh = bool(kept) and any(kept[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys))
        if fresh:
            yield pa.Table.from_batches(kept)
            kept = []
        if len(starts):
            last = int(starts[-1])
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _bounds(table: pa.Table, keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns (all but lists and bytes) and the starts of the groups, with the end."""
    columns = [table.column(i).to_numpy() for i in range(keys)]
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return columns, np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, node, at) sorted by token, the rows whose token has another row."""
    held, held_out = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = batch.column(0).to_numpy()
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held_out:  # the row carried over belongs to a group that has been seen before
            keep[0] = True
        held, held_out = batch.slice(len(token) - 1), bool(keep[-1])
        keep[-1] = False
        yield batch.filter(pa.array(keep))
    if held is not None and held_out:
        yield held


def _crowded(batches: Iterator[pa.RecordBatch], cell: int) -> Iterator[pa.RecordBatch]:
    """(token, count) of the tokens with more than `cell` rows, of rows that come whole and sorted by token."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.diff(np.append(start, len(token)))
        token = token[start]
        if last is not None and last == token[0]:
            count[0] += held
        elif last is not None and held > cell:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held], pa.int64())], names=["token", "count"])
        many = np.flatnonzero(count[:-1] > cell)
        yield pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(count[many], pa.int64())], names=["token", "count"])
        last, held = int(token[-1]), int(count[-1])
    if held > cell:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held], pa.int64())], names=["token", "count"])


def chunked(chunks: Column, of: Column) -> Column:
    """array of cells: all pairs of chunks that have the chunk of this row, or cell 0 where there is one chunk only."""
    own = F.pmod(F.xxhash64(of), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(own, j) * chunks + F.greatest(own, j))
    return F.when(F.coalesce(chunks, F.lit(1)) <= 1, F.array(F.lit(0))).otherwise(pairs)


def _words(bits: list[bytes]) -> dict[int, np.ndarray]:
    return {w: np.frombuffer(b"".join(b for b in bits if len(b) == w), np.uint64).reshape(-1, w // 8) for w in {len(b) for b in bits}}


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which bitmaps (rows of words) differ; the longer kind is folded onto the shorter one, which keeps parities."""
    while a.shape[1] > b.shape[1]:
        a = _folded(a)
    while b.shape[1] > a.shape[1]:
        b = _folded(b)
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _folded(a: np.ndarray) -> np.ndarray:
    return a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]


def possible(n: np.ndarray, m: int, i: np.ndarray, j: int) -> np.ndarray:
    """Whether sets of sizes n and m that share their i-th and j-th shingle can be similar, by sizes and places."""
    close = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
    return close & (9 * (np.minimum(i, j) + np.minimum(n - i, m - j)) >= 4 * (n + m))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (token, cell, node, at, bits) sorted by token and cell; yields forests of the pairs that may be similar."""
    for table in _groups(batches, 2):
        _, bounds = _bounds(table, 2)
        node, at = table.column(2).to_numpy(), table.column(3).to_numpy()
        n, place, bits = at >> 32, at & 0xFFFFFFFF, table.column(4).to_pylist()
        left, right = [], []
        widths = np.fromiter(map(len, bits), np.int64, len(bits))
        # groups of two rows with bitmaps of one kind, all at once
        first = bounds[:-1][np.diff(bounds) == 2]
        alike = first[(widths[first] == widths[first + 1]) & (node[first] != node[first + 1])]
        fine = possible(n[alike], n[alike + 1], place[alike], place[alike + 1])
        alike = alike[fine]
        for w in np.unique(widths[alike]):
            own = alike[widths[alike] == w]
            a, b = (np.frombuffer(b"".join([bits[k] for k in rows]), np.uint64).reshape(-1, w // 8) for rows in (own.tolist(), (own + 1).tolist()))
            near = own[9 * _apart(a, b) <= n[own] + n[own + 1]]
            left.append(node[near])
            right.append(node[near + 1])
        others = np.diff(bounds) > 2
        others |= (np.diff(bounds) == 2) & (widths[bounds[:-1]] != widths[np.minimum(bounds[:-1] + 1, len(widths) - 1)])
        for k in np.flatnonzero(others):
            lo, hi = bounds[k], bounds[k + 1]
            made = _forest(node[lo:hi], n[lo:hi], place[lo:hi], bits[lo:hi])
            left.append(np.array([x for x, _ in made], np.int64))
            right.append(np.array([x for _, x in made], np.int64))
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _forest(node: np.ndarray, n: np.ndarray, place: np.ndarray, bits: list[bytes]) -> list[tuple[int, int]]:
    """Spanning forest of the rows of one key that may be similar: breadth first against those not reached yet."""
    maps, widths = _words(bits), np.fromiter(map(len, bits), np.int64, len(bits))
    row = np.zeros(len(bits), np.int64)
    for w in maps:
        row[widths == w] = np.arange(int((widths == w).sum()))
    edges, rest = [], np.argsort(n, kind="stable")
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            hit = possible(n[rest], n[p], place[rest], place[p])
            for w in maps:
                mine = np.flatnonzero(hit & (widths[rest] == w))
                if len(mine):
                    own = maps[widths[p]][row[p]][None, :]
                    hit[mine] = 9 * _apart(maps[w][row[rest[mine]]], own) <= n[rest[mine]] + n[p]
            if hit.any():
                near = rest[hit]
                edges += [(int(node[p]), int(node[x])) for x in near if node[p] != node[x]]
                queue += near.tolist()
                rest = rest[~hit]
    return edges


class Trie:
    """Sets of ordered shingles in a prefix tree whose long edges are cut into segments of SEGMENT shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.known = len(ids)
        ends = np.cumsum(self.sizes)
        self.sets = [inverse[e - n : e] for e, n in zip(ends, self.sizes)]  # numbered in the common order
        keys = [s.astype(">u4").tobytes() for s in self.sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        parent, labels, depth, leaf = [-1], [np.zeros(0, np.int64)], [0], [-1]
        path = [0]  # nodes from the root to the last set's end, by depth
        before = None
        for s in order:
            own = self.sets[s]
            common = 0
            if before is not None:
                m = min(len(before), len(own))
                differ = np.flatnonzero(before[:m] != own[:m])
                common = int(differ[0]) if len(differ) else m
            while depth[path[-1]] > common:
                last = path.pop()
                if depth[parent[last]] < common:  # cut the edge at the branch
                    at = common - depth[parent[last]]
                    parent.append(parent[last])
                    labels.append(labels[last][:at])
                    depth.append(common)
                    leaf.append(-1)
                    labels[last], parent[last] = labels[last][at:], len(parent) - 1
                    path.append(len(parent) - 1)
            for lo in range(common, len(own), SEGMENT):
                parent.append(path[-1])
                labels.append(own[lo : lo + SEGMENT])
                depth.append(min(lo + SEGMENT, len(own)))
                leaf.append(-1)
                path.append(len(parent) - 1)
            leaf[path[-1]] = s
            before = own
        self.parent, self.depth, self.leaf = np.array(parent), np.array(depth), np.array(leaf)
        lengths = np.array([len(x) for x in labels])
        self.label_end = np.cumsum(lengths)
        self.label_start = self.label_end - lengths
        self.pool = np.concatenate(labels)
        self.last = np.where(lengths > 0, self.pool[np.maximum(self.label_end - 1, 0)] if len(self.pool) else 0, -1)
        kids = np.argsort(self.parent[1:], kind="stable") + 1
        self.kids, counts = kids, np.bincount(self.parent[1:], minlength=len(parent))
        self.kids_end = np.cumsum(counts)
        self.kids_start = self.kids_end - counts
        self.least, self.most = np.full(len(parent), 1 << 40), np.zeros(len(parent), np.int64)
        self.live = np.zeros(len(parent), np.int64)
        self.end_of = np.zeros(len(sets), np.int64)
        held = np.flatnonzero(self.leaf >= 0)
        self.end_of[self.leaf[held]] = held
        at, size = held, self.sizes[self.leaf[held]]
        while len(at):
            np.minimum.at(self.least, at, size)
            np.maximum.at(self.most, at, size)
            np.add.at(self.live, at, 1)
            keep = self.parent[at] >= 0
            at, size = self.parent[at][keep], size[keep]
        self.marked = np.zeros(self.known, bool)

    def remove(self, sets: np.ndarray) -> None:
        at = self.end_of[sets]
        while len(at):
            np.subtract.at(self.live, at, 1)
            at = self.parent[at]
            at = at[at >= 0]

    def similar(self, probe: int) -> np.ndarray:
        """The live sets of a similarity of 4/5 or more to the set `probe`."""
        own, n = self.sets[probe], int(self.sizes[probe])
        self.marked[own] = True
        found = []
        at, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        least = -(-4 * n // 5)
        while len(at):
            counts = self.kids_end[at] - self.kids_start[at]
            overlap = np.repeat(overlap, counts)
            ends = np.cumsum(counts)
            at = self.kids[np.arange(ends[-1]) + np.repeat(self.kids_start[at] - (ends - counts), counts)] if ends[-1] else at[:0]
            some = (self.live[at] > 0) & (self.most[at] >= least) & (4 * self.least[at] <= 5 * n)
            at, overlap = at[some], overlap[some]
            if not len(at):
                break
            lengths = self.label_end[at] - self.label_start[at]
            ends = np.cumsum(lengths)
            tokens = self.pool[np.arange(ends[-1]) + np.repeat(self.label_start[at] - (ends - lengths), lengths)]
            overlap = overlap + np.add.reduceat(self.marked[tokens].astype(np.int64), ends - lengths)
            hit = self.leaf[at]
            ended = np.flatnonzero(hit >= 0)
            ended = ended[9 * overlap[ended] >= 4 * (n + self.sizes[hit[ended]])]
            found.append(hit[ended])
            left = np.minimum(n - np.searchsorted(own, self.last[at], side="right"), self.most[at] - self.depth[at])
            reach = 9 * (overlap + left) >= 4 * (n + np.maximum(self.least[at], least))
            at, overlap = at[reach], overlap[reach]
        self.marked[own] = False
        out = np.concatenate(found) if found else np.zeros(0, np.int64)
        return out[self.gone[out] == 0]

    def forest(self) -> list[tuple[int, int]]:
        """Pairs of sets: a spanning forest of all links."""
        self.gone = np.zeros(len(self.sets), np.int8)
        edges = []
        for seed in range(len(self.sets)):
            if self.gone[seed]:
                continue
            queue = [seed]
            self.gone[seed] = 1
            self.remove(np.array([seed]))
            while queue and self.live[0]:
                p = queue.pop()
                near = self.similar(p)
                if len(near):
                    self.gone[near] = 1
                    self.remove(near)
                    edges += [(p, int(x)) for x in near]
                    queue += near.tolist()
        return edges


def _sets(batches: Iterator[pa.RecordBatch], words: int, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, node, chunks, set) of (digest, block, node, chunks, text), where the text is the one of the digest."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            keep, made = [], []
            for k, (digest, text) in enumerate(zip(part.column(0).to_pylist(), part.column(4))):
                own = shingles(text.as_py(), words)
                if xxhash.xxh3_128_digest(own.tobytes(), SEED) == digest:
                    keep.append(k)
                    made.append(ordered(own, levels).tobytes())
            part = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(made, pa.binary())], names=["block", "node", "chunks", "set"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (block, cell, node, set) sorted by block and cell; yields the links of each cell as a spanning forest."""
    for table in _groups(batches, 2):
        _, bounds = _bounds(table, 2)
        node, sets = table.column(2).to_numpy(), table.column(3)
        a, b = [], []
        for lo, hi in zip(bounds, bounds[1:]):
            names, first = np.unique(node[lo:hi], return_index=True)  # repeated rows of one document
            if len(names) > 1:
                trie = Trie([np.frombuffer(sets[int(lo + k)].as_py(), np.uint64) for k in first])
                for x, y in trie.forest():
                    a.append(names[x])
                    b.append(names[y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def join(docs: DataFrame, words: int = 5, cell: int = CELL, tokens: int = TOKENS) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable over links.

    docs: doc_id and text; other columns are ignored. Two documents link when 5 * |intersection| >= 4 * |union|. Equal sets
    are one node of the search, so copies cost one row there. Texts without words, null ones too, link with
    nothing. Rows with a null doc_id keep it and take the smallest id of their component, if it has one; repeated rows are
    returned as often as they occur; an empty table gives no rows. Shingles are compared by 61-bit hashes,
    sets by 128-bit ones. cell and tokens bound what a task holds of one key or block.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, print long, digest binary, n long, kept array<long>, narrow binary, wide binary"
    with small_batches(spark):
        made = cut(texts.mapInArrow(released(lambda it: _sketched(it, words)), kinds).withColumn("node", F.monotonically_increasing_id()))
    full = made.where("n > 0")
    order = spark.sparkContext.broadcast(frequent(full.select("kept")))
    sets = stored(full.groupBy("digest").agg(F.min("node").alias("node"), F.min(F.struct("doc_id", "print")).alias("one")))
    alone = F.when(4 * F.col("n") <= 5 * (LONG - 1), F.expr("n div 5 + 1")).otherwise(0)  # as singles()
    place = F.shiftleft("n", 32) + F.col("pos") - F.when(F.col("pos") >= alone, alone).otherwise(0)
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS))  # noqa: E731  a filter before the shuffle: what is let through in vain drops out of the join
    one = only(full.select("digest", "node", "n", "print", "kept"), "node", sets.select(F.col("node").alias("row")), 1)  # a bit for each text
    known = one.mapInArrow(released(lambda it: _known_keys(it, order.value)), "digest binary, node long, n long, print long, keys array<long>")
    late = only(texts.withColumn("slot", slot("print")), "slot", known.where("keys is null").select(slot("print").alias("row")), SLOTS)
    read = late.select("text").mapInArrow(released(lambda it: _late_keys(it, words, order.value)), "digest binary, keys array<long>")
    missing = known.where("keys is null").select("digest", "node", "n").join(read.dropDuplicates(["digest"]), "digest")
    single = known.where("keys is not null").select("node", "n", "keys").unionByName(missing.select("node", "n", "keys"))
    filed = single.select(F.posexplode("keys").alias("pos", "token"), "node", "n").select("token", "node", place.alias("at"))
    shared = cut(filed.repartition(partitions(spark), "token").sortWithinPartitions("token").mapInArrow(released(_shared), "token long, node long, at long"))
    crowded = shared.select("token").mapInArrow(released(lambda it: _crowded(it, cell)), "token long, count long")
    first = components(_possible(shared.join(full.select("node", F.col("narrow").alias("bits")), "node"), crowded, cell))
    once = first.select(F.col("root").alias("token"), "node").join(full.select("node", F.shiftleft("n", 32).alias("at"), F.col("wide").alias("bits")), "node")
    second = components(_possible(once.select("token", "node", "at", "bits"), first.groupBy(F.col("root").alias("token")).count(), cell))
    blocks = cut(second.select("node", F.col("root").alias("block")).join(full.select("node", "n", "digest"), "node"))
    large = blocks.groupBy("block").agg(F.sum("n").alias("all")).where(F.col("all") > tokens).select("block", F.ceil(F.col("all") / tokens).cast("int").alias("chunks"))
    wanted = stored(blocks.join(large, "block", "left").join(sets.select("node", "one"), "node").select("digest", "block", "node", F.coalesce("chunks", F.lit(1)).alias("chunks"), "one.*"))
    near = only(texts.withColumn("slot", slot("print")), "slot", wanted.select(slot("print").alias("row")), SLOTS)
    sent = (
        near.join(wanted.withColumnRenamed("doc_id", "id").withColumnRenamed("print", "p"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("p")))
        .select("digest", "block", "node", "chunks", "text")
        .mapInArrow(released(lambda it: _sets(it, words, order.value)), "block long, node long, chunks int, set binary")
        .select("block", F.explode(chunked(F.col("chunks"), F.col("node"))).alias("cell"), "node", "set")
    )
    links = sent.repartition(partitions(spark), "block", "cell").sortWithinPartitions("block", "cell").mapInArrow(released(_linked), "a long, b long")
    roots = components(links)
    named = sets.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    named = full.groupBy("digest").agg(F.min("doc_id").alias("least")).join(named, "digest")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = named.join(least, "root").select("digest", "component_id")
    some = full.select("doc_id", "digest", F.col("n").alias("n_shingles")).join(component, "digest")
    none = made.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none)


def _possible(rows: DataFrame, counts: DataFrame, cell: int) -> DataFrame:
    """Candidate links (a, b) of rows (token, node, at, bits): see _candidates; tokens that counts says have more than `cell` rows are dealt into cells."""
    hot = counts.where(F.col("count") > cell).select("token", F.ceil(F.col("count") / cell).cast("int").alias("chunks"))
    met = rows.join(hot, "token", "left").select("token", F.explode(chunked(F.col("chunks"), F.col("node"))).alias("cell"), "node", "at", "bits")
    return met.repartition(partitions(rows.sparkSession), "token", "cell").sortWithinPartitions("token", "cell").mapInArrow(released(_candidates), "a long, b long")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Exactly one row, with all its columns, of each component of join(); see one_of_each. Texts without words all stay."""

    def groups(rows: DataFrame) -> DataFrame:
        found = join(rows.select(F.col("row").alias("doc_id"), "text"), **options)
        return found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))

    return one_of_each(docs, groups)


#: The same in DuckDB's SQL: all pairs that share a shingle, then what is reachable.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.other = p.a
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
