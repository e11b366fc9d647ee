"""Exact removal of repeated byte strings with an enhanced suffix array.

A repeat is a string of at least `MIN_BYTES` bytes that occurs twice. Every
window of MIN_BYTES bytes has an anchor: the K bytes in it whose hash is least
(the last such). Equal windows have equal anchors, so all occurrences of a repeat
meet under its anchors' hashes; anchors that occur once are dropped early. Around
each repeated anchor the windows it stands for form a context of up to
2 * MIN_BYTES - K bytes. The contexts of an anchor are indexed by a suffix array
with common-prefix lengths; a stack scan yields the intervals of the common-prefix
tree, and those whose left neighbours differ are the maximal repeats within
the contexts, each with all its occurrences. A repeat longer than a context is
reported as a chain of overlapping ones.

Documents are held in shards of a few MB. For removal, equal contexts are found
first, by hashes: a shard sends one of its equal contexts, and of equal ones among
shards only the earliest is looked at again; the others are repeats of it. Texts
move only where an anchor has several contexts. An anchor that occurs in more than
`hot` shards is dealt by the contents of its contexts and windows. So no task holds a
group that grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import cut, partitions, released, released_groups, small_batches

MIN_BYTES = 100
K = 32
SPAN = MIN_BYTES - K + 1  # windows that may share an anchor
REACH = MIN_BYTES + SPAN - 1  # bytes of the longest context
HOT = 1024
SHARD_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.append(np.uint64(1), np.cumprod(np.full(n - 1, base, np.uint64)))


_UP, _DOWN = _powers(_BASE, _CHUNK + MIN_BYTES + 1), _powers(_INVERSE, _CHUNK + MIN_BYTES + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first window, last window) of each anchor.

    data: the bytes of the documents one after another; ends: where each stops.
    Windows are named by where they start; none crosses a document's end.
    """
    found: list[tuple] = []
    starts = np.append(0, ends[:-1])
    for lo in range(0, max(0, len(data) - MIN_BYTES + 1), _CHUNK):
        part = data[lo : lo + _CHUNK + MIN_BYTES - 1].astype(np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * _UP[: len(part)], out=sums[1:])
        grams = _mixed((sums[K:] - sums[:-K]) * _DOWN[: len(part) - K + 1])
        place = np.uint64(0xFFFFFFFF) - np.arange(lo, lo + len(grams), dtype=np.uint64)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | place  # of equal hashes the last
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
        at = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
        window = np.arange(lo, lo + len(at))
        doc = np.searchsorted(ends, window, side="right")
        inside = window + MIN_BYTES <= ends[np.minimum(doc, len(ends) - 1)]
        at, window, doc = at[inside], window[inside], doc[inside]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 0) | (np.diff(doc) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        if len(first):
            found.append((at[first], grams[at[first] - lo], doc[first], window[first], window[last]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, key, doc, first, last = (np.concatenate(c) for c in zip(*found))
    new = np.ones(len(at), bool)  # a run of windows may go on in the next chunk
    new[1:] = (np.diff(at) != 0) | (np.diff(doc) != 0)
    begin = np.flatnonzero(new)
    return key[begin], doc[begin], first[begin], last[np.append(begin[1:], len(at)) - 1]


class Shard:
    """Some documents, ordered by doc_id, their bytes one after another."""

    def __init__(self, payload: bytes):
        self.table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        texts = self.table.column("text").to_pylist()
        self.raw = b"".join(t or b"" for t in texts)
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.ends = np.cumsum([len(t or b"") for t in texts]).astype(np.int64)
        self.starts = self.ends - np.array([len(t or b"") for t in texts], dtype=np.int64)
        ids = self.table.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
        self.ids = ids.astype(np.int64)

    def anchors(self):
        if not len(self.ends) or not len(self.data):
            return anchors(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        return anchors(self.data, self.ends)


def _packed(arrays: dict[str, np.ndarray | pa.Array]) -> bytes:
    batch = pa.record_batch([pa.array(v) for v in arrays.values()], names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> dict[str, pa.Array]:
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return {name: table.column(name).combine_chunks() for name in table.column_names}


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(shard, payload): the rows of a task in blocks of about `most` bytes of text, sorted by doc_id."""
    number = TaskContext.get().partitionId() << 24
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        at = table.schema.get_field_index("text")
        table = table.set_column(at, "text", table.column("text").cast(pa.binary()))
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
        payload = _packed({n: table.column(n).combine_chunks() for n in table.column_names})
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "payload"])

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield block()
                number, held, start, size = number + 1, [], i, 0
            size += n + 64
        held.append(batch.slice(start))
    if sum(b.num_rows for b in held):
        yield block()


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, shard, payload): a shard's distinct anchors for each bucket, marked where the shard has two."""
    for batch in batches:
        for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys, counts = np.unique(Shard(payload.as_py()).anchors()[0], return_counts=True)
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, order[bounds[b] : bounds[b + 1]]) for b in np.flatnonzero(np.diff(bounds)).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in rows], pa.int64()),
                        pa.array([number] * len(rows), pa.int64()),
                        pa.array([keys[at].astype("<u8").tobytes() + (counts[at] > 1).astype(np.uint8).tobytes() for _, at in rows], pa.binary()),
                    ],
                    names=["bucket", "shard", "payload"],
                )


def _answered(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """(shard, payload): those of a shard's anchors that occur twice anywhere, with a mark where over `hot` shards have them."""
    shards: list[int] = []
    keys: list[np.ndarray] = []
    twice: list[np.ndarray] = []
    for batch in batches:
        for number, payload in zip(batch.column(1).to_pylist(), batch.column(2)):
            raw = payload.as_py()
            n = len(raw) // 9
            shards.append(number)
            keys.append(np.frombuffer(raw, dtype="<u8", count=n))
            twice.append(np.frombuffer(raw, dtype=np.uint8, offset=8 * n))
    if not shards:
        return
    everything, marks = np.concatenate(keys), np.concatenate(twice)
    _, place, counts = np.unique(everything, return_inverse=True, return_counts=True)
    repeated = (counts > 1) | (np.bincount(place, weights=marks, minlength=len(counts)) > 0)
    ends = np.cumsum([len(k) for k in keys])
    for number, own, end in zip(shards, keys, ends.tolist()):
        at = place[end - len(own) : end]
        hit = repeated[at]
        if hit.any():
            payload = own[hit].tobytes() + (counts[at[hit]] > hot).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "payload"])


def _span_payload(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return _packed({"doc": doc.astype(np.int32), "start": start.astype(np.int64), "end": end.astype(np.int64)})


def _repeated(shard: Shard, answers: pa.Table) -> tuple[np.ndarray, ...]:
    """(key, document, first window, last window, hot) of a shard's anchors that occur twice anywhere."""
    raw = answers.column("payload").to_pylist()
    known = np.concatenate([np.frombuffer(r, dtype="<u8", count=len(r) // 9) for r in raw])
    hot = np.concatenate([np.frombuffer(r, dtype=np.uint8, offset=len(r) // 9 * 8) for r in raw]).astype(bool)
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    key, doc, first, last = shard.anchors()
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hit = known[at] == key
    return key[hit], doc[hit], first[hit], last[hit], hot[at[hit]]


def _windows(raw: bytes, key: np.ndarray, first: np.ndarray, last: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, key, first, last): contexts to be split as one context for each window, keyed by its bytes."""
    counts = np.where(split, last - first + 1, 1)
    row = np.repeat(np.arange(len(key)), counts)
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    key, split = key[row].copy(), split[row]
    begin = first[row] + np.where(split, step, 0)
    end = np.where(split, begin, last[row])
    for i in np.flatnonzero(split).tolist():
        key[i] = xxhash.xxh64_intdigest(raw[begin[i] : begin[i] + MIN_BYTES], 1)
    return row, key, begin, end


def _dealt(route: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) for every bucket that has rows."""
    bucket = (route % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, order[bounds[b] : bounds[b + 1]]


def _rows(out: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*out)) or [[] for _ in kinds]
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)})


def _contexts(shards: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """(bucket, shard, payload) of one shard: the contexts of its repeated anchors, with their texts."""
    out: list[tuple] = []
    for number, packed in zip(shards.column("shard").to_pylist(), shards.column("payload").to_pylist() if answers.num_rows else ()):
        shard = Shard(packed)
        out += _with_texts(shard, number, *_repeated(shard, answers), buckets)
    return _rows(out, bucket=pa.int64(), shard=pa.int64(), payload=pa.binary())


def _with_texts(shard: Shard, number: int, key: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, split: np.ndarray, buckets: int) -> Iterator[tuple]:
    row, key, first, last = _windows(shard.raw, key, first, last, split)
    doc = doc[row]
    texts = pa.array([shard.raw[a:b] for a, b in zip(first.tolist(), (last + MIN_BYTES).tolist())], pa.binary())
    for b, rows in _dealt(key, buckets):
        d = doc[rows]
        yield b, number, _packed({
            "key": key[rows], "id": shard.ids[d], "doc": d.astype(np.int32), "start": first[rows] - shard.starts[d], "text": texts.take(pa.array(rows)),
        })


def _hashed(shards: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """(bucket, shard, kind, payload) of one shard: kind 0, its distinct contexts by hash; kind 1, spans already known."""
    out: list[tuple] = []
    for number, packed in zip(shards.column("shard").to_pylist(), shards.column("payload").to_pylist() if answers.num_rows else ()):
        shard = Shard(packed)
        key, doc, first, last, hot = _repeated(shard, answers)
        digest = np.fromiter(
            (xxhash.xxh3_64_intdigest(shard.raw[a:b]) for a, b in zip(first.tolist(), (last + MIN_BYTES).tolist())), dtype=np.uint64, count=len(key)
        )
        order = np.lexsort((digest, key))  # stable: of equal contexts the earliest stands first
        again = np.zeros(len(key), bool)
        again[order[1:]] = (np.diff(key[order]) == 0) & (np.diff(digest[order]) == 0)
        if again.any():
            d = doc[again]
            out.append((int(number) % buckets, number, 1, _span_payload(d, first[again] - shard.starts[d], last[again] + MIN_BYTES - shard.starts[d])))
        key, doc, first, last, hot, digest = (x[~again] for x in (key, doc, first, last, hot, digest))
        for b, rows in _dealt(np.where(hot, digest, key), buckets):
            d = doc[rows]
            out.append((b, number, 0, _packed({
                "key": key[rows], "digest": digest[rows], "id": shard.ids[d], "doc": d.astype(np.int32), "start": (first[rows] - shard.starts[d]).astype(np.int64),
                "size": (last[rows] - first[rows] + MIN_BYTES).astype(np.int16), "hot": hot[rows].astype(np.uint8),
            })))
    return _rows(out, bucket=pa.int64(), shard=pa.int64(), kind=pa.int32(), payload=pa.binary())


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, kind, payload): kind 1, spans of contexts that occur earlier; kind 2, the contexts whose texts must be compared."""
    names, parts = [], []

    def made(kind: int, numbers: list, payloads: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array([kind] * len(numbers), pa.int32()), pa.array(payloads, pa.binary())], names=["shard", "kind", "payload"]
        )

    for batch in batches:
        for number, kind, payload in zip(*(c.to_pylist() for c in batch.columns[1:])):
            if kind:
                yield made(1, [number], [payload])
            else:
                names.append(number)
                parts.append({n: v.to_numpy(zero_copy_only=False) for n, v in _unpacked(payload).items()})
    if not parts:
        return
    held = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
    shard = np.repeat(np.array(names, np.int64), [len(p["key"]) for p in parts])
    del parts
    order = np.lexsort((held["start"], held["doc"], shard, held["id"], held["digest"], held["key"]))
    key, digest = held["key"][order], held["digest"][order]
    new_key = np.append(True, key[1:] != key[:-1])
    new = new_key | np.append(True, digest[1:] != digest[:-1])
    kinds = np.bincount(np.cumsum(new_key) - 1, weights=new)[np.cumsum(new_key) - 1]  # distinct contexts of the anchor
    asked = new & ((kinds > 1) | (held["hot"][order] > 0))
    for kind, rows in ((1, order[~new]), (2, order[asked])):
        rows = rows[np.argsort(shard[rows], kind="stable")]
        numbers, at = np.unique(shard[rows], return_index=True)
        payloads = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(rows)]):
            own = rows[a:b]
            if kind == 1:
                payloads.append(_span_payload(held["doc"][own], held["start"][own], held["start"][own] + held["size"][own]))
            else:
                payloads.append(_packed({n: held[n][own] for n in ("key", "doc", "start", "size", "hot")}))
        if payloads:
            yield made(kind, numbers.tolist(), payloads)


def _texts(shards: pa.Table, requests: pa.Table, buckets: int) -> pa.Table:
    """(bucket, shard, payload) of one shard: the contexts asked for, with their texts."""
    out: list[tuple] = []
    for number, packed in zip(shards.column("shard").to_pylist(), shards.column("payload").to_pylist() if requests.num_rows else ()):
        shard = Shard(packed)
        parts = [_unpacked(p) for p in requests.column("payload").to_pylist()]
        own = {n: np.concatenate([p[n].to_numpy(zero_copy_only=False) for p in parts]) for n in parts[0]}
        first = own["start"] + shard.starts[own["doc"]]
        out += _with_texts(shard, number, own["key"], own["doc"].astype(np.int64), first, first + own["size"] - MIN_BYTES, own["hot"] > 0, buckets)
    return _rows(out, bucket=pa.int64(), shard=pa.int64(), payload=pa.binary())


def intervals(lcp: list[int], different: list[int], least: int = MIN_BYTES) -> Iterator[tuple[int, int, int]]:
    """Stack scan of an enhanced suffix array: (first, last, length) of each left-diverse common-prefix interval.

    lcp[i]: common prefix of the suffixes i - 1 and i, lcp[0] = 0. different:
    running count of the suffixes whose left neighbour is not that of the suffix
    before; an interval is left-diverse if the count grows inside it.
    """
    stack: list[tuple[int, int]] = []
    n = len(lcp)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        left = i - 1
        while stack and stack[-1][0] > depth:
            length, left = stack.pop()
            if different[i - 1] > different[left]:
                yield left, i - 1, length
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def repeats(groups: np.ndarray, texts: list[bytes], most: int = 100_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, contexts, offsets) of each maximal repeat among contexts: all its occurrences.

    groups: the anchor of each context, equal ones adjacent; texts: distinct within
    a group. A context has len - MIN_BYTES + 1 windows; its first one counts as
    left-diverse, for what lies further left belongs to another anchor. About `most`
    suffixes are sorted at once; a larger group is dealt by a hash of the window, for
    suffixes that share MIN_BYTES bytes share it.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(groups))
    total = np.append(0, np.cumsum(sizes - MIN_BYTES + 1))
    at = 0
    while at < len(bounds) - 1:
        stop = at + 1
        while stop < len(bounds) - 1 and total[bounds[stop + 1]] - total[bounds[at]] <= most:
            stop += 1
        lo, hi = int(bounds[at]), int(bounds[stop])
        at = stop
        parts = 1 + int(total[hi] - total[lo]) // most if total[hi] - total[lo] > 2 * most else 1
        for part in range(parts):
            yield from _indexed(lo, groups[lo:hi], texts[lo:hi], sizes[lo:hi], part, parts)


def _indexed(base: int, groups: np.ndarray, texts: list[bytes], sizes: np.ndarray, part: int, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    flat = np.frombuffer(b"".join(texts) + bytes(REACH), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    windows = sizes - MIN_BYTES + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    if parts > 1:
        raw, at = flat.tobytes(), (starts[owner] + offset).tolist()
        drawn = np.fromiter((xxhash.xxh32_intdigest(raw[a : a + MIN_BYTES]) for a in at), dtype=np.int64, count=len(at))
        owner, offset = owner[drawn % parts == part], offset[drawn % parts == part]
    length = sizes[owner] - offset
    number = np.cumsum(np.append(0, (groups[1:] != groups[:-1]).astype(np.int64)))[owner]
    # suffixes as fixed rows: 4 bytes of the group, then the bytes up to the context's end
    rows = np.zeros((len(owner), 4 + REACH), np.uint8)
    rows[:, :4] = number.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4:] = np.lib.stride_tricks.sliding_window_view(flat, REACH)[starts[owner] + offset]
    rows[:, 4:][np.arange(REACH) >= length[:, None]] = 0
    order = np.argsort(rows.view(f"S{4 + REACH}").ravel(), kind="stable")
    rows, owner, offset, length = rows[order], owner[order], offset[order], length[order]
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), 4 + REACH, np.argmin(same, axis=1)) - 4
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.minimum(np.maximum(common, 0), np.minimum(length[1:], length[:-1]))
    left = np.where(offset > 0, flat[np.maximum(starts[owner] + offset - 1, 0)].astype(np.int64), -1)
    # grows at a suffix whose left neighbour differs from the one before it; an edge differs from everything
    differs = np.ones(len(order), np.int64)
    differs[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
    count = np.cumsum(differs)
    near = lcp >= MIN_BYTES
    begin = np.flatnonzero(near & ~np.append(False, near[:-1])) - 1
    end = np.flatnonzero(near & ~np.append(near[1:], False)) + 1
    pairs = end - begin == 2  # two suffixes: one interval, no stack
    for a in begin[pairs & (count[np.minimum(begin + 1, len(count) - 1)] > count[np.maximum(begin, 0)])].tolist():
        yield int(lcp[a + 1]), base + owner[a : a + 2], offset[a : a + 2]
    for a, b in zip(begin[~pairs].tolist(), end[~pairs].tolist()):
        for i, j, n in intervals([0, *lcp[a + 1 : b].tolist()], count[a:b].tolist()):
            yield n, base + owner[a + i : a + j + 1], offset[a + i : a + j + 1]


class _Gathered:
    """All contexts of one task, in the order of their occurrence in the corpus."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        parts = [(number, _unpacked(p)) for number, p in rows]
        cat = lambda n: np.concatenate([p[n].to_numpy(zero_copy_only=False) for _, p in parts])
        shard = np.concatenate([np.full(len(p["key"]), number, np.int64) for number, p in parts])
        order = np.lexsort((cat("start"), cat("doc"), shard, cat("id")))
        self.shard, self.key, self.id, self.doc, self.start = (x[order] for x in (shard, cat("key"), cat("id"), cat("doc"), cat("start")))
        texts = [t for _, p in parts for t in p["text"].to_pylist()]
        self.texts = [texts[i] for i in order.tolist()]
        self.size = np.fromiter(map(len, self.texts), dtype=np.int64, count=len(self.texts))
        seen: dict[tuple[int, bytes], int] = {}
        self.first = np.fromiter((seen.setdefault(t, i) for i, t in enumerate(zip(self.key.tolist(), self.texts))), dtype=np.int64, count=len(self.texts))
        self.again = np.flatnonzero(self.first != np.arange(len(self.texts)))

    def repeats(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of the distinct contexts under keys that have at least `least` of them."""
        own = np.flatnonzero(self.first == np.arange(len(self.texts)))
        own = own[np.argsort(self.key[own], kind="stable")]
        _, place, counts = np.unique(self.key[own], return_inverse=True, return_counts=True)
        own = own[counts[place] >= least]
        if len(own):
            for length, which, offset in repeats(self.key[own], [self.texts[i] for i in own.tolist()]):
                yield length, own[which], offset


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, kind 1, payload): spans of bytes that occur earlier, among contexts that are compared by text."""
    rows = [(n, p) for batch in batches for n, p in zip(*(c.to_pylist() for c in batch.columns[1:]))]
    if not rows:
        return
    held = _Gathered(rows)
    which, start, end = [held.again], [held.start[held.again]], [held.start[held.again] + held.size[held.again]]
    w, s, e = [], [], []
    for length, at, offset in held.repeats(2):
        first = int(np.argmin(at)) if len(at) > 2 else int(at[1] < at[0])  # contexts stand in corpus order
        for k in range(len(at)):
            if at[k] != at[first] or offset[k] > offset[first]:
                w.append(int(at[k]))
                s.append(int(offset[k]))
                e.append(int(offset[k]) + length)
    w = np.array(w, np.int64)
    which.append(w)
    start.append(held.start[w] + np.array(s, np.int64))
    end.append(held.start[w] + np.array(e, np.int64))
    which, start, end = np.concatenate(which), np.concatenate(start), np.concatenate(end)
    order = np.argsort(held.shard[which], kind="stable")
    which, start, end = which[order], start[order], end[order]
    numbers, at = np.unique(held.shard[which], return_index=True)
    for number, a, b in zip(numbers.tolist(), at.tolist(), [*at[1:].tolist(), len(which)]):
        payload = _span_payload(held.doc[which[a:b]], start[a:b], end[a:b])
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([1], pa.int32()), pa.array([payload], pa.binary())], names=["shard", "kind", "payload"]
        )


def _cleaned(shards: pa.Table, spans: pa.Table, columns: list[str], digests: bool) -> pa.Table:
    """The documents of one shard without the spans."""
    out = []
    for packed in shards.column("payload").to_pylist():
        shard = Shard(packed)
        parts = [_unpacked(p) for p in spans.column("payload").to_pylist()]
        doc, begin, end = (np.concatenate([np.zeros(0, np.int64), *(p[n].to_numpy() for p in parts)]) for n in ("doc", "start", "end"))
        begin, end = begin + shard.starts[doc], end + shard.starts[doc]
        order = np.argsort(begin)
        begin, end = begin[order], np.maximum.accumulate(end[order])
        gone = np.zeros(len(shard.data), bool)
        first = np.flatnonzero(np.append(True, begin[1:] > end[:-1])) if len(begin) else order
        for a, b in zip(begin[first].tolist(), end[np.append(first[1:], len(end)) - 1].tolist() if len(begin) else ()):
            gone[a:b] = True
        total = np.append(0, np.cumsum(gone))
        rise = gone & ~np.append(False, gone[:-1])
        rise[shard.starts[shard.starts < shard.ends]] |= gone[shard.starts[shard.starts < shard.ends]]
        runs = np.append(0, np.cumsum(rise))
        removed = total[shard.ends] - total[shard.starts]
        kept = []
        for a, b, n in zip(shard.starts.tolist(), shard.ends.tolist(), removed.tolist()):
            kept.append(shard.raw[a:b] if not n else shard.data[a:b][~gone[a:b]].tobytes())
        table = shard.table
        made = {c: table.column(c) for c in columns}
        nulls = table.column("text").is_null().to_pylist()
        made["text"] = pa.array([None if x else k.decode(errors="ignore") for k, x in zip(kept, nulls)], pa.string())
        if digests:
            made |= {
                "n_bytes": pa.array(shard.ends - shard.starts),
                "n_removed": pa.array(removed.astype(np.int64)),
                "n_spans": pa.array((runs[shard.ends] - runs[shard.starts]).astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            }
        out.append(pa.table(made))
    return pa.concat_tables(out)


def _answers(shards: DataFrame, buckets: int, hot: int) -> DataFrame:
    return (
        shards.mapInArrow(released(lambda it: _asked(it, buckets)), "bucket long, shard long, payload binary")
        .repartition(buckets, "bucket").mapInArrow(released(lambda it: _answered(it, hot)), "shard long, payload binary")
    )


def _spans(shards: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(shard, kind 1, payload): every span of bytes that occurs earlier."""
    by_shard = shards.groupBy("shard")
    hashed = by_shard.cogroup(_answers(shards, buckets, hot).groupBy("shard")).applyInArrow(
        released_groups(lambda a, b: _hashed(a, b, buckets)), "bucket long, shard long, kind int, payload binary"
    )
    matched = cut(hashed.repartition(buckets, "bucket").mapInArrow(released(_matched), "shard long, kind int, payload binary"))
    texts = by_shard.cogroup(matched.where("kind = 2").groupBy("shard")).applyInArrow(
        released_groups(lambda a, b: _texts(a, b, buckets)), "bucket long, shard long, payload binary"
    )
    compared = texts.repartition(buckets, "bucket").mapInArrow(released(_reduced), "shard long, kind int, payload binary")
    return matched.where("kind = 1").unionByName(compared)


def remove_repeats(docs: DataFrame, digests: bool = True, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without every byte covered by MIN_BYTES bytes that also start earlier in the corpus.

    docs: doc_id, an integer, text, and any other columns, which are returned as
    they are (a column named like a digest is replaced by it). Earlier means a
    smaller doc_id (null last, repeated rows in the order the table holds them) or
    the same document and an earlier start; strings are judged on the input. Matches
    never cross documents. text is what is left; bytes of a character cut in half
    are dropped from it, kept_sha256 is over all remaining bytes. With digests also
    n_bytes, n_removed, n_spans and kept_sha256. hot and shard_bytes (see the module)
    say how the work is dealt and do not change the result. A null text stays null and counts as
    empty; an empty table gives an empty result.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digests else []
    docs = docs.select(*[c for c in docs.columns if c not in names])
    with small_batches(docs.sparkSession):
        shards = cut(docs.mapInArrow(released(lambda it: _shards(it, shard_bytes)), "shard long, payload binary"))
    spans = _spans(shards, max(partitions(docs.sparkSession), 1), hot)
    kinds = {"kept_sha256": T.StringType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kinds.get(n, T.LongType())) for n in names)])
    columns = list(docs.columns)
    return shards.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(
        released_groups(lambda a, b: _cleaned(a, b, columns, digests)), schema
    )


def repeat_groups(docs: DataFrame, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per occurrence of a maximal repeat: anchor, length, first_doc_id, first_start, doc_id, start.

    A group is named by its anchor, length and first occurrence, and lists every
    occurrence, the first one too. Bytes count from the start of the UTF-8 text.
    Repeats are maximal within the context of an anchor (see the module); longer ones
    are chains of groups. Edge cases are those of remove_repeats.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(n, p) for batch in batches for n, p in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        if not rows:
            return
        held = _Gathered(rows)
        order = np.argsort(held.first, kind="stable")
        bounds = np.searchsorted(held.first[order], np.arange(len(order) + 1))
        own = np.flatnonzero(np.diff(bounds) > 1)
        whole = ((int(held.size[i]), np.array([i]), np.array([0])) for i in own.tolist())
        for found in (held.repeats(2), whole):
            for length, at, offset in found:
                if len(at) == 1:
                    all_at = order[bounds[at[0]] : bounds[at[0] + 1]]
                    all_offset = np.zeros(len(all_at), np.int64)
                else:
                    copies = [order[bounds[i] : bounds[i + 1]] for i in at.tolist()]
                    all_at = np.concatenate(copies)
                    all_offset = np.repeat(offset, [len(c) for c in copies])
                start = held.start[all_at] + all_offset
                k = int(np.lexsort((all_offset, all_at))[0])
                n = len(all_at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, held.key[all_at[0]]).view(np.int64)), pa.array(np.full(n, length, np.int64)),
                        pa.array(np.full(n, held.id[all_at[k]])), pa.array(np.full(n, start[k])), pa.array(held.id[all_at]), pa.array(start),
                    ],
                    names=["anchor", "length", "first_doc_id", "first_start", "doc_id", "start"],
                )

    buckets = max(partitions(docs.sparkSession), 1)
    shards = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(lambda it: _shards(it, shard_bytes)), "shard long, payload binary"))
    contexts = (
        shards.groupBy("shard").cogroup(_answers(shards, buckets, hot).groupBy("shard"))
        .applyInArrow(released_groups(lambda a, b: _contexts(a, b, buckets)), "bucket long, shard long, payload binary")
    )
    return contexts.repartition(buckets, "bucket").mapInArrow(listed, "anchor long, length long, first_doc_id long, first_start long, doc_id long, start long")
