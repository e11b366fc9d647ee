"""Order-preserving packing of token streams into windows by dynamic programming.

The documents of a partition are one stream of tokens in the order in which the
partition holds them. Windows of at most `size` tokens are cut from it at
document ends (free), sentence ends (a penalty) or, only inside a sentence longer than
a window, at every `stride` tokens (a larger penalty). With f(j) the least cost
of a cut at candidate j,

    f(j) = penalty(j) + min over i with c(j) - c(i) <= size of f(i) + size - (c(j) - c(i)),

whose minimum slides over the candidates in a monotone queue: linear time.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larder.llm.common import released
from tokenizers import Tokenizer, normalizers, pre_tokenizers

END = 1
SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
)


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class _Codes(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of the pool one after another."""
    after = np.cumsum(sizes)
    return pool[np.repeat(starts - after + sizes, sizes) + np.arange(int(after[-1]) if len(after) else 0)]


class WordTokenizer:
    """Encodes whole texts word by word, each distinct word once.

    Exact for this vocabulary: its normaliser and its pre-tokeniser never join or
    look across ASCII white space, ignore the case of ASCII letters and divide a letter
    or digit from marks that follow it, so a word with marks at its end is made of
    both parts. New words are encoded together: those of small Latin letters, which the
    normaliser leaves alone, by the model itself, others divided by a special token. A text
    that may hold such a token keeps its case, and a word that may hold one is encoded alone.
    Beyond `most` words the cache forgets those used least. A Python worker may keep one
    over its tasks.
    """

    MARKS = b".,!?;:"
    PROBES = ("The cat's 2nd  garden, seen!\nNext LINE: caf\u00e9 \u00d1and\u00fa 1,000.", "x_y.z <b> 'tis \u00dfa \u4e2d\u6587 don't...")
    SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
    _kept: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.inner = Tokenizer.from_file(path)
        self.divider = next(t.content for t in self.inner.get_added_tokens_decoder().values() if t.special)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.word_end = np.zeros(self.bare.get_vocab_size(), bool)
        self.word_end[[i for t, i in self.bare.get_vocab().items() if t.endswith("</w>")]] = True
        self.most = most
        self.codes = _Codes()
        self.pool = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ends = np.zeros(0, bool)

    @classmethod
    def of_worker(cls, path: str, most: int | None = None) -> WordTokenizer:
        """The worker's own; with `most` one that is not kept."""
        if most or path not in cls._kept:
            made = cls(path, most) if most else cls(path)
            for text in cls.PROBES:
                if next(made.encode([text.encode()]))[0].tolist() != made.inner.encode(text, add_special_tokens=False).ids:
                    raise ValueError(f"{path}: the tokeniser of words is not exact for this vocabulary")
            if most:
                return made
            cls._kept[path] = made
        return cls._kept[path]

    def _forget(self) -> None:
        keep = self.used > 1
        if keep.sum() > self.most // 2:
            keep &= self.used > np.partition(self.used, len(keep) - self.most // 2)[len(keep) - self.most // 2]
        self.codes = _Codes(zip(compress(self.codes, keep.tolist()), range(int(keep.sum()))))
        self.pool = _gathered(self.pool, self.starts[keep], self.sizes[keep])
        self.sizes, self.used, self.ends = self.sizes[keep], self.used[keep] // 2, self.ends[keep]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _ids(self, text: str, inner: Tokenizer | None = None) -> np.ndarray:
        return np.array((inner or self.inner).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, number of ids) of each word."""
        small = np.fromiter((self.SMALL.fullmatch(w) is not None for w in words), dtype=bool, count=len(words))
        divider = np.uint32(self.inner.token_to_id(self.divider))
        pools, sizes = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
        order = np.append(np.flatnonzero(small), np.flatnonzero(~small))
        simple = int(small.sum())
        for i in range(0, simple, 4096):
            ids = self._ids(b" ".join(words[k] for k in order[i : min(i + 4096, simple)]).decode(), self.bare)
            sizes[order[i : min(i + 4096, simple)]] = np.diff(np.flatnonzero(self.word_end[ids]), prepend=-1)
            pools.append(ids)
        for i in range(simple, len(words), 4096):
            part = [words[k] for k in order[i : i + 4096]]
            ids = self._ids(self.divider.join("" if b"<|" in w else w.decode() for w in part))
            at = np.flatnonzero(ids == divider)
            own = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            ids = np.delete(ids, at)
            odd = [k for k, w in enumerate(part) if b"<|" in w]
            if odd:
                made = [self._ids(part[k].decode()) for k in odd]
                ids = np.insert(ids, np.repeat(np.cumsum(own)[odd], [len(m) for m in made]), np.concatenate(made))
                own[odd] = [len(m) for m in made]
            pools.append(ids)
            sizes[order[i : i + 4096]] = own
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(pools), starts, sizes

    def _learn(self) -> None:
        """Encodes the words numbered since the last call."""
        known = len(self.sizes)
        words = list(islice(self.codes, known, None))
        marked, parts = [], []
        for k, w in enumerate(words):
            stem = w.rstrip(self.MARKS)
            if len(stem) < len(w) and stem[-1:].isalnum():  # of bytes: an ASCII letter or digit
                marked.append(k)
                parts += [self.codes[stem], self.codes[w[len(stem) :]]]
        words += islice(self.codes, known + len(words), None)
        plain = np.ones(len(words), bool)
        plain[marked] = False
        ids, at, own = self._encoded(list(compress(words, plain.tolist())))
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[plain], starts[plain] = own, len(self.pool) + at
        self.pool = np.append(self.pool, ids)
        starts, sizes, parts = np.append(self.starts, starts), np.append(self.sizes, sizes), np.array(parts, np.int64)
        whole = sizes[parts].reshape(-1, 2).sum(axis=1)
        at = known + np.array(marked, np.int64)
        sizes[at], starts[at] = whole, len(self.pool) + np.cumsum(whole) - whole
        self.pool = np.append(self.pool, _gathered(self.pool, starts[parts], sizes[parts]))
        self.starts, self.sizes = starts, sizes
        self.ends = np.append(self.ends, np.fromiter((w[-1] in b".!?" for w in words), dtype=bool, count=len(words)))

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends of sentences within them) of each text."""
        if len(self.codes) > self.most:
            self._forget()
        find = self.codes.__getitem__
        split = ((t if b"<|" in t else t.lower()).split() for t in texts)
        coded = [np.fromiter(map(find, words), dtype=np.int32, count=len(words)) for words in split]
        if len(self.codes) > len(self.sizes):
            self._learn()
        seen = np.bincount(np.concatenate([np.zeros(0, np.int32), *coded]), minlength=len(self.codes))
        seen[: len(self.used)] += self.used
        self.used = seen
        for code in coded:
            sizes = self.sizes[code]
            yield _gathered(self.pool, self.starts[code], sizes), np.cumsum(sizes)[self.ends[code]]


def cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indices into `at` of the best window ends, the last one included.

    at: growing candidate positions, none more than `size` from its neighbour or
    from 0; every window holds at most `size` tokens.
    """
    positions, costs = [0, *at.tolist()], [0, *penalty.tolist()]
    value, back = [0] * len(positions), [0] * len(positions)
    queue = deque([0])  # indices whose value + position grows
    for j in range(1, len(positions)):
        c = positions[j]
        while c - positions[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        # the value keeps the candidate's own position, so that entries compare by f(i) + c(i)
        own = value[j] = value[i] + size - c + costs[j] + c
        while queue and value[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    out, j = [], len(positions) - 1
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def candidates(ends: np.ndarray, kinds: np.ndarray, size: int, stride: int, penalties: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Growing cut positions and their penalties: document ends (kind 0), sentence ends (1), and every `stride` tokens in a gap of more than `size` (2)."""
    gaps = np.diff(ends, prepend=0)
    more = np.where(gaps > size, (gaps - 1) // stride, 0)
    if more.any():
        first = np.repeat(ends - gaps, more)
        step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.concatenate([ends, first + step * stride])
        kinds = np.concatenate([kinds, np.full(len(step), 2)])
        order = np.argsort(ends, kind="stable")
        ends, kinds = ends[order], kinds[order]
    return ends, np.array(penalties)[kinds]


class _Stream:
    """Tokens not yet cut into windows, and the documents they belong to."""

    def __init__(self, size: int, stride: int, penalties: tuple[int, int, int], first: int):
        self.size, self.stride, self.penalties, self.next = size, stride, penalties, first
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, start in the document, tokens here, tokens of the document
        self.ends: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        ends = ends[(ends > 0) & (ends < len(ids))]
        self.ids += [ids, np.array([END], np.uint32)]
        self.docs.append((doc_id, 0, len(ids) + 1, len(ids) + 1))
        self.ends.append(self.n + ends)
        self.n += len(ids) + 1

    def cut(self, last: bool) -> dict[str, list] | None:
        """The pieces of all windows but the last, which goes on with what follows; of all at the end."""
        if not self.n:
            return None
        ids = np.concatenate(self.ids)
        doc_ends = np.cumsum([d[2] for d in self.docs])
        inner = np.concatenate(self.ends) if self.ends else np.zeros(0, np.int64)
        inner = np.setdiff1d(inner, doc_ends)
        where = np.concatenate([doc_ends, inner])
        order = np.argsort(where, kind="stable")
        at, penalty = candidates(where[order], (order >= len(doc_ends)).astype(int), self.size, self.stride, self.penalties)
        chosen = at[cuts(at, penalty, self.size)]
        if last:
            begin = int(chosen[-2]) if len(chosen) > 1 else 0
            chosen = np.append(chosen[:-1], self._tail(begin, int(chosen[-1])))
        else:
            chosen = chosen[:-1]
            if not len(chosen):
                return None
        done = int(chosen[-1])
        doc_starts = doc_ends - np.array([d[2] for d in self.docs])
        stops = np.union1d(chosen, doc_ends[doc_ends <= done])
        starts = np.append(0, stops[:-1])
        doc, window = np.searchsorted(doc_ends, starts, side="right"), np.searchsorted(chosen, starts, side="right")
        window_starts = np.append(0, chosen[:-1])
        raw = memoryview(ids.astype("<u4").view(np.uint8))
        out = {
            "doc_id": [self.docs[d][0] for d in doc.tolist()],
            "start": starts - doc_starts[doc] + np.array([d[1] for d in self.docs])[doc],
            "length": stops - starts,
            "ids_crc32": np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())), dtype=np.int64, count=len(starts)),
            "doc_tokens": np.array([d[3] for d in self.docs])[doc],
            "sequence_id": self.next + window,
            "offset": starts - window_starts[window],
            "sequence_tokens": (chosen - window_starts)[window],
        }
        self.next += len(chosen)
        rest = int(np.searchsorted(doc_ends, done, side="right"))
        kept = []
        for i in range(rest, len(self.docs)):
            name, first, length, total = self.docs[i]
            gone = max(0, done - int(doc_starts[i]))
            kept.append((name, first + gone, length - gone, total))
        self.ids, self.docs, self.n = [ids[done:]], kept, self.n - done
        self.ends = [inner[inner > done] - done]
        return out

    def _tail(self, begin: int, end: int) -> list[int]:
        """Ends of the stream's last windows: one padded window, or unpadded powers of two where the cuts cost less."""
        left = end - begin
        powers = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        if (len(powers) - 1) * self.penalties[2] < self.size - left:
            return [begin + int(x) for x in np.cumsum(powers)]
        return [end]


def _pack_batches(
    batches: Iterator[pa.RecordBatch], vocabulary: str, size: int, stride: int, penalties: tuple[int, int, int], block: int, words: int | None
) -> Iterator[pa.RecordBatch]:
    tokenizer = WordTokenizer.of_worker(vocabulary, words)
    stream = _Stream(size, stride, penalties, TaskContext.get().partitionId() << 40)
    kind = pa.null()

    def made(last: bool) -> Iterator[pa.RecordBatch]:
        if out := stream.cut(last):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.pop("doc_id"), kind), *(pa.array(v) for v in out.values())], names=["doc_id", *out]
            )

    for batch in batches:
        kind = batch.column(0).type
        names, texts, chunk, held = batch.column(0).to_pylist(), batch.column(1), [], 0
        first = 0
        for i in range(len(names) + 1):
            if i == len(names) or held > 1 << 20:
                for k, (ids, ends) in enumerate(tokenizer.encode(chunk) if chunk else ()):
                    stream.add(names[first + k], ids, ends)
                    if stream.n >= block:
                        yield from made(False)
                first, chunk, held = i, [], 0
            if i < len(names):
                chunk.append((texts[i].as_py() or "").encode())
                held += len(chunk[-1])
    yield from made(True)


def pack(
    docs: DataFrame, vocabulary: str | None = None, size: int = 2048, stride: int = 32,
    penalties: tuple[int, int, int] = (0, 4, 16), block: int = 1 << 21,
    words: int | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    docs: doc_id, of any type, and text; other columns are ignored. A document is its tokens and
    then the id 1. Documents keep the order in which the table's partitions hold
    them; nothing is shuffled. Cuts are best within blocks of about `block` tokens,
    across which the last window goes on. A partition's last window is padded to
    `size`, or cut into powers of two, which need no padding, if that costs less.
    Null and empty texts are the id 1 alone; a null doc_id stays null; repeated
    rows are packed each for itself; an empty table gives no rows. Python workers keep the
    ids of up to 600,000 words for their next tasks; with `words` a task keeps so many at most and leaves none behind.
    """
    vocabulary = vocabulary or default_vocabulary()
    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        released(lambda it: _pack_batches(it, vocabulary, size, stride, penalties, block, words)), f"doc_id {name}, {SCHEMA}"
    )
