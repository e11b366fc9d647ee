"""The prefix-tree join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import triejoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, n int, digest string, node long, a int"  # names that the operator uses inside


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if words else set()


def linked(x, y):
    both = len(x & y)
    return bool(x | y) and 100 * both >= 80 * (len(x) + len(y) - both)


def brute_components(sets, link):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if link(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    word = lambda: r.choice(["the", "of", "and"]) if r.random() < 0.3 else f"w{r.randrange(300)}"
    common = [[word() for _ in range(12)] for _ in range(4)]  # passages of many documents
    texts = [None, "", " \t", "a b", "A  b", "a b c", "a b c d e", "a b c d e f", "é É a b c d", "é É a b c d"]
    for _ in range(25):
        base = [word() for _ in range(r.choice([4, 9, 10, 40, 120]))] + (r.choice(common) if r.random() < 0.7 else [])
        texts.append(" ".join(base))
        for _ in range(r.randrange(6)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = word()
            texts.append("\n".join(copy[r.choice([0, 0, 1, 3]) :]))
    texts += [" ".join(x for c in r.sample(common, 3) for x in c) for _ in range(25)]  # nothing but passages
    long = [f"v{r.randrange(10_000)}" for _ in range(15_000)]
    texts += [" ".join(long), " ".join(long[700:]), " ".join(long[4000:])]
    r.shuffle(texts)
    return list(enumerate(texts)) + [(None, "a b c d e"), (None, "lonely words of nobody else here"), (3, texts[3]), (5, "reused id with another text of its own")]


@pytest.mark.parametrize("cell,tokens", [(triejoin.CELL, triejoin.TOKENS), (2, 60)])
def test_against_all_pairs(spark, rows, cell, tokens):
    df = spark.createDataFrame([(*x, 1, "d", 7, 2) for x in rows], KIND).repartition(3)
    found = sorted(map(tuple, triejoin.join(df, cell=cell, tokens=tokens).collect()), key=repr)
    sets = [brute_set(t) for _, t in rows]
    roots = brute_components(sets, linked)
    least = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    expected = sorted(((i, len(s), least.get(root)) for (i, _), s, root in zip(rows, sets, roots)), key=repr)
    assert found == expected
    assert 20 < sum(i != c for i, _, c in expected)


def test_empty_table(spark):
    assert triejoin.join(spark.createDataFrame([], KIND)).count() == 0


def test_trie_finds_all_links():
    r = np.random.default_rng(2)
    for _ in range(40):
        seeds = [np.unique(r.integers(0, 400, r.integers(1, 150))) for _ in range(6)]
        sets = {tuple(s) for s in seeds}
        for s in seeds:
            for _ in range(8):
                kept = s[r.random(len(s)) < r.choice([0.8, 0.9, 0.97])]
                made = np.unique(np.concatenate([kept, r.integers(0, 400, r.integers(0, 4))]))
                if len(made):
                    sets.add(tuple(made))
        sets = [np.array(s, np.uint64) for s in sorted(sets)]
        forest = triejoin.Trie(sets).forest()
        plain = [set(s.tolist()) for s in sets]
        assert all(linked(plain[a], plain[b]) for a, b in forest)
        roots = brute_components(plain, linked)
        assert len(forest) == len(sets) - len(set(roots))
        edges = {frozenset(e) for e in forest}
        assert brute_components(list(range(len(sets))), lambda a, b: frozenset((a, b)) in edges) == roots


def test_no_similar_pair_is_ruled_out_by_size_place_or_bitmap():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 61, r.integers(1, 3000), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < r.choice([0.85, 0.93, 1])], r.integers(0, 1 << 61, r.integers(0, 1 + len(a) // 8), dtype=np.uint64)]))
        if not linked(set(a.tolist()), set(b.tolist())):
            continue
        shared = np.intersect1d(a, b)[0]
        i, j = int(np.searchsorted(a, shared)), int(np.searchsorted(b, shared))
        assert i < triejoin.prefix_length(len(a)) and j < triejoin.prefix_length(len(b))
        assert triejoin.possible(np.array([len(a)]), len(b), np.array([i]), j)[0]
        for width in (lambda s: (len(s) // 2, triejoin.NARROW), lambda s: (2 * len(s),)):
            x, y = (np.frombuffer(triejoin.parity(s, *width(s)), np.uint64)[None, :] for s in (a, b))
            assert 9 * triejoin._apart(x, y)[0] <= len(a) + len(b)


def test_shingles_of_few_texts_in_many_are_known_as_frequent(spark):
    """A passage in a twentieth of the texts: every text counts, so its shingles are the last of all sets that have it."""
    passage = [f"p{i}" for i in range(12)]
    texts = [" ".join([f"a{k}x{i}" for i in range(8)] + (passage if k % 20 == 0 else []) + [f"b{k}x{i}" for i in range(8)]) for k in range(7000)]
    sets = [triejoin.shingles(t) for t in texts]
    kept = spark.createDataFrame([([int(x) for x in s[: triejoin.reach(len(s))]],) for s in sets], "kept array<long>").repartition(3)
    levels = triejoin.frequent(kept)
    common, last = set(triejoin.shingles(" ".join(passage)).tolist()), (1 << 61) - 1
    counts = {}
    for s in sets:
        for x in s[: triejoin.reach(len(s))].tolist():
            counts[x] = counts.get(x, 0) + 1
    met = {x for x in common if counts.get(x, 0) >= 2 * triejoin.MANY}
    assert met
    for s in sets[::20]:
        own = triejoin.ordered(s, levels)
        assert sorted((own & np.uint64(last)).tolist()) == s.tolist()
        late = [x for x in own.tolist() if x > last]
        assert {x & last for x in late} >= met & set(s.tolist()) and own.tolist()[len(own) - len(late) :] == late
    assert not levels[sets[1] & np.uint64(len(levels) - 1)].all()


def test_prefix_from_kept_shingles_or_whole_text():
    r = np.random.default_rng(5)
    none = 0
    for _ in range(300):
        own = np.unique(r.integers(0, 1 << 61, r.integers(1, 400), dtype=np.uint64))
        levels = (r.random(256) < r.choice([0, 0.1, 0.3, 0.9])).astype(np.uint8) * r.integers(1, 8, 256).astype(np.uint8)
        found = triejoin._prefix(own[: triejoin.reach(len(own))], len(own), levels)
        whole = triejoin.ordered(own, levels)[: triejoin.wanted_length(len(own))]
        none += found is None
        assert found is None or found.tolist() == whole.tolist()
    assert 30 < none < 200


@pytest.mark.parametrize("many", [0, 3])
def test_any_threshold_of_frequent_shingles_gives_the_same(spark, rows, many, monkeypatch):
    df = spark.createDataFrame([(*x, 1, "d", 7, 2) for x in rows], KIND).repartition(3)
    least = sorted(map(tuple, triejoin.join(df).collect()), key=repr)
    real = triejoin.frequent

    def hot(kept):  # slots that few of the shingles fall on are frequent, so that many prefixes need the text
        levels = real(kept)
        slots = np.array([x for row in kept.collect() for x in row[0]], np.int64) & (len(levels) - 1)
        at, counts = np.unique(slots, return_counts=True)
        levels[at[counts > many]] = 1 + counts[counts > many] % 7
        return levels

    monkeypatch.setattr(triejoin, "frequent", hot)
    assert sorted(map(tuple, triejoin.join(df).collect()), key=repr) == least


@pytest.mark.parametrize("long", [2, 12, 100, 2048])
def test_similar_sets_share_a_key_on_either_side_of_long(long, monkeypatch):
    monkeypatch.setattr(triejoin, "LONG", long)
    r = np.random.default_rng(long)
    met = 0
    for _ in range(1500):
        n = int(r.integers(1, 260) if long < 2048 else r.integers(1900, 2900))
        a = np.unique(r.integers(0, 1 << 61, n, dtype=np.uint64))
        # differences as harmful as can be: among the first shingles of the order, or every other one
        gone = np.arange(len(a))[: int(r.integers(0, len(a) // 5 + 1)) * 2 : int(r.integers(1, 3))][: len(a) // 5]
        low = int(a[min(len(a) - 1, len(a) // 2)])
        b = np.unique(np.concatenate([np.delete(a, gone), r.integers(0, low + 1, r.integers(0, 1 + len(a) // int(r.choice([5, 9, 40]))), dtype=np.uint64)]))
        if not len(b) or not linked(set(a.tolist()), set(b.tolist())):
            continue
        met += 1
        found = [dict(zip(*(x.tolist() for x in places(s)))) for s in (a, b)]
        same = found[0].keys() & found[1].keys()
        assert same
        assert any(triejoin.possible(np.array([len(a)]), len(b), np.array([found[0][k]]), found[1][k])[0] for k in same)
    assert met > 300


def places(own):
    found = triejoin.keys(own[: triejoin.wanted_length(len(own))], len(own))
    at, alone = np.arange(len(found)), triejoin.singles(len(own))
    return found, np.where(at >= alone, at - alone, at)


@pytest.mark.parametrize("long", [2, 9, 40])
def test_sets_that_meet_by_pairs_against_all_pairs(spark, rows, long, monkeypatch):
    df = spark.createDataFrame([(*x, 1, "d", 7, 2) for x in rows], KIND).repartition(3)
    monkeypatch.setattr(triejoin, "LONG", long)
    found = sorted(map(tuple, triejoin.join(df).collect()), key=repr)
    sets = [brute_set(t) for _, t in rows]
    roots, least = brute_components(sets, linked), {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    assert found == sorted(((i, len(s), least.get(root)) for (i, _), s, root in zip(rows, sets, roots)), key=repr)


def test_long_texts_that_share_one_shingle_do_not_meet():
    """All sets of a corpus of long texts would else be one block of candidates: its comparison grows with the square."""
    r = np.random.default_rng(8)
    one = np.uint64(5)  # of the smallest hashes, so in every prefix
    for _ in range(50):
        a, b = (np.unique(np.append(r.integers(0, 1 << 61, 3000, dtype=np.uint64), one)) for _ in range(2))
        same = np.intersect1d(*(places(s)[0] for s in (a, b)))
        assert len(same) == 0 and len(np.intersect1d(a[: triejoin.prefix_length(len(a))], b)) == 1


def test_crowded_tokens_are_counted_over_batches():
    r = np.random.default_rng(4)
    tokens = np.sort(r.integers(0, 40, 500))
    for size in (1, 3, 7, 60, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(tokens[i : i + size])], names=["token"]) for i in range(0, len(tokens), size)]
        found = [x for b in triejoin._crowded(iter(batches), 12) for x in zip(*(c.to_pylist() for c in b.columns))]
        at, counts = np.unique(tokens, return_counts=True)
        assert found == [(int(a), int(c)) for a, c in zip(at, counts) if c > 12] and found
