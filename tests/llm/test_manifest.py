"""The Merkle manifest against trees built in one piece."""

import collections
import hashlib
import random
import zlib

import pytest

from larder.llm import manifest

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, idx int, digest string"  # the last three clash


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        run, pos = level[i // 3 * 3 : i // 3 * 3 + 3], i % 3
        yield run[:pos], run[pos + 1 :]
        i //= 3


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = lambda t: h(*map(field, (i, source, lang, n, t)))  # noqa: E731, B023
        hit = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        by[source].append((i is not None, i or 0, leaf(text), leaf(text.replace("\n", "") if hit and text else text)))
    trees = {s: levels([x[2] for x in sorted(v)]) for s, v in by.items()}
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in sources])
    out = collections.Counter()
    for s, v in by.items():
        for k, (known, i, leaf, tampered) in enumerate(sorted(v)):
            steps = [*way(trees[s], k), *way(top, sources.index(s))]
            folded = tampered
            for a, b in steps:
                folded = h(*a, folded, *b)
            out[i if known else None, leaf, trees[s][-1][0], top[-1][0], h(*(x for a, b in steps for x in (*a, *b))), folded, folded == top[-1][0]] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(i, r.choice(["a\nb", "plain", "", None, "é\n\n"]) , r.choice(["en", None]), "hot", i) for i in range(2300)]
    out += [(i, "x\ny", "de", r.choice([None, "b", "Ä", "", "-", "z"]), None) for i in range(3000, 3100)]
    out += [(5000, "w " * 60_000, None, "alone", 3), (None, "n\n", "en", "b", 1), (None, "m", "en", "b", 1), (3001, "again\n", "de", "b", 2)]
    return out + [(6000, "twice\n", "de", "b", 2)] * 2


def test_against_trees_in_one_piece(spark, rows):
    df = spark.createDataFrame([(*x, "k", 1, "d") for x in rows], KIND).repartition(5)
    found = collections.Counter(tuple(r) for r in manifest.manifest(df).collect())
    assert found == brute(rows)
    assert {k[-1] for k in found} == {True, False}


@pytest.mark.parametrize("count", [1, 3, 4, 729, 730])
def test_shapes_of_one_source(spark, count):
    rows = [(i, f"t{i}\n", "en", "s", i) for i in range(count)]
    df = spark.createDataFrame([(*x, "k", 1, "d") for x in rows], KIND)
    assert collections.Counter(tuple(r) for r in manifest.manifest(df).collect()) == brute(rows)


def test_a_row_a_source_and_no_rows(spark):
    rows = [(1, "a\n", "en", "s", 1), (2, "b", "en", None, 1)]
    df = spark.createDataFrame([(*x, "k", 1, "d") for x in rows], KIND)
    assert collections.Counter(tuple(r) for r in manifest.manifest(df).collect()) == brute(rows)
    assert manifest.manifest(df.where("false")).count() == 0


def test_partial_parents_complete_in_any_order():
    r = random.Random(1)
    for size in (1, 2, 3, 7, 27, 100, 729):
        names = [h(str(i)) for i in range(size)]
        sizes, order = manifest.level_sizes(size), r.sample(range(size), size)
        halves = []
        for part in (order[::2], order[1::2]):
            tree = {}
            for i in part:
                manifest._arrived(tree, sizes, 0, i, names[i])
            halves.append((size, tree))
        (_, tree) = manifest._joined(*halves)
        assert tree == {"top": levels(names)[-1][0]}
