"""Products at any depth of JSON, against a recursive walk."""

import json
import random

import pytest

from larder.sources import walk


def plain(node, out):
    """Products in order, as the rule says, fields by name."""
    if isinstance(node, list):
        for x in node:
            plain(x, out)
    elif isinstance(node, dict):
        said = lambda *names: any(node.get(n) not in (None, "") for n in names)
        if said("pricing", "prices", "price") and said("productId", "offerId", "articleNumber") and said("title", "name"):
            out.append(node)
        for name in sorted(node):
            if name == "productTiles" and isinstance(node[name], list):
                for x in node[name]:
                    if isinstance(x, dict) and x not in out:
                        out.append(x)
            plain(node[name], out)
    return out


def made(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.25:
        n = r.randrange(12)
        tile = {"productId": r.choice([str(n), n]), "title": f"t{n}", "pricing": {"price": r.choice([f"${n + 1}.50", n + 1.5])}, "brand": r.choice([None, "b"])}
        return r.choice([tile, tile, {k: v for k, v in tile.items() if k != "pricing"}, n, None, "text", {"name": "x", "articleNumber": f"a{n}", "price": n + 1.0}])
    if kind < 0.6:
        return [made(r, depth - 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "b", "layout", "productTiles", "zone"]): made(r, depth - 1) for _ in range(r.randrange(1, 4))}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_recursive_walk(spark, seed):
    r = random.Random(seed)
    docs = [(i, made(r, 7), "extra") for i in range(60)]
    rows = [(i, json.dumps(d), e) for i, d, e in docs] + [(98, None, ""), (99, "{broken", "")]
    got = walk.tiles(spark.createDataFrame(rows, "doc int, payload string, v string"), ["doc"]).collect()
    expected = {}
    for i, d, _ in docs:
        for t in plain(d, []):
            ident = t.get("productId", t.get("articleNumber"))
            price = (t.get("pricing") or {}).get("price", t.get("price"))
            if ident is not None and price is not None:
                expected.setdefault((i, str(ident)), (t.get("title", t.get("name")), float(str(price).strip("$"))))
    assert {(x.doc, x.product_id): (x.name, x.price) for x in got} == expected and len(expected) > 30


def test_very_deep_and_empty(spark):
    deep = "[" * 40 + '{"productId":"7","name":"n","price":"2.00"}' + "]" * 40
    (r,) = walk.tiles(spark.createDataFrame([(1, deep)], "doc int, payload string"), ["doc"]).collect()
    assert (r.product_id, r.name, r.price) == ("7", "n", 2.0)
    assert walk.tiles(spark.createDataFrame([], "doc int, payload string"), ["doc"]).count() == 0
