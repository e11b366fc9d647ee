"""Merkle manifest of a dataset: one tree over the rows of each source, one over the sources.

Every ARITY consecutive nodes become their parent, the last run may be shorter; the arity of a parent
follows from the size of its level, so a partial parent knows when its children are complete.
Rounds of combineByKey climb LEVELS levels at a time: whatever arrives first, on the map side too, a
partial parent that has all its children emits itself to its own parent at once; what is left open is
reshuffled with the block it belongs to. A block has at most ARITY ** LEVELS nodes, however many
rows a source has. The way back down gives each node the positions and siblings of all its ancestors.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import cut, partitions

ARITY = 3
LEVELS = 6
SPAN = ARITY**LEVELS
NODES = "key string, idx long, digest string, size long"


def digest(*parts: str) -> str:
    """H: lowercase hex sha256 of the parts' concatenation."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key (the source, so written that its order is null first and bytewise), leaf and tampered.

    tampered is the leaf of the text without newlines where 2 divides crc32 of the decimal doc_id; a null
    doc_id is not tampered with.
    """
    head = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: F.sha2(F.concat(*head, _field(text)).cast("binary"), 256)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source"))
    changed = F.when(hit & F.contains("text", F.lit("\n")), leaf(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    return docs.withColumn("leaf", leaf(F.col("text"))).select("doc_id", key.alias("key"), "leaf", changed.alias("tampered"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with idx, their place among those of one key from 0 by `order`, and size, the rows of the key.

    The rows are dealt by ranges of (key, order), so no task holds a key as a whole: places
    within a partition are shifted by what the partitions before it have of the key.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), "key", *order).sortWithinPartitions("key", *order)
    placed = cut(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("key", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    shifts = parts.select(
        "key", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(Window.partitionBy("key")).alias("size")
    )
    return placed.join(shifts, ["key", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def level_sizes(size: int) -> list[int]:
    """The number of nodes of each level, from the given one up to the root."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def _arrived(tree: dict, sizes: list[int], level: int, index: int, value: str) -> dict:
    """tree, partial parents by (level, index), after a node has come in; complete parents climb on at once."""
    top = min(LEVELS, len(sizes) - 1)
    while level < top:
        parent = index // ARITY
        children = tree.setdefault((level + 1, parent), {})
        children[index] = value
        if len(children) < min(ARITY, sizes[level] - ARITY * parent):
            return tree
        del tree[level + 1, parent]
        value = digest(*(children[i] for i in sorted(children)))
        level, index = level + 1, parent
    tree["top"] = value
    return tree


def _joined(a: tuple, b: tuple) -> tuple:
    """Two partial trees of one block, with what their open parents complete together."""
    size, tree = a
    sizes = level_sizes(size)
    for place, children in b[1].items():
        if place == "top":
            tree["top"] = children
        else:
            for index, value in children.items():
                _arrived(tree, sizes, place[0] - 1, index, value)
    return size, tree


def climbed(nodes: DataFrame) -> DataFrame:
    """The nodes LEVELS levels up, or the roots where a tree ends before: (key, idx, digest, size) again."""
    spark = nodes.sparkSession
    begin = lambda v: (v[2], _arrived({}, level_sizes(v[2]), 0, v[0], v[1]))
    more = lambda c, v: (c[0], _arrived(c[1], level_sizes(c[0]), 0, v[0], v[1]))
    done = (
        nodes.select("key", "idx", "digest", "size").rdd.map(lambda r: ((r[0], r[1] // SPAN), (r[1], r[2], r[3])))
        .combineByKey(begin, more, _joined, partitions(spark), lambda k: zlib.crc32(repr(k).encode()))
        .map(lambda kv: (*kv[0], kv[1][1]["top"], -(-kv[1][0] // SPAN)))
    )
    return cut(spark.createDataFrame(done, NODES))


def _block(nodes: pd.DataFrame) -> list[list[str]]:
    """For the nodes of one block, in order of idx: the steps from each, "position and siblings" by level."""
    sizes = level_sizes(int(nodes["size"].iloc[0]))
    level, steps = list(nodes["digest"]), [[] for _ in range(len(nodes))]
    for k in range(min(LEVELS, len(sizes) - 1)):
        runs = [level[i : i + ARITY] for i in range(0, len(level), ARITY)]
        for at, own in enumerate(steps):
            place = at // ARITY**k
            run, pos = runs[place // ARITY], place % ARITY
            own.append(str(pos) + "".join(run[:pos] + run[pos + 1 :]))
        level = [digest(*run) for run in runs]
    return steps


def descended(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """nodes with path, the steps to the root, lowest first and divided by commas; above: (key, idx, path) of their blocks' roots."""

    def paths(mine: pd.DataFrame, over: pd.DataFrame | None = None) -> pd.DataFrame:
        mine = mine.sort_values("idx", ignore_index=True)
        rest = [over["path"].iloc[0]] if over is not None and over["path"].iloc[0] else []
        return mine.assign(path=[",".join(own + rest) for own in _block(mine)] if len(mine) else [])

    kind = ", ".join(f"`{c}` {t}" for c, t in nodes.dtypes) + ", path string"
    blocks = nodes.groupBy("key", F.floor(F.col("idx") / SPAN).alias("block"))
    if above is None:
        return blocks.applyInPandas(paths, kind)
    return blocks.cogroup(above.select("key", F.col("idx").alias("block"), "path").groupBy("key", "block")).applyInPandas(paths, kind)


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of nodes below the last, and the roots (key, idx, digest, size)."""
    rounds = []
    while (nodes.agg(F.max("size")).first()[0] or 1) > 1:
        rounds.append(nodes)
        nodes = climbed(nodes)
    return rounds, nodes


def proven(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest nodes with path; roots: (key, idx, path) of the trees' roots."""
    for nodes in reversed(rounds):
        roots = descended(nodes, roots)
    return roots


def fold(leaf: str, path: str) -> str:
    """The root that follows from a leaf and the steps of its path."""
    for step in path.split(",") if path else []:
        cut_at = 1 + 64 * int(step[0])
        leaf = digest(step[1:cut_at], leaf, step[cut_at:])
    return leaf


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored. Rows of a source are ordered by doc_id, a null
    one first, and by leaf, so repeated rows have one tree however they come; each of them is a leaf. Null sources
    are one source. An empty table gives no rows. The folded root is recomputed from the tampered leaf.
    """
    spark = docs.sparkSession
    made = cut(leaves(docs))
    low = ranked(made, "doc_id", "leaf").withColumnRenamed("leaf", "digest")
    rounds, subroots = tree(cut(low))
    top = cut(ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), "source"))
    top_rounds, root = tree(top)
    ways = proven(top_rounds, root.withColumn("path", F.lit(""))).select(F.col("idx").alias("at"), "path")
    over = top.join(ways, top["idx"] == ways["at"]) if top_rounds else top.withColumn("path", F.lit(""))
    over = cut(over.select(F.col("source").alias("key"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot")))
    paths = proven(rounds, over)
    if not rounds:  # one row a source at most: it is its own root
        paths = rounds_of_one(low, over)
    first = root.first()
    whole = paths.join(over.select("key", "subroot"), "key").withColumn("root", F.lit(first.digest if first else None).cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def told(batches):
        for rows in batches:
            rows["proof_sha256"] = [digest(*(step[1:] for step in p.split(","))) for p in rows["path"]]
            rows["folded_root"] = [fold(leaf, p) for leaf, p in zip(rows["tampered"], rows["path"])]
            rows["verified"] = rows["folded_root"] == rows["root"]
            yield rows.rename(columns={"digest": "leaf"})[["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]]

    return whole.select("doc_id", "digest", "tampered", "subroot", "root", "path").mapInPandas(told, out)


def rounds_of_one(low: DataFrame, over: DataFrame) -> DataFrame:
    """Leaves that are subroots themselves, with the paths of these."""
    return low.join(over.select("key", "path"), "key")


#: The same in DuckDB's SQL: crc32 bit by bit, levels and paths by recursion.
ORACLE = r"""
WITH RECURSIVE k AS (
  SELECT *, string_split(CAST(doc_id AS VARCHAR), '') AS s, coalesce('=' || source, '-') AS key,
    (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))) AS tab
  FROM documents
), h AS (
  SELECT *, {head} AS head, coalesce(xor(list_reduce([4294967295] || list_transform(s, lambda c: CAST(ord(c) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 2 = 0, false) AS hit FROM k
), l AS (
  SELECT doc_id, key, sha256(head || {text}) AS leaf, sha256(head || CASE WHEN hit THEN {bare} ELSE {text} END) AS tampered FROM h
), i AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM l
), up AS (
  SELECT key, 0 AS level, idx, leaf AS digest, n FROM i
  UNION ALL
  SELECT key, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY key, level, idx // 3
), sub AS (
  SELECT key, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), over AS (
  SELECT 0 AS level, idx, subroot AS digest, n FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM over WHERE n > 1 GROUP BY level, idx // 3
), node AS (
  SELECT *, coalesce(lag(digest, 2) OVER w, '') || coalesce(lag(digest) OVER w, '') AS before,
    coalesce(lead(digest) OVER w, '') || coalesce(lead(digest, 2) OVER w, '') AS after
  FROM (SELECT * FROM up UNION ALL SELECT NULL, * FROM over) WINDOW w AS (PARTITION BY key, level, idx // 3 ORDER BY idx)
), p AS (
  SELECT doc_id, key, leaf, idx AS id, n AS of, 0 AS level, idx, n, tampered AS folded, '' AS proof FROM i
  UNION ALL
  SELECT p.doc_id, p.key, p.leaf, p.id, p.of, p.level + 1, p.idx // 3, (p.n + 2) // 3, sha256(before || folded || after), proof || before || after
  FROM p JOIN node ON node.key = p.key AND node.level = p.level AND node.idx = p.idx WHERE p.n > 1
), q AS (
  SELECT p.doc_id, p.leaf, p.key, p.id, sub.subroot, 0 AS level, sub.idx, sub.n, folded, proof FROM p JOIN sub USING (key) WHERE p.n = 1
  UNION ALL
  SELECT q.doc_id, q.leaf, q.key, q.id, q.subroot, q.level + 1, q.idx // 3, (q.n + 2) // 3, sha256(before || folded || after), proof || before || after
  FROM q JOIN node ON node.key IS NULL AND node.level = q.level AND node.idx = q.idx WHERE q.n > 1
)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM q, (SELECT digest FROM over WHERE n = 1) WHERE q.n = 1
"""


def oracle() -> str:
    """ORACLE with the fields of a leaf written out."""
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return ORACLE.format(head=head, text=field("text"), bare=field("replace(text, chr(10), '')"))
