"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A flow network routes the word capacity of the patterns to the quotas of
the sources, every further repetition of a pattern costing more than the one
before. The flow then becomes whole rounds of a pattern and a seeded selection
of its documents. Only one row per pattern reaches the driver.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Patterns that the driver's flow network may hold; more is an error, never a sample.
MAX_PATTERNS = 100_000
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of words of a whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> dict[str | None, float]:
    """Words wanted of each source: `share` of all words dealt by weight, none above `most` times its size.

    Sources stand in code point order, null last; what a full source leaves is
    dealt again by weight among the others until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = list(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


class _Network:
    """Greatest flows over a small directed network, by blocking flows along shortest paths."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, s: int) -> list[int]:
        far = [-1] * len(self.out)
        far[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 0 and far[self.to[e]] < 0:
                    far[self.to[e]] = far[a] + 1
                    queue.append(self.to[e])
        return far

    def send(self, s: int, t: int) -> None:
        """Sends as much more as possible from s to t."""
        while (far := self._levels(s))[t] >= 0:
            turn, path, at = [0] * len(self.out), [], s
            while True:
                if at == t:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    path, at = [], s
                    continue
                while turn[at] < len(self.out[at]):
                    e = self.out[at][turn[at]]
                    if self.room[e] > 0 and far[self.to[e]] == far[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(self.out[at]):
                    path.append(e)
                    at = self.to[e]
                elif at == s:
                    break
                else:
                    at = self.to[path.pop() ^ 1]
                    turn[at] += 1


def route(patterns: list[tuple[tuple, int]], quotas: dict, costs: tuple = (0.0, 1.0)) -> list[dict]:
    """Words that each pattern sends to each of its sources.

    patterns: (sources, words); costs: of the first, second, ... repetition of a
    pattern's words, growing; their number is the most repetitions.

    Costs lie on the edges into the patterns alone, so a shortest path costs what its first
    edge does: the capacity of each repetition is opened in turn and filled as far as it goes.
    """
    names = list(quotas)
    at = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    net = _Network(2 + len(patterns) + len(names))
    edges: list[dict] = []
    for i, (sources, words) in enumerate(patterns):
        edges.append({s: net.add(2 + i, at[s], words * len(costs)) for s in sources})
    for s in names:
        net.add(at[s], 1, int(round(quotas[s])))
    for _ in sorted(costs):
        for i, (_, words) in enumerate(patterns):
            net.add(0, 2 + i, words)
        net.send(0, 1)
    return [{s: net.room[e ^ 1] for s, e in own.items()} for own in edges]


@dataclass
class Plan:
    """quotas by source, words by source, and per pattern key: rounds, cut, part and the words routed."""

    quotas: dict
    sizes: dict
    rows: list[tuple]
    seed: int

    COLUMNS = "pattern string, rounds long, cut_bucket int, cut long, part long, ties long"


def _seeded(df: DataFrame, seed: int) -> DataFrame:
    """Adds size, pattern (the key of the set of sources), bucket and draw, the seeded order of a document."""
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (
        df.withColumn("_size", word_count(F.col("text")))
        .withColumn("_pattern", F.to_json(F.struct(F.array_sort(F.array_distinct("_sources")).alias("s"))))
        .withColumn("_draw", draw)
        .withColumn("_bucket", F.shiftrightunsigned("_draw", 64 - 12).cast("int"))
    )


def plan(sized: DataFrame, seed: int = 7, costs: tuple = (0.0, 1.0)) -> Plan:
    """sized: checkpointed rows (_sources, _pattern, _size, _draw, _bucket)."""
    found = (
        sized.groupBy("_pattern").agg(F.sum("_size").alias("words"), F.min(F.array_sort(F.array_distinct("_sources"))).alias("sources"))
        .limit(MAX_PATTERNS + 1).collect()
    )
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found = sorted((r for r in found if r["sources"]), key=lambda r: r["_pattern"])
    patterns = [(tuple(dict.fromkeys(r["sources"])), int(r["words"])) for r in found]
    sizes: dict = {}
    for sources, words in patterns:
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    quotas = targets(sizes, most=float(len(costs)))
    wanted = [sum(x.values()) for x in route(patterns, quotas, costs)]
    rounds = [min(w // n, len(costs)) if n else 1 for w, (_, n) in zip(wanted, patterns)]
    rest = {r["_pattern"]: w - k * n for r, w, k, (_, n) in zip(found, wanted, rounds, patterns)}

    spark = sized.sparkSession
    rests = F.broadcast(spark.createDataFrame([(k, v) for k, v in rest.items() if v > 0], "_pattern string, rest long"))
    before = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (  # at most BUCKETS rows of a pattern in one window
        sized.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(rests, "_pattern").where("before < rest and rest <= before + words")
        .select("_pattern", "_bucket", (F.col("rest") - F.col("before")).alias("rest"))
    )
    edges = {r["_pattern"]: r for r in edge.collect()}
    marks = F.broadcast(spark.createDataFrame([(r["_pattern"], r["_bucket"], r["rest"]) for r in edges.values()], "_pattern string, _bucket int, rest long"))
    running = Window.partitionBy("_pattern").orderBy("_draw").rowsBetween(Window.unboundedPreceding, -1)
    exact = (  # one bucket of a pattern in one window
        sized.join(marks, ["_pattern", "_bucket"])
        .groupBy("_pattern", "rest", "_draw").agg(F.sum("_size").alias("words"), F.count("*").alias("ties"))
        .withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .where("before < rest and rest <= before + words")
    )
    cuts = {r["_pattern"]: r for r in exact.collect()}
    rows = []
    for r, k in zip(found, rounds):
        c = cuts.get(r["_pattern"])
        rows.append(
            (r["_pattern"], int(k), edges[r["_pattern"]]["_bucket"], c["_draw"], int(c["rest"] - c["before"]), int(c["ties"]))
            if c else (r["_pattern"], int(k), -1, 0, 0, 1)
        )
    return Plan(quotas, sizes, rows, seed)


def _decided(seeded: DataFrame, made: Plan) -> DataFrame:
    """Adds _taken (words, a part of one document at the cut included) and _copies (whole documents)."""
    rows = seeded.sparkSession.createDataFrame(made.rows, Plan.COLUMNS).select(
        F.col("pattern").alias("_pattern"), *[F.col(c).alias(f"_{c}") for c in ("rounds", "cut_bucket", "cut", "part", "ties")]
    )
    inside = (F.col("_bucket") < F.col("_cut_bucket")) | ((F.col("_bucket") == F.col("_cut_bucket")) & (F.col("_draw") < F.col("_cut")))
    at = (F.col("_bucket") == F.col("_cut_bucket")) & (F.col("_draw") == F.col("_cut"))
    part = F.floor(F.col("_part") / F.col("_ties"))
    out = seeded.join(F.broadcast(rows), "_pattern", "left")  # a row for each pattern, at most MAX_PATTERNS
    taken = F.col("_rounds") * F.col("_size") + F.when(inside, F.col("_size")).when(at, F.least(part, F.col("_size"))).otherwise(0)
    copies = F.col("_rounds") + F.when(inside | (at & (2 * part >= F.col("_size"))), 1).otherwise(0)
    return out.withColumn("_taken", F.coalesce(taken, F.lit(0)).cast("long")).withColumn("_copies", F.coalesce(copies, F.lit(0)).cast("int"))


def mix(docs: DataFrame, sources: Column | None = None, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, sources, size, source_size, target, taken.

    docs: doc_id, text and source, or `sources`, an array column of all sources of
    a document; other columns are ignored. source_size and target are those of the
    document's first source. A null source is a source of its own, null texts have
    size 0, a document without any source is never taken. Documents are drawn in
    the order of a seeded hash of the id, so reruns agree; repeated rows are drawn
    together. One document at a pattern's cut gives a part of its words. An empty
    table gives an empty result. More than MAX_PATTERNS patterns is an error.
    """
    spark = docs.sparkSession
    sized = cut(
        _seeded(docs.select("doc_id", "text", (F.array("source") if sources is None else sources).alias("_sources")), seed)
        .select("doc_id", "_sources", "_pattern", "_size", "_draw", "_bucket")
    )
    made = plan(sized, seed)
    known = spark.createDataFrame(
        [(s, int(made.sizes[s]), float(t)) for s, t in made.quotas.items()], "_known string, source_size long, target double"
    )
    out = _decided(sized, made).withColumn("_source", F.get("_sources", F.lit(0)))
    return out.join(F.broadcast(known), F.col("_source").eqNullSafe(F.col("_known")), "left").select(
        "doc_id", F.col("_sources").alias("sources"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken")
    )


def apply_mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed documents with all their columns, repeated documents as repeated rows; the part at a cut is rounded to a whole copy or none."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.array("source").alias("_sources"))
    seeded = _seeded(rows, seed)
    made = plan(cut(seeded.select("_sources", "_pattern", "_size", "_draw", "_bucket")), seed)
    return (
        _decided(seeded, made).where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
    )
