"""Conversation structure repair as a fold over sorted turns, with Spark expressions only.

Windows derive the faults of each turn. The turns of a conversation are collected as sorted
structs, and aggregate() carries four (cost, audit) structs through them, one for each state of
the pattern (s?(ua)+)? of role initials: nothing yet, after s, after u, after a. Long conversations
are folded in chunks of CHUNK turns, from each of the four states, and the chunks' results are folded
in turn; a conversation of one chunk starts from the first state only.

An audit has the initials of the edits in order: K(eep), R(erole), D(elete), I(nsert). Costs follow
from the audit alone, so of two prefixes of one cost none is the beginning of the other, and the least
(cost, audit) of each state is all that has to be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256
SPACES = " \t\n\x0b\f\r"
#: The costs of a rerole, a deletion, an insertion and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 50  # the cost of a state that cannot be reached


def damage(turns: DataFrame) -> DataFrame:
    """The turns with planted faults: conv_id, turn, role, text, copy and dropped.

    crc32 of "conv_id:turn" modulo 20 decides: 0 drops the row (here: marks it), 1 empties its text, 2 removes
    the characters . ! ? from it, 3 repeats it, 4 sets its role to user. A null role, text or part of that key
    is one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("kind")
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("dropped"),
    )


def faults(turns: DataFrame) -> DataFrame:
    """Each turn with its place `pos` in the conversation, its first fault, and marks of a new turn number and an illegal step.

    Turns are sorted by (turn, role, text), nulls first; dropped rows come last and have no part in the marks.
    fault: blank, duplicate, truncated or null.
    """
    order = Window.partitionBy("conv_id").orderBy("dropped", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    bare = F.rtrim("text", F.lit(SPACES))
    placed = turns.withColumn("initial", F.substring("role", 1, 1)).withColumn("pos", F.row_number().over(order).cast("long") - 1)
    marked = (
        placed.withColumn("fresh", F.col("turn").isNotNull() & ~F.lag("turn").over(order).eqNullSafe(F.col("turn")))
        .withColumn("step", F.concat(F.lag("initial").over(order), "initial"))
        .withColumn("again", F.row_number().over(same) > 1).withColumn("bare", bare)
    )
    fault = (
        F.when(F.col("bare") == "", "blank").when(F.col("again"), "duplicate")
        .when(~F.right("bare", F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return marked.select(
        "conv_id", "turn", "pos", "role", "text", "initial", "dropped", "fresh", fault.alias("fault"),
        (F.col("step").isNotNull() & ~F.col("step").isin("su", "ua", "au")).alias("illegal"),
    )


def _state(cost: Column | int, audit: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(cost).cast("long").alias("c"), lit(audit).cast("string").alias("a"))


def _after(state: Column, cost: Column | int, edit: str) -> Column:
    return _state(state["c"] + cost, F.concat(state["a"], F.lit(edit)))


def _four(states: list[Column]) -> Column:
    return F.struct(*[s.alias(f"s{i}") for i, s in enumerate(states)])


def _inserted(acc: Column) -> Column:
    """The states with what insertions reach from each other."""
    user = F.least(acc["s2"], *[_after(acc[f"s{i}"], INSERT, "I") for i in (0, 1, 3)])
    with_user = _four([acc["s0"], acc["s1"], user, acc["s3"]])
    return _four([acc["s0"], acc["s1"], user, F.least(acc["s3"], _after(with_user["s2"], INSERT, "I"))])


def _edited(ready: Column, turn: Column) -> Column:
    """The states after one more turn: each the least of what its native edits cost."""
    stays = turn["fault"].isNull() | (turn["fault"] == "truncated")
    extra = F.when(turn["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0))
    before = {1: ready["s0"], 2: F.least(ready["s0"], ready["s1"], ready["s3"]), 3: ready["s2"]}
    states = [_after(ready["s0"], DELETE, "D")]
    for i, initial in ((1, "s"), (2, "u"), (3, "a")):
        ways = [_after(ready[f"s{i}"], DELETE, "D"), F.when(stays & (turn["initial"] == initial), _after(before[i], extra, "K"))]
        if i > 1:
            ways.append(F.when(stays, _after(before[i], extra + REROLE, "R")))
        states.append(F.least(*ways))
    return _four(states)


def _folded(turns: Column, start: Column) -> Column:
    """The four states after the turns, from the state of number `start`."""
    first = _four([_state(F.when(start == i, 0).otherwise(FAR), "") for i in range(4)])
    # aggregate() over one element binds the states with insertions once, instead of once for each use
    step = lambda acc, t: F.aggregate(F.array(_inserted(acc)), acc, lambda _, ready: _edited(ready, t))
    return F.aggregate(turns, first, step)


def _joined(chunks: Column) -> Column:
    """The four states after all chunks, each with the way taken: array<struct<start, audit>>."""
    way = lambda number, audit: F.array(F.struct(F.lit(number).alias("start"), audit.alias("audit")))
    kind = "array<struct<start:int,audit:string>>"

    def state(cost: Column, audit: Column, path: Column) -> Column:
        return F.struct(F.least(cost, F.lit(FAR)).alias("c"), audit.alias("a"), path.cast(kind).alias("p"))

    def step(acc: Column, chunk: Column) -> Column:
        found = []
        for j in range(4):
            ways = []
            for i in range(4):
                old, new = acc[f"s{i}"], F.get(chunk["ends"], F.lit(i))[f"s{j}"]
                made = state(old["c"] + new["c"], F.concat(old["a"], new["a"]), F.concat(old["p"], way(i, new["a"])))
                ways.append(F.when(F.get(chunk["ends"], F.lit(i)).isNotNull(), made))
            found.append(F.least(*ways))
        return _four(found)

    none = F.array().cast(kind)
    first = _four([state(F.lit(0 if i == 0 else FAR).cast("long"), F.lit(""), none) for i in range(4)])
    return F.aggregate(chunks, first, step)


def _lines(chunk: Column, start: Column, audit: Column) -> Column:
    """The repaired lines "role:text" of a chunk, from the state it starts in and its part of the audit."""
    edits = F.when(F.length(audit) > 0, F.sequence(F.lit(1), F.length(audit))).otherwise(F.array().cast("array<int>"))
    count = lambda i, without: F.length(F.translate(F.substr(audit, F.lit(1), i), without, ""))

    def line(i: Column) -> Column:
        edit, turn = F.substr(audit, i, F.lit(1)), F.get(chunk["turns"], count(i, "I") - 1)
        first = F.get(chunk["turns"], F.length(F.regexp_extract(audit, "^D*", 0)))["initial"]
        system = (start == 0) & F.regexp_like(audit, F.lit("^D*K")) & (first == "s")
        place = count(i, "D") + F.when(start == 2, 1).otherwise(0) - F.when(system, 1).otherwise(0)
        role = F.when(place % 2 == 1, "user").otherwise("assistant")
        return F.when(edit == "K", F.concat(turn["role"], F.lit(":"), turn["text"])).when(edit == "R", F.concat(role, F.lit(":"), turn["text"])).when(
            edit == "I", F.concat(role, F.lit(":"))
        )

    return F.filter(F.transform(edits, line), lambda x: x.isNotNull())


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The cheapest repair of each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (text).

    turns: rows of damage(); a table without faults has copy 0 and dropped false. Rows are sorted by turn, nulls
    first, ties by role and text, so repeated rows have a fixed order and count as duplicates; other columns are
    ignored. A null conv_id is a conversation of its own; one whose rows are all dropped has zeros and an empty audit;
    an empty table gives no rows. A conversation is one value of the result, so its texts meet in one row; the windows
    sort it with spilling and the fold reads it by chunks, so its time grows in proportion to its turns.
    """
    live = ~F.col("dropped")
    seen = faults(turns).withColumn("chunk", F.floor(F.col("pos") / chunk))
    number = lambda c: F.sum(F.when(live & c, 1).otherwise(0))
    kinds = ("blank", "duplicate", "truncated")
    counts = [number(F.col("fault") == k).alias(k) for k in kinds] + [number(F.col(c)).alias(c) for c in ("illegal", "fresh")]
    parts = seen.groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(F.when(live, F.struct("pos", "initial", "fault", "role", "text")))).alias("turns"),
        F.max(F.when(live, F.col("turn"))).alias("last"), F.min(F.when(live, F.col("turn"))).alias("first"), *counts,
    )
    starts = F.when(F.col("chunk") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(4))))
    folded = parts.withColumn("ends", F.transform(starts, lambda s: _folded(F.col("turns"), s)))
    whole = folded.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "turns", "ends"))).alias("chunks"),
        *[F.sum(c).alias(c) for c in (*kinds, "illegal", "fresh")], (F.max("last") - F.min("first") + 1).alias("span"),
    )
    done = whole.withColumn("states", _joined(F.col("chunks"))).withColumn("plain", _four([_state(F.col(f"states.s{i}.c"), F.col(f"states.s{i}.a")) for i in range(4)]))
    best = done.withColumn("best", F.least("plain.s0", _inserted(F.col("plain"))["s3"]))
    # the way to the last chunk, and what is inserted after it
    from_state = [F.col("best.a").eqNullSafe(F.col("plain.s0.a")) & (F.col("best.c") == F.col("plain.s0.c"))]
    tails = [F.lit("")]
    for i, tail in ((3, ""), (2, "I"), (0, "II"), (1, "II")):
        from_state.append((F.concat(F.col(f"plain.s{i}.a"), F.lit(tail)) == F.col("best.a")) & (F.col(f"plain.s{i}.c") + INSERT * len(tail) == F.col("best.c")))
        tails.append(F.lit(tail))
    path, tail = F.lit(None), F.lit(None)
    for i, hit, more in reversed(list(zip((0, 3, 2, 0, 1), from_state, tails))):
        path, tail = F.when(hit, F.col(f"states.s{i}.p")).otherwise(path), F.when(hit, more).otherwise(tail)
    placed = best.withColumn("path", path).withColumn("tail", tail)
    last = F.size("path") - 1
    lines = F.flatten(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda k: _lines(
                F.get("chunks", k), F.get("path", k)["start"], F.concat(F.get("path", k)["audit"], F.when(k == last, F.col("tail")).otherwise(""))
            ),
        )
    )
    return placed.select(
        "conv_id", F.coalesce(F.col("span") - F.col("fresh"), F.lit(0)).cast("long").alias("gaps"), *[F.col(k).cast("long").alias(k) for k in kinds],
        F.col("illegal").cast("long").alias("illegal"), F.col("best.c").alias("cost"), F.col("best.a").alias("audit"),
        F.array_join(lines, "\n").alias("repaired"),
    )


def repaired(turns: DataFrame) -> DataFrame:
    """repair() of the damaged turns, with the digest of the repaired text in its place."""
    found = repair(damage(turns))
    return found.select(*found.columns[:-1], F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


#: The same in DuckDB's SQL: crc32 bit by bit, then one recursion over the turns; a state is its cost in ten digits before its audit.
ORACLE = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS s,
    (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))) AS tab
  FROM conversations
), d AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(s, lambda c: CAST(ord(c) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM k
), e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM d WHERE kind <> 0
), p AS (
  SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w || left(role, 1) AS step, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p
), r AS (
  SELECT c.conv_id, 0 AS pos, '0000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM (SELECT DISTINCT conv_id FROM conversations) c
  UNION ALL
  SELECT conv_id, pos, plus(s0, 2, 'D'),
    least(plus(s1, 2, 'D'), CASE WHEN stays AND i = 's' THEN plus(s0, extra, 'K') END),
    least(plus(t2, 2, 'D'), CASE WHEN stays AND i = 'u' THEN plus(least(s0, s1, t3), extra, 'K') END, CASE WHEN stays THEN plus(least(s0, s1, t3), extra + 1, 'R') END),
    least(plus(t3, 2, 'D'), CASE WHEN stays AND i = 'a' THEN plus(t2, extra, 'K') END, CASE WHEN stays THEN plus(t2, extra + 1, 'R') END)
  FROM (
    SELECT *, least(s3, plus(t2, 5, 'I')) AS t3 FROM (
      SELECT f.conv_id, f.pos, s0, s1, s3, least(s2, plus(s0, 5, 'I'), plus(s1, 5, 'I'), plus(s3, 5, 'I')) AS t2,
        left(f.role, 1) AS i, f.fault IN ('', 'truncated') AS stays, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS extra
      FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1
    )
  )
), b AS (
  SELECT conv_id, least(s0, s3, plus(least(s2, plus(s0, 5, 'I'), plus(s1, 5, 'I'), plus(s3, 5, 'I')), 5, 'I')) AS best
  FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), c AS (
  SELECT conv_id, substr(best, 11) AS audit, CAST(left(best, 10) AS BIGINT) AS cost FROM b
), x AS (
  SELECT conv_id, audit, n, substr(audit, n, 1) AS edit, n - length(replace(left(audit, n), 'I', '')) AS inserted,
    length(replace(left(audit, n), 'D', '')) AS said
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS n FROM c)
), y AS (
  SELECT x.*, f.role, f.text, coalesce(bool_or(edit = 'K' AND left(f.role, 1) = 's') OVER (PARTITION BY x.conv_id), false) AS sys
  FROM x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.pos = x.n - x.inserted AND x.edit <> 'I'
), z AS (
  SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (said - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY n) AS repaired
  FROM y WHERE edit <> 'D' GROUP BY conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (step IS NOT NULL AND step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle() -> str:
    """ORACLE with plus(state, cost, edit) written out, as it has no functions of its own."""
    out = ORACLE
    while "plus(" in out:
        at = out.rindex("plus(")  # the innermost of nested ones is found last
        depth, parts, begin = 0, [], at + 5
        for end in range(at + 5, len(out)):
            if out[end] == "(":
                depth += 1
            elif depth == 0 and out[end] in ",)":
                parts.append(out[begin:end].strip())
                begin = end + 1
                if out[end] == ")":
                    break
            elif out[end] == ")":
                depth -= 1
        state, cost, edit = parts
        out = f"{out[:at]}(lpad(CAST(CAST(left({state}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({state}, 11) || {edit}){out[end + 1 :]}"
    return out
