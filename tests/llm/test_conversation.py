"""Conversation repair against an enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from larder.llm import conversation

SPACE = " \t\n\x0b\f\r"
KIND = "conv_id long, turn long, role string, text string, cost int, audit string"  # two names that the operator uses inside


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """rows of one conversation, in order: everything by trying every edit of every row and every number of insertions."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in faults]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            lines, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                for role in gaps[k]:
                    lines.append((role, ""))
                    audit, cost = audit + "I", cost + conversation.INSERT
                if k == len(rows):
                    break
                e, (_, _, role, text) = edits[k], rows[k]
                audit += e[0]
                cost += {"K": 0, "Ru": 1, "Ra": 1, "D": 2}[e] + (5 if e != "D" and faults[k] == "truncated" else 0)
                if e != "D":
                    lines.append(({"K": role, "Ru": "user", "Ra": "assistant"}[e], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    turns = [t for _, t, _, _ in rows if t is not None]
    first = [r[:1] for _, _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), "cost": best[0], "audit": best[1],
        "repaired_sha256": hashlib.sha256(best[2].encode()).hexdigest(),
    }


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for c in range(70):
        for t in range(r.choice([1, 2, 3, 3])):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", None])
            out.append((c, r.choice([t, t, t + 2, None]), role, r.choice(["Yes.", "No!", "and then", " \t", "", None, "Why? ", "Yes.", "é…"])))
    out += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (None, 1, "assistant", "Hi.")]
    return out


@pytest.mark.parametrize("chunk,insert", [(1, 5), (2, 5), (256, 5), (2, 1)])
def test_repair_against_all_edits(spark, rows, monkeypatch, chunk, insert):
    monkeypatch.setattr(conversation, "INSERT", insert)  # at 5 a deletion always stands in for an insertion
    df = spark.createDataFrame([(*x, 1, "KK") for x in rows], KIND).repartition(3)
    found = {r.conv_id: r.asDict() for r in conversation.repair(conversation.damage(df), chunk).collect()}
    assert set(found) == {x[0] for x in rows}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2], x[3])
    damaged = brute_damage(rows)
    for c in found:
        got = found[c]
        got["repaired_sha256"] = hashlib.sha256(got.pop("repaired").encode()).hexdigest()
        del got["conv_id"]
        assert got == brute_repair(sorted((x for x in damaged if x[0] == c), key=order)), c
    assert any("I" in r["audit"] for r in found.values()) == (insert == 1)


def test_every_fault_and_edit_is_reached(spark, rows):
    df = spark.createDataFrame([(*x, 1, "KK") for x in rows], KIND)
    found = conversation.repaired(df).collect()
    assert set("".join(r.audit for r in found)) == set("DKR")
    assert all(any(r[k] for r in found) for k in ("gaps", "blank", "duplicate", "truncated", "illegal"))


def test_all_white_space_and_no_letter_ends_a_text(spark):
    texts = [("Hi.\x0b", None), ("Hi!\x0c\r\n", None), ("\x0b\x0c", "blank"), ("Hello.0", "truncated"), ("The box", "truncated"), ("xbc0", "truncated"), ("Why?\\", "truncated"), ("Yes.\u00a0", "truncated")]
    df = spark.createDataFrame([(i, 0, "user", text, 0, False) for i, (text, _) in enumerate(texts)], "conv_id long, turn long, role string, text string, copy int, dropped boolean")
    found = {r.conv_id: r.fault for r in conversation.faults(df).collect()}
    assert [found[i] for i in range(len(texts))] == [fault for _, fault in texts]


def test_long_conversations_do_not_depend_on_the_chunk(spark):
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant", "tool"]), r.choice(["Yes.", "no", f"Turn {t}."]), 0, "") for t in range(700)]
    rows += [(2, t, "user", "x" * 30_000 + ".", 0, "") for t in range(3)]
    df = conversation.damage(spark.createDataFrame(rows, KIND))
    by = [sorted(map(tuple, conversation.repair(df, chunk).collect())) for chunk in (64, 1000)]
    assert by[0] == by[1] and len(by[0]) == 2


def test_empty_conversations(spark):
    assert conversation.repaired(spark.createDataFrame([], KIND)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (r,) = conversation.repaired(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "")], KIND)).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
