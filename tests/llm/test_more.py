"""More cases of the operators: hot keys, wrapped licences, headers, cuts, flows, risks, long conversations."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import chat, common, license_scan, mixing, packing, pulearn, revisit, simhash


def test_simhash_hot_key_is_split(spark):
    r = random.Random(3)
    fps = spark.createDataFrame([((r.getrandbits(40) << 22) | 77,) for _ in range(60)], "fp long").distinct().repartition(3)
    for cell, most in ((1 << 16, 60), (10, 40)):
        groups = simhash.dealt(fps, 4, 3, cell).groupBy("segment", "key", "cell").count().collect()
        assert max(g["count"] for g in groups if g.segment == 0) <= most
    cells = {g.cell for g in simhash.dealt(fps, 4, 3, 10).where("segment = 0 and key = 77").select("cell").distinct().collect()}
    assert len(cells) == 21  # all pairs of 6 chunks


def wrapped(text, width=60, mark="# "):
    words, lines = text.split(), [mark]
    for w in words:
        if len(lines[-1]) + len(w) > width:
            lines.append(mark)
        lines[-1] += w + " "
    return "\n".join(lines)


def test_licence_files_and_wrapped_headers(spark):
    header = license_scan.TEMPLATES["GPL-3.0 header"][1]
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n".join(wrapped(license_scan.TEMPLATES["MIT"][2], 70, "").split("\n"))
    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(80))
    short = license_scan.TEMPLATES["MIT"][0]
    rows = [(1, mit), (2, code + "\n" + wrapped(header) + "\n" + code), (3, f"a long line before it says {short} and goes on and on in the same line " + "more " * 50),
            (4, code), (4, code), (5, short + "\n" + short), (6, " ".join(["x"] * 30000)), (7, None)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (got[1].license, got[1].dice > 0.9) == ("MIT", True)
    assert got[2].license == "GPL-3.0 header" and got[2].dice > 0.9 and 80 < got[2].line_no < 95
    assert got[3].license == "MIT" and got[3].dice > 0.8 and got[3].line_no == 1
    assert (got[5].license, got[5].line_no) == ("MIT", 1)
    assert all(got[i].license is None and got[i].n_matches == 0 for i in (4, 6, 7))
    two = {"b": ["one two three four"], "a": ["one two three four"]}
    tie = license_scan.scan(docs.select("doc_id", F.lit("one two three four").alias("text")), two).first()
    assert (tie.license, tie.dice, tie.n_matches) == ("a", 1.0, 2)
    assert license_scan.scan(docs.limit(0)).count() == 0 and license_scan.scan(docs, {}).where("license is not null").count() == 0


def test_headers_that_differ_in_case_and_null_urls(spark):
    rows = [("r", "u/a", 1, "response", {"ETag": '"0"', "etag": '"1"', "X": "a", "x": "b"}, "p"), ("v", "u/a", 2, "revisit", {"ETAG": '"1"'}, None),
            ("v", "u/a", 2, "revisit", {"ETAG": '"1"'}, None), ("n", None, 3, "revisit", {"etag": '"1"'}, None), ("m", None, 1, "response", {"etag": '"1"'}, "q")]
    pairs = [(*row[:4], list(row[4].keys()), list(row[4].values()), row[5]) for row in rows]
    table = spark.createDataFrame(pairs, "record_id string, url string, ts long, kind string, k array<string>, v array<string>, payload_digest string")
    table = table.withColumn("headers", F.map_from_arrays("k", "v")).withColumn("near", F.lit(1))
    got = revisit.resolve(table).collect()
    assert sorted((r.record_id, r.resolution, r.target_id) for r in got) == [("n", "missing", None), ("v", "resolved", "r"), ("v", "resolved", "r")]
    assert next(r for r in got if r.record_id == "v").headers == {"x": "b", "etag": '"1"'}


def test_cuts_inside_sentences_only_where_they_do_not_fit():
    ends, kinds = packing.candidates(np.array([100, 500, 3000, 3010]), np.array([1, 1, 1, 0]), 2048, 32, (0, 4, 16))
    inside = [int(e) for e, k in zip(ends, kinds) if k == 16]
    assert inside and min(inside) > 500 and max(inside) < 3000
    assert packing.candidates(np.array([100, 2100]), np.array([1, 0]), 2048, 32, (0, 4, 16))[0].tolist() == [100, 2100]


def test_packing_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "one"), (2, None), (2, None)], "doc_id int, text string").selectExpr("cast(doc_id as decimal(10,0)) doc_id", "text")
    assert sorted((int(r.doc_id), r.doc_tokens) for r in packing.pack(docs).collect())[1:] == [(2, 1), (2, 1)]


def test_targets_by_hand():
    # 150 % of 600 words by 3 : 1 : 2 is 450, 150, 300; a stops at 200, its 250 go on by 1 : 2; c stops at 400
    assert mixing.targets({"a": 100, "b": 300, "c": 200}) == pytest.approx({"a": 200, "b": 300, "c": 400})
    assert mixing.targets({"a": 100, None: 100}) == pytest.approx({"a": 200, None: 100})
    # 180 by 3 : 1 : 2 is 90, 30, 60; c has none, its 60 go on by 3 : 1 to 135, 45; a stops at 120 and b takes the other 60
    assert mixing.targets({"b": 60, "c": 0, "a": 60}) == pytest.approx({"a": 120, "b": 60, "c": 0})


def test_flow_against_all_plans():
    r = random.Random(6)
    for _ in range(40):
        names = ["a", "b", "c"]
        patterns = [(tuple(sorted(r.sample(names, r.randrange(1, 4)))), r.randrange(0, 4)) for _ in range(3)]
        quotas = {n: r.randrange(0, 6) for n in names}
        sent = mixing.route(patterns, quotas)
        into = collections.Counter()
        for own, (sources, words) in zip(sent, patterns):
            assert set(own) <= set(sources) and sum(own.values()) <= 2 * words and min(own.values(), default=0) >= 0
            into.update(own)
        assert all(into[n] <= quotas[n] for n in names)
        best, repeats = 0, None
        states = {(tuple(quotas.values()), 0, 0)}  # quotas left, words sent, repeated words
        for sources, words in patterns:
            step = set()
            for left, n, again in states:
                splits = [((), 0)]
                for s in names:
                    room = left[names.index(s)] if s in sources else 0
                    splits = [((*p, x), t + x) for p, t in splits for x in range(room + 1) if t + x <= 2 * words]
                step |= {(tuple(a - b for a, b in zip(left, p)), n + t, again + max(0, t - words)) for p, t in splits}
            states = step
        best = max(n for _, n, _ in states)
        repeats = min(a for _, n, a in states if n == best)
        assert sum(into.values()) == best
        assert sum(max(0, sum(own.values()) - words) for own, (_, words) in zip(sent, patterns)) == repeats


def test_mix_of_overlapping_sources_and_clashing_names(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for i, s in enumerate([["a"], ["a", "b"], ["b", "a"], ["b"], [], None, ["a", "a"]] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    one = {r.doc_id: r.taken for r in mixing.mix(docs, F.col("s")).collect()}
    assert one == {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), F.col("s")).collect()}
    assert all(not one[i] for i, _, s in rows if not s) and sum(v or 0 for v in one.values()) > 0
    clash = docs.select("doc_id", "text", F.lit("x").alias("source"), *[F.lit(5).alias(c) for c in ("_size", "_rounds", "_row", "_copy", "_draw")])
    mixed = mixing.apply_mix(clash)
    assert mixed.columns == clash.columns and {r["_size"] for r in mixed.collect()} == {5}


def test_risk_by_definition(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, pulearn.N_FEATURES))
    positive = np.arange(400) < 80
    x[:200, 0] += 3  # the first half is good, 80 of it known
    table = spark.createDataFrame([(bytearray(a.astype("<f4").tobytes()), bool(p)) for a, p in zip(x, positive)], "x binary, positive boolean").repartition(3).cache()
    model = pulearn.fit(table, steps=40)
    assert 0.35 < model.prior < 0.7
    z = np.c_[(x.astype("<f4") - model.mean) / model.scale, np.ones(len(x))]
    ridge = 1e-3 + 1 / 80

    def risk(w):
        plus, minus = np.logaddexp(0, -(z @ w)), np.logaddexp(0, z @ w)
        return model.prior * plus[positive].mean() + max(0.0, minus.mean() - model.prior * minus[positive].mean()) + ridge / 2 * w @ w

    least = risk(model.weights)
    assert least < risk(np.zeros(len(model.weights)))
    for _ in range(60):
        assert risk(model.weights + r.normal(size=len(model.weights)) * 0.05) > least - 1e-2  # the step back at the bend of the risk keeps it near the least, not at it
    score = model.score(x.astype("<f4"))
    assert score[:200].mean() > score[200:].mean() + 0.3


def test_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(6000)]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in got.turns] == [t[3] for t in rows] and got.loss == [t[3] for t in rows if t[2] == "assistant"]


def test_packing_that_leaves_no_words_behind(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 301}." for k in range(90))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(packing.pack(docs, words=40).collect()) == sorted(packing.pack(docs).collect())
    path, before = packing.default_vocabulary(), dict(packing.WordTokenizer._kept)
    own = packing.WordTokenizer.of_worker(path, 40)
    assert own.most == 40 and own is not packing.WordTokenizer.of_worker(path, 40) and packing.WordTokenizer._kept == before


def test_cogroups_give_memory_back(monkeypatch):
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    for _ in range(3):
        assert common.released_groups(lambda a, b: a + b)(1, 2) == 3
    assert list(common.released(iter)([4, 5])) == [4, 5] and len(called) == 4


def test_packing_begins_with_collected_heaps(spark):
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))
    docs = spark.createDataFrame([(1, "a few words here")], "doc_id long, text string")
    before = full()
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == {1} and full() > before


def test_search_hands_on_the_best_of_all_shards():
    import pyarrow as pa

    from larder.llm import search

    r = random.Random(12)
    texts = [" ".join(f"w{int(r.paretovariate(0.5))}" for _ in range(r.randrange(60))) for _ in range(900)]
    made, shards, queries = [], [], {}
    for lo in (0, 300, 600):
        made.append(search._Builder())
        for i in range(lo, lo + 300):
            made[-1].add(i, texts[i % 700], i % 20 == 0)  # the last ones are copies: ties
        shards.append(made[-1].shard()[0])
    mean = sum(sum(m.lengths) for m in made) / 900
    whole = search.Index(shards, mean)
    df = dict(zip(whole.names.tolist(), np.diff(whole.ptr).tolist()))
    for m in made:
        found = search._unpacked(m.shard()[1])
        for q, part in zip(found["id"].tolist(), np.split(np.arange(len(found["term"])), np.cumsum(found["size"])[:-1])):
            queries[q] = [{"term": np.uint64(t).astype(np.int64).item(), "df": df[t], "tf": f} for t, f in zip(found["term"][part].tolist(), found["tf"][part].tolist())]
    kind = pa.list_(pa.struct([("term", pa.int64()), ("df", pa.int64()), ("tf", pa.int32())]))
    rows = pa.record_batch([pa.array([0] * len(queries), pa.int32()), pa.array(list(queries)), pa.array(list(queries.values()), kind)], names=["b", "query_id", "vector"])
    (block,) = search._bundled(iter([rows]))
    pairs = pa.record_batch([pa.array([0] * 3, pa.int32()), pa.array([block["payload"][0].as_py()] * 3), pa.array(shards)], names=["b", "payload", "index"])
    got = collections.defaultdict(list)
    for batch in search._searched(iter([pairs]), 900, mean, 7):
        for q, d, p in zip(*(c.to_pylist() for c in batch.columns)):
            got[q].append((d, p))
    for q, vector in queries.items():
        n = np.array([v["df"] for v in vector], float)
        want = whole.search(np.array([v["term"] for v in vector], np.int64).view(np.uint64), np.log(1 + (900 - n + 0.5) / (n + 0.5)), np.array([v["tf"] for v in vector]), 7)
        assert got[q] == list(zip(*(x.tolist() for x in want)))  # no more rows than the best, whatever the number of shards
