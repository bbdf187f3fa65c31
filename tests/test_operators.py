from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking as B
from kinweave.operators import decide as D
from kinweave.operators import decoy as J
from kinweave.operators import overlay as O
from kinweave.sources import files as S
from kinweave.streaming import events as E


def pairs(spark, rows, schema="s1_id string, m_id string"):
    return spark.createDataFrame(rows, schema)


def test_f05(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    truth = pairs(spark, [("a", "1"), ("a", "2"), ("c", "3")])
    predicted = pairs(spark, [("a", "1"), ("a", "2"), ("a", "9"), ("b", "7")])
    got = {r["s1_id"]: r["f05"] for r in D.entity_f05(entities, predicted, truth).collect()}
    assert got == {"a": pytest.approx(0.714, abs=1e-3), "b": 0.0, "c": 0.0, "d": 1.0}


def test_one_owner_breaks_ties(spark):
    p = pairs(spark, [("b", "1", 0.5), ("a", "1", 0.5), ("a", "2", 0.1)], "s1_id string, m_id string, p double")
    assert sorted(tuple(r)[:2] for r in D.one_owner(p).collect()) == [("a", "1"), ("a", "2")]


def test_overlay(spark):
    now = pairs(spark, [("a", "1"), ("b", "2")])
    moved = O.move(now, spark.createDataFrame([("1", "a", "c"), ("2", "x", "c")], "m_id string, from_id string, to_id string"))
    assert sorted(map(tuple, moved.collect())) == [("b", "2"), ("c", "1")]
    assert sorted(map(tuple, O.add_only(now, pairs(spark, [("z", "1"), ("z", "3"), ("y", "3")])).collect())) == [("a", "1"), ("b", "2"), ("y", "3")]
    delta = [(pairs(spark, [("a", "1")]), pairs(spark, [("c", "1")]))]
    assert sorted(map(tuple, O.apply_deltas(now, delta).collect())) == [("b", "2"), ("c", "1")]
    with pytest.raises(Exception, match="two owners"):
        O.apply_deltas(now, [(pairs(spark, []), pairs(spark, [("c", "1")]))]).collect()
    assert O.changes(now, now).count() == 0


def test_caps_and_top_k(spark):
    a = spark.createDataFrame([(i, "k" if i < 5 else "r") for i in range(6)], "s1_id int, k string")
    b = spark.createDataFrame([(i, "k") for i in range(3)] + [(9, "r")], "m_id int, k string")
    assert [tuple(r) for r in B.capped_equi_join(a, b, ["k"], 4, 4).select("s1_id", "m_id").collect()] == [(5, 9)]
    c = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("a", "z", 0.1)], "s1_id string, m_id string, cos double")
    assert [r["m_id"] for r in B.top_k(c, "s1_id", "m_id", 2).collect()] == ["x", "y"]


def test_planted_copies_are_found(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("t"), F.col("p_partkey").alias("id"))
    noisy = parts.select(F.concat(F.lit("the "), F.col("t")).alias("t"), "id")
    g = [B.grams(x, "id", F.split(F.lower("t"), " ")) for x in (parts, noisy)]
    w = B.idf(g[0].unionByName(g[1]), 2 * parts.count())
    found = B.top_k(B.cosines(B.weights(g[0], w), B.weights(g[1], w)), "m_id", "s1_id", 3)
    assert found.where("s1_id = m_id").count() == parts.count()


def test_tsv_and_lists(spark, tmp_path):
    f = tmp_path / "r.tsv"
    f.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\t"Q" name\t\tUS\n2\tb\tx, y\tIndia\n')
    df = S.read_tsv(spark, str(f))
    assert [tuple(r) for r in df.collect()] == [("1", '"Q" name', "", "US"), ("2", "b", "x, y", "India")]
    S.check_row_count(spark, str(f), df)
    lists = S.lists_per_entity(df.select(F.col("entity_id").alias("s1_id")), pairs(spark, [("1", "b"), ("1", "a"), ("1", "a")]))
    assert sorted(map(tuple, lists.collect())) == [("1", "a,b"), ("2", "")]
    assert sorted(map(tuple, S.read_pairs(lists).collect())) == [("1", "a"), ("1", "b")]
    S.write_partitioned(df, str(tmp_path / "p"))
    assert S.done(spark, str(tmp_path / "p")) and S.read_country(spark, str(tmp_path / "p"), "US", ["entity_id"]).count() == 1


def test_relations(spark):
    rel = lambda a, b: spark.range(1).select(J.number_relation(F.array(*map(F.lit, a)).cast("array<int>"), F.array(*map(F.lit, b)).cast("array<int>"))).head()[0]
    assert [rel(*x) for x in (([], [1]), ([1, 2], [2, 1]), ([58, 14, 14], [58, 14, 19]), ([1, 2], [1]), ([40], [30]), ([1], [500]), ([10], [13]), ([10], [11]), ([1234], [1294]), ([100], [190]), ([123], [23]))] == ["missing", "eq", "shift_ms_only", "sub", "neg_small", "far", "shift_pure", "shift_12", "typo", "typo", "typo"]


def test_events_as_stream(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{path}/events.parquet")
    stream = E.read_stream(spark, path, batch.schema, "events.parquet")
    q = E.windowed(stream, late="100000 hours").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("w").select(F.col("window_start").cast("timestamp"), "event_type", "n")
    want = E.windowed(batch).select(F.col("window_start").cast("timestamp"), "event_type", "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_exact_sets_of_many_pairs(spark):
    """Every prefix is tried: against the laws of both sides for few pairs, and beyond 64 of them."""
    import numpy as np

    def law(p):
        out = np.ones(1)
        for x in p:
            out = np.convolve(out, [1 - x, x])
        return out

    rng = np.random.default_rng(3)
    for n, misses in ((1, 0.0), (1, 0.5), (7, 0.0), (40, 0.5), (150, 2.5)):
        p = np.sort(np.append(rng.random(n - 1), 1.0))[::-1]
        for k, got in enumerate(D.prefix_f(p, misses, block=32), 1):
            a, b = law(p[:k]), law(p[k:])
            t, u = np.arange(len(a))[:, None], np.arange(len(b))[None, :]
            assert got == pytest.approx(a @ (1.25 * t / (k + 0.25 * (t + u + misses))) @ b, rel=1e-11)
    hot = pairs(spark, [("a", f"{i:04}", 0.97) for i in range(700)] + [("b", "x", 0.01)], "s1_id string, m_id string, p double")
    assert {r["s1_id"]: r["count"] for r in D.expected_f_exact(hot, misses=0.5).groupBy("s1_id").count().collect()} == {"a": 700}


def test_evidence_of_all_pairs(spark):
    """Siblings, peer support and simulated F0.5 by brute force, with weak pairs, repeated names and ties."""
    import numpy as np

    from kinweave.operators import context as C

    rng, names = np.random.default_rng(4), ["red ring", "red bolt", "old red ring", "nut", "bolt"]
    rows = [(f"s{i % 3}", f"{'ab'[i % 2]}{i % 4}{i}", float(rng.choice([0.05, 0.4, 0.6, 0.9, 0.95])), names[rng.integers(5)]) for i in range(60)] + [("lone", "a1", 0.95, "nut"), ("weak", "a2", 0.1, "nut"), ("weak", "a3", 0.2, "nut")]
    sim = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    same = lambda a, b: F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))) / F.size(F.array_union(F.split(a, " "), F.split(b, " ")))
    df = pairs(spark, rows, "s1_id string, m_id string, p double, name string")
    got = {(r["s1_id"], r["m_id"]): r for r in C.peer_support(C.siblings(df, same), same).collect()}
    assert len(got) == len(rows)
    for s, m, _, name in rows:
        a = [(x[1], x[2], sim(name, x[3])) for x in rows if x[0] == s and x[1] != m]
        sib, peers = [x for x in a if x[1] >= 0.5], [x for x in a if x[1] >= 0.9]
        r = got[s, m]
        assert (r["sib_n"], r["sib_same_source"], r["contradictions"]) == (len(sib), sum(x[0][:2] == m[:2] for x in sib), sum(x[2] < 0.5 for x in peers))
        want = [max((x[2] for x in sib), default=-1), max((x[1] * x[2] for x in sib), default=-1), sum(x[1] * x[2] for x in peers) / (len(peers) + 1), max((x[2] for x in peers), default=0), sum(x[2] for x in peers) / max(1, len(peers))]
        assert [r[c] for c in ("sib_best", "sib_weighted", "support", "support_max", "support_mean")] == pytest.approx(want, abs=1e-9)
    scored = pairs(spark, [("a", "1", 1.0, True), ("a", "2", 1.0, False), ("b", "3", 1.0, True), ("c", "4", 0.0, False), ("d", "5", 0.5, True), ("d", "6", 0.5, False)], "s1_id string, m_id string, p double, predicted boolean")
    f = {r["s1_id"]: r["f05"] for r in D.monte_carlo_f(scored, 0.0, draws=4000).collect()}
    assert [f["a"], f["b"], f["c"]] == pytest.approx([1.25 / 1.5, 1.0, 1.0])
    assert f["d"] == pytest.approx((1.0 + 1.25 / 1.5) / 4, abs=0.03)


def test_evidence_queries_take_all_pairs(spark):
    from kinweave.plans import library

    sf = "/root/testdata/sf0.001"
    assert library.sibling_support(spark, sf).count() == library.scored_pairs(spark, sf).count()
    assert library.monte_carlo_f(spark, sf).count() == library.scored_pairs(spark, sf).select("s1_id").distinct().count()


def test_linkage_of_records(spark):
    """The whole pipeline on planted copies and look-alikes: most lists are right, and no record has two owners."""
    from kinweave.plans import linkage
    from kinweave.plans import records as T

    sf = "/root/testdata/sf0.001"
    found = S.read_pairs(linkage.linkage_pipeline(spark, sf))
    assert found.groupBy("m_id").count().where("count > 1").isEmpty()
    entities = T.raw_s1(spark, sf).select(F.col("entity_id").alias("s1_id"))
    assert D.macro_f05(entities, found, linkage.truth(spark, sf)).head()["macro_f05"] > 0.9


def test_classes_of_names(spark):
    """Name classes, swaps and the similarities of pairs against plain code."""
    import difflib

    from kinweave.plans import features as V

    sf = "/root/testdata/sf0.001"
    x = V.described(spark, sf)
    rows = {(r["s1_id"], r["m_id"]): r for r in x.collect()}
    same = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    swaps = {(r["s1_id"], r["m_id"]): r for r in J.one_word_swaps(x).collect()}
    classes = {(r["s1_id"], r["m_id"]): r["cls"] for r in J.name_class(x).collect()}
    suffixes = {(r["s1_id"], r["m_id"]): r["cls"] for r in J.suffix_class(x).collect()}
    assert len(classes) == len(suffixes) == len(rows) and swaps
    for key, r in rows.items():
        ta, tb = r["a_name_core"].split(), r["b_name_core"].split()
        differ = [i for i, (p, q) in enumerate(zip(ta, tb)) if p != q]
        one = len(ta) == len(tb) and len(differ) == 1
        street = [{t for t in r[f"{s}_addr_text"].split() if t.isalpha() and len(t) > 2} for s in "ab"]
        swap = one and len(ta) > 1 and r["a_addr_nums"] and r["a_addr_nums"] == r["b_addr_nums"] and street[1] and len(street[0] & street[1]) >= 0.5 * len(street[0] | street[1]) and same(ta[differ[0]], tb[differ[0]]) < 0.6
        assert bool(swap) == (key in swaps) and (not swap or (swaps[key]["at"], swaps[key]["target"]) == (differ[0] + 1, tb[differ[0]]))
        if ta == tb:
            assert suffixes[key] is None and classes[key].startswith("exact_")
        elif one and set(ta) != set(tb) and not set(ta) < set(tb) and not set(tb) < set(ta):
            kind = "typo" if same(ta[differ[0]], tb[differ[0]]) >= 0.6 else "swap_generic" if tb[differ[0]] in J.GENERIC_WORDS else "swap_descr"
            assert suffixes[key] == kind and classes[key].startswith(("typo", "swap"))


def test_count_shapes():
    """Fits of count histograms find what made them."""
    import numpy as np

    truth = np.array([0.1, 0.1, 0.3, 0.3, 0.15, 0.05])
    for want in ((0.95, 0.1, 0.01), (0.9, 0.3, 0.05), (0.99, 0.0, 0.0)):
        got = J.fit_counts(1e6 * J.count_law(truth, *want, 9), truth)
        assert got == pytest.approx(want, abs=0.01)
    assert J.expected_score(truth, 1.0, 0.0, 0.0) == pytest.approx(1.0) and J.expected_score(truth, 0.9, 0.2, 0.0) < 0.95
    ref = np.array([5.0, 10, 20, 30, 20, 10, 3, 1, 1])
    true, false = np.arange(9) * ref, np.concatenate([[0], ref[:-1]])
    for share in (0.0, 0.4, 1.0):
        assert J.false_share(ref, share * false / false.sum() + (1 - share) * true / true.sum()) == pytest.approx(share, abs=0.05)
        real = ref[::-1] / ref.sum()
        assert J.removal_share(ref, 1e5 * (share * ref / ref.sum() + (1 - share) * real), real)[0] == pytest.approx(share, abs=0.01)


def test_draws():
    import numpy as np

    u = D.uniforms(np.arange(2000), 50, 1)
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and (u == D.uniforms(np.arange(2000), 50, 1)).all()
    n = D.poissons(u, 1.5)
    assert abs(n.mean() - 1.5) < 0.02 and abs(n.var() - 1.5) < 0.05 and not D.poissons(u, 0.0).any()


def test_fillers_and_guards(spark, tmp_path):
    from kinweave.operators import learn as L

    rows = [(f"a{i} b", f"a{i} b pra li") for i in range(5)] + [(f"a{i} c", f"a{i} c limtid") for i in range(4)] + [("x", "x y")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert L.filler_suffixes(df, F.split("a", " "), F.split("b", " "), support=3) == ["limtid", "pra li"]
    calls = []
    tries = L.random_search({"a": [1, 2], "b": [3]}, lambda s: calls.append(s) or float(s["a"]), tries=10)
    assert tries[0] == (2.0, {"a": 2, "b": 3}) and len(calls) == 2
    assert S.check_room(spark, str(tmp_path), 1) > 1
    with pytest.raises(OSError):
        S.check_room(spark, str(tmp_path), 1 << 62)
    path = str(tmp_path / "once")
    made = [S.once(spark, path, lambda: spark.range(n), force=f).count() for n, f in ((3, False), (5, False), (5, True))]
    assert made == [3, 3, 5]
    plan = spark.read.parquet(path).where("id = 2").select("id")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,2)]" in plan._jdf.queryExecution().executedPlan().toString()
