"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and against brute force."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF, KEY = "/root/testdata/sf0.001", b"a key of the tests"
ODD = "doc_id long, text string, lang string, source string, n_chars long, `slot.x` int, h long, sig string, shard int, slot int, lang_pred string, score double, evidence string, replaced string, class_id int, m map<string,int>"
LONG = "word " * 30_000 + "x" * 60_000
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "one two", None, "a", 7), (4, LONG, "de", "b", 9), (5, "## ??", "fr", None, 5), (6, "日本語 テキスト é", "ja", "c", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, i, i, "s", i, None, "p", 0.5, "e", "r", 7, {"k": i}) for i, r in enumerate(ROWS)], ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_tokenizer():
    """The library itself, without anything of ours."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_shards(spark, odd, docs):
    from kinweave.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards

    for df, shards in ((odd, 3), (docs, 40), (odd.limit(0), 4)):
        got = shuffle_into_shards(df, shards).toPandas()
        assert len(got) == df.count() and set(df.columns) < set(got.columns)
        shard, slot = ("_shard", "_slot") if "shard" in df.columns else ("shard", "slot")
        sizes = [sorted(g[slot]) for _, g in got.groupby(shard)]
        assert all(s == list(range(len(s))) for s in sizes)
        if len(got):
            assert max(map(len, sizes)) - (min(map(len, sizes)) if len(sizes) == shards else 0) <= 1
    a, b = (shuffle_into_shards(docs.select("doc_id"), 5).orderBy("doc_id").collect() for _ in range(2))
    assert a == b
    m = communication_matrix([5, 0, 7], [4, 4, 4], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 7] and m.sum(axis=0).tolist() == [4, 4, 4]
    rng = np.random.default_rng(1)
    big = [hypergeometric(rng, 10**9, 3 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 250_000) < 5 * 433 / 200**0.5 and 250 < np.std(big) < 650


def test_shards_hold_whole_documents(spark, docs, monkeypatch):
    """The query deals whole rows, and its digest is that of the rows in the shards."""
    from kinweave.llm import queries, sharding

    given, plain = [], sharding.shuffle_into_shards

    def watched(df, *a, **b):
        given.append(df.columns)
        return plain(df, *a, **b)

    monkeypatch.setattr(sharding, "shuffle_into_shards", watched)
    got = queries.op1_shards(spark, SF).collect()
    assert given == [docs.columns]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts(docs))


def test_chunk_store(spark, odd, docs):
    from kinweave.llm.chunkstore import cuts, merkle_root, name_of, new_store_path, read_store, write_store

    tok = plain_tokenizer()
    for df in (docs, odd, odd.limit(0)):
        path = new_store_path(spark, "test")
        write_store(df, path)
        got = read_store(spark, path).collect()
        want = Counter((i, zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t in texts(df))
        assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
        ordered = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()][: len(ordered)]
        assert [r["doc_id"] for r in ordered if r["doc_id"] is not None] == sorted(r["doc_id"] for r in ordered if r["doc_id"] is not None)
        names = [bytes(r["name"]) for r in spark.read.parquet(f"{path}/chunks").collect()]
        assert len(names) == len(set(names))
        assert sum(r["documents"] for r in spark.read.parquet(f"{path}/manifest").collect()) == df.count()
    with pytest.raises(Exception, match="do not fit"):
        write_store(docs, new_store_path(spark, "test"), end_id=70_000)
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 9999, 5000)
    a, b = (np.concatenate([rng.integers(0, 9999, n), shared]) for n in (700, 1300))
    chunks = [{x[i:j].tobytes() for i, j in zip([0, *cuts(x)], cuts(x))} for x in (a, b)]
    assert len(chunks[0] & chunks[1]) > 3 and all(j - i <= 2048 for i, j in zip([0, *cuts(a)], cuts(a))) and cuts(np.zeros(9000, int))[-1] == 9000
    assert merkle_root([b"a"]) == b"a" and merkle_root([b"a", b"b"]) == name_of(b"ab")


def test_store_damage_is_found(spark, docs, tmp_path):
    from kinweave.llm.chunkstore import read_store, write_store

    path = f"file://{tmp_path}/store"
    write_store(docs.limit(20), path)
    chunks = spark.read.parquet(f"{path}/chunks")
    chunks.withColumn("ids", F.when(F.col("at") == 0, F.unhex(F.lit("0102"))).otherwise(F.col("ids"))).write.parquet(f"{path}/bad")
    spark.read.parquet(f"{path}/bad").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        read_store(spark, path).collect()


def test_lost_recipes_are_found(spark, docs, tmp_path):
    """A lost part, a lost document and documents changed together with their roots differ from the manifest."""
    import shutil

    from kinweave.llm.chunkstore import read_store, write_store

    path = f"file://{tmp_path}/store"
    write_store(docs.repartition(4), path)
    assert read_store(spark, path).count() == docs.count()
    shutil.copytree(f"{tmp_path}/store/recipes", f"{tmp_path}/whole")
    whole = spark.read.parquet(f"file://{tmp_path}/whole").cache()
    assert whole.count() == docs.count()
    some, first = whole.agg(F.max("part")).head()[0], whole.orderBy("start").head()
    swapped = whole.where(F.col("row") != first["row"]).unionByName(whole.where(F.col("row") == first["row"]).drop("root", "names", "n_tokens").crossJoin(whole.orderBy(F.desc("start")).limit(1).select("root", "names", "n_tokens")))
    for damaged in (whole.where(F.col("part") != some), whole.where(F.col("row") != first["row"]), swapped):
        damaged.write.mode("overwrite").parquet(f"{path}/recipes")
        with pytest.raises(Exception, match="damaged"):
            read_store(spark, path).collect()


def grams(text):
    import re

    w = re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", text)}


def classes(rows):
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[find(i)].append(d)
    return Counter(tuple(sorted(v, key=str)) for v in out.values())


def test_near_duplicates(spark, odd, docs):
    from kinweave.llm.dartminhash import drop_near_duplicates, near_duplicates, signatures

    base = [f"w{i}" for i in range(100)]
    cloud = [(1000 + k, " ".join(base[:k] + [f"n{k}"] + base[k + 1 :])) for k in range(0, 100, 3)] + [(2000, " ".join(base))]
    # far copies whose only near neighbour is not the centre of the cloud
    far = [" ".join(base[:30] + [f"f{i}" for i in range(k)] + base[30 + k :]) for k in (3, 7, 9, 11, 13, 15, 30)]
    made = spark.createDataFrame(cloud + [(3000 + i, t) for i, t in enumerate(far)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), made, odd.select("doc_id", "text"), odd.select("doc_id", "text").limit(0)):
        got, found = near_duplicates(df).collect(), defaultdict(list)
        want = classes(texts(df))
        for r in got:
            found[r["class_id"], r["class_size"]].append(r["doc_id"])
        assert Counter(tuple(sorted(v, key=str)) for v in found.values()) == want
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.select("doc_id").distinct().count() == 5
    nameless = spark.createDataFrame([(None, " ".join(base)), (None, " ".join([*base[:-1], "x"])), (None, "another text of five words")], "doc_id long, text string")
    assert drop_near_duplicates(nameless).count() == 2
    e = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5])]
    sig = signatures(e, [np.array([1.0, 2, 0.5, 7]), np.array([2.0, 1, 0.5, 3, 9])], 8000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(5.5 / 20.5, abs=0.03)
    few, many = signatures([np.arange(1, 3, dtype=np.uint64), np.arange(1, 5000, dtype=np.uint64)], k=96)
    assert len(set(few.tolist())) > 1 and len(set(many.tolist())) > 90


def test_surrogates(spark, odd, docs):
    from kinweave.llm import surrogates as S

    c = S.Cipher(b"k")
    assert sorted(c.number(i, 1000, "x") for i in range(1000)) == list(range(1000))
    text = "Frau Anna Müller and MR JONES, JSmith@Foo.co.uk, (415) 555-0199, +1 415 555 0199, DE89 3704 0044 0532 0130 00, 4111 1111 1111 1111, 123-45-6789, 10.0.0.1, token = \"0123456789abcdef\""
    new, counts = S.replace_entities(text, c, {})
    for gone in ("Müller", "JONES", "Foo", "555", "3704", "4111 1111 1111", "123-45", "10.0.0.1", "0123456789abcdef"):
        assert gone not in new
    assert counts == {"name": 2, "email": 1, "phone": 2, "iban": 1, "account": 1, "ssn": 1, "ip": 1, "secret": 1}
    found = {k: [new[a:b] for a, b, kind, _ in S.find_entities(new) if kind == k] for k in counts}
    assert S.luhn(found["account"][0].replace(" ", "")[:-1]) == int(found["account"][0][-1])
    assert "".join(filter(str.isdigit, found["phone"][0])) == "".join(filter(str.isdigit, found["phone"][1]))[1:]
    assert found["name"][1].isupper() and found["name"][0].split()[0] in S.NAMES["latin", "f"]
    mask = "password: ********, token = ----------"
    assert S.replace_entities(mask, c, {}) == (mask, {})
    new, counts = S.replace_entities("Contact John Smith, 06 12 34 56 78, SSN 123 45 6789; my name is John Smith, Dr John Smith and Mr Smith", c, {})
    assert counts == {"name": 4, "phone": 1, "ssn": 1} and "Smith" not in new and "John" not in new
    first, last = new.split(" ")[1], new.split(" ")[2].strip(",")
    assert first in S.NAMES["latin", "m"] and new.count(f"{first} {last}") == 3 and new.endswith(f"Mr {last}")
    same = "Nothing to see: 12.5 of 1.2.3, v1.2.3.4.5, 2024-01-02, a@b and The Of."
    assert S.replace_entities(same, c, {}) == (same, {})
    many = spark.createDataFrame([(i, f"mail user{i}@x.org or 10.0.{i}.7, Mr Smith{chr(97 + i % 26)} {chr(97 + i // 26)}") for i in range(200)], "doc_id long, text string")
    for limit in (S.MAX_BROADCAST, 0):
        rows = S.replace_personal_data(many, KEY, max_broadcast=limit).orderBy("doc_id").collect()
        cores = {(k, S.core_of(k, r["text"][a:b], g)) for r in rows for a, b, k, g in S.find_entities(r["text"])}
        real = {(k, S.core_of(k, t[a:b], g)) for _, t in texts(many) for a, b, k, g in S.find_entities(t)}
        assert not cores & real and len(cores) == len(real)
    out = S.replace_personal_data(odd, KEY).collect()
    assert sorted((r["text"] or "null") for r in out) == sorted((r["text"] or "null") for r in odd.collect())
    assert S.replace_personal_data(odd.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        S.replace_personal_data(odd, b"")


def test_many_names(spark):
    """More names than the lists hold: given names of the gender, one surname a word, no random letters."""
    from kinweave.llm import surrogates as S

    words = [a + b + c for a in ("Ka", "Lo", "Mi", "Ne") for b in ("bar", "den", "fil", "gos") for c in ("t", "k", "ra", "lo", "mund")]
    texts_ = [f"{form} {w} and {form} {g} {w}" for w in words for g in words[:12] for form in ("Mr", "Mrs")] + ["господин Иванов и господин Сергей Иванов"]
    many = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    given = {(s, g): {n for n in v} for (s, g), v in S.NAMES.items()}
    for limit in (S.MAX_BROADCAST, 0):
        whole, alone = defaultdict(set), defaultdict(set)
        for r in S.replace_personal_data(many, KEY, max_broadcast=limit).select("doc_id", "text").collect():
            (a, b, _, g), (c, d, _, _) = S.find_entities(r["text"])
            one, (first, *last) = r["text"][a:b], r["text"][c:d].split(" ")
            assert [one] == last, r["text"]
            assert set(first.split("-")) <= given["cyrillic" if r["doc_id"] == len(texts_) - 1 else "latin", g], r["text"]
            before = texts_[r["doc_id"]]
            whole[r["text"][c:d], g].add(before.split(" ", 4)[-1] if "and" in before else before)
            alone[one].add(before.split(" ")[1])
        assert len(whole) == len(set(texts_)) and all(len(x) == 1 for x in whole.values())
        assert len(alone) == len(words) + 1 and all(len(x) == 1 for x in alone.values())


def test_names_with_mixed_forms_of_address(spark):
    """Names are told apart as they are written: no two persons read alike after Mr, Mrs or Dr, and no real name comes back."""
    from kinweave.llm import surrogates as S

    words = [a + b + c for a in ("Ka", "Lo", "Mi") for b in ("bar", "den", "fil") for c in ("t", "ra", "mund")]
    forms = ("Mr", "Mrs", "Dr")
    texts_ = [f"{forms[i % 3]} {w}" for i, w in enumerate(words)] + [f"{forms[i % 3]} {g} {words[0]}" for i, g in enumerate(words)]
    # names that are real here and the first surrogates of others, after another form of address
    cipher = S.Cipher(KEY)
    texts_ += [f"{forms[(i + 1) % 3]} {S.replace_entities(f'{forms[i % 3]} {w}', cipher, {})[0].split(' ', 1)[1]}" for i, w in enumerate(words[:6])]
    real = {t.split(" ", 1)[1] for t in texts_}
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    for limit in (S.MAX_BROADCAST, 0):
        made = [r["text"].split(" ", 1)[1] for r in S.replace_personal_data(docs, KEY, max_broadcast=limit).collect()]
        assert len(set(made)) == len(real) and not set(made) & real


def test_exceptions_of_repeated_texts(spark, monkeypatch):
    """Copies of one text bring its exceptional entities once into the join path."""
    from kinweave.llm import surrogates as S

    longest, plain = [], S.stage

    def watched(df, name):
        out = plain(df, name)
        if name == "per-text":
            longest.append(out[0].agg(F.max(F.size("_kw_odd"))).head()[0])
        return out

    monkeypatch.setattr(S, "stage", watched)
    people = ", ".join(f"Mr {a}{b} Smith" for a in "ABCDEFGH" for b in ("ob", "al", "en", "im", "ud"))
    docs = spark.createDataFrame([(i, people if i < 300 else f"{people}, {i}") for i in range(310)], "doc_id long, text string")
    joined, broadcast = (S.replace_personal_data(docs, KEY, max_broadcast=n).select("doc_id", "text").orderBy("doc_id").collect() for n in (0, S.MAX_BROADCAST))
    assert joined == broadcast and len({r["text"] for r in joined[:300]}) == 1
    assert 0 < longest[0] <= 40


def test_nearest(spark):
    from kinweave.llm.dimscan import nearest

    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = df.toPandas()
    x, ids = np.stack(v["embedding"].to_numpy()).astype(float), v["vec_id"].to_numpy()
    got = nearest(df, F.col("vec_id") % 5 == 0).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(ids[best]) & set(g["vec_id"]))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g["score"], [d[ids == i][0] for i in g["vec_id"]], rtol=1e-12) and (np.diff(g["score"]) >= 0).all()
    assert hits >= 0.9 * len(got)
    odd = spark.createDataFrame([(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, None, 2), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, float("nan")], 0), (6, [1.0], 0), (7, [0.0, 2.0], 0)], "vec_id long, embedding array<double>, rank int")
    rows = [tuple(r)[:3] for r in nearest(odd, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 1), (0, 2, 100), (0, 3, 7), (100, 1, 0), (100, 2, 1), (100, 3, 7)]
    assert nearest(odd.limit(0), F.lit(True)).count() == 0
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    hot = nearest(same, F.col("vec_id") % 1000 == 0, chunk=500, block=1).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in hot[:10]] == list(range(1, 11)) and len(hot) == 30


def test_packing(spark, odd, docs):
    from kinweave.llm.packing import BestFit, pack

    tok = plain_tokenizer()
    for df in (docs, docs.repartition(70), odd, odd.limit(0)):
        got = pack(df).toPandas()
        want = Counter()
        for i, t in texts(df):
            ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
            for k, a in enumerate(range(0, len(ids), 2048)):
                want[str(i), k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
        assert Counter((str(i if i == i and i is not None else None).removesuffix(".0"), p, s, n, c) for i, p, s, n, c in zip(got["doc_id"].astype(object), got["piece"], got["start"], got["length"], got["ids_crc32"])) == want
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
        if df is not odd:
            # as good on many small partitions
            assert got["sequence_id"].nunique() <= 1.05 * -(-got["length"].sum() // 2048) + 3
    b = BestFit(10, 2)
    assert [b.place(n) for n in (6, 5, 4, 9, 5)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 5)]
    with pytest.raises(ValueError):
        b.place(11)


def test_exact_dedup(spark, odd, docs):
    from kinweave.llm.bloomdedup import dedup_report, exact_dedup

    for df, bits in ((docs, 1 << 30), (docs, 1 << 15), (odd, 1 << 30), (odd.limit(0), 1 << 30)):
        groups = defaultdict(list)
        for i, t in texts(df):
            groups[t].append(i)
        got = dedup_report(df, max_bits=bits).collect()
        assert len(got) == df.count() and sum(r["kept"] for r in got) == len(groups)
        best = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in v if i is not None), default=None), len(v)) for t, v in groups.items()}
        assert all((r["keep_id"], r["group_size"]) == best[r["text_sha256"]] for r in got)
        kept = exact_dedup(df, max_bits=bits)
        assert kept.columns == df.columns and sorted(r["text"] or "" for r in kept.collect()) == sorted(groups)


def test_token_counts(spark, odd, docs):
    import public_tokenizers
    import tiktoken

    from kinweave.llm.sepscan import roster, scan_separators, write_flat
    from kinweave.llm.tokens import byte_ranks, vocabulary_path

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(vocabulary_path("byte_bpe_50k.tiktoken")), special_tokens={})
    for df in (docs, odd, odd.limit(0)):
        flat = write_flat(df, 50256, block=1000).cache()
        got = scan_separators(flat, 50256).join(roster(flat), ["file", "nth"]).collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(enc.encode_ordinary(t))) for i, t in texts(df))
    pack = lambda *x: np.array(x, "<u2").tobytes()
    flat = spark.createDataFrame([(0, 0, pack(5, 9, 5, 5)), (0, 1, b""), (0, 2, pack(5, 5)), (0, 3, pack(9, 9, 3)), (1, 0, None), (2, 0, pack(9))], "file int, block int, ids binary")
    assert [tuple(r) for r in scan_separators(flat, 9).orderBy("file", "nth").collect()] == [(0, 0, 0, 1, True), (0, 1, 2, 4, True), (0, 2, 7, 0, True), (0, 3, 8, 1, False), (2, 0, 0, 0, True)]


def test_language_id(spark, odd, docs):
    from kinweave.llm.langid import held_out, predict, train

    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(big.where(~held_out()))
    got = predict(big.withColumn("held", held_out()), model).where("held").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    rows = {r["slot.x"]: (r["_lang_pred"], r["_score"]) for r in predict(odd, model).collect()}
    assert rows[0] == rows[1] == rows[6] == ("und", 0.0) and rows[7][0] in model[0] and len(rows) == len(ROWS)
    assert predict(odd.limit(0), model).count() == 0
    none = train(odd.limit(0))
    assert {r["_lang_pred"] for r in predict(odd, none).collect()} == {"und"}
    assert len(train(big, train_docs=500)[0]) == 4


def test_byte_bpe(spark, odd, docs):
    import public_tokenizers
    import tiktoken

    from kinweave.llm.bytebpe import encode_decode
    from kinweave.llm.tokens import vocabulary_path

    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    hard = [(1, "a" * 5000), (2, "abcabc" * 900), (3, "😀é" * 40 + " \n\n  x"), (4, letters("abcdefghij", 20_000)), (5, letters("日本語テキスト漢字ーん", 4000)), (6, letters("aab", 3000)), (7, letters("ethrs", 3000))]
    hard = spark.createDataFrame(hard, "doc_id long, text string")
    for df in (docs, odd, hard, odd.limit(0)):
        want = Counter()
        for i, t in texts(df):
            ids = enc.encode_ordinary(t)
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
        assert Counter(tuple(r)[:4] for r in encode_decode(df, with_ids=True).collect()) == want


def test_pipeline(spark, odd, docs):
    import corpus_pipeline as P

    rows = docs
    for name, f in P.STAGES[:-1]:
        before, rows = rows, f(spark, rows, SF).cache()
        assert rows.columns == docs.columns and 0 < rows.count() <= before.count(), name
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == {r["doc_id"] for r in rows.collect()}
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "surrogates", "best_fit_packing"]
    for df in (odd, odd.limit(0)):
        for _, f in P.STAGES:
            df = f(spark, df, SF)
        df.count()


def test_words_with_marks_and_digits():
    """Words that are taken apart before they are encoded: as the tokenizers library encodes the whole text."""
    from kinweave.llm.tokens import vocabulary_path, word_encoder

    encoder, rng = word_encoder(vocabulary_path("word_bpe_49k.json")), np.random.default_rng(5)
    alphabet = np.array(list("abcdstremvlXZ'''019.,,#$%&*_-@/:<>|!?\"()[]{}~`^\\+=;\n\t  éßñÀİŉǅ×÷ª² \u0085̇Σςя日﷐"))
    texts = ["", "word.###", "don't'll", "a1" * 5000, "x" * 6000 + ".###", "<|endoftext|>", *("".join(rng.choice(alphabet, n)) for n in rng.integers(1, 60, 5000))]
    wanted = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 1000):  # later slices meet known words
        assert encoder.encode(texts[at : at + 1000]) == wanted[at : at + 1000]
    assert not any(len(w) > encoder.memory.longest for w in encoder.memory.known)


def test_words_of_a_slice_are_looked_up_once():
    """Repeated words cost no lookup of their own, and a full memory changes no ids."""
    from kinweave.llm.tokens import WordEncoder, vocabulary_path

    class Counted(dict):
        looked = 0

        def get(self, *key):
            Counted.looked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    encoder, rng = WordEncoder(vocabulary_path("word_bpe_49k.json")), np.random.default_rng(9)
    wanted = lambda texts: [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder.memory.known = Counted()
    texts = ["", " ", *[f"one plain text, no{i % 7} 'S of it.\n" * 5 for i in range(500)], "x" * 300, "<|startoftext|> here", ""]
    assert encoder.encode(texts) == wanted(texts)
    assert Counted.looked < 200
    assert encoder.encode([]) == [] and encoder.encode(["", "<|endoftext|>"]) == wanted(["", "<|endoftext|>"])
    words = ["".join(rng.choice(list("abcdeÄß.,1-ж"), n)) for n in rng.integers(1, 9, 400)] + ["y" * 250]
    encoder.memory.most = 150
    for _ in range(40):
        texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 30, 6)]
        assert encoder.encode(texts) == wanted(texts)
        assert len(encoder.memory.known) < 500 and "y" * 250 not in encoder.memory.known
        assert list(encoder.memory.known.values()) == list(range(len(encoder.memory.bounds) - 1)) and encoder.memory.bounds[-1] == len(encoder.memory.ids)


def test_cuts_of_many_streams():
    """Streams that are cut together: as each is cut alone."""
    from kinweave.llm.chunkstore import cuts, cuts_of_many

    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 49408, n).astype("<u4") for n in [1, 1, 127, 128, 129, 9000, 2, *rng.integers(1, 4000, 200)]] + [np.full(7000, 5, "<u4")]
    assert cuts_of_many(np.concatenate(streams), np.cumsum([len(s) for s in streams])) == [cuts(s) for s in streams]


def test_surrogates_end(spark):
    """Formats without room end: secrets that cannot change, mail names of one letter, phone numbers that are all real; every entity of its own, none real."""
    from kinweave.llm import surrogates as S

    made = [f"{chr(97 + i)}@x.org" for i in range(26)] + [f"secret = {'٣' * 9}{'٤' * i}" for i in range(3)] + [f"06 1{i} 22 22 22" for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    real = {(k, S.core_of(k, t[a:b], g)) for t in made for a, b, k, g in S.find_entities(t)}
    for limit in (S.MAX_BROADCAST, 0):
        new = [r["text"] for r in S.replace_personal_data(docs, KEY, max_broadcast=limit).select("text").collect()]
        assert len(set(new)) == len(made) and not set(new) & set(made)
    assert len(real) == len(made)
    # each format grows from some attempt on
    for kind, core in (("email", "a@b.de"), ("phone", "12345"), ("account", "4111111111111111"), ("ssn", "123456789"), ("iban", "DE89370400440532013000"), ("secret", "0123456789abcdef"), ("secret", "٣٣٣٣٣٣٣٣"), ("ip", "1.2.3.4")):
        sizes = [len(S.surrogate(S.Cipher(KEY), kind, core, n)) for n in range(S.NARROW + 4)]
        assert sizes[-1] > sizes[-2] > sizes[0], (kind, sizes)


def test_genders_from_elsewhere(spark):
    """A given name that no list knows has the gender of its other mentions, in both ways that exceptions travel."""
    from kinweave.llm import surrogates as S

    docs = spark.createDataFrame([(1, "Frau Xandra Muster"), (2, "Dr Xandra Muster"), (3, "Dr Quorin Muster"), (4, "Mr Xandrov Muster")], "doc_id long, text string")
    for limit in (S.MAX_BROADCAST, 0):
        new = {r["doc_id"]: r["text"].split(" ", 1)[1] for r in S.replace_personal_data(docs, KEY, max_broadcast=limit).collect()}
        assert new[1] == new[2] and len(set(new.values())) == 3 and new[1].split(" ")[0].split("-")[0] in S.NAMES["latin", "f"]


def plain_bayes(rows, orders=(1, 2, 3), buckets=1 << 15):
    """Naive Bayes written plainly: hashes one n-gram at a time."""
    import math

    odd_numbers = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]

    def found(t):
        codes = [0, 0, 0, *(ord(c) if c.isalpha() else 32 for c in t.lower()), 0, 0, 0]
        for i in range(3, len(codes)):
            for n in orders:
                h = n + sum((codes[i - k] + 1) * odd_numbers[k] for k in range(n)) & 0xFFFFFFFF
                h ^= h >> 15
                h = h * 0x2C1B3C6D & 0xFFFFFFFF
                h ^= h >> 13
                yield h & buckets - 1

    counts, docs = defaultdict(Counter), Counter()
    for t, lang in rows:
        counts[lang].update(found(t))
        docs[lang] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}

    def tell(t):
        sums = {x: math.log(docs[x] / sum(docs.values())) for x in docs}
        for g in found(t):
            for x in sums:
                sums[x] += math.log((counts[x][g] + 1) / (total[x] + buckets))
        top = max(sorted(sums), key=sums.get)
        return top, 1 / sum(math.exp(v - sums[top]) for v in sums.values())

    return tell


def test_language_id_by_hand(spark, docs, monkeypatch):
    from kinweave.llm import langid

    rows = [(r["doc_id"], (r["text"] or "")[:400], r["lang"]) for r in docs.collect()]
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tell = plain_bayes([(t, x) for d, t, x in rows if x is not None and zlib.crc32(str(d).encode()) % 3 != 1])
    want = {d: tell(t) if any(c.isalpha() for c in t) else ("und", 0.0) for d, t, _ in rows}
    for cells in (2_000_000, 400):  # whole texts, and pieces of them
        monkeypatch.setattr(langid, "_CELLS", cells)
        got = langid.predict(small, langid.train(small.where(~langid.held_out()))).collect()
        assert {r["doc_id"]: r["lang_pred"] for r in got} == {d: x for d, (x, _) in want.items()}
        assert all(r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-9) for r in got)
    part = list(langid.pieces(["abcdefgh", "", "İx"], 3, 2))
    assert [("".join(t[k:] for p in part for i, t, k, _ in p if i == n)) for n in range(3)] == ["abcdefgh", "", "i̇x"]


def test_nearest_exactly(spark):
    """With all lists and no test the search is exact; repeated ids count once."""
    import math

    from kinweave.llm.dimscan import calibrated, column_blocks, fit_centroids, nearest, scan

    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.normal(size=(150, 20)) * 0.3 for c in rng.normal(size=(8, 20)) * 4])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 10 == 0, probed=1.0, critical=math.inf, chunk=100, block=50).toPandas()
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert g.sort_values("rank")["vec_id"].tolist() == [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
    # in clusters few lists hold nearly all neighbours
    assert calibrated(x, fit_centroids(x, 64), 10) <= 16
    far = scan(x[:3], column_blocks(x), np.array([1.0, 1.0, np.inf]), 2.1)
    exact = ((x[:3, None, :] - x[None]) ** 2).sum(axis=2)
    assert np.allclose(far[2], exact[2]) and (np.isinf(far[:2]) | np.isclose(far[:2], exact[:2])).all() and np.isinf(far[:2]).mean() > 0.5


def test_registered_queries(spark, docs):
    """Every query as it is registered, with its columns, against plain code over the whole table."""
    import public_tokenizers
    import tiktoken

    from kinweave.llm import queries as Q

    rows, tok = texts(docs), plain_tokenizer()
    by_id = dict(rows)
    out = {n: f(spark, SF).collect() for n, f in Q.QUERIES.items()}
    one = out["op1_shards"]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in one) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in rows)
    per = Counter(r["shard"] for r in one)
    assert set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1 and {r["law"] for r in one} == {"rows"} and {r["grown_shard"] for r in one} == {None}
    assert all(sorted(r["slot"] for r in one if r["shard"] == s) == list(range(per[s])) for s in per)
    at = 0
    for d, r in zip(sorted(by_id), sorted(out["op2_chunk_store"], key=lambda r: r["doc_id"])):
        ids = np.array(tok.encode(by_id[d], add_special_tokens=False).ids + [1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = defaultdict(list)
    for r in out["op3_near_dedup"]:
        found[r["class_id"], r["class_size"]].append(r["doc_id"])
    assert Counter(tuple(sorted(v, key=str)) for v in found.values()) == classes(rows)
    changed = {r["doc_id"]: r for r in out["op4_surrogates"]}
    assert set(changed) == set(by_id) and all((r["text"] or "") == by_id[d] for d, r in changed.items() if not r["replaced"]) and any(r["replaced"] for r in changed.values())
    pieces = defaultdict(list)
    for r in out["op6_best_fit_packing"]:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in out["op6_best_fit_packing"]) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in by_id.values())
    for v in pieces.values():
        v.sort()
        assert [a for a, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]] and sum(n for _, n in v) <= 2048
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    want = Counter((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out["op7_exact_dedup"]) == want
    ranks = lambda name: {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    flat = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks("byte_bpe_50k.tiktoken"), special_tokens={})
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out["op8_token_counts"]) == Counter((d, len(flat.encode_ordinary(t))) for d, t in rows)
    nine = {r["doc_id"]: r for r in out["op9_language_id"]}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for d, r in nine.items()) and set(nine) == set(by_id)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect() if r["lang"]}
    assert np.mean([nine[d]["lang_pred"] == x for d, x in truth.items() if nine[d]["held_out"]]) > 0.9
    multi = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks("byte_bpe_multi_50k.tiktoken"), special_tokens={})
    want = Counter()
    for d, t in rows:
        ids = multi.encode_ordinary(t)
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out["op10_byte_bpe"]) == want
