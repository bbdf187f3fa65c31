"""Queries over business records: normal forms, candidate pairs by all search paths, rescues, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import places
from kinweave.functions import text as X
from kinweave.operators import blocking as B
from kinweave.operators import decide as D
from kinweave.operators import learn as L
from kinweave.operators import pairs as P
from kinweave.operators import records as R
from kinweave.plans import records as T
from kinweave.plans.registry import CLEAN_SQL, big, query, rounded
from kinweave.sources import files as S

_NORMAL = "entity_id, name_core, name_legal, name_phon, addr_text, addr_state, addr_nums, addr_empty"


@query(f"WITH {T.RECORDS_CTE} SELECT {_NORMAL} FROM s1 UNION ALL SELECT {_NORMAL} FROM pool")
def normalized_records(spark, d):
    """Cores, legal forms and sounds of names, canonical addresses with state and numbers, of all records."""
    cols = _NORMAL.split(", ")
    return T.s1(spark, d).select(cols).unionByName(T.pool(spark, d).select(cols))


_ALL = "r AS (SELECT * FROM s1 UNION ALL SELECT * FROM pool)"
_CODES = sorted({c for country in ("US", "India", "") for c in places.state_codes(country).values()})
_STREETS = sorted(set(places.ABBREVIATIONS) | set(places.ABBREVIATIONS.values()))
_RAW = "regexp_extract_all(replace(lower(strip_accents(business_name)), '.', ''), '[a-z0-9]+')"


@query(f"""WITH {T.RECORDS_CTE}, {_ALL} SELECT entity_id, array_to_string(list_sort(list_filter(list_transform(list_filter(string_split(addr_text, ' '), lambda t: NOT list_contains({T._list(_CODES)}, t)), lambda t: ltrim(t, '0')), lambda t: t <> '')), ' ') AS order_free,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(string_split(name_legal, ' '), lambda t: t <> ''), lambda t: CASE t WHEN 'sasu' THEN 'sas' WHEN 'eurl' THEN 'sarl' WHEN 'pvt' THEN 'ltd' WHEN 'public' THEN '' WHEN 'co' THEN '' ELSE t END), lambda t: t <> ''))), ' ') AS family,
    array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(addr_text, '[a-z]+'), lambda t: len(t) > 2))), ' ') AS street, array_to_string(list_sort(list_filter({_RAW}, lambda t: NOT list_contains({T._list(X._RAW_LEGAL)}, t))), ' ') AS body,
    array_to_string(list_sort(list_distinct(list_filter({_RAW}, lambda t: list_contains({T._list(X._RAW_LEGAL)}, t)))), ' ') AS legal, CASE WHEN addr_state = 'ts' THEN 'ap' ELSE addr_state END AS merged, substr(entity_id, 1, 2) AS source,
    CASE WHEN addr_state <> '' AND business_address <> '' THEN lower(trim(split_part(business_address, ',', 2))) ELSE '' END AS city,
    array_to_string(list_filter(list_transform(list_filter(string_split(business_address, ','), lambda c: c <> ''), lambda c: {CLEAN_SQL.format('c')}), lambda c: c <> addr_state AND NOT regexp_matches(c, '[0-9]') AND NOT list_has_any(string_split(c, ' '), {T._list(_STREETS)}) AND NOT list_contains({T._list([n for n in sorted({k for c in ("US", "India", "") for k in places.state_codes(c)})])}, c)), '|') AS localities
    FROM r""")
def record_keys(spark, d):
    """Keys and parts of names and addresses that joins and features use."""
    raw = T.raw_s1(spark, d).unionByName(T.raw_pool(spark, d))
    parts = R.address_components(raw).withColumnsRenamed({"business_address": "ba", "country": "co"})
    r = R.normalise(raw).join(parts, F.col("business_address").eqNullSafe(F.col("ba")) & F.col("country").eqNullSafe(F.col("co")))
    return r.select(
        "entity_id", X.order_free(F.col("addr_text"), _CODES).alias("order_free"), X.join(X.legal_families(F.col("name_legal"))).alias("family"), X.join(F.array_sort(X.street_words(F.col("addr_text")))).alias("street"),
        X.body(F.col("business_name")).alias("body"), X.join(X.raw_legal(F.col("business_name"))).alias("legal"), X.merged_state(F.col("addr_state")).alias("merged"), X.source_of(F.col("entity_id")).alias("source"),
        X.city(F.col("parts")).alias("city"), F.array_join(X.localities(F.col("parts")), "|").alias("localities"),
    )


@query(f"""WITH {T.RECORDS_CTE}, w AS (SELECT DISTINCT entity_id, country, addr_state AS state, unnest(string_split(addr_text, ' ')) AS word FROM s1 WHERE addr_state <> ''), n AS (SELECT country, word, state, count(*) AS n FROM w WHERE len(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY ALL),
    g AS (SELECT country, word, sum(n) AS total, max(n) AS top, arg_max(state, (n, state)) AS says FROM n GROUP BY ALL), m AS (SELECT country, word, says FROM g WHERE total >= 5 AND top / total >= 0.97),
    v AS (SELECT entity_id, says, count(*) AS n FROM (SELECT DISTINCT entity_id, country, unnest(string_split(addr_text, ' ')) AS word FROM pool WHERE addr_state = '' AND addr_text <> '') JOIN m USING (country, word) GROUP BY ALL),
    b AS (SELECT entity_id, arg_max(says, (n, says)) AS inferred FROM v GROUP BY entity_id HAVING max(n) / sum(n) >= 0.8) SELECT entity_id, coalesce(inferred, addr_state) AS addr_state, CASE WHEN inferred IS NULL THEN addr_text ELSE addr_text || ' ' || inferred END AS addr_text FROM pool LEFT JOIN b USING (entity_id)""")
def inferred_states(spark, d):
    """States for records whose address has none, from the words of the S1 addresses."""
    return R.infer_states(T.pool(spark, d), R.state_words(T.s1(spark, d), support=5)).select("entity_id", "addr_state", "addr_text")


# candidate pairs

_PART = "CASE WHEN addr_state = '' THEN '' ELSE country || '/' || CASE WHEN addr_state = 'ts' THEN 'ap' ELSE addr_state END END"
_WORD_GRAMS = "flatten(list_transform(list_filter(string_split({0}, ' '), lambda t: t <> ''), lambda t: list_transform(range(1, len(t) + 1), lambda i: substr(' ' || t || ' ', i, 3))))"
_CHAR_GRAMS = "list_transform(range(1, len({0}) - 1), lambda i: substr({0}, i, 3))"
_CAT = "replace(regexp_replace(name_core, '\\b(and|the|of)\\b', '', 'g'), ' ', '')"
_SHARE = 0.6
_SEARCH = f"""both_ AS (SELECT 1 AS side, entity_id AS id, country, {_PART} AS part, name_core, name_phon, addr_text, addr_nums FROM s1 UNION ALL SELECT 2, entity_id, country, {_PART}, name_core, name_phon, addr_text, addr_nums FROM pool),
    gr AS (SELECT side, id, country, path, gram, count(*) AS tf FROM (SELECT side, id, country, 'name' AS path, unnest({_WORD_GRAMS.format('name_core')}) AS gram FROM both_ UNION ALL SELECT side, id, country, 'phon', unnest({_WORD_GRAMS.format('name_phon')}) FROM both_
        UNION ALL SELECT side, id, country, 'addr', unnest({_WORD_GRAMS.format('addr_text')}) FROM both_ UNION ALL SELECT side, id, country, 'cat', unnest({_CHAR_GRAMS.format(_CAT)}) FROM both_) GROUP BY ALL),
    nn AS (SELECT country, count(*) AS n FROM both_ GROUP BY ALL), ii AS (SELECT country, path, gram, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT country, path, gram, count(*) AS df FROM gr GROUP BY ALL) JOIN nn USING (country) WHERE df >= 2 AND df <= n * {_SHARE}),
    w1 AS (SELECT side, id, path, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id, path)) AS w FROM (SELECT side, id, path, gram, (1 + ln(tf)) * idf AS w FROM gr JOIN ii USING (country, path, gram))),
    w2 AS (SELECT side, id, 'comb' AS path, path || ':' || gram AS gram, w * CASE path WHEN 'name' THEN sqrt(0.6) ELSE sqrt(0.4) END AS w FROM w1 WHERE path IN ('name', 'addr')),
    vec AS (SELECT * FROM w1 UNION ALL SELECT side, id, path, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) FROM w2),
    va AS (SELECT id AS s1_id, part, country, path, gram, w FROM vec JOIN both_ USING (side, id) WHERE side = 1), vb AS (SELECT id AS m_id, part, country, path, gram, w FROM vec JOIN both_ USING (side, id) WHERE side = 2),
    cs AS (SELECT path, s1_id, m_id, round(sum(va.w * vb.w), 9) AS cos FROM va JOIN vb USING (part, path, gram) WHERE part <> '' GROUP BY ALL HAVING cos > 1e-6),
    sl AS (SELECT path, s1_id, m_id, round(sum(va.w * vb.w), 9) AS cos FROM va JOIN vb USING (country, path, gram) WHERE vb.part = '' GROUP BY ALL HAVING cos > 1e-6)"""
_FOUND = """SELECT s1_id, m_id, CASE path WHEN 'name' THEN 1 WHEN 'phon' THEN 2 WHEN 'addr' THEN 4 WHEN 'comb' THEN 8 ELSE 16 END AS via FROM (SELECT *, row_number() OVER (PARTITION BY path, s1_id ORDER BY cos DESC, m_id) AS r FROM cs) WHERE r <= CASE path WHEN 'name' THEN 15 WHEN 'phon' THEN 10 WHEN 'addr' THEN 15 WHEN 'comb' THEN 20 ELSE 5 END
    UNION ALL SELECT s1_id, m_id, 32 FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY cos DESC, s1_id) AS r FROM cs WHERE path = 'comb') WHERE r <= 3
    UNION ALL SELECT s1_id, m_id, CASE path WHEN 'name' THEN 128 WHEN 'phon' THEN 256 WHEN 'cat' THEN 512 WHEN 'addr' THEN 1024 ELSE 2048 END FROM (SELECT *, row_number() OVER (PARTITION BY path, m_id ORDER BY cos DESC, s1_id) AS r FROM sl) WHERE r <= 20"""
_EXACT = " UNION ALL ".join(
    f"SELECT a.id, b.id, {bit} FROM both_ a JOIN both_ b ON a.side = 1 AND b.side = 2 AND a.part = b.part AND a.{key} = b.{key} WHERE a.part <> '' AND len(a.{key}) >= 4 AND (a.part, a.{key}) IN (SELECT (part, {key}) FROM both_ WHERE side = 1 GROUP BY part, {key} HAVING count(*) <= 30) AND (a.part, a.{key}) IN (SELECT (part, {key}) FROM both_ WHERE side = 2 GROUP BY part, {key} HAVING count(*) <= 150)"
    for key, bit in (("name_core", 65536), ("name_phon", 131072), ("addr_text", 262144))
)
_NUMTOK = """tok AS (SELECT DISTINCT side, id, part, token, unnest(string_split(addr_nums, ' ')) AS num FROM (SELECT side, id, part, addr_nums, unnest(string_split(name_phon, ' ')) AS token FROM both_ WHERE part <> '' AND addr_nums <> '') WHERE len(token) >= 3),
    okk AS (SELECT part, token, num FROM tok GROUP BY ALL HAVING count(CASE WHEN side = 1 THEN 1 END) BETWEEN 1 AND 10 AND count(CASE WHEN side = 2 THEN 1 END) BETWEEN 1 AND 40)"""
_NUMTOK_PAIRS = "SELECT DISTINCT a.id, b.id, 524288 FROM tok a JOIN tok b ON a.side = 1 AND b.side = 2 AND a.part = b.part AND a.token = b.token AND a.num = b.num JOIN okk ON okk.part = a.part AND okk.token = a.token AND okk.num = a.num"
_STATELESS_EXACT = " UNION ALL ".join(
    f"SELECT a.id, b.id, 1048576 FROM both_ a JOIN both_ b ON a.side = 1 AND b.side = 2 AND a.country = b.country AND a.{key} = b.{key} WHERE b.part = '' AND len(a.{key}) >= 4 AND (a.country, a.{key}) IN (SELECT (country, {key}) FROM both_ WHERE side = 1 GROUP BY country, {key} HAVING count(*) <= 30)"
    for key in ("name_core", "name_phon")
)
_CANDIDATES = f"""{T.RECORDS_CTE}, {_SEARCH}, {_NUMTOK}, fnd AS ({_FOUND} UNION ALL {_EXACT} UNION ALL {_NUMTOK_PAIRS} UNION ALL {_STATELESS_EXACT}), cand AS (SELECT s1_id, m_id, bit_or(via) AS via FROM fnd GROUP BY ALL)"""
_COS = ", ".join(f"round(coalesce(sum(va.w * vb.w) FILTER (va.path = '{p}'), 0.0), 6) AS cos_{p}" for p in ("name", "phon", "addr", "comb", "cat"))


def found_pairs(spark, d):
    return T.held(spark, d, "found", lambda: B.candidate_pairs(T.s1(spark, d), T.pool(spark, d), max_share=_SHARE))


@query(f"WITH {_CANDIDATES} SELECT s1_id, m_id, via, {_COS} FROM cand LEFT JOIN va USING (s1_id) LEFT JOIN vb USING (m_id, path, gram) GROUP BY s1_id, m_id, via")
def candidate_pairs(spark, d):
    """The union of all search paths with the bits of the paths that found a pair and its five cosines on whole vectors."""
    return rounded(found_pairs(spark, d), *B.COSINES)


_TRUTH = "truth AS (SELECT 'S1-' || CAST(k AS VARCHAR) AS s1_id, entity_id AS m_id FROM raw_pool WHERE variant NOT IN (2, 5))"


def truth(spark, d):
    return T.raw_pool(spark, d).where("variant NOT IN (2, 5)").select(F.concat(F.lit("S1-"), F.col("k").cast("string")).alias("s1_id"), F.col("entity_id").alias("m_id")).hint("merge")


@query(f"""WITH {_CANDIDATES}, {_TRUTH}, hit AS (SELECT via FROM cand JOIN truth USING (s1_id, m_id)), p AS (SELECT unnest({T._list(B.PATHS)}) AS path, unnest(range(0, {len(B.PATHS)})) AS bit)
    SELECT path, count(CASE WHEN (via >> bit) & 1 = 1 THEN 1 END) AS hits, count(CASE WHEN via = (1 << bit) THEN 1 END) AS alone, (SELECT count(*) FROM truth) AS total FROM p LEFT JOIN hit ON true GROUP BY path""")
def blocking_report(spark, d):
    """For each search path the true pairs it finds and those that it alone finds."""
    hit = found_pairs(spark, d).join(truth(spark, d), ["s1_id", "m_id"], "left_semi").select("via")
    each_ = hit.agg(*[F.struct(F.lit(p).alias("path"), F.count(F.when(F.col("via").bitwiseAND(F.lit(1 << i)) != 0, 1)).alias("hits"), F.count(F.when(F.col("via") == 1 << i, 1)).alias("alone")).alias(p) for i, p in enumerate(B.PATHS)])
    rows = each_.select(F.inline(F.array(*[F.col(p) for p in B.PATHS])))
    return rows.join(F.broadcast(truth(spark, d).agg(F.count("*").alias("total"))))


@query(f"""WITH {_CANDIDATES}, {_TRUTH}, n AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1), h AS (SELECT s1_id, count(*) AS hits FROM cand JOIN truth USING (s1_id, m_id) GROUP BY 1), x AS (SELECT entity_id, coalesce(n_true, 0) AS n_true, coalesce(hits, 0) AS hits FROM s1 LEFT JOIN n ON n.s1_id = entity_id LEFT JOIN h ON h.s1_id = entity_id)
    SELECT count(*) AS entities, (SELECT count(*) FROM cand) AS candidates, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(n_true) AS BIGINT) AS total, round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN hits = 0 THEN 0.0 ELSE 1.25 * hits / (hits + 0.25 * n_true) END), 9) AS oracle_f05 FROM x""")
def blocking_quality(spark, d):
    """Recall of the candidates and the F0.5 that a perfect judge would reach on them."""
    cand, t = found_pairs(spark, d), truth(spark, d)
    entities = T.raw_s1(spark, d).select(F.col("entity_id").alias("s1_id"))
    x = D.entity_f05(entities, cand.join(t, ["s1_id", "m_id"], "left_semi"), t)
    return rounded(x.agg(F.count("*").alias("entities"), F.sum("hits").alias("hits"), F.sum("n_true").alias("total"), F.avg("f05").alias("oracle_f05")).join(F.broadcast(cand.agg(F.count("*").alias("candidates")))), "oracle_f05", digits=9)


@query(f"""WITH {T.RECORDS_CTE}, {_SEARCH}, {_TRUTH}, r AS (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY cos DESC, s1_id) AS rank FROM cs WHERE path = 'comb'), t AS (SELECT rank, count(*) AS n FROM r JOIN truth USING (s1_id, m_id) GROUP BY rank)
    SELECT rank, n, round(sum(n) OVER (ORDER BY rank) / (SELECT count(*) FROM truth), 9) AS recall FROM t""")
def true_ranks(spark, d):
    """At which rank among its record's candidates the true S1 stands, by the combined vector within a state."""
    s1, pool = T.s1(spark, d), T.pool(spark, d)
    return rounded(big(B.true_ranks(s1, pool, truth(spark, d), max_share=_SHARE), "rank"), "recall", digits=9)


@query(f"""WITH {T.RECORDS_CTE}, sh AS (SELECT part, n FROM (SELECT {_PART} AS part, unnest(string_split(addr_nums, ' ')) AS n FROM s1) WHERE n <> '' GROUP BY ALL HAVING count(*) <= 3000), vocab AS (SELECT DISTINCT {_PART} AS part, unnest(string_split(name_core, ' ')) AS t FROM s1),
    strange AS (SELECT *, {_PART} AS part FROM pool WHERE addr_state <> '' AND entity_id NOT IN (SELECT entity_id FROM (SELECT entity_id, {_PART} AS part, unnest(string_split(replace(name_core, 'widget', 'zzz'), ' ')) AS t FROM pool) p JOIN vocab USING (part, t)))
    SELECT count(*) AS n FROM strange""")
def trade_name_records(spark, d):
    """How many records with a state share no word of their name with any S1 of it."""
    s1, pool = (T.s1(spark, d), T.pool(spark, d))
    (a, b) = B.state_parts(s1, pool)
    words = lambda df, p, c: df.join(p.select(F.col("id").alias("entity_id"), "part"), "entity_id").where("part <> ''").select("entity_id", "part", F.explode(X.tokens(c)).alias("t"))
    known = words(s1, a, F.col("name_core")).select("part", "t").distinct()
    shared = words(pool, b, F.replace(F.col("name_core"), F.lit("widget"), F.lit("zzz"))).join(known, ["part", "t"], "left_semi").select("entity_id").distinct()
    return b.where("part <> ''").join(shared, F.col("id") == F.col("entity_id"), "left_anti").agg(F.count("*").alias("n"))


# rescues

_KEYED = f"""raw_w AS (SELECT *, list_sort(list_transform(list_filter(regexp_extract_all(addr_text, '[0-9]+'), lambda x: len(x) <= 7), lambda x: CAST(x AS INTEGER))) AS nk, list_distinct(list_filter(regexp_extract_all(addr_text, '[a-z]+'), lambda t: len(t) > 2)) AS street,
    array_to_string(list_sort(list_filter({_RAW}, lambda t: NOT list_contains({T._list(X._RAW_LEGAL)}, t))), ' ') AS body, list_sort(list_distinct(list_filter({_RAW}, lambda t: list_contains({T._list(X._RAW_LEGAL)}, t)))) AS legal, {_RAW} AS words FROM r)"""
_STREET_JACCARD = "len(list_intersect(a.street, b.street)) / greatest(len(list_distinct(list_concat(a.street, b.street))), 1)"


@query(f"""WITH {T.RECORDS_CTE}, {_ALL}, {_KEYED}, a AS (SELECT * FROM raw_w WHERE entity_id LIKE 'S1%' AND name_core <> '' AND len(nk) > 0), u AS (SELECT country, name_core, nk FROM a GROUP BY ALL HAVING count(*) = 1)
    SELECT a.entity_id AS s1_id, b.entity_id AS m_id FROM raw_w b JOIN u USING (country, name_core, nk) JOIN a USING (country, name_core, nk) WHERE b.entity_id NOT LIKE 'S1%' AND len(b.street) > 0 AND {_STREET_JACCARD} >= 0.5 AND a.body = b.body AND (len(a.legal) = 0 OR len(b.legal) = 0 OR a.legal = b.legal) AND NOT list_has_any(list_filter(b.words, lambda t: NOT list_contains(a.words, t)), ['steel'])""")
def exact_rescue(spark, d):
    """Records that equal exactly one S1 in name and numbers, with like streets, raw words and legal forms."""
    return B.rescue(T.s1(spark, d), T.pool(spark, d), ["steel"])


@query(f"""WITH {T.RECORDS_CTE}, {_ALL}, {_KEYED}, {T.PAIRS_CTE}, own AS (SELECT m_id, max(s1_id) AS from_id FROM pairs WHERE y = 0 GROUP BY 1), a AS (SELECT * FROM raw_w WHERE entity_id LIKE 'S1%'), b AS (SELECT * FROM raw_w WHERE entity_id NOT LIKE 'S1%' AND name_core <> '' AND len(nk) > 0),
    n AS (SELECT b.entity_id AS m_id, a.entity_id AS s1_id, a.body = b.body AND (len(a.legal) = 0 OR len(b.legal) = 0 OR a.legal = b.legal) AS loose, a.body = b.body AND a.legal = b.legal AS strict, b.body AS bb FROM b JOIN a USING (country, name_core, nk) WHERE len(b.street) > 0 AND {_STREET_JACCARD} >= 0.5),
    g AS (SELECT m_id, count(*) AS n, count(CASE WHEN loose THEN 1 END) AS l, count(CASE WHEN strict THEN 1 END) AS s, max(CASE WHEN loose THEN s1_id END) AS one, max(CASE WHEN strict THEN s1_id END) AS alone, max(bb) AS bb FROM n GROUP BY m_id),
    c AS (SELECT m_id, CASE WHEN n = 1 THEN one ELSE alone END AS s1_id, CASE WHEN n = 1 THEN 'unique' ELSE 'group' END AS why, bb FROM g WHERE (n = 1 AND l = 1) OR (n > 1 AND s = 1))
    SELECT m_id, from_id, c.s1_id, why FROM c LEFT JOIN own USING (m_id) LEFT JOIN a ON a.entity_id = from_id WHERE from_id IS NULL OR (from_id <> c.s1_id AND a.body <> bb)""")
def group_rescue(spark, d):
    """The same where several S1 share the key and one alone has the words and legal forms; records that another S1 holds move."""
    owners = T.candidates(spark, d).where("y = 0").groupBy("m_id").agg(F.max("s1_id").alias("s1_id"))
    return B.group_rescue(T.s1(spark, d), T.pool(spark, d), owners)


@query(f"""WITH {T.RECORDS_CTE}, kept AS (SELECT DISTINCT k FROM raw_pool WHERE variant = 0), {_ALL}, {_KEYED}, a AS (SELECT * FROM raw_w WHERE entity_id LIKE 'S1%' AND name_core <> '' AND len(nk) > 0 AND k NOT IN (SELECT k FROM kept)), u AS (SELECT country, name_core, nk FROM a GROUP BY ALL HAVING count(*) = 1)
    SELECT a.entity_id AS s1_id, b.entity_id AS m_id FROM raw_w b JOIN u USING (country, name_core, nk) JOIN a USING (country, name_core, nk) WHERE b.entity_id NOT LIKE 'S1%' AND b.variant <> 0 AND len(b.street) > 0 AND {_STREET_JACCARD} >= 0.5 AND (len(a.legal) = 0 OR len(b.legal) = 0 OR a.legal = b.legal)""")
def empty_s1_rescue(spark, d):
    """For S1 that own nothing: free records equal in name and numbers, whatever their raw words."""
    s1, pool = T.s1(spark, d), T.pool(spark, d)
    held = pool.where("variant = 0").select("k").distinct()
    return B.rescue(s1.join(held, "k", "left_anti"), pool.where("variant <> 0"), [], body=False)


_FLOOR = "SELECT entity_id, replace(business_address, 'California', 'CA, Fl 3') AS business_address, business_name, country, k, variant FROM {0} WHERE country = 'US'"


@query(f"""WITH {T.RAW_CTE}, f1 AS ({_FLOOR.format('raw_s1')}), s1 AS ({T.normalised_sql('f1')}), pool AS ({T.normalised_sql('raw_pool')}), {_ALL.replace('SELECT * FROM s1', "SELECT * FROM s1")}, {_KEYED},
    a AS (SELECT * FROM raw_w WHERE entity_id LIKE 'S1%' AND addr_state = 'fl' AND contains(business_address, ', CA,')), b AS (SELECT * FROM raw_w WHERE entity_id NOT LIKE 'S1%' AND len(nk) > 0 AND name_core <> ''),
    x AS (SELECT a.entity_id AS s1_id, b.entity_id AS m_id, len(list_intersect(string_split(a.name_core, ' '), string_split(b.name_core, ' '))) / len(list_distinct(list_concat(string_split(a.name_core, ' '), string_split(b.name_core, ' ')))) AS j FROM b JOIN a USING (nk) WHERE b.addr_state IN ('ca', 'fl') AND {_STREET_JACCARD} >= 0.5),
    t AS (SELECT m_id, max(j) AS best FROM x WHERE j >= 0.6 GROUP BY 1) SELECT min(s1_id) AS s1_id, m_id FROM x JOIN t USING (m_id) WHERE j = best GROUP BY m_id HAVING count(*) = 1""")
def floor_rescue(spark, d):
    """S1 that were read as Florida because of a floor, with the records of their true state."""
    raw = T.raw_s1(spark, d).where("country = 'US'").withColumn("business_address", F.replace("business_address", F.lit("California"), F.lit("CA, Fl 3")))
    return B.floor_rescue(B.floor_victims(R.normalise(raw), list(places.US_STATES)), T.pool(spark, d))


@query(f"""WITH {T.RECORDS_CTE}, {T.PAIRS_CTE}, w AS (SELECT entity_id, unnest(list_distinct(list_filter(regexp_extract_all(addr_text, '[a-z]+'), lambda t: len(t) > 2))) AS word FROM s1), v AS (SELECT entity_id, unnest(list_distinct(list_filter(regexp_extract_all(addr_text, '[a-z]+'), lambda t: len(t) > 2))) AS word FROM pool), n AS (SELECT count(*) AS n FROM s1),
    i AS (SELECT word, ln(n / count(*)) AS wt FROM w, n GROUP BY word, n), l AS (SELECT s1_id, m_id, word FROM pairs JOIN w ON entity_id = s1_id UNION ALL SELECT s1_id, m_id, word FROM pairs JOIN v ON entity_id = m_id), e AS (SELECT s1_id, m_id, word, count(*) AS c FROM l GROUP BY ALL),
    g AS (SELECT s1_id, m_id, sum(CASE WHEN c = 2 THEN coalesce(wt, ln(n)) ELSE 0 END) AS hit, sum(coalesce(wt, ln(n))) AS tot FROM e LEFT JOIN i USING (word), n GROUP BY ALL) SELECT s1_id, m_id, round(CASE WHEN tot > 0 THEN hit / tot ELSE 0.0 END, 6) AS street FROM pairs LEFT JOIN g USING (s1_id, m_id)""")
def weighted_street(spark, d):
    """How alike the streets of candidate pairs are when common words count little."""
    return rounded(B.weighted_street(T.candidates(spark, d), T.s1(spark, d), T.pool(spark, d)), "street")


_TIES = "nm AS (SELECT country, name_core, count(*) AS n_s1 FROM s1 WHERE name_core <> '' GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40), hd AS (SELECT entity_id AS m_id, country, name_core, n_s1 FROM pool JOIN nm USING (country, name_core) WHERE addr_empty), hn AS (SELECT country, name_core, count(*) AS n_records FROM hd GROUP BY ALL), ti AS (SELECT s1.entity_id AS s1_id, m_id, n_s1, n_records FROM hd JOIN s1 USING (country, name_core) JOIN hn USING (country, name_core))"
_SHORT = "regexp_replace(name_core, '^(\\S+ \\S+).*$', '\\1')"


def _short_names(df):
    """Names cut to two words, so that some are shared."""
    return df.withColumn("name_core", F.regexp_replace("name_core", "^(\\S+ \\S+).*$", "$1"))


_SHORT_CTE = f"{T.RAW_CTE}, s0 AS ({T.normalised_sql('raw_s1')}), p0 AS ({T.normalised_sql('raw_pool')}), s1 AS (SELECT * REPLACE ({_SHORT} AS name_core) FROM s0), pool AS (SELECT * REPLACE ({_SHORT} AS name_core) FROM p0)"


@query(f"WITH {_SHORT_CTE}, {_TIES} SELECT * FROM ti")
def name_ties(spark, d):
    """Records without address and the S1 that share their name."""
    return B.tie_groups(_short_names(T.s1(spark, d)), _short_names(T.pool(spark, d)))


@query(f"WITH {_SHORT_CTE}, {_TIES}, o AS (SELECT DISTINCT 'S1-' || CAST(k AS VARCHAR) AS s1_id FROM raw_pool WHERE variant = 0), g AS (SELECT m_id, count(CASE WHEN o.s1_id IS NULL THEN 1 END) AS e, min(CASE WHEN o.s1_id IS NULL THEN ti.s1_id END) AS s1_id FROM ti LEFT JOIN o USING (s1_id) WHERE n_s1 = 2 GROUP BY m_id) SELECT s1_id, m_id FROM g WHERE e = 1")
def empty_rivals(spark, d):
    """Of two S1 with the name of a record without address, the one that owns nothing."""
    owned = T.raw_pool(spark, d).where("variant = 0").select(F.concat(F.lit("S1-"), F.col("k").cast("string")).alias("s1_id"))
    return B.empty_rival(_short_names(T.s1(spark, d)), _short_names(T.pool(spark, d)), owned)


# learned word table

@query(f"""WITH {T.RECORDS_CTE}, {T.PAIRS_CTE}, q AS (SELECT string_split(b.name_core, ' ') AS x, string_split(a.name_core, ' ') AS y FROM pairs JOIN s1 a ON a.entity_id = s1_id JOIN pool b ON b.entity_id = m_id WHERE y = 1 AND b.variant = 3 OR y = 0 AND b.k = a.k), p AS (SELECT unnest(x) AS word, unnest(y) AS other FROM q WHERE len(x) = len(y)),
    n AS (SELECT word, other, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT word, arg_max(other, (n, other)) AS meaning, max(n) AS n, sum(n) AS tot FROM n GROUP BY word), t AS (SELECT word, meaning FROM g WHERE n >= 2 AND n / tot >= 0.5)
    SELECT entity_id, string_agg(coalesce(meaning, w), ' ' ORDER BY i) AS translated FROM (SELECT entity_id, unnest(string_split(name_core, ' ')) AS w, generate_subscripts(string_split(name_core, ' '), 1) AS i FROM pool) LEFT JOIN t ON word = w GROUP BY entity_id""")
def translated_names(spark, d):
    """Record names word by word in the words of S1 names, by a table learned from pairs."""
    a, b = T.s1(spark, d).select(F.col("entity_id").alias("s1_id"), F.col("k").alias("ka"), F.col("name_core").alias("an")), T.pool(spark, d).select(F.col("entity_id").alias("m_id"), "k", "variant", F.col("name_core").alias("bn"))
    learned = T.candidates(spark, d).join(a, "s1_id").join(b, "m_id").where("(y = 1 AND variant = 3) OR (y = 0 AND k = ka)")
    table = L.translation_table(learned, X.tokens(F.col("bn")), X.tokens(F.col("an")))
    # a table of words, bounded by the vocabulary, joined to the words of the names
    words = b.select("m_id", F.posexplode(X.tokens(F.col("bn"))).alias("at", "word")).join(table.select("word", "meaning"), "word", "left")
    named = words.groupBy("m_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("meaning", "word").alias("w")))), lambda s: s["w"]), " ").alias("translated"))
    return named.select(F.col("m_id").alias("entity_id"), "translated")


@query()
def linkage_pipeline(spark, d):
    """From raw records to match lists: normal forms, states, search paths, features and context, trees in two stages out of fold, one owner, expected-F sets, a list for every S1."""
    return linked(spark, d)


def linked(spark, d):
    from kinweave.operators import pipeline

    s1, pool = T.s1(spark, d), T.pool(spark, d)
    scored = pipeline.scores(s1, pool, truth(spark, d), max_share=_SHARE)
    kept = D.expected_f(D.one_owner(scored), misses=0.05)
    return S.lists_per_entity(s1.select(F.col("entity_id").alias("s1_id")), kept)
