"""Queries of pair features, context, collective evidence and decisions over the candidate pairs of business records."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators import context as C
from kinweave.operators import decide as D
from kinweave.operators import learn as L
from kinweave.operators import pairs as P
from kinweave.plans import records as T
from kinweave.plans.linkage import _CODES, truth
from kinweave.plans.linkage import _TRUTH as TRUTH_CTE
from kinweave.plans.registry import big, query, rounded
from kinweave.plans.sources import HALF

#: Candidate pairs with both records: x (columns a_* and b_* of those that the queries use).
_SIDES = ", ".join(f"{t}.{c} AS {t}_{c}" for t in "ab" for c in ("country", "business_name", "business_address", "name_core", "name_legal", "name_phon", "addr_text", "addr_state", "addr_nums", "addr_empty", "k", "variant"))
DESCRIBED_CTE = f"{T.RECORDS_CTE}, {T.PAIRS_CTE}, x AS (SELECT s1_id, m_id, y, {_SIDES} FROM pairs JOIN s1 a ON a.entity_id = s1_id JOIN pool b ON b.entity_id = m_id)"


def described(spark, d):
    return T.held(spark, d, "described", lambda: P.described(T.candidates(spark, d), T.s1(spark, d), T.pool(spark, d)))


def _list(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


_N = f"n AS (SELECT *, {_list('a_addr_nums')} AS na, {_list('b_addr_nums')} AS nb FROM x), nn AS (SELECT *, len(na) > 0 AND len(nb) > 0 AS s, list_intersect(na, nb) AS i, list_max(list_transform(na, lambda t: CAST(t AS BIGINT))) AS ha, list_max(list_transform(nb, lambda t: CAST(t AS BIGINT))) AS hb FROM n)"


@query(f"""WITH {DESCRIBED_CTE}, {_N} SELECT s1_id, m_id, round(CASE WHEN s THEN len(i) / len(list_distinct(list_concat(na, nb))) ELSE 0.0 END, 9) AS num_jaccard, CAST(s AND len(i) > 0 AS BIGINT) AS num_share, CAST(s AND len(i) = 0 AS BIGINT) AS num_conflict, CAST(NOT s AS BIGINT) AS num_missing,
    CAST(coalesce(list_reverse_sort(list_transform(na, lambda t: (len(t), t)))[1] = list_reverse_sort(list_transform(nb, lambda t: (len(t), t)))[1], false) AS BIGINT) AS num_longest_eq, CASE WHEN s THEN CAST(list_min(flatten(list_transform(na[1:6], lambda p: list_transform(nb[1:6], lambda q: levenshtein(p, q))))) AS BIGINT) ELSE -1 END AS num_min_edit,
    CAST(s AND len(i) = len(na) AND len(i) = len(nb) AS BIGINT) AS agree_eq, CAST(s AND len(i) = len(na) AND len(nb) > len(na) AS BIGINT) AS agree_a_in_b, CAST(s AND len(i) = len(nb) AND len(na) > len(nb) AS BIGINT) AS agree_b_in_a, CASE WHEN s THEN CAST(ha = hb AS BIGINT) ELSE -1 END AS house_eq,
    CASE WHEN s THEN CAST(levenshtein(CAST(ha AS VARCHAR), CAST(hb AS VARCHAR)) AS BIGINT) ELSE -1 END AS house_edit, round(CASE WHEN s THEN ln(1 + abs(ha - hb)) ELSE -1.0 END, 9) AS house_log_gap, CASE WHEN s THEN CAST(ha // 10 = hb // 10 AS BIGINT) ELSE -1 END AS house_same_prefix FROM nn""")
def number_features(spark, d):
    """How the numbers of two addresses agree."""
    a, b = (X.tokens(F.col(c)) for c in ("a_addr_nums", "b_addr_nums"))
    made = P.number_set_features(a, b) | P.number_agreement(a, b)
    whole = ["num_share", "num_conflict", "num_missing", "num_longest_eq", "num_min_edit", "agree_eq", "agree_a_in_b", "agree_b_in_a", "house_eq", "house_edit", "house_same_prefix"]
    return rounded(big(described(spark, d).select("s1_id", "m_id", *[made[c].alias(c) for c in ["num_jaccard", *whole, "house_log_gap"]]), *whole), "num_jaccard", "house_log_gap", digits=9)


# `digit_relation` of functions/kernels.py for two numbers p and q as strings
_DROP = "(abs(len(p) - len(q)) = 1 AND list_contains(list_transform(range(1, greatest(len(p), len(q)) + 1), lambda i: substr(CASE WHEN len(p) > len(q) THEN p ELSE q END, 1, i - 1) || substr(CASE WHEN len(p) > len(q) THEN p ELSE q END, i + 1)), CASE WHEN len(p) > len(q) THEN q ELSE p END))"
_DIFFER = "list_filter(range(1, len(p) + 1), lambda i: substr(p, i, 1) <> substr(q, i, 1))"
_KIND = f"CASE WHEN {_DROP} THEN 0 WHEN len(p) = len(q) AND len({_DIFFER}) = 2 AND list_sort(string_split(p, '')) = list_sort(string_split(q, '')) THEN 1 WHEN len(p) = len(q) AND len({_DIFFER}) = 1 THEN 2 WHEN abs(CAST(p AS BIGINT) - CAST(q AS BIGINT)) <= 10 THEN 3 WHEN abs(CAST(p AS BIGINT) - CAST(q AS BIGINT)) <= 100 THEN 4 ELSE 5 END"


@query(f"""WITH {DESCRIBED_CTE}, {_N}, c AS (SELECT s1_id, m_id, unnest(list_filter(na, lambda t: NOT list_contains(nb, t))) AS p, nb, na FROM nn WHERE s), c2 AS (SELECT s1_id, m_id, p, unnest(list_filter(nb, lambda t: NOT list_contains(na, t))) AS q FROM c),
    k AS (SELECT s1_id, m_id, {_KIND} AS kind, CAST(q AS BIGINT) - CAST(p AS BIGINT) AS g, p, q, CASE WHEN len(p) = len(q) AND len({_DIFFER}) = 1 THEN len(p) - ({_DIFFER})[1] ELSE -1 END AS place, greatest(len(p), len(q)) AS digits FROM c2),
    m AS (SELECT s1_id, m_id, arg_min((kind, abs(g), CASE WHEN kind = 2 THEN place ELSE -1 END, digits), (kind, abs(g), p, q)) AS b, CAST(bool_or(g IN (1, 2, 3, 4, 5, 7, 9, 11, 13, 21)) AS BIGINT) AS shift, arg_min(g, (abs(g), g)) AS gap FROM k GROUP BY ALL)
    SELECT s1_id, m_id, CASE WHEN NOT s THEN 1 WHEN len(i) = len(na) AND len(i) = len(nb) THEN 0 WHEN len(i) = len(na) OR len(i) = len(nb) THEN 2 ELSE CASE b[1] WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN CASE WHEN b[3] = 0 THEN 6 ELSE 3 END WHEN 3 THEN 9 WHEN 4 THEN 7 ELSE 4 END END AS house_code,
    round(CASE WHEN NOT s THEN -1.0 WHEN len(i) = len(na) AND len(i) = len(nb) THEN 0.0 WHEN b IS NULL THEN -1.0 ELSE ln(1 + b[2]) END, 6) AS house_log_gap, coalesce(CAST(b[3] AS BIGINT), -1) AS house_place, coalesce(CAST(b[4] AS BIGINT), 0) AS house_digits, CASE WHEN NOT s THEN -1 ELSE coalesce(shift, 0) END AS direct_shift,
    CASE WHEN gap IS NULL THEN -999 ELSE greatest(least(gap, 100), -100) END AS direct_gap FROM nn LEFT JOIN m USING (s1_id, m_id)""")
def house_relations(spark, d):
    """Relation codes, shifts and differences of house numbers."""
    made = P.house_features()
    whole = ["house_code", "house_place", "house_digits", "direct_shift", "direct_gap"]
    return rounded(big(described(spark, d).select("s1_id", "m_id", *[made[c].alias(c) for c in [*whole, "house_log_gap"]]), *whole), "house_log_gap")


_MULTI = "list_sort(list_transform(list_filter(regexp_extract_all({0}, '[0-9]+'), lambda x: len(x) <= 7), lambda x: CAST(x AS INTEGER)))"
_ACRONYM = "CASE WHEN len(list_filter(string_split({0}, ' '), lambda t: t NOT IN ('and', 'the', 'of', ''))) >= 2 THEN array_to_string(list_transform(list_filter(string_split({0}, ' '), lambda t: t NOT IN ('and', 'the', 'of', '')), lambda t: t[1]), '') ELSE '' END"
_FAMILY = "list_sort(list_distinct(list_filter(list_transform(list_filter(string_split({0}, ' '), lambda t: t <> ''), lambda t: CASE t WHEN 'sasu' THEN 'sas' WHEN 'eurl' THEN 'sarl' WHEN 'pvt' THEN 'ltd' WHEN 'public' THEN '' WHEN 'co' THEN '' ELSE t END), lambda t: t <> '')))"


@query(f"""WITH {DESCRIBED_CTE}, f AS (SELECT *, CASE WHEN a_addr_state = 'ts' THEN 'ap' ELSE a_addr_state END AS sa, CASE WHEN b_addr_state = 'ts' THEN 'ap' ELSE b_addr_state END AS sb, {_FAMILY.format('a_name_legal')} AS fa, {_FAMILY.format('b_name_legal')} AS fb, list_distinct(string_split(a_name_legal, ' ')) AS la, list_distinct(string_split(b_name_legal, ' ')) AS lb, {_MULTI.format('a_addr_text')} AS ma, {_MULTI.format('b_addr_text')} AS mb FROM x)
    SELECT s1_id, m_id, CAST(sa = sb AND sa <> '' AS BIGINT) AS state_eq, CAST(sa <> sb AND sa <> '' AND sb <> '' AS BIGINT) AS state_conflict, CAST(a_name_legal = b_name_legal AND a_name_legal <> '' AS BIGINT) AS legal_eq, CAST(a_name_legal = '' OR b_name_legal = '' AS BIGINT) AS legal_missing, CAST(split_part(a_name_core, ' ', 1) = split_part(b_name_core, ' ', 1) AS BIGINT) AS first_eq,
    len(a_name_core) AS len_a, len(b_name_core) AS len_b, CAST(m_id LIKE 'S3%' AS BIGINT) AS is_s3, CAST(b_addr_empty AS BIGINT) AS addr_empty, CAST(b_addr_state = '' AND NOT b_addr_empty AS BIGINT) AS stateless, CAST(a_name_core <> '' AND b_name_core <> '' AND ({_ACRONYM.format('a_name_core')} = b_name_core OR ({_ACRONYM.format('b_name_core')} = a_name_core AND len(a_name_core) <= 5)) AS BIGINT) AS acronym,
    CAST(len(fa) > 0 AND len(fb) > 0 AND len(list_intersect(fa, fb)) = 0 AS BIGINT) AS family_conflict, round(CASE WHEN len(list_distinct(list_concat(fa, fb))) > 0 THEN len(list_intersect(fa, fb)) / len(list_distinct(list_concat(fa, fb))) ELSE -1.0 END, 9) AS family_jaccard,
    CASE WHEN a_name_legal = '' AND b_name_legal = '' THEN 0 WHEN a_name_legal = b_name_legal THEN 1 WHEN fa = fb THEN 2 WHEN a_name_legal = '' OR b_name_legal = '' THEN 3 WHEN len(list_intersect(la, lb)) IN (len(la), len(lb)) THEN 4 WHEN len(list_intersect(la, lb)) > 0 THEN 5 ELSE 6 END AS legal_relation,
    CASE WHEN len(ma) = 0 OR len(mb) = 0 THEN -1 WHEN len(ma) = 1 AND len(mb) = 1 AND mb[1] - ma[1] IN (1, 2, 3, 4, 5, 7, 9, 11, 13, 21) THEN 1 ELSE 0 END AS shift_ms, CAST(m_id LIKE 'S3%' AS BIGINT) AS profile_s3, CAST(b_addr_empty AS BIGINT) AS profile_no_address, len(b_name_core) AS profile_length FROM f""")
def pair_flags(spark, d):
    """States, legal forms, lengths, acronyms, shifts of multisets and the record's profile."""
    made = P.plain_flags() | P.legal_features() | P.record_profile() | {"shift_ms": P.multiset_shift(F.col("a_addr_text"), F.col("b_addr_text"))}
    whole = ["state_eq", "state_conflict", "legal_eq", "legal_missing", "first_eq", "len_a", "len_b", "is_s3", "addr_empty", "stateless", "acronym", "family_conflict", "legal_relation", "shift_ms", "profile_s3", "profile_no_address", "profile_length"]
    return rounded(big(described(spark, d).select("s1_id", "m_id", *[made[c].alias(c) for c in [*whole, "family_jaccard"]]), *whole), "family_jaccard", digits=9)


@query(f"""WITH {DESCRIBED_CTE}, t AS (SELECT country, name_core, name_legal, array_to_string({_FAMILY.format('name_legal')}, ' ') AS fam FROM s1), u AS (SELECT country, name_core, name_legal, least(count(*), 10) AS uf FROM t GROUP BY ALL), v AS (SELECT country, name_core, fam, least(count(*), 10) AS uv FROM t GROUP BY ALL)
    SELECT s1_id, m_id, coalesce(uf, 0) AS unique_form, coalesce(uv, 0) AS unique_family, CAST(a_name_core = b_name_core AND a_name_legal = b_name_legal AS BIGINT) AS form_eq, CAST(a_name_core = b_name_core AND {_FAMILY.format('a_name_legal')} = {_FAMILY.format('b_name_legal')} AS BIGINT) AS family_eq
    FROM x LEFT JOIN u ON u.country = a_country AND u.name_core = b_name_core AND u.name_legal = b_name_legal LEFT JOIN v ON v.country = a_country AND v.name_core = b_name_core AND v.fam = array_to_string({_FAMILY.format('b_name_legal')}, ' ')""")
def legal_uniqueness(spark, d):
    """How many S1 hold the record's name with its legal forms or their family."""
    return big(P.uniqueness(described(spark, d), T.s1(spark, d)).select("s1_id", "m_id", "unique_form", "unique_family", "form_eq", "family_eq"), "unique_form", "unique_family", "form_eq", "family_eq")


_KEY = f"array_to_string(list_sort(list_filter(list_transform(list_filter(string_split({{0}}, ' '), lambda t: NOT list_contains({T._list(_CODES)}, t)), lambda t: ltrim(t, '0')), lambda t: t <> '')), ' ')"
_ST = "CASE WHEN {0} = 'ts' THEN 'ap' ELSE {0} END"


@query(f"""WITH {DESCRIBED_CTE}, a AS (SELECT *, {_ST.format('addr_state')} AS st, {_KEY.format('addr_text')} AS ky FROM s1), b AS (SELECT *, {_ST.format('addr_state')} AS st, {_KEY.format('addr_text')} AS ky FROM pool), z AS (SELECT *, {_ST.format('a_addr_state')} AS st, {_KEY.format('a_addr_text')} AS ka, {_KEY.format('b_addr_text')} AS kb FROM x),
    f1 AS (SELECT country, st, name_core, count(*) AS n FROM a GROUP BY ALL), f2 AS (SELECT country, name_core, count(*) AS n FROM a GROUP BY ALL), f3 AS (SELECT country, st, name_core, count(*) AS n FROM b GROUP BY ALL), f4 AS (SELECT country, name_phon, count(*) AS n FROM a GROUP BY ALL), f5 AS (SELECT country, ky, count(*) AS n FROM a WHERE addr_text <> '' GROUP BY ALL), f6 AS (SELECT country, ky, count(*) AS n FROM b WHERE addr_text <> '' GROUP BY ALL)
    SELECT s1_id, m_id, coalesce(f1.n, 0) AS freq_s1name_state, coalesce(f2.n, 0) AS freq_s1name, coalesce(g2.n, 0) AS freq_bname_in_s1, coalesce(f3.n, 0) AS freq_s1name_in_pool, coalesce(f4.n, 0) AS freq_bphon_in_s1, least(coalesce(f5.n, 0), 10) AS freq_s1addr, least(coalesce(g5.n, 0), 10) AS freq_baddr_in_s1, round(least(coalesce(f6.n, 0) / greatest(least(coalesce(g5.n, 0), 10), 1), 20.0), 9) AS freq_pool_per_s1
    FROM z LEFT JOIN f1 ON f1.country = a_country AND f1.st = z.st AND f1.name_core = a_name_core LEFT JOIN f2 ON f2.country = a_country AND f2.name_core = a_name_core LEFT JOIN f2 g2 ON g2.country = a_country AND g2.name_core = b_name_core LEFT JOIN f3 ON f3.country = a_country AND f3.st = z.st AND f3.name_core = a_name_core LEFT JOIN f4 ON f4.country = a_country AND f4.name_phon = b_name_phon LEFT JOIN f5 ON f5.country = a_country AND f5.ky = ka LEFT JOIN f5 g5 ON g5.country = a_country AND g5.ky = kb LEFT JOIN f6 ON f6.country = a_country AND f6.ky = kb""")
def name_frequencies(spark, d):
    """How many records hold the names, sounds and addresses of a pair."""
    x = C.name_frequencies(described(spark, d), T.s1(spark, d), T.pool(spark, d), _CODES)
    cols = [c for c in x.columns if c.startswith("freq_")]
    return rounded(big(x.select("s1_id", "m_id", *cols), *[c for c in cols if c != "freq_pool_per_s1"]), "freq_pool_per_s1", digits=9)


_W = f"wd AS (SELECT *, list_distinct({_list('a_name_core')}) AS wa, list_distinct({_list('b_name_core')}) AS wb, list_distinct({_list('a_addr_text')}) AS va, list_distinct({_list('b_addr_text')}) AS vb FROM x)"


@query(f"""WITH {DESCRIBED_CTE}, {_W}, bo AS (SELECT entity_id, country, name_core FROM s1 UNION ALL SELECT entity_id, country, name_core FROM pool), nc AS (SELECT country, count(*) AS n FROM bo GROUP BY 1), i AS (SELECT country, gram, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT entity_id, country, unnest(list_distinct({_list('name_core')})) AS gram FROM bo) JOIN nc USING (country) GROUP BY country, gram),
    l AS (SELECT s1_id, m_id, a_country AS country, unnest(list_distinct(list_concat(wa, wb))) AS gram, wa, wb FROM wd), s AS (SELECT s1_id, m_id, sum(idf) FILTER (list_contains(wa, gram) AND list_contains(wb, gram)) AS hit, sum(idf) AS tot, max(idf) FILTER (list_contains(wa, gram) AND list_contains(wb, gram)) AS mx, count(*) FILTER (list_contains(wa, gram) AND list_contains(wb, gram)) AS n FROM l JOIN i USING (country, gram) GROUP BY ALL)
    SELECT s1_id, m_id, round(coalesce(hit / tot, 0.0), 9) AS idf_jaccard, round(coalesce(mx, 0.0), 9) AS max_shared, coalesce(n, 0) AS n_shared FROM pairs LEFT JOIN s USING (s1_id, m_id)""")
def idf_overlap(spark, d):
    """Weighted overlap of the words of two names."""
    return rounded(P.idf_overlap(described(spark, d), P.country_idf(T.s1(spark, d), T.pool(spark, d), "name_core"), "a_name_core", "b_name_core"), "idf_jaccard", "max_shared", digits=9)


_IDF = f"idf AS (SELECT gram, ln(((SELECT count(*) FROM s1) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT DISTINCT entity_id, unnest({_list('{0}')}) AS gram FROM s1) GROUP BY gram)"


@query(f"""WITH {DESCRIBED_CTE}, {_W}, {_IDF.format('addr_text')}, av AS (SELECT avg(len({_list('addr_text')})) AS avgdl FROM pool), l AS (SELECT s1_id, m_id, unnest(va) AS gram, {_list('b_addr_text')} AS ws FROM wd), s AS (SELECT s1_id, m_id, sum(CASE WHEN len(list_filter(ws, lambda t: t = gram)) > 0 THEN coalesce(idf, 10.0) * len(list_filter(ws, lambda t: t = gram)) * 2.2 / (len(list_filter(ws, lambda t: t = gram)) + 1.2 * (0.25 + 0.75 * len(ws) / avgdl)) ELSE 0 END) AS b, sum(coalesce(idf, 10.0)) AS own FROM l LEFT JOIN idf USING (gram), av GROUP BY ALL)
    SELECT s1_id, m_id, round(coalesce(b, 0.0), 6) AS bm25, round(coalesce(b / greatest(own, 1e-6), 0.0), 6) AS bm25_norm FROM pairs LEFT JOIN s USING (s1_id, m_id)""")
def address_bm25(spark, d):
    """BM25 of the record's address for the words of the S1's."""
    s1, pool = T.s1(spark, d), T.pool(spark, d)
    idf = P.token_idf(s1, "entity_id", X.tokens(F.col("addr_text"))).withColumnRenamed("idf", "bidf")
    average = pool.agg(F.avg(F.size(X.tokens(F.col("addr_text")))).alias("avgdl"))
    return rounded(P.bm25_pairs(described(spark, d), idf, average, "a_addr_text", "b_addr_text"), "bm25", "bm25_norm")


@query(f"""WITH {DESCRIBED_CTE}, {_W}, {_IDF.format('name_core')}, p AS (SELECT s1_id, m_id, unnest(wa) AS gram FROM wd), q AS (SELECT s1_id, m_id, unnest(wb) AS gram FROM wd), pa AS (SELECT s1_id, m_id, gram AS ga, least(coalesce(idf, 10.0), 10.0) AS ia FROM p LEFT JOIN idf USING (gram)), pb AS (SELECT s1_id, m_id, gram AS gb, least(coalesce(idf, 10.0), 10.0) AS ib FROM q LEFT JOIN idf USING (gram)),
    ua AS (SELECT *, ia / sqrt(sum(ia * ia) OVER (PARTITION BY s1_id, m_id)) AS wa FROM pa), ub AS (SELECT *, ib / sqrt(sum(ib * ib) OVER (PARTITION BY s1_id, m_id)) AS wb FROM pb), c AS (SELECT *, jaro_winkler_similarity(ga, gb) AS sim FROM ua JOIN ub USING (s1_id, m_id)),
    ta AS (SELECT s1_id, m_id, ga, any_value(wa) AS w, any_value(ia) AS i, max((sim, gb, wb)) AS t FROM c GROUP BY s1_id, m_id, ga), tb AS (SELECT s1_id, m_id, gb, any_value(wb) AS w, any_value(ib) AS i, max((sim, ga, wa)) AS t FROM c GROUP BY s1_id, m_id, gb),
    sa AS (SELECT s1_id, m_id, sum(CASE WHEN t[1] >= 0.9 THEN w * t[3] * t[1] ELSE 0 END) AS soft, avg(t[1]) AS me, avg(CAST(t[1] >= 0.9 AS DOUBLE)) AS co, max(CASE WHEN t[1] >= 0.9 THEN i ELSE 0 END) AS ra, sum(CASE WHEN t[1] >= 0.9 THEN i ELSE 0 END) / sum(i) AS cv, count(*) AS n FROM ta GROUP BY ALL),
    sb AS (SELECT s1_id, m_id, sum(CASE WHEN t[1] >= 0.9 THEN w * t[3] * t[1] ELSE 0 END) AS soft, avg(t[1]) AS me, avg(CAST(t[1] >= 0.9 AS DOUBLE)) AS co, max(CASE WHEN t[1] >= 0.9 THEN i ELSE 0 END) AS ra, sum(CASE WHEN t[1] >= 0.9 THEN i ELSE 0 END) / sum(i) AS cv, max(CASE WHEN t[1] < 0.9 THEN i ELSE 0 END) AS ex, count(*) AS n FROM tb GROUP BY ALL), e AS (SELECT s1_id, m_id, sum(wa * wb) AS tc FROM c WHERE ga = gb GROUP BY ALL)
    SELECT s1_id, m_id, round(coalesce(sa.soft, 0), 6) AS soft_ab, round(coalesce(sb.soft, 0), 6) AS soft_ba, round((coalesce(sa.soft, 0) + coalesce(sb.soft, 0)) / 2, 6) AS soft, round(coalesce(sa.me, -1), 6) AS monge_ab, round(coalesce(sb.me, -1), 6) AS monge_ba, round(coalesce(CASE WHEN coalesce(sa.n, 0) <= coalesce(sb.n, 0) THEN sa.co ELSE sb.co END, -1), 6) AS cont_s2l, round(greatest(coalesce(sa.ra, 0), coalesce(sb.ra, 0)), 6) AS rare,
    round(coalesce(sa.cv, -1), 6) AS cover_ab, round(coalesce(sb.cv, -1), 6) AS cover_ba, round(coalesce(ex, 0), 6) AS extra_b, round(coalesce(tc, 0), 6) AS tokcos FROM pairs LEFT JOIN sa USING (s1_id, m_id) LEFT JOIN sb USING (s1_id, m_id) LEFT JOIN e USING (s1_id, m_id)""")
def soft_token_features(spark, d):
    """Soft TF-IDF, Monge-Elkan, containment, rare and added words of two names."""
    s1 = T.s1(spark, d)
    found = P.token_features(described(spark, d), P.token_idf(s1, "entity_id", X.tokens(F.col("name_core"))), "a_name_core", "b_name_core")
    return rounded(found, *[c for c in found.columns if c not in ("s1_id", "m_id")])


_GRAMS = "list_distinct(list_transform(range(1, len({0}) + 1), lambda i: substr(' ' || {0} || ' ', i, 3)))"


@query(f"""WITH {DESCRIBED_CTE}, g AS (SELECT *, {_GRAMS.format('a_name_core')} AS ga, {_GRAMS.format('b_name_core')} AS gb FROM x), i AS (SELECT gram, ln(((SELECT count(*) FROM s1) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest({_GRAMS.format('name_core')}) AS gram FROM s1) GROUP BY gram), l AS (SELECT s1_id, m_id, unnest(list_distinct(list_concat(ga, gb))) AS gram, ga, gb FROM g),
    s AS (SELECT s1_id, m_id, sum(CASE WHEN list_contains(ga, gram) AND list_contains(gb, gram) THEN idf * idf ELSE 0 END) AS ab, sum(CASE WHEN list_contains(ga, gram) THEN idf * idf ELSE 0 END) AS aa, sum(CASE WHEN list_contains(gb, gram) THEN idf * idf ELSE 0 END) AS bb FROM l JOIN i USING (gram) GROUP BY ALL) SELECT s1_id, m_id, round(coalesce(ab / sqrt(aa * bb), 0.0), 6) AS cos FROM pairs LEFT JOIN s USING (s1_id, m_id)""")
def name_gram_cosine(spark, d):
    """Cosine of the character 3-grams of two names."""
    s1 = T.s1(spark, d)
    idf = P.token_idf(s1, "entity_id", X.char_grams(F.concat(F.lit(" "), F.col("name_core"), F.lit(" "))))
    return rounded(P.gram_cosine(described(spark, d), idf, "a_name_core", "b_name_core"), "cos")


@query(f"""WITH {DESCRIBED_CTE}, {_W}, df AS (SELECT gram, count(*) AS df FROM (SELECT DISTINCT entity_id, unnest({_list('name_core')}) AS gram FROM s1) GROUP BY gram), n AS (SELECT count(*) AS n FROM s1), l AS (SELECT s1_id, m_id, unnest(list_distinct(list_concat(wa, wb))) AS gram, wa, wb FROM wd WHERE len(wa) > 0 AND len(wb) > 0), t AS (SELECT l.*, coalesce(df, 0) AS df, ln(n / (1 + coalesce(df, 0))) AS w, list_contains(wa, gram) AS ia, list_contains(wb, gram) AS ib FROM l LEFT JOIN df USING (gram), n),
    r AS (SELECT s1_id, m_id, min((df, gram)) FILTER (ia) AS rk, any_value(wb) AS wb, sum(CASE WHEN ia AND ib THEN w ELSE 0 END) / greatest(sum(CASE WHEN ia THEN w ELSE 0 END), 1e-9) AS ca, sum(CASE WHEN ia AND ib THEN w ELSE 0 END) / greatest(sum(CASE WHEN ib THEN w ELSE 0 END), 1e-9) AS cb, coalesce(max(w) FILTER (NOT ia), 0.0) AS ex FROM t GROUP BY ALL), c AS (SELECT country, name_core, count(*) AS k FROM s1 GROUP BY ALL)
    SELECT x.s1_id, x.m_id, coalesce(CASE WHEN list_contains(r.wb, rk[2]) THEN 1.0 WHEN len(rk[2]) >= 4 AND list_min(list_transform(r.wb, lambda u: levenshtein(u, rk[2]))) <= 2 THEN 0.5 WHEN rk IS NULL THEN -1.0 ELSE 0.0 END, -1.0) AS rare_in, round(coalesce(ln(n / (1 + rk[1])), -1.0), 6) AS rare_w, round(coalesce(ca, -1.0), 6) AS cover_a, round(coalesce(cb, -1.0), 6) AS cover_b, round(coalesce(ex, -1.0), 6) AS extra, coalesce(c1.k, 0) AS names_a, coalesce(c2.k, 0) AS names_b
    FROM n, x LEFT JOIN r USING (s1_id, m_id) LEFT JOIN c c1 ON c1.country = a_country AND c1.name_core = a_name_core LEFT JOIN c c2 ON c2.country = a_country AND c2.name_core = b_name_core""")
def distinctive_words(spark, d):
    """Whether the record holds the rarest word of the S1's name, and how much the names cover of each other."""
    return rounded(P.distinctive_word(described(spark, d), T.s1(spark, d)), "rare_w", "cover_a", "cover_b", "extra")


@query(f"""WITH {DESCRIBED_CTE}, t AS (SELECT country, addr_text, count(*) AS n FROM s1 WHERE addr_text <> '' GROUP BY ALL) SELECT s1_id, m_id, coalesce(p.n, 0) AS s1_at_a, coalesce(q.n, 0) AS s1_at_b, -1 AS key_count FROM x LEFT JOIN t p ON p.country = a_country AND p.addr_text = a_addr_text LEFT JOIN t q ON q.country = a_country AND q.addr_text = b_addr_text""")
def colocation(spark, d):
    """How many S1 share the addresses of a pair; no address here has a key number."""
    return big(P.colocation(described(spark, d), T.s1(spark, d)).select("s1_id", "m_id", "s1_at_a", "s1_at_b", "key_count"), "key_count")


_CITY = "CASE WHEN {0} <> '' THEN [lower(trim(split_part({0}, ',', 2)))] ELSE [] END"


@query(f"""WITH {DESCRIBED_CTE}, l AS (SELECT s1_id, m_id, y, {_CITY.format('a_business_address')} AS la, {_CITY.format('b_business_address')} AS lb FROM x), t AS (SELECT la[1] AS loc_a, lb[1] AS loc_b FROM l WHERE y = 1 AND len(la) > 0 AND len(lb) > 0), n AS (SELECT loc_a, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 3), al AS (SELECT loc_a, loc_b, count(*) / any_value(n) AS share FROM t JOIN n USING (loc_a) GROUP BY ALL)
    SELECT s1_id, m_id, CAST(len(la) > 0 AND len(lb) > 0 AND la = lb AS BIGINT) AS loc_exact, round(coalesce(share, 0.0), 9) AS loc_alias, CAST(len(la) > 0 AND len(lb) > 0 AND la <> lb AS BIGINT) AS loc_conflict, CAST(len(la) > 0 AND len(lb) > 0 AS BIGINT) AS loc_has FROM l LEFT JOIN al ON loc_a = la[1] AND loc_b = lb[1]""")
def locality(spark, d):
    """Whether the places of two addresses agree, or are usual counterparts of each other in true pairs."""
    place = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.lower(F.trim(F.split_part(c, F.lit(","), F.lit(2)))))).otherwise(F.array().cast("array<string>"))
    x = described(spark, d).select("s1_id", "m_id", "y", place(F.col("a_business_address")).alias("loc_a"), place(F.col("b_business_address")).alias("loc_b"))
    known = x.where("y = 1").select(F.explode("loc_a").alias("loc_a"), "loc_b").select("loc_a", F.explode("loc_b").alias("loc_b"))
    return rounded(big(P.locality_features(x, P.conditional_alias(known, "loc_a", "loc_b")), "loc_exact", "loc_conflict", "loc_has"), "loc_alias", digits=9)


_RAWW = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_U = T._list(P.USUAL_EXTRA)


@query(f"""WITH {DESCRIBED_CTE}, s AS (SELECT *, {_RAWW.format('a_business_name')} AS ta, {_RAWW.format('b_business_name')} AS tb, regexp_replace(b_business_name, '[^\\p{{L}}]', '', 'g') AS let FROM x), e AS (SELECT *, list_filter(tb, lambda t: NOT list_contains(ta, t)) AS ex, list_filter(ta, lambda t: NOT list_contains(tb, t)) AS lo FROM s)
    SELECT s1_id, m_id, CAST(a_business_name = b_business_name AS BIGINT) AS raw_eq, CAST(lower(a_business_name) = lower(b_business_name) AS BIGINT) AS case_eq, CAST(ta = tb AS BIGINT) AS words_eq, CAST(len(ta) > 0 AND list_sort(list_distinct(ta)) = list_sort(list_distinct(tb)) AND ta <> tb AS BIGINT) AS set_eq, len(list_filter(ex, lambda t: list_contains({_U}, t))) AS extra_usual, len(list_filter(ex, lambda t: NOT list_contains({_U}, t))) AS extra_other,
    len(list_filter(lo, lambda t: list_contains({_U}, t))) AS lost_usual, len(list_filter(lo, lambda t: NOT list_contains({_U}, t))) AS lost_other, len(list_filter(ex, lambda t: len(t) >= 3 AND NOT list_contains({_U}, t) AND coalesce(list_min(list_transform(lo, lambda u: levenshtein(t, u))) <= 2, false))) AS typos, CASE WHEN let = '' THEN 0 WHEN let = upper(let) THEN 1 WHEN let = lower(let) THEN 2 ELSE 0 END AS "case",
    CAST(regexp_matches(b_business_name, '[A-Za-z][0-9][A-Za-z]|[A-Za-z]''?[0-9]\\b|\\b[0-9][A-Za-z]{{2,}}') AND NOT regexp_matches(a_business_name, '[A-Za-z][0-9][A-Za-z]|[A-Za-z]''?[0-9]\\b|\\b[0-9][A-Za-z]{{2,}}') AS BIGINT) AS leet, CAST(len(tb) <> len(list_distinct(tb)) AND len(ta) = len(list_distinct(ta)) AS BIGINT) AS repeats FROM e""")
def name_edit_signature(spark, d):
    """What kinds of edit separate the raw names of a pair."""
    made = P.edit_signature(F.col("a_business_name"), F.col("b_business_name"))
    cols = ["raw_eq", "case_eq", "words_eq", "set_eq", "extra_usual", "extra_other", "lost_usual", "lost_other", "typos", "case", "leet", "repeats"]
    return big(described(spark, d).select("s1_id", "m_id", *[made[c].alias(c) for c in cols]), *cols)


@query()
def pair_similarities(spark, d):
    """All similarities of names, sounds and addresses that need kernels in Python."""
    made = P.text_similarities()
    return rounded(described(spark, d).select("s1_id", "m_id", *[c.alias(n) for n, c in made.items()]), *[n for n in made if n != "n_alts"])


# context

_SYN = f"sy AS (SELECT *, {_jaccard('wa', 'wb')} AS cos_name, {_jaccard('va', 'vb')} AS cos_addr, CAST(a_addr_nums = b_addr_nums AS BIGINT) AS shares FROM wd), sz AS (SELECT *, 0.6 * cos_name + 0.4 * cos_addr AS cos_comb FROM sy)"


def with_scores(spark, d):
    """Described pairs with plain similarities in the place of cosines: overlaps of words."""
    names, addrs = (X.jaccard(F.array_distinct(X.tokens(F.col(f"a_{c}"))), F.array_distinct(X.tokens(F.col(f"b_{c}")))) for c in ("name_core", "addr_text"))
    x = described(spark, d).withColumns({"cos_name": names, "cos_addr": addrs, "shares": (F.col("a_addr_nums") == F.col("b_addr_nums")).cast("int")})
    return x.withColumns({"cos_comb": 0.6 * F.col("cos_name") + 0.4 * F.col("cos_addr"), "set_ratio": 100 * F.col("cos_name")})


@query(f"""WITH {DESCRIBED_CTE}, {_W}, {_SYN}, h AS (SELECT *, CASE WHEN cos_name * 100 >= 90 THEN cos_addr END AS held FROM sz) SELECT s1_id, m_id, dense_rank() OVER (PARTITION BY m_id ORDER BY cos_comb DESC) AS m_rank, round(max(cos_comb) OVER (PARTITION BY m_id) - cos_comb, 9) AS m_gap, count(*) OVER (PARTITION BY m_id) AS m_n,
    dense_rank() OVER (PARTITION BY s1_id ORDER BY cos_comb DESC) AS s1_rank_comb, dense_rank() OVER (PARTITION BY s1_id ORDER BY cos_name DESC) AS s1_rank_name, dense_rank() OVER (PARTITION BY s1_id ORDER BY cos_addr DESC) AS s1_rank_addr, round(max(cos_comb) OVER (PARTITION BY s1_id) - cos_comb, 9) AS s1_gap, count(*) OVER (PARTITION BY s1_id) AS s1_n, count(CASE WHEN cos_comb > 0.6 THEN 1 END) OVER (PARTITION BY s1_id) AS s1_strong,
    count(held) OVER (PARTITION BY s1_id) AS s1_same_name, count(CASE WHEN held IS NOT NULL AND shares > 0 THEN 1 END) OVER (PARTITION BY s1_id) AS s1_same_name_number, CASE WHEN held IS NOT NULL THEN dense_rank() OVER (PARTITION BY s1_id ORDER BY held DESC NULLS LAST) ELSE 99 END AS s1_same_rank, round(coalesce(max(held) OVER (PARTITION BY s1_id) - cos_addr, 1.0), 9) AS s1_same_gap FROM h""")
def pair_context(spark, d):
    """Where a pair stands among the pairs of its record and of its S1, and among those of the same name."""
    x = C.s1_side(C.record_side(with_scores(spark, d)), "set_ratio", "shares")
    ranks = ["m_rank", "s1_rank_comb", "s1_rank_name", "s1_rank_addr", "s1_same_rank"]
    return rounded(big(x.select("s1_id", "m_id", "m_gap", "m_n", "s1_gap", "s1_n", "s1_strong", "s1_same_name", "s1_same_name_number", "s1_same_gap", *ranks), *ranks), "m_gap", "s1_gap", "s1_same_gap", digits=9)


#: The pairs of records as scores: the overlap of words moved into (0, 1).
_SCORED = f"{DESCRIBED_CTE}, {_W}, {_SYN}, sp AS (SELECT s1_id, m_id, y, a_country AS country, a_name_core, b_name_core, a_addr_text, b_addr_text, b_addr_nums, a_addr_nums, round(0.02 + 0.96 * cos_comb, 6) AS p FROM sz)"


def scored(spark, d):
    return with_scores(spark, d).withColumn("p", F.round(0.02 + 0.96 * F.col("cos_comb"), 6)).withColumn("country", F.col("a_country"))


@query(f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC) AS i, row_number() OVER (PARTITION BY m_id ORDER BY p DESC) AS j FROM sp), z AS (SELECT *, max(p) OVER s AS s1_best, coalesce(max(CASE WHEN i = 2 THEN p END) OVER s, 0.0) AS s1_second, max(p) OVER m AS m_best, coalesce(max(CASE WHEN j = 2 THEN p END) OVER m, 0.0) AS m_second, count(*) OVER s AS s1_n, count(CASE WHEN p >= 0.9 THEN 1 END) OVER s AS s1_n90, count(CASE WHEN p >= 0.5 THEN 1 END) OVER s AS s1_n50, count(CASE WHEN p >= 0.1 THEN 1 END) OVER s AS s1_n_kept, count(*) OVER m AS m_n FROM r WINDOW s AS (PARTITION BY s1_id), m AS (PARTITION BY m_id))
    SELECT s1_id, m_id, s1_n, s1_n90, s1_n50, s1_n_kept, m_n, round(s1_best, 6) AS s1_best, round(s1_second, 6) AS s1_second, round(p - CASE WHEN p >= s1_best THEN s1_second ELSE s1_best END, 6) AS s1_margin, round(p - CASE WHEN p >= m_best THEN m_second ELSE m_best END, 6) AS m_margin, rank() OVER (PARTITION BY s1_id ORDER BY p DESC) AS s1_rank, rank() OVER (PARTITION BY m_id ORDER BY p DESC) AS m_rank FROM z WHERE p >= 0.1""")
def competition(spark, d):
    """Ranks, counts and margins of a scored pair among the pairs of both ends."""
    x = C.competition(scored(spark, d).select("s1_id", "m_id", "p"), least=0.1)
    return rounded(big(x.select("s1_id", "m_id", "s1_n", "s1_n90", "s1_n50", "s1_n_kept", "m_n", "s1_best", "s1_second", "s1_margin", "m_margin", "s1_rank", "m_rank"), "s1_rank", "m_rank"), "s1_best", "s1_second", "s1_margin", "m_margin")


_ORD = "row_number() OVER (PARTITION BY m_id ORDER BY {0} DESC, s1_id) AS {0}_rank"


@query(f"""WITH {_SCORED}, q AS (SELECT s1_id, m_id, p, round(1 - p, 6) AS c FROM sp), r AS (SELECT *, count(*) OVER (PARTITION BY m_id) AS candidates, {_ORD.format('p')}, {_ORD.format('c')} FROM q) SELECT s1_id, m_id, candidates, p_rank, c_rank, """ + ", ".join(f"round(coalesce(CASE WHEN {c}_rank = 1 THEN max(CASE WHEN {c}_rank = 2 THEN {c} END) OVER w ELSE max({c}) OVER w END, 0.0), 6) AS {c}_other, round({c} - coalesce(CASE WHEN {c}_rank = 1 THEN max(CASE WHEN {c}_rank = 2 THEN {c} END) OVER w ELSE max({c}) OVER w END, 0.0), 6) AS {c}_margin" for c in "pc") + " FROM r WINDOW w AS (PARTITION BY m_id)")
def ordinal_competition(spark, d):
    """A pair's place among its record's pairs by two scores."""
    x = C.ordinal_competition(scored(spark, d).select("s1_id", "m_id", "p", F.round(1 - F.col("p"), 6).alias("c")), ["p", "c"]).drop("p", "c")
    return rounded(big(x, "p_rank", "c_rank"), "p_other", "p_margin", "c_other", "c_margin")


# collective evidence

_WJ = "100.0 * (CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END)"


@query(f"""WITH {_SCORED}, e AS (SELECT s1_id, m_id, p, list_distinct({_list('b_name_core')}) AS nw, list_distinct({_list('b_addr_text')}) AS aw, b_addr_text AS ad, list_max(list_transform({_list('b_addr_nums')}, lambda t: CAST(t AS BIGINT))) AS h, substr(m_id, 1, 2) AS src FROM sp),
    j AS (SELECT a.s1_id, a.m_id, b.p, {_WJ.format('a.nw', 'b.nw')} / 100 AS ns, CASE WHEN a.ad <> '' AND b.ad <> '' THEN {_WJ.format('a.aw', 'b.aw')} / 100 END AS sa, a.src = b.src AS same, a.h IS NOT NULL AND b.h IS NOT NULL AND a.h <> b.h AS hd FROM e a JOIN e b ON a.s1_id = b.s1_id AND a.m_id <> b.m_id AND b.p >= 0.5), k AS (SELECT *, coalesce((ns + sa) / 2, ns) AS k FROM j),
    g AS (SELECT s1_id, m_id, count(*) AS n, sum(k * p) / (count(*) + 1) AS support, max(k) AS kmax, avg(k) AS kmean, max(ns) AS name, max(sa) AS addr, max(least(ns, coalesce(sa, ns))) AS both_, count(CASE WHEN ns >= 0.9 AND hd THEN 1 END) AS contra, count(CASE WHEN same THEN 1 END) AS same_src, count(CASE WHEN NOT same THEN 1 END) AS other_src FROM k GROUP BY ALL),
    co AS (SELECT a.s1_id, avg(CASE WHEN a.ad = '' OR b.ad = '' THEN {_WJ.format('a.nw', 'b.nw')} / 100 ELSE ({_WJ.format('a.nw', 'b.nw')} + {_WJ.format('a.aw', 'b.aw')}) / 200 END) AS coherence FROM e a JOIN e b ON a.s1_id = b.s1_id AND a.m_id < b.m_id AND a.p >= 0.5 AND b.p >= 0.5 GROUP BY 1)
    SELECT e.s1_id, e.m_id, coalesce(n, 0) AS n, round(coalesce(support, 0.0), 6) AS support, round(coalesce(kmax, -1.0), 6) AS kmax, round(coalesce(kmean, -1.0), 6) AS kmean, round(coalesce(name, -1.0), 6) AS name, round(coalesce(addr, -1.0), 6) AS addr, round(coalesce(both_, -1.0), 6) AS both, coalesce(contra, 0) AS contra, coalesce(same_src, 0) AS same_src, coalesce(other_src, 0) AS other_src, round(coalesce(coherence, -1.0), 6) AS coherence FROM e LEFT JOIN g USING (s1_id, m_id) LEFT JOIN co USING (s1_id)""")
def peer_features(spark, d):
    """What the other sure records of an S1 say of a record."""
    x = scored(spark, d).select("s1_id", "m_id", "p", F.col("b_name_core").alias("name"), F.col("b_addr_text").alias("addr"), F.array_max(F.transform(X.tokens(F.col("b_addr_nums")), lambda n: n.cast("bigint"))).alias("house"))
    like = lambda a, b: 100 * X.jaccard(F.array_distinct(X.tokens(F.col(a))), F.array_distinct(X.tokens(F.col(b))))
    return rounded(C.peer_features(x, like, tau=0.5), "support", "kmax", "kmean", "name", "addr", "both", "coherence")


@query(f"""WITH {DESCRIBED_CTE}, {_W}, e AS (SELECT s1_id, m_id, wb, list_filter(wb, lambda t: NOT list_contains(wa, t)) AS na, list_filter(regexp_extract_all(b_addr_text, '[a-z]+'), lambda t: len(t) > 2) AS sb, list_filter(list_filter(regexp_extract_all(b_addr_text, '[a-z]+'), lambda t: len(t) > 2), lambda t: NOT list_contains(regexp_extract_all(a_addr_text, '[a-z]+'), t)) AS sn FROM wd)
    SELECT s1_id, m_id, len(na) AS n_add, list_contains(na, 'motors') OR list_contains(na, 'steel') AS decoy_word, len(na) > 0 AND EXISTS (SELECT 1 FROM e o WHERE o.s1_id = e.s1_id AND o.m_id <> e.m_id AND list_has_all(o.wb, e.na)) AS name_corr, len(sn) > 0 AND EXISTS (SELECT 1 FROM e o WHERE o.s1_id = e.s1_id AND o.m_id <> e.m_id AND list_has_all(o.sb, e.sn)) AS street_corr FROM e""")
def word_support(spark, d):
    """Whether another record of the S1 holds the words that a record adds."""
    x = described(spark, d)
    held = x.select("s1_id", "m_id", F.array_distinct(X.tokens(F.col("a_name_core"))).alias("s1_words"), F.array_distinct(X.tokens(F.col("b_name_core"))).alias("name_words"), X.street_words(F.col("a_addr_text")).alias("s1_street"), X.street_words(F.col("b_addr_text")).alias("street"))
    return big(C.word_support(held, ["motors", "steel"]), "n_add")


@query(f"WITH {_SCORED} SELECT s1_id, m_id, p, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS lp, CASE WHEN p >= 0.5 THEN round(p * 0.5, 6) ELSE -1.0 END AS cn, CAST(p >= 0.5 AS DOUBLE) AS cn_scored, CASE WHEN y = 1 THEN 0.25 END AS extra FROM sp")
def stacking_design(spark, d):
    """The table that a model over scores learns from."""
    x = scored(spark, d).select("s1_id", "m_id", "y", "p")
    return rounded(C.stacking_design(x.drop("y"), x.where("p >= 0.5").withColumn("p", F.round(F.col("p") * 0.5, 6)), {"extra": x.where("y = 1").withColumn("p", F.lit(0.25))}), "lp")


@query(f"WITH {_SCORED}, q AS (SELECT s1_id, m_id, p, CAST(len(b_name_core) AS DOUBLE) AS size FROM sp) SELECT s1_id, m_id, 'p' AS feature, p FROM q UNION ALL SELECT s1_id, m_id, 'size', size FROM q")
def split_features(spark, d):
    """A wide table of features as one row for each pair and feature."""
    return C.split_wide(scored(spark, d).select("s1_id", "m_id", "p", F.length("b_name_core").alias("size")), ["p", "size"])


@query(f"WITH {_SCORED} SELECT s1_id, m_id, CASE WHEN y = 1 THEN round(1 - p, 6) WHEN p >= 0.5 THEN p ELSE round(1 - p, 6) END AS p FROM sp")
def covered_or_old(spark, d):
    """A new score where it is covered, the old one elsewhere, the new one where there is no old one."""
    x = scored(spark, d).select("s1_id", "m_id", "y", "p")
    return C.fall_back(x.select("s1_id", "m_id", F.round(1 - F.col("p"), 6).alias("p")), x.where("p >= 0.5").drop("y"), x.where("y = 1"))


# decisions

@query(f"""WITH {_SCORED}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM sp) WHERE r = 1), m AS (SELECT entity_id AS s1_id, CASE WHEN k % 4 = 0 THEN 0.2 ELSE 0.9 END AS pm FROM s1 WHERE k % 5 <> 0), c AS (SELECT s1_id, m_id, p, coalesce(pm, 0.5) AS pm, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM o LEFT JOIN m USING (s1_id)),
    q AS (SELECT *, least(c / least(greatest(1 - exp(sum(ln(1 - c)) OVER (PARTITION BY s1_id)), 1e-6), 1.0), 1.0) AS q FROM c), f AS (SELECT *, row_number() OVER w AS k, pm * 1.25 * sum(q) OVER (w ROWS UNBOUNDED PRECEDING) / (row_number() OVER w + 0.25 * (sum(q) OVER (PARTITION BY s1_id) + 0.05)) AS f FROM q WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, m_id)), b AS (SELECT *, max(f) OVER (PARTITION BY s1_id) AS best FROM f), s AS (SELECT *, min(CASE WHEN f = best THEN k END) OVER (PARTITION BY s1_id) AS stop FROM b) SELECT s1_id, m_id, p FROM s WHERE best > 1 - pm AND k <= stop""")
def expected_f_entity(spark, d):
    """Expected-F sets with the chance that an S1 has a match from a model of its own."""
    m = T.raw_s1(spark, d).where("k % 5 <> 0").select(F.col("entity_id").alias("s1_id"), F.when(F.col("k") % 4 == 0, 0.2).otherwise(0.9).alias("p_match"))
    return D.expected_f_entity(D.one_owner(scored(spark, d).select("s1_id", "m_id", "p")), m)


@query(f"WITH {_SCORED}, g AS (SELECT s1_id, m_id, p, country AS grp, CASE WHEN y = 1 THEN 'corr' ELSE 'lone' END AS sup FROM sp) SELECT s1_id, m_id, p FROM g WHERE p >= CASE WHEN grp = 'US' AND sup = 'corr' THEN 0.3 WHEN grp = 'US' THEN 1.01 WHEN grp = 'India' THEN 0.6 ELSE 0.75 END")
def group_thresholds(spark, d):
    """Thresholds by group, and by group and support; above 1 nothing stays."""
    x = scored(spark, d).select("s1_id", "m_id", "p", F.col("country").alias("grp"), F.when(F.col("y") == 1, "corr").otherwise("lone").alias("sup"))
    return x.where(F.col("p") >= D.group_thresholds(x, {"US|corr": 0.3, "US": 1.01, "India": 0.6}, 0.75)).select("s1_id", "m_id", "p")


@query(f"""WITH {_SCORED}, {TRUTH_CTE}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM sp) WHERE r = 1), g AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS threshold), nt AS (SELECT s1_id, count(*) AS nt FROM truth GROUP BY 1), np AS (SELECT threshold, s1_id, count(*) AS np, count(t.m_id) AS hits FROM g JOIN o ON p >= threshold LEFT JOIN truth t USING (s1_id, m_id) GROUP BY ALL),
    f AS (SELECT g.threshold, {HALF.format('entity_id')} AS half, CASE WHEN coalesce(np, 0) = 0 AND coalesce(nt, 0) = 0 THEN 1.0 WHEN coalesce(hits, 0) = 0 THEN 0.0 ELSE 1.25 * hits / (np + 0.25 * nt) END AS f FROM s1, g LEFT JOIN nt ON nt.s1_id = entity_id LEFT JOIN np ON np.s1_id = entity_id AND np.threshold = g.threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, half, round(avg(f), 9) AS macro_f05 FROM f GROUP BY ALL""")
def halves_sweep(spark, d):
    """The macro F0.5 at each threshold in both halves of the S1."""
    entities = T.raw_s1(spark, d).select(F.col("entity_id").alias("s1_id"))
    return rounded(D.halves_sweep(entities, scored(spark, d).select("s1_id", "m_id", "p"), truth(spark, d), [0.3, 0.5, 0.7, 0.9]), "macro_f05", digits=9)


@query(f"""WITH {_SCORED}, {TRUTH_CTE}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM sp) WHERE r = 1 AND p >= 0.6), nt AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1), np AS (SELECT s1_id, count(*) AS np, count(t.m_id) AS hits FROM o LEFT JOIN truth t USING (s1_id, m_id) GROUP BY 1), fr AS (SELECT addr_state, name_core, count(*) AS k FROM pool WHERE entity_id NOT IN (SELECT m_id FROM truth) GROUP BY ALL),
    f AS (SELECT country, coalesce(fr.k, 0) AS k, coalesce(n_true, 0) AS n_true, CASE WHEN coalesce(np, 0) = 0 AND coalesce(n_true, 0) = 0 THEN 1.0 WHEN coalesce(hits, 0) = 0 THEN 0.0 ELSE 1.25 * hits / (np + 0.25 * n_true) END AS f FROM s1 LEFT JOIN nt ON nt.s1_id = entity_id LEFT JOIN np ON np.s1_id = entity_id LEFT JOIN fr USING (addr_state, name_core))
    SELECT coalesce(country, 'all') AS country, round(avg(f), 9) AS macro_f05, round(sum(f * 2 ** least(k, 3)) / sum(2 ** least(k, 3)), 9) AS weighted_f05, round(avg(CASE WHEN k >= 1 THEN f END), 9) AS look_alike_f05, round(avg(CAST(k >= 1 AS DOUBLE)), 9) AS look_alike_share, round(avg(CASE WHEN n_true = 0 THEN f END), 9) AS singleton_f05, round(avg(CASE WHEN n_true > 0 THEN f END), 9) AS matched_f05, count(*) AS entities FROM f GROUP BY ROLLUP (country)""")
def quality_report(spark, d):
    """Macro F0.5, weighted by look-alikes, by kinds of S1 and by country."""
    s1, pool, t = T.s1(spark, d), T.pool(spark, d), truth(spark, d)
    pred = D.one_owner(scored(spark, d).select("s1_id", "m_id", "p")).where("p >= 0.6")
    f = D.entity_f05(s1.select(F.col("entity_id").alias("s1_id")), pred, t).select("s1_id", "n_true", "f05")
    found = D.report(f, D.look_alikes(s1, pool, t).join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id"))
    return rounded(found, "macro_f05", "weighted_f05", "look_alike_f05", "look_alike_share", "singleton_f05", "matched_f05", digits=9)


# learned tables and models

@query(f"""WITH {_SCORED}, pos AS (SELECT sum(y) AS np, count(*) - sum(y) AS nn FROM sp), r AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM sp), b AS (SELECT p, count(*) AS n, sum(y) AS k FROM sp GROUP BY p), a AS (SELECT k, sum(k) OVER (ORDER BY p DESC) / sum(n) OVER (ORDER BY p DESC) AS pr FROM b)
    SELECT round((SELECT (sum(rk) FILTER (y = 1) - any_value(np) * (any_value(np) + 1) / 2.0) / (any_value(np) * any_value(nn)) FROM r, pos), 6) AS auc, round((SELECT -avg(y * ln(p) + (1 - y) * ln(1 - p)) FROM sp), 6) AS log_loss, round((SELECT sum(k * pr) / sum(k) FROM a), 6) AS average_precision""")
def score_quality(spark, d):
    """Area under the curve, log loss and average precision of scores."""
    x = scored(spark, d).select("p", "y")
    return rounded(L.quality(x).join(F.broadcast(L.average_precision(x))), "auc", "log_loss", "average_precision")


@query(f"""WITH {_SCORED}, v AS (SELECT s1_id, m_id, ln(p / (1 - p)) * 0.7 AS z, 0.7 AS w FROM sp UNION ALL SELECT s1_id, m_id, ln((1 - p) / p) * 0.3, 0.3 FROM sp WHERE y = 1) SELECT s1_id, m_id, round(1 / (1 + exp(-sum(z) / sum(w))), 6) AS p FROM v GROUP BY ALL""")
def blended_variants(spark, d):
    """The weighted mean of the logits of two scores; pairs that one lacks have the other's."""
    x = scored(spark, d).select("s1_id", "m_id", "y", "p")
    return rounded(L.blend_variants([x, x.where("y = 1").withColumn("p", 1 - F.col("p"))], [0.7, 0.3]), "p")


_CROSS = "q AS (SELECT s1_id, a_name_core AS a, b_name_core AS b, a_country = 'US' AS held, " + HALF.format("s1_id") + " AS half FROM x WHERE a_k = b_k)"


def _table_sql(where: str) -> str:
    return f"SELECT word, meaning, n FROM (SELECT word, arg_max(other, (n, other)) AS meaning, max(n) AS n, sum(n) AS tot FROM (SELECT word, other, count(*) AS n FROM (SELECT unnest(string_split(a, ' ')) AS word, unnest(string_split(b, ' ')) AS other FROM q WHERE {where} AND len(string_split(a, ' ')) = len(string_split(b, ' '))) GROUP BY ALL) GROUP BY word) WHERE n >= 2 AND n >= tot * 0.5"


@query(f"WITH {DESCRIBED_CTE}, {_CROSS} " + " UNION ALL ".join(f"SELECT '{k}' AS key, * FROM ({_table_sql(w)})" for k, w in {"nv": "NOT held", "h0": "NOT held AND half = 1", "h1": "NOT held AND half = 0", "v0": "half = 1", "v1": "half = 0", "all": "true"}.items()))
def crossed_translations(spark, d):
    """Word tables learned from other halves of the S1, so that no pair is described with a table learned from itself."""
    x = described(spark, d).where(F.regexp_extract("s1_id", "-(\\d+)$", 1) == F.regexp_extract("m_id", "-(\\d+)-", 1)).select("s1_id", F.col("a_name_core").alias("a"), F.col("b_name_core").alias("b"), "a_country")
    out = None
    for key, t in L.crossed_tables(x, "a", "b", F.col("a_country") == "US").items():
        t = t.select(F.lit(key).alias("key"), "word", "meaning", "n")
        out = t if out is None else out.unionByName(t)
    return out


@query(f"WITH {T.RAW_CTE}, st AS (SELECT entity_id, 'S1-' || CAST(k // 2 AS VARCHAR) AS s1_id, lower(split_part(business_name, ' ', 1)) AS b FROM raw_pool WHERE variant = 0) SELECT b AS brand, min(s1_id) AS s1_id FROM (SELECT b || chr(CAST(97 + CAST(split_part(entity_id, '-', 2) AS BIGINT) % 26 AS INT)) || chr(CAST(97 + (CAST(split_part(entity_id, '-', 2) AS BIGINT) // 26) % 26 AS INT)) AS b, s1_id FROM st) WHERE len(b) >= 5 GROUP BY b HAVING count(DISTINCT s1_id) = 1")
def brand_names(spark, d):
    """Brands from names of the form 'brand f/k/a name' that belong to one S1 alone."""
    letter = lambda n: F.chr(97 + n % 26)
    k = F.col("k")
    brand = F.concat(F.split_part(F.col("business_name"), F.lit(" "), F.lit(1)), letter(k), letter(F.floor(k / 26)))
    records = T.raw_pool(spark, d).where("variant = 0").withColumn("business_name", F.concat(brand, F.lit(" Labs f/k/a "), "business_name"))
    owners = records.select(F.col("entity_id").alias("m_id"), F.concat(F.lit("S1-"), F.floor(k / 2).cast("string")).alias("s1_id"))
    return L.brand_table(records, owners)


@query()
def has_match(spark, d):
    """The chance that an S1 has a match at all, out of fold."""
    return rounded(L.has_match_scores(scored(spark, d).select("s1_id", "m_id", "p"), truth(spark, d), fit=lambda df, f: L.fit_trees(df, f, rounds=3, depth=3)), "p_match")


@query()
def entity_roles(spark, d):
    """Which records fit, stop and test a model, and the regional sample of records."""
    s1, pool = T.s1(spark, d), T.pool(spark, d)
    sample = L.regional_sample(s1, pool, ["ny", "ap"]).withColumn("role", F.lit("sample"))
    return L.roles(s1, ["ny", "ap"]).unionByName(sample)


@query()
def second_region(spark, d):
    """How well a model of two countries scores the third."""
    x = with_scores(spark, d)
    names = ["cos_name", "cos_addr", "shares"]
    return rounded(L.transfer(x.where("a_country <> 'France'"), x.where("a_country = 'France'"), names, fit=lambda df, f: L.fit_trees(df, f, rounds=3, depth=3)), "auc", "log_loss")


@query()
def all_pair_features(spark, d):
    """Every feature of the candidate pairs in one table."""
    s1, pool = T.s1(spark, d), T.pool(spark, d)
    zero = {f"cos_{p}": F.lit(0.0) for p in ("name", "phon", "addr", "comb", "cat")}
    return P.all_features(T.candidates(spark, d).drop("y").withColumns({"via": F.lit(9), **zero}), s1, pool, P.country_idf(s1, pool, "name_core"), P.country_idf(s1, pool, "addr_text"))


