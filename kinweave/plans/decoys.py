"""Queries of the label-free tests on decoys, and of the maintenance of match files, over scored pairs of business records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators import decide as D
from kinweave.operators import decoy as J
from kinweave.operators import overlay as O
from kinweave.plans import features as V
from kinweave.plans import records as T
from kinweave.plans.features import _SCORED, described, scored
from kinweave.plans.linkage import _TRUTH, truth
from kinweave.plans.registry import big, query, rounded

_SHIFT, _PURE = "(1, 2, 3, 4, 5, 7, 9, 11, 13, 21)", "(3, 4, 5, 7, 9, 11, 13, 21)"
_ONE_OFF = "CASE WHEN len(p) = len(q) THEN len(list_filter(range(1, len(p) + 1), lambda i: substr(p, i, 1) <> substr(q, i, 1))) = 1 AND substr(p, len(p), 1) = substr(q, len(q), 1) ELSE " + V._DROP + " END"
#: Addresses here hold at most one number, so that the multisets are sets.
_NUM_REL = f"""m AS (SELECT *, {V._MULTI.format('a_addr_text')} AS ma, {V._MULTI.format('b_addr_text')} AS mb FROM sp), mm AS (SELECT * EXCLUDE (p), p AS score, CAST(ma[1] AS VARCHAR) AS p, CAST(mb[1] AS VARCHAR) AS q, mb[1] - ma[1] AS g FROM m),
    nr AS (SELECT * EXCLUDE (p, q, score), score AS p, CASE WHEN len(ma) = 0 OR len(mb) = 0 THEN 'missing' WHEN ma = mb THEN 'eq' WHEN g IN {_SHIFT} THEN CASE WHEN g IN {_PURE} THEN 'shift_pure' ELSE 'shift_12' END WHEN g BETWEEN -25 AND -1 THEN 'neg_small' WHEN {_ONE_OFF} THEN 'typo' WHEN abs(g) <= 100 THEN 'near_other' ELSE 'far' END AS num_rel FROM mm)"""


def related(spark, d):
    """Scored pairs with the class of their numbers."""
    return scored(spark, d).withColumn("num_rel", J.number_relation(X.number_multiset(F.col("a_addr_text")), X.number_multiset(F.col("b_addr_text"))))


@query(f"WITH {_SCORED}, {_NUM_REL} SELECT s1_id, m_id, num_rel FROM nr")
def number_relations(spark, d):
    """The class of the relation of the house numbers of a pair."""
    return related(spark, d).select("s1_id", "m_id", "num_rel")


_REL = "list_sort(string_split(a_name_core, ' ')) AS sa, list_sort(string_split(b_name_core, ' ')) AS sb, list_filter(list_distinct(string_split(b_name_core, ' ')), lambda t: NOT list_contains(string_split(a_name_core, ' '), t)) AS mo, list_filter(list_distinct(string_split(a_name_core, ' ')), lambda t: NOT list_contains(string_split(b_name_core, ' '), t)) AS le"


@query(f"""WITH {_SCORED}, t AS (SELECT *, {_REL}, 100.0 * {V._jaccard("list_distinct(string_split(a_name_core, ' '))", "list_distinct(string_split(b_name_core, ' '))")} AS ts FROM sp) SELECT s1_id, m_id, CASE WHEN a_name_core = b_name_core THEN 'eq' WHEN sa = sb THEN 'perm' WHEN replace(a_name_core, ' ', '') = replace(b_name_core, ' ', '') THEN 'space' WHEN len(le) = 0 THEN CASE WHEN len(mo) = 1 THEN 'add_1' ELSE 'add_2+' END WHEN len(mo) = 0 THEN CASE WHEN len(le) = 1 THEN 'drop_1' ELSE 'drop_2+' END
    WHEN len(mo) = 1 AND len(le) = 1 THEN CASE WHEN 1 - levenshtein(mo[1], le[1]) / greatest(len(mo[1]), len(le[1])) >= 0.5 THEN 'typo1' ELSE 'swap1' END WHEN ts >= 85 THEN 'fuzzy_hi' WHEN split_part(a_name_core, ' ', 1) = split_part(b_name_core, ' ', 1) THEN 'first_same' WHEN ts >= 60 THEN 'fuzzy_mid' ELSE 'diff' END AS name_rel FROM t""")
def name_relations(spark, d):
    """The class of the relation of two names; the overlap of words stands for the set ratio."""
    x = scored(spark, d)
    return x.select("s1_id", "m_id", J.name_relation(F.col("a_name_core"), F.col("b_name_core"), F.col("set_ratio")).alias("name_rel"))


@query(f"""WITH {V.DESCRIBED_CTE}, s AS (SELECT *, list_distinct(list_filter(string_split(a_addr_text, ' '), lambda t: NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ('ny', 'ca') AND len(t) > 1)) AS wa, list_distinct(list_filter(string_split(b_addr_text, ' '), lambda t: NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ('ny', 'ca') AND len(t) > 1)) AS wb FROM x), j AS (SELECT *, {V._jaccard('wa', 'wb')} AS j FROM s)
    SELECT s1_id, m_id, CASE WHEN a_name_legal = '' AND b_name_legal = '' THEN 'both_empty' WHEN a_name_legal = b_name_legal THEN 'eq' WHEN a_name_legal = '' OR b_name_legal = '' THEN 'one_empty' ELSE 'diff' END AS legal_rel, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 'empty' WHEN j = 1 THEN 'eq' WHEN j >= 0.6 THEN 'hi' WHEN j >= 0.3 THEN 'mid' ELSE 'lo' END AS street_rel, CASE WHEN a_addr_state = '' OR b_addr_state = '' THEN 'empty' WHEN a_addr_state = b_addr_state THEN 'eq' ELSE 'diff' END AS state_rel FROM j""")
def other_relations(spark, d):
    """The classes of the relations of legal forms, streets and states."""
    x = described(spark, d)
    return x.select("s1_id", "m_id", J.legal_relation(F.col("a_name_legal"), F.col("b_name_legal")).alias("legal_rel"), J.street_relation(F.col("a_addr_text"), F.col("b_addr_text"), ["ny", "ca"]).alias("street_rel"), J.state_relation(F.col("a_addr_state"), F.col("b_addr_state")).alias("state_rel"))


_VT = "v AS (SELECT * FROM nr WHERE country <> 'US'), t AS (SELECT * FROM nr WHERE country = 'US')"


def sides(spark, d):
    """A labelled side and a test side: other countries and the US."""
    x = related(spark, d)
    return x.where("country <> 'US'"), x.where("country = 'US'")


@query(f"""WITH {_SCORED}, {_NUM_REL}, {_VT}, a AS (SELECT num_rel, count(*) * 1000.0 / 120 AS v_n, count(CASE WHEN y = 1 THEN 1 END) * 1000.0 / 120 AS pos, count(CASE WHEN y = 0 THEN 1 END) * 1000.0 / 120 AS neg, count(CASE WHEN y = 1 AND p >= 0.7 THEN 1 END) * 1000.0 / 120 AS v_tp, count(CASE WHEN y = 0 AND p >= 0.7 THEN 1 END) * 1000.0 / 120 AS v_fp FROM v GROUP BY 1), b AS (SELECT num_rel, count(*) * 1000.0 / 60 AS t_n, count(CASE WHEN p >= 0.7 THEN 1 END) * 1000.0 / 60 AS t_pred FROM t GROUP BY 1),
    c AS (SELECT num_rel, coalesce(t_n, 0) AS t_n, coalesce(t_pred, 0) AS t_pred, coalesce(v_n, 0) AS v_n, coalesce(v_tp, 0) AS v_tp, coalesce(v_fp, 0) AS v_fp, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM a FULL JOIN b USING (num_rel)) SELECT num_rel, round(t_n, 6) AS t_n, round(t_pred, 6) AS t_pred, round(v_n, 6) AS v_n, round(v_tp, 6) AS v_tp, round(v_fp, 6) AS v_fp, round(CASE WHEN neg > 0 THEN (t_n - pos) / neg END, 6) AS rho, round(t_pred - v_tp, 6) AS excess FROM c WHERE t_n >= 2 OR v_n >= 2""")
def labelled_cells(spark, d):
    """Densities by number relation on a labelled and a test side."""
    v, t = (x.withColumn("predicted", F.col("p") >= 0.7) for x in sides(spark, d))
    return rounded(J.labelled_cells(v, t, ["num_rel"], 120, 60), "t_n", "t_pred", "v_n", "v_tp", "v_fp", "rho", "excess")


_BAND = "CASE WHEN p > 0.95 THEN 'e' WHEN p > 0.75 THEN 'd' WHEN p > 0.3 THEN 'c' WHEN p > 0.05 THEN 'b' ELSE 'a' END"
_G = "CASE WHEN num_rel IN ('shift_pure', 'shift_12', 'shift_ms_only') THEN num_rel ELSE 'other' END"


@query(f"""WITH {_SCORED}, {_NUM_REL}, {_VT}, a AS (SELECT {_G} AS g, {_BAND} AS band, count(CASE WHEN y = 1 THEN 1 END) * 1000.0 / 120 AS pos, count(CASE WHEN y = 0 THEN 1 END) * 1000.0 / 120 AS neg FROM v GROUP BY ALL), b AS (SELECT {_G} AS g, {_BAND} AS band, count(*) * 1000.0 / 60 AS n FROM t GROUP BY ALL),
    w AS (SELECT 'x' AS country, g, band, round(CASE WHEN neg > 0 THEN least(greatest((n - pos) / neg, 1.0), 5.0) ELSE 5.0 END, 6) AS weight FROM a JOIN b USING (g, band)) SELECT * FROM w WHERE band <> 'e' UNION ALL SELECT country, g, 'e', weight FROM w WHERE band = 'd'""")
def inflation_weights(spark, d):
    """How much denser false pairs are on the test side, by group and band."""
    v, t = (x.withColumn("country", F.lit("x")) for x in sides(spark, d))
    return rounded(J.inflation(v, t, 120, 60), "weight")


@query(f"""WITH {_SCORED}, {_NUM_REL}, {_VT}, a AS (SELECT {_G} AS g, count(CASE WHEN p >= 0.75 AND y = 1 THEN 1 END) / greatest(count(CASE WHEN y = 1 THEN 1 END), 1) AS recall, count(CASE WHEN p >= 0.75 AND y = 1 THEN 1 END) * 1000.0 / 120 AS tp FROM v GROUP BY 1), tr AS (SELECT {_G} AS g, count(*) * 1000.0 / 200 AS all_true FROM nr WHERE y = 1 GROUP BY 1), te AS (SELECT {_G} AS g, count(CASE WHEN p >= 0.75 AND country = 'US' THEN 1 END) * 1000.0 / 60 AS here, count(CASE WHEN p >= 0.75 THEN 1 END) * 1000.0 / 200 AS everywhere FROM nr GROUP BY 1)
    SELECT g, round(greatest(everywhere - recall * all_true, 0.01) / greatest(here - tp, 0.01), 6) AS k, round(recall * all_true / greatest(tp, 0.01), 6) AS k_pos FROM a JOIN tr USING (g) JOIN te USING (g)""")
def all_state_correction(spark, d):
    """How the densities of the labelled states compare with those of all."""
    g = F.when(F.col("num_rel").isin(J.SHIFT_GROUPS), F.col("num_rel")).otherwise("other").alias("g")
    x = related(spark, d).select("*", g)
    rate = x.where("y = 1").groupBy("g").agg((F.count("*") * 1000.0 / 200).alias("all_true"))
    sure = F.col("p") >= 0.75
    test = x.groupBy("g").agg((F.count(F.when(sure & (F.col("country") == "US"), 1)) * 1000.0 / 60).alias("here"), (F.count(F.when(sure, 1)) * 1000.0 / 200).alias("everywhere"))
    return rounded(J.all_state_correction(x.where("country <> 'US'"), rate, test, 120), "k", "k_pos")


@query(f"""WITH {_SCORED}, {_NUM_REL}, {_VT}, a AS (SELECT num_rel, CAST(p >= 0.5 AS INTEGER) + CAST(p >= 0.8 AS INTEGER) AS band, count(*) AS valid, (sum(y) + 0.5) / (count(*) + 1) AS pr FROM v GROUP BY ALL), b AS (SELECT num_rel, CAST(p >= 0.5 AS INTEGER) + CAST(p >= 0.8 AS INTEGER) AS band, count(*) AS test FROM t GROUP BY ALL), c AS (SELECT num_rel, band, coalesce(valid, 0) AS valid, coalesce(test, 0) AS test, pr FROM a FULL JOIN b USING (num_rel, band)),
    h AS (SELECT num_rel, sum(valid) AS hv, sum(test) AS ht FROM c WHERE band > 0 GROUP BY 1), r AS (SELECT c.*, CASE WHEN NOT starts_with(num_rel, 'shift') AND band > 0 AND hv IS NOT NULL THEN CASE WHEN hv >= 15 AND ht >= 15 THEN greatest((ht / 60) / (hv / 120), 1.0) ELSE 1.0 END WHEN valid >= 15 AND test >= 15 THEN greatest((test * 1000.0 / 60) / (valid * 1000.0 / 120), 1.0) ELSE 1.0 END AS ratio FROM c LEFT JOIN h USING (num_rel))
    SELECT num_rel, CAST(band AS BIGINT) AS band, round(ratio, 6) AS ratio, round(pr, 6) AS precision, round(pr / ratio, 6) AS q FROM r""")
def pooled_invariance(spark, d):
    """Precision by invariance, with one density ratio for the upper bands of groups that are no shift."""
    v, t = (x.withColumn("band", X.band(F.col("p"), [0.5, 0.8])) for x in sides(spark, d))
    cells = J.density(v, t, ["num_rel", "band"], 120, 60)
    return rounded(big(J.pooled_invariance(v, cells, ["num_rel"], 120, 60), "band"), "ratio", "precision", "q")


_VOCABULARY = ["motors", "steel", "foods", "pharma", "group"]
_NEAR = "coalesce(list_bool_or(list_transform(ta, lambda w: levenshtein(t, w) <= CASE WHEN len(t) >= 5 AND len(w) >= 5 THEN 2 ELSE 1 END)), false)"


@query(f"""WITH {V.DESCRIBED_CTE}, w AS (SELECT s1_id, m_id, string_split(a_name_core, ' ') AS ta, string_split(b_name_core, ' ') AS tb, regexp_extract_all(lower(a_business_name), '[a-z0-9]+') AS ra, regexp_extract_all(lower(b_business_name), '[a-z0-9]+') AS rb FROM x)
    SELECT s1_id, m_id, len(list_filter(tb, lambda t: NOT list_contains(ta, t) AND list_contains({T._list(_VOCABULARY)}, t) AND NOT {_NEAR})) > 0 AS decoy, len(list_filter(rb, lambda t: NOT list_contains(ra, t) AND list_contains({T._list(_VOCABULARY)}, t) AND NOT coalesce(list_bool_or(list_transform(ra, lambda w: regexp_replace(w, 's$', '') = regexp_replace(t, 's$', '') OR (len(t) >= 5 AND levenshtein(w, t) <= 1))), false))) > 0 AS raw_decoy FROM w""")
def decoy_words(spark, d):
    """Whether a record adds a word of the decoy vocabulary, to the core and to the raw name."""
    x = described(spark, d)
    return x.select("s1_id", "m_id", J.decoy_words(F.col("a_name_core"), F.col("b_name_core"), _VOCABULARY).alias("decoy"), J.raw_decoy_words(F.col("a_business_name"), F.col("b_business_name"), _VOCABULARY).alias("raw_decoy"))


@query(f"""WITH {_SCORED}, nn AS (SELECT *, list_filter({V._MULTI.format('a_addr_text')}, lambda n: n < 10000) AS ma, list_filter({V._MULTI.format('b_addr_text')}, lambda n: n < 10000) AS mb, 100.0 * {V._jaccard("list_distinct(string_split(a_name_core, ' '))", "list_distinct(string_split(b_name_core, ' '))")} AS ts FROM sp)
    SELECT s1_id, m_id, CASE WHEN len(ma) > 0 AND len(mb) > 0 AND NOT list_has_all(mb, ma) AND NOT list_has_all(ma, mb) THEN CASE WHEN a_name_core = b_name_core THEN 'exact' WHEN ts >= 85 THEN 'near' ELSE 'other' END END AS moved FROM nn""")
def moved_numbers(spark, d):
    """Pairs whose numbers moved, by how alike the names are; the overlap of words stands for the ratio."""
    x = scored(spark, d)
    return x.select("s1_id", "m_id", J.moved_numbers(F.col("a_addr_text"), F.col("b_addr_text"), F.col("a_name_core"), F.col("b_name_core"), F.col("set_ratio")).alias("moved"))


@query()
def name_classes(spark, d):
    """How the names of pairs differ, in the two classifications."""
    x = described(spark, d)
    a, b = J.name_class(x).select("s1_id", "m_id", "cls"), J.suffix_class(x).select("s1_id", "m_id", F.col("cls").alias("suffix"))
    return a.join(b, ["s1_id", "m_id"])


@query()
def word_swaps(spark, d):
    """Pairs whose names differ in one unlike word at the same address, with class, tier and owner."""
    x = J.swap_classes(J.one_word_swaps(described(spark, d)), T.s1(spark, d), T.pool(spark, d))
    return big(x.select("s1_id", "m_id", "at", "target", "cls", "tier", "owner"), "at")


#: Pairs of a file with made classes: those of variant 5 are swaps, by the first letter of their S1.
_FILE = "fl AS (SELECT s1_id, m_id, a_name_core, b_name_core, a_k, b_variant, a_k % 3 AS third FROM x WHERE a_k = b_k), own AS (SELECT s1_id, count(CASE WHEN a_name_core = b_name_core THEN 1 END) AS copies FROM fl GROUP BY 1), sw AS (SELECT s1_id, m_id, split_part(b_name_core, ' ', 1) AS target, CASE WHEN a_k % 2 = 0 THEN 'first' ELSE 'single' END AS cls, CASE WHEN a_k % 4 = 0 THEN 'S1-0' END AS owner FROM fl WHERE b_variant = 5)"


def file_and_swaps(spark, d):
    x = described(spark, d).withColumns({"k": F.regexp_extract("s1_id", "-(\\d+)$", 1).cast("long"), "mk": F.regexp_extract("m_id", "-(\\d+)-", 1).cast("long")}).where("k = mk")
    swaps = x.where(F.col("m_id").endswith("-5")).select("s1_id", "m_id", F.split_part(F.col("b_name_core"), F.lit(" "), F.lit(1)).alias("target"), F.when(F.col("k") % 2 == 0, "first").otherwise("single").alias("cls"), F.when(F.col("k") % 4 == 0, "S1-0").alias("owner"))
    return x, swaps


@query(f"WITH {V.DESCRIBED_CTE}, {_FILE}, c AS (SELECT s1_id, min(cls) AS cls FROM sw GROUP BY 1) SELECT cls, count(*) AS n, round(avg(copies), 9) AS mean, round((SELECT avg(copies) FROM own WHERE s1_id NOT IN (SELECT s1_id FROM c)) - avg(copies), 9) AS deficit FROM own JOIN c USING (s1_id) GROUP BY cls")
def copy_deficits(spark, d):
    """How many fewer own-name copies the S1 of a class hold."""
    kept, swaps = file_and_swaps(spark, d)
    return rounded(J.copy_deficit(kept, swaps), "mean", "deficit", digits=9)


_SHARES = "f1 AS (SELECT s1_id, min((m_id, target, cls)) AS f FROM sw GROUP BY 1), f2 AS (SELECT s1_id, copies, f[2] AS target, f[3] AS cls FROM own JOIN f1 USING (s1_id)), bs AS (SELECT avg(copies) AS base FROM own WHERE s1_id NOT IN (SELECT s1_id FROM f1)), nw AS (SELECT target, cls, count(*) AS n FROM f2 GROUP BY ALL), f3 AS (SELECT copies, cls, CASE WHEN n < 3 THEN '<small>' ELSE target END AS target FROM f2 JOIN nw USING (target, cls)), sh AS (SELECT target, cls, count(*) AS n, least(greatest((any_value(base) - avg(copies)) / CASE cls WHEN 'first' THEN 0.8 ELSE 0.4 END, 0.0), 1.0) AS share FROM f3, bs GROUP BY target, cls)"


@query(f"WITH {V.DESCRIBED_CTE}, {_FILE}, {_SHARES} SELECT target, cls, n, round(share, 9) AS share FROM sh")
def word_shares(spark, d):
    """The share of true pairs among the swaps of each word."""
    kept, swaps = file_and_swaps(spark, d)
    return rounded(J.word_shares(swaps, kept, {"first": 0.8, "single": 0.4}, least=3), "share", digits=9)


@query(f"WITH {V.DESCRIBED_CTE}, {_FILE}, {_SHARES}, z AS (SELECT s1_id, m_id, owner, coalesce(a.share, b.share, 1.0) AS share FROM sw LEFT JOIN (SELECT * FROM sh WHERE n >= 3 AND target <> '<small>') a USING (target, cls) LEFT JOIN (SELECT cls, share FROM sh WHERE target = '<small>') b USING (cls)) SELECT s1_id, m_id, CASE WHEN owner IS NOT NULL THEN 'move' ELSE 'drop' END AS action, owner AS to_id, round(share, 9) AS share FROM z WHERE share < 0.5")
def swap_actions(spark, d):
    """Which swaps go, and which move to the S1 that owns their name."""
    kept, swaps = file_and_swaps(spark, d)
    return rounded(J.swap_actions(swaps, J.word_shares(swaps, kept, {"first": 0.8, "single": 0.4}, least=3), rows=3), "share", digits=9)


@query(f"""WITH {T.RAW_CTE}, o AS (SELECT entity_id, 'S1-' || CAST(k AS VARCHAR) AS s1_id FROM raw_pool WHERE variant IN (0, 1)), d AS (SELECT entity_id || suffix AS entity_id, business_name, business_address FROM raw_pool, (SELECT unnest(['', 'b']) AS suffix)), q AS (SELECT substr(d.entity_id, 1, 2) AS src, lower(trim(business_name)) AS n, lower(trim(business_address)) AS a, count(*) AS k, count(s1_id) AS owned, count(DISTINCT s1_id) AS owners FROM d LEFT JOIN o USING (entity_id) WHERE business_address <> '' GROUP BY ALL HAVING count(*) > 1)
    SELECT CASE WHEN owned = 0 THEN 'none owned' WHEN owned < k THEN 'some unowned' WHEN owners = 1 THEN 'same owner' ELSE 'several owners' END AS outcome, count(*) AS n FROM q GROUP BY 1""")
def raw_duplicates(spark, d):
    """Groups of records with one raw name and address in a source, by their owners; every record is given twice."""
    raw = T.raw_pool(spark, d)
    twice = raw.select(F.explode(F.array(F.col("entity_id"), F.concat("entity_id", F.lit("b")))).alias("entity_id"), "business_name", "business_address")
    owners = raw.where("variant IN (0, 1)").select(F.col("entity_id").alias("m_id"), F.concat(F.lit("S1-"), F.col("k").cast("string")).alias("s1_id"))
    return J.raw_duplicates(twice, owners)


@query(f"""WITH {_SCORED}, {_TRUTH}, cp AS (SELECT s1_id, count(CASE WHEN m_id LIKE 'S2%' THEN 1 END) AS n2, count(CASE WHEN m_id LIKE 'S3%' THEN 1 END) AS n3 FROM truth GROUP BY 1), j AS (SELECT n2, n3, count(*) AS k FROM cp GROUP BY ALL), t AS (SELECT sp.s1_id, m_id, CAST(substr(m_id, 2, 1) AS INTEGER) AS src, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3 FROM sp LEFT JOIN cp USING (s1_id)),
    l AS (SELECT t.s1_id, m_id, (coalesce(h.k, 0) + 0.5) / (coalesce(g.k, 0) + 0.5) AS lr FROM t LEFT JOIN j g ON g.n2 = t.n2 AND g.n3 = t.n3 LEFT JOIN j h ON h.n2 = t.n2 + CAST(src = 2 AS INTEGER) AND h.n3 = t.n3 + CAST(src = 3 AS INTEGER)) SELECT s1_id, m_id, round(lr / sum(lr) OVER (PARTITION BY m_id), 9) AS q FROM l""")
def source_priors(spark, d):
    """Which of a record's S1 lacks a copy in the record's source."""
    t = truth(spark, d)
    count = t.groupBy("s1_id").agg(F.count(F.when(F.col("m_id").startswith("S2"), 1)).alias("n2"), F.count(F.when(F.col("m_id").startswith("S3"), 1)).alias("n3"))
    ties = T.candidates(spark, d).select("s1_id", "m_id", F.substring("m_id", 2, 1).cast("int").alias("src"))
    return rounded(J.source_prior(ties, count, count), "q", digits=9)


@query(f"""WITH {_SCORED}, {_TRUTH}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM sp) WHERE r = 1), h AS (SELECT p, t.m_id IS NOT NULL AS hit FROM b LEFT JOIN truth t USING (s1_id, m_id)) SELECT CAST(threshold AS DOUBLE) AS threshold, round(count(CASE WHEN p >= threshold THEN 1 END) / count(*), 9) AS covered, round(count(CASE WHEN p >= threshold AND hit THEN 1 END) / greatest(count(CASE WHEN p >= threshold THEN 1 END), 1), 9) AS precision FROM h, (SELECT unnest([0.72, 0.8, 0.9]) AS threshold) GROUP BY threshold""")
def tie_break_quality(spark, d):
    """How many tied records a threshold decides, and how well."""
    q = scored(spark, d).select("s1_id", "m_id", F.col("p").alias("q"))
    return rounded(J.tie_break_quality(q, truth(spark, d), [0.72, 0.8, 0.9]), "covered", "precision", digits=9)


_KS = ", ".join(f"round(avg(CAST(least(k, 6) = {i} AS DOUBLE)), 9) AS k{i}" for i in range(7))


@query(f"""WITH {T.RECORDS_CTE}, {_TRUTH}, b AS (SELECT s1_id, count(*) AS n FROM truth WHERE m_id LIKE 'S2%' GROUP BY 1), w AS (SELECT s1_id, count(*) AS n FROM truth WHERE m_id LIKE 'S3%' GROUP BY 1), e AS (SELECT addr_state, coalesce(b.n, 0) AS bf, coalesce(w.n, 0) AS nw FROM s1 LEFT JOIN b ON b.s1_id = entity_id LEFT JOIN w ON w.s1_id = entity_id),
    l AS (SELECT addr_state, 'before' AS stage, bf AS k FROM e UNION ALL SELECT addr_state, 'after', bf + nw FROM e UNION ALL SELECT addr_state, 'receivers', bf FROM e WHERE nw > 0) SELECT addr_state, stage, count(*) AS n, round(avg(k), 9) AS mean, {_KS} FROM l GROUP BY ALL""")
def fill_test(spark, d):
    """How many records the S1 of a state hold before and after additions."""
    s1, t = T.s1(spark, d).select(F.col("entity_id").alias("s1_id"), "addr_state"), truth(spark, d)
    x = J.fill_test(s1, t.where(F.col("m_id").startswith("S2")), t.where(F.col("m_id").startswith("S3")), "addr_state")
    return rounded(x, "mean", *[f"k{i}" for i in range(7)], digits=9)


@query(f"""WITH {T.RECORDS_CTE}, {_TRUTH}, n AS (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1), c AS (SELECT country, coalesce(n, 0) AS n, list_distinct(list_filter(regexp_extract_all(addr_text, '[a-z]+'), lambda t: len(t) > 2)) AS f FROM s1 LEFT JOIN n ON s1_id = entity_id), b AS (SELECT country, avg(n) AS base FROM c GROUP BY 1), l AS (SELECT country, n, unnest(f) AS feature FROM c)
    SELECT feature, country, count(*) AS rows, round(avg(n), 9) AS mean, round(avg(n) - any_value(base), 9) AS gap FROM l JOIN b USING (country) GROUP BY feature, country HAVING count(*) >= 5""")
def format_health(spark, d):
    """Counts of the S1 with each word in their address against their country's."""
    n = truth(spark, d).groupBy("s1_id").agg(F.count("*").alias("n"))
    c = T.s1(spark, d).join(n, F.col("s1_id") == F.col("entity_id"), "left").na.fill(0, ["n"])
    return rounded(J.format_health(c, X.street_words(F.col("addr_text")), "country", 5), "mean", "gap", digits=9)


_NEW = "sn AS (SELECT s1_id, m_id, y, p, country, CASE WHEN y = 1 THEN round(least(p + 0.2, 0.99), 6) WHEN country <> 'US' THEN round(p * 0.8, 6) END AS p_new FROM sp)"


def rescored(spark, d):
    """Scored pairs with a second score; some have none."""
    new = F.when(F.col("y") == 1, F.round(F.least(F.col("p") + 0.2, F.lit(0.99)), 6)).when(F.col("country") != "US", F.round(F.col("p") * 0.8, 6))
    return scored(spark, d).select("s1_id", "m_id", "y", "p", "country", new.alias("p_new"))


@query(f"""WITH {_SCORED}, {_NEW}, z AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) = 1 AND p BETWEEN 0.1 AND 0.995 AND p_new IS NOT NULL THEN p_new ELSE p END AS pz FROM sn), a AS (SELECT s1_id, m_id FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM z) WHERE r = 1 AND p >= 0.75), b AS (SELECT s1_id, m_id FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY pz DESC, s1_id) AS r FROM z) WHERE r = 1 AND pz >= 0.75)
    SELECT s1_id, m_id, 'add' AS action FROM b ANTI JOIN a USING (s1_id, m_id) UNION ALL SELECT s1_id, m_id, 'remove' FROM a ANTI JOIN b USING (s1_id, m_id)""")
def zone_changes(spark, d):
    """What a new score changes where the old one is unsure."""
    return J.zone_changes(rescored(spark, d))


@query()
def threshold_scan(spark, d):
    """The expected score at each threshold without labels: recall, false pairs and lost S1 fitted to the counts of kept records."""
    counts = truth(spark, d).groupBy("s1_id").agg(F.count("*").alias("n"))
    entities = T.raw_s1(spark, d).select(F.col("entity_id").alias("s1_id"))
    law = J.histogram(entities.join(counts, "s1_id", "left").na.fill(0), "n")
    rows = list(J.scan_thresholds(scored(spark, d).select("s1_id", "m_id", "p"), entities, law, [0.5, 0.7, 0.9]))
    return rounded(spark.createDataFrame(rows, "threshold double, recall double, false double, lost double, expected double"), "recall", "false", "lost", "expected")


@query()
def count_shapes(spark, d):
    """The shares of false pairs that the shapes of count histograms tell: among pairs of other S1 than their record's, and among removals."""
    x, t = described(spark, d), truth(spark, d)
    n = t.groupBy("s1_id").agg(F.count("*").alias("n"))
    ref = J.histogram(n, "n") + np.concatenate([[float(x.select("s1_id").distinct().count() - n.count())], np.zeros(8)])
    kept = x.where("y = 1").groupBy("s1_id").agg(F.count("*").alias("n"))
    moved = kept.withColumn("n", F.col("n") + 1)
    shares = [("true copies", J.false_share(ref, J.histogram(kept, "n"))), ("one more", J.false_share(ref, J.histogram(moved, "n"))), ("removals", J.removal_share(ref, J.histogram(kept.withColumn("n", F.col("n") - 1), "n"), np.arange(1, 10)[::-1])[0])]
    return rounded(spark.createDataFrame(shares, "kind string, share double"), "share")


# match files

_DEC = "df AS (SELECT s1_id, m_id FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM sp) WHERE r = 1 AND p >= 0.7)"


def decided(spark, d):
    return D.one_owner(scored(spark, d).select("s1_id", "m_id", "p")).where("p >= 0.7").select("s1_id", "m_id")


@query(f"WITH {_SCORED}, {_DEC}, mv AS (SELECT s1_id AS from_id, 'S1-0' AS to_id, m_id FROM sp WHERE p >= 0.9) SELECT coalesce(to_id, s1_id) AS s1_id, df.m_id FROM df LEFT JOIN mv ON mv.m_id = df.m_id AND from_id = s1_id")
def moved_records(spark, d):
    """Records that still belong to the S1 they are to leave get their new one."""
    moves = scored(spark, d).where("p >= 0.9").select("m_id", F.col("s1_id").alias("from_id"), F.lit("S1-0").alias("to_id"))
    return O.move(decided(spark, d), moves)


@query(f"WITH {_SCORED}, {_DEC} SELECT s1_id, m_id FROM df ANTI JOIN (SELECT s1_id, m_id FROM sp WHERE p >= 0.72 AND p < 0.8) USING (s1_id, m_id)")
def band_dropped(spark, d):
    """A file without the pairs of a band of scores."""
    return O.drop_band(decided(spark, d), scored(spark, d), 0.72, 0.8)


@query(f"WITH {_SCORED}, {_DEC}, f AS (SELECT s1_id, m_id FROM df ANTI JOIN (SELECT s1_id, m_id FROM sp WHERE p < 0.8) USING (s1_id, m_id)), g AS (SELECT min(s1_id) AS s1_id, m_id FROM sp WHERE p >= 0.6 AND p < 0.8 AND m_id NOT IN (SELECT m_id FROM f) GROUP BY m_id), h AS (SELECT * FROM f UNION SELECT * FROM g) SELECT s1_id, m_id FROM h ANTI JOIN (SELECT s1_id, m_id FROM sp WHERE country = 'US' AND y = 0) USING (s1_id, m_id)")
def ordered_deltas(spark, d):
    """Two deltas one after another, with the check for two owners after each."""
    x = scored(spark, d)
    low = x.where("p < 0.8").select("s1_id", "m_id")
    kept = O.remove(decided(spark, d), low)
    new = x.where("p >= 0.6 AND p < 0.8").join(kept.select("m_id"), "m_id", "left_anti").groupBy("m_id").agg(F.min("s1_id").alias("s1_id")).select("s1_id", "m_id")
    none = new.limit(0)
    return O.apply_deltas(decided(spark, d), [(low, new), (x.where("country = 'US' AND y = 0").select("s1_id", "m_id"), none)])


@query(f"""WITH {_SCORED}, {_DEC}, ch AS (SELECT s1_id, m_id, 'remove' AS action, 'a' AS src FROM sp WHERE p < 0.8 AND p >= 0.6 UNION ALL SELECT s1_id, m_id, 'add', 'b' FROM sp WHERE p >= 0.5 AND p < 0.7), rm AS (SELECT src, action, CASE WHEN d.m_id IS NOT NULL THEN 'applied' ELSE 'not present' END AS outcome FROM (SELECT * FROM ch WHERE action = 'remove') c LEFT JOIN df d USING (s1_id, m_id)),
    kp AS (SELECT DISTINCT m_id FROM df ANTI JOIN (SELECT * FROM ch WHERE action = 'remove') USING (s1_id, m_id)), ad AS (SELECT c.*, k.m_id IS NOT NULL AS held, c.m_id LIKE '%-2' AS stop, row_number() OVER (PARTITION BY c.m_id ORDER BY s1_id) AS r FROM (SELECT * FROM ch WHERE action = 'add') c LEFT JOIN kp k USING (m_id)),
    al AS (SELECT * FROM rm UNION ALL SELECT src, action, CASE WHEN s1_id = 'S1-1' THEN 'unknown entity' WHEN held THEN 'record assigned' WHEN stop THEN 'blocked' WHEN r > 1 THEN 'record assigned' ELSE 'applied' END FROM ad) SELECT src, action, outcome, count(*) AS n FROM al GROUP BY ALL""")
def overlay_counts(spark, d):
    """What becomes of each change of an overlay."""
    x = scored(spark, d)
    changes = x.where("p < 0.8 AND p >= 0.6").select("s1_id", "m_id", F.lit("remove").alias("action"), F.lit("a").alias("src")).unionByName(x.where("p >= 0.5 AND p < 0.7").select("s1_id", "m_id", F.lit("add").alias("action"), F.lit("b").alias("src")))
    entities = T.raw_s1(spark, d).where("entity_id <> 'S1-1'").select(F.col("entity_id").alias("s1_id"))
    return O.overlay_counts(decided(spark, d), entities, changes, T.raw_pool(spark, d).where("variant = 2").select(F.col("entity_id").alias("m_id")))


@query(f"WITH {_SCORED}, a AS (SELECT s1_id, m_id, nullif(country, 'India') AS country, p FROM sp) SELECT s1_id, m_id, country, p FROM a WHERE coalesce(country, '') <> 'France' UNION ALL SELECT s1_id, m_id, country, round(1 - p, 6) FROM a WHERE country = 'France'")
def country_swap(spark, d):
    """The rows of one country from another file; rows without a country stay."""
    a = scored(spark, d).select("s1_id", "m_id", F.nullif("country", F.lit("India")).alias("country"), "p")
    return O.swap_rows(a, a.withColumn("p", F.round(1 - F.col("p"), 6)), F.col("country") == "France")


@query(f"WITH {_SCORED}, {_DEC} SELECT s1_id, m_id FROM df UNION SELECT s1_id, m_id FROM sp WHERE p >= 0.5")
def merged_candidates(spark, d):
    return O.merge_candidates(decided(spark, d), scored(spark, d).where("p >= 0.5"))


@query(f"""WITH {_SCORED}, {_DEC}, pr AS (SELECT s1_id, CASE WHEN m_id LIKE '%-4' THEN 'S2-none' ELSE m_id END AS m_id FROM df UNION ALL SELECT 'S1-0', m_id FROM df WHERE m_id LIKE 'S2-1%'), j AS (SELECT a.country AS ca, b.country AS cb FROM pr LEFT JOIN s1 a ON a.entity_id = s1_id LEFT JOIN pool b ON b.entity_id = m_id) SELECT 'unknown record' AS rule, count(CASE WHEN cb IS NULL THEN 1 END) AS n FROM j UNION ALL SELECT 'pair across countries', count(CASE WHEN ca <> cb THEN 1 END) FROM j""")
def country_check(spark, d):
    """Records that do not exist and pairs across countries."""
    dec = decided(spark, d)
    broken = dec.withColumn("m_id", F.when(F.col("m_id").endswith("-4"), "S2-none").otherwise(F.col("m_id"))).unionByName(dec.where(F.col("m_id").startswith("S2-1")).withColumn("s1_id", F.lit("S1-0")))
    return O.country_violations(T.raw_s1(spark, d), T.raw_pool(spark, d), broken)


@query(f"WITH {_SCORED}, {_DEC}, n AS (SELECT s1_id, count(*) AS k FROM df GROUP BY 1) SELECT country, CAST(least(coalesce(n.k, 0), 8) AS BIGINT) AS k, count(*) AS entities FROM (SELECT entity_id, country FROM s1) LEFT JOIN n ON s1_id = entity_id GROUP BY ALL")
def match_histogram(spark, d):
    """How many S1 of a country have how many records."""
    return O.match_histogram(T.raw_s1(spark, d), decided(spark, d))


@query(f"""WITH {_SCORED}, {_NUM_REL}, {_DEC}, b AS (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM nr) SELECT s1_id, m_id FROM b ANTI JOIN (SELECT s1_id, m_id FROM df WHERE m_id NOT LIKE '%-2') USING (s1_id, m_id) WHERE r = 1 AND country = 'US' AND num_rel IN ('shift_pure', 'shift_ms_only') AND p >= 0.6 AND NOT m_id LIKE 'S2-6%'""")
def restored_shifts(spark, d):
    """Sure pairs of one country that the rule on shifted numbers took out."""
    x = related(spark, d).select("s1_id", "m_id", "p", "country", F.col("num_rel").alias("grp"), F.col("m_id").startswith("S2-6").alias("decoy_word"))
    return O.restore_shifts(decided(spark, d).where(~F.col("m_id").endswith("-2")), x, country="US", least=0.6)


@query(f"""WITH {_SCORED}, {_DEC}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM sp) WHERE r = 1), a AS (SELECT s1_id, m_id, p, country FROM b WHERE y = 1 AND m_id NOT IN (SELECT m_id FROM df WHERE m_id LIKE 'S2%') AND p >= CASE WHEN country = 'US' THEN 0.9 ELSE 0.5 END AND p >= 0.6), n AS (SELECT country, count(*) AS n FROM a GROUP BY 1), e AS (SELECT country, count(*) AS e FROM s1 GROUP BY 1)
    SELECT country, coalesce(n, 0) AS n, round(coalesce(n, 0) * 1000.0 / e, 6) AS per_1000, round(coalesce(n, 0) * 1000.0 / e / 300, 6) AS ratio, coalesce(n, 0) * 1000.0 / e / 300 > 2 AS flagged FROM e LEFT JOIN n USING (country)""")
def accepted_density(spark, d):
    """New pairs that pass the gate, and their density by country against a reference."""
    x = scored(spark, d).select("s1_id", "m_id", "y", "p", "country")
    new = O.accept_new(x, x.where("y = 1"), decided(spark, d).where(F.col("m_id").startswith("S2")), F.when(F.col("country") == "US", 0.9).otherwise(0.5), 0.6)
    return rounded(O.density_gate(new, T.raw_s1(spark, d), 300.0), "per_1000", "ratio")


@query("WITH t AS (SELECT o_orderstatus AS parsed, o_orderpriority AS alt, avg(CAST(o_totalprice > 150000 AS DOUBLE)) AS in_alt, avg(CAST(o_totalprice < 60000 AS DOUBLE)) AS in_parsed, count(*) AS alt_missed FROM orders GROUP BY ALL) SELECT parsed, alt FROM t WHERE in_alt >= 0.3 AND in_alt > 1.5 * in_parsed AND alt_missed >= 10")
def selected_rules(spark, d):
    """Rules whose share in the other state is large enough."""
    from kinweave.sources.tables import table

    share = lambda c: F.avg(c.cast("double"))
    t = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("parsed"), F.col("o_orderpriority").alias("alt")).agg(share(F.col("o_totalprice") > 150000).alias("in_alt"), share(F.col("o_totalprice") < 60000).alias("in_parsed"), F.count("*").alias("alt_missed"))
    return O.select_rules(t, share=0.3, missed=10, ratio=1.5)


@query(f"""WITH {_SCORED}, {_NEW}, {_DEC}, r AS (SELECT *, coalesce(p_new, 0.0) AS pn FROM sn), q AS (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY pn DESC, s1_id) AS i FROM r) SELECT s1_id, m_id, 'remove' AS action FROM q SEMI JOIN df USING (s1_id, m_id) WHERE p >= 0.7 AND pn < 0.72 UNION ALL SELECT s1_id, m_id, 'add' FROM q WHERE p < 0.7 AND pn >= 0.72 AND i = 1 AND m_id NOT IN (SELECT m_id FROM df) AND NOT (country = 'India' AND m_id LIKE 'S3%')""")
def score_flips(spark, d):
    """What a new score adds to a file and takes from it."""
    x = rescored(spark, d).withColumn("p_old", F.col("p")).withColumn("p_new", F.coalesce("p_new", F.lit(0.0)))
    blocked = x.where((F.col("country") == "India") & F.col("m_id").startswith("S3"))
    return O.flips(decided(spark, d), x, 0.7, 0.72, blocked)


@query(f"""WITH {_SCORED}, u AS (SELECT s1_id, m_id, p, y FROM sp WHERE country <> 'US') SELECT CAST(threshold AS DOUBLE) AS threshold, count(u.m_id) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS hits, round(CASE WHEN count(u.m_id) > 0 THEN sum(y) / count(u.m_id) END, 9) AS precision FROM (SELECT unnest([0.3, 0.6, 0.9]) AS threshold) LEFT JOIN u ON p >= threshold GROUP BY threshold""")
def pipeline_union(spark, d):
    """Pairs that another run alone scored, at each threshold."""
    x = scored(spark, d).select("s1_id", "m_id", "p", "y", "country")
    return rounded(O.pipeline_union(x.where("country = 'US'"), x.drop("y"), x.where("y = 1"), [0.3, 0.6, 0.9]), "precision", digits=9)


@query(f"WITH {_SCORED}, {_DEC} SELECT s1_id, m_id, p FROM sp ANTI JOIN df USING (s1_id, m_id) WHERE p >= 0.5")
def unscored_pairs(spark, d):
    """Pairs that a list of done ones does not hold."""
    return O.unscored(scored(spark, d), decided(spark, d), least=0.5).select("s1_id", "m_id", "p")
