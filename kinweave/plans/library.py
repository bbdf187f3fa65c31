"""The registered queries over the driver tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import kernels as K
from kinweave.functions import text as X
from kinweave.operators import blocking as B
from kinweave.operators import context as C
from kinweave.operators import decide as D
from kinweave.operators import decoy as J
from kinweave.operators import learn as L
from kinweave.operators import overlay as O
from kinweave.operators import pairs as P
from kinweave.plans import records as T
from kinweave.plans.registry import CLEAN_SQL, ORACLE_SQL, QUERIES, big, query, rounded  # noqa: F401
from kinweave.sources import files as S
from kinweave.sources.tables import table
from kinweave.staging import stage
from kinweave.streaming import events as E

#: Scored pairs from lineitem: suppliers as entities, parts as records, the largest quantity as score.
PAIRS_SQL = "p AS (SELECT l_suppkey AS s1_id, l_partkey AS m_id, max(l_quantity) / 51.0 AS p, CAST(max(l_discount) > 0.06 AS INTEGER) AS y, min(l_returnflag) AS grp FROM lineitem GROUP BY 1, 2)"

def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s1_id"), F.col("l_partkey").alias("m_id")).agg(
        (F.max("l_quantity") / 51.0).alias("p"), (F.max("l_discount") > 0.06).cast("int").alias("y"), F.min("l_returnflag").alias("grp")
    )


# text

@query(f"SELECT doc_id, {CLEAN_SQL.format('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query(f"""SELECT p_partkey, replace(replace(replace(' ' || replace({CLEAN_SQL.format('p_name')}, ' ', '  ') || ' ', ' and ', ''), ' the ', ''), ' ', '') AS concat_key,
    CASE WHEN len(w) >= 2 THEN array_to_string(list_transform(w, lambda t: t[1]), '') ELSE '' END AS acronym
    FROM (SELECT *, list_filter(string_split({CLEAN_SQL.format('p_name')}, ' '), lambda t: t NOT IN ('and', 'the', 'of', '')) AS w FROM part)""")
def name_keys(spark, d):
    c = X.clean(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.concat_key(c).alias("concat_key"), X.acronym(c).alias("acronym"))


@query(r"SELECT page_id, replace(regexp_extract(regexp_extract(lower(coalesce(url, '')), '^[a-z]+://([^/]+)', 1), '^(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9\-]{2,})\.(?:com|net|org|co\.in|in|co|biz|fr|io|info|us)/?$', 1), '-', ' ') AS words, words <> '' AS is_domain FROM pages")
def domain_key(spark, d):
    """The names that the hosts of pages hold, and whether they hold one."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), "^[a-z]+://([^/]+)", 1)
    return table(spark, d, "pages").select("page_id", X.domain_words(host).alias("words"), X.is_domain(host).alias("is_domain"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: len(x) <= 7), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)))), ' ') AS nums,
    array_to_string(list_sort(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: len(x) <= 7), lambda x: CAST(x AS INTEGER))), ' ') AS multiset FROM documents""")
def number_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.numbers(F.col("text")), " ").alias("nums"), F.array_join(X.number_multiset(F.col("text")).cast("array<string>"), " ").alias("multiset"))


@query(f"SELECT page_id, array_to_string(list_sort(list_filter(list_transform(string_split({CLEAN_SQL.format('url')}, ' '), lambda t: ltrim(t, '0')), lambda t: t <> '')), ' ') AS key FROM pages")
def order_free_key(spark, d):
    return table(spark, d, "pages").select("page_id", X.order_free(X.clean(F.col("url"))).alias("key"))


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split({CLEAN_SQL.format('text')}, ' ')) AS word, lang FROM documents), s AS (SELECT word, lang, count(*) AS n FROM w WHERE lang IS NOT NULL AND word <> '' GROUP BY ALL),
    g AS (SELECT word, CAST(sum(n) AS BIGINT) AS total, max(n) AS top, arg_max(lang, (n, lang)) AS says FROM s GROUP BY word) SELECT word, says, total FROM g WHERE total >= 20 AND top >= total * 0.97""")
def word_to_lang(spark, d):
    """The words that point to one language: the table behind the inference of a missing part."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    seen = docs.select("lang", F.explode(F.array_distinct(X.tokens(X.clean(F.col("text"))))).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n"))
    g = seen.groupBy("word").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.max_by("lang", F.struct("n", "lang")).alias("says"))
    return g.where((F.col("total") >= 20) & (F.col("top") >= F.col("total") * 0.97)).select("word", "says", "total")


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split({CLEAN_SQL.format('text')}, ' ')) AS word, lang FROM documents), s AS (SELECT word, lang, count(*) AS n FROM w WHERE lang IS NOT NULL AND lang <> '' AND word <> '' GROUP BY ALL),
    g AS (SELECT word, sum(n) AS total, max(n) AS top, arg_max(lang, (n, lang)) AS says FROM s GROUP BY word HAVING total >= 20 AND top >= total * 0.97), v AS (SELECT doc_id AS id, says, count(*) AS n FROM w JOIN g USING (word) WHERE lang IS NULL OR lang = '' GROUP BY ALL)
    SELECT id, arg_max(says, (n, says)) AS inferred FROM v GROUP BY id HAVING max(n) >= sum(n) * 0.8""")
def inferred_lang(spark, d):
    """Languages inferred for documents that have none; learned from the others."""
    docs = table(spark, d, "documents")
    return B.infer_part(docs, "doc_id", X.tokens(X.clean(F.col("text"))), "lang")


# candidates

_TOK = lambda t, i, x: f"SELECT {i} AS id, unnest(string_split({CLEAN_SQL.format(x)}, ' ')) AS gram FROM {t}"
_TFIDF = f"""WITH ga AS (SELECT id, gram, count(*) AS tf FROM ({_TOK('benchmark', 'item_id', 'text')}) WHERE gram <> '' GROUP BY ALL), gb AS (SELECT id, gram, count(*) AS tf FROM ({_TOK('documents', 'doc_id', 'text')}) WHERE gram <> '' GROUP BY ALL),
    n AS (SELECT (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM documents) AS n), i AS (SELECT gram, df, n, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT gram, count(*) AS df FROM (SELECT gram FROM ga UNION ALL SELECT gram FROM gb) GROUP BY gram), n WHERE df >= 2),
    ra AS (SELECT id, gram, (1 + ln(tf)) * idf AS w, df <= n * 0.02 AS rare FROM ga JOIN i USING (gram)), rb AS (SELECT id, gram, (1 + ln(tf)) * idf AS w, df <= n * 0.02 AS rare FROM gb JOIN i USING (gram)),
    pa AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM ra WHERE rare), pb AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM rb WHERE rare),
    wa AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM ra), wb AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM rb),
    sc AS (SELECT pa.id AS s1_id, pb.id AS m_id, round(sum(pa.w * pb.w), 6) AS cos FROM pa JOIN pb USING (gram) GROUP BY ALL), fo AS (SELECT s1_id, m_id, 1 AS bit FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY cos DESC, m_id) AS r FROM sc WHERE cos > 0) WHERE r <= 15), ba AS (SELECT s1_id, m_id, 32 AS bit FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY cos DESC, s1_id) AS r FROM sc WHERE cos > 0) WHERE r <= 3),
    fd AS (SELECT s1_id, m_id, bit_or(bit) AS via FROM (SELECT * FROM fo UNION ALL SELECT * FROM ba) GROUP BY ALL), c AS (SELECT s1_id, m_id, via, round(sum(wa.w * wb.w), 6) AS cos FROM fd JOIN wa ON wa.id = s1_id JOIN wb ON wb.id = m_id AND wb.gram = wa.gram GROUP BY ALL)"""


def benchmark_vectors(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """TF-IDF word vectors of benchmark items (s1) and documents (pool): without common words for the search, and whole."""
    a, b = table(spark, d, "benchmark"), table(spark, d, "documents")
    ga, gb = B.grams(a, "item_id", X.tokens(X.clean(F.col("text")))), B.grams(b, "doc_id", X.tokens(X.clean(F.col("text"))))
    n = a.count() + b.count()
    return [tuple(B.weights(g, B.idf(ga.unionByName(gb), n, max_share=share)) for g in (ga, gb)) for share in (0.02, 1.0)]


def benchmark_candidates(spark: SparkSession, d: str) -> DataFrame:
    """s1_id, m_id, via, cos: found in both directions on the vectors without common words, scored on the whole ones."""
    searched, whole = benchmark_vectors(spark, d)
    c, _ = stage(rounded(B.cosines(*searched), "cos"), "searched")
    found = B.union_paths([(B.top_k(c, "s1_id", "m_id", 15), B.BITS["name"]), (B.top_k(c, "m_id", "s1_id", 3), B.BITS["rev"])]).drop("cos")
    return rounded(B.rescore(found, *whole), "cos")


@query(_TFIDF + " SELECT s1_id, m_id, cos, rank FROM (SELECT s1_id, m_id, cos, row_number() OVER (PARTITION BY s1_id ORDER BY cos DESC, m_id) AS rank FROM c WHERE via & 1 = 1 AND cos > 0) WHERE rank <= 15")
def tfidf_top_k(spark, d):
    """Each benchmark item's 15 nearest documents by word TF-IDF."""
    found = benchmark_candidates(spark, d).where(F.col("via").bitwiseAND(F.lit(1)) == 1).drop("via")
    return big(B.top_k(found, "s1_id", "m_id", 15), "rank")


@query(_TFIDF + " SELECT s1_id, m_id, via, cos FROM c")
def via_union(spark, d):
    """Both directions of search, united by path bits."""
    return benchmark_candidates(spark, d)


@query(_TFIDF + ", o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY cos DESC, s1_id) AS r FROM c) WHERE r = 1 AND cos >= 0.3), l AS (SELECT s1_id, string_agg(CAST(m_id AS VARCHAR), ',' ORDER BY CAST(m_id AS VARCHAR)) AS x FROM o GROUP BY s1_id) SELECT item_id AS s1_id, coalesce(x, '') AS matched_entity_ids FROM benchmark LEFT JOIN l ON item_id = s1_id")
def text_linkage(spark, d):
    """From texts to match lists: vectors, search, one owner a record, a threshold, a list for every item."""
    kept = D.above(D.one_owner(benchmark_candidates(spark, d), "cos"), 0.3, p="cos")
    return S.lists_per_entity(table(spark, d, "benchmark").select(F.col("item_id").alias("s1_id")), kept.withColumn("m_id", F.col("m_id").cast("string")))


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer GROUP BY 1 HAVING count(*) <= 70), b AS (SELECT s_nationkey AS k FROM supplier GROUP BY 1 HAVING count(*) <= 5)
    SELECT c_custkey AS s1_id, s_suppkey AS m_id, c_nationkey AS k FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_nationkey IN (SELECT k FROM a) AND c_nationkey IN (SELECT k FROM b)""")
def capped_join(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("s1_id"), F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("m_id"), F.col("s_nationkey").alias("k"))
    return B.capped_equi_join(a, b, ["k"], 70, 5).select("s1_id", "m_id", "k")


@query("WITH u AS (SELECT p_name, p_brand, min(p_partkey) AS s1_id FROM part GROUP BY 1, 2 HAVING count(*) = 1) SELECT p_partkey AS m_id, s1_id, p_name FROM part JOIN u USING (p_name, p_brand)")
def unique_key(spark, d):
    parts = table(spark, d, "part")
    return B.unique_key_match(parts.select(F.col("p_partkey").alias("s1_id"), "p_name", "p_brand"), parts.select(F.col("p_partkey").alias("m_id"), "p_name", "p_brand"), ["p_name", "p_brand"]).select("m_id", "s1_id", "p_name")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM v),
    c AS (SELECT a.vec_id AS m_id, b.vec_id AS s1_id, round(list_dot_product(a.v, b.v), 12) AS cos FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT s1_id, m_id, round(cos, 5) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY cos DESC, s1_id) AS rank FROM c) WHERE rank <= 5""")
def dense_top_k(spark, d):
    """Each vector's five nearest of the same label by cosine, exactly."""
    e = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("part"), F.transform(e, lambda x: x / norm).alias("v"))
    found = B.dense_top_k(v.withColumnRenamed("vec_id", "m_id"), v.withColumnRenamed("vec_id", "s1_id"), 5)
    return big(rounded(found, "cos", digits=5), "rank")


# pair features

@query(f"""WITH t AS (SELECT DISTINCT id, gram FROM ({_TOK('documents', 'doc_id', 'text')}) WHERE gram <> '') SELECT gram, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 9) AS idf FROM t GROUP BY gram""")
def token_idf(spark, d):
    docs = table(spark, d, "documents")
    return rounded(P.token_idf(docs.select("doc_id", "text"), "doc_id", X.tokens(X.clean(F.col("text")))), "idf", digits=9)


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The distinct pairs of raw names of candidate pairs, in lower case."""
    a, b = (raw(spark, d).select(F.col("entity_id").alias(i), F.lower("business_name").alias(n)) for raw, i, n in ((T.raw_s1, "s1_id", "a"), (T.raw_pool, "m_id", "b")))
    return T.candidates(spark, d).join(a, "s1_id").join(b, "m_id").select("a", "b").distinct()


_NAME_PAIRS = f"{T.RAW_CTE}, {T.PAIRS_CTE}, q AS (SELECT DISTINCT lower(x.business_name) AS a, lower(y.business_name) AS b FROM pairs JOIN raw_s1 x ON x.entity_id = s1_id JOIN raw_pool y ON y.entity_id = m_id)"


@query(f"WITH {_NAME_PAIRS} SELECT a, b, CAST(levenshtein(a, b) AS BIGINT) AS lev, round(jaro_winkler_similarity(a, b), 9) AS jw, CAST(damerau_levenshtein(a, b) AS BIGINT) AS dam FROM q")
def edit_distances(spark, d):
    return rounded(big(name_pairs(spark, d).select("a", "b", F.levenshtein("a", "b").alias("lev"), K.winkler("a", "b").alias("jw"), K.swaps("a", "b").alias("dam")), "lev", "dam"), "jw", digits=9)


_PAIRTOK = f"ta AS (SELECT DISTINCT id, gram FROM ({_TOK('benchmark', 'item_id', 'text')}) WHERE gram <> ''), tb AS (SELECT DISTINCT id, gram FROM ({_TOK('documents', 'doc_id', 'text')}) WHERE gram <> '')"


@query(_TFIDF + f""", {_PAIRTOK}, ii AS (SELECT gram, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM tb GROUP BY gram), xa AS (SELECT id, sum(idf) AS w FROM ta JOIN ii USING (gram) GROUP BY id), xb AS (SELECT id, sum(idf) AS w FROM tb JOIN ii USING (gram) GROUP BY id),
    s AS (SELECT s1_id, m_id, sum(idf) AS hit, max(idf) AS max_idf, count(*) AS n_shared FROM fd JOIN ta ON ta.id = s1_id JOIN tb ON tb.id = m_id AND tb.gram = ta.gram JOIN ii ON ii.gram = ta.gram GROUP BY ALL)
    SELECT s1_id, m_id, round(hit / (xa.w + xb.w - hit), 6) AS idf_jaccard, round(max_idf, 6) AS max_idf, n_shared FROM s JOIN xa ON xa.id = s1_id JOIN xb ON xb.id = m_id""")
def idf_jaccard(spark, d):
    """Of the candidates that the search found."""
    a, b = table(spark, d, "benchmark"), table(spark, d, "documents")
    words = F.explode(F.array_distinct(X.tokens(X.clean(F.col("text"))))).alias("gram")
    ta, tb = a.select(F.col("item_id").alias("id"), words), b.select(F.col("doc_id").alias("id"), words)
    idf = P.token_idf(b.select("doc_id", "text"), "doc_id", X.tokens(X.clean(F.col("text"))))
    return rounded(P.idf_jaccard(benchmark_candidates(spark, d), ta, tb, idf), "idf_jaccard", "max_idf")


@query(f"""WITH gb AS (SELECT id, gram, count(*) AS tf FROM ({_TOK('documents', 'doc_id', 'text')}) WHERE gram <> '' GROUP BY ALL), ta AS (SELECT DISTINCT id, gram FROM ({_TOK('benchmark', 'item_id', 'text')}) WHERE gram <> ''), l AS (SELECT id, CAST(sum(tf) AS BIGINT) AS dl FROM gb GROUP BY id), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
    t AS (SELECT gram, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avgdl) AS avgdl, count(*) <= n * 0.1 AS rare FROM gb, s GROUP BY gram, n), f AS (SELECT DISTINCT ta.id AS q_id, gb.id AS d_id FROM ta JOIN t USING (gram) JOIN gb USING (gram) WHERE rare),
    x AS (SELECT q_id, d_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM f JOIN ta ON ta.id = q_id JOIN t USING (gram) JOIN gb ON gb.id = d_id AND gb.gram = ta.gram JOIN l ON l.id = d_id GROUP BY ALL)
    SELECT q_id, d_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, d_id) AS rank FROM x) WHERE rank <= 20""")
def bm25(spark, d):
    """The 20 best documents of each benchmark item."""
    a, b = table(spark, d, "benchmark"), table(spark, d, "documents")
    words = X.tokens(X.clean(F.col("text")))
    q = a.select(F.col("item_id").alias("id"), F.explode(F.array_distinct(words)).alias("gram"))
    docs = b.select(F.col("doc_id").alias("id"), X.clean(F.col("text")).alias("text"))
    return big(rounded(P.bm25(q, docs, 20), "score", digits=5), "rank")


@query(f"""WITH {_NAME_PAIRS.replace('lower(x.business_name) AS a, lower(y.business_name) AS b', CLEAN_SQL.format('x.business_name') + ' AS a, ' + CLEAN_SQL.format('y.business_name') + ' AS b')}, nm AS (SELECT DISTINCT a AS n FROM q UNION SELECT b FROM q), g AS (SELECT n AS id, gram, count(*) AS tf FROM (SELECT n, unnest(string_split(n, ' ')) AS gram FROM nm) GROUP BY ALL),
    i AS (SELECT gram, ln((1 + (SELECT count(*) FROM nm)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY gram), w AS (SELECT id, gram, (1 + ln(tf)) * idf AS w FROM g JOIN i USING (gram)), u AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
    b AS (SELECT q.a, q.b, x.gram, max((jaro_winkler_similarity(x.gram, y.gram), x.w * y.w)) AS t FROM q JOIN u x ON x.id = q.a JOIN u y ON y.id = q.b WHERE jaro_winkler_similarity(x.gram, y.gram) >= 0.9 GROUP BY ALL) SELECT a AS s1_id, b AS m_id, round(sum(t[1] * t[2]), 6) AS soft_tfidf FROM b GROUP BY a, b""")
def soft_tfidf(spark, d):
    """Soft TF-IDF of the names of candidate pairs."""
    a, b = (raw(spark, d).select(F.col("entity_id").alias(i), X.clean(F.col("business_name")).alias(n)) for raw, i, n in ((T.raw_s1, "e1", "s1_id"), (T.raw_pool, "e2", "m_id")))
    pairs = T.candidates(spark, d).toDF("e1", "e2", "y").join(a, "e1").join(b, "e2").select("s1_id", "m_id").distinct()
    names = pairs.select(F.col("s1_id").alias("n")).union(pairs.select("m_id")).distinct()
    g = B.grams(names, "n", X.tokens(F.col("n")))
    w = B.weights(g, B.idf(g, names.count(), min_df=1)).select("id", "gram", "w")
    return rounded(P.soft_tfidf(pairs, w, w), "soft_tfidf")


# context and decisions

@query(f"""WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS rec_rank FROM p), o AS (SELECT *, coalesce(CASE WHEN rec_rank = 1 THEN max(CASE WHEN rec_rank = 2 THEN p END) OVER (PARTITION BY m_id) ELSE max(p) OVER (PARTITION BY m_id) END, 0.0) AS rec_other FROM r)
    SELECT s1_id, m_id, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, m_id) AS s1_rank, round(max(p) OVER (PARTITION BY s1_id) - p, 6) AS s1_gap, round(sum(p) OVER (PARTITION BY s1_id), 6) AS s1_sum, count(CASE WHEN p >= 0.5 THEN 1 END) OVER (PARTITION BY s1_id) AS s1_n50, rec_rank,
    round(sum(p) OVER (PARTITION BY m_id) - p, 6) AS rec_rest, count(*) OVER (PARTITION BY m_id) AS rec_n, round(rec_other, 6) AS rec_other, round(p - rec_other, 6) AS rec_margin FROM o""")
def stage_two_context(spark, d):
    x = C.stage_two(scored_pairs(spark, d)).select("s1_id", "m_id", "s1_rank", "s1_gap", "s1_sum", "s1_n50", "rec_rank", "rec_rest", "rec_n", "rec_other", "rec_margin")
    return rounded(big(x, "s1_rank", "rec_rank"), "s1_gap", "s1_sum", "rec_rest", "rec_other", "rec_margin")


@query(f"WITH {PAIRS_SQL} SELECT s1_id, m_id, dense_rank() OVER (PARTITION BY m_id ORDER BY p DESC) AS rec_rank, round(max(p) OVER (PARTITION BY m_id) - p, 6) AS rec_gap, count(*) OVER (PARTITION BY m_id) AS rec_n, CASE WHEN y = 1 THEN dense_rank() OVER (PARTITION BY s1_id ORDER BY CASE WHEN y = 1 THEN p END DESC NULLS LAST) ELSE 99 END AS same_rank, round(CASE WHEN y = 1 THEN max(CASE WHEN y = 1 THEN p END) OVER (PARTITION BY s1_id) - p ELSE 1.0 END, 6) AS same_gap, count(CASE WHEN y = 1 THEN p END) OVER (PARTITION BY s1_id) AS same_n FROM p")
def rank_context(spark, d):
    x = C.conditional_rank(scored_pairs(spark, d).withColumns(C.side("m_id", "p", "s1_id", "rec")), "s1_id", F.col("y") == 1, "p")
    return rounded(big(x.select("s1_id", "m_id", "rec_rank", "rec_gap", "rec_n", "same_rank", "same_gap", "same_n"), "rec_rank", "same_rank"), "rec_gap", "same_gap")


@query(f"WITH {PAIRS_SQL} SELECT s1_id, m_id, p FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM p) WHERE r = 1 AND p >= CASE grp WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.7 ELSE 0.8 END")
def one_owner_threshold(spark, d):
    return D.above(D.one_owner(scored_pairs(spark, d)), {"A": 0.6, "N": 0.7, "R": 0.8}, by="grp").select("s1_id", "m_id", "p")


@query(f"""WITH {PAIRS_SQL}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS r FROM p) WHERE r = 1), x AS (SELECT s1_id, m_id, p, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS c, sum(p) OVER (PARTITION BY s1_id) AS t, exp(sum(ln(greatest(1 - p, 1e-12))) OVER (PARTITION BY s1_id) - 0.5) AS e FROM o WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, m_id)),
    f AS (SELECT *, 1.25 * c / (k + 0.25 * (t + 0.5)) AS f FROM x), b AS (SELECT *, max(f) OVER (PARTITION BY s1_id) AS best FROM f), s AS (SELECT *, min(CASE WHEN f = best THEN k END) OVER (PARTITION BY s1_id) AS stop FROM b) SELECT s1_id, m_id, p FROM s WHERE best > e AND k <= stop""")
def expected_f_sets(spark, d):
    return D.expected_f(D.one_owner(scored_pairs(spark, d)), misses=0.5).select("s1_id", "m_id", "p")


@query()
def expected_f_exact(spark, d):
    """The same sets by the exact law, of suppliers' best pairs."""
    return D.expected_f_exact(D.one_owner(scored_pairs(spark, d)), misses=0.5)


@query(f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, m_id) AS k FROM p) SELECT s1_id, count(*) AS n, max(p) AS p1, coalesce(max(CASE WHEN k = 2 THEN p END), 0.0) AS p2, round(sum(p), 6) AS total, round(avg(p), 6) AS mean, count(CASE WHEN p >= 0.5 THEN 1 END) AS n50, count(CASE WHEN p >= 0.9 THEN 1 END) AS n90 FROM r GROUP BY s1_id")
def entity_table(spark, d):
    return rounded(D.entity_table(scored_pairs(spark, d)), "total", "mean")


_DECIDED = PAIRS_SQL + ", pred AS (SELECT s1_id, m_id FROM p WHERE p >= 0.7), truth AS (SELECT s1_id, m_id FROM p WHERE y = 1), ent AS (SELECT s_suppkey AS s1_id FROM supplier)"


@query(f"""WITH {_DECIDED}, a AS (SELECT s1_id, count(*) AS n_pred FROM pred GROUP BY 1), b AS (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY 1), h AS (SELECT s1_id, count(*) AS hits FROM pred JOIN truth USING (s1_id, m_id) GROUP BY 1),
    x AS (SELECT s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(hits, 0) AS hits FROM ent LEFT JOIN a USING (s1_id) LEFT JOIN b USING (s1_id) LEFT JOIN h USING (s1_id)) SELECT *, round(CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN hits = 0 THEN 0.0 ELSE 1.25 * hits / (n_pred + 0.25 * n_true) END, 9) AS f05 FROM x""")
def entity_f05(spark, d):
    p = scored_pairs(spark, d)
    return rounded(D.entity_f05(table(spark, d, "supplier").select(F.col("s_suppkey").alias("s1_id")), p.where("p >= 0.7"), p.where("y = 1")), "f05", digits=9)


@query(f"WITH {PAIRS_SQL}, g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(p) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS hits, round(CASE WHEN count(p) > 0 THEN sum(y) / count(p) END, 9) AS precision, round(coalesce(sum(y), 0) / (SELECT sum(y) FROM p), 9) AS recall FROM g LEFT JOIN p ON p >= threshold GROUP BY threshold")
def threshold_sweep(spark, d):
    return rounded(D.threshold_sweep(scored_pairs(spark, d), [0.1, 0.3, 0.5, 0.7, 0.9]), "precision", "recall", digits=9)


@query()
def monte_carlo_f(spark, d):
    """Expected F0.5 of the one-owner pairs from 0.7 up; the true pairs are drawn among all scored pairs."""
    p = scored_pairs(spark, d)
    best = D.one_owner(p).where("p >= 0.7").select("s1_id", "m_id", F.lit(True).alias("predicted"))
    return rounded(D.monte_carlo_f(p.join(best, ["s1_id", "m_id"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(False))), 0.3), "f05")


@query()
def bootstrap_gain(spark, d):
    p = scored_pairs(spark, d)
    return rounded(D.bootstrap_gain(p.groupBy("s1_id").agg((F.avg("y") - F.avg("p")).alias("gain"))), "mean", "low", "high")


@query(f"""WITH {PAIRS_SQL} SELECT s1_id, m_id, round(p * 1.7 / (p * 1.7 + 1 - p), 6) AS shifted, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS logit, CAST(p >= 0.2 AS BIGINT) + CAST(p >= 0.5 AS BIGINT) + CAST(p >= 0.8 AS BIGINT) AS band FROM p""")
def prior_odds(spark, d):
    """Scores shifted to another prior, their logits and bands."""
    return rounded(big(scored_pairs(spark, d).select("s1_id", "m_id", X.shift_prior(F.col("p"), 1.7).alias("shifted"), X.logit(F.col("p")).alias("logit"), X.band(F.col("p"), [0.2, 0.5, 0.8]).alias("band")), "band"), "shifted", "logit")


@query()
def prior_shift(spark, d):
    """The share of matches that expectation-maximisation finds, and the scores shifted to it."""
    p = scored_pairs(spark, d)
    prior = D.saerens(p, 0.6)
    return rounded(p.select("s1_id", "m_id", X.shift_prior(F.col("p"), prior / 0.6 / ((1 - prior) / 0.4)).alias("shifted"), F.lit(prior).alias("prior")), "shifted", "prior")


# collective evidence and decoys

@query(f"WITH {PAIRS_SQL}, a AS (SELECT s1_id, m_id, p AS pa FROM p WHERE p >= 0.5), b AS (SELECT s1_id, m_id, y * 0.9 AS pb FROM p WHERE y = 1) SELECT s1_id, m_id, round(coalesce(pa, 0.0) * 0.7 + coalesce(pb, 0.0) * 0.3, 9) AS p FROM a FULL JOIN b USING (s1_id, m_id)")
def blended(spark, d):
    p = scored_pairs(spark, d)
    return rounded(C.blend(p.where("p >= 0.5"), p.where("y = 1").withColumn("p", F.col("y") * 0.9), 0.7), "p", digits=9)


_SIM = "len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))"


@query(f"""WITH {PAIRS_SQL}, x AS (SELECT s1_id, m_id, p, substr(CAST(m_id AS VARCHAR), 1, 2) AS src, p_name, list_distinct(string_split(p_name, ' ')) AS w FROM p JOIN part ON p_partkey = m_id), v AS (SELECT s1_id, p_name, any_value(w) AS w FROM x GROUP BY ALL),
    k AS (SELECT a.s1_id, a.p_name AS na, b.p_name AS nb, {_SIM} AS sim FROM v a JOIN v b USING (s1_id)), g AS (SELECT a.s1_id, a.m_id, count(*) AS sib_n, max(sim) AS sib_best, max(sim * b.p) AS sib_weighted, count(CASE WHEN a.src = b.src THEN 1 END) AS sib_same FROM x a JOIN x b ON a.s1_id = b.s1_id AND a.m_id <> b.m_id AND b.p >= 0.5 JOIN k ON k.s1_id = a.s1_id AND na = a.p_name AND nb = b.p_name GROUP BY ALL),
    h AS (SELECT a.s1_id, a.m_id, count(*) AS n, sum(sim * b.p) AS kp, max(sim) AS mx, avg(sim) AS mn, count(CASE WHEN sim < 0.5 THEN 1 END) AS con FROM x a JOIN x b ON a.s1_id = b.s1_id AND a.m_id <> b.m_id AND b.p >= 0.9 JOIN k ON k.s1_id = a.s1_id AND na = a.p_name AND nb = b.p_name GROUP BY ALL)
    SELECT x.s1_id, CAST(x.m_id AS VARCHAR) AS m_id, x.p, coalesce(sib_n, 0) AS sib_n, round(coalesce(sib_best, -1.0), 6) AS sib_best, round(coalesce(sib_weighted, -1.0), 6) AS sib_weighted, coalesce(sib_same, 0) AS sib_same_source, round(coalesce(kp / (n + 1), 0.0), 6) AS support, round(coalesce(mx, 0.0), 6) AS support_max, round(coalesce(mn, 0.0), 6) AS support_mean, coalesce(con, 0) AS contradictions FROM x LEFT JOIN g USING (s1_id, m_id) LEFT JOIN h USING (s1_id, m_id)""")
def sibling_support(spark, d):
    """Sibling and peer features of parts that one supplier delivers, by their names."""
    pairs = scored_pairs(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("m_id"), F.col("p_name").alias("name")), "m_id").withColumn("m_id", F.col("m_id").cast("string"))
    same = lambda a, b: X.jaccard(X.tokens(F.col(a)), X.tokens(F.col(b)))
    found = C.peer_support(C.siblings(pairs, same), same).select("s1_id", "m_id", "p", "sib_n", "sib_best", "sib_weighted", "sib_same_source", "support", "support_max", "support_mean", "contradictions")
    return rounded(big(found, "sib_n", "sib_same_source", "contradictions"), "sib_best", "sib_weighted", "support", "support_max", "support_mean")


@query("""WITH n AS (SELECT s1_id, m_id, string_agg(CAST(q AS VARCHAR), ' ' ORDER BY q) AS x FROM (SELECT DISTINCT l_orderkey AS s1_id, l_linenumber AS m_id, CAST(l_quantity AS INTEGER) AS q FROM lineitem) GROUP BY ALL), t AS (SELECT s1_id, m_id, list_transform(string_split(x, ' '), lambda v: CAST(v AS INTEGER)) AS nums, [25] AS base FROM n),
    e AS (SELECT *, list_filter(nums, lambda v: NOT list_contains(base, v)) AS fresh FROM t), c AS (SELECT DISTINCT a.s1_id, a.m_id FROM e a JOIN e b ON a.s1_id = b.s1_id AND a.m_id <> b.m_id WHERE len(a.fresh) > 0 AND list_has_all(b.nums, a.fresh)) SELECT e.s1_id, e.m_id, CASE WHEN len(fresh) = 0 THEN 'none' WHEN c.s1_id IS NOT NULL THEN 'corr' ELSE 'lone' END AS support FROM e LEFT JOIN c ON e.s1_id = c.s1_id AND e.m_id = c.m_id""")
def support_class(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("s1_id"), F.col("l_linenumber").alias("m_id"), F.col("l_quantity").cast("int").alias("q"))
    x = li.groupBy("s1_id", "m_id").agg(F.collect_set("q").alias("nums")).withColumn("s1_nums", F.array(F.lit(25)))
    return C.support_class(x).select("s1_id", "m_id", "support")


@query(f"""WITH {PAIRS_SQL}, v AS (SELECT grp, y, count(*) AS valid FROM p WHERE p < 0.5 GROUP BY ALL), t AS (SELECT grp, y, count(*) AS test FROM p WHERE p >= 0.5 GROUP BY ALL), c AS (SELECT grp, y, coalesce(valid, 0) AS valid, coalesce(test, 0) AS test FROM v FULL JOIN t USING (grp, y))
    SELECT *, round(valid * 1000.0 / 100, 6) AS d_valid, round(test * 1000.0 / 90, 6) AS d_test, round(CASE WHEN valid > 0 THEN (test * 1000.0 / 90) / (valid * 1000.0 / 100) END, 6) AS rho FROM c""")
def density_cells(spark, d):
    p = scored_pairs(spark, d)
    return rounded(J.density(p.where("p < 0.5"), p.where("p >= 0.5"), ["grp", "y"], 100, 90), "d_valid", "d_test", "rho")


@query(f"""WITH {PAIRS_SQL}, v AS (SELECT grp, count(*) AS valid FROM p WHERE p < 0.5 GROUP BY 1), t AS (SELECT grp, count(*) AS test FROM p WHERE p >= 0.5 GROUP BY 1), l AS (SELECT grp, (sum(y) + 0.5) / (count(*) + 1) AS pr FROM p GROUP BY 1), c AS (SELECT grp, coalesce(valid, 0) AS valid, coalesce(test, 0) AS test FROM v FULL JOIN t USING (grp)),
    r AS (SELECT grp, CASE WHEN valid >= 15 AND test >= 15 THEN greatest((test * 1000.0 / 90) / (valid * 1000.0 / 100), 1.0) ELSE 1.0 END AS ratio, pr FROM c LEFT JOIN l USING (grp)) SELECT grp, round(ratio, 6) AS ratio, round(pr, 6) AS precision, round(pr / ratio, 6) AS q FROM r""")
def invariance_cells(spark, d):
    p = scored_pairs(spark, d)
    cells = J.density(p.where("p < 0.5"), p.where("p >= 0.5"), ["grp"], 100, 90)
    return rounded(J.invariance(p, cells, ["grp"]), "ratio", "precision", "q")


@query("WITH c AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL), a AS (SELECT c_nationkey, count(*) AS rows, avg(n) AS mean, " + ", ".join(f"count(CASE WHEN least(n, 6) = {k} THEN 1 END) AS n{k}" for k in range(7)) + " FROM c GROUP BY 1 HAVING count(*) >= 3) SELECT c_nationkey, rows, round(mean, 6) AS mean, round(mean - (SELECT median(mean) FROM a), 6) AS gap, n0, n1, n2, n3, n4, n5, n6 FROM a")
def health_scan(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_nationkey").agg(F.count("o_orderkey").alias("n"))
    return rounded(J.health_scan(c, "c_nationkey", 3).drop("median"), "mean", "gap")


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT s1_id, count(*) AS n FROM p GROUP BY 1), u AS (SELECT n, count(*) AS k FROM c GROUP BY 1), l AS (SELECT u.n, (coalesce(f.k, 0) + 0.5) / (u.k + 0.5) AS lr FROM u LEFT JOIN u f ON f.n = u.n + 1) SELECT s1_id, m_id, round(lr / sum(lr) OVER (PARTITION BY m_id), 9) AS q FROM p JOIN c USING (s1_id) JOIN l USING (n)""")
def count_tie_breaker(spark, d):
    """Weights of a record's rival entities by how usual one more record is for each."""
    p = scored_pairs(spark, d)
    return rounded(J.count_prior(p, p.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id").select("s1_id", "m_id", "q"), "q", digits=9)


@query(f"WITH {_DECIDED}, r AS (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY p DESC, s1_id) AS k FROM p) SELECT s1_id, m_id, 'false' AS kind FROM pred ANTI JOIN truth USING (s1_id, m_id) UNION ALL SELECT s1_id, m_id, CASE WHEN k > 1 THEN 'outranked' ELSE 'below' END FROM r WHERE y = 1 AND p < 0.7")
def mistakes(spark, d):
    p = scored_pairs(spark, d)
    return J.mistakes(p, p.where("p >= 0.7"), p.where("y = 1"))


# overlays

@query(f"WITH {_DECIDED}, one AS (SELECT min(s1_id) AS s1_id, m_id FROM pred GROUP BY m_id), kept AS (SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.s1_id = one.s1_id AND p.m_id = one.m_id AND p < 0.75)), new AS (SELECT min(s1_id) AS s1_id, m_id FROM p WHERE p >= 0.5 AND p < 0.7 AND m_id NOT IN (SELECT m_id FROM kept) GROUP BY m_id) SELECT * FROM kept UNION ALL SELECT * FROM new")
def overlay_apply(spark, d):
    """Removals of a score band, then additions of free records."""
    p = scored_pairs(spark, d)
    one = p.where("p >= 0.7").groupBy("m_id").agg(F.min("s1_id").alias("s1_id")).select("s1_id", "m_id")
    changes = p.where("p < 0.75").select("s1_id", "m_id", F.lit("remove").alias("action")).unionByName(p.where("p >= 0.5 AND p < 0.7").select("s1_id", "m_id", F.lit("add").alias("action")))
    return O.overlay(one, changes)


@query(f"WITH {_DECIDED} SELECT 'pair repeated' AS rule, 0::BIGINT AS n UNION ALL SELECT 'record with two owners', count(*) FROM (SELECT m_id FROM pred GROUP BY m_id HAVING count(DISTINCT s1_id) > 1) UNION ALL SELECT 'not a candidate', count(*) FROM pred ANTI JOIN (SELECT * FROM p WHERE p >= 0.8) c USING (s1_id, m_id) UNION ALL SELECT 'unknown entity', 0 UNION ALL SELECT 'wrong prefix', count(*) FROM pred WHERE substr(CAST(m_id AS VARCHAR), 1, 2) NOT IN ('S2', 'S3') UNION ALL SELECT 'entity repeated', 0")
def integrity_check(spark, d):
    p = scored_pairs(spark, d)
    return O.violations(table(spark, d, "supplier").select(F.col("s_suppkey").alias("s1_id")), p.where("p >= 0.7").select("s1_id", "m_id"), p.where("p >= 0.8"))


@query(f"WITH {_DECIDED} SELECT s1_id, m_id, 'remove' AS action FROM truth ANTI JOIN pred USING (s1_id, m_id) UNION ALL SELECT s1_id, m_id, 'add' FROM pred ANTI JOIN truth USING (s1_id, m_id)")
def pair_changes(spark, d):
    p = scored_pairs(spark, d)
    return O.changes(p.where("y = 1"), p.where("p >= 0.7"))


@query(f"WITH {_DECIDED} SELECT s1_id, coalesce(string_agg(CAST(m_id AS VARCHAR), ',' ORDER BY CAST(m_id AS VARCHAR)), '') AS matched_entity_ids FROM ent LEFT JOIN pred USING (s1_id) GROUP BY s1_id")
def list_sink(spark, d):
    p = scored_pairs(spark, d).where("p >= 0.7").select("s1_id", F.col("m_id").cast("string").alias("m_id"))
    return S.lists_per_entity(table(spark, d, "supplier").select(F.col("s_suppkey").alias("s1_id")), p)


@query(f"WITH {_DECIDED} SELECT s1_id, CAST(m_id AS VARCHAR) AS m_id FROM pred")
def list_round_trip(spark, d):
    """Pairs from the lists that they were joined to."""
    return S.read_pairs(list_sink(spark, d))


# relational primitives

@query("SELECT n_name, count(c_custkey) AS customers, count(DISTINCT c_mktsegment) AS segments, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(max(c_acctbal), 6) AS top, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS negative FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def right_join_aggregates(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return rounded(c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "right").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.countDistinct("c_mktsegment").alias("segments"), F.percentile("c_acctbal", 0.25).alias("q25"), F.max("c_acctbal").alias("top"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("negative")), "q25", "top")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")
def semi_anti_union(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("buys", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("buys", F.lit(False)))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top_two_per_group(spark, d):
    return big(B.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", 2, "o_totalprice", float("-inf")), "rank")


@query("SELECT l_shipmode_n AS n, count(*) AS orders FROM (SELECT l_orderkey, least(count(*), 6) AS l_shipmode_n FROM lineitem GROUP BY 1) GROUP BY 1")
def capped_histogram(spark, d):
    return C.frequency(C.frequency(table(spark, d, "lineitem"), ["l_orderkey"], "n", 6), ["n"], "orders").select("n", "orders")


@query(f"WITH {_NAME_PAIRS} SELECT word, meaning, n FROM (SELECT word, arg_max(other, (n, other)) AS meaning, max(n) AS n, sum(n) AS total FROM (SELECT word, other, count(*) AS n FROM (SELECT unnest(string_split(a, ' ')) AS word, unnest(string_split(b, ' ')) AS other FROM q WHERE len(string_split(a, ' ')) = len(string_split(b, ' '))) GROUP BY ALL) GROUP BY word) WHERE n >= 2 AND n >= total * 0.1")
def translation_table(spark, d):
    """The usual counterpart of each word in the names paired by place."""
    return L.translation_table(name_pairs(spark, d), F.split("a", " "), F.split("b", " "), share=0.1)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return rounded(E.windowed(table(spark, d, "events")), "total", digits=4)


# models

@query()
def stacked_scores(spark, d):
    """Out-of-fold scores of boosted trees, by entity, with their context."""
    p = scored_pairs(spark, d)
    x = C.stage_two(p).select("s1_id", "m_id", "y", "p", "s1_gap", "rec_n", "rec_margin").withColumnRenamed("p", "p0")
    done, _ = L.out_of_fold(x, ["p0", "s1_gap", "rec_n", "rec_margin"], fit=lambda df, f: L.fit_trees(df, f, rounds=5, depth=3))
    return L.quality(done.select("p", "y"))


@query()
def synthetic_decoys(spark, d):
    return L.positions_shifted(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("size")), "size", "p_partkey")


# the modules below register their queries here
from kinweave.plans import decoys, features, linkage, sources  # noqa: E402, F401
