"""Features of a scored pair in the light of the other pairs of its two ends, and collective evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side(key: str, score: str, tie: str, prefix: str) -> dict[str, Column]:
    """Dense rank, gap to the best and count of a pair's score among the pairs of one end."""
    w = Window.partitionBy(key)
    return {f"{prefix}_rank": F.dense_rank().over(w.orderBy(F.desc(score))), f"{prefix}_gap": F.max(score).over(w) - F.col(score), f"{prefix}_n": F.count("*").over(w)}


def stage_two(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Ten columns for stacking: rank, gap, sum and counts by s1; rank, rest, count, best other and margin by record."""
    s1, m = Window.partitionBy("s1_id"), Window.partitionBy("m_id")
    ranked = pairs.withColumn("rec_rank", F.row_number().over(m.orderBy(F.desc(p), "s1_id")))
    second = F.max(F.when(F.col("rec_rank") == 2, F.col(p))).over(m)
    other = F.coalesce(F.when(F.col("rec_rank") == 1, second).otherwise(F.max(p).over(m)), F.lit(0.0))
    return ranked.select(
        *pairs.columns, F.row_number().over(s1.orderBy(F.desc(p), "m_id")).alias("s1_rank"), (F.max(p).over(s1) - F.col(p)).alias("s1_gap"), F.sum(p).over(s1).alias("s1_sum"),
        F.count(F.when(F.col(p) >= 0.5, 1)).over(s1).alias("s1_n50"), F.count(F.when(F.col(p) >= 0.2, 1)).over(s1).alias("s1_n20"),
        "rec_rank", (F.sum(p).over(m) - F.col(p)).alias("rec_rest"), F.count("*").over(m).alias("rec_n"), other.alias("rec_other"), (F.col(p) - other).alias("rec_margin"),
    )


def conditional_rank(pairs: DataFrame, key: str, condition: Column, score: str) -> DataFrame:
    """Rank, gap and count among the pairs of `key` for which the condition holds; others get 99, 1.0 and the count."""
    held = F.when(condition, F.col(score))
    w = Window.partitionBy(key)
    rank = F.when(condition, F.dense_rank().over(w.orderBy(F.desc_nulls_last(held)))).otherwise(99)
    return pairs.withColumns({"same_rank": rank, "same_gap": F.when(condition, F.max(held).over(w) - F.col(score)).otherwise(1.0), "same_n": F.count(held).over(w)})


def frequency(table: DataFrame, keys: list[str], out: str, cap: int | None = None) -> DataFrame:
    n = F.count("*")
    return table.groupBy(*keys).agg((F.least(n, F.lit(cap)) if cap else n).cast("bigint").alias(out))


def with_frequency(df: DataFrame, counts: DataFrame, keys: list[str], out: str) -> DataFrame:
    return df.join(counts, keys, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def siblings(pairs: DataFrame, similarity, anchor: float = 0.5) -> DataFrame:
    """For each pair, how like the s1's other sure records it is: count, best, best times p. `similarity` takes two names and is at least 0.

    Names are compared, not records: an s1's records of one name share their comparisons.
    """
    sure = pairs.where(F.col("p") >= anchor)
    counts = sure.groupBy("s1_id").agg(F.count("*").alias("_n"))
    sources = sure.groupBy("s1_id", F.substring("m_id", 1, 2).alias("_src")).agg(F.count("*").alias("_same"))
    top = F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, 2)
    held = sure.groupBy("s1_id", F.col("name").alias("a_name")).agg(F.count("*").alias("a_n"), F.max("p").alias("a_p"), F.try_element_at(top, F.lit(2)).alias("a_p2"))
    # null names are compared like others
    near = pairs.select("s1_id", "name").distinct().join(held, "s1_id").withColumn("sim", similarity("name", "a_name"))
    own = F.col("name").eqNullSafe(F.col("a_name"))
    by_name = near.groupBy("s1_id", F.col("name").alias("_name")).agg(
        F.max(F.when(~own, F.col("sim"))).alias("_best"), F.max(F.when(~own, F.col("sim") * F.col("a_p"))).alias("_weighted"),
        F.max(F.when(own, F.struct("sim", "a_n", "a_p", "a_p2"))).alias("_own"),
    )
    x = pairs.withColumn("_self", F.coalesce(F.col("p") >= anchor, F.lit(False))).withColumn("_src", F.substring("m_id", 1, 2))
    x = x.join(counts, "s1_id", "left").join(sources, ["s1_id", "_src"], "left")
    x = x.join(by_name.withColumnRenamed("s1_id", "_s1"), (F.col("s1_id") == F.col("_s1")) & F.col("name").eqNullSafe(F.col("_name")), "left")
    one = F.col("_self").cast("long")
    others = F.col("_own.a_n") > one
    # without itself the best p of its name is the second if it is the first
    best_p = F.when(F.col("_self") & (F.col("p") == F.col("_own.a_p")), F.col("_own.a_p2")).otherwise(F.col("_own.a_p"))
    return x.select(
        *pairs.columns, (F.coalesce("_n", F.lit(0)) - one).alias("sib_n"),
        F.coalesce(F.greatest("_best", F.when(others, F.col("_own.sim"))), F.lit(-1.0)).alias("sib_best"),
        F.coalesce(F.greatest("_weighted", F.when(others, F.col("_own.sim") * best_p)), F.lit(-1.0)).alias("sib_weighted"),
        (F.coalesce("_same", F.lit(0)) - one).alias("sib_same_source"),
    )


def peer_support(pairs: DataFrame, kernel, tau: float = 0.9) -> DataFrame:
    """Sum of kernel times p over the other records of the s1 with p >= tau, over their number plus one; by names, as `siblings`."""
    held = pairs.where(F.col("p") >= tau).groupBy("s1_id", F.col("name").alias("k_name")).agg(F.count("*").alias("k_n"), F.sum("p").alias("k_p"))
    near = pairs.select("s1_id", "name").distinct().join(held, "s1_id").withColumn("k", kernel("name", "k_name"))
    own = F.col("name").eqNullSafe(F.col("k_name"))
    by_name = near.groupBy(F.col("s1_id").alias("_s1"), F.col("name").alias("_name")).agg(
        F.sum("k_n").alias("_n"), F.sum(F.col("k") * F.col("k_p")).alias("_sum"), F.sum(F.col("k") * F.col("k_n")).alias("_k"), F.max(F.when(~own, F.col("k"))).alias("_max"),
        F.sum(F.when(F.col("k") < 0.5, F.col("k_n")).otherwise(0)).alias("_against"), F.max(F.when(own, F.struct("k", "k_n"))).alias("_own"),
    )
    x = pairs.withColumn("_self", F.coalesce(F.col("p") >= tau, F.lit(False)).cast("long"))
    x = x.join(by_name, (F.col("s1_id") == F.col("_s1")) & F.col("name").eqNullSafe(F.col("_name")), "left")
    n, k = F.col("_n") - F.col("_self"), F.coalesce("_own.k", F.lit(0.0)) * F.col("_self")
    out = x.select(
        *pairs.columns, F.when(n > 0, (F.col("_sum") - k * F.col("p")) / (n + 1)).alias("support"),
        F.when(n > 0, F.greatest("_max", F.when(F.col("_own.k_n") > F.col("_self"), F.col("_own.k")))).alias("support_max"), F.when(n > 0, (F.col("_k") - k) / n).alias("support_mean"),
        F.when(n > 0, F.col("_against") - F.when(F.col("_own.k") < 0.5, F.col("_self")).otherwise(0)).alias("contradictions"),
    )
    return out.na.fill(0)


def contained_elsewhere(pairs: DataFrame, new: str, held: str) -> DataFrame:
    """s1_id, m_id of pairs whose array `new` is not empty and lies in the array `held` of another pair of the s1.

    Equal arrays of an s1 are one: they are compared once, and only with arrays that hold the first element of `new`.
    """
    sets = pairs.groupBy("s1_id", F.array_sort(held).alias("h")).agg(F.count("*").alias("n"))
    asked = pairs.where(F.size(new) > 0).select("s1_id", F.array_sort(held).alias("own"), F.array_sort(new).alias("new")).distinct().withColumn("first", F.try_element_at("new", F.lit(1)))
    lookup = sets.select("s1_id", "h", "n", F.explode(F.array_distinct("h")).alias("first"))
    hit = asked.join(lookup, ["s1_id", "first"]).where((F.size(F.array_except("new", "h")) == 0) & ((F.col("h") != F.col("own")) | (F.col("n") > 1))).select("s1_id", "own", "new").distinct()
    return pairs.select("s1_id", "m_id", F.array_sort(held).alias("own"), F.array_sort(new).alias("new")).join(hit, ["s1_id", "own", "new"], "left_semi").select("s1_id", "m_id")


def support_class(pairs: DataFrame) -> DataFrame:
    """corr, lone or none: whether the numbers that a record adds to its s1's (arrays nums, s1_nums) are held by another record of the s1."""
    new = pairs.withColumn("new", F.array_except("nums", "s1_nums"))
    found = contained_elsewhere(new, "new", "nums").distinct().withColumn("hit", F.lit(True))
    kind = F.when(F.size("new") == 0, "none").when(F.col("hit"), "corr").otherwise("lone")
    return new.join(found, ["s1_id", "m_id"], "left").withColumn("support", kind).drop("hit", "new")


def word_support(pairs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """n_add, decoy_word, name_corr, street_corr: what a record (arrays name_words, street) adds to its s1 (s1_words, s1_street), and whether another record of the s1 holds all of it."""
    x = pairs.withColumns({"_n": F.array_except("name_words", "s1_words"), "_s": F.array_except("street", "s1_street")})
    name, street = (contained_elsewhere(x, new, held).distinct().withColumn(out, F.lit(True)) for new, held, out in (("_n", "name_words", "name_corr"), ("_s", "street", "street_corr")))
    y = x.join(name, ["s1_id", "m_id"], "left").join(street, ["s1_id", "m_id"], "left")
    return y.select("s1_id", "m_id", F.size("_n").alias("n_add"), F.exists("_n", lambda w: w.isin(vocabulary or [""])).alias("decoy_word"), F.coalesce("name_corr", F.lit(False)).alias("name_corr"), F.coalesce("street_corr", F.lit(False)).alias("street_corr"))


def blend(a: DataFrame, b: DataFrame, w: float) -> DataFrame:
    """w x pa + (1 - w) x pb; a missing side counts 0."""
    both = a.select("s1_id", "m_id", F.col("p").alias("pa")).join(b.select("s1_id", "m_id", F.col("p").alias("pb")), ["s1_id", "m_id"], "full")
    return both.select("s1_id", "m_id", (F.coalesce("pa", F.lit(0.0)) * w + F.coalesce("pb", F.lit(0.0)) * (1 - w)).alias("p"))


def record_side(pairs: DataFrame) -> DataFrame:
    """Dense rank of cos_comb, gap to the best and candidates, among the pairs of a record."""
    return pairs.withColumns(side("m_id", "cos_comb", "s1_id", "m"))


def s1_side(pairs: DataFrame, set_ratio: str = "f_name_set", shares: str = "f_num_share") -> DataFrame:
    """Dense ranks by the combined, name and address cosine among the pairs of an s1, gap, candidates, strong ones; and among those of (nearly) the same name."""
    w = Window.partitionBy("s1_id")
    same = F.col(set_ratio) >= 90
    held = F.when(same, F.col("cos_addr"))
    return pairs.withColumns({
        **{f"s1_rank_{c}": F.dense_rank().over(w.orderBy(F.desc(f"cos_{c}"))) for c in ("comb", "name", "addr")},
        "s1_gap": F.max("cos_comb").over(w) - F.col("cos_comb"), "s1_n": F.count("*").over(w), "s1_strong": F.count(F.when(F.col("cos_comb") > 0.6, 1)).over(w),
        "s1_same_name": F.count(F.when(same, 1)).over(w), "s1_same_name_number": F.count(F.when(same & (F.col(shares) > 0), 1)).over(w),
        "s1_same_rank": F.when(same, F.dense_rank().over(w.orderBy(F.desc_nulls_last(held)))).otherwise(99), "s1_same_gap": F.coalesce(F.max(held).over(w) - F.col("cos_addr"), F.lit(1.0)),
    })


def competition(pairs: DataFrame, least: float = 0.005, p: str = "p") -> DataFrame:
    """Of pairs with p >= least, in the light of all pairs of both ends: ranks (equal ones share the smallest), counts, sums, margins to the best other."""
    q, kept = F.col(p), F.col(p) >= least
    out = pairs
    for key, tag in (("s1_id", "s1"), ("m_id", "m")):
        w = Window.partitionBy(key)
        order = w.orderBy(F.desc(p))
        out = out.withColumns({f"_{tag}_best": F.max(p).over(w), f"_{tag}_second": F.coalesce(F.nth_value(p, 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))})
        out = out.withColumns({f"{tag}_n": F.count("*").over(w), f"{tag}_n50": F.count(F.when(q >= 0.5, 1)).over(w), f"{tag}_sum": F.sum(p).over(w), f"{tag}_margin": q - F.when(q >= F.col(f"_{tag}_best"), F.col(f"_{tag}_second")).otherwise(F.col(f"_{tag}_best"))})
    s1 = Window.partitionBy("s1_id")
    out = out.withColumns({"s1_n90": F.count(F.when(q >= 0.9, 1)).over(s1), "s1_n_kept": F.count(F.when(kept, 1)).over(s1)}).where(kept)
    ranks = {f"{tag}_rank": F.rank().over(Window.partitionBy(key).orderBy(F.desc(p))) for key, tag in (("s1_id", "s1"), ("m_id", "m"))}
    return out.withColumns(ranks).withColumnsRenamed({"_s1_best": "s1_best", "_s1_second": "s1_second", "_m_best": "m_best", "_m_second": "m_second"})


def ordinal_competition(pairs: DataFrame, scores: list[str], key: str = "m_id", tie: str = "s1_id") -> DataFrame:
    """For each score: the pair's place among the pairs of the key, the best other score (0 if none) and the margin to it."""
    w, out = Window.partitionBy(key), pairs.withColumn("candidates", F.count("*").over(Window.partitionBy(key)))
    for c in scores:
        place = F.row_number().over(w.orderBy(F.desc(c), tie))
        other = F.coalesce(F.when(F.col(f"{c}_rank") == 1, F.max(F.when(F.col(f"{c}_rank") == 2, F.col(c))).over(w)).otherwise(F.max(c).over(w)), F.lit(0.0))
        out = out.withColumn(f"{c}_rank", place).withColumn(f"{c}_other", other).withColumn(f"{c}_margin", F.col(c) - F.col(f"{c}_other"))
    return out


def name_frequencies(pairs: DataFrame, s1: DataFrame, pool: DataFrame, codes: list[str]) -> DataFrame:
    """Described pairs (see pairs.described) with how many records hold their names, sounds and addresses.

    States are merged on both sides before they are counted and looked up.
    """
    from kinweave.functions import text as X

    keyed = [df.withColumns({"state": X.merged_state(F.col("addr_state")), "addr_key": X.order_free(F.col("addr_text"), codes)}) for df in (s1, pool)]
    a, b = keyed
    x = pairs.withColumns({"_state": X.merged_state(F.col("a_addr_state")), "_ka": X.order_free(F.col("a_addr_text"), codes), "_kb": X.order_free(F.col("b_addr_text"), codes)})
    placed = [df.where("addr_text <> ''") for df in (a, b)]
    tables = [
        (frequency(a, ["country", "state", "name_core"], "freq_s1name_state"), ["a_country", "_state", "a_name_core"]), (frequency(a, ["country", "name_core"], "freq_s1name"), ["a_country", "a_name_core"]),
        (frequency(a, ["country", "name_core"], "freq_bname_in_s1"), ["a_country", "b_name_core"]), (frequency(b, ["country", "state", "name_core"], "freq_s1name_in_pool"), ["a_country", "_state", "a_name_core"]),
        (frequency(a, ["country", "name_phon"], "freq_bphon_in_s1"), ["a_country", "b_name_phon"]), (frequency(placed[0], ["country", "addr_key"], "freq_s1addr"), ["a_country", "_ka"]),
        (frequency(placed[0], ["country", "addr_key"], "freq_baddr_in_s1"), ["a_country", "_kb"]), (frequency(placed[1], ["country", "addr_key"], "_pool_addr"), ["a_country", "_kb"]),
    ]
    for table, keys in tables:
        out = table.columns[-1]
        x = with_frequency(x, table.toDF(*keys, out), keys, out)
    capped = {c: F.least(c, F.lit(10)) for c in ("freq_s1addr", "freq_baddr_in_s1")}
    x = x.withColumns(capped)
    return x.withColumn("freq_pool_per_s1", F.least(F.col("_pool_addr") / F.greatest("freq_baddr_in_s1", F.lit(1)), F.lit(20.0))).drop("_state", "_ka", "_kb", "_pool_addr")


def stacking_design(scores: DataFrame, optional: DataFrame, extras: dict[str, DataFrame]) -> DataFrame:
    """s1_id, m_id, lp (logit of p), cn and whether there is one (else -1), and a column for each further table of scores (null where it has none)."""
    from kinweave.functions import text as X

    x = scores.join(optional.select("s1_id", "m_id", F.col("p").alias("cn")), ["s1_id", "m_id"], "left")
    for name, extra in extras.items():
        x = x.join(extra.select("s1_id", "m_id", F.col("p").alias(name)), ["s1_id", "m_id"], "left")
    return x.withColumns({"lp": X.logit(F.col("p")), "cn_scored": F.col("cn").isNotNull().cast("double"), "cn": F.coalesce("cn", F.lit(-1.0))})


def split_wide(wide: DataFrame, columns: list[str]) -> DataFrame:
    """s1_id, m_id, feature, p: one row for each pair and column of a wide table; the first of equal pairs by value."""
    one = wide.groupBy("s1_id", "m_id").agg(*[F.min(c).cast("double").alias(c) for c in columns])
    return one.unpivot(["s1_id", "m_id"], columns, "feature", "p")


def fall_back(new: DataFrame, old: DataFrame, covered: DataFrame) -> DataFrame:
    """The new p of covered pairs; the old one of others, or the new one where there is none."""
    x = new.join(old.select("s1_id", "m_id", F.col("p").alias("_old")), ["s1_id", "m_id"], "left").join(covered.select("s1_id", "m_id").distinct().withColumn("_cov", F.lit(True)), ["s1_id", "m_id"], "left")
    return x.withColumn("p", F.when(F.col("_cov"), F.col("p")).otherwise(F.coalesce("_old", "p"))).drop("_old", "_cov")


def peer_features(pairs: DataFrame, similarity, tau: float = 0.9, least: float = 0.005) -> DataFrame:
    """Support by the other sure records (p >= tau) of the s1 for pairs with p >= least; pairs carry name, addr and house (the largest number or null).

    n, weighted mean P of the kernel times p over n + 1, largest and mean kernel, largest name and address similarity,
    contradictions (like names, other house numbers), peers of the same and another source; and the coherence of the
    sure records among each other. The kernel is the mean of name and address similarity, or the name's where an address
    is missing. Records of an s1 that are equal in name, address and house are one, with their number, on both sides.
    """
    keys = ["s1_id", "name", "addr", "house"]
    x = pairs.select("s1_id", "m_id", "p", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("addr", F.lit("")).alias("addr"), "house", F.substring("m_id", 1, 2).alias("src"))
    seeds = x.where(F.col("p") >= tau).groupBy(*keys, "src").agg(F.count("*").alias("kn"), F.sum("p").alias("kp")).withColumnsRenamed({"name": "k_name", "addr": "k_addr", "house": "k_house", "src": "k_src"})
    asked = x.where(F.col("p") >= least)
    meet = asked.select(*keys).distinct().join(seeds, "s1_id").withColumns({"ns": similarity("name", "k_name") / 100, "ad": similarity("addr", "k_addr") / 100})
    bare = (F.col("addr") == "") | (F.col("k_addr") == "")
    meet = meet.withColumns({"k": F.when(bare, F.col("ns")).otherwise((F.col("ns") + F.col("ad")) / 2), "ad": F.when(~bare, F.col("ad")), "against": F.coalesce((F.col("ns") >= 0.9) & (F.col("house") != F.col("k_house")), F.lit(False))})
    y = asked.withColumn("_self", (F.col("p") >= tau).cast("int")).join(meet.withColumnsRenamed({k: f"_{k}" for k in keys}), F.expr("s1_id = _s1_id AND name = _name AND addr = _addr AND house <=> _house"), "left")
    own = F.expr("name = k_name AND addr = k_addr AND house <=> k_house AND src = k_src").cast("int") * F.col("_self")
    y = y.withColumns({"_n": F.col("kn") - own, "_p": F.col("kp") - own * F.col("p")})
    some = F.col("_n") > 0
    agg = y.groupBy("s1_id", "m_id").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sum(F.col("k") * F.col("_p")).alias("kp"), F.max(F.when(some, F.col("k"))).alias("kmax"), F.sum(F.col("k") * F.col("_n")).alias("ks"), F.max(F.when(some, F.col("ns"))).alias("name"),
        F.max(F.when(some, F.col("ad"))).alias("addr"), F.max(F.when(some, F.least("ns", F.coalesce("ad", "ns")))).alias("both"), F.sum(F.when(F.col("against"), F.col("_n")).otherwise(0)).alias("contra"),
        F.sum(F.when(F.col("src") == F.col("k_src"), F.col("_n")).otherwise(0)).alias("same_src"), F.sum(F.when(F.col("src") != F.col("k_src"), F.col("_n")).otherwise(0)).alias("other_src"),
    )
    left, right = (seeds.groupBy("s1_id", "k_name", "k_addr").agg(F.sum("kn").alias(f"n{t}")).withColumnsRenamed({"k_name": f"n_{t}", "k_addr": f"a_{t}"}) for t in "ab")
    pairs_ = left.join(right, "s1_id").where("(n_a, a_a) <= (n_b, a_b)")
    equal = F.expr("n_a = n_b AND a_a = a_b")
    weight = F.when(equal, F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    like = F.when(F.expr("a_a = '' OR a_b = ''"), similarity("n_a", "n_b") / 100).otherwise((similarity("n_a", "n_b") + similarity("a_a", "a_b")) / 200)
    coherence = pairs_.withColumns({"w": weight, "l": like}).groupBy("s1_id").agg((F.sum(F.col("w") * F.col("l")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("coherence"))
    out = agg.join(coherence, "s1_id", "left")
    none = lambda c: F.coalesce(c, F.lit(-1.0))
    return out.select(
        "s1_id", "m_id", "n", F.when(F.col("n") > 0, F.col("kp") / (F.col("n") + 1)).otherwise(0.0).alias("support"), none(F.col("kmax")).alias("kmax"), none(F.when(F.col("n") > 0, F.col("ks") / F.col("n"))).alias("kmean"),
        none(F.col("name")).alias("name"), none(F.col("addr")).alias("addr"), none(F.col("both")).alias("both"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("contra", "same_src", "other_src")], none(F.col("coherence")).alias("coherence"),
    )
