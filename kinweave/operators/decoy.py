"""Label-free tests for decoys: relation classes, densities, precision by invariance, count shapes, swapped words, health scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import kernels as K
from kinweave.functions import text as X
from kinweave.functions.kernels import SHIFTS

#: The shifts that copies never show, and the word classes of the tests on names.
PURE_SHIFTS = [3, 4, 5, 7, 9, 11, 13, 21]
GENERIC_WORDS = "center services service partners france groupe developpement centre holding associes st sa".split()
LEGAL_WORDS = ["sci", "sa", "a s", "e l r u", "ets", "a s u", "5as", "sarl", "eurl", "sas"]
#: Street words that tell nothing, and the groups of number relations that are weighed apart.
STREET_STOP = "rd st ave road street no nr near opp ngr nagar fl floor unit apt suite ste dr ln blvd the of and plot h d door flat sec sector colony main cross".split()
SHIFT_GROUPS = ["shift_pure", "shift_12", "shift_ms_only"]
BANDS = [0.05, 0.3, 0.75, 0.95]


def _gaps(less: Column, more: Column) -> Column:
    return F.flatten(F.transform(less, lambda x: F.transform(more, lambda y: (y - x).cast("bigint"))))


def _closest(gaps: Column) -> Column:
    """The smallest difference, of two of one size the negative one."""
    return F.array_min(F.transform(gaps, lambda g: F.struct(F.abs(g).alias("size"), g.alias("g"))))["g"]


def _one_digit_off(a: Column, b: Column) -> Column:
    """Whether two numbers differ by a dropped digit, or by one digit that is not the last."""
    x, y = a.cast("string"), b.cast("string")
    differ = lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1))
    places = F.filter(F.sequence(F.lit(1), F.length(x)), differ)
    longer, shorter = F.when(F.length(x) > F.length(y), x).otherwise(y), F.when(F.length(x) > F.length(y), y).otherwise(x)
    dropped = F.exists(F.sequence(F.lit(1), F.length(longer)), lambda i: F.concat(F.substring(longer, F.lit(1), i - 1), F.substring(longer, i + 1, F.length(longer))) == shorter)
    return F.when(F.length(x) == F.length(y), (F.size(places) == 1) & (F.element_at(places, 1) < F.length(x))).otherwise((F.abs(F.length(x) - F.length(y)) == 1) & dropped)


def number_relation(a: Column, b: Column) -> Column:
    """The class of two multisets of integers, the first that holds: missing, eq, shift_pure, shift_12, shift_ms_only, sub, neg_small, typo, near_other, far.

    The shifts are told from distinct numbers, shift_ms_only from repeated ones.
    """
    sets = _gaps(F.array_except(a, b), F.array_except(b, a))
    less, more = X.multiset_minus(a, b), X.multiset_minus(b, a)
    gaps = _gaps(less, more)
    closest = _closest(gaps)
    typo = F.exists(less, lambda x: F.exists(more, lambda y: _one_digit_off(x, y)))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "missing").when(F.array_sort(a) == F.array_sort(b), "eq")
        .when(F.exists(sets, lambda g: g.isin(SHIFTS)), F.when(_closest(sets).isin(PURE_SHIFTS), "shift_pure").otherwise("shift_12"))
        .when(F.exists(gaps, lambda g: g.isin(SHIFTS)), "shift_ms_only").when((F.size(less) == 0) | (F.size(more) == 0), "sub").when(closest.between(-25, -1), "neg_small")
        .when(typo, "typo").when(F.abs(closest) <= 100, "near_other").otherwise("far")
    )


def name_relation(a: Column, b: Column, set_ratio: Column) -> Column:
    """The class of two cleaned names: eq, perm, space, add_1, add_2+, drop_1, drop_2+, typo1, swap1, fuzzy_hi, first_same, fuzzy_mid or diff. `set_ratio` is that of the names."""
    ta, tb = X.tokens(a), X.tokens(b)
    more, less = F.array_except(tb, ta), F.array_except(ta, tb)
    n, m = F.size(more), F.size(less)
    x, y = F.element_at(less, 1), F.element_at(more, 1)
    like = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    first = lambda t: F.try_element_at(t, F.lit(1))
    return (
        F.when(a == b, "eq").when(F.array_sort(ta) == F.array_sort(tb), "perm").when(F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit("")), "space")
        .when((F.size(ta) > 0) & (m == 0) & (n > 0), F.when(n == 1, "add_1").otherwise("add_2+")).when((F.size(tb) > 0) & (n == 0) & (m > 0), F.when(m == 1, "drop_1").otherwise("drop_2+"))
        .when((n == 1) & (m == 1), F.when(like >= 0.5, "typo1").otherwise("swap1")).when(set_ratio >= 85, "fuzzy_hi")
        .when(F.coalesce(first(ta) == first(tb), F.lit(False)), "first_same").when(set_ratio >= 60, "fuzzy_mid").otherwise("diff")
    )


def legal_relation(a: Column, b: Column) -> Column:
    return F.when((a == "") & (b == ""), "both_empty").when(a == b, "eq").when((a == "") | (b == ""), "one_empty").otherwise("diff")


def street_relation(a: Column, b: Column, states: list[str]) -> Column:
    """eq, hi, mid, lo or empty, by the Jaccard of the address words without numbers, states and single characters."""
    words = lambda c: F.array_distinct(F.filter(X.tokens(c), lambda t: ~t.rlike("^[0-9]+$") & ~t.isin(states or [""]) & (F.length(t) > 1)))
    wa, wb = words(a), words(b)
    j = X.jaccard(wa, wb)
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), "empty").when(j == 1, "eq").when(j >= 0.6, "hi").when(j >= 0.3, "mid").otherwise("lo")


def state_relation(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), "empty").when(a == b, "eq").otherwise("diff")


def moved_numbers(a_address: Column, b_address: Column, a_name: Column, b_name: Column, sort_ratio: Column) -> Column:
    """exact, near or other (by the names) for pairs whose numbers of at most four digits moved: neither side's are all of the other's; else null."""
    nums = lambda c: F.filter(X.number_multiset(c), lambda n: n < 10_000)
    a, b = nums(a_address), nums(b_address)
    moved = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)
    return F.when(moved, F.when(a_name == b_name, "exact").when(sort_ratio >= 85, "near").otherwise("other"))


def _differing(ta: Column, tb: Column) -> Column:
    """The places (from 1) at which two arrays of one length differ."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(ta), F.lit(1))), lambda i: F.try_element_at(ta, i) != F.try_element_at(tb, i))


def swapped_words(pairs: DataFrame, a: str = "a_name_core", b: str = "b_name_core") -> DataFrame:
    """Pairs with `at`, `word_a`, `word_b`: the only place (from 1) at which two names of one length differ, and how alike the two words are (`like`); null for other pairs."""
    ta, tb = X.tokens(F.col(a)), X.tokens(F.col(b))
    places = _differing(ta, tb)
    at = F.when((F.size(ta) == F.size(tb)) & (F.size(places) == 1), F.element_at(places, 1))
    x = pairs.withColumn("at", at).withColumns({"word_a": F.try_element_at(ta, F.col("at")), "word_b": F.try_element_at(tb, F.col("at"))})
    return x.withColumn("like", K.difflib_ratio("word_a", "word_b"))


def name_class(pairs: DataFrame) -> DataFrame:
    """Pairs (described) with `cls`: how the record's name differs, and whether its numbers are the same, other or missing, such as exact_same or swap_first_diff."""
    a, b = F.col("a_name_core"), F.col("b_name_core")
    ta, tb = X.tokens(a), X.tokens(b)
    na, nb = X.number_multiset(F.col("a_addr_text")), X.number_multiset(F.col("b_addr_text"))
    tag = F.when((F.size(na) > 0) & (na == nb), "same").when(F.trim("b_addr_text") == "", "noaddr").otherwise("diff")
    x = swapped_words(pairs).withColumn("_whole", K.difflib_ratio(a, b)).withColumn("_words", K.worst_word(a, b))
    added = X.join(F.array_sort(F.array_except(tb, ta)))
    more, less = F.size(F.array_except(tb, ta)), F.size(F.array_except(ta, tb))
    swap = F.when(F.col("at") == 1, "swap_first").when(F.col("word_b").isin(GENERIC_WORDS), "swap_generic").otherwise("swap_descr")
    rest = F.when(F.col("_whole") >= 0.85, "fuzzy").otherwise("lowov")
    kind = (
        F.when(a == b, "exact").when((more == 0) & (less == 0), "reorder")
        .when(less == 0, F.when(added.isin(LEGAL_WORDS), "add_legal").when(added.isin(GENERIC_WORDS), "add_generic").otherwise("add_other")).when(more == 0, "drop")
        .when(F.size(ta) == F.size(tb), F.when(F.col("_words") >= 0.6, "typo").when(F.col("at").isNotNull(), swap).otherwise(rest)).otherwise(rest)
    )
    return x.withColumn("cls", F.concat_ws("_", kind, tag)).drop("_whole", "_words", "at", "word_a", "word_b", "like")


def suffix_class(pairs: DataFrame) -> DataFrame:
    """Pairs with `cls`: adds_word, typo, swap_generic, swap_descr, reorder, drops_word or other; null where a name is empty or both are equal."""
    a, b = F.col("a_name_core"), F.col("b_name_core")
    ta, tb = X.tokens(a), X.tokens(b)
    more, less = F.size(F.array_except(tb, ta)), F.size(F.array_except(ta, tb))
    one = F.when(F.col("like") >= 0.6, "typo").when(F.col("word_b").isin(GENERIC_WORDS), "swap_generic").otherwise("swap_descr")
    kind = F.when((less == 0) & (more > 0), "adds_word").when(F.col("at").isNotNull(), one).when((more == 0) & (less == 0), "reorder").when((more == 0) & (less > 0), "drops_word").otherwise("other")
    return swapped_words(pairs).withColumn("cls", F.when((a != b) & (a != "") & (b != ""), kind)).drop("at", "word_a", "word_b", "like")


def one_word_swaps(pairs: DataFrame, unlike: float = 0.6, street: float = 0.5) -> DataFrame:
    """Described pairs whose names differ in one of two words or more, the words unlike, the house numbers the same and the streets alike: with the place `at` and the record's word `target`."""
    na, nb = X.number_multiset(F.col("a_addr_text")), X.number_multiset(F.col("b_addr_text"))
    sa, sb = X.street_words(F.col("a_addr_text")), X.street_words(F.col("b_addr_text"))
    x = swapped_words(pairs).where((F.size(na) > 0) & (na == nb) & (F.size(sa) > 0) & (X.jaccard(sa, sb) >= street) & (F.size(X.tokens(F.col("a_name_core"))) >= 2))
    return x.where(F.col("like") < unlike).withColumnRenamed("word_b", "target").drop("word_a", "like")


def swap_classes(swaps: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Swaps with `cls` (first, generic, twin: two records or more share the swapped name and numbers, single), `tier` (T1a: another s1 alone has the name, numbers and a like street; T1b: twins; T2) and `owner` (that s1)."""
    nk = X.number_multiset
    twins = pool.where("name_core <> ''").groupBy(F.col("name_core").alias("b_name_core"), nk(F.col("addr_text")).alias("_nk")).agg(F.count("*").alias("_twins"))
    x = swaps.withColumn("_nk", nk(F.col("b_addr_text"))).join(twins, ["b_name_core", "_nk"], "left")
    owners = s1.select(F.col("entity_id").alias("o_id"), F.col("name_core").alias("b_name_core"), nk(F.col("addr_text")).alias("_nk"), X.street_words(F.col("addr_text")).alias("_so"))
    near = x.join(owners, ["b_name_core", "_nk"]).where((F.col("o_id") != F.col("s1_id")) & (X.jaccard(X.street_words(F.col("b_addr_text")), F.col("_so")) >= 0.5))
    one = near.groupBy("s1_id", "m_id").agg(F.count("*").alias("_n"), F.min("o_id").alias("owner")).where("_n = 1").drop("_n")
    y = x.join(one, ["s1_id", "m_id"], "left")
    twin = F.coalesce(F.col("_twins") >= 2, F.lit(False))
    cls = F.when(F.col("at") == 1, "first").when(F.col("target").isin(GENERIC_WORDS), "generic").when(twin, "twin").otherwise("single")
    return y.withColumn("cls", cls).withColumn("tier", F.when(F.col("owner").isNotNull(), "T1a").when(twin, "T1b").otherwise("T2")).drop("_nk", "_twins")


def copy_deficit(kept: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, n, mean, deficit: for each class, how many fewer own-name copies its s1 hold than s1 without any class.

    kept: described pairs of the file; classes: s1_id, m_id, cls of some of them. An s1 counts for its smallest class.
    """
    own = kept.groupBy("s1_id").agg(F.count(F.when(F.col("a_name_core") == F.col("b_name_core"), 1)).alias("copies"))
    of = classes.groupBy("s1_id").agg(F.min("cls").alias("cls"))
    x = own.join(of, "s1_id", "left")
    base = x.where("cls IS NULL").agg(F.avg("copies").alias("base"))
    return x.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("n"), F.avg("copies").alias("mean")).join(F.broadcast(base)).select("cls", "n", "mean", (F.col("base") - F.col("mean")).alias("deficit"))


def word_shares(swaps: DataFrame, kept: DataFrame, deficits: dict[str, float], least: int = 150) -> DataFrame:
    """target, cls, n, share: of each swapped word in each class, the share of true pairs: the deficit of its s1 over that of true swaps, between 0 and 1. Words of fewer than `least` s1 are pooled by class; generic words stand apart."""
    own = kept.groupBy("s1_id").agg(F.count(F.when(F.col("a_name_core") == F.col("b_name_core"), 1)).alias("copies"))
    first = swaps.groupBy("s1_id").agg(F.min(F.struct("m_id", "target", "cls")).alias("f")).select("s1_id", "f.target", "f.cls")
    base = own.join(first, "s1_id", "left_anti").agg(F.avg("copies").alias("base"))
    x = own.join(first, "s1_id").withColumn("target", F.when(F.col("target").isin(GENERIC_WORDS), "<generic>").otherwise(F.col("target")))
    n = x.groupBy("target", "cls").agg(F.count("*").alias("n"))
    y = x.join(n, ["target", "cls"]).withColumn("word", F.when((F.col("n") < least) & (F.col("target") != "<generic>"), "<small>").otherwise(F.col("target")))
    true = F.element_at(F.create_map(*[F.lit(v) for kv in deficits.items() for v in kv]), F.col("cls"))
    pooled = y.groupBy("word", "cls").agg(F.count("*").alias("n"), F.avg("copies").alias("mean")).join(F.broadcast(base))
    return pooled.select(F.col("word").alias("target"), "cls", "n", F.least(F.greatest((F.col("base") - F.col("mean")) / true, F.lit(0.0)), F.lit(1.0)).alias("share"))


def swap_actions(swaps: DataFrame, shares: DataFrame, least: float = 0.5, rows: int = 150) -> DataFrame:
    """s1_id, m_id, action (drop or move), to_id, share: swaps of words whose share of true pairs is below `least`; they move where another s1 alone owns the name."""
    big, small = shares.where((F.col("n") >= rows) & ~F.col("target").isin("<small>", "<generic>")), shares.where("target = '<small>'").select("cls", F.col("share").alias("pooled"))
    x = swaps.where(~F.col("target").isin(GENERIC_WORDS)).join(big.select("target", "cls", F.col("share").alias("own")), ["target", "cls"], "left").join(small, "cls", "left")
    share = F.coalesce("own", "pooled", F.lit(1.0))
    return x.where(share < least).select("s1_id", "m_id", F.when(F.col("owner").isNotNull(), "move").otherwise("drop").alias("action"), F.col("owner").alias("to_id"), share.alias("share"))


def density(valid: DataFrame, test: DataFrame, cell: list[str], n_valid: int, n_test: int) -> DataFrame:
    """Pairs per 1000 entities in each cell on both sides, and their ratio."""
    a, b = (x.groupBy(*cell).agg(F.count("*").alias(n)) for x, n in ((valid, "valid"), (test, "test")))
    x = a.join(b, cell, "full").na.fill(0, ["valid", "test"])
    dv, dt = F.col("valid") * 1000.0 / n_valid, F.col("test") * 1000.0 / n_test
    return x.select(*cell, "valid", "test", dv.alias("d_valid"), dt.alias("d_test"), F.when(dv > 0, dt / dv).alias("rho"))


def labelled_cells(valid: DataFrame, test: DataFrame, cell: list[str], n_valid: int, n_test: int, least: float = 2.0) -> DataFrame:
    """Cells with at least `least` pairs per 1000 entities on a side: densities of all, true and predicted pairs (columns y, predicted), rho (test pairs without the true ones, over the false ones) and the excess of predictions."""
    per = lambda c, n: F.count(c) * 1000.0 / n
    v = valid.groupBy(*cell).agg(per("*", n_valid).alias("v_n"), per(F.when(F.col("y") == 1, 1), n_valid).alias("_pos"), per(F.when(F.col("y") == 0, 1), n_valid).alias("_neg"), per(F.when((F.col("y") == 1) & F.col("predicted"), 1), n_valid).alias("v_tp"), per(F.when((F.col("y") == 0) & F.col("predicted"), 1), n_valid).alias("v_fp"))
    t = test.groupBy(*cell).agg(per("*", n_test).alias("t_n"), per(F.when(F.col("predicted"), 1), n_test).alias("t_pred"))
    x = t.join(v, cell, "full").na.fill(0.0)
    rho = F.when(F.col("_neg") > 0, (F.col("t_n") - F.col("_pos")) / F.col("_neg"))
    return x.where((F.col("t_n") >= least) | (F.col("v_n") >= least)).select(*cell, "t_n", "t_pred", "v_n", "v_tp", "v_fp", rho.alias("rho"), (F.col("t_pred") - F.col("v_tp")).alias("excess"))


def band_letter(p: Column) -> Column:
    """a to e, by bands that are closed on the right."""
    return F.element_at(F.array(*[F.lit(c) for c in "abcde"]), sum(((p > e).cast("int") for e in BANDS), F.lit(0)) + 1)


def inflation(valid: DataFrame, test: DataFrame, n_valid: int, n_test: int, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """country, g, band, weight: by group of number relation and band of p, how much denser false pairs are on the test side, between `low` and `high`; the top band takes the weight of the one below."""
    group = F.when(F.col("num_rel").isin(SHIFT_GROUPS), F.col("num_rel")).otherwise("other")
    v, t = (x.select("*", group.alias("g"), band_letter(F.col("p")).alias("band")) for x in (valid, test))
    keys = ["country", "g", "band"]
    a = v.groupBy(*keys).agg((F.count(F.when(F.col("y") == 1, 1)) * 1000.0 / n_valid).alias("pos"), (F.count(F.when(F.col("y") == 0, 1)) * 1000.0 / n_valid).alias("neg"))
    b = t.groupBy(*keys).agg((F.count("*") * 1000.0 / n_test).alias("n"))
    w = a.join(b, keys).select(*keys, F.when(F.col("neg") > 0, F.least(F.greatest((F.col("n") - F.col("pos")) / F.col("neg"), F.lit(low)), F.lit(high))).otherwise(high).alias("weight"))
    return w.where("band <> 'e'").unionByName(w.where("band = 'd'").withColumn("band", F.lit("e")))


def all_state_correction(valid: DataFrame, truth_rate: DataFrame, test_rate: DataFrame, n_valid: int, least: float = 0.75) -> DataFrame:
    """g, k, k_pos: how the density of false pairs and of true ones in all states compares with that in the states of the labelled side.

    valid: g, y, p of labelled pairs; truth_rate: g, all_true (true pairs per 1000 entities of all states); test_rate: g,
    here, everywhere (predicted test pairs per 1000 entities in the labelled states and in all).
    """
    sure, y = F.col("p") >= least, F.col("y") == 1
    v = valid.groupBy("g").agg((F.count(F.when(sure & y, 1)) / F.greatest(F.count(F.when(y, 1)), F.lit(1))).alias("recall"), (F.count(F.when(sure & y, 1)) * 1000.0 / n_valid).alias("tp"), F.greatest(F.count(F.when(sure & ~y, 1)) * 1000.0 / n_valid, F.lit(0.01)).alias("fp"))
    x = v.join(truth_rate, "g").join(test_rate, "g").withColumn("expected", F.col("recall") * F.col("all_true"))
    edge = lambda c: F.greatest(c, F.lit(0.01))
    return x.select("g", (edge(F.col("everywhere") - F.col("expected")) / edge(F.col("here") - F.col("tp"))).alias("k"), (F.col("expected") / edge(F.col("tp"))).alias("k_pos"))


def invariance(labelled: DataFrame, cells: DataFrame, cell: list[str], least: int = 15) -> DataFrame:
    """Smoothed precision of each cell, divided by how much denser the cell is on the test side (1 where either side has fewer than `least` pairs)."""
    ratio = F.when((F.col("valid") >= least) & (F.col("test") >= least), F.greatest("rho", F.lit(1.0))).otherwise(1.0)
    prec = labelled.groupBy(*cell).agg(((F.sum("y") + 0.5) / (F.count("*") + 1)).alias("precision"))
    return cells.join(prec, cell, "left").select(*cell, ratio.alias("ratio"), "precision", (F.col("precision") / ratio).alias("q"))


def pooled_invariance(labelled: DataFrame, cells: DataFrame, group: list[str], n_valid: int, n_test: int, least: int = 15) -> DataFrame:
    """As `invariance` over the cells (group, band), but groups that are no shift share one density ratio over all bands but the lowest (band 0)."""
    high = cells.where("band > 0").groupBy(*group).agg(F.sum("valid").alias("_v"), F.sum("test").alias("_t"))
    pooled = F.when((F.col("_v") >= least) & (F.col("_t") >= least), F.greatest(F.col("_t") / n_test / (F.col("_v") / n_valid), F.lit(1.0))).otherwise(1.0)
    own = invariance(labelled, cells, [*group, "band"], least).join(high.select(*group, pooled.alias("_pooled")), group, "left")
    use = ~F.col(group[0]).cast("string").startswith("shift") & (F.col("band") > 0) & F.col("_pooled").isNotNull()
    ratio = F.when(use, F.col("_pooled")).otherwise(F.col("ratio"))
    return own.select(*group, "band", ratio.alias("ratio"), "precision", (F.col("precision") / ratio).alias("q"))


def decoy_words(a: Column, b: Column, vocabulary: list[str]) -> Column:
    """Whether the name b adds a word of the vocabulary over a that is no near copy of a word of a (two edits, one for words of fewer than five characters) and no two of them joined."""
    ta = X.tokens(a)
    added = F.filter(F.array_except(X.tokens(b), ta), lambda t: t.isin(vocabulary or [""]))
    joined = F.flatten(F.transform(ta, lambda u: F.transform(F.filter(ta, lambda v: v != u), lambda v: F.concat(u, v))))
    near = lambda t: F.exists(ta, lambda w: F.levenshtein(t, w) <= F.when((F.length(t) >= 5) & (F.length(w) >= 5), 2).otherwise(1))
    return F.exists(added, lambda t: ~near(t) & ~F.array_contains(joined, t))


def raw_decoy_words(a: Column, b: Column, vocabulary: list[str]) -> Column:
    """Whether the raw name b adds a word of the vocabulary over the raw name a; a final s, or one edit in words of five characters, is no addition."""
    wa = X.raw_words(a)
    stem = lambda t: F.regexp_replace(t, "s$", "")
    near = lambda t: F.exists(wa, lambda w: (stem(w) == stem(t)) | ((F.length(t) >= 5) & (F.levenshtein(w, t) <= 1)))
    return F.exists(F.filter(F.array_except(X.raw_words(b), wa), lambda t: t.isin(vocabulary or [""])), lambda t: ~near(t))


def raw_duplicates(records: DataFrame, owners: DataFrame) -> DataFrame:
    """outcome, n: groups of records of a source with one raw name and address (case aside), by their owners: same owner, several owners, some unowned, none owned."""
    x = records.where("business_address <> ''").select("entity_id", F.substring("entity_id", 1, 2).alias("src"), F.lower(F.trim("business_name")).alias("name"), F.lower(F.trim("business_address")).alias("addr"))
    x = x.join(owners.select(F.col("m_id").alias("entity_id"), "s1_id"), "entity_id", "left")
    g = x.groupBy("src", "name", "addr").agg(F.count("*").alias("n"), F.count("s1_id").alias("owned"), F.countDistinct("s1_id").alias("owners")).where("n > 1")
    outcome = F.when(F.col("owned") == 0, "none owned").when(F.col("owned") < F.col("n"), "some unowned").when(F.col("owners") == 1, "same owner").otherwise("several owners")
    return g.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def health_scan(counts: DataFrame, by: str, least: int) -> DataFrame:
    """Mean of a count by area against the median area, of areas with enough rows; and the capped distribution."""
    area = counts.groupBy(by).agg(F.count("*").alias("rows"), F.avg("n").alias("mean"), *[F.count(F.when(F.least("n", F.lit(6)) == k, 1)).alias(f"n{k}") for k in range(7)]).where(F.col("rows") >= least)
    middle = area.agg(F.percentile("mean", 0.5).alias("median"))
    return area.join(F.broadcast(middle)).withColumn("gap", F.col("mean") - F.col("median"))


def format_health(counts: DataFrame, formats: Column, by: str, least: int) -> DataFrame:
    """feature, by, rows, mean, gap: mean count of the rows with each feature of their address (array `formats`), against the mean of their country."""
    base = counts.groupBy(by).agg(F.avg("n").alias("base"))
    x = counts.select(by, "n", F.explode(F.array_distinct(formats)).alias("feature")).groupBy("feature", by).agg(F.count("*").alias("rows"), F.avg("n").alias("mean")).where(F.col("rows") >= least)
    return x.join(F.broadcast(base), by).select("feature", by, "rows", "mean", (F.col("mean") - F.col("base")).alias("gap"))


def count_prior(pairs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Tie-breaker: each pair's weight by how usual one more record is for an s1 with that count, normalised by record."""
    usual = counts.groupBy("n").agg(F.count("*").alias("k"))
    following = usual.select((F.col("n") - 1).alias("n"), F.col("k").alias("k_next"))
    lr = usual.join(following, "n", "left").select("n", ((F.coalesce("k_next", F.lit(0)) + 0.5) / (F.col("k") + 0.5)).alias("lr"))
    x = pairs.join(counts, key).join(F.broadcast(lr), "n")
    return x.withColumn("q", F.col("lr") / F.sum("lr").over(Window.partitionBy("m_id")))


def source_prior(ties: DataFrame, truth_counts: DataFrame, copies: DataFrame, cap: int = 8) -> DataFrame:
    """s1_id, m_id, q: for records (m_id with source src, 2 or 3) tied between s1, the chance of each by how usual one more copy in that source is.

    truth_counts: n2, n3 of labelled s1 (copies in S2 and S3); copies: s1_id, n2, n3 now. Counts are capped, cells smoothed by a half.
    """
    capped = [F.least(F.coalesce(c, F.lit(0)), F.lit(cap)).cast("int").alias(c) for c in ("n2", "n3")]
    joint = truth_counts.select(*capped).groupBy("n2", "n3").agg(F.count("*").alias("k"))
    x = ties.join(copies, "s1_id", "left").select("s1_id", "m_id", "src", *capped)
    more = x.withColumns({"n2": F.least(F.col("n2") + (F.col("src") == 2).cast("int"), F.lit(cap)), "n3": F.least(F.col("n3") + (F.col("src") == 3).cast("int"), F.lit(cap))})
    now = x.join(F.broadcast(joint), ["n2", "n3"], "left").select("s1_id", "m_id", (F.coalesce("k", F.lit(0)) + 0.5).alias("now"))
    then = more.join(F.broadcast(joint), ["n2", "n3"], "left").select("s1_id", "m_id", (F.coalesce("k", F.lit(0)) + 0.5).alias("then"))
    y = now.join(then, ["s1_id", "m_id"]).withColumn("lr", F.col("then") / F.col("now"))
    return y.select("s1_id", "m_id", (F.col("lr") / F.sum("lr").over(Window.partitionBy("m_id"))).alias("q"))


def tie_break_quality(q: DataFrame, truth: DataFrame, limits: list[float]) -> DataFrame:
    """threshold, covered, precision of the best s1 of each tied record where its chance reaches the threshold."""
    best = q.withColumn("_r", F.row_number().over(Window.partitionBy("m_id").orderBy(F.desc("q"), "s1_id"))).where("_r = 1").join(truth.select("s1_id", "m_id").withColumn("hit", F.lit(1)), ["s1_id", "m_id"], "left")
    cols = [F.struct(F.lit(t).alias("threshold"), (F.count(F.when(F.col("q") >= t, 1)) / F.count("*")).alias("covered"), (F.count(F.when((F.col("q") >= t) & (F.col("hit") == 1), 1)) / F.greatest(F.count(F.when(F.col("q") >= t, 1)), F.lit(1))).alias("precision")).alias(f"c{i}") for i, t in enumerate(limits)]
    return best.agg(*cols).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(limits))])))


def fill_test(entities: DataFrame, kept: DataFrame, added: DataFrame, by: str) -> DataFrame:
    """by, stage, n, mean, k0 to k6: the capped number of records of the entities before and after additions, and of the receivers before."""
    n = lambda df, c: df.groupBy("s1_id").agg(F.countDistinct("m_id").alias(c))
    x = entities.select("s1_id", by).join(n(kept, "before"), "s1_id", "left").join(n(added, "new"), "s1_id", "left").na.fill(0, ["before", "new"])
    stages = F.array(F.struct(F.lit("before").alias("stage"), F.col("before").alias("k")), F.struct(F.lit("after").alias("stage"), (F.col("before") + F.col("new")).alias("k")), F.struct(F.when(F.col("new") > 0, "receivers").alias("stage"), F.col("before").alias("k")))
    long = x.select(by, F.inline(stages)).where("stage IS NOT NULL")
    return long.groupBy(by, "stage").agg(F.count("*").alias("n"), F.avg("k").alias("mean"), *[F.avg((F.least("k", F.lit(6)) == i).cast("double")).alias(f"k{i}") for i in range(7)])


def zone_changes(scores: DataFrame, limit: float = 0.75, low: float = 0.1, high: float = 0.995) -> DataFrame:
    """s1_id, m_id, action: what a new score (p_new) changes in the decision when it counts only for the best pairs of their record with p in [low, high]."""
    def chosen(c: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("m_id").orderBy(F.desc(c), "s1_id"))
        return scores_.withColumn("_r", rank).where((F.col("_r") == 1) & (F.col(c) >= limit)).select("s1_id", "m_id")

    first = F.row_number().over(Window.partitionBy("m_id").orderBy(F.desc("p"), "s1_id"))
    zone = (first == 1) & F.col("p").between(low, high) & F.col("p_new").isNotNull()
    scores_ = scores.withColumn("p_zone", F.when(zone, F.col("p_new")).otherwise(F.col("p")))
    old, new = chosen("p"), chosen("p_zone")
    return new.join(old, ["s1_id", "m_id"], "left_anti").withColumn("action", F.lit("add")).unionByName(old.join(new, ["s1_id", "m_id"], "left_anti").withColumn("action", F.lit("remove")))


# shapes of count histograms: a table of at most nine counts comes to the driver

def histogram(counts: DataFrame, column: str, cells: int = 9) -> np.ndarray:
    """How many rows have the count 0, 1, ..., cells - 1 or more."""
    rows = counts.groupBy(F.least(F.col(column), F.lit(cells - 1)).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
    out = np.zeros(cells)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


def false_share(reference: np.ndarray, observed: np.ndarray) -> float:
    """The share of false pairs in a class, from the record counts of its s1: between the size-biased reference (true copies) and the reference moved up by one (false pairs), by least squares."""
    ref, obs = reference / reference.sum(), observed / observed.sum()
    true = np.arange(len(ref)) * ref
    true /= true.sum()
    false = np.concatenate([[0.0], ref[:-1]])
    false[-1] += ref[-1]
    x = (false / false.sum() - true)[1:]
    return float(np.clip((obs - true)[1:] @ x / (x @ x), -0.5, 1.5))


def removal_share(general: np.ndarray, after: np.ndarray, real: np.ndarray, steps: int = 2001) -> tuple[float, float, float]:
    """The share of false pairs among removals (with an interval of 1.92 in log likelihood): the counts after the removal are a mixture of the general ones and those that the removal of real copies leaves."""
    f, g, r = np.linspace(0, 1, steps)[:, None], general / general.sum(), real / real.sum()
    value = np.log(np.maximum(f * g + (1 - f) * r, 1e-9)) @ after
    good = np.flatnonzero(value >= value.max() - 1.92)
    return float(f[value.argmax(), 0]), float(f[good[0], 0]), float(f[good[-1], 0])


def _binomials(top: int, r: float) -> np.ndarray:
    """[n, k]: the chance of k of n at r each."""
    out = np.zeros((top + 1, top + 1))
    out[0, 0] = 1.0
    for n in range(1, top + 1):
        out[n] = out[n - 1] * (1 - r)
        out[n, 1:] += out[n - 1, :-1] * r
    return out


def _poisson(mean: float, n: int) -> np.ndarray:
    k = np.arange(1, n)
    return np.exp(-mean + np.concatenate([[0.0], np.cumsum(np.log(max(mean, 1e-300) / k))]))


def count_law(truth: np.ndarray, recall: float, false: float, lost: float, cells: int) -> np.ndarray:
    """The law of the kept counts: with chance `lost` an s1 loses all its records, else each stays with chance `recall`; Poisson false pairs come on top."""
    kept = (1 - lost) * truth @ _binomials(len(truth) - 1, recall)
    kept[0] += lost
    every = np.convolve(kept, _poisson(false, 40))
    return np.append(every[: cells - 1], max(1 - every[: cells - 1].sum(), 1e-12))


def fit_counts(observed: np.ndarray, truth: np.ndarray) -> tuple[float, float, float]:
    """(recall, false pairs per entity, share of lost entities) by maximum likelihood, on a grid that narrows around its best point."""
    t = truth / truth.sum()
    low, high = np.array([0.8, 0.0, 0.0]), np.array([1.0, 0.5, 0.1])
    best = (low + high) / 2
    for _ in range(7):
        axes = [np.linspace(a, b, 9) for a, b in zip(low, high)]
        value, best = max(((float(observed @ np.log(np.maximum(count_law(t, r, f, z, len(observed)), 1e-12))), np.array([r, f, z])) for r in axes[0] for f in axes[1] for z in axes[2]), key=lambda x: x[0])
        width = (high - low) / 4
        low, high = np.maximum(best - width, [0.8, 0.0, 0.0]), np.minimum(best + width, [1.0, 0.5, 0.1])
    return tuple(map(float, best))


def expected_score(truth: np.ndarray, recall: float, false: float, lost: float) -> float:
    """The expected F0.5 of an entity under `count_law`."""
    t, fp = truth / truth.sum(), _poisson(false, 40)
    law, out = _binomials(len(t) - 1, recall), t[0] * fp[0]
    for n in range(1, len(t)):
        for tp in range(1, n + 1):
            k = np.arange(len(fp))
            out += t[n] * (1 - lost) * law[n, tp] * float(fp @ (1.25 * tp / (tp + k + 0.25 * n)))
    return float(out)


def scan_thresholds(scored: DataFrame, entities: DataFrame, truth: np.ndarray, grid: list[float]) -> Iterator[tuple[float, float, float, float, float]]:
    """(threshold, recall, false, lost, expected score) of the one-owner pairs at each threshold, without labels."""
    best = Window.partitionBy("m_id").orderBy(F.desc("p"), "s1_id")
    own = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    steps = sorted(grid)
    per = own.groupBy("s1_id").agg(*[F.count(F.when(F.col("p") >= t, 1)).alias(f"k{i}") for i, t in enumerate(steps)])
    x = entities.select("s1_id").join(per, "s1_id", "left").na.fill(0)
    # one job: each threshold's histogram has nine cells
    cells = x.agg(*[F.count(F.when(F.least(f"k{i}", F.lit(8)) == k, 1)).alias(f"c{i}_{k}") for i in range(len(steps)) for k in range(9)]).head()
    for i, t in enumerate(steps):
        fit = fit_counts(np.array([cells[f"c{i}_{k}"] for k in range(9)], dtype=float), truth)
        yield (t, *fit, expected_score(truth, *fit))


def mistakes(scored: DataFrame, decided: DataFrame, truth: DataFrame) -> DataFrame:
    """s1_id, m_id, kind: false positives, misses among candidates (outranked or below the threshold), and true pairs that were no candidates."""
    keys = ["s1_id", "m_id"]
    fp = decided.select(*keys).join(truth.select(*keys), keys, "left_anti").withColumn("kind", F.lit("false"))
    rank = F.row_number().over(Window.partitionBy("m_id").orderBy(F.desc("p"), "s1_id"))
    missed = scored.withColumn("r", rank).join(truth.select(*keys), keys, "left_semi").join(decided.select(*keys), keys, "left_anti").select(*keys, F.when(F.col("r") > 1, "outranked").otherwise("below").alias("kind"))
    absent = truth.select(*keys).join(scored.select(*keys), keys, "left_anti").withColumn("kind", F.lit("no candidate"))
    return fp.unionByName(missed).unionByName(absent)
