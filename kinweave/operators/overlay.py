"""Match files (s1_id, m_id): additions, removals, moves, ordered deltas, and the checks that must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["s1_id", "m_id"]


def add_only(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """New pairs whose record is free; of several for a record the smallest s1_id."""
    free = new.select(*PAIR).join(pairs, "m_id", "left_anti").groupBy("m_id").agg(F.min("s1_id").alias("s1_id"))
    return pairs.select(*PAIR).unionByName(free.select(*PAIR))


def remove(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    return pairs.join(gone.select(*PAIR).distinct(), PAIR, "left_anti")


def move(pairs: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (m_id, from_id, to_id) of records that still belong to from_id."""
    valid = moves.join(pairs, [moves["m_id"] == pairs["m_id"], moves["from_id"] == pairs["s1_id"]], "left_semi")
    return pairs.join(valid.select("m_id"), "m_id", "left_anti").select(*PAIR).unionByName(valid.select(F.col("to_id").alias("s1_id"), "m_id"))


def drop_band(pairs: DataFrame, scores: DataFrame, low: float, high: float) -> DataFrame:
    """Without the pairs whose score lies in [low, high)."""
    return remove(pairs, scores.where((F.col("p") >= low) & (F.col("p") < high)))


def overlay(pairs: DataFrame, changes: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Changes (s1_id, m_id, action): removals first, then additions of free records that are not blocked."""
    kept, added = remove(pairs, changes.where("action = 'remove'")), changes.where("action = 'add'")
    return add_only(kept, remove(added, blocked) if blocked is not None else added)


def overlay_counts(pairs: DataFrame, entities: DataFrame, changes: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """action, outcome, n: what `overlay` does with each change (s1_id, m_id, action, src), removals first."""
    present = pairs.select(*PAIR, F.lit(True).alias("here"))
    gone = changes.where("action = 'remove'").join(present, PAIR, "left").withColumn("outcome", F.when(F.col("here"), "applied").otherwise("not present"))
    kept = remove(pairs, changes.where("action = 'remove'")).select("m_id", F.lit(True).alias("held")).distinct()
    stop = (blocked.select("m_id") if blocked is not None else pairs.select("m_id").limit(0)).distinct().withColumn("stop", F.lit(True))
    x = changes.where("action = 'add'").join(entities.select("s1_id").distinct().withColumn("known", F.lit(True)), "s1_id", "left").join(kept, "m_id", "left").join(stop, "m_id", "left")
    first = F.row_number().over(Window.partitionBy("m_id").orderBy("s1_id"))
    x = x.withColumn("outcome", F.when(F.col("known").isNull(), "unknown entity").when(F.col("held"), "record assigned").when(F.col("stop"), "blocked").when(first > 1, "record assigned").otherwise("applied"))
    return gone.select("src", "action", "outcome").unionByName(x.select("src", "action", "outcome")).groupBy("src", "action", "outcome").agg(F.count("*").alias("n"))


def apply_deltas(pairs: DataFrame, deltas: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Removals and additions one after another; fails if a record has two owners after any of them."""
    out = pairs.select(*PAIR)
    for gone, new in deltas:
        owners = F.count("*").over(Window.partitionBy("m_id"))
        checked = remove(out, gone).unionByName(new.select(*PAIR)).distinct().withColumn("_n", owners)
        out = checked.select("s1_id", F.when(F.col("_n") == 1, F.col("m_id")).otherwise(F.raise_error(F.lit("a record has two owners"))).alias("m_id"))
    return out


def merge_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select(*PAIR).unionByName(new.select(*PAIR)).distinct()


def swap_rows(a: DataFrame, b: DataFrame, from_b: Column) -> DataFrame:
    """Rows of `a`, with those for which the condition holds taken from `b`; where it is null the row of `a` stays."""
    sure = F.coalesce(from_b, F.lit(False))
    return a.where(~sure).unionByName(b.where(sure))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """s1_id, m_id, action that turn one file into the other."""
    return remove(before, after).select(*PAIR, F.lit("remove").alias("action")).unionByName(remove(after, before).select(*PAIR, F.lit("add").alias("action")))


def violations(entities: DataFrame, pairs: DataFrame, candidates: DataFrame, prefixes: tuple[str, ...] = ("S2", "S3")) -> DataFrame:
    """rule, n: how often each integrity rule is broken; all zero for a good file."""
    twice = pairs.groupBy(*PAIR).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("pair repeated").alias("rule"), "n")
    owners = pairs.groupBy("m_id").agg(F.countDistinct("s1_id").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("record with two owners").alias("rule"), "n")
    outside = remove(pairs, candidates).agg(F.count("*").alias("n")).select(F.lit("not a candidate").alias("rule"), "n")
    unknown = pairs.join(entities.select("s1_id").distinct(), "s1_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown entity").alias("rule"), "n")
    prefix = pairs.where(~F.substring(F.col("m_id").cast("string"), 1, 2).isin(*prefixes)).agg(F.count("*").alias("n")).select(F.lit("wrong prefix").alias("rule"), "n")
    rows = entities.groupBy("s1_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("entity repeated").alias("rule"), "n")
    return twice.unionByName(owners).unionByName(outside).unionByName(unknown).unionByName(prefix).unionByName(rows)


def unscored(pairs: DataFrame, done: DataFrame, least: float | None = None) -> DataFrame:
    """Pairs that another run never scored."""
    rest = remove(pairs, done)
    return rest.where(F.col("p") >= least) if least is not None else rest


def country_violations(s1: DataFrame, records: DataFrame, pairs: DataFrame) -> DataFrame:
    """rule, n: records that do not exist, pairs across countries."""
    x = pairs.join(s1.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("ca")), "s1_id", "left").join(records.select(F.col("entity_id").alias("m_id"), F.col("country").alias("cb")), "m_id", "left")
    one = x.agg(F.count(F.when(F.col("cb").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("ca") != F.col("cb"), 1)).alias("across"))
    return one.select(F.inline(F.array(F.struct(F.lit("unknown record").alias("rule"), F.col("unknown").alias("n")), F.struct(F.lit("pair across countries").alias("rule"), F.col("across").alias("n")))))


def match_histogram(s1: DataFrame, pairs: DataFrame, most: int = 8) -> DataFrame:
    """country, k, entities: how many s1 have k records (`most` or more as `most`)."""
    n = pairs.groupBy("s1_id").agg(F.countDistinct("m_id").alias("k"))
    x = s1.select(F.col("entity_id").alias("s1_id"), "country").join(n, "s1_id", "left")
    return x.groupBy("country", F.least(F.coalesce("k", F.lit(0)), F.lit(most)).cast("long").alias("k")).agg(F.count("*").alias("entities"))


def restore_shifts(pairs: DataFrame, scored: DataFrame, country: str = "India", groups: tuple[str, ...] = ("shift_pure", "shift_ms_only"), least: float = 0.98) -> DataFrame:
    """Sure pairs of one country that a rule on shifted numbers took out: best of their record, p >= least, no decoy word, not in the file.

    scored: s1_id, m_id, p, country, grp, decoy_word.
    """
    best = Window.partitionBy("m_id").orderBy(F.desc("p"), "s1_id")
    sure = scored.withColumn("_r", F.row_number().over(best)).where((F.col("_r") == 1) & (F.col("country") == country) & F.col("grp").isin(*groups) & (F.col("p") >= least) & ~F.coalesce("decoy_word", F.lit(False)))
    return remove(sure.select(*PAIR), pairs)


def accept_new(scored: DataFrame, new: DataFrame, used: DataFrame, threshold: Column, least: float) -> DataFrame:
    """New pairs that are the best of their record among all scored ones, whose record is free, and that reach the threshold of their group and `least`; one s1 a record."""
    best = Window.partitionBy("m_id").orderBy(F.desc("p"), "s1_id")
    x = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r").join(new.select(*PAIR).distinct(), PAIR, "left_semi")
    return x.join(used.select("m_id").distinct(), "m_id", "left_anti").where((F.col("p") >= threshold) & (F.col("p") >= least))


def density_gate(accepted: DataFrame, entities: DataFrame, reference: float, by: str = "country", most: float = 2.0) -> DataFrame:
    """by, n, per_1000, ratio, flagged: additions per 1000 entities against a reference density."""
    n = accepted.groupBy(by).agg(F.count("*").alias("n"))
    x = entities.groupBy(by).agg(F.count("*").alias("entities")).join(n, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), "entities")
    rate = F.col("n") * 1000.0 / F.col("entities")
    return x.select(by, "n", rate.alias("per_1000"), (rate / reference).alias("ratio"), (rate / reference > most).alias("flagged"))


def select_rules(table: DataFrame, share: float = 0.6, missed: int = 10, ratio: float = 2.0) -> DataFrame:
    """parsed, other: pairs of states whose true partners are mostly in the other one, with enough missed pairs (columns in_alt, in_parsed, alt_missed)."""
    return table.where((F.col("in_alt") >= share) & (F.col("in_alt") > ratio * F.col("in_parsed")) & (F.col("alt_missed") >= missed)).select("parsed", "alt")


def flips(pairs: DataFrame, scores: DataFrame, old_limit: float, new_limit: float, blocked: DataFrame) -> DataFrame:
    """s1_id, m_id, action: what a new score (p_new beside p_old) changes in a file: pairs that fall below the limit go, best pairs of free records that rise above it and are not blocked come."""
    rank = F.row_number().over(Window.partitionBy("m_id").orderBy(F.desc("p_new"), "s1_id"))
    x = scores.withColumn("_r", rank)
    gone = x.where((F.col("p_old") >= old_limit) & (F.col("p_new") < new_limit)).join(pairs, PAIR, "left_semi")
    new = x.where((F.col("p_old") < old_limit) & (F.col("p_new") >= new_limit) & (F.col("_r") == 1)).join(pairs.select("m_id"), "m_id", "left_anti").join(blocked.select(*PAIR), PAIR, "left_anti")
    return gone.select(*PAIR, F.lit("remove").alias("action")).unionByName(new.select(*PAIR, F.lit("add").alias("action")))


def pipeline_union(own: DataFrame, other: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """threshold, n, hits, precision: the pairs that another run scored and this one never did, at each threshold."""
    from kinweave.operators.decide import threshold_sweep

    rest = unscored(other, own).join(truth.select(*PAIR).distinct().withColumn("y", F.lit(1)), PAIR, "left").na.fill(0, ["y"])
    return threshold_sweep(rest, grid).select("threshold", "n", "hits", "precision")
