"""From scores to sets: at most one owner, thresholds, expected-F sets, and the F0.5 of a prediction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_owner(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Each record with its best s1 only; ties to the smaller s1_id."""
    best = Window.partitionBy("m_id").orderBy(F.desc(p), "s1_id")
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def above(pairs: DataFrame, threshold: float | dict[str, float], by: str = "country", p: str = "p") -> DataFrame:
    """Pairs at or above a threshold, one for all or one for each group."""
    if isinstance(threshold, dict):
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in threshold.items() for x in kv]), F.col(by))
        return pairs.where(F.col(p) >= limit)
    return pairs.where(F.col(p) >= threshold)


def group_thresholds(pairs: DataFrame, table: dict[str, float], default: float, group: str = "grp", support: str = "sup") -> Column:
    """The threshold of `grp|sup` if there is one, else of `grp`, else the default; above 1 drops the group."""
    values = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(values, F.concat_ws("|", group, support)), F.try_element_at(values, F.col(group)), F.lit(default))


def expected_f(pairs: DataFrame, misses: float = 0.0, p: str = "p") -> DataFrame:
    """The prefix of each s1's pairs, by falling p, with the largest expected F0.5; none if an empty set is expected to score more."""
    order = Window.partitionBy("s1_id").orderBy(F.desc(p), "m_id")
    run, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("s1_id")
    x = pairs.withColumn("_k", F.row_number().over(order)).withColumn("_f", 1.25 * F.sum(p).over(run) / (F.col("_k") + 0.25 * (F.sum(p).over(whole) + misses)))
    empty = F.exp(F.sum(F.log(F.greatest(1 - F.col(p), F.lit(1e-12)))).over(whole) - misses)
    x = x.withColumn("_best", F.max("_f").over(whole)).withColumn("_empty", empty)
    x = x.withColumn("_stop", F.min(F.when(F.col("_f") == F.col("_best"), F.col("_k"))).over(whole))
    return x.where("_best > _empty AND _k <= _stop").select(*pairs.columns)


def expected_f_exact(pairs: DataFrame, misses: float = 0.0) -> DataFrame:
    """The same choice by the exact law of the number of true pairs (Poisson-binomial); one s1's pairs at a time.

    Every prefix is tried, whatever the number of pairs.
    """
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "m_id"], ascending=[False, True], ignore_index=True)
        p = pdf["p"].to_numpy(float)
        f = prefix_f(p, misses)
        k = int(np.argmax(f)) + 1
        return pdf.head(k if f[k - 1] > float(np.prod(1 - p) * np.exp(-misses)) + 1e-12 else 0)

    return pairs.select("s1_id", "m_id", F.col("p").cast("double").alias("p")).groupBy("s1_id").applyInPandas(choose, pairs.select("s1_id", "m_id", F.col("p").cast("double")).schema)


def prefix_f(p: np.ndarray, misses: float, block: int = 4096) -> np.ndarray:
    """Expected F0.5 of each prefix of p: E[1.25 t / (k + 0.25 (t + u + misses))], t and u true pairs inside and outside of it.

    With 1 / c as the integral of exp(-c x) over x > 0 this is 5 times the integral of exp(-(4 k + misses) x) W(x) A(k, x),
    where W is the product over all pairs of 1 - p + p s, A the sum over the prefix of p s / (1 - p + p s), s = exp(-x).
    Panels of 24 Gauss-Legendre nodes that double in width give it to rounding, in time linear in the pairs.
    """
    nodes, weights = np.polynomial.legendre.leggauss(24)
    ends = [0.0, 1.0 / (5 * len(p) + misses + 1)]
    while ends[-1] < 60:
        ends.append(2 * ends[-1])
    low, half = np.array(ends[:-1])[:, None], np.diff(ends)[:, None] / 2
    x, w = (low + half * (nodes + 1)).ravel(), (half * weights).ravel()
    s, log_all, inside, out = np.exp(-x), np.zeros(len(x)), np.zeros(len(x)), []
    blocks = [p[i : i + block] for i in range(0, len(p), block)]
    for q in blocks:
        log_all += np.log(1 - q[:, None] + q[:, None] * s).sum(axis=0)
    for i, q in enumerate(blocks):
        a = inside + np.cumsum(q[:, None] * s / (1 - q[:, None] + q[:, None] * s), axis=0)
        k = i * block + 1 + np.arange(len(q))
        out.append(5 * (np.exp(log_all - (4 * k[:, None] + misses) * x) * a) @ w)
        inside = a[-1]
    return np.concatenate(out)


def entity_table(pairs: DataFrame, p: str = "p") -> DataFrame:
    """What a model of 'has a match' sees of an s1; columns of further features, where there are any, by their largest value."""
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(p), "m_id")))
    further = [c for c in ("cos_comb", "cos_name", "cos_addr") if c in pairs.columns]
    first = [c for c in ("s1_same_name", "f_num_share") if c in pairs.columns]
    return ranked.groupBy("s1_id").agg(
        F.count("*").alias("n"), F.max(p).alias("p1"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(p))), F.lit(0.0)).alias("p2"), F.sum(p).alias("total"), F.avg(p).alias("mean"), F.count(F.when(F.col(p) >= 0.5, 1)).alias("n50"), F.count(F.when(F.col(p) >= 0.9, 1)).alias("n90"),
        *[F.max(c).alias(f"{c}_max") for c in further], *[F.max(F.when(F.col("_r") == 1, F.col(c))).alias(f"{c}_top") for c in first],
    )


def expected_f_entity(pairs: DataFrame, p_match: DataFrame, misses: float = 0.05, p: str = "p") -> DataFrame:
    """As `expected_f`, with the probability `p_match` that the s1 has a match at all (0.5 where it is not known) from a model of its own."""
    order = Window.partitionBy("s1_id").orderBy(F.desc(p), "m_id")
    run, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("s1_id")
    x = pairs.join(p_match.select("s1_id", F.col("p_match").alias("_m")), "s1_id", "left").withColumn("_m", F.coalesce("_m", F.lit(0.5))).withColumn("_c", F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6)))
    some = F.least(F.greatest(1 - F.exp(F.sum(F.log(1 - F.col("_c"))).over(whole)), F.lit(1e-6)), F.lit(1.0))
    x = x.withColumn("_q", F.least(F.col("_c") / some, F.lit(1.0))).withColumn("_k", F.row_number().over(order))
    x = x.withColumn("_f", F.col("_m") * 1.25 * F.sum("_q").over(run) / (F.col("_k") + 0.25 * (F.sum("_q").over(whole) + misses)))
    x = x.withColumn("_best", F.max("_f").over(whole)).withColumn("_stop", F.min(F.when(F.col("_f") == F.col("_best"), F.col("_k"))).over(whole))
    return x.where("_best > 1 - _m AND _k <= _stop").select(*pairs.columns)


def entity_f05(entities: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """F0.5 of each s1: 1 for two empty sets, 0 if only one is empty or nothing is right."""
    np_, nt = (x.select("s1_id", "m_id").distinct().groupBy("s1_id").agg(F.count("*").alias(n)) for x, n in ((predicted, "n_pred"), (truth, "n_true")))
    hit = predicted.select("s1_id", "m_id").distinct().join(truth.select("s1_id", "m_id").distinct(), ["s1_id", "m_id"], "left_semi").groupBy("s1_id").agg(F.count("*").alias("hits"))
    x = entities.select("s1_id").distinct().join(np_, "s1_id", "left").join(nt, "s1_id", "left").join(hit, "s1_id", "left").na.fill(0)
    f = F.when((F.col("n_pred") == 0) & (F.col("n_true") == 0), 1.0).when(F.col("hits") == 0, 0.0).otherwise(1.25 * F.col("hits") / (F.col("n_pred") + 0.25 * F.col("n_true")))
    return x.withColumn("f05", f)


def macro_f05(entities: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return entity_f05(entities, predicted, truth).agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("entities"))


def threshold_sweep(labelled: DataFrame, grid: list[float], p: str = "p", y: str = "y") -> DataFrame:
    """Pairs, hits, precision and recall at each threshold: one pass over the pairs, each counted in its band, then running sums over the grid."""
    steps = sorted(grid)
    at = labelled.select(sum(((F.col(p) >= t).cast("int") for t in steps), F.lit(0)).alias("step"), F.col(y).alias("y")).groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    grid_df = labelled.sparkSession.createDataFrame(list(enumerate(steps, 1)), "step int, threshold double")
    # as many rows as thresholds
    after = Window.orderBy(F.desc("step"))
    filled = grid_df.join(F.broadcast(at), "step", "left").select("step", "threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))
    total = labelled.agg(F.sum(y).alias("total"))
    run = filled.select("threshold", F.sum("n").over(after).alias("n"), F.sum("hits").over(after).cast("bigint").alias("hits")).join(F.broadcast(total))
    return run.select("threshold", "n", "hits", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("precision"), (F.col("hits") / F.col("total")).alias("recall"))


def half_of(column: str = "s1_id") -> Column:
    """0 or 1 for each entity, by a hash that DuckDB has as well."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("long") % 2


def halves_sweep(entities: DataFrame, scored: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """threshold, half, macro_f05 of the one-owner pairs, for both halves of the entities: a choice on one half is confirmed on the other."""
    steps = sorted(grid)
    best = one_owner(scored).join(truth.select("s1_id", "m_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "m_id"], "left").withColumn("step", sum(((F.col("p") >= t).cast("int") for t in steps), F.lit(0)))
    # counts by entity and band, then running sums over the few bands
    bands = best.where("step > 0").groupBy("s1_id", "step").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    nt = truth.select("s1_id", "m_id").distinct().groupBy("s1_id").agg(F.count("*").alias("n_true"))
    grid_df = F.broadcast(scored.sparkSession.createDataFrame(list(enumerate(steps, 1)), "at int, threshold double"))
    # an entity has as many rows as thresholds
    e = entities.select("s1_id").distinct().join(nt, "s1_id", "left").na.fill(0, ["n_true"]).withColumn("half", half_of()).join(grid_df)
    x = e.join(bands, "s1_id", "left").groupBy("threshold", "half", "s1_id", "n_true").agg(F.coalesce(F.sum(F.when(F.col("step") >= F.col("at"), F.col("n"))), F.lit(0)).alias("n_pred"), F.coalesce(F.sum(F.when(F.col("step") >= F.col("at"), F.col("hits"))), F.lit(0)).alias("hits"))
    return x.groupBy("threshold", "half").agg(F.avg(f05(F.col("hits"), F.col("n_pred"), F.col("n_true"))).alias("macro_f05"))


def f05(hits: Column, n_pred: Column, n_true: Column) -> Column:
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(hits == 0, 0.0).otherwise(1.25 * hits / (n_pred + 0.25 * n_true))


def look_alikes(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """s1_id, k: unmatched records with the state and core name of the s1."""
    free = pool.join(truth.select(F.col("m_id").alias("entity_id")), "entity_id", "left_anti").groupBy("addr_state", "name_core").agg(F.count("*").alias("k"))
    return s1.select("entity_id", "addr_state", "name_core").join(free, ["addr_state", "name_core"], "left").select(F.col("entity_id").alias("s1_id"), F.coalesce("k", F.lit(0)).alias("k"))


def report(scores: DataFrame, entities: DataFrame) -> DataFrame:
    """The macro F0.5 as it is, weighted by 2 to the power of the look-alikes (at most 3), of s1 with look-alikes, of s1 without and with matches, by country and over all.

    scores: s1_id, n_true, f05; entities: s1_id, country, k.
    """
    w = F.pow(F.lit(2.0), F.least("k", F.lit(3)))
    x = scores.join(entities, "s1_id").withColumn("w", w)
    measures = [
        F.avg("f05").alias("macro_f05"), (F.sum(F.col("f05") * F.col("w")) / F.sum("w")).alias("weighted_f05"), F.avg(F.when(F.col("k") >= 1, F.col("f05"))).alias("look_alike_f05"),
        F.avg((F.col("k") >= 1).cast("double")).alias("look_alike_share"), F.avg(F.when(F.col("n_true") == 0, F.col("f05"))).alias("singleton_f05"), F.avg(F.when(F.col("n_true") > 0, F.col("f05"))).alias("matched_f05"), F.count("*").alias("entities"),
    ]
    return x.rollup("country").agg(*measures).withColumn("country", F.coalesce("country", F.lit("all")))


def saerens(scores: DataFrame, prior: float, p: str = "p", rounds: int = 100, tolerance: float = 1e-7, bins: int = 10_000) -> float:
    """The share of matches in new scores, by expectation-maximisation over a histogram of the scores: one pass, at most `bins` rows on the driver."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    held = scores.select(q.alias("q")).groupBy(F.floor(F.col("q") * bins)).agg(F.count("*").alias("n"), F.avg("q").alias("q")).select("q", "n").toPandas()
    if not len(held):
        return prior
    x, n, now = held["q"].to_numpy(float), held["n"].to_numpy(float), prior
    for _ in range(rounds):
        r = (now / prior) / ((1 - now) / (1 - prior))
        new = float(np.average(r * x / (r * x + 1 - x), weights=n))
        # an end of the range would be no prior
        new = min(max(new, 1e-9), 1 - 1e-9)
        if abs(new - now) < tolerance:
            return new
        now = new
    return now


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, draws: int, salt: int) -> np.ndarray:
    """A number in [0, 1) for each key and draw, from the key alone."""
    h = _mix(keys.astype(np.int64).view(np.uint64)[:, None] + _mix(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def poissons(u: np.ndarray, mean: float) -> np.ndarray:
    """The Poisson numbers with these ranks."""
    k = np.arange(1, 200)
    law = np.cumsum(np.exp(np.concatenate([[-mean], -mean + np.cumsum(np.log(mean / k))]))) if mean > 0 else np.ones(1)
    return np.minimum(np.searchsorted(law, u, side="right"), len(law))


def bootstrap_gain(gains: DataFrame, draws: int = 200, seed: int = 1) -> DataFrame:
    """Mean gain per s1 with a 95 % interval by Poisson bootstrap: one pass, each row weighted in every draw by a hash of its id."""
    def draw(batches):
        s = np.zeros((draws, 2))
        for pdf in batches:
            w = poissons(uniforms(pdf["h"].to_numpy(), draws, seed), 1.0)
            s[:, 0] += pdf["gain"].to_numpy(float) @ w
            s[:, 1] += w.sum(axis=0)
        yield pd.DataFrame({"draw": np.arange(draws), "total": s[:, 0], "weight": s[:, 1]})

    sums = gains.select(F.xxhash64("s1_id").alias("h"), F.col("gain").cast("double")).mapInPandas(draw, "draw int, total double, weight double").groupBy("draw").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("mean"))
    return sums.agg(F.avg("mean").alias("mean"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def monte_carlo_f(pairs: DataFrame, misses: float, draws: int = 100, seed: int = 1, rows: int = 100_000) -> DataFrame:
    """Expected F0.5 of each s1's predicted pairs (column `predicted`) when each pair is true with probability p and missed pairs are Poisson.

    Give all scored pairs: those that are not predicted are misses where they are true. An empty prediction scores 1
    where nothing is true. Every draw of a pair comes from a hash of its ids, so the pairs of an s1 are cut into parts
    of about `rows`, whose counts are added: no task holds a hot s1.
    """
    sizes = pairs.groupBy("s1_id").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    x = pairs.join(sizes, "s1_id").select("s1_id", F.xxhash64("s1_id").alias("g"), F.xxhash64("s1_id", "m_id").alias("h"), F.pmod(F.xxhash64("m_id"), F.col("parts")).alias("part"), F.col("p").cast("double").alias("p"), "predicted")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        true = uniforms(pdf["h"].to_numpy(), draws, seed) < pdf["p"].to_numpy(float)[:, None]
        chosen = pdf["predicted"].to_numpy(bool)
        return pd.DataFrame({"s1_id": pdf["s1_id"].iloc[:1], "g": pdf["g"].iloc[:1], "n": [int(chosen.sum())], "hits": [true[chosen].sum(axis=0).tolist()], "true": [true.sum(axis=0).tolist()]})

    kind = pairs.schema["s1_id"].dataType.simpleString()
    counted = x.groupBy("s1_id", "part").applyInPandas(count, f"s1_id {kind}, g long, n long, hits array<long>, true array<long>")
    added = lambda c: F.aggregate(F.collect_list(c), F.array_repeat(F.lit(0).cast("long"), draws), lambda s, v: F.zip_with(s, v, lambda i, j: i + j))
    # as many arrays an s1 as it has parts
    total = counted.groupBy("s1_id").agg(F.first("g").alias("g"), F.sum("n").alias("n"), added("hits").alias("hits"), added("true").alias("true"))

    def score(batches):
        for pdf in batches:
            hits, n = (np.stack(pdf[c].to_numpy()) if len(pdf) else np.zeros((0, draws)) for c in ("hits", "true")), pdf["n"].to_numpy(float)[:, None]
            hits, true = hits
            every = true + poissons(uniforms(pdf["g"].to_numpy(), draws, seed + 1), misses)
            f = np.where(every == 0, (n == 0).astype(float), 1.25 * hits / np.maximum(n + 0.25 * every, 1e-12))
            yield pd.DataFrame({"s1_id": pdf["s1_id"], "f05": f.mean(axis=1)})

    return total.mapInPandas(score, f"s1_id {kind}, f05 double")
