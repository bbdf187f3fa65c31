"""Records of the sources to normalised records: names, addresses, missing states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X

#: What normalisation adds to entity_id, business_name, business_address and country.
NORMALISED = ["name_core", "name_legal", "name_alts", "name_phon", "name_is_domain", "name_has_alt", "name_non_latin", "addr_text", "addr_state", "addr_nums", "addr_empty", "addr_native_state"]


def normalised_names(names: DataFrame) -> DataFrame:
    """The name columns for each distinct business_name."""
    x = names.select("business_name").distinct()
    x = x.withColumn("_ascii", X.any_script(F.col("business_name"))).withColumn("name_non_latin", X.non_latin(F.col("business_name")))
    raw, plain = X.name_parts(F.col("business_name")), X.name_parts(F.col("_ascii"))
    # a part is judged by its own script, the name by the whole
    x = x.withColumn("_parts", F.transform(F.arrays_zip(plain.alias("a"), raw.alias("r")), lambda p: X.split_name(p["a"], X.non_latin(p["r"]))))
    x = x.withColumn("_main", F.coalesce(F.try_element_at("_parts", F.lit(1)), F.struct(F.lit("").alias("core"), F.lit("").alias("legal"))))
    alts = F.filter(F.transform(F.slice("_parts", 2, 100), lambda p: p["core"]), lambda c: (c != "") & (c != F.col("_main.core")))
    return x.select(
        "business_name", F.col("_main.core").alias("name_core"), F.col("_main.legal").alias("name_legal"), F.array_join(alts, "|").alias("name_alts"), X.phonetic(F.col("_main.core")).alias("name_phon"),
        F.coalesce(X.is_domain(X.strip_tags(F.try_element_at(plain, F.lit(1)))), F.lit(False)).alias("name_is_domain"), (F.size(alts) > 0).alias("name_has_alt"), F.coalesce("name_non_latin", F.lit(False)).alias("name_non_latin"),
    )


def address_components(addresses: DataFrame) -> DataFrame:
    """business_address, country and `parts` (see text.address_parts) of each distinct address."""
    x = addresses.select("business_address", "country").distinct().withColumn("_ascii", X.any_script(F.col("business_address")))
    return x.select("business_address", "country", X.address_parts(F.col("business_address"), F.col("_ascii"), F.col("country")).alias("parts"))


def normalised_addresses(addresses: DataFrame) -> DataFrame:
    """The address columns for each distinct pair of business_address and country."""
    x = address_components(addresses)
    return x.select("business_address", "country", *[c.alias(n) for n, c in X.canonical_address(F.col("parts")).items()], F.coalesce(F.col("business_address").rlike("[\\u0901-\\uFFFF]"), F.lit(False)).alias("addr_native_state"))


def normalise(records: DataFrame) -> DataFrame:
    """Records with the columns NORMALISED. Each distinct name and address is worked on once and joined back; a null is its own value."""
    out = records
    for table, keys in ((normalised_names(records), ["business_name"]), (normalised_addresses(records), ["business_address", "country"])):
        renamed = table.withColumnsRenamed({k: f"_{k}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])
    return out.select(*records.columns, *NORMALISED)


def state_words(s1: DataFrame, support: int = 20, purity: float = 0.97) -> DataFrame:
    """word, says: address words (three letters or more, no numbers) that nearly always go with one state."""
    words = s1.where("addr_state <> ''").select("country", F.col("addr_state").alias("state"), F.explode(F.array_distinct(X.tokens(F.col("addr_text")))).alias("word"))
    seen = words.where("length(word) >= 3 AND NOT word RLIKE '^[0-9]+$'").groupBy("country", "word", "state").agg(F.count("*").alias("n"))
    best = seen.groupBy("country", "word").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.max_by("state", F.struct("n", "state")).alias("says"))
    return best.where((F.col("total") >= support) & (F.col("top") / F.col("total") >= purity)).select("country", "word", "says")


def infer_states(records: DataFrame, words: DataFrame, share: float = 0.8) -> DataFrame:
    """Records with a state for those that have an address and none, where `share` of their telling words agree; its code goes behind the address."""
    need = records.where("addr_state = '' AND addr_text <> ''").select("entity_id", "country", F.explode(F.array_distinct(X.tokens(F.col("addr_text")))).alias("word"))
    votes = need.join(words, ["country", "word"]).groupBy("entity_id", "says").agg(F.count("*").alias("n"))
    best = votes.groupBy("entity_id").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.max_by("says", F.struct("n", "says")).alias("inferred"))
    x = records.join(best.where(F.col("top") / F.col("total") >= share).select("entity_id", "inferred"), "entity_id", "left")
    filled = {"addr_state": F.coalesce("inferred", "addr_state"), "addr_text": F.when(F.col("inferred").isNotNull(), F.concat_ws(" ", "addr_text", "inferred")).otherwise(F.col("addr_text"))}
    return x.withColumns(filled).drop("inferred")


def search_texts(records: DataFrame) -> dict[str, Column]:
    """What the search paths compare: the name with its alternatives, its sound, the address, the name in one word."""
    core = F.col("name_core")
    return {
        "name": F.trim(F.concat_ws(" ", core, F.replace(F.col("name_alts"), F.lit("|"), F.lit(" ")))), "phon": F.col("name_phon"), "addr": F.col("addr_text"),
        "cat": F.replace(F.regexp_replace(core, "\\b(and|the|of)\\b", ""), F.lit(" "), F.lit("")),
    }
