"""Business records made from the table part, by one SQL text that Spark and DuckDB both read, and their normal forms in DuckDB.

The driver's tables hold no names and addresses of businesses. Each part becomes an S1 record with a name, a legal
form and an address; up to six variants of it become records of S2 and S3: a plain copy, one without legal form and
state, a look-alike with another house number, one with digits for letters, one without address, and a look-alike with
another word in its name. The look-alikes are not matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import places
from kinweave.functions import text as X
from kinweave.operators import records as R
from kinweave.plans.registry import CLEAN_SQL
from kinweave.sources.tables import table
from kinweave.staging import stage


def _pick(words: str, n: str, by: str = " ") -> str:
    return f"split_part('{words}', '{by}', CAST(1 + {n} % {len(words.split(by))} AS INT))"


_K, _THIRD = "p_partkey", "CAST(floor(p_partkey / 3) AS BIGINT)"
_FIRST = _pick("Alpha Balash Crown Dhanvi Everest Ganesh Harbor Imperial Jupiter Kumar Lotus Meridian Noble", _K)
_KIND = "Traders Impex Foods Motors Holding Services Exports Textiles Pharma Steel Group"
_LEGAL = _pick("Ltd,Inc,Pvt Ltd,LLC,Corp,SARL,GmbH,S.A.S,Public Limited,& Co,", f"CAST(floor({_K} / 7) AS BIGINT)", ",")
_STREET = _pick("Main Oak Park Lake Hill Gandhi Station Church Garden River Market Temple", f"({_K} * 5)") + " || ' ' || " + _pick("Street Road Avenue Lane Drive Nagar Marg", f"CAST(floor({_K} / 12) AS BIGINT)")
_COUNTRY = _pick("US India France", _K)
_STATE = f"CASE {_K} % 3 WHEN 0 THEN {_pick('New York,California,Texas,Ohio', _THIRD, ',')} WHEN 1 THEN {_pick('Telangana,Andhra Pradesh,Maharashtra,Kerala', _THIRD, ',')} ELSE {_pick('Ile de France,Bretagne,Normandie,Occitanie', _THIRD, ',')} END"
_CITY = f"CASE {_K} % 3 WHEN 0 THEN {_pick('Albany,Fresno,Austin,Dayton', _THIRD, ',')} WHEN 1 THEN {_pick('Hyderabad,Guntur,Pune,Kochi', _THIRD, ',')} ELSE {_pick('Melun,Rennes,Caen,Nimes', _THIRD, ',')} END"


def _row(prefix: str, variant: int, keep: str) -> str:
    kind = _pick(_KIND, f"({_K} + {1 if variant == 5 else 0})")
    name = f"{_FIRST} || ' ' || p_name || ' ' || {kind}"
    if variant == 3:
        name = f"replace({name}, 'o', '0')"
    if variant != 1:
        name = f"trim({name} || ' ' || {_LEGAL})"
    number = f"CAST(1 + ({_K} * 37) % 900 + {3 if variant == 2 else 0} AS STRING)"
    address = f"{number} || ' ' || {_STREET} || ', ' || {_CITY}" + ("" if variant == 1 else f" || ', ' || {_STATE}")
    if variant == 4:
        address = "''"
    id_ = f"'{prefix}' || CAST({_K} AS STRING)" + ("" if prefix == "S1-" else f" || '-{variant}'")
    return f"SELECT {id_} AS entity_id, {name} AS business_name, {address} AS business_address, {_COUNTRY} AS country, {_K} AS k, {variant} AS variant FROM {{part}} WHERE {keep}"


S1_SQL = _row("S1-", 0, "true")
#: variant, source and which parts have it.
VARIANTS = [(0, "S2-", f"{_K} % 5 <> 0"), (1, "S3-", f"{_K} % 2 = 0"), (2, "S2-", f"{_K} % 3 = 0"), (3, "S3-", f"{_K} % 4 = 1"), (4, "S2-", f"{_K} % 7 = 0"), (5, "S3-", f"{_K} % 3 = 1")]
POOL_SQL = " UNION ALL ".join(_row(s, v, keep) for v, s, keep in VARIANTS)
#: Each record with its own part and two others as candidates.
PAIRS_SQL = "SELECT a.entity_id AS s1_id, b.entity_id AS m_id, CASE WHEN a.k = b.k AND b.variant NOT IN (2, 5) THEN 1 ELSE 0 END AS y FROM {s1} a JOIN (SELECT entity_id, variant, country, k, k + 39 AS k2, k + 3 AS k3 FROM {pool}) b ON a.k = b.k OR a.k = b.k2 OR a.k = b.k3"


def raw_s1(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(S1_SQL, part=table(spark, d, "part"))


def raw_pool(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(POOL_SQL, part=table(spark, d, "part"))


_HELD: dict[tuple[str, str, str], DataFrame] = {}


def held(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """A stage of the linkage that several queries read: written once a session and folder, as the stages of a run are. Joins never broadcast it: its compressed files say little of what its rows take in the driver."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _HELD:
        _HELD[key] = stage(make(), name)[0].hint("merge")
    return _HELD[key]


def s1(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d, "s1", lambda: R.normalise(raw_s1(spark, d)))


def pool(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d, "pool", lambda: R.normalise(raw_pool(spark, d)))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """s1_id, m_id, y of fixed candidate pairs: three equality joins instead of one join on alternatives."""
    a, b = raw_s1(spark, d).select(F.col("entity_id").alias("s1_id"), "k"), raw_pool(spark, d).select(F.col("entity_id").alias("m_id"), "k", "variant")
    out = None
    for step in (0, 39, 3):
        x = a.hint("merge").join(b.withColumn("k", F.col("k") + step), "k").select("s1_id", "m_id", ((F.lit(step) == 0) & ~F.col("variant").isin(2, 5)).cast("int").alias("y"))
        out = x if out is None else out.unionByName(x)
    return out


# the same in DuckDB

def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_map(values: dict[str, str]) -> str:
    return f"MAP({_list(values)}, {_list(values.values())})"


def phonetic_sql(core: str) -> str:
    """`text.phonetic` without look-around: character by character for m, word by word for vowels."""
    chars = f"string_split({core}, '')"
    m = f"array_to_string(list_transform({chars}, lambda c, i: CASE WHEN c = 'm' AND i > 1 AND ({chars})[i - 1] BETWEEN 'a' AND 'z' AND i < len({chars}) AND ({chars})[i + 1] NOT IN ('a', 'e', 'i', 'o', 'u', 'm', ' ') THEN 'n' ELSE c END), '')"
    for a, b in X.PHONETIC:
        m = f"replace({m}, '{a}', '{b}')"
    return f"trim(regexp_replace({_collapse(_inner_vowels(m))}, '\\s+', ' ', 'g'))"


def _inner_vowels(s: str) -> str:
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda w: substr(w, 1, 1) || regexp_replace(substr(w, 2), '[aeiou]', '', 'g')), ' ')"


def _collapse(s: str) -> str:
    return f"list_reduce(list_concat([''], string_split({s}, '')), lambda acc, c: CASE WHEN right(acc, 1) = c THEN acc ELSE acc || c END)"


_DELEET = "CASE WHEN len(t) >= 4 AND len(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 AND len(regexp_replace(t, '[0-9]', '', 'g')) >= 3 THEN translate(t, '013457', 'oleast') ELSE t END"
_PHRASED = CLEAN_SQL.format("business_name")
for _p, _f in X.LEGAL_PHRASES:
    _PHRASED = f"regexp_replace({_PHRASED}, '{_p}', '{_f}', 'g')"
_WORDS = f"list_transform(list_transform(list_filter(string_split({_PHRASED}, ' '), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]{{7,}}$')), lambda t: {_DELEET}), lambda t: CASE WHEN t IN ('et', 'und', 'y') THEN 'and' ELSE t END)"
_FORM = f"""CASE WHEN list_contains({_list(X.LEGAL)}, t) THEN {_sql_map(X.LEGAL)}[t]
    WHEN i = len(w) AND len(w) > 1 AND list_contains({_list(X.LEGAL_LAST)}, t) THEN {_sql_map(X.LEGAL_LAST)}[t] WHEN i = 1 AND len(w) > 1 AND list_contains({_list(X.LEGAL_FIRST)}, t) THEN {_sql_map(X.LEGAL_FIRST)}[t]
    WHEN t = 'public' AND i < len(w) AND w[i + 1] IN ('ltd', 'limited', 'co', 'company') THEN 'public' END"""
_STATES = {c: _sql_map(places.state_codes(c)) for c in ("US", "India", "")}
_PLACE = "trim(regexp_replace(c, '[0-9 ]+', ' ', 'g'))"


def normalised_sql(raw: str) -> str:
    """A SELECT of the normal forms of the records in the view `raw`: Latin script, no alternatives, no web addresses."""
    state = f"coalesce(CASE WHEN {_PLACE} = '' THEN '' WHEN country = 'US' THEN {_STATES['US']}[{_PLACE}] WHEN country = 'India' THEN {_STATES['India']}[{_PLACE}] ELSE {_STATES['']}[{_PLACE}] END, '')"
    short = f"coalesce({_sql_map(places.ABBREVIATIONS)}[t], t)"
    return f"""SELECT *, {phonetic_sql('name_core')} AS name_phon, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(addr_text, '[0-9]+'), lambda x: len(x) <= 7), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)))), ' ') AS addr_nums, addr_text = '' AS addr_empty FROM (
    SELECT entity_id, business_name, business_address, country, k, variant, CASE WHEN core = '' THEN array_to_string(forms, ' ') ELSE core END AS name_core, array_to_string(list_sort(list_distinct(forms)), ' ') AS name_legal,
        array_to_string(flatten(list_transform(comps, lambda c: CASE WHEN c.state <> '' THEN [c.state] ELSE c.words END)), ' ') AS addr_text, coalesce(list_filter(list_transform(comps, lambda c: c.state), lambda s: s <> '')[-1], '') AS addr_state FROM (
    SELECT *, regexp_replace(array_to_string(list_filter(w, lambda t, i: {_FORM} IS NULL), ' '), '(?:(?:^| )(?:and|the|of))+$', '') AS core, list_filter(list_transform(w, lambda t, i: {_FORM}), lambda f: f IS NOT NULL) AS forms,
        list_transform(list_filter(list_transform(string_split(business_address, ','), lambda x: {CLEAN_SQL.format('x')}), lambda c: c <> ''), lambda c: {{'c': c, 'state': {state}, 'words': list_transform(list_filter(string_split(c, ' '), lambda t: NOT list_contains({_list(places.DROPPED)}, t)), lambda t: {short})}}) AS comps
    FROM (SELECT *, {_WORDS} AS w FROM {raw})))"""


RAW_CTE = f"raw_s1 AS ({S1_SQL.format(part='part')}), raw_pool AS ({POOL_SQL.format(part='part')})"
#: The views s1 and pool of normalised records, and pairs (s1_id, m_id, y).
RECORDS_CTE = f"{RAW_CTE}, s1 AS ({normalised_sql('raw_s1')}), pool AS ({normalised_sql('raw_pool')})"
PAIRS_CTE = f"pairs AS ({PAIRS_SQL.format(s1='raw_s1', pool='raw_pool')})"
