"""Problem 7: records of one business across sources without a shared key.

MinHash bands over the canonical forms of names, alone and together with the address, give candidates; pairwise features go to a
logistic model fitted on rule-made (weak) labels and reviewed pairs, then calibrated on reviewed pairs that it hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm import addresses, names
from linkloom.runtime import materialise, table

#: MinHash: bands, and values in a band.
BANDS, ROWS = 4, 6
#: Values combined with the address key in turn.
WITH_ADDRESS = 3
#: Records of one side of a band that one task joins; larger bands are salted on both sides.
RECORDS_A_PART = 1_000
_SEED = 20_240_131
#: Odd multipliers of the mixing of letters.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Rows of each weak class, and reviewed pairs, that are brought to the driver to fit and calibrate the model.
FIT_ROWS = 8_000
#: Confidence from which a pair is a match.
MATCH_FROM = 0.5

FEATURES = ["name_same", "name_exact", "name_near", "trade_same", "trade_off", "lead_off", "first_off", "place_same", "place_exact", "place_off", "area_same", "area_off", "no_address", "no_number", "country_off", "rivals", "agrees", "conflicts"]


def profiles(records: DataFrame) -> DataFrame:
    """``entity_id, s1, country, name, address, names, place, keys``: each entity once with all forms of its name and its address's components.

    Entities without a usable name are left out: nothing could match them. ``keys`` are the number-and-street forms.
    """
    once = materialise(
        records.where("entity_id is not null")
        .groupBy("entity_id")
        .agg(F.max("source_tag").alias("tag"), *(F.max(c).alias(c) for c in ("business_name", "business_address", "country")))
    )
    forms = names.name_forms(once.select(F.col("business_name").alias("value")))
    forms = forms.groupBy(F.col("value").alias("business_name")).agg(F.collect_list(F.struct("kind", "key", "lead", "trades", "firsts", "middle", "rarity")).alias("names"))
    parsed = addresses.parsed_addresses(once.select(F.col("business_address").alias("value")), partial=True)
    keys = addresses.address_forms(parsed).where("not startswith(key, 'at ')").groupBy(F.col("value").alias("business_address")).agg(F.collect_set("key").alias("keys"))
    place = parsed.select(F.col("value").alias("business_address"), F.struct("number", "direction", "kind", "postcode", "region", "locality").alias("place"))
    return materialise(
        once.join(forms, "business_name")
        .join(place, "business_address", "left")
        .join(keys, "business_address", "left")
        .select("entity_id", (F.coalesce("tag", F.substring("entity_id", 1, 2)) == "S1").alias("s1"), F.when(F.col("country") != "", F.col("country")).alias("country"), "business_name", "business_address", "names", "place", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))
    )


def minhash(forms: list[str], values: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values of the letter triples of each form, one row a form; a form of fewer than three letters is one triple."""
    letters = np.frombuffer("".join(f if len(f) >= 3 else f.ljust(3) for f in forms).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([max(3, len(f)) for f in forms])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    with np.errstate(over="ignore"):
        h = (letters[:-2] * _MIX[0] ^ letters[1:-1]) * _MIX[1] ^ letters[2:]
        h = _mixed(h)
        inside = np.ones(len(letters), bool)
        inside[(starts + sizes)[:, None] - [1, 2]] = False  # triples that would reach into the next form
        h = h[inside[: len(h)]]
        first = np.concatenate([[0], np.cumsum(sizes - 2)])[:-1]
        return np.stack([np.minimum.reduceat(_mixed(h ^ np.uint64(seed)), first) for seed in np.random.default_rng(_SEED).integers(0, 2**63, values)], axis=1).view(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Multiplications and shifts that spread every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * _MIX[2]
    return (h ^ (h >> np.uint64(29))) * _MIX[1]


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(m=list(minhash(batch["form"].tolist()))) if len(batch) else batch.assign(m=[])


def signatures(forms: DataFrame) -> DataFrame:
    """``form, m``: the MinHash values of each distinct form's letter triples."""
    return forms.select("form").distinct().mapInPandas(_signed, "form string, m array<long>")


def candidates(people: DataFrame) -> DataFrame:
    """``s1_id, cand_id``: pairs of an S1 and another record that share a band, each once. A whole form is a band as well.

    Every band is joined whole, whatever its size and whether its records have an address. A large one is a grid of parts: a record's own
    part by a hash of its id, repeated for each part of the other side.
    """
    named = materialise(people.select("entity_id", "s1", F.explode(F.array_distinct(F.col("names.key"))).alias("form"), "keys"))
    signed = materialise(named.join(signatures(named), "form"))
    bands = F.array(F.xxhash64(F.lit(-1), F.col("form")), *(F.xxhash64(F.lit(b), *(F.col("m")[b * ROWS + i] for i in range(ROWS))) for b in range(BANDS)))
    own = signed.select("entity_id", "s1", F.explode(bands).alias("band"))
    placed = signed.select("entity_id", "s1", F.explode("keys").alias("at"), F.array(*(F.col("m")[i] for i in range(WITH_ADDRESS))).alias("m")).select("entity_id", "s1", "at", F.posexplode("m").alias("i", "v")).select("entity_id", "s1", F.xxhash64("at", "i", "v").alias("band"))
    keyed = materialise(own.unionByName(placed).distinct())
    parts = lambda side: F.ceil(F.sum(side.cast("long")) / RECORDS_A_PART).cast("int")
    sizes = keyed.groupBy("band").agg(parts(F.col("s1")).alias("left"), parts(~F.col("s1")).alias("right")).where("left > 0 and right > 0")
    sized = keyed.join(sizes, "band")
    own_part = lambda side: F.pmod(F.xxhash64("entity_id"), F.col(side)).cast("int")
    each = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    left = sized.where("s1").select(F.col("entity_id").alias("s1_id"), "band", own_part("left").alias("i"), each("right").alias("j"))
    right = sized.where("not s1").select(F.col("entity_id").alias("cand_id"), "band", each("left").alias("i"), own_part("right").alias("j"))
    return left.join(right, ["band", "i", "j"]).select("s1_id", "cand_id").distinct()


def features(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """``s1_id, cand_id`` with ``FEATURES``; missing components are neither agreement nor conflict."""
    a = people.select(F.col("entity_id").alias("s1_id"), F.struct("country", "business_name", "business_address", "names", "place", "keys").alias("a"))
    b = people.select(F.col("entity_id").alias("cand_id"), F.struct("country", "business_name", "business_address", "names", "place", "keys").alias("b"))
    both = pairs.join(a, "s1_id").join(b, "cand_id")
    pick = lambda x: lambda c: x[c]

    def some(rule):
        return F.exists("a.names", lambda x: F.exists("b.names", lambda y: rule(pick(x), pick(y))))

    same_key = lambda x, y: x("key") == y("key")
    # agreement and conflicts of trade, first word and first name only count where the rest is one name
    trade = lambda x, y: F.arrays_overlap(x("trades"), y("trades"))
    stated = lambda x, y: (F.size(x("trades")) > 0) & (F.size(y("trades")) > 0)
    pa, pb = pick(F.col("a.place")), pick(F.col("b.place"))
    known = F.col("a.place").isNotNull() & F.col("b.place").isNotNull()
    numbered = known & (pa("number") != "") & (pb("number") != "")
    street = F.arrays_overlap("a.keys", "b.keys")
    area = addresses.same_area(pa, pb)
    place = numbered & street & addresses.agreeing(pa, pb)
    nearest = F.array_max(F.flatten(F.transform("a.names", lambda x: F.transform("b.names", lambda y: 1 - F.levenshtein(x["key"], y["key"]) / F.greatest(F.length(x["key"]), F.length(y["key"]))))))
    flags = {
        "name_same": some(lambda x, y: same_key(x, y) & names.agreeing(x, y)),
        "name_exact": F.col("a.business_name") == F.col("b.business_name"),
        "trade_same": some(lambda x, y: same_key(x, y) & stated(x, y) & trade(x, y)),
        "trade_off": ~some(lambda x, y: ~stated(x, y) | trade(x, y)),
        "lead_off": ~some(lambda x, y: names.same_lead(x("lead"), y("lead"))),
        "first_off": ~some(lambda x, y: (F.size(x("firsts")) == 0) | (F.size(y("firsts")) == 0) | F.arrays_overlap(F.concat(x("firsts"), F.transform(x("firsts"), lambda w: F.substring(w, 1, 1))), F.concat(y("firsts"), F.transform(y("firsts"), lambda w: F.substring(w, 1, 1))))),
        "place_same": F.coalesce(place, F.lit(False)),
        "place_exact": F.coalesce(F.col("a.business_address") == F.col("b.business_address"), F.lit(False)),
        "place_off": F.coalesce(numbered & ~place, F.lit(False)),
        "area_same": F.coalesce(known & area & (((pa("postcode") != "") & (pa("postcode") == pb("postcode"))) | ((F.size(pa("locality")) > 0) & (F.size(pb("locality")) > 0))), F.lit(False)),
        "area_off": F.coalesce(known & ~area, F.lit(False)),
        "no_address": ~known,
        "no_number": F.coalesce(known & ~numbered, F.lit(False)),
        "country_off": F.coalesce(F.col("a.country") != F.col("b.country"), F.lit(False)),
    }
    made = both.select("s1_id", "cand_id", nearest.alias("name_near"), *(f.cast("double").alias(c) for c, f in flags.items()))
    made = materialise(made.withColumn("agrees", F.col("name_same") * F.col("place_same")).withColumn("conflicts", F.greatest(*(c for c in flags if c.endswith("_off")))))
    # S1 records that could own the candidate as well, by name and area
    open_ = (F.col("name_same") == 1) & (F.col("place_off") == 0) & (F.col("area_off") == 0) & (F.col("country_off") == 0)
    rivals = made.where(open_).groupBy("cand_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return made.join(rivals, "cand_id", "left").withColumn("rivals", F.log1p(F.coalesce(F.col("n") - 1, F.lit(0)).cast("double"))).drop("n")


def weak_label():
    """1 where name and location agree, 0 where one of them is in conflict, null where the rules can't tell."""
    return (
        F.when((F.col("name_same") == 1) & (F.col("place_same") == 1) & (F.col("country_off") == 0), 1.0)
        .when((F.col("place_off") == 1) | (F.col("area_off") == 1) | (F.col("trade_off") == 1) | (F.col("lead_off") == 1) | (F.col("first_off") == 1) | (F.col("country_off") == 1) | (F.col("name_near") < 0.5), 0.0)
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights, the constant last, by Newton steps on the penalised likelihood; zeros without both classes."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(set(y.tolist())) < 2:
        return w
    ridge = penalty * len(y) / 100 * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored_matches(records: DataFrame, labels: DataFrame) -> DataFrame:
    """``s1_id, cand_id, confidence`` of every candidate pair.

    The model sees at most ``FIT_ROWS`` pairs of each weak class and as many reviewed pairs, drawn by a hash of their ids; a
    third of the reviewed pairs is kept back to calibrate its scores (a logistic line on the model's score). Without reviewed pairs the scores stand.
    Null labels don't count; a pair reviewed both ways counts as no match.
    """
    people = profiles(records)
    made = materialise(features(candidates(people), people))
    drawn = lambda df: df.orderBy(F.xxhash64("s1_id", "cand_id")).limit(FIT_ROWS).collect()
    labelled = made.withColumn("y", weak_label())
    rows = [(r, 0) for y in (1.0, 0.0) for r in drawn(labelled.where(F.col("y") == y))]
    reviewed = labels.where("y is not null and s1_id is not null and cand_id is not null").groupBy("s1_id", "cand_id").agg(F.min(F.col("y").cast("double")).alias("y"))
    third = F.pmod(F.xxhash64("cand_id", "s1_id"), F.lit(3)) == 0
    rows += [(r, 2 if r.held else 1) for r in drawn(made.join(reviewed, ["s1_id", "cand_id"]).withColumn("held", third))]
    x = np.array([[r[c] for c in FEATURES] for r, _ in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r, _ in rows], float)
    part = np.array([k for _, k in rows])
    w = fit_logistic(x[part < 2], y[part < 2])
    score = lambda v: v @ w[:-1] + w[-1]
    held = part == 2
    line = fit_logistic(score(x[held])[:, None], y[held], penalty=1e-4) if held.sum() >= 50 and len(set(y[held].tolist())) == 2 else np.array([1.0, 0.0])
    total = F.lit(float(w[-1]))
    for c, k in zip(FEATURES, w[:-1]):
        total = total + F.lit(float(k)) * F.col(c)
    return made.withColumn("confidence", 1 / (1 + F.exp(-(F.lit(float(line[0])) * total + F.lit(float(line[1]))))))


def matches(records: DataFrame, labels: DataFrame, match_from: float = MATCH_FROM) -> DataFrame:
    """``s1_id, cand_id, confidence`` of the pairs whose calibrated confidence is at least ``match_from``.

    Null, blank and placeholder names match nothing. Records delivered again count once. Empty tables give no pairs.
    """
    return scored_matches(records, labels).where(F.col("confidence") >= match_from).select("s1_id", "cand_id", "confidence")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "source_records"), table(spark, sf_dir, "match_labels")).select("s1_id", "cand_id")
