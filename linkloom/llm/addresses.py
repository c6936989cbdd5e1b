"""Problem 4: addresses of one place written differently.

An address is parsed into components whatever their order: house or plot number, direction, street name and type, postcode and the other words.
Suites, floors, shops, flats, buildings, landmarks and post-office boxes are dropped; abbreviations are expanded by
dictionaries of the locales; components are brought into one order. Addresses join on hierarchical keys: number and street, first as written and then as the
corpus spells the street, and postcode and number; explicit rules say what the other components must agree on when some of them are missing.
Words that the corpus uses in a large share of its addresses name regions, the others towns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.names import once, side
from linkloom.llm.pairs import expand
from linkloom.llm.plain import WORD_UP_TO, heard, near, plain, rewritings, spellings
from linkloom.runtime import materialise, table

#: Street types, each with its abbreviations; those after whose type the name follows are marked in ``NAME_AFTER``.
TYPES = {
    "street": "street st str", "avenue": "avenue av ave aven avn", "road": "road rd", "drive": "drive dr drv", "lane": "lane ln", "court": "court ct crt", "boulevard": "boulevard blvd bd boul bvd bld", "highway": "highway hwy hiway hgwy",
    "colony": "colony col cly clny", "layout": "layout lyt lay", "nagar": "nagar ngr nagr", "marg": "marg mrg mg", "place": "place pl plc", "way": "way wy", "square": "square sq", "parkway": "parkway pkwy", "circle": "circle cir", "terrace": "terrace ter terr",
    "rue": "rue r", "chemin": "chemin ch chem che", "allee": "allee all", "impasse": "impasse imp", "route": "route rte", "quai": "quai", "cours": "cours crs", "trail": "trail trl", "alley": "alley aly", "close": "close", "crescent": "crescent cres", "strasse": "strasse", "platz": "platz", "weg": "weg", "gasse": "gasse", "calle": "calle", "via": "via", "avenida": "avenida avda", "plaza": "plaza", "paseo": "paseo",
}
NAME_AFTER = "rue avenue boulevard chemin allee place impasse route quai cours calle via avenida plaza paseo".split()
#: Endings of street names that are one word with their type.
ENDINGS = {"strasse": "strasse", "str": "strasse", "platz": "platz", "weg": "weg", "gasse": "gasse", "allee": "allee"}
#: Directions.
DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west", "north": "north", "south": "south", "east": "east", "west": "west", "no": "", "so": "south"}
#: Words that say nothing about a place.
FILLERS = frozenset("de du des d la le les l of the and null none nil na nan unknown cedex us usa india france dist district po pin zip code city".split())
_NUMBER_WORDS = frozenset("plot no number nr h d hno dno house door n num site survey khasra".split())

_BOX = re.compile(r"\b(?:p\W{0,2}o\W{0,2}\s?box|post(?: office)? box|boite postale|b\.?p\.?)\W{0,3}\d+")
_ORDINAL_FLOOR = re.compile(r"\b\d+\s?(?:st|nd|rd|th|er|eme|e)?\s+(?:floor|flr|fl|etage)\b")
_UNIT = re.compile(r"\b(?:suite|ste|unit|apt|appt|appartement|apartment|flat|shop|office|room|rm|floor|flr|fl|bldg|building|batiment|bat|block|blk|wing|esc|escalier|etage|level|lot)\b\.?\s*(?:no\b\.?|n°|#|number\b)?\s*(?:\d+[a-z]?\b|[a-z]\b(?![.]?\s*\d))")
_LANDMARK = re.compile(r"\b(?:near|nr|opp|opposite|behind|bhd|beside|next to|adj|adjacent to|above|below|in front of)\b\.?(?: to| of| the)?\s+[a-z]+(?:[ .]+[a-z]+)?")
_NOTHING = re.compile(r"(?<![a-z])(?:n/a|null|none)(?![a-z])")
_HYPHEN = re.compile(r"\s[-–]\s")
_RANGE = re.compile(r"\b(\d{1,4})\s?[-–/]\s?\d{1,4}\b(?!\s?[-/])")
_LETTERED = re.compile(r"\b(\d{1,5})(?:[a-z]| [abc](?= [a-z]))\b")
_TOKENS = re.compile(r"\d+(?:st|nd|rd|th)\b|[a-z]+|\d+|[,;#|\n]")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)")

#: A word is a region's from so many distinct addresses, and from one in so many of them; at most ``REGION_ONE_IN`` times the mean number of words are.
REGION_FROM, REGION_ONE_IN = 20, 150

_TYPE_OF = {short: full for full, shorts in TYPES.items() for short in shorts.split()}


@lru_cache(maxsize=50_000)
def street_type(token: str) -> str:
    """The type a token names, in full, abbreviated or slightly misspelt; ``""`` if none."""
    if token in _TYPE_OF:
        return _TYPE_OF[token]
    if len(token) >= 5:
        return next((t for t in TYPES if len(t) >= 5 and near(t, token)), "")
    return ""


_LINKS = frozenset("de du des d la le les l del las los".split())


def _number_before(tokens: list[str], k: int) -> int:
    """Place of the house number before place ``k``, perhaps with a separator between (plot 12, name road); -1 if there is none."""
    k -= 1
    while k >= 0 and tokens[k] in ",#":
        k -= 1
    return k if k >= 0 and tokens[k].isdigit() and len(tokens[k]) <= 5 else -1


def _words_before(tokens: list[str], k: int) -> tuple[int, list[int]]:
    """(place of the house number, places of the words) before place ``k``; (-1, []) unless a number stands before one or more words of the same part."""
    at, words = k - 1, []
    while at >= 0 and (tokens[at].isalpha() or _ORDINAL.fullmatch(tokens[at])) and (tokens[at] not in _NUMBER_WORDS or (words and tokens[at] in DIRECTIONS and _number_before(tokens, at) >= 0)):
        words.append(at)
        at -= 1
    number = _number_before(tokens, at + 1) if words else -1
    return (number, words[::-1]) if number >= 0 else (-1, [])


def _words_after(tokens: list[str], k: int) -> tuple[list[int], bool]:
    """Places of the words behind place ``k`` up to the end of the part, and whether a separator ends them."""
    at, words = k + 1, []
    while at < len(tokens) and tokens[at].isalpha():
        words.append(at)
        at += 1
    while words and tokens[words[0]] in _LINKS:
        words.pop(0)
    return words, at < len(tokens) and tokens[at] in ",;|\n#"


def _joined(tokens: list[str], places: list[int]) -> str:
    return "".join(tokens[k] for k in places if tokens[k] not in _LINKS)


def _street(tokens: list[str]) -> tuple[int, str, list[str], str, set[int]] | None:
    """(place of the number, direction, readings of the name, type, places used) of the first street that has a number.

    A name of several words is one run of letters, so that split words are no difference. A name whose end isn't marked is read up to every word.
    """
    for k, token in enumerate(tokens):
        kind = street_type(token)
        if kind and kind in NAME_AFTER:
            number = _number_before(tokens, k)
            words, ended = _words_after(tokens, k)
            if number < 0 and words and words[-1] + 1 < len(tokens) and tokens[words[-1] + 1].isdigit() and len(tokens[words[-1] + 1]) <= 4:
                number, ended = words[-1] + 1, True  # the number behind the name
            if number >= 0 and words:
                names = [n for m in range(1, len(words) + 1) if (n := _joined(tokens, words[:m]))]
                full, names = names[-1:], [n for n in names[:-1] if len(n) <= WORD_UP_TO]
                return number, "", full if ended else full + names, kind, {number, k, *words}
        if kind and kind != "rue":
            number, words = _words_before(tokens, k)
            if number >= 0:
                direction, used = "", {number, k, *words}
                if len(words) > 1 and tokens[words[0]] in DIRECTIONS:
                    direction, words = DIRECTIONS[tokens[words[0]]], words[1:]
                if name := _joined(tokens, words):
                    return number, direction, [name], kind, used
        if ending := next((e for e in ENDINGS if token.endswith(e) and len(token) >= len(e) + 3), None):
            number = k + 1 if k + 1 < len(tokens) and tokens[k + 1].isdigit() and len(tokens[k + 1]) <= 4 else k - 1
            if number >= 0 and tokens[number].isdigit() and len(tokens[number]) <= 4:
                return number, "", [token[: -len(ending)]], ENDINGS[ending], {number, k}
    return _untyped(tokens)


def _untyped(tokens: list[str]) -> tuple[int, str, list[str], str, set[int]] | None:
    """A street without a type: the address begins with a number and words, and has another part. The last word may be a misspelt type."""
    first = next((k for k, t in enumerate(tokens) if t not in _NUMBER_WORDS and t not in ",#"), None)
    if first is None or not tokens[first].isdigit() or len(tokens[first]) > 4:
        return None
    words, ended = _words_after(tokens, first)
    direction, used = "", {first, *words}
    if len(words) > 1 and tokens[words[0]] in DIRECTIONS:
        direction, words = DIRECTIONS[tokens[words[0]]], words[1:]
    names = [n for m in (len(words), len(words) - 1) if m > 0 and len(n := _joined(tokens, words[:m])) > 2]
    return (first, direction, names, "", used) if ended and names else None


@lru_cache(maxsize=50_000)
def parse_place(address: str | None) -> dict | None:
    """Components of an address, with an empty number and street where it has none; None of null, blank and placeholders."""
    text = plain(address)
    if not text:
        return None
    text = _BOX.sub(" ", text)
    text = _NOTHING.sub(" ", text)
    text = _ORDINAL_FLOOR.sub(" , ", text)
    text = _UNIT.sub(" , ", text)
    text = _LANDMARK.sub(" , ", text)
    text = _LETTERED.sub(r"\1 ", _RANGE.sub(r"\1 ", _HYPHEN.sub(" , ", text)))
    tokens = _TOKENS.findall(text.replace("'", " "))
    number, direction, names, kind, used = "", "", [], "", set()
    if found := _street(tokens):
        at, direction, names, kind, used = found
        number = tokens[at].lstrip("0") or "0"
    rest = [t for k, t in enumerate(tokens) if k not in used and t not in ",;|\n#"]
    codes = [t for t in rest if t.isdigit() and 5 <= len(t) <= 6]
    # a name whose end isn't marked has its other words among the places too
    open_ = [tokens[k] for k in sorted(used) if tokens[k].isalpha()][2:] if len(names) > 1 else []
    locality = sorted({heard(t) for t in [*rest, *open_] if t.isalpha() and t not in FILLERS and t not in _NUMBER_WORDS and len(t) > 2})
    if not (number or codes or locality):
        return None
    return {"number": number, "direction": direction, "words": list(dict.fromkeys(x for n in names for x in spellings(n))), "kind": kind, "postcode": codes[-1] if codes else "", "locality": locality}


def parse_address(address: str | None) -> dict | None:
    """Components of an address; None without a house or plot number at a street."""
    found = parse_place(address)
    return found if found and found["number"] else None


_PARSED = "number string, direction string, words array<string>, kind string, postcode string, locality array<string>"


def _parser(parse):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["number", "direction", "words", "kind", "postcode", "locality"]
        for batch in batches:
            rows = [(value, *(p[c] for c in names)) for value in batch["value"] if (p := parse(value))]
            yield pd.DataFrame(rows, columns=["value", *names])

    return run


def parsed_addresses(addresses: DataFrame, partial: bool = False) -> DataFrame:
    """Each distinct ``value`` with its components, ``locality`` being the words of towns and ``region`` those of regions; addresses without a number only if ``partial``.

    Regions' words are those of a large share of all addresses; their number is bounded by ``REGION_ONE_IN``.
    """
    parsed = materialise(addresses.select("value").where("value is not null").distinct().mapInPandas(_parser(parse_place), "value string, " + _PARSED))
    least = max(REGION_FROM, -(-parsed.count() // REGION_ONE_IN))
    wide = sorted(r.word for r in parsed.select(F.explode("locality").alias("word")).groupBy("word").count().where(F.col("count") >= least).select("word").collect())
    regions = F.array(*(F.lit(w) for w in wide)).cast("array<string>")
    split = parsed.withColumn("region", F.array_intersect("locality", regions)).withColumn("locality", F.array_except("locality", regions))
    return split if partial else split.where("number <> ''")


def address_forms(parsed: DataFrame) -> DataFrame:
    """``value`` with its components and ``key``: number and street, once per spelling the street may stand for, and postcode and number."""
    read = parsed.where("number <> ''").withColumn("street", F.explode("words"))
    known = rewritings(read.groupBy(F.col("street").alias("word")).agg(F.count(F.lit(1)).alias("n"))).withColumnRenamed("word", "street")
    parts = ["value", "number", "direction", "kind", "postcode", "locality", "region", "words"]
    spelt = read.join(known, "street").groupBy(*parts, F.concat_ws(" ", "number", "form").alias("key")).agg(F.max("rarity").alias("rarity"))
    placed = parsed.where("number <> '' and postcode <> ''").select(*parts, F.concat_ws(" ", F.lit("at"), "postcode", "number").alias("key"), F.lit(1.0).alias("rarity"))
    return spelt.unionByName(placed)


def _close(a, b, most: int):
    """Whether two strings differ by at most so many edits; a swap of neighbours is two."""
    return F.levenshtein(a, b) <= most


#: Letters from which two street names at one number and postcode may differ by ``STREET_EDITS``.
STREET_FROM, STREET_EDITS = 6, 2


def agreeing(a, b, key=None):
    """Rules for two addresses with one ``key``.

    Direction and type must agree where both state them. With one number and street then, in this order: equal postcodes agree; towns that share a
    word, or a slight misspelling of it, agree; towns without such a word disagree; postcodes more than a swap or two digits apart disagree;
    without a town on either side regions without a common word disagree; what then has no component in common (one has only its postcode, the other only its town) agrees,
    as number and street agree. With one postcode and number the streets must be slight misspellings of each other.
    """
    either = lambda c: (a(c) == "") | (b(c) == "") | (a(c) == b(c))
    rules = either("direction") & either("kind")
    if key is None:
        return rules & same_area(a, b)
    near = F.exists(a("words"), lambda x: F.exists(b("words"), lambda y: (F.least(F.length(x), F.length(y)) >= STREET_FROM) & _close(x, y, STREET_EDITS)))
    return rules & F.when(key.startswith("at "), near).otherwise(same_area(a, b))


def same_area(a, b):
    """The rules on postcode, town and region alone; true where nothing can be compared."""
    both = lambda c: (a(c) != "") & (b(c) != "")
    shared = F.exists(a("locality"), lambda x: F.exists(b("locality"), lambda y: (x == y) | ((F.length(x) >= 4) & _close(x, y, 1)) | ((F.length(x) >= 5) & _close(x, y, 2))))
    stated = lambda c: (F.size(a(c)) > 0) & (F.size(b(c)) > 0)
    return (
        F.when(both("postcode") & (a("postcode") == b("postcode")), True)
        .when(stated("locality"), shared)
        .when(both("postcode"), _close(a("postcode"), b("postcode"), 2))
        .otherwise((F.size(a("locality")) > 0) | (F.size(b("locality")) > 0) | ~stated("region") | F.arrays_overlap(a("region"), b("region")))
    )


#: Addresses of one key that one task joins; larger keys are salted.
ADDRESSES_A_PART = 500


def address_links(addresses: DataFrame) -> DataFrame:
    """``value_a < value_b``: distinct addresses of one location, each pair once, with the better ``rarity``."""
    forms = materialise(address_forms(parsed_addresses(addresses)))
    parts = forms.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / ADDRESSES_A_PART).cast("int").alias("parts"))
    forms = forms.join(parts, "key")
    a = forms.withColumn("part", F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")).alias("a")
    b = forms.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    joined = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.value") < F.col("b.value")))
    return joined.where(agreeing(side("a"), side("b"), F.col("a.key"))).groupBy(F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b")).agg(F.max(F.col("a.rarity") * F.col("b.rarity")).alias("rarity"))


def location_pairs(records: DataFrame) -> DataFrame:
    """``id_a, id_b`` of entities whose addresses denote one location but aren't the same string.

    Null, blank and placeholder addresses, and those without a house or plot number, pair with nothing. Linking is between distinct addresses.
    """
    entities = materialise(once(records, "business_address"))
    return expand(address_links(entities), entities)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return location_pairs(table(spark, sf_dir, "source_records"))
