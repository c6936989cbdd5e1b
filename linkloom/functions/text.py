"""Normalisation of names, addresses and ids as column expressions, evaluated in the JVM.

Every function takes columns and gives a column; null counts as the empty string unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Tokens of legal forms.
LEGAL = (
    "pvt private pvtltd ltd limited llp llc inc incorporated corp corporation co company cos plc lp pllc pc sa sas sasu sarl eurl sci snc "
    "gmbh ag bv nv oy ab spa srl praivet praiveta praaivet limiteda limitid limitad"
).split()
#: Further legal and company words of the second normalisation.
LEGAL2 = [*LEGAL, *"ei eirl selarl sca scop scs cie ets etablissements societe ste".split()]
#: Joining words that a core name leaves out.
JOINING, JOINING2 = "and the dba".split(), "and the dba et fka".split()
#: Abbreviations of street types and address words.
ADDRESS_WORDS = {
    "r": "rue", "av": "avenue", "ave": "avenue", "avn": "avenue", "bd": "boulevard", "blvd": "boulevard", "bld": "boulevard", "imp": "impasse", "crs": "cours", "pl": "place",
    "ch": "chemin", "che": "chemin", "chem": "chemin", "rte": "route", "all": "allee", "sq": "square", "fbg": "faubourg", "qu": "quai", "st": "street", "str": "street", "rd": "road",
    "ln": "lane", "dr": "drive", "ct": "court", "cir": "circle", "pkwy": "parkway", "hwy": "highway", "ter": "terrace", "trl": "trail", "apt": "apartment", "ste": "suite",
    "fl": "floor", "bldg": "building", "flr": "floor", "nr": "near", "opp": "opposite", "mkt": "market", "rly": "railway", "stn": "station",
}
#: Generic words and their French equivalents.
FRENCH_WORDS = {
    "street": "Rue", "st": "Rue", "road": "Route", "rd": "Route", "avenue": "Avenue", "ave": "Avenue", "boulevard": "Boulevard", "blvd": "Boulevard", "lane": "Allée", "ln": "Allée", "drive": "Chemin", "dr": "Chemin",
    "place": "Place", "pl": "Place", "court": "Cour", "ct": "Cour", "square": "Place", "marg": "Rue", "way": "Voie", "inc": "SA", "incorporated": "SA", "llc": "SARL", "corp": "SAS", "corporation": "SAS", "ltd": "SAS",
    "limited": "SAS", "llp": "EURL", "pvt": "", "private": "", "co": "Cie", "company": "Compagnie", "and": "et", "sons": "Fils", "brothers": "Frères", "partners": "Associés", "group": "Groupe", "enterprises": "Entreprises",
    "trading": "Commerce", "center": "Centre", "centre": "Centre", "medical": "Médical", "school": "École", "consulting": "Conseil", "cafe": "Café", "bakery": "Boulangerie", "pharmacy": "Pharmacie", "hotel": "Hôtel",
    "services": "Services", "industries": "Industries", "association": "Association", "club": "Club", "sports": "Sport", "sport": "Sport", "society": "Société", "foundation": "Fondation", "clinic": "Clinique",
    "unit": "Bât", "suite": "Bât", "floor": "Étage", "near": "près de", "opposite": "face à",
}

#: Cyrillic and Greek lower-case letters by sound, one letter each; letters of two sounds are in ``_PAIRS``.
_BY_SOUND = dict(zip("абвгдезийклмнопрстуфыэіјѕѵүһԁԛԝӏαβγδεζηικλμνξορστυφωςϲϳ", "abvgdeziiklmnoprstufyeijsvuhdqwlabgdeziiklmnxorstyfoscj"))
_PAIRS = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "θ": "th", "χ": "ch", "ψ": "ps", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ﬁ": "fi", "ﬂ": "fl", "ъ": "", "ь": ""}
_ONE = {"ø": "o", "đ": "d", "ł": "l", "ı": "i", "ð": "d", "ħ": "h", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": " "}


def _singles() -> dict[str, str]:
    """One-letter replacements, by rule: what a character decomposes to, and the tables above."""
    out = dict(_BY_SOUND) | _ONE | {"ϲ": "s", "Ϲ": "s", "ү": "y"}
    # letters that are named by words that begin with their sound
    for code in [*range(0x561, 0x587), *range(0x5D0, 0x5EB), *range(0x621, 0x64B), *range(0x10D0, 0x10F1)]:
        initial = unicodedata.name(chr(code), "-").split(" WITH ")[0].rsplit(" ", 1)[-1][0].lower()
        if initial.isascii() and initial.isalpha():
            out[chr(code)] = initial
    for code in [*range(0xA0, 0x250), *range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x1E00, 0x1F00), *range(0x2000, 0x2010), 0x202F, 0x205F, 0x3000, *range(0xFF01, 0xFF5F)]:
        ch = chr(code)
        if unicodedata.category(ch) == "Zs":
            out[ch] = " "
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch).lower() if unicodedata.category(c) != "Mn")
        base = out.get(base, base)
        if len(base) == 1 and base.isascii():
            out[ch] = base
    return out


#: Devanagari letters: the block names its letters by sound.
_DEVANAGARI = {ch: unicodedata.name(ch).rsplit(" ", 1)[1].lower() for ch in map(chr, range(0x900, 0x970)) if unicodedata.name(ch, "").startswith(("DEVANAGARI LETTER", "DEVANAGARI VOWEL SIGN")) and " SHORT " not in unicodedata.name(ch) and "CANDRA" not in unicodedata.name(ch)}
#: By sound: consonants without the vowel that Devanagari leaves unwritten, long vowels as short ones.
_DEVANAGARI = {ch: (s[:-1] if 0x915 <= ord(ch) <= 0x939 else {"aa": "a", "ii": "i", "uu": "u", "vocalic": "ri"}.get(s, s)) for ch, s in _DEVANAGARI.items() if s.isalpha() and len(s) <= 3}


def ascii_steps() -> tuple[list[tuple[str, str]], str, str]:
    """(regular replacements in order, characters of the translation, what they become).

    The same steps state :func:`to_ascii` in any SQL dialect: letters of several sounds are replaced first, all others by one translation;
    what has no sound then is dropped, such as signs that silence a vowel.
    """
    steps = [("\u095b|\u091c\u093c", "j"), ("\u095e|\u092b\u093c?", "f"), ("\u0902|\u0901", "n")]
    several = {**{c: s for c, s in _DEVANAGARI.items() if len(s) > 1}, **_PAIRS}
    steps += list(several.items())
    single = _singles() | {c: s for c, s in _DEVANAGARI.items() if len(s) == 1}
    single = {c: s for c, s in single.items() if c not in several and not c.isascii()}
    return steps, "".join(single), "".join(single.values())


_STEPS, _FROM, _TO = ascii_steps()


def _indic() -> dict[str, str]:
    """Letters and signs of the other Indic blocks to those of Devanagari at the same place, where both have the same name."""
    out = {}
    for block in (0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00):
        for place in range(0x80):
            there, here = unicodedata.name(chr(block + place), ""), unicodedata.name(chr(0x900 + place), "")
            if there and here and there.partition(" ")[2] == here.partition(" ")[2]:
                out[chr(block + place)] = chr(0x900 + place)
    return out


_INDIC = _indic()
_INDIC_FROM, _INDIC_TO = "".join(_INDIC), "".join(_INDIC.values())


def _spark(replacement: str) -> str:
    return replacement.replace("\\1", "$1")


def to_ascii(s: Column) -> Column:
    """Lower-case ASCII by sound: accents, full-width forms, Cyrillic, Greek, the Indic scripts, and by their letters' names Arabic, Hebrew, Armenian and Georgian; other characters drop."""
    out = F.lower(F.coalesce(s, F.lit("")))
    plain = out
    out = F.translate(out, _INDIC_FROM, _INDIC_TO)
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, _spark(by))
    out = F.regexp_replace(F.translate(out, _FROM, _TO), "[^\\x00-\\x7f]", "")
    return F.when(plain.rlike("^[\\x00-\\x7f]*$"), plain).otherwise(out)


def to_ascii_sql(s: str) -> str:
    """:func:`to_ascii` in DuckDB's dialect."""
    out = f"translate(lower(coalesce({s}, '')), '{_INDIC_FROM}', '{_INDIC_TO}')"
    for pattern, by in _STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    quote = "''"
    return f"regexp_replace(translate({out}, '{_FROM}', '{_TO.replace(chr(39), quote)}'), '[^\\x00-\\x7f]', '', 'g')"


def clean(s: Column) -> Column:
    """ASCII; ``&`` as ``and``; other than letters and digits as spaces; without null words; single spaces."""
    out = F.regexp_replace(to_ascii(s), "&", " and ")
    out = F.regexp_replace(out, "[^a-z0-9]+", " ")
    out = F.regexp_replace(out, "\\b(null|none|nan|n a)\\b", " ")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def name(s: Column) -> Column:
    """Cleaned name with legal phrases joined."""
    out = clean(s)
    for pattern, by in (("\\bl l p\\b", "llp"), ("\\bl l c\\b", "llc"), ("\\bp\\s?ltd\\b", "pvt ltd"), ("\\bf k a\\b", "fka"), ("\\bd b a\\b", "dba")):
        out = F.regexp_replace(out, pattern, by)
    return out


def tokens(s: Column) -> Column:
    """Words between spaces; none of the empty string."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def without(words: Column, drop: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(drop))


def core(named: Column) -> Column:
    """A normalised name without legal forms and joining words; all its words if none is left. The former-name marker goes in any case."""
    words = without(tokens(named), ["fka"])
    kept = without(words, [*LEGAL, *JOINING])
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def numbers(s: Column) -> Column:
    """All digit runs in order without leading zeros; zero stays ``0``."""
    return F.transform(F.regexp_extract_all(to_ascii(s), F.lit("([0-9]+)"), 1), lambda d: F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0")))


def postcode(s: Column) -> Column:
    """The last digit run of five or six; ``""`` if there is none."""
    runs = F.filter(F.regexp_extract_all(to_ascii(s), F.lit("([0-9]+)"), 1), lambda d: F.length(d).between(5, 6))
    return F.coalesce(F.try_element_at(runs, F.lit(-1)), F.lit(""))


def joined_initials(words: Column) -> Column:
    """Runs of two or more single letters as one word each; digits and lone letters stay."""
    letter = lambda t: t.rlike("^[a-z]$")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run"))

    def flush(acc):
        return F.when(acc["run"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["run"])))

    step = lambda acc, t: F.when(letter(t), F.struct(acc["out"].alias("out"), F.concat(acc["run"], t).alias("run"))).otherwise(F.struct(F.concat(flush(acc), F.array(t)).alias("out"), F.lit("").alias("run")))
    return F.aggregate(words, start, step, flush)


def core2(named: Column) -> Column:
    """Core name with initials joined and the wider list of legal words left out."""
    words = joined_initials(tokens(named))
    kept = without(words, [*LEGAL2, *JOINING2])
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def _mapped(words: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def address2(cleaned: Column) -> Column:
    """A cleaned address with its abbreviations written out, word by word."""
    return F.array_join(_mapped(tokens(cleaned), ADDRESS_WORDS), " ")


def record_text(named: Column, address: Column) -> Column:
    return F.concat(F.coalesce(named, F.lit("")), F.lit(" | "), F.coalesce(address, F.lit("")))


def view_text(named: Column, address: Column, view: str) -> Column:
    """Text that a view's vectors are made of: name, address, or both."""
    named, address = F.coalesce(named, F.lit("")), F.coalesce(address, F.lit(""))
    return F.concat(F.lit("query: "), {"name": named, "addr": address, "both": F.concat(named, F.lit(", "), address)}[view])


def clip(s: Column, n: int) -> Column:
    """White space squeezed; what is longer than ``n`` is cut to ``n`` characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), "\\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def id_list(cell: Column) -> Column:
    """Ids of a comma list: trimmed, without empties and repeats; none of null."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))


def script(s: Column) -> Column:
    """Coarse script class."""
    return (
        F.when(s.rlike("[\\x{0900}-\\x{097F}]"), "devanagari")
        .when(s.rlike("[\\x{00C0}-\\x{024F}]"), "latin_accented")
        .when(s.rlike("[^\\x00-\\x7f]"), "other_non_ascii")
        .otherwise("ascii")
    )


def stripped(s: Column) -> Column:
    """Accents off Latin letters, case kept; combining marks drop."""
    marks = {}
    for ch in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base != ch and len(base) == 1:
            marks[ch] = base
    return F.regexp_replace(F.translate(s, "".join(marks), "".join(marks.values())), "[\\x{0300}-\\x{036F}]", "")


def french(s: Column) -> Column:
    """Generic words in French, word by word; the rest of the text stays."""
    parts = F.regexp_extract_all(s, F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)
    words = F.create_map(*[F.lit(x) for kv in FRENCH_WORDS.items() for x in kv])
    return F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(words, F.lower(t)), t)), ""), "\\s{2,}", " "))


def typo(s: Column, seed: int) -> Column:
    """One seeded swap of neighbours or deletion; texts under four characters stay."""
    at = (F.pmod(F.xxhash64(s, F.lit(seed)), F.length(s) - 2) + 1).cast("int")
    cut = F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s)))
    swap = F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.lit(1)), F.substring(s, at, F.lit(1)), F.substring(s, at + 2, F.length(s)))
    return F.when(F.length(s) < 4, s).when(F.pmod(F.xxhash64(s, F.lit(seed + 1)), F.lit(2)) == 0, swap).otherwise(cut)


def safe_name(key: Column) -> Column:
    """The key itself if it is a plain file name under 120 characters, else its SHA-1."""
    return F.when(key.rlike("^[A-Za-z0-9_.-]+$") & (F.length(key) < 120), key).otherwise(F.sha1(key))


def redacted(s: Column) -> Column:
    """URLs masked."""
    return F.regexp_replace(s, "https?://\\S+", "<url>")


def number_set(spaced: Column) -> Column:
    """Distinct words of a space-joined list; none of the empty string."""
    return F.array_distinct(tokens(F.coalesce(spaced, F.lit(""))))
