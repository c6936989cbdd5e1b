"""Problem 2: names of one firm or person in different spellings.

A name is rewritten canonically: look-alikes, case, accents and scripts are levelled, legal forms, greetings and trade words are
recognised in any abbreviation and set aside, words that the corpus has before or behind many names and also leaves out (affixes) as well,
nicknames and initials become formal names, parts are put in order, split or joined words are read every way, long names also become their
initials, and misspelt words become the corpus' frequent neighbours. Each rewriting is a form; forms are equi-joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.pairs import expand
from linkloom.llm.plain import WORD_UP_TO, Lexicon, heard, plain, rewritings, spellings
from linkloom.runtime import materialise, table

#: Words of legal forms, after dots are dropped and single letters joined.
LEGAL = "limited ltd private pvt pte llc llp lp plc inc incorporated corp corporation co company partnership liability cie sarl sas sasu sa eurl gmbh ag kg ohg ug societe par actions simplifiee responsabilite limitee a p l srl spa bv nv".split()
#: Words that say nothing about a name.
EMPTY = "and the et m s ms messrs mr mrs miss mme dr prof sri shri smt of de".split()
#: Trades, each with the words that name it.
TRADES = {
    "furniture": "furniture", "logistics": "logistics", "foods": "foods", "electronics": "electronics", "services": "services", "motors": "motors", "construction": "construction", "bakery": "bakery",
    "textiles": "textiles", "manufacturing": "manufacturing", "hardware": "hardware", "printing": "printing", "traders": "traders trading", "consulting": "consulting consultancy", "pharmaceuticals": "pharmaceuticals pharmacy",
    "engineering": "engineering", "immobilier": "immobilier", "boulangerie": "boulangerie", "menuiserie": "menuiserie", "patisserie": "patisserie", "conseil": "conseil", "transports": "transports", "librairie": "librairie",
    "batiment": "batiment", "electricite": "electricite", "mecanique": "mecanique", "dental": "dental dentist", "veterinary": "veterinary", "music": "music", "hair": "hair", "attorney": "attorney lawyer law",
    "plumbing": "plumbing plumbers", "florist": "florist", "opticians": "opticians", "tailors": "tailors tailoring", "photography": "photography",
}
#: Words that go with a trade's word and say nothing alone.
BESIDE = "clinic school studio at office".split()
#: Shops that trade names end with.
SHOPS = "house store depot shop mart".split()
#: Formal first names and the short forms in use for them.
NICKNAMES = {
    "alexander": "alex al sandy xander lex", "charles": "charlie chuck chas carl", "dorothy": "dot dolly dottie dora", "edward": "ed eddie ned ted teddy", "elizabeth": "liz beth betty lizzie eliza bess libby betsy", "francis": "frank fran frankie",
    "gerald": "gerry jerry ger", "henry": "harry hank hal", "ignatius": "iggy nat", "james": "jim jimmy jamie jem", "john": "jack johnny jon", "katherine": "kate kathy kit katie kath kitty", "lawrence": "larry laurie lars",
    "margaret": "maggie meg peggy marge greta", "michael": "mike mick mickey micky", "nathaniel": "nate nat nathan", "ondine": "ondie", "patricia": "pat trish patty tricia", "philippa": "pip pippa", "quentin": "quent quin",
    "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "susan": "sue suzy susie", "theodore": "theo ted teddy", "ulrich": "uli", "valentin": "val", "victoria": "vicky tori vic", "william": "will bill liam billy willy",
    "yolanda": "yoli", "zebulon": "zeb", "anthony": "tony", "andrew": "andy drew", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy cate", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie", "frederick": "fred freddy", "joseph": "joe joey", "joshua": "josh", "matthew": "matt", "nicholas": "nick", "rebecca": "becky", "samuel": "sam sammy", "stephen": "steve", "thomas": "tom tommy", "timothy": "tim", "peter": "pete", "rachel": "rach",
}

_FORMAL: dict[str, tuple[str, ...]] = {}
for _formal, _short in NICKNAMES.items():
    for _name in [_formal, *_short.split()]:
        _FORMAL[_name] = (*_FORMAL.get(_name, ()), _formal)
_OTHER_NAME = re.compile(r"\b(?:d[/. ]?b[/. ]?a|f[/. ]?k[/. ]?a|a[/. ]?k[/. ]?a|t/a|trading as|doing business as|formerly(?: known as)?|also known as)\b\.?")
_TOKENS = re.compile(r"[a-z]+|\d+")
_CUT = re.compile(r"\b([a-z]+)\.")
#: A word in brackets behind a name belongs before it.
_BEHIND = re.compile(r"^(.*\S)\s*\(([a-z]+\.?)\)\s*$")
_FIRM_FROM = 4

#: A word counts as common from so many of the corpus' distinct names, and from one in so many of them; this bounds the common words that are broadcast to
#: ``COMMON_ONE_IN`` times the mean number of words of a name.
COMMON_FROM, COMMON_ONE_IN = 20, 20_000
#: A common word is a misspelling only of a word that is so many times as frequent.
MISSPELT_ONE_IN = 50
#: A common word is an affix if so many different rests stand with it and without it, and so large a share of its rests.
AFFIX_RESTS, AFFIX_SHARE = 3, 0.005
#: Tokens that a process remembers before it starts afresh; bounds its memory, not its results.
TOKENS_KEPT = 200_000


def _left_out(token: str, word: str) -> bool:
    """Whether ``token`` is ``word`` with letters left out: between the beginning and the end that both share, no vowel stands; three consonants are left."""
    at = iter(word)
    if sum(ch not in "aeiou" for ch in token) < 3 or not all(ch in at for ch in token):
        return False
    i = j = 0
    while i < len(token) and token[i] == word[i]:
        i += 1
    while j < len(token) - i and token[-1 - j] == word[-1 - j]:
        j += 1
    return not set(token[i : len(token) - j]) & set("aeiou") and len(token) * 5 >= len(word)


def _joined_letters(tokens: list[str]) -> list[str]:
    """Runs of three or more single letters that spell a legal form are joined: l l c. Two may be a person's initials."""
    out, i = [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and len(tokens[j]) == 1 and tokens[j].isalpha():
            j += 1
        for end in range(j, i + 2, -1):
            if "".join(tokens[i:end]) in LEGAL:
                out.append("".join(tokens[i:end]))
                i = end
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def _readings(words: list[str]) -> tuple[list[list[str]], bool]:
    """Every way to read tokens as two words: as they stand, neighbours joined, or one split; and whether that is a guess.

    Five and more words are read as a bag and as one run of letters, so that words split or joined anywhere are no difference.
    """
    if len(words) == 2:
        cuts = [words]
    elif len(words) == 1:
        w = words[0]
        cuts = [[w, ""]] if not 10 <= len(w) <= WORD_UP_TO else [[w[:i], w[i:]] for i in range(_FIRM_FROM, len(w) - _FIRM_FROM + 1)]
    elif len(words) in (3, 4):
        cuts = [["".join(words[:i]), "".join(words[i:])] for i in range(1, len(words))]
    else:
        return [[a, ""] for x in (" ".join(sorted(words)), "".join(words)) for a in spellings(x)], False
    return [[a, b] for x, y in cuts for a in spellings(x) for b in spellings(y)], len(cuts) > 1


_LEGAL_LETTERS = frozenset("plcsarmbhegu")


def _one(trades: list[tuple[str, ...]]) -> list[str]:
    """Trades all tokens allow, else those of the first."""
    if not trades:
        return []
    return sorted(set.intersection(*map(set, trades)) or set(trades[0]))


class Reader:
    """Parses names with what the corpus knows: its common words, and its affixes before (``leads``) and behind (``trades``) names.

    A misspelling keeps its first letter; a common word is one only of a word that is ``MISSPELT_ONE_IN`` times as common.
    """

    def __init__(self, common: dict[str, int] | None = None, leads: Iterable[str] = (), trades: Iterable[str] = ()):
        self._common = common or {}
        self._leads = tuple(leads)
        self._trade_words = [(trade, w) for trade, words in TRADES.items() for w in words.split()] + [(w, w) for w in trades]
        self._heard_trades = {heard(w) for _, w in self._trade_words}
        self._lexicons = {
            "trade": Lexicon({w: trade for trade, w in self._trade_words}, 5, 9),
            "legal": Lexicon({w: w for w in LEGAL}, 6, 8),
            "lead": Lexicon({w: w for w in self._leads}, 5, 8),
            "beside": Lexicon({w: w for w in BESIDE}, 6),
            "shop": Lexicon({w: w for w in SHOPS}, 6),
            "first": Lexicon({w: w for w in NICKNAMES if len(w) >= 6}, 6),
        }
        self._found: dict[tuple[str, str], tuple] = {}

    def _find(self, token: str, which: str) -> tuple:
        """Values of the words of a list that ``token`` may be."""
        key = (token, which)
        known = self._found.get(key)
        if known is None:
            if len(self._found) > TOKENS_KEPT:
                self._found.clear()
            lexicon = self._lexicons[which]
            values = set(lexicon.find(token))
            if values and (n := self._common.get(token)) and not lexicon.has(token):
                spelt = (lambda v: [w for t, w in self._trade_words if t == v]) if which == "trade" else (lambda v: [v])
                values = {v for v in values if n * MISSPELT_ONE_IN < max(self._common.get(w, 0) for w in spelt(v))}
            known = self._found[key] = tuple(sorted(values))
        return known

    def trades_of(self, token: str) -> tuple[str, ...]:
        """Trades that a token may name: in full, misspelt, cut short, or with letters left out."""
        key = (token, "trades")
        known = self._found.get(key)
        if known is None:
            known = self._found[key] = self._trades(token)
        return known

    def _trades(self, token: str) -> tuple[str, ...]:
        if named := self._find(token, "trade"):
            return named
        if len(token) < 3:
            return ()
        if cut := {t for t, w in self._trade_words if w.startswith(token)}:
            return tuple(sorted(cut))
        return tuple(sorted({t for t, w in self._trade_words if w[0] == token[0] and len(token) < len(w) and _left_out(token, w)}))

    def formal_names(self, token: str) -> tuple[str, ...]:
        """Formal first names of a name, nickname or slight misspelling of a long name."""
        if token in _FORMAL:
            return _FORMAL[token]
        return self._find(token, "first") if len(token) >= 6 else ()

    def _settle(self, hits: list[tuple[int, str, tuple[str, ...]]], words: list[str], short: set[str]) -> list[tuple[str, ...]]:
        """Takes the trade words out of ``words``. Where tokens name different trades, those written in full count, and the others are plain words.

        An abbreviation without a dot is a plain word beside a single short word, as in a name of two words one of which looks like an abbreviation.
        """
        sure = [h for h in hits if heard(h[1]) in self._heard_trades]
        if sure and len(sure) < len(hits) and not set.intersection(*(set(h[2]) for h in hits)):
            hits = sure
        rest = [w for k, w in enumerate(words) if k not in {h[0] for h in hits}]
        if len(rest) == 1 and 1 < len(rest[0]) < 10:
            hits = [h for h in hits if h in sure or h[1] in short]
        for at, _, _ in reversed(hits):
            del words[at]
        return [h[2] for h in hits]

    def _part(self, text: str) -> list[dict]:
        text = re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", text)  # l.l.c. -> llc.
        text = re.sub(r"\(p\)|\bp\.? (?=ltd|limited)|m/s|\ba (?=respon)", " ", text)
        text = _BEHIND.sub(r"\2 \1", text)
        tokens = _joined_letters(_TOKENS.findall(text.replace("'", "")))
        short = set(_CUT.findall(text))
        lead, hits, words = "", [], []
        for t in tokens:
            if t in EMPTY and len(t) > 1 and t not in _FORMAL:
                continue
            if lead_word := self._lead(t, short):
                lead = lead_word
            elif (len(t) > 1 and self._find(t, "legal")) or self._find(t, "beside") or t in ("schl", "clnc", "std", "stud", "clin", "sch"):
                continue
            elif len(t) > 2 and not (t in _FORMAL and t not in short) and (named := self.trades_of(t)):
                hits.append((len(words), t, named))
                words.append(t)
            else:
                words.append(t)
        spelt = "".join(w[0] for w in words if w.isalpha())
        trades = self._settle(hits, words, short)
        if lead and not any(len(w) > 1 for w in words):
            lead, words = "", [lead, *words]
        # a person: a first name or an initial beside one surname
        long = [w for w in words if len(w) > 1]
        formal = [w for w in long if self.formal_names(w)]
        others = [w for w in long if w not in formal]
        initials = [w for w in words if len(w) == 1 and w.isalpha()]
        firm = lambda readings, guess, lead: {"kind": "f", "readings": readings, "guess": guess, "lead": lead, "trades": _one(trades), "firsts": [], "middle": ""}
        if others and len("".join(others)) >= 4 and (formal or (initials and len(others) == 1)) and len(others) <= 2 and not lead:
            names = [set(self.formal_names(w)) for w in formal]
            firsts = sorted(set.intersection(*names) or names[0]) if formal else []
            if not firsts and initials:
                firsts, initials = [initials[0]], initials[1:]
            middle = initials[0] if initials else ""
            person = {"kind": "p", "readings": [[a, ""] for a in spellings("".join(others))], "guess": False, "lead": "", "trades": _one(trades), "firsts": firsts, "middle": middle}
            if len(others) == 1 or initials:
                return [person]
            return [person, firm(*_readings(long), "")]
        if any(w in _LEGAL_LETTERS for w in initials):
            words = [w for w in words if w not in _LEGAL_LETTERS]
        words = [w for w in words if len(w) > 1 or w.isdigit()] or words
        if not words:
            return []
        out = [firm(*_readings(words), lead)]
        if not lead and len(words) in (3, 4):
            # the first word may be one that the corpus leaves out, rarely
            out.append(firm(_readings(words[1:])[0], True, words[0]))
        if len(words) >= 3 and 3 <= len(spelt) <= 6:
            out.append(firm([[spelt, ""]], True, lead) | {"trades": []})
        return out

    def _lead(self, token: str, short: set[str]) -> str:
        if token in short and len(token) >= 3 and (cut := [w for w in self._leads if w.startswith(token)]):
            return cut[0]
        return next(iter(self._find(token, "lead")), "")

    def parse(self, name: str | None) -> list[dict]:
        """Readings of a name: one or more per name it holds. None of null, blank and placeholder names."""
        text = plain(name)
        if not text:
            return []
        said = [x for x in _OTHER_NAME.split(text) if x.strip()]
        parts = [(x, p) for x in said if (p := self._part(x))]
        if len(parts) > 1:
            parts = [(x, p) for x, p in parts if not any(self._find(t, "shop") for t in _TOKENS.findall(x))] or parts[-1:]
        return [x for _, p in parts for x in p]


def parse_name(name: str | None) -> list[dict]:
    """:meth:`Reader.parse` without a corpus."""
    return Reader().parse(name)


def vocabulary(names: DataFrame) -> tuple[dict[str, int], list[str], list[str]]:
    """Common words with their counts, leads and trades of the corpus of ``names`` (``value``, ``text``, distinct).

    Counts are over all names. A word is an affix where names stand with it and without it: the rest of a name without its first (last) word is
    another whole name, legal forms left out. What comes to the driver is bounded by ``COMMON_ONE_IN``.
    """
    tokens = F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))
    ignored = F.array(*(F.lit(w) for w in sorted({*LEGAL, *EMPTY})))
    words = materialise(names.select(F.filter(tokens, lambda w: (F.length(w) > 1) & ~F.array_contains(ignored, w)).alias("words")))
    least = max(COMMON_FROM, -(-words.count() // COMMON_ONE_IN))
    common = {r.word: r.n for r in words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}
    size = F.size("words")
    whole = words.where(size >= 2).select(F.xxhash64("words").alias("rest")).distinct()
    ends = words.where(size >= 3).select(
        F.explode(F.array(
            F.struct(F.lit("lead").alias("role"), F.col("words")[0].alias("word"), F.xxhash64(F.slice("words", 2, size)).alias("rest")),
            F.struct(F.lit("trade").alias("role"), F.element_at("words", -1).alias("word"), F.xxhash64(F.slice("words", 1, size - 1)).alias("rest")),
        )).alias("e")
    ).select("e.*").distinct()
    kept = ends.join(whole.withColumn("stands", F.lit(1)), "rest", "left").groupBy("role", "word").agg(F.count("stands").alias("both"), F.count(F.lit(1)).alias("n"))
    kept = kept.where((F.col("both") >= AFFIX_RESTS) & (F.col("both") >= AFFIX_SHARE * F.col("n"))).orderBy(F.desc("both"), "word").select("role", "word", "both").collect()
    plainly = Reader()
    known = set(_FORMAL) | {*BESIDE, *SHOPS}
    best = {w: max((r.both, r.role) for r in kept if r.word == w)[1] for w in {r.word for r in kept} & common.keys() - known if len(w) >= 3 and not plainly.trades_of(w)}
    return common, sorted(w for w, role in best.items() if role == "lead"), sorted(w for w, role in best.items() if role == "trade")


_FORM = "kind string, readings array<array<string>>, guess boolean, lead string, trades array<string>, firsts array<string>, middle string"


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch = batch.assign(text=[plain(v) for v in batch["value"]])
        yield batch[batch["text"] != ""]


def _parser(known):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*known.value)
        for batch in batches:
            rows = [(value, p["kind"], p["readings"], p["guess"], p["lead"], p["trades"], p["firsts"], p["middle"]) for value, text in zip(batch["value"], batch["text"]) for p in reader.parse(text)]
            yield pd.DataFrame(rows, columns=["value", "kind", "readings", "guess", "lead", "trades", "firsts", "middle"])

    return run


def name_forms(names: DataFrame) -> DataFrame:
    """``value, kind, key, rarity, lead, trades, firsts, middle``: every canonical rewriting of each distinct name.

    ``key`` joins the two distinguishing words of a firm in alphabetical order, or a person's surname and first initial.
    Words count over all names; readings of a token split or joined are kept only where both words are known otherwise.
    """
    texts = materialise(names.select("value").where("value is not null").distinct().mapInPandas(_plain, "value string, text string"))
    known = names.sparkSession.sparkContext.broadcast(vocabulary(texts))
    parsed = materialise(texts.mapInPandas(_parser(known), "value string, " + _FORM))
    read = parsed.select("*", F.posexplode("readings").alias("reading", "words")).drop("readings")
    read = read.withColumn("w1", F.col("words")[0]).withColumn("w2", F.col("words")[1]).drop("words")
    natural = read.where("not guess")
    words = natural.select(F.col("w1").alias("word")).unionAll(natural.select(F.col("w2"))).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    guessed = read.where("guess")
    unsure = guessed.select(F.col("w1").alias("word")).unionAll(guessed.select(F.col("w2"))).where("word <> ''").distinct().select("word", F.lit(0).cast("long").alias("n"))
    known = materialise(rewritings(words.unionByName(unsure)).join(words.where("n > 0").select(F.col("word").alias("form")), "form", "left_semi").select("word", "form", "rarity"))
    first = known.select(F.col("word").alias("w1"), F.col("form").alias("f1"), F.col("rarity").alias("r1"))
    second = known.select(F.col("word").alias("w2"), F.col("form").alias("f2"), F.col("rarity").alias("r2"))
    alone = read.where("w2 = ''").join(first, "w1").withColumn("f2", F.lit("")).withColumn("r2", F.lit(1.0))
    both = read.where("w2 <> ''").join(first, "w1").join(second, "w2")
    formed = alone.unionByName(both)
    key = F.when(F.col("kind") == "f", F.concat_ws(" ", F.lit("f"), F.least("f1", "f2"), F.greatest("f1", "f2"))).otherwise(F.concat_ws(" ", F.lit("p"), "f1", F.col("initial")))
    persons = F.when(F.size("firsts") > 0, F.transform("firsts", lambda x: F.substring(x, 1, 1))).otherwise(F.array(F.lit("")))
    return (
        formed.withColumn("initial", F.explode(F.array_distinct(persons)))
        .select("value", "kind", key.alias("key"), (F.col("r1") * F.col("r2")).alias("rarity"), "lead", "trades", "firsts", "middle")
        .groupBy("value", "kind", "key", "lead", "trades", "firsts", "middle")
        .agg(F.max("rarity").alias("rarity"))
    )


def same_lead(a, b):
    """Whether the words before two names may be one: either is missing, cut short or slightly misspelt."""
    begins = lambda x, y: (F.length(x) >= 3) & y.startswith(x)
    return (a == "") | (b == "") | (a == b) | begins(a, b) | begins(b, a) | ((F.length(a) >= 5) & (F.levenshtein(a, b) <= 1))


def agreeing(a, b):
    """Whether two forms of one key are one name: what both state must agree. ``a`` and ``b`` give a form's column by name."""
    either = lambda c: (a(c) == "") | (b(c) == "") | (a(c) == b(c))
    trades = (F.size(a("trades")) == 0) | (F.size(b("trades")) == 0) | F.arrays_overlap(a("trades"), b("trades"))
    # a first name against an initial agrees by the key; two full names must be one
    full = lambda side: F.exists(side("firsts"), lambda x: F.length(x) > 1)
    firsts = ~(full(a) & full(b)) | F.arrays_overlap(a("firsts"), b("firsts"))
    person = (a("kind") == "f") | ((F.size(a("firsts")) > 0) & (F.size(b("firsts")) > 0))
    return same_lead(a("lead"), b("lead")) & either("middle") & trades & firsts & person


def side(alias: str):
    """Columns of a joined side by name."""
    return lambda c: F.col(f"{alias}.{c}")


#: Names of one key that one task joins; larger keys are salted.
NAMES_A_PART = 500


def name_links(names: DataFrame) -> DataFrame:
    """``value_a, value_b, rarity``: distinct names that are spellings of one name, each pair once, ``value_a < value_b``.

    ``rarity`` is the best product of the two rewritings' rarities, 1 where both names stand as the corpus spells them.
    """
    forms = materialise(name_forms(names))
    parts = forms.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / NAMES_A_PART).cast("int").alias("parts"))
    forms = forms.join(parts, "key")
    a = forms.withColumn("part", F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")).alias("a")
    b = forms.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    joined = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.value") < F.col("b.value")))
    return joined.where(agreeing(side("a"), side("b"))).groupBy(F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b")).agg(F.max(F.col("a.rarity") * F.col("b.rarity")).alias("rarity"))


def once(records: DataFrame, column: str) -> DataFrame:
    """``entity_id, value``: one row per entity however often delivered, the greatest value where they differ."""
    return records.where("entity_id is not null").groupBy("entity_id").agg(F.max(column).alias("value")).where("value is not null")


def spelling_pairs(records: DataFrame) -> DataFrame:
    """``id_a, id_b`` of entities whose names are spellings of one name but not the same string.

    Null, blank and placeholder names pair with nothing; names of any length are read whole. Linking is between distinct
    names, so copies of a name cost nothing until they are expanded.
    """
    entities = materialise(once(records, "business_name"))
    return expand(name_links(entities), entities)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(table(spark, sf_dir, "source_records"))
