"""Lower-case Latin forms of names and addresses, folding of spelling by ear, and correction against the corpus' own words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from linkloom.llm.lookalike import by_table
from linkloom.runtime import materialise

#: Texts that stand for nothing.
PLACEHOLDERS = frozenset("null none nil n/a na n.a. #n/a nan unknown not-available not-known unnamed tbd tba test xxx x - -- . ? 0 void undefined missing blank empty".split()) | {"not available", "not known", "no name", "no address", "not applicable"}

_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "ð": "d", "þ": "th"}


def _indic(ch: str) -> tuple[str, str]:
    """(consonant or vowel by its Unicode name, kind) of a letter of an Indic script: every block names its letters alike."""
    name = unicodedata.name(ch, "")
    if "VOWEL SIGN " in name:
        return name.rsplit(" ", 1)[1].lower(), "sign"
    if name.endswith("SIGN VIRAMA"):
        return "", "sign"
    if name.endswith("SIGN NUKTA"):
        return "", "nukta"
    if name.endswith(("SIGN ANUSVARA", "SIGN CANDRABINDU")):
        return "n", "mark"
    if " LETTER " in name:
        sound = name.rsplit(" ", 1)[1].lower()
        if sound[0] in "aeiou" or sound.startswith("vocalic"):
            return sound.replace("vocalic", "r"), "vowel"
        return sound[:-1] if sound.endswith("a") else sound, "consonant"
    return ch, "other"


def _transliterate(text: str) -> str:
    """Indic letters by sound: the inherent vowel is written unless a sign or the end of the word follows it."""
    out: list[str] = []
    due = False
    for ch in unicodedata.normalize("NFD", text):
        if not 0x0900 <= ord(ch) <= 0x0D7F:
            if due:
                out.append("a")
                due = False
            out.append(ch)
            continue
        sound, kind = _indic(ch)
        if kind == "nukta":
            out[-1] = {"j": "z", "ph": "f"}.get(out[-1], out[-1])
            continue
        if due and kind != "sign":
            out.append("a")
        due = kind == "consonant"
        out.append(sound)
    return "".join(out) + "a" * due


def plain(text: str | None) -> str:
    """``text`` in lower-case Latin letters without accents; ``""`` of null, blank and placeholders."""
    if not text:
        return ""
    if not text.isascii():
        text = by_table(text)
        if any(0x0900 <= ord(ch) <= 0x0D7F for ch in text):
            text = _transliterate(text)
        text = "".join([_LETTERS.get(ch, ch) for ch in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(ch) != "Mn"])
    text = text.lower().strip()
    return "" if text in PLACEHOLDERS else text


#: Letters that different scripts and hands write for one sound; pairs that are heard alike.
_WRITTEN = (("ck", "k"), ("q", "k"), ("c", "k"), ("w", "v"))
_HEARD = (("ae", "a"), ("oe", "o"), ("ue", "u"), ("au", "o"), ("oo", "u"), ("ee", "i"), ("ph", "f"), ("zh", "j"))
_DOUBLED = re.compile(r"(.)\1+")


def written(word: str) -> str:
    for letters, letter in _WRITTEN:
        word = word.replace(letters, letter)
    return word


def heard(word: str) -> str:
    """``word`` with spellings that sound alike made one, and doubled letters single."""
    return _sounded(written(word))


def _sounded(word: str) -> str:
    for letters, letter in _HEARD:
        word = word.replace(letters, letter)
    return _DOUBLED.sub(r"\1", word)


def spellings(word: str) -> list[str]:
    """The word as written and, if that differs, as heard."""
    first = written(word)
    second = _sounded(first)
    return [first] if first == second else [first, second]


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours at most turns ``a`` into ``b``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


def _begins(word: str, form: str) -> bool:
    """Whether ``form`` begins with the word's first letter or with its first two swapped."""
    return word[0] == form[0] or word[:2] == form[1::-1]


@lru_cache(maxsize=512)
def _shorter(word: str, letters: int) -> frozenset[str]:
    """The word and what is left of it without up to so many letters. A few are kept, as one token is looked up in several lists."""
    out = {word}
    for _ in range(letters):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return frozenset(out)


class Lexicon:
    """Words found by themselves or by a slight misspelling: one edit, two in words of at least ``long`` letters."""

    def __init__(self, words: dict[str, object], least: int, long: int = 99):
        self._least, self._long = least, long
        self._exact = {heard(w): v for w, v in words.items()} | words
        self._once: dict[str, dict] = {}
        self._twice: dict[str, dict] = {}
        for w, v in words.items():
            for form in spellings(w):
                if len(w) >= least:
                    for key in _shorter(form, 1):
                        self._once.setdefault(key, {})[form] = v
                if len(w) >= long:
                    for key in _shorter(form, 2):
                        self._twice.setdefault(key, {})[form] = v
        self._once_keys, self._twice_keys = frozenset(self._once), frozenset(self._twice)
        #: first letter and length of what may be a misspelling by one edit, by two
        self._once_heads = {(form[0], len(form) + k) for w in words if len(w) >= least for form in spellings(w) for k in (-1, 0, 1)}
        self._twice_heads = {(form[0], len(form) + k) for w in words if len(w) >= long for form in spellings(w) for k in (-2, -1, 0, 1, 2)}

    def has(self, token: str) -> bool:
        """Whether ``token`` is one of the words or heard as one."""
        return token in self._exact or heard(token) in self._exact

    def find(self, token: str) -> list:
        """Values of the words that ``token`` may be. A misspelling has the word's first letter, if only at the second place."""
        if token in self._exact:
            return [self._exact[token]]
        folded = heard(token)
        if folded in self._exact:
            return [self._exact[folded]]
        if not self._least - 1 <= len(token) <= WORD_UP_TO:  # a letter may be missing
            return []
        forms, close = spellings(token), {}
        if near_ones := [f for f in forms if (f[0], len(f)) in self._once_heads or (f[1:2], len(f)) in self._once_heads]:
            close = {w: v for form in near_ones for key in _shorter(form, 1) & self._once_keys for w, v in self._once[key].items() if _begins(w, form) and near(w, form)}
        if not close and len(folded) >= self._long - 2:
            far_ones = [f for f in forms if (f[0], len(f)) in self._twice_heads or (f[1:2], len(f)) in self._twice_heads]
            close = {w: v for form in far_ones for key in _shorter(form, 2) & self._twice_keys for w, v in self._twice[key].items() if _begins(w, form)}
        return list(close.values())


def _deletions(word) -> list:
    """The word and what is left of it without any one letter, as columns."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


#: Letters below which a word isn't corrected, and above which a run of letters is no word to correct.
CORRECT_FROM, WORD_UP_TO = 5, 48
#: Mean length of two words from which they may differ in their first letter.
FIRST_FROM = 6
#: A word is a misspelling of a neighbour that is at least so many times as frequent, or if it is itself seen at most so often.
RATIO, RARE = 3, 2


def rewritings(words: DataFrame) -> DataFrame:
    """``word, form, rarity``: the spellings that each of ``words`` (``word, n``) may stand for, itself included.

    Two words are neighbours if leaving out at most one letter of each gives the same string; the join is on these strings.
    A neighbour is a form if it is counted at all and clearly more frequent, or if the word is rare and the neighbour not rarer (equal counts: the
    smaller string); every such neighbour is one. ``rarity`` is the share of the word's own count in the sum of both: small for a probable misspelling.
    """
    words = materialise(words.groupBy("word").agg(F.sum("n").alias("n")))
    keyed = words.where(F.length("word").between(CORRECT_FROM, WORD_UP_TO)).select("word", "n", F.explode(_deletions(F.col("word"))).alias("key"))
    other = keyed.where("n > 0").select(F.col("word").alias("form"), F.col("n").alias("m"), "key")
    close = (
        keyed.join(other, "key")
        .where((F.substring("word", 1, 1) == F.substring("form", 1, 1)) | (F.substring("word", 1, 2) == F.reverse(F.substring("form", 1, 2))) | (F.length("word") + F.length("form") >= 2 * FIRST_FROM))
        .where((F.col("word") != F.col("form")) & ((F.col("m") >= RATIO * F.col("n")) | ((F.col("n") <= RARE) & ((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("form") < F.col("word")))))))
        .select("word", "form", "n", "m")
        .distinct()
    )
    return close.select("word", "form", (F.col("n") / (F.col("n") + F.col("m"))).alias("rarity")).unionByName(words.select("word", F.col("word").alias("form"), F.lit(1.0).alias("rarity")))
