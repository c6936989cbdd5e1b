"""Problem 5: text that looks the same brought to one form.

Words are matched against tries of the corpus' plain words by a weighted edit automaton: look-alike characters and ignorable ones cost nothing, the
less likely readings of a character a little, other edits a whole; the cheapest word under the bound is the canonical spelling. The vocabulary is not held
in one place: plain words and odd tokens meet by their outline, in which letters that one character may stand for are one, and
each outline has its trie. Tokens that match no word are normalised by the table alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.pairs import pairs_within
from linkloom.runtime import materialise, small, table

#: Characters and the Latin letters, digits or marks that they look like, the likeliest first.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "Il",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "ѵ": "v", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "lI",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "κ": "k",
    # Armenian
    "Օ": "O", "Տ": "S", "Ս": "U", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮤ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin letters of phonetic use, letter-like signs
    "ɑ": "a", "ɡ": "g", "ℓ": "l", "K": "K", "Å": "Å", "ǀ": "lI|",
    # marks
    "‐": "-", "‑": "-", "՚": "’", "ʼ": "’", "＇": "'", "∕": "/", "⁄": "/", "։": ":", "∶": ":", "‚": ",", "․": ".",
}

#: Cost of a character's second and further readings, of any other edit, and the greatest cost of a match: no edit that changes the looks is within it.
LESS_LIKELY, EDIT, BOUND = 0.1, 1.0, 0.9

_SPACES = re.compile(r"(\s+)")


def _ignorable(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠㅤﾠ᠎" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


#: Ranges of full-width forms, ligatures, Roman numerals and mathematical letters, which are their compatibility forms.
_DRAWN = ((0xFF00, 0xFFEF), (0xFB00, 0xFB06), (0x2160, 0x217F), (0x1D400, 0x1D7FF))


class _Forms(dict):
    """Per character the strings it may stand for: none of ignorables; worked out when first met."""

    def __missing__(self, ch: str) -> tuple[str, ...]:
        if ch < "\x7f":
            forms = (ch,)
        elif _ignorable(ch):
            forms = ("",)
        elif unicodedata.category(ch) == "Zs":
            forms = (" ",)
        elif ch in LOOKALIKES:
            forms = tuple(LOOKALIKES[ch])
        elif any(low <= ord(ch) <= high for low, high in _DRAWN):
            forms = (unicodedata.normalize("NFKC", ch),)
        else:
            forms = (ch,)
        self[ch] = forms
        return forms


_forms = _Forms()


def by_table(text: str) -> str:
    """Every character by the table's first letter, ignorables dropped, accents composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join([_forms[ch][0] for ch in text]))


#: Letters that one character may stand for, each with the one that stands for all of them in an outline.
_SAME = {letter: forms[0] for forms in LOOKALIKES.values() if len(forms) > 1 for letter in sorted(forms)}


def outline(word: str) -> str:
    """``word`` by the table, with letters that one character may stand for made one."""
    return "".join([_SAME.get(ch, ch) for ch in by_table(word)])


class Trie:
    """Vocabulary as nested maps; ``None`` ends a word. Given words come in the order of preference at equal cost."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for place, word in enumerate(words):
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node.setdefault(None, (place, word))

    def match(self, token: str, bound: float = BOUND) -> tuple[float, str] | None:
        """(cost, word) of the cheapest word within ``bound``, the preferred one of several.

        The automaton's states are trie nodes with the least cost that reaches them. A character moves along each of its readings, ignorables
        stay for nothing; replacing, leaving out and adding a character costs ``EDIT``.
        """
        states = self._added({id(self.root): (0.0, self.root)}, bound)
        for ch in token:
            forms = _forms[ch]
            if forms == ("",):
                continue
            after: dict[int, tuple[float, dict]] = {}

            def reach(cost: float, node: dict) -> None:
                if cost <= bound and (id(node) not in after or cost < after[id(node)][0]):
                    after[id(node)] = (cost, node)

            for cost, node in states.values():
                for k, form in enumerate(forms):
                    to = node
                    for part in form:
                        to = to.get(part)
                        if to is None:
                            break
                    if to is not None:
                        reach(cost + LESS_LIKELY * (k > 0), to)
                if cost + EDIT <= bound:
                    reach(cost + EDIT, node)
                    for part, to in node.items():
                        if part is not None:
                            reach(cost + EDIT, to)
            states = self._added(after, bound)
            if not states:
                return None
        ends = [(cost, *node[None]) for cost, node in states.values() if None in node]
        if not ends:
            return None
        cost, _, word = min(ends)
        return cost, word

    def _added(self, states: dict, bound: float) -> dict:
        """States with those that characters added to the token reach."""
        todo = [x for x in states.values() if x[0] + EDIT <= bound]
        while todo:
            cost, node = todo.pop()
            for part, to in node.items():
                if part is not None and cost + EDIT <= bound and (id(to) not in states or cost + EDIT < states[id(to)][0]):
                    states[id(to)] = (cost + EDIT, to)
                    todo.append(states[id(to)])
        return states


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as words and the spacing between them; every kind of space is one, accents are composed."""
    for batch in batches:
        out = []
        for text in batch.column("value").to_pylist():
            spaced = "".join([" " if _forms[ch] == (" ",) else ch for ch in text])
            out.append([p for p in _SPACES.split(unicodedata.normalize("NFC", spaced)) if p])
        yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(out, pa.list_(pa.string()))], names=["value", "parts"])


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([outline(t) for t in batch.column("part").to_pylist()], pa.string())], names=["part", "outline"])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = []
        for token, words in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist()):
            found = Trie(words).match(token) if words else None
            forms.append(found[1] if found else by_table(token))
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(forms, pa.string())], names=["part", "spelt"])


def spellings_of(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``part, spelt``: the canonical spelling of each distinct ``part`` of ``tokens`` by the plain words of ``texts`` (``value``).

    All plain words of all texts are counted; only those that share the outline of a token go on, the more frequent first.
    A trie holds the words of one outline, which differ only in letters that one character may stand for.
    """
    outlined = materialise(tokens.select("part").distinct().mapInArrow(_outlined, "part string, outline string"))
    folded = F.translate("word", "".join(_SAME), "".join(_SAME.values()))
    plain_words = texts.select(F.explode(F.split("value", r"\s+")).alias("word")).where(F.col("word").rlike(r"^[!-~]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    tries = (
        plain_words.withColumn("outline", folded)
        .join(outlined.select("outline").distinct(), "outline", "left_semi")
        .groupBy("outline")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), lambda x: x["word"]).alias("words"))
    )
    return outlined.join(tries, "outline", "left").select("part", "words").mapInArrow(_matched, "part string, spelt string")


def one_form(texts: DataFrame) -> DataFrame:
    """``texts`` (``value`` and other columns) with ``form``, equal for values that look alike.

    Null stays null, empty stays empty, plain text is its own form. The others are read word by word, each distinct value once.
    """
    plain = F.col("value").rlike(r"^[\x00-\x7f]*$")
    odd = materialise(texts.where(~plain).select("value").distinct().mapInArrow(_parts, "value string, parts array<string>"))
    placed = odd.select("value", F.posexplode("parts").alias("place", "part"))
    strange = ~F.col("part").rlike(r"^[\x00-\x7f]*$")
    spelt = spellings_of(texts.where("value is not null"), placed.where(strange))
    read = placed.where(strange).join(small(materialise(spelt)), "part").select("value", "place", F.col("spelt").alias("part")).unionByName(placed.where(~strange).select("value", "place", "part"))
    forms = read.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "").alias("form"))
    changed = texts.where(~plain).join(forms, "value").select(*texts.columns, "form")
    return texts.where(plain | F.col("value").isNull()).withColumn("form", F.col("value")).unionByName(changed)


def fields(records: DataFrame) -> DataFrame:
    """``entity_id, field_name, value``, one row per entity and field however often it was delivered; blank values are left out.

    Of differing values of one entity the greatest holds.
    """
    once = records.where("entity_id is not null").groupBy("entity_id").agg(F.max("business_name").alias("business_name"), F.max("business_address").alias("business_address"))
    long = once.select("entity_id", F.explode(F.create_map(F.lit("business_name"), "business_name", F.lit("business_address"), "business_address")).alias("field_name", "value"))
    return long.where("value is not null and trim(value) <> ''")


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """``id_a, id_b, field_name`` of entities whose values of a field look the same but aren't the same string.

    Values that look like nothing at all make no pairs. Only forms with at least two different strings are paired.
    """
    formed = materialise(one_form(materialise(fields(records))).where("trim(form) <> ''"))
    return pairs_within(formed, ["field_name", "form"], "entity_id", "value").select("id_a", "id_b", "field_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "source_records"))
