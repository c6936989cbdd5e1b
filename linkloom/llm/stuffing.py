"""Problem 10: pages of repeated keywords, links or product tags, by their rank-frequency curves.

Every page's curve of ln frequency over ln rank is fitted by least squares in SQL. Slope, residual and divergence of its classes of words are held
against those of prose of the same language at comparable lengths, which the corpus itself gives; extremes are flagged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.runtime import materialise, small, table

#: Frequent function words of the corpus' languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that for not was were with as be by this on are which it from an or we at has have does its than when whether how can our will may",
    "de": "der die das den dem des und ist nicht mit für von ein eine einen einer einem auf sich dass daß wir als auch bei aus zu im wird werden wurden sofern oder es sei wie gilt nach über",
    "fr": "le la les des du de et est que qui pour dans un une il sur par avec en ne pas plus ou nous se ce cette soit lorsque reste mais au aux comme sont être",
    "es": "el la los las del de que se es una un con no lo su al como cuando sigue siendo por para sea en esto este pero más son está queremos sus ha",
}
#: Commands whose argument is not text of the body.
_COMMANDS = "title|author|date|documentclass|documentstyle|usepackage|begin|end|cite|citep|citet|ref|eqref|label|input|include|bibitem|bibliography|bibliographystyle|pagestyle|includegraphics|color|textcolor|fontsize"

#: Markup, keys, fields and identifiers of bibliographies and long runs of encoded data are no words.
_UNITS = re.compile(
    r"https?://[^\s{}]+|(?<!\\)%[^\n]*|\\(?:" + _COMMANDS + r")\*?(?:\[[^\]\n]*\])?(?:\{[^{}]*\})*|[a-z0-9+/]{64,}={0,2}|@[a-z]+\{[^\s,{}]*|[a-z]+\s*=\s*(?=[{\"\d])|10\.\d{4,}/[^\s{}]+|\\[a-z]+\*?|#[^\W\d_]+|[^\W\d_]{2,}"
)
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")

_LANGS = tuple(FUNCTION_WORDS)
_IN = {w: tuple(k for k, lang in enumerate(_LANGS) if w in FUNCTION_WORDS[lang].split()) for w in " ".join(FUNCTION_WORDS.values()).split()}

#: Nats by which a page's classes must diverge from prose to be flagged whatever its curve, and with an extreme curve.
DIVERGENCE, WITH_CURVE = 0.16, 0.08
#: Standard deviations from prose at which a slope (steeper) and a residual (greater) are extreme.
STEEP, UNEVEN = 3.0, 5.0
#: Nats that all units of a page together must give: a few words diverge by chance.
EVIDENCE = 5.0
#: Units from which a page counts as prose of its language, pages of one length from which they are a reference of their own.
PROSE_UNITS, REFERENCE_PAGES = 16, 10
#: Share of links and tags that any text may have.
FEW_POINTERS = 0.01
#: Share of function words that is enough for prose, whatever is usual.
ENOUGH_FUNCTION = 0.5
#: Least standard deviation of slopes and residuals.
LEAST_DEVIATION = 0.03

#: Pages that Python takes up at a time.
PAGES_A_SLICE = 512

_SPECTRUM = pa.list_(pa.struct([("f", pa.int64()), ("v", pa.int64())]))
_PAGE = "lang string, units bigint, function bigint, pointers bigint, spectrum array<struct<f:bigint,v:bigint>>"


def page_counts(text: str | None, lang: str | None) -> tuple:
    """What a page's curve is made of: its language, its units, how many are function words and how many links or hash tags, and the number of kinds of each frequency.

    A kind is a word; all links are one kind, and so are all hash tags. The language is that of most function words, the stated one in doubt.
    A function word of any of the languages counts as one.
    """
    text = (text or "").lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    start = text.find("\\begin{document}")
    units = Counter(_UNITS.findall(text, start + 16 if start >= 0 else 0))
    links = tags = words = function = 0
    spectrum: Counter[int] = Counter()
    hits = [0] * len(_LANGS)
    for unit, f in units.items():
        head = unit[0]
        if head in "\\%@1":
            continue
        if head == "#":
            tags += f
        elif head == "h" and unit.startswith(("http://", "https://")):
            links += f
        elif unit.isalpha() and len(unit) < 64:
            words += f
            spectrum[f] += 1
            if known := _IN.get(unit):
                function += f
                for k in known:
                    hits[k] += f
    for f in (links, tags):
        if f:
            spectrum[f] += 1
    best = max(range(len(_LANGS)), key=lambda k: (hits[k], _LANGS[k] == lang))
    return _LANGS[best], words + links + tags, function, links + tags, [{"f": f, "v": k} for f, k in sorted(spectrum.items(), reverse=True)]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 3, _SPECTRUM]
    names = ["lang", "units", "function", "pointers", "spectrum"]
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_A_SLICE):
            part = batch.slice(at, PAGES_A_SLICE)
            rows = [page_counts(t, g) for t, g in zip(part.column("text").to_pylist(), part.column("lang").to_pylist())]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])


def rank_curves(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, lang, units, function, pointers, size``, its curve's ``slope`` and ``residual``, and its ``divergence``.

    The curve is a staircase: at every frequency f it runs from the first to the last rank of the words seen f times, and behind the last rank it falls to once.
    The corners' ranks are running counts, a window over the page's frequencies; ``slope`` and ``residual`` (root mean square) are those of the
    least-squares line of ln f over ln rank through them. ``divergence`` is the relative entropy of the shares of function words, links and tags, and
    other words from the usual ones of the language at that length (``size``, power of two of units): pooled over its pages
    with at least half the median share of function words, so that copies of one stuffed page don't shift it; function words not below and
    pointers not above those of the whole language. Pages without units have no curve and diverge by 0. Whole texts of all pages count.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text", "lang").mapInArrow(_pages, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {_PAGE}")
    pages = materialise(texts.withColumn("page", F.monotonically_increasing_id()).withColumn("size", F.floor(F.log2(F.greatest(F.col("units"), F.lit(1))))))
    curves = spark.sql(
        """
        with steps as (
          select page, f, v, sum(v) over (partition by page order by f desc) as last, row_number() over (partition by page order by f) as up
          from (select page, inline(spectrum) from {pages} where units > 0)
        ),
        corners as (
          select page, inline(if(up = 1, array(named_struct('x', ln(last - v + 1), 'y', ln(f)), named_struct('x', ln(last), 'y', ln(f)), named_struct('x', ln(last + 1), 'y', 0d)),
                                         array(named_struct('x', ln(last - v + 1), 'y', ln(f)), named_struct('x', ln(last), 'y', ln(f))))) from steps
        )
        select page, coalesce(regr_slope(y, x), 0d) as slope,
          sqrt(greatest(0d, regr_syy(y, x) - coalesce(try_divide(regr_sxy(y, x) * regr_sxy(y, x), regr_sxx(y, x)), 0d)) / count(*)) as residual
        from corners group by page
        """,
        pages=pages,
    )
    return _divergence(pages).join(curves, "page", "left").drop("page", "spectrum")


def _divergence(pages: DataFrame) -> DataFrame:
    """``pages`` with the divergence of their classes from the usual shares. What is joined is one row per language and length."""
    share = F.col("function") / F.col("units")
    read = pages.where(F.col("units") >= PROSE_UNITS)
    middle = small(read.groupBy("lang").agg(F.percentile_approx(share, 0.5).alias("middle")))
    cells = read.join(middle, "lang").where(share >= F.col("middle") / 2).groupBy("lang", "size").agg(F.sum("function").alias("function"), F.sum("pointers").alias("pointers"), F.sum("units").alias("units"))
    whole = cells.groupBy("lang").agg(((F.sum("function") + 1) / (F.sum("units") + 3)).alias("f"), ((F.sum("pointers") + 0.01) / (F.sum("units") + 3)).alias("p"))
    own = cells.select("lang", "size", ((F.col("function") + 1) / (F.col("units") + 3)).alias("own_f"), ((F.col("pointers") + 0.01) / (F.col("units") + 3)).alias("own_p"))
    usual_f, usual_p = F.least(F.greatest("own_f", "f"), F.lit(ENOUGH_FUNCTION)), F.least("own_p", "p") + FEW_POINTERS
    has_f, has_p = (F.col("function") + 0.01) / (F.col("units") + 0.02), (F.col("pointers") + 1e-4) / (F.col("units") + 0.02)
    entropy = lambda has, usual: has * F.log(has / usual)
    other = F.greatest(F.lit(1e-6), 1 - has_f - has_p)
    total = entropy(has_f, usual_f) + entropy(has_p, usual_p) + entropy(other, F.greatest(F.lit(1e-6), 1 - usual_f - usual_p))
    joined = pages.join(small(own), ["lang", "size"], "left").join(small(whole), "lang", "left")
    # more function words than usual is no sign
    level = has_f.isNotNull() & (has_f >= usual_f) & (has_p <= usual_p)
    return joined.withColumn("divergence", F.when((F.col("units") == 0) | level, 0.0).otherwise(F.coalesce(total, F.lit(0.0)))).drop("own_f", "own_p", "f", "p")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """``doc_id`` of pages that are for the most part keywords, links or tags.

    A page is one if its classes of words diverge extremely from prose of its language at comparable lengths, or if they
    diverge clearly and its curve is extreme: its slope lies ``STEEP`` deviations below, or its residual ``UNEVEN`` above, the
    means over prose pages of that language and length (of the language, where there are fewer than ``REFERENCE_PAGES``; without any the
    divergence alone counts). All units of the page together must give ``EVIDENCE``, so null, empty and blank texts, stubs, style files and tables of
    numbers, which have few words, are none. Each row is judged by itself, so copies come out alike. No rows give no rows.
    """
    curves = materialise(rank_curves(documents))
    prose = curves.where((F.col("units") >= PROSE_UNITS) & (F.col("divergence") < 0.05))
    figures = lambda name: [x for c in ("slope", "residual") for x in (F.avg(c).alias(f"{name}_{c}"), F.stddev(c).alias(f"{name}_{c}_by"))]
    own = small(prose.groupBy("lang", "size").agg(*figures("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= REFERENCE_PAGES).drop("n"))
    whole = small(prose.groupBy("lang").agg(*figures("all"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= REFERENCE_PAGES).drop("n"))
    far = lambda c: (F.col(c) - F.coalesce(f"own_{c}", f"all_{c}")) / F.greatest(F.coalesce(f"own_{c}_by", f"all_{c}_by"), F.lit(LEAST_DEVIATION))
    extreme = (far("slope") <= -STEEP) | (far("residual") >= UNEVEN)
    held = curves.join(own, ["lang", "size"], "left").join(whole, "lang", "left").where(F.col("units") * F.col("divergence") >= EVIDENCE)
    return held.where((F.col("divergence") >= DIVERGENCE) | ((F.col("divergence") >= WITH_CURVE) & F.coalesce(extreme, F.lit(False)))).select("doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(table(spark, sf_dir, "documents"))
