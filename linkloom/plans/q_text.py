"""Queries of the string and normalisation functions, and of the similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkloom.functions import similarity as sim, text
from linkloom.plans import views
from linkloom.plans.measures import measures_sql
from linkloom.plans.registry import query
from linkloom.plans.views import NF, P, PF, REC, TRUTH, VEC, cosine_sql, tokens_sql
from linkloom.runtime import table

_ASCII_NAME, _ASCII_ADDRESS = text.to_ascii_sql("business_name"), text.to_ascii_sql("business_address")


def _clean_sql(ascii_: str) -> str:
    out = f"replace({ascii_}, '&', ' and ')"
    for pattern, by in (("[^a-z0-9]+", " "), (r"\b(null|none|nan|n a)\b", " "), (r"\s+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def _name_sql(ascii_: str) -> str:
    out = _clean_sql(ascii_)
    for pattern, by in ((r"\bl l p\b", "llp"), (r"\bl l c\b", "llc"), (r"\bp\s?ltd\b", "pvt ltd"), (r"\bf k a\b", "fka"), (r"\bd b a\b", "dba")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


def _core_sql(words: str, drop: list[str]) -> str:
    kept = f"list_filter({words}, lambda t: t not in ({_list(drop)}))"
    return f"array_to_string(case when len({kept}) > 0 then {kept} else {words} end, ' ')"


def _map_sql(words: str, pairs: dict[str, str]) -> str:
    entries = ", ".join(f"'{k}': '{v}'" for k, v in pairs.items())
    return f"list_transform({words}, lambda t: coalesce(map {{{entries}}}[t], t))"


_NO_FKA = "list_filter(" + tokens_sql("n") + ", lambda t: t <> 'fka')"
_NAMES = f"with {REC}, a as materialized (select entity_id, {_ASCII_NAME} as a from rec), n as materialized (select entity_id, {_name_sql('a')} as n from a)"
_ADDRESSES = f"with {REC}, a as materialized (select entity_id, {_ASCII_ADDRESS} as a from rec), c as materialized (select entity_id, a, {_clean_sql('a')} as c from a)"
_RUNS = "regexp_extract_all(a, '([0-9]+)', 1)"
_NUMS = f"array_to_string(list_transform({_RUNS}, lambda d: coalesce(nullif(ltrim(d, '0'), ''), '0')), ' ')"
_POST = f"coalesce(list_filter({_RUNS}, lambda d: length(d) between 5 and 6)[-1], '')"


def _rec(make):
    """A query over records that adds one column."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.records(spark, sf_dir).select("entity_id", *make())

    return build


query("norm_ascii", f"with {REC} select entity_id, {_ASCII_NAME} as name_ascii, {_ASCII_ADDRESS} as addr_ascii from rec")(_rec(lambda: (text.to_ascii(F.col("business_name")).alias("name_ascii"), text.to_ascii(F.col("business_address")).alias("addr_ascii"))))
#: A vowel sign without its consonant before it, as where a word was split: the frames sound it otherwise.
_LOOSE = "(^|[\\s\\p{P}])[\\x{093E}-\\x{094D}]"


@query("norm_given", f"with {REC} select distinct n.entity_id, n.name_norm from normalised_frames n join rec using (entity_id) where n.name_norm is not null and not regexp_matches(coalesce(business_name, ''), '{_LOOSE}') and lower(trim(coalesce(business_name, ''))) <> 'n/a'")
def norm_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our normal form of the names that the given frames have; the frames themselves are the other side, so that no table of ours stands on both. Names with a loose vowel sign are left out."""
    given = table(spark, sf_dir, "normalised_frames").where("name_norm is not null").select("entity_id").distinct()
    rec = views.records(spark, sf_dir).join(given, "entity_id", "left_semi")
    name = F.coalesce(F.col("business_name"), F.lit(""))
    return rec.where(~name.rlike(_LOOSE) & (F.lower(F.trim(name)) != "n/a")).select("entity_id", text.name(F.col("business_name")).alias("name_norm"))


query("norm_clean", f"{_NAMES} select entity_id, {_clean_sql('a')} as cleaned from a")(_rec(lambda: (text.clean(F.col("business_name")).alias("cleaned"),)))
query("norm_name", f"{_NAMES} select entity_id, n as name_norm from n")(_rec(lambda: (text.name(F.col("business_name")).alias("name_norm"),)))
query("norm_core", f"{_NAMES} select entity_id, {_core_sql(_NO_FKA, [*text.LEGAL, *text.JOINING])} as name_core from n")(_rec(lambda: (text.core(text.name(F.col("business_name"))).alias("name_core"),)))
query("norm_addr", f"{_ADDRESSES} select entity_id, c as addr_norm from c")(_rec(lambda: (text.clean(F.col("business_address")).alias("addr_norm"),)))
query("norm_numbers", f"{_ADDRESSES} select entity_id, {_NUMS} as addr_nums from c")(_rec(lambda: (F.array_join(text.numbers(F.col("business_address")), " ").alias("addr_nums"),)))
query("norm_postcode", f"{_ADDRESSES} select entity_id, {_POST} as postcode from c")(_rec(lambda: (text.postcode(F.col("business_address")).alias("postcode"),)))


def normalised(records: DataFrame) -> DataFrame:
    """All normalised columns of the first kind in one pass over the records."""
    named = records.withColumn("name_norm", text.name(F.col("business_name"))).withColumn("addr_norm", text.clean(F.col("business_address")))
    return named.select("entity_id", "country", "name_norm", text.core(F.col("name_norm")).alias("name_core"), "addr_norm", F.array_join(text.numbers(F.col("business_address")), " ").alias("addr_nums"), text.postcode(F.col("business_address")).alias("postcode"))


@query(
    "norm_frame",
    f"{_NAMES}, c as materialized (select entity_id, {_ASCII_ADDRESS} as a from rec) select n.entity_id, rec.country, n.n as name_norm, {_core_sql(_NO_FKA.replace('string_split(n,', 'string_split(n.n,'), [*text.LEGAL, *text.JOINING])} as name_core, "
    f"{_clean_sql('c.a')} as addr_norm, {_NUMS.replace('(a,', '(c.a,')} as addr_nums, {_POST.replace('(a,', '(c.a,')} as postcode from n join rec using (entity_id) join c using (entity_id)",
)
def norm_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(views.records(spark, sf_dir))


_JOINED = r"list_filter(string_split(trim(regexp_replace(regexp_replace(' ' || replace(n, ' ', '  ') || ' ', ' ([a-z]) ', ' <\1> ', 'g'), '>\s+<', '', 'g')), ' '), lambda t: t <> '')"
_JOINED = f"list_transform({_JOINED}, lambda t: replace(replace(t, '<', ''), '>', ''))"


@query("norm_initials", f"with {NF}, n as (select entity_id, name_norm as n from nf) select entity_id, array_to_string({_JOINED}, ' ') as joined from n")
def norm_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("entity_id", F.array_join(text.joined_initials(text.tokens(F.col("name_norm"))), " ").alias("joined"))


@query("norm_core2", f"with {NF}, n as (select entity_id, {_JOINED.replace('(n,', '(name_norm,')} as w from nf) select entity_id, {_core_sql('w', [*text.LEGAL2, *text.JOINING2])} as name_core2 from n")
def norm_core2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("entity_id", text.core2(F.col("name_norm")).alias("name_core2"))


@query("norm_addr2", f"with {NF} select entity_id, array_to_string({_map_sql(tokens_sql('addr_norm'), text.ADDRESS_WORDS)}, ' ') as addr_norm2 from nf")
def norm_addr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).select("entity_id", text.address2(F.col("addr_norm")).alias("addr_norm2"))


query("str_record_text", f"with {REC} select entity_id, business_name || ' | ' || business_address as record_text from rec")(_rec(lambda: (text.record_text(F.col("business_name"), F.col("business_address")).alias("record_text"),)))
query("str_view_text", f"with {REC} select entity_id, 'query: ' || business_name as name_text, 'query: ' || business_address as addr_text, 'query: ' || business_name || ', ' || business_address as both_text from rec")(
    _rec(lambda: tuple(text.view_text(F.col("business_name"), F.col("business_address"), v).alias(f"{v}_text") for v in ("name", "addr", "both")))
)
_FLAT = r"trim(regexp_replace(business_address, '\s+', ' ', 'g'))"
query("str_clip", f"with {REC} select entity_id, case when length({_FLAT}) > 24 then substr({_FLAT}, 1, 24) || '…' else {_FLAT} end as clipped from rec")(_rec(lambda: (text.clip(F.col("business_address"), 24).alias("clipped"),)))
query("str_script", f"with {REC} select entity_id, case when regexp_matches(business_name, '[\\x{{0900}}-\\x{{097F}}]') then 'devanagari' when regexp_matches(business_name, '[\\x{{00C0}}-\\x{{024F}}]') then 'latin_accented' when regexp_matches(business_name, '[^\\x00-\\x7f]') then 'other_non_ascii' else 'ascii' end as script from rec")(
    _rec(lambda: (text.script(F.col("business_name")).alias("script"),))
)
query("str_redact", "select doc_id, regexp_replace(text, 'https?://[^ \\t\\n\\r\\f\\x0b]+', '<url>', 'g') as masked from documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("masked")))
query("str_strip_accents")(_rec(lambda: (text.stripped(F.col("business_name")).alias("stripped"),)))
query("str_francize")(_rec(lambda: (text.french(F.col("business_name")).alias("french_name"), text.french(F.col("business_address")).alias("french_address"))))
query("str_typo")(_rec(lambda: (text.typo(F.col("business_name"), 7).alias("typo"),)))
query("str_safe_name", f"with {REC} select entity_id, case when regexp_full_match(business_name, '[A-Za-z0-9_.-]+') and length(business_name) < 120 then business_name else sha1(business_name) end as file_name from rec")(_rec(lambda: (text.safe_name(F.col("business_name")).alias("file_name"),)))
query("str_prefix", f"with {REC} select 'tr:' || entity_id as train_id, entity_id || '#fr' as french_id, source from rec")(lambda spark, d: views.records(spark, d).select(F.concat(F.lit("tr:"), "entity_id").alias("train_id"), F.concat("entity_id", F.lit("#fr")).alias("french_id"), "source"))


@query("str_idlist", f"with {TRUTH}, l as (select s1_id, string_agg(cand_id, ' , ' order by cand_id) || ',,' || min(cand_id) as cell from truth group by s1_id) select s1_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(cell, ','), lambda t: trim(t)), lambda t: t <> ''))), ',') as ids from l")
def str_idlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parses lists of matches with blanks, empties and a repeat, as they are typed."""
    lists = views.truth(spark, sf_dir).groupBy("s1_id").agg(F.concat(F.array_join(F.array_sort(F.collect_list("cand_id")), " , "), F.lit(",,"), F.min("cand_id")).alias("cell"))
    return lists.select("s1_id", F.array_join(F.array_sort(text.id_list(F.col("cell"))), ",").alias("ids"))


@query("str_fingerprint", f"with {P} select count(*)::bigint as n, bit_xor(('0x' || substr(md5(s1_id || '|' || cand_id), 1, 15))::bigint) as fingerprint from p")
def str_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of a set of pairs that doesn't depend on their order: xor of the pairs' hashes, combined before the shuffle."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", "s1_id", "cand_id")), 1, 15), 16, 10).cast("bigint")
    return views.pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(hashed).alias("fingerprint"))


#: Wording and lengths of the question.
_ASKED = ("Business A (", "): ", "Record B: ", "Other businesses that record B also resembles:", "Is record B the same real-world business as business A? Answer Yes or No.", "Answer:")
_NAME_CUT, _ADDRESS_CUT, _RIVAL_NAME_CUT, _RIVAL_ADDRESS_CUT, _RIVALS_SHOWN = 80, 90, 60, 70, 3


def best_rivals(pairs: DataFrame, k: int) -> DataFrame:
    """``cand_id, s1_id, place``: the ``k`` best S1s of each record, equal scores by smaller id."""
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("prob"), "s1_id"))).where(F.col("place") <= k)


def _cut_sql(c: str, n: int) -> str:
    flat = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"case when length({flat}) > {n} then substr({flat}, 1, {n}) || '…' else {flat} end"


def _or_none(s: str) -> str:
    return f"coalesce(nullif({s}, ''), '(no address)')"


@query(
    "str_prompt",
    f"""with {REC}, {P}, best as (select cand_id, s1_id, row_number() over (partition by cand_id order by prob desc, s1_id) as place from p qualify place <= {_RIVALS_SHOWN + 1}),
    o as (select p.s1_id, p.cand_id, r.place, '  - ' || {_cut_sql('rec.business_name', _RIVAL_NAME_CUT)} || ' | ' || {_or_none(_cut_sql('rec.business_address', _RIVAL_ADDRESS_CUT))} as line
      from p join best r on r.cand_id = p.cand_id and r.s1_id <> p.s1_id join rec on rec.entity_id = r.s1_id
      qualify row_number() over (partition by p.s1_id, p.cand_id order by r.place) <= {_RIVALS_SHOWN}),
    g as (select s1_id, cand_id, string_agg(line, chr(10) order by place) as lines from o group by all)
    select p.s1_id, p.cand_id, '{_ASKED[0]}' || a.country || '{_ASKED[1]}' || {_cut_sql('a.business_name', _NAME_CUT)} || ' | ' || {_or_none(_cut_sql('a.business_address', _ADDRESS_CUT))} || chr(10) || '{_ASKED[2]}' ||
      {_cut_sql('b.business_name', _NAME_CUT)} || ' | ' || {_or_none(_cut_sql('b.business_address', _ADDRESS_CUT))} || chr(10) || '{_ASKED[3]}' || chr(10) || coalesce(g.lines, '  (none)') || chr(10) || '{_ASKED[4]}' || chr(10) || '{_ASKED[5]}' as prompt
    from p left join g using (s1_id, cand_id) join rec a on a.entity_id = p.s1_id join rec b on b.entity_id = p.cand_id""",
)
def str_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no question of a pair, with the record's best other S1s: names and addresses cut, missing addresses said."""
    p, rec = views.pairs(spark, sf_dir), views.records(spark, sf_dir)
    said = lambda c, n: F.coalesce(F.nullif(text.clip(F.col(c), n), F.lit("")), F.lit("(no address)"))
    shown = rec.select(F.col("entity_id").alias("s1_id"), F.concat(F.lit("  - "), text.clip(F.col("business_name"), _RIVAL_NAME_CUT), F.lit(" | "), said("business_address", _RIVAL_ADDRESS_CUT)).alias("line"))
    lists = best_rivals(p, _RIVALS_SHOWN + 1).join(shown, "s1_id").groupBy("cand_id").agg(F.array_sort(F.collect_list(F.struct("place", "s1_id", "line"))).alias("best"))
    a = rec.select(F.col("entity_id").alias("s1_id"), F.concat(F.lit(_ASKED[0]), "country", F.lit(_ASKED[1]), text.clip(F.col("business_name"), _NAME_CUT), F.lit(" | "), said("business_address", _ADDRESS_CUT)).alias("a"))
    b = rec.select(F.col("entity_id").alias("cand_id"), F.concat(F.lit(_ASKED[2]), text.clip(F.col("business_name"), _NAME_CUT), F.lit(" | "), said("business_address", _ADDRESS_CUT)).alias("b"))
    asked = p.join(lists, "cand_id").join(a, "s1_id").join(b, "cand_id")
    others = F.slice(F.transform(F.filter("best", lambda x: x["s1_id"] != F.col("s1_id")), lambda x: x["line"]), 1, _RIVALS_SHOWN)
    lines = F.when(F.size(others) == 0, "  (none)").otherwise(F.array_join(others, "\n"))
    return asked.select("s1_id", "cand_id", F.concat_ws("\n", "a", "b", F.lit(_ASKED[3]), lines, F.lit(_ASKED[4]), F.lit(_ASKED[5])).alias("prompt"))


# similarities ------------------------------------------------------------------------------------------------------


def _string_measure(kind: str, field: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = sim.scored(views.framed_pairs(spark, sf_dir), f"l_{field}", f"r_{field}", [kind], "sim")
        return made.select("s1_id", "cand_id", F.round(f"sim_{kind}", 6).alias(f"sim_{kind}"))

    return build


for _kind, _field in (("ratio", "name_core"), ("tset", "name_norm"), ("tsort", "name_core"), ("partial", "addr_norm")):
    query(f"sim_{_kind}", f"with {PF}, {measures_sql(f'select l_{_field} as a, r_{_field} as b from pf', 'm', _kind == 'partial')} select s1_id, cand_id, round({_kind}, 6) as sim_{_kind} from pf join m on a = l_{_field} and b = r_{_field}")(_string_measure(_kind, _field))
query("sim_jw", f"with {PF} select s1_id, cand_id, round(case when l_name_core = '' or r_name_core = '' then 0 else jaro_winkler_similarity(l_name_core, r_name_core) end, 6) as sim_jw from pf")(_string_measure("jw", "name_core"))


def _pf(sql: str, name: str, make):
    query(name, f"with {PF} select s1_id, cand_id, {sql} from pf")(lambda spark, d: views.framed_pairs(spark, d).select("s1_id", "cand_id", *make()))


_LN, _RN = (f"list_distinct({tokens_sql(f'{s}_addr_nums')})" for s in "lr")
_l, _r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
_pf("(l_name_core = r_name_core)::int as name_exact", "sim_exact", lambda: ((_l("name_core") == _r("name_core")).cast("int").alias("name_exact"),))
_pf("length(l_name_core)::bigint as name_len_l, length(r_name_core)::bigint as name_len_r", "sim_len", lambda: (F.length(_l("name_core")).cast("bigint").alias("name_len_l"), F.length(_r("name_core")).cast("bigint").alias("name_len_r")))
_pf(f"round(len(list_intersect({_LN}, {_RN})) / nullif(len(list_distinct(list_concat({_LN}, {_RN}))), 0), 6) as num_jaccard", "sim_num_jaccard", lambda: (F.round(sim.jaccard(text.number_set(_l("addr_nums")), text.number_set(_r("addr_nums"))), 6).alias("num_jaccard"),))
_pf(f"len(list_intersect({_LN}, {_RN}))::bigint as num_common", "sim_num_common", lambda: (F.size(F.array_intersect(text.number_set(_l("addr_nums")), text.number_set(_r("addr_nums")))).cast("bigint").alias("num_common"),))
_pf("case when l_addr_nums <> '' and r_addr_nums <> '' then (string_split(l_addr_nums, ' ')[1] = string_split(r_addr_nums, ' ')[1])::int::double end as num_first", "sim_num_first", lambda: (sim.same_first(text.tokens(_l("addr_nums")), text.tokens(_r("addr_nums"))).alias("num_first"),))
_pf("case when l_postcode <> '' and r_postcode <> '' then (l_postcode = r_postcode)::int::double end as postcode_eq", "sim_post_eq", lambda: (sim.same_stated(_l("postcode"), _r("postcode")).alias("postcode_eq"),))
_pf("(r_addr_norm = '')::int as addr_empty", "sim_addr_empty", lambda: ((_r("addr_norm") == "").cast("int").alias("addr_empty"),))


def with_cosines(pairs: DataFrame, vectors: DataFrame, views_: list[str]) -> DataFrame:
    """``pairs`` with ``cos_<view>`` of every pair, null where a side has no vector. Vectors join late and only the product stays."""
    for view in views_:
        own = vectors.where(F.col("view_name") == view)
        left = own.select(F.col("entity_id").alias("s1_id"), F.col("vec").alias("_a"))
        right = own.select(F.col("entity_id").alias("cand_id"), F.col("vec").alias("_b"))
        pairs = pairs.join(left, "s1_id", "left").join(right, "cand_id", "left").withColumn(f"cos_{view}", sim.cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return pairs


_COS = f"with {P}, {VEC} select s1_id, cand_id, round({cosine_sql('a.vec', 'b.vec')}, 6) as cos_name, round({cosine_sql('c.vec', 'd.vec')}, 6) as cos_both from p left join vec a on a.entity_id = s1_id and a.view_name = 'name' left join vec b on b.entity_id = cand_id and b.view_name = 'name' left join vec c on c.entity_id = s1_id and c.view_name = 'both' left join vec d on d.entity_id = cand_id and d.view_name = 'both'"


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_cosines(views.pairs(spark, sf_dir), views.vectors(spark, sf_dir), ["name", "both"])
    return made.select("s1_id", "cand_id", F.round("cos_name", 6).alias("cos_name"), F.round("cos_both", 6).alias("cos_both"))


query("sim_cos", _COS)(_cosines)
query("feat_embed", _COS)(_cosines)


def norm2_features(pairs: DataFrame) -> DataFrame:
    """Five similarities of the second normalisation."""
    made = pairs.withColumns({"l_n2": text.core2(F.col("l_name_norm")), "r_n2": text.core2(F.col("r_name_norm")), "l_a2": text.address2(F.col("l_addr_norm")), "r_a2": text.address2(F.col("r_addr_norm"))})
    made = sim.scored(made, "l_n2", "r_n2", ["ratio", "tset", "tsort"], "name2")
    return sim.scored(made, "l_a2", "r_a2", ["tset", "tsort"], "addr2")


_NORM2 = ["name2_ratio", "name2_tset", "name2_tsort", "addr2_tset", "addr2_tsort"]
NORM2_SQL = (
    f"n2 as (select entity_id, {_core_sql('w', [*text.LEGAL2, *text.JOINING2])} as n2, array_to_string({_map_sql(tokens_sql('addr_norm'), text.ADDRESS_WORDS)}, ' ') as a2 from (select *, {_JOINED.replace('(n,', '(name_norm,')} as w from nf)), "
    "p2 as materialized (select s1_id, cand_id, l.n2 as ln, r.n2 as rn, l.a2 as la, r.a2 as ra from pf join n2 l on l.entity_id = s1_id join n2 r on r.entity_id = cand_id), "
    f"{measures_sql('select ln as a, rn as b from p2', 'mn')}, {measures_sql('select la as a, ra as b from p2', 'ma')}, "
    "norm2 as (select s1_id, cand_id, mn.ratio as name2_ratio, mn.tset as name2_tset, mn.tsort as name2_tsort, ma.tset as addr2_tset, ma.tsort as addr2_tsort from p2 join mn on mn.a = ln and mn.b = rn join ma on ma.a = la and ma.b = ra)"
)
for _name in ("sim_norm2", "feat_norm2"):
    query(_name, f"with {PF}, {NORM2_SQL} select s1_id, cand_id, {', '.join(f'round({c}, 6) as {c}' for c in _NORM2)} from norm2")(lambda spark, d: norm2_features(views.framed_pairs(spark, d)).select("s1_id", "cand_id", *(F.round(c, 6).alias(c) for c in _NORM2)))
