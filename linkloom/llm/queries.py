"""Queries of the problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from linkloom.llm import addresses, cutoff, encoding, lookalike, matching, names, neighbours, packing, stuffing, topn
from linkloom.llm.scores import COUNTING_SQL

QUERIES = {
    "p1_found": cutoff.p1_found,
    "p2_found": names.p2_found,
    "p3_found": topn.p3_found,
    "p4_found": addresses.p4_found,
    "p5_found": lookalike.p5_found,
    "p6_found": neighbours.p6_found,
    "p7_found": matching.p7_found,
    "p8_ids": encoding.p8_ids,
    "p8_round_trip": encoding.p8_round_trip,
    "p9_containers": packing.p9_containers,
    "p10_found": stuffing.p10_found,
}

ORACLE = {
    "p1_found": f"""
      with pairs as ({COUNTING_SQL}),
      best as (select cand_id, max(prob) as prob from pairs group by cand_id),
      recs as (select entity_id, max(source_tag) as source_tag, max(country) as country from source_records
               where entity_id is not null and country is not null and country <> '' group by entity_id),
      t as (select source_tag, country, max(keep_permille) as keep_permille from keep_targets group by all),
      r as (select t.source_tag, t.country, t.keep_permille, cast(round(best.prob * 1000000) as bigint) as micro
            from best join recs on recs.entity_id = best.cand_id
            join t on t.source_tag = recs.source_tag and t.country = recs.country),
      c as (select source_tag, country, keep_permille, micro,
              count(*) over (partition by source_tag, country order by micro desc range between unbounded preceding and current row) as kept,
              count(*) over (partition by source_tag, country) as total from r)
      select source_tag, country, max(micro) as cutoff_micro, cast(min(kept) as bigint) as n_kept
      from c where kept * 1000 >= keep_permille * total group by source_tag, country
    """,
    "p8_round_trip": "select doc_id, md5(coalesce(text, '')) as digest from documents",
    "p6_found": """
      with v as (select view_name, entity_id, max(vec) as vec from record_vectors
                 where entity_id is not null and view_name is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0 group by all),
      u as (select view_name, entity_id, vec::double[64] as vec from v),
      c as (select a.view_name, a.entity_id as x, b.entity_id as y, round(array_cosine_similarity(a.vec, b.vec), 12) as cosine from u a join u b on a.view_name = b.view_name and a.entity_id <> b.entity_id),
      k as (select * from c qualify row_number() over (partition by view_name, x order by cosine desc, y) <= 5)
      select distinct view_name, least(x, y) as id_a, greatest(x, y) as id_b from k
    """,
    "p3_found": f"""
      with pairs as ({COUNTING_SQL})
      select s1_id, cand_id from pairs
      qualify row_number() over (partition by s1_id order by prob desc, cand_id) <= 10
    """,
}
