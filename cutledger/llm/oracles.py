"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in tests/llm."""

from __future__ import annotations

_REACH = """, und as (select a, b from links union select b, a from links), reach as (select a, b from und union select r.a, u.b from reach r join und u on u.a = r.b)"""

ORACLES: dict[str, str] = {
    "op6_embedding_near_dedup": f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id < y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.9){_REACH},
 n as (select a, count(*) as n from und group by 1), c as (select a, min(b) as m from reach group by 1)
 select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) as component_id, least(e.vec_id, coalesce(c.m, e.vec_id)) = e.vec_id as kept from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id""",
    "op8_minhash_near_dedup": f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as ws from documents),
 sh as (select doc_id, list_distinct(case when len(ws) >= 4 then [array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)] when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w),
 ex as (select doc_id, len(s) as n, unnest(s) as g from sh), pr as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as c from ex x join ex y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
 links as (select a, b from pr where 100*c >= 80*(na + nb - c)){_REACH}, c as (select a, min(b) as m from reach group by 1)
 select sh.doc_id, cast(len(s) as bigint) as n_shingles, least(sh.doc_id, coalesce(c.m, sh.doc_id)) as component_id, least(sh.doc_id, coalesce(c.m, sh.doc_id)) = sh.doc_id as kept from sh left join c on c.a = sh.doc_id""",
    "op11_block_search": """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 d as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
 r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d) select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
    "op12_hard_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.e, c.e) as bigint) as score from v a join v c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id and len(a.e) = len(c.e)),
 p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same),
 n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
 from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score where p.k <= 5)
 select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3""",
}
