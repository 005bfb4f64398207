"""DuckDB SQL of the views that the oracles read."""

from __future__ import annotations

VIEWS = {
    "iv": "select l_orderkey as asset_id, cast((l_partkey*37 + l_linenumber*5000) % 60000 as bigint) as s, cast((l_partkey*37 + l_linenumber*5000) % 60000 + cast(l_quantity*200 as bigint) as bigint) as e, l_returnflag as flag from lineitem",
    "iv_assets": "select distinct l_orderkey as asset_id, cast(70000 as bigint) as duration_ms from lineitem",
    "spans": "select asset_id, pos, speaker, text, e - len as s, e from (select *, cast(sum(len) over (partition by asset_id order by pos) as bigint) as e from (select conv_id as asset_id, turn as pos, role as speaker, coalesce(text,'') as text, cast(length(coalesce(text,''))*60 as bigint) as len from conversations))",
    "words": """select asset_id, pos, i, text, e0 - step as s, e0 - step + len as e from (
        select *, cast(sum(step) over (partition by asset_id order by pos, i) as bigint) as e0 from (
        select *, cast(length(text)*60 as bigint) as len, cast(length(text)*60 + case when right(text,1) in ('.','?','!',',') then 400 else 40 end as bigint) as step from (
        select asset_id, pos, unnest(string_split(text,' ')) as text, generate_subscripts(string_split(text,' '),1)-1 as i from spans) where text <> ''))""",
    "word_assets": "select asset_id, max(e) + 1000 as duration_ms from words group by 1",
    "observations": """select user_id as asset_id, event_id as obs_id, event_type as facet, (us - first_us)//1000 as s, (us - first_us)//1000 + cast(floor(value) as bigint)*1000 as e, props as value
        from (select *, epoch_us(ts) as us, min(epoch_us(ts)) over (partition by user_id) as first_us from events)""",
    "cut_points": "select asset_id, obs_id as point_id, s as t, case facet when 'click' then 'gap_start' when 'view' then 'gap_end' when 'error' then 'shot_change' when 'signup' then 'word_start' when 'purchase' then 'word_end' end as reason from observations where facet in ('click','view','error','signup','purchase')",
    "point_assets": "select asset_id, max(e) + 1000 as duration_ms from observations group by 1",
    "segments": """select d.doc_id as segment_id, source as asset_id, cast(d.doc_id*7919 % 600000 as bigint) as s, cast(d.doc_id*7919 % 600000 + 2000 + n_chars % 8000 as bigint) as e, text as summary, lang as mood,
        (['hook','context','reaction','performance','payoff','archive','emotion'])[cast(d.doc_id % 7 + 1 as int)] as role, cast(coalesce(quality,0) as bigint) as quality, coalesce(toxic,0) = 0 as usable, d.doc_id % 3 = 0 as has_card
        from documents d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) l on d.doc_id = l.doc_id""",
    "plan_items": "select l_orderkey as plan_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos, l_partkey as segment_id, l_suppkey as asset_id, cast(l_quantity*100 as bigint) as target, cast(150*(1 + l_partkey % 40) as bigint) as cap, l_returnflag as role from lineitem",
    "queries": "select doc_id as query_id, array_to_string(string_split(text,' ')[2:5],' ') as query_text from documents where doc_id % 50 = 0",
}
#: Views that a view reads.
NEEDS = {"words": ["spans"], "word_assets": ["spans", "words"], "cut_points": ["observations"], "point_assets": ["observations"]}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named views (blank-separated, in any order) as common table expressions; ``body`` may go on with its own (start it with a comma)."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    head = ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)
    return f"with {'recursive ' if recursive else ''}{head}\n{body}"
