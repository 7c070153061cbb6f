"""DuckDB SQL that builds pages' trees, texts and words from the HTML, for the queries over pages to be compared with.

A page's tags are taken one after the other with a stack of open elements: an end tag closes the innermost open element of its
name and all within, or nothing. It knows the markup of the given tables (no attribute holds ">", entities are &amp;
&copy; &middot; &lt; &gt; &quot;) and is no parser for others.
"""

from weftline.functions.text import BLOCK_TAGS, SPACE_CLASS
from weftline.operators.markup import VOID

_VOID = ", ".join(f"'{t}'" for t in sorted(VOID))
_BREAKS = ", ".join(f"'{t}'" for t in [*BLOCK_TAGS, "br"])
_SPACE = SPACE_CLASS

#: The text of a page by patterns alone.
STRIP = """replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
      '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')"""

#: nodes: page_id, node_id, parent_id, depth, tag, sib_idx, subtree_end. segs: page_id, pos, raw, node_id (owner, -1 at the top).
TREE = f"""
with recursive cut as (
  select page_id, unnest(t) as tok, generate_subscripts(t, 1) as pos from (select page_id,
    regexp_extract_all(html, '(?is)<!--.*?-->|<![^>]*>|<script[^>]*>.*?</script>|<noscript[^>]*>.*?</noscript>|<meta[^>]*>|<style[^>]*>.*?</style>|</?[a-z][^>]*>|[^<]+') as t from pages)),
tags as (select page_id, pos, tok, tok like '</%' as closes, lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) as tag,
    row_number() over (partition by page_id order by pos) as k from cut
  where regexp_matches(tok, '^</?[a-zA-Z]') and not regexp_matches(tok, '(?i)^<(script|noscript|meta)')),
walk as (
  select page_id, 0::bigint as k, 0::bigint as pos, []::bigint[] as ids, []::varchar[] as names, 0::bigint as n, null::bigint as node_id, null::bigint as parent_id, null::bigint as depth, null::varchar as tag from pages
  union all
  select w.page_id, t.k, t.pos,
    case when t.closes then case when list_contains(w.names, t.tag) then w.ids[:len(w.names) - list_position(list_reverse(w.names), t.tag)] else w.ids end
      when t.tag in ({_VOID}) or t.tag = 'style' then w.ids else list_append(w.ids, w.n) end,
    case when t.closes then case when list_contains(w.names, t.tag) then w.names[:len(w.names) - list_position(list_reverse(w.names), t.tag)] else w.names end
      when t.tag in ({_VOID}) or t.tag = 'style' then w.names else list_append(w.names, t.tag) end,
    w.n + (not t.closes)::int, case when not t.closes then w.n end, case when not t.closes then w.ids[-1] end, case when not t.closes then len(w.ids) end, case when not t.closes then t.tag end
  from walk w join tags t on t.page_id = w.page_id and t.k = w.k + 1),
nodes as (
  select page_id, node_id, parent_id, depth, tag, row_number() over (partition by page_id, parent_id order by node_id) - 1 as sib_idx,
    coalesce((select min(x.node_id) from walk x where x.page_id = w.page_id and x.node_id > w.node_id and x.depth <= w.depth) - 1, (select max(x.node_id) from walk x where x.page_id = w.page_id)) as subtree_end
  from walk w where node_id is not null),
texts as (select page_id, pos, replace(replace(replace(replace(replace(replace(tok, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as raw from cut where tok not like '<%'),
segs as (select t.page_id, t.pos, t.raw, coalesce(w.ids[-1], -1) as node_id from texts t join walk w on w.page_id = t.page_id
  where w.k = (select max(x.k) from walk x where x.page_id = t.page_id and x.pos < t.pos))"""

#: words: page_id, pos, i, word, node_id, and whether the word goes on with the one before (joined).
WORDS = f"""{TREE},
placed as (select *, lag(raw) over w as before, lag(pos) over w as pos_before from segs window w as (partition by page_id order by pos)),
broken as (select *, pos_before is null or regexp_matches(before, '{_SPACE}$') or exists (select 1 from walk b where b.page_id = p.page_id and b.pos > p.pos_before and b.pos < p.pos and b.tag in ({_BREAKS})) as is_broken from placed p),
cutw as (select *, list_filter(string_split_regex(raw, '{_SPACE}+'), lambda x: x <> '') as w from broken),
words as (select page_id, pos, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, node_id, (not is_broken and not regexp_matches(raw, '^{_SPACE}')) as open from cutw)"""

NODES = f"{TREE} select page_id, node_id::int as node_id, parent_id::int as parent_id, depth::int as depth, tag, least(sib_idx, 31)::bigint + 1 as slot, subtree_end::int as subtree_end from nodes"
OWN_TEXT = f"""{WORDS} select page_id, node_id::int as node_id, string_agg(word, ' ' order by pos, i) as text, count(*)::int as n_words from words where node_id >= 0 group by all"""
TOKENS = f"""{WORDS}, numbered as (select *, sum(case when open and i = 1 then 0 else 1 end) over (partition by page_id order by pos, i) - 1 as p from words)
select page_id, p::int as pos, string_agg(word, '' order by pos, i) as token, list(node_id order by pos, i)::int[] as owners from numbered group by page_id, p"""
TWO_HOPS = f"""{TREE}, degree as (select n.page_id, n.node_id, (select count(*) from nodes c where c.page_id = n.page_id and c.parent_id = n.node_id) + (n.parent_id is not null)::int as d from nodes n),
pairs as (select page_id, unnest([0, 1, 2]) as distance, unnest([1, d, 0]) as own, d from degree),
near as (select n.page_id, count(*) as n_pairs from (select a.page_id, a.node_id, b.node_id from nodes a join nodes b on a.page_id = b.page_id and a.node_id <> b.node_id
  where a.parent_id = b.parent_id or a.parent_id in (select c.node_id from nodes c where c.page_id = b.page_id and c.parent_id = b.node_id) or b.parent_id in (select c.node_id from nodes c where c.page_id = a.page_id and c.parent_id = a.node_id)) n group by all)
select page_id, distance, sum(own)::bigint as n_pairs from pairs where distance < 2 group by all having sum(own) > 0 union all select page_id, 2, n_pairs from near"""
