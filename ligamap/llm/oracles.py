"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: CRC-32 of the decimal digits of conv_id, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 1, 2, 3, 4, 5, 6, 7]::bigint[]),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)), 4294967295)"""

OP11 = f"""
with said as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, sha256(lpad(length(coalesce(role, ''))::varchar, 10, '0') || coalesce(role, '') || coalesce(text, '')) as d, turn
  from conversations where conv_id is not null
), original as (
  select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, d) as turns from said group by conv_id
), sized as (
  select conv_id, turns, {CRC} % 9 as h from original
), rebuilt as (
  select a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] as turns from sized a left join sized b on b.conv_id = a.conv_id - a.conv_id % 5
), prefix as (
  select conv_id, k as depth, turns[1:k] as path, k = len(turns) as ends from rebuilt, lateral unnest(range(len(turns) + 1)) as u(k)
), node as (
  select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, bool_and(ends) as leaf, any_value(case when depth > 0 then path[1:depth - 1] end) as parent,
    coalesce(any_value(octet_length(encode(path[depth].text))), 0) as n_bytes, sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from prefix group by path
), subtree as (
  select path[1:k] as path, sum(leaf::int) as n_leaves, sum((n_convs - 1) * n_bytes) as saved_tokens from node, lateral unnest(range(depth + 1)) as u(k) group by 1
), children as (
  select parent as path, count(*) as n_children from node where depth > 0 group by 1
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from node n join subtree s on n.path = s.path left join node p on n.parent = p.path left join children c on n.path = c.path
"""

CONTROL = r"([<\[])(\\*)(s>|/s>|\|im_start\|>|\|im_end\|>|INST\]|/INST\]|\|endoftext\|>)"

OP12 = rf"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written as (
  select *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{CONTROL}', '\1\2\\\3', 'g')) + length(regexp_replace(text, '{CONTROL}', '\1\2\\\3', 'g')) + 24 as chars from said
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, (sum(chars) + 7)::bigint as formatted_chars
from written group by conv_id
"""

OP13 = r"""
with drawn as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units, sha256('7:' || coalesce(doc_id::varchar, '')) as d from documents
), hashed as (
  select *, len(units) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from drawn
), placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from hashed
), cut as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from placed
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": OP11, "op12_chat": OP12, "op13_fill_middle": OP13}
