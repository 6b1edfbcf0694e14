"""DuckDB SQL for the operators that SQL can express (chains, SimHash, licence expressions and the pipeline cannot)."""

from __future__ import annotations

from dataprobe.llm import chat, mixing, quality, urls

_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# ---- 1: every rule as SQL on the same measurements -----------------------------------------------------------------

_BITS = " + ".join(f"case when {fails} then {quality.BIT[name]} else 0 end" for name, fails in quality.RULES)
QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from win) where n > 1),
covered as (select doc_id, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(8)) as k) group by doc_id),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
          from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines,
         len(list_filter(w, lambda x: length(x) > 1 and x like '%!'))::bigint as n_shouts
  from d left join covered using (doc_id) left join lines using (doc_id)),
b as (select *, ({_BITS})::bigint as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {quality.BASE}) <> 0 as base_failed,
       (failed_bits & {quality.POLICIES[quality.CURRENT]}) = 0 as kept, failed_bits from b"""

# ---- 2: every 50-byte string as a slice of bytes ---------------------------------------------------------------------

SUFFIX = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n_bytes from documents),
g as (select doc_id, i, x[i + 1:i + 50] as s from (select doc_id, encode(coalesce(text, '')) as x, unnest(range(0, strlen(coalesce(text, '')) - 49)) as i from documents)),
least_doc as (select s, min(doc_id) as m from g group by s),
hit as (select doc_id, i from g join least_doc using (s) where m < doc_id),
edge as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from hit),
island as (select *, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as k from edge),
span as (select doc_id, k, min(i) as a, max(i) + 50 as b from island group by doc_id, k),
cut as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from span),
left_over as (select c.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as head, max(b) as last
              from cut c join d using (doc_id) group by c.doc_id)
select doc_id, n_bytes::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join left_over using (doc_id)"""

# ---- 3 --------------------------------------------------------------------------------------------------------------

CONTAMINATION = f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents),
b as (select item_id, w, least(len(w), 10) as k from (select item_id, {_WORDS.format('text')} as w from benchmark) where len(w) > 0),
item as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from (select *, unnest(range(1, len(w) - k + 2)) as i from b)),
win as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from b))),
hit as (select doc_id, i, k, item_id from win join item using (k, s)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from hit)) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, list_sort(list_distinct(list(item_id::varchar))) as ids from hit group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

# ---- 4 --------------------------------------------------------------------------------------------------------------

CHAT = f"""
with t as (select conv_id, turn, role as speaker, coalesce(text, '') as text from conversations),
who as (select distinct conv_id, speaker as perspective from t where speaker is not null and speaker <> '{chat.SYSTEM}'),
r as (select t.*, perspective, case when speaker = perspective then 'assistant' when speaker = '{chat.SYSTEM}' then 'system' else 'user' end as role from t join who on who.conv_id is not distinct from t.conv_id),
n as (select *, case when role = 'user' then coalesce(speaker, '{chat.UNKNOWN}') end as name from r),
h as (select *, '{chat.START}' || role || case when name is null then '' else ' name=' || name end || chr(10) as head from n)
select conv_id, perspective, turn, speaker, role, name, head || text || '<|im_end|>' || chr(10) as segment,
       (case when role = 'assistant' then length(head) else 0 end)::bigint as mask_start,
       (case when role = 'assistant' then length(head || text || '<|im_end|>' || chr(10)) else 0 end)::bigint as mask_end from h"""

# ---- 5: rules, then every round of the propagation as a table ------------------------------------------------------


def _url_sql(rounds: int = urls.ROUNDS) -> str:
    d = urls.DAMPING
    fits = ", ".join(
        f"case when (host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}') then {{'size': {len(r.text)}, 'rule': '{r.text}', 'verdict': '{r.verdict}'}} end" for r in urls.RULES
    )
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"r0 as materialized (select host, s, d, {1 - d} * s as trust, {1 - d} * d as distrust from start)"]
    for k in range(rounds):
        steps.append(f"""r{k + 1} as materialized (
  select r.host, s, d, round({1 - d} * s + {d} * coalesce(t, 0), {urls.DIGITS}) as trust, round({1 - d} * d + {d} * coalesce(u, 0), {urls.DIGITS}) as distrust
  from r{k} r left join (select e.dst as host, sum(x.trust * e.links / o.n) as t from edges e join r{k} x on x.host = e.src join outs o on o.src = e.src group by 1) f using (host)
  left join (select e.src as host, sum(x.distrust * e.links / o.n) as u from edges e join r{k} x on x.host = e.dst join ins o on o.dst = e.dst group by 1) g using (host))""")
    return rf"""
with cut as (select page_id, html, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parsed as (select page_id, html, {lower("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select *, list_max(list_filter([{fits}], lambda x: x is not null)) as best from parsed),
links as (select host as src, {lower("unnest(regexp_extract_all(html, '(?i)[[:space:]](?:href|src)[[:space:]]*=[[:space:]]*[\"'']?[[:space:]]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"''[:space:]>]+)', 1))")} as dst from parsed),
edges as materialized (select src, dst, count(*)::double as links from links where src <> '' and src <> dst group by 1, 2),
outs as (select src, sum(links) as n from edges group by 1), ins as (select dst, sum(links) as n from edges group by 1),
counted as (select host, count(*) filter (where best.verdict = 'allow') as good, count(*) filter (where best.verdict = 'block') as bad from ruled where host <> '' group by 1),
seeds as (select host, good::double / greatest((select sum(good) from counted), 1) as s, bad::double / greatest((select sum(bad) from counted), 1) as d from counted),
start as materialized (select host, coalesce(s, 0) as s, coalesce(d, 0) as d from (select host from seeds union select src from edges union select dst from edges) left join seeds using (host)),
{', '.join(steps)}
select page_id, host, path, best.rule as rule, coalesce(best.verdict, case when coalesce(distrust, 0) > {urls.THRESHOLD} * coalesce(trust, 0) then 'block' else 'allow' end) as verdict
from ruled left join r{rounds} using (host)"""


# ---- 7: base32 of a digest, five bits at a time --------------------------------------------------------------------

WARC = """
with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as last from pages)
select page_id, strlen(html)::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(html), (5 * i) // 4 + 1, 2))::int >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '') as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id < last then last end as refers_to from p"""

# ---- 9: the schedule slot by slot, in one segment, as these tables need ----------------------------------------------------------------------------------

MIXING = f"""
with recursive n as (select source, count(*) as n from documents group by source),
q as (select source, round(pow(n::double, 0.5) * {mixing.UNIT})::hugeint as q, ((n + {mixing.BLOCK_DOCS - 1}) // {mixing.BLOCK_DOCS})::hugeint as blocks from n),
s as materialized (select list(source order by coalesce(source, ''), source is null) as names, list(q order by coalesce(source, ''), source is null) as q,
                          list(blocks order by coalesce(source, ''), source is null) as blocks, sum(q)::hugeint as p from q),
ends as materialized (select max((blocks * (select p from s) + q - 1) // q) as last from q),
run as (
  select -1::bigint as slot, 0::bigint as pick, list_transform(q, lambda x: 0::hugeint) as nxt from s
  union all
  select slot, pick, list_transform(nxt, lambda x, i: case when i = pick then x + 1 else x end) from (
    select r.slot + 1 as slot, r.nxt, (list_min(list_filter(list_transform(range(1, len(s.q) + 1),
             lambda i: case when r.nxt[i] < s.blocks[i] and r.nxt[i] * s.p // s.q[i] <= r.slot + 1 then (((r.nxt[i] + 1) * s.p + s.q[i] - 1) // s.q[i]) * 100000 + i end), lambda x: x is not null)) % 100000)::bigint as pick
    from run r, s, ends where r.slot + 1 < ends.last)),
clock as (select s.names[pick] as source, nxt[pick] - 1 as turn, slot, ((nxt[pick] - 1) * s.p // s.q[pick])::bigint as release, ((nxt[pick] * s.p + s.q[pick] - 1) // s.q[pick])::bigint as deadline
          from run, s where slot >= 0 and pick is not null),
ranked as (select doc_id, source, row_number() over (partition by source order by cast('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', doc_id)), 1, 8) as bigint), doc_id) - 1 as k from documents)
select doc_id, r.source as source, k // {mixing.BLOCK_DOCS} as mix_block, slot as mix_slot, release as mix_release, deadline as mix_deadline, (k % {mixing.BLOCK_DOCS})::int as mix_place
from ranked r join clock c on c.source is not distinct from r.source and c.turn = k // {mixing.BLOCK_DOCS}"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": QUALITY, "op2_suffix_dedup": SUFFIX, "op3_decontaminate": CONTAMINATION, "op4_chat_rotation": CHAT,
    "op5_url_filter": _url_sql(), "op7_warc": WARC, "op9_mixing": MIXING,
}

# ---- 11 and 12: crc32 by its table, byte by byte -----------------------------------------------------------------------

_BIT = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
_CRC_TABLE = "crc_table as (select list(v order by k) as tab from (select k, list_reduce(list_prepend(k, [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]), lambda c, i: " + _BIT + ") as v from (select unnest(range(256)) as k)))"
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + unicode(x) // 64, 128 + unicode(x) % 64]::bigint[] end))"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, " + _BYTES + "), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295)"

VARIANTS = rf"""
with recursive {_CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
each as (select doc_id, run, count(*) as k from runs group by all),
hashed as (select run, k, {_CRC.format("concat(doc_id, ':', run)")} as h from each, crc_table),
slipped as (select case when h % 97 = 0 then concat(substr(run, 1, (h % length(run))::bigint), substr(run, (h % length(run))::bigint + 2)) else run end as word, k from hashed),
w as (select word, sum(k)::bigint as n from slipped where length(word) >= 5 group by word having sum(k) >= 3),
cut as (select word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
near as (select a.word, b.word as other, b.n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
         union select c.word, w.word, w.n from cut c join w on w.word = c.rest
         union select w.word, c.word, c.n from cut c join w on w.word = c.rest),
best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as top from near group by word),
named as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when top >= 2 * w.n then other end as form, case when top >= 2 * w.n then top end as form_n from w left join best using (word)),
way as (select word, word as at from named union all select way.word, named.form from way join named on named.word = way.at where named.form is not null)
select named.word, named.form, way.at as root, named.n, named.n_near, named.form_n::bigint as form_n
from named join way on way.word = named.word join named as last on last.word = way.at where last.form is null"""



def _then(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 's': {state}.s || '{letter}'}}"


_NONE = "{'c': 1000000000::bigint, 's': '~'}"
_STEP = f"""
step as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 's': ''}} as e, {_NONE} as y, {_NONE} as u, {_NONE} as a from convs
  union all
  select conv_id, i + 1, {_then("e", "2", "D")},
         list_min([{_then("y", "2", "D")}, case when live and r = 's' then {_then("e", "late", "K")} else {_NONE} end]),
         list_min([{_then("u", "2", "D")}, case when not live then {_NONE} when r = 'u' then {_then("bu", "late", "K")} else {_then("bu", "late + 1", "R")} end]),
         list_min([{_then("a", "2", "D")}, case when not live then {_NONE} when r = 'a' then {_then("pu", "late", "K")} else {_then("pu", "late + 1", "R")} end])
  from (select s.conv_id, s.i, e, y, u, a, r, fault not in ('blank', 'duplicate') as live, case when fault = 'truncated' then 5 else 0 end as late,
               list_min([u, {_then("e", "5", "I")}, {_then("y", "5", "I")}, {_then("a", "5", "I")}]) as pu,
               list_min([e, y, a, {_then("u", "5", "I")}, {_then("e", "10", "II")}, {_then("y", "10", "II")}]) as bu
        from step s join rows_ x on x.key = s.conv_id and x.i = s.i))"""

REPAIR = rf"""
with recursive {_CRC_TABLE},
drawn as (select conv_id, coalesce(conv_id::varchar, ' ') as key, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 {_CRC.format("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 as d from conversations, crc_table),
hurt as (select key, turn, case when d = 4 then 'user' else role end as role, case when d = 1 then '' when d = 2 then translate(text, '.!?', '') else text end as text,
                unnest(case when d = 3 then [0, 1] else [0] end) as copy from drawn where d > 0),
placed as (select *, row_number() over (partition by key order by turn nulls first, role, text, copy) - 1 as i from hurt),
marked as (select *, substr(role, 1, 1) as r, row_number() over (partition by key, role, text order by i) as nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as tail from placed),
rows_ as (select *, case when tail = '' then 'blank' when nth > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault,
                 lag(r) over (partition by key order by i) as before from marked),
convs as (select distinct key as conv_id from drawn), {_STEP},
sized as (select conv_id, coalesce(max(x.i) + 1, 0) as n from convs left join rows_ x on x.key = conv_id group by conv_id),
ended as (select conv_id, n, list_min([e, {_then("e", "10", "II")}, {_then("y", "10", "II")}, a, {_then("u", "5", "I")}]) as b from step join sized using (conv_id) where step.i = n),
edits as (select conv_id, k, substr(b.s, k::bigint, 1) as l, b.s as s from (select *, unnest(range(1, length(b.s) + 1)) as k from ended)),
numbered as (select conv_id, k, l, count(*) filter (l <> 'I') over (partition by conv_id order by k) - 1 as i,
                    count(*) filter (l in ('I', 'R', 'K')) over (partition by conv_id order by k) as o from edits where l <> 'D' or true),
shown as (select m.conv_id, k, l, o, x.role, x.text, case when first_role = 's' then 1 else 0 end as shift
          from numbered m left join rows_ x on l <> 'I' and x.key = m.conv_id and x.i = m.i
          left join (select conv_id, first(r order by k) as first_role from (select m.conv_id, k, r from numbered m join rows_ x on l = 'K' and x.key = m.conv_id and x.i = m.i where o = 1) group by conv_id) using (conv_id)
          where l <> 'D'),
told as (select conv_id, string_agg(case when l = 'K' then role else case when (o - shift) % 2 = 1 then 'user' else 'assistant' end end || ':' || case when l = 'I' then '' else text end, chr(10) order by k) as said from shown group by conv_id),
tally as (select key, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                 count(*) filter (fault = 'truncated') as truncated, count(*) filter (before || r not in ('su', 'ua', 'au')) as illegal from rows_ group by key)
select case when conv_id = ' ' then null else conv_id::bigint end as conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, b.c::bigint as cost, b.s as audit, sha256(coalesce(said, '')) as repaired_sha256
from ended left join tally on key = conv_id left join told using (conv_id)"""

ORACLES |= {"op11_spelling_variants": VARIANTS, "op12_conversation_repair": REPAIR}
