"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _rules_sql() -> str:
    value = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop / greatest(n_words, 1)",
        "mean_word_length": "word_chars / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "words_per_line": "n_words / greatest(n_lines, 1)",
        "neighbour_repeat_ratio": "n_twice / greatest(n_words, 1)",
    }
    tests = []
    for r in RULES:
        if r.low is not None:
            tests.append(f"{value[r.measure]} >= {r.low!r}::double")
        if r.high is not None:
            tests.append(f"{value[r.measure]} <= {r.high!r}::double")
    return " and ".join(tests)


OP10 = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{_WORD}') as ws,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as ls from d),
x as (select doc_id, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') as s
      from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
y as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from x) where n > 1),
z as (select doc_id, sum(least(8, i - p))::bigint as n_repeat_words
      from (select doc_id, i, coalesce(lag(i) over (partition by doc_id order by i), i - 8) as p from y) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words,
      coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0)::bigint as word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
      len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
      len(list_filter(ws, lambda v: lower(v) in ({', '.join(repr(s) for s in sorted(set(STOP_WORDS)))})))::bigint as n_stop,
      len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1]))::bigint as n_twice,
      coalesce(z.n_repeat_words, 0)::bigint as n_repeat_words
      from w left join z using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {_rules_sql()} as kept
from b
"""

OP4 = """
with p as (select page_id, coalesce(html, '') as h from pages),
x as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(encode(h)) as payload_digest from p),
y as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as m from x)
select page_id, payload_bytes, payload_digest, case when page_id < m then 'revisit' else 'response' end as record_type,
       case when page_id < m then m end as refers_to
from y
"""

OP8 = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
x as (select doc_id, i, list_aggregate(ws[i:i+12], 'string_agg', ' ') as s
      from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
f as (select s, min(doc_id) as a from x group by s),
g as (select distinct doc_id, i + o as i from x join f using (s), range(13) as r(o) where doc_id > a),
u as (select doc_id, unnest(ws) as v, unnest(range(1, len(ws) + 1)) as i from w),
k as (select u.doc_id, count(g.i)::bigint as n_removed, string_agg(case when g.i is null then v end, ' ' order by u.i) as kept
      from u left join g on u.doc_id = g.doc_id and u.i = g.i group by u.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)
"""
