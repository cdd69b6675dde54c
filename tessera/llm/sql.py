"""SQL (DuckDB) that states those training-data problems that SQL can express on whole tables."""

from ..plans.sql import clean

_GROUPS = f"""
with recursive links as (
  select distinct run_id, {clean('left_id')} as a, {clean('right_id')} as b from fusion_proposals
  where decision in ('auto_merge', 'review-approved') and reversed_at is null),
pairs as (
  select run_id, a, b from links where a <> b union select run_id, b, a from links where a <> b),
reach(run_id, a, b) as (
  select run_id, a, a from pairs union select run_id, a, b from pairs
  union
  select r.run_id, r.a, p.b from reach r join pairs p on p.run_id = r.run_id and p.a = r.b),
members as (select run_id, min(b) as group_id, a as member_id from reach group by run_id, a)
"""

P4_FOUND = _GROUPS + "select run_id, group_id, member_id from members"

P4_SIZES = _GROUPS + "select run_id, group_id, count(*) as members from members group by run_id, group_id"

# RE2 has no look-ahead: white space is taken whole, and what GPT-2's pattern would have split off is added. A run of two
# or more that doesn't end in a blank gives one piece more; so does a contraction that such a run's blank is taken into.
_WS = r"[\t-\r\x{85}\p{Z}]"
_NOT_BLANK = r"[\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OTHER = r"[^\t-\r\x{85}\p{Z}\p{L}\p{N}]"
_PIECES = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?{_OTHER}+|{_WS}+"

_SIZED = rf"""
with sized as (
  select doc_id, len(regexp_extract_all(text, '{_PIECES}'))
       + len(regexp_extract_all(text, '{_WS}{_NOT_BLANK}[^\t-\r\x{{85}}\p{{Z}}]'))
       + len(regexp_extract_all(text, '{_WS} ''(?:s|t|re|ve|m|ll|d)(?:[^\p{{L}}]|$)')) as n
  from documents)
"""

P7_FOUND = _SIZED + "select budget_id, doc_id from sized, token_budgets where n > capacity_tokens"

P7_TOTALS = _SIZED + """
select budget_id, count(*) as documents, sum(greatest(1, ceil(coalesce(n, 0) / capacity_tokens)))::bigint as pieces, sum(coalesce(n, 0))::bigint as tokens, 0::bigint as overfull
from sized, token_budgets group by budget_id
"""

_LINES = r"list_filter(list_transform(regexp_split_to_array(t, '[\r\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '')"

P9_PUBLISHED = rf"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
counted as (
  select doc_id, len(regexp_extract_all(t, '[^ \t\r\n]+')) as words, length(regexp_replace(t, '[ \t\r\n]+', '', 'g')) as chars,
         length(t) - length(replace(t, '#', '')) + len(regexp_extract_all(t, '\.\.\.|…')) as symbols,
         len(regexp_extract_all(t, '[^ \t\r\n]*\p{{L}}[^ \t\r\n]*')) as lettered, {_LINES} as ls
  from texts)
select doc_id, words::bigint as words, round(chars::double / nullif(words, 0), 6) as mean_word_length, round(symbols::double / nullif(words, 0), 6) as symbol_ratio,
       round(lettered::double / nullif(words, 0), 6) as letter_word_share, len(ls)::int as lines,
       round(len(list_filter(ls, lambda x: contains('.!?…"''”’»)]', right(x, 1))))::double / nullif(len(ls), 0), 6) as closed_line_share,
       round(len(list_filter(ls, lambda x: contains('-*•‣◦▪●○·–—+', left(x, 1))))::double / nullif(len(ls), 0), 6) as bullet_line_share,
       round(len(list_filter(ls, lambda x: right(x, 1) = '…' or right(x, 3) = '...'))::double / nullif(len(ls), 0), 6) as ellipsis_line_share,
       round(len(list_filter(ls, lambda x: length(x) <= 30))::double / nullif(len(ls), 0), 6) as short_line_share
from counted
"""
