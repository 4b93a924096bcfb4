"""SQL that states the result of a query another way, over the same tables."""

from __future__ import annotations

from frameloom.llm.quality_rules import RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"

_RULES = " and ".join(
    f"{r.feature} {op} {v}" for r in RULES for op, v in ((">=", r.least), ("<=", r.most)) if v is not None
)

QUALITY = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(text, '{WORD}') as w from d),
g as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
      from (select k, w, unnest(range(1, len(w) - 1)) as i from w)),
twice as (select k, i, count(*) over (partition by k, g) as n from g),
cover as (select k, count(distinct i + s) as n_repeat_words from twice, (values (0), (1), (2)) t(s) where n > 1 group by k),
lines as (select k, line, regexp_matches(line, '{WORD}') as full_line from (select k, unnest(string_split(text, chr(10))) as line from d)),
dup as (select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where full_line group by k),
stop as (select k, count(*) as n_stop from (select k, unnest(w) as x from w) where lower(x) in ({", ".join(f"'{x}'" for x in STOP_WORDS)}) group by k),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
             coalesce(n_lines, 0) as n_lines, coalesce(n_stop, 0) as n_stop
      from w left join cover using (k) left join dup using (k) left join stop using (k)),
r as (select *, word_chars / greatest(n_words, 1) as mean_word_chars, n_symbols / greatest(n_words, 1) as symbols_per_word,
             n_stop / greatest(n_words, 1) as stop_word_share, n_dup_lines / greatest(n_lines, 1) as duplicate_line_share,
             n_repeat_words / greatest(n_words, 1) as repeat_word_share,
             n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, mean_word_chars, symbols_per_word, stop_word_share,
       duplicate_line_share, repeat_word_share, base_failed, not base_failed and {_RULES} as kept
from r
"""

MIX = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint as h from documents),
per as (select source, sum(size)::bigint as source_size,
               [3, 1, 2][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight from d group by source),
l as (select *, sum(source_size) over () as total,
             coalesce(sum(source_size) over (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as capped,
             sum(weight) over (order by source_size / weight, source is null, source rows between current row and unbounded following) as open from per),
v as (select *, (1.5::double * total::double - 2.0::double * capped::double) / open::double as level from l),
c as (select *, max(case when 2 * source_size >= level * weight then level end) over () as chosen from v),
t as (select source, source_size, least(2.0::double * source_size, coalesce(chosen, 'infinity'::double) * weight) as target from c),
p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as rounds from t),
u as (select *, target - rounds * source_size as room from p),
s as (select source, h, sum(size) as same from d group by source, h),
q as (select s.source, s.h, same, coalesce(sum(same) over (partition by s.source order by h rows between unbounded preceding and 1 preceding), 0) as below from s),
cut as (select q.source, q.h, below + same <= room or (below <= room and room > below and 2 * (room - below) >= same) as extra
        from q join u on q.source is not distinct from u.source)
select doc_id, size, source_size, target, (size * (rounds + case when extra then 1 else 0 end))::bigint as taken
from d join u on d.source is not distinct from u.source
join cut on cut.source is not distinct from d.source and cut.h = d.h
"""

PHRASES = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws
    from documents),
grams as (
    select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase
    from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from pieces, (values (1), (2), (3)) as t(m))),
f as (select lang, m, phrase, count(*) as f from grams group by all),
n as (select lang, sum(f) as n from f where m = 1 group by lang),
cuts as (
    select lang, m, phrase, f as a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as lp, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') as rp
    from f, (values (1), (2)) as t(k) where m > k and f >= 10),
scored as (
    select c.*, x.f as l, y.f as r, 1000000::hugeint * a * a // (x.f::hugeint * y.f) as score
    from cuts c join f x on x.lang = c.lang and x.phrase = c.lp join f y on y.lang = c.lang and y.phrase = c.rp),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
outer_f as (
    select lang, sub, max(f) as o from (
        select lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as sub
        from f where m = 3 and f >= 10) group by all),
kept as (select b.* from best b left join outer_f o on o.lang = b.lang and o.sub = b.phrase where o.o is null or 100 * o.o < 50 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, rank, phrase, a, l, r, cast(n.n as bigint) as n, cast(score as bigint) as score from ranked r join n on n.lang = r.lang where rank <= 2000
"""
