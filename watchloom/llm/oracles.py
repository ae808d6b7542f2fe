"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from watchloom.llm import quality

WORD = r"[^\x20\x09-\x0D]+"

# Least id that each id of ``nodes`` reaches over ``links`` (a, b), given in both directions.
COMPONENTS = """
reached(id, root) as (
  select id, id from nodes
  union
  select l.b, r.root from reached r join links l on l.a = r.id),
parts as (select id, min(root) as component_id from reached group by id)"""

SUBSTRINGS = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
windows as (
  select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as g
  from (select *, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
firsts as (select g, min(doc_id) as f from windows group by g),
gone as (
  select distinct r, i + j as k from windows join firsts using (g), (select unnest(range(13)) as j) where f < doc_id),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as k from d),
kept as (
  select r, string_agg(word, ' ' order by k) as t from words anti join gone using (r, k) group by r),
counts as (select r, count(*) as n from gone group by r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r) left join counts using (r)"""

NEAR_COPIES = rf"""
with recursive d as (
  select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
shingles as (
  select distinct id, array_to_string(w[i:i + 4], ' ') as g
  from (select *, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
  union all
  select id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
sizes as (select id, count(*) as n from shingles group by id),
common as (
  select x.id as a, y.id as b, count(*) as n from shingles x join shingles y on x.g = y.g and x.id <> y.id group by all),
links as (
  select c.a, c.b from common c join sizes s on s.id = c.a join sizes t on t.id = c.b
  where 100 * c.n >= 75 * (s.n + t.n - c.n)),
nodes as (select id from d),
{COMPONENTS}
select p.id as doc_id, coalesce(s.n, 0) as n_shingles, p.component_id, p.id = p.component_id as kept
from parts p left join sizes s using (id)"""

DIVERGENCE = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
t as (select r, lang, source, unnest(w) as term from d),
vocabulary as (select lang, term from t group by lang, term having count(distinct r) >= 10),
v as (select lang, count(*) as v from vocabulary group by lang),
c as (select lang, source, term, count(*) as n from t join vocabulary using (lang, term) group by all),
g as (
  select lang, source, coalesce(sum(n), 0) + 2 * coalesce(any_value(v), 0) as below
  from (select distinct lang, source from d) left join c using (lang, source) left join v using (lang) group by lang, source),
p as (
  select lang, source, term, coalesce(n, 0) as n,
    1 + (cast(1000000000 as hugeint) * (coalesce(n, 0) + 2)) // cast(below as hugeint) as p
  from g join vocabulary using (lang) left join c using (lang, source, term)),
q as (
  select lang, term, 1 + (cast(1000000000 as hugeint) * (sum(n) + 2))
    // cast(sum(sum(n)) over (partition by lang) + 2 * count(*) over (partition by lang) as hugeint) as q
  from c group by lang, term),
pairs as (
  select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  union all
  select x.lang, x.source, y.source, 0 from g x join g y on x.lang = y.lang and x.source <> y.source
  where x.lang not in (select lang from v)),
terms as (
  select lang, source, term as item, (p - q) * (p - q) // (p + q) as value
  from p join q using (lang, term) where n > 0 and p > q),
both_parts as (
  select lang, source, 'pair' as part, item, cast(value as bigint) as value from pairs
  union all
  select lang, source, 'term', item, cast(value as bigint) from terms),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from both_parts)
select lang, source, part, item, value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 10"""

VECTORS = f"""
with recursive v as (
  select vec_id as id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select x.id as a, y.id as b from v x join v y
  on x.label = y.label and x.id <> y.id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.98),
nodes as (select vec_id as id from embeddings),
counts as (select a as id, count(*) as n from links group by a),
{COMPONENTS}
select p.id as vec_id, coalesce(c.n, 0) as n_links, p.component_id, p.id = p.component_id as kept
from parts p left join counts c using (id)"""

_PHRASES = "|".join(quality.PHRASES).replace("'", "''")

QUALITY = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
runs as (
  select r, i, array_to_string(w[i:i + 2], ' ') as g
  from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
twice as (select r, g from runs group by r, g having count(*) >= 2),
covered as (
  select distinct r, i + j as k from runs join twice using (r, g), (select unnest(range(3)) as j)),
repeats as (select r, count(*) as n_repeat_words from covered group by r),
lines as (
  select r, line, len(regexp_extract_all(line, '{WORD}')) as n,
    row_number() over (partition by r, line order by k) as nth
  from (select r, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from d)
  where regexp_matches(line, '{WORD}')),
judged as (
  select r, n, nth > 1 as again,
    len(regexp_extract_all(line, '[^\p{{L}}\p{{N}}\p{{M}}\p{{P}}\s]|[#*$%&|<>@]')) > len(regexp_extract_all(line, '[\p{{L}}\p{{N}}]'))
    or (len(list_filter(regexp_split_to_array(line, '\s*[|>»•·]+\s*'), lambda x: x <> '')) >= 3
      and len(list_filter(regexp_split_to_array(line, '\s*[|>»•·]+\s*'),
        lambda x: len(regexp_extract_all(x, '{WORD}')) > 3)) = 0)
    or regexp_matches(lower(line), '{_PHRASES}') as bad
  from lines),
lost as (
  select r, count(*) filter (again) as n_dup_lines, sum(n) filter (again or bad) as n_lost_words from judged group by r),
counted as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lost_words, 0) as n_lost_words
  from d left join repeats using (r) left join lost using (r))
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
  cast(n_lost_words as bigint) as n_lost_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_lost_words <= 0.5 * n_words as kept
from counted"""

ORACLES = {
    "op2_substrings": SUBSTRINGS,
    "op4_setsketch": NEAR_COPIES,
    "op7_vector_dup": VECTORS,
    "op9_quality": QUALITY,
    "op12_divergence": DIVERGENCE,
}
