"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from contestframe.llm import licenses, secrets

ORACLES: dict[str, str] = {}

ORACLES["op2_url_filter"] = r"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
urls as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(rule_host, rule_path, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select page_id, max(row(length(rule_host || rule_path), length(rule_host), rule_host || rule_path, action)) as best
  from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id)
select page_id, host, path, best[3] as rule, coalesce(best[4], 'allow') as verdict
from urls left join fits using (page_id)
"""

ORACLES["op9_chat_format"] = r"""
with chats as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
steps as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as earlier,
    lead(role) over (partition by conv_id order by turn, role, text) as later,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as size from chats)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + size + length('<|im_end|>') + 1)::bigint as formatted_chars,
  bool_and(case when earlier is null then role in ('system', 'user')
    else (earlier || '>' || role) in ('system>user', 'user>assistant', 'assistant>user') end
    and (later is not null or role = 'assistant')) as valid
from steps group by conv_id
"""

ORACLES["op4_quality_rules"] = r"""
with docs as (
  select row_number() over () as n, doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents),
words as (
  select n, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word,
    generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as place from docs),
windows as (
  select n, place, lead(word) over w as second, lead(word, 2) over w as third, word as first from words
  window w as (partition by n order by place)),
twice as (
  select n, place from (select *, count(*) over (partition by n, first, second, third) as found from windows where third is not null)
  where found > 1),
repeats as (
  select n, count(distinct place + k) as n_repeat_words from twice, (values (0), (1), (2)) as t(k) group by n),
own_lines as (select n, host, unnest(string_split(text, chr(10))) as line from docs),
line_counts as (
  select n, count(*) - count(distinct line) as n_dup_lines from own_lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by n),
normal as (
  select n, host, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as plain from own_lines),
hashed as (select n, host, line, md5(plain) as hash from normal where plain <> ''),
bodies as (select n, list_sort(list_distinct(list(plain))) as body from normal where plain <> '' group by n),
told as (select distinct host, hash, body from hashed join bodies using (n)),
common as (
  select t.host, hash from told t join (select host, count(*) as docs from docs group by host) d on t.host = d.host
  group by t.host, hash, docs having count(*) > 10 and count(*) > docs * 0.01),
removed as (
  select n, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as gone
  from hashed join common using (host, hash) group by n),
counts as (
  select doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(gone, 0) as gone
  from docs left join repeats using (n) left join line_counts using (n) left join removed using (n)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * (n_words - gone) >= 30 * n_words and 100 * n_symbols <= 30 * n_words as kept
from judged
"""

ORACLES["op11_source_divergence"] = r"""
with docs as (
  select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
groups as (select distinct lang, source from docs),
words as (select n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as total from words group by lang, term having count(distinct n) >= 10),
sizes as (select lang, count(*) as v, sum(total) as n from kept group by lang),
counts as (select w.lang, w.source, w.term, count(*) as c from words w join kept using (lang, term) group by all),
sums as (select lang, source, sum(c) as n from counts group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(c, 0) as c,
    1 + 1000000000::hugeint * (coalesce(c, 0) + 2) // (coalesce(s.n, 0) + 2 * z.v)::hugeint as p,
    1 + 1000000000::hugeint * (k.total + 2) // (z.n + 2 * z.v)::hugeint as q
  from groups g join kept k using (lang) join sizes z using (lang)
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
    left join sums s on s.lang = g.lang and s.source = g.source),
sums_of_pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join sums_of_pairs s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
  from shares where c > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 10
"""

ORACLES["op12_collocations"] = r"""
with docs as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select row_number() over () as n, lang, piece from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from docs)),
lists as (select n, lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
places as (select n, lang, unnest(words) as w, generate_subscripts(words, 1) as i from lists),
grams as (select lang, w, lead(w) over p as x, lead(w, 2) over p as y from places window p as (partition by n order by i)),
freq as (
  select lang, 1 as size, w as phrase, count(*) as f from grams group by all
  union all select lang, 2, w || ' ' || x, count(*) from grams where x is not null group by all
  union all select lang, 3, w || ' ' || x || ' ' || y, count(*) from grams where y is not null group by all),
totals as (select lang, sum(f)::bigint as n from freq where size = 1 group by lang),
candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as words from freq where size > 1 and f >= 10),
cuts as (
  select lang, phrase, a, k, array_to_string(words[1:k], ' ') as head, array_to_string(words[k + 1:], ' ') as tail
  from candidates, (values (1), (2)) as t(k) where k < size),
scored as (
  select c.lang, c.phrase, a, k, x.f as l, y.f as r, (1000000::hugeint * a * a // (x.f::hugeint * y.f))::bigint as score
  from cuts c join freq x on x.lang = c.lang and x.phrase = head join freq y on y.lang = c.lang and y.phrase = tail),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, phrase, max(a) as longer from (
    select lang, a, unnest([words[1] || ' ' || words[2], words[2] || ' ' || words[3]]) as phrase from candidates where size = 3) group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from worst left join inside using (lang, phrase) join totals using (lang)
where longer is null or 100 * longer < 50 * a
qualify rank <= 2000
"""

ORACLES["op13_jaccard_join"] = r"""
with recursive docs as (
  select row_number() over () as n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
places as (select n, unnest(words) as w, generate_subscripts(words, 1) as i from docs where len(words) >= 3),
grams as (select n, w, lead(w) over p as x, lead(w, 2) over p as y from places window p as (partition by n order by i)),
shingles as (
  select distinct n, w || ' ' || x || ' ' || y as shingle from grams where y is not null
  union all select n, array_to_string(words, ' ') from docs where len(words) in (1, 2)),
sizes as (select n, count(*) as size from shingles group by n),
common as (select a.n as a, b.n as b, count(*) as met from shingles a join shingles b on a.shingle = b.shingle and a.n < b.n group by all),
links as (
  select a, b from common join sizes x on x.n = a join sizes y on y.n = b where 100 * met >= 90 * (x.size + y.size - met)),
steps as (select a, b from links union all select b, a from links),
reach(n, m) as (select n, n from docs union select reach.n, steps.b from reach join steps on reach.m = steps.a)
select d.doc_id, coalesce(size, 0) as n_shingles, class_id, component_id
from docs d left join sizes using (n)
  join (select reach.n, min(doc_id) as component_id from reach join docs on docs.n = reach.m group by reach.n) using (n)
  join (select s.n, coalesce(min(t.doc_id), any_value(s.doc_id)) as class_id from
      (select docs.n, doc_id, list_sort(list(shingle) filter (shingle is not null)) as own from docs left join shingles using (n) group by all) s
      left join (select docs.n, doc_id, list_sort(list(shingle)) as own from docs join shingles using (n) group by all) t using (own) group by s.n) using (n)
"""


def _license_sql() -> str:
    rows = ", ".join(
        f"({n}, '{t.label}', {t.slack}, {t.cover}, {str(t in licenses.PHRASES).lower()}, '{t.words}')" for n, t in enumerate(licenses.TEMPLATES))
    return rf"""
with docs as (
  select row_number() over () as n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
templates(template, label, slack, cover, phrase, wording) as (values {rows}),
listed as (select template, unnest(string_split(wording, ' ')) as one, generate_subscripts(string_split(wording, ' '), 1) - 1 as place from templates),
sizes as (select template, count(*) as size from listed group by template),
wanted as (select *, lead(one) over (partition by template order by place) as two from listed),
words as (select n, unnest(words) as one, generate_subscripts(words, 1) - 1 as place from docs),
grams as (select *, lead(one) over (partition by n order by place) as two from words),
votes as (
  select n, template, g.place as here, w.place as there, g.place - w.place as diagonal
  from grams g join wanted w on g.one = w.one and g.two = w.two),
lines as (select distinct n, template, diagonal from votes),
gaps as (select *, diagonal - lag(diagonal) over (partition by n, template order by diagonal) as gap from lines),
runs as (
  select n, template, diagonal, sum(case when gap <= slack then 0 else 1 end) over (partition by n, template order by diagonal) as run
  from gaps join templates using (template)),
covered as (
  select n, template, run, count(distinct there + k) as hit, min(here) as start
  from votes join runs using (n, template, diagonal), (values (0), (1)) as t(k) group by n, template, run),
spans as (
  select n, label, phrase, start, hit / size as similarity
  from covered join templates using (template) join sizes using (template) where hit / size >= cover),
found as (
  select n, count(*) filter (phrase) as n_base, min(start) filter (phrase) as first_word, max(start) filter (phrase) as last_word,
    string_agg(distinct label, ',' order by label) filter (phrase) as base_labels, string_agg(distinct label, ',' order by label) as labels,
    max(similarity) as score from spans group by n)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from docs left join found using (n)
"""


def _secret_sql() -> str:
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = []
    for n, r in enumerate(secrets.RULES):
        pattern = assign if r.kind == "assign" else r.pattern
        kinds.append(f"""select n, {n} as rule, '{r.kind}' as kind, {r.least} as least, string_split_regex(text, '{pattern}') as parts,
      regexp_extract_all(text, '{pattern}') as hits, regexp_extract_all(text, '{pattern}', {r.group}) as vals from docs""")
    return f"""
with docs as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(kinds)}),
each as (
  select n, rule, kind, least, generate_subscripts(hits, 1) as i, unnest(hits) as hit, unnest(vals) as val, parts, hits
  from found where len(hits) > 0),
spans as (
  select n, rule, kind, list_sum(list_transform(parts[1:i], lambda x: length(x)))::bigint
    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::bigint as start, length(hit) as size
  from each where length(val) >= least),
sums as (
  select n, count(*) filter (rule = 0) as n_assign, count(*) filter (rule = 1) as n_access, count(*) filter (rule = 2) as n_hex,
    string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, rule) filter (rule < 3) as base,
    string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, rule) as spans from spans group by n)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join sums using (n)
"""


ORACLES["op1_license_scan"] = _license_sql()
ORACLES["op7_secret_scan"] = _secret_sql()
