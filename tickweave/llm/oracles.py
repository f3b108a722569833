"""DuckDB SQL that the registered queries must equal."""

_OP7 = r"""
with pieces as (select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select distinct cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark where text is not null and item_id is not null),
patterns as (select distinct item_id, p, len(p) as n from (
    select item_id, unnest(case when len(w) < 10 then [w] else list_transform(range(1, len(w) - 8), lambda i: w[i:i+9]) end) as p from items where len(w) > 0)),
starts as (select r, n, w, unnest(range(1, len(w) - n + 2)) as i from pieces, (select distinct n from patterns) where len(w) >= n),
found as (select s.r, s.i, s.n, p.item_id from starts s join patterns p on s.w[s.i:s.i+s.n-1] = p.p),
hits as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from found) group by r),
named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from pieces left join hits using (r) left join named using (r)
"""

_OP8 = r"""
with pieces as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select r, doc_id, i, md5(array_to_string(w[i:i+12], ' ')) as k from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from pieces where len(w) >= 13 and doc_id is not null)),
firsts as (select k, min(doc_id) as first from starts group by k),
gone as (select distinct r, unnest(range(i, i + 13)) as i from starts join firsts using (k) where first < doc_id),
kept as (select r, doc_id, len(w) as n_words, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from pieces where len(w) > 0)
select p.doc_id, len(p.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from pieces p left join (select r, count(*) filter (gone.i is not null) as n_removed, string_agg(word, ' ' order by kept.i) filter (gone.i is null) as kept
    from kept left join gone using (r, i) group by r) using (r)
"""

_OP9 = r"""
with recursive pieces as (select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select r, array_to_string(s, ' ') as s from (select r, unnest(case when len(w) < 5 then [w] else list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) end) as s from pieces where len(w) > 0) group by all),
sizes as (select r, count(*) as n from shingles group by r),
shared as (select x.r as a, y.r as b, count(*) as k from shingles x join shingles y on x.s = y.s and x.r <> y.r group by all),
links as (select a, b from shared join sizes p on p.r = a join sizes q on q.r = b where 100 * k >= 80 * (p.n + q.n - k)),
reach(a, b) as (select r, r from pieces union select reach.a, links.b from reach join links on links.a = reach.b)
select p.doc_id, coalesce(n, 0)::bigint as n_shingles, q.component_id
from pieces p left join sizes using (r) join (select reach.a as r, min(doc_id) as component_id from reach join pieces on pieces.r = reach.b group by 1) q using (r)
"""

_OP10 = r"""
with pieces as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as t from documents),
starts as (select r, i, md5(substr(t, 2 * i + 1, 400)) as k from (select r, t, unnest(range(0, length(t) // 2 - 199)) as i from pieces where length(t) >= 400)),
twice as (select k from starts group by k having count(*) > 1),
marks as (select r, i, max(i) over (partition by r order by i rows between unbounded preceding and 1 preceding) as before from starts where k in (select k from twice)),
numbered as (select r, i, sum(case when before is null or before + 200 < i then 1 else 0 end) over (partition by r order by i) as span from marks),
spans as (select r, span, min(i) as a, max(i) + 200 as b from numbered group by all),
cuts as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) as kept_from from spans),
kept as (select r, count(*) as n_spans, sum(b - a)::bigint as n_removed, max(b) as last, string_agg(substr(t, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) as head
    from cuts join pieces using (r) group by r)
select doc_id, (length(t) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    sha256(unhex(coalesce(head || substr(t, 2 * last + 1), t))) as kept_sha256
from pieces left join kept using (r)
"""

_OP2 = r"""
with vectors as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from vectors q join vectors c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scores)
select query_id, n::int as rank, vec_id, score from ranked where n <= 5
"""

_OP1 = r"""
with parsed as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
rules(rule, said, h, p) as (values ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
    ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
named as (select *, (select max_by(rule, length(rule)) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as rule from parsed),
ruled as (select n.*, said from named n left join rules using (rule)),
seeds as (select distinct said as kind, host from ruled where said is not null and host <> ''),
links as (select distinct host as src, translate(d, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from (select host,
    unnest(regexp_extract_all(html, '<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*["'']?(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#"''\s>]+)', 1)) as d from parsed where host <> '')),
edges as (select 'allow' as kind, src as host, dst as goal from links where src <> dst union all select 'block', dst, src from links where src <> dst),
parts as (select *, 100 * count(*) over (partition by kind, host) as parts from edges),
base as (select kind, host, 1000000000000 * 15 // (100 * count(*) over (partition by kind)) as score from seeds),
scores0 as (select * from base),
ROUNDS
net as (select host, sum(case when kind = 'block' then score else -score end) as net from scores20 group by host)
select page_id, host, path, rule, coalesce(said, case when net > 0 then 'block' else 'allow' end) as verdict from ruled left join net using (host)
""".replace("ROUNDS", "".join(f"""scores{i + 1} as (select kind, host, sum(score)::bigint as score from (select * from base union all
    select kind, goal, score * 85 // parts from parts join scores{i} using (kind, host)) group by all),
""" for i in range(20)))

_OP12 = r"""
with pieces as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
tokens as (select lang, source, r, unnest(w) as term from pieces),
vocabulary as (select lang, term from tokens group by all having count(distinct r) >= 30),
known as (select distinct lang, source from pieces),
counts as (select v.lang, k.source, v.term, count(t.term) as n from vocabulary v join known k using (lang) left join tokens t using (lang, source, term) group by all),
shares as (select lang, source, term, n, (1 + 1000000000::hugeint * (n + 5) // (sum(n) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)))::bigint as p from counts),
whole as (select lang, term, sum(n) as n from counts group by all),
base as (select lang, term, (1 + 1000000000::hugeint * (n + 5) // (sum(n) over (partition by lang) + 5 * count(*) over (partition by lang)))::bigint as q from whole),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value from known a join known b on a.lang = b.lang and a.source <> b.source
    left join shares x on x.lang = a.lang and x.source = a.source left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
over_used as (select s.lang, s.source, s.term as item, (p - q)::bigint as value from shares s join base using (lang, term) where s.n > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as k from pairs
    union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from over_used)
select lang, source, part, item, value, k::int as rank from ranked where part = 'pair' or k <= 50
"""

_OP13 = r"""
with pieces as (select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
items as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where item_id is not null),
whole as (select count(*)::bigint as n, sum(len(w))::bigint as l from pieces where len(w) > 0),
sizes as (select r, doc_id, 50 + (50 * len(w)::bigint * n) // l as m from pieces, whole where len(w) > 0),
tokens as (select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from pieces) where term in (select term from items) group by all),
weights as (select term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::bigint as weight from tokens, whole group by term, n),
scores as (select item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from items join tokens using (term) join weights using (term) join sizes using (r) group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as k from scores join sizes using (r) where score > 0)
select item_id, k::int as rank, doc_id, score from ranked where k <= 50
"""

SQL = {"op13_lexical_search": _OP13, "op12_source_divergence": _OP12, "op1_url_filters": _OP1, "op2_exact_topk": _OP2, "op7_benchmark_decontamination": _OP7, "op8_substring_dedup": _OP8, "op9_ngram_jaccard_join": _OP9, "op10_suffix_array_dedup": _OP10}
