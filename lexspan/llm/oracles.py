"""DuckDB SQL for the queries that SQL can express."""

WORD = "[^\\x20\\x09-\\x0D]+"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {}

ORACLES["op7_line_dedup"] = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents
), keyed as (
  select *, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines
), owners as (
  select k, min(doc_id) owner from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), flagged as (
  select keyed.*, owner is not null and owner <> doc_id dropped from keyed left join owners using (k)
)
select doc_id, count(*)::bigint n_lines, count(*) filter (where dropped)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) kept_sha256
from flagged group by doc_id
"""

ORACLES["op8_exact_dedup"] = """
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') t from documents)
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
       doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256
from n
"""

ORACLES["op5_mix"] = f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size,
         md5('mix:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))) key from documents
), s as (
  select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 weight from d group by source
), o as (
  select *, (select sum(size) from d) total,
         coalesce(sum(3 * source_size) over (order by 3.0 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) held,
         sum(weight) over (order by 3.0 * source_size / weight, source nulls last rows between current row and unbounded following) free from s
), l as (
  select coalesce(min_by((total - held)::double / free::double, 3.0 * source_size / weight), 0) level from o where (total - held)::double / free::double * weight <= 3 * source_size
), t as (
  select source, source_size, least((3 * source_size)::double, level * weight) target from s, l
), r as (
  select d.*, source_size, target, floor(target)::bigint // greatest(source_size, 1) epochs,
         floor(target)::bigint - floor(target)::bigint // greatest(source_size, 1) * source_size rest,
         sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and current row) - size before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint taken from r
"""

# SHA-1 is not in DuckDB's functions by that name in every version; the payloads themselves decide what is equal
ORACLES["op10_warc"] = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n from pages),
q as (select *, max(page_id) over (partition by h) keep from p)
select page_id, n::bigint payload_bytes, sha1(h) payload_digest,
       case when n >= 1000 and page_id <> keep then 'revisit' else 'response' end record_type,
       case when n >= 1000 and page_id <> keep then keep end refers_to
from q
"""

ORACLES["op11_divergence"] = """
with d as (
  select row_number() over () row, coalesce(lang, '') lang, coalesce(source, '') source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') ts from documents
), t as (
  select row, lang, source, unnest(ts) term from d
), k as (
  select lang, term from t group by lang, term having count(distinct row) >= 10
), v as (
  select lang, count(*)::hugeint v from k group by lang
), c as (
  select lang, source, term, count(*)::hugeint n from t join k using (lang, term) group by lang, source, term
), g as (
  select lang, source, coalesce((select sum(n) from c where c.lang = x.lang and c.source = x.source), 0)::hugeint total
  from (select distinct lang, source from d) x
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.v) p
  from g join k on g.lang = k.lang join v on g.lang = v.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), l as (
  select c.lang, c.term, 1 + 1000000000::hugeint * (sum(c.n)::hugeint + 2) // (any_value(s.total) + 2 * any_value(v.v)) q
  from c join v using (lang) join (select lang, sum(total)::hugeint total from g group by lang) s using (lang) group by c.lang, c.term
), pairs as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) f
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), every as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all
  select p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // (p + q))::bigint from p join l on p.lang = l.lang and p.term = l.term where p.n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from every
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
