"""SQL (DuckDB) of the corpus queries that SQL can express."""

OP11 = r"""
with d as (
  select doc_id, coalesce('0' || source, '1') as g, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    md5(coalesce(doc_id::varchar, '-') || ':' || coalesce(md5(text), '-')) as turn
  from documents
), placed as (
  select *, sum(size) over (partition by g order by turn rows unbounded preceding) - size as earlier,
    sum(size) over (partition by g) as source_size
  from d
), s as (
  select g, sum(size)::bigint as source_size, (row_number() over (order by g) - 1) % 3 as kind,
    list_extract([5.0, 2.0, 1.0]::double[], ((row_number() over (order by g) - 1) % 3 + 1)::int) as w
  from d group by g
), f as (
  select *, sum(source_size) over () as words,
    coalesce(sum(source_size) over (order by source_size / w, g rows between unbounded preceding and 1 preceding), 0) as before_,
    sum(w) over (order by source_size / w desc, g desc rows unbounded preceding) as rest
  from s
), c as (select *, source_size * 4 * rest <= w * (3 * words - 4 * before_) as is_full from f
), t as (
  select g, kind, w, case when is_full then source_size * 2.0 else
    w * (words * 3 - sum(case when is_full then source_size else 0 end) over () * 4)
      / (sum(case when is_full then 0 else w end) over () * 2) end::double as target
  from c
), wanted as (select placed.*, kind, w, target, floor(target + 0.5)::bigint as quota from placed join t using (g)
), p as (
  select *, greatest(0, least(size, quota - earlier)) as first_pass,
    greatest(0, least(size, quota - source_size - earlier)) as second_pass,
    earlier::double / nullif(quota, 0) * w as demand
  from wanted
), seg(kind, start, weight, slope, done, upto) as (values
  (0, 0.0::double, 8.0::double, -6.0::double, 0.0::double, 5.0::double), (1, 0.0, 2.0, 0.0, 0.0, 2.0),
  (2, 0.0, 0.0, 1.0, 0.0, 0.125), (2, 0.5, 0.5, 5.0, 0.125, 1.0)
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target, (first_pass + second_pass)::bigint as taken,
  ((first_pass > 0)::int + (second_pass > 0)::int) as passes,
  case when first_pass > 0 then case when demand <= done then start
    else start + 2.0 * (demand - done) / (weight + sqrt(greatest(weight * weight + 2.0 * slope * (demand - done), 0.0))) end end as position
from p left join seg on p.kind = seg.kind and first_pass > 0 and demand >= done and demand < upto
"""

OP12 = r"""
with w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), m as (
  select doc_id, part, [
    len(words) < 50,
    100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails
  from w
), l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), c as (
  select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from m left join l using (doc_id) group by part, fails
), i(k) as (values (1), (2), (3), (4), (5)
), o as (
  select [a.k, b.k, c.k, d.k, e.k] as ks from i a, i b, i c, i d, i e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), r as (
  select part, array_to_string(list_transform(ks, lambda x: substr('ABCDE', x, 1)), '') as filter_order, i.k as step, ks[i.k] as own,
    fails[ks[i.k]] as fails_here, coalesce(list_bool_or(list_transform(ks[1:i.k - 1], lambda x: fails[x])), false) as gone,
    len(list_filter(fails, lambda x: x)) = 1 and fails[ks[i.k]] as alone, n, good, toxic
  from c, o, i
), a as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (where not gone and not fails_here), 0)::bigint as kept,
    coalesce(sum(n) filter (where not gone and fails_here), 0)::bigint as removed,
    coalesce(sum(n) filter (where gone and fails_here), 0)::bigint as redundant,
    coalesce(sum(n) filter (where alone), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where not gone and fails_here), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where not gone and fails_here), 0)::bigint as toxic_lost
  from r group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley
from a
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || ({column}::varchar), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


#: Check sum of the decimal id: eight list items a byte, the byte and seven times nothing, one
#: step of the check sum each.
_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''),
    lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0])),
    lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)))"""

OP13 = f"""
with recursive d as (
  select doc_id, coalesce('1' || source, '0') as g, {_leaf("text")} as leaf,
    case when {_CRC} & 1 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as found
  from documents
), l as (
  select *, row_number() over (order by doc_id, leaf) as id,
    row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as slot, count(*) over (partition by g) as n
  from d
), nodes(level, g, slot, n, h) as (
  select 0, g, slot, n, leaf from l
  union all
  select level + 1, g, slot // 3, (n + 2) // 3, sha256(string_agg(h, '' order by slot)) from nodes where n > 1
  group by level, g, slot // 3, (n + 2) // 3
), subroots as (
  select g, h as subroot, row_number() over (order by g) - 1 as slot, count(*) over () as n from nodes where n = 1
), upper_nodes(level, slot, n, h) as (
  select 0, slot, n, subroot from subroots
  union all
  select level + 1, slot // 3, (n + 2) // 3, sha256(string_agg(h, '' order by slot)) from upper_nodes where n > 1
  group by level, slot // 3, (n + 2) // 3
), steps as (
  select l.id, level, string_agg(h, '' order by m.slot) filter (where m.slot < l.slot // (3 ** level)::bigint) as left_,
    string_agg(h, '' order by m.slot) filter (where m.slot > l.slot // (3 ** level)::bigint) as right_
  from l join nodes m on l.g = m.g and m.n > 1 and m.slot // 3 = l.slot // (3 ** (level + 1))::bigint
  group by l.id, level
  union all
  select l.id, 100 + level, string_agg(h, '' order by m.slot) filter (where m.slot < s.slot // (3 ** level)::bigint),
    string_agg(h, '' order by m.slot) filter (where m.slot > s.slot // (3 ** level)::bigint)
  from l join subroots s using (g) join upper_nodes m on m.n > 1 and m.slot // 3 = s.slot // (3 ** (level + 1))::bigint
  group by l.id, level
), paths as (
  select id, string_agg(coalesce(left_, '') || coalesce(right_, ''), '' order by level) as siblings,
    list(coalesce(left_, '') || '|' || coalesce(right_, '') order by level) as path
  from steps group by id
), folded as (
  select l.*, sha256(coalesce(siblings, '')) as proof_sha256,
    list_reduce([found] || coalesce(path, []), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) as folded_root
  from l left join paths using (id)
)
select doc_id, leaf, subroot, h as root, proof_sha256, folded_root, folded_root = h as verified
from folded join subroots using (g) join upper_nodes u on u.n = 1
"""

ORACLES = {"op11_mixing": OP11, "op12_filter_audit": OP12, "op13_merkle": OP13}
