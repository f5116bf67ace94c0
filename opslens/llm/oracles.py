"""The same results as SQL for DuckDB, where SQL can express them."""

MIX = r"""
with sized as (
  select *, coalesce('0' || source, '1') as sk, md5('mix/' || coalesce(doc_id::varchar, '')) as k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
strata as (select *, lpad(length(bin(size))::varchar, 2, '0') || substr(bin(size), 1, 5) as cls, substr(k, 1, 1) as bucket from sized),
sources as (select sk, sum(size)::bigint as source_size from sized group by sk),
weighed as (
  select sk, source_size, 3 * source_size as most, [5, 2, 1][((row_number() over (order by sk) - 1) % 3 + 1)::int] as weight from sources),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(most) over before, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from weighed
  window before as (order by most / weight, sk rows between unbounded preceding and 1 preceding)),
targets as (
  select sk, source_size,
         case when most <= level * weight then most::double
              else max(case when most > level * weight then level end) over () * weight end as target
  from levels),
rates as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as rate,
         ('0x' || substr(md5('mix/' || sk), 1, 8))::bigint::double / 4294967296.0::double as u
  from targets),
placed as (
  select doc_id, source, text, size, source_size, target, rate, u,
         row_number() over (partition by sk order by cls, bucket, size, k) as i
  from strata join rates using (sk)),
mixed as (
  select *, least(floor(i * rate + u) - floor((i - 1) * rate + u), ceil(rate))::bigint as copies from placed)
select {columns} from mixed
"""

#: crc32 bit by bit: a table of 256 remainders, then one step for each byte.
CRC32 = """
with remainders as (
  select list(r order by b) as t from (
    select b, list_reduce(list_prepend(b::bigint, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as r
    from range(256) s(b))),
"""

SHARDS = CRC32 + r"""
hexed as (select doc_id, source, hex(encode(coalesce(text, ''))) as h from documents),
sized as (
  select doc_id, coalesce('0' || source, '1') as sk, md5('shards/' || coalesce(doc_id::varchar, '')) as k,
         (length(h) // 2 + 1)::bigint as size,
         xor(list_reduce(
           list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)),
           lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::bigint])), 4294967295::bigint)::bigint as text_crc32
  from hexed, remainders),
ranked as (
  select *, (row_number() over (partition by sk order by k) - 0.5::double) / count(*) over (partition by sk) as part from sized),
placed as (select *, row_number() over (order by part, sk, k) - 1 as place, count(*) over () as n from ranked)
select doc_id, size, text_crc32, 'rows' as law, (place * 16 // n)::int as shard,
       (place - ((place * 16 // n) * n + 15) // 16)::bigint as slot, null::int as grown_shard
from placed
"""


CHAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, regexp_replace(regexp_replace(text, '<(\\*)(\||/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') as body
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|turn|>' || role || chr(10) || body || '<|end|>' || chr(10)))::bigint as formatted_chars
from escaped group by conv_id
"""

WARC = r"""
with sized as (
  select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1], lambda p:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::bigint, 5))::bigint // p) % 32 + 1)::bigint, 1)), '')), '')
         as payload_digest,
       case when page_id = max(page_id) over same then 'response' else 'revisit' end as record_type,
       case when page_id <> max(page_id) over same then max(page_id) over same end as refers_to
from sized window same as (partition by body)
"""


def clusters_sql(k: int = 8, dim: int = 64, rounds: int = 10, scale: int = 1024, prefix: str = "3:") -> str:
    """All rounds one after the other, by distances to every centroid."""
    near = """(select vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, c := c)) as b
               from kept, c{r} group by vec_id, v)"""
    steps = [f"""kept as (
      select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
      where len(embedding) = {dim} and len(list_filter(embedding, lambda x: isfinite(x::double))) = {dim}),
    c0 as (select (row_number() over (order by sha256('{prefix}' || vec_id)) - 1)::int as c, v as cv from kept
           order by sha256('{prefix}' || vec_id) limit {k})"""]
    for r in range(rounds):
        steps.append(f"""a{r} as materialized {near.format(r=r)},
    m{r} as (select c, list(floor(s / n)::bigint order by i) as cv from (
        select b.c as c, i, sum(v[i])::double as s, count(*) as n from a{r}, range(1, {dim + 1}) t(i) group by all) group by c),
    c{r + 1} as materialized (select c, coalesce(m{r}.cv, c{r}.cv) as cv from c{r} left join m{r} using (c))""")
    return f"""with {", ".join(steps)}, last as {near.format(r=rounds)}
    select vec_id, b.c as cluster, b.d as distance, (sum(b.d) over (partition by b.c))::bigint as cluster_inertia,
           (sum(b.d) over ())::bigint as inertia, sha256(array_to_string(cv, ',')) as centroid_sha256
    from last join c{rounds} on b.c = c{rounds}.c"""


def oracle_sql() -> dict[str, str]:
    """SQL by the query's name."""
    return {
        "op5_mix_sources": MIX.format(columns="doc_id, size, source_size, target, copies * size as taken, copies"),
        "op7_shards": SHARDS,
        "op9_chat": CHAT,
        "op11_warc": WARC,
        "op13_centroid_clusters": clusters_sql(),
    }
