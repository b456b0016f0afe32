"""DuckDB SQL of sharding, collocations and vector codes."""

from __future__ import annotations

#: The reflected polynomial of CRC-32, from which its table for half bytes follows.
CRC32 = 0xEDB88320


def _half_bytes() -> list[int]:
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (CRC32 if x & 1 else 0)
        table.append(x)
    return table


def shard_sql(shards: int = 8) -> str:
    """op11: checksums of the texts' bytes, global prefix sums, equal cuts."""
    half = lambda c: f"xor({c} >> 4, {_half_bytes()}[({c} & 15) + 1])"
    step = f"list_transform([xor(c, b)], lambda x: list_transform([{half('x')}], lambda y: {half('y')})[1])[1]"
    return rf"""
        with texts as (
            select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) as bytes from documents
        ), summed as (
            select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: {step}), 4294967295::bigint) as text_crc32 from texts
        ), placed as (
            select *, coalesce(sum(size) over (w rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over () as everything, row_number() over w as nth
            from summed window w as (order by doc_id nulls first, text_crc32, size)
        ), cut as (
            select *, cast(least({shards - 1}, (2 * before + size) * {shards} // (2 * everything)) as integer) as shard from placed
        )
        select doc_id, size, text_crc32, 'bytes' as law, shard, cast(row_number() over (partition by shard order by nth) - 1 as bigint) as slot, cast(null as integer) as grown_shard from cut"""


def collocation_sql(least: int = 10, share: int = 50, top: int = 2000) -> str:
    """op12: windows of one to three words, their counts, both cuts, the longest phrases around."""
    return rf"""
        with texts as (
            select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
        ), pieces as (
            select lang, piece, row_number() over () as p from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from texts)
        ), placed as (
            select lang, p, unnest(words) as w1, generate_subscripts(words, 1) as i from (select lang, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as words from pieces)
        ), windows as (
            select *, lead(w1, 1) over w as w2, lead(w1, 2) over w as w3 from placed window w as (partition by p order by i)
        ), phrases as (
            select lang, 1 as size, w1 as phrase, w1, null as w2, null as w3 from windows
            union all select lang, 2, w1 || ' ' || w2, w1, w2, null from windows where w2 is not null
            union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3 from windows where w3 is not null
        ), f as materialized (
            select lang, size, phrase, w1, w2, w3, count(*) as f from phrases group by all having count(*) >= {least}
        ), n as (
            select lang, count(*) as n from placed group by lang
        ), cuts as (
            select c.lang, c.size, c.phrase, c.w1, c.w2, c.w3, c.f as a, 1 as k, l.f as l, r.f as r
            from f c join f l on l.lang = c.lang and l.size = 1 and l.phrase = c.w1 join f r on r.lang = c.lang and r.size = c.size - 1 and r.phrase = concat_ws(' ', c.w2, c.w3) where c.size > 1
            union all
            select c.lang, c.size, c.phrase, c.w1, c.w2, c.w3, c.f, 2, l.f, r.f
            from f c join f l on l.lang = c.lang and l.size = 2 and l.phrase = c.w1 || ' ' || c.w2 join f r on r.lang = c.lang and r.size = 1 and r.phrase = c.w3 where c.size = 3
        ), scored as (
            select *, cast(cast(1000000 as hugeint) * a * a // (cast(l as hugeint) * r) as bigint) as score from cuts
        ), best as (
            select * from (select *, row_number() over (partition by lang, phrase, size order by score, k) as nth from scored) where nth = 1
        ), around as (
            select lang, phrase, max(a) as longer
            from (select lang, w1 || ' ' || w2 as phrase, a from best where size = 3 union all select lang, w2 || ' ' || w3, a from best where size = 3) group by all
        ), kept as (
            select best.* from best left join around on around.lang = best.lang and around.phrase = best.phrase and best.size = 2 where longer is null or 100 * longer < {share} * a
        ), ranked as (
            select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
        )
        select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= {top}"""


def vector_code_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """op13: plain rounds of assignment and floored means, part by part."""
    gap = "cast(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) as bigint)"
    steps, book = [], "book0"
    for n in range(rounds + 1):
        steps.append(f"""near{n} as materialized (
            select r, part, arg_min(e, (d, e)) as e, min(d) as d from (select v.r, v.part, b.e, {gap} as d from cut v join {book} b on v.part = b.part) group by r, part
        )""")
        if n < rounds:
            steps.append(f"""book{n + 1} as materialized (
            select part, e, list(x order by i) as x from (
                select b.part, b.e, i, coalesce(cast(floor(m.s / m.c) as bigint), b.x[i]) as x
                from (select *, unnest(range(1, len(x) + 1)) as i from {book}) b
                left join (select part, e, i, sum(x) as s, count(*) as c from (select part, e, unnest(v.x) as x, generate_subscripts(v.x, 1) as i from near{n} join cut v using (r, part)) group by all) m using (part, e, i)
            ) group by part, e
        )""")
            book = f"book{n + 1}"
    return f"""
        with kept as (
            select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), cut as materialized (
            select r, vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] as x from kept, range({parts}) t(part)
        ), book0 as materialized (
            select part, r - 1 as e, x from cut where r <= {entries}
        ), {', '.join(steps)}, coded as (
            select r, string_agg(printf('%02x', cast(e as integer)), '' order by part) as code, cast(sum(d) as bigint) as error from near{rounds} group by r
        ), digest as (
            select sha256(string_agg(cast(x as varchar), ',' order by part, e, i)) as codebooks_sha256 from (select part, e, unnest(x) as x, generate_subscripts(x, 1) as i from {book})
        )
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join coded using (r), digest"""
