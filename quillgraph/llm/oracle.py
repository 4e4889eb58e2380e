"""DuckDB SQL for the registered queries that SQL can state.

The others (stored media, a trained network, tokenizers, page differencing, bin packing) are tested against brute force,
round trips or held-out rows.
"""

from __future__ import annotations

from .license_scan import BASE, TEMPLATES
from .suffix_dedup import LENGTH

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
    with v as (
        select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
        where embedding is not null and len(embedding) > 0 and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as (
        select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
        from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
    ), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""

#: The checksum goes byte by byte over a table of 256 entries, which a rule gives.
INTERLEAVE = """
    with t as (select list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: case when c % 2 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end)) as t),
    b as (select doc_id, coalesce(source, '') as source, encode(coalesce(text, '')) as b from documents),
    c as (select doc_id, source, octet_length(b) + 8 as size, list_transform(range(0, octet_length(b)), lambda i: ('0x' || hex(b[i + 1:i + 1]))::bigint) as bytes from b),
    d as (select doc_id, source, size::bigint as size, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as text_crc32 from c, t),
    h as (select *, md5(concat_ws('|', '17', doc_id, size, text_crc32)) as h from d),
    f as (select *, (row_number() over (partition by source order by h, doc_id, size, text_crc32) - 1 + ('0x' || md5('17|' || source)[1:8])::bigint / 4294967296::double) / count(*) over (partition by source) as f from h),
    p as (select *, row_number() over (order by f, source, h, doc_id, size, text_crc32) - 1 as pos, count(*) over () as n from f),
    s as (select *, pos * 24 // n as shard from p)
    select doc_id, size, text_crc32, 'rows' as law, shard::integer as shard, pos - (shard * n + 23) // 24 as slot, null::integer as grown_shard, source from s
"""

NEAR_DUPLICATES = f"""
    with recursive w as (
        select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos, len(ws) as n from (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as ws from documents)
    ), x as (
        select doc_id, n, pos, concat_ws(' ', w, lead(w, 1) over p, lead(w, 2) over p, lead(w, 3) over p, lead(w, 4) over p) as s from w window p as (partition by doc_id order by pos)
    ), sh as (select distinct doc_id, s from x where pos <= greatest(1, n - 4)),
    k as (select doc_id, count(*) as n from sh group by doc_id),
    p as (select a.doc_id as u, b.doc_id as v, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
    l as (select u, v from p join k a on a.doc_id = u join k b on b.doc_id = v where 100 * c >= 85 * (a.n + b.n - c)),
    e as (select u, v from l union all select v, u from l),
    r as (select doc_id, doc_id as root from k union select e.v, r.root from r join e on e.u = r.doc_id),
    m as (select doc_id, min(root) as root from r group by doc_id)
    select d.doc_id, coalesce(k.n, 0) as n_shingles, coalesce(root, d.doc_id) as component_id, coalesce(root, d.doc_id) = d.doc_id as kept
    from documents d left join k on k.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""

REPEATS = f"""
    with t as (select doc_id, encode(coalesce(text, '')) as b from documents),
    n as (select doc_id, b, octet_length(b) as n from t),
    w as (select doc_id, i, md5(b[i + 1:i + {LENGTH}]) as h from n, lateral (select unnest(range(0, greatest(0, n - {LENGTH - 1}))) as i)),
    r as (select doc_id, i from w where h in (select h from w group by h having count(*) > 1)),
    s as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + {LENGTH} then 0 else 1 end as new from r),
    g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from s),
    spans as (select doc_id, min(i) as a, max(i) + {LENGTH} as b from g group by doc_id, g),
    cut as (
        select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from spans
        union all select n.doc_id, coalesce(max(spans.b), 0), any_value(n.n) from n left join spans on spans.doc_id = n.doc_id group by n.doc_id
    ), kept as (select cut.doc_id, unhex(string_agg(hex(b[x + 1:y]), '' order by x)) as kept from cut join n on n.doc_id = cut.doc_id where y > x group by cut.doc_id),
    gone as (select doc_id, sum(b - a) as removed, count(*) as spans from spans group by doc_id)
    select n.doc_id, n.n as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans, sha256(coalesce(kept, ''::blob)) as kept_sha256
    from n left join kept on kept.doc_id = n.doc_id left join gone on gone.doc_id = n.doc_id
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def licences() -> str:
    """Every template over every place: words in place are counted, key phrases have to stand whole."""
    words = [(k, i, w) for k, (_, t, _) in enumerate(TEMPLATES) for i, w in enumerate(t.split())]
    keyed = []
    for k, (_, t, keys) in enumerate(TEMPLATES):
        split = t.split()
        for p in map(str.split, keys):
            at = next(i for i in range(len(split)) if split[i : i + len(p)] == p)
            keyed += [(k, at + i) for i in range(len(p))]
    labels = [(k, x, len(t.split()), len({i for j, i in keyed if j == k})) for k, (x, t, _) in enumerate(TEMPLATES)]
    base = [(n, label, i, w) for n, (p, label) in enumerate(BASE.items()) for i, w in enumerate(p.split())]
    sizes = [(n, label, len(p.split())) for n, (p, label) in enumerate(BASE.items())]
    return f"""
        with w as (
            select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as pos from (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents)
        ), t(k, i, w) as (values {_values(words)}), keyed(k, i) as (select distinct * from (values {_values(keyed)})), lab(k, label, n, need) as (values {_values(labels)}),
        bw(p, label, i, w) as (values {_values(base)}), bn(p, label, n) as (values {_values(sizes)}),
        near as (select doc_id, p, pos - i as spot, count(*) as same from w join bw on bw.w = w.w group by doc_id, p, pos - i),
        places as (select doc_id, p, spot from near join bn using (p) where same = n),
        found as (select doc_id, count(*) as n, min(spot) as a, max(spot) as b from places group by doc_id),
        own as (select distinct doc_id, label from places join bn using (p)),
        laid as (
            select doc_id, t.k, pos - t.i as spot, count(*) as same, count(keyed.i) as held from w join t on t.w = w.w left join keyed on keyed.k = t.k and keyed.i = t.i group by doc_id, t.k, pos - t.i
        ), hits as (select doc_id, label, same / n::double as score from laid join lab on lab.k = laid.k where held = need and same / n::double >= 0.8),
        every as (select doc_id, label from own union select doc_id, label from hits)
        select d.doc_id, (select count(*) from w where w.doc_id = d.doc_id) as n_words, coalesce(f.n, 0) as n_base, f.a as first_word, f.b as last_word,
            coalesce((select string_agg(label, ',' order by label) from own where own.doc_id = d.doc_id), '') as base_labels,
            coalesce((select string_agg(label, ',' order by label) from every where every.doc_id = d.doc_id), '') as labels,
            case when f.n > 0 then 1.0::double else coalesce((select max(score) from hits where hits.doc_id = d.doc_id), 0.0::double) end as score
        from documents d left join found f on f.doc_id = d.doc_id
    """


def clusters(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Every vector against every centroid, in each round."""
    out = [
        "v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select row_number() over (order by h) - 1 as c, v from (select sha256('{seed}:' || vec_id) as h, v from v order by h limit {k}))",
    ]
    for i in range(rounds + 1):
        d = "list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v)"
        out.append(f"a{i} as materialized (select vec_id, v, c, d from (select vec_id, v.v, c, {d} as d, row_number() over (partition by vec_id order by {d}, c) as r from v, c{i} c) where r = 1)")
        out.append(f"m{i} as (select c, list(m order by i) as v from (select c, i, floor(sum(x) / count(*)) as m from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{i}) group by c, i) group by c)")
        out.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(m.v, c{i}.v) as v from c{i} left join m{i} m on m.c = c{i}.c)")
    told = f"select vec_id, a.c::integer as cluster, d::bigint as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(list_transform(c.v, lambda x: x::bigint), ',')) as centroid_sha256"
    return f"with {', '.join(out)} {told} from a{rounds} a join c{rounds} c on c.c = a.c"


COLLOCATIONS = f"""
    with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from t),
    g as ({" union all ".join(f"select lang, {n} as words, array_to_string(ws[i:i + {n - 1}], ' ') as phrase from (select lang, ws, unnest(range(1, len(ws) - {n - 2})) as i from p)" for n in (1, 2, 3, 4))}),
    f as materialized (select lang, words, phrase, count(*) as f from g group by all having count(*) >= 30), n as (select lang, sum(len(ws))::bigint as n from p group by lang),
    a as (select * from f where words > 1 and not exists (select 1 from f b where b.lang = f.lang and b.words > f.words and contains(' ' || b.phrase || ' ', ' ' || f.phrase || ' ') and 100 * b.f >= 80 * f.f)),
    k as (select a.*, unnest(range(1, words)) as k, string_split(phrase, ' ') as w from a),
    c as (select k.lang, k.phrase, k.f as a, k, l.f as l, r.f as r, 2000000 * k.f // (l.f + r.f) as score from k join f l on l.lang = k.lang and l.phrase = array_to_string(w[1:k], ' ') join f r on r.lang = k.lang and r.phrase = array_to_string(w[k + 1:], ' ')),
    b as (select *, row_number() over (partition by lang, phrase order by score, k) as cut from c), o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b where cut = 1)
    select o.lang, rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang where rank <= 2000
"""


ORACLE_SQL = {"op1_exact_topk": TOP_K, "op3_interleave": INTERLEAVE, "op5_fast_similarity": NEAR_DUPLICATES, "op6_prefix_free": REPEATS, "op10_license_index": licences(), "op11_weighted_lloyd": clusters(), "op13_suffix_phrases": COLLOCATIONS}
