"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, with DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storewatch.llm import fim, hmm, jaccard, near_vectors, packing, quality, source_mix, substring, token_file, topk, turn_trie, url_filter, warc
from storewatch.session import cut_lineage, new_folder
from storewatch.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn
    return deco


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@_register("""
with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u as (select row_number() over () as k, page_id,
        case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as tail from pages),
s as (select k, page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) as path from u),
best as (select k, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
         from s join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, p) group by k)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from s left join best using (k)
""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the five rules; a url that is not listed is allowed."""
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"), URL_RULES)


WORD = source_mix.WORD


@_register("""
with d as (select row_number() over () as k, coalesce(doc_id, 9223372036854775807) as id, doc_id,
             coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
p as (select k, id, unnest(range(len(w) - 12)) as s, w from d where len(w) >= 13),
g as (select k, id, s, array_to_string(w[s + 1 : s + 13], ' ') as run from p),
m as (select run, min(id) as first from g group by run having count(*) > 1),
c as (select distinct g.k, g.s + o.o as pos from g join m using (run), (select unnest(range(13)) as o) o where g.id > m.first),
x as (select k, count(*) as n, list(pos) as gone from c group by k)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(case when gone is null then array_to_string(w, ' ')
         else array_to_string(list_filter(w, lambda t, i: not list_contains(gone, i - 1)), ' ') end) as kept_sha256
from d left join x using (k)
""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are left of every document once passages of 13 words or more that an earlier one has are cut."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substring.remove_repeats(docs, min_words=13)
    kept = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)), " ")
    return done.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(kept, 256).alias("kept_sha256"))


MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED = (5, 2, 1), 3, 17


@_register("""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
             md5('17:' || coalesce(doc_id::varchar, '')) as o from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 3 * source_size as cap,
        [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight,
        row_number() over (order by source nulls last) as place from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0))::bigint::double
               / (sum(weight) over () - coalesce(sum(weight) over b, 0))::bigint as lev
      from w window b as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cap::double, weight * max(lev) over ()) as target from l),
f as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
g as (select *, round(target - whole * source_size)::bigint as budget from f),
r as (select d.doc_id, d.size, g.*, sum(d.size) over (partition by d.source order by o, doc_id, size rows unbounded preceding) as run
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, round(target, 6) as target,
  (size * (whole + case when 2 * run - size <= 2 * budget then 1 else 0 end))::bigint as taken from r
""")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 5, 2, 1 (repeating) and at most 3 epochs takes of each document."""
    plan = source_mix.mix_plan(read_table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS, max_epochs=MIX_EPOCHS,
                               seed=MIX_SEED)
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@_register("""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where embedding is not null and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
""")
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors of highest integer inner product for every vector whose id is divisible by 50."""
    vecs = read_table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding"), 256).alias("vec"))
    return topk.top_k(vecs.filter(F.col("vec_id") % 50 == 0), vecs, 5, id_col="vec_id")


@_register("""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, strlen(html)::bigint as payload_bytes, sha1(html) as hex from p),
b as (select *, list_aggregate(list_transform(range(8), lambda i: (
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i * 5 + 1)::int, 5))::int >> 15) & 31) + 1, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i * 5 + 1)::int, 5))::int >> 10) & 31) + 1, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i * 5 + 1)::int, 5))::int >> 5) & 31) + 1, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, (i * 5 + 1)::int, 5))::int & 31) + 1, 1))),
        'string_agg', '') as payload_digest, max(page_id) over (partition by html) as holder from h)
select page_id, payload_bytes, payload_digest, case when page_id = holder then 'response' else 'revisit' end as record_type,
  case when page_id <> holder then holder end as refers_to from b
""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as Zstandard WARC archives (equal payloads once, the rest revisits) and read back."""
    manifest = cut_lineage(warc.write_archives(warc.mark_revisits(read_table(spark, sf_dir, "pages")),
                                               new_folder(spark, "warc")))
    return warc.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest",
                                                            "record_type", "refers_to")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_register("""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as r from v),
l as (select a.vec_id as x, b.vec_id as y from n a join n b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      and list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.9),
r as (select vec_id as x, vec_id as y from embeddings union select r.x, l.y from r join l on r.y = l.x),
m as (select x as vec_id, min(y) as component_id from r group by x),
k as (select x as vec_id, count(*) as n from l group by x)
select m.vec_id, coalesce(k.n, 0)::bigint as n_links, component_id, m.vec_id = component_id as kept
from m left join k using (vec_id)
""")
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings linked by a cosine of 0.9 or more: number of links and component of every vector."""
    return near_vectors.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


@_register("""
with recursive d as (select coalesce(doc_id, 9223372036854775807) as id, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
s as (select id, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) end as g from d),
o as (select *, list_sort(g) as og from s),
c as (select og, min(id) as node, any_value(len(g)) as n from o where len(g) > 0 group by og),
t as (select node, n, unnest(og) as g from c),
p as (select a.node as x, b.node as y, count(*) as k, any_value(a.n) as n1, any_value(b.n) as n2
      from t a join t b on a.g = b.g and a.node < b.node and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by 1, 2),
e as (select x, y from p where 100 * k >= 90 * (n1 + n2 - k)),
b as (select x, y from e union select y, x from e),
r as (select node as x, node as y from c union select r.x, b.y from r join b on r.y = b.x),
m as (select x as node, min(y) as comp from r group by x)
select o.doc_id, len(o.g)::bigint as n_shingles, coalesce(m.comp, o.doc_id) as component_id
from o left join c on o.og = c.og left join m using (node)
""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.9 or more of their 3-word shingles."""
    groups = jaccard.similar_groups(read_table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return groups.select("doc_id", "n_shingles", "component_id")


@_register()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    packed = packing.pack(read_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 2048, with_ids=True)
    return packing.digests(packed)


@_register()
def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bit-packed token id files in doc_id order, read back: position, length and checksum of each."""
    manifest = cut_lineage(token_file.write_tokens(read_table(spark, sf_dir, "documents"), new_folder(spark, "tokens"),
                                                   _vocabulary("byte_bpe_50k.json")))
    return token_file.read_tokens(manifest, digest_only=True).drop("ids")


@_register()
def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a conditional random field over its lines."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    done = quality.score_quality(docs, model, threshold=0.3)
    return done.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "quality_of_text.score",
                       "quality_of_text.predicted")


@_register("""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
             sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (select *, len(u)::bigint as n, [('0x' || substr(h, (8 * i + 1)::int, 8))::bigint for i in range(4)] as r from d),
c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 90 then 'plain'
             when r[4] % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (select *, array_to_string(u[1 : a], '') as pre, array_to_string(u[a + 1 : b], '') as mid, array_to_string(u[b + 1 :], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars,
  case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
         else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p
""")
def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for fill-in-the-middle: cuts, form, digests of the output and of the text rebuilt from it."""
    return fim.digests(fim.fill_in_middle(read_table(spark, sf_dir, "documents")))


@_register("""
with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (
             partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as j from conversations where conv_id is not null),
b as (select *, md5(r) || md5(x) as v, length(x)::bigint as n from t),
o as (select c, count(*) as own, (xor(list_reduce([4294967295::bigint] || flatten([[ord(a), -1, -1, -1, -1, -1, -1, -1, -1]::bigint[] for a in string_split(c::varchar, '')]),
        lambda s, e: case when e >= 0 then xor(s, e) else xor(s >> 1, 3988292384 * (s & 1)) end), 4294967295) % 6)::bigint as h from t group by c),
g as (select o.c, b.j, v, n from o join b on b.c = o.c - o.c % 100 and b.j <= o.h union all select o.c, b.j, v, n from o join b on b.c = o.c and b.j > o.h),
s as (select c, row_number() over w as depth, string_agg(v, '') over w as k, n from g window w as (partition by c order by j)),
p as (select c, depth, k, n from s union all select c, 0, '', 0 from o),
e as (select c, max(depth) as depth from p group by c),
m as (select k, any_value(depth)::bigint as depth, min(c) as conv_id, count(*) as n_convs, any_value(n) as n from p group by k),
f as (select k, string_agg(c::varchar, ',' order by c) as ids from p join e using (c, depth) group by k),
q as (select m.*, u.conv_id as parent_conv_id, u.k as up from m left join m u on m.depth = u.depth + 1 and u.k = left(m.k, (64 * u.depth)::int)),
i as (select up, count(*) as n_children from q where up is not null group by up),
a as (select left(k, (64 * unnest(range(depth + 1)))::int) as k, (i.up is null)::int as leaf, (n_convs - 1) * n as saved from q left join i on i.up = q.k),
z as (select k, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from a group by k)
select conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from q join z using (k) left join i on i.up = q.k left join f on f.k = q.k
""")
def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the rebuilt conversations: members, children, leaves and savings of every node."""
    nodes = turn_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), borrow=True)
    return nodes.drop("enter", "exit")


@_register()
def op11_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a hidden Markov model and under smoothed unigrams."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.score_texts(docs, ~hmm.held_out(F.col("doc_id")))
