"""Queries of search: vectors, keywords, BM25, fusion, packing, sections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import context as X2
from folioforge.operators import hybrid as H
from folioforge.operators import lexical as X
from folioforge.operators import sections as S
from folioforge.operators import vectors as V
from folioforge.operators.ingest import index_state
from folioforge.plans import library as L
from folioforge.plans.queries_text import keywords_sql, sentences_sql, tokens_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_C = """
c as (select distinct on (id) id, paper_id, chunk_index, text_content as text, embedding_vector as vec, section_name as section, chunk_type,
  importance_score as importance, coalesce(is_valid, false) as valid from paper_chunks)"""
_D = """
v as (select id, paper_id, vec::double[64] as x from c where valid and len(vec) = 64),
d as (select q.id as qid, v.id, v.paper_id, round(power(array_distance(q.x, v.x), 2), 6) as distance from v q join v on q.id % 100 = 0)"""


@query(f"with {_C}, {_D} select qid, id, distance, (r - 1)::int as rank from (select *, row_number() over (partition by qid order by distance, id) as r from d) where r <= 24")
def v1_knn(spark, folder):
    c = L.chunks(spark, folder, valid=True)
    return V.knn(L.asking(c), c, 24, L.DIM)


_G = "g as (select qid, paper_id as grp, min(distance) as distance from (select *, row_number() over (partition by qid order by distance, id) as r from d) where r <= 24 group by all)"


@query(f"with {_C}, {_D}, {_G} select qid, grp, distance from (select *, row_number() over (partition by qid order by distance, grp) as r from g) where r <= 8")
def v3_top_papers(spark, folder):
    c = L.chunks(spark, folder, valid=True)
    return V.nearest_groups(L.asking(c), c.select("id", F.col("paper_id").alias("grp"), "vec"), 8, L.DIM)


@query(f"with {_C}, {_D}, {_G.replace('24', '60')}, t as (select *, row_number() over (partition by qid order by distance, grp) as r from g), s as (select t.*, c.paper_id from t join c on c.id = t.qid where r <= 20 and t.grp <> c.paper_id) select qid, grp, distance from (select *, row_number() over (partition by qid order by distance, grp) as n from s) where n <= 5")
def t5_similar_papers(spark, folder):
    """The five papers nearest to a chunk, without its own."""
    c = L.chunks(spark, folder, valid=True)
    near = V.nearest_groups(L.asking(c), c.select("id", F.col("paper_id").alias("grp"), "vec"), 20, L.DIM)
    seeds = c.select(F.col("id").alias("qid"), F.col("paper_id").alias("grp"))
    left = near.join(seeds, ["qid", "grp"], "left_anti")
    return left.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("distance", "grp"))).where("n <= 5").drop("n")


@query(f"""with {_C},
e as (select t.id, t.paper_id, unnest({tokens_sql('t.text')}) as term from c t where t.valid)
select count(*)::bigint as docs, (select count(distinct term) from e)::bigint as terms, (select count(*) from e)::bigint as postings from c where valid""")
def a6_term_statistics(spark, folder):
    c = L.chunks(spark, folder, valid=True).select("id", T.tokens(F.col("text")).alias("t"))
    flat = c.select(F.explode("t").alias("term")).agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))
    # two frames of one row each
    return c.agg(F.count("*").alias("docs")).join(F.broadcast(flat)).select("docs", "terms", "postings")


@query(f"""with {_C},
docs as (select id, {tokens_sql('text')} as t from c where valid and text is not null),
st as (select count(*) as n, avg(len(t)) as mean from docs),
p as (select id, len(t) as len, unnest(t) as term from docs), tf as (select id, term, len, count(*) as tf from p group by all),
df as (select term, count(*) as df from tf group by all),
q as (select id as qid, unnest({keywords_sql('title')}) as term from papers where id % 100 = 0), m as (select qid, term, count(*) as m from q group by all),
s as (select qid, tf.id, round(sum(m * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean)))), 6) as score from m join tf using (term) join df using (term), st group by all)
select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as r from s) where r <= 5""")
def r6_bm25(spark, folder):
    """The five chunks that match best for every paper title whose id is divisible by 100."""
    q = L.papers(spark, folder).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("title").alias("question"))
    return X.bm25(q, L.chunks(spark, folder, "text is not null", valid=True).select("id", "text"), 5)


@query(f"""with {_C},
s as (select c.id, c.text, {sentences_sql('c.text')} as s, list_distinct({keywords_sql('p.title')}) as k from c join papers p on p.id = c.paper_id where c.text is not null),
u as (select id, unnest(s) as x, generate_subscripts(s, 1) as i, k from s where len(s) > 5 and len(k) > 0),
n as (select id, x, i, len(list_intersect(list_distinct(k), list_distinct({tokens_sql('x')}))) as n from u),
t as (select id, i from (select *, row_number() over (partition by id order by n desc, i) as r from n) where r <= 3),
k as (select distinct n.id, n.i, n.x from n join t on t.id = n.id and abs(t.i - n.i) <= 1),
e as (select id, string_agg(x, ' ' order by i) as y from k group by id)
select s.id, sha256(coalesce(e.y, s.text)) as digest from s left join e on e.id = s.id""")
def r5_relevant_sentences(spark, folder):
    c = L.chunks(spark, folder, "text is not null").select("id", "paper_id", "text")
    p = L.papers(spark, folder).select(F.col("id").alias("paper_id"), F.array_distinct(T.keywords(F.col("title"))).alias("k"))
    return c.join(p, "paper_id").select("id", F.sha2(X.relevant_sentences(F.col("text"), F.col("k")), 256).alias("digest"))


@query("select id, title from papers where title ilike '%uncertainty%' or authors ilike '%uncertainty%' or abstract ilike '%uncertainty%'")
def pr3_keyword_papers(spark, folder):
    any_ = [F.coalesce(F.col(c).ilike("%uncertainty%"), F.lit(False)) for c in ("title", "authors", "abstract")]
    return L.papers(spark, folder).where(any_[0] | any_[1] | any_[2]).select("id", "title")


@query(f"with {_C} select id, importance from (select id, importance from c where valid and (contains(lower(text), 'sparse') or contains(lower(text), 'glacier')) order by importance desc nulls last, id limit 50)")
def pr5_keyword_chunks(spark, folder):
    """A top-50 report by importance of chunks that hold one of two words."""
    c = L.chunks(spark, folder, valid=True).where(X.keyword_match(F.col("text"), F.array(F.lit("sparse"), F.lit("glacier"))))
    return c.orderBy(F.desc_nulls_last("importance"), "id").select("id", "importance").limit(50)


@query(f"with {_C} select id, chunk_index from c where valid and paper_id = 1 and section ilike '%method%'")
def pr4_section_filter(spark, folder):
    return L.chunks(spark, folder, "paper_id = 1", valid=True).where(F.col("section").ilike("%method%")).select("id", "chunk_index")


@query(f"with {_C} select c.id, c.paper_id, c.chunk_index from c where valid and (paper_id, chunk_index) in (select id, 0 from papers where year >= 2020)")
def pr6_chunks_by_key(spark, folder):
    keys = L.papers(spark, folder).where("year >= 2020").select(F.col("id").alias("paper_id"), F.lit(0).alias("chunk_index"))
    return L.chunks(spark, folder, valid=True).join(keys, ["paper_id", "chunk_index"], "left_semi").select("id", "paper_id", "chunk_index")


@query(f"with {_C} select id, paper_id, importance from c where chunk_type in ('abstract', 'introduction')")
def pr7_chunks_by_type(spark, folder):
    return L.chunks(spark, folder, F.col("chunk_type").isin("abstract", "introduction")).select("id", "paper_id", "importance")


_K = f"""
kw as (select id as qid, unnest(list_distinct(({keywords_sql('text')})[1:8])) as w from c where valid and id % 100 = 0 and len(vec) = 64),
kh as (select distinct kw.qid, c.id, c.importance from kw join c on c.valid and contains(lower(c.text), kw.w)),
ks as (select qid, id, r - 1 as r from (select *, row_number() over (partition by qid order by importance desc nulls last, id) as r from kh) where r <= 24),
ds as (select qid, id, r - 1 as r from (select *, row_number() over (partition by qid order by distance, id) as r from d) where r <= 24),
zk as (select qid, count(*) as z from ks group by all), zd as (select qid, count(*) as z from ds group by all),
f as (select qid, id, round(1 / (60 + coalesce(ds.r, 2 * coalesce(zd.z, 0))) + 1 / (60 + coalesce(ks.r, 2 * coalesce(zk.z, 0))), 9) as rrf
  from ds full outer join ks using (qid, id) left join zd using (qid) left join zk using (qid))"""


def _fused(c):
    q = L.asking(c).where(F.size("vec") == L.DIM)
    return q, H.fuse(V.knn(q, c, 24, L.DIM).select("qid", "id", "rank"), H.keyword_ranks(q, c, 24))


@query(f"with {_C}, {_D}, {_K} select qid, id, rrf from f")
def r8_rank_fusion(spark, folder):
    return _fused(L.chunks(spark, folder, valid=True))[1]


@query(f"""with {_C}, {_D}, {_K},
j as (select f.qid, f.id, f.rrf, c.paper_id, c.chunk_index from f join c using (id) where length(c.text) > 0),
p as (select *, row_number() over (partition by qid, paper_id order by rrf desc, paper_id, chunk_index, id) as n from j),
t as (select *, row_number() over (partition by qid order by rrf desc, paper_id, chunk_index, id) as place from p where n <= 3)
select qid, id, paper_id, rrf, place::int as place from t where place <= 8""")
def w3_capped_fusion(spark, folder):
    c = L.chunks(spark, folder, valid=True)
    return H.capped(_fused(c)[1], c, 8).select("qid", "id", "paper_id", "rrf", "place")


_R9 = f"""with recursive {_C.strip()}, {_D}, {_K},
j as (select f.qid, f.id, f.rrf, c.paper_id, c.chunk_index, c.section, c.importance, c.text from f join c using (id) where length(c.text) > 0),
p as (select *, row_number() over (partition by qid, paper_id order by rrf desc, paper_id, chunk_index, id) as n from j),
t as (select *, row_number() over (partition by qid order by rrf desc, paper_id, chunk_index, id) as place from p where n <= 3),
q as (select id as qid, paper_id as own, text as question, list_distinct({keywords_sql('text')}) as words from c where valid and id % 100 = 0 and len(vec) = 64),
o as (select *, row_number() over (partition by paper_id order by importance desc nulls last, id) as n from c where valid and chunk_type in ('abstract', 'introduction', 'paragraph') and text is not null),
k as (select qid, place, id, paper_id, section, text, round(rrf * case when coalesce(importance, 0) = 0 then 0.5 else importance end, 9) as score from t where place <= 8
  union all select q.qid, 9, o.id, o.paper_id, o.section, o.text, 0.05 from q join o on o.paper_id = q.own and o.n = 1 where not exists (select 1 from t where t.qid = q.qid and t.paper_id = q.own and t.place <= 8)),
ss as (select k.qid, k.id, k.text, {sentences_sql('k.text')} as s, q.words as w from k join q using (qid)),
su as (select qid, id, unnest(s) as x, generate_subscripts(s, 1) as i, w from ss where len(s) > 5 and len(w) > 0),
sn as (select qid, id, x, i, len(list_intersect(w, list_distinct({tokens_sql('x')}))) as n from su),
st as (select qid, id, i from (select *, row_number() over (partition by qid, id order by n desc, i) as r from sn) where r <= 3),
sk as (select distinct sn.qid, sn.id, sn.i, sn.x from sn join st on st.qid = sn.qid and st.id = sn.id and abs(st.i - sn.i) <= 1),
se as (select qid, id, string_agg(x, ' ' order by i) as y from sk group by all),
x as (select k.*, regexp_replace(coalesce(se.y, k.text), '^\\s+|\\s+$', '', 'g') as excerpt from k left join se using (qid, id)),
i as (select *, greatest(1, length(excerpt) // 4) + 15 as cost, row_number() over (partition by qid order by score desc, place) as r from x where excerpt <> ''),
g as (select qid, r, case when cost <= 600 then cost else 0 end as used, cost <= 600 as kept from i where r = 1
  union all select i.qid, i.r, case when g.used + i.cost <= 600 then g.used + i.cost else g.used end, g.used + i.cost <= 600 from g join i on i.qid = g.qid and i.r = g.r + 1),
h as (select i.* from i join g using (qid, r) where g.kept)
"""


def _retrieved(spark, folder):
    c = L.chunks(spark, folder, valid=True)
    q = c.where((F.col("id") % 100 == 0) & (F.size("vec") == L.DIM)).select(F.col("id").alias("qid"), F.col("text").alias("question"), "vec", "paper_id")
    return H.retrieve(q.drop("paper_id"), c, 8, 600, L.DIM, pins=q.select("qid", "paper_id"))


@query(_R9 + "select qid, place::int as place, id, paper_id, section, score::double as score, sha256(excerpt) as digest from h")
def r9_hybrid_retrieve(spark, folder):
    """The context packed for every valid chunk whose id is divisible by 100, its own
    paper being pinned."""
    r = _retrieved(spark, folder)
    return r.select("qid", "place", "id", "paper_id", "section", "score", F.sha2("excerpt", 256).alias("digest"))


@query(_R9 + """, b as (select h.qid, h.score, h.place, h.paper_id, coalesce(nullif(p.title, ''), 'Untitled') as title, coalesce(p.authors, '') as authors, coalesce(p.year::varchar, '') as year, coalesce(h.section, 'Content') as section, h.excerpt from h join papers p on p.id = h.paper_id),
e as (select distinct qid, paper_id, '  Paper ' || paper_id || ': [id ' || paper_id || '] ' || title || ' — ' || authors || ', ' || year as l from b),
n as (select qid, string_agg(l, chr(10) order by paper_id) as legend, count(*) as papers from e group by qid),
m as (select qid, string_agg('[Paper ' || paper_id || ' | ' || case when length(title) > 55 then substring(title, 1, 55) || '…' else title end || ' | ' || section || ']' || chr(10) || excerpt, chr(10) || chr(10) order by score desc, place) as blocks from b group by qid)
select qid, sha256('Papers in context:' || chr(10) || legend || chr(10) || chr(10) || blocks) as digest, papers::int as papers from n join m using (qid)""")
def r10_context_blocks(spark, folder):
    """The context of each question as the model reads it: legend and labelled blocks."""
    c = X2.context_blocks(_retrieved(spark, folder), L.papers(spark, folder))
    return c.select("qid", F.sha2("context", 256).alias("digest"), "papers")


@query(_R9 + "select h.qid, h.id, coalesce(nullif(p.title, ''), 'Untitled') as title, coalesce(p.authors, '') as authors, coalesce(p.year::varchar, '') as year from h join papers p on p.id = h.paper_id")
def j5_excerpt_titles(spark, folder):
    return X2.titled(_retrieved(spark, folder), L.papers(spark, folder)).select("qid", "id", "title", "authors", "year")


@query(f"""with {_C},
o as (select *, row_number() over (partition by paper_id order by importance desc nulls last, id) as r from c where valid and chunk_type in ('abstract', 'introduction', 'paragraph') and text is not null),
n as (select distinct n.id as qid, unnest(paper_ids) as paper_id from notes n)
select n.qid, n.paper_id, o.id, o.section from n join o on o.paper_id = n.paper_id and o.r = 1
where n.paper_id not in (select unnest(regexp_extract_all(coalesce(m.answer, ''), '\\[Paper\\s+(\\d+)', 1))::bigint from notes m where m.id = n.qid)""")
def j6_pinned_papers(spark, folder):
    """For each note the opening chunk of those of its papers that its answer does not cite."""
    n = L.notes(spark, folder)
    cited = n.select(F.col("id").alias("qid"), F.explode(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[Paper\s+(\d+)"), F.lit(1))).alias("p")).select("qid", F.col("p").cast("bigint").alias("paper_id"))
    pins = n.select(F.col("id").alias("qid"), F.explode("paper_ids").alias("paper_id"))
    return X2.pinned(cited, pins, L.chunks(spark, folder, valid=True)).select("qid", "paper_id", "id", "section")


@query("select distinct id, floor(w * 0.6)::int as input, floor(w * 0.3)::int as response from (select id, case model " + " ".join(f"when '{m}' then {w}" for m, w in X2.WINDOWS.items()) + f" else {X2.DEFAULT_WINDOW} end as w from llm_cache)")
def r15_model_budgets(spark, folder):
    m = F.col("model")
    return L.cache(spark, folder).select("id", X2.budget(m).alias("input"), X2.budget(m, X2.RESPONSE_SHARE).alias("response"))


@query(f"""with recursive {_C.strip()}, {_D}, {_K},
j as (select f.qid, f.id, f.rrf, c.paper_id, c.chunk_index, c.text from f join c using (id) where length(c.text) > 0),
p as (select *, row_number() over (partition by qid, paper_id order by rrf desc, paper_id, chunk_index, id) as n from j),
t as (select *, row_number() over (partition by qid order by rrf desc, paper_id, chunk_index, id) as r from p where n <= 3),
i as (select qid, id, r, greatest(1, length(text) // 4) + 15 as cost from t where r <= 8),
w as (select qid, id, r, case when cost <= 400 then cost else 0 end as used, cost <= 400 as kept from i where r = 1
  union all select i.qid, i.id, i.r, case when w.used + i.cost <= 400 then w.used + i.cost else w.used end, w.used + i.cost <= 400 from w join i on i.qid = w.qid and i.r = w.r + 1)
select qid, id from w where kept""")
def w6_greedy_packing(spark, folder):
    """Of each question's eight best chunks those that fit 400 tokens, greedily."""
    c = L.chunks(spark, folder, valid=True)
    best = H.capped(_fused(c)[1], c, 8)
    one = F.struct("place", "id", (T.token_estimate(F.col("text")) + 15).alias("cost"))
    g = best.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("items"))
    return g.select("qid", F.explode(H.greedy(F.col("items"), "cost", F.lit(400))).alias("x")).select("qid", "x.id")


_KEY = "case " + " ".join(f"when contains(n, '{k}') then '{k}'" for k in T.SECTION_BUDGETS if k != "_other") + " else '_other' end"
_BUDGET = "case key " + " ".join(f"when '{k}' then {v}" for k, v in T.SECTION_BUDGETS.items()) + " end"
_RANK = "case key " + " ".join(f"when '{k}' then {i + 1}" for i, k in enumerate(T.SECTION_BUDGETS)) + " end"


@query(f"with {_C} select id, {_KEY} as key from (select id, lower(coalesce(nullif(section, ''), chunk_type, '')) as n from c)")
def r11_section_keys(spark, folder):
    return L.chunks(spark, folder).select("id", T.section_key(F.col("section"), F.col("chunk_type")).alias("key"))


@query(f"""with {_C},
k as (select *, {_KEY} as key from (select *, lower(coalesce(nullif(section, ''), chunk_type, '')) as n from c where valid and length(text) > 0)),
j as (select paper_id, key, string_agg(text, ' ' order by coalesce(importance, 0) desc, chunk_index, id) as t from k group by all),
e as (select paper_id, {_RANK} as rank, key, substring(t, 1, {_BUDGET} * 4) as excerpt from j),
u as (select *, sum(greatest(1, length(excerpt) // 4) + 5) over (partition by paper_id order by rank) as used from e)
select paper_id, rank::int as rank, key as section_key, sha256(excerpt) as digest from u where used <= 2000""")
def r12_structured_extract(spark, folder):
    return S.structured_extract(L.chunks(spark, folder)).select("paper_id", "rank", "section_key", F.sha2("excerpt", 256).alias("digest"))


@query(f"""with {_C},
v as (select * from c where valid and length(text) > 0),
j as (select paper_id, substring(string_agg(text, ' ' order by coalesce(importance, 0) desc, chunk_index, id), 1, 2400) as t from v where contains(lower(section), 'results') group by all),
w as (select paper_id, id, chunk_index, text, {tokens_sql('text')} as t from v where paper_id not in (select paper_id from j)),
k as (select *, len(t) as len, len(list_filter(t, lambda x: x = 'results')) as tf from w),
st as (select paper_id, count(*) as n, avg(len) as mean, count(*) filter (where tf > 0) as df from k group by all),
sc as (select k.*, ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) as score from k join st using (paper_id) where tf > 0),
b as (select paper_id, substring(regexp_replace(string_agg(text, ' ' order by score desc, chunk_index, id), '^\\s+|\\s+$', '', 'g'), 1, 2400) as t
  from (select *, row_number() over (partition by paper_id order by score desc, chunk_index, id) as r from sc) where r <= 5 group by all)
select p.id as paper_id, sha256(coalesce(j.t, b.t, '[Section ''results'' not found]')) as digest from papers p left join j on j.paper_id = p.id left join b on b.paper_id = p.id""")
def r14_aligned_sections(spark, folder):
    s = S.aligned_section(L.chunks(spark, folder), L.papers(spark, folder).select(F.col("id").alias("paper_id")), "results")
    return s.select("paper_id", F.sha2("excerpt", 256).alias("digest"))


@query(f"with {_C} select paper_id, section, min(chunk_index) as first from c where valid and length(section) > 0 group by all")
def a4_section_names(spark, folder):
    return S.section_names(L.chunks(spark, folder))


_N = "n as (select paper_id, section, min(chunk_index) as first from c where valid and length(section) > 0 group by all)"


def _fuzzy(a: str, b: str) -> str:
    words = "case " + " ".join(f"when {a} = '{k}' then [" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in S.SECTION_WORDS.items()) + f" else [{a}] end"
    return f"case when contains({b}, {a}) or contains({a}, {b}) then 0 when len(list_filter({words}, lambda w: contains({b}, w))) > 0 then 1 end"


@query(f"""with {_C}, {_N}, g as (select unnest(['abstract', 'introduction', 'methodology', 'results', 'discussion', 'conclusion']) as name),
m as (select g.name, n.*, {_fuzzy('g.name', 'lower(n.section)')} as rank from n, g)
select paper_id, name, section from (select *, row_number() over (partition by paper_id, name order by rank, first, section) as r from m where rank is not null) where r = 1""")
def j10_fuzzy_sections(spark, folder):
    """The section of each paper that is meant by each of six usual names."""
    return S.fuzzy_sections(S.section_names(L.chunks(spark, folder, valid=True)), list(S.SECTION_WORDS))


@query(f"""with {_C}, {_N},
l as (select id as note, paper_ids[1] as lead, list_filter(list_distinct(paper_ids), lambda x: x <> paper_ids[1]) as rest from notes where len(paper_ids) > 0),
o as (select note, lead, unnest(rest) as other from l),
r as (select l.note, n.section, n.first, len(l.rest) as need from l join n on n.paper_id = l.lead),
h as (select distinct r.note, r.section, o.other from r join o on o.note = r.note join n on n.paper_id = o.other where {_fuzzy('lower(r.section)', 'lower(n.section)')} is not null)
select r.note, r.section, r.first from r left join h on h.note = r.note and h.section = r.section group by r.note, r.section, r.first, r.need having count(h.other) = r.need""")
def j11_common_sections(spark, folder):
    """For each note the sections of its first paper that all its papers have."""
    lists = L.notes(spark, folder).select(F.col("id").alias("note"), F.col("paper_ids").alias("papers"))
    return S.common_sections(S.section_names(L.chunks(spark, folder, valid=True)), lists)


@query(f"with {_C} select q.id as qid, c.id, case when len(c.vec) = 64 then round(power(array_distance(q.vec::double[64], (case when len(c.vec) = 64 then c.vec end)::double[64]), 2), 6) else 1e9 end as distance from c q join c on c.paper_id = q.paper_id where q.valid and q.id % 100 = 0 and len(q.vec) = 64")
def v4_rerank(spark, folder):
    """For every question the rows of its own paper by distance; those that could not be
    encoded come last."""
    c = L.chunks(spark, folder)
    q = c.where("valid and id % 100 = 0").where(F.size("vec") == L.DIM).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "paper_id")
    return V.rerank(c.select("id", "vec", "paper_id").join(q, "paper_id"), L.DIM).select("qid", "id", "distance")


@query(f"with {_C} select case when vec is null then 'missing' when len(vec) <> 64 then 'size' else 'fits' end as state, count(*)::bigint as n from c group by all")
def v2_validated_vectors(spark, folder):
    return L.chunks(spark, folder).groupBy(V.fitness(F.col("vec"), L.DIM).alias("state")).agg(F.count("*").alias("n"))


@query(f"with {_C}, k as (select paper_id, chunk_index, count(*) as n, count(*) filter (where len(vec) <> 64) as m from c where vec is not null group by all) select sum(n)::bigint as size, sum(m)::bigint as misfits, count(*) filter (where n > 1)::bigint as repeated from k")
def v6_index_state(spark, folder):
    return index_state(L.chunks(spark, folder, "vec is not null"), L.DIM)
