"""Queries over text: tokens, sentences, chunking, metadata, names, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import extract as X
from folioforge.functions import intent as I
from folioforge.functions import text as T
from folioforge.operators import chunking as K
from folioforge.operators.maintain import unique_targets
from folioforge.plans import library as L

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda t: t <> '')"


def tokens_sql(x: str) -> str:
    return _TOKENS.format(x)


def keywords_sql(x: str) -> str:
    return f"list_filter({tokens_sql(x)}, lambda t: length(t) >= 3 and not list_contains({_list(T.STOPWORDS)}, t))"


def sentences_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace({x}, '^ +| +$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(f"select doc_id, len(t)::int as n, sha256(array_to_string(t, ' ')) as digest from (select doc_id, {tokens_sql('text')} as t from documents)")
def r1_tokens(spark, folder):
    d = L.documents(spark, folder).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query(f"select id, len(k)::int as n, array_to_string(k, ' ') as keywords from (select id, {keywords_sql('title')} as k from papers)")
def r2_keywords(spark, folder):
    k = L.papers(spark, folder).select("id", T.keywords(F.col("title")).alias("k"))
    return k.select("id", F.size("k").alias("n"), F.array_join("k", " ").alias("keywords"))


@query("select doc_id, greatest(1, length(text) // 4)::int as tokens from documents")
def r3_token_estimate(spark, folder):
    return L.documents(spark, folder).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"select doc_id, len(s)::int as n, sha256(array_to_string(s, '|')) as digest from (select doc_id, {sentences_sql('text')} as s from documents)")
def r4_sentences(spark, folder):
    d = L.documents(spark, folder).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


_WINDOWS = """
with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as words from documents),
s as (select *, case when len(words) <= {size} then [0] else range(0, ceil((len(words) - {size}) / {step}.0)::bigint * {step} + 1, {step}) end as starts from w)
select doc_id, (i - 1)::int as chunk, sha256(case when len(words) <= {size} then text else array_to_string(words[starts[i] + 1:starts[i] + {size}], ' ') end) as digest
from (select *, unnest(range(1, len(starts) + 1)) as i from s)"""


def _windows(spark, folder, size, overlap):
    d = L.documents(spark, folder).select("doc_id", F.posexplode(K.word_windows(F.col("text"), size, overlap)).alias("chunk", "x"))
    return d.select("doc_id", "chunk", F.sha2("x", 256).alias("digest"))


@query(_WINDOWS.format(size=600, step=500))
def c2_word_windows(spark, folder):
    return _windows(spark, folder, 600, 100)


@query(_WINDOWS.format(size=500, step=450))
def c3_encoder_windows(spark, folder):
    return _windows(spark, folder, 500, 50)


@query(f"""
with recursive s as (select doc_id, unnest(x) as s, generate_subscripts(x, 1) as i from (select doc_id, {sentences_sql('text')} as x from documents)),
r as (select doc_id, i, s, 0 as chunk, length(s) // 4 as n, i as first from s where i = 1
  union all
  select s.doc_id, s.i, s.s,
    case when r.n + length(s.s) // 4 > 300 then r.chunk + 1 else r.chunk end,
    case when r.n + length(s.s) // 4 > 300 then length(r.s) // 4 + length(s.s) // 4 else r.n + length(s.s) // 4 end,
    case when r.n + length(s.s) // 4 > 300 then r.i else r.first end
  from r join s on s.doc_id = r.doc_id and s.i = r.i + 1),
e as (select doc_id, chunk, min(first) as a, max(i) as b from r group by all)
select e.doc_id, e.chunk::int as chunk, sha256(string_agg(s.s, ' ' order by s.i)) as digest
from e join s on s.doc_id = e.doc_id and s.i between e.a and e.b group by all""")
def c4_sentence_chunks(spark, folder):
    d = L.documents(spark, folder).select("doc_id", F.posexplode(K.sentence_chunks(F.col("text"), 300)).alias("chunk", "x"))
    return d.select("doc_id", "chunk", F.sha2("x", 256).alias("digest"))


@query()
def c5_structure(spark, folder):
    """Parts of each paper by headings; checked against a fixture in the tests."""
    return K.structure(L.documents(spark, folder).withColumnRenamed("doc_id", "id"))


_NOTE = "coalesce(formatted_note, '') || chr(10) || answer || chr(10) || '### Sources' || chr(10) || array_to_string(coalesce(sources, []), ' ')"


@query(f"""
with m as (select id, chr(10) || ({_NOTE}) as t from notes where answer is not null),
b as (select id, unnest(string_split(regexp_replace(t, '\\n(#{{1,3}}[ \\t]+\\S)', chr(1) || '\\1', 'g'), chr(1))) as x from m),
p as (select id, nullif(trim(regexp_extract(x, '^#{{1,3}}[ \\t]+([^\\n]+)', 1)), '') as name, x from b)
select id, name, regexp_replace(case when name is null then x else regexp_replace(regexp_replace(x, '^#{{1,3}}[ \\t]+[^\\n]+\\n?', ''), '(?m)^\\s*[-*]{{3,}}\\s*$', '', 'g') end, '^\\s+|\\s+$', '', 'g') as body
from p where name is not null or regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''""")
def c7_markdown_sections(spark, folder):
    n = L.notes(spark, folder).where("answer is not null")
    text = F.concat(F.coalesce("formatted_note", F.lit("")), F.lit("\n"), "answer", F.lit("\n### Sources\n"), F.array_join(F.coalesce("sources", F.array().cast("array<string>")), " "))
    return n.select("id", F.explode(K.markdown_sections(text)).alias("x")).select("id", "x.name", "x.body")


_CASES = " ".join(f"when contains(n, '{p}') then '{k}'" for p, k in T.SECTION_TYPES)


@query(f"select id, case {_CASES} else 'section' end as kind from (select distinct id, lower(section_name) as n from paper_chunks where section_name is not null)")
def c9_classify_sections(spark, folder):
    return L.chunks(spark, folder, "section is not null").select("id", T.classify_section(F.col("section")).alias("kind"))


@query("select chunk_type, importance::double as importance, count(distinct id)::bigint as n from (select id, chunk_type, case chunk_type " + " ".join(f"when '{k}' then {v}" for k, v in T.IMPORTANCE.items()) + " else 0.5 end as importance from paper_chunks) group by all")
def c10_importance(spark, folder):
    return L.chunks(spark, folder).groupBy("chunk_type", T.importance(F.col("chunk_type")).alias("importance")).agg(F.count("*").alias("n"))


@query("select distinct id, sha256(text_content) as digest from paper_chunks")
def c11_chunk_hash(spark, folder):
    return L.chunks(spark, folder).select("id", K.chunk_hash(F.col("text")).alias("digest"))


_TEXT = "title || chr(10) || coalesce(authors, '') || chr(10) || chr(10) || 'Abstract: ' || coalesce(abstract, '') || chr(10) || chr(10) || coalesce('doi ' || doi, '') || ' ' || coalesce('arXiv:' || arxiv_id, '') || ' published ' || coalesce(year::varchar, '')"
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"""
with t as (select id, {_TEXT} as text from papers)
select id, nullif(regexp_extract(text, '10\\.\\d{{4,}}/\\S+', 0), '') as doi,
  nullif(regexp_extract(text, '(?i)arXiv:(\\d{{4}}\\.\\d{{4,5}})', 1), '') as arxiv_id,
  try_cast(nullif(regexp_extract(text, '\\b(19|20)\\d{{2}}\\b', 0), '') as int) as year from t""")
def f1_identifiers(spark, folder):
    t, x = L.paper_texts(spark, folder), F.col("text")
    return t.select("id", X.doi(x).alias("doi"), X.arxiv_id(x).alias("arxiv_id"), X.year(x).alias("year"))


@query(f"""
with t as (select id, {_TEXT} as text from papers)
select id, coalesce(
  nullif(trim(regexp_replace(regexp_extract(text, '(?m)^([A-Z][^\\n]{{10,200}})\\n', 1), '\\s+', ' ', 'g')), ''),
  nullif(trim(regexp_replace(regexp_extract(text, '(?m)^([^\\n]{{10,200}}?)\\n\\n', 1), '\\s+', ' ', 'g')), '')) as title from t""")
def f4_title(spark, folder):
    return L.paper_texts(spark, folder).select("id", X.title(F.col("text")).alias("title"))


@query("select id, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) as text from papers where abstract is not null")
def f8_clean(spark, folder):
    return L.papers(spark, folder).where("abstract is not null").select("id", T.clean(F.col("abstract")).alias("text"))


def _safe(x: str) -> str:
    y = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[<>:\"/\\\\|?*]', '', 'g'), '\\s+', '_', 'g'), '[^\\p{{L}}\\p{{N}}\\-_.]', '', 'g'), '_+', '_', 'g')"
    return f"coalesce(nullif(substring(regexp_replace({y}, '^[._]+|[._]+$', '', 'g'), 1, 200), ''), 'unnamed')"


_LAST = "list_filter(regexp_split_to_array(trim(string_split({0}, ',')[1]), '\\s+'), lambda w: w <> '')[-1]"


@query("""
with n as (select id, publication || '.pdf' as target, row_number() over (partition by publication order by id) - 1 as n from papers where publication is not null)
select id, case when n = 0 then target else regexp_extract(target, '^(.*?)(\\.[^.]*)?$', 1) || '_' || n || '.pdf' end as target from n""")
def f13_unique_names(spark, folder):
    return unique_targets(L.papers(spark, folder).where("publication is not null").select("id", F.concat("publication", F.lit(".pdf")).alias("target")))


@query("select id, regexp_replace(trim(regexp_replace(lower(trim(arxiv_id)), '^arxiv:', '')), 'v\\d+$', '') as arxiv_id from papers where arxiv_id is not null")
def f15_normal_arxiv(spark, folder):
    return L.papers(spark, folder).where("arxiv_id is not null").select("id", X.normal_arxiv(F.col("arxiv_id")).alias("arxiv_id"))


@query(f"""
with w as (select id, list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9+\\-]+'), lambda w: not list_contains({_list(X.QUERY_STOPWORDS)}, w)) as w from papers),
u as (select id, unnest(w) as t, generate_subscripts(w, 1) as i from w),
d as (select id, t, min(i) as i from u group by all), r as (select *, row_number() over (partition by id order by i) as n from d)
select w.id, coalesce('all:' || string_agg(r.t, '+' order by r.i), 'all:learning') as q from w left join r on r.id = w.id and r.n <= 14 group by w.id""")
def f17_search_query(spark, folder):
    return L.papers(spark, folder).select("id", X.search_query(F.col("title")).alias("q"))


def _any(patterns, x="lower(question)") -> str:
    return f"regexp_matches({x}, '{'|'.join(patterns)}')".replace("what(?:'s|", "what(?:''s|")


_IDS = " || ".join(f"regexp_extract_all(question, '{p}', 1)" for p in I.PAPER_IDS)


@query(f"""
with f as (select id, list_transform({_IDS}, lambda x: try_cast(x as bigint)) as l from notes),
u as (select id, unnest(l) as v, generate_subscripts(l, 1) as i from f), d as (select id, v, min(i) as i from u group by all)
select f.id, coalesce(string_agg(d.v::varchar, ',' order by d.i), '') as ids from f left join d on d.id = f.id and d.v is not null group by f.id""")
def f20_paper_ids(spark, folder):
    return L.notes(spark, folder).select("id", F.array_join(F.transform(I.paper_ids(F.col("question")), lambda x: x.cast("string")), ",").alias("ids"))


_SECTION = "case " + " ".join(f"when regexp_matches(lower(question), '{p}') then '{k}'" for k, p in I.SECTIONS.items()) + " end"


@query(f"""
with q as (select id, question, len(list_distinct({_IDS})) as n, {_SECTION} as s from notes)
select id, case when {_any(I.COMPARISON)} and n >= 2 then 'compare' when {_any(I.SIMILAR)} then 'similar' when {_any(I.LIST_SECTIONS)} then 'list_sections'
  when n = 1 and {_any(I.SUMMARIZE)} then case when s is not null then 'summarize_section' else 'summarize' end else 'qa' end as plan, s as section from q""")
def l9_dispatch(spark, folder):
    q = F.col("question")
    return L.notes(spark, folder).select("id", I.dispatch(q).alias("plan"), I.section_named(q).alias("section"))


@query("""
with c as (select distinct id, unnest(list_distinct(regexp_extract_all(response, '\\[Paper\\s+(\\d+)', 1))) as p from llm_cache)
select id, p::bigint as paper_id from c""")
def f24_cited_ids(spark, folder):
    ids = F.array_distinct(F.regexp_extract_all("response", F.lit(r"\[Paper\s+(\d+)"), F.lit(1)))
    return L.cache(spark, folder).select("id", F.explode(ids).alias("p")).select("id", F.col("p").cast("bigint").alias("paper_id"))


@query("select doc_id, sha256(string_split(text, chr(10) || chr(10))[1]) as digest from documents")
def f27_first_paragraph(spark, folder):
    return L.documents(spark, folder).select("doc_id", F.sha2(X.first_paragraph(F.col("text")), 256).alias("digest"))


_MESSAGE = "'Rate limit reached: requests per ' || case when hit_count > 0 then 'day' else 'minute' end || ', try again in ' || coalesce(tokens_used, 5) || case when provider = 'groq' then 'ms' else '.5s' end"


@query(f"""
with m as (select distinct id, {_MESSAGE} as m from llm_cache),
x as (select id, m, regexp_extract(m, 'try again in (\\d+(?:\\.\\d+)?)(m?s)', 1)::double as v, regexp_extract(m, 'try again in (\\d+(?:\\.\\d+)?)(m?s)', 2) as u from m)
select id, case when contains(m, 'per day') then 'rpd' else 'rpm' end as kind, greatest(1, floor(case when u = 'ms' then v / 1000 else v end)::int + 1)::int as seconds from x""")
def f32_rate_limits(spark, folder):
    m = F.concat(F.lit("Rate limit reached: requests per "), F.when(F.col("hit_count") > 0, "day").otherwise("minute"), F.lit(", try again in "), F.coalesce("tokens_used", F.lit(5)).cast("string"), F.when(F.col("provider") == "groq", "ms").otherwise(".5s"))
    return L.cache(spark, folder).select("id", X.limit_kind(m).alias("kind"), X.retry_seconds(m).alias("seconds"))


@query(f"""
with t as (select id, {_TEXT} as text from papers)
select id, coalesce({", ".join("nullif(trim(regexp_replace(regexp_extract(text, '(?is)" + w + "[:\\s]+(.{50,1000}?.{0,1000}?)(?:\\n\\n|keywords|introduction)', 1), '\\s+', ' ', 'g')), '')" for w in ("abstract", "summary"))}) as abstract from t""")
def f5_abstract(spark, folder):
    """The abstract found on the first page of every paper."""
    return L.paper_texts(spark, folder).select("id", F.nullif(X.abstract(F.col("text")), F.lit("")).alias("abstract"))


_FOUND = "coalesce(nullif(trim(regexp_replace(regexp_extract(text, '(?m)^([A-Z][^\\n]{10,200})\\n', 1), '\\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(text, '(?m)^([^\\n]{10,200}?)\\n\\n', 1), '\\s+', ' ', 'g')), ''))"


@query(f"""
with t as (select id, text, {_FOUND} as title from (select id, {_TEXT} as text from papers)),
n as (select id, regexp_extract_all(substring(text, strpos(text, title) + length(title), greatest(0, 500 - length(title))), '([A-Z][a-z]+\\s+[A-Z][a-z]+)', 1) as n, strpos(text, title) > 0 as known from t)
select id, case when known and len(n) > 0 then array_to_string(n[1:5], ', ') end as authors from n""")
def f6_authors_after_title(spark, folder):
    t = L.paper_texts(spark, folder).select("id", "text", X.title(F.col("text")).alias("title"))
    return t.select("id", X.authors_after(F.col("text"), F.col("title")).alias("authors"))


@query(f"""
with t as (select id, publication, authors, year, doi, {_TEXT} as text from papers)
select id, coalesce(nullif(trim(publication), ''), {_FOUND}) as title, coalesce(nullif(trim(authors), ''), 'none') as authors, coalesce(nullif(trim(doi), ''), nullif(regexp_extract(text, '10\\.\\d{{4,}}/\\S+', 0), '')) as doi from t""")
def f7_merged_metadata(spark, folder):
    """A file's own fields (here the publication as its title), the rest from its text."""
    p = L.papers(spark, folder).select("id", "publication", "authors", "doi").join(L.paper_texts(spark, folder), "id")
    x = F.col("text")
    return p.select("id", X.merged(F.col("publication"), X.title(x)).alias("title"), X.merged(F.col("authors"), F.lit("none")).alias("authors"), X.merged(F.col("doi"), X.doi(x)).alias("doi"))


_FIRST = f"coalesce(nullif({_LAST.format('authors')}, ''), 'unknown')"
_LABEL = f"""case when coalesce(authors, '') = '' then 'unknown' else {_safe("array_to_string(list_transform(list_transform(string_split(authors, ','), lambda a: trim(a))[1:2], lambda a: coalesce(list_filter(regexp_split_to_array(trim(string_split(a, ',')[1]), '\\s+'), lambda w: w <> '')[-1], 'unknown')), '_') || case when len(string_split(authors, ',')) > 2 then '_et_al' else '' end")} end"""
_NAMES = {
    "{year}_{first_author}_{short_title}": f"coalesce(nullif(year::varchar, ''), 'unknown') || '_' || {_FIRST} || '_' || {_safe('substring(title, 1, 50)')}",
    "{authors}-{title}": f"{_LABEL} || '-' || {_safe('title')}",
    "{doi}_{arxiv_id}": f"{_safe('doi')} || '_' || coalesce(nullif(replace(arxiv_id, '.', '_'), ''), 'unknown')",
}


@query(" union all ".join(f"select id, '{k}' as pattern, {v} || '.pdf' as new_name, regexp_extract(file_path, '[^/]+$', 0) as old_name, ({v} || '.pdf') <> regexp_extract(file_path, '[^/]+$', 0) as changed from papers" for k, v in _NAMES.items()))
def f12_rename_preview(spark, folder):
    """What each paper's file would be called by three patterns, and whether it changes."""
    p, old = L.papers(spark, folder), F.regexp_extract("file_path", "[^/]+$", 0)
    name = lambda k: X.file_name(k, year=F.col("year"), authors=F.col("authors"), title=F.col("title"), doi=F.col("doi"), arxiv_id=F.col("arxiv_id"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), name(k).alias("new_name")) for k in _NAMES]))
    return p.select("id", old.alias("old_name"), each.alias("x")).select("id", "x.pattern", "x.new_name", "old_name", (F.col("x.new_name") != F.col("old_name")).alias("changed"))


@query(f"select id, {_LABEL} as label, {_FIRST} as first from papers")
def f11_author_labels(spark, folder):
    a = F.col("authors")
    return L.papers(spark, folder).select("id", X.author_label(a).alias("label"), F.coalesce(X.last_name(a), F.lit("unknown")).alias("first"))


@query("select id, regexp_replace(trim(regexp_replace(lower(trim(regexp_extract('see https://arxiv.org/abs/' || arxiv_id || '?x=1', '(?i)arxiv\\.org/abs/([^?\\s#]+)', 1))), '^arxiv:', '')), 'v\\d+$', '') as external_id from papers where arxiv_id is not null")
def f16_arxiv_from_url(spark, folder):
    url = F.concat(F.lit("see https://arxiv.org/abs/"), "arxiv_id", F.lit("?x=1"))
    return L.papers(spark, folder).where("arxiv_id is not null").select("id", X.arxiv_from_url(url).alias("external_id"))


@query("select id, sha256(question) as prompt_key, sha256(question || chr(10) || '10') as search_key, sha256(array_to_string(list_sort(paper_ids), ',') || ':results') as comparison_key, sha256(array_to_string(list_sort(paper_ids), ',')) as whole_key from notes")
def f18_cache_keys(spark, folder):
    n, ids = L.notes(spark, folder), F.col("paper_ids")
    return n.select("id", F.sha2("question", 256).alias("prompt_key"), X.search_key(F.col("question"), 10).alias("search_key"), X.comparison_key(ids, F.lit("results")).alias("comparison_key"), X.comparison_key(ids).alias("whole_key"))


_REVIEW = X.REVIEW.replace("(?i)", "")
_ASKED = "select id, question from notes union all select id, q || ' paper ' || id || ' and paper 1' from notes, (select unnest(['Compare the methods of', 'What similar papers are there to', 'List the sections of', 'Summarize the findings of', 'Write a review of the conclusions of', 'How does it differ,']) as q)"


def _asked(spark, folder):
    """The notes' questions, and made ones of every kind about each note's number."""
    n = L.notes(spark, folder).select("id", "question")
    kinds = ["Compare the methods of", "What similar papers are there to", "List the sections of", "Summarize the findings of", "Write a review of the conclusions of", "How does it differ,"]
    made = n.select("id", F.explode(F.array(*map(F.lit, kinds))).alias("q")).select("id", F.concat("q", F.lit(" paper "), F.col("id").cast("string"), F.lit(" and paper 1")).alias("question"))
    return n.unionByName(made)


@query(f"with a as ({_ASKED}) select id, question, {_any(I.COMPARISON)} as comparison, {_any(I.SIMILAR)} as similar_papers, {_any(I.LIST_SECTIONS)} as sections, {_any(I.SUMMARIZE)} as summary, regexp_matches(lower(question), '{_REVIEW}') as review from a")
def f19_intents(spark, folder):
    q = F.col("question")
    return _asked(spark, folder).select("id", "question", I.asks(q, I.COMPARISON).alias("comparison"), I.asks(q, I.SIMILAR).alias("similar_papers"), I.asks(q, I.LIST_SECTIONS).alias("sections"), I.asks(q, I.SUMMARIZE).alias("summary"), q.rlike(X.REVIEW).alias("review"))


_NAMED = "case " + " ".join(f"when regexp_matches(lower(question), '{'|'.join(v)}') then '{k}'" for k, v in I.SECTION_FORMS.items()) + " end"


@query(f"with a as ({_ASKED}) select id, question, {_SECTION} as asked, {_NAMED} as compared from a")
def f21_section_names(spark, folder):
    """The section that a question names, as questions and as comparisons read it."""
    q = F.col("question")
    return _asked(spark, folder).select("id", "question", I.section_named(q).alias("asked"), I.section_compared(q).alias("compared"))


@query(f"""with a as ({_ASKED}), i as (select id, question, list_distinct(list_filter(list_transform({_IDS}, lambda x: try_cast(x as bigint)), lambda x: x is not null)) as ids, {_any(I.COMPARISON)} as c, {_NAMED} as s from a),
k as (select u.id, u.question, count(*) as known from (select id, question, unnest(ids) as p from i) u join papers on papers.id = u.p group by all)
select i.id, i.question, case when s is null then 'whole' else 'section' end as kind, len(ids)::int as named, coalesce(known, 0)::int as known from i left join k using (id, question) where c and len(ids) >= 2 and coalesce(known, 0) >= 2""")
def f22_comparison_requests(spark, folder):
    """Questions that ask for a comparison of two papers or more that the library has."""
    known = L.papers(spark, folder).select(F.col("id").alias("paper_id"))
    return I.comparison_requests(_asked(spark, folder), known)


_PROFILE = " || ".join(f"'{f}: ' || {v} || chr(10)" for f, v in zip(X.PROFILE, ("title", "coalesce(publication, '')", "'found in ' || coalesce(year::varchar, 'no year')", "coalesce(authors, '')", "''", "coalesce(substring(abstract, 1, 300), '')"), strict=True))
_ENDS = [*(f"\\s*{f}:" for f in X.PROFILE[1:]), "$"]


@query(f"with t as (select id, {_PROFILE} as t from papers) select id, " + ", ".join(f"regexp_replace(regexp_extract(t, '(?is){f}:\\s*(.*?){e}', 1), '^\\s+|\\s+$', '', 'g') as {f.lower()}" for f, e in zip(X.PROFILE, _ENDS, strict=True)) + " from t")
def f25_profile_fields(spark, folder):
    """The six fields of a profile as a model writes it, made from each paper's columns."""
    no = F.lit("")
    values = ["title", F.coalesce("publication", no), F.concat(F.lit("found in "), F.coalesce(F.col("year").cast("string"), F.lit("no year"))), F.coalesce("authors", no), no, F.coalesce(F.substring("abstract", 1, 300), no)]
    t = F.concat(*[x for f, v in zip(X.PROFILE, values, strict=True) for x in (F.lit(f"{f}: "), v, F.lit("\n"))])
    p = L.papers(spark, folder).select("id", t.alias("t"))
    return p.select("id", *[X.profile_field(F.col("t"), f).alias(f.lower()) for f in X.PROFILE])


@query("select id, case when length(answer) > 100 then substring(answer, 1, 100) || '...' else answer end as preview, len(paper_ids)::int as papers from notes")
def f29_note_preview(spark, folder):
    return L.notes(spark, folder).select("id", X.cut_with_dots(F.col("answer"), 100).alias("preview"), F.size("paper_ids").alias("papers"))


@query()
def c6_hybrid_chunks(spark, folder):
    """Chunks by structure; checked against a fixture in the tests."""
    c = K.hybrid_chunks(L.documents(spark, folder).withColumnRenamed("doc_id", "id"))
    return c.select("id", "chunk_index", "chunk_type", "section", "importance", F.sha2("text", 256).alias("digest"))


@query(f"""
with recursive m as (select id, chr(10) || ({_NOTE}) as t from notes where answer is not null),
b as (select id, unnest(x) as x, generate_subscripts(x, 1) as part from (select id, string_split(regexp_replace(t, '\\n(#{{1,3}}[ \\t]+\\S)', chr(1) || '\\1', 'g'), chr(1)) as x from m)),
p as (select id, part, nullif(trim(regexp_extract(x, '^#{{1,3}}[ \\t]+([^\\n]+)', 1)), '') as name, x from b),
y as (select id, part, name, regexp_replace(case when name is null then x else regexp_replace(regexp_replace(x, '^#{{1,3}}[ \\t]+[^\\n]+\\n?', ''), '(?m)^\\s*[-*]{{3,}}\\s*$', '', 'g') end, '^\\s+|\\s+$', '', 'g') as body from p),
s as (select id, part, name, unnest(q) as s, generate_subscripts(q, 1) as i from (select id, part, name, {sentences_sql('body')} as q from y where body <> '')),
r as (select id, part, i, s, 0 as chunk, length(s) // 4 as n, i as first from s where i = 1
  union all
  select s.id, s.part, s.i, s.s, case when r.n + length(s.s) // 4 > 400 then r.chunk + 1 else r.chunk end,
    case when r.n + length(s.s) // 4 > 400 then length(r.s) // 4 + length(s.s) // 4 else r.n + length(s.s) // 4 end,
    case when r.n + length(s.s) // 4 > 400 then r.i else r.first end
  from r join s on s.id = r.id and s.part = r.part and s.i = r.i + 1),
e as (select id, part, chunk, min(first) as a, max(i) as z from r group by all),
t as (select e.id, e.part, e.chunk, any_value(s.name) as section, string_agg(s.s, ' ' order by s.i) as x from e join s on s.id = e.id and s.part = e.part and s.i between e.a and e.z group by all)
select id, (row_number() over (partition by id order by part, chunk) - 1)::int as chunk_index, section, case when section is null then 'paragraph' else (select case {_CASES} else 'section' end from (select lower(section) as n)) end as chunk_type, sha256(x) as digest from t""")
def c8_markdown_chunks(spark, folder):
    n = L.notes(spark, folder).where("answer is not null")
    text = F.concat(F.coalesce("formatted_note", F.lit("")), F.lit("\n"), "answer", F.lit("\n### Sources\n"), F.array_join(F.coalesce("sources", F.array().cast("array<string>")), " "))
    return K.markdown_chunks(n.select("id", text.alias("text"))).select("id", "chunk_index", "section", "chunk_type", F.sha2("text", 256).alias("digest"))
