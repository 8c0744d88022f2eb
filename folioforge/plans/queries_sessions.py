"""Queries over sessions, caches, notes and limits, on the notes as turns: a session is
what one provider and model answered in one month."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import checks as Q
from folioforge.functions import extract as X
from folioforge.operators import context as C
from folioforge.operators import sessions as S
from folioforge.plans import library as L
from folioforge.plans.queries_retrieval import _C

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_T = "t as (select coalesce(provider, 'none') || '|' || coalesce(model, 'none') || '|' || strftime(created_at, '%Y-%m') as session, created_at as said, id, question, coalesce(paper_ids, []) as paper_ids from notes)"


def turns(spark, folder):
    none = F.lit("none")
    month = F.date_format("created_at", "yyyy-MM")
    return L.notes(spark, folder).select(F.concat_ws("|", F.coalesce("provider", none), F.coalesce("model", none), month).alias("session"), F.col("created_at").alias("at"), "id", "question", F.coalesce("paper_ids", F.array().cast("array<bigint>")).alias("paper_ids"))


@query(f"with {_T}, u as (select distinct session, unnest(paper_ids) as p from t), p as (select session, string_agg(p::varchar, ',' order by p) as papers from u group by all) select session, count(*)::bigint as messages, coalesce(any_value(papers), '') as papers, epoch_us(min(said)) as started_at, epoch_us(max(said)) as last_at from t left join p using (session) group by session")
def a10_session_rollup(spark, folder):
    s = S.roll_up(turns(spark, folder))
    return s.select("session", "messages", F.array_join(F.transform("paper_ids", lambda p: p.cast("string")), ",").alias("papers"), F.unix_micros("started_at").alias("started_at"), F.unix_micros("last_at").alias("last_at"))


@query(f"with {_T} select session, id, turn::int as turn from (select *, row_number() over (partition by session order by said, id) as turn, row_number() over (partition by session order by said desc, id desc) as back from t) where back <= 5")
def w9_last_turns(spark, folder):
    return S.number_turns(turns(spark, folder)).where("back <= 5").select("session", "id", "turn")


@query(f"with {_T} select session, count(*)::bigint as messages from t group by session order by max(said) desc, session desc limit 1")
def w10_latest_session(spark, folder):
    """The session used last: a report of one."""
    return S.latest_session(S.roll_up(turns(spark, folder))).select("session", "messages")


@query(f"""with {_T}, n as (select *, list_filter(list_transform(regexp_extract_all(lower(question), 'paper\\s+(\\d+)', 1), lambda x: try_cast(x as bigint)), lambda x: x is not null) as named from t),
h as (select *, last_value(case when len(named) > 0 then named when len(paper_ids) > 0 then paper_ids end ignore nulls) over (partition by session order by said, id rows between unbounded preceding and 1 preceding) as carried from n)
select id, case when len(named) = 0 and len(carried) > 0 then question || ' ' || array_to_string(list_transform(carried, lambda p: '[' || p || ']'), ' ') else question end as asked from h""")
def l10_carry_over(spark, folder):
    """What is asked in each turn, with the papers in mind where none is named."""
    return S.carry_over(turns(spark, folder)).select("id", "asked")


@query(f"with {_T}, u as (select distinct session, unnest(paper_ids) as p from t) select session, count(*)::bigint as n, sum(p)::bigint as ids from u group by all")
def u5_session_papers(spark, folder):
    return S.roll_up(turns(spark, folder)).where(F.size("paper_ids") > 0).select("session", F.size("paper_ids").cast("bigint").alias("n"), F.aggregate("paper_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"))


_OLD = "timestamp '2023-02-01 00:00:00'"


@query(f"with o as (select *, row_number() over (partition by prompt_hash order by created_at desc, id desc) as n from (select distinct on (id) * from llm_cache)), k as (select * from o where n = 1) select id, epoch_us(created_at + interval 30 day) as expires_at, (created_at + interval 30 day < {_OLD}) as gone from k")
def m11_cache_lives(spark, folder):
    """The last entry of each prompt, when it expires and whether it has."""
    from folioforge.operators.maintain import latest

    k = latest(L.cache(spark, folder), ["prompt_hash"], ["created_at", "id"])
    until = S.expires(F.col("created_at"), S.LIVES["response"])
    return k.select("id", F.unix_micros(until).alias("expires_at"), (until < F.expr(_OLD)).alias("gone"))


@query("select n.id from notes n where not exists (select 1 from papers p where p.content_version > coalesce(p.last_embedded_version, 0) and list_contains(n.paper_ids, p.id))")
def m12_drop_changed(spark, folder):
    """Notes, as cached comparisons, of which no paper has changed since."""
    changed = L.papers(spark, folder).where(F.col("content_version") > F.coalesce("last_embedded_version", F.lit(0))).select(F.col("id").alias("paper_id"))
    return S.drop_containing(L.notes(spark, folder), changed).select("id")


@query("select n.id, n.provider from (select id, provider, row_number() over (partition by question order by created_at desc, id desc) as r from notes) n where r = 1")
def m15_notes_upsert(spark, folder):
    """Notes kept once for each question: later ones take the place of earlier ones."""
    from folioforge.operators.maintain import latest

    return latest(L.notes(spark, folder), ["question"], ["created_at", "id"]).select("id", "provider")


@query(f"with {_C}, f as (select paper_id, max(content_version) as v from (select distinct on (id) id, paper_id, content_version from paper_chunks) group by all) select p.id from papers p left join f on f.paper_id = p.id where f.v is null or f.v < p.content_version")
def j15_lacking_profile(spark, folder):
    """Papers of which nothing was cut from their present version."""
    fresh = L.chunks(spark, folder).groupBy("paper_id").agg(F.max("content_version").alias("v"))
    p = L.papers(spark, folder).join(fresh, F.col("id") == F.col("paper_id"), "left")
    return p.where(F.col("v").isNull() | (F.col("v") < F.col("content_version"))).select("id")


@query("select distinct id, epoch_us(date_trunc('day', created_at) + interval 1 day) as midnight from llm_cache")
def f33_next_midnight(spark, folder):
    return L.cache(spark, folder).select("id", F.unix_micros(S.next_midnight(F.col("created_at"))).alias("midnight"))


@query("""with c as (select distinct on (id) id, created_at as now, date_trunc('day', created_at) + interval 1 day as day, created_at + to_seconds(hit_count) as minute, hit_count from llm_cache),
x as (select *, epoch(day)::bigint - floor(epoch(now))::bigint as d, floor(epoch(minute))::bigint - floor(epoch(now))::bigint as m from c)
select id, case when hit_count % 3 = 0 then 'Daily limit — resets in ' || (d // 3600) || 'h ' || (d % 3600 // 60) || 'm' when now < minute then 'RPM cooldown — ' || m || 's' else 'Available' end as shown from x""")
def f33_cooldown(spark, folder):
    """A model blocked for the day at every third hit count, else for as many seconds as hits."""
    now = F.col("created_at")
    day = F.when(F.col("hit_count") % 3 == 0, S.next_midnight(now))
    return L.cache(spark, folder).select("id", S.cooldown(now, day, now + F.make_dt_interval(secs=F.col("hit_count"))).alias("shown"))


@query("select distinct id, epoch_us(created_at + interval 30 day) as answer_until, epoch_us(created_at + interval 1 day) as search_until from llm_cache")
def f34_lives(spark, folder):
    until = lambda k: F.unix_micros(S.expires(F.col("created_at"), S.LIVES[k]))
    return L.cache(spark, folder).select("id", until("response").alias("answer_until"), until("search").alias("search_until"))


@query("""select id, (length(trim(question, ' ' || chr(9) || chr(10) || chr(13))) > 0 and length(trim(coalesce(answer, ''), ' ' || chr(9) || chr(10) || chr(13))) > 0 and length(question) <= 10000 and length(answer) <= 50000 and len(paper_ids) > 0
  and strlen(coalesce(formatted_note, '')) <= 5242880) as sound from notes""")
def f30_note_checks(spark, folder):
    n = L.notes(spark, folder)
    return n.select("id", F.coalesce(Q.note_is_sound(F.col("question"), F.col("answer"), F.col("paper_ids"), F.col("formatted_note")), F.lit(False)).alias("sound"))


@query("""with d as (select id, case when sources is null then coalesce(provider, '') else to_json(sources)::varchar end as stored from notes)
select id, stored, json_valid(stored) as is_json from d""")
def f31_config_codec(spark, folder):
    """Values of settings as they are stored: lists as JSON, text as it is; read back by
    what parses."""
    stored = F.when(F.col("sources").isNull(), F.coalesce("provider", F.lit(""))).otherwise(F.to_json("sources"))
    return L.notes(spark, folder).select("id", stored.alias("stored"), Q.is_json(stored).alias("is_json"))


@query("select doc_id, regexp_extract(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', 0) as email from documents where regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') union all select id, regexp_extract(e, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', 0) from (select id, 'write to ' || lower(regexp_replace(regexp_extract(title, '^\\S+', 0), '[^A-Za-z]', '', 'g')) || '@example.org.' as e from papers)")
def f9_emails(spark, folder):
    """Addresses in documents, and in a line made of each paper's first word."""
    made = F.concat(F.lit("write to "), F.lower(F.regexp_replace(F.regexp_extract("title", r"^\S+", 0), "[^A-Za-z]", "")), F.lit("@example.org."))
    both = L.documents(spark, folder).union(L.papers(spark, folder).select("id", made))
    return both.select("doc_id", X.email(F.col("text")).alias("email")).where("email is not null")


@query("""with t as (select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, '(?i)\\b(literature\\s+review|lit\\s+review|write\\s+a\\s+review|review\\s+(the\\s+)?literature|systematic\\s+review)\\b', '', 'g'), '(?i)\\b(on|about|for|of|the)\\b', '', 'g'), '(?i)\\bpapers?\\s+\\d+(?:[,\\s]+\\d+)*', '', 'g'), '\\s+', ' ', 'g'), ' .,?') as t from notes)
select id, case when t = '' then 'Research Library' else t end as topic from t""")
def f36_topics(spark, folder):
    return L.notes(spark, folder).select("id", X.topic(F.col("question")).alias("topic"))


@query(f"""with {_C}, k as (select c.paper_id, c.text, row_number() over (partition by c.paper_id order by importance desc nulls last, id) as r from c where valid and chunk_type in ('abstract', 'introduction') and text is not null),
j as (select paper_id, string_agg(text, ' ' order by r) as t from k where r <= 2 group by all)
select p.id as paper_id, sha256(coalesce(nullif(regexp_replace(p.abstract, '^\\s+|\\s+$', '', 'g'), ''), substring(j.t, 1, 1200), 'Abstract not available.')) as digest from papers p left join j on j.paper_id = p.id""")
def l7_abstracts(spark, folder):
    """The abstract of each paper, or what stands in for it."""
    return C.abstracts(L.papers(spark, folder), L.chunks(spark, folder, valid=True)).select("paper_id", F.sha2("abstract", 256).alias("digest"))


_A = _C + """, k as (select c.paper_id, c.text, row_number() over (partition by c.paper_id order by importance desc nulls last, id) as r from c where valid and chunk_type in ('abstract', 'introduction') and text is not null),
j as (select paper_id, string_agg(text, ' ' order by r) as t from k where r <= 2 group by all),
a as (select p.id as paper_id, coalesce(nullif(title, ''), 'Untitled') as title, coalesce(nullif(authors, ''), 'Unknown') as authors, coalesce(year::varchar, 'N/A') as year, coalesce(nullif(regexp_replace(p.abstract, '^\\s+|\\s+$', '', 'g'), ''), substring(j.t, 1, 1200), 'Abstract not available.') as summary from papers p left join j on j.paper_id = p.id)"""


@query(f"""with {_A}, u as (select distinct id, unnest(paper_ids) as paper_id from notes)
select u.id, sha256(string_agg('[Paper ' || a.paper_id || '] ' || title || ' — ' || authors || ' (' || year || ')' || chr(10) || summary, chr(10) || chr(10) order by a.paper_id)) as digest, count(*)::bigint as papers from u join a using (paper_id) group by u.id""")
def f43_summaries(spark, folder):
    """The summaries of the papers of each note, as one block."""
    fill = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v))
    p = L.papers(spark, folder)
    s = C.abstracts(p, L.chunks(spark, folder, valid=True)).join(p.select(F.col("id").alias("paper_id"), fill("title", "Untitled").alias("title"), fill("authors", "Unknown").alias("authors"), F.coalesce(F.col("year").cast("string"), F.lit("N/A")).alias("year")), "paper_id")
    entry = C.summary_entry(F.col("paper_id"), F.col("title"), F.col("authors"), F.col("year"), F.col("abstract"))
    u = L.notes(spark, folder).select("id", F.explode("paper_ids").alias("paper_id")).distinct()
    g = u.join(s.select("paper_id", entry.alias("e")), "paper_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("paper_id", "e"))).alias("x"))
    return g.select("id", F.sha2(F.array_join(F.transform("x", lambda y: y["e"]), "\n\n"), 256).alias("digest"), F.size("x").cast("bigint").alias("papers"))


@query("select id, '- ' || coalesce(nullif(provider, ''), 'none') || ': ' || case when length(answer) > 150 then substring(answer, 1, 150) || '...' else answer end as line from notes where answer is not null")
def f28_section_digest(spark, folder):
    return L.notes(spark, folder).where("answer is not null").select("id", C.digest_line(F.coalesce(F.nullif("provider", F.lit("")), F.lit("none")), F.col("answer")).alias("line"))


@query("select id, '- Library id ' || id || ': ' || title || ' (' || year || ') | authors: ' || authors || ' | doi: ' || coalesce(nullif(doi, ''), 'N/A') || ' | arxiv: ' || coalesce(nullif(arxiv_id, ''), 'N/A') as line from papers")
def f38_candidate_lines(spark, folder):
    p = L.papers(spark, folder)
    return p.select("id", C.candidate_line({c: F.col(c) for c in ("id", "title", "year", "authors", "doi", "arxiv_id")}).alias("line"))


@query(f"with {_C}, f as (select id, abstract from papers), g as (select paper_id, min_by(text, (chunk_index, id)) as t from c where valid and text is not null group by all) select id, sha256(case when length(abstract) > 100 then abstract else coalesce(nullif(substring(t, 1, 2000), ''), '(No text available.)') end) as digest from f left join g on g.paper_id = f.id")
def pr16_reading_text(spark, folder):
    """The abstract of each paper if it says enough, else how its first chunk begins."""
    t = L.chunks(spark, folder, "text is not null", valid=True).groupBy("paper_id").agg(F.min_by("text", F.struct("chunk_index", "id")).alias("t"))
    p = L.papers(spark, folder).join(t, F.col("id") == F.col("paper_id"), "left")
    return p.select("id", F.sha2(C.reading_text(F.col("abstract"), F.col("t")), 256).alias("digest"))


@query("""with b as (select id, question || chr(10) || '---' || chr(10) || case when id % 2 = 0 then 'THEME: ' || coalesce(provider, 'none') || chr(10) || 'DESCRIPTION: ' || coalesce(model, '') || chr(10) || 'PAPERS: ' || array_to_string(paper_ids, ', ') || ', 999999999' else '' end as raw, paper_ids, provider, model from notes)
select id, case when id % 2 = 0 then coalesce(provider, 'none') else 'Overview of the Literature' end as theme, unnest(list_distinct(paper_ids)) as paper_id from b""")
def j12_themes_or_all(spark, folder):
    """The themes of each answer with their papers; one theme of all papers where none is
    found (answers with odd ids are written without any)."""
    n = L.notes(spark, folder)
    block = F.concat(F.lit("THEME: "), F.coalesce("provider", F.lit("none")), F.lit("\nDESCRIPTION: "), F.coalesce("model", F.lit("")), F.lit("\nPAPERS: "), F.array_join(F.transform("paper_ids", lambda p: p.cast("string")), ", "), F.lit(", 999999999"))
    raw = F.concat("question", F.lit("\n---\n"), F.when(F.col("id") % 2 == 0, block).otherwise(""))
    known = n.select("id", F.explode("paper_ids").alias("paper_id")).distinct()
    return X.themes_or_all(n.select("id", raw.alias("text")), known).select("id", "theme", "paper_id")


@query("""with k as (select id, paper_ids[1] as paper_id, created_at from notes where len(paper_ids) > 0)
select paper_id, id from (select *, row_number() over (partition by paper_id order by created_at desc, id desc) as r from k) where r = 1""")
def m13_profile_upsert(spark, folder):
    """What is kept of each note's first paper when notes since a day are put over older ones."""
    from folioforge.operators.maintain import latest

    n = L.notes(spark, folder).where(F.size("paper_ids") > 0).select("id", F.element_at("paper_ids", 1).alias("paper_id"), "created_at")
    since = F.col("created_at") >= F.expr(_OLD)
    old, new = (latest(d, ["paper_id"], ["created_at", "id"]) for d in (n.where(~since), n.where(since)))
    return S.put(old, new, "paper_id").select("paper_id", "id")
