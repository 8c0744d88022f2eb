"""Queries that keep the library: scans, changes, merges, caches, statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import extract as X
from folioforge.operators import ingest as I
from folioforge.operators import maintain as M
from folioforge.plans import library as L
from folioforge.sources.tables import table
from folioforge.streaming.watch import debounce

QUERIES, SQL = {}, {}
NOW = "timestamp '2023-02-01 00:00:00'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_C = "c as (select distinct on (id) * from paper_chunks)"


@query(f"with {_C} select chunk_hash as file_hash, count(*)::bigint as n, min(paper_id || '/' || chunk_index) as first_path from c where chunk_hash is not null group by all having count(*) > 1")
def s4_duplicate_groups(spark, folder):
    c = L.chunks(spark, folder)
    return M.duplicate_groups(c.select(F.col("chunk_hash").alias("file_hash"), F.concat(F.col("paper_id").cast("string"), F.lit("/"), F.col("chunk_index").cast("string")).alias("path")))


@query(f"with {_C} select sha256(text_content) as file_hash, min(id::varchar) as path from c where text_content is not null and sha256(text_content) not in (select chunk_hash from c where chunk_hash is not null and is_valid) group by all")
def j1_new_files(spark, folder):
    c = L.chunks(spark, folder)
    scanned = c.where("text is not null").select(F.sha2("text", 256).alias("file_hash"), F.col("id").cast("string").alias("path"))
    return M.new_files(scanned, c.where("valid and chunk_hash is not null").select(F.col("chunk_hash").alias("file_hash")))


@query("select id, file_path from papers where id not in (select paper_id from paper_chunks where paper_id is not null)")
def pr13_missing_files(spark, folder):
    here = table(spark, folder, "paper_chunks", "paper_id").where("paper_id is not null").select(F.col("paper_id").alias("id")).distinct()
    files = L.papers(spark, folder).join(here, "id", "left_semi").select(F.col("file_path").alias("path"))
    return M.missing_files(L.papers(spark, folder).select("id", "file_path"), files)


@query("select id, embedding_status from papers where embedding_status in ('pending', 'failed') or embedding_status is null")
def pr8_needs_embedding(spark, folder):
    return L.papers(spark, folder).where(M.needs_embedding()).select("id", "embedding_status")


@query("select id from papers where embedding_status in ('pending', 'failed') or embedding_status is null or last_embedded_version is null or content_version > last_embedded_version")
def pr9_needs_update(spark, folder):
    return L.papers(spark, folder).where(M.needs_update()).select("id")


@query("select id, title, year, epoch_us(indexed_at) as indexed_at from papers where id in (1, 2, 3, 5, 8, 13, 999999999)")
def pr2_papers_by_ids(spark, folder):
    return L.papers(spark, folder).where(F.col("id").isin(1, 2, 3, 5, 8, 13, 999999999)).select("id", "title", "year", F.unix_micros("indexed_at").alias("indexed_at"))


@query("select id, epoch_us(created_at) as created_at from (select id, created_at from notes order by created_at desc, id limit 20)")
def t2_list_notes(spark, folder):
    return L.notes(spark, folder).orderBy(F.desc("created_at"), "id").limit(20).select("id", F.unix_micros("created_at").alias("created_at"))


@query("select id, coalesce(nullif(title, ''), 'Untitled') as title, coalesce(nullif(authors, ''), 'Unknown') as authors, coalesce(nullif(year, 0)::varchar, 'N/A') as year, round(file_size / 1048576.0, 2) as mb from papers")
def pr15_display(spark, folder):
    fill = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    year = F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("N/A")).alias("year")
    return L.papers(spark, folder).select("id", fill("title", "Untitled"), fill("authors", "Unknown"), year, F.round(F.col("file_size") / 1048576.0, 2).alias("mb"))


@query(f"""with {_C} select p.id, count(c.id)::bigint as chunks, (count(c.id) filter (where is_valid))::bigint as valid_chunks, any_value(coalesce(p.content_version, 1) > coalesce(p.last_embedded_version, 0)) as needs_update
  from papers p left join c on c.paper_id = p.id group by p.id""")
def a2_embedding_stats(spark, folder):
    n = L.chunks(spark, folder).groupBy("paper_id").agg(F.count("*").alias("chunks"), F.count_if("valid").alias("valid_chunks"))
    zero = F.lit(0).cast("bigint")
    p = L.papers(spark, folder).join(n, F.col("id") == F.col("paper_id"), "left")
    return p.select("id", F.coalesce("chunks", zero).alias("chunks"), F.coalesce("valid_chunks", zero).alias("valid_chunks"), (F.coalesce("content_version", F.lit(1)) > F.coalesce("last_embedded_version", F.lit(0))).alias("needs_update"))


@query("select distinct regexp_replace(trim(regexp_replace(lower(trim(arxiv_id)), '^arxiv:', '')), 'v\\d+$', '') as key from papers where arxiv_id is not null union select distinct lower(trim(doi)) from papers where doi is not null")
def a5_known_identifiers(spark, folder):
    p = L.papers(spark, folder)
    return p.where("arxiv_id is not null").select(X.normal_arxiv(F.col("arxiv_id")).alias("key")).union(p.where("doi is not null").select(F.lower(F.trim("doi")))).distinct()





@query("""select p.id, case when c.paper_id is null then 'new' when p.content_hash is null or p.content_hash <> p.file_hash and p.content_version > coalesce(p.last_embedded_version, 0) then 'changed'
  when c.n > 1 then 'model_upgrade' else 'no_change' end as change
from papers p left join (select paper_id, count(distinct model_name) as n from paper_chunks group by all) c on c.paper_id = p.id""")
def m5_detect_changes(spark, folder):
    c = table(spark, folder, "paper_chunks", "paper_id", "model_name").groupBy("paper_id").agg(F.count_distinct("model_name").alias("n"))
    p = L.papers(spark, folder).join(c, F.col("id") == F.col("paper_id"), "left")
    # content counts as cut anew where its version is ahead of the embedded one
    fresh = F.when(F.col("content_version") > F.coalesce("last_embedded_version", F.lit(0)), F.col("file_hash")).otherwise(F.col("content_hash"))
    known = F.col("paper_id").isNotNull()
    return p.select("id", M.change_class(F.col("content_hash"), fresh, known, F.col("n") <= 1, F.lit(False)).alias("change"))


@query(f"""with {_C},
a as (select paper_id, chunk_index, chunk_hash, row_number() over (partition by paper_id, chunk_hash order by chunk_index) as o from c where is_valid and chunk_hash is not null),
b as (select paper_id, chunk_index, sha256(text_content) as chunk_hash, row_number() over (partition by paper_id, sha256(text_content) order by chunk_index) as o from c where text_content is not null),
t as (select * from a where paper_id in (select paper_id from b))
select coalesce(b.paper_id, t.paper_id) as paper_id, coalesce(b.chunk_index, t.chunk_index) as chunk_index, coalesce(b.chunk_hash, t.chunk_hash) as chunk_hash,
  case when b.paper_id is null then 'orphaned' when t.paper_id is null then 'new' else 'reused' end as state
from b full outer join t on t.paper_id = b.paper_id and t.chunk_hash = b.chunk_hash and t.o = b.o""")
def m6_incremental_merge(spark, folder):
    c = L.chunks(spark, folder)
    live = c.where("valid").select("paper_id", "chunk_index", "chunk_hash")
    return M.merge_chunks(live, c.where("text is not null").select("paper_id", "chunk_index", F.sha2("text", 256).alias("chunk_hash")))


@query(f"with {_C} select id from c where is_valid or created_at >= {NOW}")
def m8_purge_invalid(spark, folder):
    return L.chunks(spark, folder).where(F.col("valid") | (F.col("created_at") >= F.expr(NOW))).select("id")


@query(f"with {_C} select id, coalesce(chunk_hash, sha256(text_content)) as chunk_hash from c")
def m18_hash_backfill(spark, folder):
    return L.chunks(spark, folder).select("id", F.coalesce("chunk_hash", F.sha2("text", 256)).alias("chunk_hash"))


@query(f"select distinct id, prompt_hash from llm_cache where expires_at is null or expires_at >= {NOW}")
def pr11_live_cache(spark, folder):
    return M.live_cache(L.cache(spark, folder), F.expr(NOW)).select("id", "prompt_hash")


@query("select id, prompt_hash, hits from (select id, prompt_hash, hit_count + 1 as hits, row_number() over (partition by prompt_hash order by created_at desc, id desc) as n from (select distinct * from llm_cache)) where n = 1")
def m10_cache_upsert(spark, folder):
    return M.latest(L.cache(spark, folder), ["prompt_hash"], ["created_at", "id"]).select("id", "prompt_hash", (F.col("hit_count") + 1).alias("hits"))


@query("select n.id from notes n where list_contains(n.paper_ids, 1) or list_contains(n.paper_ids, 10)")
def j13_by_member(spark, folder):
    return L.notes(spark, folder).where(F.arrays_overlap("paper_ids", F.array(F.lit(1).cast("bigint"), F.lit(10).cast("bigint")))).select("id")


@query(f"with {_C} select id from c where paper_id not in (select id from papers where year < 2000)")
def m3_cascade_delete(spark, folder):
    old = L.papers(spark, folder).where("year < 2000")
    return M.delete_with_children(old, L.papers(spark, folder), chunks=L.chunks(spark, folder))["chunks"].select("id")


@query("""with recursive e as (select user_id as key, ts, event_id as id, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null),
k as (select key, n, id, ts, ts as last, true as kept from e where n = 1
  union all select e.key, e.n, e.id, e.ts, case when e.ts - k.last >= interval 6 hour then e.ts else k.last end, e.ts - k.last >= interval 6 hour from k join e on e.key = k.key and e.n = k.n + 1)
select key, id, epoch_us(ts) as at from k where kept""")
def st2_debounce(spark, folder):
    """Events kept when those within six hours of the last kept one are dropped."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    return debounce(e, 6 * 3600.0).select("key", "id", F.unix_micros("ts").alias("at"))


@query("""
with n as (select id, paper_ids, list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\\[Paper\\s+(\\d+)', 1), lambda x: x::bigint)), lambda x: list_contains(paper_ids, x)) as c from notes)
select distinct id, unnest(case when len(c) > 0 then c else paper_ids end) as paper_id from n""")
def j14_cited_in_context(spark, folder):
    """The papers of a note that its answer cites; all of them if it cites none."""
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[Paper\s+(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))
    hit = F.array_intersect(F.coalesce(cited, F.array().cast("array<bigint>")), F.col("paper_ids"))
    return L.notes(spark, folder).select("id", F.explode(F.array_distinct(F.when(F.size(hit) > 0, hit).otherwise(F.col("paper_ids")))).alias("paper_id"))


@query(f"with {_C} select c.id from c left join papers p on p.id = c.paper_id where p.id is null or p.content_version is null or c.content_version >= p.content_version")
def pr12_fresh_chunks(spark, folder):
    """Chunks cut from the paper's present version, or from a paper no longer known."""
    p = L.papers(spark, folder).select(F.col("id").alias("paper_id"), F.col("content_version").alias("now"))
    return L.chunks(spark, folder).join(p, "paper_id", "left").where(F.col("now").isNull() | (F.col("content_version") >= F.col("now"))).select("id")


@query("select n.id, p.id as paper_id, '[Paper ' || p.id || '] ' || p.title || ' (' || coalesce(p.year::varchar, 'N/A') || ')' as line from (select id, unnest(paper_ids) as q from notes) n join papers p on p.id = n.q")
def j12_summary_lines(spark, folder):
    """A line for each paper of each note."""
    n = L.notes(spark, folder).select("id", F.explode("paper_ids").alias("paper_id"))
    p = L.papers(spark, folder).select(F.col("id").alias("paper_id"), F.concat(F.lit("[Paper "), F.col("id").cast("string"), F.lit("] "), "title", F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("N/A")), F.lit(")")).alias("line"))
    return n.join(p, "paper_id").select("id", "paper_id", "line")


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def v5_cosine(spark, folder):
    """The similarity of each vector to the next."""
    from folioforge.operators.vectors import cosine

    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", cosine("embedding", "other").alias("similarity"))


@query("""
with t as (select id, 'THEME: ' || title || chr(10) || 'DESCRIPTION: ' || coalesce(publication, 'none') || chr(10) || 'PAPERS: ' || id || ', 999999999' as b from papers)
select id, trim(regexp_extract(b, 'THEME:\\s*(.+)', 1)) as theme, trim(regexp_extract(b, 'DESCRIPTION:\\s*(.+)', 1)) as description, id as paper_id from t""")
def f26_themes(spark, folder):
    """Theme blocks as a model writes them, read back; unknown papers are left out."""
    block = F.concat(F.lit("THEME: "), "title", F.lit("\nDESCRIPTION: "), F.coalesce("publication", F.lit("none")), F.lit("\nPAPERS: "), F.col("id").cast("string"), F.lit(", 999999999"))
    p = L.papers(spark, folder)
    themes = X.themes(p.select("id", block.alias("text")))
    return themes.join(p.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").select("id", "theme", "description", "paper_id")


@query(f"""with {_C} select (select count(*) from papers)::bigint as papers, (select count(*) from papers where embedding_status = 'completed')::bigint as completed,
  (select count(*) from papers where embedding_status = 'pending' or embedding_status is null)::bigint as pending, (select count(*) from papers where embedding_status = 'failed')::bigint as failed,
  (select count(*) from papers where content_version > last_embedded_version)::bigint as outdated,
  count(*)::bigint as chunks, count(*) filter (where is_valid)::bigint as valid_chunks, count(*) filter (where not coalesce(is_valid, false))::bigint as invalid_chunks,
  round(100.0 * (select count(*) from papers where embedding_status = 'completed') / nullif((select count(*) from papers), 0), 2)::double as coverage_pct from c""")
def a1_coverage(spark, folder):
    return M.coverage(L.papers(spark, folder), L.chunks(spark, folder))


_SORT = {"indexed_at": "indexed_at desc nulls last", "year": "year desc nulls last", "title": "title asc nulls first"}


@query(" union all ".join(f"(select '{k}' as sorted_by, id from papers order by {o}, id limit 50 offset 100)" for k, o in _SORT.items()))
def t1_paginate(spark, folder):
    """The third page of 50 papers in each of the three orders."""
    pages = [M.page(L.papers(spark, folder), by, 50, 100).select(F.lit(by).alias("sorted_by"), "id") for by in _SORT]
    return pages[0].union(pages[1]).union(pages[2])


_STAGES = """f as (select id, file_path as path, file_hash, title, abstract, row_number() over (partition by file_hash order by file_path, id) as n from papers),
m as (select id, path, case when n > 1 then 'duplicate' when regexp_replace(coalesce(abstract, ''), '^\\s+|\\s+$', '', 'g') = '' then 'failed' when length(regexp_replace(abstract, '^\\s+|\\s+$', '', 'g')) < 100 then 'stored' else 'embedded' end as outcome,
  case when n > 1 then 'dedup' when regexp_replace(coalesce(abstract, ''), '^\\s+|\\s+$', '', 'g') = '' then 'extract' when length(regexp_replace(abstract, '^\\s+|\\s+$', '', 'g')) < 100 then 'insert' else 'embed' end as stage from f)"""


def _processed(spark, folder):
    """The papers' files as a folder is processed, their abstracts being what parsers read."""
    p = L.papers(spark, folder).select("id", F.col("file_path").alias("path"), "file_hash", F.col("abstract").alias("text"))
    return I.process(p)


@query(f"with {_STAGES} select id, outcome, stage from m")
def m22_process_files(spark, folder):
    return _processed(spark, folder).select("id", "outcome", "stage")


@query(f"with {_STAGES} select count(*)::bigint as files, count(*) filter (where outcome in ('stored', 'embedded'))::bigint as success, count(*) filter (where outcome = 'duplicate')::bigint as duplicate, count(*) filter (where outcome = 'failed')::bigint as failed, count(*) filter (where outcome = 'embedded')::bigint as embedded from m")
def a8_run_totals(spark, folder):
    return I.run_totals(_processed(spark, folder))


@query(f"with {_STAGES} select path, stage, 'no text' as error from m where outcome = 'failed'")
def m23_run_errors(spark, folder):
    return _processed(spark, folder).where("outcome = 'failed'").select("path", "stage", "error")


_MERGED = f"""{_C},
a as (select paper_id, chunk_index, chunk_hash, text_content, row_number() over (partition by paper_id, chunk_hash order by chunk_index) as o from c where is_valid and chunk_hash is not null),
b as (select paper_id, chunk_index, sha256(text_content) as chunk_hash, text_content, row_number() over (partition by paper_id, sha256(text_content) order by chunk_index) as o from c where text_content is not null),
t as (select * from a where paper_id in (select paper_id from b)),
g as (select coalesce(b.paper_id, t.paper_id) as paper_id, coalesce(b.chunk_index, t.chunk_index) as chunk_index, case when b.paper_id is null then 'orphaned' when t.paper_id is null then 'new' else 'reused' end as state,
  case when b.paper_id is null then t.text_content when t.paper_id is null then substring(b.text_content, 1, 1000) else t.text_content end as text from b full outer join t on t.paper_id = b.paper_id and t.chunk_hash = b.chunk_hash and t.o = b.o),
w as (select g.*, coalesce(p.content_version, 1) as v from g left join papers p on p.id = g.paper_id)"""


def _merged(spark, folder):
    c = L.chunks(spark, folder)
    live = c.where("valid").select("paper_id", "chunk_index", "chunk_hash", "text", "vec")
    fresh = c.where("text is not null").select("paper_id", "chunk_index", "text")
    return I.merge_chunks_in_full(live, fresh, L.papers(spark, folder))


@query(f"with {_MERGED} select paper_id, chunk_index, state, sha256(text) as digest, (state <> 'orphaned') as valid, (v + (state <> 'orphaned')::int)::int as version from w")
def m6_merged_chunks(spark, folder):
    m = _merged(spark, folder)
    return m.select("paper_id", "chunk_index", "state", F.sha2("text", 256).alias("digest"), "valid", "version")


@query(f"with {_MERGED} select count(*) filter (where state = 'reused')::bigint as reused, count(*) filter (where state = 'new')::bigint as new, count(*) filter (where state = 'orphaned')::bigint as orphaned, round(100.0 * count(*) filter (where state = 'reused') / nullif(count(*) filter (where state <> 'orphaned'), 0), 2)::double as reuse_pct from w")
def a9_embed_totals(spark, folder):
    return I.reuse_totals(_merged(spark, folder))


@query("select id, (coalesce(content_version, 1) + (coalesce(content_version, 1) <= coalesce(last_embedded_version, 0))::int)::int as content_version, (content_version > coalesce(last_embedded_version, 0)) as outdated from papers")
def m9_versions(spark, folder):
    """Versions where every paper already embedded in its present one was cut anew."""
    done = F.coalesce("last_embedded_version", F.lit(0))
    p = L.papers(spark, folder).withColumn("outdated", F.col("content_version") > done)
    return I.next_versions(p, p.where(F.coalesce("content_version", F.lit(1)) <= done).select("id")).select("id", "content_version", "outdated")


@query("select id, coalesce(nullif(publication, ''), title) as title, coalesce(year, 0) as year from papers")
def m2_update(spark, folder):
    """Fields set by id; a field that is not given stays."""
    p = L.papers(spark, folder)
    new = p.select("id", F.nullif("publication", F.lit("")).alias("title"))
    return M.update(p.select("id", "title", F.coalesce("year", F.lit(0)).alias("year")), new)


@query("with c as (select distinct on (id) * from citations) select paper_id, count(*)::bigint as citations, count(cited_year)::bigint as dated, sum(1.0)::double as confidence from c where cited_title is not null group by all")
def m21_insert_citations(spark, folder):
    """Citations appended with confidence 1, counted for each paper."""
    c = table(spark, folder, "citations").dropDuplicates(["id"]).where("cited_title is not null")
    rows = I.citations(c.select("paper_id", F.col("cited_title").alias("title"), F.col("cited_authors").alias("authors"), F.col("cited_year").alias("year"), F.col("citation_context").alias("context")))
    return rows.groupBy("paper_id").agg(F.count("*").alias("citations"), F.count("year").alias("dated"), F.sum("confidence").alias("confidence"))


_X = """x as (select id, case when arxiv_id is null then null else 'arXiv:' || regexp_replace(arxiv_id, 'v\\d+$', '') || 'v9' end as arxiv_id, upper(doi) as doi, title from papers where embedding_status is distinct from 'completed' or arxiv_id is null),
l as (select * from papers where embedding_status = 'completed')"""
_NORMAL = "regexp_replace(trim(regexp_replace(lower(trim({0})), '^arxiv:', '')), 'v\\d+$', '')"


@query(f"with {_X} select id from x where (x.arxiv_id is null or {_NORMAL.format('x.arxiv_id')} not in (select {_NORMAL.format('arxiv_id')} from l where arxiv_id is not null)) and (x.doi is null or lower(trim(x.doi)) not in (select lower(trim(doi)) from l where doi is not null))")
def j9_external_new(spark, folder):
    """Of records as they come from outside, with another version and upper-case DOIs,
    those that the embedded library does not hold by either identifier."""
    p = L.papers(spark, folder)
    outside = p.where(~F.col("embedding_status").eqNullSafe("completed") | F.col("arxiv_id").isNull())
    shown = F.concat(F.lit("arXiv:"), F.regexp_replace("arxiv_id", r"v\d+$", ""), F.lit("v9"))
    return M.not_in_library(outside.select("id", shown.alias("arxiv_id"), F.upper("doi").alias("doi")), p.where("embedding_status = 'completed'")).select("id")


@query("select id, case when length(title) > 50 then substring(title, 1, 50) || '...' else title end as title, case when length(authors) > 30 then substring(authors, 1, 30) || '...' else authors end as authors, right(file_path, 50) as path from papers")
def pr17_display_cuts(spark, folder):
    return L.papers(spark, folder).select("id", X.cut_with_dots(F.col("title"), 50).alias("title"), X.cut_with_dots(F.col("authors"), 30).alias("authors"), F.right("file_path", F.lit(50)).alias("path"))


@query("select id, title from papers where file_hash = (select min(file_hash) from papers) or id = 1")
def pr1_point_lookup(spark, folder):
    p = L.papers(spark, folder)
    return p.join(F.broadcast(p.agg(F.min("file_hash").alias("least"))), (F.col("file_hash") == F.col("least")) | (F.col("id") == 1)).select("id", "title")  # one row


@query(f"with {_C} select id, chunk_index, coalesce(is_valid, false) as valid from c where paper_id = 1")
def pr18_chunks_of_paper(spark, folder):
    """All chunks of one paper, invalid ones too."""
    return L.chunks(spark, folder, "paper_id = 1").select("id", "chunk_index", "valid").orderBy("chunk_index", "id")


@query("select id, hit_count from (select distinct on (id) id, hit_count, created_at, expires_at from llm_cache) where hit_count > 0 and created_at >= timestamp '2022-06-01' and (expires_at is null or expires_at > created_at)")
def pr10_rollbackable(spark, folder):
    """Log rows since a day that can be undone and were not, as predicates over a log."""
    log = L.cache(spark, folder).select("id", "hit_count", "created_at", (F.col("hit_count") > 0).alias("can"), (F.col("expires_at") <= F.col("created_at")).alias("undone"))
    return M.undoable(log, F.expr("timestamp '2022-06-01'")).select("id", "hit_count")


@query("select p.id, regexp_extract(file_path, '[^/]+$', 0) as old_name from papers p")
def j16_previews_to_rows(spark, folder):
    p = L.papers(spark, folder)
    preview = p.select(F.col("file_path").alias("path"), F.regexp_extract("file_path", "[^/]+$", 0).alias("old_name"))
    return p.select("id", "file_path").join(preview.distinct(), F.col("file_path") == F.col("path")).select("id", "old_name")


@query("with f as (select file_hash, file_path from papers) select count(*)::bigint as files, count(distinct file_hash)::bigint as contents, (select count(*) from (select file_hash from f group by all having count(*) > 1))::bigint as groups from f")
def s5_scan_and_duplicates(spark, folder):
    f = L.papers(spark, folder).select("file_hash", F.col("file_path").alias("path"))
    groups = M.duplicate_groups(f).agg(F.count("*").alias("groups"))
    return f.agg(F.count("*").alias("files"), F.count_distinct("file_hash").alias("contents")).join(F.broadcast(groups))  # two frames of one row
