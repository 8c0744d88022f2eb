"""Ingest, sessions, checks, structure and streams on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioforge.functions import checks
from folioforge.operators import chunking, context, ingest, maintain, sections, sessions
from folioforge.streaming import watch

PAPER = """A Study of River Ice and Its Break-Up

Abstract:
{abstract}

1. Introduction
Rivers freeze. They thaw again.

Methods
We walked along the river. We counted.

REFERENCES
[1] A. Author, Ice, 1999.
"""


def test_structure_and_hybrid_chunks(spark):
    text = PAPER.format(abstract="Ice matters to all. " * 8)
    parts = chunking.parse_structure(text)
    kinds = [(k, n) for k, n, _ in parts]
    assert kinds[0] == ("title", "title") and kinds[1] == ("abstract", "Abstract") and kinds[-1][0] == "references"
    assert ("section", "1. Introduction") in kinds and ("section", "Methods") in kinds
    assert dict((n, t) for _, n, t in parts)["Methods"] == "We walked along the river. We counted."
    assert parts[-1][2] == "[1] A. Author, Ice, 1999."
    assert chunking.parse_structure("just a few words that make a title\nand more")[-1][:2] == ("section", "Main Content")
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "Short text. " * 900)], "id bigint, text string")
    got = chunking.hybrid_chunks(df).orderBy("id", "chunk_index").collect()
    mine = [r for r in got if r.id == 1]
    assert [r.chunk_index for r in mine] == list(range(len(mine)))
    assert mine[0].chunk_type == "title" and mine[0].importance == 1.0 and mine[-1].section == "References" and mine[-1].importance == 0.3
    assert {r.chunk_type for r in mine} >= {"title", "abstract", "introduction", "methods", "reference"}
    assert not any(r.id in (2, 3) for r in got) and sum(r.id == 4 for r in got) > 1
    assert chunking.chunks_by("simple", df).where("id = 4").count() > 1 and chunking.chunks_by("sentence", df).count() > 0
    with pytest.raises(ValueError):
        chunking.chunks_by("other", df)


def test_markdown_chunks(spark):
    df = spark.createDataFrame([(1, "intro here\n# Methods\nWe did it.\n# Results\n"), (2, "# Only\n## Headings"), (3, " ")], "id bigint, text string")
    got = [(r.id, r.chunk_index, r.chunk_type, r.section) for r in chunking.markdown_chunks(df).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, "paragraph", None), (1, 1, "methods", "Methods"), (2, 0, "paragraph", None)]


def test_process_keeps_going(spark):
    rows = [(1, "/b", "h1", "x" * 200), (2, "/a", "h1", "x" * 200), (3, "/c", "h2", None), (4, "/d", "h3", "few"), (5, "/e", "h4", "y" * 200)]
    files = spark.createDataFrame(rows, "id bigint, path string, file_hash string, text string")
    known = spark.createDataFrame([("h4",)], "file_hash string")
    done = ingest.process(files, known)
    assert {r.id: (r.outcome, r.stage, r.error) for r in done.collect()} == {1: ("duplicate", "dedup", None), 2: ("embedded", "embed", None), 3: ("failed", "extract", "no text"), 4: ("stored", "insert", None), 5: ("duplicate", "dedup", None)}
    t = ingest.run_totals(done).first()
    assert (t.files, t.success, t.duplicate, t.failed, t.embedded) == (5, 2, 2, 1, 1)
    assert ingest.run_totals(ingest.process(files.where("false"))).first().files == 0


def test_merge_keeps_vectors_and_versions(spark):
    live = spark.sql("select 1L as paper_id, 0 as chunk_index, sha2('old text', 256) as chunk_hash, 'old text' as text, array(1f) as vec union all select 1L, 1, sha2('gone', 256), 'gone', array(2f)")
    fresh = spark.createDataFrame([(1, 5, "old text"), (1, 6, "n" * 3000)], "paper_id bigint, chunk_index int, text string")
    papers = spark.createDataFrame([(1, 3)], "id bigint, content_version int")
    got = {r.state: r for r in ingest.merge_chunks_in_full(live, fresh, papers).collect()}
    assert got["reused"].chunk_index == 5 and got["reused"].vec == [1.0] and got["reused"].version == 4
    assert len(got["new"].text) == 1000 and got["new"].vec is None and got["new"].valid
    assert not got["orphaned"].valid and got["orphaned"].version == 3
    totals = ingest.reuse_totals(ingest.merge_chunks_in_full(live, fresh, papers)).first()
    assert (totals.reused, totals.new, totals.orphaned, totals.reuse_pct) == (1, 1, 1, 50.0)


def test_encode_and_index(spark, tmp_path):
    def model():
        def run(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in texts]

        return run

    rows = spark.createDataFrame([(1, 0, 1, "abc"), (1, 1, 2, None), (2, 0, 3, "bad"), (2, 1, 4, "")], "paper_id bigint, chunk_index int, id bigint, text string").coalesce(1)
    got = {r.id: r.vec for r in ingest.encode(rows, model, batch=1).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: None, 4: [0.0, 1.0]}
    ingest.save_index(ingest.encode(rows, model, batch=1), str(tmp_path / "index"))
    state = ingest.index_state(ingest.load_index(spark, str(tmp_path / "index")), 2).first()
    assert (state["size"], state.misfits, state.repeated) == (2, 0, 0)


def test_insert_update_and_pages(spark):
    table = spark.createDataFrame([(1, "h1", "A", 2000)], "id bigint, file_hash string, title string, year int")
    rows = spark.createDataFrame([(2, "h1", "B", 2001), (3, "h2", "C", 2002), (4, "h2", "D", 2003)], table.schema)
    both = ingest.insert_new(rows, table)
    assert sorted(r.id for r in both.collect()) == [1, 3]
    new = maintain.update(both, spark.createDataFrame([(3, "CC", None)], "id bigint, title string, year int"))
    assert {r.id: (r.title, r.year) for r in new.collect()} == {1: ("A", 2000), 3: ("CC", 2002)}
    assert [r.id for r in maintain.page(both, "year", 1).collect()] == [3]
    for bad in (lambda: maintain.page(both, "id", 1), lambda: maintain.page(both, "year", 0), lambda: maintain.page(both, "year", 1, -1)):
        with pytest.raises(ValueError):
            bad()


def test_external_ids(spark):
    library = spark.createDataFrame([("2301.00001v2", None), (None, "10.1/AB"), ("", "")], "arxiv_id string, doi string")
    outside = spark.createDataFrame([(1, "arXiv:2301.00001v1", None), (2, None, "10.1/ab"), (3, "", ""), (4, "2301.2", "10.2/x")], "id bigint, arxiv_id string, doi string")
    assert sorted(r.id for r in maintain.not_in_library(outside, library).collect()) == [3, 4]


def test_sessions(spark):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    rows = [("s", at(0), 1, "What of paper 7?", []), ("s", at(1), 2, "and its results?", [9]), ("s", at(2), 3, "again?", []), ("r", at(9), 4, "new", [])]
    t = spark.createDataFrame(rows, "session string, at timestamp, id bigint, question string, paper_ids array<bigint>")
    asked = {r.id: r.asked for r in sessions.carry_over(t).collect()}
    assert asked == {1: "What of paper 7?", 2: "and its results? [7]", 3: "again? [9]", 4: "new"}
    up = {r.session: r for r in sessions.roll_up(t).collect()}
    assert up["s"].messages == 3 and up["s"].paper_ids == [9] and up["r"].paper_ids == []
    assert sessions.latest_session(sessions.roll_up(t)).first().session == "r"
    cached = spark.createDataFrame([(1, [1, 2]), (2, [3])], "id bigint, paper_ids array<bigint>")
    assert [r.id for r in sessions.drop_containing(cached, spark.createDataFrame([(2,)], "paper_id bigint")).collect()] == [2]
    put = sessions.put(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("a", 9)], "k string, v int"), "k")
    assert {(r.k, r.v) for r in put.collect()} == {("a", 9), ("b", 2)}


def test_context_blocks_and_budgets(spark):
    kept = spark.createDataFrame([(1, 1, 0.5, 7, None, "text a"), (1, 2, 0.9, 8, "Results", "text b")], "qid bigint, place int, score double, paper_id bigint, section string, excerpt string")
    papers = spark.createDataFrame([(7, "T" * 60, "Ann", 2001)], "id bigint, title string, authors string, year int")
    text = context.context_blocks(kept, papers).first().context
    assert text == "Papers in context:\n  Paper 7: [id 7] " + "T" * 60 + " — Ann, 2001\n  Paper 8: [id 8] Paper 8 — , \n\n[Paper 8 | Paper 8 | Results]\ntext b\n\n[Paper 7 | " + "T" * 55 + "… | Content]\ntext a"
    m = spark.createDataFrame([("compound-beta",), ("unknown",)], "m string").select(context.budget(F.col("m")).alias("b")).collect()
    assert [r.b for r in m] == [4915, 2457]


def test_fuzzy_sections(spark):
    names = spark.createDataFrame([(1, "Our Approach", 2), (1, "Findings", 3), (2, "Methods", 1), (2, "Results", 2)], "paper_id bigint, section string, first int")
    got = {(r.paper_id, r.name): r.section for r in sections.fuzzy_sections(names, ["methodology", "results"]).collect()}
    assert got == {(1, "methodology"): "Our Approach", (1, "results"): "Findings", (2, "methodology"): "Methods", (2, "results"): "Results"}
    lists = spark.createDataFrame([(5, [2, 1]), (6, [2]), (7, [])], "note bigint, papers array<bigint>")
    assert {(r.note, r.section) for r in sections.common_sections(names, lists).collect()} == {(5, "Results"), (6, "Methods"), (6, "Results")}


def test_checks(tmp_path):
    assert checks.between("top_k", 5, checks.TOP_K) == 5 and checks.positive("id", 1) == 1 and checks.search_text(" x ") == "x"
    for bad in (lambda: checks.between("top_k", 101, checks.TOP_K), lambda: checks.positive("id", 0), lambda: checks.search_text(" "), lambda: checks.sort_by("size"), lambda: checks.positive("id", True)):
        with pytest.raises(ValueError):
            bad()
    assert checks.has_room(str(tmp_path), 1) and not checks.has_room(str(tmp_path), 10**18)


def test_sync_then_watch_and_stop(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n, t in (("a.pdf", "one"), ("b.pdf", "one"), ("c.pdf", "two")):
        (folder / n).write_text(t)
    none = lambda: spark.createDataFrame([], "file_hash string")
    query = watch.sync_then_watch(watch.watch_folder(spark, str(folder)), none, out, str(tmp_path / "state"), "1 second")
    (folder / "d.pdf").write_text("three")
    assert watch.stop(query)
    assert spark.read.parquet(out).count() == 3
