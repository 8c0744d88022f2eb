"""Core operators against plain Python on small fixtures."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioforge.functions import extract as X
from folioforge.functions import intent as I
from folioforge.functions import text as T
from folioforge.operators import chunking as K
from folioforge.operators import lexical, maintain
from folioforge.operators.hybrid import fuse, greedy
from folioforge.operators.vectors import knn, nearest_groups
from folioforge.plans.components import connected_components
from folioforge.plans.running import running_total
from folioforge.plans.skew import pairs_by_key
from folioforge.sources.files import atom_entries, parse_files, scan_folder
from folioforge.streaming.watch import debounce, ingest, watch_folder


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first()[0]


def test_tokens_keywords_sentences(spark):
    assert one(spark, T.tokens(F.col("t")), t="État-of-the-art: it's 3.5!") == ["étatoftheart", "its", "35"]
    assert one(spark, T.keywords(F.col("t")), t="The new paper on graph graph nets is ok") == ["graph", "graph", "nets"]
    assert one(spark, T.sentences(F.col("t")), t=" One. Two?  Three ") == ["One.", "Two?", "Three"]
    assert one(spark, T.tokens(F.col("t")), t="") == []


def test_identifiers_and_names(spark):
    text = "Title\nSee doi 10.1234/abc.5 and ARXIV:2301.00001v2, printed 1999 or 2020"
    assert one(spark, X.doi(F.col("t")), t=text) == "10.1234/abc.5"
    assert one(spark, X.arxiv_id(F.col("t")), t=text) == "2301.00001"
    assert one(spark, X.year(F.col("t")), t=text) == 1999
    assert one(spark, X.doi(F.col("t")), t="none") is None
    assert one(spark, X.safe_name(F.col("t")), t="Test: Paper / Title") == "Test_Paper_Title"
    assert one(spark, X.safe_name(F.col("t")), t="<>|?*") == "unnamed"
    assert one(spark, X.safe_name(F.col("t")), t=None) == "unnamed"
    assert len(one(spark, X.safe_name(F.col("t")), t="x" * 300)) == 200
    assert one(spark, X.normal_arxiv(F.col("t")), t=" arXiv:2301.00001v2 ") == "2301.00001"
    assert one(spark, X.author_label(F.col("t")), t="Ann Lee, Bo Ray, Cy Poe") == "Lee_Ray_et_al"
    assert one(spark, X.retry_seconds(F.col("t")), t="please try again in 1.5s") == 2
    assert one(spark, X.retry_seconds(F.col("t")), t="no hint") == 60
    assert one(spark, X.search_query(F.col("t")), t="of the") == "all:learning"


def test_intents(spark):
    q = F.col("q")
    for text, want in [
        ("Compare paper 2 and paper 7", "compare"), ("Compare paper 2 with others", "qa"), ("similar papers on graphs", "similar"),
        ("what sections does paper 3 have", "list_sections"), ("Summarize the results of paper 4", "summarize_section"), ("summarise paper 4", "summarize"), ("why", "qa"),
    ]:
        assert one(spark, I.dispatch(q), q=text) == want, text
    assert one(spark, I.paper_ids(q), q="compare [7] and paper 2, paper 7") == [7, 2]


def test_word_windows_and_sentence_chunks(spark):
    words = [f"w{i}" for i in range(23)]
    text = " ".join(words)
    got = one(spark, K.word_windows(F.col("t"), 10, 3), t=text)
    assert got[0] == " ".join(words[:10]) and all(a.split()[-3:] == b.split()[:3] for a, b in zip(got, got[1:]))
    assert got[-1].split()[-1] == "w22"
    assert one(spark, K.word_windows(F.col("t"), 50, 3), t=text) == [text]
    s = [f"Sentence number {i} says this." for i in range(9)]
    got = one(spark, K.sentence_chunks(F.col("t"), 20), t=" ".join(s))
    assert all(a.split(". ")[-1].rstrip(".") == b.split(". ")[0].rstrip(".") for a, b in zip(got, got[1:]))
    assert one(spark, K.sentence_chunks(F.col("t")), t="") == []


def test_structure():
    text = "A title of some length\n\nAbstract\n" + "x" * 120 + "\n\n1. Introduction\nBody one.\n2. Results\nBody two.\nReferences\n[1] A."
    parts = K.parse_structure(text)
    assert parts[0] == ("title", "title", "A title of some length") and parts[1][0] == "abstract"
    assert ("section", "1. Introduction", "Body one.") in parts and ("section", "2. Results", "Body two.") in parts and parts[-1] == ("references", "References", "[1] A.")
    assert K.parse_structure("plain") == [("section", "Main Content", "plain")]


def test_markdown_sections(spark):
    md = "intro\n# One\nsee [x](http://y) here\n---\n## Two\n![i](p.png) text"
    got = [tuple(r) for r in one(spark, K.markdown_sections(F.col("t")), t=md)]
    assert got == [(None, "intro"), ("One", "see x here"), ("Two", "text")]


def test_knn_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).round(3)
    x[5] = x[6]
    rows = spark.createDataFrame([(i, i % 7, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, 1, None), (901, 1, [1.0])], "id bigint, grp bigint, vec array<double>")
    q = rows.where("id < 20").select(F.col("id").alias("qid"), "vec")
    got = {}
    for r in knn(q, rows, 5, 8).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.id
    for i in range(20):
        d = sorted((round(float(((x[i] - y) ** 2).sum()), 6), j) for j, y in enumerate(x))
        assert [got[i][k] for k in range(5)] == [j for _, j in d[:5]]
    assert knn(q.where("false"), rows, 5, 8).count() == 0
    assert nearest_groups(q, rows, 3, 8).groupBy("qid").count().where("count > 3").count() == 0


def test_bm25(spark):
    docs = {1: "sparse graphs of sparse nets", 2: "graphs", 3: "other words here", 4: "", 5: "sparse sparse sparse nets"}
    d = spark.createDataFrame([*docs.items(), (6, None)], "id bigint, text string")
    q = spark.createDataFrame([(1, "sparse sparse nets")], "qid bigint, question string")
    got = [(r.id, r.score) for r in lexical.bm25(q, d, 10).orderBy(F.desc("score"), "id").collect()]
    toks = {i: t.split() for i, t in docs.items()}
    n, mean = len(docs) + 1, sum(map(len, toks.values())) / len(docs)

    def score(t):
        total = 0
        for w in ("sparse", "sparse", "nets"):
            df = sum(w in x for x in toks.values())
            f = t.count(w)
            if f:
                total += math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / mean))
        return round(total, 6)

    assert {i for i, _ in got} == {1, 5} and got[0][0] == max((1, 5), key=lambda i: score(toks[i]))


def test_fuse_and_greedy(spark):
    d = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "qid bigint, id bigint, rank int")
    k = spark.createDataFrame([(1, 11, 0)], "qid bigint, id bigint, rank int")
    got = {r.id: r.rrf for r in fuse(d, k).collect()}
    assert got == {10: round(1 / 60 + 1 / 62, 9), 11: round(1 / 61 + 1 / 60, 9)}
    items = spark.sql("select array(named_struct('c', 60), named_struct('c', 50), named_struct('c', 30), named_struct('c', 10)) as a")
    assert [x.c for x in items.select(greedy(F.col("a"), "c", F.lit(100)).alias("x")).first().x] == [60, 30, 10]


def test_merge_chunks(spark):
    live = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "z"), (1, 3, None)], "paper_id bigint, chunk_index int, chunk_hash string")
    fresh = spark.createDataFrame([(1, 0, "a"), (1, 1, "c")], "paper_id bigint, chunk_index int, chunk_hash string")
    got = Counter(r.state for r in maintain.merge_chunks(live, fresh).collect())
    assert got == {"reused": 1, "new": 1, "orphaned": 2}


def test_unique_targets(spark):
    t = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "b.pdf"), (4, "a.pdf")], "id bigint, target string")
    assert {r.id: r.target for r in maintain.unique_targets(t).collect()} == {1: "a.pdf", 2: "a_1.pdf", 3: "b.pdf", 4: "a_2.pdf"}


def test_running_total_over_hot_groups(spark):
    rng = random.Random(1)
    rows = [(("h" if i % 3 else None) if i % 5 else "g", rng.randrange(50), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a int, i bigint, m int")
    got = {r.i: r.upto for r in running_total(df, ["g"], ["a", "i"], "m", "upto", rows_per_task=60).collect()}
    want, run = {}, Counter()
    for g, _a, i, m in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        run[g] += m
        want[i] = run[g]
    assert got == want
    assert running_total(df.where("false"), ["g"], ["a", "i"], "m", "upto").count() == 0


def test_pairs_by_key_splits_buckets(spark):
    rows = [("hot", i) for i in range(40)] + [("cold", 1), ("cold", 2), ("one", 3), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "k string, i bigint")
    got = {(r.a, r.b) for r in pairs_by_key(df, "k", "i", block=7).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40)}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 100), (5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_debounce_batch_and_loop(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(4), base + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(300)]
    got = {r.id for r in debounce(spark.createDataFrame(rows, "key bigint, ts timestamp, id bigint"), 90).collect()}
    want, last = set(), {}
    for k, t, i in sorted(rows):
        if k not in last or (t - last[k]).total_seconds() >= 90:
            want.add(i)
            last[k] = t
    assert got == want


def test_files_and_ingest(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.pdf").write_bytes(b"one")
    (src / "sub" / "b.pdf").write_bytes(b"one")
    (src / "c.PDF").write_bytes(b"two")
    (src / "d.txt").write_bytes(b"no")
    files = scan_folder(spark, str(src))
    assert files.count() == 3 and maintain.duplicate_groups(files).count() == 1
    assert scan_folder(spark, str(src), ignored=("sub/*",)).count() == 2 and scan_folder(spark, str(src), ignored=("[ab].*",)).count() == 1

    def parser(content):
        if content == b"two":
            raise ValueError("bad")
        return content.decode()

    parsed = {r.path[-5:]: (r.text, r.error) for r in parse_files(spark, str(src), parser, "*.{pdf,PDF}").collect()}
    assert parsed == {"a.pdf": ("one", None), "b.pdf": ("one", None), "c.PDF": (None, "bad")}
    long = {r.path[-5:]: (r.text, r.title) for r in parse_files(spark, str(src), parser, "*.pdf", fallback=lambda c: "y" * 101, metadata=lambda c: {"title": "T"}).collect()}
    assert long == {"a.pdf": ("y" * 101, "T"), "b.pdf": ("y" * 101, "T")}
    known = spark.createDataFrame([], "file_hash string")
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    for _ in range(2):  # the second run finds nothing new
        ingest(watch_folder(spark, str(src)), lambda: known, out, chk).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_atom(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1234.5678v2</id><title>A  b</title><summary>s</summary></entry><entry><id>x</id></entry></feed>'
    got = atom_entries(spark.createDataFrame([("f", xml), ("g", "<broken"), ("h", None)], "feed string, xml string")).collect()
    assert [(r.external_id, r.title) for r in got] == [("1234.5678", "A b")]
