"""Problems 1, 2, 7, 10: brute force, round trips and edge cases."""

import math
import pathlib
import random

import numpy as np
import pytest

from folioforge.llm import answers, lookalikes, neighbours, splitting

ROOT = pathlib.Path(__file__).resolve().parents[2]
VEC = "id bigint, grp bigint, vec array<float>, valid boolean, h1 string, rank int, key string"


def vectors(n=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.15 * rng.standard_normal((n, dim))).astype(np.float32)
    return x, rng.integers(1, 30, n)


def brute(x, grp, ids, k, least):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    out = set()
    for i in range(len(x)):
        s = u @ u[i]
        near = sorted((-round(float(s[j]), 9), ids[j]) for j in range(len(x)) if grp[j] != grp[i] and s[j] >= least)[:k]
        out |= {(ids[i], j) for _, j in near}
    return out


def test_most_similar_against_brute_force(spark):
    x, grp = vectors()
    ids = list(range(10, 10 + 7 * len(x), 7))
    rows = [(i, int(g), [float(v) for v in r], True, "x", 1, "y") for i, g, r in zip(ids, grp, x, strict=True)]
    rows += rows[:5]  # repeated rows
    rows += [(1, 1, None, True, "", 0, ""), (2, 1, [0.0] * 8, True, "", 0, ""), (3, 1, [1.0] * 5, True, "", 0, ""), (4, 1, rows[0][2], False, "", 0, ""), (None, 1, rows[0][2], True, "", 0, ""), (5, 1, [float("nan")] * 8, True, "", 0, ""), (6, 1, [1.0] * 7 + [None], True, "", 0, ""), (7, 1, rows[0][2], None, "", 0, "")]
    df = spark.createDataFrame(rows, VEC)
    got = neighbours.most_similar(df, 5, dim=8, min_similarity=0.9).collect()
    pairs = {(r.id, r.near_id) for r in got}
    want = brute(x, grp, ids, 5, 0.9)
    assert len(pairs & want) >= 0.97 * len(want) and len(pairs) <= len(want) * 1.03
    every = {(r.id, r.near_id) for r in neighbours.most_similar(df, 5, dim=8, asks="id % 10 = 0").collect()}
    mine = {p for p in brute(x, grp, ids, 5, -2) if p[0] % 10 == 0}
    assert len(every & mine) >= 0.95 * len(mine)


def test_copies_ties_and_hot_groups(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, 1 if i % 3 else i, v, True, "", 0, "") for i in range(1, 91)]  # one group holds two thirds
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in neighbours.most_similar(df, 5, dim=4, min_similarity=0.9).collect():
        got.setdefault(r.id, []).append((r.place, r.near_id))
    grp = {r[0]: r[1] for r in rows}
    for i in grp:
        want = sorted(j for j in grp if grp[j] != grp[i])[:5]
        assert [j for _, j in sorted(got[i])] == want
    assert neighbours.most_similar(df.where("false"), 5, dim=4).count() == 0


@pytest.mark.parametrize(
    ("prompt", "response", "want"),
    [
        ("What is x?", None, "empty"), ("What is x?", " \n", "empty"), ("What is x?", "<p></p>", "empty"), ("q", "**Answer:** ", "empty"), ("q", "​", "empty"), ("q", "N/A", "empty"),
        ("Be brief.\nHow do wolves hunt deer in winter?", "How do wolves hunt deer in winter?", "echo"),
        ("Be brief.\nHow do wolves hunt deer in winter?", "Sure! how do wolves hunt deer in winter", "echo"),
        ("How do wolves hunt deer in winter?", "You asked: How do wolves hunt deer in winter? They chase the weak ones over long distances in packs.", None),
        ("How do wolves hunt deer in winter?", "I'm sorry, but I can't help with that request. Is there something else I can do for you?", "refusal"),
        ("How do wolves hunt?", "I cannot tell from the abstract alone, but the methods section answers this: They hunt in packs.", None),
        ("How do wolves hunt?", "The authors cannot rule out that packs matter.", None),
        ("How do the wolves hunt in the winter?", "Die Wölfe jagen in der Nacht und sie ziehen mit dem Rudel durch den Wald.", "language"),
        ("How do the wolves hunt? Please answer in German.", "Die Wölfe jagen in der Nacht und sie ziehen mit dem Rudel durch den Wald.", None),
        ("How do wolves hunt?", "They hunt in packs. They follow the", "truncated"), ("How do wolves hunt?", "They hunt in packs (see the", "truncated"),
        ("How do wolves hunt?", "They hunt.\n```\nx = 1", "truncated"), ("How do wolves hunt?", "- They hunt in packs\n- They chase weak deer", None),
        ("How do wolves hunt?", "They hunt.\n\n| a | b |\n|---|---|\n| 1 | 2 |", None), ("How many?", "39 sites", None), ("Is it?", "No.", None), (None, "They hunt.", None), ("", None, "empty"),
    ],
)
def test_defects(prompt, response, want):
    assert answers.defect(prompt, response) == want


def test_suffix_automaton_against_search():
    rng = random.Random(2)
    for _ in range(40):
        p, r = ([rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        runs = answers.SuffixAutomaton(p).runs(r, 2)
        covered = {i for a, b, _ in runs for i in range(a, b)}
        text = " ".join(p) + " "
        want = set()
        for i in range(len(r)):
            for j in range(i + 2, len(r) + 1):
                if " ".join(r[i:j]) + " " in text and (text.startswith(" ".join(r[i:j]) + " ") or " " + " ".join(r[i:j]) + " " in text):
                    want |= set(range(i, j))
        assert covered == want
        for a, b, e in runs:
            assert p[e - (b - a) : e] == r[a:b]


def test_defective_pairs_table(spark):
    schema = "record_table string, record_id bigint, prompt string, response string, defect string"
    rows = [("llm_cache", 1, "q", None, "x"), ("llm_cache", 1, "q", None, "x"), ("notes", 2, None, "All is well here.", ""), ("notes", None, "q", None, ""), ("notes", 3, "q " * 40_000, "w " * 100_000 + "end.", "")]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in answers.defective_pairs(df).collect()] == [("llm_cache", 1, "empty")]
    assert answers.defective_pairs(df.where("false")).count() == 0


def check_pieces(text, limit, overlap):
    kind, pieces = splitting.split_text(text, limit, overlap)
    at = 0
    for n, (lo, a, b) in enumerate(pieces):
        assert b - lo <= limit and 0 <= a - lo <= overlap and lo <= a < b
        assert not text[at:a].strip()
        if n:
            assert lo >= pieces[n - 1][1]
        at = b
    assert not text[at:].strip()
    return kind, pieces


def test_split_round_trip_and_boundaries():
    rng = random.Random(5)
    alphabet = ["word", "a", "Dr. Smith", "end.", "Next", "\n\n", "\n \n", "!", "xyzzy" * 30, "é", "\U0001f600", " "]
    for _ in range(150):
        text = " ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120)))
        check_pieces(text, 120, 20)
    para = "Some words here. " * 4
    assert check_pieces(f"{para}\n\n{para}\n\n{para}", 100, 10)[0] == "paragraph"
    assert check_pieces(para * 5, 100, 10)[0] == "sentence"
    assert check_pieces("see Dr. Who of no end " * 30, 100, 10)[0] == "word"
    assert check_pieces("x" * 500, 100, 10)[0] == "none"
    assert splitting.split_text("   " * 900)[1] == [] and splitting.split_text("")[1] == []
    assert splitting.split_text("a" * 1200)[1] == [(0, 0, 1200)]
    assert check_pieces("Long text. " * 100_000, 1200, 100)[0] == "sentence"


def test_cohesion_matches_recount():
    rng = random.Random(1)
    text = " ".join(rng.choice(["river", "water", "graph", "node", "stone"]) for _ in range(150))
    places, sims = splitting.cohesion(text)
    words = text.split()
    for g in range(1, len(words)):
        left, right = words[max(0, g - splitting.BLOCK) : g], words[g : g + splitting.BLOCK]
        dot = sum(left.count(w) * right.count(w) for w in set(left))
        want = dot / math.sqrt(sum(left.count(w) ** 2 for w in set(left)) * sum(right.count(w) ** 2 for w in set(right)))
        assert abs(sims[g] - want) < 1e-9


def test_deepest_valley_is_chosen():
    a, b = ("The river water flows past stones. " * 6), ("Graph nodes share edges with nodes. " * 6)
    _, pieces = splitting.split_text(a + b, 330, 30)
    assert any((a + b)[p[1] :].startswith("Graph") for p in pieces)


def test_split_pieces_table(spark):
    schema = "id bigint, owner bigint, place int, section string, text string, n int, piece string"
    long = "One more sentence stands here. " * 100
    rows = [(1, 7, 0, "A", "short", 0, ""), (2, 7, 1, None, long, 0, ""), (2, 7, 1, None, long, 0, ""), (3, 7, 2, "B", None, 0, ""), (4, None, 0, "C", "", 0, ""), (None, 7, 0, "D", long, 0, "")]
    df = spark.createDataFrame(rows, schema)
    got = splitting.split_pieces(df).orderBy("owner", "place").collect()
    mine = [r for r in got if r.owner == 7]
    assert [r.place for r in mine] == list(range(len(mine))) and mine[0].piece == "short" and mine[-1].piece is None
    assert all(len(r.piece or "") <= 1200 for r in got) and {r.section for r in got if r.id == 2} == {None}
    assert "".join(r.piece[r.repeated :] + " " for r in mine if r.id == 2).split() == long.split()
    assert splitting.split_pieces(df.where("false")).count() == 0


def test_normal_forms(spark):
    texts = {
        1: "Ｆｕｌｌ ｗｉｄｔｈ", 2: "résumé", 3: "zero​width ﻿mark so­ft", 4: "no break", 5: "ﬁne \U0001d42d\U0001d421\U0001d41e", 6: "tοken and measurement measurement",
        7: "mеasurеment", 8: "пpивет привет привет", 9: "その結果（全10）。　次の文です", 10: "می‌دهد", 11: "team \U0001f469‍\U0001f52c", 12: "Here Δt and λmax, x̄", 13: "plain text", 14: "", 15: None,
    }
    df = spark.createDataFrame([(i, t, "k", "w") for i, t in texts.items()] + [(1, texts[1], "k", "w"), (None, "ﬁ", "", "")], "id bigint, text string, kinds string, word string")
    got = {r.id: (r.text, r.kinds) for r in lookalikes.canonical_text(df).collect()}
    assert len(got) == len(texts)
    assert got[1] == ("Full width", ["fullwidth"]) and got[2] == ("résumé", ["combining"]) and got[3] == ("zerowidth mark soft", ["invisible"])
    assert got[4] == ("no break", ["space"]) and got[5] == ("fine the", ["presentation"])
    assert got[6][1] == ["lookalike"] and got[7] == ("measurement", ["lookalike"]) and got[8] == ("привет привет привет", ["lookalike"])
    for i in (9, 10, 11, 12, 13, 14):
        assert got[i] == (texts[i], []), i
    assert got[15][0] is None and got[15][1] == []
    assert lookalikes.canonical_text(df.where("false")).count() == 0
    again = spark.createDataFrame([(i, t) for i, (t, _) in got.items()], "id bigint, text string")
    assert {r.id: r.text for r in lookalikes.canonical_text(again).collect()} == {i: t for i, (t, _) in got.items()}
    assert lookalikes.rewrite("ﬁ" * 200_000, {})[0] == "fi" * 200_000


def test_trie_reaches_words_within_cost():
    trie = lookalikes.Trie()
    for w, n in (("cop", 3), ("cap", 2), ("сор", 1), ("café", 4), ("final", 5)):
        trie.add(w, n)
    assert {w for _, w, _, _ in trie.reach("сop")} == {"cop", "сор"}
    assert {(c, w) for c, w, _, _ in trie.reach("cop", 1)} == {(0, "cop"), (1, "cap"), (0, "сор")}
    free = {"cafe\u0301": {"combining"}, "ca\u00adfé": {"invisible"}, "\ufb01nal": {"presentation"}, "ｆinal": {"fullwidth"}, "ca\u200bfe\u0301": {"invisible", "combining"}, "finаl": {"lookalike"}}
    for typed, kinds in free.items():
        ((cost, word, _, met),) = trie.reach(typed)
        assert cost == 0 and word in ("café", "final") and met == kinds, typed


def test_registered_queries_run(spark, folder):
    from folioforge.llm import catalogue

    known = catalogue.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} <= set(known)
    want = {
        "p1_found": ["id_a", "id_b"], "p2_found": ["record_table", "record_id", "defect"], "p3_found": ["name_a", "name_b"], "p4_found": ["citation_id", "paper_id"],
        "p5_found": ["record_table", "record_id", "noise"], "p6_found": ["id_a", "id_b"], "p7_found": ["id", "boundary"], "p10_found": ["doc_id", "kind"],
    }
    for name, query in known.items():
        df = query(spark, folder)
        rows = df.collect()
        assert rows, name
        if name in want:
            assert df.columns == want[name] and len(set(rows)) == len(rows), name


def test_a_missing_library_leaves_the_other_queries():
    import subprocess
    import sys

    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert 'v1_knn' in q and 'p8_pack' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(ROOT), capture_output=True, timeout=120).returncode == 0
