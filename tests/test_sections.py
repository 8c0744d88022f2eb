"""Aligned sections: papers without a labelled chunk."""

import math
import random

from folioforge.operators.sections import aligned_section

CHUNKS = "id bigint, paper_id bigint, chunk_index int, text string, section string, importance double, valid boolean"


def stand_in(chunks, name, size):
    """One paper's excerpt by plain BM25."""
    words, asked = [c[3].lower().split() for c in chunks], name.lower().split()
    mean, n = sum(map(len, words)) / len(words), len(words)
    ranked = []
    for c, w in zip(chunks, words, strict=True):
        score = 0.0
        for t in asked:
            df = sum(t in x for x in words)
            score += math.log((n - df + 0.5) / (df + 0.5) + 1) * (w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean))) if df else 0
        if score > 0:
            ranked.append((-score, c[2], c[0], c[3]))
    return " ".join(r[3] for r in sorted(ranked)[:5])[:size] or f"[Section '{name}' not found]"


def test_papers_without_the_label_give_their_best_chunks(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for paper in range(1, 9):
        vocabulary = ["main", "results", "show", "that", "graphs", "grow"] if paper < 7 else ["other", "words"]
        for at in range(120 if paper == 1 else 9):
            i += 1
            rows.append((i, paper, at, " ".join(rng.choices(vocabulary, k=rng.randint(3, 12))), "Body" if at % 2 else None, 0.5, True))
    rows += [(900, 2, 50, "results results", "Body", 0.5, False), (901, 3, 51, "Labelled", "Main Results of it", 0.5, True)]
    df = spark.createDataFrame(rows, CHUNKS)
    papers = spark.createDataFrame([(p,) for p in range(1, 11)], "paper_id bigint")
    for name in ("results", "main results"):
        got = {r.paper_id: r.excerpt for r in aligned_section(df, papers, name, 60).collect()}
        for p in range(1, 11):
            mine = [r for r in rows if r[1] == p and r[6]]
            want = "Labelled" if p == 3 else stand_in(mine, name, 240) if mine else f"[Section '{name}' not found]"
            assert got[p] == want, (name, p)
