"""Document folds against plain Python models, on odd and random texts."""

from __future__ import annotations

import random
import time

import models
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays, search
from corpusloom.operators import clauses, semantic_chunks, structural_chunks, structure
from corpusloom.workload.tables import LETTERS, letter_embedder

ODD = [
    "",
    "   \n\n ",
    "no heading at all",
    "# A\n\n### B\n\n### C\n\ntext",          # skipped level
    "#\ntitle on the next line\nmore",
    "```\n# in a fence\n```\n# Real",
    "# Nbsp  \n\nÀ. École. Été # not a heading",
    "# CR\rline\r\n## Two\r\n\r\nx",
    "####### seven\n###### six ######",
    "intro. before\n\n# H",
    "One. Two! (Three) \"Four\" 'five' six? [Seven]\n\n\n \nEight.\tNine",
    "tabs.\x1cUnits sep. \x85Next. 　Wide.  Two",
    " private mark. And\n# heading ",
    "a" * 50 + "\n\n" + "b" * 4000 + "\n\n\n\n  c  \n\nd",
    "𝔘𝔫𝔦. 𝔠𝔬𝔡𝔢. Astral 🙂. Done\n\n# 🙂 Head\n\n🙂🙂",
]


def random_text(rng: random.Random) -> str:
    words = ["alpha", "Beta.", "gamma", "Delta!", "eps", "(zeta)", "\"Eta\"", "theta?", "é.", "#"]
    lines = []
    for _ in range(rng.randint(1, 40)):
        mark = rng.choice(["", "", "", "# ", "## ", "### ", "#### ", "  "])
        lines.append(mark + " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))))
    return rng.choice(["\n", "\n\n"]).join(lines) + rng.choice(["", "\n", "\n\n\n"])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ODD + [random_text(rng) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, full_text string")
    return structure.markdown_structure(df.withColumn("filename", F.lit("x.md"))).cache()


def by_doc(df, *cols):
    out: dict[int, list] = {}
    for r in df.orderBy("doc_id", "ord").collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols))
    return out


def test_headings_and_sections(docs, texts):
    for r in docs.collect():
        got = [(h.level, h.text, h.char_start, h.char_end) for h in r.headings]
        assert got == models.heads(texts[r.doc_id]), texts[r.doc_id]
        secs = [(s.section_path, s.char_start, s.char_end) for s in r.sections]
        assert secs == models.tree(texts[r.doc_id])


def test_section_lookup_short_and_long_lists(spark):
    text = "".join(f"# H{i}\nbody\n" for i in range(400))
    df = structure.markdown_structure(
        spark.createDataFrame([(0, "f.md", text)], "doc_id long, filename string, full_text string")
    )
    probes = df.select("sections", F.explode(F.sequence(F.lit(-1), F.lit(len(text) + 1), F.lit(3))).alias("p"))
    secs = models.tree(text)
    for r in probes.select("p", structure.section_at(F.col("sections"), F.col("p")).alias("s")).collect():
        assert r.s == models.path_at(secs, r.p)


@pytest.mark.parametrize("low,high,levels,exact", [
    (50, 800, (1, 2, 3), True), (5, 20, (1, 2), True), (5, 20, (1, 2), False), (1, 3, (1,), True), (30, 40, (), False),
])
def test_structural(docs, texts, low, high, levels, exact):
    got = by_doc(
        structural_chunks.structural_chunks(
            docs, min_tokens=low, max_tokens=high, heading_split_levels=levels, exact_spans=exact
        ),
        "text", "char_start", "char_end", "section_path", "token_count",
    )
    for i, t in enumerate(texts):
        assert got.get(i, []) == models.structural(t, low, high, levels, exact), t


def test_structural_chunks_are_ordered_and_quote_the_text(docs, texts):
    got = by_doc(structural_chunks.structural_chunks(docs, min_tokens=1, max_tokens=10),
                 "text", "char_start", "char_end")
    for i, chunks in got.items():
        for (t, a, z), after in zip(chunks, [*chunks[1:], None]):
            squeeze = lambda s: "".join(s.split())
            assert squeeze(texts[i][a:z]) == squeeze(t)
            assert after is None or z <= after[1]


def test_sentences(docs, texts):
    got = by_doc(semantic_chunks.sentences(docs), "char_start", "char_end", "text")
    for i, t in enumerate(texts):
        assert got.get(i, []) == models.sentence_spans(t), t


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("low,high,threshold", [(50, 800, 0.5), (3, 30, 0.95), (1, 5, 0.0)])
def test_semantic(docs, texts, low, high, threshold, spread):
    got = by_doc(
        semantic_chunks.semantic_chunks(
            docs, letter_embedder, min_tokens=low, max_tokens=high,
            similarity_threshold=threshold, spread=spread,
        ),
        "text", "char_start", "char_end", "token_count", "boundary_confidence",
    )
    for i, t in enumerate(texts):
        want = models.semantic(t, low, high, threshold, LETTERS)
        assert [g[:4] for g in got.get(i, [])] == [w[:4] for w in want], t
        assert [g[4] for g in got.get(i, [])] == pytest.approx([w[4] for w in want], abs=6e-4)


def test_semantic_section_at_root(docs):
    chunks = semantic_chunks.semantic_chunks(docs, letter_embedder, max_tokens=5, root_section=True)
    roots = {r.doc_id: r.s for r in docs.select(
        "doc_id", structure.section_at(F.col("sections"), F.lit(0)).alias("s")).collect()}
    assert all(r.section_path == roots[r.doc_id] for r in chunks.collect())


def test_hybrid_cuts_only_oversize_chunks(docs, texts):
    got = by_doc(
        semantic_chunks.hybrid_chunks(docs, letter_embedder, min_tokens=4, max_tokens=12, similarity_threshold=0.9),
        "ord", "sub_ord", "text", "char_start", "char_end", "token_count",
    )
    for i, t in enumerate(texts):
        want = []
        for k, (body, a, z, _, n) in enumerate(models.structural(t, 4, 12, (1, 2, 3), True), 1):
            parts = models.semantic(body, 4, 12, 0.9, LETTERS) if n > 12 else []
            if not parts:
                want.append((k, 1, body, a, z, n))
            want += [(k, j, p[0], a + p[1], a + p[2], p[3]) for j, p in enumerate(parts, 1)]
        assert sorted(got.get(i, [])) == want, t


@pytest.mark.parametrize("limit", [3000, 40, 3])
def test_windows(docs, texts, limit):
    out = clauses.windows(docs, max_window_tokens=limit).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.w)
        assert [(r.char_start, r.char_end) for r in mine] == models.windows(t, limit), t
        assert all(r.text == t[r.char_start:r.char_end] for r in mine)


def test_located_clauses(spark):
    rng = random.Random(3)
    cases = [("a b  c\n d", ["a", "zz", "b c", "d"]), ("x x x", ["x", "x", "x", "x"]), ("", ["q"])]
    for _ in range(40):
        t = random_text(rng)
        parts = [p for p in t.split("\n") if p.strip()]
        rng.shuffle(parts[: len(parts) // 4])
        cases.append((t, [rng.choice([p, p.replace(" ", "  "), "nope"]) for p in parts]))
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(cases)], "i int, t string, c array<string>")
    for r in df.select("i", clauses.locate_clauses(F.col("t"), F.col("c")).alias("s")).collect():
        t, c = cases[r.i]
        assert [(s.clause, s.start, s.end) for s in r.s] == models.locate(t, c)


@pytest.mark.parametrize("patience", [8, -1])
def test_searched_needles_equal_plain_search(monkeypatch, patience):
    monkeypatch.setattr(search.Haystack, "PATIENCE", patience)
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice("ab \n\u2003") for _ in range(rng.randrange(0, 120)))
        cut = lambda: (lambda a: t[a:a + rng.randrange(1, 25)])(rng.randrange(0, len(t) + 1))
        needles = [rng.choice([cut(), cut().replace(" ", "  "), cut() + "zz"]) for _ in range(12)]
        needles = [n for n in needles if n.strip()]
        assert search.locate(t, needles) == models.locate(t, needles), (t, needles)


def test_many_missing_clauses_take_linear_time():
    """Twice the clauses in twice the window: about twice the time, found or not."""
    def seconds(n):
        text = " ".join(f"clause number {i} about\n things." for i in range(n))
        needles = [f"clause number {i} about{' ' if i % 3 else '  '}things{'.' if i % 2 else '?'}" for i in range(n)]
        start = time.process_time()
        found = search.locate(text, needles)
        assert len(found) == n // 2
        return time.process_time() - start

    seconds(500)
    small, large = (min(seconds(n) for _ in range(3)) for n in (4000, 16000))
    assert large < 8 * small


def test_replies_are_parsed_once(spark):
    df = spark.createDataFrame([(1, 0, '["a b", "c"]'), (1, 1, "no list"), (2, 0, None)], "doc_id long, w int, response string")
    good, bad = clauses.split_replies(df)
    assert [tuple(r) for r in good.collect()] == [(1, 0, ["a b", "c"])]
    assert sorted((r.doc_id, r.w, r.response) for r in bad.collect()) == [(1, 1, "no list"), (2, 0, None)]
    for part in (good, bad):
        assert "parse_json" not in part._jdf.queryExecution().toString()
    wins = spark.createDataFrame([(1, 0, 10, "x a b c")], "doc_id long, w int, char_start int, text string")
    docs = structure.with_structure(spark.createDataFrame([(1, "a.md", "md", "z" * 20)], "doc_id long, filename string, format string, full_text string"))
    assert [(r.text, r.char_start) for r in clauses.clause_chunks(wins, good, docs).collect()] == [("a b", 12), ("c", 16)]


def test_folds_across_blocks(spark):
    n = arrays.BLOCK * 3 + 17
    sizes = [(i * 37) % 11 + 1 for i in range(n)]
    df = spark.createDataFrame([(sizes,), ([],), ([5],)], "xs array<int>")
    out = df.select("xs", arrays.prefix_sums(F.col("xs")).alias("sums"),
                    structural_chunks.pack_starts(F.col("xs"), 30).alias("starts")).collect()
    for r in out:
        assert r.sums == [sum(r.xs[: i + 1]) for i in range(len(r.xs))]
        assert r.starts == [g[0] for g in models.packs(list(r.xs), 30)]


def test_long_document_is_linear(spark):
    """20 000 paragraphs in one text: a quadratic fold would not come back."""
    text = "\n\n".join(f"paragraph {i} with some words" for i in range(20_000))
    df = spark.createDataFrame([(0, "x.txt", "txt", text)], "doc_id long, filename string, format string, full_text string")
    out = structural_chunks.structural_chunks(structure.with_structure(df), max_tokens=70)
    want = models.structural(text, 50, 70, (1, 2, 3), True)
    got = out.select("text", "char_start", "char_end", "token_count").orderBy("ord").collect()
    assert [tuple(g) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]


def test_many_headings_are_linear(spark):
    text = "".join(f"# Heading {i}\n\nsome body text of it {i}\n\n" for i in range(20_000))
    df = structure.markdown_structure(
        spark.createDataFrame([(0, "f.md", text)], "doc_id long, filename string, full_text string"))
    got = structural_chunks.structural_chunks(df, min_tokens=1, max_tokens=50).collect()
    assert len(got) == 20_000 and all(text[r.char_start:r.char_end].strip() == r.text for r in got)


def test_overlapping_sections_of_any_number(spark):
    for n in (3, 128, 129, 400):
        secs = [(["root"], 0, 10**6)] + [([f"s{i}"], 10 * i, 10 * i + (3 if i % 2 else 25)) for i in range(1, n)]
        df = spark.createDataFrame([(secs,)], "s array<struct<section_path:array<string>,char_start:int,char_end:int>>")
        probes = df.select("s", F.explode(F.sequence(F.lit(-1), F.lit(10 * n + 40), F.lit(7))).alias("p"))
        for r in probes.select("p", structure.section_at(F.col("s"), F.col("p")).alias("at")).collect():
            want = [path for path, a, b in secs if a <= r.p < b]
            assert r.at == (want[-1] if want else [])
