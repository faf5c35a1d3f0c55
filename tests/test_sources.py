"""Files, doc maps, rubric JSON, stored tables and exports on real folders."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import documents
from corpusloom.schemas import TABLES
from corpusloom.sources import docmap, files, ledger, rubric_json
from corpusloom.sources import tables as store
from corpusloom.sources.rule_trie import RuleTrie


def make(root, names, body="x"):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body, encoding="utf-8")


def chosen(spark, root, rules, **kw):
    (root / "m.docmap").write_text(rules, encoding="utf-8")
    compiled = docmap.load_doc_map(spark, str(root / "m.docmap"), **kw)
    listing = files.list_folder(spark, str(root))
    got = [os.path.relpath(r.path, root) for r in docmap.resolve_doc_map(listing, compiled, ordered=True).collect()]
    missed = [r.pattern for r in docmap.unmatched_rules(listing, compiled).orderBy("line_no").collect()]
    return got, missed


def test_folder_scan(spark, tmp_path):
    make(tmp_path, ["b/x.PDF", "a.md", "a.png", "c d/é (1).txt", "noext", ".md"])
    got = [r.path for r in files.scan_folder(spark, str(tmp_path)).collect()]
    assert got == sorted(str(tmp_path / n) for n in ["b/x.PDF", "a.md", "c d/é (1).txt"])
    with pytest.raises(Exception, match="(?i)path"):
        files.scan_folder(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("rules,want,missed", [
    ("a/*.pdf\nb/z*.txt\n", ["a/x.pdf", "b/z.txt"], []),
    ("a/**/*.pdf\n", ["a/b/c/x.pdf", "a/x.pdf"], []),
    ("a\n!a/b/**\n", ["a/x.pdf", "a/y.docx"], []),
    ("!a/x.pdf\na/*.pdf\n", [], []),
    ("a/*\n", ["a/x.pdf", "a/y.docx"], []),
    ("a/*.pdf\na/x.pdf\n./a/x.pdf\n", ["a/x.pdf"], []),
    ("a/*.pdf\nnone/*.pdf\ngone.txt\n", ["a/x.pdf"], ["none/*.pdf", "gone.txt"]),
    ("a/*.png\n", [], []),
    ("# c\n\n  !  \n!\nb/?.txt\n", ["b/z.txt"], []),
    ("b/*[xyz].txt\n", ["b/z.txt"], []),
    ("b/?[!z]*.txt\n", ["b/(q+).txt", "b/long.txt"], []),
    ("b/*[!z].txt\n", ["b/(q+).txt", "b/long.txt"], []),
    ("b/(q+)*\n", ["b/(q+).txt"], []),
    ("**\n!**/*.txt\n", ["a/b/c/x.pdf", "a/x.pdf", "a/y.docx", "w.md"], []),
    ("*/*.t?t\n", ["b/(q+).txt", "b/long.txt", "b/z.txt"], []),
])
def test_doc_map_rules(spark, tmp_path, rules, want, missed):
    make(tmp_path, ["a/x.pdf", "a/y.docx", "a/i.png", "a/b/c/x.pdf", "b/z.txt", "b/long.txt", "b/(q+).txt", "w.md"])
    assert chosen(spark, tmp_path, rules) == (want, missed)


def test_rule_trie_equals_patterns_of_whole_paths():
    """Random rules and paths, against one regular expression for each rule."""
    rng = random.Random(4)
    seg = lambda: rng.choice(["a", "b", "ab", "*", "a*", "?", "[!b]", "**"])
    as_regex = {"*": "[^/]*", "a*": "a[^/]*", "?": "[^/]", "[!b]": "[^b/]"}
    for _ in range(60):
        rules = [[seg() for _ in range(rng.randrange(1, 5))] for _ in range(12)]
        trie, tests = RuleTrie(), []
        for i, rule in enumerate(rules):
            whole = not any(c in s for s in rule for c in "*?[")
            full = rule + ["*"] * (rule[-1] == "**")
            trie.add(i, [("deep", "") if s == "**" else ("glob", as_regex[s]) if s in as_regex else ("literal", s)
                         for s in full], whole)
            body = "".join("(?:[^/]+/)*" if s == "**" else as_regex.get(s, s) + "/" * (k < len(full) - 1)
                           for k, s in enumerate(full))
            tests.append(re.compile("/" + body + "(?:/.*)?" * whole))
        for _ in range(40):
            path = "/" + "/".join(rng.choice(["a", "b", "ab", "ba", "c"]) for _ in range(rng.randrange(1, 6)))
            assert trie.matches(path) == {i for i, t in enumerate(tests) if t.fullmatch(path)}, (path, rules)


def test_walk_does_not_grow_with_the_number_of_maps():
    def seconds(maps):
        trie = RuleTrie()
        for i in range(maps):
            trie.add(2 * i, [("literal", "share"), ("literal", f"m{i}"), ("glob", r"[^/]*\.md")], False)
            trie.add(2 * i + 1, [("literal", "share"), ("glob", "[^/]*"), ("literal", f"m{i}")], True)
        start = time.process_time()
        for i in range(4000):
            assert trie.matches(f"/share/m{i % 1000}/x.md") == {i % 1000 * 2}
        return time.process_time() - start

    seconds(1000)
    assert min(seconds(50_000) for _ in range(2)) < 5 * min(seconds(1000) for _ in range(2))


def test_maps_dealt_over_several_walks(spark, monkeypatch):
    monkeypatch.setattr(docmap, "TRIE_CHARS", 20)
    maps = spark.createDataFrame([(i, f"d{i % 3}/*.md\n!d{i % 3}/{i}.md") for i in range(9)], "m int, value string")
    rules = docmap.compile_patterns(docmap.expand_patterns(docmap.parse_doc_map(maps, ["m"]), "/s", home="/h"))
    listing = spark.createDataFrame([(f"/s/d{i % 3}/{i}.md",) for i in range(9)], "path string")
    got = {(r.m, r.path) for r in docmap.resolve_doc_map(listing, rules, keys=["m"]).collect()}
    assert got == {(m, f"/s/d{i % 3}/{i}.md") for m in range(9) for i in range(9) if m % 3 == i % 3 and m != i}
    assert docmap.unmatched_rules(listing.limit(0), rules, keys=["m"]).count() == 9


def test_doc_map_variables_home_and_absolute(spark, tmp_path):
    make(tmp_path, ["v/x.pdf", "home/P/y.pdf", "abs/z.pdf"])
    rules = f"$ROOT/*.pdf\n${{ROOT}}x/*.pdf\n$UNSET/*.pdf\n~/P/*.pdf\n{tmp_path}/abs/*.pdf\n"
    got, missed = chosen(spark, tmp_path, rules, home=str(tmp_path / "home"), env={"ROOT": str(tmp_path / "v")})
    assert got == ["abs/z.pdf", "home/P/y.pdf", "v/x.pdf"]
    assert missed == ["${ROOT}x/*.pdf", "$UNSET/*.pdf"]


def test_doc_map_lines(spark, tmp_path):
    p = tmp_path / "d.docmap"
    p.write_text("\n  # comment\r\n  a/*.pdf\n\n  !drafts/**  \n!\n", encoding="utf-8")
    rules = docmap.parse_doc_map(spark.read.text(str(p), wholetext=True))
    assert [tuple(r) for r in rules.collect()] == [(3, "a/*.pdf", False), (5, "drafts/**", True)]
    with pytest.raises(Exception):
        docmap.load_doc_map(spark, str(tmp_path / "none")).collect()


def test_conversion(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\r\nbody\r## U\n")
    (tmp_path / "b.txt").write_bytes("caf\xe9\r\nx".encode("latin-1"))
    (tmp_path / "c.md").write_bytes(b"# \xff\xfe bad")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    good, bad = files.convert_files(files.read_files(spark, str(tmp_path)))
    rows = {r.filename: r for r in good.collect()}
    assert rows["a.md"].full_text == "# T\nbody\n## U\n"
    assert [h.text for h in rows["a.md"].headings] == ["T", "U"]
    assert rows["a.md"].source_hash == hashlib.sha256(b"# T\r\nbody\r## U\n").hexdigest()
    assert rows["a.md"].metadata["clean_text_length"] == str(len("T\nbody\nU"))
    assert rows["b.txt"].full_text == "café\nx" and rows["b.txt"].sections[0].section_path == ["b"]
    assert {os.path.basename(r.path): r.error for r in bad.collect()} == {
        "c.md": "not valid UTF-8", "d.pdf": "unsupported format: .pdf"}


def test_rubric_json(spark):
    texts = {
        "object": '{"name": "r", "categories": [{"name": "a", "exemplars": ["x"], "parent": "p"}, {"name": "b", "confidence_threshold": 0.5}]}',
        "array": '[{"name": "a", "definition": "d"}]',
        "empty": "{}",
        "number": "3", "broken": '{"categories": [', "trailing": '[{"name": "a"}] x',
        "not objects": '["a"]', "nameless": '[{"definition": "d"}]',
    }
    good, bad = rubric_json.parse_rubrics(spark.createDataFrame(list(texts.items()), "k string, json string"))
    rows = {r.k: [c.asDict() for c in r.categories] for r in good.collect()}
    assert rows["object"][0] == {"name": "a", "definition": "", "exemplars": ["x"], "boundary_cases": [],
                                 "confidence_threshold": 0.85, "parent": "p"}
    assert rows["object"][1]["confidence_threshold"] == 0.5 and rows["array"][0]["definition"] == "d"
    assert rows["empty"] == []
    assert {r.k: r.reason for r in bad.collect()} == {
        "number": "JSON must be an object or array", "broken": "invalid JSON", "trailing": "invalid JSON",
        "not objects": "each category must be an object", "nameless": "each category must have a name"}


def test_identity(spark):
    schema = "doc_id long, filename string, metadata map<string,string>, source_hash string, full_text string"
    existing = spark.createDataFrame([
        (1, "a.txt", {"source": "/x/a.txt"}, "h1", "one"),
        (2, "b.txt", {"source": "/x/b.txt", "k": "v"}, "h2", "two"),
        (3, "legacy.txt", {"source": "/x/legacy.txt"}, None, "three"),
        (4, "both.txt", {}, "h9", "nine"), (5, "both.txt", {}, None, "ten"),
    ], schema)
    incoming = spark.createDataFrame([
        ("/x/a.txt", "h1", "one"),                                   # unchanged
        ("/y/b2.txt", "h2", "two"),                                  # moved
        ("/y/legacy.txt", "h3", "3"), ("/z/legacy.txt", "h4", "4"),  # one of them takes the row
        ("/y/both.txt", "h5", "5"),                                  # oldest of that name has a hash
        ("/n/c1.txt", "aa", "new"), ("/n/c2.txt", "aa", "new"), ("/n/c0.txt", "aa", "new"),
    ], "path string, source_hash string, full_text string")
    outcome = documents.identify_documents(existing, incoming)
    got = {r.source_hash: (r.action, r.doc_id, r.path) for r in outcome.collect()}
    assert got["h1"] == ("unchanged", 1, "/x/a.txt") and got["h2"] == ("moved", 2, "/y/b2.txt")
    assert got["h3"] == ("backfilled", 3, "/y/legacy.txt")
    assert {got[h][0] for h in ("h4", "h5", "aa")} == {"inserted"}
    assert sorted(got[h][1] for h in ("h4", "h5", "aa")) == [6, 7, 8]
    assert got["aa"][2] == "/n/c2.txt"
    after = {r.doc_id: r for r in documents.upsert_documents(existing, outcome, incoming).collect()}
    assert len(after) == 8
    assert (after[2].filename, after[2].metadata) == ("b2.txt", {"source": "/y/b2.txt", "k": "v"})
    assert after[3].source_hash == "h3" and after[3].metadata["source"] == "/x/legacy.txt"
    assert after[got["aa"][1]].full_text == "new" and after[got["aa"][1]].filename == "c2.txt"
    # A second ingest of the same files settles: nothing new.
    again = documents.identify_documents(documents.upsert_documents(existing, outcome, incoming), incoming)
    assert "inserted" not in {r.action for r in again.collect()}


def test_stored_tables(spark, tmp_path, rows):
    path = str(tmp_path / "chunks")
    df = spark.range(100).select(
        (F.col("id") * 10).alias("chunk_id"), (F.col("id") % 7).alias("doc_id"),
        F.array(F.lit("s")).alias("section_path"), F.create_map(F.lit("a"), F.lit("b")).alias("manual_override"))
    store.append_table(df, path, "chunks", buckets=4)
    back = store.read_table(spark, path, "chunks")
    assert back.count() == 100 and set(back.columns) == {"chunk_id", "doc_id", "run_id", "text", "char_start", "char_end",
        "section_path", "token_count", "chunk_type", "boundary_confidence", "manual_override"}
    one = df.where("doc_id = 3").withColumn("chunk_id", F.col("chunk_id") + 1)
    bucket = store.doc_bucket(4)
    same = [r.doc_id for r in df.select("doc_id", bucket.alias("b")).distinct().collect()
            if r.b == one.select(bucket.alias("b")).first().b]
    store.replace_buckets(one, path, "chunks", buckets=4)
    left = store.read_table(spark, path, "chunks")
    assert left.where("doc_id = 3").count() == one.count()
    assert left.where(~F.col("doc_id").isin(same)).count() == df.where(~F.col("doc_id").isin(same)).count()
    some = df.where("doc_id in (1, 2)")
    only = store.touched_buckets(some, buckets=4)
    part = store.read_table(spark, path, "chunks", only=only)
    assert some.join(part, "chunk_id", "left_anti").count() == 0
    assert {r.b for r in part.select(bucket.alias("b")).distinct().collect()} == set(only)
    for name in TABLES:
        empty = spark.range(0).select(F.col("id").alias("chunk_id"))
        store.append_table(empty, str(tmp_path / name), name)


def test_text_functions(spark):
    cases = ["  hello   world  ", "a\n\nb\tc  d\x1ce", "short", "x" * 300, "One. Two", "no end", "A!\nB", "", "```json\n{}\n```"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    c = F.col("t")
    out = {r.t: r for r in df.select("t", text.normalize_whitespace(c).alias("n"), text.truncate(c, 10).alias("s"),
           text.first_sentence(c).alias("f"), text.text_hash(c).alias("h"), text.strip_fences(c).alias("u"),
           text.estimate_tokens(c).alias("k"), text.is_blank(c).alias("b")).collect()}
    for t in cases:
        assert out[t].n == " ".join(t.split()) and out[t].h == hashlib.sha256(t.encode()).hexdigest()
        assert out[t].k == max(1, len(t) // 4) and out[t].b == (not t.strip())
    assert out["x" * 300].s == "xxxxxxx..." and out["One. Two"].f == "One." and out["A!\nB"].f == "A!"
    assert out["no end"].f == "no end" and out["x" * 300].f == "x" * 200
    assert out["```json\n{}\n```"].u == "{}"
    json.loads(out["```json\n{}\n```"].u)


def test_opened_files(spark, tmp_path):
    make(tmp_path, ["c d/é (1).txt", "b.MD", "x.pdf"], "é\r\nz")
    (tmp_path / "l.txt").write_bytes(b"caf\xe9")
    (tmp_path / "l.md").write_bytes(b"caf\xe9")
    names = ["c d/é (1).txt", "b.MD", "x.pdf", "l.txt", "l.md", "none.txt"]
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in names], "path string")
    got = {os.path.relpath(r.path, tmp_path): r for r in files.judged_files(files.open_files(paths)).collect()}
    assert [got[n].full_text for n in names] == ["é\nz", "é\nz", None, "café", None, None]
    assert [got[n].error for n in names[:5]] == [None, None, "unsupported format: .pdf", None, "not valid UTF-8"]
    assert "cannot be read" in got["none.txt"].error and got["none.txt"].source_hash is None
    assert got["x.pdf"].source_hash == hashlib.sha256("é\r\nz".encode()).hexdigest()


def test_ledger_knows_unchanged_files(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = lambda r, c: spark.createDataFrame(r, c).withColumn("modified_at", F.to_timestamp("modified_at"))
    old = rows([("/a", 1, at(1), "ha"), ("/a", 1, at(0), "older"), ("/b", 1, at(1), "hb"), ("/c", 1, at(1), "hc")],
               "path string, length long, modified_at string, source_hash string")
    listing = rows([("/a", 1, at(1)), ("/b", 2, at(1)), ("/c", 1, at(2)), ("/d", 1, at(1))],
                   "path string, length long, modified_at string")
    known = {r.path: r.source_hash for r in ledger.with_known_hashes(listing, old).collect()}
    assert known == {"/a": "ha", "/b": None, "/c": None, "/d": None}
    opened = spark.createDataFrame([("/b", "h2"), ("/d", None)], "path string, source_hash string")
    after = {(r.path, r.length, r.source_hash) for r in ledger.ledger_after(old, listing, opened).collect()}
    assert after == {("/a", 1, "ha"), ("/a", 1, "older"), ("/c", 1, "hc"), ("/b", 2, "h2")}


def test_joined_rules_equal_the_walk(spark, monkeypatch):
    """Random maps, joined and walked; deep, whole and anchorless rules, odd names, a null key."""
    rng = random.Random(11)
    names = ["a", "b", "ab", "b.md", "a(1).md", "ba.md", "c.txt"]
    seg = lambda: rng.choice([*names, "*", "a*", "?", "[!b]*", "**", "*.md", "b?md", "a(1)*"])
    rule = lambda: rng.choice(["", "!"]) * (rng.random() < 0.4) + rng.choice(["", "/"]) + "/".join(
        seg() for _ in range(rng.randrange(1, 4)))
    maps = [(None if i == 0 else i, "\n".join(rule() for _ in range(6))) for i in range(40)] + [(50, "/**"), (51, "/*/*\n!/s/a")]
    paths = {"/" + "/".join([rng.choice(["s", "a", "t"]), *rng.choices(names, k=rng.randrange(1, 5))]) for _ in range(300)}
    rules = docmap.compile_patterns(docmap.expand_patterns(docmap.parse_doc_map(
        spark.createDataFrame(maps, "m int, value string"), ["m"]), "/s", home="/h"))
    listing = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")

    def both():
        found = docmap.resolve_doc_map(listing, rules, keys=["m"])
        missed = docmap.unmatched_rules(listing, rules, keys=["m"])
        return sorted(map(tuple, found.collect()), key=repr), sorted(map(tuple, missed.collect()), key=repr)

    walked = both()
    monkeypatch.setattr(docmap, "TRIE_CHARS", 0)
    assert both() == walked and len(walked[0]) > 500 and walked[1]


def test_walk_does_not_test_every_pattern_of_a_folder():
    def seconds(maps):
        trie = RuleTrie()
        for i in range(maps):
            trie.add(i, [("literal", "share"), ("glob", rf"{i:05}\.[^/]*")], False)
        start = time.process_time()
        for i in range(1000):
            assert trie.matches(f"/share/{i:05}.md") == {i}
        return time.process_time() - start

    assert min(seconds(20_000) for _ in range(2)) < 5 * min(seconds(1000) for _ in range(2))
