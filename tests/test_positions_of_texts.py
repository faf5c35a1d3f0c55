"""Many positions of one text: no row may carry all sections of its text."""

from pyspark.sql import functions as F

from corpusloom.operators import structure
from corpusloom.workload import registry
from tests import models


def test_positions_share_their_section(spark):
    for n in (1, 3, 129, 400):
        secs = [(["root"], 0, 10**6)] + [([f"s{i}"], 10 * i, 10 * i + (3 if i % 2 else 25)) for i in range(1, n)]
        df = spark.createDataFrame([(secs,)], "s array<struct<section_path:array<string>,char_start:int,char_end:int>>")
        probes = F.sequence(F.lit(-1), F.lit(10 * n + 400), F.lit(7))
        runs = df.select(structure.sections_of_positions(F.col("s"), probes).alias("r")).first().r
        assert [p for r in runs for p in r.positions] == list(range(-1, 10 * n + 401, 7))
        assert all(0 < len(r.positions) <= structure.POSITIONS for r in runs)
        for r in runs:
            for p in r.positions:
                want = [path for path, a, b in secs if a <= p < b]
                assert r.section_path == (want[-1] if want else [])


def test_positions_of_nothing(spark):
    df = spark.createDataFrame([([], [1]), ([(["a"], 0, 5)], []), (None, [1])],
                               "s array<struct<section_path:array<string>,char_start:int,char_end:int>>, p array<int>")
    got = [r.r for r in df.select(structure.sections_of_positions(F.col("s"), F.col("p")).alias("r")).collect()]
    assert got[0] == [([], [1])] and got[1] == [] and got[2] == [([], [1])]


def test_a_long_text_of_many_headings(spark, tmp_path):
    """A row per probe with all sections in it would be some 15 GB here."""
    lines = [f"{i} " + "x" * 250 for i in range(4000)]
    spark.createDataFrame([(7, "\n".join(lines), "en", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    text = "\n\n".join(("# " if i == 0 else "### " if i % 7 == 0 else "## " if i % 4 == 0 else "") + x
                       for i, x in enumerate(lines))
    got = registry.runner(registry.load()["b7_section_at_position"])(spark, str(tmp_path))
    rows = {r.pos: r.path for r in got.select("pos", F.substring("path", -260, 260).alias("path")).collect()}
    assert sorted(rows) == list(range(0, len(text) + 51, 50))
    secs = models.tree(text)
    for pos in list(rows)[::97]:
        assert rows[pos] == " > ".join(models.path_at(secs, pos))[-260:]


def test_batches_are_bounded(spark):
    """Long texts do not meet in one batch of a Python worker, unless the session says so."""
    from corpusloom import shipping

    key = shipping.BATCH_BYTES[0]
    spark.conf.unset(key)
    shipping.ship_package(spark)
    assert int(spark.conf.get(key)) == int(shipping.BATCH_BYTES[1]) <= 8 << 20
    spark.conf.set(key, "123456")
    shipping.ship_package(spark)
    assert spark.conf.get(key) == "123456"
    spark.conf.unset(key)


def test_splits_cut_each_chunk_once(spark):
    """The halves are read from a file, not cut anew for each use."""
    from corpusloom.operators import edits

    chunks = spark.createDataFrame(
        [(i, 1, "first part\nsecond part", 0, 22, 5, "line", 0.5, None) for i in (1, 2, 3)],
        "chunk_id long, doc_id long, text string, char_start int, char_end int, token_count int, chunk_type string, "
        "boundary_confidence double, manual_override map<string,string>")
    out = edits.split_chunks(chunks, spark.createDataFrame([(1, None), (2, 0), (3, 2), (3, 4), (9, 1)], "chunk_id long, offset int"))
    assert sorted((r.chunk_id, r.text) for r in out.chunks.collect()) == [
        (1, "first part"), (2, "first part\nsecond part"), (3, "first part\nsecond part"), (4, "second part")]
    assert [r.chunk_id for r in out.touched.collect()] == [1]
    assert sorted((r.chunk_id, r.reason) for r in out.rejects.collect()) == [
        (2, "invalid split offset"), (3, "chunk in several edits"), (3, "chunk in several edits"), (9, "chunk not found")]
    assert "reverse(" not in out.chunks._jdf.queryExecution().optimizedPlan().toString()


def test_parts_and_clauses_do_not_carry_sections(spark):
    """Rows of parts and of clauses are made after their paths are known."""
    from corpusloom.operators import clauses, semantic_chunks
    from corpusloom.workload.tables import letter_embedder

    text = "".join(f"# H{i}\n\nOne sentence {i}. Another sentence {i}.\n\n" for i in range(60))
    docs = structure.markdown_structure(spark.createDataFrame(
        [(0, "f.md", text), (1, "g.md", "plain text")], "doc_id long, filename string, full_text string"))
    chunks = semantic_chunks.semantic_chunks(docs, letter_embedder, min_tokens=1, max_tokens=8, spread=False)
    wins = clauses.windows(docs, max_window_tokens=60)
    said = wins.select("doc_id", "w", F.filter(F.split("text", "\n\n"), lambda p: p != "").alias("clauses"))
    cut = clauses.clause_chunks(wins, said, docs)
    secs = {0: models.tree(text), 1: [([], 0, 10)]}
    for out in (chunks, cut):
        got = out.collect()
        assert len(got) > 60 and {r.doc_id for r in got} == {0, 1}
        for r in got:
            assert r.section_path == models.path_at(secs[r.doc_id], r.char_start)
        plan = out._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
        assert "sections#" not in plan
    none = clauses.clause_chunks(wins, said, docs.where("doc_id = 1")).where("doc_id = 0")
    assert none.count() == cut.where("doc_id = 0").count() and none.where("size(section_path) > 0").count() == 0


def test_chunks_without_spans(spark):
    """Labels and vectors read chunks without the fold over lines that finds their places."""
    from corpusloom.workload.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    places = ["char_start", "char_end"]
    full, bare = (df.drop(*places).withColumn("manual_override", F.to_json("manual_override"))
                  for df in (t.chunks(), t._chunks(spans=False)))
    assert full.exceptAll(bare).count() == bare.exceptAll(full).count() == 0
    for df in (t.labels(), t.chunk_embeddings()):
        assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_replies_are_read_once(spark):
    """The JSON of a reply stands once in the plan, however often its value is used."""
    from corpusloom.operators import clauses

    df = spark.createDataFrame([('["a", "b", 3, " "]',), ('x ["c"] y',), ("none",), (None,), ('{"a": 1}',), ("```json\n[]\n```",)],
                               "response string")
    parsed = df.select(clauses._parsed_once(F.col("response")).alias("c"), clauses.parse_clauses(F.col("response")).alias("d"))
    assert [r.c for r in parsed.collect()] == [r.d for r in parsed.collect()] == [["a", "b"], ["c"], None, None, None, []]
    # Whole and between its brackets; in an object once, in an array for its size and its value.
    assert parsed.select("c")._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 6
