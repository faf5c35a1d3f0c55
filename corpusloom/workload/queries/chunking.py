"""Queries for chunkers, runs and edits (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vectors import udf_embedder
from corpusloom.operators import (
    analytics, clauses, edits, runs, semantic_chunks, structural_chunks, structure,
)
from corpusloom.schemas import DNB
from corpusloom.workload.queries.ingest import joined, sha
from corpusloom.workload.registry import query
from corpusloom.workload.sql import cosine, letters
from corpusloom.workload.tables import LETTERS, Tables, letter_embedder

# Sizes that make every branch of the chunkers occur in the given texts.
MIN_TOKENS, MAX_TOKENS = 40, 90
WINDOW_TOKENS = 200
SPACE = "' ' || chr(10)"


def md_docs(t: Tables) -> DataFrame:
    return structure.markdown_structure(t.markdown())


def flat(chunks: DataFrame, *extra: str) -> DataFrame:
    return chunks.select(
        "doc_id", "ord", *extra, sha("text").alias("text_hash"), "char_start", "char_end",
        F.array_join("section_path", " > ").alias("section_path"), "token_count", "boundary_confidence",
    )


# ------------------------------------------------------- structural chunking


def pieces_sql(levels: str) -> list[tuple[str, str]]:
    """C2 over the derived Markdown texts."""
    return [
        ("cuts", f"""SELECT doc_id, 0 AS s FROM md UNION SELECT doc_id, char_start FROM heads WHERE level IN ({levels})"""),
        ("spans", """SELECT c.doc_id, s, coalesce(lead(s) OVER (PARTITION BY c.doc_id ORDER BY s), length(full_text)) AS e, full_text
            FROM cuts c JOIN md ON md.doc_id = c.doc_id"""),
        ("pieces", f"""SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY s) AS pc, s, e,
            trim(substring(full_text, s + 1, e - s), {SPACE}) AS body,
            length(substring(full_text, s + 1, e - s)) - length(ltrim(substring(full_text, s + 1, e - s), {SPACE})) AS lead_n,
            coalesce(path, []::VARCHAR[]) AS path
            FROM spans p LEFT JOIN sections x ON x.doc_id = p.doc_id AND x.char_start <= s AND s < x.char_end
            WHERE trim(substring(full_text, s + 1, e - s), {SPACE}) <> ''"""),
        ("sized", "SELECT *, greatest(1, length(body) // 4) AS tokens FROM pieces"),
    ]


@query("c2_heading_pieces", needs=["md", "heads", "sections"], extra=pieces_sql("1, 2"), sql="""
    SELECT doc_id, pc AS ord, s AS char_start, e AS char_end, sha256(body) AS text_hash,
           array_to_string(path, ' > ') AS section_path FROM pieces""")
def c2(t: Tables) -> DataFrame:
    pieces = structural_chunks.heading_pieces(
        F.col("full_text"), F.col("headings"), F.col("sections"), [1, 2]
    )
    return md_docs(t).select("doc_id", F.posexplode(pieces).alias("pos", "p")).select(
        "doc_id", (F.col("pos") + 1).alias("ord"), F.col("p.start").alias("char_start"),
        F.col("p.end").alias("char_end"), sha("p.text").alias("text_hash"),
        F.array_join("p.path", " > ").alias("section_path"),
    )


def merged_sql(drafts: str) -> list[tuple[str, str]]:
    """Drafts that join their predecessor form one chunk with it."""
    return [
        ("grouped", f"""SELECT *, sum(CASE WHEN joins AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS ord
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pc, sub) AS n FROM {drafts})"""),
        ("structural", """SELECT doc_id, ord::BIGINT AS ord, string_agg(body, chr(10) || chr(10) ORDER BY n) AS body,
            min(s) AS s, arg_max(e, n) AS e, arg_min(path, n) AS path,
            CASE WHEN count(*) = 1 THEN min(tokens)
                 ELSE greatest(1, length(string_agg(body, chr(10) || chr(10) ORDER BY n)) // 4) END AS tokens
            FROM grouped GROUP BY doc_id, ord"""),
    ]


CHUNK_ROWS = """
    SELECT doc_id, ord, sha256(body) AS text_hash, s AS char_start, e AS char_end,
           array_to_string(path, ' > ') AS section_path, tokens AS token_count, NULL::DOUBLE AS boundary_confidence FROM structural"""


@query("c3_merged_small_pieces", needs=["md", "heads", "sections"],
       extra=pieces_sql("1, 2, 3") + [("drafts", f"SELECT *, 1 AS sub, tokens < {MIN_TOKENS} AS joins FROM sized")]
       + merged_sql("drafts"), sql=CHUNK_ROWS)
def c3(t: Tables) -> DataFrame:
    return flat(structural_chunks.structural_chunks(
        md_docs(t), min_tokens=MIN_TOKENS, max_tokens=1_000_000
    ))


PACKED = pieces_sql("1, 2, 3") + [
    # One paragraph per row; the derived texts put exactly one break between them.
    ("paras", f"""SELECT doc_id, pc, s, path, lead_n, unnest(string_split(body, chr(10) || chr(10))) AS para,
        generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS k FROM sized WHERE tokens > {MAX_TOKENS}"""),
    ("psize", f"""SELECT *, greatest(1, length(trim(para, {SPACE})) // 4) AS n,
        sum(length(para) + 2) OVER (PARTITION BY doc_id, pc ORDER BY k) - 2 - length(para)
          + length(para) - length(ltrim(para, {SPACE})) AS pos0 FROM paras"""),
    ("pkept", f"""SELECT *, row_number() OVER (PARTITION BY doc_id, pc ORDER BY k) AS i FROM psize WHERE trim(para, {SPACE}) <> ''"""),
    ("packed", f"""SELECT doc_id, pc, i, n AS used, 1 AS sub FROM pkept WHERE i = 1
        UNION ALL
        SELECT k.doc_id, k.pc, k.i, CASE WHEN p.used + k.n > {MAX_TOKENS} THEN k.n ELSE p.used + k.n END,
               CASE WHEN p.used + k.n > {MAX_TOKENS} THEN p.sub + 1 ELSE p.sub END
        FROM packed p JOIN pkept k ON k.doc_id = p.doc_id AND k.pc = p.pc AND k.i = p.i + 1"""),
    ("drafts", f"""SELECT doc_id, pc, 1 AS sub, body, s, e, path, tokens, tokens < {MIN_TOKENS} AS joins FROM sized WHERE tokens <= {MAX_TOKENS}
        UNION ALL
        SELECT doc_id, pc, sub, string_agg(trim(para, {SPACE}), chr(10) || chr(10) ORDER BY i),
               (min(s) + min(lead_n) + min(pos0))::BIGINT, (min(s) + min(lead_n) + max(pos0 + length(trim(para, {SPACE}))))::BIGINT,
               any_value(path), sum(n)::BIGINT, false
        FROM packed JOIN pkept USING (doc_id, pc, i) GROUP BY doc_id, pc, sub"""),
] + merged_sql("drafts")


@query("c4_structural_chunks", needs=["md", "heads", "sections"], extra=PACKED, sql=CHUNK_ROWS)
def c4(t: Tables) -> DataFrame:
    return flat(structural_chunks.structural_chunks(
        md_docs(t), min_tokens=MIN_TOKENS, max_tokens=MAX_TOKENS
    ))


# Lines of the plain texts packed into chunks: the flagship's chunker.
LINE_TOKENS = 60
LINE_PACKS = [
    ("lsize", """SELECT doc_id, ord AS i, text, greatest(1, length(text) // 4) AS n,
        sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord) - 1 - length(text) AS pos0,
        sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM raw_lines WHERE trim(text) <> ''"""),
    ("lpack", f"""SELECT doc_id, i, n AS used, 1 AS ord FROM lsize WHERE i = 1
        UNION ALL
        SELECT l.doc_id, l.i, CASE WHEN p.used + l.n > {LINE_TOKENS} THEN l.n ELSE p.used + l.n END,
               CASE WHEN p.used + l.n > {LINE_TOKENS} THEN p.ord + 1 ELSE p.ord END
        FROM lpack p JOIN lsize l ON l.doc_id = p.doc_id AND l.i = p.i + 1"""),
    # A text that fits as a whole is one chunk and is counted as a whole.
    ("whole", f"SELECT doc_id FROM documents WHERE greatest(1, length(trim(text, {SPACE})) // 4) <= {LINE_TOKENS}"),
    ("packs", f"""SELECT p.doc_id, ord, string_agg(l.text, chr(10) ORDER BY l.i) AS body, min(pos0)::BIGINT AS s,
        max(pos0 + length(l.text))::BIGINT AS e, sum(n)::BIGINT AS tokens
        FROM lpack p JOIN lsize l USING (doc_id, i) WHERE p.doc_id NOT IN (SELECT doc_id FROM whole) GROUP BY p.doc_id, ord
        UNION ALL SELECT doc_id, 1, trim(text, {SPACE}), 0, length(text), greatest(1, length(trim(text, {SPACE})) // 4)
        FROM documents WHERE doc_id IN (SELECT doc_id FROM whole)"""),
]


def line_packs(t: Tables, docs: DataFrame | None = None) -> DataFrame:
    """The plain texts, packed by line."""
    src = t.documents() if docs is None else docs
    return structural_chunks.structural_chunks(
        structure.with_structure(src), min_tokens=1, max_tokens=LINE_TOKENS, separator="\n"
    )


@query("c4_packed_lines", needs=["raw_lines"], extra=LINE_PACKS, sql="""
    SELECT doc_id, ord, sha256(body) AS text_hash, s AS char_start, e AS char_end, doc_id::VARCHAR AS section_path,
           tokens AS token_count, NULL::DOUBLE AS boundary_confidence FROM packs""")
def c4_lines(t: Tables) -> DataFrame:
    return flat(line_packs(t))


# --------------------------------------------------------- semantic chunking


def sentences_sql(source: str, key: str) -> list[tuple[str, str]]:
    """C5 without look-behind: a mark is put into each break and split on."""
    mark = chr(0xE000)
    return [
        ("broken", rf"""SELECT {key}, txt, replace(regexp_replace(txt, '([.!?]) ([A-Z(\["''])', '\1{mark}\2', 'g'), chr(10), '{mark}') AS m FROM {source}"""),
        ("segs", f"""SELECT {key}, txt, unnest(string_split(m, '{mark}')) AS text, generate_subscripts(string_split(m, '{mark}'), 1) AS k FROM broken"""),
        # Every mark stands for one character; neighbouring marks give empty segments.
        ("sents", f"""SELECT {key}, k, text, pos0 AS s, pos0 + length(text) AS e, row_number() OVER (PARTITION BY {key} ORDER BY k) AS i
            FROM (SELECT {key}, k, text, sum(length(text) + 1) OVER (PARTITION BY {key} ORDER BY k) - 1 - length(text) AS pos0 FROM segs)
            WHERE trim(text, {SPACE}) <> ''"""),
    ]


DOC_SENTENCES = [("src", "SELECT doc_id, text AS txt FROM documents")] + sentences_sql("src", "doc_id")


@query("c5_sentences", extra=DOC_SENTENCES, sql="""
    SELECT doc_id, i AS ord, s::BIGINT AS char_start, e::BIGINT AS char_end, text FROM sents""")
def c5(t: Tables) -> DataFrame:
    return semantic_chunks.sentences(t.given("documents"), "text")


def similar_sql(key: str) -> list[tuple[str, str]]:
    return [
        ("vecs", f"SELECT {key}, i, k, text, s, e, {letters('text')} AS v, greatest(1, length(text) // 4) AS n FROM sents"),
        ("sims", f"""SELECT *, CASE WHEN prev IS NOT NULL THEN {cosine('prev', 'v')} END AS sim
            FROM (SELECT *, lag(v) OVER (PARTITION BY {key} ORDER BY i) AS prev FROM vecs)"""),
    ]


@query("c6_adjacent_similarity", extra=DOC_SENTENCES + similar_sql("doc_id"), sql="""
    SELECT doc_id, i AS ord, round(sim, 6) AS similarity FROM sims WHERE sim IS NOT NULL""")
def c6(t: Tables) -> DataFrame:
    """Spread over tasks by blocks of sentences."""
    d = semantic_chunks.with_sentences(t.documents().select("doc_id", "full_text"))
    scored = semantic_chunks.with_similarities(
        d.select("doc_id", "sentences"), ["doc_id"], letter_embedder, spread=True
    )
    return scored.select("doc_id", F.posexplode("sims")).select(
        "doc_id", (F.col("pos") + 2).alias("ord"), F.round("col", 6).alias("similarity")
    )


SEMANTIC_MIN, SEMANTIC_MAX, THRESHOLD = 30, 150, 0.9


def semantic_sql(key: str, join: str, low: int = SEMANTIC_MIN) -> list[tuple[str, str]]:
    cut = f"(f.used + m.n > {SEMANTIC_MAX} OR (m.sim < {THRESHOLD} AND f.used >= {low}))"
    cols = ", ".join(f"m.{c.strip()}" for c in key.split(","))
    return similar_sql(key) + [
        ("folded", f"""SELECT {key}, i, n AS used, 1 AS part, NULL::DOUBLE AS cut_sim FROM sims WHERE i = 1
            UNION ALL
            SELECT {cols}, m.i, CASE WHEN {cut} THEN m.n ELSE f.used + m.n END,
                   CASE WHEN {cut} THEN f.part + 1 ELSE f.part END, CASE WHEN {cut} THEN m.sim END
            FROM folded f JOIN sims m ON {join} AND m.i = f.i + 1"""),
        ("bounds", f"""SELECT {key}, part, min(s)::BIGINT AS s, max(e)::BIGINT AS e, count(*) AS n_sent, any_value(cut_sim) AS cut_sim
            FROM folded JOIN sims USING ({key}, i) GROUP BY {key}, part"""),
        ("parts", f"""SELECT b.*, coalesce(round(1 - lead(cut_sim) OVER (PARTITION BY {key} ORDER BY part), 3), 1.0) AS conf,
            trim(substring(txt, s + 1, e - s), {SPACE}) AS body,
            CASE WHEN count(*) OVER (PARTITION BY {key}) = 1 AND n_sent = 1 THEN greatest(1, (e - s) // 4)
                 ELSE greatest(1, length(trim(substring(txt, s + 1, e - s), {SPACE})) // 4) END AS tokens
            FROM bounds b JOIN src USING ({key})"""),
    ]


@query("c7_semantic_chunks", extra=DOC_SENTENCES + semantic_sql("doc_id", "m.doc_id = f.doc_id"), sql="""
    SELECT doc_id, part AS ord, sha256(body) AS text_hash, s AS char_start, e AS char_end, doc_id::VARCHAR AS section_path,
           tokens AS token_count, conf AS boundary_confidence FROM parts""")
def c7(t: Tables) -> DataFrame:
    return flat(semantic_chunks.semantic_chunks(
        structure.with_structure(t.documents()), letter_embedder, spread=False, min_tokens=SEMANTIC_MIN,
        max_tokens=SEMANTIC_MAX, similarity_threshold=THRESHOLD,
    ))


def letter_encoder():
    """A model hook of the kind ``udf_embedder`` takes: texts to numpy vectors."""
    import numpy as np

    return lambda texts: np.array([[t.count(x) for x in LETTERS] for t in texts], float).reshape(-1, len(LETTERS))


@query("c7_model_chunks", extra=DOC_SENTENCES + semantic_sql("doc_id", "m.doc_id = f.doc_id"), sql="""
    SELECT doc_id, part AS ord, sha256(body) AS text_hash, s AS char_start, e AS char_end, doc_id::VARCHAR AS section_path,
           tokens AS token_count, conf AS boundary_confidence FROM parts""")
def c7_model(t: Tables) -> DataFrame:
    """As c7, with vectors from a vectorized hook, spread over all tasks."""
    return flat(semantic_chunks.semantic_chunks(
        structure.with_structure(t.documents()), udf_embedder(letter_encoder), min_tokens=SEMANTIC_MIN,
        max_tokens=SEMANTIC_MAX, similarity_threshold=THRESHOLD,
    ))


HYBRID_MAX = SEMANTIC_MAX
HYBRID_PACKED = [(n, s.replace(f"> {MAX_TOKENS}", f"> {HYBRID_MAX}").replace(f"<= {MAX_TOKENS}", f"<= {HYBRID_MAX}"))
                 for n, s in PACKED]


@query("c8_hybrid_chunks", needs=["md", "heads", "sections"], extra=HYBRID_PACKED + [
    ("src", f"SELECT doc_id, ord, body AS txt, s AS base, path FROM structural WHERE tokens > {HYBRID_MAX}"),
] + sentences_sql("src", "doc_id, ord") + semantic_sql("doc_id, ord", "m.doc_id = f.doc_id AND m.ord = f.ord", MIN_TOKENS), sql=f"""
    SELECT doc_id, ord, 1 AS sub_ord, sha256(body) AS text_hash, s AS char_start, e AS char_end, array_to_string(path, ' > ') AS section_path,
           tokens AS token_count, NULL::DOUBLE AS boundary_confidence FROM structural WHERE tokens <= {HYBRID_MAX}
    UNION ALL
    SELECT p.doc_id, p.ord, part, sha256(body), base + s, base + e, array_to_string(path, ' > '), tokens, conf
    FROM parts p JOIN (SELECT doc_id, ord, base, path FROM src) x USING (doc_id, ord)""")
def c8(t: Tables) -> DataFrame:
    return flat(semantic_chunks.hybrid_chunks(
        md_docs(t), letter_embedder, spread=False, min_tokens=MIN_TOKENS, max_tokens=HYBRID_MAX,
        similarity_threshold=THRESHOLD,
    ), "sub_ord")


# ------------------------------------------------------------ clause chunking

WINDOWS = [
    ("wpara", """SELECT doc_id, unnest(string_split(full_text, chr(10) || chr(10))) AS para,
        generate_subscripts(string_split(full_text, chr(10) || chr(10)), 1) AS i FROM md WHERE trim(full_text) <> ''"""),
    ("wsize", "SELECT *, greatest(1, length(para) // 4) AS n FROM wpara"),
    ("wfold", f"""SELECT doc_id, i, n AS used, 0 AS w FROM wsize WHERE i = 1
        UNION ALL
        SELECT s.doc_id, s.i, CASE WHEN f.used + s.n > {WINDOW_TOKENS} THEN s.n ELSE f.used + s.n END,
               CASE WHEN f.used + s.n > {WINDOW_TOKENS} THEN f.w + 1 ELSE f.w END
        FROM wfold f JOIN wsize s ON s.doc_id = f.doc_id AND s.i = f.i + 1"""),
    ("wtext", f"""SELECT doc_id, CASE WHEN length(full_text) // 4 <= {WINDOW_TOKENS} THEN 0 ELSE w END AS w,
        string_agg(para, chr(10) || chr(10) ORDER BY i) AS body
        FROM wfold JOIN wsize USING (doc_id, i) JOIN md USING (doc_id) GROUP BY ALL"""),
    ("wins", """SELECT doc_id, w, body || CASE WHEN w < max(w) OVER (PARTITION BY doc_id) THEN chr(10) || chr(10) ELSE '' END AS text FROM wtext"""),
    ("windows", """SELECT *, (sum(length(text)) OVER (PARTITION BY doc_id ORDER BY w) - length(text))::BIGINT AS char_start,
        (sum(length(text)) OVER (PARTITION BY doc_id ORDER BY w))::BIGINT AS char_end FROM wins"""),
]


def windows_of(t: Tables) -> DataFrame:
    return clauses.windows(t.markdown(), max_window_tokens=WINDOW_TOKENS, keep=["lang"])


@query("c9_token_windows", needs=["md"], extra=WINDOWS,
       sql="SELECT doc_id, w, char_start, char_end, sha256(text) AS text_hash FROM windows")
def c9(t: Tables) -> DataFrame:
    return windows_of(t).select("doc_id", "w", "char_start", "char_end", sha("text").alias("text_hash"))


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("c10_clause_requests", needs=["md"], extra=WINDOWS, sql=f"""
    SELECT doc_id, w, sha256(replace({sql_text(clauses.CLAUSE_PROMPT)}, '{{text}}', text)) AS prompt_hash FROM windows""")
def c10(t: Tables) -> DataFrame:
    return clauses.clause_requests(windows_of(t)).select("doc_id", "w", sha("prompt").alias("prompt_hash"))


def clause_responses(t: Tables) -> DataFrame:
    """Replies that list a window's paragraphs: German ones invent a clause and a
    number, Spanish ones double every space, and some French ones are broken."""
    paras = F.filter(F.split("text", "\n\n", -1), lambda p: F.trim(p) != "")
    said = (
        F.when(F.col("lang") == "de", F.concat(F.array(F.lit("@@ invented @@")), paras, F.array(F.lit(" "))))
        .when(F.col("lang") == "es", F.transform(paras, lambda p: F.replace(p, F.lit(" "), F.lit("  "))))
        .otherwise(paras)
    )
    body = F.to_json(said)
    reply = (
        F.when(F.col("lang") == "de", F.concat(F.lit("Here you are: [1, "), F.substring(body, F.lit(2), F.length(body)), F.lit(" Bye.")))
        .when(F.col("lang") == "es", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when((F.col("lang") == "fr") & (F.col("w") % 3 == 1), F.concat(F.lit('{"a": '), body))
        .otherwise(body)
    )
    return windows_of(t).select("doc_id", "w", reply.alias("response"))


CLAUSES = WINDOWS + [
    ("wl", "SELECT w.*, lang FROM windows w JOIN md USING (doc_id)"),
    ("said", """SELECT doc_id, w, text, char_start, lang, list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '') AS ps FROM wl"""),
    ("parsed", """SELECT doc_id, w, text, char_start, CASE lang WHEN 'de' THEN ['@@ invented @@'] || ps
        WHEN 'es' THEN list_transform(ps, lambda p: replace(p, ' ', '  ')) ELSE ps END AS cl
        FROM said"""),
]


@query("c11_parsed_clauses", needs=["md"], extra=CLAUSES, sql="""
    SELECT doc_id, w, len(cl) AS n_clauses, sha256(array_to_string(cl, '|')) AS clauses_hash FROM parsed""")
def c11(t: Tables) -> DataFrame:
    """A French reply cut off after an opening brace still holds a whole array."""
    parsed = clause_responses(t).withColumn("c", clauses.parse_clauses(F.col("response")))
    return parsed.select("doc_id", "w", F.size("c").alias("n_clauses"), sha(joined("c")).alias("clauses_hash"))


@query("c11_rejected_replies", needs=["md"], extra=CLAUSES, sql="""
    SELECT doc_id, w, CASE WHEN (doc_id + w) % 4 <> 0 THEN len(cl) END AS n_clauses,
           CASE WHEN (doc_id + w) % 4 = 0 THEN 'no JSON array in the reply' END AS reason FROM parsed""")
def c11_rejects(t: Tables) -> DataFrame:
    """Every fourth window is answered in prose; good and rejected replies come from one parse."""
    prose = F.when((F.col("doc_id") + F.col("w")) % 4 == 0, F.concat(F.lit("Sorry, not "), "w", F.lit(".")))
    found = clauses.split_replies(clause_responses(t).withColumn("response", F.coalesce(prose, "response")))
    return found.parsed.select("doc_id", "w", F.size("clauses").alias("n_clauses"), F.lit(None).cast("string").alias("reason")).unionByName(
        found.rejects.select("doc_id", "w", F.lit(None).cast("int").alias("n_clauses"), "reason"))


LOCATED = CLAUSES + [
    ("cl", "SELECT doc_id, w, unnest(cl) AS clause, generate_subscripts(cl, 1) AS i FROM parsed"),
    ("walk", """SELECT doc_id, w, 0::BIGINT AS i, 0::BIGINT AS cursor, NULL::BIGINT AS pos0, ''::VARCHAR AS clause FROM parsed
        UNION ALL
        SELECT doc_id, w, i, CASE WHEN pos0 IS NULL THEN cursor ELSE pos0 + length(clause) END, pos0, clause FROM (
          SELECT k.doc_id, k.w, c.i, k.cursor, c.clause,
            CASE WHEN instr(substring(p.text, k.cursor + 1), c.clause) > 0 THEN k.cursor + instr(substring(p.text, k.cursor + 1), c.clause) - 1
                 WHEN instr(regexp_replace(substring(p.text, k.cursor + 1), '\\s+', ' ', 'g'), trim(regexp_replace(c.clause, '\\s+', ' ', 'g'))) > 0
                 THEN k.cursor + instr(regexp_replace(substring(p.text, k.cursor + 1), '\\s+', ' ', 'g'), trim(regexp_replace(c.clause, '\\s+', ' ', 'g'))) - 1 END AS pos0
          FROM walk k JOIN cl c ON c.doc_id = k.doc_id AND c.w = k.w AND c.i = k.i + 1
          JOIN parsed p ON p.doc_id = k.doc_id AND p.w = k.w)""".replace("\\\\", "\\")),
    ("spans_c", "SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS ord FROM walk WHERE pos0 IS NOT NULL"),
]


@query("c12_located_clauses", needs=["md"], extra=LOCATED, sql="""
    SELECT doc_id, w, ord, pos0 AS start, pos0 + length(clause) AS end, sha256(clause) AS clause_hash FROM spans_c""")
def c12(t: Tables) -> DataFrame:
    replies = windows_of(t).join(clause_responses(t), ["doc_id", "w"])
    spans = clauses.locate_clauses(F.col("text"), clauses.parse_clauses(F.col("response")))
    return replies.select("doc_id", "w", F.posexplode(spans).alias("pos", "s")).select(
        "doc_id", "w", (F.col("pos") + 1).alias("ord"), "s.start", "s.end", sha("s.clause").alias("clause_hash")
    )


@query("c13_clause_chunks", needs=["md", "sections"], extra=LOCATED, sql=f"""
    SELECT c.doc_id, c.w, ord, sha256(trim(clause, {SPACE})) AS text_hash, p.char_start + pos0 AS char_start,
           p.char_start + pos0 + length(clause) AS char_end, coalesce(array_to_string(x.path, ' > '), '') AS section_path,
           greatest(1, length(clause) // 4) AS token_count, 1.0 AS boundary_confidence
    FROM spans_c c JOIN parsed p USING (doc_id, w)
    LEFT JOIN sections x ON x.doc_id = c.doc_id AND x.char_start <= p.char_start + pos0 AND p.char_start + pos0 < x.char_end""")
def c13(t: Tables) -> DataFrame:
    return flat(clauses.clause_chunks(windows_of(t), clause_responses(t), md_docs(t)), "w")


# --------------------------------------------------------------- runs, edits

JOB_NO = 5


@query("c14_chunking_runs", needs=["raw_lines", "runs", "docs"], extra=LINE_PACKS, sql=f"""
    SELECT run_id, doc_id, strategy, '' AS params, NULL::BIGINT AS n_chunks FROM runs WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE lang = 'de')
    UNION ALL
    SELECT ({JOB_NO}::BIGINT << 40) | doc_id, doc_id, 'structural', 'max_tokens={LINE_TOKENS}', coalesce(n, 0)
    FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM packs GROUP BY 1) USING (doc_id) WHERE lang = 'de'""")
def c14(t: Tables) -> DataFrame:
    """German texts chunked anew."""
    docs = t.documents().where("lang = 'de'")
    out = runs.run_chunking(
        t.tables(), docs, line_packs(t, docs), strategy="structural",
        params={"max_tokens": LINE_TOKENS, "_progress": None}, job_no=JOB_NO, started_at="2024-01-01 00:00:00",
    )
    pairs = F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out["chunking_runs"].select(
        "run_id", "doc_id", "strategy", F.coalesce(joined(pairs), F.lit("")).alias("params"), "n_chunks"
    )


@query("c14_chunks_after_run", needs=["raw_lines", "chunks", "docs"], extra=LINE_PACKS, sql=f"""
    SELECT doc_id, run_id, char_start, sha256(text) AS text_hash, token_count FROM chunks
      WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE lang = 'de')
    UNION ALL
    SELECT doc_id, ({JOB_NO}::BIGINT << 40) | doc_id, s, sha256(body), tokens FROM packs
      WHERE doc_id IN (SELECT doc_id FROM docs WHERE lang = 'de')""")
def c14_chunks(t: Tables) -> DataFrame:
    docs = t.documents().where("lang = 'de'")
    out = runs.run_chunking(
        t.tables(), docs, line_packs(t, docs), strategy="structural", params={}, job_no=JOB_NO,
    )
    return out["chunks"].select("doc_id", "run_id", "char_start", sha("text").alias("text_hash"), "token_count")


@query("c15_latest_runs", needs=["latest"], sql="SELECT doc_id, run_id FROM latest")
def c15(t: Tables) -> DataFrame:
    return runs.latest_runs(t.runs())


EDITED = "chunk_id, doc_id, sha256(text) AS text_hash, char_start, char_end, token_count"


def edited(chunks: DataFrame, action: str = "manual_override") -> DataFrame:
    return chunks.select(
        "chunk_id", "doc_id", sha("text").alias("text_hash"), "char_start", "char_end", "token_count",
        F.coalesce(F.col("manual_override")["action"], F.lit("")).alias("action"),
    )


def merge_edits(t: Tables) -> DataFrame:
    """Second and first line of every text; of Spanish texts the first line with that of the next.

    German texts with an even number have chains (2, 1), (2, 3); French ones that
    divide by three merge their first line with itself.
    """
    d = t.given("documents").select("doc_id", "lang")
    first, even = F.col("doc_id") * 1_000_000 + 1, F.col("doc_id") % 2 == 0
    a = F.when(F.col("lang") == "es", first).when(
        (F.col("lang") == "fr") & (F.col("doc_id") % 3 == 0), first).otherwise(first + 1)
    b = F.when(F.col("lang") == "es", first + 1_000_000).otherwise(first)
    one = d.select(a.alias("chunk_id_a"), b.alias("chunk_id_b"))
    chain = d.where((F.col("lang") == "de") & even).select((first + 1).alias("chunk_id_a"), (first + 2).alias("chunk_id_b"))
    return one.unionByName(chain)


MERGES = [
    ("me", """SELECT CASE WHEN lang = 'es' OR (lang = 'fr' AND doc_id % 3 = 0) THEN doc_id * 1000000 + 1 ELSE doc_id * 1000000 + 2 END AS a,
        CASE WHEN lang = 'es' THEN (doc_id + 1) * 1000000 + 1 ELSE doc_id * 1000000 + 1 END AS b FROM documents
        UNION ALL SELECT doc_id * 1000000 + 2, doc_id * 1000000 + 3 FROM documents WHERE lang = 'de' AND doc_id % 2 = 0"""),
    ("mb", """SELECT me.a, me.b, x.text AS xt, y.text AS yt, x.char_start AS xs, y.char_start AS ys, x.char_end AS xe, y.char_end AS ye,
        CASE WHEN x.chunk_id IS NULL OR y.chunk_id IS NULL THEN 'chunk not found'
             WHEN a = b THEN 'chunk merged with itself'
             WHEN x.doc_id <> y.doc_id THEN 'chunks from different documents' END AS alone
        FROM me LEFT JOIN chunks x ON x.chunk_id = a LEFT JOIN chunks y ON y.chunk_id = b"""),
    ("mu", """SELECT id FROM (SELECT a AS id FROM mb WHERE alone IS NULL UNION ALL SELECT b FROM mb WHERE alone IS NULL)
        GROUP BY id HAVING count(*) > 1"""),
    ("mj", """SELECT *, coalesce(alone, CASE WHEN a IN (SELECT id FROM mu) OR b IN (SELECT id FROM mu) THEN 'chunk in several edits' END) AS reason
        FROM mb"""),
    ("mm", """SELECT CASE WHEN xs <= ys THEN a ELSE b END AS keep, CASE WHEN xs <= ys THEN b ELSE a END AS gone,
        CASE WHEN xs <= ys THEN xt || chr(10) || chr(10) || yt ELSE yt || chr(10) || chr(10) || xt END AS body,
        CASE WHEN xs <= ys THEN ye ELSE xe END AS e FROM mj WHERE reason IS NULL"""),
]


@query("c16_merged_chunks", needs=["chunks"], extra=MERGES, sql="""
    SELECT chunk_id, doc_id, sha256(coalesce(body, text)) AS text_hash, char_start, coalesce(e, char_end) AS char_end,
           CASE WHEN body IS NULL THEN token_count ELSE greatest(1, length(body) // 4) END AS token_count,
           CASE WHEN body IS NULL THEN '' ELSE 'merge' END AS action
    FROM chunks LEFT JOIN mm ON keep = chunk_id WHERE chunk_id NOT IN (SELECT gone FROM mm)""")
def c16(t: Tables) -> DataFrame:
    return edited(edits.merge_chunks(t.chunks(), merge_edits(t)).chunks)


@query("c16_merge_rejects", needs=["chunks"], extra=MERGES,
       sql="SELECT a AS chunk_id_a, b AS chunk_id_b, reason FROM mj WHERE reason IS NOT NULL")
def c16_rejects(t: Tables) -> DataFrame:
    return edits.merge_chunks(t.chunks(), merge_edits(t)).rejects


def split_edits(t: Tables) -> DataFrame:
    """The whole-text chunks at their default place, every other one at its number of tokens; some twice."""
    c = t.chunks()
    one = c.select(
        "chunk_id",
        F.when(F.col("chunk_id") % 1_000_000 == 0, F.lit(None)).otherwise(F.col("token_count") - 1).cast("int").alias("offset"),
    )
    return one.unionByName(c.where("chunk_id % 7 = 0").select("chunk_id", F.lit(2).alias("offset")))


SPLITS = [
    ("mids", """SELECT chunk_id, length(text) // 2 AS mid, least(100, length(text) // 2) AS reach, text FROM chunks WHERE ord = 0"""),
    ("mid2", """SELECT chunk_id, mid, instr(substring(text, mid + 1, reach), chr(10)) - 1 AS ahead,
        instr(reverse(substring(text, mid - reach + 2, reach)), chr(10)) - 1 AS behind FROM mids"""),
    ("se", """SELECT c.chunk_id, CASE WHEN ord > 0 THEN token_count - 1
           WHEN ahead >= 0 AND (behind < 0 OR ahead <= behind) THEN mid + ahead + 1
           WHEN behind >= 0 THEN mid - behind + 1 ELSE mid END AS cut FROM chunks c LEFT JOIN mid2 m USING (chunk_id)"""),
    ("sh", f"""SELECT c.*, cut, trim(substring(text, 1, cut), {SPACE}) AS a, trim(substring(text, cut + 1), {SPACE}) AS b,
        CASE WHEN chunk_id % 7 = 0 THEN 'chunk in several edits' WHEN cut <= 0 OR cut >= length(text) THEN 'invalid split offset'
             WHEN trim(substring(text, 1, cut), {SPACE}) = '' OR trim(substring(text, cut + 1), {SPACE}) = '' THEN 'split would leave an empty chunk' END AS reason
        FROM chunks c JOIN se USING (chunk_id)"""),
]


@query("c17_split_chunks", needs=["chunks"], extra=SPLITS, sql="""
    SELECT chunk_id AS source_id, doc_id, sha256(text) AS text_hash, char_start, char_end, token_count, '' AS action FROM sh WHERE reason IS NOT NULL
    UNION ALL SELECT chunk_id, doc_id, sha256(a), char_start, char_start + length(a), greatest(1, length(a) // 4), 'split' FROM sh WHERE reason IS NULL
    UNION ALL SELECT chunk_id, doc_id, sha256(b), char_start + length(a), char_start + length(a) + length(b), greatest(1, length(b) // 4), 'split_result'
      FROM sh WHERE reason IS NULL""")
def c17(t: Tables) -> DataFrame:
    out = edits.split_chunks(t.chunks(), split_edits(t)).chunks
    source = F.coalesce(F.col("manual_override")["original_chunk_id"].cast("long"), F.col("chunk_id"))
    return edited(out.withColumn("chunk_id", source)).withColumnRenamed("chunk_id", "source_id")


@query("c17_split_rejects", needs=["chunks"], extra=SPLITS,
       sql="SELECT chunk_id, reason FROM sh WHERE reason IS NOT NULL UNION ALL SELECT chunk_id, 'chunk in several edits' FROM sh WHERE chunk_id % 7 = 0")
def c17_rejects(t: Tables) -> DataFrame:
    return edits.split_chunks(t.chunks(), split_edits(t)).rejects.select("chunk_id", "reason")


@query("c18_chunk_statistics", needs=["chunks"], sql="""
    SELECT run_id, count(*) AS count, round(avg(token_count), 1) AS mean, median(token_count)::DOUBLE AS median,
           min(token_count) AS min, max(token_count) AS max FROM chunks GROUP BY run_id""")
def c18(t: Tables) -> DataFrame:
    return runs.chunk_statistics(t.chunks())


@query("c18_token_counts", needs=["chunks"], sql="""
    SELECT run_id, token_count, count(*) AS n_chunks FROM chunks GROUP BY run_id, token_count""")
def c18_counts(t: Tables) -> DataFrame:
    return runs.token_count_histogram(t.chunks())


@query("c19_chunk_by_id", needs=["chunks"], sql="SELECT chunk_id, doc_id, char_end FROM chunks WHERE chunk_id = (SELECT max(chunk_id) FROM chunks)")
def c19(t: Tables) -> DataFrame:
    last = t.chunks().agg(F.max("chunk_id").alias("c")).first().c
    return runs.find_chunks(t.chunks(), chunk_id=last).select("chunk_id", "doc_id", "char_end")


@query("c19_chunks_of_document", needs=["chunks"], sql="""
    SELECT chunk_id, doc_id, run_id, char_start FROM chunks WHERE doc_id = (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1)""")
def c19_document(t: Tables) -> DataFrame:
    """All chunks of the longest document, in the order of the text."""
    longest = t.given("documents").orderBy(F.desc("n_chars"), "doc_id").select("doc_id").first()
    found = runs.find_chunks(t.chunks(), doc_id=longest.doc_id if longest else -1, ordered=True)
    return found.select("chunk_id", "doc_id", "run_id", "char_start")


@query("c19_chunks_of_run", needs=["chunks"], sql="SELECT chunk_id, char_start FROM chunks WHERE run_id = (SELECT max(run_id) FROM chunks)")
def c19_run(t: Tables) -> DataFrame:
    newest = t.runs().agg(F.max("run_id").alias("r")).first().r
    return runs.find_chunks(t.chunks(), run_id=newest).select("chunk_id", "char_start")


@query("c20_chunks_after_delete", needs=["live"], sql="SELECT chunk_id, run_id FROM live")
def c20(t: Tables) -> DataFrame:
    """All runs but the newest of each document are deleted."""
    stale = t.runs().join(runs.latest_runs(t.runs()).select("run_id"), "run_id", "left_anti")
    return runs.delete_runs(t.runs(), t.chunks(), stale.select("run_id"))[1].select("chunk_id", "run_id")


@query("c21_chunk_index", needs=["chunks", "docs"], sql="""
    SELECT c.doc_id, run_id, chunk_id, row_number() OVER (PARTITION BY c.doc_id, run_id ORDER BY char_start, chunk_id) AS ord, char_start,
           least(char_end, length(full_text)) AS overlay_end, substring(replace(text, chr(10), ' '), 1, 60) AS preview
    FROM chunks c JOIN docs d ON c.doc_id = d.doc_id""")
def c21(t: Tables) -> DataFrame:
    return runs.chunk_index(t.chunks(), t.documents())


# ------------------------------------------------------------------ flagship

HEALTH = LINE_PACKS + [
    ("said", """SELECT p.doc_id, p.ord, p.tokens, list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END],
        lambda x: x IS NOT NULL) AS cats, (tokens % 101) / 100.0 AS conf FROM packs p JOIN labels q ON q.doc_id = p.doc_id"""),
    ("used", f"""SELECT doc_id, conf, unnest(CASE WHEN len(cats) = 0 THEN ['{DNB}'] ELSE cats END) AS name FROM said"""),
    ("stat", "SELECT name, count(*) AS n, avg(conf) AS conf, count(DISTINCT doc_id) AS docs FROM used GROUP BY name"),
    ("cov", """SELECT coalesce(c.name, s.name) AS name, c.name IS NOT NULL AS in_rubric, coalesce(n, 0) AS count,
        coalesce(conf, 0.0)::DOUBLE AS conf, coalesce(docs, 0) AS docs
        FROM (SELECT name FROM cats WHERE rubric_id = 1) c FULL OUTER JOIN stat s ON c.name = s.name"""),
]


@query("f5_corpus_health", needs=["raw_lines", "cats"], extra=HEALTH, sql="""
    SELECT name, in_rubric, count, round(conf, 6) AS avg_confidence, docs AS doc_count, NOT in_rubric AS orphan,
           in_rubric AND count = 0 AND (SELECT sum(count) FROM cov) > 0 AS dead, in_rubric AND count > 0 AND conf < 0.6 AS low_confidence
    FROM cov""")
def f5_health(t: Tables) -> DataFrame:
    """Texts, packed into chunks, labeled, and reported by category."""
    chunks = line_packs(t).select(
        (F.col("doc_id") * 1_000_000 + F.col("ord")).alias("chunk_id"), "doc_id", "token_count"
    )
    return corpus_health(t.given("labels"), chunks, t.categories(), rubric_id=1).select(
        "name", "in_rubric", "count", F.round("avg_confidence", 6).alias("avg_confidence"),
        "doc_count", "orphan", "dead", "low_confidence",
    )


def corpus_health(given: DataFrame, chunks: DataFrame, categories: DataFrame, *, rubric_id: int) -> DataFrame:
    """Coverage of a rubric by chunks that carry the labels of their document."""
    found = F.filter(
        F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")),
        lambda x: x.isNotNull(),
    )
    labels = chunks.join(given, "doc_id").select(
        F.col("chunk_id").alias("label_id"), "chunk_id", F.lit(rubric_id).alias("rubric_id"),
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DNB))).alias("predicted_categories"),
        ((F.col("token_count") % 101) / 100.0).alias("composite_confidence"), "doc_id",
    )
    return analytics.coverage_flags(
        analytics.category_coverage(labels, None, None, categories, rubric_id)
    )
