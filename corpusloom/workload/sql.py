"""DuckDB twins of the derived tables, as named common table expressions."""

from __future__ import annotations

from corpusloom.schemas import DNB
from corpusloom.workload.tables import LETTERS

LETTER_VECTOR = "[" + ", ".join(
    f"(length({{t}}) - length(replace({{t}}, '{x}', '')))::DOUBLE" for x in LETTERS
) + "]"


def letters(t: str) -> str:
    return LETTER_VECTOR.replace("{t}", t)


def cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}) + 1e-8))"


# name: (names it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), """
        SELECT doc_id, source || '/' || doc_id || '.txt' AS filename, 'txt' AS format,
               text AS full_text, lang, source,
               CASE WHEN n_chars < 20 THEN 'failed' WHEN n_chars < 100 THEN 'warnings' ELSE 'parsed' END AS status,
               sha256(text) AS source_hash
        FROM documents"""),
    "md": ((), r"""
        SELECT doc_id, lang, source, source || '/' || doc_id || '.md' AS filename,
               list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i:
                 CASE WHEN i = 1 THEN '# ' WHEN (i - 1) % 7 = 0 THEN '### ' WHEN (i - 1) % 4 = 0 THEN '## ' ELSE '' END || x),
                 'string_agg', chr(10) || chr(10)) AS full_text
        FROM documents"""),
    "runs": ((), """
        SELECT doc_id * 2 + 1 AS run_id, doc_id, 'lines' AS strategy FROM documents
        UNION ALL SELECT doc_id * 2, doc_id, 'whole' FROM documents WHERE lang = 'fr'"""),
    "raw_lines": ((), """
        SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents"""),
    "chunks": (("raw_lines",), """
        SELECT doc_id * 1000000 + ord AS chunk_id, doc_id, doc_id * 2 + CASE WHEN ord = 0 THEN 0 ELSE 1 END AS run_id,
               text, char_start, char_end, [source, lang] AS section_path, lang, source,
               greatest(1, length(text) // 4) AS token_count, 'line' AS chunk_type,
               (ord % 10) / 10.0 AS boundary_confidence, ord
        FROM (
          SELECT doc_id, lang, source, ord, text,
                 (sum(length(text) + 1) OVER w - 1 - length(text))::BIGINT AS char_start,
                 (sum(length(text) + 1) OVER w - 1)::BIGINT AS char_end
          FROM raw_lines WINDOW w AS (PARTITION BY doc_id ORDER BY ord)
          UNION ALL
          SELECT doc_id, lang, source, 0, text, 0, length(text) FROM documents WHERE lang = 'fr')
        WHERE ord = 0 OR trim(text) <> ''"""),
    "labels_e": (("chunks",), f"""
        SELECT chunk_id + kind AS label_id, chunk_id, doc_id, rubric_id, cats AS predicted_categories, conf,
               'because of ' || coalesce(list_aggregate(cats, 'string_agg', '+'), '') AS rationale,
               -(chunk_id % 23) / 10.0 AS logprob_signal,
               CASE WHEN length(text) >= 12 THEN conf END AS composite_confidence,
               'run' || (doc_id % 7) AS llm_run_id
        FROM (
          SELECT c.chunk_id, c.doc_id, c.text, 0 AS kind, 1 AS rubric_id, (c.chunk_id * 37) % 101 / 100.0 AS conf,
                 CASE WHEN quality = 1 OR toxic = 1 OR token_count > 60 THEN
                        list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END,
                                     CASE WHEN token_count > 60 THEN 'lengthy' END], lambda x: x IS NOT NULL)
                      WHEN token_count < 10 THEN []::VARCHAR[] ELSE ['{DNB}'] END AS cats
          FROM chunks c JOIN labels q ON c.doc_id = q.doc_id
          UNION ALL
          SELECT c.chunk_id, c.doc_id, c.text, 250000, 1, (c.chunk_id * 53) % 101 / 100.0, ['toxic']
          FROM chunks c JOIN labels q ON c.doc_id = q.doc_id WHERE toxic = 1
          UNION ALL
          SELECT c.chunk_id, c.doc_id, c.text, 500000, 2, (c.chunk_id * 29) % 101 / 100.0,
                 [CASE WHEN token_count > 60 THEN 'other' ELSE 'quality' END]
          FROM chunks c JOIN labels q ON c.doc_id = q.doc_id WHERE quality = 1)"""),
    "review_log": (("labels_e",), """
        SELECT review_id, e.label_id, reviewer, action,
               CASE WHEN action IN ('accept', 'bypassed') THEN l.predicted_categories
                    WHEN action = 'correct' THEN CASE WHEN value >= 20 THEN ['quality'] ELSE ['toxic', 'quality'] END
                    ELSE []::VARCHAR[] END AS final_categories, notes, reviewed_at
        FROM (SELECT event_id AS review_id, event_id % (SELECT count(*) FROM documents) * 1000000 + 1 + (event_id // (SELECT count(*) FROM documents)) % 3 AS label_id, 'u' || user_id AS reviewer,
                     CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'correct' WHEN 'view' THEN 'skip'
                          WHEN 'error' THEN 'flag' ELSE 'bypassed' END AS action,
                     value, props AS notes, ts AS reviewed_at FROM events) e
        JOIN labels_e l ON e.label_id = l.label_id"""),
    "reviews": (("review_log",), """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY reviewed_at DESC, review_id DESC) AS rn
        FROM review_log) WHERE rn = 1"""),
    "latest": (("runs",), "SELECT doc_id, max(run_id) AS run_id FROM runs GROUP BY doc_id"),
    "live": (("chunks", "latest"), "SELECT * FROM chunks WHERE run_id IN (SELECT run_id FROM latest)"),
    "cats": ((), """
        SELECT 1 AS rubric_id, 0 AS pos, 'quality' AS name UNION ALL SELECT 1, 1, 'toxic' UNION ALL SELECT 1, 2, 'unused'
        UNION ALL SELECT 2, 0, 'quality' UNION ALL SELECT 2, 1, 'toxic' UNION ALL SELECT 2, 2, 'unused' UNION ALL SELECT 2, 3, 'other'"""),
    "rubric_cats": ((), """
        SELECT lang, source AS name, 'Texts from ' || source || ' in ' || lang AS definition,
               CASE WHEN count(*) > 1 THEN [min(text), max(text)] ELSE [min(text)] END AS exemplars,
               CASE WHEN max(n_chars) > 5000 THEN [max(text)] ELSE []::VARCHAR[] END AS boundary_cases
        FROM documents GROUP BY lang, source"""),
    "status": (("docs", "chunks", "labels_e", "reviews"), """
        SELECT d.doc_id, d.filename, d.status, count(DISTINCT c.chunk_id) AS chunk_count,
               count(DISTINCT l.label_id) AS label_count,
               count(DISTINCT CASE WHEN r.review_id IS NOT NULL THEN l.label_id END) AS reviewed_count
        FROM docs d LEFT JOIN chunks c ON d.doc_id = c.doc_id LEFT JOIN labels_e l ON c.chunk_id = l.chunk_id
        LEFT JOIN reviews r ON l.label_id = r.label_id GROUP BY d.doc_id, d.filename, d.status"""),
    "coverage": (("labels_e", "chunks", "reviews", "cats"), """
        SELECT coalesce(c.name, s.name) AS name, c.name IS NOT NULL AS in_rubric, coalesce(n, 0) AS count,
               coalesce(avg_conf, 0.0) AS avg_confidence, coalesce(docs, 0) AS doc_count,
               coalesce(revs, 0) AS review_count, coalesce(corrected / nullif(revs, 0), 0.0) AS disagree_pct
        FROM (SELECT name FROM cats WHERE rubric_id = 1) c FULL OUTER JOIN (
          SELECT name, count(*) AS n, avg(coalesce(composite_confidence, 0.0)) AS avg_conf, count(DISTINCT doc_id) AS docs,
                 count(action) AS revs, count(*) FILTER (action = 'correct') AS corrected
          FROM (SELECT unnest(l.predicted_categories) AS name, l.composite_confidence, c.doc_id, r.action
                FROM labels_e l JOIN chunks c ON l.chunk_id = c.chunk_id LEFT JOIN reviews r ON l.label_id = r.label_id
                WHERE l.rubric_id = 1) GROUP BY name) s ON c.name = s.name"""),
    "embs": (("chunks",), f"""
        SELECT chunk_id, doc_id, {letters('text')} AS embedding, 'letters-' || lang AS embedding_model
        FROM chunks WHERE lang <> 'de'"""),
    "listing": ((), r"""
        SELECT '/share/' || lang || '/' || source || '/' || doc_id || CASE WHEN n_chars > 5000 THEN '.PDF'
                 WHEN n_chars > 2000 THEN '.md' WHEN n_chars > 1000 THEN '.txt' ELSE '.png' END AS path FROM documents
        UNION ALL SELECT '/share/web/' || regexp_replace(url, '^https?://|[?#].*$', '', 'g') || '.html' FROM pages
        UNION ALL SELECT '/share/chat/' || conv_id || '/' || role || '/' || turn || '.text' FROM conversations"""),
    "heads": (("md",), r"""
        SELECT doc_id, k, m AS mark, len(regexp_extract(m, '^#+')) AS level,
               trim(regexp_replace(m, '^#{1,6} +', '')) AS title,
               (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m))::BIGINT AS char_start,
               (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS char_end
        FROM (SELECT doc_id, unnest(regexp_extract_all(full_text, '(?m)^#{1,6} +.+$')) AS m,
                     unnest(list_slice(string_split_regex(full_text, '(?m)^#{1,6} +.+$'), 1,
                            len(regexp_extract_all(full_text, '(?m)^#{1,6} +.+$')))) AS g,
                     generate_subscripts(regexp_extract_all(full_text, '(?m)^#{1,6} +.+$'), 1) AS k FROM md)"""),
    "paths": (("heads",), """
        SELECT doc_id, k, list_slice([]::VARCHAR[], 1, 0) || [title] AS path FROM heads WHERE k = 1
        UNION ALL
        SELECT h.doc_id, h.k, list_slice(p.path, 1, least(len(p.path), h.level - 1)) || [h.title]
        FROM paths p JOIN heads h ON h.doc_id = p.doc_id AND h.k = p.k + 1"""),
    "sections": (("heads", "paths", "md"), """
        SELECT h.doc_id, h.k, p.path, h.char_start,
               coalesce(lead(h.char_start) OVER (PARTITION BY h.doc_id ORDER BY h.k), length(m.full_text)) AS char_end
        FROM heads h JOIN paths p USING (doc_id, k) JOIN md m ON m.doc_id = h.doc_id
        UNION ALL
        SELECT doc_id, 1, []::VARCHAR[], 0, length(full_text) FROM md WHERE doc_id NOT IN (SELECT doc_id FROM heads)"""),
}


def compose(needs: tuple[str, ...] | list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``body`` behind the expressions it needs, in order of dependence."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in CTES[name][0]:
                visit(dep)
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in ordered]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in extra]
    return (f"WITH RECURSIVE {', '.join(parts)}\n" if parts else "") + body.strip()
