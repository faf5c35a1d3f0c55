"""Queries for rubrics, requests, replies and labels (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.vectors import udf_embedder
from corpusloom.operators import labels, requests, responses, rubrics, scoring, vector_store
from corpusloom.schemas import DNB
from corpusloom.workload.queries.chunking import sql_text
from corpusloom.workload.queries.ingest import joined, sha
from corpusloom.workload.registry import query
from corpusloom.workload.sql import cosine, letters
from corpusloom.workload.tables import LETTERS, Tables

# ------------------------------------------------------------------- rubrics


@query("d1_rubric_versions", sql="""
    SELECT event_id AS rubric_id, 'u' || user_id AS name, event_type AS category,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events""")
def d1(t: Tables) -> DataFrame:
    return rubrics.version_rubrics(t.rubric_edits()).select("rubric_id", "name", "category", "version")


@query("d1_latest_rubrics", sql="""
    SELECT max(event_id) AS rubric_id, 'u' || user_id AS name, count(*) AS version FROM events GROUP BY user_id""")
def d1_latest(t: Tables) -> DataFrame:
    versions = rubrics.version_rubrics(t.rubric_edits())
    return rubrics.latest_rubrics(versions).select("rubric_id", "name", "version")


@query("d1_active_rubric", sql="""
    SELECT event_id AS rubric_id, 'u' || user_id AS name FROM events WHERE event_id = (SELECT max(event_id) FROM events)""")
def d1_active(t: Tables) -> DataFrame:
    return rubrics.active_rubric(t.rubric_edits().withColumnRenamed("edit_id", "rubric_id")).select(
        "rubric_id", "name"
    )


@query("d2_rubric_violations", extra=[("c", """
    SELECT (user_id * 24 + hour(ts)) AS rubric_id, CASE WHEN value > 100 THEN NULL WHEN value < 2 THEN ' ' ELSE event_type END AS name FROM events"""),
    ("n", "SELECT rubric_id, name, count(*) AS n FROM c GROUP BY 1, 2"),
    ("g", """SELECT rubric_id, count(*) FILTER (name IS NOT NULL) AS names, count(*) FILTER (name IS NOT NULL AND n > 1) AS repeated,
        count(*) FILTER (trim(name) = '') AS blank FROM n GROUP BY 1""")], sql="""
    SELECT rubric_id, 'no category' AS violation FROM g WHERE names = 0
    UNION ALL SELECT rubric_id, 'category names must be unique' FROM g WHERE repeated > 0
    UNION ALL SELECT rubric_id, 'category name is empty' FROM g WHERE blank > 0""")
def d2(t: Tables) -> DataFrame:
    """Events of a user in one hour of the day as the categories of a rubric."""
    cats = t.given("events").select(
        (F.col("user_id") * 24 + F.hour("ts")).alias("rubric_id"),
        F.when(F.col("value") > 100, F.lit(None)).when(F.col("value") < 2, " ").otherwise(F.col("event_type")).alias("name"),
    )
    return rubrics.validate_rubrics(cats)


# ------------------------------------------------------------------ requests


@query("d3_classification_text", needs=["chunks"], sql="""
    SELECT chunk_id, sha256('[Section: ' || array_to_string(section_path, ' > ') || ']' || chr(10) || chr(10) || text) AS text_hash FROM chunks""")
def d3(t: Tables) -> DataFrame:
    body = requests.classification_text(F.col("section_path"), F.col("text"))
    return t.chunks().select("chunk_id", sha(body).alias("text_hash"))


def prompt_sql(listing: str) -> str:
    return f"{sql_text(requests.SYSTEM_HEAD)} || {listing} || {sql_text(requests.SYSTEM_TAIL)}"


def entry_sql(name: str, definition: str, exemplars: str, cases: str) -> str:
    return f"""'- **' || {name} || '**: ' || {definition}
        || CASE WHEN len({exemplars}) > 0 THEN chr(10) || '  Examples: ' || array_to_string(list_transform({exemplars}[1:3], lambda e: '"' || e || '"'), '; ') ELSE '' END
        || CASE WHEN len({cases}) > 0 THEN chr(10) || '  Boundary cases: ' || array_to_string({cases}[1:2], '; ') ELSE '' END"""


@query("d4_rubric_prompts", needs=["rubric_cats"], sql=f"""
    SELECT ascii(lang) * 256 + ascii(lang[2]) AS rubric_id,
           sha256({prompt_sql("string_agg(" + entry_sql("name", "definition", "exemplars", "boundary_cases") + ", chr(10) || chr(10) ORDER BY name)")}) AS prompt_hash
    FROM rubric_cats GROUP BY lang""")
def d4(t: Tables) -> DataFrame:
    return requests.rubric_prompts(t.rubrics()).select("rubric_id", sha("system_prompt").alias("prompt_hash"))


UNLABELED = "SELECT * FROM live WHERE NOT EXISTS (SELECT 1 FROM labels_e l WHERE l.chunk_id = live.chunk_id AND l.rubric_id = {r})"


@query("d5_classification_requests", needs=["live", "labels_e"], extra=[("todo", UNLABELED.format(r=2))], sql=f"""
    SELECT chunk_id, 2 AS rubric_id,
      sha256({sql_text(requests.USER_HEAD)} || '[Section: ' || array_to_string(section_path, ' > ') || ']' || chr(10) || chr(10) || text) AS user_hash
    FROM todo""")
def d5(t: Tables) -> DataFrame:
    r = requests.classification_requests(t.chunks(), t.runs(), t.labels(), 2)
    return r.select("chunk_id", "rubric_id", sha("user_prompt").alias("user_hash"))


# ------------------------------------------------------------------- replies

REPLIES = [
    ("r", """SELECT l.chunk_id, l.doc_id, l.predicted_categories AS cats, l.conf, l.rationale, l.logprob_signal AS lp,
        CASE WHEN chunk_id % 17 = 0 THEN 'broken' WHEN chunk_id % 13 = 0 THEN 'prose' WHEN chunk_id % 11 = 0 THEN 'fenced'
             WHEN chunk_id % 7 = 0 THEN 'listed' ELSE 'plain' END AS kind FROM labels_e l WHERE label_id = chunk_id"""),
    ("reply", r"""SELECT *, json_object('predicted_categories', cats, 'rationale', rationale)::VARCHAR AS body FROM r"""),
    ("sent", """SELECT *, CASE kind WHEN 'broken' THEN '{broken ' || rationale WHEN 'prose' THEN 'Sure: ' || body || ' Done.'
        WHEN 'fenced' THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 'listed' THEN '[' || body || ']' ELSE body END AS response FROM reply"""),
    ("bare", r"SELECT *, regexp_replace(regexp_replace(response, '^```(?:json)?\s*', ''), '\s*```$', '') AS t FROM sent"),
    ("val", r"""SELECT *, CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '(?s)\{.*\}')) THEN regexp_extract(t, '(?s)\{.*\}') END AS j FROM bare"""),
    ("obj", """SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS found, CASE WHEN json_type(j) = 'OBJECT' THEN json_extract(j, '$.predicted_categories')::VARCHAR[] END AS said,
        CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.rationale') END AS why FROM val"""),
    ("parsed", f"""SELECT *, CASE WHEN len(said) > 0 THEN said ELSE ['{DNB}'] END AS predicted,
        CASE WHEN NOT found THEN '{responses.UNPARSED}' WHEN why = '' THEN '{responses.NO_MATCH}' ELSE why END AS rationale_out,
        CASE WHEN len(said) > 0 THEN conf ELSE 1.0 END AS top FROM obj"""),
    ("scored", """SELECT *, CASE WHEN chunk_id % 5 = 0 THEN NULL ELSE (lp + (lp - 0.5)) / 2 END AS logprob FROM parsed"""),
]


@query("d6_parsed_replies", needs=["labels_e"], extra=REPLIES, sql="""
    SELECT chunk_id, array_to_string(predicted, '|') AS categories, rationale_out AS rationale, found AS parsed,
           round(top, 6) AS top_confidence, len(predicted) AS n_confidences FROM parsed""")
def d6(t: Tables) -> DataFrame:
    p = responses.parse_responses(t.responses())
    return p.select(
        "chunk_id", joined("predicted_categories").alias("categories"), "rationale", "parsed",
        F.round(F.array_max(F.map_values("confidence")), 6).alias("top_confidence"),
        F.size("confidence").alias("n_confidences"),
    )


@query("d7_unlabeled_chunks", needs=["live", "labels_e"],
       sql="SELECT chunk_id, doc_id, char_start FROM (" + UNLABELED.format(r=2) + ")")
def d7(t: Tables) -> DataFrame:
    return labels.unlabeled_chunks(t.chunks(), t.runs(), t.labels(), 2, ordered=True).select(
        "chunk_id", "doc_id", "char_start"
    )


@query("d8_mean_logprob", needs=["labels_e"], extra=REPLIES,
       sql="SELECT chunk_id, round(logprob, 6) AS logprob FROM scored")
def d8(t: Tables) -> DataFrame:
    return t.responses().select(
        "chunk_id", F.round(responses.mean_logprob(F.col("logprobs")), 6).alias("logprob")
    )


def letter_encoder():
    """A stand-in for a model: counts letters."""
    return lambda texts: [[float(x.count(c)) for c in LETTERS] for x in texts]


@query("d9_chunk_embeddings", needs=["chunks"], sql=f"""
    SELECT chunk_id, {len(LETTERS)} AS dim, len(list_filter(v, lambda x: x > 0)) AS n_positive, list_sum(v) AS total,
           list_sum(list_transform(v, lambda x, i: x * i)) AS weighted, 'letters' AS embedding_model
    FROM (SELECT chunk_id, {letters('text')} AS v FROM chunks)""")
def d9(t: Tables) -> DataFrame:
    """Through the vectorized hook, as a model would run."""
    e = scoring.embed_chunks(t.chunks(), udf_embedder(letter_encoder), "letters")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return e.select(
        "chunk_id", F.size("embedding").alias("dim"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"),
        total.alias("total"), weighted.alias("weighted"), "embedding_model",
    )


@query("d9_vectors_by_content", needs=["chunks"], sql=f"""
    SELECT chunk_id, list_sum(v) AS total, NOT known AS added
    FROM (SELECT chunk_id, {letters('text')} AS v, sha256(text) IN (SELECT sha256(text) FROM chunks WHERE lang IN ('en', 'fr')) AS known FROM chunks)""")
def d9_by_content(t: Tables) -> DataFrame:
    """English and French texts are in the store; of the others only texts it has not are embedded, once each."""
    embedder = udf_embedder(letter_encoder)
    old = t.chunks().where(F.element_at("section_path", 2).isin("en", "fr"))
    store = vector_store.embed_by_content(old, vector_store.empty_store(t.spark), embedder, "letters").added
    found = vector_store.embed_by_content(t.chunks(), store, embedder, "letters")
    new = found.added.select("text_hash", F.lit(True).alias("added"))
    hashes = t.chunks().select("chunk_id", text.text_hash(F.col("text")).alias("text_hash")).join(new, "text_hash", "left")
    return found.chunk_embeddings.join(hashes, "chunk_id").select(
        "chunk_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.coalesce("added", F.lit(False)).alias("added"))


CENTROIDS = [
    ("comp", """SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"""),
    ("cm", "SELECT label, i, avg(x::DOUBLE) AS x FROM comp GROUP BY label, i"),
    ("centroid", "SELECT label, list(x ORDER BY i) AS c FROM cm GROUP BY label"),
]


@query("d10_exemplar_centroids", extra=CENTROIDS, sql="""
    SELECT 'c' || label AS category, i - 1 AS i, round(x, 6) AS x FROM cm""")
def d10(t: Tables) -> DataFrame:
    return scoring.exemplar_centroids(t.exemplars()).select("category", F.posexplode("centroid")).select(
        "category", F.col("pos").alias("i"), F.round("col", 6).alias("x")
    )


@query("d11_nearest_centroid", extra=CENTROIDS + [("near", f"""
    SELECT vec_id, arg_max(c.label, [sim, -c.label]) AS nearest FROM (
      SELECT e.vec_id, c.label, {cosine('e.embedding', 'c.c')} AS sim FROM embeddings e, centroid c) c GROUP BY vec_id""")], sql="""
    SELECT e.vec_id, 'c' || nearest AS nearest, CASE WHEN nearest = e.label OR nearest = (e.label + 1) % 10 THEN 1.0 ELSE 0.0 END AS knn_agreement
    FROM embeddings e JOIN near n ON n.vec_id = e.vec_id""")
def d11(t: Tables) -> DataFrame:
    """Every vector, predicted to be of its label or the next one."""
    lab = F.col("label")
    rows = t.given("embeddings").select(
        "vec_id", F.lit(1).cast("long").alias("rubric_id"), "embedding",
        F.array(F.concat(F.lit("c"), lab), F.concat(F.lit("c"), (lab + 1) % 10)).alias("predicted_categories"),
    )
    return scoring.knn_agreement(rows, scoring.exemplar_centroids(t.exemplars())).select(
        "vec_id", "nearest", "knn_agreement"
    )


def composite_sql(top: str, knn: str, lp: str) -> str:
    with_knn = f"""(CASE WHEN {knn} IS NULL THEN {top} WHEN {top} > 0.8 AND {knn} > 0.5 THEN least(1.0, {top} * 1.05)
        WHEN {top} > 0.8 AND {knn} = 0 THEN {top} * 0.7 ELSE {top} * 0.85 END)::DOUBLE"""
    return f"""round(greatest(0.0, least(1.0, CASE WHEN {lp} > -0.5 THEN least(1.0, {with_knn} * 1.03)
        WHEN {lp} < -1.5 THEN {with_knn} * 0.92 ELSE {with_knn} END))::DOUBLE, 6)"""


@query("d12_composite_confidence", needs=["labels_e"], sql=f"""
    SELECT label_id, CASE WHEN len(predicted_categories) = 0 THEN 0.0
      ELSE {composite_sql('conf::DOUBLE', "(CASE label_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END)", 'logprob_signal')} END AS composite FROM labels_e""")
def d12(t: Tables) -> DataFrame:
    knn = F.when(F.col("label_id") % 3 == 0, 1.0).when(F.col("label_id") % 3 == 1, 0.0)
    c = scoring.composite_confidence(F.col("confidence"), knn, F.col("logprob_signal"))
    return t.labels().select("label_id", F.round(c, 6).alias("composite"))


EXEMPLAR_CHUNKS = """SELECT u.c AS category, avg(u.v) AS x, u.i FROM (
    SELECT l.c, unnest(e.embedding) AS v, generate_subscripts(e.embedding, 1) AS i
    FROM (SELECT chunk_id, unnest(predicted_categories) AS c FROM labels_e WHERE rubric_id = 1) l JOIN embs e USING (chunk_id)
    WHERE l.c IN ('quality', 'toxic')) u GROUP BY 1, 3"""


@query("d13_scored_labels", needs=["labels_e", "embs", "cats"], extra=REPLIES + [
    ("xc", EXEMPLAR_CHUNKS),
    ("cen", "SELECT category, list(x ORDER BY i) AS c FROM xc GROUP BY category"),
    ("knn", f"""SELECT chunk_id, arg_max(category, [sim, -pos]) AS nearest FROM (
        SELECT e.chunk_id, cen.category, cats.pos, {cosine('e.embedding', 'cen.c')} AS sim
        FROM embs e, cen JOIN cats ON cats.name = cen.category AND cats.rubric_id = 1) GROUP BY chunk_id"""),
    ("with_knn", """SELECT s.*, CASE WHEN nearest IS NOT NULL THEN CASE WHEN list_contains(predicted, nearest) THEN 1.0 ELSE 0.0 END END AS k
        FROM scored s LEFT JOIN knn USING (chunk_id)"""),
], sql=f"""
    SELECT chunk_id, 1 AS rubric_id, array_to_string(predicted, '|') AS categories, k AS knn_agreement, round(logprob, 6) AS logprob_signal,
           {composite_sql('top::DOUBLE', 'k', 'logprob')} AS composite_confidence, 'm1' AS llm_model, 'job00001' AS llm_run_id FROM with_knn""")
def d13(t: Tables) -> DataFrame:
    """Replies to label rows, with centroids over the vectors of labeled chunks."""
    vecs = t.chunk_embeddings()
    shown = t.labels().where("rubric_id = 1").select("chunk_id", F.explode("predicted_categories").alias("category"))
    cats = t.categories().where("rubric_id = 1 and name in ('quality', 'toxic')").select(
        "rubric_id", F.col("name").alias("category"), F.col("pos").alias("rubric_pos")
    )
    exemplars = shown.join(cats, "category").join(vecs, "chunk_id")
    scored = scoring.score_responses(
        t.responses(), t.chunks(), vecs, scoring.exemplar_centroids(exemplars), rubric_id=1
    )
    rows = labels.assemble_labels(scored, rubric_id=1, llm_model="m1", llm_run_id="job00001")
    return rows.select(
        "chunk_id", "rubric_id", joined("predicted_categories").alias("categories"), "knn_agreement",
        F.round("logprob_signal", 6).alias("logprob_signal"),
        F.round("composite_confidence", 6).alias("composite_confidence"), "llm_model", "llm_run_id",
    )


ATTEMPTS = [
    ("tried", """SELECT chunk_id, max(CASE WHEN token_count % 4 = 0 THEN 0 ELSE 1 END) AS ok FROM chunks WHERE lang IN ('en', 'de') GROUP BY 1"""),
    ("had", "SELECT DISTINCT chunk_id FROM labels_e WHERE rubric_id = 2"),
    ("rep", """SELECT d.doc_id, count(c.chunk_id) AS total, count(h.chunk_id) AS already,
        count(*) FILTER (c.chunk_id IS NOT NULL AND h.chunk_id IS NULL AND ok = 1) AS fresh,
        count(*) FILTER (c.chunk_id IS NOT NULL AND h.chunk_id IS NULL AND ok = 0) AS failed
        FROM documents d LEFT JOIN live c ON c.doc_id = d.doc_id LEFT JOIN had h ON h.chunk_id = c.chunk_id
        LEFT JOIN tried t ON t.chunk_id = c.chunk_id GROUP BY d.doc_id"""),
    ("report", """SELECT doc_id, total, already, already + fresh AS done, failed, total - already - fresh - failed AS remaining,
        CASE WHEN total = 0 THEN 'no chunks' WHEN total - already - fresh - failed > 0 THEN 'cancelled'
             WHEN failed > 0 AND already + fresh = 0 THEN 'failed' ELSE 'done' END AS outcome FROM rep"""),
]


def stage_report(t: Tables) -> DataFrame:
    attempts = t.chunks().where(F.get("section_path", F.lit(1)).isin("en", "de")).select(
        "chunk_id", (F.col("token_count") % 4 != 0).alias("ok")
    )
    return labels.label_stage_report(
        t.documents(), t.chunks(), t.runs(), t.labels(), attempts, 2, cancelled=True
    )


@query("d14_stage_report", needs=["live", "labels_e"], extra=ATTEMPTS,
       sql="SELECT doc_id, total, already, done, failed, remaining, outcome FROM report")
def d14(t: Tables) -> DataFrame:
    """A run cut short: it tried English and German chunks only."""
    return stage_report(t)


@query("d14_stage_totals", needs=["live", "labels_e"], extra=ATTEMPTS,
       sql="SELECT sum(done)::BIGINT AS succeeded, sum(failed)::BIGINT AS failed FROM report")
def d14_totals(t: Tables) -> DataFrame:
    return labels.label_stage_totals(stage_report(t))


# --------------------------------------------------------------- label table


@query("d15_labels_after_document_clear", needs=["labels_e", "docs"], sql="""
    SELECT label_id, rubric_id FROM labels_e WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE lang = 'fr')""")
def d15(t: Tables) -> DataFrame:
    doomed = labels.labels_of_documents(t.labels(), t.chunks(), t.documents().where("lang = 'fr'"))
    return labels.delete_labels(t.labels(), t.reviews(), doomed)[0].select("label_id", "rubric_id")


@query("d15_reviews_after_rubric_clear", needs=["reviews", "labels_e"], sql="""
    SELECT review_id, label_id FROM reviews WHERE label_id NOT IN (SELECT label_id FROM labels_e WHERE rubric_id = 2)""")
def d15_rubric(t: Tables) -> DataFrame:
    doomed = labels.labels_of_rubric(t.labels(), 2)
    return labels.delete_labels(t.labels(), t.reviews(), doomed)[1].select("review_id", "label_id")


@query("d16_labels_without_dnb", needs=["labels_e", "docs"], sql=f"""
    SELECT label_id FROM labels_e WHERE NOT (rubric_id = 1 AND (len(predicted_categories) = 0 OR predicted_categories = ['{DNB}'])
      AND doc_id IN (SELECT doc_id FROM docs WHERE lang <> 'es'))""")
def d16(t: Tables) -> DataFrame:
    doomed = labels.dnb_labels(t.labels(), 1, t.chunks(), t.documents().where("lang <> 'es'"))
    return labels.delete_labels(t.labels(), t.reviews(), doomed)[0].select("label_id")


@query("d17_latest_labels", needs=["labels_e"], sql="""
    SELECT chunk_id, max(label_id) AS label_id, array_to_string(arg_max(predicted_categories, label_id), '|') AS categories
    FROM labels_e WHERE rubric_id = 1 GROUP BY chunk_id""")
def d17(t: Tables) -> DataFrame:
    return labels.latest_labels(t.labels(), 1).select(
        "chunk_id", "label_id", joined("predicted_categories").alias("categories")
    )


@query("d18_labels_of_chunk", needs=["labels_e"], extra=[("c", "SELECT max(chunk_id) AS c FROM labels_e WHERE rubric_id = 2")],
       sql="SELECT label_id, rubric_id, rationale FROM labels_e WHERE chunk_id = (SELECT c FROM c)")
def d18_chunk(t: Tables) -> DataFrame:
    last = t.labels().where("rubric_id = 2").agg(F.max("chunk_id").alias("c")).first().c
    return labels.find_labels(t.labels(), chunk_id=last if last is not None else -1, ordered=True).select(
        "label_id", "rubric_id", "rationale")


@query("d15_labels_of_edited_chunks", needs=["labels_e"], sql="SELECT label_id, chunk_id FROM labels_e WHERE chunk_id % 9 = 0")
def d15_chunks(t: Tables) -> DataFrame:
    edited = t.chunks().where("chunk_id % 9 = 0").select("chunk_id")
    return labels.labels_of_chunks(t.labels(), edited).select("label_id", "chunk_id")


@query("d1_versions_of_rubric", sql="""
    SELECT event_id AS rubric_id, row_number() OVER (ORDER BY event_id) AS version FROM events WHERE user_id = (SELECT max(user_id) FROM events)""")
def d1_list(t: Tables) -> DataFrame:
    """All versions of one user's rubric, oldest first."""
    name = t.rubric_edits().orderBy(F.desc(F.substring("name", 2, 20).cast("long"))).first().name
    versions = rubrics.version_rubrics(t.rubric_edits().where(F.col("name") == name))
    return rubrics.list_versions(versions).select("rubric_id", "version")


@query("d18_labels_of_rubric", needs=["labels_e"],
       sql="SELECT label_id, chunk_id, rationale, llm_run_id FROM labels_e WHERE rubric_id = 2")
def d18(t: Tables) -> DataFrame:
    return labels.find_labels(t.labels(), rubric_id=2).select("label_id", "chunk_id", "rationale", "llm_run_id")
