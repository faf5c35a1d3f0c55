"""Engine tables derived from the given Parquet tables.

Every rule is a function of the given columns and has a DuckDB twin in
``workload/sql.py``. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.operators.reviews import current_reviews
from corpusloom.schemas import DNB

PROJECT_UUID = "6f1c2f0a-51d1-4c43-9f0e-2f2b9a3d7c11"
OTHER_PROJECT_UUID = "0b8a4b52-7f7f-4a0e-8f57-6c3f2f1f9d10"
# The frequent letters of all four languages of the texts.
LETTERS = "aeinorst"


class Tables:
    """Lazy engine tables over one folder of the given data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        """One row per text; ids, names and status follow from its columns."""
        n = F.col("n_chars")
        return self.given("documents").select(
            "doc_id",
            F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("filename"),
            F.lit("txt").alias("format"),
            F.col("text").alias("full_text"),
            "lang",
            "source",
            F.when(n < 20, "failed").when(n < 100, "warnings").otherwise("parsed").alias("status"),
            F.sha2("text", 256).alias("source_hash"),
        )

    def markdown(self) -> DataFrame:
        """The texts as Markdown: every line a paragraph, some of them headings."""
        mark = lambda i: (
            F.when(i == 0, "# ").when(i % 7 == 0, "### ").when(i % 4 == 0, "## ").otherwise("")
        )
        lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(mark(i), x))
        return self.given("documents").select(
            "doc_id", "lang", "source",
            F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("filename"),
            F.lit("md").alias("format"),
            F.array_join(lines, "\n\n").alias("full_text"),
        )

    def runs(self) -> DataFrame:
        """A run per document, and an older one for French texts."""
        d = self.given("documents").select("doc_id", "lang")
        old = F.when(F.col("lang") == "fr", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
        numbered = d.select("doc_id", F.explode(old).alias("n"))
        return numbered.select((F.col("doc_id") * 2 + F.col("n")).alias("run_id"), "doc_id").withColumn("strategy", F.when(F.col("run_id") % 2 == 1, "lines").otherwise("whole"))

    def chunks(self) -> DataFrame:
        """The lines of each text; the older run of French texts is one whole chunk."""
        return self._chunks(spans=True)

    def _chunks(self, spans: bool) -> DataFrame:
        """``chunks``; without ``spans`` the places in the text, which cost a fold over its lines, stay null."""
        d = self.given("documents").select("doc_id", "lang", "source", "text")
        lines = F.split("text", "\n", -1)
        if spans:
            ends = arrays.prefix_sums(F.transform(lines, lambda x: F.length(x) + 1))
            placed = F.transform(
                F.arrays_zip(lines.alias("t"), ends.alias("e")),
                lambda s, i: F.struct(
                    (i + 1).alias("ord"), s["t"].alias("text"),
                    (s["e"] - 1 - F.length(s["t"])).alias("char_start"), (s["e"] - 1).alias("char_end"),
                ),
            )
        else:
            unknown = F.lit(None).cast("int")
            placed = F.transform(lines, lambda x, i: F.struct(
                (i + 1).alias("ord"), x.alias("text"), unknown.alias("char_start"), unknown.alias("char_end")))
        whole = F.array(F.struct(
            F.lit(0).alias("ord"), F.col("text").alias("text"),
            F.lit(0).alias("char_start"), F.length("text").alias("char_end"),
        ))
        kept = F.filter(placed, lambda s: F.trim(s["text"]) != "")
        both = F.when(F.col("lang") == "fr", F.concat(whole, kept)).otherwise(kept)
        c = d.select("doc_id", "lang", "source", F.explode(both).alias("s")).select(
            "doc_id", "lang", "source", "s.*"
        )
        return c.select(
            (F.col("doc_id") * 1_000_000 + F.col("ord")).alias("chunk_id"),
            "doc_id",
            (F.col("doc_id") * 2 + F.when(F.col("ord") == 0, 0).otherwise(1)).alias("run_id"),
            "text", "char_start", "char_end",
            F.array("source", "lang").alias("section_path"),
            F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int")).alias("token_count"),
            F.lit("line").alias("chunk_type"),
            ((F.col("ord") % 10) / 10.0).alias("boundary_confidence"),
            F.lit(None).cast("map<string,string>").alias("manual_override"),
        )

    def labels(self) -> DataFrame:
        """Labels under rubrics 1 and 2 for chunks of texts in the given labels.

        Rubric 1 labels every chunk, and toxic texts twice; rubric 2 good texts.
        """
        base = self._chunks(spans=False).select("chunk_id", "doc_id", "text", "token_count").join(
            self.given("labels").select("doc_id", "quality", "toxic"), "doc_id"
        )
        tokens = F.col("token_count")
        found = F.filter(
            F.array(
                F.when(F.col("quality") == 1, "quality"),
                F.when(F.col("toxic") == 1, "toxic"),
                F.when(tokens > 60, "lengthy"),
            ),
            lambda x: x.isNotNull(),
        )
        none = F.when(tokens < 10, arrays.empty_array("string")).otherwise(F.array(F.lit(DNB)))
        main = F.when(F.size(found) > 0, found).otherwise(none)
        share = lambda k: ((F.col("chunk_id") * k) % 101) / 100.0
        empty = F.array().cast("array<struct<kind:int,cats:array<string>,conf:double>>")
        variant = lambda kind, cats, conf: F.array(F.struct(
            F.lit(kind).alias("kind"), cats.alias("cats"), conf.alias("conf")
        ))
        kinds = F.concat(
            variant(0, main, share(37)),
            F.when(F.col("toxic") == 1, variant(250_000, F.array(F.lit("toxic")), share(53))).otherwise(empty),
            F.when(
                F.col("quality") == 1,
                variant(500_000, F.array(F.when(tokens > 60, "other").otherwise("quality")), share(29)),
            ).otherwise(empty),
        )
        rows = base.select("chunk_id", "doc_id", "text", F.explode(kinds).alias("k"))
        cats = F.col("k.cats")
        return rows.select(
            (F.col("chunk_id") + F.col("k.kind")).alias("label_id"),
            "chunk_id",
            F.when(F.col("k.kind") == 500_000, 2).otherwise(1).cast("long").alias("rubric_id"),
            cats.alias("predicted_categories"),
            F.map_from_arrays(
                cats, F.transform(cats, lambda c, i: F.col("k.conf") / (i + 1))
            ).alias("confidence"),
            F.concat(F.lit("because of "), F.array_join(cats, "+")).alias("rationale"),
            F.lit(None).cast("double").alias("knn_agreement"),
            (-(F.col("chunk_id") % 23) / 10.0).alias("logprob_signal"),
            F.when(F.length("text") >= 12, F.col("k.conf")).alias("composite_confidence"),
            F.lit("m1").alias("llm_model"),
            F.concat(F.lit("run"), F.col("doc_id") % 7).alias("llm_run_id"),
        )

    def review_log(self) -> DataFrame:
        """User events as reviews of labels, dealt over the first lines of all texts; several for a label."""
        n = self.given("documents").agg(F.count("*")).scalar()
        event = F.col("event_id")
        e = self.given("events").select(
            event.alias("review_id"),
            (event % n * 1_000_000 + 1 + F.floor(event / n) % 3).cast("long").alias("label_id"),
            F.concat(F.lit("u"), "user_id").alias("reviewer"),
            F.when(F.col("event_type") == "purchase", "accept")
            .when(F.col("event_type") == "click", "correct")
            .when(F.col("event_type") == "view", "skip")
            .when(F.col("event_type") == "error", "flag")
            .otherwise("bypassed").alias("action"),
            "value",
            F.col("props").alias("notes"),
            F.col("ts").alias("reviewed_at"),
        )
        known = self.labels().select("label_id", "predicted_categories")
        chosen = F.when(F.col("value") >= 20, F.array(F.lit("quality"))).otherwise(
            F.array(F.lit("toxic"), F.lit("quality"))
        )
        return e.join(known, "label_id").select(
            "review_id", "label_id", "reviewer", "action",
            F.when(F.col("action").isin("accept", "bypassed"), F.col("predicted_categories"))
            .when(F.col("action") == "correct", chosen)
            .otherwise(arrays.empty_array("string")).alias("final_categories"),
            "notes", "reviewed_at",
        )

    def reviews(self) -> DataFrame:
        return current_reviews(self.review_log())

    def categories(self) -> DataFrame:
        """Categories of rubrics 1 and 2: what the given labels can say, and one unused."""
        names = ["quality", "toxic", "unused", "other"]
        rows = [(1, i, n) for i, n in enumerate(names[:3])] + [(2, i, n) for i, n in enumerate(names)]
        return self.spark.createDataFrame(rows, "rubric_id long, pos int, name string")

    def label_rubrics(self) -> DataFrame:
        """Rubrics 1 and 2 in full."""
        texts = lambda *parts: F.array(*[F.concat(F.lit(p), "name") for p in parts])
        cat = F.struct(
            "pos", "name",
            F.concat(F.lit("Chunks about "), "name").alias("definition"),
            texts("one ", "two ", "three ", "four ").alias("exemplars"),
            F.when(F.col("pos") > 0, texts("not ", "never ", "rarely ")).otherwise(
                arrays.empty_array("string")).alias("boundary_cases"),
            F.lit(0.85).alias("confidence_threshold"),
            F.lit(None).cast("string").alias("parent"),
        )
        return self.categories().groupBy("rubric_id").agg(
            F.transform(F.array_sort(F.collect_list(cat)), lambda c: c.dropFields("pos")).alias("categories")
        ).withColumn("name", F.lit("labels")).withColumn("version", F.col("rubric_id").cast("int"))

    def rubrics(self) -> DataFrame:
        """A rubric per language with a category per source of its texts."""
        per_source = self.given("documents").groupBy("lang", "source").agg(
            F.min("text").alias("lo"), F.max("text").alias("hi"), F.count("*").alias("n"),
            F.max("n_chars").alias("longest"),
        )
        cat = F.struct(
            F.col("source").alias("name"),
            F.concat(F.lit("Texts from "), "source", F.lit(" in "), "lang").alias("definition"),
            F.when(F.col("n") > 1, F.array("lo", "hi")).otherwise(F.array("lo")).alias("exemplars"),
            F.when(F.col("longest") > 5000, F.array("hi")).otherwise(arrays.empty_array("string")).alias("boundary_cases"),
            F.lit(0.85).alias("confidence_threshold"),
            F.lit(None).cast("string").alias("parent"),
        )
        return per_source.groupBy("lang").agg(F.array_sort(F.collect_list(cat)).alias("categories")).select(
            (F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))).cast("long").alias("rubric_id"),
            F.col("lang").alias("name"),
            F.lit(1).alias("version"),
            "categories",
        )

    def rubric_edits(self) -> DataFrame:
        """Every event as a saved rubric of its user."""
        return self.given("events").select(
            F.col("event_id").alias("edit_id"),
            F.concat(F.lit("u"), "user_id").alias("name"),
            F.col("event_type").alias("category"),
        )

    def responses(self) -> DataFrame:
        """Model replies to chunks: plain, fenced, wrapped in prose, broken or without categories."""
        first = self.labels().where("label_id = chunk_id")
        cats, conf = F.col("predicted_categories"), F.col("confidence")
        body = F.to_json(F.struct(
            cats.alias("predicted_categories"), conf.alias("confidence_per_category"), "rationale"
        ))
        cid = F.col("chunk_id")
        # The given text decides nothing here: replies vary by chunk number only.
        reply = (
            F.when(cid % 17 == 0, F.concat(F.lit("{broken "), "rationale"))
            .when(cid % 13 == 0, F.concat(F.lit("Sure: "), body, F.lit(" Done.")))
            .when(cid % 11 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(cid % 7 == 0, F.concat(F.lit("["), body, F.lit("]")))
            .otherwise(body)
        )
        lp = -(cid % 23) / 10.0
        logprobs = F.when(cid % 5 == 0, F.array().cast("array<double>")).otherwise(
            F.array(lp, F.lit(None).cast("double"), lp - 0.5)
        )
        return first.select("chunk_id", reply.alias("response"), logprobs.alias("logprobs"))

    def exemplars(self) -> DataFrame:
        """Every given vector as an exemplar of its label."""
        return self.given("embeddings").select(
            F.lit(1).cast("long").alias("rubric_id"),
            F.concat(F.lit("c"), "label").alias("category"),
            F.col("label").alias("rubric_pos"),
            "embedding",
        )

    def chunk_embeddings(self) -> DataFrame:
        """Letter counts of each chunk; German texts have no vectors."""
        c = self._chunks(spans=False).where(F.get("section_path", F.lit(1)) != "de")
        return c.select(
            "chunk_id",
            letter_counts(F.col("text")).cast("array<float>").alias("embedding"),
            F.concat(F.lit("letters-"), F.get("section_path", F.lit(1))).alias("embedding_model"),
        )

    def audit(self) -> DataFrame:
        return self.given("events").select(
            "event_id", "event_type",
            F.concat(F.lit("u"), "user_id").alias("actor"),
            "ts",
            F.from_json("props", "map<string,string>").alias("payload"),
            F.array(F.col("user_id") * 1_000_000 + F.col("event_id") % 40 + 1).alias("related_chunk_ids"),
        )

    def listing(self) -> DataFrame:
        """Paths of an imagined share: one per text, page and conversation turn."""
        d = self.given("documents").select(F.concat(
            F.lit("/share/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id",
            F.when(F.col("n_chars") > 5000, ".PDF").when(F.col("n_chars") > 2000, ".md")
            .when(F.col("n_chars") > 1000, ".txt").otherwise(".png"),
        ).alias("path"))
        p = self.given("pages").select(F.concat(
            F.lit("/share/web/"), F.regexp_replace("url", r"^https?://|[?#].*$", ""), F.lit(".html")
        ).alias("path"))
        c = self.given("conversations").select(F.concat(
            F.lit("/share/chat/"), "conv_id", F.lit("/"), "role", F.lit("/"), "turn", F.lit(".text")
        ).alias("path"))
        return d.unionByName(p).unionByName(c)

    def tables(self) -> dict[str, DataFrame]:
        """The tables a cascade touches."""
        return {
            "documents": self.documents(),
            "chunking_runs": self.runs(),
            "chunks": self.chunks(),
            "labels": self.labels(),
            "human_reviews": self.reviews(),
            "chunk_embeddings": self.chunk_embeddings(),
        }


def letter_counts(c: Column) -> Column:
    """Counts of some letters: a vector that every engine computes exactly."""
    return F.array(*[
        (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double") for x in LETTERS
    ])


def letter_embedder(texts: Column) -> Column:
    return F.transform(texts, letter_counts)
