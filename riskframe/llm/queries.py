"""Registered queries of the document operators and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import bpe, conversations, decontamination, language_id, line_dedup, mixing, near_dedup, quality_model, quality_rules, spelling, suffix_dedup, surrogates, token_counts

LEAST_DOCS = 5  # documents of a language that is learned

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(table) -> DataFrame`` under ``name``; ``table(t)`` opens a parquet table."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(lambda t: spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op7_pivotal_mixing")
def _op7(table):
    return mixing.report(mixing.decide(table("documents")))


@query("op8_line_first_rules", quality_rules.REPORT_SQL)
def _op8(table):
    return quality_rules.measure(table("documents")).select(*quality_rules.REPORT)


@query("op4_line_windows", line_dedup.SQL)
def _op4(table):
    return line_dedup.dedup(table("documents").select("doc_id", "text"))


@query("op1_template_decontamination")
def _op1(table):
    return decontamination.leaks(table("documents"), table("benchmark")).drop("k1", "k2")


@query("op3_language_families")
def _op3(table):
    docs = table("documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held), least=LEAST_DOCS)
    found = language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op6_factorisation_machine")
def _op6(table):
    docs, labels = table("documents"), table("labels")
    model = quality_model.fit(docs, labels.where(~quality_model.held_out(F.col("doc_id"))))
    found = quality_model.score(docs.select("doc_id", "text", "n_chars", quality_model.held_out(F.col("doc_id")).alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


@query("op5_probminhash")
def _op5(table):
    return near_dedup.classes(table("documents")).select("doc_id", "class_id", "class_size")


@query("op10_repeat_intervals")
def _op10(table):
    return suffix_dedup.dedup(table("documents"))


@query("op9_surrogates")
def _op9(table):
    return surrogates.replace(table("documents").select("doc_id", "text"))


MASKED = r"\d{9,}|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b"


@query("op2_edit_aware_counts")
def _op2(table):
    """Tokens of every text, and again after long numbers, mail and IP addresses are masked."""
    docs = table("documents").select("doc_id", "text")
    counted = token_counts.recount(docs, token_counts.Counter(docs.sparkSession), MASKED, "[hidden]")
    return counted.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded")


@query("op12_speculative_bpe")
def _op12(table):
    rows = bpe.encode(table("documents").select("doc_id", "text"), decoded_col="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op13_sorted_spelling", spelling.SQL)
def _op13(table):
    return spelling.group(spelling.vocabulary(table("documents")))


@query("op11_deepening_repair")
def _op11(table):
    return conversations.report(table("conversations"))
