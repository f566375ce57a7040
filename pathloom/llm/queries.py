"""The thirteen registered queries of this subpackage and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, embeddings, lexical, licenses, mixing, oracle, packing, quality, secrets, simhash, structure, topk, urls, windows

# The probe conversation and the url rules.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back.  Null text or role: empty; a null conv_id is a conversation; ties
    by turn go by role and text; repeated rows are turns of their own; empty table: the probe only."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    made = chat.format_trees(chat.chain_messages(rows.union(probe)))
    turns = chat.read_turns(F.col("formatted"))
    read = made.select("conv_id", "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text.  Null and empty texts have none; repeated rows return a row each; empty table: no rows."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    of = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    n = [of(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)]
    return found.select("doc_id", *n, F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every text.  Null and empty texts have no words and fail; repeated rows return a row each, and count
    each as labelled if their id is; a null language is one of its own; empty tables: no rows, or no cutoffs."""
    slim = quality.measured(_table(spark, sf_dir, "documents"))
    done = quality.verdicts(slim, quality.fit(slim, _table(spark, sf_dir, "labels")), "stratum")
    return done.select(F.col("id").alias("doc_id"), *[F.col(f"_pl_c.{c}").alias(c) for c in quality.COUNTS[:5]], F.col("_pl_base_failed").alias("base_failed"), F.col("_pl_kept").alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors.  Null, zero and non-finite vectors and null labels or ids link with nothing; equal vectors link; rows of
    one id share a component; empty table: no rows."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every text.  Null and empty texts have none; repeated rows return a row each; empty table: no rows."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every url.  Null urls and urls without :// have an empty host and path; repeated rows return a row each; empty
    table: no rows."""
    return urls.filter_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "key string, verdict string"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all documents, weighted by each source's count to 0.7.  A null source is a source; null ids and repeated rows
    stand next to each other; empty table: no rows."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all texts.  Null and wordless texts have fingerprint 0 and link like any other; a null id has
    a null component; repeated rows return a row each; empty table: no rows."""
    done = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places.  Null and empty texts are one piece of one id; repeated rows and null ids are
    pieces of their own; empty table: no rows."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept words of every text.  Null texts have none; rows that share an id are no copies of each other; null ids lose nothing;
    empty table: no rows."""
    done = windows.drop_repeated(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every 50th vector.  Null and non-finite vectors and rows with a null id take no part; rows of one id
    are no partners of each other; equal scores go by id; empty table: no rows."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage.  Nulls in texts and roles count as one space; a null
    conv_id is a conversation; repeated rows are duplicates; ties by turn go by role and a hash of the text; empty table: no rows."""
    rows = _table(spark, sf_dir, "conversations")
    return structure.audited(rows, structure.damage(rows))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item.  Null and empty texts have no terms; equal scores go by doc_id, a null one last;
    repeated documents are ranked each, repeated items too; empty tables: no rows."""
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_secrets, op3_quality, op4_embeddings, op5_licenses, op6_urls, op7_mixing, op8_simhash, op9_packing, op10_substrings, op11_topk, op12_structure, op13_lexical)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
