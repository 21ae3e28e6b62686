"""A corpus from raw documents to packed sequences, by operators of sciobs.llm.

Null and empty texts are documents like others: the classifier scores them, one
of all of them stays, and each is packed as one token. A null doc_id is below
all others. Repeated rows are near copies, of which one stays; ties go to the
smallest doc_id. Very long texts are read whole. Other columns stay as they are,
whatever their names, but for n_chars, which follows the text. Empty tables give
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sciobs.llm import jaccard_join, line_dedup, mixing, packing, quality, shared
from sciobs.llm.queries import document_domains, table

#: Tokens of each domain that the mixture aims at, relative to what came in.
WANTED = {"clean": 1.0, "junk": 1.0, "toxic": 0.1}


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns beside doc_id and text under names that no operator uses, and their own names."""
    own = {f"__other{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed({c: k for k, c in own.items()}), own


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "__score").where(F.col("__score") >= 0.5).drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    plain, own = _aside(docs)
    done = line_dedup.dedup_lines(plain).select(plain.columns).withColumnsRenamed(own)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fewer toxic documents; a document comes as often as its rate says."""
    plain, own = _aside(docs)
    model = mixing.train(plain, document_domains(table(spark, sf_dir, "labels")))
    scored = shared.keep(mixing.with_posteriors(plain, model), "domains")
    now = mixing.domain_tokens(scored, model.domains)
    mixed = mixing.mix(scored, [t * WANTED.get(d, 1.0) for t, d in zip(now, model.domains, strict=True)])
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.where("copies > 0").select(*plain.columns, copies.alias("__copy")).drop("__copy").withColumnsRenamed(own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_domains),
    ("best-fit packing", pack_sequences),
]
#: Two stages are trained models, so SQL cannot express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.keep(docs, name.replace(" ", "-").lower())
    return docs
