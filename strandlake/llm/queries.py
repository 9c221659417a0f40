"""The registered queries of the subpackage: thin layers that derive the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _counted(found: DataFrame, kinds: list[str], base: list[str]) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[of(k) for k in kinds],
        F.sha2(common.joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        common.joined(F.col("spans")).alias("spans"),
    )


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns, and high-entropy stretches."""
    from .secrets import scan_secrets

    base = ["assign", "access", "hex"]
    return _counted(scan_secrets(common.table(spark, sf_dir, "documents")), [*base, "entropy"], base)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in full sequences of 256 to 2048 tokens; pieces with a checksum of their ids."""
    import public_tokenizers

    from .packing import pack

    pieces = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have similarity 0.75 or more."""
    from .near_dups import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def _remainder(id_col, of: int):
    return F.crc32(id_col.cast("string").cast("binary")) % of


def _predicted(scored: DataFrame, held_out, least: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 3 = 1 are held out from learning."""
    from . import toxicity

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, trainable=lambda x: _remainder(x, 3) != 1)
    return _predicted(toxicity.score(docs, model), _remainder(F.col("doc_id"), 3) == 1, 0.7)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds, exactly or with a few edits."""
    from .decontamination import find_leaks

    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows with crc32(doc_id) mod 5 = 0 are held out from learning."""
    from . import quality

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, trainable=lambda x: _remainder(x, 5) != 0)
    return _predicted(quality.score(docs, model), _remainder(F.col("doc_id"), 5) == 0, 0.3)


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of any 400-byte string that also starts elsewhere."""
    from .repeats import removed_digest

    return removed_digest(common.table(spark, sf_dir, "documents"))


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product with every vector whose id is divisible by 20."""
    from .neighbours import nearest

    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


BASE_PERSONAL = ["email", "ip", "card", "phone"]


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base patterns, and terms that reveal them."""
    from .personal import scan_personal

    with common.Scratch(spark) as scratch:
        found = scan_personal(common.table(spark, sf_dir, "documents"), scratch=scratch)
        return scratch.kept(_counted(found, BASE_PERSONAL, BASE_PERSONAL), "personal")


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document by sentence rules."""
    from .licences import scan_licences

    found = scan_licences(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("licences", ",").alias("licences"))
