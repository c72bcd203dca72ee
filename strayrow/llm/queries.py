"""One query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.functions.materialize import new_path
from strayrow.llm import centroids, dialogue, html_text, jaccard, licenses, line_dedup, near_vectors, packing, pieces, quality, token_files, topk, url_filters
from strayrow.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(ship_package(spark), sf_dir)

    QUERIES[run.__name__] = shipped
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: host, path, verdict
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rows = [F.struct(*map(F.lit, rule)) for rule in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*rows)).alias("host", "path", "verdict"))
    return url_filters.judge_urls(pages, rules).drop("url")


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json")
    )
    read = token_files.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_of = pieces.PieceTable.from_model(tokenizer_file("piece_bpe_32k.model"))
    encoded = pieces.encode_pieces(table(spark, sf_dir, "documents"), pieces_of)
    decoded = pieces.decode_pieces(encoded, pieces_of, keep=["n_pieces", F.crc32("ids").alias("ids_crc32")])
    return decoded.select(
        "doc_id", "n_pieces", "ids_crc32", F.length("text").cast("long").alias("n_chars"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *quality.COUNTS, base_failed.alias("base_failed"), "kept")


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(
        table(spark, sf_dir, "documents"), shingle=4, similarity=(85, 100)
    )


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return scanned.withColumn("spans", F.to_json("spans"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(
        table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")
    )
    packed = packing.pack_pieces(pieces.withColumn("ids", F.crc32("ids")))
    return packed.select(
        "doc_id", "piece", "start", "length", F.col("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "source", "text", "n_lines", "n_dropped")


@query
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256.0, dims=64)


def damaged(conversations: DataFrame) -> DataFrame:
    """Messages dropped, emptied, cut off, repeated or given to the user, by a hash of their place."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    case = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"])) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(said["text"], "[.!?]", "")).otherwise(said["text"])
    return conversations.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(said["role"]).alias("role"), text.alias("text"),
        F.explode(F.when(case == 0, F.array().cast("array<int>")).when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = dialogue.digests(dialogue.repair_conversations(damaged(conversations)))
    every = conversations.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
