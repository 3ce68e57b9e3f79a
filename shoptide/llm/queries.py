"""One registered query per operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.llm import (chat, hard_negatives, language, licences, line_dedup, mixing, near_texts, near_vectors, neighbours, pieces, runs, secret_scan,
                          urls)
from shoptide.llm.common import saved, table
from shoptide.llm.stages import tokenizer_path
from shoptide.sinks import files


def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    decoded = pieces.round_trip(docs, tokenizer_path())
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), pieces.ids_digest(F.col("ids")).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_near_texts(spark: SparkSession, folder: str) -> DataFrame:
    return near_texts.near_duplicates(table(spark, folder, "documents"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.predict(docs.select("doc_id", "text").withColumn("held_out", language.held_out(F.col("doc_id"))), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.where("vec_id % 50 = 0"))


def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages").select("page_id", "url"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["place"] == secret_scan.KINDS.index(kind))).cast("bigint")
    base = F.filter("spans", lambda s: s["place"] < secret_scan.KINDS.index("random"))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secret_scan.written(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.written(F.col("spans")).alias("spans"))


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(more)))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(
        F.col("label")).alias("label"))
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find(periodic(table(spark, folder, "documents").select("doc_id", "text")))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # The runs are in order, so of equal exponents the first stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    known = found.select("doc_id", "runs", "collapsed", F.transform(F.array(best), lambda b: b)[0].alias("best"))
    return known.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the texts, of a tenth of the documents with words repeated periodically from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def made(x):
        n, g = F.size(x["words"]), x["g"]
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        later = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1 - a), lambda i: F.get(x["words"], (a + F.pmod(i, p)).cast("int")))
        return F.array_join(F.concat(F.slice(x["words"], F.lit(1), a.cast("int")), later), " ")

    changed = F.transform(F.array(F.struct(words.alias("words"), F.floor(h / 10).alias("g"))), lambda x: F.when(F.size(x["words"]) > 0, made(x)).otherwise(""))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed[0]).otherwise(F.col("text")).alias("text"))


def op13_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    root = files.shared_folder(spark)
    index = line_dedup.LineIndex(spark, root)
    index.insert(docs)
    found, _ = saved(index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))
    files.remove(spark, root)
    return found


QUERIES = {q.__name__: q for q in (op1_pieces, op2_near_texts, op3_language, op4_neighbours, op5_near_vectors, op6_urls, op7_mixing, op8_secrets, op9_licences, op10_chat,
                                   op11_hard_negatives, op12_runs, op13_lines)}
