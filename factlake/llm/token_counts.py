"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from factlake.llm.bpe import byte_bpe, n_ids, text_chunks
from factlake.llm.common import free_name, stored

CACHE = "digest binary, n_tokens long, tokenizer string"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file never takes this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str):
    """Texts -> token counts, as the file's library gives them, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    try:
        bpe = byte_bpe(path)
    except ValueError:  # another kind of model: the library itself
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        return lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    return lambda texts: list(map(n_ids, bpe.encode_batch(texts)))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    # two jobs at once, or one that was run again, may have appended a digest twice
    return stored(found.filter(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"]), "cache-view")


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes`` and ``n_tokens``.

    Content (a null text is the empty one; these tokenizers' libraries are given no other
    normalisation, which would change counts) is known by its SHA-256 and the tokenizer by its
    file's. Digests join the counts stored under ``cache``; of those that aren't there, one text
    each is encoded and its count appended. Copies meet first within their input task, so a
    text with any number of copies sends one row from each task. A digest that the cache holds twice
    counts once. Repeated rows each give their
    row; columns named like a result are replaced; an empty table gives an empty one.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    digest = free_name(docs, "digest")
    whole = F.coalesce(docs[text], F.lit(""))
    of_text = F.unhex(F.sha2(whole, 256))
    misses = docs.select(of_text.alias("digest"), whole.alias("text"))
    cached = read_cache(spark, cache, version)
    if cached is not None:
        misses = misses.join(cached.select("digest"), "digest", "left_anti")

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count(texts[a:b]), pa.int64())], names=["digest", "n_tokens"])

    new = misses.dropDuplicates(["digest"]).mapInArrow(run, "digest binary, n_tokens long")
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    known = read_cache(spark, cache, version).withColumnRenamed("digest", digest)
    return docs.select(*kept, F.octet_length(whole).cast("long").alias("n_bytes"), of_text.alias(digest)).join(known, digest, "left").drop(digest)
