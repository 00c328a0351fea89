"""Query of operator 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import read
from noveltide.llm.sentencepiece_bpe import encode


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(read(spark, sf_dir, "documents"), model_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_mismatch",
    )


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
SQL: dict[str, str] = {}
