"""Sources and sinks of the gate: prompt lines, audit logs, text stores, datasets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads
from .tables import placed

REASON = "struct<type:string,pattern_id:string,detail:string,intent:string>"
CHANNEL = f"struct<channel:string,decision:struct<type:string,intent:string,reason:{REASON},pattern_id:string,code:string>,elapsed_us:bigint,similarity:float>"
AUDIT = (
    f"schema_version int, sequence bigint, ingested_at_ns bigint, decided_at_ns bigint, total_elapsed_us bigint, verdict_kind string, input_hash string, block_reason {REASON}, "
    "advisory struct<type:string,score:int,heuristic_version:int>, semantic_similarity float, chain_hmac string, egress_verdict string, egress_reason struct<type:string,detail:string>, "
    f"channel_a_result {CHANNEL}, channel_b_result {CHANNEL}, audit_detail_level string, input_text string"
)


def prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, text) of the lines of a text file that are not blank; blank lines use up a number too.

    Numbers are consecutive within a file: lines are counted by partition first, and only those counts meet.
    """
    return placed(spark.read.text(path).select(F.col("value").alias("text")), "sequence").select("sequence", "text").filter(F.trim("text") != "")


def write_verdict_lines(verdicts: DataFrame, path: str, text: str = "text") -> None:
    """LABEL, kind and prompt, tab-separated."""
    label = F.when(F.col("is_pass"), "PASS").otherwise("BLOCK")
    verdicts.select(F.concat_ws("\t", label, "verdict_kind", F.translate(text, "\r\n\t", "   ")).alias("value")).write.mode("overwrite").text(path)


def audit_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Audit rows of JSON lines in schema version 1 or 2, and the lines that are not valid JSON."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", AUDIT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.filter("r._corrupt IS NULL").select("r.*").drop("_corrupt")
    return good, parsed.filter("r._corrupt IS NOT NULL").select("value")


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def text_store(spark: SparkSession, path: str) -> DataFrame:
    """hash, input_text, normalised_text, created_at from a table; an empty one if it is not there or not readable."""
    schema = "hash string, input_text string, normalised_text string, created_at bigint"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def goals(spark: SparkSession, path: str, column: str = "goal") -> DataFrame:
    """The named column of a CSV file, whatever the case of its header; blank values are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found = [c for c in df.columns if c.lstrip("\ufeff").strip().lower() == column.lower()]
    if not found:
        raise ValueError(f"no column {column} in {path}")
    return df.select(F.trim(F.col(f"`{found[0]}`")).alias("text")).filter("text <> ''")


def write_report(rows: DataFrame, path: str) -> None:
    """category, key, count and rate_pct as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def conformance(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three lists of a conformance file: single prompts, conversations, and egress pairs."""
    df = spark.read.option("multiLine", True).json(path)
    return {name: df.select(F.explode(name).alias("c")).select("c.*") for name in ("single", "conversation", "egress") if name in df.columns}


def vocabulary(path: str) -> list[str]:
    """Rules of a vocabulary, one a line (see `functions.payloads`); for the payload vocabularies of a GateConfig."""
    with open(path, encoding="utf-8") as f:
        return payloads.vocabulary(f.read())
