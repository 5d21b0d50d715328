"""Citation audit: was every evidence id that an answer cites really returned by a tool in its run?

`messages` holds one row per message: run_id, seq, role (human, ai, tool), content,
tool_calls (how many tools the message asks for), input_tokens, output_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions.text import ACCOUNT_ID, EVIDENCE_ID, found_ids

STATUS = "PENDING ANALYST REVIEW"


def answers(messages: DataFrame) -> DataFrame:
    """The last message of each run."""
    return messages.groupBy("run_id").agg(F.max_by("content", "seq").alias("answer"))


def run_totals(messages: DataFrame) -> DataFrame:
    """Tool calls and tokens per run."""
    def total(column: str, of: Column) -> Column:
        return F.coalesce(F.sum(of), F.lit(0)).alias(column)

    return messages.groupBy("run_id").agg(
        total("tool_calls", F.when(F.col("role") == "ai", F.col("tool_calls"))),
        total("input_tokens", F.col("input_tokens")), total("output_tokens", F.col("output_tokens")))


def audit(messages: DataFrame, evidence_pattern: str = EVIDENCE_ID, account_pattern: str = ACCOUNT_ID) -> DataFrame:
    """Per run: the answer, cited ids split into verified and unverified, accounts, totals, status.

    Ids are joined row by row, so a run with a huge tool history is never gathered in one place;
    only the ids of one answer are.
    """
    group = 1 if "(" in evidence_pattern else 0
    said = answers(messages)
    cited = said.select("run_id", F.explode(found_ids(F.col("answer"), evidence_pattern, group)).alias("id"))
    tools = messages.filter(F.col("role") == "tool")
    seen = tools.select("run_id", F.explode(F.regexp_extract_all(
        "content", F.lit(evidence_pattern), F.lit(group))).alias("id")).distinct()
    checked = cited.join(seen.withColumn("seen", F.lit(True)), ["run_id", "id"], "left")
    split = checked.groupBy("run_id").agg(
        F.array_sort(F.collect_list("id")).alias("cited_evidence"),
        F.array_sort(F.collect_list(F.when(F.col("seen"), F.col("id")))).alias("verified_evidence"))
    none = F.array().cast("array<string>")
    out = said.join(split, "run_id", "left").join(run_totals(messages), "run_id").withColumns({
        "cited_evidence": F.coalesce("cited_evidence", none),
        "verified_evidence": F.coalesce("verified_evidence", none)})
    return out.select(
        "run_id", "answer", found_ids(F.col("answer"), account_pattern).alias("accounts_mentioned"),
        "cited_evidence", "verified_evidence",
        F.array_except("cited_evidence", "verified_evidence").alias("unverified_evidence"),
        "tool_calls", "input_tokens", "output_tokens", F.lit(STATUS).alias("status"))
