"""What retrieval and answers cost, by method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import mean_or_zero, ratio

# fixed values: names of token counts in usage reports, whatever their case
USAGE = {"input": ("prompt_tokens", "input_tokens"), "output": ("completion_tokens", "output_tokens"), "total": ("total_tokens",)}


def reported(usage: Column, *names: str) -> Column:
    """The sum of the numbers under the given names at any depth of a JSON text, none below 0; null if there is none.

    Read off the text by a pattern, so depth has no limit and no Python runs; a name inside a string value has its quotes
    escaped and doesn't count.
    """
    pattern = r'(?i)(?<!\\)"(?:' + "|".join(names) + r')"\s*:\s*(-?\d+)'
    found = F.regexp_extract_all(usage, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, x: acc + F.greatest(F.lit(0).cast("bigint"), x.cast("bigint"))))


def usage_tokens(usage: Column) -> Column:
    """struct(input, output, total) of a usage report as JSON text; null without any count. The total is the reported one, else the sum."""
    i, o, t = (reported(usage, *USAGE[k]) for k in ("input", "output", "total"))
    zero = F.lit(0).cast("bigint")
    row = F.struct(F.coalesce(i, zero).alias("input"), F.coalesce(o, zero).alias("output"), F.coalesce(t, F.coalesce(i, zero) + F.coalesce(o, zero)).alias("total"))
    return F.when(i.isNotNull() | o.isNotNull() | t.isNotNull(), row)


def usage_or_estimate(usage: Column, name: str, estimate: Column) -> Column:
    """A count of a usage report, or the estimate where there is none."""
    return F.coalesce(reported(usage, *USAGE[name]), estimate)


def counter_delta(after: Column, before: Column) -> Column:
    """What a counter grew by; 0 if it was reset."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(after, F.lit(0)).cast("bigint") - F.coalesce(before, F.lit(0)).cast("bigint"))


def evidence(retrieved: DataFrame) -> DataFrame:
    """(method_name, question_id, memories, tokens, bytes, kept, began): the memories that a method gave a question."""
    size = F.coalesce(F.octet_length(F.col("content").cast("string")), F.lit(0))
    return retrieved.groupBy("method_name", "question_id").agg(F.count("*").alias("memories"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"), F.sum(size).alias("bytes"), F.countDistinct("memory_id").alias("kept"), F.min("retrieved_at").alias("began"))


def summary(per: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each method with answers.

    per: evidence() and available, the memories a question has. answers: method_name, correct, input_tokens, output_tokens, usage (JSON
    text or null), end_to_end_ms. Ratios to correct answers are null if there are none.
    """
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    r = per.groupBy("method_name").agg(
        F.count("*").alias("samples"), mean_or_zero("tokens").alias("mean_retrieved_tokens"), F.sum("tokens").cast("bigint").alias("total_retrieved_tokens"), mean_or_zero("memories").alias("mean_memory_count"), mean_or_zero("bytes").alias("mean_storage_bytes"),
        mean(F.col("bytes") / F.lit(1048576.0)).alias("mean_storage_mb"), mean((F.col("bytes") > 0).cast("double")).alias("storage_coverage"), mean(F.when(F.col("available") > 0, F.col("kept") / F.col("available"))).alias("retention_ratio"),
    )
    a = answers.withColumn("_u", usage_tokens(F.col("usage")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    q = a.groupBy("method_name").agg(
        F.count("*").alias("qa_samples"), F.count_if("correct").alias("correct_answers"), ratio(F.count_if("correct"), F.count("*")).alias("local_accuracy"),
        F.sum(zero("input_tokens")).cast("bigint").alias("total_input_tokens"), mean(zero("input_tokens")).alias("mean_input_tokens"), F.sum(zero("output_tokens")).cast("bigint").alias("total_output_tokens"), mean(zero("output_tokens")).alias("mean_output_tokens"), F.round(F.percentile(zero("output_tokens").cast("double"), F.lit(0.95)), 6).alias("p95_output_tokens"),
        F.sum("_u.input").alias("usage_input_tokens"), F.sum("_u.output").alias("usage_output_tokens"), F.sum("_u.total").alias("usage_tokens"), ratio(F.count("_u"), F.count("*")).alias("usage_coverage"),
        mean_or_zero("end_to_end_ms").alias("mean_end_to_end_ms"), F.round(F.coalesce(F.percentile("end_to_end_ms", F.lit(0.95)), F.lit(0.0)), 6).alias("p95_end_to_end_ms"), F.coalesce(F.sum("end_to_end_ms"), F.lit(0.0)).alias("_ms"),
    )
    out = q.join(r, "method_name", "left").withColumn("samples", zero("samples")).withColumn("observed_tokens", F.col("total_input_tokens") + F.col("total_output_tokens") + zero("usage_tokens"))
    return out.withColumn("tokens_per_correct", ratio(F.col("observed_tokens"), F.nullif("correct_answers", F.lit(0)))).withColumn("ms_per_correct", ratio(F.col("_ms"), F.nullif("correct_answers", F.lit(0)))).drop("_ms")


def with_deltas(costs: DataFrame, references: tuple[str, ...]) -> DataFrame:
    """costs with what each method takes more than the first of `references` that is there; null if none is."""
    order = F.array_position(F.array(*[F.lit(m) for m in references]), F.col("method_name"))
    names = ("mean_end_to_end_ms", "mean_input_tokens", "mean_output_tokens", "mean_memory_count")
    ref = costs.where(F.col("method_name").isin(*references)).agg(F.min_by(F.struct(*names), order).alias("_r"))  # one row
    d = lambda c: F.round(c, 6)
    return costs.crossJoin(F.broadcast(ref)).withColumns(
        {
            "delta_end_to_end_ms": d(F.col("mean_end_to_end_ms") - F.col("_r.mean_end_to_end_ms")),
            "delta_reader_tokens": d(F.col("mean_input_tokens") + F.col("mean_output_tokens") - F.col("_r.mean_input_tokens") - F.col("_r.mean_output_tokens")),
            "delta_memory_count": d(F.col("mean_memory_count") - F.col("_r.mean_memory_count")),
        }
    ).drop("_r")
