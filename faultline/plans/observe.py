"""Trace, span, generation and token-usage tables derived from stored investigations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.text import TOKENS_PER_MESSAGE, estimate_tokens
from faultline.plans.investigate import TEMPERATURE, call_error, extract_final_report, result_count
from faultline.schemas import ROLES
from faultline.session import sorted_join


def trace_rows(
    investigations: DataFrame, service_names: DataFrame, steps: DataFrame, product: str = "faultline"
) -> DataFrame:
    """One trace per investigation: its start metadata and, once over, its outcome.

    ``service_names`` is (incident_id, service_name).
    """
    report = extract_final_report(steps).select("investigation_id", "report")
    named = sorted_join(investigations.withColumnRenamed("id", "investigation_id"), service_names, "incident_id")
    joined = sorted_join(named, report, "investigation_id", "left")
    over = F.col("status").isin("completed", "failed")
    failed = F.col("status") == "failed"
    citations = F.transform(
        "report.citedRunbooks", lambda r: F.struct(r["title"], r["slug"], r["chunkId"])
    )
    return joined.select(
        F.col("investigation_id").alias("id"),
        F.lit("investigation.workflow").alias("name"),
        "incident_id",
        "service_name",
        "provider",
        "model",
        "prompt_version",
        F.array(F.lit(product), F.lit("investigation"), F.col("provider")).alias("tags"),
        F.when(over, F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("completed_at"))).alias(
            "duration_ms"
        ),
        F.when(over, F.col("status") == "completed").alias("success"),
        F.when(over, F.col("status")).alias("investigation_status"),
        F.col("report.confidence").alias("confidence_score"),
        citations.alias("cited_runbooks"),
        F.when(F.col("report").isNotNull(), F.size("report.evidence").cast("long")).alias("evidence_count"),
        F.when(failed, F.col("summary")).alias("error_message"),
    )


def tool_spans(calls: DataFrame) -> DataFrame:
    """One span per tool call, without its payload."""
    ok = F.col("status") == "success"
    return calls.select(
        F.col("investigation_id").alias("trace_id"),
        F.col("tool_name").alias("name"),
        F.timestamp_add("MILLISECOND", -F.col("latency_ms"), F.col("created_at")).alias("start_time"),
        F.col("created_at").alias("end_time"),
        F.col("latency_ms").cast("long").alias("latency_ms"),
        ok.alias("success"),
        F.when(ok, result_count()).alias("result_count"),
        F.when(~ok, F.lit("Error")).alias("error_name"),
        F.when(ok, "DEFAULT").otherwise("ERROR").alias("level"),
        F.when(~ok, F.lit("Tool call failed.")).alias("status_message"),
    )


def usage_details(usage: Column) -> Column:
    """{input, output, total} of the counts present; null when there is none."""
    counts = F.create_map(
        F.lit("input"), usage["promptTokens"],
        F.lit("output"), usage["completionTokens"],
        F.lit("total"), usage["totalTokens"],
    )
    present = F.map_filter(counts, lambda _, v: v.isNotNull())
    return F.when(F.size(present) > 0, present)


def generation_rows(checked: DataFrame) -> DataFrame:
    """One generation per model call (columns of ``validate_reports`` plus the call's).

    A call that failed has no output and the error as its message. The prompt is the input
    where the rows carry it.
    """
    ok = F.col("report").isNotNull()
    asked = [F.col("prompt_text").alias("input")] if "prompt_text" in checked.columns else []
    return checked.select(
        *asked,
        F.col("investigation_id").alias("trace_id"),
        F.lit("investigation.llm_generation").alias("name"),
        "model",
        "provider",
        F.col("response").alias("output"),
        F.timestamp_add("MILLISECOND", -F.col("duration_ms"), F.col("created_at")).alias("start_time"),
        F.col("created_at").alias("end_time"),
        F.col("duration_ms").cast("long").alias("latency_ms"),
        F.lit(TEMPERATURE).alias("temperature"),
        usage_details(F.col("usage")).alias("usage"),
        ok.alias("structured_output_success"),
        F.when(ok, "DEFAULT").otherwise("ERROR").alias("level"),
        F.when(
            ~ok, F.coalesce(call_error(checked), "parser_error", F.lit("Structured output failed."))
        ).alias("status_message"),
    )


def llm_call_events(calls: DataFrame) -> DataFrame:
    """One event per model call: usage when it succeeded, the error's name when not."""
    ok = F.col("error_name").isNull()
    return calls.select(
        "call_id",
        "provider",
        "model",
        F.col("duration_ms").cast("long").alias("duration_ms"),
        ok.alias("success"),
        F.when(ok, F.col("usage")).alias("usage"),
        "error_name",
    )


def llm_call_rollup(events: DataFrame) -> DataFrame:
    """Per provider and model: calls, failures, exact p50 and p95 duration, tokens.

    The percentile (the smallest duration that covers the share) is read off a histogram
    of whole milliseconds. A group is at most one row per distinct duration, which the
    call timeout bounds, so a model with most of the calls is no hot group.
    """
    keys = ["provider", "model"]
    bars = events.groupBy(*keys, "duration_ms").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum("usage.totalTokens").alias("tokens"),
    )
    upto = W.partitionBy(*keys).orderBy("duration_ms")
    total = F.sum("n").over(W.partitionBy(*keys))
    bars = bars.withColumn("covered", F.sum("n").over(upto)).withColumn("calls", total)

    def percentile(share: float) -> Column:
        reached = F.col("covered") >= F.ceil(F.col("calls") * F.lit(share))
        return F.min(F.when(reached, F.col("duration_ms")))

    return bars.groupBy(*keys).agg(
        F.sum("n").alias("calls"),
        F.sum("failures").alias("failures"),
        F.round(F.sum("failures") / F.sum("n"), 6).alias("failure_rate"),
        percentile(0.5).alias("p50_ms"),
        percentile(0.95).alias("p95_ms"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    )


def prompt_tokens(messages: DataFrame, key: str = "conv_id", text: str = "content") -> DataFrame:
    """Estimated prompt tokens per conversation: 4 more for each message."""
    per_message = estimate_tokens(F.col(text)) + TOKENS_PER_MESSAGE
    return messages.groupBy(key).agg(F.sum(per_message).alias("prompt_tokens"))


def _usage(prompt: Column, completion: Column, total: Column, estimated: bool) -> Column:
    return F.struct(
        prompt.cast("long").alias("promptTokens"),
        completion.cast("long").alias("completionTokens"),
        total.cast("long").alias("totalTokens"),
        F.lit(estimated).alias("estimated"),
    )


def normalize_usage(calls: DataFrame, *, either: str = "gemini") -> DataFrame:
    """Adds ``usage`` to a call log with the counts a provider reported.

    Exact when both counts are there, the total being their sum. A provider of the
    ``either`` kind may report one count (the other is 0) and its own total. Else the
    usage is estimated from ``prompt_tokens`` and the completion text.
    """
    prompt, completion = F.col("reported_prompt"), F.col("reported_completion")
    p, c = F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0))
    own = _usage(p, c, F.coalesce(F.col("reported_total"), p + c), False)
    both = _usage(prompt, completion, prompt + completion, False)
    guess = estimate_tokens(F.col("completion"))
    estimated = _usage(F.col("prompt_tokens"), guess, F.col("prompt_tokens") + guess, True)
    is_either = F.col("provider") == either
    usage = (
        F.when(is_either & (prompt.isNotNull() | completion.isNotNull()), own)
        .when(~is_either & prompt.isNotNull() & completion.isNotNull(), both)
        .otherwise(estimated)
    )
    return calls.withColumn("usage", usage)


def classify_llm_errors(calls: DataFrame, *, hosted: str = "gemini") -> DataFrame:
    """Adds ``error_code``, null for a good call.

    Reads provider, has_credential, aborted, http_status (null when nothing came back),
    body and parsed. The hosted provider needs a credential and knows no missing model.
    """
    is_hosted = F.col("provider") == hosted
    body = F.lower(F.coalesce("body", F.lit("")))
    refused = ~F.col("http_status").between(200, 299)
    no_model = (F.col("http_status") == 404) | body.contains("model") | body.contains("not found")
    code = (
        F.when(is_hosted & ~F.col("has_credential"), "provider_disabled")
        .when(F.col("aborted"), "provider_timeout")
        .when(F.col("http_status").isNull(), "provider_unavailable")
        .when(refused & ~is_hosted & no_model, "model_missing")
        .when(refused, "provider_unavailable")
        .when(~F.col("parsed"), "bad_response")
    )
    return calls.withColumn("error_code", code)


def message_violations(messages: DataFrame) -> DataFrame:
    """Messages no model call takes: an unknown role or an empty content."""
    bad_role = ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    no_content = ~F.coalesce(F.length("content") > 0, F.lit(False))
    fields = F.array_compact(
        F.array(F.when(bad_role, F.lit("role")), F.when(no_content, F.lit("content")))
    )
    return messages.select("conv_id", "turn", F.explode(fields).alias("field"))


def conversation_payload(messages: DataFrame) -> DataFrame:
    """Messages as a hosted model takes them, one row each, in ``turn`` order.

    System messages go to section 'instruction' (their texts, joined by a blank line, are
    the instruction), the others to 'contents' with the role 'model' or 'user'. Rows, not
    one array per conversation: a conversation has no bound.
    """
    system = F.col("role") == "system"
    return messages.select(
        "conv_id",
        F.when(system, "instruction").otherwise("contents").alias("section"),
        "turn",
        F.when(system, None)
        .when(F.col("role") == "assistant", "model")
        .otherwise("user")
        .alias("role"),
        F.col("content").alias("text"),
    )


def system_instruction(messages: DataFrame) -> DataFrame:
    """The instruction per conversation, a row per system text: conv_id, turn, text, has_instruction.

    Its texts in ``turn`` order, joined by a blank line, are the instruction. A conversation
    without one has a single row that says so. Rows, as an instruction has no bound.
    """
    is_system = F.col("role") == "system"
    texts = messages.filter(is_system).select(
        "conv_id", "turn", F.col("content").alias("text"), F.lit(True).alias("has_instruction")
    )
    without = messages.groupBy("conv_id").agg(F.max(is_system).alias("any")).filter(~F.col("any"))
    kinds = {f.name: f.dataType for f in texts.schema.fields}
    return texts.unionByName(
        without.select(
            "conv_id",
            F.lit(None).cast(kinds["turn"]).alias("turn"),
            F.lit(None).cast("string").alias("text"),
            F.lit(False).alias("has_instruction"),
        )
    )
