"""Explicit schemas of everything that is read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CALL = "struct<id: string, function_name: string, function_args: string>"
CONSTRAINTS = (
    "struct<word_count: int, required_words: array<string>, forbidden_chars: array<string>, bullet_count: int, words_per_bullet: int, "
    "line_count: int, word_range: array<int>, required_elements: array<string>, forbidden_words: array<string>, forbidden_elements: array<string>, "
    "no_punctuation: boolean, structure: array<string>, no_narration: boolean, starts_with_speaker: boolean, forbidden_style: string>"
)
#: A prompt suite: one sparse object for each case. Expected arguments are taken as JSON text, so that 84.0, 84 and "84" differ.
CASE = (
    "id string, category string, scoring string, temperature double, max_tokens int, prompt string, expected string, expected_keywords array<string>, "
    f"test_code string, constraints {CONSTRAINTS}, system string, tool_responses map<string, string>, expected_tool_call string, expected_args_contain string"
)
RUN = (
    "bench_run_id string, run_id string, model_label string, served_model string, quant string, category string, prompt_id string, repeat int, seed int, "
    "temperature double, top_p double, max_tokens int, ttft_s double, gen_s double, total_s double, output_tokens_approx int, tok_per_s double, "
    "finish_reason string, valid boolean, score_raw string, score_type string"  # '' and 'None' stand for no score
)
TRANSCRIPT = (
    "bench_run_id string, run_id string, model_label string, category string, prompt_id string, prompt string, response string, reasoning string, "
    f"tool_calls_trace array<array<{CALL}>>, finish_reason string, repeat int, seed int, valid boolean, score_raw double, score_type string, "
    "metrics struct<ttft_s: double, gen_s: double, total_s: double, output_tokens_approx: int, tok_per_s: double>"
)
JUDGED = (
    "prompt_id string, category string, model_a string, model_b string, order_swapped boolean, winner string, a_score double, b_score double, "
    "confidence double, rationale string, violations_a string, violations_b string, judge_model string"
)
#: What a server says of a whole response: the message, why it ended, and its own timings.
RESPONSE = (
    "struct<choices: array<struct<message: struct<content: string, reasoning_content: string>, finish_reason: string>>, "
    "timings: struct<prompt_n: int, prompt_per_second: double, predicted_n: int, predicted_per_second: double>>"
)
RUN_META = "model_label string, served_model string, quant string, elapsed_s double, passed boolean, timestamp string"
#: The row that all collectors come to.
RESULT = "model string, framework string, task string, category string, score double, score_type string, tok_per_s double"
VERDICT = "struct<winner: string, a_score: double, b_score: double, confidence: double, rationale: string, violations: struct<A: array<string>, B: array<string>>>"
CHUNK = "run_id string, turn int, seq long, arrival double, line string"
DELTA_CALL = "struct<index: int, id: string, function: struct<name: string, arguments: string>>"
EVENT = f"struct<choices: array<struct<delta: struct<content: string, reasoning_content: string, reasoning: string, tool_calls: array<{DELTA_CALL}>>, finish_reason: string>>>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
