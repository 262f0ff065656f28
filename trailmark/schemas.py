"""Record schemas and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------

# The four elements of a state, in order; bit i of a view mask stands for ELEMENTS[i].
ELEMENTS = ["question", "task", "images", "observations"]

# The views are the non-empty subsets of the elements, smaller subsets first.
FULL_VIEW = "question+task+images+observations"


def _views() -> list[tuple[str, int]]:
    from itertools import combinations

    return [
        ("+".join(combo), sum(1 << ELEMENTS.index(name) for name in combo))
        for size in range(1, len(ELEMENTS) + 1)
        for combo in combinations(ELEMENTS, size)
    ]


VIEW_MASKS: list[tuple[str, int]] = _views()
VIEWS: list[str] = [name for name, _ in VIEW_MASKS]

ERROR_CATEGORIES = [
    "visual_perception",
    "ineffective_tool_use",
    "tool_misinterpretation",
    "reasoning_error",
    "instruction_following",
    "no_answer",
]

UNANSWERABLE = ["unanswerable", "n/a", "none"]

ORDINALS = [
    "first", "second", "third", "fourth", "fifth",
    "sixth", "seventh", "eighth", "ninth", "tenth",
]

ANSWER_TOKEN = "\nAnswer:"

# Instruction appended to a query, by task type and language; {token} is the answer token.
INSTRUCTIONS = {
    "multi-choice": {
        "en": "Think step-by-step to analyze the question. Provide your final answer in this EXACT format on a new line: {token} [single capital letter]\n\nDo not include any text after the answer.",
        "zh": "逐步思考分析问题。按以下精确格式在新的一行给出最终答案：{token} [单个大写字母]\n\n答案后不要包含任何文字。",
    },
    "open-ended": {
        "en": "You may provide reasoning first, but you MUST end your response with your final answer in this format on a new line: {token} [your concise answer]",
        "zh": "你可以先提供推理过程，但必须在回答的最后一行按以下格式输出最终答案：{token} [你的简洁答案]",
    },
    "yes-no": {
        "en": "You may explain your reasoning, but you MUST end with: {token} Yes or {token} No",
        "zh": "你可以解释推理过程，但必须以以下格式结尾：{token} Yes 或 {token} No",
    },
    "true-false": {
        "en": "You may explain your reasoning, but you MUST end with: {token} True or {token} False",
        "zh": "你可以解释推理过程，但必须以以下格式结尾：{token} True 或 {token} False",
    },
}

# Characters removed by a full whitespace strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ---- record schemas ---------------------------------------------------------

SAMPLE = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("dataset", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("sub_task", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("answer", T.StringType()),
    T.StructField("prompt", T.StringType()),
])

RESULT = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("query", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("predicted", T.StringType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("response", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("sub_task", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("error", T.StringType()),
])

# One step of a trace document. ``log_step`` is set on retrieval-log entries only.
STEP = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("step", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("properties", T.StringType()),
    T.StructField("observation", T.StringType()),
    T.StructField("state_experience", T.StringType()),
    T.StructField("log_step", T.IntegerType()),
    T.StructField("log_rounds", T.StringType()),
])

TRACE_FILE = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("sub_task", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("trace", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("trace_experience", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

BANK_META = T.StructType([
    T.StructField("bank_row", T.LongType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("state", T.IntegerType()),
    T.StructField("experience", T.StringType()),
    T.StructField("q_value", T.IntegerType()),
    T.StructField("state_text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("elements", T.StructType([
        T.StructField("question", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("observations", T.ArrayType(T.StringType())),
    ])),
    T.StructField("available_views", T.ArrayType(T.StringType())),
])

BANK_VECTORS = T.StructType([
    T.StructField("bank_row", T.LongType()),
    T.StructField("view", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

STEP_EVENT = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("event_seq", T.LongType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("view", T.StringType()),
    T.StructField("payload", T.StringType()),
])
