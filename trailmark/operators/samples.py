"""Source rows of multiple-choice benchmarks to the unified sample schema.

Every source is one entry of ``DIALECTS``: where its fields come from, how its
choices and answers are written, which rows count and how they are numbered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import choices as C
from trailmark.functions.text import first_non_empty, is_blank, strip
from trailmark.operators.filters import is_answerable, is_multi_choice_type
from trailmark.operators.trajectories import reindex

Expr = Callable[[], Column]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _choices() -> Column:
    return F.col("_choices")


@dataclass(frozen=True)
class Dialect:
    """Field rules of one source; expressions may use the parsed ``_choices``."""

    dataset: str
    choices: Expr
    answer: Expr
    question: Expr
    sub_task: Expr = lambda: F.lit("")
    prompt: Expr = lambda: F.lit("")
    before: Expr | None = None  # source rows that count, on raw columns
    keep: Expr | None = None  # rows that count once parsed (``_choices``, ``_answer``)
    images: str = "as_is"  # as_is, drop or placeholder
    idx_mode: str = "source"  # position in the source, or dense after filtering
    listed: tuple[str, ...] = ()  # columns that may hold a list, of which the first non-blank item counts


def _normal_options() -> Column:
    given = F.filter(F.transform(F.col("options"), strip), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.coalesce(F.size(given), F.lit(0)) >= 2, given).otherwise(C.colon_option_lines("question"))


def _mathverse_choices() -> Column:
    own = C.choices_block("question")
    return F.when(F.size(own) > 0, own).otherwise(C.choices_block("question_for_eval"))


def _two_or_more() -> Column:
    return F.size("_choices") >= 2


def _listed_or_dotted() -> Column:
    return F.when(F.coalesce(F.size("choices"), F.lit(0)) >= 2, F.col("choices")).otherwise(
        C.dotted_option_lines("question")
    )


def _zoom_answer() -> Column:
    raw = strip(_text("response"))
    return F.when(F.size("_choices") > 0, C.answer_text(raw, "_choices")).otherwise(raw)


def _letter_or_raw(name: str) -> Expr:
    """Plain letter answers; without choices the answer stays as it is."""
    return lambda: F.when(
        F.size("_choices") > 0, C.answer_text(F.col(name), "_choices", parens=False)
    ).otherwise(_text(name))


def _tree_answer() -> Column:
    return C.answer_text(F.col("answer"), "_choices", strip_answer=True)


# Dataset names, source column names and accepted type words are fixed values.
DIALECTS: dict[str, Dialect] = {
    "blink": Dialect(
        "BLINK", lambda: F.col("choices"), lambda: C.answer_text("answer", "_choices", hidden=True),
        lambda: F.col("question"), lambda: F.col("sub_task"), lambda: F.col("prompt"),
    ),
    "mmmu": Dialect(
        "MMMU", lambda: C.literal_options("options"), lambda: C.literal_answer("answer", "_choices"),
        lambda: _text("question"), lambda: first_non_empty("subfield", "topic_difficulty"),
        keep=lambda: is_multi_choice_type("question_type", "_choices"), idx_mode="dense",
    ),
    "mathverse": Dialect(
        "MathVerse", _mathverse_choices,
        lambda: C.answer_text("answer", "_choices", strip_answer=True, inner_strip=True, hidden=True),
        lambda: _text("question"), lambda: strip(_text("subfield")),
        lambda: F.when(C.has_option_block("question"), F.col("question")).otherwise(""),
        before=lambda: (F.col("question_type") == "multi-choice") & ~is_blank("question"), keep=_two_or_more,
    ),
    "mathvision": Dialect(
        "MathVision", _normal_options,
        lambda: C.answer_text("answer", "_choices", strip_answer=True, inner_strip=True, hidden=True),
        lambda: _text("question"), lambda: strip(_text("subject")), keep=_two_or_more, idx_mode="dense",
    ),
    "mme_realworld": Dialect(
        "MME-RealWorld-Lite",
        lambda: F.coalesce(F.transform("options", C.clean_choice), C.no_choices()),
        lambda: C.bracketed_answer("answer", F.coalesce("options", C.no_choices())),
        lambda: _text("question"), lambda: _text("category"), idx_mode="dense",
    ),
    "chartqa": Dialect(
        "ChartQAPro", lambda: C.loose_option_lines(strip("question")),
        lambda: C.answer_text("answer", "_choices", strip_answer=True),
        lambda: strip("question"), prompt=lambda: strip("question"),
        before=lambda: (F.upper(strip(_text("question_type"))) == "MULTI CHOICE") & ~is_blank("question"),
        keep=lambda: is_answerable("_answer", "_choices"), images="drop", listed=("question", "answer"),
    ),
    "mmsi": Dialect(
        "MMSI-Bench", lambda: C.comma_options("question"), _letter_or_raw("answer"),
        lambda: _text("question"), lambda: _text("question_type"), lambda: _text("question"),
    ),
    "mmstar": Dialect(
        "MMStar", lambda: C.split_options("question"),
        lambda: C.answer_text("answer", "_choices", hidden=True),
        lambda: _text("question"), lambda: _text("category"), lambda: _text("question"),
    ),
    "vstar": Dialect(
        "vstar_bench", lambda: C.paren_option_lines("text"), _letter_or_raw("label"),
        lambda: _text("text"), lambda: _text("category"), lambda: _text("text"), images="drop",
    ),
    "we_math": Dialect(
        "We-Math", lambda: C.semicolon_options("option"),
        lambda: C.answer_text("answer", "_choices", parens=False),
        lambda: _text("question"), lambda: _text("knowledge_concept"), images="drop",
    ),
    "realworldqa": Dialect(
        "RealWorldQA", _listed_or_dotted, lambda: C.answer_text("answer", "_choices"),
        lambda: _text("question"), prompt=lambda: _text("question"), keep=_two_or_more,
    ),
    "tir": Dialect(
        "TIR-Bench", lambda: C.prompt_option_lines("prompt"),
        lambda: C.single_letter_answer("answer", "_choices"),
        lambda: C.prompt_question("prompt"), lambda: _text("task"), lambda: _text("prompt"),
        before=lambda: F.col("answer").rlike("^[A-Za-z]$"), images="keep", idx_mode="dense",
    ),
    "zoom": Dialect(
        "ZoomBench", lambda: C.first_choices("choices", "options", "query"), _zoom_answer,
        lambda: _text("query"), lambda: first_non_empty("sub_task", "dimension", "category"),
        lambda: _text("query"), before=lambda: F.lower(_text("question_type")) == "mcq", idx_mode="dense",
    ),
    "o3": Dialect(
        "O3-Bench", lambda: C.labelled_list(_text("options")),
        lambda: F.when(is_blank("answer"), "").otherwise(C.answer_text("answer", "_choices")),
        lambda: _text("question"), lambda: _text("subset"),
    ),
    "tree": Dialect(
        "TreeBench", lambda: C.column_choices(*"ABCDEFGHIJK"), _tree_answer,
        lambda: strip(_text("question")), lambda: strip(_text("category")),
        keep=lambda: F.size("_choices") > 0, images="placeholder", idx_mode="dense",
    ),
    "hr": Dialect(
        "HR-Bench",
        lambda: F.filter(F.array(*[_text(c) for c in "ABCD"]), lambda x: x != ""),
        lambda: C.answer_text("answer", "_choices"), lambda: _text("question"),
        before=lambda: F.col("cycle_category").cast("string") == "0", idx_mode="dense",
    ),
}


def _first_items(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    lists = [f.name for f in df.schema.fields if f.name.lower() in names and isinstance(f.dataType, T.ArrayType)]
    for name in lists:
        items = F.filter(F.transform(F.col(name).cast("array<string>"), strip), lambda x: x != "")
        df = df.withColumn(name, F.coalesce(F.get(items, 0), F.lit("")))
    return df


def to_samples(df: DataFrame, dialect: str, idx_mode: str | None = None, position: str = "src_pos") -> DataFrame:
    """Unified samples of a source table; ``images`` holds its image paths."""
    d = DIALECTS[dialect]
    df = _first_items(df, d.listed)
    rows = df if d.before is None else df.where(d.before())
    # a generated column is no expression that Spark writes out anew wherever it is used, in the filter and in each field
    once = F.explode_outer(F.array("_parsed")).alias("_choices")
    parsed = rows.withColumn("_parsed", d.choices()).select(*rows.columns, once).withColumn("_answer", d.answer())
    if d.keep is not None:
        parsed = parsed.where(d.keep())
    picked = parsed.select(
        F.col(position).cast("long").alias("src_pos"),
        F.coalesce("images", C.no_choices()).alias("images"),
        F.lit(d.dataset).alias("dataset"), F.lit("multi-choice").alias("type"),
        d.sub_task().alias("sub_task"), d.question().alias("question"),
        F.coalesce("_choices", C.no_choices()).alias("choices"), F.col("_answer").alias("answer"),
        d.prompt().alias("prompt"),
    )
    if d.images == "drop":
        picked = picked.where(F.size("images") > 0)
    if (idx_mode or d.idx_mode) == "dense":
        numbered = reindex(picked)
    else:
        numbered = picked.withColumn("idx", F.col("src_pos"))
    if d.images == "placeholder":
        name = F.array(F.format_string("%05d/00000.png", "idx"))
        numbered = numbered.withColumn("images", F.when(F.size("images") > 0, F.col("images")).otherwise(name))
    return numbered.select(
        F.col("idx").cast("long").alias("idx"), "images", "dataset", "type", "sub_task", "question",
        "choices", "answer", "prompt", "src_pos",
    )


def image_rel_paths(df: DataFrame, count: str = "n_images", idx: str = "idx") -> DataFrame:
    """Add ``images``: ``{idx:05d}/{i:05d}.png`` for every stored image."""
    numbers = F.when(F.col(count) > 0, F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return df.withColumn(
        "images", F.transform(numbers, lambda i: F.format_string("%05d/%05d.png", F.col(idx).cast("long"), i))
    )
