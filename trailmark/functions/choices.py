"""Choices and answers of multiple-choice sources, one function per text layout."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.text import col, strip, stripped_lines
from trailmark.schemas import WHITESPACE as _SPACE

# The option formats of the sources. They say which texts are options and have to accept the same texts
# as the tools the sources were made for.
BLOCK_MARK, OPTIONS_MARK, HINT = "Choices:", "Options:", "answer with"
BLOCK_HEAD = r"(?is)\bchoices\s*:\s*\n"
BLOCK_LABEL = r"(?i)^([A-Z])[:\s\)]\s*(.*)$"
COMMA_OPTION = r"(?s)([A-Z]):\s*(.*?)(?=\s*,\s*[A-Z]:\s*|$)"
COLON_CUT = r"\s*[A-Z]:\s*"
COLON_LINE = r"(?i)^([A-D])\s*[:\)]\s*(.+?)\s*$"
COLON_LINE_ANYWHERE = r"(?m)^\s*([A-D])\s*[:\)]\s*.+$"
PAREN_LABEL, PAREN_LINE = r"^\([A-Z]\)", r"^\(([A-Z])\)\s*(.*)$"
SEMICOLON_LABEL = r"^[A-Za-z]\.\s*(.*)$"
DOTTED_LINE = r"^([A-D])\.\s*(.+)$"
RUNNING_OPTION = r"(?is)\(?([A-F])\)?\s*[.:]\s*(.*?)(?=\s*\(?[A-F]\)?\s*[.:]\s*|\s*$)"
LETTERED_LINE = r"(?i)^[A-F][.)]\s*(.*)$"
PROMPT_LINE = r"^([A-Z])[:\.]\s*(.+)$"
LABEL_CUT = r"\s*[\(]?[A-Za-z][\)]\s*"


def no_choices() -> Column:
    return F.array().cast("array<string>")


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def _after(c: Column, mark: str) -> Column:
    """Stripped text after the first ``mark``; null when the mark is absent."""
    at = F.instr(c, mark)
    return F.when(at > 0, strip(F.substring(c, at + len(mark), F.length(c))))


def _lines_matching(lines: Column, pattern: str, group: int) -> Column:
    """Stripped ``group`` of every line that matches ``pattern``."""
    hits = F.filter(lines, lambda x: x.rlike(pattern))
    return F.transform(hits, lambda x: strip(F.regexp_extract(x, pattern, group)))


def _first_filled(*options: Column) -> Column:
    out = no_choices()
    for o in reversed(options):
        out = F.when(F.coalesce(F.size(o), F.lit(0)) > 0, o).otherwise(out)
    return out


# ---- layouts ----------------------------------------------------------------


def choices_block(question: Column | str) -> Column:
    """Lines after ``Choices:``, option labels removed."""
    block = _after(col(question), BLOCK_MARK)
    return F.coalesce(
        F.transform(
            _present(stripped_lines(block)),
            lambda x: F.when(x.rlike(BLOCK_LABEL), strip(F.regexp_extract(x, BLOCK_LABEL, 2))).otherwise(x),
        ),
        no_choices(),
    )


def comma_options(question: Column | str) -> Column:
    """``Options: A: .., B: ..`` where a text may hold commas."""
    block = F.nullif(_after(col(question), OPTIONS_MARK), F.lit(""))
    found = F.regexp_extract_all(block, F.lit(COMMA_OPTION), 2)
    return F.coalesce(F.transform(found, strip), no_choices())


def split_options(question: Column | str) -> Column:
    """``Options:`` text cut at every ``X:`` label, closing punctuation removed."""
    block = F.nullif(_after(col(question), OPTIONS_MARK), F.lit(""))
    parts = F.split(block, COLON_CUT)
    texts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.coalesce(
        _present(F.transform(texts, lambda x: strip(F.rtrim(strip(x), F.lit(".,;"))))), no_choices()
    )


def colon_option_lines(question: Column | str) -> Column:
    """Lines ``A: text`` or ``B) text``, labels A to D."""
    return F.coalesce(
        _lines_matching(stripped_lines(question), COLON_LINE, 2), no_choices()
    )


def _paren_parts(text: Column | str) -> Column:
    """Non-empty lines before the closing answer hint."""
    lines = _present(stripped_lines(text))
    stop = F.array_position(
        F.transform(
            lines,
            lambda x: ~x.rlike(PAREN_LABEL) & F.contains(F.lower(x), F.lit(HINT)),
        ),
        True,
    )
    return F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)


def paren_option_lines(text: Column | str) -> Column:
    """Lines ``(A) text`` up to the answer hint."""
    return F.coalesce(_lines_matching(_paren_parts(text), PAREN_LINE, 2), no_choices())


def paren_question(text: Column | str) -> Column:
    """Question lines of the ``(A) text`` layout joined by blanks; first line when there are none."""
    asked = F.filter(_paren_parts(text), lambda x: ~x.rlike(PAREN_LABEL))
    return F.when(F.size(asked) > 0, strip(F.array_join(asked, " "))).otherwise(
        F.substring_index(col(text), "\n", 1)
    )


def semicolon_options(text: Column | str) -> Column:
    """``A. one;B. two``."""
    parts = _present(F.transform(F.split(col(text), ";"), strip))
    return F.coalesce(
        F.transform(
            parts, lambda x: F.when(x.rlike(SEMICOLON_LABEL), strip(F.regexp_extract(x, SEMICOLON_LABEL, 1))).otherwise(x)
        ),
        no_choices(),
    )


def dotted_option_lines(question: Column | str) -> Column:
    """Unindented lines ``A. text``, labels A to D, in label order."""
    hits = F.filter(F.split(col(question), "\n"), lambda x: x.rlike(DOTTED_LINE))
    ordered = F.array_sort(
        F.transform(
            hits,
            lambda x, i: F.struct(
                F.regexp_extract(x, DOTTED_LINE, 1).alias("tag"), i.alias("i"),
                strip(F.regexp_extract(x, DOTTED_LINE, 2)).alias("text"),
            ),
        )
    )
    return F.coalesce(F.transform(ordered, lambda s: s["text"]), no_choices())


def labelled_list(text: Column | str) -> Column:
    """Running ``(A): one (B): two`` or ``A. one B. two`` text, labels A to F."""
    return F.coalesce(
        F.transform(F.regexp_extract_all(strip(text), F.lit(RUNNING_OPTION), 2), strip), no_choices()
    )


def lettered_lines(text: Column | str) -> Column:
    """Lines ``A. text`` or ``A) text``, labels A to F."""
    return F.coalesce(_lines_matching(stripped_lines(text), LETTERED_LINE, 1), no_choices())


def loose_option_lines(text: Column | str) -> Column:
    """Option lines that begin with a letter A to D, with or without punctuation behind it.

    A label that stands alone takes the next line as its text, or is an empty option when only white space follows.
    A text ends where the next label with punctuation stands in its line. Lower-case letters are labels, and texts
    then whole lines, when no capital one begins a line.
    """
    raw = col(text)

    def texts(kept: Column, label: str) -> Column:
        return F.transform(F.filter(kept, lambda x: (F.length(x) > 1) & F.rlike(x, F.lit(f"^{label}"))), _unlabelled)

    def owned(lines: Column) -> Column:
        # of lines that follow each other as bare labels every second one begins an option; a line behind it is its text
        bare = F.transform(lines, lambda x: F.rlike(x, F.lit("^[A-D][.):]?$")))
        begins = F.aggregate(bare, F.struct(F.lit("").alias("marks"), F.lit(False).alias("open")), lambda acc, x: F.struct(
            F.concat(acc["marks"], F.when(acc["open"], "t").when(x, "b").otherwise("-")).alias("marks"), (~acc["open"] & x).alias("open")))
        return F.struct(lines.alias("lines"), begins["marks"].alias("marks"), begins["open"].alias("open"))

    def options(s: Column) -> Column:
        mark = lambda i: F.substring(s["marks"], i + 1, F.lit(1))
        joined = F.transform(s["lines"], lambda x, i: F.when(mark(i) == "t", F.concat(F.get(s["lines"], i - 1), F.lit(" "), x)).when(mark(i) == "-", x))
        done = F.filter(joined, lambda x: x.isNotNull())
        last = F.get(s["lines"], F.size(s["lines"]) - 1)
        alone = F.when(~s["open"], no_choices()).when(F.rlike(raw, F.lit(r"\s$")), F.array(F.lit(""))).otherwise(
            F.transform(F.filter(F.array(last), lambda x: F.length(x) > 1), _unlabelled)
        )
        capital = F.transform(texts(done, "[A-D]"), lambda x: strip(F.concat(F.left(x, F.lit(1)), F.get(F.split(F.substring(x, 2, 1 << 30), r"\s*[A-D][.):]"), F.lit(0)))))
        return _first_filled(F.concat(capital, alone), texts(s["lines"], "[A-Da-d]"))

    return _let(_let(_present(stripped_lines(raw)), owned), options)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unlabelled(line: Column) -> Column:
    """A line without its first letter and the punctuation behind it, which stays when nothing else follows."""
    rest = F.substring(line, 2, 1 << 30)
    inner = F.when(F.rlike(rest, F.lit("^[.):]")), strip(F.substring(rest, 2, 1 << 30))).otherwise(strip(rest))
    return F.when(inner == "", strip(rest)).otherwise(inner)


def prompt_option_lines(prompt: Column | str) -> Column:
    """Lines ``A: text`` or ``A. text``, any capital label."""
    return F.coalesce(_lines_matching(stripped_lines(prompt), PROMPT_LINE, 2), no_choices())


def prompt_question(prompt: Column | str) -> Column:
    """First line of a prompt."""
    return strip(F.substring_index(strip(F.coalesce(col(prompt), F.lit(""))), "\n", 1))


def column_choices(*cols: Column | str) -> Column:
    """Non-blank option columns, in order."""
    return _present(F.transform(F.array(*[col(c) for c in cols]), strip))


# Lists of plainly quoted texts mean the same in JSON and in Python.
_PLAIN_ITEM = r"""(?:'[^'\\\p{Cntrl}]*'|"[^"\\\p{Cntrl}]*")"""
_PLAIN_LIST = rf"^\[\s*{_PLAIN_ITEM}(?:\s*,\s*{_PLAIN_ITEM})*+\s*\]$"


def _python_list(text: str | None) -> list | None:
    try:
        items = ast.literal_eval(text) if text else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    return items if isinstance(items, list) else None


def _list_items(texts: pd.Series) -> pd.Series:
    """Stripped items of Python list literals, None left out; null for any other text."""
    found = [_python_list(t) for t in texts]
    return pd.Series([None if x is None else [str(i).strip() for i in x if i is not None] for x in found], dtype=object)


def _list_answer(texts: pd.Series) -> pd.Series:
    """The item of a one-item list literal, a longer list as text; null for any other text."""
    found = [_python_list(t) for t in texts]
    return pd.Series([str(x[0] if len(x) == 1 else x).strip() if x else None for x in found], dtype=object)


def literal_options(text: Column | str) -> Column:
    """Items of a Python list literal, else text cut at ``A)`` labels, else its lines."""
    s = strip(text)
    plain = s.rlike(_PLAIN_LIST)
    quoted = F.when(plain, F.transform(F.from_json(s, "array<string>", {"allowSingleQuotes": "true"}), strip))
    items = F.pandas_udf(_list_items, T.ArrayType(T.StringType()))
    parsed = F.coalesce(quoted, items(F.when(s.startswith("[") & ~plain, s)))
    parts = _present(F.transform(F.split(s, LABEL_CUT), strip))
    return F.coalesce(
        parsed,
        F.when(F.size(parts) > 1, parts),
        _present(stripped_lines(s)),
        no_choices(),
    )


PARSERS: dict[str, Callable[[Column | str], Column]] = {
    "choices_block": choices_block,
    "comma_options": comma_options,
    "split_options": split_options,
    "colon_option_lines": colon_option_lines,
    "paren_option_lines": paren_option_lines,
    "semicolon_options": semicolon_options,
    "dotted_option_lines": dotted_option_lines,
    "labelled_list": labelled_list,
    "lettered_lines": lettered_lines,
    "loose_option_lines": loose_option_lines,
    "prompt_option_lines": prompt_option_lines,
    "literal_options": literal_options,
}


def parse_choices(c: Column | str, dialect: str) -> Column:
    """Choices of a text in the named layout."""
    return PARSERS[dialect](c)


def first_choices(choices: Column | str, options: Column | str, question: Column | str) -> Column:
    """Declared choices, else the option text, else option lines of the question."""
    option_text = strip(options)
    has_options = F.coalesce(option_text, F.lit("")) != ""
    return (
        F.when(F.coalesce(F.size(col(choices)), F.lit(0)) > 0, col(choices))
        .when(has_options, labelled_list(options))
        .otherwise(lettered_lines(F.coalesce(col(question), F.lit(""))))
    )


def has_option_block(question: Column | str) -> Column:
    """Question text that already carries its options."""
    q = F.coalesce(col(question), F.lit(""))
    return q.rlike(BLOCK_HEAD) | q.rlike(COLON_LINE_ANYWHERE)


def clean_choice(c: Column | str) -> Column:
    """Choice text without a leading ``(A)``, ``A.``, ``A)`` or ``A:``."""
    s = F.ltrim(col(c), F.lit(_SPACE))
    return F.ltrim(
        F.when(s.rlike(r"^\(\p{L}\)."), F.substring(s, 4, 1 << 30))
        .when(s.rlike(r"^\p{L}[.)：:]."), F.substring(s, 3, 1 << 30))
        .otherwise(s),
        F.lit(_SPACE),
    )


# ---- answers ----------------------------------------------------------------


def choice_for_letter(tag: Column, choices: Column | str) -> Column:
    """Choice a capital letter points at; null for anything else."""
    return F.get(col(choices), F.when(tag.rlike("^[A-Z]$"), F.ascii(tag) - 65))


def answer_text(
    answer: Column | str,
    choices: Column | str,
    *,
    strip_answer: bool = False,
    inner_strip: bool = False,
    parens: bool = True,
    hidden: bool = False,
) -> Column:
    """Answer letter (``A``, ``(A)``, ``A)``) to choice text; the answer itself when it is no letter in range."""
    raw = F.coalesce(col(answer), F.lit(""))
    kept = strip(raw) if strip_answer else raw
    tag = F.btrim(kept, F.lit("()")) if parens else strip(kept)
    if inner_strip:
        tag = strip(tag)
    text = F.coalesce(choice_for_letter(F.upper(tag), choices), kept)
    return F.when(kept == "hidden", F.lit("")).otherwise(text) if hidden else text


def bracketed_answer(answer: Column | str, raw_choices: Column | str) -> Column:
    """Answer given as a letter or as one of the labelled choices; returns the cleaned choice."""
    raw = F.coalesce(col(answer), F.lit(""))
    cleaned = F.transform(col(raw_choices), clean_choice)
    tag = F.upper(strip(F.regexp_replace(F.regexp_replace(strip(raw), r"^\(", ""), r"\)$", "")))
    return (
        F.when(raw == "", F.lit(""))
        .when(F.array_contains(col(raw_choices), raw), clean_choice(raw))
        .otherwise(F.coalesce(choice_for_letter(F.left(tag, F.lit(1)), cleaned), raw))
    )


def literal_answer(answer: Column | str, choices: Column | str) -> Column:
    """Answer that may be written as a one-item list."""
    s = strip(F.coalesce(col(answer), F.lit("")))
    listed = F.pandas_udf(_list_answer, T.StringType())(F.when(s.startswith("["), s))
    return F.coalesce(listed, answer_text(s, choices))


def single_letter_answer(answer: Column | str, choices: Column | str) -> Column:
    """Stripped upper-case answer; a single letter becomes its choice."""
    s = F.upper(strip(F.coalesce(col(answer), F.lit(""))))
    return F.coalesce(choice_for_letter(s, choices), s)
