"""String and array expressions for queries, answers, traces and observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.schemas import ANSWER_TOKEN, INSTRUCTIONS, ORDINALS, WHITESPACE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove whitespace of every kind at both ends (``trim`` removes blanks only)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0)) == 0


def first_non_empty(*cols: Column | str) -> Column:
    """First value that is neither null nor the empty string, else ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def stripped_lines(c: Column | str) -> Column:
    """Lines of a text, stripped."""
    return F.transform(F.split(col(c), "\n"), strip)


def numbered(items: Column) -> Column:
    """``1. first`` / ``2. second`` lines joined by a newline."""
    return F.array_join(
        F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
    )


# ---- options and answers ----------------------------------------------------


def option_tag(i: Column, option_format: str = "letter") -> Column:
    """Label of the option at 0-based position ``i``."""
    if option_format == "numeric":
        return (i + 1).cast("string")
    if option_format != "letter":
        raise ValueError(f"option format {option_format!r}: use 'letter' or 'numeric'")
    # Past Z the labels continue with the characters after z.
    return F.when(i < 26, F.char(i + 65)).otherwise(F.char(i + 97))


def make_options(choices: Column | str, option_format: str = "letter") -> Column:
    """``(A) text`` for every choice."""
    return F.transform(
        col(choices),
        lambda c, i: F.concat(F.lit("("), option_tag(i, option_format), F.lit(") "), c),
    )


def task_instruction(task_type: Column | str, zh: bool = False, token: str = ANSWER_TOKEN) -> Column:
    """Instruction text of a task type; '' for an unknown type."""
    lang = "zh" if zh else "en"
    out = F.lit("")
    for name, texts in INSTRUCTIONS.items():
        out = F.when(col(task_type) == name, F.lit(texts[lang].format(token=token))).otherwise(out)
    return out


def build_query(
    prompt: Column | str,
    question: Column | str,
    choices: Column | str,
    task_type: Column | str,
    zh: bool = False,
    token: str = ANSWER_TOKEN,
) -> Column:
    """Prompt or question, then the options when there is no prompt, then the instruction."""
    no_prompt = F.coalesce(col(prompt), F.lit("")) == ""
    options = F.when(no_prompt & (F.size(col(choices)) > 0), F.array_join(make_options(choices), "\n"))
    instruction = task_instruction(F.coalesce(col(task_type), F.lit("open-ended")), zh, token)
    return F.concat_ws(
        "\n\n",
        strip(first_non_empty(prompt, question)),
        options,
        F.nullif(instruction, F.lit("")),
    )


def extract_answer(response: Column | str, token: str = ANSWER_TOKEN) -> Column:
    """First line after the last answer token; '' without a token."""
    mark = token.lstrip("\n")
    tail = strip(F.substring_index(col(response), mark, -1))
    return F.when(
        F.contains(col(response), F.lit(mark)), strip(F.substring_index(tail, "\n", 1))
    ).otherwise(F.lit(""))


def match_choice(
    predicted: Column | str, choices: Column | str, option_format: str = "letter"
) -> Column:
    """Choice a prediction stands for, or null.

    A leading option label wins, then the exact choice text, then the first
    choice that contains the prediction or is contained in it.
    """
    pred = F.lower(strip(predicted))
    texts = F.transform(col(choices), strip)
    tag = F.regexp_extract(pred, r"^\(?([a-z]|\d+)\)?(?![a-z0-9])", 1)
    if option_format == "numeric":
        pos = F.when(tag.rlike(r"^[1-9]\d*$"), tag.try_cast("int") - 1)
    else:
        pos = F.when(tag.rlike("^[a-z]$"), F.ascii(tag) - 97)

    def overlaps(c: Column) -> Column:
        low = F.lower(c)
        return (
            (F.length(low) > 1)
            & (F.length(pred) > 1)
            & (F.contains(pred, low) | F.contains(low, pred))
        )

    return F.when(
        pred != "",
        F.coalesce(
            F.get(texts, pos),
            F.get(F.filter(texts, lambda c: F.lower(c) == pred), 0),
            F.get(F.filter(texts, overlaps), 0),
        ),
    )


def scoring_error(predicted: Column | str, task_type: Column | str) -> Column:
    """Error text for a task type that cannot be scored, else null."""
    return F.when(
        (F.coalesce(col(predicted), F.lit("")) != "")
        & ~F.coalesce(col(task_type) == "multi-choice", F.lit(False)),
        F.concat(
            F.lit("Task type '"), F.coalesce(col(task_type), F.lit("None")),
            F.lit("' is not implemented yet"),
        ),
    )


def is_answer_correct(
    predicted: Column | str,
    ground_truth: Column | str,
    task_type: Column | str,
    choices: Column | str,
    option_format: str = "letter",
) -> Column:
    """Whether a prediction stands for the ground truth."""
    truth = F.lower(strip(ground_truth))
    matched = match_choice(predicted, choices, option_format)
    plain = F.lower(strip(predicted)) == truth
    by_choice = (F.coalesce(matched, F.lit("")) != "") & (F.lower(matched) == truth)
    no_choices = F.coalesce(F.size(col(choices)), F.lit(0)) <= 0
    hit = F.when(no_choices, plain).otherwise(by_choice)
    scored = (F.coalesce(col(predicted), F.lit("")) != "") & (col(task_type) == "multi-choice")
    return F.coalesce(scored & hit, F.lit(False))


# ---- traces -----------------------------------------------------------------
# Labels, tags and the words of the texts below are fixed values.


def index_text(question: Column | str, sub_task: Column | str) -> Column:
    """Text a trace is indexed by."""
    return F.concat_ws(
        "\n", _labelled("Question: ", col(question)), _labelled("Task: ", col(sub_task))
    )


def _labelled(label: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))


def source_tag(source: Column | str) -> Column:
    return F.when(
        F.coalesce(col(source), F.lit("correct")) == "correct", F.lit("[Learned from success]")
    ).otherwise(F.lit("[Learned from failure]"))


def format_trace(steps: Column | str) -> Column:
    """Numbered think/answer texts and ``[tool]`` marks of a trace; ``N/A`` when empty."""

    def text(s: Column) -> Column:
        said = s["type"].isin("think", "answer") & (F.coalesce(s["content"], F.lit("")) != "")
        acted = (s["type"] == "action") & s["tool"].isNotNull()
        return F.when(said, s["content"]).when(acted, F.concat(F.lit("["), s["tool"], F.lit("]")))

    shown = F.filter(F.transform(col(steps), text), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.size(shown), F.lit(0)) > 0, numbered(shown)).otherwise(F.lit("N/A"))


def used_tools(steps: Column | str) -> Column:
    """True when the trace holds an action step; a missing trace counts as none."""
    return F.coalesce(F.exists(col(steps), lambda s: s["type"] == "action"), F.lit(False))


def describe_input(pos: Column | str, modality: Column | str) -> Column:
    """``The first input image`` .. ``The tenth ..``, then ``Input image 11``."""
    noun = F.when(col(modality) == "vid", F.lit("video")).otherwise(F.lit("image"))
    word = F.get(F.array(*[F.lit(w) for w in ORDINALS]), col(pos).cast("int"))
    return F.coalesce(
        F.concat(F.lit("The "), word, F.lit(" input "), noun),
        F.concat(F.lit("Input "), noun, F.lit(" "), (col(pos).cast("int") + 1).cast("string")),
    )


def task_id_text(n: Column | str) -> Column:
    """Six-digit task id; longer numbers stay whole."""
    return F.format_string("%06d", col(n).cast("long"))


# ---- observations -----------------------------------------------------------
# The texts of observations, descriptions and messages below are fixed values.


def format_regions(regions: Column | str) -> Column:
    """``label at [x1, y1, x2, y2]`` items of a region list."""
    return F.array_join(
        F.transform(
            col(regions),
            lambda r: F.concat(
                r["label"], F.lit(" at ["),
                F.array_join(F.transform(r["bbox"], lambda v: v.cast("string")), ", "), F.lit("]"),
            ),
        ),
        ", ",
    )


def format_observation(data: Column | str) -> Column:
    """``Key: value`` text of an observation map, in entry order; a missing value reads ``None``."""
    m = col(data)

    def entry(e: Column) -> Column:
        key = e["key"]
        return F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 30), F.lit(": "), F.coalesce(e["value"], F.lit("None")))

    body = F.array_join(F.transform(F.map_entries(m), entry), ", ")
    return (
        F.when(F.coalesce(F.size(m), F.lit(0)) <= 0, F.lit("success"))
        .when(F.map_contains_key(m, "error"), F.concat(F.lit("Error: "), F.coalesce(m["error"], F.lit("None"))))
        .otherwise(body)
    )


def output_observation(
    output_id: Column | str, description: Column | str, data: Column | str, memory: bool = True
) -> Column:
    """Text shown for a tool that produced a media object."""
    prefix = "Saved to memory as " if memory else "Generated "
    return F.concat_ws(
        ". ",
        F.concat(F.lit(prefix), col(output_id), F.lit(": "), col(description)),
        F.when(F.size(col(data)) > 0, format_observation(data)),
    )


def media_observation(
    output_id: Column | str, modality: Column | str, description: Column | str, data: Column | str
) -> Column:
    """Map ``id, type, description`` overlaid by the tool's own data."""
    base = F.create_map(
        F.lit("id"), col(output_id), F.lit("type"), col(modality),
        F.lit("description"), col(description),
    )
    own = F.coalesce(col(data), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def describe_output(tool: Column | str, properties: Column | str) -> Column:
    """Description of a tool's media output from its parameter map."""
    t, p = col(tool), col(properties)
    image = F.coalesce(p["image"], F.lit("image"))
    box = F.coalesce(p["bbox_2d"], F.lit("[]"))
    regions = F.from_json(F.coalesce(p["regions"], F.lit("[]")), "array<string>")
    count = F.greatest(F.coalesce(F.size(regions), F.lit(0)), F.lit(0)).cast("string")
    factor = F.coalesce(p["zoom_factor"], F.lit("2"))
    return (
        F.when(t == "crop", F.concat(F.lit("Cropped "), image, F.lit(" at bbox_2d "), box))
        .when(
            t == "zoom_in",
            F.concat(F.lit("Zoomed in "), image, F.lit(" at bbox_2d "), box, F.lit(" by "), factor, F.lit("x")),
        )
        .when(
            t == "visualize_regions",
            F.concat(F.lit("Visualized "), count, F.lit(" regions on "), image),
        )
        .otherwise(F.concat(t, F.lit(" output")))
    )


def view_message(ids: Column | str) -> Column:
    """Sentence that lists the requested media ids, or the id-format error."""
    a = col(ids)
    bad = F.get(F.filter(a, lambda x: ~x.rlike("^(img_|vid_)")), 0)
    listed = F.concat(
        F.array_join(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), ", "),
        F.lit(" and "), F.try_element_at(a, F.lit(-1)),
    )
    return (
        F.when(
            bad.isNotNull(),
            F.concat(F.lit("Invalid image ID format: "), bad, F.lit(". Expected format: 'img_0', 'img_1', etc.")),
        )
        .when(F.size(a) == 1, F.concat(F.lit("You can now view "), F.get(a, 0), F.lit(".")))
        .otherwise(
            F.concat(
                F.lit("You can now view "), F.size(a).cast("string"),
                F.lit(" images in order: "), listed, F.lit("."),
            )
        )
    )


def truncate_text(c: Column | str, n: int = 150) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n)), F.lit("..."))).otherwise(col(c))


def split_tags(c: Column | str) -> Column:
    return F.split(col(c), r" \| ")


def prefix_task_id(prefix: Column | str, task_id: Column | str) -> Column:
    return F.concat_ws("_", prefix if isinstance(prefix, Column) else F.lit(prefix), col(task_id))


def bank_spec(spec: Column | str) -> Column:
    """``prefix:path`` as a struct, split at the first colon; null without one."""
    s = col(spec)
    at = F.instr(s, ":")
    return F.when(
        at > 0,
        F.struct(
            strip(F.substring_index(s, ":", 1)).alias("prefix"),
            strip(F.substring(s, at + 1, F.length(s))).alias("path"),
        ),
    )


def non_empty_metadata(m: Column | str) -> Column:
    return F.map_filter(col(m), lambda k, v: v.isNotNull() & (v != ""))


def with_refs(query: Column | str, ref_ids: Column | str) -> Column:
    """Query led by the list of available image ids, when there are any."""
    refs = F.array_join(col(ref_ids), ", ")
    return F.when(
        F.coalesce(F.size(col(ref_ids)), F.lit(0)) > 0,
        F.concat(F.lit("Available images: "), refs, F.lit("\n\n"), col(query)),
    ).otherwise(col(query))


def relabel_refs(text: Column | str) -> Column:
    return F.replace(col(text), F.lit("Available images:"), F.lit("Images in memory:"))


def replace_values(m: Column | str, lookup: Column | str) -> Column:
    """Values of a flat string map replaced through a lookup map; others unchanged."""
    table = col(lookup)
    return F.transform_values(col(m), lambda k, v: F.coalesce(F.try_element_at(table, v), v))
