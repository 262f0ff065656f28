"""Source layouts, media, sinks, tools and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import choices as C
from trailmark.functions import jsons as J
from trailmark.functions import models
from trailmark.functions import text as X
from trailmark.functions import tools
from trailmark.operators import samples as S
from trailmark.plans import bindings as B
from trailmark.plans.registry import query
from trailmark.session import checkpoint_dir
from trailmark.sources import banks as SB
from trailmark.sources import media, tables

# ---- benchmark layouts ------------------------------------------------------

# A raw benchmark row per document: its lines, letters only, are the options, and the
# answer letter may point past the last one.
B.cte("raw", r"""
SELECT doc_id, lang, opts, chr((65 + doc_id % 8)::INT) AS letter, opts[doc_id % 8 + 1] AS hit FROM (
  SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L} ]', '', 'g'))), lambda x: x <> '') AS opts
  FROM documents)""")


def _raw(spark, d):
    d_ = B.table(spark, d, "documents")
    clean = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L} ]", "")))
    return d_.select(
        "doc_id", F.col("doc_id").alias("src_pos"), "lang", F.filter(clean, lambda x: x != "").alias("opts"),
        F.char(F.col("doc_id") % 8 + 65).alias("letter"), F.array(F.lit("00000/00000.png")).alias("images"),
    )


def _block(m: int, pre: str, post: str, delim: str):
    """Labelled options, labels starting over after ``m``."""
    return F.array_join(
        F.transform("opts", lambda x, i: F.concat(F.lit(pre), F.char(i % m + 65), F.lit(post), x)), delim
    )


def _block_sql(m: int, pre: str, post: str, delim: str) -> str:
    sep = delim.replace("\n", "' || chr(10) || '")
    return f"array_to_string(list_transform(opts, lambda x, i: '{pre}' || chr((65 + (i - 1) % {m})::INT) || '{post}' || x), '{sep}')"


def _asked(block):
    return F.concat(F.lit("Question "), F.col("doc_id").cast("string"), F.lit("\n"), block)


def _asked_sql(block: str) -> str:
    return f"'Question ' || doc_id || chr(10) || {block}"


_PLAIN = (4, "", ". ", "\n")
_COLON = (4, "", ": ", "\n")
_VERSE = (26, "", ":", "\n")
_COMMA = (26, "", ": ", ", ")
_PAREN = (26, "(", ") ", "\n")
_SEMI = (26, "", ". ", ";")
_LONG = (6, "(", "): ", "\n")
_NO_LIST = lambda: F.lit(None).cast("array<string>")

_MMSI = ("'Question ' || doc_id || '? Options: ' || " + _block_sql(*_COMMA))
_VSTAR = _asked_sql(_block_sql(*_PAREN)) + " || chr(10) || 'Answer with the option'"
_SORTED = "list_transform(list_sort(list_transform(opts, lambda x, i: {'t': (i - 1) % 4, 'i': i, 'x': x})), lambda s: s.x)"

# Per layout: raw columns, then SQL for question, choices, answer, sub_task, prompt, kept rows.
_LAYOUTS = {
    "blink": (
        lambda: {"question": F.lit("Q"), "choices": F.col("opts"), "answer": F.concat(F.lit("("), "letter", F.lit(")")),
                 "sub_task": F.col("lang"), "prompt": F.concat(F.lit("P "), "lang")},
        "'Q'", "opts", "coalesce(hit, '(' || letter || ')')", "lang", "'P ' || lang", "true"),
    "mmmu": (
        lambda: {"question": F.lit("Q"), "answer": F.col("letter"), "subfield": F.lit(""), "topic_difficulty": F.col("lang"),
                 "question_type": F.lit(None).cast("string"),
                 "options": F.concat(F.lit("["), F.array_join(F.transform("opts", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))},
        "'Q'", "opts", "coalesce(hit, letter)", "lang", "''", "len(opts) >= 2"),
    "mathverse": (
        lambda: {"question": _asked(F.concat(F.lit("Choices:\n"), _block(*_VERSE))), "question_for_eval": F.lit(""),
                 "question_type": F.lit("multi-choice"), "answer": F.concat(F.lit(" ("), "letter", F.lit(") ")), "subfield": F.concat(F.lit(" "), "lang")},
        _asked_sql("'Choices:' || chr(10) || " + _block_sql(*_VERSE)), "opts", "coalesce(hit, '(' || letter || ')')", "lang",
        _asked_sql("'Choices:' || chr(10) || " + _block_sql(*_VERSE)), "len(opts) >= 2"),
    "mathvision": (
        lambda: {"question": _asked(_block(*_COLON)), "options": _NO_LIST(), "answer": F.col("letter"), "subject": F.col("lang")},
        _asked_sql(_block_sql(*_COLON)), "opts", "coalesce(hit, letter)", "lang", "''", "len(opts) >= 2"),
    "mme_realworld": (
        lambda: {"question": F.lit("Q"), "options": F.transform("opts", lambda x, i: F.concat(F.lit("("), F.char(i % 26 + 65), F.lit(") "), x)),
                 "answer": F.concat("letter", F.lit(")")), "category": F.col("lang")},
        "'Q'", "opts", "coalesce(hit, letter || ')')", "lang", "''", "true"),
    "chartqa": (
        lambda: {"question": F.concat(F.lit(" "), _asked(_block(*_PLAIN))), "answer": F.col("letter"), "question_type": F.lit(" Multi Choice")},
        _asked_sql(_block_sql(*_PLAIN)), "opts", "coalesce(hit, letter)", "''", _asked_sql(_block_sql(*_PLAIN)),
        "len(opts) = 0 OR list_contains(opts, coalesce(hit, letter))"),
    "mmsi": (
        lambda: {"question": F.concat(F.lit("Question "), F.col("doc_id").cast("string"), F.lit("? Options: "), _block(*_COMMA)),
                 "answer": F.col("letter"), "question_type": F.col("lang")},
        _MMSI, "opts", "coalesce(hit, letter)", "lang", _MMSI, "true"),
    "mmstar": (
        lambda: {"question": F.concat(F.lit("Question "), F.col("doc_id").cast("string"), F.lit("? Options: "), _block(*_COMMA)),
                 "answer": F.when(F.col("lang") == "fr", "hidden").otherwise(F.lower("letter")), "category": F.col("lang")},
        _MMSI, "opts", "CASE WHEN lang = 'fr' THEN '' ELSE coalesce(hit, lower(letter)) END", "lang", _MMSI, "true"),
    "vstar": (
        lambda: {"text": F.concat(_asked(_block(*_PAREN)), F.lit("\nAnswer with the option")), "label": F.col("letter"), "category": F.col("lang")},
        _VSTAR, "opts", "coalesce(hit, letter)", "lang", _VSTAR, "true"),
    "we_math": (
        lambda: {"question": F.lit("Q"), "option": _block(*_SEMI), "answer": F.concat(F.lit(" "), F.lower("letter")), "knowledge_concept": F.col("lang")},
        "'Q'", "opts", "coalesce(hit, ' ' || lower(letter))", "lang", "''", "true"),
    "realworldqa": (
        lambda: {"question": _asked(_block(*_PLAIN)), "choices": _NO_LIST(), "answer": F.col("letter")},
        _asked_sql(_block_sql(*_PLAIN)), _SORTED, f"coalesce({_SORTED}[doc_id % 8 + 1], letter)", "''", _asked_sql(_block_sql(*_PLAIN)), "len(opts) >= 2"),
    "tir": (
        lambda: {"prompt": _asked(_block(26, "", ": ", "\n")), "answer": F.lower("letter"), "task": F.col("lang")},
        "'Question ' || doc_id", "opts", "coalesce(hit, letter)", "lang", _asked_sql(_block_sql(26, "", ": ", "\n")), "true"),
    "zoom": (
        lambda: {"query": F.lit("Q"), "choices": _NO_LIST(), "options": _block(*_LONG), "response": F.concat("letter", F.lit("\n")),
                 "question_type": F.lit("MCQ"), "sub_task": F.lit(""), "dimension": F.col("lang"), "category": F.lit("c")},
        "'Q'", "opts", "coalesce(hit, letter)", "lang", "'Q'", "true"),
    "o3": (
        lambda: {"question": F.lit("Q"), "options": _block(6, "(", "): ", " "), "answer": F.col("letter"), "subset": F.col("lang")},
        "'Q'", "opts", "coalesce(hit, letter)", "lang", "''", "true"),
    "tree": (
        lambda: {"question": F.lit(" Q "), "answer": F.concat(F.lit("("), "letter", F.lit(") ")), "category": F.col("lang"),
                 **{c: F.get("opts", i) for i, c in enumerate("ABCDEFGHIJK")}},
        "'Q'", "opts[1:11]", "coalesce(hit, '(' || letter || ')')", "lang", "''", "len(opts) > 0"),
    "hr": (
        lambda: {"question": F.lit("Q"), "answer": F.col("letter"), "cycle_category": F.when(F.col("lang") == "en", "0").otherwise("1"),
                 **{c: F.get("opts", i) for i, c in enumerate("ABCD")}},
        "'Q'", "opts[1:4]", "coalesce(opts[1:4][doc_id % 8 + 1], letter)", "''", "''", "lang = 'en'"),
}


def _register_layout(name: str) -> None:
    columns, question, choices, answer, sub_task, prompt, kept = _LAYOUTS[name]
    dialect = S.DIALECTS[name]
    idx = "row_number() OVER (ORDER BY doc_id) - 1" if dialect.idx_mode == "dense" else "doc_id"

    def run(spark, d):
        raw = _raw(spark, d)
        s = S.to_samples(raw.withColumns(columns()), name)
        return s.select(
            "idx", "src_pos", "dataset", "sub_task", "answer", F.size("choices").cast("long").alias("n_choices"),
            F.md5(F.array_join("choices", "|")).alias("choices_digest"), F.md5("question").alias("question_digest"),
            F.md5("prompt").alias("prompt_digest"),
        )

    query(f"samples_{name}", B.sql("raw", body=f"""
SELECT {idx} AS idx, doc_id AS src_pos, '{dialect.dataset}' AS dataset, {sub_task} AS sub_task, {answer} AS answer, len({choices}) AS n_choices,
  md5(array_to_string({choices}, '|')) AS choices_digest, md5({question}) AS question_digest, md5({prompt}) AS prompt_digest
FROM raw WHERE {kept}"""))(run)


for _name in _LAYOUTS:
    _register_layout(_name)


# ---- layouts on unedited text -----------------------------------------------

_S = B.strip_sql


def _lines_sql(pattern: str, group: int, flags: str = "") -> str:
    f = f", '{flags}'" if flags else ""
    return (
        f"list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_S('x')}), lambda x: regexp_matches(x, '{pattern}'{f})),"
        f" lambda x: {_S(f'''regexp_extract(x, '{pattern}', {group}{f})''')})"
    )


def _wrapped(mark: str, m: int, pre: str, post: str, delim: str) -> tuple:
    """Document lines as labelled options after a mark, in Spark and SQL."""
    def col():
        labelled = F.transform(
            F.split("text", "\n"), lambda x, i: F.concat(F.lit(pre), F.char(i % m + 65), F.lit(post), x)
        )
        return F.concat(F.lit(mark), F.array_join(labelled, delim))

    sep = delim.replace("\n", "' || chr(10) || '")
    head = mark.replace("\n", "' || chr(10) || '")
    text = (
        f"'{head}' || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '{pre}' || chr((65 + (i - 1) % {m})::INT) || '{post}' || x), '{sep}')"
    )
    return col, text


_AFTER_CHOICES = "substr(t, strpos(t, 'Choices:') + 8)"
_LABEL_TEXT = r"regexp_extract(x, '^([A-Z])[:\s\)]\s*(.*)$', 2, 'i')"
_PARSED = {
    "choices_block": (
        _wrapped("Pick.\nChoices:\n", 26, "", ") ", "\n"),
        f"list_transform(list_filter(list_transform(string_split({_S(_AFTER_CHOICES)}, chr(10)), lambda x: {_S('x')}), lambda x: x <> ''),"
        f" lambda x: CASE WHEN regexp_matches(x, '^([A-Z])[:\\s\\)]\\s*(.*)$', 'i') THEN {_S(_LABEL_TEXT)} ELSE x END)"),
    "colon_option_lines": (_wrapped("Pick.\n", 5, " ", ") ", "\n"), _lines_sql(r"^([A-D])\s*[:\)]\s*(.+?)\s*$", 2, "i")),
    "lettered_lines": (_wrapped("Pick.\n", 7, "", ".", "\n"), _lines_sql(r"^[A-F][.)]\s*(.*)$", 1, "i")),
    "prompt_option_lines": (_wrapped("Pick.\n", 26, "", ": ", "\n"), _lines_sql(r"^([A-Z])[:\.]\s*(.+)$", 2)),
    "paren_option_lines": (_wrapped("Pick.\n", 26, "(", ") ", "\n"), _lines_sql(r"^\(([A-Z])\)\s*(.*)$", 2)),
    "semicolon_options": (
        _wrapped("", 26, "", ". ", ";"),
        f"list_transform(list_filter(list_transform(string_split(t, ';'), lambda x: {_S('x')}), lambda x: x <> ''),"
        f" lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z]\\.\\s*(.*)$') THEN {_S('''regexp_extract(x, '^[A-Za-z]\\.\\s*(.*)$', 1)''')} ELSE x END)"),
    "split_options": (
        _wrapped("Pick. Options: ", 26, "", ": ", ", "),
        f"list_filter(list_transform(string_split_regex({_S('''substr(t, strpos(t, 'Options:') + 8)''')}, '\\s*[A-Z]:\\s*')[2:],"
        f" lambda x: {_S(f'''rtrim({_S('x')}, '.,;')''')}), lambda x: x <> '')"),
    "comma_options": (
        _wrapped("Pick. Options: ", 26, "", ": ", ", "),
        f"list_transform(string_split_regex(regexp_replace({_S('''substr(t, strpos(t, 'Options:') + 8)''')}, '^.*?[A-Z]:\\s*', '', 's'), '\\s*,\\s*[A-Z]:\\s*'), lambda x: {_S('x')})"),
    "labelled_list": (
        _wrapped("", 6, "(", "): ", "\n"),
        f"list_transform(string_split_regex({_S('t')}, '\\s*\\(?[A-Fa-f]\\)?\\s*[.:]\\s*')[2:], lambda x: {_S('x')})"),
}


def _register_parser(name: str) -> None:
    (column, text), expected = _PARSED[name]

    def run(spark, d):
        t = B.table(spark, d, "documents").select("doc_id", C.parse_choices(column(), name).alias("c"))
        return t.select("doc_id", F.size("c").cast("long").alias("n_choices"), F.md5(F.array_join("c", "|")).alias("digest"))

    query(f"parse_{name}", f"""
SELECT doc_id, len(c) AS n_choices, md5(array_to_string(c, '|')) AS digest FROM (
  SELECT doc_id, {expected} AS c FROM (SELECT doc_id, {text} AS t FROM documents))""")(run)


for _name in _PARSED:
    _register_parser(_name)


@query("paren_question", f"""
SELECT doc_id, CASE WHEN len(q) > 0 THEN {_S("array_to_string(q, ' ')")} ELSE string_split(text, chr(10))[1] END AS question FROM (
  SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_S('x')}), lambda x: x <> '') AS q FROM documents)""")
def paren_question(spark, d):
    asked = C.paren_question(F.concat("text", F.lit("\n(A) yes\n(B) no\nPlease answer with A or B\nmore")))
    return B.table(spark, d, "documents").select("doc_id", asked.alias("question"))


@query("clean_choice", """
SELECT doc_id, kind, ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cleaned
FROM documents, (VALUES ('(B) '), ('b. '), ('C) '), ('D: ')) k(kind)""")
def clean_choice(spark, d):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("(B) ", "b. ", "C) ", "D: ")]))
    t = B.table(spark, d, "documents").select("doc_id", "text", kinds.alias("kind"))
    return t.select("doc_id", "kind", C.clean_choice(F.concat("kind", "text")).alias("cleaned"))


@query("first_non_empty", """
SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), source) AS sub_task FROM documents""")
def first_non_empty(spark, d):
    t = B.table(spark, d, "documents").withColumn("a", F.when(F.col("lang") != "en", F.col("lang")).otherwise(""))
    return t.select("doc_id", X.first_non_empty("a", "source").alias("sub_task"))


# ---- scans, sinks and media -------------------------------------------------


@query("read_source", """
SELECT p_partkey AS id, p_name AS name, 'part.parquet' AS config FROM part
UNION ALL SELECT s_suppkey, s_name, 'supplier.parquet' FROM supplier""")
def read_source(spark, d):
    df = tables.read_source(spark, d, "parquet", ["part.parquet", "supplier.parquet", "absent.parquet"])
    return df.select(F.coalesce("p_partkey", "s_suppkey").alias("id"), F.coalesce("p_name", "s_name").alias("name"), "config")


_PROFILED = {"nation": "n_nationkey,n_name,n_regionkey", "labels": "doc_id,quality,toxic", "conversations": "conv_id,turn,role,text"}


def _first_row_sql(table: str, columns: str) -> str:
    shown = " || ' | ' || ".join(
        f"'{c}: ' || coalesce(CASE WHEN length({c}::VARCHAR) > 150 THEN left({c}::VARCHAR, 150) || '...' ELSE {c}::VARCHAR END, 'None')"
        for c in columns.split(",")
    )
    return f"(SELECT {shown} FROM {table} LIMIT 1)"


@query("profile_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, '{c}' AS column_names, {_first_row_sql(t, c)} AS sample" for t, c in _PROFILED.items()))
def profile_tables(spark, d):
    return tables.profile_tables({t: B.table(spark, d, t) for t in _PROFILED})


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS shown FROM documents")
def truncate_text(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.truncate_text("text").alias("shown"))


@query("image_rel_paths", """
SELECT doc_id, array_to_string(list_transform(range(length(text) % 4), lambda i: printf('%05d/%05d.png', doc_id, i)), ' ') AS paths FROM documents""")
def image_rel_paths(spark, d):
    t = B.table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("idx"), (F.length("text") % 4).alias("n_images"))
    return S.image_rel_paths(t).select("doc_id", F.array_join("images", " ").alias("paths"))


@query("decode_image_bytes", "SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(text) AS digest FROM documents")
def decode_image_bytes(spark, d):
    """Every document's bytes in one of three columns: raw, base64 text, or a struct."""
    raw = F.encode("text", "utf-8")
    t = B.table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", raw).alias("bytes"),
        F.when(F.col("lang") == "fr", F.base64(raw)).alias("encoded"),
        F.when(~F.col("lang").isin("en", "fr"), F.struct(raw.alias("bytes"))).alias("image"),
    )
    out = media.decode_image_bytes(t, ["bytes", "encoded", "image"])
    return out.select("doc_id", F.octet_length("image_bytes").cast("long").alias("n_bytes"), F.md5("image_bytes").alias("digest"))


def _folder(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("state_bank_round_trip", B.sql("emb", body="""
SELECT vec_id AS bank_row, task_id, label::BIGINT AS q_value, CASE WHEN label <> 0 THEN view ELSE '' END AS view, CASE WHEN label <> 0 THEN """ + B.vector_digest_sql("v") + """ ELSE '' END AS digest FROM emb"""))
def state_bank_round_trip(spark, d):
    path = _folder(spark, "state-bank")
    SB.write_state_bank(*B.bank(spark, d), path)
    meta, vectors = SB.read_state_bank(spark, path)
    return meta.join(vectors, "bank_row", "left").select(
        "bank_row", "task_id", F.col("q_value").cast("long").alias("q_value"), F.coalesce("view", F.lit("")).alias("view"),
        F.coalesce(B.vector_digest("embedding"), F.lit("")).alias("digest"),
    )


@query("trace_bank_round_trip", B.sql("emb", body="""
SELECT vec_id AS bank_row, CASE WHEN label >= 5 THEN task_id ELSE '' END AS task_id, CASE WHEN label BETWEEN 1 AND 4 THEN 'incorrect' ELSE 'correct' END AS source FROM emb"""))
def trace_bank_round_trip(spark, d):
    path = _folder(spark, "trace-bank")
    meta, _ = B.bank(spark, d)
    old = meta.select(
        "bank_row", F.when(F.col("q_value") >= 5, F.col("task_id")).alias("task_id"),
        F.when(F.col("q_value") > 0, F.col("source")).alias("source"), "experience",
    )
    SB.write_trace_bank(old, path)
    return SB.read_trace_bank(spark, path).select("bank_row", "task_id", "source")


@query("write_jsonl", B.sql("run_a", "run_b", body="""
SELECT CASE WHEN a.is_correct AND b.is_correct THEN 'both_correct' WHEN NOT a.is_correct AND NOT b.is_correct THEN 'both_wrong'
  WHEN b.is_correct THEN 'only_a_wrong' ELSE 'only_b_wrong' END AS category, a.idx, a.predicted FROM run_a a JOIN run_b b ON a.idx = b.idx"""))
def write_jsonl(spark, d):
    from trailmark.operators.compare import categorise

    path = _folder(spark, "categories")
    tables.write_jsonl(categorise(*B.runs(spark, d)), path, by="category")
    return spark.read.schema("idx long, predicted string, category string").json(path)


@query("read_results", B.sql("results", body="""
SELECT idx, answer AS ground_truth, is_correct, type, coalesce(sub_task, '') AS sub_task, len(choices) AS n_choices FROM results"""))
def read_results(spark, d):
    from trailmark.operators.scoring import to_results

    path = _folder(spark, "results")
    tables.write_jsonl(to_results(B.answered(spark, d)), path)
    r = tables.read_results(spark, path)
    return r.select("idx", "ground_truth", "is_correct", "type", "sub_task", F.size("choices").cast("long").alias("n_choices"))


@query("read_samples", B.sql("samples", body="""
SELECT idx, dataset, type, answer, md5(question) AS question_digest, array_to_string(choices, ' ') AS choices FROM samples"""))
def read_samples(spark, d):
    path = _folder(spark, "samples")
    tables.write_jsonl(B.samples(spark, d).drop("src_pos"), path)
    s = tables.read_samples(spark, path)
    return s.select("idx", "dataset", "type", "answer", F.md5("question").alias("question_digest"), F.array_join("choices", " ").alias("choices"))


@query("read_stats", B.sql("results", body="""
SELECT 'bench (tool)' AS label, (SELECT count(*) FROM results) AS total, sub_task, count(*) AS group_total, count(*) FILTER (is_correct) AS group_correct
FROM (SELECT coalesce(sub_task, 'unknown') AS sub_task, is_correct FROM results) GROUP BY sub_task"""))
def read_stats(spark, d):
    from trailmark.operators import scoring

    path = _folder(spark, "stats")
    a = B.answered(spark, d)
    r = scoring.to_results(a)
    tables.write_stats(
        scoring.eval_stats(r), scoring.stats_by(a, r, "type"), scoring.stats_by(a, r, "sub_task"), path,
        {"model_name": "bench", "qa_type": "tool"},
    )
    s = tables.read_stats(spark, path).select("label", "total", F.explode("by_subtask").alias("sub_task", "g"))
    return s.select("label", "total", "sub_task", F.col("g.total").alias("group_total"), F.col("g.correct").alias("group_correct"))


# Media of an order: one file per line, in any of four formats.
B.cte("files", """
SELECT DISTINCT l_orderkey, l_linenumber, '/m/' || printf('%06d', l_orderkey) || '/img_' || l_linenumber || ['.png', '.jpg', '.webp', '.gif'][l_partkey % 4 + 1] AS path FROM lineitem""")


def _files(spark, d):
    ext = F.get(F.array(*[F.lit(e) for e in (".png", ".jpg", ".webp", ".gif")]), (F.col("l_partkey") % 4).cast("int"))
    return B.table(spark, d, "lineitem").select(
        F.concat(F.lit("/m/"), F.format_string("%06d", "l_orderkey"), F.lit("/img_"), F.col("l_linenumber").cast("string"), ext).alias("path"),
        F.length(ext).cast("long").alias("length"),
    ).distinct()


@query("resolve_media", B.sql("files", body="""
SELECT r.o_orderkey, n.ref_id, min(f.path) AS path FROM orders r, (VALUES ('img_1'), ('img_9')) n(ref_id)
LEFT JOIN (SELECT l_orderkey, 'img_' || l_linenumber AS ref_id, path FROM files) f ON r.o_orderkey = f.l_orderkey AND n.ref_id = f.ref_id GROUP BY 1, 2"""))
def resolve_media(spark, d):
    refs = B.table(spark, d, "orders").select(
        "o_orderkey", F.format_string("%06d", "o_orderkey").alias("task_id"), F.explode(F.array(F.lit("img_1"), F.lit("img_9"))).alias("ref_id")
    )
    return media.resolve_media(refs, _files(spark, d)).select("o_orderkey", "ref_id", "path")


@query("find_images", B.sql("files", body="""
SELECT o_orderkey, coalesce(min(CASE WHEN ext = '.png' THEN path END), min(CASE WHEN ext = '.webp' THEN path END), min(CASE WHEN ext = '.jpg' THEN path END)) AS found
FROM orders LEFT JOIN (SELECT l_orderkey, path, regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext FROM files WHERE l_linenumber = 2) f ON o_orderkey = l_orderkey GROUP BY 1""".replace("\\\\", "\\")))
def find_images(spark, d):
    asked = B.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("/m/"), F.format_string("%06d", "o_orderkey"), F.lit("/img_2.png")).alias("path")
    )
    return media.find_images(asked, "path", _files(spark, d)).select("o_orderkey", "found")


B.cte("refs", """
SELECT l_orderkey AS task_id, 'img_' || l_linenumber AS ref_id, min('/m/' || l_orderkey || '_' || l_partkey || '.png') AS path FROM lineitem GROUP BY 1, 2""")


def _refs(spark, d):
    path = F.concat(F.lit("/m/"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".png"))
    return B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.concat(F.lit("img_"), F.col("l_linenumber").cast("string")).alias("ref_id"), path.alias("path")
    )


@query("ids_to_paths", B.sql("refs", body="""
SELECT l_orderkey AS task_id, l_partkey AS name, coalesce(r.path, 'img_' || (l_suppkey % 9)) AS value FROM lineitem
LEFT JOIN refs r ON l_orderkey = r.task_id AND 'img_' || (l_suppkey % 9) = r.ref_id"""))
def ids_to_paths(spark, d):
    props = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("name"),
        F.concat(F.lit("img_"), (F.col("l_suppkey") % 9).cast("string")).alias("value"),
    )
    return media.ids_to_paths(props, _refs(spark, d)).select("task_id", "name", "value")


@query("paths_to_ids", """
SELECT l_orderkey AS task_id, l_linenumber::BIGINT AS name, min(ref_id) OVER (PARTITION BY l_orderkey, l_partkey) AS value
FROM (SELECT *, 'img_' || l_linenumber AS ref_id FROM lineitem)""")
def paths_to_ids(spark, d):
    refs = _refs(spark, d)
    props = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("long").alias("name"),
        F.concat(F.lit("/m/"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("value"),
    )
    return media.paths_to_ids(props, refs).select("task_id", "name", "value")


@query("replace_values", """
SELECT event_id, CASE WHEN json_extract_string(props, '$.k') = '7' THEN 'seven' ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def replace_values(spark, d):
    m = F.from_json("props", "map<string,string>")
    table = F.create_map(F.lit("7"), F.lit("seven"))
    return B.table(spark, d, "events").select("event_id", X.replace_values(m, table)["k"].alias("k"))


# ---- observations and tools -------------------------------------------------


def _data():
    """Observation map of an event: none, an error, or a value and a label; some values are missing."""
    none = F.create_map().cast("map<string,string>")
    return (
        F.when(F.col("event_type") == "view", none)
        .when(F.col("event_type") == "error", F.create_map(F.lit("error"), F.when(F.col("event_id") % 5 != 0, F.col("props"))))
        .otherwise(F.create_map(F.lit("estimated depth"), F.col("value").cast("string"), F.lit("label"), F.when(F.col("event_id") % 3 != 0, F.col("event_type"))))
    )


_FORMATTED = """CASE event_type WHEN 'view' THEN 'success' WHEN 'error' THEN 'Error: ' || CASE WHEN event_id % 5 <> 0 THEN props ELSE 'None' END
  ELSE 'Estimated depth: ' || value::VARCHAR || ', Label: ' || CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'None' END END"""


@query("format_observation", f"SELECT event_id, {_FORMATTED} AS text FROM events")
def format_observation(spark, d):
    return B.table(spark, d, "events").select("event_id", X.format_observation(_data()).alias("text"))


@query("output_observation", f"""
SELECT event_id, 'Saved to memory as img_' || user_id || ': ' || event_type || ' output' || CASE WHEN event_type = 'view' THEN '' ELSE '. ' || {_FORMATTED} END AS stored,
  'Generated img_' || user_id || ': ' || event_type || ' output' || CASE WHEN event_type = 'view' THEN '' ELSE '. ' || {_FORMATTED} END AS shown FROM events""")
def output_observation(spark, d):
    oid, text = F.concat(F.lit("img_"), F.col("user_id").cast("string")), F.concat("event_type", F.lit(" output"))
    e = B.table(spark, d, "events").withColumn("data", _data())
    return e.select(
        "event_id", X.output_observation(oid, text, "data").alias("stored"),
        X.output_observation(oid, text, "data", memory=False).alias("shown"),
    )


@query("media_observation", """
SELECT event_id, 'img_' || user_id AS id, CASE WHEN event_type = 'click' THEN 'own' ELSE 'made by tool' END AS description,
  (CASE WHEN event_type = 'click' THEN 3 ELSE 4 END)::BIGINT AS n_keys FROM events""")
def media_observation(spark, d):
    own = F.when(F.col("event_type") == "click", F.create_map(F.lit("description"), F.lit("own"))).otherwise(
        F.create_map(F.lit("score"), F.lit("1"))
    )
    m = X.media_observation(F.concat(F.lit("img_"), F.col("user_id").cast("string")), F.lit("img"), F.lit("made by tool"), own)
    e = B.table(spark, d, "events").select("event_id", m.alias("m"))
    return e.select("event_id", F.col("m")["id"].alias("id"), F.col("m")["description"].alias("description"), F.size("m").alias("n_keys"))


_TOOL_OF = {"click": "crop", "purchase": "zoom_in", "view": "visualize_regions", "signup": "ocr", "error": "get_images"}
_TOOL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TOOL_OF.items()) + " END"


@query("describe_output", f"""
SELECT event_id, CASE event_type WHEN 'click' THEN 'Cropped img_' || user_id || ' at bbox_2d [0.1,0.2,0.5,0.6]'
  WHEN 'purchase' THEN 'Zoomed in img_' || user_id || ' at bbox_2d [0.1,0.2,0.5,0.6] by 3x'
  WHEN 'view' THEN 'Visualized 2 regions on img_' || user_id ELSE {_TOOL_SQL} || ' output' END AS description FROM events""")
def describe_output(spark, d):
    tool = F.create_map(*[F.lit(x) for kv in _TOOL_OF.items() for x in kv])[F.col("event_type")]
    props = F.create_map(
        F.lit("image"), F.concat(F.lit("img_"), F.col("user_id").cast("string")), F.lit("bbox_2d"), F.lit("[0.1,0.2,0.5,0.6]"),
        F.lit("zoom_factor"), F.lit("3"), F.lit("regions"), F.lit('[{"label":"a"},{"label":"b"}]'),
    )
    return B.table(spark, d, "events").select("event_id", X.describe_output(tool, props).alias("description"))


@query("view_message", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'Invalid image ID format: file.png. Expected format: ''img_0'', ''img_1'', etc.'
  WHEN user_id % 3 = 0 THEN 'You can now view img_0.' WHEN user_id % 3 = 1 THEN 'You can now view 2 images in order: img_0 and img_1.'
  ELSE 'You can now view 3 images in order: img_0, img_1 and img_2.' END AS message FROM events""")
def view_message(spark, d):
    ids = F.transform(F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int")), lambda i: F.concat(F.lit("img_"), i.cast("string")))
    asked = F.when(F.col("event_type") == "error", F.concat(ids, F.array(F.lit("file.png")))).otherwise(ids)
    return B.table(spark, d, "events").select("event_id", X.view_message(asked).alias("message"))


@query("split_tags", "SELECT p_partkey, len(string_split(p_name || ' | ' || p_type, ' | ')) AS n_tags, p_type AS last_tag FROM part")
def split_tags(spark, d):
    t = B.table(spark, d, "part").select("p_partkey", X.split_tags(F.concat("p_name", F.lit(" | "), "p_type")).alias("t"))
    return t.select("p_partkey", F.size("t").alias("n_tags"), F.element_at("t", -1).alias("last_tag"))


@query("non_empty_metadata", """
SELECT doc_id, (CASE WHEN lang = 'en' THEN 1 ELSE 2 END)::BIGINT AS n_keys, CASE WHEN lang <> 'en' THEN lang END AS sub_task FROM documents""")
def non_empty_metadata(spark, d):
    m = F.create_map(
        F.lit("dataset"), F.col("source"), F.lit("sub_task"), F.when(F.col("lang") != "en", F.col("lang")).otherwise(""),
        F.lit("type"), F.lit(None).cast("string"),
    )
    t = B.table(spark, d, "documents").select("doc_id", X.non_empty_metadata(m).alias("m"))
    return t.select("doc_id", F.size("m").alias("n_keys"), F.try_element_at("m", F.lit("sub_task")).alias("sub_task"))


@query("task_id_text", "SELECT o_orderkey, printf('%06d', o_orderkey) AS task_id FROM orders")
def task_id_text(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", X.task_id_text("o_orderkey").alias("task_id"))


def _calls(spark, d):
    """A tool call per event; parameters are sound, fenced, incomplete or of a wrong type."""
    known = {k: v for k, v in _TOOL_OF.items() if v in tools.REGISTRY}
    tool = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("event_type")], F.lit("abacus"))
    image = F.concat(F.lit("img_"), F.col("user_id").cast("string"))
    good = F.concat(F.lit('{"image": "'), image, F.lit('", "images": ["'), image, F.lit('"], "bbox_2d": [0.1, 0.2, 0.5, 0.6], "zoom_factor": 2}'))
    style = F.col("user_id") % 4
    params = (
        F.when(style == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(style == 2, F.lit('{"zoom_factor": 2}'))
        .when(style == 3, F.replace(F.replace(good, F.lit("[0.1, 0.2, 0.5, 0.6]"), F.lit('"all"')), F.lit('["'), F.lit('[["')))
        .otherwise(good)
    )
    return B.table(spark, d, "events").select("event_id", tool.alias("tool"), params.alias("params"))


@query("validate_params", """
SELECT event_id, CASE WHEN event_type IN ('click', 'purchase', 'error') THEN CASE user_id % 4
    WHEN 2 THEN CASE WHEN event_type = 'error' THEN '''images''' ELSE '''image''' END || ' is a required property'
    WHEN 3 THEN 'parameters are not a JSON object' END END AS error FROM events""")
def validate_params(spark, d):
    return tools.validate_params(_calls(spark, d)).select("event_id", "error")


@query("call_tools", """
SELECT event_id, CASE WHEN event_type IN ('view', 'signup') THEN 'Tool abacus does not exist!'
  WHEN user_id % 4 = 2 THEN 'An error occurred when calling tool `' || tool || '`:' || chr(10) || CASE WHEN event_type = 'error' THEN '''images''' ELSE '''image''' END || ' is a required property'
  WHEN user_id % 4 = 3 THEN 'An error occurred when calling tool `' || tool || '`:' || chr(10) || 'parameters are not a JSON object'
  WHEN event_type = 'click' THEN 'Cropped img_' || user_id || ' at bbox_2d [0.1,0.2,0.5,0.6]'
  WHEN event_type = 'purchase' THEN 'Zoomed in img_' || user_id || ' at bbox_2d [0.1,0.2,0.5,0.6] by 2x'
  ELSE 'You can now view img_' || user_id || '.' END AS result
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'crop' WHEN 'purchase' THEN 'zoom_in' ELSE 'get_images' END AS tool FROM events)""")
def call_tools(spark, d):
    return tools.call_tools(_calls(spark, d)).select("event_id", "result")


# ---- JSON in text -----------------------------------------------------------


def _replies(spark, d):
    """Model replies around event properties: fenced, bare, nested, or no JSON."""
    return B.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {x}")))
        .when(F.col("event_type") == "view", F.concat(F.lit("I say "), "props", F.lit(" and more")))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"a": '), "props", F.lit(', "b": 2}')))
        .when(F.col("event_type") == "error", F.concat(F.lit("list [1, 2, "), F.col("user_id").cast("string"), F.lit("] end")))
        .otherwise(F.concat(F.lit("plain text "), F.col("event_id").cast("string"))).alias("reply"),
    )


@query("extract_json", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'object' WHEN 'view' THEN 'object' WHEN 'error' THEN 'array' ELSE 'text' END AS kind,
  CASE event_type WHEN 'click' THEN props WHEN 'view' THEN props WHEN 'signup' THEN '{"a": ' || props || ', "b": 2}' WHEN 'error' THEN '[1, 2, ' || user_id || ']'
    ELSE 'plain text ' || event_id END AS raw FROM events""")
def extract_json(spark, d):
    """Without a fence the text is cut at the first closing brace, so a nested object stays text."""
    return _replies(spark, d).select("event_id", J.extract_json("reply").alias("j")).select("event_id", "j.kind", "j.raw")


@query("extract_json_object", """
SELECT event_id, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN props WHEN 'signup' THEN '{"a": ' || props || ', "b": 2}' ELSE '{}' END AS object_text FROM events""")
def extract_json_object(spark, d):
    return _replies(spark, d).select("event_id", J.extract_json_object("reply").alias("object_text"))


@query("safe_udf", """
SELECT doc_id, CASE WHEN lang = 'en' THEN length(text) END::DOUBLE AS value, CASE WHEN lang <> 'en' THEN 'ValueError: not a number' END AS error FROM documents""")
def safe_udf(spark, d):
    def number(v: str) -> float:
        if not v.isdigit():
            raise ValueError("not a number")
        return float(v)

    text = F.when(F.col("lang") == "en", F.length("text").cast("string")).otherwise(F.col("lang"))
    out = B.table(spark, d, "documents").select("doc_id", models.safe_udf(number, "double")(text).alias("r"))
    return out.select("doc_id", "r.value", "r.error")
