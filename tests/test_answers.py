"""Answer extraction, matching and scoring on hand-made cases."""

from pyspark.sql import functions as F

from trailmark.functions import text as X
from trailmark.operators import scoring

IMAGES = ["the first image", "the second image", "the third image", "the fourth image"]
NUMBERS = ["1", "2", "3", "4"]
LONG = ["a cat sitting on a mat", "a dog running in a park", "a bird flying over the sea"]
TWELVE = [f"option {i}" for i in range(12)]
TWENTY = [f"option {i}" for i in range(20)]

# predicted, choices, format, matched choice
CASES = [
    ("A", IMAGES, "letter", "the first image"),
    ("c", IMAGES, "letter", "the third image"),
    ("(d)", IMAGES, "letter", "the fourth image"),
    ("B)", IMAGES, "letter", "the second image"),
    ("A.", IMAGES, "letter", "the first image"),
    ("C, because it looks real", IMAGES, "letter", "the third image"),
    ("B: the second image", IMAGES, "letter", "the second image"),
    ("(C) the third image", IMAGES, "letter", "the third image"),
    ("(C", IMAGES, "letter", "the third image"),
    ("  C  ", IMAGES, "letter", "the third image"),
    ("I think the third image is correct", IMAGES, "letter", "the third image"),
    ("first image", IMAGES, "letter", "the first image"),
    ("Z", IMAGES, "letter", None),
    ("", IMAGES, "letter", None),
    (" \t\n", IMAGES, "letter", None),
    ("something completely unrelated", IMAGES, "letter", None),
    ("3", IMAGES, "numeric", "the third image"),
    ("(1)", IMAGES, "numeric", "the first image"),
    ("12", TWELVE, "numeric", "option 11"),
    ("1", TWELVE, "numeric", "option 0"),
    ("(10)", TWELVE, "numeric", "option 9"),
    ("03", IMAGES, "numeric", None),
    ("yes", ["yes", "no"], "letter", "yes"),
    ("B", ["yes", "no"], "letter", "no"),
    ("3", NUMBERS, "letter", "3"),
    ("C", NUMBERS, "letter", "3"),
    ("the third image", TWENTY, "letter", None),
    ("cat sitting on a mat", LONG, "letter", "a cat sitting on a mat"),
    ("a dog running", LONG, "letter", "a cat sitting on a mat"),  # the leading label wins
    ("image", IMAGES, "letter", "the first image"),  # first of several
    ("yes", ["  Yes ", "no"], "letter", "Yes"),
]


def test_match_choice(spark):
    rows = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CASES)], "i int, predicted string, choices array<string>, fmt string, want string"
    )
    out = rows.select(
        "i", "predicted", "want",
        F.when(F.col("fmt") == "numeric", X.match_choice("predicted", "choices", "numeric"))
        .otherwise(X.match_choice("predicted", "choices")).alias("got"),
    ).collect()
    assert [(r.predicted, r.got) for r in sorted(out)] == [(c[0], c[3]) for c in CASES]


def test_scoring(spark):
    rows = spark.createDataFrame(
        [
            ("C", "the third image", "multi-choice", IMAGES),
            ("B", "the third image", "multi-choice", IMAGES),
            ("THE THIRD image", " the third image ", "multi-choice", IMAGES),
            ("", "the third image", "multi-choice", IMAGES),
            ("the third image", "the third image", "multi-choice", None),
            (" Else ", "else", "multi-choice", []),
            ("x", "x", "open-ended", None),
            ("", "x", "open-ended", None),
            ("x", "x", None, None),
        ],
        "p string, t string, k string, c array<string>",
    )
    got = [
        (r.ok, r.err)
        for r in rows.select(X.is_answer_correct("p", "t", "k", "c").alias("ok"), X.scoring_error("p", "k").alias("err")).collect()
    ]
    bad = "Task type 'open-ended' is not implemented yet"
    assert got == [
        (True, None), (False, None), (True, None), (False, None), (True, None), (True, None),
        (False, bad), (False, None), (False, "Task type 'None' is not implemented yet"),
    ]


def test_extract_answer(spark):
    texts = [
        "think\nAnswer: B\nmore", "Answer: A\nAnswer:  (C) \n", "no token", "Answer:", "x Answer: mid", "Answer: \n\n D \nrest",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "r string")
    assert [r[0] for r in rows.select(X.extract_answer("r")).collect()] == ["B", "(C)", "", "", "mid", "D"]


def test_options_and_query(spark):
    one = spark.createDataFrame([("", " Q? ", ["x", "y"], "yes-no"), ("P", "Q", ["x"], "other")], "p string, q string, c array<string>, k string")
    got = [r[0] for r in one.select(X.build_query("p", "q", "c", "k")).collect()]
    assert got[0].startswith("Q?\n\n(A) x\n(B) y\n\nYou may explain your reasoning, but you MUST end with: \nAnswer: Yes")
    assert got[1] == "P"
    labels = spark.range(1).select(X.make_options(F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: F.lit("t"))).alias("o")).first().o
    assert labels[0] == "(A) t" and labels[25] == "(Z) t" and labels[26] == "({) t"


def test_results_and_stats(spark):
    samples = spark.createDataFrame(
        [
            (1, 0, "multi-choice", "s", "Q1", ["a1", "b1"], "a1", "", "Answer: A"),
            (2, 1, "multi-choice", "", "Q2", ["a2", "b2"], "b2", "", "Answer: A"),
            (3, 2, "open-ended", None, "Q3", [], "z", "", "Answer: z"),
        ],
        "idx long, src_pos long, type string, sub_task string, question string, choices array<string>, answer string, prompt string, response string",
    ).withColumn("dataset", F.lit("d"))
    results = scoring.to_results(samples)
    rows = {r.idx: r for r in results.collect()}
    assert rows[1].is_correct and not rows[2].is_correct
    assert rows[3].error and rows[3].predicted == "" and rows[3].query == "" and not rows[3].is_correct
    stats = scoring.eval_stats(results).first()
    assert (stats.total, stats.correct, stats.accuracy) == (3, 1, 0.3333)
    by = {r.sub_task: (r.total, r.correct) for r in scoring.stats_by(samples, results, "sub_task").collect()}
    assert by == {"s": (1, 1), "": (1, 0), "unknown": (1, 0)}
    assert scoring.eval_stats(results.limit(0)).first().accuracy == 0.0
