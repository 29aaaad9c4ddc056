"""Segmentation and extraction on sentences written for the tests, and the corpus against a sequential fold."""

import random

from pyspark.sql import functions as F

from verdance.functions import logic, text
from verdance.operators import segmentation

BLOB = "Inclusion Criteria:\n\n* Age 18 to 65 years\n1\\. HbA1c \\> 7.5 %\nExclusion criteria: history of stroke within 6 months\n- No prior   chemotherapy\n\nInclusion Criteria\n(2) willing to sign"


def test_sentences(spark):
    df = spark.createDataFrame([(BLOB,), (None,), ("",)], "text string").select(text.sentences(F.col("text")).alias("s"))
    got = [[(x["pos"], x["section"], x["sentence"]) for x in r["s"]] for r in df.collect()]
    assert got == [[(2, "inclusion", "Age 18 to 65 years"), (3, "inclusion", "HbA1c > 7.5 %"), (4, "exclusion", "history of stroke within 6 months"), (5, "exclusion", "No prior chemotherapy"), (8, "inclusion", "willing to sign")], [], []]


CASES = [
    ("Age 18 to 65 years", "age between 18.0 and 65.0 years", "age_range"),
    ("Adults 18 years of age or older", "age >= 18.0 years", "age_min"),
    ("age <= 80", "age <= 80.0 years", "age_max"),
    ("aged 65 to 18 years", None, None),
    ("HbA1c > 7.5 %", "hba1c > 7.5 %", "measurement_threshold"),
    ("systolic blood pressure ≥ 140 mmHg at visit", "systolic blood pressure >= 140.0 mmHg", "measurement_threshold"),
    ("BMI between 18.5 and 30 kg/m2", "bmi between 18.5 and 30.0 kg/m2", "measurement_range"),
    ("creatinine <= 3 times ULN", None, None),
    ("platelet count < 150 and rising", "platelet count < 150.0", "measurement_threshold"),
    ("history of the stroke within 6 months", "stroke (within the past 6.0 months)", "condition:history_of"),
    ("treatment with an oral anticoagulant", "oral anticoagulant", "drug:treatment_with"),
    ("use of invasive hemodynamic monitoring", "invasive hemodynamic monitoring", "procedure:use_of"),
    ("history of oral or intravenous antibiotics", None, None),
    ("known cardiac, pulmonary, renal, or metabolic disease", None, None),
    ("history of fracture within 0 days", None, None),
    ("diagnosis of active asthma (moderate) such as", "asthma (current / ongoing)", "condition:diagnosis_of"),
    ("documented lesions <5 mm", None, None),
    ("nothing to be found here", None, None),
]


def test_atoms(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, s string").select("i", text.sentence_atom(F.col("s")).alias("h"))
    got = {r["i"]: (r["r"], r["p"]) for r in df.select("i", logic.render(F.col("h.tree")).alias("r"), F.col("h.pattern").alias("p")).collect()}
    assert [(CASES[i][0], *got[i]) for i in sorted(got)] == CASES


def test_expressions(spark):
    cases = [
        ("No history of stroke", None, None, None),
        ("No known diagnosis of asthma", "NOT (asthma)", "condition:diagnosis_of", True),
        ("history of stroke or diagnosis of asthma", "(stroke (at any time in history) OR asthma)", "coordinated_or", False),
        ("BMI >= 18 and <= 40", None, None, None),
        ("history of stroke and diagnosis of asthma or use of aspirin", None, None, None),
        ("history of stroke or history of stroke", None, None, None),
        ("Without diagnosis of asthma", "NOT (asthma)", "condition:diagnosis_of", True),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string").select("i", text.sentence_expression(F.col("s")).alias("h"))
    got = {r["i"]: (r["r"], r["p"], r["n"]) for r in df.select("i", logic.render(F.col("h.tree")).alias("r"), F.col("h.rule").alias("p"), F.col("h.negated").alias("n")).collect()}
    assert [(cases[i][0], *got[i]) for i in sorted(got)] == cases


def test_corpus_is_the_sequential_fold(spark):
    r = random.Random(2)
    words = ["asthma", "stroke", "gout", "anemia", "sepsis", "psoriasis", "lupus", "scurvy"]
    studies = [(f"NCT{i:08d}", "\n".join(f"diagnosis of {r.choice(words[: 2 + i % 7])}" for _ in range(r.randint(0, 9)))) for i in range(60)] + [("NCT99999999", None)]
    rows = segmentation.mapped(spark.createDataFrame(studies, "study_id string, text string"))
    for cap in (1, 3, None):
        seen, want = set(), []
        for study, body in sorted(studies):
            kept = 0
            for pos, line in enumerate((body or "").split("\n")):
                if line and line not in seen:
                    seen.add(line)
                    want.append((study, pos, kept))
                    kept += 1
                    if cap and kept >= cap:
                        break
        got = segmentation.corpus(rows, cap).select("study_id", "pos", "kept_no").collect()
        assert sorted(map(tuple, got)) == want


def test_counts(spark):
    studies = spark.createDataFrame([("NCT00000001", "diagnosis of asthma\nshort\nsigned informed consent\ndiagnosis of asthma\nnothing that maps\nNo known diagnosis of gout")], "study_id string, text string")
    rows = segmentation.mapped(studies)
    counts = {(x["kind"], x["name"]): x["n"] for x in segmentation.corpus_counts(rows, segmentation.corpus(rows)).collect()}
    assert counts == {("total", "considered"): 6, ("total", "mapped"): 2, ("total", "negated"): 1, ("skipped", "length_out_of_range"): 1, ("skipped", "boilerplate_phrase"): 1, ("skipped", "no_faithful_mapping"): 1, ("skipped", "duplicate_of_earlier_trial"): 1}
    capped = {(x["kind"], x["name"]): x["n"] for x in segmentation.corpus_counts(rows, segmentation.corpus(rows, 1), 1).collect()}
    assert capped == {("total", "considered"): 1, ("total", "mapped"): 1}
    made = segmentation.criteria(rows).orderBy("criterion_id").collect()
    assert [(m["criterion_id"], m["polarity"]) for m in made] == [("ctgov:NCT00000001:inc:00", "inclusion"), ("ctgov:NCT00000001:inc:01", "inclusion")]
