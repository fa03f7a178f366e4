from pyspark.sql import functions as F

from briefmill.operators import filings as f

NAMES = [
    ("SUPPLEMENTAL AFFIDAVIT IN SUPPORT OF PETITION FOR BILL OF REVIEW.pdf", "Affidavit", 0.85),
    ("D-1-FM-25-000222 - MOTION TO STRIKE.pdf", "Motion", 0.85),
    ("PETITIONER John Doe Amended BRIEF.pdf", "Brief", 0.85),
    ("/x/2nd Supp RR Vol 2.pdf", "Reporter's Record", 0.85),
    ("PetitionOfBillofReviewFinal.pdf", "Petition", 0.85),
    ("527222.pdf", "Other", 0.2),
    ("secretary.pdf", "Other", 0.2),
    (None, "Other", 0.2),
]


def test_names(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(NAMES)], "i int, name string")
    got = {r["i"]: (r["t"]["type"], r["t"]["confidence"]) for r in df.select("i", f.filing_type(F.col("name")).alias("t")).collect()}
    assert got == {i: (t, c) for i, (_, t, c) in enumerate(NAMES)}


def test_signs_agree(spark):
    df = spark.createDataFrame([("motion.pdf", "Motions", "MOTION TO STRIKE"), ("1.pdf", "Motions", None), ("1.pdf", None, "ORDER"), ("order.pdf", None, "an order")], "n string, d string, h string")
    got = [tuple(r["t"]) for r in df.select(f.filing_type(F.col("n"), F.col("d"), F.col("h")).alias("t")).collect()]
    assert got == [("Motion", 0.97), ("Motion", 0.75), ("Order", 0.6), ("Order", 0.93)]


def test_headers(spark):
    cases = [
        ("NO. D-1-FM-25-000222\nIN THE DISTRICT COURT OF TRAVIS COUNTY, TEXAS\nRESPONDENT'S RESPONSE IN OPPOSITION TO PETITION TO ENFORCE", ("Response", "high", "RESPONDENT'S RESPONSE")),
        ("ORDER GRANTING MOTION FOR SUMMARY JUDGMENT", ("Order", "high", "ORDER GRANTING")),
        ("filed in support of NOTICE OF appeal", None),
        ("x PETITION y", ("Petition", "medium", "PETITION")),
        ("REPORTER'S RECORD volume 2 of the motion to", ("Reporter's Record", "high", "REPORTER'S RECORD")),
        ("RFA", None),
        (None, None),
        ("", None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string")
    got = {r["i"]: r["t"] and tuple(r["t"]) for r in df.select("i", f.header_type(F.col("h")).alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}


def test_hybrid(spark):
    rows = [("Petition to Enforce.pdf", "RESPONSE TO PETITION"), ("Petition.pdf", "final JUDGMENT of"), ("Motion.pdf", "final JUDGMENT of"), ("Motion.pdf", None)]
    df = spark.createDataFrame(rows, "n string, h string")
    got = [tuple(r["t"]) for r in df.select(f.hybrid_type(F.col("n"), F.col("h")).alias("t")).collect()]
    assert got == [("Response", "header", 0.95), ("Judgment", "hybrid", 0.85), ("Motion", "filename", 0.85), ("Motion", "filename", 0.85)]


def test_titles(spark):
    rows = [
        ("D-1-FM-25-000222 - MOTION TO STRIKE THE ANSWER - signed.pdf", None, None, "Motion to Strike the Answer"),
        ("2024-01-05 Notice_of_Hearing V2.pdf", None, None, "Notice of Hearing"),
        ("MotionToStrike (1).pdf", None, None, "Motion To Strike"),
        ("527222.pdf", "Order on Costs", None, "Order on Costs"),
        ("527222.pdf", "12", "CAUSE NO. 5\nPLAINTIFF\nORDER DENYING COSTS\nmotion", "Order Denying Costs"),
        ("527222.pdf", None, None, "527222"),
        ("Motion.pdf", None, "- MOTION FOR LEAVE TO FILE A REPLY BRIEF -", "Motion for Leave to File a Reply Brief"),
        (None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, "n string, d string, h string, want string")
    got = [tuple(r) for r in df.select(f.filing_title(F.col("n"), F.col("h"), F.col("d")), "want").collect()]
    assert [a for a, _ in got] == [b for _, b in got]
