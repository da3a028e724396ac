import pytest
from pyspark.sql import functions as F

from siftline.operators.axes import Category, Vocabulary, score_axes
from siftline.operators.gating import evaluate_gates, with_evidence

VOCAB = Vocabulary(
    domain=(Category("supply_chain", ("supply chain", "logistics", "warehouse"), (),
                     ("data warehouse",)),
            Category("operations", ("operations excellence",), ("operations",)),
            Category("finance", ("financial planning",), ("finance",))),
    enabler=(Category("ai", ("ai", "artificial intelligence")), Category("bi", ("bi",)),
             Category("automation", ("automation",)), Category("data_bi", (), ("data",))),
    core_tech=("machine learning engineer", "software engineer"))

SCHEMA = ("id int, title string, description string, description_snippet string, "
          "description_truncated boolean, location string, date_posted string")


def gate_rows(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    df = with_evidence(df).drop("full_text", "caveat", "evidence_source")
    df = evaluate_gates(score_axes(df, VOCAB), "2026-09-12")
    return [r.gates for r in df.orderBy("id").collect()]


def bodies(spark, texts):
    return gate_rows(spark, [("Analyst", t, None, None, "", "") for t in texts])


EXPERIENCE = [
    ("Minimum 5-7 years of experience delivering solutions, ideally within finance", "FAIL", 7),
    ("At least 5 years of project management experience, preferably in pharma", "FAIL", 5),
    ("3-5 years of experience required.", "FAIL", 5),
    ("3–5 years of experience required.", "FAIL", 5),
    ("6 up to 8 years of experience required", "FAIL", 8),
    ("6/8 years of experience required", "FAIL", 8),
    ("6 to 8 years of experience required", "FAIL", 8),
    ("6—8 years of experience required", "FAIL", 8),
    ("6−8 years of experience required", "FAIL", 8),
    ("2-4 years of experience required.", "FAIL", 4),
    ("5 years in operations", "FAIL", 5),
    ("A proven history of 5 years", "FAIL", 5),
    ("1-3 years of experience required", "PASS", 3),
    ("2-3 years of experience required", "PASS", 3),
    ("Ideally 5 years of experience", "PASS", 5),
    ("8 years of experience preferred.", "PASS", 8),
    ("5+ years or equivalent experience.", "PASS", 5),
    ("+/- 5 years of experience in Finance industry.", "PASS", 5),
    ("6 years of experience in the telecom sector.", "PASS", 6),
    ("Founded 25 years ago, we lead the market.", "PASS", None),
    ("This is a 2 years fixed-term contract.", "PASS", None),
    ("Our company has 18 years in business", "PASS", 18),
    ("We want curious people.", "PASS", None),
    ("5 years of experience required; 7+ years of Python experience required", "FAIL", 7),
]


def test_experience(spark):
    got = bodies(spark, [t for t, *_ in EXPERIENCE])
    for (text, verdict, years), g in zip(EXPERIENCE, got):
        assert (g.experience.verdict, g.experience.years_required) == (verdict, years), text


def test_experience_quote_names_the_figure(spark):
    text = "Intro " * 400 + "you need 6 years of experience here " + "tail " * 300
    quote = bodies(spark, [text])[0].experience.quote
    assert "6 years" in quote and len(quote) <= 300


LANGUAGE = [
    ("Fluent Hungarian is required.", "FAIL", ["hungarian"]),
    ("German C1 is needed.", "FAIL", ["german"]),
    ("Spanish is mandatory", "FAIL", ["spanish"]),
    ("Very good German and English skills", "FAIL", ["german"]),
    ("English and German.", "FAIL", ["german"]),
    ("English, German.", "FAIL", ["german"]),
    ("Must be a native speaker.", "FAIL", ["native-speaker"]),
    ("German preferred", "PASS", []),
    ("English and preferably German", "PASS", []),
    ("Hungarian is an advantage", "PASS", []),
    ("French is a plus. Fluent German required.", "FAIL", ["german"]),
    ("We are an English-speaking company with German and French offices", "PASS", []),
    ("Native speaker would be a bonus", "PASS", []),
    ("Très bon niveau de français", "PASS", []),
    ("Français required and Dutch required", "FAIL", ["dutch", "french"]),
]


def test_language(spark):
    got = bodies(spark, [t for t, *_ in LANGUAGE])
    for (text, verdict, langs), g in zip(LANGUAGE, got):
        assert (g.language.verdict, g.language.languages_required) == (verdict, langs), text
    assert got[10].language.languages_optional == ["french"]
    assert "German" in got[10].language.quote


def test_posting_language(spark):
    italian = ("Il candidato lavora con la nostra azienda per una esperienza che sono delle "
               "attività della produzione con il team per la crescita. ") * 8
    swedish = "Blorvik snarfel dunkt grobel morfin talvek wompal. " * 20
    got = bodies(spark, [italian, swedish, "the and of to in for with you " * 20, ""])
    assert got[0].language.verdict == "FAIL" and "italian" in got[0].language.reason
    assert got[1].language.verdict == "UNKNOWN"
    assert got[2].language.verdict == "PASS"
    assert got[3].language.verdict == "UNKNOWN"


SPONSOR = [
    ("Please not there is no sponsorship available for this role", "FAIL", "sponsorship_denied"),
    ("You hold an EU passport", "FAIL", "authorisation_wall"),
    ("No EU passport required", "PASS", None),
    ("Only Irish applicants will be considered", "FAIL", "authorisation_wall"),
    ("only shortlisted applicants will be contacted", "PASS", None),
    ("We offer visa sponsorship. A valid work permit is required.", "PASS", None),
    ("A valid work permit is required.", "FAIL", "authorisation_wall"),
    ("This role is not eligible for immigration sponsorship", "FAIL", "sponsorship_denied"),
    ("We won't sponsor visas", "FAIL", "sponsorship_denied"),
    ("You must have the right to work in Spain", "FAIL", "authorisation_wall"),
]


def test_sponsorship(spark):
    got = bodies(spark, [t for t, *_ in SPONSOR])
    for (text, verdict, bar), g in zip(SPONSOR, got):
        assert (g.sponsorship.verdict, g.sponsorship.bar) == (verdict, bar), text
    assert got[5].sponsorship.sponsorship_offered and not got[0].sponsorship.sponsorship_offered


TITLES = [("Sr. Analyst", "sr"), ("Sr-Manager", "sr"), ("SRE Manager", None),
          ("Lead Time Analyst", None), ("Lead-to-Cash Analyst", None), ("Team (Lead)", "lead"),
          ("Leadership Development", None), ("Junior/Senior Analyst", "senior"),
          ("Lead Time Lead", "lead"), ("Head of Data", "head"), (None, None)]


def test_seniority(spark):
    got = gate_rows(spark, [(t, "x", None, None, "", "") for t, _ in TITLES])
    for (title, marker), g in zip(TITLES, got):
        assert g.seniority.marker == marker, title
        assert g.seniority.verdict == ("FAIL" if marker else "PASS")


def test_closed(spark):
    texts = ["No longer accepting applications.", "This role closes on 30 September.",
             "We work closely with you.", "Applications closed; apply before never",
             "The position has been filled"]
    got = bodies(spark, texts)
    assert [g.closed.verdict for g in got] == ["FAIL", "PASS", "PASS", "FAIL", "FAIL"]
    assert got[0].closed.marker == "no longer accepting applications"


PLACES = [("Austin, TX", "FAIL", "us/ca subdivision"), ("Paris, TX", "FAIL", "us/ca subdivision"),
          ("Remote (US only)", "FAIL", "us only"), ("Budapest, Hungary", "PASS", "hungary"),
          ("Remote", "UNKNOWN", None), ("", "UNKNOWN", None), ("Georgia", "UNKNOWN", None),
          ("Berlin or Ohio", "FAIL", "ohio"), ("Toronto, Canada", "FAIL", "canada"),
          ("Business park", "UNKNOWN", None), ("Düsseldorf", "PASS", "dusseldorf"),
          ("Tokyo and USA", "FAIL", "usa")]


def test_geography(spark):
    got = gate_rows(spark, [("Analyst", "x", None, None, p, "") for p, *_ in PLACES])
    for (place, verdict, marker), g in zip(PLACES, got):
        assert (g.geography.verdict, g.geography.marker) == (verdict, marker), place


@pytest.mark.parametrize("posted,verdict", [
    ("2026-09-10", "PASS"), ("2026-07-29", "PASS"), ("2026-07-28", "FAIL"), ("", "UNKNOWN"),
    ("2026-09-13T00:00:00Z", "UNKNOWN"), ("20269999", "UNKNOWN")])
def test_recency(spark, posted, verdict):
    assert gate_rows(spark, [("A", "x", None, None, "", posted)])[0].recency.verdict == verdict


def test_incomplete_text_never_acquits_and_still_convicts(spark):
    got = gate_rows(spark, [
        ("Analyst", None, "We want curious people", None, "Berlin", "2026-09-10"),
        ("Analyst", None, "Fluent German is required", None, "Berlin", "2026-09-10"),
        ("Analyst", "We want curious people…", None, True, "Berlin", "2026-09-10"),
        ("Analyst", "We want curious people", None, False, "Berlin", "2026-09-10"),
        ("Analyst", None, None, None, "Berlin", "2026-09-10")])
    assert [g.overall for g in got] == ["UNKNOWN", "FAIL", "UNKNOWN", "PASS", "UNKNOWN"]
    assert [g.evidence_source for g in got] == [
        "description_snippet", "description_snippet", "description_truncated", "description",
        "none"]
    assert got[1].failed == ["language"]


def test_pure_technical(spark):
    got = gate_rows(spark, [
        ("Machine Learning Engineer", "x", None, None, "", ""),
        ("Machine Learning Engineer", "logistics and financial planning", None, None, "", ""),
        ("Machine Learning Engineer, Supply Chain", "x", None, None, "", ""),
        ("Analyst", "x", None, None, "", "")])
    assert [g.pure_technical.verdict for g in got] == ["FAIL", "PASS", "PASS", "PASS"]


AXES = [
    ("Maintenance Technician", "", [], []), ("Ambition Group Recruiter", "", [], []),
    ("Supply-Chain Analyst", "", ["supply_chain"], []),
    ("SUPPLY  CHAIN Analyst", "", ["supply_chain"], []),
    ("Software Engineer", "operates operational data", [], []),
    ("Enterprise data warehouse", "", [], ["data_bi"]),
    (None, None, [], []),
]


def test_axes(spark):
    df = spark.createDataFrame([(i, t, b) for i, (t, b, *_) in enumerate(AXES)],
                               "id int, title string, body string")
    got = [r.axes for r in score_axes(df, VOCAB).orderBy("id").collect()]
    for (title, _, dom, enb), a in zip(AXES, got):
        assert (a.domain_matched, a.enabler_matched) == (dom, enb), title
    assert got[-1].score == 0


def test_axis_score_formula(spark):
    df = spark.createDataFrame([
        (0, "Supply chain AI", ""), (1, "Machine learning engineer", "logistics ai"),
        (2, "Analyst", "supply chain work with ai"), (3, "Supply chain analyst", "bi and ai"),
    ], "id int, title string, body string")
    got = [r.axes.score for r in score_axes(df, VOCAB).orderBy("id").collect()]
    # 1: penalty, one body domain only: bonus 8 + 5, no hybrid points, -60
    # 2: overlap 35, bonus 13, hidden 15, tier 40 * 70 / 100
    # 3: 30 title, overlap 35, bonus 10, hidden 15, tier 40
    assert got == [125, 13 - 60, 35 + 13 + 15 + 28, 30 + 35 + 10 + 15 + 40]


def test_gate_text_of_mixed_marks(spark):
    from siftline.functions.text import axis_text, gate_text

    row = spark.range(1).select(
        axis_text(F.lit("S&OP / FP&A, C++")).alias("a"),
        gate_text(F.lit("Küche ﬁne – 5+ yrs")).alias("g")).first()
    assert (row.a, row.g) == (" s&op fp&a c++ ", " kuche fine - 5+ yrs ")
