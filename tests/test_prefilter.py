import pytest

from wirepulse.operators import prefilter as pf


@pytest.fixture(scope="module")
def classify(spark):
    def run(rows, **options):
        frame = spark.createDataFrame(
            [(i, *(r + ("", None)[len(r) - 1:] if len(r) < 3 else r)) for i, r in enumerate(rows)],
            "i int, title string, summary string, sec_form_type string",
        )
        return [r.asDict() for r in pf.prefilter(frame, **options).orderBy("i").collect()]

    return run


@pytest.mark.parametrize(
    "title, hit, strong",
    [
        ("Orchid raises $30M Series C", "funding", True),
        ("Orchid gets $30 million term loan", "funding", True),
        ("Orchid raising money", "funding", False),
        ("Larch to acquire Rowan in $70M deal", "acquisition", True),
        ("Larch buys Rowan", "acquisition", False),
        ("Orchid launches a card and raises $20M", "funding", True),
        ("Orchid launches a $20M card", "launch", False),
        ("Weiss expands to Canada", "expansion", False),
        ("Orchid is now known as Tulip", "rebrand", False),
        ("Plume partners with a bank", "partnership", False),
    ],
)
def test_families(classify, title, hit, strong):
    row = classify([(title,)])[0]
    assert (row["pass"], row["hit"], row["strong"]) == (True, hit, strong)
    assert row["reason"].startswith("matched ")


@pytest.mark.parametrize("title", ["groundwork", "debuyser", "reseeding", "relaunchable", "a fundraiser"])
def test_substrings_do_not_count(classify, title):
    assert classify([(title,)])[0]["reason"] == "no tracked event language"


def test_vetoes_and_scope(classify):
    rows = classify([
        ("Global market to grow, merger activity", "The market size is projected to reach $1B, says a research report."),
        ("Orchid launches app", "It also raised money before."),
        ("Quiet headline", "x" * 1600 + " raises money"),
        ("Orchid appoints new CFO to lead funding",),
        ("Quiet headline", None),
    ])
    assert rows[0]["reason"] == r"vetoed by \bmarket (report|research|forecast|size|outlook)\b"
    assert rows[1]["hit"] == "launch"
    assert not rows[2]["pass"]
    assert rows[3]["reason"].startswith(r"vetoed by \bappoints?")
    assert rows[4]["reason"] == "no tracked event language"


def test_filings(classify):
    rows = classify([
        ("8-K - ACME", "Item 2.01 Completion", "8-K"),
        ("8-K - ACME", "Item 1.01 Entry into a Material Definitive Agreement", "8-k"),
        ("8-K - ACME", "Item 1.01 Entry into a Material Definitive Agreement for a merger", "8-K"),
        ("8-K - ACME", "Item 5.02", "8-K"),
        ("D - Willow Payments Inc (0009876543) (Filer)", "", "D"),
        ("D/A - Willow Capital Fund II, L.P. (0009876543) (Filer)", "", "D/A"),
        ("D - Willow Mining Corp. (0009876544) (Filer)", "", "D"),
        ("10-Q - ACME", "raises money", "10-Q"),
        ("Orchid raises $5M", "", ""),
    ])
    assert [r["hit"] for r in rows] == ["sec-8k", None, "sec-8k", None, "sec-form-d", None, None, None, "funding"]
    assert rows[2]["reason"] == r"8-K item 1.01 + \bmerger\b"
    assert rows[5]["reason"].startswith("Form D from an investment vehicle (")
    assert rows[7]["reason"] == "SEC form 10-Q is not tracked"


def test_disabled_events_leave_the_vocabulary(classify):
    families = pf.enabled_families(disabled=["launch"])
    assert not classify([("Orchid launches app",)], families=families)[0]["pass"]


def test_filter_on_outcome_does_not_copy_patterns(spark):
    frame = spark.createDataFrame([("a", "b")], "title string, summary string")
    plan = pf.prefilter(frame).where("pass")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert not any("Filter" in line and "RLIKE" in line for line in lines)


def test_a_veto_word_added_by_a_row(spark):
    from wirepulse.operators import prefilter as pf

    rows = [("funding", 1, 0, r"\braises\b"), ("veto", 9, 0, r"\bgardening\b")]
    words = pf.read_vocabulary(spark.createDataFrame(rows, "list string, priority int, position int, pattern string"))
    items = spark.createDataFrame(
        [(1, "Firm raises funds", "for gardening"), (2, "Firm raises funds", "for cards"), (3, "Firm rests", ""), (4, "x", "y " * 900 + "it raises")],
        "id int, title string, summary string",
    )
    got = {r.id: (r["pass"], r.hit) for r in pf.prefilter(items, vocabulary=words).collect()}
    assert got == {1: (False, None), 2: (True, "funding"), 3: (False, None), 4: (False, None)}
    assert {r.id for r in pf.prefilter(items, vocabulary=words, body_chars=None).where("pass").collect()} == {2, 4}


def test_whole_documents_are_searched(spark, sf_dir):
    """The query puts a deal sentence at character 1,600 of a third of the documents."""
    from wirepulse.plans import catalog

    cut, whole = ({r.item_id: r.hit for r in catalog.QUERIES[name](spark, sf_dir).collect()} for name in ("prefilter_documents", "prefilter_documents_whole"))
    far = {k for k in whole if whole[k] and not cut[k]}
    assert far and set(cut) == set(whole) and all(whole[k] for k in cut if cut[k])
