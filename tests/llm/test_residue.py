import pytest

from lexforge.llm import queries, residue

FLAGGED = [
    ("The laws of {{ start_date }} govern this deed.", "template"),
    ("Dear [INSERT NAME],", "template"),
    ("Rent is $X,XXX.XX, due XX/XX/2025.", "template"),
    ("Signed by &lt;&lt;client name&gt;&gt; today.", "template"),
    ("Our file: %MATTER_ID%", "template"),
    ("The rent [•] is due.", "template"),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
    ("Real text first.\n\ntest test test test test test test", "filler"),
    ("foo bar baz foo bar baz foo bar baz foo bar baz foo bar", "filler"),
    ("Sample text - do not file.", "filler"),
    ("Votre texte ici. Votre texte ici.", "filler"),
    ("Error 503: Service Unavailable", "notice"),
    ("<html><head><title>404 Not Found</title></head><body><h1>Not Found</h1></body></html>", "notice"),
    ('{"error": {"code": 413, "message": "Payload Too Large"}}', "notice"),
    ("Traceback (most recent call last):\n  File \"a.py\", line 3\nKeyError: 'x'", "notice"),
    ("The Vendor shall deliver the goods.\n\nThe requested file could not be loaded. Please try again later.", "notice"),
    ("LA CONVERSION DU FICHIER A11050 A ÉCHOUÉ.", "notice"),
    ("PLEASE ENABLE JAVASCRIPT TO CONTINUE.", "notice"),
    ("Dieses Portal funktioniert nur mit JavaScript.", "notice"),
    ("FATAL ORA-01555: snapshot too old", "notice"),
    ("The registry is overloaded for about 5 minutes. Please try again later.", "notice"),
    ("xxx xxxx xxx xxxx", "filler"),
    ("<noscript>You need scripts.</noscript>", "notice"),
]
KEPT = [
    None, "", " \n ",
    "Signature: ____________________  Date: ______________",
    "[x] approved   [ ] rejected",
    "The court added [sic] and [emphasis added] to it. See [2021] NWCA 77, at [88].",
    'The guide tells staff to complete fields such as "{{client_name}}" first.',
    'The expert explained that "Access denied" was the message seen.',
    "Article 7 of the Terms says that users must enable JavaScript in order to file lists; they did so.",
    "The log in Exhibit A shows a 404 Not Found entry in line 77, which the Vendor relies on.",
    "Any amount marked TBD in the bid was later fixed at $5.",
    "Let S = {x | x > 47} be the set of days.",
    "The scan of the letter could not be admitted because it was not signed.",
    "Write to <taliford.r@example.com> or lea [at] example [dot] com.",
    "<u>Closing date</u>: March 2, 2020.",
    "Under the licence the service may be unavailable for maintenance up to 2 hours a month.",
]
SCHEMA = "doc_id long, text string, source string, matter_id string, document_type string, jurisdiction string, kind string"


def docs(spark, texts, **more):
    row = {"source": "a", "matter_id": "m", "document_type": "letter", "jurisdiction": "x"} | more
    return spark.createDataFrame([(i, t, *row.values(), "clash") for i, t in enumerate(texts)], SCHEMA)


def test_flagged_kinds(spark):
    got = {r.doc_id: r.kind for r in residue.flagged(docs(spark, [t for t, _ in FLAGGED])).collect()}
    assert [got.get(i) for i in range(len(FLAGGED))] == [k for _, k in FLAGGED]


def test_real_texts_are_kept(spark):
    assert residue.flagged(docs(spark, KEPT)).collect() == []
    clean = residue.without_residue(docs(spark, KEPT + ["Dear {{name}},"]))
    assert clean.count() == len(KEPT) and clean.columns == docs(spark, []).columns


def test_combined_evidence(spark):
    text = "Nothing to show: server said 17"
    many = docs(spark, [text, text.replace("17", "99"), text]).unionByName(docs(spark, [text], source="b").selectExpr("doc_id + 10 AS doc_id", "text", "source", "matter_id", "document_type", "jurisdiction", "kind"))
    assert {r.kind for r in residue.flagged(many).collect()} == {"duplicate"}
    assert residue.flagged(docs(spark, [text])).count() == 0


def test_long_text_and_empty_table(spark):
    long = "The Vendor shall deliver the goods to the Purchaser in time. " * 20_000
    assert residue.flagged(docs(spark, [long])).count() == 0
    assert residue.flagged(docs(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p8_found", "p8_clean", "p8_reasons"])
def test_queries_run(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_combined_evidence_of_long_and_titled_texts(spark):
    """No length, title or weak word decides alone."""
    long = " ".join(f"The server told {a} of {b}." for a, b in zip("amber birch cedar dune elm fern gorse heath iris juniper kelp".split(), "one two three four five six seven eight nine ten eleven".split()))
    titled = "# Quarterly accounts\n\nNothing to show: server said 17"
    foreign = "Rien ne se trouve ici pour le moment 17"
    for text in (long, titled, foreign):
        many = docs(spark, [text, text.replace("17", "99")] * 4).unionByName(docs(spark, [text], source="b").selectExpr("doc_id + 10 AS doc_id", "text", "source", "matter_id", "document_type", "jurisdiction", "kind"))
        assert sorted((r.doc_id, r.kind) for r in residue.flagged(many).collect()) == [(i, "duplicate") for i in (*range(8), 10)], text
    about = "# Letter of thanks\n\nThe letter gives thanks for the work."
    many = docs(spark, [about] * 8).unionByName(docs(spark, [about], source="b"))
    assert residue.flagged(many).count() == 0


REAL = "The {a} shall deliver the {b} to the {c} within {n} days of the notice, and the {a} shall keep records of the {b} for {n} years."


def test_terms_flag_wordings_that_no_detector_names(spark):
    """Seeds name some wordings of a broken viewer; other texts with the same terms, and units of real texts, are flagged by terms alone."""
    words = "vendor tenant landlord supplier licensor employer trustee lender guarantor assignee".split()
    real = [REAL.format(a=words[i % 10], b=words[(i * 3 + 1) % 10], c=words[(i * 7 + 2) % 10], n=i) for i in range(60)]
    seeds = [f"The viewer could not be loaded. Page {i} of the portal is unavailable." for i in range(12)]
    unnamed = ["Viewer portal page loaded unavailable", "Portal unavailable, viewer page"]
    mixed = real[0] + "\n\nViewer page of portal unavailable"
    texts = real + seeds + unnamed + [mixed]
    got = {r.doc_id: r for r in residue.reasons(docs(spark, texts)).collect()}
    n = len(real)
    assert set(got) == set(range(n, n + len(seeds) + len(unnamed) + 1))
    assert all(not got[i].by_detector and got[i].by_terms and got[i].kind == "combined" for i in range(n + len(seeds), len(texts)))


def test_long_notice_and_long_quote(spark):
    """Neither a unit's nor a quote's length switches anything off."""
    long = "Your browser blocks JavaScript " + "and the page can't be shown " * 1 + "."
    notice = "Please enable JavaScript. " + "x" * 400
    assert {r.doc_id for r in residue.flagged(docs(spark, [long, notice])).collect()} == {0, 1}
    quoted = "The guide says \"" + "fill in {{name}} and more " * 20 + "\" to all staff."
    assert residue.flagged(docs(spark, [quoted])).count() == 0


def test_ties_repeats_and_nulls(spark):
    rows = docs(spark, [None, "Dear {{name}},", "Dear {{name}},"], source=None, matter_id=None, document_type=None, jurisdiction=None)
    assert sorted((r.doc_id, r.kind) for r in residue.flagged(rows).collect()) == [(1, "template"), (2, "template")]
