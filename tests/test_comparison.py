"""Comparison, queue, ranking and text operators against plain Python and worked examples."""

import datetime
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as t
from lexforge.operators import comparison, ranking
from lexforge.plans import comparison_queries

CASES = "source_path string, case_id string, case_pos int, family string, passed boolean"


def cases(spark, rows):
    return spark.createDataFrame(rows, CASES)


def pairs(spark, *rows):
    return spark.createDataFrame(rows or [("new", "old")], "candidate string, baseline string")


def test_case_changes_last_duplicate_wins(spark):
    rows = [("old", "a", 0, "f", True), ("old", "b", 1, "f", False), ("old", "gone", 2, "f", True), ("new", "a", 0, "f", True), ("new", "a", 3, "g", False), ("new", "b", 1, "f", True), ("new", "added", 2, "f", True), ("new", None, 4, "f", False)]
    got = {(r.case_id, r.case_pos, r.family, r.change) for r in comparison.case_changes(cases(spark, rows), pairs(spark)).collect()}
    assert got == {("a", 3, "g", "regressed"), ("b", 1, "f", "improved")}
    assert comparison.case_changes(cases(spark, []), pairs(spark)).count() == 0


def test_family_changes_in_both_variants(spark):
    rows = [("old", "a", 0, "x", True), ("old", "b", 1, "x", False), ("new", "a", 0, "x", True), ("new", "c", 1, "y", True), ("old", "d", 2, "z", True)]
    got = {r.family: (r.before_cases, r.now_cases, r.delta, r.status, r.delta_or_zero) for r in comparison.family_changes(cases(spark, rows), pairs(spark)).collect()}
    assert got == {"x": (2, 1, 0.5, "improved", 0.5), "y": (0, 1, None, "unavailable", 1.0), "z": (1, 0, None, "unavailable", -1.0)}


VERDICT = CASES + ", checks map<string,boolean>, grounded boolean, latency_ms double, cost_usd double"


@pytest.mark.parametrize(
    "old, new, want",
    [
        ([(True, 10.0)], [(True, 10.0)], ("unchanged", "mixed")),
        ([(False, 10.0)], [(True, 9.0)], ("improved", "better")),
        ([(False, 10.0)], [(True, 12.0)], ("improved", "mixed")),
        ([(True, 10.0)], [(False, 9.0)], ("regressed", "review")),
    ],
)
def test_verdicts(spark, old, new, want):
    rows = [(p, f"c{i}", i, "f", ok, {"citation_checks": True}, True, ms, None) for p, side in (("old", old), ("new", new)) for i, (ok, ms) in enumerate(side)]
    r = comparison.verdicts(spark.createDataFrame(rows, VERDICT), pairs(spark)).first()
    assert (r.rate_trend, r.verdict) == want


def test_a_worse_risk_asks_for_review(spark):
    rows = [(p, "c", 0, "f", p == "new", {"citation_checks": p == "old", "answerability_checks": False}, p == "new", 1.0, 1.0) for p in ("old", "new")]
    r = comparison.verdicts(spark.createDataFrame(rows, VERDICT), pairs(spark)).first()
    assert (r.risk_regressions, r.verdict) == (2, "review")


def test_merge_hits_keeps_first_and_fills_nulls(spark):
    rows = [("q", None, 1, "a", 0.9, None), ("q", None, 2, "b", 0.8, None), ("q", "s2", 1, "c", 0.1, 0.7), ("q", "s1", 1, "a", 0.5, 0.6), ("q", "s1", 2, "c", None, 0.3), ("q", "s2", 2, "a", 0.4, 0.2), ("q", "s1", 2, "c", None, 0.3)]
    d = spark.createDataFrame(rows, "query_id string, subquery_id string, rank int, id string, dense_score double, sparse_score double")
    got = {r.id: (r.dense_score, r.sparse_score, r.from_root, r.subquery_ids, r.hits, r.place) for r in ranking.merge_hits(d).collect()}
    assert got == {"a": (0.9, 0.6, True, ["s1", "s2"], 3, 1), "b": (0.8, None, True, [], 1, 2), "c": (0.1, 0.3, False, ["s1", "s2"], 3, 3)}
    assert ranking.merge_hits(d.limit(0)).count() == 0


def test_unknown_filter_keys_are_named(spark):
    assert ranking.known_filters({"court": "x", "date_from": "2020", "resolved": 1}, ["court", "id"]) == ({"court": "x"}, ["date_from", "resolved"])


def test_scope_before_and_after_the_ranking(spark):
    hits = spark.createDataFrame([("q", i, "d1" if i % 2 else "d2", float(-i)) for i in range(6)] + [("free", 9, None, 1.0)], "query_id string, id int, document_id string, score double")
    scope = spark.createDataFrame([("q", "d1"), ("q", "d1")], "query_id string, document_id string")
    from lexforge.operators.retrieval import top_k

    post = ranking.in_scope(top_k(hits, 2, [F.desc("score"), F.asc("id")]), scope, pushdown=False)
    pre = top_k(ranking.in_scope(hits, scope, pushdown=True), 2, [F.desc("score"), F.asc("id")])
    assert sorted((r.query_id, r.id) for r in post.collect()) == [("free", 9), ("q", 1)]
    assert sorted((r.query_id, r.id) for r in pre.collect()) == [("free", 9), ("q", 1), ("q", 3)]


def of(spark, function, *values):
    names = [f"c{i}" for i in range(len(values[0]))]
    d = spark.createDataFrame(list(values), ", ".join(f"{n} string" for n in names)).withColumn("_n", F.monotonically_increasing_id())
    return [r.x for r in d.select("_n", function(*[F.col(n) for n in names]).alias("x")).orderBy("_n").collect()]


def test_text_functions(spark):
    assert of(spark, t.normal_term, ("The Notices, and Fees!",), ("gas",), ("is as",), (None,), ("",)) == ["the notice and fee", "gas", "is as", None, ""]
    assert of(spark, lambda c: t.date_boundary(c, True), ("since 2019",), ("after May 3, 2020 and 2021",), ("in 2020",), ("after x",), (None,)) == ["2019-01-01", "2020-01-01", None, None, None]
    assert of(spark, lambda c: t.date_boundary(c, False), ("until 1999",), ("before",)) == ["1999-12-31", None]
    assert of(spark, t.hint_confidence, ("a b", "A, b."), ("a b c", "b c"), ("a b", "b c d"), ("a", "x"), ("", "x"), (None, "x")) == [1.0, 0.666667, 0.333333, 0.0, 0.0, 0.0]
    assert of(spark, t.version_or, (" v1 ",), ("  ",), (None,)) == ["v1", "unknown", "unknown"]
    v = lambda c: t.safe_count(F.try_parse_json(c))
    assert of(spark, v, ("3",), ("-1",), ("true",), ("2.0",), ("2.5",), ('" 7 "',), ('"n/a"',), ("null",), ('"7.0"',)) == [3, None, None, 2, None, 7, None, None, None]
    j = lambda c: F.to_json(t.json_object(c))
    assert of(spark, j, ('```json\n{"a":1}\n```',), ('so: {"a":{"b":2}} ok',), ('{"a":1}',), ("{oops",), ("[1]",), (None,), ("",)) == ['{"a":1}', '{"a":{"b":2}}', '{"a":1}', None, "[1]", None, None]


def brute_split(query):
    out = []
    for part in (p.strip(" .") for p in re.split(r"\s*;\s*", re.sub(r"\s+", " ", query or "").strip())):
        if not part:
            continue
        low = part.lower()
        if "rule" in low and "exception" in low and " and " in low:
            pieces = re.split(r"\band\b", part, maxsplit=1, flags=re.I)
        elif " and " in low and sum(a in low for a in t.SPLIT_ANCHORS) >= 2:
            pieces = re.split(r"\band\b", part, flags=re.I)
        else:
            pieces = [part]
        out += [p.strip(" .") for p in pieces if p.strip(" .")]
    return list(dict.fromkeys(out))


def test_sub_queries(spark):
    texts = ["", "one; two ;one.", "the rule and the exception and more", "compare a and the difference of b and c", "salt and pepper", "What is x AND what are y; z", " ; ; "]
    got = of(spark, t.sub_queries, *[(x,) for x in texts])
    assert got == [brute_split(x) for x in texts]


def brute_topic(text, topic):
    canon = lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]+", " ", (s or "").lower())).strip()
    stem = lambda w: w[:-2] if len(w) > 4 and w.endswith("es") else w[:-1] if len(w) > 3 and w.endswith("s") else w
    body, want = canon(text), canon(topic)
    if not body or not want:
        return False
    if want in body:
        return True
    asked, words = [stem(w) for w in want.split() if len(w) >= 3], [stem(w) for w in body.split()]
    if len(asked) < 2 or len(words) < 2:
        return False
    at, found = 0, []
    for a in asked:
        hit = next((i for i in range(at, len(words)) if words[i] == a or (len(a) >= 6 and len(words[i]) >= 6 and words[i][:6] == a[:6])), None)
        if hit is None:
            return False
        found.append(hit)
        at = hit + 1
    return found[-1] - found[0] <= max(6, len(asked) + 3)


def test_topic_in_text(spark, small):
    rows = [("The terminations of a notice", "termination notices"), ("notice then termination", "termination notice"), ("a b", "a"), ("termination x x x x x x x notice", "termination notice"), ("", "x"), (None, "x"), ("x", None), ("Liability caps", "liability cap")]
    assert of(spark, t.topic_in_text, *rows) == [brute_topic(*r) for r in rows]
    d = pd.read_parquet(f"{small}/parent_chunks.parquet").sort_values("ingested_at").drop_duplicates("parent_chunk_id").set_index("parent_chunk_id")
    got = {r.parent_chunk_id: r.on_topic for r in comparison_queries.heading_topics(spark, small).collect()}
    assert got == {i: brute_topic(r.text, r.heading_text) for i, r in d.iterrows()}


def brute_chronology(text):
    out = []
    for m in re.finditer(rf"\b(?:{t.EVENT_DATE})\b", text or "", re.I | re.A):
        for form in ("%Y-%m-%d", "%B %d, %Y", "%b %d, %Y"):
            try:
                day = datetime.datetime.strptime(re.sub(r"\s+", " ", m[0]), form).date()
                break
            except ValueError:
                continue
        else:
            continue
        out.append((day, m[0], m.start(), " ".join(re.sub(r"[ \t\n\x0b\f\r]+", " ", text[max(0, m.start() - 80) : m.end() + 120]).strip(" ").split(" "))))
    return out


def test_chronology(spark, small):
    texts = ["On 2020-02-30 nothing; on 2020-02-29 it began. Sept 5, 2024 is no form, Sep 5, 2024 is.", "March 5,2024 fails, march  5, 2024 counts", "", None, "x" * 200 + " 2021-01-01 " + "y" * 300, "2021-01-01"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.event_date, r.date_text, r.position, r.excerpt) for r in ranking.chronology(d).collect())
    assert got == sorted((i, *x) for i, text in enumerate(texts) for x in brute_chronology(text))
    d = pd.read_parquet(f"{small}/parent_chunks.parquet").sort_values("ingested_at").drop_duplicates("parent_chunk_id")
    got = {(r.parent_chunk_id, r.event_date, r.position) for r in comparison_queries.chronology(spark, small).collect()}
    assert got == {(i, day, at) for i, text in zip(d.parent_chunk_id, d.text) for day, _, at, _ in brute_chronology(text)} and got


def test_best_excerpt(spark):
    q = "notice period"
    texts = ["The notice period is 30 days. It runs unless waived. Rent is due.", "Unless agreed, the notice period is short.", "No match here. Nor here", "", None]
    got = of(spark, ranking.best_excerpt, *[(x, q) for x in texts])
    assert got == ["The notice period is 30 days. It runs unless waived.", "Unless agreed, the notice period is short.", "Nor here", None, None]


def test_violations_and_categories(spark):
    schema = "case_id string, query string, family string, selected int, required boolean, messages int, depends boolean"
    rows = [("a.1", "q", "f", 0, False, None, False), ("A", " ", "f", None, True, 0, True), (None, None, None, 1, None, None, None)]
    got = [r.violations for r in comparison.violations(spark.createDataFrame(rows, schema)).collect()]
    assert got == [[], ["id", "query", "selected_document_ids", "selected_document_required", "follow_up"], ["id", "query"]]
    schema = "source_path string, case_pos int, run string, case_id string, family string, checks map<string,boolean>, judges map<string,boolean>, citations int, warnings array<string>, passed boolean"
    rows = [("s", 0, "r", "c", "policy_issue_spotting", {"citation_checks": False, "family_routing": True}, {"groundedness": False}, 2, ["x"], False), ("s", 1, "r", "", "f", {}, {}, 0, ["Hallucination likely", None], True), ("s", 2, "r", "d", "f", {}, {}, None, None, True)]
    got = sorted((r.source_id, r.category) for r in comparison.review_categories(spark.createDataFrame(rows, schema)).collect())
    assert got == [("r:c", "legal_issue_spotting_disagreement"), ("r:c", "missing_citation"), ("r:c", "suspected_hallucination"), ("r:unknown_case", "missing_citation"), ("r:unknown_case", "suspected_hallucination")]


def test_answerability_table(spark):
    rows = [("f", {"answerability_checks": a}, g) for a, g in ((True, True), (True, False), (False, True), (False, None))] + [("f", {}, True)]
    r = comparison.answerability(spark.createDataFrame(rows, "family string, checks map<string,boolean>, grounded boolean"), "family").first()
    assert (r.cases, r.correct_supported_count, r.correct_insufficient_count, r.false_positive_count, r.false_negative_count, r.false_negative_rate) == (4, 1, 1, 1, 1, 0.25)
