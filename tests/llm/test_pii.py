import pytest

from lexforge.llm import pii, queries

WEIGHTS = dict(pii.trained())


def starts(text):
    return {(text[s:e], kind) for s, e, kind in pii.best(text, WEIGHTS)}


def test_training_sentences():
    wrong = 0
    for marked in pii.SEEDS:
        text, gold = pii.unmark(marked)
        wrong += {(s, k) for s, _, k in gold} != {(s, k) for s, _, k in pii.best(text, WEIGHTS)}
    assert wrong <= 2


#: Held out: none of these is among the training sentences.
HELD_OUT = [
    ("Reach [[person_name:Sofia Bernardez]] via [[email:sofia.b@post.example]] or [[phone:(303) 555-0140]].", None),
    ("Ms. [[person_name:Trelawney]] moved to [[address:Suite 9, 410 Elm Terrace, Oakham]].", None),
    ("Order no. 944-00-1288 and docket 512333555 were closed.", None),
    ("Her passport no. [[id_number:KL998877]] lapsed; SIN [[id_number:130 692 544]] did not.", None),
    ("Marchetti v. Valdova was cited; the Valdova Housing Act applies.", None),
    ("Signed by [[person_name:R. Castellova]] at [[address:PO Box 19, Millbrook]].", None),
    ("[[person_name:O'Rellara, Simon]] wrote from [[email:o.rellara AT post DOT example]].", None),
    ("what did [[person_name:nina valdenko]] say", None),
    ("Fax [[phone:+44 1632 960777]]; version 3.11.555.014.", None),
    ("[[person_name:HUGO TRESSARA]] of Tressara & Sons Ltd. called.", None),
]


@pytest.mark.parametrize("marked", [m for m, _ in HELD_OUT])
def test_held_out(marked):
    text, gold = pii.unmark(marked)
    assert {(s, k) for s, _, k in gold} == {(s, k) for s, _, k in pii.best(text, WEIGHTS)}, starts(text)


def test_segments_never_overlap_and_masking():
    text = "Call Laura Petrova (lpetrova@example.net) on 202-555-0177 at 5 Church Close."
    found = pii.best(text, WEIGHTS)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert pii.replace(text, found) == "Call [PERSON_NAME] ([EMAIL]) on [PHONE] at [ADDRESS]."


def test_best_is_the_maximum():
    """The dynamic program against all subsets."""
    import itertools

    for marked in pii.SEEDS[10:60]:
        text = pii.unmark(marked)[0]
        found = pii.segments(text)
        if len(found) > 9:
            continue

        def total(chosen):
            s = sum(pii._score(WEIGHTS, x) for x in chosen)
            return s + sum(WEIGHTS.get(pii._link(a, b) or "", 0.0) for a, b in zip(chosen, chosen[1:]))

        sets = [c for r in range(len(found) + 1) for c in itertools.combinations(found, r) if all(a[1] <= b[0] for a, b in zip(c, c[1:]))]
        best = max(total(c) for c in sets)
        got = [next(f for f in found if f[:3] == x) for x in pii.best(text, WEIGHTS)]
        assert total(got) >= best - 1e-9


def test_odd_texts(spark):
    d = spark.createDataFrame([("t", "1", "f", None), ("t", "2", "f", ""), ("t", "3", "f", "a" * 200_000 + " x@y.example"), ("t", None, "f", "Mr. Dalton"), ("t", "4", "f", "😀 lea@example.com")], "table_name string, record_key string, field_name string, text string")
    rows = {(r.record_key, r.pii_type, r.start_pos) for r in pii.find(d).collect()}
    assert rows == {("3", "email", 200_001), (None, "person_name", 4), ("4", "email", 2)}
    assert pii.find(d.limit(0)).count() == 0
    assert pii.masked("text", d).filter("record_key = '1'").first().text is None


def test_queries(spark, small):
    found = queries.p2_found(spark, small)
    assert found.columns == ["table_name", "record_key", "field_name", "pii_type", "start_pos"]
    rows = found.collect()
    assert len(rows) == len(set(rows)) > 0
    masked = queries.p2_masked(spark, small)
    assert masked.filter(masked.text.contains("[EMAIL]")).count() > 0


#: Names of which neither word is in GIVEN, without a title.
UNLISTED = ["Nancy Brown", "Kofi Mensah", "Rhys Pritchard", "Mandla Zulu", "Wiremu Tane", "Ling Zhao", "Saoirse Flynn", "Ulf Dahl"]


@pytest.mark.parametrize("name", UNLISTED)
def test_names_outside_the_lists(name):
    for frame in ("The report was written by {}.", "{} signed the lease on May 2.", "Tenant: {}", "the file of {} is closed"):
        text = frame.format(name)
        at = text.index(name)
        assert (at, at + len(name), "person_name") in {s[:3] for s in pii.segments(text)}
        assert frame.startswith("the file") or (at, at + len(name), "person_name") in pii.best(text, WEIGHTS)


def test_other_capitalised_runs_are_no_names():
    for text in ("The Receiving Party met the Supplier in Mirador Bay.", "Data Handling and Closing Deliverables", "Juniper Quay Holdings LLC paid Copperfield Lane Marine."):
        assert starts(text) == set()


#: Common names of many languages, none among the training sentences. Neither word of most is in a list.
COMMON_NAMES = (
    "Jennifer Smith;Patricia Brown;Zhang Wei;Sanjay Gupta;Thomas Wright;Olivia Taylor;Chidinma Eze;Rhys Pritchard;Mandla Zulu;Wiremu Tane;Ling Zhao;Saoirse Flynn;Ulf Dahl;Eleni Stavrou;Bartosz Wrona;Fatou Diop;Hyun-woo Park;"
    "Dmitry Orlov;Aylin Demir;Priyanka Nair;Tomasz Kaczmarek;Siobhan Kavanagh;Gustavo Pereira;Marta Horvat;Lars Nygaard;Emeka Obiora;Khadija Benali;Oleksandr Bondar;Hana Svoboda;Ravindra Jadhav;Monique Lefort;Klaus Bremer;"
    "Teodora Ilieva;Makoto Hayashi;Nguyen Thi;Caitlin Doyle;Desmond Clarke;Rosalind Pike;Barnaby Hale;Imogen Frost;Kwesi Boakye;Abigail Turner;Dylan Shepherd;Freya Winter;Ignacio Salas;Renata Moretti"
).split(";")
FRAMES = ("The note was left by {}.", "{} signed the lease on May 2.", "Tenant: {}", "the file of {} is closed", "In June {} paid the rent.", "We met {} at the station.", "Counsel for {} replied.", "{} lives here.", "They gave {} the keys, and left.")


def test_recall_on_common_names():
    lists = pii.GIVEN | pii.MORE_GIVEN | pii.FAMILY
    for names in (COMMON_NAMES, [n for n in COMMON_NAMES if not set(n.lower().split()) & lists]):
        hits = [(t.index(n), t.index(n) + len(n), "person_name") in pii.best(t, WEIGHTS) for f in FRAMES for n in names for t in (f.format(n),)]
        assert len(names) > 25 and sum(hits) >= 0.9 * len(hits)


def test_long_details_are_found_whole():
    """No bound of length drops what a whole pattern has matched."""
    address = "a" * 90 + "." + "b" * 90 + "@" + "c" * 40 + ".example"
    assert starts(f"Write to {address} today.") == {(address, "email")}
    assert starts("10 Broadway, New York, NY 10006") == {("10 Broadway, New York, NY 10006", "address")}


def test_organisations_without_a_listed_word_beside_them():
    assert starts("The agreement is with Hollowmere Marine plc, dated May 2.") == set()
    assert starts("Per the chronology, Una Petersen moved out.") == {("Una Petersen", "person_name")}
