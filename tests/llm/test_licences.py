from millrace.llm import licences


def test_rules_in_order(spark):
    s = licences.SENTENCES
    bsd3 = " ".join(s[i] for i in (14, 15, 16, 17))
    wrapped = s[10].replace(" the ", "\nthe ") + "\n" + s[11].replace(" and ", "\nand ") + " " + s[12].replace("OF ", "OF\n")
    rows = [
        (1, s[1], "MIT"), (2, "Words first.\n" + s[4].upper() + "\nWords after.", "Apache-2.0"), (3, bsd3, "BSD-3-Clause"),
        (4, " ".join(s[i] for i in (14, 15, 16)), "BSD-2-Clause"), (5, " ".join(s[i] for i in (16, 15, 14)), ""), (6, wrapped, "MIT"),
        (7, s[1] + " Some words. " + s[22], "CC-BY-NC-4.0,MIT"), (8, None, ""), (9, "", ""), (10, "This permission is a licence to nothing.", ""),
        (None, s[21], "GPL-3.0"), (1, s[1], "MIT"), (11, "license " * 20_000, ""), (12, "?!. \n\n .", ""),
        (13, "An unknown word. " + s[18] + " " + s[19] + "\n\n" + s[20], "GPL-3.0"),
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, licences string")
    out = sorted((repr(r.doc_id), r.licences) for r in licences.scan_licences(docs).collect())
    assert out == sorted((repr(k), want) for k, _, want in rows)
    assert licences.scan_licences(docs.filter("doc_id < 0")).collect() == []


def test_every_known_sentence_has_a_trigger():
    import re

    for norm in licences.known(licences.SENTENCES):
        assert re.search(licences.TRIGGER, norm), norm


def test_own_sentences_without_the_usual_words(spark):
    """What gates the cut comes from the sentences that are given."""
    docs = spark.createDataFrame([(1, "Intro. Do as you please with it. Bye."), (2, "Nothing.")], "doc_id long, text string")
    out = {r.doc_id: r.licences for r in licences.scan_licences(docs, {1: "Do as you please with it."}, [("Free", (1,))]).collect()}
    assert out == {1: "Free", 2: ""}
