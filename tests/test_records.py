"""Golden cases of the record parsers, worked out from the format's rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import records as R
from lodestone.functions import text as X
from lodestone.operators import extract, segment

BLOCK = [
    "CLASS : 9, 35",
    "TM2025001234 18 April 2025",
    "Mark translation: 'small star' in English.",
    "Computer programs; recorded media for the storage of data and for teaching.",
    "NORTHERN LIGHT",
    "STAR SDN BHD ; 12 High Road",
    "AGENT : First & Last",
    "2nd floor",
]


def block(spark, lines):
    return R.with_block_fields(spark.createDataFrame([(lines, "x", "y")], "lines array<string>, _serial string, completeness string").drop("_serial", "completeness")).first()


def entry(spark, lines):
    return R.with_entry_fields(spark.createDataFrame([(lines,)], "lines array<string>")).drop("lines").first().asDict()


def hits(spark, text):
    return [r.asDict() for r in R.with_context_fields(R.with_hits(spark.createDataFrame([(text,)], "text string"))).orderBy("n").collect()]


def test_block_by_semicolon(spark):
    r = block(spark, BLOCK)
    assert (r["serial_number"], r["registration_date"], r["class_indices"]) == ("TM2025001234", "18 April 2025", "9, 35")
    assert r["trademark_name"] == "small star"
    assert (r["applicant_name"], r["applicant_address"]) == ("NORTHERN LIGHT STAR SDN BHD", "12 High Road")
    assert r["agent_details"] == "First & Last 2nd floor"
    assert r["description"] == "Computer programs; recorded media for the storage of data and for teaching."
    assert r["completeness"] == pytest.approx(1.0)


def test_block_by_company_word_and_without_owner(spark):
    r = block(spark, ["TM2025001234", "goods of all kinds", "SOME NAME", "ACME LTD", "AGENT: x"])
    assert (r["applicant_name"], r["applicant_address"]) == ("SOME NAME ACME LTD", "")
    # Of a body of up to fifteen lines the first is never tried for a company word.
    r = block(spark, ["TM2025001234", "ACME LTD makes goods", "of all kinds"])
    assert (r["applicant_name"], r["description"]) == ("", "ACME LTD makes goods of all kinds")


def test_block_second_serial_bounds_the_owner_but_not_the_description(spark):
    r = block(spark, ["TM2025001234", "first goods", "FIRST INC ; here", "TM2025009999 next", "other goods", "AGENT : x"])
    assert r["applicant_name"] == "FIRST INC"
    assert r["applicant_address"] == "here TM2025009999 next other goods"
    assert r["description"] == "first goods"


def test_block_without_serial_and_empty(spark):
    assert block(spark, ["CLASS : 3", "text"])["serial_number"] is None
    assert block(spark, [])["completeness"] == 0


def test_block_transliteration(spark):
    r = block(spark, ["TM2025001234", "Mark transliteration: LONG WANG Registration of this trademark is limited."])
    assert r["trademark_name"] == "LONG WANG"


def test_entry(spark):
    lines = ["CLASS: 3, 5 TM2025012263 18 April 2025", "International priority date claimed: 11 September 2018, Japan", "By consent of the registered proprietor no: 123, 456", "Soaps", "and oils", "ACME SDN BHD JALAN 1;", "AGENT : one two three", "more of the agent here", "short line"]
    r = entry(spark, lines)
    assert r == {
        "class_index": "3,5", "serial_number": "TM2025012263", "application_date": "18 April 2025", "priority_date": "11 September 2018, Japan", "consent_numbers": "123, 456",
        "description": "Soaps and oils short line", "company_name": "ACME SDN BHD JALAN 1;", "agent_details": "one two three more of the agent here",
    }


def test_entry_date_on_next_line(spark):
    r = entry(spark, ["TM2025012263", "18 April 2025 goods"])
    assert (r["application_date"], r["description"]) == ("18 April 2025", "goods")


def test_hits(spark):
    text = "CLASS : 7\n\n\nTM2025012263 18 April 2025 Engines of many kinds\nACME ENGINES AND MORE SDN BHD;\nAGENT: someone\n"
    (r,) = hits(spark, text)
    assert (r["class_index"], r["company_name"], r["agent_details"]) == ("7", "ACME ENGINES AND MORE SDN BHD;", "someone")
    assert r["description"] == "Engines of many kinds"
    # A hit at the very start of its context gives no company and no description.
    assert hits(spark, "TM2025012263 18 April 2025 Things\nACME ENGINES AND MORE SDN BHD;")[0]["company_name"] == ""


def plain_contexts(text):
    """Every hit with its context, cut by places in the text."""
    text = re.sub(r"\n\s*\n+", "\n", text)
    found = list(re.finditer(r"(TM\d{8,})\s+(\d{1,2}\s+\w+\s+\d{4})", text))
    return [(i, m.group(1), m.group(2), text[max(0, m.start() - 500) : m.end() + (500 if i < len(found) - 1 else 1000)]) for i, m in enumerate(found)]


def test_contexts_by_places(spark):
    rng = random.Random(4)
    texts = [None, "", "no hit", "TM12345678 1 ab 2025"]
    for _ in range(12):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts += [f"TM{rng.randrange(10**8, 10**9)} {rng.randrange(1, 30)} août {rng.randrange(1990, 2030)}", "é \n\n" * rng.randrange(3), "word; " * rng.choice([0, 0, 1, 5, 90, 400])]
        texts.append("".join(parts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted(tuple(r) for r in R.with_hits(rows).collect())
    assert got == [(d, *c) for d, t in enumerate(texts) for c in plain_contexts(t or "")] and len(got) > 100


def test_context_fields(spark):
    text = (
        "CLASS : 9, 35\nTM2025000001 1 May 2025 Registration of this trademark\nis limited. Engines\n and parts\nNORTHERN ENGINES AND MORE SDN BHD; 1 Road\nInternational priority date claimed : 2 June 2020, Japan;"
        " by consent of the registered proprietor,\nthe marks no: 12, 34 and more\nAGENT : First\nand Last\nTM1\n"
    )
    (r,) = hits(spark, text)
    assert r == {
        "n": 0, "class_index": "9,35", "serial_number": "TM2025000001", "application_date": "1 May 2025", "priority_date": "2 June 2020, Japan", "consent_numbers": "12, 34",
        "description": "Engines and parts", "company_name": "NORTHERN ENGINES AND MORE SDN BHD;", "agent_details": "First\nand Last",
    }


def test_odd_lines(spark):
    """Null lines and null arrays have no fields; nothing is read past either end."""
    assert block(spark, None)["serial_number"] is None and block(spark, [None, ""])["completeness"] == 0
    assert set(entry(spark, None).values()) == set(entry(spark, [None]).values()) == {""}
    r = block(spark, ["AGENT : TM2025001234 1 May 2025"])
    assert (r["serial_number"], r["description"], r["applicant_name"], r["agent_details"]) == ("TM2025001234", "", "", "TM2025001234 1 May 2025")
    r = entry(spark, ["AGENT : x", "one two three", "a b c;", "d e f", "TM12345678"])
    assert (r["agent_details"], r["serial_number"], r["description"], r["application_date"]) == ("x one two three", "TM12345678", "", "")


def test_segmenter(spark):
    text = "preface\nCLASS:3 TM2025012263 x\ngoods a\nlast line\n# Super Value\nname line\n\nTM2025012264 1 x\nend"
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "goods without a start"), ("d", 3, None)], "doc_id string, page int, text string")
    lines = lambda compat: [r["lines"] for r in segment.entries(pages, compat=compat).orderBy("page", "entry").collect()]
    assert lines(False) == [["CLASS:3 TM2025012263 x", "goods a", "last line"], ["# Super Value", "name line"], ["TM2025012264 1 x", "end"]]
    # The line right before a start is lost, but a blank one protects the line before it.
    assert lines(True) == [["CLASS:3 TM2025012263 x", "goods a"], ["# Super Value", "name line"], ["TM2025012264 1 x", "end"]]


def words(page, *lines, doc="d", w=600.0, h=800.0):
    return [(doc, page, w, h, t, 50.0 * i, 50.0 * i + 40, float(y), float(y) + 8) for y, line in lines for i, t in enumerate(line.split())]


def test_blocks(spark):
    from lodestone.schema import WORDS

    rows = words(1, (100, "CLASS : 9"), (140, "TM2025000001 goods"), (300, "AGENT : a"), (340, "CLASS : 5"), (380, "TM2025000002 goods"), (500, "the CLASS : 9 inside"))
    rows += words(2, (60, "no header")) + words(3, (0, "AGENT : top"), (150, "CLASS : 1"), (170, "TM2025000003 x"))
    df = spark.createDataFrame(rows, WORDS)
    found = {(r["page"], r["class_y"]): (r["by0"], r["by1"]) for r in extract.blocks(df).collect()}
    # An agent line at height 0 counts as none.
    assert found == {(1, 100.0): (50.0, 315.0), (1, 340.0): (325.0, 740.0), (3, 150.0): (50.0, 740.0)}
    got = {r["serial_number"]: r["class_indices"] for r in extract.records(df).collect()}
    assert got == {"TM2025000001": "9", "TM2025000002": "5", "TM2025000003": "1"}
    assert extract.records(df, start_page=2).count() == 1
    assert {r["page"]: (r["records"], r["percent"]) for r in extract.page_status(df, extract.records(df)).collect()} == {1: (2, 33), 2: (0, 66), 3: (1, 100)}


def test_block_of_exactly_the_least_height_is_dropped(spark):
    from lodestone.schema import WORDS

    rows = words(1, (110, "AGENT : a"), (150, "CLASS : 9"), (220, "AGENT : b")) + words(2, (110, "AGENT : a"), (150, "CLASS : 9"), (220.1, "AGENT : b"))
    assert [r["page"] for r in extract.blocks(spark.createDataFrame(rows, WORDS)).collect()] == [2]


def test_text_expressions(spark):
    df = spark.createDataFrame([("Mark translation: 'Big Bear' and more", "2 may 2024"), ("Mark transliteration: DA XIONG The mark", "31 Sept 2024"), ("plain", None)], "line string, d string")
    got = df.select(X.translated_name(F.col("line")), X.date_of(F.col("d")).cast("string"), X.class_numbers(F.lit("9, 35 x 100"))).collect()
    assert [tuple(r) for r in got] == [("Big Bear", "2024-05-02", [9, 35, 100]), ("DA XIONG", None, [9, 35, 100]), (None, None, [9, 35, 100])]
