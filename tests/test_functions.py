"""Worked examples per function."""

import random

import pytest

from pyspark.sql import functions as F

from siteweave.functions import company as C
from siteweave.functions import confidence as CF
from siteweave.functions import geo, industry, predicates, scoring
from siteweave.functions import text as T

RULES = (C.CompanyRule(r"\bCATERPILLAR\b", "Caterpillar"), C.CompanyRule(r"\bCAT\s+INC\b", "Caterpillar"),
         C.CompanyRule(r"\bABB\b", "ABB", exact_case=True), C.CompanyRule(r"\bBMW\b", "BMW"))


def check(spark, make, cases):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = {r.i: r.v for r in rows.select("i", make(F.col("a")).alias("v")).collect()}
    assert {cases[i][0]: v for i, v in got.items()} == dict(cases)


def test_address(spark):
    check(spark, T.normalize_address, [
        ("100 N Main St Ste 5", "100 NORTH MAIN STREET"),
        ("100 north  main street", "100 NORTH MAIN STREET"),
        ("12 N. Elm Ave.", "12 NORTH. ELM AVENUE"),  # the dot of a direction stays
        ("5 St Louis Rd, Bldg 3", "5 STREET LOUIS ROAD"),  # a comma falls with the look-up
        ("9 FLORIDA BLVD", "9 BOULEVARD"),  # FL takes the rest of the word as a unit
        ("", None), (None, None), ("STE 5", None),
    ])
    check(spark, lambda c: T.normalize_address(c, strict_units=True), [("9 FLORIDA BLVD", "9 FLORIDA BOULEVARD")])


def test_zip_city_numbers(spark):
    check(spark, T.normalize_zip, [("77001-1234", "77001"), (" 770011234 ", "77001"), ("7700", None), ("77-001", None), (None, None)])
    check(spark, T.normalize_city, [("  San   antonio ", "SAN ANTONIO"), ("", None)])
    check(spark, T.leading_number, [("12.3N", 12.3), (" -5", -5.0), ("x1", None), (".5", 0.5), ("1e2", 100.0), ("", None)])


def test_entities_and_names(spark):
    check(spark, T.normalize_facility_name, [
        ("A &amp; B,;.", "A & B"), ("A &#38; &#8212; B", "A & — B"), ("  x  y ", "x y"), ("&#65;&#66;", "AB"),
        ("&AMP;lt;", "<"), ("&#38;#60;x", "&#60;x"), (",.;", None),
    ])


def test_states(spark):
    check(spark, T.state_from_name, [("texas", "TX"), ("tx", "TX"), ("Guam", None)])
    check(spark, T.state_loose, [("texas", "TX"), ("zz", "ZZ"), ("Guam", None), ("", None)])
    check(spark, T.state_seed, [("guam", "GU"), ("zz", "ZZ"), ("Ontario", None)])


def test_company_names(spark):
    check(spark, C.is_blocked, [("n/a", True), ("  TBD ", True), ("12-3.", True), ("A", True), ("3M", False), (None, True)])
    check(spark, C.clean_company, [
        ("THE ACME COMPANY", "Acme"), ("ACME, INC.", "Acme"), ("IBM OF USA LLC", "IBM of USA"), ("NO COMPANY", "No"),
        ("GENERAL", None), ("OF MICE", "Of Mice"),
    ])
    check(spark, lambda c: C.normalize_company(c, RULES), [
        ("caterpillar inc", "Caterpillar"), ("ABB INC", "ABB"), ("none", None), ("FOO CORP", "Foo"),
    ])


NAMES = [
    ("ARCHROCK - CATERPILLAR G3516", "Archrock"),
    ("CATERPILLAR INC - MAPLETON", "Caterpillar"),
    ("BMW - PLANT SPARTANBURG", "Bmw"),  # the rule's name equals the text, so the text is cleaned
    ("CITY OF AUSTIN - CATERPILLAR", None),
    ("ACME, INC", "Acme"),
    ("FOO / BAR", "Foo"),
    ("EAST DIVISION OF CATERPILLAR", "Caterpillar"),
    ("EAST DIVISION OF FOO CORP", "Foo"),
    ("SHOP DBA BAR LLC", "Bar"),
    ("CAT INC: YARD", "Caterpillar"),
    ("FOO LLC #12", "Foo"),
    ("HORIZON STEEL", "Horizon Steel"),
    ("STEEL", None),
    ("PLAIN NAME", None),
    ("", None),
]


def test_extraction(spark):
    rows = spark.createDataFrame([(n,) for n, _ in NAMES], "name string")
    got = {r.name: r.c for r in C.extract_company(rows, "c", RULES, "name").collect()}
    assert got == dict(NAMES)


def test_resolution_order(spark):
    rows = spark.createDataFrame(
        [("n/a", "FOO LLC"), ("PARENT HOLDINGS", "FOO LLC"), (None, "PLAIN NAME"), (None, "PLAIN (BAR INC)"), (None, "AB CO NORTH")],
        "parent string, name string",
    )
    out = C.with_company(C.with_company(rows, "c", RULES, "name", "parent"), "a", RULES, "name", "parent", aggressive=True)
    assert {r.name + str(r.parent): (r.c, r.a) for r in out.collect()} == {
        "FOO LLCn/a": ("Foo", "Foo"), "FOO LLCPARENT HOLDINGS": ("Parent", "Parent"), "PLAIN NAMENone": (None, None),
        "PLAIN (BAR INC)None": (None, "Plain (bar"), "AB CO NORTHNone": (None, "Ab"),
    }


def test_rules_from_table(spark):
    table = spark.createDataFrame([(2, r"\bB\b", "Bee", False), (1, r"\bAB\b", "Ab", True)],
                                  "rule_no int, pattern string, company string, exact_case boolean")
    assert [r.company for r in C.rules_from_table(table)] == ["Ab", "Bee"]
    with pytest.raises(ValueError):
        C.rules_from_table(table, max_rules=1)


STUBS = [
    "ELM PROPERTY HOLDER", "77 QUARRY LANE @ NORTHGATE PARK", "4406 WILLOW ROAD DEPOT", "7710 WILLOW PROPERTIES",
    "512 HARBOR VIEW LLC", "640 MERIDIAN INC-WEST", "12X30 LAKE HOLDINGS", "CITY OF DAYTON FLEET MGMT NORTH",
    "OAK HILL GRAVEL PIT", "2044 LLC", "12TH STREET GARAGE", "7TH HARBOR AVENUE SHOP", "8/90 N LAKE TOWER LLC",
    "(FORMER MILL SITE)", "OLD MILL FORMER", "OAK WORKS - INCIDENT", "220TPH PLANT", "#17 - OAK VALLEY", "042", "OH DOT",
    "88, LTD", "STACK (BOILER 4)", "VALLEY LANDFILL", "DAYTON, TOWN OF", "OAK TRUCKING CO", "OAK TRUCK REPAIR",
]
KEPT = ["40417 - OAK TOOL INC", "200 ELM ST LLC DBA OAK TOOL", "3 WAY VALVE INC", "OAK STEEL WORKS", "", None]


def test_stubs(spark):
    check(spark, predicates.is_address_stub, [(n, True) for n in STUBS] + [(n, False) for n in KEPT])


def test_equipment(spark):
    check(spark, predicates.is_other_operator, [("ARCHROCK - CATERPILLAR G3516", True), ("CATERPILLAR - X CATERPILLAR", False)])
    check(spark, predicates.is_cross_brand, [("FOO - 3516 CUMMINS", True), ("FOO-CUMMINS", False), (None, False)])


def test_industry(spark):
    check(spark, industry.category_label, [("336411", "Aerospace & Defense"), ("336111", "Automobiles & Vehicles"), ("336", "Manufacturing"), (None, "Manufacturing")])
    check(spark, industry.sic_to_naics, [("2011", "311"), ("2399", "313"), ("3999", "339"), ("4000", None), ("x", None)])
    check(spark, industry.size_category, [("Large", "Large"), ("Very Large", None), ("very_small", "Very Small"), ("Small", "Small")])
    check(spark, industry.activity_to_naics, [("Poultry Slaughter", "311615"), ("Slaughter", "311611"), ("Egg", "311999"), (None, "311611")])
    check(spark, industry.validate_naics, [(" 332710, 5", "332710"), ("541330", None), ("3", None), ("33x", None)])


def test_coordinates(spark):
    rows = spark.createDataFrame(
        [("30", "-90"), ("0", "0"), ("95", "-90"), ("10", "10"), ("n", "1"), (None, "1"), ("61", "-150")], "a string, b string")
    got = [r.c.issue for r in rows.select(geo.validate_coordinates(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [None, "zero_coordinates", "out_of_global_bounds", "outside_us", "non_numeric", "missing_coordinates", None]


def test_similarity(spark):
    rows = spark.createDataFrame([("RED PLATE BRAND#2 PLANT", "RED PLATE BRAND#2", 74), ("A", "A", 100), (None, "A", 0), ("AB", "AC", 50)],
                                 "a string, b string, want int")
    assert all(r.want == r.got for r in rows.withColumn("got", scoring.text_similarity(F.col("a"), F.col("b"))).collect())


def test_confidence(spark):
    rows = spark.createDataFrame([(1, 1, False, 30), (2, 2, True, 80), (3, 3, True, 100), (5, 1, False, 50)], "r int, s int, c boolean, want int")
    got = rows.withColumn("got", CF.merge_confidence(F.col("r"), F.col("s"), F.col("c"))).collect()
    assert all(r.want == r.got for r in got)


def test_address_in_parts_equals_the_rules_one_by_one(spark):
    """Words are asked once whether they hold a direction or can be a street type; the answers are those of all rules over the whole text."""
    from siteweave import constants as K

    def plain(c):
        text = F.regexp_replace(T.strip(F.upper(c)), K.UNIT_PATTERN, "")
        for short, full in K.DIRECTIONALS:
            text = F.regexp_replace(text, rf"\b{short}\b", full)
        types = T.text_map(K.STREET_TYPES)
        words = F.transform(F.split(text, f"{OLD_SPACE}+"), lambda w: F.coalesce(F.try_element_at(types, F.regexp_replace(w, "[.,]$", "")), w))
        return T.blank_to_null(T.strip(F.regexp_replace(F.array_join(words, " "), f"{OLD_SPACE}+", " ")))

    OLD_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    draw = random.Random(6)
    parts = ["N", "n.", "NW", "S-E", "W,", "ST", "ST.", "ST..", "Ave,", "BLVD", "É", "ÉN", "N_E", "#5", "STE 4", "FL.2", "unit\t7", "12", ".", "MAIN", "PKWY.", "x😀"]
    gaps = [" ", "  ", "\t", "\u00a0", "\u2003 ", "\u3000", "\n", "", "\x85"]
    texts = ["".join(draw.choice(parts) + draw.choice(gaps) for _ in range(draw.randint(1, 7))) for _ in range(600)] + ["", " ", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_address(F.col("t")).alias("now"), plain(F.col("t")).alias("want"))
    assert found.filter(~F.col("now").eqNullSafe(F.col("want"))).collect() == []
    spaces = spark.range(0x10000).filter("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert spaces.filter(F.col("c").rlike(T.SPACE) != F.col("c").rlike(OLD_SPACE)).isEmpty()
