"""Rule lookup by required letters against trying every rule on every name."""

import random
import re

import pytest

from siteweave.functions.company import CompanyRule, rule_company
from siteweave.operators import rules


@pytest.mark.parametrize("pattern, letters", [
    (r"\bCATERPILLAR\b", "caterpillar"), (r"ACME\s+BOLTS?", "acme"), (r"(?:RED|BLUE)\s+WIDGET", "widget"), (r"AB", None), (r"[A-Z]+", None),
    (r"(GENERAL) MOTORS", "general motors"), (r"X?YZW", "yzw"), (r"(FOO)?BARS", "bars"), (r"(FORD){2}", "ford"), (r"FORD*S", "for"),
    (r"É+CLAIR", "clair"), (r"\p{Lu}STEEL", None), (r"A(?=BC)BCDE", "abcde"), (r"a|bcdef", None), (r"(?x) a b c", None), (r"(unclosed", None), (r"\Qabc.d\E", None),
])
def test_required_letters(pattern, letters):
    assert rules.required_letters(pattern) == letters


def test_like_every_rule_on_every_name(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("ABCDE") for _ in range(draw.randint(2, 6))) for _ in range(150)]
    shapes = [r"\b{}\b", r"{}", r"{}\s+{}", r"(?:{}|{})X?", r"{}.*{}", r"^{}", r"{}S?$", r"[AB]{}"]
    listed = [CompanyRule(draw.choice(shapes).format(*draw.choices(words, k=2)), f"c{i}", draw.random() < 0.2) for i in range(400)]
    names = {" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(300)}
    names = sorted(n.lower() if draw.random() < 0.3 else n for n in names) + ["", "éA", "12 AB"]
    table = spark.createDataFrame([(i, r.pattern, r.company, r.exact_case) for i, r in enumerate(listed)], "rule_no int, pattern string, company string, exact_case boolean")
    frame = spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "name string")
    got = {r["name"]: (r["rule_no"], r["company"]) for r in rules.by_rules(frame, table).collect()}
    want = {}
    for n in names:
        hit = next((i for i, r in enumerate(listed) if re.search(r.pattern, n, 0 if r.exact_case else re.I)), None)
        if hit is not None:
            want[n] = (hit, f"c{hit}")
    assert got == want and len(want) > 100
    few = listed[:25]
    chained = frame.distinct().select("name", rule_company(frame["name"], few).alias("company")).filter("company is not null")
    small = rules.by_rules(frame, table.filter("rule_no < 25")).select("name", "company")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, chained.collect()))


def test_too_many_rules_without_letters_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rules, "UNINDEXED", 1)
    table = spark.createDataFrame([(1, "A.", "a", False), (2, "B.", "b", False)], "rule_no int, pattern string, company string, exact_case boolean")
    with pytest.raises(ValueError, match="more than 1"):
        rules.by_rules(spark.createDataFrame([("AB",)], "name string"), table)
