"""Company rules as a table: a name meets only the rules whose required letters it holds.

Nearly every pattern contains a run of letters that each match must hold. The rules are indexed by one
trigram of that run, the names by all of theirs; what meets is tested for the whole run, and only then for the
pattern. Rules without such a run are tried on every name. The lowest rule number wins, as
in ``rule_company``, but the list does not become part of the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.operators.search import trigrams

#: Rules without required letters; they are tried on every name, so a list with more is refused.
UNINDEXED = 500
#: Rules that a list may have.
MAX_RULES = 200_000

_OPS = re._constants


def _runs(tree, fixed: list[str], open_run: str) -> str:
    """Collects runs of letters that every match holds; returns the run that is still open at the end."""
    run = open_run
    for op, arg in tree:
        if op is _OPS.LITERAL:
            run += chr(arg)
        elif op is _OPS.SUBPATTERN and not arg[1] & re.X:
            run = _runs(arg[3], fixed, run)
        elif op in (_OPS.AT, _OPS.ASSERT_NOT, _OPS.ASSERT):
            # Zero width: what stands on both sides is still adjacent.
            continue
        else:
            fixed.append(run)
            run = ""
            if op in (_OPS.MAX_REPEAT, _OPS.MIN_REPEAT, _OPS.POSSESSIVE_REPEAT) and arg[0] >= 1:
                fixed.append(_runs(arg[2], fixed, ""))
    return run


def required_letters(pattern: str) -> str | None:
    """The longest ASCII run, in lower case, that every text with a match of the pattern holds; None below three letters.

    A pattern that Python cannot read as Java does, or with options other than case, counts as one without.
    """
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & re.X or "\\Q" in pattern or "&&" in pattern:
        return None
    fixed: list[str] = []
    fixed.append(_runs(tree, fixed, ""))
    best = max((r for r in fixed if r.isascii()), key=len, default="")
    return best.lower() if len(best) >= 3 else None


def read_rules(rules: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """((rule_no, regex, company, letters) of the rules with required letters, (rule_no, regex, company) of the others in order).

    A rule list is a code list: its patterns are read on the driver, behind a check of their number.
    """
    rows = rules.select("rule_no", "pattern", "company", F.coalesce("exact_case", F.lit(False)).alias("exact")).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} company rules")
    read = [(r["rule_no"], r["pattern"] if r["exact"] else f"(?i){r['pattern']}", r["company"], required_letters(r["pattern"])) for r in rows]
    always = sorted(r[:3] for r in read if r[3] is None)
    if len(always) > UNINDEXED:
        raise ValueError(f"more than {UNINDEXED} rules without three letters that each match holds")
    schema = f"rule_no {rules.schema['rule_no'].dataType.simpleString()}, regex string, company string, letters string"
    return rules.sparkSession.createDataFrame([r for r in read if r[3] is not None], schema), always


def by_rules(names: DataFrame, rules: DataFrame, column: str = "name") -> DataFrame:
    """(column, rule_no, company) of every distinct name that a rule matches, by the rule of the lowest number.

    Null names match none.
    """
    read, always = read_rules(rules)
    own = names.select(F.col(column).alias("text")).filter("text is not null").distinct()
    pieces = own.select("text", F.explode(trigrams(F.col("text"))).alias("piece"))
    # Each rule stands under the trigram of its letters that the fewest names hold.
    parts = read.select("*", F.explode(trigrams(F.col("letters"))).alias("piece"))
    counts = pieces.join(parts.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    best = parts.join(counts, "piece").groupBy("rule_no", "regex", "company", "letters").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    met = pieces.join(best, "piece").filter(F.contains(F.lower("text"), F.col("letters")))
    hits = met.filter(F.rlike("text", F.col("regex"))).select("text", F.struct("rule_no", "company").alias("hit"))
    if always:
        kind = read.schema["rule_no"].dataType
        tests = [F.when(F.col("text").rlike(regex), F.struct(F.lit(n).cast(kind).alias("rule_no"), F.lit(company).alias("company"))) for n, regex, company in always]
        hits = hits.unionByName(own.select("text", F.coalesce(*tests).alias("hit")).filter("hit is not null"))
    first = hits.groupBy("text").agg(F.min("hit").alias("first"))
    return first.select(F.col("text").alias(column), "first.rule_no", "first.company")
