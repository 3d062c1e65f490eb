"""Search by trigrams against a scan of all rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave import fixtures as X
from siteweave.operators import search
from siteweave.operators.filters import like_any_case
from siteweave.streaming.shelf import Shelf

SF = "/root/testdata/sf0.001"
ODD = [("o1", "100% Pure_Steel"), ("o2", "100 pure steel"), ("o3", "back\\slash WORKS"), ("o4", None), ("o5", ""), ("o6", "ab"), ("o7", "ÉCLAIR éclair"), ("o8", "KELVIN works")]
TERMS = ["anvil", "ANVIL", "n", "an", "Brand#1", "red%plant", "p_ant", "100\\%", "pure\\_s", "pure_steel", "back\\\\slash", "éclair", "kelvin", "works", "zzz", "zzzz%anvil", "%", "plant"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("search")
    rows = X.derive(spark, SF, X.FACILITIES).select("id", "name", "company_name")
    odd = spark.createDataFrame([(i, n, "x") for i, n in ODD], rows.schema)
    index = search.TextIndex(spark, str(folder / "index"), 8)
    index.add(rows, ["name", "company_name"], 0)
    index.add(odd, ["name", "company_name"], 1)
    kept = Shelf(spark, str(folder / "rows"), rows.schema, 8)
    for n, some in enumerate((rows, odd)):
        kept.write(some.withColumns({"kind": F.lit("row"), "key": F.col("id")}), n)
    return index, kept, rows.unionByName(odd).cache()


def test_like_a_scan(built):
    index, kept, rows = built
    for term in TERMS:
        want = sorted(r.id for r in rows.filter(like_any_case(F.col("name"), term) | like_any_case(F.col("company_name"), term)).collect())
        for table in (rows, kept):
            assert sorted(r.id for r in search.search(table, index, term, ["name", "company_name"]).collect()) == want, term


def test_few_rows_are_verified(built):
    index, _, rows = built
    for term in ("anvil", "Brand#12", "kelvin"):
        hits = rows.filter(like_any_case(F.col("name"), term) | like_any_case(F.col("company_name"), term)).count()
        assert hits <= index.candidates(term, ["name", "company_name"]).count() <= hits + 3
    assert index.candidates("zzzz", ["name"]).isEmpty() and index.candidates("a%b_c", ["name"]) is None


def test_changed_rows_are_found_by_their_new_text(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
    index, kept = search.TextIndex(spark, str(tmp_path / "i"), 4), Shelf(spark, str(tmp_path / "r"), schema, 4)
    for n, name in enumerate(("old name", "new words")):
        rows = spark.createDataFrame([("a", name)], schema)
        index.add(rows, ["name"], n)
        kept.write(rows.withColumns({"kind": F.lit("row"), "key": F.col("id")}), n)
    assert search.search(kept, index, "old name", ["name"]).isEmpty()
    assert search.search(kept, index, "new w", ["name"]).count() == 1
    assert search.search(kept, index, "old", ["name"], batch=1).count() == 1


def test_literals():
    assert search.literals(r"a\%b%c_d\\") == ["a%b", "c", "d\\"]
    assert search.term_trigrams("AbCd%xy") == ["abc", "bcd"]
