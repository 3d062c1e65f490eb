"""Landed files, as the sources publish them, through the readers."""

import json

from siteweave.sources import common
from siteweave.operators.companies import match_tickers
from siteweave.sources import curated, federal


def test_echo(spark, tmp_path):
    (tmp_path / "echo.csv").write_text(
        "REGISTRY_ID,FAC_NAME,FAC_STREET,FAC_CITY,FAC_STATE,FAC_ZIP,EXTRA,FAC_NAICS_CODES,FAC_SIC_CODES,FAC_LAT,FAC_LONG\n"
        '0011,"ACME, ""A"" WORKS",1 ELM ST,WACO,TX,07701,x,"541330 332710",3499 1,30.1,-97\n'
        "0012,10218 TOLUCA LLC,2 ELM ST,WACO,TX,07702,x,332710,,,\n"
        "0013,OFFICE,3 ELM ST,WACO,TX,07703,x,541330,,,\n"
    )
    (row,) = federal.read_echo(spark, str(tmp_path / "echo.csv"), "run1").collect()
    assert (row.source_record_id, row.raw_name, row.raw_zip) == ("0011", 'ACME, "A" WORKS', "07701")
    assert (row.raw_naics_code, row.raw_sic_code, row.raw_county, row.source_run_id) == ("541330", "3499", None, "run1")


def test_tri(spark, tmp_path):
    base = {"facility_name": "ACME", "state_abbr": "TX", "zip_code": "01234", "epa_registry_id": 1100}
    rows = [
        {**base, "tri_facility_id": "T1", "pref_latitude": 30.5, "pref_longitude": 97.5},
        {**base, "tri_facility_id": "T1", "facility_name": "LATER"},
        {**base, "tri_facility_id": "T2", "pref_longitude": -97.5}, {**base, "tri_facility_id": None},
        {**base, "tri_facility_id": "T3", "facility_name": "ARM TRUCKING"},
    ]
    (tmp_path / "p1.json").write_text(json.dumps(rows))
    got = {r.source_record_id: r for r in federal.read_tri(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["T1", "T2"]
    assert (got["T1"].raw_name, got["T1"].raw_longitude, got["T1"].registry_id, got["T1"].raw_zip) == ("ACME", "-97.5", "1100", "01234")


def test_osha(spark, tmp_path):
    (tmp_path / "osha.csv").write_text(
        "ACTIVITY_NR,ESTAB_NAME,SITE_CITY,SITE_STATE,SITE_ZIP,NAICS_CODE,SIC_CODE,NR_IN_ESTAB,OPEN_DATE\n"
        "1,Acme,Waco,TX,01234-5678-9,332710,,12,2020-01-01\n"
        "2,ACME,WACO,TX,01234,332710,,0,2021-01-01\n"
        "3,acme,waco,TX,01234,332710,,9,2021-01-01\n"
        ",Bolt,Waco,TX,01234,,2011,,2019-01-01\n"
        "5,Office,Waco,TX,01234,541330,,1,2020-01-01\n"
        "6,Far,Waco,TEX,01234,332710,,1,2020-01-01\n"
    )
    got = {r.raw_name: r for r in federal.read_osha(spark, str(tmp_path / "osha.csv")).collect()}
    assert sorted(got) == ["ACME", "Bolt"]
    assert (got["ACME"].source_record_id, got["ACME"].osha_employee_count) == ("2", None)
    assert (got["Bolt"].source_record_id, got["Bolt"].raw_naics_code) == ("osha_Bolt_TX_Waco", "311")


def test_fsis(spark, tmp_path):
    (tmp_path / "fsis.csv").write_text(
        "EST_NUMBER,COMPANY,DBA,State,Activities,Size\n"
        "M1,,Bolt Meats,tx,Meat Processing,Very Small\n"
        "M1,Other,,TX,Processing,Large\n"
        "M1,Other,,TX,Poultry,Large\n"
        "M2,,,TX,,large\n"
        "M3,Foo,,Texas,,\n"
    )
    got = {r.source_record_id: r for r in federal.read_fsis(spark, str(tmp_path / "fsis.csv")).collect()}
    assert sorted(got) == ["FSIS-M1", "FSIS-M2"]
    one = got["FSIS-M1"]
    assert (one.raw_name, one.fsis_activities, one.raw_naics_code, one.raw_state) == ("Bolt Meats", "Meat Processing, Poultry", "311615", "TX")
    assert (got["FSIS-M2"].raw_name, got["FSIS-M2"].fsis_size_category) == ("FSIS Est. M2", "Large")


def test_nhtsa(spark, tmp_path):
    listing = [
        {"Mfr_ID": 1, "Mfr_Name": "ACME MOTORS", "Mfr_CommonName": "Acme", "Country": "UNITED STATES (USA)"},
        {"Mfr_ID": 1, "Mfr_Name": "AGAIN", "Country": "USA"}, {"Mfr_ID": 2, "Mfr_Name": "FOO", "Country": "CANADA"},
        {"Mfr_ID": 3, "Mfr_Name": "BOLT"}, {"Mfr_ID": 4, "Country": "US"},
    ]
    detail = [{"Mfr_ID": 3, "Mfr_Name": "BOLT CO", "StateProvince": "Ohio", "Address": "1 Elm", "Address2": "Dock 2",
               "VehicleTypes": [{"IsPrimary": True, "Name": "Trailer"}]}]
    (tmp_path / "list.json").write_text(json.dumps(listing))
    (tmp_path / "detail.json").write_text(json.dumps(detail))
    rows = federal.read_nhtsa(spark, str(tmp_path / "list.json"), str(tmp_path / "detail.json")).collect()
    got = {r.nhtsa_mfr_id: r for r in rows}
    assert sorted(got) == ["1", "3"]
    assert (got["1"].raw_name, got["1"].raw_naics_code) == ("Acme", "336110")
    assert (got["3"].raw_address, got["3"].raw_state, got["3"].raw_naics_code) == ("1 Elm, Dock 2", "OH", "336212")


def test_census(spark, tmp_path):
    page = [["NAICS2017", "NAICS2017_LABEL", "ESTAB", "PAYANN", "EMP", "state", "county"],
            ["31-33", "Manufacturing", "1,234", "S", "5", "48", "001"], ["31-33", "Manufacturing", "D", "1", "1", "48", "003"]]
    (tmp_path / "48.json").write_text(json.dumps(page))
    (row,) = federal.read_census(spark, str(tmp_path)).collect()
    assert (row.source_record_id, row.raw_state, row.raw_naics_code) == ("cbp_48001_3133", "TX", "31")
    assert (row.census_establishment_count, row.census_annual_payroll, row.census_employees) == (1234, 0, 5)


def test_seed_lists_and_tickers(spark, tmp_path):
    (tmp_path / "seed.csv").write_text(
        "Company,Description,LAT,LONG,Address,City,State,Country\nAcme Inc,Acme Plant,30,-97,1 Elm,Waco,Texas,US\n"
        "Acme Inc,Acme Yard,,,2 Elm,Waco,TX,US\nCompany,Description,,,,,,\n")
    store = curated.read_seed(spark, str(tmp_path / "seed.csv"))
    assert sorted((r.name, r.company_name, r.state, r.confidence) for r in store["facilities"].collect()) == [
        ("Acme Plant", "Acme", "TX", 85), ("Acme Yard", "Acme", "TX", 60)]
    (company,) = store["companies"].collect()
    assert (company.name, company.facility_count) == ("Acme", 2)
    assert store["facility_sources"].join(store["facilities"].withColumnRenamed("id", "facility_id"), "facility_id").count() == 2

    (tmp_path / "list.csv").write_text(
        "company_name,industry,primary_naics,tx_factory_count\nACME INC,A,,1\nBOLT LLC,B,332710,7 sites\nBolt,C,1,2\n")
    (row,) = curated.read_company_list(spark, str(tmp_path / "list.csv"), store["companies"]).collect()
    assert (row.name, row.sector, row.naics_codes, row.facility_count) == ("Bolt", "B", '["332710"]', 7)

    (tmp_path / "factories.csv").write_text("epa_registry_id,factory_name,state,zip\n11,One,,07701\n12,Two,OK,\n,Three,,\n13, ,,\n")
    known = curated.read_factories(spark, str(tmp_path / "factories.csv")).filter("registry_id = '11'")
    rows = curated.read_factories(spark, str(tmp_path / "factories.csv"), known).collect()
    assert sorted((r.raw_name, r.raw_state) for r in rows) == [("Three", "TX"), ("Two", "OK")]

    (tmp_path / "tickers.json").write_text(json.dumps(
        {"fields": ["cik", "name", "ticker", "exchange"], "data": [[7, "ACME INC", "ACM", "NYSE"], [8, "Acme Corp", "ACX", "N"]]}))
    (hit,) = match_tickers(store["companies"], curated.read_tickers(spark, str(tmp_path / "tickers.json"))).collect()
    assert (hit.ticker, hit.cik, hit.exchange) == ("ACM", "0000000007", "NYSE")

    (tmp_path / "cross.csv").write_text("naicsCode,naicsTitle,sicCode,sicDesc\n311111,Dog Food,47,Pets\n31x,Bad,2011,Bad\n")
    (pair,) = curated.read_crosswalk(spark, str(tmp_path / "cross.csv")).collect()
    assert (pair.sic_code, pair.naics_code) == ("0047", "311111")


def test_file_order_over_many_files(spark, tmp_path):
    """The first row wins in file order, not in task order."""
    for i in range(12):
        (tmp_path / f"p{i:02d}.json").write_text(json.dumps([{"tri_facility_id": "T1", "facility_name": f"N{i}"}]))
    (row,) = federal.read_tri(spark, str(tmp_path)).collect()
    assert row.raw_name == "N0"


def test_csv_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('activity_nr,estab_name\n1,"ACME ""X""\nPLANT"\n2,FOO\n')
    (tmp_path / "c.csv").write_text("ESTAB_NAME,ACTIVITY_NR\nBAR,3\nBAZ\n")
    rows = common.read_csv(spark, str(tmp_path))
    name, number = (common.any_of(rows, n, n.upper()) for n in ("estab_name", "activity_nr"))
    assert sorted(map(tuple, rows.select(name, number).collect()), key=str) == [('ACME "X"\nPLANT', "1"), ("BAR", "3"), ("BAZ", None), ("FOO", "2")]
    counts = {r.file.rsplit("/", 1)[1]: r.malformed for r in common.malformed_rows(rows).collect()}
    assert counts == {"a%20b.csv": 0, "c.csv": 1}
