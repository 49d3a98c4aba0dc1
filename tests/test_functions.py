from pyspark.sql import functions as F

from tessera.functions import ids, names, nested, text


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("x")).first()["x"]


def test_clean_text(spark):
    c = F.col("t")
    clean = lambda t: one(spark, text.clean_text(c), t=t)
    assert clean("<p>A &amp; B</p>  &eacute;t&#233;") == "A & B été"
    assert clean("see https://x.org/a now") == "see now"
    assert clean("mail me@x.ac.uk please") == "mail please"
    assert clean("[link][1] text [1]: http") == "text"
    assert clean("*** -- !!") is None
    assert clean("") is None
    assert clean("&unknown; stays") == "&unknown; stays"
    assert clean("itâ€™s") == "it's"
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) is None


def test_placeholders(spark):
    c = F.col("t")
    for t in ("N/A", "n.a.", " ", "TBC", "None", "Not provided"):
        assert one(spark, text.null_placeholders(c), t=t) is None
    assert one(spark, text.null_placeholders(c), t="Abstract A study") == "A study"


def test_comparison_keys(spark):
    c = F.col("t")
    assert one(spark, text.comparison_key(c, "journal"), t="Nature & Science (London): part - two") == "nature and science"
    assert one(spark, text.comparison_key(c, "doi"), t=" 10.1/ A ") == "10.1/a"
    assert one(spark, text.comparison_key(c, "organisation"), t="B; A (UK); B") == ["a", "b"]
    assert one(spark, text.comparison_key(c, "title"), t="Ｆｕｌｌ–width, Title!") == "fullwidth title"


def test_organisations(spark):
    c = F.col("t")
    assert one(spark, text.organisation_key(c), t="The Université of Hull") == "universite hull"
    assert one(spark, text.company_key(c), t="TATA STEEL U.K. P.L.C.") == "tata steel"
    assert one(spark, text.organisation_type(c), t="University Hospital Leeds") == "healthcare"
    assert one(spark, text.organisation_type(c), t="CITY CENTRE CONTAINERS CO.LIMITED") == "company"
    assert one(spark, text.slug(c), t="***") == "unnamed"


def test_screening(spark):
    rows = [("a circular economy",), ("refurbished virgin materials",), ("refurbish and recycle",), ("recycling reuse",), (None,)]
    df = text.screen(spark.createDataFrame(rows, "t string"), "t")
    assert [r["decision"] for r in df.collect()] == ["keep", "keep", "keep", "drop", "drop"]


def test_ids(spark):
    c = F.col("t")
    assert one(spark, ids.issn_list(c), t="1234567x and 1234-567X; 99999-9999 00011112") == "1234-567X; 0001-1112"
    assert one(spark, ids.issn_list(c), t="none") is None
    assert one(spark, ids.native_id_key(c), t="000.0") == "0"
    assert one(spark, ids.native_id_key(c), t="0012.0") == "12"
    assert one(spark, ids.doi_key(c), t="https://doi.org/10.1/A ") == "10.1/a"
    assert one(spark, ids.strict_doi_key(c), t="11.1/a") is None
    assert one(spark, ids.doi_url(c), t="doi: 10.1/a") == "https://doi.org/10.1/a"
    assert one(spark, ids.extract_doi(c), t="x 10.1234/ab.c y") == "10.1234/ab.c"
    assert one(spark, ids.last_segment(c), t="https://x/y/Z1/") == "Z1"
    assert one(spark, ids.valid_year(c), t="2024.0") == "2024"
    assert one(spark, ids.valid_year(c), t="2101") is None
    assert one(spark, ids.year_list(c), t="1999; x, 2001.0") == ["1999", "2001"]


def test_times(spark):
    df = spark.createDataFrame([("2020-01-01", "2021-01-01", 5.0), ("2020-06-01", None, None)], "s string, e string, v double")
    a, b = ids.project_times(df, "s", "e", "v", "2020-07-01").collect()
    assert (a["start_year"], a["duration_months"], a["elapsed_months"], a["is_complete"], a["has_funding"]) == (2020, 12.0, 6.0, False, True)
    assert (b["duration_months"], b["elapsed_months"], b["has_funding"]) == (None, 1.0, False)


def test_tags(spark):
    got = one(spark, nested.weighted_tags(F.col("t")), t="A (x) (60%); B; ;C (2.5%)")
    assert [(r["subject"], r["weight"]) for r in got] == [("A (x)", 60.0), ("B", 100.0), ("C", 2.5)]
    assert one(spark, nested.weighted_tags(F.lit(None).cast("string"))) == []
    back = F.array(F.struct(F.lit("A").alias("subject"), F.lit(60.0).alias("weight")), F.struct(F.lit("B").alias("subject"), F.lit(0.0).alias("weight")))
    assert one(spark, nested.format_tags(back)) == "A (60%); B"


def test_flatten_project(spark):
    schema = (
        "id string, title string, abstractText string, techAbstractText string, potentialImpact string, status string, grantCategory string, leadFunder string, "
        "researchSubjects struct<researchSubject: array<struct<text: string, percentage: double>>>, researchTopics struct<researchTopic: array<struct<text: string, percentage: double>>>, "
        "identifiers struct<identifier: array<struct<type: string, value: string>>>, links struct<link: array<struct<href: string, rel: string, start: bigint, end: bigint>>>"
    )
    row = ("p", "T", None, None, None, None, None, None, ([("S", 100.0), ("Z", 0.0)],), None, ([("X", "1"), ("RCUK", "EP/1")],), ([("f", "FUND", 0, 86_400_000), ("l", "LEAD_ORG", None, None), ("q", "PARTICIPANT_ORG", None, None)],))
    got = nested.flatten_project(spark.createDataFrame([row], schema)).first()
    assert (got["grant_reference"], got["research_subjects"], got["start_date"], got["end_date"], got["lead_href"], got["participant_hrefs"]) == ("EP/1", "S (100%); Z", "1970-01-01", "1970-01-02", "l", ["q"])


def test_names(spark):
    c = F.col("t")
    assert one(spark, names.normalise_name(c), t="Jane Smith") == "Smith J"
    assert one(spark, names.normalise_name(c), t="Smith, J.") == "Smith J"
    assert one(spark, names.normalise_name(c), t="Ana Maria Lopez") == "Ana Maria Lopez"
    assert names.display_name(None, None, "SMITH-JONES, JA") == "Smith-Jones, J. A."
    assert names.display_name(None, None, "van der Berg M") == "van der Berg, M."
    assert names.display_name(None, None, "Dr Jane O'BRIEN") == "O'Brien, Jane"
    assert names.display_name(None, None, "真") == "真"
    assert names.comparison_key("Müller, Jörg") == "muller j"
    assert names.comparison_key("Prof Wei van der Berg") == "van der berg w"
    assert names.comparison_key(None) == ""
    assert [names.comparison_key(x) for x in ("Wang Li", "Sir Ang", "Prof Ang", "Zu Wang", "Ann St Clair", "Ann (Bo) Lee Jr", "Dr", "Lee, , Ann")] == ["wang l", "ang s", "ang", "wang z", "st clair a", "lee a", "", "lee ,"]
    given = {("", "Zhang", "Zhang Jianguo"): "Zhang, Jianguo", ("", "Patay-Horváth", "Patay-Horvath A."): "Patay-Horváth, A.", ("Ehecatl Antonio del", "Rio-Chanona", ""): "del Rio-Chanona, Ehecatl Antonio"}
    given |= {("ANN", "ST CLAIR", None): "St Clair, Ann", ("Jo", "ZU BERG", None): "zu Berg, Jo", ("Morgan", "-Green", None): "Green, Morgan", (None, None, "Hogg‐Johnson 2, S."): "Hogg-Johnson, S.", (None, None, "Mendoza J.M.F."): "Mendoza, J. M. F."}
    given |= {(None, None, "Dr"): "Dr", ("Y.C.", "LEE", None): "Lee, Y. C.", ("Ann Jr", "Lee", None): "Lee, Ann", (None, "Lee", "Kim Park"): "Lee", ("Al", "Lee", None): "Al Lee"}
    assert {k: names.display_name(*k) for k in given} == given
    assert [one(spark, names.normalise_name(c), t=x) for x in ("Dr Smith", "John Jr.", "Li Wang", "Wang Li")] == ["Dr Smith", "John Jr", "Wang L", "Wang Li"]
    from html import unescape

    odd = ["a&#150;b x", "&ampT &apos;q&apos; &lbrack;z&rbrack; w", "R&amp;D &notit; &#x110000; &#128; &nosuch; & alone", "plain", "caf&eacute &Eacute;t&eacute"]
    assert [one(spark, text.unescape_html(c), t=x) for x in odd] == [unescape(x) for x in odd]
    found = [one(spark, names.strip_identifiers(c), t=x) for x in ("Wooles, Ashley; id_orcid 0000–0001–7411–962x", "Louise S.; id_orcid 0000-0002-9451-3557 Natrajan", "Ann Lee;")]
    assert [tuple(x) for x in found] == [("Wooles, Ashley", "0000-0001-7411-962X"), ("Louise S. Natrajan", "0000-0002-9451-3557"), ("Ann Lee", None)]
    assert one(spark, names.completeness(c), t="Smith, J. A.") == "initials_only"
    assert one(spark, names.completeness(c), t="Smith, Jane") == "full_forename"
    assert one(spark, names.completeness(c), t="Smith") == "surname_only"
    assert one(spark, names.flags(c, c), t="Smith 2, 真") == "non_latin_script; digits_remain"
    assert one(spark, text.name_shape(c), t="Smith J.A.") == "surname + initials"


def test_days_of_late_years(spark):
    ms = [0, 253_402_300_799_000, 253_402_300_800_000, 518_400_000_000_000]
    df = spark.createDataFrame([(str(x) + ".0",) for x in ms] + [(None,)], "ms string")
    got = [r["d"] for r in df.select(text.day_text(text.to_timestamp_ms(F.col("ms"))).alias("d")).collect()]
    assert got == ["1970-01-01", "9999-12-31", "10000-01-01", "18397-06-11", None]
