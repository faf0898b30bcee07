import pytest
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import places as P


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "clean", "key"),
    [
        ("  “Acme  Corp” ", "Acme Corp", "acme corp"),
        ("O’Neil – Co", "O’Neil – Co", "o'neil - co"),
        ("ＡＢＣ", "ABC", "abc"),
        ("Straße", "Straße", "strasse"),
        ("", "", ""),
    ],
)
def test_names(spark, name, clean, key):
    assert one(spark, name, text.clean_name) == clean
    assert one(spark, name, text.canonical_key) == key


def test_keys_of_companies(spark):
    for name, key in (("Acme Holdings, Inc.", "acme"), ("Company Group", "company"), ("Alphabet Inc", "alphabet"), ("Inc", "inc")):
        assert one(spark, name, text.company_alias_key) == key
    pairs = spark.createDataFrame([("Alphabet Inc.", "Alphabet"), ("Micro", "Microsoft Corp"), ("Meta", "Metallica"), ("Acme", "Other")], "a string, b string")
    assert [r[0] for r in pairs.select(text.companies_compatible(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_slug_title_softmax(spark):
    assert one(spark, "Crédit & Söhne  AG", text.slug) == "credit_sohne_ag"
    assert one(spark, "—", text.slug) == "company"
    assert one(spark, "walmart-u.s. 10k", text.title) == "Walmart-U.S. 10K"
    assert one(spark, "big_acme_10k", text.company_from_stem) == "Big Acme"
    row = spark.sql("select array(1D, 1D, 1D) as l").select(text.softmax(F.col("l"))).first()[0]
    assert row == pytest.approx([1 / 3] * 3)


@pytest.fixture(scope="module")
def here(spark):
    return P.default_places(spark)


def test_default_hierarchy(here):
    for alias, place in (("U.S.", "United States"), ("asia-pacific", "Asia Pacific"), ("global", "Worldwide"), ("Czechia", "Czech Republic"), ("Washington, DC", "District of Columbia")):
        assert here.normalize(alias) == place
    for asked, has, match in (("Italy", "Italy", "exact"), ("Europe", "Italy", "narrower_place"), ("Italy", "Europe", "broader_region"), ("Japan", "Italy", None)):
        assert here.classify(asked, has) == match
    assert {"Western Europe", "European Union", "EMEA", "Worldwide"} <= set(here.ancestors("Italy"))
    assert {"United States", "Europe"} <= set(here.ancestors("Georgia"))
    assert {"Vietnam", "Singapore"} <= set(here.descendants("Southeast Asia"))
    assert [r[0] for r in here.query_properties(["U.S.", "United States", "Italy"])] == ["Italy", "United States"]
    for country in ("Japan", "Brazil", "Nigeria", "South Korea", "United Arab Emirates", "United Kingdom", "Cote d'Ivoire", "Mexico", "Republic of the Congo", "Democratic Republic of the Congo", "Turkey", "Trinidad and Tobago", "Myanmar", "Vatican City", "Palestine", "Sao Tome and Principe", "Saint Vincent and the Grenadines", "Micronesia"):
        assert here.known(country), country
    assert not here.known("Hong Kong") and len(here.parents) == 17 + 245
    assert set(here.parents["Iran"]) == {"Middle East", "EMEA"} and set(here.parents["Latvia"]) == {"Europe", "Eastern Europe", "EMEA", "European Union"}


def test_cycles_end():
    p = P.Places([("a", "b"), ("b", "c"), ("c", "a")])
    assert p.ancestors("a") == ["b", "c"]


def test_company_matches(spark, here):
    operates = spark.createDataFrame([("x", "Italy"), ("y", "Europe"), ("z", "Japan"), ("x", "EMEA")], "company string, place string")
    rows = P.company_matches(operates, here.dimension(spark), ["Europe"]).collect()
    assert [(r.company, r.geography_match) for r in rows] == [("y", "exact"), ("x", "narrower_place")]
