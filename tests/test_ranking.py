import glob
import random

import pytest
from citemill.operators import analysis, organizations, ranking
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture
def many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_places_equal_those_of_a_window(spark, many_files):
    rng = random.Random(3)
    rows = [(rng.choices(["hot", "b", None, ""], [30, 2, 1, 1])[0], rng.choice([None, 1990, 1991]), rng.choice("aBc"), k) for k in range(900)]
    made = spark.createDataFrame(rows, "who string, print_year int, journal string, ord long").repartition(4)
    order = [F.col("print_year").isNull(), F.desc("print_year"), F.lower("journal"), F.col("ord")]
    for by in (("who",), ()):
        window = Window.partitionBy(*(by or (F.lit(0),))).orderBy(*order)
        want = {r.ord: r.idx for r in made.select("ord", (F.row_number().over(window) - 1).alias("idx")).collect()}
        found = analysis.report_order(made, by)
        assert {r.ord: r.idx for r in found.collect()} == want and found.columns == [*made.columns, "idx"]
    assert len(glob.glob(f"{vars(spark)['_citemill_places'][-2].removeprefix('file:')}/*.parquet")) > 5  # the sorted rows lie in many files
    assert ranking.numbered(made.limit(0), ("who",), ["ord"]).count() == 0


def test_bound_on_likeness_is_exact(spark):
    """No pair that difflib finds alike is held back, and few others reach it."""
    from difflib import SequenceMatcher

    rng = random.Random(8)
    words = ["institute", "academy", "of", "national", "ocean", "studies", "geology", "arts", "7"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)]
    names += ["".join(rng.sample(n, len(n))).strip() for n in names[:20]] + [n[:-1] for n in names[:20]] + [n.replace("a", "e", 1) for n in names[:20]]
    names = sorted({" ".join(n.split()) for n in names} - {""})
    side = spark.createDataFrame([(n,) for n in names], "s string").withColumn("l", organizations.letter_counts(F.col("s")))
    pairs = side.select(F.col("s").alias("inst_signature"), F.col("l").alias("inst_letters")).crossJoin(side.select(F.col("s").alias("o_signature"), F.col("l").alias("o_letters")))
    asked = {(r.inst_signature, r.o_signature) for r in organizations.possibly_alike(pairs).collect()}
    alike = {(a, b) for a in names for b in names if SequenceMatcher(a=a, b=b).ratio() >= 0.9}
    assert alike <= asked and len(asked) < len(names) ** 2 / 10


def test_similar_names_equal_difflib(spark):
    from difflib import SequenceMatcher

    names = ["National Acadmy of Sciences", "Harbor Institute of Oceanograhpy", "Royal Museum of Arts", "Sciences Harbor"]
    orgs = [(0, "National Academy of Sciences", "", ""), (1, "Harbor Institute of Oceanography", "", ""), (2, "Museum of Royal Arts", "", "")]
    table = organizations.organizations(spark.createDataFrame(orgs, "ord int, name string, country string, identifier string"))
    found = {(r.name, r.o_name, round(r.ratio, 6)) for r in organizations.candidates(spark.createDataFrame([(n,) for n in names], "name string"), table).where("tier = 'similar'").collect()}
    want = {(n, o, round(r, 6)) for n in names for _, o, *_ in orgs if (r := SequenceMatcher(a=n.lower(), b=o.lower()).ratio()) >= 0.9}
    assert found == want and len(found) == 2


def test_keys_of_the_first_resolved_institution(spark):
    registry = spark.createDataFrame([("text", "harborinstitute", "Harbor Institute of Seas"), ("text", "institutharbor", "Harbor Institute of Seas")], "kind string, key string, canonical string")
    raw = spark.createDataFrame([(1, " Harbor  Institute", "us", ""), (2, "Institut Harbor", "US", ""), (3, "Nameless Club", "us", ""), (4, "", "us", "")], "ord int, name string, country string, identifier string")
    found = {r.ord: (r.name, r.key) for r in organizations.organizations(raw, registry).collect()}
    assert found == {1: ("Harbor Institute", "harborinstituteofseas"), 3: ("Nameless Club", "namelessclub")}
    assert sorted(r.key for r in organizations.organizations(raw).collect()) == ["harborinstitute", "institutharbor", "namelessclub"]


def test_badges(spark):
    from datetime import date

    from citemill.operators import badges

    assert badges.year_options(date(1952, 5, 1)) == [1952, 1951, 1950]
    weak = spark.createDataFrame([(False, " Contains "), (True, "contains"), (False, "likely")], "m boolean, l string").select(badges.badge_class(F.col("m"), F.col("l")).alias("c"))
    assert [r.c for r in weak.collect()] == [badges.WEAK, badges.BADGE, badges.BADGE]
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string")
    ids = spark.createDataFrame([("1", ["doi", "pmid"])], "pmid string, kinds array<string>")
    places = spark.createDataFrame([("2", "Likely", "X", "")], "pmid string, level string, institution string, label string")
    found = {r.pmid: (r.badge_show, r.badge_title, r.record_url, r.affiliation_verified) for r in badges.record_fields(rows, ids, places, "").collect()}
    assert found == {"1": (True, "Citation added from ORCiD record (matched by DOI/PMID)", None, False), "2": (False, "ORCiD affiliation likely match", None, False), "3": (False, "ORCiD match", None, False)}
