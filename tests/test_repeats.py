"""Texts that many rows repeat are worked on once; rows keep their own results."""

from pyspark.sql import functions as F

from citemill.functions import affiliation, names
from citemill.operators import identity, organizations
from citemill.plans import publication
from citemill.sources import bibliography as view

ORGS = "ord int, name string, country string, identifier string"


def test_text_matches_judge_each_text_once(spark):
    orgs = organizations.organizations(spark.createDataFrame([(1, "Harbor Willow Hospital", "us", ""), (2, "Tarland Medical School", "us", "")], ORGS))
    texts = ["Harbor Willow Hospital; Oz", "Dept, Tarland Medical School of Oz", "Harbor Willow Hospitol", "Nowhere", None]
    rows = spark.createDataFrame([(i, texts[i % 5]) for i in range(50)], "id int, affiliation string")
    got = {r.affiliation: (r.level, r.institution) for r in organizations.text_matches(rows, orgs).collect()}
    own = rows.select("id", F.lit(0).alias("affiliation_ord"), "affiliation", F.posexplode(organizations.phrases(F.col("affiliation"))).alias("name_ord", "name"))
    want = {texts[r.id % 5]: (r.level, r.institution) for r in organizations.affiliation_matches(own, orgs).collect()}
    assert got == want and [got[t][0] for t in texts[:3]] == ["likely", "contains", "possible"]
    assert organizations.text_matches(rows, orgs).count() == 3


def test_organisation_query_takes_no_author_apart(spark, sf_dir):
    found = publication.org_exact_contains_match(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_cleaned_authors_keep_their_own_blocks(spark):
    raw = [("1", 1, 1, "[2] A", ["[2] A", "B"]), ("2", 1, 1, "B", ["B"]), ("3", 2, 1, None, None), ("4", 2, 2, "B", []), ("5", 3, 1, "B", ["B", None, "[3] B"]), ("6", 3, 1, "[2] A", ["B"])]
    authors = spark.createDataFrame(raw, "pmid string, ord int, position int, affiliation string, blocks array<string>")
    got = {r.pmid: (r.affiliation, r.blocks, r.changed) for r in affiliation.clean_affiliations(authors).collect()}
    # authors of one place (1 and 2, 5 and 6) got each other's blocks before
    assert got["1"] == ("A", ["A", "B"], True) and got["2"] == ("B", ["B"], False)
    assert got["3"][:2] == (None, []) and got["4"] == ("B", [], False)
    assert got["5"][:2] == ("B", ["B"]) and got["6"] == ("A", ["B"], True)


def test_authors_bring_surname_keys_and_lines_are_sorted_once(spark, sf_dir):
    authors = view.authors(spark, sf_dir)
    assert authors.where(~F.col("surname_keys").eqNullSafe(names.surname_keys(F.col("last_name")))).count() == 0
    wanted = identity.targets(spark, {"t": publication.KNOWN, "s": publication.SHORT})
    with_keys, without = identity.mentions(authors, wanted), identity.mentions(authors.drop("surname_keys"), wanted)
    assert with_keys.columns == without.columns and with_keys.exceptAll(without).count() == without.exceptAll(with_keys).count() == 0 < with_keys.count()
    assert "WindowGroupLimit" not in authors._jdf.queryExecution().optimizedPlan().toString()


def test_report_counts_all_authors_of_its_citations(spark, sf_dir):
    counts = {r.pmid: r.author_count for r in publication._cites(spark, sf_dir).collect()}
    rows = publication.target_rows(spark, sf_dir, publication.SHORT).collect()
    assert rows and all(r.author_count == counts[r.pmid] for r in rows)
