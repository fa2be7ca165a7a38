"""Every outcome of putting a citation together from two records."""

import pytest
from citemill.operators import assembly as A
from citemill.plans import assembled as plan
from citemill.sources import xml_records as X

CITE = f"pmid string, doi string, authors {A.AUTHORS}, title string"
ARTICLE = f"pmcid string, doi string, authors {A.AUTHORS}, co_first array<int>, co_senior array<int>"


def person(position, last, fore="", initials="", blocks=(), orcid=""):
    return (position, last, fore, initials, list(blocks), orcid)


@pytest.fixture(scope="module")
def assembled(spark):
    ids = spark.createDataFrame([(p, f"PMC{p}", 1) for p in "12345678"] + [("1", "PMC1", 2), ("2", "PMCold", 0), ("9", "PMC9", 1)], "pmid string, pmcid string, ord int")
    lee, two = person(1, "Lee", "Ann B", "AB", ["Lab A"], "0000-0001-0000-0001"), person(2, "Roe", "Cy", "C", ["Lab B"])
    cites = [
        ("1", "10.1/a", [lee, two], "t"),  # names reconciled, affiliation filled
        ("2", None, [lee, person(2, "Roe", "Cy", "C")], "t"),  # no surname in the full text
        ("3", "", [lee], "t"),  # other count, doi of the full text, other person keeps none
        ("4", None, [lee], "t"),  # failed, no doi
        ("5", "10.1/e", [lee], "t"),  # not there
        ("6", "10.1/f", None, "t"),  # no authors in the index
        ("7", None, [person(1, "Lee"), person(3, "Roe", "", "", [" B ", "", "B"])], "t"),  # a gap, no authors in the full text
        ("8", "10.1/h", [], "t"),
        ("9", None, [two, lee], "t"),  # mapping failed
        ("10", None, [lee], "t"),  # no full text
        (None, None, [lee], "t"),
    ]
    articles = [
        ("PMC1", "10.9/x", [person(1, "Bo Lee", "Ann", "AB", ["Text A"]), person(2, "Roe", "Cyd", "C")], [1], None),
        ("PMC2", "10.9/y", [person(1, " ", "Ann", "A", ["Text A"]), person(2, "", "", "", ["Text B", "Text B"])], None, [2]),
        ("PMC3", "10.9/z", [person(1, "Low", "Kim", "K"), person(2, "New", "Al", "A")], [], []),
        ("PMC6", None, [person(1, "Only", "In", "I")], [], []),
        ("PMC7", None, [], [], []),
        ("PMC8", None, None, [], []),
        ("PMC9", "10.9/i", [person(1, "Never")], [], []),
    ]
    failures = spark.createDataFrame([("PMC4", "HTTPError: 502"), ("PMC4", "timeout")], "pmcid string, error string")
    unmapped = spark.createDataFrame([("9", "503")], "pmid string, error string")
    rows = A.citations(spark.createDataFrame(cites, CITE), ids, spark.createDataFrame(articles, ARTICLE), failures, unmapped).collect()
    return {r.pmid: r for r in rows}


def authors(row):
    return [(a.position, a.last_name, a.fore_name, a.initials, a.blocks, a.orcid) for a in row.authors]


def test_full_text_authors_replace(assembled):
    r = assembled["1"]
    assert authors(r) == [(1, "Lee", "Ann B", "AB", ["Text A"], "0000-0001-0000-0001"), (2, "Roe", "Cyd", "C", ["Lab B"], "")]
    assert (r.pmcid, r.doi, r.source_for_roles, r.co_first, r.co_senior, r.author_count, r.title) == ("PMC1", "10.1/a", "pmc", [1], [], 2, "t")
    assert r.notes == ["Author metadata sourced from PMC", "Filled 1 affiliation(s) from PubMed fallback"]


def test_incomplete_full_text_fills(assembled):
    r = assembled["2"]
    assert authors(r) == [(1, "Lee", "Ann B", "AB", ["Lab A"], "0000-0001-0000-0001"), (2, "Roe", "Cy", "C", ["Text B"], "")]
    assert r.notes == ["Filled 1 affiliation(s) from PMC", "PMC author metadata incomplete; kept PubMed author list"]
    assert (r.doi, r.source_for_roles, r.co_senior) == ("10.9/y", "pmc", [2])


def test_counts_differ_and_other_person(assembled):
    r = assembled["3"]
    assert [a[1] for a in authors(r)] == ["Low", "New"] and all(a[4] == [] for a in authors(r)) and r.doi == "10.9/z"
    assert r.notes == ["PMC author count mismatch (PMC 2 vs PubMed 1)", "Author metadata sourced from PMC"]


def test_failures(assembled):
    assert assembled["4"].notes == ["PMC fetch/parse failed: HTTPError: 502", "DOI not found in PubMed/PMC metadata"]
    assert assembled["5"].notes == ["PMC fetch/parse failed: PMC XML unavailable for PMC5"]
    assert {assembled[p].source_for_roles for p in "45"} == {"pubmed"} and assembled["5"].author_count == 1
    assert assembled["9"].notes == ["PMCID mapping failed: 503", "No PMCID mapping"] and assembled["9"].pmcid is None
    assert [a[0] for a in authors(assembled["9"])] == [2, 1]  # an index's own order stays
    assert assembled["10"].notes == assembled[None].notes == ["No PMCID mapping"] and assembled["10"].doi is None


def test_missing_author_lists(assembled):
    assert assembled["6"].author_count == 1 and assembled["6"].notes[0] == "PMC author count mismatch (PMC 1 vs PubMed 0)"
    r = assembled["7"]
    assert authors(r) == [(1, "Lee", "", "", [], ""), (3, "Roe", "", "", ["B"], "")] and r.source_for_roles == "pmc"
    assert r.notes == ["PMC author metadata incomplete; kept PubMed author list", "DOI not found in PubMed/PMC metadata"]
    assert assembled["8"].author_count == 0 and assembled["8"].notes == ["PMC author metadata incomplete; kept PubMed author list"]


def test_author_rows_and_empty_tables(spark, assembled):
    none = lambda schema: spark.createDataFrame([], schema)
    cites = spark.createDataFrame([("1", None, [person(2, "A"), person(5, "B", blocks=["x", "y"])], "t")], CITE)
    found = A.citations(cites, none("pmid string, pmcid string, ord int"), none(ARTICLE))
    assert [(r.author_ord, r.position, r.affiliation) for r in A.author_rows(found).orderBy("author_ord").collect()] == [(1, 2, ""), (2, 5, "x; y")]
    assert A.citations(cites.limit(0), none("pmid string, pmcid string, ord int"), none(ARTICLE)).count() == 0


def test_thousands_of_authors(spark):
    many = [person(k, f"Name{k}", "Al", "A") for k in range(1, 4001)]
    cites = spark.createDataFrame([("1", "d", many, "t")], CITE)
    articles = spark.createDataFrame([("PMC1", "d", [person(k, f"Name{k}", "Al", "A", [f"Lab {k}"]) for k in range(1, 4001)], [], [])], ARTICLE)
    row = A.citations(cites, spark.createDataFrame([("1", "PMC1", 1)], "pmid string, pmcid string, ord int"), articles).first()
    assert row.author_count == 4000 and row.authors[3999].blocks == ["Lab 4000"] and row.notes == ["Author metadata sourced from PMC"]


def test_documents_to_records(spark):
    article = """<article><front><article-meta><article-id pub-id-type="pmcid">7</article-id><contrib-group>
      <contrib contrib-type="author"><name><surname>One</surname><given-names>A</given-names></name><xref ref-type="fn" rid="n"/></contrib>
      <contrib contrib-type="author"><name><surname>Two</surname></name><xref ref-type="fn" rid="n"/></contrib>
      <contrib contrib-type="author"><name><surname>Six</surname></name></contrib></contrib-group>
      <author-notes><fn id="n"><p>Contributed equally.</p></fn></author-notes></article-meta></front></article>"""
    (r,) = A.full_texts(X.pmc(spark.createDataFrame([(article,)], "document string"))).collect()
    assert (r.pmcid, r.co_first, r.co_senior, [a.last_name for a in r.authors]) == ("PMC7", [1, 2], [], ["One", "Two", "Six"])
    index = "<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><AuthorList><Author><LastName>One</LastName></Author><Author><LastName>Two</LastName></Author></AuthorList><Affiliation>Home</Affiliation></Article></MedlineCitation></PubmedArticle>"
    (r,) = A.index_records(X.pubmed(spark.createDataFrame([(index,)], "document string"))).collect()
    assert [a.blocks for a in r.authors] == [["Home"], ["Home"]]


def test_full_text_that_lists_nobody_is_read(spark):
    full = plan._full_texts(spark, "/root/testdata/sf0.01").where("size(authors) = 0").select("pmcid", "co_first").collect()
    assert full and all(r.pmcid.endswith("2") and r.co_first == [1] for r in full)
    rows = spark.createDataFrame([("PMC1", *person(2, "Lee"), False), ("PMC2", *person(2, "Roe"), True), ("PMC2", *person(1, "Poe"), False)], "pmcid string, position int, last_name string, fore_name string, initials string, blocks array<string>, orcid string, listed boolean")
    lists = {r.pmcid: [a.last_name for a in r.authors] for r in A.author_list(rows, "pmcid", rows.listed).collect()}
    assert lists == {"PMC1": [], "PMC2": ["Roe"]}


def test_names_and_blocks_are_judged_once_an_author(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    plan = A.citations(none(CITE), none("pmid string, pmcid string, ord int"), none(ARTICLE))._jdf.queryExecution().analyzed().toString().lower()
    # inside lambdas every place is evaluated: the judgement of names stood in 16 places, the tidying of blocks in 12
    assert (plan.count("endswith"), plan.count("startswith"), plan.count("array_distinct")) == (1, 1, 4)


def test_full_texts_are_read_in_their_own_row(spark):
    """Contributors and notes went through shuffles of their own before, and a full text that came twice got its authors twice."""
    person = lambda last: f"<contrib contrib-type='author'><name><surname>{last}</surname></name><xref ref-type='fn' rid='n m'/></contrib>"
    article = f"<article><front><article-meta><article-id pub-id-type='pmc'>7</article-id><contrib-group>{person('One')}{person('Two')}<contrib><name><surname>Six</surname></name></contrib></contrib-group><author-notes><fn id='n'><p>Contributed  Equally</p></fn><fn id='m'><p>Division of Maps</p></fn></author-notes></article-meta></front></article>"
    empty = "<article><front><article-meta><article-id pub-id-type='pmc'>8</article-id></article-meta></front></article>"
    found = A.full_texts(X.pmc(spark.createDataFrame([(article,), (article,), (empty,)], "document string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1
    rows = [(r.pmcid, [(a.position, a.last_name, a.blocks) for a in r.authors], r.co_first, r.co_senior) for r in found.collect()]
    once = ("PMC7", [(1, "One", ["Division of Maps"]), (2, "Two", ["Division of Maps"]), (3, "Six", [])], [1, 2], [])
    assert rows == [once, once, ("PMC8", [], [], [])]
