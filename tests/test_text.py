import pytest
from citemill.functions import affiliation, institutions, names, text
from citemill.operators import resolve
from pyspark.sql import functions as F


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (text.token, "O'Neil-Smith 3", "oneilsmith3"),
        (text.squash, "  A  B\t c ", "a b c"),
        (text.country_key, "The U.S.A.", "usa"),
        (text.initials, "Mary-Jane K. de", "mjkd"),
        (text.institution_key, "Brigham & Women’s", "brighamandwomens"),
        (text.institution_label, "Texas A and M  University.,", "Texas A&M University"),
        (text.orcid, "https://orcid.org/0000-0001-2345-678x", "0000-0001-2345-678X"),
        (text.orcid, "000000012345678X", "0000-0001-2345-678X"),
        (text.orcid, "0000 0001 2345 6789", "0000-0001-2345-6789"),
        (text.orcid, "12", ""),
        (text.year, "Winter 2019-2020", 2019),
        (text.year, "Spring", None),
        (text.parsed_doi, "https://dx.doi.org/10.1/AbC", "10.1/AbC"),
        (text.record_doi, "doi: 10.1/AbC.", "10.1/abc"),
        (text.match_doi, " 10.1/AbC ", "10.1/abc"),
        (text.pmid, "PMID: 12", "12"),
        (text.pmcid, "pmc-77", "PMC77"),
        (text.pmcid, "77", "PMC77"),
        (text.pmcid_number, "PMC77", "77"),
        (text.pmids_in, "2468, 1357 and 2468", ["2468", "1357"]),
        (text.affiliation_blocks, "A; B | A;;", ["A", "B"]),
        (text.affiliation_blocks, None, []),
        (text.type_terms, "Letter, letter; News\n", ["letter", "news"]),
        (text.organization_signature, "Harvard & Med. School", "harvard and med school"),
        (text.organization_identifier, "https://ror.org/04b6nzv94/", "04b6nzv94"),
        (text.distinctive_tokens, "The University of NYU at 12 Yale ab", ["nyu", "yale"]),
    ],
)
def test_scalars(spark, function, value, want):
    assert one(spark, value, function) == want


def test_required_orcid(spark):
    assert one(spark, " ", text.required_orcid) == ""
    with pytest.raises(Exception, match="ORCID must be"):
        one(spark, "nope", text.required_orcid)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Lund J", ("lund", "j", "j", "initials")), ("Lund JS", ("lund", "js", "js", "initials")), ("Lund, J.", ("lund", "j", "j", "initials")),
        ("LuNd, jS", ("lund", "js", "js", "initials")), ("Lund, Josefa", ("lund", "josefa", "j", "full")), ("Lund, Josefa,", ("lund", "josefa", "j", "full")),
        ("Josefa Sigrid Lund", ("lund", "josefa sigrid", "js", "full")), ("JS Lund", ("lund", "js", "js", "initials")),
    ],
)
def test_targets(raw, want):
    t = names.parse_target(raw)
    assert (t.surname, t.given, t.initials, t.style) == want


@pytest.mark.parametrize("raw", ["", "Lund", "Lund,", " , "])
def test_targets_that_are_none(raw):
    with pytest.raises(ValueError):
        names.parse_target(raw)


@pytest.mark.parametrize(
    ("target", "orcid", "author", "want"),
    [
        ("Lund JS", "", ("Lund", "Josefa Sigrid", "JS", ""), "initials"),
        ("Sage PT", "", ("Sage", "Peter", "P", ""), "initials"),
        ("Wu, Hsin-Jung", "", ("Joyce Wu", "Hsin-Jung", "HJ", ""), "given"),
        ("Josefa Lund", "", ("Lund", "Jonas", "J", ""), None),
        ("Josefa Lund", "", ("Lund", "J", "J", ""), "initials"),
        ("Josefa Lund", "", ("Plund", "Josefa", "J", ""), None),
        ("Josefa Lund", "0000-0001-2345-6789", ("Lund", "Jonas", "J", "0000000123456789"), "orcid"),
        ("Josefa Lund", "0000-0001-2345-6789", ("Lund", "Josefa", "J", "0000-0001-2345-6780"), None),
        ("Josefa Lund", "", (None, None, None, None), None),
    ],
)
def test_matching(spark, target, orcid, author, want):
    t = names.parse_target(target, orcid)
    df = spark.createDataFrame([author], "last_name string, fore_name string, initials string, orcid string")
    columns = {c: F.col(c) for c in df.columns}
    wanted = {k: F.lit(getattr(t, k)) for k in ("surname", "given", "initials", "style", "orcid")}
    assert df.select(names.match_method(columns, wanted).alias("m")).first().m == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1Department of Surgery, and2 Department of Medicine, Alpha College, Rome", "Department of Surgery, Alpha College, Rome"),
        ("Department of X, Beta University, USA. 2 Department of Y, Gamma University", "Department of X, Beta University, USA"),
        ("[2] Department of Medicine", "Department of Medicine"),
        ("¹Department of Physics", "Department of Physics"),
        ("aHospital One; XWeill Two", "Hospital One; Weill Two"),
        ("12 E 70 th Street", "E 70th Street"),
        ("https://ror.org/03 zjqec80HSS Institute", "https://ror.org/03zjqec80 HSS Institute"),
        ("1grid.239915.50000 0001 2285 8823Hospital", "grid.239915.5 Hospital"),
        ("grid.38142.3c000000041936754XTransplant Center", "grid.38142.3c Transplant Center"),
        ("University of Arizonagrid. College of Law", "University of Arizona College of Law"),
        (None, ""),
    ],
)
def test_cleaning(raw, want):
    assert affiliation.clean(raw) == want


def test_cleaning_is_stable():
    for raw in ("Department of Surgery, Alpha College, Rome", "https://ror.org/03zjqec80 HSS Institute", "grid.38142.3c Transplant Center"):
        assert affiliation.clean(affiliation.clean(raw)) == affiliation.clean(raw) == raw


RESOLVED = [
    ("Brigham and Women's Hospital and Harvard Medical School", [], ["Brigham and Women's Hospital", "Harvard University"]),
    ("Dept https://ror.org/04b6nzv94", [], ["Brigham and Women's Hospital"]),
    ("Dept grid.62560.370000", [], ["Brigham and Women's Hospital"]),
    ("Department of Medicine, Davis, CA", ["University of California"], ["University of California, Davis"]),
    ("San Diego Hospital, San Diego", [], []),
    ("University of Louisiana at Lafayette, LA", [], ["University of Louisiana, Lafayette"]),
    ("University of Nebraska-Lincoln, Lincoln, NE", [], ["University of Nebraska, Lincoln"]),
    ("University of Missouri-Kansas City, MO", [], ["University of Missouri, Kansas City"]),
    ("University of Maryland School of Medicine, Baltimore", [], ["University of Maryland School of Medicine"]),
    ("University of North Carolina Project Malawi, Lilongwe", [], []),
    ("Harvey Mudd College, Claremont, CA", [], ["Harvey Mudd College"]),
    ("Arizona State University, Tempe", [], ["Arizona State University-Tempe"]),
    ("Texas A and M University", [], ["Texas A&M"]),
    ("A is with X. B is with Y; C is also with Z.", [], []),
    ("Some Research Institute, Mumbai, India", [], ["Some Research Institute, India"]),
    ("Kodiak Therapeutics Partners, Boston, MA", [], ["Kodiak Therapeutics Partners"]),
    ("", [], []),
]


def test_resolution(spark):
    found = {r.block: r.institutions for r in resolve.resolve(spark.createDataFrame([(b, c) for b, c, _ in RESOLVED], "block string, context array<string>"), resolve.seed_registry(spark)).collect()}
    assert found == {b: want for b, _, want in RESOLVED}


def test_holders_of_one_identifier(spark):
    ror = "https://ror.org/0aa1bb2cc"
    known = spark.createDataFrame([("ror", ror, "Alder Institute"), ("ror", ror, "Birch Institute"), ("ror", "https://ror.org/0dd1ee2ff", "Cedar Hall")], "kind string, key string, canonical string")
    blocks = spark.createDataFrame([(f"Unit, Birch Institute; {ror}",), (f"Hall 1, {ror}",), (f"Hall 2, {ror}; ror.org/0dd1ee2ff",), ("Hall 3, ror.org/0dd1ee2ff",)], "block string").withColumn("context", F.array().cast("array<string>"))
    found = lambda **how: sorted((r.block.split(",")[0], *r.institutions) for r in resolve.resolve(blocks, known, **how).collect())
    # the block's own name decides (the smallest name did before); where it has none, every holder is a reading
    assert found() == [("Hall 1", "Alder Institute"), ("Hall 2", "Alder Institute", "Cedar Hall"), ("Hall 3", "Cedar Hall"), ("Unit", "Birch Institute")]
    assert found(readings=True) == sorted([*found(), ("Hall 1", "Birch Institute"), ("Hall 2", "Birch Institute", "Cedar Hall")])


def test_signals(spark):
    got = spark.range(1).select(institutions.ror_ids(F.lit("https://ror.org/03 vek6s52grid.38142.3c")).alias("ror"), institutions.grid_ids(F.lit("https://ror.org/03 vek6s52grid.38142.3c")).alias("grid"), institutions.grid_candidates(F.lit("grid.1.370000")).alias("cut"), institutions.country(F.lit("X, Atlanta, Georgia")).alias("ga"), institutions.email_domains(F.lit("a@b.c.edu")).alias("mail")).first()
    assert got.ror == ["https://ror.org/03vek6s52"] and got.grid == [] and got.ga == "" and got.mail == ["b.c.edu", "c.edu"]
    assert got.cut == ["grid.1.370000", "grid.1.37", "grid.1.3", "grid.1.370", "grid.1.3700"]
