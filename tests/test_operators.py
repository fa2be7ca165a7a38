import random

import pytest
from citemill.functions import names
from citemill.operators import analysis, identity, organizations, records, review
from pyspark.sql import functions as F

AUTHOR = "pmid string, ord long, position int, last_name string, fore_name string, initials string, affiliation string, blocks array<string>, orcid string"


def authors(spark, rows):
    return spark.createDataFrame([(p, int(p), k, last, fore, "".join(w[0] for w in fore.split()), "; ".join(blocks), blocks, orcid) for p, k, last, fore, blocks, orcid in rows], AUTHOR)


def cites(spark, rows):
    defaults = {"print_year": 2024, "journal": "J", "publication_types": [], "doi": "", "source_for_roles": "pmc", "author_count": 3, "co_first": [], "co_senior": [], "update_in": [], "update_of": []}
    schema = "pmid string, ord long, print_year int, journal string, publication_types array<string>, doi string, source_for_roles string, author_count int, co_first array<int>, co_senior array<int>, update_in array<string>, update_of array<string>"
    return spark.createDataFrame([(r["pmid"], int(r["pmid"]), *[{**defaults, **r}[k] for k in defaults]) for r in rows], schema)


def mentions(spark, rows):
    return spark.createDataFrame([(p, k, m, c) for p, k, m, c in rows], "pmid string, position int, method string, cluster_id string")


def clustered(spark, rows, target="Lund J"):
    found = identity.mentions(authors(spark, rows), identity.targets(spark, {"t": names.parse_target(target)}))
    return identity.with_cluster(found.withColumn("institutions", F.col("blocks")))


def test_identifier_match_is_exclusive(spark):
    rows = [("1", 1, "Lund", "Josefa", ["A"], "0000-0001-2345-6789"), ("1", 2, "Lund", "Josefa", ["B"], ""), ("2", 1, "Lund", "Josefa", ["B"], "")]
    target = identity.targets(spark, {"t": names.parse_target("Josefa Lund", "0000-0001-2345-6789"), "u": names.parse_target("Josefa Lund")})
    got = sorted((r.target_id, r.pmid, r.position, r.method) for r in identity.mentions(authors(spark, rows), target).collect())
    assert got == [("t", "1", 1, "orcid"), ("t", "2", 1, "given"), ("u", "1", 1, "given"), ("u", "1", 2, "given"), ("u", "2", 1, "given")]


def test_mentions_without_affiliation_stay_apart(spark):
    found = clustered(spark, [("1", 1, "Lund", "Josefa", [], ""), ("2", 1, "Lund", "Josefa", [], "")])
    assert found.select("cluster_id").distinct().count() == 2


def test_merging_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(str(i), 1, "Lund", rng.choice(["Josefa", "Jonas K"]), sorted(rng.sample("ABCDEF", rng.randint(1, 4))), "") for i in range(160)]
    found = clustered(spark, rows)
    got = {r.first_id: r.cluster_id for r in identity.merged(found).collect()}
    size, keys = {}, {}
    for r in found.collect():
        size[r.cluster_id] = size.get(r.cluster_id, 0) + 1
        keys[r.cluster_id] = (r.name_key, frozenset(r["keys"]))
    best = {}
    for a, (name, own) in keys.items():
        wider = [b for b, (n, k) in keys.items() if n == name and own < k and size[b] >= size[a]]
        if wider:
            best[a] = max(wider, key=lambda b: (size[b], len(keys[b][1]), b))

    def end(c):
        return end(best[c]) if c in best else c

    assert got == {c: end(c) for c in keys} and best


def test_same_result_in_any_partitioning(spark):
    rows = [(str(i), 1, "Lund", "Josefa", ["AB"[i % 2], "C"][: 1 + i % 2], "") for i in range(40)]
    def run(n):
        c = cites(spark, [{"pmid": str(i), "print_year": 2000 + i % 5} for i in range(40)]).repartition(n)
        return sorted(map(str, identity.clusters(identity.merged(clustered(spark, rows).repartition(n)), c).collect()))
    assert run(1) == run(8)


def test_cluster_labels_follow_first_appearance(spark):
    rows = [("1", 1, "Lund", "Josefa", ["Alpha Lab"], ""), ("2", 1, "Lund", "Josefa", ["ALPHA lab", "beta"], ""), ("3", 1, "Lund", "Josefa", ["alpha LAB", "beta"], "")]
    found = identity.clusters(identity.merged(clustered(spark, rows)), cites(spark, [{"pmid": p} for p in "123"])).collect()
    assert [(r.mention_count, r.affiliations, r.years, r.label) for r in found] == [(3, ["Alpha Lab", "beta"], [2024], "Lund, Josefa")]


def frame_of(spark, cs, ms, start=None, end=None, forced=None, excluded=None):
    found = mentions(spark, ms)
    pick = lambda ids: spark.createDataFrame([(p,) for p in ids], "pmid string")
    rows = analysis.analysis_rows(cites(spark, cs), found, found.select("cluster_id"), start, end, pick(forced or []), pick(excluded or []))
    return analysis.report_order(rows)


def rows_of(spark, *args, **options):
    return {r.pmid: r for r in frame_of(spark, *args, **options).collect()}


def test_roles(spark):
    got = rows_of(spark, [{"pmid": "1", "co_first": [2], "co_senior": [2]}, {"pmid": "2"}, {"pmid": "3", "author_count": 1}, {"pmid": "4", "author_count": 2}], [("1", 1, "given", "c"), ("2", 3, "given", "c"), ("3", 1, "given", "c"), ("4", 3, "given", "c")])
    assert {p: (r.counted_first, r.counted_senior) for p, r in got.items()} == {"1": (True, False), "2": (False, True), "3": (True, True), "4": (False, False)}


def test_uncertainty(spark):
    got = rows_of(spark, [{"pmid": "1", "source_for_roles": "pubmed"}, {"pmid": "2"}, {"pmid": "3"}], [("1", 1, "given", "c"), ("1", 2, "given", "c"), ("2", 1, "initials", "c"), ("3", 1, "orcid", "c"), ("3", 2, "initials", "c")])
    assert got["1"].reasons == [analysis.SEVERAL, analysis.NO_ROLES] and got["2"].reasons == [analysis.BY_INITIALS] and got["3"].reasons == []
    assert [got[p].include for p in "123"] == [False, False, True]


def test_forced_window_and_order(spark):
    got = rows_of(spark, [{"pmid": "1", "print_year": 1990}, {"pmid": "2", "print_year": 2022}, {"pmid": "3", "print_year": 2025, "journal": "b"}, {"pmid": "4", "print_year": 2025, "journal": "A"}, {"pmid": "5", "print_year": None}, {"pmid": "6"}], [(str(i), 1, "given", "c") for i in range(1, 7)], 2000, 2030, forced=["1", "5"], excluded=["1", "6"])
    assert sorted(got, key=lambda p: got[p].idx) == ["4", "3", "2", "1", "5"] and got["1"].forced_include


def test_preprints(spark):
    pre = {"publication_types": ["Preprint"]}
    cs = [{"pmid": "1", "doi": "10.1/A", **pre}, {"pmid": "2", "doi": " 10.1/a"}, {"pmid": "3", "update_in": ["99", "4", "x"], **pre}, {"pmid": "4", **pre}, {"pmid": "5", "update_of": ["4"]}, {"pmid": "6", "update_of": ["5"]}]
    got = {r.pmid: r.later for r in analysis.superseded(cites(spark, cs)).collect()}
    assert got == {"1": ["2"], "3": ["99", "x"], "4": ["5"]}
    rows = rows_of(spark, cs[:2], [("1", 3, "given", "c"), ("2", 3, "given", "c")])
    assert [rows[p].include for p in "12"] == [False, True]


def test_summary_and_subtotals(spark):
    years = [2023, 2023, 2024, 2025, 2025, None]
    rows = frame_of(spark, [{"pmid": str(i), "print_year": y, "journal": "Sci"} for i, y in enumerate(years, 1)] + [{"pmid": "8", "publication_types": ["Systematic Review"]}], [(str(i), 1, "given", "c") for i in range(1, 7)] + [("8", 3, "given", "c")])
    totals = analysis.summary(rows).first()
    assert tuple(totals) == (6, 6, 1, 0, 0)
    assert analysis.journal_subtotals(rows).collect()[0].detail == "2x2023, 2024, 2x2025, n/a"
    line = analysis.summary_line(analysis.summary(rows), analysis.journal_subtotals(rows), "all years").first().report
    assert line == "Peer-reviewed Publications (all years): 6 total, 6 1st/Sr author (6 Sci 2x2023, 2024, 2x2025, n/a). In addition: 1 review(s) as Sr author; 0 preprint(s)."
    assert "(none)" in analysis.summary_line(analysis.summary(rows.where("false")), analysis.journal_subtotals(rows.where("false")), "x").first().report


@pytest.mark.parametrize("seed", [1, 2])
def test_include_needs_no_reason(spark, seed):
    rng = random.Random(seed)
    got = rows_of(spark, [{"pmid": str(i), "source_for_roles": rng.choice(["pmc", "pubmed"])} for i in range(1, 20)], [(str(rng.randint(1, 19)), rng.randint(1, 3), rng.choice(["given", "initials", "orcid"]), "c") for _ in range(30)])
    assert all(r.include == (not r.reasons) for r in got.values())


def test_overrides(spark):
    rows = frame_of(spark, [{"pmid": "1", "source_for_roles": "pubmed"}, {"pmid": "2"}, {"pmid": "3", "source_for_roles": "pubmed", "print_year": 2020}], [(p, 1, "given", "c") for p in "123"])
    entries = spark.createDataFrame([("1::senior", 1), ("1:: exclude", 2), ("1::review_senior", 3), ("2::exclude", 4), ("3::coauthor", 5), ("junk", 6), ("::x", 7)], "entry string, ord int")
    modes = review.corrections(entries)
    assert {r.pmid: r.mode for r in modes.collect()} == {"1": "first_senior_review", "2": "exclude", "3": "coauthor"}
    corrected = {r.pmid: r for r in review.report_correct(rows, spark.createDataFrame([("1",)], "pmid string"), modes).collect()}
    assert (corrected["1"].is_review, corrected["1"].counted_review_senior, corrected["1"].counted_first) == (True, True, False)
    assert not corrected["2"].include and corrected["3"].include
    final = {r.pmid: r for r in review.finalize(rows, rows.where("pmid = '1'").select("idx"), modes).collect()}
    assert final["1"].is_review and final["2"].include and not final["3"].include


def test_filters_before_analysis(spark):
    found = mentions(spark, [("1", 1, "given", "a"), ("2", 1, "given", "b"), ("3", 1, "given", "a"), ("4", 1, "given", "b")])
    ids = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = review.filtered_mentions(found, ids("cluster_id", "a"), None, ids("pmid", "3", "4"), ids("pmid", "4"))
    assert sorted(r.pmid for r in got.collect()) == ["1", "4"]
    assert review.filtered_mentions(found, ids("cluster_id", "a"), ids("pmid", "3"), ids("pmid", "3"), ids("pmid", "9")).count() == 0


def test_organisation_levels(spark):
    orgs = organizations.organizations(spark.createDataFrame([(1, "Harbor and Willow's Hospital", "us", "https://ror.org/0aa1bb2cc"), (2, "Tarland Medical School", "US", ""), (3, "harbor and willow's  hospital", "US", "https://ror.org/0aa1bb2cc")], "ord int, name string, country string, identifier string"))
    assert orgs.count() == 2
    rows = [("a", "x 0aa1bb2cc", "Harbor and Willow's Hospital"), ("b", "y", "Harbor & Willow’s Hospital"), ("c", "z", "Partners - Harbor and Willow's Hospital Boston"), ("d", "w", "Tarland Med School"), ("e", "v", "Medical School Hospital"), ("f", "u", "Stanford")]
    names_ = spark.createDataFrame([(i, 0, a, 0, n) for i, a, n in rows], "id string, affiliation_ord int, affiliation string, name_ord int, name string")
    got = {r.id: (r.level, r.institution) for r in organizations.affiliation_matches(names_, orgs).collect()}
    assert got == {"a": ("verified", "Harbor and Willow's Hospital"), "b": ("likely", "Harbor and Willow's Hospital"), "c": ("contains", "Harbor and Willow's Hospital"), "d": ("possible", "Tarland Medical School")}


def test_badges(spark):
    rows = spark.createDataFrame([("c", "Alpha Institute", "contains", 1), ("c", "ALPHA institute", "likely", 2), ("c", " ", "verified", 3)], "cluster_id string, institution string, level string, ord int")
    levels = organizations.cluster_levels(rows)
    assert [(r.name, r.level) for r in levels.collect()] == [("ALPHA institute", "likely")]
    shown = spark.createDataFrame([("c", "Alpha Institute"), ("c", "Alpha Institute of Rome"), ("c", "Beta"), ("d", "Alpha Institute")], "cluster_id string, affiliation string")
    got = {(r.cluster_id, r.affiliation): r.match for r in organizations.cluster_badges(shown, levels).collect()}
    assert got == {("c", "Alpha Institute"): "likely", ("c", "Alpha Institute of Rome"): "contains", ("c", "Beta"): None, ("d", "Alpha Institute"): None}


@pytest.mark.parametrize(
    ("note", "at", "want"),
    [
        ("These authors contributed equally", [1, 2], ([1, 2], [])), ("Equal contribution.", [3, 4], ([], [3, 4])), ("contributed equally", [1, 2, 3, 4], ([], [])),
        ("contributed equally", [2, 3], ([], [])), ("share senior authorship; contributed equally", [2, 4], ([], [2, 4])), ("Correspondence", [4], ([], [])),
    ],
)
def test_roles_from_notes(spark, note, at, want):
    notes = spark.createDataFrame([("1", "n", note, k) for k in at], "pmid string, note_id string, note string, author_ord int")
    got = records.role_positions(notes, spark.createDataFrame([("1", 4)], "pmid string, author_count int")).first()
    assert (got.co_first, got.co_senior) == want


def test_shared_affiliation(spark):
    rows = [("1", 1, "A", "X", ["One"], ""), ("1", 2, "B", "Y", [], ""), ("2", 1, "A", "X", ["One"], ""), ("2", 2, "B", "Y", ["Two"], ""), ("2", 3, "C", "Z", [], "")]
    got = {(r.pmid, r.position): r.blocks for r in records.shared_affiliation(authors(spark, rows)).collect()}
    assert got[("1", 2)] == ["One"] and got[("2", 3)] == []


def test_targets_do_not_mix(spark):
    cs = cites(spark, [{"pmid": str(i), "print_year": 2000 + i, "source_for_roles": "pmc"} for i in range(1, 6)])
    schema = "target_id string, pmid string, position int, method string, cluster_id string, affiliation string"
    ms = {"t": [("1", 1, "given", "c", "A"), ("2", 2, "initials", "d", "")], "u": [("1", 3, "given", "c", "B"), ("2", 1, "given", "c", "B"), ("3", 1, "given", "c", "B"), ("2", 2, "given", "d", "A")]}
    frame = lambda rows, columns: spark.createDataFrame(rows, columns)
    found = frame([(t, *m) for t in ms for m in ms[t]], schema)
    chosen = frame([("t", "c"), ("t", "d"), ("u", "c")], "target_id string, cluster_id string")
    forced, out = frame([("t", "5"), ("u", "2")], "target_id string, pmid string"), frame([("t", "1"), ("u", "3")], "target_id string, pmid string")
    labels = frame([("t", "c", "T"), ("t", "d", "D"), ("u", "c", "U")], "target_id string, cluster_id string, label string")
    accepted, modes = frame([("t", "2")], "target_id string, pmid string"), frame([("u", "1", "exclude")], "target_id string, pmid string, mode string")

    def run(t=None):
        pick = lambda df: df if t is None else df.where(F.col("target_id") == t).drop("target_id")
        rows = analysis.report_order(analysis.analysis_rows(cs, pick(found), pick(chosen), None, None, pick(forced), pick(out)), () if t else ("target_id",))
        corrected = review.report_correct(rows, pick(accepted), pick(modes))
        kept = review.filtered_mentions(pick(found), pick(chosen), None, pick(out), pick(forced))
        tables = [rows, corrected, review.selection_rows(cs, pick(found), pick(found), pick(labels)), kept, analysis.summary(corrected, () if t else ("target_id",)), analysis.journal_subtotals(corrected, () if t else ("target_id",))]
        tables.append(review.finalize(rows, rows.where("pmid = '2'").select(*analysis.target_key(rows), "idx"), pick(modes)))
        return [[(r.asDict().get("target_id", t), sorted((k, str(v)) for k, v in r.asDict().items() if k != "target_id")) for r in table.collect()] for table in tables]

    both = run()
    assert [sorted(table) for table in both] == [sorted(a + b) for a, b in zip(run("t"), run("u"), strict=True)]
    assert [len(table) for table in both][:2] == [4, 4]
