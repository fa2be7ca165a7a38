"""Requests in rounds, headers, tokens and early stops, all on saved answers."""

import json
import re
import sys
import urllib.parse
from dataclasses import replace
from urllib.error import HTTPError

import pytest
from citemill.sources import connectors as C
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests
IDS = [f"0000-0001-0000-{k:04d}" for k in range(30)]


def saved(log, answer, lifetime=3600):
    """A transport that writes what it is asked to a file and answers by a function of url; tokens are numbered."""

    def send(url, headers, form):
        with open(log, "a") as f:
            f.write(json.dumps([url, headers, form]) + "\n")
        return json.dumps({"access_token": "t1", "expires_in": lifetime}) if form else answer(url)

    return send


def asked(log):
    try:
        return [json.loads(line) for line in open(log)]
    except FileNotFoundError:
        return []


def still(seconds):
    pass


def article(number, named=True):
    mark = f'<article-id pub-id-type="pmcid">PMC{number}</article-id>' if named else ""
    return f"<article><front><article-meta>{mark}<title>{number}</title></article-meta></front></article>"


@pytest.mark.parametrize("parallel", [1, 3])
def test_missing_articles_are_asked_for_one_by_one(spark, tmp_path, parallel):
    log = str(tmp_path / "log")

    def answer(url):
        ids = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))["id"].split(",")
        if ids == ["13"]:
            raise HTTPError(url, 404, "gone", None, None)
        if ids == ["14"]:
            return "<broken"
        there = [i for i in ids if len(ids) == 1 or i not in ("13", "14", "15")]
        return f"<pmc-articleset>{''.join(article(i) for i in there)}</pmc-articleset>"

    wanted = spark.createDataFrame([(f"PMC{k}",) for k in range(1, 101)] + [("pmc 5",), ("",), (None,)], "pmcid string")
    found = {r.pmcid: r for r in C.full_texts(wanted, C.Client("pmc", parallel, transport=saved(log, answer), sleep=still)).collect()}
    ids = [dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(u).query))["id"].split(",") for u, _, _ in asked(log)]
    assert sorted(map(len, ids)) == [1, 1, 1, 50, 50] and sorted(i for x in ids if len(x) == 1 for i in x) == ["13", "14", "15"]
    assert len(found) == 100 and {p for p, r in found.items() if r.error} == {"PMC13", "PMC14"}
    assert "404" in found["PMC13"].error and "ParseError" in found["PMC14"].error and found["PMC13"].document is None
    assert (found["PMC15"].round, found["PMC1"].round) == (2, 1) and "<title>15</title>" in found["PMC15"].document


def test_failed_chunk_and_unnamed_articles(spark, tmp_path):
    log = str(tmp_path / "log")

    def answer(url):
        ids = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))["id"].split(",")
        if ids == ["1", "2"]:
            raise ValueError("odd answer")
        return f"<x>{''.join(article(i, named=False) for i in ids)}</x>" if ids != ["2"] else "<x/>"

    wanted = spark.createDataFrame([(f"PMC{k}",) for k in range(1, 5)], "pmcid string")
    found = {r.pmcid: r for r in C.full_texts(wanted, C.Client("pmc", transport=saved(log, answer), sleep=still), size=2).collect()}
    assert {p: r.round for p, r in found.items()} == {"PMC1": 2, "PMC2": 2, "PMC3": 1, "PMC4": 1}
    assert found["PMC2"].error == "PMC XML unavailable for PMC2" and [p for p, r in found.items() if r.error] == ["PMC2"]
    assert all(f"<title>{p[3:]}</title>" in r.document for p, r in found.items() if r.document)
    assert C.full_texts(wanted.limit(0), C.Client("pmc", transport=saved(log, answer), sleep=still)).count() == 0


def test_works_need_a_token_and_searches_do_not(spark, tmp_path):
    log = str(tmp_path / "log")
    client = C.Client("orcid_works", client_id="me", secret="s", transport=saved(log, lambda url: "{}"), sleep=still)
    requests = spark.createDataFrame([(1, IDS[1]), (2, IDS[2])], "request int, ids string")
    assert [(r.request, r.document, r.error) for r in C.ask(requests, client).orderBy("request").collect()] == [(1, "{}", None), (2, "{}", None)]
    form, *gets = asked(log)
    assert form[0] == C.TOKENS and form[1] == {"Accept": "application/json"} and form[2]["grant_type"] == "client_credentials" and form[2]["client_secret"] == "s"
    assert [g[1] for g in gets] == [{"Accept": "application/json", "Authorization": "Bearer t1"}] * 2 and gets[0][0] == f"https://pub.orcid.org/v3.0/{IDS[1]}/works"
    bare = C.Client("orcid_works", transport=saved(str(tmp_path / "bare"), lambda url: "{}"), sleep=still)
    assert all("credentials" in r.error and r.document is None for r in C.ask(requests, bare).collect()) and not asked(tmp_path / "bare")
    search = C.Client("orcid_search", transport=saved(str(tmp_path / "search"), lambda url: "{}"), sleep=still)
    assert search.get(search.url("x")) == "{}" and asked(tmp_path / "search")[0][1] == {"Accept": "application/json"}
    pubmed = C.Client("pubmed", apikey="k", transport=saved(str(tmp_path / "pubmed"), lambda url: "<x/>"), sleep=still)
    assert pubmed.get(pubmed.url("1,2")) == "<x/>" and asked(tmp_path / "pubmed")[0][1] == {} and "api_key=k" in pubmed.url("1")


def test_token_is_renewed_between_requests(tmp_path):
    clock, log = [0.0], str(tmp_path / "log")
    client = C.Client("orcid_activities", client_id="me", secret="s", transport=saved(log, lambda url: "{}", lifetime=100), sleep=still, now=lambda: clock[0])
    for clock[0] in (0.0, 60.0, 80.0, 90.0):
        client.get(client.url(IDS[0]))
    assert [form is not None for _, _, form in asked(log)] == [True, False, False, True, False, False]


def test_reader_sends_token_and_headers():
    reader = C.ServiceReader({"service": "orcid_works", "requests": json.dumps(IDS[:2]), "clientid": "me", "clientsecret": "s", "tokenurl": "http://token"})
    calls = []

    def send(url, headers, form):
        calls.append((url, headers))
        return json.dumps({"access_token": "abc"}) if form else "{}"

    reader.client.transport, reader.client.sleep = send, still
    (part,) = reader.partitions()
    assert [(r[0], r[3]) for r in reader.read(part)] == [(0, "{}"), (1, "{}")]
    assert calls[0][0] == "http://token" and [h.get("Authorization") for _, h in calls] == [None, "Bearer abc", "Bearer abc"]


def search(found, basic=False):
    return json.dumps({"result": [{"orcid-identifier": {"path": i}} for i in found]} if basic else {"expanded-result": [{"orcid-id": i, "credit-name": f"N{i[-2:]}"} for i in found]})


def test_search_stops_early_and_falls_back(spark, tmp_path):
    log = str(tmp_path / "log")

    def answer(url):
        q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))["q"].lower()
        if "many" in q:
            k = 2 if q.startswith("given-and") else 0
            return search(IDS[k : k + 3])
        if "plain" in q:
            return search(IDS[7:9], basic=True) if url.startswith(C.BASIC) else search([])
        if "bad" in q:
            raise HTTPError(url, 400, "bad", None, None)
        return "no json"

    names = spark.createDataFrame([("a", "Ann Many"), ("b", "Bo Plain"), ("c", "Cy Bad"), ("d", "Di None"), ("e", " "), ("f", None)], "search string, name string")
    client = C.Client("orcid_search", parallel=2, transport=saved(log, answer), sleep=still)
    rows = C.search_profiles(names, 4, client).orderBy("search", "place").collect()
    urls = [u for u, _, form in asked(log) if not form]
    per = {key: [u for u in urls if key.lower() in u.lower()] for key in ("Many", "Plain", "Bad", "None")}
    assert len(per["Many"]) == 2 and len(per["Bad"]) == 1
    assert [u.startswith(C.BASIC) for u in per["Plain"]] == [False] * len(C.profile_queries("Bo Plain")) + [True] * (len(per["Plain"]) - len(C.profile_queries("Bo Plain")))
    assert len(per["None"]) == 2 * len(C.profile_queries("Di None")) and all("rows=4" in u and "start=0" in u for u in urls)
    assert [(r.search, r.place, r.orcid) for r in rows if r.search == "a"] == [("a", k + 1, i) for k, i in enumerate([IDS[2], IDS[3], IDS[4], IDS[0]])]
    assert [(r.place, r.orcid, r.display_name) for r in rows if r.search == "b"] == [(1, IDS[7], ""), (2, IDS[8], "")]
    assert [(r.place, r.orcid, "400" in r.error) for r in rows if r.search == "c"] == [(None, None, True)] and {r.search for r in rows} == {"a", "b", "c"}


def test_chunks_keep_order_in_every_partitioning(spark):
    ids = spark.range(1000).selectExpr("cast(id as string) id", "id ord").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = [r.ids.split(",") for r in C.chunks(ids, 200).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(int(i) for c in cut for i in c) == list(range(1000)) and all(len(c) <= 200 and [int(i) for i in c] == list(range(int(c[0]), int(c[0]) + len(c))) for c in cut)
    assert len(C.chunks(ids, 200).collect()) == 5


def test_client_copies_keep_their_own_token():
    one = C.Client("orcid_works", client_id="a", secret="b")
    assert replace(one, parallel=4).spacing == 4 * one.spacing and C.Client("pmc", apikey="k").spacing == 0.11
