"""HTTP services as tables: requests in, one row per response out.

Requests come as a DataFrame (ask, full_texts, search_profiles) or as options of a Python data source (responses). They are dealt
over as many partitions as parallel says (one by default), each of which waits that many times the service's spacing, so
that all keep the spacing together. A Client makes a worker's requests: it sends the headers that a service wants and
asks for tokens and renews them where it runs. Its transport is a function, so tests and closed networks can put their
own in; live behaviour is not tested here.
"""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from http.client import HTTPException
from urllib.error import HTTPError, URLError

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions import text
from ..functions.requests import profile_queries
from ..runtime import ship, written
from .xml_records import split_articles

RETRIED, RETRIES, CAP = frozenset({429, 500, 502, 503, 504}), 4, 8.0
EUTILS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
SERVICES = {
    "pubmed": f"{EUTILS}/efetch.fcgi?db=pubmed&retmode=xml&id={{ids}}",
    "pmc": f"{EUTILS}/efetch.fcgi?db=pmc&retmode=xml&id={{ids}}",
    "idmap": "https://pmc.ncbi.nlm.nih.gov/tools/idconv/api/v1/articles/?format=json&ids={ids}",
    "litsense": "https://www.ncbi.nlm.nih.gov/research/litsense-api/api/author/?query={ids}",
    "orcid_works": "https://pub.orcid.org/v3.0/{ids}/works",
    "orcid_activities": "https://pub.orcid.org/v3.0/{ids}/activities",
    "orcid_search": "https://pub.orcid.org/v3.0/expanded-search/?q={ids}",
}
#: Profile searches: the one that shows names, and the plain one.
EXPANDED, BASIC = "https://pub.orcid.org/v3.0/expanded-search", "https://pub.orcid.org/v3.0/search"
TOKENS = "https://orcid.org/oauth/token"
#: Services that answer only with a token; others of their host take one where it can be had.
GUARDED = frozenset({"orcid_works", "orcid_activities"})
PMC_CHUNK = 50
ORCID = re.compile(r"\d{4}-?\d{4}-?\d{4}-?\d{3}[\dXx]")
SPACING = {"ncbi": 0.34, "ncbi_key": 0.11, "orcid": 0.2}


def backoff(attempt: int, retry_after: str | None = None, now: float | None = None) -> float:
    """Seconds to wait: what the service says (a number or a date; half a second at least), else 0.6 doubled each time up to the cap."""
    if retry_after:
        try:
            return max(0.5, float(retry_after))
        except ValueError:
            try:
                return max(0.5, parsedate_to_datetime(retry_after).timestamp() - (time.time() if now is None else now))
            except ValueError:
                pass
    return min(CAP, 0.6 * 2**attempt)


def augmented(url: str, api_key: str = "", tool: str = "", email: str = "") -> str:
    """url with the key, and for E-utilities tool and e-mail, where it has none of its own."""
    parts = urllib.parse.urlsplit(url)
    params = dict(urllib.parse.parse_qsl(parts.query, keep_blank_values=True))
    extra = {"api_key": api_key} | ({"tool": tool, "email": email} if url.startswith(EUTILS) else {})
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode({k: v for k, v in extra.items() if v} | params)))


#: Body of a url, with headers, and with a form where it is posted.
Transport = Callable[[str, dict[str, str], dict[str, str] | None], str]


def over_network(url: str, headers: dict[str, str], form: dict[str, str] | None = None) -> str:
    body = urllib.parse.urlencode(form).encode() if form else None
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=30) as response:
        return response.read().decode()


def fetch(url: str, spacing: float = 0.0, send: Callable[[str], str] | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body of url; retried after busy answers, time-outs and dropped connections."""
    for attempt in range(RETRIES + 1):
        try:
            sleep(spacing)
            return send(url) if send else over_network(url, {})
        except HTTPError as e:
            if e.code not in RETRIED or attempt == RETRIES:
                raise
            sleep(backoff(attempt, e.headers.get("Retry-After") if e.headers else None))
        except (URLError, HTTPException, TimeoutError, ConnectionError):
            if attempt == RETRIES:
                raise
            sleep(backoff(attempt))
    raise AssertionError("unreachable")


def pages(url: str, get: Callable[[str], str], most: int = 10) -> Iterator[str]:
    """Responses of a service that links pages by `next`, at most so many."""
    for _ in range(most):
        body = get(url)
        yield body
        try:
            url = json.loads(body).get("next") or ""
        except (ValueError, AttributeError):
            return
        if not url:
            return


def chunks(ids: DataFrame, size: int = 200) -> DataFrame:
    """chunk and ids (joined by commas) of ids (id, ord), at most size to a chunk, in order; numbered within the sorted partitions, so no task sees all."""
    placed = ids.orderBy("ord").select("id", "ord", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    first = F.shiftleft(F.col("part").cast("long"), 33)
    cut = placed.select("id", "ord", (first + F.floor((F.col("row") - first) / size)).alias("chunk"))
    return cut.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]), ",").alias("ids"))


class Token:
    """A service token for client credentials, asked for again 30 seconds before it ends.

    send(url, form) gives the body of the answer. A missing or odd lifetime counts as an hour, a short one as a minute.
    """

    def __init__(self, url: str, client_id: str, secret: str, send: Callable[[str, dict], str], now: Callable[[], float] = time.monotonic):
        self.url, self.client_id, self.secret, self.send, self.now = url, client_id, secret, send, now
        self.value, self.ends = "", 0.0

    def get(self) -> str:
        asked = self.now()
        if self.value and asked < self.ends - 30:
            return self.value
        if not (self.client_id and self.secret):
            raise RuntimeError("client credentials are not configured")
        answer = json.loads(self.send(self.url, {"client_id": self.client_id, "client_secret": self.secret, "grant_type": "client_credentials", "scope": "/read-public"}))
        token = str(answer.get("access_token", "")).strip() if isinstance(answer, dict) else ""
        if not token:
            raise RuntimeError("the answer holds no access_token")
        try:
            lifetime = int(answer.get("expires_in", 3600))
        except (TypeError, ValueError):
            lifetime = 3600
        self.value, self.ends = token, asked + max(lifetime, 60)
        return self.value


@dataclass
class Client:
    """How a worker asks a service: headers, spacing, retries, and a token of its own that it renews in time."""

    service: str
    parallel: int = 1
    apikey: str = ""
    tool: str = ""
    email: str = ""
    client_id: str = ""
    secret: str = ""
    token_url: str = TOKENS
    transport: Transport = over_network
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], float] = time.monotonic
    token: Token | None = None

    @property
    def spacing(self) -> float:
        kind = "orcid" if self.service.startswith("orcid") else "ncbi_key" if self.apikey else "ncbi"
        return SPACING[kind] * self.parallel

    def url(self, ids: str) -> str:
        return augmented(SERVICES[self.service].format(ids=urllib.parse.quote(ids, safe=",")), self.apikey, self.tool, self.email)

    def headers(self) -> dict[str, str]:
        """What the service wants to be sent: JSON asked for, and a bearer token, without which only searches go on."""
        if not self.service.startswith("orcid"):
            return {}
        found = {"Accept": "application/json"}
        if self.token is None:
            self.token = Token(self.token_url, self.client_id, self.secret, lambda url, form: fetch(url, self.spacing, lambda u: self.transport(u, {"Accept": "application/json"}, form), self.sleep), self.now)
        try:
            found["Authorization"] = f"Bearer {self.token.get()}"
        except Exception:
            if self.service in GUARDED:
                raise
        return found

    def get(self, url: str) -> str:
        return fetch(url, self.spacing, lambda u: self.transport(u, self.headers(), None), self.sleep)


def ask(requests: DataFrame, client: Client, most: int = 1) -> DataFrame:
    """request, page, url, document and error of requests (request, ids), up to most pages each; a failed request is a row with its error, and the others go on.

    Every use of the result asks again: keep it with runtime.written.
    """
    ship(requests.sparkSession)
    names = ("request", "page", "url", "document", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for request, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                url = client.url(ids)
                for k, body, error in _answers(url, client.get, most):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((request, k, url, body, error), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    return requests.select(F.col("request").cast("long"), "ids").repartition(client.parallel).mapInArrow(run, "request long, page int, url string, document string, error string")


def _answers(url: str, get: Callable[[str], str], most: int) -> Iterator[tuple[int, str | None, str | None]]:
    """Page, body and error of a request's pages; after an error there are no more."""
    k = -1
    try:
        for k, body in enumerate(pages(url, get, most)):
            yield k, body, None
    except Exception as e:  # a failed request is a row
        yield k + 1, None, f"{type(e).__name__}: {e}"


@dataclass
class Requests(InputPartition):
    urls: list[tuple[int, str]] = field(default_factory=list)


class ServiceReader(DataSourceReader):
    def __init__(self, options: dict):
        known = {name: options[key] for name, key in (("apikey", "apikey"), ("tool", "tool"), ("email", "email"), ("client_id", "clientid"), ("secret", "clientsecret"), ("token_url", "tokenurl")) if options.get(key)}
        self.requests = json.loads(options.get("requests", "[]"))
        self.client = Client(options["service"], max(1, min(int(options.get("parallel", 1)), len(self.requests))), **known)
        self.most = int(options.get("pages", 10 if options["service"] == "litsense" else 1))
        if options.get("fixture"):
            saved = json.loads(options["fixture"])
            self.client.transport, self.client.sleep = (lambda url, headers, form: saved[url]), (lambda seconds: None)

    def partitions(self) -> list[InputPartition]:
        placed = [(k, self.client.url(ids)) for k, ids in enumerate(self.requests)]
        return [Requests(placed[k :: self.client.parallel]) for k in range(self.client.parallel)]

    def read(self, partition: Requests) -> Iterator[tuple]:
        for i, url in partition.urls:
            for k, body, error in _answers(url, self.client.get, self.most):
                yield i, k, url, body, error


class ServiceSource(DataSource):
    """Options: service, requests (JSON list of id lists), apikey, tool, email, clientid, clientsecret, tokenurl, pages, parallel; fixture (JSON object of bodies by url, the token's too) instead of the network."""

    @classmethod
    def name(cls) -> str:
        return "citation_service"

    def schema(self) -> str:
        return "request int, page int, url string, document string, error string"

    def reader(self, schema) -> ServiceReader:
        return ServiceReader(self.options)


def responses(spark: SparkSession, service: str, requests: list[str], **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ServiceSource)
    return spark.read.format("citation_service").options(service=service, requests=json.dumps(requests), **options).load()


def missing(requested: DataFrame, received: DataFrame) -> DataFrame:
    """pmcids asked for and not received, to be asked for one by one."""
    return requested.select("pmcid").join(received.select("pmcid"), "pmcid", "left_anti")


def full_texts(requested: DataFrame, client: Client | None = None, size: int = PMC_CHUNK) -> DataFrame:
    """pmcid, document (one article), error and round of every different pmcid of requested, in two rounds.

    First they are asked for in chunks of size. What a chunk did not bring, because the request failed, its answer could not be read or
    an article was missing from it, is asked for once more, one by one. What is missing then is a row with an error and no document.
    An article answers the identifier it names itself; where it names none, and there are as many articles as identifiers, the one at its place.
    """
    client = client or Client("pmc")
    wanted = requested.select(text.pmcid(F.col("pmcid")).alias("pmcid")).where("pmcid <> ''").distinct()
    number = text.pmcid_number(F.col("pmcid"))
    batches = chunks(wanted.select(number.alias("id"), F.lpad(number, 20, "0").alias("ord")), size).withColumnRenamed("chunk", "request")
    first = written(_articles(batches, client))
    had = first.where("document IS NOT NULL").groupBy("pmcid").agg(F.max("document").alias("document"))
    single = missing(wanted, had).select(number.alias("ids"), F.monotonically_increasing_id().alias("request"))
    second = written(_articles(written(single), client)).groupBy("pmcid").agg(F.max("document").alias("document"), F.max("error").alias("error"))
    received = had.join(wanted, "pmcid", "left_semi").select("pmcid", "document", F.lit(None).cast("string").alias("error"), F.lit(1).alias("round"))
    rest = missing(wanted, had).join(second, "pmcid", "left")
    unread = F.when(F.col("document").isNull(), F.coalesce("error", F.concat(F.lit("PMC XML unavailable for "), "pmcid")))
    return received.union(rest.select("pmcid", "document", unread.alias("error"), F.lit(2)))


def _articles(requests: DataFrame, client: Client) -> DataFrame:
    """pmcid, document and error of requests (request, ids): the articles of each answer, or a row for each of its ids with the error."""
    asked = written(requests.select(F.col("request").cast("long").alias("request"), "ids"))
    answers = written(ask(asked, client))
    both = asked.join(answers.withColumnRenamed("request", "answered"), F.col("request") == F.col("answered"))
    return split_articles(both.select("ids", "document", "error"))


def _found_ids(body: str, key: str) -> set[str]:
    """Identifiers in a search answer, for the early stop only; profiles reads the answers properly."""
    try:
        listed = json.loads(body).get(key)
    except (ValueError, AttributeError):
        return set()
    return {m[0].upper() for item in listed if isinstance(item, dict) if (m := ORCID.search(json.dumps([item.get("orcid-id"), item.get("orcid-identifier")])))} if isinstance(listed, list) else set()


def search_answers(name: str, client: Client, most: int = 12) -> Iterator[tuple[int, bool, str | None, str | None]]:
    """ord, basic, json and error of the searches for a name, from the narrowest on: until they found most profiles; plain searches only if the others found none; none after an error."""
    rows, seen = max(1, min(50, most)), set()
    queries = profile_queries(name) if name.strip() else []
    for basic, base, key in ((False, EXPANDED, "expanded-result"), (True, BASIC, "result")):
        for k, query in enumerate(queries):
            url = f"{base}?{urllib.parse.urlencode({'q': query, 'start': 0, 'rows': rows})}"
            try:
                body = client.get(url)
            except Exception as e:
                yield k, basic, None, f"{type(e).__name__}: {e}"
                return
            yield k, basic, body, None
            seen |= _found_ids(body, key)
            if len(seen) >= rows:
                return
        if seen:
            return


def search_profiles(names: DataFrame, most: int = 12, client: Client | None = None) -> DataFrame:
    """search, place, orcid, display_name, institution, country and record_url of the profiles found for names (search, name); a failed search is one row with an error.

    The searches of one name go one after another in one task, which stops as soon as there are enough; names are dealt over client.parallel tasks.
    """
    client = client or Client("orcid_search")
    ship(names.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = (("search", pa.string()), ("ord", pa.int32()), ("basic", pa.bool_()), ("json", pa.string()), ("error", pa.string()))
        for batch in batches:
            for search, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(search, *answer) for answer in search_answers(name or "", client, most)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields])

    dealt = names.select(F.col("search").cast("string").alias("search"), "name").repartition(client.parallel)
    answers = written(dealt.mapInArrow(run, "search string, ord int, basic boolean, json string, error string"))
    failed = answers.where("error IS NOT NULL").groupBy("search").agg(F.min("error").alias("error"))
    good = answers.join(failed.select("search"), "search", "left_anti")
    return profiles(good, most, "search").unionByName(failed, allowMissingColumns=True)


def profiles(found: DataFrame, most: int = 12, key: str | None = None) -> DataFrame:
    """(key,) place, orcid, display_name, institution, country, record_url of search answers (json, ord, basic): the first 1 to 50 distinct identifiers, from basic answers only where the others give none.

    Where a name is missing the credit name is shown; an institution may be text or a list of texts. Answers of another shape give no rows.
    With a key, a column of found, its values are searches of their own.
    """
    by = key or "_all"

    def texts(path: str) -> Column:
        """Text at path, or its list of texts joined by semicolons."""
        as_list = F.array_join(F.filter(F.transform(F.try_variant_get("v", path, "array<string>"), lambda x: F.trim(x)), lambda x: x != ""), "; ")
        return F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")).startswith("ARRAY"), as_list).otherwise(F.trim(F.try_variant_get("v", path, "string")))

    def one(path: str) -> Column:
        return F.trim(F.coalesce(F.try_variant_get("v", path, "string"), F.lit("")))

    def known(*paths: str) -> Column:
        return F.get(F.filter(F.transform(F.array(*map(one, paths)), text.orcid), lambda x: x != ""), 0)

    parts = [f"$['{key}']{end}" for key in ("orcid-id", "orcid-identifier") for end in ("", ".path", ".uri")]
    answers = found.select(F.col(key).alias(by) if key else F.lit(0).alias(by), "ord", "basic", F.try_parse_json("json").alias("answer"))
    items = []
    for basic, name in ((False, "expanded-result"), (True, "result")):
        listed = F.try_variant_get("answer", f"$['{name}']", "array<variant>")
        items.append(answers.where(F.col("basic") == basic).select(by, "ord", "basic", F.posexplode(listed).alias("at", "v")))
    rows = items[0].union(items[1]).withColumn("orcid", known(*parts)).where("orcid IS NOT NULL")
    shown = F.when(F.col("basic"), "").otherwise
    full = F.concat_ws(" ", F.nullif(one("$['given-names']"), F.lit("")), F.nullif(one("$['family-names']"), F.lit("")))
    named = rows.select(
        by, "ord", "basic", "at", "orcid",
        shown(F.when(full != "", full).otherwise(one("$['credit-name']"))).alias("display_name"),
        shown(F.coalesce(F.nullif(texts("$['institution-name']"), F.lit("")), texts("$['current-institution-affiliation-name']"), F.lit(""))).alias("institution"),
        shown(one("$.country")).alias("country"),
    )
    first = named.groupBy(by, "orcid").agg(F.min_by(F.struct("basic", "ord", "at", "display_name", "institution", "country"), F.struct("basic", "ord", "at")).alias("r")).select(by, "orcid", "r.*")
    own = Window.partitionBy(by)  # a search's answers, a few hundred rows at most
    kept = first.withColumn("some", F.max(~F.col("basic")).over(own)).where("NOT (basic AND some)")
    placed = kept.withColumn("place", F.row_number().over(own.orderBy("basic", "ord", "at"))).where(F.col("place") <= max(1, min(50, most)))
    shown = placed.select(by, "place", "orcid", "display_name", "institution", "country", F.concat(F.lit("https://orcid.org/"), "orcid").alias("record_url"))
    return shown if key else shown.drop(by)
