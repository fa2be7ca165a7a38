"""Identifiers and organisations in JSON payloads of unknown shape."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..runtime import ship

ID_MAP = "struct<records:array<struct<pmid:string,pmcid:string>>,articles:array<struct<pmid:string,pmcid:string>>,response:struct<records:array<struct<pmid:string,pmcid:string>>>>"


def id_map(payloads: DataFrame) -> DataFrame:
    """pmid, pmcid and ord of id-map payloads (json, ord): the first of records, articles and response.records that is there."""
    read = payloads.select("ord", F.from_json("json", ID_MAP).alias("p"))
    each = read.select("ord", F.posexplode(F.coalesce("p.records", "p.articles", "p.response.records")).alias("i", "r"))
    return each.select(F.trim("r.pmid").alias("pmid"), text.pmcid(F.col("r.pmcid")).alias("pmcid"), F.struct("ord", "i").alias("ord")).where("pmid <> '' AND pmcid <> ''")


def _nodes(root) -> Iterator[tuple[str, str, object]]:
    """Path (places from the root, which sort in order of appearance), key and value of every node; a list's elements have its key."""
    waiting = [("", "", root)]
    while waiting:
        path, key, value = waiting.pop()
        yield path, key, value
        if isinstance(value, dict):
            waiting += [(f"{path}/{i:012d}", k, v) for i, (k, v) in enumerate(value.items())]
        elif isinstance(value, list):
            waiting += [(f"{path}/{i:012d}", key, v) for i, v in enumerate(value)]


def _walked(payloads: DataFrame, pick: Callable[[str, str, object], Iterator[tuple]], fields: str) -> DataFrame:
    """id and fields: what pick takes from the nodes of each payload (id, json); text that is no JSON, or is nested beyond what Python reads, gives nothing."""
    ship(payloads.sparkSession)
    schema = T.StructType([payloads.schema["id"], *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                try:
                    root = json.loads(own or "")
                except (ValueError, RecursionError):
                    continue
                for node in _nodes(root):
                    for row in pick(*node):
                        ids.append(i)
                        rows.append(row)
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], schema.names)

    return payloads.select("id", "json").mapInArrow(run, schema)


def _text(value) -> str:
    """A value as text; nothing for null, lists and objects."""
    return "" if value is None or isinstance(value, (dict, list)) else str(value).lower() if isinstance(value, bool) else str(value)


def _at(value, *keys: str) -> str:
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return _text(value)


def pmids(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """id, pmid: every identifier under a key pmid or pmids at any depth; positive whole numbers, digit runs in strings, and lists of them."""

    def pick(path: str, key: str, value) -> Iterator[tuple]:
        if key.lower() in ("pmid", "pmids"):
            if isinstance(value, str):
                yield from ((x,) for x in re.findall(r"[0-9]+", value))
            elif isinstance(value, int) and not isinstance(value, bool) and value > 0:
                yield (str(value),)

    return _walked(payloads, pick, "pmid string").distinct()


def organizations(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """id, ord (order of appearance), name, country and identifier of every organization object at any depth."""

    def pick(path: str, key: str, value) -> Iterator[tuple]:
        if key == "organization" and isinstance(value, dict) and _at(value, "name").strip():
            yield path, _at(value, "name"), _at(value, "address", "country"), _at(value, "disambiguated-organization", "disambiguated-organization-identifier")

    return _walked(payloads, pick, "ord string, name string, country string, identifier string")


def external_ids(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """id, kind (doi, pmid, pmcid), value of every external identifier at any depth; the normalised value is preferred."""

    def pick(path: str, key: str, value) -> Iterator[tuple]:
        if key == "external-id" and isinstance(value, dict):
            own = _at(value, "external-id-normalized", "value").strip() or _at(value, "external-id-value").strip()
            yield _at(value, "external-id-type").strip().lower(), own

    found = _walked(payloads, pick, "type string, value string")
    kind = F.when(F.col("type") == "doi", "doi").when(F.col("type").isin("pmid", "pubmed", "pubmed-id"), "pmid").when(F.col("type").isin("pmc", "pmcid", "pmc-id", "pubmed-central", "pubmed-central-id"), "pmcid")
    value = F.when(kind == "doi", text.record_doi(F.col("value"))).when(kind == "pmid", text.pmid(F.col("value"))).otherwise(text.pmcid(F.col("value")))
    return found.select("id", kind.alias("kind"), value.alias("value")).where("kind IS NOT NULL AND value <> ''").distinct()
