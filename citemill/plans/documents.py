"""Queries over XML and JSON documents made from the driver tables.

Each document is one SQL expression that Spark and DuckDB both evaluate; Spark parses it, and the
SQL counterpart takes the same facts out of the text with patterns and JSON paths of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import organizations
from ..runtime import spread
from ..sources import bibliography as view
from ..sources import payloads
from ..sources import xml_records as X

KEY = "CAST(o_orderkey AS STRING)"
ARTICLE = f"""'<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>' || {KEY} || '</PMID><Article><Journal><JournalIssue><PubDate>'
  || CASE WHEN o_orderkey % 5 = 0 THEN '<MedlineDate>Winter ' || CAST(year(o_orderdate) AS STRING) || '</MedlineDate>' ELSE '<Year>' || CAST(year(o_orderdate) AS STRING) || '</Year><Month>Mar</Month>' END
  || '</PubDate></JournalIssue><Title>Long ' || o_orderpriority || '</Title>' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '<ISOAbbreviation>' || o_orderpriority || '</ISOAbbreviation>' END
  || '</Journal><ArticleTitle>Order <i>' || {KEY} || '</i>  of<b> it</b></ArticleTitle><ELocationID EIdType="pii">S1</ELocationID>'
  || CASE WHEN o_orderkey % 2 = 0 THEN '<ELocationID EIdType="doi">https://doi.org/10.5/X' || {KEY} || '</ELocationID>' ELSE '' END
  || '<AuthorList><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Last' || {KEY} || '</LastName><ForeName>Ada Bo</ForeName><Initials>AB</Initials>'
  || CASE WHEN o_orderkey % 4 = 0 THEN '<Identifier Source="ORCID">https://orcid.org/0000-0001-2345-678x</Identifier>' ELSE '' END
  || '<AffiliationInfo><Affiliation>Lab ' || o_orderpriority || '</Affiliation></AffiliationInfo></Author><Author><LastName>Next</LastName><ForeName>Cy</ForeName></Author></AuthorList>'
  || '<PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>' || CASE o_orderstatus WHEN 'F' THEN 'REVIEW' ELSE 'Letter' END || '</PublicationType></PublicationTypeList></Article>'
  || '<CommentsCorrectionsList><CommentsCorrections RefType="UpdateIn"><PMID>9' || {KEY} || '</PMID></CommentsCorrections><CommentsCorrections RefType="CommentIn"><PMID>7</PMID></CommentsCorrections></CommentsCorrectionsList>'
  || '</MedlineCitation></PubmedArticle></PubmedArticleSet>'"""
FULL_TEXT = """'<pmc-articleset><article><front><article-meta><article-id pub-id-type="pmc">' || CAST(s_suppkey AS STRING) || '</article-id><contrib-group>'
  || '<contrib contrib-type="author"><name><surname>One</surname><given-names>Ann</given-names></name><xref ref-type="aff" rid="a1"/></contrib>'
  || '<contrib contrib-type="author"><name><surname>Two</surname><given-names>Bo Cy</given-names></name><xref ref-type="aff" rid="a' || CAST(s_suppkey % 2 + 1 AS STRING) || '"/></contrib>'
  || '<contrib contrib-type="editor"><name><surname>Ed</surname></name></contrib></contrib-group>'
  || '<aff id="a1"><label>1</label>Dept of ' || s_name || '</aff><aff id="a2"><label>2</label>Lab of ' || s_name || '</aff></article-meta></front></article></pmc-articleset>'"""
WORKS = f"""'{{"group":[{{"external-ids":{{"external-id":[{{"external-id-type":"DOI","external-id-value":"10.5/RAW' || {KEY} || '","external-id-normalized":{{"value":"'
  || CASE WHEN o_orderkey % 2 = 0 THEN 'https://doi.org/10.5/N' || {KEY} ELSE '' END || '"}}}},{{"external-id-type":"PubMed","external-id-value":"PMID ' || {KEY} || '"}},{{"external-id-type":"isbn","external-id-value":"1"}}]}}}}]}}'"""
RECORD = """'{"a":[{"organization":{"name":" ' || s_name || ' Academy","address":{"country":"us"}}},{"deep":{"organization":{"name":"","address":{}}}},{"organization":{"name":"Lab","disambiguated-organization":{"disambiguated-organization-identifier":"R'
  || CAST(s_suppkey AS STRING) || '"}}}]}'"""


def orders(spark, sf_dir):
    """What documents are made of, spread before they are made: an order is far smaller than its document."""
    return spread(view.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"), "o_orderkey")


def articles(spark, sf_dir, *only):
    return X.pubmed(orders(spark, sf_dir).select(F.expr(ARTICLE).alias("document")), only=only)


def xml_citations(spark, sf_dir):
    joined = {c: F.array_join(c, "|").alias(c) for c in ("publication_types", "update_in", "update_of")}
    found = articles(spark, sf_dir, "title", "journal", "print_date", "doi", *joined)
    return found.select("pmid", "title", "journal", "print_date", "print_year", "doi", *joined.values())


def xml_authors(spark, sf_dir):
    return X.pubmed_authors(articles(spark, sf_dir, "authors")).select("pmid", "author_ord", "position", "last_name", "fore_name", "initials", "affiliation", "orcid")


def xml_contributors(spark, sf_dir):
    found = X.pmc(view.read(spark, sf_dir, "supplier").select(F.expr(FULL_TEXT).alias("document")))
    return X.pmc_contributors(found).select("pmcid", "position", "last_name", "fore_name", "initials", "affiliation")


def json_external_ids(spark, sf_dir):
    return payloads.external_ids(spark, orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.expr(WORKS).alias("json")))


def json_organizations(spark, sf_dir):
    found = payloads.organizations(spark, view.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(RECORD).alias("json")))
    return found.select("id", F.trim("name").alias("name"), "country", "identifier")


def cluster_institution_levels(spark, sf_dir):
    """The strongest level of each institution that the suppliers of a nation name, each of which has one."""
    p = view.read(spark, sf_dir, "supplier")
    level = F.element_at(F.array(*map(F.lit, organizations.LEVELS)), (F.col("s_suppkey") * 7 % 4 + 1).cast("int"))
    rows = p.select(F.col("s_nationkey").alias("cluster_id"), F.concat(F.lit("Academy "), (F.col("s_suppkey") % 11).cast("string")).alias("institution"), level.alias("level"), F.col("s_suppkey").alias("ord"))
    return organizations.cluster_levels(rows).select("cluster_id", "key", "name", "level")


QUERIES = {f.__name__: f for f in (xml_citations, xml_authors, xml_contributors, json_external_ids, json_organizations, cluster_institution_levels)}

SQL = {
    "xml_citations": f"""WITH d AS (SELECT {ARTICLE} AS x FROM orders), p AS (
      SELECT *, regexp_extract_all(x, '<PublicationType>([^<]*)<', 1) AS t, regexp_extract(x, '<PubDate>(.*?)</PubDate>', 1) AS w FROM d)
      SELECT regexp_extract(x, '<PMID>(\\d+)<', 1) AS pmid, trim(regexp_replace(regexp_replace(regexp_extract(x, '<ArticleTitle>(.*?)</ArticleTitle>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title,
        coalesce(nullif(regexp_extract(x, '<ISOAbbreviation>([^<]*)<', 1), ''), regexp_extract(x, '<Title>([^<]*)<', 1)) AS journal,
        trim(regexp_replace(replace(w, '</Year><Month>', '-'), '<[^>]*>', '', 'g')) AS print_date, regexp_extract(w, '\\d{{4}}')::INT AS print_year,
        nullif(regexp_extract(x, 'EIdType="doi">https://doi.org/([^<]*)<', 1), '') AS doi,
        CASE WHEN lower(t[1]) = lower(t[2]) THEN t[1] ELSE array_to_string(t, '|') END AS publication_types,
        regexp_extract(x, 'RefType="UpdateIn"><PMID>(\\d+)', 1) AS update_in, '' AS update_of FROM p""",
    "xml_authors": f"""WITH d AS (SELECT {ARTICLE} AS x FROM orders), s AS (
      SELECT regexp_extract(x, '<PMID>(\\d+)<', 1) AS pmid, string_split(regexp_extract(x, '<AuthorList>(.*?)</AuthorList>', 1), '<Author>')[2:] AS l FROM d),
      e AS (SELECT pmid, unnest(l) AS a, generate_subscripts(l, 1) AS position FROM s)
      SELECT pmid, row_number() OVER (PARTITION BY pmid ORDER BY position)::INT AS author_ord, position::INT AS position, regexp_extract(a, '<LastName>([^<]*)', 1) AS last_name,
        regexp_extract(a, '<ForeName>([^<]*)', 1) AS fore_name, regexp_extract(a, '<Initials>([^<]*)', 1) AS initials, regexp_extract(a, '<Affiliation>([^<]*)', 1) AS affiliation,
        upper(regexp_extract(a, '\\d{{4}}-\\d{{4}}-\\d{{4}}-\\d{{3}}[\\dx]')) AS orcid FROM e WHERE NOT contains(a, 'CollectiveName')""",
    "xml_contributors": f"""WITH d AS (SELECT {FULL_TEXT} AS x FROM supplier), s AS (
      SELECT x, 'PMC' || regexp_extract(x, '"pmc">(\\d+)', 1) AS pmcid, regexp_extract_all(x, '<contrib contrib-type="author">(.*?)</contrib>', 1) AS l FROM d),
      e AS (SELECT x, pmcid, unnest(l) AS c, generate_subscripts(l, 1) AS position FROM s)
      SELECT pmcid, position::INT AS position, regexp_extract(c, '<surname>([^<]*)', 1) AS last_name, regexp_extract(c, '<given-names>([^<]*)', 1) AS fore_name,
        regexp_replace(regexp_extract(c, '<given-names>([^<]*)', 1), '[^A-Z]', '', 'g') AS initials,
        regexp_extract(x, 'id="' || regexp_extract(c, 'rid="([^"]*)', 1) || '"><label>\\d</label>([^<]*)', 1) AS affiliation FROM e""",
    "json_external_ids": f"""WITH d AS (SELECT o_orderkey AS id, ({WORKS})::JSON AS j FROM orders),
      e AS (SELECT id, unnest(json_extract(j, '$.group[*]."external-ids"."external-id"[*]')) AS x FROM d),
      v AS (SELECT id, lower(x ->> '$."external-id-type"') AS t, coalesce(nullif(x ->> '$."external-id-normalized".value', ''), x ->> '$."external-id-value"') AS v FROM e)
      SELECT id, CASE t WHEN 'doi' THEN 'doi' ELSE 'pmid' END AS kind, CASE t WHEN 'doi' THEN lower(replace(v, 'https://doi.org/', '')) ELSE regexp_replace(v, '\\D', '', 'g') END AS value FROM v WHERE t IN ('doi', 'pubmed')""",
    "json_organizations": f"""WITH d AS (SELECT s_suppkey AS id, ({RECORD})::JSON AS j FROM supplier), e AS (SELECT id, unnest(json_extract(j, '$.a[*].organization')) AS x FROM d)
      SELECT id, trim(x ->> '$.name') AS name, coalesce(x ->> '$.address.country', '') AS country,
        coalesce(x ->> '$."disambiguated-organization"."disambiguated-organization-identifier"', '') AS identifier FROM e""",
    "cluster_institution_levels": """WITH r AS (SELECT s_nationkey AS cluster_id, 'Academy ' || (s_suppkey % 11) AS name, s_suppkey * 7 % 4 AS k, s_suppkey AS ord FROM supplier)
      SELECT cluster_id, lower(replace(name, ' ', '')) AS key, name, ['possible', 'contains', 'likely', 'verified'][k + 1] AS level
      FROM r QUALIFY row_number() OVER (PARTITION BY cluster_id, name ORDER BY k DESC, ord) = 1""",
}
