"""Queries over citations put together from two records, and their SQL counterparts.

The second record of a citation is made from the first: every second citation has a full text, of which some cannot be had, some lack
surnames, some hold one author more or less, some have a given name in the surname; every third author has no affiliation there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly, badges, identity, organizations, review
from ..operators.counts import RunCounts
from ..runtime import written
from ..sources import bibliography as view
from ..sources import workbook
from ..sources import xml_records as X
from . import publication, publication_sql, scalars
from .documents import ARTICLE, KEY
from .documents import orders as spread_orders

TEXT_LAST = "CASE WHEN ord % 5 = 0 THEN ' ' WHEN ord % 4 = 0 THEN split_part(fore_name, ' ', 2) || ' ' || last_name ELSE last_name END"
TEXT_FORE = "CASE WHEN ord % 4 = 0 THEN split_part(fore_name, ' ', 1) ELSE fore_name END"
#: Full texts that cannot be had, and those of which nothing is known.
FAILED, ABSENT = "ord % 7 = 3", "ord % 11 = 5"
#: A full text in XML for every second order: notes on roles, a third author for some, no surnames for some, a DOI for some.
FULL = f"""'<article><front><article-meta><article-id pub-id-type="pmc">' || {KEY} || '</article-id>'
  || CASE WHEN o_orderkey % 4 = 0 THEN '<article-id pub-id-type="doi">doi: 10.7/T' || {KEY} || '.</article-id>' ELSE '' END || '<contrib-group>'
  || '<contrib contrib-type="author"><collab>Group</collab></contrib>'
  || '<contrib contrib-type="author"><name><surname>' || CASE WHEN o_orderkey % 6 = 0 THEN 'Bo Last' ELSE 'Last' END || {KEY} || '</surname><given-names>' || CASE WHEN o_orderkey % 6 = 0 THEN 'Ada B' ELSE 'Ada Bo' END || '</given-names></name><xref ref-type="fn" rid="n1"/></contrib>'
  || '<contrib contrib-type="author"><name><surname>Next</surname><given-names>Cy</given-names></name><xref ref-type="aff" rid="a1"/><xref ref-type="fn" rid="n1"/></contrib>'
  || CASE WHEN o_orderkey % 10 = 0 THEN '<contrib contrib-type="author"><name><surname>Third</surname><given-names>Di</given-names></name></contrib>' ELSE '' END
  || '</contrib-group><aff id="a1"><label>1</label>Hall of ' || o_orderpriority || '</aff><author-notes><fn id="n1"><p>'
  || CASE WHEN o_orderkey % 8 = 0 THEN 'Jointly supervised the work' ELSE 'These authors contributed equally' END || '</p></fn></author-notes></article-meta></front></article>'"""


def _full_texts(spark, sf_dir) -> DataFrame:
    a = view.authors(spark, sf_dir).where("ord % 2 = 0").where(f"NOT ({FAILED}) AND NOT ({ABSENT})")
    none = F.array().cast("array<string>")
    blocks = F.when(F.col("position") % 3 == 0, none).otherwise(F.array(F.concat(F.lit("Text of "), "affiliation")))
    shown = a.select("ord", "position", F.expr(TEXT_LAST).alias("last_name"), F.expr(TEXT_FORE).alias("fore_name"), "initials", blocks.alias("blocks"), F.lit("").alias("orcid"), F.expr("NOT (ord % 10 = 2 AND position = 2)").alias("listed"))
    more = a.where("ord % 6 = 4").groupBy("ord").agg((F.max("position") + 1).alias("position"))
    extra = more.select("ord", "position", F.when(F.col("ord") % 5 == 0, " ").otherwise("Extra"), F.lit("New"), F.lit("N"), none, F.lit(""), F.lit(True))
    # A full text stays one where it lists none of its authors.
    people = assembly.author_list(shown.union(extra), "ord", F.col("listed"))
    doi = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("10.2000/"), "ord")).otherwise("")
    return people.select(F.concat(F.lit("PMC"), "ord").alias("pmcid"), doi.alias("doi"), "authors", F.array(F.lit(1)).alias("co_first"), F.array().cast("array<int>").alias("co_senior"))


def _shown(df: DataFrame) -> DataFrame:
    numbers = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",").alias(c)
    return df.select("pmid", "pmcid", "doi", "author_count", numbers("co_first"), numbers("co_senior"), "source_for_roles", F.array_join("notes", "; ").alias("notes"), assembly.shown(F.col("authors")).alias("authors"))


def citation_assembly(spark, sf_dir):
    c = view.citations(spark, sf_dir).select("pmid", "ord", F.when(F.col("ord") % 9 != 0, F.col("doi")).alias("doi"), "pmcid")
    people = assembly.author_list(view.authors(spark, sf_dir), "pmid").withColumnRenamed("pmid", "a_pmid")
    cites = c.join(people, F.col("pmid") == F.col("a_pmid"), "left").select("pmid", "doi", "authors")
    ids = c.where("pmcid IS NOT NULL").select("pmid", "pmcid", F.lit(1).alias("ord"))
    failures = c.where(f"pmcid IS NOT NULL AND {FAILED}").select("pmcid", F.lit("HTTPError: 502").alias("error"))
    unmapped = c.where("ord % 13 = 0").select("pmid", F.lit("timed out").alias("error"))
    return _shown(assembly.citations(cites, ids, _full_texts(spark, sf_dir), failures, unmapped))


def xml_assembly(spark, sf_dir):
    orders = spread_orders(spark, sf_dir)
    cites = assembly.index_records(X.pubmed(orders.select(F.expr(ARTICLE).alias("document")), only=("doi", "authors", "article_blocks")))
    articles = assembly.full_texts(X.pmc(orders.where("o_orderkey % 2 = 0").select(F.expr(FULL).alias("document"))))
    ids = orders.where("o_orderkey % 2 = 0 OR o_orderkey % 5 = 0").select(F.expr(KEY).alias("pmid"), F.expr(f"'PMC' || {KEY}").alias("pmcid"), F.lit(1).alias("ord"))
    return _shown(assembly.citations(cites.select("pmid", "doi", "authors"), ids, articles))


def run_counts(spark, sf_dir):
    """The counts of one run: citations, authors, matches, clusters and changed affiliations, taken from the tables as the run reads them."""
    counts = RunCounts()
    authors = written(counts.of("authors", view.authors(spark, sf_dir)))  # read three times
    found = identity.mentions(authors, F.broadcast(identity.targets(spark, {"t": publication.SHORT})))  # one target
    matches = written(counts.of("matches", identity.with_cluster(found.withColumn("institutions", F.col("blocks")))))
    written(counts.of("clusters", identity.clusters(identity.merged(matches), counts.of("citations", view.citations(spark, sf_dir).select("ord", "print_year")))))
    written(counts.of("changed affiliations", scalars.cleaned(authors).select("pmid", "position", "affiliation", "changed"), F.col("changed")).drop("changed"))
    return spark.createDataFrame(sorted(counts.get().items()), "name string, n long")


def report_workbook(spark, sf_dir):
    """Rows, cells and links of a report's workbook."""
    c = view.citations(spark, sf_dir)
    cites = c.select("pmid", "pmcid", "doi", F.concat(F.lit("Order <"), "pmid", F.lit(">")).alias("title"), "journal", F.col("print_year").alias("print_date"), F.lit("A B").alias("authors"), "publication_types")
    found = workbook.workbook_rows(review.report(publication.target_rows(spark, sf_dir)), cites)
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.coalesce(F.try_element_at("links", k), F.lit("-"))), " ")
    return found.select("row", F.array_join("cells", "|").alias("cells"), links.alias("links"))


def record_badges(spark, sf_dir):
    """How every citation stands to a record that holds some of them by identifier, and to affiliations of some more."""
    c = view.citations(spark, sf_dir)
    record = c.where("ord % 7 = 0").select(F.lit("doi").alias("kind"), F.upper("doi").alias("value")).union(c.where("ord % 11 = 0").select(F.lit("pmid"), "pmid"))
    level = F.element_at(F.array(*map(F.lit, organizations.LEVELS)), (F.col("ord") % 4 + 1).cast("int"))
    places = c.where("ord % 5 = 0").select("pmid", F.upper(level).alias("level"), F.lit("Academy").alias("institution"), F.when(F.col("ord") % 2 == 0, "").otherwise("match (Academy)").alias("label"))
    tags = F.array_compact(F.array(F.when(F.col("ord") % 3 == 0, "litsense"), F.when(F.col("ord") % 2 == 0, "user"), F.when(F.col("ord") % 5 == 0, "other")))
    rows = c.select("pmid", F.array_join(F.transform(badges.source_badges(tags), lambda b: F.concat_ws(":", b["label"], b["class"], b["title"])), "; ").alias("sources"))
    found = badges.record_fields(rows, organizations.identifier_matches(c, record), places, "0000000000000007")
    return found.drop("match_types")


QUERIES = {f.__name__: f for f in (citation_assembly, xml_assembly, run_counts, report_workbook, record_badges)}

_ONE = "concat_ws('|', position::VARCHAR, last_name, fore_name, initials, blocks, orcid)"
SQL = {
    "citation_assembly": f"""WITH {view.VIEW_SQL.strip()},
      c AS (SELECT pmid, ord, CASE WHEN ord % 9 <> 0 THEN doi END AS doi, CASE WHEN ord % 2 = 0 AND ord % 13 <> 0 THEN 'PMC' || ord END AS pmcid, ord % 13 = 0 AS unmapped,
        author_count AS n FROM citations),
      s AS (SELECT *, pmcid IS NOT NULL AND NOT ({FAILED}) AND NOT ({ABSENT}) AND n > 0 AS have FROM c),
      own AS (SELECT s.ord, have, a.position, a.last_name, a.fore_name, a.initials, a.affiliation AS blocks, a.orcid FROM s JOIN authors a ON a.ord = s.ord),
      t AS (SELECT ord, position, {TEXT_LAST} AS last_name, {TEXT_FORE} AS fore_name, initials, CASE WHEN position % 3 = 0 THEN '' ELSE trim('Text of ' || blocks) END AS blocks, orcid,
          blocks AS own_blocks, last_name AS own_last, fore_name AS own_fore
        FROM own WHERE have AND NOT (ord % 10 = 2 AND position = 2)
        UNION ALL SELECT ord, max(position) + 1, CASE WHEN ord % 5 = 0 THEN ' ' ELSE 'Extra' END, 'New', 'N', '', '', '', '', '' FROM own WHERE have AND ord % 6 = 4 GROUP BY ord),
      chosen AS (SELECT ord, position, CASE WHEN ord % 4 = 0 AND own_last <> '' THEN own_last ELSE last_name END AS last_name, CASE WHEN ord % 4 = 0 AND own_last <> '' THEN own_fore ELSE fore_name END AS fore_name,
          initials, CASE WHEN blocks = '' THEN own_blocks ELSE blocks END AS blocks, CASE WHEN ord % 4 = 0 THEN orcid ELSE '' END AS orcid, blocks = '' AND own_blocks <> '' AS filled, 'text' AS kind FROM t WHERE ord % 5 <> 0
        UNION ALL SELECT o.ord, o.position, o.last_name, o.fore_name, o.initials, CASE WHEN o.blocks = '' THEN coalesce(t.blocks, '') ELSE o.blocks END, o.orcid, o.blocks = '' AND coalesce(t.blocks, '') <> '', 'kept'
          FROM own o LEFT JOIN t ON t.ord = o.ord AND t.position = o.position WHERE NOT o.have OR o.ord % 5 = 0),
      g AS (SELECT ord, count(*) AS n, count(*) FILTER (filled) AS filled, min(kind) AS kind, string_agg({_ONE}, ' / ' ORDER BY position) AS authors FROM chosen GROUP BY ord),
      tn AS (SELECT ord, count(*) AS tn FROM t GROUP BY ord),
      d AS (SELECT s.*, coalesce(nullif(s.doi, ''), CASE WHEN have AND s.ord % 3 = 0 THEN '10.2000/' || s.ord END) AS final FROM s)
      SELECT d.pmid, d.pmcid, d.final AS doi, coalesce(g.n, 0)::INT AS author_count, CASE WHEN have THEN '1' ELSE '' END AS co_first, '' AS co_senior,
        CASE WHEN have THEN 'pmc' ELSE 'pubmed' END AS source_for_roles,
        concat_ws('; ', CASE WHEN unmapped THEN 'PMCID mapping failed: timed out' END, CASE WHEN pmcid IS NULL THEN 'No PMCID mapping' END,
          CASE WHEN tn > 0 AND tn <> d.n THEN 'PMC author count mismatch (PMC ' || tn || ' vs PubMed ' || d.n || ')' END,
          CASE WHEN have AND kind = 'text' THEN 'Author metadata sourced from PMC' END,
          CASE WHEN have AND filled > 0 THEN 'Filled ' || filled || CASE kind WHEN 'text' THEN ' affiliation(s) from PubMed fallback' ELSE ' affiliation(s) from PMC' END END,
          CASE WHEN have AND kind = 'kept' THEN 'PMC author metadata incomplete; kept PubMed author list' END,
          CASE WHEN pmcid IS NOT NULL AND NOT have THEN 'PMC fetch/parse failed: ' || CASE WHEN {FAILED.replace('ord', 'd.ord')} THEN 'HTTPError: 502' ELSE 'PMC XML unavailable for ' || pmcid END END,
          CASE WHEN pmcid IS NOT NULL AND final IS NULL THEN 'DOI not found in PubMed/PMC metadata' END) AS notes, coalesce(g.authors, '') AS authors
      FROM d LEFT JOIN g ON g.ord = d.ord LEFT JOIN tn ON tn.ord = d.ord""",
    "xml_assembly": f"""WITH o AS (SELECT o_orderkey AS k, {KEY} AS pmid, o_orderpriority AS p, o_orderkey % 2 = 0 AS have, o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 AS mapped,
        o_orderkey % 10 = 0 AS third FROM orders),
      f AS (SELECT *, CASE WHEN k % 2 = 0 THEN '10.5/X' || k END AS doi, 'Lab ' || p AS lab FROM o)
      SELECT pmid, CASE WHEN mapped THEN 'PMC' || k END AS pmcid, doi, CASE WHEN NOT have THEN 2 WHEN third THEN 4 ELSE 3 END AS author_count,
        '' AS co_first, CASE WHEN have AND (k % 8 = 0 OR NOT third) THEN '2,3' ELSE '' END AS co_senior,
        CASE WHEN have THEN 'pmc' ELSE 'pubmed' END AS source_for_roles,
        CASE WHEN NOT mapped THEN 'No PMCID mapping' WHEN NOT have THEN 'PMC fetch/parse failed: PMC XML unavailable for PMC' || k || '; DOI not found in PubMed/PMC metadata'
          ELSE 'PMC author count mismatch (PMC ' || CASE WHEN third THEN 4 ELSE 3 END || ' vs PubMed 2); Author metadata sourced from PMC; Filled 1 affiliation(s) from PubMed fallback' END AS notes,
        CASE WHEN NOT have THEN '2|Last' || k || '|Ada Bo|AB|' || lab || '|' || CASE WHEN k % 4 = 0 THEN '0000-0001-2345-678X' ELSE '' END || ' / 3|Next|Cy||' || lab || '|'
          ELSE '1|Group||||' || ' / 2|Last' || k || '|Ada Bo|AB|' || lab || '|' || CASE WHEN k % 6 = 0 AND k % 4 = 0 THEN '0000-0001-2345-678X' ELSE '' END
            || ' / 3|Next|Cy|C|Hall of ' || p || '|' || CASE WHEN third THEN ' / 4|Third|Di|D||' ELSE '' END END AS authors FROM f""",
    "run_counts": f"""SELECT 'citations' AS name, count(*) AS n FROM orders UNION ALL SELECT 'authors', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
      UNION ALL SELECT 'matches', count(*) FROM ({publication_sql.SQL['match_author_initials']}) UNION ALL SELECT 'clusters', count(*) FROM ({publication_sql.SQL['clusters']})
      UNION ALL SELECT 'changed affiliations', count(*) FILTER (changed) FROM ({scalars.SQL['affiliation_clean']})""",
    "report_workbook": f"""WITH r AS ({publication_sql.SQL['report_rows']}), o AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS pmid, o_orderpriority AS j, year(o_orderdate) AS y, o_orderkey % 2 = 0 AS p,
        CASE o_orderstatus WHEN 'F' THEN 'Journal Article' WHEN 'O' THEN 'Review' WHEN 'P' THEN 'Preprint' END AS t FROM orders)
      SELECT row_number() OVER (ORDER BY bucket, idx, pmid) + 1 AS row,
        concat_ws('|', 'PMID ' || pmid || CASE WHEN p THEN ' | PMC' || pmid ELSE '' END, 'PubMed', CASE WHEN p THEN 'PMC' ELSE '' END, '10.1000/' || (k // 2), 'Order <' || pmid || '>', j, y::VARCHAR, 'A B', t, category) AS cells,
        'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/ ' || CASE WHEN p THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || pmid || '/' ELSE '-' END || ' https://doi.org/10.1000/' || (k // 2) AS links
      FROM r JOIN o USING (pmid)""",
    "record_badges": f"""WITH {view.VIEW_SQL.strip()}, d AS (SELECT doi FROM citations WHERE ord % 7 = 0),
      k AS (SELECT pmid, ord, concat_ws('/', CASE WHEN doi IN (SELECT doi FROM d) THEN 'DOI' END, CASE WHEN ord % 11 = 0 THEN 'PMID' END) AS label,
        CASE WHEN ord % 5 = 0 THEN ['possible', 'contains', 'likely', 'verified'][ord % 4 + 1] ELSE '' END AS lv, CASE WHEN ord % 5 = 0 AND ord % 2 = 1 THEN 'match (Academy)' ELSE '' END AS al FROM citations)
      SELECT pmid, concat_ws('; ', CASE WHEN ord % 2 = 0 THEN 'user:source-badge source-user:Citation added from user file' END, CASE WHEN ord % 3 = 0 THEN 'litsense:source-badge source-litsense:Citation added from LitSense' END) AS sources,
        label <> '' AS verified, label AS match_label, al <> '' AS affiliation_verified, lv AS affiliation_level, al AS affiliation_label, CASE WHEN ord % 5 = 0 THEN 'Academy' ELSE '' END AS affiliation_institution,
        label <> '' AS badge_show, 'orcid-badge' AS badge_class,
        CASE WHEN label <> '' THEN 'Citation added from ORCiD record (matched by ' || label || ')' WHEN lv = '' THEN 'ORCiD match' WHEN al <> '' THEN 'ORCiD affiliation ' || lv || ': ' || al ELSE 'ORCiD affiliation ' || lv || ' match' END AS badge_title,
        CASE WHEN label <> '' THEN 'https://orcid.org/0000-0000-0000-0007' END AS record_url FROM k""",
}
