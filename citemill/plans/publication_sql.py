"""DuckDB SQL for the queries of publication.py."""

from __future__ import annotations

from ..sources.bibliography import VIEW_SQL
from .publication import END, INSTITUTE, START, WORDS

TOKEN = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
BLOCKS = "list_filter(list_transform(string_split_regex(affiliation, '[;|]+'), lambda x: trim(x)), lambda x: x <> '')"


def _mentions(style: str, orcid: str = "") -> str:
    first = "split_part(lower(fore_name), ' ', 1)"
    by_name = (
        f"CASE WHEN starts_with(lower(initials), 'r') OR starts_with('r', lower(initials)) THEN 'initials' END"
        if style == "initials"
        else f"CASE WHEN {first} = 'red' THEN 'given' WHEN length({first}) > 1 THEN NULL WHEN starts_with(lower(initials), 'r') THEN 'initials' END"
    )
    own = f"WHEN '{orcid}' <> '' AND orcid <> '' THEN CASE WHEN orcid = '{orcid}' THEN 'orcid' END"
    return f"""
m0 AS (SELECT *, CASE {own} WHEN {TOKEN.format('last_name')} = 'brand17' THEN {by_name} END AS method FROM authors),
m1 AS (SELECT *, {BLOCKS} AS blocks FROM m0 WHERE method IS NOT NULL
  QUALIFY max((method = 'orcid')::INT) OVER (PARTITION BY ord) = 0 OR method = 'orcid'),
m2 AS (SELECT *, list_sort(list_distinct(list_transform(blocks, lambda x: {TOKEN.format('x')}))) AS ks,
  {TOKEN.format('last_name')} || '|' || lower(initials) AS name_key FROM m1),
m3 AS (SELECT *, CASE WHEN method = 'orcid' THEN 'orcid:' || orcid WHEN len(ks) = 0 THEN name_key || '|no-affiliation|pmid:' || pmid
  ELSE name_key || '|' || left(array_to_string(ks, '|'), 120) END AS first_id, CASE WHEN method = 'orcid' THEN [] ELSE ks END AS keys FROM m2),
sizes AS (SELECT name_key, first_id, count(*) AS n, any_value(keys) AS keys FROM m3 WHERE len(keys) > 0 GROUP BY ALL),
edges AS (SELECT a.first_id, b.first_id AS merged_id FROM sizes a JOIN sizes b ON a.name_key = b.name_key AND len(a.keys) < len(b.keys)
  AND list_has_all(b.keys, a.keys) AND b.n >= a.n
  QUALIFY row_number() OVER (PARTITION BY a.first_id ORDER BY b.n DESC, len(b.keys) DESC, b.first_id DESC) = 1),
mentions AS (SELECT m3.*, coalesce(merged_id, m3.first_id) AS cluster_id, min(ord * 1000 + position) OVER (PARTITION BY m3.first_id) AS member
  FROM m3 LEFT JOIN edges USING (first_id))"""


SUPERSEDED = """
later AS (SELECT p.pmid, array_to_string(list_transform(list_sort(list(r.ord)), lambda x: x::VARCHAR), ',') AS later
  FROM citations p JOIN citations r ON p.doi = r.doi AND r.kind <> 'Preprint' AND p.pmid <> r.pmid WHERE p.kind = 'Preprint' GROUP BY p.pmid)"""


def _rows(style: str = "full", orcid: str = "") -> str:
    return f"""WITH {VIEW_SQL}, {_mentions(style, orcid)}, {SUPERSEDED},
per AS (SELECT pmid, count(*) AS n, list(position) AS positions, list(method) AS methods FROM mentions GROUP BY pmid),
r0 AS (SELECT c.*, per.*  EXCLUDE (pmid), coalesce(later, '') AS superseded_by, list_contains(methods, 'orcid') AS sure, kind = 'Review' AS is_review, kind = 'Preprint' AS is_preprint,
  list_contains(positions, 1) AS counted_first, list_contains(positions, author_count) AS counted_senior
  FROM citations c JOIN per ON c.pmid = per.pmid LEFT JOIN later ON later.pmid = c.pmid WHERE print_year BETWEEN {START} AND {END}),
r1 AS (SELECT *, list_filter([CASE WHEN n > 1 AND NOT sure THEN 'multiple matching authors with same/similar name' END,
    CASE WHEN list_contains(methods, 'initials') AND NOT sure THEN 'matched by initials fallback' END,
    CASE WHEN source_for_roles = 'pubmed' THEN 'PMC missing; co-first/co-senior not detectable' END], lambda x: x IS NOT NULL) AS reasons FROM r0),
rows AS (SELECT *, NOT is_review AND NOT is_preprint AS counted_overall, is_review AND counted_senior AS counted_review_senior,
  len(reasons) = 0 AND superseded_by = '' AS include,
  (row_number() OVER (ORDER BY print_year IS NULL, print_year DESC, lower(journal), ord) - 1)::BIGINT AS idx FROM r1)"""


SUBTOTALS = """
y AS (SELECT journal, print_year, count(*) AS n FROM rows WHERE include AND counted_overall AND (counted_first OR counted_senior) GROUP BY ALL),
sub AS (SELECT journal, sum(n)::BIGINT AS publications, string_agg(CASE WHEN n > 1 THEN n || 'x' ELSE '' END || print_year, ', ' ORDER BY print_year) AS detail FROM y GROUP BY journal)"""
TOTALS = """SELECT count(*) FILTER (include AND counted_overall) AS total,
  count(*) FILTER (include AND counted_overall AND (counted_first OR counted_senior)) AS first_senior,
  count(*) FILTER (include AND counted_review_senior) AS review_senior, count(*) FILTER (include AND is_preprint) AS preprints,
  count(*) FILTER (superseded_by <> '') AS superseded_preprints FROM rows"""
REASON = f"""
x AS (SELECT *, CASE WHEN print_year NOT BETWEEN {START} AND {END} THEN 'Outside year window {START}-{END} (year: ' || print_year || ')'
  WHEN kind = 'Preprint' THEN 'Excluded by publication type: preprint' END AS excluded_reason FROM citations)"""
PLACED = "a0 AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY position) AS author_ord, count(*) OVER (PARTITION BY pmid) AS author_count FROM authors)"
MODES = """
modes(mode, m_include, m_overall, m_senior, m_review_senior, m_review, m_preprint) AS (VALUES
  ('exclude', false, false, false, false, false, false), ('first_senior_author', true, true, true, false, false, false),
  ('coauthor_review', true, false, false, false, true, false), ('first_senior_preprint', true, false, true, false, false, true)),
fix AS (SELECT pmid, modes.* FROM citations JOIN modes ON mode = ['exclude', 'first_senior_author', 'coauthor_review', 'first_senior_preprint', 'unknown'][ord % 5 + 1] WHERE ord % 2 = 0)"""
FIXED = """coalesce(CASE WHEN {hit} THEN m_include END, included) AS include, coalesce(CASE WHEN {hit} THEN m_overall END, counted_overall) AS counted_overall,
  CASE WHEN {hit} AND m_include IS NOT NULL THEN false ELSE counted_first END AS counted_first, coalesce(CASE WHEN {hit} THEN m_senior END, counted_senior) AS counted_senior,
  coalesce(CASE WHEN {hit} THEN m_review_senior END, counted_review_senior) AS counted_review_senior, coalesce(CASE WHEN {hit} THEN m_review END, is_review) AS is_review,
  coalesce(CASE WHEN {hit} THEN m_preprint END, is_preprint) AS is_preprint"""
SELECTION = f"""
lab AS (SELECT cluster_id, arg_min(last_name || ', ' || fore_name, member * 10000000000 + ord * 1000 + position) AS label FROM mentions GROUP BY cluster_id),
sel AS (SELECT pmid, string_agg(DISTINCT label, ' | ' ORDER BY label) AS cluster_labels, string_agg(DISTINCT affiliation, ' | ' ORDER BY affiliation) FILTER (affiliation <> '') AS affs,
  string_agg(DISTINCT position::VARCHAR, ',' ORDER BY position::VARCHAR) AS positions, count(DISTINCT position) AS np, bool_or(method = 'initials') AS bi
  FROM mentions JOIN lab USING (cluster_id) GROUP BY pmid),
s1 AS (SELECT c.pmid, print_year, journal, source_for_roles, cluster_labels, positions, coalesce(affs, '(no affiliation listed)') AS affiliations,
  concat_ws('; ', CASE WHEN affs IS NULL THEN 'No affiliation listed for matched author' END, CASE WHEN np > 1 THEN 'Multiple matched author positions in citation' END,
    CASE WHEN bi THEN 'Matched by initials fallback' END) AS review_reason FROM sel JOIN citations c USING (pmid))"""
ASSEMBLED = """
asm AS (SELECT pmid, pmcid, CASE WHEN ord % 4 = 0 THEN 'pmc' ELSE 'pubmed' END AS source_for_roles,
  CASE WHEN pmcid IS NULL THEN 'PMCID not found' WHEN ord % 4 = 0 THEN 'Author metadata sourced from PMC' ELSE 'PMC fetch/parse failed' END AS notes FROM citations)"""
V = f"WITH {VIEW_SQL}"
M = f"{V}, {_mentions('initials')}"
COUNTED = """CASE WHEN is_preprint THEN CASE WHEN counted_first OR counted_senior THEN {a} ELSE {b} END
  WHEN is_review THEN CASE WHEN counted_senior OR counted_review_senior THEN {c} ELSE {d} END WHEN counted_first OR counted_senior THEN {e} ELSE {f} END"""

SQL = {
    "flagship_publication_summary": f"{_rows()} {TOTALS}",
    "journal_subtotals": f"{_rows()}, {SUBTOTALS} SELECT * FROM sub",
    "summary_line": f"""{_rows()}, {SUBTOTALS}, t AS ({TOTALS}), d AS (SELECT string_agg(publications || ' ' || journal || ' ' || detail, '; ' ORDER BY publications DESC, lower(journal)) AS detail FROM sub)
      SELECT 'Peer-reviewed Publications ({START}-{END}): ' || total || ' total, ' || first_senior || ' 1st/Sr author (' || coalesce(detail, 'none') || '). In addition: ' || review_senior || ' review(s) as Sr author; '
      || preprints || ' preprint(s).' || CASE WHEN superseded_preprints > 0 THEN ' Excluded as superseded by a peer-reviewed version: ' || superseded_preprints || ' preprint(s).' ELSE '' END AS report FROM t, d""",
    "match_author_full": f"{V}, {_mentions('full')} SELECT pmid, position, method FROM m1",
    "match_author_initials": f"{M} SELECT pmid, position, method FROM m1",
    "match_author_orcid": f"{V}, {_mentions('full', '0000-0000-0000-0007')} SELECT pmid, position, method FROM m1",
    "fingerprint": f"""{V} SELECT pmid, position, CASE WHEN affiliation = '' THEN 'no-affiliation' ELSE
      left(array_to_string(list_sort(list_distinct(list_transform({BLOCKS}, lambda x: {TOKEN.format('x')}))), '|'), 120) END AS fingerprint FROM authors""",
    "clusters": f"""{M} SELECT cluster_id, arg_min(last_name || ', ' || fore_name, member * 10000000000 + ord * 1000 + position) AS label, count(*) AS mention_count,
      row_number() OVER (ORDER BY count(*) DESC, min(member * 10000000000 + ord * 1000 + position)) AS rank FROM mentions GROUP BY cluster_id""",
    "cluster_years": f"""{M}, cy AS (SELECT DISTINCT cluster_id, print_year FROM mentions JOIN citations USING (pmid))
      SELECT cluster_id, string_agg(print_year::VARCHAR, ',' ORDER BY print_year) AS years FROM cy GROUP BY cluster_id""",
    "cluster_labels": f"""{M}, u AS (SELECT cluster_id, unnest(CASE WHEN len(blocks) = 0 THEN ['(no affiliation listed)'] ELSE blocks END) AS b FROM mentions),
      d AS (SELECT DISTINCT cluster_id, b FROM u) SELECT cluster_id, string_agg(b, ' | ' ORDER BY lower(b)) AS affiliations FROM d GROUP BY cluster_id""",
    "cluster_subset_edges": f"{M} SELECT first_id AS cluster_id, merged_id FROM edges",
    "cluster_merge": f"{M} SELECT pmid, position, first_id, cluster_id FROM mentions",
    "superseded_preprints": f"{V}, {SUPERSEDED} SELECT * FROM later",
    "type_filter": f"{V} SELECT pmid, lower(kind) AS hit FROM citations WHERE kind IN ('Review', 'Preprint')",
    "review_preprint_flags": f"{V} SELECT pmid, kind = 'Review' AS is_review, kind = 'Preprint' AS is_preprint FROM citations",
    "year_window": f"{V} SELECT pmid, print_year BETWEEN {START} AND {END} AS in_window FROM citations",
    "excluded_reason": f"{V}, {REASON} SELECT pmid, excluded_reason FROM x WHERE excluded_reason IS NOT NULL",
    "excluded_partition": f"{V}, {REASON} SELECT CASE WHEN excluded_reason LIKE 'Outside%' THEN 'window' ELSE 'type' END AS class, count(*) AS n FROM x WHERE excluded_reason IS NOT NULL GROUP BY 1",
    "excluded_rows": f"{M}, {REASON} SELECT pmid, print_year, excluded_reason FROM x WHERE excluded_reason IS NOT NULL AND pmid IN (SELECT pmid FROM mentions)",
    "out_of_window": f"{V}, {REASON} SELECT pmid, print_year, journal FROM x WHERE excluded_reason LIKE 'Outside%'",
    "affiliation_blocks": f"{V} SELECT pmid, position, array_to_string({BLOCKS}, '|') AS blocks FROM authors",
    "shared_affiliation_fill": f"""{V}, b AS (SELECT *, {BLOCKS} AS blocks FROM authors), u AS (SELECT pmid, unnest(blocks) AS block FROM b),
      o AS (SELECT pmid, min(block) AS one FROM u GROUP BY pmid HAVING count(DISTINCT block) = 1)
      SELECT b.pmid, position, CASE WHEN len(blocks) = 0 THEN coalesce(one, '') ELSE array_to_string(blocks, '|') END AS blocks FROM b LEFT JOIN o ON b.pmid = o.pmid""",
    "role_inference": f"""{V}, {PLACED}, n AS (SELECT pmid, ord, any_value(author_count) AS c, list_sort(list(author_ord)) AS ps FROM a0 WHERE suppkey % 2 = 0 GROUP BY ALL),
      f AS (SELECT *, ord % 5 = 0 AS senior, ps[1] = 1 AND ps[-1] = len(ps) AS pre, ps[-1] = c AND ps[-1] - ps[1] + 1 = len(ps) AS suf FROM n)
      SELECT pmid, CASE WHEN NOT senior AND pre AND NOT suf THEN array_to_string(ps, ',') ELSE '' END AS co_first,
        CASE WHEN senior OR (suf AND NOT pre) THEN array_to_string(ps, ',') ELSE '' END AS co_senior FROM f""",
    "affiliation_backfill": f"""{V} SELECT a.pmid, a.position, CASE WHEN f THEN 'Institute of Records' ELSE affiliation END AS affiliation, f AS filled
      FROM (SELECT *, affiliation = '' AND ord % 3 = 0 AS f FROM authors) a""",
    "name_reconcile": f"""{V}, s AS (SELECT *, split_part(fore_name, ' ', 2) AS second, split_part(fore_name, ' ', 1) AS first FROM authors)
      SELECT pmid, position, CASE WHEN ord % 3 = 0 THEN last_name ELSE second || ' ' || last_name END AS last_name, CASE WHEN ord % 3 = 0 THEN fore_name ELSE first END AS fore_name,
        ord % 3 = 0 AS reconciled FROM s""",
    "pmcid_left_join": f"{V}, {ASSEMBLED} SELECT * FROM asm",
    "pmcid_missing_anti": f"{V} SELECT pmcid FROM citations WHERE pmcid IS NOT NULL AND ord % 4 <> 0",
    "litsense_extra": f"{V} SELECT pmid FROM citations WHERE ord % 3 = 0 AND ord % 2 <> 0 AND ord % 5 <> 0 ORDER BY ord",
    "source_tags": f"{V} SELECT pmid, concat_ws(',', CASE WHEN ord % 2 = 0 THEN 'user' END, CASE WHEN ord % 3 = 0 THEN 'litsense' END) AS tags FROM citations",
    "orcid_identifier_match": f"""{V}, d AS (SELECT doi FROM citations WHERE ord % 7 = 0), k AS (
      SELECT pmid, concat_ws(',', CASE WHEN doi IN (SELECT doi FROM d) THEN 'doi' END, CASE WHEN pmcid IS NOT NULL AND ord % 13 = 0 THEN 'pmcid' END, CASE WHEN ord % 11 = 0 THEN 'pmid' END) AS kinds FROM citations)
      SELECT * FROM k WHERE kinds <> ''""",
    "org_similarity_match": f"""WITH s AS (SELECT s_suppkey AS k, {WORDS.format('s_suppkey')} AS w FROM supplier), n AS (SELECT k, {INSTITUTE} AS name FROM s)
      SELECT k::VARCHAR AS id, CASE k % 3 WHEN 0 THEN 'likely' ELSE 'possible' END AS level, name AS institution,
        CASE k % 3 WHEN 0 THEN 'institution match (' ELSE 'name similarity (' END || name || ')' AS label FROM n WHERE k % 3 <> 2""",
    "org_exact_contains_match": f"""{V}, o AS (SELECT n_nationkey AS i, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Royal ' || n_name || ' Academy' END AS name FROM nation),
      ok AS (SELECT *, {TOKEN.format('name')} AS key FROM o),
      p AS (SELECT pmid || ':' || position AS id, {TOKEN.format("split_part(affiliation, ';', 1)")} AS key FROM authors WHERE affiliation <> ''),
      r AS (SELECT id, name, p.key = ok.key AS exact, length(ok.key) AS l, i FROM p JOIN ok ON p.key = ok.key OR (length(ok.key) >= 10 AND (contains(ok.key, p.key) OR contains(p.key, ok.key))
        AND list_has_any(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '[0-9]+')), ['nation']) IS NOT NULL)),
      q AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY exact DESC, CASE WHEN exact THEN 0 ELSE -l END, i) = 1)
      SELECT id, CASE WHEN exact THEN 'likely' ELSE 'contains' END AS level, name AS institution,
        CASE WHEN exact THEN 'institution match (' ELSE 'affiliation contains institution (' END || name || ')' AS label FROM q""",
    "analysis_rows": f"""{_rows('full', '0000-0000-0000-0007')} SELECT pmid, idx, include, counted_overall, counted_first, counted_senior, counted_review_senior,
      array_to_string(reasons, '; ') AS reasons, superseded_by FROM rows""",
    "uncertain_index": f"{_rows()} SELECT idx FROM rows WHERE len(reasons) > 0",
    "citation_selection": f"{M}, {SELECTION} SELECT *, review_reason <> '' AS needs_review FROM s1",
    "needs_review": f"{M}, {SELECTION} SELECT review_reason, count(*) AS n FROM s1 GROUP BY 1",
    "missing_affiliation": f"""{V}, {ASSEMBLED} SELECT a.pmid, position, CASE WHEN pmcid IS NULL THEN 'No PMCID mapping, and PubMed author entry has no affiliation.'
      WHEN source_for_roles = 'pubmed' THEN 'PMC fetch/parse failed; PubMed author entry has no affiliation.'
      ELSE 'PMC author entry for this contributor does not include affiliation text.' END AS reason FROM authors a JOIN asm ON a.pmid = asm.pmid WHERE affiliation = ''""",
    "corrections_report": f"""{_rows()}, {MODES}, a AS (SELECT *, CASE WHEN len(reasons) > 0 THEN ord % 3 = 0 ELSE include END AS included FROM rows)
      SELECT a.pmid, {FIXED.format(hit='true')} FROM a LEFT JOIN fix ON a.pmid = fix.pmid""",
    "corrections_finalize": f"""{_rows()}, {MODES}, a AS (SELECT *, CASE WHEN len(reasons) > 0 THEN idx % 2 = 0 ELSE include END AS included FROM rows)
      SELECT a.pmid, {FIXED.format(hit='len(reasons) > 0 AND included')} FROM a LEFT JOIN fix ON a.pmid = fix.pmid""",
    "report_rows": f"""{_rows()} SELECT pmid, idx, CASE WHEN NOT include THEN 0 WHEN source_for_roles = 'pubmed' THEN 1 ELSE 2 END::INT AS bucket,
      CASE WHEN superseded_by <> '' THEN 'superseded' WHEN include THEN 'included' ELSE 'excluded' END AS status, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS link,
      {COUNTED.format(a="'1st/Sr preprint'", b="'coauthor preprint'", c="'1st/Sr review'", d="'coauthor review'", e="'1st/Sr author'", f="'coauthor'")} AS category,
      {COUNTED.format(a="'first_senior_preprint'", b="'coauthor_preprint'", c="'first_senior_review'", d="'coauthor_review'", e="'first_senior_author'", f="'coauthor'")} AS counted_mode,
      CASE WHEN NOT include THEN 'exclude' WHEN is_preprint THEN CASE WHEN counted_first OR counted_senior THEN 'first_senior_preprint' ELSE 'coauthor_preprint' END
        WHEN is_review THEN CASE WHEN counted_review_senior THEN 'first_senior_review' ELSE 'coauthor_review' END WHEN counted_first OR counted_senior THEN 'first_senior_author'
        WHEN counted_overall THEN 'coauthor' ELSE 'exclude' END AS default_mode, superseded_by, array_to_string(reasons, '; ') AS reasons FROM rows""",
}
