"""Queries of scalar functions, stores and payloads, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import affiliation, institutions, text
from ..operators import resolve
from ..runtime import written
from ..sources import bibliography as view
from ..sources import payloads
from ..streaming import jobs

UPPER = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
#: A time at which some of the tables' jobs have expired.
NOW = 1_706_686_400


#: An institute and its identifiers made from a key, and a block that names it in the way that an order's key says (o).
WORD = "translate(substr(md5(CAST({k} AS STRING)), {at}, 10), '0123456789', 'ghijklmnop')"
MADE = (
    f"named_struct('name', 'Institute of ' || {WORD.replace('{at}', '1')} || ' ' || {WORD.replace('{at}', '11')}, 'ror', '0' || substr(md5(CAST({{k}} AS STRING)), 5, 8), "
    f"'grid', 'grid.' || CAST({{k}} AS STRING) || '.a1', 'domain', {WORD.replace('{at}', '1')} || '.edu')"
)
MADE_BLOCK = """CASE o % 6 WHEN 0 THEN 'Department of Arts, https://ror.org/' || ror || ', Boston' WHEN 1 THEN 'Unit 7, ' || upper(grid) WHEN 2 THEN 'Write to a.b@Mail.' || domain || ' only'
  WHEN 3 THEN name || '; Athens, Greece' WHEN 4 THEN 'Room ' || CAST(o AS STRING) ELSE 'Unit, ' || name || '; ROR: ' || ror END"""


def pmid_scan_distinct(spark, sf_dir):
    found = view.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.pmids_in(F.col("text"))).alias("ord", "pmid"))
    return found.select("doc_id", F.col("ord").cast("long"), "pmid")


def name_normalize(spark, sf_dir):
    p = view.read(spark, sf_dir, "part")
    return p.select("p_partkey", text.token(F.col("p_brand")).alias("token"), text.squash(F.concat(F.lit("  "), "p_name", F.lit(" \t X "))).alias("squashed"), text.institution_key(F.concat("p_name", F.lit(" & Co’s"))).alias("key"))


def initials(spark, sf_dir):
    p = view.read(spark, sf_dir, "part")
    return p.select("p_partkey", text.initials(F.col("p_name")).alias("lower"), text.initials(F.col("p_name"), upper=True).alias("upper"))


def orcid_normalize(spark, sf_dir):
    s = view.read(spark, sf_dir, "supplier")
    digits = F.lpad(F.col("s_suppkey").cast("string"), 15, "0")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://orcid.org/"), digits, F.lit("x"))).when(F.col("s_suppkey") % 3 == 1, F.concat(digits, F.lit("7"))).otherwise(F.lit("none"))
    return s.select("s_suppkey", text.orcid(raw).alias("orcid"))


def doi_normalize(spark, sf_dir):
    c = view.citations(spark, sf_dir)
    raw = F.concat(F.lit(" HTTPS://doi.org/"), "doi", F.lit("/Ab. "))
    return c.select("pmid", text.parsed_doi(raw).alias("parsed"), text.record_doi(raw).alias("record"), text.match_doi(F.concat(F.lit(" "), "doi", F.lit("/Ab "))).alias("matched"))


def pmcid_normalize(spark, sf_dir):
    c = view.citations(spark, sf_dir)
    raw = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("pmc-"), "pmid")).otherwise(F.col("pmid"))
    return c.select("pmid", text.pmcid(raw).alias("pmcid"), text.pmcid_number(raw).alias("number"))


def year_parse(spark, sf_dir):
    o = view.read(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.lit("Winter")).otherwise(F.concat(F.lit("Spring "), F.date_format("o_orderdate", "yyyy-MMM")))
    return o.select("o_orderkey", text.year(raw).alias("year"))


def email_signals(spark, sf_dir):
    d = view.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(institutions.emails(F.col("text"))).alias("email"))


def _blocks(spark, sf_dir):
    """An affiliation for every order: a state university, a country or neither at the end."""
    o = view.read(spark, sf_dir, "orders")
    ends = F.element_at(F.array(*map(F.lit, ("Athens, Greece", "Atlanta, Georgia", "UK.", "Boston, MA, USA", "Pretoria, South Africa"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    heads = F.element_at(F.array(*map(F.lit, ("University of Maryland School of Medicine", "University of Missouri-Kansas City", "University of Ohio", "University of North Carolina Project Malawi"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat_ws(", ", heads, ends).alias("block"))


def geo_suffix(spark, sf_dir):
    return _blocks(spark, sf_dir).select("id", institutions.country(F.col("block")).alias("country"))


def state_university(spark, sf_dir):
    return _blocks(spark, sf_dir).select("id", institutions.state_label(F.col("block")).alias("label"))


def _registry(spark, sf_dir):
    """Every supplier's institute by ROR, GRID, e-mail domain and name."""
    s = view.read(spark, sf_dir, "supplier").select(F.expr(MADE.format(k="s_suppkey")).alias("m")).select("m.*")
    kinds = {"ror": "'https://ror.org/' || ror", "grid": "grid", "email": "domain", "text": "replace(lower(name), ' ', '')"}
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.expr(key).alias("key"), F.col("name").alias("canonical")) for kind, key in kinds.items()]))
    return s.select(each.alias("r")).select("r.*")


def institution_resolution(spark, sf_dir):
    """Affiliations that name a supplier's institute in five ways, or none, resolved by a registry of all suppliers; a row for each institute that holds the identifier."""
    line = view.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    made = line.select(F.col("l_orderkey").alias("o"), F.expr(MADE.format(k="l_suppkey")).alias("m")).select("o", "m.*")
    b = made.select(F.expr(MADE_BLOCK).alias("block"), F.array().cast("array<string>").alias("context"))
    return resolve.resolve(b, _registry(spark, sf_dir).union(resolve.seed_registry(spark)), readings=True).select("block", F.array_join("institutions", " | ").alias("institutions"))


def cleaned(authors):
    """pmid, position, affiliation, blocks and changed of authors with cleaned affiliations, to every second of which a reference mark was put before."""
    even, marked = F.col("position") % 2 == 0, F.concat(F.lit("[2] "), "affiliation")
    own = authors.select("pmid", "position", "affiliation", "blocks")
    made = own.select("pmid", "position", F.when(even, marked).otherwise(F.col("affiliation")).alias("affiliation"), F.when(even, text.affiliation_blocks(marked)).otherwise(F.col("blocks")).alias("blocks"))
    return affiliation.clean_affiliations(made)


def affiliation_clean(spark, sf_dir):
    return cleaned(written(view.authors(spark, sf_dir).select("pmid", "position", "affiliation", "blocks"))).select("pmid", "position", "affiliation", "changed")


def json_recursive_ids(spark, sf_dir):
    e = view.read(spark, sf_dir, "events")
    wrapped = e.select(F.col("event_id").alias("id"), F.replace("props", F.lit('"k"'), F.lit('"pmid"')).alias("json"))
    return payloads.pmids(spark, wrapped).select(F.col("id").alias("event_id"), "pmid")


def _jobs(spark, sf_dir):
    e = view.read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run"), F.col("event_type").alias("author"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))


def usage_top_n(spark, sf_dir):
    return jobs.usage(_jobs(spark, sf_dir), author="PUR", limit=500).select("id", "author", "status")


def usage_merged(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    updates = j.select("run", "created_at", F.when(F.col("status") != "running", F.col("status")).alias("status"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("even_id"))
    return jobs.merged_updates(updates, "run", "created_at")


def job_latest(spark, sf_dir):
    return jobs.latest(_jobs(spark, sf_dir), "run", ["created_at", "id"]).select("run", "id", "status")


def ttl_expired(spark, sf_dir):
    j = jobs.latest(_jobs(spark, sf_dir), "run", ["created_at", "id"]).withColumn("updated_at", F.col("created_at") / 1_000_000)
    return jobs.expired_jobs(j, F.lit(float(NOW))).select("run")


def events_rate_window(spark, sf_dir):
    e = view.read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = jobs.rate(e, "event_type", "at", 3600, 1)
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        pmid_scan_distinct, name_normalize, initials, orcid_normalize, doi_normalize, pmcid_normalize, year_parse, email_signals, geo_suffix, state_university,
        institution_resolution, affiliation_clean, json_recursive_ids, usage_top_n, usage_merged, job_latest, ttl_expired, events_rate_window,
    )
}

MADE_SQL = MADE.replace("named_struct(", "struct_pack(").replace("'name', ", "name := ").replace("'ror', ", "ror := ").replace("'grid', ", "grid := ").replace("'domain', ", "domain := ")
LABELS = "CASE o_orderkey % 4 WHEN 0 THEN 'University of Maryland School of Medicine' WHEN 1 THEN 'University of Missouri, Kansas City' WHEN 2 THEN 'University of Ohio' END"
JOBS = """WITH j AS (SELECT event_id AS id, user_id AS run, event_type AS author, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status,
  epoch_us(ts) AS created_at FROM events), last AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY run ORDER BY created_at DESC, id DESC) = 1)"""
SQL = {
    "pmid_scan_distinct": """WITH m AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS pmid, generate_subscripts(l, 1) AS i FROM m),
      f AS (SELECT doc_id, pmid, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, pmid FROM f""",
    "name_normalize": f"SELECT p_partkey, {UPPER.format('p_brand')} AS token, lower(p_name) || ' x' AS squashed, {UPPER.format('p_name')} || 'andcos' AS key FROM part",
    "initials": """SELECT p_partkey, lower(array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z]+'), lambda x: x[1]), '')) AS lower,
      upper(array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z]+'), lambda x: x[1]), '')) AS upper FROM part""",
    "orcid_normalize": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE regexp_replace(lpad(s_suppkey::VARCHAR, 15, '0') || CASE WHEN s_suppkey % 3 = 0 THEN 'X' ELSE '7' END,
      '(.{4})(.{4})(.{4})(.{4})', '\\1-\\2-\\3-\\4') END AS orcid FROM supplier""",
    "doi_normalize": "SELECT o_orderkey::VARCHAR AS pmid, '10.1000/' || (o_orderkey // 2) || '/Ab' AS parsed, '10.1000/' || (o_orderkey // 2) || '/ab' AS record, '10.1000/' || (o_orderkey // 2) || '/ab' AS matched FROM orders",
    "pmcid_normalize": "SELECT o_orderkey::VARCHAR AS pmid, 'PMC' || o_orderkey AS pmcid, o_orderkey::VARCHAR AS number FROM orders",
    "year_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate)::INT END AS year FROM orders",
    "email_signals": "SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) AS email FROM documents",
    "geo_suffix": "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Greece' WHEN 2 THEN 'United Kingdom' WHEN 4 THEN 'South Africa' ELSE '' END AS country FROM orders",
    "state_university": f"SELECT o_orderkey AS id, {LABELS} AS label FROM orders",
    "institution_resolution": f"""WITH l AS (SELECT DISTINCT l_orderkey AS o, {MADE_SQL.format(k='l_suppkey')} AS m FROM lineitem), e AS (SELECT o, m.name AS name, m.ror AS ror, m.grid AS grid, m.domain AS domain FROM l)
      SELECT DISTINCT {MADE_BLOCK} AS block, CASE o % 6 WHEN 3 THEN name || ', Greece' WHEN 4 THEN '' ELSE name END AS institutions FROM e""",
    "affiliation_clean": """WITH li AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1)
      SELECT l_orderkey::VARCHAR AS pmid, l_linenumber AS position, CASE WHEN l_returnflag = 'N' AND l_discount = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN '[2]' ELSE '' END
        WHEN l_linestatus = 'F' THEN n_name || '; ' || r_name ELSE n_name END AS affiliation, l_linenumber % 2 = 0 AS changed
      FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "json_recursive_ids": "SELECT event_id, json_extract_string(props, '$.k') AS pmid FROM events WHERE json_extract_string(props, '$.k') <> '0'",
    "usage_top_n": f"{JOBS} SELECT id, author, status FROM j WHERE author ILIKE '%PUR%' ORDER BY created_at DESC, id DESC LIMIT 200",
    "usage_merged": f"""{JOBS} SELECT run, arg_max(status, created_at) FILTER (status <> 'running') AS status, arg_max(id, created_at) FILTER (id % 2 = 0) AS even_id FROM j GROUP BY run""",
    "job_latest": f"{JOBS} SELECT run, id, status FROM last",
    "ttl_expired": f"{JOBS} SELECT run FROM last WHERE status <> 'running' AND {NOW} - created_at / 1000000 > 86400",
    "events_rate_window": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
}
