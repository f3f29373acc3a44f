"""Registered queries over the driver's tables, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import identity, text
from quillspark.functions.core import confidence, content_id, level, tolerance
from quillspark.functions.numbers import UNITS, mentions, registry, to_canonical
from quillspark.operators import entities, matching, meta, ordered, package, retrieval, scoring, tables, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(t: Callable[[str], DataFrame]) -> DataFrame:
    """Customers as documents of their nation."""
    return t("customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("document_id"))


def _findings(t: Callable[[str], DataFrame]) -> DataFrame:
    """Orders as findings, their priority as severity; each 97th belongs to its customer's nation as a whole."""
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").when(F.col("o_orderpriority") == "3-MEDIUM", "low").otherwise("info")
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("c_nationkey").alias("project_id"), F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey")).alias("document_id"), severity.alias("severity"),
        F.col("o_orderstatus").alias("finding_type"), content_id("f", F.col("o_orderkey")).alias("finding_id"))


_FINDINGS_SQL = """findings AS (
  SELECT c_nationkey AS project_id, CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS document_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'low' ELSE 'info' END AS severity,
    o_orderstatus AS finding_type, 'f__' || substr(sha256(o_orderkey::VARCHAR), 1, 12) AS finding_id
  FROM orders JOIN customer ON o_custkey = c_custkey),
pointed AS (SELECT *, CASE severity WHEN 'high' THEN 25 WHEN 'medium' THEN 12 WHEN 'low' THEN 5 ELSE 2 END AS points FROM findings)"""
_DOCUMENT_SQL = f"""{_FINDINGS_SQL},
per AS (SELECT document_id, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium, count(*) FILTER (WHERE severity = 'low') AS n_low, count(*) FILTER (WHERE severity = 'info') AS n_info, sum(points) AS points FROM pointed WHERE document_id IS NOT NULL GROUP BY document_id),
scored AS (SELECT c_nationkey AS project_id, c_custkey AS document_id, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, coalesce(n_info, 0) AS n_info, least(100, coalesce(points, 0))::BIGINT AS score FROM customer LEFT JOIN per ON c_custkey = document_id)"""
_PROJECT_SQL = f"""{_DOCUMENT_SQL},
means AS (SELECT project_id, count(*) AS n_documents, sum(score)::BIGINT AS total FROM scored GROUP BY project_id),
package AS (SELECT project_id, sum(points) AS package_points FROM pointed WHERE document_id IS NULL GROUP BY project_id),
rounded AS (SELECT coalesce(m.project_id, p.project_id) AS project_id, coalesce(n_documents, 0) AS n_documents, coalesce(total // n_documents + CASE WHEN 2 * (total % n_documents) > n_documents OR (2 * (total % n_documents) = n_documents AND (total // n_documents) % 2 = 1) THEN 1 ELSE 0 END, 0)::BIGINT AS document_mean, coalesce(package_points, 0)::BIGINT AS package_points FROM means m FULL JOIN package p ON m.project_id = p.project_id),
projects AS (SELECT *, least(100, document_mean + package_points)::BIGINT AS score FROM rounded)"""


@query(f"WITH {_DOCUMENT_SQL} SELECT * FROM scored")
def score_documents(t):
    return scoring.score_documents(_documents(t), _findings(t))


@query(f"WITH {_PROJECT_SQL} SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'elevated' WHEN score >= 25 THEN 'moderate' ELSE 'low' END AS level FROM projects")
def score_projects(t):
    return scoring.score_projects(_documents(t), _findings(t)).withColumn("level", level(F.col("score"))).orderBy(F.desc("score"), "project_id")


@query(f"WITH {_FINDINGS_SQL} SELECT * EXCLUDE (points) FROM pointed ORDER BY project_id, coalesce(document_id::VARCHAR, '~'), severity, finding_type, finding_id LIMIT 100".replace("severity, finding_type, finding_id LIMIT", "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, finding_type, finding_id LIMIT"))
def findings_page(t):
    rows = _findings(t)
    return rows.orderBy(*scoring.sort_key(rows)).limit(100)


@query(f"WITH {_FINDINGS_SQL} SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM findings GROUP BY severity UNION ALL SELECT 'finding_type', finding_type, count(*) FROM findings GROUP BY finding_type")
def severity_facets(t):
    return scoring.facets(_findings(t), "severity", "finding_type")


@query("SELECT user_id, max_by(event_type, (n, event_type)) AS dominant, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def dominant_value(t):
    return scoring.dominant(t("events"), "user_id", "event_type")


@query(r"""SELECT doc_id, heading, count(*) AS n FROM (SELECT doc_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g')) AS heading FROM documents) WHERE heading <> '' GROUP BY ALL HAVING count(*) >= 3""")
def duplicate_headings(t):
    return package.repeated_headings(t("documents"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) = 0) AS n_empty, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) < 32) AS n_low FROM documents GROUP BY source")
def low_text_ratio(t):
    return package.text_coverage(t("documents"), "source")


_STOPS = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = f"[x for x in string_split_regex(replace(lower(coalesce({{0}}, '')), 'ё', 'е'), '[^{text.LETTERS}]+') if length(x) >= 2 AND x NOT IN ({_STOPS})]"


def _headings(t):
    """Every line of every document."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "title"))
    return lines.select(F.concat_ws(":", "doc_id", "line").alias("heading_id"), "title")


def _rules(t):
    return t("benchmark").select(F.col("item_id").alias("rule_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("alias"))


@query(rf"""
WITH l AS (SELECT doc_id || ':' || unnest(range(len(string_split(text, chr(10))))) AS heading_id, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT heading_id, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS title, list_distinct({_TOKENS.format('line')}) AS ht FROM l),
a AS (SELECT item_id AS rule_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS raw FROM benchmark),
r AS (SELECT rule_id, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS alias, list_distinct({_TOKENS.format('raw')}) AS rt FROM a),
p AS (SELECT heading_id, rule_id, title, alias, len(list_intersect(ht, rt)) AS both_n, len(ht) AS nh, len(rt) AS nr FROM h CROSS JOIN r),
m AS (SELECT heading_id, rule_id, CASE WHEN title = alias THEN 1 WHEN length(alias) >= 6 AND contains(title, alias) THEN 2 WHEN both_n = nr OR both_n / (nh + nr - both_n) >= 0.6 THEN 3 END AS tier FROM p WHERE both_n > 0)
SELECT * FROM m WHERE tier IS NOT NULL""")
def section_match_tiers(t):
    return package.match_sections(_headings(t), _rules(t))


_REQUIRED = ("click", "error", "purchase", "signup", "view")


@query("WITH e AS (SELECT event_id // 10 AS block, event_type FROM events) SELECT block, k AS missing FROM (SELECT DISTINCT block FROM e) u, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS k) r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.block = u.block AND e.event_type = k)")
def missing_type(t):
    return package.missing_types(t("events").withColumn("block", F.expr("event_id div 10")), "block", "event_type", list(_REQUIRED))


@query(f"""
WITH ct AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark), tc AS (SELECT item_id, term, count(*) AS c FROM ct GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tc GROUP BY term),
w AS (SELECT tc.item_id, tc.term, (1 + ln(c)) * (ln(1 + (SELECT count(*) FROM benchmark) / (1 + df)) + 1) AS w FROM tc JOIN df ON tc.term = df.term),
norm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY item_id),
qt AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), qc AS (SELECT doc_id, term, 1 + ln(count(*)) AS qw FROM qt GROUP BY ALL),
s AS (SELECT doc_id, w.item_id, sum(qw * w) AS dot FROM qc JOIN w ON qc.term = w.term GROUP BY ALL),
r AS (SELECT doc_id AS query_id, s.item_id AS requirement_id, round(dot / norm, 6) AS score FROM s JOIN norm ON s.item_id = norm.item_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, requirement_id) AS rank FROM r WHERE score >= 0.05 QUALIFY rank <= 5""")
def tfidf_topk(t):
    return retrieval.retrieve(t("documents").select(F.col("doc_id").alias("query_id"), "text"), t("benchmark").select(F.col("item_id").alias("requirement_id"), "text"))


@query("""
WITH sums AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS computed, count(*) AS n_parts FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2),
b AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS stated, computed::DECIMAL(18,2) AS computed, n_parts, abs(o_totalprice::DECIMAL(18,2) - computed::DECIMAL(18,2)) AS abs_diff FROM orders JOIN sums ON o_orderkey = l_orderkey)
SELECT o_orderkey, stated, computed, n_parts, abs_diff::DECIMAL(18,2) AS abs_diff,
  CASE WHEN stated = 0 AND computed = 0 THEN false WHEN stated = 0 OR computed = 0 THEN abs_diff > 0.005 ELSE abs_diff > 0.005 AND abs_diff > 0.02 * greatest(abs(stated), abs(computed)) END AS mismatch FROM b""")
def reconcile_total(t):
    return matching.reconcile(t("orders"), t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "o_totalprice", "l_extendedprice")


@query("""
WITH g AS (SELECT p_brand, p_size, p_type FROM part GROUP BY ALL HAVING count(*) <= 10),
p AS (SELECT part.* FROM part SEMI JOIN g ON part.p_brand = g.p_brand AND part.p_size = g.p_size AND part.p_type = g.p_type),
d AS (SELECT a.p_brand, a.p_size, a.p_type, a.p_partkey AS p_partkey_a, b.p_partkey AS p_partkey_b, a.p_retailprice::DECIMAL(18,2) AS x, b.p_retailprice::DECIMAL(18,2) AS y FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey)
SELECT p_brand, p_size, p_type, p_partkey_a, p_partkey_b, abs(x - y)::DECIMAL(18,2) AS abs_diff,
  CASE WHEN x = 0 AND y = 0 THEN false WHEN x = 0 OR y = 0 THEN abs(x - y) > 0.01 ELSE abs(x - y) > 0.01 AND abs(x - y) > 0.02 * greatest(abs(x), abs(y)) END AS mismatch FROM d""")
def tolerance_pairs(t):
    rows = t("part").withColumn("value", F.col("p_retailprice").cast("decimal(18,2)"))
    pairs, _ = matching.guarded_pairs(rows, ["p_brand", "p_size", "p_type"], "p_partkey", ["value"])
    out = matching.compare_pairs(pairs, "value", F.lit("0.01"))
    return out.select("p_brand", "p_size", "p_type", "p_partkey_a", "p_partkey_b", F.col("abs_diff").cast("decimal(18,2)").alias("abs_diff"), "mismatch")


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2)) AS total FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity::DECIMAL(18,2)) > 0)
SELECT l.l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_quantity::DECIMAL(18,2) * 100 - (l_discount * 1000)::DECIMAL(18,2) * total) > 1.0 * total AS flagged FROM lineitem l JOIN s ON l.l_orderkey = s.l_orderkey""")
def percent_recompute(t):
    rows = t("lineitem").withColumn("stated_share", (F.col("l_discount") * 1000).cast("decimal(18,2)"))
    return matching.share_check(rows, "l_orderkey", "l_quantity", F.col("stated_share")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flagged")


@query("""
WITH n AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT a.s_nationkey, a.s_suppkey AS s_suppkey_a, b.s_suppkey AS s_suppkey_b, 'pair' AS outcome FROM supplier a JOIN n ON a.s_nationkey = n.s_nationkey AND n.n <= 10 JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
UNION ALL SELECT s_nationkey, NULL, NULL, 'group_too_large' FROM n WHERE n > 10""")
def guarded_self_join(t):
    pairs, large = matching.guarded_pairs(t("supplier"), ["s_nationkey"], "s_suppkey", [])
    return pairs.withColumn("outcome", F.lit("pair")).unionByName(large.select("s_nationkey", F.col("reason").alias("outcome")), allowMissingColumns=True)


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, c_custkey // 40 AS grp, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 <> 0 THEN (c_acctbal > 0) END AS positive FROM customer),
k AS (SELECT c_nationkey, grp FROM c GROUP BY ALL HAVING count(*) <= 10),
p AS (SELECT a.c_nationkey, a.grp, a.c_custkey AS c_custkey_a, b.c_custkey AS c_custkey_b, a.segment AS sa, b.segment AS sb, a.positive AS pa, b.positive AS pb FROM c a JOIN k ON a.c_nationkey = k.c_nationkey AND a.grp = k.grp JOIN c b ON a.c_nationkey = b.c_nationkey AND a.grp = b.grp AND a.c_custkey < b.c_custkey),
s AS (SELECT *, CASE WHEN sa IS NULL OR sb IS NULL THEN 'unknown' WHEN sa = sb THEN 'match' ELSE 'conflict' END AS state_segment, CASE WHEN pa IS NULL OR pb IS NULL THEN 'unknown' WHEN pa = pb THEN 'match' ELSE 'conflict' END AS state_positive FROM p)
SELECT c_custkey_a, c_custkey_b, state_segment, state_positive, (state_segment <> 'match' OR state_positive <> 'match') AS suppressed FROM s""")
def tri_state(t):
    rows = t("customer").select("c_nationkey", "c_custkey", F.expr("c_custkey div 40").alias("grp"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") > 0).alias("positive"))
    pairs, _ = matching.guarded_pairs(rows, ["c_nationkey", "grp"], "c_custkey", ["segment", "positive"])
    return matching.tri_states(pairs, ["segment", "positive"]).select("c_custkey_a", "c_custkey_b", "state_segment", "state_positive", "suppressed")


@query("""
WITH a AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM a WHERE k <= 2)
SELECT event_type, user_id, event_id FROM b WHERE n <= 10""")
def suppression_caps(t):
    return matching.sample_suppressed(t("events").select("event_type", "user_id", "event_id"), "event_type", "user_id", "event_id")


@query("""
WITH claims AS (SELECT c_nationkey AS project_id, CASE WHEN c_custkey % 11 = 0 AND c_nationkey % 3 = 0 THEN c_custkey % 2 + c_nationkey END::VARCHAR AS identifier, c_mktsegment AS name, CASE WHEN c_custkey % 2 = 0 THEN 'llp' ELSE 'jsc' END AS form, c_custkey % 13 = 0 AND c_nationkey % 2 = 0 AS designer FROM customer),
v AS (SELECT DISTINCT project_id, name FROM claims WHERE designer),
k AS (SELECT c.* FROM claims c ANTI JOIN v ON c.project_id = v.project_id AND c.name = v.name WHERE NOT designer),
f AS (SELECT project_id, count(DISTINCT identifier) AS n_identifiers, count(DISTINCT (name, form)) AS n_names, min(identifier) AS i, min(name) AS nm FROM k GROUP BY project_id),
e AS (SELECT p.project_id, coalesce(n_identifiers, 0) AS n_identifiers, coalesce(n_names, 0) AS n_names, i, nm FROM (SELECT DISTINCT project_id FROM claims) p LEFT JOIN f ON p.project_id = f.project_id),
s AS (SELECT *, CASE WHEN n_identifiers >= 2 THEN 'conflicting_identifier' WHEN n_identifiers = 1 THEN 'confirmed_by_identifier' WHEN n_names = 1 THEN 'confirmed_by_name' WHEN n_names > 1 THEN 'unresolved_names' ELSE 'absent' END AS status FROM e)
SELECT project_id, n_identifiers, n_names, status, CASE status WHEN 'confirmed_by_identifier' THEN 'org__' || substr(sha256(i), 1, 12) WHEN 'confirmed_by_name' THEN 'org__' || substr(sha256(nm), 1, 12) END AS entity_id FROM s""")
def entity_resolution(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    claims = t("customer").select(
        nation.alias("project_id"), F.when((key % 11 == 0) & (nation % 3 == 0), key % 2 + nation).cast("string").alias("identifier"), F.col("c_mktsegment").alias("name"),
        F.when(key % 2 == 0, "llp").otherwise("jsc").alias("form"), ((key % 13 == 0) & (nation % 2 == 0)).alias("designer"))
    return entities.resolve_operators(claims)


@query("SELECT sha256(text) AS digest, min(doc_id) AS representative, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t):
    return entities.exact_groups(t("documents"), "doc_id", F.col("text"))


@query()
def near_duplicate_clusters(t):
    bits = F.aggregate(F.slice("embedding", 1, 64), F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR((x > 0).cast("long")))
    return entities.near_clusters(t("embeddings").select(F.col("vec_id").alias("node"), bits.alias("h")))


@query("""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 5) AS cosine FROM p WHERE s >= 0.30""")
def cosine_links(t):
    rows = t("embeddings").select("vec_id", "embedding")
    found = entities.cosine_links(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 0.30)
    return found.select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"))


@query("""
WITH a AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS v FROM embeddings),
e AS (SELECT vec_id, [exp(50 * (x - list_max(v))) for x in v] AS e FROM a), s AS (SELECT vec_id, [x / list_sum(e) for x in e] AS p FROM e)
SELECT vec_id, round(list_max(p), 6) AS best, CASE WHEN list_reverse_sort(p)[1] >= 0.30 AND list_reverse_sort(p)[1] - list_reverse_sort(p)[2] >= 0.05 THEN list_position(p, list_max(p)) - 1 END::BIGINT AS class FROM s""")
def softmax_decision(t):
    p = entities.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")))
    return t("embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round(F.array_max("p"), 6).alias("best"), entities.decide(F.col("p")).cast("long").alias("class"))


@query("SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE n_chars < 300) AS n_short, count(*) FILTER (WHERE (n_chars >= 300)::INT = quality) AS n_agree FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY ALL")
def label_agreement(t):
    both = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return both.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 300).alias("n_short"), F.count_if((F.col("n_chars") >= 300).cast("int") == F.col("quality")).alias("n_agree"))


@query("SELECT event_id, user_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM events")
def range_page_to_block(t):
    return ordered.blocks(t("events").select("event_id", "user_id", "event_type"), "user_id", "event_id", F.col("event_type") == "signup").select("event_id", "user_id", "block")


@query("""
WITH b AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, sum((before IS NULL OR before <> event_type)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b""")
def continuation(t):
    rows = t("events").select("event_id", "user_id", "event_type")
    return ordered.runs(rows, "user_id", "event_id", F.col("event_type") == F.col("_before.event_type")).select("event_id", "user_id", "run")


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber * 1000000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS place, round(l_extendedprice * 100)::BIGINT AS w FROM lineitem),
s AS (SELECT l_orderkey, sum(w)::BIGINT AS total, max(place) FILTER (WHERE w > 0) AS last FROM w GROUP BY l_orderkey),
c AS (SELECT w.l_orderkey, place, last, CASE WHEN w > 0 THEN (20000 * w + total) // (2 * total) ELSE 0 END::BIGINT AS c FROM w JOIN s ON w.l_orderkey = s.l_orderkey),
o AS (SELECT l_orderkey, sum(c) AS others FROM c WHERE place <> last GROUP BY l_orderkey)
SELECT c.l_orderkey, place, ((CASE WHEN place = last THEN 10000 - coalesce(others, 0) ELSE c END)::DECIMAL(18,2) / 100)::DECIMAL(18,2) AS allocated FROM c LEFT JOIN o ON c.l_orderkey = o.l_orderkey""")
def running_allocation(t):
    from pyspark.sql import Window as W

    place = F.col("l_linenumber") * 1_000_000 + F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    rows = t("lineitem").withColumn("place", place)
    return scoring.allocate(rows, "l_orderkey", "place", F.col("l_extendedprice"), F.lit("100")).select("l_orderkey", "place", "allocated")


@query()
def number_scan(t):
    return mentions(t("documents"))


_UNITS_SQL = ", ".join(f"('{c}', '{k}', '{u}', {f}::DECIMAL(16,6))" for c, k, u, f in UNITS)
_UNIT_NAMES_SQL = ", ".join(f"'{u}'" for u in sorted(u for _, _, u, _ in UNITS))


@query(f"""
WITH r(canonical, kind, unit, factor) AS (VALUES {_UNITS_SQL}), p AS (SELECT event_id, value, [{_UNIT_NAMES_SQL}][event_id % {len(UNITS)} + 1] AS unit FROM events WHERE value IS NOT NULL)
SELECT event_id, p.unit, canonical, kind, (value::DECIMAL(20,2) * factor::DECIMAL(18,6))::DOUBLE AS canonical_value FROM p JOIN r ON p.unit = r.unit""")
def unit_convert(t):
    events = t("events").where("value is not null")
    units = F.array(*[F.lit(u) for u in sorted(u for _, _, u, _ in UNITS)])
    named = events.select("event_id", "value", F.get(units, F.col("event_id") % len(UNITS)).alias("unit"))
    both = named.join(F.broadcast(registry(events.sparkSession)), "unit")  # the registry's rows are those of UNITS
    return both.select("event_id", "unit", "canonical", "kind", to_canonical(F.col("value").cast("decimal(18,2)"), F.col("factor")).cast("double").alias("canonical_value"))


@query(r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>')) AS h, unnest(range(len(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>')))) AS n FROM pages)
SELECT page_id, n, substr(h, 3, 1)::INT AS level, trim(regexp_replace(h, '<[^>]*>', '', 'g')) AS title FROM h""")
def html_sections(t):
    return package.html_sections(t("pages"))


@query("""
SELECT 'orders.o_custkey' AS rule, count(*) AS broken FROM orders ANTI JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'labels.doc_id', count(*) FROM labels ANTI JOIN documents ON labels.doc_id = documents.doc_id""")
def fk_orphans(t):
    rules = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"))
    counts = [validate.orphans(t(c).withColumnRenamed(f, "_f"), "_f", t(p), k).agg(F.lit(f"{c}.{f}").alias("rule"), F.count("*").alias("broken")) for c, f, p, k in rules]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness(t):
    return validate.repeated(t("lineitem"), "l_orderkey", "l_linenumber")


@query("""
WITH s AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT *, 'stored' AS side FROM (FROM s EXCEPT ALL FROM a) UNION ALL SELECT *, 'actual' FROM (FROM a EXCEPT ALL FROM s)""")
def except_both_ways(t):
    stored = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return validate.differences(stored, t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")))


@query("""
WITH p AS (SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS progress, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
SELECT event_id, user_id, progress FROM p WHERE back <= 200""")
def event_log_progress(t):
    return ordered.recent_log(t("events").select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "user_id", "progress")


@query("""
WITH b AS (SELECT user_id, ts, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
r AS (SELECT *, sum((before IS NULL OR us - before > 3600000000)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM r GROUP BY user_id, run""")
def ttl_sessions(t):
    found = ordered.sessions(t("events"), "user_id", "ts", 3600)
    return found.select("user_id", "n", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity::DECIMAL(24,6) - 40 > 0.01 AND l_quantity::DECIMAL(24,6) - 40 > 0.02 * 40) AS violation FROM lineitem")
def row_bounds(t):
    return matching.beyond_bound(t("lineitem"), F.col("l_quantity"), F.lit("40")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "violation")


@query("SELECT r.n_regionkey AS fold, n.n_nationkey, CASE WHEN n.n_regionkey = r.n_regionkey THEN 'test' ELSE 'train' END AS part FROM nation n, (SELECT DISTINCT n_regionkey FROM nation) r")
def leave_one_out(t):
    return validate.leave_one_out(t("nation").select("n_nationkey", "n_regionkey"), "n_regionkey")


def _features(t):
    """Orders of a nation's customers by priority and status as findings of the four parts."""
    per = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("project_id")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("a"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("b"), F.count_if(F.col("o_orderstatus") == "P").alias("c"), F.count("*").alias("n"))
    rows = (("P1", "p1_medium_severity_rate", "a"), ("P1", "p1_low_severity_rate", "b"), ("P2", "p2_potential_conflicts", "a"), ("P3", "p3_proven_conflicts", "b"), ("P4", "p4_proven_conflicts", "c"), ("P4", "p4_unresolved_identity_findings", "a"))
    each = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(name).alias("feature"), F.col(count).alias("count"), F.lit(meta.FEATURE_WEIGHTS[part][name]).alias("weight")) for part, name, count in rows])
    found = per.select("project_id", "n", F.explode(each).alias("f")).select("project_id", "n", "f.*")
    return found.withColumn("value", meta.normalized(F.col("count"), F.col("n"))).withColumn("contribution", meta.contribution(F.col("value"), F.col("weight")))


_FEATURES_SQL = """per AS (
  SELECT c_nationkey AS project_id, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS a, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS b, count(*) FILTER (WHERE o_orderstatus = 'P') AS c, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
counted AS (
  SELECT project_id, n, 'P1' AS part, 'p1_medium_severity_rate' AS feature, a AS k, 12 AS weight FROM per UNION ALL SELECT project_id, n, 'P1', 'p1_low_severity_rate', b, 4 FROM per
  UNION ALL SELECT project_id, n, 'P2', 'p2_potential_conflicts', a, 16 FROM per UNION ALL SELECT project_id, n, 'P3', 'p3_proven_conflicts', b, 18 FROM per
  UNION ALL SELECT project_id, n, 'P4', 'p4_proven_conflicts', c, 20 FROM per UNION ALL SELECT project_id, n, 'P4', 'p4_unresolved_identity_findings', a, 5 FROM per),
valued AS (SELECT project_id, part, feature, weight, round((k::DOUBLE / n)::DECIMAL(18,9), 6)::DECIMAL(12,6) AS value FROM counted),
features AS (SELECT *, round(value * weight::DECIMAL(8,2), 2)::DECIMAL(12,2) AS contribution FROM valued),
parts AS (SELECT project_id, part, sum(contribution)::DECIMAL(18,2) AS raw, CASE part WHEN 'P2' THEN 0.35 ELSE 1 END::DECIMAL(8,6) AS factor, CASE part WHEN 'P1' THEN 35 WHEN 'P2' THEN 8 ELSE 25 END::DECIMAL(8,2) AS cap FROM features GROUP BY project_id, part),
capped AS (SELECT *, least(round(raw * factor, 2), cap)::DECIMAL(18,2) AS subtotal FROM parts)"""


@query(f"WITH {_FEATURES_SQL} SELECT project_id, part, feature, value, contribution FROM features")
def review_features(t):
    return _features(t).select("project_id", "part", "feature", "value", "contribution")


@query(f"WITH {_FEATURES_SQL} SELECT * FROM capped")
def review_parts(t):
    return meta.part_scores(_features(t))


@query(f"WITH {_FEATURES_SQL} SELECT project_id, least(sum(subtotal), 100)::DECIMAL(18,2) AS score FROM capped GROUP BY project_id")
def review_scores(t):
    return meta.total_scores(meta.part_scores(_features(t)))


@query(f"WITH {_FEATURES_SQL}, r AS (SELECT project_id, part, feature, contribution, row_number() OVER (PARTITION BY project_id ORDER BY contribution DESC, part, feature) AS rank FROM features WHERE contribution > 0) SELECT * FROM r WHERE rank <= 5")
def top_positive_factors(t):
    return meta.top_factors(_features(t)).select("project_id", "part", "feature", "contribution", "rank")


@query("""
WITH m AS (SELECT user_id, event_id, value::DECIMAL(18,2) AS v, event_type = 'purchase' AS tot, event_type = 'error' AS dv, event_type IN ('click', 'signup') AS part FROM events),
g AS (SELECT *, coalesce(sum((tot OR dv)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM m),
s AS (SELECT user_id, seg, max(event_id) FILTER (WHERE tot) AS total_row, max(v) FILTER (WHERE tot) AS stated, (sum(v) FILTER (WHERE part))::DECIMAL(18,2) AS computed, count(*) FILTER (WHERE part) AS n_parts,
  count(v) FILTER (WHERE part) AS known, min(v) FILTER (WHERE part) AS lo, max(v) FILTER (WHERE part) AS hi FROM g GROUP BY user_id, seg)
SELECT user_id, total_row, stated, computed, n_parts, abs(stated - computed)::DECIMAL(18,2) AS abs_diff,
  abs(stated - computed) * 2 > 0.01 AND (stated = 0 OR computed = 0 OR abs(stated - computed) > 0.02 * greatest(abs(stated), abs(computed))) AS mismatch
FROM s WHERE n_parts >= 2 AND known = n_parts AND stated IS NOT NULL AND NOT (lo = stated AND hi = stated)""")
def segment_totals(t):
    kind = F.col("event_type")
    return tables.totals_above(t("events"), "user_id", "event_id", F.col("value"), kind == "purchase", kind == "error", ~kind.isin("click", "signup"))


@query(r"""
WITH r AS (SELECT doc_id, trim(unnest(regexp_extract_all(coalesce(text, ''), '[0-9.,]+')), '.,') AS r FROM documents),
v AS (SELECT doc_id, sum(CASE WHEN regexp_full_match(r, '[0-9]+[.,][0-9]+') AND (NOT regexp_matches(r, '[.,][0-9]{3}$') OR regexp_matches(r, '^0[.,]')) THEN CASE WHEN contains(r, ',') THEN 1 ELSE -1 END ELSE 0 END) AS s,
  bool_or(regexp_full_match(r, '[0-9]{1,3}(,[0-9]{3}){2,}')) AS c, bool_or(regexp_full_match(r, '[0-9]{1,3}([.][0-9]{3}){2,}')) AS d FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN s > 0 THEN 'comma' WHEN s < 0 THEN 'dot' END AS style, coalesce(c, false) AS comma_groups, coalesce(v.d, false) AS dot_groups FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id""")
def decimal_styles(t):
    style, comma, dot = tables.numeral_styles(F.col("text"))
    return t("documents").select("doc_id", style.alias("style"), comma.alias("comma_groups"), dot.alias("dot_groups"))


@query("""
WITH k AS (SELECT user_id, event_type, arg_max(value, event_id) AS twin FROM events WHERE event_id % 3 = 0 AND value IS NOT NULL GROUP BY ALL)
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, twin) AS value FROM events e LEFT JOIN k ON e.user_id = k.user_id AND e.event_type = k.event_type""")
def twin_propagation(t):
    rows = t("events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return tables.from_twins(rows, ["user_id", "event_type"], "value", "event_id").select("event_id", "value")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey AS k, o_orderkey % 40 AS a, o_orderkey % 40 + o_orderkey % 9 AS b, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS title FROM orders),
p AS (SELECT o_custkey, o_orderkey, o_orderkey % 41 AS page FROM orders)
SELECT p.o_custkey, p.o_orderkey, page, arg_max(title, k) FILTER (WHERE title IS NOT NULL) AS title, max(k) AS section_id FROM p LEFT JOIN s ON p.o_custkey = s.o_custkey AND page BETWEEN a AND b GROUP BY ALL""")
def nearest_heading(t):
    key = F.col("o_orderkey")
    sections = t("orders").select("o_custkey", key.alias("section_id"), key.alias("k"), (key % 40).alias("a"), (key % 40 + key % 9).alias("b"), F.when(key % 7 != 0, F.col("o_orderpriority")).alias("title"))
    pages = t("orders").select("o_custkey", "o_orderkey", (key % 41).alias("page"))
    return tables.covering_heading(pages, sections, "o_custkey", "page", "a", "b", "title", "section_id", "k").select("o_custkey", "o_orderkey", "page", "title", "section_id")


_PROFILES = [("retail", ["BUILDING", "FURNITURE"]), ("industry", ["MACHINERY", "AUTOMOBILE", "BUILDING"]), ("other", ["HOUSEHOLD"])]


@query(f"""
WITH p AS (SELECT c_nationkey, c_custkey // 20 AS grp, list(DISTINCT c_mktsegment) AS types FROM customer GROUP BY ALL),
o AS (SELECT *, {", ".join(f"len(list_intersect(types, {triggers})) AS n{k}" for k, (_, triggers) in enumerate(_PROFILES))} FROM p)
SELECT c_nationkey, grp, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 'retail' WHEN n1 >= n2 THEN 'industry' ELSE 'other' END AS profile FROM o""")
def package_profile(t):
    types = t("customer").groupBy("c_nationkey", F.expr("c_custkey div 20").alias("grp")).agg(F.collect_set("c_mktsegment").alias("types"))
    return types.select("c_nationkey", "grp", tables.profile(F.col("types"), _PROFILES).alias("profile"))


_FORMS = ("ТОО «{}»", "акционерное общество {}", "ИП  кх \"{}\"", "{}", "ао")


@query(rf"""
WITH n AS (SELECT c_custkey, CASE c_custkey % 5 {' '.join(f"WHEN {k} THEN replace('{f}', '{{}}', c_name)" for k, f in enumerate(_FORMS))} END AS name FROM customer),
l AS (SELECT c_custkey, trim(regexp_replace(translate(name, '{identity.QUOTES.replace("'", "''")}', '{' ' * len(identity.QUOTES)}'), '\s+', ' ', 'g')) AS label FROM n),
k AS (SELECT *, lower(label) AS whole, regexp_extract(lower(label), '^({'|'.join(sorted(identity.LEGAL_FORMS, key=len, reverse=True))})( |$)', 1) AS spelling FROM l)
SELECT c_custkey, label, coalesce(nullif(trim(substr(whole, length(spelling) + 1)), ''), whole) AS key,
  CASE spelling {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in identity.LEGAL_FORMS.items())} END AS form FROM k""")
def organisation_names(t):
    spelled = F.lit(None).cast("string")
    for k, form in enumerate(_FORMS):
        spelled = F.when(F.col("c_custkey") % 5 == k, F.replace(F.lit(form), F.lit("{}"), F.col("c_name"))).otherwise(spelled)
    return t("customer").select("c_custkey", identity.organisation(spelled).alias("o")).select("c_custkey", "o.*")


@query(r"""
WITH r AS (SELECT o_orderkey, 'No ' || lpad((o_orderkey * 7919)::VARCHAR, CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE 12 END, '0') AS raw, 1995 + o_orderkey % 110 AS a, 1998 + o_custkey % 107 AS b FROM orders),
d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM r)
SELECT o_orderkey, CASE WHEN length(digits) = 12 THEN digits END AS identifier, CASE WHEN a BETWEEN 2000 AND 2100 AND b BETWEEN 2000 AND 2100 AND a <= b THEN a || '-' || b END AS period FROM d""")
def identifiers_and_periods(t):
    key = F.col("o_orderkey")
    raw = F.concat(F.lit("No "), F.lpad((key * 7919).cast("string"), F.when(key % 3 == 0, 11).otherwise(12), F.lit("0")))
    return t("orders").select("o_orderkey", identity.identifier(raw).alias("identifier"), identity.period(1995 + key % 110, (1998 + F.col("o_custkey") % 107).cast("string")).alias("period"))


_NAMES = ("a/{}", "/{}", "../{}", ".{}", "b/../{}", "c\\{}", "{}", "{}..x", "")


@query(rf"""
WITH n AS (SELECT p_partkey, CASE p_partkey % 9 {' '.join(f"WHEN {k} THEN replace('{f}', '{{}}', p_name)" for k, f in enumerate(_NAMES))} END AS name FROM part),
s AS (SELECT *, NOT starts_with(name, '/') AND NOT list_contains(string_split(name, '/'), '..') AS path, name <> '' AND NOT contains(name, '/') AND NOT contains(name, chr(92)) AND NOT contains(name, '..') AS component FROM n)
SELECT p_partkey, path, path AND name <> '' AND NOT contains(name, chr(92)) AS posix_path, component, component AND NOT starts_with(name, '.') AS identifier FROM s""")
def safe_names(t):
    name = F.lit(None).cast("string")
    for k, form in enumerate(_NAMES):
        name = F.when(F.col("p_partkey") % len(_NAMES) == k, F.replace(F.lit(form), F.lit("{}"), F.col("p_name"))).otherwise(name)
    rows = t("part").select("p_partkey", name.alias("name"))
    n = F.col("name")
    return rows.select("p_partkey", identity.safe_path(n).alias("path"), identity.safe_posix_path(n).alias("posix_path"), identity.safe_component(n).alias("component"), identity.safe_identifier(n).alias("identifier"))


@query("""
WITH c AS (SELECT c_nationkey AS project_id, c_custkey // 3 AS document_id, c_custkey AS claim_id, (2000 + c_custkey % 4) || '-' || (2004 + c_nationkey % 2) AS period, c_nationkey % 5 <> 0 AND c_custkey % 3 <> 0 AS core FROM customer WHERE c_nationkey % 7 > 0 OR c_custkey % 4 = 1),
s AS (SELECT project_id, count(DISTINCT document_id) FILTER (WHERE core) AS docs, count(*) FILTER (WHERE NOT core) AS n_suppressed FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE core) > 0),
p AS (SELECT project_id, period, min(claim_id) AS claim_id FROM c WHERE core GROUP BY ALL),
l AS (SELECT project_id, count(*) AS n, string_agg(period, ', ' ORDER BY period) AS periods, string_agg(claim_id::VARCHAR, '|' ORDER BY period) AS claim_ids FROM p GROUP BY 1)
SELECT s.project_id, CASE WHEN n >= 2 AND docs >= 2 THEN periods END AS periods, CASE WHEN n >= 2 AND docs >= 2 THEN claim_ids END AS claim_ids, n_suppressed
FROM s JOIN l ON s.project_id = l.project_id WHERE (n >= 2 AND docs >= 2) OR n_suppressed > 0""")
def period_conflicts(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    claims = t("customer").where((nation % 7 > 0) | (key % 4 == 1)).select(
        nation.alias("project_id"), F.expr("c_custkey div 3").alias("document_id"), key.alias("claim_id"), identity.period(2000 + key % 4, 2004 + nation % 2).alias("period"),
        ((nation % 5 != 0) & (key % 3 != 0)).alias("core"))
    return entities.period_findings(claims)


@query("""
WITH o AS (SELECT o_orderkey AS project_id, CASE o_orderkey % 5 WHEN 0 THEN 'conflicting_identifier' WHEN 1 THEN 'unresolved_names' WHEN 2 THEN 'absent' WHEN 3 THEN 'confirmed_by_name' ELSE 'confirmed_by_identifier' END AS status, 1 + o_custkey % 3 AS n_names, o_custkey % 4 AS n_named, o_custkey % 6 AS n_documents, o_orderpriority IN ('1-URGENT', '2-HIGH') AS scanned FROM orders),
f AS (SELECT *, CASE WHEN status = 'conflicting_identifier' THEN 'conflicting_operator' WHEN status = 'unresolved_names' AND n_named >= 2 THEN 'unresolved_entity_identity' WHEN status = 'absent' AND n_documents >= 2 THEN 'insufficient_cross_document_context' END AS finding_type FROM o)
SELECT project_id, finding_type, CASE WHEN finding_type <> 'conflicting_operator' THEN 'info' WHEN n_names = 1 THEN 'medium' ELSE 'low' END AS severity,
  CASE finding_type WHEN 'conflicting_operator' THEN 'P4-A-IDENTIFIER' WHEN 'unresolved_entity_identity' THEN 'P4-A-UNRESOLVED' ELSE 'P4-A-ABSENT' END AS rule_id,
  (CASE finding_type WHEN 'conflicting_operator' THEN 0.85 WHEN 'unresolved_entity_identity' THEN 0.40 ELSE 0.35 END - CASE WHEN scanned THEN 0.15 ELSE 0 END)::DECIMAL(4,2) AS confidence
FROM f WHERE finding_type IS NOT NULL""")
def identity_findings(t):
    key, buyer = F.col("o_orderkey"), F.col("o_custkey")
    status = F.element_at(F.array(*map(F.lit, ("conflicting_identifier", "unresolved_names", "absent", "confirmed_by_name", "confirmed_by_identifier"))), (key % 5 + 1).cast("int"))
    scanned = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.array(F.lit("ocr_source"), F.lit("ocr_source")))
    operators = t("orders").select(key.alias("project_id"), status.alias("status"), (1 + buyer % 3).alias("n_names"), (buyer % 4).alias("n_named"), (buyer % 6).alias("n_documents"), scanned.alias("flags"))
    return entities.identity_findings(operators).select("project_id", "finding_type", "severity", "rule_id", confidence(F.col("finding_type"), F.col("flags")).alias("confidence"))
