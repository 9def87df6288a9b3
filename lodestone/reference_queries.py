"""Queries of the engine's own operators over the driver's tables, each with its SQL where SQL can express it.

documents stand in for source files (lang: language, source: namespace), pages for templates, embeddings
for vectors, and the star schema for the graph G0: regions, nations, customers, suppliers and parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import maths
from .functions import text as tx
from .functions import vectors as vx
from .operators import chunk, code_graph, graph, patterns, relational, rollup, search, store, templates
from .registry import query, table
from .storage import shared_folder
from .sources import repo
from .streaming import ingest


# --- A. predicates and projections
@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source = 'src3'")
def flt_payload_and_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(relational.payload_filter({"lang": ["en", "de"], "source": "src3"})).select("doc_id", "lang", "source")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'view') AND user_id = 7")
def flt_type_routing(spark, d):
    kinds = F.when(F.col("event_type") == "signup", "file").when(F.col("event_type") == "view", "class").otherwise("documentation")
    rows = relational.optional_filter(table(spark, d, "events"), user_id=7, value=None).withColumn("type", kinds)
    return rows.where(relational.search_type_filter("code")).select("event_id", "event_type")


@query("SELECT page_id, url FROM pages WHERE NOT contains(url, '/1') AND NOT contains(url, 'zz')")
def flt_exclude_substring(spark, d):
    return table(spark, d, "pages").where(relational.without_substrings(F.col("url"), ["/1", "zz"])).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^.*/[0-9].*5.*$') AND NOT regexp_matches(url, '^.*7.$')")
def flt_exclude_glob(spark, d):
    return table(spark, d, "pages").where(relational.without_globs(F.col("url"), ["*/[0-9]*5*", "*7?"])).select("page_id", "url")


@query("SELECT doc_id, lang FROM documents WHERE lower(lang) = 'fr'")
def flt_lang_ci(spark, d):
    return table(spark, d, "documents").where(relational.same_text(F.col("lang"), "FR")).select("doc_id", "lang")


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL' THEN 'steel' WHEN p_type LIKE '%BRASS' THEN 'brass' ELSE 'unknown' END AS kind,
    CASE lower(substr(p_brand, 1, 1)) WHEN 'b' THEN 'brand' ELSE NULL END AS family FROM part""")
def flt_suffix_case(spark, d):
    kind = F.when(F.endswith("p_type", F.lit("STEEL")), "steel").when(F.endswith("p_type", F.lit("BRASS")), "brass").otherwise("unknown")
    family = F.try_element_at(F.create_map(F.lit("b"), F.lit("brand")), F.lower(F.substring("p_brand", 1, 1)))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), family.alias("family"))


@query("""WITH exact AS (SELECT p_partkey, p_name FROM part WHERE p_name = 'o')
    SELECT * FROM exact UNION ALL (SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'o') AND NOT EXISTS (SELECT 1 FROM exact) ORDER BY p_partkey LIMIT 5)""")
def flt_component_lookup(spark, d):
    return relational.exact_else_partial(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "o", 5, ["p_partkey"])


_PRIORITY = " UNION ALL ".join(f"""SELECT '{text}' AS text, * FROM (SELECT kind, name FROM (SELECT 1 AS r, 'region' AS kind, r_name AS name FROM region WHERE contains(lower(r_name), '{text}')
    UNION ALL SELECT 2, 'nation', n_name FROM nation WHERE contains(lower(n_name), '{text}')
    UNION ALL SELECT 3, 'supplier', s_name FROM supplier WHERE contains(lower(s_name), '{text}')) ORDER BY r, name LIMIT 1)""" for text in ("a", "on", "pp", "zz"))


@query(_PRIORITY)
def flt_pattern_priority(spark, d):
    """Four lookups: found in the first part, the second, the third, and nowhere."""
    out = None
    for text in ("a", "on", "pp", "zz"):
        parts = [table(spark, d, t).where(F.contains(F.lower(c), F.lit(text))).select(F.lit(text).alias("text"), F.lit(t).alias("kind"), F.col(c).alias("name")) for t, c in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"))]
        found = relational.first_by_priority(parts, ["name"])
        out = found if out is None else out.unionByName(found)
    return out


@query("""SELECT lang, doc_id, rank, more FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank,
    greatest(count(*) OVER (PARTITION BY lang) - 5, 0) AS more FROM documents) WHERE rank <= 5""")
def flt_truncate_more(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return relational.top_with_rest(docs, "lang", [F.desc("n_chars"), F.asc("doc_id")], 5).select("lang", "doc_id", "rank", "more")


@query("""SELECT d.doc_id, coalesce(cast(quality AS VARCHAR), 'Unknown') AS quality,
    CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents d LEFT JOIN labels USING (doc_id)""")
def proj_defaults_preview(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("Unknown")).alias("quality"), tx.preview(F.col("text")).alias("preview"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id ELSE 'ns.p' || page_id END AS fq,
    replace('a.b.' || page_id, '.', '_') AS flat FROM pages""")
def str_fqn_basename(spark, d):
    ns = F.when(F.col("page_id") % 3 == 0, "").otherwise("ns")
    name = F.concat(F.lit("p"), F.col("page_id"))
    flat = F.replace(F.concat(F.lit("a.b."), F.col("page_id")), F.lit("."), F.lit("_"))
    return table(spark, d, "pages").select("page_id", tx.basename(F.col("url")).alias("base"), tx.qualified(ns, name).alias("fq"), flat.alias("flat"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


# --- the graph G0
def g0(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and edges (src, dst, type)."""
    t = lambda name: table(spark, d, name)
    node = lambda df, p, key, name, kind: df.select(F.concat(F.lit(p), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
    edge = lambda df, p, a, q, b, kind: df.select(F.concat(F.lit(p), F.col(a)).alias("src"), F.concat(F.lit(q), F.col(b)).alias("dst"), F.lit(kind).alias("type"))
    nodes = node(t("region"), "R:", "r_regionkey", "r_name", "region")
    for name, p, key, label in (("nation", "N:", "n_nationkey", "n_name"), ("customer", "C:", "c_custkey", "c_name"), ("supplier", "S:", "s_suppkey", "s_name"), ("part", "P:", "p_partkey", "p_name")):
        nodes = nodes.unionByName(node(t(name), p, key, label, name))
    edges = edge(t("nation"), "N:", "n_nationkey", "R:", "n_regionkey", "located_in")
    edges = edges.unionByName(edge(t("customer"), "C:", "c_custkey", "N:", "c_nationkey", "in_nation"))
    edges = edges.unionByName(edge(t("supplier"), "S:", "s_suppkey", "N:", "s_nationkey", "in_nation"))
    return nodes, edges.unionByName(edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "S:", "l_suppkey", "P:", "l_partkey", "supplies"))


G0 = """WITH RECURSIVE nodes AS (SELECT 'R:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region UNION ALL SELECT 'N:' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'C:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'P:' || p_partkey, 'part', p_name FROM part),
  edges AS (SELECT 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS dst, 'located_in' AS type FROM nation UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'in_nation' FROM customer
    UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'in_nation' FROM supplier UNION ALL SELECT DISTINCT 'S:' || l_suppkey, 'P:' || l_partkey, 'supplies' FROM lineitem),
  ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) """


# --- B. joins
@query(G0 + """, near AS (SELECT dst AS id, type AS kind, 'out' AS direction FROM edges WHERE src = 'N:3' UNION ALL SELECT src, type, 'in' FROM edges WHERE dst = 'N:3')
    SELECT n.id, coalesce(a.name, b.name) AS name, kind, direction FROM near n LEFT JOIN (SELECT * FROM nodes WHERE type = 'customer') a USING (id)
    LEFT JOIN (SELECT * FROM nodes WHERE type = 'supplier') b ON b.id = n.id WHERE coalesce(a.name, b.name) IS NOT NULL ORDER BY direction, id, kind LIMIT 100""")
def jn_related_entity(spark, d):
    nodes, edges = g0(spark, d)
    return relational.related_entities(edges, "N:3", nodes.where("type = 'customer'"), nodes.where("type = 'supplier'"))


@query("SELECT 'C' || c_custkey AS src, 'S' || s_suppkey AS dst FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 7 = s_suppkey % 7")
def jn_same_ns_theta(spark, d):
    """Customers as classes and suppliers as interfaces of a namespace, the nation; a class names one interface."""
    rows = lambda t, p, key, nation, kind, bases: table(spark, d, t).select(F.concat(F.lit(p), key).alias("id"), F.concat(F.lit("I"), F.pmod(key, F.lit(7))).alias("name"), F.lit(kind).alias("kind"), bases.alias("bases"), F.col(nation).cast("string").alias("namespace"), F.lit("").alias("order"))
    none = F.array().cast("array<string>")
    classes = rows("customer", "C", "c_custkey", "c_nationkey", "class", F.array(F.concat(F.lit("x.I"), F.pmod("c_custkey", F.lit(7)), F.lit("<T>"))))
    return code_graph.implementing(classes.unionByName(rows("supplier", "S", "s_suppkey", "s_nationkey", "interface", none))).drop("order")


@query("""SELECT DISTINCT source || '.C' || doc_id AS src, u || '.' || b AS dst FROM (SELECT doc_id, source, unnest([source, 'a.' || lang, 'Sys']) AS u FROM documents) CROSS JOIN (SELECT unnest(['x', 'y']) AS b)""")
def jn_cross_explode(spark, d):
    """Each document is a class of the namespace source with two bases, in a file with two usings."""
    row = lambda kind, name, parent, *bases: F.struct(F.lit(kind).alias("kind"), name.alias("name"), parent.alias("parent"), F.array(*[F.lit(b) for b in bases]).cast("array<string>").alias("bases"))
    rows = F.array(row("class", F.concat(F.lit("C"), "doc_id"), F.col("source"), "x", "y"), row("using", F.concat(F.lit("a."), "lang"), F.lit(None).cast("string")), row("using", F.lit("Sys"), F.lit(None).cast("string")))
    entities = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit("csharp").alias("language"), F.explode(rows).alias("r")).select("path", "language", "r.*")
    return code_graph.namespace_dependencies(entities)


@query("""SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) s
    ON s_nationkey = n_nationkey AND r = 1""")
def jn_first_match(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (-F.col("s_acctbal")).alias("debt"), "s_suppkey")
    return relational.first_match(table(spark, d, "nation").select("n_nationkey", "n_name"), s, "n_nationkey", "n_nationkey", ["debt", "s_suppkey"]).select("n_nationkey", "n_name", "s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def jn_semi_existing(spark, d):
    return relational.existing(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def jn_anti_resume(spark, d):
    failed = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return relational.unprocessed(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), failed, "doc_id")


@query(G0 + "SELECT src, dst FROM edges JOIN nodes ON dst = id WHERE nodes.type = 'nation' AND edges.type = 'in_nation' AND src LIKE 'S:%'")
def jn_edge_node_type(spark, d):
    nodes, edges = g0(spark, d)
    edges = edges.where("type = 'in_nation' AND src LIKE 'S:%'")
    return edges.join(nodes.where("type = 'nation'").select(F.col("id").alias("dst")), "dst").select("src", "dst")


@query(G0 + "SELECT id, coalesce(n, 0) AS n FROM (SELECT id FROM nodes WHERE type = 'nation') LEFT JOIN (SELECT id, count(*) AS n FROM ends GROUP BY id) USING (id) ORDER BY n DESC, id LIMIT 20")
def jn_key_entities(spark, d):
    nodes, edges = g0(spark, d)
    return graph.degrees(nodes.where("type = 'nation'"), edges).withColumnRenamed("degree", "n").orderBy(F.desc("n"), "id").limit(20)


# --- C. aggregation
@query(G0 + "SELECT 'node' AS what, coalesce(type, 'unknown') AS type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def agg_type_counts(spark, d):
    nodes, edges = g0(spark, d)
    return graph.type_counts(nodes, "node").unionByName(graph.type_counts(edges, "edge"))


@query("SELECT source, count(*) AS n_files, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS paths FROM documents WHERE source <> '' GROUP BY source")
def agg_group_paths(spark, d):
    rows = rollup.paths_by(table(spark, d, "documents"), "source", "doc_id")
    return rows.withColumn("paths", F.array_join(F.transform("paths", lambda x: x.cast("string")), ","))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def agg_last_wins(spark, d):
    return relational.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) FILTER (event_type <> 'view') AS value FROM events GROUP BY user_id""")
def agg_merge_attributes(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return relational.merge_attributes(rows, "user_id", "event_id")


@query("SELECT l_suppkey AS src, string_agg(p, ',' ORDER BY p) AS dependencies FROM (SELECT DISTINCT l_suppkey, l_partkey::VARCHAR AS p FROM lineitem WHERE l_suppkey <> l_partkey) GROUP BY l_suppkey")
def agg_dep_sets(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return relational.dependency_sets(edges).select(F.col("src").cast("long").alias("src"), F.array_join("dependencies", ",").alias("dependencies"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY l_suppkey, l_partkey")
def agg_dep_lists(spark, d):
    return relational.dependency_lists(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")
def agg_rel_hist_top10(spark, d):
    return rollup.histogram(table(spark, d, "events"), "event_type", 10)


@query("""SELECT count(*) AS files, count(DISTINCT source) AS namespaces, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 2000) AS large, bool_or(contains(text, 'password=')) AS has_secret FROM documents""")
def agg_scan_summary(spark, d):
    return rollup.scan_summary(table(spark, d, "documents"), "source", {"english": F.col("lang") == "en", "large": F.col("n_chars") > 2000}, {"has_secret": F.contains("text", F.lit("password="))})


@query("""SELECT source AS repo_id, count(DISTINCT doc_id) AS n_files, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, string_agg(DISTINCT 'q' || quality, ',' ORDER BY 'q' || quality) AS patterns,
    string_agg(DISTINCT 't' || toxic, ',' ORDER BY 't' || toxic) AS environment FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source""")
def agg_repo_rollup(spark, d):
    """Sources as repositories, labels as their patterns and facts."""
    files = table(spark, d, "documents").select("doc_id", F.col("source").alias("repo_id"), F.col("lang").alias("language"))
    marks = files.join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id")
    out = rollup.repository_rollup(files, marks.select("repo_id", F.concat(F.lit("q"), "quality").alias("name")), marks.select("repo_id", F.concat(F.lit("t"), "toxic").alias("fact")))
    return out.select("repo_id", "n_files", *[F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("languages", "patterns", "environment")])


@query("""SELECT dir, count(*) AS n FROM (SELECT DISTINCT page_id % 3 AS tree, array_to_string(p[1:n], '/') AS dir FROM (SELECT page_id, p, unnest(range(1, len(p))) AS n FROM (SELECT page_id, string_split(url, '/') AS p FROM pages))) WHERE dir <> '' GROUP BY dir""")
def agg_folder_keywords(spark, d):
    """The folders of three trees of URLs, and in how many of them each is."""
    return rollup.histogram(patterns.folders(table(spark, d, "pages").withColumn("tree", F.col("page_id") % 3), "url", ["tree"]), "dir")


# --- D. sets and order
@query("SELECT l_suppkey AS id FROM lineitem WHERE l_discount = 0.1 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 UNION SELECT l_partkey FROM lineitem WHERE l_tax = 0")
def set_union_distinct(spark, d):
    li = table(spark, d, "lineitem")
    return relational.union_distinct([li.where("l_discount = 0.1").select(F.col("l_suppkey").alias("id")), table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")), li.where("l_tax = 0").select(F.col("l_partkey").alias("id"))])


@query("""SELECT k, kind FROM (SELECT k, kind, row_number() OVER (PARTITION BY k ORDER BY p) AS r FROM (SELECT doc_id AS k, 'label' AS kind, 1 AS p FROM labels
    UNION ALL SELECT doc_id, 'document', 2 FROM documents UNION ALL SELECT page_id, 'page', 3 FROM pages)) WHERE r = 1""")
def set_except_prec(spark, d):
    return relational.by_precedence([table(spark, d, t).select(F.col(c).alias("k"), F.lit(kind).alias("kind")) for t, c, kind in (("labels", "doc_id", "label"), ("documents", "doc_id", "document"), ("pages", "page_id", "page"))], ["k"])


@query("""SELECT name, confidence, n FROM (SELECT event_type AS name, CASE WHEN count(*) FILTER (value > 95) > 0 THEN 'high' WHEN count(*) % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM events GROUP BY event_type)
    ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, n DESC, name LIMIT 3""")
def top_conf_rank(spark, d):
    n = F.count(F.lit(1))
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.when(F.count_if(F.col("value") > 95) > 0, "high").when(n % 2 == 0, "medium").otherwise("low").alias("confidence"), n.alias("n"))
    return rows.orderBy(relational.confidence_rank(), F.desc("n"), "name").limit(3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def top_limit_ordered(spark, d):
    return relational.first_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"])


# --- E. graph
@query(G0 + "SELECT id, degree, round(degree / (SELECT count(*) - 1 FROM nodes)::DOUBLE, 6) AS centrality FROM (SELECT id, count(*) AS degree FROM ends GROUP BY id) ORDER BY degree DESC, id LIMIT 10")
def grf_degree_centrality(spark, d):
    return graph.degree_centrality(*g0(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query(G0 + "SELECT dst AS id, type, 'out' AS direction FROM edges WHERE src = 'N:0' UNION ALL SELECT src, type, 'in' FROM edges WHERE dst = 'N:0'")
def grf_one_hop(spark, d):
    return graph.one_hop(g0(spark, d)[1], "N:0")


@query(G0 + """, reach AS (SELECT 'S:1' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = reach.id WHERE depth < 10)
    SELECT id, min(depth) AS depth FROM reach GROUP BY id""")
def grf_closure(spark, d):
    start = spark.createDataFrame([("S:1",)], "id string")
    return graph.closure(g0(spark, d)[1], start).select("id", "depth")


@query(G0 + "SELECT dst AS id, count(DISTINCT src) AS n, CASE WHEN count(DISTINCT src) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM edges WHERE type = 'supplies' GROUP BY dst HAVING count(DISTINCT src) > 1")
def grf_strategy(spark, d):
    nodes, edges = g0(spark, d)
    edges = edges.withColumn("type", F.when(F.col("type") == "supplies", "implements").otherwise(F.col("type")))
    return graph.implementations(edges, nodes.where("type = 'part'")).where("n > 1").withColumn("confidence", F.when(F.col("n") >= 3, "high").otherwise("medium"))


@query("""SELECT role, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'steel') THEN 'controller' WHEN contains(t, 'brass') THEN 'model' WHEN contains(t, 'promo') THEN 'view' END AS role
    FROM (SELECT lower(p_type) AS t FROM part)) WHERE role IS NOT NULL GROUP BY role""")
def grf_mvc_classes(spark, d):
    name = F.replace(F.replace(F.replace(F.lower("p_type"), F.lit("steel"), F.lit("controller")), F.lit("brass"), F.lit("model")), F.lit("promo"), F.lit("view"))
    return table(spark, d, "part").groupBy(graph.mvc_role(name).alias("role")).agg(F.count(F.lit(1)).alias("n")).where("role IS NOT NULL")


# --- F. text and vectors
_LINES = "list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))"


@query(f"""SELECT doc_id, len(l)::BIGINT AS line_count, len(list_filter(l, lambda x: x = ''))::BIGINT AS empty_line_count,
    len(list_filter(l, lambda x: starts_with(x, '#') OR starts_with(x, '//') OR starts_with(x, '/*') OR starts_with(x, '*')))::BIGINT AS comment_line_count FROM (SELECT doc_id, {_LINES} AS l FROM documents)""")
def txt_line_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.line_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("""SELECT doc_id, score FROM (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w IN ('the', 'thing', 'and')))::BIGINT AS score FROM documents WHERE lang = 'en')
    WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def txt_search_topk(spark, d):
    return search.text_search(table(spark, d, "documents"), ["the", "thing", "AND"], where=F.col("lang") == "en", key="doc_id", text="text").select("doc_id", "score")


_FRAGMENT = "<app-card-{i} *ngIf=\"a{i}\" [value]=\"b\"><input formControlName=\"c{i}\">{{x | date}}</app-card-{i}>"
_KINDS = {"component": "<([a-z]+-[a-z0-9-]+)[^>]*>", "structural": "\\*([A-Za-z]+)=", "bracket": "\\[([A-Za-z]+)\\]", "pipe": "\\|\\s*([A-Za-z0-9]+)", "control": "formControlName=[\"'']([^\"'']+)[\"'']", "tag": "<([a-z][a-z0-9]*)[\\s>/]", "link": "href=[\"'']([^\"'']+)[\"'']"}
_MARKED_HTML = "html || replace('" + _FRAGMENT + "', '{i}', page_id::VARCHAR)"


@query("SELECT DISTINCT page_id, CASE WHEN kind IN ('structural', 'bracket') THEN 'directive' ELSE kind END AS kind, token FROM (" + " UNION ALL ".join(f"SELECT page_id, '{kind}' AS kind, unnest(regexp_extract_all({_MARKED_HTML}, '{pattern}', 1)) AS token FROM pages" for kind, pattern in _KINDS.items()) + ")")
def tpl_tokens(spark, d):
    """Tokens of all pages, each with a template's fragment behind it."""
    html = F.concat("html", F.replace(F.lit(_FRAGMENT), F.lit("{i}"), F.col("page_id").cast("string")))
    tokens = templates.template_tokens(html)
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), tokens[name].alias("tokens")) for kind, name in (("component", "components"), ("directive", "directives"), ("pipe", "pipes"), ("control", "form_controls"), ("tag", "tags"), ("link", "links"))])
    rows = table(spark, d, "pages").select("page_id", F.explode(kinds).alias("k"))
    return rows.select("page_id", "k.kind", F.explode("k.tokens").alias("token"))


_CHUNKS = """WITH RECURSIVE ln AS (SELECT doc_id, u.i - 1 AS i, length(u.l) + 1 AS n FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(a)), lambda k: struct_pack(i := k, l := a[k]))) u
      FROM (SELECT doc_id, string_split(text, chr(10)) a FROM documents WHERE length(text) > 2000))),
  pp AS (SELECT doc_id, i, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p, count(*) OVER (PARTITION BY doc_id) AS c FROM ln),
  st AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS s, NULL::BIGINT AS fs, NULL::BIGINT AS fe FROM pp UNION ALL
    SELECT st.doc_id, st.i + 1, CASE WHEN x.p - y.p + x.n > 2000 AND x.p - y.p > 100 THEN st.i - least(st.i - st.s, 5) ELSE st.s END,
      CASE WHEN x.p - y.p + x.n > 2000 AND x.p - y.p > 100 THEN st.s END, CASE WHEN x.p - y.p + x.n > 2000 AND x.p - y.p > 100 THEN st.i - 1 END
    FROM st JOIN pp x ON x.doc_id = st.doc_id AND x.i = st.i JOIN pp y ON y.doc_id = st.doc_id AND y.i = st.s)
SELECT doc_id, fs::INT AS start_line, fe::INT AS end_line FROM st WHERE fs IS NOT NULL UNION ALL
SELECT st.doc_id, st.s::INT, (st.i - 1)::INT FROM st JOIN pp e ON e.doc_id = st.doc_id AND e.i = st.i - 1 JOIN pp y ON y.doc_id = st.doc_id AND y.i = st.s WHERE st.i = e.c AND e.p + e.n - y.p > 100
UNION ALL SELECT doc_id, 0, (len(string_split(text, chr(10))) - 1)::INT FROM documents WHERE length(text) <= 2000"""


@query(_CHUNKS)
def chk_generic(spark, d):
    rows = chunk.line_ranges(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.explode("ranges").alias("r")).select("doc_id", "r.start_line", "r.end_line")


_Q = [0.05 * (i % 7) - 0.1 for i in range(64)]
_QSQL = "[" + ", ".join(f"{x:.17g}" for x in _Q) + "]::DOUBLE[]"
_V = "list_transform(embedding, lambda x: x::DOUBLE)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


@query(f"SELECT vec_id AS id, label, round(list_cosine_similarity({_V}, {_QSQL}), 6) AS score FROM embeddings WHERE label IN (1, 3, 5) ORDER BY score DESC, id LIMIT 5")
def vec_topk_filtered(spark, d):
    return search.similar(_vectors(spark, d), _Q, 5, where=relational.payload_filter({"label": [1, 3, 5]})).select("id", "label", "score")


@query(f"SELECT vec_id AS id, round(list_distance({_V}, {_QSQL}), 6) AS score FROM embeddings ORDER BY score, id LIMIT 10")
def vec_topk_euclid(spark, d):
    return search.similar(_vectors(spark, d), _Q, 10, how="euclid").select("id", "score")


@query(f"SELECT vec_id AS id, round(list_inner_product({_V}, {_QSQL}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def vec_topk_dot(spark, d):
    return search.similar(_vectors(spark, d), _Q, 10, how="dot").select("id", "score")


@query(f"""SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.vec_id) AS rank
    FROM (SELECT vec_id, {_V} AS v FROM embeddings WHERE vec_id % 100 = 0) q CROSS JOIN (SELECT vec_id, {_V} AS v FROM embeddings) e) WHERE rank <= 2""")
def vec_multi_query(spark, d):
    v = _vectors(spark, d)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return search.similar_to_each(v, queries, 2).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (3, 17, 99, 123456789)")
def vec_by_ids(spark, d):
    return search.by_ids(_vectors(spark, d), [3, 17, 99, 123456789]).select("id", "label")


@query(f"SELECT vec_id AS id, round(sqrt(list_inner_product({_V}, {_V})), 6) AS norm FROM embeddings")
def vec_norms(spark, d):
    return _vectors(spark, d).select("id", F.round(vx.l2_norm(F.col("embedding")), 6).alias("norm"))


@query()
def vec_mock_embed(spark, d):
    return table(spark, d, "documents").select("doc_id", vx.mock_embed(16)(F.col("text")).alias("embedding"))


# --- G. rules
_RULES = [("e-mail", "high", r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+"), ("license line", "medium", r"[Ll]icensed under"), ("digits", "low", r"[0-9]{4,}"), ("table", "medium", r" \| [^|\n]+ \| "), ("shouting", "low", r"[A-Z]{5,}")]
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, '{c}' AS confidence, source, doc_id * 10 + {i} AS seq FROM documents WHERE regexp_matches(text, '{r}')" for i, (n, c, r) in enumerate(_RULES))


def _hits(spark, d):
    rules = [patterns.Rule(n, "D", c, (r,)) for n, c, r in _RULES]
    return patterns.rule_hits(table(spark, d, "documents"), rules, text="text", keep=["doc_id", "source"], seq=F.col("doc_id") * 10)


@query(f"SELECT doc_id, name, confidence, source, seq FROM ({_HITS})")
def rule_hits(spark, d):
    return _hits(spark, d).select("doc_id", "name", "confidence", "source", "seq")


@query(f"""SELECT name, CASE WHEN bool_or(confidence = 'high') OR count(*) > 2 THEN 'high' ELSE min_by(confidence, seq) END AS confidence, count(*) AS count, min(seq) AS first_seq
    FROM ({_HITS}) GROUP BY name""")
def rule_dedup(spark, d):
    return relational.sort_patterns(relational.dedup_patterns(_hits(spark, d)))


@query(f"SELECT name, seq, source FROM ({_HITS})")
def rule_sources(spark, d):
    return relational.pattern_sources(_hits(spark, d))


# --- H. incremental
@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stm_available_now(spark, d):
    target = ingest.copy_available(spark, f"{d}/events.parquet", shared_folder(spark, "stream"))
    return target.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT id, name, price FROM (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS price FROM part
    UNION ALL SELECT -p_partkey, NULL, p_retailprice * 2 FROM part WHERE p_partkey % 5 = 0) WHERE id % 7 <> 0""")
def snk_upsert_all(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    to = store.Table(spark, shared_folder(spark, "table"), ["id"])
    to.upsert(part)
    more = part.where("id % 5 = 0").select(F.explode(F.array(F.col("id"), -F.col("id"))).alias("id"), (F.col("price") * 2).alias("price"))
    to.upsert(more)
    to.delete(F.col("id") % 7 == 0)
    return to.read()


@query("""SELECT l_orderkey AS repo_id, l_linenumber AS line, l_quantity AS quantity FROM lineitem WHERE l_linenumber <> 2 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 2
    UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders""")
def snk_append(spark, d):
    """Line items in two appends and orders in a third: no append reads or writes again what is there."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("repo_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    to = store.Table(spark, shared_folder(spark, "table"), ["repo_id", "line"])
    to.append(li.where("line != 2"))
    to.append(li.where("line = 2"))
    to.append(table(spark, d, "orders").select(F.col("o_orderkey").alias("repo_id"), F.lit(0).cast(li.schema["line"].dataType).alias("line"), F.col("o_totalprice").alias("quantity")))
    return to.read()


@query("SELECT vec_id AS id, label, CASE WHEN label = 3 THEN 'new' ELSE 'old' END AS state FROM embeddings WHERE label <> 5")
def snk_replace(spark, d):
    """Vectors as parts by label: one label's rows replaced, one's taken away."""
    v = _vectors(spark, d).select("id", "label", F.lit("old").alias("state"))
    to = store.Table(spark, shared_folder(spark, "table"), ["id"], by="label")
    to.overwrite(v)
    to.replace("3", v.where("label = 3").withColumn("state", F.lit("new")))
    to.replace("5", v.where("label = 5").limit(0))
    return to.read()


@query("SELECT 0 AS n")
def snk_clear(spark, d):
    to = store.Table(spark, shared_folder(spark, "table"), ["id"])
    to.overwrite(_vectors(spark, d).select("id"))
    to.clear()
    return to.read().agg(F.count(F.lit(1)).cast("int").alias("n"))


# --- I. files of other kinds, texts and numbers
@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'csharp' WHEN 3 THEN NULL WHEN 4 THEN 'c' ELSE 'bash' END AS language, CASE WHEN p_partkey % 6 = 1 THEN 'service' ELSE 'unknown' END AS kind FROM part")
def flt_language_kind(spark, d):
    path = F.concat(F.lit("a.b/f"), "p_partkey", F.element_at(F.array(*[F.lit(x) for x in (".py", ".service.ts", ".CS", ".zip", ".h", ".sh")]), F.pmod("p_partkey", F.lit(6)).cast("int") + 1))
    return table(spark, d, "part").select("p_partkey", tx.language_of(path).alias("language"), tx.file_kind(path).alias("kind"))


@query("SELECT event_id, (event_id // 24) || 'd ' || (event_id % 24) || 'h ' || (event_id % 60) || 'm ' || (event_id % 59) || 's' AS up FROM events")
def mth_uptime(spark, d):
    e = F.col("event_id")
    seconds = F.floor(e / 24) * 86400 + F.pmod(e, F.lit(24)) * 3600 + F.pmod(e, F.lit(60)) * 60 + F.pmod(e, F.lit(59))
    return table(spark, d, "events").select("event_id", tx.uptime(seconds).alias("up"))


@query("SELECT event_id, (event_id + 2) * 3 - event_id % 5 AS x, event_id ** 2 / 4 AS y FROM events")
def mth_arithmetic(spark, d):
    value = F.udf(lambda text: float(maths.evaluate(text)), "double")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.col("event_id") for p in parts])
    return table(spark, d, "events").select("event_id", value(t("(", 0, " + 2) * 3 - ", 0, " % 5")).cast("long").alias("x"), value(t(0, " ** 2 / 4")).alias("y"))


@query("SELECT doc_id, 'A b' || doc_id || '.' AS xml, 'Line ' || doc_id || chr(10) || chr(10) || 'end' AS js, ['a', 'b' || doc_id] AS parts FROM documents")
def str_clean_docs(spark, d):
    i = F.col("doc_id").cast("string")
    xml = F.concat(F.lit("/// <summary>\n///  A   b"), i, F.lit(".\n/// </summary>"))
    js = F.concat(F.lit("/**\n * Line "), i, F.lit("  \n *\n * end\n */"))
    return table(spark, d, "documents").select("doc_id", tx.clean_xml_doc(xml).alias("xml"), tx.clean_jsdoc(js).alias("js"), tx.split_trim(F.concat(F.lit(" a ,, b"), i, F.lit(" , "))).alias("parts"))


@query("SELECT doc_id, n_chars <= 1048576 AS small, text = '' OR text IS NULL AS nothing FROM documents WHERE lower(lang) IN ('en', 'fr')")
def flt_size_extension(spark, d):
    docs = table(spark, d, "documents").where(relational.payload_filter({"lang": ["en", "fr"]}))
    return docs.select("doc_id", (F.col("n_chars") <= repo.MOST_BYTES).alias("small"), F.coalesce(F.col("text") == "", F.lit(True)).alias("nothing"))
