"""Queries over names, graphs, versions and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.functions import text
from talus.operators import builtin, compare, graph, history, names
from talus.operators.order import numbered
from talus.session import spread, table

# Name and pattern of the link checks.
LINK_PATTERNS = [("plain_http", "^http://"), ("example_net", r"\.example\.net/"), ("referrer", "[?&]ref="), ("raw_ip", r"^https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")]


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_name").alias("name"))


def typosquat_pairs(spark, sf_dir):
    return names.confusables(_parts(spark, sf_dir), _corpus(spark, sf_dir))


def nearest_known(spark, sf_dir):
    return names.nearest_known(_parts(spark, sf_dir), _corpus(spark, sf_dir))


def phantom_names(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left_anti").select("doc_id", "source")


def incident_range_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    incidents = parts.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").alias("low"), F.max("p_size").alias("high")).select(
        "name", (F.col("low") + 10).alias("lo"), F.when(F.col("high") < 50, F.col("high") - 5).alias("hi")
    )
    rows = parts.select("p_partkey", F.col("p_brand").alias("name"), F.col("p_size").alias("version"))
    return names.in_range(rows, incidents).select("p_partkey", "name", F.col("version").cast("long").alias("version"))


def patch_suggestions(spark, sf_dir):
    """A rename to the nearest known name, else removal; the first patch of each target."""
    return _patches(_parts(spark, sf_dir).distinct(), _corpus(spark, sf_dir))


def _patches(missing, corpus):
    near = names.nearest_known(missing, corpus)
    out = missing.join(near, "name", "left").select(
        "name", F.when(F.col("known").isNotNull(), "rename").otherwise("remove").alias("action"), F.coalesce("known", F.lit("")).alias("target")
    )
    return names.first_by(out, ["name", "action"], ["target"])


def _edges(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("p"))
    n = parts.count()
    nodes = parts.select(F.col("p").alias("node"))
    edges = parts.where("p % 5 <> 0").select(F.col("p").alias("src"), ((F.col("p") * 7 + 3) % n).alias("dst"))
    return nodes, edges


def bfs_depth(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return graph.depths(nodes, edges, nodes.where("node % 50 = 1"))


def transitive_closure(spark, sf_dir):
    nodes, edges = _edges(spark, sf_dir)
    return graph.closure(nodes.where("node % 50 = 1"), edges)


def typosquat_pairs_whole(spark, sf_dir):
    """All distinct part names against all of them."""
    return names.confusables(_parts(spark, sf_dir), _parts(spark, sf_dir))


def nearest_known_whole(spark, sf_dir):
    return names.nearest_known(_parts(spark, sf_dir), _parts(spark, sf_dir))


def patch_suggestions_whole(spark, sf_dir):
    return _patches(_parts(spark, sf_dir).distinct(), _parts(spark, sf_dir))


def _graph(spark, sf_dir):
    """All nodes, and an edge p -> (7p + 3) % N from each; the keys of part run from 0."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    n = nodes.count()
    return nodes, nodes.select(F.col("node").alias("src"), ((F.col("node") * 7 + 3) % n).alias("dst"))


def bfs_depth_whole(spark, sf_dir):
    """Depths in the whole graph; the first part of each brand is a direct dependency."""
    nodes, edges = _graph(spark, sf_dir)
    direct = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("node")).select("node")
    return graph.depths(nodes, edges, direct, hops=8)


def transitive_closure_whole(spark, sf_dir):
    """Everything that each node reaches."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.closure_by_doubling(nodes, edges)


def allowlist_notes(spark, sf_dir):
    """What promotional parts, which stand for packages with an allowance, reach that has findings (order lines)."""
    _, edges = _graph(spark, sf_dir)
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("dep"), F.col("l_returnflag").alias("category"))
    allowances = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("dep"), F.lit("code_eval").alias("category"))
    return builtin.notes_along(edges, found, allowances).withColumn("categories", F.array_join("categories", ","))


def version_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return history.versions(orders.select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("released")))


def _tree(spark, sf_dir, source):
    docs = table(spark, sf_dir, "documents").where(F.col("source") == source)
    path = (F.col("n_chars") % 97).cast("string")
    return docs.groupBy(path.alias("path")).agg(F.max_by("text", "doc_id").alias("content"))


def file_set_diff(spark, sf_dir):
    return compare.file_diff(_tree(spark, sf_dir, "src0"), _tree(spark, sf_dir, "src1"))


def manifest_hash_verify(spark, sf_dir):
    declared = _tree(spark, sf_dir, "src0").select("path", F.sha2("content", 256).alias("declared_hash"))
    local = _tree(spark, sf_dir, "src1").select("path", F.sha2("content", 256).alias("local_hash"))
    return compare.mismatched(declared, local)


def _whole_tree(spark, sf_dir, source):
    """Every document of a source: its place by doc_id is the path, its hash stands for the content."""
    docs = table(spark, sf_dir, "documents").where(F.col("source") == source)
    held = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    placed = numbered(held, "doc_id", "content")
    return placed.select(F.col("ordinal").cast("string").alias("path"), "content")


def file_set_diff_whole(spark, sf_dir):
    return compare.file_diff(_whole_tree(spark, sf_dir, "src0"), _whole_tree(spark, sf_dir, "src1"))


def manifest_hash_verify_whole(spark, sf_dir):
    declared = _whole_tree(spark, sf_dir, "src0").select("path", F.col("content").alias("declared_hash"))
    local = _whole_tree(spark, sf_dir, "src1").select("path", F.col("content").alias("local_hash"))
    return compare.mismatched(declared, local)


def module_set_diff(spark, sf_dir):
    """What each supplier ships newly or no longer, before and after the middle of the orders."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    return compare.set_delta(items.where("l_linenumber <= 3"), items.where("l_linenumber > 3"), "l_suppkey", "l_partkey")


def delta_signals(spark, sf_dir):
    diff = module_set_diff(spark, sf_dir)
    spike = F.col("added") - F.col("removed")
    return diff.select("l_suppkey", F.when(spike >= 3, "spike").when(F.col("added") > 0, "added").otherwise("none").alias("signal"))


def import_density(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("kinds"), F.sum("l_quantity").alias("uses"))
    many, often = F.col("kinds") >= 5, F.col("uses") >= 150
    severity = F.when(many & often, "critical").when(many | often, "warning").otherwise("none")
    return grouped.select("l_orderkey", "kinds", F.col("uses").cast("long").alias("uses"), severity.alias("severity"))


def capability_mismatch(spark, sf_dir):
    """Declared and observed capabilities by supplier: what is used undeclared, what is declared unused."""
    items = table(spark, sf_dir, "lineitem")
    seen = items.select("l_suppkey", F.concat_ws("/", "l_returnflag", "l_linestatus").alias("capability")).distinct()
    declared = items.where("l_linenumber = 1 and l_quantity < 3 and l_suppkey % 2 = 0").select("l_suppkey", F.concat_ws("/", "l_returnflag", "l_linestatus").alias("capability")).distinct()
    owners = declared.select("l_suppkey").distinct()
    both = declared.withColumn("declared", F.lit(1)).join(seen.join(owners, "l_suppkey", "left_semi").withColumn("seen", F.lit(1)), ["l_suppkey", "capability"], "full_outer")
    problem = F.when(F.col("declared").isNull(), "undeclared_use").when(F.col("seen").isNull(), "declared_unused")
    return both.select("l_suppkey", "capability", problem.alias("problem")).where("problem is not null")


def capability_mismatch_whole(spark, sf_dir):
    """As above for every supplier, from two tables: an order's day is declared, a shipping day is observed.

    Valid capabilities are the days on which anything was shipped.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("capability"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("capability"))
    rows = items.count()
    declared = spread(items.select("l_suppkey", "l_orderkey"), rows, "l_orderkey").join(orders, "l_orderkey")
    # days stay numbers until the end
    found = compare.capability_problems(declared, items, items, "l_suppkey", 2 * rows)
    return found.withColumn("capability", F.date_format("capability", "yyyy-MM-dd"))


def shady_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("line"))
    return text.pattern_hits(pages, LINK_PATTERNS)


def secret_literals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains('"'))
    held = text.lines(docs, "doc_id", "text").where(F.col("line").rlike('(?i)token = "[0-9a-f]{16,}"'))
    return held.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def high_entropy_text(spark, sf_dir):
    return text.byte_entropy(table(spark, sf_dir, "documents"), "doc_id", "text").where("entropy > 4.2")


def decode_eval_cooccurrence(spark, sf_dir):
    """Bodies (lines) that hold both of two calls, here the words "the" and "from"."""
    held = text.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    both = F.col("line").contains("the ") & F.col("line").contains("from ")
    return held.where(both).groupBy("doc_id").agg(F.count("*").alias("n"))


def metadata_penalties(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("downloads"), F.countDistinct("o_orderpriority").alias("owners"))
    people = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    downloads = F.when(F.col("downloads") < 5, 20).when(F.col("downloads") < 10, 10).otherwise(0)
    owners = F.when(F.col("owners") <= 1, 5).otherwise(0)
    total = F.when(F.col("downloads").isNull(), 0).otherwise(downloads + owners + F.when(F.col("c_acctbal") < 0, 5).otherwise(0))
    return people.select("c_custkey", total.cast("long").alias("penalty"))


def pre_install_assessment(spark, sf_dir):
    """Only customers with warnings, and those in one line."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    people = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    parts = [
        F.when(F.col("n").isNull(), "unknown package"),
        F.when(F.col("n") < 5, "few downloads"),
        F.when(F.col("c_acctbal") < 0, "retired"),
    ]
    return people.select("c_custkey", F.concat_ws("; ", *parts).alias("warnings")).where("warnings <> ''")


def search_substring(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("re"))).select("p_partkey", "p_name")


def parse_judgment(spark, sf_dir):
    """The last verdict each conversation gives: user turns confirm, others refute."""
    turns = table(spark, sf_dir, "conversations")
    verdict = F.when(F.col("role") == "user", "confirmed").otherwise("refuted")
    last = turns.groupBy("conv_id").agg(F.max_by(verdict, "turn").alias("verdict"), F.count("*").alias("turns"))
    return last


QUERIES = {
    f.__name__: f
    for f in (
        typosquat_pairs, nearest_known, phantom_names, incident_range_join, patch_suggestions, bfs_depth, transitive_closure,
        version_history, file_set_diff, manifest_hash_verify, module_set_diff, delta_signals, import_density, capability_mismatch,
        capability_mismatch_whole, typosquat_pairs_whole, nearest_known_whole, patch_suggestions_whole, bfs_depth_whole,
        transitive_closure_whole, allowlist_notes, file_set_diff_whole, manifest_hash_verify_whole,
        shady_links, secret_literals, high_entropy_text, decode_eval_cooccurrence, metadata_penalties, pre_install_assessment,
        search_substring, parse_judgment,
    )
}

NAMES_SQL = """names AS (SELECT DISTINCT p_name AS name FROM part), known AS (SELECT DISTINCT p_name AS known FROM part WHERE p_partkey % 3 = 0)"""
NEAR_SQL = f"""{NAMES_SQL}, near AS (
  SELECT name, arg_min(known, (levenshtein(name, known), known)) AS known, min(levenshtein(name, known)) AS distance
  FROM names, known WHERE name <> known AND levenshtein(name, known) <= 2 GROUP BY name)"""
GRAPH_SQL = """
nodes AS (SELECT p_partkey - 1 AS node FROM part), edges AS (
  SELECT p_partkey - 1 AS src, ((p_partkey - 1) * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part WHERE (p_partkey - 1) % 5 <> 0)"""
TREES_SQL = """
trees AS (SELECT source, CAST(n_chars % 97 AS VARCHAR) AS path, sha256(arg_max(text, doc_id)) AS hash FROM documents WHERE source IN ('src0', 'src1') GROUP BY 1, 2),
a AS (SELECT path, hash AS old_hash FROM trees WHERE source = 'src0'), b AS (SELECT path, hash AS new_hash FROM trees WHERE source = 'src1')"""
WHOLE_NAMES_SQL = "names AS (SELECT DISTINCT p_name AS name FROM part), known AS (SELECT name AS known FROM names)"
WHOLE_GRAPH_SQL = "edges AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part)"
WHOLE_TREES_SQL = """
trees AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, sha256(coalesce(text, ''))) AS VARCHAR) AS path, sha256(coalesce(text, '')) AS hash
          FROM documents WHERE source IN ('src0', 'src1')),
a AS (SELECT path, hash AS old_hash FROM trees WHERE source = 'src0'), b AS (SELECT path, hash AS new_hash FROM trees WHERE source = 'src1')"""
DELTA_SQL = """
a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber > 3),
delta AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, count(*) FILTER (a.l_partkey IS NULL) AS added, count(*) FILTER (b.l_partkey IS NULL) AS removed,
                 count(*) FILTER (a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL) AS common
          FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey GROUP BY 1)"""
LINES_SQL = "held AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
PEOPLE_SQL = "o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS owners FROM orders GROUP BY 1)"

ORACLES = {
    "typosquat_pairs": f"""WITH {NAMES_SQL}, pairs AS (
        SELECT name, known, CASE WHEN levenshtein(name, known) = 1 THEN 'edit' WHEN length(name) = length(known) AND levenshtein(name, known) = 2 AND damerau_levenshtein(name, known) = 1 THEN 'swap'
          WHEN regexp_replace(name, '[-_.]', '', 'g') = regexp_replace(known, '[-_.]', '', 'g') THEN 'separator' END AS kind
        FROM names, known WHERE name <> known AND abs(length(name) - length(known)) <= 1) SELECT * FROM pairs WHERE kind IS NOT NULL""",
    "nearest_known": f"WITH {NEAR_SQL} SELECT name, known, CAST(distance AS BIGINT) AS distance FROM near",
    "phantom_names": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "incident_range_join": """WITH i AS (SELECT p_brand AS name, min(p_size) + 10 AS lo, CASE WHEN max(p_size) < 50 THEN max(p_size) - 5 END AS hi FROM part GROUP BY 1)
        SELECT p_partkey, p_brand AS name, CAST(p_size AS BIGINT) AS version FROM part JOIN i ON p_brand = name
        WHERE (lo IS NULL OR p_size >= lo) AND (hi IS NULL OR p_size <= hi)""",
    "patch_suggestions": f"WITH {NEAR_SQL} SELECT names.name, CASE WHEN known IS NULL THEN 'remove' ELSE 'rename' END AS action, coalesce(known, '') AS target FROM names LEFT JOIN near ON names.name = near.name",
    "bfs_depth": f"""WITH RECURSIVE {GRAPH_SQL}, walk(node, depth) AS (
        SELECT node, 1 FROM nodes WHERE node % 50 = 1 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 60)
        SELECT n.node, CAST(coalesce(min(depth), 1) AS BIGINT) AS depth FROM nodes n LEFT JOIN walk w ON n.node = w.node GROUP BY n.node""",
    "transitive_closure": f"""WITH RECURSIVE {GRAPH_SQL}, walk(root, node) AS (
        SELECT node, node FROM nodes WHERE node % 50 = 1 UNION SELECT root, dst FROM walk JOIN edges ON src = node) SELECT root, node FROM walk WHERE root <> node""",
    "version_history": """SELECT o_custkey AS package, o_orderkey AS version, lead(o_orderkey) OVER w AS previous,
        coalesce(lead(o_orderkey, 10) OVER w, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lookback
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)""",
    "file_set_diff": f"""WITH {TREES_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'removed'
        WHEN old_hash <> new_hash THEN 'modified' ELSE 'same' END AS status FROM a FULL JOIN b ON a.path = b.path""",
    "manifest_hash_verify": f"""WITH {TREES_SQL} SELECT a.path, CASE WHEN new_hash IS NULL THEN 'missing' ELSE 'mismatch' END AS problem
        FROM a LEFT JOIN b ON a.path = b.path WHERE new_hash IS NULL OR new_hash <> old_hash""",
    "module_set_diff": f"WITH {DELTA_SQL} SELECT * FROM delta",
    "delta_signals": f"WITH {DELTA_SQL} SELECT l_suppkey, CASE WHEN added - removed >= 3 THEN 'spike' WHEN added > 0 THEN 'added' ELSE 'none' END AS signal FROM delta",
    "import_density": """WITH g AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS kinds, CAST(sum(l_quantity) AS BIGINT) AS uses FROM lineitem GROUP BY 1)
        SELECT *, CASE WHEN kinds >= 5 AND uses >= 150 THEN 'critical' WHEN kinds >= 5 OR uses >= 150 THEN 'warning' ELSE 'none' END AS severity FROM g""",
    "capability_mismatch": """WITH seen AS (SELECT DISTINCT l_suppkey, l_returnflag || '/' || l_linestatus AS capability FROM lineitem),
        declared AS (SELECT DISTINCT l_suppkey, l_returnflag || '/' || l_linestatus AS capability FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 3 AND l_suppkey % 2 = 0),
        used AS (SELECT * FROM seen WHERE l_suppkey IN (SELECT l_suppkey FROM declared))
        SELECT l_suppkey, capability, 'undeclared_use' AS problem FROM (SELECT * FROM used EXCEPT SELECT * FROM declared)
        UNION ALL SELECT l_suppkey, capability, 'declared_unused' FROM (SELECT * FROM declared EXCEPT SELECT * FROM used)""",
    "capability_mismatch_whole": """WITH used AS (SELECT DISTINCT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS capability FROM lineitem),
        said AS (SELECT DISTINCT l_suppkey, strftime(o_orderdate, '%Y-%m-%d') AS capability FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        known AS (SELECT DISTINCT capability FROM used)
        SELECT l_suppkey, capability, 'undeclared_use' AS problem FROM (SELECT * FROM used WHERE l_suppkey IN (SELECT l_suppkey FROM said) EXCEPT SELECT * FROM said)
        UNION ALL SELECT l_suppkey, capability, 'unknown' FROM said WHERE capability NOT IN (SELECT capability FROM known)
        UNION ALL SELECT l_suppkey, capability, 'declared_unused' FROM (SELECT * FROM said EXCEPT SELECT * FROM used) WHERE capability IN (SELECT capability FROM known)""",
    "shady_links": " UNION ALL ".join(f"SELECT page_id, '{n}' AS pattern FROM pages WHERE regexp_matches(url, '{p}')" for n, p in LINK_PATTERNS),
    "secret_literals": f"""WITH {LINES_SQL} SELECT doc_id, count(*) AS n, min(line_no) AS first_line FROM held
        WHERE regexp_matches(line, '(?i)token = "[0-9a-f]{{16,}}"') GROUP BY doc_id""",
    "high_entropy_text": """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents),
        c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY 1, 2),
        s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_bytes, sum(n * log2(n)) AS weighed FROM c GROUP BY 1)
        SELECT doc_id, n_bytes, round(log2(n_bytes) - weighed / n_bytes, 6) AS entropy FROM s WHERE round(log2(n_bytes) - weighed / n_bytes, 6) > 4.2""",
    "decode_eval_cooccurrence": f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n FROM held WHERE contains(line, 'the ') AND contains(line, 'from ') GROUP BY doc_id",
    "metadata_penalties": f"""WITH {PEOPLE_SQL} SELECT c_custkey, CAST(CASE WHEN n IS NULL THEN 0 ELSE CASE WHEN n < 5 THEN 20 WHEN n < 10 THEN 10 ELSE 0 END
        + CASE WHEN owners <= 1 THEN 5 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 5 ELSE 0 END END AS BIGINT) AS penalty FROM customer LEFT JOIN o ON c_custkey = o_custkey""",
    "pre_install_assessment": f"""WITH {PEOPLE_SQL}, w AS (SELECT c_custkey, concat_ws('; ', CASE WHEN n IS NULL THEN 'unknown package' END,
        CASE WHEN n < 5 THEN 'few downloads' END, CASE WHEN c_acctbal < 0 THEN 'retired' END) AS warnings FROM customer LEFT JOIN o ON c_custkey = o_custkey)
        SELECT * FROM w WHERE warnings <> ''""",
    "search_substring": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're')",
    "parse_judgment": "SELECT conv_id, CASE WHEN arg_max(role, turn) = 'user' THEN 'confirmed' ELSE 'refuted' END AS verdict, count(*) AS turns FROM conversations GROUP BY conv_id",
}

ORACLES |= {
    "typosquat_pairs_whole": f"""WITH {WHOLE_NAMES_SQL}, pairs AS (
        SELECT name, known, CASE WHEN levenshtein(name, known) = 1 THEN 'edit' WHEN length(name) = length(known) AND levenshtein(name, known) = 2 AND damerau_levenshtein(name, known) = 1 THEN 'swap'
          WHEN regexp_replace(name, '[-_.]', '', 'g') = regexp_replace(known, '[-_.]', '', 'g') THEN 'separator' END AS kind
        FROM names, known WHERE name <> known AND abs(length(name) - length(known)) <= 1) SELECT * FROM pairs WHERE kind IS NOT NULL""",
    "nearest_known_whole": f"""WITH {WHOLE_NAMES_SQL} SELECT name, arg_min(known, (levenshtein(name, known), known)) AS known, CAST(min(levenshtein(name, known)) AS BIGINT) AS distance
        FROM names, known WHERE name <> known AND levenshtein(name, known) <= 2 GROUP BY name""",
    "patch_suggestions_whole": f"""WITH {WHOLE_NAMES_SQL}, near AS (SELECT name, arg_min(known, (levenshtein(name, known), known)) AS known FROM names, known
        WHERE name <> known AND levenshtein(name, known) <= 2 GROUP BY name)
        SELECT names.name, CASE WHEN known IS NULL THEN 'remove' ELSE 'rename' END AS action, coalesce(known, '') AS target FROM names LEFT JOIN near ON names.name = near.name""",
    "bfs_depth_whole": f"""WITH RECURSIVE {WHOLE_GRAPH_SQL}, walk(node, depth) AS (
        SELECT min(p_partkey), 1 FROM part GROUP BY p_brand UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < (SELECT count(*) FROM part))
        SELECT p_partkey AS node, CAST(coalesce(min(depth), 1) AS BIGINT) AS depth FROM part LEFT JOIN walk ON p_partkey = node GROUP BY p_partkey""",
    "transitive_closure_whole": f"""WITH RECURSIVE {WHOLE_GRAPH_SQL}, walk(root, node) AS (
        SELECT p_partkey, p_partkey FROM part UNION SELECT root, dst FROM walk JOIN edges ON src = node) SELECT root, node FROM walk WHERE root <> node""",
    "allowlist_notes": f"""WITH RECURSIVE {WHOLE_GRAPH_SQL}, walk(root, node) AS (
        SELECT p_partkey, p_partkey FROM part WHERE p_type = 'PROMO' UNION SELECT root, dst FROM walk JOIN edges ON src = node),
        counts AS (SELECT l_partkey, count(*) AS n_findings, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS categories FROM lineitem GROUP BY 1)
        SELECT root AS package, node AS dep, n_findings, categories FROM walk JOIN counts ON node = l_partkey WHERE root <> node""",
    "file_set_diff_whole": f"""WITH {WHOLE_TREES_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'removed'
        WHEN old_hash <> new_hash THEN 'modified' ELSE 'same' END AS status FROM a FULL JOIN b ON a.path = b.path""",
    "manifest_hash_verify_whole": f"""WITH {WHOLE_TREES_SQL} SELECT a.path, CASE WHEN new_hash IS NULL THEN 'missing' ELSE 'mismatch' END AS problem
        FROM a LEFT JOIN b ON a.path = b.path WHERE new_hash IS NULL OR new_hash <> old_hash""",
}
