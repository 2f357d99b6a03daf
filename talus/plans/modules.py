"""Compiled modules: chunk files made of the order tables in the JVM, read back by the decoder, kept in a profile cache.

No table holds compiled modules, so each order becomes a file: its items are instructions, its key is its version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import documents
from talus.operators import cache, profiles
from talus.plans.packages import IMPORTS, _import
from talus.session import scratch, table
from talus.sources.beam import read_modules


def _hex(value: Column | int, digits: int) -> Column:
    return F.lpad(F.hex(value if isinstance(value, Column) else F.lit(value)), digits, "0")


def _compact(tag: int, value: Column) -> Column:
    """A compact term of one to four bytes, in hexadecimal."""
    head = lambda lead: _hex(lead.bitwiseOR(F.lit(tag)), 2)
    return (
        F.when(value < 16, head(F.shiftleft(value, 4)))
        .when(value < 2048, F.concat(head(F.shiftleft(F.shiftright(value, 8), 5).bitwiseOR(F.lit(8))), _hex(value.bitwiseAND(F.lit(255)), 2)))
        .when(value < 32768, F.concat(head(F.lit(24)), _hex(value, 4)))
        .otherwise(F.concat(head(F.lit(56)), _hex(value, 6)))
    )


def _chunk(name: str, body: Column) -> Column:
    size = (F.length(body) / 2).cast("int")
    return F.concat(F.lit(name.encode().hex()), _hex(size, 8), body, F.repeat(F.lit("00"), F.pmod(-size, F.lit(4))))


def _atoms(*names: Column) -> Column:
    each = [F.concat(_hex(F.octet_length(n), 2), F.hex(n.cast("binary"))) for n in names]
    return F.concat(_hex(len(names), 8), *each)


def module_files(spark, sf_dir) -> DataFrame:
    """path and content of a chunk file for each order: an instruction an item, a literal an item; every fiftieth is cut off."""
    items = table(spark, sf_dir, "lineitem")
    number, part, supplier = F.col("l_linenumber").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
    code = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("4B"), _compact(0, number)))  # call_fun
        .when((F.col("l_returnflag") == "A") & (F.col("l_quantity") % 2 == 0), F.concat(F.lit("70"), _compact(0, number)))  # apply
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("71"), _compact(0, number), _compact(0, part)))  # apply_last
        .when(F.col("l_linestatus") == "O", F.concat(F.lit("4047"), _compact(0, part), _compact(3, supplier)))  # move a literal
        .otherwise(F.concat(F.lit("B2"), _compact(3, supplier), _compact(0, number), _compact(4, part)))  # call_fun2
    )
    integer = F.concat(F.lit("8362"), _hex(part, 8))
    made = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", code.alias("code"), integer.alias("literal")))).alias("made"))
    joined = lambda c: F.array_join(F.transform("made", lambda x: x[c]), "")
    n = F.size("made")
    head = F.concat(_hex(16, 8), _hex(0, 8), _hex(184, 8), _hex(1, 8), _hex(1, 8))
    terms = F.array_join(F.transform("made", lambda x: F.concat(F.lit("00000006"), x["literal"])), "")
    name = F.concat(F.lit("m"), F.col("l_orderkey").cast("string"))
    attributes = F.concat(
        F.lit("836C00000002" + "68027703" + b"vsn".hex() + "6C0000000162"), _hex(F.col("l_orderkey"), 8), F.lit("6A"),
        F.lit("68027706" + b"author".hex() + "6D00000005" + b"clerk".hex() + "6A"),
    )
    parts = [
        _chunk("AtU8", _atoms(name, F.lit("erlang"), F.lit("apply"), F.lit("run"))),
        _chunk("Code", F.concat(head, joined("code"), F.lit("03"))),
        _chunk("ImpT", F.concat(_hex(1, 8), _hex(2, 8), _hex(3, 8), _hex(3, 8))),
        _chunk("ExpT", F.concat(_hex(1, 8), _hex(4, 8), _hex(n, 8), _hex(2, 8))),
        _chunk("Attr", attributes),
        _chunk("LitT", F.concat(_hex(0, 8), _hex(n, 8), terms)),
    ]
    body = F.concat(F.lit(b"BEAM".hex()), *parts)
    whole = F.unhex(F.concat(F.lit(b"FOR1".hex()), _hex((F.length("body") / 2).cast("int"), 8), "body"))
    cut = F.when(F.col("l_orderkey") % 50 == 7, F.substring(whole, 1, 60)).otherwise(whole)
    path = F.concat(F.lit("_build/dev/lib/app/ebin/"), name, F.lit(".beam"))
    return made.withColumn("body", body).select("l_orderkey", path.alias("path"), cut.alias("content"))


def chunk_profiles(spark, sf_dir):
    """What the decoder reads back of every file; damaged ones give only a reason."""
    found = read_modules(module_files(spark, sf_dir))
    return found.select(
        "l_orderkey", "module", F.col("dispatch").cast("long").alias("dispatch"), F.col("n_literals").cast("long").alias("n_literals"),
        F.col("attributes")["vsn"].alias("vsn"), F.col("attributes")["author"].alias("author"), F.col("exports")[0]["a"].cast("long").alias("arity"),
        F.col("reason").isNull().alias("sound"),
    )


CHUNK_SQL = """
SELECT l_orderkey, CASE WHEN sound THEN 'm' || l_orderkey END AS module, CASE WHEN sound THEN dispatch END AS dispatch, CASE WHEN sound THEN n END AS n_literals,
       CASE WHEN sound THEN '[' || l_orderkey || ']' END AS vsn, CASE WHEN sound THEN '<<99,108,101,114,107>>' END AS author, CASE WHEN sound THEN n END AS arity, sound
FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (NOT (l_returnflag = 'N' AND l_linestatus = 'O')) AS dispatch, l_orderkey % 50 <> 7 AS sound
      FROM lineitem GROUP BY l_orderkey)"""

QUERIES = {"chunk_profiles": chunk_profiles}
ORACLES = {"chunk_profiles": CHUNK_SQL}


def _cached_profiles(spark, sf_dir) -> DataFrame:
    """Profiles by package and version: suppliers in packages, line numbers as versions, parts in modules."""
    items = table(spark, sf_dir, "lineitem").withColumn("i", _import(spark, sf_dir))
    keys = [
        F.concat(F.lit("p"), (F.col("l_suppkey") % 25).cast("string")).alias("package"),
        F.concat(F.lit("0."), (F.col("l_linenumber") + 5).cast("string"), F.lit(".0")).alias("version"),
        F.concat(F.lit("M"), (F.col("l_partkey") % 40).cast("string")).alias("module"), "l_returnflag",
    ]
    none = F.array().cast("array<struct<f:string,a:int>>")
    made = items.groupBy(*keys).agg(F.collect_set("i").alias("imports"), F.count("*").cast("int").alias("dispatch"))
    return made.withColumns({"exports": none, "atoms": F.array().cast("array<string>")})


def profile_cache(spark, sf_dir):
    """Every version saved, one of each package saved anew, one dropped; then what the store holds of each, and its prior version."""
    found = _cached_profiles(spark, sf_dir)
    whole = found.groupBy("package", "version", "module").agg(
        F.array_distinct(F.flatten(F.collect_list("imports"))).alias("imports"), F.sum("dispatch").cast("int").alias("dispatch"), F.first("exports").alias("exports"), F.first("atoms").alias("atoms")
    )
    root = scratch(spark, "profiles")
    cache.save(whole, root)
    cache.save(found.where("version = '0.8.0' and l_returnflag = 'A'").drop("l_returnflag"), root)
    cache.drop(spark, root, "p3", "0.9.0")
    held = cache.stored(spark, root)
    counts = held.groupBy("package", "version").agg(F.count("*").alias("n_modules"), F.sum(F.size("imports")).alias("n_imports"), F.countDistinct("digest").alias("n_digests"))
    cached = cache.versions(spark, root).withColumnRenamed("package", "dep")
    prior = profiles.prior_versions(cached, cached.select("dep").distinct().withColumn("version", F.lit("0.9.0")))
    return counts.join(prior.withColumnRenamed("dep", "package"), "package", "left")


def _manifest_texts(spark, sf_dir) -> DataFrame:
    """A manifest for each order, its keys in one of three orders and spacings; some are cut off, some no object."""
    c = F.col
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("made"))
    number = lambda value: value.cast("string")
    hashes = F.array_join(F.transform("made", lambda x: F.concat(F.lit('{"module": "M'), number(x["l_linenumber"]), F.lit('", "content_hash" :"'), F.hex(x["l_partkey"]), F.lit('"}'))), ", ")
    signer = F.when(c("l_orderkey") % 4 == 0, "null").otherwise(F.concat(F.lit('"s'), number(c("l_orderkey") % 7), F.lit('"')))
    items = items.withColumn("hashes", hashes)
    parts = [
        F.concat(F.lit('"package":"p'), number(c("l_orderkey") % 100), F.lit('"')), F.concat(F.lit('"version" : "1.'), number(F.size("made")), F.lit('.0"')),
        F.concat(F.lit('"module_hashes": ['), c("hashes"), F.lit("]")), F.lit('"capabilities":["ssh", "dns"]'), F.concat(F.lit('"signer": '), signer), F.lit('"extra":{"z":[1,{"b":2,"a":1}],"a":true}'),
    ]
    joined = lambda order: F.concat(F.lit("{"), F.array_join(F.array(*[parts[i] for i in order]), ",\n "), F.lit("}"))
    text = F.when(c("l_orderkey") % 3 == 0, joined([0, 1, 2, 3, 4, 5])).when(c("l_orderkey") % 3 == 1, joined([5, 4, 3, 2, 1, 0])).otherwise(joined([3, 0, 5, 2, 4, 1]))
    text = F.when(c("l_orderkey") % 41 == 7, F.left(text, F.lit(30))).when(c("l_orderkey") % 41 == 8, "[1, 2]").otherwise(text)
    return items.select("l_orderkey", text.alias("text"))


def manifest_documents(spark, sf_dir):
    """Digests of manifests in one spelling, what is read of them, and whether the written struct reads back equal."""
    c = F.col
    found = documents.manifests(_manifest_texts(spark, sf_dir), "text", "m")
    found = found.select("l_orderkey", F.sha2(F.to_json("m_doc"), 256).alias("digest"), "m").withColumn("document", documents.written(c("m")))
    found = documents.manifests(found, "document", "again")
    sorted_m = c("m").withField("capabilities", F.array_sort("m.capabilities"))
    return found.select(
        "l_orderkey", "digest", c("m.package").alias("package"), c("m.version").alias("version"), c("m.signer").alias("signer"),
        F.size("m.module_hashes").cast("long").alias("n_hashes"), "document", (c("again") == sorted_m).alias("reads_back"),
    )


CACHE_SQL = """
WITH x AS (SELECT 'p' || (l_suppkey % 25) AS package, '0.' || (l_linenumber + 5) || '.0' AS version, 'M' || (l_partkey % 40) AS module, l_returnflag AS flag, l_partkey % {n} AS i FROM lineitem),
kept AS (SELECT * FROM x WHERE NOT (package = 'p3' AND version = '0.9.0') AND (version <> '0.8.0' OR flag = 'A')),
m AS (SELECT package, version, module, count(DISTINCT i) AS imports FROM kept GROUP BY ALL),
counts AS (SELECT package, version, count(*) AS n_modules, CAST(sum(imports) AS BIGINT) AS n_imports, count(*) AS n_digests FROM m GROUP BY ALL),
prior AS (SELECT package, max(version) AS prior FROM counts WHERE version <> '0.9.0' GROUP BY package)
SELECT counts.*, prior FROM counts LEFT JOIN prior USING (package)"""

MANIFEST_SQL = """
WITH x AS (SELECT l_orderkey AS k, list({'h': printf('%X', l_partkey), 'n': l_linenumber} ORDER BY l_linenumber, l_partkey) AS made, l_orderkey % 41 NOT IN (7, 8) AS sound FROM lineitem GROUP BY 1),
t AS (SELECT *, '"capabilities":' AS c, array_to_string([printf('{"content_hash":"%s","module":"M%d"}', e.h, e.n) FOR e IN made], ',') AS hashes,
      CASE WHEN k % 4 = 0 THEN 'null' ELSE '"s' || (k % 7) || '"' END AS signer FROM x)
SELECT k AS l_orderkey,
  CASE WHEN sound THEN sha256('{"capabilities":["ssh","dns"],"extra":{"a":true,"z":[1,{"a":1,"b":2}]},"module_hashes":[' || hashes || '],"package":"p' || (k % 100) || '","signer":' || signer || ',"version":"1.' || len(made) || '.0"}')
       WHEN k % 41 = 8 THEN sha256('[1,2]') END AS digest,
  CASE WHEN sound THEN 'p' || (k % 100) END AS package, CASE WHEN sound THEN '1.' || len(made) || '.0' END AS version, CASE WHEN sound AND k % 4 <> 0 THEN 's' || (k % 7) END AS signer,
  CASE WHEN sound THEN len(made) END AS n_hashes,
  CASE WHEN sound THEN '{"capabilities":["dns","ssh"],"module_hashes":[' || hashes || '],"notes":null,"package":"p' || (k % 100) || '","signed_at":null,"signer":' || signer || ',"version":"1.' || len(made) || '.0"}' END AS document,
  CASE WHEN sound THEN true END AS reads_back
FROM t"""

QUERIES |= {"profile_cache": profile_cache, "manifest_documents": manifest_documents}
ORACLES |= {"profile_cache": CACHE_SQL.format(n=len(IMPORTS)), "manifest_documents": MANIFEST_SQL}
