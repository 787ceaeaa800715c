"""Projection queries: each applies scalar expressions to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import scalars as S
from jobloom.functions.timing import SQL as PRELUDE
from jobloom.functions.timing import gpu_multiplier, probe_summary
from jobloom.operators import work as W
from jobloom.registry import query, table

LADDER = [128, 256, 512, 768, 1024, 1280, 1536, 2048, 2560, 3072, 3584, 4096, 4608, 5120]
_LADDER_SQL = "[" + ", ".join(map(str, LADDER)) + "]"


def ladder():
    return F.array(*(F.lit(x).cast("bigint") for x in LADDER))


@query("SELECT p_partkey, regexp_replace(replace(p_name, ' ', '_'), '[^A-Za-z0-9_.-]', '', 'g') AS clean FROM part")
def sanitise_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.sanitise(F.col("p_name")).alias("clean"))


@query("SELECT page_id, sha256(coalesce(html, '')) AS sha256, substr(sha256(coalesce(url, '')), 1, 16) AS url_hash FROM pages")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    h, u = (F.coalesce(F.col(c), F.lit("")) for c in ("html", "url"))
    return table(spark, d, "pages").select("page_id", S.content_hash(h).alias("sha256"), S.short_hash(u).alias("url_hash"))


@query(f"""SELECT doc_id, coalesce(list_min(list_filter({_LADDER_SQL}, lambda b: b >= n_chars)), n_chars)::BIGINT AS bucket FROM documents""")
def bucket_ladder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.bucket_for(F.col("n_chars"), ladder()).alias("bucket"))


@query(f"""SELECT doc_id, b > n_chars AND b - n_chars <= greatest(floor(b * 5e-2)::BIGINT, 1) AS near
FROM (SELECT doc_id, n_chars, coalesce(list_min(list_filter({_LADDER_SQL}, lambda b: b >= n_chars)), n_chars)::BIGINT AS b FROM documents)""")
def near_boundary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.near_boundary(F.col("n_chars"), ladder(), 0.05).alias("near"))


@query("SELECT o_orderkey, (o_totalprice::BIGINT + 63) // 64 * 64 AS padded, o_totalprice::BIGINT % 64 <> 0 AS unaligned FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def ceil_multiples(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", S.ceil_multiple(n, 64).alias("padded"), (n % 64 != 0).alias("unaligned"))


@query(f"WITH {PRELUDE} SELECT job_id, shape FROM covered")
def cover_shapes(spark: SparkSession, d: str) -> DataFrame:
    return W.covered(W.jobs(spark, d), W.default(spark)).select("job_id", "shape")


@query(f"WITH {PRELUDE} SELECT c.job_id, f.inf AS inference_factor, f.comp AS compile_factor FROM covered c JOIN factors f USING (shape)")
def modifier_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = W.default(spark)
    c = W.covered(W.jobs(spark, d), t)
    return c.select("job_id", t.inference_factor(F.col("shape")).alias("inference_factor"), t.compile_factor(F.col("shape")).alias("compile_factor"))


@query(f"WITH {PRELUDE} SELECT kind, shape, compile_cost, infer_cost FROM costs")
def integer_costs(spark: SparkSession, d: str) -> DataFrame:
    t = W.default(spark)
    return W.costs(W.executors(spark, d), W.covered(W.jobs(spark, d), t), t)


@query("""SELECT l_orderkey, s AS s_ms, t[1] + t[2] - 2e0 * s AS r_ms, s > 0 AND abs(t[3] - t[4]) / s > 25e-2 AS contaminated,
  CASE WHEN s > 0 THEN s / 1e3 / 59.423::DOUBLE ELSE 1e0 END AS multiplier
FROM (SELECT l_orderkey, t, (t[3] + t[4]) / 2e0 AS s FROM (
  SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS t FROM lineitem GROUP BY l_orderkey) WHERE len(t) = 4)""")
def probe_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Probe arithmetic over the orders that have exactly four lines."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("p"))
    t = rows.filter(F.size("p") == 4).select("l_orderkey", probe_summary(F.col("p.l_extendedprice")).alias("s"))
    return t.select("l_orderkey", "s.s_ms", "s.r_ms", "s.contaminated", gpu_multiplier(F.col("s.s_ms")).alias("multiplier"))


_ID_SQL = """CASE WHEN n <= 0 THEN NULL WHEN n <= 26 THEN chr((64 + n)::INT)
  WHEN n <= 702 THEN chr((65 + (n - 27) // 26)::INT) || chr((65 + (n - 1) % 26)::INT)
  WHEN n <= 18278 THEN chr((65 + (n - 703) // 676)::INT) || chr((65 + ((n - 703) // 26) % 26)::INT) || chr((65 + (n - 1) % 26)::INT)
  ELSE chr((65 + (n - 18279) // 17576)::INT) || chr((65 + ((n - 18279) // 676) % 26)::INT) || chr((65 + ((n - 18279) // 26) % 26)::INT) || chr((65 + (n - 1) % 26)::INT) END"""


@query(f"SELECT c_custkey, {_ID_SQL} AS letters FROM (SELECT c_custkey, c_custkey AS n FROM customer)")
def base26_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.base26(F.col("c_custkey")).alias("letters"))


@query("""SELECT n_nationkey, list_sort(list_filter(['A','B','C','D','E','F','G','H','I','J','K','L'], lambda x: NOT list_contains(used, x)))[1:3] AS ids
FROM (SELECT n_nationkey, [chr((65 + n_nationkey % 5)::INT), chr((65 + n_regionkey)::INT)] AS used FROM nation)""")
def free_chain_ids(spark: SparkSession, d: str) -> DataFrame:
    used = F.array_distinct(F.array(F.char(F.lit(65) + F.col("n_nationkey") % 5), F.char(F.lit(65) + F.col("n_regionkey"))))
    return table(spark, d, "nation").select("n_nationkey", S.free_ids(used, F.lit(3)).alias("ids"))


@query("""SELECT vec_id, list_transform(range(1, len(pos) + 1), lambda i: pos[i] - (CASE WHEN i > 1 THEN pos[i - 1] ELSE 0 END) - 1) AS gaps, len(pos)::BIGINT AS kept
FROM (SELECT vec_id, list_filter(range(1, 65), lambda i: embedding[i] > 0) AS pos FROM embeddings)""")
def gap_positions(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between kept positions of each vector: an index-lambda difference within the array."""
    kept = F.transform("embedding", lambda x: x > 0)
    g = S.gaps(kept).cast("array<bigint>")
    return table(spark, d, "embeddings").select("vec_id", g.alias("gaps"), F.size(g).cast("bigint").alias("kept"))


@query("SELECT vec_id, embedding[1:8] AS head, len(embedding)::BIGINT AS padded FROM embeddings")
def array_slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("head"), S.padded_len(F.col("embedding")).cast("bigint").alias("padded"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(v.isNotNull(), F.lit(False)).alias("valid"))


@query("""SELECT doc_id, extra, exact FROM (SELECT doc_id,
  CASE doc_id % 4 WHEN 0 THEN 13 + 15 WHEN 1 THEN 0 WHEN 2 THEN 19 ELSE 13 END::BIGINT AS extra, doc_id % 4 <> 2 AS exact FROM documents)""")
def modification_tokens(spark: SparkSession, d: str) -> DataFrame:
    codes = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("TPO"), F.lit("PTR"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("ALA"), F.lit(""))).when(F.col("doc_id") % 4 == 2, F.array(F.lit("XYZ"))).otherwise(F.array(F.lit("TPO")))
    m = S.modification_extra(codes)
    return table(spark, d, "documents").select("doc_id", m["extra"].cast("bigint").alias("extra"), m["exact"].alias("exact"))


@query("SELECT doc_id, [doc_id, doc_id + 1, doc_id + 2][1:(1 + doc_id % 3)::BIGINT] AS seeds FROM documents")
def seed_expansion(spark: SparkSession, d: str) -> DataFrame:
    base = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.sequence(base, base + base % 3).alias("seeds"))


@query("""SELECT slot, memory_bytes, CASE WHEN memory_bytes <= 1342177280 THEN 0.95 ELSE round((memory_bytes - 671088640) / memory_bytes, 4) END::DOUBLE AS fraction
FROM (SELECT s_suppkey AS slot, (s_suppkey % 60)::BIGINT * 268435456 AS memory_bytes FROM supplier)""")
def memory_fractions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot"), ((F.col("s_suppkey") % 60).cast("bigint") * (1 << 28)).alias("memory_bytes"))
    return rows.withColumn("fraction", S.memory_fraction(F.col("memory_bytes")))


@query("""SELECT o_custkey, '[' || repeat('#', f) || repeat('-', 20 - f) || ']' AS bar, done, total FROM (
  SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total, floor(count(*) FILTER (o_orderstatus = 'F') * 20 / count(*))::INT AS f FROM orders GROUP BY o_custkey)""")
def progress_bars(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"))
    return rows.withColumn("bar", S.bar(F.col("done"), F.col("total")))


@query("""SELECT event_id, CASE WHEN lower(event_type) IN ('true','t','yes','y','on','1') THEN true WHEN lower(event_type) IN ('false','f','no','n','off','0') THEN false END AS flag,
  CASE WHEN c < 0 THEN 128 - c ELSE c END AS code FROM (SELECT event_id, event_type, user_id % 7 - 3 AS c FROM events)""")
def booleans_and_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.parse_bool(F.col("event_type")).alias("flag"), S.exit_code(F.col("user_id") % 7 - 3).alias("code"))


@query("""SELECT p_partkey, CASE p_size % 4
  WHEN 0 THEN json_object('protein', json_object('id', 'A', 'sequence', p_name)) WHEN 1 THEN json_object('rna', json_object('id', 'A', 'sequence', p_name))
  WHEN 2 THEN json_object('dna', json_object('id', 'A', 'sequence', p_name)) ELSE json_object('ligand', json_object('id', 'A', 'smiles', p_name)) END::VARCHAR AS entity FROM part""")
def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """One single-key entity object a record, by kind."""
    polymer = F.struct(F.lit("A").alias("id"), F.col("p_name").alias("sequence"))
    ligand = F.struct(F.lit("A").alias("id"), F.col("p_name").alias("smiles"))
    kind = F.col("p_size") % 4
    out = F.when(kind == 0, F.to_json(F.struct(polymer.alias("protein")))).when(kind == 1, F.to_json(F.struct(polymer.alias("rna")))).when(kind == 2, F.to_json(F.struct(polymer.alias("dna")))).otherwise(F.to_json(F.struct(ligand.alias("ligand"))))
    return table(spark, d, "part").select("p_partkey", out.alias("entity"))


@query("""SELECT page_id, CASE WHEN url IS NULL THEN 'missing url' WHEN html IS NULL OR html = '' THEN 'empty page'
  WHEN lower(regexp_replace(url, '.*/', '')) IN ('.', '..', '_jobloom') THEN 'reserved name' WHEN length(html) < 400 THEN 'too short' END AS reason FROM pages""")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first failing rule is the message; accepted rows have none."""
    url, html = F.col("url"), F.col("html")
    rule = F.when(url.isNull(), "missing url").when(html.isNull() | (html == ""), "empty page").when(F.lower(F.regexp_replace(url, ".*/", "")).isin(*S.RESERVED_IDS), "reserved name").when(F.length(html) < 400, "too short")
    return table(spark, d, "pages").select("page_id", rule.alias("reason"))


@query("SELECT doc_id, right(text, 200) AS tail, left(text, 30) AS head FROM documents")
def truncations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.right("text", F.lit(200)).alias("tail"), F.left("text", F.lit(30)).alias("head"))
