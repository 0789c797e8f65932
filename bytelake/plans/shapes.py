"""Relational shapes of the bytecode engine, run over the driver's synthetic tables.

They transfer the shapes (dereference chains, interval lookups, islands, closures...) to
tables for which an independent SQL engine can check the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelake.operators.graph import closure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def shape(sql: str):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@shape(
    """
    SELECT coalesce(n_name, 'nation#' || c_nationkey) AS nation, coalesce(r_name, 'region#?') AS region,
           count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
         LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    GROUP BY ALL
    """
)
def d_deref_chain(spark, sf_dir):
    """Multi-hop left joins with a placeholder for what does not resolve."""
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy(
            F.coalesce("n_name", F.concat(F.lit("nation#"), F.col("c_nationkey").cast("string"))).alias("nation"),
            F.coalesce("r_name", F.lit("region#?")).alias("region"),
        )
        .agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    )


@shape(
    """
    WITH k AS (SELECT *, event_type || ':' || (user_id % 10) AS message FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY event_id) AS rn FROM k)
    SELECT min(event_id) AS first_id, message, count(*) - 1 AS suppressed FROM r GROUP BY message
    """
)
def d_diag_dedup(spark, sf_dir):
    """The first of equal messages, and how many others it stands for."""
    message = F.concat("event_type", F.lit(":"), (F.col("user_id") % 10).cast("string"))
    return table(spark, sf_dir, "events").groupBy(message.alias("message")).agg(F.min("event_id").alias("first_id"), (F.count("*") - 1).alias("suppressed"))


@shape("SELECT p_brand, p_size, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS types, count(*) AS n FROM part GROUP BY p_brand, p_size")
def d_multi_catch(spark, sf_dir):
    """Rows of one range and target, with their types as one sorted alternative."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " | ").alias("types"), F.count("*").alias("n"))


@shape("SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS labels FROM orders GROUP BY o_orderpriority")
def d_switch_arms(spark, sf_dir):
    """Labels that lead to one target, sorted."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("labels"))


@shape("SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def d_unique_return(spark, sf_dir):
    """Keys with exactly one distinct value. Equal least and greatest value say so without a distinct count."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.max("l_returnflag").alias("last"))
    return grouped.where("flag = last").select("l_orderkey", "flag")


@shape(
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM r GROUP BY user_id, event_type, island
    """
)
def d_islands(spark, sf_dir):
    """Runs of rows with an equal state: a run starts where the state changes, and the running count of starts names it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = F.coalesce((F.lag("event_type").over(w) != F.col("event_type")).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "events").withColumn("starts", starts).withColumn("run", F.sum("starts").over(w))
    return rows.groupBy("user_id", "run", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("run")


@shape(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS at_offset FROM lineitem
    """
)
def d_prefix_sum(spark, sf_dir):
    """Positions from a running sum of lengths."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(w).alias("at_offset"))


@shape("SELECT event_id, user_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS next_id FROM events")
def d_next_offset(spark, sf_dir):
    """The row that follows."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lead("event_id", 1, -1).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id"))


@shape(
    """
    SELECT event_id, user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM events
    """
)
def d_block_assign(spark, sf_dir):
    """The block of each row: the last boundary at or before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w).alias("block"))


@shape(
    """
    WITH m AS (SELECT user_id, event_id AS scope, ts AS start, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '9999-01-01') AS stop
               FROM events WHERE event_type = 'signup')
    SELECT e.event_id, e.user_id, min(m.scope) AS scope FROM events e LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.start AND e.ts < m.stop GROUP BY e.event_id, e.user_id
    """
)
def d_scope_lookup(spark, sf_dir):
    """The scope that holds an offset: scopes of one owner do not overlap, so the interval join is an as-of lookup in one sorted pass."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("marker").desc(), "event_id")
    rows = table(spark, sf_dir, "events").withColumn("marker", (F.col("event_type") == "signup").cast("int"))
    return rows.select("event_id", "user_id", F.last(F.when(F.col("marker") == 1, F.col("event_id")), ignorenulls=True).over(w).alias("scope"))


@shape(
    """
    SELECT a.o_orderkey, min(b.o_orderdate) AS next_date FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate GROUP BY a.o_orderkey
    """
)
def d_forward_asof(spark, sf_dir):
    """The nearest later row of a key; equal positions are skipped by a range frame."""
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    w = Window.partitionBy("o_custkey").orderBy(micros).rangeBetween(1, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.min("o_orderdate").over(w).alias("next_date"))


@shape(
    """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS declared FROM events
    """
)
def d_backward_asof(spark, sf_dir):
    """The nearest earlier declaration, at most 30 rows back."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-30, -1)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("declared"))


@shape(
    """
    WITH r AS (SELECT o_custkey, min(o_orderkey) AS start, max(o_orderkey) AS stop FROM orders GROUP BY o_custkey),
    g AS (SELECT c_nationkey AS owner, o_custkey, start, stop FROM r JOIN customer ON c_custkey = o_custkey)
    SELECT a.o_custkey AS outer_key, count(*) AS n_inside FROM g a JOIN g b ON a.owner = b.owner AND a.start < b.start AND b.stop < a.stop GROUP BY a.o_custkey
    """
)
def d_nested_ranges(spark, sf_dir):
    """Ranges strictly inside others of one owner: an equi-join on the owner with the containment as its residual."""
    ranges = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("start"), F.max("o_orderkey").alias("stop"))
    ranges = ranges.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("owner"), "o_custkey", "start", "stop")
    inner = ranges.select("owner", F.col("start").alias("s"), F.col("stop").alias("e"))
    held = ranges.join(inner, "owner").where("start < s AND e < stop")
    return held.groupBy(F.col("o_custkey").alias("outer_key")).agg(F.count("*").alias("n_inside"))


@shape(
    """
    SELECT conv_id, turn, (sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text))::BIGINT AS depth FROM conversations
    """
)
def d_bracket_depth(spark, sf_dir):
    """Nesting depth from opening and closing rows."""
    step = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(step).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("depth"))


@shape(
    """
    WITH r AS (SELECT conv_id, turn, role, coalesce(max((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM conversations)
    SELECT conv_id, turn, role FROM r WHERE done = 0
    """
)
def d_truncate_first(spark, sf_dir):
    """Rows up to the first one that ends control flow."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("role") == "assistant").cast("int")).over(w), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", done.alias("done")).where("done = 0").drop("done")


@shape(
    """
    WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey + l_linenumber) // 3 AS b FROM lineitem),
    r AS (SELECT a AS root, b AS node FROM e UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a)
    SELECT root, node FROM r
    """
)
def d_closure(spark, sf_dir):
    """What each root reaches along edges with cycles: only new pairs are carried on. Edges lead to about a third of a number, so what one root reaches grows with the digits of the largest."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.expr("(l_suppkey + l_linenumber) div 3").alias("b")).distinct()
    return closure(edges, edges.select(F.col("a").alias("root"), F.col("b").alias("node")), ["root"])


@shape(
    """
    WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey + l_linenumber) // 3 AS b FROM lineitem),
    r AS (SELECT a AS root, b AS node FROM e UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a),
    f AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS member FROM lineitem WHERE l_returnflag = 'R')
    SELECT DISTINCT m.s AS root, m.member FROM f m WHERE EXISTS (SELECT 1 FROM r JOIN f o ON o.s = r.node WHERE r.root = m.s AND r.node <> m.s AND o.member = m.member)
    """
)
def d_override_semi(spark, sf_dir):
    """Members that something reachable holds too."""
    members = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("member")).distinct()
    above = d_closure(spark, sf_dir).where("root <> node").join(members.withColumnRenamed("s", "node"), "node").select("root", "member")
    return members.withColumnRenamed("s", "root").join(above, ["root", "member"], "left_semi")


@shape("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def d_anti_visited(spark, sf_dir):
    """What was never visited."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


@shape(
    """
    WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_name, lpad(p_partkey::VARCHAR, 20, '0')) AS rn FROM part)
    SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '_' || (rn - 2) END || '.java' AS path FROM r
    """
)
def d_case_collide(spark, sf_dir):
    """Names that are equal but for case: the first keeps its own, the others get a number."""
    from bytelake.operators.sources import unique_paths

    rows = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 20, "0").alias("class_id"), F.concat("p_name", F.lit(".java")).alias("path"), F.lit("").alias("text"))
    return unique_paths(rows, ()).select("p_partkey", "path")


@shape(
    """
    SELECT l_linenumber, concat_ws(' ', CASE WHEN l_linenumber & 1 <> 0 THEN 'public' END, CASE WHEN l_linenumber & 2 <> 0 THEN 'private' END, CASE WHEN l_linenumber & 4 <> 0 THEN 'protected' END) AS flags, count(*) AS n
    FROM lineitem GROUP BY l_linenumber
    """
)
def d_flag_decode(spark, sf_dir):
    """Access flags from bits."""
    from bytelake.functions.names import flags

    counts = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return counts.select("l_linenumber", flags(F.col("l_linenumber"), {1: "public", 2: "private", 4: "protected"}).alias("flags"), "n")


@shape(
    """
    SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer) WHERE name NOT LIKE 'A%'
    """
)
def d_imports(spark, sf_dir):
    """Distinct names from several places, without those that need no import."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    names = names.unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")))
    return names.where(~F.col("name").startswith("A")).distinct()


@shape("SELECT page_id, array_reverse(string_split(url, '.'))[1] AS short_name FROM pages")
def d_short_name(spark, sf_dir):
    """What follows the last dot."""
    from bytelake.functions.names import short_name

    return table(spark, sf_dir, "pages").select("page_id", short_name(F.col("url")).alias("short_name"))


@shape(
    """
    WITH t AS (SELECT p_partkey, lower(left(p_type, (p_partkey % 4)::INT)) AS token FROM part)
    SELECT p_partkey, CASE WHEN octet_length(encode(token)) = 1 THEN 'var_' || token WHEN regexp_full_match(token, '[a-z]{0,2}') THEN 'local_' || token
                           WHEN regexp_replace(token, '[^A-Za-z]', '', 'g') = '' THEN 'field_' || token ELSE token END AS name FROM t
    """
)
def d_deobf(spark, sf_dir):
    """Readable names for names that say nothing."""
    from bytelake.functions.names import readable_name

    token = F.expr("lower(left(p_type, cast(p_partkey % 4 AS int)))")
    return table(spark, sf_dir, "part").select("p_partkey", readable_name(token).alias("name"))


_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}$"


@shape(
    # a separator is used up by the word before it, so the second pass finds what stands behind a word that was found
    rf"""
    WITH o AS (SELECT doc_id, text, regexp_replace(text, '(^|[^{_WORD}])the($|[^{_WORD}])', '\1THE_0\2', 'g') AS x FROM documents),
    t AS (SELECT doc_id, text, regexp_replace(x, '(^|[^{_WORD}])the($|[^{_WORD}])', '\1THE_0\2', 'g') AS renamed FROM o)
    SELECT doc_id, md5(renamed) AS renamed, (length(renamed) - length(text)) // 2 AS n FROM t
    """
)
def d_rename_token(spark, sf_dir):
    """Whole-word renaming in all texts."""
    from bytelake.functions.names import rename_word

    renamed = rename_word(F.col("text"), "the", "THE_0")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(renamed.cast("binary")).alias("renamed"), ((F.length(renamed) - F.length("text")) / 2).cast("long").alias("n"))


@shape("SELECT l_orderkey, CASE WHEN count(DISTINCT nullif(l_linestatus, 'O')) = 1 THEN min(nullif(l_linestatus, 'O')) ELSE 'Unknown' END AS merged FROM lineitem GROUP BY l_orderkey")
def d_lattice(spark, sf_dir):
    """The merge of a flat lattice: unknown values do not count, and values that differ give unknown."""
    from bytelake.functions.names import lattice_merge

    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lattice_merge(F.col("l_linestatus"), "O").alias("merged"))


@shape("SELECT o_orderkey FROM orders WHERE NOT (NOT (o_totalprice > 200000)) AND (o_orderstatus = 'F' OR (1 = 1 AND o_orderstatus = 'P'))")
def d_const_prune(spark, sf_dir):
    """A condition after constants and double negations are folded away."""
    return table(spark, sf_dir, "orders").where("o_totalprice > 200000 AND o_orderstatus IN ('F', 'P')").select("o_orderkey")


@shape("SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey ORDER BY size DESC, o_custkey LIMIT 20")
def d_top_loops(spark, sf_dir):
    """The largest groups, with a tie break."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "o_custkey").limit(20)
