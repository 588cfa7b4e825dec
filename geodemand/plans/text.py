"""Texts, keys, sessions, table checks and fact packs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from geodemand import config as C
from geodemand.functions.scalars import letters_and_digits
from geodemand.operators import entity as E
from geodemand.operators import quality as Q
from geodemand.operators import sessions as S
from geodemand.operators.levels import children
from geodemand.plans import levels as LV
from geodemand.plans import place_role as PR
from geodemand.plans import scoring as SC
from geodemand.plans.insight import base_insights
from geodemand.plans.registry import cte, query
from geodemand.session import spread_scan
from geodemand.sources import roles
from geodemand.sources.sinks import weakest_of_rows
from geodemand.sources.tables import first_source_wins, hierarchical_ids, latest_per_source

# ---------------------------------------------------------------- mentions and numbers

cte(
    "asked",
    """SELECT 'p' || p_partkey AS text_id, CASE p_partkey % 4 WHEN 0 THEN 'Any ' || p_name || ' of ' || p_brand || '?'
         WHEN 1 THEN 'Top regions for ' || split_part(p_name, ' ', 2) || 's!' WHEN 2 THEN upper(split_part(p_name, ' ', 2)) || ', ' || split_part(p_name, ' ', 1) || ' one'
         ELSE 'how are sales of ' || lower(p_type) END AS txt FROM part
       UNION ALL SELECT 'd' || doc_id, text FROM documents""",
)


def asked(spark, sf):
    p = roles.table(spark, sf, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    k = F.col("p_partkey") % 4
    t = (
        F.when(k == 0, F.concat(F.lit("Any "), "p_name", F.lit(" of "), "p_brand", F.lit("?")))
        .when(k == 1, F.concat(F.lit("Top regions for "), b, F.lit("s!")))
        .when(k == 2, F.concat(F.upper(b), F.lit(", "), a, F.lit(" one")))
        .otherwise(F.concat(F.lit("how are sales of "), F.lower("p_type")))
    )
    q = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("text_id"), t.alias("txt"))
    d = roles.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), F.col("text").alias("txt"))
    return spread_scan(q.unionByName(d), "text_id")


@query(
    "product_mentions",
    """, q AS (SELECT text_id, trim(regexp_replace(regexp_replace(lower(txt), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) AS q FROM asked),
       c AS (SELECT p_name AS name, CAST(count(*) AS DOUBLE) AS ceiling,
             list_filter(string_split(p_name, ' '), lambda w: length(w) > 3) AS words FROM part GROUP BY 1),
       s AS (SELECT text_id, name, ceiling, CASE WHEN contains(q, name) THEN length(name) * 2e0 ELSE
          CASE WHEN len(words) > 0 AND h / len(words) >= 0.5 THEN h / len(words) * length(name) ELSE 0 END END AS score
          FROM (SELECT text_id, q, name, ceiling, words, len(list_filter(words, lambda w: list_contains(ql, w) OR list_contains(ql, w || 's') OR list_contains(ql, rtrim(w, 's')))) AS h
                FROM (SELECT *, string_split(q, ' ') AS ql FROM q), c)),
       t AS (SELECT *, max(score) OVER (PARTITION BY text_id) AS top FROM s WHERE score > 0)
       SELECT text_id, name AS item, round(score, 6) AS score FROM t WHERE top >= 5 AND score >= top * 0.75
       QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY ceiling DESC, score DESC, name) = 1""",
    needs=("asked",),
)
def product_mentions(spark, sf):
    cat = roles.table(spark, sf, "part").groupBy(F.col("p_name").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("ceiling"))
    cat = cat.withColumn("name", F.col("item"))
    m = E.product_mentions(asked(spark, sf), "text_id", "txt", cat)
    return m.select("text_id", "item", F.round("score", 6).alias("score"))


@query(
    "product_mentions_branded",
    """, q AS (SELECT text_id, trim(regexp_replace(regexp_replace(lower(txt), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS q FROM asked),
       c AS (SELECT name, CAST(count(*) AS DOUBLE) AS ceiling, list_filter(string_split(name, ' '), lambda w: length(w) > 3 AND w <> 'brand') AS words
             FROM (SELECT p_name || ' of brand ' || regexp_extract(p_brand, '[0-9]+') AS name FROM part) GROUP BY 1),
       s AS (SELECT text_id, name, ceiling, CASE WHEN contains(q, name) THEN length(name) * 2e0 ELSE
          CASE WHEN len(words) > 0 AND h / len(words) >= 0.5 THEN h / len(words) * length(name) ELSE 0 END END AS score
          FROM (SELECT text_id, q, name, ceiling, words, len(list_filter(words, lambda w: list_contains(ql, w) OR list_contains(ql, w || 's') OR list_contains(ql, rtrim(w, 's')))) AS h
                FROM (SELECT *, string_split(q, ' ') AS ql FROM q), c)),
       t AS (SELECT *, max(score) OVER (PARTITION BY text_id) AS top FROM s WHERE score > 0)
       SELECT text_id, name AS item, round(score, 6) AS score FROM t WHERE top >= 5 AND score >= top * 0.75
       QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY ceiling DESC, score DESC, name) = 1""",
    needs=("asked",),
)
def product_mentions_branded(spark, sf):
    """The same over every product of every brand, told apart by the number of the brand."""
    name = F.concat("p_name", F.lit(" of brand "), F.regexp_extract("p_brand", "[0-9]+", 0))
    cat = roles.table(spark, sf, "part").groupBy(name.alias("item")).agg(F.count(F.lit(1)).cast("double").alias("ceiling"))
    m = E.product_mentions(asked(spark, sf), "text_id", "txt", cat.withColumn("name", F.col("item")), generic=("brand",), letters="a-z0-9")
    return m.select("text_id", "item", F.round("score", 6).alias("score"))


@query(
    "grounded_numbers",
    """, n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9,]{3,}')) AS token FROM documents),
       v AS (SELECT *, CAST(replace(token, ',', '') AS DOUBLE) AS number FROM n),
       f AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS fact FROM documents UNION ALL SELECT doc_id, CAST(doc_id AS DOUBLE) FROM documents UNION ALL SELECT doc_id, 2024e0 FROM documents)
       SELECT doc_id, token FROM v WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = v.doc_id AND abs(number - fact) <= greatest(2, abs(fact) * 0.02))""".replace(", n AS", "WITH n AS", 1),
)
def grounded_numbers(spark, sf):
    d = roles.table(spark, sf, "documents")
    facts = d.select("doc_id", F.explode(F.array(F.col("n_chars").cast("double"), F.col("doc_id").cast("double"), F.lit(2024.0))).alias("fact"))
    return E.ungrounded_numbers(d, "doc_id", "text", facts).select("doc_id", "token")


@query(
    "banned_terms",
    """SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(list_filter(['qui', 'ther', 'beta', 'el '], lambda t: contains(lower(text), t)), ', ') AS terms
       FROM documents WHERE len(list_filter(['qui', 'ther', 'beta', 'el '], lambda t: contains(lower(text), t))) > 0""",
)
def banned_terms(spark, sf):
    b = E.banned_terms(roles.table(spark, sf, "documents"), "doc_id", "text", ["qui", "ther", "beta", "el "])
    return b.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws(", ", "terms").alias("terms"))


@query(
    "alias_join",
    """, r AS (SELECT n_nationkey AS id, lower(regexp_replace(r_name, '[^A-Za-z0-9]', '', 'g')) AS st, 'nation' || n_nationkey AS nm FROM nation JOIN region ON n_regionkey = r_regionkey),
       g AS (SELECT st, nm AS gk FROM r WHERE id % 2 = 0 UNION SELECT st, 'nation' FROM r WHERE id < 2),
       t AS (SELECT id, st, nm AS cand, 9 AS prio FROM r UNION ALL SELECT id, st, 'nation' || (id - 5), 0 FROM r WHERE id % 3 = 0 UNION ALL SELECT id, st, 'nation' || (id + 10), 1 FROM r WHERE id % 3 = 0),
       f AS (SELECT id, t.st, gk FROM t JOIN g ON g.st = t.st AND gk = cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio) = 1),
       c AS (SELECT id, r.st, min(gk) AS gk FROM r JOIN g ON g.st = r.st AND (contains(gk, nm) OR contains(nm, gk)) WHERE id NOT IN (SELECT id FROM f) GROUP BY 1, 2),
       u AS (SELECT id, st, gk, 'direct' AS how FROM f UNION ALL SELECT id, st, gk, 'contained' FROM c)
       SELECT r.id, r.st AS state_key, gk AS geo_key, how, coalesce(gk IS NOT NULL AND count(*) OVER (PARTITION BY r.st, gk) > 1, false) AS shared FROM r LEFT JOIN u ON u.id = r.id""".replace(", r AS", "WITH r AS", 1),
)
def alias_join(spark, sf):
    n = roles.districts(spark, sf).join(roles.states(spark, sf), "state_id")
    key = F.concat(F.lit("nation"), F.col("district_id").cast("string"))
    st = letters_and_digits("state")
    geo = n.where(F.col("district_id") % 2 == 0).select(st.alias("state_key"), key.alias("name_key")).union(
        n.where(F.col("district_id") < 2).select(st, F.lit("nation"))
    ).distinct()
    near = lambda d: F.concat(F.lit("nation"), (F.col("district_id") + d).cast("string"))
    aliases = n.where(F.col("district_id") % 3 == 0).select(key.alias("name_key"), F.array(near(-5), near(10)).alias("candidates"))
    return E.alias_join(n, "district_id", "state", "district", geo, aliases).withColumnRenamed("district_id", "id")


@query(
    "alias_join_facilities",
    """, r AS (SELECT facility_id AS id, lower(regexp_replace(r_name, '[^A-Za-z0-9]', '', 'g')) AS st, 'depot' || facility_id || 'x' AS nm FROM facility JOIN region ON state_id = r_regionkey),
       g AS (SELECT DISTINCT st, 'depot' || id || CASE WHEN id % 2 = 0 THEN 'x' WHEN id % 5 = 0 THEN 'xnorth' ELSE 'z' END AS gk FROM r),
       t AS (SELECT id, st, nm AS cand, 9 AS prio FROM r UNION ALL SELECT id, st, 'depot' || (id - 5) || 'x', 0 FROM r WHERE id % 3 = 0 UNION ALL SELECT id, st, 'depot' || (id + 10) || 'x', 1 FROM r WHERE id % 3 = 0),
       f AS (SELECT id, t.st, gk FROM t JOIN g ON g.st = t.st AND gk = cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio) = 1),
       c AS (SELECT id, r.st, min(gk) AS gk FROM r JOIN g ON g.st = r.st AND (contains(gk, nm) OR contains(nm, gk)) WHERE id NOT IN (SELECT id FROM f) GROUP BY 1, 2),
       u AS (SELECT id, st, gk, 'direct' AS how FROM f UNION ALL SELECT id, st, gk, 'contained' FROM c)
       SELECT r.id, r.st AS state_key, gk AS geo_key, how, coalesce(gk IS NOT NULL AND count(*) OVER (PARTITION BY r.st, gk) > 1, false) AS shared FROM r LEFT JOIN u ON u.id = r.id""",
    needs=("facility",),
)
def alias_join_facilities(spark, sf):
    """Names of all facilities, which share a stem, against the keys of a map."""
    f = roles.facilities(spark, sf).join(roles.states(spark, sf), "state_id")
    name = lambda d, end: F.concat(F.lit("depot"), (F.col("facility_id") + d).cast("string"), end)
    end = F.when(F.col("facility_id") % 2 == 0, "x").when(F.col("facility_id") % 5 == 0, "xnorth").otherwise("z")
    geo = f.select(letters_and_digits("state").alias("state_key"), name(0, end).alias("name_key")).distinct()
    x = F.lit("x")
    aliases = f.where(F.col("facility_id") % 3 == 0).select(name(0, x).alias("name_key"), F.array(name(-5, x), name(10, x)).alias("candidates"))
    rows = f.select(F.col("facility_id").alias("id"), "state", F.concat(F.lit("Depot "), F.col("facility_id").cast("string"), F.lit(" X")).alias("name"))
    return E.alias_join(rows, "id", "state", "name", geo, aliases)


# ---------------------------------------------------------------- sessions


@query(
    "bounded_history",
    """SELECT conv_id, turn, role, CAST(rn AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4""",
)
def bounded_history(spark, sf):
    return S.last_turns(roles.table(spark, sf, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role", F.col("rn").alias("back"))


@query(
    "dedupe_facts",
    """, f AS (SELECT l_orderkey AS session, min(l_partkey * 10 + l_linenumber) AS seq, lower(p_name) AS fact FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 3)
       SELECT session, seq, fact FROM f QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 3""".replace(", f AS", "WITH f AS", 1),
)
def dedupe_facts(spark, sf):
    li = roles.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = roles.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("fact"))
    f = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("session"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), "fact"
    )
    return S.distinct_facts(f, "session", "seq", "fact", 3).select("session", "seq", F.lower("fact").alias("fact"))


@query(
    "evict_idle",
    """, s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1)
       SELECT user_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM s WHERE last_seen >= TIMESTAMP '2024-02-12 12:00:00' - INTERVAL 14 DAY
       ORDER BY s.last_seen DESC, user_id LIMIT 100""".replace(", s AS", "WITH s AS", 1),
)
def evict_idle(spark, sf):
    e = roles.table(spark, sf, "events").select("user_id", "ts")
    l = S.live_sessions(e, "user_id", "ts", "2024-02-12 12:00:00", capacity=100)
    return l.select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


# ---------------------------------------------------------------- tables and provenance


@query(
    "null_clean",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS v,
         CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS w FROM customer""",
)
def null_clean(spark, sf):
    from geodemand.sources.sinks import null_clean as clean

    c = roles.table(spark, sf, "customer")
    inf = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(float("-inf"))).otherwise(F.col("c_acctbal"))
    raw = c.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(inf).alias("v"), F.struct(inf.alias("w")).alias("s"))
    return clean(raw).select("c_custkey", "v", F.col("s.w").alias("w"))


@query(
    "table_profile",
    """SELECT 'place_id' AS feature, 'derived' AS "group", 'bigint' AS dtype, CAST(NULL AS BIGINT) AS nunique
       UNION ALL SELECT 'block_id', 'derived', 'string', count(DISTINCT block_id) FROM feature
       UNION ALL SELECT 'segment', 'derived', 'string', count(DISTINCT segment) FROM feature
       UNION ALL SELECT 'soil_texture', 'soil', 'string', count(DISTINCT soil_texture) FROM feature
       UNION ALL SELECT 'dominant_crop', 'derived', 'string', count(DISTINCT dominant_crop) FROM feature
       UNION ALL SELECT 'dealer_distance_km', 'distribution', 'double', NULL
       UNION ALL SELECT 'residue_t', 'residue', 'double', NULL""",
    needs=("feature",),
)
def table_profile(spark, sf):
    f = PR.features(spark, sf)
    return Q.table_profile(f.select("place_id", "block_id", "segment", "soil_texture", "dominant_crop", "dealer_distance_km", "residue_t", "lon"), skip=["lon"])


@query(
    "contract_violations",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'real' WHEN o_orderstatus = 'O' THEN 'allocated' ELSE 'guess:' || o_orderpriority END AS provenance, count(*) AS n
       FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1""",
)
def contract_violations(spark, sf):
    from geodemand.sources.sinks import unknown_provenance

    o = roles.table(spark, sf, "orders")
    p = F.when(F.col("o_orderstatus") == "F", "real").when(F.col("o_orderstatus") == "O", "allocated").otherwise(F.concat(F.lit("guess:"), "o_orderpriority"))
    o = o.select(p.alias("provenance"))
    return o.join(unknown_provenance(o), "provenance", "left_semi").groupBy("provenance").agg(F.count(F.lit(1)).alias("n"))


@query(
    "weakest_provenance",
    """SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 END) WHEN 2 THEN 'allocated' WHEN 3 THEN 'real' ELSE 'simulated' END AS provenance
       FROM orders GROUP BY 1""",
)
def weakest_provenance(spark, sf):
    s = F.col("o_orderstatus")
    p = F.when(s == "P", "simulated").when(s == "O", "allocated").when(s == "F", "real")
    return roles.table(spark, sf, "orders").select("o_custkey", p.alias("p")).groupBy("o_custkey").agg(weakest_of_rows("p").alias("provenance"))


@query(
    "source_priority_merge",
    """, a AS (SELECT c_custkey AS k, c_mktsegment AS v, 'first' AS src FROM customer WHERE c_acctbal > 5000),
       b AS (SELECT DISTINCT o_custkey AS k, 'ordered' AS v, 'second' AS src FROM orders WHERE o_orderstatus = 'P'),
       c AS (SELECT c_custkey AS k, 'known' AS v, 'third' AS src FROM customer)
       SELECT k, arg_min(v, p) AS v, arg_min(src, p) AS src FROM (SELECT *, 0 AS p FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c) GROUP BY 1""".replace(", a AS", "WITH a AS", 1),
)
def source_priority_merge(spark, sf):
    c = roles.table(spark, sf, "customer")
    a = c.where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit("first").alias("src"))
    o = roles.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    b = o.select(F.col("o_custkey").alias("k"), F.lit("ordered").alias("v"), F.lit("second").alias("src")).distinct()
    d = c.select(F.col("c_custkey").alias("k"), F.lit("known").alias("v"), F.lit("third").alias("src"))
    return first_source_wins([a, b, d], ["k"])


@query(
    "latest_record_per_source",
    """SELECT source, doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) = 1""",
)
def latest_record_per_source(spark, sf):
    d = roles.table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    return latest_per_source(d, "source", [F.col("n_chars"), F.col("doc_id")])


@query(
    "hier_ids",
    """SELECT place_id, block_id, printf('%03d', district_id) || 'V' || printf('%05d', row_number() OVER (PARTITION BY district_id ORDER BY place_id)) AS hier_id FROM place""",
    needs=("place",),
)
def hier_ids(spark, sf):
    p = roles.places(spark, sf).withColumn("parent", F.lpad(F.col("district_id").cast("string"), 3, "0"))
    return hierarchical_ids(p, "parent", "place_id", "V", 5, "hier_id").select("place_id", "block_id", "hier_id")


@query(
    "anti_orphans",
    """SELECT 'facility without parts sold' AS check_name, s_suppkey AS id, CAST(NULL AS BIGINT) AS n FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 49)
       UNION ALL SELECT 'line number used twice', l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 3
       UNION ALL SELECT 'order out of bounds', o_orderkey, NULL FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 499000""",
)
def anti_orphans(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    s = Q.orphans(roles.table(spark, sf, "supplier"), "s_suppkey", li.where((F.col("l_discount") >= 0.1) & (F.col("l_quantity") >= 49)), "l_suppkey")
    d = Q.duplicates(li, ["l_orderkey", "l_linenumber"]).where(F.col("n") > 3)
    b = Q.out_of_bounds(roles.table(spark, sf, "orders"), "o_totalprice", 1000, 499000)
    none = F.lit(None).cast("bigint").alias("n")
    return (
        s.select(F.lit("facility without parts sold").alias("check_name"), F.col("s_suppkey").alias("id"), none)
        .unionByName(d.select(F.lit("line number used twice").alias("check_name"), F.col("l_orderkey").alias("id"), "n"))
        .unionByName(b.select(F.lit("order out of bounds").alias("check_name"), F.col("o_orderkey").alias("id"), none))
    )


@query(
    "set_difference_keys",
    """SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000""",
)
def set_difference_keys(spark, sf):
    o = roles.table(spark, sf, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("k"))
    return Q.missing_from(roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), o)


# ---------------------------------------------------------------- fact packs


def whole(c):
    """Whole number with thousands separators."""
    return F.format_number(F.round(c).cast("bigint"), 0)


@query(
    "fact_pack_overview",
    """, n AS (SELECT district_id, sum(units) AS units FROM star GROUP BY 1), t AS (SELECT n.*, n_name, row_number() OVER (ORDER BY units DESC, district_id) AS rn FROM n JOIN nation ON n_nationkey = district_id),
       s AS (SELECT sum(units) AS u, sum(value) AS v, sum(headroom) AS h FROM star)
       SELECT 'all products' AS scope, CAST(round(u) AS BIGINT) AS total_units, round(v / 1e7, 4) AS value_crore, CAST(round(h) AS BIGINT) AS unserved,
         (SELECT string_agg(n_name, ', ' ORDER BY rn) FROM t WHERE rn <= 5) AS top_5_districts,
         round((SELECT sum(units) FROM t WHERE rn <= 5) / u * 100, 4) AS share_top_5_pct,
         'Yearly units over all products: ' || format('{:,}', CAST(round(u) AS BIGINT)) || '. First ' || (SELECT n_name FROM t WHERE rn = 1) || ' with '
          || (SELECT format('{:,}', CAST(round(units) AS BIGINT)) FROM t WHERE rn = 1) || ', then ' || (SELECT n_name FROM t WHERE rn = 2) || ' and ' || (SELECT n_name FROM t WHERE rn = 3)
          || '. Five districts together: ' || printf('%.0f', round((SELECT sum(units) FROM t WHERE rn <= 5) / u * 100)) || ' percent.' AS txt FROM s""",
    needs=("star",),
)
def fact_pack_overview(spark, sf):
    n = children(LV.nodes(spark, sf), "district").select("district_id", F.col("name").alias("district"), "units", "value", "headroom")
    top = n.orderBy(F.desc("units"), "district_id").limit(5)
    arr = F.array_sort(F.collect_list(F.struct((-F.col("units")).alias("k"), "district_id", "district")))
    top = top.agg(arr.alias("a"), F.sum("units").alias("u"))
    names = F.concat_ws(", ", F.transform("a", lambda x: x["district"])).alias("names")
    t = top.select(F.struct("a", "u", names).alias("s")).scalar()
    s = n.agg(F.sum("units").alias("u"), F.sum("value").alias("v"), F.sum("headroom").alias("h"))
    name = lambda i: t["a"][i]["district"]
    share = t["u"] / F.col("u") * 100
    text = F.concat(
        F.lit("Yearly units over all products: "), whole("u"), F.lit(". First "), name(0), F.lit(" with "), whole(-t["a"][0]["k"]),
        F.lit(", then "), name(1), F.lit(" and "), name(2), F.lit(". Five districts together: "),
        F.format_string("%.0f", F.round(share)), F.lit(" percent."),
    )
    return s.select(
        F.lit("all products").alias("scope"), F.round("u").cast("bigint").alias("total_units"), F.round(F.col("v") / 1e7, 4).alias("value_crore"),
        F.round("h").cast("bigint").alias("unserved"), t["names"].alias("top_5_districts"),
        F.round(share, 4).alias("share_top_5_pct"), text.alias("txt"),
    )


@query(
    "fact_pack_geography",
    """, a AS (SELECT district, action_segment, count(*) AS n, sum(potential_units_yr) AS u FROM ins3 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY district ORDER BY n DESC, action_segment) = 1),
       t AS (SELECT district, archetype, count(*) AS n FROM ins3 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY district ORDER BY n DESC, archetype) = 1),
       g AS (SELECT district, count(*) AS places, sum(potential_units_yr) AS u, sum(headroom) AS h, avg(attach_rate) AS r, avg(dealer_distance_km) AS km FROM ins3 GROUP BY 1)
       SELECT g.district AS name, places, round(g.u, 4) AS units, round(h, 4) AS unserved, round(r, 4) AS implements_per_tractor, round(km, 4) AS km_to_dealer,
         t.archetype AS main_type, a.action_segment AS main_action,
         g.district || ': ' || places || ' places with '  || printf('%.2f', round(r + 3e-11, 2)) || ' owned per tractor; commonest kind ' || t.archetype || '; commonest advice for '
          || a.n || ' of them ' || a.action_segment || '.' AS txt
       FROM g JOIN a USING (district) JOIN t USING (district)""",
    needs=("ins3",),
)
def fact_pack_geography(spark, sf):
    from geodemand.functions.scalars import steady_round

    i = base_insights(spark, sf)
    g = i.groupBy("district").agg(
        F.count(F.lit(1)).alias("places"), F.sum("potential_units_yr").alias("u"), F.sum("headroom").alias("h"), F.avg("attach_rate").alias("r"), F.avg("dealer_distance_km").alias("km")
    )

    def commonest(c, out):
        n = i.groupBy("district", c).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("district").agg(F.min_by(F.struct(F.col(c).alias("v"), "n"), F.struct((-F.col("n")).alias("k"), c)).alias(out))

    g = g.join(commonest("action_segment", "a"), "district").join(commonest("archetype", "t"), "district")
    text = F.concat(
        "district", F.lit(": "), F.col("places").cast("string"), F.lit(" places with "), F.format_string("%.2f", steady_round("r", 2)),
        F.lit(" owned per tractor; commonest kind "), F.col("t.v"), F.lit("; commonest advice for "), F.col("a.n").cast("string"), F.lit(" of them "), F.col("a.v"), F.lit("."),
    )
    return g.select(
        F.col("district").alias("name"), "places", F.round("u", 4).alias("units"), F.round("h", 4).alias("unserved"), F.round("r", 4).alias("implements_per_tractor"),
        F.round("km", 4).alias("km_to_dealer"), F.col("t.v").alias("main_type"), F.col("a.v").alias("main_action"), text.alias("txt"),
    )


@query(
    "fact_pack_products",
    """, g AS (SELECT sku_id, category, sum(potential_units_yr) AS u, sum(new_units_yr) AS n, sum(replacement_units_yr) AS r, sum(potential_value) AS v FROM score GROUP BY 1, 2)
       SELECT sku_id, category, round(u, 4) AS units, round(n, 4) AS new_demand, round(r, 4) AS replacement_demand, round(v / 1e7, 6) AS value_crore, round(r / u * 100, 4) AS replacement_pct
       FROM g ORDER BY g.u DESC, sku_id LIMIT 8""",
    needs=("score",),
)
def fact_pack_products(spark, sf):
    g = SC.scores(spark, sf).groupBy("sku_id", "category").agg(
        F.sum("potential_units_yr").alias("u"), F.sum("new_units_yr").alias("n"), F.sum("replacement_units_yr").alias("r"), F.sum("potential_value").alias("v")
    )
    return g.orderBy(F.desc("u"), "sku_id").limit(8).select(
        "sku_id", "category", F.round("u", 4).alias("units"), F.round("n", 4).alias("new_demand"), F.round("r", 4).alias("replacement_demand"),
        F.round(F.col("v") / 1e7, 6).alias("value_crore"), F.round(F.col("r") / F.col("u") * 100, 4).alias("replacement_pct"),
    )
