"""Rules and probes over the star-schema tables, as SQL that Spark and any ANSI engine run alike.

Small: rules from supplier, probes from customer. Large: rules from part, probes from orders and customer. Every third to
eleventh field is NULL by its key, so wildcards and missing probe fields occur in every combination. {id} is the rule ID: the key
itself, or a smaller number that rows share.
"""

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEGMENT = lambda n: "CASE " + " ".join(f"WHEN {n} % 5 = {i} THEN '{s}'" for i, s in enumerate(SEGMENTS)) + " END"

SUPPLIER_RULES = f"""
SELECT s_suppkey AS pos, {{id}} AS rule_id,
 CASE WHEN s_suppkey % 4 <> 0 THEN {_SEGMENT('(s_suppkey + s_nationkey)')} END AS segment,
 CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS nation,
 CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS balance,
 CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 20 AS INT) END AS low,
 CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey % 20 + s_nationkey % 9 AS INT) END AS high,
 CASE WHEN s_suppkey % 6 <> 0 THEN CAST(s_suppkey % 8 AS INT) END AS value,
 CAST((s_suppkey + s_nationkey) % 5 AS INT) AS op,
 CASE WHEN s_suppkey % 2 = 0 THEN {_SEGMENT('s_nationkey')} END AS forbidden,
 CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_nationkey % 3 AS INT) END AS major,
 CAST(s_suppkey % 4 AS INT) AS minor
 FROM supplier"""

CUSTOMER_PROBES = """
SELECT c_custkey AS probe_id,
 CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 17 <> 0 THEN c_nationkey END AS nation,
 CASE WHEN c_custkey % 19 <> 0 THEN c_acctbal END AS balance,
 CASE WHEN c_custkey % 23 <> 0 THEN CAST(c_custkey % 22 AS INT) END AS low,
 CASE WHEN c_custkey % 29 <> 0 THEN CAST(c_custkey % 22 + c_custkey % 4 - 1 AS INT) END AS high,
 CASE WHEN c_custkey % 31 <> 0 THEN CAST(c_custkey % 9 AS INT) END AS value,
 CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 3 AS INT) END AS major, CAST(c_custkey % 5 AS INT) AS minor
 FROM customer"""

PART_RULES = f"""
SELECT p_partkey AS pos, {{id}} AS rule_id,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE {_SEGMENT('p_size')} END AS segment,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 25 AS INT) END AS nation,
 CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * p_size * 8 END AS min_total,
 CASE WHEN p_partkey % 7 <> 0 THEN CAST(1995*12 + p_partkey % 72 AS INT) END AS from_mi,
 CASE WHEN p_partkey % 11 <> 0 THEN CAST(1995*12 + p_partkey % 72 + 18 AS INT) END AS until_mi,
 CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 6 + 1 AS INT) END AS cmp_value,
 CAST(p_partkey % 5 AS INT) AS cmp_op,
 CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_size % 3 = 0 THEN '1-URGENT' WHEN p_size % 3 = 1 THEN '2-HIGH' ELSE '5-LOW' END END AS priority
 FROM part"""

ORDER_PROBES = """
SELECT o_orderkey AS probe_id,
 CASE WHEN o_orderkey % 13 <> 0 THEN c_mktsegment END AS segment, CASE WHEN o_orderkey % 17 <> 0 THEN c_nationkey END AS nation,
 CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END AS min_total, CASE WHEN o_orderkey % 23 <> 0 THEN CAST(year(o_orderdate)*12 + month(o_orderdate) AS INT) END AS from_mi,
 CASE WHEN o_orderkey % 23 <> 0 THEN CAST(year(o_orderdate)*12 + month(o_orderdate) + 1 AS INT) END AS until_mi,
 CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_orderkey % 7 AS INT) END AS cmp_value,
 CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END AS priority
 FROM orders JOIN customer ON o_custkey = c_custkey"""

#: A wide rule shape: 17 fields, most of them missing in most rows, as in a promotion or pricing service.
SHAPE_RULES = """
SELECT p_partkey AS pos, p_partkey AS rule_id,
 CASE WHEN p_partkey % 500 <> 0 THEN CAST(p_partkey % 365 AS INT) END AS since, CASE WHEN p_partkey % 500 <> 0 THEN CAST(p_partkey % 365 + 7 AS INT) END AS until,
 CASE WHEN p_partkey % 900 <> 0 THEN 1 END AS orders, CAST(NULL AS INT) AS slot_since, CAST(NULL AS INT) AS slot_until,
 CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey % 536 AS INT) END AS customer, CAST(NULL AS INT) AS segment, CAST(NULL AS BOOLEAN) AS fraud,
 CASE WHEN p_partkey % 8 = 1 THEN CAST(p_partkey % 179 AS INT) END AS store, CAST(NULL AS INT) AS area,
 CASE WHEN p_partkey % 1600 = 1 THEN 1 END AS region, CAST(NULL AS INT) AS retailer, CAST(NULL AS INT) AS vertical,
 CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey % 2 + 1 AS INT) END AS slot_type, CAST(NULL AS INT) AS day_of_week,
 CAST(p_partkey % 34 AS INT) AS platform, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey % 3 + 1 AS INT) END AS major, CAST(0 AS INT) AS minor,
 p_partkey % 2 = 0 AS dbs, CASE WHEN p_partkey % 500 <> 0 THEN 1 END AS market, CAST(NULL AS STRING) AS ab_label
 FROM part"""

SHAPE_PROBES = """
SELECT o_orderkey AS probe_id, CAST(o_orderkey % 365 AS INT) AS since, CAST(o_orderkey % 365 + o_orderkey % 3 AS INT) AS until,
 CAST(1 + o_orderkey % 2 AS INT) AS orders, CAST(3 AS INT) AS slot_since, CAST(4 AS INT) AS slot_until,
 CAST(o_custkey % 536 AS INT) AS customer, CAST(1 AS INT) AS segment, o_orderkey % 5 = 0 AS fraud,
 CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey % 179 AS INT) END AS store, CAST(7 AS INT) AS area, 1 AS region, CAST(2 AS INT) AS retailer, CAST(1 AS INT) AS vertical,
 CAST(o_orderkey % 2 + 1 AS INT) AS slot_type, CAST(o_orderkey % 7 AS INT) AS day_of_week,
 CAST(o_custkey % 34 AS INT) AS platform, CAST(o_orderkey % 4 + 1 AS INT) AS major, CAST(0 AS INT) AS minor, o_orderkey % 2 = 0 AS dbs, 1 AS market, CAST('a' AS STRING) AS ab_label
 FROM orders"""
