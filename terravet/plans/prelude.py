"""The domain tables of sources.warehouse in SQL, for the statements of the catalogue."""

PRELUDE = """
WITH RECURSIVE base_n AS (
  SELECT p_partkey AS id, 1 AS version, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size,
    CAST((p_partkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST((p_partkey * 17) % 170 - 85 AS DOUBLE) AS lat FROM part),
wl AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey AS node, l_returnflag AS flag FROM lineitem),
base_wn AS (SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY ln, node) - 1 AS pos FROM wl),
base_w AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS uid, o_orderdate AS created
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
base_r AS (SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
base_rm AS (SELECT o_custkey AS id, o_orderkey AS ref, o_orderstatus AS role, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos
  FROM orders JOIN customer ON c_custkey = o_custkey),
ev AS (
  SELECT event_id AS n, ts, user_id, event_type, value,
    CASE WHEN event_type = 'signup' THEN event_id + 1000000000 WHEN event_type = 'error' AND event_id % 10 = 0 THEN event_id + 2000000000 ELSE user_id END AS id,
    event_type = 'error' AS deleted, 2 + event_id % 5 AS version, user_id * 100 + day(ts) AS changeset_id FROM events),
cn AS (
  SELECT n, ts, user_id, id, deleted, version, changeset_id,
    CAST((id * 37) % 360 - 180 + n % 7 - 3 AS DOUBLE) AS lon, CAST((id * 17) % 170 - 85 + n % 7 - 3 AS DOUBLE) AS lat,
    CASE WHEN NOT deleted THEN event_type END AS event_type, CASE WHEN NOT deleted THEN 'Brand#' || (n % 25 + 1) END AS brand
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM ev) WHERE r = 1),
cwn AS (SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY ln, node) - 1 AS pos FROM wl WHERE id % 200 = 0 AND flag <> 'R'),
cw AS (SELECT id, status, priority, uid, created, 2 AS version, id NOT IN (SELECT id FROM cwn) AS deleted FROM base_w WHERE id % 200 = 0),
crm AS (SELECT id, ref, role FROM base_rm WHERE id % 50 = 0 AND role <> 'P'),
cr AS (SELECT id, segment, 2 AS version, FALSE AS deleted FROM base_r WHERE id % 50 = 0),
queue AS (
  SELECT 'n' AS objtype, id, version, deleted FROM cn WHERE NOT (deleted AND id NOT IN (SELECT id FROM base_n))
  UNION ALL SELECT 'w', id, version, deleted FROM cw UNION ALL SELECT 'r', id, version, deleted FROM cr),
base_keys AS (SELECT 'n' AS objtype, id, 1 AS version FROM base_n UNION ALL SELECT 'w', id, 1 FROM base_w UNION ALL SELECT 'r', id, 1 FROM base_r),
sets AS (
  SELECT user_id * 100 + day(ts) AS id, min(ts) AS created_at, max(ts) AS updated_at, count(*) FILTER (event_type = 'error') AS comments_count,
    CASE WHEN max(value) > 100 THEN 'yes' END AS review_requested FROM events GROUP BY 1),
-- what the graph stages take: interest by tags, movement by place, references or members
gi AS (
  SELECT 'n' AS objtype, q.id, q.deleted, b.id IS NULL AS new, coalesce(b.brand = 'Brand#11', FALSE) OR coalesce(c.brand = 'Brand#11', FALSE) AS targeted,
    b.id IS NULL OR q.deleted OR b.lon <> c.lon OR b.lat <> c.lat AS moved
  FROM queue q JOIN cn c ON q.id = c.id LEFT JOIN base_n b ON b.id = q.id WHERE q.objtype = 'n'
  UNION ALL
  SELECT 'w', c.id, c.deleted, FALSE, c.priority = '1-URGENT', c.deleted OR (SELECT count(*) FROM base_wn x WHERE x.id = c.id) <> (SELECT count(*) FROM cwn y WHERE y.id = c.id) FROM cw c
  UNION ALL
  SELECT 'r', c.id, FALSE, FALSE, c.segment = 'BUILDING', (SELECT count(*) FROM base_rm x WHERE x.id = c.id) <> (SELECT count(*) FROM crm y WHERE y.id = c.id) FROM cr c),
gn AS (SELECT DISTINCT id, node FROM (SELECT id, node FROM base_wn WHERE id IN (SELECT id FROM cw) UNION ALL SELECT id, node FROM cwn)),
gm AS (SELECT DISTINCT id, ref FROM base_rm WHERE id IN (SELECT id FROM cr)),
newrefs AS (
  SELECT objtype, id FROM gi WHERE new AND objtype = 'n' AND id IN (SELECT node FROM gn)
  UNION SELECT objtype, id FROM gi WHERE new AND objtype = 'w' AND id IN (SELECT ref FROM gm)),
p0 AS (SELECT g.*, g.deleted OR r.id IS NOT NULL AS propa FROM gi g LEFT JOIN newrefs r ON g.objtype = r.objtype AND g.id = r.id),
hotway AS (SELECT DISTINCT gn.id FROM gn JOIN p0 ON p0.objtype = 'n' AND p0.id = gn.node AND p0.propa),
p1 AS (SELECT objtype, id, deleted, new, targeted, moved, propa OR (objtype = 'w' AND id IN (SELECT id FROM hotway)) AS propa FROM p0),
hotrel AS (SELECT DISTINCT gm.id FROM gm JOIN p1 ON p1.objtype = 'w' AND p1.id = gm.ref AND p1.propa),
p2 AS (SELECT objtype, id, deleted, new, targeted, moved, propa OR (objtype = 'r' AND id IN (SELECT id FROM hotrel)) AS propa FROM p1),
st AS (
  SELECT *, targeted OR propa AS active, targeted OR propa OR moved AS eligible,
    id * 4 + CASE objtype WHEN 'n' THEN 0 WHEN 'w' THEN 1 ELSE 2 END AS v FROM p2),
ew AS (SELECT st.v, st.active, gn.node FROM st JOIN gn ON st.objtype = 'w' AND st.id = gn.id AND st.eligible),
edges AS (
  SELECT ew.v AS a, n.v AS b FROM ew JOIN st n ON n.objtype = 'n' AND n.id = ew.node AND n.eligible WHERE ew.active OR n.active
  UNION SELECT v, node * 4 + 3 FROM ew WHERE node IN (SELECT node FROM ew WHERE active)
  UNION SELECT r.v, w.v FROM st r JOIN gm ON r.objtype = 'r' AND r.id = gm.id AND r.moved AND r.eligible
    JOIN st w ON w.objtype = 'w' AND w.id = gm.ref AND w.eligible WHERE r.active OR w.active),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT v, v AS r FROM st UNION SELECT reach.v, e.b FROM reach JOIN both_ways e ON e.a = reach.r),
comp AS (SELECT st.objtype, st.id, st.v, st.targeted, c.cc_id FROM st JOIN (SELECT v, min(r) AS cc_id FROM reach WHERE r % 4 <> 3 GROUP BY v) c ON c.v = st.v)
"""


def sql(final: str, *ctes: str) -> str:
    """A statement over the prelude and more tables of its own; a final part that begins with a comma has tables too."""
    return PRELUDE.rstrip() + "".join(",\n" + c.strip() for c in ctes) + "\n" + final.strip()
