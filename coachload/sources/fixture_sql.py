"""SQL texts of the derived input views (see FIXTURES.md section 2).

They use only syntax DuckDB and Spark SQL share.  The Spark side builds the
same views with the DataFrame API in ``coachload.sources.tables``; these texts
are the oracle's copy and are prefixed as CTEs to every oracle query.
"""

LEGS_SQL = """
WITH k AS (
  SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk,
         l.l_shipdate AS sd, CAST(l.l_quantity AS BIGINT) AS q, o.o_custkey AS ck,
         l.l_orderkey * 31 + l.l_linenumber * 17 + l.l_partkey * 7 + l.l_suppkey AS h
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
v AS (
  SELECT k.*,
         CASE WHEN h % 3 = 0 THEN 'First Class' WHEN h % 3 = 1 THEN 'Standard' ELSE 'Mixed' END AS ct,
         CASE WHEN h % 3 = 0 THEN 40 + h % 41 WHEN h % 3 = 1 THEN 60 + h % 61 ELSE 80 + h % 71 END AS cap,
         sk % 25 AS fk, (sk % 25 + 1 + ck % 24) % 25 AS tk,
         sd + (5 + h % 19) * INTERVAL '1' HOUR + ((h % 4) * 15) * INTERVAL '1' MINUTE AS dep
  FROM k),
a AS (
  SELECT v.*, CAST(FLOOR(cap * (20 + q + h % 23) / 100.0) AS BIGINT) AS a_std,
         CASE WHEN ct = 'Standard' THEN 0
              ELSE CAST(FLOOR(cap * (20 + q + h % 23) / 500.0) AS BIGINT) END AS a_fst
  FROM v),
f AS (
  SELECT a.*,
         CAST(FLOOR(a_std * (10 + h % 31) / 100.0) AS BIGINT) AS al_std,
         CAST(FLOOR(a_fst * (10 + h % 31) / 100.0) AS BIGINT) AS al_fst,
         CAST(FLOOR(cap * (5 + h % 26) / 100.0) AS BIGINT) AS bo_std,
         CASE WHEN ct = 'Standard' THEN 0
              ELSE CAST(FLOOR(cap * (5 + h % 26) / 500.0) AS BIGINT) END AS bo_fst,
         5 + h % 21 AS on_u, 3 + h % 18 AS off_u
  FROM a),
s AS (
  SELECT n_nationkey AS nk, n_name AS nm,
         CASE WHEN n_nationkey = 24 THEN ''
              ELSE CONCAT(CAST(50 + n_nationkey % 9 AS VARCHAR(9)), '.',
                          CAST(1000 + (n_nationkey * 137) % 9000 AS VARCHAR(9)), ',-',
                          CAST(n_nationkey % 5 AS VARCHAR(9)), '.',
                          CAST(1000 + (n_nationkey * 251) % 9000 AS VARCHAR(9))) END AS loc
  FROM nation)
SELECT ct AS coach_type,
       CONCAT('DR', CAST(1000 + h % 9000 AS VARCHAR(20))) AS driverId,
       CONCAT('2X0', CAST(pk % 8 AS VARCHAR(20))) AS headcode,
       dep AS leg_departure_dt,
       CONCAT(CAST(ok AS VARCHAR(20)), '-', CAST(ln AS VARCHAR(20)), '-',
              CAST(pk AS VARCHAR(20)), '-', CAST(sk AS VARCHAR(20))) AS messageId_leg_start,
       dep + (20 + h % 41) * INTERVAL '1' MINUTE AS next_station_departure_dt,
       off_u AS offUnitPassenger_at_from_station,
       on_u AS onUnitPassenger_at_from_station,
       CAST(a_std + a_fst - al_std - al_fst + bo_std + bo_fst AS DOUBLE) AS relevant_passengers_on_leg_departure,
       CONCAT('RS', CAST(100001 + sk % 6 AS VARCHAR(20))) AS rsid,
       sf.loc AS stationLocation_from, st.loc AS stationLocation_to,
       sf.nm AS stationName_from, st.nm AS stationName_to,
       a_std + a_fst + on_u - off_u AS totalUnitPassenger_at_leg_departure,
       CONCAT('UNIT', CAST(100 + h % 900 AS VARCHAR(20))) AS unitId,
       CAST(cap AS DOUBLE) AS vehicle_capacity,
       CAST(al_fst AS DOUBLE) AS vehicle_pax_alighted_first_at_from,
       CAST(al_std AS DOUBLE) AS vehicle_pax_alighted_std_at_from,
       CAST(bo_fst AS DOUBLE) AS vehicle_pax_boarded_first_at_from,
       CAST(bo_std AS DOUBLE) AS vehicle_pax_boarded_std_at_from,
       CAST(a_fst AS DOUBLE) AS vehicle_pax_on_arrival_first_at_from,
       CAST(a_std AS DOUBLE) AS vehicle_pax_on_arrival_std_at_from,
       CONCAT('VEH', CAST(10000 + h % 90000 AS VARCHAR(20))) AS vehicleNo
FROM f JOIN s sf ON sf.nk = f.fk JOIN s st ON st.nk = f.tk
"""

TIPLOCS_SQL = """
SELECT CONCAT('T', CAST(1000 + n_nationkey AS VARCHAR(9))) AS tiploc_code,
       CASE WHEN n_nationkey % 4 = 2 THEN CONCAT(n_name, ' Long Depot')
            WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_name END AS description,
       CASE WHEN n_nationkey % 4 = 1 THEN CONCAT(n_name, ' Junction')
            WHEN n_nationkey % 4 = 3 THEN 'abc' ELSE n_name END AS tps_description,
       CASE WHEN n_nationkey % 2 = 0 THEN CONCAT('C', CAST(10 + n_nationkey AS VARCHAR(9))) END AS crs_code
FROM nation
"""
