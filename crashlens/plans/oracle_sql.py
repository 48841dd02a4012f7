"""Independent SQL texts (DuckDB dialect) for every registered query.

They run on the raw test tables (registered as views by the checker) and are written
directly in SQL, not generated from the Spark code, so a mistake on one side shows up as a
mismatch. The incident views repeat the rules of ``crashlens.sources.sample_views``.
Notes: DuckDB sums integers as HUGEINT, so sums are cast to BIGINT; every dedup order says
NULLS LAST; ties go to the group value ascending, as in the Spark code.
"""

from __future__ import annotations

_UNITS = """
units AS (
  SELECT l_orderkey AS crash_id,
         l_linenumber AS unit_nbr,
         CASE l_suppkey % 40 WHEN 0 THEN 'NA' WHEN 1 THEN '98'
              ELSE 'S' || CAST(l_suppkey % 40 AS VARCHAR) END AS veh_lic_state_id,
         'V' || CAST(l_partkey AS VARCHAR) AS vin,
         CASE WHEN p_size = 1 THEN 'NA' ELSE CAST(1970 + p_size AS VARCHAR) END AS veh_mod_year,
         p_brand AS veh_make_id,
         CASE l_partkey % 14 WHEN 12 THEN 'NA' WHEN 13 THEN '99'
              ELSE 'C' || CAST(l_partkey % 14 AS VARCHAR) END AS veh_color_id,
         CASE l_partkey % 7 WHEN 0 THEN 'PASSENGER CAR, 4-DOOR' WHEN 1 THEN 'Passenger Car, 2-Door'
              WHEN 2 THEN 'PICKUP' WHEN 3 THEN 'MOTORCYCLE' WHEN 4 THEN 'Police Motorcycle'
              WHEN 5 THEN 'UNKNOWN' END AS veh_body_styl_id,
         CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS veh_hnr_fl,
         CASE WHEN l_linestatus = 'F' THEN 'LIABILITY INSURANCE POLICY' ELSE 'SURETY BOND' END
           AS fin_resp_type_id,
         CASE CAST(l_quantity AS INTEGER) % 11 WHEN 7 THEN 'DAMAGED 7 HIGHEST' WHEN 8 THEN 'NO DAMAGE'
              WHEN 9 THEN 'NA' WHEN 10 THEN 'INVALID VALUE'
              ELSE 'DAMAGED ' || CAST(CAST(l_quantity AS INTEGER) % 11 AS VARCHAR) END AS veh_dmag_scl_1_id,
         CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN 'DAMAGED 6' WHEN 1 THEN 'NO DAMAGE'
              WHEN 2 THEN 'NA' END AS veh_dmag_scl_2_id,
         CASE CAST(round(l_discount * 100) AS INTEGER) WHEN 0 THEN 'UNDER INFLUENCE - ALCOHOL'
              WHEN 1 THEN 'Had Been Drinking' ELSE 'NONE' END AS contrib_factr_1_id,
         CASE CAST(round(l_tax * 100) AS INTEGER) WHEN 0 THEN 'ALCOHOL' ELSE 'NA' END AS contrib_factr_2_id,
         'NA' AS contrib_factr_p1_id,
         CAST(l_quantity AS INTEGER) % 4 AS tot_injry_cnt,
         CASE WHEN CAST(l_quantity AS INTEGER) % 10 = 0 THEN 1 ELSE 0 END AS death_cnt
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
units_k AS (
  SELECT * FROM units
  QUALIFY row_number() OVER (PARTITION BY crash_id, unit_nbr ORDER BY
    veh_lic_state_id ASC NULLS LAST, vin ASC NULLS LAST, veh_mod_year ASC NULLS LAST,
    veh_make_id ASC NULLS LAST, veh_color_id ASC NULLS LAST, veh_body_styl_id ASC NULLS LAST,
    veh_hnr_fl ASC NULLS LAST, fin_resp_type_id ASC NULLS LAST, veh_dmag_scl_1_id ASC NULLS LAST,
    veh_dmag_scl_2_id ASC NULLS LAST, contrib_factr_1_id ASC NULLS LAST,
    contrib_factr_2_id ASC NULLS LAST, contrib_factr_p1_id ASC NULLS LAST,
    tot_injry_cnt ASC NULLS LAST, death_cnt ASC NULLS LAST) = 1
)"""

_PERSONS = """
persons AS (
  SELECT l_orderkey AS crash_id,
         l_linenumber AS unit_nbr,
         CAST(1 + l_partkey % 2 AS INTEGER) AS prsn_nbr,
         CASE l_suppkey % 5 WHEN 0 THEN 'PASSENGER/OCCUPANT' WHEN 1 THEN 'Driver of Motorcycle Type Vehicle'
              ELSE 'DRIVER' END AS prsn_type_id,
         CASE l_partkey % 5 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'Male' WHEN 2 THEN 'UNKNOWN'
              WHEN 3 THEN 'MALE' END AS prsn_gndr_id,
         CASE CAST(l_quantity AS INTEGER) % 3 WHEN 0 THEN 'KILLED' WHEN 1 THEN 'NOT INJURED'
              ELSE 'NA' END AS prsn_injry_sev_id,
         CASE CAST(l_quantity AS INTEGER) % 2 WHEN 0 THEN 'NOT DEPLOYED' ELSE 'DEPLOYED, FRONT' END
           AS prsn_airbag_id,
         CASE o_custkey % 6 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'BLACK' WHEN 2 THEN 'HISPANIC'
              WHEN 3 THEN 'NA' WHEN 4 THEN 'UNKNOWN' END AS prsn_ethnicity_id,
         CASE l_suppkey % 4 WHEN 0 THEN 'CLASS C' WHEN 1 THEN 'OTHER/OUT OF STATE'
              WHEN 2 THEN 'UNLICENSED' END AS drvr_lic_cls_id,
         'ST' || CAST(c_nationkey AS VARCHAR) AS drvr_lic_state_id,
         CASE o_custkey % 50 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN NULL
              ELSE CAST(78000 + o_custkey % 50 AS VARCHAR) END AS drvr_zip,
         CASE WHEN o_orderstatus = 'F' THEN 'Positive' ELSE 'NA' END AS prsn_alc_rslt_id,
         CAST(l_quantity AS INTEGER) % 3 AS tot_injry_cnt,
         CASE WHEN CAST(l_quantity AS INTEGER) % 3 = 0 THEN 1 ELSE 0 END AS death_cnt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
persons_k AS (
  SELECT * FROM persons
  QUALIFY row_number() OVER (PARTITION BY crash_id, unit_nbr ORDER BY
    prsn_nbr ASC NULLS LAST, prsn_type_id ASC NULLS LAST, prsn_gndr_id ASC NULLS LAST,
    prsn_injry_sev_id ASC NULLS LAST, prsn_airbag_id ASC NULLS LAST,
    prsn_ethnicity_id ASC NULLS LAST, drvr_lic_cls_id ASC NULLS LAST,
    drvr_lic_state_id ASC NULLS LAST, drvr_zip ASC NULLS LAST, prsn_alc_rslt_id ASC NULLS LAST,
    tot_injry_cnt ASC NULLS LAST, death_cnt ASC NULLS LAST) = 1
)"""

_CHARGES = """
charges_k AS (
  SELECT * FROM (
    SELECT l_orderkey AS crash_id,
           l_linenumber AS unit_nbr,
           CAST(1 + l_partkey % 2 AS INTEGER) AS prsn_nbr,
           CASE l_suppkey % 3 WHEN 0 THEN 'SPEEDING - 10% OVER' WHEN 1 THEN 'Unsafe Speed'
                ELSE 'NO DRIVER LICENSE' END AS charge,
           'CIT' || CAST(l_suppkey AS VARCHAR) AS citation_nbr
    FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY crash_id, unit_nbr, prsn_nbr
                             ORDER BY charge ASC NULLS LAST, citation_nbr ASC NULLS LAST) = 1
)"""

_DAMAGES = """
damages_k AS (
  SELECT * FROM (
    SELECT l_orderkey AS crash_id,
           CASE l_partkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'No Damages to Pole' WHEN 2 THEN 'FENCE'
                WHEN 3 THEN 'MAILBOX' END AS damaged_property
    FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY crash_id ORDER BY damaged_property ASC NULLS LAST) = 1
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_UP = _with(_UNITS, _PERSONS)

_HIT_AND_RUN = """
  FROM units_k u JOIN persons_k p USING (crash_id, unit_nbr)
  WHERE upper(u.veh_hnr_fl) = 'Y'
    AND contains(upper(p.prsn_type_id), 'DRIVER')
    AND (contains(upper(p.drvr_lic_cls_id), 'CLASS') OR contains(upper(p.drvr_lic_cls_id), 'OTHER'))"""

_Q9_FILTER = """
  WHERE (contains(upper(d.damaged_property), 'NONE') OR contains(upper(d.damaged_property), 'NO DAMAGE'))
    AND ((upper(u.veh_dmag_scl_1_id) > 'DAMAGED 4'
          AND upper(u.veh_dmag_scl_1_id) NOT IN ('NA', 'NO DAMAGE', 'INVALID VALUE'))
      OR (upper(u.veh_dmag_scl_2_id) > 'DAMAGED 4'
          AND upper(u.veh_dmag_scl_2_id) NOT IN ('NA', 'NO DAMAGE', 'INVALID VALUE')))
    AND contains(upper(u.fin_resp_type_id), 'INSURANCE')"""

QUESTIONS_SQL = {
    "q1": _with(_PERSONS) + """
SELECT crash_id, count(*) AS count_of_males_killed
FROM persons_k
WHERE upper(prsn_gndr_id) = 'MALE' AND upper(prsn_injry_sev_id) = 'KILLED'
GROUP BY crash_id
HAVING count(*) > 2""",

    "q2": _with(_UNITS) + """
SELECT count(*) AS n FROM (
  SELECT DISTINCT veh_lic_state_id, vin, veh_mod_year, veh_make_id
  FROM units_k WHERE contains(upper(veh_body_styl_id), 'MOTORCYCLE'))""",

    "q2_rows": _with(_UNITS) + """
SELECT * FROM units_k WHERE contains(upper(veh_body_styl_id), 'MOTORCYCLE')
QUALIFY row_number() OVER (PARTITION BY veh_lic_state_id, vin, veh_mod_year, veh_make_id
                           ORDER BY crash_id, unit_nbr) = 1""",

    "q3": _UP + """
SELECT veh_make_id, count(*) AS "count" FROM (
  SELECT DISTINCT u.veh_lic_state_id, u.vin, u.veh_mod_year, u.veh_make_id
  FROM units_k u JOIN persons_k p USING (crash_id, unit_nbr)
  WHERE contains(upper(u.veh_body_styl_id), 'CAR')
    AND upper(p.prsn_type_id) = 'DRIVER'
    AND upper(p.prsn_airbag_id) = 'NOT DEPLOYED'
    AND upper(p.prsn_injry_sev_id) = 'KILLED')
GROUP BY veh_make_id
ORDER BY "count" DESC, veh_make_id ASC NULLS LAST
LIMIT 5""",

    "q4": _UP + """
SELECT count(*) AS n FROM (
  SELECT DISTINCT u.veh_lic_state_id, u.vin, u.veh_mod_year, u.veh_make_id""" + _HIT_AND_RUN + ")",

    "q4_rows": _UP + """
SELECT crash_id, unit_nbr,
       u.* EXCLUDE (crash_id, unit_nbr, tot_injry_cnt, death_cnt),
       p.* EXCLUDE (crash_id, unit_nbr)""" + _HIT_AND_RUN + """
QUALIFY row_number() OVER (PARTITION BY u.veh_lic_state_id, u.vin, u.veh_mod_year, u.veh_make_id
                           ORDER BY crash_id, unit_nbr) = 1""",

    # Written as the surveyed job states it: crashes without females, joined back.
    "q5": _with(_PERSONS) + """,
no_female AS (
  SELECT crash_id FROM persons_k GROUP BY crash_id
  HAVING sum(CASE WHEN upper(prsn_gndr_id) = 'FEMALE' THEN 1 ELSE 0 END) = 0)
SELECT p.drvr_lic_state_id, count(DISTINCT p.crash_id) AS count_of_accidents
FROM no_female f JOIN persons_k p ON f.crash_id = p.crash_id
GROUP BY p.drvr_lic_state_id
ORDER BY count_of_accidents DESC, drvr_lic_state_id ASC NULLS LAST
LIMIT 1""",

    "q6": _with(_UNITS) + """
SELECT veh_make_id,
       CAST(sum(tot_injry_cnt + death_cnt) AS BIGINT) AS death_plus_injry_cnt_per_veh_make_id
FROM units_k
GROUP BY veh_make_id
ORDER BY death_plus_injry_cnt_per_veh_make_id DESC NULLS LAST, veh_make_id ASC NULLS LAST
LIMIT 3 OFFSET 2""",

    "q7": _UP + """,
counted AS (
  SELECT u.veh_body_styl_id, p.prsn_ethnicity_id, count(*) AS "count"
  FROM units_k u JOIN persons_k p USING (crash_id, unit_nbr)
  WHERE upper(u.veh_body_styl_id) NOT IN ('NA', 'UNKNOWN', 'NOT REPORTED')
    AND upper(p.prsn_ethnicity_id) NOT IN ('NA', 'UNKNOWN')
  GROUP BY u.veh_body_styl_id, p.prsn_ethnicity_id)
SELECT * FROM counted
QUALIFY row_number() OVER (PARTITION BY veh_body_styl_id
                           ORDER BY "count" DESC, prsn_ethnicity_id ASC NULLS LAST) = 1
ORDER BY "count" DESC""",

    "q8": _UP + """
SELECT p.drvr_zip, count(DISTINCT crash_id) AS crash_count
FROM units_k u JOIN persons_k p USING (crash_id, unit_nbr)
WHERE p.drvr_zip IS NOT NULL AND upper(p.drvr_zip) NOT IN ('UNKNOWN')
  AND (contains(upper(u.contrib_factr_1_id), 'ALCOHOL') OR contains(upper(u.contrib_factr_2_id), 'ALCOHOL')
    OR contains(upper(u.contrib_factr_p1_id), 'ALCOHOL') OR contains(upper(u.contrib_factr_1_id), 'DRINKING')
    OR contains(upper(u.contrib_factr_2_id), 'DRINKING') OR contains(upper(u.contrib_factr_p1_id), 'DRINKING')
    OR contains(upper(p.prsn_alc_rslt_id), 'POSITIVE'))
GROUP BY p.drvr_zip
ORDER BY crash_count DESC, drvr_zip ASC NULLS LAST
LIMIT 5""",

    "q9": _with(_UNITS, _DAMAGES) + """
SELECT count(DISTINCT crash_id) AS n
FROM units_k u JOIN damages_k d USING (crash_id)""" + _Q9_FILTER,

    "q9_rows": _with(_UNITS, _DAMAGES) + """
SELECT crash_id, u.* EXCLUDE (crash_id), d.damaged_property
FROM units_k u JOIN damages_k d USING (crash_id)""" + _Q9_FILTER + """
QUALIFY row_number() OVER (PARTITION BY crash_id ORDER BY u.unit_nbr) = 1
ORDER BY crash_id DESC""",

    "q10": _with(_UNITS, _PERSONS, _CHARGES) + """,
colours AS (
  SELECT veh_color_id FROM units_k
  WHERE NOT veh_color_id IN ('NA') AND TRY_CAST(veh_color_id AS INTEGER) IS NULL
  GROUP BY veh_color_id ORDER BY count(*) DESC, veh_color_id ASC LIMIT 10),
states AS (
  SELECT veh_lic_state_id FROM units_k
  WHERE NOT veh_lic_state_id IN ('NA') AND TRY_CAST(veh_lic_state_id AS INTEGER) IS NULL
  GROUP BY veh_lic_state_id ORDER BY count(*) DESC, veh_lic_state_id ASC LIMIT 25)
SELECT u.veh_make_id, count(*) AS offence_count
FROM charges_k c
JOIN persons_k p USING (crash_id, unit_nbr, prsn_nbr)
JOIN units_k u USING (crash_id, unit_nbr)
WHERE u.veh_color_id IN (SELECT veh_color_id FROM colours)
  AND u.veh_lic_state_id IN (SELECT veh_lic_state_id FROM states)
  AND contains(upper(p.prsn_type_id), 'DRIVER')
  AND (contains(upper(p.drvr_lic_cls_id), 'CLASS') OR contains(upper(p.drvr_lic_cls_id), 'OTHER'))
  AND contains(upper(c.charge), 'SPEED')
GROUP BY u.veh_make_id
ORDER BY offence_count DESC, veh_make_id ASC NULLS LAST
LIMIT 5""",
}

_CHARGES_ANY = """
charges_any AS (
  SELECT * FROM (
    SELECT l_orderkey AS crash_id,
           l_linenumber AS unit_nbr,
           CAST(1 + l_partkey % 2 AS INTEGER) AS prsn_nbr,
           CASE l_suppkey % 3 WHEN 0 THEN 'SPEEDING - 10% OVER' WHEN 1 THEN 'Unsafe Speed'
                ELSE 'NO DRIVER LICENSE' END AS charge,
           'CIT' || CAST(l_suppkey AS VARCHAR) AS citation_nbr
    FROM lineitem)
  WHERE contains(upper(charge), 'SPEED')
  QUALIFY row_number() OVER (PARTITION BY crash_id, unit_nbr, prsn_nbr
                             ORDER BY charge ASC NULLS LAST, citation_nbr ASC NULLS LAST) = 1
)"""

_DAMAGES_ANY = """
damages_any AS (
  SELECT * FROM (
    SELECT l_orderkey AS crash_id,
           CASE l_partkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'No Damages to Pole' WHEN 2 THEN 'FENCE'
                WHEN 3 THEN 'MAILBOX' END AS damaged_property
    FROM lineitem)
  WHERE contains(upper(damaged_property), 'NONE') OR contains(upper(damaged_property), 'NO DAMAGE')
  QUALIFY row_number() OVER (PARTITION BY crash_id ORDER BY damaged_property ASC NULLS LAST) = 1
)"""

MATCH_MODE_SQL = {
    "q9_any_damage": _with(_UNITS, _DAMAGES_ANY) + """
SELECT count(DISTINCT crash_id) AS n
FROM units_k u JOIN damages_any d USING (crash_id)
WHERE ((upper(u.veh_dmag_scl_1_id) > 'DAMAGED 4'
        AND upper(u.veh_dmag_scl_1_id) NOT IN ('NA', 'NO DAMAGE', 'INVALID VALUE'))
    OR (upper(u.veh_dmag_scl_2_id) > 'DAMAGED 4'
        AND upper(u.veh_dmag_scl_2_id) NOT IN ('NA', 'NO DAMAGE', 'INVALID VALUE')))
  AND contains(upper(u.fin_resp_type_id), 'INSURANCE')""",

    "q10_any_charge": _with(_UNITS, _PERSONS, _CHARGES_ANY) + """,
colours AS (
  SELECT veh_color_id FROM units_k
  WHERE NOT veh_color_id IN ('NA') AND TRY_CAST(veh_color_id AS INTEGER) IS NULL
  GROUP BY veh_color_id ORDER BY count(*) DESC, veh_color_id ASC LIMIT 10),
states AS (
  SELECT veh_lic_state_id FROM units_k
  WHERE NOT veh_lic_state_id IN ('NA') AND TRY_CAST(veh_lic_state_id AS INTEGER) IS NULL
  GROUP BY veh_lic_state_id ORDER BY count(*) DESC, veh_lic_state_id ASC LIMIT 25)
SELECT u.veh_make_id, count(*) AS offence_count
FROM charges_any c
JOIN persons_k p USING (crash_id, unit_nbr, prsn_nbr)
JOIN units_k u USING (crash_id, unit_nbr)
WHERE u.veh_color_id IN (SELECT veh_color_id FROM colours)
  AND u.veh_lic_state_id IN (SELECT veh_lic_state_id FROM states)
  AND contains(upper(p.prsn_type_id), 'DRIVER')
  AND (contains(upper(p.drvr_lic_cls_id), 'CLASS') OR contains(upper(p.drvr_lic_cls_id), 'OTHER'))
GROUP BY u.veh_make_id
ORDER BY offence_count DESC, veh_make_id ASC NULLS LAST
LIMIT 5""",
}

_LP = "lp AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"
_CODE = """coded AS (
  SELECT CASE p_partkey % 29 WHEN 0 THEN '1.5' WHEN 1 THEN '.5' WHEN 2 THEN '1.' WHEN 3 THEN '1e3' WHEN 4 THEN ' 12 '
              WHEN 5 THEN '99999999999' WHEN 6 THEN '-7' WHEN 7 THEN '+.' WHEN 8 THEN ''
         ELSE CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'na' ELSE p_brand END END AS code
  FROM part)"""

# A number: sign, digits, fraction; its whole part (text before the point) fits 32 bits.
_NUMBER = r"""(regexp_matches(trim(code), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$')
       AND abs(coalesce(TRY_CAST(split_part(trim(code), '.', 1) AS DECIMAL(38, 0)),
                        CASE WHEN length(split_part(trim(code), '.', 1)) > 1 THEN 9999999999 ELSE 0 END)) <= 2147483647)"""

_SIDES = """l AS (SELECT s_nationkey AS nation, s_suppkey AS id, s_name AS name, 's' AS r_name FROM supplier),
r AS (SELECT c_nationkey AS nation, min(c_custkey) AS id, min(c_name) AS name, count(*) AS n
      FROM customer GROUP BY c_nationkey)"""

OPERATORS_SQL = {
    "dedup_by_key": """
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
  l_partkey ASC NULLS LAST, l_suppkey ASC NULLS LAST, l_quantity ASC NULLS LAST,
  l_extendedprice ASC NULLS LAST, l_discount ASC NULLS LAST, l_tax ASC NULLS LAST,
  l_returnflag ASC NULLS LAST, l_linestatus ASC NULLS LAST, l_shipdate ASC NULLS LAST) = 1""",

    "distinct_entities": """
SELECT * FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey ASC NULLS LAST) = 1""",

    "count_entities": """
SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part)""",

    "groups_with_more_than": """
SELECT l_orderkey, count(*) AS n_flagged
FROM lineitem WHERE upper(l_returnflag) = 'R'
GROUP BY l_orderkey HAVING count(*) > 2""",

    "groups_without": """
SELECT DISTINCT a.l_orderkey FROM lineitem a
WHERE NOT EXISTS (SELECT 1 FROM lineitem b
                  WHERE b.l_orderkey = a.l_orderkey AND upper(b.l_returnflag) = 'R')""",

    "conditional_count": """
SELECT c_mktsegment, count(*) FILTER (WHERE contains(upper(o_orderpriority), 'URGENT')) AS n_urgent
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment""",

    "top_k_count": "WITH " + _LP + """
SELECT p_brand, count(*) AS n_lines FROM lp
GROUP BY p_brand ORDER BY n_lines DESC, p_brand ASC LIMIT 5""",

    "top_k_distinct": """
SELECT n_name, count(DISTINCT o_custkey) AS n_customers
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY n_customers DESC, n_name ASC LIMIT 5""",

    "count_distinct_ids": """
SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS n_orders
FROM lineitem GROUP BY l_returnflag, l_linestatus""",

    "group_sum": """
SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS total
FROM lineitem GROUP BY l_returnflag""",

    "rank_band": "WITH " + _LP + """
SELECT p_brand, count(*) AS n_lines FROM lp
GROUP BY p_brand ORDER BY n_lines DESC, p_brand ASC LIMIT 3 OFFSET 2""",

    "deep_rank_band": """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1000 OFFSET 5000""",

    "csv_good_records": """
SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n,
       CAST(sum(o_orderkey) AS BIGINT) AS sum_keys, CAST(sum(o_custkey) AS BIGINT) AS sum_units
FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 5 <> 0 GROUP BY 1, 2""",

    "csv_rejected_records": """
SELECT 'wrong number of fields or an open quote' AS reason,
       o_orderpriority || ',torn,' || o_orderstatus || ',' || o_custkey || ',' || o_orderkey AS text
FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey % 5 = 0""",

    "top_per_group": """
SELECT c_mktsegment, o_orderpriority, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment, o_orderpriority
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_orders DESC, o_orderpriority ASC) = 1""",

    "restrict_to_top": "WITH " + _LP + """,
top AS (SELECT p_brand FROM lp GROUP BY p_brand ORDER BY count(*) DESC, p_brand ASC LIMIT 10)
SELECT l_returnflag, count(*) AS n_lines FROM lp
WHERE p_brand IN (SELECT p_brand FROM top)
GROUP BY l_returnflag""",

    "icontains_any": """
SELECT * FROM part
WHERE contains(upper(p_name), 'BLUE') OR contains(upper(p_name), 'WIDGET')
   OR contains(upper(p_type), 'BLUE') OR contains(upper(p_type), 'WIDGET')""",

    "not_placeholder": "WITH " + _CODE + """
SELECT code, count(*) AS n FROM coded
WHERE upper(code) NOT IN ('NA', 'UNKNOWN') GROUP BY code""",

    "non_numeric": "WITH " + _CODE + """
SELECT code, count(*) AS n FROM coded
WHERE NOT """ + _NUMBER + """ GROUP BY code""",

    "grade_above": """
SELECT o_orderpriority, count(*) AS n_orders FROM orders
WHERE upper(o_orderpriority) > '2-HIGH' AND upper(o_orderpriority) NOT IN ('5-LOW')
GROUP BY o_orderpriority""",

    "join_on": """
SELECT s.s_suppkey, s.s_name, s.s_nationkey, s.s_acctbal, n.n_name, n.n_regionkey
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",

    "join_on_collision": "WITH " + _SIDES + """
SELECT l.nation, l.r_name, r.id, r.name, r.n FROM l JOIN r ON l.nation = r.nation""",

    "join_on_prefix": "WITH " + _SIDES + """
SELECT l.nation, l.id, l.name, l.r_name, r.id AS r_id, r.name AS r_r_name, r.n FROM l JOIN r ON l.nation = r.nation""",

    "sample_entities": """
SELECT p_brand, p_size, p_name, p_partkey FROM (
  SELECT *, dense_rank() OVER (ORDER BY p_brand ASC NULLS LAST, p_size ASC NULLS LAST) AS d,
         row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_name ASC NULLS LAST, p_partkey ASC NULLS LAST) AS r
  FROM part)
WHERE d <= 20 AND r = 1""",

    "three_way_join": """
SELECT p_brand, o_orderstatus, count(*) AS n_lines
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
GROUP BY p_brand, o_orderstatus""",

    "profile_table": """
SELECT (SELECT count(*) FROM lineitem) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n_distinct_rows,
       (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_keys,
       (SELECT count(*) FROM lineitem
        WHERE l_orderkey IS NULL OR CAST(l_orderkey AS VARCHAR) IN ('NA')) AS n_missing""",

    "key_counts": """
SELECT (SELECT count(*) FROM lineitem) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
         AS n_keys_l_orderkey_l_linenumber,
       (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem)) AS n_keys_l_orderkey,
       (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))
         AS n_keys_l_orderkey_l_linenumber_l_partkey""",

    "missing_counts": """
SELECT count(*) FILTER (WHERE l_returnflag IS NULL OR l_returnflag IN ('NA', 'R')) AS n_missing_l_returnflag,
       count(*) FILTER (WHERE l_linenumber IS NULL OR CAST(l_linenumber AS VARCHAR) IN ('NA', 'R'))
         AS n_missing_l_linenumber
FROM lineitem""",

    "value_counts": """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority""",

    "heavy_values": """
        SELECT l_partkey AS value, count(*) AS n
        FROM lineitem
        WHERE l_partkey IS NOT NULL
        GROUP BY l_partkey
        HAVING count(*) >= CAST(0.0005 AS DOUBLE) * (SELECT count(*) FROM lineitem)""",
    "largest_keys": """
SELECT DISTINCT l_orderkey FROM lineitem ORDER BY l_orderkey DESC LIMIT 20""",
}

PROFILE_SQL = {
    "profile_units": _with(_UNITS) + """
SELECT (SELECT count(*) FROM units) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM units)) AS n_distinct_rows,
       (SELECT count(*) FROM (SELECT DISTINCT crash_id, unit_nbr FROM units)) AS n_keys,
       (SELECT count(*) FROM units WHERE crash_id IS NULL OR CAST(crash_id AS VARCHAR) IN ('NA')) AS n_missing""",

    "value_counts_units": _with(_UNITS) + """
SELECT 'veh_body_styl_id' AS "column", veh_body_styl_id AS value, count(*) AS n
FROM units GROUP BY veh_body_styl_id
UNION ALL
SELECT 'veh_color_id', veh_color_id, count(*) FROM units GROUP BY veh_color_id
UNION ALL
SELECT 'veh_dmag_scl_1_id', veh_dmag_scl_1_id, count(*) FROM units GROUP BY veh_dmag_scl_1_id
UNION ALL
SELECT 'tot_injry_cnt', CAST(tot_injry_cnt AS VARCHAR), count(*) FROM units GROUP BY tot_injry_cnt""",
}

ORACLE_SQL = {**QUESTIONS_SQL, **MATCH_MODE_SQL, **OPERATORS_SQL, **PROFILE_SQL}
