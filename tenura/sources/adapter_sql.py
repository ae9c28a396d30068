"""The adapter views of ``adapters.py`` as ANSI SQL text.

Used to build the oracle queries that an independent engine (DuckDB) runs on
the same parquet tables.  ``with_views(body, names)`` prepends the named views
(and the views they depend on) as CTEs.
"""

from __future__ import annotations

from tenura.functions.codes import system_code_sql_values

_CUR = "CASE WHEN status IN ('LIVE', 'REGD') THEN TRUE ELSE FALSE END AS is_current"

VIEWS: dict[str, str] = {
    "title": f"""SELECT *, {_CUR} FROM (
SELECT concat('T', CAST(o_orderkey AS VARCHAR)) AS title_no, CAST(c_nationkey AS BIGINT) AS ldt_loc_id,
 CASE o_orderstatus WHEN 'O' THEN 'LIVE' WHEN 'P' THEN 'REGD' ELSE 'HIST' END AS status,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'FHOL' WHEN '2' THEN 'LEHI' WHEN '3' THEN 'UNIT' WHEN '4' THEN 'ZZZZ' ELSE 'MORI' END AS type,
 CASE WHEN o_orderkey % 3 = 0 THEN 'FREE' ELSE 'LEAS' END AS register_type,
 CAST(o_orderdate AS DATE) AS issue_date,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS VARCHAR) ELSE 'GURT' END AS guarantee_status,
 CASE WHEN o_orderkey % 8 = 0 THEN 'Y' ELSE 'N' END AS provisional, CASE WHEN o_orderkey % 7 = 0 THEN 'Y' END AS maori_land,
 o_custkey % 50 AS ste_id, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey END AS sur_wrk_id,
 CASE WHEN o_orderkey % 10 = 3 THEN concat('T', CAST(o_orderkey + 1 AS VARCHAR)) END AS ttl_title_no_srs,
 CASE WHEN o_orderkey % 10 = 3 THEN concat('T', CAST(o_orderkey - 3 AS VARCHAR)) END AS ttl_title_no_head_srs
FROM orders JOIN customer ON o_custkey = c_custkey) x""",
    "title_estate": f"""SELECT *, {_CUR} FROM (
SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id,
 concat('T', CAST(l_orderkey AS VARCHAR)) AS ttl_title_no,
 min(CASE l_returnflag WHEN 'A' THEN 'FSIM' WHEN 'N' THEN 'LEAS' ELSE 'QQQQ' END) AS type,
 min(CASE l_linestatus WHEN 'O' THEN 'REGD' ELSE 'HIST' END) AS status,
 min(CASE WHEN l_linenumber % 2 = 0 THEN '1/2' END) AS share, l_orderkey AS lgd_id,
 CASE WHEN l_partkey % 10 = 0 THEN CAST(l_partkey % 52 + 1 AS VARCHAR) END AS timeshare_week_no,
 CASE l_partkey % 6 WHEN 0 THEN 'Road reserve' WHEN 1 THEN 'Recreation' END AS purpose,
 CASE WHEN l_suppkey % 5 = 0 THEN '21 years' END AS term, CASE WHEN l_partkey % 2 = 0 THEN 'Y' ELSE 'N' END AS original_flag
FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey) x""",
    "title_instrument": f"""SELECT *, {_CUR} FROM (
SELECT p_partkey AS id, concat('I', CAST(p_partkey AS VARCHAR)) AS inst_no, 'TINT' AS trt_grp,
 substr(p_type,1,4) AS trt_type, CASE WHEN p_size % 4 = 0 THEN 'HIST' ELSE 'REGD' END AS status,
 CASE WHEN p_size % 10 = 0 THEN CAST(NULL AS DATE) ELSE CAST(min(l_shipdate) AS DATE) END AS lodged_date,
 p_size AS priority_no, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 END AS tin_id_parent, p_partkey * 2 AS dlg_id,
 p_partkey % 25 AS ldt_loc_id
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_type, p_size) x""",
    "title_instrument_title": """SELECT DISTINCT l_partkey AS tin_id, concat('T', CAST(l_orderkey AS VARCHAR)) AS ttl_title_no
FROM lineitem""",
    "transaction_type": """SELECT DISTINCT 'TINT' AS grp, CASE WHEN p_type = 'SMALL' THEN 'none' ELSE substr(p_type,1,4) END AS type, p_type AS description
FROM part""",
    "title_document_reference": """SELECT p_partkey * 10 AS id, CASE WHEN p_partkey % 7 = 0 THEN p_partkey ELSE -p_partkey - 1 END AS tin_id, p_brand AS type, p_name AS reference
FROM part""",
    "title_encumbrance": f"""SELECT *, {_CUR} FROM (
SELECT DISTINCT l_orderkey * 100000 + l_suppkey AS id, CASE WHEN l_orderkey % 2 = 0 THEN concat('T', CAST(l_orderkey AS VARCHAR)) ELSE concat('X', CAST(l_orderkey AS VARCHAR)) END AS ttl_title_no,
 l_suppkey AS enc_id, CASE WHEN (l_orderkey + l_suppkey) % 3 = 0 THEN 'HIST' ELSE 'REGD' END AS status,
 l_suppkey * 7 AS act_tin_id_crt, CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey END AS act_id_crt
FROM lineitem) x""",
    "encumbrance": f"""SELECT *, {_CUR} FROM (
SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'HIST' ELSE 'REGD' END AS status,
 CASE WHEN s_suppkey % 2 = 0 THEN '99 years' END AS term
FROM supplier) x""",
    "encumbrance_share": f"""SELECT *, {_CUR} FROM (
SELECT s_suppkey * 10 + n AS id, s_suppkey AS enc_id,
 CASE WHEN n % 2 = 0 THEN 'REGD' ELSE 'HIST' END AS status
FROM supplier CROSS JOIN (VALUES (0), (1), (2)) AS share(n)) x""",
    "encumbrancee": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey ELSE -s_suppkey - 1 END AS ens_id, 'REGD' AS status, s_name AS name
FROM supplier""",
    "title_hierarchy": f"""SELECT *, {_CUR} FROM (
SELECT o_orderkey * 2 AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'HIST' ELSE 'CURR' END AS status,
 CASE WHEN o_orderkey > 0 THEN concat('T', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS VARCHAR)) END AS ttl_title_no_prior,
 concat('T', CAST(o_orderkey AS VARCHAR)) AS ttl_title_no_flw, o_orderkey * 3 AS tdr_id
FROM orders
UNION ALL SELECT o_orderkey * 2 + 1, 'CURR', concat('T', CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS VARCHAR)),
 concat('T', CAST(o_orderkey AS VARCHAR)), CAST(NULL AS BIGINT) FROM orders WHERE o_orderkey > 0 AND o_orderkey % 11 = 0) x""",
    "title_parcel_association": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN concat('T', CAST(o_orderkey AS VARCHAR)) ELSE concat('X', CAST(o_orderkey AS VARCHAR)) END AS ttl_title_no,
 o_custkey AS par_id, 'LINK' AS source
FROM orders""",
    "appellation": """SELECT c_custkey AS id, c_custkey AS par_id, CASE WHEN c_custkey % 5 = 0 THEN 'N' ELSE 'Y' END AS title_flag,
 CASE WHEN c_custkey % 6 = 0 THEN 'HIST' ELSE 'CURR' END AS status, 'LOT' AS parcel_type,
 CAST(c_custkey AS VARCHAR) AS parcel_value, concat('DP ', CAST(c_custkey % 97 AS VARCHAR)) AS appellation_value,
 CASE WHEN c_custkey % 9 = 0 THEN 'II' END AS block_number, CASE WHEN c_custkey % 2 = 0 THEN 'GNRL' ELSE 'OTHR' END AS type,
 CASE WHEN c_custkey % 3 = 0 THEN 'N' ELSE 'Y' END AS survey_flag,
 CASE WHEN c_custkey % 4 = 0 THEN 'PART' ELSE 'WHOL' END AS part_indicator,
 CASE WHEN c_custkey % 10 = 0 THEN 'UNIT' END AS second_parcel_type,
 CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 30 AS VARCHAR) END AS second_prcl_value,
 CASE WHEN c_custkey % 2 = 0 THEN 'DP' END AS sub_type, CASE WHEN c_custkey % 2 = 0 THEN 'PREFIX' END AS sub_type_position,
 CASE WHEN c_custkey % 25 = 0 THEN 'Te Ākau' END AS maori_name,
 CASE WHEN c_custkey % 50 = 0 THEN 'Y' ELSE 'N' END AS height_limited,
 CASE WHEN c_custkey % 2 = 1 THEN concat('Block ', CAST(c_custkey AS VARCHAR)) END AS other_appellation
FROM customer""",
    "legal_description": """SELECT o_orderkey AS id,
 CASE WHEN o_orderkey % 2 = 0 THEN concat('X', CAST(o_orderkey AS VARCHAR)) WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS VARCHAR) ELSE concat('T', CAST(o_orderkey AS VARCHAR)) END AS ttl_title_no,
 'FSIM' AS type, 'REGD' AS status, concat('Lot ', CAST(o_custkey AS VARCHAR)) AS legal_desc_text,
 CAST(o_totalprice AS DECIMAL(20,4)) AS total_area
FROM orders""",
    "legal_description_parcel": """SELECT o_orderkey AS lgd_id, o_custkey AS par_id, 1 AS sequence,
 CASE WHEN o_orderkey % 3 = 0 THEN 'PART' END AS part_affected, CASE WHEN o_orderkey % 4 = 0 THEN '1/2' END AS share,
 CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 END AS sur_wrk_id FROM orders""",
    "estate_share": f"""SELECT *, {_CUR} FROM (
SELECT id * 10 AS id, CASE WHEN id % 3 <> 0 THEN id ELSE -id - 1 END AS ett_id, status, '1/1' AS share,
 CASE WHEN id % 7 = 0 THEN 'EXEC' END AS executorship, CASE WHEN id % 11 = 0 THEN 'Memorial' END AS share_memorial FROM title_estate) x""",
    "proprietor": """SELECT es.id + c.c_custkey % 2 AS id, es.id AS ets_id,
 CASE WHEN es.id % 70 = 0 THEN CAST(NULL AS VARCHAR) ELSE es.status END AS status,
 CASE c.c_custkey % 3 WHEN 0 THEN 'CORP' WHEN 1 THEN 'INDV' ELSE 'OTHR' END AS type,
 c.c_name AS prime_surname, c.c_mktsegment AS prime_other_names,
 CASE WHEN c.c_custkey % 2 = 0 THEN 'JR' END AS name_suffix
FROM estate_share es JOIN title_estate te ON es.ett_id = te.id
 JOIN orders o ON te.ttl_title_no = concat('T', CAST(o.o_orderkey AS VARCHAR))
 JOIN customer c ON o.o_custkey = c.c_custkey""",
    "land_district": """SELECT CASE WHEN n_nationkey < 20 THEN CAST(n_nationkey AS BIGINT) ELSE -CAST(n_nationkey AS BIGINT) - 1 END AS ldt_loc_id, n_name AS name, substr(n_name, 1, 3) AS abbrev
FROM nation""",
    "address_point": """SELECT c_custkey AS address_id, c_custkey AS parcel_id,
 CASE WHEN c_custkey % 8 = 0 THEN 'Retired' ELSE 'Current' END AS status, 'Road' AS address_class,
 CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS primary_address,
 CASE WHEN c_custkey % 8 = 0 THEN 'Retired' ELSE 'Current' END AS address_lifecycle_stage,
 CASE WHEN c_custkey % 3 = 0 THEN 'CENT' END AS address_position_type,
 CASE WHEN c_custkey % 12 = 0 THEN 'ALT' END AS alternative_address_type, c_custkey * 4 AS addressable_object_id
FROM customer""",
    "address_reference": """SELECT o_orderkey AS address_reference_id, o_custkey AS address_id, 'Parcel' AS reference_object_type,
 CASE WHEN o_orderkey % 6 <> 0 THEN concat('Ref ', CAST(o_orderkey AS VARCHAR)) END AS reference_value
FROM orders""",
    "address_component": """SELECT c_custkey AS address_id, 'Address Number' AS component_type,
 CAST(c_custkey % 200 AS VARCHAR) AS component_value,
 CASE WHEN c_custkey % 17 = 0 THEN '20200101' ELSE '00000000' END AS end_lifecycle
FROM customer
UNION ALL SELECT c_custkey, 'Address Number Suffix', 'A', '' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'Address Number High', CAST(c_custkey % 200 + 4 AS VARCHAR), '' FROM customer WHERE c_custkey % 9 = 0
UNION ALL SELECT c_custkey, 'Road Name', CASE WHEN c_custkey % 5 = 0 THEN 'ĀHURI' ELSE c_mktsegment END, CAST(NULL AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'Road Type Name', 'ROAD', '0000-00-00' FROM customer
UNION ALL SELECT c_custkey, 'Unit Type', 'FLAT', '' FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, 'Unit Value', '2', '' FROM customer WHERE c_custkey % 22 = 0
UNION ALL SELECT c_custkey, 'Suburb/Locality Name', n_name, '' FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "system_code": system_code_sql_values(),
}

DEPENDS = {
    "estate_share": ["title_estate"],
    "proprietor": ["estate_share", "title_estate"],
}


def _resolve(names, out):
    for n in names:
        for d in DEPENDS.get(n, []):
            _resolve([d], out)
        if n not in out:
            out.append(n)
    return out


def with_views(body: str, *extra_ctes: tuple[str, str], views: list[str], recursive: bool = False) -> str:
    """``WITH [RECURSIVE] <views...>, <extra ctes...> <body>``."""
    order = _resolve(views, [])
    ctes = [f"{n} AS (\n{VIEWS[n]}\n)" for n in order]
    ctes += [f"{n} AS (\n{sql}\n)" for n, sql in extra_ctes]
    if not ctes:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body
