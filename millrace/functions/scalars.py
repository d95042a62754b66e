"""Scalar operators and functions, one query for each family or function."""

from __future__ import annotations

_D = "DATE '2020-01-31'"
_T = "CAST(TIMESTAMP '2021-03-14 15:09:26' AS TIMESTAMP)"
_TS = "TIMESTAMP_NTZ'2021-03-14 15:09:26'"
_A = "array(10, 20, 30)"
_J = """'{"a": {"b": [1, 2, {"c": "x"}]}, "n": 5, "s": "t"}'"""


def _one(spark: str, duck: str | None = None) -> tuple[str, str | None]:
    return f"SELECT {spark}", f"SELECT {duck}" if duck else None


QUERIES: dict[str, tuple[str, str | None]] = {
    "op_add": ("SELECT o_orderkey + o_custkey AS x FROM orders", None),
    "op_sub": ("SELECT o_orderkey - o_custkey AS x FROM orders", None),
    "op_mul": ("SELECT o_orderkey * o_custkey AS x FROM orders", None),
    "op_div": _one("-7 div 2 AS a, 7 div 2 AS b, CAST(9 AS BIGINT) div 3 AS c", "CAST(-7 // 2 AS BIGINT) AS a, CAST(7 // 2 AS BIGINT) AS b, CAST(9 // 3 AS BIGINT) AS c"),
    "op_mod": ("SELECT o_orderkey % 7 AS x, mod(o_custkey, 5) AS y FROM orders", None),
    "op_neg": ("SELECT -p_size AS x FROM part", None),
    "op_case": ("SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1050 THEN 'mid' END AS band FROM part", None),
    "op_cast": ("SELECT CAST(p_size AS STRING) AS t, CAST('42' AS INT) AS i, CAST(p_partkey AS INT) AS k FROM part", "SELECT CAST(p_size AS VARCHAR) AS t, CAST('42' AS INT) AS i, CAST(p_partkey AS INT) AS k FROM part"),
    "op_pgcast": ("SELECT p_partkey::bigint AS k, p_name::string AS n FROM part", "SELECT p_partkey::bigint AS k, p_name::varchar AS n FROM part"),
    "str_case": ("SELECT upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, initcap(p_name) AS i FROM part", "SELECT upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INT) AS n, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS i FROM part"),
    "str_cut": (
        "SELECT substr(p_name, 2, 3) AS s, left(p_name, 4) AS l, right(p_name, 2) AS r, concat(p_brand, '/', p_type) AS c, split_part(p_name, ' ', 2) AS w, split_part(p_name, ' ', 9) AS none FROM part", None
    ),
    "str_trim": _one("trim('  a b ') AS t, ltrim('  a ') AS l, rtrim(' a  ') AS r, reverse('abc') AS v, repeat('ab', 3) AS p"),
    "str_find": ("SELECT instr(p_name, 'e') AS i, position('i' IN p_name) AS p, instr(p_name, 'zz') AS none FROM part", "SELECT CAST(strpos(p_name, 'e') AS INT) AS i, CAST(position('i' IN p_name) AS INT) AS p, CAST(strpos(p_name, 'zz') AS INT) AS none FROM part"),
    "str_pad": _one("lpad('7', 3, '0') AS l, rpad('abc', 2, 'x') AS cut, rpad('a', 3, 'xy') AS r, ascii('A') AS a, chr(66) AS c"),
    "null_functions": _one("coalesce(CAST(NULL AS INT), 3) AS c, nullif(2, 2) AS n, nullif(2, 3) AS m, greatest(1, CAST(NULL AS INT), 5) AS g, least(4, CAST(NULL AS INT), 2) AS l"),
    "math_functions": _one("abs(-5) AS a, mod(17, 5) AS m, CAST(sign(-3) AS BIGINT) AS s", "abs(-5) AS a, mod(17, 5) AS m, CAST(sign(-3) AS BIGINT) AS s"),
    "date_part": (
        "SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(date_part('month', o_orderdate) AS BIGINT) AS m, CAST(date_part('day', o_orderdate) AS BIGINT) AS d, "
        "CAST(date_part('dow', o_orderdate) - 1 AS BIGINT) AS dow, CAST(date_part('doy', o_orderdate) AS BIGINT) AS doy FROM orders",
        "SELECT o_orderkey, date_part('year', o_orderdate) AS y, date_part('month', o_orderdate) AS m, date_part('day', o_orderdate) AS d, "
        "date_part('dow', o_orderdate) AS dow, date_part('doy', o_orderdate) AS doy FROM orders",
    ),
    "date_extract_time": _one(
        f"CAST(extract(hour FROM {_TS}) AS BIGINT) AS h, CAST(extract(minute FROM {_TS}) AS BIGINT) AS m, CAST(extract(second FROM {_TS}) AS BIGINT) AS s, CAST(unix_timestamp({_TS}) AS BIGINT) AS e",
        f"extract(hour FROM {_T}) AS h, extract(minute FROM {_T}) AS m, extract(second FROM {_T}) AS s, CAST(epoch({_T}) AS BIGINT) AS e",
    ),
    "date_trunc": (
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP_NTZ) AS y FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS y FROM orders",
    ),
    "interval_months": _one(
        f"{_D} + INTERVAL 1 MONTH AS up, {_D} - INTERVAL 2 MONTH AS down, add_months({_D}, 13) AS far",
        f"CAST({_D} + INTERVAL 1 MONTH AS DATE) AS up, CAST({_D} - INTERVAL 2 MONTH AS DATE) AS down, CAST({_D} + INTERVAL 13 MONTH AS DATE) AS far",
    ),
    "interval_seconds": _one(
        f"{_TS} + INTERVAL 90 MINUTE AS up, CAST({_D} AS TIMESTAMP_NTZ) + INTERVAL 5 SECOND AS s, CAST(unix_timestamp({_TS}) - unix_timestamp(TIMESTAMP_NTZ'2021-03-14 00:00:00') AS BIGINT) AS apart",
        f"{_T} + INTERVAL 90 MINUTE AS up, CAST({_D} AS TIMESTAMP) + INTERVAL 5 SECOND AS s, CAST(epoch({_T}) - epoch(TIMESTAMP '2021-03-14 00:00:00') AS BIGINT) AS apart",
    ),
    "time_wrap": _one("CAST(pmod(23 * 3600 + 7200, 86400) AS INT) AS late, CAST(pmod(1800 - 3600, 86400) AS INT) AS early", "CAST(3600 AS INT) AS late, CAST(84600 AS INT) AS early"),
    "array_subscript": _one(f"try_element_at({_A}, 1) AS first, try_element_at({_A}, 9) AS none", "10 AS first, CAST(NULL AS INT) AS none"),
    "array_functions": _one(
        f"size({_A}) AS n, cardinality({_A}) AS c, CAST(array_contains({_A}, 20) AS INT) AS has, array_position({_A}, 30) AS at, array_append({_A}, 40) AS more, concat({_A}, array(1)) AS cat",
        "CAST(len([10, 20, 30]) AS INT) AS n, 3 AS c, CAST(list_contains([10, 20, 30], 20) AS INT) AS has, CAST(list_position([10, 20, 30], 30) AS BIGINT) AS at, list_append([10, 20, 30], 40) AS more, list_concat([10, 20, 30], [1]) AS cat",
    ),
    "unnest": ("SELECT p_partkey, explode(split(p_name, ' ')) AS word FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "json_get": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.zz') AS none FROM events",
        "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.zz' AS none FROM events",
    ),
    "json_path": _one(
        f"get_json_object({_J}, '$.a.b[2].c') AS deep, get_json_object({_J}, '$.s') AS s, json_array_length(get_json_object({_J}, '$.a.b')) AS n",
        f"CAST({_J} AS JSON)->>'$.a.b[2].c' AS deep, CAST({_J} AS JSON)->>'$.s' AS s, CAST(json_array_length(CAST({_J} AS JSON), '$.a.b') AS INT) AS n",
    ),
    "session_functions": _one("current_catalog() IS NOT NULL AS c, current_schema() IS NOT NULL AS s, current_user() IS NOT NULL AS u, length(version()) > 0 AS v", "TRUE AS c, TRUE AS s, TRUE AS u, TRUE AS v"),
    "type_decimal": (
        "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS s, min(CAST(l_discount AS DECIMAL(4,2))) AS low FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS s, min(CAST(l_discount AS DECIMAL(4,2))) AS low FROM lineitem GROUP BY l_returnflag",
    ),
    "type_int128": (
        "SELECT sum(CAST(o_orderkey AS DECIMAL(38,0)) * CAST(100000000000000000 AS DECIMAL(20,0))) AS s FROM orders",
        "SELECT CAST(sum(CAST(o_orderkey AS HUGEINT) * 100000000000000000) AS DECIMAL(38,0)) AS s FROM orders",
    ),
    "type_enum": (
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE array_position(array('P', 'O', 'F'), o_orderstatus) < 3",
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE list_position(['P', 'O', 'F'], o_orderstatus) < 3",
    ),
    "type_real": _one("CAST('NaN' AS DOUBLE) = CAST('NaN' AS DOUBLE) AS same, CAST('NaN' AS DOUBLE) > CAST(1e308 AS DOUBLE) AS top, CAST(1 AS DOUBLE) + 2 AS three", "TRUE AS same, TRUE AS top, CAST(3 AS DOUBLE) AS three"),
}
