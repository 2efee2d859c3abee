"""The same queries as plain SQL, written from the definitions rather than the plans."""

from __future__ import annotations

PRIOR, CURRENT = 1996, 2000


def _wmean(x: str, w: str) -> str:
    """Mean of the known x; missing when one of them lacks its weight."""
    return (
        f"CASE WHEN count(*) FILTER (WHERE {x} IS NOT NULL AND {w} IS NULL) > 0 THEN NULL "
        f"ELSE sum({x} * {w}) FILTER (WHERE {w} <> 0) "
        f"/ nullif(sum({w}) FILTER (WHERE {x} IS NOT NULL), 0) END"
    )


def _wmean_strict(x: str, w: str) -> str:
    """Mean of x; missing when a weight is, or an x that has weight."""
    return (
        f"CASE WHEN count(*) FILTER (WHERE {w} IS NULL OR ({x} IS NULL AND {w} <> 0)) > 0 "
        f"THEN NULL ELSE sum({x} * {w}) FILTER (WHERE {w} <> 0) / nullif(sum({w}), 0) END"
    )


def _alloc(x: str, w: str) -> str:
    return f"coalesce(sum({x} * {w} / 100), 0)"


CROSSWALK = """
pairs AS (
  SELECT l_orderkey AS ord, l_suppkey AS sup, sum(l_quantity) AS qa,
         sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS qo
  FROM lineitem GROUP BY 1, 2),
cw AS (
  SELECT ord, sup,
         100 * qa / nullif(sum(qa) OVER (PARTITION BY ord), 0) AS all_s,
         100 * qa / nullif(sum(qa) OVER (PARTITION BY sup), 0) AS all_t,
         100 * qo / nullif(sum(qo) OVER (PARTITION BY ord), 0) AS open_s,
         100 * qo / nullif(sum(qo) OVER (PARTITION BY sup), 0) AS open_t
  FROM pairs)"""

ATTRIBUTES = """
attrs AS (
  SELECT o_orderkey AS okey,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS price,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 100e0 ELSE 0e0 END AS urgent,
         CASE WHEN o_orderstatus = 'F' THEN 100e0 ELSE 0e0 END AS finished,
         1e0 AS orders, o_totalprice / 1000 AS spend
  FROM orders)"""

ATTACHED = f"""{CROSSWALK}, {ATTRIBUTES},
attached AS (SELECT * FROM cw FULL JOIN attrs ON cw.ord = attrs.okey)"""

RETURNED_CASES = f"""{ATTRIBUTES},
pairs AS (
  SELECT l_orderkey AS o, l_partkey AS p, sum(l_quantity) AS q FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity > 25 AND extract(year FROM l_shipdate) = {PRIOR}
  GROUP BY 1, 2),
cw AS (
  SELECT o, p, 100 * q / sum(q) OVER (PARTITION BY o) AS q_s,
         100 * q / sum(q) OVER (PARTITION BY p) AS q_t FROM pairs),
reach(node, near) AS (
  SELECT DISTINCT o, o FROM pairs
  UNION SELECT r.node, b.o FROM reach r JOIN pairs a ON a.o = r.near JOIN pairs b ON b.p = a.p),
own AS (SELECT node AS o, min(near) AS root FROM reach GROUP BY 1),
got AS (SELECT DISTINCT p, root FROM pairs JOIN own USING (o)),
cases AS (
  SELECT root, count(DISTINCT o) AS sources, count(DISTINCT p) AS targets, min(p) AS first_part,
         CASE WHEN count(DISTINCT o) = 1 THEN CASE WHEN count(DISTINCT p) = 1 THEN 'unchanged' ELSE 'split' END
              ELSE CASE WHEN count(DISTINCT p) = 1 THEN 'merge' ELSE 'boundary' END END AS kind
  FROM pairs JOIN own USING (o) GROUP BY 1)"""


def _boundary_cases() -> str:
    rows = []
    for measure in ("urgent", "price"):
        rows.append(f"""SELECT root, '{measure}' AS measure, 'range' AS test,
       (SELECT min({measure}) FROM own JOIN attrs ON okey = o WHERE own.root = cases.root) AS before_low,
       (SELECT max({measure}) FROM own JOIN attrs ON okey = o WHERE own.root = cases.root) AS before_high,
       (SELECT min({measure}) FROM part_values v WHERE v.root = cases.root) AS after_low,
       (SELECT max({measure}) FROM part_values v WHERE v.root = cases.root) AS after_high FROM cases""")
    for measure in ("orders", "spend"):
        rows.append(f"""SELECT root, '{measure}', 'total',
       (SELECT sum({measure}) FROM own JOIN attrs ON okey = o WHERE own.root = cases.root) AS x,
       (SELECT sum({measure}) FROM own JOIN attrs ON okey = o WHERE own.root = cases.root),
       (SELECT sum({measure}) FROM part_values v WHERE v.root = cases.root),
       (SELECT sum({measure}) FROM part_values v WHERE v.root = cases.root) FROM cases""")
    union = " UNION ALL ".join(rows)
    figures = ", ".join(
        f"round({c}, 3) AS {c}" for c in ("before_low", "before_high", "after_low", "after_high")
    )
    return f"""WITH RECURSIVE {RETURNED_CASES},
part_values AS (
  SELECT p, root, {_wmean('urgent', 'q_t')} AS urgent, {_wmean('price', 'q_t')} AS price,
         {_alloc('orders', 'q_s')} AS orders, {_alloc('spend', 'q_s')} AS spend
  FROM cw JOIN got USING (p) JOIN attrs ON okey = o GROUP BY 1, 2),
rows AS ({union})
SELECT root AS first_order, first_part, kind, sources, targets, measure, test, {figures},
       after_low >= before_low - 1e-4 AND after_high <= before_high + 1e-4 AS passed
FROM rows JOIN cases USING (root)"""


INTERPOLATED = f"""{ATTACHED},
interp AS (
  SELECT sup,
         {_wmean('price', 'all_t')} AS price10, {_wmean('urgent', 'all_t')} AS urgent10,
         {_alloc('orders', 'all_s')} AS orders10, {_alloc('spend', 'all_s')} AS spend10,
         {_wmean('(price * 1.1e0)', 'open_t')} AS price18,
         {_wmean('urgent', 'open_t')} AS urgent18,
         {_wmean('finished', 'open_t')} AS finished,
         {_alloc('orders', 'open_s')} AS orders18,
         {_alloc('(spend * 1.1e0)', 'open_s')} AS spend18
  FROM attached GROUP BY sup)"""


def _shares(name: str, key: str, year: int) -> str:
    flags = ", ".join(
        f"100 * sum(CASE WHEN l_returnflag = '{f}' THEN l_quantity ELSE 0 END)"
        f" / nullif(sum(l_quantity), 0) AS {f}"
        for f in "ANR"
    )
    return (
        f"{name} AS (SELECT {key}, {flags} FROM lineitem "
        f"WHERE extract(year FROM l_shipdate) = {year} GROUP BY 1)"
    )


def _class(suffix: str) -> str:
    branches = " ".join(f"WHEN {f}{suffix} > 35 THEN '{f}'" for f in "RAN")
    return f"CASE {branches} ELSE 'none' END AS class{suffix}"


SUPPLIERS = f"""
{_shares('s10', 'l_suppkey', PRIOR)}, {_shares('s18', 'l_suppkey', CURRENT)},
sups AS (
  SELECT s_suppkey AS supplier, s_name AS name,
         lpad(s_nationkey::VARCHAR, 2, '0') || lpad(s_suppkey::VARCHAR, 9, '0') AS unit
  FROM supplier),
aligned AS (
  SELECT supplier, unit, name, s18.R AS rate18, s18.A AS A18, s18.N AS N18, s18.R AS R18,
         s10.R AS rate10, s10.A AS A10, s10.N AS N10, s10.R AS R10,
         s18.R - s10.R AS dif
  FROM sups JOIN s18 ON supplier = s18.l_suppkey JOIN s10 ON supplier = s10.l_suppkey),
classed AS (SELECT *, {_class('10')}, {_class('18')} FROM aligned)"""

GROUPS = """
lookup AS (
  SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS nation_code, n_nationkey AS group_id,
         n_name AS grp FROM nation
  UNION ALL
  SELECT lpad(n_nationkey::VARCHAR, 2, '0'), n_nationkey, 'FOCUS'
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
peers AS (
  SELECT c_nationkey, count(*) AS customers FROM customer
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"""

FINAL = f"""{INTERPOLATED}, {SUPPLIERS},
final AS (
  SELECT coalesce(sup, supplier) AS supplier, price10, urgent10, orders10, spend10,
         price18, urgent18, finished, orders18, spend18,
         unit, name, rate18, A18, N18, R18, rate10, A10, N10, R10, dif,
         coalesce(class10, 'none') AS class10, coalesce(class18, 'none') AS class18
  FROM (SELECT * FROM interp WHERE sup IS NOT NULL) i
  FULL JOIN classed ON sup = supplier)"""


def _period(name: str, rate: str, weight: str, label: str, dedupe: bool) -> str:
    kept = f"{rate} IS NOT NULL AND {weight} IS NOT NULL"
    measures = f"{_wmean_strict(rate, weight)} AS m, count(*) AS n"
    if not dedupe:
        return f"""
{name} AS (
  SELECT CASE WHEN grouping({label}) = 1 THEN 'all' ELSE {label} END AS class,
         CASE WHEN grouping(grp) = 1 THEN 'all' ELSE grp END AS "group", {measures}
  FROM members WHERE {kept} GROUP BY CUBE ({label}, grp))"""
    return f"""
{name} AS (
  SELECT CASE WHEN grouping({label}) = 1 THEN 'all' ELSE {label} END AS class,
         grp AS "group", {measures}
  FROM members WHERE {kept} GROUP BY GROUPING SETS (({label}, grp), (grp))
  UNION ALL
  SELECT CASE WHEN grouping({label}) = 1 THEN 'all' ELSE {label} END, 'all', {measures}
  FROM (SELECT DISTINCT supplier, {label}, {rate}, {weight} FROM members WHERE {kept}) t
  GROUP BY ROLLUP ({label}))"""


def _comparison(dedupe: bool = False) -> str:
    return f"""{FINAL}, {GROUPS},
members AS (
  SELECT final.*, grp FROM final JOIN lookup ON substr(unit, 1, 2) = nation_code
  WHERE group_id IN (SELECT c_nationkey FROM peers)),
{_period('p10', 'rate10', 'orders10', 'class10', dedupe)},
{_period('p18', 'rate18', 'orders18', 'class18', dedupe)},
comparison AS (
  SELECT p10.class, p10."group", p10.m AS prior, p18.m AS current,
         p18.m - p10.m AS difference, p10.n AS n_prior, p18.n AS n_current
  FROM p10 LEFT JOIN p18 ON p10.class = p18.class AND p10."group" = p18."group")"""


COMPARISON = _comparison()
UNKNOWN = COMPARISON.replace(
    "SELECT final.*, grp FROM final",
    "SELECT final.* REPLACE (CASE WHEN supplier % 7 <> 0 THEN rate10 END AS rate10, "
    "CASE WHEN supplier % 5 <> 0 THEN orders18 END AS orders18), grp FROM final",
)


def _rounded(names: str, digits: int = 6, money: int = 2) -> str:
    places = {n: money if n.startswith(("price", "spend")) else digits for n in names.split()}
    return ", ".join(f"round({n}, {d}) AS {n}" for n, d in places.items())


SHOWN = (
    f"class, \"group\", {_rounded('prior current difference')}, n_prior, "
    "n_current::DOUBLE AS n_current"
)

FACTS = """
facts AS (
  SELECT lpad(s_nationkey::VARCHAR, 2, '0') || lpad(s_suppkey::VARCHAR, 9, '0') AS GEOID,
         s_name AS NAME, l_returnflag AS flag, sum(l_quantity) AS e, sum(l_discount) AS m
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
wide AS (
  SELECT GEOID, NAME, max(e) FILTER (WHERE flag = 'A') AS AE, max(m) FILTER (WHERE flag = 'A') AS AM,
         max(e) FILTER (WHERE flag = 'N') AS NE, max(m) FILTER (WHERE flag = 'N') AS NM,
         max(e) FILTER (WHERE flag = 'R') AS RE, max(m) FILTER (WHERE flag = 'R') AS RM
  FROM facts GROUP BY 1, 2)"""

PARTS = f"""
{_shares('p10', 'l_partkey', PRIOR)}, {_shares('p18', 'l_partkey', CURRENT)},
named10 AS (SELECT l_partkey, '1400000US' || lpad(l_partkey::VARCHAR, 11, '0') AS full_id,
            p_name AS name, R AS rate10 FROM p10 JOIN part ON l_partkey = p_partkey),
named18 AS (SELECT '1400000US' || lpad(l_partkey::VARCHAR, 11, '0') AS full_id,
            p_name AS name, R AS rate18 FROM p18 JOIN part ON l_partkey = p_partkey),
vintages AS (
  SELECT full_id, name, rate18, rate10, rate18 - rate10 AS dif
  FROM named18 FULL JOIN named10 USING (full_id, name))"""


def _supplier_year(name: str, year: int) -> str:
    return f"""
{name} AS (
  SELECT lpad(s_nationkey::VARCHAR, 2, '0') AS code, l_suppkey,
         greatest(max(s_acctbal), 0) AS balance, sum(l_quantity) AS quantity,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE extract(year FROM l_shipdate) = {year} GROUP BY 1, 2),
{name}_nation AS (
  SELECT code, 100 * sum(returned) / nullif(sum(quantity), 0) AS rate FROM {name} GROUP BY 1)"""


NATIONS = f"""
{_supplier_year('y1996', 1996)}, {_supplier_year('y1999', 1999)}, {_supplier_year('y2000', 2000)},
weights AS (
  SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS code, count(*)::DOUBLE AS w10,
         sum(greatest(c_acctbal, 0)) AS w18
  FROM customer GROUP BY 1),
alternative AS (
  SELECT lpad(s_nationkey::VARCHAR, 2, '0') AS code, count(*)::DOUBLE AS w10alt,
         sum(greatest(s_acctbal, 0)) AS w18alt
  FROM supplier GROUP BY 1),
frame AS (
  SELECT code, w10, w18, y2000_nation.rate AS rate18, y1996_nation.rate AS rate10,
         y1999_nation.rate AS rate_snapshot, w18alt, w10alt
  FROM weights
  FULL JOIN (y2000_nation FULL JOIN y1996_nation USING (code)) USING (code)
  LEFT JOIN alternative USING (code)
  LEFT JOIN y1999_nation USING (code))"""

BY_ORDER = f"""
by_order AS (
  SELECT ord, {_wmean('s_acctbal', 'all_s')} AS got, min(s_acctbal) AS want
  FROM cw JOIN supplier ON sup = s_suppkey GROUP BY ord
  HAVING min(sup) = max(sup))"""


def _verdict_counts(case: str, measure: str, rows: str, got: str, want: str, tolerance: str) -> str:
    passed = f"abs({got} - {want}) <= {tolerance}"
    return (
        f"SELECT '{case}' AS \"case\", '{measure}' AS measure, count(*) AS units, "
        f"count(*) FILTER (WHERE {passed}) AS passed, "
        f"count(*) FILTER (WHERE NOT ({passed})) AS failed, "
        f"count(*) FILTER (WHERE ({passed}) IS NULL) AS unknown FROM {rows}"
    )


def _strict(x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN coalesce(sum({x}), 0) END"


def _case_checks() -> str:
    got = {
        "price": _wmean("price", "all_t"),
        "urgent": _wmean("urgent", "all_t"),
        "amount": _wmean("amount", "all_t"),
        "orders": _alloc("orders", "all_s"),
        "spend": _alloc("spend", "all_s"),
    }
    weights = {"price": "all_t", "urgent": "all_t", "amount": "all_t", "orders": "all_s", "spend": "all_s"}
    targets = ", ".join(
        f"{got[m]} AS got_{m}, CASE WHEN sup IS NOT NULL THEN {_strict(f'({m} * {w} / 100)')} END AS want_{m}"
        for m, w in weights.items()
    )
    parts = [
        _verdict_counts(
            "averaged" if w == "all_t" else "allocated", m, "targets", f"got_{m}", f"want_{m}", "1e-4"
        )
        for m, w in weights.items()
    ]
    parts += [
        _verdict_counts("split", m, "sources", f"{m} * share / 100", m, "1e-4")
        for m in ("orders", "spend")
    ]
    parts.append(_verdict_counts("inherited", "s_acctbal", "by_order", "got", "want", "1e-9"))
    return f"""WITH {ATTACHED}, {BY_ORDER},
targets AS (SELECT sup, {targets} FROM (SELECT *, spend AS amount FROM attached) t GROUP BY sup),
sources AS (
  SELECT share, orders, spend
  FROM (SELECT ord, {_strict('all_s')} AS share FROM cw GROUP BY ord) s
  LEFT JOIN attrs ON ord = okey)
{' UNION ALL '.join(parts)}"""


FOCUS_SUPPLIERS = """SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"""


def _closed_cases() -> str:
    every, here = "SELECT s_suppkey FROM supplier", FOCUS_SUPPLIERS
    lines, theirs = "SELECT ord FROM cw", f"SELECT ord FROM cw WHERE sup IN ({FOCUS_SUPPLIERS})"
    parts = []
    for case, to, of, measure in (
        ("closed", "SELECT sup FROM cw", lines, "orders"),
        ("closed by list", every, lines, "orders"),
        ("one region", here, theirs, "spend"),
        ("unknown price", every, theirs, "price"),
        ("mistyped", "SELECT -1", theirs, "orders"),
    ):
        parts.append(f"""SELECT '{case}' AS "case", '{measure}' AS measure,
       (SELECT sum({measure}) FROM got WHERE sup IN ({to})) AS interpolated,
       (SELECT CASE WHEN count(*) = count({measure}) THEN sum({measure}) END FROM attrs WHERE okey IN ({of})) AS recomputed,
       (SELECT count(*) FROM got WHERE sup IN ({to})) AS targets_found,
       (SELECT count(*) FROM attrs WHERE okey IN ({of})) AS sources_found""")
    measures = ", ".join(f"{_alloc(m, 'all_s')} AS {m}" for m in ("orders", "spend", "price"))
    return f"""WITH {ATTACHED},
got AS (SELECT sup, {measures} FROM attached WHERE sup IS NOT NULL GROUP BY sup),
rows AS ({' UNION ALL '.join(parts)})
SELECT "case", measure, round(interpolated, 3) AS interpolated, round(recomputed, 3) AS recomputed,
       targets_found, sources_found, abs(interpolated - recomputed) <= 1e-4 AS passed FROM rows"""


def _chosen_targets() -> str:
    got, want = _alloc("orders", "all_s"), _strict("(orders * all_s / 100)")
    kept = f"sup IN ({FOCUS_SUPPLIERS})"
    split = _verdict_counts("split", "orders", "sources", "orders * share / 100", "orders", "1e-4")
    return f"""WITH {ATTACHED},
targets AS (SELECT sup, {got} AS got, {want} AS want FROM attached WHERE {kept} GROUP BY sup),
sources AS (
  SELECT share, orders FROM (SELECT ord, {_strict('all_s')} AS share FROM cw GROUP BY ord) s
  LEFT JOIN attrs ON ord = okey WHERE ord IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))
{_verdict_counts('allocated', 'orders', 'targets', 'got', 'want', '1e-4')} UNION ALL {split}"""


FRAME_COLUMNS = ["price10", "urgent18", "finished", "orders10", "spend18"]


def _frame_equality() -> str:
    matches = {
        c: f"count(*) FILTER (WHERE f.sup IS NOT NULL AND l.sup IS NOT NULL "
        f"AND (f.{c} IS NOT DISTINCT FROM l.{c} OR abs(f.{c} - l.{c}) <= 1e-6 * greatest(abs(f.{c}), 1)))"
        for c in FRAME_COLUMNS
    }
    listed = ", ".join(f"{m} AS match_{c}" for c, m in matches.items())
    least = f"least({', '.join(matches.values())})"
    in_scope = """(SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"""
    aggregates = INTERPOLATED[INTERPOLATED.index("interp AS") :]
    scoped = aggregates.replace("interp AS", "f AS").replace(
        "FROM attached", f"FROM attached WHERE sup IN {in_scope}"
    )
    return f"""WITH {INTERPOLATED}, {scoped},
l AS (SELECT * FROM interp WHERE sup IN {in_scope})
SELECT count(*) AS n_rows, {listed}, {least} AS min_matches, {least} = count(*) AS equal
FROM f FULL JOIN l ON f.sup = l.sup"""


SUPPLIER_CODES = """
codes AS (
  SELECT s_suppkey, s_name, lpad(s_nationkey::VARCHAR, 2, '0') AS state,
         lpad(s_nationkey::VARCHAR, 2, '0') || lpad(s_suppkey::VARCHAR, 9, '0') AS code,
         s_acctbal FROM supplier)"""

# Rows landed in files, read back and put through a reader: what they say, without files.
LANDED = {
    "read_rates": f"""WITH {SUPPLIER_CODES}
SELECT f AS format, '1400000US' || code AS GEO_ID, s_name AS NAME, state, s_acctbal::VARCHAR AS CRRALL
FROM codes, (VALUES ('json'), ('csv')) formats(f) WHERE state IN ('03', '04')""",
    "read_crosswalk": f"""WITH {CROSSWALK}
SELECT lpad((1000 + sup)::VARCHAR, 11, '0') AS GEOID10, lpad(ord::VARCHAR, 11, '0') AS GEOID20,
       lpad((sup % 7)::VARCHAR, 2, '0') AS STATEFP10, lpad((sup % 11)::VARCHAR, 3, '0') AS COUNTYFP10,
       round(all_s, 6) AS HU10PCT_T10, round(all_t, 6) AS HU10PCT_T20
FROM cw WHERE sup % 7 = 3 AND sup % 11 IN (2, 5)""",
    "read_group_lookup": """
SELECT n_nationkey::VARCHAR AS MSA_GEOID, r_name AS MSA, lpad(n_nationkey::VARCHAR, 5, '0') AS County_GEOID,
       n_name AS county_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "read_place_list": f"""WITH {SUPPLIER_CODES}
SELECT code, s_name FROM codes WHERE s_acctbal > 5000""",
    "read_snapshot": f"""WITH {SUPPLIER_CODES}
SELECT state, substr(code, 3) AS county, s_acctbal AS CRRALL FROM codes""",
    "other_geographies": f"""WITH {SUPPLIER_CODES},
both_levels AS (
  SELECT 'county' AS geography, code, s_name AS name, state, floor(s_acctbal) AS x FROM codes
  UNION ALL
  SELECT 'place', lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 9, '0'), c_name,
         lpad(c_nationkey::VARCHAR, 2, '0'), floor(c_acctbal) FROM customer)
SELECT geography, code AS GEOID, name AS NAME, round(x, 6) AS white, round(x / 2, 6) AS black,
       round(100 - x - x / 2, 1) AS other, round(100 - x, 1) AS nonwh
FROM both_levels WHERE state IN ('01', '05', '09')""",
    "one_sided_presence": f"""WITH {PARTS}
SELECT full_id, round(rate18, 6) AS rate18 FROM vintages WHERE rate10 IS NULL AND rate18 IS NOT NULL""",
    "landed_again": """
WITH f AS (
  SELECT extract(year FROM l_shipdate)::INTEGER AS year, lpad(s_nationkey::VARCHAR, 2, '0') AS state,
         l_suppkey, l_returnflag, sum(l_quantity) AS estimate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4),
p AS (SELECT DISTINCT year, state FROM f)
SELECT year, state, 'landing 1' AS step, NULL::DOUBLE AS units, NULL::DOUBLE AS total FROM p WHERE year < 2000
UNION ALL SELECT year, state, 'landing 2', NULL, NULL FROM p WHERE year >= 2000
UNION ALL SELECT year, state, 'landing 4', NULL, NULL FROM p WHERE year = 1997 AND state = '03'
UNION ALL SELECT year, state, 'read', count(*), sum(CASE WHEN year = 1997 AND state = '03' THEN -1 ELSE estimate END)
FROM f GROUP BY 1, 2""",
    "peer_facts": f"""WITH {GROUPS}
SELECT lpad(s_nationkey::VARCHAR, 2, '0') || lpad(s_suppkey::VARCHAR, 9, '0') AS GEOID, s_name AS NAME,
       {", ".join(f"round(sum({c}) FILTER (WHERE l_returnflag = '{f}'), {d}) AS {f}{t}" for f in "ANR" for c, t, d in (("l_quantity", "E", 4), ("l_discount", "M", 2)))}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN peers ON c_nationkey = s_nationkey
WHERE extract(year FROM l_shipdate) = 2000 GROUP BY 1, 2""",
    "landed_rates": f"""WITH {SUPPLIER_CODES}
SELECT '0500000US' || code AS GEO_ID, s_name AS NAME, state, substr(code, 3) AS county,
       CASE WHEN state = '03' THEN '99.5' ELSE s_acctbal::VARCHAR END AS CRRALL,
       NULL::VARCHAR AS CRRINT, '2020-08-19' AS RESP_DATE
FROM codes WHERE state IN ('03', '05', '11')""",
    "chosen_targets": _chosen_targets(),
    "ascending_report": f"""WITH {COMPARISON},
r AS (
  SELECT "group" AS "Nation", max(difference / 100) FILTER (WHERE class = 'all') AS o,
         max(difference / 100) FILTER (WHERE class = 'R') AS r
  FROM comparison WHERE class IN ('all', 'R') AND "group" NOT IN ('all', 'FOCUS') GROUP BY 1)
SELECT row_number() OVER (ORDER BY o NULLS LAST, "Nation") AS row_id, "Nation",
       round(o, 6) AS "Overall Change", round(r, 6) AS "Returned Change" FROM r""",
    "state_codes": """
SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS code, n_name AS name FROM nation
WHERE n_nationkey IN (1, 2, 4, 5, 6, 8, 9, 10, 11, 12, 13, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL text per query."""
    return {
        "widen_variables": f"WITH {FACTS} SELECT GEOID, NAME, {_rounded('AE AM NE NM RE RM')} FROM wide",
        "clean_demographics": f"""WITH {FACTS},
p AS (SELECT GEOID, NAME, round(100 * AE / (AE + NE + RE), 3) AS white,
             round(100 * NE / (AE + NE + RE), 3) AS black,
             round(100 * RE / (AE + NE + RE), 3) AS hispa FROM wide)
SELECT GEOID, substr(GEOID, 1, 2) AS state, substr(GEOID, 3, 3) AS county,
       substr(GEOID, 6) AS tract, NAME, white, black, hispa,
       round(100 - hispa - black, 1) AS other, round(100 - white, 1) AS nonwh FROM p""",
        "normalize_codes": """
SELECT c_custkey, CASE WHEN c_nationkey > 1 THEN lpad(c_custkey::VARCHAR, 11, '0') END AS code,
       CASE WHEN c_nationkey > 1 AND c_custkey < 100 THEN lpad(c_custkey::VARCHAR, 2, '0') END AS short_code
FROM customer""",
        "split_code": """
SELECT code, substr(code, 1, 2) AS state, substr(code, 3, 3) AS county,
       substr(code, 6) AS tract, substr(code, 1, 5) AS first_five
FROM (SELECT lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 9, '0') AS code
      FROM customer) t""",
        "strip_labels": """
SELECT lpad(p_partkey::VARCHAR, 11, '0') AS code, p_name AS label FROM part""",
        "cast_numbers": """
SELECT p_partkey, p_size::DOUBLE AS size, TRY_CAST(p_name AS DOUBLE) AS not_a_number,
       p_retailprice AS price, NULL::DOUBLE AS suffixed FROM part""",
        "scope_filter": """
SELECT c_name AS name, '0500000US' AS prefix, lpad(c_nationkey::VARCHAR, 2, '0') AS state,
       lpad(c_custkey::VARCHAR, 9, '0') AS rest
FROM customer WHERE c_nationkey IN (2, 6, 11, 17, 21)""",
        "residual_share": f"""WITH {_shares('s', 'l_suppkey', PRIOR)}
SELECT l_suppkey, round(100 - A - N, 1) AS other, round(100 - A, 1) AS not_a FROM s""",
        "weighted_means": f"""
WITH t AS (
  SELECT o_orderpriority, o_orderstatus,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS x,
         CASE WHEN o_orderstatus <> 'P' THEN (length(o_orderpriority) - 5)::DOUBLE END AS w
  FROM orders)
SELECT o_orderpriority, o_orderstatus, round({_wmean('x', 'w')}, 4) AS mean_lenient,
       round({_wmean_strict('x', 'w')}, 4) AS mean_strict, count(*) AS n
FROM t GROUP BY 1, 2""",
        "strict_sums": f"""WITH {ATTRIBUTES}
SELECT finished > 0 AS is_finished, urgent,
       round({_strict('price')}, 2) AS sum_strict, round(coalesce(sum(price), 0), 2) AS sum_lenient,
       round(sum(spend), 2) AS spend
FROM attrs GROUP BY 1, 2""",
        "build_crosswalk": f"""WITH {CROSSWALK}
SELECT ord AS "order", sup AS supplier, {_rounded('all_s all_t open_s open_t')} FROM cw""",
        "attach_attributes": f"""WITH {ATTACHED}
SELECT coalesce(ord, okey) AS "order", sup::VARCHAR AS supplier,
       {_rounded('all_s all_t open_s open_t price urgent finished orders spend', money=6)} FROM attached""",
        "interpolate_means": f"""WITH {INTERPOLATED}
SELECT sup::VARCHAR AS supplier, round(price10, 2) AS price, round(urgent10, 6) AS urgent FROM interp""",
        "interpolate_counts": f"""WITH {INTERPOLATED}
SELECT sup::VARCHAR AS supplier, round(orders10, 6) AS orders, round(spend10, 2) AS spend FROM interp""",
        "areal_interpolate": f"""WITH {INTERPOLATED}
SELECT sup::VARCHAR AS supplier, {_rounded('price10 urgent10 orders10 spend10 price18 urgent18 finished orders18 spend18')}
FROM interp""",
        "interpolate_exact": f"""WITH {INTERPOLATED}
SELECT sup::VARCHAR AS supplier, {_rounded('price10 urgent10 orders10 spend10 price18 urgent18 finished orders18 spend18')}
FROM interp""",
        "tied_row_index": """
WITH n AS (SELECT l_returnflag, count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS lines FROM lineitem GROUP BY 1)
SELECT l_returnflag, (sum(n) OVER (ORDER BY l_returnflag) - n + 1)::BIGINT AS first,
       (sum(n) OVER (ORDER BY l_returnflag))::BIGINT AS last, n, n AS numbers, lines FROM n""",
        "interpolate_landed": f"""WITH {INTERPOLATED}
SELECT sup::VARCHAR AS supplier, {_rounded('price10 urgent10 orders10 spend10 price18 urgent18 finished orders18 spend18')},
       NULL AS "order", NULL AS daily, NULL AS day FROM interp
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ord::VARCHAR,
       round({_wmean('(s_acctbal / 7)', 'all_s')}, 9), round(sum(1e0 / 7 * all_t / 100), 9)
FROM cw JOIN supplier ON sup = s_suppkey GROUP BY ord""",
        "align_vintages": f"""WITH {PARTS}
SELECT full_id, name, {_rounded('rate18 rate10 dif')}, substr(full_id, 10) AS code
FROM vintages WHERE rate18 IS NOT NULL AND rate10 IS NOT NULL""",
        "missing_report": f"""WITH {PARTS}
SELECT count(*) AS units, count(*) FILTER (WHERE rate10 IS NULL) AS missing_rate10,
       count(*) FILTER (WHERE rate18 IS NULL) AS missing_rate18,
       count(*) FILTER (WHERE rate10 IS NULL OR rate18 IS NULL) AS missing_any,
       count(*) FILTER (WHERE rate10 IS NULL AND rate18 IS NULL) AS missing_all
FROM vintages""",
        "enrich_left": f"""WITH {PARTS}
SELECT full_id, name, {_rounded('rate18 rate10 dif')}, p_size, p_retailprice
FROM vintages LEFT JOIN part
  ON full_id = '1400000US' || lpad(p_partkey::VARCHAR, 11, '0') AND name = p_name
WHERE rate18 IS NOT NULL AND rate10 IS NOT NULL""",
        "suffix_join": f"""
WITH {_shares('s10', 'l_suppkey', PRIOR)}, {_shares('s18', 'l_suppkey', CURRENT)}
SELECT s10.l_suppkey, round(s10.A, 6) AS A10, round(s10.N, 6) AS N10, round(s10.R, 6) AS R10,
       round(s18.A, 6) AS A18, round(s18.N, 6) AS N18, round(s18.R, 6) AS R18
FROM s10 LEFT JOIN s18 ON s10.l_suppkey = s18.l_suppkey""",
        "majority_class": f"""WITH {SUPPLIERS}
SELECT supplier, unit, name, class10, class18 FROM classed""",
        "final_units": f"""WITH {FINAL}
SELECT supplier, {_rounded('price10 urgent10 orders10 spend10 price18 urgent18 finished orders18 spend18')},
       unit, name, {_rounded('rate18 A18 N18 R18 rate10 A10 N10 R10 dif')}, class10, class18
FROM final""",
        "top_groups": f"WITH {GROUPS} SELECT c_nationkey, customers FROM peers",
        "assign_groups": f"""WITH {SUPPLIERS}, {GROUPS}
SELECT supplier, unit, name, substr(unit, 1, 2) AS prefix, group_id, grp
FROM sups LEFT JOIN lookup ON substr(unit, 1, 2) = nation_code""",
        "restrict_groups": f"""WITH {SUPPLIERS}, {GROUPS}
SELECT supplier, unit, name, substr(unit, 1, 2) AS prefix, group_id, grp
FROM sups LEFT JOIN lookup ON substr(unit, 1, 2) = nation_code
WHERE group_id IN (SELECT c_nationkey FROM peers)""",
        "focus_group": f"""WITH {SUPPLIERS}, {GROUPS}
SELECT supplier, unit, name, substr(unit, 1, 2) AS prefix, group_id, grp
FROM sups LEFT JOIN lookup ON substr(unit, 1, 2) = nation_code
WHERE group_id IN (SELECT c_nationkey FROM peers) AND grp = 'FOCUS'""",
        "totals_cube": f"""WITH {SUPPLIERS}, {GROUPS}
SELECT CASE WHEN grouping(class10) = 1 THEN 'all' ELSE class10 END AS class10,
       CASE WHEN grouping(grp) = 1 THEN 'all' ELSE grp END AS grp,
       round({_wmean('rate10', 'A10')}, 6) AS mean_rate, count(*) AS n
FROM classed JOIN lookup ON substr(unit, 1, 2) = nation_code
WHERE group_id IN (SELECT c_nationkey FROM peers)
GROUP BY CUBE (class10, grp)""",
        "compare_periods": f"WITH {COMPARISON} SELECT {SHOWN} FROM comparison",
        "compare_dedupe": f"WITH {_comparison(dedupe=True)} SELECT {SHOWN} FROM comparison",
        "class_view": f"WITH {COMPARISON} SELECT {SHOWN} FROM comparison WHERE class = 'none'",
        "chart_frame": f"""WITH {COMPARISON}
SELECT {SHOWN}, CASE class WHEN 'all' THEN 'Overall Difference'
       ELSE 'Difference in Majority-Returned Suppliers' END AS legend
FROM comparison WHERE class IN ('all', 'R') AND "group" <> 'all' AND difference IS NOT NULL""",
        "pivoted_report": f"""WITH {COMPARISON}
SELECT "group" AS "Nation",
       round(max(difference / 100) FILTER (WHERE class = 'all'), 6) AS "Overall Change",
       round(max(difference / 100) FILTER (WHERE class = 'R'), 6) AS "Returned Change",
       round(max(difference / 100) FILTER (WHERE class = 'N'), 6) AS "New Change",
       round(max(difference / 100) FILTER (WHERE class = 'none'), 6) AS "Other Change"
FROM comparison WHERE class IN ('all', 'R', 'N', 'none') AND "group" NOT IN ('all', 'FOCUS')
GROUP BY 1""",
        "ranked_report": f"""WITH {COMPARISON}
SELECT row_number() OVER (ORDER BY prior DESC NULLS LAST) AS row_id,
       CASE class WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted'
            WHEN 'none' THEN 'No Majority' END AS "Majority Flag",
       round(prior / 100, 6) AS "1996 Rate", round(current / 100, 6) AS "2000 Rate",
       n_prior AS "Suppliers in 1996", n_current::DOUBLE AS "Suppliers in 2000"
FROM comparison WHERE "group" = 'FOCUS' AND class <> 'all'""",
        "partition_union": """
SELECT c_name AS name, lpad(c_nationkey::VARCHAR, 2, '0') AS code, c_mktsegment AS segment,
       c_acctbal AS balance FROM customer
UNION ALL
SELECT s_name, lpad(s_nationkey::VARCHAR, 2, '0'), NULL, s_acctbal FROM supplier""",
        "first_codes": """
SELECT DISTINCT lpad(c_nationkey::VARCHAR, 2, '0') AS code FROM customer ORDER BY 1 LIMIT 12""",
        "regional_rollup": f"""WITH {NATIONS}
SELECT round({_wmean_strict('rate18', 'w18')}, 6) AS current,
       round({_wmean_strict('rate18', 'w18alt')}, 6) AS current_alt,
       round({_wmean_strict('rate_snapshot', 'w18')}, 6) AS snapshot,
       round({_wmean_strict('rate10', 'w10')}, 6) AS prior,
       round({_wmean_strict('rate10', 'w10alt')}, 6) AS prior_alt
FROM frame""",
        "discrepancy": f"""WITH {_supplier_year('y1996', PRIOR)},
rates AS (SELECT code, balance, 100 * returned / nullif(quantity, 0) AS rate FROM y1996)
SELECT r.code, round(m, 6) AS unit_mean, round(y1996_nation.rate, 6) AS rate10, n_name AS name
FROM (SELECT code, {_wmean_strict('rate', 'balance')} AS m FROM rates GROUP BY code) r
LEFT JOIN y1996_nation ON r.code = y1996_nation.code
LEFT JOIN nation ON r.code = lpad(n_nationkey::VARCHAR, 2, '0')""",
        "conservation_check": f"""WITH {INTERPOLATED},
b AS (SELECT sum(orders) AS orders, sum(spend) AS spend,
             {_wmean('urgent', 'orders')} AS urgent FROM attrs),
l AS (SELECT count(*)::DOUBLE AS with_lines FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
a AS (SELECT sum(orders10) AS orders, sum(spend10) AS spend,
             {_wmean('urgent10', 'orders10')} AS urgent FROM interp WHERE sup IS NOT NULL),
rows AS (
  SELECT 'orders' AS figure, b.orders AS before, a.orders AS after FROM a, b
  UNION ALL SELECT 'with lines', l.with_lines, a.orders FROM a, l
  UNION ALL SELECT 'spend', b.spend, a.spend FROM a, b
  UNION ALL SELECT 'urgent', b.urgent, a.urgent FROM a, b)
SELECT figure, round(before, 3) AS before, round(after, 3) AS after,
       round(abs(1 - after / nullif(before, 0)), 3) AS relative_error,
       abs(1 - after / nullif(before, 0)) < 1e-4 AS passed
FROM rows""",
        "frame_multiplicity": """
WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
b AS (SELECT coalesce(s.n, 0) AS l, CASE WHEN n_nationkey IS NULL THEN 0 ELSE 1 END AS r
      FROM s FULL JOIN nation ON k = n_nationkey)
SELECT sum(greatest(l, r))::BIGINT AS n_rows, sum(least(l, r))::BIGINT AS match_one,
       sum(least(l, r))::BIGINT AS min_matches, sum(least(l, r)) = sum(greatest(l, r)) AS equal FROM b""",
        "frame_differences": """
WITH l AS (SELECT s_nationkey AS k, count(*) AS units, max(s_acctbal) AS most FROM supplier GROUP BY 1),
r AS (SELECT c_nationkey AS k, count(*) AS units, max(c_acctbal) AS most FROM customer GROUP BY 1),
b AS (
  SELECT coalesce(l.k, r.k) AS nation, l.k IS NOT NULL AS in_l, r.k IS NOT NULL AS in_r,
         l.units IS DISTINCT FROM r.units AS units_differ,
         NOT (abs(l.most - r.most) <= 0.01 * greatest(abs(l.most), 1)) AS most_differ
  FROM l FULL JOIN r ON l.k = r.k)
SELECT nation, in_l::BIGINT AS only_left, in_r::BIGINT AS only_right,
       CASE WHEN in_l AND in_r THEN array_to_string(list_filter([
         CASE WHEN units_differ THEN 'units' END, CASE WHEN most_differ THEN 'most' END,
         CASE WHEN units_differ AND nation % 3 <> 0 THEN 'some' END], lambda x: x IS NOT NULL), ',') END AS columns
FROM b WHERE NOT (in_l AND in_r) OR units_differ OR most_differ""",
        "compare_unknown": f"WITH {UNKNOWN} SELECT {SHOWN} FROM comparison",
        "closed_cases": _closed_cases(),
        "boundary_cases": _boundary_cases(),
        "case_kinds": f"""WITH RECURSIVE {RETURNED_CASES}
SELECT kind, count(*) AS cases, sum(sources)::BIGINT AS orders, sum(targets)::BIGINT AS parts
FROM cases GROUP BY 1""",
        **LANDED,
        "landed_facts": """
SELECT lpad(s_nationkey::VARCHAR, 2, '0') || lpad(s_suppkey::VARCHAR, 9, '0') AS GEOID,
       s_name AS NAME,
       round(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS AE,
       round(sum(l_discount) FILTER (WHERE l_returnflag = 'A'), 6) AS AM,
       round(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS NE,
       round(sum(l_discount) FILTER (WHERE l_returnflag = 'N'), 6) AS NM,
       round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS RE,
       round(sum(l_discount) FILTER (WHERE l_returnflag = 'R'), 6) AS RM
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE extract(year FROM l_shipdate) = 2000 GROUP BY 1, 2""",
        "csv_round_trip": f"""WITH {ATTRIBUTES}
SELECT okey::VARCHAR AS "order", price, spend,
       CASE WHEN urgent > 0 THEN 'a "note",' || chr(10) || 'of order ' || okey END AS note FROM attrs""",
        "row_index": """
SELECT row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS row_id,
       c_custkey, c_acctbal FROM customer""",
        "case_checks": _case_checks(),
        "frame_equality": _frame_equality(),
    }
