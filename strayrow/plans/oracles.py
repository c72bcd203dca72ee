"""The same results in SQL, written independently of the operators."""

from __future__ import annotations

from strayrow.functions.sampling import HALVES, PRIME, SHIFTS

# Common parts -------------------------------------------------------------------------------

USER_DAY = """
user_day AS (
  SELECT user_id, event_date, value_sum, event_count, event_type,
         CASE WHEN event_count >= 5 THEN 'busy' ELSE 'quiet' END AS activity
  FROM (SELECT user_id, CAST(ts AS DATE) AS event_date, round(SUM(value), 2) AS value_sum,
               COUNT(*) AS event_count, MIN(event_type) AS event_type
        FROM events GROUP BY 1, 2))"""

Z = (
    USER_DAY
    + """,
z AS (
  SELECT *,
    ABS((value_sum - AVG(value_sum) OVER ()) / NULLIF(STDDEV(value_sum) OVER (), 0))
      AS zscore_value_sum,
    ABS((event_count - AVG(event_count) OVER ()) / NULLIF(STDDEV(event_count) OVER (), 0))
      AS zscore_event_count
  FROM user_day),
m AS (SELECT *, GREATEST(zscore_value_sum, zscore_event_count) AS max_zscore FROM z)"""
)

TIER = """CASE WHEN anomaly_probability <= 50 THEN 'LOW' WHEN anomaly_probability <= 70 THEN 'MEDIUM'
  WHEN anomaly_probability <= 90 THEN 'HIGH' WHEN anomaly_probability <= 100 THEN 'CRITICAL' END"""


def probability(score: str) -> str:
    return f"""CASE WHEN {score} IS NOT NULL THEN round_even(
      (RANK() OVER (ORDER BY {score} NULLS LAST)
       + (COUNT(*) OVER (PARTITION BY {score}) - 1) / 2.0) / COUNT({score}) OVER () * 100, 2) END"""


SCORED = (
    Z
    + f""",
p AS (SELECT *, CAST(CASE WHEN max_zscore > 3 THEN 1 ELSE 0 END AS INTEGER) AS anomaly,
             max_zscore AS anomaly_score, {probability("max_zscore")} AS anomaly_probability
      FROM m),
scored AS (SELECT *, {TIER} AS risk_tier FROM p)"""
)

EVENTS_SCORED = f"""
z AS (SELECT event_id, event_type, value,
        ABS((value - AVG(value) OVER ()) / NULLIF(STDDEV(value) OVER (), 0)) AS anomaly_score
      FROM events),
scored_events AS (
  SELECT *, CAST(CASE WHEN anomaly_score > 3 THEN 1 ELSE 0 END AS INTEGER) AS anomaly,
         {probability("anomaly_score")} AS anomaly_probability FROM z)"""

EVENT_DAYS = f"""{EVENTS_SCORED},
t AS (SELECT CAST(ts AS DATE) AS day, CAST(SUM(anomaly) AS BIGINT) AS anomalies, COUNT(*) AS total
      FROM scored_events JOIN events USING (event_id) GROUP BY 1)"""

FENCE_TABLE = """f AS (SELECT q1v, q3v, q1c, q3c,
        q1v - 1.5 * (q3v - q1v) AS lov, q3v + 1.5 * (q3v - q1v) AS hiv,
        q1c - 1.5 * (q3c - q1c) AS loc, q3c + 1.5 * (q3c - q1c) AS hic
      FROM (SELECT quantile_cont(value_sum, 0.25) AS q1v, quantile_cont(value_sum, 0.75) AS q3v,
                   quantile_cont(event_count, 0.25) AS q1c, quantile_cont(event_count, 0.75) AS q3c
            FROM user_day))"""

FENCES = f"{USER_DAY},\n{FENCE_TABLE}"

IQR_SCORE = """GREATEST(0.0::DOUBLE, lov - value_sum, value_sum - hiv,
  loc - event_count, event_count - hic)"""


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


Z_NAMES = ("zscore_value_sum", "zscore_event_count")
DAY = "user_id, event_date, value_sum, event_count"

LINEITEM_TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


def _hash(keys: tuple[str, ...], seed: int) -> str:
    """A number from 0 to 1 of whole-number keys."""
    return f"({_number(keys, seed)})::DOUBLE / ({PRIME}.0::DOUBLE * {PRIME}.0::DOUBLE)"


def _number(keys: tuple[str, ...], seed: int) -> str:
    halves = []
    for fold, *rounds in HALVES:
        at = f"{seed}::BIGINT"
        for key in keys:
            value = f"coalesce({key}, -1)::BIGINT"
            for limb in (f"(({value} % {PRIME}) + {PRIME}) % {PRIME}", f"((({value} >> 31) % {PRIME}) + {PRIME}) % {PRIME}"):
                at = f"(({at} * {fold} + {limb}) % {PRIME})"
        for ((a, p), (b, q)), (i, j) in zip(rounds, SHIFTS):
            at = f"((({at} * {a} + {i}) % {p}) * (({at} * {b} + {j}) % {q}) % {PRIME})"
        halves.append(at)
    return f"({halves[0]} * {PRIME} + {halves[1]})"


DAY_KEY = ("user_id", "(event_date - DATE '1970-01-01')")


def role(kind: str) -> str:
    return {"string": "categorical", "timestamp_ntz": "temporal"}.get(kind, "numeric")


def _profile() -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{t}' AS type,
        '{role(t)}' AS role, COUNT(*) AS total, COUNT(DISTINCT {c}) AS "distinct",
        COUNT(*) - COUNT({c}) AS nulls,
        round((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 6) AS null_pct FROM lineitem"""
        for i, (c, t) in enumerate(LINEITEM_TYPES.items())
    )


def _roles() -> str:
    parts = []
    for kind in ("numeric", "categorical", "temporal", "other"):
        names = [c for c, t in LINEITEM_TYPES.items() if role(t) == kind]
        filled = " + ".join(f"COUNT({c})" for c in names) or "COUNT(*) * 0"
        parts.append(
            f"""SELECT '{kind}' AS role, CAST({len(names)} AS INTEGER) AS column_count,
            '{",".join(names)}' AS column_names, CAST({filled} AS BIGINT) AS filled_cells
            FROM lineitem"""
        )
    return " UNION ALL ".join(parts)


def _rules() -> str:
    rules = {
        c: "first" if role(t) != "numeric" else "sum"
        for c, t in LINEITEM_TYPES.items()
        if c not in ("l_orderkey", "l_shipdate")
    }
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{rule}' AS rule,
        {f"round(CAST(SUM({c}) AS DOUBLE), 2)" if rule == "sum" else "MAX(CAST(NULL AS DOUBLE))"} AS value
        FROM lineitem"""
        for c, rule in rules.items()
    )


def _group_scores(weights: tuple[float, ...] = (0.40, 0.35, 0.15)) -> str:
    a, b, c = weights
    return f"""g AS (
  SELECT user_id, COUNT(*) FILTER (risk_tier IN ('CRITICAL', 'HIGH')) AS critical_days,
         AVG(anomaly_probability) AS avg_probability, MAX(anomaly_score) AS max_severity,
         COUNT(*) AS group_rows
  FROM scored GROUP BY 1),
priorities AS (
  SELECT user_id, CAST(avg_probability * {a} + LEAST(critical_days * 10, 50) * {b}
         + max_severity / 10 * 30 * {c} AS DOUBLE) AS priority_score,
         critical_days, avg_probability, max_severity, group_rows FROM g)"""


PRIORITY_COLUMNS = (
    "user_id, critical_days, group_rows, " + r("priority_score", "avg_probability", "max_severity")
)

TOP = """top AS (SELECT user_id FROM priorities ORDER BY priority_score DESC, user_id LIMIT 20),
marked AS (SELECT s.*, p.priority_score, s.user_id IN (SELECT user_id FROM top) AS recommended_for_audit
           FROM scored s LEFT JOIN priorities p USING (user_id))"""


def _funnel(variant: str) -> str:
    third = "m >= 1 OR d >= 2 OR anomaly_probability >= 60"
    filtered = "WHEN NOT final_group THEN 'FILTERED_OUT'"
    if variant == "B":
        third, filtered = "m >= 1 AND anomaly_probability >= 50", ""
    return (
        SCORED
        + f""",
q AS (SELECT quantile_cont(anomaly_score, 0.85) AS cut FROM scored),
metric AS (
  SELECT user_id,
    (CASE WHEN zscore_value_sum > 2 THEN 1 ELSE 0 END)
    + (CASE WHEN zscore_event_count > 2 THEN 1 ELSE 0 END) AS hits FROM scored),
freq AS (SELECT user_id, COUNT(*) AS d FROM scored WHERE risk_tier IN ('CRITICAL', 'HIGH') GROUP BY 1),
multi AS (SELECT user_id, CAST(SUM(hits) AS BIGINT) AS m FROM metric GROUP BY 1 HAVING SUM(hits) > 0),
often AS (SELECT user_id FROM freq WHERE d >= 3),
several AS (SELECT user_id FROM multi WHERE m >= 2),
severe AS (SELECT DISTINCT user_id FROM scored, q
           WHERE anomaly = 1 AND anomaly_score >= cut AND user_id IN (SELECT user_id FROM often)),
final_groups AS (SELECT user_id FROM severe INTERSECT SELECT user_id FROM several),
wide AS (
  SELECT s.*, COALESCE(f.d, 0) AS d, COALESCE(x.m, 0) AS m, anomaly_score >= cut AS high_score,
         user_id IN (SELECT user_id FROM often) AS is_often,
         user_id IN (SELECT user_id FROM several) AS is_several,
         user_id IN (SELECT user_id FROM final_groups) AS final_group
  FROM scored s CROSS JOIN q LEFT JOIN freq f USING (user_id) LEFT JOIN multi x USING (user_id)),
tiered AS (
  SELECT *, d AS critical_day_count, m AS anomalous_metric_count,
    {"final_group" if variant == "A" else "high_score AND d >= 3 AND is_several"} AS in_final,
    CASE WHEN anomaly = 0 THEN 'NORMAL' {filtered}
      WHEN m >= 3 AND d >= 5 AND anomaly_probability >= 90 THEN 'TIER_1_CRITICAL'
      WHEN m >= 2 AND d >= 3 AND anomaly_probability >= 70 THEN 'TIER_2_HIGH'
      WHEN {third} THEN 'TIER_3_MEDIUM' ELSE 'TIER_4_LOW' END AS audit_tier
  FROM wide)"""
    )


FUNNEL_COLUMNS = (
    "user_id, event_date, anomaly, risk_tier, critical_day_count, anomalous_metric_count"
)


def _tier_groups(variant: str) -> str:
    return f"""WITH {_funnel(variant)}, t(audit_tier, share) AS (VALUES ('TIER_1_CRITICAL', 1.0),
      ('TIER_2_HIGH', 0.5), ('TIER_3_MEDIUM', 0.2), ('TIER_4_LOW', 0.0)),
    n AS (SELECT t.audit_tier, share, COUNT(DISTINCT user_id) AS group_count
          FROM t LEFT JOIN tiered USING (audit_tier) GROUP BY ALL)
    SELECT audit_tier, group_count, CAST(floor(group_count * share) AS BIGINT) AS audit_volume FROM n"""


def _stages(variant: str) -> str:
    def stage(i: int, name: str, groups: str, rows: str) -> str:
        return f"""SELECT CAST({i} AS INTEGER) AS stage, '{name}' AS name,
        COUNT(DISTINCT user_id) FILTER ({groups}) AS groups_remaining,
        COUNT(*) FILTER ({rows}) AS records_remaining FROM tiered"""

    severe = "anomaly = 1 AND high_score AND is_often"
    final = "anomaly = 1 AND in_final"
    return f"WITH {_funnel(variant)} " + " UNION ALL ".join(
        [
            stage(0, "Initial", "anomaly = 1", "anomaly = 1"),
            stage(1, "Frequency Filter", "is_often", "anomaly = 1 AND is_often"),
            stage(2, "Severity Filter", severe, severe),
            stage(3, "Multi-Metric Consensus", final, final),
        ]
    )


def _rates(columns: tuple[str, ...], top: int) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS category_order, '{c}' AS category, {c} AS value,
        CAST(SUM(anomaly) AS BIGINT) AS anomaly_count, COUNT(*) AS total_count,
        SUM(anomaly) / COUNT(*) * 100 AS anomaly_rate
        FROM scored WHERE {c} IS NOT NULL GROUP BY {c}"""
        for i, c in enumerate(columns)
    )
    return f"""rates AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY category_order
      ORDER BY anomaly_rate DESC, value) AS INTEGER) AS position FROM ({parts})
      QUALIFY position <= {top})"""


CONTRAST = """contrast AS (""" + " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS feature_order, '{c}' AS feature,
    AVG({c}) FILTER (anomaly = 1) AS anomaly_mean, AVG({c}) FILTER (anomaly = 0) AS normal_mean,
    STDDEV({c}) FILTER (anomaly = 1) AS anomaly_std,
    ABS(AVG({c}) FILTER (anomaly = 1) - AVG({c}) FILTER (anomaly = 0)) AS difference FROM scored"""
    for i, c in enumerate(("value_sum", "event_count"))
) + ")"

CONTRAST_COLUMNS = "feature_order, feature, " + r(
    "anomaly_mean", "normal_mean", "anomaly_std", "difference"
)

RATE = "SUM(anomaly) / COUNT(*) * 100"


def _histogram(value: str, by: str) -> str:
    keys = f", {by}" if by else ""
    return f"""e AS (SELECT MIN({value}) AS low, (MAX({value}) - MIN({value})) / 50 AS width FROM scored),
    b AS (SELECT CAST(LEAST(floor(({value} - low) / width), 49) AS INTEGER) AS bin{keys}
          FROM scored, e WHERE {value} IS NOT NULL),
    h AS (SELECT bin{keys}, COUNT(*) AS rows FROM b GROUP BY ALL),
    hist AS (SELECT bin{keys}, rows, low + bin * width AS bin_start, low + bin * width + width AS bin_end
             FROM h, e)"""


def _box() -> str:
    parts = []
    for c in ("value_sum", "event_count"):
        for name, v in (("normal", 0), ("anomaly", 1)):
            parts.append(
                f"""SELECT '{c}' AS feature, '{name}' AS class, COUNT(x) AS rows,
            CAST(MIN(x) AS DOUBLE) AS minimum, round(MIN(q1), 6) AS q1, round(MIN(q2), 6) AS median,
            round(MIN(q3), 6) AS q3, CAST(MAX(x) AS DOUBLE) AS maximum,
            CAST(MIN(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_low,
            CAST(MAX(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_high,
            COUNT(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
            FROM (SELECT {c} AS x FROM scored WHERE anomaly = {v}),
              (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
                      quantile_cont({c}, 0.75) AS q3 FROM scored WHERE anomaly = {v})"""
            )
    return " UNION ALL ".join(parts)


NORMALIZED = (
    Z
    + """,
n AS (SELECT user_id, event_date, max_zscore,
        10 * (max_zscore - MIN(max_zscore) OVER ()) / (MAX(max_zscore) OVER () - MIN(max_zscore) OVER ())
          AS anomaly_score FROM m)"""
)

LOF = """
WITH st AS (SELECT AVG(c_nationkey) AS m1, STDDEV_POP(c_nationkey) AS s1,
                   AVG(c_acctbal) AS m2, STDDEV_POP(c_acctbal) AS s2, COUNT(*) AS n FROM customer),
pt AS (SELECT c_nationkey, c_acctbal, (c_nationkey - m1) / s1 AS x, (c_acctbal - m2) / s2 AS y,
              COUNT(*) AS w, LEAST(20, MIN(n) - 1) AS k FROM customer, st GROUP BY ALL),
d AS (SELECT a.x AS px, a.y AS py, b.x AS ox, b.y AS oy, a.k,
             sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
             b.w - CASE WHEN a.x = b.x AND a.y = b.y THEN 1 ELSE 0 END AS w FROM pt a, pt b),
o AS (SELECT *, SUM(w) OVER (PARTITION BY px, py ORDER BY d, ox, oy
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w AS before FROM d WHERE w > 0),
nb AS (SELECT *, LEAST(w, k - before) AS share FROM o WHERE before < k),
kd AS (SELECT px, py, MAX(d) AS kdist FROM nb GROUP BY 1, 2),
lr AS (SELECT nb.px, nb.py, 1 / (SUM(share * GREATEST(kdist, d)) / MIN(k) + 1e-10) AS lrd
       FROM nb JOIN kd ON nb.ox = kd.px AND nb.oy = kd.py GROUP BY 1, 2),
lf AS (SELECT nb.px, nb.py, SUM(share * b.lrd) / MIN(k) / MIN(a.lrd) AS lof
       FROM nb JOIN lr a ON nb.px = a.px AND nb.py = a.py
       JOIN lr b ON nb.ox = b.px AND nb.oy = b.py GROUP BY 1, 2),
sc AS (SELECT c_custkey, lof FROM customer JOIN pt USING (c_nationkey, c_acctbal)
       JOIN lf ON pt.x = lf.px AND pt.y = lf.py),
nm AS (SELECT c_custkey, 10 * (lof - MIN(lof) OVER ()) / (MAX(lof) OVER () - MIN(lof) OVER ()) AS s FROM sc),
th AS (SELECT GREATEST(quantile_cont(s, 0.9) * 1.2, 6.0) AS t FROM nm)
SELECT c_custkey, round(s, 4) AS anomaly_score,
       CAST(CASE WHEN s > t THEN 1 ELSE 0 END AS INTEGER) AS anomaly FROM nm, th"""


DENSITY = """
WITH RECURSIVE s AS (
  SELECT c_custkey, (c_acctbal - AVG(c_acctbal) OVER ()) / STDDEV_POP(c_acctbal) OVER () AS x,
         (c_nationkey - AVG(c_nationkey) OVER ()) / STDDEV_POP(c_nationkey) OVER () AS y FROM customer),
near AS MATERIALIZED (
  SELECT p.c_custkey AS a, q.c_custkey AS b FROM s p, s q
  WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.1 * 0.1),
seen AS MATERIALIZED (SELECT a, COUNT(*) AS n FROM near GROUP BY 1),
edges AS MATERIALIZED (
  SELECT near.a, near.b FROM near JOIN seen p ON near.a = p.a JOIN seen q ON near.b = q.a
  WHERE p.n >= 4 AND q.n >= 4),
reach(k, first) AS (
  SELECT a, a FROM seen WHERE n >= 4
  UNION SELECT edges.b, reach.first FROM reach JOIN edges ON edges.a = reach.k WHERE reach.first < edges.b),
named AS MATERIALIZED (SELECT k, MIN(first) AS cluster FROM reach GROUP BY 1),
beside AS (SELECT a, MIN(cluster) AS cluster FROM near JOIN named ON b = k GROUP BY 1),
judged AS (
  SELECT seen.a AS c_custkey, coalesce(named.cluster, beside.cluster) AS cluster, n >= 4 AS core,
         CAST(CASE WHEN coalesce(named.cluster, beside.cluster) IS NULL THEN 1 ELSE 0 END AS INTEGER) AS anomaly,
         10.0::DOUBLE * GREATEST(4 - n, 0) / 4.0::DOUBLE AS anomaly_score
  FROM seen LEFT JOIN named ON seen.a = k LEFT JOIN beside ON beside.a = seen.a)"""


TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

_BATCH_RANKED = f"""ranked AS (
  SELECT *, CASE WHEN anomaly_score IS NOT NULL THEN round_even(
      (RANK() OVER (PARTITION BY source_file ORDER BY anomaly_score NULLS LAST)
       + (COUNT(*) OVER (PARTITION BY source_file, anomaly_score) - 1) / 2.0)
      / COUNT(anomaly_score) OVER (PARTITION BY source_file) * 100, 2) END AS anomaly_probability
  FROM b),
batch_scored AS (SELECT *, {TIER} AS risk_tier FROM ranked)"""

BATCH_Z = f"""WITH d AS (
  SELECT event_id, value, event_type AS source_file,
         ABS((value - AVG(value) OVER w) / NULLIF(STDDEV(value) OVER w, 0)) AS anomaly_score
  FROM events WINDOW w AS (PARTITION BY event_type)),
b AS (SELECT *, CAST(CASE WHEN anomaly_score > 3 THEN 1 ELSE 0 END AS INTEGER) AS anomaly FROM d),
{_BATCH_RANKED}"""

BATCH_IQR = f"""WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
e AS (
  SELECT event_id, value, event_type AS source_file, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM events JOIN q USING (event_type)),
b AS (
  SELECT event_id, value, source_file, CAST(CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END AS INTEGER) AS anomaly,
         GREATEST(0.0::DOUBLE, lo - value, value - hi) AS anomaly_score FROM e),
{_BATCH_RANKED}"""


def _forest(trees: int = 100, tree_rows: int = 256, seed: int = 42, pool: int = 256 * 64) -> str:
    """An Isolation Forest over user-days: samples, then nodes level by level, then paths."""
    c = "CASE WHEN {0} > 2 THEN 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / {0}::DOUBLE WHEN {0} = 2 THEN 1.0 ELSE 0.0 END"
    parts = [f"""{USER_DAY},
 scaled AS MATERIALIZED (
  SELECT *, (value_sum - AVG(value_sum) OVER ()) / STDDEV_POP(value_sum) OVER () AS x0,
         (event_count - AVG(event_count) OVER ()) / STDDEV_POP(event_count) OVER () AS x1,
         {_number(DAY_KEY, seed)} AS number FROM user_day),
 pool AS MATERIALIZED (SELECT x0, x1, number FROM scaled ORDER BY {_hash(("number",), seed)}, number LIMIT {pool}),
 sizes AS (SELECT LEAST({tree_rows}, COUNT(*)) AS size, ceil(log2(GREATEST(LEAST({tree_rows}, COUNT(*)), 2))) AS most FROM pool),
 l0 AS MATERIALIZED (
  SELECT tree, 1 AS place, x0, x1 FROM (
    SELECT tree, x0, x1, row_number() OVER (PARTITION BY tree ORDER BY {_number(("tree", "number"), seed + 1)}, x0, x1) AS k
    FROM pool, (SELECT unnest(range({trees})) AS tree)), sizes WHERE k <= size),
 r0 AS (SELECT tree, 1 AS place, number, x0, x1 FROM scaled, (SELECT unnest(range({trees})) AS tree))"""]
    depth = (tree_rows - 1).bit_length()
    for d in range(depth + 1):
        feature = f"CASE WHEN varied = 2 THEN {_number(('tree', 'place'), seed + 2)} % 2 WHEN h0 > l0 THEN 0 ELSE 1 END"
        parts.append(f"""
 n{d} AS MATERIALIZED (
  SELECT *, {feature} AS f, {d} + round({c.format("n")} * 16777216) / 16777216 AS path,
         {d} >= most OR n <= 1 OR varied = 0 AS leaf, {_hash(("tree", "place"), seed + 3)} AS share
  FROM (SELECT tree, place, COUNT(*) AS n, MIN(x0) AS l0, MAX(x0) AS h0, MIN(x1) AS l1, MAX(x1) AS h1,
               CAST(MAX(x0) > MIN(x0) AS INT) + CAST(MAX(x1) > MIN(x1) AS INT) AS varied
        FROM l{d} GROUP BY 1, 2), sizes),
 s{d} AS MATERIALIZED (
  SELECT tree, place, f, leaf, path, CASE WHEN f = 0 THEN l0 + share * (h0 - l0) ELSE l1 + share * (h1 - l1) END AS split FROM n{d}),
 p{d} AS (SELECT number, SUM(path) AS path FROM r{d} JOIN s{d} USING (tree, place) WHERE leaf GROUP BY 1)""")
        if d < depth:
            step = "2 * place + CAST(CASE WHEN f = 0 THEN x0 ELSE x1 END > split AS INT) AS place"
            parts.append(f"""
 l{d + 1} AS MATERIALIZED (SELECT tree, {step}, x0, x1 FROM l{d} JOIN s{d} USING (tree, place) WHERE NOT leaf),
 r{d + 1} AS MATERIALIZED (SELECT tree, {step}, number, x0, x1 FROM r{d} JOIN s{d} USING (tree, place) WHERE NOT leaf)""")
    every = " UNION ALL ".join(f"SELECT * FROM p{d}" for d in range(depth + 1))
    parts.append(f"""
 raw AS (SELECT number, pow(2, -(SUM(path) / {trees}) / ANY_VALUE({c.format("size")})) AS s FROM ({every}), sizes GROUP BY 1),
 normal AS (SELECT *, 10 * (s - MIN(s) OVER ()) / (MAX(s) OVER () - MIN(s) OVER ()) AS anomaly_score
            FROM scaled JOIN raw USING (number)),
 limits AS (SELECT GREATEST(quantile_cont(anomaly_score, 0.9) * 1.2, 6.0) AS cut FROM normal),
 found AS (SELECT *, CAST(CASE WHEN anomaly_score > cut THEN 1 ELSE 0 END AS INTEGER) AS anomaly,
                  {probability("anomaly_score")} AS anomaly_probability FROM normal, limits)""")
    return f"""WITH {",".join(parts)}
 SELECT user_id, event_date, value_sum, CAST(event_count AS DOUBLE) AS event_count, event_type, activity,
        anomaly, round(anomaly_score, 6) AS anomaly_score, anomaly_probability, {TIER} AS risk_tier FROM found"""


# Queries ------------------------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    scored = f"WITH {SCORED} SELECT"
    all_columns = f"""user_id, event_date, value_sum, event_count, {r(*Z_NAMES, "max_zscore", "anomaly_score")},
      anomaly, anomaly_probability, risk_tier"""
    audited = f"WITH {SCORED}, {_group_scores()}, {TOP}"
    return {
        "format_by_suffix": """
          SELECT CASE doc_id % 7 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'xls'
                   WHEN 3 THEN 'txt' WHEN 4 THEN 'parquet' END AS format, COUNT(*) AS files
          FROM documents GROUP BY 1""",
        "scan_parquet": "SELECT * FROM customer",
        "scan_csv": """SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name,
          CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""",
        "scan_txt": """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey,
          CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority
          FROM orders""",
        "convert_to_parquet": """SELECT COUNT(*) OVER () AS row_count, CAST(4 AS INTEGER) AS column_count,
          CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_acctbal FROM supplier""",
        "write_parquet": f"{scored} {all_columns} FROM scored",
        "write_csv": f"{scored} {all_columns} FROM scored",
        "sample_dataset": """WITH n AS (SELECT COUNT(*) AS n, CAST(floor(COUNT(*) * 0.05) AS BIGINT) AS p FROM orders)
          SELECT TRUE AS planted, p AS rows FROM n UNION ALL SELECT FALSE, n - p FROM n""",
        "table_shape": "SELECT COUNT(*) AS row_count, CAST(11 AS INTEGER) AS column_count FROM lineitem",
        "column_profile": _profile(),
        "column_roles": _roles(),
        "default_features": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(AVG({c}), 4) AS mean FROM lineitem"
            for c in ("l_orderkey", "l_partkey", "l_suppkey")
        ),
        "preview": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
          ORDER BY 1, 2, 3, 4, 5 LIMIT 1000""",
        "detect_group_date": """SELECT 'user_id' AS group_column, 'event_date' AS date_column,
          COUNT(DISTINCT user_id) AS groups, COUNT(DISTINCT CAST(ts AS DATE)) AS dates FROM events""",
        "sensitivity_band": """
          WITH r AS (SELECT user_id, COUNT(*) AS events,
            COUNT(*) FILTER (event_type = 'error') / COUNT(*) AS rate FROM events GROUP BY 1)
          SELECT user_id, events, round(rate, 6) AS rate,
            CASE WHEN rate <= 0.01 THEN 'very strict' WHEN rate <= 0.05 THEN 'strict'
              WHEN rate <= 0.10 THEN 'balanced' WHEN rate <= 0.20 THEN 'lenient'
              ELSE 'very lenient' END AS sensitivity,
            CAST(trunc(events * rate) AS BIGINT) AS expected_anomalies FROM r""",
        "rollup_metric_rule": _rules(),
        "group_date_rollup": f"""
          WITH a AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate,
            CAST(SUM(l_orderkey) AS BIGINT) AS l_orderkey, CAST(SUM(l_partkey) AS BIGINT) AS l_partkey,
            CAST(SUM(l_linenumber) AS BIGINT) AS l_linenumber, SUM(l_quantity) AS l_quantity,
            SUM(l_extendedprice) AS l_extendedprice, SUM(l_discount) AS l_discount, AVG(l_tax) AS l_tax,
            MIN(l_returnflag) AS l_returnflag, MIN(l_linestatus) AS l_linestatus
            FROM lineitem GROUP BY 1, 2)
          SELECT * REPLACE ({r("l_quantity", "l_extendedprice", "l_discount", "l_tax", digits=4)}) FROM a""",
        "rollup_reduction": """
          WITH g AS (SELECT COUNT(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE))
          SELECT CAST(SUM(n) AS BIGINT) AS row_count, COUNT(*) AS rolled_up_rows,
                 round((1 - COUNT(*) / SUM(n)) * 100, 6) AS reduction_pct FROM g""",
        "zscore_columns": f"WITH {Z} SELECT {DAY}, {r(*Z_NAMES)} FROM z",
        "zscore_max": f"WITH {Z} SELECT {DAY}, {r(*Z_NAMES, 'max_zscore')} FROM m",
        "zscore_detect": f"{scored} event_type, activity, {all_columns} FROM scored",
        "iqr_fences": f"""WITH {FENCES}
          SELECT 'value_sum' AS feature, round(q1v, 6) AS q1, round(q3v, 6) AS q3,
                 round(lov, 6) AS lower, round(hiv, 6) AS upper FROM f
          UNION ALL SELECT 'event_count', round(q1c, 6), round(q3c, 6), round(loc, 6), round(hic, 6) FROM f""",
        "iqr_score": f"""WITH {FENCES} SELECT {DAY}, round({IQR_SCORE}, 6) AS anomaly_score
          FROM user_day, f""",
        "iqr_detect": f"""WITH {FENCES},
          i AS (SELECT user_day.*, {IQR_SCORE} AS anomaly_score,
            CAST(CASE WHEN value_sum < lov OR value_sum > hiv OR event_count < loc OR event_count > hic
                 THEN 1 ELSE 0 END AS INTEGER) AS anomaly FROM user_day, f),
          p AS (SELECT *, {probability("anomaly_score")} AS anomaly_probability FROM i)
          SELECT * REPLACE (round(anomaly_score, 6) AS anomaly_score), {TIER} AS risk_tier FROM p""",
        "detect_metadata": f"""{scored} 'zscore' AS method, CAST(3 AS DOUBLE) AS threshold_value,
          '3.0σ (standard deviations)' AS threshold_display, CAST(NULL AS BIGINT) AS expected_anomalies,
          CAST(SUM(anomaly) AS BIGINT) AS actual_anomalies,
          COUNT(*) FILTER (risk_tier = 'LOW') AS low_rows, COUNT(*) FILTER (risk_tier = 'MEDIUM') AS medium_rows,
          COUNT(*) FILTER (risk_tier = 'HIGH') AS high_rows,
          COUNT(*) FILTER (risk_tier = 'CRITICAL') AS critical_rows FROM scored""",
        "median_impute": """
          WITH j AS (SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id))
          SELECT doc_id, CAST(COALESCE(n_chars, MEDIAN(n_chars) OVER ()) AS DOUBLE) AS n_chars,
                 CAST(COALESCE(quality, MEDIAN(quality) OVER ()) AS DOUBLE) AS quality FROM j""",
        "standard_scale": """SELECT c_custkey, c_nationkey, c_acctbal,
          round((c_nationkey - AVG(c_nationkey) OVER ()) / STDDEV_POP(c_nationkey) OVER (), 6) AS scaled_c_nationkey,
          round((c_acctbal - AVG(c_acctbal) OVER ()) / STDDEV_POP(c_acctbal) OVER (), 6) AS scaled_c_acctbal
          FROM customer""",
        "local_outlier_factor": LOF,
        "score_normalize": f"""WITH {NORMALIZED}
          SELECT user_id, event_date, {r("max_zscore", "anomaly_score")} FROM n""",
        "adaptive_threshold": f"""WITH {NORMALIZED},
          t AS (SELECT GREATEST(quantile_cont(anomaly_score, 0.99) * 1.2, 6.0) AS limit_score FROM n)
          SELECT user_id, event_date, {r("max_zscore", "anomaly_score")},
            round(limit_score, 6) AS threshold_value,
            CAST(CASE WHEN anomaly_score > limit_score THEN 1 ELSE 0 END AS INTEGER) AS anomaly FROM n, t""",
        "expected_vs_actual": f"""WITH {SCORED},
          c AS (SELECT COUNT(*) AS total, CAST(floor(COUNT(*) * 0.05) AS BIGINT) AS expected_anomalies,
                CAST(SUM(anomaly) AS BIGINT) AS actual_anomalies FROM scored)
          SELECT *, actual_anomalies - expected_anomalies AS difference,
            round((actual_anomalies - expected_anomalies) / expected_anomalies * 100, 6) AS difference_pct,
            ABS(actual_anomalies - expected_anomalies) > expected_anomalies * 0.1 AS notable FROM c""",
        "ml_sample_policy": """
          SELECT 'isolation_forest' AS method, COUNT(*) AS rows FROM lineitem
          UNION ALL SELECT 'lof', LEAST(COUNT(*), 50000) FROM lineitem
          UNION ALL SELECT 'one_class_svm', LEAST(COUNT(*), 50000) FROM lineitem""",
        "percent_rank_avg": f"""WITH v AS (SELECT event_id, round_even(value, 0) AS whole_value FROM events)
          SELECT event_id, whole_value, {probability("whole_value")} AS anomaly_probability FROM v""",
        "risk_tier": f"""WITH v AS (SELECT event_id, round_even(value, 0) AS whole_value FROM events),
          p AS (SELECT *, {probability("whole_value")} AS anomaly_probability FROM v),
          t AS (SELECT *, {TIER} AS risk_tier FROM p)
          SELECT *, CAST(CASE risk_tier WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2
                         WHEN 'CRITICAL' THEN 3 END AS INTEGER) AS tier_order FROM t""",
        "tier_counts": f"""WITH {SCORED},
          t(risk_tier, tier_order) AS (VALUES ('LOW', 0), ('MEDIUM', 1), ('HIGH', 2), ('CRITICAL', 3))
          SELECT risk_tier, tier_order, COUNT(user_id) AS rows,
            round(COUNT(user_id) / (SELECT COUNT(*) FROM scored) * 100, 6) AS share_pct
          FROM t LEFT JOIN scored USING (risk_tier) GROUP BY ALL""",
        "result_group_column": """SELECT 'user_id' AS group_column, COUNT(DISTINCT user_id) AS groups
          FROM events""",
        "row_priority": f"""WITH {EVENTS_SCORED} SELECT event_id,
          round(anomaly_score * anomaly_probability / 100, 6) AS priority_score FROM scored_events""",
        "group_priority": f"WITH {SCORED}, {_group_scores()} SELECT {PRIORITY_COLUMNS} FROM priorities",
        "group_priority_by_severity": f"""WITH {SCORED}, {_group_scores((0.35, 0.20, 0.35))}
          SELECT {PRIORITY_COLUMNS} FROM priorities""",
        "group_priority_fallback": f"""WITH {SCORED},
          g AS (SELECT user_id, CAST(SUM(anomaly) AS BIGINT) AS critical_days, COUNT(*) AS group_rows
                FROM scored GROUP BY 1)
          SELECT user_id, critical_days, group_rows, CAST(50 AS DOUBLE) AS avg_probability,
            CAST(0 AS DOUBLE) AS max_severity,
            round(CAST(50 * 0.4 + LEAST(critical_days * 10, 50) * 0.35 AS DOUBLE), 6) AS priority_score FROM g""",
        "top_groups": f"""WITH {SCORED}, {_group_scores()}
          SELECT {PRIORITY_COLUMNS} FROM (
            SELECT * FROM priorities ORDER BY priority_score DESC, user_id LIMIT 20)""",
        "mark_recommended": f"""{audited} SELECT user_id, event_date, anomaly, risk_tier,
          round(priority_score, 6) AS priority_score, recommended_for_audit FROM marked""",
        "audit_stats": f"""{audited} SELECT 'intelligent' AS mode, 'user_id' AS group_column,
          COUNT(DISTINCT user_id) FILTER (anomaly = 1) AS initial_anomaly_groups,
          CAST(20 AS INTEGER) AS target_count, (SELECT COUNT(*) FROM top) AS recommended_count,
          TRUE AS prioritize_consistency FROM scored""",
        "audit_volume_plan": f"""WITH {SCORED},
          c AS (SELECT COUNT(*) FILTER (risk_tier = 'CRITICAL') AS critical,
                COUNT(*) FILTER (risk_tier = 'HIGH') AS high,
                COUNT(*) FILTER (risk_tier = 'MEDIUM') AS medium FROM scored),
          a AS (SELECT *, critical AS critical_audit, CAST(floor(high * 0.5) AS BIGINT) AS high_audit,
                CAST(floor(medium * 0.2) AS BIGINT) AS medium_audit FROM c)
          SELECT *, critical_audit + high_audit + medium_audit AS total_audit FROM a""",
        "funnel_simple": f"""WITH {EVENTS_SCORED},
          q AS (SELECT quantile_cont(anomaly_score, 0.95) AS cut FROM scored_events)
          SELECT event_id, anomaly, anomaly = 1 AND anomaly_score >= cut AS simple_priority
          FROM scored_events, q""",
        "funnel_frequency": f"""{scored} user_id, COUNT(*) AS critical_day_count FROM scored
          WHERE risk_tier IN ('CRITICAL', 'HIGH') GROUP BY 1 HAVING COUNT(*) >= 7""",
        "funnel_severity": f"WITH {_funnel('A')} SELECT user_id FROM severe",
        "funnel_severity_b": f"""WITH {_funnel("B")} SELECT DISTINCT user_id FROM tiered
          WHERE anomaly = 1 AND high_score AND d >= 3""",
        "metric_zscores": f"""WITH {Z} SELECT user_id, event_date,
          round(zscore_value_sum, 6) AS value_sum_zscore,
          round(zscore_event_count, 6) AS event_count_zscore FROM z""",
        "funnel_multi_metric": f"""WITH {_funnel("A")} SELECT user_id, m AS anomalous_metric_count
          FROM multi WHERE m >= 2""",
        "funnel_final": f"""WITH {_funnel("A")} SELECT {FUNNEL_COLUMNS} FROM tiered
          WHERE anomaly = 1 AND in_final""",
        "funnel_final_b": f"""WITH {_funnel("B")} SELECT {FUNNEL_COLUMNS} FROM tiered
          WHERE anomaly = 1 AND in_final""",
        "audit_tier": f"WITH {_funnel('A')} SELECT {FUNNEL_COLUMNS}, audit_tier FROM tiered",
        "audit_tier_b": f"WITH {_funnel('B')} SELECT {FUNNEL_COLUMNS}, audit_tier FROM tiered",
        "tier_group_counts": _tier_groups("A"),
        "tier_group_counts_b": _tier_groups("B"),
        "funnel_stages": _stages("A"),
        "funnel_stages_b": _stages("B"),
        "summary": f"""{scored} COUNT(*) AS total_records, CAST(SUM(anomaly) AS BIGINT) AS anomalies,
          round({RATE}, 6) AS anomaly_rate, 'Z-Score' AS method,
          '3.0σ (standard deviations)' AS threshold_display FROM scored""",
        "category_rates": f"""WITH {SCORED}, {_rates(("event_type", "activity"), 10)}
          SELECT * REPLACE (round(anomaly_rate, 6) AS anomaly_rate) FROM rates""",
        "feature_contrast": f"WITH {SCORED}, {CONTRAST} SELECT {CONTRAST_COLUMNS} FROM contrast",
        "top_anomalies": f"""{scored} {DAY}, round(anomaly_score, 6) AS anomaly_score, risk_tier
          FROM (SELECT * FROM scored ORDER BY anomaly_score DESC, user_id, event_date LIMIT 5)""",
        "verdict": f"""WITH {SCORED}, c AS (SELECT COUNT(*) AS total_records,
            CAST(SUM(anomaly) AS BIGINT) AS anomalies, {RATE} AS anomaly_rate FROM scored)
          SELECT total_records, anomalies, round(anomaly_rate, 6) AS anomaly_rate,
            CASE WHEN anomaly_rate < 1 THEN 'excellent' WHEN anomaly_rate < 5 THEN 'good'
              WHEN anomaly_rate < 10 THEN 'moderate' ELSE 'high' END AS verdict FROM c""",
        "verdict_expected": f"""WITH {SCORED}, c AS (SELECT COUNT(*) AS total_records,
            CAST(SUM(anomaly) AS BIGINT) AS anomalies, round({RATE}, 6) AS anomaly_rate,
            CAST(floor(COUNT(*) * 0.02) AS BIGINT) AS expected_anomalies FROM scored),
          e AS (SELECT *, anomalies - expected_anomalies AS difference,
            (anomalies - expected_anomalies) / expected_anomalies * 100 AS pct FROM c)
          SELECT * EXCLUDE (pct), round(pct, 6) AS difference_pct,
            CASE WHEN ABS(pct) < 10 THEN 'on target' WHEN difference > 0 THEN 'high alert'
              ELSE 'cleaner than expected' END AS verdict FROM e""",
        "primary_feature": f"""WITH {SCORED}, {CONTRAST},
          b AS (SELECT *, anomaly_mean / normal_mean AS q FROM contrast
                ORDER BY difference DESC, feature_order LIMIT 1)
          SELECT {CONTRAST_COLUMNS}, round(q, 6) AS ratio,
            CASE WHEN q > 2 THEN 'higher' WHEN q > 0 AND q < 0.5 THEN 'lower' WHEN q = 0 THEN 'zero'
              ELSE 'notable' END AS finding FROM b""",
        "hotspot": f"""WITH {SCORED}, {_rates(("event_type", "activity"), 1)},
          o AS (SELECT {RATE} AS overall_rate FROM scored),
          h AS (SELECT * FROM rates, o WHERE anomaly_rate > overall_rate * 1.5
                ORDER BY category_order LIMIT 1)
          SELECT category, value, anomaly_count, total_count, {r("anomaly_rate", "overall_rate")},
            round(anomaly_rate / overall_rate, 6) AS ratio,
            CASE WHEN anomaly_rate / overall_rate > 5 THEN 'critical'
              WHEN anomaly_rate / overall_rate > 3 THEN 'high' ELSE 'above average' END AS level FROM h""",
        "feature_ranking": f"""WITH {SCORED}, {CONTRAST} SELECT {CONTRAST_COLUMNS} FROM
          (SELECT * FROM contrast ORDER BY difference DESC, feature_order LIMIT 5)""",
        "extreme_count": f"""WITH {SCORED},
          q AS (SELECT quantile_cont(anomaly_score, 0.95) AS cut FROM scored)
          SELECT COUNT(*) FILTER (anomaly_score > cut) AS extreme_rows, round(MIN(cut), 6) AS score_cut
          FROM scored, q""",
        "alert_threshold": f"""{scored} round({RATE}, 6) AS anomaly_rate,
          round({RATE} * 1.5, 6) AS alert_rate FROM scored""",
        "class_counts": f"""{scored} 'normal' AS class, COUNT(*) FILTER (anomaly = 0) AS rows FROM scored
          UNION ALL SELECT 'anomaly', COUNT(*) FILTER (anomaly = 1) FROM scored""",
        "score_histogram": f"""WITH {SCORED}, {_histogram("anomaly_score", "anomaly")}
          SELECT bin, anomaly, rows, {r("bin_start", "bin_end")} FROM hist""",
        "probability_histogram": f"""WITH {SCORED}, {_histogram("anomaly_probability", "")}
          SELECT bin, rows, {r("bin_start", "bin_end")},
            CAST(CASE WHEN bin_start <= 90 AND 90 < bin_end THEN 90 WHEN bin_start <= 70 AND 70 < bin_end THEN 70
              WHEN bin_start <= 50 AND 50 < bin_end THEN 50 END AS DOUBLE) AS tier_line FROM hist""",
        "daily_series": f"""WITH {SCORED},
          t AS (SELECT event_date AS day, CAST(SUM(anomaly) AS BIGINT) AS anomalies, COUNT(*) AS total
                FROM scored GROUP BY 1),
          s AS (SELECT CAST(unnest(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS DATE) AS day FROM t)
          SELECT day, COALESCE(anomalies, 0) AS anomalies, COALESCE(total, 0) AS total,
            COALESCE(round(anomalies / total * 100, 6), 0) AS anomaly_rate FROM s LEFT JOIN t USING (day)""",
        "category_bars": f"""WITH {SCORED}, {_rates(("event_type", "activity"), 15)}
          SELECT * REPLACE (round(anomaly_rate, 6) AS anomaly_rate) FROM rates""",
        "box_summary": f"WITH {SCORED} {_box()}",
        "filter_results": f"""{audited} SELECT user_id, event_date, anomaly_probability, risk_tier,
          recommended_for_audit FROM marked WHERE recommended_for_audit AND anomaly = 1
          AND risk_tier IN ('CRITICAL', 'HIGH') AND anomaly_probability BETWEEN 95 AND 100""",
        "order_results": f"""{audited} SELECT user_id, event_date, round(priority_score, 6) AS priority_score,
          anomaly_probability FROM marked WHERE anomaly = 1 AND risk_tier IN ('CRITICAL', 'HIGH')
          ORDER BY priority_score DESC""",
        "stream_score": f"""WITH {EVENTS_SCORED} SELECT event_id, event_type, value,
          {r("anomaly_score")}, round(anomaly_score, 6) AS zscore_value, round(anomaly_score, 6) AS max_zscore,
          anomaly, anomaly_probability, {TIER} AS risk_tier FROM scored_events""",
        "stream_daily_rate": f"""WITH {EVENT_DAYS},
          s AS (SELECT CAST(unnest(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS DATE) AS day FROM t)
          SELECT day, COALESCE(anomalies, 0) AS anomalies, COALESCE(total, 0) AS total,
            COALESCE(round(anomalies / total * 100, 6), 0) AS anomaly_rate FROM s LEFT JOIN t USING (day)""",
        "stream_alert": f"""WITH {EVENT_DAYS},
          b AS (SELECT SUM(anomalies) / SUM(total) * 100 AS base FROM t),
          e AS (SELECT MAX(ts) - INTERVAL 1 DAY AS watermark FROM events)
          SELECT day, anomalies, total, round(anomalies / total * 100, 6) AS anomaly_rate,
            round(base, 6) AS baseline_rate, round(base * 1.5, 6) AS alert_rate,
            round(anomalies / total * 100 / base, 6) AS ratio
          FROM t, b, e WHERE anomalies / total * 100 > base * 1.5 AND day + INTERVAL 1 DAY <= watermark""",
        "dbscan": f"""{DENSITY} SELECT c_custkey, cluster, core, anomaly, round(anomaly_score, 6) AS anomaly_score,
          anomaly_probability, {TIER} AS risk_tier
          FROM (SELECT *, {probability("anomaly_score")} AS anomaly_probability FROM judged)""",
        "batch_detect": f"""{BATCH_Z} SELECT event_id, value, source_file, anomaly,
          round(anomaly_score, 6) AS anomaly_score, anomaly_probability, risk_tier FROM batch_scored""",
        "batch_detect_iqr": f"""{BATCH_IQR} SELECT event_id, value, source_file, anomaly,
          round(anomaly_score, 6) AS anomaly_score, anomaly_probability, risk_tier FROM batch_scored""",
        "batch_summary": f"""{BATCH_Z} SELECT source_file, COUNT(*) AS total_records,
          CAST(SUM(anomaly) AS BIGINT) AS anomalies,
          {", ".join(f"COUNT(*) FILTER (risk_tier = '{t}') AS {t.lower()}_rows" for t in TIERS)},
          round(MAX(anomaly_score), 6) AS highest_score,
          round(CAST(SUM(anomaly) AS BIGINT) / COUNT(*) * 100, 6) AS anomaly_rate
          FROM batch_scored GROUP BY 1""",
        "sample_rows": f"""SELECT o_orderkey, o_totalprice FROM orders
          ORDER BY {_hash(("o_orderkey",), 42)}, o_orderkey LIMIT 1000""",
        "scatter_sample": f"""{scored} user_id, event_date, value_sum, event_count, anomaly FROM scored
          ORDER BY {_hash(DAY_KEY, 42)}, user_id, event_date LIMIT 10000""",
        "review_sample": f"""{scored} user_id, event_date, value_sum, event_count, anomaly, risk_tier
          FROM scored WHERE anomaly = 1 ORDER BY {_hash(DAY_KEY, 42)}, user_id, event_date LIMIT 20""",
        "rollup_metric_rule_avg": """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate,
          round(AVG(l_tax), 6) AS tax_rate, round(SUM(l_discount), 6) AS discount_pct,
          round(AVG(l_extendedprice), 6) AS avg_price, CAST(SUM(l_linenumber) AS BIGINT) AS line,
          'avg_price:avg,discount_pct:sum,line:sum,tax_rate:avg' AS rules FROM lineitem GROUP BY 1, 2""",
        "detector_registry_exact": f"""WITH {SCORED}, {FENCE_TABLE},
          i AS (SELECT CASE WHEN value_sum < lov OR value_sum > hiv OR event_count < loc OR event_count > hic
                 THEN 1 ELSE 0 END AS anomaly FROM user_day, f),
          l AS ({LOF})
          SELECT 'zscore' AS method, 'statistical' AS kind, COUNT(*) AS rows, CAST(SUM(anomaly) AS BIGINT) AS anomalies FROM scored
          UNION ALL SELECT 'iqr', 'statistical', COUNT(*), CAST(SUM(anomaly) AS BIGINT) FROM i
          UNION ALL SELECT 'lof', 'ml', COUNT(*), CAST(SUM(anomaly) AS BIGINT) FROM l""",
        "isolation_forest": _forest(),
        "profile_sketches": f"""SELECT *, true AS estimate_is_close FROM ({_profile()})""",
    }
