"""The registered queries stated in SQL over the plain tables, for checking results."""

from __future__ import annotations

from itertools import combinations

from flowlab.fixtures import with_clause
from flowlab.schemas import COMPARED_METRICS, FEATURES, LADDER, LONG_LADDER, SAMPLE_COLUMNS

ODD = "Flow_Bytes_per_s"
KEYS = ["k1", "k2", "k3", "k4"]
KEY_LIST = ", ".join(KEYS)
KEY_TEXT = "concat_ws('|', {seed}" + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEYS) + ")"
INF, NEG_INF = "CAST('Infinity' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)"
TARGET = "CASE WHEN Label IS NULL OR upper(trim(Label)) <> 'BENIGN' THEN 1 ELSE 0 END AS is_attack"
OTHERS = [f for f in FEATURES if f != ODD]
BASE_COLUMNS = [*KEYS, "source_file", *OTHERS, "Average_Packet_Size"]
DAY = "CAST(CAST(flow_ts AS DATE) AS VARCHAR) AS flow_day"


def odd(expression: str = ODD) -> str:
    """A column that may hold NaN or Infinity, as a finite value and a kind."""
    kind = (
        f"CASE WHEN {expression} IS NULL THEN 'null' WHEN isnan({expression}) THEN 'nan' "
        f"WHEN {expression} = {INF} THEN '+inf' WHEN {expression} = {NEG_INF} THEN '-inf' ELSE 'number' END"
    )
    return f"CASE WHEN {kind} = 'number' THEN {expression} END AS {ODD}, {kind} AS {ODD}_kind"


FINITE = f"CASE WHEN isfinite({ODD}) THEN {ODD} END"
FLOWS = with_clause("flows")
SAMPLE = with_clause("sample_flows")
SCORED = with_clause("scored")
RUNS = with_clause("run_metrics")
GOLD = (
    FLOWS + f", gold AS (SELECT {KEY_LIST}, flow_ts, source_file, {', '.join(FEATURES)}, "
    f"Average_Packet_Size, {TARGET} FROM (SELECT DISTINCT * FROM flows))"
)
# Rows per feature, finite value and class.
LONG = GOLD + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, is_attack FROM gold"
    + (f" WHERE isfinite({ODD})" if f == ODD else "")
    for f in FEATURES
) + ")"
COUNTS = LONG + """, counts AS (
SELECT feature, value, sum(1 - is_attack)::DOUBLE AS n0, sum(is_attack)::DOUBLE AS n1 FROM long GROUP BY feature, value
), aucs AS (
SELECT feature, sum(n1 * (below + n0 / 2)) / (sum(n1) * sum(n0)) AS auc FROM (
  SELECT *, sum(n0) OVER (PARTITION BY feature ORDER BY value) - n0 AS below FROM counts
) GROUP BY feature)"""
EFFECTS = """, moments AS (
SELECT feature, is_attack, count(*) AS n, avg(value) AS m, var_samp(value) AS v, median(value) AS med FROM long GROUP BY feature, is_attack
), effects AS (
SELECT a.feature, n.n AS normal_count, a.n AS attack_count, n.m AS normal_mean, a.m AS attack_mean,
       n.med AS normal_median, a.med AS attack_median,
       coalesce(abs(n.m - a.m) / nullif(sqrt(((n.n - 1) * n.v + (a.n - 1) * a.v) / (n.n + a.n - 2)), 0), 0) AS d
FROM moments n JOIN moments a ON n.feature = a.feature AND n.is_attack = 0 AND a.is_attack = 1)"""


def bucket(seed: str, text: str = KEY_TEXT) -> str:
    body = text.format(seed=f"'{seed}', " if seed else "")
    return f"CAST('0x' || substr(md5({body}), 1, 15) AS BIGINT)"


def edge(fraction: float) -> int:
    return round(fraction * 16**15)


DIGEST = f"md5({KEY_TEXT.format(seed='')})"
# Exact stratified quota of :size rows by largest remainder, then the smallest digests per class.
STRATA = """, totals AS (SELECT is_attack, count(*)::HUGEINT AS n, sum(count(*)) OVER ()::HUGEINT AS total FROM gold GROUP BY is_attack),
sized AS (SELECT *, {size} AS size FROM totals),
shares AS (SELECT is_attack, size, (size * n) // total AS base, (size * n) % total AS rest FROM sized),
quotas AS (SELECT is_attack, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, is_attack) <= size - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
placed AS (SELECT g.*, row_number() OVER (PARTITION BY g.is_attack ORDER BY {digest}, k1, k2, k3, k4) <= quota AS picked FROM gold g JOIN quotas q ON g.is_attack = q.is_attack)"""
ORDERED = GOLD + """, placed AS (SELECT *, row_number() OVER (ORDER BY flow_ts, k1, k2, k3, k4, Fwd_Packets_Length_Total) AS place, count(*) OVER () AS total FROM gold)"""

FINITE_GOLD = GOLD + f", finite AS (SELECT *, {bucket('split')} < {edge(0.8)} AS in_train FROM gold WHERE isfinite({ODD}))"


def _scaled(centre: bool, deviation: str) -> str:
    fits = ", ".join(f"avg({f}) AS m_{f}, {deviation}({f}) AS s_{f}" for f in FEATURES)
    columns = ", ".join(
        f"round(({f}{f' - m_{f}' if centre else ''}) / s_{f}, 6) AS {f}" for f in FEATURES
    )
    return f"{FINITE_GOLD}, fit AS (SELECT {fits} FROM finite WHERE in_train) SELECT {KEY_LIST}, {columns} FROM finite, fit"


COMPLETE = GOLD + ", complete AS (SELECT " + ", ".join(
    f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES
) + f" FROM gold WHERE isfinite({ODD}))"


def _correlation(a: str, b: str) -> str:
    return f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


PAIRS = COMPLETE + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {_correlation(a, b)} AS correlation FROM complete"
    for a, b in combinations(FEATURES, 2)
) + ")"

CELLS = SCORED + """, cells AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM scored)"""
BY_SCORE = SCORED + """, by_score AS (SELECT score, sum(1 - label)::DOUBLE AS n0, sum(label)::DOUBLE AS n1 FROM scored GROUP BY score)"""


def _weighted(score: str) -> str:
    return (
        f"WITH_CELLS, classes AS (SELECT tn AS t, tn + fn AS q, tn + fp AS c FROM cells UNION ALL SELECT tp, tp + fp, tp + fn FROM cells), "
        "pr AS (SELECT c, coalesce(t::DOUBLE / nullif(q, 0), 0) AS p, coalesce(t::DOUBLE / nullif(c, 0), 0) AS r FROM classes) "
        f"SELECT {score} FROM pr"
    ).replace("WITH_CELLS", CELLS)


def _rungs(source: str, fractions, sample: str, side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({f} AS DOUBLE) AS fraction, count(*) AS n_rows, count(*) FILTER ({side} < {edge(0.8)}) AS train_rows, "
        f"count(*) FILTER ({side} >= {edge(0.8)}) AS test_rows FROM {source} WHERE {sample} < {edge(f)}"
        for f in fractions
    )


def _text_second(columns) -> str:
    return ", ".join("substr(timestamp, 1, 19) AS timestamp" if c == "timestamp" else c for c in columns)


NUMBER = {c: f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ("src_port", "dst_port", "packet_count", "bytes")}
STRIPPED = {c: f"upper(trim({c})) AS {c}" for c in ("protocol", "label")}
SILVER = FLOWS + f", silver AS (SELECT {', '.join([*BASE_COLUMNS, ODD, 'flow_ts'])}, upper(trim(Label)) AS Label FROM (SELECT DISTINCT * FROM flows))"
ROBUST_KEYS = "concat_ws('|', {seed}" + ", ".join(
    f"CAST({c} AS VARCHAR)" for c in ("Flow_Duration", "Protocol", "Total_Fwd_Packets", "Total_Backward_Packets")
) + ")"
DOUBLES = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in OTHERS)
FLOW_COLUMNS = f"{', '.join([*BASE_COLUMNS, 'Empty_Column', 'Label'])}, {DAY}, {odd()}"
GOLD_ROW = f"{KEY_LIST}, source_file, {', '.join(OTHERS)}, Average_Packet_Size, is_attack, {DAY}"
HEAD_COLUMNS = ", ".join(FEATURES) + ", is_attack"
RUN = "condition, algorithm, dataset_size"
SIZE_ORDER = "CAST(list_position(['10%', '25%', '50%', '75%', '100%'], dataset_size) AS BIGINT)"
RULES = {
    "timestamp is not null": "timestamp IS NULL", "src_ip is not null": "src_ip IS NULL",
    "dst_ip is not null": "dst_ip IS NULL", "protocol is not null": "protocol IS NULL",
    **{f"{c} >= 0": f"coalesce(NOT (TRY_CAST({c} AS DOUBLE) >= 0), true)" for c in ("src_port", "dst_port", "packet_count", "bytes")},
}
NULL_COLUMNS = [*KEYS, "flow_ts", "source_file", *FEATURES, "Average_Packet_Size", "Empty_Column", "Label"]
MISSING = {c: f"{c} IS NULL" for c in NULL_COLUMNS} | {ODD: f"{ODD} IS NULL OR isnan({ODD})"}

# Spark's names for the column types of the flow view, by position.
FLOW_TYPES = {
    "k1": "bigint", "k2": "bigint", "k3": "bigint", "k4": "int", "flow_ts": "timestamp_ntz",
    "source_file": "string", "Protocol": "int", "Flow_Duration": "bigint", "Total_Fwd_Packets": "bigint",
    "Total_Backward_Packets": "bigint", "Fwd_Packets_Length_Total": "double",
    "Bwd_Packets_Length_Total": "double", "Flow_Bytes_per_s": "double", "Flow_Packets_per_s": "double",
    "Packet_Length_Mean": "double", "Packet_Length_Std": "double", "Average_Packet_Size": "double",
    "Empty_Column": "double", "Label": "string",
}


def _measure_entries(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_values, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, "
        f"round(min(CAST({c} AS DOUBLE)), 4) AS min, round(max(CAST({c} AS DOUBLE)), 4) AS max FROM gold"
        for c in columns
    )


def _robust() -> str:
    full = (
        f"{RUNS}, o AS (SELECT * FROM run_metrics WHERE dataset_size = '100%' AND condition = 'Original'), "
        "d AS (SELECT * FROM run_metrics WHERE dataset_size = '100%' AND condition = 'Deduplicated') "
    )
    return full + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, o.algorithm, round((1 - d.n_rows / o.n_rows::DOUBLE) * 100, 6) AS rows_removed_percent, "
        f"round(o.{m}, 6) AS old_value, round(d.{m}, 6) AS new_value, round(d.{m} - o.{m}, 6) AS difference, "
        + (f"abs(d.{m} - o.{m}) < 0.005e0" if m in ("f1", "roc_auc") else "CAST(NULL AS BOOLEAN)")
        + " AS is_stable FROM o JOIN d ON o.algorithm = d.algorithm"
        for m in COMPARED_METRICS
    )




def _except(kind: str) -> str:
    return f"{FLOWS} SELECT {FLOW_COLUMNS} FROM (SELECT * FROM flows {kind} SELECT * FROM flows_base WHERE source_file = 'botnet')"


# --- logistic regression: Newton steps, each an aggregate and a Gauss-Jordan elimination on one row -----------

SIZE = len(FEATURES) + 1
PREPARED = GOLD + f", prepared AS (SELECT {KEY_LIST}, source_file, " + ", ".join(
    f"CASE WHEN isfinite({f}) THEN {f} ELSE 0 END AS {f}" if f == ODD else f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES
) + f", CAST(is_attack AS DOUBLE) AS y, {bucket('split')} < {edge(0.8)} AS in_train FROM gold)"


def _newton(penalty: float, spread: str, steps: int = 8) -> str:
    """Ends with a relation `weights` of one row: b, the list of intercept and coefficients."""
    z = [f"z{i}" for i in range(1, SIZE)]
    moments = ", ".join(f"avg({f}) AS m{i}, {spread}({f}) AS d{i}" for i, f in enumerate(FEATURES, 1))
    scaled = ", ".join(f"({f} - m{i}) / d{i} AS z{i}" for i, f in enumerate(FEATURES, 1))
    parts = [
        PREPARED + f", moments AS MATERIALIZED (SELECT {moments} FROM prepared WHERE in_train)",
        f"z AS MATERIALIZED (SELECT p.*, {scaled} FROM prepared p, moments)",
        f"b0 AS MATERIALIZED (SELECT list_transform(range(0, {SIZE}), lambda i: 0e0) AS b)",
    ]
    x = ["1e0", *z]
    eta = " + ".join(["b[1]", *(f"b[{i}] * {c}" for i, c in enumerate(z, 2))])
    for s in range(1, steps + 1):
        upper = [f"sum(w * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(SIZE) for j in range(i, SIZE)]
        sums = ", ".join([*(f"sum(r * {c}) AS g{i}" for i, c in enumerate(x)), *upper])
        parts.append(
            f"sums{s} AS MATERIALIZED (SELECT {sums} FROM (SELECT {', '.join(z)}, y - p AS r, p * (1 - p) AS w FROM "
            f"(SELECT {', '.join(z)}, y, 1 / (1 + exp(-({eta}))) AS p FROM z, b{s - 1} WHERE in_train)))"
        )
        rows = ", ".join(
            "[" + ", ".join(
                [f"h{min(i, j)}_{max(i, j)}" + (f" + {penalty}e0" if i == j and i else "") for j in range(SIZE)]
                + [f"g{i}" + (f" - {penalty}e0 * b[{i + 1}]" if i else "")]
            ) + "]" for i in range(SIZE)
        )
        parts.append(f"e{s}_0 AS MATERIALIZED (SELECT [{rows}] AS m FROM sums{s}, b{s - 1})")
        for k in range(1, SIZE + 1):
            parts.append(
                f"e{s}_{k} AS MATERIALIZED (SELECT list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / r[{k}]) "
                f"ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m FROM e{s}_{k - 1})"
            )
        parts.append(f"b{s} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v + m[i][{SIZE + 1}]) AS b FROM b{s - 1}, e{s}_{SIZE})")
    return ", ".join([*parts, f"weights AS (SELECT b FROM b{steps})"])


def _coefficients(penalty: float, spread: str) -> str:
    names = ", ".join(f"'{f}'" for f in ("(intercept)", *FEATURES))
    return _newton(penalty, spread) + f" SELECT unnest([{names}]) AS feature, round(unnest(b), 6) AS coefficient FROM weights"


LOGREG_SCORES = _newton(0, "stddev_samp") + f""" SELECT {KEY_LIST}, CAST(y AS INTEGER) AS label, round(p, 6) AS score, CAST(p > 0.5 AS INTEGER) AS prediction
FROM (SELECT *, 1 / (1 + exp(-(b[1] + {' + '.join(f'b[{i + 1}] * z{i}' for i in range(1, SIZE))}))) AS p FROM z, weights WHERE NOT in_train)"""


def _binned(bins: int) -> str:
    return f"""SELECT {bins} AS bins, round(sum(n1 * (below + n0 / 2)) / (max(t1) * max(t0)), 6) AS roc_auc,
  round(sum(n1 / t1 * (hits / (hits + misses) + coalesce((hits - n1) / nullif(hits + misses - n1 - n0, 0), hits / (hits + misses))) / 2), 6) AS pr_auc
FROM (SELECT *, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1, sum(n0) OVER (ORDER BY grp DESC) - n0 AS below,
             sum(n1) OVER (ORDER BY grp) AS hits, sum(n0) OVER (ORDER BY grp) AS misses
      FROM (SELECT CASE WHEN total // {bins} < 2 THEN place ELSE place // (total // {bins}) END AS grp, sum(n0) AS n0, sum(n1) AS n1
            FROM (SELECT *, row_number() OVER (ORDER BY score DESC) - 1 AS place, count(*) OVER () AS total FROM by_score) GROUP BY grp))"""


BINNED = SCORED + (
    ", by_score AS (SELECT score, sum(1 - label)::DOUBLE AS n0, sum(label)::DOUBLE AS n1 FROM scored GROUP BY score) "
    + _binned(1000) + " UNION ALL " + _binned(40)
)
# --- trees: one block of common table expressions per level ----------------------------------------------------

# As in queries.py: (drawn rows, features a node chooses from, features left out) per tree.
BOOTSTRAP = [(True, 4, ())] * 3
ABLATION = [(False, 10, ()), *((False, 10, (i,)) for i in range(10))]
# The distribution function of the Poisson law with mean 1.
POISSON = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406]


def _trees(specs: list, depth: int = 4, bins: int = 32) -> str:
    """Ends with a relation `nodes`; `rows` are the prepared rows of both sides."""
    def weight(i: int, draw: bool) -> str:
        return " + ".join(f"({bucket(f'tree{i}')} >= {edge(p)})::INTEGER" for p in POISSON) if draw else "1"

    def purity(side: str) -> str:
        return f"({side}0::DOUBLE * {side}0 + {side}1::DOUBLE * {side}1) / ({side}0 + {side}1)"

    counts = " UNION ALL ".join(f"SELECT {i} AS feature, {f} AS value, count(*) AS n FROM rows WHERE in_train GROUP BY value" for i, f in enumerate(FEATURES))
    lists = ", ".join(f"coalesce(list(threshold ORDER BY threshold) FILTER (feature = {i}), []) AS t{i}" for i in range(len(FEATURES)))
    numbers = ", ".join(f"len(list_filter(t{i}, lambda v: v < {f}))" for i, f in enumerate(FEATURES))
    allowed = ", ".join(f"({i}, {f}, {c})" for i, (_, c, out) in enumerate(specs) for f in range(len(FEATURES)) if f not in out)
    drawn = " UNION ALL ".join(f"SELECT y, bins, {i} AS tree, {weight(i, draw)} AS w FROM binned" for i, (draw, _, _) in enumerate(specs))
    parts = [
        PREPARED + ", rows AS MATERIALIZED (SELECT * EXCLUDE (y), (Fwd_Packets_Length_Total > 1500 * Total_Fwd_Packets)::INTEGER AS y FROM prepared)",
        f"places AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value) - n AS below, sum(n) OVER (PARTITION BY feature) AS total FROM ({counts}))",
        f"limits AS MATERIALIZED (SELECT feature, value AS threshold, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS bin FROM places "
        f"WHERE least((below + n) * {bins} // total, {bins - 1}) > below * {bins} // total AND below + n < total)",
        f"lists AS MATERIALIZED (SELECT {lists} FROM limits)",
        f"binned AS MATERIALIZED (SELECT {KEY_LIST}, y, [{numbers}] AS bins FROM rows, lists WHERE in_train)",
        f"allowed AS (SELECT * FROM (VALUES {allowed}) v(tree, feature, choice))",
        f"level0 AS MATERIALIZED (SELECT *, 1 AS node FROM ({drawn}) WHERE w > 0)",
    ]
    ends = ["SELECT tree, node, sum(w * (1 - y)) AS n0, sum(w * y) AS n1 FROM level0 GROUP BY tree, node"]
    for d in range(depth):
        parts += [
            f"hist{d} AS (SELECT tree, node, feature, bins[feature + 1] AS bin, sum(w * (1 - y)) AS c0, sum(w * y) AS c1 "
            f"FROM (SELECT *, unnest(range(0, {len(FEATURES)})) AS feature FROM level{d}) GROUP BY tree, node, feature, bin)",
            f"sums{d} AS (SELECT *, n0 - l0 AS r0, n1 - l1 AS r1 FROM (SELECT tree, node, feature, bin, sum(c0) OVER (o ORDER BY bin) AS l0, "
            f"sum(c1) OVER (o ORDER BY bin) AS l1, sum(c0) OVER o AS n0, sum(c1) OVER o AS n1 FROM hist{d} WINDOW o AS (PARTITION BY tree, node, feature)))",
            f"chosen{d} AS (SELECT *, dense_rank() OVER (PARTITION BY tree, node ORDER BY md5(concat_ws('|', 'subset', tree, node, feature)), feature) AS place "
            f"FROM sums{d} JOIN allowed USING (tree, feature))",
            f"best{d} AS MATERIALIZED (SELECT tree, node, feature, bin, threshold, l0, l1, r0, r1, gain FROM (SELECT *, "
            f"({purity('l')} + {purity('r')} - {purity('n')}) / (n0 + n1)::DOUBLE AS gain FROM chosen{d} WHERE place <= choice AND r0 + r1 > 0) "
            f"JOIN limits USING (feature, bin) WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, bin) = 1)",
            f"level{d + 1} AS MATERIALIZED (SELECT y, bins, tree, w, 2 * node + (bins[feature + 1] > bin)::INTEGER AS node FROM level{d} JOIN best{d} USING (tree, node))",
        ]
        ends += [f"SELECT tree, 2 * node, l0, l1 FROM best{d}", f"SELECT tree, 2 * node + 1, r0, r1 FROM best{d}"]
    splits = " UNION ALL ".join(f"SELECT tree, node, feature, threshold, gain FROM best{d}" for d in range(depth))
    parts.append(
        f"nodes AS MATERIALIZED (SELECT tree, node::INTEGER AS node, feature, threshold, CASE WHEN feature IS NOT NULL THEN 2 * node END::INTEGER AS \"left\", "
        f"CASE WHEN feature IS NOT NULL THEN 2 * node + 1 END::INTEGER AS \"right\", n0::DOUBLE AS n0, n1::DOUBLE AS n1, coalesce(gain, 0) AS gain "
        f"FROM ({' UNION ALL '.join(ends)}) LEFT JOIN ({splits}) USING (tree, node))"
    )
    return ", ".join(parts)


def _scored(specs: list, depth: int = 4) -> str:
    """As _trees, then `scored`: the score of each test row in each tree."""
    values = f"[{', '.join(FEATURES)}]"
    step = "SELECT s.* EXCLUDE (node), CASE WHEN n.feature IS NULL THEN s.node WHEN s.x[n.feature + 1] <= n.threshold THEN n.\"left\" ELSE n.\"right\" END AS node FROM {before} s JOIN nodes n USING (tree, node)"
    parts = [_trees(specs, depth), f"walk0 AS (SELECT {KEY_LIST}, y, {values} AS x, tree, 1 AS node FROM rows, (SELECT DISTINCT tree FROM nodes) WHERE NOT in_train)"]
    parts += [f"walk{d + 1} AS (" + step.format(before=f"walk{d}") + ")" for d in range(depth)]
    parts.append(f"scored AS (SELECT s.*, n1 / (n0 + n1) AS score FROM walk{depth} s JOIN nodes USING (tree, node))")
    return ", ".join(parts)


FOREST_NODES = _trees(BOOTSTRAP) + ' SELECT tree, node, feature, round(threshold, 6) AS threshold, "left", "right", n0, n1, round(gain, 9) AS gain FROM nodes'
FOREST_IMPORTANCE = _trees(BOOTSTRAP) + f""", shares AS (
  SELECT feature, sum(share) AS share FROM (
    SELECT feature, fall / sum(fall) OVER (PARTITION BY tree) AS share FROM (
      SELECT tree, feature, sum(gain * (n0 + n1)) AS fall FROM nodes WHERE feature IS NOT NULL GROUP BY tree, feature
    )) GROUP BY feature
), names AS (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS name, unnest(range(0, {len(FEATURES)})) AS feature)
SELECT name AS feature, round(coalesce(share, 0) / sum(share) OVER (), 6) AS importance FROM names LEFT JOIN shares USING (feature)"""
FOREST_SCORES = _scored(BOOTSTRAP) + f" SELECT {KEY_LIST}, y AS label, round(avg(score), 6) AS score FROM scored GROUP BY {KEY_LIST}, y"
TREE_ABLATION = _scored(ABLATION) + f""" SELECT (['none', {', '.join(f"'{f}'" for f in FEATURES)}])[tree + 1] AS removed_feature,
  count(*) FILTER (y = 0 AND score <= 0.5) AS tn, count(*) FILTER (y = 0 AND score > 0.5) AS fp,
  count(*) FILTER (y = 1 AND score <= 0.5) AS fn, count(*) FILTER (y = 1 AND score > 0.5) AS tp FROM scored GROUP BY tree"""

WITH_TOTAL = [*FEATURES, "Packets_Length_Total"]
STRONG = COMPLETE + ", wider AS (SELECT *, Fwd_Packets_Length_Total + Bwd_Packets_Length_Total AS Packets_Length_Total FROM complete), pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {_correlation(a, b)} AS correlation FROM wider" for a, b in combinations(WITH_TOTAL, 2)
) + ") SELECT feature_1, feature_2, round(correlation, 6) AS correlation, count(*) OVER () AS n_pairs, row_number() OVER (ORDER BY abs(correlation) DESC, feature_1, feature_2) = 1 AS is_strongest FROM pairs WHERE abs(correlation) >= 0.7"

# What each column of the sample's text holds.
CSV_TYPES = {
    "timestamp": "timestamp_ntz", "src_ip": "string", "dst_ip": "string", "src_port": "string", "dst_port": "bigint",
    "protocol": "string", "packet_count": "bigint", "bytes": "double", "label": "string",
}
TYPED = SAMPLE + """ SELECT label, count(*) AS n_rows, CAST(sum(TRY_CAST(src_port AS BIGINT)) AS BIGINT) AS src_port, CAST(sum(CAST(packet_count AS BIGINT)) AS BIGINT) AS packets,
round(sum(CAST(bytes AS DOUBLE)), 2) AS bytes, CAST(CAST(max(CAST(timestamp AS TIMESTAMP)) AS DATE) AS VARCHAR) AS last_day FROM sample_flows GROUP BY label"""
MERGED = """SELECT true AS is_order, count(*) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS sum_custkey, count(*) AS n_amounts,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, 0::BIGINT AS n_segments FROM orders
UNION ALL SELECT false, count(*), CAST(sum(c_custkey) AS BIGINT), 0, NULL, count(c_mktsegment) FROM customer"""

EXACT_COUNTS = GOLD + """, counts AS (
  SELECT source_file, is_attack, count(*)::HUGEINT AS n, sum(count(*)) OVER (PARTITION BY source_file)::HUGEINT AS total
  FROM gold GROUP BY source_file, is_attack
), sized AS (
  SELECT *, (size * n) // total AS base, (size * n) % total AS rest
  FROM counts, (SELECT unnest([2500, 10000, 100000, 250000, 500000, 750000])::BIGINT AS size) WHERE size <= total
)
SELECT source_file, size AS dataset_size, is_attack, CAST(base + CASE WHEN row_number() OVER (PARTITION BY source_file, size ORDER BY rest DESC, is_attack)
  <= size - sum(base) OVER (PARTITION BY source_file, size) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM sized"""

SQL: dict[str, str] = {
    "csv_scan": f"{SAMPLE} SELECT {_text_second(SAMPLE_COLUMNS)} FROM sample_flows",
    "bronze_csv_to_parquet": f"{SAMPLE} SELECT {_text_second(SAMPLE_COLUMNS)} FROM sample_flows",
    "bronze_ingest": "SELECT 'lineitem.parquet' AS source_file, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey FROM lineitem",
    "scan_by_source": f"{FLOWS} SELECT source_file, Label, count(*) AS n_rows, CAST(sum(Flow_Duration) AS BIGINT) AS sum_duration FROM flows WHERE source_file = 'botnet' GROUP BY source_file, Label",
    "recursive_scan": "SELECT count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey FROM lineitem",
    "silver_write": f"{SILVER} SELECT {', '.join(BASE_COLUMNS)}, Label, {DAY}, {odd()} FROM silver",
    "gold_write": f"{SILVER} SELECT source_file, {', '.join(OTHERS)}, Average_Packet_Size, {TARGET}, {odd()} FROM silver",
    "raw_to_gold": f"""{SILVER} SELECT is_attack, count(*) AS n_rows, CAST(sum(Flow_Duration) AS BIGINT) AS sum_duration,
        CAST(sum(Total_Fwd_Packets) AS BIGINT) AS sum_packets, count({ODD}) AS n_rates, count(*) FILTER (isnan({ODD})) AS n_nan,
        count(*) FILTER (isinf({ODD})) AS n_infinite FROM (SELECT *, {TARGET} FROM silver) GROUP BY is_attack""",
    "sample_raw_to_gold": f"""{SAMPLE} SELECT upper(trim(protocol)) AS protocol, CAST(upper(trim(label)) <> 'BENIGN' AS INTEGER) AS is_attack, count(*) AS n_rows,
        round(sum(CASE WHEN src_port = 'n/a' THEN 0 ELSE CAST(src_port AS DOUBLE) END), 2) AS sum_ports, round(sum(CAST(packet_count AS DOUBLE)), 2) AS packets,
        round(sum(CAST(bytes AS DOUBLE)), 2) AS bytes, CAST(CAST(max(CAST(timestamp AS TIMESTAMP)) AS DATE) AS VARCHAR) AS last_day
        FROM (SELECT DISTINCT * FROM sample_flows) GROUP BY ALL""",
    "sample_gold": f"""{SAMPLE}, typed AS (SELECT strftime(CAST(timestamp AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS timestamp, src_ip, dst_ip,
{', '.join(NUMBER.values())}, {', '.join(STRIPPED.values())} FROM (SELECT DISTINCT * FROM sample_flows))
SELECT timestamp, src_ip, dst_ip, src_port, dst_port, packet_count, round(bytes, 6) AS bytes, protocol, label,
round(bytes / nullif(packet_count + 1, 0), 6) AS duration_bytes, CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END AS is_attack FROM typed""",
    "result_sink": f"{RUNS} SELECT {RUN}, fraction, n_rows, train_rows, test_rows, " + ", ".join(
        f"round({m}, 6) AS {m}" for m in COMPARED_METRICS) + " FROM run_metrics",
    "feature_projection": f"{FLOWS} SELECT {', '.join(OTHERS)}, {TARGET}, {odd()} FROM flows",
    "gold_projection": f"{FLOWS} SELECT {KEY_LIST}, {', '.join(OTHERS)}, Average_Packet_Size, {TARGET}, {odd()} FROM flows",
    "normalise_columns": f"{FLOWS} SELECT {FLOW_COLUMNS} FROM flows",
    "drop_empty_columns": f"{FLOWS} SELECT {', '.join([*BASE_COLUMNS, 'Label'])}, {DAY}, {odd()} FROM flows",
    "normalise_strings": f"{SAMPLE} SELECT src_ip, dst_ip, {', '.join(STRIPPED.values())} FROM sample_flows",
    "parse_timestamp": f"{SAMPLE} SELECT strftime(CAST(timestamp AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS timestamp, src_ip, dst_ip FROM sample_flows",
    "coerce_numeric": f"{SAMPLE} SELECT src_ip, dst_ip, protocol, label, {', '.join(NUMBER.values())} FROM sample_flows",
    "cast_features": f"{GOLD} SELECT {KEY_LIST}, source_file, {DOUBLES}, Average_Packet_Size, CAST(is_attack AS DOUBLE) AS is_attack, {DAY}, {odd()} FROM gold",
    "zero_fill_nan": f"{GOLD}, filled AS (SELECT * REPLACE (CASE WHEN {ODD} IS NULL OR isnan({ODD}) THEN 0e0 ELSE {ODD} END AS {ODD}) FROM gold) SELECT {KEY_LIST}, source_file, {DOUBLES}, Average_Packet_Size, is_attack, {DAY}, {odd()} FROM filled",
    "zero_fill_inf": f"{GOLD}, filled AS (SELECT * REPLACE (CASE WHEN {ODD} IS NULL OR isinf({ODD}) THEN 0e0 ELSE {ODD} END AS {ODD}) FROM gold) SELECT {KEY_LIST}, source_file, {DOUBLES}, Average_Packet_Size, is_attack, {DAY}, {odd()} FROM filled",
    "inf_to_null": f"{GOLD}, filled AS (SELECT * REPLACE ({FINITE} AS {ODD}) FROM gold) SELECT {KEY_LIST}, source_file, {DOUBLES}, Average_Packet_Size, is_attack, {DAY}, {odd()} FROM filled",
    "drop_incomplete": f"{GOLD} SELECT {GOLD_ROW}, {odd()} FROM gold WHERE NOT ({MISSING[ODD]})",
    "drop_null_label": f"{FLOWS} SELECT {FLOW_COLUMNS} FROM flows WHERE Label IS NOT NULL",
    "feature_not_null": f"{GOLD} SELECT {GOLD_ROW}, {odd()} FROM gold WHERE {ODD} IS NOT NULL",
    "ratio_feature": f"{SAMPLE}, typed AS (SELECT src_ip, dst_ip, {', '.join(NUMBER.values())} FROM sample_flows) SELECT src_ip, dst_ip, packet_count, round(bytes, 6) AS bytes, round(bytes / nullif(packet_count + 1, 0), 6) AS duration_bytes FROM typed",
    "binary_target": f"{FLOWS} SELECT {KEY_LIST}, upper(trim(Label)) AS Label, {TARGET} FROM flows",
    "dedup_full_row": f"{FLOWS} SELECT {FLOW_COLUMNS} FROM (SELECT DISTINCT * FROM flows)",
    "dedup_gold": f"{FLOWS} SELECT {', '.join(OTHERS)}, Average_Packet_Size, is_attack, {odd()} FROM (SELECT DISTINCT {', '.join(FEATURES)}, Average_Packet_Size, {TARGET} FROM flows)",
    "dedup_projected": f"{FLOWS} SELECT {', '.join(OTHERS)}, is_attack, {odd()} FROM (SELECT DISTINCT {', '.join(FEATURES)}, {TARGET} FROM flows)",
    "dedup_after_clean": f"{FLOWS}, cleaned AS (SELECT DISTINCT {DOUBLES}, CASE WHEN {ODD} IS NULL OR isinf({ODD}) THEN 0e0 ELSE {ODD} END AS {ODD}, CAST(CASE WHEN Label IS NULL OR upper(trim(Label)) <> 'BENIGN' THEN 1 ELSE 0 END AS DOUBLE) AS is_attack FROM flows) SELECT {', '.join(OTHERS)}, is_attack, {odd()} FROM cleaned",
    "duplicate_report": f"{FLOWS}, t AS (SELECT {', '.join(FEATURES)}, {TARGET} FROM flows), r AS (SELECT (SELECT count(*) FROM t) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS unique_rows) SELECT total_rows, unique_rows, total_rows - unique_rows AS duplicate_rows, round(100e0 * (total_rows - unique_rows) / total_rows, 6) AS duplicate_rate FROM r",
    "except_distinct": _except("EXCEPT"),
    "except_all": _except("EXCEPT ALL"),
    "exact_size_counts": EXACT_COUNTS,
    "logreg_coefficients": _coefficients(0, "stddev_samp"),
    "logreg_l2_coefficients": _coefficients(1, "stddev_pop"),
    "logreg_scores": LOGREG_SCORES,
    "binned_auc": BINNED,
    "strong_pairs": STRONG,
    "csv_types": " UNION ALL ".join(
        f"SELECT '{t}' AS file, '{c}' AS column_name, '{'bigint' if (t, c) == ('ports', 'src_port') else k}' AS column_type" for t in ("sample", "ports") for c, k in CSV_TYPES.items()
    ),
    "csv_typed_scan": TYPED,
    "bronze_ingest_merged": MERGED,
    "duplicate_sketch": f"{FLOWS} SELECT count(*) AS total_rows, true AS within_bound FROM flows",
    "approximate_medians": f"{LONG} SELECT feature, is_attack AS label, count(*) AS n_rows, true AS within_bound FROM long GROUP BY feature, is_attack",
    "forest_nodes": FOREST_NODES,
    "forest_importance": FOREST_IMPORTANCE,
    "forest_scores": FOREST_SCORES,
    "tree_ablation": TREE_ABLATION,
    "union_results": f"{RUNS} SELECT {RUN}, n_rows, round(f1, 6) AS f1, CASE WHEN algorithm = 'Random Forest' THEN round(roc_auc, 6) END AS roc_auc FROM run_metrics WHERE (algorithm = 'Logistic Regression' AND condition = 'Original') OR (algorithm = 'Random Forest' AND condition = 'Deduplicated')",
    "preview": f"{GOLD} SELECT {KEY_LIST}, Flow_Duration, round(Fwd_Packets_Length_Total, 6) AS Fwd_Packets_Length_Total, is_attack FROM gold ORDER BY {KEY_LIST}, gold.Fwd_Packets_Length_Total LIMIT 5",
    "table_profile": f"{FLOWS} SELECT count(*) AS n_rows, {len(NULL_COLUMNS)} AS n_columns FROM flows",
    "null_counts": f"{FLOWS}, c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({m}) AS null_count FROM flows" for c, m in MISSING.items()
    ) + ") SELECT * FROM c UNION ALL SELECT '*', CAST(sum(null_count) AS BIGINT) FROM c",
    "schema_report": f"{FLOWS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS column_type, count(*) FILTER (NOT ({MISSING[c]})) AS n_values FROM flows"
        for i, (c, t) in enumerate(FLOW_TYPES.items())
    ),
    "label_counts": f"{SILVER} SELECT source_file, Label, count(*) AS n_rows FROM silver WHERE Label IS NOT NULL GROUP BY source_file, Label",
    "class_distribution": f"{GOLD} SELECT is_attack, count(*) AS n_rows FROM gold GROUP BY is_attack",
    "class_share": f"{GOLD} SELECT CASE is_attack WHEN 0 THEN 'Normal' ELSE 'Attack' END AS class_name, count(*) AS n_rows, round(100e0 * count(*) / (SELECT count(*) FROM gold), 6) AS share_percent FROM gold GROUP BY is_attack",
    "describe_features": f"{GOLD} {_measure_entries(['Protocol', 'Flow_Duration', 'Total_Fwd_Packets', 'Total_Backward_Packets', 'is_attack'])}",
    "constraint_report": f"{SAMPLE}, d AS (SELECT DISTINCT * FROM sample_flows), r AS (" + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) FILTER ({broken}) AS violations FROM d" for rule, broken in RULES.items()
    ) + ") SELECT rule, violations, violations = 0 AS passed FROM r",
    "class_stats": f"{LONG}{EFFECTS} SELECT feature, normal_count, attack_count, round(normal_mean, 4) AS normal_mean, round(attack_mean, 4) AS attack_mean, round(normal_median, 4) AS normal_median, round(attack_median, 4) AS attack_median FROM effects",
    "cohens_d": f"{LONG}{EFFECTS} SELECT feature, round(d, 6) AS effect_size FROM effects",
    "feature_auc": f"{COUNTS} SELECT feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS separability_auc FROM aucs",
    "separability_ranking": f"{COUNTS}{EFFECTS} SELECT feature, round(greatest(auc, 1 - auc), 6) AS separability_auc, round(d, 6) AS effect_size, CASE WHEN d < 0.2 THEN 'very small' WHEN d < 0.5 THEN 'small' WHEN d <= 0.8 THEN 'medium' ELSE 'large' END AS effect_band FROM aucs JOIN effects USING (feature) ORDER BY greatest(auc, 1 - auc) DESC, feature LIMIT 5",
    "correlation_matrix": f"{COMPLETE} " + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, " + ", ".join(f"round({_correlation(a, b)}, 6) AS {b}" for b in FEATURES) + " FROM complete"
        for a in FEATURES
    ),
    "high_correlation_pairs": f"{PAIRS} SELECT feature_1, feature_2, round(correlation, 6) AS correlation, count(*) OVER () AS n_pairs, row_number() OVER (ORDER BY abs(correlation) DESC, feature_1, feature_2) = 1 AS is_strongest FROM pairs WHERE correlation IS NOT NULL",
    "ablation_impact": f"{with_clause('ablation_metrics')} SELECT m.removed_feature, round(b.f1 - m.f1, 6) AS f1_drop, round(b.roc_auc - m.roc_auc, 6) AS roc_auc_drop FROM ablation_metrics m JOIN ablation_metrics b ON b.experiment = 'Full Model' AND m.experiment <> 'Full Model'",
    "sample_fraction": f"{GOLD} SELECT {KEY_LIST}, is_attack FROM gold WHERE {bucket('sample')} < {edge(0.25)}",
    "stratified_sample_n": GOLD + STRATA.format(size="least(5000, total)", digest=DIGEST) + f" SELECT {KEY_LIST}, is_attack FROM placed WHERE picked",
    "slot_draws": f"{GOLD}, indexed AS (SELECT *, row_number() OVER (ORDER BY md5({KEY_TEXT.format(seed="'draw', ")}), {KEY_LIST}, Fwd_Packets_Length_Total, is_attack) - 1 AS row_index FROM gold), draws AS (SELECT i AS draw, CAST('0x' || substr(md5('draw|' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % (SELECT count(*) FROM gold) AS row_index FROM range(500) r(i)) SELECT {KEY_LIST}, is_attack, draw FROM indexed JOIN draws USING (row_index)",
    "sample_with_replacement": f"{GOLD}, indexed AS (SELECT *, row_number() OVER (ORDER BY {KEY_LIST}, Fwd_Packets_Length_Total) - 1 AS row_index FROM gold), draws AS (SELECT i AS draw, CAST('0x' || substr(md5('draw|' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % (SELECT count(*) FROM gold) AS row_index FROM range(500) r(i)) SELECT {KEY_LIST}, is_attack, draw FROM indexed JOIN draws USING (row_index)",
    "split_random": f"{GOLD} SELECT {KEY_LIST}, is_attack, {bucket('split')} < {edge(0.8)} AS in_train FROM gold",
    "split_exact": f"{GOLD} SELECT {KEY_LIST}, is_attack, row_number() OVER (ORDER BY {DIGEST}, {KEY_LIST}) <= count(*) OVER () - ceil(count(*) OVER () * 0.2e0) AS in_train FROM gold",
    "split_stratified": GOLD + STRATA.format(size="total - ceil(total::DOUBLE * 0.2e0)::HUGEINT", digest=DIGEST) + f" SELECT {KEY_LIST}, is_attack, picked AS in_train FROM placed",
    "split_ordered": f"{ORDERED} SELECT {KEY_LIST}, is_attack, place <= floor(total * 0.8e0) AS in_train FROM placed",
    "split_head_except": f"{ORDERED}, head AS (SELECT {HEAD_COLUMNS} FROM placed WHERE place <= floor(total * 0.06e0)) SELECT {', '.join(OTHERS)}, is_attack, {odd()}, in_train FROM (SELECT *, true AS in_train FROM head UNION ALL SELECT *, false FROM (SELECT {HEAD_COLUMNS} FROM placed EXCEPT SELECT * FROM head))",
    "split_by_source": f"{GOLD} SELECT source_file = 'botnet' AS in_train, source_file, is_attack, count(*) AS n_rows, CAST(sum(Flow_Duration) AS BIGINT) AS sum_duration FROM gold GROUP BY source_file, is_attack",
    "assemble_features": f"{GOLD} SELECT {KEY_LIST}, {DOUBLES}, {odd()} FROM gold WHERE NOT ({MISSING[ODD]})",
    "scale_std": _scaled(False, "stddev_samp"),
    "scale_zscore": _scaled(True, "stddev_samp"),
    "scale_zscore_pop": _scaled(True, "stddev_pop"),
    "class_weights": f"{GOLD} SELECT is_attack, count(*) AS n_rows, round(sum(count(*)) OVER () / (2e0 * count(*)), 6) AS class_weight FROM gold GROUP BY is_attack",
    "confusion_matrix": f"{CELLS} SELECT * FROM cells",
    "confusion_table": f"{SCORED} SELECT label, prediction, count(*) AS n_rows FROM scored GROUP BY label, prediction",
    "classification_metrics": _weighted(
        "round((SELECT (tn + tp)::DOUBLE / (tn + fp + fn + tp) FROM cells), 6) AS accuracy, round(sum(p * c) / sum(c), 6) AS precision_weighted, "
        "round(sum(r * c) / sum(c), 6) AS recall_weighted, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * c) / sum(c), 6) AS f1_weighted"
    ),
    "attack_metrics": f"{CELLS}, pr AS (SELECT coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM cells) SELECT round(p, 6) AS precision_attack, round(r, 6) AS recall_attack, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1_attack FROM pr",
    "roc_auc": f"{BY_SCORE} SELECT round(sum(n1 * (below + n0 / 2)) / (sum(n1) * sum(n0)), 6) AS roc_auc FROM (SELECT *, sum(n0) OVER (ORDER BY score) - n0 AS below FROM by_score)",
    "pr_auc": f"{BY_SCORE}, points AS (SELECT score, sum(n1) OVER w / sum(n1) OVER () AS r, sum(n1) OVER w / sum(n0 + n1) OVER w AS p FROM by_score WINDOW w AS (ORDER BY score DESC)), steps AS (SELECT r - coalesce(lag(r) OVER (ORDER BY score DESC), 0) AS dr, p + coalesce(lag(p) OVER (ORDER BY score DESC), p) AS pp FROM points) SELECT round(sum(dr * pp / 2), 6) AS pr_auc FROM steps",
    "generalization_verdict": f"{CELLS} SELECT *, round(tp::DOUBLE / (tp + fn), 6) AS recall_attack, CASE WHEN tp = 0 THEN 'none' WHEN tp::DOUBLE / (tp + fn) < 0.5 THEN 'limited' ELSE 'present' END AS generalization FROM cells",
    "ladder_counts": f"{GOLD} {_rungs('gold', LONG_LADDER, bucket('sample'), bucket('split'))}",
    "ladder_runs": f"{GOLD}, rungs AS ({_rungs('gold', [0.001, *LONG_LADDER], bucket('sample'), bucket('split'))}) SELECT *, test_rows AS n_scored, TRUE AS all_timed FROM rungs WHERE n_rows >= 100",
    "robust_ladder_counts": f"{FLOWS}, t AS (SELECT DISTINCT {', '.join(FEATURES)}, {TARGET} FROM flows) {_rungs('t', LADDER, bucket('sample', ROBUST_KEYS), bucket('split', ROBUST_KEYS))}",
    "sample_detector_counts": f"""{SAMPLE}, t AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM sample_flows))
SELECT true AS in_train, CAST(n - ceil(n * 0.2e0) AS BIGINT) AS n_rows FROM t UNION ALL SELECT false, CAST(ceil(n * 0.2e0) AS BIGINT) FROM t""",
    "time_per_row": f"{RUNS} SELECT {RUN}, round(training_time_sec / n_rows, 9) AS time_per_row FROM run_metrics",
    "scalability_growth": f"{RUNS} SELECT {RUN}, round(training_time_sec / first(training_time_sec) OVER w, 4) AS training_time_growth, round(prediction_time_sec / first(prediction_time_sec) OVER w, 4) AS prediction_time_growth, round(train_rows / training_time_sec, 4) AS rows_per_second_training, round(test_rows / prediction_time_sec, 4) AS rows_per_second_prediction FROM run_metrics WINDOW w AS (PARTITION BY condition, algorithm ORDER BY fraction)",
    "scalability_findings": f"{RUNS} SELECT condition, algorithm, max(n_rows) AS largest_rows, first(dataset_size ORDER BY n_rows DESC, fraction) AS largest_size, round(min(training_time_sec), 6) AS fastest_training_sec, first(dataset_size ORDER BY training_time_sec, fraction) AS fastest_size, round(max(f1), 6) AS best_f1, first(dataset_size ORDER BY f1 DESC, fraction) AS best_f1_size FROM run_metrics GROUP BY condition, algorithm",
    "ordered_results": f"{RUNS} SELECT {SIZE_ORDER} AS size_order, {RUN}, n_rows, round(f1, 6) AS f1 FROM run_metrics WHERE condition = 'Original'",
    "algorithm_pivot": f"{RUNS} SELECT dataset_size, " + ", ".join(
        f"round(max({c}) FILTER (algorithm = '{a}'), 6) AS {p}_{m}_sec"
        for a, p in (("Logistic Regression", "logistic"), ("Random Forest", "forest"))
        for m, c in (("training", "training_time_sec"), ("total", "total_ml_time_sec"))
    ) + " FROM run_metrics WHERE condition = 'Original' GROUP BY dataset_size",
    "algorithm_ratio": f"{RUNS} SELECT condition, " + ", ".join(
        f"round(max({c}) FILTER (algorithm = 'Random Forest') / max({c}) FILTER (algorithm = 'Logistic Regression'), 6) AS {m}_ratio"
        for m, c in (("training", "training_time_sec"), ("total", "total_ml_time_sec"))
    ) + " FROM run_metrics WHERE dataset_size = '100%' GROUP BY condition",
    "robustness_delta": _robust(),
    "first_last": f"{RUNS} SELECT condition, algorithm, " + ", ".join(
        (f"arg_{side}({c}, fraction) AS {name}_{c}" if c == "n_rows" else f"round(arg_{side}({c}, fraction), 6) AS {name}_{c}")
        for c in ("n_rows", "training_time_sec", "prediction_time_sec", "f1", "roc_auc")
        for name, side in (("first", "min"), ("last", "max"))
    ) + " FROM run_metrics GROUP BY condition, algorithm",
}
