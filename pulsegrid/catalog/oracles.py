"""SQL counterparts of the registered queries, as whole-table statements for an ANSI engine.

They are written from definitions (spines, window functions, as-of joins), not from the Spark
plans.  Each statement is a list of common table expressions and a final SELECT.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
MEMBERS = {"trend_168": 168, "trend_72": 72, "trend_24": 24}
STEPS = 336
PERIODS = (365, 180, 90, 60, 30, 14)
CALENDAR = [
    ("hour", "hr"), ("sin_hour", "sin(2 * pi() * hr / 24)"), ("cos_hour", "cos(2 * pi() * hr / 24)"),
    ("day_of_week", "dow"), ("sin_dow", "sin(2 * pi() * dow / 7)"), ("cos_dow", "cos(2 * pi() * dow / 7)"),
    ("sin_week", "sin(2 * pi() * (dow * 24 + hr) / 168)"), ("cos_week", "cos(2 * pi() * (dow * 24 + hr) / 168)"),
    ("day_of_month", "dom"), ("sin_month", "sin(2 * pi() * dom / 30.5)"), ("cos_month", "cos(2 * pi() * dom / 30.5)"),
    ("month", "mon"), ("sin_year", "sin(2 * pi() * mon / 12)"), ("cos_year", "cos(2 * pi() * mon / 12)"),
    ("is_weekend", "CASE WHEN dow >= 5 THEN 1.0 ELSE 0.0 END"),
]

ORACLES: dict[str, str] = {}


def statement(ctes: list[str], final: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + final


# Series --------------------------------------------------------------------------------------

BY_TYPE = ["s AS (SELECT event_type AS tag, ts, value FROM events)"]
BY_USER = ["s AS (SELECT CAST(user_id AS VARCHAR) AS tag, ts, value FROM events)"]
ORDERS = [
    "s AS (SELECT o_orderpriority AS tag, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,"
    " avg(o_totalprice) AS value FROM orders GROUP BY ALL)"
]
LINES = [
    "s AS (SELECT l_returnflag || l_linestatus AS tag, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,"
    " sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
]

BOUNDS = ["b AS (SELECT tag, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM s GROUP BY tag)"]
INSIDE = "value BETWEEN p10 - 1.5 * (p90 - p10) AND p90 + 1.5 * (p90 - p10)"
CLEAN = BOUNDS + [f"c AS (SELECT s.* FROM s JOIN b USING (tag) WHERE {INSIDE})"]
LEVEL_COLUMNS = ", ".join(
    [f"median + {k} * 1.4826 * mad AS p{k}" for k in range(1, 6)]
    + [f"median - {k} * 1.4826 * mad AS n{k}" for k in range(1, 6)]
)
SIGMA = [
    "m AS (SELECT tag, median(value) AS median FROM c GROUP BY tag)",
    "d AS (SELECT tag, any_value(median) AS median, median(abs(value - median)) AS mad"
    " FROM c JOIN m USING (tag) GROUP BY tag)",
    f"sig AS (SELECT tag, median, mad, 1.4826 * mad AS sigma, {LEVEL_COLUMNS} FROM d)",
]
ABOVE = {k: f"value >= p{k}" for k in range(1, 6)}
BELOW = {k: f"value <= n{k}" for k in range(1, 6)}


def prepared(step: str) -> list[str]:
    """Bin means of ``c`` on a spine, filled forward, with position ``i`` and length ``n``."""
    return [
        f"bins AS (SELECT tag, time_bucket(INTERVAL '{step}', ts) AS ds, avg(value) AS y FROM c GROUP BY ALL)",
        f"spine AS (SELECT tag, unnest(generate_series(min(ds), max(ds), INTERVAL '{step}')) AS ds FROM bins GROUP BY tag)",
        "filled AS (SELECT tag, ds, last_value(y IGNORE NULLS) OVER (PARTITION BY tag ORDER BY ds) AS y"
        " FROM spine LEFT JOIN bins USING (tag, ds))",
        "pos AS (SELECT tag, ds, y, row_number() OVER (PARTITION BY tag ORDER BY ds) - 1 AS i,"
        " count(*) OVER (PARTITION BY tag) AS n FROM filled)",
    ]


TRAIN_LENGTH = "CAST(floor(n * 8e-1) AS BIGINT)"


def stats(source: str, name: str, recent: int) -> str:
    return (
        f"{name} AS (SELECT tag, max(n) AS n, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS lo, max(y) AS hi,"
        f" CASE WHEN max(n) > {recent} THEN regr_slope(CASE WHEN i >= n - {recent} THEN y END, i) ELSE 0 END AS slope,"
        f" arg_max(y, i) AS last, max(ds) AS last_ds FROM {source} GROUP BY tag)"
    )


TREND = "(mean + (last + slope * (i + 1) - mean) * pow(0.99, i))"
CLIP = "least(greatest({0}, lo - 0.2 * (hi - lo)), hi + 0.2 * (hi - lo))"


def forecasts(step: str, steps: int, members=MEMBERS) -> list[str]:
    ctes, parts = [], []
    for model, recent in members.items():
        ctes.append(stats("pos", f"st_{model}", recent))
        ctes.append(
            f"f_{model} AS (SELECT tag, '{model}' AS model, last_ds + (i + 1) * INTERVAL '{step}' AS ds, i,"
            f" {CLIP.format(TREND)} AS yhat, 1.96 * std * (1 + sqrt((i + 1) / {steps}.0)) AS half"
            f" FROM st_{model} CROSS JOIN (SELECT unnest(generate_series(0, {steps - 1})) AS i))"
        )
        parts.append(f"SELECT tag, model, ds, i, yhat, yhat - half AS lower, yhat + half AS upper FROM f_{model}")
    return ctes + ["fc AS (" + " UNION ALL ".join(parts) + ")"]


def holdouts(members=MEMBERS) -> list[str]:
    ctes = [f"tr AS (SELECT tag, ds, y, i, {TRAIN_LENGTH} AS n FROM pos WHERE i < {TRAIN_LENGTH})"]
    parts = []
    for model, recent in members.items():
        ctes.append(stats("tr", f"hs_{model}", recent))
        trend = TREND.replace("(i + 1)", "(k + 1)").replace(", i)", ", k)")
        parts.append(
            f"SELECT tag, '{model}' AS model, ds, actual, {trend} AS predicted FROM"
            f" (SELECT pos.tag, pos.ds, pos.y AS actual, pos.i - h.n AS k, h.mean, h.last, h.slope"
            f" FROM pos JOIN hs_{model} h ON pos.tag = h.tag WHERE pos.i >= h.n)"
        )
    return ctes + ["ho AS (" + " UNION ALL ".join(parts) + ")"]


METRICS = (
    "avg(abs({1} - {0})) AS mae, sqrt(avg(pow({1} - {0}, 2))) AS rmse,"
    " avg(abs({1} - {0}) / greatest(abs({0}), 2.220446049250313e-16)) AS mape"
)
SCORES = [
    f"me AS (SELECT tag, model, {METRICS.format('actual', 'predicted')} FROM ho GROUP BY tag, model)",
    "sd AS (SELECT tag, stddev_samp(value) AS data_std FROM c GROUP BY tag)",
    "sc0 AS (SELECT me.*, data_std, greatest(coalesce(data_std, 0), 1e-8) AS spread FROM me JOIN sd USING (tag))",
    "sc1 AS (SELECT *, 0.4 * greatest(0, least(100, (1 - least(mape, 0.5) / 0.5) * 100))"
    " + 0.3 * greatest(0, least(100, (1 - least(rmse / spread, 2) / 2) * 100))"
    " + 0.3 * greatest(0, least(100, (1 - least(mae / spread, 1)) * 100)) AS score,"
    " CASE WHEN data_std > 0 THEN rmse * rmse / (data_std * data_std) ELSE 'Infinity'::DOUBLE END AS nmse FROM sc0)",
    "sc AS (SELECT *, CASE WHEN score >= 70 THEN 'Good' WHEN score >= 30 THEN 'Moderate' ELSE 'Poor' END AS category,"
    " CASE WHEN score >= 70 THEN 'success' WHEN score >= 30 THEN 'warning' ELSE 'error' END AS color FROM sc1)",
]
MODEL_RANK = "CASE model " + " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(MEMBERS)) + " END"
BEST = [
    "best AS (SELECT * FROM sc QUALIFY row_number() OVER"
    f" (PARTITION BY tag ORDER BY coalesce(score, 0) DESC, {MODEL_RANK}) = 1)"
]


def fits(periods=PERIODS) -> list[str]:
    slopes = ", ".join(
        f"CASE WHEN count(*) FILTER (x >= -{d} * 86400) >= 10"
        f" THEN regr_slope(value, x) FILTER (x >= -{d} * 86400) END AS s{d},"
        f" CASE WHEN count(*) FILTER (x >= -{d} * 86400) >= 10"
        f" THEN regr_intercept(value, x) FILTER (x >= -{d} * 86400) END AS a{d},"
        f" count(*) FILTER (x >= -{d} * 86400) AS c{d}"
        for d in periods
    )
    return [
        "ends AS (SELECT tag, max(ts) AS last_ts FROM c GROUP BY tag)",
        "cx AS (SELECT c.*, last_ts, (epoch_us(ts) - epoch_us(last_ts)) / 1e6 AS x FROM c JOIN ends USING (tag))",
        f"ft AS (SELECT tag, max(last_ts) AS last_ts, min(value) FILTER (x = 0) AS last_value, {slopes} FROM cx GROUP BY tag)",
    ]


def sides(periods=(14, 30, 60)) -> list[str]:
    def reach(d: int) -> str:
        up = f"CASE WHEN s{d} > 0 AND p5 > last_value THEN (p5 - last_value) / (s{d} * 86400) END"
        down = f"CASE WHEN s{d} < 0 AND n5 < last_value THEN (n5 - last_value) / (s{d} * 86400) END"
        return f"SELECT tag, {d} AS period, last_ts, {up} AS up_days, {down} AS down_days FROM ft JOIN sig USING (tag)"

    def moment(days: str) -> str:
        ahead = f"CAST(floor(CASE WHEN {days} < 106751e0 THEN {days} END * 86400e6) AS BIGINT)"
        return f"CASE WHEN epoch_us(last_ts) + {ahead} <= 9223372036854775 THEN last_ts + to_microseconds({ahead}) END"

    return [
        "reach AS (" + " UNION ALL ".join(reach(d) for d in periods) + ")",
        f"sd2 AS (SELECT tag, period, {moment('up_days')} AS upper_ts, {moment('down_days')} AS lower_ts FROM reach)",
        "slope_ttf AS (SELECT tag, 'TTF ROC ' || period || 'd' AS breach_type,"
        " least(upper_ts, lower_ts) AS predicted_ts FROM sd2)",
    ]


def breach_wide(source: str = "fc") -> list[str]:
    columns = ", ".join(
        [f"min(ds) FILTER (yhat >= p{k}) AS pos_{k}" for k in (1, 2, 3)]
        + [f"min(ds) FILTER (yhat <= n{k}) AS neg_{k}" for k in (1, 2, 3)]
    )
    long = " UNION ALL ".join(
        f"SELECT tag, '{word} {k}σ' AS breach_type, {side}_{k} AS predicted_ts FROM bw"
        for word, side in (("Positive", "pos"), ("Negative", "neg")) for k in (1, 2, 3)
    )
    return [f"bw AS (SELECT tag, {columns} FROM {source} JOIN sig USING (tag) GROUP BY tag)", f"bl AS ({long})"]


ALL_BREACHES = ["br AS (SELECT * FROM bl UNION ALL SELECT tag, breach_type, date_trunc('minute', predicted_ts) FROM slope_ttf)"]
BREACH_NAMES = (
    [(f"Positive {k}σ", f"TTF_Pos_{k}Sigma") for k in (1, 2, 3)]
    + [(f"Negative {k}σ", f"TTF_Neg_{k}Sigma") for k in (1, 2, 3)]
    + [(f"TTF ROC {d}d", f"TTF_ROC_{d}d") for d in (14, 30, 60)]
)
BREACH_PIVOT = ", ".join(
    f"max(predicted_ts) FILTER (breach_type = '{label}') AS {column}" for label, column in BREACH_NAMES
)
PIVOTED = [f"bp AS (SELECT tag, {BREACH_PIVOT} FROM br GROUP BY tag)"]
ONE = {"trend_168": 168}


# Scans ---------------------------------------------------------------------------------------

ORACLES["scan_range"] = statement(
    BY_TYPE,
    "SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"
    " AND tag IN ('click', 'purchase', 'view')",
)
ORACLES["scan_trailing"] = statement(
    ORDERS,
    "SELECT tag, ts, round(value, 6) AS value FROM s"
    " QUALIFY ts >= max(ts) OVER (PARTITION BY tag) - INTERVAL 90 DAY",
)
ORACLES["scan_aggregate"] = statement(
    BY_TYPE,
    " UNION ALL ".join(
        f"SELECT tag, time_bucket(INTERVAL '1 hour', ts) AS ts, round(CAST({f}(value) AS DOUBLE), 6) AS value,"
        f" '{how}' AS how FROM s GROUP BY 1, 2"
        for how, f in (("average", "avg"), ("min", "min"), ("max", "max"), ("sum", "sum"), ("count", "count"))
    ),
)


def interpolated(step: str, unit: str, linear: bool = True) -> list[str]:
    between = (
        "p.value + (q.value - p.value) * (epoch_us(g.ts) - epoch_us(p.ts)) / (epoch_us(q.ts) - epoch_us(p.ts))"
        if linear else "p.value"
    )
    return [
        f"g AS (SELECT tag, unnest(generate_series(CASE WHEN date_trunc('{unit}', min(ts)) = min(ts) THEN min(ts)"
        f" ELSE date_trunc('{unit}', min(ts))::TIMESTAMP + INTERVAL '{step}' END, max(ts), INTERVAL '{step}')) AS ts"
        " FROM s GROUP BY tag)",
        f"gi AS (SELECT g.tag, g.ts, CASE WHEN q.ts = g.ts THEN q.value WHEN p.ts = g.ts THEN p.value ELSE {between} END AS value"
        " FROM g ASOF JOIN s p ON g.tag = p.tag AND g.ts >= p.ts ASOF JOIN s q ON g.tag = q.tag AND g.ts <= q.ts)",
    ]


ORACLES["scan_interpolate"] = statement(
    BY_TYPE + interpolated("1 hour", "hour"), "SELECT tag, ts, round(value, 6) AS value FROM gi"
)
ORACLES["scan_interpolate_step"] = statement(
    BY_USER + interpolated("1 day", "day", False), "SELECT tag, ts, round(value, 6) AS value FROM gi"
)

META = [
    "own AS (SELECT *, replace(p_brand, '#', '') || '_' || p_partkey AS own_id FROM part)",
    "meta AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 7 THEN 'forecast_of_' || own_id ELSE own_id END AS external_id,"
    " 'S.A.' || p_brand || '.' || p_type || '.' || p_name || '.PV' AS name,"
    " CASE WHEN p_size <> 1 THEN p_type END AS description,"
    " CASE p_type WHEN 'SMALL' THEN 'mm' WHEN 'LARGE' THEN 'm' END AS unit, CAST(p_size AS BIGINT) AS asset_id,"
    " CAST(NULL AS BIGINT) AS data_set_id, p_size % 2 = 0 AS is_step, p_size, p_brand, p_type, p_name FROM own)",
    "valid AS (SELECT * FROM meta WHERE external_id IS NOT NULL AND trim(external_id) <> '' AND external_id <> 'N/A'"
    " AND NOT starts_with(external_id, 'forecast_of_'))",
]
ORACLES["meta_lookup"] = statement(
    META + [
        "asked AS (SELECT DISTINCT l_partkey FROM lineitem)",
        "tags AS (SELECT coalesce(own_id, 'unknown_' || l_partkey) AS tag FROM asked LEFT JOIN own ON l_partkey = p_partkey)",
    ],
    "SELECT tag, coalesce(unit, 'N/A') AS unit, coalesce(description, 'N/A') AS description, asset_id, data_set_id"
    " FROM tags LEFT JOIN meta ON tag = external_id",
)
ORACLES["forecast_series"] = statement(
    META,
    "SELECT 'forecast_of_' || external_id AS external_id, 'forecast_of_' || external_id AS name,"
    " 'Forecast data for ' || external_id AS description, coalesce(unit, 'N/A') AS unit,"
    " 'asset_id=' || asset_id || ';base_tag=' || external_id || ';created_by=automated;data_set_id=;'"
    " || 'forecast_horizon=12_weeks;model_type=additive' AS facts FROM meta",
)
FIELDS = [
    ("external_id", "external_id"), ("name", "name"), ("description", "coalesce(description, external_id)"),
    ("unit", "coalesce(unit, 'N/A')"), ("asset_id", "coalesce(CAST(asset_id AS VARCHAR), 'N/A')"),
    ("data_set_id", "coalesce(CAST(data_set_id AS VARCHAR), 'N/A')"), ("is_string", "'false'"),
    ("is_step", "CAST(is_step AS VARCHAR)"), ("selected_start_time", "'365d-ago'"), ("selected_end_time", "'now'"),
    ("selected_granularity", "'1h'"), ("metadata.brand", "p_brand"), ("metadata.size", "CAST(p_size AS VARCHAR)"),
]
ORACLES["meta_unpivot"] = statement(
    META,
    " UNION ALL ".join(
        f"SELECT external_id, CAST({k} AS BIGINT) AS position, '{f}' AS field, {e} AS value FROM meta"
        for k, (f, e) in enumerate(FIELDS)
    ),
)
ORACLES["meta_search"] = statement(
    META + [
        "hits AS (SELECT *, CASE WHEN contains(lower(name), 'large') THEN 0 WHEN contains(lower(description), 'large') THEN 1 END AS match_rank FROM valid)"
    ],
    "SELECT id, external_id, name, CAST(match_rank AS BIGINT) AS match_rank FROM hits WHERE match_rank IS NOT NULL"
    " ORDER BY match_rank, id LIMIT 100",
)
ORACLES["meta_search_words"] = statement(
    META + [
        "hits AS (SELECT *, CASE WHEN lower(name) LIKE '%ring%' AND lower(name) LIKE '%small%' THEN 0"
        " WHEN lower(description) LIKE '%ring%' AND lower(description) LIKE '%small%' THEN 1 END AS match_rank FROM valid)"
    ],
    "SELECT id, external_id, name, CAST(match_rank AS BIGINT) AS match_rank FROM hits WHERE match_rank IS NOT NULL",
)
def _grams(text: str) -> str:
    return (
        "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce(" + text + ", '')), '[^a-z0-9]+'),"
        " lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda k: substring('  ' || w || ' ', k, 3)))))"
    )


ORACLES["meta_search_fuzzy"] = statement(
    META + [
        f"en AS (SELECT id, 0 AS field, {_grams('name')} AS g FROM valid UNION ALL SELECT id, 1, {_grams('description')} FROM valid)",
        "ix AS (SELECT unnest(g) AS gram, id, field, len(g) AS size FROM en)",
        "tot AS (SELECT count(*) AS entries FROM (SELECT DISTINCT id, field FROM ix))",
        "qs AS (SELECT id AS query_id, name[1:6] || name[8:] AS query FROM meta WHERE id % 100 = 0)",
        f"qg AS (SELECT query_id, unnest({_grams('query')}) AS gram FROM qs)",
        "df AS (SELECT gram, count(*) AS df FROM ix GROUP BY gram)",
        "wt AS (SELECT query_id, gram, ln(1 + entries / coalesce(df, 1)::DOUBLE) AS w,"
        " row_number() OVER (PARTITION BY query_id ORDER BY df NULLS LAST, gram) AS place FROM qg LEFT JOIN df USING (gram), tot)",
        "al AS (SELECT query_id, sum(w) AS whole FROM wt GROUP BY query_id)",
        "hi AS (SELECT query_id, id, field, any_value(size) AS size, min(place) AS place, round(sum(w) / any_value(whole), 9) AS o"
        " FROM wt JOIN ix USING (gram) JOIN al USING (query_id) GROUP BY query_id, id, field)",
        "on1 AS (SELECT * FROM hi WHERE place <= 4 AND o >= 0.5"
        " QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY o DESC, field) = 1)",
    ],
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, field, size, id) AS rank, id, round(o, 6) AS overlap"
    " FROM on1 QUALIFY rank <= 20",
)
ORACLES["meta_field_filter"] = statement(
    META, "SELECT id, external_id, description FROM valid WHERE external_id LIKE 'Brand1%'"
)
ORACLES["meta_display_name"] = statement(
    META,
    "SELECT id, external_id, p_name || ' (' || p_brand || '/' || p_type || ')' ||"
    " CASE WHEN description IS NOT NULL THEN ': ' || description ELSE '' END ||"
    " CASE WHEN unit IS NOT NULL THEN ' (' || unit || ')' ELSE '' END AS display_name,"
    " name, coalesce(unit, 'N/A') AS unit, coalesce(description, 'N/A') AS description FROM valid",
)

# Cleaning and sigma --------------------------------------------------------------------------

ORACLES["outlier_bounds"] = statement(
    BY_TYPE + BOUNDS,
    "SELECT tag, round(p10, 6) AS p10, round(p90, 6) AS p90, round(p10 - 1.5 * (p90 - p10), 6) AS lower_bound,"
    " round(p90 + 1.5 * (p90 - p10), 6) AS upper_bound FROM b",
)
ORACLES["outlier_clean"] = statement(BY_USER + CLEAN, "SELECT tag, ts, value FROM c")
ORACLES["outlier_counts"] = statement(
    BY_TYPE + BOUNDS,
    f"SELECT tag, count(*) AS total_count, count(*) FILTER ({INSIDE}) AS kept_count,"
    f" count(*) - count(*) FILTER ({INSIDE}) AS removed_count,"
    f" round(100.0 * (count(*) - count(*) FILTER ({INSIDE})) / count(*), 6) AS percent_removed"
    " FROM s JOIN b USING (tag) GROUP BY tag",
)
SUMMARY_COLUMNS = ", ".join(
    f"round({c}, 6) AS {c}" for c in ["median", "mad", "sigma"] + [f"{s}{k}" for s in "pn" for k in range(1, 6)]
)
ORACLES["sigma_summary"] = statement(BY_TYPE + CLEAN + SIGMA, f"SELECT tag, {SUMMARY_COLUMNS} FROM sig")
ORACLES["sigma_flags"] = statement(
    BY_TYPE + CLEAN + SIGMA,
    "SELECT tag, ts, value, " + ", ".join(f"{e} AS above{k}" for k, e in ABOVE.items()) + ", "
    + ", ".join(f"{e} AS below{k}" for k, e in BELOW.items()) + " FROM c JOIN sig USING (tag)",
)
ORACLES["sigma_counts"] = statement(
    BY_USER + CLEAN + SIGMA,
    "SELECT tag, " + ", ".join(f"count(*) FILTER ({e}) AS above{k}" for k, e in ABOVE.items()) + ", "
    + ", ".join(f"count(*) FILTER ({e}) AS below{k}" for k, e in BELOW.items()) + " FROM c JOIN sig USING (tag) GROUP BY tag",
)
EVENTS = [
    "ev AS (" + " UNION ALL ".join(
        f"SELECT tag, ts, value, 'Crossed {word} {k}σ' AS type FROM c JOIN sig USING (tag) WHERE {e}"
        for word, side in (("Above", ABOVE), ("Below", BELOW)) for k, e in side.items()
    ) + ")"
]
ORACLES["sigma_events"] = statement(BY_TYPE + CLEAN + SIGMA + EVENTS, "SELECT * FROM ev")

ORACLES["sigma_event_table"] = statement(
    BY_USER + CLEAN + SIGMA + EVENTS,
    'SELECT ts AS "Timestamp", value AS "Value", type AS "Type", tag AS "Tag" FROM ev',
)
ORACLES["sigma_table"] = statement(
    BY_USER + CLEAN + SIGMA,
    'SELECT tag AS "Tag", round(median, 6) AS "Median", round(mad, 6) AS "MAD", round(sigma, 6) AS "Sigma", '
    + ", ".join(f'round({s}{k}, 6) AS "{sign}{k}σ"' for s, sign in (("p", "+"), ("n", "-")) for k in range(1, 6))
    + " FROM sig",
)

# Rates ---------------------------------------------------------------------------------------

ORACLES["latest_value"] = statement(
    BY_USER, "SELECT tag, max(ts) AS last_ts, arg_max(value, ts) AS last_value FROM s GROUP BY tag"
)
RATES = [
    "rt AS (" + " UNION ALL ".join(
        f"SELECT tag, '{d}d' AS period, s{d} * 86400 AS slope_per_day,"
        f" CASE WHEN c{d} < 10 THEN 'Not enough data for {d}-day window.' END AS note FROM ft"
        for d in PERIODS
    ) + ")"
]
ORACLES["rate_of_change"] = statement(
    ORDERS + CLEAN + fits() + RATES, "SELECT tag, period, round(slope_per_day, 6) AS slope_per_day, note FROM rt"
)
ORACLES["rate_units"] = statement(
    BY_TYPE + CLEAN + fits((14, 30)),
    " UNION ALL ".join(
        f"SELECT tag, '{unit}' AS unit, round(s14 * {f}, 6) AS slope_14d, round(s30 * {f}, 6) AS slope_30d FROM ft"
        for unit, f in (("per_day", "86400e2"), ("per_hour", "3600e2"), ("per_second", "1e6"))
    ),
)
ORACLES["rate_fit_line"] = statement(
    ORDERS + CLEAN + fits(),
    " UNION ALL ".join(
        f"SELECT cx.tag, '{d}d' AS period, ts, round(a{d} + s{d} * x, 3) AS fitted FROM cx JOIN ft ON cx.tag = ft.tag"
        f" WHERE x >= -{d} * 86400 AND s{d} IS NOT NULL"
        for d in (365, 180, 90, 60, 30)
    ),
)

# Grids and features --------------------------------------------------------------------------

HOURLY = BY_TYPE + CLEAN + prepared("1 hour")
USER_HOURLY = BY_USER + CLEAN + prepared("1 hour")
LINES_DAILY = LINES + CLEAN + prepared("1 day")
ORDERS_DAILY = ORDERS + CLEAN + prepared("1 day")

ORACLES["resample_mean"] = statement(
    BY_USER,
    "SELECT tag, time_bucket(INTERVAL '1 day', ts) AS ts, round(avg(value), 6) AS value FROM s GROUP BY 1, 2",
)
ORACLES["resample_ffill"] = statement(HOURLY, "SELECT tag, ds, round(y, 6) AS y FROM pos WHERE y IS NOT NULL")
ORACLES["prepared_as_is"] = statement(
    BY_USER + CLEAN,
    "SELECT tag, ts AS ds, value AS y, row_number() OVER (PARTITION BY tag ORDER BY ts) - 1 AS i,"
    " count(*) OVER (PARTITION BY tag) AS n FROM c",
)
ORACLES["future_grid"] = statement(
    BY_TYPE + CLEAN + prepared("30 minutes"),
    "SELECT tag, max(ds) + (i + 1) * INTERVAL 30 MINUTE AS ds, i, any_value(n) AS n"
    " FROM pos p(tag, ds, y, j, n) CROSS JOIN (SELECT unnest(generate_series(0, 335)) AS i) GROUP BY tag, i",
)
ORACLES["time_features"] = statement(
    HOURLY + [
        "cal AS (SELECT tag, ds, i, n, hour(ds) AS hr, isodow(ds) - 1 AS dow, day(ds) AS dom, month(ds) AS mon FROM pos)"
    ],
    "SELECT tag, ds, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {c}" for c, e in CALENDAR)
    + ", round(i / greatest(1, n), 6) AS time_idx FROM cal",
)
ORACLES["holdout_split"] = statement(
    HOURLY,
    f"SELECT tag, ds, i, n, i >= {TRAIN_LENGTH} AS is_test,"
    f" i >= greatest(50, least(n - 10, {TRAIN_LENGTH})) AS is_validation FROM pos",
)
ORACLES["even_subsample"] = statement(
    HOURLY + [
        "pick AS (SELECT DISTINCT tag, CASE WHEN n <= 100 THEN k WHEN k = 99 THEN n - 1"
        " ELSE CAST(floor(k * ((n - 1) / 99e0)) AS BIGINT) END AS i"
        " FROM (SELECT DISTINCT tag, n FROM pos) CROSS JOIN (SELECT unnest(generate_series(0, 99)) AS k))"
    ],
    "SELECT tag, ds, i FROM pos JOIN pick USING (tag, i)",
)
ORACLES["lag_sequences"] = statement(
    HOURLY,
    "SELECT a.tag, a.ds, round(any_value(a.y), 6) AS y, round(arg_min(b.y, b.i), 6) AS oldest,"
    " round(arg_max(b.y, b.i), 6) AS newest, count(*) AS length, round(sum(b.y * (b.i - a.i + 73)), 6) AS weighted"
    " FROM pos a JOIN pos b ON a.tag = b.tag AND b.i BETWEEN a.i - 72 AND a.i - 1 WHERE a.i >= 72 GROUP BY a.tag, a.ds",
)
SPLIT = [f"sp AS (SELECT *, i >= {TRAIN_LENGTH} AS is_test FROM pos)"]
ORACLES["minmax_scale"] = statement(
    HOURLY + SPLIT + [
        "mm AS (SELECT tag, min(y) FILTER (NOT is_test) AS lo, max(y) FILTER (NOT is_test) AS hi FROM sp GROUP BY tag)"
    ],
    "SELECT tag, ds, round(y, 6) AS y, is_test, round((y - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS scaled,"
    " round(y, 6) AS restored FROM sp JOIN mm USING (tag)",
)
ORACLES["standard_scale"] = statement(
    HOURLY + SPLIT + [
        "fe AS (SELECT *, CAST(hour(ds) AS DOUBLE) AS hour, i / greatest(1, n) AS time_idx FROM sp)",
        "mo AS (SELECT tag, " + ", ".join(
            f"avg({c}) FILTER (NOT is_test) AS {c}_m, stddev_pop({c}) FILTER (NOT is_test) AS {c}_s"
            for c in ("y", "hour", "time_idx")
        ) + " FROM fe GROUP BY tag)",
    ],
    "SELECT tag, ds, " + ", ".join(
        f"round(({c} - {c}_m) / {c}_s, 6) AS {c}_scaled" for c in ("y", "hour", "time_idx")
    ) + " FROM fe JOIN mo USING (tag)",
)

# Trend forecast ------------------------------------------------------------------------------

ORACLES["history_stats"] = statement(
    USER_HOURLY + [stats("pos", "st", 168)],
    "SELECT tag, n, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max,"
    " round(slope, 6) AS trend_slope, round(last, 6) AS trend_intercept FROM st",
)
ORACLES["recent_trend"] = statement(
    LINES_DAILY + [stats("pos", "st", 168)],
    "SELECT tag, n, round(slope, 3) AS trend_slope, round(last, 3) AS trend_intercept FROM st",
)
ORACLES["calendar_pattern"] = statement(
    HOURLY,
    "SELECT tag, 'hour' AS by, hour(ds) AS slot, round(avg(y), 6) AS mean FROM pos GROUP BY ALL"
    " UNION ALL SELECT tag, 'weekday' AS by, isodow(ds) - 1 AS slot, round(avg(y), 6) AS mean FROM pos GROUP BY ALL",
)
ORACLES["trend_projection"] = statement(
    LINES_DAILY + [stats("pos", "st", 168)],
    f"SELECT tag, last_ds + (i + 1) * INTERVAL 1 DAY AS ds, round({TREND}, 3) AS yhat"
    " FROM st CROSS JOIN (SELECT unnest(generate_series(0, 179)) AS i)",
)
ORACLES["horizon_blend"] = statement(
    HOURLY + [
        stats("pos", "st", 168),
        "hp AS (SELECT tag, hour(ds) AS slot, avg(y) AS level FROM pos GROUP BY ALL)",
        f"fg AS (SELECT *, last_ds + (i + 1) * INTERVAL 1 HOUR AS ds, i * 3e-1 / {STEPS - 1} AS w FROM st"
        f" CROSS JOIN (SELECT unnest(generate_series(0, {STEPS - 1})) AS i))",
    ],
    f"SELECT fg.tag, ds, round({CLIP.format(f'((1 - w) * level + w * {TREND})')}, 6) AS yhat"
    " FROM fg JOIN hp ON fg.tag = hp.tag AND hour(ds) = slot",
)
FORECAST = HOURLY + forecasts("1 hour", STEPS)
FORECAST_ONE = HOURLY + forecasts("1 hour", STEPS, ONE)
ORACLES["forecast_interval"] = statement(
    FORECAST_ONE,
    "SELECT tag, ds, round(yhat, 6) AS yhat, round(lower, 6) AS lower, round(upper, 6) AS upper FROM fc",
)
ORACLES["forecast_table"] = statement(
    LINES_DAILY + forecasts("1 day", 84, ONE),
    'SELECT ds AS "Timestamp", round(yhat, 2) AS "Forecast", round(lower, 2) AS "Lower_CI",'
    ' round(upper, 2) AS "Upper_CI", tag AS "Tag" FROM fc',
)
ORACLES["forecast_rebased"] = statement(
    HOURLY + forecasts("1 hour", STEPS, {"trend_72": 72}),
    "SELECT TIMESTAMP '2024-03-01 11:00:00' + i * INTERVAL 1 HOUR AS \"Timestamp\", round(yhat, 6) AS \"Forecast\","
    ' round(lower, 6) AS "Lower_CI", round(upper, 6) AS "Upper_CI", tag AS "Tag" FROM fc',
)
ORACLES["forecast_summary"] = statement(
    FORECAST,
    "SELECT tag, model, round(min(yhat), 6) AS forecast_min, round(max(yhat), 6) AS forecast_max,"
    " round(avg(yhat), 6) AS forecast_mean, round(avg(upper - lower) / 2, 6) AS half_width FROM fc GROUP BY tag, model",
)
ORACLES["forecast_points"] = statement(
    FORECAST_ONE,
    "SELECT tag, epoch_ms(ds) AS timestamp_ms, round(yhat, 6) AS value FROM fc WHERE i % 24 <> 5",
)

# Evaluation ----------------------------------------------------------------------------------

HELD = HOURLY + holdouts()
HELD_ONE = HOURLY + holdouts(ONE)
ORACLES["holdout_residuals"] = statement(
    HELD_ONE,
    "SELECT tag, ds, round(actual, 6) AS actual, round(predicted, 6) AS predicted,"
    " round(actual - predicted, 6) AS residual, round(abs(actual - predicted), 6) AS absolute_error FROM ho",
)
ORACLES["forecast_metrics"] = statement(
    LINES_DAILY + holdouts() + SCORES[:1],
    "SELECT tag, model, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(mape, 3) AS mape FROM me",
)
ORACLES["model_score"] = statement(
    HELD + SCORES,
    "SELECT tag, model, round(data_std, 6) AS data_std, round(score, 6) AS score, category, color FROM sc",
)
ORACLES["model_comparison"] = statement(
    HELD + SCORES,
    "SELECT tag, model, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(mape * 100, 3) AS mape_percent,"
    " round(nmse, 4) AS nmse, round(score, 1) AS score, category AS performance FROM sc WHERE mae IS NOT NULL",
)
USER_SCORED = USER_HOURLY + holdouts() + SCORES + BEST
ORACLES["best_model"] = statement(USER_SCORED, "SELECT tag, model, round(score, 6) AS score FROM best")
ORACLES["value_range"] = statement(
    BY_USER + CLEAN,
    "SELECT tag, round(min(value), 6) AS v_min, round(max(value), 6) AS v_max,"
    " round(min(value) - 0.1 * (max(value) - min(value)), 6) AS range_min,"
    " round(max(value) + 0.1 * (max(value) - min(value)), 6) AS range_max FROM c GROUP BY tag",
)
ORACLES["parity_range"] = statement(
    HELD + [
        "ex AS (SELECT tag, model, least(min(actual), min(predicted)) AS lo, greatest(max(actual), max(predicted)) AS hi"
        " FROM ho GROUP BY tag, model)",
        "ro AS (SELECT *, CASE WHEN hi = lo THEN greatest(abs(hi) * 0.05, 1) ELSE 0.05 * (hi - lo) END AS room FROM ex)",
    ],
    "SELECT tag, model, round(lo, 6) AS v_min, round(hi, 6) AS v_max, round(lo - room, 6) AS range_min,"
    " round(hi + room, 6) AS range_max FROM ro",
)
FOLDS = [
    "en AS (SELECT tag, min(ds) AS lo, max(ds) AS hi FROM pos GROUP BY tag)",
    "cu AS (SELECT tag, unnest(generate_series(hi - INTERVAL 30 DAY, lo + INTERVAL 365 DAY, INTERVAL '-90 days')) AS cutoff FROM en)",
    "cvtr AS (SELECT pos.tag, cutoff, ds, y, i, count(*) OVER (PARTITION BY pos.tag, cutoff) AS n"
    " FROM pos JOIN cu ON pos.tag = cu.tag AND ds <= cutoff)",
    "cvte AS (SELECT pos.tag, cutoff, ds, y FROM pos JOIN cu ON pos.tag = cu.tag AND ds > cutoff AND ds <= cutoff + INTERVAL 30 DAY)",
]
ORACLES["cv_folds"] = statement(
    ORDERS_DAILY + FOLDS,
    " UNION ALL ".join(
        f"SELECT tag, strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS fold, count(*) AS rows, min(ds) AS first_ds,"
        f" max(ds) AS last_ds, '{part}' AS part FROM {source} GROUP BY tag, cutoff"
        for part, source in (("train", "cvtr"), ("test", "cvte"))
    ),
)
FOLD_ERRORS = [
    "cs AS (SELECT tag, cutoff, max(n) AS n, avg(y) AS mean, stddev_pop(y) AS std,"
    " CASE WHEN max(n) > 168 THEN regr_slope(CASE WHEN i >= n - 168 THEN y END, i) ELSE 0 END AS slope,"
    " arg_max(y, i) AS last FROM cvtr GROUP BY tag, cutoff)",
    "cp AS (SELECT tag, cutoff, y, std, mean, last, slope, date_diff('day', cutoff, ds) - 1 AS i"
    " FROM cvte JOIN cs USING (tag, cutoff))",
    f"cq AS (SELECT tag, cutoff, i, y, std, {TREND} AS yhat FROM cp)",
]
ORACLES["cv_trend"] = statement(
    ORDERS_DAILY + FOLDS + FOLD_ERRORS + [
        f"cm AS (SELECT tag, cutoff, {METRICS.format('y', 'yhat')},"
        " avg(CASE WHEN abs(y - yhat) <= std * 1.6448536269514722 THEN 1.0 ELSE 0.0 END) AS coverage FROM cq GROUP BY tag, cutoff)",
    ],
    "SELECT tag, count(*) AS folds, " + ", ".join(
        f"round(avg({m}), 3) AS {m}_mean, round(stddev_samp({m}), 3) AS {m}_std" for m in ("mae", "rmse", "mape")
    ) + ", round(avg(coverage), 3) AS coverage FROM cm GROUP BY tag",
)
ORACLES["cv_trend_sums"] = ORACLES["cv_trend"]
# Residuals one by one in order of their step; a window of w residuals ends with each step, and the residuals of
# the step in which it begins count alike, in part.
HORIZON = FOLD_ERRORS + [
    "er AS (SELECT tag, i, abs(yhat - y) AS mae, pow(yhat - y, 2) AS rmse, abs(yhat - y) / greatest(abs(y), 2.220446049250313e-16) AS mape,"
    " CASE WHEN abs(y - yhat) <= std * 1.6448536269514722 THEN 1.0 ELSE 0.0 END AS coverage FROM cq)",
    "st AS (SELECT tag, i, count(*) AS points, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(coverage) AS coverage FROM er GROUP BY tag, i)",
    "cn AS (SELECT *, sum(points) OVER (PARTITION BY tag ORDER BY i) AS hi,"
    " greatest(1, floor(sum(points) OVER (PARTITION BY tag) * 1e-1)) AS w FROM st)",
    "pr AS (SELECT a.tag, a.i, a.points, a.w, greatest(0, least(a.hi, b.hi) - greatest(a.hi - a.w, b.hi - b.points)) AS part,"
    " b.mae, b.rmse, b.mape, b.coverage FROM cn a JOIN cn b ON a.tag = b.tag AND b.i <= a.i WHERE a.hi >= a.w)",
    "hz AS (SELECT tag, i, any_value(points) AS points, sum(part * mae) / any_value(w) AS mae, sqrt(sum(part * rmse) / any_value(w)) AS rmse,"
    " sum(part * mape) / any_value(w) AS mape, sum(part * coverage) / any_value(w) AS coverage FROM pr GROUP BY tag, i)",
]
ORACLES["cv_horizon"] = statement(
    ORDERS_DAILY + FOLDS + HORIZON,
    "SELECT tag, i, points, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(mape, 3) AS mape, round(coverage, 3) AS coverage FROM hz",
)

# Time to failure and result tables -----------------------------------------------------------

ORACLES["cv_horizon_summary"] = statement(
    LINES_DAILY + FOLDS + HORIZON,
    "SELECT tag, count(*) AS steps, " + ", ".join(
        f"round(avg({m}), 3) AS {m}_mean, round(stddev_samp({m}), 3) AS {m}_std" for m in ("mae", "rmse", "mape")
    ) + ", round(avg(coverage), 3) AS coverage FROM hz GROUP BY tag",
)

ORACLES["ttf_first_breach"] = statement(
    LINES_DAILY + SIGMA + forecasts("1 day", 180, ONE) + breach_wide(), "SELECT * FROM bl"
)
ORACLES["ttf_wide"] = statement(
    LINES_DAILY + SIGMA + forecasts("1 day", 180, {"trend_72": 72}) + breach_wide(), "SELECT * FROM bw"
)
ORACLES["ttf_slope_sides"] = statement(
    ORDERS + CLEAN + SIGMA + fits() + sides(),
    "SELECT tag, 'TTF ROC ' || period || 'd (Upper 5σ)' AS breach_type, date_trunc('minute', upper_ts) AS predicted_ts FROM sd2"
    " UNION ALL SELECT tag, 'TTF ROC ' || period || 'd (Lower 5σ)', date_trunc('minute', lower_ts) FROM sd2",
)
ORACLES["ttf_slope"] = statement(
    BY_USER + CLEAN + SIGMA + fits() + sides(),
    "SELECT tag, breach_type, date_trunc('minute', predicted_ts) AS predicted_ts FROM slope_ttf",
)
ORACLES["ttf_countdown"] = statement(
    BY_TYPE + CLEAN + SIGMA + fits() + sides() + [
        "cd AS (SELECT tag, breach_type, date_trunc('minute', predicted_ts) AS predicted_ts,"
        f" CAST(floor((epoch_us(date_trunc('minute', predicted_ts)) - epoch_us({AS_OF})) / 6e7) AS BIGINT) AS minutes"
        " FROM slope_ttf WHERE predicted_ts IS NOT NULL)",
    ],
    "SELECT tag, breach_type, predicted_ts, strftime(predicted_ts, '%d %B %Y - %H:%M') AS threshold_time,"
    " CAST(floor(minutes / 1440) AS BIGINT) || 'd ' ||"
    " CAST(floor((minutes - 1440 * floor(minutes / 1440)) / 60) AS BIGINT) || 'h ' ||"
    " CAST((minutes - 60 * floor(minutes / 60)) AS BIGINT) || 'm' AS time_to_threshold FROM cd",
)
TTF_ALL = HOURLY + SIGMA + forecasts("1 hour", STEPS, ONE) + breach_wide() + fits() + sides() + ALL_BREACHES
ORACLES["ttf_breach_times"] = statement(
    TTF_ALL, 'SELECT tag AS "Tag", breach_type AS "Breach_Type", predicted_ts AS "Predicted_Timestamp" FROM br'
)
SUMMARISED = TTF_ALL + holdouts(ONE) + SCORES + PIVOTED
ORACLES["ttf_summary"] = statement(
    SUMMARISED,
    'SELECT sc.tag AS "Tags", \'2024-02-01 00:00:00\' AS "Date_Modelling", model AS "Model", round(mae, 4) AS "Model_MAE",'
    ' round(rmse, 4) AS "Model_RMSE", round(mape, 4) AS "Model_MAPE", round(score, 2) AS "Score", '
    + ", ".join(c for _, c in BREACH_NAMES) + " FROM sc LEFT JOIN bp ON sc.tag = bp.tag",
)
NODES = SUMMARISED + EVENTS + RATES + [
    "no AS (SELECT tag || '_forecast_' || strftime(ds, '%Y%m%d_%H%M%S') AS external_id, 'forecast' AS view, tag, yhat AS number FROM fc"
    " UNION ALL SELECT tag || '_rate_' || period, 'rate_of_change', tag, slope_per_day FROM rt"
    " UNION ALL SELECT tag || '_sigma_summary', 'sigma_summary', tag, median FROM sig"
    " UNION ALL SELECT tag || '_ttf_summary', 'ttf_summary', tag, score FROM sc"
    " UNION ALL SELECT tag || '_sigma_' || replace(type, ' ', '_') || '_' || strftime(ts, '%Y%m%d_%H%M%S'), 'sigma_event', tag, value FROM"
    " (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY tag, type, date_trunc('second', ts) ORDER BY ts DESC) = 1))",
]
ORACLES["node_records"] = statement(
    NODES,
    "SELECT external_id, view, tag, round(CASE WHEN view = 'ttf_summary' THEN round(number, 2) ELSE number END, 3) AS number FROM no",
)
ORACLES["run_report"] = statement(
    NODES + [
        "asked AS (SELECT DISTINCT unnest([tag, tag || '.missing']) AS tag FROM s)",
        "wr AS (SELECT tag, count(*) AS nodes_written FROM no GROUP BY tag)",
    ],
    "SELECT tag, CASE WHEN nodes_written IS NULL THEN 'error' ELSE 'success' END AS status,"
    " CASE WHEN nodes_written IS NULL THEN 'No data' END AS error,"
    " CASE WHEN nodes_written IS NULL THEN 'no_data' ELSE 'success' END AS write_status,"
    " coalesce(nodes_written, 0) AS nodes_written FROM asked LEFT JOIN wr USING (tag)",
)
ORACLES["sink_csv_roundtrip"] = statement(BY_TYPE + CLEAN, "SELECT tag, ts, value FROM c")
ORACLES["sink_replace_tag"] = statement(
    BY_TYPE,
    "SELECT tag, time_bucket(INTERVAL '1 day', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM s"
    " WHERE tag NOT IN ('click', 'view') GROUP BY 1, 2 UNION ALL"
    " SELECT tag, time_bucket(INTERVAL '1 hour', ts), CAST(count(*) AS DOUBLE) FROM s"
    " WHERE tag IN ('click', 'view') GROUP BY 1, 2",
)
ORACLES["store_change"] = statement(
    BY_TYPE + [
        "runs AS (SELECT tag, 'broken' AS phase, count(DISTINCT time_bucket(INTERVAL '1 day', ts)) AS rows FROM s GROUP BY tag"
        " UNION ALL SELECT tag, 'rerun', count(DISTINCT time_bucket(INTERVAL '12 hours', ts)) FROM s GROUP BY tag)",
    ],
    "SELECT phase, name, tag, rows FROM runs, (SELECT unnest(['points', 'nodes']) AS name)",
)
ORACLES["sink_upsert_nodes"] = statement(
    NODES,
    "SELECT external_id, view, tag FROM no WHERE NOT (tag = 'click' AND view = 'forecast'"
    " AND external_id < 'click_forecast_20240205')",
)

# Ensembles -----------------------------------------------------------------------------------

AVERAGE = "av AS (SELECT tag, ds, avg(yhat) AS yhat, avg(lower) AS lower, avg(upper) AS upper FROM fc GROUP BY tag, ds)"
ORACLES["ensemble_average"] = statement(
    FORECAST + [AVERAGE],
    "SELECT tag, 'ensemble_average' AS model, ds, round(yhat, 6) AS yhat, round(lower, 6) AS lower,"
    " round(upper, 6) AS upper FROM av",
)
ORACLES["ensemble_average_metrics"] = statement(
    HELD + SCORES[:1],
    "SELECT tag, 'ensemble_average' AS model, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse,"
    " round(avg(mape), 6) AS mape FROM me GROUP BY tag",
)
ORACLES["ensemble_average_ttf"] = statement(
    LINES_DAILY + SIGMA + forecasts("1 day", 180) + [AVERAGE] + breach_wide("av"), "SELECT * FROM bl"
)
ORACLES["ensemble_best"] = statement(
    USER_SCORED + forecasts("1 hour", 72),
    "SELECT fc.tag, fc.model, ds, round(yhat, 6) AS yhat, round(lower, 6) AS lower, round(upper, 6) AS upper"
    " FROM fc JOIN best ON fc.tag = best.tag AND fc.model = best.model",
)

# The whole analysis --------------------------------------------------------------------------

ON_GRID = [
    "raw AS (SELECT event_type AS tag, ts, value FROM events)",
    *[c.replace("FROM s GROUP BY", "FROM raw GROUP BY").replace("JOIN s ", "JOIN raw ") for c in interpolated("1 hour", "hour")],
    "s AS (SELECT * FROM gi QUALIFY ts >= (max(ts) OVER (PARTITION BY tag)) - INTERVAL 365 DAY)",
]
ORACLES["asset_health"] = statement(
    ON_GRID + CLEAN + SIGMA + fits() + sides() + prepared("1 hour") + holdouts({"trend": 168}) + SCORES
    + forecasts("1 hour", STEPS, {"trend": 168}) + breach_wide() + ALL_BREACHES + PIVOTED + [
        f"cn AS (SELECT tag, count(*) AS total_count, count(*) - count(*) FILTER ({INSIDE}) AS removed_count FROM s JOIN b USING (tag) GROUP BY tag)",
        "cr AS (SELECT tag, count(*) FILTER (value >= p1) AS above_1s, count(*) FILTER (value >= p3) AS above_3s,"
        " count(*) FILTER (value <= n1) AS below_1s, count(*) FILTER (value <= n3) AS below_3s FROM c JOIN sig USING (tag) GROUP BY tag)",
    ],
    "SELECT cn.tag, total_count, removed_count, round(100.0 * removed_count / total_count, 3) AS percent_removed, "
    + ", ".join(f"round({c}, 3) AS {c}" for c in ("median", "mad", "sigma", "p3", "n3"))
    + ", above_1s, above_3s, below_1s, below_3s, last_ts, round(last_value, 3) AS last_value, "
    + ", ".join(f"round(s{d} * 86400, 3) AS slope_{d}d" for d in (14, 30, 60))
    + ", model, " + ", ".join(f"round({c}, 3) AS {c}" for c in ("mae", "rmse", "mape", "score"))
    + ", category, " + ", ".join(c for _, c in BREACH_NAMES)
    + " FROM cn JOIN sig ON cn.tag = sig.tag JOIN cr ON cn.tag = cr.tag JOIN ft ON cn.tag = ft.tag"
    " JOIN sc ON cn.tag = sc.tag LEFT JOIN bp ON cn.tag = bp.tag",
)

ORACLES["publish_report"] = statement(
    ON_GRID + CLEAN + SIGMA + fits() + prepared("1 hour") + holdouts({"trend": 168}) + SCORES
    + forecasts("1 hour", STEPS, {"trend": 168}) + EVENTS + RATES + NODES[-1:] + [
        "asked AS (SELECT DISTINCT unnest([tag, tag || '.missing']) AS tag FROM s)",
        "wr AS (SELECT tag, count(DISTINCT external_id) AS nodes_written FROM no GROUP BY tag)",
        "pt AS (SELECT tag, count(yhat) AS points_written FROM fc GROUP BY tag)",
    ],
    "SELECT tag, CASE WHEN nodes_written IS NULL THEN 'error' ELSE 'success' END AS status,"
    " CASE WHEN nodes_written IS NULL THEN 'No data' END AS error,"
    " CASE WHEN nodes_written IS NULL THEN 'no_data' ELSE 'success' END AS write_status,"
    " coalesce(nodes_written, 0) AS nodes_written, coalesce(points_written, 0) AS points_written"
    " FROM asked LEFT JOIN wr USING (tag) LEFT JOIN pt USING (tag)",
)

FAULTY = (
    ON_GRID + CLEAN + SIGMA + fits() + prepared("1 hour") + holdouts({"trend": 168}) + SCORES
    + forecasts("1 hour", STEPS, {"trend": 168}) + EVENTS + RATES + NODES[-1:] + [
        "wr AS (SELECT tag, count(DISTINCT external_id) AS nodes_written FROM no GROUP BY tag)",
        "cause AS (SELECT * FROM (VALUES ('.huge', 'grid: values too large'), ('.single', 'grid: no point'), ('.missing', 'No data')) AS v(ending, error))",
        "rp AS (SELECT tag, 'success' AS status, NULL AS error, 'success' AS write_status, nodes_written FROM wr"
        " UNION ALL SELECT tag || ending, 'error', error, 'no_data', 0 FROM (SELECT DISTINCT tag FROM s) CROSS JOIN cause)",
    ]
)
ORACLES["fault_report"] = statement(FAULTY, "SELECT * FROM rp")
ORACLES["run_totals"] = statement(
    FAULTY,
    "SELECT count(*) AS processed_tags, count(*) FILTER (status = 'success') AS successful_tags,"
    " sum(nodes_written)::BIGINT AS nodes_written FROM rp",
)

# Fitted models: what can be stated without fitting them.
for _name, _model in (
    ("forecast_additive", "additive"), ("forecast_kernel", "kernel"), ("forecast_autoregressive", "autoregressive"),
    ("forecast_random_forest", "random_forest"), ("forecast_gbt", "boosted_trees"),
):
    ORACLES[_name] = statement(
        HOURLY,
        f"SELECT tag, '{_model}' AS model, {STEPS}::BIGINT AS rows, max(ds) + INTERVAL 1 HOUR AS first_ds,"
        f" max(ds) + {STEPS} * INTERVAL 1 HOUR AS last_ds, {STEPS}::BIGINT AS good_rows FROM pos GROUP BY tag",
    )
_NAMED = ", ".join(
    f"struct_pack(place := {j}, feature := '{name}', value := CAST({term} AS DOUBLE))"
    for j, (name, term) in enumerate(CALENDAR + [("time_idx", "pos_idx")])
)
_PART = "(sign({g}) * greatest(abs({g}) - 0.12, 0))"
_SCORE = "(power(greatest(abs({g}) - 0.12, 0), 2) / ({h} + 0.27))"
ORACLES["boosted_stump"] = statement(
    HOURLY + [
        "pt AS (SELECT tag, y, hour(ds) AS hr, isodow(ds) - 1 AS dow, day(ds) AS dom, month(ds) AS mon,"
        " CASE WHEN n > 256 THEN floor(i * 256 / n::DOUBLE) / 256 ELSE i / n::DOUBLE END AS pos_idx,"
        " avg(y) OVER (PARTITION BY tag) AS base FROM pos)",
        f"un AS (SELECT tag, base, y, unnest([{_NAMED}]) AS f FROM pt)",
        "hi AS (SELECT tag, f.place AS place, f.feature AS feature, f.value AS value, count(*) AS h, sum(base - y) AS g FROM un GROUP BY ALL)",
        "cu AS (SELECT tag, place, feature, value, sum(h) OVER w AS lh, sum(g) OVER w AS lg,"
        " sum(h) OVER (PARTITION BY tag, place) AS h FROM hi WINDOW w AS (PARTITION BY tag, place ORDER BY value))",
        f"sc AS (SELECT *, round({_SCORE.format(g='lg', h='lh')} + {_SCORE.format(g='lg', h='(h - lh)')}, 3) AS gain"
        " FROM cu WHERE lh >= 7 AND h - lh >= 7)",
    ],
    "SELECT tag, feature, round(value, 6) AS value, round(gain, 2) AS gain, lh::BIGINT AS left_rows,"
    f" round(-{_PART.format(g='lg')} / (lh + 0.27), 5) AS left_leaf, round({_PART.format(g='lg')} / (h - lh + 0.27), 5) AS right_leaf"
    " FROM sc WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY gain DESC, place, value) = 1",
)
ORACLES["cv_metrics"] = statement(ORDERS_DAILY + FOLDS, "SELECT tag, count(*) AS folds, true AS sound FROM cu GROUP BY tag")
ORACLES["holdout_eval"] = statement(
    HOURLY + [
        "mo AS (SELECT unnest(['boosted_trees', 'random_forest', 'kernel', 'autoregressive', 'additive', 'trend']) AS model)",
    ],
    f"SELECT tag, model, count(*) AS rows, min(ds) AS first_ds,"
    f" CASE WHEN model = 'autoregressive' THEN 'one_step' ELSE 'full_horizon' END AS eval_mode, true AS sound"
    f" FROM pos CROSS JOIN mo WHERE i >= {TRAIN_LENGTH} GROUP BY tag, model",
)
ORACLES["model_diagnostics"] = statement(
    HOURLY,
    "SELECT tag, 6::BIGINT AS num_changepoints, max(CASE WHEN i <= floor((n - 1) * 0.9) THEN ds END) AS last_changepoint,"
    " concat_ws(',', CASE WHEN max(n) / 24.0 >= 2 THEN 'daily' END, CASE WHEN max(n) / 24.0 >= 14 THEN 'weekly' END,"
    " CASE WHEN max(n) > greatest(500, floor(max(n) * 0.3)) THEN 'monthly' END) AS seasonality_components,"
    " 0.1 AS changepoint_prior_scale, 'additive' AS seasonality_mode, 0.9 AS interval_width, true AS sound"
    " FROM pos GROUP BY tag",
)
ORACLES["kernel_tube"] = statement(BY_TYPE, "SELECT DISTINCT tag, 0.0::DOUBLE AS residual, true AS settled FROM s")
# Two coefficients of the trend, six changes of slope and thirty seasonal ones; all must be optimal.
ORACLES["additive_optimality"] = statement(
    LINES, "SELECT DISTINCT tag, unnest(range(38)) AS j, 0.0::DOUBLE AS residual FROM s",
)
# Variance of the changes to come: in proportion to the cube of the time since the last training point.
ORACLES["additive_band"] = statement(
    LINES,
    "SELECT tag, i, round((power(i + 1, 3) - 1) / (power(84, 3) - 1), 5) AS growth"
    " FROM (SELECT DISTINCT tag FROM s), (SELECT unnest(range(84)) AS i)",
)
ORACLES["hpo_best_params"] = statement(
    HOURLY,
    "SELECT DISTINCT tag, unnest(['additive', 'kernel']) AS model, 50::BIGINT AS trials, 50::BIGINT AS places, 50::BIGINT AS good_trials FROM pos",
)
ORACLES["search_split"] = statement(
    HOURLY + [
        f"cut AS (SELECT *, {TRAIN_LENGTH} AS k FROM pos)",
        "parts AS (SELECT *, CASE WHEN i >= k THEN 'scoring' WHEN i >= greatest(1, CAST(floor(k * 8e-1) AS BIGINT)) THEN 'validation' END AS part FROM cut)",
    ],
    "SELECT tag, part, count(*) AS rows, min(ds) AS first_ds, max(ds) AS last_ds FROM parts WHERE part IS NOT NULL GROUP BY tag, part",
)
_NEAR = "exp(-pow((a - at_a) / (1 / (1 + sqrt({n}))), 2) / 2) / ((1 / (1 + sqrt({n}))) * sqrt(2 * pi()))"
ORACLES["search_density"] = statement(
    [
        "tr AS (SELECT CAST(o_custkey AS VARCHAR) AS tag, dayofyear(o_orderdate) / 366.0::DOUBLE AS a,"
        " CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS b, count(*) OVER (PARTITION BY o_custkey) AS n,"
        " row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR)) AS p FROM orders)",
        "gr AS (SELECT *, p <= ceil(n / 3.0) AS good, ceil(n / 3.0)::BIGINT AS ng, n - ceil(n / 3.0)::BIGINT AS nr FROM tr)",
        "pt AS (SELECT * FROM (VALUES (0.25::DOUBLE, 0), (0.5, 1), (0.75, 4)) AS v(at_a, at_b))",
        "dn AS (SELECT tag, at_a, any_value(ng) AS ng, any_value(nr) AS nr,"
        f" (1 + coalesce(sum({_NEAR.format(n='ng')}) FILTER (good), 0)) / (any_value(ng) + 1) AS ga,"
        f" (1 + coalesce(sum({_NEAR.format(n='nr')}) FILTER (NOT good), 0)) / (any_value(nr) + 1) AS ra,"
        " (1.0 + count(*) FILTER (good AND b = at_b)) / (any_value(ng) + 5) AS gb,"
        " (1.0 + count(*) FILTER (NOT good AND b = at_b)) / (any_value(nr) + 5) AS rb FROM gr CROSS JOIN pt GROUP BY tag, at_a)",
    ],
    "SELECT tag, at_a AS season, ng AS good, nr AS rest, round(ln(ga) - ln(ra) + ln(gb) - ln(rb), 6) AS preference FROM dn",
)
ORACLES["search_importance"] = statement(
    [
        "tr AS (SELECT l_returnflag AS tag, CAST(l_extendedprice AS DOUBLE) AS loss,"
        " least(floor((CAST(l_quantity AS DOUBLE) - 1.0::DOUBLE) / 49.0::DOUBLE * 4), 3) AS quantity,"
        " least(floor(CAST(l_discount AS DOUBLE) * 10.0::DOUBLE * 4), 3) AS discount,"
        " CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status FROM lineitem)",
        "un AS (UNPIVOT tr ON quantity, discount, status INTO NAME setting VALUE level)",
        "me AS (SELECT *, avg(loss) OVER (PARTITION BY tag, setting, level) AS lm, avg(loss) OVER (PARTITION BY tag, setting) AS tm FROM un)",
        "ex AS (SELECT tag, setting, count(*) AS trials, sum(pow(lm - tm, 2)) / sum(pow(loss - tm, 2)) AS explained FROM me GROUP BY tag, setting)",
    ],
    "SELECT tag, setting, trials, round(explained, 6) AS explained,"
    " round(coalesce(explained / nullif(sum(explained) OVER (PARTITION BY tag), 0), 0), 6) AS share FROM ex",
)
ORACLES["search_rung_rows"] = statement(
    HOURLY + [
        f"cut AS (SELECT tag, {TRAIN_LENGTH} AS k FROM pos WHERE i = 0)",
        "ln AS (SELECT tag, k, greatest(50, least(k - 10, greatest(1, CAST(floor(k * 8e-1) AS BIGINT)))) AS t FROM cut)",
        "ru AS (SELECT * FROM (VALUES (0, 9, 9), (1, 3, 3), (2, 1, 1)) AS v(rung, trials, part_of))",
        "le AS (SELECT *, least(t, greatest(50, CAST(ceil(t / CAST(part_of AS DOUBLE)) AS BIGINT))) AS m FROM ln CROSS JOIN ru)",
    ],
    "SELECT tag, rung::BIGINT AS rung, unnest(['train', 'validation']) AS part, trials::BIGINT AS trials,"
    " unnest([trials * m, trials * (k - t)])::BIGINT AS rows, m AS length, 0::BIGINT AS first_i FROM le",
)
ORACLES["search_rounds"] = statement(
    HOURLY + [
        "mo AS (SELECT unnest(['boosted_trees', 'random_forest', 'kernel', 'additive']) AS model)",
        "ru AS (SELECT * FROM (VALUES (0, 6), (1, 2), (2, 1)) AS v(rung, trials))",
        "tu AS (SELECT unnest([0, 1]) AS round)",
    ],
    "SELECT DISTINCT tag, round, rung, model, trials::BIGINT AS trials, trials::BIGINT AS good_trials"
    " FROM pos CROSS JOIN mo CROSS JOIN ru CROSS JOIN tu",
)
ORACLES["asset_health_best"] = statement(
    ON_GRID + CLEAN + SIGMA + fits() + [
        f"cn AS (SELECT tag, count(*) AS total_count, count(*) - count(*) FILTER ({INSIDE}) AS removed_count FROM s JOIN b USING (tag) GROUP BY tag)",
        "cr AS (SELECT tag, count(*) FILTER (value >= p1) AS above_1s, count(*) FILTER (value >= p3) AS above_3s,"
        " count(*) FILTER (value <= n1) AS below_1s, count(*) FILTER (value <= n3) AS below_3s FROM c JOIN sig USING (tag) GROUP BY tag)",
    ],
    "SELECT cn.tag, total_count, removed_count, round(100.0 * removed_count / total_count, 3) AS percent_removed, "
    + ", ".join(f"round({c}, 3) AS {c}" for c in ("median", "mad", "sigma", "p3", "n3"))
    + ", above_1s, above_3s, below_1s, below_3s, last_ts, round(last_value, 3) AS last_value, true AS sound"
    " FROM cn JOIN sig ON cn.tag = sig.tag JOIN cr ON cn.tag = cr.tag JOIN ft ON cn.tag = ft.tag",
)

# The ways that only large inputs take, forced by small limits: the same results.
for _large, _same in (
    ("scan_interpolate_slices", "scan_interpolate"), ("resample_ffill_slices", "resample_ffill"),
    ("outlier_bounds_large", "outlier_bounds"), ("sigma_summary_large", "sigma_summary"),
    ("outlier_clean_large", "outlier_clean"), ("prepared_as_is_large", "prepared_as_is"),
    ("lag_sequences_large", "lag_sequences"),
):
    ORACLES[_large] = ORACLES[_same]
