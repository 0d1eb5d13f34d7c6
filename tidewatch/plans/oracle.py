"""Independent DuckDB statements for the correctness gate.

Each registered query has a twin here written in plain SQL against the same
Parquet tables.  Shared steps are named CTEs with declared dependencies;
``statement(body, *ctes)`` assembles the ``WITH`` clause with everything the
body needs, in dependency order.
"""

from __future__ import annotations

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


def statement(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order) + "\n" + body


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def spark_rounding(sql: str) -> str:
    """Rewrite every ``round(x, n)`` / ``round_even(x, n)`` to round the decimal form of x.

    Spark rounds a DOUBLE through its shortest decimal text; DuckDB's plain
    ``round`` scales in binary and can land on the other side of a tie.  Going
    through the text and DECIMAL makes both engines agree.
    """
    out, i = [], 0
    while True:
        j = min([k for k in (sql.find("round(", i), sql.find("round_even(", i)) if k >= 0], default=-1)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 1])
            i = j + 1
            continue
        name = "round_even" if sql.startswith("round_even(", j) else "round"
        start = j + len(name) + 1
        depth, k, comma = 1, start, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        arg, places = sql[start:comma], sql[comma + 1:k - 1]
        out.append(sql[i:j])
        v = spark_rounding(arg)
        out.append(f"CAST(CASE WHEN isfinite({v}) THEN {name}(CAST(CAST({v} AS VARCHAR) AS DECIMAL(38, 18)), "
                   f"{places.strip()}) ELSE {v} END AS DOUBLE)")
        i = k


# --- fixture: readings from events (FIXTURES.md section B) ---------------------------

cte("ev", [], """
  SELECT event_id AS reading_id, user_id AS station, user_id % 5 AS dk, value, event_type,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         DATE '2022-01-01' + CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 2400) AS INTEGER) AS d
  FROM events""")

cte("evr", ["ev"], "SELECT ev.*, r_name AS district FROM ev JOIN region ON dk = r_regionkey")

cte("fx_b", ["evr"], """
  SELECT evr.*,
         CASE WHEN reading_id % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(reading_id % 400 AS DOUBLE) / 2 END AS water_area_km2,
         CASE WHEN reading_id % 103 = 0 THEN NULL ELSE CAST(reading_id % 105 AS DOUBLE) / 100 END AS soil
  FROM evr""")

cte("fx_p", ["fx_b"], """
  SELECT fx_b.*,
    lag(water_area_km2) OVER (PARTITION BY station ORDER BY d, reading_id) AS prev_km2,
    round(avg(value) OVER (PARTITION BY station ORDER BY d, reading_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS precip_3day_avg,
    round(avg(value) OVER (PARTITION BY station ORDER BY d, reading_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS precip_7day_avg,
    round(avg(k / 2) OVER (PARTITION BY station ORDER BY d, reading_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS temp_3day_avg,
    round(avg(soil) OVER (PARTITION BY station ORDER BY d, reading_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS soil_3day_avg
  FROM fx_b""")

cte("fx_f", ["fx_p"], """
  SELECT reading_id, station, district,
    CASE WHEN reading_id % 211 = 0 THEN '31/31/2023'
         ELSE concat(CAST(month(d) AS VARCHAR), '/', CAST(day(d) AS VARCHAR), '/', CAST(year(d) AS VARCHAR)) END AS date,
    CAST(100 AS DOUBLE) + CAST(dk AS DOUBLE) * 50 AS elevation,
    CAST(24 AS DOUBLE) + CAST(dk * dk AS DOUBLE) * 0.75 AS latitude,
    CAST(61 AS DOUBLE) + CAST(dk AS DOUBLE) * 1.25 AS longitude,
    (k - 50) / 10000 AS evaporation,
    CASE WHEN reading_id % 89 = 0 THEN '' WHEN reading_id % 97 = 0 THEN '-999' ELSE CAST(value AS VARCHAR) END AS precipitation,
    CAST(98000 AS DOUBLE) + k * 10 AS pressure,
    soil AS soil_moisture,
    k / 2 AS temperature,
    CAST(reading_id % 12 AS DOUBLE) AS wind_speed,
    CASE WHEN reading_id % 197 = 0 THEN CAST(130 AS DOUBLE) ELSE k END AS humidity,
    water_area_km2, precip_3day_avg, precip_7day_avg, temp_3day_avg, soil_3day_avg,
    CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(month(d) AS INTEGER) AS month, CAST(year(d) AS INTEGER) AS year,
    CASE WHEN month(d) IN (7, 8, 9) THEN 1 ELSE 0 END AS is_monsoon,
    water_area_km2 - prev_km2 AS water_area_change,
    CASE WHEN prev_km2 = 0 THEN CAST('inf' AS DOUBLE) ELSE (water_area_km2 - prev_km2) / prev_km2 END AS water_area_pct_change,
    CAST(reading_id % 4 AS DOUBLE) AS ds_idx,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flood_event
  FROM fx_p""")

cte("raw", ["fx_f"], "SELECT * FROM fx_f UNION ALL SELECT * FROM fx_f WHERE reading_id % 53 = 0")

# --- fixture dimensions ------------------------------------------------------------

cte("terrain_dim", [], """
  SELECT r_name AS district, CAST(57 AS DOUBLE) + CAST(r_regionkey AS DOUBLE) * 100 AS avg_elevation_m,
         concat('terrain ', r_name) AS terrain_type FROM region""")

cte("terrain_short", [], """
  SELECT r_name AS district, CAST(57 AS DOUBLE) + CAST(r_regionkey AS DOUBLE) * 100 AS avg_elevation_m,
         concat('terrain ', r_name) AS terrain_type FROM region WHERE r_regionkey <> 4""")

cte("impact_raw", [], """
  SELECT CAST(n_nationkey AS BIGINT) AS row_seq, r_name AS region,
         CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE CAST(count(*) * 10000 AS BIGINT) END AS affected_population
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY n_nationkey, r_name""")

# the "_part" tables lack one region each: q_population_at_risk shows the defaults
for _suffix, _lacks in (("", ("", "", "")), ("_part", tuple(f" WHERE r_regionkey <> {k}" for k in (4, 3, 0)))):
    cte(f"district_region{_suffix}", [], f"SELECT r_name AS district, r_name AS region FROM region{_lacks[0]}")
    cte(f"region_divisor{_suffix}", [], f"""
  SELECT r_name AS region, CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 1 END AS divisor
  FROM region{_lacks[1]}""")
    cte(f"risk_profile{_suffix}", [], f"""
  SELECT r_name AS district, 0.55 + CAST(r_regionkey AS DOUBLE) * 0.1 AS exposure_factor,
         0.05 + CAST(r_regionkey AS DOUBLE) * 0.01 AS max_exposed_share
  FROM region{_lacks[2]}""")

cte("reports", ["evr"], """
  SELECT reading_id AS report_id,
         CASE WHEN reading_id % 61 = 0 THEN 'ATLANTIS' ELSE district END AS district,
         CASE WHEN reading_id % 89 = 0 THEN NULL ELSE value * 2 END AS rainfall_mm,
         d AS selected_date,
         CASE reading_id % 4 WHEN 0 THEN 'Dry' WHEN 1 THEN 'Moist' WHEN 2 THEN 'Saturated' ELSE 'Muddy' END AS soil_condition,
         CASE WHEN reading_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS visible_water,
         value / 600 AS score
  FROM evr""")

cte("pairs", [], """
  SELECT event_id AS row_id, CAST(user_id % 4 AS INTEGER) AS fold, value / 600 AS score,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         CASE WHEN value / 600 >= 0.1 THEN 1 ELSE 0 END AS prediction
  FROM events""")

# --- cleaning (C1) ----------------------------------------------------------------------

NUMERIC = ["elevation", "evaporation", "latitude", "longitude", "precipitation", "pressure", "soil_moisture",
           "temperature", "water_area_km2", "wind_speed", "humidity", "precip_3day_avg", "precip_7day_avg",
           "temp_3day_avg", "soil_3day_avg", "day_of_year", "month", "year", "is_monsoon", "water_area_change",
           "water_area_pct_change", "ds_idx", "flood_event"]


def _num(c: str) -> str:
    return f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"


_coerced = ",\n    ".join(
    (f"nullif({_num(c)}, -999.0) AS {c}" if c == "precipitation" else
     f"CASE WHEN abs({_num(c)}) = CAST('inf' AS DOUBLE) THEN NULL ELSE {_num(c)} END AS {c}"
     if c == "water_area_pct_change" else f"{_num(c)} AS {c}")
    for c in NUMERIC)

cte("st0", ["raw"], f"""
  SELECT reading_id, station, district, CAST(try_strptime(date, '%m/%d/%Y') AS DATE) AS date,
    {_coerced}
  FROM raw""")

cte("staged", ["st0"], """
  SELECT st0.*, date IS NOT NULL AS date_ok,
    coalesce(soil_moisture < 0, false) OR coalesce(soil_moisture > 1, false)
    OR coalesce(humidity < 0, false) OR coalesce(humidity > 100, false)
    OR coalesce(temperature < -20, false) OR coalesce(temperature > 60, false)
    OR coalesce(precipitation < 0, false) OR coalesce(precipitation > 500, false)
    OR coalesce(water_area_km2 < 0, false) OR coalesce(wind_speed < 0, false) AS phantom
  FROM st0""")

cte("dedup", ["staged"], """
  SELECT DISTINCT * EXCLUDE (date_ok, phantom) FROM staged WHERE date_ok AND NOT phantom""")

cte("cal", ["dedup"], """
  SELECT * REPLACE (CAST(month(date) AS INTEGER) AS month, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
                    CAST(year(date) AS INTEGER) AS year,
                    CASE WHEN month(date) IN (7, 8, 9) THEN 1 ELSE 0 END AS is_monsoon)
  FROM dedup""")

cte("wbounds", ["cal"], """
  SELECT quantile_cont(water_area_pct_change, 0.01) AS lo, quantile_cont(water_area_pct_change, 0.99) AS hi FROM cal""")

cte("wins", ["cal", "wbounds"], """
  SELECT cal.* REPLACE (CASE WHEN water_area_pct_change IS NULL THEN NULL
                             ELSE least(greatest(water_area_pct_change, lo), hi) END AS water_area_pct_change)
  FROM cal CROSS JOIN wbounds""")

cte("feat", ["wins"], """
  SELECT wins.*,
    coalesce(precipitation, 0) * coalesce(soil_moisture, 0) AS rain_soil_interaction,
    sum(CASE WHEN is_monsoon = 1 THEN coalesce(precipitation, 0) ELSE 0 END)
      OVER (PARTITION BY district, year ORDER BY date, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS monsoon_cumulative_precip,
    lag(water_area_km2) OVER (PARTITION BY district ORDER BY date, reading_id) AS water_area_km2_lag1,
    lag(water_area_change) OVER (PARTITION BY district ORDER BY date, reading_id) AS water_area_change_lag1,
    lag(water_area_pct_change) OVER (PARTITION BY district ORDER BY date, reading_id) AS water_area_pct_change_lag1
  FROM wins""")

cte("lagmed", ["feat"], """
  SELECT median(water_area_km2_lag1) AS m1, median(water_area_change_lag1) AS m2,
         median(water_area_pct_change_lag1) AS m3 FROM feat""")

cte("clean", ["feat", "lagmed"], """
  SELECT feat.* REPLACE (coalesce(water_area_km2_lag1, m1) AS water_area_km2_lag1,
                         coalesce(water_area_change_lag1, m2) AS water_area_change_lag1,
                         coalesce(water_area_pct_change_lag1, m3) AS water_area_pct_change_lag1)
  FROM feat CROSS JOIN lagmed""")

# --- model frame and baselines (J1, C2) ----------------------------------------------------

BASE_COLS = ["precipitation", "precip_3day_avg", "precip_7day_avg", "soil_moisture", "soil_3day_avg",
             "water_area_km2_lag1", "water_area_change_lag1", "water_area_pct_change_lag1", "temperature",
             "humidity", "pressure", "evaporation", "month", "day_of_year", "is_monsoon", "rain_soil_interaction",
             "monsoon_cumulative_precip", "avg_elevation_m", "year"]
MONTH_BASE_COLS = [c for c in BASE_COLS if c != "month"]

cte("model", ["clean", "terrain_dim"], """
  SELECT clean.*, t.avg_elevation_m, t.terrain_type FROM clean LEFT JOIN terrain_dim t USING (district)""")

cte("mbase", ["model"], "SELECT district, month, " + ", ".join(
    f"median(CAST({c} AS DOUBLE)) AS {c}" for c in MONTH_BASE_COLS) +
    " FROM model WHERE district IS NOT NULL AND month IS NOT NULL GROUP BY district, month")

cte("dbase", ["model"], "SELECT " + ", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in BASE_COLS) + " FROM model")

cte("tlookup", ["model", "terrain_dim"], """
  SELECT district, terrain_type, CAST(avg_elevation_m AS DOUBLE) AS avg_elevation_m FROM (
    SELECT district, terrain_type, avg_elevation_m,
           row_number() OVER (PARTITION BY district ORDER BY date, reading_id) AS rn
    FROM model WHERE district IS NOT NULL) WHERE rn = 1
  UNION ALL
  SELECT district, terrain_type, CAST(avg_elevation_m AS DOUBLE) FROM terrain_dim
  WHERE district IS NOT NULL AND district NOT IN (SELECT district FROM model WHERE district IS NOT NULL)""")

cte("allowed", ["model", "terrain_dim"], """
  SELECT DISTINCT district FROM (SELECT district FROM model UNION ALL SELECT district FROM terrain_dim)
  WHERE district IS NOT NULL""")

cte("popn", ["impact_raw"], """
  SELECT region, CAST(arg_max(affected_population, row_seq) AS BIGINT) AS affected_population
  FROM impact_raw WHERE affected_population IS NOT NULL AND region IS NOT NULL GROUP BY region""")

# --- neighbours (A5, J6, J7) ----------------------------------------------------------------

cte("cent", ["raw"], """
  SELECT district AS key, avg(latitude) AS lat, avg(longitude) AS lon FROM raw
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND district IS NOT NULL GROUP BY district""")

cte("knn", ["cent"], """
  SELECT * FROM (
    SELECT a.key AS target, b.key AS neighbour,
           sqrt((b.lat - a.lat) * (b.lat - a.lat) + (b.lon - a.lon) * (b.lon - a.lon)) AS dist,
           row_number() OVER (PARTITION BY a.key ORDER BY
             sqrt((b.lat - a.lat) * (b.lat - a.lat) + (b.lon - a.lon) * (b.lon - a.lon)), b.key) AS rank
    FROM cent a JOIN cent b ON a.key <> b.key) WHERE rank <= 2""")

cte("rawp", ["raw"], f"""
  SELECT reading_id, district, CAST(try_strptime(date, '%m/%d/%Y') AS DATE) AS d, {_num('precipitation')} AS p,
         {_num('precip_3day_avg')} AS p3, {_num('precip_7day_avg')} AS p7
  FROM raw""")

cte("tdate", ["rawp"], """
  SELECT district AS target, max(d) AS target_date FROM rawp WHERE d IS NOT NULL GROUP BY district""")

cte("donorval", ["knn", "tdate", "rawp"], """
  SELECT target, donor, p AS precipitation, gap AS date_gap FROM (
    SELECT knn.target, knn.neighbour AS donor, rawp.p, abs(date_diff('day', tdate.target_date, rawp.d)) AS gap,
           row_number() OVER (PARTITION BY knn.target, knn.neighbour ORDER BY abs(date_diff('day', tdate.target_date, rawp.d)),
             CASE WHEN rawp.d = tdate.target_date THEN -rawp.reading_id ELSE rawp.reading_id END) AS rn
    FROM knn JOIN tdate ON knn.target = tdate.target
         JOIN rawp ON rawp.district = knn.neighbour
    WHERE rawp.p IS NOT NULL AND rawp.d IS NOT NULL) WHERE rn = 1""")

# --- scoring (F1-F7, J9, C5, C6, C7) ------------------------------------------------------------

from tidewatch.functions import fixed as _fx  # noqa: E402


def _q(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return repr(v)


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def band_sql(p: str, closed: bool = True) -> str:
    if closed:
        return (f"CASE WHEN {p} < 0.25 THEN 'Low' WHEN {p} <= 0.5 THEN 'Medium' WHEN {p} <= 0.75 THEN 'High' "
                f"ELSE 'Critical' END")
    return f"CASE WHEN {p} < 0.25 THEN 'Low' WHEN {p} < 0.5 THEN 'Medium' WHEN {p} < 0.75 THEN 'High' ELSE 'Critical' END"


def rank_sql(level: str) -> str:
    return case_map(level, _fx.RISK_ORDER)


def guard_sql(level: str, rain: str, soil: str, water: str) -> str:
    forced = (f"(CASE WHEN {rain} >= 450 AND {soil} = 'Saturated' AND {water} = 'Yes' THEN 'Critical' "
              f"WHEN {rain} >= 350 AND ({soil} = 'Saturated' OR {water} = 'Yes') THEN 'High' "
              f"WHEN {rain} >= 300 AND {soil} IN ('Moist', 'Saturated') AND {water} = 'Yes' THEN 'High' "
              f"ELSE {level} END)")
    return f"(CASE WHEN coalesce({rank_sql(forced)} > {rank_sql(level)}, false) THEN {forced} ELSE {level} END)"


def people_sql(level: str, conf: str, pop: str, divisor: str, ef: str, ms: str) -> str:
    base = f"({pop} / greatest(coalesce({divisor}, 1), 1))"
    sev = case_map(level, _fx.SEVERITY_RATE)
    cap = case_map(level, _fx.MAX_CAP_RATE)
    mn = case_map(level, _fx.MINIMUM_PEOPLE)
    raw = f"({base} * {sev} * (0.6 + 0.4 * ({conf} / 100.0)) * coalesce({ef}, 0.75))"
    capv = f"({base} * least({cap}, coalesce({ms}, 0.06)))"
    return (f"CAST(CASE WHEN {pop} IS NULL THEN 0 ELSE round_even(greatest(CAST({mn} AS DOUBLE), least({raw}, {capv})), -2) END "
            f"AS BIGINT)")


cte("rep_valid", ["reports", "allowed"], """
  SELECT r.*, coalesce(r.rainfall_mm IS NOT NULL AND r.selected_date IS NOT NULL AND r.district <> ''
           AND r.soil_condition <> '' AND r.visible_water <> '' AND r.rainfall_mm >= 0 AND r.rainfall_mm <= 500
           AND a.district IS NOT NULL AND r.soil_condition IN ('Dry', 'Moist', 'Saturated')
           AND r.visible_water IN ('Yes', 'No'), false) AS ok
  FROM reports r LEFT JOIN allowed a ON r.district = a.district""")


def feature_sql(src: str) -> str:
    """Feature row of F7 for a table of reports ``src`` (district, rainfall_mm, selected_date, ...)."""
    b = lambda c: f"CASE WHEN m.district IS NOT NULL THEN m.{c} ELSE d.{c} END"
    soil = case_map("s.soil_condition", _fx.SOIL_CONDITION_TO_VALUE)
    return f"""
  SELECT s.*, month(s.selected_date) AS month, dayofyear(s.selected_date) AS day_of_year,
         CASE WHEN month(s.selected_date) IN (7, 8, 9) THEN 1 ELSE 0 END AS is_monsoon,
         CASE WHEN t.district IS NOT NULL THEN t.terrain_type ELSE 'Unknown' END AS terrain_type,
         CASE WHEN t.district IS NOT NULL THEN t.avg_elevation_m ELSE {b('avg_elevation_m')} END AS avg_elevation_m,
         s.rainfall_mm AS precipitation,
         0.5 * s.rainfall_mm + 0.5 * {b('precip_3day_avg')} AS precip_3day_avg,
         0.3 * s.rainfall_mm + 0.7 * {b('precip_7day_avg')} AS precip_7day_avg,
         {soil} AS soil_moisture,
         0.6 * {b('soil_3day_avg')} + 0.4 * {soil} AS soil_3day_avg,
         CASE WHEN s.visible_water = 'Yes' THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS water_area_km2,
         CASE WHEN s.visible_water = 'Yes' THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS water_area_change,
         CASE WHEN s.visible_water = 'Yes' THEN CAST(2.5 AS DOUBLE) / 2.5 ELSE CAST(0 AS DOUBLE) / 0.001 END
           AS water_area_pct_change,
         s.rainfall_mm * {soil} AS rain_soil_interaction,
         CASE WHEN month(s.selected_date) IN (7, 8, 9) THEN {b('monsoon_cumulative_precip')} + s.rainfall_mm
              ELSE 0.0 END AS monsoon_cumulative_precip,
         {b('temperature')} AS temperature, {b('humidity')} AS humidity,
         {b('pressure')} AS pressure, {b('evaporation')} AS evaporation
  FROM {src} s LEFT JOIN mbase m ON s.district = m.district AND month(s.selected_date) = m.month
  CROSS JOIN dbase d LEFT JOIN tlookup t ON s.district = t.district"""


def scored_sql(src: str) -> str:
    """C5 over a validated, featurised table ``src`` (needs ok, rainfall_mm, soil_condition, visible_water)."""
    p = "least(1.0, (rain_soil_interaction + coalesce(precip_7day_avg, 0)) / 300.0)"
    return f"""
  SELECT x.*, {guard_sql('base_level', 'rainfall_mm', 'soil_condition', 'visible_water')} AS final_level FROM (
    SELECT f.*, {p} AS flood_probability, {band_sql(p)} AS base_level,
           greatest({p}, 1 - {p}) * 100 AS conf, round_even(greatest({p}, 1 - {p}) * 100, 1) AS conf_r,
           pp.affected_population AS pop, v.divisor, pf.exposure_factor AS ef, pf.max_exposed_share AS ms
    FROM {src} f LEFT JOIN district_region dr ON f.district = dr.district
    LEFT JOIN popn pp ON dr.region = pp.region LEFT JOIN region_divisor v ON dr.region = v.region
    LEFT JOIN risk_profile pf ON f.district = pf.district) x"""


cte("rep_feat", ["rep_valid", "mbase", "dbase", "tlookup"], feature_sql("rep_valid"))
cte("rep_scored", ["rep_feat", "district_region", "popn", "region_divisor", "risk_profile"], scored_sql("rep_feat"))

ADVISORY_SQL = {
    "risk_level_ur": _fx.RISK_LABELS_UR,
    "recommended_action_en": {k: v["en"] for k, v in _fx.RISK_ACTIONS.items()},
    "recommended_action_ur": {k: v["ur"] for k, v in _fx.RISK_ACTIONS.items()},
    "risk_color": _fx.RISK_COLORS,
}


def result_sql(src: str) -> str:
    people = (f"CASE WHEN final_level = base_level THEN {people_sql('base_level', 'conf', 'pop', 'divisor', 'ef', 'ms')} "
              f"ELSE {people_sql('final_level', 'conf_r', 'pop', 'divisor', 'ef', 'ms')} END")
    adv = ", ".join(f"CASE WHEN ok THEN {case_map('final_level', m)} END AS {k}" for k, m in ADVISORY_SQL.items())
    return f"""
  SELECT *, CASE WHEN ok THEN final_level END AS risk_level_en, {adv},
         CASE WHEN ok THEN conf_r END AS confidence_pct, CASE WHEN ok THEN {people} END AS population_risk_estimate,
         CASE WHEN ok THEN '' ELSE {_q(_fx.INSUFFICIENT_DATA_MESSAGE)} END AS message
  FROM {src}"""


cte("rep_result", ["rep_scored"], result_sql("rep_scored"))

cte("fan", ["reports", "allowed"], """
  SELECT r.report_id, a.district, r.rainfall_mm, r.selected_date, r.soil_condition, r.visible_water
  FROM reports r JOIN allowed a ON a.district IS DISTINCT FROM r.district""")
cte("fan_valid", ["fan", "allowed"], """
  SELECT r.*, coalesce(r.rainfall_mm IS NOT NULL AND r.selected_date IS NOT NULL AND r.district <> ''
           AND r.soil_condition <> '' AND r.visible_water <> '' AND r.rainfall_mm >= 0 AND r.rainfall_mm <= 500
           AND a.district IS NOT NULL AND r.soil_condition IN ('Dry', 'Moist', 'Saturated')
           AND r.visible_water IN ('Yes', 'No'), false) AS ok
  FROM fan r LEFT JOIN allowed a ON r.district = a.district""")
cte("fan_feat", ["fan_valid", "mbase", "dbase", "tlookup"], feature_sql("fan_valid"))
cte("fan_scored", ["fan_feat", "district_region", "popn", "region_divisor", "risk_profile"], scored_sql("fan_feat"))
cte("fan_result", ["fan_scored"], result_sql("fan_scored"))
cte("fan_alerts", ["fan_result"], """
  SELECT report_id, district, risk_level_en, trim(risk_level_ur) AS risk_level_ur,
         trim(recommended_action_en) AS recommended_action_en, trim(recommended_action_ur) AS recommended_action_ur
  FROM fan_result WHERE ok AND risk_level_en IN ('High', 'Critical')""")

# --- scenarios (C3, C4) -------------------------------------------------------------------------

SURGE_DISTRICTS = ["AFRICA", "ASIA"]
FAULTY_DISTRICT = "ASIA"


def mdy_sql(d: str) -> str:
    return f"concat(CAST(month({d}) AS VARCHAR), '/', CAST(day({d}) AS VARCHAR), '/', CAST(year({d}) AS VARCHAR))"


cte("s_rawq", ["raw"], f"""
  SELECT raw.*, CAST(try_strptime(date, '%m/%d/%Y') AS DATE) AS pd, {_num('precipitation')} AS pn FROM raw""")
cte("s_last", ["s_rawq"], "SELECT coalesce(max(pd), DATE '2024-12-31') AS g FROM s_rawq")
cte("s_imp", [], "SELECT * FROM (VALUES " + ", ".join(f"('{d}', {i})" for i, d in enumerate(SURGE_DISTRICTS))
    + ") t(district, pos)")
cte("s_valid", ["s_rawq", "s_imp"], "SELECT s_rawq.*, s_imp.pos FROM s_rawq JOIN s_imp USING (district) WHERE pd IS NOT NULL")
cte("s_src", ["s_valid"], """
  SELECT * EXCLUDE (rn) FROM (SELECT s_valid.*, row_number() OVER (PARTITION BY district ORDER BY (pn IS NULL),
      -coalesce(pn, 0), CASE WHEN pn IS NOT NULL THEN pd END, CASE WHEN pn IS NOT NULL THEN reading_id END,
      pd DESC, reading_id DESC) AS rn FROM s_valid) WHERE rn = 1""")
cte("s_fb", ["s_valid"], f"""
  SELECT district, p7n AS fb7 FROM (SELECT district, {_num('precip_7day_avg')} AS p7n,
      row_number() OVER (PARTITION BY district ORDER BY pd DESC, reading_id DESC) AS rn
    FROM s_valid WHERE {_num('precip_7day_avg')} IS NOT NULL) WHERE rn = 1""")
cte("s_rows", ["s_src", "s_fb", "s_last"], """
  SELECT x.*, least(500.0, orig * 4.0) AS newp, g + CAST(off AS INTEGER) AS sdate FROM (
    SELECT s.*, CASE WHEN s.pn > 0 THEN s.pn ELSE coalesce(fb.fb7, 50.0) END AS orig,
           row_number() OVER (ORDER BY pos) AS off
    FROM s_src s LEFT JOIN s_fb fb USING (district)) x CROSS JOIN s_last""")

_SURGE_OUT = ["reading_id", "district", "date", "precipitation", "precip_3day_avg", "precip_7day_avg",
              "soil_moisture", "soil_3day_avg", "water_area_km2", "water_area_change", "water_area_pct_change",
              "flood_event"]

cte("s_aug", ["raw", "s_rows"], f"""
  SELECT reading_id, district, date, {_num('precipitation')} AS precipitation, precip_3day_avg, precip_7day_avg,
         soil_moisture, soil_3day_avg, water_area_km2, water_area_change, water_area_pct_change, flood_event FROM raw
  UNION ALL
  SELECT reading_id, district, {mdy_sql('sdate')}, newp,
         least(500.0, precip_3day_avg * 0.35 + newp * 0.65), least(500.0, precip_7day_avg * 0.55 + newp * 0.45),
         least(1.0, soil_moisture + 0.12), least(1.0, soil_3day_avg + 0.08),
         greatest(0.0, water_area_km2 * 1.45), greatest(1.0, water_area_change + 3.5),
         greatest(1.0, water_area_change + 3.5) / greatest(greatest(0.0, water_area_km2 * 1.45)
           - greatest(1.0, water_area_change + 3.5), 0.001),
         1
  FROM s_rows""")

cte("c4_target", ["rawp"], f"""
  SELECT d AS tdate, reading_id AS tseq, p AS tprec FROM rawp WHERE district = '{FAULTY_DISTRICT}' AND d IS NOT NULL
  ORDER BY d DESC, reading_id DESC LIMIT 1""")
cte("rain_known", ["rawp"], "SELECT reading_id, district, d, p FROM rawp WHERE p IS NOT NULL AND p <> -999")
cte("c4_donors", ["knn", "tdate", "rain_known"], f"""
  SELECT k.rank, k.neighbour AS donor, v.p AS value FROM knn k LEFT JOIN (
    SELECT knn.target, knn.neighbour AS donor, r.p, row_number() OVER (PARTITION BY knn.target, knn.neighbour
             ORDER BY abs(date_diff('day', tdate.target_date, r.d)),
                      CASE WHEN r.d = tdate.target_date THEN -r.reading_id ELSE r.reading_id END) AS rn
    FROM knn JOIN tdate ON knn.target = tdate.target JOIN rain_known r ON r.district = knn.neighbour
    WHERE r.d IS NOT NULL) v ON v.rn = 1 AND v.target = k.target AND v.donor = k.neighbour WHERE k.target = '{FAULTY_DISTRICT}'""")
cte("c4_fallback", ["rain_known"], "SELECT coalesce(median(p), 0.0) AS fb FROM rain_known")
cte("c4_audit", ["c4_target", "c4_donors", "c4_fallback"], f"""
  SELECT '{FAULTY_DISTRICT}' AS faulty_district, {mdy_sql('tdate')} AS faulty_date, tprec AS original_precipitation,
         (coalesce(v1, v2, fb) + CASE WHEN v1 IS NOT NULL THEN coalesce(v2, fb) ELSE fb END) / 2 AS imputed, d1, d2,
         coalesce(v1, v2, fb) AS val1, CASE WHEN v1 IS NOT NULL THEN coalesce(v2, fb) ELSE fb END AS val2
  FROM c4_target, c4_fallback, (
    SELECT max(donor) FILTER (WHERE rank = 1) AS d1, max(donor) FILTER (WHERE rank = 2) AS d2,
           max(value) FILTER (WHERE rank = 1) AS v1, max(value) FILTER (WHERE rank = 2) AS v2
    FROM c4_donors)""")
cte("c4_updated", ["raw", "c4_target", "c4_audit"], f"""
  SELECT reading_id, district, date,
         CASE WHEN pick THEN imputed ELSE p END AS precipitation,
         CASE WHEN pick THEN coalesce(0.6 * imputed + 0.4 * p3, imputed) ELSE p3 END AS precip_3day_avg,
         CASE WHEN pick THEN coalesce(0.35 * imputed + 0.65 * p7, imputed) ELSE p7 END AS precip_7day_avg
  FROM (
    SELECT r.reading_id, r.district, r.date, {_num('r.precipitation')} AS p, {_num('r.precip_3day_avg')} AS p3,
           {_num('r.precip_7day_avg')} AS p7, a.imputed,
           coalesce(r.district = '{FAULTY_DISTRICT}' AND CAST(try_strptime(r.date, '%m/%d/%Y') AS DATE) = t.tdate
             AND r.reading_id = t.tseq, false)
           AND row_number() OVER (PARTITION BY r.reading_id, r.district, r.date ORDER BY r.reading_id) = 1 AS pick
    FROM raw r CROSS JOIN c4_target t CROSS JOIN c4_audit a)""")

# --- splits (W7-W10) ----------------------------------------------------------------------------

cte("sp_rank", ["clean"], """
  SELECT reading_id, flood_event, year, date, row_number() OVER (ORDER BY date, reading_id) - 1 AS pos,
         count(*) OVER () AS n FROM clean""")
cte("holdout_year", ["clean"], """
  SELECT CASE WHEN count(*) FILTER (WHERE year = 2024) > 0 THEN 2024 ELSE max(year) END AS hy FROM clean""")
cte("fold_rows", ["clean", "holdout_year"], """
  SELECT reading_id, row_number() OVER (ORDER BY date, reading_id) - 1 AS pos, count(*) OVER () AS n
  FROM clean, holdout_year WHERE year < hy""")
cte("strat_counts", ["clean"], """
  SELECT flood_event AS label, count(*) AS nc FROM clean GROUP BY flood_event""")
cte("strat_alloc", ["strat_counts"], """
  SELECT label, nc, nc * 1 // 5 + CASE WHEN fr <= rem THEN 1 ELSE 0 END AS tc FROM (
    SELECT label, nc, row_number() OVER (ORDER BY -((nc * 1) % 5), label) AS fr,
           (sum(nc) OVER () * 1 + 4) // 5 - sum(nc * 1 // 5) OVER () AS rem FROM strat_counts)""")

# --- per-key selections (W3-W6) ---------------------------------------------------------------

cte("w_latest", ["clean"], """
  SELECT station, reading_id, date FROM (SELECT station, reading_id, date,
    row_number() OVER (PARTITION BY station ORDER BY date DESC, reading_id DESC) AS rn FROM clean) WHERE rn = 1""")
cte("w_first", ["clean"], """
  SELECT station, reading_id, date FROM (SELECT station, reading_id, date,
    row_number() OVER (PARTITION BY station ORDER BY date, reading_id) AS rn FROM clean) WHERE rn = 1""")
cte("w_top", ["clean"], """
  SELECT station, reading_id, date, precipitation FROM (SELECT station, reading_id, date, precipitation,
    row_number() OVER (PARTITION BY station ORDER BY (precipitation IS NULL), -coalesce(precipitation, 0),
      CASE WHEN precipitation IS NOT NULL THEN date END, CASE WHEN precipitation IS NOT NULL THEN reading_id END,
      date DESC, reading_id DESC) AS rn FROM clean) WHERE rn = 1""")
cte("w_last", ["clean"], """
  SELECT station, soil_moisture FROM (SELECT station, soil_moisture,
    row_number() OVER (PARTITION BY station ORDER BY date DESC, reading_id DESC) AS rn
    FROM clean WHERE soil_moisture IS NOT NULL) WHERE rn = 1""")
