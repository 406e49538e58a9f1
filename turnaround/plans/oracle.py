"""The registered queries as SQL for DuckDB over the same Parquet tables.

Written from the definition of each question, not from the Spark code: medians are plain
`quantile_cont`, folds are counted fold by fold, pivots are CASE expressions.
"""

from __future__ import annotations

from turnaround import schema

START, END = "2024-01-02 00:00:00", "2024-01-29 00:00:00"
_BLANKS = r"^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$"


def _text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def r(expr: str, digits: int = 1) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def num(expr: str, digits: int) -> str:
    return f"CAST(CAST(round(CAST({expr} AS DECIMAL(38,12)), {digits}) AS DECIMAL(18,{digits})) AS VARCHAR)"


def known(expr: str, value: str = "hours") -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN {expr} END"


def med(expr: str) -> str:
    return f"quantile_cont(CAST({expr} AS DOUBLE), 0.5)"


def std(expr: str) -> str:
    return f"upper(regexp_replace({expr}, '{_BLANKS}', '', 'g'))"


def zip5(expr: str) -> str:
    whole = f"CAST(CAST(trunc(TRY_CAST({expr} AS DOUBLE)) AS BIGINT) AS VARCHAR)"
    return f"CASE WHEN length({whole}) < 5 THEN lpad({whole}, 5, '0') ELSE {whole} END"


def hash32(salt: str, key: str = "unique_key") -> str:
    return f"CAST(concat('0x', substr(md5(concat('{salt}:', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT)"


def split_of(key: str = "unique_key") -> str:
    h = f"{hash32('split', key)} % 100"
    return f"CASE WHEN {h} < 60 THEN 'train' WHEN {h} < 80 THEN 'validation' ELSE 'test' END"


HOURS = "(epoch_us(closed_date) - epoch_us(created_date)) / 1e6 / 3600"

# One row per event; CASE rules are read top down.
_RAW_RULES = {
    "unique_key": "event_id",
    "created_date": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END",
    "closed_date": """CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts + to_microseconds(CAST(round(3.6e9 * CASE
        WHEN event_id % 89 = 0 THEN -value WHEN event_id % 83 = 0 THEN value + 9000
        WHEN event_id % 41 = 0 THEN value + 800 ELSE value END) AS BIGINT)) END""",
    "agency": "concat(' ', lower(office))",
    "agency_name": "event_type",
    "problem_type": """CASE WHEN event_id % 59 = 0 THEN NULL WHEN office = 'HPD' AND k < 40 THEN 'HEAT/HOT WATER'
        ELSE concat(office, ' TYPE ', CAST(CAST(floor(k / 20.0) AS INTEGER) AS VARCHAR)) END""",
    "problem_detail": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('Detail ', CAST(k AS VARCHAR)) END",
    "location_type": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE c_mktsegment END",
    "incident_zip": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat(CAST(user_id + 1000 AS VARCHAR), '.0') END",
    "city": "CASE WHEN event_id % 37 = 0 THEN NULL ELSE n_name END",
    "status": """CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'In Progress'
        WHEN event_id % 5 = 0 THEN 'Open' ELSE ' Closed ' END""",
    "due_date": "ts + INTERVAL 30 DAY",
    "council_district": "CAST(event_id % 51 + 1 AS INTEGER)",
    "police_precinct": "concat('Precinct ', CAST(user_id % 77 AS VARCHAR))",
    "bbl": "CASE WHEN event_id % 47 = 0 THEN NULL ELSE 1000000000 + user_id END",
    "borough": """CASE WHEN event_id % 11 = 0 THEN 'Unspecified' WHEN event_id % 13 = 0 THEN NULL
        WHEN n_regionkey = 0 THEN 'BRONX' WHEN n_regionkey = 1 THEN 'BROOKLYN' WHEN n_regionkey = 2 THEN 'MANHATTAN'
        WHEN n_regionkey = 3 THEN 'QUEENS' WHEN n_regionkey = 4 THEN 'STATEN ISLAND' END""",
    "x_coordinate": "CASE WHEN event_id % 43 = 0 THEN NULL ELSE value * 100 END",
    "y_coordinate": "CAST(NULL AS DOUBLE)",
    "open_data_channel_type": """CASE WHEN event_id % 23 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'Mobile'
        WHEN user_id % 4 = 1 THEN 'online' WHEN user_id % 4 = 2 THEN 'PHONE' ELSE 'OTHER' END""",
    "latitude": "CAST(CAST(40 + (event_id % 10000) / 10000.0 AS DECIMAL(10,7)) AS DOUBLE)",
    "longitude": "CAST(NULL AS DOUBLE)",
    "resolution_action_updated_date": "CAST(NULL AS TIMESTAMP)",
}
_NO_TEXT = "CAST(NULL AS VARCHAR)"
_raw_columns = ",\n    ".join(f"{_RAW_RULES.get(c, _NO_TEXT)} AS {c}" for c in schema.RAW_COLUMNS)
_std_columns = ", ".join(
    f"{std(c)} AS {c}" if c in schema.STANDARDIZED else f"{zip5(c)} AS {c}" if c == "incident_zip" else c
    for c in schema.RAW_COLUMNS
)


def _filled(columns: list[str]) -> str:
    def one(c: str) -> str:
        if c == "resolution_hours":
            return "CAST(CAST(hours AS DECIMAL(10,2)) AS DOUBLE) AS resolution_hours"
        if c in schema.FILL_DEFAULTS:
            return f"coalesce({c}, '{schema.FILL_DEFAULTS[c]}') AS {c}"
        return c

    return ", ".join(one(c) for c in columns)


_PREFIX = f"""WITH src AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value,
    CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k,
    CASE e.event_type WHEN 'error' THEN 'HPD' WHEN 'click' THEN 'NYPD' WHEN 'view' THEN 'DSNY'
      WHEN 'signup' THEN 'DOT' WHEN 'purchase' THEN 'DEP' END AS office,
    c.c_mktsegment, n.n_name, n.n_regionkey
  FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
raw AS (SELECT
    {_raw_columns}
  FROM src),
typed AS (SELECT {_std_columns} FROM raw),
timed AS (SELECT *, {HOURS} AS hours FROM typed),
valid AS (SELECT * FROM timed WHERE status = 'CLOSED' AND closed_date IS NOT NULL AND hours > 0 AND hours <= 8760
  AND created_date >= TIMESTAMP '{START}' AND created_date <= TIMESTAMP '{END}'),
clean AS (SELECT {_filled(schema.CLEAN_COLUMNS)} FROM valid),
base AS (SELECT unique_key, created_date AS created, closed_date AS closed, agency, problem_type AS problem, borough,
  status, open_data_channel_type AS channel, hours FROM valid),
inputs AS (SELECT unique_key, coalesce(problem_type, 'UNKNOWN') AS problem_type, location_type,
  ln(1 + resolution_hours) AS y, {split_of()} AS split, CAST({hash32('fold')} % 5 AS INTEGER) AS fold FROM clean)
"""


def with_(body: str, *ctes: str) -> str:
    return _PREFIX + "".join(f",\n{c}" for c in ctes) + "\n" + body


# --- Export text ------------------------------------------------------------------------------


def _date_text(c: str) -> str:
    return (
        f"CASE unique_key % 3 WHEN 0 THEN strftime({c}, '%m/%d/%Y %I:%M:%S %p') "
        f"WHEN 1 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S') END"
    )


_TEXTS = {
    "created_date": _date_text("created_date"),
    "closed_date": _date_text("closed_date"),
    "due_date": _date_text("due_date"),
    "problem_detail": "coalesce(problem_detail, 'N/A')",
    "council_district": "CASE WHEN unique_key % 43 = 0 THEN 'NaN' ELSE concat(CAST(council_district AS VARCHAR), '.0') END",
    "bbl": "CASE WHEN bbl IS NOT NULL THEN concat(CAST(bbl AS VARCHAR), '.0') END",
    "x_coordinate": "CASE WHEN unique_key % 53 = 0 THEN 'unknown' ELSE CAST(CAST(floor(x_coordinate) AS BIGINT) AS VARCHAR) END",
    "incident_zip": "CASE WHEN unique_key % 61 = 0 THEN 'abc' ELSE incident_zip END",
    "latitude": "CAST(CAST(latitude AS DECIMAL(10,7)) AS VARCHAR)",
}
_export = "export AS (SELECT " + ", ".join(f"{_TEXTS[c]} AS {c}" if c in _TEXTS else c for c in schema.RAW_COLUMNS) + " FROM raw)"
_na = _text_list(schema.NA_TOKENS)


def _na_null(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({_na}) THEN {c} END"


_present = "present AS (SELECT * REPLACE (" + ", ".join(
    f"{_na_null(c)} AS {c}" for c in ("problem_detail", "council_district", "bbl", "x_coordinate", "incident_zip", "created_date", "closed_date", "due_date")
) + ") FROM export)"


def _parsed(c: str) -> str:
    return f"try_strptime({c}, ['%m/%d/%Y %I:%M:%S %p', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S'])"


def _whole(c: str, kind: str) -> str:
    return f"TRY_CAST(TRY_CAST({c} AS DOUBLE) AS {kind})"


def _conformed(c: str) -> str:
    if c in ("created_date", "closed_date", "due_date"):
        return f"{_parsed(c)} AS {c}"
    if c == "incident_zip":
        return f"{zip5(c)} AS {c}"
    if c in schema.STANDARDIZED:
        return f"{std(c)} AS {c}"
    if c == "council_district":
        return f"CAST({_whole(c, 'SMALLINT')} AS INTEGER) AS {c}"
    if c == "bbl":
        return f"{_whole(c, 'BIGINT')} AS {c}"
    if c in ("x_coordinate", "latitude"):
        return f"TRY_CAST({c} AS DOUBLE) AS {c}"
    return c


_conform = f"SELECT {', '.join(_conformed(c) for c in schema.RAW_COLUMNS)} FROM present"

# --- Encodings --------------------------------------------------------------------------------


def _encoding(name: str, splits: str) -> str:
    """Encodings and their global mean from rows of the given splits: `<name>`, `<name>_mean`."""
    rows = f"(SELECT * FROM inputs WHERE split IN ({splits}))"

    def one(c: str) -> str:
        return (
            f"SELECT '{c}' AS \"column\", {c} AS category, (avg(y) * count(*) + 20 * (SELECT g FROM {name}_mean)) / (count(*) + 20) AS encoding "
            f"FROM {rows} GROUP BY {c}"
        )

    return f"{name}_mean AS (SELECT avg(y) AS g FROM {rows}),\n{name} AS ({one('problem_type')} UNION ALL {one('location_type')})"


def _encoded(name: str, column: str, alias: str) -> str:
    return (
        f"coalesce((SELECT e.encoding FROM {name} e WHERE e.\"column\" = '{column}' AND e.category = {alias}.{column}), "
        f"(SELECT g FROM {name}_mean))"
    )


def _out_of_fold(column: str) -> str:
    """Encoding of each training category per fold, straight from the rows of the other folds."""
    return (
        f"oof_{column} AS (SELECT f.fold, f.{column}, (coalesce(sum(o.y), 0) + 20 * any_value(m.g)) / (count(o.y) + 20) AS encoding "
        f"FROM (SELECT DISTINCT fold, {column} FROM tr) f JOIN fold_mean m ON m.fold = f.fold "
        f"LEFT JOIN tr o ON o.fold <> f.fold AND o.{column} = f.{column} GROUP BY f.fold, f.{column})"
    )


_FOLD_TABLES = [
    "fold_mean AS (SELECT f.fold, (SELECT avg(y) FROM tr t WHERE t.fold <> f.fold) AS g FROM (SELECT DISTINCT fold FROM tr) f)",
    _out_of_fold("problem_type"),
    _out_of_fold("location_type"),
]
_TRAIN = "tr AS (SELECT * FROM inputs WHERE split = 'train')"

_full = _encoding("enc", "'train', 'validation'")
_scored = f"scored AS (SELECT unique_key, y, {_encoded('enc', 'problem_type', 'i')} AS prediction FROM inputs i WHERE split = 'test')"
_preds = """preds AS (SELECT unique_key, exp(y) - 1 AS actual_hours, exp(prediction) - 1 AS predicted_hours,
  (exp(prediction) - 1) - (exp(y) - 1) AS error_hours FROM scored)"""
_PREDICTED = [_full, _scored, _preds]

_METRICS = {
    "r2": "1 - sum((prediction - y) * (prediction - y)) / (var_pop(y) * count(*))",
    "rmse_log": "sqrt(avg((prediction - y) * (prediction - y)))",
    "mae_log": "avg(abs(prediction - y))",
    "mae_hours": "avg(abs(exp(prediction) - exp(y)))",
    "rmse_hours": "sqrt(avg((exp(prediction) - exp(y)) * (exp(prediction) - exp(y))))",
}
_metric_row = "metrics AS (SELECT count(*) AS rows, " + ", ".join(f"{r(e, 6)} AS {n}" for n, e in _METRICS.items()) + " FROM scored)"
_SCORED = [_full, _scored, _metric_row]


def _error(segment: str) -> str:
    return with_(
        f"""SELECT c.{segment} AS segment, count(*) AS complaints,
          {r(med('abs(p.predicted_hours - p.actual_hours)'))} AS median_abs_error,
          {r('avg(abs(p.predicted_hours - p.actual_hours))')} AS mae_hours, {r(med('p.actual_hours'))} AS median_actual
        FROM preds p JOIN clean c ON c.unique_key = p.unique_key WHERE c.{segment} <> 'UNSPECIFIED'
        GROUP BY c.{segment} HAVING count(*) >= 100""",
        *_PREDICTED,
    )


# --- Analysis ---------------------------------------------------------------------------------

_AVG, _MED, _MAX = r("avg(resolution_hours)"), r(med("resolution_hours")), r("max(resolution_hours)")


def _segment(key: str, name: str, *columns: str, where: str = "") -> str:
    found = {"median_hours": _MED, "avg_hours": _AVG, "max_hours": _MAX, "complaints": "count(*)"}
    picked = ", ".join(f"{found[c]} AS {c}" for c in columns)
    return with_(f"SELECT {key} AS {name}, {picked} FROM clean {where} GROUP BY {key}")


def _chart(name: str, statement: str, *groups: str, measured: tuple[str, ...] = ("complaints", "median_hours")) -> str:
    group = " || '|' || ".join(f"coalesce(CAST({g} AS VARCHAR), 'null')" for g in groups)
    found = {"complaints": "CAST(NULL AS BIGINT)", "median_hours": "CAST(NULL AS DOUBLE)"} | {m: m for m in measured}
    picked = ", ".join(f"CAST({v} AS {t}) AS {c}" for (c, v), t in zip(found.items(), ("BIGINT", "DOUBLE")))
    return f"SELECT '{name}' AS chart, {group} AS segment, {picked} FROM ({statement})"


def _ranked(direction: str, top: int, extra: str = "", having: str = "HAVING count(*) > 100", where: str = "") -> str:
    return with_(
        f"SELECT problem_type, count(*) AS complaints, {_MED} AS median_hours{extra} FROM clean {where} GROUP BY problem_type "
        f"{having} ORDER BY median_hours {direction}, problem_type NULLS LAST LIMIT {top}"
    )


_HOUR = "CAST(hour(created_date) AS INTEGER)"
_DOW = "CAST(dayofweek(created_date) AS INTEGER)"
_MONDAY = "CAST(isodow(created_date) - 1 AS INTEGER)"
_WEEKEND = "CASE WHEN dayofweek(created_date) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END"
_NIGHT = "CASE WHEN hour(created_date) >= 22 OR hour(created_date) < 6 THEN 'Night (10pm-6am)' ELSE 'Day (6am-10pm)' END"
_BUCKET = """CASE WHEN resolution_hours <= 1 THEN '0-1 hrs' WHEN resolution_hours <= 4 THEN '1-4 hrs'
  WHEN resolution_hours <= 24 THEN '4-24 hrs' WHEN resolution_hours <= 72 THEN '1-3 days'
  WHEN resolution_hours <= 168 THEN '3-7 days' WHEN resolution_hours <= 720 THEN '1-4 weeks' ELSE '4+ weeks' END"""
_hour_day = f"hour_day AS (SELECT {_HOUR} AS hour, {_DOW} AS dow, {_MED} AS median_hours FROM clean GROUP BY 1, 2)"
_matrix_agencies = _text_list(schema.MATRIX_AGENCIES)
_matrix = f"""matrix AS (SELECT borough, agency, {_MED} AS median_hours, count(*) AS complaints FROM clean
  WHERE borough NOT IN ('UNSPECIFIED') AND agency IN ({_matrix_agencies}) GROUP BY borough, agency)"""
_label = "CASE dow WHEN 0 THEN 'Sun' WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' END"

# --- Findings ---------------------------------------------------------------------------------

_BOROUGH_ROWS = "borough <> 'UNSPECIFIED'"
_CHANNEL_ROWS = "channel IN ('MOBILE', 'ONLINE', 'PHONE')"
_HEAT_ROWS = "problem = 'HEAT/HOT WATER'"


def _medians(column: str, where: str = "TRUE") -> str:
    return (
        f"SELECT {column} AS label, {r(med('hours'))} AS median_hours, count(*) AS count FROM base "
        f"WHERE {column} IS NOT NULL AND {where} GROUP BY {column}"
    )


def _share(column: str, where: str, agency: str) -> str:
    part = f"avg(CASE WHEN agency = '{agency}' THEN 1.0 ELSE 0.0 END)"
    return f"SELECT {column} AS label, {r(part, 3)} AS share, count(*) AS count FROM base WHERE {column} IS NOT NULL AND {where} GROUP BY {column}"


_top15 = "problem IN (SELECT problem FROM base WHERE problem IS NOT NULL GROUP BY problem ORDER BY count(*) DESC, problem LIMIT 15)"
_lists = {
    "by_problem": _medians("problem", _top15),
    "by_borough": _medians("borough", _BOROUGH_ROWS),
    "heat_by_borough": _medians("borough", f"{_BOROUGH_ROWS} AND {_HEAT_ROWS}"),
    "housing_share_by_borough": _share("borough", _BOROUGH_ROWS, "HPD"),
    "by_channel": _medians("channel", _CHANNEL_ROWS),
    "heat_by_channel": _medians("channel", f"{_CHANNEL_ROWS} AND {_HEAT_ROWS}"),
    "police_share_by_channel": _share("channel", _CHANNEL_ROWS, "NYPD"),
}
_SHARES = ", ".join(
    f"{r(f'avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)', 3)} AS {name}"
    for name, cond in (("share_within_2h", "hours <= 2"), ("share_within_24h", "hours <= 24"), ("share_over_7d", "hours > 168"))
)
_OVERALL = f"""count(*) AS total, strftime(min(created), '%Y-%m-%d') AS first_created,
  strftime(max(created), '%Y-%m-%d') AS last_created, {r(med('hours'))} AS median_hours"""


def _json_list(name: str) -> str:
    value = "share" if "share" in name else "median_hours"
    order = "label" if "share" in name else "median_hours, label"
    return f"(SELECT list({{'label': label, '{value}': {value}, 'count': count}} ORDER BY {order}) FROM ({_lists[name]}))"


_findings_json = with_(
    "SELECT CAST(to_json({'total': o.total, 'first_created': o.first_created, 'last_created': o.last_created, "
    "'median_hours': o.median_hours, 'share_within_2h': o.share_within_2h, 'share_within_24h': o.share_within_24h, "
    "'share_over_7d': o.share_over_7d, "
    + ", ".join(f"'{n}': {_json_list(n)}" for n in _lists)
    + f"}}) AS VARCHAR) AS json FROM (SELECT {_OVERALL}, {_SHARES} FROM base) o"
)

# --- Texts ------------------------------------------------------------------------------------


def duration(h: str) -> str:
    return (
        f"CASE WHEN {h} < 1 THEN concat({num(f'{h} * 60', 0)}, ' min') WHEN {h} < 48 THEN concat({num(h, 1)}, ' h') "
        f"WHEN {h} IS NOT NULL THEN concat({num(f'{h} / 24', 1)}, ' days') END"
    )


def percent(x: str) -> str:
    return f"CASE WHEN {x} < 0.1 THEN concat({num(f'{x} * 100', 1)}, '%') WHEN {x} IS NOT NULL THEN concat({num(f'{x} * 100', 0)}, '%') END"


def title(s: str) -> str:
    letters = (
        f"list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i = 1 OR substr({s}, i - 1, 1) IN (' ', '/', '-') "
        f"THEN upper(substr({s}, i, 1)) ELSE lower(substr({s}, i, 1)) END)"
    )
    return f"CASE WHEN {s} = upper({s}) THEN array_to_string({letters}, '') ELSE {s} END"


def _comparison(overall: str, alike: str, shares: str) -> str:
    return with_(
        f"SELECT {title('a.label')} AS label, {duration('a.median_hours')} AS all_requests, {duration('b.median_hours')} AS heat_only, "
        f"{percent('s.share')} AS share FROM ({_lists[overall]}) a LEFT JOIN ({_lists[alike]}) b ON b.label = a.label "
        f"LEFT JOIN ({_lists[shares]}) s ON s.label = a.label"
    )


_ABOUT = "concat('(~', {0}, ' hours)')"


def summary(h: str) -> str:
    about, in_days = _ABOUT.format(num(h, 0)), f"concat({num(f'{h} / 24', 1)}, ' days ')"
    return (
        f"CASE WHEN {h} < 2 THEN 'Expected to resolve in under 2 hours.' "
        f"WHEN {h} < 24 THEN concat('Expected to resolve within the same day ', {about}, '.') "
        f"WHEN {h} < 72 THEN concat('Expected to resolve in ', {in_days}, {about}, '.') "
        f"ELSE concat('Expected to take ', {in_days}, {about}, ' to resolve.') END"
    )


def verdict(h: str) -> str:
    cases = " ".join(f"WHEN {h} < {bound} THEN '{label}'" for bound, label in schema.VERDICTS)
    return f"CASE {cases} ELSE '{schema.LAST_VERDICT}' END"


def low(h: str, mae: str) -> str:
    return f"greatest(0.0::DOUBLE, {r(f'{h} - {mae}')})"


def band(h: str, mae: str) -> str:
    return f"concat({num(low(h, mae), 1)}, 'h – ', {num(f'{h} + {mae}', 1)}, 'h')"


# --- Scoring ----------------------------------------------------------------------------------

_requests = """requests AS (SELECT unique_key AS request_id,
  CASE WHEN unique_key % 37 = 0 THEN 'XYZ' ELSE trim(agency) END AS agency, borough, problem_type, location_type,
  open_data_channel_type AS channel,
  CASE WHEN unique_key % 41 = 0 THEN 25 ELSE hour(created_date) END AS hour_of_day,
  CASE WHEN unique_key % 43 = 0 THEN 7 ELSE isodow(created_date) - 1 END AS day_of_week,
  CASE WHEN unique_key % 47 = 0 THEN 13 ELSE month(created_date) END AS month FROM raw)"""
_agencies, _boroughs = _text_list(schema.AGENCIES), _text_list(schema.BOROUGHS)


def _bad(c: str, lo: int, hi: int) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} NOT BETWEEN {lo} AND {hi} THEN '{c} must be {lo} to {hi}' END"


def _unknown(c: str, allowed: str) -> str:
    return f"CASE WHEN {c} IS NULL OR upper({c}) NOT IN ({allowed}) THEN concat('invalid {c} ''', coalesce({c}, ''), '''') END"


_errors = ", ".join(
    [
        _unknown("agency", _agencies), _unknown("borough", _boroughs),
        "CASE WHEN problem_type IS NULL THEN 'problem_type is missing' END",
        _bad("hour_of_day", 0, 23), _bad("day_of_week", 0, 6), _bad("month", 1, 12),
    ]
)
_checked = f"checked AS (SELECT *, array_to_string(list_filter([{_errors}], lambda x: x IS NOT NULL), '; ') AS errors FROM requests)"
_accepted = """accepted AS (SELECT request_id, agency, borough, problem_type, channel AS given_channel,
  coalesce(location_type, 'UNKNOWN') AS location_type,
  coalesce(channel, 'ONLINE') AS channel, hour_of_day, day_of_week, month FROM checked WHERE errors = '')"""
_REQUESTS = [_requests, _checked, _accepted]

_ONE_HOT = {
    "agency": ["DEP", "DOT", "DSNY", "HPD", "NYPD"],
    "borough": [*schema.BOROUGHS, "UNKNOWN", "UNSPECIFIED"],
    "channel": [*schema.CHANNELS, "UNKNOWN"],
}
_HOT_SOURCE = {"agency": "agency", "borough": "borough", "channel": "open_data_channel_type"}


def _hot(source: dict[str, str]) -> str:
    return ", ".join(
        f"CAST(coalesce(upper({source[p]}) = '{v}', FALSE) AS INTEGER) AS \"{p}_{v}\"" for p, values in _ONE_HOT.items() for v in values
    )


_time = f"""{_HOUR} AS hour_of_day, {_MONDAY} AS day_of_week, CAST(month(created_date) AS INTEGER) AS month,
  CAST(isodow(created_date) >= 6 AS INTEGER) AS is_weekend,
  CAST(hour(created_date) >= 22 OR hour(created_date) < 6 AS INTEGER) AS is_night"""
_features = f"""features AS (SELECT unique_key, resolution_hours, ln(1 + resolution_hours) AS log_resolution_hours, {_time},
  coalesce(problem_type, 'UNKNOWN') AS problem_type, location_type, {_hot(_HOT_SOURCE)} FROM clean)"""
_load = """CASE WHEN unique_key % 53 = 0 OR unique_key % 59 = 0 OR unique_key % 61 = 0 THEN NULL ELSE hour_of_day * 1.5 END"""

_answered = f"answered AS (SELECT a.*, exp({_encoded('enc', 'problem_type', 'a')}) - 1 AS h FROM accepted a)"
_MAE = "(SELECT mae_hours FROM metrics)"
_DEPLOYED = [*_SCORED, *_REQUESTS, _answered]

_problem_names = "[" + _text_list(sorted(schema.PROBLEM_AGENCY)) + ", 'Other Problem', NULL]"
_forms = f"""forms AS (SELECT unique_key AS form_id, {_problem_names}[unique_key % 31 + 1] AS problem_type, borough,
  open_data_channel_type AS channel, hour(created_date) AS hour,
  CASE WHEN unique_key % 53 = 0 THEN '' ELSE dayname(created_date) END AS day, month(created_date) AS month FROM raw)"""
_office = "CASE problem_type " + " ".join(f"WHEN '{p}' THEN '{a}'" for p, a in schema.PROBLEM_AGENCY.items()) + " ELSE '' END"
_gaps = ", ".join(
    f"CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = '' THEN '{n}' END" for c, n in schema.FORM_FIELDS.items()
)
_form_rows = f"form_rows AS (SELECT *, array_to_string(list_filter([{_gaps}], lambda x: x IS NOT NULL), ', ') AS missing, {_office} AS agency FROM forms)"

_pairs = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS rows FROM typed WHERE {c} IS NOT NULL GROUP BY {c}" for c in schema.PROFILED
)
_null_rows = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, {r(f'100.0 * (count(*) - count({c})) / count(*)')} AS null_pct FROM typed"
    for c in schema.RAW_COLUMNS
)
_violating = {
    **{c: f"length({c}) > {n}" for c, n in schema.TEXT_LIMITS.items()},
    "borough": "length(CASE WHEN unique_key % 71 = 0 THEN 'SOMEWHERE BEYOND EVERY BOROUGH' ELSE borough END) > 20",
    "council_district": "unique_key % 73 = 0",
    "latitude": "unique_key % 79 = 0",
}
_checked_columns = [
    c for c in schema.RAW_COLUMNS
    if c in schema.TEXT_LIMITS or c in (*schema.DATE_COLUMNS, "unique_key", "council_district", "bbl", "x_coordinate", "y_coordinate", "latitude", "longitude")
]
_violations = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_violating.get(c, 'FALSE')}) AS violations FROM typed" for c in _checked_columns
)
_SAMPLED = ", ".join(schema.SAMPLED)
_RULE = f"""CASE WHEN closed_date IS NULL THEN '1 no closed date' WHEN created_date IS NULL THEN '2 no created date'
  WHEN hours <= 0 THEN '3 closed at or before creation'
  WHEN created_date < TIMESTAMP '{START}' OR created_date > TIMESTAMP '{END}' THEN '4 created outside window'
  WHEN hours > 8760 THEN '5 over one year' ELSE 'kept' END"""
_clean_all = f"SELECT * FROM clean"
_train_encoding = _encoding("enc", "'train'")
_upper_label = "upper(concat_ws('/', borough, problem_type, CASE WHEN unique_key % 2 = 0 THEN 'street-side' END))"
_any_label = "concat_ws('/', borough, problem_type, CASE WHEN unique_key % 2 = 0 THEN 'street-side' END)"


def _tidy(stage: str, metric: str, value: str | None = None) -> str:
    return f"SELECT '{stage}' AS stage, 'Baseline' AS model, '{metric}' AS metric, {value or metric} AS value FROM metrics"


_flag_rows = f"flag_rows AS (SELECT unique_key, ln(1 + resolution_hours) AS y, {split_of()} AS split, {_time} FROM clean)"
_by_slope = """scored AS (SELECT v.y, t.intercept + t.slope * v.hour_of_day AS prediction FROM flag_rows v,
  (SELECT regr_slope(y, hour_of_day) AS slope, regr_intercept(y, hour_of_day) AS intercept FROM flag_rows WHERE split = 'train') t
  WHERE v.split = 'validation')"""
_by_cell = """scored AS (SELECT v.y, t.y AS prediction FROM flag_rows v JOIN (SELECT is_weekend, is_night, avg(y) AS y
  FROM flag_rows WHERE split = 'train' GROUP BY 1, 2) t ON t.is_weekend = v.is_weekend AND t.is_night = v.is_night
  WHERE v.split = 'validation')"""


def _candidate(scored: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT 'validation' AS stage, 'Candidate' AS model, '{m}' AS metric, {m} AS value FROM metrics" for m in _METRICS
    )
    return with_(rows, _flag_rows, scored, _metric_row)


_planted = f"""planted AS (SELECT i.* EXCLUDE (y), CAST({hash32('effect', 'i.problem_type')} % 10 AS DOUBLE) / 2
  + CASE WHEN hour(c.created_date) BETWEEN 6 AND 17 THEN 1.5 ELSE 0 END
  + CAST({hash32('noise', 'i.unique_key')} % 1000 AS DOUBLE) / 5000 AS y
  FROM inputs i JOIN clean c ON c.unique_key = i.unique_key)"""


def _beside_baseline(stage: str, fitted_on: str, name: str) -> list[str]:
    """`<name>`: rows of a split and the R² of the planted problem types' encoding on it."""
    return [
        _encoding(f"enc_{name}", fitted_on).replace("FROM inputs WHERE", "FROM planted WHERE"),
        f"scored_{name} AS (SELECT y, {_encoded(f'enc_{name}', 'problem_type', 'i')} AS prediction FROM planted i WHERE split = '{stage}')",
        f"{name} AS (SELECT '{stage}' AS stage, count(*) AS rows, {r(_METRICS['r2'], 6)} AS baseline_r2 FROM scored_{name})",
    ]


_VALIDATED = [_planted, *_beside_baseline("validation", "'train'", "valid_base")]
_TESTED = _beside_baseline("test", "'train', 'validation'", "test_base")


def _beats(model: str, base: str = "valid_base") -> str:
    return f"SELECT stage, '{model}' AS model, rows, baseline_r2, TRUE AS beats_baseline FROM {base}"


def statements() -> dict[str, str]:
    """SQL per registered query; queries without an SQL form are absent."""
    found = {
        "read_requests_csv": with_(_conform, _export, _present),
        "read_findings_csv": with_(
            f"""SELECT {_parsed('created_date')} AS created, {_parsed('closed_date')} AS closed, {std('agency')} AS agency,
              problem_type AS problem, {std('borough')} AS borough, {std('status')} AS status,
              {std('open_data_channel_type')} AS channel FROM present""",
            _export, _present,
        ),
        "parse_timestamps": with_(
            f"""SELECT unique_key, {_parsed('created_date')} AS created_date, {_parsed('closed_date')} AS closed_date,
              CASE WHEN unique_key % 71 = 0 THEN NULL ELSE {_parsed('due_date')} END AS due_date FROM present""",
            _export, _present,
        ),
        "normalize_na": with_(
            "SELECT CAST(unique_key AS VARCHAR) AS unique_key, problem_detail, council_district, bbl, x_coordinate, incident_zip FROM present",
            _export, _present,
        ),
        "rename_columns": with_(
            "SELECT CAST(unique_key AS VARCHAR) AS unique_key, problem_type, agency, open_data_channel_type, latitude FROM export", _export
        ),
        "drop_columns": with_(
            "SELECT CAST(unique_key AS VARCHAR) AS unique_key, agency, borough, CAST(35 AS INTEGER) AS columns_left FROM export", _export
        ),
        "scan_table": "SELECT * FROM events",
        "run_sql": with_(
            f"""SELECT agency, {_HOUR} AS hour, count(*) AS complaints, min(resolution_hours) AS least, max(resolution_hours) AS greatest
            FROM clean WHERE agency IN ('HPD', 'NYPD') GROUP BY 1, 2"""
        ),
        "conform_raw": with_(_conform, _export, _present),
        "conform_rejects": with_(
            """SELECT CAST(unique_key AS VARCHAR) AS unique_key, 'x_coordinate' AS column_name, x_coordinate AS text FROM present WHERE x_coordinate = 'unknown'
            UNION ALL SELECT CAST(unique_key AS VARCHAR), 'incident_zip', incident_zip FROM present WHERE incident_zip = 'abc'""",
            _export, _present,
        ),
        "constraint_violations": with_(_violations),
        "quarantined_records": "SELECT event_id AS unique_key FROM events WHERE event_id % 89 = 0",
        "gated_load": """SELECT 'published rows' AS name, count(*) AS rows FROM events UNION ALL SELECT 'loaded rows', count(*) FROM events
            UNION ALL SELECT 'repeated keys', count(*) FROM events WHERE event_id % 97 = 0
            UNION ALL SELECT 'limit of agency', count(*) + count(*) FILTER (event_id % 97 = 0) FROM events WHERE event_id % 83 = 0""",
        "duplicate_keys": "SELECT event_id AS unique_key, CAST(2 AS BIGINT) AS rows FROM events WHERE event_id % 97 = 0",
        "write_table": with_(_clean_all),
        "verify_load": with_(f"SELECT {_SAMPLED}, (SELECT count(*) FROM typed) AS table_rows FROM typed ORDER BY unique_key LIMIT 3"),
        "reconcile_counts": with_(
            """SELECT 'requests_raw' AS table_name, count(*) AS rows FROM typed UNION ALL SELECT 'requests_clean', count(*) FROM clean
            UNION ALL SELECT 'requests_open', count(*) FROM typed WHERE status IS DISTINCT FROM 'CLOSED'"""
        ),
        "profile_shape": "SELECT count(*) AS row_count, CAST(35 AS INTEGER) AS column_count FROM events",
        "profile_nulls": with_(f"SELECT * FROM ({_null_rows}) WHERE null_count > 0"),
        "profile_date_range": with_(
            """SELECT min(created_date) AS first_created, max(created_date) AS last_created, min(closed_date) AS first_closed,
            max(closed_date) AS last_closed FROM typed"""
        ),
        "profile_closed_share": with_(
            f"""SELECT count(closed_date) AS with_closed, count(*) - count(closed_date) AS without_closed,
            {r('100.0 * count(closed_date) / count(*)')} AS with_closed_pct,
            {r('100.0 * (count(*) - count(closed_date)) / count(*)')} AS without_closed_pct FROM typed"""
        ),
        "profile_describe": with_(
            f"""SELECT 'hours' AS measure, count(hours) AS count, {r('avg(hours)', 2)} AS mean, {r('stddev_samp(hours)', 2)} AS std,
            {r('min(hours)', 2)} AS min, {r('max(hours)', 2)} AS max, {r('quantile_cont(hours, 0.25)', 2)} AS p25,
            {r('quantile_cont(hours, 0.5)', 2)} AS p50, {r('quantile_cont(hours, 0.75)', 2)} AS p75 FROM timed"""
        ),
        "profile_anomalies": with_(
            "SELECT count(*) FILTER (WHERE hours < 0) AS negative_hours, count(*) FILTER (WHERE hours > 8760) AS over_one_year FROM timed"
        ),
        "profile_top_values": with_(
            f"""SELECT column_name, value, rows, rank, unique_values FROM (SELECT column_name, value, rows,
              CAST(row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, value) AS INTEGER) AS rank,
              count(*) OVER (PARTITION BY column_name) AS unique_values FROM ({_pairs})) WHERE rank <= 3"""
        ),
        "value_counts": with_("SELECT status, count(*) AS rows FROM typed WHERE status IS NOT NULL GROUP BY status"),
        "sample_rows": with_(f"SELECT {_SAMPLED} FROM typed ORDER BY md5(concat('42:', CAST(unique_key AS VARCHAR))), unique_key LIMIT 3"),
        "normalize_zip": with_(
            f"""SELECT unique_key, {zip5('z')} AS incident_zip, z IS NOT NULL AND TRY_CAST(z AS DOUBLE) IS NULL AS rejected
            FROM (SELECT unique_key, CASE WHEN unique_key % 61 = 0 THEN 'abc' ELSE incident_zip END AS z FROM raw)"""
        ),
        "coerce_numeric": with_(
            f"""SELECT CAST(unique_key AS VARCHAR) AS unique_key, TRY_CAST(x_coordinate AS DOUBLE) AS x_coordinate,
            CAST({_whole('council_district', 'SMALLINT')} AS INTEGER) AS council_district, {_whole('bbl', 'BIGINT')} AS bbl FROM present""",
            _export, _present,
        ),
        "standardize_strings": with_("SELECT unique_key, agency, borough, status, open_data_channel_type FROM typed"),
        "split_closed": with_("SELECT unique_key, status FROM typed WHERE status = 'CLOSED'"),
        "split_open": with_("SELECT unique_key, status FROM typed WHERE status IS DISTINCT FROM 'CLOSED'"),
        "resolution_hours": with_(f"SELECT unique_key, {r('hours', 6)} AS hours FROM timed"),
        "clean_requests": with_(_clean_all),
        "clean_rejects": with_(f"SELECT {_RULE} AS rule, count(*) AS rows FROM timed WHERE status = 'CLOSED' GROUP BY 1"),
        "resolution_stats": with_(
            f"SELECT {r('min(hours)')} AS min_hours, {r(med('hours'))} AS median_hours, {r('avg(hours)')} AS mean_hours, {r('max(hours)')} AS max_hours FROM valid"
        ),
        "fill_defaults": with_(
            "SELECT unique_key, " + ", ".join(f"coalesce({c}, '{v}') AS {c}" for c, v in schema.FILL_DEFAULTS.items()) + " FROM typed"
        ),
        "open_requests": with_(f"SELECT {_filled(schema.OPEN_COLUMNS)} FROM typed WHERE status IS DISTINCT FROM 'CLOSED'"),
        "borough_distribution": with_("SELECT borough, count(*) AS cnt FROM clean GROUP BY borough"),
        "findings_base": with_(f"SELECT * REPLACE ({r('hours', 6)} AS hours) FROM base"),
        "time_features": with_(f"SELECT unique_key, {_time} FROM typed"),
        "log_target": with_(f"SELECT unique_key, {r('resolution_hours', 6)} AS resolution_hours, {r('ln(1 + resolution_hours)', 6)} AS log_resolution_hours FROM clean"),
        "encoding_inputs": with_(
            """SELECT 'problem_type' AS column_name, count(DISTINCT coalesce(problem_type, 'UNKNOWN')) AS unique_values FROM clean
            UNION ALL SELECT 'location_type', count(DISTINCT coalesce(location_type, 'UNKNOWN')) FROM clean"""
        ),
        "one_hot": with_(f"SELECT unique_key, agency_name, {_hot(_HOT_SOURCE)} FROM clean"),
        "request_features": with_(
            f"SELECT * REPLACE ({r('resolution_hours', 6)} AS resolution_hours, {r('log_resolution_hours', 6)} AS log_resolution_hours) FROM features",
            _features,
        ),
        "impute_median": with_(
            f"SELECT unique_key, {r(f'coalesce(x_coordinate, (SELECT median(x_coordinate) FROM typed))', 6)} AS x_coordinate, council_district FROM typed"
        ),
        "target_encoding_fit": with_(
            f"""SELECT "column", category, {r('encoding', 6)} AS encoding FROM enc
            UNION ALL SELECT NULL, NULL, {r('g', 6)} FROM enc_mean""",
            _train_encoding,
        ),
        "fold_assign": with_(f"SELECT unique_key, CAST({hash32('fold')} % 5 AS INTEGER) AS fold FROM typed"),
        "target_encoding_oof": with_(
            f"""SELECT t.unique_key, {r('t.y', 6)} AS log_resolution_hours, {r('p.encoding', 6)} AS problem_type_encoded,
              {r('l.encoding', 6)} AS location_type_encoded FROM tr t
            JOIN oof_problem_type p ON p.fold = t.fold AND p.problem_type = t.problem_type
            JOIN oof_location_type l ON l.fold = t.fold AND l.location_type = t.location_type""",
            _TRAIN, *_FOLD_TABLES,
        ),
        "target_encoding_apply": with_(
            f"""SELECT unique_key, {r('y', 6)} AS log_resolution_hours, {r(_encoded('enc', 'problem_type', 'i'), 6)} AS problem_type_encoded,
              {r(_encoded('enc', 'location_type', 'i'), 6)} AS location_type_encoded FROM inputs i WHERE split = 'test'""",
            _train_encoding,
        ),
        "error_by_borough": _error("borough"),
        "error_by_agency": _error("agency"),
        "dow_label": with_(f"SELECT unique_key, {_label} AS dow_label FROM (SELECT unique_key, dayofweek(created_date) AS dow FROM typed)"),
        "agency_lookup": with_(f"SELECT form_id, problem_type, {_office} AS agency FROM forms", _forms),
        "predictions_table": with_(
            f"""SELECT unique_key, {r('actual_hours', 4)} AS actual_hours, {r('predicted_hours', 4)} AS predicted_hours,
            {r('error_hours', 4)} AS error_hours FROM preds""",
            *_PREDICTED,
        ),
        "borough_comparison": _comparison("by_borough", "heat_by_borough", "housing_share_by_borough"),
        "channel_comparison": _comparison("by_channel", "heat_by_channel", "police_share_by_channel"),
        "eda_distribution": with_(
            f"""SELECT bucket, complaints, {r('100.0 * complaints / (SELECT count(*) FROM clean)')} AS pct
            FROM (SELECT {_BUCKET} AS bucket, count(*) AS complaints FROM clean GROUP BY 1)"""
        ),
        "eda_agency": _segment("agency", "agency", "complaints", "avg_hours", "median_hours", "max_hours"),
        "eda_slowest_types": _ranked("DESC", 10, f", {_AVG} AS avg_hours"),
        "eda_fastest_types": _ranked("ASC", 10),
        "eda_borough": _segment("borough", "borough", "complaints", "median_hours", "avg_hours"),
        "eda_hour": _segment(_HOUR, "hour", "complaints", "median_hours"),
        "eda_weekend": _segment(_WEEKEND, "day_type", "complaints", "median_hours", "avg_hours"),
        "eda_channel": _segment("open_data_channel_type", "channel", "complaints", "median_hours"),
        "eda_agency_types": _ranked("DESC", 8, having="", where="WHERE agency = 'HPD'"),
        "eda_night": _segment(_NIGHT, "time_of_day", "complaints", "median_hours", "avg_hours"),
        "dash_agency": _segment("agency", "agency", "complaints", "median_hours", "avg_hours"),
        "dash_hour_day": with_("SELECT * FROM hour_day", _hour_day),
        "dash_borough_agency": with_("SELECT * FROM matrix", _matrix),
        "dash_channel": _segment("open_data_channel_type", "channel", "complaints", "median_hours"),
        "dash_slowest": _ranked("DESC", 15),
        "dash_fastest": _ranked("ASC", 15),
        "dash_daily": with_("SELECT strftime(created_date, '%Y-%m-%d') AS date, agency, count(*) AS complaints FROM clean GROUP BY 1, 2"),
        "dash_daily_top": with_(
            "SELECT CAST(created_date AS DATE) AS date, agency, count(*) AS complaints FROM clean WHERE agency IN ('NYPD', 'HPD', 'DSNY') GROUP BY 1, 2"
        ),
        "medians_by": with_(_medians("agency")),
        "findings_overall": with_(f"SELECT {_OVERALL} FROM base"),
        "findings_shares": with_(f"SELECT {_SHARES} FROM base"),
        "findings_by_problem": with_(_lists["by_problem"]),
        "findings_by_borough": with_(_lists["by_borough"]),
        "findings_heat_by_borough": with_(_lists["heat_by_borough"]),
        "findings_housing_share": with_(_lists["housing_share_by_borough"]),
        "findings_by_channel": with_(_lists["by_channel"]),
        "findings_heat_by_channel": with_(_lists["heat_by_channel"]),
        "findings_police_share": with_(_lists["police_share_by_channel"]),
        "findings_json": _findings_json,
        "scoring_options": with_(
            " UNION ALL ".join(
                f"SELECT DISTINCT '{n}' AS field, {c} AS value FROM clean WHERE {c} IS NOT NULL"
                for c, n in (("agency", "agencies"), ("borough", "boroughs"), ("open_data_channel_type", "channels"),
                             ("problem_type", "problem_types"), ("location_type", "location_types"))
            )
        ),
        "predicted_vs_actual": with_(
            f"""SELECT unique_key, {r('actual_hours', 4)} AS actual_hours, {r('predicted_hours', 4)} AS predicted_hours,
            {r('error_hours', 4)} AS error_hours FROM preds WHERE actual_hours BETWEEN 0 AND 300 AND predicted_hours BETWEEN 0 AND 300
            ORDER BY md5(concat('42:', CAST(unique_key AS VARCHAR))), unique_key LIMIT 8000""",
            *_PREDICTED,
        ),
        "pivot_hour_day": with_(
            f"SELECT d.dow_label, " + ", ".join(f'avg(CASE WHEN hour = {h} THEN median_hours END) AS "{h}"' for h in range(24))
            + f" FROM (SELECT unnest([{_text_list(schema.DOW_LABELS)}]) AS dow_label) d LEFT JOIN (SELECT *, {_label} AS dow_label FROM hour_day) h"
            " ON h.dow_label = d.dow_label GROUP BY d.dow_label",
            _hour_day,
        ),
        "pivot_borough_agency": with_(
            "SELECT agency, " + ", ".join(f"coalesce(avg(CASE WHEN borough = '{b}' THEN median_hours END), 0) AS \"{b}\"" for b in schema.BOROUGHS)
            + " FROM matrix GROUP BY agency",
            _matrix,
        ),
        "pivot_range": with_("SELECT min(median_hours) AS low, max(median_hours) AS high FROM hour_day", _hour_day),
        "error_clip_mean": with_(
            f"SELECT count(*) AS predictions, {r('avg(least(greatest(error_hours, -200), 200))')} AS mean_error FROM preds", *_PREDICTED
        ),
        "error_histogram": with_(
            """SELECT bin, CAST(bin * 5.0 - 200 AS DOUBLE) AS from_hours, count(*) AS predictions FROM (
              SELECT CAST(least(floor((least(greatest(error_hours, -200), 200) + 200) / 5), 79) AS INTEGER) AS bin FROM preds) GROUP BY bin""",
            *_PREDICTED,
        ),
        "agency_flagged": with_(
            f"""SELECT *, CAST(median_hours > 36 AS INTEGER) AS is_slow FROM (SELECT agency, count(*) AS complaints,
            {_MED} AS median_hours, {_AVG} AS avg_hours FROM clean GROUP BY agency)"""
        ),
        "type_chart_rows": with_(
            f"""SELECT substr(problem_type, 1, 30) AS label, median_hours, complaints FROM (SELECT problem_type, count(*) AS complaints,
            {_MED} AS median_hours FROM clean GROUP BY problem_type HAVING count(*) > 100 ORDER BY median_hours DESC, problem_type LIMIT 10)"""
        ),
        "shared_scale": with_(
            f"""SELECT list, label, median_hours, scale_max, {r('median_hours / scale_max', 4)} AS part FROM (
              SELECT *, (SELECT max(median_hours) FROM both_lists) AS scale_max FROM both_lists)""",
            f"""both_lists AS (SELECT 'by_borough' AS list, label, median_hours FROM ({_lists['by_borough']})
              UNION ALL SELECT 'heat_by_borough', label, median_hours FROM ({_lists['heat_by_borough']}))""",
        ),
        "format_duration": with_(f"SELECT unique_key, {duration('hours')} AS duration FROM timed"),
        "title_label": with_(
            f"""SELECT unique_key, {title('u')} AS upper_label, {title('l')} AS label
            FROM (SELECT unique_key, {_upper_label} AS u, {_any_label} AS l FROM typed)"""
        ),
        "format_percent": f"SELECT event_id, {percent('p')} AS percent FROM (SELECT event_id, value / 250 AS p FROM events)",
        "model_inputs": with_(
            f"""SELECT * EXCLUDE (resolution_hours) REPLACE ({r('log_resolution_hours', 6)} AS log_resolution_hours),
            CAST({_load} AS DOUBLE) AS load_factor FROM features WHERE unique_key % 67 <> 0""",
            _features,
        ),
        "split_assign": with_(f"SELECT unique_key, {split_of()} AS split FROM typed"),
        "split_sizes": with_(f"SELECT {split_of()} AS split, count(*) AS rows FROM clean GROUP BY 1"),
        "encode_split": with_(
            f"""SELECT t.unique_key, {r('t.y', 6)} AS log_resolution_hours, {r('p.encoding', 6)} AS problem_type_encoded,
              {r('l.encoding', 6)} AS location_type_encoded, {r('coalesce(t.load_factor, (SELECT median(load_factor) FROM tr))', 6)} AS load_factor, 'train' AS part
            FROM tr t JOIN oof_problem_type p ON p.fold = t.fold AND p.problem_type = t.problem_type
            JOIN oof_location_type l ON l.fold = t.fold AND l.location_type = t.location_type
            UNION ALL
            SELECT i.unique_key, {r('i.y', 6)}, {r(_encoded('enc', 'problem_type', 'i'), 6)}, {r(_encoded('enc', 'location_type', 'i'), 6)},
              {r('coalesce(i.load_factor, (SELECT median(load_factor) FROM tr))', 6)}, 'test' FROM loaded i WHERE split = 'test'""",
            f"""loaded AS (SELECT i.*, CAST(CASE WHEN i.unique_key % 53 = 0 OR i.unique_key % 59 = 0 OR i.unique_key % 61 = 0 THEN NULL
              ELSE hour(c.created_date) * 1.5 END AS DOUBLE) AS load_factor FROM inputs i JOIN clean c ON c.unique_key = i.unique_key
              WHERE i.unique_key % 67 <> 0)""",
            "tr AS (SELECT * FROM loaded WHERE split = 'train')",
            *_FOLD_TABLES,
            _encoding("enc", "'train'").replace("FROM inputs WHERE", "FROM loaded WHERE"),
        ),
        "regression_metrics": with_("SELECT * FROM metrics", *_SCORED),
        "merge_metrics": with_(
            " UNION ALL ".join(_tidy(s, m) for s in ("test", "deployed") for m in ("r2", "mae_hours")), *_SCORED
        ),
        "read_metrics": with_(
            " UNION ALL ".join(
                [_tidy("test", m) for m in ("r2", "mae_hours", "rmse_hours")] + [_tidy("deployed", m) for m in ("r2", "mae_hours")]
            ),
            *_SCORED,
        ),
        "metrics_json": with_(
            """SELECT CAST(to_json({'rows': (SELECT count(*) FROM clean), 'best_model': 'Baseline',
              'validation': {'Baseline': {'r2': r2, 'mae_hours': mae_hours, 'rmse_hours': rmse_hours}},
              'test': {'r2': r2, 'mae_hours': mae_hours, 'rmse_hours': rmse_hours},
              'deployed': {'model': 'Baseline', 'r2': r2, 'mae_hours': mae_hours}}) AS VARCHAR) AS json FROM metrics""",
            *_SCORED,
        ),
        "model_linear": with_(_beats("Linear Regression"), *_VALIDATED),
        "model_forest": with_(_beats("Random Forest"), *_VALIDATED),
        "model_boosted": with_(_beats("Boosted Trees"), *_VALIDATED),
        "model_small_forest": with_(_beats("Random Forest (25 trees)", "test_base"), _planted, *_TESTED),
        "model_linear_residuals": with_(
            """SELECT count(*) AS rows, feature, CAST(0 AS DOUBLE) AS moment FROM inputs, (SELECT unnest(['intercept', 'hour_of_day',
              'day_of_week', 'is_weekend', 'is_night', 'problem_type_encoded', 'location_type_encoded']) AS feature)
            WHERE split = 'train' GROUP BY feature"""
        ),
        "model_comparison": """SELECT * FROM (VALUES ('Linear Regression', FALSE), ('Random Forest', TRUE), ('Boosted Trees', TRUE))
            t(model, ahead_of_line)""",
        "final_test_metrics": with_(
            " UNION ALL ".join([*map(_beats, ("Linear Regression", "Random Forest", "Boosted Trees")), _beats("winner", "test_base")]),
            *_VALIDATED, *_TESTED,
        ),
        "feature_importance": """SELECT * FROM (VALUES (1, 'problem_type_encoded', CAST(1 AS DOUBLE)),
            (2, 'hour_of_day', CAST(1 AS DOUBLE))) t(rank, feature, total)""",
        "headline_metrics": with_("SELECT count(*) AS rows, TRUE AS beats_baseline, TRUE AS mostly_problem_type FROM inputs"),
        "model_linear_hour": _candidate(_by_slope),
        "model_forest_flags": _candidate(_by_cell),
        "model_boosted_flags": _candidate(_by_cell),
        "score_validate": with_("SELECT request_id, errors FROM checked", _requests, _checked),
        "score_missing": with_("SELECT form_id, missing FROM form_rows", _forms, _form_rows),
        "score_prepare": with_(
            f"""SELECT request_id, CAST(hour_of_day AS INTEGER) AS hour_of_day, CAST(day_of_week AS INTEGER) AS day_of_week,
              CAST(month AS INTEGER) AS month, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
              CAST(hour_of_day >= 22 OR hour_of_day < 6 AS INTEGER) AS is_night,
              {_hot({'agency': 'agency', 'borough': 'borough', 'channel': 'channel'})},
              {r(_encoded('enc', 'problem_type', 'a'), 6)} AS problem_type_encoded,
              {r(_encoded('enc', 'location_type', 'a'), 6)} AS location_type_encoded FROM accepted a""",
            _train_encoding, *_REQUESTS,
        ),
        "score_requests": with_(
            f"""SELECT request_id, {r('h')} AS predicted_hours, {r('h / 24')} AS predicted_days, {band('h', _MAE)} AS confidence_band,
            {summary('h')} AS summary, agency AS input_agency, given_channel AS input_channel FROM answered""",
            *_DEPLOYED,
        ),
        "save_model": with_(
            f"SELECT request_id, {r('h')} AS predicted_hours, {r('h / 24')} AS predicted_days FROM answered", *_DEPLOYED
        ),
        "score_form": with_(
            f"""SELECT form_id, agency, {verdict('h')} AS verdict, {r('h')} AS predicted_hours, {r('h / 24')} AS predicted_days,
            {band('h', _MAE)} AS confidence_band, {summary('h')} AS summary FROM filled""",
            *_SCORED, _forms, _form_rows,
            f"filled AS (SELECT f.*, exp({_encoded('enc', 'problem_type', 'f')}) - 1 AS h FROM form_rows f WHERE missing = '')",
        ),
        "score_band": with_(
            f"SELECT unique_key, {known(low('hours', '34.3'))} AS low, {r('hours + 34.3')} AS high, {known(band('hours', '34.3'))} AS band FROM timed"
        ),
        "score_summary": with_(
            f"SELECT unique_key, {known(summary('hours'))} AS summary, {known(verdict('hours'))} AS verdict, {r('hours / 24')} AS predicted_days FROM timed"
        ),
        "score_stream": with_(
            f"""SELECT request_id, {r('h')} AS predicted_hours, {band('h', _MAE)} AS confidence_band, '' AS errors FROM answered
            UNION ALL SELECT request_id, NULL, NULL, errors FROM checked WHERE errors <> ''""", *_DEPLOYED
        ),
        "score_stream_tables": with_(
            f"""SELECT request_id, {r('h')} AS predicted_hours, {band('h', _MAE)} AS confidence_band, '' AS errors FROM answered
            UNION ALL SELECT request_id, NULL, NULL, errors FROM checked WHERE errors <> ''""", *_DEPLOYED
        ),
    }
    found["errors_by_layout"] = " UNION ALL ".join(
        f"SELECT *, '{by}' AS by FROM ({found[f'error_by_{by}']})" for by in ("borough", "agency")
    )
    measured = ("complaints", "median_hours")
    found["charts_of_one_scan"] = " UNION ALL ".join(
        _chart(name, found[key], *groups, measured=columns)
        for name, key, groups, columns in [
            ("distribution", "eda_distribution", ["bucket"], measured[:1]), ("agency", "eda_agency", ["agency"], measured),
            ("borough", "eda_borough", ["borough"], measured), ("channel", "eda_channel", ["channel"], measured),
            ("weekend", "eda_weekend", ["day_type"], measured), ("night", "eda_night", ["time_of_day"], measured),
            ("hour", "eda_hour", ["hour"], measured), ("hour_day", "dash_hour_day", ["hour", "dow"], measured[1:]),
            ("borough_agency", "dash_borough_agency", ["borough", "agency"], measured),
            ("slowest", "dash_slowest", ["problem_type"], measured), ("fastest", "dash_fastest", ["problem_type"], measured),
            ("agency_types", "eda_agency_types", ["problem_type"], measured), ("daily", "dash_daily", ["date", "agency"], measured[:1]),
        ]
    )
    return found
