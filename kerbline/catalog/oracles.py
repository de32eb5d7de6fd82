"""SQL for a second engine that must give the same rows as each registered query."""

from __future__ import annotations

from kerbline import constants as C
from kerbline.catalog.queries import COMPLIANCE, FEED_LINES, MIN_CIS, MIN_SCORES, PER_UNIT, SEARCHES, SHOWN_CIS, STATED_TREES, STATION, UNITS, VEHICLE
from kerbline.catalog.tables import PLACES, VEHICLES, VIOLATIONS
from kerbline.functions.scoring import tenths

INPUTS = "hour, day_of_week, month, w_size, w_type, w_road, vehicle_type, police_station, primary_violation"
LEFT = f"{(100 - COMPLIANCE) / 100.0!r}::DOUBLE"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _map(weights) -> str:
    return "MAP {" + ", ".join(f"{_text(k)}: {tenths(v)}" for k, v in weights.items()) + "}"


def _case(value: str, names) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN {_text(n)}" for i, n in enumerate(names)) + " END"


def np1(x: str) -> str:
    return f"(round_even(({x}) * 10, 0) / 10)"


def py1(x: str) -> str:
    return f"printf('%.1f', ({x})::DOUBLE)::DOUBLE"


def js1(x: str) -> str:
    """One decimal, exact ties (odd quarters) up."""
    return f"(CASE WHEN ({x}) * 4 % 2 = 1 THEN floor(({x}) * 10 + 0.5) / 10 ELSE {py1(x)} END)"


def norm(x: str) -> str:
    return f"least(10e0, {np1(f'({x}) * 4.14e0')})"


def bands(x: str, cuts, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {c} THEN {_text(t)}" for c, t in cuts) + f" ELSE {_text(other)} END"


ACTIONS = ((8.0, "Tow Immediately"), (5.0, "Deploy Officers"))
STATUSES = ((8.0, "critical"), (5.0, "active"))


LATITUDE = ("(129000 + j * 100 + (e % 7 - 3) * 2 + CASE WHEN e % 53 = 0 THEN 5000 + (37 * e) % 1000 * 100 ELSE 0 END) / 10000")
LONGITUDE = "(775000 + j * 100 + ((e // 7) % 7 - 3) * 2) / 10000"


def _tickets(name: str, junction_suffix: str, latitude: str = LATITUDE, longitude: str = LONGITUDE) -> str:
    return f"""{name}_raw AS (
  SELECT e AS id, ts AS created_datetime,
    {_case('(e + u) % 15', VEHICLES)} AS vehicle_type,
    CASE WHEN e % 97 = 0 THEN NULL
         WHEN k % 8 <= 3 THEN '["' || {_case('e % 11', VIOLATIONS)} || '"]'
         WHEN k % 8 <= 5 THEN '["' || {_case('e % 11', VIOLATIONS)} || '","' || {_case('(e + 3) % 11', VIOLATIONS)} || '"]'
         WHEN k % 8 = 6 THEN {_case('e % 11', VIOLATIONS)}
         ELSE '[]' END AS violation_type,
    CASE WHEN e % 101 <> 0 THEN {_case('u % 6', PLACES)} END AS location,
    CASE WHEN j = 0 THEN NULL WHEN j = 1 THEN 'No Junction'
         WHEN j <= 9 THEN 'BTP00' || j || ' - Junction'{junction_suffix}
         ELSE 'Circle ' || j{junction_suffix} END AS junction_name,
    CASE WHEN u % 9 <> 0 THEN 'Station ' || (u % 9) END AS police_station,
    CASE WHEN k % 4 <= 1 THEN 'approved' WHEN k % 4 = 2 THEN 'rejected' END AS validation_status,
    {latitude} AS latitude, {longitude} AS longitude
  FROM (SELECT event_id AS e, user_id AS u, user_id % 13 AS j, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
{name}_clean AS (
  SELECT * REPLACE (coalesce(vehicle_type, 'UNKNOWN') AS vehicle_type, coalesce(location, 'UNKNOWN') AS location,
    coalesce(police_station, 'UNKNOWN') AS police_station, coalesce(junction_name, 'No Junction') AS junction_name),
    CAST(hour(created_datetime) AS INTEGER) AS hour, CAST(isodow(created_datetime) - 1 AS INTEGER) AS day_of_week,
    CAST(month(created_datetime) AS INTEGER) AS month,
    CASE WHEN violation_type IS NULL THEN CAST([] AS VARCHAR[])
         WHEN violation_type LIKE '[%' THEN CAST(CAST(violation_type AS JSON) AS VARCHAR[])
         ELSE [violation_type] END AS violations
  FROM {name}_raw),
{name}_weighed AS (
  SELECT *, coalesce({_map(C.VEHICLE_WEIGHTS)}[vehicle_type], 10) AS s,
    coalesce(list_max(list_transform(violations, lambda v: coalesce({_map(C.VIOLATION_WEIGHTS)}[v], 10))), 10) AS t,
    CASE WHEN lower(junction_name) LIKE '%btp%' THEN 30
         WHEN lower(location) LIKE '%metro station%' OR lower(location) LIKE '%market%' THEN 28
         WHEN regexp_matches(lower(location), 'main road|ring road|highway|flyover') THEN 20
         WHEN regexp_matches(lower(location), 'cross|layout') THEN 8 ELSE 12 END AS r
  FROM {name}_clean),
{name} AS (
  SELECT *, s / 10e0 AS w_size, t / 10e0 AS w_type, r / 10e0 AS w_road, CAST(s * t * r AS BIGINT) AS milli,
    s * t * r / 1000e0 AS cis, coalesce(violations[1], 'UNKNOWN') AS primary_violation
  FROM {name}_weighed)"""


TICKETS = _tickets("scored", "")
BY_USER = _tickets("by_user", " || ' #' || u")
STREETS = _tickets("scored", "", """(CASE WHEN e % 9 <= 4 THEN 12800000 + e % 40 * 10000 + e % 5 * 20 WHEN e % 9 <= 6 THEN 12950000 + e % 13 * 10
      WHEN e % 9 = 7 THEN 12801400 + e % 40 * 10000 + e % 3 * 50 ELSE 12700000 + (e * 104729) % 500000 END) / 1000000""",
    """(CASE WHEN e % 9 <= 4 THEN 77400000 + (e * 7919) % 2000 * 10 WHEN e % 9 <= 6 THEN 77600000 + (e // 13) % 13 * 10
      WHEN e % 9 = 7 THEN 77400000 + (e * 31) % 2000 * 10 ELSE 77300000 + (e * 15485863) % 500000 END) / 1000000""")
ODD_LATITUDE = ("CASE e % 20 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN 'inf'::DOUBLE ELSE " + LATITUDE + " END")
ODD_LONGITUDE = "CASE e % 20 WHEN 3 THEN 'nan'::DOUBLE WHEN 4 THEN '-inf'::DOUBLE ELSE " + LONGITUDE + " END"
ODD = _tickets("scored", "", ODD_LATITUDE, ODD_LONGITUDE)
PROBABILITY = "CASE id % 10 WHEN 0 THEN NULL WHEN 1 THEN 0.5 WHEN 2 THEN 0.6999 WHEN 3 THEN 0.7 ELSE (75 + id % 10) / 100 END::DOUBLE"


JUDGED = f"""judged AS (
  SELECT score, count(*) FILTER (validation_status = 'approved') AS approved, count(*) FILTER (validation_status = 'rejected') AS rejected
  FROM (SELECT validation_status, {PROBABILITY} AS score FROM scored WHERE validation_status IN ('approved', 'rejected')) WHERE score IS NOT NULL GROUP BY score)"""


def _mean(column: str) -> str:
    """Mean coordinate from whole degrees and 1e-7 parts."""
    part = f"CAST(floor(({column} - floor({column})) * 1e7 + 0.5e0) AS BIGINT)"
    return f"((CAST(sum(CAST(floor({column}) AS BIGINT)) AS DOUBLE) + CAST(sum({part}) AS DOUBLE) / 1e7) / count({column}))"


def _round5(x: str) -> str:
    return f"round_even({x} * 1e5, 0) / 1e5"


MILLI = "CAST(sum(milli) AS BIGINT)"
RAW = f"({MILLI} / (1000 * count(*)))"


def _junctions(source: str) -> str:
    """named, mix, peak, trend and records per junction of a source."""
    hours = ", ".join(
        f"coalesce(CAST(sum(milli) FILTER (hour = {h}) AS BIGINT) / (1000 * count(*) FILTER (hour = {h})), "
        f"{RAW} * {C.QUIET_FACTOR if h in C.QUIET_TREND_HOURS else C.BUSY_FACTOR}::DOUBLE) AS h{h}"
        for h in C.TREND_HOURS)
    multipliers = ", ".join(
        f"coalesce(CAST(sum(milli) FILTER (hour = {h}) AS BIGINT) / (1000 * count(*) FILTER (hour = {h})) / {RAW}, "
        f"{C.QUIET_FACTOR if h in C.QUIET_TREND_HOURS else C.BUSY_FACTOR}::DOUBLE) AS m{h}"
        for h in C.TREND_HOURS)
    short = "replace(replace(vehicle_type, 'MOTOR CYCLE', 'MOTORCYCLE'), 'PRIVATE BUS', 'BUS')"
    return f"""named AS (SELECT * FROM {source} WHERE junction_name <> 'No Junction'),
summary AS (
  SELECT junction_name, arg_min(police_station, id) AS jurisdiction, count(*) AS violations, {RAW} AS raw_cis,
    {MILLI} AS milli, {_round5(_mean('latitude'))} AS lat, {_round5(_mean('longitude'))} AS lng
  FROM named GROUP BY junction_name),
mix AS (
  SELECT junction_name, vehicle_type, count(*) AS n,
    count(*) / sum(count(*)) OVER (PARTITION BY junction_name) * 100 AS percentage,
    row_number() OVER (PARTITION BY junction_name ORDER BY count(*) DESC, vehicle_type) AS place, {short} AS short
  FROM named GROUP BY junction_name, vehicle_type),
mix_text AS (
  SELECT junction_name,
    string_agg(short || ' (' || printf('%.0f', percentage) || '%)', ', ' ORDER BY place) FILTER (place <= 3) AS vehicle_mix,
    string_agg(vehicle_type || ' (' || printf('%.1f', percentage) || '%)', ', ' ORDER BY place) FILTER (place <= 3) AS vehicle_mix_detail,
    string_agg(short || ' (' || CAST(floor({py1('percentage')} + 0.5) AS BIGINT) || '%)', ', ' ORDER BY place) FILTER (place <= 2) AS two_vehicles,
    string_agg(short || '=' || printf('%.1f', percentage), ',' ORDER BY place) FILTER (place <= 5) AS mix_data
  FROM mix GROUP BY junction_name),
peak AS (
  SELECT junction_name, hour AS peak_hour_val, n AS peak_hour_violations, printf('%02d:00', hour) AS peak_hour,
    printf('%02d:00', hour) || ' (' || n || ' violations)' AS peak_hour_text
  FROM (SELECT junction_name, hour, count(*) AS n,
          row_number() OVER (PARTITION BY junction_name ORDER BY count(*) DESC, hour) AS place
        FROM named GROUP BY junction_name, hour) WHERE place = 1),
trend AS (SELECT junction_name, {hours} FROM named GROUP BY junction_name),
multiplier AS (SELECT junction_name, {multipliers} FROM named GROUP BY junction_name),
records AS (
  SELECT row_number() OVER (ORDER BY violations DESC, junction_name) AS id, junction_name AS name, jurisdiction, violations,
    round_even(raw_cis * 1000, 0) / 1000 AS raw_cis, {norm('raw_cis')} AS cis,
    CAST(trunc(violations / 150 * 12) AS BIGINT) AS affected_vehicles,
    {np1('raw_cis * 2')} AS avg_delay,
    (milli * 375) // (10000 * 150) AS economic_cost, (milli * 345) // (1000000 * 150) AS co2_impact, lat, lng
  FROM summary),
hotspots AS (
  SELECT r.*, {bands('cis', STATUSES, 'neutral')} AS status, {bands('cis', ACTIONS, 'Routine Patrol')} AS action,
    least(50e0, {np1('cis * 5')}) AS expected_improvement, least(95e0, {np1('cis * 4.5e0')}) AS capacity_loss,
    vehicle_mix, mix_data
  FROM records r JOIN mix_text m ON m.junction_name = r.name)"""


def _top(n: int) -> str:
    return f"""top AS (
  SELECT row_number() OVER (ORDER BY violations DESC, junction_name) AS position, junction_name, violations,
    round_even(raw_cis * 100, 0) / 100 AS cis,
    {bands('raw_cis', ((3.0, 'Tow Immediately'), (2.0, 'Deploy Officers')), 'Routine Patrol')} AS recommendation
  FROM summary ORDER BY position LIMIT {n})"""


TREND_ROWS = " UNION ALL ".join(
    f"SELECT junction_name, '{h:02d}:00' AS hour_name, {norm(f'h{h}')} AS cis FROM trend" for h in C.TREND_HOURS)
MULTIPLIER_ROWS = " UNION ALL ".join(
    f"SELECT junction_name, {h} AS hour, m{h} AS multiplier FROM multiplier" for h in C.TREND_HOURS)
TREND_TEXT = " || ',' || ".join(f"'{h:02d}:00=' || CAST({norm(f'h{h}')} AS VARCHAR)" for h in C.TREND_HOURS)

EPS2 = f"({C.EPS_DEGREES!r}::DOUBLE * {C.EPS_DEGREES!r}::DOUBLE)"
_CLUSTERS = f"""eligible AS (SELECT * FROM scored WHERE milli >= 1500 AND PROBABLE AND isfinite(latitude) AND isfinite(longitude)),
sites AS (SELECT latitude, longitude, count(*) AS weight, min(id) AS first_id FROM eligible GROUP BY latitude, longitude),
near AS (
  SELECT a.first_id AS a, b.first_id AS b, b.weight
  FROM sites a JOIN sites b ON b.latitude BETWEEN a.latitude - 0.002 AND a.latitude + 0.002
  WHERE (a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude) <= {EPS2}),
core AS (SELECT a AS site FROM near GROUP BY a HAVING sum(weight) >= 15),
links AS (SELECT n.a, n.b FROM near n JOIN core x ON x.site = n.a JOIN core y ON y.site = n.b),
reach(a, b) AS (SELECT site, site FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS site, min(b) AS root FROM reach GROUP BY a),
numbered AS (SELECT site, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS label FROM roots),
site_labels AS (
  SELECT s.latitude, s.longitude, coalesce(min(own.label), min(other.label)) AS label
  FROM sites s LEFT JOIN numbered own ON own.site = s.first_id
  LEFT JOIN near n ON n.a = s.first_id LEFT JOIN numbered other ON other.site = n.b
  GROUP BY s.latitude, s.longitude),
labelled AS (
  SELECT t.*, CASE WHEN t.milli >= 1500 AND PROBABLE THEN coalesce(l.label, -1) ELSE -1 END AS cluster_label
  FROM scored t LEFT JOIN site_labels l ON l.latitude = t.latitude AND l.longitude = t.longitude),
clusters AS (
  SELECT cluster_label, {_mean('latitude')} AS lat, {_mean('longitude')} AS lng, count(*) AS violations_count,
    {RAW} AS avg_cis, {MILLI} * 375 / 1e4 AS economic_loss, arg_min(police_station, id) AS police_station
  FROM labelled WHERE cluster_label <> -1 GROUP BY cluster_label)"""

CLUSTERS = _CLUSTERS.replace("PROBABLE", "true")
LIKELY_CLUSTERS = _CLUSTERS.replace("PROBABLE", f"({PROBABILITY}) >= 0.7")

LITERAL_ROADS = " UNION ALL ".join(
    "SELECT {} AS id, {} AS name, [{}] AS path, {} AS speed, {} AS free_flow_speed, {} AS congestion, "
    "{}::DOUBLE AS estimated_delay, {} AS parking_suspected".format(
        _text(i), _text(n), ", ".join("{" + f"'lat': {a!r}::DOUBLE, 'lng': {b!r}::DOUBLE" + "}" for a, b in path),
        speed, free, _text(colour), delay, suspected)
    for i, n, path, speed, free, colour, _, delay, suspected in C.CORRIDORS)
_STEPS = ", ".join(
    "{" + f"'lat': (12900 + s_suppkey * 37 % 500) / 1000 + 0.003::DOUBLE * {i}, "
    f"'lng': (77500 + s_suppkey * 13 % 130) / 1000 + 0.002::DOUBLE * {i}" + "}" for i in range(3))
ROADS = f"""roads AS (
  {LITERAL_ROADS}
  UNION ALL
  SELECT 'S' || s_suppkey, 'Road ' || s_suppkey, [{_STEPS}], s_suppkey * 7 % 60 + 3, s_suppkey * 11 % 40 + 45,
    {_case('s_suppkey % 5', ('dark-red', 'red', 'orange', 'yellow', 'green'))}, s_suppkey * 3 % 90 / 10, s_suppkey % 3 <> 0
  FROM supplier)"""
LINKS = f"""points AS (SELECT id, unnest(path) AS p FROM roads),
linked AS (
  SELECT DISTINCT p.id, h.id AS hotspot_id, h.name
  FROM (SELECT id, p.lat AS a, p.lng AS o FROM points) p, hotspots h
  WHERE 2 * 6371 * asin(sqrt(pow(sin(radians(h.lat - p.a) / 2), 2)
    + cos(radians(p.a)) * cos(radians(h.lat)) * pow(sin(radians(h.lng - p.o) / 2), 2))) < 1.0)"""


def _sql(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def _scored(select: str) -> str:
    return _sql(select, TICKETS)


def _user_junctions(select: str, *more: str) -> str:
    return _sql(select, BY_USER, _junctions("by_user"), *more)


def _city_junctions(select: str, *more: str) -> str:
    return _sql(select, TICKETS, _junctions("scored"), *more)


def _clustered(select: str, *more: str) -> str:
    return _sql(select, TICKETS, CLUSTERS, *more)


def _feed() -> str:
    d = C.FEED_DEFAULTS

    def known(column: str, default: str) -> str:
        return f"CASE WHEN known THEN {column} ELSE {default} END"

    trend = " || ',' || ".join(
        f"'{h:02d}:00=' || CAST({norm(f'cis * CASE WHEN known THEN m{h} ELSE 1e0 END')} AS VARCHAR)" for h in C.TREND_HOURS)
    base = "CASE WHEN known THEN base_cis ELSE 1e0 END"
    mix = ",".join(f"{n}={p}" for n, p in d["vehicle_mix_data"])
    return _user_junctions(
        f"""SELECT position AS id, junction_name AS name, {known('jurisdiction', _text(d['jurisdiction']))} AS jurisdiction,
  violations, cis AS raw_cis, n AS cis, {bands('n', STATUSES, 'neutral')} AS status,
  {bands('n', ACTIONS, 'Routine Patrol')} AS action,
  coalesce(nullif(recommendation, ''), {bands('n', ACTIONS, 'Routine Patrol')}) AS recommendation, least(50e0, {np1('n * 5')}) AS expected_improvement,
  {known('vehicle_mix', _text(d['vehicle_mix']))} AS vehicle_mix, {known('mix_data', _text(mix))} AS mix_data,
  {known('peak_hour', _text(d['peak_hour']))} AS peak_hour, {known('peak_hour_val', '9')} AS peak_hour_val,
  {known('peak_hour_violations', '100')} AS peak_hour_violations,
  CAST(trunc(violations / 150 * 12) AS BIGINT) AS affected_vehicles, {np1('cis * 2')} AS avg_delay,
  least(95e0, {py1('n * 4.5e0')}) AS capacity_loss,
  CAST(trunc(CASE WHEN known AND cost <> 0 THEN cost * (cis / {base}) ELSE violations * cis * 0.25e0 * 150e0 / 150 END) AS BIGINT) AS economic_cost,
  CAST(trunc(CASE WHEN known AND carbon <> 0 THEN carbon * (cis / {base})
    ELSE violations * cis * 0.25e0 * 1.2e0 * 0.5e0 * 2.3e0 / 150 END) AS BIGINT) AS co2_impact,
  {known('lat', '12.9716::DOUBLE')} AS lat, {known('lng', '77.5946::DOUBLE')} AS lng, {trend} AS trend
FROM joined""",
        _top(FEED_LINES),
        """published AS (
  SELECT * REPLACE (CASE WHEN position % 7 = 3 THEN '' WHEN position % 7 = 5 THEN junction_name || ' (old)' ELSE junction_name END AS junction_name,
    CASE WHEN position % 5 = 0 THEN '' WHEN position % 5 = 1 THEN NULL ELSE recommendation END AS recommendation) FROM top)""",
        f"""joined AS (
  SELECT t.*, s.junction_name IS NOT NULL AS known, s.jurisdiction, s.lat, s.lng, s.raw_cis AS base_cis, {norm('t.cis')} AS n,
    (s.milli * 375) // (10000 * 150) AS cost, (s.milli * 345) // (1000000 * 150) AS carbon,
    m.vehicle_mix, m.mix_data, p.peak_hour, p.peak_hour_val, p.peak_hour_violations, x.*EXCLUDE (junction_name)
  FROM published t LEFT JOIN summary s USING (junction_name) LEFT JOIN mix_text m USING (junction_name)
  LEFT JOIN peak p USING (junction_name) LEFT JOIN multiplier x USING (junction_name) WHERE t.junction_name <> '')""")


TOP5 = "top5 AS (SELECT * FROM hotspots ORDER BY cis DESC, id LIMIT 5)"
TOP3 = "top3 AS (SELECT *, row_number() OVER (ORDER BY cis DESC, id) AS position FROM hotspots ORDER BY position LIMIT 3)"
REASONS = (
    (8.0, "Critical bottleneck showing extreme peak-hour congestion and heavy vehicle footprint. Immediate towing enforcement required."),
    (5.0, "High violation density and sustained peak-hour concentration. Scheduled officer deployment recommended to clear transit capacity."),
)
SPLIT = "(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT % 10 < 8)"
TIERS = bands("avg_cis", ((4.0, "CRITICAL"), (2.5, "HIGH")), "MEDIUM")


def _topsis() -> str:
    names = ("total_cis", "economic_loss", "approval_rate", "recidivism")
    gap = {
        side: " + ".join(f"pow(({n} - {side}({n}) OVER ()) / sqrt(sum({n} * {n}) OVER ()) * 0.25e0, 2)" for n in names)
        for side in ("max", "min")
    }
    return _clustered(
        "SELECT cluster_label, round(far / (near + far), 6) AS closeness FROM distances",
        f"""criteria AS (
  SELECT cluster_label, {MILLI} / 1000e0 AS total_cis, {MILLI} * 375 / 1e4 AS economic_loss,
    count(*) FILTER (validation_status = 'approved') / count(*) FILTER (validation_status IN ('approved', 'rejected')) AS approval_rate,
    count(DISTINCT CAST(created_datetime AS DATE)) / (SELECT count(DISTINCT CAST(created_datetime AS DATE)) FROM labelled) AS recidivism
  FROM labelled WHERE cluster_label <> -1 GROUP BY cluster_label)""",
        f"distances AS (SELECT cluster_label, sqrt({gap['max']}) AS near, sqrt({gap['min']}) AS far FROM criteria)")


def _raw_queries() -> dict[str, str]:
    """What the texts of ``raw_texts`` stand for."""
    first, second = (_case(f"{x} % 11", VIOLATIONS) for x in ("id", "(id + 3)"))
    return {
        "mixed_times": _scored("""SELECT 'T' || id AS id, strftime(CASE id % 6 WHEN 1 THEN date_trunc('second', created_datetime) - INTERVAL 330 MINUTE
  WHEN 2 THEN date_trunc('minute', created_datetime) WHEN 5 THEN NULL ELSE date_trunc('second', created_datetime) END, '%Y-%m-%d %H:%M:%S') AS created FROM scored"""),
        "rejected_values": _scored("""SELECT count(*) FILTER (id % 6 = 5) AS created_datetime, count(*) FILTER (id % 11 = 0) AS latitude,
  count(*) FILTER (id % 13 = 0) AS longitude FROM scored"""),
        "odd_violation_texts": _scored(f"""SELECT 'T' || id AS id, CASE id % 6 WHEN 0 THEN {first} || '|' || {second} WHEN 1 THEN '{{"type": "' || {first} || '"}}'
  WHEN 2 THEN '["' || {first} || '"] extra' WHEN 3 THEN {first} || ' "x"' WHEN 4 THEN {first} ELSE {first} || ', ' || {second} END AS violations FROM scored"""),
    }


FILTERED = f"filtered AS (SELECT * FROM labelled WHERE police_station = {_text(STATION)} AND cis >= {MIN_CIS})"
NARROWED = f"""narrowed AS (
  SELECT cluster_label, {_mean('latitude')} AS lat, {_mean('longitude')} AS lng, count(*) AS violations_count,
    {RAW} AS avg_cis, {MILLI} * 375 / 1e4 AS economic_loss, arg_min(police_station, id) AS police_station
  FROM filtered WHERE cluster_label <> -1 GROUP BY cluster_label)"""


def _visits(left: float, source: str = "clusters", *more: str) -> str:
    """Patrol plan: the 15 clusters with most loss left, visited by their full loss."""
    return _clustered(
        """SELECT patrol, string_agg('Hotspot #' || cluster_label, ' -> ' ORDER BY rank) AS route,
  round(sum(economic_loss), 4) AS loss, round(avg(avg_cis), 6) AS avg_cis FROM visits GROUP BY patrol""",
        *more,
        f"""considered AS (SELECT * FROM {source} ORDER BY economic_loss * {left!r}::DOUBLE DESC, economic_loss DESC, cluster_label LIMIT 15)""",
        f"""visits AS (
  SELECT *, (rank - 1) // {PER_UNIT} + 1 AS patrol
  FROM (SELECT *, row_number() OVER (ORDER BY economic_loss DESC, cluster_label) AS rank FROM considered) WHERE rank <= {UNITS * PER_UNIT})""")


def build() -> dict[str, str]:
    loss = f"({MILLI} * 375 / 1e4 * {LEFT})"
    carbon = f"({MILLI} * 345 / 1e6 * {LEFT})"
    cube_loss, cube_carbon = f"(total * 375 / 1e4 * {LEFT})", f"(total * 345 / 1e6 * {LEFT})"
    audit = _clustered(
        f"""SELECT c.cluster_label, c.violations_count AS violations, v.vehicle_type AS top_vehicle,
  v.n / c.violations_count * 100 AS top_vehicle_pct, w.violation AS top_violation, c.avg_cis,
  850000 * c.violations_count / (c.violations_count * 10000) AS avg_approval_pct, c.economic_loss * {LEFT} AS economic_loss,
  {TIERS} AS tier,
  'Hotspot prioritized as ' || {TIERS} || ' due to a high density of ' || w.violation ||
  ' violations. Analysis reveals that ' || printf('%.1f', v.n / c.violations_count * 100) || '% of offending vehicles are ' ||
  v.vehicle_type || 's, significantly restricting transit capacity.' AS sentence
FROM clusters c JOIN vehicles v USING (cluster_label) JOIN listed w USING (cluster_label)
WHERE v.place = 1 AND w.place = 1""",
        """vehicles AS (
  SELECT cluster_label, vehicle_type, count(*) AS n,
    row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, vehicle_type) AS place
  FROM labelled GROUP BY cluster_label, vehicle_type)""",
        """listed AS (
  SELECT cluster_label, violation, count(*) AS n,
    row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, violation) AS place
  FROM (SELECT cluster_label, unnest(violations) AS violation FROM labelled) GROUP BY cluster_label, violation)""")
    weights = " UNION ALL ".join(
        f"SELECT cluster_label, '{title}' AS component, CAST(sum({w}) AS BIGINT) / (10 * count(*)) AS contribution "
        "FROM labelled WHERE cluster_label <> -1 GROUP BY cluster_label"
        for w, title in (("s", "Vehicle Footprint"), ("t", "Violation Type"), ("r", "Road Class")))
    encoded = " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM scored)"
        for c in ("vehicle_type", "police_station", "primary_violation"))
    facets = " UNION ALL ".join(
        f"SELECT '{c}' AS facet, 'ALL' AS value UNION ALL SELECT DISTINCT '{c}', {c} FROM scored"
        for c in ("police_station", "vehicle_type"))
    return {
        "clean_nulls": _scored(
            "SELECT id, vehicle_type, location, junction_name, police_station, validation_status FROM scored"),
        "time_features": _scored("SELECT id, hour, day_of_week, month FROM scored"),
        "vehicle_weight": _scored("SELECT id, vehicle_type, w_size FROM scored"),
        "violation_list": _scored(
            "SELECT id, unnest(range(len(violations))) AS place, unnest(violations) AS violation FROM scored"),
        "primary_violation": _scored("SELECT id, primary_violation FROM scored"),
        "severity_weight": _scored("SELECT id, w_type FROM scored"),
        "road_weight": _scored("SELECT id, w_road FROM scored"),
        "cis_cost": _scored(
            "SELECT id, cis, cis * 0.25e0 AS delay_hours, cis * 0.25e0 * 150e0 AS economic_loss_inr, "
            "cis * 0.25e0 * 1.2e0 * 0.5e0 AS fuel_wasted_liters, cis * 0.25e0 * 1.2e0 * 0.5e0 * 2.3e0 AS co2_wasted_kg FROM scored"),
        "junction_summary": _user_junctions(
            "SELECT junction_name, jurisdiction, violations, raw_cis, milli * 375 / 1e4 AS economic_loss, "
            "milli * 345 / 1e6 AS co2_wasted, (milli * 375) // 1500000 AS economic_cost, "
            "(milli * 345) // 150000000 AS co2_impact, lat, lng FROM summary"),
        "top_junctions": _city_junctions("SELECT * FROM top", _top(10)),
        "top_details": _city_junctions(
            """SELECT t.junction_name, t.violations, t.cis, m.vehicle_mix_detail AS vehicle_mix, p.peak_hour_text AS peak_hour_violations,
  s.lat AS latitude, s.lng AS longitude, t.recommendation
FROM top t JOIN summary s USING (junction_name) JOIN mix_text m USING (junction_name) JOIN peak p USING (junction_name)""", _top(10)),
        "vehicle_mix": _city_junctions("SELECT junction_name, vehicle_type, n, percentage FROM mix"),
        "vehicle_mix_top": _user_junctions("SELECT * FROM mix_text"),
        "peak_hour": _user_junctions("SELECT * FROM peak"),
        "hourly_trend": _user_junctions(TREND_ROWS),
        "trend_multiplier": _user_junctions(MULTIPLIER_ROWS),
        "hotspot_rank": _user_junctions("SELECT id, name, violations FROM hotspots"),
        "hotspot_metrics": _user_junctions(
            f"""SELECT id, name, jurisdiction, violations, raw_cis, cis, status, action, expected_improvement,
  affected_vehicles, avg_delay, capacity_loss, economic_cost, co2_impact, lat, lng,
  {bands('capacity_loss', ((40.0, 'critical'), (30.0, 'high'), (20.0, 'moderate')), 'healthy')} AS capacity_band,
  capacity_loss / 3e0 + 12e0 AS capacity_size,
  {bands('cis', ((9.0, 'critical'), (7.0, 'active')), 'low')} AS urgency,
  {bands('cis', REASONS, 'Routine patrol. Minor parking friction with low baseline delay impact.')} AS reason,
  CAST(floor(expected_improvement * 0.25e0 + 0.5e0) AS BIGINT) AS recovery,
  CAST(floor(capacity_loss * {LEFT} + 0.5e0) AS BIGINT) AS capacity_left,
  CAST(floor(economic_cost * {LEFT} + 0.5e0) AS BIGINT) AS cost_left FROM hotspots"""),
        "junction_records": _city_junctions(
            f"""SELECT id, name, jurisdiction, violations, raw_cis, cis, status, action AS recommendation, vehicle_mix, mix_data,
  peak_hour, peak_hour_val, peak_hour_violations, lat, lng, {TREND_TEXT} AS trend
FROM hotspots h JOIN peak p ON p.junction_name = h.name JOIN trend t ON t.junction_name = h.name"""),
        "incremental_summary": _user_junctions(
            "SELECT junction_name, jurisdiction, violations, raw_cis, milli * 375 / 1e4 AS economic_loss, "
            "milli * 345 / 1e6 AS co2_wasted, (milli * 375) // 1500000 AS economic_cost, "
            "(milli * 345) // 150000000 AS co2_impact, lat, lng FROM summary"),
        "incremental_records": _city_junctions(
            f"""SELECT name, jurisdiction, violations, raw_cis, cis, vehicle_mix, mix_data,
  peak_hour, peak_hour_val, peak_hour_violations, lat, lng, {TREND_TEXT} AS trend
FROM hotspots h JOIN peak p ON p.junction_name = h.name JOIN trend t ON t.junction_name = h.name"""),
        "bucketed_records": _city_junctions(
            f"""SELECT name, jurisdiction, violations, raw_cis, cis, vehicle_mix, mix_data,
  peak_hour, peak_hour_val, peak_hour_violations, lat, lng, {TREND_TEXT} AS trend
FROM hotspots h JOIN peak p ON p.junction_name = h.name JOIN trend t ON t.junction_name = h.name"""),
        "hotspot_feed": _feed(),
        "filter_rows": _scored(
            f"SELECT id, police_station, vehicle_type, cis FROM scored WHERE police_station = {_text(STATION)} "
            f"AND vehicle_type = {_text(VEHICLE)} AND cis >= {MIN_CIS}"),
        "filter_category": _user_junctions(
            "SELECT id, name, vehicle_mix, cis FROM hotspots WHERE cis >= 5 "
            "AND regexp_matches(lower(vehicle_mix), 'tanker|bus|lgv|hcv')"),
        "search_hotspots": _user_junctions(
            "SELECT id, name, jurisdiction FROM hotspots WHERE lower(name) LIKE '%circle 1%' OR lower(jurisdiction) LIKE '%circle 1%'"),
        "search_index": _user_junctions(
            """SELECT q.query, h.id, h.name FROM hotspots h JOIN asked q
  ON trim(q.query) = '' OR contains(lower(h.name), lower(q.query)) OR contains(lower(h.jurisdiction), lower(q.query))""",
            "asked(query) AS (VALUES " + ", ".join(f"({_text(t)})" for t in SEARCHES) + ")"),
        "filtered_kpis": _clustered(
            f"""SELECT count(*) AS violations, {MILLI} * 25 / 1e5 * {LEFT} AS delay_hours, {loss} AS economic_loss,
  {loss} / 1e5 AS loss_lakh, {carbon} AS co2_kg, {carbon} / 1e3 AS co2_tonnes,
  count(DISTINCT cluster_label) FILTER (cluster_label <> -1) AS active_hotspots FROM filtered""", FILTERED),
        "kpi_cube": _clustered(
            f"""SELECT station, vehicle, min_cis, n AS violations, total * 25 / 1e5 * {LEFT} AS delay_hours, {cube_loss} AS economic_loss,
  {cube_loss} / 1e5 AS loss_lakh, {cube_carbon} AS co2_kg, {cube_carbon} / 1e3 AS co2_tonnes, active_hotspots
FROM (SELECT c.station, c.vehicle, m.min_cis, count(l.id) AS n, CAST(coalesce(sum(l.milli), 0) AS BIGINT) AS total,
        count(DISTINCT l.cluster_label) FILTER (l.cluster_label <> -1) AS active_hotspots
      FROM cells c CROSS JOIN least m LEFT JOIN labelled l ON l.cis >= m.min_cis
        AND (c.station = 'ALL' OR c.station = l.police_station) AND (c.vehicle = 'ALL' OR c.vehicle = l.vehicle_type)
      GROUP BY c.station, c.vehicle, m.min_cis)""",
            """cells AS (SELECT coalesce(police_station, 'ALL') AS station, coalesce(vehicle_type, 'ALL') AS vehicle FROM labelled GROUP BY CUBE (police_station, vehicle_type))""",
            "least(min_cis) AS (VALUES " + ", ".join(f"({m!r}::DOUBLE)" for m in MIN_SCORES) + ")"),
        "filtered_clusters": _clustered(
            f"""SELECT cluster_label, lat, lng, violations_count, avg_cis, economic_loss * {LEFT} AS economic_loss_compliant,
  police_station, {TIERS} AS priority_tier FROM narrowed""", FILTERED, NARROWED),
        "filtered_patrols": _visits((100 - COMPLIANCE) / 100.0, "narrowed", FILTERED, NARROWED),
        "kpis": _clustered(
            f"""SELECT count(*) AS violations, {MILLI} * 25 / 1e5 * {LEFT} AS delay_hours, {loss} AS economic_loss,
  {loss} / 1e5 AS loss_lakh, {carbon} AS co2_kg, {carbon} / 1e3 AS co2_tonnes,
  count(DISTINCT cluster_label) FILTER (cluster_label <> -1) AS active_hotspots FROM labelled"""),
        "vehicle_top6": _scored(
            "SELECT vehicle_type, count(*) AS count FROM scored GROUP BY vehicle_type ORDER BY count(*) DESC, vehicle_type LIMIT 6"),
        "hour_histogram": _scored("SELECT hour, count(*) AS violations FROM scored GROUP BY hour"),
        "summary_metrics": _user_junctions(
            f"""SELECT count(*) AS active_count, count(*) FILTER (status = 'critical') AS critical_count,
  {js1('sum(CAST(round(cis * 10) AS BIGINT))::BIGINT / 10e0 / count(*)')} AS avg_cis,
  CAST(floor(sum(CAST(round(avg_delay * 10) AS BIGINT) * affected_vehicles)::BIGINT / 10e0 * {LEFT} + 0.5e0) AS BIGINT) AS total_delay,
  CAST(floor(sum(CAST(round(capacity_loss * 10) AS BIGINT))::BIGINT / 10e0 / count(*) * {LEFT} + 0.5e0) AS BIGINT) AS avg_capacity_loss,
  CAST(floor(sum(economic_cost)::BIGINT * {LEFT} + 0.5e0) AS BIGINT) AS total_cost FROM hotspots WHERE cis >= 3"""),
        "focus_top5": _user_junctions("SELECT id, name, cis, expected_improvement FROM top5", TOP5),
        "focus_improvement": _user_junctions(
            f"SELECT {js1('sum(CAST(round(expected_improvement * 10) AS BIGINT))::BIGINT / 10e0 / count(*)')} AS improvement FROM top5", TOP5),
        "focus_bounds": _user_junctions(
            "SELECT min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM top5", TOP5),
        "priority_index": _user_junctions(
            "SELECT row_number() OVER (ORDER BY cis DESC, id) AS index_number, id, name, cis FROM hotspots"),
        "facets": _scored(facets),
        "map_centre": _scored(f"SELECT {_mean('latitude')} AS lat, {_mean('longitude')} AS lng FROM scored"),
        "corridor_links": _user_junctions("SELECT * FROM linked", ROADS, LINKS),
        "corridor_hotspots": _user_junctions(
            """SELECT l.id, row_number() OVER (PARTITION BY l.id ORDER BY l.hotspot_id) - 1 AS place, l.name,
  h.status
FROM linked l JOIN hotspots h ON h.name = l.name""", ROADS, LINKS),
        "corridor_status": _user_junctions(
            f"""SELECT l.id, CAST(row_number() OVER (PARTITION BY l.id ORDER BY l.hotspot_id) - 1 AS INTEGER) AS place, l.name,
  CASE WHEN h.cis >= {SHOWN_CIS!r} THEN h.status ELSE 'Inactive' END AS status
FROM linked l JOIN hotspots h ON h.name = l.name""", ROADS, LINKS),
        "corridor_stats": _sql(
            """SELECT id, name, CASE WHEN speed < 12 THEN 'Critical' WHEN speed < 20 THEN 'Severe' WHEN speed < 30 THEN 'Heavy'
    WHEN speed <= 40 THEN 'Moderate' ELSE 'Free Flow' END AS speed_band,
  CASE congestion WHEN 'dark-red' THEN 'Critical' WHEN 'red' THEN 'Severe' WHEN 'orange' THEN 'Heavy'
    WHEN 'yellow' THEN 'Moderate' ELSE 'Free Flow' END AS level,
  parking_suspected AND congestion IN ('red', 'dark-red', 'orange') AS bottleneck,
  congestion IN ('red', 'dark-red') AS delay_zone,
  path[len(path) // 2 + 1].lat AS mid_lat, path[len(path) // 2 + 1].lng AS mid_lng FROM roads""", ROADS),
        "corridor_speeds": _sql(
            "SELECT id, 'Current Speed' AS name, speed FROM roads UNION ALL "
            "SELECT id, 'Free Flow Speed', free_flow_speed FROM roads", ROADS),
        "network_stats": _sql(
            f"""SELECT {js1('sum(speed)::BIGINT / count(*)')} AS avg_speed,
  (SELECT name FROM roads ORDER BY speed, id LIMIT 1) AS slowest,
  (SELECT name || ' (+' || regexp_replace(CAST(estimated_delay AS VARCHAR), '[.]0$', '') || 'm)'
   FROM roads ORDER BY estimated_delay DESC, id LIMIT 1) AS longest_delay FROM roads""", ROADS),
        "dbscan_core": _clustered(
            """SELECT s.latitude, s.longitude, s.weight, c.site IS NOT NULL AS is_core
FROM sites s LEFT JOIN core c ON c.site = s.first_id"""),
        "dbscan_labels": _clustered("SELECT id, cluster_label FROM labelled"),
        "hotspot_count": _clustered(
            "SELECT count(DISTINCT cluster_label) FILTER (cluster_label <> -1) AS hotspots FROM labelled"),
        "cluster_summary": _clustered("SELECT * FROM clusters"),
        "priority_tier": _clustered(
            f"""SELECT cluster_label, {TIERS} AS priority_tier,
  CASE WHEN avg_cis < 2 THEN 'low' WHEN avg_cis < 4 THEN 'mid' ELSE 'high' END AS severity,
  CAST(least(30, greatest(6, trunc(violations_count / 50))) AS INTEGER) AS size, violations_count,
  economic_loss * {LEFT} AS economic_loss_compliant FROM clusters"""),
        "topsis": _topsis(),
        "hotspot_audit": audit,
        "cluster_drilldown": _clustered("SELECT id, cis FROM labelled WHERE cluster_label = 0"),
        "violation_counts": _clustered(
            """SELECT cluster_label, violation, count(*) AS n
FROM (SELECT cluster_label, unnest(violations) AS violation FROM labelled WHERE cluster_label <> -1)
GROUP BY cluster_label, violation"""),
        "weight_contributions": _clustered(weights),
        "patrol_assignment": _visits((100 - COMPLIANCE) / 100.0),
        "patrol_assignment_full": _visits(0.0),
        "dispatch_top3": _user_junctions(
            f"""SELECT {_case('position - 1', C.DISPATCH_NAMES)} AS unit, name AS target,
  CASE WHEN position = 3 THEN 'Tow Vehicle' ELSE action END AS action, {_case('position - 1', C.DISPATCH_CODES)} AS code
FROM top3""", TOP3),
        "patrol_lines": _user_junctions(
            """SELECT u.unit, u.a AS from_lat, u.o AS from_lng, t.name AS target, t.lat AS to_lat, t.lng AS to_lng
FROM top3 t JOIN units u ON u.position = t.position""", TOP3,
            "units(position, unit, a, o) AS (VALUES " + ", ".join(
                f"({i + 1}, {_text(u)}, {a!r}::DOUBLE, {o!r}::DOUBLE)" for i, (u, a, o, _, _) in enumerate(C.PATROL_UNITS[:3])) + ")"),
        "csv_tickets": _scored("""SELECT 'T' || s.id AS id, strftime(CASE s.id % 6 WHEN 1 THEN date_trunc('second', s.created_datetime) - INTERVAL 330 MINUTE
  WHEN 2 THEN date_trunc('minute', s.created_datetime) WHEN 5 THEN NULL ELSE date_trunc('second', s.created_datetime) END, '%Y-%m-%d %H:%M:%S') AS created,
  CASE WHEN s.id % 7 = 0 THEN r.location || chr(10) || '"corner", ' || s.id ELSE r.location END AS location, r.junction_name FROM scored s JOIN scored_raw r USING (id)"""),
        "snapshot_round_trip": _scored("""SELECT id, latitude, longitude, location, vehicle_type, police_station, junction_name, validation_status, hour, day_of_week, month,
  cis, cis * 0.25e0 AS delay_hours, cis * 0.25e0 * 150e0 AS economic_loss_inr, 0.85e0 AS approval_probability, -1 AS cluster_label, w_size, w_type, w_road FROM scored"""),
        "top_list_round_trip": _city_junctions("SELECT * FROM top", _top(10)),
        "hotspots_round_trip": _city_junctions(
            f"""SELECT id, name, jurisdiction, violations, raw_cis, cis, status, action AS recommendation, vehicle_mix, mix_data,
  peak_hour, peak_hour_val, peak_hour_violations, lat, lng, {TREND_TEXT} AS trend
FROM hotspots h JOIN peak p ON p.junction_name = h.name JOIN trend t ON t.junction_name = h.name"""),
        "model_round_trip": _scored("SELECT id, true AS agrees FROM scored"),
        "encoders": _scored(encoded),
        "approval_split": _scored(f"""SELECT is_train, count(*) AS n, CAST(count(*) FILTER (validation_status = 'approved') AS DOUBLE) AS approved
  FROM (SELECT *, {SPLIT} AS is_train FROM scored WHERE validation_status IN ('approved', 'rejected')) GROUP BY is_train"""),
        "approval_scores": _scored("SELECT id, true AS is_probability FROM scored"),
        "approval_logloss": _scored(f"SELECT count(*) AS n, true AS is_bounded FROM scored WHERE validation_status IN ('approved', 'rejected') AND NOT {SPLIT}"),
        "approval_share": _scored("""SELECT count(*) AS n, CAST(count(*) FILTER (validation_status = 'approved') AS DOUBLE) AS approved, true AS meets_share
  FROM scored WHERE validation_status IN ('approved', 'rejected')"""),
        "approval_repeats": _scored(f"""SELECT {INPUTS}, count(*) AS n, true AS same_score FROM scored GROUP BY {INPUTS}"""),
        "approval_compiled": _scored("SELECT id, true AS agrees FROM scored"),
        "tree_margins": _sql("SELECT id, CAST(sum(value) AS DOUBLE) AS margin FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY id", TICKETS,
            "nodes(tree, node, feature, threshold, l, r, value) AS (VALUES " + ", ".join(
                "(" + ", ".join("NULL" if v is None else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in STATED_TREES) + ")",
            """walk(id, x, tree, node) AS (
  SELECT DISTINCT id, [CAST(hour AS DOUBLE), w_type, w_road], tree, 0 FROM scored CROSS JOIN nodes
  UNION ALL
  SELECT w.id, w.x, w.tree, CASE WHEN w.x[n.feature + 1] <= n.threshold THEN n.l ELSE n.r END
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature IS NOT NULL)"""),
        "approval_rank": _sql("""SELECT CAST(sum(approved) AS BIGINT) AS approved, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(wins) AS BIGINT) AS twice_wins,
  CAST(sum(wins) AS DOUBLE) / (2e0 * CAST(sum(approved) AS DOUBLE) * CAST(sum(rejected) AS DOUBLE)) AS auc
FROM (SELECT approved, rejected, approved * (2 * coalesce(sum(rejected) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + rejected) AS wins FROM judged)""",
            TICKETS, JUDGED),
        "approval_calibration": _sql("""SELECT bin, CAST(sum(approved + rejected) AS BIGINT) AS n, CAST(sum(approved) AS BIGINT) AS approved,
  CAST(sum(CAST(round(score * 1e6) AS BIGINT) * (approved + rejected)) AS BIGINT) / (sum(approved + rejected) * 1e6::DOUBLE) AS mean_score,
  CAST(sum(approved) AS BIGINT) / CAST(sum(approved + rejected) AS BIGINT) AS share
FROM (SELECT *, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin FROM judged) GROUP BY bin""", TICKETS, JUDGED),
        "approval_default": _scored("SELECT id, 0.85e0 AS approval_probability FROM scored WHERE validation_status IS NULL"),
        "dbscan_odd_coordinates": _sql("SELECT id, cluster_label FROM labelled", ODD, CLUSTERS),
        "cluster_summary_odd": _clustered(
            f"SELECT cluster_label, {_mean('latitude')} AS lat, {_mean('longitude')} AS lng, count(*) AS violations_count FROM odd GROUP BY cluster_label",
            f"""odd AS (SELECT cluster_label, CASE WHEN isfinite(la) THEN la END AS latitude, CASE WHEN isfinite(lo) THEN lo END AS longitude
  FROM (SELECT cluster_label, CASE WHEN id % 20 IN (0, 1, 2) THEN NULL ELSE latitude END AS la, CASE WHEN id % 20 IN (3, 4) THEN NULL ELSE longitude END AS lo
        FROM labelled WHERE cluster_label <> -1))"""),
        "dbscan_streets": _sql("SELECT id, cluster_label FROM labelled", STREETS, CLUSTERS),
        "dbscan_incremental": _sql("SELECT id, cluster_label FROM labelled", STREETS, CLUSTERS),
        "cluster_summary_streets": _sql("SELECT * FROM clusters", STREETS, CLUSTERS),
        "dbscan_labels_scored": _sql("SELECT id, cluster_label FROM labelled", TICKETS, LIKELY_CLUSTERS),
        "hotspot_audit_scored": audit.replace(CLUSTERS, LIKELY_CLUSTERS).replace(
            "850000 * c.violations_count / (c.violations_count * 10000)", "c.approval / (c.violations_count * 10000)").replace(
            f"{MILLI} * 375 / 1e4 AS economic_loss, arg_min", f"CAST(sum(CAST(round({PROBABILITY} * 1e6) AS BIGINT)) AS BIGINT) AS approval, {MILLI} * 375 / 1e4 AS economic_loss, arg_min"),
        **_raw_queries(),
    }
