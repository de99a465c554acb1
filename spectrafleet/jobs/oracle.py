"""DuckDB SQL for the queries of jobs.queries that SQL can express."""

from __future__ import annotations

from ..sources.fixtures import CELLS_SQL as CELLS
from ..sources.fixtures import CONFIG_SQL as CONFIGS
from ..sources.fixtures import EV_SQL as EV
from ..sources.fixtures import FEATURES
from ..sources.fixtures import PSD_SQL as PSD

CURVES = """curves as (select sensor_id, list_transform(range(0, n_bins), lambda i: 1.0::double + 0.05::double * k + 0.001::double * i) as gain,
  list_transform(range(0, n_bins), lambda i: 1e-7::double * k * (1.0::double + 0.01::double * i)) as floor, list_transform(range(0, n_bins), lambda i: 1e-12::double * (k + i)) as var
  from (select distinct sensor_id, n_bins, substring(sensor_id, 5)::double as k from psd))"""
CAL = """cal as (select psd.*, list_transform(pxx_db, lambda x: power(10.0::double, x / 10)) as pw,
  list_transform(range(1, n_bins + 1), lambda i: greatest(power(10.0::double, pxx_db[i] / 10) - floor[i], 0.0::double) / gain[i]) as cp from psd join curves using (sensor_id))"""
CORR = """z as (select *, list_transform(pxx_db, lambda x: (x - list_avg(pxx_db)) / greatest(list_stddev_pop(pxx_db), 1e-8)) as z from psd),
  rho as (select a.campaign, a.record_idx, a.sensor_id as sensor_a, b.sensor_id as sensor_b, greatest(-1.0::double, least(1.0::double, list_dot_product(a.z, b.z) / a.n_bins)) as value
  from z a join z b on a.campaign = b.campaign and a.record_idx = b.record_idx and a.sensor_id < b.sensor_id),
  two as (select campaign, record_idx, sensor_a as sensor_id, value from rho union all select campaign, record_idx, sensor_b, value from rho),
  scores as (select campaign, record_idx, sensor_id, sum(value) as score, count(*) + 1 as sensors from two group by all)"""
NOISE = """edges as (select *, list_min(pxx_db) as lo, (list_max(pxx_db) - list_min(pxx_db)) / 50 as step from psd),
  binned as (select src_row, lo, step, least(len(list_filter(range(0, 51), lambda i: lo + step * i <= v or (i = 50 and v >= lo + step * 50))) - 1, 49) as b from (select src_row, lo, step, unnest(pxx_db) as v from edges)),
  counted as (select src_row, lo, step, b, count(*) as n from binned group by all),
  nf as (select src_row, lo + step * b as noise_floor_db from (select *, row_number() over (partition by src_row order by n desc, b) as k from counted) where k = 1)"""
RANKING = """ranking as (select *, row_number() over (partition by campaign order by mean_score desc, sensor_id desc) as rank from (
  select campaign, sensor_id, avg(score) as mean_score, avg(score / (sensors - 1)) as mean_correlation, stddev_pop(score) as score_std, count(*) as n_records from scores group by all))"""


def _hist(values: str) -> str:
    return f"""span as (select campaign, min(value) as lo, (max(value) - min(value)) / 50 as w from {values} group by campaign),
  g as (select campaign, sensor_id, value, lo, w, least(floor((value - lo) / w), 49) as g from {values} join span using (campaign)),
  hist as (select campaign, sensor_id, (g - (value < lo + g * w)::int + (value >= lo + (g + 1) * w and g < 49)::int)::int as bin, w, count(*) as n from g group by all),
  dens as (select campaign, sensor_id, bin, n, n / (sum(n) over (partition by campaign, sensor_id) * w) as density from hist)"""


DIST = f"""vals as (select campaign, sensor_id, unnest(pxx_db) as value from psd), {_hist("vals")},
  st as (select campaign, sensor_id, sum(density) / 50 as m, greatest(sqrt(greatest(sum(density * density) / 50 - (sum(density) / 50) * (sum(density) / 50), 0)), 1e-8) as s from dens group by all),
  xy as (select a.campaign, a.sensor_id as a, b.sensor_id as b, sum(a.density * b.density) / 50 as xy from dens a join dens b on a.campaign = b.campaign and a.bin = b.bin and a.sensor_id <> b.sensor_id group by all),
  r as (select x.campaign, x.sensor_id as a, greatest(least((coalesce(xy, 0) - x.m * y.m) / (x.s * y.s), 1), -1) as rho from st x join st y on x.campaign = y.campaign and x.sensor_id <> y.sensor_id
        left join xy on xy.campaign = x.campaign and xy.a = x.sensor_id and xy.b = y.sensor_id),
  sc as (select campaign, a as sensor_id, sum(rho) as score, avg(rho) as normalised_score from r group by all),
  dist as (select *, score < avg(score) over (partition by campaign) - stddev_pop(score) over (partition by campaign) as is_outlier, row_number() over (partition by campaign order by score desc, sensor_id desc) as rank from sc)"""
RMSE = """rm as (select a.campaign, a.record_idx, avg(sqrt(list_sum(list_transform(range(1, a.n_bins + 1), lambda i: power(a.{x}[i] - b.{x}[i], 2))) / a.n_bins)) as {n}
  from {t} a join {t} b on a.campaign = b.campaign and a.record_idx = b.record_idx and a.sensor_id < b.sensor_id group by all)"""
DB = "db as (select *, list_transform(pw, lambda p: 10 * log10(greatest(p, 1e-12))) as raw_db, list_transform(cp, lambda p: 10 * log10(greatest(p, 1e-12))) as cal_db from cal)"
DISP = """lg as (select campaign, record_idx, unnest(list_transform(cp, lambda p: ln(p + 1e-12))) as v, generate_subscripts(cp, 1) as bin from cal),
  disp as (select campaign, sum(ss) / sum(n) as dispersion from (select campaign, record_idx, bin, var_pop(v) * count(*) as ss, count(*) as n from lg group by all) group by campaign)"""
LOGC = """lz as (select campaign, record_idx, sensor_id, list_transform(l, lambda x: x - list_avg(l)) as c from (select *, list_transform(cp, lambda p: ln(p + 1e-12)) as l from cal)),
  logc as (select a.campaign, avg(greatest(-1.0::double, least(1.0::double, list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c)))))) as log_correlation
  from lz a join lz b on a.campaign = b.campaign and a.record_idx = b.record_idx and a.sensor_id < b.sensor_id group by 1)"""
DIAG = f"""{RMSE.format(x="raw_db", n="raw", t="db").replace("rm as", "rmr as")}, {RMSE.format(x="cal_db", n="cal", t="db").replace("rm as", "rmc as")}, {DISP}, {LOGC},
  diag as (select campaign, count(*) as n_records, avg(raw) as mean_raw_rmse_db, quantile_cont(raw, 0.5) as median_raw_rmse_db, max(raw) as max_raw_rmse_db, avg(cal) as mean_cal_rmse_db,
  quantile_cont(cal, 0.5) as median_cal_rmse_db, max(cal) as max_cal_rmse_db, avg(raw) - avg(cal) as improvement_db, any_value(dispersion) as dispersion, any_value(log_correlation) as log_correlation,
  case when substring(campaign, 2)::int % 2 = 0 then 'train' else 'test' end as role, campaign = 'c1' as is_ood from rmr join rmc using (campaign, record_idx) join disp using (campaign) join logc using (campaign) group by campaign)"""


def _inverse(rows: list[str], table: str) -> str:
    """inv: the inverse of a matrix of expressions over a table, as one list of rows; by elimination, column by column."""
    n = len(rows)
    unit = lambda i: ", ".join("1.0::double" if i == j else "0.0::double" for j in range(n))
    out = "e0 as (" + " union all ".join(f"select {i + 1} as i, [{row}, {unit(i)}] as m from {table}" for i, row in enumerate(rows)) + ")"
    for p in range(1, n + 1):
        out += f""", e{p} as (select i, case when i = {p} then list_transform(m, lambda v: v / lead[{p}]) else list_transform(range(1, {2 * n + 1}), lambda j: m[j] - m[{p}] * lead[j] / lead[{p}]) end as m
  from e{p - 1}, (select m as lead from e{p - 1} where i = {p}))"""
    return out + f", inv as (select list(m[{n + 1}:{2 * n}] order by i) as inv from e{n})"


def _cell(a: str, b: str) -> str:
    sd = lambda f: f"(case when stddev_pop({f}) <= 1e-12 then 1 else stddev_pop({f}) end)"
    return f"covar_samp({a}, {b}) / ({sd(a)} * {sd(b)})" + (" + 1e-6 * greatest(count(*) / (count(*) - 1), 1)" if a == b else "")


#: Distances of settings from those for training, and upper tails of chi-square of 7 degrees of freedom.
TRUST = f"""{CONFIGS}, train as (select * from configs where role = 'train'), {_inverse([", ".join(_cell(a, b) for b in FEATURES) for a in FEATURES], "train")},
  st as (select {", ".join(f"avg({f}) as m_{f}, case when stddev_pop({f}) <= 1e-12 then 1 else stddev_pop({f}) end as s_{f}, min({f}) as lo_{f}, max({f}) as hi_{f}" for f in FEATURES)} from train),
  zs as (select config_id, role, central_freq_hz - span_hz as a, central_freq_hz + span_hz as b, [{", ".join(f"({f} - m_{f}) / s_{f}" for f in FEATURES)}] as z, {" or ".join(f"{f} < lo_{f} or {f} > hi_{f}" for f in FEATURES)} as outside_envelope from configs, st),
  sq as (select *, greatest(list_sum(list_transform(range(1, 8), lambda i: z[i] * list_dot_product(z, inv[i]))), 0) as d2 from zs, inv),
  ds as (select *, sqrt(d2) as distance, greatest(max(sqrt(d2)) filter (role = 'train') over (), sqrt(18.475306906582357)) as threshold,
  least(greatest(ceil((80e6 - a) / ((b - a) / 63)), 0), 64)::bigint as bins_below, least(greatest(ceil((b - 100e6) / ((b - a) / 63)), 0), 64)::bigint as bins_above,
  case when d2 > 80 then 0 else 1 - 2 / sqrt(pi()) * exp(-d2 / 2) * sqrt(d2 / 2) * list_sum(list_transform(range(0, 300), lambda n: exp(n * ln(2 * greatest(d2, 1e-300)) + lgamma(n + 1) - lgamma(2 * n + 2)))) end as erfc from sq)"""
#: The curves of queries.level_model(), values under them, and latent spectra.
LEVEL = f"""{CONFIGS}, ks as (select sensor_id, k, avg(k) over () as mk from (select distinct sensor_id, substring(sensor_id, 5)::double as k from psd)),
  hs as (select campaign, exp(2 * a) as e from (select campaign, 0.3::double * (vga_gain_db - 5) / 3 + 0.1::double as a from (select distinct campaign from psd) join configs on config_id = substring(campaign, 2)::bigint)),
  flat as (select campaign, record_idx, sensor_id, n_bins, unnest(pxx_db) as p, generate_subscripts(pxx_db, 1) - 1 as bin from psd),
  par as (select campaign, record_idx, sensor_id, bin, power(10.0::double, p / 10) / 1e-6 as y, bin / (n_bins - 1)::double as x, k, mk, (e - 1) / (e + 1) as h from flat join ks using (sensor_id) join hs using (campaign)),
  arg as (select *, 0.02::double * k + 0.5::double * h + 0.3::double * x - 3 as pn, 0.1::double * k + 0.5::double * h + 0.2::double * x - 2 as pv from par),
  obs as (select campaign, record_idx, sensor_id, bin, y, pn, pv, exp(0.05::double * (1 + x) * (k - mk)) as gain, ln(1 + exp(pn)) as floor, 1e-3::double + ln(1 + exp(pv)) as var from arg),
  lat as (select campaign, record_idx, bin, greatest(sum(gain / var * (y - floor)) / sum(gain / var * gain), 1e-12) as s from obs group by all),
  level as (select campaign, sensor_id, bin, any_value(gain) as gain, any_value(floor) as floor, any_value(var) as var from obs group by all)"""
LOGS = """lx as (select *, ln(greatest(y - floor, 0) / gain + 1e-6) as z from obs), nr as (select campaign, count(distinct record_idx) as records from obs group by campaign)"""


def _splines(knots: list[float], degree: int) -> str:
    """splines: the weights b of x of points (x, others), degree by degree."""
    t, n = "[" + ", ".join(f"{k}::double" for k in knots) + "]", len(knots) - 1
    zero = f"select *, list_transform(range(1, {n + 1}), lambda j: case when x < 1 and t[j] <= x and x < t[j + 1] or x >= 1 and j = {n - degree} then 1.0::double else 0.0::double end) as b from (select *, {t} as t from points)"
    out = f"d0 as ({zero})"
    for d in range(1, degree + 1):
        up = f"case when t[j + {d}] > t[j] then (x - t[j]) / (t[j + {d}] - t[j]) * b[j] else 0 end"
        down = f"case when t[j + {d + 1}] > t[j + 1] then (t[j + {d + 1}] - x) / (t[j + {d + 1}] - t[j + 1]) * b[j + 1] else 0 end"
        out += f", d{d} as (select * exclude (b), list_transform(range(1, {n - d + 1}), lambda j: {up} + {down}) as b from d{d - 1})"
    return out + f", splines as (select * from d{degree})"


def _covariance(a: str, b: str) -> str:
    return f"select '{a}' as feature_a, '{b}' as feature_b, round({_cell(a, b)}, 5) + 0.0::double as covariance from train"


def r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in cols.split())


def _anchor(t: str) -> str:
    return f"anchor as (select campaign, first(sensor_id order by n, sensor_id) as anchor from (select campaign, sensor_id, count(*) as n from {t} group by all) group by campaign)"


def _labels(t: str) -> str:
    return f"(select campaign as label, min(src_row) as pos from {t} group by campaign)"


TRAIN_STATS = ", ".join(f"avg({f}) as m_{f}, case when stddev_pop({f}) <= 1e-12 then 1 else stddev_pop({f}) end as s_{f}, min({f}) as lo_{f}, max({f}) as hi_{f}" for f in FEATURES)

LANDED = """landed as (select event_id::varchar as id, case when event_id % 4 = 0 then ' ' else 'm' || user_id end as mac, case when event_id % 3 = 0 then user_id::varchar end as campaign_id, user_id,
  case when event_id % 9 = 0 then null when event_id % 10 = 0 then '' else format('[{{}}, {{}},{{}}]', event_id % 7, event_id % 5, user_id % 3) end as pxx, (epoch_us(ts) // 1000)::varchar as ts, 'c' || (user_id % 10) as campaign, event_type as label from events)""".replace("{{}}", "{}")

#: The greedy rule by recursion over anchor rows: each step takes every sensor's nearest free row, if all have one.
GREEDY = """n as (select campaign, sensor_id, ts_ms, src_row, row_number() over (partition by campaign, sensor_id order by ts_ms, src_row) as rn from ev),
sz as (select campaign, sensor_id, count(*) as held from n group by all),
an as (select campaign, arg_min(sensor_id, (held, sensor_id)) as anchor, count(*) as sensors from sz group by campaign),
m as (
  select campaign, sensor_id, 0::bigint as i, 0::bigint as last, false as whole, null::bigint as src_row, null::bigint as ts_ms from sz
  union all
  select campaign, sensor_id, i, case when whole then rn else last end, whole, src_row, ts_ms
  from (select *, count(rn) over (partition by campaign) = sensors as whole
        from (select r.campaign, r.sensor_id, r.i + 1 as i, r.last, an.sensors, n.rn, n.src_row, n.ts_ms,
                     row_number() over (partition by r.campaign, r.sensor_id order by abs(n.ts_ms - a.ts_ms), n.ts_ms, case when n.ts_ms < a.ts_ms then -n.rn else n.rn end) as k
              from m as r join an on an.campaign = r.campaign join n as a on a.campaign = r.campaign and a.sensor_id = an.anchor and a.rn = r.i + 1
              left join n on n.campaign = r.campaign and n.sensor_id = r.sensor_id and case when r.sensor_id = an.anchor then n.rn = r.i + 1 else n.rn > r.last and abs(n.ts_ms - a.ts_ms) <= 7200000 end)
        where k = 1))"""
#: The most matches of a pair by recursion over the first sensor's rows: each takes the second's earliest free row within the tolerance.
PAIRED = """n as (select campaign, sensor_id, ts_ms, row_number() over (partition by campaign, sensor_id order by ts_ms, src_row) as rn from ev),
p as (select a.campaign, a.sensor_id as sensor_a, b.sensor_id as sensor_b from (select distinct campaign, sensor_id from n) as a join (select distinct campaign, sensor_id from n) as b on a.campaign = b.campaign and a.sensor_id < b.sensor_id),
m as (
  select campaign, sensor_a, sensor_b, 0::bigint as i, 0::bigint as last, 0::bigint as matches from p
  union all
  select r.campaign, r.sensor_a, r.sensor_b, r.i + 1, coalesce(min(b.rn), r.last), r.matches + (count(b.rn) > 0)::bigint
  from m as r join n as a on a.campaign = r.campaign and a.sensor_id = r.sensor_a and a.rn = r.i + 1
  left join n as b on b.campaign = r.campaign and b.sensor_id = r.sensor_b and b.rn > r.last and abs(b.ts_ms - a.ts_ms) <= 1800000
  group by r.campaign, r.sensor_a, r.sensor_b, r.i, r.last, r.matches)"""

ORACLE_SQL: dict[str, str] = {
    "align_greedy": f"with recursive {EV}, {GREEDY} select campaign, (dense_rank() over (partition by campaign order by i) - 1)::int as record_idx, sensor_id, src_row, ts_ms, 7200000::bigint as tolerance_ms from m where whole",
    "pairwise_match_count": f"with recursive {EV}, {PAIRED} select campaign, sensor_a, sensor_b, max(matches) as matches from m group by all",
    "sensor_ranking": f"with {PSD}, {CORR}, {NOISE}, {RANKING}, f as (select campaign, sensor_id, avg(noise_floor_db) as mean_noise_floor_db from psd join nf using (src_row) group by all) select campaign, sensor_id, n_records, rank, {r('mean_score mean_correlation score_std mean_noise_floor_db')} from ranking join f using (campaign, sensor_id)",
    "db_to_linear": f"with {PSD} select campaign, record_idx, sensor_id, round(list_sum(list_transform(pxx_db, lambda x: power(10.0::double, x / 10))) * 1e6, 6) as total_uw from psd",
    "linear_to_db": f"with {PSD} select campaign, record_idx, sensor_id, round(list_avg(list_transform(pxx_db, lambda x: 10 * log10(greatest(power(10.0::double, x / 10) - 1e-6, 1e-12)))), 6) as mean_db from psd",
    "frequency_axis": f"with {PSD} select distinct campaign, sensor_id, n_bins as n, round(start_freq_hz + (end_freq_hz - start_freq_hz) / (n_bins - 1), 3) as second_hz, round(end_freq_hz, 3) as last_hz, round(n_bins * (start_freq_hz + end_freq_hz) / 2 / 1e6, 3) as sum_mhz from psd",
    "noise_floor": f"with {PSD}, {NOISE} select campaign, record_idx, sensor_id, round(noise_floor_db, 6) as noise_floor_db from psd join nf using (src_row)",
    "curve_roughness": f"with {PSD} select campaign, record_idx, sensor_id, round(sqrt(list_avg(list_transform(range(2, n_bins), lambda i: power(pxx_db[i + 1] - 2 * pxx_db[i] + pxx_db[i - 1], 2)))), 6) as roughness from psd",
    "gain_edge_jump_ratio": f"with {PSD}, j as (select *, list_transform(range(1, n_bins), lambda i: abs(pxx_db[i + 1] - pxx_db[i])) as d from psd) select campaign, record_idx, sensor_id, round(greatest(d[1], d[n_bins - 1]) / greatest(list_aggregate(d[2:n_bins - 2], 'quantile_cont', 0.5), 1e-12), 6) as ratio from j",
    "validate_measurements": f"with {PSD}, v as (select *, case when src_row % 7 = 0 then 'fewer than two values' when src_row % 11 = 0 then 'spectrum is no array' when src_row % 17 = 0 then 'frequency missing' when src_row % 13 = 0 then 'timestamp missing' else 'none' end as problem from psd) select campaign, sensor_id, problem, count(*) as n from v group by all",
    "stream_quarantine": f"with {PSD}, {CURVES}, {CAL}, v as (select cal.*, case when src_row % 7 = 0 then 'fewer than two values' when src_row % 11 = 0 then 'no curve' when campaign = 'c2' then 'configuration out of distribution' else 'none' end as problem from cal), t as (select v.campaign, case when src_row % 11 = 0 then 'Node99' else v.sensor_id end as sensor_id, problem, list_sum(cp) as cp, list_sum(list_transform(range(1, len(gain) + 1), lambda i: var[i] / greatest(gain[i] * gain[i], 1e-12))) as pv from v join curves using (sensor_id)) select campaign, sensor_id, problem, count(*) as n, round(sum(cp) filter (problem = 'none') * 1e6, 6) as total_uw, round(sum(pv) filter (problem = 'none') * 1e12, 6) as total_var from t group by all",
    "list_campaigns": f"with {EV} select distinct campaign from ev",
    "drop_leading": f"with {EV} select campaign, sensor_id, count(*) as n, min(ts_ms) as first_ms, sum(src_row)::bigint as rows_sum from (select *, row_number() over (partition by campaign, sensor_id order by ts_ms, src_row) as k from ev) where k > 3 group by all",
    "select_record_sample": f"with {PSD}, c as (select campaign, min(n) as n from (select campaign, sensor_id, count(*) as n from psd group by all) group by campaign) select campaign, sensor_id, record_idx, src_row from psd join c using (campaign) where record_idx in (0, n // 2, n - 1)",
    "exclude_sensors": f"with {EV}, x as (select distinct campaign, sensor_id from ev where src_row % 50 = 0 and campaign in ('c1', 'c2')) select campaign, sensor_id, count(*) as n from ev where not exists (select 1 from x where x.campaign = ev.campaign and x.sensor_id = ev.sensor_id) group by all",
    "resolve_global_exclusions": f"with {PSD}, ids as (select distinct case when src_row % 2 = 0 then sensor_id else 'Node2' end as sensor_id from psd) select distinct campaign, sensor_id from psd where sensor_id in (select sensor_id from ids) and sensor_id in ('Node2', 'Node4')",
    "unknown_sensor_check": f"with {PSD}, {CELLS} select distinct sensor_id from cells where sensor_id not in (select sensor_id from psd)",
    "sensor_registry": f"with {PSD} select distinct sensor_id from psd",
    "sensor_pairs": f"with {PSD} select a.campaign, a.record_idx, a.sensor_id as sensor_a, b.sensor_id as sensor_b from psd a join psd b on a.campaign = b.campaign and a.record_idx = b.record_idx and a.sensor_id < b.sensor_id",
    "reference_weights": f"with {CELLS} select sensor_id, round(count(*) / (select count(*) from cells), 6) as weight from cells group by sensor_id",
    "workflow_union": f"with {PSD}, {EV}, u as (select label, min((0, pos)) as k from {_labels('ev')} group by label union all select label, min((1, pos)) from {_labels('psd')} group by label), f as (select label, min(k) as k from u group by label) select label, row_number() over (order by k) as pos from f",
    "split_overlap": f"with {PSD}, {EV} select label, 'overlap' as problem from (select label from {_labels('ev')} intersect select label from {_labels('psd')})",
    "missing_campaigns": f"with {PSD}, {EV} select campaign from ev except select campaign from psd",
    "infer_tolerance": f"with {EV}, g as (select campaign, ts_ms // 3000 - lag(ts_ms // 3000) over (partition by campaign, sensor_id order by ts_ms // 3000) as gap from ev) select campaign, coalesce(round_even(greatest(least(quantile_cont(gap, 0.5) filter (gap > 0) * 0.25, 5000), 250), 0), 5000)::bigint as tolerance_ms from g group by campaign",
    "select_anchor": f"with {EV}, {_anchor('ev')} select campaign, anchor from anchor",
    "nearest_asof": f"with {EV}, {_anchor('ev')}, p as (select a.campaign, a.src_row as anchor_row, a.ts_ms as anchor_ts, b.sensor_id, b.src_row, b.ts_ms, row_number() over (partition by a.campaign, a.src_row, b.sensor_id order by abs(b.ts_ms - a.ts_ms), b.ts_ms, case when b.ts_ms < a.ts_ms then -b.src_row else b.src_row end) as k from ev a join anchor on a.campaign = anchor.campaign and a.sensor_id = anchor join ev b on b.campaign = a.campaign and b.sensor_id <> a.sensor_id and b.ts_ms between a.ts_ms - 1800000 and a.ts_ms + 1800000) select campaign, anchor_row, anchor_ts, sensor_id, src_row, ts_ms from p where k = 1",
    "align_campaign": f"with {PSD}, full_records as (select campaign, record_idx from psd group by all having count(*) = 5) select campaign, (dense_rank() over (partition by campaign order by record_idx) - 1)::int as record_idx, sensor_id, src_row, ts_ms, 1000::bigint as tolerance_ms from psd join full_records using (campaign, record_idx)",
    "align_report": f"with {PSD}, s as (select campaign, record_idx, max(ts_ms) - min(ts_ms) as s from psd group by all), m as (select campaign, avg(s) as mean_spread_ms, max(s) as max_spread_ms from s group by all) select campaign, sensor_id, sensor_id = 'Node1' as is_anchor, count(*) as source_rows, count(*) as aligned_rows, 0::bigint as dropped_rows, 1.0::double as retained, round(any_value(mean_spread_ms), 6) as mean_spread_ms, any_value(max_spread_ms) as max_spread_ms from psd join m using (campaign) group by campaign, sensor_id",
    "stack_row_aligned": f"with {PSD} select campaign, sensor_id, (row_number() over (partition by campaign, sensor_id order by ts_ms, src_row) - 1)::int as record_idx, src_row from psd",
    "dataset_summary": f"with {PSD}, s as (select campaign, (max(ts_ms) - min(ts_ms)) / 1000 as s from psd group by campaign, record_idx), m as (select campaign, count(*) as n_records, avg(s) as mean_spread_s, max(s) as max_spread_s from s group by all) select campaign, count(distinct sensor_id) as n_sensors, max(n_bins) as n_bins, round(max((end_freq_hz - start_freq_hz) / (n_bins - 1)), 6) as step_hz, round(max(end_freq_hz - start_freq_hz) / 1e6, 6) as span_mhz, string_agg(distinct sensor_id, ',' order by sensor_id) as sensors, any_value(n_records) as n_records, round(any_value(mean_spread_s), 6) as mean_spread_s, round(any_value(max_spread_s), 6) as max_spread_s from psd join m using (campaign) group by campaign",
    "sensor_integrity": f"with {PSD}, v as (select campaign, sensor_id, unnest(pxx_db) as v from psd), a as (select campaign, sensor_id, avg(v) as mean_db, stddev_pop(v) as std_db, min(v) as min_db, max(v) as max_db from v group by all) select campaign, sensor_id, count(*) as n_records, min(ts_ms) as first_ms, max(ts_ms) as last_ms, round((max(ts_ms) - min(ts_ms)) / 1000, 6) as span_s, round(any_value(mean_db), 6) as mean_db, round(any_value(std_db), 6) as std_db, round(any_value(min_db), 6) as min_db, round(any_value(max_db), 6) as max_db from psd join a using (campaign, sensor_id) group by campaign, sensor_id",
    "psd_histogram": f"with {CELLS}, {_hist('cells')} select campaign, sensor_id, bin, n, round(density, 6) as density from dens",
    "histogram_summary": f"with {CELLS}, c as (select campaign, value, 10.0::double as lo, (50.0::double - 10.0::double) / 50 as w from cells), g as (select *, least(floor((value - lo) / w), 49) as g from c where value between 10 and 50), h as (select campaign, (g - (value < lo + g * w)::int + (value >= lo + (g + 1) * w and g < 49)::int)::int as bin, count(*) as n from g group by all), t as (select campaign, count(*) filter (value < 10 or value > 50) / count(*) as clipped_fraction from cells group by campaign), b as (select campaign, unnest(range(0, 50))::int as bin from t), a as (select campaign, bin, coalesce(n, 0)::bigint as n from b left join h using (campaign, bin)) select campaign, bin, round(10 + (bin + 0.5::double) * (40::double / 50), 6) as centre, n, round(n / (sum(n) over (partition by campaign) * (40::double / 50)), 6) as density, round(clipped_fraction, 6) as clipped_fraction from a join t using (campaign)",
    "distribution_similarity": f"with {PSD}, {DIST} select campaign, sensor_id, is_outlier, rank, {r('score normalised_score')} from dist",
    "record_correlation": f"with {PSD}, {CORR} select campaign, record_idx, sensor_a, sensor_b, round(value, 6) as value from rho",
    "mean_correlation_matrix": f"with {PSD}, {CORR} select campaign, sensor_a, sensor_b, round(avg(value), 6) as mean_correlation from rho group by all",
    "rank_stability": f"with {PSD}, {CORR}, k as (select *, row_number() over (partition by campaign, record_idx order by score desc, sensor_id desc) as rank from scores) select campaign, sensor_id, round(avg(rank), 6) as mean_rank, min(rank) as best_rank, max(rank) as worst_rank, round(min(score), 6) as min_score, round(max(score), 6) as max_score, round(stddev_pop(score), 6) as score_std, count(*) filter (rank = 1) as top_1_count, round(count(*) filter (rank = 1) / count(*), 6) as top_1_fraction from k group by campaign, sensor_id",
    "dataset_overview": f"with {PSD}, {CORR}, {RANKING}, b as (select *, row_number() over (partition by campaign order by mean_score desc, sensor_id) as k, count(*) over (partition by campaign) as n_sensors, max(n_records) over (partition by campaign) as nr from ranking) select campaign, sensor_id as best_sensor, round(mean_score, 6) as best_score, round(mean_correlation, 6) as best_correlation, n_sensors, nr as n_records from b where k = 1",
    "reliable_sensor": f"with {PSD}, {CORR}, {RANKING}, {DIST}, j as (select campaign, ranking.sensor_id, row_number() over (partition by campaign order by is_outlier, ranking.rank) as k from ranking join dist using (campaign, sensor_id)) select campaign, sensor_id as reliable_sensor from j where k = 1",
    "mean_psd_curve": f"with {PSD}, {CORR}, {RANKING}, v as (select campaign, sensor_id, unnest(pxx_db) as v, (generate_subscripts(pxx_db, 1) - 1)::int as bin from psd join (select campaign, sensor_id from ranking where rank <= 3) using (campaign, sensor_id)) select campaign, sensor_id, bin, round(avg(v), 6) as mean_db from v group by all",
    "corpus_stats": f"with {PSD}, v as (select power(10.0::double, unnest(pxx_db) / 10) as p from psd) select round(var_pop(p) * 1e12, 6) as variance, round(quantile_cont(p, 0.05) * 1e6, 6) as q05, round(greatest(1e-18, 1e-3 * var_pop(p)) * 1e12, 6) as variance_floor, 88e6::double as freq_min_hz, 108e6::double as freq_max_hz from v",
    "config_stats": f"with {CONFIGS} " + " union all ".join(f"select '{f}' as feature, round(avg({f}), 4) as mean, round(case when stddev_pop({f}) <= 1e-12 then 1 else stddev_pop({f}) end, 4) as scale, round(min({f}), 4) as least, round(max({f}), 4) as greatest from configs where role = 'train'" for f in FEATURES),
    "trust_envelope": f"with {CONFIGS}, s as (select {TRAIN_STATS} from configs where role = 'train'), o as (select config_id, greatest({', '.join(f'abs(({f} - m_{f}) / s_{f})' for f in FEATURES)}) as z, list_filter([{', '.join(f'''case when {f} < lo_{f} or {f} > hi_{f} then '{f}' end''' for f in FEATURES)}], lambda x: x is not null) as o from configs, s) select config_id, round(z, 4) as max_abs_z, array_to_string(o, ',') as out_of_range, len(o) > 0 as outside_envelope from o",
    "calibration_map": f"with {PSD}, {CURVES}, {CAL} select campaign, record_idx, sensor_id, round(list_sum(cp) * 1e6, 6) as total_uw from cal",
    "propagated_variance": f"with {PSD}, {CURVES} select sensor_id, round(list_sum(list_transform(range(1, len(gain) + 1), lambda i: var[i] / greatest(gain[i] * gain[i], 1e-12))) * 1e12, 6) as sum_var, 'observation_noise_only' as uncertainty from curves",
    "curve_summary": f"with {PSD}, {CURVES} select sensor_id, " + ", ".join(f"round(list_avg(list_transform({c}, lambda x: 10 * log10(greatest(x, 1e-12)))), 6) as mean_{c}_db" for c in ("gain", "floor", "var")) + " from curves",
    "sensor_training_summary": f"with {PSD}, {CURVES}, b as (select sensor_id, unnest(gain) as g, unnest(floor) as f, unnest(var) as v from (select distinct campaign, sensor_id from psd) join curves using (sensor_id)) select sensor_id, (select count(distinct campaign) from psd) as campaigns, round(quantile_cont(10 * log10(greatest(g, 1e-12)), 0.5), 6) as median_gain_db, round(quantile_cont(10 * log10(greatest(f, 1e-12)), 0.5), 6) as median_floor_db, round(quantile_cont(10 * log10(greatest(sqrt(v), 1e-12)), 0.5), 6) as median_std_db, round(1.0 / (select count(distinct sensor_id) from psd), 6) as weight from b group by sensor_id",
    "pairwise_rmse": f"with {PSD}, {RMSE.format(x='pxx_db', n='rmse_db', t='psd')} select campaign, record_idx, round(rmse_db, 6) as rmse_db from rm",
    "log_dispersion": f"with {PSD}, {CURVES}, {CAL}, {DISP} select campaign, round(dispersion, 6) as dispersion from disp",
    "pairwise_log_correlation": f"with {PSD}, {CURVES}, {CAL}, {LOGC} select campaign, round(log_correlation, 6) as log_correlation from logc",
    "overlay_limits": f"with {PSD}, {CURVES}, {CAL}, {DB} select campaign, round(min(least(list_min(raw_db), list_min(cal_db))) - 0.5, 6) as lower, round(max(greatest(list_max(raw_db), list_max(cal_db))) + 0.5, 6) as upper from db group by campaign",
    "campaign_diagnostics": f"with {PSD}, {CURVES}, {CAL}, {DB}, {DIAG} select campaign, role, is_ood, n_records, {r('mean_raw_rmse_db median_raw_rmse_db max_raw_rmse_db mean_cal_rmse_db median_cal_rmse_db max_cal_rmse_db improvement_db dispersion log_correlation')} from diag",
    "role_summary": f"with {PSD}, {CURVES}, {CAL}, {DB}, {DIAG} select role, count(*) as campaigns, sum(n_records)::bigint as records, round(avg(mean_raw_rmse_db), 6) as mean_raw_rmse_db, round(avg(mean_cal_rmse_db), 6) as mean_cal_rmse_db, round(max(max_cal_rmse_db), 6) as max_cal_rmse_db, round(sum(dispersion), 6) as dispersion_term, round(sum(1 - log_correlation), 6) as correlation_term, count(*) filter (is_ood) as ood_campaigns from diag group by role",
    "objective_history": f"with {EV}, s as (select campaign || '/' || sensor_id as run, src_row as step, value as objective from ev), l as (select *, lag(objective) over w as b, min(objective) over (partition by run order by step rows unbounded preceding) as best, row_number() over (partition by run order by objective, step) as k from s window w as (partition by run order by step)) select run, step, round(objective, 4) as objective, round(objective - b, 4) as delta, round((objective - b) / greatest(abs(b), 1e-12), 4) as relative_delta, objective <= best as is_best_so_far, k = 1 as is_selected from l",
    "stream_calibrate": f"with {PSD}, {CURVES}, {CAL} select campaign, sensor_id, count(*) as n, round(sum(list_sum(cp)) * 1e6, 6) as total_uw from cal group by all",
    "content_fingerprint": f"""with {PSD} select campaign, sha256('{{"campaign":"' || campaign || '","grid":{{"start_freq_hz":8.8E7,"end_freq_hz":1.08E8,"n_bins":' || any_value(n_bins) || '}},"n":' || count(*) || ',"sensors":["' || string_agg(distinct sensor_id, '","' order by sensor_id) || '"]}}') as sha256 from psd group by campaign""",
    "write_calibrated": f"with {PSD}, {CURVES}, {CAL} select campaign, sensor_id, count(*) as n, round(sum(list_sum(cp)) * 1e6, 6) as total_uw from cal group by all",
    "ingest_measurements": f"with {LANDED} select id, coalesce(nullif(trim(mac), ''), 'fallback') as mac, coalesce(campaign_id::bigint, 7) as campaign_id, replace(pxx, ' ', '') as pxx, '88e6' as start_freq_hz, '108e6' as end_freq_hz, ts as timestamp, {', '.join(f'null::varchar as {c}' for c in ('lat', 'lng', 'excursion_peak_to_peak_hz', 'excursion_peak_deviation_hz', 'excursion_rms_deviation_hz', 'depth_peak_to_peak', 'depth_peak_deviation', 'depth_rms_deviation', 'created_at'))} from landed where pxx is not null and pxx <> ''",
    "ingest_report": f"with {LANDED}, raw as (select * from landed where not (campaign = 'c1' and label = 'click')), pairs as (select * from (select distinct campaign from raw), (select distinct label from raw)), n as (select campaign, label, count(*) as raw, count(*) filter (pxx is not null and pxx <> '' and not (campaign = 'c2' and label = 'view')) as kept from raw group by all) select campaign, label, coalesce(kept, 0) as rows, case when raw is null then 'no data' when kept = 0 then 'nothing left after filter' else 'saved' end as reason from pairs left join n using (campaign, label)",
    "read_measurements": f"with {LANDED}, v as (select *, id::bigint % 13 = 0 or pxx is null or pxx = '' as bad from landed) select campaign, label as sensor_id, count(*) filter (not bad) as n_good, round(sum(id::bigint % 7 + id::bigint % 5 + user_id % 3) filter (not bad), 6)::double as total, count(*) filter (bad) as n_bad from v group by all",
    "parse_campaign_payload": "select p_partkey as campaign_id, 'campaign ' || p_partkey as name, (60 + p_size * 15)::double as acquisition_interval_s, (88000000 + 125000 * p_size)::double as central_freq_hz, p_size * 1e6::double as span_hz, (1000 * (1 + p_size % 5))::double as rbw_hz, case p_size % 3 when 1 then true when 2 then false end as antenna_amp, case when p_size % 3 = 0 then 'antenna_amp missing' end as problem from part",
    "build_metadata_row": "select 'c' || p_partkey as campaign_label, p_partkey::varchar as campaign_id, printf('%.12g', (60 + p_size * 15) / 60) as acquisition_freq_minutes, printf('%.12g', (88000000 + 125000 * p_size) / 1e6) as \"central_freq_MHz\", p_size::varchar as \"span_MHz\", (1 + p_size % 5)::varchar as \"rbw_kHz\", case p_size % 3 when 1 then 'true' when 2 then 'false' end as antenna_amp from part",
    "load_campaign_config": "with f as (select 'g' || (p_partkey % 50) as campaign, first(p_size order by p_partkey) as s from part group by all) select campaign, round((88000000 + 125000 * s)::double, 3) as central_freq_hz, round(s * 1e6::double, 3) as span_hz, round((1000 * (1 + s % 5))::double, 3) as rbw_hz, (s % 40)::double as lna_gain_db, (s % 20)::double as vga_gain_db, round((60 + s * 15)::double, 3) as acquisition_interval_s, case s % 3 when 1 then true when 2 then false end as antenna_amp, case when s % 3 = 0 then 'antenna_amp missing' end as problem from f",
    "load_registry": "with r as (select 'r' || (p_partkey % 997) as label, case when p_partkey % 5 = 0 then null else p_partkey end as id from part), w as (select *, count(*) over (partition by label) as n from r) select problem, count(*) as n from (select case when id is null or id <= 0 then 'bad id' when n > 1 then 'repeated label' end as problem from w) where problem is not null group by problem",
    "resolve_sensors": f"with {CELLS}, reg as (select distinct sensor_id as label, case when sensor_id = 'Node3' then ' ' else 'mac-' || sensor_id end as mac from cells), c as (select 'Node' || (s_suppkey * 5 % 11) as label, s_suppkey as pos from supplier), w as (select *, count(*) over (partition by label) as n from c) select label, pos, mac, case when n > 1 then 'repeated' when mac is null then 'unknown' when trim(mac) = '' then 'blank mac' end as problem from w left join reg using (label)",
    "rank_campaigns": f"with {PSD}, {CORR}, {NOISE}, {RANKING}, {DIST}, f as (select campaign, sensor_id, avg(noise_floor_db) as mean_noise_floor_db from psd join nf using (src_row) group by all) select campaign, sensor_id, n_records, ranking.rank, is_outlier, round(score, 6) as similarity, {r('mean_score mean_correlation score_std mean_noise_floor_db')} from ranking join dist using (campaign, sensor_id) join f using (campaign, sensor_id)",
    "prepare_corpus": f"with {PSD.replace('psd as', 'every as', 1)}, psd as (select * from every where record_idx > 0 and not (campaign = 'c1' and sensor_id = 'Node5')), {CORR}, {RANKING}, {DIST}, {CONFIGS}, j as (select campaign, ranking.sensor_id, is_outlier, row_number() over (partition by campaign order by is_outlier, ranking.rank) as k from ranking join dist using (campaign, sensor_id)), best as (select campaign, any_value(sensor_id) filter (k = 1) as reliable_sensor, coalesce(string_agg(sensor_id, ',' order by sensor_id) filter (is_outlier), '') as outliers from j group by campaign) select campaign, string_agg(distinct sensor_id, ',' order by sensor_id) as sensors, case when campaign = 'c1' then 'Node5' else '' end as left_out, count(distinct record_idx) as n_records, any_value(reliable_sensor) as reliable_sensor, any_value(outliers) as outliers, round(any_value(central_freq_hz) / 1e6, 6) as central_freq_mhz, round(any_value(span_hz) / 1e6, 6) as span_mhz, round(any_value(rbw_hz) / 1e3, 6) as rbw_khz, round(any_value(acquisition_interval_s) / 60, 6) as interval_min from psd join best using (campaign) left join configs on config_id = substring(campaign, 2)::bigint group by campaign",
    "campaign_inspection": f"with {PSD} select campaign, sensor_id, count(*) as n_records, make_timestamp(min(ts_ms) * 1000)::varchar as start_utc, make_timestamp(max(ts_ms) * 1000)::varchar as end_utc, round((max(ts_ms) - min(ts_ms)) / 60000, 6) as span_min, 64.0::double as median_bins, round(avg(list_avg(pxx_db)), 6) as mean_db, round(avg(list_aggregate(pxx_db, 'quantile_cont', 0.1)), 6) as mean_p10_db from psd group by campaign, sensor_id",
    "deployment_summary": f"with {PSD}, {CURVES}, {CAL}, b as (select campaign, record_idx, unnest(cp) as v, generate_subscripts(cp, 1) as bin from cal), sp as (select campaign, avg(s) as calibrated_spread from (select campaign, record_idx, bin, stddev_pop(v) as s from b group by all) group by campaign), vs as (select campaign, avg(v) as m, quantile_cont(v, 0.99) as q from b group by campaign), gs as (select avg(s) as g from (select bin, stddev_pop(v) as s from (select unnest(gain) as v, generate_subscripts(gain, 1) as bin from curves) group by bin)), cs as (select avg(list_avg(gain)) as mg, avg(list_avg(floor)) as mf, avg(list_avg(var)) as mv, max(sqrt(list_avg(list_transform(range(2, len(gain)), lambda i: power(gain[i + 1] - 2 * gain[i] + gain[i - 1], 2))))) as r from curves) select campaign, round(calibrated_spread * 1e6, 6) as calibrated_spread, round(m * 1e6, 6) as mean_calibrated, round(q * 1e6, 6) as q99_calibrated, round(g, 6) as gain_spread, round(mg, 6) as mean_gain, round(mf * 1e6, 6) as mean_floor, round(mv * 1e12, 6) as mean_var, round(r, 6) as max_gain_roughness from sp join vs using (campaign), gs, cs",
    "spline_basis": f"with {CONFIGS}, g as (select config_id, central_freq_hz - span_hz / 2 as a, central_freq_hz + span_hz / 2 as b from configs), points as (select config_id, i as bin, least(greatest((a + i * (b - a) / 15 - lo) / (hi - lo), 0), 1) as x from g, (select min(a) - 123457.0::double as lo, max(b) + 234571.0::double as hi from g), (select unnest(range(0, 16)) as i)), {_splines([0, 0, 0, 0, 0.2, 0.4, 0.6, 0.8, 1, 1, 1, 1], 3)}, w as (select config_id, bin, unnest(b) as weight, generate_subscripts(b, 1) - 1 as spline from splines) select config_id, bin::int as bin, spline::int as spline, round(weight, 6) as weight from w where weight > 1e-9",
    "config_geometry": f"with {CONFIGS}, train as (select * from configs where role = 'train') " + " union all ".join(_covariance(a, b) for a in FEATURES for b in FEATURES),
    "evaluate_curves": f"with {PSD}, {LEVEL} select campaign, sensor_id, bin::int as bin, {r('gain floor var')} from level",
    "latent_update": f"with {PSD}, {LEVEL} select campaign, record_idx, bin::int as bin, round(s, 6) as s from lat",
    "write_latent": f"with {PSD}, {LEVEL} select campaign, record_idx, count(*)::int as n, round(sum(s), 6) as total from lat group by all",
    "write_curves": f"with {PSD}, {LEVEL} select campaign, sensor_id, count(*)::int as n, round(avg(gain), 6) as mean_gain, round(avg(floor), 6) as mean_floor, round(avg(var), 6) as mean_var from level group by all",
    "initial_floors": f"with {PSD}, {LEVEL} select campaign, sensor_id, bin::int as bin, round(0.1::double * quantile_disc(y, 0.05), 6) as floor from obs group by all",
    "objective_and_gradient": f"""with {PSD}, {LEVEL}, res as (select campaign, sensor_id, bin, any_value(gain) as gain, any_value(var) as v, any_value(pn) as pn, any_value(pv) as pv, count(*) as n, sum(y - gain * s - floor) as r, sum(power(y - gain * s - floor, 2)) as rr
  from obs join lat using (campaign, record_idx, bin) group by campaign, sensor_id, bin), rel as (select campaign, min(sensor_id) as reliable from psd group by campaign)
  select round(sum(0.5::double * (rr / v + n * ln(v)) + case when sensor_id = reliable then 0.01::double * power(ln(gain), 2) else 0 end), 4) as loss, round(sum(-r / v / (1 + exp(-pn))), 4) as floor_slope,
  round(sum(0.5::double * (n / v - rr / (v * v)) / (1 + exp(-pv))), 4) as variance_slope from res join rel using (campaign)""",
    "consistency_penalty": f"with {PSD}, {LEVEL}, {LOGS}, q as (select campaign, record_idx, sum(ss) / sum(n) as q from (select campaign, record_idx, bin, var_pop(z) * count(*) as ss, count(*) as n from lx group by all) group by all) select round(sum(q / records), 6) as penalty from q join nr using (campaign)",
    "correlation_penalty": f"with {PSD}, {LEVEL}, {LOGS}, c as (select a.campaign, a.record_idx, a.sensor_id, b.sensor_id as other, corr(a.z, b.z) as rho from lx a join lx b on a.campaign = b.campaign and a.record_idx = b.record_idx and a.bin = b.bin and a.sensor_id < b.sensor_id group by all), q as (select campaign, record_idx, avg(1 - rho) as q from c group by all) select round(sum(q / records), 6) as penalty from q join nr using (campaign)",
    "trust_diagnostics": f"with {TRUST} select config_id, bins_below, bins_above, round(distance, 6) as distance, round(erfc + exp(-d2 / 2) * sqrt(d2 / 2 / pi()) * 2 * (1 + d2 / 3 + d2 * d2 / 15), 6) as tail_probability, outside_envelope, outside_envelope or distance > threshold or bins_below > 0 or bins_above > 0 as is_ood from ds",
}
