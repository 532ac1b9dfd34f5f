"""M1-M20."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import gridding as G
from hourgrid.operators import scoring as M
from hourgrid.operators.fills import rolling_mean
from hourgrid.workload.base import DIM, Tables, query, rounded, s6
from hourgrid.workload.gridding import XY, _REGIONS, _few

_PARTS = {
    "rmse": "sqrt(avg(pow(p - t, 2)))",
    "mae": "avg(abs(p - t))",
    "r2": "1 - sum(pow(t - p, 2)) / nullif(var_pop(t) * count(t), 0e0)",
    "nrmse": "sqrt(avg(pow(p - t, 2))) / avg(t) * 100",
    "mape": "avg(abs(p - t) / greatest(abs(t), 2.220446049250313e-16)) * 100",
}
ALL = tuple(_PARTS)


def metrics_sql(*names: str) -> str:
    return ", ".join(f"{s6(_PARTS[n])} AS {n}" for n in names or ALL)


F_TP = "(SELECT *, y_true AS t, y_pred AS p FROM forecasts)"


def _score(name: str, metric: str):
    @query(name, f"SELECT {metrics_sql(metric)} FROM {F_TP}")
    def _(t: Tables):
        return rounded(M.score(t.forecasts).select(metric), metric)


for _name, _metric in (("m1_rmse", "rmse"), ("m2_mae", "mae"), ("m3_r2", "r2"), ("m4_nrmse", "nrmse"), ("m4_mape", "mape")):
    _score(_name, _metric)


@query("m5_metrics_by_hour", f"SELECT horizon, {metrics_sql()} FROM {F_TP} GROUP BY horizon")
def _(t: Tables):
    return rounded(M.score(t.forecasts, "horizon"), *ALL)


_H = ("h1", "h2", "h3", "h4")
_CELL = f"c AS (SELECT sensor_id, horizon, {_PARTS['rmse']} AS r FROM {F_TP} GROUP BY sensor_id, horizon)"
_HCOLS = ", ".join(f"{s6(f'avg(r) FILTER (WHERE horizon = {h})')} AS h{h}" for h in (1, 2, 3, 4))


@query("m6_sensor_hour_matrix", f"+ {_CELL} SELECT CAST(sensor_id AS VARCHAR) AS sensor_id, {_HCOLS}, {s6('avg(r)')} AS mean_rmse FROM c GROUP BY sensor_id UNION ALL SELECT 'all', {_HCOLS}, {s6('avg(r)')} FROM c")
def _(t: Tables):
    return rounded(M.rmse_matrix(t.forecasts, (1, 2, 3, 4)), *_H, "mean_rmse")


# Errors scaled down so that every quality bucket occurs.
_SMALL = "(SELECT *, y_true / 20 AS t, y_pred / 20 AS p FROM forecasts)"
_RANK = f"rk AS (SELECT sensor_id, {_PARTS['rmse']} AS rmse FROM {_SMALL} GROUP BY sensor_id)"
_BUCKET = "CASE WHEN rmse < 1.5e0 THEN 'excellent' WHEN rmse < 3 THEN 'good' WHEN rmse < 5 THEN 'fair' ELSE 'poor' END"


def _small(t: Tables):
    return t.forecasts.withColumn("y_true", F.col("y_true") / 20).withColumn("y_pred", F.col("y_pred") / 20)


@query("m7_station_ranking", f"+ {_RANK} SELECT sensor_id, {s6('rmse')} AS rmse, {_BUCKET} AS bucket FROM rk")
def _(t: Tables):
    return rounded(M.station_ranking(_small(t)), "rmse")


@query("m7_station_summary", f"+ {_RANK}, b AS (SELECT *, {_BUCKET} AS bucket FROM rk) SELECT arg_min(sensor_id, (rmse, sensor_id)) AS best, arg_max(sensor_id, (rmse, sensor_id)) AS worst, {s6('avg(rmse)')} AS mean_rmse, {s6('max(rmse) - min(rmse)')} AS rmse_range, " + ", ".join(f"count(*) FILTER (WHERE bucket = '{n}') AS n_{n}" for n in ("excellent", "good", "fair", "poor")) + f", {s6('count(*) FILTER (WHERE rmse < 3) / CAST(count(*) AS DOUBLE) * 100')} AS reliable_pct FROM b")
def _(t: Tables):
    return rounded(M.station_summary(_small(t)), "mean_rmse", "rmse_range", "reliable_pct")


@query("m8_sensor_hour_table", f"""+ c AS (SELECT horizon, sensor_id, {', '.join(f'{_PARTS[n]} AS {n}' for n in ALL)}, avg(t) AS mean_true, avg(p) AS mean_pred FROM {F_TP} GROUP BY horizon, sensor_id)
SELECT horizon, sensor_id, {', '.join(f'{s6(n)} AS {n}' for n in ('rmse', 'mae', 'r2', 'nrmse', 'mean_true', 'mean_pred'))}, row_number() OVER (PARTITION BY horizon ORDER BY rmse, sensor_id) = 1 AS is_best, row_number() OVER (PARTITION BY horizon ORDER BY rmse DESC, sensor_id DESC) = 1 AS is_worst FROM c""")
def _(t: Tables):
    return rounded(M.sensor_hour_table(t.forecasts), "rmse", "mae", "r2", "nrmse", "mean_true", "mean_pred")


@query("m9_worst_pairs", f"+ {_CELL} SELECT sensor_id, horizon, {s6('r')} AS rmse FROM c ORDER BY r DESC, sensor_id, horizon LIMIT 5")
def _(t: Tables):
    return rounded(M.worst_pairs(t.forecasts), "rmse")


def _persistence_sql(where: str = "true") -> str:
    return f"""+ l AS (SELECT y_true, y_pred, lead(y_true) OVER w AS nt, lead(y_pred) OVER w AS np FROM forecasts WHERE {where} WINDOW w AS (PARTITION BY sensor_id, horizon ORDER BY sample_id)),
e AS (SELECT 'baseline' AS kind, y_true AS t, nt AS p FROM l UNION ALL SELECT 'model', y_true, y_pred FROM l UNION ALL SELECT 'model_shifted', y_true, np FROM l)
SELECT kind, {metrics_sql()} FROM e WHERE p IS NOT NULL GROUP BY kind"""


@query("m10_persistence_baseline", _persistence_sql())
def _(t: Tables):
    return rounded(M.persistence_report(t.forecasts), *ALL)


@query("m10_persistence_first_frame", _persistence_sql("horizon = 1"))
def _(t: Tables):
    return rounded(M.persistence_report(t.forecasts, first_frame_only=True), *ALL)


@query("m11_persistence_cleaned", _persistence_sql("y_true > 15 AND horizon <= 2"))
def _(t: Tables):
    from hourgrid.operators.cleaning import drop_dead_readings, subset_targets
    dead = F.when(F.col("y_true") <= 15, 0.0).otherwise(F.col("y_true"))
    return rounded(M.persistence_report(drop_dead_readings(subset_targets(t.forecasts.withColumn("y_true", dead), 2))), *ALL)


@query("m12_extreme_weeks", f"""+ w AS (SELECT sensor_id, sample_id, sqrt(avg(pow(y_pred - y_true, 2)) OVER a) AS rmse, avg(y_true) OVER a AS m, row_number() OVER (PARTITION BY sensor_id ORDER BY sample_id) AS i, count(*) OVER (PARTITION BY sensor_id) AS n FROM forecasts WHERE horizon = 1 WINDOW a AS (PARTITION BY sensor_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND 167 FOLLOWING)),
v AS (SELECT sensor_id, sample_id, rmse / m * 100 AS nrmse FROM w WHERE i <= n - 168)
SELECT sensor_id, arg_min(sample_id, (nrmse, sample_id)) AS best_start, {s6('min(nrmse)')} AS best_nrmse, arg_max(sample_id, (nrmse, -sample_id)) AS worst_start, {s6('max(nrmse)')} AS worst_nrmse FROM v GROUP BY sensor_id""")
def _(t: Tables):
    return rounded(M.extreme_weeks(t.forecasts.where(F.col("horizon") == 1), 168), "best_nrmse", "worst_nrmse")


@query("m13_extreme_samples", f"""+ s AS (SELECT sample_id, {_PARTS['rmse']} AS rmse FROM {F_TP} GROUP BY sample_id)
(SELECT sample_id, {s6('rmse')} AS rmse, 'best' AS kind FROM s ORDER BY s.rmse, sample_id LIMIT 10) UNION ALL (SELECT sample_id, {s6('rmse')}, 'worst' FROM s ORDER BY s.rmse DESC, sample_id DESC LIMIT 10)""")
def _(t: Tables):
    return rounded(M.extreme_samples(t.forecasts), "rmse")


_R3 = "rg AS (SELECT 'sensor' AS region, x, y FROM sc UNION ALL SELECT 'nhood', x, y FROM nh UNION ALL SELECT 'full', x, y FROM k)"


@query("m14_region_nrmse", f"""+ {XY}, {_REGIONS.format(r=2)}, {_R3}, h AS (SELECT region, horizon, sqrt(avg(pow(y_pred - y_true, 2))) / (avg(y_true) + 1e-8) * 100 AS nrmse FROM forecasts f JOIN rg ON rg.x = f.x AND rg.y = f.y GROUP BY region, horizon)
SELECT region, horizon, {s6('nrmse')} AS nrmse, {s6('avg(nrmse) OVER (PARTITION BY region)')} AS region_mean FROM h""")
def _(t: Tables):
    return rounded(M.region_scores(t.forecasts, G.region_masks(_few(t), DIM, 2)), "nrmse", "region_mean")


@query("m15_weighted_mae", f"+ {XY}, {_REGIONS.format(r=1)} SELECT {s6('avg(abs(y_true - y_pred) * CASE WHEN sc.x IS NOT NULL THEN 25 WHEN nh.x IS NOT NULL THEN 5 ELSE 1 END)')} AS weighted_mae FROM forecasts f LEFT JOIN sc ON sc.x = f.x AND sc.y = f.y LEFT JOIN nh ON nh.x = f.x AND nh.y = f.y")
def _(t: Tables):
    return rounded(M.weighted_mae(t.forecasts, G.weight_grid(_few(t), DIM, 1)), "weighted_mae")


@query("m16_sensor_error_series", f"SELECT sensor_id, sample_id, {s6('y_true')} AS y_true, {s6('y_pred')} AS y_pred, {s6('abs(y_pred - y_true)')} AS abs_error, {s6('avg(abs(y_pred - y_true)) OVER (PARTITION BY sensor_id)')} AS mae FROM forecasts WHERE horizon = 2")
def _(t: Tables):
    out = M.sensor_error_series(t.forecasts, 2).select("sensor_id", "sample_id", "y_true", "y_pred", "abs_error", "mae")
    return rounded(out, "y_true", "y_pred", "abs_error", "mae")


@query("m17_rolling_error", f"SELECT sensor_id, sample_id, {s6('abs(y_pred - y_true)')} AS abs_error, CASE WHEN count(*) OVER a = 24 THEN {s6('avg(abs(y_pred - y_true)) OVER a')} END AS mean_24 FROM forecasts WHERE horizon = 1 WINDOW a AS (PARTITION BY sensor_id ORDER BY sample_id ROWS 23 PRECEDING)")
def _(t: Tables):
    rows = M.sensor_error_series(t.forecasts, 1).select("sensor_id", "sample_id", "abs_error")
    return rounded(rolling_mean(rows, 24, ts="sample_id", value="abs_error"), "abs_error", "mean_24")


@query("m18_best_epoch", "SELECT l_suppkey AS run_id, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_val_loss FROM (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS epoch, l_quantity AS val_loss FROM lineitem) GROUP BY l_suppkey")
def _(t: Tables):
    log = t.raw("lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("epoch"), F.col("l_quantity").alias("val_loss"))
    return M.best_epoch(log)


@query("m19_leaderboard", "(SELECT 'val_loss' AS board, p_partkey AS run_id, p_size AS score FROM part ORDER BY p_size, p_partkey LIMIT 10) UNION ALL (SELECT 'nrmse', p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)")
def _(t: Tables):
    runs = t.raw("part").select(F.col("p_partkey").alias("run_id"), F.col("p_size").cast("double").alias("val_loss"), F.col("p_retailprice").alias("nrmse"))
    boards = [M.leaderboard(runs, m).select(F.lit(m).alias("board"), "run_id", F.col(m).alias("score")) for m in ("val_loss", "nrmse")]
    return boards[0].unionByName(boards[1])


@query("m20_error_grid", f"SELECT sample_id, horizon, x, y, {s6('y_pred - y_true')} AS error, {s6('(SELECT least(min(y_true), min(y_pred)) FROM forecasts)')} AS range_min, {s6('(SELECT greatest(max(y_true), max(y_pred)) FROM forecasts)')} AS range_max, {s6('(SELECT max(abs(y_pred - y_true)) FROM forecasts)')} AS max_abs_error FROM forecasts")
def _(t: Tables):
    cols = ("error", "range_min", "range_max", "max_abs_error")
    return rounded(M.error_grid(t.forecasts).select("sample_id", "horizon", "x", "y", *cols), *cols)
