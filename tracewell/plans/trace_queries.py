"""Queries over ordered traces: levels of events per user, and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import statistics as S
from ..operators import traces as T
from ..sources import load_table
from .registry import query

KEYS, ORDER = ["user_id"], ["ts", "event_id"]

#: Events with their level: view and signup macro, click and error meso, purchase micro.
EV = "SELECT user_id, event_id, ts, value, event_type, CASE WHEN event_type IN ('view','signup') THEN 0 WHEN event_type IN ('click','error') THEN 1 ELSE 2 END AS lvl FROM events"


def levelled_events(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("event_type").isin("view", "signup"), 0).when(F.col("event_type").isin("click", "error"), 1).otherwise(2)
    return load_table(spark, sf, "events").select("user_id", "event_id", "ts", "value", "event_type", level.alias("lvl"))


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, with negative zero made zero, so that engines agree."""
    return df.select(*((F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" and n not in keep else F.col(n) for n, t in df.dtypes))


def six_digits(value: Column) -> Column:
    """Six digits of a number that often ends in half a unit, as SQL has them: ``round(value, 6)`` goes by its decimal digits, SQL by the product in doubles."""
    return F.round(value * 1e6) / 1e6


JUMPS = f"""
WITH ev AS ({EV}), d AS (SELECT *, lvl - lag(lvl) OVER w AS delta FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
nz AS (SELECT user_id, sign(delta) AS s, lag(sign(delta)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM d WHERE delta <> 0),
fl AS (SELECT user_id, count(*) FILTER (WHERE s <> p) AS flips FROM nz GROUP BY user_id),
m AS (SELECT user_id, count(*) AS n_steps, count(*) FILTER (WHERE delta <> 0) AS jump_count, round(coalesce(avg(abs(delta)), 0), 6) AS mean_abs_delta,
 coalesce(max(abs(delta)), 0)::INT AS max_jump, round(var_pop(lvl), 6) AS level_variance FROM d GROUP BY user_id)
SELECT m.user_id, n_steps, jump_count, mean_abs_delta, max_jump, level_variance, coalesce(flips, 0)::BIGINT AS direction_changes,
 round(CASE WHEN n_steps > 1 THEN jump_count / (n_steps - 1) ELSE 0 END, 6) AS jump_rate FROM m LEFT JOIN fl USING (user_id)"""


@query("q_jump_metrics", JUMPS)
def jump_metrics(spark, sf):
    return T.jump_metrics(levelled_events(spark, sf), KEYS, ORDER, "lvl")


CELLS = [(i, j) for i in range(3) for j in range(3)]
_HARD = f"""WITH ev AS ({EV}), p AS (SELECT *, lead(lvl) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM ev),
m AS (SELECT user_id, count(nx) AS n_transitions, {', '.join(f'CASE WHEN count(nx) > 0 THEN count(*) FILTER (WHERE lvl = {i} AND nx = {j}) / count(nx) ELSE 0 END AS t_{i}{j}' for i, j in CELLS)} FROM p GROUP BY user_id)"""
_R = lambda names: ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
_T = [f"t_{i}{j}" for i, j in CELLS]


@query("q_transition_hard", f"{_HARD} SELECT user_id, n_transitions, {_R(_T)} FROM m")
def transition_hard(spark, sf):
    return rounded(T.hard_transitions(levelled_events(spark, sf), KEYS, ORDER, "lvl"))


_OFF = [f"t_{i}{j}" for i, j in CELLS if i != j]
_FEATURES = f"""{_HARD}, x AS (SELECT *, {' + '.join(_T)} AS tot, {' + '.join(_OFF)} AS off FROM m)
SELECT user_id, round(CASE WHEN tot = 0 THEN 0 ELSE (t_00 + t_11 + t_22) / tot END, 6) AS self_loop_ratio,
 round(abs({' + '.join(f'CASE WHEN {c} > 0 THEN {c} * log2({c}) ELSE 0 END' for c in _T)}), 6) AS entropy,
 round(sqrt(({' + '.join(f'({c} - off / 6) * ({c} - off / 6)' for c in _OFF)}) / 6), 6) AS oscillation_index,
 round(CASE WHEN tot = 0 THEN 0 ELSE (t_02 + t_20) / tot END, 6) AS shuttle,
 round(CASE WHEN off = 0 THEN 0 ELSE (t_01 + t_02 + t_12) / off END, 6) AS upward_ratio,
 round(CASE WHEN off = 0 THEN 0 ELSE (t_10 + t_20 + t_21) / off END, 6) AS downward_ratio,
 (list_position([{', '.join(_T)}], greatest({', '.join(_T)})) - 1)::INT AS dominant_cell FROM x"""


@query("q_transition_features", _FEATURES)
def transition_features(spark, sf):
    return rounded(T.transition_features(T.hard_transitions(levelled_events(spark, sf), KEYS, ORDER, "lvl")).drop("n_transitions", *_T))


@query("q_transition_rollup", f"{_HARD} SELECT user_id % 10 AS bucket, count(*) AS traces, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _T)} FROM m GROUP BY 1")
def transition_rollup(spark, sf):
    cells = T.hard_transitions(levelled_events(spark, sf), KEYS, ORDER, "lvl")
    return rounded(cells.groupBy(F.pmod("user_id", F.lit(10)).alias("bucket")).agg(F.count("*").alias("traces"), *(F.avg(c).alias(c) for c in _T)))


#: Level probabilities that follow from an event's value, to stand in for a probe's.
_PROBS = "exp(-abs((value - 10.0 * 1) / 10.0)) AS a0, exp(-abs((value - 10.0 * 3) / 10.0)) AS a1, exp(-abs((value - 10.0 * 6) / 10.0)) AS a2"


def soft_events(spark, sf):
    raw = levelled_events(spark, sf)
    a = [F.exp(-F.abs((F.col("value") - 10.0 * k) / 10.0)) for k in (1, 3, 6)]
    return raw.select("*", *(x.alias(f"a{k}") for k, x in enumerate(a))).select("user_id", "event_id", "ts", "lvl", *((F.col(f"a{k}") / (F.col("a0") + F.col("a1") + F.col("a2"))).alias(f"p{k}") for k in range(3)))


_SOFT = [f"s_{i}{j}" for i, j in CELLS]


@query(
    "q_transition_soft",
    f"""WITH ev AS (SELECT *, {_PROBS} FROM ({EV})), p AS (SELECT user_id, ts, event_id, a0 / (a0 + a1 + a2) AS p0, a1 / (a0 + a1 + a2) AS p1, a2 / (a0 + a1 + a2) AS p2 FROM ev),
n AS (SELECT *, {', '.join(f'lead(p{k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n{k}' for k in range(3))} FROM p)
SELECT user_id, {', '.join(f'round(coalesce(avg(p{i} * n{j}), 0), 6) AS s_{i}{j}' for i, j in CELLS)} FROM n GROUP BY user_id""",
)
def transition_soft(spark, sf):
    return rounded(T.soft_transitions(soft_events(spark, sf), KEYS, ORDER, ["p0", "p1", "p2"]))


_CONT = f"""{_HARD}, l AS ({' UNION ALL '.join(f"SELECT user_id % 4 AS condition, 't_{i}{j}' AS cell, round(t_{i}{j} * n_transitions) AS n FROM m" for i, j in CELLS)}),
f AS (SELECT condition, cell, sum(n) AS o FROM l GROUP BY ALL), e AS (SELECT *, sum(o) OVER (PARTITION BY condition) AS r, sum(o) OVER (PARTITION BY cell) AS c, sum(o) OVER () AS n FROM f)"""


@query("q_contingency", f"{_CONT} SELECT condition, cell, o AS n FROM f")
def contingency(spark, sf):
    cells = T.hard_transitions(levelled_events(spark, sf), KEYS, ORDER, "lvl").withColumn("condition", F.pmod("user_id", F.lit(4)))
    return T.cell_table(cells, "condition")


@query("q_contingency_chi2", f"{_CONT} SELECT round(sum((o - r * c / n) ^ 2 / (r * c / n)), 6) AS chi2, ((count(DISTINCT condition) - 1) * (count(DISTINCT cell) - 1))::BIGINT AS dof FROM e WHERE r > 0 AND c > 0")
def contingency_chi2(spark, sf):
    return rounded(S.chi_square(contingency(spark, sf), "condition", "cell", "n"))


_ARR = f"WITH ev AS ({EV}), a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS xs, count(*) AS n FROM ev GROUP BY user_id)"


def traces_of_values(spark, sf) -> DataFrame:
    """Per user the values in order, centred (cs) and interpolated to 20 points (xs)."""
    rows = levelled_events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("steps"))
    arrays = rows.select("user_id", F.transform("steps", lambda s: s["value"]).alias("raw"))
    return arrays.withColumn("cs", V.centred(F.col("raw"))).withColumn("xs", V.interpolate(F.col("cs"), 20))


_INTERP = f"""{_ARR}, c AS (SELECT user_id, n, list_transform(xs, lambda x: x - list_avg(xs)) AS cs FROM a),
g AS (SELECT user_id, n, cs, j, j * (n - 1) / 19.0::DOUBLE AS place FROM c, range(20) r(j)),
i AS (SELECT user_id, j, cs[(least(floor(place), n - 1) + 1)::INT] + (cs[(least(least(floor(place), n - 1) + 1, n - 1) + 1)::INT] - cs[(least(floor(place), n - 1) + 1)::INT]) * (place - least(floor(place), n - 1)) AS x FROM g)"""


@query("q_interpolate", f"{_INTERP} SELECT user_id, j::INT AS pos, round(x, 6) + 0.0 AS x FROM i")
def interpolate(spark, sf):
    return rounded(traces_of_values(spark, sf).select("user_id", F.posexplode("xs").alias("pos", "x")))


_FEAT = f"""{_INTERP}, dd AS (SELECT user_id, j, x, lead(x) OVER w - x AS d, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS dd FROM i WINDOW w AS (PARTITION BY user_id ORDER BY j)),
sg AS (SELECT user_id, j, sign(d) AS s, lag(sign(d)) OVER (PARTITION BY user_id ORDER BY j) AS p FROM dd WHERE abs(d) > 1e-8),
sc AS (SELECT user_id, count(*) FILTER (WHERE s <> p) AS dc FROM sg GROUP BY user_id),
zs AS (SELECT user_id, j, sign(x) AS s, lag(sign(x)) OVER (PARTITION BY user_id ORDER BY j) AS p FROM i WHERE abs(x) > 1e-8),
zc AS (SELECT user_id, count(*) FILTER (WHERE s <> p) AS zc FROM zs GROUP BY user_id)
SELECT user_id, round(max(x) FILTER (WHERE j = 0), 6) AS r_start, round(max(x) FILTER (WHERE j = 19), 6) AS r_end, round(stddev_pop(x), 6) AS r_std, round(max(x) - min(x), 6) AS r_range,
 round(avg(x) FILTER (WHERE j < 7), 6) AS r_early_mean, round(avg(x) FILTER (WHERE j BETWEEN 7 AND 13), 6) AS r_mid_mean, round(avg(x) FILTER (WHERE j > 13), 6) AS r_late_mean,
 round(sum(abs(d)), 6) AS r_total_variation, round(abs(max(x) FILTER (WHERE j = 19) - max(x) FILTER (WHERE j = 0)) / greatest(sum(abs(d)), 1e-8), 6) AS r_monotonicity,
 coalesce(any_value(dc), 0)::INT AS r_direction_changes, coalesce(any_value(zc), 0)::INT AS r_zero_crossings, round(arg_max(j, (x, -j)) / 19.0::DOUBLE, 6) AS r_peak_pos,
 round(max(x) - max(x) FILTER (WHERE j = 19), 6) AS r_fall_from_peak, round(max(d), 6) AS r_max_rise, round(greatest(0, -min(d)), 6) AS r_max_drop,
 round(avg(abs(dd)), 6) AS r_curvature_abs_mean, round(avg(greatest(x, 0)), 6) AS r_positive_mass, round(avg((x < 0)::INT), 6) AS r_time_negative
FROM dd LEFT JOIN sc USING (user_id) LEFT JOIN zc USING (user_id) GROUP BY user_id"""
_SHOWN = "start end std range early_mean mid_mean late_mean total_variation monotonicity direction_changes zero_crossings peak_pos fall_from_peak max_rise max_drop curvature_abs_mean positive_mass time_negative".split()


@query("q_trajectory_features", _FEAT)
def trajectory_features(spark, sf):
    features = V.trajectory_features(F.col("xs"), "r")
    return rounded(traces_of_values(spark, sf).select("user_id", *(features[f"r_{n}"].alias(f"r_{n}") for n in _SHOWN)))


@query("q_direction_zero_cross", f"{_FEAT.replace('SELECT user_id, round(max(x) FILTER (WHERE j = 0), 6) AS r_start', 'SELECT user_id, coalesce(any_value(dc), 0)::INT AS direction_changes, coalesce(any_value(zc), 0)::INT AS zero_crossings FROM dd LEFT JOIN sc USING (user_id) LEFT JOIN zc USING (user_id) GROUP BY user_id --').replace(chr(10) + ' round', ' round').replace(chr(10) + ' coalesce', ' coalesce').split('--')[0]}")
def direction_zero_cross(spark, sf):
    t = traces_of_values(spark, sf)
    return t.select("user_id", V.direction_changes(V.differences(F.col("xs"))).alias("direction_changes"), V.zero_crossings(F.col("xs")).alias("zero_crossings"))


@query("q_segment_means", f"{_INTERP} SELECT user_id, round(avg(x) FILTER (WHERE j < 7), 6) + 0.0 AS early, round(avg(x) FILTER (WHERE j BETWEEN 7 AND 13), 6) + 0.0 AS middle, round(avg(x) FILTER (WHERE j > 13), 6) + 0.0 AS late FROM i GROUP BY user_id")
def segment_means(spark, sf):
    early, middle, late = V.segment_means(F.col("xs"), 20)
    return rounded(traces_of_values(spark, sf).select("user_id", early.alias("early"), middle.alias("middle"), late.alias("late")))


@query("q_series_columns", f"{_INTERP} SELECT user_id, {', '.join(f'round(max(x) FILTER (WHERE j = {k}), 6) + 0.0 AS r_traj_t{k:02d}' for k in range(20))} FROM i GROUP BY user_id")
def series_columns(spark, sf):
    return rounded(traces_of_values(spark, sf).select("user_id", *(c.alias(n) for n, c in V.series_columns(F.col("xs"), "r").items())))


@query("q_outcome_band", f"{_INTERP}, o AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') > count(*) / 5 AS success FROM events GROUP BY user_id) SELECT success, j::INT AS pos, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std FROM i JOIN o USING (user_id) GROUP BY ALL")
def outcome_band(spark, sf):
    outcome = load_table(spark, sf, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") > F.count("*") / 5).alias("success"))
    points = traces_of_values(spark, sf).select("user_id", F.posexplode("xs").alias("pos", "x"))
    return rounded(points.join(outcome, "user_id").groupBy("success", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")))


@query(
    "q_step_features",
    f"""WITH ev AS ({EV}), s AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS step_index, count(*) OVER (PARTITION BY user_id) AS n_steps, value - avg(value) OVER (PARTITION BY user_id) + 1e-9 AS centred,
 value - first_value(value) OVER w AS from_start, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - value AS to_end,
 value - coalesce(lag(value) OVER w, value) AS delta_prev, coalesce(lead(value) OVER w, value) - value AS delta_next,
 max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - value AS fall_from_peak, value - min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rebound_from_trough
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, step_index::INT AS step_index, n_steps, {_R("centred from_start to_end delta_prev delta_next fall_from_peak rebound_from_trough".split())}, round(step_index / greatest(n_steps - 1, 1), 6) AS step_pos,
 (n_steps - step_index - 1)::BIGINT AS remaining_steps, round(delta_next - delta_prev, 6) + 0.0 AS curvature, (fall_from_peak <= 1e-8)::INT AS is_peak_so_far, (rebound_from_trough <= 1e-8)::INT AS is_trough_so_far FROM s""",
)
def step_features(spark, sf):
    out = T.step_features(levelled_events(spark, sf), KEYS, ORDER, "value").withColumn("centred", F.col("centred") + 1e-9)  # off the ties of rounding
    return rounded(out.drop("user_id", "ts", "value", "event_type", "lvl"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
_TURN_LEVEL = f"CASE WHEN {_WORDS} < 20 THEN 0 WHEN {_WORDS} < 60 THEN 1 ELSE 2 END"


def levelled_turns(spark, sf) -> DataFrame:
    """Turns with a level by their words: below 20 macro, below 60 meso, else micro."""
    from ..functions.text import word_count

    n = word_count(F.col("text"))
    return load_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.when(n < 20, 0).when(n < 60, 1).otherwise(2).alias("lvl"))


def _profile_sql(prefix: str, where: str) -> str:
    shares = ", ".join(f"count(*) FILTER (WHERE lvl = {k}) / count(*) AS {prefix}p{k}" for k in range(3))
    return f"SELECT conv_id, count(*) AS {prefix}n, avg(lvl) AS {prefix}mean, {shares} FROM tl WHERE {where} GROUP BY conv_id"


_TURNS = f"WITH tl AS (SELECT conv_id, turn, role, {_TURN_LEVEL} AS lvl FROM conversations), c AS ({_profile_sql('c_', 'role <> chr(97) || chr(115) || chr(115) || chr(105) || chr(115) || chr(116) || chr(97) || chr(110) || chr(116)')}), r AS ({_profile_sql('r_', 'role = chr(97) || chr(115) || chr(115) || chr(105) || chr(115) || chr(116) || chr(97) || chr(110) || chr(116)')})".replace("chr(97) || chr(115) || chr(115) || chr(105) || chr(115) || chr(116) || chr(97) || chr(110) || chr(116)", "'assistant'")
_E = "1e-10::DOUBLE"
_ALIGN = f"""{_TURNS}, j AS (SELECT *, {', '.join(f'({s}_p{k} + {_E}) / ({s}_p0 + {s}_p1 + {s}_p2 + 3 * {_E}) AS {s}{k}' for s in 'cr' for k in range(3))} FROM c JOIN r USING (conv_id)),
d AS (SELECT *, ({' + '.join(f'c{k} * ln(c{k} / ((c{k} + r{k}) / 2)) + r{k} * ln(r{k} / ((c{k} + r{k}) / 2))' for k in range(3))}) / 2 AS jsd_, {', '.join(f"-({' + '.join(f'{s}{k} * log2({s}{k})' for k in range(3))}) AS {s}div" for s in 'cr')} FROM j)
SELECT conv_id, round(jsd_, 6) + 0.0 AS jsd, round(cdiv, 6) + 0.0 AS context_diversity, round(rdiv, 6) + 0.0 AS reasoning_diversity,
 (list_position([c_p0, c_p1, c_p2], greatest(c_p0, c_p1, c_p2)) = list_position([r_p0, r_p1, r_p2], greatest(r_p0, r_p1, r_p2)))::INT AS dominant_level_match,
 round((abs(c0 - r0) + abs(c1 - r1) + abs(c2 - r2)) / 3, 6) + 0.0 AS soft_mean_gap FROM d"""


@query("q_trace_alignment", _ALIGN)
def trace_alignment(spark, sf):
    turns = levelled_turns(spark, sf)
    context = T.level_profile(turns.where("role <> 'assistant'"), ["conv_id"], "lvl", "c_")
    reasoning = T.level_profile(turns.where("role = 'assistant'"), ["conv_id"], "lvl", "r_")
    return rounded(T.alignment_features(context.join(reasoning, "conv_id")).select("conv_id", "jsd", "context_diversity", "reasoning_diversity", "dominant_level_match", "soft_mean_gap"))


@query("q_alignment_gaps", f"{_TURNS} SELECT conv_id, round(avg(abs(lvl - c_mean)), 6) AS mean_alignment_gap, round(max(abs(lvl - c_mean)), 6) AS max_alignment_gap, round(sum((turn + 1) * abs(lvl - c_mean)) / sum(turn + 1), 6) AS weighted_alignment_gap FROM tl JOIN c USING (conv_id) WHERE role = 'assistant' GROUP BY conv_id")
def alignment_gaps(spark, sf):
    turns = levelled_turns(spark, sf)
    context = T.level_profile(turns.where("role <> 'assistant'"), ["conv_id"], "lvl", "c_").select("conv_id", "c_mean")
    steps = turns.where("role = 'assistant'").join(context, "conv_id").withColumn("weight", (F.col("turn") + 1).cast("double"))
    return rounded(T.gap_features(steps, ["conv_id"], "lvl", "c_mean", "weight"))


@query("q_level_profile", f"{_TURNS} SELECT conv_id, r_n, round(r_mean, 6) AS r_mean, round(r_p0, 6) AS r_p0, round(r_p1, 6) AS r_p1, round(r_p2, 6) AS r_p2 FROM r")
def level_profile(spark, sf):
    return rounded(T.level_profile(levelled_turns(spark, sf).where("role = 'assistant'"), ["conv_id"], "lvl", "r_"))


@query(
    "q_cross_features",
    f"""{_ARR}, x AS (SELECT user_id, xs[1:(n // 2)::INT] AS r, xs[(n // 2)::INT + 1:] AS a FROM a)
SELECT user_id, round(list_avg(a) - list_avg(r), 6) + 0.0 AS answer_minus_reasoning_mean, round(a[1] - r[-1], 6) + 0.0 AS answer_start_minus_reasoning_end, round(a[-1] - r[-1], 6) + 0.0 AS answer_end_minus_reasoning_end,
 round((list_max(a) - list_min(a)) - (list_max(r) - list_min(r)), 6) + 0.0 AS answer_range_minus_reasoning_range FROM x WHERE len(r) > 0""",
)
def cross_features(spark, sf):
    t = traces_of_values(spark, sf).select("user_id", "raw", (F.size("raw") / 2).cast("int").alias("cut"))
    halves = t.where("cut > 0").select("user_id", F.expr("slice(raw, 1, cut)").alias("r"), F.expr("slice(raw, cut + 1, size(raw))").alias("a"))
    return rounded(halves.select("user_id", *(c.alias(n) for n, c in V.cross_features(F.col("r"), F.col("a")).items())))


@query("q_comparison_density", "WITH p AS (SELECT user_id, least(event_type, lead(event_type) OVER w) AS a, greatest(event_type, lead(event_type) OVER w) AS b, lead(event_type) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN any_value(n) >= 2 THEN count(DISTINCT (a, b)) FILTER (WHERE nx IS NOT NULL) / (any_value(n) * (any_value(n) - 1) / 2) END, 6) AS density FROM p JOIN k USING (user_id) GROUP BY user_id")
def comparison_density(spark, sf):
    ahead = levelled_events(spark, sf).select("user_id", "event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy(*ORDER)).alias("next"))
    pairs = ahead.groupBy("user_id").agg(F.collect_set(F.when(F.col("next").isNotNull(), F.array_sort(F.array("event_type", "next")))).alias("pairs"), F.count_distinct("event_type").alias("n"))
    return rounded(pairs.select("user_id", V.comparison_density(F.col("pairs"), F.col("n").cast("double")).alias("density")))


@query("q_jumps_by_outcome", f"WITH j AS ({JUMPS}) SELECT user_id % 3 AS condition, count(*) AS traces, round(avg(jump_rate), 6) AS mean_jump_rate, round(quantile_cont(jump_rate, 0.5), 6) AS median_jump_rate, round(stddev_pop(jump_rate), 6) AS std_jump_rate FROM j GROUP BY 1")
def jumps_by_outcome(spark, sf):
    return rounded(jump_metrics(spark, sf).groupBy(F.pmod("user_id", F.lit(3)).alias("condition")).agg(F.count("*").alias("traces"), F.avg("jump_rate").alias("mean_jump_rate"), F.percentile("jump_rate", 0.5).alias("median_jump_rate"), F.stddev_pop("jump_rate").alias("std_jump_rate")))
