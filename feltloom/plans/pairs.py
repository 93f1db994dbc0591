"""Queries over pairwise evaluation, range features and reliability: J1 to J14, K1 to K9, L1 to L15."""

from __future__ import annotations

from pyspark.sql import functions as F

from feltloom.functions import buckets
from feltloom.operators import pairs, ranges, reliability
from feltloom.plans import ledger, ledger_sql
from feltloom.plans.base import query
from feltloom.plans.estimators import corr_sql, nan
from feltloom.sources import bindings as b
from feltloom.sources.scratch import folder

N, M, NM = f"WITH {b.N_SQL}", f"WITH {b.M_SQL}", f"WITH {b.N_SQL}, {b.M_SQL}"
NMIN, MIN_HANDS = 10, 10


def r6(c):
    """Six digits; rates of whole cents over 8 or 16 hands lie half way between two often, so they are lifted off first."""
    return F.round(F.col(c) + 1e-9, 6)


MET = "met AS (SELECT p.*, o.player AS opponent FROM n p JOIN n o ON p.hand_id = o.hand_id AND p.player <> o.player)"
ACTUAL = f"{MET}, act AS (SELECT player, opponent, count(*) AS n_hands, sum(net_c)::DOUBLE / count(net_c) / 10000.0 AS actual FROM met GROUP BY ALL)"


def policy_sql(nmin: int = NMIN, weight: str = "count(*)::DOUBLE", action: str = "a") -> str:
    return f"""qv AS (SELECT s_core AS s, {action} AS a, sum(r_c)::DOUBLE / count(*) / 100.0 AS q, count(*) AS n FROM m GROUP BY ALL),
    sup AS (SELECT player, s_core AS s, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= {nmin}),
    pol AS (SELECT player, s_core AS s, {action} AS a, count(*)::DOUBLE / any_value(sup.n) AS p FROM m JOIN sup USING (player) WHERE m.s_core = sup.s GROUP BY ALL),
    wt AS (SELECT s_core AS s, {weight} AS w FROM m GROUP BY ALL)"""


# The value of each side in each common state, by a correlated subquery as it is defined.
LATERAL = f"""pr AS (SELECT player, opponent, n_hands, actual FROM act WHERE n_hands >= {MIN_HANDS}),
    val AS (SELECT player, s, sum(p * q) AS v FROM pol JOIN qv USING (s, a) GROUP BY ALL),
    com AS (SELECT pr.player, pr.opponent, x.s, w / sum(w) OVER (PARTITION BY pr.player, pr.opponent) AS w FROM pr JOIN sup x ON x.player = pr.player JOIN sup y ON y.player = pr.opponent AND y.s = x.s JOIN wt ON wt.s = x.s),
    sc AS (SELECT player, opponent, sum(com.w * (coalesce(v1.v, 0) - coalesce(v2.v, 0))) * 100 AS score, count(*) AS n_states FROM com LEFT JOIN val v1 USING (player, s) LEFT JOIN val v2 ON v2.player = com.opponent AND v2.s = com.s GROUP BY ALL)"""
SCORED = f"{NM}, {ACTUAL}, {policy_sql()}, {LATERAL}, ev AS (SELECT pr.*, sc.score, sc.n_states FROM pr JOIN sc USING (player, opponent))"


def _scored(spark, d, **how):
    return pairs.evaluated(b.n(spark, d), b.m(spark, d), NMIN, MIN_HANDS, **how)


@query("j1_opponent_self_join", f"{N}, {MET} SELECT player, opponent, hand_id, net_c FROM met")
def _(spark, d):
    return pairs.meetings(b.n(spark, d)).select("player", "opponent", "hand_id", "net_c")


@query("j2_pair_actual", f"{N}, {ACTUAL} SELECT player, opponent, n_hands, round(actual + 1e-9, 6) AS actual FROM act")
def _(spark, d):
    return pairs.actual(b.n(spark, d)).withColumn("actual", r6("actual"))


@query("j3_continuation_value", f"{M}, {policy_sql()} SELECT s, a, round(q, 6) AS q, n FROM qv")
def _(spark, d):
    return pairs.continuation(b.m(spark, d)).withColumn("q", F.round("q", 6))


@query("j4_supported_states", f"{M}, {policy_sql()} SELECT * FROM sup")
def _(spark, d):
    return pairs.supported(b.m(spark, d), NMIN)


@query("j5_policies", f"{M}, {policy_sql()} SELECT player, s, a, round(p, 9) AS p FROM pol")
def _(spark, d):
    return pairs.policies(b.m(spark, d), NMIN).withColumn("p", F.round("p", 9))


@query("j6_state_weights", f"{M}, {policy_sql()} SELECT s, w, 1.0::DOUBLE AS w_uniform FROM wt")
def _(spark, d):
    m = b.m(spark, d)
    return pairs.state_weights(m).join(pairs.state_weights(m, uniform=True).withColumnRenamed("w", "w_uniform"), "s")


@query("j7_common_states", f"{NM}, {ACTUAL}, {policy_sql()}, {LATERAL} SELECT player, opponent, count(*) AS n_states, round(sum(w), 6) AS total, round(max(w), 9) AS heaviest FROM com GROUP BY ALL")
def _(spark, d):
    n, m = b.n(spark, d), b.m(spark, d)
    common = pairs.common_states(pairs.actual(n).where(F.col("n_hands") >= MIN_HANDS), m, NMIN)
    return common.groupBy("player", "opponent").agg(F.count("*").alias("n_states"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 9).alias("heaviest"))


@query("j8_pair_value_difference", f"{SCORED} SELECT player, opponent, n_hands, round(actual + 1e-9, 6) AS actual, round(score, 4) AS score, n_states FROM ev")
def _(spark, d):
    return _scored(spark, d).withColumns({"actual": r6("actual"), "score": F.round("score", 4)})


@query("j9_score_agreement", f"{SCORED}, r AS (SELECT round(score, 9) AS score, round(actual, 9) AS actual FROM ev) {corr_sql('score', 'actual', 'r')}")
def _(spark, d):
    return pairs.agreement(_scored(spark, d))


STRICT = 16
LATERAL_SQL = f"""{NM}, {ACTUAL}, {policy_sql(STRICT)}, pr AS (SELECT player, opponent, n_hands, actual FROM act WHERE n_hands >= {MIN_HANDS}),
    val AS (SELECT player, s, sum(p * q) AS v FROM pol JOIN qv USING (s, a) GROUP BY ALL),
    com AS (SELECT pr.player, pr.opponent, wt.w, x.v AS v1, y.v AS v2 FROM pr JOIN val x ON x.player = pr.player JOIN val y ON y.player = pr.opponent AND y.s = x.s JOIN wt ON wt.s = x.s),
    sc AS (SELECT player, opponent, sum(w * (v1 - v2)) / sum(w) * 100 AS score, count(*) AS n_states FROM com GROUP BY ALL)
    SELECT player, opponent, n_hands, round(pr.actual + 1e-9, 6) AS actual, round(sc.score, 4) AS score, sc.n_states FROM pr LEFT JOIN sc USING (player, opponent)"""


@query("j10_unsupported_pairs_kept", LATERAL_SQL)
def _(spark, d):
    out = pairs.evaluated(b.n(spark, d), b.m(spark, d), STRICT, MIN_HANDS, keep_unsupported=True)
    return out.withColumns({"actual": r6("actual"), "score": F.round("score", 4)})


GRID = [("s_core", 10, "a"), ("s_core", 12, "a"), ("s_core", 10, "a_base")]


def _sweep_sql() -> str:
    parts = []
    for i, (_, nmin, action) in enumerate(GRID):
        col = "a" if action == "a" else "left(a, 1)"
        body = f"{policy_sql(nmin, action=col)}, {LATERAL}, r AS (SELECT round(sc.score, 9) AS score, round(pr.actual, 9) AS actual FROM pr JOIN sc USING (player, opponent)), z AS ({corr_sql('score', 'actual', 'r')})"
        parts.append(f"z{i} AS (WITH {body} SELECT 's_core' AS state, {nmin}::INTEGER AS nmin, '{action}' AS action, n, pearson, spearman FROM z)")
    return f"{NM}, {ACTUAL}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM z{i}" for i in range(len(GRID)))


@query("j11_sensitivity_sweep", _sweep_sql())
def _(spark, d):
    m = b.m(spark, d).withColumn("a_base", F.substring("a", 1, 1))
    return pairs.sweep(b.n(spark, d), m, GRID, MIN_HANDS)


OPP = "opp AS (SELECT DISTINCT hand_id, player AS opponent FROM n), mo AS (SELECT m.*, opp.opponent FROM m JOIN opp ON m.hand_id = opp.hand_id AND m.player <> opp.opponent)"


@query("j12_opponent_actions", f"{NM}, {OPP} SELECT player, opponent, s_core AS s, a, count(*) AS c FROM mo GROUP BY ALL")
def _(spark, d):
    return pairs.opponent_actions(b.n(spark, d), b.m(spark, d))


@query(
    "j13_action_sizes",
    f"{NM}, {OPP}, e AS (SELECT player, opponent, s_core AS s, a, size, count(*) AS c FROM mo WHERE a LIKE 'A%' OR a LIKE 'R%' GROUP BY ALL) SELECT player, opponent, s, a, string_agg(size::BIGINT || 'x' || c, ',' ORDER BY size) AS sizes, sum(c)::BIGINT AS n FROM e GROUP BY ALL",
)
def _(spark, d):
    out = pairs.sizes(b.n(spark, d), b.m(spark, d), ("A", "R"))
    shown = F.transform("sizes", lambda x: F.concat(x["size"].cast("bigint").cast("string"), F.lit("x"), x.c.cast("string")))
    return out.withColumn("sizes", F.array_join(shown, ","))


@query("j13_sketched_sizes")
def _(spark, d):
    """Quantiles of the same distributions from bounded sketches: within their error, so without SQL; tests/test_pairs.py holds them against exact ranks."""
    return pairs.size_quantiles(pairs.size_sketches(b.n(spark, d), b.m(spark, d), ("A", "R")), {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("j14_population_actions", f"{NM}, {OPP} SELECT s_core AS s, a, count(*) AS c FROM mo GROUP BY ALL")
def _(spark, d):
    return pairs.population_actions(pairs.opponent_actions(b.n(spark, d), b.m(spark, d)))


# ---------------------------------------------------------------- range features

# Replayed decisions with known hole cards, in tenths of a hand score; ctx is all that is public before the board.
TENTHS = "CASE hero_hand_bucket " + " ".join(f"WHEN '{k}' THEN {round(10 * v)}" for k, v in buckets.HAND_SCORES.items()) + " ELSE 5 END"
PUBLIC = " || '|' || ".join(ranges.PUBLIC)
K = f"{ledger.STATES}, rs AS (SELECT *, {PUBLIC} AS ctx, hero_hole_class AS hole_class, {TENTHS} AS tenths, hero_hand_bucket IN {buckets.STRONG} AS strong, {ledger.DYN} AS proxy FROM s3), src AS (SELECT * FROM rs WHERE hole_class IS NOT NULL)"
BY_CLASS = "by_class AS (SELECT ctx, board, hole_class, any_value(proxy) AS proxy, count(*) AS n, count(*) FILTER (strong) AS n_strong, round(sum(tenths)::DOUBLE / count(*) / 10, 9) AS hv FROM src GROUP BY ALL)"
STOOD = """stood AS (SELECT *, sum(n) OVER (same ORDER BY hv RANGE UNBOUNDED PRECEDING) AS no_better, sum(n) OVER same AS hands, sum(n_strong) OVER same AS strong_hands, stddev_pop(hv) OVER same AS deviation FROM by_class WINDOW same AS (PARTITION BY ctx, board)),
    figures AS (SELECT ctx, board, hole_class, round(no_better::DOUBLE / hands, 9) AS h_pct, round(strong_hands::DOUBLE / hands, 9) AS wetness, round(coalesce(deviation, 0) / 8 + proxy, 9) AS dynamicness FROM stood)"""


def cut_sql(c: str, share: float) -> str:
    """The value at that share of the ordered values, between two of them by their distance."""
    at = f"{share} * (count(*) - 1)"
    lower, upper = (f"list({c} ORDER BY {c})[({f}({at}) + 1)::BIGINT]" for f in ("floor", "ceil"))
    return f"round({lower} + ({upper} - {lower}) * ({at} - floor({at})), 9)"


NAMED = {"h": "h_pct", "w": "wetness", "d": "dynamicness"}
CUTS = "cuts AS (SELECT " + ", ".join(f"{cut_sql(c, x)} AS {k}{i}" for k, c in NAMED.items() for i, x in ((1, 0.333), (2, 0.667))) + " FROM figures)"
BINNED = "binned AS (SELECT ctx, board, hole_class, h_pct, wetness, dynamicness, " + ", ".join(f"(['low', 'mid', 'high'])[1 + ({c} > {k}1)::INT + ({c} > {k}2)::INT] AS {k}_bin" for k, c in NAMED.items()) + " FROM figures, cuts)"
ALL = f"{K}, {BY_CLASS}, {STOOD}, {CUTS}, {BINNED}"


def _source(spark, d):
    rows = ledger.narrow(spark, d, "ranges", *ranges.PUBLIC, "board", "hero_hole_class", "hero_hand_bucket", "board_bucket", "s_fine")
    return ranges.source(ranges.keyed(rows))


@query("k1_range_source", f"{K} SELECT ctx, count(*) AS n, sum(tenths)::BIGINT AS hv, count(*) FILTER (strong) AS strong FROM src GROUP BY ALL")
def _(spark, d):
    return _source(spark, d).where("hole_class IS NOT NULL").groupBy("ctx").agg(F.count("*").alias("n"), F.sum("hv").alias("hv"), F.sum("strong").alias("strong"))


@query("k2_class_distribution", f"{K}, {BY_CLASS} SELECT ctx, board, hole_class, hv, n_strong, n, round(n_strong::DOUBLE / n, 9) AS strong_rate FROM by_class")
def _(spark, d):
    return ranges.distribution(_source(spark, d)).withColumn("strong_rate", F.round("strong_rate", 9))


@query("k3_context_wetness", f"{K}, {BY_CLASS}, {STOOD} SELECT DISTINCT ctx, board, hands::BIGINT AS total_n, round(strong_hands::DOUBLE / hands, 9) AS wetness, round(deviation / 8, 9) AS dispersion FROM stood")
def _(spark, d):
    return ranges.contexts(ranges.distribution(_source(spark, d))).withColumns({c: F.round(c, 9) for c in ("wetness", "dispersion")})


@query("k4_board_metadata", f"{K} SELECT DISTINCT ctx, board, board_bucket, street FROM src")
def _(spark, d):
    return ranges.board_meta(_source(spark, d))


@query("k5_weighted_percentile", f"{ALL} SELECT ctx, board, hole_class, h_pct FROM binned")
def _(spark, d):
    return ranges.percentiles(ranges.distribution(_source(spark, d))).select("ctx", "board", "hole_class", F.round("h_pct", 9).alias("h_pct"))


@query("k6_dynamicness", f"{ALL} SELECT ctx, board, hole_class, dynamicness FROM binned")
def _(spark, d):
    return ranges.features(_source(spark, d)).select("ctx", "board", "hole_class", "dynamicness")


@query("k7_tercile_bins", f"{ALL} SELECT * FROM binned")
def _(spark, d):
    return ranges.features(_source(spark, d))


@query(
    "k8_attached_bins",
    f"{ALL} SELECT s_fine || '|Hq=' || coalesce(h_bin, 'mid') || '|W=' || coalesce(w_bin, 'mid') || '|D=' || coalesce(d_bin, 'mid') AS s_range, count(*) AS n FROM rs LEFT JOIN binned USING (ctx, board, hole_class) GROUP BY ALL",
)
def _(spark, d):
    rows = _source(spark, d)
    return ranges.attach(rows, ranges.features(rows)).groupBy("s_range").agg(F.count("*").alias("n"))


@query("k9_feature_summary", f"{ALL} SELECT count(*) AS n, round({nan('corr(wetness, dynamicness)')}, 6) AS corr_wd FROM binned")
def _(spark, d):
    return ranges.summary(ranges.features(_source(spark, d)))


# ---------------------------------------------------------------- reliability

HALF = "(ascii(substr(md5(site || ':' || hand_id), 32, 1)) % 2)::INTEGER"
SPLIT = f"""ns AS (SELECT *, {HALF} AS split FROM n), {MET}, ms AS (SELECT *, {HALF} AS split FROM met),
    mom AS (SELECT 'player' AS kind, player, NULL::VARCHAR AS opponent, split, count(*) AS n, sum(net_c)::BIGINT AS s, sum(net_c::HUGEINT * net_c)::DOUBLE AS ss FROM ns GROUP BY ALL
            UNION ALL SELECT 'pair', player, opponent, split, count(*), sum(net_c)::BIGINT, sum(net_c::HUGEINT * net_c)::DOUBLE FROM ms GROUP BY ALL),
    mm AS (SELECT *, round(s::DOUBLE / n / 10000.0, 9) AS bb FROM mom),
    hv AS (SELECT a.kind, a.player, a.opponent, a.bb AS bb_0, a.n AS n_0, b.bb AS bb_1, b.n AS n_1 FROM mm a JOIN mm b ON a.kind = b.kind AND a.player = b.player AND a.opponent IS NOT DISTINCT FROM b.opponent AND a.split = 0 AND b.split = 1)"""


def _moments(spark, d):
    return reliability.split_moments(b.n(spark, d))


@query("l1_half_split", f"{N} SELECT {HALF} AS half, count(*) AS n, count(DISTINCT hand_id) AS hands FROM n GROUP BY ALL")
def _(spark, d):
    rows = b.n(spark, d).withColumn("half", reliability.half(F.concat_ws(":", "site", "hand_id")))
    return rows.groupBy("half").agg(F.count("*").alias("n"), F.countDistinct("hand_id").alias("hands"))


@query("l2_half_split_by_hand", f"{N} SELECT hand_id, (ascii(substr(md5(hand_id), 32, 1)) % 2)::INTEGER AS half FROM n GROUP BY ALL")
def _(spark, d):
    return b.n(spark, d).select("hand_id").distinct().select("hand_id", reliability.half(F.col("hand_id")).alias("half"))


@query("l3_split_moments", f"{N}, {SPLIT} SELECT kind, player, opponent, split, n, s, ss FROM mom")
def _(spark, d):
    return _moments(spark, d)


@query("l3_merged_shards", f"{N}, {SPLIT} SELECT kind, player, opponent, split, n, s, ss FROM mom")
def _(spark, d):
    """A state a day, kept in two batches, the first of them written twice; their merge is what one run gives."""
    rows, path = b.n(spark, d), folder(spark, "moments")
    for days in ("day <= 13", "day > 13", "day <= 13"):
        reliability.keep_state(rows.where(days), path, "day")
    return reliability.merged(spark.read.parquet(path))


VAR = "(CASE WHEN n > 1 THEN greatest(0, (ss / 1000000.0 / 1000000.0 - n * (s::DOUBLE / n / 1000000.0) * (s::DOUBLE / n / 1000000.0)) / (n - 1)) ELSE 0 END)"


@query("l4_standard_errors", f"{N}, {SPLIT} SELECT kind, player, opponent, split, n, round(s::DOUBLE / n / 1000000.0 * 100 + 1e-9, 6) AS bb100, round(sqrt({VAR} / n) * 100, 4) AS se FROM mom")
def _(spark, d):
    return reliability.with_errors(_moments(spark, d)).withColumns({"bb100": r6("bb100"), "se": F.round("se", 4)})


@query(
    "l5_split_half_correlations",
    f"{N}, {SPLIT}, z AS (SELECT kind, bb_0, bb_1 FROM hv), r AS ({corr_sql('bb_0', 'bb_1', 'z', 'kind')}) SELECT * FROM r",
)
def _(spark, d):
    return reliability.split_summary(_moments(spark, d))


@query("l6_pair_rollup", f"{N}, {SPLIT} SELECT player, opponent, sum(n)::BIGINT AS hands, round(avg(bb), 6) AS bb100 FROM mm WHERE kind = 'pair' GROUP BY ALL ORDER BY hands DESC, player, opponent LIMIT 40")
def _(spark, d):
    return reliability.pair_rollup(_moments(spark, d))


@query("l7_counters", f"{N} SELECT count(DISTINCT site || nl_level) AS files, count(DISTINCT hand_id) AS hands, count(*) AS entries FROM n")
def _(spark, d):
    return reliability.counters(b.n(spark, d), F.struct("site", "nl_level"))


@query(
    "l8_integrity",
    f"{ledger_sql.ALL} SELECT (SELECT count(DISTINCT hand_id) FROM hpl) AS hands, (SELECT count(*) FROM hpl) AS n_rows, (SELECT round(avg(saw_hole::INT), 6) FROM hpl) AS hole_coverage, "
    "(SELECT round(max(abs(s)), 6) FROM (SELECT sum(net_bb) AS s FROM hpl GROUP BY hand_id)) AS max_abs_sum, (SELECT count(*) FROM dec) AS decisions",
)
def _(spark, d):
    return reliability.integrity(ledger.decisions(spark, d, "seq"), ledger.seats(spark, d))


@query("l9_net_sources_of_decisions", f"{NM} SELECT coalesce(net_source, 'unknown') AS net_source, count(*) AS n FROM m LEFT JOIN (SELECT hand_id, player, net_source FROM n) USING (hand_id, player) GROUP BY ALL")
def _(spark, d):
    known = b.n(spark, d).select("hand_id", "player", "net_source")
    joined = b.m(spark, d).join(known, ["hand_id", "player"], "left").withColumn("net_source", F.coalesce("net_source", F.lit("unknown")))
    return joined.groupBy("net_source").agg(F.count("*").alias("n"))


@query("l10_pair_target", f"{N}, {MET} SELECT player, opponent, count(*) AS n, round(avg(net_bb) * 100 + 1e-9, 6) AS bb100, round(stddev_samp(net_bb) / sqrt(count(*)) * 100, 6) AS se, round(avg(net_bb) / nullif(stddev_samp(net_bb) / sqrt(count(*)), 0), 6) AS z FROM met GROUP BY ALL")
def _(spark, d):
    return reliability.pair_target(b.n(spark, d)).withColumns({"bb100": r6("bb100"), "se": F.round("se", 6), "z": F.round("z", 6)})


@query("l11_player_halves", f"{N}, {SPLIT} SELECT player, bb_0, n_0, bb_1, n_1 FROM hv WHERE kind = 'player'")
def _(spark, d):
    return reliability.halves(_moments(spark, d).where("kind = 'player'"), ("player",))


UNORDERED = """un AS (SELECT least(player, opponent) AS p1, greatest(player, opponent) AS p2, split, count(*) AS n, round(sum(CASE WHEN player < opponent THEN net_c ELSE -net_c END)::DOUBLE / count(*) / 10000.0, 9) AS bb FROM ms GROUP BY ALL)
    SELECT a.p1, a.p2, a.bb AS bb_0, a.n AS n_0, b.bb AS bb_1, b.n AS n_1 FROM un a JOIN un b ON a.p1 = b.p1 AND a.p2 = b.p2 AND a.split = 0 AND b.split = 1"""


@query("l12_unordered_pair_halves", f"{N}, {SPLIT}, {UNORDERED}")
def _(spark, d):
    return reliability.unordered_split(b.n(spark, d))


@query("l13_action_table", f"{M} SELECT a, count(*) AS n, round(avg(reward_bb), 6) AS mean, round(stddev_samp(reward_bb), 6) AS sd FROM m GROUP BY ALL")
def _(spark, d):
    return reliability.action_table(b.m(spark, d))


RESIDUAL = """q AS (SELECT s_core, a, sum(r_c)::DOUBLE / count(*) / 100.0 AS q FROM m GROUP BY ALL HAVING count(*) >= 10), rs AS (SELECT player, round(avg(reward_bb - q), 6) AS residual FROM m JOIN q USING (s_core, a) GROUP BY ALL),
    ra AS (SELECT player, round(sum(net_c)::DOUBLE / count(net_c) / 10000.0, 6) AS actual FROM n GROUP BY ALL), rr AS (SELECT * FROM rs JOIN ra USING (player))"""


@query("l14_residual_score", f"{NM}, {RESIDUAL} SELECT * FROM rr")
def _(spark, d):
    return reliability.residual_scores(b.m(spark, d), b.n(spark, d))


@query("l15_ranked_names", f"{NM}, {RESIDUAL} SELECT row_number() OVER (ORDER BY residual DESC, player) AS rank, player FROM rr")
def _(spark, d):
    return reliability.ranked_names(reliability.residual_scores(b.m(spark, d), b.n(spark, d)))
