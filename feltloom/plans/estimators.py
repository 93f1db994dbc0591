"""Queries over the estimators, the residual checks and the tournament: F1 to F20, H1 to H4, I1 to I9."""

from __future__ import annotations

from pyspark.sql import functions as F

from feltloom.functions import buckets
from feltloom.functions.stats import correlations, phi_sql
from feltloom.operators import estimators as e
from feltloom.operators import residual, texture, tournament
from feltloom.plans import ledger
from feltloom.plans.base import query
from feltloom.sources import bindings as b

N, V = f"WITH {b.N_SQL}", f"WITH {b.V_SQL}"
P = e.Params()
NP = e.Params(min_train=300, min_test=100)

REALISED_N = """sheet AS (SELECT site, player, count(net_c) FILTER (day <= 18) AS n_train, count(net_c) FILTER (day > 18) AS n_test,
    round(sum(net_c) FILTER (day <= 18)::DOUBLE / count(net_c) FILTER (day <= 18) * 100 / 1000000.0::DOUBLE, 6) AS wr_train, round(sum(net_c) FILTER (day > 18)::DOUBLE / count(net_c) FILTER (day > 18) * 100 / 1000000.0::DOUBLE, 6) AS wr_test
    FROM n GROUP BY ALL)"""
REALISED_V = REALISED_N.replace("net_c", "r_c").replace("1000000.0", "100.0").replace("FROM n ", "FROM v ")


def judged(state: str = "s_core", p: e.Params = P, source: str | None = None, by: str = "") -> str:
    """Decisions with all that they are held against, by windows over the decisions themselves: nothing is aggregated and joined back.

    by: a column, with a comma, that keeps several ways of keying states apart.
    """
    rows = source or f"SELECT v.site, v.player, {state} AS s, a, reward_bb AS r FROM v SEMI JOIN kept USING (site, player) WHERE day <= {p.split_day}"
    of_state, of_action = f"PARTITION BY {by}s", f"PARTITION BY {by}s, a"
    return f"""played AS ({rows}),
    crowd AS (SELECT {by}s, count(*) AS entities FROM (SELECT DISTINCT {by}s, site, player FROM played) GROUP BY ALL HAVING count(*) >= {p.min_eligible}),
    seen AS (SELECT played.*, entities, coalesce(entities, 0) > 0 AS common, count(*) OVER ({of_state}) AS decisions, count(*) OVER ({of_state}, site, player) AS n_state,
                    CASE WHEN entities > 0 THEN avg(r) OVER ({of_action}) END AS action_mean, count(r) OVER ({of_action}) AS action_known, CASE WHEN entities > 0 THEN avg(r) OVER ({of_state}) END AS state_mean,
                    count(*) OVER ({of_action}, site, player) AS n, avg(r) OVER ({of_action}, site, player) AS own_mean, count(r) OVER ({of_action}, site, player) AS own_known
             FROM played LEFT JOIN crowd USING ({by}s)),
    judged AS (SELECT *, avg(coalesce(action_mean, state_mean)) OVER ({of_state}) AS population_value, avg(coalesce(action_mean, state_mean)) OVER ({of_state}, site, player) AS entity_value,
                      decisions::DOUBLE / count(*) FILTER (common) OVER () AS weight, common AND own_known >= {p.nmin_sa} AS like_for_like FROM seen)"""


def chain(state: str = "s_core", p: e.Params = P, head: str = f"{V}, {REALISED_V}") -> str:
    """Judged decisions and the score sheet of the cohort, on V or on what head gives as v and sheet."""
    return f"""{head}, kept AS (SELECT * FROM sheet WHERE n_train >= {p.min_train} AND n_test >= {p.min_test}), {judged(state, p)},
    gains AS (SELECT site, player, sum(weight * (entity_value - population_value) / n_state) FILTER (common AND n_state >= {p.nmin}) AS edge,
                     sum(own_mean - action_mean) FILTER (like_for_like) / count(*) FILTER (common) AS skill, count(*) FILTER (like_for_like)::DOUBLE / count(*) FILTER (common) AS cov,
                     bool_or(common AND n_state >= {p.nmin}) AS aligned, bool_or(like_for_like) AS compared FROM judged GROUP BY ALL),
    scores AS (SELECT kept.*, {", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in ("edge", "skill"))}, round(CASE WHEN compared THEN cov ELSE 0 END, 6) AS cov FROM kept LEFT JOIN gains USING (site, player))"""


def nan(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


def rank_sql(x: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    both = f"PARTITION BY {by + ', ' if by else ''}{x}"
    return f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER ({both}) - 1) / 2.0::DOUBLE)"


def corr_sql(x: str, y: str, source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"SELECT {keys}count(*) AS n, round({nan(f'corr({x}, {y})')}, 6) AS pearson, round({nan('corr(rx, ry)')}, 6) AS spearman FROM (SELECT *, {rank_sql(x, by)} AS rx, {rank_sql(y, by)} AS ry FROM {source}) {group}"


@query("f1_realised_winrate", f"{N}, {REALISED_N} SELECT * FROM sheet")
def _(spark, d):
    return e.realised(b.n(spark, d), NP)


@query("f2_two_sided_cohort", f"{N}, {REALISED_N} SELECT * FROM sheet WHERE n_train >= 300 AND n_test >= 100")
def _(spark, d):
    return e.cohort(e.realised(b.n(spark, d), NP), NP.min_train, NP.min_test)


@query("f3_train_decisions", f"{chain()} SELECT site, player, count(*) AS n, round(sum(r), 4) AS total FROM played GROUP BY ALL")
def _(spark, d):
    v = b.v(spark, d)
    cd = e.train_decisions(v, e.evaluate(v).members, P)
    return cd.groupBy(*P.entity).agg(F.count("*").alias("n"), F.round(F.sum("r_c") / F.lit(100.0), 4).alias("total"))


@query("f4_eligible_states", f"{chain()} SELECT DISTINCT s, entities, decisions FROM judged WHERE common")
def _(spark, d):
    return e.evaluate(b.v(spark, d)).met.select("s", "entities", "decisions")


@query("f5_state_weights", f"{chain()} SELECT DISTINCT s, round(weight, 9) AS weight FROM judged WHERE common")
def _(spark, d):
    return e.evaluate(b.v(spark, d)).met.select("s", F.round("w", 9).alias("weight"))


@query("f6_action_values", f"{chain()} SELECT DISTINCT s, a, round(action_mean, 6) AS action_mean, action_known AS known FROM judged WHERE common AND action_known > 0")
def _(spark, d):
    return e.evaluate(b.v(spark, d)).q.withColumn("action_mean", F.round("action_mean", 6))


@query("f7_state_values", f"{chain()} SELECT DISTINCT s, round(state_mean, 6) AS state_mean FROM judged WHERE state_mean IS NOT NULL")
def _(spark, d):
    return e.evaluate(b.v(spark, d)).state_mean.withColumn("state_mean", F.round("state_mean", 6))


@query("f8_population_policy", f"{chain()} SELECT DISTINCT s, round(population_value, 6) AS population_value FROM judged WHERE common")
def _(spark, d):
    x = e.evaluate(b.v(spark, d))
    return e.population_policy(x.cell, x.met, x.q, x.state_mean).withColumn("population_value", F.round("population_value", 6))


@query("f9_entity_cells", f"{chain()} SELECT DISTINCT site, player, s, a, n, round(own_mean, 6) AS own_mean, own_known AS known, n_state FROM judged")
def _(spark, d):
    cell = e.evaluate(b.v(spark, d)).cell
    totals = cell.groupBy(*P.entity, "s").agg(F.sum("c").alias("n_state"))
    return cell.join(totals, [*P.entity, "s"]).select(*P.entity, "s", "a", F.col("c").alias("n"), F.round(F.col("total") / F.col("known") / 100, 6).alias("own_mean"), "known", "n_state")


@query("f10_entity_policy", f"{chain()} SELECT DISTINCT site, player, s, round(entity_value, 6) AS entity_value, n_state FROM judged")
def _(spark, d):
    x = e.evaluate(b.v(spark, d))
    return e.entity_policy(x.cell, x.q, x.state_mean, P).withColumn("entity_value", F.round("entity_value", 6))


@query("f11_alignment_edge", f"{chain()} SELECT site, player, round(edge, 6) AS edge FROM gains WHERE aligned")
def _(spark, d):
    return e.evaluate(b.v(spark, d)).edge.withColumn("edge", F.round("edge", 6))


@query("f12_like_for_like_skill", f"{chain()} SELECT site, player, round(skill, 6) AS skill, round(cov, 6) AS cov FROM gains WHERE compared")
def _(spark, d):
    return e.evaluate(b.v(spark, d)).skill.withColumns({c: F.round(c, 6) for c in ("skill", "cov")})


@query("f13_score_sheet", f"{chain()} SELECT * FROM scores")
def _(spark, d):
    return e.evaluate(b.v(spark, d)).scores


@query("f14_pearson", f"{N}, {REALISED_N} SELECT round({nan('corr(wr_train, wr_test)')}, 6) AS pearson FROM sheet")
def _(spark, d):
    return correlations(e.realised(b.n(spark, d), NP), "wr_train", "wr_test").select("pearson")


@query("f15_spearman", f"{N}, {REALISED_N}, known AS (SELECT * FROM sheet WHERE wr_train IS NOT NULL AND wr_test IS NOT NULL) {corr_sql('wr_train', 'wr_test', 'known')}")
def _(spark, d):
    return correlations(e.realised(b.n(spark, d), NP), "wr_train", "wr_test")


COMBINED = f"""ra AS (SELECT *, {rank_sql('edge')} AS a_, {rank_sql('skill')} AS b_ FROM scores),
    comb AS (SELECT site, player, n_train, n_test, wr_train, wr_test, edge, skill, cov, round(coalesce((a_ - avg(a_) OVER ()) / nullif(stddev_pop(a_) OVER (), 0), 0) + coalesce((b_ - avg(b_) OVER ()) / nullif(stddev_pop(b_) OVER (), 0), 0), 6) AS combined FROM ra)"""


@query("f16_combined_score", f"{chain()}, {COMBINED} SELECT site, player, combined FROM comb")
def _(spark, d):
    return e.with_combined(e.evaluate(b.v(spark, d)).scores).select(*P.entity, "combined")


@query("f17_subset_correlations", f"{chain()}, st AS (SELECT scores.*, cut FROM scores, (SELECT unnest([20, 25, 28]) AS cut) WHERE n_test >= cut), r AS ({corr_sql('skill', 'wr_test', 'st', 'cut')}) SELECT * FROM r WHERE n >= 50")
def _(spark, d):
    return e.subset_correlations(e.evaluate(b.v(spark, d)).scores, "skill", "wr_test", (20, 25, 28), least=50)


@query(
    "f18_summary",
    f"{chain()}, {COMBINED}, rk AS (SELECT cov, "
    + ", ".join(f"{rank_sql(c)} AS r_{c}" for c in ("wr_train", "wr_test", "edge", "skill", "combined"))
    + " FROM comb) SELECT count(*) AS n_players, "
    + ", ".join(f"round({nan(f'corr(r_{c}, r_wr_test)')}, 6) AS {k}" for c, k in (("wr_train", "ceiling"), ("edge", "edge"), ("skill", "skill"), ("combined", "combined")))
    + ", round(avg(cov), 6) AS mean_cov, (SELECT count(DISTINCT s) FROM judged WHERE common) AS n_states FROM rk",
)
def _(spark, d):
    x = e.evaluate(b.v(spark, d))
    return e.summary(x.scores, x.met)


P19 = e.Params(state="s_fine", split_day=15, nmin=3, nmin_sa=1, min_eligible=10, min_train=25, min_test=25)


@query("f19_other_parameters", f"{chain('s_fine', P19).replace('day <= 18', 'day <= 15').replace('day > 18', 'day > 15')} SELECT * FROM scores")
def _(spark, d):
    return e.evaluate(b.v(spark, d), P19).scores


def ablation_sql(states: dict[str, str]) -> str:
    """The same judgement for several ways of keying states at once; a member without a like-for-like decision scores 0."""
    rows = " UNION ALL ".join(f"SELECT '{k}' AS label, v.site, v.player, {x} AS s, a, reward_bb AS r FROM v SEMI JOIN kept USING (site, player) WHERE day <= {P.split_day} AND {x} IS NOT NULL" for k, x in states.items())
    return f"""{V}, {REALISED_V}, kept AS (SELECT * FROM sheet WHERE n_train >= {P.min_train} AND n_test >= {P.min_test}), {judged(source=rows, by="label, ")},
    gains AS (SELECT label, site, player, sum(own_mean - action_mean) FILTER (like_for_like) / count(*) FILTER (common) AS skill FROM judged GROUP BY ALL),
    labels AS (SELECT label, count(DISTINCT s) AS n_states FROM judged WHERE common GROUP BY ALL),
    every AS (SELECT labels.label, wr_test, round(coalesce(skill, 0), 6) AS skill FROM kept CROSS JOIN labels LEFT JOIN gains ON gains.label = labels.label AND gains.site = kept.site AND gains.player = kept.player),
    r AS ({corr_sql('skill', 'wr_test', 'every', 'label')})
    SELECT * FROM r JOIN labels USING (label)"""


STATES = {"core": "s_core", "fine": "s_fine", "core_x": "s_core || '|X' || (k % 3)", "fine_x": "CASE WHEN k >= 5 THEN s_fine || '|X' || (k % 3) END"}


def _states():
    x = F.concat(F.lit("|X"), (F.col("k") % 3).cast("string"))
    return {"core": F.col("s_core"), "fine": F.col("s_fine"), "core_x": F.concat("s_core", x), "fine_x": F.when(F.col("k") >= 5, F.concat("s_fine", x))}


@query("f20_texture_ablation", ablation_sql(STATES))
def _(spark, d):
    return e.ablation(b.v(spark, d), _states())


# ---------------------------------------------------------------- on replayed hands

# Nets and rewards in millionths of a big blind, so that sums don't depend on their order.
P_REPLAY = e.Params(scale=1000000.0)
REPLAY = f"""{ledger.STATES}, hn AS (SELECT site, player, day, round(round(net_bb, 6) * 1000000)::BIGINT AS net_c FROM hpl), {REALISED_N.replace("FROM n ", "FROM hn ")},
    v AS (SELECT site, player, hand_id, day, a, s_core, s_fine, round(round(reward_bb, 6) * 1000000)::BIGINT / 1000000.0::DOUBLE AS reward_bb FROM s3)"""


REPLAYED = ("site", "player", "hand_id", "day", "a", "s_core", "s_fine", "board", "reward_bb")


def micro(c: str):
    return F.round(F.round(c, 6) * 1000000).cast("bigint")


def replayed(spark, d):
    """Enriched decisions of the replay."""
    return ledger.narrow(spark, d, "replayed", *REPLAYED).withColumn("r_c", micro("reward_bb")).withColumn("reward_bb", F.col("r_c") / F.lit(1000000.0))


def replayed_sheet(spark, d):
    """Winrates from the seats of the replay."""
    return e.realised(ledger.seats(spark, d).withColumn("net_c", micro("net_bb")), P_REPLAY)


@query("f12_skill_of_replay", f"{chain(head=REPLAY)} SELECT site, player, round(skill, 6) AS skill, round(cov, 6) AS cov FROM gains WHERE compared")
def _(spark, d):
    return e.evaluate(replayed(spark, d), P_REPLAY, replayed_sheet(spark, d)).skill.withColumns({c: F.round(c, 6) for c in ("skill", "cov")})


@query("f13_scores_of_replay", f"{chain(head=REPLAY)} SELECT * FROM scores")
def _(spark, d):
    return e.evaluate(replayed(spark, d), P_REPLAY, replayed_sheet(spark, d)).scores


def textured_states():
    key = lambda s: buckets.texture_key(F.col(s), F.col("board"), F.col("wtile"), F.col("dtile"))
    return {"core": F.col("s_core"), "core_texture": key("s_core"), "fine": F.col("s_fine"), "fine_texture": key("s_fine")}


def textured(spark, d):
    return texture.attach(replayed(spark, d), ledger.flop_texture(spark, d))


@query("f20_texture_states")
def _(spark, d):
    """The ablation over flop texture. Dynamicness is sampled, so there is no SQL; tests/test_texture.py holds it against plain Python."""
    return e.ablation(textured(spark, d), textured_states(), P_REPLAY, replayed_sheet(spark, d))


# ---------------------------------------------------------------- residual adequacy

MIN_HANDS = 20
CO_H = f"mem AS (SELECT site, player FROM v GROUP BY ALL HAVING count(DISTINCT hand_id) >= {MIN_HANDS}), h AS (SELECT v.* FROM v SEMI JOIN mem USING (site, player))"


def eta_sql(states: dict[str, str], value: str) -> str:
    stack = " UNION ALL ".join(f"SELECT {i} AS i, '{k}' AS label, {x} AS key, ({value})::DOUBLE AS x FROM h WHERE {x} IS NOT NULL" for i, (k, x) in enumerate(states.items()))
    return f"""st AS ({stack}), g AS (SELECT i, label, key, count(*) AS n, avg(x) AS m FROM st GROUP BY ALL), t AS (SELECT i, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM st GROUP BY ALL),
    r AS (SELECT i, label, count(*) AS n_groups, max(t.n) AS n, round(sum(g.n * (g.m - t.m) * (g.m - t.m)) / (max(t.v) * max(t.n)), 6) AS eta2 FROM g JOIN t USING (i) GROUP BY ALL)
    SELECT label, n_groups, n, eta2, round(eta2 - lag(eta2) OVER (ORDER BY i), 6) AS gain FROM r"""


@query("h1_hands_cohort", f"{V}, {CO_H} SELECT site, player, count(*) AS n FROM h GROUP BY ALL")
def _(spark, d):
    return residual.cohort(b.v(spark, d), MIN_HANDS).groupBy("site", "player").agg(F.count("*").alias("n"))


@query("h2_eta_squared", f"{V}, {CO_H}, {eta_sql({'core': 's_core'}, 'reward_bb')}")
def _(spark, d):
    return residual.explained(residual.cohort(b.v(spark, d), MIN_HANDS), {"core": F.col("s_core")}, F.col("reward_bb"))


@query("h3_eta_squared_of_action", f"{V}, {CO_H}, {eta_sql({'core': 's_core', 'fine': 's_fine'}, chr(40) + 'a = ' + chr(39) + 'click' + chr(39) + chr(41) + '::INT')}")
def _(spark, d):
    return residual.explained(residual.cohort(b.v(spark, d), MIN_HANDS), {"core": F.col("s_core"), "fine": F.col("s_fine")}, (F.col("a") == "click").cast("int"))


@query("h4_incremental_eta_squared", f"{V}, {CO_H}, {eta_sql(STATES, 'reward_bb')}")
def _(spark, d):
    return residual.explained(residual.cohort(b.v(spark, d), MIN_HANDS), _states(), F.col("reward_bb"))


@query("h4_texture_eta_squared")
def _(spark, d):
    """What texture adds to the states, for rewards and for folding; no SQL, as in f20_texture_states."""
    rows = residual.cohort(textured(spark, d), MIN_HANDS)
    values = {"reward": F.col("reward_bb"), "fold": (F.col("a") == "f").cast("int")}
    out = [residual.explained(rows, textured_states(), x).withColumn("value", F.lit(k)) for k, x in values.items()]
    return out[0].union(out[1])


# ---------------------------------------------------------------- tournament

MIN = 300
RATES = f"""rates AS (SELECT *, bb100 - 1.96::DOUBLE * se AS lo, bb100 + 1.96::DOUBLE * se AS hi FROM (SELECT site, player, count(*) AS n_hands, avg(net_bb) AS m, stddev_samp(net_bb) AS sd, avg(net_bb) * 100 AS bb100,
    stddev_samp(net_bb) / sqrt(count(*)) * 100 AS se FROM n GROUP BY ALL HAVING count(*) >= {MIN}))"""
ROUNDED = "site, player, n_hands, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("m", "sd", "bb100", "se", "lo", "hi"))


def _rates(spark, d):
    return tournament.winrates(b.n(spark, d), MIN)


@query("i1_winrates", f"{N}, {RATES} SELECT site, player, n_hands, round(m, 6) AS m, round(sd, 6) AS sd FROM rates")
def _(spark, d):
    return tournament.rounded(_rates(spark, d).select("site", "player", "n_hands", "m", "sd"))


@query("i2_confidence_intervals", f"{N}, {RATES} SELECT {ROUNDED} FROM rates")
def _(spark, d):
    return tournament.rounded(_rates(spark, d))


@query("i3_resolvable", f"{N}, {RATES} SELECT count(*) AS players, count(*) FILTER (lo > 0) AS winning, count(*) FILTER (hi < 0) AS losing, count(*) FILTER (lo <= 0 AND hi >= 0) AS neither FROM rates")
def _(spark, d):
    return tournament.resolvable(_rates(spark, d))


@query("i4_spread", f"{N}, {RATES} SELECT round(quantile_cont(bb100, 0.05), 6) AS p5, round(quantile_cont(bb100, 0.5), 6) AS median, round(quantile_cont(bb100, 0.95), 6) AS p95, round(median((hi - lo) / 2), 6) AS half_width, round(median(n_hands), 6) AS median_hands FROM rates")
def _(spark, d):
    return tournament.spread(_rates(spark, d))


@query("i5_leaderboard", f"{N}, {RATES} SELECT {ROUNDED}, 'top' AS part FROM (SELECT * FROM rates ORDER BY bb100 DESC, site, player LIMIT 12) UNION ALL SELECT {ROUNDED}, 'bottom' AS part FROM (SELECT * FROM rates ORDER BY bb100, site, player LIMIT 6)")
def _(spark, d):
    return tournament.rounded(tournament.leaderboard(_rates(spark, d)))


@query(
    "i6_head_to_head",
    f"{N}, {RATES}, best AS (SELECT site || '|' || player AS p, bb100, se FROM rates ORDER BY bb100 DESC, site, player LIMIT 6) SELECT a.p AS a_p, b.p AS b_p, round({phi_sql('((a.bb100 - b.bb100) / sqrt(a.se * a.se + b.se * b.se))')}, 6) AS p_a FROM best a, best b WHERE a.p <> b.p",
)
def _(spark, d):
    return tournament.head_to_head(_rates(spark, d))


MATCHED = f"""lv AS (SELECT nl_level, count(*)::DOUBLE / (SELECT count(*) FROM n) AS w FROM n GROUP BY ALL), pl AS (SELECT site, player, nl_level, avg(net_bb) AS m, count(*) AS n FROM n GROUP BY ALL),
    mt AS (SELECT site, player, sum(w * m) / sum(w) * 100 AS matched, sum(n)::BIGINT AS n_hands FROM pl JOIN lv USING (nl_level) GROUP BY ALL HAVING sum(n) >= {MIN})"""


@query("i7_stakes_matched", f"{N}, {MATCHED} SELECT site, player, round(matched, 6) AS matched, n_hands FROM mt")
def _(spark, d):
    return tournament.stakes_matched(b.n(spark, d), MIN).withColumn("matched", F.round("matched", 6))


@query("i8_rank_agreement", f"{N}, {RATES}, {MATCHED}, bo AS (SELECT site, player, round(bb100, 9) AS bb100, round(matched, 9) AS matched FROM rates JOIN mt USING (site, player)) {corr_sql('bb100', 'matched', 'bo')}")
def _(spark, d):
    return tournament.agreement(b.n(spark, d), MIN)


@query("i9_generalisation", f"{N}, {REALISED_N}, st AS (SELECT sheet.*, cut FROM sheet, (SELECT unnest([100, 150, 170]) AS cut) WHERE n_train >= 300 AND n_test >= cut), r AS ({corr_sql('wr_train', 'wr_test', 'st', 'cut')}) SELECT * FROM r WHERE n >= 20")
def _(spark, d):
    return e.subset_correlations(e.cohort(e.realised(b.n(spark, d), NP), 300, 100), "wr_train", "wr_test", (100, 150, 170), least=20)
