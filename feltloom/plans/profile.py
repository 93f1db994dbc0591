"""Queries over the profiling operators: D1 to D13, E1 to E6."""

from __future__ import annotations

from feltloom.operators import profile, support
from feltloom.plans import ledger, ledger_sql
from feltloom.plans.base import query
from feltloom.sources import bindings as b

N, V = f"WITH {b.N_SQL}", f"WITH {b.V_SQL}"
CUTS = (300, 500, 600, 700)
EVENT_CUTS = (50, 60, 70, 80)
GRID_N, GRID_X = (3, 5, 10), (0.1, 0.2, 0.3, 0.5)


@query("d1_totals", f"{N}, {b.V_SQL} SELECT (SELECT count(*) FROM v) AS n_decisions, (SELECT count(*) FROM n) AS n_rows")
def _(spark, d):
    return profile.totals(b.v(spark, d), b.n(spark, d))


@query("d2_distinct_hands", f"{N} SELECT count(DISTINCT site || '|' || hand_id) AS n_hands FROM n")
def _(spark, d):
    return profile.distinct_hands(b.n(spark, d))


@query("d3_volume_by_level", f"{N} SELECT site, nl_level, count(*) AS n, count(DISTINCT site || '|' || player) AS n_players FROM n GROUP BY ALL ORDER BY n DESC, site, nl_level LIMIT 40")
def _(spark, d):
    return profile.volume(b.n(spark, d), ("site", "nl_level"), 40)


@query("d4_volume_by_site", f"{N} SELECT site, count(*) AS n, count(DISTINCT player) AS n_players FROM n GROUP BY ALL")
def _(spark, d):
    return profile.volume(b.n(spark, d), ("site",))


COUNTS = "pc AS (SELECT site, player, count(*) AS hands, count(*) FILTER (vpip) AS vpip_hands, count(*) FILTER (reached_showdown) AS showdowns, count(*) FILTER (reached_showdown AND saw_hole) AS shown FROM n GROUP BY ALL)"


@query("d5_entity_counts", f"{N}, {COUNTS} SELECT * FROM pc")
def _(spark, d):
    return profile.entity_counts(b.n(spark, d))


def quantiles_sql(x: str, source: str) -> str:
    ps = ", ".join(f"round(quantile_cont({x}, {p}), 6) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.99))
    return f"SELECT min({x}) AS min, {ps}, max({x}) AS max, round(avg({x}), 6) AS mean FROM {source}"


@query("d6_hands_quantiles", f"{N}, {COUNTS} {quantiles_sql('hands', 'pc')}")
def _(spark, d):
    return profile.quantiles(profile.entity_counts(b.n(spark, d)), "hands")


@query("d6_sketched_quantiles")
def _(spark, d):
    """The same from a sketch a site: within the sketch's error, so without SQL; tests/test_pairs.py holds sketches against exact ranks."""
    return profile.sketched_quantiles(profile.value_sketch(profile.entity_counts(b.n(spark, d)), "hands", ("site",)))


@query("d7_hands_thresholds", f"{N}, {COUNTS} SELECT " + ", ".join(f"count(*) FILTER (hands >= {c}) AS ge_{c}" for c in CUTS) + " FROM pc")
def _(spark, d):
    return profile.at_least(profile.entity_counts(b.n(spark, d)), "hands", CUTS)


@query("d8_volume_share", f"{N}, {COUNTS} SELECT " + ", ".join(f"round(sum(CASE WHEN hands >= {c} THEN hands ELSE 0 END)::DOUBLE / sum(hands), 6) AS share_{c}" for c in CUTS) + " FROM pc")
def _(spark, d):
    return profile.volume_share(profile.entity_counts(b.n(spark, d)), "hands", CUTS)


@query(
    "d9_decisions_per_entity",
    f"{V}, pc AS (SELECT site, player, count(*) AS decisions FROM v GROUP BY ALL), q AS ({quantiles_sql('decisions', 'pc')}) SELECT q.*, "
    + ", ".join(f"(SELECT count(*) FROM pc WHERE decisions >= {c}) AS ge_{c}" for c in EVENT_CUTS)
    + " FROM q",
)
def _(spark, d):
    each = support.entity_summary(b.v(spark, d)).select("decisions")
    return profile.quantiles(each, "decisions").crossJoin(profile.at_least(each, "decisions", EVENT_CUTS))


@query("d9_sketched_quantiles")
def _(spark, d):
    """As d6_sketched_quantiles, of decisions."""
    return profile.sketched_quantiles(profile.value_sketch(support.entity_summary(b.v(spark, d)), "decisions", ("site",)))


@query(
    "d10_visibility",
    f"{N} SELECT round(avg(saw_hole::INT), 6) AS hole_rate, round(avg(reached_showdown::INT), 6) AS showdown_rate, round(avg(CASE WHEN reached_showdown THEN saw_hole::INT END), 6) AS hole_at_showdown, round(avg(CASE WHEN NOT reached_showdown THEN saw_hole::INT END), 6) AS hole_elsewhere, round(avg(vpip::INT), 6) AS vpip_rate FROM n",
)
def _(spark, d):
    return profile.visibility(b.n(spark, d))


@query(
    "d11_missing_bias",
    f"{N} SELECT round(avg(CASE WHEN vpip THEN saw_hole::INT END), 6) AS shown_if_vpip, round(avg(CASE WHEN NOT vpip THEN saw_hole::INT END), 6) AS shown_if_not, round(avg(net_c) FILTER (saw_hole), 6) AS net_shown, round(avg(net_c) FILTER (NOT saw_hole), 6) AS net_hidden, round(avg(invested_c) FILTER (saw_hole), 6) AS invested_shown, round(avg(invested_c) FILTER (NOT saw_hole), 6) AS invested_hidden FROM n",
)
def _(spark, d):
    return profile.missing_bias(b.n(spark, d))


@query("d12_outcome_sources", f"{N} SELECT net_source, count(*) AS n, round(avg(net_c), 6) AS mean_net_c FROM n GROUP BY ALL")
def _(spark, d):
    return profile.outcome_sources(b.n(spark, d))


@query(
    "d13_conservation",
    f"{ledger_sql.ALL}, s AS (SELECT site, hand_id, round(sum(net_bb), 6) + 0.0 AS s FROM hpl WHERE net_bb IS NOT NULL GROUP BY ALL) SELECT count(*) AS hands, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.01), 6) AS p01, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.99), 6) AS p99, count(*) FILTER (s > 0.01) AS created, count(*) FILTER (abs(s) < 0.01) AS balanced FROM s",
)
def _(spark, d):
    return profile.conservation(ledger.seats(spark, d))


# ---------------------------------------------------------------- common support

SUM_SQL = "es AS (SELECT site, player, count(*) AS decisions, count(DISTINCT hand_id) AS n_hands FROM v GROUP BY ALL)"
MIN_HANDS = (20, 25)
COHORT = f"{SUM_SQL}, c AS (SELECT site, player FROM es WHERE n_hands >= {MIN_HANDS[0]}), es_n AS (SELECT site, player, s_core AS s, count(*) AS n FROM v SEMI JOIN c USING (site, player) GROUP BY ALL)"
SUPPORT = "ss AS (SELECT s, count(*) AS eligible, count(*) FILTER (n >= 3) AS obs_3, count(*) FILTER (n >= 5) AS obs_5, count(*) FILTER (n >= 10) AS obs_10, sum(n)::BIGINT AS decisions FROM es_n GROUP BY ALL)"


def _cohort(spark, d):
    v = b.v(spark, d)
    return support.cohort_states(v, support.cohort(support.entity_summary(v), MIN_HANDS[0]), "s_core")


@query("e1_entity_summary", f"{V}, {SUM_SQL} SELECT * FROM es")
def _(spark, d):
    return support.entity_summary(b.v(spark, d))


@query("e2_cohort_sizes", f"{V}, {SUM_SQL}, h AS (SELECT unnest([{MIN_HANDS[0]}, {MIN_HANDS[1]}]) AS min_hands) SELECT min_hands, count(*) AS players, coalesce(sum(decisions), 0)::BIGINT AS decisions FROM h JOIN es ON n_hands >= min_hands GROUP BY ALL")
def _(spark, d):
    return support.cohort_sizes(b.v(spark, d), MIN_HANDS)


@query("e3_entity_state_counts", f"{V}, {COHORT} SELECT * FROM es_n")
def _(spark, d):
    return _cohort(spark, d)


@query("e4_state_support", f"{V}, {COHORT}, {SUPPORT} SELECT * FROM ss")
def _(spark, d):
    return support.state_support(_cohort(spark, d))


@query("e5_supported_fraction", f"{V}, {COHORT} SELECT " + ", ".join(f"round(sum(CASE WHEN n >= {k} THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS frac_{k}" for k in GRID_N) + " FROM es_n")
def _(spark, d):
    return support.supported_fraction(_cohort(spark, d), GRID_N)


def grid_sql(head: str = V) -> str:
    return (
        f"{head}, {COHORT}, {SUPPORT}, g AS (SELECT * FROM (SELECT unnest([3, 5, 10]) AS n) CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS x)), z AS (SELECT count(*) AS size FROM c) "
        "SELECT n, x, count(*) FILTER (ok) AS states, round(coalesce(sum(decisions) FILTER (ok), 0)::DOUBLE / sum(decisions), 6) AS share FROM (SELECT g.n, g.x, decisions, "
        "CASE g.n WHEN 3 THEN obs_3 WHEN 5 THEN obs_5 ELSE obs_10 END >= g.x * size AND eligible >= 20 AS ok FROM ss, g, z) GROUP BY ALL"
    )


def grid(v):
    members = support.cohort(support.entity_summary(v), MIN_HANDS[0])
    return support.coverage_grid(support.cohort_states(v, members, "s_core"), members, GRID_N, GRID_X)


@query("e6_coverage_grid", grid_sql())
def _(spark, d):
    return grid(b.v(spark, d))


@query("e6_grid_of_replay", grid_sql(f"{ledger.STATES}, v AS (SELECT site, player, hand_id, s_core FROM s3)"))
def _(spark, d):
    return grid(ledger.narrow(spark, d, "met-states", "site", "player", "hand_id", "s_core"))
