"""The replay in SQL for the oracles: a recursive query that takes one token of every hand at a time."""

from __future__ import annotations

from feltloom.functions.cards import RANKS
from feltloom.operators.ledger import BY_BLIND, BY_BUTTON
from feltloom.plans.logs import hands_sql

R = f"position(substr(c, 1, 1) IN '{RANKS}')"


def put(xs: str, x: str) -> str:
    return f"list_transform({xs}, lambda v, k: CASE WHEN k = t.seat THEN {x} ELSE v END)"


LABEL = (
    "CASE WHEN pos_idx = 0 THEN CASE n_players WHEN 2 THEN 'SB/BTN' ELSE 'SB' END WHEN pos_idx = 1 THEN 'BB' "
    f"ELSE coalesce({list(BY_BUTTON)!r}[n_players - pos_idx], {list(BY_BLIND)!r}[pos_idx - 1], 'MP') END"
)

REPLAY = f"""
    hd AS (SELECT *, CASE WHEN nl_level > 0 THEN nl_level / 100.0::DOUBLE ELSE coalesce(nullif(greatest(list_max(blinds), 0), 0), 1.0) END AS bb FROM l),
    tk0 AS (SELECT hand_id, unnest(actions) AS tok, generate_subscripts(actions, 1) AS i FROM l),
    tk1 AS (SELECT *, CASE WHEN regexp_matches(tok, '^d db .+$') THEN 'board' WHEN regexp_matches(tok, '^d dh p\\d+ .+$') THEN 'hole'
                   WHEN regexp_matches(tok, '^p\\d+ (f|cc|cbr|sm)( .+)?$') THEN string_split(tok, ' ')[2] ELSE 'other' END AS kind FROM tk0),
    tk AS MATERIALIZED (SELECT hand_id, i, kind, sum((kind = 'board')::INT) OVER (PARTITION BY hand_id ORDER BY i)::INTEGER AS street,
                  coalesce(try_cast(CASE WHEN kind = 'hole' THEN substr(string_split(tok, ' ')[3], 2) ELSE substr(string_split(tok, ' ')[1], 2) END AS INTEGER), 0) AS seat,
                  CASE kind WHEN 'board' THEN substr(tok, 6) WHEN 'hole' THEN string_split(tok, ' ')[4] ELSE coalesce(string_split(tok, ' ')[3], '') END AS arg FROM tk1),
    i0 AS (SELECT hand_id, n_players AS n, list_transform(generate_series(1, n_players), lambda k: CASE WHEN blinds[k] > 0 THEN least(blinds[k], starting_stacks[k]) ELSE 0.0 END) AS posted, starting_stacks AS st FROM hd),
    st AS (SELECT hand_id, 0::BIGINT AS i, NULL::VARCHAR AS kind, NULL::INTEGER AS seat, 0 AS street, '' AS board, posted AS contrib, posted AS invested, list_transform(st, lambda s, k: s - posted[k]) AS stack,
                  list_transform(posted, lambda x: false) AS folded, list_transform(posted, lambda x: '') AS hole, list_transform(posted, lambda x: false) AS shown,
                  list_sum(posted) AS pot, list_max(posted) AS bet, (list_max(posted) > 0)::INTEGER AS wagers, list_max(posted) AS last_inc, 0.0::DOUBLE AS pot_ref, 0 AS raises, 0 AS n_folds,
                  NULL::DOUBLE AS to_call, NULL::DOUBLE AS to_amt, NULL::DOUBLE AS paid FROM i0
           UNION ALL
           SELECT hand_id, i, kind, seat, CASE WHEN kind = 'board' THEN t_street ELSE street END, CASE WHEN kind = 'board' THEN board || arg ELSE board END,
                  CASE WHEN kind = 'board' THEN list_transform(contrib, lambda v: 0.0::DOUBLE) WHEN act THEN {put('contrib', 'v + paid').replace('t.seat', 'seat')} ELSE contrib END,
                  CASE WHEN act THEN {put('invested', 'v + paid').replace('t.seat', 'seat')} ELSE invested END, CASE WHEN act THEN {put('stack', 'v - paid').replace('t.seat', 'seat')} ELSE stack END,
                  CASE WHEN kind = 'f' THEN {put('folded', 'true').replace('t.seat', 'seat')} ELSE folded END,
                  CASE WHEN kind IN ('hole', 'sm') AND arg NOT IN ('', '????') THEN {put('hole', 'arg').replace('t.seat', 'seat')} ELSE hole END,
                  CASE WHEN kind = 'sm' AND arg <> '' THEN {put('shown', 'true').replace('t.seat', 'seat')} ELSE shown END,
                  CASE WHEN act THEN pot + paid ELSE pot END, CASE WHEN kind = 'board' THEN 0.0 WHEN kind = 'cbr' THEN contrib[seat] + paid ELSE bet END,
                  CASE WHEN kind = 'board' THEN 0 WHEN kind = 'cbr' THEN wagers + 1 ELSE wagers END, CASE WHEN kind = 'board' THEN 0.0 WHEN kind = 'cbr' THEN paid ELSE last_inc END,
                  CASE WHEN kind IN ('board', 'cbr') THEN pot ELSE pot_ref END, CASE WHEN kind = 'cbr' AND street = 0 THEN raises + 1 ELSE raises END, n_folds + (kind = 'f')::INTEGER, to_call, to_amt, paid
           FROM (SELECT *, CASE WHEN kind = 'f' THEN 0.0 WHEN kind = 'cbr' THEN least(to_amt - contrib[seat], stack[seat]) WHEN to_call <= 1e-9 THEN 0.0 ELSE least(to_call, stack[seat]) END AS paid FROM
                 (SELECT s.* EXCLUDE (i, kind, seat, to_call, to_amt, paid), t.i, t.kind, t.seat, t.street AS t_street, t.arg, t.kind IN ('f', 'cc', 'cbr') AS act,
                         CASE WHEN t.kind IN ('f', 'cc', 'cbr') THEN greatest(0.0, s.bet - s.contrib[t.seat]) END AS to_call, CASE WHEN t.kind = 'cbr' THEN coalesce(try_cast(t.arg AS DOUBLE), s.bet) END AS to_amt
                  FROM st s JOIN tk t ON t.hand_id = s.hand_id AND t.i = s.i + 1))),
    fin AS (SELECT * FROM st SEMI JOIN (SELECT hand_id, max(i) AS i FROM st GROUP BY ALL) z USING (hand_id, i)),
    rf AS (SELECT *, list_position(contrib, list_max(contrib)) AS top, CASE WHEN list_reverse_sort(contrib)[1] - list_reverse_sort(contrib)[2] > 1e-9 THEN list_reverse_sort(contrib)[1] - list_reverse_sort(contrib)[2] ELSE 0.0 END AS excess FROM fin),
    o1 AS MATERIALIZED (SELECT rf.hand_id, hd.* EXCLUDE (hand_id), rf.hole, rf.shown, rf.board, rf.top, rf.excess, rf.pot - excess AS pot, list_transform(rf.invested, lambda x, k: CASE WHEN k = top THEN x - excess ELSE x END) AS inv,
                  list_filter(generate_series(1, n_players), lambda k: NOT rf.folded[k]) AS alive FROM rf JOIN hd USING (hand_id)),
    cd7 AS (SELECT hand_id, k, list_concat([hole[k][1:2], hole[k][3:4]], [board[1:2], board[3:4], board[5:6], board[7:8], board[9:10]]) AS cs FROM (SELECT hand_id, hole, board, unnest(alive) AS k FROM o1) WHERE length(board) = 10 AND hole[k] <> ''),
    five AS (SELECT hand_id, k, list_filter(cs, lambda c, j: j <> x AND j <> y) AS cs FROM cd7, generate_series(1, 6) g(x), generate_series(2, 7) h(y) WHERE x < y),
    f2 AS (SELECT *, list_transform(cs, lambda c: {R} + 1) AS rk, len(list_distinct(list_transform(cs, lambda c: c[2:2]))) = 1 AS flush FROM five),
    f3 AS (SELECT *, list_transform(list_reverse_sort(list_transform(list_distinct(rk), lambda x: [len(list_filter(rk, lambda y: y = x)), x])), lambda p: p[2]) AS ks, list_reverse_sort(list_transform(list_distinct(rk), lambda x: len(list_filter(rk, lambda y: y = x)))) AS ns,
                  CASE WHEN len(list_distinct(rk)) = 5 AND list_max(rk) - list_min(rk) = 4 THEN list_max(rk) WHEN list_sort(rk) = [2, 3, 4, 5, 14] THEN 5 ELSE 0 END AS top FROM f2),
    f4 AS (SELECT hand_id, k, CASE WHEN flush AND top > 0 THEN [8, top] WHEN ns[1] = 4 THEN list_concat([7], ks) WHEN ns[1] = 3 AND ns[2] = 2 THEN list_concat([6], ks) WHEN flush THEN list_concat([5], ks)
                  WHEN top > 0 THEN [4, top] WHEN ns[1] = 3 THEN list_concat([3], ks) WHEN ns[1] = 2 AND ns[2] = 2 THEN list_concat([2], ks) WHEN ns[1] = 2 THEN list_concat([1], ks) ELSE list_concat([0], ks) END AS p FROM f3),
    sc7 AS MATERIALIZED (SELECT hand_id, k, max(coalesce(p[1], 0) * 759375 + coalesce(p[2], 0) * 50625 + coalesce(p[3], 0) * 3375 + coalesce(p[4], 0) * 225 + coalesce(p[5], 0) * 15 + coalesce(p[6], 0))::BIGINT AS score FROM f4 GROUP BY ALL),
    sch AS (SELECT hand_id, count(*) AS n_seen, max(score) AS best, list(k ORDER BY k) AS seen, list({{'k': k, 's': score}} ORDER BY k) AS each FROM sc7 GROUP BY ALL),
    o2 AS (SELECT o1.*, CASE WHEN board = '' OR starts_with(site, 'ACPC') THEN 0.0 ELSE least(least(3.0 / bb, 3.0), 0.05 * (pot / bb)) END * bb AS rake,
                  len(finishing_stacks) = n_players AND abs(list_sum(finishing_stacks) - list_sum(starting_stacks)) < 1e-6 AS exact, coalesce(n_seen, 0) AS n_seen, best, seen, each,
                  list_filter(generate_series(1, len(winnings)), lambda k: winnings[k] > 0) AS paidto FROM o1 LEFT JOIN sch USING (hand_id)),
    o3 AS (SELECT *, CASE WHEN coalesce(exact, false) THEN 'finishing' WHEN len(alive) = 1 THEN 'uncontested' WHEN n_seen = len(alive) AND n_seen > 1 THEN 'showdown_eval' WHEN n_seen = 1 THEN 'sd_heuristic'
                  WHEN len(winnings) = n_players AND len(paidto) > 0 THEN 'winnings_winner' ELSE 'unknown' END AS net_source FROM o2),
    o4 AS (SELECT *, CASE net_source WHEN 'uncontested' THEN alive WHEN 'showdown_eval' THEN list_transform(list_filter(each, lambda x: x.s = best), lambda x: x.k) WHEN 'sd_heuristic' THEN seen WHEN 'winnings_winner' THEN paidto END AS winners FROM o3),
    oc AS MATERIALIZED (SELECT *, CASE WHEN net_source = 'finishing' THEN list_transform(finishing_stacks, lambda x, k: x - starting_stacks[k]) WHEN winners IS NOT NULL THEN list_transform(inv, lambda x, k: CASE WHEN list_contains(winners, k) THEN (pot - rake) / len(winners) - x ELSE -x END) END AS net FROM o4),
    hp AS (SELECT site, nl_level, hand_id, unnest(players) AS player, (generate_subscripts(players, 1) - 1)::INTEGER AS pos_idx, n_players, bb, blinds, inv, net, shown, hole AS holes, net_source, day FROM oc),
    hpl AS (SELECT site, nl_level, hand_id, player, pos_idx, n_players, round(inv[pos_idx + 1] / bb, 6) AS invested_bb, round(net[pos_idx + 1] / bb, 6) + 0.0 AS net_bb, net_source, shown[pos_idx + 1] AS reached_showdown, holes[pos_idx + 1] <> '' AS saw_hole,
                   holes[pos_idx + 1] AS hole, inv[pos_idx + 1] > blinds[pos_idx + 1] + 1e-9 AS vpip, day FROM hp),
    d0 AS (SELECT a.hand_id, a.i, a.kind, a.seat, b.street, b.board, b.pot, b.stack[a.seat] AS stack, b.invested[a.seat] AS committed, b.hole[a.seat] AS hole, b.wagers, b.last_inc, b.pot_ref, b.raises, b.n_folds, b.bet, b.folded, a.to_call, a.to_amt, a.paid
           FROM st a JOIN st b ON a.hand_id = b.hand_id AND b.i = a.i - 1 WHERE a.kind IN ('f', 'cc', 'cbr')),
    la AS (SELECT d0.hand_id, d0.i, count(DISTINCT x.seat)::INTEGER AS later FROM d0 JOIN tk x ON x.hand_id = d0.hand_id AND x.i > d0.i AND x.street = d0.street AND x.kind IN ('f', 'cc', 'cbr') AND NOT d0.folded[x.seat] GROUP BY ALL),
    dec AS (SELECT oc.site, oc.nl_level, d0.hand_id, (row_number() OVER (PARTITION BY d0.hand_id ORDER BY i) - 1)::INTEGER AS seq, players[seat] AS player, seat - 1 AS pos_idx, n_players, bb, nullif(d0.hole, '') AS hero_hole, d0.street, d0.board,
                   round(d0.pot / bb, 6) AS pot_before_bb, round(to_call / bb, 6) AS to_call_bb, round(d0.stack / bb, 6) AS hero_stack_before_bb, round(CASE WHEN d0.pot > 1e-9 THEN d0.stack / d0.pot ELSE 99.0 END, 6) AS spr,
                   CASE WHEN to_call <= 1e-9 THEN 'no_wager' WHEN wagers <= 1 THEN 'bet' WHEN wagers = 2 THEN 'raise' ELSE 'reraise' END AS action_faced,
                   round(CASE WHEN pot_ref > 1e-9 THEN last_inc / pot_ref WHEN last_inc > 0 THEN 99.0 ELSE 0.0 END, 6) AS prev_wager_frac,
                   CASE raises WHEN 0 THEN 'limped' WHEN 1 THEN 'SRP' WHEN 2 THEN '3bet' ELSE '4bet+' END AS pot_type, n_players - n_folds AS n_active_before, coalesce(later, 0) AS n_to_act_after, oc.day,
                   round(committed / bb, 6) AS committed_before_bb, CASE WHEN kind = 'f' THEN 'fold' WHEN kind = 'cc' AND to_call <= 1e-9 THEN 'check' WHEN kind = 'cc' THEN 'call' WHEN bet > 1e-9 THEN 'raise' ELSE 'bet' END AS act,
                   round(CASE WHEN kind = 'cbr' THEN to_amt WHEN kind = 'cc' AND to_call > 1e-9 THEN paid ELSE 0.0 END / bb, 6) AS act_to_bb,
                   round(CASE WHEN kind = 'f' OR (kind = 'cc' AND to_call <= 1e-9) THEN 0.0 WHEN d0.pot > 1e-9 THEN paid / d0.pot WHEN kind = 'cbr' THEN 99.0 ELSE 0.0 END, 6) AS act_frac,
                   round(net[seat] / bb, 6) + 0.0 AS hand_net_bb, round(net[seat] / bb + committed / bb, 6) + 0.0 AS reward_bb, net_source
            FROM d0 LEFT JOIN la USING (hand_id, i) JOIN oc USING (hand_id))"""

HANDS = f"WITH {hands_sql()}"
ALL = f"WITH RECURSIVE {hands_sql()}, {REPLAY}"

CLASS = f"""CASE WHEN length(hero_hole) = 4 AND hero_hole <> '????' THEN CASE WHEN hero_hole[1] = hero_hole[3] THEN hero_hole[1] || hero_hole[3]
    WHEN position(hero_hole[1] IN '{RANKS}') > position(hero_hole[3] IN '{RANKS}') THEN hero_hole[1] || hero_hole[3] ELSE hero_hole[3] || hero_hole[1] END || CASE WHEN hero_hole[1] = hero_hole[3] THEN '' WHEN hero_hole[2] = hero_hole[4] THEN 's' ELSE 'o' END END"""


def cards_sql(text: str) -> str:
    return f"list_transform(generate_series(1, length({text}) // 2), lambda j: {text}[2 * j - 1 : 2 * j])"


def buckets_sql() -> str:
    """CTEs that add hero_hole_class, board_bucket and hero_hand_bucket to dec, as dx."""
    vals = f"list_transform(cs, lambda c: {R} + 1)"
    most = "list_max(list_transform(['c', 'd', 'h', 's'], lambda s: len(list_filter(cs, lambda c: c[2:2] = s))))"
    return f"""bd AS (SELECT DISTINCT board, {cards_sql('board')} AS cs FROM dec WHERE board <> ''),
    bb1 AS (SELECT board, len(cs) || CASE WHEN len(list_distinct({vals})) < len(cs) THEN 'p' ELSE 'u' END || CASE WHEN {most} >= 3 THEN 'm' WHEN {most} = 2 THEN 't' ELSE 'r' END
                   || CASE WHEN len(list_distinct({vals})) >= 3 AND list_max({vals}) - list_min({vals}) <= 4 THEN 'c' ELSE 'g' END AS board_bucket FROM bd),
    hb AS (SELECT DISTINCT hero_hole, board, {cards_sql('(hero_hole || board)')} AS cs FROM dec WHERE hero_hole IS NOT NULL AND board <> ''),
    hb1 AS (SELECT *, {vals} AS v, {most} AS suited, list_reverse_sort(list_transform(list_distinct({vals}), lambda x: len(list_filter({vals}, lambda y: y = x)))) AS ns FROM hb),
    hb2 AS (SELECT *, len(list_filter(generate_series(1, 10), lambda x: list_has_all(CASE WHEN list_contains(v, 14) THEN list_append(v, 1) ELSE v END, [x, x + 1, x + 2, x + 3, x + 4]))) > 0 AS straight FROM hb1),
    hb3 AS (SELECT hero_hole, board, CASE WHEN suited >= 5 AND straight THEN 'straight_flush' WHEN ns[1] = 4 THEN 'quads' WHEN ns[1] = 3 AND ns[2] = 2 THEN 'full_house' WHEN suited >= 5 THEN 'flush' WHEN straight THEN 'straight' WHEN ns[1] = 3 THEN 'trips'
                   WHEN ns[1] = 2 AND ns[2] = 2 THEN 'two_pair' WHEN ns[1] = 2 THEN CASE WHEN hero_hole[1] = hero_hole[3] THEN 'overpair_pair' ELSE 'pair' END WHEN suited = 4 THEN 'flush_draw' ELSE 'high_card' END AS made FROM hb2),
    dx AS (SELECT dec.*, {LABEL} AS pos_label, {CLASS} AS hero_hole_class, CASE WHEN board = '' THEN 'preflop' ELSE board_bucket END AS board_bucket, CASE WHEN hero_hole IS NULL THEN 'unknown' WHEN board = '' THEN 'preflop' ELSE made END AS hero_hand_bucket
           FROM dec LEFT JOIN bb1 USING (board) LEFT JOIN hb3 USING (hero_hole, board))"""
