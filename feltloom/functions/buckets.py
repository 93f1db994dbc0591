"""Scalar bucket functions and state keys, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and scores that results must carry.
HAND_SCORES = {
    "straight_flush": 8.0, "quads": 7.0, "full_house": 6.0, "flush": 5.0, "straight": 4.0, "trips": 3.0,
    "two_pair": 2.0, "overpair_pair": 1.2, "pair": 1.0, "flush_draw": 0.4, "high_card": 0.0,
}
HAND_LABELS = (*HAND_SCORES, "preflop")
STRONG = ("trips", "straight", "flush", "full_house", "quads", "straight_flush")


def steps(x: Column, cuts: tuple[tuple[float, str], ...], last: str) -> Column:
    """The label of the first cut that x is below, else last; a NULL is below none."""
    out = None
    for cut, label in cuts:
        out = F.when(x < cut, label) if out is None else out.when(x < cut, label)
    return out.otherwise(last)


def size_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "na").otherwise(steps(x, ((0.4, "1"), (0.75, "2"), (1.25, "3")), "4"))


def spr_bucket(x: Column) -> Column:
    return steps(x, ((0.5, "a"), (1, "b"), (2, "c"), (5, "d"), (15, "e")), "f")


def position_group(x: Column) -> Column:
    return F.when(x.isin("SB", "SB/BTN"), "SB").when(x.isin("BB", "BTN", "CO"), x).when(x.isin("UTG", "UTG1", "UTG2"), "EP").otherwise("MP")


def active_bucket(n: Column) -> Column:
    return F.when(n >= 6, "6+").otherwise(n.cast("string"))


def sized_action(act: Column, frac: Column, pot: Column, to_call: Column) -> Column:
    """f, x, c, or b / r with the bucket of the wager against the pot after a call."""
    size = size_bucket(F.try_divide(frac * pot, pot + to_call))
    return F.when(act == "fold", "f").when(act == "check", "x").when(act == "call", "c").when(act == "bet", F.concat(F.lit("b"), size)).when(act == "raise", F.concat(F.lit("r"), size))


def hand_score(label: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, score in HAND_SCORES.items():
        out = out.when(label == name, score)
    return out.otherwise(0.5)


def is_strong(label: Column) -> Column:
    return label.isin(*STRONG)


def board_dynamic(bucket: Column, street: Column) -> Column:
    return F.when(street.isin(0, 3), 0.0).when(bucket.contains("m"), 0.35).when(bucket.contains("c"), 0.25).when(bucket.contains("t"), 0.18).otherwise(0.08)


def joined(*parts: Column | str) -> Column:
    """Parts with bars between, NULL if any is NULL."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    out = [columns[0].cast("string")]
    for c in columns[1:]:
        out += [F.lit("|"), c.cast("string")]
    return F.concat(*out)


def _known(c: str, other: str) -> Column:
    return F.coalesce(F.col(c), F.lit(other))


#: Buckets, the sized action and the state keys: what each is made of, in an order in which they can be made.
STATES = {
    "pos": (("pos_label",), lambda: position_group(F.col("pos_label"))),
    "faced_sz": (("prev_wager_frac",), lambda: size_bucket(F.col("prev_wager_frac"))),
    "spr_b": (("spr",), lambda: spr_bucket(F.col("spr"))),
    "nactive": (("n_active_before",), lambda: active_bucket(F.col("n_active_before"))),
    "a": (("act", "act_frac", "pot_before_bb", "to_call_bb"), lambda: sized_action(F.col("act"), F.col("act_frac"), F.col("pot_before_bb"), F.col("to_call_bb"))),
    "s_core": (("street", "pot_type", "pos", "action_faced", "spr_b"), lambda: joined("street", "pot_type", "pos", "action_faced", "spr_b")),
    "s_fine": (("s_core", "faced_sz", "nactive"), lambda: joined("s_core", "faced_sz", "nactive")),
    "s_hole": (("s_core", "hero_hole_class"), lambda: F.concat("s_core", F.lit("|H="), _known("hero_hole_class", "??"))),
    "s_sim": (("s_hole", "hero_hand_bucket"), lambda: F.concat("s_hole", F.lit("|M="), _known("hero_hand_bucket", "unknown"))),
    "s_pdf": (
        ("s_fine", "hero_hole_class", "hero_hand_bucket", "board_bucket", "n_to_act_after"),
        lambda: F.concat(
            "s_fine", F.lit("|H="), _known("hero_hole_class", "??"), F.lit("|M="), _known("hero_hand_bucket", "unknown"), F.lit("|B="), _known("board_bucket", "unknown"),
            F.lit("|behind="), F.col("n_to_act_after").cast("string"),
        ),
    ),
}


def needed(*names: str) -> set[str]:
    """The columns of decisions that these columns of decisions with states are made of."""
    return set().union(*(needed(*STATES[x][0]) if x in STATES else {x} for x in names))


def with_states(d: DataFrame) -> DataFrame:
    """Decisions with buckets, the sized action and the five state keys, as far as d has what they are made of."""
    for name, (parts, make) in STATES.items():
        if set(parts) <= set(d.columns):
            d = d.withColumn(name, make())
    return d


NAMED_STATES = {
    "core": lambda: F.col("s_core"),
    "fine": lambda: F.col("s_fine"),
    "hole": lambda: F.col("s_hole"),
    "sim": lambda: F.col("s_sim"),
    "pdf": lambda: F.col("s_pdf"),
}


def state(d: DataFrame, name: str) -> Column:
    """A named state, or any column of d whose name is a plain identifier; anything else is refused."""
    if name in NAMED_STATES:
        return NAMED_STATES[name]()
    if not re.fullmatch(r"[A-Za-z_]\w*", name) or name not in d.columns:
        raise ValueError(f"no state {name!r}")
    return F.col(name)


def texture_key(state_key: Column, board: Column, w: Column, d: Column) -> Column:
    """The state with the flop's tercile labels, once there is a flop; NULL if its texture is unknown."""
    return F.when(F.length(board) >= 6, F.concat(state_key, F.lit("|W"), w.cast("string"), F.lit("|D"), d.cast("string"))).otherwise(state_key)
