"""Names of classes, views and reasons, and how classes of two sides combine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: names in the order of their codes ----
DIRECTIONS = ("unknown", "toward_camera", "away_from_camera", "left", "right", "static", "mixed")
GESTURES = ("unknown", "push", "pull", "raise", "lower", "turn", "step", "run", "wave", "static", "mixed", "raise_lower", "reach_return", "head_turn", "head_nod", "head_tilt")
FAMILY_REASONS = (
    "representative", "overlapping_event", "adjacent_event", "copied_footage", "invalid_range", "different_identity", "different_scene", "different_sequence", "different_context", "distant_occurrence",
    "missing_pose", "different_pose", "different_action", "different_direction", "different_posture",
)
# ---- end of fixed values ----


def named(code: Column, names: tuple[str, ...], other: str) -> Column:
    """The name of a code from 0 on; `other` for codes that aren't known."""
    return F.when((code >= 0) & (code < len(names)), F.element_at(F.array(*[F.lit(n) for n in names]), code.cast("int") + 1)).otherwise(other)


def combined_class(a: Column, b: Column, trust_a: Column, trust_b: Column, mixed: str = "mixed") -> Column:
    """The class of two sides: the common one, that of the only side that is trusted at all, or mixed."""
    return F.when(a == b, a).when(trust_a <= 0, b).when(trust_b <= 0, a).otherwise(mixed)


def view_of(yaw: Column) -> Column:
    """1 to 8, eighths of a turn around 0 degrees; 0 if unknown."""
    known = yaw.isNotNull() & ~F.isnan(yaw) & (F.abs(yaw) <= 180)
    return F.when(known, (F.pmod(F.floor((yaw + 22.5) / 45), F.lit(8)) + 1).cast("int")).otherwise(0)


def body_supported(evidence: Column, yaw: Column, view: Column, observed: Column, requested: Column) -> Column:
    return F.coalesce(evidence.isin(2, 3) & (view_of(yaw) > 0) & (view == view_of(yaw)) & (observed >= 3) & (requested >= observed), F.lit(False))


def head_supported(yaw: Column, view: Column, strength: Column) -> Column:
    return F.coalesce((view_of(yaw) > 0) & (view == view_of(yaw)) & (strength > 0) & (strength <= 1), F.lit(False))


def export_class_order(requested: Column, present: Column, groups: Column) -> Column:
    """Requested keys that are present, each once, with manual groups that weren't named, in order, before the first key that is no group."""
    keys = F.filter(F.array_distinct(requested), lambda k: (k != "") & (F.array_contains(present, k) | F.array_contains(groups, k)))
    missing = F.array_sort(F.array_except(groups, keys))
    at = F.array_position(F.transform(keys, lambda k: ~k.startswith("group:")), True).cast("int")
    n = F.when(at == 0, F.size(keys)).otherwise(at - 1)
    return F.concat(F.slice(keys, 1, n), missing, F.slice(keys, n + 1, F.greatest(F.size(keys) - n, F.lit(0))))
