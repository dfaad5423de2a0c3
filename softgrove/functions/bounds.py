"""Upper bounds of the gain inside a range of split values, as SQL expressions.

Count times impurity is concave in the sums of a side, so its minimum over a box
of possible sums lies on a corner. That bounds the gain of every split value in
a bucket from the bucket's sums alone; buckets whose bound is below a gain
already found need no exact scan (the "alive interval" idea of Alsabti, Ranka
and Singh, CLOUDS, KDD 1998).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from softgrove.functions.criteria import CLASS_CRITERIA, CONCAVE, VALUE_CRITERIA, GainSpec, Side, impurity, plus

# More classes than this would need too many corners; their buckets are all scanned.
MAX_CORNER_CLASSES = 4


def _pick(fn: str, parts: Sequence[str]) -> str:
    return f"{fn}({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _class_bound(parent: str, whole: Sequence[str], n: str, lo: Sequence[str], hi: Sequence[str],
                 criterion: str) -> str:
    fn = CLASS_CRITERIA[criterion]

    def mass_impurity(masses: list[str]) -> str:
        return f"if({plus(masses)} > 0, {plus(masses)} * {fn(masses, plus(masses))}, 0D)"

    corners = []
    for pick in product((0, 1), repeat=len(whole)):
        hit = [h if p else l for p, l, h in zip(pick, lo, hi)]
        rest = [f"({w} - {x})" for w, x in zip(whole, hit)]
        corners.append(f"{mass_impurity(hit)} + {mass_impurity(rest)}")
    return f"({parent} - {_pick('least', corners)} / {n})"


def _variance_bound(node: Side, lo: Side, hi: Side) -> str:
    n, n_lo, n_hi = node.n, f"greatest({lo.n}, 1D)", f"least({hi.n}, {node.n} - 1)"
    outputs = []
    for s, s_lo, s_hi in zip(node.sums, lo.sums, hi.sums):
        corners = [f"{x} * {x} / {c} + ({s} - {x}) * ({s} - {x}) / ({n} - {c})"
                   for c, x in product((n_lo, n_hi), (s_lo, s_hi))]
        outputs.append(f"({_pick('greatest', corners)} - {s} * {s} / {n}) / {n}")
    return plus(outputs)


def _value_bound(node: Side, lo: Side, hi: Side, criterion: str, soft: bool) -> str:
    fn, n = VALUE_CRITERIA[criterion], node.n

    def floor(count_hi: str, corners: list[tuple[str, str, str]], mass_lo: str, mass: str) -> str:
        least = _pick("least", [f"if({c} > 0, {c} * {fn(c, s, q)}, 0D)" for c, s, q in corners])
        return f"if({count_hi} > 0, {mass_lo} / {mass} * {least} / {count_hi}, 0D)"

    outputs = []
    for s, q, s_lo, s_hi, q_lo, q_hi in zip(node.sums, node.squares, lo.sums, hi.sums, lo.squares, hi.squares):
        hit = list(product((lo.n, hi.n), (s_lo, s_hi), (q_lo, q_hi)))
        rest = [(f"({n} - {c})", f"({s} - {x})", f"({q} - {y})") for c, x, y in hit]
        mass, mass_lo, mass_hi = (node.g, lo.g, hi.g) if soft else (n, lo.n, hi.n)
        outputs.append(floor(hi.n, hit, mass_lo, mass))
        outputs.append(floor(f"({n} - {lo.n})", rest, f"({mass} - {mass_hi})", mass))
    return f"({impurity(node, criterion)} - {plus(outputs)})"


def gain_bound(node: Side, lo: Side, hi: Side, spec: GainSpec) -> str | None:
    """No split whose hit side lies between ``lo`` and ``hi`` gains more; None = no bound known."""
    if spec.gain is not None or spec.criterion not in CONCAVE:
        return None
    if node.classes:
        if len(node.classes) > MAX_CORNER_CLASSES:
            return None
        parent = impurity(node, spec.criterion)
        crisp = _class_bound(parent, node.classes, node.n, lo.classes, hi.classes, spec.criterion)
        if not spec.soft:
            return crisp
        soft = _class_bound(parent, node.soft_classes, node.g, lo.soft_classes, hi.soft_classes, spec.criterion)
    else:
        crisp = (_variance_bound(node, lo, hi) if spec.criterion in ("variance", "mse")
                 else _value_bound(node, lo, hi, spec.criterion, soft=False))
        if not spec.soft:
            return crisp
        soft = _value_bound(node, lo, hi, spec.criterion, soft=True)
    return f"if({node.g} > 0, {soft}, {crisp})"
