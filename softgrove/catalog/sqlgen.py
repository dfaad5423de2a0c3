"""SQL texts that grow trees level by level, written from the formulas.

A text starts from a relation ``base(model, rid, w, y | t0.., f0.., [m0..])`` and
adds one block of CTEs per split level; :class:`TreeSql` collects them.
"""

from __future__ import annotations

from softgrove.catalog.common import sql_entropy, sql_gini


class TreeSql:
    def __init__(self, n_features: int, task: str = "class", width: int = 3, soft: bool = False,
                 criterion: str = "gini", prefix: str = "t", base: str = "base", min_gain: float = 1e-7,
                 min_samples: int = 2, subset: str | None = None, payload: str = ""):
        self.f, self.task, self.k, self.soft, self.criterion = n_features, task, width, soft, criterion
        self.p, self.min_gain, self.min_samples, self.subset = prefix, min_gain, min_samples, subset
        self.payload = payload  # extra columns of base to carry along
        self.ctes: list[str] = [f"{prefix}_rows0 AS (SELECT *, CAST(1 AS BIGINT) AS node FROM {base})"]
        self.levels = 0

    def _stats(self) -> list[tuple[str, str]]:
        if self.task == "class":
            out = [(f"c{i}", f"sum(CASE WHEN y = {i} THEN w ELSE 0 END)::DOUBLE") for i in range(self.k)]
            if self.soft:
                out += [(f"g{i}", f"sum(CASE WHEN y = {i} THEN w * m ELSE 0 END)") for i in range(self.k)]
            return out
        out = [("n", "sum(w)::DOUBLE")]
        out += [(f"s{i}", f"sum(w * t{i})") for i in range(self.k)]
        out += [(f"q{i}", f"sum(w * t{i} * t{i})") for i in range(self.k)]
        return out + [("g", "sum(w * m)")] if self.soft else out

    def _spread(self, side: str, i: int) -> str:
        v = f"greatest(0, {side}q{i} / {side}n - ({side}s{i} / {side}n) * ({side}s{i} / {side}n))"
        return f"sqrt({v})" if self.criterion == "stddev" else v

    def _gain(self) -> tuple[str, str]:
        """Gain and the scale its ties are judged on."""
        if self.task == "class":
            fn = sql_gini if self.criterion == "gini" else sql_entropy
            side = lambda s, st: [f"{s}{st}{i}" for i in range(self.k)]
            n = {s: "(" + " + ".join(side(s, "c")) + ")" for s in ("a_", "h_", "r_")}
            crisp = (f"{fn(side('a_', 'c'))} - {n['h_']} / {n['a_']} * {fn(side('h_', 'c'))}"
                     f" - {n['r_']} / {n['a_']} * {fn(side('r_', 'c'))}")
            if not self.soft:
                return crisp, "1"
            g = {s: "(" + " + ".join(side(s, "g")) + ")" for s in ("a_", "h_", "r_")}
            soft = (f"{fn(side('a_', 'c'))} - {g['h_']} / {g['a_']} * {fn(side('h_', 'g'))}"
                    f" - {g['r_']} / {g['a_']} * {fn(side('r_', 'g'))}")
            return (f"CASE WHEN {g['a_']} > 0 THEN CASE WHEN {g['h_']} > 0 AND {g['r_']} > 0 THEN {soft} END "
                    f"ELSE {crisp} END"), "1"
        parts = []
        for i in range(self.k):
            crisp = (f"({self._spread('a_', i)} - h_n / a_n * {self._spread('h_', i)} - r_n / a_n * {self._spread('r_', i)})")
            soft = (f"({self._spread('a_', i)} - h_g / a_g * {self._spread('h_', i)} - r_g / a_g * {self._spread('r_', i)})")
            parts.append(f"CASE WHEN a_g > 0 THEN {soft} ELSE {crisp} END" if self.soft else crisp)
        scale = " + ".join(self._spread("a_", i) for i in range(self.k))
        return " + ".join(parts), f"nullif({scale}, 0)"

    def feature_of(self, fi: str) -> str:
        return f"CASE {fi} " + " ".join(f"WHEN {i} THEN f{i}" for i in range(self.f)) + " END"

    def level(self) -> TreeSql:
        p, L = self.p, self.levels
        stats = [s for s, _ in self._stats()]
        target = "y" if self.task == "class" else ", ".join(f"t{i}" for i in range(self.k))
        only = f" JOIN {self.subset} USING (model, fi)" if self.subset else ""
        long = " UNION ALL ".join(
            f"SELECT model, node, w, {target}, {i} AS fi, f{i} AS v{f', m{i} AS m' if self.soft else ''} FROM {p}_rows{L}"
            for i in range(self.f))
        run = ", ".join(f"sum({s}) OVER (PARTITION BY model, node, fi ORDER BY v DESC "
                        f"ROWS UNBOUNDED PRECEDING) AS h_{s}, sum({s}) OVER (PARTITION BY model, node, fi) AS a_{s}"
                        for s in stats)
        rest = ", ".join(
            (f"CASE WHEN a_{s} - h_{s} <= 1e-12 * a_{s} THEN 0 ELSE a_{s} - h_{s} END AS r_{s}"
             if s.startswith("g") else f"a_{s} - h_{s} AS r_{s}") for s in stats)
        gain, scale = self._gain()
        count = {s: " + ".join(f"{s}c{i}" for i in range(self.k)) if self.task == "class" else f"{s}n"
                 for s in ("a_", "r_")}
        self.ctes += [
            f"{p}_long{L} AS (SELECT * FROM ({long}){only})",
            f"{p}_hist{L} AS (SELECT model, node, fi, v, {', '.join(f'{e} AS {s}' for s, e in self._stats())} "
            f"FROM {p}_long{L} GROUP BY model, node, fi, v)",
            f"{p}_pre{L} AS (SELECT *, {rest} FROM (SELECT *, {run} FROM {p}_hist{L}))",
            f"{p}_gain{L} AS (SELECT * FROM (SELECT *, {gain} AS gain, {scale} AS scale FROM {p}_pre{L} "
            f"WHERE {count['r_']} > 0 AND {count['a_']} >= {self.min_samples}) WHERE gain IS NOT NULL)",
            f"{p}_best{L} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, node "
            f"ORDER BY round(gain / scale, 12) DESC, fi, v) AS rn FROM {p}_gain{L}) WHERE rn = 1 AND gain > {self.min_gain})",
            f"{p}_rows{L + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN b.fi IS NULL THEN r.node ELSE 2 * r.node + "
            f"CASE WHEN {self.feature_of('b.fi')} >= b.v THEN 0 ELSE 1 END END AS node "
            f"FROM {p}_rows{L} r LEFT JOIN {p}_best{L} b USING (model, node))",
        ]
        self.levels += 1
        return self

    def route(self, source: str, out: str, model: str = "model") -> TreeSql:
        """Send the rows of another relation down the grown tree."""
        last = f"SELECT *, CAST(1 AS BIGINT) AS node FROM {source}"
        for L in range(self.levels):
            self.ctes.append(f"{out}_{L} AS ({last})")
            last = (f"SELECT r.* EXCLUDE (node), CASE WHEN b.fi IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN "
                    f"{self.feature_of('b.fi')} >= b.v THEN 0 ELSE 1 END END AS node FROM {out}_{L} r "
                    f"LEFT JOIN {self.p}_best{L} b USING (model, node)")
        self.ctes.append(f"{out} AS ({last})")
        return self

    @property
    def final(self) -> str:
        return f"{self.p}_rows{self.levels}"

    def leaves(self) -> TreeSql:
        """``<p>_leaf``: label (smallest of the most frequent) or means per leaf."""
        if self.task == "class":
            self.ctes.append(
                f"{self.p}_leaf AS (SELECT model, node, arg_min(y, (-c, y)) AS label, sum(c) AS n FROM "
                f"(SELECT model, node, y, sum(w) AS c FROM {self.final} GROUP BY model, node, y) GROUP BY model, node)")
        else:
            means = ", ".join(f"sum(w * t{i}) / sum(w) AS mean{i}" for i in range(self.k))
            self.ctes.append(f"{self.p}_leaf AS (SELECT model, node, {means}, sum(w) AS n FROM {self.final} "
                             f"GROUP BY model, node)")
        return self

    def text(self) -> str:
        return ",\n".join(self.ctes)
