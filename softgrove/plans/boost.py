"""Gradient boosting with regression trees; many models advance one round together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from softgrove.functions import encode
from softgrove.functions.draws import draw_hash, draw_unit
from softgrove.functions.losses import LOSSES
from softgrove.functions.sqltext import name, num
from softgrove.operators.sampling import stratified_holdout
from softgrove.operators.splits import Layout
from softgrove.plans.frame import FuzzySetMap, ModelSpec, base_rows, expand_models, masses_sql, value_edges
from softgrove.plans.grow import grow
from softgrove.plans.route import Forest, Node, Tree
from softgrove.plans.score import is_small, leaves_by_model, running_leaves, summed_leaves, tree_sql
from softgrove.plans.store import load_trees, node_table, save_trees
from softgrove.plans.tree import Coding, TreeSpec, leaf_mean
from softgrove.session import cut_lineage


@dataclass(frozen=True)
class BoostSpec:
    """Boosting options. The first tree enters unshrunk; every later tree is
    subtracted with ``learning_rate``.

    ``loss`` names an entry of :data:`softgrove.functions.losses.LOSSES`.
    Classification defaults to "residual" (target minus raw score, no softmax
    before the gradient); "softmax" descends on softmax(scores) - target.
    ``n_iter_no_change`` stops a model after so many rounds without a smaller loss on the held-out
    ``validation_fraction`` of the rows (with the class shares of the table for classification).
    """

    tree: TreeSpec
    n_estimators: int = 100
    learning_rate: float = 0.1
    loss: str | None = None
    n_classes: int | None = None  # one-hot width; default: largest label + 1
    validation_fraction: float = 0.1
    n_iter_no_change: int | None = None
    key: tuple[str, ...] = ()  # unique row key, needed for the hold-out only
    checkpoint_every: int = 10
    seed: int = 0

    @property
    def loss_name(self) -> str:
        return self.loss or ("least_squares" if self.tree.task == "value" else "residual")


def _outputs(df: DataFrame, spec: BoostSpec) -> tuple[dict[str, Column], int]:
    """Target columns ``y0..``: the number itself, or a one-hot block for integer labels."""
    target = spec.tree.targets[0]
    if spec.tree.task == "value":
        return {"y0": F.expr(f"cast({name(target)} AS double)")}, 1
    width = spec.n_classes or int(df.agg(F.max(target).alias("m")).first()["m"]) + 1
    return {f"y{k}": F.expr(f"if({name(target)} = {k}, 1D, 0D)") for k in range(width)}, width


def fit_boosted_models(df: DataFrame, spec: BoostSpec, models: Sequence[ModelSpec],
                       variants: Sequence[FuzzySetMap] = (), weights: str | None = None,
                       history: list[tuple[int, int, float]] | None = None) -> tuple[list[tuple[Forest, Coding]], int]:
    """One forest per round; trees of all models of a round grow in the same jobs.

    A cached row is one row of the table: the scores of all models it takes part in are in its array ``mw``, kept
    until the next round's are there; rows by model exist only inside a job. Models stop one by one: a forest has the
    trees of the models that still go on. ``history`` collects (round, model, held-out loss).
    """
    if spec.n_iter_no_change is not None and not spec.key:
        raise ValueError("early stopping holds rows out by their key; name it in BoostSpec.key")
    tree = replace(spec.tree, task="value")
    gain = tree.gain_spec()
    if variants:
        gain = replace(gain, soft=True)
    elif gain.soft:
        gain = replace(gain, soft=False)
    targets, width = _outputs(df, spec)
    edges = value_edges(df, tree.features, tree.categorical, tree.direct_limit)
    cats = frozenset(i for i, f in enumerate(tree.features) if f in set(tree.categorical))
    layout = Layout(tuple(tree.features), "value", width, gain, cats,
                    frozenset(i for i, f in enumerate(tree.features) if f in edges),
                    masses_sql(tree.features, variants, models) if variants else "0D")
    source = df
    keep: list[str] = []
    if spec.n_iter_no_change is not None:
        if spec.tree.task == "class":
            source = stratified_holdout(source, spec.key, spec.tree.targets[0], spec.validation_fraction, "validation",
                                        spec.seed, "__held")
        else:
            source = source.withColumn("__held", draw_unit(draw_hash(spec.key, "validation", spec.seed)) < spec.validation_fraction)
        keep = ["__held"]
    base = base_rows(source, tree.features, tree.categorical, targets, weights, edges, keep)
    alone = weights is None
    if alone:
        base = base.withColumn("mw", F.array(F.struct(F.lit(models[0].model).alias("model"), F.lit(1).cast("bigint").alias("w"))))
    else:
        base = base.withColumn("mw", F.filter("mw", lambda s: s["w"] > 0)).filter("size(mw) > 0")
    base, older = base.persist(StorageLevel.MEMORY_AND_DISK), None
    loss = LOSSES[spec.loss_name]
    ys = [F.col(f"y{k}") for k in range(width)]
    rounds: list[tuple[Forest, Coding]] = []
    best = {m.model: (float("inf"), 0) for m in models}  # smallest loss, rounds since
    try:
        for i in range(spec.n_estimators):
            live = base
            if len(best) < len(models):
                live = base.withColumn("mw", F.filter("mw", lambda s: s["model"].isin(sorted(best)))).filter("size(mw) > 0")
            part = live.filter("NOT __held") if keep else live
            train = expand_models(part, tree.features, models)
            if i == 0:
                means = part.selectExpr(*[f"avg(y{k}) AS m{k}" for k in range(width)]).first()
                coding = Coding(centres=tuple(float(m) for m in means))
                train = train.selectExpr("*", *[f"y{k} - {num(c)} AS t{k}" for k, c in enumerate(coding.centres)])
            else:
                coding = Coding(centres=(0.0,) * width)
                scores = [F.get("f", F.lit(k)) for k in range(width)]
                train = train.withColumns({f"t{k}": g for k, g in enumerate(loss.gradient(ys, scores))})
            forest = grow(train, layout, tree.rules, sorted(best))
            rounds.append((forest, coding))
            if older is not None:
                older.unpersist()
            if i + 1 == spec.n_estimators and not keep:
                break
            leaves = leaves_by_model(forest, lambda n, c=coding: leaf_mean(n, c), width, bool(cats), alone)
            score = f"zip_with(s.f, l, (f, p) -> f - p * {num(spec.learning_rate)})" if i else "l"
            state = f"zip_with(mw, __leaves, (s, l) -> struct(s.model AS model, s.w AS w, {score} AS f))"
            moved = live.withColumn("__leaves", leaves).withColumn("mw", F.expr(state)).drop("__leaves")
            older, base = base, moved.persist(StorageLevel.MEMORY_AND_DISK)
            if (i + 1) % spec.checkpoint_every == 0 and i + 1 < spec.n_estimators:
                cached, base = base, cut_lineage(base)
                for done in (older, cached):
                    done.unpersist()
                older = None
            if keep:
                held = expand_models(base.filter("__held"), tree.features, models).groupBy("model").agg(
                    F.avg(loss.of_row(ys, [F.get("f", F.lit(k)) for k in range(width)])).alias("e")).collect()  # a row per model
                errors = {r["model"]: r["e"] for r in held}
                if history is not None:
                    history += [(i, m, errors.get(m)) for m in sorted(best)]
                going = {}
                for m, (least, waited) in best.items():
                    err = errors.get(m)
                    least, waited = (err, 0) if err is not None and err < least - 1e-12 else (least, waited + 1)
                    if waited < spec.n_iter_no_change:
                        going[m] = (least, waited)
                best = going
                if not best:
                    break
        return rounds, width
    finally:
        for cached in (older, base):
            if cached is not None:
                cached.unpersist()


@dataclass
class BoostedModel:
    spec: BoostSpec
    trees: list[Tree]
    codings: list[Coding]
    width: int
    validation: list[tuple[int, float]] = field(default_factory=list)  # held-out loss after each round

    def __post_init__(self) -> None:
        # leaves carry final values from here on, so that trees of all rounds can be summed alike
        self._values = {id(n): leaf_mean(n, c) for t, c in zip(self.trees, self.codings) for n in t.values() if n.is_leaf}

    def _leaf(self, node: Node) -> list[float]:
        return self._values[id(node)]

    def scores(self, n_trees: int | None = None) -> Column:
        """``array<double>`` of raw scores after the first ``n_trees`` trees."""
        trees = self.trees[: n_trees or len(self.trees)]
        rates = [1.0] + [-self.spec.learning_rate] * (len(trees) - 1)
        features = self.spec.tree.features
        if is_small(trees):
            outputs = []
            for k in range(self.width):
                parts = [tree_sql(t, features, lambda n, k=k: num(self._leaf(n)[k])) for t in trees]
                outputs.append(" + ".join(f"{num(w)} * {p}" for w, p in zip(rates, parts)))
            return F.expr(f"array({', '.join(outputs)})")
        return summed_leaves(trees, features, self.spec.tree.categorical, self._leaf, self.width, rates)

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Add the prediction; classification adds ``probability`` (softmax of the scores) too."""
        if self.spec.tree.task == "value":
            return df.withColumn(prediction, F.get(self.scores(), F.lit(0)))
        scored = df.withColumn("__scores", self.scores())
        return scored.withColumn("probability", encode.softmax(F.col("__scores"))) \
            .withColumn(prediction, encode.argmax_decode(F.col("__scores"))).drop("__scores")

    def staged(self) -> Column:
        """``array<double>``: the (first) score of a row after each tree."""
        rates = [1.0] + [-self.spec.learning_rate] * (len(self.trees) - 1)
        return running_leaves(self.trees, self.spec.tree.features, self.spec.tree.categorical,
                              lambda n: [self._leaf(n)[0]], rates)

    def loss_curve(self, df: DataFrame) -> DataFrame:
        """Mean squared-error loss on a table after each round: ``round, loss``."""
        y = F.expr(f"cast({name(self.spec.tree.targets[0])} AS double)").alias("y")
        loss = LOSSES["least_squares"].value(F.col("y"), F.col("f"))
        return df.select(y, F.posexplode(self.staged()).alias("round", "f")).groupBy("round").agg(F.avg(loss).alias("loss"))


    def nodes(self, spark: SparkSession) -> DataFrame:
        return node_table(spark, self._stored_spec(), self.trees, self.codings)

    def _stored_spec(self) -> TreeSpec:
        """All trees are regressions, whatever the model predicts."""
        return replace(self.spec.tree, task="value")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as tables; :meth:`load` scores with them again."""
        options = {"task": self.spec.tree.task, "width": self.width, "learning_rate": self.spec.learning_rate,
                   "loss": self.spec.loss, "n_classes": self.spec.n_classes, "seed": self.spec.seed}
        save_trees(spark, path, self._stored_spec(), self.trees, self.codings, options)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        tree, trees, codings, options = load_trees(spark, path)
        spec = BoostSpec(replace(tree, task=options["task"]), len(trees), options["learning_rate"], options["loss"],
                         options["n_classes"], seed=options["seed"])
        return BoostedModel(spec, trees, codings, options["width"])


def fit_boosted(df: DataFrame, spec: BoostSpec) -> BoostedModel:
    sets = spec.tree.fuzzy_sets
    variants = [sets] if sets is not None else []
    history: list[tuple[int, int, float]] = []
    rounds, width = fit_boosted_models(df, spec, [ModelSpec(0, 0 if variants else None)], variants, history=history)
    return BoostedModel(spec, [f[0] for f, _ in rounds], [c for _, c in rounds], width, [(i, e) for i, _, e in history])


