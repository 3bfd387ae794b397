"""Learning jobs over the labelled embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import vectors as vx
from lexivec.operators import learn, learn_blocks, linear
from lexivec.operators import random as rd
from registry.common import CELLS_SQL, cells, q6, r6, table, xavier_sql
from registry.vectors import BLOCKED_CELLS, CLASSES, SEED, WIDTH

EPOCHS, RATE, DECAY, MOMENTUM, DAMPING = 3, 0.5, 0.01, 0.9, 0.1


def vectors_of(spark, sf):
    return table(spark, sf, "embeddings")


def start(spark):
    return rd.xavier_matrix(spark, CLASSES, WIDTH, SEED)


def predicted(spark, sf):
    targets = learn.with_targets(vectors_of(spark, sf), "label", CLASSES)
    return learn.predictions(targets, linear.small_matrix(start(spark)), "embedding")


def one_hot(spark, sf):
    return cells(learn.with_targets(vectors_of(spark, sf), "label", CLASSES), "vec_id", "y", "y")


def cross_entropy(spark, sf):
    out = learn.loss_by_label(predicted(spark, sf), "label")
    return out.select("label", r6("loss").alias("loss"), r6("loss_logits").alias("loss_logits"), "n")


def softmax_gradient(spark, sf):
    return cells(learn.softmax_gradient(predicted(spark, sf)), "vec_id", "delta", "delta")


def gradient_sanity(spark, sf):
    """Per label: probabilities sum to one, gradients to zero."""
    rows = learn.softmax_gradient(predicted(spark, sf))
    return rows.groupBy("label").agg(
        r6(F.max(F.abs(vx.total(F.col("p")) - 1.0))).alias("p_gap"),
        r6(F.max(F.abs(vx.total(F.col("delta"))))).alias("delta_gap"),
        F.count(F.lit(1)).alias("n"),
    )


def outer_gradient(spark, sf):
    rows = learn.softmax_gradient(predicted(spark, sf))
    return learn.outer_gradient(rows, "delta", "embedding").withColumn("g", r6("g"))


def chain_gradient(spark, sf):
    rows = learn.softmax_gradient(predicted(spark, sf))
    back = learn.chain_gradient(rows, linear.small_matrix(start(spark)), "vec_id", "delta", "embedding")
    return cells(back, "vec_id", "dz")


def _step(spark, sf, nesterov):
    rows = learn.softmax_gradient(predicted(spark, sf))
    gradient = learn.outer_gradient(rows, "delta", "embedding")
    weights = start(spark).select(
        F.col("row").cast("int").alias("i"), F.col("col").alias("j"), F.col("val").alias("w"),
        (F.col("val") / 2).alias("v"),
    )
    out = learn.sgd_step(weights, gradient, 0.01, DECAY, MOMENTUM, DAMPING, nesterov)
    return out.select("i", "j", r6("w").alias("w"), r6("v").alias("v"))


def sgd_step(spark, sf):
    return _step(spark, sf, False)


def sgd_step_nesterov(spark, sf):
    return _step(spark, sf, True)


def _train(spark, sf):
    return learn.train_classifier(
        vectors_of(spark, sf), "label", "embedding", CLASSES, start(spark), EPOCHS, RATE, DECAY, MOMENTUM
    )


def train_classifier(spark, sf):
    return _train(spark, sf)[0].withColumn("w", r6("w"))


def train_classifier_blocks(spark, sf):
    """The same training with the model as a table of several blocks."""
    weights, _ = learn_blocks.train_classifier(
        vectors_of(spark, sf), "label", "embedding", CLASSES, start(spark), EPOCHS, RATE, DECAY, MOMENTUM,
        block_cells=BLOCKED_CELLS, broadcast_cells=0,
    )
    return weights.withColumn("w", r6("w"))


def loss_summary(spark, sf):
    history = _train(spark, sf)[1]
    return history.select("epoch", r6("mean_loss").alias("mean_loss"), r6("std_loss").alias("std_loss"), "n")


def scatter_add(spark, sf):
    return learn.scatter_add(vectors_of(spark, sf), "label", "embedding", WIDTH).withColumn("g", r6("g"))


def norm_softmax_gradients(spark, sf):
    x, weight = F.col("embedding"), F.array(*[F.lit(1.0 + j / WIDTH) for j in range(WIDTH)])
    rows = vectors_of(spark, sf).select(
        "vec_id",
        vx.softmax_gradient_product(F.reverse(x), vx.softmax(x)).alias("ds"),
        vx.rmsnorm_input_gradient(F.reverse(x), weight, x).alias("dx"),
    )
    both = rows.select("vec_id", F.posexplode(F.arrays_zip("ds", "dx")).alias("j", "e"))
    return both.select("vec_id", "j", r6("e.ds").alias("ds"), r6("e.dx").alias("dx"))


def norm_weight_gradient(spark, sf):
    x = F.col("embedding")
    per_row = F.zip_with(
        F.reverse(x), F.transform(x, lambda v: v.cast("double") * vx.inverse_rms(x)), lambda g, n: g.cast("double") * n
    )
    rows = vectors_of(spark, sf).select(per_row.alias("dw"))
    return learn.column_sums(rows, "dw", WIDTH, "dw").withColumn("dw", r6("dw"))


def finite_guard(spark, sf):
    rows = learn.softmax_gradient(predicted(spark, sf))
    return learn.finite_guard(rows, ["embedding", "logits", "delta"])


QUERIES = {
    f.__name__: f
    for f in (
        one_hot, cross_entropy, softmax_gradient, gradient_sanity, outer_gradient, chain_gradient, sgd_step,
        sgd_step_nesterov, train_classifier, train_classifier_blocks, loss_summary, scatter_add, norm_softmax_gradients, norm_weight_gradient,
        finite_guard,
    )
}

TARGETS = f"{CELLS_SQL}, t AS (SELECT vec_id, label, i::INT AS i, (i = label)::INT::DOUBLE AS y FROM embeddings, range(0, {CLASSES}) r(i))"


def forward_sql(weights: str, tag: str) -> str:
    """Common tables up to ``d{tag}(vec_id, label, i, p, y, z)`` for the weights ``(i, j, w)``."""
    return (
        f"z{tag} AS (SELECT vec_id, i, sum(x * w) AS z FROM cells JOIN {weights} USING (j) GROUP BY vec_id, i), "
        f"e{tag} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z{tag}), "
        f"d{tag} AS MATERIALIZED (SELECT vec_id, label, i, y, z, e / sum(e) OVER (PARTITION BY vec_id) AS p "
        f"FROM e{tag} JOIN t USING (vec_id, i))"
    )


W0 = xavier_sql("w0", CLASSES, WIDTH, SEED)
FIRST = f"{TARGETS}, {W0}, {forward_sql('w0', '0')}"
OUTER = "g0 AS (SELECT i, j, sum((p - y) * x) AS g FROM d0 JOIN cells USING (vec_id) GROUP BY i, j)"


def epochs_sql() -> str:
    """Unrolled epochs: ``w{k}`` and ``v{k}`` hold weights and velocity after epoch ``k``."""
    parts = [TARGETS, W0, "s0 AS (SELECT i, j, w, 0.0::DOUBLE AS v FROM w0)"]
    for k in range(EPOCHS):
        parts.append(forward_sql(f"s{k}", str(k)))
        parts.append(
            f"g{k} AS (SELECT i, j, sum((p - y) * x) / (SELECT count(*) FROM embeddings) AS g "
            f"FROM d{k} JOIN cells USING (vec_id) GROUP BY i, j)"
        )
        v = f"{MOMENTUM} * v + (g + {DECAY} * w)"
        parts.append(
            f"s{k + 1} AS MATERIALIZED (SELECT i, j, w - {RATE} * ({v}) AS w, {v} AS v FROM s{k} JOIN g{k} USING (i, j))"
        )
    return ", ".join(parts)


LOSSES = " UNION ALL ".join(
    f"SELECT {k} AS epoch, vec_id, sum(-y * ln(p + 1e-8)) AS l FROM d{k} GROUP BY vec_id" for k in range(EPOCHS)
)
NORM = "sqrt(sum(x * x) OVER (PARTITION BY vec_id) / 64.0 + 1e-6)"
PAIRS = "pairs AS (SELECT a.vec_id, a.j, a.x, b.x AS dy FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND b.j = 63 - a.j)"
SIG = "(1.0 / (1.0 + exp(-x)))"


def _sgd_sql(nesterov: bool) -> str:
    g = f"(g + {DECAY} * w)"
    v = f"({MOMENTUM} * (w / 2) + (1.0 - {DAMPING}) * {g})"
    step = f"({g} + {MOMENTUM} * {v})" if nesterov else v
    return (
        f"WITH {FIRST}, {OUTER} SELECT i, j, {q6(f'w - 0.01 * {step}')} AS w, {q6(v)} AS v FROM w0 JOIN g0 USING (i, j)"
    )


ORACLES = {
    "one_hot": f"WITH {TARGETS} SELECT vec_id, i AS j, y FROM t",
    "cross_entropy": (
        f"WITH {FIRST} SELECT label, {q6('avg(-ln(greatest(p, 1e-8::DOUBLE)))')} AS loss, "
        f"{q6('avg(-ln(p + 1e-8::DOUBLE))')} AS loss_logits, count(*) AS n FROM d0 WHERE y = 1 GROUP BY label"
    ),
    "softmax_gradient": f"WITH {FIRST} SELECT vec_id, i AS j, {q6('p - y')} AS delta FROM d0",
    "gradient_sanity": (
        f"WITH {FIRST}, r AS (SELECT vec_id, label, abs(sum(p) - 1) AS a, abs(sum(p - y)) AS b FROM d0 GROUP BY vec_id, label) "
        f"SELECT label, {q6('max(a)')} AS p_gap, {q6('max(b)')} AS delta_gap, count(*) AS n FROM r GROUP BY label"
    ),
    "outer_gradient": f"WITH {FIRST}, {OUTER} SELECT i, j::INT AS j, {q6('g')} AS g FROM g0",
    "chain_gradient": (
        f"WITH {FIRST}, back AS (SELECT vec_id, j, sum((p - y) * w) AS b FROM d0 JOIN w0 USING (i) GROUP BY vec_id, j) "
        f"SELECT vec_id, j::INT AS j, {q6(f'b * {SIG} * (1 + x * (1 - {SIG}))')} AS val FROM back JOIN cells USING (vec_id, j)"
    ),
    "sgd_step": _sgd_sql(False),
    "sgd_step_nesterov": _sgd_sql(True),
    "train_classifier": f"WITH {epochs_sql()} SELECT i, j, {q6('w')} AS w FROM s{EPOCHS}",
    "loss_summary": (
        f"WITH {epochs_sql()} SELECT epoch, {q6('avg(l)')} AS mean_loss, "
        f"{q6('sqrt(greatest(avg(l * l) - avg(l) * avg(l), 0.0))')} AS std_loss, count(*) AS n FROM ({LOSSES}) GROUP BY epoch"
    ),
    "scatter_add": f"WITH {CELLS_SQL} SELECT label AS id, j::INT AS j, {q6('sum(x)')} AS g FROM cells GROUP BY label, j",
    "norm_softmax_gradients": (
        f"WITH {CELLS_SQL}, {PAIRS}, e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM pairs), "
        f"p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, {NORM} AS n, "
        "sum(dy * (1.0 + j / 64.0) * x) OVER (PARTITION BY vec_id) AS along FROM e), "
        "d AS (SELECT *, sum(dy * p) OVER (PARTITION BY vec_id) AS mix FROM p) "
        f"SELECT vec_id, j::INT AS j, {q6('(dy - mix) * p')} AS ds, "
        f"{q6('dy * (1.0 + j / 64.0) / n - x * along / (64.0 * n * n * n)')} AS dx FROM d"
    ),
    "norm_weight_gradient": (
        f"WITH {CELLS_SQL}, {PAIRS}, n AS (SELECT j, dy * x / {NORM} AS g FROM pairs) "
        f"SELECT j::INT AS j, {q6('sum(g)')} AS dw FROM n GROUP BY j"
    ),
    "finite_guard": (
        f"WITH {FIRST} SELECT 'embedding' AS \"column\", count(*) AS n, count(*) FILTER (isnan(x)) AS n_nan, "
        "count(*) FILTER (isinf(x)) AS n_inf, count(*) FILTER (NOT isfinite(x)) = 0 AS ok FROM cells UNION ALL "
        "SELECT 'logits', count(*), count(*) FILTER (isnan(z)), count(*) FILTER (isinf(z)), "
        "count(*) FILTER (NOT isfinite(z)) = 0 FROM d0 UNION ALL SELECT 'delta', count(*), "
        "count(*) FILTER (isnan(p - y)), count(*) FILTER (isinf(p - y)), count(*) FILTER (NOT isfinite(p - y)) = 0 FROM d0"
    ),
}
ORACLES["train_classifier_blocks"] = ORACLES["train_classifier"]
