"""Quantisation, vector and matrix operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import formats as fm
from lexivec.functions import vectors as vx
from lexivec.operators import codec, linear, quant
from lexivec.operators import random as rd
from lexivec.plans import attention as plan
from registry.common import CELLS_SQL, cells, lehmer_sql, q6, r6, table, xavier_sql
from registry.tokens import DOCS, encoded_docs, tokenizer_of

WIDTH, CLASSES, HEADS, KV_HEADS, HEAD_DIM, HIDDEN = 64, 10, 4, 2, 16, 16
ATTENTION_BLOCK = 32  # several blocks a sequence already in the small tables
BETA, SEED, SCALE, TOP = 1.5, 1337, 10.0, 5


def vectors_of(spark, sf):
    return table(spark, sf, "embeddings")


def flipped(df):
    """A second vector table on the same keys: every vector back to front."""
    return df.select("vec_id", F.reverse("embedding").alias("embedding"))


def scaled(df):
    """Vectors large enough to reach the saturating range of the blocked format."""
    grown = F.transform("embedding", lambda x: (x.cast("double") * SCALE).cast("float"))
    return df.withColumn("embedding", grown)


def _codes(fmt):
    def query(spark, sf):
        coded = quant.quantized(vectors_of(spark, sf), fmt)
        rows = coded.select("vec_id", F.posexplode_outer("code").alias("j", "code")).filter("j is not null")
        return rows.withColumn("code", fm.unsigned(F.col("code"), fmt))

    return query


LARGE = {"e4m3": 1000.0, "e5m10": 200000.0}  # scales that leave the range of the format


def quant_overflow(spark, sf):
    """Codes of numbers around and above the largest of the narrow formats."""
    parts = []
    for fmt, scale in LARGE.items():
        grown = F.transform("embedding", lambda x: (x.cast("double") * scale).cast("float"))
        coded = quant.quantized(vectors_of(spark, sf).select("vec_id", grown.alias("embedding")), fmt)
        rows = coded.select("vec_id", F.posexplode_outer("code").alias("j", "code")).filter("j is not null")
        parts.append(rows.select(F.lit(fmt).alias("format"), "vec_id", "j", fm.unsigned(F.col("code"), fmt).alias("code")))
    return parts[0].unionByName(parts[1])


def quant_q8(spark, sf):
    coded = quant.quantized(scaled(vectors_of(spark, sf)), "q8")
    parts = coded.select("vec_id", "code.w", F.posexplode_outer("code.q").alias("j", "q")).filter("j is not null")
    return parts.select(
        "vec_id", "j", F.col("q").cast("int").alias("q"),
        F.get("w", F.floor(F.col("j") / fm.Q8_BLOCK).cast("int")).cast("int").alias("w"),
    )


def dequant_q8(spark, sf):
    coded = quant.quantized(scaled(vectors_of(spark, sf)), "q8")
    return cells(quant.dequantized(coded, "q8"), "vec_id", "vec")


def _unsigned(fmt):
    return lambda code: fm.unsigned(code, fmt)


def quant_matrix(spark, sf):
    """Every format over the whole table in one scan, as one checksum of codes per row."""
    vec = F.col("embedding")
    codes = {fmt: fm.encode_scalar(fmt)(vec).alias(fmt) for fmt in fm.FORMATS} | {"q8": fm.encode_q8()(vec).alias("q8")}
    coded = vectors_of(spark, sf).select("vec_id", *codes.values())
    whole = {fmt: "q8.q" if fmt == "q8" else F.transform(fmt, _unsigned(fmt)) for fmt in codes}
    sums = [
        F.struct(
            F.lit(fmt).alias("format"),
            F.aggregate(whole[fmt], F.lit(0).cast("bigint"), lambda s, c: s + c).alias("code_sum"),
        )
        for fmt in codes
    ]
    return coded.select("vec_id", F.inline(F.array(*sums)))


def quant_error(spark, sf):
    out = quant.quant_error(vectors_of(spark, sf), "label")
    return out.withColumn("max_error", r6("max_error")).withColumn("mean_error", r6("mean_error"))


def type_footprint(spark, sf):
    return quant.type_footprint(vectors_of(spark, sf))


def shape_check(spark, sf):
    return linear.shape_check(vectors_of(spark, sf), "embedding", WIDTH)


def row_view(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    rows = linear.row_view(vectors_of(spark, sf), wanted, "vec_id", "embedding", 8, 8)
    return cells(rows, "vec_id", "embedding")


def fill_matrix(spark, sf):
    return cells(linear.fill_like(vectors_of(spark, sf), "vec_id", "embedding", 0.5), "vec_id", "embedding")


def matmul(spark, sf):
    weights = rd.xavier_matrix(spark, CLASSES, WIDTH, SEED)
    out = linear.matmul(vectors_of(spark, sf), weights, "vec_id", "embedding")
    return out.withColumn("val", r6("val"))


def matmul_by_join(spark, sf):
    weights = rd.xavier_matrix(spark, CLASSES, WIDTH, SEED)
    out = linear.matmul_by_join(vectors_of(spark, sf), weights, "vec_id", "embedding")
    return out.select("vec_id", F.col("row").cast("int").alias("row"), r6("val").alias("val"))


BLOCKED_ROWS, BLOCKED_CELLS = 80, 1024  # a matrix of three by two blocks


def matmul_blocks(spark, sf):
    """A matrix of several blocks; its blocks and those of the vectors are dealt over the tasks."""
    weights = rd.xavier_matrix(spark, BLOCKED_ROWS, WIDTH, SEED)
    out = linear.matmul(vectors_of(spark, sf), weights, "vec_id", "embedding", BLOCKED_CELLS, broadcast_cells=0)
    return out.withColumn("val", r6("val"))


def residual_add(spark, sf):
    a = vectors_of(spark, sf).select("vec_id", "embedding")
    return cells(linear.residual_add(a, flipped(a), "vec_id", "embedding"), "vec_id", "embedding")


def rmsnorm(spark, sf):
    weight = F.array(*[F.lit(1.0 + j / WIDTH) for j in range(WIDTH)])
    out = vectors_of(spark, sf).select("vec_id", vx.rmsnorm(F.col("embedding"), weight).alias("y"))
    return cells(out, "vec_id", "y")


def softmax(spark, sf):
    out = vectors_of(spark, sf).select("vec_id", vx.softmax(F.col("embedding")).alias("y"))
    return cells(out, "vec_id", "y")


def softmax_by_group(spark, sf):
    out = linear.softmax_by_group(table(spark, sf, "events"), "event_type", "event_id", "value")
    return out.withColumn("p", r6("p"))


def argmax_topk(spark, sf):
    return linear.top_k(vectors_of(spark, sf), "vec_id", "embedding", 3).withColumn("val", r6("val"))


X = F.col


def activation_profile(spark, sf):
    x = X("x")
    curves = {"sigmoid": vx.sigmoid(x), "relu": vx.relu(x), "silu": vx.silu(x), "swish": vx.swish(x, BETA)}
    out = linear.activation_profile(vectors_of(spark, sf), "label", "embedding", curves)
    return out.select("label", *[r6(c).alias(c) for c in out.columns[1:]])


def activation_gradients(spark, sf):
    x = X("x")
    curves = {
        "sigmoid": vx.sigmoid_prime(x), "relu": vx.relu_prime(x), "silu": vx.silu_prime(x),
        "swish": vx.swish_prime(x, BETA),
    }
    out = linear.activation_profile(vectors_of(spark, sf), "label", "embedding", curves)
    return out.select("label", *[r6(c).alias(c) for c in out.columns[1:]])


def swiglu(spark, sf):
    a = vectors_of(spark, sf)
    out = linear.swiglu(a, flipped(a), "vec_id", "embedding", BETA)
    return out.select("vec_id", "j", *[r6(c).alias(c) for c in ("y", "da", "dg")])


def embedding_lookup(spark, sf):
    """Token ids of every document looked up in a table of token vectors, as one sum per document."""
    model = tokenizer_of(spark, sf)
    vectors = rd.matrix_rows(rd.xavier_matrix(spark, model.count(), 4, SEED))
    found = codec.embedding_lookup(
        encoded_docs(spark, sf, model), vectors.select(F.col("row").cast("int").alias("id"), "vec"), ["doc_id"]
    )
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").cast("bigint").alias("pos_sum"),
        *[r6(F.sum(F.get("vec", F.lit(j)))).alias(f"v{j}") for j in range(4)],
    )


def placed(spark, sf):
    """The vectors of a label are one sequence."""
    return linear.sequence_positions(vectors_of(spark, sf), "label", "vec_id")


def _rotated(spark, sf, inverse):
    turned = vx.rotary(F.col("embedding"), F.col("pos"), HEAD_DIM, HEADS, inverse=inverse)
    return cells(placed(spark, sf).select("vec_id", turned.alias("y")), "vec_id", "y")


def rotary(spark, sf):
    return _rotated(spark, sf, False)


def rotary_inverse(spark, sf):
    return _rotated(spark, sf, True)


def causal_attention(spark, sf):
    half = HEAD_DIM * KV_HEADS
    rows = placed(spark, sf).select(
        "label", "pos", "vec_id", F.col("embedding").alias("q"),
        F.slice("embedding", 1, half).alias("k"), F.slice("embedding", half + 1, half).alias("v"),
    )
    return cells(linear.causal_attention(rows, ["label"], "vec_id", HEADS, KV_HEADS, block=ATTENTION_BLOCK), "vec_id", "out")


ATTENTION_SEEDS = {"wq": 21, "wk": 22, "wv": 23, "wo": 24}
ATTENTION_ROWS = {"wq": HEADS * HEAD_DIM, "wk": KV_HEADS * HEAD_DIM, "wv": KV_HEADS * HEAD_DIM, "wo": WIDTH}


def attention_block(spark, sf):
    weights = {n: linear.small_matrix(rd.xavier_matrix(spark, ATTENTION_ROWS[n], WIDTH, s)) for n, s in ATTENTION_SEEDS.items()}
    out = plan.attention_block(
        vectors_of(spark, sf), "label", "vec_id", "vec_id", "embedding", **weights, heads=HEADS, kv_heads=KV_HEADS,
        block=ATTENTION_BLOCK,
    )
    return cells(out, "vec_id", "embedding")


def _decoded(fmt):
    """Vectors coded and decoded again, element by element."""

    def query(spark, sf):
        return cells(quant.dequantized(quant.quantized(vectors_of(spark, sf), fmt), fmt), "vec_id", "vec")

    return query


def _quantised_product(fmt):
    """A product in which both the matrix and the vectors are stored in a reduced format."""

    def query(spark, sf):
        grown = quant.dequantized(quant.quantized(scaled(vectors_of(spark, sf)), fmt), fmt, into="embedding")
        rows = rd.matrix_rows(rd.xavier_matrix(spark, CLASSES, WIDTH, SEED)).withColumn("vec", F.col("vec").cast("array<float>"))
        rows = quant.dequantized(quant.quantized(rows, fmt, vec="vec"), fmt)
        weights = rows.select("row", F.posexplode("vec").alias("col", "val"))
        return linear.matmul(grown, weights, "vec_id", "embedding").withColumn("val", r6("val"))

    return query


def gated_ffn(spark, sf):
    w1 = linear.small_matrix(rd.xavier_matrix(spark, HIDDEN, WIDTH, 11))
    w2 = linear.small_matrix(rd.xavier_matrix(spark, WIDTH, HIDDEN, 12))
    w3 = linear.small_matrix(rd.xavier_matrix(spark, HIDDEN, WIDTH, 13))
    return cells(linear.gated_ffn(vectors_of(spark, sf), "vec_id", "embedding", w1, w2, w3), "vec_id", "embedding")


def centroids(spark, sf):
    means = F.array(*[F.avg(F.get("embedding", F.lit(j)).cast("double")) for j in range(WIDTH)])
    return vectors_of(spark, sf).groupBy("label").agg(means.alias("embedding"))


def tied_scoring(spark, sf):
    """The vectors that score highest against the mean vector of each label."""
    base = vectors_of(spark, sf).select("vec_id", "embedding")
    out = linear.tied_scoring(base, centroids(spark, sf), "vec_id", "embedding", "label", TOP)
    return out.withColumn("score", r6("score"))


def search_queries(spark, sf):
    """Every vector whose id 50 divides is a query."""
    wanted = vectors_of(spark, sf).filter("vec_id % 50 = 0")
    return wanted.select(F.col("vec_id").alias("query_id"), "embedding")


def scoring_blocks(spark, sf):
    """The stated queries against all vectors; blocks of both are dealt over the tasks."""
    base = vectors_of(spark, sf).select("vec_id", "embedding")
    queries = search_queries(spark, sf)
    out = linear.tied_scoring(base, queries, "vec_id", "embedding", "query_id", TOP, BLOCKED_CELLS, broadcast_cells=0)
    return out.withColumn("score", r6("score"))


def table_reconcile(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    paid = (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * F.col("l_extendedprice")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(paid).alias("v"))
    return linear.table_reconcile(orders, lines, "k", "v", 2)


def reconcile_single(spark, sf):
    """Event values against their single-precision copies, at six significant digits."""
    a = table(spark, sf, "events").select("event_id", "value")
    b = a.select("event_id", F.col("value").cast("float").cast("double").alias("value"))
    return linear.table_reconcile(a, b, "event_id", "value", 6, single=True)


BOUNDS = {"l_quantity": (10, 40), "l_discount": (0.08, 0.02), "l_extendedprice": (1000, 50000)}


def clamp_columns(spark, sf):
    out = linear.clamp_report(table(spark, sf, "lineitem"), BOUNDS)
    return out.select("column", "n_changed", *[r6(c).alias(c) for c in out.columns if c not in ("column", "n_changed")])


QUERIES = {f"quant_{fmt}": _codes(fmt) for fmt in fm.FORMATS} | {f"dequant_{fmt}": _decoded(fmt) for fmt in fm.FORMATS} | {
    f"matmul_{fmt}": _quantised_product(fmt) for fmt in ("q8", "e4m3")
} | {
    f.__name__: f
    for f in (
        quant_overflow, quant_q8, dequant_q8, quant_matrix, quant_error, type_footprint, shape_check, row_view, fill_matrix, matmul, matmul_blocks,
        matmul_by_join, scoring_blocks, residual_add, rmsnorm, softmax, softmax_by_group, argmax_topk, activation_profile,
        activation_gradients, swiglu, embedding_lookup, rotary, rotary_inverse, causal_attention, attention_block, gated_ffn, tied_scoring,
        table_reconcile, reconcile_single, clamp_columns,
    )
}

# Bits of normal numbers by arithmetic: exponent e and 23-bit mantissa m of every element.
LOGB = (
    "(CASE WHEN {x} = 0 THEN 0 WHEN {x} >= pow(2, floor(log2({x})) + 1) THEN floor(log2({x})) + 1 "
    "WHEN {x} < pow(2, floor(log2({x}))) THEN floor(log2({x})) - 1 ELSE floor(log2({x})) END)::BIGINT"
)
BITS = (
    f"{CELLS_SQL}, parts AS (SELECT vec_id, label, j, x, (x < 0)::BIGINT AS s, {LOGB.format(x='abs(x)')} AS e FROM cells), "
    "bits AS MATERIALIZED (SELECT *, CASE WHEN x = 0 THEN 0 ELSE ((abs(x) / pow(2, e) - 1) * 8388608)::BIGINT END AS m "
    "FROM parts)"
)
CODES = {
    "e8m23": "(s << 31) | ((e + 127) << 23) | m",
    "e5m10": "(s << 15) | (greatest(e + 15, 0) << 10) | (m >> 13)",
    "e8m7": "(s << 15) | ((e + 127) << 7) | (m >> 16)",
    "e4m3": "(s << 7) | (greatest(e + 7, 0) << 3) | (m >> 20)",
}
CODES = {n: f"CASE WHEN x = 0 THEN 0 ELSE {c} END" for n, c in CODES.items()}
DECODED = {
    "e8m23": "abs(x)",
    "e5m10": "CASE WHEN e + 15 > 0 THEN pow(2, e) * (1 + (m >> 13) / 1024.0) ELSE ((m >> 13) << 13) * pow(2, -149) END",
    "e8m7": "pow(2, e) * (1 + (m >> 16) / 128.0)",
    "e4m3": "CASE WHEN e + 7 > 0 THEN pow(2, e) * (1 + (m >> 20) / 8.0) ELSE ((m >> 20) << 20) * pow(2, -149) END",
}


def q8_sql(source: str) -> str:
    """Common tables up to ``q8(vec_id, label, j, x, w, q)`` from ``(vec_id, label, j, x)``."""
    return (
        f"top AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id, j // 8) AS big FROM {source}), "
        f"shared AS (SELECT *, CASE WHEN big = 0 THEN 0 ELSE greatest(-7, least(8, {LOGB.format(x='big')} - 7)) END::INT "
        "AS w FROM top), q8 AS MATERIALIZED (SELECT *, "
        "greatest(-127, least(127, round_even(x / pow(2, w), 0)))::INT AS q FROM shared)"
    )


GROWN = f"{CELLS_SQL}, grown AS (SELECT vec_id, label, j, (x * {SCALE})::FLOAT::DOUBLE AS x FROM cells), {q8_sql('grown')}"
ROWS = (
    "s AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos "
    "FROM embeddings)"
)


def turned_sql(name: str, heads: int, sign: str = "") -> str:
    """CTE ``name(vec_id, label, pos, h, d, y)``: rotated heads of the leading elements."""
    here, other = (f"embedding[h * {HEAD_DIM} + {d} + 1]::DOUBLE" for d in ("d", f"(d + {HEAD_DIM // 2}) % {HEAD_DIM}"))
    half = HEAD_DIM // 2
    angle = f"{sign}pos * pow(10000.0, -(d % {half}) / {HEAD_DIM}.0)"
    return (
        f"{name} AS MATERIALIZED (SELECT vec_id, label, pos, h, d, {here} * cos({angle}) + "
        f"(CASE WHEN d < {half} THEN -{other} ELSE {other} END) * sin({angle}) AS y "
        f"FROM s, range(0, {heads}) a(h), range(0, {HEAD_DIM}) b(d))"
    )


def curve_sql(curves: dict[str, str]) -> str:
    parts = [
        f"{q6(f'{agg}({c})')} AS {n}_{agg}" for n, c in curves.items() for agg in ("min", "max", "avg")
    ]
    return f"WITH {CELLS_SQL} SELECT label, {', '.join(parts)} FROM cells GROUP BY label"


SIG = "(1.0 / (1.0 + exp(-x)))"
SIGB = f"(1.0 / (1.0 + exp(-{BETA} * x)))"
NORM = "sqrt(sum(x * x) OVER (PARTITION BY vec_id) / 64.0 + 1e-6)"
CLOSE_SINGLE = "abs(a.value - a.value::FLOAT::DOUBLE) <= greatest(1e-7 * greatest(abs(a.value), abs(a.value::FLOAT::DOUBLE)), 1e-6)"

ORACLES = {f"quant_{n}": f"WITH {BITS} SELECT vec_id, j::INT AS j, {c} AS code FROM bits" for n, c in CODES.items()} | {
    "quant_q8": f"WITH {GROWN} SELECT vec_id, j::INT AS j, q, w FROM q8",
    "dequant_q8": f"WITH {GROWN} SELECT vec_id, j::INT AS j, {q6('q * pow(2, w)')} AS val FROM q8",
    "quant_matrix": f"WITH {BITS}, {q8_sql('cells')} "
    + " UNION ALL ".join(
        f"SELECT vec_id, '{n}' AS format, sum({c})::BIGINT AS code_sum FROM bits GROUP BY vec_id" for n, c in CODES.items()
    )
    + " UNION ALL SELECT vec_id, 'q8', sum(q)::BIGINT FROM q8 GROUP BY vec_id",
    "quant_error": f"WITH {BITS}, {q8_sql('cells')}, gaps AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS format, label, abs(abs(x) - ({d})) AS gap FROM bits" for n, d in DECODED.items()
    )
    + " UNION ALL SELECT 'q8', label, abs(x - q * pow(2, w)) FROM q8) "
    f"SELECT format, label, {q6('max(gap)')} AS max_error, {q6('avg(gap)')} AS mean_error, count(*) AS n_finite "
    "FROM gaps GROUP BY format, label",
    "type_footprint": (
        "SELECT n_elements, format, bytes_per_element, n_elements * bytes_per_element AS total_bytes FROM "
        "(SELECT sum(len(embedding))::BIGINT AS n_elements FROM embeddings), (VALUES ('e8m23', 4.0::DOUBLE), "
        "('e5m10', 2.0), ('e8m7', 2.0), ('e4m3', 1.0), ('f32', 4.0), ('q8', 1.125)) v(format, bytes_per_element)"
    ),
    "shape_check": (
        "SELECT len(embedding)::INT AS width, count(*) AS n_rows, coalesce(len(embedding) = 64, false) AS matches "
        "FROM embeddings GROUP BY len(embedding)"
    ),
    "row_view": (
        "SELECT vec_id, r.j::INT AS j, " + q6("embedding[9 + r.j]::DOUBLE") + " AS val FROM embeddings, range(0, 8) r(j) "
        "WHERE vec_id IN (SELECT doc_id FROM labels)"
    ),
    "fill_matrix": f"WITH {CELLS_SQL} SELECT vec_id, j::INT AS j, 0.5::DOUBLE AS val FROM cells",
    "matmul": (
        f"WITH {CELLS_SQL}, {xavier_sql('m', CLASSES, WIDTH, SEED)} SELECT vec_id, i AS row, {q6('sum(x * w)')} AS val "
        "FROM cells JOIN m USING (j) GROUP BY vec_id, i"
    ),
    "matmul_blocks": (
        f"WITH {CELLS_SQL}, {xavier_sql('m', BLOCKED_ROWS, WIDTH, SEED)} SELECT vec_id, i AS row, {q6('sum(x * w)')} AS val "
        "FROM cells JOIN m USING (j) GROUP BY vec_id, i"
    ),
    "scoring_blocks": (
        f"WITH {CELLS_SQL}, qn AS (SELECT vec_id AS query_id, j, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id) / 64.0 + 1e-6) AS m "
        "FROM cells WHERE vec_id % 50 = 0), "
        "sc AS (SELECT query_id, vec_id, sum(x * m) AS score FROM cells JOIN qn USING (j) GROUP BY query_id, vec_id), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc) "
        f"SELECT query_id, vec_id, {q6('score')} AS score, rank::INT AS rank FROM r WHERE rank <= {TOP}"
    ),
    "residual_add": (
        f"WITH {CELLS_SQL} SELECT a.vec_id, a.j::INT AS j, {q6('a.x + b.x')} AS val FROM cells a "
        "JOIN cells b ON a.vec_id = b.vec_id AND b.j = 63 - a.j"
    ),
    "rmsnorm": (
        f"WITH {CELLS_SQL} SELECT vec_id, j::INT AS j, {q6('y')} AS val FROM "
        f"(SELECT vec_id, j, (1.0 + j / 64.0) * x / {NORM} AS y FROM cells)"
    ),
    "softmax": (
        f"WITH {CELLS_SQL}, p AS (SELECT vec_id, j, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM cells) "
        f"SELECT vec_id, j::INT AS j, {q6('y')} AS val FROM "
        "(SELECT vec_id, j, e / sum(e) OVER (PARTITION BY vec_id) AS y FROM p)"
    ),
    "softmax_by_group": (
        "WITH p AS (SELECT event_type, event_id, exp(value - max(value) OVER (PARTITION BY event_type)) AS e FROM events) "
        f"SELECT event_type, event_id, {q6('y')} AS p FROM "
        "(SELECT *, e / sum(e) OVER (PARTITION BY event_type) AS y FROM p)"
    ),
    "argmax_topk": (
        f"WITH {CELLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, j) AS rank FROM cells) "
        f"SELECT vec_id, rank::INT AS rank, j::INT AS idx, {q6('x')} AS val FROM r WHERE rank <= 3"
    ),
    "activation_profile": curve_sql(
        {"sigmoid": SIG, "relu": "greatest(x, 0.0)", "silu": f"x * {SIG}", "swish": f"x * {SIGB}"}
    ),
    "activation_gradients": curve_sql({
        "sigmoid": f"{SIG} * (1 - {SIG})", "relu": "CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0 END",
        "silu": f"{SIG} * (1 + x * (1 - {SIG}))", "swish": f"{SIGB} + x * {BETA} * {SIGB} * (1 - {SIGB})",
    }),
    "swiglu": (
        f"WITH {CELLS_SQL}, p AS (SELECT a.vec_id, a.j, a.x, b.x AS g FROM cells a JOIN cells b "
        "ON a.vec_id = b.vec_id AND b.j = 63 - a.j) SELECT vec_id, j::INT AS j, "
        f"{q6(f'x * {SIGB} * g')} AS y, {q6(f'({SIGB} + x * {BETA} * {SIGB} * (1 - {SIGB})) * g')} AS da, "
        f"{q6(f'x * {SIGB}')} AS dg FROM p"
    ),
    "embedding_lookup": (
        f"WITH {DOCS}, m AS MATERIALIZED (SELECT (k - 1) // 4 AS id, (k - 1) % 4 AS j, (2.0 * ("
        f"{lehmer_sql('k', SEED)} / 2147483647.0::DOUBLE) - 1.0) * sqrt(6.0::DOUBLE / (4 + (SELECT count(*) FROM ids))) AS w "
        "FROM (SELECT unnest(range(1, 4 * (SELECT count(*) FROM ids) + 1)) AS k)), "
        "wide AS (SELECT id, max(w) FILTER (j = 0) AS w0, max(w) FILTER (j = 1) AS w1, max(w) FILTER (j = 2) AS w2, "
        "max(w) FILTER (j = 3) AS w3 FROM m GROUP BY id), tok AS (SELECT doc_id, unnest(l) AS token, "
        "generate_subscripts(l, 1) - 1 AS pos FROM enc) SELECT doc_id, count(*) AS n, sum(pos)::BIGINT AS pos_sum, "
        + ", ".join(f"{q6(f'sum(w{j})')} AS v{j}" for j in range(4))
        + " FROM tok JOIN ids USING (token) JOIN wide USING (id) GROUP BY doc_id"
    ),
    "rotary": (
        f"WITH {ROWS}, {turned_sql('t', HEADS)} SELECT vec_id, (h * {HEAD_DIM} + d)::INT AS j, {q6('y')} AS val FROM t"
    ),
    "rotary_inverse": (
        f"WITH {ROWS}, {turned_sql('t', HEADS, '-')} SELECT vec_id, (h * {HEAD_DIM} + d)::INT AS j, {q6('y')} AS val FROM t"
    ),
    "causal_attention": (
        f"WITH {ROWS}, {turned_sql('q', HEADS)}, {turned_sql('k', KV_HEADS)}, "
        "dots AS (SELECT q.vec_id, q.h, k.vec_id AS at, sum(q.y * k.y) / sqrt(16.0::DOUBLE) AS z FROM q JOIN k "
        f"ON q.label = k.label AND q.d = k.d AND k.h = q.h // {HEADS // KV_HEADS} AND k.pos <= q.pos "
        "GROUP BY q.vec_id, q.h, k.vec_id), "
        "powers AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id, h)) AS e FROM dots), "
        "shares AS MATERIALIZED (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, h) AS p FROM powers), "
        f"v AS (SELECT vec_id AS at, h, d, embedding[{HEAD_DIM * KV_HEADS} + h * {HEAD_DIM} + d + 1]::DOUBLE AS y "
        f"FROM s, range(0, {KV_HEADS}) a(h), range(0, {HEAD_DIM}) b(d)) "
        f"SELECT shares.vec_id, (shares.h * {HEAD_DIM} + v.d)::INT AS j, {q6('sum(p * v.y)')} AS val FROM shares "
        f"JOIN v ON v.at = shares.at AND v.h = shares.h // {HEADS // KV_HEADS} GROUP BY shares.vec_id, shares.h, v.d"
    ),
    "gated_ffn": (
        f"WITH {CELLS_SQL}, {xavier_sql('w1', HIDDEN, WIDTH, 11)}, {xavier_sql('w2', WIDTH, HIDDEN, 12)}, "
        f"{xavier_sql('w3', HIDDEN, WIDTH, 13)}, n AS (SELECT vec_id, j, x, x / {NORM} AS y FROM cells), "
        "up AS (SELECT vec_id, w1.i, sum(y * w1.w) AS a, sum(y * w3.w) AS g FROM n JOIN w1 USING (j) "
        "JOIN w3 ON w3.i = w1.i AND w3.j = w1.j GROUP BY vec_id, w1.i), "
        "down AS (SELECT vec_id, w2.i AS j, sum(a * g / (1.0 + exp(-g)) * w2.w) AS y FROM up JOIN w2 ON w2.j = up.i "
        f"GROUP BY vec_id, w2.i) SELECT vec_id, j::INT AS j, {q6('cells.x + down.y')} AS val FROM cells JOIN down USING (vec_id, j)"
    ),
    "tied_scoring": (
        f"WITH {CELLS_SQL}, c AS (SELECT label, j, avg(x) AS m FROM cells GROUP BY label, j), "
        "qn AS (SELECT label, j, m / sqrt(sum(m * m) OVER (PARTITION BY label) / 64.0 + 1e-6) AS m FROM c), "
        "sc AS (SELECT qn.label, vec_id, sum(x * m) AS score FROM cells JOIN qn USING (j) GROUP BY qn.label, vec_id), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM sc) "
        f"SELECT label, vec_id, {q6('score')} AS score, rank::INT AS rank FROM r WHERE rank <= {TOP}"
    ),
    "table_reconcile": (
        "WITH l AS (SELECT l_orderkey AS k, sum((1 - l_discount) * (1 + l_tax) * l_extendedprice) AS v FROM lineitem "
        "GROUP BY l_orderkey) SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l.k IS NULL THEN 'left_only' "
        "WHEN o_orderkey IS NULL THEN 'right_only' WHEN abs(o_totalprice - l.v) <= "
        "greatest(1e-15 * greatest(abs(o_totalprice), abs(l.v)), 0.01) THEN 'close' ELSE 'differs' END AS outcome "
        "FROM orders FULL JOIN l ON l.k = o_orderkey) GROUP BY outcome"
    ),
    "reconcile_single": (
        f"SELECT CASE WHEN {CLOSE_SINGLE} THEN 'close' ELSE 'differs' END AS outcome, count(*) AS n FROM events a GROUP BY 1"
    ),
    "clamp_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", sum((x <> y)::INT)::BIGINT AS n_changed, {q6('min(x)')} AS min_before, "
        f"{q6('max(x)')} AS max_before, {q6('min(y)')} AS min_after, {q6('max(y)')} AS max_after, {q6('sum(y)')} AS sum_after, "
        f"{(a + b) / 2}::DOUBLE AS midpoint FROM (SELECT {c} AS x, greatest({min(a, b)}, least({max(a, b)}, {c}))::DOUBLE AS y "
        "FROM lineitem)" for c, (a, b) in BOUNDS.items()
    ),
}


def _projected_sql(name: str, rotate: bool) -> str:
    """CTE ``name(vec_id, label, pos, h, d, y)``: heads of the projected rows, rotated by their position."""
    half = HEAD_DIM // 2
    raw = f"{name}_raw AS MATERIALIZED (SELECT vec_id, label, pos, w{name}.i AS i, sum(y * w{name}.w) AS z FROM n JOIN w{name} USING (j) GROUP BY ALL)"
    if not rotate:
        return f"{raw}, {name} AS (SELECT vec_id, label, pos, i // {HEAD_DIM} AS h, i % {HEAD_DIM} AS d, z AS y FROM {name}_raw)"
    angle = f"a.pos * pow(10000.0, -(a.i % {half}) / {HEAD_DIM}.0)"
    return (
        f"{raw}, {name} AS MATERIALIZED (SELECT a.vec_id, a.label, a.pos, a.i // {HEAD_DIM} AS h, a.i % {HEAD_DIM} AS d, a.z * cos({angle}) + "
        f"(CASE WHEN a.i % {HEAD_DIM} < {half} THEN -b.z ELSE b.z END) * sin({angle}) AS y FROM {name}_raw a JOIN {name}_raw b "
        f"ON a.vec_id = b.vec_id AND b.i = a.i // {HEAD_DIM} * {HEAD_DIM} + (a.i + {half}) % {HEAD_DIM})"
    )


ORACLES["attention_block"] = (
    f"WITH {CELLS_SQL}, {ROWS}, "
    + ", ".join(xavier_sql(name, ATTENTION_ROWS[name], WIDTH, seed) for name, seed in ATTENTION_SEEDS.items())
    + f", n AS MATERIALIZED (SELECT vec_id, s.label, pos, j, x / {NORM} AS y FROM cells JOIN s USING (vec_id)), "
    + f"{_projected_sql('q', True)}, {_projected_sql('k', True)}, {_projected_sql('v', False)}, "
    "dots AS (SELECT q.vec_id, q.h, k.vec_id AS at, sum(q.y * k.y) / sqrt(16.0::DOUBLE) AS z FROM q JOIN k "
    f"ON q.label = k.label AND q.d = k.d AND k.h = q.h // {HEADS // KV_HEADS} AND k.pos <= q.pos GROUP BY q.vec_id, q.h, k.vec_id), "
    "powers AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id, h)) AS e FROM dots), "
    "shares AS MATERIALIZED (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, h) AS p FROM powers), "
    f"o AS MATERIALIZED (SELECT shares.vec_id, shares.h * {HEAD_DIM} + v.d AS j, sum(p * v.y) AS y FROM shares JOIN v "
    f"ON v.vec_id = shares.at AND v.h = shares.h // {HEADS // KV_HEADS} GROUP BY ALL), "
    "down AS (SELECT vec_id, wo.i AS j, sum(y * wo.w) AS y FROM o JOIN wo USING (j) GROUP BY ALL) "
    f"SELECT vec_id, j::INT AS j, {q6('cells.x + down.y')} AS val FROM cells JOIN down USING (vec_id, j)"
)
ORACLES["matmul_by_join"] = ORACLES["matmul"]
ORACLES |= {
    f"dequant_{n}": f"WITH {BITS} SELECT vec_id, j::INT AS j, {q6(f'CASE WHEN s = 1 THEN -1.0 ELSE 1.0 END * CASE WHEN x = 0 THEN 0.0 ELSE {d} END')} "
    "AS val FROM bits" for n, d in DECODED.items()
}


def _product_sql(vectors: str, matrix: str) -> str:
    return (
        f"SELECT v.vec_id, m.vec_id::INT AS row, {q6('sum(v.y * m.y)')} AS val FROM ({vectors}) v JOIN ({matrix}) m "
        "USING (j) GROUP BY v.vec_id, m.vec_id"
    )


def _bits_sql(source: str, name: str) -> str:
    """Common table ``name`` with the exponent and mantissa of every element of ``source(vec_id, j, x)``."""
    return (
        f"{name}_e AS (SELECT *, {LOGB.format(x='abs(x)')} AS e FROM {source}), {name} AS MATERIALIZED (SELECT *, CASE WHEN x = 0 "
        f"THEN 0 ELSE ((abs(x) / pow(2, e) - 1) * 8388608)::BIGINT END AS m FROM {name}_e)"
    )


_LARGE_CODES = {
    "e4m3": "(s << 7) | (least(greatest(e + 7, 0), 15) << 3) | (CASE WHEN e + 7 > 15 THEN 0 ELSE m >> 20 END)",
    "e5m10": "(s << 15) | (least(greatest(e + 15, 0), 31) << 10) | (m >> 13)",
}
ORACLES["quant_overflow"] = (
    f"WITH {CELLS_SQL}, "
    + ", ".join(
        f"{n}_x AS (SELECT vec_id, j, (x < 0)::BIGINT AS s, (x * {scale})::FLOAT::DOUBLE AS x FROM cells), {_bits_sql(f'{n}_x', f'{n}_b')}"
        for n, scale in LARGE.items()
    )
    + " "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS format, vec_id, j::INT AS j, CASE WHEN x = 0 THEN 0 ELSE {c} END AS code FROM {n}_b" for n, c in _LARGE_CODES.items()
    )
)
_WEIGHTS = (
    f"{xavier_sql('w0', CLASSES, WIDTH, SEED)}, w1 AS (SELECT i AS vec_id, 0 AS label, j::BIGINT AS j, w::FLOAT::DOUBLE AS x FROM w0)"
)
_E4M3 = f"CASE WHEN x < 0 THEN -1.0 ELSE 1.0 END * CASE WHEN x = 0 THEN 0.0 ELSE {DECODED['e4m3']} END AS y"
ORACLES["matmul_e4m3"] = (
    f"WITH {CELLS_SQL}, grown AS (SELECT vec_id, label, j, (x * {SCALE})::FLOAT::DOUBLE AS x FROM cells), {_WEIGHTS}, "
    f"{_bits_sql('grown', 'gb')}, {_bits_sql('w1', 'wb')} "
    + _product_sql(f"SELECT vec_id, j, {_E4M3} FROM gb", f"SELECT vec_id, j, {_E4M3} FROM wb")
)
_WQ8 = q8_sql("w1").replace("top AS", "wtop AS").replace("FROM top", "FROM wtop").replace("shared AS", "wshared AS").replace(
    "FROM shared", "FROM wshared").replace("q8 AS MATERIALIZED", "wq8 AS MATERIALIZED")
ORACLES["matmul_q8"] = (
    f"WITH {GROWN}, {_WEIGHTS}, {_WQ8} "
    + _product_sql("SELECT vec_id, j, q * pow(2, w) AS y FROM q8", "SELECT vec_id, j, q * pow(2, w) AS y FROM wq8")
)
