"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked: scaled in turn so
that their sums over each dimension meet that dimension's targets. A document is
then kept with the probability that its cell's weight asks for. DataFrame
functions only; all that is iterated over is the table of cells, whose sums are
aggregated before they are shuffled; sweeps end when every sum meets its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import BROADCAST_ROWS, cut, fresh, join_hot

SWEEPS = 60  # at most
TOLERANCE = 1e-9  # by which share the sums may miss their targets
TEMPERATURE = 0.8
SEED = "mix-1"

#: a document's topic, by what its text holds (the same expression in Spark's SQL and DuckDB's)
TOPIC = """CASE WHEN contains(text, 'icense') THEN 'legal'
    WHEN contains(text, ' | ') THEN 'table'
    WHEN contains(text, '@') THEN 'contact'
    ELSE 'prose' END"""

#: a text's tokens, as words that a space separates
TOKENS = "CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END"

DIMS = ["source", "lang", "topic"]


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _targets(cells: DataFrame, dim: str, tokens: str, temperature: float, given: DataFrame | None) -> DataFrame:
    """(value, target) of each value of a dimension, scaled to the sum of all tokens."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum(F.col(tokens).cast("double")).alias("has"))
    if given is None:
        out = sums.select("value", "has", F.pow("has", F.lit(temperature)).alias("target"))
    else:
        asked = given.select(F.col("value").alias("asked"), F.col("target").cast("double").alias("target"))
        out = sums.join(asked, F.col("value").eqNullSafe(F.col("asked")), "left").select("value", "has", F.coalesce("target", F.lit(0.0)).alias("target"))
    out = cut(out)
    total, asked_for = out.agg(F.sum("has"), F.sum("target")).first()
    return out.select("value", (F.col("target") * F.lit(float(total or 0)) / F.lit(float(asked_for or 1) or 1.0)).alias("target"))


def rake(cells: DataFrame, dims: list[str], tokens: str = "tokens", temperature: float = TEMPERATURE, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with a column weight (double), raked from ``tokens``.

    The target of a dimension's value is its row (value, target) in ``targets``
    or else its share of tokens to the power of ``temperature``; targets are
    scaled to the sum of all tokens. Values that a targets table lacks get
    none. Null values of a dimension are one value of their own; cells without
    tokens keep weight zero. Sweeps over the dimensions end when no sum misses
    its target by more than ``tolerance``, or after ``sweeps``, as targets that
    contradict each other are never all met.
    """
    wanted = [_targets(cells, d, tokens, temperature, (targets or {}).get(d)) for d in dims]
    out = cells.withColumn("weight", F.col(tokens).cast("double"))
    for _ in range(sweeps):
        out = out.withColumn("_moved", F.lit(0.0))
        for d, want in zip(dims, wanted, strict=True):
            sums = out.groupBy(F.col(d).alias("_of")).agg(F.sum("weight").alias("_has"))
            # cut, a row a value: otherwise the plan of each dimension holds that of the one before twice
            by = cut(sums.join(want, F.col("_of").eqNullSafe(F.col("value"))).select("_of", F.when(F.col("_has") > 0, F.col("target") / F.col("_has")).alias("_by")))
            out = out.join(by, F.col(d).eqNullSafe(F.col("_of"))).withColumn("weight", F.coalesce(F.col("weight") * F.col("_by"), F.lit(0.0))).withColumn("_moved", F.greatest("_moved", F.abs(F.col("_by") - 1))).drop("_of", "_by")
        out = cut(out)
        # a sweep that moved no sum has met all targets before it began
        moved = out.agg(F.max("_moved")).first()[0]
        out = out.drop("_moved")
        if moved is None or moved <= tolerance:
            break
    return out


def calibrated(docs: DataFrame, dims: list[str], size: Column, temperature: float = TEMPERATURE, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(dims, tokens, rows, weight, p) per cell of ``docs``: p, the probability to
    keep a document, is the cell's weight per token over the largest such, so that
    kept tokens have the raked proportions and none would be needed twice. Cells
    without tokens have p 1. An empty table has no cells; null sizes count as 0."""
    cells = cut(docs.groupBy(*dims).agg(F.coalesce(F.sum(size), F.lit(0)).alias("tokens"), F.count("*").alias("rows")))
    raked = rake(cells, dims, "tokens", temperature, sweeps, targets)
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    top = raked.agg(F.max(factor)).first()[0]
    return raked.withColumn("p", F.when(F.col("tokens") > 0, factor / F.lit(float(top or 1) or 1.0)).otherwise(F.lit(1.0)))


def sample(docs: DataFrame, cells: DataFrame, dims: list[str], id_col: str, seed: str = SEED, p: str = "p", kept: str = "kept") -> DataFrame:
    """``docs`` with ``p`` and ``kept`` (boolean): kept where a number drawn from
    the id lies below p. Rows of one id share their draw; null ids draw as 'null'.

    Up to BROADCAST_ROWS cells go to every task. Of more cells, those that hold
    many documents still do; the documents of the others are shuffled."""
    name = fresh(docs, "cell")
    of_cell = F.to_json(F.struct(*(F.col(d).cast("string").alias(str(k)) for k, d in enumerate(dims))))  # leaves nulls out
    c = cells.select(of_cell.alias(name), F.col("p").alias(p), "rows")
    keyed = docs.withColumn(name, of_cell)
    n, total = cells.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    joined = keyed.join(F.broadcast(c.drop("rows")), name) if n <= BROADCAST_ROWS else join_hot(keyed, c, name, "rows", total)
    return joined.drop(name).withColumn(kept, uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), seed) < F.col(p))


SQL_SWEEPS = 12  # enough to meet all targets of the given tables


def cells_sql(documents: str, sweeps: int = SQL_SWEEPS, temperature: float = TEMPERATURE) -> str:
    """DuckDB's WITH list that ends in table p (dims, p), the same raking as a
    chain of common tables, one a step, for as many sweeps as targets need; ``documents`` is the table or query."""
    names = ", ".join(DIMS)
    steps = [
        f"d AS (SELECT *, {TOPIC} AS topic, {TOKENS} AS tokens FROM {documents})",
        f"c AS (SELECT {names}, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for x in DIMS:
        steps.append(f"t_{x} AS (SELECT {x}, pow(sum(tokens), {temperature}) AS t FROM c GROUP BY {x})")
        steps.append(f"g_{x} AS (SELECT {x} AS y, t * (SELECT sum(tokens) FROM c) / (SELECT sum(t) FROM t_{x}) AS t FROM t_{x})")
    steps.append("w0 AS (SELECT *, tokens AS w FROM c)")
    for k, x in enumerate(DIMS * sweeps):
        steps.append(
            f"w{k + 1} AS MATERIALIZED (SELECT w{k}.* REPLACE (CASE WHEN s > 0 THEN w * t / s ELSE 0 END AS w) FROM w{k} "
            f"JOIN (SELECT {x} AS x, sum(w) AS s FROM w{k} GROUP BY {x}) ON x IS NOT DISTINCT FROM w{k}.{x} JOIN g_{x} ON y IS NOT DISTINCT FROM w{k}.{x})"
        )
    last = f"w{len(DIMS) * sweeps}"
    steps.append(f"p AS (SELECT {names}, CASE WHEN tokens > 0 THEN (w / tokens) / (SELECT max(CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END) FROM {last}) ELSE 1 END AS p FROM {last})")
    return ",\n".join(steps)


#: DuckDB: the draw of the row's doc_id, and the join of d and p
DRAW_SQL = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / pow(2.0, 48)"
JOIN_SQL = "d JOIN p ON " + " AND ".join(f"d.{x} IS NOT DISTINCT FROM p.{x}" for x in DIMS)
