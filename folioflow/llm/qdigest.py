"""Problem 6: percentiles with a deterministic rank error that merge across days and partitions.

Values are quantized to a bounded ordered universe of ``2 ** bits`` cells. A digest is a set of nodes of the dyadic tree
over the cells with counts. Compression keeps a node when at least ``tau = floor(eps * n / (2 * bits))`` values (at
least 1) lie under it; values under lighter nodes count at their deepest kept ancestor. A kept inner node then holds
less than ``2 * tau`` values of its own, a path has at most ``bits`` inner nodes, so any rank is off by at most
``eps * n``. Two digests merge by adding the counts of equal nodes; the bound of the sum is the sum of the bounds, again
``eps * n``. All steps are groupings with map-side sums: first by cell, then by node, so a group with a third of all
rows is reduced to at most ``2 ** bits`` counts before anything moves.

Null, NaN and negative values are not measured; they are counted in ``unusable``. Empty tables give empty results. Keys
may be null and form their own group. Exact duplicate rows count once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Universe:
    """Order-preserving map of [0, hi] to ``2 ** bits`` cells; ``log`` makes cells of equal ratio above one unit."""

    hi: float
    bits: int = 16
    log: bool = False

    def cell(self, x: Column) -> Column:
        y = F.log1p(x) / math.log1p(self.hi) if self.log else x / self.hi
        return F.least(F.floor(y * (1 << self.bits)), F.lit((1 << self.bits) - 1)).cast("bigint")

    def upper(self, cell: Column) -> Column:
        y = (cell + 1) / float(1 << self.bits)
        return F.expm1(y * math.log1p(self.hi)) if self.log else y * self.hi


def digest(df: DataFrame, keys: list[str], value: str, u: Universe, eps: float = 0.01) -> DataFrame:
    """Rows (keys, level, node, own, n; keys may not have these names): the digest of ``value`` for every group of ``keys``. ``node`` counts from 0 in its level."""
    leaves = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0)).groupBy(*keys, u.cell(F.col(value)).alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))
    level = F.explode(F.sequence(F.lit(0), F.lit(u.bits)))
    nodes = leaves.select(*keys, "_cell", "_c", level.alias("level")).groupBy(*keys, "level", F.expr(f"shiftright(_cell, {u.bits} - level)").alias("node")).agg(F.sum("_c").alias("_under"))
    n = F.sum(F.when(F.col("level") == 0, F.col("_under"))).over(Window.partitionBy(*keys))
    heavy = nodes.withColumn("n", n).where(F.col("_under") >= F.greatest(F.floor(F.col("n") * eps / (2 * u.bits)), F.lit(1)))
    # own count: what is under a node less what is under its kept children
    parts = F.explode(F.array(F.struct("level", "node", F.col("_under").alias("d")), F.struct((F.col("level") - 1).alias("level"), F.expr("shiftright(node, 1)").alias("node"), (-F.col("_under")).alias("d"))))
    own = heavy.select(*keys, "n", parts.alias("_p")).where("_p.level >= 0").groupBy(*keys, "n", F.col("_p.level").alias("level"), F.col("_p.node").alias("node")).agg(F.sum("_p.d").alias("own"))
    return own.where("own > 0").select(*keys, "level", "node", "own", "n")


def merge(digests: DataFrame, keys: list[str]) -> DataFrame:
    """Merge digests to coarser ``keys`` by adding the counts of equal nodes."""
    added = digests.groupBy(*keys, "level", "node").agg(F.sum("own").alias("own"))
    return added.withColumn("n", F.sum("own").over(Window.partitionBy(*keys)))


def quantiles(digests: DataFrame, keys: list[str], u: Universe, probs: tuple[float, ...], eps: float) -> DataFrame:
    """One row per group: n, rank error bound, and a column per probability (upper end of the cell)."""
    right = F.expr(f"shiftleft(node + 1, {u.bits} - level) - 1")
    order = Window.partitionBy(*keys).orderBy("_right", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    c = digests.withColumn("_right", right).withColumn("_upto", F.sum("own").over(order))
    cells = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("n") * p), F.col("_right"))).alias(f"_q{i}") for i, p in enumerate(probs)]
    g = c.groupBy(*keys).agg(F.max("n").alias("n"), *cells)
    return g.select(*keys, "n", F.floor(F.col("n") * eps).cast("bigint").alias("rank_error"), *[F.round(u.upper(F.col(f"_q{i}")), 9).alias(f"p{round(100 * p)}") for i, p in enumerate(probs)])


PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
EPS = 0.01
CONFIDENCE = Universe(hi=1.0)
ELAPSED = Universe(hi=1e6, log=True)


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, value): percent values are brought to shares."""
    return scaled(table(spark, sf_dir, "blocks").select("block_id", "label", "confidence").distinct()).select("label", "value")


def scaled(b: DataFrame) -> DataFrame:
    v = F.col("confidence")
    return b.withColumns({"label": F.lower(F.trim("label")), "value": F.when((v > 1) & (v <= 100), v / 100).when(v <= 1, v)})


def elapsed(spark: SparkSession, sf_dir: str, more: list[str] | None = None) -> DataFrame:
    """(extractor, day, value): the latest record of each extraction; the day is that of the UTC time."""
    e = table(spark, sf_dir, "extractions").groupBy("extraction_id").agg(F.max_by(F.struct("processed_at", "elapsed_seconds", "extractor"), F.struct("received_at", "processed_at", "elapsed_seconds")).alias("r"))
    at = F.regexp_replace(F.col("r.processed_at"), r"(\.\d{6})\d+", "$1")
    zoned = F.when(at.rlike(r"(Z|[+-]\d\d:?\d\d)$"), at).otherwise(F.concat(at, F.lit("Z")))
    day = F.floor(F.unix_seconds(zoned.try_cast("timestamp")) / 86400)
    return e.select(*(more or []), F.col("r.extractor").alias("extractor"), day.alias("day"), F.col("r.elapsed_seconds").alias("value"))


def with_unusable(q: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    bad = F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0)
    u = values.groupBy(*keys).agg(F.sum(bad.cast("bigint")).alias("unusable"))
    cond = [q[k].eqNullSafe(F.col(f"u_{k}")) for k in keys]
    u = u.select(*[F.col(k).alias(f"u_{k}") for k in keys], "unusable")
    return u.join(q, cond, "left").select(*[F.col(f"u_{k}").alias(k) for k in keys], F.coalesce("n", F.lit(0)).alias("n"), "unusable", F.coalesce("rank_error", F.lit(0)).alias("rank_error"), *[c for c in q.columns if c[0] == "p"])


def p6_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form: digests of confidence per label and day and of elapsed seconds per extractor and day, ready to merge."""
    days = elapsed(spark, sf_dir, ["extraction_id"]).select("extraction_id", "day")
    b = table(spark, sf_dir, "blocks").select("block_id", "extraction_id", "label", "confidence").distinct()
    v = scaled(b).join(days, "extraction_id", "left")
    out = []
    for measure, df, key, u in (("confidence", v, "label", CONFIDENCE), ("elapsed_seconds", elapsed(spark, sf_dir), "extractor", ELAPSED)):
        d = digest(df, [key, "day"], "value", u, EPS)
        out.append(d.select(F.lit(measure).alias("measure"), F.col(key).alias("key"), "day", "level", "node", "own", "n"))
    return out[0].unionByName(out[1])


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = confidences(spark, sf_dir)
    return with_unusable(quantiles(digest(v, ["label"], "value", CONFIDENCE, EPS), ["label"], CONFIDENCE, PROBS, EPS), v, ["label"])


def p6_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["extractor", "day"]
    v = elapsed(spark, sf_dir)
    return with_unusable(quantiles(digest(v, keys, "value", ELAPSED, EPS), keys, ELAPSED, PROBS, EPS), v, keys)


def p6_elapsed_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per extractor over all days, from the digests of the days only."""
    days = digest(elapsed(spark, sf_dir), ["extractor", "day"], "value", ELAPSED, EPS)
    return quantiles(merge(days, ["extractor"]), ["extractor"], ELAPSED, PROBS, EPS)


def _sql(source: str, keys: list[str], u: Universe, merged: list[str] | None = None, stored: str | None = None) -> str:
    """The digest in DuckDB's SQL: percentiles, or its nodes under the name of the measure ``stored``."""
    k, out = ", ".join(keys), ", ".join(merged or keys)
    y = f"ln(1 + value) / {math.log1p(u.hi)!r}::double" if u.log else f"value / {u.hi}"
    up = (lambda c: f"exp(({c} + 1) / {1 << u.bits}.0::double * {math.log1p(u.hi)!r}::double) - 1") if u.log else (lambda c: f"({c} + 1) / {1 << u.bits}.0::double * {u.hi}")
    bits = u.bits
    cells = ", ".join(f"min(case when upto >= ceil(n * {p}::double) then rgt end) as c{i}" for i, p in enumerate(PROBS))
    cols = ", ".join(f"round({up(f'c{i}')}, 9) as p{round(100 * p)}" for i, p in enumerate(PROBS))
    tail = f"""select {", ".join("v." + x for x in keys)}, coalesce(n, 0)::bigint as n, unusable, coalesce(floor(n * {EPS}::double), 0)::bigint as rank_error, {cols}
from (select {k}, sum(case when value is null or value::varchar = 'nan' or value < 0 then 1 else 0 end)::bigint as unusable from v group by {k}) v
left join q on {" and ".join(f"v.{x} is not distinct from q.{x}" for x in keys)}"""
    if merged:
        tail = f"select {out}, n::bigint as n, floor(n * {EPS}::double)::bigint as rank_error, {cols} from q"
    if stored:
        tail = f"select '{stored}' as measure, {keys[0]} as key, {keys[1]}, level, node, own, n::bigint as n from merged"
    return f"""with v as ({source}),
leaves as (select {k}, least(floor({y} * {1 << bits}), {(1 << bits) - 1})::bigint as cell, count(*) as c from v where value is not null and value::varchar <> 'nan' and value >= 0 group by all),
nodes as (select {k}, level, cell >> ({bits} - level) as node, sum(c)::bigint as under from leaves, (select unnest(range({bits + 1}))::int as level) group by all),
heavy as (select *, sum(case when level = 0 then under end) over (partition by {k}) as n from nodes qualify under >= greatest(floor(n * {EPS}::double / {2 * bits}), 1)),
own as (select {k}, level, node, sum(d)::bigint as own from (select {k}, level, node, under as d from heavy union all select {k}, level - 1, node >> 1, -under from heavy where level > 0) group by all having sum(d) > 0),
merged as (select {out}, level, node, sum(own)::bigint as own, sum(sum(own)) over (partition by {out}) as n from own group by {out}, level, node),
ranked as (select {out}, n, ((node + 1) << ({bits} - level)) - 1 as rgt, sum(own) over (partition by {out} order by ((node + 1) << ({bits} - level)) - 1, level desc rows unbounded preceding) as upto from merged),
q as (select {out}, max(n) as n, {cells} from ranked group by {out})
{tail}"""


CONFIDENCE_SQL = "select lower(trim(label)) as label, case when confidence > 1 and confidence <= 100 then confidence / 100 when confidence <= 1 then confidence end as value from (select distinct block_id, label, confidence from blocks)"
ELAPSED_SQL = r"""select extractor, floor(epoch(try_cast(case when regexp_matches(p, '(Z|[+-]\d\d:?\d\d)$') then p else p || 'Z' end as timestamptz)) / 86400)::bigint as day, elapsed_seconds as value
from (select extractor, elapsed_seconds, regexp_replace(processed_at, '(\.\d{6})\d+', '\1') as p from extractions qualify row_number() over (partition by extraction_id order by received_at desc nulls last, processed_at desc nulls last, elapsed_seconds desc nulls last) = 1)"""


def oracle_sql() -> dict[str, str]:
    days = f"(select extraction_id, day from ({ELAPSED_SQL.replace('select extractor, floor', 'select extraction_id, extractor, floor').replace('(select extractor, elapsed', '(select extraction_id, extractor, elapsed')}))"
    shares = f"select lower(trim(b.label)) as label, e.day, case when confidence > 1 and confidence <= 100 then confidence / 100 when confidence <= 1 then confidence end as value from (select distinct block_id, extraction_id, label, confidence from blocks) b left join {days} e on b.extraction_id = e.extraction_id"
    return {
        "p6_digests": f"({_sql(shares, ['label', 'day'], CONFIDENCE, stored='confidence')}) union all ({_sql(ELAPSED_SQL, ['extractor', 'day'], ELAPSED, stored='elapsed_seconds')})",
        "p6_confidence": _sql(CONFIDENCE_SQL, ["label"], CONFIDENCE),
        "p6_elapsed": _sql(ELAPSED_SQL, ["extractor", "day"], ELAPSED),
        "p6_elapsed_merged": _sql(ELAPSED_SQL, ["extractor", "day"], ELAPSED, ["extractor"]),
    }
