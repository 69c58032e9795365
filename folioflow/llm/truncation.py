"""Problem 10: texts cut off by field limits or in transfer, and how often each source cuts.

Lengths are read as discrete lifetimes. For each source and unit (characters, bytes) the hazard of a length is the
share of the texts still running that end exactly there; windows give the hazards of the neighbouring lengths, a
Poisson tail gives the chance of so many endings if the neighbours' hazard held, and the Benjamini-Hochberg procedure
over all lengths of all sources picks those at which a source cuts. At such a length any ending that is not complete is a
cut (``by`` is 'limit'). Elsewhere the text must show it by itself: something appended at the cut ('mark'), or an open word
or sentence in running text ('ending'); these are counted apart.

Null and empty texts are not cut. Copies of a document are each reported. The source may be null; such rows form one
source. Texts are read once: what an ending shows is judged in the scan, and only numbers about it, one row per document,
are shuffled. The step-up procedure needs no ordering of all tests: chances are rounded up to one of ``Params.steps`` per
power of e, which keeps the error rate, and their histogram, of bounded size, gives the threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import written
from .common import table
from .sentences import NEVER_FINAL


@dataclass(frozen=True)
class Params:
    neighbours: int = 40  # lengths on either side that give the expected hazard
    fdr: float = 0.001
    steps: int = 64  # values of a chance that are told apart, per power of e
    support: int = 3  # documents of different length ending in the same line that make the line a complete one


#: What pipelines append where they cut.
APPENDED = r"(?i)(?:\s*(?:\.{3,}|…|\[(?:\.{3}|…|truncated|cut|more|gekürzt|обрезано|tronqué|truncado)[^\]\n]{0,20}\]|\((?:truncated|continued|more|cont\.)\)|<(?:br|p|/)?[^<>\n]{0,8}|&[a-z#0-9]{0,5}|read more))+\s*$"
LONGEST_APPENDED = 40  # no single part of what is appended is longer
FINAL = r"(?:[.!?؟।…。！？｡．]|\.{3})[\"'”»“)」』\]\s]*$"
PAGE_NUMBER = r"(?i)^\s*(?:[-–—\[(]?\s*(?:\d{1,5}|[ivxlc]{1,7})\s*[-–—\])]?|(?:page|p\.|seite|s\.|página|pág\.|страница|стр\.|сторінка|стор\.|лист|аркуш|pag\.?)\s*\d+(?:\s*(?:of|von|de|sur|из|з|/)\s*\d+)?)\s*$"
SIGNATURE = r"^\s*[\p{Lu}][^\n]{2,60},\s*\d{4}\s*$"
APPENDIX = r"^\s*\p{Lu}\p{L}{3,14}\s+[\p{Lu}\d]\s*$"
ITEM = r"^\s*(?:[•*–—‣◦▪·-]\s|\(?(?:\p{L}|\d{1,3})[.)]\s|\[\d{1,3}\]\s)"
ROW = r"(?:</(?:table|tr|tbody|td)>|\|)\s*$|^\s*[\d.,%\s]+$|\.{4,}\s*\d+\s*$|(?:\s{2,}|[;\t])\d[\d.,%]*\s*$"
REFERENCE = r"^\s*\[\d+\].*\d{4}\s*$"


UNSTOPPED = r"[\u0E01-\u0EFF\u1000-\u109F\u1780-\u17FF]\s*$"  # Thai, Lao, Burmese, Khmer


def hazards(lengths: DataFrame, p: Params = Params()) -> DataFrame:
    """``lengths``: source, unit, n. Rows (source, unit, n, ends, at_risk, expected, p_value, significant) per occurring length."""
    per = lengths.groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("ends"))
    by = Window.partitionBy("source", "unit").orderBy("n")
    near = by.rangeBetween(-p.neighbours, p.neighbours)
    h = per.withColumn("at_risk", F.sum("ends").over(Window.partitionBy("source", "unit").orderBy(F.desc("n"))))
    h = h.withColumn("around", (F.sum("ends").over(near) - F.col("ends")) / F.lit(2.0 * p.neighbours))
    h = h.withColumn("risk_around", F.avg("at_risk").over(near))
    # the hazard around, but never under one ending among all neighbours
    h = h.withColumn("expected", F.greatest(F.col("around"), F.lit(1.0 / (2 * p.neighbours))) / F.greatest("risk_around", "at_risk") * F.col("at_risk"))
    # Chernoff bound of the Poisson tail P(X >= ends)
    k, lam = F.col("ends"), F.col("expected")
    h = h.withColumn("p_value", F.when(k > lam, F.exp(k - lam - k * F.log(k / lam))).otherwise(F.lit(1.0)))
    # rounded up, never under the smallest positive double: at most 745 * steps values, whatever the number of tests
    h = written(h.withColumn("step", F.floor(-F.log(F.greatest("p_value", F.lit(1e-300))) * p.steps).cast("int")), "hazards")
    last = threshold({(r.unit, r.step): r["count"] for r in h.groupBy("unit", "step").count().collect()}, p)
    lows = F.create_map(*[F.lit(x) for kv in last.items() for x in kv]) if last else F.create_map().cast("map<string,int>")
    h = h.withColumn("significant", F.coalesce(F.col("step") >= F.try_element_at(lows, F.col("unit")), F.lit(False)))
    return h.select("source", "unit", "n", "ends", "at_risk", F.round("expected", 6).alias("expected"), F.round("p_value", 12).alias("p_value"), "significant")


def threshold(counts: dict[tuple[str, int], int], p: Params = Params()) -> dict[str, int]:
    """Least step of the significant tests of each unit, by the step-up procedure over the histogram of steps."""
    out = {}
    for unit in {u for u, _ in counts}:
        steps = sorted(((s, n) for (u, s), n in counts.items() if u == unit), reverse=True)
        tests, rank = sum(n for _, n in steps), 0
        for s, n in steps:
            rank += n
            if s > 0 and math.exp(-s / p.steps) <= p.fdr * rank / tests:
                out[unit] = s
    return out


def _last(lines: Column, back: int) -> Column:
    return F.coalesce(F.get(lines, F.size(lines) - back), F.lit(""))


def endings(docs: DataFrame) -> DataFrame:
    """One row per document about how its text ends; no part of the text but the last letters of unspaced scripts is kept."""
    text = F.col("text")
    whole = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    d = docs.where("length(text) > 0 and doc_id is not null").select("doc_id", "source", F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), whole.alias("t"))
    # whatever was appended has its last part among the last signs: texts without one need no search from their start
    d = d.withColumn("body", F.when(F.right("t", F.lit(LONGEST_APPENDED)).rlike(APPENDED), F.regexp_replace("t", APPENDED, "")).otherwise(F.col("t"))).withColumn("appended", (F.length("body") < F.length("t")) & (F.length("body") > 0))
    d = d.withColumn("body", F.when(F.col("appended"), F.col("body")).otherwise(F.col("t")))
    lines = F.split(F.substring_index("body", "\n", -4), "\n")
    # scripts without full stops: endings of all their parts between spaces
    tails = F.when(F.col("t").rlike(UNSTOPPED), F.transform(F.filter(F.split("t", r"\s+"), lambda x: x.rlike(UNSTOPPED)), lambda x: F.right(x, F.lit(6))))
    d = d.select("doc_id", "source", "chars", "bytes", "appended", lines.alias("ls"), tails.alias("tails"))
    d = d.select("doc_id", "source", "chars", "bytes", "appended", "tails", _last(F.col("ls"), 1).alias("line"), _last(F.col("ls"), 2).alias("before"), _last(F.col("ls"), 3).alias("before2"))
    c = F.col
    line, short = c("line"), lambda x: F.length(x) < 45
    word = F.lower(F.regexp_extract(line, r"([\p{L}]+)\.$", 1))
    items = ~c("before").rlike(FINAL) & ~c("before2").rlike(FINAL) & short(c("before")) & short(line) & (c("before") != "") & (c("before2") != "") & short(c("before2"))
    return d.select(
        "doc_id", "source", "chars", "bytes", "appended", "tails", F.xxhash64(F.regexp_replace(line, r"\d+", "#")).alias("line_key"), line.rlike(FINAL).alias("final"),
        (word.isin(*sorted(NEVER_FINAL)) & ~line.rlike(r"^\s*\p{L}{1,12}\.$")).alias("abbreviation"),
        (line.rlike(PAGE_NUMBER) | line.rlike(APPENDIX) | line.rlike(SIGNATURE) | line.rlike(REFERENCE)).alias("furniture"),
        line.rlike(ROW).alias("row"), line.rlike(r"(?:>|\||\.{4,}\s*\d+)\s*$").alias("row_end"), (line.rlike(ITEM) | items).alias("item"),
    )


def judged(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, source, chars, bytes, at_limit, appended, final, cut, by) for every non-empty document; ``by`` is null where nothing is cut."""
    e = written(endings(docs).distinct(), "endings")
    sig = hazards(_lengths(e), p).where("significant").select("source", "unit", "n")
    limits = sig.groupBy(F.col("source").alias("limit_source")).agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("n"))).alias("char_limits"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("n"))).alias("byte_limits"))
    # one row per source, the planner broadcasts it by size
    e = e.join(limits, F.col("source").eqNullSafe(F.col("limit_source")), "left").drop("limit_source")
    c = F.col
    at_limit = F.coalesce(F.array_contains("char_limits", c("chars")), F.lit(False)) | F.coalesce(
        F.exists("byte_limits", lambda b: (c("bytes") <= b) & (c("bytes") > b - 4)), F.lit(False)
    )
    # a last line that documents of several lengths share is a heading, an item or page furniture, not a cut
    shared = e.groupBy("line_key").agg(F.count_distinct("chars").alias("sharing")).where(c("sharing") >= p.support).select("line_key", F.lit(True).alias("shared"))
    e = e.join(shared, "line_key", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    # scripts without full stops: the last letters must be ones that stand before a space elsewhere
    stops = e.where("tails is not null").select(F.explode("tails").alias("tail")).groupBy("tail").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    stopped = e.where("tails is not null").select("doc_id", F.element_at("tails", -1).alias("tail")).join(stops, "tail").select("doc_id", F.lit(True).alias("stopped")).distinct()
    e = e.join(stopped, "doc_id", "left")
    final = c("final") | c("stopped").isNotNull()
    open_text = ~final & ~(c("furniture") | c("row") | c("shared")) & ~c("item")
    cut = (
        F.when(c("appended"), F.lit("mark"))
        .when(final, F.when(c("abbreviation"), F.lit("ending")))
        .when(c("furniture"), F.lit(None))
        .when(at_limit, F.when(~c("shared") & (~c("row") | ~c("row_end")), F.lit("limit")))
        .when(open_text, F.lit("ending"))
    )
    return e.select("doc_id", "source", "chars", "bytes", at_limit.alias("at_limit"), "appended", final.alias("final"), F.coalesce(cut.isNotNull(), F.lit(False)).alias("cut"), cut.alias("by"))


def _lengths(d: DataFrame) -> DataFrame:
    """(source, unit, n) of a table with source, chars and bytes."""
    return d.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("l")).select("source", "l.unit", "l.n")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncation rate of each source, and how its cuts are known."""
    j = judged(table(spark, sf_dir, "documents"))
    by = [F.count(F.when(F.col("by") == k, 1)).alias(f"by_{k}") for k in ("limit", "mark", "ending")]
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("cut"), 1)).alias("cut"), *by, F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"))


def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which a source ends significantly often."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0 and doc_id is not null")
    d = d.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).distinct()
    return hazards(_lengths(d)).where("significant").drop("significant")


def oracle_sql() -> dict[str, str]:
    return {
        "p10_limits": """with d as (select distinct doc_id, source, length(text)::int as chars, strlen(text)::int as bytes from documents where length(text) > 0 and doc_id is not null),
l as (select source, 'chars' as unit, chars as n from d union all select source, 'bytes', bytes from d), per as (select source, unit, n, count(*) as ends from l group by all),
h as (select *, (sum(ends) over (partition by source, unit order by n desc))::bigint as at_risk, (sum(ends) over near - ends) / 80.0::double as around from per window near as (partition by source, unit order by n range between 40 preceding and 40 following)),
r as (select *, avg(at_risk) over (partition by source, unit order by n range between 40 preceding and 40 following) as risk_around from h),
e as (select *, greatest(around, 1 / 80.0::double) / greatest(risk_around, at_risk) * at_risk as expected from r), p as (select *, case when ends > expected then exp(ends - expected - ends * ln(ends / expected)) else 1 end as p_value from e),
s as (select *, floor(-ln(greatest(p_value, 1e-300)) * 64)::int as step from p), k as (select *, count(*) over (partition by unit order by step desc) as rank, count(*) over (partition by unit) as tests from s),
t as (select *, min(case when step > 0 and exp(-step / 64.0::double) <= 0.001::double * rank / tests then step end) over (partition by unit) as last from k)
select source, unit, n, ends, at_risk, round(expected, 6) as expected, round(p_value, 12) as p_value from t where step >= last""",
    }
