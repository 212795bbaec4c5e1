"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets base measures. For every language and source, mergeable KLL sketches of three
ratios give quartiles; a ratio beyond the quartiles by FENCE interquartile ranges and a small
slack is an outlier of its own group, whatever is usual there. Sketches merge upwards: a group
of fewer than LEAST texts uses the sketch of its language, and that of all texts if the language
is as small. The thresholds are joined to the measures and filter them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, same, sheltered, table

WINDOW = 8
FENCE = 6.0
LEAST = 30
#: Items of a sketch's base level. Groups up to this size have exact quartiles.
SKETCH_K = 4096
#: Ratio, slack, and whether low values are outliers too.
RATIOS = (("mean_word", 0.5, True), ("symbol_rate", 0.1, False), ("dup_line_rate", 0.25, False))
#: Thresholds are broadcast up to this many groups, and else joined by shuffle.
BROADCAST_GROUPS = 20_000

_SPACE = r"\\x20\\x09-\\x0D"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, text: str) -> DataFrame:
    """df with the base measures of column text, and base_failed. A null text has no words and no lines."""
    steps = [
        {"t": F.coalesce(F.col(text), F.lit(""))},
        {"words": F.expr(f"regexp_extract_all(t, '[^{_SPACE}]+', 0)"), "lines": F.expr(f"filter(split(t, '\\n', -1), x -> x rlike '[^{_SPACE}]')")},
        {"marks": F.expr("transform(words, x -> xxhash64(x))")},
        {"spans": F.expr(f"if(size(marks) < {WINDOW}, array(), transform(sequence(0, size(marks) - {WINDOW}), i -> xxhash64(slice(marks, i + 1, {WINDOW}))))")},
        {"again": F.expr("size(array_distinct(spans)) < size(spans)")},
        {"sorted": F.expr("if(again, sort_array(transform(spans, (x, i) -> struct(x, i))), null)")},
        {"found": F.expr("sort_array(transform(filter(sorted, (e, k) -> e.x <=> get(sorted, k - 1).x or e.x <=> get(sorted, k + 1).x), e -> e.i))")},
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            # Each repeated window adds the words up to the next one, or all of its own.
            "n_repeat_words": F.expr(
                f"if(again, aggregate(zip_with(found, slice(found, 2, size(found)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0, (s, x) -> s + x), 0)"
            ).cast("long"),
        },
    ]
    kept = list(df.columns)
    for k, step in enumerate(steps):
        used = {1: ["t"], 2: ["t", "words", "lines"], 3: ["t", "words", "lines", "marks"], 4: ["t", "words", "lines", "spans"], 5: ["t", "words", "lines", "spans", "again"], 6: ["t", "words", "lines", "again", "sorted"], 7: ["t", "words", "lines", "again", "found"]}.get(k, [])
        df = df.select(*kept, *used, *(c.alias(name) for name, c in step.items()))
    # A filter on a measure must not be pushed below this, where it would be worked out once for
    # each mention in its formula; it is not, as it comes to a column that is not deterministic.
    df = df.select(*kept, *BASE, "n_lines", F.monotonically_increasing_id().alias("fence"))
    return df.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def _ratio(top: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(top).cast("double") / F.col(under))


def rated(measures: DataFrame) -> DataFrame:
    """measures with the three ratios; null where there is nothing to divide by."""
    return measures.withColumns({"mean_word": _ratio("word_chars", "n_words"), "symbol_rate": _ratio("n_symbols", "n_words"), "dup_line_rate": _ratio("n_dup_lines", "n_lines")})


def thresholds(ratios: DataFrame, fence: float = FENCE, least: int = LEAST, k: int = SKETCH_K) -> DataFrame:
    """(lang, source, low_*, high_*) for every language and source in ratios, nulls being values of their own."""
    names = [r[0] for r in RATIOS]
    own = materialize(
        ratios.groupBy("lang", "source").agg(
            F.count_if(~F.col("base_failed")).alias("n"), *(F.expr(f"kll_sketch_agg_double({r}, {k}) filter (where not base_failed and {r} is not null)").alias(r) for r in names)
        ),
        "sketches",
    )
    merged = [F.expr(f"kll_merge_agg_double({r}, {k}) filter (where n > 0)").alias(r) for r in names]
    by_lang = own.groupBy("lang").agg(F.sum("n").alias("n"), *merged).select(F.col("lang").alias("lang_l"), F.col("n").alias("n_l"), *(F.col(r).alias(f"{r}_l") for r in names))
    of_all = own.agg(*merged).select(*(F.col(r).alias(f"{r}_a") for r in names))
    out = own.join(by_lang, same(F.col("lang"), F.col("lang_l")), "left").join(F.broadcast(of_all))
    for r, slack, both in RATIOS:
        sketch = F.when(F.col("n") >= least, F.col(r)).when(F.col("n_l") >= least, F.col(f"{r}_l")).otherwise(F.col(f"{r}_a"))
        out = out.withColumn(f"s_{r}", sketch)
        # An empty sketch has no quantile: without any text that passes there is no bound.
        out = out.withColumns({f"q{k}_{r}": F.expr(f"case when kll_sketch_get_n_double(s_{r}) > 0 then kll_sketch_get_quantile_double(s_{r}, {q}D) end") for k, q in ((1, 0.25), (3, 0.75))})
        out = out.withColumn(f"high_{r}", F.expr(f"q3_{r} + {fence}D * (q3_{r} - q1_{r}) + {slack}D"))
        if both:
            out = out.withColumn(f"low_{r}", F.expr(f"q1_{r} - {fence}D * (q3_{r} - q1_{r}) - {slack}D"))
    bounds = [f"high_{r}" for r in names] + [f"low_{r}" for r, _, both in RATIOS if both]
    return out.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *bounds)


def judged(ratios: DataFrame, bounds: DataFrame) -> DataFrame:
    """ratios with kept: not base_failed and no ratio beyond its group's bounds."""
    bounds = materialize(bounds, "bounds")
    if bounds.count() <= BROADCAST_GROUPS:
        bounds = F.broadcast(bounds)
    out = ratios.join(bounds, same(F.col("lang"), F.col("of_lang")) & same(F.col("source"), F.col("of_source")), "left")
    inside = ~F.col("base_failed")
    for r, _, both in RATIOS:
        inside &= F.coalesce(F.col(r) <= F.col(f"high_{r}"), F.lit(True))
        if both:
            inside &= F.coalesce(F.col(r) >= F.col(f"low_{r}"), F.lit(True))
    return out.withColumn("kept", inside & (F.col("fence") >= 0))


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, base measures, base_failed, ratios, kept) for each row of docs.

    A null or empty text has no words, so it fails the base rules. A null language or source is a
    group of its own. Repeated rows and several texts of one doc_id are answered each, very long texts
    whole; an empty table gives an empty result; other columns are not read. Quartiles are exact for
    groups of up to SKETCH_K texts. Beyond that a sketch is random within its error (rank error under
    0.1 %), so a rerun may give slightly other thresholds; within a run all rows meet the same ones.
    """
    ratios = rated(measured(docs.select("doc_id", "lang", "source", "text"), "text").drop("text"))
    ratios = materialize(ratios, "measures")
    return judged(ratios, thresholds(ratios)).select("doc_id", *BASE, "base_failed", "mean_word", "symbol_rate", "dup_line_rate", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with the columns that docs has, whatever they are called.

    Null, empty and wordless texts go, as they fail the base rules; repeated rows stay or go alike,
    several texts of one doc_id each for itself; a null lang or source is a group of its own, and an
    empty table stays empty. The rows are written once with their ratios, so whole texts, however
    long, are measured once and not shuffled.
    """
    names, safe = docs.columns, sheltered(docs)
    where = {name: f"c{names.index(name)}" for name in ("lang", "source", "text")}
    groups = [F.col(where[n]).alias(n) for n in ("lang", "source")]
    rows = materialize(rated(measured(safe.select(*safe.columns, *groups), where["text"])), "measures")
    return judged(rows, thresholds(rows)).where("kept").select(*safe.columns).toDF(*names)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql_ratio(top: str, under: str) -> str:
    return f"case when {under} > 0 then cast({top} as double) / {under} end"


def kept_sql(source: str = "documents") -> str:
    """DuckDB SQL for quality(); exact quartiles, as the sketches have up to SKETCH_K texts."""
    space = r"\x20\x09-\x0D"
    names = [r[0] for r in RATIOS]
    disc = lambda r, q: f"quantile_disc({r}, {q}) filter (where not base_failed)"
    quartiles = ", ".join(f"{disc(r, q)} as q{k}_{r}" for r in names for k, q in ((1, 0.25), (3, 0.75)))
    pick = lambda k, r: f"case when g.n >= {LEAST} then g.q{k}_{r} when l.n >= {LEAST} then l.q{k}_{r} else a.q{k}_{r} end"
    picked = ", ".join(f"{pick(k, r)} as q{k}_{r}" for r in names for k in (1, 3))
    tests = [f"coalesce(r.{r} <= q3_{r} + {FENCE}::double * (q3_{r} - q1_{r}) + {s}::double, true)" for r, s, _ in RATIOS]
    tests += [f"coalesce(r.{r} >= q1_{r} - {FENCE}::double * (q3_{r} - q1_{r}) - {s}::double, true)" for r, s, both in RATIOS if both]
    return f"""
with w as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from {source}),
p as (select *, regexp_extract_all(t, '[^{space}]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as lines from w),
spans as (select rid, i, list_slice(words, i, i + {WINDOW - 1}) as span from (select rid, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) as i from p) z),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, span) as c from spans) z where c > 1),
cover as (select rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as n from (select rid, i, lead(i) over (partition by rid order by i) as nxt from twice) z group by rid),
m as (select p.rid, doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(len(lines) as bigint) as n_lines, cast(coalesce(cover.n, 0) as bigint) as n_repeat_words from p left join cover on p.rid = cover.rid),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {_sql_ratio("word_chars", "n_words")} as mean_word,
  {_sql_ratio("n_symbols", "n_words")} as symbol_rate, {_sql_ratio("n_dup_lines", "n_lines")} as dup_line_rate from m),
g as (select lang, source, count(*) filter (where not base_failed) as n, {quartiles} from b group by lang, source),
l as (select lang, count(*) filter (where not base_failed) as n, {quartiles} from b group by lang),
a as (select {quartiles} from b),
h as (select g.lang, g.source, {picked} from g left join l on g.lang is not distinct from l.lang cross join a)
select r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, mean_word, symbol_rate, dup_line_rate,
  not base_failed and {" and ".join(tests)} as kept
from b r left join h on r.lang is not distinct from h.lang and r.source is not distinct from h.source"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE = {"op2_quality_rules": kept_sql()}
