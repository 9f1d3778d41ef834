"""Rule bitmask ledger: every rule is evaluated once, failures are stored as bits beside the measurements,
and versioned policies and ablations are bit operations on the ledger.

Edge cases: a null or blank text has no words, measures 0 everywhere and fails ``too_short``; ids may be
null or repeated (each row is judged by itself); other columns pass through ``ledger`` untouched, but one
that has the name of a measurement is replaced. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words

WINDOW = 5


def _repeat_words(ws: Column) -> Column:
    """Words inside WINDOW-word windows that the text has twice or more, the first occurrence included."""

    def covered(at: Column) -> Column:
        # at: sorted starts of repeated windows; each covers what the next one doesn't
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def starts(marks: Column) -> Column:
        # marks: windows as (hash, start), sorted, so equal windows are neighbours
        same = F.zip_with(marks, F.slice(marks, 2, F.size(marks)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        return let(same, lambda e: F.sort_array(F.array_compact(F.transform(
            marks, lambda m, k: F.when(F.get(e, k) | F.coalesce(F.get(e, k - 1), F.lit(False)), m["i"])))))

    def windows(h: Column) -> Column:
        n = F.size(h) - (WINDOW - 1)
        return F.transform(F.arrays_zip(*[F.slice(h, k + 1, n) for k in range(WINDOW)]), lambda w: F.xxhash64(w))

    def count(g: Column) -> Column:
        marks = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(let(marks, starts), covered)).otherwise(F.lit(0))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) > WINDOW, let(let(hashes, windows), count)).otherwise(F.lit(0)).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_shouts."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words(F.col(text)))
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dup_lines": _dup_lines(F.col(text)),
            "n_shouts": ((F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_words")),
        }
    ).drop("_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true; ``bit`` is its place for good."""

    bit: int
    name: str
    fails: str


#: Fixed for good: a new rule gets a new bit, a changed one too.
RULES = (
    Rule(0, "too_short", "n_words < 10"),
    Rule(1, "repetitive", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "shouting", "100 * n_shouts > 25 * n_words"),
    Rule(5, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
)

#: Versioned policies: a document goes if it fails a rule that the policy's mask names.
POLICIES = {
    "v1_base": ("too_short", "repetitive"),
    "v2_symbols": ("too_short", "repetitive", "symbols", "duplicate_lines"),
    "v3_full": tuple(r.name for r in RULES),
}
PRODUCTION = "v3_full"


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` of every row; one pass, no shuffle."""
    bits = F.lit(0)
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)))
    return measure(df, text).withColumn("fail_bits", bits)


def kept(policy: str = PRODUCTION) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(led: DataFrame) -> DataFrame:
    """For each policy and rule in it: rows that fail it, rows that fail it alone, and rows kept without it.

    Bit arithmetic on counts of distinct bit sets: what is shuffled is one row a set and task.
    """
    sets = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = [(p, mask(p), r.name, 1 << r.bit) for p in POLICIES for r in RULES if r.name in POLICIES[p]]
    plan = led.sparkSession.createDataFrame(rows, "policy string, mask int, rule string, bit int")
    # a broadcast of the policies: at most len(POLICIES) * len(RULES) rows, and at most 2 ** len(RULES) sets
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        sets.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in POLICIES])))
        .join(F.broadcast(plan), F.col("_p") == F.col("policy"))
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("v1_base"))) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & kept()).alias("kept"), "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")))


_MEASURES = r"""
words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS text FROM documents),
shingles AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM shingles) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM repeated) GROUP BY doc_id),
measures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
    CAST((length(text) - length(replace(text, '!!', ''))) // 2 AS BIGINT) AS n_shouts,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
ledger AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_shouts > 25 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 32 ELSE 0 END) AS INTEGER) AS fail_bits
  FROM measures)
"""

SQL = {
    "op9_quality_rules": f"""WITH {_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM ledger""",
    "quality_ablations": f"""WITH {_MEASURES},
rules(rule, bit) AS (VALUES ('too_short', 1), ('repetitive', 2), ('symbols', 4), ('duplicate_lines', 8), ('shouting', 16), ('word_length', 32)),
policies(policy, mask) AS (VALUES ('v1_base', 3), ('v2_symbols', 15), ('v3_full', 63))
SELECT policy, rule, CAST(count(*) FILTER (WHERE fail_bits & bit <> 0) AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (WHERE fail_bits & mask = bit) AS BIGINT) AS n_failed_alone,
  CAST(count(*) FILTER (WHERE fail_bits & mask & ~bit = 0) AS BIGINT) AS n_kept_without
FROM policies JOIN rules ON mask & bit <> 0 CROSS JOIN ledger GROUP BY policy, rule""",
}
QUERIES = {"op9_quality_rules": op9_quality_rules, "quality_ablations": quality_ablations}
