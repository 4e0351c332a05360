"""Quality rules as a ledger: every rule is evaluated once, its measurement and failure bit are stored,
and policies and ablations read the bits."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import GAP, table, words_of
from litmill.llm.registry import query

RUN = 5  # words in a window of the repetition rule
SYMBOLS = "#*$%&|<>"

# Bit of each rule, in order; a new rule takes the next bit, bits are never reused.
RULES: tuple[str, ...] = (
    "few_words", "repeated_words", "symbols", "short_words", "long_words", "repeated_lines",
)
BIT: Mapping[str, int] = {name: 1 << i for i, name in enumerate(RULES)}

# Versioned policies: the rules whose failure rejects a document.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "clean-1": ("few_words", "repeated_words", "symbols"),
    "strict-1": RULES,
}
DEFAULT_POLICY = "clean-1"


def mask_of(policy: str) -> int:
    return reduce(int.__or__, (BIT[r] for r in POLICIES[policy]), 0)


def _repeated(pairs: Column) -> Column:
    """Words covered by windows whose hash occurs again, from (hash, place) pairs sorted by hash."""
    twice = F.filter(
        pairs,
        lambda p, i: (p["h"] == F.get(pairs, i + 1)["h"])
        | (p["h"] == F.when(i > 0, F.get(pairs, i - 1)["h"])),
    )
    places = F.sort_array(F.transform(twice, lambda p: p["i"]))
    # Each window adds the words that the window before it does not cover.
    return F.aggregate(
        places,
        F.struct(F.lit(-RUN).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(RUN), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measurements): one pass of built-in functions over each whole text.

    Null texts measure as empty ones.  Rows come out one for one, so repeated
    rows repeat.  Only the two named columns are read; others may have any name.
    Windows of a text are compared by 64-bit hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t"))
    df = df.select(
        "doc_id", "_t",
        F.transform(words_of(F.col("_t")), lambda w: F.xxhash64(w)).alias("_h"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    df = df.select(
        "doc_id",
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", GAP, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_h",
    )
    at = [F.col("_h")] * RUN
    df = df.withColumn(
        "_w",
        F.when(
            F.col("n_words") > RUN,
            F.transform(
                F.sequence(F.lit(0), F.size("_h") - RUN),
                lambda i: F.xxhash64(*[F.get(a, i + k) for k, a in enumerate(at)]),
            ),
        ),
    ).drop("_h")
    # Only texts with a window that comes again pay for the sort.
    df = df.withColumn(
        "_p",
        F.when(
            F.size(F.array_distinct("_w")) < F.size("_w"),
            F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_w")
    repeated = F.coalesce(_repeated(F.col("_p")), F.lit(0).cast("long")).alias("n_repeat_words")
    measures = [c for c in df.columns if c not in ("doc_id", "_p")]
    # The one-row generator keeps later filters from being pushed down, which would measure each text many times.
    return df.select("doc_id", F.inline(F.array(F.struct(*measures, repeated))))


def failures() -> dict[str, Column]:
    """Failure of each rule, from the measurements alone."""
    n = F.col("n_words")
    return {
        "few_words": n < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "short_words": F.col("word_chars") < 3 * n,
        "long_words": F.col("word_chars") > 10 * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements with ``fail_bits``: bit i is set if rule i of RULES fails."""
    fails = failures()
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(fails[r], F.lit(BIT[r])).otherwise(F.lit(0)).cast("long") for r in RULES],
    )
    return measure(docs, doc_id, text).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed.  Reads bits only, never texts."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    return entries.withColumn("policy", F.lit(policy)).withColumn("kept", hit == 0)


def ablations(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """(rule, n_failed, n_only, kept_without): what each rule of the policy does.

    One aggregation over the masked bits (2^rules rows at most), then bit tests.
    """
    names = POLICIES[policy]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    counts = entries.groupBy(hit.alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in names]))
    long = counts.select("bits", "n", rule.alias("r")).select("bits", "n", "r.*")
    when = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return long.groupBy("rule").agg(
        when(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        when(F.col("bits") == F.col("bit")).alias("n_only"),
        when((F.col("bits") == F.col("bit")) | (F.col("bits") == 0)).alias("kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = DEFAULT_POLICY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose text the policy keeps."""
    # The whole row rides through the ledger as the id, so no join is needed.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("body"))
    kept = apply_policy(ledger(row, "row", "body"), policy).filter("kept")
    return kept.select("doc_id.*")


ORACLE = r"""
with w as (select doc_id, coalesce(text, '') as t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
 l as (select doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
  list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i + 4], ' ')) as win from w),
 x as (select doc_id, unnest(win) as g, unnest(range(1, len(win) + 1)) as i from l),
 d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from x) where c > 1),
 r as (select doc_id, sum(least(5, coalesce(nxt - i, 5))) as n from (
  select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from d) group by 1),
 m as (select l.doc_id, cast(len(ws) as bigint) as n_words,
  cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(r.n, 0) as bigint) as n_repeat_words from l left join r on l.doc_id = r.doc_id),
 b as (select *, cast(case when n_words < 10 then 1 else 0 end
  + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
  + case when 10 * n_symbols > n_words then 4 else 0 end
  + case when word_chars < 3 * n_words then 8 else 0 end
  + case when word_chars > 10 * n_words then 16 else 0 end
  + case when 100 * n_dup_lines > 30 * n_lines then 32 else 0 end as bigint) as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
 (fail_bits & 7) = 0 as kept, fail_bits from b
"""


@query("op7_rule_ledger", ORACLE)
def rule_ledger(spark, sf_dir):
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of("base-1")).cast("long")) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits",
    )
