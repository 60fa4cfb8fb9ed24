"""Quality rules as a bitmask ledger, in built-in expressions only.

Every rule is evaluated once for each document: the ledger keeps the measurements and one bit for each
rule that failed.  A policy is a versioned set of rules, so applying one, or changing it, is an
operation on the stored bits; ablations (what a rule alone decides) come from counts by mask and
bit operations, without the texts.

Null text: no words.  Repeated rows keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"

#: name -> condition of failure over the measurements; the place in this list is the rule's bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_words": "n_words > 1000000",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 5 * n_lines",
    "few_letters": "10 * n_letters < 5 * word_chars",
    "shouting": "10 * n_capitals > 6 * n_letters",
}
#: version -> rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_words", "short_mean_word", "long_mean_word", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once (a lambda variable is bound, not copied)."""
    return F.transform(F.array(value), use)[0]


def _covered(hashes: Column) -> Column:
    """Words inside windows of 8 whose hash occurs twice or more, given the windows' hashes in order:
    the starts of such windows, sorted, each add the words that the one before did not reach."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s):
        again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def total(p):
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + 1) - x, F.lit(8)))),
                           F.lit(0).cast("long"), lambda acc, x: acc + x)

    return _let(pairs, lambda s: _let(starts(s), total))


def measured(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and the measurements of every row."""
    t = F.coalesce(docs[text], F.lit(""))
    base = docs.select(*[docs[c] for c in keep], t.alias("_t"))
    words = F.filter(F.split("_t", WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    plain = F.length("_t")

    def without(chars):
        return plain - F.length(F.translate("_t", chars, ""))

    return base.select(
        *[F.col(c) for c in keep],
        _let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            _let(F.when(F.size(w) >= 9, F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, 8))))
                 .otherwise(F.array().cast("array<bigint>")),
                 lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long"))).alias("n_repeat_words"),
        )).alias("_m"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                       (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    ).select(*keep, "_m.n_words", "_m.word_chars", "n_symbols", "_l.n_dup_lines", "_m.n_repeat_words", "_l.n_lines", "n_letters", "n_capitals")


def ledger(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """The measurements and fail_bits: bit k is set where the k-th rule failed."""
    bits = F.lit(0).cast("long")
    for k, condition in enumerate((rules or RULES).values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, keep, text).withColumn("fail_bits", bits)


def mask(policy, rules: dict[str, str] | None = None) -> int:
    """The bits of a policy: a version, or rule names."""
    names = list(rules or RULES)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def passes(policy, rules: dict[str, str] | None = None) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def by_mask(book: DataFrame) -> DataFrame:
    """(fail_bits, n): all that policies and ablations need, at most one row for each set of rules."""
    return book.groupBy("fail_bits").agg(F.count("*").alias("n"))


def policy_report(book: DataFrame, policies: dict | None = None) -> DataFrame:
    """(policy, n, n_kept) of each policy, from the counts by mask."""
    counts = by_mask(book)
    rows = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask(r)).cast("long").alias("bits")) for p, r in (policies or POLICIES).items()])
    return counts.select("fail_bits", "n", F.explode(rows).alias("p")).groupBy(F.col("p.policy").alias("policy")).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("p.bits")) == 0, F.col("n"))), F.lit(0)).alias("n_kept"))


def ablation(book: DataFrame, policy) -> DataFrame:
    """(rule, n_failed, n_only): rows that a rule of the policy fails, and those that no other rule
    of the policy fails, which dropping the rule would keep."""
    names, bits = list(RULES), mask(policy)
    chosen = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, n in enumerate(names) if bits >> k & 1])
    failed = F.col("fail_bits").bitwiseAND(F.lit(bits).cast("long"))
    return by_mask(book).select(failed.alias("f"), "n", F.explode(chosen).alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"))


#: DuckDB SQL of the query: the same measurements from rows of words and lines.
ORACLE = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda a: a <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda a: regexp_matches(a, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 9),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda a: length(a))), 0)::BIGINT AS word_chars,
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             length(regexp_replace(x, '[^\\p{L}]+', '', 'g'))::BIGINT AS n_letters,
             length(regexp_replace(x, '[^\\p{Lu}]+', '', 'g'))::BIGINT AS n_capitals
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
             (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (n_words > 1000000)::BIGINT
             + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (10 * n_symbols > 3 * n_words)::BIGINT
             + 64 * (10 * n_dup_lines > 5 * n_lines)::BIGINT + 128 * (10 * n_letters < 5 * word_chars)::BIGINT
             + 256 * (10 * n_capitals > 6 * n_letters)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (fail_bits & 511) = 0 AS kept, fail_bits FROM b
"""
