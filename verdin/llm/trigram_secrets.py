"""Secret scans through a trigram inverted index, in built-in expressions only.

From each rule's regular expression the driver derives a Boolean query over trigrams: an OR of
clauses, each an AND of trigrams that every match of that branch contains (letters folded to lower case).
The index holds, for the trigrams that the rules ask for, the postings (trigram, document).  A
clause's postings are intersected by counting a document's distinct trigrams of the clause; a rule's
candidates are the documents of any of its clauses.  Rules without a mandatory trigram scan fully.
Candidates are verified by the expression itself; spans come from the matches and the pieces
between them.

Null text: empty.  A document is known by its id together with its text's hash, so null or repeated
ids do not mix rows; repeated rows keep a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import fresh

try:
    from re import _constants as _c, _parser
except ImportError:   # Python before 3.11
    import sre_constants as _c
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    """``least``: characters that the group ``part`` of a match must have at least.  A match without
    them is dropped, after it has taken its place among the matches."""
    kind: str
    pattern: str
    part: int = 0
    least: int = 0


#: Fixed by the contract, in its order.  A run of 20 or 24 characters is asked for in the expression
#: where that gives the same spans: both expressions take whole runs of their characters.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Between two runs of base64 in a text or a quoted string.
_GAP = r"""(?:[\s"'#>*,]|\\[nrt])*+"""
#: A PEM key: up to its END line, which comes before any other five dashes.  Where there is none, the header
#: fields, the runs of 16 characters or more, and a shorter last one that ends its line.  Possessive
#: groups, which Java's matcher repeats without recursion.
PRIVATE_KEY = (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----|"
               rf"(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)*+"
               rf"""(?:(?<=[A-Za-z0-9+/=]{{16}}){_GAP}[A-Za-z0-9+/=]{{1,15}}(?![^\r\n"'\\]))?+)""")
#: Public formats of further credentials.
MORE = (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
)

MOST = 16   # strings, or clauses, that an expression may stand for before it is given up


def _fold(strings):
    return frozenset(s.lower() for s in strings)


def _clauses_of(strings) -> list[frozenset]:
    """Clauses of an OR of strings; None where one is too short to have a trigram."""
    out = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
    return out if out and all(out) else None


def _and(a, b):
    if a is None or b is None:
        return b if a is None else a
    out = list(dict.fromkeys(x | y for x in a for y in b))
    return out if len(out) <= MOST else min(a, b, key=len)


def _item(op, arg):
    if op is _c.LITERAL:
        return _fold({chr(arg)}), None
    if op is _c.IN:
        chars = set()
        for kind, value in arg:
            if kind is _c.LITERAL:
                chars.add(chr(value))
            elif kind is _c.RANGE and value[1] - value[0] < MOST:
                chars.update(map(chr, range(value[0], value[1] + 1)))
            else:
                return None, None
        chars = _fold(chars)
        return (chars, None) if len(chars) <= MOST else (None, None)
    if op is _c.SUBPATTERN:
        return query_of(arg[-1])
    if op is _c.BRANCH:
        got = [query_of(x) for x in arg[1]]
        if all(e is not None for e, _ in got) and sum(len(e) for e, _ in got) <= MOST:
            return frozenset().union(*[e for e, _ in got]), None
        clauses = [n if e is None else _clauses_of(e) for e, n in got]
        return None, (sum(clauses, []) if all(clauses) else None)
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        low, high, inner = arg
        exact, need = query_of(inner)
        if exact is not None and high <= 2 and len(exact) <= 4:
            out, now = set(exact if low == 1 else [] if low == 2 else [""]), exact
            if low == 0:
                out |= exact
            for _ in range(1, high):
                now = frozenset(x + y for x in now for y in exact)
                out |= now
            return frozenset(out), None
        if low == 0:
            return None, None
        return None, (need if exact is None else _clauses_of(exact))
    if op is _c.AT:
        return frozenset({""}), None
    return None, None


def query_of(items):
    """(the strings that the items can match, if few, else None; clauses that every match meets)."""
    exact, need, whole = frozenset({""}), None, True
    for op, arg in items:
        one, asked = _item(op, arg)
        if one is not None and len(one) * len(exact) <= MOST:
            exact = frozenset(x + y for x in exact for y in one)
            continue
        whole = False
        need = _and(need, _clauses_of(exact))
        if one is None:
            need, exact = _and(need, asked), frozenset({""})
        else:
            exact = one
    if whole:
        return exact, None
    return None, _and(need, _clauses_of(exact))


def trigram_query(pattern: str) -> list[frozenset] | None:
    """The clauses of an expression, or None when it has no mandatory trigram."""
    exact, need = query_of(_parser.parse(pattern))
    clauses = need if exact is None else _clauses_of(exact)
    if clauses is None:
        return None
    # of an OR, a clause that asks for more than another one adds nothing
    return [c for c in clauses if not any(o < c for o in clauses)]


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def postings(docs: DataFrame, vocabulary: list[str], keys: list[str], text: str) -> DataFrame:
    """(trigram, *keys): the documents of each trigram of the vocabulary, letters folded."""
    present = _let(F.lower(text), lambda low: F.filter(
        F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in vocabulary]), lambda t: t.isNotNull()))
    return docs.select(*keys, F.explode(present).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset]], keys: list[str]) -> DataFrame:
    """(*keys, rules): the rules, as bits by their number, that a document is a candidate of.  The
    clauses are a few literal rows; the intersection is a count by document and clause."""
    spark = index.sparkSession
    clauses = list(dict.fromkeys(c for q in queries.values() for c in q))
    terms = [(t, k) for k, c in enumerate(clauses) for t in sorted(c)]
    needed = spark.createDataFrame([(k, len(c), sum(1 << r for r, q in queries.items() if c in q)) for k, c in enumerate(clauses)],
                                   "clause int, size long, bits long")
    asked = spark.createDataFrame(terms, "trigram string, clause int")
    met = index.join(F.broadcast(asked), "trigram").groupBy(*keys, "clause").agg(F.count("*").alias("found"))   # as many rows as the rules' trigrams
    return met.join(F.broadcast(needed), "clause").where("found = size").groupBy(*keys).agg(F.bit_or("bits").alias("rules"))


_SPAN = "array<struct<a:int,k:int,b:int>>"


def spans_of(rule: Rule, number: int, text: str) -> Column:
    """Spans (first character, rule number, end) of a rule's matches: the pieces between matches give
    their places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.part))

    def placed(match, piece, group):
        # the running end of what is before each match
        steps = F.transform(match, lambda m, i: F.struct(F.length(F.get(piece, i)).alias("gap"), F.length(m).alias("size"),
                                                         F.length(F.get(group, i)).alias("part")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(steps, start, lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.when(s["part"] >= rule.least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("a"), F.lit(number).alias("k"), (acc["at"] + s["gap"] + s["size"]).alias("b")))))
            .otherwise(acc["out"]).alias("out")))["out"]

    got = _let(F.struct(found.alias("m"), F.split(text, rule.pattern, -1).alias("p"), part.alias("g")),
               lambda x: placed(x["m"], x["p"], x["g"]))
    return F.when(F.rlike(text, pattern), got).otherwise(F.array().cast(_SPAN))


def find_secrets(docs: DataFrame, rules: tuple = BASE + MORE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` and the column spans: the sorted spans of each row as (a, k, b), k the rule's number."""
    key, h, k2, h2, mask, body, spans = fresh(docs.columns, "key", "h", "key2", "h2", "rules", "body", "spans")
    base = docs.withColumns({key: docs[doc_id], h: F.xxhash64(docs[text]), body: F.coalesce(docs[text], F.lit(""))})
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q}
    marked = base.withColumn(mask, F.lit(0).cast("long"))
    if indexed:
        vocabulary = sorted({t for q in indexed.values() for c in q for t in c})
        index = postings(base.select(F.col(key).alias("key"), F.col(h).alias("h"), F.col(body).alias("body")),
                         vocabulary, ["key", "h"], "body")
        hits = candidates(index.distinct(), indexed, ["key", "h"]).select(
            F.col("key").alias(k2), F.col("h").alias(h2), F.col("rules").alias(mask))
        marked = base.join(hits, F.expr(f"`{key}` <=> `{k2}` AND `{h}` = `{h2}`"), "left")
    wanted = F.coalesce(F.col(mask), F.lit(0).cast("long"))
    parts = []
    for i, r in enumerate(rules):
        one = spans_of(r, i, body)
        parts.append(F.when(wanted.bitwiseAND(F.lit(1 << i).cast("long")) != 0, one).otherwise(F.array().cast(_SPAN)) if i in indexed else one)
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], F.sort_array(F.concat(*parts)).alias(spans))


def named(spans: Column, rules: tuple) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple = BASE + MORE, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]",
           n_chars: str | None = None) -> DataFrame:
    """``docs`` with each maximal run of secret characters replaced by ``mark``; a null text stays null.
    ``n_chars`` names a column that holds the text's length, set anew where the text changes."""
    (spans,) = fresh(docs.columns, "spans")
    found = find_secrets(docs, rules, doc_id, text)
    # union of spans, then the text between them
    union = F.aggregate(F.col(spans), F.array().cast("array<struct<a:int,b:int>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["a"] <= F.element_at(acc, -1)["b"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))))
    body = F.col(f"`{text}`")

    def cut(u):
        pieces = F.transform(u, lambda s, i: F.concat(
            F.substring(body, F.when(i == 0, 1).otherwise(F.get(u, i - 1)["b"] + 1),
                        s["a"] - F.when(i == 0, 0).otherwise(F.get(u, i - 1)["b"])), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), F.substring(body, F.element_at(u, -1)["b"] + 1, F.length(body)))

    out = found.select(*[F.when(F.size(spans) > 0, _let(union, cut)).otherwise(body).alias(c) if c == text else F.col(f"`{c}`")
                         for c in docs.columns], F.size(spans).alias(spans))
    if n_chars:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col(spans) > 0, F.length(body).cast(kind)).otherwise(F.col(f"`{n_chars}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

