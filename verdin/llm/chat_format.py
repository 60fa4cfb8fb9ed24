"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one marked text: of each turn ``<|turn|>role<|says|>text<|end|>``.  Every
assistant turn is an example of its own: its context is the whole text before the reply (all preceding
turns and the reply's own opening marks), and only the reply is trainable.  The examples of a
conversation are therefore prefixes of one text, and that text is stored once: ``formatted`` returns a
row a turn with its place, ``examples`` a row an assistant turn with the extent of its prefix and of the
trainable characters, and ``expand`` writes out the full texts of the examples asked for.  The
stored size follows the conversations, not the squares of their lengths; ``digests`` writes out every
example in full and reads its figures back from those texts, so its work follows the examples.

Control strings (the marks, and ``<s> </s> [INST] [/INST] <<SYS>> <</SYS>>``) inside a text or role get a
backslash after their bracket; those that have backslashes there already get one more, so the way back
is to take one away, and no text can hold a mark.

Turns follow by (turn, role, text); null turns come first, and equal rows each count.  Null role or text: empty.  Null
conversation ids are one conversation.  Text after the last reply, and conversations without a reply, are
stored with nothing trainable.  Texts are handled whole; an empty table gives empty results; other
columns are never read.  Places and sums along a conversation are added up in chunks, so one with any
share of the rows is handled by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import stored
from verdin.operators.series import prefix_sums

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
_AFTER = r"(/?s>|/?INST\]|/?SYS>>|\|(?:turn|says|end)\|>)"
_PLAIN = r"([<\[])(\\*)" + _AFTER
_ESCAPED = r"([<\[])\\(\\*)" + _AFTER


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def formatted(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              reply: str = "assistant", chunk_rows: int | None = None) -> DataFrame:
    """A row a turn: conv_id, position (from 1), example (the number of the reply in it or next after it), start
    (characters of the conversation before it), piece, trainable, loss_start (place of the reply in the
    conversation), loss_chars (0 unless trainable)."""
    body = escaped(F.coalesce(F.col(text), F.lit("")))
    head = F.concat(F.lit(TURN), escaped(F.coalesce(F.col(role), F.lit(""))), F.lit(SAYS))
    rows = chats.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
                        head.alias("head"), body.alias("body"))
    rows = rows.select("conv_id", "turn", "role", "text", F.length("head").cast("long").alias("head_chars"),
                       F.length("body").cast("long").alias("body_chars"), F.concat("head", "body", F.lit(END)).alias("piece"),
                       F.coalesce(F.col("role") == reply, F.lit(False)).cast("long").alias("reply"), F.lit(1).cast("long").alias("one"))
    rows = stored(rows.withColumn("chars", F.length("piece").cast("long")), "chat-turns")
    sums = prefix_sums(rows, ["conv_id"], ["turn", "role", "text"], ["one", "reply", "chars"], chunk_rows)
    start, own = F.col("cum_chars") - F.col("chars"), F.col("reply") == 1
    return sums.select("conv_id", F.col("cum_one").alias("position"), (F.col("cum_reply") - F.col("reply") + 1).alias("example"),
                       start.alias("start"), "piece", own.alias("trainable"), (start + F.col("head_chars")).alias("loss_start"),
                       F.when(own, F.col("body_chars")).otherwise(F.lit(0)).alias("loss_chars"))


def examples(turns: DataFrame) -> DataFrame:
    """Of ``formatted`` rows, a row an assistant turn: conv_id, example, position, context_turns, context_chars
    (of the prefix before the reply), loss_chars, chars (of the whole example)."""
    return turns.where("trainable").select("conv_id", "example", "position", (F.col("position") - 1).alias("context_turns"),
                                           F.col("loss_start").alias("context_chars"), "loss_chars",
                                           (F.col("start") + F.length("piece")).alias("chars"))


def rests(turns: DataFrame) -> DataFrame:
    """Of ``formatted`` rows, what no reply follows: conv_id, example, position of the last turn of each conversation that
    does not end with a reply.  Expanded, its text is the whole conversation, with nothing trainable."""
    last = turns.groupBy("conv_id").agg(F.max_by(F.struct("trainable", "example", "position"), "position").alias("last"))
    return last.where("NOT last.trainable").select("conv_id", "last.example", "last.position")


def expand(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """The full texts of the examples in ``chosen`` (conv_id, example, position): conv_id, example, text, context_chars, loss_chars
    (null where nothing is trainable), whole (the text holds the whole conversation).  Its size is that of the examples, each with
    all its context; what is shuffled follows the turns, which meet once by conversation and are written out from there."""
    turn = F.struct("position", "piece", "trainable", (F.col("start") + F.length("piece")).alias("end"), "loss_start", "loss_chars")
    asked = F.struct("example", "position")
    rows = turns.select("conv_id", turn.alias("turn"), F.lit(None).alias("asked")).unionByName(
        chosen.select("conv_id", F.lit(None).alias("turn"), asked.alias("asked")))
    met = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.collect_list("asked").alias("asked"))
    ends = F.transform("asked", lambda a: F.struct(a["example"].alias("example"), F.get("turns", a["position"].cast("int") - 1).alias("last")))
    each = met.select("conv_id", F.transform("turns", lambda t: t["piece"]).alias("pieces"), F.explode(ends).alias("x"))
    own, upto = F.col("x.last.trainable"), F.col("x.last.position").cast("int")
    return each.select("conv_id", "x.example", F.array_join(F.slice("pieces", F.lit(1), upto), "").alias("text"),
                       F.when(own, F.col("x.last.loss_start")).otherwise(F.col("x.last.end")).alias("context_chars"),
                       F.when(own, F.col("x.last.loss_chars")).alias("loss_chars"), (upto == F.size("pieces")).alias("whole"))


def read_back(expanded: DataFrame) -> DataFrame:
    """Of ``expand`` rows: conv_id, example, ``learned``, the unescaped text under the loss mask (null where nothing is trainable),
    and of whole conversations ``turns``, the role and text found between the marks of each turn, and ``chars``."""
    def turn(piece):
        opened = F.substring_index(piece, SAYS, 1)
        said = F.substr(piece, F.length(opened) + len(SAYS) + 1)
        return F.struct(unescaped(F.substr(opened, F.lit(len(TURN) + 1))).alias("role"), unescaped(said).alias("text"))

    pieces = F.split("text", END.replace("|", r"\|"))   # the part after the last mark is empty
    masked = F.substr("text", (F.col("context_chars") + 1).cast("int"), F.col("loss_chars").cast("int"))
    return expanded.select("conv_id", "example", unescaped(masked).alias("learned"),
                           F.when(F.col("whole"), F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)).alias("turns"),
                           F.when(F.col("whole"), F.length("text").cast("long")).alias("chars"))


def digests(turns: DataFrame) -> DataFrame:
    """Of ``formatted`` rows, a row a conversation: what was read back from its examples, all written out, and n_examples."""
    chosen = examples(turns).select("conv_id", "example", "position").unionByName(rests(turns))
    rows = read_back(expand(turns, chosen))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "example", "learned", "chars", F.size("turns").cast("long").alias("n"), F.sha2(lines.cast("binary"), 256).alias("digest"))
    kept = F.array_sort(F.collect_list(F.when(F.col("learned").isNotNull(), F.struct("example", "learned"))))
    whole = rows.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("digest").alias("turns_sha256"), kept.alias("kept"),
                                        F.max("chars").alias("formatted_chars"), F.count("learned").alias("n_examples"))
    return whole.withColumn("said", F.array_join(F.transform("kept", lambda s: s["learned"]), "")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("said").cast("long").alias("loss_chars"),
        F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def probe(chats: DataFrame) -> DataFrame:
    """The conversations (conv_id, turn, role, text) and conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    more = chats.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chats.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(more)


#: DuckDB SQL of the query: digests of the plain turns; the characters of the marked text from the same escapes.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IS NULL AS r0, text IS NULL AS t0 FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', false, false), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', false, false)),
e AS (SELECT *, length('<|turn|><|says|><|end|>')
        + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>>|\|(?:turn|says|end)\|>)', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>>|\|(?:turn|says|end)\|>)', '\1\\\2\3', 'g')) AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS said,
             sum(chars) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, n_examples::BIGINT AS n_examples FROM g
"""
