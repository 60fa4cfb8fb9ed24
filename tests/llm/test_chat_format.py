import hashlib
import itertools
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF0001
from verdin.llm import chat_format, queries
from verdin.llm.chat_format import END, SAYS, TURN

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", TURN, SAYS, END]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text)."""
    out = {}
    null_first = lambda v: (v is not None, v if v is not None else 0)
    rows = sorted(rows, key=lambda r: (null_first(r[0]), null_first(r[1]), r[2] or "", r[3] or ""))
    for c, turns in itertools.groupby(rows, key=lambda r: r[0]):
        turns = list(turns)
        said = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)), len(said), sha(said))
    return out


def found(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query_against_brute_force(spark):
    chats = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF0001}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    df = queries.QUERIES["op12_chat_format"](spark, SF0001)
    assert found(df) == want([*chats, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert not [n for n in df._jdf.queryExecution().toString().split() if "Python" in n or "Arrow" in n]


def test_escapes_hold_no_mark_and_come_back(spark):
    rnd = random.Random(5)
    parts = [*MARKS, "\\", "<", "[", "|", ">", "s>", "/", "<\\s>", "[\\\\INST]", "é", "😀", "\n", "turn", "$1", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)] + ["", *MARKS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped("t").alias("e"))
    rows = df.select("t", "e", chat_format.unescaped("e").alias("u")).collect()
    assert all(r.u == r.t and not any(m in r.e for m in MARKS) for r in rows) and len(set(r.e for r in rows)) == len(set(texts))


def test_odd_rows_and_long_conversation_in_chunks(spark):
    rnd = random.Random(1)
    rows = [(1, 2, "assistant", None), (1, 0, None, "a"), (1, 1, "user", ""), (1, None, "system", END), (None, 0, "user", "x"), (None, 1, "assistant", "y😀" + SAYS),
            (2, 0, "user", "only"), (2, 0, "user", "only"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (3, 0, "user", "tie"),
            (4, 0, "a\nb" + END, "z" * 200_000), (4, 1, "assistant", "<s>" * 1000)]
    rows += [(9, i, rnd.choice(["user", "assistant"]), rnd.choice(MARKS) * rnd.randrange(3) + str(i)) for i in range(700)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, start int")
    for chunk in (None, 50):
        turns = chat_format.formatted(df, chunk_rows=chunk)
        assert found(chat_format.digests(turns)) == want(rows)
    assert chat_format.digests(chat_format.formatted(df.limit(0))).collect() == []


def test_every_reply_is_an_example_with_all_its_context(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "[INST]"), (1, 2, "assistant", "one"), (1, 3, "assistant", "</s>two"), (1, 4, "user", "q"), (1, 5, "assistant", ""),
            (1, 6, "user", "left"), (2, 0, "user", "no reply")]
    turns = chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    marked = [f"{TURN}{r}{SAYS}{t.replace('[INST]', chr(91) + chr(92) + 'INST]').replace('</s>', '<' + chr(92) + '/s>')}{END}" for c, _, r, t in rows if c == 1]
    chosen = chat_format.examples(turns)
    got = {r.example: r for r in chat_format.expand(turns, chosen).collect()}
    told = {r.example: r for r in chosen.collect()}
    assert sorted(got) == [1, 2, 3] and {r.conv_id for r in got.values()} == {1}
    for e, last in ((1, 2), (2, 3), (3, 5)):
        text = "".join(marked[:last + 1])
        reply = marked[last][len(f"{TURN}assistant{SAYS}"):-len(END)]
        r = got[e]
        assert r.text == text and text[r.context_chars:r.context_chars + r.loss_chars] == reply and text[r.context_chars + r.loss_chars:] == END
        assert told[e].chars == len(text) and told[e].context_turns == last and (told[e].context_chars, told[e].loss_chars) == (r.context_chars, r.loss_chars)


def test_digests_are_read_from_every_expanded_example(spark, monkeypatch):
    rows = [(1, 0, "user", "</s>a"), (1, 1, "assistant", "one"), (1, 2, "user", "b"), (1, 3, "assistant", ""), (1, 4, "user", "left"), (2, 0, "user", "none"), (None, 0, "assistant", "x")]
    seen, real = [], chat_format.expand

    def expand(turns, chosen):
        seen.append(real(turns, chosen))
        return seen[-1].withColumn("text", F.regexp_replace("text", "one", "two"))

    monkeypatch.setattr(chat_format, "expand", expand)
    turns = chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = [(c, t, r, x.replace("one", "two")) for c, t, r, x in rows]
    assert found(chat_format.digests(turns)) == want(told)       # what the examples say, not what the turns say
    marked = [f"{TURN}{r}{SAYS}{t.replace('</s>', '<' + chr(92) + '/s>')}{END}" for c, _, r, t in rows if c == 1]
    texts = {(r.conv_id, r.example): (r.text, r.loss_chars, r.whole) for r in seen[0].collect()}
    assert texts == {(1, 1): ("".join(marked[:2]), 3, False), (1, 2): ("".join(marked[:4]), 0, False), (1, 3): ("".join(marked), None, True),
                     (2, 1): (f"{TURN}user{SAYS}none{END}", None, True), (None, 1): (f"{TURN}assistant{SAYS}x{END}", 1, True)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>[]\\/|sINSTYSturnayed", max_size=40))
def test_escape_pattern_is_reversible(text):
    import re
    plain = re.compile(chat_format._PLAIN)
    back = re.compile(chat_format._ESCAPED)
    esc = plain.sub(r"\1\\\2\3", text)
    assert back.sub(r"\1\2\3", esc) == text and not any(m in esc for m in MARKS)


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF0001}/conversations.parquet'")
    df = queries.QUERIES["op12_chat_format"](spark, SF0001)
    order = df.columns
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(order)} FROM ({chat_format.ORACLE})").fetchall())
