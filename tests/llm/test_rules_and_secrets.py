import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from verdin.llm import decontaminate as D
from verdin.llm import quality_rules as Q
from verdin.llm import trigram_secrets as S


def measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen: dict = {}
    for w in win:
        seen[w] = seen.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(win) if seen[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_measurements_equal_brute_force(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["a", "bb", "ccc", "é ß", "#x"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    texts += ["", None, " \n\n ", "one two three four five six seven eight " * 4, "x\ny\nx\nx \n\n", "  a\x0bb\x0cc\x1fd", "w " * 30000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.ledger(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measure(t), t
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: r[1:] for r in con.execute(Q.ORACLE).fetchall()}
    for i, r in got.items():
        assert want[i] == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.fail_bits & 3 != 0, r.fail_bits == 0, r.fail_bits)


def test_policies_and_ablation_from_bits(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (3,), (32,), (None,)][:5], "fail_bits long")
    report = {r.policy: (r.n, r.n_kept) for r in Q.policy_report(book).collect()}
    assert report["base"] == (5, 2) and report["v2"] == (5, 1)
    rules = {r.rule: (r.n_failed, r.n_only) for r in Q.ablation(book, "base").collect()}
    assert rules == {"few_words": (3, 2), "repeated_windows": (1, 0)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.ledger(empty).collect() == [] and Q.policy_report(Q.ledger(empty)).collect() == []


def brute_spans(text, rules):
    fixed = {"access": (r"AKIA[A-Z0-9]+", 20), "hex": (r"[0-9a-f]+", 24)}
    out = []
    for k, r in enumerate(rules):
        pattern, least = fixed.get(r.kind, (r.pattern.replace("(?i)", ""), r.least))
        for m in re.finditer(pattern, text or "", (re.I if "(?i)" in r.pattern else 0) | re.A):
            if len(m.group(r.part)) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_trigram_queries():
    assert S.trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert {frozenset(c) for c in S.trigram_query("ab(c|de)f")} == {frozenset({"abc", "bcf"}), frozenset({"abd", "bde", "def"})}
    assert S.trigram_query("[0-9a-f]+") is None and S.trigram_query("a?b?c?") is None and S.trigram_query("(abc|d+)") is None
    assert S.trigram_query("abc[0-9]+xyz") == [frozenset({"abc", "xyz"})]
    assert S.trigram_query("(abc)+") == [frozenset({"abc"})]


SECRETS = ["password: hunter22 x", 'API_KEY = "abcdef123"', "apikey=abc token:zzzzzzz", "secret=token:abcdef", "passwdpassword=token=abcdefg",
           "AKIA" + "A1" * 8, "xAKIAAKIA" + "Z9" * 9 + "z", "deadbeef" * 3, "g" + "0123456789abcdef" * 4 + "g", "é 🎉 token = '" + "a1" * 20 + "'",
           "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890-x", "eyJhbGciOi12.eyJzdWIiOi12.abcdefgh_-", "", None, "nothing here",
           "token = " + "f" * 30 + " Token=" + "f" * 30, "PASSWORD=x" * 3]


def test_secrets_equal_brute_force(spark):
    rnd = random.Random(1)
    rules = S.BASE + S.MORE
    texts = SECRETS + ["".join(rnd.choice([x or "" for x in SECRETS] + [" ", "\n", "ü"]) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts.append(" ".join(x or "" for x in SECRETS) * 200)
    rows = [(i if i % 9 else None, t, "e") for i, t in enumerate(texts)] + [(1, texts[1], "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = S.find_secrets(df, rules).toDF("doc_id", "text", "spans", "got").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.a, s.k, s.b) for s in r.got] == brute_spans(r.text, rules), r.text
    for r in S.redact(df, rules, n_chars=None).collect():
        assert not brute_spans(r.text, rules) or "[SECRET]" in r.text
    clean = spark.createDataFrame([(1, "a token = 'abcdef99' b", 5), (2, None, 0), (3, "plain", 9)], "doc_id long, text string, n_chars long")
    assert sorted(tuple(r) for r in S.redact(clean, n_chars="n_chars").collect()) == [(1, "a [SECRET]' b", 13), (2, None, 0), (3, "plain", 9)]
    assert S.find_secrets(df.limit(0), rules).collect() == []


def brute_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1]))
        prev = cur
    return min(prev)


def test_bit_parallel_distance():
    rnd = random.Random(1)
    for _ in range(400):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 80)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90)))
        want = brute_distance(p, t)
        assert D.distance(p, t, 99) == want and D.distance(p, t, want - 1) is None


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(6)
    letters = "abcdefghij  "
    items = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(60, 120))).strip()) for i in range(6)] + [(7, "short item"), (8, None), (9, "..."), (None, "another one of sixty characters, or even more of them, say 70")]
    rows = []
    for k in range(60):
        base = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200)))
        item = list(rnd.choice(items[:6])[1])
        for _ in range(rnd.randint(0, 12)):
            item[rnd.randrange(len(item))] = rnd.choice(["", "x", "zz", " "])
        rows.append((k, base + "".join(item) + base[::-1], "k"))
    rows += [(100, None, ""), (101, "", ""), (102, "A SHORT,  item!", ""), (102, "A SHORT,  item!", ""), (103, "shortitem", ""), (None, items[0][1].upper(), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t, _ in rows:
        for i, x in items:
            p = D.plain(x)
            if p:
                k = int(0.08 * len(p)) if len(p) >= 50 else 0
                got = brute_distance(p if k else f" {p} ", f" {D.plain(t)} ") if t else 99
                if got <= k:
                    want[(d, i)] = got
    for block in (100, 10**6):
        got = D.matches(docs, bench, block_chars=block).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, f["item"]): f["distance"] for r in got for f in r[1]} == want
    kept = D.clean(docs, bench).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _, _ in rows if not any(d == w for w, _ in want)) and kept[0].asDict().keys() == {"doc_id", "text", "found"}
    assert D.matches(docs.limit(0), bench).collect() == [] and len(D.clean(docs, bench.limit(0)).collect()) == len(rows)


def test_short_items_have_the_edit_budget_of_their_length(spark):
    rnd = random.Random(3)
    items = [(m, "".join(rnd.choice("abcdefgh") for _ in range(m))) for m in (12, 13, 25, 38, 49)]
    rows = []
    for i, x in items:
        for edits in range(5):
            places = rnd.sample(range(1, len(x) - 1), edits)
            rows.append((i * 10 + edits, "qq " + "".join("z" if k in places else c for k, c in enumerate(x)) + " rr"))
    got = {(r.doc_id, f["item"]): f["distance"] for r in D.matches(spark.createDataFrame(rows, "doc_id long, text string"),
                                                                   spark.createDataFrame(items, "item_id long, text string")).collect() for f in r.found}
    assert got == {(i * 10 + e, i): e for i, x in items for e in range(5) if e <= len(x) * 8 // 100}


def test_a_private_key_goes_with_its_body(spark):
    rnd = random.Random(4)

    def pem(lines, kind="RSA ", head="", eol="\n", end=True, last="Zm9v=="):
        body = [*("".join(rnd.choice("ABCxyz019+/") for _ in range(64)) for _ in range(lines)), last]
        return eol.join([f"-----BEGIN {kind}PRIVATE KEY-----", *head.split("|"), *body][:None if head else 1] + ([] if head else body)) + \
            (f"{eol}-----END {kind}PRIVATE KEY-----" if end else "")

    keys = [pem(3), pem(25, ""), pem(3, "EC ", eol="\r\n"), pem(3, eol="\\n"), pem(2, head="Proc-Type: 4,ENCRYPTED|DEK-Info: AES-128-CBC,0A1B|"),
            pem(5, end=False), pem(5, end=False, eol="\\n"), pem(3, head="Proc-Type: 4,ENCRYPTED|DEK-Info: AES-128-CBC,0A1B|", end=False),
            pem(20_000), pem(20_000, end=False), "-----BEGIN PRIVATE KEY-----"]
    rows = [(i, f"before\n{k}\nafter it - all of this stays -----") for i, k in enumerate(keys)]
    rows += [(50, "x " + keys[0] + "\n" + keys[5] + "\n" + keys[1] + " y"), (51, "-----BEGIN PRIVATE KEY----- " + "a - b -- c --- " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.redact(df).collect()}
    for i in range(len(keys)):
        assert got[i] == "before\n[SECRET]\nafter it - all of this stays -----", (i, got[i][:200])
    assert got[50] == "x [SECRET]\n[SECRET]\n[SECRET] y"
    assert got[51] == "[SECRET] " + "a - b -- c --- " * 20_000
    for r in S.find_secrets(df).toDF("doc_id", "text", "got").collect():
        assert [(s.a, s.k, s.b) for s in r.got] == brute_spans(r.text, S.BASE + S.MORE)


def test_one_block_of_the_benchmark_is_held_at_a_time(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(i if i else None, "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(60, 90)))) for i in range(30)]
    bench = spark.createDataFrame([*items, items[3], (99, None)], "item_id long, text string")
    docs = spark.createDataFrame([(k % 20, None if k == 7 else f"{rnd.choice(items)[1]} and {items[k % 5][1]}") for k in range(40)], "doc_id long, text string")
    want = sorted(map(repr, D.matches(docs, bench).collect()))
    kind, live, most = type(spark.sparkContext.broadcast(0)), set(), []
    make, free = type(spark.sparkContext).broadcast, kind.destroy

    def tracked(self, value):
        out = make(self, value)
        live.add(id(out))
        most.append((len(live), sum(len(t or "") for _, t in value)))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", tracked)
    monkeypatch.setattr(kind, "destroy", lambda self, *a: (live.discard(id(self)), free(self, *a)))
    got = D.matches(docs, bench, block_chars=300)
    assert sorted(map(repr, got.collect())) == want and not live
    assert len(most) > 5 and max(n for n, _ in most) == 1 and max(c for _, c in most) <= 300


def test_the_secrets_query_counts_every_kind(spark, tmp_path):
    from verdin.llm.queries import QUERIES
    texts = [*SECRETS, "token=abcdef " * 300, "f" * 24 + " " + "e" * 24, "AKIA" + "Z" * 16 + " secret: 'abcdef'"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_trigram_secrets"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = brute_spans(t, S.BASE)
        said = ",".join(f"{S.BASE[k].kind}:{a}:{b}" for a, k, b in spans)
        want = [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256] == [*want, hashlib.sha256(said.encode()).hexdigest()], t
