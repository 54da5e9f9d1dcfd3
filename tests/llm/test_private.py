import hashlib
import random
import re

from pyspark.sql import functions as F

from brindle.llm import private as P

SLOW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def slow(text):
    out = []
    for k, kind in enumerate(SLOW):
        out += [(m.start(), k, m.end()) for m in re.finditer(SLOW[kind], text or "") if fine(kind, m[0])]
    return sorted(out)


def name(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_random_texts_match_brute_force(spark):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@x.yz", ".", "-", "_", " ", "1", "22", "333", "255", "256", "007", "+1", "+49", "(", ")", "4111 1111 1111 1111", "é", "😀", "\n", "/", "4111-1111-1111-1112"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(600)]
    texts += [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@b.cd@e.fg", "9" * 30_000, "x" * 50_000 + "@", "a.b@c" + ".d" * 20_000, "1 " * 9000, "+1" * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = P.base_spans(df, P.text_of("text")).select("doc_id", P.spans_text(F.array_sort(F.concat(*P.PATTERNS))).alias("s")).collect()
    for r in rows:
        assert r.s == name(slow(texts[r.doc_id])), texts[r.doc_id]


def test_query_keeps_the_base(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = P.op9_disclosure(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 10
    for r in got:
        base = slow(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert set(name(base).split(",")) <= set(r.spans.split(","))
        assert [sum(k == j for _, k, _ in base) for j in range(4)] == [r.n_email, r.n_ip, r.n_card, r.n_phone]


def test_terms_that_go_with_one_entity_are_found(spark):
    rng = random.Random(6)
    common = ["the", "of", "and", "mail", "call", "now", "here", "see"]
    rows = []
    for i in range(300):
        line = [rng.choice(common) for _ in range(8)]
        if i % 30 == 0:
            line[3:5] = ["Zorblax,", f"zed{chr(97 + i // 30)}@corp.example"] if i < 150 else ["Quibble", "zed@corp.example"]
        rows.append((i, " ".join(line)))
    rows += [(500, "QUIBBLE alone, quibbles not; quibble!"), (501, rows[150][1]), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in P.disclosing(df).collect()] == [("quibble", False)] or {r.term for r in P.disclosing(df).collect()} == {"quibble"}
    out = {r.id: r for r in P.personal(df).withColumn("said", P.spans_text(F.col("spans"))).collect()}
    assert out[500].said == "term:0:7,term:29:36" and out[502].said == ""
    clean = df.join(P.personal(df).withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", P.sanitised(F.coalesce("text", F.lit("")), F.col("spans")).alias("t"))
    said = {r.doc_id: r.t for r in clean.collect()}
    assert said[500] == "<TERM> alone, quibbles not; <TERM>!" and "@" not in "".join(said.values())


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a@b.cd", "z")], "doc_id long, text string, email string")
    got = P.personal(df)
    assert got.count() == 4 and got.agg(F.sum("n_email")).first()[0] == 1
    assert P.personal(df.limit(0)).count() == 0


def test_overlapping_spans_leave_no_tail_and_removed_ones_go(spark):
    text = "+1 555 123 4567foo@bar.com or Quibble, x"
    df = spark.createDataFrame([(1, text, [(0, 3, 15), (13, 0, 26), (30, 4, 37)], [(30, 4, 37)])], f"id long, text string, spans {P.SPAN}, removed {P.SPAN}")
    plain, cut = df.select(P.sanitised(F.col("text"), F.col("spans")), P.sanitised(F.col("text"), F.col("spans"), F.col("removed"))).first()
    assert plain == "<PHONE> or <TERM>, x" and cut == "<PHONE> or , x"


def test_terms_that_go_with_one_entity_alone_are_removed(spark):
    rows = [(i, f"plain words of line {chr(97 + i % 26)} {chr(97 + i // 26)}") for i in range(200)]
    rows += [(500 + i, f"Quibble said {w} zed@corp.example") for i, w in enumerate(["aa", "bb", "cc", "dd"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.personal(df)
    assert {tuple(s) for r in out.where("id >= 500").collect() for s in r.removed} >= {(0, 4, 7)}
    joined = df.join(out.withColumnRenamed("id", "doc_id"), "doc_id").where("doc_id >= 500")
    said = [r[0] for r in joined.select(P.sanitised(F.col("text"), F.col("spans"), F.col("removed"))).collect()]
    assert len(said) == 4 and not any("Quibble" in t or "<TERM>" in t or "@" in t for t in said)


def test_terms_far_off_or_on_other_lines_are_found(spark):
    fill = lambda i, n: " ".join(f"f{chr(97 + (i * 7 + k) % 26)}{chr(97 + k % 5)}" for k in range(n))
    rows = [(i, fill(i, 30)) for i in range(100)]
    for i in range(6):
        rows.append((200 + i, f"Quibble {fill(i, 25)} zed@corp.example"))
        rows.append((300 + i, f"Zorblax\n{fill(i, 9)}\nyes@corp.example"))
        rows.append((400 + i, f"Wumpus, room 12, {fill(i, 3)} 4111 1111 1111 1111"))
    rows += [(500 + i, "Snark\n\nno@corp.example") for i in range(9)]
    got = {r.term for r in P.disclosing(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {"quibble", "zorblax", "wumpus"} <= got and "snark" not in got


def test_secrets_are_found_by_the_words_that_announce_them(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    prose = lambda: " ".join(word() for _ in range(30))
    key = lambda: "".join(rng.choices("0123456789abcdef", k=39)) + "7a"
    keys = [key() for _ in range(12)]
    rows = [(k, f'{prose()}\nToken = "{keys[k]}" and {prose()} é', 1) for k in range(10)]
    rows += [(20 + k, rows[0][1], 1) for k in range(5)]  # copies are one witness
    rows += [(30, f"{prose()} {keys[3]}.", 1), (31, f"{prose()} about {keys[10]} x", 0), (32, f"about {prose()}", 0), (33, f"about {prose()}", 0)]
    rows += [(40 + k, f"about {prose()}", 0) for k in range(40)]  # a common word stands before identifiers by chance
    rows += [(90 + k, f"about {key()} {prose()}", 0) for k in range(3)]
    rows += [(100, "https://example/" + "a" * 40, 0), (101, "1" * 40, 0), (102, None, 0), (103, "", 0), (104, f"token={keys[1]}", 1), (104, f"token={keys[1]}", 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, want int, spans string")
    got = P.personal(df.drop("want")).withColumn("said", P.spans_text(F.col("secret"))).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        found = [tuple(map(int, x.split(":")[1:])) for x in r.said.split(",") if x.startswith("secret")]
        assert len(found) == {i: w for i, _, w in rows}[r.id], r.id
        assert all(texts[r.id][a:b] in keys for a, b in found)
    cut = df.join(P.personal(df), df.doc_id == F.col("id")).where("doc_id = 2").select(P.sanitised(F.col("text"), F.col("secret"), F.col("removed"))).first()[0]
    assert keys[2] not in cut and cut.replace('""', f'"{keys[2]}"') == texts[2]


def test_query_finds_the_secrets_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in P.op9_disclosure(spark, "/root/testdata/sf0.01").collect()}
    want = {i: [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "", re.I)] for i, t in docs.items()}
    found = {i: [tuple(map(int, x.split(":")[1:])) for x in r.secret_spans.split(",") if x] for i, r in got.items()}
    assert found == want and sum(map(len, want.values())) >= 13
    assert all(r.n_secret == len(want[i]) for i, r in got.items())
