import hashlib
import random
import re
import string

import brute
import edge

from textmill.llm import queries, secrets

SF = "/root/testdata/sf0.01"
PATTERNS = [("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
             r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", r"(AKIA[A-Z0-9]+)", 16), ("hex", r"([0-9a-f]+)", 32)]
ORDER = {k: i for i, k in enumerate(secrets.KINDS)}


def base(text):
    return [(k, *m.span()) for k, p, n in PATTERNS for m in re.finditer(p, text or "") if len(m.group(1)) >= n]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


def linked(text, reach):
    strong = base(text)
    weak = secrets.weak_spans(text or "", strong)
    blocks = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text or "")]
    scope = lambda s: sum(b <= s for b in blocks)
    out = []
    for k, s, e in weak:
        roles = {secrets.ROLES[k2] for k2, s2, e2 in strong + weak if scope(s2) == scope(s) and max(s2 - e, s - e2) <= reach} - {secrets.ROLES[k]}
        role = secrets.ROLES[k]
        if (role == "identifier" and "secret" in roles or role == "secret" and roles or role == "endpoint" and len(roles) == 2):
            out.append((k, s, e))
    return out


def same(docs, reach=secrets.REACH):
    want = [(d["doc_id"], joined(base(d["text"])), joined(base(d["text"]) + linked(d["text"], reach))) for d in brute.rows(docs)]
    r = secrets.find(docs, reach)
    got = r.select("doc_id", secrets.listed(r.base).alias("b"), secrets.listed(
        secrets.F.concat(r.base, secrets.F.transform("linked", lambda s: secrets.F.struct(s["kind"], s["start"], s["end"])))).alias("a")).collect()
    assert sorted(map(str, got and [tuple(x) for x in got])) == sorted(map(str, want))
    return want


def test_registered_query(spark):
    got = {r["doc_id"]: r for r in brute.rows(queries.op2_credential_links(spark, SF))}
    for d in brute.read(spark, SF, "documents"):
        r, b = got[d["doc_id"]], base(d["text"])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for x, _, _ in b) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(joined(b).encode()).hexdigest()
        assert r["spans"] == joined(b + linked(d["text"], secrets.REACH))
    assert any(r["n_assign"] for r in got.values())


def test_edges(spark):
    same(edge.edge_docs(spark))
    same(edge.empty_docs(spark))
    texts = ["paſſword=12345678 toKen: 'abcdefgh'", "password=token=abcdefgh1 secret = x passwd:'1234567'", "AKIA" + "A" * 11 + " AKIA" + "B" * 12,
             "xAKIAAKIA12AKIA99", "a" * 31 + "g" + "a" * 32, 'api_key" : "abc=/+.-_" APIKEY==12345678', "é😀 password=abcdefgh" * 30]
    same(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], brute.DOCS))


def test_links_need_complementary_parts(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    makers = [lambda: f"user={word(6)}", lambda: f"client_id: '{word(9)}'", lambda: word(40), lambda: f"password={word(5)}", lambda: f"token={word(20)}",
              lambda: "AKIA" + word(16).upper(), lambda: f"https://{word(8)}.example.org/x", lambda: "\n\n", lambda: "\n", lambda: " lorem ipsum " * 8]
    docs = [(i, " ".join(r.choice(makers)() for _ in range(r.randrange(1, 60))), "en", "s", 1) for i in range(150)]
    want = same(spark.createDataFrame(docs, brute.DOCS), 60)
    assert sum(a != b for _, b, a in want) > 50
    long = [f"token={'x' * 500}\nuser=bob", f"user=bob {'y' * 450} https://h/{'z' * 900} client_id=abc", "user=bob" + " " * 400 + "token=abcdefgh", "user=bob" + " " * 401 + "token=abcdefgh",
            f"user=bob {'f0' * 3000} https://example.org/a"]
    want = same(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(long)], brute.DOCS))
    assert [a.count("identifier") for _, _, a in want] == [1, 0, 1, 0, 1]
    alone = spark.createDataFrame([(1, "user=someone", "", "", 1), (2, "see https://example.org/a", "", "", 1), (3, "k " + "aB3" * 13 + "z k", "", "", 1)], brute.DOCS)
    assert all(not b and not a for _, b, a in same(alone))
