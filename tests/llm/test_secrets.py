"""Secret scans: base spans by the plain patterns over text, links by comparing all pairs of parts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import queries, secrets

BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
}
WEAK = {
    "endpoint": (r"\b(https?|ftp|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[!#-&(-;=?-~]{4,}", re.I | re.A, lambda m: True),
    "id": (r"""\b(user|user_?name|login|account_?id|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", re.I | re.A, lambda m: len(m[2]) >= 4),
    "key": (r"[A-Za-z0-9+/_-]{20,}", 0, lambda m: all(re.search(x, m[0]) for x in ("[0-9]", "[A-Z]", "[a-z]"))),
}
KINDS = [*BASE, *WEAK]
ROLE = dict(zip(KINDS, ("secret", "identifier", "secret", "endpoint", "identifier", "secret"), strict=True))


def spans(text, kinds):
    return {k: [m.span() for m in re.finditer(p, text or "", flags) if right(m)] for k, (p, flags, right) in kinds.items()}


def brute(text, reach=200):
    text = text or ""
    base, weak = spans(text, BASE), spans(text, WEAK)
    taken = [x for v in base.values() for x in v]
    for k in WEAK:
        weak[k] = [(a, b) for a, b in weak[k] if not any(c < b and a < d for c, d in taken)]
        taken = taken + weak[k]
    breaks = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = {a: sum(x <= a for x in breaks) for v in (base | weak).values() for a, _ in v}
    every = [(a, KINDS.index(k), b) for k, v in (base | weak).items() for a, b in v]
    linked = []
    for a, n, b in every:
        if KINDS[n] in WEAK:
            for c, m, d in every:
                roles = {ROLE[KINDS[n]], ROLE[KINDS[m]]}
                if len(roles) == 2 and "secret" in roles and scope[a] == scope[c] and 0 <= max(c - b, a - d) <= reach:
                    linked.append((a, n, b))
                    break
    own = sorted(x for x in every if KINDS[x[1]] in BASE)
    show = lambda rows: ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in sorted(rows))
    return (*(len(base[k]) for k in BASE), hashlib.sha256(show(own).encode()).hexdigest(), show(own + linked))


def texts():
    r = random.Random(11)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda n: "".join(r.choice("ABCxyz0189+/_-") for _ in range(n))
    pieces = [
        lambda: f'{r.choice(["password", "TOKEN", "Api_Key", "apikey", "paſſword", "toKen", "secret"])}{r.choice(["=", ": ", chr(34) + " : " + chr(39), "  ", " = = "])}{word(r.choice([3, 8, 20]))}',
        lambda: "AKIA" + "".join(r.choice("ABCDEF0123456789") for _ in range(r.choice([4, 11, 12, 16]))),
        lambda: hexes(r.choice([8, 31, 32, 40])),
        lambda: f"{r.choice(['https', 'HTTP', 'redis', 'xhttp', 'gopher'])}://{r.choice(['api.example.org/v1?user=longname', 'a', 'é.com', 'db:5432/x'])}",
        lambda: f"{r.choice(['user', 'login', 'client_id', 'AccountId', 'superuser'])}{r.choice(['=', ': ', ' '])}{r.choice(['bob', 'robert', 'a.b@c.org'])}",
        lambda: word(r.choice([19, 20, 24, 60])),
        lambda: r.choice(["und", "é", "한글", "ÄÖ", "the quick", "\n", "\n\n", "\n \t\n", "\r\n\r\n", ".", "x" * 90, "\x01\x02", "😀"]),
    ]
    made = ["".join(r.choice(pieces)() + r.choice([" ", " ", "\n", ""]) for _ in range(r.choice([1, 3, 8, 40]))) for _ in range(400)]
    return [None, "", " ", "AKIA", "token=", "token: secret=abcdefgh12", *made, " ".join(r.choice(pieces)() for _ in range(1_500)), "a1B" * 3000 + " user: someone", ("password = " + "x" * 500_000)]


@pytest.fixture(scope="module")
def docs(spark):
    data = list(enumerate(texts()))
    data += [data[20], (20, "token = 12345678"), (None, "token = 12345678")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for name in ("row", "kind", "start", "end", "scope", "base", "weak", "linked", "cell", "role", "partner"):
        df = df.withColumn(name, F.lit("x"))
    return df


def digests(found):
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind))
    made = found.select("doc_id", *map(number, BASE), F.sha2(secrets.listed("base").cast("binary"), 256), secrets.listed("base", "linked"))
    return sorted(map(tuple, made.collect()), key=str)


def test_scan_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert digests(secrets.secret_scan(docs)) == want
    assert sum(",id:" in w[-1] or ",key:" in w[-1] for w in want) > 20 and any("endpoint:" in w[-1] for w in want)
    assert digests(secrets.secret_scan(docs.where("doc_id < 60"), reach=10)) == sorted(((i, *brute(t, 10)) for i, t in rows if i is not None and i < 60), key=str)


def test_sql_equals_scan_on_odd_texts(spark, docs):
    import duckdb

    con = duckdb.connect()
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 5000 OR text IS NULL").select("doc_id", "text").collect()]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = con.execute(queries.ORACLE_SQL["op12_secret_scans"]).fetchall()
    assert sorted(((r[0], *r[1:]) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_weak_parts_need_partners(spark):
    data = [(1, "user: someone and nothing else"), (2, "user: someone\npassword = longenough"), (3, "user: someone\n\npassword = longenough"), (4, "see https://x.example/login user: someone"), (5, "https://x.example/a Zx9abcdefghijklmnopqr")]
    got = {r.doc_id: [(x.kind, x.partner.kind, x.partner.start) for x in r.linked] for r in secrets.secret_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [("id", "assign", 14)], 3: [], 4: [], 5: [("endpoint", "key", 20), ("key", "endpoint", 0)]}


def test_nothing(spark):
    assert secrets.secret_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
