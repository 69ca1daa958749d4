"""Lexical search, personal data and spelling variants against brute force and their SQL on small rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from postlens.llm import personal, search, spelling

DOCS = "doc_id long, text string, spans long, n long, word string, item_id long, score double, block long"


def docs(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 5, 7, "k", 3, 0.5, 1) for i, t in rows], DOCS)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.execute(f"CREATE TABLE {name} ({'item_id' if name == 'benchmark' else 'doc_id'} BIGINT, text VARCHAR)")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(df, sql, **tables):
    names, want = by_sql(sql, **tables)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


# --- search -------------------------------------------------------------------------------------

def ranked(rows, items, k):
    """Every item against every document, term by term."""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c.group().lower(), t or ""))
    counts = [(i, Counter(split(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * c.total() * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in own if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeñ1") for _ in range(rng.randrange(1, 5))) for _ in range(160)]
    pick = lambda n: " ".join(rng.choices(words, k=n, weights=range(1, 161)))
    rows = [(i, pick(rng.randrange(1, 60)).title()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(300, 420)] + [rows[7]] * 5            # ties and repeated rows
    rows += [(900, None), (901, ""), (902, " .,\x7f"), (903, "a " * 30_000), (None, rows[5][1]), (904, "É é ÀÀ１")]
    common = pick(20)
    items = [(i, common + " " + pick(rng.randrange(1, 25))) for i in range(40)]
    items += [(50, None), (51, "?!"), (52, "zzzzzzz"), (53, "a"), (7, pick(9)), (None, pick(5)), (54, "é àà１")]
    return rows, items


@pytest.mark.parametrize("terms_a_block", [100_000, 250])
def test_search_equals_plain_ranking(spark, corpus, terms_a_block, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", terms_a_block)
    rows, items = corpus
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank long")
    for k in (50, 3):
        got = [tuple(r) for r in search.search(docs(spark, rows), asked, k).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=str) == sorted(ranked(rows, items, k), key=str)


def test_search_equals_its_sql_and_takes_empty_tables(spark, corpus):
    rows, items = corpus
    asked = spark.createDataFrame(items, "item_id long, text string")
    same(search.search(docs(spark, rows), asked), search.SQL, documents=rows, benchmark=items)
    assert search.search(docs(spark, []), asked).collect() == []
    assert search.search(docs(spark, rows), asked.limit(0)).collect() == []
    assert search.search(docs(spark, rows), asked.where("item_id = 51")).collect() == []
    named = asked.where("item_id < 3").selectExpr("concat('q', item_id) AS item_id", "text")
    assert {r.item_id for r in search.search(docs(spark, rows), named).collect()} == {"q0", "q1", "q2"}


def test_shared_terms_are_added_once():
    base = [f"t{i}".encode() for i in range(30)]
    items = [(i, set(base) | {f"own{i}".encode(), f"pair{i // 2}".encode()}) for i in range(50)]
    plan = search.Plan(items)
    assert plan.additions() < 200 < sum(len(own) for _, own in items)
    rng = random.Random(3)
    drawn = [(i, set(rng.sample(base, 12))) for i in range(40)]
    plan = search.Plan(drawn)
    number = {t: k for k, t in enumerate(plan.terms)}
    import numpy as np
    term = np.arange(len(plan.terms))
    got = plan.scores(term, 1 << term, np.zeros(len(term), np.int64), 1)[:, 0]
    assert got.tolist() == [sum(1 << number[t] for t in own) for _, own in drawn]


# --- personal data --------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and personal.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), list(BASE).index(kind), kind, m.end()))
    return [(kind, a, z) for a, _, kind, z in sorted(out)]


PLANTED = [
    "mail a.b+c@x-y.co.uk, see é ünï@ö.de x@y a@b.c@d.e.f @x.y %@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3 1..2.3.4 9.9.9.9.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 5500005555555559 0000000000000000000000", "+1 (487) 555-7209 +49 30 1234567890 12345 +1 ++12-34-56-78-9() +1-2",
    "é https://ex.org/a?b=é. (http://x) ftp://a://b <s3://k> ://no 9http://q, http://... x", "Token = \"04dbebab91ab85\" my_token=abcdef12 ACCOUNT: 12-34-56-78 password=hunter acct 99 secret abc-secret 123456x passport#X1234567é token      1234567",
    "IBAN: DE89 3704 0044 0532 0130 00 IS iban GB29NWBK60161331926819 IBAN DE00 3704 0044 0532 0130 00 iban", "", "+" * 500 + "@" * 500 + "1." * 500, "a" * 50_000 + "@b.c " + "1 " * 20_000,
]


@pytest.fixture(scope="module")
def private():
    rng = random.Random(5)
    bits = ["@", "a", "b.c", "1", "22", "+1", " ", " ", "-", ".", "(", ")", "://", "http", "token", "=", "iban", "DE89", "é", "4111111111111111", "255", "\n", "x1y2z3", '"']
    made = ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(600)]
    return list(enumerate(PLANTED + made)) + [(9000, None), (None, PLANTED[0]), (0, PLANTED[0]), (0, PLANTED[0])]


def test_base_spans_equal_the_patterns_and_sql(spark, private):
    got = personal.digests(docs(spark, private)).collect()
    assert len(got) == len(private)
    want = Counter()
    for i, text in private:
        base = base_spans(text or "")
        listed = ",".join(f"{k}:{a}:{z}" for k, a, z in base)
        want[(i, *(sum(k == kind for k, _, _ in base) for kind in BASE), hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    same(personal.digests(docs(spark, private)), personal.SQL, documents=private)
    assert personal.digests(docs(spark, [])).count() == 0


def test_added_kinds_and_redaction(spark):
    rows = personal.find(docs(spark, list(enumerate(PLANTED))), name="found").orderBy("doc_id").collect()
    assert rows[0].spans == 5 and rows[0].word == "k"

    def texts(i, kind):
        return [PLANTED[i][s.start : s.end] for s in rows[i].found if s.kind == kind]
    assert texts(4, "url") == ["https://ex.org/a?b=é", "http://x", "ftp://a://b", "s3://k", "http://q"]
    assert texts(5, "account") == ["04dbebab91ab85", "12-34-56-78", "X1234567"]
    assert texts(6, "iban") == ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"]
    masked = personal.redact(docs(spark, [(1, PLANTED[3]), (2, None), (3, "é mail a@b.org!"), (4, "token: a@b.cd1234")])).orderBy("doc_id").collect()
    assert masked[0].text == "[PHONE] +49 30 1234567890 12345 +1 +[PHONE]() +1-2"
    assert [r.text for r in masked[1:]] == [None, "é mail [EMAIL]!", "token: [EMAIL]"]
    assert personal.find(docs(spark, [(1, "a@b.org")])).columns[-1] == "spans"


# --- spelling -------------------------------------------------------------------------------------

def variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
    met = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in met.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], len(met[w]), n.get(form[w])) for w in n)


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(60)] + ["übermäßig", "zusammen"]
    rows = []
    for i in range(80):
        words = rng.choices(base, k=60, weights=[3 ** (k % 6) for k in range(len(base))])
        rows.append((i, " ".join(words).title() if i % 3 else "-".join(words)))
    long = "x" * 3000
    chain = [("receivable", 400), ("receivabl", 30), ("receivab", 2)]
    rows += [(700 + k, f"{w} " * n) for k, (w, n) in enumerate(chain)]
    rows += [(800, f"{long} {long} {long}y {long}y"), (801, None), (802, ""), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("group", [2048, 4])
def test_variants_equal_brute_force_and_sql(spark, spelled, group, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", group)
    got = spelling.variants(docs(spark, spelled)).select("word", "form", "root", "n", "n_near", "form_n")
    want = variants(spelled)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {w[0]: w[2] for w in want}["receivab"] == "receivable"
    if group > 4:
        same(got, spelling.SQL, documents=spelled)
    assert spelling.variants(docs(spark, [(1, "ab"), (2, None)])).count() == 0
    assert spelling.variants(docs(spark, [])).count() == 0


def test_index_finds_all_near_words():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    index = spelling.Index(words)
    got = {(index.words[a], index.words[b]) for a, b in zip(*index.near())}
    want = set()
    for a in words:
        for b in words:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                want.add((a, b))
            if len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b))):
                want.add((a, b))
    assert got == want
    assert spelling.Index([]).near()[0].size == 0
