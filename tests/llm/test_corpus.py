"""Corpus operators against brute force on small rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import bpe, decontaminate, features, jaccard, quality, shards, suffixes, topk, toxicity, urls, warc

DOCS = "doc_id long, text string, score double, n long, key string"


def docs(spark, rows):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 0.5, 7, "k") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abdeilnorst") for _ in range(rng.randrange(2, 8)))
    words = [word() for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 260))) for _ in range(30)]
    near = [b.replace(b.split()[-1], "edit") for b in base[:10]]
    shared = " ".join(rng.choice(words) for _ in range(120))
    inside = [f"{b} {shared} {word()}" for b in base[10:20]]
    rows = list(enumerate(base + near + inside + base[:5], 1))
    return rows + [(90, None), (91, ""), (92, "One"), (93, "one"), (94, "x " * 30_000), (95, "é" * 900), (None, base[3]), (2, base[1])]


def test_bpe_equals_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    odd = "ab'st \n\t éñ中½²!.<|endoftext|>　\x1c\x85I'll 🙂"
    rows = [(i, "".join(rng.choice(odd) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "a<|endoftext|>b"), (903, "a \n  b"), (904, "the " * 5000), (905, "x" * 4000), (905, "x")]
    got = bpe.encoded(docs(spark, rows), path, ["doc_id"], decoded=True).collect()
    known = Tokenizer.from_file(path)
    want = {(i, tuple(known.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert {(r.doc_id, tuple(r.token_ids)) for r in got} == want
    assert all(r.decoded == known.decode(r.token_ids, skip_special_tokens=False) for r in got)
    assert bpe.encoded(docs(spark, []), path, ["doc_id"]).count() == 0


@pytest.mark.parametrize("bounds", [None, (2, 2, 2)])
def test_jaccard_components(spark, texts, bounds, monkeypatch):
    for name, k in zip(("LONG", "CHUNK", "SLICE"), bounds or ()):
        monkeypatch.setattr(jaccard, name, k)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    for k in range(24):        # chains: near its neighbours, far from most others
        base = base[:]
        base[rng.randrange(200)] = f"edit{k}"
        texts = [*texts, (200 + k, " ".join(base))]
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    sets = [(i, shingles(t)) for i, t in texts]
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 90 * len(x | y):
            label = [label[a] if k == label[b] else k for k in label]
    want = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if label[j] == label[k] and sets[j][0] is not None]
        want.append((i, len(s), i if not s else min(ids, default=None)))
    got = [tuple(r) for r in jaccard.similar_sets(docs(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = jaccard.one_of_each(docs(spark, texts), 3, 90, 100)
    assert kept.columns == ["doc_id", "text", "score", "n", "key"]
    named = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(named) == sorted({c for i, _, c in want if i == c and i is not None})
    same = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (None, "i j k l"), (None, "I j k l"), (3, None), (3, None), (1, "a b c d")]
    kept = [(r.doc_id, (r.text or "").lower()) for r in jaccard.one_of_each(docs(spark, same), 3, 90, 100).collect()]
    assert sorted(kept, key=str) == [(1, "a b c d"), (1, "e f g h"), (3, ""), (None, "i j k l")]
    assert jaccard.similar_sets(docs(spark, [])).count() == 0


def test_signatures_never_part_sets_that_link():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 700, 5000):
        for num, part in ((90, 0.04), (80, 0.1), (90, 0.2), (80, 0.4)):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            b = np.unique(np.append(a[rng.random(len(a)) > part], rng.integers(0, 2**64, int(part * n), np.uint64)))
            apart = jaccard.fields_apart(jaccard.signature(a, num, 100), jaccard.signature(b, num, 100)) if len(b) else 0
            assert apart <= len(np.setxor1d(a, b))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                rows = [("x", 0, True, len(a), jaccard.signature(a, num, 100)), ("y", 0, True, len(b), jaccard.signature(b, num, 100))]
                assert jaccard.near_rows(rows, num, 100) == [0, 1]


def test_block_join_finds_all_connections():
    rng = np.random.default_rng(2)
    base = np.arange(200, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rng.choice(200, rng.integers(0, 14), False)] = rng.integers(1000, 10**9, 1)[0] + np.arange(1)
        sets.append(np.unique(np.append(own, rng.integers(10**9, 10**10, rng.integers(0, 9)).astype(np.uint64))))

    def parts(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [label[a] if k == label[b] else k for k in label]
        return [label.index(k) for k in label]
    good = [(a, b) for a, b in itertools.combinations(range(60), 2)
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))]
    assert parts(jaccard.join_block(sets, [0] * 60, True, 90, 100)) == parts(good)


def brute_spans(rows, span):
    starts: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for s in range(len(b) - span + 1):
            starts[b[s : s + span]] = starts.get(b[s : s + span], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - span + 1):
            if starts[b[s : s + span]] > 1:
                gone[s : s + span] = True
        edge = np.diff(np.pad(gone.astype(int), 1))
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum())))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [256, 1])
def test_suffix_dedup(spark, texts, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = [r for r in texts if r[0] != 94] + [(96, "ab" * 700)]
    got = suffixes.digests(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, got), key=str) == brute_spans(rows, suffixes.SPAN)
    if group == 256:
        left = suffixes.without_duplicates(docs(spark, rows))
        assert left.count() == len(rows) and left.columns == ["doc_id", "text", "score", "n", "key"]
        assert suffixes.digests(docs(spark, [])).count() == 0


def brute_word_bytes(rows, words):
    """Bytes of each text outside the runs of ``words`` words that start twice."""
    lines = [(i, [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^ \t-\r]+", t.encode())], t.encode()) for i, t in rows]
    window = lambda line, k: tuple(w for _, _, w in line[k : k + words])
    starts = Counter(window(line, k) for _, line, _ in lines for k in range(len(line) - words + 1))
    out = {}
    for i, line, text in lines:
        left = bytearray(b"\1" * len(text))
        for k in range(len(line) - words + 1):
            if starts[window(line, k)] > 1:
                a, b = line[k][0], line[k + words - 1][1]
                left[a:b] = bytes(b - a)
        out[i] = bytes(c for c, keep in zip(text, left) if keep).decode()
    return out


def test_stage_removes_passages_of_over_50_words(spark):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 7))) for _ in range(n))
    passage, shorter, stem, broken = words(51), words(50), words(70), words(60)
    assert len(passage.encode()) < suffixes.SPAN
    plain = [f"{words(20)} {p} {words(20)}" for p in (passage, passage.replace(" ", "\n"), shorter, shorter, words(90))]
    # the same words with other neighbours on either side, so that tuples overlap in part
    cut = [f"{words(5)} {' '.join(stem.split()[k : k + 54])} {words(5)}" for k in range(12)]
    rows = list(enumerate([*plain, *cut, f"{broken} {broken}", passage + " end", "x " * 150, ""], 1))
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs(spark, rows), "").collect()}
    want = brute_word_bytes(rows, 51)
    assert got == want
    assert passage not in got[1] and shorter in got[3] and got[5] == plain[4] and len(got) == len(rows)
    assert suffixes.repeated_words(docs(spark, [(None, passage), (None, None), (1, passage)]), 51).count() == 2


def test_repeated_rows_and_clashing_names(spark):
    rng = random.Random(8)
    passage = " ".join(f"word{rng.randrange(10**6)}" for _ in range(80))
    rows = docs(spark, [(1, f"x {passage} y")] * 40 + [(2, f"z {passage}")])
    spans = {r.doc_id: r["items"] for r in suffixes.duplicate_spans(rows).collect()}
    assert len(spans[1]) == len(set(spans[1])) <= 30
    clashing = rows.withColumns({c: F.lit(3) for c in ("key", "_key", "items", "KEY_")})
    left = suffixes.without_duplicates(clashing, words=51)
    assert left.columns == clashing.columns and left.count() == 41 and left.where("KEY_ = 3 and items = 3").count() == 41


def test_masks_cover_the_window():
    span, stride = decontaminate.WINDOW, decontaminate.STRIDE
    for bad in itertools.combinations(range(span), decontaminate.SUBSTITUTIONS):
        for phase in range(stride):
            assert any(
                p + m[-1] < span and not any(p + c in bad for c in m)
                for p in range(phase, span, stride) for m in decontaminate.MASKS
            )


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    changed = item.replace("gamma", "g").replace("kappa", "k")
    broken = item.replace("gamma", "g").replace("zeta", "z").replace("theta", "t").replace("lambda", "l")
    short = "seven small words make one short item"
    rows = [(1, f"a b {item.upper()}, c"), (2, f"q {changed} r"), (3, f"q {broken} r"), (4, None), (5, ""), (6, f"x {short} y"),
            (7, "seven small words make one short"), (None, item), (1, f"a b {item}"), (8, "w " * 30_000 + item)]
    bench = spark.createDataFrame([(1, item, "k"), (2, short, "k"), (3, None, "k"), (None, item + " pi", "k"), (4, "of the", "k")],
                                  "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(i, b) for i in (1, 2, 8, None) for b in (1, None)} | {(6, 2)}
    assert {r.doc_id for r in decontaminate.clean(docs(spark, rows), bench).collect()} == {3, 4, 5, 7}
    others = [*rows, (1, "a clean text"), (None, "another"), (None, "another")]
    left = decontaminate.clean(docs(spark, others).withColumn("mark", F.lit(1)).withColumn("row", F.lit(2)), bench)
    assert left.columns == ["doc_id", "text", "score", "n", "key", "mark", "row"]
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id == 1) == [(1, "a clean text")]
    assert left.where("doc_id is null").count() == 2
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.choice([0, 0, 0.3, -0.7], 6)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 6), (450, []), (301, [float("inf")] * 6), (10, rows[10][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in ints:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, topk.top_k(frame).collect())) == sorted(want)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_shards(spark, texts):
    got = shards.assign(docs(spark, texts)).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"}
    assert all(r.size >= 16 and 0 <= r.shard < 40 for r in got)
    for shard in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert {(r.doc_id, r.text_crc32) for r in got} == {(i, zlib.crc32((t or "").encode())) for i, t in texts}
    assert shards.assign(docs(spark, [])).count() == 0
    load = {(s, 0): 1000 + s % 7 for s in range(400)}
    after = shards.rebalance(shards.first_map(7, 400), load, 7)
    total = [sum(load[s] for s in load if after[s] == k) for k in range(7)]
    assert max(total) - min(total) < 1007 and shards.rebalance(after, load, 7) == after
    # a slot that no shard can share: the others still become even
    load[5, 0] = 400_000
    after = shards.rebalance(shards.first_map(7, 400), load, 7)
    total = sorted(sum(load[s] for s in load if after[s] == k) for k in range(7))
    assert total[-1] == 400_000 and total[-2] - total[0] < 1007


def loads_of(rows):
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    return total


def test_shards_split_slots_of_equal_rows(spark):
    many = docs(spark, [(None, "")] * 25_000 + [(i, f"text {i}") for i in range(2000)])
    got = shards.assign(many, 8).collect()
    total = loads_of(got)
    assert len(got) == 27_000 and len(total) == 8 and max(total.values()) - min(total.values()) <= 200
    for shard in total:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    heavy = {r.virtual_slot for r in got if r.part}
    assert len(heavy) == 1 and all(r.virtual_slot in heavy for r in got if r.doc_id is None)


def test_stored_slot_map_is_edited(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(400)) for i in range(3000)]
    path = str(tmp_path / "map")
    one = {r.doc_id: r.shard for r in shards.assign(docs(spark, rows), 8, path).collect()}
    same = {r.doc_id: r.shard for r in shards.assign(docs(spark, rows), 8, path).collect()}
    assert one == same and shards.newest_map(spark, path)[0] == 1
    more = rows + [(i, "y" * 2000) for i in range(3000, 3200)]
    got = shards.assign(docs(spark, more), 8, path).collect()
    version, newest, _ = shards.newest_map(spark, path)
    first = {(r.virtual_slot, r.part): r.shard for r in spark.read.parquet(path).where("version = 1").collect()}
    moved = {k for k in newest if newest[k] != first.get(k)}
    assert version == 2 and 0 < len(moved) < 400
    assert {r.doc_id for r in got if r.doc_id < 3000 and r.shard != one[r.doc_id]} == {
        r.doc_id for r in got if r.doc_id < 3000 and (r.virtual_slot, r.part) in moved}
    total = loads_of(got)
    assert max(total.values()) - min(total.values()) <= 2100
    # one more shard takes slots and gives none
    grown = {r.doc_id: r.shard for r in shards.assign(docs(spark, more), 9, path).collect()}
    assert set(grown.values()) == set(range(9)) and shards.newest_map(spark, path)[0] == 3


def test_warc_round_trip(spark):
    rows = [(1, "http://b.org/x", "same"), (5, "http://a.org/y", "same"), (3, None, "same"), (2, "http://a.org/", None),
            (4, "bad\r\nurl", ""), (6, "http://A.org/y?q", "é" * 70_000), (None, "http://c.org", "lone"), (7, "http://a.org/y", "own")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, stored int")
    got = warc.archive_round_trip(pages).collect()
    want = {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("revisit", 4), 4: ("response", None),
            6: ("response", None), None: ("response", None), 7: ("response", None)}
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == want
    assert {r.page_id: r.payload_digest for r in got} == {i: warc.payload_digest((h or "").encode()) for i, _, h in rows}
    order = [(r.url_key, r.time) for r in got]
    assert order == sorted(order)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(8)
    lists = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(7)] + [[]]
    assert list(warc.LoserTree(lists, lambda x: x)) == sorted(itertools.chain(*lists))
    assert list(warc.LoserTree([], lambda x: x)) == []


def test_url_filter(spark):
    link = '<a href="//{0}/">x</a>'.format
    rows = [(1, "http://x.example.org/es/1", None), (2, "HTTP://Example.ORG/de", ""), (3, "http://good.com/fr/1", link("near.net")),
            (4, "http://near.net/1", "<a href='/own'>"), (5, "http://bad.com/de/1?q", None), (6, "http://farm.net/", link("bad.com")),
            (7, None, None), (8, "no scheme", None), (9, "http://lone.net", None), (9, "http://lone.net", None), (10, "http://notorg/x", None)]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[1] == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/de", "org/", "allow")
    assert got[4] == ("near.net", "/1", None, "allow")
    assert got[5] == ("bad.com", "/de/1", "com/de/", "block")
    assert got[6] == ("farm.net", "/", None, "block")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9] == ("lone.net", "", None, "allow") and got[10][2] is None
    known = urls.ruled(urls.located(pages))
    masses = {r.host: (r.trust, r.distrust) for r in urls.host_masses(known).collect()}
    assert masses["near.net"][0] > 0 and masses["farm.net"][1] > 0
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_filter_sql_on_linked_pages(spark):
    link = '<a href="http://{0}/p">x</a>'.format
    # a chain of hosts to a blocked hub, a chain from a trusted one, a ring between, several links from one page
    rows = [("http://hub.com/de/1", link("other.net")), ("http://good.com/fr/1", link("g0.net") + link("c1.net"))]
    rows += [(f"http://c{k}.net/", link(f"c{k + 1}.net") if k < 5 else link("hub.com")) for k in range(6)]
    rows += [(f"http://g{k}.net/", link(f"g{k + 1}.net") + link("c2.net") * (k % 2)) for k in range(3)]
    rows += [("http://r1.net/", link("r2.net")), ("http://r2.net/", link("r1.net") + link("hub.com") + link("good.com"))]
    rows += [(None, None), ("http://lone.net/x", ""), ("http://hub.com/de/2", None)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    want = {tuple(r) for r in duck_rows(urls.SQL, pages=pages)}
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == want and {r[4] for r in got if r[1].startswith("c")} == {"allow", "block"}


def duck_rows(sql, **tables):
    with duckdb.connect() as con:
        for name, df in tables.items():
            con.register(name, df.toArrow())
        return con.execute(sql).fetchall()


def test_distrust_reaches_all_linkers_of_a_small_hub(spark):
    blocked = spark.createDataFrame([("hub", 1), ("else", 25_000_000 - 1)], "host string, n long")
    seeds = blocked.select("host", (F.col("n") / 25_000_000).alias("seed"))
    links = spark.range(50_000).select(F.lit("hub").alias("host"), F.format_string("h%d", "id").alias("to"), F.lit(1).cast("long").alias("n"))
    chain = spark.range(30).select(F.format_string("c%d", "id").alias("host"), F.format_string("c%d", F.col("id") + 1).alias("to"), F.lit(1).cast("long").alias("n"))
    onto = spark.createDataFrame([("h7", "c0", 1), ("a", "b", 1), ("b", "a", 1)], links.schema)
    mass = {r.host: r.mass for r in urls.propagate(links.union(chain).union(onto), seeds).collect()}
    assert mass["h1"] == pytest.approx(0.15 * 0.85 / 50_000 / 25_000_000)
    assert len(mass) == 50_000 + 2 + 31 and mass["c30"] == pytest.approx(mass["h1"] * 0.85**31)
    # a cycle: the fixed point of a = 0.15 + 0.85 b, b = 0.85 a
    ring = urls.propagate(onto, spark.createDataFrame([("a", 1.0)], "host string, seed double"))
    assert {r.host: round(r.mass, 4) for r in ring.collect()} == {"a": round(0.15 / (1 - 0.85**2), 4), "b": round(0.85 * 0.15 / (1 - 0.85**2), 4)}


def test_pages_that_link_a_blocked_hub_are_blocked(spark):
    link = '<a href="//{0}/">x</a>'.format
    rows = [(0, "http://hub.com/de/1", None), *((k, f"http://other{k % 40}.com/de/1", None) for k in range(1, 400))]
    rows += [(1000 + k, f"http://h{k}.net/", link("hub.com")) for k in range(2000)]
    rows += [(5000 + k, f"http://c{k}.net/", link(f"c{k - 1}.net" if k else "h5.net")) for k in range(14)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.verdict for r in urls.judge(pages).where("page_id >= 1000").collect()} == {"block"}


def sample(n):
    rng = random.Random(6)
    nice = ["gentle", "river", "window", "garden", "paper", "music", "travel", "summer"]
    rude = ["idiotic", "scummy", "trashy", "moronic"]
    rows, labels = [], []
    for i in range(n):
        toxic, junk = i % 4 == 0, i % 5 == 0
        words = [rng.choice(nice) for _ in range(30)] + [rng.choice(rude) for _ in range(5)] * toxic
        rng.shuffle(words)
        rows.append((i, "!!! ### ".join(words).upper() if junk else " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_classifiers(spark):
    rows, labels = sample(400)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows += [(1000, None), (1001, ""), (None, "gentle river"), (3, rows[3][1]), (1002, "gentle " * 20_000)]
    for run, k, parts in ((quality.classify, 1, (4, 2)), (toxicity.toxicity, 2, (5, 0))):
        got = run(docs(spark, rows), given).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        truth = {r[0]: r[k] for r in labels}
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % parts[0] == parts[1]}
        assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
        one = run(docs(spark, rows), given.where(F.col("quality") + F.col("toxic") > 9)).collect()
        assert {r.score for r in one} == {1.0 if k == 1 else 0.0}
        assert run(docs(spark, []), given).count() == 0
    kept = quality.accepted(docs(spark, rows[:400]), given)
    assert kept.columns == ["doc_id", "text", "score", "n", "key"]
    assert {r.doc_id for r in kept.collect()} == {i for i, q, _ in labels if q}


def test_neighbours_are_those_of_a_full_scan():
    rng = np.random.default_rng(9)
    n, terms = 300, 40
    doc = np.repeat(np.arange(n), 8)
    stem = np.concatenate([rng.choice(terms, 8, False) for _ in range(n)])
    index = toxicity.build(np.arange(n), np.arange(n) % 2, doc, stem, np.ones(len(doc)), {}, 1000, 0.5)
    q = index.queries(doc, stem, np.ones(len(doc)), n)[::7]
    every = np.concatenate([index.block(k, q) for k in range(index.most.shape[1])], 1)
    best, _ = index.neighbours(q)
    assert np.allclose(best, -np.sort(-every, axis=1)[:, : toxicity.NEIGHBOURS], atol=1e-4)


def test_rare_terms_are_indexed():
    rng = np.random.default_rng(5)
    n = 600
    # ordinary words in every example, an own insult in each pair of toxic ones
    rows = [(i, int(t), 1) for i in range(n) for t in rng.choice(60, 8, False)]
    rows += [(i, 1000 + i // 4, 1) for i in range(n) if i % 2]
    doc, stem, count = (np.array(x) for x in zip(*rows))
    index = toxicity.build(np.arange(n), np.arange(n) % 2, doc, stem, count, {}, 10_000, 0.5)
    q = index.queries(doc, stem, count, n)[::7]
    dense = np.zeros((n, len(index.terms)))
    d, at, weight = index.weights(doc, stem, count, n)
    dense[d, at] = weight
    every = dense[::7] @ dense[index.ids].T
    best, whose = index.neighbours(q)
    assert np.allclose(best, -np.sort(-every, axis=1)[:, : toxicity.NEIGHBOURS], atol=1e-4)
    insults = np.arange(1000, 1000 + n // 4)
    one = np.ones(len(insults), int)
    best, whose = index.neighbours(index.queries(np.arange(len(insults)), insults, one, len(insults)))
    assert (index.vote(best, whose) == 1).all()
    assert {tuple(sorted(index.ids[w[w >= 0]])) for w in whose} == {(k + 1, k + 3) for k in range(0, n, 4)}


def test_terms_of_short_words_and_other_scripts():
    part = features.Slice(["You big OAF".encode(), "привет приветы кот".encode(), "漢字漢a".encode(), b"", "don’t pathetic path".encode()])
    doc, term, count = part.beginnings()
    own = [dict(zip(term[doc == k], count[doc == k])) for k in range(5)]
    assert [sorted(o.values()) for o in own] == [[1, 1, 1], [1, 2], [1, 1, 1], [], [1, 2]]
    doc, term, count = part.whole_words()
    assert [int((doc == k).sum()) for k in range(5)] == [3, 3, 3, 0, 3]
    again = features.Slice(["x кот oaf".encode(), "字漢".encode()])
    doc, term, _ = again.beginnings()
    assert set(term[doc == 0]) & set(own[0]) and set(term[doc == 0]) & set(own[1]) and set(term[doc == 1]) & set(own[2])


@pytest.mark.parametrize("rude, nice", [
    ("you big oaf", "the sun is out"), ("ты дурак и осёл", "сегодня ясный день"), ("你是个大笨蛋", "今天天气很好"),
])
def test_short_words_and_other_scripts_are_told_apart(spark, rude, nice):
    rows = [(i, rude if i % 2 else nice) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, toxic int, quality int")
    for run in (toxicity.toxicity, quality.classify):
        assert all(r.predicted == r.doc_id % 2 for r in run(docs(spark, rows), labels).collect())


def test_pairwise_sum_equals_the_identity():
    rng = np.random.default_rng(4)
    size, n = (1 << quality.BITS) + features.STATISTICS, 6
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)), None, None)
    rows = [np.unique(rng.integers(0, size, 9)) for _ in range(n - 1)] + [np.zeros(0, np.int64)]
    values = [rng.normal(size=len(f)) for f in rows]
    got = m.logits(np.repeat(np.arange(n), [len(f) for f in rows]), np.concatenate(rows).astype(np.int64), np.concatenate(values), n)
    for k, (f, x) in enumerate(zip(rows, values)):
        pairs = sum(m.factor[f[i]] @ m.factor[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert got[k] == pytest.approx(0.3 + m.weight[f] @ x + pairs)


def test_vote_and_calibration_of_toxicity():
    index = toxicity.Index(*[None] * 2, np.array([10, 11, 12]), np.array([1, 0, 1]), *[None] * 5, 0.25)
    best, whose = np.array([[0.9, 0.5, 0.1], [0.4, -1, -1], [-1, -1, -1]]), np.array([[0, 1, 2], [1, -1, -1], [-1, -1, -1]])
    vote = index.vote(best, whose)
    assert vote[0] == pytest.approx((0.81 + 0.01) / (0.81 + 0.25 + 0.01)) and vote[1] == 0 and np.isnan(vote[2])
    rng = np.random.default_rng(2)
    given = rng.uniform(0.05, 0.95, 4000)
    label = (rng.uniform(size=4000) < given).astype(int)        # a vote that is the probability
    toxicity.calibrate(index, given, label, 0.0)
    assert index.slope == pytest.approx(1, abs=0.1) and index.shift == pytest.approx(0, abs=0.1)
    assert index.scores(vote)[2] == 0.25 and index.scores(np.array([0.8]))[0] == pytest.approx(0.8, abs=0.03)


def test_long_pieces_leave_the_table():
    coder = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for _ in range(20):
        texts = ["a " + "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(500)) + " end" for _ in range(5)]
        got = coder.encode(texts)
        assert [b.decode() for _, b in got] == texts
    assert set(coder.ids) == set(coder.text) == {"end"}
    assert coder.held == len("end") + len(coder.ids["end"]) + len(coder.text["end"])


def test_varied_insults_are_toxic(spark):
    rng = random.Random(3)
    nice = ["gentle", "river", "window", "garden", "paper", "music", "travel", "summer"]
    rude = [f"{a}{b}{c}q" for a, b, c in itertools.product("bdgkz", "aeiou", "bdgkz")]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(nice) for _ in range(20)] + rng.sample(rude, 3) * (i % 4 == 0)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    held = [r for r in toxicity.toxicity(docs(spark, rows), given).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
