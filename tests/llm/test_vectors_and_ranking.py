"""Vector codes, ranked search and near-duplicate vectors against brute force, and on nulls, ties, repeats and empty tables."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quarry.llm import queries, ranking, vectorcodes, vectordedup

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int, code string, v string, node string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, "clash", "clash", "clash") for i, v, g in rows], VECTORS)


ODD = [
    (None, [1, 0, 0, 0, 0, 0, 0, 0], 1), (1, None, 1), (2, [], 1), (3, [1, None, 0, 0, 0, 0, 0, 0], 1), (4, [math.nan] * 8, None), (5, [math.inf] + [0] * 7, None),
    (6, [0] * 8, None), (7, [1, 0, 0, 0, 0, 0, 0, 0], None), (7, [1, 0, 0, 0, 0, 0, 0, 0], None), (8, [2, -0.0, 0, 0, 0, 0, 0, 0], 2), (9, [0, 0, 0, 0, 0, 0, 0, 3], 2), (10, [1] * 16, 2),
]


# 11 vector codes
def plain_codes(rows, parts, entries, rounds, scale=4096):
    x = np.floor(np.array([v for _, v in rows]) * scale).astype(np.int64)
    first = np.argsort([i for i, _ in rows], kind="stable")[:entries]
    books, codes, error = [], [], 0
    for part in np.split(x, parts, axis=1):
        book = part[first].copy()
        for r in range(rounds + 1):
            d = ((part[:, None] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if r < rounds:
                for e in range(len(book)):
                    if (near == e).any():
                        book[e] = part[near == e].sum(0) // (near == e).sum()
        books.append(book)
        codes.append(near)
        error = error + d.min(1)
    return books, ["".join(f"{c:02x}" for c in row) for row in np.array(codes).T], error


def test_annulus_is_exact():
    rng = np.random.default_rng(1)
    for high in (3, 40, 2**20):
        entries, x = rng.integers(-high, high, (16, 4)), rng.integers(-high, high, (400, 4))
        entries[5] = entries[2]  # ties go to the lower entry
        entry, d = vectorcodes.Annulus(entries).nearest(x)
        want = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (entry == want.argmin(1)).all() and (d == want.min(1)).all()


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.standard_normal(12).tolist()) for i in rng.permutation(300)]
    df = vectors(spark, [(i, v, i % 3) for i, v in rows]).repartition(5)
    coded, books = vectorcodes.compress(df, parts=3, entries=7, rounds=4)
    want_books, codes, error = plain_codes(rows, 3, 7, 4)
    assert all((a == b).all() for a, b in zip(books.entries, want_books))
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in coded.collect()}
    sums = Counter()
    for (i, _), e in zip(rows, error):
        sums[i % 3] += int(e)
    assert got == {i: (c, int(e), sums[i % 3]) for (i, _), c, e in zip(rows, codes, error)}
    assert np.abs(books.decode(np.array([[0, 1, 2]])) - np.concatenate([books.entries[p][p] for p in range(3)]) / 4096).max() == 0


def test_codes_edges(spark):
    coded, books = vectorcodes.compress(vectors(spark, ODD))
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()]
    assert sorted(str(r[0]) for r in got) == ["6", "7", "7", "8", "9", "None"]  # 10 has another size
    assert len(books.entries[0]) == 6 and all(r[2] == 0 for r in got)
    assert {r[1] for r in got if r[0] == 7} == {"0100000000000000"}
    none = vectors(spark, [])
    assert vectorcodes.compress(none)[0].count() == 0 and vectorcodes.fit(none).text() == ""
    assert vectorcodes.encode(vectors(spark, [(1, [1] * 8, 1)]), vectorcodes.Codebooks(())).count() == 0
    kept = vectorcodes.encode(vectors(spark, ODD), books, code="code2")
    assert kept.columns == ["vec_id", "label", "code", "v", "node", "code2", "error"] and kept.count() == 6
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.fit(vectors(spark, [(1, [1, 2, 3], 0)]))


# 12 ranked search
def plain_rank(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for q, t in items:
        asked.setdefault(q, []).extend(split(t))
    out = []
    for q, terms in asked.items():
        scored = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def test_terms():
    for text in ("Héllo, WORLD-x9 É_a\x7fb", "", None, "a b 　c", "!!!", "ÀB\nİi"):
        assert [t.decode() for t in ranking.terms_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_radix_order():
    rng = np.random.default_rng(3)
    for bits in (1, 16, 17, 50):
        keys = rng.integers(0, 2**bits, 5000).astype(np.uint64)
        assert (ranking.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranking.radix_order(np.zeros(0, np.uint64))) == 0


@pytest.fixture(scope="module")
def searched(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{k}" for k in rng.zipf(1.4, n) if k < 500)
    docs = [(int(i), word(int(rng.integers(1, 60)))) for i in rng.permutation(400)]
    docs += [(500, docs[0][1]), (500, docs[0][1]), (None, docs[0][1]), (501, None), (502, ""), (503, "!?"), (504, "long " * 200_000 + "w1 w2")]
    items = [(int(q), word(12)) for q in range(25)] + [(3, "w7 w7 w9"), (30, None), (31, "--"), (32, "unheardof"), (None, "w1 w400"), (33, "long W1")]
    return docs, items, spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, n int"), spark.createDataFrame([(q, t, "x") for q, t in items], "item_id long, text string, rank string")


@pytest.mark.parametrize("block", [ranking.BLOCK_BYTES, 400])
def test_rank_against_brute_force(searched, block, monkeypatch):
    docs, items, d, q = searched
    monkeypatch.setattr(ranking, "RUN", 700)
    got = [tuple(r) for r in ranking.rank(d, q, block_bytes=block).collect()]
    assert sorted(got, key=str) == sorted(plain_rank(docs, items), key=str)


def test_rank_edges(spark, searched):
    _, _, d, q = searched
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("text is null"), q)):
        assert ranking.rank(a, b).count() == 0
    assert ranking.rank(d, q).columns == ["item_id", "rank", "doc_id", "score"]


# 13 near-duplicate vectors
def plain_links(rows, threshold=0.95):
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sound = [i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sound[a] and sound[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted([(i, links[k], least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(rows)], key=str)


def test_links_edges(spark):
    got = sorted([tuple(r) for r in vectordedup.near_duplicates(vectors(spark, ODD)).collect()], key=str)
    assert got == plain_links([(i, v) for i, v, _ in ODD])
    assert ("7", 2) in {(str(r[0]), r[1]) for r in got}  # the other 7, and 8 in the same direction
    assert vectordedup.near_duplicates(vectors(spark, [])).count() == 0


def test_links_against_brute_force(spark):
    """Tight, wide and chained families, copies, rows of one id; the rings leave links that only cells count."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = [(k, base[k % 12] + rng.standard_normal(16) * (0.05, 0.2, 0.3, 0.45)[k % 4]) for k in range(600)]
    rows += [(600 + k, base[0]) for k in range(60)] + [(3, base[1]), (700, 2e200 * base[2])]
    a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
    rows += [(800 + k, math.cos(k / 8) * a + math.sin(k / 8) * b) for k in range(50)]  # all around a circle
    rows = [(i, v.tolist()) for i, v in rows]
    got = [tuple(r) for r in vectordedup.near_duplicates(vectors(spark, [(i, v, 0) for i, v in rows])).collect()]
    assert sorted(got, key=str) == plain_links(rows)


def test_links_on_the_hot_table(spark):
    """One large family of near copies: every link counted, every component whole."""
    df = spark.read.parquet("/root/testdata/check_h/embeddings.parquet")
    rows = df.collect()
    m = np.array([r["embedding"] for r in rows], float)
    u = m / np.linalg.norm(m, axis=1)[:, None]
    n = {r["vec_id"]: int((u[s] @ u.T >= 0.95).sum() - 1) for s, r in enumerate(rows)}
    got = {r["vec_id"]: r["n_links"] for r in vectordedup.near_duplicates(df).collect()}
    assert sum(abs(got[i] - n[i]) for i in n) <= 0.01 * sum(n.values())


def test_hashing_follows_the_size():
    for n in (1, 500, 50_000, 10**9):
        tables, signs = vectordedup.hashing(n, 0.95)
        assert 2**signs >= 16 * n and (1 - (1 - math.acos(0.95) / math.pi) ** signs) ** tables <= vectordedup.MISS


@pytest.mark.parametrize("name,first", [
    ("op11_vector_codes", [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]),
    ("op12_ranked_search", [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]),
    ("op13_vector_near_dedup", [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]),
])
def test_contract(spark, name, first):
    df = queries.QUERIES[name](spark, SF)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == first
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    columns = ", ".join(c for c, _ in first)
    want = con.execute(f"select {columns} from ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
