"""Text queries without SQL against plain Python over the whole table."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from quarry.plans import QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def sentences(t):
    guard = r"(?<!\bDr\.)(?<!\bMr\.)(?<!\bMs\.)(?<!\bMrs\.)(?<!\bProf\.)(?<!\bEngr\.)(?<!\bvs\.)(?<!\be\.g\.)(?<!\bi\.e\.)(?<!\b[A-Z]\.)"
    return [x for x in (s.strip(" ") for s in re.split(rf"(?<=[.!?]){guard}[ \t\n\x0b\f\r]+", t)) if x]


def test_rouge_l(spark, sf):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    before, last = {}, None
    for key in sorted(turns):
        if last and last[0] == key[0]:
            before[key] = last
        last = key
    got = {(r["conv_id"], r["turn"]): r["f1"] for r in QUERIES["rouge_l"](spark, sf).collect()}
    assert set(got) == set(before)
    for key, other in before.items():
        a, b = words(turns[key])[:2000], words(turns[other])[:2000]
        best = defaultdict(int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i, j] = best[i - 1, j - 1] + 1 if a[i] == b[j] else max(best[i - 1, j], best[i, j - 1])
        n = best[len(a) - 1, len(b) - 1] if a and b else 0
        assert abs(got[key] - (2 * n / (len(a) + len(b)) if n else 0)) < 1e-9


def test_clean_text(spark, sf, texts):
    got = {r["doc_id"]: r["text"] for r in QUERIES["clean_text"](spark, sf).collect()}
    for i, t in texts.items():
        out = []
        for line in (x.strip(" ") for x in t.split("\n")):
            if line and (not out or out[-1] != line):
                out.append(line)
        assert got[i] == "\n".join(out)


def test_chunk_sentence(spark, sf, texts):
    got = {(r["doc_id"], r["chunk"]): r["text"] for r in QUERIES["chunk_sentence"](spark, sf).collect()}
    want = {(i, k // 5): " ".join(s[k : k + 5]) for i, t in texts.items() for s in [sentences(t)] for k in range(0, len(s), 5)}
    assert got == want


def test_extractive_top4(spark, sf, texts):
    asked = {"the", "of", "and", "in", "der", "de"}
    for r in QUERIES["extractive_top4"](spark, sf).collect():
        t = texts[r["doc_id"]]
        s = sentences(t)
        best = sorted(range(len(s)), key=lambda k: (-len(asked & set(words(s[k]))), k))[:4]
        assert r["summary"] == (t if len(t) <= 700 else " ".join(s[k] for k in sorted(best))[:700])


def test_hash_embed(spark, sf):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = defaultdict(dict)
    for r in QUERIES["hash_embed"](spark, sf).collect():
        got[r["item_id"]][r["at"]] = r["value"]
    for i, t in items.items():
        v = defaultdict(int)
        for w in words(t):
            h = hashlib.sha256(w.encode()).hexdigest()
            v[int(h[:8], 16) % 384] += 1 if int(h[8:10], 16) % 2 == 0 else -1
        size = math.sqrt(sum(x * x for x in v.values()))
        assert got[i] == pytest.approx({k: x / size for k, x in v.items() if x}, abs=1e-6)


def test_mojibake(spark, sf, texts):
    got = {r["doc_id"]: r["text"] for r in QUERIES["fix_mojibake"](spark, sf).collect()}
    for i, t in texts.items():
        lines = []
        for line in t.split("\n"):
            try:
                lines.append(line.encode("cp1252").decode() if set(line) & set("ÃÂâ") else line)
            except UnicodeError:
                lines.append(line)
        assert got[i] == "\n".join(lines)


def test_html_sections(spark, sf):
    whole = {r["page_id"]: r["text"] for r in QUERIES["html_to_text"](spark, sf).collect()}
    got = defaultdict(list)
    for r in QUERIES["html_sections"](spark, sf).orderBy("page_id", "ord").collect():
        got[r["page_id"]].append((r["heading"], r["body"]))
    for i, t in whole.items():
        want, heading, body = [], "", []
        for line in [*t.split("\n"), "#"]:
            if line.startswith("#"):
                if heading or "\n".join(body).strip():
                    want.append((heading, "\n".join(body).strip()))
                heading, body = line.lstrip("#").strip(), []
            else:
                body.append(line)
        assert got[i] == want


def test_split_passages_cover(spark, sf, texts):
    got = defaultdict(list)
    for r in QUERIES["split_passages"](spark, sf).orderBy("doc_id", "ord").collect():
        got[r["doc_id"]].append(r["text"])
    for i, t in texts.items():
        assert all(len(x) <= 1000 and x in t for x in got[i])
        assert set(t.split()) <= {w for x in got[i] for w in x.split()} | {w for w in t.split() if len(w) > 100}


def test_mentions(spark, sf, texts):
    names = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        for n in (2, 4):
            names[tuple(w[:n])].add(r["item_id"])
    got = defaultdict(set)
    for r in QUERIES["mention_resolve"](spark, sf).collect():
        got[r["doc_id"]].add((r["item_id"], r["start"], r["length"]))
    for i, t in texts.items():
        w, taken, want = words(t), set(), set()
        for n in (4, 3, 2, 1):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in names and not taken & set(range(k, k + n)):
                    taken |= set(range(k, k + n))
                    want |= {(e, k, n) for e in names[tuple(w[k : k + n])]}
        assert got[i] == want


def test_grounding(spark, sf):
    for r in QUERIES["ground_sentences"](spark, sf).collect():
        assert r["kept"].endswith("It stays.") and "Nobody" not in r["kept"]
