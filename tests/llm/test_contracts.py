"""The opN_ queries as they are registered: columns in order, types and values on the table; and what their operators promise."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import decontam, langid, licenses, minhash, pii, quality, queries, suffix

from .test_corpus_operators import brute_components, brute_hits, brute_quality, brute_repeats, covered, frame, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name, first):
    df = queries.QUERIES[name](spark, SF)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields][: len(first)] == first
    return df.collect()


def test_op2(spark, texts):
    got = run(spark, "op2_language_id", [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    assert len(got) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert langid.classify("² ½ ①", [])[0] == "und" and langid.normal("² ½ ① 5_") == b""


def test_op4(spark, texts):
    got = run(spark, "op4_quality_rules", [("doc_id", "bigint"), *((c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean")])
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == {i: brute_quality(t) for i, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op6(spark, texts):
    got = run(spark, "op6_minhash_near_dedup", [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op7(spark, texts):
    got = run(spark, "op7_benchmark_decontamination", [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")])
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held: dict[tuple, set] = {}
    for i, t in bench:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(k) for k in held}
    for r in got:
        w, hit, items = split(texts[r["doc_id"]]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = held.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    items |= found
        assert tuple(r)[1:6] == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))


def test_op8(spark, texts):
    got = run(spark, "op8_token_sstable", [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")])
    tok, start, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i in sorted(texts):
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in got) == want


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_op10(spark, texts):
    got = run(spark, "op10_pii_weak_supervision", [("doc_id", "bigint"), ("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint"), ("base_sha256", "string"), ("spans", "string")])
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r["doc_id"]] or "")
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert tuple(r)[1:5] == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r["spans"].split(",")) | {""}


def test_op10_base_spans_on_random_strings():
    rng = np.random.default_rng(0)
    for _ in range(4000):
        t = "".join(rng.choice(list("ab1.2@_-+ 59(é"), rng.integers(1, 40)))
        assert pii.base_spans(t) == brute_base(t), t


def test_op10_long_unbroken_texts():
    began = time.process_time()
    for t in ("a" * 1_000_000 + "@", "1" * 1_000_000 + ".2.3", "a1" * 500_000, "1." * 500_000, "+1" + "(" * 1_000_000, "x@" * 500_000):
        pii.candidates(t, pii.base_spans(t))
    assert time.process_time() - began < 60


def test_op10_names_addresses_and_letter_secrets():
    text = "Dear Dr. Anna Miller, write to 12 Long Meadow Street. password: correctHorseBattery and the word Name in Spring 2024"
    kinds = {text[a:b]: pii.KINDS[k] for a, b, k, *_ in pii.candidates(text, [])}
    assert kinds["Anna Miller"] == "name" and kinds["12 Long Meadow Street"] == "address" and kinds["correctHorseBattery"] == "secret" and "Spring" not in kinds


def test_op10_candidates_of_any_length():
    secret, word = "correctHorse" * 20, "A" + "b" * 60
    text = f"password: {secret} and name: Anna {word} Maria Miller; lives at 7 Old North {word} Long Meadow Street."
    kinds = {text[a:b]: pii.KINDS[k] for a, b, k, *_ in pii.candidates(text, [])}
    assert kinds == {secret: "secret", f"Anna {word} Maria Miller": "name", f"7 Old North {word} Long Meadow Street": "address"}
    began = time.process_time()
    for t in ("name: " + "Ab " * 300_000, "password=" + "x" * 1_000_000, "7 " + "Ab " * 300_000, "7 Ab " * 200_000, "password=" * 100_000):
        pii.candidates(t, [])
    assert time.process_time() - began < 30


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_license_scan", "op5_source_mixing", "op9_suffix_array_dedup"])
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_licence_inside_a_longer_text(spark):
    notice = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and "distributed" in t).split()
    wrapped = "\n".join(" * " + " ".join(notice[k : k + 9]) for k in range(0, len(notice), 9))
    rows = [(1, f"{prose(1, 300)}\n{wrapped}\n{prose(2, 300)}", "en", "a"), (2, prose(3, 200) + " released under the MIT licence, all rights reserved, " + prose(4, 200), "en", "a"), (3, prose(5, 500), "en", "a")]
    got = {r["doc_id"]: (r["licenses"], r["best"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1] == (["Apache-2.0"], "Apache-2.0") and "Proprietary" in got[2][0] and 3 not in got


def test_repeated_notices_in_a_long_text(spark):
    """1 MB of one notice again and again: each of them once, in a time that grows with the length."""
    took = {}
    for n in (13_000, 52_000):
        began = time.time()
        got = licenses.scan(frame(spark, [(1, "all rights reserved " * n, "en", "a"), (2, "plain text", "en", "a")])).collect()
        took[n] = time.time() - began
        assert [(r["doc_id"], r["best"], r["best_dice"], r["n_units"]) for r in got] == [(1, "Proprietary", 1.0, n)]
    assert took[52_000] < 60


def test_apart_from_what_beats_its_neighbour(spark):
    """Where A beats B and B beats C, A and C count if they lie apart; and units meet across the ends of segments."""
    rows = [("X", "a b c d e f g h"), ("Y", "e f g h i j k l"), ("Z", "j k l m n o p q")]
    text = "a b c d e f g h i j k x m n o p q"
    got = sorted((r["license"], r["start"], r["end"]) for r in licenses.matches(frame(spark, [(1, text, "en", "a")]), threshold=0.6, rows=rows).collect())
    assert [g[0] for g in got] == ["X", "Z"]
    long = "w " * 250 + "a b c d e f g h " + "w " * 300
    assert [(r["start"], r["end"]) for r in licenses.matches(frame(spark, [(1, long, "en", "a")]), rows=rows).collect()] == [(250, 258)]


def test_fences_differ_between_groups(spark):
    """Each language has fences of its own, and they move with its distribution."""
    rng = np.random.default_rng(1)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, max(1, n))))

    def text(mean):
        return " ".join(word(int(n)) for n in rng.normal(mean, 1, 120))

    rows = [(k, text(4 + rng.normal(0, 0.2)), "aa", "s") for k in range(120)] + [(1000 + k, text(8 + rng.normal(0, 0.6)), "bb", "s") for k in range(120)]
    rows += [(5000, text(8), "aa", "s"), (5001, text(4), "bb", "s")]
    got = quality.rate(frame(spark, rows))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert not kept[5000] and not kept[5001] and sum(kept.values()) > 200
    top = {r["lang"]: (r["a"], r["b"]) for r in got.groupBy("lang").agg(F.max("max_mean_word_chars").alias("a"), F.max("max_mark_share").alias("b")).collect()}
    assert top["aa"][0] + 2 < top["bb"][0]


def test_fences_of_two_sources_of_a_language(spark):
    """At the registered settings a source has its own fences; a small one is drawn toward its language's, and no run differs."""
    rng = np.random.default_rng(2)
    text = lambda mean: " ".join("".join(map(chr, rng.integers(97, 123, max(1, int(n))))) for n in rng.normal(mean, 1, 120))
    rows = [(k, text(4 + rng.normal(0, 0.2)), "aa", "s") for k in range(200)] + [(1000 + k, text(8 + rng.normal(0, 0.2)), "aa", "t") for k in range(200)] + [(2000 + k, text(6), "aa", "u") for k in range(3)]
    rows += [(5000, text(8), "aa", "s"), (5001, text(4), "aa", "t")]
    got = quality.rate(frame(spark, rows)).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[5000] and not kept[5001] and sum(kept.values()) >= 400
    low = {r["source"]: (r["min_mean_word_chars"], r["max_mean_word_chars"]) for r in got}
    assert low["s"][1] < 8 < low["t"][1] and low["u"][1] > low["t"][1]
    again = quality.rate(frame(spark, rows[::-1]).repartition(7)).collect()
    assert {r["doc_id"]: (r["kept"], r["max_mark_share"], r["max_mean_word_chars"]) for r in again} == {r["doc_id"]: (r["kept"], r["max_mark_share"], r["max_mean_word_chars"]) for r in got}


def test_large_family(spark, monkeypatch):
    """A family that its hub does not link, dealt over many cells."""
    monkeypatch.setattr(minhash, "CELL", 32)
    base = prose(5, 150).split()
    rng = np.random.default_rng(3)
    family = {}
    for i in range(400):
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            w[at] = f"new{i}at{at}"
        family[i] = " ".join(w)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, [(i, t, "en", "a") for i, t in family.items()]), 3, 85).collect()}
    assert got == brute_components(family, 3, 85)


def families():
    """p and q share 51 words; others share 49 of them that reach one word further left or right of them."""
    texts, n = {}, 0
    for f in range(6):
        core = prose(2000 + f, 51).split()
        left, right = prose(3000 + f, 1), prose(4000 + f, 1)
        for k in range(2):
            texts[n] = " ".join([prose(5000 + n, 40), left, *core, right, prose(6000 + n, 40)]) if k else " ".join([prose(5000 + n, 40), *core, prose(6000 + n, 40)])
            n += 1
        for k in range(12):
            part = [left, *core[:48]] if k % 2 else [*core[3:], right]
            texts[n] = " ".join([prose(5000 + n, 40), *part, prose(6000 + n, 40)])
            n += 1
    return texts


@pytest.mark.parametrize("few,cores", [(8, 1 << 25), (1, 1 << 25), (8, 0)])
def test_passages_of_families(spark, monkeypatch, few, cores):
    """Nothing is lost, whether contexts are compared or meet by windows, and whether cores go by bitmap or by join."""
    monkeypatch.setattr(suffix, "FEW", few)
    monkeypatch.setattr(suffix, "MAP_CORES", cores)
    texts = families()
    got = covered(suffix.passages(frame(spark, [(k, t, "en", "a") for k, t in texts.items()])).collect())
    assert got == brute_repeats(texts)


def test_decontamination_cuts_what_two_blocks_cover(spark):
    words = prose(70, 30).split()
    bench = spark.createDataFrame([(1, " ".join(words[:18])), (2, " ".join(words[12:]))], "item_id long, text string")
    docs = frame(spark, [(1, prose(71, 20) + " " + " ".join(words) + " " + prose(72, 20), "en", "a")])
    left = decontam.remove(docs, bench, block_bytes=150).collect()[0]["text"]
    assert left.split() == prose(71, 20).split() + prose(72, 20).split()
    assert Counter(brute_hits(left, [(1, bench.collect()[0]["text"])])[1]) == Counter()
