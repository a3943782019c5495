"""Lexical search, license scan and fill-in-the-middle against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import license_scan, max_sketch, wavelet_fim

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Lorem ipsum, dolor!! sit\n*** amet. " * 3000
TEXTS = [
    (1, "alpha beta Gamma delta"), (2, "alpha  beta-gamma\ndelta\tepsilon"), (3, None), (4, ""), (5, " \n"), (6, LONG), (7, "İstanbul Kelvin 中文 12,5 a_b\n\n"),
    (8, "alpha"), (9, "alpha"), (9, "alpha"), (None, "alpha beta"), (None, None), (10, LONG + "tail CC-BY 4.0"), (11, "<P>alpha\nbeta"),
    (12, "All rights reserved. all RIGHTS reserved cc by cc by"), (13, "GNU general\npublic license, all rights  reserved"), (-5, "beta " * 500 + "alpha")]
SCHEMA = "doc_id long, text string, item int, n long, bound long, words string, row string, score int"


def documents(spark, rows=TEXTS):
    """Extra columns clash with names the operators use."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "w", "r", 4) for i, t in rows], SCHEMA)


# Search

def ranked(rows, items, top=20):
    """item ids with (rank, doc_id, score), by the formula alone."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    n_docs, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 75 + 25 * c.total() * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc, score))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, k, s[2], s[3]) for k, s in enumerate(scores[:top], 1)]
    return Counter(out)


def found(spark, rows, items, top=20):
    docs = documents(spark, rows)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    return Counter(tuple(r) for r in max_sketch.search(docs, max_sketch.build_index(docs), asked, top).collect())


ITEMS = [(1, "ALPHA beta beta"), (1, "alpha beta beta"), (2, None), (3, ""), (4, "nowhere"), (None, "lorem 中文 tail"), (5, "cc by rights")]


def test_search_equals_the_formula(spark):
    assert found(spark, TEXTS, ITEMS) == ranked(TEXTS, ITEMS)
    assert found(spark, TEXTS, ITEMS, 3) == ranked(TEXTS, ITEMS, 3)


def test_search_of_empty_tables(spark):
    assert not found(spark, [], ITEMS) and not found(spark, TEXTS, []) and not found(spark, [(1, None)], ITEMS)


def test_search_in_batches_and_blocks(spark, monkeypatch):
    """Small batches, small blocks, loose bounds and many copies give the same ranks."""
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(k // 2, " ".join(draw.choices(words, weights=range(1, 61), k=draw.randint(1, 80)))) for k in range(400)] + [(7, "w1 w2 w3")] * 90
    items = [(k, " ".join(draw.choices(words, k=6))) for k in range(8)] + [(9, "w1 w2 w3")]
    want = ranked(rows, items, 5)
    for name, value in (("FIRST", 5), ("GROWTH", 1), ("RATIO", 1), ("LEAST", 4), ("BLOCK_TERMS", 30), ("CHUNK", 16)):
        monkeypatch.setattr(max_sketch, name, value)
    assert found(spark, rows, items, 5) == want


def test_bounds_are_never_below_the_score():
    draw = random.Random(5)
    for size in (1, 30, 3000):
        counts = Counter({f"t{k}".encode(): draw.choice([1, 2, 127, 128, 129, 5000]) for k in range(size)})
        made = max_sketch.sketch(counts)
        assert len(made) & (len(made) - 1) == 0
        at = (max_sketch.hashes(list(counts)) & np.uint64(len(made) - 1)).astype(int)
        for code, tf in zip(made[at], counts.values()):
            assert max_sketch.LEVELS[code] >= tf


def test_terms_in_slices(monkeypatch):
    monkeypatch.setattr(max_sketch, "SLICE", 10)
    text = "One two, three two 中文中文中文中文 x" * 3
    assert max_sketch.term_counts(text.encode()) == Counter(t.encode() for t in TERM.findall(text.translate(LOWER)))
    assert max_sketch.term_counts(None) == Counter()


# License scan

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text, templates):
    """(n_words, base places by label) by looking at every word."""
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    base = {}
    for t in templates:
        if t.base:
            base.setdefault(t.label, []).extend(k for k in range(len(words)) if tuple(words[k:k + len(t.words)]) == t.words)
    return len(words), {k: v for k, v in base.items() if v}


def test_scan_equals_brute_force(spark):
    got = license_scan.scan(documents(spark)).collect()
    assert len(got) == len(TEXTS)
    want = Counter()
    for i, text in TEXTS:
        n, base = places(text, license_scan.TEMPLATES)
        at = [p for v in base.values() for p in v]
        want[i, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_scan_merges_diagonals_and_verifies(spark):
    mit = next(t for t in license_scan.OWN if t.label == "mit" and t.gap)
    words = list(mit.words)
    changed = [*words[:20], "now", "also", *words[20:34], *words[36:]]        # two words in, two out
    texts = [(1, " ".join(words).upper()), (2, "x y " + " ".join(changed)), (3, " ".join(words[:25])), (4, " ".join(words[::-1])),
             (5, " ".join(w for part in (words[:15], ["filler"] * 200, words[15:]) for w in part)), (6, "Released under the MIT License.")]
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, texts)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1
    assert got[2]["labels"] == "mit" and 0.7 <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.7
    assert got[4]["labels"] == "" and got[4]["score"] == 0
    assert got[5]["labels"] == "mit" or got[5]["score"] < 1
    assert got[6]["labels"] == "mit" and got[6]["n_base"] == 0


def test_scan_of_an_empty_table(spark):
    assert license_scan.scan(documents(spark, [])).collect() == []


def test_scan_runs_no_python(spark):
    plan = license_scan.scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Fill-in-the-middle

def test_wavelet_ranks():
    draw = np.random.default_rng(1)
    for size in (0, 1, 255, 256, 257, 5000):
        symbols = draw.integers(0, 4, size).astype(np.uint8)
        matrix = wavelet_fim.WaveletMatrix(symbols)
        for end in {0, size, *draw.integers(0, size + 1, 20).tolist()}:
            assert [matrix.rank(s, end) for s in range(4)] == [int((symbols[:end] == s).sum()) for s in range(4)]


UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"\A[\t-\r ]*[^\t-\r ]+[\t-\r ]*|[^\t-\r ]+[\t-\r ]*|\A[\t-\r ]+\Z"}


@pytest.mark.parametrize("unit", UNITS)
def test_cuts_fall_behind_whole_units(unit):
    for _, text in [*TEXTS[:5], *TEXTS[6:]]:
        text = (text or "")[-3000:]
        units = re.findall(UNITS[unit], text)
        assert "".join(units) == text
        cutter = wavelet_fim.Cutter(text.encode(), unit)
        assert cutter.units == len(units)
        for k in {0, len(units), len(units) // 2, len(units) // 3}:
            at = cutter.behind(k)
            assert text.encode()[:at].decode() == "".join(units[:k]) and cutter.chars(at) == len("".join(units[:k]))


def test_unknown_unit():
    with pytest.raises(ValueError):
        wavelet_fim.Cutter(b"", "page")


def test_transformation_and_its_inverse(spark):
    cut = wavelet_fim.transform(documents(spark)).withColumn("restored", wavelet_fim.restored(F.col("output"), F.col("form")))
    rows = cut.collect()
    assert Counter((r["doc_id"], r["restored"]) for r in rows) == Counter((i, t or "") for i, t in TEXTS)
    for r in rows:
        lines = re.findall(UNITS["line"], r["restored"])
        h = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
        p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
        plain = not r["restored"] or "<P>" in r["restored"]
        assert r["n"] == len(lines) and r["form"] == ("plain" if plain else "spm" if h4 % 100 < 50 else "psm")
        if not plain:
            assert (r["prefix_chars"], r["middle_chars"]) == (len(p), len(m))
            assert r["output"] == (f"<S>{s}<P>{p}<M>{m}" if r["form"] == "spm" else f"<P>{p}<S>{s}<M>{m}")
        else:
            assert r["output"] == r["restored"] and r["prefix_chars"] is None and r["middle_chars"] is None


def test_rates(spark):
    none = wavelet_fim.transform(documents(spark), wavelet_fim.Settings(rate=0)).collect()
    assert {r["form"] for r in none} == {"plain"}
    assert "spm" not in {r["form"] for r in wavelet_fim.transform(documents(spark), wavelet_fim.Settings(spm_rate=0)).collect()}
