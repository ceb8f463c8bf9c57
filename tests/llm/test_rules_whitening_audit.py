"""Line rules, whitening and the filter audit against brute force, and on the odd cases each one states."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

SF1 = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997} tail{i % 13}," for i in range(30_000))
PROSE = "The committee met on the second day to hear what its members had found in the north. Some of them spoke for hours about rivers, bridges and old mills; others read letters aloud. Nobody voted. In the evening they walked along the harbour and agreed to meet again when the first snow had fallen on the hills."
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (5, "a b a b a b a"), (5, "a b a b a b a"), (6, PROSE), (7, LONG), (None, PROSE + "\nHome\n" + PROSE), (8, "\n".join([PROSE, "Home | News | Sport | Weather | Contact", "", PROSE, "日本語　の文 café\x0b#x\x0c$y"])), (9, "\n".join(["FREE!! MONEY!! NOW!! CLICK!! FAST!! ALL!! DAY!! LONG!!"] * 3 + [PROSE[:150]])), (10, "x" * 5000), (11, PROSE + " and then some more words follow that were not there before, so that all is long enough.\nCopyright (c) of somebody.")]


def base(text):
    t = text or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = {}
    for g in grams:
        times[g] = times.get(g, 0) + 1
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_line_rules(spark):
    from gleanery.llm.line_rules import clean

    docs = spark.createDataFrame([(i, t, 1, "x", "k") for i, t in ODD], "doc_id long, text string, extra int, kept string, why string")
    out = clean(docs).collect()
    assert len(out) == len(ODD) and {(r.extra, r.why) for r in out} == {(1, "k")}
    texts = dict(zip(((i, t) for i, t in ODD), (base(t) for _, t in ODD), strict=True))
    by = {(r.doc_id, r.text): r for r in out}
    for key, want in texts.items():
        r = by[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.n_lines == len(r.reasons) == (key[1] or "").count("\n") + 1
        kept = [x for x, why in zip((key[1] or "").split("\n"), r.reasons, strict=True) if why is None]
        assert r.cleaned == "\n".join(kept)
        assert r.lost_chars == want[1] - sum(len(x) for x in WORDS.findall(r.cleaned))
        assert r.kept == (not r.base_failed and 100 * r.lost_chars <= 50 * r.word_chars)
    assert by[(6, PROSE)].kept and by[(11, ODD[-1][1])].kept and not by[(9, ODD[-3][1])].kept
    assert by[(11, ODD[-1][1])].reasons == [None, "boilerplate"]
    assert by[(8, ODD[9][1])].reasons == [None, "navigation", None, None, "punctuation"]
    assert by[(9, ODD[-3][1])].reasons == ["punctuation"] * 3 + [None]
    assert clean(docs.limit(0)).count() == 0


def test_line_rules_leave_good_documents_alone(spark):
    from gleanery.llm.line_rules import clean

    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    rows = clean(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n[1, True] > 250 and n.get((1, False), 0) == 0 and n[0, False] > 20 and n.get((0, True), 0) == 0


def brute_whitening(vectors: list, most: int = 8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, [sum(int(d) ** 2 for d in n * row - s) for row in x], c @ v[:, ::-1][:, :most] / np.sqrt(e[::-1][:most]), e[::-1][:most] / e.sum()


def test_whitening(spark):
    from gleanery.llm.whitening import whiten

    vectors = spark.read.parquet(f"{SF1}/embeddings.parquet")
    want = sorted((r.vec_id, r.embedding) for r in vectors.collect())
    n, deviation, white, explained = brute_whitening([v for _, v in want])
    out = sorted(whiten(vectors.repartition(37)).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    assert [r.deviation for r in out] == [d for d in deviation for _ in range(8)]
    got = np.array([r.whitened for r in out]).reshape(n, 8)
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-8
    assert np.allclose([r.explained for r in out[:8]], explained, rtol=1e-9) and {r.identity_error for r in out}.pop() < 1e-9


def test_whitening_odd(spark):
    from gleanery.llm.whitening import whiten

    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 5)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300] * 5, [1.0, 2.0]]
    rows = [(k, v, 7) for k, v in enumerate(good)] + [(None, good[0], 7), (1, good[1], 7)] + [(100 + k, v, 7) for k, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").repartition(40)
    out = whiten(df).collect()
    n, deviation, white, explained = brute_whitening([v for _, v, _ in rows[:42]])
    assert n == 42 and len(out) == 42 * 5 and {r.n for r in out} == {42}
    one = {(r.vec_id, r.component): r for r in out}
    for k in range(40):
        assert one[k, 1].deviation == deviation[k] and abs(abs(one[k, 5].whitened) - abs(white[k, 4])) < 1e-9
    assert abs(one[0, 1].explained - explained[0]) < 1e-12 and sum(r.vec_id is None for r in out) == 5 and sum(r.vec_id == 1 for r in out) == 10
    assert whiten(df.where("vec_id >= 100 and vec_id < 106")).count() == 0  # nothing usable
    assert whiten(df.where("vec_id = 3")).count() == 0 and whiten(df.where("vec_id = 1")).count() == 0  # one point has no spread
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whiten(flat).collect()} == {1}  # a line has one component
    far = spark.createDataFrame([(k, [2.0**40 * k, 1.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(far).collect() if r.vec_id != 4} == {None}  # too large for a long


def test_jacobi_keeps_small_values():
    from gleanery.llm.whitening import jacobi

    rng = np.random.default_rng(1)
    for dim in (1, 2, 7, 32):
        q, p = np.linalg.qr(rng.normal(size=(dim, dim)))[0], np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        s = np.logspace(3, -3, dim)
        values, parts = jacobi(np.linalg.qr((q * s) @ p.T, mode="r"))
        assert np.allclose(values, s, rtol=1e-8) and np.abs(parts @ parts.T - np.eye(dim)).max() < 1e-12
    assert jacobi(np.zeros((0, 3)))[0].tolist() == [0, 0, 0]


def brute_audit(docs: list, labels: list):
    """docs: (doc_id, text, source). Every document is sent through every order."""
    out = {}
    for i, t, part in docs:
        t, part = t or "", part or ""
        w = WORDS.findall(t)
        c = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        c["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        good, toxic = (any(j is not None and j == i and x[k] == 1 for j, *x in labels) for k in (0, 1))
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                r = out.setdefault((part, "".join(order), step), [0] * 6)
                r[0] += not gone and not c[f]
                r[1] += not gone and c[f]
                r[2] += gone and c[f]
                r[3] += c[f] and sum(c.values()) == 1
                r[4] += not gone and c[f] and good
                r[5] += not gone and c[f] and toxic
                gone |= c[f]
    total = {}
    for (part, order, step), r in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + r[1]
    return {k: (*r, total[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def test_filter_audit(spark):
    from gleanery.llm.filter_audit import audit

    many = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", "short", "short", many, many, "A " * 150 + "b " * 150, many + " #", "Same TEXT here", LONG, LONG]
    docs = [(i, t, "s" if i % 3 else None) for i, t in enumerate(texts)]
    docs += [(4, many, "s"), (4, many, "s"), (None, many, ""), (None, None, "t"), (2, "short", "t"), (20, "é" * 9, "t")]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, None), (4, 1, 1), (None, 1, 1), (7, None, 1), (10, 1, 1), (10, 1, 1)]
    d = spark.createDataFrame([(*x, 1, True) for x in docs], "doc_id long, text string, source string, mask int, good boolean")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit(d, lab).collect()}
    assert got == brute_audit(docs, labels) and len(got) == 3 * 600
    assert audit(d.limit(0), lab).count() == 0
    assert audit(d, lab.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 3])
def test_survivors(n):
    from gleanery.llm.filter_audit import survivors

    c = np.random.default_rng(n).integers(0, 9, 1 << n)
    assert survivors(c).tolist() == [sum(int(c[m]) for m in range(1 << n) if not m & s) for s in range(1 << n)]
