from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from voxspark.llm import resampling
from voxspark.llm.resampling import WORDS, feature_counts, features, pair_crc, resample

SCHEMA = "doc_id long, text string, lang string, n_words long, place long, score long, line string"
ODD = [None, "", " \n\n ", "one", "two\nwords", "A\n\n\nb\n", "É é x\ny", "x" * 70_000, "y" * 9_000 + " " + "z" * 9_000 + "\n" + "w " * 300, "0\x000 \x7f a-b"]


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]


def buckets(text):
    w = words(text)
    return [zlib.crc32(x) % 10_000 for x in w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]]


def brute_force(rows, target):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [text for _, text in rows]), (t, target)):
        for text in texts:
            for b in buckets(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    scored = []
    for doc_id, text in rows:
        found = buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, len(found), weight, score, len(words(text)) >= 20 and score is not None))
    able = sorted((-score, doc_id, n, weight) for doc_id, n, weight, score, fit in scored if fit)
    drawn = 25 * len(able) // 100
    rows = [(doc_id, n, weight, -score, rank if rank <= drawn else None) for rank, (score, doc_id, n, weight) in enumerate(able, 1)]
    rows += [(doc_id, n, weight, score, None) for doc_id, n, weight, score, fit in scored if not fit]
    return sorted(rows, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 3, 4, 5, "line") for i, t in rows], SCHEMA).repartition(3)


def sentences(seed, count):
    draw = random.Random(seed)
    common = ["the", "Of", "and", "día", "naïve", "42", "x" * 65, "日本"]
    lines = [" ".join(draw.choice(common) + str(draw.choice(("", "", draw.randint(0, 30)))) for _ in range(draw.randint(1, 12))) for _ in range(20)]
    return ["\n".join(draw.choice(lines) for _ in range(draw.randint(0, 9))) for _ in range(count)]


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 50)


def test_rows_are_those_of_brute_force(spark):
    rows = [*enumerate(ODD), *enumerate(sentences(1, 150), 100)]
    rows += [(n, rows[120][1]) for n in range(400, 500)] + [(777, "same text " * 12)] * 40 + [(None, "no id " * 20), (None, None)]
    target = [*sentences(2, 20), "same text", None, ""]
    found = resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(frame(spark, []), none).count() == 0
    rows = [(n, f"some words {n} " * 12) for n in range(8)]
    assert sorted(map(tuple, resample(frame(spark, rows), none).collect()), key=str) == brute_force(rows, [])


def test_long_texts_are_taken_in_parts(small_chunks):
    draw = random.Random(4)
    for _ in range(200):
        letters = draw.choice(("abcé.A\n", "abc"))
        text = draw.choice((" ", "\n", "  ")).join("".join(draw.choice(letters) for _ in range(draw.choice((1, 3, 60, 130)))) for _ in range(draw.randint(0, 30)))
        found = [b for f in features([None, text.encode().translate(WORDS)], 10_000) for b in f.together()[0].tolist()]
        assert sorted(found) == sorted(buckets(text))


def test_counts_of_lines_and_of_pairs_across_lines_add_up(spark):
    texts = ["a b\nc", "a b\nc", "a b\n\n \nc d\n", "e", None, "\n", "a b"] * 5
    counts = feature_counts(spark.createDataFrame([(t,) for t in texts], "text string"), 10_000)
    expected = np.zeros(10_000, np.int64)
    for text in texts:
        np.add.at(expected, buckets(text), 1)
    assert (counts == expected).all()


def test_checksums_of_pairs_follow_from_those_of_words():
    draw = random.Random(9)
    for length in (1, 2, 63, 64, 65, 128, 500):
        a, b = bytes(draw.randrange(256) for _ in range(draw.randint(1, 80))), bytes(draw.randrange(256) for _ in range(length))
        got = pair_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([length]))
        assert got[0] == zlib.crc32(a + b" " + b)
