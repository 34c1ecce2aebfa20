from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxspark.llm.components import components
from voxspark.llm.common import fold
from voxspark.llm.fingerprints import containment, distinct, edited, fingerprint_edits, merge, packed, resemblance, sketch, unpacked
from voxspark.llm.lattice import near_vectors, nearest, neighbours
from voxspark.llm.mixing import temperature, with_mixture
from voxspark.llm.nb_language import fit_language, predict_language
from voxspark.llm.ngram_join import ngram_components
from voxspark.llm.quality import difference, fit_quality, score_quality
from voxspark.llm.sharding import assign_shards
from voxspark.llm.toxicity import fit_toxicity, score_toxicity
from voxspark.llm.viterbi import SPACE, Encoder, Stream, decode, encode_texts, load_pieces
from voxspark.llm import wavelet
from voxspark.llm.wavelet import WaveletMatrix, build, read_shards, write_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, block long"


def frame(spark, texts, ids=None):
    """Documents with extra columns that clash with names used inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, 1.0, 3, 4) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(seed, words=60):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeghilmnorstu") for _ in range(draw.randint(2, 7))) for _ in range(words))


ODD = [None, "", "  \t\n ", "!!! ...", "word", "Word", "a b c d", "x" * 50_000, "é ß 日本語 🙂 " * 30]


def brute_components(ids, texts):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def test_ngram_components_are_those_of_brute_force(spark):
    draw, texts = random.Random(5), list(ODD)
    for group in range(6):
        base = prose(group, 80).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(draw.choice((0, 0, 1, 2, 3, 5))):
                copy[draw.randrange(len(copy))] = prose(draw.random(), 1)
            texts.append(" ".join(copy[draw.choice((0, 0, 3)) :]))
    texts += [texts[-1].upper(), texts[-1] + " "]
    ids = random.Random(1).sample(range(-50, 1000), len(texts))
    found = ngram_components(frame(spark, texts, ids))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(ids, texts)


def test_ngram_components_of_no_rows_and_of_rows_without_id(spark):
    assert ngram_components(frame(spark, [])).count() == 0
    assert [r.doc_id for r in ngram_components(frame(spark, ["a b", "a b"], [None, 4])).collect()] == [4]


def test_ngram_components_of_repeated_ids_and_of_ids_in_steps(spark):
    base = [prose(n, 40) for n in range(3)]
    texts = [base[n % 3] + f" tail{n % 2}" for n in range(60)]
    ids = [64 * n for n in range(60)]
    found = ngram_components(frame(spark, texts, ids)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(ids, texts)
    # Of the rows of one id the least text counts: null before all others, then by bytes.
    several = {7: ["b " + base[0], "a " + base[1], "c"], 8: [base[1]] * 3, 9: [None, base[0]], 10: [base[0]]}
    rows = [(i, t) for i, found in several.items() for t in found]
    random.Random(4).shuffle(rows)
    least = {i: min(found, key=lambda t: (t is not None, t)) for i, found in several.items()}
    found = ngram_components(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert len(found) == 4
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(list(least), list(least.values()))


def test_components_of_chains_and_stars(spark):
    links = [(n, n + 1) for n in range(20)] + [(100, n) for n in range(101, 120)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{n: 0 for n in range(21)}, **{n: 100 for n in range(100, 120)}}


def test_shards_follow_the_published_loop_and_slots_have_no_gaps(spark):
    def jump(key, shards):
        last, following = -1, 0
        while following < shards:
            last, key = following, (key * 2862933555777941757 + 1) % 2**64
            following = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return last

    rows = spark.createDataFrame([(i, 0) for i in range(500)] + [(None, 0), (3, 0), (3, 0)], "doc_id long, slot int")
    for shards in (1, 7, 40, 70):
        found = assign_shards(rows, "doc_id", shards).collect()
        assert len(found) == 503
        slots = {}
        for r in found:
            key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
            assert (r.shard, r.grown_shard) == (jump(key, shards), jump(key, shards + 1))
            assert r.grown_shard in (r.shard, shards)
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(rows.limit(0), "doc_id", 4).count() == 0


def test_fingerprints_estimate_and_merge(spark):
    whole, half = prose(1, 2000), prose(1, 2000)[:5000]
    a, b = sketch(whole), sketch(half)
    exact = {whole[i : i + 8] for i in range(len(whole) - 7)}
    assert distinct(a) == pytest.approx(len(exact), rel=0.3)
    assert containment(b, a) > 0.8 and containment(a, b) == pytest.approx(5000 / len(whole), abs=0.2)
    assert (unpacked(packed(a)) == a).all() and packed(sketch(None)) == ""
    parts = [sketch(whole[:4007]), sketch(whole[4000:])]
    assert (merge(parts) == a).all()
    assert resemblance(a, a) == 1.0 == resemblance(sketch(""), sketch(None)) and resemblance(a, sketch("")) == 0.0


def test_every_document_meets_the_next_one_over_all_parts(spark):
    texts = [*ODD, *[prose(n, 30) for n in range(60)], "twice", "twice"]
    ids = random.Random(2).sample(range(10_000), len(texts))
    found = {r.doc_id: r for r in fingerprint_edits(frame(spark, texts, ids), part_bytes=1500).collect()}
    order = sorted(zip(ids, [t or "" for t in texts], strict=True))
    assert len(found) == len(order)
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        row = found[doc]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited(text, following).encode()).hexdigest()
        assert row.near_next == resemblance(sketch(text), sketch(following))
        assert row.fingerprint == packed(sketch(text))
    assert fingerprint_edits(frame(spark, [])).count() == 0
    assert fingerprint_edits(frame(spark, ["alone"])).count() == 1


def test_likeness_of_fingerprints_is_near_the_true_one(spark):
    texts = [prose(n, 300) for n in range(40)] + ["short", "", None]
    found = {r.doc_id: r for r in fingerprint_edits(frame(spark, texts)).collect()}

    def shingles(text):
        return {text[i : i + 8] for i in range(max(1, len(text) - 7))} if text else set()

    gaps = []
    for i, text in enumerate(t or "" for t in texts):
        after = edited(text, texts[(i + 1) % len(texts)] or "")
        a, b = shingles(text), shingles(after)
        assert found[i].edited_fingerprint == packed(sketch(after)) and found[i].near_edited == resemblance(sketch(text), sketch(after))
        gaps.append(abs(found[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(gaps) < 0.2 and np.mean(gaps) < 0.06


def test_lattice_points_are_nearest():
    around = np.concatenate((np.zeros((1, 8)), neighbours()))
    assert len(around) == 241 and np.allclose((around[1:] ** 2).sum(axis=1), 2)
    points = np.random.default_rng(1).normal(size=(200, 8)) * 2
    own = nearest(points)
    gaps = ((points[:, None] - (own[:, None] + around[None])) ** 2).sum(axis=2)
    assert (gaps.argmin(axis=1) == 0).all() and gaps[:, 0].max() <= 1 + 1e-9


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("voxspark.llm.lattice.BLOCK", 16)  # large cells are split
    draw = np.random.default_rng(3)
    rows = []
    for center in draw.normal(size=(30, 32)):
        for _ in range(draw.integers(1, 60)):
            rows.append((center + draw.normal(size=32) * draw.choice((0, 0.05, 0.2, 0.3))).astype(np.float32).tolist())
    rows = [(i, v, i % 2) for i, v in enumerate(rows)]
    bad = [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [float("inf")] * 32]
    rows += [(9000 + i, v, 0) for i, v in enumerate(bad)] + [(9100, rows[0][1], None), (9101, [1.0, 0.0], 0)]
    found = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.93).collect()}
    assert len(found) == len(rows)
    good = rows[:-8]
    vectors = np.array([v for _, v, _ in good], np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.array([x for _, _, x in good])
    linked = (vectors @ vectors.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(linked, False)
    counts = np.array([found[i].n_links for i, _, _ in good])
    assert (counts <= linked.sum(axis=1)).all() and counts.sum() >= 0.95 * linked.sum()
    for i in (*range(9000, 9006), 9100, 9101):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)


def test_wavelet_matrix_answers_like_the_sequence(monkeypatch):
    monkeypatch.setattr(wavelet, "OPENED", 3)
    monkeypatch.setattr(wavelet, "PIECE", 7)
    draw = np.random.default_rng(0)
    for tokens in (draw.zipf(1.3, 5000) % 3000, np.zeros(9, int), np.empty(0, int), draw.integers(0, 70_000, 300_000), np.repeat([5, 1, 7], [513, 512, 3])):
        tokens = tokens.astype(np.uint32)
        matrix = WaveletMatrix(build(tokens, np.array([5]), np.array([len(tokens)])))
        assert (matrix.tokens() == tokens).all()
        some = draw.integers(0, max(len(tokens), 1), 40 if len(tokens) else 0)
        assert (matrix.read(some) == tokens[some]).all()
        for i in some[:20]:
            token = int(tokens[i])
            places = np.flatnonzero(tokens == token)
            assert matrix.access(int(i)) == token and matrix.count(token, 3, int(i)) == (tokens[3:i] == token).sum() * (i > 3)
            k = int(draw.integers(0, len(places)))
            assert matrix.select(token, len(places) - 1) == places[-1] and matrix.select(token, k) == places[k]
        assert matrix.count(80_000) == 0 and len(matrix._opened) <= 3
        with pytest.raises(IndexError):
            matrix.access(len(tokens))


def test_blocks_without_ones_take_no_bytes():
    tokens = np.zeros(1 << 19, np.uint32)
    tokens[-1] = 9
    data = build(tokens, np.array([5]), np.array([len(tokens)]))
    assert len(data) < 500 and (WaveletMatrix(data).tokens() == tokens).all()


def wanted_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 0
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        yield doc, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


MARKED = [
    "it's <|endoftext|> x<|startoftext|>y <|EndOfText|> X<|STARTOFTEXT|>",
    " \u0301a \xa0 q\x0bz\x1c",
    "'tis 'S don't DON'T \"'some' ('ll) rock'n'roll ''s",
    "a.b, (C) [D1] 2-3 x² ½! №5, é. É, ΣΑΣ. İ, I\u0307. <\u0338 =\u0338, \u0301. e\u0301, …, «a», 五. ٣, ǅ. ﬁ! İ. क़. \xa0a ñ\xa0,",
]


def test_token_files_come_back_whole(spark, tmp_path):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(8)
    letters = "aZ'.,<|>5²é\u0301Σ五…№ İǅ\xa0’"
    texts = [*ODD, *MARKED, *["".join(draw.choice(letters) for _ in range(60)) for _ in range(200)], *[prose(n, 40) for n in range(30)]]
    ids = random.Random(4).sample(range(1000), len(texts))
    folder = f"file://{tmp_path}/shards"
    found = read_shards(spark, folder, write_shards(frame(spark, texts, ids), folder, path, shard_bytes=5_000)).collect()
    assert sorted(map(tuple, found)) == sorted(wanted_tokens(sorted(zip(ids, texts, strict=True))))


def test_token_files_of_empty_tables_null_and_repeated_ids(spark, tmp_path):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    folder = f"file://{tmp_path}/none"
    assert read_shards(spark, folder, write_shards(frame(spark, []), folder, path)).count() == 0
    folder = f"file://{tmp_path}/odd"
    texts = [prose(n, 30) for n in range(3)] * 20
    ids = [None, 7, 7] * 20
    found = read_shards(spark, folder, write_shards(frame(spark, texts, ids), folder, path, shard_bytes=500)).collect()
    assert sum(r.doc_id is None for r in found) == 20 and sum(r.doc_id == 7 for r in found) == 40
    ends = sorted((r.start, r.n_tokens, r.doc_id) for r in found)
    assert [start for start, _, _ in ends] == [sum(n for _, n, _ in ends[:k]) for k in range(60)]
    assert [doc for _, _, doc in ends] == [None] * 20 + [7] * 40
    each = {crc for _, _, _, crc in wanted_tokens([(0, t) for t in texts[:3]])}
    assert {r.ids_crc32 for r in found} == each


def test_streaming_search_finds_the_best_path_and_decodes(spark):
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))

    def best(text):
        score, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            found = None
            for start in range(max(0, end - 16), end):
                value = pieces.scores.get(text[start:end], pieces.unknown if start == end - 1 else None)
                if value is not None and (found is None or score[start] + value > found[0]):
                    found = score[start] + value, start
            score.append(found[0])
            back.append(found[1])
        cuts, end = [], len(text)
        while end:
            cuts.append(text[back[end] : end])
            end = back[end]
        return [n for piece in reversed(cuts) for n in ([pieces.ids[piece]] if piece in pieces.ids else [pieces.byte_ids[b] for b in piece.encode()])]

    encoder = Encoder(pieces)
    for text in ["two  spaces", " lead and trail ", "日本語🙂\n\t", prose(3, 50), "a" * 300, "http://x.y/" + "q7" * 200]:
        marked = SPACE + text.replace(" ", SPACE)
        stream = Stream(pieces)
        ids = [n for character in marked for n in stream.push(character)] + stream.finish()
        assert ids == best(marked) == encoder.encode(text).tolist()
        assert decode(pieces, encoder.encode(text)) == text
    rows = encode_texts(frame(spark, ODD), str(public_tokenizers.path("piece_bpe_32k.model"))).collect()
    assert all(r.same and len(r.ids) == r.n_ids for r in rows) and rows[0].n_ids == rows[1].n_ids == 0


def dealt(spark, tokens, *limits):
    """The mixture of sources with the given tokens, its weights and its budgets by source."""
    totals = spark.createDataFrame([(n, 1, t) for n, t in tokens.items()], "source string, documents long, tokens long")
    mixture = temperature(totals, *limits)
    rows = mixture.sources.collect()
    return mixture, {r.source: r.weight for r in rows}, {r.source: r.budget for r in rows}


def entropy(weights):
    return -math.fsum(w * math.log(w) for w in weights)


def test_temperature_meets_entropy_and_repetition(spark):
    tokens = {"a": 900, "b": 90, "c": 10, "empty": 0}
    assert dealt(spark, tokens, 1.0, 0.0, 1e9)[0].exponent == 1.0
    mixture, weights, _ = dealt(spark, tokens, 1.0, 0.8, 1e9)
    assert entropy(weights.values()) == pytest.approx(0.8 * np.log(3), abs=1e-6) and sum(weights.values()) == pytest.approx(1.0)
    _, _, budgets = dealt(spark, tokens, 1.0, 1.0, 4.0)
    assert max(budgets[n] / tokens[n] for n in budgets) == pytest.approx(4.0, abs=0.2)
    assert "empty" not in budgets and dealt(spark, {}, 1.0, 1.0, 4.0)[1:] == ({}, {})


def test_repetition_limit_holds_where_the_budget_exceeds_it(spark):
    mixture, _, budgets = dealt(spark, {"a": 900, "b": 100}, 10.0, 1.0, 4.0)
    assert mixture.budget == 4000 and budgets == {"a": 3600, "b": 400} and mixture.exponent == 1.0
    tokens = {"a": 903, "b": 101, "c": 7, None: 1}
    for share in (0.5, 1.0, 3.99, 4.0, 4.01, 99.0):
        budgets = dealt(spark, tokens, share, 0.9, 4.0)[2]
        assert all(budgets[n] <= 4 * t for n, t in tokens.items())


def drawn(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def brute_mixture(rows, target, passes):
    """(id, pass, block, key) of all rows drawn, source by source, by a plain bisection and plain loops."""
    sized = [(i, len((text or "").split()), source) for i, text, source, _ in rows]
    tokens, documents = {}, {}
    for _, size, source in sized:
        tokens[source] = tokens.get(source, 0) + size
        documents[source] = documents.get(source, 0) + 1
    tokens = {n: t for n, t in tokens.items() if t}
    total = sum(tokens.values())

    def weights(exponent):
        raised = {n: (t / total) ** exponent for n, t in tokens.items()}
        return {n: r / math.fsum(raised.values()) for n, r in raised.items()}

    def right(exponent):
        found = weights(exponent)
        return entropy(found.values()) <= target * math.log(len(tokens)) + 1e-12 and all(total * w <= passes * tokens[n] for n, w in found.items())

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if right(middle) else (middle, high)
    out = []
    for name, weight in weights(round(high, 9)).items():
        whole, rest = divmod(math.floor(total * weight), tokens[name])
        for number in range(whole + 1):
            places = {}
            for i, size, source in sized:
                if source == name:
                    place = drawn("block", number, name, drawn(i) % -(-documents[name] // 1024)), drawn("row", number, i)
                    places.setdefault(place, []).append((i, size))
            used = 0
            for place in sorted(places):
                used += sum(size for _, size in places[place])
                if number == whole and used > rest:
                    break
                out += [(i, number, *place) for i, _ in places[place]]
    return sorted(out, key=str)


def test_mixture_draws_the_rows_of_plain_loops(spark):
    draw = random.Random(8)
    sources = ["big"] * 1500 + ["mid"] * 80 + [None] * 20 + ["blank"] * 3
    rows = [(i, "" if s == "blank" else prose(i, draw.randint(1, 40)), s, "x") for i, s in enumerate(sources)]
    rows += [rows[0], (None, "no id", "mid", "x"), (5000, None, "mid", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pass string")
    docs = docs.withColumns({n: F.lit("x") for n in ("blocks", "passes", "rest", "block", "tokens")})
    mixed, mixture = with_mixture(docs, 0.9, 3.0)
    found = mixed.collect()
    assert 0 < mixture.exponent < 1 and len({r.mix_block for r in found if r.source == "big"}) > 1
    assert sorted([(r.doc_id, r.mix_pass, r.mix_block, r.mix_key) for r in found], key=str) == brute_mixture(rows, 0.9, 3.0)
    assert with_mixture(docs.limit(0), 0.9, 3.0)[0].count() == 0


def test_any_number_of_sources_is_weighed_in_tables(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id") % 30_000).alias("source"))
    mixed, mixture = with_mixture(rows, 1.0, 4.0)
    assert mixture.exponent == 0.0 and mixed.count() in range(59_000, 60_001) and mixture.sources.count() == 30_000


def test_models_score_every_row_and_tell_classes_apart(spark):
    draw, rows, labels = random.Random(6), [], []
    for i in range(240):
        good, toxic, german = i % 3 > 0, i % 5 == 0, i % 2 == 0
        text = " ".join(draw.choice(("der", "und", "nicht", "schön", "haus") if german else ("the", "and", "not", "house", "nice")) + prose(i * 99 + k, 1) for k in range(60))
        text = text if good else text.upper() + " $$$ !!! " * 30
        rows.append((i, text + (" you stupid idiot moron" * 3 if toxic else ""), "de" if german else "en"))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame(rows + [(1000 + n, t, None) for n, t in enumerate(ODD)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    held = fold(F.col("doc_id"), 4) == 2
    quality = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, marks, ~held)).collect()}
    toxic = {r.doc_id: r.score for r in score_toxicity(docs, fit_toxicity(docs, marks, ~held)).collect()}
    language = {r.doc_id: r for r in predict_language(docs, fit_language(docs.where(~held))).collect()}
    tests = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(quality[i] > 0.5) == (i % 3 > 0) for i in tests]) > 0.9
    assert np.mean([(toxic[i] > 0.5) == (i % 5 == 0) for i in tests]) > 0.9
    assert np.mean([language[i].lang_pred == ("de" if i % 2 == 0 else "en") for i in tests]) > 0.95
    for i in range(1000, 1000 + len(ODD)):
        assert 0 <= quality[i] <= 1 and 0 <= toxic[i] <= 1 and 0 <= language[i].score <= 1
    assert [language[1000 + n].lang_pred for n in range(4)] == ["und"] * 4
    empty = marks.limit(0)
    assert {r.score for r in score_quality(docs, fit_quality(docs, empty, F.lit(True))).collect()} == {0.5}
    assert {r.score for r in score_toxicity(docs, fit_toxicity(docs, empty, F.lit(True))).collect()} == {0.5}
    nothing = fit_language(docs.limit(0))
    assert {r.lang_pred for r in predict_language(docs, nothing).collect()} == {"und"}


def plain_language(known, text, width_bits=15):
    """Language and posterior by a loop over languages and n-grams; ``known`` has the texts of each language."""

    def grams(value):
        value, kept, before = (value or "").lower(), [], False
        for c in value:
            kept += [c] if c.isalpha() else [" "] if before else []
            before = c.isalpha()
        value = [ord(c) for c in " " + "".join(kept) + " "] if any(c.isalpha() for c in value) else []
        out = []
        for width in (2, 3, 4):
            for at in range(len(value) - width + 1):
                total = width
                for code in value[at : at + width]:
                    total = (total * 0x9E3779B97F4A7C15 + code) % 2**64
                for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F)):
                    total = (total ^ (total >> shift)) * factor % 2**64
                out.append((total ^ (total >> 32)) >> (64 - width_bits))
        return out

    asked, documents, best = grams(text), sum(map(len, known.values())), {}
    if not asked:
        return "und", 0.0
    for name, texts in known.items():
        counts = {}
        for value in texts:
            for gram in grams(value):
                counts[gram] = counts.get(gram, 0) + 1
        size = sum(counts.values()) + 0.5 * 2**width_bits
        best[name] = math.log(len(texts) / documents) + sum(math.log((counts.get(g, 0) + 0.5) / size) for g in asked) * min(1.0, 256 / len(asked))
    name = max(sorted(best), key=best.get)
    return name, 1 / sum(math.exp(v - best[name]) for v in best.values())


def test_language_scores_are_those_of_plain_loops_in_any_blocks(spark):
    names = ["aa", "bb", "cc", "dd", "ee"]
    words = {n: prose(500 + k, 25).split() for k, n in enumerate(names)}
    draw = random.Random(7)
    known = {n: [" ".join(draw.choices(words[n], k=12)) for _ in range(6)] for n in names}
    learnt = [(k, t, n, "x") for k, (n, t) in enumerate((n, t) for n in names for t in known[n])]
    asked = [" ".join(draw.choices(words[a], k=4) + draw.choices(words[b], k=4)) for a in names for b in names] + [t for t in ODD if len(t or "") < 1000]
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame(learnt + [(100, None, "aa", "x"), (101, "no language", None, "x")], schema)
    rows = spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(asked)], schema)
    wanted = [plain_language(known, t) for t in asked]
    for width in (1, 2, 256):
        model = fit_language(docs, width=width)
        assert len(model.blocks) == -(-5 // width)
        found = {r.doc_id: r for r in predict_language(rows, model, keep=("doc_id", "text") if width == 2 else ("doc_id",)).collect()}
        assert [found[k].lang_pred for k in range(len(asked))] == [n for n, _ in wanted]
        assert [found[k].score for k in range(len(asked))] == pytest.approx([s for _, s in wanted], abs=1e-9)
    assert predict_language(rows.limit(0), model).count() == 0


def sentences(seed, size, good):
    """At least ``size`` characters of invented sentences over a small vocabulary; bad ones are lists with marks."""
    draw, words = random.Random(seed), prose(1, 300).split()
    parts, total = [], 0
    while total < size:
        line = draw.choices(words, k=12)
        parts.append(" ".join(line).capitalize() + ".\n" if good else "".join(f"{w}$$$ " if draw.random() < 0.5 else f"{w} | " for w in line))
        total += len(parts[-1])
    return "".join(parts)


def test_quality_evidence_comes_from_the_whole_text(spark):
    rows = [(i, sentences(i, random.Random(i).randint(300, 4000), i % 4 > 0), int(i % 4 > 0)) for i in range(400)]
    sizes = (500, 2_000, 10_000, 100_000, 1_000_000)
    rows += [(1000 + n, sentences(1000 + n, size, n % 2 > 0), None) for n, size in enumerate(s for s in sizes for _ in range(2))]
    good, bad = sentences(2000, 20_000, True), sentences(2001, 180_000, False)
    rows += [(2000, good + bad, None), (2001, bad + good, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, q) for i, _, q in rows if q is not None], "doc_id long, quality int")
    model = fit_quality(docs, marks, F.col("doc_id") % 5 != 0)
    score = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    texts = {i: text for i, text, _ in rows}
    for n in range(2 * len(sizes)):
        assert (score[1000 + n] >= 0.7) == (n % 2 > 0), (n, score[1000 + n])
        assert abs(score[1000 + n] - n % 2) < 0.1
    assert score[2000] < 0.3 and score[2001] < 0.3
    for kind in (0, 1):
        short, long = (np.mean([difference(model.good, model.bad, texts[i]) for i in ids]) for ids in ([1002 + kind], [1008 + kind]))
        assert long == pytest.approx(short, rel=0.25)
    assert np.mean([(score[i] >= 0.7) == (q > 0) for i, _, q in rows[:400] if i % 5 == 0]) > 0.95


def test_stream_commits_where_paths_meet_and_keeps_a_bounded_window():
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(12)

    def whole(text):
        score, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            options = [(score[start] + pieces.scores[text[start:end]], -start) for start in range(max(0, end - pieces.longest), end) if text[start:end] in pieces.scores]
            if text[end - 1 : end] not in pieces.scores:
                options.append((score[end - 1] + pieces.unknown, 1 - end))
            highest, start = max(options)
            score.append(highest)
            back.append(-start)
        cuts, end = [], len(text)
        while end:
            cuts.append(text[back[end] : end])
            end = back[end]
        return [n for piece in reversed(cuts) for n in ([pieces.ids[piece]] if piece in pieces.ids else [pieces.byte_ids[b] for b in piece.encode()])]

    texts = {
        "base64": "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=20_000)),
        "cjk": "".join(draw.choices("日本語中文人大小上下山川田水火木金土東京学校生国年月時分一二三", k=11_000)),
        "words": SPACE + prose(13, 2_000).replace(" ", SPACE),
    }
    for name, text in texts.items():
        stream, ids, largest, start = Stream(pieces), [], 0, 0
        while start < len(text):
            stop = start + draw.randint(1, 40)
            ids += stream.push(text[start:stop])
            largest = max(largest, len(stream.window), len(stream.best) - 1, len(stream.back) - 1)
            start = stop
        wanted = whole(text)
        assert largest <= 4 * pieces.longest, (name, largest)
        assert len(ids) >= len(wanted) - 4 * pieces.longest
        assert ids + stream.finish() == wanted, name
    for text in ("a" * 3000, "ab" * 1500, "=" * 3000 + "-" * 3001, "q7🙂" * 500):
        stream = Stream(pieces)
        assert stream.push(text) + stream.finish() == whole(text)
