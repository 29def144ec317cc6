"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wavequill.llm")

from wavequill.llm import ann, jaccard, licenses, media, mixing, packing, quality, tokens, toxicity, warc  # noqa: E402
from wavequill.llm.queries import tokenizer  # noqa: E402

LONG = "the quick brown fox jumps over a lazy dog and runs away " * 3000
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven twelve."),
    (2, "One two three four five six seven eight nine ten eleven twelve."),
    (3, "one TWO three four five six seven eight nine ten eleven twelve thirteen"),
    (4, None),
    (5, ""),
    (5, ""),
    (6, "short"),
    (7, LONG),
    (7, LONG),
    (8, LONG + " with a different end"),
    (None, "One two three four five six seven eight nine ten eleven twelve."),
    (9, "A text\nof lines\n\nand  double  blanks\tand tabs \n"),
    (10, "licensed under the Apache License, Version 2.0. MIT License mit license"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 6 else None, len(t or ""), 1, 2.0, "x", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, score double, node string, row int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- tokens --------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(docs, empty):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = rows_of(tokens.count_tokens(docs, tokenizer("piece_bpe_32k.model")), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = sorted(((i, len((t or "").encode()), len(p.encode(t or "")), len(p.encode(t or "")) > 4096) for i, t in TEXTS), key=repr)
    assert got == want
    assert tokens.count_tokens(empty, tokenizer("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("text", ["a b  c", " lead", "trail ", "x " * 300, "ü " * 200 + "▁ ▁", "a\nb c\td " * 50, "日本 語 " * 90])
def test_safe_pieces_add_up(text):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    assert tokens.splittable(p)
    assert sum(len(p.encode(x)) for x in tokens.safe_pieces(text, 16)) == len(p.encode(text))


# ---- packing -------------------------------------------------------------------------------------


def test_word_encoder_equals_the_library():
    e = packing.WordEncoder(tokenizer("byte_bpe_50k.json"))
    for t in [x or "" for _, x in TEXTS] + ["a\tb", " a", "a ", "a  b", "\n", "it's we're", "x<|endoftext|>y", "a\0b c\nd", "a\r\nb", "ﬁ Ａ ١", "É. È, ñ!", " ", "x² y_z", "日本 語"]:
        assert e.encode(t) == np.asarray(e.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing_is_a_gapless_cover(docs, empty):
    e = packing.WordEncoder(tokenizer("byte_bpe_50k.json"))
    out = [r.asDict() for r in packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()]
    total = 0
    want = sorted(((i, e.encode(t or "") + b"\2\0\0\0") for i, t in TEXTS), key=repr)
    total = sum(len(c) // 4 for _, c in want)
    assert sum(r["length"] for r in out) == total
    crcs = sorted(((i, c[4 * s : 4 * (s + n)]) for i, c in want for s, n in _cuts(len(c) // 4)), key=repr)
    assert sorted((repr(r["doc_id"]), r["ids_crc32"]) for r in out) == sorted((repr(i), zlib.crc32(c)) for i, c in crcs)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def _cuts(n, size=1024):
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def sequential(lengths, size):
    gaps = []
    for length in sorted(lengths, reverse=True):
        i = min((i for i, g in enumerate(gaps) if g >= length), key=lambda i: gaps[i], default=None)
        if i is None:
            gaps.append(size - length)
        else:
            gaps[i] -= length
    return len(gaps)


def packed(spark, lengths, size, range_rows):
    rows = [(i, i % 7, 0, 0, n, 1) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.best_fit(df, size, jaccard.Scratch(spark, "fit"), range_rows).collect()
    assert sorted(r["length"] for r in out) == sorted(lengths)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= size
    return len(by)


@pytest.mark.parametrize("kind", ["even", "tiny", "ties"])
def test_sweeps_match_sequential_best_fit_decreasing(spark, kind):
    rng = np.random.default_rng(3)
    lengths = {"even": rng.integers(1, 101, 400), "tiny": np.concatenate([rng.integers(55, 90, 40), 1 + rng.integers(0, 4, 900)]), "ties": np.repeat([51, 34, 26, 20, 3, 100], [30, 60, 5, 200, 90, 4])}[kind].tolist()
    want = sequential(lengths, 100)
    assert packed(spark, lengths, 100, 10**6) == want
    # Ranges of fifty rows: every border may cost a sequence.
    assert packed(spark, lengths, 100, 50) <= want + len(lengths) // 50


def test_equal_documents_fill_a_gap_before_the_next():
    """Five documents of 256 in gaps of 1024: four in one, one in another."""
    r = packing._Ranges(1024, True)
    found, offsets = r.take([1] * 5, [256] * 5, list(range(5)))
    assert found == [0, 0, 0, 0, 4] and offsets == [0, 256, 512, 768, 0]


def test_left_documents_take_the_nearest_slots_before_them():
    runs = packing.match_ranges([(0, 0, 3), (1, 1, 2), (2, 4, 0), (3, 2, 1)])
    assert runs == [(0, 0, 2, 1, 0, 1), (1, 1, 0, 2, 0, 2), (2, 0, 0, 2, 2, 2)]


# ---- mixing --------------------------------------------------------------------------------------


def test_mix_targets_share_by_weight_and_stop_at_three_sizes():
    goal = mixing.targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)])
    assert goal["c"] == 0 and goal["a"] == 30 and goal["b"] == 300
    assert abs(sum(goal.values()) - 1110) < 1e-6
    assert mixing.targets([]) == {} and mixing.targets([("a", 5)]) == {"a": 5.0}


def test_goals_of_a_table_equal_targets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 400):
        sizes = [("saé😀"[: 1 + i % 4] + f"{i:03d}", int(x)) for i, x in enumerate(rng.integers(0, 50, n) ** 3)] + [(None, 900)] * (n > 2)
        out, count = mixing.goals(spark.createDataFrame(sizes, "source string, n long").repartition(5), jaccard.Scratch(spark, "goals"), (1, 2, 3), 3)
        want = mixing.targets(sizes)
        got = {r["source"]: r["target"] for r in out.collect()}
        assert count == len(sizes) and got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)
    # Many sources are joined by a shuffle, with the same result.
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "nullif(concat('s', id % 50), 's7') as source")
    few = rows_of(mixing.mix(many)[0], "doc_id", "taken", "target")
    monkeypatch.setattr(mixing, "SENT_SOURCES", 3)
    assert rows_of(mixing.mix(many)[0], "doc_id", "taken", "target") == few and mixing.repeat(many).count() == mixing.mix(many)[0].agg({"copies": "sum"}).first()[0]


def test_mix_comes_near_its_targets(spark, docs, empty):
    out = mixing.mix(docs)[0].collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", next((t or "") for i, t in TEXTS if i == r["doc_id"])))
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    many = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "concat('s', id % 5) as source")
    mixed = mixing.mix(many)[0]
    sums = mixed.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in sums:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 7
    assert rows_of(mixed, "doc_id", "taken") == rows_of(mixing.mix(many.repartition(7))[0], "doc_id", "taken")
    assert mixing.mix(empty)[0].count() == 0
    repeated = mixing.repeat(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["copies"] for r in out)


# ---- near duplicates -----------------------------------------------------------------------------


def brute_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return [sum(1 for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= threshold * len(a | b) - 1e-9) for i, a in enumerate(sets)]


def test_jaccard_join_finds_all_links(spark, docs, empty):
    got = sorted(((r["doc_id"], r["n_links"]) for r in jaccard.similar_classes(docs)[0].collect()), key=repr)
    assert got == sorted(zip([i for i, _ in TEXTS], brute_links([t for _, t in TEXTS]), strict=True), key=repr)
    assert jaccard.similar_classes(empty)[0].count() == 0
    rng = np.random.default_rng(1)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 60)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(40):
            w = list(b)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                w[at] = f"v{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = jaccard.BLOCK_TEXTS
    jaccard.BLOCK_TEXTS = 16  # groups of 40 then fall in several blocks
    try:
        got = {r["doc_id"]: r["n_links"] for r in jaccard.similar_classes(df)[0].collect()}
    finally:
        jaccard.BLOCK_TEXTS = old
    want = brute_links(texts)
    assert sum(got.values()) >= 0.999 * sum(want) and all(got[i] <= want[i] for i in got)


def test_filters_and_mix_keep_columns_of_any_name(docs):
    """Columns called like those that the operators make stay as they are."""
    named = docs.withColumns({c: F.lit(c) for c in ("row", "key", "mark", "gone", "again", "n", "plan", "mix", "h", "whole", "below", "also", "col", "copies", "band", "low", "__id", "__mix", "a.b")})
    for out in (jaccard.keep_one(named), mixing.repeat(named)):
        assert out.columns == named.columns and out.count() > 0
        assert all(r[c] == c for r in out.collect() for c in ("row", "key", "mark", "plan", "h", "a.b"))


def test_keep_one_keeps_a_row_of_each_class(docs):
    left = jaccard.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([1, 4, 5, 5, 6, 7, 8, 9, 10], key=repr)


def test_pruning_keeps_what_can_reach_the_threshold():
    steps = jaccard.least_matches(0.8, 1e-6)
    assert [n for n, _ in steps] == list(range(5, 126, 5)) and all(m <= n for n, m in steps)
    assert steps[-1][1] > 70  # far fewer than 0.8 * 125 equal values can't be


def test_empty_blocks_count_no_links(spark, monkeypatch):
    """Forty pairs of near copies in two blocks each: both copies are often in one block, and the other is empty."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 100)
    texts = []
    for k in range(40):
        words = [f"g{k}w{i}" for i in range(100)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    out = jaccard.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0]
    assert rows_of(out, "doc_id", "class_id", "n_links") == sorted(((i, i - i % 2, 1) for i in range(80)), key=repr)


def test_components_of_long_chains(spark):
    """Chains of 400 hops whose ids are in shuffled order, a star and a lone pair."""
    rng = np.random.default_rng(2)
    edges, want = [(9000, 9001)], {9000: 9000, 9001: 9000}
    for k in range(5):
        ids = (rng.permutation(401) + 1000 * k).tolist()
        edges += zip(ids, ids[1:])
        want.update(dict.fromkeys(ids, 1000 * k))
    edges += [(8000 + i, 8500) for i in range(300)]
    want.update(dict.fromkeys([*range(8000, 8300), 8500], 8000))
    out = jaccard.components(spark.createDataFrame(edges, "a long, b long"), jaccard.Scratch(spark, "chains"), "c")
    assert {r["node"]: r["component"] for r in out.collect()} == want and out.count() == len(want)


@pytest.mark.parametrize("step", [1, 5])
def test_chained_corpora_are_one_class(spark, step):
    """Texts of 90 words, each ``step`` words on from the one before: one class, and every link of brute force."""
    texts = [" ".join(f"w{i * step + j}" for j in range(90)) for i in range(700)]
    order = np.random.default_rng(7).permutation(len(texts)).tolist()
    out = jaccard.similar_classes(spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string"))[0].collect()
    assert {r["class_id"] for r in out} == {0}
    # 86 shingles, of which texts d places apart share 86 - step * d.
    reach = max(d for d in range(1, 20) if (86 - step * d) >= 0.8 * (86 + step * d) - 1e-9)
    want = {order[i]: min(i, reach) + min(len(texts) - 1 - i, reach) for i in range(len(texts))}
    got = {r["doc_id"]: r["n_links"] for r in out}
    assert got == want


# ---- classifiers ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}a" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic, bad = i % 7 == 0, i % 5 == 0
        lines = [" ".join(rng.choice(words, 9)) + "." for _ in range(6)]
        if bad:
            lines[2:5] = [" ".join(w.upper() + "!!" for w in rng.choice(words, 9)) for _ in range(3)]
        if toxic:
            lines[0] += " " + " ".join(rng.choice(["idiot", "moronic", "stupidly"], 1 + i % 4))
        rows.append((i, "\n".join(lines)))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_on_held_out_rows(corpus, docs, empty):
    out = {r["doc_id"]: r for r in toxicity.severity(*corpus).collect()}
    held = [i for i in out if held_out(i)]
    assert sum(out[i]["toxic"] == (i % 7 == 0) for i in held) >= 0.99 * len(held)
    mild, strong = ([out[i]["expected_severity"] for i in held if i % 7 == 0 and i % 4 == k] for k in (0, 3))
    assert np.mean(mild) < np.mean(strong) <= 3
    none = corpus[1].where("false")
    assert {r["toxic"] for r in toxicity.severity(docs, none).collect()} == {False}
    assert toxicity.severity(empty, none).count() == 0
    kept = toxicity.keep_clean(*corpus)
    assert kept.columns == ["doc_id", "text"] and not any(r["doc_id"] % 7 == 0 and held_out(r["doc_id"]) for r in kept.where("doc_id % 4 = 3").collect())


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(3000)]
    true = np.array([2.0, 1.0, 0.5, -0.5, -1.0, 0.0])
    z = np.array([true[r].sum() for r in rows]) + rng.logistic(size=3000)
    grades = np.digitize(z, [0.0, 1.5, 3.0])
    w, cuts = toxicity.fit_cumulative_link(rows, grades, 6, 4)
    assert np.all(np.diff(cuts) > 0) and np.corrcoef(w, true)[0, 1] > 0.98


def test_quality_on_held_out_rows(corpus, docs, empty):
    out = {r["doc_id"]: r for r in quality.quality(*corpus).collect()}
    held = [i for i in out if held_out(i)]
    assert all(out[i]["held_out"] for i in held)
    assert sum(out[i]["predicted"] == (i % 5 != 0) for i in held) >= 0.99 * len(held)
    none = corpus[1].where("false")
    scores = quality.quality(docs, none).collect()
    assert len(scores) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.quality(empty, none).count() == 0


def test_toxicity_scores_equal_brute_force(docs):
    rng = np.random.default_rng(1)
    words = sorted({w for _, t in TEXTS for w in re.findall(r"[^\W\d_]+", (t or "").lower())})[::2]
    model = toxicity.OrdinalModel({w: i for i, w in enumerate([*words, "twel-", "apach-"])}, rng.normal(size=len(words) + 2), np.array([-0.5, 0.4, 1.0]))
    got = rows_of(toxicity.score(docs, model), "doc_id", "expected_severity", "grade", "p_toxic", "toxic")
    want = []
    for i, t in TEXTS:
        found = set()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            found |= {w} | {w[:n] + "-" for n in (4, 5, 6) if len(w) > n}
        z = sum(model.weights[model.vocabulary[f]] for f in found if f in model.vocabulary)
        over = [1 / (1 + np.exp(c - z)) for c in model.cuts]
        p = [1 - over[0], over[0] - over[1], over[1] - over[2], over[2]]
        want.append((i, sum(over), int(np.argmax(p)), over[0], bool(over[0] >= 0.5)))
    for a, b in zip(got, sorted(want, key=repr), strict=True):
        assert a[0] == b[0] and a[2] == b[2] and a[4] == b[4] and np.allclose([a[1], a[3]], [b[1], b[3]])


def test_rare_toxicity_keeps_its_rows(spark):
    """Two in a hundred rows are toxic and the sample is small: it holds them all, and the cuts still tell the whole labels' share."""
    rows = [(i, ("vile " if i % 50 == 0 else "kind ") + f"w{i % 13}x text of words") for i in range(3000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(3000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_rows=200)
    assert model.weights[model.vocabulary["vile"]] > 0 > model.weights[model.vocabulary["kind"]]
    out = toxicity.score(docs, model)
    assert {r["doc_id"] for r in out.where("toxic").select("doc_id").collect()} == set(range(0, 3000, 50))


def naive_line_features(text):
    out, seen = [], []
    for line in text.split("\n"):
        b = line.encode()
        n = lambda members: sum(x in members for x in b)
        capital = n(range(65, 91)) + sum(b[k] == 0xC3 and 0x80 <= b[k + 1] <= 0x9E for k in range(len(b) - 1))
        letters = n([*range(65, 91), *range(97, 123), *range(128, 256)])
        digit, mark, symbol, pipe, loud, blank = n(range(48, 58)), n(b".,;:'\"-()?"), n(b"*%$&#@^~=+<>{}[]\\/_`"), n(b"|"), n(b"!"), n([9, 11, 12, 13, 32])
        words = re.split(rb"[\t\x0b\x0c\r ]+", b.strip(b"\t\x0b\x0c\r ")) if b.strip(b"\t\x0b\x0c\r ") else []
        size = max(len(b), 1)
        other = max(size - max(letters, 1) - digit - mark - symbol - pipe - loud - blank, 0)
        same = sum(x == y for x, y in zip(words, words[1:]))
        again = float(len(b) > 0 and words in seen)
        seen.append(words)
        out.append([1, capital / max(letters, 1), digit / size, mark / size, (symbol / size) ** 0.5, (pipe / size) ** 0.5, (loud / size) ** 0.5, other / size, blank / size, same / max(len(words) - 1, 1), again, np.log1p(len(b)), float(len(words) < 4), min(len(b) / max(len(words), 1), 40) / 10, float(letters == 0)])
    return np.array(out, float)


def test_quality_scores_equal_brute_force(spark):
    """Features line by line, and marginals by summing over all labellings of a text's lines."""
    rng = np.random.default_rng(4)
    d = 3 * len(quality.FEATURES)
    model = quality.LineCrf(rng.normal(size=d) * 0.1, rng.uniform(0.5, 2, d), rng.normal(size=d) * 0.5, rng.normal(size=(2, 2)), -3.0, 1.5)
    texts = ["One line.", None, "", "A b\nA b\n!!! LOUD ÉTÉ | 12\n\nlast last last one", "x\n" * 6, "tabs\tand ümlauts, (marks) #1\r\nnext", "Word " * 40 + "\nend"]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model).collect()}
    for i, t in enumerate(texts):
        x = naive_line_features(t or "")
        pad = np.vstack([np.zeros(x.shape[1]), x, np.zeros(x.shape[1])])
        z = (np.hstack([x, pad[:-2], pad[2:]]) - model.mean) / model.spread
        u, n = z @ model.weights, len(x)
        total, marginal = 0.0, np.zeros(n)
        for s in np.ndindex(*[2] * n):
            v = np.exp(sum(u[k] * s[k] for k in range(n)) + sum(model.step[s[k - 1], s[k]] for k in range(1, n)))
            total, marginal = total + v, marginal + v * np.array(s)
        length = np.array([max(len(line.encode()), 1) for line in (t or "").split("\n")])
        bad = (marginal / total * length).sum() / length.sum()
        want = 1 / (1 + np.exp(-(1.5 - 3.0 * bad)))
        assert abs(got[i]["score"] - want) < 1e-9 and got[i]["predicted"] == int(want >= 0.5) and got[i]["held_out"] == held_out(i), t


def test_quality_fit_is_bounded_in_lines(corpus):
    rows = corpus[0].withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.repeat(F.lit("A line of words.\n"), 5000)).otherwise(F.col("text")))
    out = {r["doc_id"]: r["predicted"] for r in quality.score(rows, quality.fit(rows, corpus[1], max_lines=2400)).collect()}
    assert np.mean([out[i] == (i % 5 != 0) for i in out if held_out(i) and i % 50]) >= 0.98


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    lines = np.array([3, 1, 4])
    unary, step = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs, logz = quality.forward_backward(unary, lines, step)
    want, total, first = np.zeros(8), 0.0, 0
    for n in lines:
        weights, marg = [], np.zeros(n)
        for s in np.ndindex(*[2] * n):
            v = np.exp(sum(unary[first + k] * s[k] for k in range(n)) + sum(step[s[k - 1], s[k]] for k in range(1, n)))
            weights.append(v)
            marg += v * np.array(s)
        want[first : first + n] = marg / sum(weights)
        total += np.log(sum(weights))
        first += n
    assert np.allclose(p, want) and np.isclose(logz, total) and np.isclose(pairs.sum(), 5)


# ---- licenses ------------------------------------------------------------------------------------


def brute_licenses(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, base = [], set()
    for phrase, label in licenses.PHRASES:
        q = phrase.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                at.append(i)
                base.add(label)
    s = f" {' '.join(w)} "
    found = sorted((m.start(), -m.end(), -r.priority, r.label) for r in licenses.rules() if any(k in s for k in r.keywords) for m in re.finditer(r.pattern, s))
    kept = []
    for e in found:
        if not any(k[1] <= e[1] and k[2] <= e[2] for k in kept):
            kept.append(e)
    labels = base | {k[3] for k in kept}
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max([-k[2] for k in kept] + [2 * bool(base)]) / 4


def test_licenses_equal_brute_force(spark, docs, empty):
    extra = ["SPDX-License-Identifier: GPL-3.0-or-later", "CC BY 4.0 cc by", "GNU General Public License version 2 or later. " * 50, "Ünï K licence", "\0mit\0license", "see LICENSE file for details; dedicated to the public domain", "BSD license " * 90, "All rights reserved.", "mit license gpl " * 40 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    every = docs.select("doc_id", "text", "score", "node").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string").selectExpr("*", "0.0D score", "'' node"))
    got = rows_of(licenses.scan(every), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == sorted(((i, *brute_licenses(t)) for i, t in [*TEXTS, *((100 + i, t) for i, t in enumerate(extra))]), key=repr)
    assert licenses.scan(empty).count() == 0
    assert len({r.pattern for r in licenses.rules()}) == len(licenses.rules()) > 400
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1].replace("Exchange RoundRobin", "")


def test_license_keywords_miss_no_match(spark):
    """Every alternative of every license alone in a text, and brute force by all patterns without their keywords."""
    given = {
        "Released under BSD-3-Clause.": "bsd-3-clause", "FreeBSD": "bsd-2-clause", "original BSD": "bsd-4-clause", "0BSD": "0bsd", "MPL 2.0": "mpl-2.0", "mpl v1.1": "mpl-1.1", "MIT No Attribution": "mit-0",
        "https://www.eclipse.org/legal/epl-2.0": "epl-2.0", "https://www.mozilla.org/en-US/MPL/2.0/": "mpl-2.0", "https://mozilla.org/mpl": "mpl", "a simple reply": "",
    }
    # What is not fixed is a c, a digit, a z or a word.
    fill = lambda x: x.replace("li\0en", "licen").replace("licen\0e", "license").replace("ori\0ed", "orized").replace("cecill \0", "cecill a").replace("\0", "1").strip()
    own = [p for _, name, _, place in licenses.LICENSES for p in (name, place)] + [p for *_, p in licenses.SENTENCES]
    alternatives = {fill(x) for p in own for x in licenses._runs(p)}
    texts = [*given, *sorted(alternatives)]
    patterns = {(r.label, r.priority, r.pattern) for r in licenses.rules()}
    joined = "|".join(sorted({p for _, _, p in patterns}))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (t, label) in enumerate(given.items()):
        assert got[i][0] == label, t
    assert len(texts) > 800 and not [t for t in texts[len(given) :] if not re.search(joined, f" {t} ")]
    for i, t in enumerate(texts):
        s = " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "
        assert (got[i][1] > 0) == bool(re.search(joined, s)), t
        if i % 5 == 0:
            kept = []
            for e in sorted((m.start(), -m.end(), -n, label) for label, n, p in patterns for m in re.finditer(p, s)):
                if not any(k[1] <= e[1] and k[2] <= e[2] for k in kept):
                    kept.append(e)
            base = {label for phrase, label in licenses.PHRASES if f" {phrase} " in s}
            assert got[i][0] == ",".join(sorted(base | {k[3] for k in kept})), t


def test_many_mentions_in_one_text(spark):
    """100,000 mentions in one text: time grows with the text and not with its square."""
    text = "the mit license and the apache license " * 50_000
    start = time.perf_counter()
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (got["n_base"], got["labels"], got["last_word"]) == (100_000, "apache,mit", 349_998)
    assert time.perf_counter() - start < 60


# ---- media ---------------------------------------------------------------------------------------


def test_media_round_trip(spark, docs, empty):
    shared = "shared passage of some length, repeated in many documents. " * 200
    rows = [(i, t) for i, t in TEXTS] + [(50 + i, shared + f"own end {i} " * (100 * i)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as bytes", "'d' as digest")
    out, scratch = media.media_digests(df)
    got = rows_of(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    want = []
    for i, t in rows:
        p, n = media.payload_of(t or "")
        m = media.wave(p)
        assert len(p) % 192 == 0 and media.samples(m) == p
        want.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest()))
    assert got == sorted(want, key=repr)
    stored = spark.read.parquet(scratch.path("shared")).count()
    assert stored > 0 and spark.read.parquet(scratch.path("shared")).select("digest").distinct().count() == stored
    assert media.media_digests(empty)[0].count() == 0


def test_chunks_survive_an_insertion():
    data = np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    cut = lambda b: {b[s:e] for s, e in zip([0, *media.cuts(b)[:-1]], media.cuts(b), strict=True)}
    a, b = cut(data), cut(data[:70_000] + b"new" + data[70_000:])
    assert len(a & b) >= len(a) - 4
    slow, h = [], 0
    for x in data[:3000]:
        h = (h * 2 + int(media.GEAR[x])) % 2**32
        slow.append(h)
    assert media.gear_hashes(np.frombuffer(data[:3000], np.uint8)).tolist() == slow


# ---- warc ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<html>" + "same page " * 50 + "</html>"
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, "http://a/2\r\nX: y", "tiny"), (4, None, "tiny"), (5, "u", None), (6, "u", ""), (7, "u", big + "ü"), (None, "u", big), (8, "u", big + "ü"), (1, "http://a/1", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as kind", "1 as first").repartition(3)
    manifest = warc.write(pages, f"file://{tmp_path}/a", file_bytes=600)
    assert manifest.count() > 1
    got = rows_of(warc.read(spark, f"file://{tmp_path}/a"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(3, 1), (2, None), (4, None), (5, None), (6, None), (7, None), (None, 1), (8, 7)]
    page = {i: h for i, _, h in rows}
    expect = [(i, len((page[i] or "").encode()), sha(page[i]), "response" if to is None else "revisit", to) for i, to in want]
    expect += [(1, len(big), sha(big), "response", None), (1, len(big), sha(big), "revisit", 1)]
    assert got == sorted(expect, key=repr)
    first = {m["file"]: m["sha256"] for m in map(json.loads, open(tmp_path / "a/manifest.jsonl"))}
    warc.write(pages.repartition(5), f"file://{tmp_path}/b", file_bytes=600)
    again = {m["file"]: m["sha256"] for m in map(json.loads, open(tmp_path / "b/manifest.jsonl"))}
    assert first == again and not (tmp_path / "a/_temporary").exists()
    warc.write(pages.where("false"), f"file://{tmp_path}/c")
    assert warc.read(spark, f"file://{tmp_path}/c").count() == 0


def test_warc_files_do_not_depend_on_partitions(spark, tmp_path):
    """20,000 rows in several files, negative and null ids, one id and one payload with a third of all rows: files are equal to the byte."""
    i = F.col("id")
    page = F.when(i % 3 == 0, 77).when(i % 1000 == 1, None).otherwise(i * i * 7919 - 10**10)
    html = F.when(i % 3 == 1, F.repeat(F.lit("common "), 30)).otherwise(F.concat(F.sha2(i.cast("string"), 256), F.sha2((i + 1).cast("string"), 512)))
    spark.range(20_000).select(page.alias("page_id"), F.concat(F.lit("http://x/"), i).alias("url"), html.alias("html")).repartition(9).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    listed = []
    for name, df in (("a", pages), ("b", pages), ("c", pages.repartition(5)), ("d", pages.coalesce(1))):
        manifest = warc.write(df, f"file://{tmp_path}/{name}", file_bytes=100_000, shard_bytes=400_000)
        listed.append(sorted((r["file"].rpartition("/")[2], r["records"], r["sha256"]) for r in manifest.collect()))
        for file, _, sha in listed[-1][:3]:
            assert hashlib.sha256((tmp_path / name / file).read_bytes()).hexdigest() == sha
    assert listed[0] == listed[1] == listed[2] == listed[3]
    shards = {f.split("-")[1] for f, _, _ in listed[0]}
    assert len(shards) > 12 and len(listed[0]) > len(shards)
    # The id with a third of the rows is in several shards, as no record is much larger than the others.
    assert max(sum(n for f, n, _ in listed[0] if f.split("-")[1] == s) for s in shards) < 2_000
    out = warc.read(spark, f"file://{tmp_path}/a").cache()
    assert out.count() == 20_000 and out.where("record_type = 'response'").count() == 13_334


# ---- nearest neighbours --------------------------------------------------------------------------


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[100:400] = v[100]  # equal vectors: ties go to smaller ids
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [1.0] * 15), (5081, [2.0] * 15), (5082, [1.0] * 15), (5100, [None] * 16), (None, [1.0] * 16), (20, v[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "'x' as kind")
    out = ann.search(df, k=20, every=20)
    by = {}
    for r in out.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    # Vectors of fifteen components meet each other.
    assert sorted(by.pop(5080)) == [(1, 5081, 30.0), (2, 5082, 15.0)]
    assert sorted(by) == list(range(0, 3000, 20))
    exact = v.astype(float)
    hits = 0
    for q, found in by.items():
        s = exact @ exact[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert np.allclose([x for _, _, x in found], [s[i] for _, i, _ in found], atol=1e-9)
        hits += len(set(best.tolist()) & {i for _, i, _ in found})
    assert hits / (20 * len(by)) >= 0.97
    copies = [i for _, i, _ in by[100] if 100 < i < 400]
    assert len(copies) > 5 and copies == list(range(101, 101 + len(copies)))
    few = ann.search(df.where("vec_id in (20, 21, 22)"), k=20, every=20)
    assert few.count() == 2
    assert ann.search(df.where("false")).count() == 0
