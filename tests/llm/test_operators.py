"""Each operator against a plain version, on planted cases, and on odd input."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import DOC, components, crc, repeat_words, shingles, words

from pyspark.sql import functions as F

from quarry.llm import (
    decontamination,
    hmm_scoring,
    jaccard_join,
    language_id,
    line_dedup,
    quality_cnn,
    quality_rules,
    source_mix,
    substring_dedup,
    token_counts,
)
from quarry.llm.components import components as spark_components

R = random.Random(7)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(3000)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def edited(text, rate):
    return " ".join(R.choice(VOCABULARY) if R.random() < rate else w for w in text.split(" "))


def frame(spark, texts, source=lambda i: f"s{i % 12}", lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t) if t else None) for i, t in enumerate(texts)], DOC)


# ---- 1


def test_substring_dedup_finds_planted_passages(spark):
    passage, clean = prose(60), [prose(R.randint(40, 400)) for _ in range(60)]
    texts = list(clean)
    for i in (3, 17, 40):
        texts[i] = texts[i] + "\n" + passage + " " + prose(30)
    fuzzy = passage.split(" ")
    fuzzy[30] = "changed"
    texts[50] = prose(80) + " " + " ".join(fuzzy) + " " + prose(10)
    texts.append(texts[5] if len(texts[5].split()) > 60 else texts[3])
    got = substring_dedup.passages(frame(spark, texts)).collect()
    ids = {r["doc_id"] for r in got} | {r["first_doc_id"] for r in got}
    assert {3, 17, 40, 50} <= ids
    assert ids <= {3, 17, 40, 50, 60, 5}
    for r in got:
        a, b = words(texts[r["doc_id"]])[r["start_word"] : r["end_word"]], words(texts[r["first_doc_id"]])[r["first_start"] : r["first_end"]]
        assert len(a) >= substring_dedup.MIN_WORDS and r["n_equal"] >= 0.8 * len(a)
        assert len(set(a) & set(b)) >= 0.7 * len(set(a))


def test_chains_are_the_best_by_plain_search():
    for _ in range(30):
        n = R.randint(1, 25)
        x, y = np.array([R.randint(0, 60) for _ in range(n)]), np.array([R.randint(0, 60) for _ in range(n)])
        best = {}
        for i in sorted(range(n), key=lambda i: (x[i], y[i])):
            before = [best[j] - substring_dedup.GAP * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i]]
            best[i] = 1 + max([0, *before])
        found = substring_dedup.chains(x, y)
        assert sorted(i for c in found for i in c.tolist()) == list(range(n))
        for c in found:
            assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()
        top = max(len(c) - substring_dedup.GAP * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) for c in found)
        # a link over MAX_GAP costs more than it gains, so no best chain is cut
        assert top == pytest.approx(max(best.values()), abs=1e-9)


# ---- 2


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    texts = [prose(50), "a<|endoftext|>b", "<|endoftext|>" * 3, " " * 999, "it's we'LL\n\n x", "é中😀\x1c\x85  ", "ab" * 5000, "x1y22 ...!?", None, ""]
    got = {r["doc_id"]: r for r in token_counts.count(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids), t
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 512)
    assert token_counts.count(odd).count() == odd.count()


# ---- 3


def test_quality_cnn_learns_junk(spark):
    texts = [prose(80) if i % 2 else " ".join(w + "$$$" for w in prose(80).split()) for i in range(600)]
    net = quality_cnn.fit(texts[:400], [i % 2 for i in range(400)], epochs=8)
    p = net.scores(pa.array(texts[400:]))
    assert ((p >= 0.5) == [i % 2 == 1 for i in range(200)]).mean() > 0.95
    # whole texts: what comes late changes the score
    clean = prose(400)
    late = net.scores(pa.array([clean, clean + " " + " ".join(w + "$$$" for w in prose(300).split())]))
    assert late[0] != late[1]


def test_quality_gradients_are_the_slopes():
    net = quality_cnn.Network(3)
    column, y = pa.array([prose(30), prose(200), ""]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.scores(column)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    net.w["bias"] += np.linspace(-0.3, 0.31, len(net.w["bias"]))  # away from the kinks
    g, step = net.gradients(column, y), 1e-5
    for key, at in (("out", 3), ("out_bias", 0), ("bias", 5), ("filter", (7, 2)), ("embed", (97, 1))):
        keep = net.w[key][at].copy()
        net.w[key][at] = keep + step
        up = loss()
        net.w[key][at] = keep - step
        down = loss()
        net.w[key][at] = keep
        assert g[key][at] == pytest.approx((up - down) / (2 * step), abs=1e-3), key


def test_quality_on_odd_input(spark, odd, none):
    net = quality_cnn.fit([], [])
    rows = quality_cnn.score(odd.withColumn("held_out", F.lit(False)), net).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert quality_cnn.score(none.withColumn("held_out", F.lit(False)), net).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert 0 <= quality_cnn.train(odd, labels).scores(pa.array(["x"]))[0] <= 1


# ---- 4


def test_hmm_base_and_likelihood(spark):
    texts = [prose(R.randint(1, 60)) for _ in range(120)] + [None, "", prose(3) + " neverseen"]
    docs = frame(spark, texts).select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held_out"))
    from collections import Counter

    tokens = [words(t) + ["\0end"] for t in texts]
    c = Counter(w for i, t in enumerate(tokens) if crc(i) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    for r in hmm_scoring.score(docs).collect():
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r["score"] < 0


def test_long_texts_are_scored_by_the_same_recursion(spark):
    r = np.random.default_rng(8)
    m = hmm_scoring.Model(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(9), 3).T.copy())
    seqs = [r.integers(0, 9, n) for n in (hmm_scoring.STEPS * 2 + 17, 40, hmm_scoring.STEPS)]
    kept, _ = hmm_scoring.forward(m, seqs, True)
    assert np.allclose(hmm_scoring.forward(m, seqs), kept, rtol=1e-12)


def test_training_beats_the_unigram_on_topics(spark):
    topics = [[f"t{k}w{j}" for j in range(60)] for k in range(4)]
    texts = [" ".join(R.choice(topics[i % 4]) for _ in range(80)) for i in range(200)]
    docs = frame(spark, texts).select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held_out"))
    rows = hmm_scoring.score(docs).filter("held_out").collect()
    assert sum(x["score"] for x in rows) > 0.9 * sum(x["base_score"] for x in rows)  # log10: a tenth nearer to 0


def test_forward_and_expected_counts_by_plain_recursion():
    r = np.random.default_rng(2)
    k, s = 3, 7
    m = hmm_scoring.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(s), k).T.copy())
    seqs = [r.integers(0, s, n) for n in (1, 4, 9, 2)]
    got = hmm_scoring.forward(m, seqs)
    emit, move, start = np.zeros((s, k)), np.zeros((k, k)), np.zeros(k)
    hmm_scoring.expected(m, seqs, emit, move, start)
    total = 0
    for q, logp in zip(seqs, got):
        a = m.start * m.emit[q[0]]
        for o in q[1:]:
            a = (a @ m.move) * m.emit[o]
        assert logp == pytest.approx(math.log10(a.sum()))
        total += len(q)
    assert emit.sum() == pytest.approx(total) and start.sum() == pytest.approx(len(seqs)) and move.sum() == pytest.approx(total - len(seqs))


def test_hmm_on_odd_input(spark, odd, none):
    held = lambda d: d.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)).alias("held_out"))
    assert hmm_scoring.score(held(odd)).count() == odd.count()
    assert hmm_scoring.score(held(none)).count() == 0


# ---- 5


def test_mix_is_poisson_by_source(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 4 == 0, "rare").otherwise("common").alias("source"))
    out = source_mix.mix(docs, {"rare": 1.0, "common": 1.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert abs(n["rare"] - 2000) < 200 and abs(n["common"] - 2000) < 200
    again = source_mix.mix(docs, {"rare": 1.0, "common": 1.0})
    assert again.select("doc_id", "copy_no").exceptAll(source_mix.mix(docs, {"rare": 1.0, "common": 1.0}).select("doc_id", "copy_no")).isEmpty()
    assert again.filter("copy_no > n_copies").isEmpty()
    assert source_mix.mix(docs, {"rare": 1.0}).filter("source = 'common'").isEmpty()


def test_poisson_steps(spark):
    for rate in (0.0, 0.4, 7.0, 300.0):
        steps = spark.range(1).select(source_mix.poisson_steps(F.lit(rate))).first()[0]
        exact = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else float(k == 0) for k in range(len(steps))]
        assert np.allclose(steps, np.cumsum(exact), atol=1e-9) and steps[-1] > 1 - 1e-9


def test_rates_of_any_size_are_drawn(spark):
    docs = spark.createDataFrame([(i, "x" * 600, "large") for i in range(1000)] + [(5000, "y", "small"), (5001, "", "none")], "doc_id long, text string, source string")
    out = source_mix.mix(docs)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    rate = {r["_source"]: r["rate"] for r in source_mix.rates(docs).collect()}
    assert rate["small"] > source_mix.PART and abs(n["small"] - rate["small"]) < 6 * rate["small"] ** 0.5
    many = source_mix.mix(docs.filter("source <> 'none'"), {"small": 1.0}, budget=0.2)
    copies = many.agg(F.count("*"), F.max("copy_no"), F.count_distinct("copy_no"), F.max("n_copies")).first()
    assert abs(copies[0] - 120_000) < 6 * 120_000**0.5 and copies[0] == copies[1] == copies[2] == copies[3]


def test_mix_on_odd_input(spark, odd, none):
    out = source_mix.mix(odd.withColumns({"_source": F.lit("c"), "steps": F.lit("c"), "block": F.lit("c"), "n_copies": F.lit("c")}), budget=4.0)
    rows = out.collect()
    assert set(odd.columns) <= set(out.columns) and rows and all(r["_source"] == r["steps"] == r["block"] == "c" for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["copy_no"], r["text"]), []).append(r["n_copies"])
    # repeated rows draw alike
    assert all(len(v) == (2 if k[0] == 1 else 1) and k[1] <= v[0] for k, v in by.items())
    assert source_mix.mix(none).count() == 0


# ---- 6


def test_quality_rules_by_plain_code(spark, odd):
    texts = [prose(R.randint(0, 120)) for _ in range(40)] + ["a b c " * 40, "x y\nx y\n\nz\nx y", "the and of to in " * 30 + prose(60), "#a $b %c", None, "\x0b\t", "the of the"]
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        import re

        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat_words(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 50 or 2 * expected[-1] > len(w)) and not (r["base_failed"] and r["kept"])
    clash = quality_rules.judge(odd.withColumns({"_words": F.lit("c"), "_lines": F.lit("c"), "n_symbols": F.lit("c")})).collect()
    assert len(clash) == odd.count() and all(r["_words"] == r["_lines"] == "c" and r["n_symbols"] in range(100) for r in clash)
    assert quality_rules.judge(odd.limit(0)).count() == 0


# ---- 7


def language_docs(spark, n=160):
    alphabets = {"aa": "abcdef", "bb": "mnopqr"}
    texts = []
    for i in range(n):
        letters = alphabets["aa" if i % 2 else "bb"]
        texts.append(" ".join("".join(R.choice(letters) for _ in range(R.randint(2, 8))) for _ in range(20)))
    return frame(spark, texts, lang=lambda i: "aa" if i % 2 else "bb")


def test_language_id(spark):
    rows = language_id.train_and_identify(language_docs(spark)).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in rows)


def test_forward_sums_all_segmentations():
    t = language_id.trie(language_id.vocabulary_path())
    r = np.random.default_rng(1)
    p = r.dirichlet(np.ones(t.n_pieces), 2).T
    text = "thé on".encode()
    w = np.frombuffer(text, np.uint8)
    got = language_id.word_logs(t, w, np.array([0, 5]), np.array([4, 7]), p)

    def piece(raw):
        node = 0
        for b in raw:
            node = t.child[node, t.kind[b]] if node >= 0 else -1
        return t.piece[node] if node >= 0 else -1

    for word, logs in ((text[0:4], got[0]), (text[5:7], got[1])):
        whole = language_id.MARK + word
        alpha = [np.ones(2)] + [np.zeros(2) for _ in whole]
        for e in range(1, len(whole) + 1):
            for s in range(e):
                if (q := piece(whole[s:e])) >= 0:
                    alpha[e] = alpha[e] + alpha[s] * p[q]
        assert np.allclose(np.log(alpha[-1]), logs)


def test_words_of_any_length_and_rare_letters_have_finite_scores(spark):
    t = language_id.trie(language_id.vocabulary_path())
    r = np.random.default_rng(4)
    p = r.dirichlet(np.full(t.n_pieces, 0.05), 2).T + 1e-9
    p /= p.sum(axis=0)
    word = "".join(R.choice("abcdeé") for _ in range(700)).encode()
    got = language_id.word_logs(t, np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), p)[0]
    whole, log = language_id.MARK + word, np.log(p)
    alpha = np.full((len(whole) + 1, 2), -np.inf)
    alpha[0] = 0
    for s in range(len(whole)):
        node = 0
        for e in range(s + 1, len(whole) + 1):
            node = t.child[node, t.kind[whole[e - 1]]]
            if node < 0:
                break
            if t.piece[node] >= 0:
                alpha[e] = np.logaddexp(alpha[e], alpha[s] + log[t.piece[node]])
    assert np.allclose(alpha[-1], got)
    model = (["x", "y"], np.log([0.5, 0.5]), np.full((t.n_pieces, 2), 1.0 / t.n_pieces))
    model[2][5] = 1e-12
    rows = language_id.identify(frame(spark, ["𐎀" * 12, "ݐ" * 24, "q" * 200_000, "中" * 9_000 + " ok"]), model).collect()
    assert all(r["lang_pred"] in ("x", "y") and 0 < r["score"] <= 1 for r in rows)


def test_em_by_plain_forward_backward():
    t = language_id.trie(language_id.vocabulary_path())
    p = np.random.default_rng(3).dirichlet(np.ones(t.n_pieces), 2).T
    ws, code, n = [b"house", b"on", "thé".encode()], np.array([0, 1, 1]), np.array([2.0, 1.0, 3.0])
    at = np.cumsum([0, *map(len, ws)])
    counts = np.zeros_like(p)
    big, _ = language_id.scaled(t, p, 51)
    language_id._expect(t, *language_id.marked(np.frombuffer(b"".join(ws), np.uint8), at[:-1], at[1:]), big, code, n, counts)
    want = np.zeros_like(p)
    for w, c, k in zip(ws, code, n):
        whole, found = language_id.MARK + w, []

        def cut(s, used, q):
            if s == len(whole):
                found.append((used, q))
            node = 0
            for e in range(s, len(whole)):
                node = t.child[node, t.kind[whole[e]]]
                if node < 0:
                    return
                if t.piece[node] >= 0:
                    cut(e + 1, [*used, t.piece[node]], q * p[t.piece[node], c])

        cut(0, [], 1.0)
        total = sum(q for _, q in found)
        for used, q in found:
            for i in used:
                want[i, c] += k * q / total
    assert np.allclose(counts, want)


def test_language_on_odd_input(spark, odd, none):
    rows = language_id.train_and_identify(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not language_id.has_letter(r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0 < r["score"] <= 1
    assert language_id.train_and_identify(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.train_and_identify(unlabelled).collect()} == {"und"}


# ---- 8


def test_jaccard_join_by_plain_pairs(spark):
    base = [prose(R.choice([1, 2, 4, 5, 6, 7, 8, 9, 12, 20, 60, 150, 400])) for _ in range(120)]
    passage = prose(40)
    texts = list(base)
    for t in base[:60]:
        texts += [edited(t, R.choice([0, 0.005, 0.02, 0.05])) for _ in range(2)]
    texts += [passage + " " + prose(R.randint(2, 30)) for _ in range(60)]  # one common passage
    hub = prose(120)
    texts += [edited(hub, 0.01) for _ in range(60)] + [hub] * 30  # many near copies, many copies
    texts += ["", None, " \n", "one two", "One  two", "one two three"]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    expected = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}


def test_repeated_ids_are_linked_row_by_row(spark):
    a, x = prose(60), prose(60)
    near = " ".join(a.split(" ")[:-1])
    for rows in ([(1, a), (1, x), (2, near)], [(1, x), (2, x), (1, a), (2, near), (1, a)]):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        least = {t: min(i for i, y in rows if y == t or {y, t} == {a, near}) for _, t in rows}
        assert got == sorted((i, len(shingles(t)), least[t]) for i, t in rows)


def test_families_near_the_threshold(spark):
    """Many texts of one origin with similarities on both sides of 0.75: wide runs that links do not settle."""
    texts = []
    for n in (40, 250):
        origin = prose(n)
        texts += [edited(origin, R.choice([0.015, 0.025, 0.03, 0.035])) for _ in range(60)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    expected = components(sets)
    assert 1 < len(set(expected.values())) < len(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == expected


def test_every_linked_pair_shares_a_sketch_or_is_wide():
    for n in (1, 3, 5, 9, 15, 40, 111, 300):
        for _ in range(40):
            a = np.unique(np.random.default_rng(R.randint(0, 1 << 30)).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop = R.randint(0, max(0, len(a) // 7))
            b = np.unique(np.concatenate([a[drop:], np.random.default_rng(R.randint(0, 1 << 30)).integers(0, 1 << 63, drop // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 4 * both < 3 * (len(a) + len(b) - both):
                continue
            sk, entry, _, _ = jaccard_join.sketches([a, b])
            assert set(sk[entry // 2 == 0].tolist()) & set(sk[entry // 2 == 1].tolist())


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 5)], "a long, b long")
    assert {(r["id"], r["root"]) for r in spark_components(links).collect()} == {(2, 1), (3, 1), (4, 1), (9, 8)}
    assert spark_components(links.limit(0)).count() == 0


def test_jaccard_on_odd_input(odd, none):
    rows = jaccard_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert jaccard_join.near_duplicates(none).count() == 0


# ---- 9


def test_line_dedup(spark):
    texts = [f"own line {i}\nshared by all\n  few sites  \nend {i}" if i < 30 else f"other {i}\nshared by all" for i in range(40)]
    docs = frame(spark, texts, source=lambda i: f"s{i % 12}").withColumn("text", F.when((F.col("doc_id") % 12) < 4, F.col("text")).otherwise(F.regexp_replace("text", "  few sites  \n", "")))
    out = {r["doc_id"]: r for r in line_dedup.clean(docs, min_sites=10).collect()}
    assert "shared by all" in out[0]["text"] and not any("shared by all" in out[i]["text"] for i in range(1, 40))
    assert "few sites" in out[1]["text"] and out[5]["n_removed_lines"] == 1 and out[5]["n_chars"] == len(out[5]["text"])
    spread = {r["spread"]: r["exact"] for r in line_dedup.boilerplate(docs, min_sites=10).collect()}
    assert spread == {12: True}


def test_line_dedup_drops_what_is_left_empty(spark):
    docs = frame(spark, ["same line"] * 20 + ["", None], source=lambda i: f"s{i}")
    rows = {r["doc_id"]: r["text"] for r in line_dedup.clean(docs, min_sites=10).collect()}
    assert rows == {0: "same line", 20: "", 21: None}
    assert line_dedup.clean(docs, min_sites=10, drop_empty=False).count() == 22


def test_line_dedup_on_odd_input(odd, none):
    out = line_dedup.clean(odd.withColumns({"_kept": F.lit("c"), "gone": F.lit("c"), "_doc": F.lit("c"), "kept": F.lit("c")}))
    assert all(r["_kept"] == r["gone"] == r["_doc"] == r["kept"] == "c" for r in out.collect())
    assert out.count() == odd.count() and len(out.columns) == len(set(out.columns))
    assert line_dedup.clean(none).count() == 0


# ---- 10


def test_decontamination(spark):
    items = [prose(n) for n in (3, 6, 16, 20, 33, 60, 90)] + ["", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts, leaks = [prose(R.randint(50, 300)) for _ in range(60)], {}
    for i in range(7):
        for k in range(3):
            w = texts[7 * i + k].split(" ")
            at = R.randint(0, len(w))
            texts[7 * i + k] = " ".join(w[:at] + items[i].upper().split(" ") + w[at:])
            leaks[7 * i + k] = i
    w = items[6].split(" ")
    w[10] = "changed"
    texts[55] = prose(40) + " " + " ".join(w) + " " + prose(9)
    leaks[55] = 6
    got = decontamination.search(frame(spark, texts), bench).collect()
    assert {(r["doc"], r["item_id"]) for r in got} == set(leaks.items())
    for r in got:
        assert r["similarity"] == 1.0 or r["doc"] == 55
        start = words(texts[r["doc"]])[r["start_word"] : r["start_word"] + len(words(items[r["item_id"]]))]
        assert len(set(start) & set(words(items[r["item_id"]]))) >= 0.9 * len(set(start))
    assert {r["doc_id"] for r in decontamination.decontaminate(frame(spark, texts), bench).collect()} == set(range(60)) - set(leaks)


def test_simhash_is_the_majority(spark):
    for c in decontamination.CLASSES:
        hashes = [[R.getrandbits(64) - (1 << 63) for _ in range(c)] for _ in range(20)]
        rows = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "i int, w array<long>")
        for r in decontamination.simhash(rows, c).collect():
            bits = sum(1 << b for b in range(64) if sum((h >> b) & 1 for h in hashes[r["i"]]) * 2 > c)
            assert r["fp"] % (1 << 64) == bits


def test_decontamination_on_odd_input(spark, odd, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, "")], "item_id long, text string")
    out = decontamination.decontaminate(odd, bench)
    assert out.count() == odd.count() - 2 and out.columns == odd.columns
    assert decontamination.decontaminate(none, bench).count() == 0
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(None, item), (None, "clean words here"), (None, "others"), (7, item), (7, "clean seven"), (8, "clean eight"), (None, None)]
    own = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(own, key=str) == sorted([r for r in rows if r[1] != item], key=str)
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == odd.count()
