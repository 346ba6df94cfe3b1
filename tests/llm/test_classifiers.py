import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import langid, quality, toxicity

SYLLABLES = {"aa": "ba ko lu mi sen tar".split(), "bb": "sch ung keit ver zu est".split(), "cc": "tion eau que oi ment aux".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(5, 200)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    return rows + [(9000, None, "aa"), (9001, "", "bb"), (9002, "12 34 !", None), (9003, prose(rng, "aa", 30000), None), (None, prose(rng, "cc", 50), None), (9004, "日本", None)]


def test_language_of_held_out_documents(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df.unionAll(df.where("doc_id = 3"))).collect()}
    assert all(r.held_out == (i is not None and crc(i, 3) == 1) for i, r in got.items())
    known = [(i, lang) for i, _, lang in docs if lang and i < 9000 and crc(i, 3) == 1]
    assert np.mean([got[i].lang_pred == lang for i, lang in known]) > 0.98
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and [got[i].score for i in (9000, 9001, 9002)] == [0.0] * 3
    assert got[9003].lang_pred == "aa" and got[None].lang_pred == "cc"
    assert got[9004].lang_pred in SYLLABLES and got[9004].rejected and got[9004].score < 0.1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.limit(0)).collect() == []


def test_character_model_is_a_distribution():
    rng = random.Random(2)
    model = langid.Model({lang: [langid.letters(prose(rng, lang, 400))] for lang in SYLLABLES})
    alphabet = sorted({*"".join(prose(rng, lang, 300) for lang in SYLLABLES)})
    for context in ("sch", "zzz", "a k", "   "):
        x = np.concatenate([np.array([ord(c) for c in context + a], np.uint32) for a in alphabet])
        p = np.array([2.0 ** model._log2(x[4 * i : 4 * i + 4])[0] for i in range(len(alphabet))])
        assert (p.sum(0) <= 1.001).all() and (p.sum(0) > 0.4).all()


def test_probabilities_equal_plain_kneser_ney():
    text, probe = "banana bandana ban the band", "bandanna the x"
    model = langid.Model({"aa": [langid.letters(text)]})
    s = " " * 3 + text
    grams = {n: [s[i - n + 1 : i + 1] for i in range(3, len(s))] for n in range(1, 5)}
    counts = {n: Counter(grams[4]) if n == 4 else Counter(g[1:] for g in set(grams[n + 1])) for n in grams}

    def p(n, g):
        if n == 0:
            return 1 / (len(set(text)) + 1)
        own = {x: c for x, c in counts[n].items() if x[:-1] == g[:-1]}
        if not own:
            return p(n - 1, g[1:])
        one, two = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        d = one / (one + 2 * two) if one and two else 0.5
        return max(own.get(g, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(n - 1, g[1:])

    t = " " * 3 + probe
    want = [np.log2(p(4, t[i - 3 : i + 1])) for i in range(3, len(t))]
    got = model._log2(langid.padded(langid.letters(probe)))[:, 0]
    assert np.allclose(got, want, atol=1e-3)


def test_every_language_is_learned_and_too_many_are_an_error(spark, monkeypatch):
    rng = random.Random(9)
    parts = [[rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)] for _ in range(60)]
    rows = [(i, " ".join("".join(rng.choice(parts[i % 60]) for _ in range(3)) for _ in range(60)), f"l{i % 60:02d}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "CELLS", 3600 * 500)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    held = [r for r in rows if crc(r[0], 3) == 1]
    assert set(got.values()) == {r[2] for r in rows} and np.mean([got[i] == lang for i, _, lang in held]) > 0.9
    monkeypatch.setattr(langid, "LANGUAGES", 59)
    with pytest.raises(ValueError, match="59 languages"):
        langid.identify(df)


def test_sorted_arrays_find_what_they_hold():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    table = langid.Sorted(keys, np.arange(len(keys)))
    rows = table.find(np.concatenate((keys[::-1], keys + np.uint64(1))))
    assert (table.keys[rows[: len(keys)]] == keys[::-1]).all() and (rows[len(keys) :] == -1).mean() > 0.99


def test_chunks_do_not_change_the_entropy(monkeypatch):
    rng = random.Random(4)
    model = langid.Model({lang: [langid.letters(prose(rng, lang, 300))] for lang in SYLLABLES})
    x = langid.letters(prose(rng, "bb", 500))
    whole = model.bits(x)
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert np.allclose(model.bits(x), whole, atol=1e-4)


@pytest.fixture(scope="module")
def toxic():
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        words, bad = prose(rng, rng.choice(list(SYLLABLES)), rng.randrange(10, 250)).split(), rng.random() < 0.15
        for _ in range(rng.randrange(1, 5) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["grumpfish", "vexling", "snortle", "dratted!"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_of_held_out_documents(spark, toxic):
    odd = [(9000, None), (9001, ""), (9002, "Grumpfish " + "ba " * 20000), (None, "you VEXLING"), (9003, "?!" * 5000), (9004, "x" * 100_000)]
    d = spark.createDataFrame([(i, t) for i, t, _ in toxic] + odd, "doc_id bigint, text string").withColumn("predicted", F.lit("clash"))
    y = spark.createDataFrame([(i, b, None) for i, _, b in toxic] + [(9000, None, 1), (None, 1, 1)], "doc_id bigint, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score(d, y).collect()}
    held = [(i, b) for i, _, b in toxic if crc(i, 5) == 0]
    assert all(got[i].held_out for i, _ in held) and not got[None].held_out
    assert np.mean([got[i].predicted == b for i, b in held]) > 0.97
    assert [got[i].predicted for i in (9000, 9001, 9003, 9004)] == [0] * 4 and got[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = toxicity.clean(d, y)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_dictionaries_are_trained_and_tell_unseen_forms(toxic):
    model = toxicity.train([(t, y) for _, t, y in toxic])
    assert model.toxic != model.ordinary and model.toxic.endswith(toxicity.SHARED) and model.ordinary.endswith(toxicity.SHARED)
    rng = random.Random(77)
    plain = [prose(rng, "aa", 40) for _ in range(60)]
    forms = ["Grumpfishes", "VEXLINGER", "snortled", "vexlingly", "grumpfish-like"]
    assert not any(any(w in t.split() for w in map(str.lower, forms)) for _, t, _ in toxic)
    assert sum(model.score(t) >= 0.5 for t in plain) <= 2
    assert sum(model.score(f"{t} {forms[i % 5]} {forms[(i + 1) % 5]} ba ko") >= 0.5 for i, t in enumerate(plain)) >= 57
    # By hand: what a window gains is the difference of its lengths when compressed.
    t = plain[0] + " vexling"
    pair = [toxicity._compressor(d) for d in (model.ordinary, model.toxic)]
    lengths = [[len(c.compress(toxicity.SHARED + w)) for w in toxicity.windows(t)] for c in pair]
    assert model.gains(t) == [a - b for a, b in zip(*lengths, strict=True)]


def test_toxicity_segments_equal_a_slow_likelihood_ratio():
    own, other = Counter({"grumpf": 30, "common": 40, "rarely": 3}), Counter({"common": 380, "plainly": 100})
    assert toxicity.contrast(own, other, 50, 500)[0].strip().lower() in "grumpf" and len(toxicity.contrast(own, other, 50, 500)) == 1


def test_toxicity_without_both_classes(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    for rows in ([], [(1, 0)], [(1, 1)]):
        y = spark.createDataFrame(rows, "doc_id bigint, toxic int")
        assert [r.score for r in toxicity.score(d, y).collect()] == [0.0, 0.0]
    assert toxicity.score(d.limit(0), y).collect() == []


def test_quality_shrinks_sparse_sites_and_finds_junk(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < (0.5 if i % 3 == 0 else 0.05)
        text = prose(rng, "aa", 80).capitalize()
        text = text.replace(" ", "### ") if bad else text + ".\n" + prose(rng, "aa", 20)
        rows.append((i, text, ["spam", "good", None][i % 3], "aa"))
        if rng.random() < 0.5:
            labels.append((i, int(not bad)))
    truth = {i: int("###" not in t) for i, t, *_ in rows}
    rows += [(5000, None, "lone", None), (5001, "", "lone", "x"), (None, "word " * 30000, "good", "aa")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("host", F.lit(1)).withColumn("salt", F.lit(1))
    y = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.score_documents(d, y).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].keep == t for i, t in truth.items()]) > 0.97
    mean = {h: np.mean([r.prior for r in got.values() if r.host == h]) for h in ("spam", "good", None)}
    assert mean["spam"] < 0.75 < mean["good"] and mean[None] > 0.75
    assert 0.2 < got[5000].prior < 0.8  # two empty texts, drawn toward the whole


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "a", "s", "l"), (1, "a", "s", "l")], "doc_id bigint, text string, source string, lang string")
    y = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [round(r.score, 6) for r in quality.score_documents(d, y).collect()] == [0.5, 0.5]
    assert quality.score_documents(d.limit(0), y).collect() == []


def test_word_weights_equal_a_slow_ratio(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(["fine", "prose", "good"] if i % 2 else ["spam", "buy", "prose"]) for _ in range(6)), i % 2) for i in range(60)]
    d, y = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, y int")
    got = {r.doc_id: r.w for r in d.select("doc_id", quality.lexical(d, y, F.col("doc_id"), F.col("text")).alias("w")).collect()}
    half = {r.doc_id: r.h for r in d.select("doc_id", quality._half(F.col("doc_id")).alias("h")).collect()}
    for i, t, _ in rows:
        for j, halves in enumerate(({0}, {1}, {0, 1})):
            own = [(set(x.split()), q) for k, x, q in rows if half[k] in halves]
            n = [sum(q == c for _, q in own) for c in (0, 1)]
            k = {w: [sum(q == c and w in x for x, q in own) for c in (0, 1)] for w in set(t.split())}
            want = np.mean([np.log((k[w][1] + 1) / (n[1] + 2)) - np.log((k[w][0] + 1) / (n[0] + 2)) for w in k])
            assert got[i][j] == pytest.approx(want, abs=1e-6)


def test_posteriors_equal_plain_arithmetic(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["ba", "ko", "lu"]) for _ in range(8)), f"h{min(i % 7, 2)}", f"p{i % 5}") for i in range(200)]
    y = {i: int(rng.random() < (0.9 if h == "h0" else 0.3)) for i, _, h, _ in rows if i % 3 == 0}
    d = spark.createDataFrame(rows, "doc_id bigint, text string, h string, p string")
    got = {r.doc_id: r for r in quality.score(d, spark.createDataFrame(list(y.items()), "doc_id bigint, quality int"), F.col("h"), F.col("p")).collect()}
    share = sum(y.values()) / len(y)
    own = {i: y[i] if i in y else 1 / (1 + np.exp(-(got[i].evidence + np.log(share / (1 - share))))) for i, *_ in rows}
    sites, hosts = {}, {}
    for i, _, h, p in rows:
        sites.setdefault((h, p), []).append(own[i])
        hosts.setdefault(h, []).append(own[i])

    def strength(groups):
        n, mean = np.mean([len(g) for g in groups]), sum(map(sum, groups)) / sum(map(len, groups))
        return mean, quality._beta(mean, np.var([np.mean(g) for g in groups]), n)

    mean, of_hosts = strength(list(hosts.values()))
    _, of_paths = strength(list(sites.values()))
    for i, _, h, p in rows:
        prior = (sum(hosts[h]) + of_hosts * mean) / (len(hosts[h]) + of_hosts)
        want = (sum(sites[h, p]) - own[i] + of_paths * prior) / (len(sites[h, p]) - 1 + of_paths)
        assert got[i].prior == pytest.approx(want, abs=1e-4)
        logit = np.log(want / (1 - want))
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(got[i].evidence + logit))), abs=1e-3)
