import random

import pytest

import corpus_pipeline as P
from quillgraph.llm import queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    return " ".join("".join(rng.choice("ba ko lu mi sen tar".split()) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted cases, by kind."""
    rng = random.Random(21)
    at = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, prose(rng, 40)) for i in range(5)]
    kinds, texts = {}, []

    def plant(kind, text):
        kinds.setdefault(kind, []).append(len(texts))
        texts.append(text)

    for _ in range(900):
        words = prose(rng, rng.randrange(30, 120)).split()
        if rng.random() < 0.15:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumpfish", "vexling", "snortle"]))
            plant("toxic", " ".join(words))
        else:
            plant("clean", " ".join(words))
    base = prose(rng, 500)
    for _ in range(5):
        plant("copies", base)
    for k in range(5):
        w = base.split()
        w[50 * k] = "other"
        plant("copies", " ".join(w))
    for _, t in items:
        plant("leaks", f"{prose(rng, 30)} {t.upper()} {prose(rng, 20)}")
        w = t.split()
        plant("leaks", f"{prose(rng, 30)} {' '.join(w[20:] + ['x'] + w[:20])}")
    plant("secrets", prose(rng, 40) + " password=correcthorse1 " + prose(rng, 5))
    docs = [(i, t, "aa", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(9000, None, None, None, None), (9001, "", "aa", "s0", 0)]
    labels = [(i, 1, int(i in kinds["toxic"])) for i in kinds["toxic"] + kinds["clean"]]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, kinds, {d[0]: d[1] for d in docs}


def test_each_stage_does_its_part(spark, corpus):
    at, kinds, texts = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = [set(texts)]
    frames = []
    for n, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, at)
        docs.write.parquet(out := f"{at}/stage{n}.parquet")
        docs = spark.read.parquet(out)
        frames.append(docs)
        assert docs.columns == COLUMNS + ["taken"] * (n == 4)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    gone = [a - b for a, b in zip(kept, kept[1:], strict=False)]
    # Held against the classifier that the stage must follow, and that against the truth.
    source = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fit(source, toxicity.training_labels(spark.read.parquet(f"{at}/labels.parquet")))
    assert gone[0] == {i for i, t in texts.items() if model.score(t) >= 0.5}
    assert len(gone[0] ^ set(kinds["toxic"])) < 10
    copies = set(kinds["copies"]) - gone[0]
    assert copies - gone[1] == {min(copies)} and gone[1] <= copies | {9000, 9001}
    assert gone[2] == set(kinds["leaks"]) - gone[0] - gone[1]
    assert gone[3] == set()
    masked = {r.doc_id: r for r in frames[3].collect()}
    (i,) = kinds["secrets"]
    assert masked[i].text == texts[i].replace("password=correcthorse1", "<secret>") and masked[i].n_chars == len(masked[i].text)
    assert all(r.text == texts[j] for j, r in masked.items() if j != i)
    mixed = frames[4].collect()
    assert all(0 < r.taken <= 2 * len((r.text or "").split()) for r in mixed)
    total = sum(len((r.text or "").split()) for r in masked.values())
    assert abs(sum(r.taken for r in mixed) - 1.5 * total) < 10
    ran = sorted((r.doc_id, r.taken) for r in P.run(spark, at).collect())
    assert ran == sorted((r.doc_id, r.taken) for r in mixed)


def test_names_of_the_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
