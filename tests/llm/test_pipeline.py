"""The pipeline's stages against plain models of what they should do, on rows with edges."""

import random

import corpus_pipeline
from skeinwork.llm import language

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted(seed):
    """Texts, and which of them are near copies (a few words changed) of an earlier one."""
    rng, texts, copies = random.Random(seed), [], set()
    for _ in range(40):
        base = words(rng, rng.randint(60, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            new = list(base)
            for i in rng.sample(range(len(new)), rng.randint(0, 2)):
                new[i] = words(rng, 1)[0]
            if len(shingles(texts[-1]) & shingles(" ".join(new))) * 5 >= 4 * len(shingles(texts[-1]) | shingles(" ".join(new))):
                copies.add(len(texts))
            texts.append(" ".join(new))
    return texts, copies


def test_near_copies_go_and_others_stay(spark):
    texts, copies = planted(2)
    kept = {r.doc_id for r in stage("near_duplicates")(spark, frame(spark, texts), SF).collect()}
    assert len(copies) > 20 and not kept & copies  # recall 1
    alike = lambda i, j: 5 * len(shingles(texts[i]) & shingles(texts[j])) >= 4 * len(shingles(texts[i]) | shingles(texts[j]))
    assert all(any(alike(i, j) for j in kept) for i in set(range(len(texts))) - kept)


def test_language_stage_keeps_what_has_letters(spark):
    texts = ["hello there", None, "", "12 34", "...", "x", "Señor 漢字"]
    kept = stage("language")(spark, frame(spark, texts), SF)
    assert {r.doc_id for r in kept.collect()} == {0, 5, 6}


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in stage("toxicity")(spark, docs, sf).select("doc_id").collect()}
    toxic = {True: set(), False: set()}
    for r in labels.collect():
        toxic[r.toxic == 1].add(r.doc_id)
    assert len(toxic[True] - kept) >= 0.7 * len(toxic[True]) and len(toxic[False] & kept) >= 0.97 * len(toxic[False])


def test_passages_go_from_later_documents(spark):
    rng = random.Random(4)
    passage = " ".join(words(rng, 60))
    texts = [f"{' '.join(words(rng, 20))} {passage} {' '.join(words(rng, 20))}" for _ in range(5)] + [None, ""]
    got = {r.doc_id: r for r in stage("substrings")(spark, frame(spark, texts), SF).collect()}
    assert passage in got[0].text and all(passage not in got[i].text and len(got[i].text.split()) == 40 for i in range(1, 5))
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_whole_pipeline_on_edge_rows(spark, tmp_path):
    texts, _ = planted(3)
    docs = frame(spark, [*texts[:20], *texts[:3], None, "", " ", "a" * 100_000, "word " * 30_000], [*range(20), 3, 3, None, None, 50, 51, 52, 53]).selectExpr("*", "1 as _score", "'t' as told")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, docs, str(tmp_path)).columns == docs.columns, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all() and {52, 53} <= set(packed.doc_id)


def test_whole_pipeline_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, run in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(run(spark, docs, SF), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert language.identify_language(docs).where("lang_pred = 'und'").count() == 0
