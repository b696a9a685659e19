"""The training-data operators on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skeinwork.llm import fingerprints, language, licences, media, neardup, packing, pieces, queries, sharding, substrings, toxicity
from skeinwork.llm.common import in_arrow

from ..oracle import SF, assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, told string"


def documents(spark, texts, ids=None):
    """Rows with extra columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, "k", "t") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sample():
    random.seed(4)
    words = ["the", "of", "Ärger", "señor", "x1", "don't", "漢字", "a"]
    texts = [None, "", " ", "\n\n", "one", "a  b\tc\x0bd", "é" * 50, "word " * 3000]
    texts += [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(25)]
    shared = " ".join(f"w{i}" for i in range(40))
    texts += [f"{i} start {shared} end {i}" for i in range(6)] + [texts[-1]] * 3
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, sample()).repartition(3)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_licences(spark):
    texts = [None, "Under the MIT License, under-the MIT license", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause\nmore", "CC BY-NC 4.0; Apache License, Version 2.0", "SPDX-License-Identifier: AND"]
    got = rows(licences.scan_licences(documents(spark, texts)))
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, 0, None, "", 0.0)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 0, 4, "mit")
    assert (got[2].base_labels, got[2].labels, got[2].score) == ("", "bsd,gpl-3,mit", 1.0)
    assert got[3].base_labels == "apache-2,cc-by-nc" and got[4].labels == ""


def test_licences_equal_a_word_search(spark, docs):
    got = rows(queries.op1_licences(spark, SF))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        at = [i for k in licences.BASE_PHRASES for i in range(len(words)) if words[i : i + len(k.split())] == k.split()]
        assert (got[r.doc_id].n_words, got[r.doc_id].n_base, got[r.doc_id].first_word, got[r.doc_id].last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        named = {label for k, label in licences.BASE_PHRASES.items() if any(words[i : i + len(k.split())] == k.split() for i in range(len(words)))}
        assert got[r.doc_id].base_labels == ",".join(sorted(named)) and named <= set(got[r.doc_id].labels.split(",")) and 0 <= got[r.doc_id].score <= 1


@pytest.mark.parametrize("text, order", [("mit or apache-2.0 and bsd", ["mit", "apache-2.0", "bsd", "and", "or"]), ("(mit or x) and y", ["mit", "x", "or", "y", "and"]), ("gpl with e or m", ["gpl", "e", "with", "m", "or"]), ("mit or", None), ("(mit", None), ("mit)", None), ("", None)])
def test_shunting_yard(text, order):
    assert licences.postfix(text) == order


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, entry.queries()[name], queries.ORACLE_SQL[name])


def test_sharding_counts_and_slots(spark, docs):
    got = rows(sharding.shard_documents(docs, 5, 8))
    by = {}
    for i, r in got.items():
        by.setdefault(r.shard, []).append(r.slot)
        text = (sample()[i] or "").encode()
        assert (r["size"], r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def fingerprint_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashed = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashed) * 2 > len(hashed)) if hashed else 0


def test_neardup_equals_all_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 3)  # both ways of linking
    got = rows(neardup.near_duplicates(docs))
    prints = {i: fingerprint_of(t) for i, t in enumerate(sample())}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r.fingerprint for i, r in got.items()}
    root = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            root[i] = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    assert root == {i: r.component_id for i, r in got.items()}


def test_links_of_a_crowd(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ (1 << i) for i in range(40)] + [base ^ (15 << k) for k in (3, 20, 50)] + [base ^ (31 << 10)]
    frame = spark.createDataFrame([(neardup.signed(p),) for p in prints], "fp long")
    for crowd in (2, 1000):
        monkeypatch.setattr(neardup, "CROWD", crowd)
        near = {neardup.signed(p): {neardup.signed(p)} for p in prints}
        for a, b in neardup.links(frame).collect():
            joined = near[a] | near[b]
            for x in joined:
                near[x] = joined
        assert len({frozenset(v) for v in near.values()}) == 1


def near_texts():
    """Texts with planted copies of a few changed words, two crowds among them, and a passage that many share."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, texts = " ".join(word() for _ in range(30)), []
    for n, copies in ((60, 12), (200, 12), (8, 3), (120, 1)) * 4:
        base = [word() for _ in range(n)]
        for _ in range(copies):
            new = list(base)
            for i in rng.sample(range(n), rng.randint(0, max(1, n // 40))):
                new[i] = word()
            texts.append(" ".join(new))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(5, 60)))}" for _ in range(30)]
    return [*texts, None, "", "one two", "One two", texts[0], texts[0]]


@pytest.mark.parametrize("crowd", [2, 32])
def test_near_copies_equal_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    texts = near_texts()
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = [fingerprint_of(t) for t in texts]
    bits = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    near = [[b for b in range(len(texts)) if bits(a, b) <= 4 or alike(a, b)] for a in range(len(texts))]
    assert any(bits(a, b) > 4 for a in range(len(texts)) for b in near[a])
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        root = [min(root[b] for b in near[a]) for a in range(len(texts))]
    got = rows(neardup.near_duplicates(documents(spark, texts).repartition(3)))
    assert root == [got[i].component_id for i in range(len(texts))]
    assert {r.doc_id for r in neardup.keep_one_of_each(documents(spark, texts)).collect()} == set(root)


def test_one_row_of_each_component_stays(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    found = neardup.keep_one_of_each(documents(spark, [one, one, None, two, two, one, one + " x", two], [3, 3, 9, None, None, None, 3, None]))
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in found.collect()) == [(0, "b"), (3, "a"), (9, "")]


def brute_repeats(texts, ids):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in zip(ids, words, strict=True):
        gone = {p + k for p in range(len(w) - 12) for k in range(13) if first[tuple(w[p : p + 13])] < i}
        out[i] = [x for p, x in enumerate(w) if p not in gone]
    return out


def test_substrings_equal_brute_force(spark, docs):
    got = rows(substrings.remove_repeats(docs))
    want = brute_repeats(sample(), range(len(sample())))
    assert {i: hashlib.sha256(" ".join(w).encode()).hexdigest() for i, w in want.items()} == {i: r.kept_sha256 for i, r in got.items()}
    kept = substrings.remove_repeats(docs, carry=True)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: " ".join(w) for i, w in want.items()}


def test_substrings_of_repetitive_rows(spark):
    rng = random.Random(9)
    for letters in ("a", "ab", "abc"):
        texts = [" ".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(30)]
        got = rows(substrings.remove_repeats(documents(spark, texts)))
        want = brute_repeats(texts, range(30))
        assert {i: r.n_removed for i, r in got.items()} == {i: len((texts[i]).split()) - len(w) for i, w in want.items()}


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    random_words = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for _ in range(400):
        shared = random_words(13)
        shared[1], shared[-1] = shared[0], shared[-2]  # doubled words at both edges
        rows = [np.concatenate([random_words(20), shared, random_words(20)]) for _ in range(4)]
        assert len({int(substrings.anchors(row, np.zeros(len(row), np.int64))[20]) for row in rows}) == 1


def test_substrings_are_the_same_in_chunks_of_any_size(spark, docs):
    want = rows(substrings.remove_repeats(docs))
    assert rows(substrings.remove_repeats(docs, chunk_bytes=20_000)) == want
    powers = substrings.Powers(5)
    powers.reach(1000)
    assert 1000 <= len(powers.up) < 2000


def test_substrings_with_doubled_edges(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for _ in range(150):
        inner = [word() for _ in range(11)]
        shared = [inner[0], *inner, inner[-1]]
        texts += [" ".join([word() for _ in range(15)] + shared + [word() for _ in range(15)]) for _ in range(2)]
    got = rows(substrings.remove_repeats(documents(spark, texts)))
    want = brute_repeats(texts, range(len(texts)))
    assert {i: r.n_removed for i, r in got.items()} == {i: len(texts[i].split()) - len(w) for i, w in want.items()}


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(pieces.encode_pieces(docs, path, with_ids=True))
    for i, t in enumerate(sample()):
        ids = library.encode(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_packing_holds_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library, at, used = Tokenizer.from_file(path), {}, {}
    found = packing.pack_documents(docs, path).collect()
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        ids = library.encode(sample()[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
    assert len(at) == len(sample())
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in used.values())


def test_media_round_trip(spark, docs):
    got = rows(media.store_media(docs, with_media=True))
    for i, t in enumerate(sample()):
        payload = media.padded((t or "").encode())
        image = media.Image(got[i].media)
        assert image.payload() == payload and got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert len(got[i].tensor) == image.height * image.width * 3 and got[i].tail_crc32 == zlib.crc32(payload[-32:])


def test_media_slow_scans_equal_fast_ones():
    class Slow(media.Image):
        def read_scan(self, body, bits):
            low, up, approx = body[1 + 2 * body[0] :]
            if low == 0:
                return super().read_scan(body, bits)
            own, codes = self.coefficients[body[1] - 1][:, low : up + 1], self.tables[0x10 | body[2] & 15]
            (self.refine if approx >> 4 else self.spread)(media.Bits(bits), codes, own, approx & 15)

    data = media.encode(random.Random(1).randbytes(576 * 4))
    assert all((a == b).all() for a, b in zip(Slow(data).coefficients, media.Image(data).coefficients, strict=True))


CONTRACTS = {
    "op1_licences": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_neardup": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op5_pieces": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_first_columns_are_the_contract(spark, name):
    got = queries.QUERIES[name](spark, SF)
    want = CONTRACTS[name].split(", ")
    assert [f"{c} {t}" for c, t in got.dtypes][: len(want)] == want and "text" not in got.columns


def test_keys_leave_full_shards_only(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = sharding.shard_documents(got.dropDuplicates(["doc_id"])).toPandas()
    loads, bound = got.groupby("home_shard").size(), len(got) / sharding.SHARDS
    least = sum(max(0, n - int(bound) - 1) for n in loads), sum(max(0, n - int(bound)) for n in loads)
    assert least[0] <= (got.home_shard != got.shard).sum() <= least[1]


def test_long_lines_and_runs_take_linear_time(spark):
    import time

    took = []
    for n in (20_000, 200_000):
        texts = ["SPDX-License-Identifier: " + "mit or " * n, "under the mit license " * n, "a" + " " * n + "b", "spdx-license-identifier: " * n]
        begun = time.time()
        rows(licences.scan_licences(documents(spark, texts)))
        rows(pieces.encode_pieces(documents(spark, texts[2:3]), queries.tokenizer_path("piece_bpe_32k.model")))
        took.append(time.time() - begun)
    assert took[1] < 30 * max(1.0, took[0])


def test_runs_of_spaces_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" " * k + "x" + " " * (2 * k) + "yz" + " " * k for k in (1, 2, 3, 5, 17, 64, 1000)]
    got = rows(pieces.encode_pieces(documents(spark, texts), path, with_ids=True))
    assert all(np.frombuffer(got[i].ids, "<u4").tolist() == library.encode(t) for i, t in enumerate(texts))


def test_tensor_equals_the_formulas():
    """The coefficients, transformed by the definition's double sum and coloured point by point."""
    image = media.Image(media.encode(random.Random(3).randbytes(576 * 2)))
    scan = sorted(((x + y, (y if (x + y) % 2 else x), y, x) for y in range(8) for x in range(8)))
    norm = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    planes = []
    for own, (high, wide) in zip(image.coefficients, image.grid, strict=True):
        plane = np.zeros((high * 8, wide * 8))
        for b, block in enumerate(own):
            for y in range(8):
                for x in range(8):
                    total = sum(c * norm(u) * norm(v) * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) / 4 for (_, _, u, v), c in zip(scan, block.tolist(), strict=True) if c)
                    plane[b // wide * 8 + y, b % wide * 8 + x] = np.clip(np.rint(total) + 128, 0, 255)
        planes.append(plane)
    y, cb, cr = planes[0], planes[1].repeat(2, 0).repeat(2, 1) - 128, planes[2].repeat(2, 0).repeat(2, 1) - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2).clip(0, 255)
    far = np.abs(image.rgb(media.inverse_transform()).astype(float) - want)
    assert far.max() <= 2.5 and (far <= 1).mean() > 0.95  # the transform is rounded to 1/4096, so that sums are exact


def test_many_paragraphs_take_seconds(spark):
    import time

    texts = ["\n".join(f"line {i} of {k}" for i in range(2000)) for k in range(2)]
    begun = time.time()
    got = rows(fingerprints.fingerprint_documents(documents(spark, texts)))
    assert time.time() - begun < 60 and got[0].near_next == 0.0


def test_repeated_and_null_ids(spark):
    """No operator drops or merges rows over their ids; removal of windows follows the ids."""
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [passage, f"{passage} end", passage, "other words", None, passage, passage]
    docs = documents(spark, texts, [5, 5, 7, 7, 7, None, None])
    labels = spark.createDataFrame([(5, 0), (7, 1)], "doc_id long, toxic int")
    for run in (licences.scan_licences, sharding.shard_documents, lambda d: neardup.near_duplicates(d, similar=False), substrings.remove_repeats, media.store_media, fingerprints.fingerprint_documents, language.identify_language, lambda d: toxicity.score_toxicity(d, labels)):
        assert run(docs).count() == len(texts)
    packed = packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json")).toPandas()
    assert len(packed[packed.start == 0]) == len(texts)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert got == [(0, 20, 0), (0, 20, 0), (5, 20, 0), (5, 21, 0), (7, 0, 0), (7, 2, 0), (7, 20, 20)]


def test_clashing_names_of_carried_columns(spark):
    docs = documents(spark, sample()[-8:] + [None]).selectExpr("*", "1 as _score", "'z' as _lang_pred", "2 as __score", "3 as _sid", "4 as _key", "5 as _place", "6 as x", "7 as gone")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    for run in (language.keep_identified, lambda d: toxicity.keep_clean(d, labels), neardup.keep_one_of_each, lambda d: substrings.remove_repeats(d, carry=True)):
        found = run(docs)
        assert found.columns == docs.columns and found.select("_score", "gone", "x").distinct().count() <= 1


def test_labels_and_ids_of_any_size(spark):
    big = (1 << 63) - 1
    docs = documents(spark, [f"good words {i}" if i % 2 else f"bad words {i}" for i in range(60)] + ["", None], [big - i for i in range(62)])
    labels = spark.createDataFrame([(big - i, (i + 1) % 2 * 7 if i < 50 else None) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).toPandas()
    assert got.score.between(0, 1).all() and got.score.notna().all()


def test_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op10_language(spark, sf).join(known.select("doc_id", "lang"), "doc_id").where(language.fold(4) == 2).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95
    scored = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert scored.score.between(0, 1).all()
    hit = ((scored.predicted == 1) & (scored.toxic == 1)).sum()
    assert hit >= 0.6 * (scored.toxic == 1).sum() and hit >= 0.6 * (scored.predicted == 1).sum()


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    both = rng.random((600, 2)) < 0.5
    bags = [np.sort(np.array([k for k in (1, 2) if b[k - 1]] + [3], np.uint64)) for b in both]
    machine = toxicity.fit(bags, (both[:, 0] & both[:, 1]).astype(float))
    score = [machine.margin(machine.active(np.array(x, np.uint64))) for x in ([1, 3], [2, 3], [1, 2, 3])]
    assert score[2] > 0 > max(score[:2])


def test_language_of_textless_rows(spark):
    got = rows(language.identify_language(documents(spark, [None, "", "12 34", "hello there", "漢字"])))
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[3].lang_pred == "en"


def test_languages_are_not_forgotten(spark):
    many = spark.createDataFrame([(i, f"text {i}", f"l{i % 70}") for i in range(700)], "doc_id long, text string, lang string")
    model = language.learn(language.training_sample(many))
    assert len(model[0]) == 70 and len(model[1]) == 2
    apart = {f"l{i:02d}": [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("lo", "mi", "nu")) * 3] for i in range(70)}
    model, table = language.learn(apart), language.letter_table()
    assert [language.decide(language.letters(v[0], table), *model)[0] for v in apart.values()] == list(apart)
    long = spark.createDataFrame([(i, ("alpha " if i % 2 else "beta ") * (5000 if i % 2 else 5), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    assert set(language.training_sample(long)) == {"a", "b"}


def test_fingerprints_of_edge_cases(spark):
    got = rows(fingerprints.fingerprint_documents(documents(spark, [None, "", "a\nb\nc\nd", "a\nb\nc\nd", "x"], [5, 1, 2, 3, None])))
    assert got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1.0 and got[5].n_chars == 0
    lone = rows(fingerprints.fingerprint_documents(documents(spark, ["a\nb"])))
    assert lone[0].near_next == 1.0


@pytest.mark.parametrize("run", [licences.scan_licences, sharding.shard_documents, neardup.near_duplicates, substrings.remove_repeats, media.store_media, fingerprints.fingerprint_documents, language.identify_language, lambda d: toxicity.score_toxicity(d, d.selectExpr("doc_id", "1 as toxic")), lambda d: packing.pack_documents(d, queries.tokenizer_path("word_bpe_49k.json")), lambda d: pieces.encode_pieces(d, queries.tokenizer_path("piece_bpe_32k.model"))])
def test_empty_tables(spark, run):
    assert run(documents(spark, [])).count() == 0


def test_parities_leave_similar_sets_and_tell_others():
    rng = np.random.default_rng(5)
    for n in (1, 5, 63, 64, 65, 300, 2_000, 20_000):
        base, other = (np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n)) for _ in range(2))
        for lost in (0, n // 18, n // 9, n // 5):  # sets of other sizes, and marks of other lengths
            near = np.unique(np.concatenate([base[lost:], other[: n // 20]]))
            if neardup.similar(base.tobytes(), near.tobytes()):
                assert neardup.may_be_similar(neardup.parity(base), neardup.parity(near))
        # long texts that share a few shingles: their whole sets needn't be sent
        if n >= 2_000:
            other = np.unique(np.concatenate([base[:20], other]))
            assert not neardup.may_be_similar(neardup.parity(base), neardup.parity(other))
            assert len(neardup.parity(base)) * 20 < base.nbytes


def test_workers_forget_what_other_operators_kept(spark, docs):
    packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json")).count()

    def held(batches):
        import sys

        store = sys.modules.get("_worker_store")
        names = [k for k in (vars(store) if store else ()) if not k.startswith("__")]
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"kept": names})

    assert in_arrow(spark.range(0, 40, 1, 4), held, "kept string").count() == 0


def test_substrings_of_documents_with_and_without_repeats_in_one_chunk(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [f"a b {passage} c", None, "  lone\twords \n here ", f"{passage}  d", "", " ".join(f"q{i}" for i in range(30)), f" x {passage}"]
    got = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, texts).coalesce(1), carry=True).collect()}
    assert [got[i].text for i in range(7)] == [texts[0], "", "lone words here", "d", "", texts[5], "x"]
    got = rows(substrings.remove_repeats(documents(spark, texts).coalesce(1)))
    assert [(got[i].n_words, got[i].n_removed) for i in range(7)] == [(23, 0), (0, 0), (3, 0), (21, 20), (0, 0), (30, 0), (21, 20)]


def test_packing_looks_at_words_of_ascii_letters_once(monkeypatch):
    with open(queries.tokenizer_path("word_bpe_49k.json")) as file:
        words = packing.Words(file.read())

    class Looked:
        def search(self, text):
            assert not (text.isascii() and text.isalpha())
            return original.search(text)

    original = packing.UNSPLIT
    monkeypatch.setattr(packing, "UNSPLIT", Looked())
    texts = ["thoninea, ofanth it's 12ab", "ofanth <|endoftext|> \u00fcber na\u00efve I\u0307", "", "Ofanth <|x"]
    for text, ids in zip(texts, words.look_up(pa.array(texts)), strict=True):
        assert ids.tolist() == words.library.encode(text, add_special_tokens=False).ids


def test_pieces_of_words_that_several_texts_share():
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.Vocabulary(path))
    made, make = [], encoder.words.make
    encoder.words.make = lambda w: made.append(w) or make(w)
    texts = ["one two, one", "", "two, one ", " one", "a  b", "\u2581one", "\u00e9t\u00e9\nx \U0001f600", " ", "w" * 100 + " one", "w" * 100]
    for text, line, raw in zip(texts, *encoder.encode(texts), strict=True):
        ids = library.encode(text)
        assert line == ",".join(map(str, ids)) and pieces.decoded(raw) == library.decode(ids)
    assert len(made) == len(set(made))  # also of words too long to be kept


def test_samples_stay_bounded_without_ids(spark):
    ids = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert len(language.training_sample(ids)["en"]) < 1.2 * language.SAMPLE_TEXTS
    assert len(language.training_sample(ids.withColumn("text", F.lit("the same text")))["en"]) <= language.SHORTEST
    long = spark.range(60).select("id", F.repeat(F.lit("word "), 9000).alias("text"), F.lit("xx").alias("lang")).withColumnRenamed("id", "doc_id")
    assert [len(t) for t in language.training_sample(long)["xx"]] == [language.SAMPLE_CHARS] * language.SHORTEST
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    many = ids.drop("doc_id").withColumn("doc_id", F.lit(1).cast("long")).unionByName(spark.createDataFrame([("fine words", "en", 2)], "text string, lang string, doc_id long"))
    bags, toxic = toxicity.training_sample(many, labels)
    assert len(bags) < 1.2 * toxicity.SAMPLE_TOXIC and toxic.sum() == len(bags) - 1
    assert len(toxicity.training_sample(many.withColumn("text", F.col("lang")), labels)[0]) == 2


def test_margin_is_a_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(np.sort(rng.integers(1, 1 << 60, 40).astype(np.uint64)), -0.7)
    machine.weights, machine.vectors = rng.normal(size=40), rng.normal(size=(40, toxicity.RANK))
    for n in (0, 1, 2, 9):
        at = np.sort(rng.choice(40, n, replace=False))
        pairs = sum(float(machine.vectors[i] @ machine.vectors[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert machine.margin(at) == pytest.approx(machine.bias + machine.weights[at].sum() + pairs)
    assert machine.active(np.array([0, int(machine.keys[3]), 1 << 61], np.uint64)).tolist() == [3]


def test_fit_learns_a_pair_that_no_weight_tells():
    """Of two terms each alone is clean and both together toxic: the pair's weight tells."""
    import xxhash

    bag = lambda *words: np.unique(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
    rng = random.Random(1)
    rows = [(bag(*w, *(str(rng.randrange(30)) for _ in range(4))), float(len(w) == 2)) for w in [("a",), ("b",), ("a", "b"), ()] * 150]
    machine = toxicity.fit([b for b, _ in rows], np.array([y for _, y in rows]))
    said = [float(machine.margin(machine.active(b)) > 0) for b, _ in rows]
    assert said == [y for _, y in rows]


def test_language_decision_equals_plain_sets():
    """Filters give what sets of n-grams give, but for false positives, whose rate is taken off."""
    rng, table = random.Random(5), language.letter_table()
    syllables = {x: ["".join(rng.choices("abcdefghij", k=3)) for _ in range(12)] for x in "pqrs"}
    texts = {x: [" ".join("".join(rng.choices(s, k=2)) for _ in range(30)) for _ in range(30)] for x, s in syllables.items()}
    model, grams = language.learn(texts), lambda t: language.ngrams(language.letters(t, table))
    counts = {x: dict(zip(*np.unique(np.concatenate([grams(t) for t in v]), return_counts=True), strict=True)) for x, v in texts.items()}
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    own = {x: {g for g, n in c.items() if n >= language.LEAST_SEEN and rate[x][g] >= language.LEAST_RATE * max(r.get(g, 0) for r in rate.values())} for x, c in counts.items()}
    for x, s in syllables.items():
        for _ in range(20):
            t = " ".join("".join(rng.choices(s if rng.random() < 0.7 else syllables["p"], k=2)) for _ in range(12))
            hits = {y: sum(g in own[y] for g in grams(t).tolist()) for y in own}
            said, score = language.decide(language.letters(t, table), *model)
            best = max(hits.values())
            assert hits[said] >= best - 2 and abs(score - hits[said] / sum(hits.values())) < 0.05
    tied = language.learn({"b": ["same words here now"] * 5, "a": ["same words here now"] * 5})
    assert language.decide(language.letters("same words", table), *tied)[0] == "a"


def test_rows_with_maps_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, {"a": 1}, [1]), (1, text, {"a": 2}, [2]), (2, text, None, None), (3, "other", {}, [])]
    kept = neardup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>, list array<int>")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and len(kept) == 2


def test_word_cache_stays_in_its_bounds():
    from pathlib import Path

    vocabulary = Path(queries.tokenizer_path("word_bpe_49k.json")).read_text()
    cache, fresh = packing.Words(vocabulary, 30_000), lambda: packing.Words(vocabulary)
    rng = random.Random(9)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdeé1'", k=rng.randint(1, 9))) for _ in range(60))
        assert (cache.look_up(pa.array([text]))[0] == fresh().look_up(pa.array([text]))[0]).all()
        size = lambda d: sum(packing.ENTRY + len(k) + len(v) for k, v in d.items())
        assert cache.held == size(cache) and size(cache.old) < 60_000 and size(cache.runs) < 60_000


def test_peeling_recovers_the_paragraphs(spark):
    """Both lists of digests are those of plain sets, for few and for many differing paragraphs."""
    rng = random.Random(12)
    texts = []
    for n, changed in ((0, 0), (5, 0), (5, 2), (40, 3), (300, 90), (900, 900), (1, 1)):
        old = [f"p{rng.randrange(10**9)}" for _ in range(n)]
        new = [x for x in old[changed // 2 :]] + [f"q{rng.randrange(10**9)}" for _ in range(changed - changed // 2)]
        texts.append(("\n".join(old), "\n".join(new + new[:3])))
    texts += [(None, "a\n\nb"), ("a", None), ("a\na", "a")]
    pairs = spark.createDataFrame([(i, *t, "x", 1) for i, t in enumerate(texts)], "id long, old string, new string, added string, n int")
    got = {r.id: r for r in fingerprints.changes(pairs, "old", "new").collect()}
    of = lambda t: {fingerprints.digest_of(p) for p in (t or "").split("\n") if p}
    for i, (old, new) in enumerate(texts):
        assert (got[i].removed, got[i].added) == (sorted(of(old) - of(new)), sorted(of(new) - of(old)))
    docs = documents(spark, ["a\nb", "b\nc", None])
    found = rows(fingerprints.document_changes(docs))
    assert found[0].next_removed == [fingerprints.digest_of("a")] and found[0].next_added == [fingerprints.digest_of("c")] and found[2].next_removed == []
