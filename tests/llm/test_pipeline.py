"""The pipeline's stages and their chain against plain code, and what else of the operators SQL cannot say."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from ringledger.llm import decontaminate, quality, sentencepiece_codec, token_counts
from tests.llm.test_operators import LOWER, shingles, smallest_reachable

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, selected long, p_top string"
MORE = ("en", "web", 5, 7, "kept")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables: good, junk and toxic documents, exact and near copies, benchmark passages, null, empty and very long texts, null and repeated ids, clashing names."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(90)]
    junk = [" ".join(r.choice(["$$", "##", "@@!", "%%"]) + word().upper() for _ in range(80)) for _ in range(60)]
    toxic = [" ".join(r.choice([word(), "vileword", "awfulword"]) for _ in range(80)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate([*good, *junk, *toxic])]
    labels = [(k, int(k < 90 or k >= 150), int(k >= 150)) for k in range(0, 210, 2)]
    items = [(k, " ".join(f"item{k}x{j}" for j in range(12))) for k in range(3)]
    extra = [(1000, good[0]), (1001, good[0]), (1002, good[1].replace(good[1].split()[40], "changed")), (1003, f"{good[2]} {items[0][1]} {good[3]}"), (1004, items[1][1] + " and some more"), (None, good[4] + " null id"), (None, good[5] + " null too"), (7, good[6] + " same id"), (1005, None), (1006, ""), (1007, " ".join(good * 6))]
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, t, *MORE) for k, t in rows + extra], COLUMNS).repartition(3).write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(base / "benchmark.parquet"))
    return str(base)


def pairs(df) -> list:
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.good(spark, docs, folder)
    assert kept.schema == docs.schema
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet").withColumn("grade", quality.grade()))
    slots, expected = quality.TokenSlots(), []
    for k, t in pairs(docs):
        found = quality.features(t, slots)
        score = float(sum(float(model.weights[s]) * float(v) for s, v in zip(*found, strict=True)))
        if 1 / (1 + np.exp(model.thresholds[-1] - score)) >= quality.MIN_TAIL:
            expected.append((k, t))
    assert pairs(kept) == expected
    ids = {k for k, _ in expected if k is not None}
    assert set(range(90)) <= ids and not ids & set(range(90, 210))
    assert all(tuple(r)[2:] == MORE for r in kept.collect())


def test_distinct_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = pairs(docs)
    sets = {n: shingles(t) for n, (_, t) in enumerate(rows)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    groups: dict[int, list] = {}
    for n, root in smallest_reachable(list(sets), links).items():
        groups.setdefault(root, []).append(rows[n])
    kept = pairs(corpus_pipeline.distinct(spark, docs, folder))
    assert len(kept) == len(groups)
    for members in groups.values():
        ids = [k for k, _ in members if k is not None]
        one = [x for x in members if x in kept]
        assert one and (not ids or one[0][0] == min(ids))


def test_decontaminated_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(f"item{k}x{j}" for j in range(i, i + 10)) for k in range(3) for i in range(3)}
    expected = []
    for k, t in pairs(docs):
        found = list(word.finditer((t or "").translate(LOWER)))
        words = [m.group() for m in found]
        hit = {i + j for i in range(len(words) - 9) if tuple(words[i : i + 10]) in windows for j in range(10)}
        if len(hit) > len(words) / 2:
            continue
        if hit:  # one run here: the text before it and that behind it, trimmed at the cut
            before, after = t[: found[min(hit)].start()].rstrip(), t[found[max(hit) + 1].start() :]
            t = f"{before}\n{after}"
        expected.append((k, t))
    kept = corpus_pipeline.decontaminated(spark, docs, folder)
    assert pairs(kept) == sorted(expected, key=str) and len(expected) == docs.count() - 1
    assert {r["n_chars"] for r in kept.where("doc_id = 1003").collect()} == {len(dict(expected)[1003])}


def test_encoded_stage_and_offsets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tool = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {}
    for k, t in pairs(docs):
        texts.setdefault(k, []).append(t)
    for r in corpus_pipeline.encoded(spark, docs, folder).collect():
        assert list(r["ids"]) in [tool.encode(t or "") for t in texts[r["doc_id"]]] and r["n_tokens"] == len(r["ids"])


def test_offsets_equal_the_library(spark):
    """Where the text is normal already, every id's bytes are those of the library's pieces; else spans join up and cover what ids stand for."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(0, "a few plain words of text"), (1, "größer und älter 🙂 é"), (2, "ﬁne ① x"), (3, "  two   spaces "), (4, ""), (5, None)]
    for r in sentencepiece_codec.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect():
        text = (dict(rows)[r["doc_id"]] or "").encode()
        spans = list(zip(r["starts"], r["ends"], strict=True))
        assert all(a[1] <= b[0] or a == b or a[1] == b[1] for a, b in zip(spans, spans[1:], strict=False))
        if r["doc_id"] < 2:
            proto = tool.encode(text.decode(), return_type="proto")
            assert spans == [(p.begin, p.end) for p in proto.pieces]  # in bytes
        assert text[min((a for a, _ in spans), default=0) : max((b for _, b in spans), default=0)].strip() == text.strip()


def test_run_chains_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], list(r["ids"]))
    expected, found = sorted(map(key, docs.collect())), sorted(map(key, corpus_pipeline.run(spark, folder).collect()))
    assert found == expected and len(found) > 80


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_token_counts_equal_a_loop_over_characters(spark):
    r = random.Random(4)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["".join(r.choice(["a", "word", " the", "\n", " ", "é", "🙂", "12"]) for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, "", "x" * 20_000]
    rows = []
    for k, t in enumerate(texts):
        cuts = sorted(r.sample(range(len(t or "") + 1), min(4, len(t or "") + 1)))
        rows.append((k, t, [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=False)], "clash"))
    df = spark.createDataFrame(rows, "doc_id int, text string, parts array<struct<start:int,end:int>>, sections string")
    tool = token_counts.encoder(path, pattern)
    for rule in token_counts.RULES:
        found = {x["doc_id"]: x for x in token_counts.count_tokens(df, path, pattern, sections_col="parts", rule=rule).collect()}
        for k, t, sections, _ in rows:
            _, starts, ends = tool.character_spans(t or "")
            counts, outside = [0] * len(sections), 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                chars = range(a, b) if b > a else [max(a - 1, 0)]
                votes = [sum(low <= c < high for c in chars) for low, high in sections]
                if rule == "start":
                    owner = next((n for n, (low, high) in enumerate(sections) if low <= chars[0] < high), None)
                else:
                    free = len(chars) - sum(votes)
                    owner = votes.index(max(votes)) if votes and max(votes) >= max(free, 1) else None
                if owner is None:
                    outside += 1
                else:
                    counts[owner] += 1
            assert (list(found[k]["section_tokens"]), found[k]["outside_tokens"], found[k]["n_tokens"]) == (counts, outside, len(starts))
    assert token_counts.count_tokens(df.limit(0), path, pattern).collect() == []


def test_quality_fit_follows_the_slope():
    """At the fitted point of a small ridge-only problem, no small step along any axis of the thresholds or weights lowers the loss by much."""
    r = np.random.default_rng(3)
    rows, grades = [], []
    for _ in range(240):
        g = int(r.integers(0, 3))
        slots = np.unique(np.concatenate([r.integers(0, 12, 4), [20 + g]])).astype(np.int32)
        rows.append((slots, np.ones(len(slots), np.float32)))
        grades.append(g if r.random() < 0.8 else int(r.integers(0, 3)))
    grades = np.array(grades)
    model = quality.fit(rows, grades, np.ones(240), lasso=0.0)

    def loss(weights, thresholds):
        f = np.array([weights[s] @ v for s, v in rows])
        tail = np.concatenate([np.ones((240, 1)), 1 / (1 + np.exp(thresholds - f[:, None])), np.zeros((240, 1))], axis=1)
        return -np.log(tail[np.arange(240), grades] - tail[np.arange(240), grades + 1]).mean() + quality.RIDGE / 2 * (weights**2).sum()

    best = loss(model.weights.astype(float), model.thresholds)
    for k in range(24):
        for step in (-0.05, 0.05):
            w = model.weights.astype(float)
            w[k] += step
            assert loss(w, model.thresholds) > best - 2e-3
    for k in range(2):
        for step in (-0.05, 0.05):
            t = model.thresholds.copy()
            t[k] += step
            assert loss(model.weights.astype(float), t) > best - 2e-3


def test_quality_ignores_grades_out_of_range(spark):
    docs = spark.createDataFrame([(k, f"word{k % 3} text", "x") for k in range(30)], "doc_id long, text string, selected string")
    rated = spark.createDataFrame([(k, g) for k in range(30) for g in [[0, 1, 2, 3, -1, None][k % 6]]], "doc_id long, grade int")
    model = quality.train(docs, rated)
    assert len(model.thresholds) == 2
    names = ("a", "b", "c")
    assert {r["selected"] for r in quality.rate_documents(docs, model, names=names).collect()} == {"x"}
    assert quality.rate_documents(docs.limit(0), model).collect() == []


def test_cut_words_at_both_ends():
    hit = np.array([True, True, False, True])
    assert decontaminate.cut_words("a b, c d.", hit) == "c"
    assert decontaminate.cut_words("a b", np.array([False, False])) == "a b"
