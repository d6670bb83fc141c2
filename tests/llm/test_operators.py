"""Operators of the training-data side against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions

from ringledger.llm import decontaminate, embedding_join, html_extract, jaccard_join, lm_scoring, quality, sentencepiece_codec, sharding, token_counts, url_filter

DOCS = "doc_id long, text string, source string, items int"
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed: int = 3, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(80)]
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]
    for k in range(0, n, 5):  # near copies
        parts = made[k].split()
        parts[len(parts) // 2] = "CHANGED"
        made.append(" ".join(parts))
    made += [made[0]] * 7 + [None, "", " \t\n", "one", "Two words", " ".join(r.choice(words) for _ in range(9000))]
    return [(k, t, "x", 1) for k, t in enumerate(made)]


def shingles(text: str | None) -> frozenset:
    w = SPACE_WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def smallest_reachable(ids: list, linked) -> dict:
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_jaccard_join(spark):
    rows = texts()
    sets = {k: shingles(t) for k, t, *_ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    reach, degree = smallest_reachable(list(sets), pairs), Counter(x for p in pairs for x in p)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {k: (len(sets[k]), reach[k], degree[k]) for k in sets}
    assert not jaccard_join.jaccard_join(spark.createDataFrame([], DOCS)).collect()


def test_jaccard_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    near = a.replace("a39", "z")
    rows = [(None, a), (None, near), (5, b), (5, c), (7, b), (None, c + " more"), (None, None), (8, ""), (9, "alone here"), (9, "alone here")]
    docs = spark.createDataFrame([(k, t, "x", n) for n, (k, t) in enumerate(rows)], DOCS)
    found = Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect())
    assert found == Counter([(None, None, 1)] * 2 + [(5, 5, 1)] * 2 + [(7, 5, 1), (None, 5, 1), (None, None, 0), (8, 8, 0)] + [(9, 9, 1)] * 2)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs).collect()]
    assert len(kept) == 6 and {(5, b), (5, c), (None, None), (8, ""), (9, "alone here")} < set(kept)
    assert ((None, a) in kept) != ((None, near) in kept)


def test_jaccard_tiles_of_one_large_cluster(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:-1], f"v{k}"]), "x", 1) for k in range(130)]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS), tile=20).collect()
    assert {(r["component_id"], r["n_links"]) for r in found} == {(0, 129)}


def test_embedding_join(spark):
    r = np.random.default_rng(4)
    rows, schema = [], "vec_id long, embedding array<float>, label string, component_id string"
    for k in range(40):
        v = r.normal(size=12)
        rows += [(3 * k + j, [float(x) for x in v + j * 0.1 * r.normal(size=12)], "ab"[k % 2], "x") for j in range(3)]
    for k in range(20):  # other lengths, one of them shorter than the axes
        v = r.normal(size=(3, 15)[k % 2])
        rows += [(500 + 2 * k + j, [float(x) for x in v + j * 0.1], "a", "x") for j in range(2)]
    rows += [(1000 + k, rows[0][1], rows[0][2], "x") for k in range(5)]
    rows += [(2000, None, "a", "x"), (2001, [0.0] * 12, "a", "x"), (2002, [float("nan")] * 12, "a", "x"), (2003, rows[0][1], None, "x"), (2004, [None] + [1.0] * 11, "a", "x"), (2005, [], "a", "x")]
    ok = {k: np.array(v, np.float32).astype(float) for k, v, label, _ in rows if k < 2000}
    label = {k: x for k, _, x, _ in rows}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    pairs = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and cos(ok[a], ok[b]) >= 0.93]
    assert len(pairs) > 40
    ids = [x[0] for x in rows]
    reach, degree = smallest_reachable(ids, pairs), Counter(x for p in pairs for x in p)
    for block in (512, 1):  # one block a label; 16 and more of them, so intervals of several levels
        found = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding_join.near_duplicates(spark.createDataFrame(rows, schema), block=block).collect()}
        assert found == {k: (degree[k], reach[k], reach[k] == k) for k in ids}
    assert not embedding_join.near_duplicates(spark.createDataFrame([], schema)).collect()


def test_close_blocks_equal_all_pairs_of_boxes(spark):
    r, eps = np.random.default_rng(5), 0.1
    low = np.sort(r.random((300, 1)), 0) + [[0.0, 0.0]] * 300
    low[:, 1] = r.random(300)
    high = low + 0.05 * r.random((300, 2))
    label = ["a" if k < 290 else "b" for k in range(300)]
    packed = spark.createDataFrame([(label[k], 2, k // 100, k % 100 + 7, low[k].tolist(), high[k].tolist()) for k in range(300)], "label string, size int, part int, pos long, low array<double>, high array<double>")
    boxes = embedding_join.numbered(packed)
    assert sorted((x["label"], x["seq"]) for x in boxes.collect()) == [("a", k) for k in range(290)] + [("b", k) for k in range(10)]
    found = [(x["label"], x["a"], x["b"]) for x in embedding_join.close_blocks(boxes, 2, eps).collect()]
    gap = lambda i, j: np.maximum(np.maximum(low[i] - high[j], low[j] - high[i]), 0)
    want = [(label[i], i % 290, j % 290) for i in range(300) for j in range(i, 300) if label[i] == label[j] and gap(i, j) @ gap(i, j) <= eps * eps]
    assert sorted(found) == sorted(want) and len(want) < 10_000


def test_url_filter(spark):
    urls = ["http://example.net/en/a?x#y", "https://Sub.Example.NET/fr", "http://example.org/fr/x", "http://example.com/de/q", "http://example.com/d", "http://badexample.net/", "no scheme", None, "http://", "http://net", "x://org?/fr/"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = host.translate(LOWER)
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    df = spark.createDataFrame([(k % 9, u, "r") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, url_filter.default_rules(spark)).collect()}
    assert found == {(u, *judge(u)) for u in urls}
    assert not url_filter.judge_urls(df.limit(0), url_filter.default_rules(spark)).collect()


def test_decontamination(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(f"i{k}", " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 10, 14, 30])))) for k in range(12)] + [("same", None), ("i99", "W1 w2, w3"), ("i98", "w1 w2 w3"), ("none", "--")]
    rows = []
    for k in range(40):
        parts = [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        if k % 2:
            piece = (r.choice(items)[1] or "").split()
            parts[len(parts) // 2 : len(parts) // 2] = piece[: r.choice([9, 10, 40])]
        rows.append((k, " ".join(parts).upper() if k % 3 else " - ".join(parts), "x", 1))
    rows += [(100, None, "x", 1), (101, "", "x", 1), (102, "w5 w1 w2 w3 w1 w2 w3", "x", 1), (103, " ".join(["z"] * 30_000) + " w1 w2 w3", "x", 1)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(name)
    expected = {}
    for k, t, *_ in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        expected[k] = (len(w), len(hit), sorted(names))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id string, text string")
    for most in (decontaminate.MAX_BLOCK_WORDS, 40):
        found = decontaminate.find_contamination(docs, bench, max_block_words=most).withColumn("n_hit", decontaminate.hit_words()).collect()
        assert {x["doc_id"]: (x["n_words"], x["n_hit"], sorted(x["items"])) for x in found} == expected
    kept = {x["doc_id"]: x["text"] for x in decontaminate.remove_spans(docs, bench).collect()}
    assert set(kept) == {k for k, (n, hit, _) in expected.items() if hit <= n / 2}
    assert all(kept[k] == t for k, t, *_ in rows if not expected[k][1])
    assert not decontaminate.find_contamination(docs.limit(0), bench).collect()


def test_decontamination_of_repeated_and_null_ids(spark):
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(8)]
    rows = [(i, f"start {items[k][1]} and so on it goes for quite some words more than were hit before {k}", "x", k) for i in (None, 3) for k in range(4)] * 2 + [(3, None, "x", 0)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id string, text string")
    found, cleaned = [], []
    for most in (decontaminate.MAX_BLOCK_WORDS, 20):
        part = decontaminate.find_contamination(docs, bench, max_block_words=most, keep_text=True).collect()
        found.append(Counter((r["doc_id"], r["text"], r["n_words"], str(r["spans"]), str(r["items"]), r["longest"]) for r in part))
        cleaned.append(Counter(map(tuple, decontaminate.remove_spans(docs, bench, max_block_words=most).collect())))
    assert found[0] == found[1] and cleaned[0] == cleaned[1]
    assert sum(found[0].values()) == sum(cleaned[0].values()) == len(rows)
    assert not any("w0x5" in (r[1] or "") for r in cleaned[1])


def test_sentencepiece_matches_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["ﬁne  ① ｶﾞ\u3000x", "a\x00b", "🙂👩‍👩‍👧 é e\u0301", "  lead and trail  ", "tab\tnew\nline\r\n", "▁under▁", "\u200b\ufeff", "<s></s><unk>", "ǅ 𝒜 ½", "x" * 5000]
    rows = [*texts(5, 20), *[(500 + k, t, "x", 1) for k, t in enumerate(odd)]]
    for r in sentencepiece_codec.encode_documents(spark.createDataFrame(rows, DOCS), path).join(spark.createDataFrame(rows, DOCS), "doc_id").collect():
        ids = tool.encode(r["text"] or "")
        assert list(r["ids"]) == ids and r["decoded"] == tool.decode(ids)
        assert len(r["starts"]) == len(ids) == len(r["ends"])
        assert all(a <= b for a, b in zip(r["starts"], r["ends"], strict=True)) and list(r["starts"]) == sorted(r["starts"])
        assert max(r["ends"], default=0) <= len((r["text"] or "").encode())


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [*texts(6, 20), (900, "a\nb b\n\nlast 🙂 line", "x", 1)]
    found = token_counts.count_tokens(spark.createDataFrame(rows, DOCS), path, public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    for r in found:
        assert sum(r["section_tokens"]) + r["outside_tokens"] == r["n_tokens"]
    assert token_counts.attribute(np.array([0, 2, 4]), np.array([2, 4, 5]), np.array([[0, 3], [3, 5]]), "most")[0].tolist() == [2, 1]


def test_lm_scoring(spark):
    rows = texts(9, 80)
    found = {r["doc_id"]: r for common in (10, 10_000) for r in lm_scoring.score_documents(spark.createDataFrame(rows, DOCS), public_tokenizers.path("byte_bpe_50k.tiktoken"), sample=300, common_words=common).collect()}
    tokens = {k: [*SPACE_WORDS.findall((t or "").translate(LOWER)), None] for k, t, *_ in rows}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        r = found[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert -1e9 < r["score"] < 0
    assert not lm_scoring.score_documents(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()


def test_lm_probabilities_add_up_and_windows_do_not_matter():
    r = np.random.default_rng(2)
    data = [r.integers(0, 40, lm_scoring.WINDOW + 1).astype(np.int32) for _ in range(200)]
    model = lm_scoring.train(data, np.bincount(np.concatenate(data), minlength=50), classes=12, epochs=1)
    one = sum(10 ** model.scores(np.array([3, 7, k]), np.array([3]))[0] for k in range(50))
    assert one == pytest.approx(10 ** model.scores(np.array([3, 7]), np.array([2]))[0], rel=1e-4)
    ids = r.integers(0, 50, 700)
    alone = [model.scores(part, np.array([len(part)]))[0] for part in (ids[:5], ids[5:300], ids[300:])]
    assert model.scores(ids, np.array([5, 295, 400])) == pytest.approx(alone, rel=1e-5)


def test_lm_scores_equal_a_loop_over_tokens():
    """Each token in the window that scores it, in double precision, one head position by position."""
    r = np.random.default_rng(7)
    data = [r.integers(0, 30, lm_scoring.WINDOW + 1).astype(np.int32) for _ in range(100)]
    model = lm_scoring.train(data, np.bincount(np.concatenate(data), minlength=40), classes=10, epochs=1)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, step = r.integers(0, 40, 61), lm_scoring.WINDOW - lm_scoring.OVERLAP
    total = 0.0
    for i, wanted in enumerate(ids):
        start = 0 if i < lm_scoring.WINDOW else step * (-(-(i + 1 - lm_scoring.WINDOW) // step))  # the first window in which it stands behind its overlap
        rows = [0 if j < 0 else int(model.row[ids[j]]) for j in range(start - 1, i)]
        h = np.array([p["E"][x] + p["P"][k] for k, x in enumerate(rows)])
        scores = np.array([h[-1] @ p["Q"] @ (x @ p["K"]) for x in h]) / lm_scoring.WIDTH**0.5
        share = np.exp(scores - scores.max())
        one = h[-1] + (share / share.sum()) @ (h @ p["V"]) @ p["O"]
        two = one + np.maximum(one @ p["A"] + p["a"], 0) @ p["B"]
        z = two @ p["U"] + p["u"]
        total += (z[model.group[wanted]] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10) + model.share[wanted]
    assert model.scores(ids, np.array([len(ids)]))[0] == pytest.approx(total, rel=1e-4)


def test_lm_windows_hold_every_id_once():
    sizes = np.array([1, 16, 17, 300, 5, 28, 29])
    ids = np.arange(sizes.sum()) + 7
    data, later = lm_scoring.windows_of(ids, sizes)
    wanted = data[:, 1:].copy()
    wanted[later, : lm_scoring.OVERLAP] = -2
    assert sorted(wanted[wanted >= 0]) == ids.tolist()
    parts = [lm_scoring.windows_of(ids, sizes, lambda n, k=k: np.random.default_rng(1).integers(0, 3, n) == k)[0] for k in range(3)]
    assert sorted(map(tuple, np.concatenate(parts))) == sorted(map(tuple, data))


def test_lm_ids_have_rows_of_their_own():
    counts = np.arange(6000)[::-1].copy()
    model = lm_scoring.train([], counts)
    assert len(np.unique(model.row)) == len(counts) and 0 not in model.row and len(model.p["E"]) == len(counts) + 1
    assert model.p["U"].shape[1] == lm_scoring.CLASSES == 192


def test_lm_learns_from_all_windows(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TASK_WINDOWS", 200)  # several tasks
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(str(k), "x" * 40 + "".join(f"qz{k % 7}-" for _ in range(60)) + " one long run " * 20) for k in range(40)]
    blocks = lm_scoring.id_blocks(spark.createDataFrame(rows, "id string, text string"), path)
    ids, sizes, _ = lm_scoring.encode(lm_scoring.subwords(path), [t for _, t in rows])
    counts = np.bincount(ids, minlength=lm_scoring.subwords(path).size)
    cells, times = lm_scoring.count_neighbours(blocks, counts)
    pairs = Counter((a, b) for d in np.split(ids, np.cumsum(sizes)[:-1]) for a, b in zip(d[:-1], d[1:], strict=True))
    assert times.sum() == 2 * sum(pairs.values())
    model = lm_scoring.train_on(blocks, counts)
    met = np.unique(model.row[ids[ids != lm_scoring.subwords(path).end]])
    start = lm_scoring.fresh(counts, cells, times, lm_scoring.CLASSES, 5)
    assert (model.p["E"][met] != start.p["E"][met]).any(1).all()  # every id of the documents, those inside long runs included, was learnt from
    start.tables()
    assert model.scores(ids, sizes).sum() > start.scores(ids, sizes).sum()


def test_quality_classifier(spark):
    r = random.Random(1)
    kinds = {0: "zz qq !! xx", 1: "vile awful nasty", 2: "calm clear useful text here"}
    rows = [(k, " ".join(r.choice(kinds[k % 3].split()) for _ in range(30)), "x", 1) for k in range(300)]
    rated = spark.createDataFrame([(k, k % 3) for k in range(0, 300, 2)], "doc_id long, grade int")
    docs = spark.createDataFrame([*rows, (900, None, "x", 1), (901, "", "x", 1)], DOCS)
    found = {x["doc_id"]: x for x in quality.rate_documents(docs, quality.train(docs, rated)).collect()}
    assert len(found) == 302
    assert all(found[k]["selected"] == (k % 3 == 2) for k in range(1, 300, 2))
    assert found[900]["p_top"] == found[901]["p_top"] and 0 <= found[7]["expected_grade"] <= 2


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav class=menu><a href=/>Home</a><a href=/b>B</a></nav><article><h1>Head &amp; line</h1><p>First   text of the\n page, with some words.</p><p>Second text of it, quite long as well.</p></article><div class='comments'><p>nice</p></div><footer>&copy; 2020 x</footer><script>var a='<p>no</p>'</script></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (3, "u", ""), (4, None, "<p>unclosed <b>text")]
    found = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 5
    by = {r["page_id"]: r["text"] for r in found}
    assert by[1] == "Head & line\nFirst text of the page, with some words.\nSecond text of it, quite long as well."
    assert by[2] == by[3] == "" and by[4] == "unclosed text" and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text int")).collect() == []


MENU, RIGHTS = "<div><a href=/a>Home</a> <a href=/b>News and more</a> <a href=/c>About us</a></div>", "<div>&copy; 2024 Some Company Ltd. All rights reserved.</div>"
SHAPES = {
    "article alone": ("<body><article>", "</article></body>"), "section between furniture": (f"<body>{MENU}<section>", f"</section>{RIGHTS}</body>"), "div between furniture": (f"<body>{MENU}<div>", f"</div>{RIGHTS}</body>"),
    "behind a notice": ("<body><div>We use cookies to make this site better. <button>OK</button></div><div id=x>", "</div></body>"), "body alone": ("<body>", "</body>"), "main between furniture": (f"<body>{MENU}<main>", f"</main>{RIGHTS}</body>"),
    "body between furniture": (f"<body>{MENU}", f"{RIGHTS}</body>")}


@pytest.mark.parametrize("shape", SHAPES)
def test_html_keeps_every_paragraph_of_short_articles(shape):
    start, end = SHAPES[shape]
    for n in (1, 2, 3, 4, 5, 8, 12, 20):
        paragraphs = [f"Paragraph {k} of the article says something in some fifteen words, as one does in an article." for k in range(n)]
        page = f"<html>{start}{''.join(f'<p>{p}</p>' for p in paragraphs)}{end}</html>"
        assert html_extract.extract(page, html_extract.trained()) == "\n".join(paragraphs), n


def test_html_plain_text_and_pages_without_article():
    model = html_extract.trained()
    assert html_extract.extract("Just plain text without tags.", model) == "Just plain text without tags."
    assert html_extract.extract("<p>Just one line of text.</p>", model) == "Just one line of text."
    assert html_extract.extract("<nav><a href=/>Home</a></nav><footer>&copy; 2020 x</footer>", model) == ""


def test_html_items_under_many_open_elements_take_linear_time():
    import time

    began = time.process_time()
    nodes = html_extract.parse("<div>" * 20_000 + "<li>x" * 2_000 + "</p>" * 2_000)
    assert sum(x.tag == "li" for x in nodes) == 2_000 and time.process_time() - began < 5


@pytest.mark.parametrize("page", [
    "<body><form><select><option>no<option>no</select></form><p>Body text.</p><p>More.</p>",
    "<head><meta charset=x><title>no</title><p>Body text.</p><p>More.</p>",
    "<head><title>no</title>Body text.<p>More.</p>",
    "<body><datalist><option>no<option>no</datalist><p>Body text.</p><p>More.</p>",
    "<body><select><optgroup><option>no<optgroup><option>no</select>Body text.<p>More.</p>",
    "<body><div><button>no</div><p>Body text.</p><p>More.</p>",
    "<body><svg><text>no</text><p>Body text.</p><p>More.</p>",
    "<body><table><tr><td><select><option>no<td>Body text.</table><p>More.</p>",
    '<body><p title="abc>Body text.</p><p>More.</p>',
    """<body><p title="abc>Body text.</p><p class="x">More.</p>""",
    """<body><p title=a'b data-x="a>b" data-y='c>d' e=f>Body text.</p><p it's>More.</p>""",
])
def test_html_hidden_elements_end(page):
    assert [t for _, t in sorted(b for x in html_extract.parse(page) for b in x.texts)] == ["Body text.", "More."]


def test_html_math_and_fallback_content_reach_the_trees():
    nodes = html_extract.parse("<body><p>Let <math><mi>x</mi> = 2</math> be.</p><p><video><a href=/v>get it</a></video> End.</p><object><p>Shown.</p></object>")
    assert [(x.tag, [t for _, t in x.texts]) for x in nodes if x.texts] == [("p", ["Let x = 2 be."]), ("p", ["End."]), ("video", ["get it"]), ("p", ["Shown."])]


def test_html_with_names_that_say_nothing():
    page = (
        "<body><div class=zq1><a href=/a>Home</a> | <a href=/b>News</a> | <a href=/c>Sport</a></div><div class=kx><h1>A headline of some words</h1><p>The first paragraph has a number of words, as they do.</p>"
        "<p>The second one is longer; it has commas, and more than one sentence. This is it.</p><p>And a third, to close.</p></div><div class=zz9>&copy; 2024 Some Firm. All rights reserved.</div>"
    )
    text = html_extract.extract(page, html_extract.trained())
    assert text.startswith("A headline of some words\nThe first paragraph has a number of words, as they do.\nThe second one is longer; it has commas, and more than one sentence. This is it.")
    assert "Home" not in text and "Firm" not in text


def test_html_blocks_of_the_pages_table():
    """Blocks inside the article are the main text of the given pages; nothing else is."""
    import pandas as pd

    pages, model, right, kept, wanted = pd.read_parquet("/root/testdata/sf0.001/pages.parquet"), html_extract.trained(), 0, 0, 0
    for page in pages["html"].fillna(""):
        nodes = html_extract.parse(page)
        inside = {}
        for x in nodes:
            inside[id(x)] = x.tag == "article" or (x.parent is not None and inside[id(x.parent)])
        gold = {b for x in nodes if inside[id(x)] for b in x.texts}
        features = html_extract.describe(nodes)
        taken = html_extract.chosen(nodes, features, model.log_odds(features))
        found = {b for k, x in enumerate(nodes) if taken[k] for b in x.texts}
        right, kept, wanted = right + len(gold & found), kept + len(found), wanted + len(gold)
    assert right / kept > 0.98 and right / wanted > 0.98


def test_html_on_composed_pages():
    model, r, right, all_ = html_extract.trained(), random.Random(99), 0, 0
    for _ in range(60):
        nodes = html_extract.parse(html_extract.compose_page(r), "data-main")
        kept = html_extract.decode(nodes, model.log_odds(html_extract.describe(nodes)))
        with_text = [k for k, x in enumerate(nodes) if x.texts]
        right += sum(kept[k] == (nodes[k].label is True) for k in with_text)
        all_ += len(with_text)
        place = {id(x): k for k, x in enumerate(nodes)}
        assert all(kept[place[id(nodes[k].parent)]] for k in range(1, len(nodes)) if kept[k])
    assert right / all_ > 0.93


def test_sharding(spark):
    shards = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(shards, 1009)
    n = Counter(table)
    assert len(table) == 1009 and max(n.values()) - min(n.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 0.35 * 1009
    df = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y"), ("b", "z")], "key string, shard string")
    found = sharding.assign_shards(df, "key", shards, 1009).collect()
    assert len(found) == 4 and all(r["shard"] == shards[table[r["slot"]]] for r in found)
    assert len({r["shard"] for r in found if r["key"] == "a"}) == 1


def test_jaccard_passage_that_many_texts_quote_ties_only_near_ones(spark, monkeypatch):
    """With buckets that hide it, as in a large input: texts that share a passage alone are no cluster, near copies among them are."""
    monkeypatch.setattr(jaccard_join, "bucket_counts", lambda docs, words: np.zeros(jaccard_join.BUCKETS, np.uint8))
    passage = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join([*(f"d{k}x{i}" for i in range(60 + k % 30)), *passage])) for k in range(500)]
    rows += [(1000 + k, rows[k][1].replace("x3 ", "y ")) for k in range(0, 500, 50)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("key", functions.xxhash64("id", "text"))
    signed = jaccard_join.signatures(docs, 5, 80)
    tokens = signed.select(functions.explode("first").alias("token")).groupBy("token").count()
    assert tokens.where(f"count > {jaccard_join.PAIRS_UP_TO}").count() > 0
    sizes = [r["count"] for r in jaccard_join.clusters(signed, 80).groupBy("cluster").count().collect()]
    assert sorted(sizes) == [2] * 10
    found = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs.withColumnRenamed("id", "doc_id")).collect()}
    assert found == {k: (k % 1000, int(k % 50 == 0)) for k, _ in rows}


def test_jaccard_large_groups_in_ordinary_buckets(spark, monkeypatch):
    """A family of near copies whose shingles are in more classes than are paired, with buckets that hide them."""
    monkeypatch.setattr(jaccard_join, "bucket_counts", lambda docs, words: np.zeros(jaccard_join.BUCKETS, np.uint8))
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:-1], f"v{k}"]), "x", 1) for k in range(130)]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS), tile=20).collect()
    assert {(r["component_id"], r["n_links"]) for r in found} == {(0, 129)}


def test_jaccard_join_of_one_row_repeated_by_the_thousand(spark):
    """A hot row, ids and all, in a group of near copies: each task hands it on once, and all copies are counted."""
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (0, 1, 58, 59)]
    n = 50_000
    hot = spark.range(n, numPartitions=8).selectExpr("cast(null as long) doc_id", f"'{' '.join(words)}' text")
    rest = spark.createDataFrame([(k, t) for k, t in enumerate(near)], "doc_id long, text string")
    found = jaccard_join.jaccard_join(hot.unionByName(rest)).groupBy("doc_id", "component_id", "n_links").count().collect()
    pairs = Counter(a for a in near for b in near if a != b and 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(a) | shingles(b)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"], r["n_links"], r["count"]) for r in found) == [(-1, 0, n - 1 + 4, n), *[(k, 0, n + pairs[t], 1) for k, t in enumerate(near)]]
    keyed = hot.unionByName(rest).selectExpr("doc_id", "text", "xxhash64(doc_id, text) key", "0 a", "0 b")
    assert jaccard_join.once(keyed, "key", "a", "b").count() <= 8 + len(near)


def test_sets_that_agree_in_half_their_hash_are_told_apart(spark):
    rows = [(1, 5, 7), (2, 5, 8), (3, 5, 7), (4, 6, 9), (5, None, None)]
    signed = spark.createDataFrame(rows, "id long, own long, other long")
    cls = {r["id"]: r["cls"] for r in jaccard_join.told_apart(signed).collect()}
    assert cls[1] == cls[3] != cls[2] and cls[4] == 6 and cls[5] is None
    assert {r["cls"] for r in jaccard_join.told_apart(signed.where("id != 2")).collect()} == {5, 6, None}


def test_automaton_equals_search_for_every_window():
    """Items of few different words, shorter and longer than a window, repeated and contained in one another."""
    r = random.Random(11)
    for _ in range(120):
        window, letters = r.choice((2, 3, 5)), "abc"[: r.randint(1, 3)]
        items = [(f"i{k}", [r.choice(letters) for _ in range(r.randint(0, 9))]) for k in range(r.randint(0, 7))]
        auto = decontaminate.Automaton(decontaminate.unpacked(*decontaminate.packed(items)), window)
        for _ in range(8):
            doc = [r.choice(letters + "x") for _ in range(r.randint(0, 30))]
            hit, met, longest = set(), set(), 0
            for name, seq in items:
                n = min(window, len(seq))
                for at in range(len(doc) - n + 1):
                    if n and any(doc[at : at + n] == seq[k : k + n] for k in range(len(seq) - n + 1)):
                        hit |= set(range(at, at + n))
                        met.add(name)
                for a in range(len(doc)):
                    for k in range(len(seq)):
                        run = 0
                        while a + run < len(doc) and k + run < len(seq) and doc[a + run] == seq[k + run]:
                            run += 1
                        longest = max(longest, run)
            spans, found, most = auto.match(doc)
            assert {p for a, b in spans for p in range(a, b)} == hit and {auto.names[k] for k in found} == met and most == longest
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
