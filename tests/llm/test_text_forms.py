"""Spelling groups, fill-in-middle and chat formatting against plain code, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringledger.llm import chat_format, fill_in_middle, spelling

DOCS = "doc_id long, text string, word string, form int"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(rows) -> dict:
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def variants(seed: int, letters: str, low: int, high: int, n: int) -> list[str]:
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)]
    for w in list(words):
        k, c = r.randrange(len(w)), r.choice(letters)
        words += [w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]]
    return words


@pytest.mark.parametrize("letters,low,high,n", [("ab", 5, 9, 60), ("abcé", 5, 12, 120), ("abcdefghijklmnopqrstuvwxyzÀß", 5, 14, 150)])
def test_spelling_groups(spark, letters, low, high, n):
    r = random.Random(n)
    rows = [(k, " ".join(r.choice((w, w.upper() if w.isascii() else w)) for _ in range(r.choice((1, 3, 3, 7, 14)))) + "; x1") for k, w in enumerate(variants(n, letters, low, high, n))]
    rows += [(None, None), (3, ""), (None, rows[0][1]), rows[1], rows[1]]
    found = spelling.spelling_groups(spark.createDataFrame([(*x, "w", 1) for x in rows], DOCS)).collect()
    assert {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in found} == plain_groups(rows)
    assert len(found) == len({x["word"] for x in found})


def test_spelling_chain_and_empty_table(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb"]
    rows = [(7, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    found = {x["word"]: x["root"] for x in spelling.spelling_groups(spark.createDataFrame([(*x, "w", 1) for x in rows], DOCS)).collect()}
    assert found == {w: "abbbb" for w in chain}
    assert spelling.spelling_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_do_not_depend_on_slices(monkeypatch):
    text = "Änd ÀÉß× word1 twoāthree " * 50
    whole = [x.translate(LOWER) for x in RUN.findall(text)]
    for size in (1, 2, 7, 10_000):
        monkeypatch.setattr(spelling, "SLICE", size)
        assert list(spelling.runs(text)) == whole


def test_pivots_are_the_cheapest_disjoint_pair():
    r = random.Random(4)
    for _ in range(300):
        prefix = sorted((k, r.randrange(50), r.randrange(1, 9)) for k in r.sample(range(9), r.randint(3, 6)))
        cost = {k: n for k, _, n in prefix}
        one, two = spelling.pivots(prefix)
        assert abs(one - two) >= 2
        assert cost[one] + cost[two] == min(cost[a] + cost[b] for a in cost for b in cost if b - a >= 2)


def plain_middle(doc_id, text) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return len(text), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out


def middle_rows() -> list[tuple]:
    r = random.Random(8)
    rows = [(k, "".join(r.choice("ab<PSM>é\U0001f600\n") for _ in range(r.randint(0, 90)))) for k in range(300)]
    rows += [(k, "<" * k + "P" + "S>M>" * (k % 3)) for k in range(300, 330)]
    return rows + [(None, None), (None, "null id"), (5, ""), (6, None), (9, "long \U0001f600" * 20_000), rows[0], rows[0], (1, "same id, other text"), *[(77, "a text of many copies")] * 40]


@pytest.mark.parametrize("units", [1, 2, 7, 4096])
def test_fill_in_middle(spark, units):
    rows = [x for x in middle_rows() if units > 2 or len(x[1] or "") < 200]
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows], DOCS).repartition(5)
    wanted = Counter((k, *plain_middle(k, t)) for k, t in rows)
    made = fill_in_middle.transform_documents(docs, units=units).cache()
    assert Counter(tuple(x) for x in made.collect()) == wanted
    assert Counter(tuple(x) for x in fill_in_middle.restore_documents(made, units=units).collect()) == Counter((k, t or "") for k, t in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = Counter((k, *(p := plain_middle(k, t))[:4], sha(p[4]), sha(t or "")) for k, t in rows)
    assert Counter(tuple(x) for x in fill_in_middle.digest_documents(docs, units=units).collect()) == digests


def test_fill_in_middle_one_shuffle_and_bad_outputs(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fill_in_middle.digest_documents(empty).collect() == fill_in_middle.transform_documents(empty).collect() == []
    docs = spark.createDataFrame([(k, "text", "w", 1) for k in range(9)], DOCS)
    plan = fill_in_middle.digest_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2
    for form, output in (("psm", "no marks"), ("psm", "x<P>a<S>b<M>c"), ("spm", "<P>a<S>b<M>c")):
        with pytest.raises(Exception, match="mark"):
            fill_in_middle.restore_documents(spark.createDataFrame([(1, form, output)], "doc_id long, form string, output string")).collect()


TURNS = "conv_id long, turn long, role string, text string, formatted string"


def chat_rows() -> list[tuple]:
    r = random.Random(5)
    bits = ["</turn>", "\n", "\\", "### Assistant:", "### ", "#", "</", "turn>", "User", "é\U0001f600", ": ", " ok ", "<"]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
    rows = [(c, t, r.choice(("user", "assistant", "system", "user", "assistant")), text()) for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], text()) for t in range(900)]
    rows += [(101, 0, "tool: \\x", "a"), (101, 1, None, None), (101, None, "", "b"), (None, 0, "user", "null id"), (102, 5, "assistant", "tie"), (102, 5, "assistant", "tie"), (102, 5, "assistant", "a tie"), (103, -3, "user", "negative"), (104, 0, "Role x: ", "y")]
    return rows


def plain_turns(rows) -> dict:
    out: dict = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def plain_machine(turns, template) -> tuple:
    state, errors = template.start, 0
    for role, _ in turns:
        if (state, role) in template.moves:
            state = template.moves[state, role]
        else:
            errors += 1
    return state, errors, not errors and state in template.accept


@pytest.mark.parametrize("block", [1, 3, 256])
def test_chat_format(spark, block, monkeypatch):
    rows, template = chat_rows(), chat_format.Template()
    df = spark.createDataFrame([(*x, "f") for x in rows], TURNS)
    monkeypatch.setattr(chat_format.format_blocks, "__defaults__", (*chat_format.format_blocks.__defaults__[:-1], block))
    made = chat_format.format_conversations(df).withColumns({"turns": chat_format.read_turns(F.col("formatted")), "learnt": chat_format.read_learnt(F.col("segments"))}).collect()
    wanted = plain_turns(rows)
    assert len(made) == len(wanted)
    for x in made:
        turns = wanted[x["conv_id"]]
        assert [tuple(t) for t in x["turns"]] == turns
        assert x["learnt"] == "".join(t for role, t in turns if role == "assistant")
        assert x["formatted"] == "".join(s["text"] for s in x["segments"])
        assert x["formatted"].count("</turn>") == x["n_turns"] == len(turns)
        assert x["formatted"].count("### Assistant:") == sum(role == "assistant" for role, _ in turns)
        assert (x["end_state"], x["errors"], x["valid"]) == plain_machine(turns, template)
    assert chat_format.format_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_chat_marks_that_overlap(spark):
    template = chat_format.Template(roles={"user": ("abc", False), "assistant": ("cab", True)}, end="bca|", between="", other="oo", other_end=":;", moves={("start", "user"): "start", ("start", "assistant"): "start"}, accept=("start",))
    texts = ["abcabca|bca|cab", "aabcc", "bca", "a", "\\", "\\\\abc\\", "oo:;oo", "ooo"]
    rows = [(1, k, ("user", "assistant", "x:;ooy")[k % 3], t, "f") for k, t in enumerate(texts)]
    made = chat_format.format_conversations(spark.createDataFrame(rows, TURNS), template)
    got = made.select(chat_format.read_turns(F.col("formatted"), template).alias("t"), "formatted", "errors").first()
    assert [tuple(t) for t in got["t"]] == [(r[2], r[3]) for r in rows]
    assert got["formatted"].count("bca|") == len(texts) and got["errors"] == 2


@pytest.mark.parametrize("change", [{"end": "x"}, {"end": "abab"}, {"end": "a\\b"}, {"other": "### User"}, {"accept": ("nowhere",)}])
def test_chat_templates_that_cannot_be_read_back(change):
    with pytest.raises(ValueError):
        chat_format.Template(**change)
