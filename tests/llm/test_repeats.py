"""Spelling variants, repeated runs of words and fill-in-the-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import fill_middle, spelling_variants, substring_dedup
from tests.llm.conftest import DOCUMENT, PROSE

# Spelling variants


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_near(words):
    """By word, those one edit away, found through words with one letter left out."""
    less = defaultdict(set)
    near = defaultdict(set)
    for w in words:
        if len(w) > 1000:  # too many words with one letter left out
            near[w] = {v for v in words if v == w[1:] or v[1:] == w}
            continue
        for i in range(len(w)):
            less[i, w[:i] + w[i + 1 :]].add(w)
    for (_, short), found in less.items():
        for w in found:
            near[w] |= found - {w}
            if short in words:
                near[w].add(short)
                near[short].add(w)
    return near


def plain_variants(rows):
    words = plain_words(rows)
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def variants(spark, docs):
    got = spelling_variants.variant_groups(docs).collect()
    assert len(got) == len({r["word"] for r in got})
    return {r["word"]: tuple(r)[1:2] + tuple(r)[2:] for r in got}


def misspelt_corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(4, 8))) for _ in range(30)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = base[min(rng.randrange(30), rng.randrange(30))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("abcdeé"), w[k] + rng.choice("xyz")]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ", ", "1", "×", "ā"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_are_those_of_brute_force(spark, documents, seed):
    rows = misspelt_corpus(seed)
    got, wanted = variants(spark, documents(rows)), plain_variants(rows)
    assert got == wanted
    assert any(v[0] for v in wanted.values())


def test_chains_of_forms_lead_to_one_root(spark, documents):
    chain = {"aaaaa": 40, "aaaab": 18, "aaabb": 8, "aabbb": 4, "abbbb": 4}
    rows = [(None, f"{w} " * n) for w, n in chain.items()]
    got = variants(spark, documents(rows))
    assert got == plain_variants(rows)
    assert {got[w][1] for w in ("aaaab", "aaabb", "aabbb")} == {"aaaaa"}


def test_crowds_are_cut_into_cells(spark):
    """Words of one crowd in cells of three, against all pairs."""
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 7))) for _ in range(80)})
    words = {w: rng.randint(1, 9) for w in names}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling_variants.near_words(df, len(words), tile_words=3).collect()
    near = {w: x for w, x in plain_near(words).items() if x}
    assert {r["word"]: r["n_near"] for r in got} == {w: len(x) for w, x in near.items()}
    best = {w: min(x, key=lambda v: (-words[v], v)) for w, x in near.items()}
    assert {r["word"]: (r["best"], r["best_n"]) for r in got} == {w: (v, words[v]) for w, v in best.items()}


def test_variants_of_odd_tables(spark, documents, odd_texts):
    odd = [*odd_texts, (9, "y" * 5000 + " " + "y" * 4999 + " " + "Éé " * 3), (9, None)]
    rows = [(i, t) for i, t in odd * 3]
    docs = documents(rows).selectExpr("*", "'w' AS word", "1 AS n", "2 AS key", "3 AS tile")
    assert variants(spark, docs) == plain_variants(rows)
    assert variants(spark, documents([])) == {} and variants(spark, documents([(1, None)])) == {}


def test_long_texts_are_counted_alike(monkeypatch):
    text = ("Über naïve×x café " * 50).encode()
    whole = Counter(dict(spelling_variants.words_of(1, text)))
    monkeypatch.setattr(spelling_variants, "LONG_TEXT", 10)
    assert Counter(dict(spelling_variants.words_of(1, text))) == whole


# Repeated runs of words


def plain_repeats(texts, window):
    """By row, the words and which of them go."""
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in rows for i in range(len(w) - window + 1))
    out = []
    for w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def repeats_by_id(docs, **how):
    got = substring_dedup.remove_repeats(docs, **how).collect()
    return {r["doc_id"]: r for r in got}


def agrees(got, texts, window):
    wanted = plain_repeats(texts, window)
    for i, (words, gone) in enumerate(wanted):
        row = got[i]
        spans = [k for s in row["repeats"] for k in range(s["start"], s["end"])]
        assert (row["n_words"], row["n_removed"]) == (len(words), sum(gone))
        assert spans == [k for k, g in enumerate(gone) if g]
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert row["text"] == (None if texts[i] is None else kept)
    return sum(sum(g) for _, g in wanted)


def passages(seed, size, window):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefg") + str(rng.randrange(9)) for _ in range(60)) for _ in range(4)]
    texts = []
    for _ in range(size):
        words = [rng.choice("abc") + str(rng.randrange(40)) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            run = rng.choice(shared).split()
            a = rng.randrange(len(run))
            k = rng.randrange(len(words) + 1)
            words[k:k] = run[a : a + rng.randrange(1, 2 * window)]
        text = rng.choice([" ", "  ", "\n", "\t "]).join(words)
        texts.append(rng.choice(texts) if texts and rng.random() < 0.1 else text)
    return texts


@pytest.mark.parametrize("window", [2, 5, 12, 35])
def test_repeats_are_those_of_brute_force(spark, documents, window):
    texts = passages(window, 80, window)
    docs = documents(texts)
    assert agrees(repeats_by_id(docs, window=window), texts, window)
    small = repeats_by_id(docs, window=window, block_bytes=700, bucket_hashes=40)
    assert agrees(small, texts, window)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30), max_size=6), st.integers(2, 6), st.integers(0, 3))
def test_blocks_find_what_brute_force_finds(rows, window, bits):
    """The functions that run in tasks, without Spark between them."""
    texts = [" ".join(r) for r in rows]
    tables = [pa.table({"block": [i], "text": pa.array([t.encode()])}) for i, t in enumerate(texts)]

    def answers(packets, kind):
        every = pa.concat_tables([*packets, substring_dedup._rows([], [], [])])
        out = [substring_dedup._rows([], [], [])]
        for bucket in set(every["bucket"].to_pylist()):
            held = every.filter(pa.compute.equal(every["bucket"], bucket))
            out.append(substring_dedup.answer(kind)((pa.scalar(bucket),), held))
        every = pa.concat_tables(out)
        return [every.filter(pa.compute.equal(every["block"], i)) for i in range(len(texts))]

    probe, extend = substring_dedup.probe(window, bits), substring_dedup.extend(window, bits)
    hits = answers([probe((pa.scalar(i),), t) for i, t in enumerate(tables)], substring_dedup.NARROW)
    again = answers([extend(t, h) for t, h in zip(tables, hits, strict=True)], substring_dedup.WIDE)
    for i, (words, gone) in enumerate(plain_repeats(texts, window)):
        held = substring_dedup.Texts(tables[i]["text"])
        starts, entries = substring_dedup.window_entries(held, window, bits, hits[i])
        covered = substring_dedup.cover(len(words), starts[entries.marked(again[i])], window)
        assert covered.tolist() == gone


def test_hot_passage_and_repeated_rows(spark):
    """A third of all rows are one text under one id; the rest share a passage."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(7, PROSE[0] * 3, "en", "s", 1)] * 50
    rows += [(100 + i, f"own{i} {passage} end{i}", "en", "s", 1) for i in range(100)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCUMENT), block_bytes=900).collect()
    assert len(got) == 150
    assert {r["text"] for r in got if r["doc_id"] == 7} == {""}
    assert {r["text"] for r in got if r["doc_id"] != 7} == {f"own{i} end{i}" for i in range(100)}


def test_repeats_keep_columns_and_odd_rows(spark, documents, odd_texts):
    docs = documents(odd_texts).selectExpr("*", "1 AS block", "'r' AS rest", "2 AS number", "'x' AS repeats")
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "block", "rest", "number", "text", "n_words", "n_removed", "repeats"]
    rows = got.collect()
    assert len(rows) == len(odd_texts)
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[0, 0]["text"] is None and by[1, 0]["text"] == "" and by[2, 0]["text"] == ""
    assert by[3, 1]["text"] == "x" * 300_000 and by[4, 60_000]["n_removed"] == 60_000
    assert by[8, 3]["text"] == "😀 é\0 ß" and by[None, len(PROSE[1].split())]["rest"] == "r"
    assert substring_dedup.repeat_report(documents([])).count() == 0
    alone = substring_dedup.remove_repeats(documents(["a b"]).select("text")).collect()
    assert alone[0]["n_words"] == 2
    report = substring_dedup.repeat_report(documents([(1, None)])).first()
    assert tuple(report) == (1, 0, 0, hashlib.sha256(b"").hexdigest())


# Fill in the middle


def plain_middle(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_middles_are_those_of_brute_force(spark, documents, odd_texts):
    rng = random.Random(3)
    letters = ["a", "b ", "é", "한", "😀", "<", "<S", "P>", "\n", "\0"]
    rows = [(i, "".join(rng.choice(letters[: rng.randint(1, 10)]) for _ in range(rng.randrange(400)))) for i in range(20, 300)]
    rows += odd_texts + [(400, "<P>"), (401, "a<M>b"), (402, "<S"), (403, "é" * 5000 + "a" * 5000 + "😀한" * 3000)]
    docs = documents(rows).selectExpr("*", "'f' AS form", "1 AS digest", "2 AS h1", "'r' AS rest")
    got = fill_middle.fill_in_middle(docs, run_bytes=1000, error=5)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "digest", "h1", "rest", "n", "form", "prefix_chars", "middle_chars", "output"]
    again = got.withColumn("again", fill_middle.restored()).collect()
    wanted = Counter((i, *plain_middle(i, t), t or "") for i, t in rows)
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    assert Counter(tuple(r[c] for c in columns) for r in again) == wanted
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}
    assert fill_middle.middle_report(documents([])).count() == 0


def test_bytes_that_are_no_text_come_back(spark):
    bad = spark.sql("SELECT id AS doc_id, cast(unhex('80C3A9FF41E2828282') AS string) AS text FROM range(40)")
    got = fill_middle.fill_in_middle(bad).withColumn("again", fill_middle.restored())
    assert got.selectExpr("hex(cast(again AS binary)) AS h").distinct().collect() == [("80C3A9FF41E2828282",)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 700)), max_size=12), st.integers(0, 120))
def test_rank_index_is_exact_and_within_its_bound(stretches, error):
    widths = np.concatenate([np.zeros(1, np.int64), *[np.full(n, w) for w, n in stretches]])
    offsets = np.cumsum(widths)
    index = fill_middle.RankIndex(offsets, error)
    ranks = np.arange(len(offsets))
    assert np.array_equal(index.offset(ranks), offsets)
    assert np.abs(index.predict(ranks) - offsets).max() <= error + 1
    assert len(index.firsts) <= 1 + sum(n for _, n in stretches)


def test_plain_letters_are_one_segment():
    index = fill_middle.RankIndex(np.arange(100_000))
    assert len(index.firsts) == 1 and not index.residuals.any()
