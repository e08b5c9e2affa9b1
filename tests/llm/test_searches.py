"""Decontamination, URL lists and language-model scores against brute force."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import decontamination, lm_scoring, url_filter
from rosterlink.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import PROSE

# Benchmark items


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.text("abc", max_size=16))
def test_alignment(item, region):
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(region, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert decontamination.align(item, region) == (min(row), row.index(min(row)))


@pytest.mark.parametrize("q", [1, 3, 8, 10, 13])
def test_equal_grams_have_equal_hashes(q):
    text = "hello world, hello there é中😀 hello world"
    hashes = decontamination.qgram_hashes(text, q).tolist()
    grams = [text[i : i + q] for i in range(len(text) - q + 1)]
    assert len(set(zip(hashes, grams, strict=True))) == len(set(hashes)) == len(set(grams))


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        at, how = rng.randrange(1, len(chars) - 1), rng.random()
        chars[at : at + 1] = [] if how < 0.3 else ["z"] if how < 0.7 else [chars[at], "q"]
    return "".join(chars)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(2)
    words = [w for p in PROSE for w in p.split()]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 50)))) for i in range(30)]


def test_no_leak_within_the_budget_is_missed(items):
    rng, index = random.Random(3), decontamination.Items(items)
    for _ in range(200):
        n = rng.randrange(len(items))
        text = items[n][1].replace(" ", "_")  # blanks that an edit moves would be edits of their own
        one = decontamination.Items([(n, text)])
        changed = edited(text, int(one.edits[0]), rng)
        found = one.leaks(f"{PROSE[0]} {changed} {PROSE[1]}")
        assert n in found and found[n][0] <= one.edits[0]
    assert all(not index.leaks(p) for p in ("", None, "something else entirely"))


def test_leaks_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    tests = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    got = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op8_decontamination"](spark, SMALL).collect()}
    plain = [decontamination.plain(t) for t in tests["text"]]
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        content = decontamination.plain(text)
        for item, p in zip(tests["item_id"], plain, strict=True):
            if p in content:
                assert got[doc, item]["edits"] == 0
            elif (doc, item) in got:
                best, _ = decontamination.align(p, content)
                assert best == got[doc, item]["edits"] <= decontamination.edit_budget(len(p))


def test_blocks_short_items_and_odd_rows(spark, documents, odd_texts):
    rows = [(1, PROSE[0]), (1, PROSE[0]), (2, None), (3, ""), (4, " "), (5, "A  b"), (None, PROSE[1]), (6, PROSE[2])]
    tests = spark.createDataFrame([(*r, 0) for r in rows], "item_id long, text string, doc_id int").drop("doc_id")
    blocks = list(decontamination.item_blocks(tests, 40))
    assert len(blocks) > 1 and sum(len(items) for _, items in blocks) == 6
    assert not any(alone for alone, _ in blocks)
    docs = documents(odd_texts).withColumnRenamed("source", "item_id")
    for chars in (40, 10**6):
        found = decontamination.find_leaks(docs, tests, block_chars=chars).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(5, 5), (6, 5), (7, 1)]
        # Rows go whatever their ids: an item without id counts, and a document without id goes.
        clean = decontamination.clean_documents(docs, tests, block_chars=chars)
        assert clean.columns == docs.columns and clean.count() == len(odd_texts) - 5
    assert decontamination.find_leaks(docs, tests.limit(0)).count() == 0
    assert decontamination.find_leaks(docs.limit(0), tests).count() == 0


def test_repeated_patterns_take_bounded_memory():
    items = decontamination.Items([(1, "abcab" * 30), (2, "abcab" * 12 + "x" + "abcab" * 12), (3, "q" * 200)])
    text = "abcab" * 80_000 + " " + "q" * 100_000
    tracemalloc.start()
    found = items.leaks(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[1][0] == 0 and found[3][0] == 0 and found[2][0] == 1
    assert peak < 200 << 20


def test_places_across_stretches_are_found(items, monkeypatch):
    monkeypatch.setattr(decontamination, "STRETCH", 64)
    rng, index = random.Random(4), decontamination.Items(items)
    for n in range(len(items)):
        before = " ".join(rng.choice(PROSE) for _ in range(rng.randint(1, 40)))
        found = index.leaks(f"{before} {items[n][1]} {PROSE[0] * 30}")
        assert found[n] == (0, len(before) + 1 + len(decontamination.plain(items[n][1])))


# URLs


def plain_judge(captures, entries):
    out = set()
    for page, url, at in captures:
        keys = [] if url is None else covering(url)
        held = []
        for k in keys if at is not None else []:
            own = [e for e in entries if e[0] == k and e[1] is not None and e[1] <= at]
            if own and (last := max(own, key=lambda e: (e[1], e[2])))[3]:
                held.append((len(k), k, last[1]))
        best = max(held, default=(0, None, None))
        out.add((page, bool(held), len(held), best[1], best[2]))
    return out


def covering(url):
    if "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    for stop in "?#":
        rest = rest.split(stop)[0]
    name, _, path = rest.partition("/")
    name = name.rsplit("@", 1)[-1].lower().split(":")[0].rstrip(".")
    if not name:
        return []
    labels, parts = name.split("."), [p for p in path.split("/") if p]
    domains = [".".join(labels[i:]) for i in range(len(labels)) if i == 0 or len(labels) - i >= 2]
    return domains + [f"{name}/{'/'.join(parts[: i + 1])}" for i in range(len(parts))]


CAPTURE, ENTRY = "page_id long, url string, at long", "pattern string, at long, entry_id long, listed boolean"


def test_captures_of_one_page_at_several_times(spark):
    captures = [(1, "http://a.b/x", 10), (1, "http://a.b/x", 100), (1, "http://a.b/x", 200), (None, "http://a.b/x", 60)]
    entries = [("a.b", 50, 1, True), ("a.b", 150, 2, False), ("a.b/x", 150, 3, True)]
    got = url_filter.judge(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(entries, ENTRY)).collect()
    wanted = [(None, True, 1, "a.b", 50), (1, False, 0, None, None), (1, True, 1, "a.b", 50), (1, True, 1, "a.b/x", 150)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


@pytest.mark.parametrize("seed", [1, 2])
def test_judged_as_of_the_fetch(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "host"]
    urls = [f"http://{'U:p@' if rng.random() < 0.2 else ''}{rng.choice(hosts)}{rng.choice(['', ':80', '/', '/p/q', '/p?x=1', '/P#f'])}" for _ in range(150)]
    urls += ["http://HOT.example.com/p"] * 400
    captures = [(i, u, rng.randint(0, 60)) for i, u in enumerate(urls)]
    patterns = [*hosts, "a.example.com/p", "a.example.com/p/q", "hot.example.com", "hot.example.com/p"]
    entries = [(rng.choice(patterns), rng.randint(0, 60), i, rng.random() < 0.5) for i in range(200)]
    captures += [(900, None, 3), (901, "no url", 3), (902, "http://x.org", None), (903, "http:///p", 3), (903, "http:///p", 3)]
    entries += [(None, 1, 1000, True), ("x.org", None, 1001, True)]
    got = url_filter.judge(spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(entries, ENTRY))
    rows = [(r["page_id"], r["blocked"], r["n_active"], r["pattern"], r["listed_at"]) for r in got.collect()]
    assert len(rows) == len(set(captures)) and set(rows) == plain_judge(captures, entries)


def test_urls_empty_tables(spark):
    captures, entries = spark.createDataFrame([(1, "http://x.org", 5)], CAPTURE), spark.createDataFrame([("x.org", 1, 1, True)], ENTRY)
    assert url_filter.judge(captures.limit(0), entries).count() == 0
    assert not url_filter.judge(captures, entries.limit(0)).first()["blocked"]
    assert url_filter.judge(captures.withColumn("key", captures["url"]), entries).first()["blocked"]


# Language models


def plain_scores(texts, targets):
    slots = lm_scoring.Slots()
    words = {i: slots.of(t or "").tolist() for i, t in texts.items()}
    counts, total = (Counter(), Counter()), [0, 0]
    for i, w in words.items():
        for model in (0, 1) if i in targets else (0,):
            total[model] += len(w)
            counts[model].update(w)
            counts[model].update(zip([lm_scoring.START, *w], w, strict=False))
            counts[model][lm_scoring.START] += bool(w)
    out = {}
    for i, w in words.items():
        losses = []
        for model in (1, 0):
            c, n = counts[model], total[model]
            chances = [
                (c[h, x] + lm_scoring.STRENGTH * (c[x] + 1) / (n + lm_scoring.VOCABULARY)) / (c[h] + lm_scoring.STRENGTH)
                for h, x in zip([lm_scoring.START, *w], w, strict=False)
            ]
            losses.append(-sum(map(math.log, chances)) / len(w) if w else None)
        out[i] = losses
    return out


@pytest.mark.parametrize("block_chars", [400, 10**7])
def test_scores_in_blocks(spark, documents, block_chars):
    rng = random.Random(11)
    words = [w for p in PROSE for w in p.split()] + ["New word", "x.", "x"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for i in range(60)}
    targets = spark.createDataFrame([(i,) for i in range(0, 60, 4)] + [(7777,), (None,), (0,)], "doc_id long")
    got = lm_scoring.score_documents(documents(list(texts.items())), targets, block_chars).collect()
    wanted = plain_scores(texts, set(range(0, 60, 4)))
    assert len(got) == 60
    for r in got:
        target, background = wanted[r["doc_id"]]
        if target is None:
            assert r["n_tokens"] == 0 and r["score"] is None
        else:
            assert r["loss_target"] == pytest.approx(target) and r["loss_background"] == pytest.approx(background)
            assert r["score"] == pytest.approx(target - background)


def test_scores_count_real_words(spark, documents, monkeypatch):
    """Against counts of the words themselves; many words, and a vocabulary above its least size."""
    rng = random.Random(15)
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 1_000, raising=False)
    texts = {i: " ".join(f"w{int(rng.paretovariate(0.3)) % 40_000}" for _ in range(600)) for i in range(50)}
    targets = set(range(0, 50, 5))
    marks = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    got = lm_scoring.score_documents(documents(list(texts.items())), marks, 40_000).collect()
    words = {i: t.split() for i, t in texts.items()}
    size = len({w for own in words.values() for w in own})
    assert size > 1_000
    wanted = {}
    for held in (targets, set(texts)):
        c = Counter(w for i in held for w in words[i])
        c.update(p for i in held for p in zip([None, *words[i]], words[i], strict=False))
        c[None] = len(held)
        n, strength = sum(len(words[i]) for i in held), lm_scoring.STRENGTH
        for i, own in words.items():
            chances = [
                (c[h, w] + strength * (c[w] + 1) / (n + size)) / (c[h] + strength)
                for h, w in zip([None, *own], own, strict=False)
            ]
            wanted.setdefault(i, []).append(-sum(map(math.log, chances)) / len(own))
    assert len(got) == 50
    for r in got:
        assert [r["loss_target"], r["loss_background"]] == pytest.approx(wanted[r["doc_id"]])


def test_words_that_differ_have_keys_of_their_own():
    words = lm_scoring.Slots().of(" ".join(f"w{i}" for i in range(50_000)))
    assert len(set(words.tolist())) == 50_000
    assert len(set(lm_scoring.pairs(words).tolist())) == 50_000
    assert max(words.tolist()) < lm_scoring.START < min(lm_scoring.pairs(words).tolist())


def test_scores_odd_texts(spark, documents, odd_texts):
    targets = spark.createDataFrame([(7,)], "doc_id long")
    docs = documents(odd_texts).withColumnRenamed("source", "block")
    got = lm_scoring.score_documents(docs, targets).toPandas()
    assert len(got) == len(odd_texts)
    by_id = got.drop_duplicates("doc_id").set_index("doc_id")
    assert (by_id.loc[[0, 1, 2], "n_tokens"] == 0).all() and by_id.loc[[0, 1, 2], "score"].isna().all()
    assert np.isfinite(by_id.loc[4, "score"]) and by_id.loc[7, "score"] < by_id.loc[4, "score"]
    assert lm_scoring.score_documents(docs.limit(0), targets).count() == 0
    assert lm_scoring.score_documents(docs, targets.limit(0)).count() == len(odd_texts)


def test_scoring_searches_no_word_of_a_document(monkeypatch):
    """Places of words come from the sort that counts them, not from a search for each text."""
    texts = ["", None, *[f"a b c w{i} a b w{i % 7}" for i in range(60)], "   ", "b"]
    rows = pa.table({
        "block": pa.array([0] * (len(texts) + 2), pa.int64()),
        "doc_id": pa.array([*range(len(texts)), 3, 0], pa.int64()),
        "text": pa.array([*texts, None, None], pa.string()),
        "target": [False] * len(texts) + [True] * 2,
    })
    none = lm_scoring.count_block(1)((pa.scalar(0),), rows).slice(0, 0)
    searches = []
    plain = np.searchsorted
    monkeypatch.setattr(lm_scoring.np, "searchsorted", lambda *a, **k: searches.append(1) or plain(*a, **k))
    got = lm_scoring.score_block((400, 7), 1000)(rows, none).to_pydict()
    assert len(searches) <= 1
    words = [lm_scoring.Slots().of(x or "") for x in texts]
    for kept, total, name in ((words, 400, "loss_background"), (words[3:4], 7, "loss_target")):
        keys, n = lm_scoring.counted(kept)
        c = dict(zip(keys.tolist(), n.tolist(), strict=True))
        for w, loss in zip(words, got[name], strict=True):
            before = [lm_scoring.START, *w.tolist()]
            each = [
                -np.log((c.get(pair, 0) + lm_scoring.STRENGTH * (c.get(x, 0) + 1) / (total + 1000)) / (c.get(h, 0) + lm_scoring.STRENGTH))
                for h, x, pair in zip(before, w.tolist(), lm_scoring.pairs(w).tolist(), strict=False)
            ]
            assert loss is None if not each else abs(loss - np.mean(each)) < 1e-12
