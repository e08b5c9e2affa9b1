"""Encoding, language, secrets and toxicity against plain versions of the same."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlink.llm import bpe, language_id, secret_scan, toxicity
from rosterlink.llm.queries import QUERIES, byte_vocabulary
from tests.conftest import SMALL
from tests.llm.conftest import PROSE

PIECES = [*"ab's lré中😀1²\n\t\x1c\x85՘़", "<|endoftext|>", "  ", "'ll", "aaaa"]
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(byte_vocabulary()))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(byte_vocabulary())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_bpe_is_the_library(codec, library, text):
    ids = next(codec.encoded([text]))
    wanted = library.encode(text, add_special_tokens=False)
    assert ids.tolist() == wanted.ids
    assert codec.decode(ids) == library.decode(wanted.ids, skip_special_tokens=False)


def test_bpe_batches_do_not_matter(codec, monkeypatch, library):
    texts = [random.Random(i).choice(PROSE) * i for i in range(30)]
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    for ids, text in zip(codec.encoded(texts), texts, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_parts_of_the_index_do_not_matter(codec, monkeypatch, library):
    for name, value in (("INDEXED_BYTES", 16), ("BATCH_WORDS", 4), ("CACHED_WORDS", 9)):
        monkeypatch.setattr(bpe, name, value)
    texts = ["".join(random.Random(i).choices([*PIECES, *PROSE[0]], k=60)) for i in range(40)]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    # Two readers of one codec, in turn, and the cache starts anew in between.
    both = zip(codec.encoded(texts), codec.encoded(iter(texts)), strict=True)
    assert [(a.tolist(), b.tolist()) for a, b in both] == [(w, w) for w in wanted]


def test_bpe_keeps_no_words_of_waiting_texts(codec):
    texts = [" ".join(PROSE) * 40] * 200  # 2 million characters, 420,000 words, few different ones
    tracemalloc.start()
    try:
        assert sum(1 for _ in codec.encoded(texts)) == 200
        assert tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()


def test_op1_on_the_table(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    got = QUERIES["op1_bpe"](spark, SMALL).toPandas().set_index("doc_id")
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got.loc[doc].tolist() == [
            len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))
        ]


def test_bpe_columns_and_odd_texts(spark, documents, odd_texts, library):
    docs = documents(odd_texts)
    path = byte_vocabulary()
    coded = docs.withColumn("ids", bpe.encoder(spark, path)("text"))
    back = coded.withColumn("again", bpe.decoder(spark, path)("ids")).toPandas()
    assert (back["again"] == back["text"].fillna("")).all()
    report = bpe.bpe_documents(docs.withColumnRenamed("lang", "n_tokens"), path).toPandas()
    assert len(report) == len(odd_texts)
    assert report[report["doc_id"] == 0]["n_tokens"].item() == 0
    assert bpe.bpe_documents(docs.limit(0), path).count() == 0


# Language


def test_language_by_families(spark):
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    held = both[both["held_out"]]
    assert len(got) == len(docs) and len(held) > 100
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_never_sees_held_out_labels(spark, documents):
    docs = documents([(i, PROSE[i % 3]) for i in range(40)])
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(language_id.held_out(), "zz").otherwise(F.lit("en")))
    got = language_id.predict_documents(wrong).toPandas()
    assert set(got["lang_pred"]) == {"en"} and got["held_out"].any()


def test_language_odd_texts(documents, odd_texts):
    got = language_id.predict_documents(documents(odd_texts)).toPandas()
    by_id = got.drop_duplicates("doc_id").set_index("doc_id")
    assert by_id.loc[[0, 1, 2], "lang_pred"].tolist() == ["und"] * 3
    assert by_id.loc[[0, 1, 2], "score"].tolist() == [0.0] * 3
    assert by_id.loc[5, "lang_pred"] == "en" and len(got) == len(odd_texts)
    assert language_id.predict_documents(documents([])).count() == 0
    unlabelled = documents(["some text"]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert language_id.predict_documents(unlabelled).first()["lang_pred"] == "und"


def test_families_join_the_closest():
    rng = np.random.default_rng(1)
    a, b = rng.random(50), rng.random(50)
    centres = {"a1": a, "a2": a + 0.01 * rng.random(50), "b1": b, "b2": b + 0.01 * rng.random(50)}
    assert sorted(language_id.families_of(centres, 2)) == [["a1", "a2"], ["b1", "b2"]]


# Secrets


def plain_base(text):
    patterns = [
        ("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8),
        ("access", r"(AKIA[A-Z0-9]+)", 16),
        ("hex", r"([0-9a-f]+)", 32),
    ]
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, p, least) in enumerate(patterns)
             for m in re.finditer(p, text) if len(m[1]) >= least]
    return [s for _, _, s in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "API_KEY", "apikey", "ſecret", "toKen", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef01", "0" * 30, "\n", "é", "-x_9"]), max_size=14).map("".join))
def test_base_spans(text):
    assert secret_scan.show(secret_scan.base_spans(text)) == ",".join(plain_base(text))


def test_markov_adds_spans_and_keeps_base(spark, documents):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(20)]
    rows = [f"{PROSE[i % 3]} token = {h} done_with_everything" for i, h in enumerate(hexes)]
    rows += [f"see {k} there" for k in keys] + ["characteristically_ordinary_identifier2 and internationalisation"] * 40
    got = secret_scan.find_secrets(documents(rows)).orderBy("doc_id").toPandas()
    assert (got["n_assign"][:60] == 1).all() and (got["n_hex"][:60] == 1).all()
    assert got["n_markov"][60:80].sum() >= 16 and got["n_markov"][80:].sum() == 0
    assert got["base_sha256"].tolist() == [digest(",".join(plain_base(t))) for t in rows]


def test_rare_secrets_train_the_model(documents):
    rng = random.Random(6)

    def digits(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    rows = [f"plain_words {PROSE[i % 3]} number {i}" for i in range(2_000)]
    rows += [f"token = {digits(40)}" for _ in range(20)] + [f"see {digits(24)} there" for _ in range(20)]
    got = secret_scan.find_secrets(documents(rows), sample=20).orderBy("doc_id").toPandas()
    assert got["n_markov"][2_020:].sum() >= 16 and got["n_markov"][:2_000].sum() == 0


def test_keys_of_letters_only_are_scored(documents):
    rng = random.Random(7)

    def key(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [f"{PROSE[i % 3]} token = {key(letters + '0123456789', 40)}" for i in range(200)]
    rows += [f"see {key(letters, 28)} there" for _ in range(20)]
    rows += ["internationalisation of characteristically ordinary things 4263429643439180"] * 40
    got = secret_scan.find_secrets(documents(rows)).orderBy("doc_id").toPandas()
    assert got["n_markov"][200:220].sum() >= 18 and got["n_markov"][220:].sum() == 0


def test_markov_spans_are_those_of_a_plain_sum(documents):
    """Spans of the table against sums of logs over pairs of characters, one by one."""
    rng = random.Random(8)

    def key(n):
        return "".join(rng.choice("0123456789abcdefXYZ") for _ in range(n))

    rows = [f"{PROSE[i % 3]} secret: {key(30)} and some_ordinary_identifier_{i}" for i in range(60)]
    rows += [f"{key(20)} ordinary_but_long_identifier {key(17)}" for _ in range(30)]
    table = documents(rows)
    counts = {True: Counter(), False: Counter()}
    for text in rows:
        found = list(secret_scan.secret_values(text))
        for token in [t for t, _, _ in found]:
            counts[True].update(zip("\n" + token, token))
        for token in secret_scan.plain_tokens(text, [(a, b) for _, a, b in found]):
            counts[False].update(zip("\n" + token, token))
    states = secret_scan.ALPHABET + "\n"

    def chance(kind, a, b):
        return (counts[kind][a, b] + 0.5) / (sum(counts[kind][a, x] for x in states) + 0.5 * len(states))

    wanted = []
    for text in rows:
        spans = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            inside = any(a < m.end() and m.start() < b for _, a, b in secret_scan.base_spans(text))
            pairs = list(zip("\n" + m[0], m[0]))
            mean = sum(math.log(chance(True, *p) / chance(False, *p)) for p in pairs) / len(pairs)
            if not inside and mean >= 0.5 and re.search("[A-Za-z]", m[0]):
                spans.append(f"markov:{m.start()}:{m.end()}")
        wanted.append(spans)
    got = secret_scan.find_secrets(table).orderBy("doc_id").toPandas()
    assert [[s for s in x.split(",") if s.startswith("markov")] for x in got["spans"]] == wanted
    assert sum(map(len, wanted)) > 40


def test_many_copies_of_a_secret_train_the_model(documents):
    rows = [f"token = {'0123456789abcdef' * 2}"] * 500
    assert secret_scan.train(documents(rows), sample=50) is not None


def test_no_secret_to_train_on_is_said(documents):
    with pytest.warns(UserWarning, match="no document holds a secret"):
        assert secret_scan.train(documents(PROSE)) is None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "API_KEY", "toKen", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef01", "0" * 30, "é"]), max_size=14).map("".join))
def test_texts_with_base_spans_are_sampled(text):
    assert re.search(secret_scan.HOLDS_SECRET, text, re.ASCII) or not secret_scan.base_spans(text)


def test_secrets_odd_texts(documents, odd_texts):
    got = secret_scan.find_secrets(documents(odd_texts)).toPandas()
    assert len(got) == len(odd_texts) and (got["spans"] == "").all()
    assert set(got["base_sha256"]) == {digest("")}
    assert secret_scan.find_secrets(documents([])).count() == 0


# Toxicity


@pytest.fixture(scope="module")
def labelled(spark, documents):
    rng = random.Random(5)
    bad = ["scoundrel", "scoundrels", "villain", "rotter", "wretch"]
    rows, labels = [], []
    for i in range(240):
        words = [w for _ in range(3) for w in rng.choice(PROSE).split()]
        toxic = i % 3 == 0
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_found_where_held_out(labelled):
    docs, labels = labelled
    known = labels.filter("doc_id % 4 <> 0")
    got = toxicity.grade_documents(docs, known).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    held = got[got["doc_id"] % 4 == 0]
    assert ((held["truth"] == 1) == held["toxic"]).mean() > 0.95
    assert got["severity"].between(0, toxicity.GRADES).all()


def test_toxicity_grades_rise_and_cuts_are_ordered():
    rng = np.random.default_rng(3)
    n, grade = 600, np.repeat([0, 1, 2, 3], 150)
    counts = np.maximum(0, grade * 2 + rng.integers(-1, 2, n)).astype(float)
    w, cuts = toxicity.fit_cumulative_link(np.arange(n), np.zeros(n, int), counts, grade, 1)
    assert w[0] > 0 and (np.diff(cuts) > 0).all()
    model = toxicity.OrdinalModel({"x": w[0]}, cuts.tolist())
    expected = model.at_least(counts * w[0]).sum(1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.85


def test_toxicity_odd_texts(spark, labelled, documents, odd_texts):
    _, labels = labelled
    docs = documents(odd_texts)
    none = toxicity.grade_documents(docs, labels.limit(0)).toPandas()
    assert (none["severity"] == 0).all() and not none["toxic"].any()
    trained = labelled[0].unionByName(documents([(1000 + i, t) for i, (_, t) in enumerate(odd_texts)]))
    got = toxicity.grade_documents(trained, labels).filter("doc_id >= 1000").toPandas()
    assert len(got) == len(odd_texts) and not got["toxic"].any()
    assert toxicity.grade_documents(docs.limit(0), labels).count() == 0
    left = toxicity.drop_toxic(*labelled)
    assert left.columns == labelled[0].columns and 150 <= left.count() <= 172
