"""What must not go wrong in silence, and results that must not depend on a size switch."""

import pytest

from checks.fixed import fixed_params
from rosterlink.functions.levels import LinkageModel
from rosterlink.operators import blocking, comparing, enriching, scoring, training
from rosterlink.operators.enriching import NAME
from rosterlink.sources import tables
from tests.test_linkage import make_records

COLUMNS = ["a", "b"]


@pytest.mark.parametrize("body", ["1,2\n3,4,5\n", "1,2\n6\n", '1,2\n"7,8\n9,10\n'])
def test_bad_csv_records_fail(spark, tmp_path, body):
    path = tmp_path / "g.csv"
    path.write_text("a,b\n" + body)
    with pytest.raises(Exception, match="(?i)malformed|bad record|FAILFAST"):
        tables.read_grants_csv(spark, str(path), COLUMNS).collect()


def test_bad_csv_records_can_be_kept(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6\n")
    rows = tables.read_grants_csv(spark, str(path), COLUMNS, bad_records="bad").collect()
    assert [(r["a"], r["bad"]) for r in rows] == [("1", None), ("3", "3,4,5"), ("6", "6")]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("F", f"name {i % 3}", "123", "p", "c") for i in range(6)]
    rows += [("N", f"other {i % 2}", "9", "q", "c") for i in range(4)]
    profiles = blocking.collapse_profiles(make_records(spark, rows))
    weighed = comparing.attach_term_frequencies(profiles)
    carry = comparing.tf_carried()
    pairs = blocking.candidate_pairs(weighed, carry=carry)
    return pairs, comparing.comparison_vectors(pairs, carry=carry)


@pytest.mark.parametrize("without", ["shard = 'N'", "level = 0"])
def test_pairs_without_parameters_fail(spark, vectors, without):
    pairs, compared = vectors
    part = fixed_params(spark).filter(f"not ({without})")
    assert scoring.score_pairs(compared, fixed_params(spark), threshold=0.0).count() == compared.count()
    with pytest.raises(Exception, match="no parameters for a pair"):
        scoring.score_pairs(compared, part, threshold=0.0).collect()
    if "shard" in without:
        with pytest.raises(Exception, match="no parameters for a pair"):
            scoring.reachable_pairs(pairs, part).collect()


def test_training_says_whether_it_settled(spark, vectors):
    _, compared = vectors
    model = LinkageModel()
    patterns = training.gamma_patterns(compared, model)
    u = training.u_by_shard(spark.createDataFrame([], "shard string, comparison string, level int, u double"), ["F", "N"], model)
    prior = {"F": 0.1, "N": 0.1}
    with pytest.raises(RuntimeError, match="no convergence in 1 rounds"):
        training.em_train(patterns, u, prior, model, max_rounds=1, tolerance=0.0)
    tried = training.em_train(patterns, u, prior, model, max_rounds=1, tolerance=0.0, must_converge=False)
    assert (tried.rounds, tried.converged) == (1, False)
    settled = training.em_train(patterns, u, prior, model)
    assert settled.converged and settled.rounds <= training.MAX_ROUNDS


def test_failed_answers_are_asked_again_once(spark):
    contexts = spark.createDataFrame([("a",), ("b",), ("c",)], f"{NAME} string")
    cache = spark.createDataFrame([("a", "old"), ("b", None)], f"{NAME} string, llm_result_json string")
    calls = spark.sparkContext.accumulator(0)

    def score(unseen):
        def answer(frames):
            for frame in frames:
                calls.add(len(frame))
                yield frame.assign(llm_result_json="new")

        return unseen.mapInPandas(answer, f"{NAME} string, llm_result_json string")

    merged = enriching.verdict_cache(cache, contexts, score)
    for _ in range(2):
        assert {tuple(r) for r in merged.collect()} == {("a", "old"), ("b", "new"), ("c", "new")}
    assert calls.value == 2


def test_whole_error_texts_are_kept():
    long = "x" * 5000
    outcome = enriching.ask(lambda p: enriching.Reply(500, long), "p", pause=lambda s: None)
    assert outcome["error"] == long


def test_number_of_values_shown_is_a_parameter(spark):
    contexts = spark.createDataFrame([("x", 1, False)], f"{NAME} string, n long, has_bn boolean")
    values = spark.createDataFrame([("x", "org", f"o{i}") for i in range(5)], f"{NAME} string, field string, value string")
    for most in (1, 4):
        prompt = enriching.render_prompt(contexts, values, most_values={"org": most}).first()["prompt"]
        assert prompt.endswith("funded_by: " + ", ".join(f"o{i}" for i in range(most)))


def test_buckets_grow_with_the_prompts():
    assert [enriching.bucket_digits(n) for n in (0, 10**6, 10**9, 10**11)] == [3, 3, 4, 5]


@pytest.mark.parametrize("max_pairs", [10, 300, 499_999, 600_000])
def test_sample_is_the_least_digests_at_any_size(spark, max_pairs):
    import hashlib

    records = make_records(spark, [("F", f"n{i}", None, None, None) for i in range(400)])
    ids = [r["unique_id"] for r in records.collect()]
    got = {r["unique_id"] for r in training.sample_records(records, max_pairs=max_pairs).collect()}
    most = int((1 + (1 + 8 * max_pairs) ** 0.5) // 2)
    ranked = sorted(ids, key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
    assert got == set(ranked[:most])


def test_blocks_need_no_broadcast_limit(spark):
    records = make_records(spark, [("F", f"n{i}", None, None, None) for i in range(20)])
    plan = blocking.block_pairs(blocking.collapse_profiles(records))._jdf.queryExecution().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan


def test_a_hanging_call_ends_and_the_last_body_stays(spark):
    import time

    rows = [("b", i, [f"n{i}"], f"p{i}") for i in range(3)]
    batches = spark.createDataFrame(rows, "bucket string, batch_no bigint, names array<string>, prompt string")

    def score(prompt):
        if prompt == "p0":
            time.sleep(60)
        if prompt == "p1":
            return enriching.Reply(429, "slow down")
        return enriching.Reply(200, "[1]")

    began = time.time()
    scored = enriching.score_batches(
        batches, score, threads=3, max_retries=0, pause=lambda s: None, call_timeout=1.0
    )
    got = {r["names"][0]: r for r in scored.collect()}
    assert time.time() - began < 40
    assert got["n0"]["status"] == "exception" and "Timeout" in got["n0"]["error"]
    assert (got["n1"]["status_code"], got["n1"]["body"]) == (429, "slow down")
    assert got["n2"]["status"] == "success"
    assert {"status_code", "body"} <= set(enriching.verdict_rows(scored).columns)


@pytest.mark.parametrize(("partitions", "threads", "max_calls"), [(None, 8, 200), (500, 8, 200), (4, 500, 100)])
def test_calls_at_a_time_have_a_limit(spark, partitions, threads, max_calls):
    batches = spark.createDataFrame([("b", 1, ["n"], "p")], "bucket string, batch_no bigint, names array<string>, prompt string")
    scored = enriching.score_batches(
        batches, lambda p: enriching.Reply(200, "[]"), partitions, threads, max_calls=max_calls
    )
    assert scored.rdd.getNumPartitions() * min(threads, max_calls) <= max_calls
