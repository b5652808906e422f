"""Live counters of all families: several batches equal one pass, files stay bounded, repeated work changes nothing."""

import os
import random

from shroudline.streaming import counters as C, jobs as J

SHAPE = ", ".join(f"{name} {kind}" for name, kind in C.FIELDS)


def events(n, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        row = dict.fromkeys(name for name, _ in C.FIELDS)
        kind = r.randrange(5)
        if kind == 0:
            row["audit"] = (r.choice(["request", "response"]), r.choice(["allow", "review"]), r.choice(["builtin", "opa_error_fallback", "review_override_approved"]), ["a", "b"][: r.randrange(3)], r.choice([None, "detector"]), None)
        elif kind == 1:
            row["auth_failure"] = r.choice(["missing", "invalid"])
        elif kind == 2:
            row["resolution"] = "approved"
        elif kind == 3:
            row |= {"model": r.choice(["m", None]), "prompt_tokens": 3, "completion_tokens": r.choice([0, 5])}
        else:
            row["timing"] = ("request", "json", r.choice([0.004, 0.02, 30.0, None]))
        out.append(tuple(row.values()))
    return out


def plain(rows):
    sums = {}

    def add(*key, n=1.0):
        key = (*key, *[None] * (4 - len(key)))
        sums[key] = sums.get(key, 0.0) + n

    for audit, failure, resolution, model, used, prompt, completion, timing in rows:
        if audit:
            way, decision, source, labels, stage, kind = audit
            add("requests_total", way, decision)
            add("policy_decisions_total", way, decision, source)
            if source == "opa_error_fallback":
                add("processing_fallback_total", source)
            if stage:
                add("proxy_errors_total", stage, kind)
            if decision == "review" and way == "request":
                add("review_events_total", "created")
            if source == "review_override_approved":
                add("review_events_total", "override_approved")
            for label in labels:
                add("detections_total", way, label)
        if failure:
            add("auth_failures_total", failure)
        if resolution:
            add("review_events_total", resolution)
        if model:
            add("llm_requests_total", model)
        if prompt is not None:
            add("llm_tokens_total", used or "unknown", "prompt", n=prompt)
            add("llm_tokens_total", used or "unknown", "completion", n=completion)
        if timing and timing[2] is not None:
            add("seconds_count", *timing[:2])
            add("seconds_sum", *timing[:2], n=timing[2])
            for le in C.M.BUCKETS:
                if timing[2] <= le:
                    add("seconds_bucket", *timing[:2], str(le))
    return {k: round(v, 6) for k, v in sums.items()}


def got(df):
    return {(r.family, r.k1, r.k2, r.k3): round(r.n, 6) for r in df.collect()}


def folders(path):
    return sorted(int(x.split("=")[1]) for x in os.listdir(path) if "=" in x) if os.path.isdir(path) else []


def test_one_pass(spark):
    rows = events(300)
    assert got(C.counted(spark.createDataFrame(rows, SHAPE))) == plain(rows)
    assert got(C.counted(spark.createDataFrame([], SHAPE))) == {}


def test_batches_are_added_up_and_old_ones_go(spark, tmp_path):
    rows = events(240, 2)
    folder = J.work_dir(spark, "t")
    for i in range(12):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/part-{i:02}")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    C.run_all_counters(stream, folder, every=3).awaitTermination()
    assert got(C.all_counters(spark, folder)) == plain(rows)
    batches, sums = folders(f"{folder}/data"), folders(f"{folder}/sums")
    assert sums == [8, 11] and batches == [9, 10, 11]
    C._add_up(spark, folder, 11, 3)  # the batch runs again after a stop
    assert got(C.all_counters(spark, folder)) == plain(rows)


def test_an_unfinished_sum_is_not_read(spark, tmp_path):
    rows = events(40, 3)
    folder = str(tmp_path)
    for i in range(2):
        C.counted(spark.createDataFrame(rows[i * 20 : i * 20 + 20], SHAPE)).write.parquet(f"{folder}/data/batch_id={i}")
    os.makedirs(f"{folder}/sums/upto=1")
    assert got(C.all_counters(spark, folder)) == plain(rows)
    assert got(C.all_counters(spark, f"{folder}/nothing")) == {}
