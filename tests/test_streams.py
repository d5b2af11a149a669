"""Streams that carry overflow, and loaders that stop and go on, against plain folds for any split into batches."""

import random

import pytest

from curata.streaming import loader, steps

ROLLOUTS = "id long, prompt string, score double"


def put(spark, path, parts, schema):
    for rows in parts:  # a file each, in this order
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def plain_groups(rows, wanted, solved_at):
    out, held, solved, number = [], {}, set(), {}
    for i, prompt, score in sorted(rows):
        if prompt in solved:
            continue
        held.setdefault(prompt, []).append((i, score))
        if len(held[prompt]) == wanted:
            got = held.pop(prompt)
            known = [s for _, s in got if s is not None]
            mean = sum(known) / len(known) if known else None
            done = mean is not None and mean >= solved_at
            out.append((prompt, number.get(prompt, 0), got[0][0], wanted, mean, len(set(known)) > 1, done))
            number[prompt] = number.get(prompt, 0) + 1
            if done:
                solved.add(prompt)
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [[12, 12, 12], [30, 1, 5], [36], [5, 7, 11, 13]], ids=str)
def test_groups_for_any_split(spark, tmp_path, sizes):
    """One prompt has a third of all rollouts; nulls of both kinds, ties of scores, a solved prompt with later rollouts."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([0.0, 0.25, 1.0, None])) for i in range(30)]
    rows += [(i, "d", 1.0) for i in range(30, 36)]
    parts, at = [], 0
    for n in sizes:
        parts.append(rng.sample(rows[at : at + n], n))
        at += n
    put(spark, f"{tmp_path}/in", parts, ROLLOUTS)
    stream = steps.rollout_stream(spark, f"{tmp_path}/in", ROLLOUTS)
    groups = steps.running_groups(stream, "prompt", "score", 3, 0.9, "id")
    steps.run_available(groups, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.schema(groups.schema).parquet(f"{tmp_path}/out").collect()
    want = plain_groups(rows, 3, 0.9)
    assert sorted([(*r[:4], r.mean, r.varied, r.solved) for r in got], key=repr) == [(*w[:4], None if w[4] is None else round(w[4], 6), *w[5:]) for w in want]
    assert [w for w in want if w[0] == "d"] == [("d", 0, 30, 3, 1.0, False, True)]


def test_groups_go_on_after_a_stop(spark, tmp_path):
    """A query that stops and starts again with its checkpoint has the left-over rollouts and the exclusions."""
    for part in ([(0, "a", 1.0), (1, "b", 0.0), (2, "a", 0.5)], [(3, "b", 1.0), (4, "a", 0.0), (5, "a", 1.0), (6, "a", 1.0), (7, "a", 0.0)]):
        put(spark, f"{tmp_path}/in", [part], ROLLOUTS)
        stream = steps.rollout_stream(spark, f"{tmp_path}/in", ROLLOUTS)
        groups = steps.running_groups(stream, "prompt", "score", 2, 0.75, "id")
        steps.run_available(groups, f"{tmp_path}/out", f"{tmp_path}/state")
    out = spark.read.schema(groups.schema).parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, out.collect())) == [("a", 0, 0, 2, 0.75, True, True), ("b", 0, 1, 2, 0.5, True, False)]
    prompts = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "prompt string")
    assert sorted(r.prompt or "" for r in steps.unsolved(prompts, out, "prompt").collect()) == ["", "b", "c"]


def plain_batches(lengths, per_batch, budget):
    """A queue that holds what a batch leaves over, as a loader has it."""
    out, overflow, batch = {}, [], 0
    chunks = [list(range(i, min(i + per_batch, len(lengths)))) for i in range(0, len(lengths), per_batch)]
    while chunks or overflow:
        pool = overflow + (chunks.pop(0) if chunks else [])
        take, tokens = 0, 0
        while take < len(pool) and (take == 0 or tokens + lengths[pool[take]] <= budget):
            tokens += lengths[pool[take]]
            take += 1
        for place, i in enumerate(pool[:take]):
            out[i] = (batch, place)
        overflow, batch = pool[take:], batch + 1
    return out


@pytest.mark.parametrize("sizes", [[40], [1, 39], [13, 13, 14]], ids=str)
@pytest.mark.parametrize("budget", [10, 25, 1000])
def test_overflow_for_any_split(spark, tmp_path, sizes, budget):
    rng = random.Random(budget)
    rows = [(i, i % 2, rng.choice([None, 0, 3, 8, 30])) for i in range(40)]
    parts, at = [], 0
    for n in sizes:
        parts.append(rows[at : at + n][::-1])
        at += n
    schema = "id long, rank long, tokens long"
    put(spark, f"{tmp_path}/in", parts, schema)
    out = steps.budgeted_batches(steps.rollout_stream(spark, f"{tmp_path}/in", schema), "rank", "id", "tokens", 4, budget)
    steps.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r.id: (r.batch, r.place) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    for rank in (0, 1):
        mine = [r for r in rows if r[1] == rank]
        want = plain_batches([r[2] or 0 for r in mine], 4, budget)
        assert {k: got[r[0]] for k, r in enumerate(mine)} == want


def test_loader_goes_on(spark, tmp_path):
    """A loader that stops after any batch and resumes gives the same rows; exclusions hold from the next epoch on."""
    path = str(tmp_path / "state")
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(50)] + [(None, "x")], "id long, place string").drop("place")
    every = lambda epoch, excluded=None, start=0: sorted(map(tuple, loader.batches(prompts, "id", epoch, 8, 3, excluded, start).collect()))
    assert loader.load(spark, path, "id")[0] == loader.State(-1, 0, 0)
    first = every(0)
    assert len(first) == 48 and {r[2] for r in first} == set(range(6))
    bad = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    for step in range(5):
        loader.save(spark, path, loader.State(step, 0, step + 1), bad.where(f"id = {step}"))
        at, excluded = loader.load(spark, path, "id")
        assert at == loader.State(step, 0, step + 1)
        assert every(at.epoch, excluded, at.batch) == [r for r in first if r[2] > step]
    assert loader.clean_up(spark, path, "id", keep=2) == [0, 1, 2]
    assert loader.clean_up(spark, path, "id", keep=2) == []
    at, excluded = loader.load(spark, path, "id")
    assert at == loader.State(4, 0, 5) and sorted(map(tuple, excluded.collect())) == [(1, 0), (2, 0)]
    second = every(1, excluded)
    assert not {1, 2} & {r[0] for r in second} and len(second) == 48
    assert [r[0] for r in second] != [r[0] for r in first]
    with pytest.raises(ValueError):
        loader.load(spark, path, "id", step=1)
    loader.save(spark, path, loader.State(3, 0, 4))  # a resumed loader leaves the later state behind
    assert loader.load(spark, path, "id")[0] == loader.State(3, 0, 4)


def test_unfinished_state_does_not_count(spark, tmp_path):
    path = str(tmp_path / "state")
    loader.save(spark, path, loader.State(0, 0, 3))
    spark.createDataFrame([(5, 0)], "id long, epoch long").write.parquet(f"{path}/step=1/excluded")
    at, excluded = loader.load(spark, path, "id")
    assert at == loader.State(0, 0, 3) and excluded.collect() == []


def test_means_add_in_order(spark, tmp_path):
    """Eight scores whose plain sum stays just under 480: SQL's mean does not reach 60, so the prompt goes on."""
    scores = [118.21, 37.48, 96.85, 16.74, 52.0, 5.01, 3.65, 150.06]
    put(spark, f"{tmp_path}/in", [[(i, "a", s) for i, s in enumerate(scores + [60.0] * 9)]], ROLLOUTS)
    groups = steps.running_groups(steps.rollout_stream(spark, f"{tmp_path}/in", ROLLOUTS), "prompt", "score", 8, 60, "id")
    steps.run_available(groups, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.schema(groups.schema).parquet(f"{tmp_path}/out").orderBy("number").collect()
    assert [(r.first, r.mean, r.solved) for r in got] == [(0, 60.0, False), (8, 60.0, True)]
