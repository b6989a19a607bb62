from __future__ import annotations

import hashlib
import random

import pytest

from panelspark.llm import mixing, ranges, sharding
from panelspark.llm.storage import fresh_path, stored, with_row_key


def water(sizes, weights, budget, repeats):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_names, target = budget * sum(sizes.values()), set(names), {}
    while open_names:
        share = {s: left * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
        over = {s for s in open_names if share[s] >= repeats * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_names -= over
    return target


@pytest.mark.parametrize("rows_a_part", [20_000, 40])
def test_targets_and_shares(spark, monkeypatch, rows_a_part):
    monkeypatch.setattr(ranges, "PART_ROWS", rows_a_part)
    rng = random.Random(4)
    rows = [(i, rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"]), " ".join("w" for _ in range(rng.randint(0, 60)))) for i in range(900)]
    rows += [(5000, "tiny", "one two"), (5001, "empty", None), (5002, "a", None), (None, "a", "x y z"), (7, "a", "again again")]
    df = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id long, source string, text string, target int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes, (3, 1, 2), 1.5, 2)
    of = {i: s for i, s, _ in rows if i not in (7, None)}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        if r["doc_id"] in of:
            assert r["target"] == pytest.approx(want[of[r["doc_id"]]]) and r["source_size"] == sizes[of[r["doc_id"]]]
            taken[of[r["doc_id"]]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 150, s
    total = sum(r["taken"] for r in got)
    assert 1.5 * sum(sizes.values()) - 60 <= total <= 1.5 * sum(sizes.values())
    again = {tuple(r) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {tuple(r) for r in got}


def test_mixed_rows_follow_the_copies(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 17)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}


def test_repeated_and_null_ids_get_their_own_copies(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PART_ROWS", 30)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"s{i % 2}", f"w{i} " * (i % 9), i) for i in range(150)] + [(None, "s0", "x y", 999)] * 20
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, row long")
    copies = sorted((r["doc_id"] or 0, r["size"], r["copies"]) for r in mixing.mix(df).collect())
    out = mixing.mixed(df.repartition(3)).collect()
    assert len(out) == sum(c for _, _, c in copies) and sum(len(r["text"].split()) for r in out) == sum(n * c for _, n, c in copies)
    taken = {}
    for r in out:
        taken[r["row"]] = taken.get(r["row"], 0) + 1
    assert max(n for k, n in taken.items() if k != 999) <= 2 and taken[999] <= 40


@pytest.mark.parametrize("from_files", [False, True])
def test_ends_of_sources_take_the_rows_of_the_sequence(spark, monkeypatch, from_files):
    """Without order no text moves: the same rows, whole groups of equal rows cut at the right number."""
    monkeypatch.setattr(ranges, "PART_ROWS", 40)
    rows = [(None if i % 5 == 0 else i, None if i % 7 == 0 else f"s{i % 3}", f"w{i} " * (i % 11), i, 1) for i in range(200)] + [(5, "s1", "a b c", 999, 2)] * 60
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, file long, `index` int").repartition(4)
    if from_files:
        path = fresh_path(spark, "mix-test")
        df.write.parquet(path)
        df = spark.read.parquet(path).where("doc_id is null or doc_id >= 0")
    plain, inside = mixing.mixed(df, ordered=False), mixing.mixed(df)
    assert plain.columns == df.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, plain.collect())) == sorted(map(key, inside.collect()))
    copies = mixing.mix(df).where("doc_id = 5").agg({"copies": "sum"}).first()[0]
    assert plain.where("doc_id = 5").count() == copies


def test_row_keys_are_stable_and_distinct(spark):
    df = spark.range(1000).repartition(5)
    for frame in (df, stored(df, "keys").where("id % 3 != 0"), df.join(spark.range(10).withColumnRenamed("id", "b"))):
        keyed = with_row_key(frame)
        assert keyed.select("file", "index").distinct().count() == frame.count() == keyed.count()
    kept = stored(df, "keys")
    a, b = (with_row_key(x).select("all.id", "file", "index") for x in (kept, kept.where("id >= 0")))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_sieve_keeps_all_that_are_needed(spark):
    df, ids = spark.range(5000), spark.range(0, 5000, 7).withColumnRenamed("id", "needed")
    some, others = ({r["id"] for r in part.collect()} for part in ranges.sifted(df, "id", ids, "needed"))
    assert set(range(0, 5000, 7)) <= some and len(some) < 800 and not some & others and len(some) + len(others) == 5000


def test_the_sequence_is_the_fair_queue(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PART_ROWS", 50)
    rng = random.Random(11)
    rows = [(i, rng.choice("abc"), "w " * rng.randint(1, 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    info = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    queues = {}
    for i, s, t in rows:
        queues.setdefault(s, []).append((int(hashlib.md5(f"{i}|17".encode()).hexdigest()[:15], 16), i, len(t.split())))
    merged = []
    for s, queue in queues.items():
        sent, whole = 0, sum(n for _, _, n in queue)
        for k, i, n in sorted(queue):
            sent += n
            merged += [((sent + copy * whole) / info[i]["target"], k, i, n) for copy in range(2)]
    total, want = 0, []
    for _, _, i, n in sorted(merged):
        total += n
        if total > 1.5 * sum(info[i]["size"] for i in info):
            break
        want.append(i)
    assert [r["doc_id"] for r in mixing.mixed(df).collect()] == want
    assert all(r["first_position"] == (want.index(i) + 1 if i in want else None) for i, r in info.items())


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0 and sharding.assign(df).count() == 0
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, "a", None)], df.schema)).collect()] == [0]


def brute_shards(keys, limit, depth=0):
    """Split a bucket by its next bit while it is too large."""
    if sum(b for _, b in keys) <= limit or depth == 60:
        return {k: depth for k, _ in keys}
    out = {}
    for bit in (0, 1):
        part = [x for x in keys if (x[0] >> (59 - depth)) & 1 == bit]
        if part:
            out |= brute_shards(part, limit, depth + 1)
    return out


@pytest.mark.parametrize("limit", [300, 2_000, 10**9])
def test_shards_equal_bucket_splitting(spark, limit):
    rng = random.Random(6)
    rows = [(i, "é" * rng.randint(0, 40)) for i in range(700)] + [(9000, "x" * 5000), (9001, None), (None, "n")] + [(9002, "y" * 90)] * 50 + [(None, f"n{k}") for k in range(40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, shard string")
    got = sharding.assign(df, limit=limit).collect()
    assert len(got) == len(rows)
    seen: dict[tuple, int] = {}
    keys = []
    for i, t in rows:
        n = seen[i, t] = seen.get((i, t), -1) + 1
        said = f"{'' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}|{n}|0"
        keys.append((int(hashlib.md5(said.encode()).hexdigest()[:15], 16), i, len((t or "").encode())))
    depth = brute_shards([(k, b) for k, _, b in keys], limit)
    totals: dict[str, int] = {}
    want = []
    for k, i, b in keys:
        shard = format(k, "060b")[: depth[k]]
        totals[shard] = totals.get(shard, 0) + b
        want.append((i or 0, b, shard, depth[k]))
    assert sorted((r["doc_id"] or 0, r["bytes"], r["shard"], r["depth"]) for r in got) == sorted(want)
    for r in got:
        assert r["shard_bytes"] == totals[r["shard"]] and r["oversized"] == (r["shard_bytes"] > limit)
        assert not r["oversized"] or r["bytes"] > limit


def test_null_and_repeated_ids_split_to_the_limit(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PART_ROWS", 100)
    df = spark.createDataFrame([(None, "t" * 100)] * 2000 + [(1, f"u{k}" * 20) for k in range(200)], "doc_id long, text string")
    got = sharding.assign(df, limit=10_000).collect()
    assert len(got) == 2200 and max(r["shard_bytes"] for r in got) <= 10_000
    again = sharding.assign(df.repartition(7), limit=10_000).collect()
    assert sorted(tuple(map(str, r)) for r in again) == sorted(tuple(map(str, r)) for r in got)


def test_written_shards_hold_every_row(spark):
    rows = [(i, "t" * 50) for i in range(90)] + [(None, "t" * 50)] * 5 + [(3, "other")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = sharding.write_shards(df, fresh_path(spark, "shards"), limit=700)
    back = spark.read.parquet(path)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((r[0] or -1, r[1]) for r in rows) and back.select("shard").distinct().count() > 5
