from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import crf, langid, ordinal, outliers, queries
from panelspark.llm.text import chunks, mix

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    got = queries.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and len(held) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def bayes_counts(text, bits, orders):
    """Buckets of a text's n-grams, one by one."""
    mask = (1 << 64) - 1

    def finish(x):
        x ^= x >> 31
        x = x * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & mask
        return (x ^ x >> 32) >> (64 - bits)

    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()) + " ").lstrip(" ")
    out = []
    for n in orders:
        padded = " " * (n - 1) + letters
        for k in range(len(letters)):
            state = n
            for back in range(n):
                state = state * 0x100000001B3 & mask ^ ord(padded[k + n - 1 - back])
            out.append(finish(state))
    return out


def test_language_equals_plain_naive_bayes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = [(10_000, "Straße ÀÉ x", "de"), (10_001, "the", None), (10_002, "12", "en"), (10_003, "der Hund " * 3000, None), (10_004, None, "en")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    rows = docs.orderBy("doc_id").collect()
    model = langid.fit(docs, bits=12)
    counts, size = {x: np.zeros(1 << 12) for x in model.languages}, {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None:
            np.add.at(counts[r["lang"]], bayes_counts(r["text"], 12, (1, 2, 3)), 1)
            size[r["lang"]] = size.get(r["lang"], 0) + 1
    assert sorted(counts) == sorted(size)
    for k, x in enumerate(model.languages):
        want = np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * (1 << 12)))
        assert model.weights[:, k] == pytest.approx(want, abs=1e-5)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    for r in rows:
        at = bayes_counts(r["text"] or "", 12, (1, 2, 3))
        logits = model.prior + model.weights[at].astype(float).sum(0)
        want = model.languages[int(logits.argmax())] if at else "und"
        assert got[r["doc_id"]]["lang_pred"] == want, r["doc_id"]
        if at:
            p = np.exp((logits - logits.max()) * min(1, 120 / len(at)))
            assert got[r["doc_id"]]["lang_score"] == pytest.approx(1 / p.sum(), rel=1e-6)
    again = {r["doc_id"]: r for r in langid.predict(docs.repartition(7), langid.fit(docs.repartition(5), bits=12), keep=["doc_id"]).collect()}
    assert again == got
    assert langid.fit(docs, max_languages=len(size)).languages == model.languages
    with pytest.raises(ValueError, match="max_languages"):
        langid.fit(docs, max_languages=len(size) - 1)
    docs.unpersist()


def test_language_edge_cases(spark):
    train = [("the cat and the dog are here", "en"), ("der Hund und die Katze sind da", "de"), (None, "en"), ("text", None)] * 5
    model = langid.fit(spark.createDataFrame([(i, *x) for i, x in enumerate(train)], "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (4, "the dog"), (None, "und die"), (5, "the " * 100_000)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "en")]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = langid.fit(empty)
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}


def test_language_rare_beside_a_large_one(spark):
    last = [r["id"] for r in spark.range(50_000, 60_000).where("pmod(xxhash64('lang', id), 1048576) > 1045000").limit(2).collect()]
    train = [(i, "the cat and the dog are here", "en") for i in range(41_000)] + [(last[0], "это русский текст", "ru"), (last[1], "zażółć gęślą jaźń", "pl")]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["en", "pl", "ru"] and all(np.ptp(model.weights[:, k]) > 1 for k in range(3))
    odd = spark.createDataFrame([(1, "русский текст"), (2, "gęślą jaźń"), (3, "the dog")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(odd, model).collect()] == ["ru", "pl", "en"]
    assert langid.fit(df, max_rows=1000).languages == ["en", "pl", "ru"]


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = queries.op9_toxicity(spark, SF).join(labels, "doc_id", "left").collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["toxic"] is not None]
    caught = [r["predicted"] for r in held if r["toxic"] == 1]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert np.mean(caught) >= 0.6 and np.mean(clean) <= 0.02


def test_toxic_spans_and_edge_cases(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmn") + rng.choice("opqrs")
    text = lambda bad: " ".join("vilest" if bad and k % 9 == 4 else word() for k in range(40))
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(240)]
    model = crf.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    said = "é aio Vilest! bjp"
    df = spark.createDataFrame([(1, said, 0), (2, None, 0), (3, "", 0), (4, "aio bjp", 0), (4, "aio bjp", 0), (None, "vilest " * 50_000, 0)], "doc_id long, text string, score int")
    got = crf.score(df, model).collect()
    assert [r["score"] > 0.5 for r in got] == [True, False, False, False, False, True]
    assert [said.encode()[s["begin"] : s["end"]].decode() for s in got[0]["spans"]] == ["Vilest!"]
    assert got[1]["score"] == got[2]["score"] and got[1]["spans"] == []
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert crf.score(empty, crf.fit(empty)).count() == 0


@pytest.mark.parametrize("block", [64, 3, 2, 1])
def test_forward_backward_equals_enumeration(monkeypatch, block):
    monkeypatch.setattr(crf, "BLOCK", block)
    rng = np.random.default_rng(2)
    sizes = [1, 2, 0, 5, 9, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score, transition, start = rng.normal(size=17), rng.normal(size=(2, 2)), rng.normal(size=2)
    marginal, pairs = crf.forward_backward(score, first, transition, start)
    want_pairs = np.zeros((2, 2))
    for a, length in zip(first.tolist(), sizes, strict=False):
        total, want, some = 0.0, np.zeros(length), np.zeros((2, 2))
        for code in range(2**length if length else 0):
            y = [(code >> k) & 1 for k in range(length)]
            w = np.exp(start[y[0]] + sum(score[a + k] * y[k] for k in range(length)) + sum(transition[y[k], y[k + 1]] for k in range(length - 1)))
            total += w
            want += w * np.array(y)
            for k in range(length - 1):
                some[y[k], y[k + 1]] += w
        if length:
            assert marginal[a : a + length] == pytest.approx(want / total)
            want_pairs += some / total
    assert pairs == pytest.approx(want_pairs)


def test_a_marginal_sees_words_beyond_a_block():
    score = np.zeros(70)
    score[63] = 9.0
    sticky = np.array([[3.0, -3.0], [-3.0, 3.0]])
    marginal, _ = crf.forward_backward(score, np.array([0, 70]), sticky, np.zeros(2))
    assert marginal[64:].min() > 0.98 and 0.86 < marginal[0] < marginal[62]


def test_retagging_follows_document_labels():
    model = crf.Model(np.zeros(1 << crf.BITS, np.float32), 0.0, np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    model.emission[[1, 2, 3]] = 3.0, -0.5, -4.0
    features = np.array([[k, 9, 9, 9] for k in (1, 3, 1, 3, 2, 3, 3)], np.int32)
    tags = crf.retagged(model, features, np.array([0, 2, 4, 6, 7]), np.array([True, False, True, True]))
    assert tags.tolist() == [1, 0, 0, 0, 1, 0, 0]


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = queries.op3_quality_grades(spark, SF).join(labels, "doc_id", "left").collect()
    held = [r for r in got if r["held_out"] and r["quality"] is not None]
    assert len(got) == 1000 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    assert sum(r["kept"] == (r["quality"] == 1) for r in held) >= 0.93 * len(held)


def test_ordinal_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 6)), rng.integers(0, 4, 40)
    free = np.concatenate([rng.normal(size=6), [-1.0, 0.2, -0.3]])
    _, gradient = ordinal.slope_of(free, x, y, 4, decay=0.01)
    for k in range(len(free)):
        step = np.eye(len(free))[k] * 1e-6
        up, down = (ordinal.slope_of(free + sign * step, x, y, 4, decay=0.01)[0] for sign in (1, -1))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def plain_vector(text):
    """The features of one text, by loops."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    out = np.zeros(ordinal.WIDTH)
    mask = (1 << 64) - 1
    for k in range(len(raw)):
        state = 0
        for back in range(min(3, k + 1)):
            state = (state * 257 + raw[k - back] + 1) & mask
            out[int(mix(np.array([state], np.uint64))[0] >> np.uint64(64 - ordinal.BITS))] += 1
    out = np.sqrt(out / max(1, 3 * len(raw)))
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    out[-3] = math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)))
    out[-2] = (len(words) - len(set(words))) / max(1, len(words) + 50) if words else 0
    out[-1] = 0.2 * bool(words)
    return out


def test_ordinal_prediction_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    model = ordinal.Model([0, 2, 5], rng.normal(size=ordinal.WIDTH) * 3, np.array([-0.5, 0.7]))
    texts = ["", None, "A", "so so so it is", "Grüße, Welt! " * 40, "### $$$\n a\tb", "é"] + [" ".join(f"w{rng.integers(50)}" for _ in range(rng.integers(1, 200))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ordinal.predict(df, model, 2).collect():
        line = plain_vector(texts[r["doc_id"]]) @ model.weights
        low, high = (1 / (1 + math.exp(line - c)) for c in model.thresholds)
        assert r["expected_grade"] == pytest.approx(2 * (high - low) + 5 * (1 - high), abs=1e-5)
        assert r["tail_probability"] == pytest.approx(1 - low, abs=1e-5)


def test_ordinal_memory_of_many_short_texts():
    import tracemalloc

    batch = pa.RecordBatch.from_pydict({"text": ["a"] * 10_000})
    tracemalloc.start()
    for part in chunks(iter([batch]), "text", 1 << 20, ordinal.ROWS):
        ordinal.chances(ordinal.Model([0, 1], np.zeros(ordinal.WIDTH), np.zeros(1)), part.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_ordinal_edge_cases(spark):
    rows = [(i, f"{'good fine' if i % 3 == 2 else 'so so' if i % 3 else '### $$$'} {i}", i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = ordinal.fit(df)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "good fine", 9.0), (3, "good fine", 9.0), (None, "### " * 30_000, 9.0)], "doc_id long, text string, expected_grade double")
    got = ordinal.predict(odd, model, 2).collect()
    assert got[2]["expected_grade"] > 1.2 > 0.8 > got[4]["expected_grade"] and got[0][1:] == got[1][1:]
    assert ordinal.predict(odd.limit(0), model, 2).count() == 0
    single = ordinal.fit(df.where("grade = 1"))
    assert {tuple(r)[1:] for r in ordinal.predict(odd, single, 1).collect()} == {(1.0, 1.0)} and {r["tail_probability"] for r in ordinal.predict(odd, single, 2).collect()} == {0.0}
    nothing = ordinal.fit(df.limit(0))
    assert {tuple(r)[1:] for r in ordinal.predict(odd, nothing, 1).collect()} == {(None, None)}


def test_grades_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert queries.op3_quality_grades(spark, f"file://{tmp_path}").count() == 0


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict[tuple, list[int]] = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_count_and_reject(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(10)) for _ in range(n // 10))
    rows = [(i, text(rng.randint(60, 400)), "en", f"s{i % 2}") for i in range(200)]
    rows += [(1000 + i, re.sub(r"(\w+)", r"\1###", text(100)), "en", "s0") for i in range(10)]
    rows += [(2000 + i, "aa bb cc dd\n" * 40, "en", "s1") for i in range(5)]
    rows += [(3000, None, "en", "s0"), (3001, "", None, None), (3002, "\x0b a\x0bb \x85 c", None, "s0"), (3003, text(80), None, "rare"), (3004, text(200), "xx", None), (3004, text(200), "xx", None), (None, text(90), "en", "s1"), (3005, text(30_000), "en", "s0"), (3006, "x y z x y z x y z " * 3, "en", "s0")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    got = outliers.rules(df).collect()
    assert len(got) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted((r[0] or 0, *statistics(r[1])) for r in rows)
    assert sorted((r["doc_id"] or 0, *[r[c] for c in names]) for r in got) == want
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        if r["doc_id"] is not None and 1000 <= r["doc_id"] < 3000:
            assert not r["kept"]
        elif not failed:
            assert r["kept"], r
    kept = outliers.passing(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)


def test_rules_reject_moderate_outliers_of_clean_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    lines = lambda n, words=10: [" ".join(word() for _ in range(words)) for _ in range(n)]
    symbols = lambda n: "\n".join(lines(20)).replace(" ", " #", n)
    copied = lambda copies, n, words: "\n".join(["aa bb cc"] * copies + lines(n, words))
    rows = [(i, "\n".join(lines(rng.randint(8, 30)))) for i in range(150)]
    rows += [(1000, symbols(10)), (1001, symbols(20)), (1002, symbols(40)), (1003, copied(8, 12, 10)), (1004, copied(11, 13, 10)), (1005, copied(19, 11, 7))]
    rows += [(2000, symbols(1)), (2001, symbols(2)), (2002, "\n".join([*(x := lines(10)), x[0]])), (2003, "\n".join(lines(6)).replace(" ", " #", 1))]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = outliers.rules(df).collect()
    assert not any(r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(1000, 1006))


def test_rules_on_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert outliers.rules(df).count() == 0 and outliers.passing(df).count() == 0


def plain_mcd(x, share, ridge, rng, tries=200):
    """Concentration steps from many random starts, until they settle."""
    n, best = len(x), (math.inf, None, None)
    h = math.ceil(share * n)
    for _ in range(tries):
        some = rng.choice(n, 6, replace=False)
        last = math.inf
        while True:
            centre, scatter = x[some].mean(0), np.cov(x[some].T, bias=True) + np.diag(np.square(ridge))
            log_det = np.linalg.slogdet(scatter)[1]
            if len(some) >= h:
                if log_det > last - 1e-9:
                    break
                last = log_det
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            some = np.flatnonzero(d <= np.sort(d)[h - 1])
        best = min(best, (log_det, tuple(centre), tuple(scatter.ravel())))
    return best


def test_estimates_equal_a_plain_mcd_of_each_group(spark):
    rng = np.random.default_rng(0)
    spread = rng.normal(size=(4, 4)) * 0.1
    groups = {
        "clean": rng.normal(size=(300, 4)) @ spread + [1.6, 0, 0, 0],
        "far quarter": np.concatenate([rng.normal(size=(600, 4)) @ spread, rng.normal(size=(190, 4)) * 0.05 + [2, 2, 0, 0]]),
        "constant": np.concatenate([rng.normal(size=(150, 4)) * [0.1, 0.1, 0, 0], [[0.1, 0, 0.5, 0.6]] * 20]),
        "copies": np.concatenate([rng.normal(size=(120, 4)) * 0.1, np.full((60, 4), 0.2)]),
    }
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "g string, x_0 double, x_1 double, x_2 double, x_3 double")
    ridge = [0.01, 0.02, 0.02, 0.01]
    for r in outliers.covariance_shapes(df.repartition(3), 0.75, ridge).collect():
        log_det, centre, scatter = plain_mcd(groups[r["g"]], 0.75, ridge, rng)
        assert r["log_det"] <= log_det + 0.01, r["g"]
        assert [r[f"m_{i}"] for i in range(4)] == pytest.approx(centre, abs=0.01)
        assert [r[f"c_{i}_{j}"] for i in range(4) for j in range(i + 1)] == pytest.approx([scatter[4 * i + j] for i in range(4) for j in range(i + 1)], abs=3e-3)


def test_levels_that_judge(spark):
    rng = random.Random(9)
    text = lambda: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(10)) for _ in range(8))
    rows = [(i, text(), "en", "big") for i in range(60)] + [(100 + i, text(), "en", f"s{i % 3}") for i in range(15)] + [(200 + i, text(), "xx", None) for i in range(5)]
    rows += [(300, "short", "en", "big"), (301, text().replace(" ", " #"), "en", "s0"), (302, text().replace(" ", " #"), "xx", None), (303, text().replace(" ", " #"), "en", "big")]
    got = {r["doc_id"]: r for r in outliers.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    want = {**{i: "group" for i in range(60)}, **{100 + i: "language" for i in range(15)}, **{200 + i: "all" for i in range(5)}, 300: None, 301: "language", 302: "all", 303: "group"}
    assert {i: r["level"] for i, r in got.items()} == want
    assert {i for i, r in got.items() if not r["kept"]} == {300, 301, 302, 303}


def test_verdicts_are_of_rows_not_of_ids(spark):
    rng = random.Random(10)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80))
    good = text()
    rows = [(None, good, "en", "a", 1), (None, "too short", "en", "a", 1), (7, good, "en", "a", 1), (7, "short", "en", "a", 1), (7, good, "en", "a", 1)] + [(10 + i, text(), "en", "a", 1) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, x_0 int")
    kept = outliers.passing(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.where("text = '%s' or doc_id is null or doc_id = 7" % good).collect()) == [0, 7, 7]


def test_chi_square_quantile():
    assert outliers.chi_square(4, outliers.chi_square_quantile(4, 0.95)) == pytest.approx(0.95)
