"""Placement, mixing, classifiers, WARC, nearest neighbours and the pipeline, on small tables with odd rows."""

import gzip
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing, permutation_index, quality, sharding, toxicity, warc


# sharding


def brute_table(shards, size):
    """Shards in order of name take turns; each takes its most preferred free slot."""
    prefer = {s: [(sharding._digest(s, "offset") % size + t * (sharding._digest(s, "skip") % (size - 1) + 1)) % size for t in range(size)] for s in shards}
    owner = {}
    while len(owner) < size:
        for s in sorted(shards):
            if len(owner) < size:
                owner[next(x for x in prefer[s] if x not in owner)] = s
    return [owner[i] for i in range(size)]


def test_table_is_filled_by_turns_and_even():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 211)
    assert table == brute_table(shards, 211)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    weighted = Counter(sharding.lookup_table({"a": 3, "b": 1}, 211))
    assert weighted["a"] > 2.8 * weighted["b"]


def test_losing_a_shard_moves_few_slots():
    shards = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(shards, 2003), sharding.lookup_table(shards[:-1], 2003)
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != "s19") < 0.1 * 2003


@pytest.mark.parametrize("size", [100, 3])
def test_table_size_must_be_a_large_enough_prime(size):
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b", "c", "d"], size)


def test_assign_keeps_rows_and_spreads_hot_and_null_keys(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 5 < 3 else f"k{i}", i, "clash") for i in range(500)]
    df = spark.createDataFrame(rows, "key string, i long, slot string")
    shards = [f"s{i}" for i in range(16)]
    plain = sharding.assign(df, ["key"], shards, 1009)
    assert plain.count() == 500 and plain.where("key = 'hot'").select("shard").distinct().count() == 1
    spread = sharding.assign(df, ["key"], shards, 1009, spread=["i"], hot_share=0.1)
    assert sorted(r["i"] for r in spread.collect()) == list(range(500))
    for key in ("key = 'hot'", "key is null"):
        assert spread.where(key).select("shard").distinct().count() > 8
    assert spread.where("key like 'k%'").join(plain.select("i", F.col("shard").alias("s")), "i").where("shard <> s").count() == 0
    assert sharding.assign(df.limit(0), ["key"], shards, 1009).count() == 0


def test_assign_leaves_columns_named_as_its_helpers(spark):
    rows = [("hot" if i % 2 else f"k{i}", i, i + 1, i + 2, i + 3) for i in range(100)]
    df = spark.createDataFrame(rows, "count string, i long, __hot long, __k_count long, __n long")
    got = sharding.assign(df, ["count"], [f"s{i}" for i in range(16)], 1009, spread=["i"], hot_share=0.1)
    assert sorted(got.select(*df.columns).collect(), key=lambda r: r["i"]) == [tuple(r) for r in rows]
    assert got.where(F.col("count") == "hot").select("shard").distinct().count() > 8


def test_op1_places_every_document_by_brute_force(spark, tmp_path):
    import xxhash

    from gridloom.llm import entries

    ids = [*range(300), -5, 1 << 62, None, None, 7, 7]
    spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    owner = sharding.lookup_table(entries.SHARDS)
    hashed = lambda i: 42 if i is None else xxhash.xxh64((i % (1 << 64)).to_bytes(8, "little"), seed=42).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    want = Counter((i, signed(hashed(i)) % sharding.TABLE_SIZE, owner[signed(hashed(i)) % sharding.TABLE_SIZE]) for i in ids)
    assert Counter(map(tuple, entries.op1_sharding(spark, str(tmp_path)).collect())) == want


# mixing


def test_every_block_meets_its_window_and_no_source_strays_by_a_block():
    r = random.Random(2)
    for _ in range(30):
        units = mixing.weight_units({f"s{i}": r.random() ** 3 + 0.001 for i in range(r.randint(1, 12))}, r.choice([16, 97, 256]))
        period = sum(units.values())
        had = Counter()
        for t, (s, i) in enumerate(mixing.edf_period(units)):
            assert i * period // units[s] <= t < -(-(i + 1) * period // units[s])
            had[s] += 1
            assert all(abs(had[x] - units[x] * (t + 1) / period) < 1 for x in units)
        assert had == Counter(units)


@pytest.mark.parametrize("salt_rows", [7, 20_000])
def test_mix_keeps_all_rows_and_weights_hold_while_in_mix(spark, salt_rows):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}", "clash") for i in range(900)] + [(None, "hot", "x"), (5, "hot", "again"), (5, "hot", "again")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {"hot": 0.5, "s0": 0.2, "s1": 0.1, None: 0.2}
    got = mixing.mix(df, weights, block_rows=4, period=64, salt_rows=salt_rows).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, s, _ in rows)
    by_block = Counter((r["source"], r["block"]) for r in got)
    for s in {r["source"] for r in got}:
        n = sum(x[1] == s for x in rows)
        assert sorted(b for x, b in by_block if x == s) == list(range(-(-n // 4)))
        assert all(by_block[s, b] == 4 for b in range(n // 4))
    slots = {}
    for r in got:
        assert r["release"] <= r["slot"] < r["due"]
        assert slots.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    ends = [r["slot"] for r in got if r["in_mix"]]
    assert sorted({*ends}) == list(range(max(ends) + 1))
    named = {"hot": 0.5, "s0": 0.2, "s1": 0.1, None: 0.2, "s2": 0.1, "s3": 0.1}
    units = mixing.weight_units({str(s): w for s, w in named.items() if s in {x for _, x, _ in rows}}, 64)
    had = Counter()
    for t in range(max(ends) + 1):
        had[str(slots[t][0])] += 1
        assert all(abs(had[s] - u * (t + 1) / 64) < 1.001 for s, u in units.items())
    assert mixing.mix(df.limit(0)).count() == 0


def test_interleaved_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "t") for i in range(100)], "doc_id long, source string, text string")
    got = mixing.interleaved(df, block_rows=2, period=32)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == list(range(100))


def test_interleaved_returns_clashing_columns_as_they_were(spark):
    rows = [(i if i % 5 else None, f"s{i % 3}" if i % 4 else None, 1000 + i, "b", None, {"k": i}) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot long, block string, in_mix boolean, extra map<string,int>")
    got = mixing.interleaved(df, block_rows=2)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert mixing.interleaved(df.limit(0)).count() == 0


def test_schedule_is_that_of_brute_force_and_blocks_are_bounded(spark):
    """op10's whole schedule: at every slot the released block with the earliest deadline, by exact fractions."""
    rows = [(i, None if i % 13 == 0 else "\u0000" if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 6}") for i in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=3).collect()
    counts = Counter(s for _, s in rows)
    weights = {s: Fraction(n**0.5) for s, n in counts.items()}
    total, left = sum(weights.values()), {s: -(-n // 3) for s, n in counts.items()}
    done, want, t = dict.fromkeys(counts, 0), {}, 0
    while any(done[s] < n for s, n in left.items()):
        free = []
        for s, n in left.items():
            i, w = done[s], weights[s] / total
            if (release := i / w // 1) <= t:
                free.append((-(-(i + 1) // w), "" if s is None else f"={s}", s, release))
        due, _, s, release = min(free, default=(None, None, None, None))
        if due is None:
            t += 1
        elif done[s] == left[s]:
            done.pop(s), left.pop(s)
        else:
            want[s, done[s]] = (t, release, due)
            done[s] += 1
            t += 1
    assert {(r["source"], r["block"]): (r["slot"], r["release"], r["due"]) for r in got} == want
    few = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=3, max_blocks=40).collect()
    assert len({(r["source"], r["block"]) for r in few}) <= 40 and len(few) == len(rows)


@pytest.mark.parametrize("weights, blocks", [({f"s{i:02d}": 1.0 for i in range(20)}, 400), ({f"s{i:02d}": (i + 1) ** 0.5 for i in range(7)}, 3000)])
def test_sources_stay_within_a_block_of_their_true_weights(weights, blocks):
    units, total, had = mixing.exact_units(weights), sum(weights.values()), Counter()
    for s, i, t, _, _, in_mix in mixing.edf_slots(units, dict.fromkeys(weights, blocks)):
        assert i == had[s] and i * total / weights[s] - 1 < t < (i + 1) * total / weights[s] + 1
        had[s] += 1
        assert not in_mix or all(abs(had[x] - w / total * (t + 1)) < 1 + 1e-9 for x, w in weights.items())
    assert set(had.values()) == {blocks}


@pytest.mark.parametrize("chunk", [250_000, 700])
def test_a_hot_source_beside_more_than_1024_others_gets_its_weight(spark, chunk):
    rows = [(i, "hot") for i in range(600)] + [(1000 + i, f"s{i}") for i in range(1100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1, chunk=chunk).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    weight, had = 600**0.5 / (600**0.5 + 1100), 0
    of_slot = {r["slot"]: r for r in got}
    assert len(of_slot) == len(rows) and all(r["release"] <= r["slot"] < r["due"] for r in got)
    end = sum(r["in_mix"] for r in got)
    assert end >= 1100 and all(of_slot[t]["in_mix"] for t in range(end))
    for t in range(end):
        had += of_slot[t]["source"] == "hot"
        assert abs(had - weight * (t + 1)) < 1
    assert had > 20


def brute_slots(counts, block_rows, period=262_144):
    """{(source, block): (slot, release, due)}: at every slot, of the blocks released, the one due first, by exact fractions; sources that have run out keep their slots, empty."""
    key = lambda s: "" if s is None else f"={s}"
    units = mixing.weight_units({key(s): n**0.5 for s, n in counts.items()}, period)
    share = {s: Fraction(units[key(s)], sum(units.values())) for s in counts}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    done, out, t = dict.fromkeys(counts, 0), {}, 0
    while any(done[s] < n for s, n in blocks.items()):
        free = [(-(-(done[s] + 1) // w), key(s), s, done[s] / w // 1) for s, w in share.items() if done[s] / w // 1 <= t]
        due, _, s, release = min(free)
        if done[s] < blocks[s]:
            out[s, done[s]] = (t, release, due)
        done[s] += 1
        t += 1
    return out


@pytest.mark.parametrize("period", [262_144, 97, 3])
def test_schedule_is_that_of_brute_force_over_many_periods(spark, period):
    """The whole schedule, by periods of many and of few slots; three slots are too few for five sources, which get one each."""
    rows = [(i, None if i % 13 == 0 else "\u0000" if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 6}") for i in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=3, period=period).collect()
    assert {(r["source"], r["block"]): (r["slot"], r["release"], r["due"]) for r in got} == brute_slots(Counter(s for _, s in rows), 3, period)


def test_query_of_the_mix_against_brute_force(spark, tmp_path):
    """op10 itself: the table's schedule, whole blocks, places from 0, and the end of the mix at the first empty slot."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}", "t") for i in range(3000)] + [(None, "hot", "t"), (7, None, "t"), (7, None, "t")]
    from gridloom.llm import entries

    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.op10_mixing(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, s, _ in rows)
    counts = Counter(s for _, s, _ in rows)
    want = brute_slots(counts, 16)
    assert {(r["source"], r["block"]): (r["slot"], r["release"], r["due"]) for r in got} == want
    taken, end = {x[0] for x in want.values()}, 0
    while end in taken:
        end += 1
    assert all(r["in_mix"] == (r["slot"] < end) for r in got)
    places = {}
    for r in got:
        places.setdefault((r["source"], r["block"]), []).append(r["place"])
    assert all(sorted(x) == list(range(min(16, counts[s] - 16 * b))) for (s, b), x in places.items())


def test_blocks_have_the_callers_size_and_every_period_is_alike(spark):
    """Blocks of two rows in 40,000 rows, over periods of 10 slots, in which these weights are whole: the schedule is worked out for 10 slots alone."""
    df = spark.range(40_000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'a' when id % 10 < 7 then 'b' else 'c' end as source")
    got = mixing.mix(df, {"a": 0.5, "b": 0.3, "c": 0.2}, block_rows=2, period=10).select("source", "block", "slot", "in_mix").distinct().collect()
    assert len(got) == 20_000
    at = {(r["source"], r["block"]): r["slot"] for r in got}
    per = {"a": 5, "b": 3, "c": 2}
    assert all(at[s, b] == at[s, b % per[s]] + b // per[s] * 10 for s, b in at)
    assert len(set(at.values())) == 20_000


def test_the_mix_broadcasts_a_row_for_each_source(spark):
    """Not one for each slot of the period, which the driver would gather and hash."""
    df = spark.range(5000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "concat('t', id) as text")
    out = mixing.mix(df, period=4096)
    plan = out._jdf.queryExecution().executedPlan()
    assert out._jdf.queryExecution().toRdd().count() == 5000
    left, sent = [plan], []
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "BroadcastExchangeExec":
            sent.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        left += inner + [node.children().apply(i) for i in range(node.children().size())]
    assert sent and max(sent) <= 3 * 64  # salts of a source at most
    assert {(r["source"], r["block"]): (r["slot"], r["release"], r["due"]) for r in out.collect()} == brute_slots({"s0": 1667, "s1": 1667, "s2": 1666}, 16, 4096)


def test_helper_columns_of_the_mix_never_clash(spark):
    names = ["doc_id", "source", "__source", "__salt", "__tie", "__rank", "__before", "__units", "__in_period", "__first", "n", "at"]
    df = spark.createDataFrame([(i, f"s{i % 3}", *[f"{n}{i}" for n in names[2:]]) for i in range(50)], names)
    for period in (None, 100):
        got = mixing.mix(df, block_rows=2, period=period)
        assert sorted(got.columns) == sorted([*names, *mixing.ADDED])
        assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, df.collect()))


# classifiers


def plain_text(r, n):
    words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}" for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def labelled(spark, seed=3, n=500):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        t = plain_text(r, r.randint(20, 120))
        if toxic:
            parts = t.split(". ")
            parts[r.randrange(len(parts))] += " " + r.choice(["vilexa", "grotzo", "snarbu"])
            t = ". ".join(parts)
        t = t if good else (t.upper().replace(" ", "!! ") if r.random() < 0.5 else t.replace(" ", "$$$ "))
        docs.append((i, t, 1.0, "x"))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, 1.0, "x"), (n + 1, "", 1.0, "x"), (None, "no id", 1.0, "x"), (n + 2, "w " * 30_000, 1.0, "x"), (3, "repeated id", 1.0, "x")]
    labels += [(n, None, None), (None, 1, 1), (4, 1, 1), (99_999, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double, offending string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[:n]}


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_learns_and_holds_out(spark):
    docs, labels, truth = labelled(spark)
    model = quality.fit(docs, labels, rounds=60, pair_rounds=20)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    test = [(r["score"] >= 0.3, truth[r["doc_id"]][0]) for r in got if r["doc_id"] in truth and held(r["doc_id"]) and r["text"] != "repeated id"]
    assert np.mean([int(p) == t for p, t in test]) > 0.95
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, flipped, rounds=60, pair_rounds=20)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))


def test_scores_are_sums_of_looked_up_bins():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(400) < 0.05)).astype(float)
    model = quality.fit_matrix(x, y, rounds=40, pair_rounds=60)
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x) > 0.5) == y) > 0.9
    by_hand = []
    for row in x:
        z = model.intercept + sum(t[sum(c <= v for c in cuts)] for t, cuts, v in zip(model.tables, model.cuts, row, strict=True))
        z += sum(t[sum(c <= row[a] for c in model.coarse[a]), sum(c <= row[b] for c in model.coarse[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        by_hand.append(1 / (1 + np.exp(-z)))
    assert np.allclose(by_hand, model.score(x))


def test_classifiers_without_labels_or_documents(spark):
    docs, labels, _ = labelled(spark, n=20)
    none = labels.limit(0)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert max(r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()) < 1e-6
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_toxicity_finds_documents_and_sentences(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    test = [(r, truth[r["doc_id"]][1]) for r in got if r["doc_id"] in truth and held(r["doc_id"]) and r["text"] != "repeated id"]
    assert np.mean([int(r["score"] >= 0.5) == t for r, t in test]) > 0.9
    found = [r["text"][s["start"] : s["end"]].lower() for r, t in test if t for s in r["offending"]]
    assert found and np.mean([any(w in f for w in ("vilexa", "grotzo", "snarbu")) for f in found]) > 0.9
    none = [r for r in got if not r["text"]]
    assert len(none) == 2 and all(r["score"] == 0 and r["offending"] == [] for r in none)
    assert toxicity.keep(docs, model).columns == docs.columns


def local_toxicity(model, text):
    """Noisy-or over sentences, by the model's weights alone."""
    z = [model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.word_features(w)) for _, _, words in toxicity.sentences(text)]
    return 1 - float(np.prod([1 - min(1 / (1 + np.exp(-np.clip(x, -30, 30))), 1 - 1e-12) for x in z])) if z else 0.0


def test_op2_and_op5_score_as_their_models_say(spark, tmp_path):
    from gridloom.llm import entries

    docs, labels, _ = labelled(spark, n=150)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    texts = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good, bad = quality.fit(texts, labels), toxicity.fit(texts, labels)
    rows = [(r["doc_id"], r["text"]) for r in texts.collect()]
    for query, threshold, score in (
        (entries.op2_quality, 0.3, lambda t: float(good.score(np.array([quality.features(t)], float))[0])),
        (entries.op5_toxicity, 0.5, lambda t: local_toxicity(bad, t)),
    ):
        got = Counter((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in query(spark, str(tmp_path)).collect())
        assert got == Counter((i, held(i), round(score(t), 9), int(score(t) >= threshold)) for i, t in rows)


def test_training_rows_are_bounded_in_rows_and_characters(spark):
    from gridloom.llm.common import training_rows

    docs, labels, _ = labelled(spark, n=200)
    every = training_rows(docs, labels, "quality", 10_000).collect()
    assert all(not held(r["doc_id"]) for r in every) and len({r["doc_id"] for r in every}) == sum(not held(i) for i in range(200))
    some = training_rows(docs, labels, "quality", 10_000, 20_000).collect()
    assert {r["doc_id"] for r in some} < {r["doc_id"] for r in every} and sum(len(r["text"]) for r in some if r["doc_id"] != 3) <= 20_000
    assert len({r["doc_id"] for r in training_rows(docs, labels, "quality", 50).collect()}) == 50


def test_a_text_too_long_by_itself_does_not_end_the_sample(spark):
    from gridloom.llm.common import training_rows

    docs, labels, _ = labelled(spark, n=200)
    ids = [r["doc_id"] for r in docs.where("doc_id < 200").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).collect() if not held(r["doc_id"])]
    long = docs.withColumn("text", F.when(F.col("doc_id") == ids[0], F.repeat(F.lit("w "), 40_000)).otherwise(F.col("text")))
    some = {r["doc_id"] for r in training_rows(long, labels, "quality", 10_000, 60_000).collect()}
    assert ids[0] not in some and len(some) > 50


def test_filters_keep_columns_of_any_name(spark):
    docs, labels, _ = labelled(spark, n=60)
    odd = docs.withColumns({"__quality": F.lit("a"), "__TOXIC": F.lit("b"), "__tox": F.lit("c")})
    for kept in (quality.keep(odd, quality.fit(docs, labels, rounds=5, pair_rounds=2), 0.0), toxicity.keep(odd, toxicity.fit(docs, labels), 1.1)):
        assert kept.columns == odd.columns and {(r["__quality"], r["__TOXIC"], r["__tox"]) for r in kept.collect()} == {("a", "b", "c")} and kept.count() == docs.count()


def test_noisy_or_gradient_is_that_of_its_likelihood():
    bags = [(1, 2, [0, 1], [0, 1]), (0, 1, [0], [1]), (1, 1, [0], [0])]
    bias, w = toxicity.train(bags, 2, steps=400)
    p = lambda *z: 1 - np.prod([1 - 1 / (1 + np.exp(-(bias + x))) for x in z])
    assert p(w[0], w[1]) > 0.9 and p(w[1]) < 0.1 and p(w[0]) > 0.9


# WARC


def test_records_refer_to_their_response_and_files_hold_them(spark, tmp_path):
    page = '<!DOCTYPE html><html lang="en"><head><title>A\n title</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One &amp; two<br>three &lt;b&gt;</p><a href="/q">q</a></body></html>'
    rows = [(1, "http://a/", page, "z"), (2, None, None, "z"), (3, "http://b/", "", "z"), (None, "http://c/", "plain é", "z"), (1, "http://a/", page, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    source = warc.responses(pages)
    records = warc.derive(source)
    got = records.collect()
    assert len(got) == 10
    ids = {r["record_id"] for r in source.collect()}
    assert all(r["refers_to"] in ids for r in got)
    mine = {r["warc_type"]: r for r in got if r["page_id"] == 1}
    assert mine["conversion"]["content"] == "A\ntitle\nOne & two\nthree <b>\nq"
    assert mine["metadata"]["content"].startswith("title: A title\r\nlanguage: en\r\noutlinks: 1\r\nhttp-status: 200\r\n")
    size = len(page.encode())
    assert mine["metadata"]["content"].endswith(f"\r\nsource-header: Content-Type: text/html; charset=UTF-8\r\nsource-header: Content-Length: {size}\r\n")
    assert mine["metadata"]["concurrent_to"] == mine["conversion"]["record_id"]
    empty = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert all(r["payload_digest"] == empty and r["content_length"] == 0 for r in got if r["page_id"] in (2, 3) and r["warc_type"] == "conversion")
    files = warc.write(records, str(tmp_path / "w"), file_bytes=500).collect()
    assert sum(f["records"] for f in files) == 10
    text = b"".join(gzip.open(f["path"].removeprefix("file://")).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == 10 and text.count(b"WARC-Refers-To: <urn:uuid:") == 10
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


# nearest neighbours


def test_search_finds_what_brute_force_finds(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16)).round(3)
    x[100:400] = x[100]  # copies: ties go to the smaller id
    rows = [(int(i) * 2, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(7001, None, 1), (7003, [0.0] * 16, 1), (7005, [float("nan")] * 16, 1), (7007, [1.0, None] * 8, 1), (7009, [float("inf")] * 16, 1), (7011, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = permutation_index.search(df, df.where("vec_id % 100 = 0 or vec_id > 7000 or vec_id in (300, 302)"), k=10, block_rows=700, query_rows=20).collect()
    ids, found = np.array([i for i, _, _ in rows]), {}
    for g in got:
        found.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert set(found) == {i for i, _, _ in rows if i % 100 == 0} | {302}
    hits = []
    for q, f in found.items():
        s = x @ x[q // 2]
        s[q // 2] = -np.inf
        best = ids[np.lexsort((ids, -s))[:10]]
        assert [n for n, _, _ in sorted(f)] == list(range(1, 11))
        assert all(abs(score - x[i // 2] @ x[q // 2]) < 1e-12 for _, i, score in f)
        hits.append(np.isin(best, [i for _, i, _ in f]).mean())
    assert np.mean(hits) >= 0.9
    copies = [i for _, i, _ in sorted(found[302]) if 200 <= i < 800]
    assert copies and copies == [i for i in range(200, 800, 2)][: len(copies)]


@pytest.mark.parametrize("n", [60, 500, 6000])
def test_op9_has_recall_over_nine_tenths_on_even_spheres(spark, tmp_path, n):
    from gridloom.llm import entries

    r = np.random.default_rng(n)
    x = r.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).round(6)
    spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {}
    for g in entries.op9_permutation_index(spark, str(tmp_path)).collect():
        found.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert sorted(found) == list(range(0, n, 20))
    hits = []
    for q, f in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        assert [i for i, _, _ in sorted(f)] == list(range(1, 21)) and all(abs(score - s[i]) < 1e-12 for _, i, score in f)
        hits.append(np.isin(np.argsort(-s, kind="stable")[:20], [i for _, i, _ in f]).mean())
    assert np.mean(hits) >= 0.93


def test_inverted_files_give_the_footrule_distance():
    r = np.random.default_rng(3)
    x, pivots, n = r.normal(size=(50, 8)), r.normal(size=(20, 8)), 6
    order = permutation_index.orders(x, pivots, n, at_once=7)
    assert (order == np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :n]).all()
    files = permutation_index.InvertedFiles(order, 20)
    place = np.full((50, 20), n)
    np.put_along_axis(place, order, np.arange(n)[None].repeat(50, 0), axis=1)
    for q in range(50):
        footrule = np.abs(place - place[q]).sum(axis=1)
        largest = n * (n + 1)  # of two prefixes that share no pivot
        assert (largest - 2 * files.closeness(order[q]) == footrule).all()


@pytest.mark.parametrize("block_rows", [4096, 150])
def test_repeated_rows_and_ids_count_once(spark, block_rows):
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 8)).round(3)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    again = rows[:40] * 3  # rows alike, queries among them
    many = [(20, v.tolist()) for v in r.normal(size=(400, 8)).round(3)] + [(7, (2 * v).tolist()) for v in x[:60]]  # an id with many vectors: a query, and a candidate
    df = spark.createDataFrame(rows + again + many, "vec_id long, embedding array<double>")
    got = permutation_index.search(df, df.where("vec_id % 20 = 0"), k=10, rerank=1.0, block_rows=block_rows, query_rows=4).collect()
    vectors = {}
    for i, v in rows + again + many:
        vectors.setdefault(i, set()).add(tuple(v))
    found = {}
    for g in got:
        found.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert set(found) == set(range(0, 300, 20))
    for q, f in found.items():
        asking = np.array(min(vectors[q]))
        best = sorted((-max(float((np.array(v) * asking).sum()) for v in vs), i) for i, vs in vectors.items() if i != q)[:10]
        assert [(n, i) for n, i, _ in sorted(f)] == [(n, i) for n, (_, i) in enumerate(best, 1)]


def test_search_of_few_and_of_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = permutation_index.search(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(g["rank"], g["vec_id"]) for g in got] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert permutation_index.search(df.limit(0), df).count() == 0


# pipeline


def brute_schedule(counts, block_rows=16):
    """The sources of all rows in the order of the mix, which repeats."""
    order = sorted((slot, b, s) for (s, b), (slot, _, _) in brute_slots(counts, block_rows).items())
    return [s for _, b, s in order for _ in range(min(block_rows, counts[s] - block_rows * b))]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage and the whole: scores by the models' formulas, groups of all pairs, the schedule slot by slot, the library's ids."""
    import hashlib

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from gridloom.llm import bpe

    from .test_text_operators import shingles

    docs, labels, _ = labelled(spark)
    r = random.Random(8)
    base = plain_text(r, 60).split()
    near = [(9000 + i, " ".join([*base[:-1], f"w{i}"]) if i else " ".join(base)) for i in range(6)]
    near += [(None, " ".join(base)), (9002, near[2][1]), (9100, plain_text(r, 9000)), (9101, None), (9101, None)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    source = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("s"), F.col("doc_id") % 3))
    table = table.withColumns({"lang": F.lit("en"), "source": source, "n_chars": F.length("text").cast("long")}).repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf, state = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows_of = lambda df: [(x["doc_id"], x["text"], x["source"]) for x in df.collect()]
    rows = rows_of(state)

    def groups(rows):
        sets, up = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                    up[find(i)] = find(j)
        best = {}
        for i, row in enumerate(rows):
            best.setdefault(find(i), []).append(((row[0] is None, row[0] or 0, i), row))
        return [min(v)[1] for v in best.values()]

    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality":
            model = quality.fit(state, labels)
            rows = [x for x in rows if model.score(np.array([quality.features(x[1])], float))[0] >= 0.3]
        elif name == "toxicity":
            model = toxicity.fit(state, labels)
            rows = [x for x in rows if local_toxicity(model, x[1]) < 0.5]
        elif name == "near_duplicates":
            rows = groups(rows)
        state = stage(spark, state, sf)
        assert tuple(state.columns) == corpus_pipeline.COLUMNS, name
        state.write.parquet(str(tmp_path / name))
        state = spark.read.parquet(str(tmp_path / name))
        assert Counter(rows_of(state)) == Counter(rows), name
    assert [x[0] for x in rows if x[0] is not None and 9000 <= x[0] < 9100] == [9000] and sum(x[0] == 9101 for x in rows) == 2
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    merges = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def digests(i, t):
        ids = merges.encode_ordinary(t or "")
        return (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))

    got = [tuple(x) for x in got.collect()]
    of = {digests(i, t): s for i, t, s in rows}
    assert Counter(got) == Counter(digests(i, t) for i, t, _ in rows)
    assert [of[x] for x in got] == brute_schedule(Counter(s for _, _, s in rows))


def test_stages_of_empty_tables_and_without_labels(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string, score string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, None, None, None, None, "a", "b"), (1, "", "en", None, 0, "a", "b"), (1, "", "en", None, 0, "a", "b"), (2, "some words are here now", None, "x", None, "c", None)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == docs.columns, name
            assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect())), name
        assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == len(data)


def test_result_keeps_the_target_weights_up_to_the_end_of_the_mix(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    r = random.Random(6)
    rows = [(i, plain_text(r, 9000 if i % 400 == 0 else 5), "en", "hot" if i < 900 else f"s{i % 4}", 1) for i in range(1300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    assert len(rows[0][1]) > 32_768
    source = {i: s for i, _, _, s, _ in rows}
    order = [x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(order) == sorted(source)
    counts = Counter(source.values())
    total, had = sum(n**0.5 for n in counts.values()), Counter()
    end = 16 * 24  # each of four sources of 100 rows has a seventh of the weights and six whole blocks
    for k, i in enumerate(order[:end]):
        had[source[i]] += 1
        if k % 16 == 15:
            assert all(abs(had[s] / 16 - n**0.5 / total * (k + 1) / 16) < 1 + 1e-9 for s, n in counts.items())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.tokens(spark, docs, str(tmp_path))
    slots = {x["doc_id"]: (x["slot"], x["place"], x["in_mix"]) for x in mixing.mix(docs, period=corpus_pipeline.PERIOD).collect()}
    assert {x["doc_id"]: (x["slot"], x["place"], x["in_mix"]) for x in got.collect()} == slots


def test_places_of_tokens_are_found_without_texts(spark, tmp_path):
    """Texts are not in the plan that gives digests their places, and rows that repeat an id keep their own."""
    import corpus_pipeline

    r = random.Random(9)
    rows = [(None if i % 50 == 0 else i % 120, None if i % 37 == 0 else plain_text(r, 9000 if i % 100 == 1 else 5), "en", None if i % 9 == 0 else f"s{i % 3}", i % 2) for i in range(300)]
    rows += rows[:20]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string, __deal string"
    spark.createDataFrame([(*x, "a", "b") for x in rows], schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.tokens(spark, docs, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "slot", "place", "in_mix"]
    assert "text" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = mixing.mix(docs, period=corpus_pipeline.PERIOD).select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), "slot", "place", "in_mix")
    assert Counter(map(tuple, got.select("doc_id", "decoded_sha256", "slot", "place", "in_mix").collect())) == Counter(map(tuple, want.collect()))
