"""Fill-in-middle, periodic runs and language identification against plain Python, on small tables with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import entries, infill, language, periods

SCHEMA = "doc_id long, text string, n string, form string, runs string, lang_pred string, score string"


def frame(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "n", "f", "r", "l", "s") for i, t in rows], SCHEMA)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "one"), (6, "a b c d"), (6, "a b c d"), (None, "no id at all"), (7, "has <P> in it"), (8, "tail <S"), (9, "<M"),
    (10, "naïve ÉCOLE ½ 漢字 🙂🙂 é"), (11, "word " * 3000), (12, "<S> <P> <M>"), (13, "line\nline\r\nlast"), (14, "x\x1cy\x85z a\x0bb\x0cc"), (15, ">" * 50), (16, "<" * 50),
]


def written(spark, path, rows, lang=False):
    """A folder whose documents.parquet has these rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(*r, None if not lang else "x", "s", 1)[:5] if len(r) == 2 else (r[0], r[1], r[2], "s", 1) for r in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def infill_by_hand(i, t):
    t = t or ""
    s = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(s[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, sha(t), sha(t))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, x = t[:a], t[a:b], t[b:]
    form, out = ("spm", f"<S>{x}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{x}<M>{m}")
    return (i, n, form, a, b - a, sha(out), sha(t))


def test_op11_is_that_of_plain_python(spark, tmp_path):
    r = random.Random(4)
    rows = ODD + [(100 + i, "".join(r.choice("ab é漢🙂<>PSM\n") for _ in range(r.randint(0, 60)))) for i in range(400)]
    got = entries.op11_infill(spark, written(spark, tmp_path / "t", rows))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(tuple(x) for x in got.collect()) == Counter(infill_by_hand(i, t) for i, t in rows)
    assert {x["form"] for x in got.collect()} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_pieces_of_any_unit_restore_the_text(spark, unit):
    r = random.Random(7)
    rows = ODD + [(100 + i, "".join(r.choice("ab1 é漢🙂<>\n") for _ in range(r.randint(0, 80)))) for i in range(200)]
    cut = infill.transform(frame(spark, rows), unit=unit, rate=100)
    got = infill.restore(cut).collect()
    assert sorted(str(x["restored"]) for x in got) == sorted(t or "" for _, t in rows)
    for x in got:
        if x["form"] != "plain":
            t, a, z = x["restored"], x["prefix_chars"], x["prefix_chars"] + x["middle_chars"]
            ends = {"char": range(len(t) + 1), "line": [0, len(t), *(m.end() for m in re.finditer("\n", t))], "word": [0, len(t), *(m.end() for m in re.finditer(r"[^\W_]+|\s+|(?:[^\w\s]|_)+", t))]}[unit]
            assert {a, z} <= {*ends}
    assert infill.transform(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="unit"):
        infill.transform(frame(spark, ODD), unit="page")


def test_outputs_and_forms_that_are_null_or_wrong(spark):
    df = spark.createDataFrame([("<P>a<S>c<M>b", "psm"), (None, "psm"), ("x", None), ("x", "plain")], "output string, form string")
    assert [x["restored"] for x in infill.restore(df).collect()] == ["abc", None, None, "x"]
    with pytest.raises(ValueError, match="no output"):
        infill.restore_text("abc", "spm")


def runs_by_hand(x, least=24, times=3):
    """Every stretch of every period, word by word."""
    n, out = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i - s + q >= max(least, times * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(r, n, k):
    x = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randint(0, 4)):
        if n > 30:
            a = r.randrange(n - 20)
            base, size = x[a : a + r.randint(1, max(1, (n - a) // 2))], r.randint(0, n - a)
            for j in range(size):
                x[a + j] = base[j % len(base)]
    return x


@pytest.mark.parametrize("least, times", [(24, 3), (1, 2), (7, 4)])
def test_runs_are_those_of_brute_force(least, times):
    r = random.Random(least)
    for _ in range(250):
        x = planted(r, r.randint(0, 200), r.choice([1, 2, 3, 50]))
        got = periods.find_runs(np.array(x, np.int32), least, times)
        want = runs_by_hand(x, least, times)
        assert [tuple(v) for v in got.tolist()] == want
        if want:
            best = min(want, key=lambda v: (-v[1] / v[2], v[0], v[2]))
            assert want[periods.strongest(got)] == best
        kept = periods.kept_words(len(x), got)
        assert [not any(s + q <= i < s + n for s, n, q in want) for i in range(len(x))] == kept.tolist()


def test_comparing_few_cells_at_once_gives_the_same(monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(periods, "_CELLS", 64)
    for _ in range(60):
        x = planted(r, r.randint(100, 300), r.choice([1, 3, 50]))
        assert [tuple(v) for v in periods.find_runs(np.array(x, np.int32)).tolist()] == runs_by_hand(x)


def periods_by_hand(i, t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    n = len(words)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
    runs = runs_by_hand(words)
    best = min(runs, key=lambda v: (-v[1] / v[2], v[0], v[2])) if runs else (None,) * 3
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + m for s, m, q in runs)]
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_op12_is_that_of_plain_python(spark, tmp_path):
    r = random.Random(3)
    none = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = ODD + [(i, t) for i, t in zip(none, (None, "", " \n", "one", "a a"), strict=False)] + [(100 + i, r.choice([" ", "\n", " \t ", "\x0b"]).join(f"w{v}" for v in planted(r, r.randint(0, 260), r.choice([2, 50])))) for i in range(300)]
    got = entries.op12_periods(spark, written(spark, tmp_path / "t", rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(x) for x in got.collect()) == Counter(periods_by_hand(i, t) for i, t in rows)


def test_collapsed_texts_and_clashing_columns(spark):
    text = "start " + "la le " * 20 + "end\n" + "x " * 30
    got = {x["doc_id"]: x for x in periods.find(frame(spark, [(1, text), (2, None), (3, "a b")])).collect()}
    assert got[1]["collapsed"] == "start la le end x" and got[1]["n_words"] == 72
    assert [tuple(v) for v in got[1]["runs"]] == [(1, 40, 2), (42, 30, 1)] and tuple(got[1]["strongest"]) == (42, 30, 1)
    assert (got[2]["runs"], got[2]["strongest"], got[2]["collapsed"], got[2]["n_words"]) == ([], None, "", 0)
    assert got[3]["collapsed"] == "a b" and got[3]["form"] == "f"
    assert periods.find(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="periods"):
        periods.find(frame(spark, []), times=1)


def grams_by_hand(text, longest):
    """Counts of n-grams of lower-case letters with gaps between stretches."""
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    if not kept.strip():
        return Counter()
    s = f" {' '.join(kept.split(' ')).strip()} "
    s = re.sub(" +", " ", s)
    return Counter(s[i : i + n] for n in range(1, longest + 1) for i in range(len(s) - n + 1))


def place_by_hand(gram, buckets):
    code = 0
    for n, c in enumerate(gram, 1):
        code = (code + ord(c) + n) * 0x9E3779B97F4A7C15 % 2**64
    return code >> 64 - (buckets.bit_length() - 1)


@pytest.mark.parametrize("window", [1 << 20, 7])
def test_counts_of_ngrams_are_those_of_plain_python(monkeypatch, window):
    texts = [t for _, t in ODD] + ["Été—là", "123 45", "ß ẞ İx", "a"]
    monkeypatch.setattr(language, "_TOGETHER", 100)
    ends, at, n = language.counted_each(texts, 3, 1 << 12)
    for k, t in enumerate(texts):
        want = Counter()
        for g, c in grams_by_hand(t, 3).items():
            want[place_by_hand(g, 1 << 12)] += c
        a, c = language.counted(t, 3, 1 << 12, window)
        assert dict(zip(a.tolist(), c.tolist(), strict=True)) == want
        first = ends[k - 1] if k else 0
        assert dict(zip(at[first : ends[k]].tolist(), n[first : ends[k]].tolist(), strict=True)) == want


def test_leader_steps_are_those_of_the_published_rule():
    """Every coordinate of every class by itself: z, n and the closed form of its weight."""
    r = np.random.default_rng(2)
    leader = language.Leader(6, 3, rate=0.3, steady=0.7, l1=0.05, l2=0.2)
    z, n = np.zeros((7, 3)), np.zeros((7, 3))

    def weight(j, k):
        return 0.0 if abs(z[j, k]) <= 0.05 else -(z[j, k] - np.sign(z[j, k]) * 0.05) / ((0.7 + np.sqrt(n[j, k])) / 0.3 + 0.2)

    for _ in range(40):
        at = np.sort(r.choice(6, 3, replace=False))
        v, y = r.random(3), int(r.integers(3))
        leader.learn(at, v, y)
        x = dict(zip(at.tolist(), v.tolist(), strict=True)) | {6: 1.0}
        w = {(j, k): weight(j, k) for j in x for k in range(3)}
        e = np.exp([sum(x[j] * w[j, k] for j in x) for k in range(3)])
        p = e / e.sum()
        for j in x:
            for k in range(3):
                g = (p[k] - (k == y)) * x[j]
                z[j, k] += g - (np.sqrt(n[j, k] + g * g) - np.sqrt(n[j, k])) / 0.3 * w[j, k]
                n[j, k] += g * g
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)
    assert np.allclose(leader.weights(), [[weight(j, k) for k in range(3)] for j in range(7)])
    assert (leader.weights() == 0).any()


def test_temperature_is_the_best_of_a_grid():
    r = np.random.default_rng(1)
    y = r.integers(0, 3, 400)
    logits = r.normal(size=(400, 3)) * 4
    logits[np.arange(400), y] += 3
    t = language.fit_temperature(logits, y)

    def loss(t):
        e = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return -np.log((e / e.sum(axis=1, keepdims=True))[np.arange(400), y]).mean()

    assert loss(t) <= min(loss(x) for x in np.geomspace(0.05, 20, 300)) + 1e-9


WORDS = {"en": "the quick brown fox jumps over lazy dog while others watch", "fr": "le vif renard brun saute par dessus chien paresseux été là", "de": "der schnelle braune fuchs springt über den faulen hund straße"}


def corpus(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choices(["en", "fr", "de"], [8, 2, 1])[0]
        rows.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(3, 40))), lang))
    return rows


def test_op13_learns_from_its_folds_alone_and_predicts_the_held_out(spark, tmp_path):
    odd = [(9001, None, "en"), (9002, "", "fr"), (9003, "12 — 34", "de"), (None, "the dog", "en"), (9004, "the quick fox", None), (9005, "le renard saute", "fr"), (9005, "le renard saute", "fr")]
    rows = corpus(600) + odd
    # what is held out has wrong labels: they would be seen in the results if they were learned from
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    told = [(i, t, "xx" if fold(i) else x) for i, t, x in rows]
    got = entries.op13_language(spark, written(spark, tmp_path / "t", told)).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((i, fold(i)) for i, _, _ in rows)
    truth = {i: x for i, t, x in rows if t and re.search(r"[a-z]", t)}
    by_id = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["lang_pred"] == "xx" for r in got)
    seen = [i for i in truth if i is not None and truth[i] is not None]
    assert sum(by_id[i]["lang_pred"] == truth[i] for i in seen) > 0.97 * len(seen)
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert by_id[9004]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "en"


def test_document_counts_and_sample_cover_what_they_should(spark):
    rows = corpus(300) + [(7, "le chien", "fr")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    total, seen = language.document_counts(df, 2, 1 << 10)
    want = Counter(p for _, t, _ in rows for p in {place_by_hand(g, 1 << 10) for g in grams_by_hand(t, 2)})
    assert total == len(rows) and {k: v for k, v in enumerate(seen.tolist()) if v} == want
    counts = Counter(x for *_, x in rows)
    got = language.sample(df, dict(counts), 60, 10**9, 2, 1 << 10)
    # languages take turns, and the copies count once
    assert Counter(x for *_, x in got) == {"en": 20, "fr": 20, "de": 20} and [x for *_, x in got[:3]] == ["de", "en", "fr"]
    few = language.sample(df, dict(counts), 60, sum(len(r[0]) for r in got[:10]), 2, 1 << 10)
    assert [(a.tolist(), x) for a, _, x in few] == [(a.tolist(), x) for a, _, x in got[:10]]
    assert language.quotas({"a": 2, "b": 100, "c": 100}, 30) == {"a": 2, "b": 14, "c": 14}


def test_nothing_or_one_language_to_learn_from(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    none = spark.createDataFrame([(1, "text", None, "x"), (None, "text", "en", "x")], schema)
    model = language.fit(none.select("doc_id", "text", "lang"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(none, model).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "some text", "en", "x") for i in range(20)] + [(30, "", None, "x")], schema)
    model = language.fit(one.select("doc_id", "text", "lang"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(one, model).collect()} == {("en", 1.0), ("und", 0.0)}
    assert language.predict(one.limit(0), model).count() == 0
    assert language.fit(one.limit(0).select("doc_id", "text", "lang")).languages == []
    with pytest.raises(ValueError, match="power"):
        language.fit(one.select("doc_id", "text", "lang"), buckets=1000)


def test_a_long_text_is_scored_whole_and_alike(spark):
    rows = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    long = WORDS["fr"] * 8000
    got = language.predict(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string"), model).collect()
    assert {r["lang_pred"] for r in got} == {"fr"} and len({r["score"] for r in got}) == 1


