"""Operators on texts against brute force, on small tables with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
import time
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import bpe, components, fingerprints, ngram_join, sstable

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, score double, ids string, fingerprint string, slot string, component_id string"


def frame(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, 9.0, "x", "y", "z", "w") for i, t in rows], SCHEMA)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "one"), (6, "a b c d"), (6, "a b c d"), (None, "no id at all"), (7, "tab\there\nand\r\nlines nbsp"),
    (8, "don't we'll they've 'S 12ab34 naïve ÉCOLE ½ ² 漢字 🙂🙂 é"), (9, "x" * 5000), (10, "word " * 3000), (11, "!" * 4000 + " " * 700 + "end"), (12, "a\x1cb\x85c"),
]


@pytest.fixture(scope="module")
def merges():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def random_texts(n, seed=5):
    r = random.Random(seed)
    alphabet = "ab cdé'  \n\t12!?ſ漢🙂st"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 400))) for _ in range(n)]


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (40, 12), (16, 4)])
def test_encoding_is_that_of_the_library_whatever_the_chunks(spark, merges, chunk, overlap):
    rows = ODD + [(100 + i, t) for i, t in enumerate(random_texts(150))]
    got = bpe.encode(frame(spark, rows), PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    decoded = bpe.decode(got, PATH).collect()
    want = sorted((str(i), merges.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in decoded) == want
    assert sorted(bytes(r["bytes"]) for r in decoded) == sorted((t or "").encode() for _, t in rows)


def test_encoding_an_empty_table(spark):
    assert bpe.encode(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(frame(spark, []), PATH, public_tokenizers.PATTERN, decoded="bytes").columns == ["doc_id", "ids", "bytes"]


@pytest.mark.parametrize("chunk", [32_768, 40])
def test_decoding_beside_the_encoding_gives_the_same(spark, chunk):
    rows = ODD + [(100 + i, t) for i, t in enumerate(random_texts(60, 3))]
    got = bpe.encode(frame(spark, rows), PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=12, decoded="back").collect()
    assert sorted((str(r["doc_id"]), bytes(r["back"])) for r in got) == sorted((str(i), (t or "").encode()) for i, t in rows)


def test_decoding_null_lists_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, [64, 65]), (2, None), (3, []), (4, [50255])], "doc_id long, ids array<int>")
    by_id = {i: t for t, i in bpe.read_ranks(PATH).items()}
    got = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(df, PATH).collect()}
    assert got == {1: by_id[64] + by_id[65], 2: b"", 3: b"", 4: by_id[50255]}
    with pytest.raises(Exception, match="out of bounds|IndexError"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), PATH).collect()


def hard_texts(n, seed):
    r = random.Random(seed)
    alphabet = "ab cdé'  \n\t12!?ſ漢🙂st \x1c\u3000\xa0"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", " ", "  ", "a ", " a", "a  ", "\u3000 b", "x<|endoftext|> y"]


@pytest.mark.parametrize("part_bytes, kept", [(8 << 20, 300_000), (500, 50), (1, 0)])
def test_words_have_the_ids_of_whole_texts(merges, part_bytes, kept):
    from tokenizers import Tokenizer

    from gridloom.llm import words

    texts = hard_texts(3000, part_bytes)
    size = np.zeros(50_256, np.int64)
    for token, i in bpe.read_ranks(PATH).items():
        size[i] = len(token)
    of = words.WordEncoder(lambda t: np.array(merges.encode_ordinary(t), np.int32), size, part_bytes=part_bytes, kept=kept)
    assert of(pa.array(texts)).to_pylist() == [merges.encode_ordinary(t) for t in texts]
    assert of(pa.array([], pa.string())).to_pylist() == []
    assert len(of.words) <= max(kept, 0)
    tokenizer = Tokenizer.from_file(JSON)
    assert sstable.tokenizer_encoder(JSON, match_added=True)(pa.array(texts)).to_pylist() == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_files_that_are_not_byte_level_are_encoded_whole(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    texts = hard_texts(300, 1)
    assert sstable.tokenizer_encoder(path, match_added=True)(pa.array(texts)).to_pylist() == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def canonical(t):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", folded).strip()


def test_fingerprints_follow_the_canonical_form(spark):
    rows = ODD + [(20, "École  ½"), (21, " ÉCOLE 1⁄2 "), (22, "ﬁne"), (23, "FINE"), (24, "straße"), (25, "STRASSE"), (26, "fine")]
    got = fingerprints.with_fingerprint(frame(spark, rows)).select("doc_id", "text", "fingerprint").collect()
    by_text = {}
    for r in got:
        by_text.setdefault(canonical(r["text"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert all(re.fullmatch("[0-9a-f]{32}", r["fingerprint"]) for r in got)


@pytest.mark.parametrize("bits", [32_768, 1 << 27])
def test_groups_of_equal_canonical_bytes(spark, bits):
    rows = [(i, t) for i, t in ODD if i is not None] + [(30 + i, f"Text {i % 7}") for i in range(60)]
    got = fingerprints.exact_groups(frame(spark, rows), max_bits=bits).collect()
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault(canonical(t), i)
    assert sorted((r["doc_id"], r["group_id"]) for r in got) == sorted((i, first[canonical(t)]) for i, t in rows)


def test_groups_hold_where_different_texts_share_a_fingerprint(spark, monkeypatch):
    """Texts of equal length are made to collide: bytes tell them apart, whether their group is large, small or of one."""
    monkeypatch.setattr(fingerprints, "wide_hash", lambda canon: F.lpad(F.length(canon).cast("string"), 32, "0"))
    texts = ["aa"] * 40 + ["bb"] * 3 + ["ccc"] * 2 + ["dddd", "eeeee"] + ["ffffff"] * 30 + [None, "", "  "]
    rows = list(enumerate(texts, 1)) + [(None, "aa"), (None, "ffffff"), (7, "aa"), (7, "gggg")]
    got = fingerprints.exact_groups(frame(spark, rows)).collect()
    first = {}
    for i, t in rows:
        if i is not None:
            first[canonical(t)] = min(i, first.get(canonical(t), i))
    key = lambda r: (r[0] or 0, r[1], r[2])
    want = sorted(((i, str(len(canonical(t))).zfill(32), first[canonical(t)]) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["fingerprint"], r["group_id"]) for r in got), key=key) == want
    assert fingerprints.exact_groups(frame(spark, rows).limit(0)).count() == 0


def test_common_groups_find_their_first_by_broadcast_and_others_by_their_fingerprint(spark):
    rows = [(i, "copied" if i % 2 else f"pair {i // 4}") for i in range(8000)]
    got = fingerprints.exact_groups(frame(spark, rows))
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert sorted((r["doc_id"], r["group_id"]) for r in got.collect()) == [(i, first[t]) for i, t in rows]


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_text_wraps_around(spark, buckets):
    rows = [(i * 7 % 101, f"t{i * 7 % 101}") for i in range(101)] + [(None, "no next"), (None, "none")]
    add = {"next_text": "text"}
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", add, buckets).collect()
    assert sorted((r["doc_id"], r["next_text"]) for r in got if r["doc_id"] is not None) == [(i, f"t{(i + 1) % 101}") for i in range(101)]
    assert sorted((r["text"], r["next_text"]) for r in got if r["doc_id"] is None) == [("no next", None), ("none", None)]
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string"), "doc_id", add, buckets).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(t, width=5):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, percent=80):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    have, where = [(i, shingles(t)) for i, t in rows if i is not None], defaultdict(list)
    for k, (i, s) in enumerate(have):
        both = Counter(j for token in s for j in where[token])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(have[j][1]) - n):
                a, b = find(i), find(have[j][0])
                up[max(a, b)] = min(a, b)
        for token in s:
            where[token].append(k)
    return {i: find(i) for i in ids}


def near_copies(seed, families=6, size=25, words=60, vocabulary=4000):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    out = []
    for _ in range(families):
        base = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = f"w{r.randrange(vocabulary)}"
            out.append(" ".join(t + (passage if r.random() < 0.3 else [])))
    out += [" ".join(passage + [f"u{r.randrange(vocabulary)}" for _ in range(r.randrange(80))]) for _ in range(40)]
    out += [" ".join(f"v{r.randrange(30)}" for _ in range(r.randrange(9))) for _ in range(60)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize(
    "options",
    [{}, {"share": 0.0, "least": 3, "classes": 2}, {"share": 0.0, "least": 2, "classes": 4, "pairs_up_to": 40}, {"block_tokens": 300, "broadcast_rows": 0}],
)
def test_join_finds_the_components_of_brute_force(spark, options):
    rows = [(i * 3 + 5, t) for i, t in enumerate(near_copies(3))] + [(i, t) for i, t in ODD if i is None or i < 5] + [(2001, "A b C d e f"), (2002, "a B c d e F"), (2001, "other words here in this one")]
    got = ngram_join.join(frame(spark, rows), **options).collect()
    want = brute_components(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, want.get(i)) for i, _ in rows}
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)


def test_words_that_collide_under_polynomial_hashes_do_not_link(spark):
    word = "a"
    while len(word) < 1024:  # an a/b Thue-Morse word and its complement
        word += word.translate({97: "b", 98: "a"})
    texts = [" ".join([w] * 6) for w in (word, word.translate({97: "b", 98: "a"}))] + ["x" * 8 + "y", "x" * 16 + "y", "xy", "y" + "x" * 8]
    sets = list(ngram_join.Shingler(5).sets(pa.array(texts)))
    assert len({x for s in sets for x in s.tolist()}) == len(texts)
    got = ngram_join.join(frame(spark, list(enumerate(texts)))).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_bitmaps_never_exclude_similar_sets():
    r = np.random.default_rng(2)
    for _ in range(300):
        base = r.integers(0, 1 << 63, r.integers(1, 300)).astype(np.uint64)
        other = np.unique(np.r_[base[r.random(len(base)) < 0.9], r.integers(0, 1 << 63, r.integers(0, 20)).astype(np.uint64)])
        sets = [np.unique(base), other]
        both = len(np.intersect1d(*sets))
        similar = len(other) and 100 * both >= 80 * (len(sets[0]) + len(other) - both)
        fit = ngram_join.could_link([ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets]), 80)
        assert fit.tolist() in ([True, True], [False, False]) and (fit.all() or not similar)
    far = [np.unique(r.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(50)]
    assert not ngram_join.could_link([ngram_join.bitmap(s) for s in far], np.full(50, 200), 80).any()


def test_bitmaps_are_compared_by_pairs_and_across_labels():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (9, 10, 12, *range(300, 340))]
    maps, sizes = [ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    assert not ngram_join.could_link(maps, sizes, 80)[3:].any()  # a small set in the block does not blur large ones
    sets += [np.r_[sets[20], sets[3][:2]], sets[0]]
    maps, sizes = [ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    assert set(np.flatnonzero(ngram_join.could_link(maps, sizes, 80))) >= {0, 20, len(sets) - 2, len(sets) - 1}
    labels = np.arange(len(sets))
    labels[[-2, 20]] = 77
    fit = ngram_join.could_link(maps, sizes, 80, labels)
    assert not fit[[20, -2]].any() and fit[[0, -1]].all()


def test_the_join_moves_no_texts_and_leaves_no_shuffle_files(spark):
    r = random.Random(1)
    texts = [" ".join(f"{r.randrange(1 << 40):x}" for _ in range(2000)) for _ in range(200)]
    texts += [t + " one more" for t in texts[:20]]
    docs = frame(spark, list(enumerate(texts)))
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    shuffles = lambda: {str(b) for b in manager.diskBlockManager().getAllFiles().mkString(" ").split() if "shuffle_" in b}
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    moved = lambda: sum(x.shuffleWriteBytes() for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())))
    left, before = shuffles(), moved()
    found = ngram_join.join(docs, broadcast_rows=4)
    for _ in range(40):
        if not shuffles() - left:
            break
        time.sleep(0.25)
    assert not shuffles() - left
    assert moved() - before < sum(map(len, texts)) / 2
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i if i < 200 else i - 200 for i in range(220)}
    assert found.collect() and ngram_join._of_nodes(docs, docs.where("doc_id < 20").select("doc_id"), 4).where("doc_id < 20").count() == 20


@pytest.mark.parametrize("partitions", [1, 7])
def test_stars_of_a_signature_that_spans_many_tasks(spark, partitions):
    r = random.Random(partitions)
    posts = [(r.choice([1, 1, 1, 2, 3, -9]), r.choice([1, 2, 3, 10, 11, 12, 40]), i) for i in range(2000)]
    before, want = None, Counter()
    for sig, n, i in sorted(posts):
        if before is None or sig != before[0] or 80 * n > 100 * before[1]:
            centre = (i, n)
        else:
            want[(*centre, i, n)] += 1
        before = (sig, n)
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = ngram_join.star_rows(spark.createDataFrame(posts, "sig long, n long, rep long").repartition(5), 80)
        assert Counter(map(tuple, found.select("c", "cn", "x", "n").collect())) == want
        assert ngram_join.star_rows(spark.createDataFrame([], "sig long, n long, rep long"), 80).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_join_of_an_empty_table_and_of_copies_alone(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    got = ngram_join.join(frame(spark, [(i, "the same words in all of these") for i in range(50)])).collect()
    assert {r["component_id"] for r in got} == {0}


def test_first_of_each_keeps_one_row_of_each_group(spark):
    def kept(rows):
        got = ngram_join.first_of_each(frame(spark, rows))
        assert got.columns == frame(spark, rows).columns
        return [(str(r["doc_id"]), r["text"]) for r in got.collect()]

    assert sorted(kept([(1, "a b c d e f"), (2, "A B C D E F"), (3, "x y")])) == [("1", "a b c d e f"), ("3", "x y")]
    # rows without an id, with the same id and text, and with the same id and other texts
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "A b c d e f"), (None, "n o"), (None, "N O"), (7, "q r s t"), (7, "q r s t"), (9, "Q R S T"), (8, "one"), (8, "two"), (8, None), (8, "")]
    want = [("1", "a b c d e f"), ("7", "q r s t"), ("8", None), ("8", ""), ("8", "one"), ("8", "two")]
    got = kept([(i, t) for i, t in rows if i is not None])
    assert sorted(map(str, got)) == sorted(map(str, want))
    got = kept(rows + [((1 << 63) - 1, "the last id of all"), (-5, "q r s t")])
    assert sorted(map(str, got)) == sorted(map(str, [w for w in want if w[0] != "7"] + [("-5", "q r s t"), (str((1 << 63) - 1), "the last id of all")] + [g for g in got if g[0] == "None"]))
    assert [g[1].lower() for g in got if g[0] == "None"] == ["n o"]
    assert kept([]) == []


def test_components_of_paths_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 150), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 200: 150, 201: 150}


def test_shards_hold_what_the_library_encodes(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True  # the encoder's match_added is False here
    rows = ODD + [(-5, "negative"), (-(1 << 62), "low"), (1 << 62, "high <|endoftext|>")] + [(1000 + i, t) for i, t in enumerate(random_texts(60, 9))]
    manifest = sstable.write(frame(spark, rows), lambda: sstable.tokenizer_encoder(JSON), end_id=2, folder=str(tmp_path / "s"), partitions=3, block_bytes=300, shard_bytes=2000)
    assert manifest.count() > 3
    got = sorted(sstable.read(manifest).collect(), key=lambda r: (r["start"]))
    keyed = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (r[0], r[1]))
    want, start = [], 0
    for i, t in keyed:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got] == want

    asked = spark.createDataFrame([(6,), (1003,), (-5,), (555,), (None,), (1 << 62,)], "doc_id long")
    found = sstable.lookup(manifest, asked).collect()
    by_id = {i: [b for k, _, _, b in want if k == i] for i in (6, 1003, -5, 1 << 62)}
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == Counter((i, b) for i, bs in by_id.items() for b in bs)


def test_op8_finds_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    from gridloom.llm import entries

    tokenizer = Tokenizer.from_file(JSON)
    rows = [(1, "x <|endoftext|> y"), (2, "a <|endoftext|><|endoftext|>b  c\nd<|endoftext|>"), (3, "<|endoftext|>"), (4, "<|endoftext |> <|endof text|>"), (5, None), (6, "words behind one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, start = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert want[0][2] == 5
    assert sorted(map(tuple, entries.op8_sstable(spark, str(tmp_path)).collect())) == want


def test_shards_of_an_empty_table(spark, tmp_path):
    manifest = sstable.write(frame(spark, []), lambda: sstable.tokenizer_encoder(JSON), end_id=2, folder=str(tmp_path / "s"))
    assert sstable.read(manifest).count() == 0


def test_bloom_filter_excludes_most_absent_ids(spark, tmp_path):
    rows = [(i * 2, "w") for i in range(2000)]
    manifest = sstable.write(frame(spark, rows), lambda: sstable.tokenizer_encoder(JSON), folder=str(tmp_path / "s"), partitions=1)
    shard = sstable.ShardReader(manifest.first()["path"])
    assert all(shard.may_hold(i * 2) for i in range(2000))
    assert sum(shard.may_hold(i * 2 + 1) for i in range(2000)) < 100


def test_queries_digest_what_the_operators_return(spark, tmp_path):
    from gridloom.llm import entries

    rows = [(i, t) for i, t in ODD if i is not None and i != 6]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = dict(rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    merges = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    for r in entries.op4_byte_bpe(spark, str(tmp_path)).collect():
        ids = merges.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((texts[r["doc_id"]] or "").encode()))
    for r in entries.op8_sstable(spark, str(tmp_path)).collect():
        ids = [*merges.encode_ordinary(texts[r["doc_id"]] or ""), 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    spark.createDataFrame([*rows, (None, "no id"), (None, "NO  ID"), (None, "")], "doc_id long, text string").write.parquet(str(tmp_path / "nulls" / "documents.parquet"))
    order = sorted(texts)
    got = entries.op3_fingerprints(spark, str(tmp_path / "nulls")).collect()
    assert len(got) == len(rows) + 3
    assert len({r["fingerprint"] for r in got if r["doc_id"] is None}) == 2
    for r in got:
        if r["doc_id"] is None:
            assert r["near_next"] == 0
            continue
        t = texts[r["doc_id"]] or ""
        following = texts[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited.encode()))
        assert r["near_edited"] == float(canonical(edited) == canonical(t)) and r["near_next"] == float(canonical(following) == canonical(t))
    assert spark.range(1).select(F.lit(1)).count() == 1
