"""Similarity self-join on word shingles, by token-combination prefixes.

A document's set has its distinct shingles of ``width`` words. Tokens (64-bit
hashes of shingles) are ordered with rare ones first. If two sets reach the
threshold they share at least a = ceil(threshold * size) tokens, so their first
d common tokens lie in the first size - a + d tokens of both.

* Rare tokens are indexed singly, over the prefix for d = 1.
* Frequent tokens are dealt to ``classes`` classes. If no common token is rare,
  the first classes + 1 common tokens lie in the prefix for d = classes + 1, and
  two of them are in one class: pairs of tokens of one class are indexed.
* Sets too small to need classes + 1 common tokens, and those over
  ``pairs_up_to`` tokens, whose pairs would be many, index frequent tokens
  singly; sets that could be similar to one of either kind do both.

So every similar pair shares a signature. The documents that share one are
split where sizes are too far apart to be similar; of each part, the smallest
set is the centre, and the others are its members. Members of a centre are
gathered by blocks of bounded size and verified in two steps:

* With bitmaps alone: a set's bitmap has a bit for each of 2^k places, at least
  as many as the set has tokens, that tells whether an odd number of its tokens
  hash there. Every bit in which two bitmaps differ stands for a token that one
  set alone has, so two sets of sizes x and y have at most (x + y - bits) / 2
  tokens in common. The longer of two bitmaps is folded to the other's length.
  Who can reach the threshold with none of the block goes.
* With whole sets: all are compared with the centre; those that reach the
  threshold are in one component already, and whatever does not is compared
  with all others of that block. No pairs are emitted: what leaves a block are
  the links that span it. At first each set goes to one block of one centre
  alone, the centre with most members. Then all blocks are done whose sets are
  not in one component yet and were not all there the first time. Both times,
  bitmaps are compared again first, so that whole sets move only of those that
  could be similar to one that is there, and the second time to one of another
  component.

The join never shuffles texts: sets are made where texts are read, of the
documents asked for. What a written table was shuffled through is removed behind it.

Equal sets count as one set from the start, under their smallest document.
All comparisons are exact counts of common tokens. A token is a 64-bit hash of
its words' 8-byte lanes, each mixed with its place before lanes are added; sets
count as equal that agree in size and in two sums of 64 bits over their tokens.
Different shingles with one hash, about n^2 / 2^65 pairs among n, would count as
the same.

Which tokens are frequent is counted over all documents; tokens that occur
once among the documents of a batch are not counted for that batch, which may
take a token for rare and changes the work, not the result.

Defined cases: null and empty texts, and texts without words, have no shingle
and link with nothing; fewer words than ``width`` make one shingle of all; rows
with a null id are returned with a null component; rows that repeat an id count
as one document, each with its own number of shingles; empty tables give empty
results; results have only the columns named, so that others never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_of, shuffles_removed, tidied
from .components import connected

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_SLICE = 1 << 20  # bytes of text hashed at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], _U)  # the first n bytes of a lane


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (the finaliser of splitmix64)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: its 8-byte lanes, each mixed with its place, added up and mixed with its length."""
    if not len(starts):
        return np.zeros(0, _U)
    size = stops - starts
    lanes = (size + 7) // 8
    first = np.r_[0, np.cumsum(lanes)[:-1]]
    place = np.arange(lanes.sum()) - np.repeat(first, lanes)
    at = np.repeat(starts, lanes) + 8 * place
    padded = np.r_[data, np.zeros(8, np.uint8)]
    value = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel().astype(_U)
    value &= _KEEP[np.minimum(np.repeat(size, lanes) - 8 * place, 8)]
    mixed = mix(value ^ mix(place.astype(_U), 9), 1)
    return mix(np.add.reduceat(mixed, first) + size.astype(_U), 1)


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int) -> None:
        self.width = width

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """One array for each text, in order."""
        binary = texts.cast(pa.large_binary())
        ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(binary):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + _SLICE, side="right")) - 1)
            yield from self._slice(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            i = j

    def _slice(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        low = _LOWER[data]
        space = _SPACE[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[ends] = True
        word = ~space
        starts = np.flatnonzero(word & (np.r_[True, space[:-1]] | edge[:-1])) if len(low) else np.zeros(0, int)
        stops = np.flatnonzero(word & (np.r_[space[1:], True] | edge[1:])) + 1 if len(low) else np.zeros(0, int)
        words = word_hashes(low, starts, stops)
        first = np.searchsorted(starts, ends)  # of each document's words
        w, n = self.width, len(words)
        rolled = np.zeros(max(0, n - w + 1), _U)
        for k in range(w):
            rolled = rolled * _BASE + words[k : n - w + 1 + k] if len(rolled) else rolled
        rolled = mix(rolled, 2)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= w:
                out.append(np.unique(rolled[a : b - w + 1]))
            elif b > a:
                h = np.array([b - a], _U)
                for x in words[a:b]:
                    h = h * _BASE + x
                out.append(mix(h, 3))
            else:
                out.append(np.zeros(0, _U))
        return out


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def ordered(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rare tokens, and frequent ones from the least frequent on; ``frequent`` is sorted, ``counts`` are theirs."""
    if not len(frequent):
        return tokens, tokens[:0]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = frequent[at] == tokens
    return tokens[~often], tokens[often][np.lexsort((tokens[often], counts[at[often]]))]


def signatures(rare: np.ndarray, common: np.ndarray, percent: int, classes: int, pairs_up_to: int) -> np.ndarray:
    """Signatures of one set in order."""
    n = len(rare) + len(common)
    if not n:
        return rare
    near = n - least_overlap(n, percent) + 1
    out = [rare[:near]]
    if len(common):
        small = classes * 100 // percent * 100 // percent  # sets that could be similar to one without classes + 1 common tokens
        if n <= small or 100 * n >= percent * pairs_up_to:
            out.append(common[: max(0, near - len(rare))])
        if percent * n <= 100 * pairs_up_to:
            far = common[: max(0, near + classes - len(rare))]
            kind = mix(far, 4) % _U(classes)
            for k in np.unique(kind):
                same = np.sort(far[kind == k])
                i, j = np.triu_indices(len(same), 1)
                out.append(mix(same[i] * _BASE + mix(same[j], 5), 6))
    return np.unique(np.concatenate(out))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Words of 64 bits, a power of two of them and a bit for each token at least: whether an odd number of tokens hash to each place."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((mix(tokens, 10) & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def folded(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of one length, that of the shortest: a place's tokens go to the place modulo the length."""
    words = min(map(len, bitmaps))
    return np.array([np.bitwise_xor.reduce(b.reshape(-1, words), axis=0) for b in bitmaps])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, _U)]).view(np.int64)))


def frequent_tokens(docs: DataFrame, width: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in more than ``share`` of the documents (and ``least``), and their counts.

    There are at most (mean size of a set) / share of them, whatever the number of documents.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in parts_of(batches, 2500):
            found, n = np.unique(np.concatenate([*shingler.sets(b.column(0)), np.zeros(0, _U)]), return_counts=True)
            again = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(found[again].view(np.int64)), pa.array(n[again].astype(np.int64))], names=["token", "n"])

    bound = max(least, int(share * docs.count()))
    rows = docs.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= bound).toArrow()
    tokens, counts = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    tokens = tokens.view(_U)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class _Postings:
    """Which sets have which tokens; a token that a set has twice counts twice."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def common(self, i: int) -> np.ndarray:
        """Tokens that set i has in common with each."""
        a, b = (np.searchsorted(self.tokens, self.sets[i], side=s) for s in ("left", "right"))
        span = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))


def could_link(bitmaps: list[np.ndarray], sizes: np.ndarray, percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Which of the sets could be similar to another, of another label if there are labels, by their sizes and bitmaps."""
    order = np.argsort(sizes, kind="stable")
    n, maps, fit = sizes[order], [bitmaps[k] for k in order], np.zeros(len(sizes), bool)
    label = np.arange(len(sizes)) if labels is None else labels[order]
    to = np.searchsorted(n * percent, n * 100, side="right")  # the first set too large for each
    words = np.array([len(b) for b in maps])
    for w in np.unique(words):  # larger sets have no shorter bitmaps
        a, z = np.searchsorted(words, w), np.searchsorted(words, w, side="right")
        rows = folded(maps[a : to[z - 1]])
        for i in range(a, z):
            apart = np.bitwise_count(rows[i + 1 - a : to[i] - a] ^ rows[i - a]).sum(axis=1, dtype=np.int64)
            near = ((100 + percent) * apart <= (100 - percent) * (n[i + 1 : to[i]] + n[i])) & (label[i + 1 : to[i]] != label[i])
            fit[i] |= near.any()
            fit[i + 1 : to[i]] |= near
    out = np.zeros(len(sizes), bool)
    out[order] = fit
    return out


def links_of(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span what is similar among sets of one centre; the first, the centre if it is here, is compared with all."""
    sizes = np.array([len(s) for s in sets])
    posts = _Postings(sets)

    def similar(i: int) -> np.ndarray:
        both = posts.common(i)
        return np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + sizes[i] - both)))

    one = _Union(len(sets))
    out = []
    linked = similar(0)
    for i in [0, *np.setdiff1d(np.arange(1, len(sets)), linked).tolist()]:
        for j in (linked if i == 0 else similar(i)).tolist():
            if i != j and one.join(i, j):
                out.append((ids[i], ids[j]))
    return out


def _groups(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[tuple[int, int, int], list[int], list[int], list[int], list[np.ndarray]] | None]:
    """Key (c, i, j), ids, sizes, labels and the 64-bit words in each ``value`` of each run of rows with one key; None where a batch ends."""
    key, ids, sizes, labels, found = None, [], [], [], []
    for b in batches:
        keys = zip(*(b.column(k).to_pylist() for k in "cij"), strict=True)
        for k, x, n, label, words in zip(keys, *(b.column(name).to_pylist() for name in ("x", "n", "label")), b.column(value), strict=True):
            if k != key:
                if len(ids) > 1:
                    yield key, ids, sizes, labels, found
                key, ids, sizes, labels, found = k, [], [], [], []
            ids.append(x)
            sizes.append(n)
            labels.append(label)
            found.append(np.frombuffer(words.as_buffer(), "<u8").copy())
        yield None
    if len(ids) > 1:
        yield key, ids, sizes, labels, found


def _if_small(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast, behind a count; beyond ``rows`` rows the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def _of_nodes(docs: DataFrame, nodes: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among the distinct ``nodes``, found where they are read.

    Beyond ``broadcast_rows`` nodes, others may be among them: as many words of
    64 bits are broadcast, in which each node sets the bit its hash falls on.
    """
    if nodes.count() <= broadcast_rows:
        return docs.join(F.broadcast(nodes), "doc_id", "left_semi")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(64 * max(1, broadcast_rows)))
    at = {"word": F.shiftright(place, 6), "bit": F.expr("shiftleft(1L, cast(place & 63 as int))")}
    words = nodes.withColumn("place", place).withColumns(at).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    known = docs.withColumn("place", place).withColumns(at).join(F.broadcast(words), "word")
    return known.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*docs.columns)


def _dealt(rows: DataFrame, value: str) -> DataFrame:
    return rows.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", F.col("x") != F.col("c"), "x").select("c", "i", "j", "x", "n", "label", value)


def star_rows(posts: DataFrame, percent: int) -> DataFrame:
    """(c, cn, x, n): each post's centre, the smallest set of its run, and its size; centres themselves are left out.

    Posts (sig, n, rep) are sorted by ranges of all three columns, so that a
    signature that many sets share is dealt over many tasks. A run ends where
    the signature does, or where the next set is too large to be similar to the
    one before. What a task meets before the first end may belong to a run of
    the task before: these rows are marked, and get their centre from what the
    tasks say of their first and last rows, a line for each.
    """
    schema = "part int, kind string, sig long, n long, c long, cn long, x long"  # kind: in, lead, first, last, or through where one run fills the task
    names = ["part", "kind", "sig", "n", "c", "cn", "x"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, lead = None, True  # signature, size, centre and its size of the row before; whether its run began with the task

        def rows(kind: str, sig: np.ndarray, n: np.ndarray, c: np.ndarray, cn: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            size = len(x)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, part, np.int32)), pa.array([kind] * size, pa.string()), *(pa.array(v, pa.int64()) for v in (sig, n, c, cn, x))], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            sig, n, rep = (b.column(k).to_numpy(zero_copy_only=False) for k in ("sig", "n", "rep"))
            starts = np.r_[True, (sig[1:] != sig[:-1]) | (percent * n[1:] > 100 * n[:-1])]
            if last is None:
                yield rows("first", sig[:1], n[:1], rep[:1], n[:1], rep[:1])
            else:
                starts[0] = sig[0] != last[0] or percent * n[0] > 100 * last[1]
            begin = np.maximum.accumulate(np.where(starts, np.arange(len(sig)), -1))
            c, cn = (np.where(begin < 0, 0 if last is None else last[k], v[np.maximum(begin, 0)]) for k, v in ((2, rep), (3, n)))
            further = np.cumsum(starts) > (last is None)  # runs that begin behind the task's first row
            leading = lead & ~further
            for kind, which in (("lead", leading), ("in", ~leading & (rep != c))):
                if which.any():
                    yield rows(kind, sig[which], n[which], c[which], cn[which], rep[which])
            lead = bool(leading[-1])
            last = (sig[-1], n[-1], c[-1], cn[-1])
        if last is not None:
            yield rows("through" if lead else "last", *(np.array([v]) for v in (*last, last[2])))

    dealt = posts.select("sig", F.col("n").cast("long"), "rep").repartitionByRange("sig", "n", "rep").sortWithinPartitions("sig", "n", "rep")
    found = cut(dealt.mapInArrow(tidied(runs), schema))
    ends: dict[int, dict] = {}
    for r in found.where("kind in ('first', 'last', 'through')").collect():  # two lines a task
        ends.setdefault(r["part"], {})[r["kind"] == "first"] = r
    before, centres = None, []
    for part in sorted(ends):
        first, last = ends[part][True], ends[part][False]
        goes_on = before is not None and first["sig"] == before[0] and percent * first["n"] <= 100 * before[1]
        centre = before[2:] if goes_on else (first["c"], first["cn"])
        centres.append((part, *centre))
        before = (last["sig"], last["n"], *(centre if last["kind"] == "through" else (last["c"], last["cn"])))
    of = found.sparkSession.createDataFrame(centres, "part int, c long, cn long")
    lead = found.where("kind = 'lead'").select("part", "x", "n").join(F.broadcast(of), "part").where("x <> c").select("c", "cn", "x", "n")
    return found.where("kind = 'in'").select("c", "cn", "x", "n").unionByName(lead)


def similar_links(classes_of: DataFrame, docs: DataFrame, width: int, percent: int, block_tokens: int, broadcast_rows: int) -> DataFrame:
    """(a, b): links that span the components of the classes' sets. classes_of: rep, n, sigs, bits."""
    stars = cut(star_rows(classes_of.select(F.explode("sigs").alias("sig"), "n", "rep"), percent).groupBy("c", "cn", "x").agg(F.max("n").alias("n")))
    blocks = stars.groupBy("c").agg(F.ceil((F.sum("n") + F.max("cn")) / block_tokens).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    tile = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    members = stars.join(blocks, "c").select("c", "x", F.explode(tile).alias("t"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    centres = blocks.select("c", F.col("c").alias("x"), F.explode(every).alias("t"))
    wanted = cut(members.unionByName(centres).select("c", "x", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("x").alias("label")))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int, int]] = []
        for group in _groups(batches, "bits"):
            if group:
                (c, i, j), ids, sizes, labels, bitmaps = group
                out += [(c, i, j, ids[k], labels[k]) for k in np.flatnonzero(could_link(bitmaps, np.array(sizes), percent, np.array(labels)))]
            else:
                yield rows_of(out)
                out = []
        yield rows_of(out)

    def rows_of(out: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((),) * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, kinds, strict=True)], names=["c", "i", "j", "x", "label"])

    bitmaps = classes_of.select(F.col("rep").alias("x"), "n", "bits")

    def fitting(rows: DataFrame) -> DataFrame:
        """Of ``rows`` (c, i, j, x, label), those that could be similar to one of another label of their block."""
        return cut(_dealt(bitmaps.join(_if_small(rows, broadcast_rows), "x"), "bits").mapInArrow(tidied(kept), "c long, i int, j int, x long, label long"))

    left = fitting(wanted).select("c", "i", "j", "x")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in parts_of(batches):
            found = list(shingler.sets(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["x", "n", "tokens"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, "tokens"):
            if group:
                out += links_of(group[1], group[4], percent)
            else:
                yield pairs_of(out)
                out = []
        yield pairs_of(out)

    def pairs_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def verified(rows: DataFrame) -> DataFrame:
        nodes = rows.select(F.col("x").alias("doc_id")).distinct()
        tokens = _of_nodes(docs, nodes, broadcast_rows).select("doc_id", "text").mapInArrow(sets, "x long, n long, tokens binary").where("n > 0")
        return cut(_dealt(tokens.join(_if_small(rows, broadcast_rows), "x"), "tokens").mapInArrow(tidied(links), "a long, b long"))

    tile = ["c", "i", "j"]
    members = left.where("x <> c").select("c", "x").distinct()
    best = members.join(members.groupBy("c").agg(F.count(F.lit(1)).alias("m")), "c").groupBy("x").agg(F.max(F.struct("m", -F.col("c"))).alias("b")).select("x", (-F.col("b.col2")).alias("c"))
    chosen = left.join(best, ["c", "x"], "left_semi").where("i = j")
    here = chosen.select(*tile).distinct()
    once = cut(chosen.unionByName(left.where("x = c").join(here, tile, "left_semi").select(*chosen.columns)))
    first = verified(fitting(once.withColumn("label", F.col("x"))))
    label = connected(first).select(F.col("node").alias("x"), "component")
    seen = once.withColumn("seen", F.lit(True))
    labelled = left.join(label, "x", "left").select(*tile, "x", F.coalesce("component", "x").alias("label"))
    open_tiles = (
        labelled.join(seen, [*tile, "x"], "left")
        .groupBy(*tile)
        .agg((F.min("label") != F.max("label")).alias("apart"), F.bool_and(F.coalesce("seen", F.lit(False))).alias("done"))
        .where("apart and not done")
    )
    return first.unionByName(verified(fitting(cut(labelled.join(open_tiles.select(*tile), tile, "left_semi")))))


def join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, share: float = 0.0001, least: int = 8,
    classes: int = 32, pairs_up_to: int = 2000, block_tokens: int = 1_000_000, broadcast_rows: int = 250_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    with shuffles_removed(docs.sparkSession):
        sizes, component = _components(rows, width, percent, share, least, classes, pairs_up_to, block_tokens, broadcast_rows)
    out = sizes.join(component, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _components(
    rows: DataFrame, width: int, percent: int, share: float, least: int, classes: int, pairs_up_to: int, block_tokens: int, broadcast_rows: int
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of every row, and (node, component) of the documents that are not alone; both written."""
    frequent, counts = frequent_tokens(rows, width, share, least)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in parts_of(batches):
            found = list(shingler.sets(b.column(1)))
            k1, k2 = (np.array([mix(s, salt).sum(dtype=_U) for s in found], _U).view(np.int64) for salt in (7, 8))
            n = pa.array([len(s) for s in found], pa.int64())
            signs = [signatures(*ordered(s, frequent, counts), percent, classes, pairs_up_to) for s in found]
            arrays = [b.column(0), n, pa.array(k1), pa.array(k2), _lists(signs), pa.array([bitmap(s).tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "k1", "k2", "sigs", "bits"])

    signed_rows = cut(rows.mapInArrow(signed, "doc_id long, n long, k1 long, k2 long, sigs array<long>, bits binary"))
    reps = cut(signed_rows.where("doc_id is not null and n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")))
    # rows that are no class's representative: copies, and rows of one id that hold other texts
    copies = cut(signed_rows.select("doc_id", "n", "k1", "k2").where("doc_id is not null and n > 0").join(reps, ["n", "k1", "k2"]).where("doc_id <> rep"))
    gone = copies.select("doc_id", "n", "k1", "k2").distinct()
    classes_of = (
        signed_rows.where("doc_id is not null and n > 0")
        .join(_if_small(gone, broadcast_rows), ["doc_id", "n", "k1", "k2"], "left_anti")
        .select(F.col("doc_id").alias("rep"), "n", "sigs", "bits")
    )
    links = similar_links(classes_of, rows, width, percent, block_tokens, broadcast_rows)
    again = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return signed_rows.select("doc_id", F.col("n").alias("n_shingles")), connected(links.unionByName(again))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, of rows without an id only where no other has one.

    Rows whose id is null or repeats are written once with a key of their own,
    by which they take part as any other row. Rows without words are alone in
    their group, and stay.
    """
    key, id_of = "__key", F.col(doc_id).cast("long")
    repeated = cut(docs.select(id_of.alias("__id")).where("__id is not null").groupBy("__id").count().where("count > 1").select("__id"))
    plain = docs.where(F.col(doc_id).isNotNull()).join(repeated, id_of == F.col("__id"), "left_anti")
    others = docs.where(F.col(doc_id).isNull()).unionByName(docs.join(repeated, id_of == F.col("__id"), "left_semi"))
    odd = cut(others.withColumn(key, F.monotonically_increasing_id()))
    last = odd.agg(F.max(key)).first()[0]
    if last is None:
        found = join(docs, doc_id=doc_id, text=text, **options)
        gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, id_of == F.col("__gone"), "left_anti")
    ends = plain.agg(F.min(id_of).alias("a"), F.max(id_of).alias("z")).first()
    low, high = ends["a"] or 0, ends["z"] or 0
    if high + last + 1 < 1 << 63:
        free = F.col(key) + F.lit(high + 1)
    elif low - last - 1 >= -(1 << 63):
        free = F.lit(low - 1) - F.col(key)
    else:
        raise ValueError("ids leave no room for the keys of rows without one")
    odd = odd.withColumn(key, free)
    rows = plain.select(id_of.alias(key), F.col(text).alias("__text")).unionByName(odd.select(key, F.col(text).alias("__text")))
    found = join(rows, doc_id=key, text="__text", **options).select(F.col("doc_id").alias(key), F.col("component_id").alias("c"))
    known = odd.select(key, F.struct(id_of.isNull().alias("none"), id_of.alias("id"), F.col(key).alias("k")).alias("own"))
    ranked = found.join(known, key, "left").withColumn("own", F.coalesce("own", F.struct(F.lit(False).alias("none"), F.col(key).alias("id"), F.col(key).alias("k"))))
    first = ranked.groupBy("c").agg(F.min("own").alias("first"))
    gone = cut(ranked.join(first, "c").where("own.k <> first.k").select(F.col(key).alias("__gone")))
    stay = plain.join(gone, id_of == F.col("__gone"), "left_anti")
    return stay.unionByName(odd.join(gone, F.col(key) == F.col("__gone"), "left_anti").select(*docs.columns))
