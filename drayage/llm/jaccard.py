"""N-gram Jaccard join: which documents' word-shingle sets are 80 % alike, and what they hang together in.

Exact copies of a set are one node. Shingles are put in one global order, rare
ones first; two sets that link share one of the first n - ceil(0.8 n) + 1 of
each. Those are the index: lists by shingle, sorted by set size. Along a list,
the sizes allow only a block of positions to link with a set, so all other
blocks are skipped.

Answers are derived rather than found anew. Each list is led by its set of least
hash, and a set takes the leader that most of its lists have as its pivot. A set
that is like its pivot is kept as what differs from it: what it has more, and
what it lacks. Of two sets of one pivot P, which differ from it in X and Y, where
x and y are the shingles of P that they lack,

    |intersection| = |P| - |x| - |y| + |X and Y in common|

so all links among a pivot's sets follow from the few shingles in which they
differ, block by block, and only a forest of links leaves a task. The last round
pairs all sets that share lists and have neither component nor pivot in common,
so no link is missed. The lists that two sets share are all that they have in
common up to the end of one prefix, which bounds the intersection; counts of
shingles in bins bound it again; sets are compared only where both bounds allow
a link.

Every step is a join, an aggregate or a sorted stream. Components are found
on executors, by contraction of edges. A side is broadcast only if counted and
at most ``SMALL`` numbers; beyond that the same join shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drayage.llm import textbuf as tb
from drayage.llm.store import cut

WORDS, NUM, DEN = 5, 80, 100
BINS = 256
#: Sets from which a list is long.
LONG = 32
#: Rounds of pivots, sets of a pivot in a block, and delta shingles that are multiplied at once.
ROUNDS, BLOCK, COLUMNS = 2, 512, 4096
#: Share of a set's index lists that its pivot must have, to be looked at.
LIKE = 0.3
#: List entries of one leader that stay together.
TOGETHER = 4096
#: Most numbers, rows times columns, that a broadcast side may have (8 bytes each).
SMALL = 4_000_000
#: Shingles counted before a task sums up, the least count it then reports, and most frequent ones that are told apart.
FLUSH, REPORT, FREQUENT = 1_000_000, 4, 1 << 20


def sets(buf: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, ascending."""
    low = tb.lowered(buf)
    s, e, doc = tb.words(low, starts)
    h = tb.span_hashes(low, s, e)
    g = tb.ngram_hashes(h, WORDS)
    n = np.bincount(doc, minlength=len(starts) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    out = []
    for i, k in enumerate(n.tolist()):
        a = first[i]
        if k >= WORDS:
            out.append(np.unique(g[a : a + k - WORDS + 1]))
        else:
            out.append(tb.ngram_hashes(h[a : a + k], k) if k else h[:0])
    return out


def _digests(batches):
    """Rows (doc_id, n, a, b) for documents, and (null, count, shingle, null) for what is frequent in this task."""
    held: list[np.ndarray] = []
    count = 0

    def frequent():
        u, c = np.unique(np.concatenate(held), return_counts=True)
        u, c = u[c >= REPORT], c[c >= REPORT]
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(c.astype(np.int64)), pa.array(u.view(np.int64)), pa.nulls(len(u), pa.int64())], ["doc_id", "n", "a", "b"])

    for batch in batches:
        for lo, hi, buf, starts in tb.slices(batch, "text"):
            own = sets(buf, starts)
            a = np.array([tb.mix(x).sum(dtype=np.uint64) for x in own], np.uint64)
            b = np.array([np.bitwise_xor.reduce(x) if len(x) else 0 for x in own], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([len(x) for x in own], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "n", "a", "b"])
            held += own
            count += sum(map(len, own))
            if count >= FLUSH:
                yield frequent()
                held, count = [], 0
    if held:
        yield frequent()


def prefix(x: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles of x in the global order: by known frequency, then by hash."""
    n = len(x)
    p = n - -(-NUM * n // DEN) + 1
    if not len(often):
        return x[:p]
    k = np.minimum(np.searchsorted(often, x), len(often) - 1)
    c = np.where(often[k] == x, counts[k], 0)
    rare = x[c == 0]
    return rare[:p] if len(rare) >= p else np.concatenate([rare, x[c > 0][np.argsort(c[c > 0], kind="stable")][: p - len(rare)]])


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of numbers alone, to be broadcast if its counted ``rows`` allow it, else to be merged."""
    return F.broadcast(df) if rows * len(df.columns) <= SMALL else df.hint("merge")


def _runs(columns: list[str]):
    """Wraps a function of whole lists, so that it sees each run of one ``h`` entire, over batches."""

    def wrap(fn):
        def run(batches):
            rest = None
            for b in batches:
                c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in columns}
                if rest is not None:
                    c = {k: np.concatenate([rest[k], c[k]]) for k in columns}
                if not len(c["h"]):
                    continue
                differ = np.flatnonzero(c["h"] != c["h"][-1])
                last = differ[-1] + 1 if len(differ) else 0
                rest = {k: v[last:] for k, v in c.items()}
                if last:
                    yield from fn({k: v[:last] for k, v in c.items()}, False)
            if rest is not None:
                yield from fn(rest, False)
            yield from fn(None, True)
            tb.release()

        return run

    return wrap


def _shared(c, end):
    """The rows of lists that hold two sets or more, with the list's leader."""
    if end:
        return
    of, first, _ = _leaders(c["h"], c["rep"], c["rep"], 0)
    c["g"] = c["rep"][first][of]
    on = np.flatnonzero(np.bincount(of)[of] > 1)
    for lo in range(0, len(on), 100_000):
        at = on[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(c[k][at]) for k in ("g", "h", "n", "rep")], ["g", "h", "n", "rep"])


def _leaders(h: np.ndarray, rep: np.ndarray, group: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each row's list, each list's row of least hash, and that of least hash in another group, if there is one)."""
    cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    of = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(h)]))
    mixed = tb.mix(rep.view(np.uint64) + np.uint64(turn * 0x9E3779B9))
    first = np.lexsort((mixed, of))[cuts]
    other = np.where(group != group[first][of], mixed, np.uint64(0xFFFFFFFFFFFFFFFF))
    return of, first, np.lexsort((other, of))[cuts]


def _votes(turn: int):
    """Rows (rep, lead, n, lists): the lists of a set by leader, where that is not of its component and pivot already."""

    def make():
        held: list[np.ndarray] = []
        size = 0

        def summed():
            p = np.concatenate(held)
            p = p[np.lexsort((p[:, 1], p[:, 0]))]
            new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]).any(1)])
            return pa.RecordBatch.from_arrays([*(pa.array(p[new, k].copy()) for k in range(3)), pa.array(np.diff(np.r_[new, len(p)]).astype(np.int64))], ["rep", "lead", "n", "lists"])

        def fn(c, end):
            nonlocal held, size
            if end:
                if size:
                    yield summed()
                return
            rep, comp, group = c["rep"], c["comp"], c[f"p{turn - 1}" if turn else "comp"]
            of, first, second = _leaders(c["h"], rep, group, turn)
            lead = np.where(group == group[first][of], second[of], first[of])
            ok = (comp != comp[lead]) & (group != group[lead])
            if turn == 0:  # a leader waits for the next round
                ok &= first[of] != np.arange(len(rep))
            held.append(np.stack([rep[ok], rep[lead[ok]], c["n"][ok].astype(np.int64)], 1))
            size += int(ok.sum())
            if size > FLUSH:
                yield summed()
                held, size = [], 0

        return fn

    return lambda batches: _runs(["h", "n", "rep", *_GROUPS])(make())(batches)


def _candidates(batches):
    """Rows (x, y, nx, ny, lists): pairs that share lists, have neither component nor pivot in common, and may link by their parities."""
    held: list[np.ndarray] = []
    size = 0

    def summed():
        # equal pairs become neighbours and are counted
        p = np.concatenate(held)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        new = np.flatnonzero(np.r_[True, (p[1:, :2] != p[:-1, :2]).any(1)])
        times = np.diff(np.r_[new, len(p)])
        return pa.RecordBatch.from_arrays([*(pa.array(p[new, k].copy()) for k in range(4)), pa.array(times.astype(np.int64))], ["x", "y", "nx", "ny", "lists"])

    def fn(c, end):
        nonlocal held, size
        if end:
            if size:
                yield summed()
            return
        cuts = np.flatnonzero(np.r_[True, c["h"][1:] != c["h"][:-1]])
        stops = np.r_[cuts[1:], len(c["h"])]
        n, rep, lists = c["n"].astype(np.int64), c["rep"], c["lists"]
        groups = np.stack([c[k] for k in _GROUPS])
        bits = np.stack([c[k] for k in _PARITIES]).view(np.uint64)  # bits of a signed number are counted of its absolute value
        short = _short(cuts, stops, n, rep, groups, lists, bits)
        held += short
        size += sum(map(len, short))
        for a, z in zip(cuts[stops - cuts > LONG], stops[stops - cuts > LONG]):
            if (groups[:, a:z] == groups[:, a : a + 1]).all(1).any():
                continue
            for p in _all(n[a:z], rep[a:z], groups[:, a:z], lists[a:z], bits[:, a:z]):
                held.append(p)
                size += len(p)
                if size > FLUSH // 2:
                    yield summed()
                    held, size = [], 0

    return _runs(["h", "n", "rep", "lists", *_GROUPS, *_PARITIES])(fn)(batches)


#: A set's component, and its pivot of each round: itself, where it has none.
_GROUPS = ["comp", *[f"p{k}" for k in range(ROUNDS)]]
#: 256 bits of a set: whether the shingles that fall on a bit are odd in number.
_PARITIES = [f"s{k}" for k in range(4)]


def _parities(batches):
    """(rep, s0, …) of each document."""
    for b in batches:
        for lo, hi, buf, starts in tb.slices(b, "text"):
            odd = [np.packbits(np.bincount((x >> np.uint64(40) & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1) for x in sets(buf, starts)]
            bits = np.stack(odd).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(bits[:, k].copy()) for k in range(len(_PARITIES)))], ["rep", *_PARITIES])


def _near(bits, n, i, other):
    """Whether sets may link: a bit differs only if an odd number of shingles do, and links leave few that differ."""
    differ = np.bitwise_count(bits[:, i] ^ bits[:, other]).sum(0, dtype=np.int64)
    return differ * (NUM + DEN) <= (n[i] + n[other]) * (DEN - NUM)


def _reach(n: np.ndarray) -> np.ndarray:
    """For sizes in ascending order: the end of the block of positions that each can link with."""
    return np.searchsorted(n, n * DEN // NUM, "right")


def _short_of(nx: str, ny: str) -> Column:
    """The same for columns, of lists counted over the whole index."""
    unseen = lambda n: F.ceil(F.col(n) * NUM / DEN) - 1  # what a set has after its prefix
    return (F.col(nx) + F.col(ny)) * NUM / (NUM + DEN) - F.greatest(unseen(nx), unseen(ny))


def _needed(nx, ny):
    """Lists that sets of these sizes share if they link: the intersection's least, less what the prefixes leave unseen."""
    unseen = np.maximum(-(-NUM * nx // DEN), -(-NUM * ny // DEN)) - 1
    return (nx + ny) * NUM / (NUM + DEN) - unseen - 1e-6


def _rows(n, rep, lists, bits, other, i):
    other = other[np.minimum(lists[other], lists[i]) >= _needed(n[other], n[i])]
    other = other[_near(bits, n, np.full(len(other), i), other)]
    swap = rep[other] < rep[i]
    return np.stack([np.where(swap, rep[other], rep[i]), np.where(swap, rep[i], rep[other]), np.where(swap, n[other], n[i]), np.where(swap, n[i], n[other])], 1)


def _short(cuts, stops, n, rep, groups, lists, bits):
    """All pairs of all lists that are not long, by distance in the list."""
    many = np.repeat(stops - cuts, stops - cuts)
    left = np.repeat(stops, stops - cuts) - np.arange(len(n))  # places to the list's end
    out = []
    for d in range(1, LONG):
        i = np.flatnonzero((many <= LONG) & (left > d))
        if not len(i):
            break
        i = i[(groups[:, i] != groups[:, i + d]).all(0) & (n[i + d] * NUM <= n[i] * DEN)]
        i = i[np.minimum(lists[i], lists[i + d]) >= _needed(n[i], n[i + d])]
        i = i[_near(bits, n, i, i + d)]
        if len(i):
            swap = rep[i] > rep[i + d]
            out.append(np.stack([np.where(swap, rep[i + d], rep[i]), np.where(swap, rep[i], rep[i + d]), np.where(swap, n[i + d], n[i]), np.where(swap, n[i], n[i + d])], 1))
    return out


def _all(n, rep, groups, lists, bits):
    for i, z in enumerate(_reach(n)):
        other = i + 1 + np.flatnonzero((groups[:, i + 1 : z] != groups[:, i : i + 1]).all(0))
        if len(other):
            yield _rows(n, rep, lists, bits, other, i)


def _whole(batches):
    """(rep, n, bins, raw) of each document: counts of its shingles by bin, and the shingles."""
    for b in batches:
        for lo, hi, buf, starts in tb.slices(b, "text"):
            own = sets(buf, starts)
            bins = []
            for x in own:
                c = np.bincount((x >> np.uint64(64 - 8)).astype(np.int64), minlength=BINS)
                bins.append(c.astype(np.uint8 if c.max(initial=0) < 256 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(x) for x in own], pa.int64()), pa.array(bins, pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["rep", "n", "bins", "raw"])


def _linked(common, n1, n2):
    return DEN * common >= NUM * (n1 + n2 - common)


def _bins(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == BINS else np.uint32)


def _may_link(batches):
    for b in batches:
        n1, n2 = b.column("n1").to_numpy(), b.column("n2").to_numpy()
        most = np.array([np.minimum(_bins(p), _bins(q)).sum(dtype=np.int64) for p, q in zip(b.column("b1").to_pylist(), b.column("b2").to_pylist())], np.int64)
        ok = pa.array(_linked(np.minimum(most, np.minimum(n1, n2)), n1, n2), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("x").filter(ok), b.column("y").filter(ok)], ["x", "y"])


def _do_link(batches):
    for b in batches:
        keep = []
        for p, q in zip(b.column("r1").to_pylist(), b.column("r2").to_pylist()):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            k = np.minimum(np.searchsorted(q, p), len(q) - 1)
            keep.append(bool(_linked(int((q[k] == p).sum()), len(p), len(q))))
        ok = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("x").filter(ok), b.column("y").filter(ok)], ["x", "y"])


def _checked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (x, y) that link."""
    one = whole.select(F.col("rep").alias("x"), F.col("n").alias("n1"), F.col("bins").alias("b1"))
    two = whole.select(F.col("rep").alias("y"), F.col("n").alias("n2"), F.col("bins").alias("b2"))
    may = cut(one.join(small(pairs, pairs.count()), "x").join(two, "y").mapInArrow(_may_link, "x long, y long"))
    k = may.count()
    one = whole.select(F.col("rep").alias("x"), F.col("raw").alias("r1"))
    two = whole.join(small(may.select(F.col("y").alias("rep")).distinct(), k), "rep", "left_semi").select(F.col("rep").alias("y"), F.col("raw").alias("r2"))
    return one.join(small(may, k), "x").join(two, "y").mapInArrow(_do_link, "x long, y long")


def _delta(batches):
    """(pivot, rep, n, np, lacks, delta) of the sets that have half of all shingles in common with their pivot."""
    for b in batches:
        rows = []
        for i, (p, x) in enumerate(zip(b.column("raw_p").to_pylist(), b.column("raw").to_pylist())):
            p, x = np.frombuffer(p, np.uint64), np.frombuffer(x, np.uint64)
            differ = np.setxor1d(p, x, assume_unique=True)
            common = (len(p) + len(x) - len(differ)) // 2
            if 2 * common >= len(p) + len(x) - common:
                rows.append((i, len(x), len(p), len(p) - common, differ.tobytes()))
        at, n, n_p, lacks, delta = zip(*rows) if rows else [()] * 5
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("pivot").take(at), b.column("rep").take(at), *(pa.array(c, pa.int64()) for c in (n, n_p, lacks)), pa.array(delta, pa.binary())], ["pivot", "rep", "n", "np", "lacks", "delta"])


def _common(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many delta shingles each of ``rows`` has in common with each of ``others``: sums of products over columns that both have."""
    h, k = np.concatenate([*rows, np.zeros(0, np.uint64)]), np.concatenate([*others, np.zeros(0, np.uint64)])
    u = np.intersect1d(h, k)
    out = np.zeros((len(rows), len(others)), np.float32)
    places = []
    for x, own in ((h, rows), (k, others)):
        at = np.searchsorted(u, x)
        at[at == len(u)] = 0
        ok = u[at] == x if len(u) else np.zeros(len(x), bool)
        places.append((np.repeat(np.arange(len(own)), [len(r) for r in own])[ok], at[ok]))
    for lo in range(0, len(u), COLUMNS):
        m = []
        for (of, at), own in zip(places, (rows, others)):
            ok = (at >= lo) & (at < lo + COLUMNS)
            a = np.zeros((len(own), min(COLUMNS, len(u) - lo)), np.float32)
            a[of[ok], at[ok] - lo] = 1
            m.append(a)
        out += m[0] @ m[1].T
    return out


def _derived(t: pa.Table) -> pa.Table:
    """(x, y): a forest of the links among a pivot's sets of one block, or between two of its blocks."""
    a, b = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    block = t.column("block").to_numpy()
    rep, n, lacks = (t.column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "lacks"))
    delta = [np.frombuffer(x, np.uint64) for x in t.column("delta").to_pylist()]
    p, q = np.flatnonzero(block == a), np.flatnonzero(block == b)
    common = t.column("np")[0].as_py() - lacks[p][:, None] - lacks[q] + _common([delta[i] for i in p], [delta[i] for i in q])
    link = _linked(common, n[p][:, None], n[q])
    # each set takes the least label among those it links with until all agree
    label = np.arange(len(rep))
    while True:
        old = label.copy()
        most = len(rep)
        np.minimum.at(label, p, np.where(link, label[q], most).min(1, initial=most))
        np.minimum.at(label, q, np.where(link, label[p][:, None], most).min(0, initial=most))
        label = label[label]
        if (label == old).all():
            break
    own = np.flatnonzero(rep[label] != rep)
    return pa.table({"x": rep[label[own]], "y": rep[own]})


def _by_pivots(sets_of: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) among the sets of each pivot, and (rep, pivot) of the sets that are like theirs; ``chosen`` (rep, pivot)."""
    pivots = sets_of.join(chosen.select(F.col("pivot").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("pivot"), F.col("raw").alias("raw_p"))
    deltas = cut(sets_of.select("rep", "raw").join(small(chosen, chosen.count()), "rep").join(pivots, "pivot").select("pivot", "rep", "raw", "raw_p").mapInArrow(_delta, "pivot long, rep long, n long, np long, lacks long, delta binary"))
    # a pivot differs from itself in nothing
    self = deltas.groupBy("pivot").agg(F.max("np").alias("n"), F.count("*").alias("sets"))
    both = deltas.unionByName(self.select("pivot", F.col("pivot").alias("rep"), "n", F.col("n").alias("np"), F.lit(0).cast("long").alias("lacks"), F.lit(b"").alias("delta")))
    blocks = self.select("pivot", F.ceil((F.col("sets") + 1) / BLOCK).cast("int").alias("blocks"))
    both = both.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    links = dealt.select("pivot", "i", "j", "block", "rep", "n", "np", "lacks", "delta").groupBy("pivot", "i", "j").applyInArrow(_derived, "x long, y long")
    return links, deltas.select("rep", "pivot")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for all nodes of ``edges`` (x, y)."""
    edges = cut(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    roots = None
    while True:
        # each node points to its least neighbour, if less than itself, and from there once more
        both = edges.union(edges.select("y", "x"))
        up = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root"))
        over = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
        up = cut(up.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")))
        if roots is None:
            roots = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
            roots = cut(roots.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")))
        a = up.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        b = up.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        edges = cut(edges.join(a, "x").join(b, "y").where("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct())
        if edges.isEmpty():
            return roots


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text).

    Words are what lies between bytes 0x20 and 0x09-0x0D, A-Z lower-cased. A text
    of fewer than five words is one shingle; one without words, or a null text,
    has none and links with nothing. Component: the smallest doc_id that links
    lead to, itself included. Rows of one doc_id are one document; a row whose
    doc_id is null links with nothing and has a null component.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    base = cut(docs.mapInArrow(_digests, "doc_id long, n long, a long, b long"))
    base, often = base.where("b is not null"), base.where("b is null")
    real = base.where("n > 0 and doc_id is not null")
    reps = real.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
    copies = cut(real.join(reps, ["n", "a", "b"]).where("doc_id <> rep").select("doc_id", "rep").distinct())

    total = real.agg(F.sum("n")).first()[0] or 0
    least = max(4 * REPORT, -(-total // FREQUENT))  # so that at most FREQUENT shingles reach it
    known = often.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("a").toArrow()
    h = known.column("a").to_numpy().view(np.uint64)
    order = np.argsort(h)
    shared = docs.sparkSession.sparkContext.broadcast((h[order], known.column("n").to_numpy()[order]))

    def index(batches):
        often, counts = shared.value
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, hi, buf, starts in tb.slices(b, "text"):
                own = sets(buf, starts)
                first = [prefix(x, often, counts) if len(x) else x for x in own]
                k = np.array([len(x) for x in first])
                if k.sum():
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat([len(x) for x in own], k).astype(np.int32)), pa.array(np.repeat(ids[lo:hi], k))], ["h", "n", "rep"])

    n_copies = copies.count()
    firsts = docs.where("doc_id is not null").join(small(copies.select("doc_id").distinct(), n_copies), "doc_id", "left_anti")
    rows = firsts.mapInArrow(index, "h long, n int, rep long").repartition("h").sortWithinPartitions("h", "n", "rep")
    lists = cut(rows.mapInArrow(_runs(["h", "n", "rep"])(_shared), "g long, h long, n int, rep long"))
    # lists with one leader go together, so that the pairs that they repeat are counted where they are found; many of them are dealt out
    sizes = cut(lists.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") > TOGETHER))
    lists = lists.join(small(sizes, sizes.count()), "g", "left")
    part = F.coalesce(F.pmod(F.xxhash64("h"), F.ceil(F.col("rows") / TOGETHER)), F.lit(0)).cast("int")
    lists = cut(lists.select("g", part.alias("part"), "h", "n", "rep").repartition("g", "part").sortWithinPartitions("g", "part", "h", "n", "rep"))
    nodes = cut(lists.groupBy("rep").agg(F.count("*").alias("lists")))
    n_nodes = nodes.count()

    labels = nodes.select("rep", "lists", *[F.col("rep").alias(k) for k in _GROUPS])
    for turn in [*range(ROUNDS), None]:
        known = labels
        if turn is None:  # a pair that can't link by its sets' parities is not counted in every task that holds one of its lists
            known = cut(labels.join(docs.join(small(nodes.select(F.col("rep").alias("doc_id")), n_nodes), "doc_id", "left_semi").mapInArrow(_parities, ", ".join(["rep long", *(f"{k} long" for k in _PARITIES)])), "rep"))
        marked = lists.join(small(known, n_nodes), "rep")
        if n_nodes * len(known.columns) > SMALL:
            marked = marked.repartition("g", "part").sortWithinPartitions("g", "part", "h", "n", "rep")
        if turn is None:
            pairs = marked.select("h", "n", "rep", "lists", *_GROUPS, *_PARITIES).mapInArrow(_candidates, "x long, y long, nx long, ny long, lists long")
            pairs = pairs.groupBy("x", "y", "nx", "ny").agg(F.sum("lists").alias("lists"))
            pairs = cut(pairs.where(F.col("lists") >= _short_of("nx", "ny") - 1e-6).select("x", "y"))
        else:
            votes = marked.select("h", "n", "rep", *_GROUPS).mapInArrow(_votes(turn), "rep long, lead long, n long, lists long").groupBy("rep", "n", "lead").agg(F.sum("lists").alias("lists"))
            best = votes.groupBy("rep", "n").agg(F.max_by("lead", F.struct("lists", F.xxhash64("lead"))).alias("pivot"), F.max("lists").alias("lists"))
            best = best.where(F.col("lists") >= LIKE * (F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1))
            pairs = cut(best.select(F.col("rep").alias("x"), F.col("pivot").alias("y")))
        named = pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct()
        whole = cut(docs.join(small(named, n_nodes), "doc_id", "left_semi").mapInArrow(_whole, "rep long, n long, bins binary, raw binary"))
        if turn is None:
            new = _checked(pairs, whole)
        else:
            new, like = _by_pivots(whole, pairs.select(F.col("x").alias("rep"), F.col("y").alias("pivot")))
            k = f"p{turn}"
            labels = labels.drop(k).join(like.withColumnRenamed("pivot", k), "rep", "left").withColumn(k, F.coalesce(k, "rep"))
        at = labels.select(F.col("rep").alias("x"), F.col("comp").alias("cx"))
        bt = labels.select(F.col("rep").alias("y"), F.col("comp").alias("cy"))
        edges = cut(new.join(at, "x").join(bt, "y").where("cx <> cy").select(F.col("cx").alias("x"), F.col("cy").alias("y")))
        if not edges.isEmpty():
            up = components(edges).select(F.col("node").alias("comp"), "root")
            labels = labels.join(up, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        labels = cut(labels.select("rep", "lists", *_GROUPS))
    out = base.join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(labels.select("rep", "comp"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
