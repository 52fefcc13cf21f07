"""Corpus operators against brute force on small fixtures, with nulls, empty texts, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from drayage.llm import ann, bpe, jaccard, langid, lm, packing, pii, quality, substring, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _prose(r, n):
    return " ".join("".join(r.choice(["ka", "lo", "mi", "tu", "re", "so", "ne"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(i, _prose(r, r.randrange(5, 120)), r.choice(["aa", "bb"]), "s", 0) for i in range(1, 60)]
    passage = _prose(r, 60)
    for i in range(60, 66):
        out.append((i, f"{_prose(r, 30)} {passage} {_prose(r, 30)}", "aa", "s", 0))
    for i in range(66, 72):  # near copies of one text
        w = out[40][1].split() + passage.split()
        w[i - 60] = "changed"
        out.append((i, " ".join(w), "bb", "s", 0))
    out += [(80, None, None, None, None), (81, "", "aa", "s", 0), (82, " \n\t ", "aa", "s", 0), (83, "one two", "bb", "s", 0), (84, "one two", "bb", "s", 0), (85, "ONE two", "bb", "s", 0), (86, "é" * 5000 + " x" * 9000, "aa", "s", 0), (87, "123 !!", "aa", "s", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert got[85][1] == 83
    assert jaccard.join(empty).count() == 0


def test_substring(docs, rows, empty):
    got = {r["doc_id"]: r for r in substring.passages(docs).collect()}
    assert set(range(60, 66)) <= set(got)
    kept = {r["doc_id"]: r["text"] for r in substring.deduplicate(docs).collect()}
    seen = defaultdict(set)
    for i, t in kept.items():
        w = (t or "").split()
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(i)
    assert not [v for v in seen.values() if len(v) > 1]
    clean = {i: t for i, t, *_ in rows if i not in got}
    assert all(kept[i] == t for i, t in clean.items()) and len(kept) == len(rows)
    assert substring.passages(empty).count() == 0 and substring.deduplicate(empty).count() == 0


def test_language(docs, rows, empty):
    got = {r["doc_id"]: r for r in langid.predictions(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (80, 81, 82, 87))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert langid.predictions(empty).count() == 0


def test_pii(spark, docs, empty):
    lines = [(i, f"call +44 20 7946 09{i:02d} or mail jo@corp.example about zebrafalcon number {i} {'pad ' * i}", "aa", "s", 0) for i in range(10)]
    others = [(i, "a plain text about number and mail " + "w" * (i % 7), "aa", "s", 0) for i in range(20, 120)]
    d = spark.createDataFrame([*lines, *others, (200, None, None, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in pii.report(d).collect()}
    assert got[3]["n_email"] == got[3]["n_phone"] == 1 and got[200]["spans"] == ""
    at = lines[3][1].index("zebrafalcon")
    assert f"term:{at}:{at + 11}" in got[3]["spans"] and "term" not in got[25]["spans"]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert "jo@" not in out[3] and "zebrafalcon" not in out[3] and out[25] == others[5][1]
    assert pii.report(empty).count() == 0
    assert pii.report(docs).where("doc_id = 80").first()["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    t = quality.grow(x[:1500], y[:1500])
    assert ((t.probability(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9


def test_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 8)).astype(np.float32)
    x[100:110] = x[100]
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1040, [0.0] * 8, 0), (1050, [float("nan")] * 8, 0), (0, x[0].tolist(), 0)]
    t = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    f = np.floor(256 * np.vstack([x, np.zeros((1, 8))]).astype(float)).astype(np.int64)
    ids = np.array([*range(600), 1040])
    want = {}
    for i in range(0, 600, 50):
        s = f @ f[i]
        o = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:5]
        want[i] = [(int(ids[k]), int(s[k])) for k in o]
    got = defaultdict(list)
    for q in sorted(topk.search(t).collect(), key=lambda q: (q["query_id"], q["rank"])):
        got[q["query_id"]].append((q["vec_id"], q["score"]))
    assert dict(got) == want
    hit = 0
    near = defaultdict(set)
    for q in ann.search(t).collect():
        near[q["query_id"]].add(q["vec_id"])
    for i in range(0, 600, 20):
        s = x.astype(float) @ x[i].astype(float)
        hit += len(near[i] & {int(k) for k in [k for k in np.lexsort((np.arange(600), -s)) if k != i][:20]})
    assert hit / (30 * 20) >= 0.9
    assert topk.search(t.limit(0)).count() == ann.search(t.limit(0)).count() == 0


def test_bpe_equals_tiktoken():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = bpe.Encoder(path, P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice("ab '²½Ⅷ5٣é\n\t\x1c\x85  .,!d'sſK漢字😀_-") for _ in range(r.randrange(30)))
        ids = e.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(s) and e.decode(ids).decode() == s


def test_packing(docs, rows, empty):
    p = packing.packed(docs).collect()
    by, of = defaultdict(list), Counter()
    for x in p:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
        of[x["doc_id"]] += x["length"]
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert all(of[x["doc_id"]] == x["doc_tokens"] for x in p) and of[80] == of[81] == 1 and len(of) == len(rows)
    assert packing.packed(empty).count() == 0


def test_lm(docs, rows, empty):
    import math

    tokens = {i: [*WORD.findall((t or "").translate(LOW)), None] for i, t, *_ in rows}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lm.scores(docs).collect():
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm.scores(empty).count() == 0


def test_lm_is_a_distribution(spark):
    import math

    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(r.choice(vocabulary[: 1 + r.randrange(400)]) for _ in range(8)), "aa", "s", 0) for i in range(300)]
    docs += [docs[0], (None, docs[3][1], "aa", "s", 0), (None, docs[3][1], "aa", "s", 0), (901, None, "aa", "s", 0)]
    held = {i for i, *_ in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1}
    tokens = [(i, [*(t or "").split(), None]) for i, t, *_ in docs]
    c, p = Counter(), Counter()
    for i, ws in tokens:
        if i not in held:
            c.update(ws)
            p.update(zip(["^", *ws], ws))
    middle = lambda n: 1.25 * 1.5 ** math.floor(math.log(n, 1.5) + 1e-9) - 0.25 if n else 0
    mass = sum(map(middle, c.values())) + 0.5 * (len(c) + 1)
    after = defaultdict(list)
    for (v, w), n in p.items():
        after[v].append(middle(n))

    def chance(v, w):
        alone = (middle(c[w]) + 0.5) / mass
        if v not in after:
            return alone
        return (max(middle(p[v, w]) - 0.75, 0) + 0.75 * len(after[v]) * alone) / sum(after[v])

    words = [*c, "unknown"]
    assert all(math.isclose(sum(chance(v, w) for w in words), 1, rel_tol=1e-9) for v in ["^", "unknown", *vocabulary[:40]])
    # the same through the filter: errors of probes add little
    keys = lm.tb.mix(np.arange(10**6, 10**6 + 400, dtype=np.uint64))
    counts = np.array([r.randrange(1, 50) for _ in keys])
    bits = np.frombuffer(lm.build(keys, lm.level(counts)), np.uint8)
    got = lm.probe(bits, keys, 0, np.uint64(8 * len(bits)))
    assert (got >= lm.level(counts)).all() and (got == lm.level(counts)).mean() > 0.97
    assert (lm.probe(bits, lm.tb.mix(np.arange(10**5, dtype=np.uint64)), 0, np.uint64(8 * len(bits))) > 0).mean() < 0.01

    got = lm.scores(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    want = defaultdict(list)
    for i, ws in tokens:
        want[i].append(sum(math.log10(chance(v, w)) for v, w in zip(["^", *ws], ws)))
    assert Counter(g["doc_id"] for g in got) == Counter(i for i, *_ in docs)
    # an error of a probe changes T of a context, and with it the scores of some documents a little
    off = sorted(abs(g["score"] - want[g["doc_id"]][0]) for g in got)
    assert off[len(off) // 2] < 1e-5 and off[int(0.95 * len(off))] < 0.2


def test_pii_terms_of_other_lines(spark):
    mail, phone = "jo@corp.example", "+44 20 7946 0958"
    docs = [(i, f"Name: zebrafalcon v{i}v\nPhone: {phone}\n" + "plain words " * 30 + f"quietotter {i} end {mail}", "aa", "s", 0) for i in range(3)]
    docs += [(20 + i, f"Name: Phone: end plain words v{i}v", "aa", "s", 0) for i in range(60)]
    docs += [(100 + i, f"one text copied loudheron sam{i // 5}@corp.example", "aa", "s", 0) for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i in range(3):
        assert "zebrafalcon" not in got[i] and "quietotter" not in got[i] and "Name: " in got[i] and "plain words" in got[i]
    assert all("loudheron" in got[100 + i] for i in range(5)) and all(got[i] == t for i, t, *_ in docs[3:63])
