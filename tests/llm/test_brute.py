"""The corpus queries against plain rewritings of what they should return, and their edges."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from test_operators import LOW, SCHEMA, WORD, _prose

from drayage.llm import ann, bpe, jaccard, langid, lm, packing, pii, quality, registry, substring, topk
from drayage.llm import textbuf as tb


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = {"aa": ["ka", "lo", "mi", "tu", "né"], "bb": ["shr", "wod", "gux", "ölk", "zip"], "cc": ["日", "本", "語", "の", "は"]}
    out = []
    for i in range(1, 90):
        lang = r.choice(list(words))
        out.append((i, " ".join("".join(r.choice(words[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), lang if i % 9 else None, "s", 0))
    out += [(100, None, None, None, None), (101, "", "aa", "s", 0), (102, " \n\t\x0b ", "bb", "s", 0), (103, "4711 !?", "aa", "s", 0), (None, "ka lo mi ka lo", "aa", "s", 0), (None, None, None, None, None)]
    out += [(104, "KaLo" * 300_000, "aa", "s", 0), (105, "a b <|endoftext|> hello<|ENDOFTEXT|>x <|startoftext|>", "aa", "s", 0), out[3], out[3], (3, "another text of the same id", "aa", "s", 0)]
    mail = "x.y+z@corp-1.example.org"
    odd = ["@@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "+12", "00012.1.2.3", "٣.1.2.3", mail, "..@a.b", "+44 20 7946 0958 11", "é", "😀", "\n", " ", "-", "5", "+"]
    out += [(200 + i, "".join(r.choice(odd) + r.choice(["", " ", "x"]) for _ in range(r.randrange(1, 14))), "aa", "s", 0) for i in range(400)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns whose names the operators use themselves."""
    names = ["plain", "base", "spans", "row", "terms", "doc", "cuts", "share", "rank", "before", "at", "best", "z", "every", "h", "rep", "__doc", "__cuts", "__text", "term", "entity", "t", "g", "n", "k"]
    text = "one passage that is shared by many documents of this small fixture and long enough for it to count as repeated " * 2
    rows = [(i, f"{text} mail jo@corp.example of falcon {i} " + "word " * i, "aa", "s", 0, *[f"{c}-{i}" for c in names]) for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in names)), names


def test_clashing_columns_stay(clashing):
    df, names = clashing
    for out in (substring.deduplicate(df), pii.sanitise(df), langid.identify(df, df.select("doc_id", "text", "lang"))):
        got = {r["doc_id"]: r.asDict() for r in out.collect()}
        assert len(got) == 12 and all(got[i][c] == f"{c}-{i}" for i in got for c in names)
        assert set(df.columns) <= set(out.columns)
    pieces = packing.pieces(df, P.path("word_bpe_49k.json"), ids=False).join(df.select("doc_id", *names), "doc_id")
    assert all(r[c] == f"{c}-{r['doc_id']}" for r in packing.pack(pieces).collect() for c in names)
    wide = df.withColumnsRenamed({"rank": "n_shingles", "term": "component_id", "at": "held_out", "best": "score"})
    for out in (jaccard.join(wide), lm.scores(wide), quality.scores(wide, df.selectExpr("doc_id", "1 AS quality", "0 AS toxic")), bpe.tokenised(wide, P.path("byte_bpe_multi_50k.tiktoken")), pii.report(wide), substring.passages(wide), packing.packed(wide)):
        assert out.count() >= 12


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (bpe.tokenised(none, P.path("byte_bpe_multi_50k.tiktoken")), quality.scores(none, labels), pii.sanitise(none), lm.scores(none), packing.packed(none)):
        assert out.count() == 0


def _chunks(raw: bytes):
    """Gear cuts, one byte at a time."""
    at, start, out = 0, 0, []
    for i in range(len(raw)):
        h = sum(int(substring._GEAR[raw[j]]) << (i - j) for j in range(max(0, i - 15), i + 1)) & 0xFFFF
        if i + 1 >= 16 and h < int(substring.CUT) and (i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80):
            out.append((start, i + 1))
            start = i + 1
    if start < len(raw):
        out.append((start, len(raw)))
    whole = []
    for s, e in out:
        while e - s > substring.MOST:
            p = s + substring.MOST
            while p > s and raw[p] & 0xC0 == 0x80:
                p -= 1
            whole.append((s, p))
            s = p
        whole.append((s, e))
    return whole


def test_passages(spark):
    r = random.Random(3)
    shared = [_prose(r, 40) + " é", _prose(r, 9), _prose(r, 300)]
    rows = [(i, " ".join(r.choice([_prose(r, 12), r.choice(shared)]) for _ in range(3)), "aa", "s", 0) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "aa", "s", 0), (None, shared[0], "aa", "s", 0), rows[0], rows[1]]
    held, spans = defaultdict(set), defaultdict(set)
    for i, t, *_ in rows:
        if i is not None and t:
            raw = t.encode()
            for s, e in _chunks(raw):
                held[raw[s:e]].add(i)
                spans[i].add((s, e, raw[s:e]))
    want = {}
    for i, cs in spans.items():
        hit = sorted((s, e, c) for s, e, c in cs if len(held[c]) > 1)
        runs = []
        for x in hit:
            if runs and runs[-1][-1][1] == x[0]:
                runs[-1].append(x)
            else:
                runs.append([x])
        runs = [u for u in runs if u[-1][1] - u[0][0] >= substring.MIN_RUN]
        if runs:
            removed = sum(e - s for u in runs for s, e, c in u if min(held[c]) < i)
            want[i] = (len(runs), sum(u[-1][1] - u[0][0] for u in runs), removed, sorted({min(held[c]) for u in runs for _, _, c in u}), ",".join(f"{u[0][0]}:{u[-1][1]}" for u in runs))
    got = {x["doc_id"]: (x["n_passages"], x["repeated_bytes"], x["removed_bytes"], list(x["first_ids"]), x["spans"]) for x in substring.passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_jaccard_joins_either_way(spark, monkeypatch, most):
    """Near copies that hang together in chains, with broadcasts and without."""
    monkeypatch.setattr(jaccard, "SMALL", most)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "TOGETHER", 50)
    r = random.Random(1)
    base = _prose(r, 60).split()
    rows = []
    for i in range(70):
        w = list(base)
        for k in r.sample(range(60), r.randrange(4)):
            w[k] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w), "aa", "s", 0))
    rows += [(100 + i, _prose(r, 30) + " " + " ".join(base[:25]), "aa", "s", 0) for i in range(20)] + [(None, rows[0][1], "aa", "s", 0), rows[5]]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, *_ in rows if i is not None for w in [t.split()]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = Counter((i, len(sets[i]) if i is not None else len(sets[0]), find(i) if i is not None else None) for i, *_ in rows)
    assert got == want and len({find(i) for i in range(70)}) > 3


def test_language_by_plain_bayes(docs, rows):
    def grams(text):
        t = text.translate(LOW)
        return [t[i : i + n] for n in langid.GRAMS for i in range(len(t) - n + 1)]

    def bucket(g):
        c, at = langid.characters(np.frombuffer(g.encode(), np.uint8), np.array([0, len(g.encode())]))
        return int(langid.gram_ids(c, at, len(c))[0])

    learned = [(t, lang) for i, t, lang, *_ in rows if lang and t is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1 and len(t) < 10**5]
    got = [r for r in langid.identify(docs.where("doc_id is null or doc_id <> 104"), docs.where("(doc_id is null or doc_id <> 104)").where(~langid.held_out(docs)).select("doc_id", "text", "lang"), per_lang=10**9).collect()]
    counts, share = defaultdict(lambda: np.full(langid.BUCKETS, 0.5)), Counter(lang for _, lang in learned)
    memo = {}
    for t, lang in learned:
        for g in grams(t):
            counts[lang][memo.setdefault(g, bucket(g))] += 1
    logp = {k: np.log(c / c.sum()) for k, c in counts.items()}
    good = seen = 0
    for r in got:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        gs = [memo.setdefault(g, bucket(g)) for g in grams(r["text"])]
        z = {k: np.mean(p[gs]) * min(len(gs), langid.EVIDENCE) + np.log(share[k] / sum(share.values())) for k, p in logp.items()}
        best = max(sorted(z), key=z.get)
        assert r["lang_pred"] == best and abs(r["score"] - 1 / sum(np.exp(v - z[best]) for v in z.values())) < 1e-4
        if r["doc_id"] and r["doc_id"] < 90 and r["lang"]:
            seen += 1
            good += best == r["lang"]
    assert good >= 0.95 * seen > 0


def test_many_languages_in_blocks(spark, docs, monkeypatch):
    train = docs.where("doc_id < 90").select("doc_id", "text", "lang")
    whole = {(r["doc_id"], r["text"]): (r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs, train).collect()}
    monkeypatch.setattr(langid, "BLOCK", 1)
    assert whole == {(r["doc_id"], r["text"]): (r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs, train).collect()}


_KINDS = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_personal_data_by_re(docs, rows):
    got = defaultdict(list)
    for r in pii.report(docs).collect():
        got[r["doc_id"]].append((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]))
    want = defaultdict(list)
    for i, t, *_ in rows:
        spans = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(_KINDS.items()) for m in p.finditer(t if t and i != 104 else "") if ok(m.group())]  # a megabyte of letters, without a span, takes plain patterns too long
        listed = ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(spans))
        n = Counter(name for *_, name in spans)
        want[i].append((*[n[k] for k in _KINDS], hashlib.sha256(listed.encode()).hexdigest(), listed))
    assert {k: sorted(x[:5] for x in v) for k, v in got.items()} == {k: sorted(x[:5] for x in v) for k, v in want.items()}
    assert all(set(b[5].split(",")) <= set(a[5].split(",")) for k in want for a, b in zip(sorted(got[k]), sorted(want[k])))


def test_quality_row_by_row(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(1, 90)] + [(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    few = docs.where("doc_id is null or doc_id <> 104")
    held = quality.fold(quality.F.col("doc_id"), 3) == 1
    trees = quality.fit(few, labels.where(~held))
    got = Counter((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in quality.scores(few, labels).collect())
    want = Counter()
    for i, t, *_ in rows:
        if i == 104:
            continue
        raw = np.frombuffer((t or "").encode(), np.uint8)
        x = quality.features(raw, np.array([0, len(raw)]))[0]
        z = trees.base
        for f, at, v in zip(trees.feature, trees.threshold, trees.value):
            k = 0
            for _ in range(quality.DEPTH):
                k = 2 * k + (2 if x[f[k]] > at[k] else 1)
            z += v[k - (2**quality.DEPTH - 1)]
        p = 1 / (1 + np.exp(-z))
        want[i, zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1, round(float(p), 9), int(p >= 0.5)] += 1
    assert got == want


def test_nearest_by_product(spark):
    """The shortlist is 7 % of the table; scores, ranks and ties are exact."""
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 16)).astype(np.float32)
    x[40:60] = x[40]  # ties
    x *= r.lognormal(0, 0.3, size=(6000, 1)).astype(np.float32)
    x[41:60] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, x[7].tolist(), 0), (None, x[0].tolist(), 0), (9001, [], 0)]
    got = defaultdict(list)
    for q in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        got[q["query_id"]].append((q["rank"], q["vec_id"], q["score"]))
    hit, f = 0, x.astype(float)
    assert set(got) == set(range(0, 6000, 20))
    for i, found in got.items():
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 21)) and all(abs(s - f[v] @ f[i]) < 1e-9 for _, v, s in found) and i not in [v for _, v, _ in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        near = [k for k in np.lexsort((np.arange(6000), -(f @ f[i]))) if k != i][:20]
        hit += len({v for _, v, _ in found} & set(map(int, near)))
    assert hit / (300 * 20) >= 0.9


def test_exact_with_large_components(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1, 1]) * 10.0 ** r.randrange(-3, 12) for _ in range(4)], 0) for i in range(120)] + [(200, [0.0] * 4, 0), (300, [1.0, 2.0], 0), (350, [3.0, 4.0], 0)]
    f = {i: [int(256 * c // 1) if abs(c) < 1e15 else int(c * 256) for c in v] for i, v, _ in rows}
    want = {}
    for i in f:
        if i % 50 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(f[i], f[k])))), k) for k in f if k != i and len(f[k]) == len(f[i]))
            want[i] = [(k, -p) for p, k in s[:5]]
    got = defaultdict(list)
    for q in sorted(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect(), key=lambda q: (q["query_id"], q["rank"])):
        got[q["query_id"]].append((q["vec_id"], q["score"]))
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_byte_bpe_query(spark, docs, rows, tmp_path, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Encoder(path, P.PATTERN).ranks, special_tokens={})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.QUERIES["op8_byte_bpe"](spark, str(tmp_path)).collect())
    want = Counter()
    for i, s, *_ in rows:
        ids = t.encode_ordinary(s or "")
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((s or "").encode()).hexdigest()] += 1
    assert got == want


def test_packing_query(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole = defaultdict(list)
    for i, s, *_ in rows:
        whole[i].append([*t.encode(s or "", add_special_tokens=False).ids, 2])
    got = packing.packed(docs).collect()
    by, places, used = defaultdict(Counter), defaultdict(list), 0
    for r in got:
        by[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        used += r["length"]
    want = defaultdict(Counter)
    for i, texts in whole.items():
        for ids in texts:
            for a in range(0, len(ids), 4096):
                piece = ids[a : a + 4096]
                want[i][a, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(ids)] += 1
    assert by == want
    for p in places.values():
        end = 0
        for o, n in sorted(p):
            assert o == end
            end += n
        assert end <= 4096
    assert used >= 0.95 * 4096 * (len(places) - 1)


def test_shortest_pack_first():
    """Against the rule, one length at a time."""
    r = random.Random(9)
    assert sorted(sorted(ls) for _, ls in packing.patterns({3000: 1, 2000: 1, 1000: 1, 500: 1})) in ([[500, 1000, 2000], [3000]], [[500, 3000], [1000, 2000]])
    for _ in range(20):
        h = {r.randrange(1, 1 + r.choice([40, 4096])): r.randrange(1, 30) for _ in range(r.randrange(1, 30))}
        rooms = []
        for n in sorted(h, reverse=True):
            for _ in range(h[n]):
                k = max(range(len(rooms)), key=rooms.__getitem__, default=None)
                if k is None or rooms[k] < n:
                    rooms.append(4096 - n)
                else:
                    rooms[k] -= n
        packs = packing.patterns(h)
        assert sum((Counter({n: c * ls.count(n) for n in set(ls)}) for c, ls in packs), Counter()) == Counter(h)
        assert all(sum(ls) <= 4096 for _, ls in packs) and abs(sum(c for c, _ in packs) - len(rooms)) <= 1 + len(rooms) // 20
