"""The pipeline's stages against plain rewritings, one after the other."""

import re
import sys
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from test_brute import _KINDS, rows  # noqa: F401
from test_operators import LOW, SCHEMA, WORD

import corpus_pipeline as C


@pytest.fixture(scope="module")
def given(rows):  # noqa: F811
    passage = " ".join(f"passage{k % 13} ka{k}" for k in range(60))
    near = [" ".join([*(f"w{k}" for k in range(80)), f"end{i}"]) for i in range(4)]
    more = [(600 + i, f"ka lo mi {i} {passage} tu {i} tu", "aa", "s", 7) for i in range(3)] + [(700 + i, t, "aa", "s", 7) for i, t in enumerate(near)]
    return [r for r in rows if r[0] != 104] + more


def test_stages(spark, given, tmp_path):
    spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in C.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.collect())
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    first, second, third, fourth, last = tables
    # language: only texts without a letter are sure to go, and clean ones to stay
    key = lambda r: (r[0], r[1])
    gone = Counter(map(key, given)) - Counter(map(key, first))
    assert Counter((i, t) for i, t, *_ in given if not t or not any(c.isalpha() for c in t)) <= gone
    assert not [i for i, t in gone if i is not None and (i < 90 or 600 <= i < 704)]
    # near copies: one of each group of linked sets, the least id; all rows without an id
    sets = {}
    for r in first:
        w = WORD.findall(r["text"].translate(LOW))
        if r["doc_id"] is not None:
            sets.setdefault(r["doc_id"], []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    kept = Counter(r["doc_id"] for r in second)
    assert {i for i in kept if i is not None} == {find(i) for i in sets} and all(n == 1 for i, n in kept.items() if i is not None)
    assert kept[None] == sum(r["doc_id"] is None for r in first)
    # passages of over 50 words are left in one document; documents that share nothing stay
    assert sorted(map(repr, (r["doc_id"] for r in third))) == sorted(map(repr, (r["doc_id"] for r in second)))
    held = defaultdict(set)
    for n, r in enumerate(third):
        w = r["text"].split()
        for k in range(len(w) - 50):
            held[tuple(w[k : k + 51])].add(n)
    assert all(len(v) == 1 for v in held.values())
    before, after = ({r["doc_id"]: r["text"] for r in t if r["doc_id"] is not None} for t in (second, third))
    assert all(after[i] == before[i] for i in before if i < 90) and all(r["n_chars"] in (None, 0, 7, len(r["text"])) for r in third)
    # personal data goes, and nothing where there is none
    for r, s in zip(*(sorted(t, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"] or 0)) for t in (third, fourth))):
        spans = [m.span() for p, ok in _KINDS.values() for m in p.finditer(r["text"]) if ok(m.group())]
        assert (s["text"] == r["text"]) or spans
        assert not spans or re.search("<(EMAIL|IP|CARD|PHONE|TERM)>", s["text"])
    # every token of every text in one place
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in fourth)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in last if r["start"] == 0) == want
    assert sum(r["length"] for r in last) == sum(n * c for (_, n), c in want.items())
    assert Counter(map(repr, C.run(spark, str(tmp_path)).select("doc_id", "start", "length", "doc_tokens").collect())) == Counter(repr(r) for r in docs.select("doc_id", "start", "length", "doc_tokens").collect())


def test_empty_and_unlabelled(spark, given, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    free = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in given], SCHEMA)
    assert C.language(spark, free, str(tmp_path)).count() == len(given)
    other = spark.createDataFrame([(*r, "mine", 0.1) for r in given], SCHEMA + ", lang_pred string, score double")
    out = C.language(spark, other, str(tmp_path))
    assert out.columns == other.columns and {(r["lang_pred"], r["score"]) for r in out.collect()} == {("mine", 0.1)}
