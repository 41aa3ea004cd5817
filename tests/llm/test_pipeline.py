"""Each stage of the pipeline against a brute-force version, on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as c
import numpy as np
import public_tokenizers
import pytest

from foliant.llm import quality, tokens

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, n_chars long, uid int, size int, epoch string, _begin int, _length int, _text string, c1 string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_quality_stage(spark, docs):
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = docs.collect()
    scores = model.scores([(r["text"] or "").encode() for r in rows])
    wanted = Counter(tuple(r) for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD)
    left = c.quality_stage(spark, docs, DATA)
    assert left.schema.simpleString() == docs.schema.simpleString()
    found = Counter(tuple(r) for r in left.collect())
    assert sum(((found - wanted) + (wanted - found)).values()) <= sum(abs(s - quality.THRESHOLD) < 1e-6 for s in scores)


def test_near_dedup_stage(spark, docs):
    rows = docs.collect()
    sets = []
    for r in rows:
        w = WORD.findall(lower(r["text"]))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    groups = defaultdict(list)
    for r, x, s in zip(rows, root, sets, strict=True):
        groups[x if s else ("none", r["doc_id"])].append(r["doc_id"])
    left = c.near_dedup_stage(spark, docs, DATA)
    assert left.schema.simpleString() == docs.schema.simpleString()
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(min(g) for g in groups.values())


def test_substring_stage(spark, docs):
    rows = {r["doc_id"]: WORD.findall(r["text"] or "") for r in docs.collect()}
    count = Counter(tuple(w[j : j + 35]) for w in rows.values() for j in range(len(w) - 34))
    left = c.substring_stage(spark, docs, DATA).collect()
    assert len(left) == len(rows)
    for r in left:
        w = rows[r["doc_id"]]
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        assert WORD.findall(r["text"]) == [x for x, g in zip(w, gone, strict=True) if not g]
        assert r["n_chars"] == len(r["text"])


def test_mixing_stage(spark, docs):
    rows = docs.collect()
    left = c.mixing_stage(spark, docs, DATA).collect()
    sizes, weights, goal = Counter(), {}, {}
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest = 1.5 * sum(sizes.values())
    while True:  # water filling
        open_ = [s for s in names if s not in goal]
        over = [s for s in open_ if rest * weights[s] / sum(weights[x] for x in open_) > 2 * sizes[s]]
        if not over:
            break
        goal |= {s: 2 * sizes[s] for s in over}
        rest = 1.5 * sum(sizes.values()) - sum(goal.values())
    goal |= {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
    took = Counter()
    for r in left:
        took[r["source"]] += len(WORD.findall(r["text"]))
    assert all(-1 < took[s] - goal[s] <= 1e-6 for s in names)
    whole = {r["doc_id"]: WORD.findall(r["text"] or "") for r in rows}
    for r in left:  # each row is a run of its document's words
        w, own = WORD.findall(r["text"]), whole[r["doc_id"]]
        assert any(own[i : i + len(w)] == w for i in range(len(own) - len(w) + 1))
    assert max(Counter(r["doc_id"] for r in left).values()) <= 2


def test_packing_stage(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    wanted = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    got = defaultdict(dict)
    for p in c.packing_stage(spark, docs, DATA).collect():
        got[p["doc_id"]][p["start"]] = np.frombuffer(p["ids"], np.uint16).tolist()
    assert {k: [x for _, part in sorted(v.items()) for x in part] for k, v in got.items()} == wanted


def test_odd_documents(spark):
    more = (1, 2, "e", 3, 4, "t", "z")
    rows = [(1, None, "en", None, None, *more), (1, "", None, "s", 0, *more), (None, "a b", "en", "s", 3, *more), (2, "w " * 90, "en", "s", 180, *more), (2, "w " * 90, "en", "s", 180, *more)]
    docs = spark.createDataFrame(rows, ODD)
    for k, (_, stage) in enumerate(c.STAGES):
        left = stage(spark, docs, DATA)
        assert left.count() >= 1
        if k < len(c.STAGES) - 1:
            assert left.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_run(spark):
    assert c.run(spark, DATA).count() > 0
