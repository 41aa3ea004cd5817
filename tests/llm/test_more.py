"""Caps that are gone, methods that have to matter, and names that clash."""

import gc
import re
import sys
import time
import tracemalloc
import weakref
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliant.llm import common, embeddings, fingerprint, minhash, mixing, packing, quality, substring, tokens, wordhash
from foliant.llm.common import spread_join
from foliant.llm.wordhash import _CODES

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Blind(substring.Passages):
    def locate(self, documents):
        return [np.zeros(len(w), bool) for w in documents]


def test_marks_come_from_the_automata(spark):
    shared = " ".join(f"s{i}" for i in range(80))
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(50))} {shared} {' '.join(f'b{i}x{j}' for j in range(40))}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in substring.remove_repeats(docs).collect()] == [80] * 6
    assert [r["n_removed"] for r in substring.remove_repeats(docs, automata=Blind).collect()] == [0] * 6
    # a phrase given by one document is found in another, and in a part of memory at a time
    phrase = shared.encode()
    assert [int(m.sum()) for m in substring.Passages([phrase]).locate([rows[3][1].encode().split(), b"x y".split()])] == [80, 0]


def test_passages_in_parts(monkeypatch):
    monkeypatch.setattr(substring, "NODES", 50)
    phrases = [b" ".join(b"%d_%d" % (k, i) for i in range(40)) for k in range(5)]
    found = substring.Passages(phrases)
    assert len(found.parts) == 5
    text = b" ".join([b"x", phrases[1], b"y", phrases[4]]).split()
    assert found.locate([text])[0].tolist() == [False, *[True] * 40, False, *[True] * 40]


def test_repeats_inside_one_document_and_edits(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        own = list(base)
        for at in rng.choice(400, 6, replace=False):
            own[at] = f"e{rng.integers(5)}"  # edits that some share
        rows.append((i, " ".join(own)))
    rows.append((99, " ".join([*base[:60], "z", *base[:60]])))
    count = Counter(tuple(t.split()[j : j + 35]) for _, t in rows for j in range(len(t.split()) - 34))
    wanted = {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        wanted[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: " ".join((r["text"] or "").split()) for r in found.collect()} == wanted


def test_hot_keys_join_once(spark, monkeypatch):
    from foliant import rows

    monkeypatch.setattr(rows, "SPREAD", 10)
    many = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v"))
    few = many.groupBy("k").agg(F.count("*").alias("n"))
    joined = spread_join(many, few, ["k"], "n", F.col("v"), 1000)
    assert joined.count() == 1000 and joined.select("v").distinct().count() == 1000
    wanted = Counter(i % 7 * (i % 3) for i in range(1000))
    assert all(r["n"] == wanted[r["k"]] for r in joined.collect())


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "date"])
def test_fingerprints_of_any_key(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprint, "PART_BYTES", 3_000)
    texts = [f"text {i} " * (i * 37 % 90) for i in range(60)]
    key = {"string": "concat('doc-', id)", "decimal(20,0)": "cast(id * 12345678901 as decimal(20,0))", "date": "date_add(date'2020-01-01', cast(id as int))"}[kind]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr(f"CASE WHEN id < 57 THEN {key} END AS doc_id", "text").repartition(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    order = sorted((r for r in rows if r[0] is not None), reverse=True)
    found = fingerprint.fingerprints(docs).collect()
    assert len(found) == 60
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for (k, text), (_, after) in zip(order, order[1:], strict=False):
        r = by[k]
        assert r["n_chars"] == len(text) and r["near_next"] == fingerprint.likeness(fingerprint.of_text(text), fingerprint.of_text(after))
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["near_edited"] == fingerprint.likeness(fingerprint.of_text(text), fingerprint.of_text(edited))
    assert isinstance(order[0][0], (str, Decimal)) or kind == "date"


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(3)
    for keep in (0.2, 0.6, 0.9):
        a = "".join(chr(97 + c) for c in rng.integers(0, 26, 4000))
        b = a[: int(4000 * keep)] + "".join(chr(97 + c) for c in rng.integers(0, 26, 4000 - int(4000 * keep)))
        sets = [{t[i : i + fingerprint.WIDTH] for i in range(len(t) - fingerprint.WIDTH + 1)} for t in (a, b)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs(fingerprint.likeness(fingerprint.of_text(a), fingerprint.of_text(b)) - true) < 0.2


def test_golden_ratio_schedule(spark):
    for total in (1, 2, 10, 987, 5000):
        step, back = mixing.lattice(total)
        assert sorted(i * step % total for i in range(total)) == list(range(total)) and (total == 1 or step * back % total == 1)
    plan = spark.createDataFrame([("a", 5000), ("b", 2500), (None, 300), ("c", 1)], "source string, slots long")
    rows = sorted((r["slot"], r["source"], r["rank"]) for r in mixing.schedule(plan, 7801, run=512).collect())
    assert [s for s, _, _ in rows] == list(range(7801))
    seen, share = Counter(), {"a": 5000 / 7801, "b": 2500 / 7801, None: 300 / 7801, "c": 1 / 7801}
    for slot, source, rank in rows:
        assert rank == seen[source]
        seen[source] += 1
        assert all(abs(seen[s] - p * (slot + 1)) <= 6 for s, p in share.items())


def test_recall_on_many_links(spark, capsys):
    rng = np.random.default_rng(11)
    rows, links, label_links = [], Counter(), Counter()
    for label in range(3):
        centres = rng.normal(size=(150, 48))
        x = np.float32(centres[rng.integers(0, 150, 2200)] + rng.normal(size=(2200, 48)) * 0.24)
        unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))
        label_links[label] = len(i)
        for a in np.concatenate([i, j]):
            links[2200 * label + int(a)] += 1
        rows += [(2200 * label + k, [float(v) for v in vec], label) for k, vec in enumerate(x)]
    assert min(label_links.values()) >= 5000
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = embeddings.near_vectors(docs, fill=16).collect()
    for label in range(3):
        got = sum(r["n_links"] for r in found if r["vec_id"] // 2200 == label)
        recall = got / (2 * label_links[label])
        with capsys.disabled():
            print(f" label {label}: recall {recall:.4f} of {label_links[label]} links")
        assert 0.9 <= recall <= 1
    assert all(r["n_links"] <= links[r["vec_id"]] for r in found)


def test_grid_grows_and_rare_sizes_are_indexed(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=12 if i % 4 else 20)], 0) for i in range(3000)]
    packed = spark.createDataFrame([(i, "0", len(v), np.array(v).tobytes()) for i, v, _ in rows], "cls long, label string, size int, payload binary")
    books = embeddings._books(packed, "<f8", 8, 0.93, 0.98)
    assert set(books) == {12, 20}
    assert len(books[12].books[0]) == round((2250 / 8) ** 0.5) and len(books[20].books[0]) == round((750 / 8) ** 0.5)


def test_packing_keeps_proportions(spark):
    rng = np.random.default_rng(5)
    sizes = {"a": 600, "b": 250, "c": 90}
    rows = [(i, f"w{i} " * int(rng.integers(5, 120)), s) for i, (s, n) in enumerate((s, n) for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"a": 1, "b": 2, "c": 1}):
        pieces = sorted(packing.pack(docs, weights=weights).collect(), key=lambda p: (p["sequence_id"], p["offset"]))
        totals = Counter()
        for p in pieces:
            totals[p["source"]] += p["length"]
        whole, held, at = sum(totals.values()), Counter(), 0
        share = {s: n / whole for s, n in totals.items()} if weights is None else {s: w / 4 for s, w in weights.items()}
        for p in pieces:
            held[p["source"]] += p["length"]
            at += p["length"]
            assert at == p["sequence_id"] * 2048 + p["offset"] + p["length"]
            if weights and min(totals[s] - held[s] for s in totals) <= 2 * packing.QUANTUM:
                break  # a source runs out
            # deficits stay below a few quanta
            assert all(abs(held[s] - share[s] * at) <= 4 * packing.QUANTUM for s in totals)
        assert at > whole / 4


def test_small_sources_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 20)
    docs = spark.createDataFrame([(i, "some words here " * (40 if i < 200 else 1), "big" if i < 200 else f"s{i}") for i in range(300)], "doc_id long, text string, source string")
    pieces = packing.pack(docs).collect()
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
    assert {p["source"] for p in pieces} == {"big", *(f"s{i}" for i in range(200, 300))}


def test_features_by_brute_force():
    """Pooled vectors and ratios of one text at a time, token by token."""
    texts = [b"The THE cat's 12 mats!! are  OK\nare OK\n\n", "été 5€ ---".encode(), b"", b"\n", b"x" * 3000 + b" yY Yy ...."]
    model = quality.vectors([t or b"" for t in texts])
    mask = (1 << 64) - 1

    def hashed(token):
        h = sum(int(_CODES[b]) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(token)) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = ((h ^ (h >> shift)) * factor) & mask
        return h ^ (h >> 31)

    for text, found in zip(texts, model.pooled(texts), strict=True):
        tokens = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", text)
        if not tokens:
            assert not found.any()
            continue
        hashes = [hashed(t) for t in tokens]
        n = len(tokens)
        words = sum(model.words[h >> 50].astype(float) for h in hashes) / n
        assert np.allclose(found[: quality.SIZE], words, atol=1e-4)
        lines = text.split(b"\n")
        marks = sum(not (t[:1].isalnum() or t[0] >= 128) for t in tokens)
        capitals = sum((c := sum(65 <= b <= 90 for b in t)) >= len(t) - 1 and c > 0 and len(t) > 1 for t in tokens if t[:1].isalnum() or t[0] >= 128)
        ratios = [np.log1p(n), len(set(hashes)) / n**0.8, len(set(lines)) / len(lines), marks / n, capitals / n, len(text) / n / 8, sum(a == b for a, b in zip(hashes, hashes[1:], strict=False)) / n, sum(a == b for a, b in zip(hashes, hashes[2:], strict=False)) / n]
        assert np.allclose(found[2 * quality.SIZE :], ratios, atol=1e-4)


def test_long_texts_are_learned_from(spark):
    """Labelled texts of any length take part: here only long ones tell the labels apart."""
    rows = [(i, ("good fine nice " if i % 2 else "!!! ??? $$$ ") * 4000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((scored[i] >= 0.5) == bool(i % 2) for i in held)


def test_names_that_clash(spark):
    rows = [(i, f"word{i} " * 50, "en", "s", 0, "x", "y", 1, 2, 3) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _text string, c0 string, uid int, size int, score int")
    model = quality.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    found = quality.score(docs, model)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["score"] and found.count() == 12
    assert set(substring.remove_repeats(docs).columns) >= {"_text", "c0", "uid", "size", "score"}
    for run in (lambda d: minhash.near_duplicates(d), lambda d: mixing.mix(d)[0], lambda d: packing.pack(d), lambda d: fingerprint.fingerprints(d)):
        assert run(docs).count() >= 12


def test_equal_keys_and_classes(spark):
    same = " ".join(f"k{i}" for i in range(50))
    docs = spark.createDataFrame([(5, same), (5, same), (None, same), (7, same + " tail"), (None, "alone in the world"), (8, None), (8, "")], "doc_id long, text string")
    found = minhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in found if r["doc_id"] in (5, 7)) == [(False, 5, 5, True)] * 2 + [(False, 7, 5, False)]
    assert sum(r["chosen"] for r in found) == 4
    groups = defaultdict(int)
    for r in found:
        groups[r["component_id"]] += r["chosen"]
    assert groups[5] == 1


def test_hot_paths_give_the_same(spark, monkeypatch):
    """With every key hot beyond five rows, results are those of plain joins."""
    from foliant import rows

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)] * 12 + [" ".join(w if rng.random() > 0.02 else f"e{rng.integers(9)}" for w in base) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4).round(0 if i % 2 else 2)], 0) for i in range(80)], "vec_id long, embedding array<float>, label int")
    runs = (lambda: substring.remove_repeats(docs).select("doc_id", "n_removed", "kept_sha256"), lambda: minhash.near_duplicates(docs, 3, 85, 100).drop("uid"), lambda: embeddings.near_vectors(vectors, fill=4).drop("uid"))
    plain = [sorted(map(tuple, run().collect())) for run in runs]
    monkeypatch.setattr(rows, "SPREAD", 5)
    assert [sorted(map(tuple, run().collect())) for run in runs] == plain


def test_shuffle_files_go_step_by_step(spark, monkeypatch):
    """op1 sweeps between its steps; each time what had been shuffled before the last sweep but one is gone."""
    sc = spark.sparkContext._jsc.sc()
    made = [sc.newShuffleId()]

    def swept(session, sweep=minhash.sweep):
        gc.collect()  # as frames in cycles and events that still wait hold what they tell of
        sc.listenerBus().waitUntilEmpty(10_000)
        sweep(session)
        until = time.time() + 10
        while (old := [x for x in map(int, str(sc.env().mapOutputTracker().shuffleStatuses().keys().mkString(" ")).split()) if made[0] < x < made[-2:][0]]) and time.time() < until:
            time.sleep(0.1)
        assert not old, (old, made)
        made.append(sc.newShuffleId())

    monkeypatch.setattr(minhash, "sweep", swept)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 4}x{j}" for j in range(40 + i % 4))) for i in range(80)], "doc_id long, text string")
    found = minhash.near_duplicates(docs, k=3, num=85, den=100)
    assert len(made) > 8 and made[-1] - made[0] > 40
    assert max(b - a for a, b in zip(made, made[1:], strict=False)) < (made[-1] - made[0]) / 2
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i // 4 * 4 for i in range(80)}


def test_release_gives_memory_back():
    """Without a later run of the garbage collector."""

    class Cached:
        def __init__(self):
            self.cache = tokens.Kept(self.make, 10)

        def make(self, key):
            return key

    gc.disable()
    try:
        held = weakref.ref(common.kept("cached", Cached))
        assert held() is common.kept("cached", Cached)
        wordhash.powers(np.uint64(3), 1000)
        common.release()
        assert held() is None
        assert not wordhash._powers
    finally:
        gc.enable()


def test_slices_copy_a_run_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array([*(chr(97 + i % 26) * (1 << 20) for i in range(48)), None, "", "é"])], ["text"])
    tracemalloc.start()
    try:
        found = [(part.num_rows, [t and (len(t), t[:1]) for t in texts]) for part, texts in common.slices([batch.slice(1)])]
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
    assert [n for n, _ in found] == [*[1] * 47, 3]
    assert [t for _, ts in found for t in ts] == [*((1 << 20, chr(97 + i % 26).encode()) for i in range(1, 48)), None, b"", (2, b"\xc3")]


def test_small_tables_need_no_python_workers(spark, monkeypatch):
    """And the driver keeps nothing of the fit but the model."""
    docs = spark.createDataFrame([(i, f"some words of text {i} " * (1 + i % 7), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    plain = [quality.score(docs, quality.train(docs, labels)).orderBy("doc_id").collect(), packing.pack(docs).count()]

    def refused(*_, **__):
        raise AssertionError("rows of a list go through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    model = quality.train(docs, labels)
    assert not wordhash._powers
    assert [quality.score(docs, model).orderBy("doc_id").collect(), packing.pack(docs).count()] == plain
    assert quality.train(docs, labels.limit(0)).scores([b"x"])[0] == 0.5
    assert packing.pack(docs.limit(0)).count() == 0


def test_vectors_hold_few_bytes_a_token():
    rng = np.random.Generator(np.random.PCG64(3))
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 3000)).encode() for _ in range(300)]
    quality.vectors(texts[:2])
    tracemalloc.start()
    try:
        quality.vectors(texts)
        assert tracemalloc.get_traced_memory()[1] < 90 * 300 * 3000
    finally:
        tracemalloc.stop()


def test_stages_send_a_text_once(spark):
    """To Python, that is: each further copy of a task's texts is held by the JVM and by the worker."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"some words of text {i}", "ab"[i % 2], "s") for i in range(40)], "doc_id long, text string, source string, score string")
    model = quality.vectors([b"some words"])
    for scored in (quality.score(docs, model, name="found"), quality.score(docs.withColumn("text", F.col("text").cast("binary")), model, name="found")):
        assert {r["doc_id"]: r["found"] for r in scored.collect()} == {i: 0.5 for i in range(40)}
    for df in (quality.score(docs.select("doc_id", "text"), model), corpus_pipeline.substring_stage(spark, docs, "")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        sent = [x for x in re.findall(r"(?:Project|LogicalRDD) \[([^\n]*)\]", plan) if x.count("text#") > 1]
        assert not sent, sent
    assert corpus_pipeline.substring_stage(spark, docs, "").columns == docs.columns


def test_encoders_caches_are_bounded():
    """And ids do not depend on them: words with marks, over line ends, beside white space, beyond the pattern's letters."""
    path = packing.public_tokenizers.path("byte_bpe_50k.json")
    small, rng = packing.IdEncoder(path, 50), np.random.Generator(np.random.PCG64(9))
    parts = ["ab", "c\n", "\n", "d.\nEf,", "g\nh\ni", "\x1c", "\x1c\nj", "k\n\x1cl", "\n\nm", "n\r\no", "\u00e9\n\u4e2d", "it's\n've", "3\n4", "p \n", "\xa0\nq", "r\n\xa0s", "$$\n##"]
    texts = [rng.choice(["", " "]).join(str(x) for x in rng.choice(parts, 12)) + f" w{i} x{i}\ny{i}" for i in range(400)]
    texts += [" ".join(str(x) for x in rng.choice(parts, 12)) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(small.encode(t), small.width).tolist() == small.library.encode(t, add_special_tokens=False).ids, t
    assert all(len(c) <= 50 and len(c.older) <= 50 for c in (small._chunks, small._pieces, small._lines))
