"""Each operator against a brute-force version on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from foliant.llm import chat, embeddings, fingerprint, minhash, mixing, packing, quality, substring, tokens, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = [f"w{i * i % 97} v{i}" for i in range(60)]
NEAR = " ".join([*BASE[:30], "changed", *BASE[31:]])
TEXTS = [" ".join(BASE), " ".join(BASE).upper(), NEAR, None, "", "  \n\t", "one", "One", "two words", "er " * 100, "x " * 35, "a b c " * 40, "é中 <|endoftext|> it's  12\n\n x", " ".join(f"q{i % 1013}" for i in range(30_000)), " ".join(BASE[5:45]) + " tail", " ".join(BASE)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "ab"[i % 2] if i % 5 else None, len(t or ""), 1, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, source string, n_chars long, uid int, score string").repartition(3)


def everything(docs):
    return {
        "near": lambda d: minhash.near_duplicates(d), "repeats": lambda d: substring.remove_repeats(d), "mix": lambda d: mixing.mix(d)[0],
        "prints": lambda d: fingerprint.fingerprints(d), "pack": lambda d: packing.pack(d), "tokens": lambda d: tokens.count_tokens(d),
    }


def test_empty_tables(spark, docs):
    for run in everything(docs).values():
        assert run(docs.limit(0)).collect() == []
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert chat.digest(chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
    model = quality.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs.limit(0), model).collect() == []
    assert all(r["score"] == 0.5 for r in quality.score(docs, model).collect())


def test_null_keys(spark, docs):
    odd = docs.selectExpr("CASE WHEN doc_id > 3 THEN doc_id END AS doc_id", "text", "lang", "source", "n_chars")
    for run in everything(docs).values():
        assert run(odd).count() >= docs.count()


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, num):
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").lower() if (r["text"] or "").isascii() else (r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    found = minhash.near_duplicates(docs, k, num, 100).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {(i, len(sets[i]), root[i], root[i] == i) for i in sets}
    assert Counter(r["component_id"] for r in found if r["chosen"] and r["n_shingles"]) == {root[i]: 1 for i in sets if sets[i]}


def test_stars_and_blocks_agree(spark):
    """A family whose members are only near their parent, and a chain."""
    rng = np.random.default_rng(1)
    parent = [f"p{i}" for i in range(200)]
    texts = [" ".join(parent)]
    for _ in range(60):
        own = list(parent)
        for at in rng.choice(200, 4, replace=False):
            own[at] = f"z{rng.integers(10**9)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[j : j + 3]) for j in range(198)} for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85, 100)
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == list(enumerate(root))


def test_sketch_likelihood():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.95):
        common = rng.integers(0, 2**64, 2000, dtype=np.uint64)
        n = int(2000 * (1 - share) / share / 2)
        a, b = (minhash.sketch(np.concatenate([common, rng.integers(0, 2**64, n, dtype=np.uint64)]))[None, :] for _ in range(2))
        size = np.array([2000 + n])
        assert minhash.plausible(a, b, size, size, 0.85)[0] == (share > 0.85)


def test_mixing(docs):
    taken, mixed = mixing.mix(docs)
    rows = taken.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["taken"]
    goals = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert sum(t for _, t in goals.values()) == pytest.approx(1.5 * sum(s for s, _ in goals.values()))
    for source, (_, target) in goals.items():
        assert abs(by[source] - target) <= 4 * mixing.LEAST_BLOCK + 0.01 * target
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs)[0].collect()))
    assert sum(r["length"] for r in mixed.collect()) == sum(r["taken"] for r in rows)


def test_mixing_tiny_sources_beside_large_blocks(spark):
    sizes = {"hot": [900] * 60, None: [700] * 20, "x3": [3], "x40": [7] * 5 + [5], "x300": [100] * 3, "x1000": [250] * 4, "empty": [0, 0]}
    rows = [(100 * i + j, s, " ".join(["w"] * n)) for i, (s, ns) in enumerate(sizes.items()) for j, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, mixed = mixing.mix(docs, slots=20)  # so a block has thousands of words, more than the small sources
    rows, pieces = taken.collect(), mixed.collect()
    by, met, at = defaultdict(int), defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in rows:
        by[r["source"]] += r["taken"]
    for p in pieces:
        met[p["uid"]] += p["length"]
        at[p["slot"]][p["source"]] += p["length"]
    goals = {r["source"]: r["target"] for r in rows}
    assert set(by) == set(sizes)
    assert all(-1 < by[s] - t <= 1e-6 for s, t in goals.items())
    assert {r["uid"]: r["taken"] for r in rows if r["taken"]} == dict(met)
    assert sorted(at) == list(range(len(at))) and all(len(v) == 1 for v in at.values())
    held, largest = defaultdict(int), {s: max((n[s] for n in at.values() if s in n), default=0) for s in goals}
    for k, slot in enumerate(sorted(at)):
        for s, n in at[slot].items():
            held[s] += n
        assert all(abs(held[s] - t * (k + 1) / len(at)) <= 3 * largest[s] + 0.15 * t for s, t in goals.items())


def test_mixing_takes_what_the_schedule_deals(docs, tmp_path, spark, monkeypatch):
    docs.selectExpr("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    docs = mixing.table(spark, str(tmp_path), "documents")
    dealt = mixing.schedule
    whole = sum(r["taken"] for r in mixing.op2_mixing(spark, str(tmp_path)).collect())
    monkeypatch.setattr(mixing, "schedule", lambda *a, **k: dealt(*a, **k).where("slot % 2 = 0"))  # half of the slots
    taken, mixed = mixing.mix(docs)
    half = defaultdict(int)
    for p in mixed.collect():
        half[p["uid"]] += p["length"]
    assert {r["uid"]: r["taken"] for r in taken.collect() if r["taken"]} == dict(half)
    assert 0 < sum(r["taken"] for r in mixing.op2_mixing(spark, str(tmp_path)).collect()) < whole


def test_targets_water_filling(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), ("d", 5000), (None, 40)]
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight, left, goal = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), 1.5 * sum(s for _, s in sizes), {}
    size = dict(sizes)
    while True:
        open_ = [s for s in size if s not in goal]
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]
        if not over:
            break
        total = sum(weight[x] for x in open_)
        for s in over:
            goal[s] = 2.0 * size[s]
        left -= sum(goal[s] for s in over)
        assert total
    goal |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert found == pytest.approx(goal)


def test_chat(spark):
    rng = np.random.default_rng(2)
    turns = [(c, t, ["system", "user", "assistant"][min(t, 1 + t % 2) if c % 2 else 1 + t % 2], None if (c + t) % 11 == 0 else " ".join(["hi <|im_end|> <!| % x\ny"] * int(rng.integers(0, 60)))) for c in range(12) for t in range(int(rng.integers(1, 30)))]
    turns += [(50, None, None, "x"), (50, 1, "a%0A\nb|<|", "y"), (None, 1, "assistant", "z"), (51, 0, "system", "only"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_windows(df)).collect()}
    told = defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda v: (str(v[0]), v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        told[c].append((r or "", x or ""))
    assert set(got) == set(told)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, own in told.items():
        lost = "".join(x for r, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for r, x in own)), len(lost), sha(lost))
    for w in chat.format_windows(df).collect():
        turns = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", w["formatted"], re.S)
        assert len(turns) == w["n_turns"] and "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in turns) == w["formatted"]
        assert sum(len(WORD.findall(x)) + chat.MARKUP for _, x in turns) <= chat.BUDGET or w["n_turns"] - w["n_repeated"] == 1


def test_fingerprints(docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "PART_BYTES", 20_000)
    distinct = docs.dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in distinct.collect()), reverse=True)
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(distinct).collect()}
    for i, (key, text) in enumerate(rows):
        after, half, r = rows[(i + 1) % len(rows)][1], len(text) // 2, found[key]
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.of_text(text), fingerprint.of_text(edited))
        assert r["common_next"] == next((j for j, (x, y) in enumerate(zip(text, after, strict=False)) if x != y), min(len(text), len(after)))
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1


def test_prefix_spans():
    a, b = fingerprint.Prefixes("abcabcabd" * 50), fingerprint.Prefixes("xxabcabcabd" * 40)
    assert a.common(0, b, 2) == 9 and a.equal(3, b, 2, 5) and not a.equal(3, b, 2, 6)


def test_tokens(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in tokens.count_tokens(docs).collect():
        t = TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), count(t), count(t) > 512)
    own, rng = tokens.PrefixCounter(public_tokenizers.path(tokens.VOCABULARY)), np.random.default_rng(3)
    parts = ["a", " ", "  ", "\n", "\t", " the", "'re", "'s", "'", "<|endoftext|>", "<|", "12", "é", "—", "中", "\x1c", "\xa0", "!?", "Hello"]
    for _ in range(150):
        t = "".join(rng.choice(parts, rng.integers(0, 12)))
        counts = [count(t[:i]) for i in range(len(t) + 1)]
        assert own.prefix_counts(t) == counts
        assert own.truncate(t, 3) == t[: max(i for i, n in enumerate(counts) if n <= 3)]


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    pieces = packing.pack(docs.dropDuplicates(["doc_id"])).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    at, seen = 0, defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert np.frombuffer(p["ids"], np.uint16).tolist() == part and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert at == p["sequence_id"] * 2048 + p["offset"] and p["offset"] + p["length"] <= 2048
        at += p["length"]
        seen[p["doc_id"]].append((p["start"], p["length"]))
    for i, own in ids.items():
        covered = sorted(seen[i])
        assert [s for s, _ in covered] == [0, *np.cumsum([n for _, n in covered])[:-1].tolist()] and sum(n for _, n in covered) == len(own)


def test_repeats(docs):
    rows = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in docs.collect()]
    count = Counter(tuple(w[j : j + 35]) for _, w in rows for j in range(len(w) - 34))
    wanted = Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        wanted[i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), tuple(kept)] += 1
    found = substring.remove_repeats(docs)
    assert {"lang", "source", "uid", "score"} <= set(found.columns)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], tuple(WORD.findall(r["text"] or ""))) for r in found.collect()) == wanted


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.05, 0.4], (400, 1))
    rows = [(i, [float(v) for v in np.float32(a)], int(i % 3)) for i, a in enumerate(x)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [], 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [1.0, None], 1)]
    monkeypatch.setattr(embeddings, "RESIDENTS", 16)
    monkeypatch.setattr(embeddings, "VISITORS", 32)
    found = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), fill=2).collect()}
    good = [(i, np.array(v, float), (lab, len(v))) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    links = Counter(i for p in pairs for i in p)
    root = {r[0]: r[0] for r in rows}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert sum(r["n_links"] for r in found.values()) >= 0.9 * sum(links.values())
    assert all(found[i]["n_links"] <= links[i] for i in found)
    same = sum(found[i]["component_id"] == root[i] for i in found)
    assert same >= 0.9 * len(found)
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in (2000, 2001, 2002, 2003, 2004, 2007))


def test_urls(spark):
    cases = {
        "http://WWW.Example.com/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "https://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "http://evil.org/x.net/es/": ("evil.org", "/x.net/es/", None, "allow"), "nothing": ("", "", None, "allow"), "http://net/fr/?a": ("net", "/fr/", "net/fr/", "block"),
        "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"), "https://example.com": ("example.com", "", None, "allow"), "ftp://q.org/a/login": ("q.org", "/a/login", None, "block"),
    }
    df = spark.createDataFrame([*enumerate(cases), (99, None)], "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df).collect()}
    assert found == dict(enumerate(cases.values())) | {99: ("", "", None, "allow")}


def test_automaton_against_regular_expressions():
    rng, globs = np.random.default_rng(5), ["*a/**", "**b", "a*b*c", "**", "ab", "*.x/**y*", "a**/b" * 20]
    patterns = [re.compile("".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", g)), re.S) for g in globs]
    texts = ["".join(rng.choice(list("abc/x.y"), rng.integers(0, 12))).encode() for _ in range(500)]
    assert urls.run(urls.compile_globs(globs), texts).tolist() == [[bool(p.fullmatch(t.decode())) for p in patterns] for t in texts]


def test_quality(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("the", "and", "ing", "ous", "ter") for b in ("ion", "est", "al", "er")]
    rows = [(i, " ".join((w.upper() + "!!" if i % 4 == 0 else w) for w in rng.choice(words, 40))) for i in range(600)]
    docs = spark.createDataFrame([*rows, (-1, None), (-2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(scored) == 602 and all(0 <= s <= 1 for s in scored.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scored[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.97
