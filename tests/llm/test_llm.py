"""The corpus operators against brute force, on small tables with nulls, empties, ties and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe, compaction, components, iblt, langid, nndescent, packing, simhash, stupid_backoff, suffixes

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, lang string, source string, n_chars long, count long, key string, n long"


def documents():
    r = random.Random(7)
    words = ["the", "and", "of", "to", "in", "hering", "lower", "straße", "été", "x1", "don't", "中文"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    common = make(60)
    rows = [make(r.randint(1, 80)) for _ in range(25)] + [make(20) + " " + common + " " + make(20) for _ in range(4)]
    rows += [rows[0], rows[0], make(3000), "", None, " \t\n", "a", "İΣ ΑΣ <|endoftext|> x", "one.\ntwo.\none.\n" + make(50)]
    out = [(i, t, "en" if i % 2 else None, "s", 0, 1, "k", 2) for i, t in enumerate(rows)]
    return out + [out[3], (None, "lost id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def texts():
    return [(d[0], d[1] or "") for d in documents()]


def test_empty_tables(spark, empty):
    for out in (packing.pack_best_fit(empty, WORD), packing.pack_balanced(empty, WORD), iblt.fingerprints(empty), langid.identify(empty), simhash.link(empty), bpe.digests(empty, BYTE), suffixes.digests(empty), suffixes.remove_repeats(empty), simhash.keep_first(empty), stupid_backoff.scores(empty), nndescent.search(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert out.count() == 0


def library_ids(path, text):
    t = Tokenizer.from_file(path)
    return t.encode(text, add_special_tokens=False).ids


def test_bpe_equals_the_library(docs):
    t = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, x in texts():
        ids = t.encode(x, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs, BYTE).collect())) == want
    assert {r["decoded"] for r in bpe.encode_decode(docs, BYTE).collect()} == {x for _, x in texts()}


def test_balanced_packing_loses_no_id(docs):
    rows = packing.pack_balanced(docs, WORD, window=64, piece=16, group=1000, with_ids=True).collect()
    whole = Counter((i, tuple([*library_ids(WORD, x), 1])) for i, x in texts())
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], tuple(ids.tolist()), r["doc_tokens"]))
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, ids), n in whole.items():
        if sum(c for (j, _), c in whole.items() if j == i) == 1:
            assert sum((p[1] for p in sorted(by_doc[i])), ()) == ids and by_doc[i][0][2] == len(ids)
    assert sum(r["length"] for r in rows) == sum(len(k[1]) * n for k, n in whole.items())
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_differencing_is_near_equal_and_within_capacity():
    r = random.Random(1)
    for n in (0, 1, 7, 300):
        sizes = [r.randint(1, 512) for _ in range(n)]
        place = packing.balanced(sizes, 2048)
        sums = np.bincount(place, weights=sizes) if n else np.zeros(1)
        assert len(place) == n and sums.max() <= 2048
    assert sums.max() - sums.min() < 64
    assert packing.balanced([60, 60, 60], 100).tolist() != [0, 0, 0] and len(set(packing.balanced([60, 60, 60], 100).tolist())) == 3


def test_best_fit_equals_brute_force():
    r = random.Random(2)
    sizes = [r.randint(1, 100) for _ in range(400)]
    free: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free[free.index(min(fits))] -= s
        else:
            free.append(100 - s)
    got = np.bincount(packing.best_fit_decreasing(sizes, 100), weights=sizes)
    assert sorted(100 - got) == sorted(free)


def test_best_fit_matrices(docs):
    rows = packing.pack_best_fit(docs, WORD, window=64, group=2000).collect()
    got = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 64 and r["cu_lengths"][-1] == r["n_tokens"] and not ids[r["n_tokens"] :].any()
        at = packing.positions(r["cu_lengths"], 64)
        assert [k for k in range(64) if at[k] == 0] == r["position_resets"]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_lengths"], r["cu_lengths"][1:]):
            got[d].setdefault(s, []).append(ids[a:b].tolist())
    assert sum(r["n_tokens"] for r in rows) == sum(len(library_ids(WORD, x)) + 1 for _, x in texts())
    for i, x in texts():
        if i not in (3, None):
            assert sum((got[i][s][0] for s in sorted(got[i])), []) == [*library_ids(WORD, x), 1]


def test_language_id(spark):
    r = random.Random(3)
    words = {"aa": ["kolo", "miku", "tavo", "rilo"], "bb": ["szcz", "przy", "wrzk", "grzb"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(2, 50))), lang, "s") for i in range(120) for lang in (r.choice(["aa", "bb"]),)]
    rows += [(200, None, "aa", "s"), (201, "123 !!", "bb", "s"), (202, "kolo miku", None, "s"), (None, "przy szcz", None, "s")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    by = {g["doc_id"]: g for g in got}
    for i, _, lang, _ in rows[:120]:
        assert by[i]["lang_pred"] == lang and 0 <= by[i]["score"] <= 1
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert by[200]["lang_pred"] == by[201]["lang_pred"] == "und" and by[202]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb"


def test_language_model_equals_kernel_ridge_regression():
    """The folded weights against explicit kernels: landmarks, their inverse square root, one-versus-rest ridge."""
    r = random.Random(16)
    words = {"aa": ["kolo", "miku", "tavo", "rilo"], "bb": ["szcz", "przy", "wrzk", "grzb"], "cc": ["ngua", "mwezi", "jambo", "kolo"]}
    texts, langs = zip(*[(" ".join(r.choices(words[y], k=r.randint(1, 6))), y) for y in (r.choice(sorted(words)) for _ in range(40))])
    sets = [set(langid.places(t).tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [x for y in sorted(words) for x in [s for s, z in zip(sets, langs) if z == y][:4]]
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    whiten = vectors @ np.diag(np.maximum(values, 1e-6 * values.max()) ** -0.5) @ vectors.T
    features = lambda some: np.array([[kernel(a, b) for b in marks] for a in some]) @ whiten
    x = features(sets)
    y = np.array([[1.0 if z == n else -1.0 for n in sorted(words)] for z in langs])
    beta = np.linalg.solve(x.T @ x + langid.RIDGE * len(x) * np.eye(len(marks)), x.T @ y)
    asked = ["kolo tavo", "przy", "jambo kolo miku", "zzz qqq", "K"]
    out = features([set(langid.places(t).tolist()) for t in asked]) @ beta
    got = langid.fit_rows(list(texts), list(langs), landmarks=4).predict(asked)
    assert got[0] == [sorted(words)[k] for k in out.argmax(1)]
    assert got[1] == pytest.approx(np.clip((1 + out.max(1)) / 2, 0, 1).tolist(), abs=1e-3)


def brute_fingerprint(text, k):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reachable(n, near):
    root = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            a = stack.pop()
            for b in range(n):
                if b not in seen and near(a, b):
                    seen.add(b)
                    stack.append(b)
        root[i] = min(seen)
    return root


def test_simhash_components(docs):
    rows = [(i, brute_fingerprint(x, 3)) for i, x in texts()]
    root = reachable(len(rows), lambda a, b: bin(rows[a][1] ^ rows[b][1]).count("1") <= 2)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root[k]].append(i)
    want = Counter((i, f - (f >> 63 << 64), min((x for x in least[root[k]] if x is not None), default=None)) for k, (i, f) in enumerate(rows))
    assert Counter(map(tuple, simhash.link(docs).collect())) == want


def test_midpoints_link_what_pairs_link(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(70)})
    root = reachable(len(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    table = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    for pairs in (1, 1000):
        got = {x["node"]: x["root"] for x in components.components(simhash.near_pairs(table, pairs=pairs)).collect()}
        groups = defaultdict(set)
        for f in fps:
            s = f - (f >> 63 << 64)
            groups[got.get(s, s)].add(fps.index(f))
        want = defaultdict(set)
        for k, x in enumerate(root):
            want[x].add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_first_keeps_one_of_each_group(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, own = [], {}
    for g in range(30):
        base = [word() for _ in range(200)]
        for c in range(r.randint(1, 4)):
            w = list(base)
            if c:
                w[r.randrange(200)] = word()
            own[len(rows)] = g
            rows.append((len(rows), " ".join(w), "x"))
    rows.append(rows[5])
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert sorted(own[k["doc_id"]] for k in kept) == list(range(30))
    assert all(k["doc_id"] == min(i for i, g in own.items() if g == own[k["doc_id"]]) for k in kept)


def brute_covered(rows, later, size):
    seen = defaultdict(list)
    for k, (_, x) in enumerate(rows):
        for p in range(len(x) - size + 1):
            seen[x[p : p + size]].append((k, p))
    gone = [np.zeros(len(x), bool) for _, x in rows]
    for at in seen.values():
        if len(at) > 1:
            for k, p in at[1:] if later else at:
                gone[k][p : p + size] = True
    return gone


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup(spark, docs, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(suffixes, "HOT", 1)
    rows = sorted(((i, x.encode()) for i, x in texts()), key=lambda r: (-1 if r[0] is None else r[0]))
    gone = brute_covered(rows, False, suffixes.MATCH)
    want = Counter()
    for (i, x), g in zip(rows, gone):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(int), [0]])) == 1)
        want[i, len(x), int(g.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~g])).hexdigest()] += 1
    assert Counter(map(tuple, suffixes.digests(docs).collect())) == want
    assert sum(g.sum() for g in gone) > 1000
    plain = [r for r in documents() if r[0] is not None][:-1]
    kept = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(plain, DDL)).collect()}
    rows = [(r[0], (r[1] or "").encode()) for r in plain]
    for (i, x), g in zip(rows, brute_covered(rows, True, suffixes.MATCH)):
        assert kept[i]["text"] == bytes(np.frombuffer(x, np.uint8)[~g]).decode("utf-8", "ignore") and kept[i]["key"] == "k"


def test_previous_factors_equal_brute_force():
    r = random.Random(13)
    for letters, n in ((b"ab", 60), (b"a", 40), (b"abcd\0", 120)):
        x = bytes(r.choice(letters) for _ in range(n))
        starts = np.arange(n)
        order = np.array(sorted(range(n), key=lambda k: x[k:]))

        def share(a, b, x=x):
            m = 0
            while max(a, b) + m < len(x) and x[a + m] == x[b + m]:
                m += 1
            return m

        common = np.array([0] + [share(a, b) for a, b in zip(order.tolist(), order[1:].tolist())])
        want = {i: max((share(i, j) for j in range(i)), default=0) for i in range(n)}
        assert dict(zip(order.tolist(), suffixes.previous_factors(order, common).tolist())) == want
        for depth in (1, 3, 7):
            starts = np.arange(n - depth + 1)
            found, shared = suffixes.suffix_order(x, starts, depth)
            strings = [x[k : k + depth] for k in found.tolist()]
            assert strings == sorted(strings) and shared.tolist()[1:] == [min(depth, share(a, b)) for a, b in zip(found.tolist(), found.tolist()[1:])]
            assert suffixes.repeated(x, starts, depth, True).tolist() == [i for i in starts.tolist() if x.find(x[i : i + depth]) < i]


def test_colliding_hashes_are_settled_by_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "rolling", lambda x, n: np.zeros(len(x) - n + 1, np.uint64))
    assert suffixes.repeated(b"abcabd", np.arange(5), 2, False).tolist() == [0, 3]


def test_query_needs_the_factors(spark, docs, monkeypatch):
    """The query's digests come by the factors: without them it finds less."""
    want = suffixes.digests(docs).agg(F.sum("n_removed")).first()[0]
    monkeypatch.setattr(suffixes, "_settle", lambda later: lambda batches: iter(()))
    assert suffixes.digests(docs).agg(F.sum("n_removed")).first()[0] < want


def test_hot_keys_are_dealt_out_and_lose_no_row(spark, docs, monkeypatch):
    want = Counter(map(tuple, suffixes.digests(docs).collect()))
    monkeypatch.setattr(suffixes, "HOT_KEYS", 1 << 40)
    monkeypatch.setattr(suffixes, "HOT", 2)
    assert Counter(map(tuple, suffixes.digests(docs).collect())) == want


def test_long_texts_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 500)
    r = random.Random(6)
    text = bytes(r.choice(b"abcd") for _ in range(3000))
    starts = sorted(s for part in suffixes.segments([text]) for p, a, n, _, _ in suffixes.runs([q[2] for q in part]) for s in range(part[p][1] + a, part[p][1] + a + n))
    assert starts == list(range(3000 - suffixes.MATCH + 1))


def test_iblt(spark, docs):
    rows = iblt.fingerprints(docs).collect()
    assert len(rows) == len(texts())
    order = sorted(texts(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    n = len(order)
    edited = Counter()
    for k, (i, x) in enumerate(order):
        half = len(x) // 2
        edited[i, len(x), hashlib.sha256((x[: len(x) - half] + order[(k + 1) % n][1][:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == edited
    of = defaultdict(set)
    for r in rows:
        of[dict(texts())[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in of.values())


def test_next_documents_with_odd_ids(spark):
    """Many null ids, one id of many rows, ids far from the others, repeated rows: the next row is that of one sorted list."""
    r = random.Random(19)
    rows = [(i, f"text {r.randrange(10**6)}. more {i}") for i in [*range(300), *[77] * 200, *[None] * 200, 1 << 60, -(1 << 60), *[5] * 3]]
    rows += [(9, "same."), (9, "same."), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed = lambda t: simhash.signed_hash((t or "").encode())
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1])))
    texts = [t or "" for _, t in order]
    want = Counter((i, t, texts[(k + 1) % len(texts)]) for k, ((i, _), t) in enumerate(zip(order, texts)))
    assert Counter((x["doc_id"], x["text"], x["next_text"]) for x in iblt.with_next(df).select("doc_id", "text", "next_text").collect()) == want


def test_iblt_recovers_the_differing_digests(spark):
    r = random.Random(8)
    line = lambda: "".join(r.choice("abcdef") for _ in range(12)) + "."
    rows = []
    for common, a, b in ((0, 0, 0), (5, 1, 1), (200, 2, 0), (50, 60, 70), (0, 30, 0), (900, 300, 10)):
        base = [line() for _ in range(common)]
        rows.append(("\n".join(base + [line() for _ in range(a)]), "\n".join(base + [line() for _ in range(b)]), a + b, common))
    t = spark.createDataFrame(rows, "x string, y string, d int, c int").withColumns({"a": iblt.digests("x"), "b": iblt.digests("y")})
    t = t.withColumns({"ca": iblt.sketch("a"), "cb": iblt.sketch("b")}).withColumns({"got": iblt.differing("a", "b", "ca", "cb"), "near": iblt.likeness("a", "b", "ca", "cb")})
    for x in t.collect():
        assert sorted(x["got"]) == sorted(set(x["a"]) ^ set(x["b"])) and len(x["got"]) == x["d"]
        assert x["near"] == pytest.approx(1.0 if not x["d"] + x["c"] else x["c"] / (x["c"] + x["d"]))


def test_compaction(spark, docs, tmp_path):
    clashing = docs.withColumns({"run": F.lit("r"), "tier": F.lit(9), "path": F.lit("p"), "file_bytes": F.lit(1)})
    store = compaction.ShardStore(spark, str(tmp_path / "store"), clashing.schema, target_bytes=1 << 20, least_bytes=1 << 8)
    for wave in range(3):
        store.append(clashing, shard_rows=5)
    before, files = Counter(map(str, store.read().collect())), store.manifest().count()
    version = store.compact()
    assert version > 3 and store.manifest().count() < files / 3
    assert Counter(map(str, store.read().collect())) == before == Counter(map(str, store.read(3).collect()))
    assert store.manifest(3).count() == files
    store.vacuum()  # nothing is old enough
    assert store.read(3).count() == sum(before.values())
    store.vacuum(age=0)
    assert sum(before.values()) == store.read().count() == 3 * docs.count()
    assert store.versions() == [version] and store.placed(F.col("run").alias("own")).columns == ["own", "run", "tier", "file_bytes"]


def test_compaction_of_an_empty_table(spark, empty, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "none"), empty.schema)
    assert store.read().count() == 0 == store.placed(F.col("doc_id")).count()
    store.append(empty)
    store.compact()
    store.vacuum(age=0)
    assert store.version() == 1 and store.read().count() == 0 == store.placed(F.col("doc_id")).count()


def test_of_racing_writers_one_gets_a_version(spark, docs, tmp_path):
    """Many writers that all saw the same version: one commits each number, the others go on to the next, no row is lost."""
    store = compaction.ShardStore(spark, str(tmp_path / "race"), docs.schema)
    store.append(docs)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: store._publish(2, f"list{k}"), range(8)))
        assert won.count(True) == 1 and store._list_of(2) == f"list{won.index(True)}"
        store._delete("versions/v2")
        assert sorted(pool.map(lambda _: store.append(docs), range(4))) == [2, 3, 4, 5]
    assert store.read().count() == 5 * docs.count()


def test_a_crashed_append_hinders_no_later_one(spark, docs, tmp_path, monkeypatch):
    store = compaction.ShardStore(spark, str(tmp_path / "crash"), docs.schema)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda after: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.append(docs)
    assert store.version() == 0 and store.append(docs) == 1
    assert store.read().count() == docs.count()
    store.vacuum(age=0)
    assert store.read().count() == docs.count() and len(store._listed("data")) == 1


def test_a_merge_of_files_that_are_gone_is_given_up(spark, docs, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "stale"), docs.schema, least_bytes=1 << 8)
    for _ in range(5):
        store.append(docs)
    commit, other = store._commit, compaction.ShardStore(spark, store.root, docs.schema, least_bytes=1 << 8)

    def late(after):
        store._commit = commit
        other.compact()
        return commit(after)

    store._commit = late
    store.compact()
    assert store.read().count() == 5 * docs.count()


def test_nn_descent_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (20, x[20].tolist())]
    got = defaultdict(list)
    for r in nndescent.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    s = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21)) and q not in [n[1] for n in near]
        assert all(n[2] == pytest.approx(s[q, n[1]], rel=1e-9) for n in near)
        want = sorted((j for j in range(1500) if j != q), key=lambda j: (-round(s[q, j], 9), j))[:20]
        hits += len({n[1] for n in near} & set(want))
    assert hits / (20 * len(got)) >= 0.9


def recall(spark, x, **kw):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    near = defaultdict(set)
    for r in nndescent.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **kw).collect():
        near[r["query_id"]].add(r["vec_id"])
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    return np.mean([len(near[q] & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in range(0, len(x), 20)])


def test_nn_descent_rounds_make_the_recall(spark):
    """6,000 vectors without clusters in about 60 blocks: the start alone finds little, its search included."""
    x = np.random.default_rng(12).normal(size=(6000, 24)).astype(np.float32)
    small = {"values": 24 * 128, "cell": 64}
    assert recall(spark, x, **small) >= 0.9
    assert recall(spark, x, rounds=0, hops=0, **small) < 0.5


def test_nn_descent_unequal_lengths_and_columns(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, [0.5, 0.5], "b"), (21, [0.0, 2.0], "c"), (40, [1.0, 2.0, 3.0], "d"), (60, [], "e"), (0, [1.0, 0.0], "z")]
    got = nndescent.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 20, 0.5), (0, 2, 21, 0.0), (20, 1, 21, 1.0), (20, 2, 0, 0.5)]
    lonely = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert nndescent.search(lonely).collect() == []


@pytest.mark.parametrize("order", [2, 3])
def test_stupid_backoff(docs, order):
    count, total = Counter(), 0
    for _, x in texts():
        w = x.encode().lower().split()
        total += len(w)
        for n in range(1, order + 1):
            count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    def score(context, word):
        for n in range(len(context), 0, -1):
            if count[(*context[-n:], word)] >= 2:
                return 0.4 ** (len(context) - n) * count[(*context[-n:], word)] / count[tuple(context[-n:])]
        return 0.4 ** len(context) * count[(word,)] / total

    want = Counter()
    for i, x in texts():
        w = x.encode().lower().split()
        want[i, len(w), round(sum(np.log(score(w[max(0, k - order + 1) : k], w[k])) for k in range(len(w))), 6) + 0.0] += 1
    got = Counter((r["doc_id"], r["n_words"], round(r["score"], 6) + 0.0) for r in stupid_backoff.scores(docs, order).collect())
    assert got == want


def test_backoff_query_counts_every_word_and_trigram(spark, tmp_path):
    """70,000 words that occur once each or twice, and common ones: none shares a count with another."""
    from tidewell.llm.queries import op10_stupid_backoff

    r = random.Random(11)
    rare = [f"w{k}" for k in range(70_000)]
    rows = [(i, " ".join(rare[700 * i : 700 * i + 700] + r.choices("abcde", k=40))) for i in range(100)] + [(100, "w1 w3 w2"), (101, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    count, total = Counter(), 0
    for _, x in rows:
        w = x.split()
        total += len(w)
        count.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    def score(*gram):
        if len(gram) == 1:
            return count[gram] / total
        return count[gram] / count[gram[:-1]] if count[gram] else 0.4 * score(*gram[1:])

    want = {i: sum(np.log(score(*w[max(0, k - 2) : k + 1])) for k in range(len(w))) for i, x in rows for w in [x.split()]}
    got = {g["doc_id"]: g["score"] for g in op10_stupid_backoff(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_language_stage_rejects_what_no_language_fits(spark):
    """Of the labelled texts of sf0.01 nearly all stay; words of unlearned scripts and random letters go."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(4)
    make = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(100))
    scripts = ["абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", [chr(c) for c in range(0x4E00, 0x9FA0)], "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    junk = spark.createDataFrame([(-1 - k, make(scripts[k % len(scripts)]), None) for k in range(50)], "doc_id long, text string, lang string")
    kept = [k["doc_id"] for k in corpus_pipeline.language(spark, docs.union(junk), "").select("doc_id").collect()]
    assert not [i for i in kept if i < 0]
    assert len(kept) >= 0.98 * docs.where("text rlike '\\\\p{L}'").count()


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    kept = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, kept, "")
        if name != "packing":
            assert after.columns == kept.columns
        kept = spark.createDataFrame(after.collect(), after.schema)
    assert kept.count() > 0 and "sequence_id" in kept.columns


def test_pipeline_equals_brute_force_stage_by_stage(spark, tmp_path):
    """Each stage against a brute-force version of it on what the stage before kept, and the chain's packed ids."""
    import corpus_pipeline

    r = random.Random(17)
    words = {"aa": ["kolo", "miku", "tavo", "rilo", "sena", "duvi"], "bb": ["szcz", "przy", "wrzk", "grzb", "chrz", "trzc"]}
    make = lambda y, n: [r.choice(words[y]) + r.choice("abcdefgh") for _ in range(n)]
    rows = []
    passage = make("aa", 60)
    for i in range(120):
        y = "aa" if i % 2 else "bb"
        w = make(y, r.randint(30, 120))
        if i % 10 == 1:
            w = w[:10] + passage + w[10:]
        rows.append((i, " ".join(w), y, 99.0, "p"))
    for i in range(120, 150):  # copies with one word of many changed
        w = rows[i - 60][1].split()
        w[r.randrange(len(w))] = "kolox"
        rows.append((i, " ".join(w), None, 99.0, "q"))
    rows += [(150, None, "aa", 1.0, None), (151, "12 34", None, 1.0, None), (152, "", "bb", 1.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.language(spark, df.withColumn("n_chars", F.length("text").cast("long")), "")
    after = sorted(map(tuple, kept.collect()), key=lambda x: x[0])
    model = langid.fit_rows(*(found := langid.sample_rows(df.select("doc_id", "text", "lang"))))
    bar = langid.least_near(*found)
    told = dict(zip([x[0] for x in rows], zip(*model.predict([x[1] for x in rows]))))
    assert [x[:5] for x in after] == [x for x in rows if told[x[0]][0] != "und" and told[x[0]][1] >= 0.5 and told[x[0]][2] >= bar]
    root = reachable(len(after), lambda a, b: similarity_of(after[a][1], after[b][1]) >= 0.8)
    firsts = [x for k, x in enumerate(after) if root[k] == k]
    assert len(firsts) < len(after)
    near = corpus_pipeline.near_copies(spark, spark.createDataFrame(after, kept.schema), "")
    assert sorted(x["doc_id"] for x in near.collect()) == [x[0] for x in firsts]
    texts = [(x[0], x[1].encode()) for x in firsts]
    want = {i: bytes(np.frombuffer(x, np.uint8)[~g]).decode() for (i, x), g in zip(texts, brute_covered(texts, True, suffixes.MATCH))}
    cut = corpus_pipeline.passages(spark, spark.createDataFrame(firsts, kept.schema), "").collect()
    assert {x["doc_id"]: x["text"] for x in cut} == want and {x["doc_id"]: x["n_chars"] for x in cut} == {i: len(t) for i, t in want.items()}
    assert sum(map(len, want.values())) < sum(len(x) for _, x in texts)
    df.withColumn("n_chars", F.length("text").cast("long")).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    got = defaultdict(dict)
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[x["doc_id"]][x["start"]] = np.frombuffer(x["ids"], "<u4").tolist()
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in got.items()} == {i: [*library_ids(WORD, t), 1] for i, t in want.items()}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_least_count_is_the_nth_largest(spark):
    counts = [1, 1, 2, 3, 3, 3, 8, 90, 700, 700, 5000]
    df = spark.createDataFrame([(n,) for n in counts], "n long")
    ordered = sorted(counts, reverse=True)
    for n in range(1, len(counts) + 1):
        assert stupid_backoff.least_count(df, n, sum(counts), ways=4) == ordered[n - 1]
    assert stupid_backoff.least_count(df, 99, sum(counts)) == 1
    assert stupid_backoff.least_count(df.limit(0), 1, 0) == 1


def brute_shingles(text, size=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similarity_of(a, b):
    x, y = brute_shingles(a), brute_shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def near_texts(r, n, words=120):
    """``n`` pairs of a text and a copy with some words in a row replaced, of similarities from 0.7 to 1."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    out = []
    for _ in range(n):
        base = [word() for _ in range(r.randint(words // 2, 2 * words))]
        copy, cut = list(base), r.randint(0, len(base) // 5)
        at = r.randrange(len(base) - cut)
        copy[at : at + cut] = [word() for _ in range(cut)]
        out.append((" ".join(base), " ".join(copy)))
    return out


def test_near_copies_are_those_of_the_similarity(spark):
    """No pair below 0.8 links; of the pairs at 0.8 or more at least 0.95 do, and of those up to 0.85 as well."""
    pairs = near_texts(random.Random(14), 700)
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    root = {g["doc_id"]: g["root"] for g in simhash.wide_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = {k: similarity_of(*p) for k, p in enumerate(pairs)}
    linked = {k for k in of if root[2 * k] == root[2 * k + 1]}
    assert all(of[k] >= 0.8 for k in linked)
    for most in (1.1, 0.85):
        meant = [k for k in of if 0.8 <= of[k] < most]
        assert len(meant) > 80 and len(linked & set(meant)) >= 0.95 * len(meant)


def test_short_texts_link_by_their_shingles(spark):
    rows = [(0, "a b c d e f g h i j"), (1, "a b c d e f g h i x"), (2, "A b c d e f g h i j"), (3, ""), (4, None), (5, " "), (6, "a b"), (7, "a  b"), (8, "b a")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(k["doc_id"] for k in kept) == [0, 1, 3, 6, 8]


def test_long_texts_are_compared_share_by_share(spark):
    pairs = near_texts(random.Random(18), 120)
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    texts = spark.createDataFrame(rows, "rep long, text string")
    sized = spark.createDataFrame([(2 * k, 2 * k + 1, *(len(brute_shingles(t)) for t in p)) for k, p in enumerate(pairs)], "u long, v long, nu long, nv long")
    got = {x["u"] // 2 for x in simhash.similar(sized, texts, 5, 0.8, share=16).collect()}
    want = {k for k, p in enumerate(pairs) if similarity_of(*p) >= 0.8}
    assert got == want and 20 < len(want) < 110


def test_a_crowd_of_near_copies_is_one_group(spark, monkeypatch):
    """300 copies of one text with a few words changed, in groups of which a task compares 16: all links are found."""
    monkeypatch.setattr(simhash, "GROUP", 16)
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [(1000 + k, " ".join(word() for _ in range(100))) for k in range(40)]
    for k in range(300):
        copy = list(base)
        for _ in range(r.randint(1, 2)):
            copy[r.randrange(150)] = word()
        rows.append((k, " ".join(copy)))
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(k["doc_id"] for k in kept) == [0, *range(1000, 1040)]


def test_columns_named_as_the_keys_stay(spark):
    rows = [(0, "one two", 5, "m", 1.5, "x"), (1, "one two", 6, "n", 2.5, "y"), (2, "three", 7, "o", 3.5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, mark string, score double, lang_pred string")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(tuple(k) for k in kept.collect()) == [rows[0], rows[2]]


def test_candidate_pairs_of_groups_connect_all_near_rows():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, (20, simhash.WORDS), dtype=np.uint64)[rng.integers(0, 20, 400)]
    for row in fps:
        for bit in rng.integers(0, 64 * simhash.WORDS, rng.integers(0, 40)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    group = np.sort(np.concatenate([rng.integers(0, 40, 200), rng.integers(40, 43, 200)]))

    def roots(edges):
        of = list(range(len(fps)))
        for a, b in edges:
            a, b = of[a], of[b]
            of = [min(a, b) if r in (a, b) else r for r in of]
        return of

    for bits in (20, 42):
        near = [(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= bits]
        found = simhash.group_pairs(group, fps, bits).tolist()
        assert len(near) > 50 and set(map(tuple, map(sorted, found))) <= set(near)
        assert roots(found) == roots(near)


def test_pairs_of_large_groups_link_though_others_are_nearer(spark, monkeypatch):
    """Pairs of one base, of similarity 0.8 or more, in one group with hundreds below 0.8 whose fingerprints may be nearer: a forest alone leaves pairs out."""
    monkeypatch.setattr(simhash, "bands_for", lambda nodes, similarity: np.zeros((1, 0), int))
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for k in range(150):
        own, *places = (5 + 6 * p for p in r.sample(range(31), 5))
        shared = word()
        for j in range(2):
            text = list(base)
            text[own] = shared
            for p in places[2 * j : 2 * j + 2]:
                text[p] = word()
            rows.append((2 * k + j, " ".join(text)))
    of = {k: similarity_of(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(150)}
    root = {g["doc_id"]: g["root"] for g in simhash.wide_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    meant = [k for k in of if of[k] >= 0.8]
    linked = [k for k in meant if root[2 * k] == root[2 * k + 1]]
    assert len(meant) == 150 and len(linked) >= 147, len(linked)


def test_counts_of_common_hashes_and_the_forest_of_roots():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64)) for _ in range(70)] + [np.arange(10_000, 10_050, dtype=np.uint64)]
    got = simhash.shared_counts(sets)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    like, root = got >= 25, rng.integers(0, 40, len(sets))
    edges, of = simhash.joining(like, root), {int(r): int(r) for r in root}
    for a, b in np.argwhere(like).tolist():
        a, b = of[root[a]], of[root[b]]
        of = {r: min(a, b) if x in (a, b) else x for r, x in of.items()}
    found = {int(r): int(r) for r in root}
    for a, b in edges:
        assert like[a, b] and root[a] != root[b]
        a, b = found[root[a]], found[root[b]]
        assert a != b
        found = {r: min(a, b) if x in (a, b) else x for r, x in found.items()}
    assert found == of and len(edges) > 3


@pytest.mark.parametrize("parts", [False, True])
def test_near_copies_below_the_similarity_cost_no_row_a_pair(spark, monkeypatch, parts):
    """400 copies of one text of which most pairs are near, but below 0.8: rows follow the copies, not their pairs, and every link is found."""
    monkeypatch.setattr(simhash, "bands_for", lambda nodes, similarity: np.zeros((1, 0), int))
    if parts:
        monkeypatch.setattr(simhash, "GROUP", 64)
        monkeypatch.setattr(simhash, "SHARE", 16, raising=False)
    made, plain = {}, simhash.written

    def counted(df, what):
        out = plain(df, what)
        made[what] = max(out[0].count(), made.get(what, 0))
        return out

    monkeypatch.setattr(simhash, "written", counted)
    r = random.Random(22)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for k in range(400):
        copy = list(texts[r.randrange(k)].split() if k % 3 == 2 else base)
        for _ in range(2 if k % 3 == 2 else r.randint(3, 5)):
            copy[r.randrange(150)] = word()
        texts.append(" ".join(copy))
    sets, of = [brute_shingles(t) for t in texts], list(range(400))
    for i in range(400):
        for j in range(i):
            if of[i] != of[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    root = {g["doc_id"]: g["root"] for g in simhash.wide_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first: dict = {}
    assert [first.setdefault(root[k], k) for k in range(400)] == [min(j for j in range(400) if of[j] == of[k]) for k in range(400)]
    assert 100 < len(set(of)) < 350
    grown = {what: n for what, n in made.items() if what not in ("shingles", "dealt")}
    assert max(grown.values()) <= 8 * 400 and made.get("dealt", 0) <= 400 * (2 * 400 // simhash.GROUP + 1), made
