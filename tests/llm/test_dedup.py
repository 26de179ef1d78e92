"""Exact, substring, suffix and shingle deduplication against brute force, with the defined odd cases."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from changelens.llm import components, exact_dedup, ngram_jaccard, repeats, seq, substring_dedup, suffix_dedup
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "doc_id long, text string, source string, n int, digest string, kept string"


def corpus(seed=1, n=160):
    """Texts with shared passages, copies, near copies, repeats inside, odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    texts = [None, "", " \n\t ", "a", "A", "one two", "ONE two", "x " * 300, "Ж" * 400, " ".join(passage)]
    for _ in range(n):
        kind = rng.randrange(6)
        w = [word() for _ in range(rng.randrange(1, 120))]
        if kind == 0:
            k = rng.randrange(0, 20)
            w = w[: len(w) // 2] + passage[k : k + rng.randrange(30, 45)] + w[len(w) // 2 :]
        elif kind == 1:
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = word()
        elif kind == 2 and texts[-1]:
            w = [texts[-1].upper() if rng.random() < 0.5 else texts[-1]]
        elif kind == 3:
            w = w + w
        texts.append(rng.choice((" ", "\n", "  ")).join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, "clash", None) for i, t in rows], SCHEMA).repartition(5)


def brute_exact(rows):
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return {i: (max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows}


def brute_words(rows, w=35):
    words = {i: (t or "").encode().split() for i, t in rows}
    seen = collections.Counter(tuple(v[k : k + w]) for v in words.values() for k in range(len(v) - w + 1))
    out = {}
    for i, v in words.items():
        gone = [False] * len(v)
        for k in range(len(v) - w + 1):
            if seen[tuple(v[k : k + w])] > 1:
                gone[k : k + w] = [True] * w
        kept = [x for x, g in zip(v, gone) if not g]
        out[i] = (len(v), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_bytes(rows, w=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if b[k : k + w] in seen:
                gone[k : k + w] = b"\1" * w
            seen.add(b[k : k + w])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = tuple((t or "").encode().translate(seq.LOWER).split())
        sets[i] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_exact(spark):
    rows = corpus()
    assert got(exact_dedup.groups(frame(spark, rows))) == brute_exact(rows)
    kept = exact_dedup.deduplicate(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in brute_exact(rows).items() if v[2]) and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_exact_ties_and_null_ids(spark):
    rows = [(5, "a"), (5, "A"), (None, "a"), (None, "z"), (None, "z"), (7, "q"), (7, "r")]
    out = exact_dedup.groups(frame(spark, rows)).collect()
    assert sum(r.kept for r in out) == 4 and {(r.keep_id, r.group_size) for r in out if r.doc_id == 5} == {(5, 3)}
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text.lower()) for r in exact_dedup.deduplicate(frame(spark, rows)).collect())
    assert kept == [(False, 5, "a"), (False, 7, "q"), (False, 7, "r"), (True, 0, "z")]


@given(st.binary(max_size=3000), st.integers(1, 40))
@settings(deadline=None, max_examples=50)
def test_chunks_give_the_text_back(b, k):
    assert b"".join(exact_dedup.cut(b * k)) == b * k


@pytest.mark.parametrize("hot,limit", [(2, 1 << 20), (2, 0), (5, 1 << 20), (4096, 1 << 20)])
def test_substrings(spark, monkeypatch, hot, limit):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "HOT_LIMIT", limit)
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", 400)
    monkeypatch.setattr(substring_dedup, "SHARD_CELLS", 20)
    rows = corpus(2)
    assert got(substring_dedup.deduplicate(frame(spark, rows))) == brute_words(rows)


@pytest.mark.parametrize("hot", [2, 5, 4096])
def test_suffixes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(3)
    assert got(suffix_dedup.deduplicate(frame(spark, rows))) == brute_bytes(rows)


def test_substrings_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (1, t), (None, "b " + t), (3, None)]
    out = sorted(substring_dedup.deduplicate(frame(spark, rows)).collect(), key=str)
    assert [(r.doc_id, r.n_words, r.n_removed) for r in out] == [(1, 40, 40), (1, 40, 40), (3, 0, 0), (None, 41, 40)]
    out = sorted(suffix_dedup.deduplicate(frame(spark, rows)).collect(), key=str)
    assert [(r.doc_id, r.n_removed) for r in out] == [(1, 0), (1, 0), (3, 0), (None, len(t))]


def common_prefix(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters,depth", [(1, 20), (2, 40), (2, 12), (3, 9), (200, 8)])
def test_longest_previous_factors_by_brute_force(letters, depth):
    rng = np.random.default_rng(letters + depth)
    buf = rng.integers(0, letters, 300).astype(np.uint8)
    at = rng.permutation(300 - depth)[:200]
    part = [buf[i : i + depth].tobytes() for i in at]
    order, lcp = suffix_dedup.suffix_order(buf, at, depth)
    assert order.tolist() == sorted(range(200), key=lambda i: (part[i], i))
    assert lcp.tolist() == [0] + [common_prefix(part[a], part[b]) for a, b in zip(order, order[1:])]
    want = [max([common_prefix(part[i], part[j]) for j in range(i)], default=0) for i in range(200)]
    assert suffix_dedup.longest_previous_factor(order, lcp).tolist() == want


def in_process(rows, monkeypatch, shards=3, **values):
    """The steps of ``substring_dedup`` in this process, where ``values`` hold for its constants."""
    for name, value in values.items():
        monkeypatch.setattr(repeats if hasattr(repeats, name) else substring_dedup, name, value)

    class Box:
        def __init__(self, value):
            self.value = value

    src = [(repeats.NO_ID if i is None else i, hash(t) % 10**9, t) for i, t in rows]
    everything = Box(np.full(64, ~np.uint64(0)))
    hot = Box(np.zeros(0, np.uint64))
    parts = [src[k::3] for k in range(3)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.string())], names=["doc", "th", "text"])
    sent = [b for part in parts for b in repeats._cells(substring_dedup.SPEC, everything, hot, substring_dedup.sender)(iter([batch(part)]))]
    table = pa.Table.from_batches(sent, repeats.CELL).sort_by("key")
    found = pa.Table.from_batches(list(substring_dedup._confirm(shards)(table.to_batches(50))), substring_dedup.FOUND).to_pylist()
    docs = [{"shard": int(substring_dedup.shard_of(np.array([d]), np.array([th]), shards)[0]), "kind": 0, "doc_id": d, "body": (t or "").encode()} for d, th, t in src]
    got = {(r["shard"], r["phrase"]) for r in found if r["kind"] == substring_dedup.PHRASE}
    rows = sorted(docs + [{"shard": s, "kind": 1, "doc_id": None, "body": p} for s, p in got], key=lambda r: (r["shard"], r["kind"]))
    out = pa.Table.from_batches(list(substring_dedup._locate([], substring_dedup.result, substring_dedup.OUT)(iter(pa.Table.from_pylist(rows, substring_dedup.ROW).to_batches(7)))), substring_dedup.OUT)
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.to_pylist()}, found


def test_substrings_in_small_pieces(monkeypatch):
    rows = corpus(6)
    out, found = in_process(rows, monkeypatch, CHUNK=16, BLOCK=300, LETTERS=100, MEMORY=10)
    assert out == brute_words(rows)
    assert {r["th"] for r in found if r["kind"] == substring_dedup.HOLDER} == {hash(t) % 10**9 for i, t in rows if brute_words(rows)[i][1]}


def test_automata_give_the_result(monkeypatch):
    """Confirmed phrases bring no places: without the automata's hits nothing is removed."""
    rows = corpus(6)
    monkeypatch.setattr(substring_dedup.Automaton, "hits", lambda self, words: iter(()))
    out, _ = in_process(rows, monkeypatch)
    assert {v[1] for v in out.values()} == {0} < {v[1] for v in brute_words(rows).values()}


def test_phrases_of_very_many_words():
    rng = np.random.default_rng(3)
    words = [b"%d" % x for x in rng.integers(0, 10**9, 1_200_000)]
    some = [b" ".join(words[k : k + 60]) for k in range(0, len(words), 60)]
    found = list(substring_dedup.automata(some))
    assert len(found) == 4 and sum(len(list(a.hits(words))) for a in found) >= len(some)


@given(st.lists(st.integers(0, 6), min_size=1, max_size=80), st.integers(1, 12))
@settings(deadline=None)
def test_winnow_picks_the_leftmost_least(values, w):
    g = np.array(values, np.uint64)
    want = {}
    for i in range(len(g) - w + 1):
        p = min(range(i, i + w), key=lambda j: (g[j], j))
        want.setdefault(p, [i, i])[1] = i
    p, lo, hi = seq.winnow(g, w)
    assert [(a, b, c) for a, b, c in zip(p, lo, hi)] == [(k, *v) for k, v in sorted(want.items())]


@pytest.mark.parametrize("small,block,across", [(4, 1024, 4096), (2, 3, 3)])
def test_jaccard_components(spark, monkeypatch, small, block, across):
    for name, value in (("SMALL", small), ("BLOCK", block), ("ACROSS", across)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    rows = corpus(4)
    want = brute_components(rows)
    assert got(ngram_jaccard.classes(frame(spark, rows))) == want
    assert len({v[1] for v in want.values()}) < len(want)


def test_jaccard_between_blocks(spark, monkeypatch):
    """Clusters that fall into several components, large and small, of several blocks each."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    monkeypatch.setattr(ngram_jaccard, "CENTERS", 1)
    monkeypatch.setattr(ngram_jaccard, "_similar", lambda batches: (b.select(["a", "b"]) for b in batches))
    rng, rows = random.Random(31), []
    base = [f"w{i}" for i in range(120)]
    for family in range(4):
        for k in range(14):
            w = list(base[: 90 + family * 4])
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
            rows.append((family * 100 + k, " ".join(w)))
    rows += [(1000 + k, " ".join(base[k : k + 60])) for k in range(20)]
    want = brute_components(rows)
    assert got(ngram_jaccard.classes(frame(spark, rows))) == want and 3 < len({v[1] for v in want.values()}) < 60


@pytest.mark.parametrize("held", [4, 1 << 19])
def test_components_by_brute_force(spark, monkeypatch, held):
    rng, edges = random.Random(32), [(i, i + 1) for i in range(100, 160)]
    edges += [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(7, 7), (900, 900)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert set(out) == {x for a, b in edges if a != b for x in (a, b)}
    assert all((out[x] == out[y]) == (root[x] == root[y]) for x in out for y in out)
    none = spark.createDataFrame([], "a long, b long")
    assert components.components(none).count() == 0


def test_jaccard_links_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.choice(1000, 60, replace=False)
        sets = []
        for _ in range(12):
            s = base.copy()
            s[: rng.integers(0, 14)] = rng.integers(1000, 3000)
            sets.append(np.unique(np.concatenate([s, rng.integers(3000, 3010, rng.integers(0, 5))])).astype(np.uint64))
        label = ngram_jaccard.links(sets)
        root = list(range(12))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(12):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[max(find(i), find(j))] = min(find(i), find(j))
        assert {(i, j) for i in range(12) for j in range(12) if label[i] == label[j]} == {(i, j) for i in range(12) for j in range(12) if find(i) == find(j)}


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id = 2")
    for f in (exact_dedup.groups, substring_dedup.deduplicate, suffix_dedup.deduplicate, ngram_jaccard.classes, exact_dedup.deduplicate, ngram_jaccard.deduplicate):
        assert f(none).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (3, "9" * 1_000_000)]
    assert got(exact_dedup.groups(frame(spark, rows))) == brute_exact(rows)
    assert {k: v[:2] for k, v in got(substring_dedup.deduplicate(frame(spark, rows))).items()} == {1: (300_000, 300_000), 2: (300_001, 300_000), 3: (1, 0)}
    assert {k: v[1] for k, v in got(suffix_dedup.deduplicate(frame(spark, rows))).items()} == {1: 0, 2: len(long), 3: 999_900 + 99}
    assert got(ngram_jaccard.classes(frame(spark, rows))) == {1: (299_996, 1), 2: (299_997, 1), 3: (1, 3)}
