"""Classifiers, personal data, decontamination, mixing, token counts and the pipeline."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from changelens.llm import charvec, decontaminate, language_id, mixing, pii, quality_knn, token_count

from .test_dedup import SCHEMA, frame

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def labelled(spark, n=240):
    rng, rows = random.Random(1), []
    for i in range(n):
        lang = "xy"[i % 2]
        rows.append((i, words(rng, "abcde" if lang == "x" else "vwxyz", rng.randrange(3, 40)), lang))
    rows += [(1000, None, "x"), (1001, "", "y"), (1002, "12 !!", "x"), (1003, "é" * 200_000, None), (None, "abc bad cab", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language(spark):
    docs = labelled(spark)
    model = language_id.fit(language_id.learnable(docs))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(got) == 245 and [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0.0
    assert all(got[i].lang_pred == "xy"[i % 2] and 0.5 < got[i].score <= 1 for i in range(240)) and got[None].lang_pred == "x"
    kept = language_id.keep(docs, model)
    assert {r.doc_id for r in kept.collect()} >= set(range(240)) and kept.where("doc_id in (1000, 1001, 1002)").count() == 0
    none = language_id.fit(language_id.learnable(docs.where("doc_id = 1000 and lang = 'y'")))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_ftrl_learns_sparse_weights_and_temperature():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(600):
        y = int(rng.integers(0, 3))
        k = np.unique(np.concatenate([[y], rng.integers(3, 50, 5)]))
        rows.append((k, np.ones(len(k)) / np.sqrt(len(k)), y))
    w = language_id.ftrl(rows, 60, 3)
    assert all((x @ w[k]).argmax() == y for k, x, y in rows[-100:]) and (w[50:] == 0).all()
    z = rng.normal(size=(2000, 3)) * 3
    y = np.array([rng.choice(3, p=language_id.softmax(s / 4)) for s in z])
    assert 3 < language_id.temperature(z, y) < 5.5


def test_quality(spark):
    rng = random.Random(4)
    good = [(i, words(rng, "abcdeé", rng.randrange(5, 60)).capitalize() + ".") for i in range(200)]
    bad = [(500 + i, " ".join(w.upper() + "!!" for w in words(rng, "abcde", rng.randrange(5, 60)).split())) for i in range(100)]
    again = [(800 + i, " ".join([words(rng, "abcde", 1)] * rng.randrange(20, 60))) for i in range(60)]
    docs = spark.createDataFrame(good + bad + again + [(2000, None), (2001, ""), (None, "abc")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad + again], "doc_id long, quality int")
    model = quality_knn.fit(quality_knn.labelled(docs, labels), docs)
    got = {r.doc_id: r for r in quality_knn.score(docs, model).collect()}
    right = sum(got[i].predicted == 1 for i, _ in good) + sum(got[i].predicted == 0 for i, _ in bad + again)
    assert right >= 0.97 * 360 and all(0 <= r.score <= 1 for r in got.values()) and got[2000].score == got[2001].score == pytest.approx(model["prior"])
    assert {r.score for r in quality_knn.score(docs, quality_knn.fit(quality_knn.labelled(docs, labels.where("quality = 3")), docs)).collect()} == {0.5}


def test_vote_by_brute_force():
    rng = np.random.default_rng(5)
    known, q = quality_knn.unit(rng.normal(size=(80, 6))), quality_knn.unit(rng.normal(size=(9, 6)))
    y = rng.integers(0, 2, 80).astype(np.float32)
    for row, s in zip(q, quality_knn.vote(q, {"known": known, "y": y})):
        cos = sorted(((float(row @ k), v) for k, v in zip(known, y)), reverse=True)[: quality_knn.NEIGHBOURS]
        w = [max(c, 0) ** 4 + 1e-9 for c, _ in cos]
        assert s == pytest.approx(sum(a * v for a, (_, v) in zip(w, cos)) / sum(w), abs=1e-6)


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = ("abc déf 12 " * 50).encode()
    want = charvec.counts(charvec.letter_codes(text), (1, 2, 3), 10)
    monkeypatch.setattr(charvec, "BLOCK", 7)
    assert (charvec.counts(charvec.letter_codes(text), (1, 2, 3), 10) == want).all()
    n = len(text.decode())
    assert want.sum() == n + n - 1 + n - 2


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def listed(spans):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


def test_base_spans(spark):
    rng = random.Random(6)
    parts = ["1", "2", "45", "255", "256", "0", "00012", ".", ".", "@", "a", "b-", "é", "+", "+1", "(", "555", ")", " ", "-", "4111 1111 1111 1111", "4111111111111111", "x@y.co", "1.2.3.4", "%", "_", "\n", "😀"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "9" * 50_000), (5003, "1 " * 20_000), (5004, "a." * 20_000 + "@" + "b." * 20_000), (5005, "x@y.co " * 300)]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    for i, t in rows:
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), t[:200]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        assert set(listed(want).split(",")) <= set(got[i].spans.split(","))


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(7)
    rows = [(i, f"{words(rng, 'abc', 4)} call me: +1 (555) 555-{1000 + i} {words(rng, 'abc', 3)}") for i in range(30)]
    rows += [(100, "now call me: 555-867-5309 ok"), (101, "other words 555-867-5301 ok"), (102, "then call me: tomorrow9 ok")]
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    assert got[100] == "phone:13:25" and got[101] == "" and got[102] == "" and got[0].startswith("phone:")
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert out[100] == "now call me: [phone] ok" and out[101] == rows[31][1]


def test_contexts_are_taken_from_the_text(spark):
    long = "x" * 60
    rows = [(i, f"No. 5 +1 (555) 555-{1000 + i}") for i in range(10)] + [(100, "No. 5 555-867-5309")]
    rows += [(200 + i, f"ring {long} +1 (555) 555-{2000 + i}") for i in range(10)] + [(300, f"ring {long} 555-867-5308")]
    rows += [(400 + i, f"Fon: +1 (555) 555-{3000 + i}") for i in range(10)] + [(500, "Fon: 555-867-5307"), (501, "a Fon: 555-867-5306")]
    rows += [(600 + i, f"+1 (555) 555-{4000 + i} ok") for i in range(10)] + [(700, "555-867-5305 ok")]
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    assert [got[i] for i in (100, 300, 500, 501, 700)] == ["phone:6:18", "phone:66:78", "phone:5:17", "", "phone:0:12"]


def test_pii_scores_by_hand(spark):
    edges = [("<l", f"s{i}", 0, 1) for i in range(5)] + [("<l", "c", None, 1), ("<m", "c", None, 3)]
    patterns, instances = pii.scored(spark.createDataFrame(edges, "left string, value string, kind int, n long"))
    s, c = 5 / 6, 5 / 24
    for _ in range(pii.ROUNDS - 1):
        s = (5 + c) / 6
        c = s / 4
    assert patterns.first().score == pytest.approx(s) and instances.first().score == pytest.approx(c)


def test_found_identifiers_induce_patterns(spark):
    """Identifiers found by a seeds' pattern support a pattern without seeds, which finds others; none else do."""
    rng = random.Random(17)
    word = lambda: words(rng, "abc", 1)
    rows = [(i, f"{word()} dial now +1 (555) 555-{1000 + i} {word()} {word()}") for i in range(30)]
    rows += [(100 + i, f"{word()} dial now 555-867-{5300 + i} or text {word()}") for i in range(8)]  # found by the left pattern
    rows += [(200 + i, f"{word()} {word()} 555-867-{6300 + i} or text {word()}") for i in range(3)]  # by the right one it induces
    rows += [(300 + i, f"{word()} {word()} 555-867-{7300 + i} {word()} {word()}") for i in range(3)]
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    assert all(got[i].startswith("phone:") for i, _ in rows if i < 300) and [got[300 + i] for i in range(3)] == [""] * 3


def test_pii_odd_rows(spark):
    rows = [(None, "a@b.co"), (None, None), (7, "x 1.2.3.4"), (7, "x 1.2.3.4"), (7, "no")]
    out = sorted(pii.find(frame(spark, rows)).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in out) == [(0, 0, 0, ""), (0, 1, 0, "email:0:6"), (7, 0, 0, ""), (7, 0, 1, "ip:2:9"), (7, 0, 1, "ip:2:9")]
    assert sorted(str(r.text) for r in pii.redact(frame(spark, rows)).collect()) == ["None", "[email]", "no", "x [ip]", "x [ip]"]
    assert pii.find(frame(spark, rows).where("doc_id = -1")).count() == pii.redact(frame(spark, rows).where("doc_id = -1")).count() == 0


def test_pii_is_native(spark):
    text = pii.find(frame(spark, [(1, "a@b.co")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def brute_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        score, start, end = decontaminate.align(a, b)
        assert score == brute_align(a, b)
        if score:
            assert brute_align(a, b[start:end]) == score


def test_decontaminate(spark):
    rng = random.Random(9)
    items = [(k, words(rng, "abcdefgh", 40)) for k in range(12)] + [(50, "zq xq"), (51, ""), (52, None)]
    clean = [(1000 + k, words(rng, "abcdefgh", 200)) for k in range(60)]
    dirty = []
    for k in range(12):
        w = items[k][1].split()
        w[5], w[20] = "CHANGED", "edited,"
        del w[30]
        dirty.append((k, words(rng, "abcdefgh", 50) + " " + " ".join(w).upper() + ". " + words(rng, "abcdefgh", 50)))
    docs = frame(spark, [*clean, *dirty, (5000, None), (5001, ""), (5002, "so zq xq it")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(k, k) for k in range(12)} | {(5002, 50)} and all(0.7 < r.score <= 1 for r in got.values())
    assert {r.doc_id for r in decontaminate.remove(docs, bench).collect()} == {i for i, _ in clean} | {5000, 5001}
    assert decontaminate.matches(docs, bench.where("item_id = 52")).count() == 0 and decontaminate.matches(docs.where("doc_id = -1"), bench).count() == 0


def test_decontaminate_finds_an_edited_passage_in_many_documents(spark):
    rng = random.Random(21)
    item = words(rng, "abcde", 40).split()
    edited = " ".join([*item[:20], "zzz", *item[21:]])
    leaked = [(i, f"{words(rng, 'vwxyz', 30)} {edited} {words(rng, 'vwxyz', 30)}") for i in range(30)]
    clean = [(1000 + i, words(rng, "vwxyz", 60)) for i in range(30)]
    docs = frame(spark, leaked + clean)
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(i, 30, 70) for i in range(30)}
    assert {r.score for r in got} == {(2 * 39 - 1) / 80}
    assert {r.doc_id for r in decontaminate.remove(docs, bench).collect()} == {i for i, _ in clean}


def test_recall_against_exhaustive_alignment(spark):
    """Hundreds of copies, lightly to heavily edited, each aligned in full with every item."""
    rng, texts = random.Random(41), []
    vocabulary = words(rng, "abcdefghij", 400).split()
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(rng.randrange(8, 45)) for _ in range(20)]
    for k in range(400):
        w, rate = [], rng.choice([0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3])
        for x in items[k % 20]:
            r = rng.random()
            w += [x] if r > rate else [] if r < rate / 3 else [rng.choice(vocabulary)] if r < 2 * rate / 3 else [x, rng.choice(vocabulary)]
        texts.append(some(rng.randrange(30)) + w + some(rng.randrange(30)))
    texts += [some(60) for _ in range(40)]
    hashed = lambda w: decontaminate.normalised([" ".join(w).encode()]).hash
    named = [hashed(w) for w in items]
    want = {}
    for i, w in enumerate(texts):
        for k, a in enumerate(named):
            score = decontaminate.align(a, hashed(w))[0] / (decontaminate.MATCH * len(a))
            if score >= decontaminate.THRESHOLD:
                want[i, k] = score
    docs = frame(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()}
    print(f"exhaustive {len(want)}, found {len(got)}")
    assert len(want) > 300 and set(got) <= set(want) and len(got) >= 0.97 * len(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_decontaminate_odd_rows(spark):
    rng = random.Random(42)
    item = words(rng, "abcde", 30)
    long = f"{words(rng, 'vwxyz', 60_000)} {item} {words(rng, 'vwxyz', 10)} {item}"
    docs = frame(spark, [(1, long), (2, item), (2, item), (None, item), (3, "v w")])
    bench = spark.createDataFrame([(0, item), (0, item), (None, item), (7, "")], "item_id long, text string")
    got = decontaminate.matches(docs, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id is None) for r in got) == [(n, d, k) for n, d in [(False, 1), (False, 2), (True, 0)] for k in (False, True)]
    assert {r.score for r in got} == {1.0} and [r.doc_id for r in decontaminate.remove(docs, bench).collect()] == [3]


def test_promising_stretches_hold_every_sufficient_alignment():
    rng, met = random.Random(22), 0
    for _ in range(300):
        a = np.array([rng.randrange(8) for _ in range(rng.randrange(1, 12))])
        b = np.array([rng.randrange(40) for _ in range(rng.randrange(1, 60))])
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(b))
            b = np.concatenate([b[:at], [x for x in a if rng.random() < 0.8], b[at:]]).astype(int)
        own = np.where(np.isin(b, a), decontaminate.MATCH, -1)
        part = max([decontaminate.align(a, b[u:v])[0] for u, v in decontaminate.promising(own, len(a))], default=0)
        whole = decontaminate.align(a, b)[0]
        if whole / (decontaminate.MATCH * len(a)) >= decontaminate.THRESHOLD:
            met += 1
            assert part == whole
    assert met > 50


def test_removal_goes_by_row_where_ids_repeat_or_are_null(spark):
    from changelens.llm import ngram_jaccard

    rng = random.Random(23)
    near, other, item, lone = (words(rng, "abcde", 60) for _ in range(4))
    leak = words(rng, "vwxyz", 20) + " " + item
    docs = frame(spark, [(1, other), (1, leak), (2, "clean"), (None, leak), (None, lone), (None, None)]).repartition(3)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontaminate.remove(docs, bench).collect()), key=repr)
    assert got == sorted([(1, other), (2, "clean"), (None, lone), (None, None)], key=repr)
    # 3 has an unrelated text beside a near copy of 2's; 4 ties with itself twice; the null ids are near copies of lone
    rows = [(2, near), (3, near + " end"), (3, other), (4, item), (4, item + " end"), (4, item), (None, lone), (None, lone + " end"), (None, None), (None, ""), (5, leak), (5, leak), (6, " "), (6, " ")]
    left = [(r.doc_id, r.text) for r in ngram_jaccard.deduplicate(frame(spark, rows).repartition(3)).collect()]
    assert sorted((i, t) for i, t in left if i in (2, 3, 6)) == [(2, near), (3, other), (6, " "), (6, " ")]
    assert [t in (item, item + " end") for i, t in left if i == 4] == [True] and left.count((5, leak)) == 1
    assert [t in (lone, lone + " end") for i, t in left if i is None and t] == [True] and left.count((None, None)) == left.count((None, "")) == 1


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, words(rng, "ab", rng.randrange(0, 300)), rng.choice(["a", "b", "c", "d", None]) if i % 3 else "a") for i in range(600)]
    rows += [(9000, None, "only"), (9001, "", "b"), (9002, "x y", None), (None, "x y z", "a"), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs.repartition(7)).collect()
    assert len(out) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute_targets(size)
    for s in size:
        own = [r for r in out if r.source == s]
        assert own[0].source_size == size[s] and own[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in own) == pytest.approx(want[s], rel=0.03, abs=2 * mixing.BLOCK)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(docs.where("doc_id = -1")).count() == 0


def test_mixed_blocks_are_disjoint_and_agree(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, words(rng, "abc", rng.randrange(1, 200)), "st"[i % 2]) for i in range(80)], "doc_id long, text string, source string")
    drawn = [tuple(r) for r in mixing.mixed_blocks(docs).select("doc_id", "pass", "block").collect()]
    assert len(drawn) == len(set(drawn))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = {}
    for r in mixing.mixed_texts(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}


def test_split_keeps_quota_and_capacity():
    for seed in range(50):
        counts = [0, 5, 100, 3, 0, 17, 1]
        out = mixing.split(counts, 60, seed, "s")
        assert sum(out) == 60 and all(0 <= q <= c for q, c in zip(out, counts))
    mean = np.mean([mixing.split([100, 300], 80, s, "x") for s in range(400)], axis=0)
    assert abs(mean[0] - 20) < 1


@pytest.mark.parametrize("good,bad,n", [(5, 9, 6), (3, 2, 4), (40, 60, 30), (1, 1000, 900), (7, 7, 0), (6, 0, 3), (0, 6, 3), (900, 1000, 1500)])
def test_large_draws_are_hypergeometric(good, bad, n):
    rng = np.random.default_rng(good * bad + n)
    got = np.array([mixing.inversion(rng, good, bad, n, part=7) if n else 0 for _ in range(4000)])
    low, high = max(0, n - bad), min(n, good)
    assert got.min() >= low and got.max() <= high
    chance = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(low, high + 1)])
    seen = np.bincount(got - low, minlength=len(chance))
    assert (np.abs(seen - 4000 * chance) < 5 * np.sqrt(4000 * chance * (1 - chance)) + 3).all()


def test_draws_beyond_the_library_bound():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**11, 7 * 10**11, 4 * 10**11
    got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(12)], float)
    sd = (n * 0.3 * 0.7 * (good + bad - n) / (good + bad)) ** 0.5
    assert (np.abs(got - n * 0.3) < 5 * sd).all() and len(set(got)) == 12 and got.std() > sd / 4


def test_quotas_go_through_groups_of_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, words(rng, "abc", rng.randrange(1, 200)), "stu"[i % 3]) for i in range(400)], "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    for s in "stu":
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.03, abs=64) and all(r.taken <= 2 * r.size for r in own)


def crc(i):
    return zlib.crc32(str(i).encode()) % 3


@pytest.fixture
def learnable(spark, tmp_path):
    """Tables whose held-out rows can be told wrong things about, and a run of a query over them."""
    rng, rows = random.Random(51), []
    for i in range(400):
        good, lang = i % 3 > 0, "xy"[i % 2]
        t = words(rng, "abcde" if lang == "x" else "vwxyz", rng.randrange(5, 40))
        rows.append((i, t.capitalize() + "." if good else t.upper().replace(" ", "!! ") + "!!", lang, int(good)))
    rows += [(1000, None, "x", 1), (1001, "", None, 0), (1002, "é" * 300_000, None, 1), (1003, rows[5][1], None, None)]

    def run(name, query, wrong=lambda i: False, tables=rows):
        d = tmp_path / name
        lang = {"x": "y", "y": "x", None: None}
        docs = [(i, t, lang[v] if wrong(i) else v, "s", 7) for i, t, v, _ in tables] + [(None, "abc bad", "y", "s", 7)] * bool(tables)
        labels = [(i, 1 - q if wrong(i) else q, 0) for i, _, _, q in tables if q is not None] + [(9999, 1, 0)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        return {r.doc_id: r for r in query(spark, str(d)).collect()}

    return rows, run


@pytest.mark.parametrize("name", ["op1", "op2"])
def test_held_out_rows_are_not_learned_from(learnable, name):
    rows, run = learnable
    query, label = (quality_knn.op1_quality, "predicted") if name == "op1" else (language_id.op2_language_id, "lang_pred")
    got = run("plain", query)
    assert len(got) == 405 and all(got[i].held_out == (crc(i) == 1) for i in got if i is not None) and got[None].held_out is None
    truth = {i: q if name == "op1" else v for i, _, v, q in rows[:400]}
    held = [i for i in truth if crc(i) == 1]
    assert len(held) > 100 and sum(got[i][label] == truth[i] for i in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    assert got[5].score == got[1003].score
    same = run("held", query, lambda i: crc(i) == 1)
    assert {i: (r.score, r[label]) for i, r in same.items()} == {i: (r.score, r[label]) for i, r in got.items()}
    other = run("learned", query, lambda i: crc(i) != 1)
    assert sum(other[i][label] == truth[i] for i in held) < 0.1 * len(held)
    assert run("none", query, tables=[]) == {}


def test_scores_by_brute_force(spark):
    """The result of both models, from their parts, one text, neighbour and weight at a time."""
    docs = labelled(spark)
    model = language_id.fit(language_id.learnable(docs))
    dense = np.zeros((1 << language_id.BITS, 2))
    for c, (k, v) in enumerate(model["w"].parts):
        dense[k, c] = v
    share = (dense != 0).sum() / (np.concatenate([k for k, _ in model["w"].parts]).size + 1e-9)
    assert share == pytest.approx(1) and (dense != 0).mean() < 0.2 and 0.005 < model["t"] < 20
    scores = set()
    for r in language_id.predict(docs, model).collect():
        text = next(x.text for x in docs.where(f"doc_id <=> {r.doc_id if r.doc_id is not None else 'null'}").collect())
        codes = charvec.letter_codes((text or "").encode())
        if (codes != 32).any():
            n = charvec.counts(codes, language_id.ORDERS, language_id.BITS)
            x = np.log1p(n) * model["idf"]
            z = np.array([sum(a * b for a, b in zip(x[n > 0] / np.sqrt((x * x).sum()), dense[n > 0, c])) for c in (0, 1)])
            p = np.exp(z / model["t"] - (z / model["t"]).max())
            p /= p.sum()
            scores.add(round(r.score, 6))
            assert r.score == pytest.approx(p.max(), abs=1e-5) and r.lang_pred == model["names"][int(p.argmax())]
        if len(scores) > 30:
            break
    assert len(scores) > 10


def test_principal_vectors_by_brute_force():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(90, 12)) * 3.0 ** -np.arange(12)) @ rng.normal(size=(12, 60))
    want = np.linalg.svd(x)[2][:5]
    got = quality_knn.principal(x.astype(np.float32), 5).T
    assert np.abs(np.abs((want * got).sum(1)) - 1).max() < 1e-3


def test_token_counts_odd_rows(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    long = "x" * 200_000 + " word" * 200_000
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (2, long)]
    n = {t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for _, t in rows}
    got = sorted((r.n_tokens, r.n_bytes, r.over_limit) for r in token_count.count_tokens(frame(spark, rows), path).collect())
    assert got == sorted((n[t], len(t), n[t] > 2048) for _, t in rows)
    assert token_count.count_tokens(frame(spark, rows).where("doc_id = 9"), path).count() == 0


def test_mixing_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "x y", "a"), (3, "z " * 100, "b")], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert out[1].size == 400_000 and out[1].taken == pytest.approx(out[1].target, rel=0.01) and out[3].taken == 200


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = token_count.whole_tokens(path)
    library = Tokenizer.from_file(path)
    assert len(whole) > 30_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::997])
    rng = random.Random(12)
    pool = [*"abcTé 'sÉΣİẞß\x1c\x85᠎​ \xa012٣Ⅰ!?<|>\n\t", "'S", "'ll", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "😀", "中文", "ͅ", "ﬁ", "\x7f", "the ", "Σας"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))) for i in range(2000)] + [(9000, None), (9001, ""), (9002, "word " * 3000)]
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark, rows), path).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), repr(t)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    item = words(rng, "abcde", 40)
    texts = {i: words(rng, "abcde", 60) for i in range(60)}
    texts |= {100: texts[0].upper(), 101: texts[1] + " end", 102: words(rng, "abcde", 20) + " " + item, 103: "12 34", 104: None}
    rows = [(i, t, "x" if i % 2 else "y", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    exact = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert {r.doc_id for r in exact.collect()} == set(texts) - {0} and exact.columns == docs.columns
    near = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert {r.doc_id for r in near.collect()} == set(texts) - {100, 101} and near.columns == docs.columns
    leaks = corpus_pipeline.leaks(spark, docs, str(tmp_path))
    assert {r.doc_id for r in leaks.collect()} == set(texts) - {102} and leaks.columns == docs.columns
    language = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert language.columns == docs.columns and language.where("doc_id in (103, 104)").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= set(texts) - {0, 101, 102, 103, 104}
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_odd_rows(spark, tmp_path):
    """Null and shared ids, repeated rows, clashing columns and an empty table, through every stage and the whole."""
    import corpus_pipeline

    rng = random.Random(61)
    item, leak = words(rng, "abcde", 40), words(rng, "abcde", 40)
    texts = [words(rng, "abcde" if k % 2 else "vwxyz", 50) for k in range(40)]
    rows = [(k if k % 5 else None, t, "x" if k % 2 else "y") for k, t in enumerate(texts)]
    rows += [(1, texts[2].upper(), "y"), (1, leak + " " + item, "x"), (1, leak + " " + item, "x"), (None, None, None), (7, "", None), (7, texts[7] + " end", "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, sha string"
    extra = [(i, t, v, f"s{k % 3}", len(t or ""), "r", "i", "s") for k, (i, t, v) in enumerate(rows)]
    spark.createDataFrame(extra, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = dict(language_id=44, exact_dedup=43, ngram_jaccard=43, decontaminate=44)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and len(got) == left[name], name
        assert all((r.row, r.id, r.sha) == ("r", "i", "s") for r in got)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 40
    none = docs.where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("names", [["row", "sha", "id"], ["__gone", "__id", "__sha"], ["__spans", "sure", "any"], ["digest", "top", "spans"]])
def test_clashing_columns(spark, names):
    """Columns named like helpers are carried as they are, for any id, null or shared."""
    from changelens.llm import exact_dedup, ngram_jaccard

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, "other"), (2, text + " end"), (2, text + " end"), (None, text), (None, None), (3, "mail a@b.co"), (4, "mail A@B.CO")]
    df = spark.createDataFrame([(i, t, k, "c", "d") for k, (i, t) in enumerate(rows)], ["doc_id", "text", *names]).repartition(3)
    bench = spark.createDataFrame([(0, "w3 w4 w5 w6 w7 w8")], "item_id long, text string")
    for f, left in ((exact_dedup.deduplicate, 5), (ngram_jaccard.deduplicate, 4), (lambda d: decontaminate.remove(d, bench), 4), (pii.redact, 8)):
        out = f(df)
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) == left and all(r[3:] == ("c", "d") and (r.doc_id, r.text) in [*rows, (3, "mail [email]"), (4, "mail [email]")] and rows[r[2]][0] == r.doc_id for r in got)
    kept = language_id.keep(df, {"names": []})
    assert kept.columns == df.columns and kept.count() == 0
