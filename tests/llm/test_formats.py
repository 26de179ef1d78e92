"""Lexical search, fill-in-middle and chat formatting against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from changelens.llm import chat_format, fill_middle, lexical_search, queries
from pyspark.sql import functions as F

from .test_dedup import frame

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- lexical search


def ranked(docs, items, k=10):
    """The contract, row by row: [(item_id, rank, doc_id, score)]."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(d, Counter(find(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, words, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(find(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma9", "Δέλτα", "the", "the", "x_y", "é"]) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    rows += [(200 + i, "the Rare copy, of one text") for i in range(40)] + [(900, None), (901, ""), (902, " \x00;- "), (None, "the rare null"), (7, "the repeated id"), (7, "the repeated id")]
    return rows + [(903, "long " * 300_000 + "needle"), (904, "z" * 2_500_000 + " needle")]


ITEMS = [(1, "THE rare the needle"), (2, "alpha; beta, ΔΈΛΤΑ Δέλτα x_y"), (3, "nowhere"), (4, None), (5, ""), (6, "é gamma9"), (6, "copy of"), (None, "needle")]


@pytest.mark.parametrize("shard,block", [(16384, 1024), (7, 2)])
def test_search_by_brute_force(spark, shard, block):
    docs, rows = frame(spark, [(d, t) for d, t in corpus()]), corpus()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = lexical_search.build(docs, shard)
    got = [tuple(r) for r in lexical_search.search(index, items, block=block).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == sorted(ranked(rows, ITEMS), key=repr)
    assert index.n == len([1 for _, t in rows if t and re.search(r"[0-9A-Za-zéΔ]", t)])


def test_index_files_hold_few_shards(spark):
    docs = frame(spark, [(d, t) for d, t in corpus()]).coalesce(1)
    shards = lexical_search.build(docs, 2).shards
    per = shards.groupBy(F.input_file_name()).count().collect()
    assert shards.count() > lexical_search.FILE_SHARDS and max(r["count"] for r in per) <= lexical_search.FILE_SHARDS


def test_search_of_nothing(spark):
    docs, items = frame(spark, corpus()[:5]), spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert lexical_search.search(lexical_search.build(docs.where("doc_id < 0")), items).collect() == []
    none = lexical_search.search(lexical_search.build(docs), items.where("item_id < 0"))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_best_is_tie_safe():
    rng = np.random.default_rng(1)
    for _ in range(300):
        score = rng.integers(0, 4, rng.integers(1, 30))
        want = [i for i in sorted(range(len(score)), key=lambda i: (-score[i], i)) if score[i] > 0][:5]
        assert lexical_search.best(score, 5).tolist() == sorted(want)


def test_lengths_across_parts(monkeypatch):
    monkeypatch.setattr(lexical_search, "PART", 5)
    for text in (b"", b"a", b"aaaa bbbbbb c,,d", "ééé é é;éé".encode(), b"     aaaaa     ", b"aaaaa" * 4):
        want = lexical_search.TERM.findall(text)
        assert lexical_search._length(text) == len(want) and [t for some in lexical_search.terms(text) for t in some] == want


# --- fill in middle


def rearranged(doc_id, text):
    """The contract for one row: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "é", "😀", "\n", "\r", "\n\n", " ", "<", "<S", ">", " ", "\x85"]) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    return rows + [(400, None), (401, ""), (402, "a <P> b\nc"), (403, "<M>"), (404, "\n" * 50_000 + "x" * 2_000_000), (None, "a\nb\nc"), (5, "twice\nx"), (5, "twice\nx"), (-9, "neg\native\n")]


def test_fill_in_middle_by_brute_force(spark):
    rows = fill_middle.transform(frame(spark, odd_texts()))
    rows = rows.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output, r.restored) for r in rows.collect()]
    want = [(d, *rearranged(d, t), t or "") for d, t in odd_texts()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(frame(spark, odd_texts()[:3]).where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("unit,grammar", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"), ("sentence", r"[^.!?]*[.!?]+|[^.!?]+"), ("char", r"(?s).")])
def test_units_are_those_of_the_grammar(spark, unit, grammar):
    texts = [t.replace("<", ".").replace(">", "! ") for _, t in odd_texts() if t and len(t) < 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fill_middle.pieces(F.col("t"), unit).alias("p")).collect()
    assert all(r.p == re.findall(grammar, r.t) for r in got)
    rate = fill_middle.transform(frame(spark, odd_texts()), unit, rate=30)
    assert rate.where(F.col("output") != "").where(fill_middle.restore(F.col("output"), F.col("form")) == "").count() == 0
    assert 0 < rate.where("form <> 'plain'").count() < 200


# --- chat


def test_escape_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "#", "###", "</turn>", "\n", "a", "### user:\n", "\n</turn>\n", " "]) for _ in range(rng.randrange(8)))
        role = "".join(rng.choice(["\\", "#", ":", "\n", "n", "<", "a"]) for _ in range(rng.randrange(5)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        twice = chat_format.render(role, text)[0] + chat_format.render("assistant", text)[0]
        assert chat_format.parse(twice) == [(role, text), ("assistant", text)]
    with pytest.raises(ValueError):
        chat_format.parse("### user:\nno end")


def talks():
    rng = random.Random(6)
    bits = ["\\", "###", "</turn>", "\n", " ", "  ", "ok", "é", "😀", "你好", "<|endoftext|>", "x1", "\t"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b\n#<"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f" {t} " + "word " * (t % 50)) for t in range(1500)]  # one that holds most rows
    rows += [(200, 0, None, None), (200, 1, "assistant", None), (None, 1, "assistant", "y"), (None, None, "user", "x"), (300, 0, "assistant", "é" * 700_000), (300, 1, "user", "z")]
    rows += [(400, 0, "user", "same")] * 300
    return rows


def read_back(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        out[c] = (len(own), digest("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)), len(loss), digest(loss), sum(len(chat_format.render(x[2] or "", x[3] or "")[0]) for x in own))
    return out


@pytest.mark.parametrize("piece", [chat_format.PIECE, 500])
def test_chat_by_brute_force(spark, piece):
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"piece": F.lit(1), "mask": F.lit("x")}).repartition(5)
    pieces = chat_format.format_chat(df, BYTES, piece)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.digests(pieces).collect()}
    assert got == read_back(rows)
    tokenizer = chat_format._encoder(BYTES)
    parts: dict = {}
    for r in sorted(pieces.where("conv_id < 130").collect(), key=lambda r: r.piece):
        parts.setdefault(r.conv_id, []).append(r)
    assert piece > 1000 or len(parts[100]) > 50
    for own in parts.values():
        whole = tokenizer.encode("".join(r.formatted for r in own), add_special_tokens=False)
        assert [x for r in own for x in r.ids] == whole.ids  # the tokens of pieces are those of the whole


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_chat(none, BYTES)).collect() == []


def test_align_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        edges = np.sort(rng.integers(0, 40, 12))
        starts, ends = edges[:-1], edges[1:]
        cut = np.unique(rng.integers(0, 40, 6))
        cut = cut[: len(cut) // 2 * 2].reshape(-1, 2)
        want = [any(max(a, s) < min(b, e) for s, e in cut) for a, b in zip(starts, ends)]
        got = chat_format.align(starts, ends, cut)
        assert [bool(x) for x, a, b in zip(got, starts, ends) if a < b] == [x for x, a, b in zip(want, starts, ends) if a < b]


def test_registered():
    for name in ("op11_lexical_search", "op12_fill_in_middle", "op13_chat_format"):
        assert name in queries.QUERIES and name in queries.SQL


# --- hot groups of earlier operators


def test_mix_spreads_rows_without_id_and_equal_rows(spark):
    from changelens.llm import mixing

    n = 20_000
    ids = F.lit(None).cast("long")
    same = spark.range(n).select(ids.alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("a").alias("source"))
    alike = spark.range(n).select(ids.alias("doc_id"), F.concat(F.lit("w x y "), F.col("id").cast("string")).alias("text"), F.lit("b").alias("source"))
    docs = same.union(alike).withColumns({"shard": F.lit("clash"), "copy": F.lit(1), "digest": F.lit("x"), "taken": F.lit(0)})
    per = mixing.mixed_blocks(docs).groupBy("source", F.shiftright("place", 40).alias("shard")).count().collect()
    for source in "ab":
        counts = [r["count"] for r in per if r.source == source]
        assert len(counts) == mixing.LEAST_SHARDS and max(counts) < 2.5 * sum(counts) / len(counts)
    taken = lambda d: sorted(tuple(r) for r in mixing.mix(d).groupBy("source", "size", "target", "taken").count().collect())
    assert taken(docs) == taken(docs.repartition(7))  # however the rows lie


def test_hot_phrases_go_to_their_shards_only(spark, monkeypatch):
    from changelens.llm import repeats, substring_dedup

    from .test_dedup import brute_words, corpus, got

    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(substring_dedup, "HOT_LIMIT", 0)
    monkeypatch.setattr(substring_dedup, "SHARD_CELLS", 1)
    sent = []
    plain = substring_dedup._to_holders

    def watched(common, src, bitmap, shards):
        out = plain(common, src, bitmap, shards)
        sent.append((out.count(), common.count(), shards))
        return out

    monkeypatch.setattr(substring_dedup, "_to_holders", watched)
    rows = corpus(2)
    assert got(substring_dedup.deduplicate(frame(spark, rows))) == brute_words(rows)
    rows_sent, phrases, shards = sent[0]
    assert shards > 100 and 0 < rows_sent < phrases * shards / 4


def test_quality_whole_result_by_brute_force(spark):
    """Every score of the model again: trigrams in a dictionary, all cosines, neighbours sorted, one text at a time."""
    from changelens.llm import charvec, quality_knn, seq

    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 7)))
    good = [(i, " ".join(word("abcdeé") for _ in range(rng.randrange(5, 30)))) for i in range(60)]
    bad = [(100 + i, " ".join(word("XYZ#7!") for _ in range(rng.randrange(5, 30)))) for i in range(50)]
    docs = frame(spark, [*good, *bad, (500, None), (501, ""), (502, "ab"), (503, "abc XYZ! " * 300), (None, good[0][1])])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    learned = {r.doc_id: (r.text, r.label) for r in quality_knn.labelled(docs, labels).collect()}
    model = quality_knn.fit(quality_knn.labelled(docs, labels), docs)
    mask, shift = (1 << 64) - 1, 64 - quality_knn.BITS

    def trigrams(text):
        codes, out = [48 if 48 <= c <= 57 else c for c in text.encode()], Counter()
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            h = (a * int(seq.STEP[40])) & mask
            for x in (b, c):
                h = (h * int(seq.STEP[41]) + x) & mask
            out[((h * int(seq.STEP[45])) & mask) >> shift] += 1
        return out

    texts = [r.text for r in docs.collect() if r.text]
    df = Counter(k for t in texts for k in trigrams(t))
    idf = lambda k: math.log((1 + len(texts)) / (1 + df[k])) + 0.1

    def latent(text):
        x = np.zeros(1 << quality_knn.BITS)
        for k, n in trigrams(text).items():
            x[k] = math.log1p(n) * idf(k)
        x = x / max(np.sqrt((x * x).sum()), 1e-12)
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        b = text.encode()
        kinds = [sum(charvec.CLASS[c] == k for c in b) / len(b) for k in (1, 2, 3)]
        shares = [sum(p == q for p, q in zip(words, words[1:])) / max(1, len(words) - 1), 1 - len(set(words)) / len(words), *kinds]
        y = np.concatenate([x, 0.7 * np.sqrt(shares)]) @ model["basis"].astype(float)
        return y / max(np.sqrt((y * y).sum()), 1e-12)

    known = [(latent(t), int(label)) for t, label in learned.values()]
    assert len(known) == len(model["y"]) and model["prior"] == pytest.approx(sum(y for _, y in known) / len(known))
    rows = docs.select("doc_id", "text").collect()
    scores = {r.doc_id: r for r in quality_knn.score(docs, model).collect()}
    assert len(rows) == len(scores)
    tied = 0
    for doc_id, text in rows:
        if not text:
            want = model["prior"]
        else:
            v = latent(text)
            near = sorted(((float(v @ k), y) for k, y in known), reverse=True)
            if near[quality_knn.NEIGHBOURS - 1][0] - near[quality_knn.NEIGHBOURS][0] < 1e-5:
                tied += 1  # which of equal neighbours votes is open
                continue
            near = near[: quality_knn.NEIGHBOURS]
            weight = [max(c, 0.0) ** 4 + 1e-9 for c, _ in near]
            want = sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight)
        assert scores[doc_id].score == pytest.approx(want, abs=2e-4) and scores[doc_id].predicted == int(scores[doc_id].score >= 0.5)
    assert tied < 10


def test_work_tables_of_two_runs_at_a_time(spark):
    import threading

    from changelens.llm import work

    at, seen = threading.Barrier(2, timeout=120), {}

    def run(name):
        since = work.mark(spark)
        first = work.stage(spark.range(5))
        at.wait()  # both have staged
        last = work.stage(spark.range(7))
        at.wait()
        work.only_latest(spark, since)
        at.wait()
        seen[name] = (last.count(), len(work._own(spark)) - since, first.inputFiles()[0])

    threads = [threading.Thread(target=run, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {n: x[:2] for n, x in seen.items()} == {"a": (7, 1), "b": (7, 1)}
    for _, _, path in seen.values():  # only their own earlier tables went
        assert not spark._jvm.java.io.File(path.removeprefix("file:").replace("///", "/")).exists()
