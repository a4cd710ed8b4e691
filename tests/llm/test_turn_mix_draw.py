"""Fill-in-middle, source mixing and substring resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sentivote.llm import fill_middle, mixing, substring_crc

CLASHING = "form string, output string, copy long, src string, `a.b` int, score long, place long, key string"
FILL = ("f", "o", 7, "s", 1, 2, 3, "k")


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *FILL) for r in rows], f"doc_id long, text string, source string, {CLASHING}")


# --- fill-in-middle -----------------------------------------------------------


def plain_turn(key, text, seed=7, rate=100, spm=50):
    """The transformation by slices and joins."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    if key is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text or ""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_with_lines(n, seed=1):
    r = random.Random(seed)
    alphabet = ["a", "é", "😀", "\n", "\n", "<", ">", "P", "S", "M", "\r", " ", " "]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_turned_texts_equal_the_plain_version_and_come_back(spark):
    texts = [*texts_with_lines(300), None, "", "\n", "\n\n", "no end", "has <S> inside\nx", "ends<\nP>", "x" * 300_000 + "\n" + "é\n" * 50_000 + "end"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a\nb\nc", "s"), (5, texts[5], "s"), (5, texts[5], "s")]
    out = fill_middle.transformed(clashing(spark, rows))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored(out).alias("back"))
    want = [(i, *plain_turn(i, t), t or "") for i, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(want, key=key)


def test_rates_and_forms(spark):
    rows = [(i, "a\nb\nc\n", "s") for i in range(400)]
    docs = clashing(spark, rows)
    for rate, spm in ((0, 50), (100, 0), (100, 100), (40, 30)):
        got = fill_middle.transformed(docs, rate=rate, suffix_first=spm).collect()
        assert {r["doc_id"]: (r["form"], r["output"]) for r in got} == {
            i: plain_turn(i, t, rate=rate, spm=spm)[1::3] for i, t, _ in rows
        }
    assert fill_middle.digest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.transformed(docs, sentinels=("<P>", "<P>", "<M>"))


def test_rotation_exchanges_blocks_in_place():
    r = random.Random(3)
    for n in (0, 1, 2, 5, 1000, 200_001):
        raw = bytes(r.randrange(256) for _ in range(n))
        a, b, c = sorted(r.randrange(n + 1) for _ in range(3))
        buffer = bytearray(raw)
        fill_middle.rotate(buffer, a, b, c)
        assert bytes(buffer) == raw[:a] + raw[b:c] + raw[a:b] + raw[c:]


# --- mixing -------------------------------------------------------------------


def plain_mix(rows, weights=(3, 1, 2), share=150, most=2, seed=12):
    """Targets by sharing out again and again what is above a limit."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, list(order), sum(total.values()) * share / 100
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > total[s] * most]
        if not over:
            break
        for s in over:
            target[s] = total[s] * most
            left -= target[s]
        free = [s for s in free if s not in over]
    target |= {s: weight[s] * level for s in free}
    out = []
    for i, t, s in rows:
        rate = target[s] / total[s] if total[s] else 0
        key = str(i) if i is not None else hashlib.sha256((t or "").encode()).hexdigest()
        u = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52
        n = math.floor(rate) + (u < rate - math.floor(rate))
        out.append((i, size(t), total[s], round(target[s], 6), n, n * size(t)))
    return out


def mixed_rows(seed, n=300):
    r = random.Random(seed)
    sources = ["b", "a", "", None, "é", "z", "hot", "hot", "hot", "hot"]
    words = ["x", "yy z", "\x0b", "\t", "w\x1c"]
    return [(i if r.random() > 0.02 else None, None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(int(r.paretovariate(1)))), r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("share", [0, 40, 150, 200])
def test_mix_equals_the_plain_version(spark, share):
    rows = mixed_rows(share)
    rows += [rows[0], rows[0]]
    got = mixing.mixed(clashing(spark, rows), share=share).collect()
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"], r["taken"]) for r in got]
    key = lambda r: (r[0] is None, r[0] or 0, *map(float, r[1:]))
    assert sorted(got, key=key) == sorted(plain_mix(rows, share=share), key=key)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    r = random.Random(8)
    rows = [(i, "w " * (1 + i % 7), f"s{r.randrange(8)}" if i % 3 else "hot") for i in range(20_000)]
    docs = clashing(spark, rows)
    mix = mixing.mixed(docs)
    per_source = mix.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")
    ).collect()
    assert all(abs(s["taken"] / s["target"] - 1) < 0.03 and s["over"] <= 0 for s in per_source)
    again = mixing.mixed(docs.repartition(7))
    assert mix.exceptAll(again).isEmpty()


def test_emitted_rows_are_the_copies(spark):
    rows = mixed_rows(4, 120)
    docs = clashing(spark, rows)
    out = mixing.emitted(docs)
    assert out.columns == [*docs.columns, "_copy"]
    times = {}
    for r in mixing.mixed(docs).collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + r["copies"]
    got = out.groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {k: v for k, v in times.items() if v}
    assert mixing.emitted(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_many_sources_are_shared_out_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    rows = [(i, "w " * (1 + i % 5), f"s{i % 400}") for i in range(2_000)]
    got = mixing.mixed(clashing(spark, rows)).collect()
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"], r["taken"]) for r in got]
    assert sorted(got) == sorted(plain_mix(rows))


# --- substring resampling -------------------------------------------------------


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_draw(docs, target, longest=1, buckets=10_000, seed=2024, least=20, share=10):
    """Features as joined strings, each hashed by itself."""
    grams = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
    found = [[zlib.crc32(g.encode()) % buckets for g in grams(plain_words(t))] for _, t, *_ in docs]
    wanted = [zlib.crc32(g.encode()) % buckets for t in target for g in grams(plain_words(t))]
    s, t = [0] * buckets, [0] * buckets
    for f in found:
        for b in f:
            s[b] += 1
    for b in wanted:
        t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (i, text, *_), f in zip(docs, found):
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None])
    able = [r for r, d in zip(rows, docs) if r[3] is not None and len(plain_words(d[1])) >= least]
    able.sort(key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = place
    return [tuple(r) for r in rows]


def spoken(seed, n=250):
    r = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "7up", "x" * 90, "日本", "a-b", "q\x7fq", "", "_", "naïve"]
    return [(i if r.random() > 0.03 else None, None if r.random() < 0.04 else r.choice([" ", "\n", ", "]).join(r.choice(words) for _ in range(r.randrange(80))), "s") for i in range(n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_equals_the_plain_version(spark, longest):
    rows = spoken(longest)
    rows += [rows[1]] * 3 + [(9_000, "w" * 70_000 + " " + "tail " * 30, "s"), (9_001, "", "s")]
    target = ["beta 7up naïve " * 5, None, "été " * 9]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = substring_crc.resampled(clashing(spark, rows), bench, longest=longest, share=30).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_draw(rows, target, longest, share=30), key=key)


def test_ties_go_to_the_smaller_id_and_empty_tables_pass(spark):
    rows = [(i, "one two " * 15, "s") for i in range(1_000)] + [(3, "one two " * 15, "s")] * 200
    docs = clashing(spark, rows)
    bench = spark.createDataFrame([("one",)], "text string")
    got = sorted(r["rank"] for r in substring_crc.resampled(docs, bench).where("rank is not null").collect())
    assert got == list(range(1, 121))
    assert sorted(map(tuple, substring_crc.resampled(docs, bench).collect()), key=str) == sorted(plain_draw(rows, ["one"]), key=str)
    assert substring_crc.resampled(docs.limit(0), bench).count() == 0
    nothing = substring_crc.resampled(docs, bench.limit(0), share=100)
    assert nothing.where("rank is null").count() == 0


def test_cancelled_prefixes_give_the_checksum_of_any_run():
    r = random.Random(5)
    documents = [[bytes(r.randrange(97, 123) for _ in range(r.choice((1, 3, 64, 5_000)))) for _ in range(r.randrange(12))] for _ in range(40)]
    found, whose = substring_crc.checksums(documents, 4, substring_crc.Shifts())
    want = [(zlib.crc32(b" ".join(d[i : i + n])), k) for n in range(1, 5) for k, d in enumerate(documents) for i in range(len(d) - n + 1)]
    assert list(zip(found.tolist(), whose.tolist())) == want
