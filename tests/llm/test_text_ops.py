import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quoin.llm.decontaminate import benchmark_blocks, clean_documents, contamination, contamination_report, original_spans
from quoin.llm.language_id import ByteConvNet, held_out, known_language, least_score, predict, train, windows

DOCS = "doc_id bigint, text string, lang string, source string, score double, n_words int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", 1.0, 2) for i, t, l in rows], DOCS)


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_report(rows, items, width=10):
    out = []
    for i, text in rows:
        words, hit, names = words_of(text), set(), set()
        for name, item in items:
            w = words_of(item)
            n = min(width, len(w))
            for s in {tuple(w[k : k + n]) for k in range(max(1, len(w) - width + 1))} if w else ():
                for k in range(len(words) - n + 1):
                    if tuple(words[k : k + n]) == s:
                        hit.update(range(k, k + n))
                        names |= {str(name)} if name is not None else set()
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def decontamination_case():
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(60)] + ["Éa", "x9"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(rng.randrange(1, 30))) for k in range(12)] + [(3, text(12)), (None, text(11)), (20, []), (21, ["v1", "v2", "v3"])]
    rows = []
    for i in range(50):
        w = text(rng.randrange(0, 60))
        if i % 2:
            part = rng.choice(items)[1]
            w[5:5] = part[rng.randrange(0, 2) :]
        rows.append((i, rng.choice([" ", ", ", " - ", "\n"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    rows += [(None, "v1 v2 v3"), (60, None), (61, ""), (62, "..."), (1, rows[1][1]), (63, " ".join(text(20_000)))]
    return rows, [(k, " ".join(w)) for k, w in items] + [(30, None)]


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination_against_plain_version(spark, block):
    rows, items = decontamination_case()
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, contamination_report(docs, bench, block_windows=block).collect()), key=str)
    assert got == plain_report(rows, items)
    kept = clean_documents(docs, bench, block_windows=block)
    assert kept.columns == docs.columns
    want = [r for r in plain_report(rows, items) if not r[5]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want)


@pytest.mark.parametrize("block", [200_000, 7])
def test_share_of_hits_over_all_blocks(spark, block):
    rows, items = decontamination_case()
    rows = [*rows, (70, " ".join(t or "" for _, t in items) + " free" * 200)]
    docs, bench = docs_of(spark, [(i, t, "en") for i, t in rows]), spark.createDataFrame(items, "item_id bigint, text string")
    for most in (0.2, 0.4):
        want = [r[0] for r in plain_report(rows, items) if r[2] <= most * r[1]]
        kept = clean_documents(docs, bench, most_hit=most, block_windows=block)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))
    assert 70 not in want and len(want) > 10


def test_benchmark_comes_in_bounded_blocks(spark):
    _, items = decontamination_case()
    bench = spark.createDataFrame([*items, (40, "w " * 95)], "item_id bigint, text string").repartition(3)
    cut = lambda w: [tuple(x.encode() for x in w[i : i + 10]) for i in range(max(1, len(w) - 9))] if w else []
    want = {(None if i is None else str(i), x) for i, t in [*items, (40, "w " * 95)] for x in cut(words_of(t))}
    got = list(benchmark_blocks(bench, 10, 20))
    assert len(got) > 3 and all(sum(max(1, len(w) - 9) for _, w in b) <= 20 for b in got)
    assert {(n, tuple(w[i : i + 10])) for b in got for n, w in b if w for i in range(max(1, len(w) - 9))} == want


def test_contamination_empty(spark):
    docs, none = docs_of(spark, [(1, "a", "en")]), spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:4] for r in contamination_report(docs, none).collect()] == [(1, 1, 0, 0)]
    assert contamination_report(docs_of(spark, []), none).collect() == []
    assert clean_documents(docs, none).count() == 1


def test_offsets_of_the_original(spark):
    text = "Start: The QUICK, brown\nfox é1! end"
    bench = spark.createDataFrame([(1, "quick brown fox")], "item_id bigint, text string")
    row = contamination(docs_of(spark, [(1, text, "en")]), bench).first()
    (a, b), = original_spans(text, [(s["first"], s["last"]) for s in row.spans])
    assert text.encode()[a:b].decode() == "QUICK, brown\nfox"


def language_rows(n=60, seed=1):
    rng = random.Random(seed)
    parts = {"xx": ["tion", "the", "ing", "wh"], "yy": ["ung", "sch", "ein", "ß"], "zz": ["que", "é", "eau", "oi"]}
    word = lambda p: "".join(rng.choice(p) for _ in range(rng.randrange(1, 4)))
    return [(i, " ".join(word(parts[k]) for _ in range(rng.randrange(8, 80))), k) for i, k in enumerate(rng.choice(sorted(parts)) for _ in range(n * 3))]


def test_language_held_out_accuracy(spark):
    rows = language_rows() + [(900, None, "xx"), (901, "", "xx"), (902, "123 ...", "yy"), (903, "thetion " * 30_000, None), (None, "schein ungein", "yy"), (1, language_rows()[1][1], language_rows()[1][2])]
    docs = docs_of(spark, rows)
    net = train(docs, per_lang=100)
    assert net.langs == ["xx", "yy", "zz"]
    out = predict(docs, net).withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (900, 901, 902)} == {"und"}
    assert next(r for r in out if r.doc_id == 903).lang_pred == "xx"
    held = [r for r in out if r.held and r.lang_pred != "und"]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert not any(r.held for r in out if r.doc_id is None)


def test_language_ignores_held_out_labels(spark):
    rows = language_rows()
    moved = [(i, t, "qq" if __import__("zlib").crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows]
    assert train(docs_of(spark, moved), per_lang=50).langs == ["xx", "yy", "zz"]


def test_language_stage_and_empty(spark):
    docs = docs_of(spark, language_rows() + [(900, None, "xx"), (901, "99", None)])
    kept = known_language(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert known_language(docs_of(spark, [(1, "a", None), (2, None, None)])).count() == 2
    few = known_language(docs, ("xx",)).collect()
    assert {r.lang for r in few} == {"xx"} and len(few) > 20
    assert known_language(docs, ("qq",)).count() == 0 and known_language(docs, share=1.0).count() < docs.count() / 2


def test_least_score_depends_on_the_number_of_languages():
    assert [least_score(k, 0.25) for k in (1, 2, 4)] == [1.0, 0.625, 0.4375]


def test_scores_against_plain_loops(spark):
    import math

    net = train(docs_of(spark, language_rows()), per_lang=60)
    embed, conv, bias, out, out_bias = (net.p[k].tolist() for k in ("embed", "conv", "bias", "out", "out_bias"))
    widths = [w for w in (2, 3, 4, 5) for _ in range(12)]
    for text in ("thetion WHe", "schein ß " * 40, "é"):
        data, total, seen = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()), [0.0] * len(out_bias), 0
        for at in range(0, len(data), 192):
            part = data[at : at + 192]
            x = list(part) + [0] * (192 - len(part))
            tops = [max(max(sum(embed[x[i + j]][e] * conv[j * 8 + e][f] for j in range(w) for e in range(8)) for i in range(188)) + bias[f], 0) for f, w in enumerate(widths)]
            z = [sum(t * out[f][k] for f, t in enumerate(tops)) + out_bias[k] for k in range(len(total))]
            norm = sum(math.exp(v) for v in z)
            total = [a + len(part) * math.exp(v) / norm for a, v in zip(total, z, strict=True)]
            seen += len(part)
        (got,) = predict(docs_of(spark, [(1, text, None)]), net).collect()
        assert got.lang_pred == net.langs[total.index(max(total))] and got.score == pytest.approx(max(total) / seen, abs=1e-4)
    none = docs_of(spark, [])
    assert train(none) is None and predict(none, None).collect() == []
    assert [r.lang_pred for r in predict(docs_of(spark, [(1, "a", None)]), None).collect()] == ["und"]


def test_gradient_against_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    net = ByteConvNet(["a", "b"])
    x = np.stack([windows(bytes(rng.integers(97, 123, 150).tolist()))[0] for _ in range(4)])
    y = np.array([0, 1, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(4), y]).mean()
    grad = net._gradient(x, y)
    for name, at in (("conv", (3, 5)), ("out", (2, 1)), ("embed", (int(x[0, 3]), 2)), ("out_bias", (0,))):
        old = float(net.p[name][at])
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_windows_cover_the_whole_text():
    data = bytes(range(1, 250)) * 7
    assert windows(data).tobytes()[: len(data)] == data and windows(b"").shape[0] == 1


def test_identifiers_of_any_type(spark):
    docs = spark.createDataFrame([("x", "one two three four"), ("x", "one two three four"), (None, "nine")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "two three"), (2, "four")], "item_id bigint, text string")
    for block in (200_000, 1):
        out = contamination_report(docs, items, width=2, block_windows=block).collect()
        assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in out) == [("None", 0, 0), ("x", 3, 2), ("x", 3, 2)]
        assert [r.text for r in clean_documents(docs, items, width=2, block_windows=block).collect()] == ["nine"]


def test_automaton_is_built_once_a_worker(spark):
    """Forty tasks over the same benchmark: the processes that ran them have built one automaton each at the utmost."""
    docs = spark.range(400).repartition(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), "id").alias("text"))
    items = spark.createDataFrame([(1, "two three 7")], "item_id bigint, text string")

    def built(batches):
        import os

        import pandas as pd

        from quoin.llm import decontaminate

        for b in batches:
            yield pd.DataFrame({"pid": [os.getpid()], "n": [decontaminate.BUILT]})

    counts = lambda: {r.pid: r.n for r in spark.range(64).repartition(16).mapInPandas(built, "pid long, n long").collect()}
    before = counts()
    assert contamination(docs, items).filter("size(spans) > 0").count() == 1
    after = counts()
    assert sum(after.values()) > 0 and all(n - before.get(pid, 0) <= 1 for pid, n in after.items())
