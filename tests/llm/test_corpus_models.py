"""Language-model scores, divergence of sources and repair of conversations, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.llm import conversation_repair as repair
from quoin.llm import divergence, language_model

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- divergence -------------------------------------------------------------------------------------------------------------


def plain_divergence(docs, min_docs, top):
    count, seen, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().translate(LOWER))
        groups.add((lang, source))
        count.update((lang, source, w) for w in words)
        seen.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (la, w), n in seen.items() if la == lang and n >= min_docs)
        sources = sorted(s for la, s in groups if la == lang)
        v = len(kept)
        shares = lambda counts: [1 + 10**9 * (c + 5) // (sum(counts) + 5 * v) for c in counts]  # noqa: B023, E731
        own = {s: [count[lang, s, w] for w in kept] for s in sources}
        p = {s: shares(c) for s, c in own.items()}
        q = shares([sum(own[s][k] for s in sources) for k in range(v)])
        for s in sources:
            pairs = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s)
            terms = sorted((y - x, w) for x, y, w, c in zip(p[s], q, kept, own[s], strict=True) if c > 0 and x > y)[:top]
            out += [(lang, s, part, item.decode(), -value, k + 1) for part, rows in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(rows)]
    return sorted(out)


def some_docs(n=300, seed=3):
    rng = random.Random(seed)
    words = ["Éa", "the", "of", "zebra", "b1c", "naïve", "x-y"] + [f"{a}{b}" for a, b in product("abcdef", "ghij")]
    docs = []
    for _ in range(n):
        lang = rng.choice(["en", "fr", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "ß", None, "lone" if lang == "fr" else "s1"])
        docs.append((" ".join(rng.choices(words, k=rng.randrange(0, 25))) if rng.random() > 0.05 else None, lang, source))
    return docs


def test_divergence_equals_plain_version_over_blocks(spark):
    docs = some_docs()
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("item", F.lit(1))
    full = sorted(map(tuple, divergence.divergence(df, 20, 7).collect()))
    assert full == plain_divergence(docs, 20, 7)
    kept = divergence.kept_terms(df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]), 20)
    groups = divergence.sized_groups(df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]), kept)
    small = divergence.pair_ranks(kept, groups, block_terms=5, block_sources=2).select("lang", "source", F.lit("pair"), "item", "value", "rank")
    assert sorted(map(tuple, small.collect())) == [r for r in full if r[2] == "pair"]


def test_divergence_ties_are_in_utf8_order_and_stop_at_the_top(spark):
    docs = [("a é z ｚ 😀 b", "x", "one")] * 4 + [("c d", "x", "two")] * 4
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    rows = [r for r in divergence.divergence(df, 3, 4).collect() if r.part == "term" and r.source == "one"]
    assert [r.item for r in sorted(rows, key=lambda r: r["rank"])] == ["a", "b", "z", "é"] and len({r.value for r in rows}) == 1


def test_divergence_without_terms_or_rows(spark):
    schema = "text string, lang string, source string"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    rows = divergence.divergence(spark.createDataFrame([(None, None, "a"), ("", None, None)], schema)).collect()
    assert sorted(map(tuple, rows)) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_long_text_in_pieces():
    from quoin.llm.arrow import pieces

    data = b"ab cde\n" * 1000 + b"x" * 500
    cut = list(pieces(data, 50))
    assert b"".join(cut) == data and len(cut) > 50 and all(p[-1:].isspace() for p in cut[:-1])


# --- conversations ----------------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """rows in order: (role, text). (cost, audit, repaired) by full search over states, forward."""
    best, seen = {0: (0, "", [])}, set()

    def inserted(states):
        for _ in range(3):
            for q, (c, a, kept) in list(states.items()):
                role = "assistant" if q == 2 else "user"
                to = 3 if q == 2 else 2
                new = (c + 2, a + "I", [*kept, f"{role}:"])
                states[to] = min(states.get(to, new), new)
        return states

    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        gone = not bare or (role, text) in seen
        late = 0 if gone or bare[-1] in ".!?" else 1
        seen.add((role, text))
        new = {}
        for q, (c, a, kept) in inserted(best).items():
            options = [(q, (c + 3, a + "D", kept))]
            if not gone:
                fits = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                if fits:
                    options.append((fits, (c + late, a + "K", [*kept, f"{role}:{text}"])))
                other = "assistant" if q == 2 else "user"
                options.append((3 if q == 2 else 2, (c + late + 2, a + "R", [*kept, f"{other}:{text}"])))
            for to, o in options:
                new[to] = min(new.get(to, o), o)
        best = new
    return min(v for q, v in inserted(best).items() if q in (0, 3))


def some_turns(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Hi.", "Well", "", " \n", "What?", "Yes!", "ok then."]
    return [(rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}" + rng.choice([".", ""])) for _ in range(n)]


def test_walk_over_blocks_equals_full_search():
    rng = random.Random(5)
    for trial in range(200):
        rows = some_turns(rng, rng.randrange(0, 14))
        seen, symbols = set(), ""
        for role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 2 if not bare or (role, text) in seen else 0 if bare[-1] in ".!?" else 1
            seen.add((role, text))
            symbols += chr(97 + 3 * ({"s": 0, "u": 1, "a": 2}.get(role[:1], 3)) + fault)
        size = trial % 5 + 1
        blocks = [symbols[i : i + size] for i in range(0, len(symbols), size)] or [""]
        ends = repair.checkpoints([repair.costs(b) for b in blocks[1:]])
        state, audit, cost = 0, "", None
        for k, (b, end) in enumerate(zip(blocks, ends, strict=True)):
            c, edits, state = repair.walk(b, end, state, k == len(blocks) - 1)
            cost, audit = c if k == 0 else cost, audit + edits
        assert (cost, audit) == plain_repair(rows)[:2]


@pytest.mark.parametrize("least", [256, 3])
def test_repair_equals_full_search(spark, monkeypatch, least):
    monkeypatch.setattr(repair, "LEAST_BLOCK", least)
    rng = random.Random(9)
    rows = [(c, t, role, text, "x") for c in (1, 2, 3, None) for t, (role, text) in enumerate(some_turns(rng, 60 if c == 1 else 9))]
    rows += [(7, None, "user", "Hm.", "x"), (7, None, None, None, "x"), (7, 4, "assistant", "Yes.", "x"), (7, 9, "assistant", "Yes.", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string").repartition(3)
    placed = repair.placed_rows(df.select("conv_id", "turn", "role", "text"))
    found = repair.cheapest_edits(placed)
    got = {r.conv_id: r for r in found.collect()}
    turns = {}
    for r in sorted(repair.repaired_turns(placed, found).collect(), key=lambda r: r.turn):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(placed, found).collect()}
    sums = {r.conv_id: r for r in repair.summary(placed).collect()}
    for c in (1, 2, 3, 7, None):
        own = sorted(((-1 if t is None else t), role or "", text or "") for k, t, role, text, _ in rows if k == c)
        cost, audit, kept = plain_repair([r[1:] for r in own])
        assert (got[c].cost, got[c].audit, turns.get(c, [])) == (cost, audit, kept)
        assert digests.get(c, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        initials = [r[1][:1] for r in own]
        assert got[c].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    assert tuple(sums[7])[1:] == (4, 1, 1, 0)


def test_repair_of_a_conversation_that_is_most_of_the_table(spark):
    rows = [(1, 5, "user", "Same.")] * 3000 + [(2, 0, "user", "A."), (2, 1, "assistant", "B.")]
    placed = repair.placed_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    got = {r.conv_id: (r.cost, r.audit) for r in repair.cheapest_edits(placed).collect()}
    assert got == {1: (3 * 2999 + 2, "K" + "D" * 2999 + "I"), 2: (0, "KK")}
    sizes = [len(r.symbols) for r in repair.blocks_of(placed).filter("conv_id = 1").collect()]
    assert max(sizes) == repair.LEAST_BLOCK and sum(sizes) == 3000  # the hot conversation lies in many blocks


def test_damage_and_conversations_that_lose_all_rows(spark, tmp_path):
    rows = [(c, 0, "user", "Hi there.") for c in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(60))
    gone = [c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and all(tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone)
    twice = [c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 3]
    assert twice and all(got[c].duplicate == 1 and got[c].audit == "KDI" for c in twice)


def test_repair_of_no_rows(spark):
    placed = repair.placed_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair.cheapest_edits(placed).count() == 0 and repair.summary(placed).count() == 0


# --- language model ---------------------------------------------------------------------------------------------------------


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), b"\n"]


def fit(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, learn boolean, text string")
    return language_model.fitted(df)


def plain_base(docs):
    c = Counter(w for _, learn, text in docs if learn for w in tokens(text))
    n, v = sum(c.values()), len(c)
    return {d: (len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, _, t in docs}


def language_docs(n=240, seed=2):
    rng = random.Random(seed)
    words = {k: [f"{k}{a}{b}" for a, b in product("bcdfg", "aeiou")] for k in "xyz"}
    docs = []
    for d in range(n):
        own = words[rng.choice("xyz")]
        docs.append((d, d % 5 != 1, " ".join(rng.choices(own, weights=range(1, len(own) + 1), k=rng.randrange(5, 60))) + (f" Rare{d}" if d % 3 else "")))
    return [*docs, (n, True, None), (n + 1, False, ""), (n + 2, True, "  ")]


def test_model_scores_beat_the_base_on_texts_held_out(spark, monkeypatch):
    docs = language_docs()
    model, texts, others = fit(spark, docs)
    got = {r.doc_id: r for r in language_model.scored(texts, model, others).collect()}
    want = plain_base(docs)
    for d, (n, known, total, base) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, abs=1e-9)
    held = [d for d, learn, _ in docs if not learn]
    assert sum(got[d].score for d in held) > 0.9 * sum(got[d].base_score for d in held)  # scores are negative
    # Words that are not listed meet the counts by a join; the base stays the same.
    monkeypatch.setattr(language_model, "frequent_words", lambda counts, most=0: counts.filter("c >= 40"))
    few = fit(spark, docs)
    again = {r.doc_id: r for r in language_model.scored(few[1], few[0], few[2]).collect()}
    assert few[2].count() > others.count() == 0
    assert all(again[d].n_known == want[d][1] and again[d].base_score == pytest.approx(want[d][3], abs=1e-9) for d in want)


def test_probabilities_of_all_words_add_up_to_one(spark):
    docs = language_docs()
    model = fit(spark, docs)[0]
    counts = Counter(w for _, learn, text in docs if learn for w in tokens(text))
    words = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0])))  # all are listed
    for one, two in ((language_model.BEFORE, language_model.BEFORE), (0, 3), (5, language_model.WORDS + 2)):
        units = [k if k < language_model.WORDS else language_model.WORDS + language_model.ending(w) for k, w in enumerate(words)]
        units, c = np.array([*units, *range(language_model.WORDS, language_model.BEFORE)]), np.array([*words.values(), *[0] * language_model.RARE])
        logs = model.log10(units, np.full(len(units), one), np.full(len(units), two))
        logs += np.where(units < language_model.WORDS, 0, np.log10(c + 0.5))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)


def test_every_unit_has_its_own_rows_in_every_class():
    model, units = language_model.Model([], [], 0, 0, {}), np.arange(language_model.BEFORE + 1)
    kind, unit = (x.ravel() for x in np.meshgrid(np.arange(language_model.FREQUENT), units))
    rows = np.concatenate(model.word_features(kind, unit, unit))
    assert np.array_equal(np.sort(rows), np.arange(language_model.WORD_ROWS))
    one, two, _ = model.features(units, units)
    assert len(np.unique(np.concatenate((one, two)))) == 2 * len(units)


def test_sums_over_contexts_are_those_over_tokens(spark):
    docs = language_docs(60)
    model, texts, _ = fit(spark, docs)
    shared = spark.sparkContext.broadcast(model)
    contexts = language_model.contexts_of(texts).repartition(3)
    got = [*language_model._expected(contexts, shared), language_model._seen_words(texts, shared)]
    want = [np.zeros_like(x) for x in got]
    for r in texts.collect():
        one = two = language_model.BEFORE
        for u in np.frombuffer(bytes(r.units), np.int16).tolist():
            kind, rows, common, at, word_rows = model.parts(np.array([u]), np.array([one]), np.array([two]))
            for k in rows:
                want[0][k[0], kind[0]] += 1
                want[1][k[0]] += model.class_shares(rows)[0]
            for k in word_rows if len(common) else ():
                want[2][k[0]] += model.word_shares(kind, word_rows)[0]
                want[3][k[0], at[0]] += 1
            one, two = u, one
    assert all(np.abs(a - b).max() < 1e-2 for a, b in zip(got, want, strict=True))


def test_model_without_training_texts_or_rows(spark):
    docs = [(1, False, "a b"), (2, False, None)]
    model, texts, others = fit(spark, docs)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in language_model.scored(texts, model, others).collect()) == [(1, 3, 0, 0, 0), (2, 1, 0, 0, 0)]
    model, texts, others = fit(spark, [])
    assert language_model.scored(texts, model, others).count() == 0


def test_op11_reads_identifiers_as_text(spark, tmp_path):
    docs = [(d, f"w{d % 3} and Some", "x") for d in range(20)] + [(None, "and", "x"), (3, "w0 and some", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, learn string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = language_model.op11_language_model(spark, str(tmp_path)).collect()
    assert len(rows) == 22 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    train = [(d, not (d is not None and zlib.crc32(str(d).encode()) % 5 == 1), t) for d, t, _ in docs]
    assert {r.train_tokens for r in rows} == {sum(len(tokens(t)) for _, learn, t in train if learn)}
