import random
from collections import defaultdict
from hashlib import sha256
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quoin.llm.components import components
from quoin.llm.exact_dedup import DigestIndex, exact_dedup
from quoin.llm.simhash import ball_links, fingerprint, keep_first, near_components
from quoin.llm.suffix_dedup import repeated_passages

SCHEMA = "doc_id bigint, text string, digest string, size int, body string"
#: Null and empty texts, white space, repeated rows, a null identifier, a very long text, extra columns with clashing names.
ROWS = [(3, "a b"), (1, "a  b"), (2, "a\tb"), (2, "a\tb"), (4, " a b"), (5, None), (6, ""), (7, " "), (8, "\n\t"), (None, "a b"), (None, "alone"), (9, "word " * 40_000), (10, "é b"), (11, "a\u00a0b")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def one_space(text):
    out, space = [], False
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out += [] if space else [" "]
            space = True
        else:
            out.append(c)
            space = False
    return "".join(out)


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[one_space(t)].append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = [x for x in groups[one_space(t)] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and one_space(t) not in seen
        seen |= {one_space(t)} if kept else set()
        out.append((i, keep, len(groups[one_space(t)]), kept, sha256(one_space(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_matches_plain_version(spark, digest_bytes):
    rows = ROWS + [(100 + i, f"text {i % 300}") for i in range(700)]
    out = exact_dedup(frame(spark, rows), digest_bytes=digest_bytes, index=DigestIndex(memtables=3))
    assert sorted(map(tuple, out.collect()), key=str) == expected_exact(rows)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_index_over_batches_matches_plain_version(spark, digest_bytes):
    """A later batch is judged by all rows so far: those of the plain version over both that come after the first."""
    first = [*ROWS, (30, "x y"), (31, "z")]
    second = [(40, "a b"), (0, "x  y"), (31, "z"), (None, "alone"), (41, "new"), (42, "new"), (43, None), (44, "one")]
    index = DigestIndex(memtables=2)
    assert sorted(map(tuple, exact_dedup(frame(spark, first), index=index, digest_bytes=digest_bytes).collect()), key=str) == expected_exact(first)
    got = sorted(map(tuple, exact_dedup(frame(spark, second), index=index, digest_bytes=digest_bytes).collect()), key=str)
    want = {(r[0], r[4]): r for r in expected_exact(first + second)}
    again = {(i, sha256(one_space(t).encode()).hexdigest()) for i, t in first}
    assert got == sorted(((*want[k][:3], want[k][3] and k not in again, k[1]) for k in ((i, sha256(one_space(t).encode()).hexdigest()) for i, t in second)), key=str)
    assert index.batches == 2 and len(index.runs) == 1


def test_exact_empty(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def test_hits_beyond_the_filter_are_joined(spark, monkeypatch):
    from quoin.llm import exact_dedup as module

    monkeypatch.setattr(module, "MOST_BITS", 16)
    assert sorted(map(tuple, exact_dedup(frame(spark)).collect()), key=str) == expected_exact(ROWS)


def test_runs_merge_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    index = DigestIndex(memtables=2)
    for ids in ([5, 7], [3, 7], [9]):
        batch = spark.createDataFrame([(i, f"k{i % 2}") for i in ids], "doc_id bigint, k string")
        rows = batch.select(F.encode("k", "utf-8").alias("digest"), "doc_id")
        index.flush(rows, rows)
    plan = index._merged(*index.runs[:2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert [(r.keep_id, r.batch, r.n) for r in index.compact().collect()] == [(3, 1, 5)]
    assert len(index.runs) == 1


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in one_space(low).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint(spark):
    for _, t in ROWS[:8] + ROWS[10:11] + [(0, "A quick Brown fox jumps over the É lazy dog " * 9)]:
        assert fingerprint(t) == plain_fingerprint(t)
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h & (2**64 - 1) == fingerprint("a b c d")


def closure(fps, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(fps, np.uint64)
    for i, j in zip(*np.where(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius), strict=True):
        x, y = find(i), find(j)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("most_variants", [1_000_000, 20_000])
def test_balls_link_what_brute_force_links(spark, most_variants):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(0, 6))) for c in centres for _ in range(20)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {r.node: r.root for r in components(ball_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), most_variants=most_variants)).collect()}
    got, want = [roots.get(x, x) for x in signed], closure(fps)
    pairs = lambda labels: {(i, j) for i in range(len(labels)) for j in range(i) if labels[i] == labels[j]}
    assert pairs(got) == pairs(want)


def test_near_components(spark):
    out = near_components(frame(spark)).collect()
    assert len(out) == len(ROWS)
    zero = [r for r in out if r.fp == 0]
    assert {r.doc_id for r in zero} == {5, 6, 7, 8} and {r.component_id for r in zero} == {5}
    assert {r.component_id for r in out if r.doc_id in (1, 2, 3, 4, None)} == {1, None}  # "alone" has no identifier
    assert near_components(frame(spark, [])).collect() == []


def test_keep_first_keeps_all_columns(spark):
    out = keep_first(frame(spark))
    assert out.columns == frame(spark).columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 5, 9, 10, 11]


def test_keep_first_leaves_one_row_a_component(spark):
    a, b = ("alpha " * 30).strip(), "other words of another text that has nothing in common with it at all"
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in keep_first(frame(spark, rows)).collect()), key=str)
    assert kept([(1, a), (1, a), (1, a)]) == [(1, a)]
    assert kept([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept([(1, a), (None, a), (None, b)]) == sorted([(1, a), (None, b)], key=str)
    assert kept([(None, a), (None, a)]) == [(None, a)]
    assert kept([(2, None), (1, ""), (1, " ")]) in ([(1, "")], [(1, " ")])
    assert kept([]) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)}


def covered(rows, n):
    seen, out = defaultdict(list), defaultdict(set)
    for at, (_, t) in enumerate(rows):
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].append((at, k))
    for v in seen.values():
        if len(v) > 1:
            for at, k in v:
                out[rows[at][0]].update(range(k, k + n))
    return out


@pytest.fixture(params=[4, 23])
def partitions(spark, request):
    """Many small partitions, none joined to others, so that neighbours lie across their edges."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param == 4)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_repeated_passages_against_brute_force(spark, partitions):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(rng.randrange(30, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = text(rng.randrange(0, 150))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = s[rng.randrange(0, 5) :]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(text(20) + shared[0] + text(20))) for i in range(80)]  # one passage in very many texts
    rows += [(200, None), (201, ""), (202, rows[3][1] + " " + " ".join(shared[1])), (203, " ".join(text(90) * 3))]
    out = repeated_passages(frame(spark, rows))
    assert out.columns == ["doc_id", "first_word", "n_words"]
    got = defaultdict(set)
    for r in out.collect():
        assert r.n_words >= 50
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    want = covered(rows, 50)
    assert want and dict(got) == {i: v for i, v in want.items() if v}


def test_repeated_passages_need_one_partner(spark):
    """Adjacent passages that repeat apart are none together; a passage is found though the longest match on each side of
    it is with other texts."""
    text = lambda name, n: [f"{name}{i}" for i in range(n)]
    a, b, key = text("a", 44), text("b", 44), text("key", 40)
    left, right = text("l", 20), text("r", 20)
    rows = [(1, text("p", 9) + a + b + text("q", 9)), (2, text("s", 30) + a + text("t", 30)), (3, text("u", 30) + b + text("v", 30))]
    rows += [(10, left + key + right), (11, text("x", 20) + left[8:] + key + right[:3] + text("y", 20))]
    rows += [(12, text("z", 20) + left[15:] + key + right[:5] + text("c", 20)), (13, text("d", 20) + left[17:] + key + right[:12] + text("e", 20))]
    rows += [(14, text("f", 20) + left[14:] + key + right[:4] + text("g", 20)), (15, text("h", 20) + left[14:] + key + right[:4] + text("i", 20))]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = defaultdict(set)
    for r in repeated_passages(frame(spark, rows)).collect():
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    assert dict(got) == {i: v for i, v in covered(rows, 50).items() if v} and got
    # Every chain of left and right contexts of a few words, so that places stay undecided.
    rng, rows = random.Random(3), []
    for i in range(150):
        ends = [[f"{side}{k}.{rng.randrange(0, 2)}" for k in range(15)] for side in "lr"]
        rows.append((i, " ".join([*text(f"o{i}.", 5), *reversed(ends[0][: rng.randrange(5, 16)]), *text("key", 36), *ends[1][: rng.randrange(5, 16)], *text(f"n{i}.", 5)])))
    got = defaultdict(set)
    for r in repeated_passages(frame(spark, rows), min_words=42, window=8).collect():
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    assert dict(got) == {i: v for i, v in covered(rows, 42).items() if v} and got


def test_repeated_rows_are_not_gathered(spark, monkeypatch):
    """Very many rows with one text and no identifier: its places are held once, and two rows of them are compared."""
    from quoin.llm import suffix_dedup

    rng, held = random.Random(8), {}
    page = " ".join(f"w{rng.randrange(900)}" for _ in range(300))
    rows = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(page).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(7, "x y " + page), (8, "alone " * 3)], "doc_id bigint, text string"))
    keep = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name, *a: held.setdefault(name, keep(df, name, *a)))
    out = sorted(map(tuple, repeated_passages(rows).collect()), key=str)
    assert out == [(7, 2, 300), (None, 0, 300)]
    most = held["candidates"].agg(F.max(F.size("places"))).first()[0]
    assert most < 60 and held["contexts"].filter("doc_id is null").count() <= 2 * most


def test_repeated_passages_store_no_checksum_files(spark, monkeypatch):
    """Each would cost an executor one more process."""
    from quoin.llm import suffix_dedup

    keep, made = suffix_dedup.stored, []
    monkeypatch.setattr(suffix_dedup, "stored", lambda *a: made.append(keep(*a)) or made[-1])
    text = " ".join(f"u{i}" for i in range(80))
    assert repeated_passages(frame(spark, [(1, text), (2, "a " + text)])).count() == 2
    files = [[p.name for p in Path(urlparse(t._scratch).path).iterdir()] for t in made]
    assert len(made) > 5 and all("_SUCCESS" in f and not any(x.endswith(".crc") for x in f) for f in files)


def test_repeated_passages_edges(spark):
    assert repeated_passages(frame(spark, [])).collect() == []
    long = " ".join(f"u{i}" for i in range(30_000))
    out = repeated_passages(frame(spark, [(1, long), (2, long), (None, "a " * 20), (3, "b"), (3, "b")])).collect()
    assert sorted((r.doc_id, r.first_word, r.n_words) for r in out) == [(1, 0, 30_000), (2, 0, 30_000)]
    with pytest.raises(ValueError):
        repeated_passages(frame(spark, []), min_words=20)
