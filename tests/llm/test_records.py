from itertools import combinations

from pyspark.sql import functions as F

from quoin.llm.chat import format_preferences
from quoin.llm.url_rules import judge, mine_rules
from quoin.llm.warc import canonical_url, resolve_revisits

TURNS = "pair_id bigint, side string, turn bigint, role string, text string, c string, n_common int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "c", 9) for r in rows], TURNS)


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "chosen", 2, "user", None),
        (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"),
        (3, "chosen", 0, "assistant", "x" * 50_000),
        (4, "chosen", 0, "user", None), (4, "rejected", 0, "user", ""),
        (None, "chosen", 0, "user", "lost"), (5, None, 0, "user", "lost"),
        (6, "chosen", 0, "user", "tie"), (6, "chosen", 0, "user", "tie"), (6, "rejected", 0, "user", "tie"),
    ]
    out = {r.pair_id: r for r in format_preferences(turns(spark, rows)).collect()}
    assert set(out) == {1, 2, 3, 4, 6}
    one = out[1]
    assert (one.n_common, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert one.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\n<|end|>\n" and one.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["good<|end|>"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["bad<|end|>"]
    assert (out[2].n_common, out[2].chosen, out[2].rejected) == (1, "", "")
    assert out[3].n_common == 0 and out[3].rejected == "" and len(out[3].chosen) > 50_000
    assert out[4].n_common == 0 and out[6].n_common == 1 and out[6].rejected == ""
    assert format_preferences(turns(spark, [])).collect() == []


def test_canonical_url(spark):
    cases = {
        "http://WWW.Example.com:80/A/b/?utm_source=x&q=1&ref=z&gclid=7#top": "example.com/A/b?q=1&ref=z",
        "https://example.com/a?ref=x": "example.com/a?ref=x", "https://example.com/a?fbclid=x": "example.com/a", "example.com": "example.com", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == cases


RECORD = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, headers map<string,string>, digest string, _url string, _at int"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], RECORD)


def test_revisits(spark):
    h = {"content-length": "9", "etag": "a", "date": "d1"}
    rows = [
        (1, "http://a/x", 100, "response", "a", "m1", h, "D1"), (2, "http://a/x/", 200, "response", "b", "m2", h, "D2"),
        (3, "https://a/x#f", 150, "revisit", 'W/a', None, {"date": "d2", "content-length": "0"}, None),
        (4, "http://a/x", 100, "revisit", "a", None, None, None), (5, "http://a/x", 10**6, "revisit", "a", "m2", {}, None),
        (6, "http://a/x", 10**6, "revisit", None, "m2", {}, None), (7, "http://a/y", 10**6, "revisit", "a", None, {}, None),
        (8, None, 10**6, "revisit", "a", None, {}, None), (9, "http://a/x", None, "revisit", "b", None, {}, None),
        (10, "http://a/x", 10**6, "revisit", None, None, {}, None), (10, "http://a/x", 10**6, "revisit", None, None, {}, None),
        (11, "http://a/x", 200, "response", "c", None, None, "D3"),
    ]
    for chunk in (50, 86_400):
        got = resolve_revisits(records(spark, rows), chunk_seconds=chunk).collect()
        assert len(got) == len(rows)
        out = {r.record_id: r for r in got}
        assert (out[3].status, out[3].refers_to, out[3].digest) == ("resolved", 1, "D1")
        assert out[3].headers == {"content-length": "9", "etag": "a", "date": "d2"}
        assert {i: out[i].status for i in (1, 4, 5, 6, 7, 8, 9, 10)} == {1: "full", 4: "orphan", 5: "mismatch", 6: "mismatch", 7: "orphan", 8: "orphan", 9: "orphan", 10: "mismatch"}
        assert out[5].refers_to == 11  # equally late: the greatest record_id
    assert resolve_revisits(records(spark, [])).collect() == []


def test_header_names_have_no_case(spark):
    rows = [
        (1, "http://a/x?ref=5", 1, "response", "a", None, {"Content-Length": "900", "ETag": "a", "X": "1", "x": "2", "Set-Cookie": None}, "D1"),
        (2, "http://a/x?ref=5&utm_source=z", 2, "revisit", "a", None, {"Content-length": "0", "etag": "b", "DATE": "d"}, None),
        (3, "http://a/x?ref=6", 2, "revisit", "a", None, None, None),
        (4, "http://a/" + "y" * 200_000, 2, "revisit", "a", None, {"k": "v" * 100_000}, None),
    ]
    out = {r.record_id: r for r in resolve_revisits(records(spark, rows)).collect()}
    assert out[2].headers.pop("x") in ("1, 2", "2, 1")  # a map from Python has no order
    assert (out[2].status, out[2].headers) == ("resolved", {"content-length": "900", "etag": "b", "set-cookie": "", "date": "d"})
    assert (out[3].status, out[4].status, len(out[4].canonical_url), len(out[4].headers["k"])) == ("orphan", "orphan", 200_002, 100_000)


def test_records_that_meet_nothing_are_not_gathered(spark):
    rows = [(i, None, 5, "revisit", "a", None, {}, None) for i in range(400)] + [(i, "http://a/x", None, "revisit", "a", None, {}, None) for i in range(400, 800)]
    frame = records(spark, rows).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay as they are dealt
    try:
        out = resolve_revisits(frame)
        assert {r.status for r in out.collect()} == {"orphan"}
        held = out.select("record_id").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held) == 800 and max(held) < 400


def test_revisits_over_chunks_match_plain_version(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"http://a/{rng.choice('hhhhxy')}", rng.randrange(0, 3000), rng.choice(["response", "revisit"]), rng.choice("ab"), None, {}, f"D{i}") for i in range(500)]
    got = {r.record_id: r.refers_to for r in resolve_revisits(records(spark, rows), chunk_seconds=70).collect() if r.kind == "revisit"}
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            old = [(t, j) for j, u, t, k, *_ in rows if k == "response" and u == url and t < ts]
            assert got[i] == (max(old)[1] if old else None)


def test_mined_rules_match_enumeration(spark):
    import random

    rng = random.Random(6)
    rows = [(sorted(rng.sample("abcdef", rng.randrange(1, 5))), rng.random() < 0.4) for _ in range(300)]
    rows = [(t, b or {"a", "b"} <= set(t)) for t, b in rows]
    frame = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    got = {tuple(sorted(r.tokens)): r.confidence for r in mine_rules(frame, min_support=0.02, min_confidence=0.5).collect()}
    want = {}
    for k in range(1, 7):
        for t in combinations("abcdef", k):
            has = [b for x, b in rows if set(t) <= set(x)]
            if has and sum(has) >= 0.02 * len(rows) and sum(has) / len(has) >= 0.5:
                want[t] = sum(has) / len(has)
    want = {t: c for t, c in want.items() if not any(len(s) < len(t) and set(s) <= set(t) and d >= c for s, d in want.items())}
    assert got == want and got


def test_judge(spark):
    pages = spark.createDataFrame(
        [(1, "http://EXAMPLE.com/en/1", 0.1), (2, "https://www.example.com/en/1", 0.1), (3, "https://a.net/fr/?q", 0.1), (4, "https://shop.com", 0.1), (5, None, 0.1), (6, "nohost", 0.1),
         (7, "http://bad.org/x", 0.1), (8, "http://bad.org/y", 0.1), (9, "http://bad.org/x", 0.1), (9, "http://bad.org/x", 0.1), (None, "http://good.org/#a://b/", 0.1), (10, "http://x.org?next=http://y.net/fr/", 0.1)],
        "page_id bigint, url string, score double",
    )
    labels = spark.createDataFrame([(i, i in (7, 8, 9)) for i in (1, 2, 3, 7, 8, 9, 10)], "page_id bigint, blocked boolean")
    out = judge(pages, labels, min_support=0.2, min_confidence=0.9).collect()
    assert len(out) == 12
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert by == {
        1: ("example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 3: ("a.net", "/fr/", "net/fr/", "block"),
        4: ("shop.com", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("bad.org", "/x", None, "block"), 8: ("bad.org", "/y", None, "block"),
        9: ("bad.org", "/x", None, "block"), None: ("good.org", "/", None, "allow"), 10: ("x.org", "", None, "allow"),
    }
    none = judge(pages.limit(0), labels.limit(0)).collect()
    assert none == [] and len(judge(pages, labels.limit(0)).collect()) == 12


def test_judge_takes_very_long_urls(spark):
    long = "http://h.org/" + "/".join(f"s{i}x" for i in range(3_000)) + "?" + "&".join(f"k{i}=1" for i in range(500))
    pages = spark.createDataFrame([(1, long), (2, "http://h.org/a")], "page_id bigint, url string")
    labels = spark.createDataFrame([(2, True)], "page_id bigint, blocked boolean")
    out = {r.page_id: r for r in judge(pages, labels, min_support=0.5).collect()}
    assert len(out[1].path) == len(long.split("?")[0]) - 12 and out[1].verdict == out[2].verdict == "block"


def test_judge_uses_rules_of_every_length(spark):
    parts = ["a", "b", "c", "d"]
    paths = [(p, False) for k in (1, 2, 3) for p in combinations(parts, k)] * 3 + [(tuple(parts), True)] * 3 + [(("a", "b", "c", "e"), False)]
    pages = spark.createDataFrame([(i, f"http://h.org/{'/'.join(p)}") for i, (p, _) in enumerate(paths)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(paths)], "page_id bigint, blocked boolean")
    out = {r.page_id: (r.verdict, r.score) for r in judge(pages, labels, min_support=0.05, min_confidence=0.6).collect()}
    # Only all four segments together are sure; three of them are blocked at most every other time.
    assert out == {i: ("block", 1.0) if b else ("allow", None) for i, (_, b) in enumerate(paths)}
