"""Merkle manifest, conversation repair and URL filter against brute force."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from isochron.llm import conversations, merkle, urls

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def level_up(nodes):
    return [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(level_up(levels[-1]))
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        low = at // 2 * 2
        yield [(k, level[k]) for k in (low, low + 1) if k < len(level) and k != at], at
        at //= 2


def brute_manifest(rows):
    def leaf(r):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: brute_tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in langs}
    top = brute_tree([trees[k][-1][0] for k in langs])
    out = []
    for number, k in enumerate(langs):
        for at, (_, _, mine, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            node, proof = mine, []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for levels, place in ((trees[k], at), (top, number)):
                for beside, own in siblings(levels, place):
                    proof += [d for _, d in beside]
                    node = H(*(d for _, d in sorted([*beside, (own, node)])))
            out.append((r[0], mine, trees[k][-1][0], top[-1][0], H(*proof), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_merkle_by_brute_force(spark, bits, monkeypatch):
    """Languages of 1 to 70 leaves, nulls in every column, ids that repeat, at several block sizes."""
    rng = random.Random(bits)
    langs = [None, "", "de", "en", "é", "z", *(f"l{k}" for k in range(9))]
    rows = [(k, rng.choice(["s", None]), lang, rng.choice([None, k]), rng.choice(["äöü", "", None, "x" * 300])) for k, lang in enumerate(x for n, x in enumerate(langs) for _ in range([1, 2, 3, 5, 70, 8, 9, 16, 17, 1, 1, 33, 4, 1, 2][n]))]
    rows += [(None, "s", "en", 5, "no id"), (None, "s", "en", 5, "no id"), (3, "s", "de", 5, "again"), (3, "s", "de", 5, "again")]
    rng.shuffle(rows)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], bits))
    found = merkle.report(spark.createDataFrame(rows, DOCS).repartition(5))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_manifest(rows), key=str)


def test_merkle_of_one_and_of_none(spark):
    one = [(7, "s", "en", 3, "abc")]
    assert [tuple(r) for r in merkle.report(spark.createDataFrame(one, DOCS)).collect()] == brute_manifest(one)
    assert merkle.report(spark.createDataFrame([], DOCS)).collect() == []


def test_merkle_ignores_further_columns(spark):
    rows = [(k, "s", "en", k, "t") for k in range(5)]
    df = spark.createDataFrame(rows, DOCS)
    extra = df.withColumns({c: F.lit("x") for c in ("key", "pos", "node", "block", "part", "path", "row", "at")})
    assert sorted(map(tuple, merkle.report(extra).collect())) == sorted(brute_manifest(rows))


# -- conversations -----------------------------------------------------------------------------------------------


def brute_damage(rows):
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        code = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if code == 3 else 1)


def brute_repair(rows):
    """rows of one conversation in order: cheapest edits by a search over grammar states, whole strings compared."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}

    @lru_cache(maxsize=None)
    def rest(at, state, inserted):
        best = [(0, "", ())] if at == len(rows) and state in "0A" else []

        def take(cost, label, to, piece, where):
            tail = rest(where, to, inserted + 1 if label == "I" else 0)
            if tail:
                best.append((cost + tail[0], label + tail[1], piece + tail[2]))

        if inserted < 4:
            for x, name in (("u", "user"), ("a", "assistant")):
                if (state, x) in nexts:
                    take(5, "I", nexts[state, x], (f"{name}:",), at)
        if at < len(rows):
            _, role, text = rows[at]
            take(2, "D", state, (), at + 1)
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                if (state, role[:1]) in nexts:
                    take(more, "K", nexts[state, role[:1]], (f"{role}:{text}",), at + 1)
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (state, x) in nexts:
                        take(1 + more, "R", nexts[state, x], (f"{name}:{text}",), at + 1)
        return min(best) if best else None

    cost, audit, pieces = rest(0, "0", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, H("\n".join(pieces))), pieces


def brute_conversations(rows):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in brute_damage(rows):
        by[conv].append((turn, role, text))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], H(x[2]))
    return {conv: brute_repair(sorted(kept, key=order)) for conv, kept in by.items()}


def some_conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "So!  ", "é.", None, "a. b"]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "user"]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(1, 11)):
            turn += rng.choice([1, 1, 1, 0, 2])
            rows.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < 0.2 else rng.choice(texts) if rng.random() < 0.3 else f"{turn} {rng.choice(['ok.', 'well', 'ok.'])}"))
    rows += [(None, 1, "user", "Nobody."), (None, 2, "assistant", "Indeed."), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_by_brute_force(spark, seed):
    rows = some_conversations(seed, 250)
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    found = {r[0]: tuple(r)[1:] for r in conversations.report(conversations.damage(df)).collect()}
    expected = brute_conversations(rows)
    assert found == {k: v[0] for k, v in expected.items()}
    turns = {}
    for r in conversations.repair(conversations.damage(df)).orderBy("conv_id", "pos").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert turns == {k: list(v[1]) for k, v in expected.items() if v[1]}


def test_conversations_of_many_rows(spark):
    """One conversation of all rows, whose repeated turns are deleted; the audit has a label for each row."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"{k % 700} said.") for k in range(20_000)]
    found = conversations.report(spark.createDataFrame(rows, CONVERSATIONS).repartition(7)).first()
    assert (found["duplicate"], found["cost"], found["illegal"]) == (19_300, 38_600, 0)
    assert found["audit"] == "K" * 700 + "D" * 19_300
    assert found["repaired_sha256"] == H("\n".join(f"{r[2]}:{r[3]}" for r in rows[:700]))


def test_conversations_all_dropped_and_none(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Gone.")], CONVERSATIONS)
    assert tuple(conversations.report(conversations.damage(df)).first()) == (conv, 0, 0, 0, 0, 0, 0, "", H())
    assert conversations.report(conversations.damage(df.limit(0))).collect() == []


# -- urls --------------------------------------------------------------------------------------------------------


def brute_url(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest)) if rest is not None else 0
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]) if rest is not None else ""
    path = rest[cut:].split("#")[0].split("?")[0] if rest is not None else ""
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if rest is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits) if fits else None
    return host, path, rule and rule[2], rule[3] if rule else listed.get(url, "allow")


def test_urls_by_brute_force(spark):
    rng = random.Random(5)
    rules = [*urls.RULES, ("example.org", "/a", "block"), ("a.example.org", "/a", "allow"), ("x.y.z.com", "/deep/er", "block"), ("com", "/", "allow")]
    hosts = ["net", "example.net", "EXAMPLE.net", "badexample.net", "a.example.org", "b.a.example.org", "org", "x.y.z.com", "z.com", "example.com", "de.example.com", "", "net.", "example.net:80"]
    ends = ["", "/", "/en/", "/en/5", "/en", "/de/1?x=/en/", "/fr/#", "?q=/fr/", "#/fr/", "/a", "/ab", "/deep/er/", "//en/", "/EN/1", "/fr/ü"]
    pages = [(rng.randrange(50), f"{rng.choice(['http://', 'https://', '', 'x://'])}{rng.choice(hosts)}{rng.choice(ends)}") for _ in range(900)]
    pages += [(None, None), (1, ""), (2, "http://"), (3, "http://a.net/\nen/"), (4, "http://net/" + "é" * 100_000), (5, "http://" + "a." * 20_000 + "net/"), (6, "mailto:x"), (7, "http://example.net/en/://org/fr/")]
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(4)
    listed = [u for _, u in pages if u and u.endswith("/en/5")][:7] + ["http://z.com/deep/er/?utm_source=1&b=2&a=1#t"]
    names = spark.createDataFrame([(u,) for u in listed], "url string").select(urls.canonical(F.col("url")).alias("url"), F.lit("block").alias("verdict"))
    canonical = {r[0]: r[1] for r in df.select("url", urls.canonical(F.col("url"))).collect()}
    blocked = {r[0] for r in names.collect() if r[0]}
    found = urls.judge(df.withColumn("rule", F.lit(1)), spark.createDataFrame(rules, "host string, path string, verdict string"), names)
    got = sorted(((r["page_id"], r["url"], r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in found.collect()), key=str)
    assert got == sorted(((k, u, *brute_url(u, rules, {u: "block"} if canonical[u] in blocked else {})) for k, u in pages), key=str)


def test_urls_canonical_form(spark):
    cases = {"HTTP://www.A.com:80/x/?utm_a=1&b=2&a=1#f": "a.com/x?a=1&b=2", "https://a.com": "a.com/", "http://u@a.com./": "a.com/", "x": None}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r[0]: r[1] for r in df.select("url", urls.canonical(F.col("url"))).collect()} == cases


def test_urls_filter_passes_all_listed_and_few_others(spark, monkeypatch):
    """No listed key is lost; with room few others pass, and in a filter far too small the answer is the same."""
    keys = spark.range(20_000).selectExpr("concat('h', id, '.com/') key")
    asked = spark.range(40_000).selectExpr("concat('h', id, '.com/') key")
    assert urls.possible(asked, keys.filter("key < 'h2'")).join(keys, "key").filter("key < 'h2'").count() == keys.filter("key < 'h2'").count()
    assert 20_000 <= urls.possible(asked, keys).count() <= 20_200
    pages = spark.range(3_000).selectExpr("id page_id", "concat('http://h', id % 500, '.com/x') url")
    rules = spark.range(250).selectExpr("concat('h', id, '.com') host", "'/' path", "'block' verdict")
    none = spark.createDataFrame([], "url string, verdict string")
    monkeypatch.setattr(urls, "MAX_BLOCKS", 1)
    assert urls.judge(pages, rules, none).filter("url_verdict = 'block'").count() == 1_500


def test_urls_of_no_pages_and_no_lists(spark):
    none = spark.createDataFrame([], "url string, verdict string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.judge(pages, rules, none).first()["url_verdict"] == "allow"
    assert urls.report(pages.limit(0)).collect() == []
