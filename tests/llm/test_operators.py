"""Operators against brute force on small tables."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions

from isochron.llm import decontaminate, jaccard, licenses, lm, mixing, neighbours, pii, quality, suffix, toxicity
from isochron.llm.components import components

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@pytest.fixture(scope="module")
def texts():
    random.seed(4)
    vocabulary = ["".join(random.choices("abcdeé ñ", k=random.randint(2, 7))).replace(" ", "") or "x" for _ in range(300)]
    words = lambda n: [random.choice(vocabulary) for _ in range(n)]
    passage = " ".join(words(60))
    out = []
    for i in range(120):
        base = words(random.randint(1, 120))
        if i % 5 == 0:
            base = base[:30] + passage.split() + base[30:]
        text = " ".join(base)
        if i % 7 == 0 and out:
            text = out[random.randrange(len(out))]
        if i % 11 == 0 and out:
            near = out[-1].split()
            near[random.randrange(len(near))] = "changed"
            text = " ".join(near)
        out.append(text)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"src{i % 3 if i % 4 else 0}") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5)


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert found == {x: root(x) for x in linked}


def test_jaccard(docs, texts):
    sets = []
    for t in texts:
        w = WORD.findall(t.encode().lower())
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    links, parent = Counter(), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = {r["doc_id"]: r for r in jaccard.join(docs).collect()}
    assert {i: out[i]["n_links"] for i in out} == {i: links[i] for i in range(len(texts))}
    assert {i: out[i]["component_id"] for i in out} == {i: root(i) for i in range(len(texts))}


def test_jaccard_blocks(docs, monkeypatch):
    whole = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard.join(docs).collect()}
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 2)
    monkeypatch.setattr(jaccard, "MAX_BROADCAST", 0)
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard.join(docs).collect()} == whole


def test_bands_reach_the_recall():
    assert (1 - 0.8**jaccard.ROWS) ** jaccard.bands_for() <= 1 - jaccard.RECALL


@pytest.mark.parametrize("hot,most", [(suffix.HOT, suffix.CHUNK), (2, suffix.CHUNK), (suffix.HOT, 130)])
def test_suffixes(docs, texts, hot, most):
    """Plain texts, grams held to be hot, and texts that are walked in pieces."""
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    out = {r["doc_id"]: tuple(r)[1:] for r in suffix.report(docs, hot=hot, most=most).collect()}
    assert sum(w[1] for w in want.values()) > 2000
    assert out == want


def test_suffix_sections(spark):
    """Rows that share an id are sections of one document: a repeat in a later one goes, none crosses."""
    text = "".join(random.Random(3).choices("abcdefgh", k=150))
    rows = [(None, text), (5, text), (5, text), (5, text[:99]), (1, text[50:])]
    out = suffix.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 99, r["n_bytes"], r["n_removed"]) for r in out.collect()) == [(1, 100, 0), (5, 99, 0), (5, 150, 100), (5, 150, 150), (99, 150, 150)]


def test_suffix_of_very_many_rows_without_id(spark):
    """70,000 equal rows: all but one go; and a passage that comes back in one text of many pieces."""
    text = "".join(random.Random(4).choices("abcdefgh", k=150))
    out = suffix.report(spark.range(70_000, numPartitions=4).select(functions.lit(None).cast("long").alias("doc_id"), functions.lit(text).alias("text")))
    assert [tuple(r) for r in out.groupBy("n_removed", "n_spans").count().orderBy("n_removed").collect()] == [(0, 0, 1), (150, 1, 69_999)]
    far = "".join(random.Random(5).choices("abcdefgh", k=60_000)) + text + "".join(random.Random(6).choices("abcdefgh", k=60_000)) + text
    out = suffix.report(spark.createDataFrame([(1, far)], "doc_id long, text string"), most=7_000).first()
    assert (out["n_bytes"], out["n_removed"], out["n_spans"]) == (120_300, 150, 1)


def test_equal_classes():
    random_bytes = np.random.default_rng(2).integers(0, 3, (400, 100), dtype=np.uint8)
    random_bytes[:, :90] = 7
    random_bytes[::3] = random_bytes[0]
    group = np.arange(400) % 2
    found = suffix.equal_classes(random_bytes, group)
    want = {}
    for k in range(400):
        want.setdefault((group[k], random_bytes[k].tobytes()), set()).add(found[k])
    assert all(len(v) == 1 for v in want.values()) and len({next(iter(v)) for v in want.values()}) == len(want)


def test_decontamination(spark, docs, texts):
    items = [("i1", " ".join(texts[0].split()[20:50])), ("i2", "changed"), ("i3", " ".join(texts[3].split()[:12])), ("i4", "no such words here")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    windows = []
    for name, t in items:
        w = t.encode().split()
        k = min(10, len(w))
        windows += [(name, tuple(w[i : i + k])) for i in range(len(w) - k + 1)]
    want = {}
    for d, t in enumerate(texts):
        w = WORD.findall(t.encode().lower())
        hit, names = set(), set()
        for name, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    names.add(name)
        want[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    for most in (500_000, 35):  # one automaton, several
        assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(docs, benchmark, max_words=most).collect()} == want
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, benchmark).collect()}
    assert {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, benchmark, max_words=35).collect()} == left
    odd = spark.createDataFrame([(None, None, 1), (7, "", 2), (8, texts[0], 3), (8, texts[0], 3)], "doc_id long, text string, spans int")
    both = [[tuple(r) for r in decontaminate.scan(odd, benchmark, max_words=most).orderBy("spans").collect()] for most in (500_000, 35)]
    assert both[0] == both[1] and len(both[0]) == 4
    assert all(left[d] == texts[d] for d in want if not want[d][1])
    assert all(d not in left or decontaminate.WORD.findall(left[d].encode()) != [] for d in want if want[d][1])


def test_licenses(spark):
    words = "alpha beta gamma delta".split()
    random.seed(9)
    rows = []
    for i in range(60):
        t = [random.choice(words) for _ in range(random.randint(0, 30))]
        for phrase in random.choices([*licenses.BASE, "Released under the MIT License", "permission is hereby granted free of charge uh to any person obtaining a copy of this software and associated documentation files"], k=i % 3):
            t.insert(random.randint(0, len(t)), phrase)
        rows.append((i, " ".join(t)))
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = t.lower().replace(".", " ").split()
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (out[i]["n_words"], out[i]["n_base"]) == (len(w), len(places))
        assert out[i]["first_word"] == min((p[0] for p in places), default=None) and out[i]["last_word"] == max((p[0] for p in places), default=None)
        assert out[i]["base_labels"] == ",".join(sorted({p[1] for p in places}))
        # A word put in leads to a neighbouring diagonal; neither part alone covers enough of the notice.
        assert ("mit" in out[i]["labels"].split(",")) == ("MIT" in t or "uh" in t.split())


def test_surrogates(spark):
    rows = [(1, "Write to Ann.Lee7@mail.example.com or ANN.LEE7@MAIL.EXAMPLE.COM, call +1 (555) 123-4567."), (2, "ann.lee7@mail.example.com from 10.1.2.3 and +1 (555) 123-4567; card 4532 0151 1283 0366"), (3, "Frau Schmidt met Mr. John Doe; Господин Иван Петров. token 0123456789abcdef0123456789abcdef01234567"), (4, "Version 1.2.3 of 2024-01-02, 12 items of 10 000 000 on 3.10.2024, pages 3-7."), (5, None), (6, "DE89 3704 0044 0532 0130 00 and 123-45-6789")]
    out = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    one, two = out[1]["text"], out[2]["text"]
    found = lambda t: re.findall(r"[^ ]+@[^ ,]+", t)
    assert len({x.lower().rstrip(".") for x in found(one) + found(two)}) == 1 and "ann" not in one.lower()
    phones = [re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", t).group() for t in (one, two)]
    assert phones[0] == phones[1] != "+1 (555) 123-4567"
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})$", two).group(1)
    digits = [int(c) for c in card if c.isdigit()]
    assert (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    assert "10.1.2.3" not in two
    assert out[3]["text"].startswith("Frau ") and "Schmidt" not in out[3]["text"] and "Doe" not in out[3]["text"] and "Петров" not in out[3]["text"]
    given = out[3]["text"].split("Mr. ")[1].split()[0]
    assert given in pii.GIVEN["latin", "m"]
    assert re.search(r"token [0-9a-f]{40}$", out[3]["text"])
    assert out[4]["text"] == rows[3][1] and out[4]["n_entities"] == 0 and out[5]["text"] is None
    assert "6789" not in out[6]["text"] and "3704" not in out[6]["text"] and out[6]["entity_kinds"] == "iban,ssn"


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With a surrogate that nearly always collides, distinct entities still get distinct ones, by later attempts."""
    from pyspark.sql import functions as F

    plain = pii.surrogate

    def narrow(kind, entity, stem, gender, attempt, key):
        h = F.sha2(F.concat_ws("-", stem, attempt.cast("string")), 256)
        return F.when(kind == "ip", F.concat(F.lit("240.0.0."), F.pmod(F.xxhash64(h), F.lit(40)).cast("string"))).otherwise(plain(kind, entity, stem, gender, attempt, key))

    monkeypatch.setattr(pii, "surrogate", narrow)
    ips = [f"10.0.0.{k}" for k in range(20)]
    out = [r["text"] for r in pii.replace(spark.createDataFrame([(k, f"at {ip} twice {ip}") for k, ip in enumerate(ips)], "doc_id long, text string"), "key").collect()]
    new = [re.findall(r"240\.0\.0\.\d+", t) for t in out]
    assert all(len(x) == 2 and x[0] == x[1] for x in new) and len({x[0] for x in new}) == 20


def test_surrogates_of_people(spark):
    """One person keeps one name whatever the title, families keep theirs, later mentions without a title follow."""
    rows = [(1, "Mr. John Doe came. John Doe spoke; Doe left. Doeville stays."), (2, "Dr. John Doe and Ms. Jane Doe"), (3, "Prof. Doe, MR DOE, Mr. DOE"), (4, "Dr. Kim Roe"), (5, "Frau Martin and Mr. Paul Doe: Martin, Paul Doe")]
    out = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    john, doe = re.match(r"Mr\. (\S+) (\S+) came\.", out[1]).groups()
    assert out[1] == f"Mr. {john} {doe} came. {john} {doe} spoke; {doe} left. Doeville stays." and john in pii.GIVEN["latin", "m"]
    jane = re.match(rf"Dr\. {john} {doe} and Ms\. (\S+) {doe}$", out[2]).group(1)
    assert jane in pii.GIVEN["latin", "f"] and out[3] == f"Prof. {doe}, MR {doe.upper()}, Mr. {doe.upper()}"
    assert "Roe" not in out[4] and out[4].split()[1] in pii.GIVEN["latin", "n"]
    martin, paul = re.match(rf"Frau (\S+) and Mr\. (\S+) {doe}: ", out[5]).groups()
    assert out[5] == f"Frau {martin} and Mr. {paul} {doe}: {martin}, {paul} {doe}" and len({martin, doe, "Martin", "Doe"}) == 4


def test_surrogates_one_to_one(spark):
    """Plain bookkeeping over random entities and spellings: equal entities agree, different ones don't, forms are kept."""
    r = random.Random(8)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    plain = []
    for _ in range(60):
        local, number, card, account = f"u{digits(3)}", f"+{r.choice(['1', '44', '353'])}" + digits(9), "4" + digits(15), "DE" + digits(20)
        plain += [("email", local, f"{local}@mail.example.org"), ("email", local, f"{local.upper()}@MAIL.example.org"), ("phone", number, number), ("phone", number, f"{number[:-7]} {number[-7:-4]} {number[-4:]}")]
        plain += [("card", card, card), ("card", card, " ".join(card[k : k + 4] for k in (0, 4, 8, 12))), ("iban", account, account), ("iban", account, " ".join(account[k : k + 4] for k in range(0, 22, 4)))]
        plain += [("person", f"{(n := r.choice(['Ann', 'Bob', 'Cy', 'Dan', 'Ed', 'Flo', 'Gus', 'Hal']))} Same", f"Mr. {n} Same")]
    out = [x["text"] for x in pii.replace(spark.createDataFrame([(k, f"see {t} now") for k, (_, _, t) in enumerate(plain)], "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    form = {"email": str.lower, "person": str.lower, "phone": lambda t: t.replace(" ", ""), "card": lambda t: t.replace(" ", ""), "iban": lambda t: t.replace(" ", "")}
    made = {}
    for (kind, entity, old), new in zip(plain, out, strict=True):
        assert (m := re.match(r"see (.*) now$", new)) and old not in new, (old, new)
        made.setdefault((kind, entity), set()).add(form[kind](m.group(1)))
        if kind != "email":
            assert re.sub(r"\w", "", old) == re.sub(r"\w", "", m.group(1)).replace("-", "")
        if kind == "iban":
            bare = m.group(1).replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and bare.startswith("DE")
        if kind == "phone":
            assert re.match(r"\+(1|44|353)", m.group(1)).group() == re.match(r"\+(1|44|353)", old).group()
    assert all(len(v) == 1 for v in made.values())
    for kind in form:
        assert len({next(iter(v)) for k, v in made.items() if k[0] == kind}) == sum(k[0] == kind for k in made)
    again = pii.replace(spark.createDataFrame([(0, "see 10.9.8.7 now")], "doc_id long, text string"), "other").first()["text"]
    assert again != pii.replace(spark.createDataFrame([(0, "see 10.9.8.7 now")], "doc_id long, text string"), "key").first()["text"]


def test_surrogates_of_long_texts(spark):
    """An address of 100,000 labels and texts of megabytes: the expressions don't recurse."""
    rows = [(1, "to anna@" + "ab." * 100_000 + "com end"), (2, "word " * 1_000_000 + "anna@example.com"), (3, "a" * 3_000_000 + "@b"), (4, "1 " * 500_000), (5, "Mr. " * 300_000)]
    out = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    assert [out[k]["n_entities"] for k in range(1, 6)] == [1, 1, 0, 0, 150_000] and "ab.ab" not in out[1]["text"] and "anna" not in out[2]["text"]


def test_mix(docs, texts):
    out = {r["doc_id"]: r for r in mixing.mix(docs, block=64).collect()}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(texts)}
    source = {i: f"src{i % 3 if i % 4 else 0}" for i in sizes}
    total = Counter()
    for i, n in sizes.items():
        total[source[i]] += n
    weights = dict(zip(sorted(total), (3, 1, 2), strict=False))
    target, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for i, r in out.items():
        assert r["size"] == sizes[i] and r["source_size"] == total[source[i]] and r["target"] == pytest.approx(target[source[i]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in total)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2), block=64).collect()} == {i: r["taken"] for i, r in out.items()}


def test_mix_of_one_huge_and_tiny_sources(spark):
    sizes = [("a", 100, 50_000), ("b", 1, 300), ("c", 40, 50_000), ("d", 10, 2_000), ("e", 60, 50_000), (None, 1, 40)]
    made = spark.createDataFrame([(f"{s}{k}", s, n) for s, docs, n in sizes for k in range(docs)], "doc_id string, source string, n int").repartition(4)
    docs = made.select("doc_id", "source", functions.repeat(functions.lit("w "), functions.col("n")).alias("text"))
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target["b"] == 600 and target[None] == 80
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    quotas = spark.createDataFrame([(0, 0, (1 << 40) - 9, 9_000), (1, (1 << 40) - 9, (1 << 40) - 8, 3), (2, (1 << 40) - 8, (1 << 40) - 8, 2)], "nth int, low long, high long, blocks long")
    slots = mixing.schedule(quotas, 64).collect()
    assert len({r["slot"] for r in slots}) == len(slots)
    assert sorted((r["nth"], r["rank"]) for r in slots) == [(n, k) for n, most in ((0, 9_000), (1, 3), (2, 2)) for k in range(most)]


def test_schedule_of_many_sources(spark):
    random.seed(6)
    blocks = [random.randint(1, 4) for _ in range(3_000)]
    edges = [(1 << 40) * k // 3_000 for k in range(3_001)]
    quotas = spark.createDataFrame([(k, edges[k], edges[k + 1], n) for k, n in enumerate(blocks)], "nth int, low long, high long, blocks long")
    slots = [tuple(r) for r in mixing.schedule(quotas, 64).collect()]
    total = int(sum(blocks) * 1.02) + 64 * len(blocks)
    taken, want = Counter(), set()
    for slot in range(total):
        nth = bisect.bisect_right(edges, int(f"{slot:040b}"[::-1], 2)) - 1
        if taken[nth] < blocks[nth]:
            want.add((nth, slot, taken[nth]))
            taken[nth] += 1
    assert len(slots) == sum(blocks) and want <= set(slots)


@pytest.mark.parametrize("tokens,words", [(lm.TOKENS, lm.WORDS), (900, 60)])
def test_language_model(docs, texts, monkeypatch, tokens, words):
    monkeypatch.setattr(lm, "TOKENS", tokens)
    monkeypatch.setattr(lm, "WORDS", words)
    split = [t.encode().lower().split() + [b" "] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    c = Counter(w for x, k in zip(split, train, strict=True) if k for w in x)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for x, k in zip(split, train, strict=True) if k for p in zip([b"^", *x[:-1]], x, strict=True))
    seen, after = Counter(), Counter()
    for (h, _), m in pairs.items():
        seen[h] += m
        after[h] += 1
    base = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    p = lambda h, w: base(w) if not seen[h] else max(pairs[h, w] - 0.75, 0) / seen[h] + 0.75 * after[h] / seen[h] * base(w)
    for r in lm.report(docs).collect():
        x = split[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(x), sum(c[w] > 0 for w in x), n, not train[r["doc_id"]])
        assert r["base_score"] == pytest.approx(sum(math.log10(base(w)) for w in x))
        assert r["score"] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip([b"^", *x[:-1]], x, strict=True)), abs=0.01 * len(x))


def test_elias_fano():
    random_numbers = np.unique(np.random.default_rng(8).integers(0, 1 << 60, 5000).astype(np.uint64))
    for values in (random_numbers, np.arange(300, dtype=np.uint64), np.zeros(1, np.uint64), np.empty(0, np.uint64)):
        e = lm.EliasFano(lm.EliasFano.parts(values))
        k = np.arange(len(values))
        assert (e.get(k) == values).all() and (e.find(values) == k).all()
        assert (e.find(values + np.uint64(1)) == np.where(np.isin(values + np.uint64(1), values), k + 1, -1)).all()


def test_neighbours(spark):
    random = np.random.default_rng(6)
    base = random.standard_normal((900, 24))
    groups = np.concatenate([base[k] + 0.08 * random.standard_normal((30 + k, 24)) for k in range(6)])
    x = np.concatenate([base, groups, groups[:5]])
    ids = random.permutation(len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    out = {r["vec_id"]: r for r in neighbours.join(table).collect()}
    assert {int(i): int(n) for i, n in zip(ids, linked.sum(1), strict=True)} == {i: r["n_links"] for i, r in out.items()}
    best = {int(i): int(i) for i in ids}
    for _ in range(20):
        for k, row in enumerate(linked):
            for m in np.flatnonzero(row):
                low = min(best[int(ids[k])], best[int(ids[m])])
                best[int(ids[k])] = best[int(ids[m])] = low
    assert {i: r["component_id"] for i, r in out.items()} == best


def test_links_between_saturated_parts(spark):
    random = np.random.default_rng(9)
    axes = np.linalg.qr(random.standard_normal((32, 32)))[0]
    # Pairs of tight clusters at a cosine of about 0.93 to each other, and single vectors.
    centres = [y for k in range(6) for y in (axes[k], 0.945 * axes[k] + np.sqrt(1 - 0.945**2) * axes[k + 10])]
    x = np.concatenate([*(c + 0.014 * random.standard_normal((20, 32)) for c in centres), random.standard_normal((300, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert (linked[:240].sum(1) == 39).all() and unit[:20].dot(unit[:20].T).min() > 0.98 and unit[:20].dot(unit[20:40].T).max() < 0.96
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    out = {r["vec_id"]: r for r in neighbours.join(table, audit=0).collect()}
    assert [out[i]["n_links"] for i in range(len(x))] == linked.sum(1).tolist()
    assert [out[i]["component_id"] for i in range(len(x))] == [i // 40 * 40 if i < 240 else i for i in range(len(x))]


def test_recall_of_sparse_links(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE", 400, raising=False)
    random = np.random.default_rng(10)
    near = lambda x, by: x + by * random.standard_normal(x.shape)
    base = random.standard_normal((200, 32))
    x = np.concatenate([base, near(base, 0.42), near(np.repeat(random.standard_normal((1, 32)), 150, 0), 0.05), random.standard_normal((700, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    out = {r["vec_id"]: r["n_links"] for r in neighbours.join(table, tables=1, rounds=0, audit=64, recall=0.99).collect()}
    assert [out[i] for i in range(len(x))] == linked.sum(1).tolist()


def test_tables_and_missed_recall(spark, monkeypatch):
    p = 1 - math.acos(0.9) / math.pi
    for bits in (1, 6, 18):
        n = neighbours.tables_for(bits, 0.9, 0.999, 1)
        assert (1 - p**bits) ** n <= 0.001 < (1 - p**bits) ** (n - 1)
    assert neighbours.tables_for(0, 0.9, 0.999, 8) == neighbours.tables_for(1, 0.9, 0.999, 8) == 8
    monkeypatch.setattr(neighbours, "TRIES", 1)
    monkeypatch.setattr(neighbours, "missed", lambda classes, *a: (0.5, classes.select(classes.id.alias("a"), classes.id.alias("b")).limit(0)))
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.join(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>"), tables=1, rounds=0)


def _labelled(spark, texts, quality_of, toxic_of):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, quality_of(t), toxic_of(t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_and_toxicity_on_held_out_rows(spark):
    random.seed(12)
    vocabulary = ["".join(random.choices("abdegilmnorstu", k=random.randint(3, 9))) for _ in range(800)]
    bad = ["grobax", "fnarlig", "quizzot", "blemish"]
    texts = []
    for i in range(700):
        words = random.choices(vocabulary, k=random.randint(20, 90))
        if i % 6 == 0:
            for _ in range(3):
                term = random.choice(bad)
                if i % 12 == 0 and len(term) > 5:  # misspelled
                    k = random.randrange(1, len(term) - 1)
                    term = term[:k] + term[k + 1 :]
                words.insert(random.randrange(len(words)), term)
        text = " ".join(words).capitalize() + "."
        if i % 5 == 0:
            text = " | ".join(words) if i % 2 else " ".join(w.upper() + "!!" for w in words)
        texts.append(text)
    toxic = {i: int(i % 6 == 0) for i in range(700)}
    good = {i: int(i % 5 != 0) for i in range(700)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, good[i], toxic[i]) for i in range(700)], "doc_id long, quality int, toxic int")
    q = [r for r in quality.report(docs, labels).collect() if r["held_out"]]
    assert len(q) > 80 and sum(r["predicted"] == good[r["doc_id"]] for r in q) >= 0.97 * len(q)
    t = [r for r in toxicity.report(docs, labels).collect() if r["held_out"]]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in t) >= 0.95 * len(t)


def test_one_edit():
    trie = toxicity.Trie({"worthless": 2.0, "idiot": 1.0}, {"veq": 3.0}, {"worthless", "idiot"})
    for word in ("worthles", "worthlesss", "wurthless", "owrthless", "worhtless", "idiott", "1diot", "idoit"):
        assert trie.near(word), word
    for word in ("worthy", "idea", "thorough", "wrthles"):
        assert trie.near(word) is None, word
    assert trie.exact("vequ") == 3.0 and trie.exact("ve") is None


def edits(a, b):
    """Edit distance with swaps of neighbours, by the table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_by_brute_force():
    """Random lexicons and words of few letters: what the automata find is what the distance table finds."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abc", k=r.randint(5, 9)))
    found = 0
    for _ in range(40):
        terms = {word(): r.random() + 0.1 for _ in range(12)}
        trie = toxicity.Trie(terms, {}, set(terms))
        for _ in range(60):
            w = word()
            near = [v for t, v in terms.items() if edits(t, w) <= 1]
            assert trie.near(w) == (max(near) if near else None), (w, terms)
            found += bool(near)
    assert found > 100


def test_ranking_minimises_the_pairwise_loss():
    """The fitted weights lose less on the pairs than any near them, and order a linear quality right."""
    r = np.random.default_rng(10)
    x = r.standard_normal((400, quality.N_FEATURES))
    truth = r.standard_normal(quality.N_FEATURES)
    good = x @ truth + 0.5 * r.standard_normal(400) > 0
    model = quality.Ranking(x, good, pairs=20_000)
    z = model.standard(x)
    draw = np.random.default_rng(7)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    count = min(20_000, max(5_000, len(better) * len(worse)))
    difference = z[draw.choice(better, count)] - z[draw.choice(worse, count)]
    loss = lambda w: np.logaddexp(0, -difference @ w).sum() + 0.5e-3 * count * (w @ w)
    least = loss(model.weights)
    assert all(loss(model.weights + 0.05 * r.standard_normal(len(truth))) > least for _ in range(50))
    scores = model.score(x)
    assert np.mean(scores[better][:, None] > scores[worse][None, :]) > 0.95


def test_quotation_counts_apart():
    lookup = toxicity.Model({"idiot": 2.0}, {}, {"idiot"}).lookup()
    quoted, plain = toxicity.features('he said "idiot" once', lookup), toxicity.features("you idiot there", lookup)
    assert quoted[4] > 0 and quoted[0] == 0 and plain[0] > 0 and plain[4] == 0


def test_surrogates_of_long_names_and_plain_words(spark):
    """Names of three words and with particles, capitals, plain words and offices, IPv6 and MAC addresses."""
    texts = [
        "Dr. Jean Paul Sartre spoke; Sartre left. JEAN PAUL SARTRE, SARTRE.",
        "Mr. José García; García; JOSÉ GARCÍA",
        "Mr. Will said so. Will you? Will it rain? Free Will",
        "Miss America and Dr. Who: Who are you? Mr President said. President Obama",
        "Herr Ludwig van Beethoven; Beethoven",
        "at 2001:db8:0:12::7 and 2001:0DB8:0000:0012::0007, fe80:1:2:3:4:5:6:7; 00:1a:2B:3c:4d:5e or 00-1A-2B-3C-4D-5E",
        "at 12:34:56 on 2024-01-02, ratio 1:2:3, std::vector and a::b, abc::def",
        "Mr. GARCÍA, then García",
    ]
    out = [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    for text, gone in ((0, ("Jean", "Sartre", "SARTRE")), (1, ("José", "García", "GARCÍA")), (4, ("Ludwig", "Beethoven")), (5, ("db8", "DB8", "fe80", "1a", "2B", "1A")), (7, ("GARCÍA", "García"))):
        assert not [g for g in gone if g in out[text]], out[text]
    family = out[0].split(";")[1].split()[0]
    assert out[0].startswith("Dr. ") and out[0].split(" spoke")[0].endswith(family) and out[0].endswith(f"{family.upper()}.")
    assert out[0].split(". ")[-1].split(",")[0] == out[0][4:].split(" spoke")[0].upper() and len(out[0].split(" spoke")[0].split()) == 4
    assert out[2].startswith("Mr. ") and "Mr. Will" not in out[2] and out[2].endswith(" said so. Will you? Will it rain? Free Will")
    assert out[3] == texts[3] and out[6] == texts[6] and " van " in out[4]
    a, b = out[5].split(" and ")[0].removeprefix("at "), out[5].split(" and ")[1].split(",")[0]
    assert a.startswith("fd") and "::" in a and len(a) == len("2001:db8:0:12::7")
    macs = out[5].split("; ")[1].split(" or ")
    assert macs[0].replace(":", "").lower() == macs[1].replace("-", "").lower() and macs[0].startswith("02:")


def test_license_notices_that_were_edited(spark):
    """Words put in or changed keep the label; a notice that lacks its telling words is another's or none."""
    texts = {
        "licensed under the apache license, the version 2.0": "apache-2.0",
        "Distributed under the MIT License.": "mit",
        "released under the the MIT license": "mit",
        "licensed under the GNU Lesser General Public License version 3": "gpl,lgpl",
        "licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
        "licensed under the GNU General Public License version 2": "gpl,gpl-2.0",
        "licensed under the GNU Affero General Public License, version 3": "agpl-3.0,gpl",
        "licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "licensed under CC BY 4.0": "cc-by",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "we drove under the old bridge, under the mit museum": "",
        "licensed under the terms below": "",
    }
    rows = list(enumerate(texts))
    out = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {texts[t]: out[k] for k, t in rows} == {v: v for v in texts.values()} and [out[k] for k, _ in rows] == list(texts.values())
