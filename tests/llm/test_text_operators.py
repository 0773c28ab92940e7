"""Brute-force checks of surrogates, quotation links, signature trees, substring dedup and template decontamination."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from orrery.llm import quotes, signature_tree, substrings, surrogates, templates
from orrery.llm.components import components
from orrery.llm.shingles import shingle_sets
from tests.llm import edge

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(spark, source):
    if source == "sf":
        return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    if source == "edge":
        return edge.documents(spark)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common, base = say(40), say(120).split()
    rows = [(i, say(rng.randint(5, 90))) for i in range(60)] + [(i, say(30) + " " + common + " " + say(rng.randint(0, 60))) for i in range(60, 150)]
    for i in range(150, 260):  # near copies of one text, few of which equal each other
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[i % 7][1]) for i in range(30)] + [(400, "aa " * 400), (401, "ab" * 300), (402, "ab" * 301)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def shingle_set(text, k):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute_components(rows, k, percent):
    sets = {}
    for r in rows:
        sets.setdefault(r["doc_id"], []).append(shingle_set(r["text"], k))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if i is not None]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: None if i is None else find(i) for i in sets}


@pytest.mark.parametrize("source", ["sf", "edge", "made"])
@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_signature_tree(spark, source, k, percent, monkeypatch):
    if (k, percent) == (5, 80):  # small limits: split buckets, several blocks a cluster, frequent shingles
        for name, value in (("BLOCK", 16), ("HOT", 8), ("FOLD", 12), ("CHUNK", 3000)):
            monkeypatch.setattr(signature_tree, name, value)
    docs = documents(spark, source)
    got = signature_tree.group(docs, k, percent).collect()
    rows = docs.select("doc_id", "text").collect()
    want = brute_components(rows, k, percent)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())
    count = lambda pairs: collections.Counter((str(i), n) for i, n in pairs)
    assert count((r["doc_id"], r["n_shingles"]) for r in got) == count((r["doc_id"], len(shingle_set(r["text"], k))) for r in rows)


def test_signature_tree_empty(spark):
    assert signature_tree.group(edge.empty(spark)).count() == 0


def test_shingles_match_words():
    texts = ["A b\x0bC a B c", None, "", "one", "x y", "ä Ä z\n\nq", "a b c " * 5]
    for t, s in zip(texts, shingle_sets(texts, 3)):
        assert len(s) == len(shingle_set(t, 3))
    a, b = shingle_sets(["P q r s", "p Q R s"], 3)
    assert (a == b).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    loops = {a for a, b in edges if a == b}
    assert {n: c for n, c in up.items() if n in got} == got and set(up) - set(got) <= loops


def brute_substrings(rows, length=100):
    known = {}
    for r in sorted(((r["doc_id"] if r["doc_id"] is not None else 1 << 62), (r["text"] or "").encode()) for r in rows):
        known.setdefault(r, None)
    seen, out = {}, {}
    for doc, data in known:
        covered = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                covered[s : s + length] = True
            seen[w] = 1
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        out[(doc, data)] = (len(data), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~covered].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("source", ["sf", "edge", "made"])
def test_substrings(spark, source, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 500)
    docs = documents(spark, source)
    if source == "edge":  # different texts under one id have an order of their own
        docs = docs.where("doc_id is null or doc_id <> 7")
    got = substrings.dedup(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    want = brute_substrings(rows)
    have = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert have == sorted((str(r["doc_id"]), *want[(r["doc_id"] if r["doc_id"] is not None else 1 << 62), (r["text"] or "").encode()]) for r in rows)


@pytest.mark.parametrize("limits", ["batches", "rounds"])
def test_substrings_phrase_in_all_documents(spark, monkeypatch, limits):
    """A phrase too short to be removed, in all documents with other words around it, and at times with 40 or 70 bytes more in common."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    phrase, before, after = noise(64), noise(60), noise(90)
    rows = [(i, noise(rng.randint(60, 130)) + (before if i % 3 == 0 else "") + phrase + (after[: rng.choice([10, 40, 70])] if i % 4 == 0 else "") + noise(rng.randint(60, 130))) for i in range(700)]
    monkeypatch.setattr(substrings, "CHUNK", 100)
    monkeypatch.setattr(substrings, "FREQUENT", 50 if limits == "batches" else 1 << 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_substrings([{"doc_id": i, "text": t} for i, t in rows])
    got = substrings.dedup(docs).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((i, *want[i, t.encode()]) for i, t in rows)
    assert 0 < sum(r["n_removed"] > 0 for r in got) < 700


def test_substrings_edges(spark):
    assert substrings.dedup(edge.empty(spark)).count() == 0
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh ") for _ in range(150))
    two = spark.createDataFrame([(5, t), (5, t), (6, "z" + t), (None, t)], "doc_id long, text string")
    got = substrings.dedup(two).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["n_spans"]) for r in got) == [("5", 0, 0), ("5", 0, 0), ("6", 150, 1), ("None", 150, 1)]
    both = spark.createDataFrame([(5, t), (5, t + "z")], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in substrings.dedup(both).collect()) in ([(150, 0), (151, 150)], [(150, 150), (151, 0)])


def test_anchor_in_every_window():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(5000)) + b"x" * 300
    place, _ = substrings.anchors(data)
    chosen = set(place.tolist())
    assert all(any(p in chosen for p in range(s, s + substrings.REACH + 1)) for s in range(len(data) - 99))
    moved, _ = substrings.anchors(b"q" * 77 + data)
    assert {p + 77 for p in chosen if p > 200} <= set(moved.tolist())


@pytest.mark.parametrize("shallow", [0, 1, 3, 13])
def test_deep_shallow_order(shallow):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (400, 100)).astype(np.uint8)
    rows[100:300] = rows[0]
    for i in range(100, 300):
        rows[i, rng.integers(0, 100)] = rng.integers(0, 256)
    order, lcp = substrings.suffix_order(rows, shallow)
    assert sorted(order.tolist()) == list(range(400))
    ordered = [rows[i].tobytes() for i in order]
    assert ordered == sorted(ordered) and lcp[0] == 0
    for i in range(1, 400):
        same = next((k for k in range(100) if ordered[i][k] != ordered[i - 1][k]), 100)
        assert lcp[i] == same


PII = [
    (1, "Call +1 (017) 555-7713 or +1 017 555 7713, mail Ann.Lee@mail7.example.com and ann.lee@MAIL7.example.com."),
    (2, "card 4485168114407329 and 4485 1681 1440 7329; valid 4111 1111 1111 1111; ip 10.20.30.40."),
    (3, "Mrs. Smith met Mr Smith and Mrs Smith; Anna Berg wrote. Г-н Иванов, г-жа Иванова. ssn 123-45-6789"),
    (4, 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" iban DE44500105175407324931'), (5, None), (6, ""), (7, "no entities 12 here"), (None, "ip 10.20.30.40"), (8, "34@mail7.example.com 35@mail7.example.com"),
]


def test_surrogates(spark):
    docs = spark.createDataFrame(PII, "doc_id long, text string").selectExpr("*", "'x' as n_entities", "'k' as canon", "'p' as pos")
    got = {r["doc_id"]: r for r in surrogates.replace(docs).collect()}
    assert len(got) == len(PII) and got[5]["text"] is None and got[6]["text"] == "" and got[7]["text"] == "no entities 12 here" and got[7]["n_entities"] == 0
    text = {i: r["text"] for i, r in got.items()}
    for old in ("555-7713", "mail7", "4485", "10.20.30.40", "Smith", "Anna Berg", "123-45-6789", "9b0b3c6a", "DE44500105175407324931"):
        assert not any(old in (t or "") for t in text.values()), old
    a = re.search(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4}), mail (\S+@\S+) and (\S+@\S+)\.$", text[1])
    assert a.groups()[:3] == a.groups()[3:6] and a[7].lower() == a[8].lower()
    b = re.search(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}); valid (\d{4} \d{4} \d{4} \d{4}); ip (\S+)\.$", text[2])
    assert b[1] == b[2].replace(" ", "")
    digits = [int(c) for c in b[3].replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert text[None] == f"ip {b[4]}" and all(0 <= int(x) <= 255 for x in b[4].split("."))
    c = re.search(r"^Mrs\. (\w+) met Mr (\w+) and Mrs (\w+); (\w+) (\w+) wrote\. Г-н (\w+), г-жа (\w+)\. ssn \d{3}-\d{2}-\d{4}$", text[3])
    assert c[1] == c[2] == c[3] and c[6] != 'Иванов' and c[4] in surrogates.GIVEN["latin", "f"] and re.fullmatch(r"[А-Яа-я]+", c[7])
    assert re.search(r'token = "[0-9a-f]{40}" iban DE[0-9A-Z]{20}$', text[4])
    x, y = text[8].split()
    assert x != y and x.split("@")[1] == y.split("@")[1]
    again = {r["doc_id"]: r["text"] for r in surrogates.replace(docs).collect()}
    assert again == text and surrogates.replace(docs, key="other").where("doc_id = 2").first()["text"] != text[2]
    assert surrogates.replace(edge.empty(spark)).count() == 0
    same = lambda df: sorted(map(str, df.collect()))
    odd = surrogates.replace(edge.documents(spark))
    assert same(odd.drop("n_entities")) == same(edge.documents(spark)) and not odd.where("n_entities <> 0").count()
    long = "no one here " * 20_000 + "mail q@mail7.example.com " + "no one here " * 20_000
    row = surrogates.replace(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")).collect()
    assert row[0] == row[1] and row[0]["n_entities"] == 1 and "mail7" not in row[0]["text"] and row[0]["text"].count("no one here ") == 40_000


def test_surrogates_glued_to_a_word(spark):
    glued = [("SSN", "123-45-6789"), ("card", "4485168114407329"), ("ip", "10.20.30.40"), ("fax", "017-555-7713"), ("tel", "+1 (017) 555-7713"), ("", "q" * 70 + "@mail7.example.com")]
    docs = spark.createDataFrame([(i, f"see {word}{number}.") for i, (word, number) in enumerate(glued)], "doc_id long, text string")
    for r in surrogates.replace(docs).collect():
        word, number = glued[r["doc_id"]]
        assert r["n_entities"] == 1 and r["text"].startswith(f"see {word}") and number[-14:] not in r["text"], r


def test_surrogate_collisions(spark):
    """Nearly all short numbers are taken: attempts go on until every entity has one of its own that is no entity."""
    names = spark.range(600).selectExpr("'ssn' as kind", "lpad(cast(id as string), 3, '0') as canon")
    rows = surrogates.assign(names.where("canon < '400'")).collect()
    used = {r["surrogate"] for r in rows}
    assert len(used) == len(rows) == 400 and not used & {f"{i:03d}" for i in range(400)}


def test_surrogate_phones_are_distinct_as_rendered(spark):
    phones = [f"+999 {i // 100:02d} {i % 100:02d}" for i in range(3000)]
    rest = ["+1 0175557713", "+10175557713", "+1 (017) 555-7713", "+49 30 12 34 56", "+4930123456"]
    entity = spark.createDataFrame([(e,) for e in phones + rest], "entity string").withColumn("kind", surrogates.F.lit("phone"))
    mentions = entity.withColumn("canon", surrogates.canonical(surrogates.F.col("entity"), surrogates.F.col("kind")))
    shown = mentions.join(surrogates.assign(mentions), ["kind", "canon"]).withColumn("to", surrogates.render(*map(surrogates.F.col, ("entity", "kind", "surrogate"))))
    to = {r["entity"]: r["to"] for r in shown.collect()}
    assert len({to[p] for p in phones}) == 3000 and not {to[p] for p in phones} & set(phones) and all(to[p].startswith("+999 ") for p in phones)
    digits = [re.sub(r"\D", "", to[e]) for e in rest]
    assert digits[0] == digits[1] == digits[2] and digits[0][0] == "1" and digits[3] == digits[4] and digits[3][:2] == "49"


def test_surrogate_space_grows(spark):
    """More surnames of a class than four syllables make, and more numbers than their format has."""
    names = spark.range(70_000).selectExpr("'family' as kind", "concat('x', cast(id as string)) as canon")
    codes = spark.range(900).selectExpr("'ssn' as kind", "lpad(cast(id as string), 3, '0') as canon")
    rows = surrogates.assign(names.unionByName(codes)).collect()
    assert len(rows) == len({(r["kind"], r["surrogate"]) for r in rows}) == 70_900 and not {(r["kind"], r["canon"]) for r in rows} & {(r["kind"], r["surrogate"]) for r in rows}
    longer = spark.createDataFrame([("123", "ssn", "45678")], "entity string, kind string, surrogate string").select(surrogates.render(*map(surrogates.F.col, ("entity", "kind", "surrogate"))))
    assert longer.first()[0] == "45678"


def test_surrogate_coreference(spark):
    rows = [
        "Anna Berg met Mrs Berg and Dr. Berg. MRS BERG", "My name is Heinrich Zweig.", "On Monday Yuki Tanaka wrote: ok", "Yuki Tanaka <y.t@mail7.example.com>", "Dear Heinrich Zweig, and Hello World", "Г-н Петров и г-жа Петрова",
        "+1 555 123 4567 or (555) 123-4567 or 555-123-4567; +49 30 1234567 or +49 030 1234567", "DE89 3704 0044 0532 0130 00 and DE89370400440532013000; bad DE00370400440532013000", "fe80::1ff:fe23:4567:890a and 2001:0db8:85a3:0000:0000:8a2e:0370:7334; at 12:30:45, std::vector a::b",
        "Mr O'Neil-Smith, Mr Oak", "Maria Berg and Anna Berg",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    t = {r["doc_id"]: r["text"] for r in surrogates.replace(docs).collect()}
    a = re.fullmatch(r"(\w+) (\w+) met Mrs (\w+) and Dr\. (\w+)\. MRS BERG", t[0])
    assert a[1] in surrogates.GIVEN["latin", "f"] and a[2] == a[3] == a[4] and "Berg" not in a[0].split(" met")[0]
    b = re.fullmatch(r"My name is (\w+) (\w+)\.", t[1])
    assert re.fullmatch(rf"Dear {b[1]} {b[2]}, and Hello World", t[4]) and {b[1], b[2]}.isdisjoint({"Heinrich", "Zweig"})
    c = re.fullmatch(r"On Monday (\w+ \w+) wrote: ok", t[2])
    assert t[3].startswith(c[1] + " <") and c[1] != "Yuki Tanaka" and "mail7" not in t[3]
    d = re.fullmatch(r"Г-н (\w+ов) и г-жа (\w+ова)", t[5])
    assert d and "Петров" not in t[5]
    e = [re.sub(r"\D", "", x) for x in re.split(r" or |; ", t[6])]
    assert e[0] == "1" + e[1] and e[1] == e[2] != "5551234567" and e[3][:2] == "49" and e[4] == "490" + e[3][2:]
    f = re.fullmatch(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (DE\d{20}); bad (DE\d{20})", t[7])
    assert f[1].replace(" ", "") == f[2] and int(f[2][4:] + "1314" + f[2][2:4]) % 97 == 1 and f[3] != f[2]
    g = re.fullmatch(r"(\S+) and (\S+); at 12:30:45, std::vector a::b", t[8])
    import ipaddress

    assert len({ipaddress.ip_address(x) for x in g.groups()}) == 2 and "fe80" not in t[8]
    assert "Neil" not in t[9] and "Oak" not in t[9]
    h = re.fullmatch(r"(\w+) (\w+) and (\w+) (\w+)", t[10])
    assert h[2] == h[4] == a[2] and h[3] == a[1] != h[1]


def test_surrogates_against_brute_force(spark):
    """Over whole documents: what isn't an entity stays, equal entities get equal surrogates, others others, and none is an entity of the corpus."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    numbers = [f"call +1 ({i % 900 + 100}) 555-{i:04d} or {i % 900 + 100}-555-{i:04d}, card {4000_0000_0000_0000 + 7919 * i}, mail a{i}@b{i % 50}.org, Dr Xu{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}o" for i in range(800)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(numbers)], "doc_id long, text string"))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    find = regex.compile(surrogates.PATTERN)
    title = regex.compile(rf"^(?:{surrogates._T})\.? ")

    def form(entity):
        if regex.search(r"^\+|^\(|^\d{3}[.-]\d{3}[.-]\d{4}$", entity):
            return "phone", regex.sub(r"\D", "", entity)[-10:]
        return ("number", regex.sub(r"[ -]", "", entity)) if regex.fullmatch(r"[\d -]+", entity) else ("name", title.sub("", entity).lower()) if title.search(entity) else ("text", entity.lower())

    to, n = {}, 0
    for r in surrogates.replace(docs).collect():
        text, entities = before[r["doc_id"]] or "", list(find.finditer(before[r["doc_id"]] or ""))
        assert r["n_entities"] == len(entities)
        ends = [m.end() for m in entities]
        pieces = [text[a:m.start()] for a, m in zip([0, *ends], entities)] + [text[ends[-1] if ends else 0 :]]
        got = regex.fullmatch("(.+?)".join(map(regex.escape, pieces)), r["text"] or "", flags=regex.DOTALL)
        assert got, (text, r["text"])
        for m, new in zip(entities, got.groups()):
            n += 1
            assert to.setdefault(form(m[0]), form(new)) == form(new), (m[0], new)
    assert n > 4000 and len(set(to.values())) == len(to) and not set(to) & set(to.values())


def test_quotation_links(spark):
    rows = [
        (1, 0, "user", "First question?\nWith two lines."), (1, 1, "assistant", "An answer."), (1, 2, "user", "> first   QUESTION?\n> With two lines.\nMore on the first."),
        (1, 3, "assistant", "> More on the first.\n>> First question?\nReply to it."), (1, 4, "user", "> An answer.\nThanks"), (1, 5, "user", "> unknown words\nalone"), (1, 6, "user", None),
        (2, 0, "user", "An answer."), (2, 1, "user", ""), (None, 0, "user", "> An answer."), (3, None, "user", "x"), (4, 0, "user", "again"), (4, 1, "user", "again"), (4, 2, "user", "> again"), (4, 2, "user", "> again"),
    ]
    docs = spark.createDataFrame([(*r, "e", "l") for r in rows], "conv_id long, turn long, role string, text string, thread string, lines string")
    got = quotes.link(docs).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    want = {(1, 0): (None, 0, 0), (1, 1): (None, 1, 0), (1, 2): (0, 0, 1), (1, 3): (2, 0, 2), (1, 4): (1, 1, 1), (1, 5): (None, 5, 0), (1, 6): (None, 6, 0), (4, 2): (1, 1, 1), (None, 0): (None, 0, 0), (3, None): (None, None, 0)}
    for k, v in want.items():
        assert (by[k]["reply_to"], by[k]["thread"], by[k]["depth"]) == v, k
    assert by[1, 2]["text"] == "More on the first." and by[1, 3]["text"] == "Reply to it." and by[1, 3]["quote_levels"] == 2 and by[1, 0]["text"] == rows[0][3]
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order == [0, 2, 3, 1, 4, 5, 6]
    for c in {r["conv_id"] for r in got}:
        own = sorted(r["position"] for r in got if r["conv_id"] == c)
        assert own == list(range(len(own)))
    assert quotes.link(edge.empty(spark, docs.schema)).count() == 0


def test_quotation_levels_and_passages(spark):
    rows = [
        (1, 0, "An answer."), (1, 1, "Some words\nthat go on"), (1, 2, "> Bob wrote:\n>> An answer.\nreply"), (1, 3, "> an edited line\n>> Some words\n>> that go on\nmore"),
        (1, 4, "> Some words that\n> go on\nyes\n> or another block\nno"), (1, 5, "> Bob wrote:\n> Some\n>> An answer.\n> words that go on\nx"), (1, 6, "> more\n>> An answer.\ny"), (1, 7, "> Some words\n> that go\n> on\n>> unknown\n> also unknown\nz"),
    ]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert {r["turn"]: r["reply_to"] for r in got} == {0: None, 1: None, 2: 0, 3: 1, 4: 1, 5: 0, 6: 3, 7: 1}


def talk(conv, n, rng):
    """A conversation in which messages quote earlier ones, whole, by a block or by a line, at one or two levels, at times edited."""
    words = "lime plum fig oat rye corn bean leek kale beet".split()
    out = []
    for turn in range(n):
        text = []
        for _ in range(rng.randint(0, 2) if turn else 0):
            lines = [x for x in out[rng.randrange(turn)][2].split("\n") if rng.random() < 0.9]
            at = rng.randrange(len(lines) + 1)
            text += [rng.choice(("> ", ">")) + (x.upper() if rng.random() < 0.2 else x) for x in (lines if rng.random() < 0.5 else lines[at : at + 2])]
            if rng.random() < 0.5:
                text.append(rng.choice(("", "so " + rng.choice(words), "> someone wrote:")))
        text += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 3))]
        out.append((conv, turn, "\n".join(text)))
    return out


def test_quotation_sql(spark):
    """The registered tables have no quotes: here most messages have, at several levels."""
    import duckdb

    rng = random.Random(6)
    rows = [(1, 0, "Alpha beta\ngamma"), (1, 1, "Delta"), (1, 2, "> alpha BETA\n> gamma\nown"), (1, 3, "> own\n> > Delta\nlast"), (1, 4, "> edited\n>> alpha beta\n>> gamma\nx"), (2, 0, "> Delta\nx"), (2, 1, "> x\ny"), (2, 2, None)]
    for conv in range(3, 40):
        rows += talk(conv, 9, rng)
    rows += [(50, 0, "the passage")] + [(50, i, "> the passage\nyes " + str(i)) for i in range(1, 60)]
    docs = spark.createDataFrame([(a, b, "u", t) for a, b, t in rows], "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, 'u', ?)", [list(r) for r in rows])
    want = con.execute(f"SELECT conv_id, turn, role, text, reply_to, thread, depth, quote_levels, n_quoted_lines, position FROM ({quotes.SQL})").fetchall()
    got = [tuple(r) for r in quotes.link(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[4] is not None for r in got) > 150 and max(r[6] for r in got) > 3 and max(r[7] for r in got) > 1


def test_quotation_of_long_texts(spark):
    """Very long messages, a long chain of replies, and a column named like a helper."""
    long = "\n".join(f"line {i} of a long message" for i in range(20_000))
    rows = [(1, 0, long), (1, 1, "\n".join("> " + x for x in long.split("\n")) + "\nshort")] + [(2, i, (f"> step {i - 1}\n" if i else "") + f"step {i}") for i in range(200)]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, text string, h long, root long")).collect()}
    assert got[1, 1]["reply_to"] == 0 and got[1, 1]["text"] == "short" and got[1, 1]["n_quoted_lines"] == 20_000 and got[1, 0]["text"] == long
    assert all(got[2, i]["depth"] == i and got[2, i]["thread"] == 0 and got[2, i]["position"] == i and got[2, i]["root"] == 2 for i in range(200))


def test_templates(spark):
    say = "the quick brown fox jumps over a lazy dog near the old stone bridge while {} birds sing at {} km from Berlin and {} birds rest"
    bench = spark.createDataFrame([(1, say.format(12, 30, 12)), (2, "too short"), (3, None), (4, "nothing of this kind is in any of the documents that we test here today at all"), (4, "nothing of this kind is in any of the documents that we test here today at all")], "item_id long, text string")
    filler = "some other words go here and are not in any item of the set "
    docs = spark.createDataFrame(
        [(1, filler + say.format(12, 30, 12)), (2, filler + say.format(99, 7, 99).replace("Berlin", "Paris") + filler), (3, filler + say.format(99, 7, 5)), (4, filler), (5, None), (6, ""), (7, filler + "the quick brown fox jumps over a lazy dog near"), (None, say.format(12, 30, 12)), (1, filler + say.format(12, 30, 12))],
        "doc_id long, text string",
    ).selectExpr("*", "1 as item_id", "'h' as h", "'t' as tokens")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in templates.find(docs, bench).collect()}
    assert got[1, 1] == "verbatim" and got[2, 1] == "re-parameterised" and set(i for i, _ in got) <= {1, 2, 3}
    strict = {r["doc_id"] for r in templates.find(docs, bench, agree=0.99).collect()}
    assert strict == {1, 2}
    assert {r["doc_id"] for r in templates.clean(docs, bench).collect()} >= {4, 5, 6, 7, None} and templates.clean(docs, bench).columns == docs.columns
    for a, b in ((edge.empty(spark), bench), (docs, bench.limit(0))):
        assert templates.find(a, b).count() == 0
    assert templates.find(edge.documents(spark), bench).count() == 0


def test_templates_in_blocks_of_the_benchmark(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, templates.find(docs, bench).collect()))
    monkeypatch.setattr(templates, "BLOCK", 1000)
    assert whole and sorted(map(str, templates.find(docs, bench).collect())) == whole


def test_templates_names_and_numbers(spark):
    """Names that begin a sentence or have two words, number words, other languages, short items, cases and marks."""
    one = "Sarah has 12 apples and buys 7 more at the market. Sarah gives 4 of them to Tom Brown. How many apples does Sarah have left?"
    two = "Mary Jones and John Smith drove 60 km to the coast on Monday, then Mary Jones walked sixteen miles back while John Smith slept near the old mill."
    drei = "Der alte Bauer hat einundzwanzig Kühe und vierzig Schafe, verkauft davon sieben Kühe und gibt dem Nachbarn zwanzig Schafe zurück, bevor der Winter kommt."
    items = [(1, one), (2, two), (3, drei), (4, "What is 17 times 23?"), (5, "3, 5, 8, 13, 21, 34, 55, 89, 144"), (6, "Yes"), (7, "?!")]
    say = "some other words go here and are not in any item. "
    docs = [
        (10, say + one), (11, say + one.replace("Sarah", "Emma").replace("Tom Brown", "Li Wei Chen").replace("12", "31")), (12, one.lower() + say), (13, one.upper()), (14, one.replace("12", "twelve").replace("4 of", "twenty-one of")),
        (20, two), (21, two.replace("Mary Jones", "Ann Lee").replace("John Smith", "Carl").replace("sixteen", "fourteen")), (22, two.replace("sixteen", "one hundred and two").replace("one hundred and two", "forty two")),
        (30, drei.replace("einundzwanzig", "dreiunddreißig").replace("vierzig", "90")), (40, say + "what is 17 times 23"), (41, "What is 18 times 29?"), (50, "so 3 5 8 13 21 34 55 89 144 on"), (51, "3, 5, 8, 13, 21, 34, 55, 89, 145, 3"), (60, "yes!"), (61, "Yes it is"),
        (70, " ".join(one.split()[:12])), (71, one[:60]), (72, say * 3),
    ]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in templates.find(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    same, other = "verbatim", "re-parameterised"
    want = {
        (10, 1): same, (11, 1): other, (12, 1): same, (13, 1): same, (14, 1): other, (20, 2): same, (21, 2): other, (22, 2): other, (30, 3): other, (40, 4): same, (50, 5): same, (60, 6): same,
        (51, 5): "partial",
    }
    assert {k: v for k, v in got.items() if k[0] < 70} == want and not any(d == 72 for d, _ in got)


def test_templates_recall_of_changed_items(spark):
    """Of word problems with other names, numbers and units, at least 0.9 are found, and none of different problems."""
    rng = random.Random(8)
    nouns = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    names, counts = ["Anna", "Boris Klein", "Chen", "Dora", "Emil Stone", "Fatima"], ["3", "12", "forty", "1,250", "seven", "two hundred", "twenty-one"]
    shape = lambda: [rng.choice(("n", "n", "n", "n", "N", "#", ".")) for _ in range(45)]
    fill = lambda shape, words, who, many: " ".join({"N": who[i % 2], "#": many[i % 3], ".": "."}.get(c) or words[i] for i, c in enumerate(shape))
    items, docs = [], []
    for k in range(40):
        form, words = shape(), [rng.choice(nouns) for _ in range(45)]
        items.append((k, fill(form, words, rng.sample(names, 2), rng.sample(counts, 3))))
        docs.append((k, "lead in text. " + fill(form, words, rng.sample(names, 2), rng.sample(counts, 3)) + " . and so on"))
        docs.append((100 + k, fill(form, [rng.choice(nouns) for _ in range(45)], names[:2], counts[:3])))
    got = {(r["doc_id"], r["item_id"]) for r in templates.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((k, k) in got for k in range(40)) >= 36 and all(d == i for d, i in got), got


def test_templates_find_planted_items(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r["doc_id"] for r in templates.find(docs, bench).collect()}
    items = [r["text"] for r in bench.collect()]
    plain = {r["doc_id"] for r in docs.collect() if any(i in r["text"] for i in items)}
    assert plain <= got
    own = lambda t: {tuple(w[i : i + 8]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 7)}
    windows = set().union(*map(own, items))
    assert all(own(r["text"]) & windows for r in docs.collect() if r["doc_id"] in got)


def test_levels_of_frequent_shingles(spark, monkeypatch):
    counts = spark.range(1000).selectExpr("id as token", "60 + id as n")
    table = signature_tree.levels(counts)
    of = table[signature_tree.slots(np.arange(1000, dtype=np.uint64), len(table))]
    assert (of[:5] == 0).all() and (of[5:196] == 1).all() and (of[200:960] >= 2).all() and of.max() == 3
    monkeypatch.setattr(signature_tree, "SLOTS", 1 << 13)
    assert (signature_tree.levels(counts) > 0).sum() > 800
    monkeypatch.setattr(signature_tree, "SLOTS", 1 << 12)  # room for 1,024 of 4,096
    monkeypatch.setattr(signature_tree, "HOT", 1)
    crowded = signature_tree.levels(spark.range(5000).selectExpr("id as token", "id + 2 as n"))
    assert (crowded > 0).sum() <= 1024
    assert not signature_tree.levels(counts.limit(0)).any()
