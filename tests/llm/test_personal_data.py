import hashlib
import random
import re

from evigraph.llm import personal_data, registry

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")


def passes(digits):
    back = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(back)) % 10 == 0


def plain_spans(text):
    """(kind, start, end) as the contract reads, with Python's regular expressions."""
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    holds = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")),
        "card": lambda m: 13 <= len(digits(m)) <= 19 and passes(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True) for m in p.finditer(text) if holds[k](m)]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def plain_found(texts, rounds=personal_data.ROUNDS):
    """The bootstrapping over a list of texts (repeated ones included) with dictionaries: found spans by text."""
    word = r"[^\s:=0-9@]*[0-9@][^\s:=]*"
    run = re.compile(rf"(?<![^\s:=]){word}(?:\x20{word})*", re.ASCII)
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    counts, occurrences = {}, []
    for text in texts:
        ws = tokens(text)
        for g in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))]:
            counts[g] = counts.get(g, 0) + 1
        matches, base = list(run.finditer(text)), plain_spans(text)
        for i, m in enumerate(matches):
            lead = re.match(r"(?:[^\w@+#]|_)*", m[0]).end()
            v = re.sub(r"(?:\W|_)+\Z", "", m[0][lead:])
            s, digits, letters = m.start() + lead, sum(c in "0123456789" for c in v), sum(c.isalpha() for c in v)
            shaped = digits >= 5 or (digits >= 4 and letters) or ("@" in v and letters >= 2)
            if not shaped or re.search(personal_data.DATE, v) or re.search(personal_data.AMOUNT, v):
                continue
            left = tokens(text[matches[i - 1].end() if i else 0 : m.start()])
            right = tokens(text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)])
            grams = {("before", " ".join(left[-k:])) for k in (1, 2) if len(left) >= k} | {("after", " ".join(right[:k])) for k in (1, 2) if len(right) >= k}
            seed = any(bs < s + len(v) and be > s for _, bs, be in base)
            occurrences.append((text, s, s + len(v), v, grams, seed))
    takes, seeds, score = {}, {}, {}
    for _, _, _, v, grams, seed in occurrences:
        for g in grams:
            takes.setdefault(g, {}).setdefault(v, 0)
            takes[g][v] += 1
            seeds[g, v] = seeds.get((g, v), False) or seed
    for _ in range(rounds):
        accepted = {}
        for g, vs in takes.items():
            rate = {v: 1.0 if seeds[g, v] else score.get(v, 0.0) for v in vs}
            confidence = sum(rate[v] * n for v, n in vs.items()) / max(counts.get(g[1], 0), sum(vs.values()))
            if len(vs) >= 3 and confidence >= personal_data.MIN_CONFIDENCE and sum(rate.values()) >= personal_data.MIN_SUPPORT:
                accepted[g] = confidence
        best = {}
        for g, c in accepted.items():
            for v in takes[g]:
                if not seeds[g, v]:
                    best[v, g[0]] = max(best.get((v, g[0]), 0.0), c)
        score = {v: 1 - (1 - best.get((v, "before"), 0.0)) * (1 - best.get((v, "after"), 0.0)) for v, _ in best}
    out = {t: [] for t in texts}
    for text, s, e in {(t, s, e) for t, s, e, v, _, seed in occurrences if not seed and score.get(v, 0.0) >= personal_data.MIN_SCORE}:
        out[text].append((s, e))
    return {t: sorted(x) for t, x in out.items()}


PIECES = ["a@b.c", "x.y@mail.example.com", "@", "_", "a", "1", "12", ".", "10.0.0.1", "256", "0255", "+", "+1", " ", " ", "-", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "37828224631000", "5", "555-0123", "é", "😀", "\n", "%", "..", "--", "٣"]


def test_base_spans_of_random_texts(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = personal_data.find_personal_data(docs, rounds=1).collect()
    for r in got:
        spans = plain_spans(texts[r["doc_id"]])
        assert (r["base_spans"], [r[f"n_{k}"] for k in KINDS]) == (listed(spans), [sum(x[0] == k for x in spans) for k in KINDS]), texts[r["doc_id"]]
        assert r["spans"].startswith(r["base_spans"])
    assert len(got) == len(texts)


def corpus():
    """Seeds behind labels, unseen identifiers behind the same labels and behind labels that only these lead to, and bait."""
    draw = random.Random(11)
    filler = lambda n: " ".join(draw.choice(["the", "of", "river", "light", "house", "runs", "over", "is", "old", "and"]) for _ in range(n))
    texts = []
    for i in range(12):
        texts.append(f"{filler(6)} patient reachable under user{i}@mail.example.com {filler(5)}")
        texts.append(f"{filler(4)} the +1 (212) 555-01{i:02d} {filler(5)}")  # a seed behind a common word
    for i in range(5):
        texts.append(f"{filler(6)} patient reachable under QX-77{i}41-KD case file {filler(4)}")
        texts.append(f"{filler(3)} registry entry QX-77{i}41-KD {filler(4)}")
    texts.append(f"{filler(3)} registry entry ZZ-90210-AA {filler(4)}")  # found in a second step, by a pattern that only found values teach
    texts += [f"{filler(5)} version 20{i}34 {filler(3)}" for i in range(8)]
    texts += [f"{filler(5)} the 88{i}12345 {filler(3)}" for i in range(4)]
    texts += ["only once near 99887766 and a@b.co near 55443322"] * 40  # copies of one text are no support
    return texts


def test_bootstrapping_equals_brute_force(spark):
    texts = corpus() + ["", "x" * 50_000, "paid 1,234,567 on 2020-01-02 to id 12", " 1 2 3 4 5 6 7", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = plain_found([t or "" for t in texts])
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t or "") + [("found", s, e) for s, e in want[t or ""]]
        assert got[i]["spans"] == listed(spans) and got[i]["n_found"] == len(want[t or ""]), t
    found = {t[s:e] for t, x in want.items() for s, e in x}
    assert {f"QX-77{i}41-KD" for i in range(5)} <= found and "ZZ-90210-AA" in found
    assert not any(v.startswith(("20", "88", "99", "55")) for v in found)
    learned = {(r["side"], r["gram"]) for r in personal_data.learn_patterns(docs).collect()}
    assert {("before", "reachable under"), ("before", "registry entry")} <= learned and ("before", "the") not in learned


def test_counts_join_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    one = sorted(map(str, personal_data.find_personal_data(docs).collect()))
    monkeypatch.setattr(personal_data, "BROADCAST_GRAMS", 0)
    assert sorted(map(str, personal_data.find_personal_data(docs).collect())) == one


LONG = ["1" * 60_000, "1 " * 40_000, "1." * 40_000, "a@" * 40_000, "+1" + " " * 60_000, "-" * 50_000 + "x1", "a.b-c_" * 20_000 + "@", "1-" * 30_000, "x" * 60_000 + "1", "12345 " * 20_000]


def test_long_texts_are_linear(spark):
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(len(LONG))
    for r in personal_data.find_personal_data(docs).collect():
        assert r["base_spans"] == listed(plain_spans(LONG[r["doc_id"]]))


def test_odd_rows(odd, none):
    got = personal_data.find_personal_data(odd)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_found", "base_spans", "spans"]
    assert got.count() == odd.count() and personal_data.find_personal_data(none).count() == 0
    assert all(r["spans"] == "" for r in got.collect())


def test_personal_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    df = registry.op11_personal_data(spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = df.collect()
    assert len(rows) == len(docs)
    found = plain_found(list(docs.values()))
    for r in rows:
        spans = plain_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in spans) for k in KINDS]
        assert r["base_sha256"] == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert r["spans"] == listed(spans + [("found", s, e) for s, e in found[docs[r["doc_id"]]]])
