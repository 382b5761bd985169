import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import registry, secrets, token_count


def plain_spans(text):
    out = []
    for kind, pattern, flags in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), (1, r"AKIA[A-Z0-9]+", 0), (2, r"[0-9a-f]+", 0),
    ):
        at = 0
        while m := re.compile(pattern, flags).search(text, at):
            size = len(m[2]) if kind == 0 else m.end() - m.start()
            if size >= (6, 20, 24)[kind]:
                out.append((m.start(), kind, m.end()))
            at = m.end()
    return sorted(out)


PIECES = st.sampled_from(["password", "PassWD", "secret", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "xyz", "\n", "_", "hunter22", "ſecret"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert secrets.base_spans(text) == plain_spans(text)


def test_novelty_reports_random_keys_only():
    novelty = secrets.Novelty()
    found = lambda t: secrets.novel_spans(t, secrets.base_spans(t), novelty)
    assert found("the session credential 9fKx82Lq0ZrT7vBn3WmYa41") == [(23, 46)]
    assert found("auth aaaaaaaaaaaaaaaaaaaaaaaaaaaa11") == []
    assert found("nothing here 9fKx82Lq0ZrT7vBn3WmYa41") == []
    assert found("password=9fKx82Lq0ZrT7vBn3WmYa41") == []


ALPHABETS = {
    "digits": "0123456789", "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower and digits": "abcdefghijklmnopqrstuvwxyz0123456789", "base62": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
}


@pytest.mark.parametrize("name", sorted(ALPHABETS))
def test_random_keys_of_every_alphabet_and_length(name):
    draw, novelty = random.Random(9), secrets.Novelty()
    for size in (16, 20, 24, 32, 40, 48, 64, 96, 128, 256):
        found = 0
        for _ in range(40):
            text = f"the auth key for this service is {''.join(draw.choice(ALPHABETS[name]) for _ in range(size))} and no other"
            found += secrets.novel_spans(text, [], novelty) == [(33, 33 + size)]
        assert found >= 38, (size, found)


def test_long_runs_that_are_no_keys():
    novelty = secrets.Novelty()
    for run in ("0" * 64, "1234567890" * 6, "abcdefghijklmnopqrstuvwxyz" * 2, "deadbeef" * 8, "application/x-www-form-urlencoded", "secretsecretsecretsecretsecretsecret"):
        assert secrets.novel_spans(f"the auth key is {run} here", [], novelty) == [], run


def test_secrets_of_odd_rows(odd, none):
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == odd.count()
    assert {r["base_spans"] for r in rows if r["doc_id"] == 7} == {"assign:0:17"}
    assert all(r["spans"] == "" for r in rows if r["doc_id"] in (3, 4))
    assert secrets.find_secrets(none).count() == 0


def test_secret_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.op4_secrets(spark, sf_dir).collect():
        spans = plain_spans(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        every = [x.split(":") for x in r["spans"].split(",") if x]
        assert ",".join(":".join(x) for x in every if x[0] != "novel") == listed
        key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=~-")
        text = docs[r["doc_id"]] or ""
        assert all(set(text[int(s) : int(e)]) <= key and int(e) - int(s) >= 16 for k, s, e in every if k == "novel")
        assert [int(x[1]) for x in every] == sorted(int(x[1]) for x in every)


def test_time_is_linear_in_the_secrets_of_a_text():
    novelty, took = secrets.Novelty(), []
    for n in (50_000, 100_000):
        text, began = "password=hunter2hunter22 " * n, time.process_time()
        assert secrets.novel_spans(text, secrets.base_spans(text), novelty) == []
        took.append(time.process_time() - began)
    assert took[1] < 0.2 + 4 * took[0] and took[1] < 10


def greedy(pieces, word, longest=None):
    known, longest, i, n = pieces if longest else set(pieces), longest or max(map(len, pieces)), 0, 0
    while i < len(word):
        for size in range(min(longest, len(word) - i), 0, -1):
            if word[i : i + size] in known:
                i, n = i + size, n + 1
                break
        else:
            n += len(word[i].encode())
            i += 1
    return n


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abcéz", max_size=16))
def test_automaton_counts_greedy_pieces(pieces, word):
    assert token_count.Automaton(pieces).count(word) == greedy(pieces, word)


def test_token_counts(spark, sf_dir, odd, none):
    pieces = token_count.read_pieces(registry.TOKENIZER_PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    made = {r["doc_id"]: r for r in registry.op6_token_counts(spark, sf_dir).collect()}
    cost, known, longest = {}, set(pieces), max(map(len, pieces))
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cost |= {w: greedy(known, token_count.WORD_MARK + w, longest) for w in set(words) - set(cost)}
        assert made[i]["n_words"] == len(words)
        assert made[i]["n_tokens"] == sum(cost[w] for w in words)
    assert token_count.count_tokens(odd, registry.TOKENIZER_PATH).count() == odd.count()
    assert token_count.count_tokens(none, registry.TOKENIZER_PATH).count() == 0


def test_novelty_decides_for_every_alphabet_and_either_side():
    novelty = secrets.Novelty()
    found = lambda t: [t[s:e] for s, e in secrets.novel_spans(t, secrets.base_spans(t), novelty)]
    for key in ("qZxWvKpTrJmNbHgL", "fKxqLwZrTbVnBpWmYaQ3", "8203957146620391", "XQZJWKVHPYGBMDTR"):
        for text in ("the auth {} was sent", "{} is the passphrase", "Bearer {}", "credential {}"):
            assert found(text.format(key)) == [key]
        assert found(f"nothing here {key} at all") == []
    for plain in ("authorization-credential-private_key", "getUserAccountConfiguration", "----------------------", "1111111111111111111"):
        assert found(f"the auth {plain} was sent") == []
