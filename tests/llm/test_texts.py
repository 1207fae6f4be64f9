"""Quality rules, PII, URL filter, chat formatting: small fixtures with nulls, empties, ties, repeats, clashing columns."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidespan.llm import chat_format, pii_surrogates, quality_rules, url_filter

PROSE = "the cat of the house and the dog in a garden is that it was for to be of and the sun in the sky " * 6
HARD = [None, "", "   \n\t ", "one", "a b c", "x " * 20_000, "Ünï çødé\u00a0word\u3000word", "same\nsame\n\nsame\n", PROSE]


def brute_quality(t):
    t = t or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(zip(words, words[1:], words[2:]))
    cover = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    n = len(words)
    failed = n < 50 or 100 * len(cover) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed


def test_quality_base(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(HARD + HARD[-2:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(t), t
        assert not (r["base_failed"] and r["kept"])


def test_quality_divergence(spark):
    import random

    rng = random.Random(1)
    common = quality_rules.COMMON_WORDS["en"]
    clean = [" ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)) for _ in range(30)]
    junk = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) + "%%%" for _ in range(300))]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality_rules.keep_good(df).collect()} == set(range(30))
    assert quality_rules.keep_good(df.limit(0)).count() == 0
    assert quality_rules.keep_good(df.drop("lang")).columns == ["doc_id", "text"]
    odd = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx"))
    assert quality_rules.judge(odd).count() == 31


PII = [
    ("mail me at anna.b+7@mail3.example.com now", "anna.b+7@mail3.example.com"),
    ("ANNA.B+7@MAIL3.EXAMPLE.COM", "ANNA.B+7@MAIL3.EXAMPLE.COM"),
    ("call +1 (974) 555-3436 or 974-555-3436", "555-3436"),
    ("card 4111 1111 1111 1111 end", "4111 1111 1111 1111"),
    ("host 97.51.17.173!!", "97.51.17.173"),
    ('token = "908038b7daaf91e4908038b7daaf91e4"', "908038b7daaf91e4"),
    ("ssn 123-45-6789.", "123-45-6789"),
    ("Mrs. Jane Smith met Herr Otto Braun", "Jane Smith"),
    ("Госпожа Анна Иванова", "Анна Иванова"),
    ("iban DE44 5001 0517 5407 3249 31 ok", "5001 0517"),
]


def test_pii(spark):
    rows = [(i, t, "z") for i, (t, _) in enumerate(PII)] + [(90, None, "z"), (91, "", "z"), (92, "clean text, version 3.0, 2004", "z"), (0, PII[0][0], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, entity_types string")
    found = pii_surrogates.replace_pii(df, "k").collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for i, (t, secret) in enumerate(PII):
        assert secret not in got[i]["text"] and got[i]["n_entities"] >= 1, (t, got[i])
        assert [c.isspace() for c in got[i]["text"]].count(True) == [c.isspace() for c in t].count(True) or "97.51" in t
    assert got[90]["text"] is None and got[91]["text"] == "" and got[92]["text"] == rows[-2][1] and got[92]["n_entities"] == 0
    # coreference across case; format; Luhn; gender and script
    assert got[0]["text"].split()[3].upper() == got[1]["text"]
    digits = re.sub(r"\D", "", got[3]["text"])
    assert len(digits) == 16 and sum((int(c) if i % 2 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(digits)) % 10 == 0
    assert got[7]["text"].split()[1] in pii_surrogates.GIVEN["f", "latin"] and got[7]["text"].split()[5] in [n for n in pii_surrogates.GIVEN["m", "latin"]]
    assert got[8]["text"].split()[1] in pii_surrogates.GIVEN["f", "cyrillic"]
    # another key, other surrogates; the same key, the same
    again = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_pii(df, "k").collect()}
    assert again == {k: r["text"] for k, r in got.items()}
    assert {r["doc_id"]: r["text"] for r in pii_surrogates.replace_pii(df, "k2").collect()}[4] != got[4]["text"]
    assert pii_surrogates.replace_pii(df.limit(0), "k").count() == 0


def test_pii_collisions_are_resolved(spark, monkeypatch):
    # one first candidate for all: the second attempt must part them, by both ways of carrying attempts
    real = pii_surrogates.surrogates

    def clashing(items, secret):
        return F.transform(real(items, secret), lambda e: F.struct(*[e[n].alias(n) for n in ("type", "key", "attempt", "head", "body")], F.when(e["attempt"] == 0, F.lit("1.1.1.1")).otherwise(e["new"]).alias("new")))

    monkeypatch.setattr(pii_surrogates, "surrogates", clashing)
    texts = [f"at 10.0.0.{i} x" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (2000, 3):
        got = [r["text"] for r in pii_surrogates.replace_pii(df, "k", inline_limit=limit).collect()]
        assert len(set(got)) == 20 and not set(got) & set(texts)


def test_pii_long_secrets(spark):
    import random

    rng = random.Random(6)
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    long, hexa = key("abcXYZ019+/_-", 700), key("0123456789abcdef", 600)
    texts = [f"token={long}", f"token={long}x1", f"id {hexa} end"]
    got = [r["text"] for r in pii_surrogates.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()]
    for t, g in zip(texts, got, strict=True):
        assert len(g) == len(t) and not any(t[i : i + 12] in g for i in range(7, len(t) - 12))
    # secrets that share their first letters are two
    assert got[0][6:80] != got[1][6:80]


def test_pii_phones_of_one_code(spark):
    # a few free digits after the code: written surrogates are distinct and no number of the corpus
    texts = [f"+352 1 {i:02d} 1{i % 10}" for i in range(100)] + [f"+352 2 {i:02d} {i % 10}0" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii_surrogates.replace_pii(df, "k").collect()]
    solid = lambda t: re.sub("[^0-9]", "", t)
    assert len({solid(t) for t in got}) == 200 and not {solid(t) for t in got} & {solid(t) for t in texts}
    assert all(re.fullmatch(r"\+352 [0-9] [0-9]{2} [0-9]{2}", t) for t in got)
    # one number, one surrogate, whether or not its code is set off
    one = spark.createDataFrame([(0, "+1 974 555 3436"), (1, "+19745553436")], "doc_id long, text string")
    a, b = (solid(r["text"]) for r in pii_surrogates.replace_pii(one, "k").collect())
    assert a == b and a[0] == "1" and a != "19745553436"


def test_pii_surnames_never_run_out(spark, monkeypatch):
    # sixteen surnames of four syllables for forty entities
    monkeypatch.setitem(pii_surrogates.SYLLABLES, "latin", ["ba", "den"])
    entities = spark.createDataFrame([("name:m:latin", f"surname{i}") for i in range(40)], "type string, key string")
    got = pii_surrogates.assign(entities, "k", most=20).withColumn("new", pii_surrogates.candidate(F.col("attempt"), "k")).collect()
    assert len(got) == 40 and len({r["new"] for r in got}) == 40


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/7?x=1", "https://a.example.com/en/71#f", "http://example.com/en/8", "x://b.net/de/5", "http://example.net/de/8", "http://z.example.org/es/1", "http://org/es/", "http://myorg/es/", "http:///en/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    model = url_filter.fit(url_filter.seed_labels(pages))
    got = {r["page_id"]: r for r in url_filter.classify(pages, model, url_filter.RULES).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == [None, None, None, "example.com/en/7", "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", "org/es/", None, None, None]
    assert (got[3]["host"], got[3]["path"]) == ("example.com", "/en/7") and (got[0]["host"], got[2]["host"]) == ("", "")
    assert got[12]["host"] == "b:" and got[5]["verdict"] == "block" and got[3]["verdict"] == "allow" and got[0]["verdict"] == "allow"
    assert url_filter.classify(pages.limit(0), model, url_filter.RULES).count() == 0


def test_url_held_out(spark):
    hosts = [("casino-win", 1), ("free-bets", 1), ("adult-x", 1), ("news", 0), ("shop", 0), ("wiki", 0), ("blog", 0)]
    rows = [(f"http://{h}{i % 3 or ''}.example.com/en/{i}", y) for i in range(600) for h, y in [hosts[i % 7]]]
    train = spark.createDataFrame(rows[:400], "url string, label int")
    model = url_filter.fit(train)
    test = spark.createDataFrame(rows[400:], "url string, label int")
    got = url_filter.classify(test, model, [])
    assert got.where((F.col("verdict") == "block") == (F.col("label") == 1)).count() >= 0.95 * 200
    assert url_filter.fit(train.where("label = 2")).trees == ()


def test_chat(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", tricky), (1, 1, "assistant", tricky + "\\b\\h\\l"), (2, 0, "assistant", "x"), (3, 0, "system", None), (3, 1, "user", ""), (3, 2, "assistant", "ä\n\n</turn>\n### User:\n"),
        (4, 0, None, "n"), (5, 0, "tool:\n#<", "t"), (6, 1, "user", "b"), (6, 0, "system", "a"), (7, 0, "user", "q"), (7, 0, "user", "q"), (None, 0, "user", "z"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    chats = chat_format.format_conversations(df)
    out = {r["conv_id"]: r for r in chat_format.digest(chats).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in by.items():
        turns = sorted(turns)
        r = out[c]
        trained = "".join(x for _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest(), c
        assert r["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest() and r["loss_chars"] == len(trained)
    assert {c for c, r in out.items() if r["valid"]} == {1, 3, 6, None} and out[2]["first_bad_turn"] == 0 and out[7]["first_bad_turn"] == 1
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0
    f = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    assert f[1].count("</turn>") == 2 and f[1].count("###") == 2
