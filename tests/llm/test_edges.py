"""Very long texts, empty tables, clashing columns, repeated null ids, clashing hashes, and more than one shard."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from tests.llm.test_corpus import brute_components, brute_lines
from tidespan.llm import chat_format, decontamination, katz_lm, line_dedup, ngram_join, packing, pii_surrogates, token_files
from tidespan.llm.arrow_text import ByteHash
from tidespan.llm.set_join import Sets

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def long_rows():
    """Texts of 200,000 words and more, one of them a near copy, one a single word of a million letters, one of line feeds alone."""
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    words = [rng.choice(vocab) for _ in range(200_000)]
    near = list(words)
    for k in range(0, len(near), 4000):
        near[k] = "zzz"
    text = lambda w: "\n".join(" ".join(w[k : k + 40]) for k in range(0, len(w), 40))
    return [(1, text(words)), (2, text(near)), (3, "x" * 1_000_000), (4, "\n" * 300_000), (5, "X" * 1_000_000), (6, "short one")]


def test_long_texts_in_joins(spark):
    rows = long_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs, Sets(words=4, num=85, den=100)).collect()}
    assert got == brute_components(rows, 4, 85, 100) and got[2][1] == 1 and got[5] == (1, 3) and got[4] == (0, 4)
    gone = {(r["doc_id"], r["number"]) for r in line_dedup.later_lines(docs).collect()}
    changed = {k // 40 for k in range(0, 200_000, 4000)}
    assert gone == {(2, k) for k in range(5000) if k not in changed} | {(5, 0)} | {g for g in gone if g[0] == 2 and g[1] in changed}
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_later_lines(docs).collect()}
    assert out[1] == rows[0][1] and out[4] == rows[3][1] and out[5] == ""


def test_long_texts_elsewhere(spark):
    rows = long_rows()
    item = " ".join(rows[0][1].split()[1000:1030])
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    found = decontamination.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {1, 2} <= {r["doc_id"] for r in found} <= {1, 2}
    mail = "write to someone.else@example.org now. "
    long = spark.createDataFrame([(1, rows[0][1][:400_000] + " " + mail + rows[0][1][:400_000]), (2, rows[2][1])], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_pii(long, "key").collect()}
    assert "someone.else@example.org" not in out[1] and out[1].startswith(rows[0][1][:400_000]) and out[2] == rows[2][1]


def test_hex_of_letters_alone_is_a_secret(spark):
    docs = spark.createDataFrame([(1, "see " + "abcdef" * 6 + " there"), (2, "an abcdefabcdef word")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_pii(docs, "key").collect()}
    assert "abcdef" * 6 not in out[1] and out[2] == "an abcdefabcdef word"


def test_names_of_sets_may_clash(spark):
    """With names of six bits nearly all sets meet another one's."""
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcd") for _ in range(3)) for _ in range(40)]
    rows = []
    for i in range(150):
        w = list(rng.choice(rows)[1].split()) if rows and rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(8, 40))]
        w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs, Sets(words=3, num=70, den=100, node_bits=6)).collect()}
    assert got == brute_components(rows, 3, 70, 100)
    lines = Sets(unit="line", words=5, num=80, den=100, ranges=0, node_bits=6)
    assert {(r["doc_id"], r["number"]) for r in line_dedup.later_lines(docs, lines).collect()} == brute_lines(rows)


def test_byte_hash():
    import numpy as np

    h = ByteHash()

    def of(*texts):
        data = "".join(texts).encode()
        bounds = np.cumsum([0, *[len(t.encode()) for t in texts]])
        x, unit = h.words(np.frombuffer(data, np.uint8), bounds)
        return list(zip(unit.tolist(), x.tolist()))

    a = of("One two\n", "", "two\tONE", "x" * 300 + " x")
    assert [u for u, _ in a] == [0, 0, 2, 2, 3, 3] and a[0][1] == a[3][1] and a[1][1] == a[2][1]
    # texts that touch don't join their words, and a word is the same wherever it stands
    assert of("ab", "ab")[0][1] == of("ab", "ab")[1][1] != of("abab")[0][1]
    assert of("pad " * 200_000 + "end")[-1][1] == of("end")[0][1]
    assert len({v for _, v in of(" ".join(f"{i:x}" for i in range(20_000)))}) == 20_000
    assert of("X" * 400)[0][1] == of("x" * 400)[0][1] != of("x" * 401)[0][1] and of("") == []


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 5, 9, "k"), (2, "a b c d e f g", 5, 9, "k"), (None, "x", 1, 1, "k"), (None, "x", 1, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long, component_id long, node string")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.similar_documents(docs, Sets()).collect()) == [(-1, None), (-1, None), (1, 1), (2, 1)]
    assert ngram_join.one_of_each(docs).columns == docs.columns
    kept = line_dedup.without_later_lines(docs.withColumnRenamed("component_id", "number").withColumnRenamed("n_shingles", "_gone"))
    assert kept.columns == ["doc_id", "text", "_gone", "number", "node", "n_removed"]
    odd = docs.toDF("doc_id", "text", "score", "held_out", "n_tokens")
    scores = katz_lm.score(odd).collect()
    assert len(scores) == 4 and len({r["score"] for r in scores if r["doc_id"] is None}) == 1
    files = token_files.write(docs.toDF("doc_id", "text", "start", "n_tokens", "ids_crc32"), BYTE)
    assert Counter(r["doc_id"] for r in token_files.read(files).collect()) == {None: 2, 1: 1, 2: 1}


def test_packing_over_shards(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randint(0, 40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tidespan.session import store

    pieces = store(packing.pieces_of(docs, WORD, 32, 1), "pieces-test")
    out = packing.pack(pieces, 32, shard_rows=70).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len({k >> 32 for k in bins}) > 1 and len(out) == pieces.count()
    for b in bins.values():
        assert sum(n for _, n in b) <= 32 and [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))]


def test_empty_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_chat(spark):
    text = "</turn> \\### ok " * 60_000
    rows = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    r = chat_format.digest(chat_format.format_conversations(rows)).first()
    assert (r["n_turns"], r["loss_chars"]) == (2, len(text)) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
