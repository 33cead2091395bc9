"""Chat formatting and token counts: exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import chat, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["### ", "</turn>", "\\", "\n", "### Assistant: ", " ok", "a", "é", ": ", "</tur", "#"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "sys tem", "a:b\n%"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5))
def test_turns_come_back(turns):
    text = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in chat.loss_spans(text)] == [t for r, t in turns if r == "assistant"]


def test_plain_texts_stay_plain():
    assert chat.render([("user", "a \\ b")]) == "### user: a \\ b\n</turn>\n"
    with pytest.raises(chat.NotInGrammar):
        chat.parse("### user: a")


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, "user", chat.TRAP_TEXT),
            (2, None, None, "late"), (2, 0, "assistant", "</turn>\n### user: x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nhi\nassistant\n\nassistant\n\n") and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == sha("assistant\n</turn>\n### user: x\n\nlate\n") and got[2]["loss_sha256"] == sha("</turn>\n### user: x")
    assert got[None]["n_turns"] == 1
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []


@pytest.fixture(scope="module")
def pair():
    library = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        return lambda s: len(library.encode(s, add_special_tokens=False).ids), tokencount.PrefixCounter(f.read())


def test_counts_and_prefixes_equal_the_library(pair):
    library, counter = pair
    rng = random.Random(3)
    parts = ["ab", "the", " ", "'s", "'re", "'", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "éü", "12", "!?", "漢字", "\U0001f600", "<|endoftext|>", "<|", "|>", "​", "é"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert counter.prefix_counts(text) == [library(text[:i]) for i in range(len(text) + 1)], repr(text)
    long = "ab" * 300 + " " * 500 + "é" * 200
    assert counter.count(long) == library(long)


def test_token_table(spark, odd_docs, no_docs, pair):
    library, _ = pair
    rows = tokencount.token_counts(odd_docs, PATH).collect()
    texts = {(r["doc_id"], len((r["text"] or "").encode())): r["text"] or "" for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        n = library(texts[r["doc_id"], r["n_bytes"]])
        assert r["n_tokens"] == n and r["over_limit"] == (n > 1024)
    assert tokencount.token_counts(no_docs, PATH).collect() == []


def test_truncation_without_encoding_again(spark, odd_docs, pair):
    library, _ = pair
    some = odd_docs.where("length(text) < 500 or text is null")
    for r in tokencount.truncate_to_budget(tokencount.with_prefix_counts(some, PATH), 5).collect():
        assert library(r["text"]) <= 5 if r["text"] else True
