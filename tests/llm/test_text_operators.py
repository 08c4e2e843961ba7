import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import leakage, near_duplicates, repetition, tokenization

pytest.importorskip("tiktoken")


def shared_of(words, n=8):
    seen, mark = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            mark.update(range(i, i + n))
        seen.add(g)
    return len(mark)


def test_repetition_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40, 90))) for _ in range(30)]
    texts = [t + " " + " ".join(t.split()[: rng.randrange(0, 60)]) for t in texts] + ["again and " * 300, "Ünïcode\u200b Wörter " * 60, "one two three four five six seven eight " * 20_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, "   \n", "x"), (903, "short text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    split = lambda t: re.findall(r"[^\W\d_]+", t.replace("\u200b", "").lower())
    want = {i for i, t, _ in rows if t and len(split(t)) >= 50 and 3 * shared_of(split(t)) >= len(split(t))}
    assert {r["doc_id"] for r in repetition.repetitive(docs).collect()} == want
    got = {r["doc_id"]: r for r in repetition.repetition(docs).collect()}
    assert all(abs(got[i]["repeated_share"] - shared_of(split(t)) / max(1, len(split(t)))) < 1e-9 for i, t, _ in rows if t)
    assert got[900]["words"] == 0 and got[900]["broken"] == [] and "repeated_share" in got[30]["broken"]
    assert repetition.repetitive(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return tokenization.load_ranks(f"{tokenization.TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_encoding_rows(spark, ranks):
    docs = spark.createDataFrame([(1, "Hello  world\n\nagain"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "x" * 300_000), (1, "Hello  world\n\nagain")], "doc_id long, text string")
    rows = tokenization.encode_corpus(docs).collect()
    assert len(rows) == 6
    ids = {r["doc_id"]: r["ids"] for r in rows}
    assert ids[2] == [] and ids[3] == [] and 50256 not in ids[4]
    words = {v: k for k, v in ranks.items()}
    assert all("".join(tokenization.decode(ids[i], words)) == t for i, t in ((1, "Hello  world\n\nagain"), (4, "<|endoftext|>"), (5, "x" * 300_000)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=300))
def test_blocks_encode_as_the_whole(text):
    ranks = tokenization.load_ranks(f"{tokenization.TOKENIZERS}/byte_bpe_50k.tiktoken") if not hasattr(test_blocks_encode_as_the_whole, "t") else None
    if ranks:
        test_blocks_encode_as_the_whole.t = tokenization.Transducer(ranks, block=7)
    t = test_blocks_encode_as_the_whole.t
    assert t.encode(text) == t.coder.encode_ordinary(text)


def test_long_tokens_are_streamed(ranks):
    t, rng = tokenization.Transducer(ranks), random.Random(3)
    for _ in range(5):
        piece = "".join(rng.choice("aeinorstué") for _ in range(3000)).encode()
        parts = list(t.encode_bytes(piece))
        assert len(parts) > 2 and sum(parts, []) == t.coder._encode_single_piece(piece)


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(25)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)]
    docs += [(100 + i, f"Noise: {t.upper().replace(' ', ', ')}! more") for i, t in items] + [(200, None), (201, ""), (202, "a b c"), (100, docs[0][1])]
    n = 6
    grams = {}
    for i, t in items:
        w = leakage.words_of(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = set()
    for d, t in docs:
        w = leakage.words_of(t)
        want |= {(d, i) for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*items, (77, None), items[0]], "item_id long, text string")
    got = leakage.leaked_items(a, b, n=n)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert leakage.leaked_items(a.limit(0), b, n=n).count() == 0 and leakage.leaked_items(a, b.limit(0), n=n).count() == 0


def test_invisible_characters_and_scrubbing(spark):
    item = "the quick brown fox jumps over the lazy dog near an old river bank"
    docs = spark.createDataFrame([(1, "x " * 30 + item.replace("quick", "qu\u00adick").title() + " tail " + "y " * 30), (2, item), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r["doc_id"], r["longest"]) for r in leakage.leaked_items(docs, items).collect()} == {(1, 14), (2, 14)}
    clean = {r["doc_id"]: r["text"] for r in leakage.scrub(docs, items).collect()}
    assert "fox" not in clean[1].lower() and "tail" in clean[1] and clean[2] is None and clean[3] == "clean"


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    sets = []
    for g in range(25):
        base = rng.sample(range(g * 1000, g * 1000 + 900), 60)
        for _ in range(rng.randrange(1, 6)):
            sets.append([v for v in base if rng.random() > 0.12] + rng.sample(range(50_000, 60_000), rng.randrange(0, 6)))
    rows = [(i, s, "x") for i, s in enumerate(sets)] + [(500 + i, sets[0], "x") for i in range(12)] + [(900, None, "x"), (901, [], "x"), (902, [None, 1], "x"), (903, [1, 1], "x"), (0, sets[0], "x")]
    frame = spark.createDataFrame(rows, "k long, s array<long>, rep string")
    clean = {i: {v for v in s or [] if v is not None} for i, s, _ in rows}
    want = {(a, b) for a in clean for b in clean if a < b and clean[a] and clean[b] and 10 * len(clean[a] & clean[b]) >= 7 * len(clean[a] | clean[b])}
    pairs = near_duplicates.similar_pairs(frame, "k", "s")
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r["k"]: r for r in near_duplicates.classes(frame, "k", pairs).collect()}
    assert groups[900]["component"] == 900 and groups[900]["links"] == 0
    assert all(groups[a]["component"] == groups[b]["component"] for a, b in want)
    assert near_duplicates.similar_pairs(frame.limit(0), "k", "s").count() == 0


def test_long_pre_tokens_of_any_letters_digits_or_marks_go_through_the_automaton():
    ranks = tokenization.load_ranks(f"{tokenization.TOKENIZERS}/byte_bpe_50k.tiktoken")
    coder = tokenization.Transducer(ranks, block=8)
    seen = []
    inner = coder.encode_bytes
    coder.encode_bytes = lambda piece: (seen.append(bytes(piece)), inner(piece))[1]
    for text in (" " + "abcdefgh" * 9, "1234567" * 9, "x" + "-=+*" * 15, "ab1" * 5 + "qwertyuio" * 8 + "'s", "été" * 20, "\n" + " " * 50 + "a"):
        seen.clear()
        assert coder.encode(text) == coder.coder.encode_ordinary(text) and seen, text


def test_groups_count_links_of_copies_without_making_them(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PART", 3)
    base = list(range(40))
    rows = [(i, base) for i in range(17)] + [(50 + i, base[:38]) for i in range(8)] + [(90, list(range(500, 540))), (91, []), (92, None), (3, base)]
    frame = spark.createDataFrame(rows, "k long, s array<long>")
    pairs = near_duplicates.similar_pairs(frame, "k", "s")
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    near = [*range(17), *range(50, 58)]
    assert got == {(a, b) for a in near for b in near if a < b} and pairs.count() == len(got)
    want = {r["k"]: (r["component"], r["links"]) for r in near_duplicates.classes(frame, "k", pairs).collect()}
    assert {r["k"]: (r["component"], r["links"]) for r in near_duplicates.groups(frame, "k", "s").collect()} == want and want[3] == (0, 24)


def test_a_table_computes_only_what_it_names(spark):
    docs = spark.createDataFrame([(1, "!?" * 200 + " a b c" * 30), (2, None)], "doc_id long, text string")
    rows = repetition.repetition(docs, thresholds=(("symbol_share", ">", 0.3, 50),)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "words", "symbol_share", "broken"} and rows[0]["broken"] == ["symbol_share"] and rows[1]["broken"] == []
    foreign = spark.createDataFrame([(1, "slovo drugoe " * 40)], "doc_id long, text string")
    assert "stop_word_share" in repetition.repetition(foreign).first()["broken"]


def test_blocks_of_any_size_stream_the_same_ids(ranks):
    rng = random.Random(8)
    t = tokenization.Transducer(ranks)
    for _ in range(400):
        text = "".join(rng.choice(["a", "'", "re", " ", "  ", "\n", "1", "é", "!", "s", "ll", " "]) for _ in range(rng.randrange(80)))
        t.block, size = rng.choice([3, 4, 5, 9]), rng.randrange(1, 9)
        blocks = [text[i : i + size] for i in range(0, len(text), size)]
        assert t.encode_stream(blocks) == t.encode(text) == t.coder.encode_ordinary(text), (text, t.block, size)
    for text in ("x" * 9000, " " * 9000 + "a", "7" * 9000 + "'re", "a" * 5000 + " " * 5000 + "!" * 5000 + "é"):
        t.block = 256
        assert t.encode_stream(text[i : i + 100] for i in range(0, len(text), 100)) == t.coder.encode_ordinary(text)
